"""The state of runs as a stateful stream: one processor folds a run's events as they come, with a timer for silence.

What a line says is told by columns before the processor, the same as in the batch fold; the processor keeps counts,
the last value of each kind with its place in the log, and the last lines. State lies in the RocksDB store, so it
may outgrow memory, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.progress import KEPT, LAST, STATE, described, marked

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HELD = "completed long, failed long, stale boolean, " + ", ".join(f"{c} {k}, {c}_seq long" for c, k in LAST.items())


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON-lines files (run, seq, line, returncode) as they appear in a folder."""
    return spark.readStream.schema("run string, seq long, line string, returncode int").json(path)


class RunFold(StatefulProcessor):
    """Folds the marked events of a run. A run without an exit code that is silent for `idle_ms` is stale."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)
        self.lines = handle.getListState("lines", "seq long, line string")

    def _facts(self) -> dict:
        if self.held.exists():
            return dict(zip((c.split()[0] for c in _HELD.split(", ")), self.held.get()))
        return {"completed": 0, "failed": 0, "stale": False} | {k: v for c in LAST for k, v in ((c, None), (f"{c}_seq", None))}

    def _out(self, key: tuple, facts: dict, lines: list[tuple]) -> Iterator[pd.DataFrame]:
        row = {"run": key[0], "completed": facts["completed"], "failed": facts["failed"]} | {c: facts[c] for c in LAST}
        row |= {"log": [x for _, x in lines], "stale": facts["stale"]}
        yield pd.DataFrame({k: pd.Series([v], dtype=object) for k, v in row.items()})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        facts, lines = self._facts(), list(self.lines.get()) if self.lines.exists() else []
        facts["stale"] = False
        for frame in rows:
            facts["completed"] += int((frame["outcome"] == "OK").sum())
            facts["failed"] += int((frame["outcome"] == "FAIL").sum())
            for c in LAST:
                said = frame.loc[frame[c].notna(), ["seq", c]]
                if len(said):
                    seq, value = said.loc[said["seq"].idxmax()]
                    if facts[f"{c}_seq"] is None or seq >= facts[f"{c}_seq"]:
                        facts[f"{c}_seq"], facts[c] = int(seq), int(value) if LAST[c] == "int" else value
            told = frame.loc[frame["line"].notna(), ["seq", "line"]]
            lines = sorted([*lines, *told.itertuples(index=False, name=None)])[-KEPT:]
        lines = [(int(n), x) for n, x in lines]
        self.held.update(tuple(facts[c.split()[0]] for c in _HELD.split(", ")))
        self.lines.put(lines) if lines else self.lines.clear()
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if facts["returncode"] is None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self._out(key, facts, lines)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        facts = self._facts() | {"stale": True}
        self.held.update(tuple(facts[c.split()[0]] for c in _HELD.split(", ")))
        yield from self._out(key, facts, list(self.lines.get()) if self.lines.exists() else [])

    def close(self) -> None:
        pass


def run_states(events: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """The state of every run that changed, each time it does; as `progress.run_state` gives it for all events.

    Events may come in any order: places in the log decide. `idle_ms` 0 sets no timer.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    folded = marked(events).groupBy("run").transformWithStateInPandas(RunFold(idle_ms), "run string, " + STATE, "Update", "ProcessingTime" if idle_ms else "None")
    return described(folded)


def start(states: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what changes in each batch to a folder of `out` named by the batch, over a half-written one of the same
    number, until all that is there is read; a restart goes on from the checkpoint.

    Batches without data, which would wait for timers without an end, are turned off for the query: a timer fires with
    the next batch that has any.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    states.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return states.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The last state of every run that `start` has written."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return rows.groupBy("run").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("run", "batch"))), "batch").alias("s")).select("run", "s.*")
