"""Progress of a run, from its log lines: as a batch fold; `streaming` applies the same aggregates to a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def progress_aggregates(line: Column, seq: Column) -> list[Column]:
    """What a run's lines say: the last announced total, how many ended and failed, the last that ended."""
    total, outcome = S.log_total(line), S.log_outcome(line)
    name = S.log_name(line)
    return [
        F.coalesce(F.max_by(total, F.when(total.isNotNull(), seq)), F.lit(0)).alias("total"),
        F.count_if(outcome == "OK").alias("completed"),
        F.count_if(outcome == "FAIL").alias("failed"),
        F.coalesce(F.max_by(name, F.when(outcome.isNotNull(), seq)), F.lit("")).alias("current"),
    ]


def with_percent(folded: DataFrame) -> DataFrame:
    done = F.col("completed") + F.col("failed")
    return folded.withColumn("done", done).withColumn("percent", S.percent_done(done, F.col("total")))


def progress(lines: DataFrame, *keys: str) -> DataFrame:
    """Progress of every run (or of the only one), over all its lines."""
    return with_percent(lines.groupBy(*keys).agg(*progress_aggregates(F.col("line"), F.col("seq"))))


def completion(lines: DataFrame, *keys: str) -> DataFrame:
    """How a run ended: the last summary and archive it names (the whole rest of the line), and the last JSON object with `run_dir`."""
    line, seq = F.col("line"), F.col("seq")
    last = lambda value, ok: F.max_by(value, F.when(ok, seq))
    named = lambda mark: (F.trim(F.get(F.split(line, mark, 2), F.lit(1))), F.contains(line, F.lit(mark)))
    run = F.array_contains(F.json_object_keys(line), "run_dir")
    json = F.trim(line).startswith("{") & F.try_parse_json(line).isNotNull() & F.coalesce(run, F.lit(False))
    return lines.groupBy(*keys).agg(last(*named("Done. summary=")).alias("summary"), last(*named("Zip=")).alias("archive"), last(line, json).alias("manifest"))


def log_tail(lines: DataFrame, n: int, *keys: str) -> DataFrame:
    """The last n lines of every run."""
    rank = F.row_number().over(Window.partitionBy(*keys, F.lit(0)).orderBy(F.desc("seq")))
    return lines.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


#: Lines of a run that its state keeps. Fixed value.
KEPT = 500
#: What a run's lines say, each the last of its kind: column and type.
LAST = {"total": "int", "current": "string", "summary": "string", "archive": "string", "manifest": "string", "returncode": "int"}
STATE = "completed long, failed long, " + ", ".join(f"{c} {k}" for c, k in LAST.items()) + ", log array<string>, stale boolean"


def marked(events: DataFrame) -> DataFrame:
    """Events (run, seq, line, returncode) with what each line says: a run's exit is an event with its code.

    Adds `outcome` (OK, FAIL) and the columns of LAST, null where a line doesn't say them.
    """
    line = F.col("line")
    outcome, name = S.log_outcome(line), S.log_name(line)
    after = lambda mark: F.when(F.contains(line, F.lit(mark)), F.trim(F.get(F.split(line, mark, 2), F.lit(1))))
    run = F.coalesce(F.array_contains(F.json_object_keys(line), "run_dir"), F.lit(False))
    json = F.trim(line).startswith("{") & F.try_parse_json(line).isNotNull() & run
    return events.select(
        "run", "seq", "line", "returncode", outcome.alias("outcome"), S.log_total(line).alias("total"), F.when(outcome.isNotNull(), name).alias("current"),
        after("Done. summary=").alias("summary"), after("Zip=").alias("archive"), F.when(json, line).alias("manifest"),
    )


def state_aggregates() -> list[Column]:
    """The fold of marked events into STATE: counts, the last value of each kind by `seq`, the last lines."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in LAST]
    said = F.col("line").isNotNull()
    lines = F.array_sort(F.collect_list(F.when(said, F.struct("seq", "line"))))
    tail = F.transform(F.slice(lines, F.greatest(F.size(lines) - KEPT + 1, F.lit(1)), KEPT), lambda x: x["line"])
    return [F.count_if(F.col("outcome") == "OK").alias("completed"), F.count_if(F.col("outcome") == "FAIL").alias("failed"), *last, tail.alias("log"), F.lit(False).alias("stale")]


def described(states: DataFrame) -> DataFrame:
    """STATE rows as a run's state: phase, running, progress, exit code, paths, counts of the manifest, last lines.

    A run is `running` until its exit code is known; 0 makes it `completed`, anything else `failed`; one that fell
    silent is `failed` without a code. A manifest names folder and archive before the lines do; without it, the folder
    is that of the summary. Whether the files are there is not looked at.
    """
    told = lambda k: F.get_json_object("manifest", f"$.{k}")
    phase = F.when(F.col("returncode") == 0, "completed").when(F.col("returncode").isNotNull() | F.col("stale"), "failed").otherwise("running")
    folder = F.when(F.contains("summary", F.lit("/")), F.regexp_replace("summary", "/[^/]*$", ""))
    out = with_percent(states.withColumn("total", F.coalesce("total", F.lit(0))).withColumn("current", F.coalesce("current", F.lit(""))))
    return out.select(
        "run", phase.alias("phase"), (phase == "running").alias("running"), "returncode", "total", "completed", "failed", "done", "percent", "current",
        F.col("summary").alias("summary_path"), F.coalesce(F.nullif(told("run_dir"), F.lit("")), folder).alias("run_dir"), F.coalesce(F.nullif(told("zip"), F.lit("")), "archive").alias("zip_path"),
        told("ok").cast("long").alias("repos_ok"), told("failed").cast("long").alias("repos_failed"), "log",
    )


def run_state(events: DataFrame) -> DataFrame:
    """The state of every run from all its events (run, seq, line, returncode); `streaming` folds the same as they come.

    A run's last lines are gathered by its key, as many as it has: for logs without a bound, use the stream.
    """
    return described(marked(events).groupBy("run").agg(*state_aggregates()))


def restored(states: DataFrame) -> DataFrame:
    """States as they are after a restart: what ran then has failed."""
    was = F.col("phase") == "running"
    return states.withColumn("phase", F.when(was, "failed").otherwise(F.col("phase"))).withColumn("running", F.lit(False))
