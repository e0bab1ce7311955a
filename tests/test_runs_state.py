"""The state of runs: the stream equals the batch on golden logs, after a restart and out of order, too."""

import json
import time

import pytest

from quarrylight.operators import progress
from quarrylight.streaming import runs

EVENTS = [
    ("a", 1, "Extracting 3 repos", None), ("a", 2, "[1/3] OK o/x: 1", None), ("a", 3, "FAIL o/y: broken", None),
    ("a", 4, "Done. summary=/out/run 1/summary.csv", None), ("a", 5, "Zip=/out/run.zip", None),
    ("a", 6, '{"run_dir": "/out/other", "zip": "/out/other.zip", "ok": 2, "failed": 1}', None), ("a", 7, None, 0),
    ("b", 1, "Extracting 2 repos", None), ("b", 2, "Done. summary=/out/b/summary.csv", None), ("b", 3, "Zip=/b.zip", None), ("b", 4, '{"other": 1}', None), ("b", 5, None, 3),
    ("c", 1, "[1/9] OK o/z: 1", None),
    *(("d", k, f"line {k}", None) for k in range(1200)),
]
SCHEMA = "run string, seq long, line string, returncode int"


def plain(rows):
    return {r.run: r.asDict() for r in rows}


def test_batch(spark):
    got = plain(progress.run_state(spark.createDataFrame(EVENTS, SCHEMA)).collect())
    pick = lambda k, *names: tuple(got[k][n] for n in names)
    names = ("phase", "running", "returncode", "total", "done", "percent", "current", "summary_path", "run_dir", "zip_path", "repos_ok", "repos_failed")
    assert pick("a", *names) == ("completed", False, 0, 3, 2, 66, "o/y", "/out/run 1/summary.csv", "/out/other", "/out/other.zip", 2, 1)
    assert pick("b", *names) == ("failed", False, 3, 2, 0, 0, "", "/out/b/summary.csv", "/out/b", "/b.zip", None, None)
    assert pick("c", *names) == ("running", True, None, 0, 1, 0, "o/z", None, None, None, None, None)
    assert got["d"]["log"] == [f"line {k}" for k in range(700, 1200)]
    after = plain(progress.restored(progress.run_state(spark.createDataFrame(EVENTS, SCHEMA))).collect())
    assert {k: (r["phase"], r["running"]) for k, r in after.items()} == {"a": ("completed", False), "b": ("failed", False), "c": ("failed", False), "d": ("failed", False)}
    assert progress.run_state(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("order", ["as it comes", "turned"])
def test_stream_equals_batch_after_a_restart(spark, tmp_path, order):
    want = plain(progress.run_state(spark.createDataFrame(EVENTS, SCHEMA)).collect())
    events = EVENTS if order == "as it comes" else EVENTS[::-1]
    log, out, checkpoint = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "check")
    log.mkdir()
    for part in range(3):
        names = SCHEMA.replace(",", "").split()[::2]
        (log / f"{part}.json").write_text("\n".join(json.dumps(dict(zip(names, e))) for e in events[part::3]))
        runs.start(runs.run_states(runs.event_stream(spark, str(log))), out, checkpoint).awaitTermination()
    assert plain(runs.latest(spark, out).collect()) == want


def test_a_silent_run_has_failed(spark, tmp_path):
    log, out, checkpoint = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "check")
    log.mkdir()
    put = lambda n, *events: (log / f"{n}.json").write_text("\n".join(json.dumps({"run": r, "seq": s, "line": x}) for r, s, x in events))
    go = lambda: runs.start(runs.run_states(runs.event_stream(spark, str(log)), idle_ms=50), out, checkpoint).awaitTermination()
    put(0, ("slow", 1, "Extracting 1 repos"))
    go()
    assert plain(runs.latest(spark, out).collect())["slow"]["phase"] == "running"
    time.sleep(0.2)
    put(1, ("other", 1, "x"))
    go()
    assert plain(runs.latest(spark, out).collect())["slow"]["phase"] == "failed"
    put(2, ("slow", 2, "[1/1] OK o/r: 1"))
    go()
    got = plain(runs.latest(spark, out).collect())["slow"]
    assert (got["phase"], got["percent"], got["log"]) == ("running", 100, ["Extracting 1 repos", "[1/1] OK o/r: 1"])
