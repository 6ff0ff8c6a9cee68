"""Monitors against a sequential simulation, in several batches and across a restart."""

import random
import tempfile
from datetime import datetime, timedelta

from codeloom.streaming import monitor

T0 = datetime(2026, 1, 1)


def simulated(rows, columns, step):
    out, states = [], {}
    for row in sorted(rows, key=lambda r: (r[1], [(x is not None, x) for _, x in sorted(zip(columns, r)) if _ not in ("ts",)])):
        x = dict(zip(columns, row))
        if x["path"] is None or x["ts"] is None:
            continue
        x["seconds"] = x["ts"].timestamp()
        action = step(states.setdefault(x["path"], {}), x)
        if action:
            out.append((x["path"], x["ts"], x["head"], action))
    return sorted(out, key=repr)


def replayed(spark, rows, schema, step):
    """In three batches by time, the last one after a restart from the checkpoint."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    top = tempfile.mkdtemp(prefix="spark-")
    rows = sorted(rows, key=lambda r: r[1])
    cut = len(rows) // 3
    for k, part in enumerate((rows[:cut], rows[cut : 2 * cut], rows[2 * cut :])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{top}/in")
        stream = spark.readStream.schema(schema).parquet(f"{top}/in")
        found = monitor.written_to_end(monitor.machine(stream, step), f"{top}/out", f"{top}/checkpoint")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return sorted(((r["path"], r["ts"], r["head"], r["action"]) for r in found.collect()), key=repr)


def test_syncs(spark):
    r = random.Random(1)
    columns = ["path", "ts", "kind", "head", "freshness", "status", "changes", "busy"]
    rows = [(r.choice("ab"), T0 + timedelta(seconds=7 * i), r.choice(["state"] * 6 + ["run"]), r.choice(["h1", "h2"]), r.choice(["stale", "stale", "fresh"]), r.choice(["ok", "failed", "failed", "degraded"]), r.random() < 0.1, r.random() < 0.1) for i in range(160)]
    got = replayed(spark, rows, "path string, ts timestamp, kind string, head string, freshness string, status string, changes boolean, busy boolean", monitor.sync_step)
    assert got == simulated(rows, columns, monitor.sync_step) and len(got) >= 3


def test_observer(spark):
    r = random.Random(2)
    rows = [(r.choice("abc"), T0 + timedelta(seconds=11 * i), r.choice(["h1"] * 9 + ["h2", None]), r.choice([0, 0, 0, 1, 4])) for i in range(200)]
    got = replayed(spark, rows, "path string, ts timestamp, head string, stale int", monitor.observer_step)
    assert got == simulated(rows, ["path", "ts", "head", "stale"], monitor.observer_step)
    assert {a for *_, a in got} == {"crawl", "rest"} and len(got) < 200


def test_rules():
    state = {}
    tick = lambda s, head="h", stale=0: monitor.observer_step(state, {"seconds": s, "head": head, "stale": stale})
    assert [tick(0, stale=2), tick(20), tick(40, stale=1), tick(110, stale=1), tick(120), tick(130, "g"), tick(140, None)] == ["crawl", "rest", None, "crawl", "rest", "rest", None]
    state = {}
    see = lambda s, **x: monitor.sync_step(state, {"kind": "state", "head": "h", "freshness": "stale", "status": "ok", "changes": False, "busy": False, "seconds": s} | x)
    assert [see(0, busy=True), see(1), see(2), see(3, kind="run", status="failed"), see(30), see(61), see(62, head="g")] == [None, "sync", None, None, None, "sync", "sync"]
