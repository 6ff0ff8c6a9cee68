"""State machines over streams of observations, one per path: automatic syncs and the observer's passes.

A machine is a step: (state, observation) to an action or none, with the state a small
dictionary.  Spark keeps a path's state between batches, restores it from the checkpoint after a
restart, and gives each path to one task, so there is one flight a path.  Observations of a batch are
taken by time, then in the order of their other columns; one that comes after a later one was seen
is taken when it comes.  Null paths and times are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.staging import scratch

#: Fixed values, in seconds: between two attempts for one head; between two full checks while resting.
ATTEMPT, RESTING = 60, 90
ACTIONS = "path string, ts timestamp, head string, action string"


def sync_step(state: dict, x: dict) -> str | None:
    """'sync' where a path's baseline is to be refreshed by itself.

    Observations have kind 'state' (head, freshness, status, changes, busy) or 'run' (head, status).  Nothing
    is done while the state is degraded or fresh, has local changes or a question is being answered (busy), while the
    last run of the head is queued, running or completed, and within a minute of the last attempt for it.
    The state holds a status and a time a head.
    """
    runs, tried = state.setdefault("runs", {}), state.setdefault("tried", {})
    head = x["head"] or ""
    if x["kind"] == "run":
        runs[head] = x["status"]
        return None
    if x["status"] == "degraded" or x["freshness"] == "fresh" or x["changes"] or x["busy"] or runs.get(head) in ("queued", "running", "completed"):
        return None
    if x["seconds"] - tried.get(head, -ATTEMPT) < ATTEMPT:
        return None
    tried[head] = x["seconds"]
    runs[head] = "queued"
    return "sync"


def observer_step(state: dict, x: dict) -> str | None:
    """What an observer does at a tick (head, stale: units that are not fresh): 'crawl' one unit, 'rest', or nothing.

    While it rests it checks again only if the head is another one or 90 seconds are over since the last full check; without a
    stale unit it rests, with one it crawls and rests no more.
    """
    if state.get("resting"):
        changed = x["head"] is not None and x["head"] != state.get("head")
        if not changed and x["seconds"] - state["checked"] < RESTING:
            return None
    state["checked"], state["head"] = x["seconds"], x["head"]
    state["resting"] = not x["stale"]
    return "crawl" if x["stale"] else "rest"


def machine(observations: DataFrame, step: Callable[[dict, dict], str | None]) -> DataFrame:
    """(path, ts, head, action) for each observation (path, ts, head and what ``step`` reads) of a stream that has an action."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(kept.get[0]) if kept.exists else {}
        rows = pd.concat(list(batches))
        rows = rows.sort_values(["ts", *sorted(c for c in rows.columns if c != "ts")], kind="stable")
        out = []
        for row in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            row["seconds"] = row["ts"].timestamp()
            action = step(state, row)
            if action:
                out.append((key[0], row["ts"], row["head"], action))
        kept.update((json.dumps(state),))
        if out:
            yield pd.DataFrame(out, columns=["path", "ts", "head", "action"])

    known = observations.where("path is not null and ts is not null")
    return known.groupBy("path").applyInPandasWithState(run, ACTIONS, "state string", "append", GroupStateTimeout.NoTimeout)


def written_to_end(actions: DataFrame, folder: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """All that the stream has now, as files; the same folder and checkpoint go on where a former run, or one that failed, ended."""
    spark = actions.sparkSession
    folder, checkpoint = folder or scratch(spark, "actions"), checkpoint or scratch(spark, "checkpoint")
    query = actions.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(actions.schema).parquet(folder)
