"""Sessions as a stream: retry budgets and replays with keyed state."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "event_id long, session long, state string, attempts long, stalled long, exhausted boolean, replayed boolean"


def decisions(events: DataFrame, window_micros: int, max_retries: int = 3, no_progress: int = 2) -> DataFrame:
    """A decision for each event (event_id, session, at in microseconds, state) of a stream or a table read as one.

    Attempts count while the state stays the same. An event replays the first evaluation of its state within the window,
    and replays do not move the window. A session's state is its last event and one time for each state name of the last
    window: older ones decide nothing and go.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        last, attempts, anchors = (kept.get[0], kept.get[1], json.loads(kept.get[2])) if kept.exists else (None, 0, {})
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for r in rows.itertuples():
            attempts = attempts + 1 if r.state == last else 1
            last = r.state
            first = anchors.get(r.state)
            replayed = first is not None and r.at - first < window_micros and r.at != first
            if not replayed and first != r.at:
                anchors[r.state] = int(r.at)
            stalled = attempts - 1
            out.append((r.event_id, key[0], r.state, attempts, stalled, attempts > max(1, max_retries) or stalled >= max(1, no_progress), replayed))
        newest = int(rows["at"].max())
        kept.update((last, attempts, json.dumps({k: v for k, v in anchors.items() if newest - v < window_micros})))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return events.groupBy("session").applyInPandasWithState(step, OUTPUT, "last string, attempts long, anchors string", "append", GroupStateTimeout.NoTimeout)


def worked_off(stream: DataFrame) -> DataFrame:
    """All that a stream gives for what is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    at = f"{folder.rstrip('/')}/graphloom/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


#: A task of a session: what was started, its todos, and how often it was urged on.
TASK = "objective string, todos array<boolean>, status string, pokes long, confidences array<long>"
TASK_OUTPUT = "event_id long, session long, kind string, accepted boolean, status string, pending long, pokes long"
MAX_POKES = 5
MAX_CONFIDENCES = 16


def advance(task: dict | None, kind: str, text: str, n: int, most_pokes: int = MAX_POKES) -> tuple[dict | None, bool]:
    """(task, accepted) after an event; a rejected event changes nothing.

    start: text is the objective, n the number of todos. Pokes are carried over, so that a new frame for the same work
    does not renew them, unless the last task was completed, or was blocked and had another objective.
    todo: n more todos. done: todo n is done. Both make the task active again.
    ready: with evidence (text) and no open todo; n is the confidence. gate: a ready task is completed if text is passed,
    and active again if it isn't. poke: an active task is urged on, and blocked when the budget is used up.
    """
    if kind == "start":
        if not text.strip() or n < 0:
            return task, False
        carry = task is not None and task["status"] != "completed" and not (task["status"] == "blocked" and task["objective"] != text)
        return {"objective": text, "todos": [False] * n, "status": "active", "pokes": task["pokes"] if carry else 0, "confidences": task["confidences"] if carry else []}, True
    if task is None:
        return None, False
    task = {**task, "todos": list(task["todos"]), "confidences": list(task["confidences"])}
    open_ = task["todos"].count(False)
    if kind == "todo" and n > 0:
        return {**task, "todos": task["todos"] + [False] * n, "status": "active"}, True
    if kind == "done" and 1 <= n <= len(task["todos"]):
        task["todos"][n - 1] = True
        return {**task, "status": "active"}, True
    if kind == "ready" and text.strip() and not open_ and 0 <= n <= 100:
        return {**task, "status": "ready", "confidences": (task["confidences"] + [n])[-MAX_CONFIDENCES:]}, True
    if kind == "gate" and task["status"] == "ready":
        return {**task, "status": "completed" if text == "passed" else "active"}, True
    if kind == "poke" and task["status"] == "active":
        if task["pokes"] >= min(most_pokes, MAX_POKES):
            return {**task, "status": "blocked"}, True
        return {**task, "pokes": task["pokes"] + 1}, True
    return task, False


def task_states(events: DataFrame, most_pokes: int = MAX_POKES) -> DataFrame:
    """The state of each session's task after each event (event_id, session, at, kind, text, n) of a stream."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TASK.split(", ")]
        task = None
        if kept.exists:
            task = dict(zip(names, kept.get, strict=True))
            task["todos"], task["confidences"] = list(task["todos"]), list(task["confidences"])
        out = []
        for r in pd.concat(list(batches)).sort_values(["at", "event_id"]).itertuples():
            task, accepted = advance(task, r.kind, r.text or "", int(r.n), most_pokes)
            out.append((r.event_id, key[0], r.kind, accepted, task and task["status"], task["todos"].count(False) if task else 0, task["pokes"] if task else 0))
        if task:
            kept.update(tuple(task[n] for n in names))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TASK_OUTPUT.split(", ")])

    return events.groupBy("session").applyInPandasWithState(step, TASK_OUTPUT, TASK, "append", GroupStateTimeout.NoTimeout)
