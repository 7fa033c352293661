"""Progress of runs as a stateful stream: pieces of server-sent event text become events, and events the progress of a run.

Pieces of a run may come late, in any order and more than once, and may cut a frame anywhere. A run keeps the place that it has read
up to, the text of an unfinished frame and the pieces that came too early, until its last event or until nothing came for a while.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PIECES = "run_id string, seq long, at timestamp, piece string"
EVENTS = "run_id string, event_no long, type string, stage string, delta string, data string, elapsed_ms long"
STATE = "next long, tail string, events long, began timestamp, last timestamp, closed boolean, early_seq array<long>, early_at array<timestamp>, early_text array<string>"
#: Events after which a run says no more, and the type of the event that stands for a run that ended without one.
LAST = ("done", "error")
CUT_OFF = "cut_off"


def frames(text: str) -> tuple[list[tuple[str, str]], str]:
    """((event, data) of each whole frame, the rest). Frames end at blank lines; lines of comments and other fields count for nothing."""
    *whole, rest = text.replace("\r\n", "\n").split("\n\n")
    out = []
    for frame in whole:
        event, data = "message", []
        for line in frame.split("\n"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "event":
                event = value
            elif name == "data":
                data.append(value)
        if data or event != "message":
            out.append((event, "\n".join(data)))
    return out, rest


def described(event: str, data: str) -> tuple[str, str | None, str | None]:
    """(type, stage, delta): the type that the data names, else the frame's event."""
    try:
        body = json.loads(data)
    except ValueError:
        body = None
    body = body if isinstance(body, dict) else {}
    text = lambda k: None if body.get(k) is None else str(body[k])
    return (text("type") or event).strip().lower(), text("stage") or text("step"), text("delta")


def events(pieces: DataFrame, quiet: str = "10 minutes") -> DataFrame:
    """The events of a stream of pieces (run_id, seq from 0, at, piece), in their order within each run.

    elapsed_ms counts from the time of the run's first piece to that of the piece that ends the event's frame. A run that got no last
    event ends with one of type cut_off once the watermark is `quiet` past its last piece; what comes for it later starts anew.
    """
    wait = pd.Timedelta(quiet)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (run,) = key
        names = [c.split()[0] for c in EVENTS.split(", ")]
        if state.hasTimedOut:
            _, _, n, began, last, closed, *_ = state.get
            state.remove()
            if not closed:
                yield pd.DataFrame([(run, n, CUT_OFF, None, None, "", int((last - began).total_seconds() * 1000))], columns=names)
            return
        held = list(state.get) if state.exists else [0, "", 0, None, None, False, [], [], []]
        at_next, tail, n, began, last, closed, seqs, ats, texts = held
        early = {s: (pd.Timestamp(a), t) for s, a, t in zip(seqs, ats, texts)}
        for frame in parts:
            for r in frame.itertuples(index=False):
                last = r.at if last is None else max(pd.Timestamp(last), r.at)
                if r.seq >= at_next:
                    early.setdefault(r.seq, (r.at, r.piece or ""))
        rows = []
        while at_next in early and not closed:
            at, text = early.pop(at_next)
            began = at if began is None else began
            at_next += 1
            found, tail = frames(tail + text)
            for event, data in found:
                kind, stage, delta = described(event, data)
                rows.append((run, n, kind, stage, delta, data, int((at - pd.Timestamp(began)).total_seconds() * 1000)))
                n += 1
                if kind in LAST:
                    closed = True
                    break
        if closed:
            tail, early = "", {}
        order = sorted(early)
        state.update((at_next, tail, n, began if began is not None else last, last, closed, order, [early[s][0].to_pydatetime() for s in order], [early[s][1] for s in order]))
        state.setTimeoutTimestamp(max(int((pd.Timestamp(last) + wait).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=names)

    typed = pieces.select(F.col("run_id").cast("string").alias("run_id"), "seq", "at", "piece").withWatermark("at", quiet)
    return typed.groupBy("run_id").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def progress(found: DataFrame) -> DataFrame:
    """A row for each run of events: status (done, error, cut_off or running), events, stages in order, deltas, answer (their text),
    first_event_ms, first_token_ms, total_ms."""
    token = F.col("type") == "generation_delta"
    ordered = lambda c, rule: F.transform(F.array_sort(F.collect_list(F.when(rule, F.struct("event_no", F.col(c).alias("x"))))), lambda s: s["x"])
    return found.groupBy("run_id").agg(
        F.coalesce(F.max(F.when(F.col("type").isin(*LAST, CUT_OFF), F.col("type"))), F.lit("running")).alias("status"), F.count_if(F.col("type") != CUT_OFF).alias("events"),
        ordered("stage", F.col("stage").isNotNull()).alias("stages"), F.count_if(token).alias("deltas"),
        F.array_join(ordered("delta", token & F.col("delta").isNotNull()), "").alias("answer"), F.min("elapsed_ms").alias("first_event_ms"),
        F.min(F.when(token, F.col("elapsed_ms"))).alias("first_token_ms"), F.max("elapsed_ms").alias("total_ms"),
    )
