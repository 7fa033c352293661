"""Progress of runs out of pieces of event text: out of order, repeated, cut anywhere and cut off."""

import datetime
import json
import random

from pyspark.sql import functions as F

from corpusloom.streaming import events, progress

START = datetime.datetime(2024, 1, 1)


def frame(kind, **more):
    return f"event: {kind}\ndata: {json.dumps({'type': kind, **more})}\n\n"


def story(words, end="done"):
    return ": hello\n\n" + frame("start", mode="standard") + frame("retrieval", stage="retrieve") + "".join(frame("generation_delta", delta=w) for w in words) + (frame(end) if end else "event: gene")


def pieces(run, text, cuts, ms=100):
    edges = [0, *sorted(cuts), len(text)]
    return [(run, i, START + datetime.timedelta(milliseconds=ms * i), text[a:b]) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def test_frames_are_cut_anywhere():
    text = story(["a", "b\n"]).replace("\n", "\r\n")
    found, rest = progress.frames(text)
    assert [e for e, _ in found] == ["start", "retrieval", "generation_delta", "generation_delta", "done"] and rest == ""
    assert progress.frames("data: 1\ndata: 2\n\nevent: x") == ([("message", "1\n2")], "event: x")
    assert progress.described("x", "no json") == ("x", None, None) and progress.described("x", '{"type": " Done "}') == ("done", None, None)


def test_runs_out_of_order_and_cut_off(spark, tmp_path):
    rng = random.Random(5)
    whole = pieces("whole", story(["one ", "two"]), rng.sample(range(1, 150), 12))
    failed = pieces("failed", story(["half"], end="error") + frame("late"), [40, 41, 90])
    silent = pieces("silent", story(["never ", "ends"], end=None), rng.sample(range(1, 150), 5))
    gap = [p for p in pieces("gap", story(["x"]), [20, 60, 100]) if p[1] != 1]  # a piece that never comes
    batches = [[], [], []]
    for p in whole + failed + silent + gap:
        batches[rng.randrange(2)].append(p)
    batches[1] += rng.sample(whole, 4)  # again
    batches[2] = [("clock", 0, START + datetime.timedelta(hours=2), frame("start"))]  # lets the watermark pass the silent ones
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for n, rows in enumerate([*batches, [("clock", 1, START + datetime.timedelta(hours=2), frame("done"))]]):
        rng.shuffle(rows)
        spark.createDataFrame(rows, progress.PIECES).coalesce(1).write.mode("append").parquet(folder)
        stream = progress.events(spark.readStream.schema(progress.PIECES).parquet(folder))
        events.publish(stream, out, check).awaitTermination()  # each batch starts the query anew from its checkpoint
    got = spark.read.schema(progress.EVENTS).option("recursiveFileLookup", "true").parquet(out)
    told = {r.run_id: r for r in progress.progress(got).collect()}
    assert (told["whole"].status, told["whole"].events, told["whole"].stages, told["whole"].answer, told["whole"].deltas) == ("done", 5, ["retrieve"], "one two", 2)
    assert told["whole"].first_event_ms <= told["whole"].first_token_ms <= told["whole"].total_ms <= 1200
    assert (told["failed"].status, told["failed"].answer, told["failed"].events) == ("error", "half", 4)
    assert (told["silent"].status, told["silent"].answer) == ("cut_off", "never ends") and told["gap"].status == "cut_off"
    assert told["clock"].status == "done"
    order = got.where("run_id = 'whole'").orderBy("event_no").collect()
    assert [r.event_no for r in order] == list(range(5)) and [r.type for r in order][0] == "start"
    assert got.groupBy("run_id", "event_no").count().where(F.col("count") > 1).isEmpty()
