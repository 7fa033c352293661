"""Classes of links: the same components with or without classes of earlier turns, in few files however many partitions a session has."""

import numpy as np

from corpusloom.llm import dedup


def components(links):
    top = {}

    def of(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((of(a), of(b)))
        top[b] = a
    return {x: of(x) for x in top}


def test_classes_take_up_those_of_earlier_turns_in_few_files(spark, monkeypatch):
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(1000, 1020)]
    star = [(2000, 2000 + i) for i in range(1, 30)]
    links = [*chain, *star, *[(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2)) if a != b]]
    rng.shuffle(links)
    first, second = links[: len(links) // 2], links[len(links) // 2 :]
    frame = lambda rows: spark.createDataFrame([(f"{a:05}".encode(), f"{b:05}".encode()) for a, b in rows], "a binary, b binary")
    named = lambda f: {int(r["node"]): int(r["class"]) for r in f.collect()}
    made = []
    real = dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda f: made.append(real(f)) or made[-1])
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        label = dedup.cut(dedup.classes_of(frame(first)).coalesce(1))
        assert named(label) == components(first)
        assert named(dedup.classes_of(frame(second), label)) == components(links)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert max(len(f.inputFiles()) for f in made) <= spark.sparkContext.defaultParallelism
