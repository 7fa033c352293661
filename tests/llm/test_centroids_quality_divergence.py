"""Centroids, the quality classifier and the divergence audit against plain loops."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import centroids, divergence, quality

# ---------------------------------------------------------------- centroids


def lloyd(rows, k, rounds, size, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in first[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, v in kept:
            of[best(v)[1]].append(v)
        for n, vs in of.items():
            middle[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, best(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, (d, n) in found:
        inertia[n] += d
    return sorted(
        ((-1 if i is None else i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, middle[n])).encode()).hexdigest()) for i, (d, n) in found)
    )


def told(frame):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in frame.collect())


def test_centroids_equal_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).round(2).tolist()) for i in range(300)]
    rows += [(i, [0.0] * 5) for i in range(300, 340)]  # many equal vectors, so that centroids tie and stay empty
    rows += [(None, [0.5] * 5), (7, [0.25] * 5), (7, [0.25] * 5), (400, None), (401, [1.0] * 4), (402, [1.0] * 6), (403, [1.0, None, 1.0, 1.0, 1.0]), (404, [float("nan")] + [1.0] * 4), (405, [float("inf")] + [1.0] * 4)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("clash"), "q": F.lit("clash")}).repartition(5)
    for k in (16, 3):
        assert told(centroids.report(docs, size=5, k=k)) == lloyd(rows, k, 3, 5, 64)
    assert told(centroids.report(docs.limit(0), size=5)) == []
    few = rows[:4]
    assert told(centroids.report(spark.createDataFrame(few, "vec_id long, embedding array<double>"), size=5)) == lloyd(few, 16, 3, 5, 64)
    same = [(i, [0.5] * 5) for i in range(40)]
    assert {r[1] for r in told(centroids.report(spark.createDataFrame(same, "vec_id long, embedding array<double>"), size=5))} == {0}


def test_centroids_refuse_what_a_long_cannot_hold(spark):
    with pytest.raises(Exception, match="steps or more|CAST_OVERFLOW"):
        centroids.report(spark.createDataFrame([(1, [1e8, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>"), size=2).collect()


# ---------------------------------------------------------------- divergence


def plain_audit(docs, least, top):
    counts, seen = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    groups = set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(words)
        seen[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for w, n in seen[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)

        def shares(c, kept=kept):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), collections.Counter()))
        order = lambda x: (-x[1], x[0].encode())
        for s in sources:
            pairs = sorted(((t, sum(abs(p[s][w] - p[t][w]) for w in kept)) for t in sources if t != s), key=order)
            terms = sorted(((w, p[s][w] - q[w]) for w in kept if counts[lang, s][w] and p[s][w] > q[w]), key=order)[:top]
            out |= {(lang, s, part, i, v, r + 1) for part, found in (("pair", pairs), ("term", terms)) for r, (i, v) in enumerate(found)}
    return out


def audited(frame):
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_divergence_equals_a_plain_loop(spark, odd, empty):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("Über", "ab", "Ä", "zz", "日本") for b in ("", "x", "YY", "ß", "q")]
    rows = []
    for i in range(400):
        lang = ["en", "de", None][rng.integers(0, 3)]
        source = [None, "hot", "a", "b", "c", "d", "e"][min(6, rng.geometric(0.35) - 1)]
        rows.append((lang, source, None if i % 50 == 0 else "1, ".join(rng.choice(words, rng.integers(0, 30), p=np.arange(25, 0, -1) / 325))))
    rows += [("fr", "one", "lone words here"), ("fr", "two", ""), ("it", "one", None)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"n": F.lit("clash"), "term": F.lit("clash"), "number": F.lit(1)})
    for least, options in ((5, {"chunk": 4, "slices": 2, "block": 2}), (1, {"chunk": 3, "slices": 1, "block": 3}), (30, {})):
        assert audited(divergence.audit(docs, least_docs=least, top=4, **options)) == plain_audit(rows, least, 4)
    got = audited(divergence.audit(odd, least_docs=1, block=2, chunk=2))
    assert got == plain_audit([(r.lang, r.source, r.text) for r in odd.collect()], 1, 50)
    assert audited(divergence.audit(empty)) == set()


def test_divergence_of_long_texts_and_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 16)
    monkeypatch.setattr(divergence, "HELD", 5)
    rows = [("en", s, t) for s, t in (("a", "word other " * 20_000), ("b", "x" * 100_000 + " word"), ("a", "Some more of it, and more"), ("b", "more"))]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    assert audited(divergence.audit(docs, least_docs=1)) == plain_audit(rows, 1, 50)


def test_shares_are_exact(spark):
    pairs = [(0, 5), (10**15, 9 * 10**15 - 1), (123_456_789_012, 123_456_789_017), (7, 3_000_000_000_001), (0, 8_999_999_999_999_999)]
    want = [1 + 10**9 * (n + 5) // t for n, t in pairs]
    frame = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(pairs)], "i int, n long, t long").orderBy("i")
    assert [r[0] for r in frame.select(divergence.share(F.col("n"), F.col("t"))).collect()] == want
    assert divergence.shares(np.array([n for n, _ in pairs]), np.array([t for _, t in pairs])).tolist() == want


# ---------------------------------------------------------------- quality


def test_chain_equals_all_labellings():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5):
        odds, t = rng.normal(size=n).tolist(), rng.normal(size=(2, 2)).tolist()
        weight = {y: math.exp(sum(u for u, a in zip(odds, y) if a) + sum(t[a][b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=n)}
        forward, backward, total = quality.chain(odds, t)
        assert math.isclose(total, math.log(sum(weight.values())))
        for k in range(n):
            assert math.isclose(quality.sigmoid(forward[k] + backward[k]), sum(w for y, w in weight.items() if y[k]) / sum(weight.values()))


def test_gradient_equals_differences(monkeypatch):
    rng = np.random.default_rng(9)
    w = rng.normal(size=3 * quality.SIZE + 5) * 0.3
    kind, mean, scale = quality.kinds(), rng.normal(size=quality.SIZE) * 0.1, np.ones(quality.SIZE)
    text = "One line.\nANOTHER!! LINE!!\n\nthe the the the\nOne line.\nüñ 42 | x | y".encode()
    for label in (0, 1):
        value, slope = quality.Model(w, mean, scale).gradient(text, label, kind)
        for i in [*rng.integers(0, len(w), 25).tolist(), -5, -4, -3, -2, -1]:
            up, down = w.copy(), w.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            rise = (quality.Model(up, mean, scale).gradient(text, label, kind)[0] - quality.Model(down, mean, scale).gradient(text, label, kind)[0]) / 2e-5
            assert math.isclose(rise, slope[i], abs_tol=1e-6)
        whole = quality.Model(w, mean, scale).score(text, kind)
        monkeypatch.setattr(quality, "PIECE", 7)  # whole lines at a time, and class pairs in stretches
        again = quality.Model(w, mean, scale).gradient(text, label, kind)
        assert math.isclose(again[0], value) and np.allclose(again[1], slope) and math.isclose(quality.Model(w, mean, scale).score(text, kind), whole)
        monkeypatch.undo()


def test_features_of_a_line():
    x, sizes = quality.features(b"ab AB\nab AB\n", quality.kinds(), set())
    pairs = collections.Counter(itertools.pairwise([0, 0, 3, 1, 1, 9]))
    want = [math.sqrt(pairs[a, b] / 6) for a in range(quality.KINDS) for b in range(quality.KINDS)]
    assert sizes.tolist() == [6, 6, 1] and np.allclose(x[0, :-6], want) and x[:, -1].tolist() == [0, 1, 0]
    assert np.allclose(x[0, -6:-1], [math.log(6), math.log(3), 5 / 3, 0.5, 0.5])


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    known = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(known) > 50 and sum(g.predicted == y for g, y in known) >= 0.95 * len(known)
    # Labels of the held-out fold are never learnt.
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.classify(docs, turned).collect()} == {i: r.score for i, r in got.items()}


def test_quality_of_odd_input(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 1), (5, 0), (7, 0), (9, 1), (77, 1)], "doc_id long, quality int").withColumn("score", F.lit("clash"))
    got = quality.classify(odd, labels).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got) and quality.classify(empty, labels).collect() == []
    assert {r.score for r in quality.classify(odd, labels.where("false")).collect()} == {0.5}
    assert {r.score for r in quality.classify(odd, labels.where("quality = 1 and doc_id = 9")).collect()} == {1.0}
    by = {r.doc_id: r for r in got}
    assert by[3].score == by[4].score
