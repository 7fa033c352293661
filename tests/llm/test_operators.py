import base64
import collections
import hashlib
import math
import os
import pathlib
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, brown, dedup, fingerprints, language, licenses, mixing, pii, token_files, webp
from corpusloom.llm.common import scratch


def rows(frame):
    return frame.collect()


rows_of = rows


def words(t):
    return (t or "").encode().lower().split()


def test_fingerprints_follow_weighted_jaccard(spark):
    texts = [" ".join(f"w{(i * j) % (20 + j)}" for i in range(120)) for j in range(1, 40)]
    got = {r.doc_id: r for r in rows(fingerprints.compare_with_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    errors = []
    for k, t in enumerate(texts):
        n = texts[(k + 1) % len(texts)]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        assert got[k].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[k].n_chars == len(t)
        a, b = collections.Counter(t.split()), collections.Counter(e.split())
        errors.append(got[k].near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.05 and np.sqrt(np.mean(np.square(errors))) < 0.12


def test_fingerprints_in_order_of_ids(spark):
    texts = {1000 - 37 * k: f"text {k} " + "x" * (k % 7) + " y" * (k * 11 % 23) for k in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in rows(fingerprints.compare_with_edits(docs))}
    assert len(got) == 40
    ids = sorted(texts)
    share = lambda a, b: sum(a[k : k + 5] == b[k : k + 5] for k in range(0, 320, 5)) / 64
    for k, i in enumerate(ids):
        r, t, n = got[i], texts[i], texts[ids[(k + 1) % 40]]
        half = len(t) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
        assert r.near_next == share(r.fingerprint, got[ids[(k + 1) % 40]].fingerprint) and r.near_edited == share(r.fingerprint, r.edited_fingerprint)


def test_fingerprints_equal_a_plain_loop(spark):
    """Each slot holds the code of the term with the least key, drawn one by one."""
    docs = spark.createDataFrame([(1, "a b b c c c d d d d"), (2, "b a e f f g")], "doc_id long, text string")
    got = {r.doc_id: r for r in rows(fingerprints.compare_with_edits(docs))}
    names = sorted(set("abcdefg"))
    draws = spark.createDataFrame([(w, s) for w in names for s in range(64)], "w string, s int")
    term = F.shiftright(F.xxhash64("w"), 1)
    draws = draws.select("w", "s", F.xxhash64(term, "s").alias("x")).withColumn("y", F.xxhash64("x"))
    table = {(r.w, r.s): (r.x % 2**64, r.y % 2**64) for r in draws.collect()}
    def slot(bag, s):
        keys = []
        for w, n in bag.items():
            x, y = table[w, s]
            u, v, p, q = ((z % 2**32 + 0.5) / 2**32 for z in (x >> 32, x, y, y >> 32))
            r, c = -math.log(u) - math.log(v), -math.log(p) - math.log(q)
            b = -math.log(v) / r
            t = math.floor(math.log(n) / r + b)
            keys.append((c * math.exp(-r * (t - b + 1)), w, t))
        return min(keys)[1:]

    codes = {}
    for i, text in ((1, "a b b c c c d d d d"), (2, "b a e f f g")):
        half = len(text) // 2
        other = {1: "b a e f f g", 2: "a b b c c c d d d d"}[i]
        edited = text[: len(text) - half] + other[:half]
        for t, f in ((text, got[i].fingerprint), (edited, got[i].edited_fingerprint)):
            assert len(f) == 320
            for s in range(64):
                # One code for each least (term, t) of a slot, another for each other.
                codes.setdefault((s, slot(collections.Counter(t.split()), s)), set()).add(f[5 * s : 5 * s + 5])
    assert all(len(c) == 1 for c in codes.values()) and len({(k[0], *c) for k, c in codes.items()}) == len(codes)


def test_fingerprints_odd(odd, empty):
    got = rows(fingerprints.compare_with_edits(odd))
    assert len(got) == 10 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    same = {r.fingerprint for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1 and {r.fingerprint for r in got if r.doc_id in (3, 4, 6)} == {""}
    assert rows(fingerprints.compare_with_edits(empty)) == []


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        total = sum((lambda x: x - 9 if x > 9 else x)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return True


def base_spans(t):
    found = [(m.start(), i, m.end(), k) for i, k in enumerate(PII) for m in re.finditer(PII[k], t or "") if valid(k, m[0])]
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(found))


def test_pii_base_matches_plain_patterns(spark, odd):
    rng = np.random.default_rng(5)
    texts = ["a@b.co_x@d.com", "1.2.3.4.5.6.7.8 001.02.255.256", "4111 1111 1111 1111-4111", "é😀 4111111111111111 a.b+c@m.co.uk", "9" * 300, "++1234567890", "@@a@b.c@d.e"]
    texts += ["".join(rng.choice(list("0123456789 -.@+()aé\n"), 60)) for _ in range(150)]
    got = {r.doc_id: r for r in rows(pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(base_spans(t).encode()).hexdigest(), t
    assert len(rows(pii.report(odd))) == 10


def test_pii_patterns_find_unseen(spark, empty):
    seen = [(i, f"please call me at +1 555 {100 + i}-{2000 + i} today") for i in range(6)]
    new = [(20 + i, f"please call me at 555-{300 + i}-{4000 + i} today") for i in range(3)]
    docs = spark.createDataFrame([*seen, *new, (30, "the year 1984 was call 5"), (31, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in rows(pii.report(docs))}
    assert all(got[i].spans == "phone:18:30" and got[i].n_phone == 0 for i in (20, 21, 22)) and got[30].n_more == 0
    masked = {r.doc_id: r.text for r in rows(pii.redact(docs.withColumn("base", F.lit("clash"))))}
    assert masked[21] == "please call me at [phone] today" and masked[31] is None and masked[30] == "the year 1984 was call 5"
    assert rows(pii.report(empty)) == []


def test_pii_finds_what_is_far_or_written_apart(spark):
    # The numbers of each wave stand behind the words of the one before and behind its own; only the first are seeds.
    sizes = [40, 24, 14, 8, 5, 3]
    words = ["call me", "ring the", "dial this", "reach our", "phone my", "try that"]
    texts = [f"{words[0]} +1 555 {100 + i}-{2000 + i}" for i in range(sizes[0])]
    for k in range(1, len(words)):
        texts += [f"{words[w]} 55{k}-{300 + i}-{4000 + i}" for i in range(sizes[k]) for w in (k - 1, k)]
    # Written with blanks and brackets, and at the beginning of lines alone.
    texts += ["call me (555) 123-4567", "call me 555 123 4567"]
    texts += [f"x\n+1 555 {700 + i}-{8000 + i} logged" for i in range(3)] + ["first line\n555-900-9000 logged"]
    got = {r.doc_id: r.spans for r in rows(pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert all("phone:" in got[i] for i in range(len(texts))), [t for i, t in enumerate(texts) if "phone:" not in got[i]]
    at = texts.index("call me (555) 123-4567")
    assert got[at] == "phone:8:22" and got[at + 1] == "phone:8:20" and got[len(texts) - 1] == "phone:11:23"


def test_pii_in_a_long_text(spark):
    """Some 5 MB of numbers, among them addresses and phone numbers, in one text."""
    piece = "call me at +1 555 123-4567 or a@b.co 10.0.0.1, " + " ".join(str(1000 + k) for k in range(40)) + "\n"
    text = piece * (5_000_000 // len(piece))
    n = text.count("a@b.co")
    docs = spark.createDataFrame([(1, text), (2, "call me at 555-321-7654 today"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in rows(pii.report(docs))}
    assert (got[1].n_email, got[1].n_ip, got[1].n_phone) == (n, n, n)
    assert got[1].base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest()
    masked = {r.doc_id: r.text for r in rows(pii.redact(docs))}
    assert masked[1] == text.replace("+1 555 123-4567", "[phone]").replace("a@b.co", "[email]").replace("10.0.0.1", "[ip]")


def test_brown_base_and_gain(spark, odd, empty):
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(rng.choice([["a", "b"], ["x", "y"]][k % 2]) for k in range(60))) for i in range(120)]
    got = {r.doc_id: r for r in rows(brown.score_corpus(spark.createDataFrame(texts, "doc_id long, text string")))}
    train = [t for i, t in texts if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(w for t in train for w in words(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, t in texts:
        p = lambda x: math.log10((x + 0.5) / (n + 0.5 * (v + 1)))
        assert abs(got[i].base_score - sum(p(c[w]) for w in words(t)) - p(len(train))) < 1e-6
        assert got[i].n_tokens == 61 and got[i].train_tokens == n and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert abs(math.log10(got[i].perplexity) + got[i].score / 61) < 1e-9
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # alternation is learned
    assert len(rows(brown.score_corpus(odd))) == 10 and rows(brown.score_corpus(empty)) == []


@pytest.mark.parametrize("share", [1e-4, 0.02, 2.0])
def test_brown_scores_equal_a_plain_count(spark, monkeypatch, share):
    """The score from the classes that words got, with transitions and emissions counted one by one; few, some or all words are rare."""
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(f"w{int(60 * rng.random() ** 3)}" for _ in range(rng.integers(0, 30)))) for i in range(150)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 5 == 1)
    kept, own = [], brown.vocabulary
    monkeypatch.setattr(brown, "vocabulary", lambda *a: kept.append(own(*a)) or kept[0])
    got = {r.doc_id: r for r in rows(brown.score(docs, docs.where("not held_out"), share=share, classes=6))}
    table = {r["word"]: (r["c"], r["class"]) for r in kept[0].collect()}
    train = [words(t) for i, t in texts if i % 5 != 1]
    c = collections.Counter(w for t in train for w in t)
    assert {w.decode(): n for w, n in c.items()} == {w: n for w, (n, _) in table.items()} and all(0 <= k < 6 for _, k in table.values())
    end = 6
    kind = lambda t: [table[w.decode()][1] for w in t] + [end]
    pairs, mass, sizes = collections.Counter(), collections.Counter(), collections.Counter(k for _, k in table.values())
    for t in train:
        k = kind(t)
        mass.update(k)
        pairs.update(zip([end, *k], k))
    alone = {k: (mass[k] + 0.5) / (sum(mass.values()) + 0.5 * 7) for k in range(7)}
    out = {a: sum(pairs[a, b] for b in range(7)) for a in range(7)}
    for i, t in texts:
        t = words(t)
        if all(w in c for w in t):
            k = kind(t)
            want = sum(math.log10((pairs[a, b] + brown.PRIOR * alone[b]) / (out[a] + brown.PRIOR)) for a, b in zip([end, *k], k))
            want += sum(math.log10((c[w] + 0.5) / (mass[b] + 0.5 * (sizes[b] + 1))) for w, b in zip(t, k))
            assert abs(got[i].score - want) < 1e-6


def test_rare_words_go_to_the_best_class():
    rng = np.random.default_rng(6)
    right = rng.integers(0, 30, (5, 7)).astype(float)
    table = np.concatenate([right, right[:, ::-1]], axis=1)  # a class's words have as many neighbours on either side
    codes, ns, sizes, old = [], [], [], []
    for k in range(40):
        right, left = rng.choice(7, 3, replace=False), rng.choice(7, 3, replace=False)
        n = rng.integers(1, 5, 3) * (1 + 20 * (k % 3))
        codes += [*sorted(right), *(7 + np.sort(left))]
        ns += [*n, *n]
        sizes.append(6)
        old.append(k % 6 - 1)
        if old[-1] >= 0:
            np.add.at(table[old[-1]], codes[-6:], ns[-6:])
    codes, ns = np.array(codes), np.array(ns)
    got = brown.best_of_rare(np.array(old), codes, ns, np.array(sizes), brown.Gains(table))
    for k in range(40):
        here, worth = slice(6 * k, 6 * k + 6), []
        for b in range(5):
            t = table.copy()
            if old[k] >= 0:
                np.subtract.at(t[old[k]], codes[here], ns[here])
            np.add.at(t[b], codes[here], ns[here])
            worth.append(brown.information(t[:, :7]) + brown.information(t[:, 7:]))
        assert worth[got[k]] >= max(worth) - 1e-3


def similar(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def bag(t):
    w = words(t)
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def near_texts():
    rng = np.random.default_rng(2)
    out = []
    for g in range(12):
        base = [f"g{g}w{rng.integers(40)}" for _ in range(80)]
        for copy in range(6):
            t = list(base)
            for _ in range(copy):
                t[rng.integers(len(t))] = f"new{rng.integers(1000)}"
            out.append(" ".join(t))
    return out


def components(texts):
    bags = [bag(t) for t in texts]
    top = list(range(len(texts)))
    find = lambda x: x if top[x] == x else find(top[x])
    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and similar(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("stars", [1, 3])
def test_near_duplicates_equal_brute_force(spark, stars):
    texts = near_texts()
    got = {r.doc_id: r.class_id for r in rows(dedup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), stars=stars))}
    assert [got[i] for i in range(len(texts))] == components(texts)


def test_block_comparison_finds_links(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 2)
    texts = near_texts()[:12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = dedup.nodes_of(docs, dedup.BANDS, dedup.ROWS).cache()
    nodes = {bytes(r.node): r.doc_id for r in signed.collect()}
    members = signed.select("node", F.explode("bands").alias("band"), F.col("node").alias("class"))
    found = dedup.across(members, signed.select("node", "n", "slots", "bands"), dedup.texts_of(docs, signed.select("node")), 0.8)
    got = {tuple(sorted((nodes[bytes(r.a)], nodes[bytes(r.b)]))) for r in found.collect()}
    assert got == {(j, i) for i in range(12) for j in range(i) if texts[i] != texts[j] and similar(bag(texts[i]), bag(texts[j])) >= 0.8}


def test_bag_signatures_follow_weighted_jaccard():
    a = collections.Counter({k: 1 + k % 7 for k in range(200)})
    b = collections.Counter({k: 1 + (k * 3) % 5 for k in range(60, 260)})
    flat = [(t, k, w) for t, c in enumerate((a, b)) for k, w in sorted(c.items())]
    s = dedup.bag_signatures(np.array([x[0] for x in flat]), dedup.mixed(np.array([x[1] for x in flat], np.uint64)), np.array([x[2] for x in flat]), 2, 4000)
    assert abs((s[0] == s[1]).mean() - similar(a, b)) < 0.03


def test_keep_one(odd, empty):
    kept = rows(dedup.keep_one(odd))
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "3", "4", "5", "6", "7", "9", "None"]) and kept[0].node == "clash"
    assert rows(dedup.keep_one(empty)) == [] and rows(dedup.groups(empty)) == []


def test_bpe_equals_the_library(spark, odd, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    own, library = bpe.Encoder(bpe.Vocabulary(open(path).read())), Tokenizer.from_file(path)
    texts = ["", "It's <|endoftext|>x 'LL", "ΣΑΣ ΟΔΟΣ.", "İ ﬁ é 한글", "½ ² Ⅷ 12", "!" * 300 + "a" * 300, "😀👩‍👩‍👧", "a\x1cb\x85c"]
    for t in texts:
        e, ids = library.encode(t, add_special_tokens=False), own.encode([t])[0]
        assert ids == e.ids and own.decode(ids) == library.decode(e.ids, skip_special_tokens=False)
    got = rows(bpe.decode(bpe.encode(odd, path, outputs=("n_tokens", "ids")), path))
    assert len(got) == 10 and all(len(r.ids) == r.n_tokens for r in got)
    assert rows(bpe.encode(empty, path)) == []


def test_mixing(spark, odd, empty):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), ["a", "b", "c", None][min(3, i % 6)]) for i in range(300)], "doc_id long, text string, source string")
    got = rows(mixing.mix(docs))
    assert sorted(r.doc_id for r in got) == list(range(300)) and got == rows(mixing.mix(docs))
    by = collections.defaultdict(lambda: [0, 0, 0, 0])
    for r in got:
        s = by[["a", "b", "c", None][min(3, r.doc_id % 6)]]
        s[0] += r["size"]
        s[1], s[2] = r.source_size, r.target
        s[3] += r.taken
        assert r.taken <= 2 * r["size"] and (r.taken == 0 or 0 <= r.first_position <= r.last_position <= 1)
    assert all(s[0] == s[1] and abs(s[2] - s[3]) <= 1 and s[2] <= 2 * s[1] + 1e-9 for s in by.values())
    assert abs(sum(s[2] for s in by.values()) - 1.5 * sum(s[1] for s in by.values())) < 1e-6
    copies = collections.Counter(r.doc_id for r in rows(mixing.mixed(docs)))
    assert all(copies.get(r.doc_id, 0) == r.copies for r in got)
    assert len(rows(mixing.mix(odd))) == 10 and rows(mixing.mix(empty)) == [] and mixing.mixed(odd).columns == odd.columns


def test_due_inverts_the_schedule(spark):
    s = (1.5, 1.0, 0.5)
    t = [r[0] for r in spark.range(101).select(mixing.due(F.col("id") / 100, s)).collect()]
    area = lambda x: 1.5 * x - 0.5 * x * x
    assert all(abs(area(x) - k / 100) < 1e-9 for k, x in enumerate(t))


def test_webp_round_trips():
    rng = np.random.default_rng(1)
    for w, h in ((1, 1), (7, 5), (33, 9)):
        few = rng.integers(0, 5, w * h) * 0x01010101
        for x in (rng.integers(0, 1 << 32, w * h), few):
            for tr in ((), ((webp.SUBTRACT_GREEN,),)):
                for cache in (0, 1, 11):
                    assert (webp.decode(webp.encode(x, w, h, tr, cache))[2] == x).all()
            k = (w + 3 >> 2) * (h + 3 >> 2)
            for mode in range(14):
                assert (webp.decode(webp.encode(x, w, h, ((webp.PREDICTOR, 2, np.full(k, mode)),)))[2] == x).all()
            mix = ((webp.PREDICTOR, 2, rng.integers(0, 14, k)), (webp.CROSS_COLOUR, 2, webp.OPAQUE | rng.integers(0, 1 << 24, k)), (webp.SUBTRACT_GREEN,))
            assert (webp.decode(webp.encode(x, w, h, mix))[2] == x).all()
        assert (webp.decode(webp.encode(few, w, h, ((webp.PALETTE,),)))[2] == few).all()
    with pytest.raises(ValueError):
        webp.decode(webp.store(bytes(64)) [:20] + b"\x00" * 20)


def test_webp_writer_picks_by_the_samples():
    rng = np.random.default_rng(2)
    part = lambda n: rng.integers(32, 127, n).astype(np.uint8).tobytes()
    # A run that recurs inside lines, with no line end at all.
    run = part(400)
    alone, twice = run + part(624), part(100) + run + part(40) + run + part(84)
    assert len(webp.store(twice)) < len(webp.store(alone)) - 250
    # Samples that repeat the ones above but for small steps get a predictor, else they cost as much as noise.
    slope = np.cumsum(rng.integers(0, 3, 4096)).astype(np.uint8).tobytes()
    assert len(webp.store(slope)) < len(webp.store(part(4096))) / 2
    # Samples of two slots that stay for a while each get the cache.
    assert any(bits for _, bits in webp.hopeful(np.repeat(rng.integers(0, 256, 512), 5).astype(np.uint8), 64))
    for p in (alone, twice, slope):
        assert webp.load(webp.store(p), len(p))[0] == p


def test_webp_of_long_texts(monkeypatch):
    rng = np.random.default_rng(3)
    long = rng.integers(32, 127, 3 << 20).astype(np.uint8).tobytes()
    assert webp.load(webp.store(long), len(long))[0] == long
    # Streams that end and go on at any place of a stretch, with copies, and with the cache.
    run = rng.integers(0, 20, 300).astype(np.uint8)
    mixed = np.concatenate([np.append(rng.integers(0, 256, rng.integers(1, 90)).astype(np.uint8), run) for _ in range(60)])
    mixed = mixed[: len(mixed) // 64 * 64]
    for stretch in (64, 100, 257):
        monkeypatch.setattr(webp, "STRETCH", stretch)
        assert webp.load(webp.store(mixed.tobytes()), len(mixed))[0] == mixed.tobytes()
        argb = webp.OPAQUE | mixed.astype(np.int64) << 8
        for cache in (0, 4):
            assert (webp.decode(webp.encode(argb, 64, len(mixed) // 64, (), cache))[2] == argb).all()


def test_webp_reads_pixels_at_any_bit():
    """Literals that begin at each of the eight bits of a byte, and texts of all sorts of lengths by the quick reader."""
    rng = np.random.default_rng(5)
    for n in range(40):
        values = rng.choice(256, 17 + n, replace=False).astype(np.int64)
        argb = webp.OPAQUE | values[rng.integers(0, len(values), 64 * 8)] << 8
        for cache in (0, 3):
            file = webp.encode(argb, 64, 8, (), cache)
            assert (webp.decode(file)[2] == argb).all()
    for _ in range(2000):
        size = 64 * int(rng.integers(1, 60))
        payload = rng.integers(32, 32 + int(rng.integers(20, 90)), size).astype(np.uint8)
        payload[size - int(rng.integers(0, 64)) :] = 0
        assert webp.load(webp.store(payload.tobytes()), size)[0] == payload.tobytes()


def test_webp_files_of_other_writers():
    """Two public one-pixel files that browsers are probed with."""
    for text, pixel in (("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", 0), ("UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=", 0xFFFFFFFF)):
        width, height, argb = webp.decode(base64.b64decode(text))
        assert (width, height, argb.tolist()) == (1, 1, [pixel])


def test_webp_column(odd, empty):
    got = rows(webp.media_column(odd, with_media=True))
    for r, t in zip(got, [x.text for x in odd.collect()]):
        n, payload = webp.payload_of(t)
        assert (r.n_bytes, r.payload_bytes) == (n, len(payload)) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert rows(webp.media_column(empty)) == []


def test_licenses(spark, odd, empty):
    assert licenses.evaluate("MIT OR GPL-3.0-only AND Apache-2.0")[1] == 1.0
    assert licenses.evaluate("(MIT OR GPL-3.0-only) AND CC-BY-NC-4.0") == ({"mit", "gpl-3", "cc-by-nc"}, 0.1)
    assert licenses.evaluate("GPL-2.0 WITH Classpath-exception-2.0")[1] == pytest.approx(0.6)
    assert licenses.evaluate("MITRE-1.0 OR ISCTE")[0] == {"mitre-1.0", "iscte"} and licenses.evaluate("LGPL-2.1-or-later")[0] == {"lgpl"}
    assert licenses.evaluate("MIT AND (")[0] == {"mit"} and licenses.evaluate("")[1] == 0.0
    text = "x Under  the MIT-License! CC BY-NC y apache license, version 2.0\n// SPDX-License-Identifier: (MIT OR BSD-3-Clause)\n"
    got = {r.doc_id: r for r in rows(licenses.scan(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")))}
    tokens = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    assert got[1].n_words == len(tokens) and got[1].n_base == 3 and got[1].first_word == 1 and got[1].base_labels == "apache-2,cc-by-nc,mit"
    assert got[1].labels == "apache-2,bsd,cc-by-nc,mit" and (got[2].n_words, got[2].first_word, got[2].score) == (0, None, 0.0)
    assert len(rows(licenses.scan(odd))) == 10 and rows(licenses.scan(empty)) == []


def test_language(spark, odd, empty):
    rng = np.random.default_rng(3)
    kinds = {"aa": ["alpha", "beta", "gamma"], "bb": ["über", "schön", "grün"]}
    docs = [(i, " ".join(rng.choice(v) for _ in range(12)), k) for i, (k, v) in enumerate(list(kinds.items()) * 60)]
    got = {r.doc_id: r for r in rows(language.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")))}
    assert all(got[i].lang_pred == k for i, _, k in docs) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in docs)
    und = {r.doc_id for r in rows(language.identify(odd)) if r.lang_pred == "und"}
    assert {3, 4, 6} <= und and rows(language.identify(empty)) == []
    kept = language.keep_known(odd)
    assert kept.columns == odd.columns and kept.count() == 7


def test_license_places_equal_a_plain_search(spark):
    rng = np.random.default_rng(8)
    parts = ["under", "the", "MIT", "license", "apache", "License", "version", "2", "cc", "by", "nc", "é", "x_y", "2.0", "under the mit license", "cc-by-nc"]
    texts = [(" -,\n"[rng.integers(4)]).join(rng.choice(parts, rng.integers(0, 60))) for _ in range(200)]
    got = {r.doc_id: r for r in rows(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower().decode())
        at = [(k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(r.labels.split(","))


def test_language_equals_plain_distances(spark):
    """Profiles, distances and ties worked out gram by gram."""
    import unicodedata

    rng = np.random.default_rng(9)
    letters = {"aa": "abcde é", "bb": "cdefg ü1", "cc": "xyzab -"}
    docs = [(i, "".join(rng.choice(list(letters[k]), rng.integers(0, 400))), k) for i, k in enumerate(list(letters) * 40)]
    got = {r.doc_id: r for r in rows(language.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")))}

    def grams(t):
        s = re.sub(" +", " ", "".join(x.lower() if unicodedata.category(x)[0] == "L" else " " for x in f" {t} "))
        points = [0 if x == " " else ord(x) for x in s]
        if len(points) < 3:
            return collections.Counter()
        out = [(a, 0) for a in points if a] + [(a << 20 | b, 1) for a, b in zip(points, points[1:])]
        return collections.Counter(x << 2 | n for x, n in out + [(a << 40 | b << 20 | c, 2) for a, b, c in zip(points, points[1:], points[2:]) if b])

    best = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: language.PROFILE]]
    learned = collections.defaultdict(collections.Counter)
    for i, t, k in docs:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            learned[k] += grams(t)
    places = {k: {g: r for r, g in enumerate(best(c))} for k, c in learned.items()}
    for i, t, _ in docs:
        own = best(grams(t))
        if not own:
            assert got[i].lang_pred == "und"
            continue
        far = {k: sum(abs(p[g] - r) if g in p else language.PROFILE for r, g in enumerate(own)) for k, p in places.items()}
        want = min(sorted(far), key=far.get)
        assert got[i].lang_pred == want and abs(got[i].score - (1 - far[want] / (language.PROFILE * len(own)))) < 1e-9


def test_mixing_equals_a_plain_fill(spark):
    """Targets by filling level by level; taken words by running sums in the order of the hash."""
    rng = np.random.default_rng(10)
    docs = [(i, "w " * int(rng.integers(0, 12)), [None, "a", "b", "c", "d"][int(5 * rng.random() ** 2)]) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in rows(mixing.mix(frame))}
    hashes = {r.doc_id: r.h for r in frame.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    size = {i: len(t.split()) for i, t, _ in docs}
    total = collections.Counter()
    for i, _, s in docs:
        total[s] += size[i]
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, rest, open_ = {}, 1.5 * sum(total.values()), set(order)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * total[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else level * weight[s]
        rest -= sum(target[s] for s in full)
        open_ -= full or open_
    for s in order:
        goal, begin = math.floor(target[s] + 1e-9), 0
        for i in sorted((i for i, _, x in docs if x == s), key=lambda i: (hashes[i], i)):
            passes = goal // total[s]
            assert got[i].taken == passes * size[i] + max(0, min(size[i], goal - passes * total[s] - begin)) and abs(got[i].target - target[s]) < 1e-6
            begin += size[i]


@pytest.mark.parametrize("block", [1, 3, 65536])
def test_token_counts(spark, odd, empty, block):
    folder = scratch(spark, "tokens")
    listed = token_files.write(odd.repartition(3), folder)
    got = listed.join(token_files.count(listed, folder, block=block), ["file", "ordinal"]).collect()
    want = sorted(len(words(r.text)) for r in odd.collect())
    assert sorted(r.n_tokens for r in got) == want
    assert rows(token_files.count_documents(spark, empty, scratch(spark, "tokens"))) == []


def test_language_stage_decides_by_profiles(spark):
    """Texts whose grams no profile has go; null languages are filled; with no language to learn, all rows stay."""
    many = [(i, f"the cat number {i} sat on the mat and slept", "en") for i in range(30)] + [(i, f"der Hund Nummer {i} schläft auf der Matte", "de") for i in range(30, 60)]
    rows = [*many, (60, "the dog sat on a mat", None), (61, "日本語 文章", None), (62, "12 !", None), (63, None, "en"), (64, "schläft der Hund", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    got = {r.doc_id: r for r in rows_of(language.keep_known(docs))}
    assert set(got) == set(range(61)) | {64} and (got[60].lang, got[64].lang, got[0].lang, got[60].lang_pred) == ("en", "de", "en", "clash")
    assert len(rows_of(language.keep_known(docs.withColumn("lang", F.lit(None).cast("string"))))) == 65


def test_queries_need_no_package_on_the_workers(tmp_path):
    """Each operator's query runs in a session elsewhere, whose workers cannot import the library."""
    top = pathlib.Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(top)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from corpusloom.llm import queries
for name, query in queries.queries().items():
    query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=900)
    assert done.stdout.count("ran op") == 13, done.stderr[-3000:]


def test_pipeline_stages(spark, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == odd.columns
    ids = {r.doc_id for r in docs.collect()}
    assert not ids & {2, 3, 4, 6} and "bob@example.com" not in " ".join(r.text for r in docs.collect())
    assert all(r.n_tokens == len(r.ids) for r in pipeline.STAGES[-1][1](spark, docs, "").collect())
