"""MinHash near-dedup with BagMinHash over multisets of five-word shingles.

A shingle of weight w carries a Poisson process over (time, height) for heights below w. Heights are discretised into
units and gathered into intervals that double, each a process of its own whose points fall into the interval's halves,
quarters and so on down to one unit; the points below w count. So the processes of two weights share exactly the points
below the lesser one, and the earliest point in each of m slots agrees for two texts with the probability of their
weighted Jaccard similarity. Signatures are cut into bands; texts that share a band are compared on their whole multisets.

Exact copies become one node first. A band's nodes are compared to one of them, not to each other; links make classes, and
only where a band still holds several classes are nodes of different classes compared, block by block, so that no
link between different texts is lost.

Results for odd input: null texts and texts without words are never copies and stay classes of their own; a text of fewer
than five words is one shingle; copies of any number become one class with the least doc_id as its name; null ids come
first; repeated rows are copies; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .brown import tokens
from .common import cut, renamed

WORDS = 5
SIMILARITY = 0.8
#: 32 bands of 5 slots: a pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^32 < 4e-6.
BANDS = 32
ROWS = 5
#: Rounds in which a band's nodes are compared with one of them, drawn anew for each band and round, before nodes of
#: different classes are compared with each other.
STARS = 3
#: Nodes of a band that are compared with each other in one task, at most.
BLOCK = 1000
TEXTS = 512
#: Rows of links, bands and classes in a file, about.
WRITTEN = 1 << 16

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the shingles of all texts one after another, their number in each text)."""
    index, lengths, distinct = tokens(texts)
    codes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in distinct.to_pylist()], np.uint64)
    # Pad each text to at least one shingle's words, unless it has none.
    padded = np.where(lengths > 0, np.maximum(lengths, words), 0)
    starts = np.cumsum(padded) - padded
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = starts[row] + np.arange(len(index)) - (np.cumsum(lengths) - lengths)[row]
    seq = np.zeros(int(padded.sum()), np.uint64)
    if len(index):
        seq[at] = codes[index]
    n = np.maximum(padded - words + 1, 0)
    first = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    h = np.zeros(len(first), np.uint64)
    for k in range(words):
        h = mixed(h * _STEP + seq[first + k] + np.uint64(k + 1))
    return h, n


def weighted(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the distinct shingles of each text, sorted."""
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    edge = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, np.int64)
    return text[edge], h[edge], np.diff(np.append(edge, len(h)))


def bag_signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, slots: int) -> np.ndarray:
    """The time of the earliest point in each slot, for each text; infinite for texts without shingles."""
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    owner = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    width = np.where(level > 1, 2.0 ** (level - 1), 1.0)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    e_text, top = text[owner], weight[owner].astype(float)
    seed = mixed(shingle[owner] + (level.astype(np.uint64) + np.uint64(1)) * _MIX2)
    total = np.bincount(text, weight, minlength=n_texts)
    best = np.full(n_texts * slots, np.inf)
    horizon = slots * (np.log(slots) + 3) / np.maximum(total, 1)
    pending = total > 0
    while pending.any():
        live = np.flatnonzero(pending[e_text])
        time = np.zeros(len(live))
        state = seed[live]
        while len(live):
            state = state + _STEP
            r = mixed(state)
            time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width[live]
            go = time <= horizon[e_text[live]]
            live, time, state = live[go], time[go], state[go]
            if not len(live):
                break
            s = mixed(state ^ _MIX1)
            slot = (s >> np.uint64(32)) % np.uint64(slots)
            # Halving the interval bit by bit ends at this unit of it.
            unit = low[live] + np.floor((s & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 * width[live])
            hit = unit < top[live]
            np.minimum.at(best, e_text[live][hit] * slots + slot[hit].astype(np.int64), time[hit])
        done = np.isfinite(best.reshape(n_texts, slots)).all(axis=1)
        pending &= ~done
        horizon[pending] *= 2
    return best.reshape(n_texts, slots)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each text and band."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    h = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2]).copy()
    for k in range(rows):
        h = mixed(h * _STEP + bits[:, :, k])
    return h


def node_key(text: str) -> bytes | None:
    """Names a text's words in their order; none for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def row_key() -> list:
    """_k, _k2: two hashes of a row's id and text, the same for repeated rows only."""
    return [F.xxhash64("doc_id", "text").alias("_k"), F.xxhash64("text", "doc_id", F.lit(1)).alias("_k2")]


def nodes_of(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, _k, _k2, node, bands, n (shingles), slots (16 bits of each) of each document."""
    keyed = docs.select("doc_id", "text", *row_key())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.drop("text").schema.fields)

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = pc.fill_null(part.column(1), "")
                h, n = shingles(texts)
                signature = bag_signatures(*weighted(h, n), len(texts), bands * rows)
                keys = band_keys(signature, bands, rows).view(np.int64)
                slots = (mixed(np.ascontiguousarray(signature).view(np.uint64)) >> np.uint64(48)).astype(np.uint16).view(np.int16)
                nodes = [node_key(t) for t in texts.to_pylist()]
                lists = pa.array([k if node else None for k, node in zip(list(keys), nodes)], pa.list_(pa.int64()))
                short = pa.array(list(slots), pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(nodes, pa.binary()), lists, pa.array(n, pa.int64()), short], names=["doc_id", "_k", "_k2", "node", "bands", "n", "slots"])

    return keyed.mapInArrow(sign, f"{fields}, node binary, bands array<long>, n long, slots array<short>")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted nodes: a task passes a node on once, however many copies it meets."""

    def name(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in it:
            nodes = [node_key(t or "") for t in batch.column(0).to_pylist()]
            new = []
            for node in nodes:
                new.append(node is not None and node not in seen)
                seen.add(node)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column(0)], names=["node", "text"]).filter(pa.array(new))

    named = docs.select("text").mapInArrow(name, "node binary, text string")
    return named.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def alike(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose shingle multisets are at least this similar."""

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                b_texts = batch.column(3).dictionary_encode()
                row_of, h, w = [], [], []
                for column in (batch.column(2), b_texts.dictionary):
                    for x, y in zip((row_of, h, w), weighted(*shingles(column))):
                        x.append(y)
                place = b_texts.indices.to_numpy(zero_copy_only=False)
                n = batch.num_rows
                size_a = np.bincount(row_of[0], w[0], minlength=n)
                size_b = np.bincount(row_of[1], w[1], minlength=len(b_texts.dictionary))[place]
                starts = np.searchsorted(row_of[1], np.arange(len(b_texts.dictionary) + 1))
                ends_a = np.searchsorted(row_of[0], np.arange(n + 1))
                both = np.zeros(n)
                for i in range(n):
                    a, b = slice(ends_a[i], ends_a[i + 1]), slice(starts[place[i]], starts[place[i] + 1])
                    hb, wb = h[1][b], w[1][b]
                    if len(hb):
                        k = np.minimum(np.searchsorted(hb, h[0][a]), len(hb) - 1)
                        both[i] = np.minimum(w[0][a], wb[k])[hb[k] == h[0][a]].sum()
                yield batch.select(["a", "b"]).filter(pa.array(both >= similarity * (size_a + size_b - both) - 1e-9))

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("_b")), "b").select("a", "b", "_a", "_b")
    return with_b.mapInArrow(compare, "a binary, b binary")


def least_agreement(similarity: float, slots: int) -> int:
    """Slots in which texts of this similarity agree at least, but for five standard deviations: a chance below 1e-6."""
    return max(1, int(slots * similarity - 5 * (slots * similarity * (1 - similarity)) ** 0.5))


def blocked(members: DataFrame) -> DataFrame:
    """Adds to members of a band the pairs of blocks bi <= bj that they take part in, and their own block."""
    sizes = members.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    own = members.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    other = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return other.withColumn("bi", F.least("block", "_other")).withColumn("bj", F.greatest("block", "_other")).drop("_blocks", "_other")


def across(members: DataFrame, sizes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b: the links between nodes of one band and different classes.

    Bands go through in pairs of blocks, so that no task holds more than two blocks. A first pass over slots and sizes keeps
    the nodes that may have a link, the second compares whole multisets and returns links only. A pair counts in the
    first band that it shares.
    """

    def pairs(t: pa.Table, key: tuple) -> Iterator[tuple[int, np.ndarray]]:
        cls = t.column("class").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        block, n = t.column("block").to_numpy(), t.column("n").to_numpy()
        matrix = lambda c: np.stack(t.column(c).to_numpy(zero_copy_only=False))
        slots, bands = matrix("slots"), matrix("bands")
        least = least_agreement(similarity, slots.shape[1])
        place = np.argmax(bands[0] == key[0].as_py())
        for i in range(len(cls) - 1):
            j = np.arange(i + 1, len(cls))
            j = j[(cls[j] != cls[i]) & (np.minimum(n[j], n[i]) >= similarity * np.maximum(n[j], n[i]) - 1e-9)]
            if key[1] != key[2]:
                j = j[block[j] != block[i]]
            j = j[(slots[j] == slots[i]).sum(axis=1) >= least] if len(j) else j
            if place and len(j):
                j = j[~(bands[j][:, :place] == bands[i][:place]).any(axis=1)]
            if len(j):
                yield i, j

    def candidates(key: tuple, t: pa.Table) -> pa.Table:
        hit = np.zeros(t.num_rows, bool)
        for i, j in pairs(t, key):
            hit[i] = True
            hit[j] = True
        return t.select(["band", "node"]).filter(pa.array(hit))

    def links(key: tuple, t: pa.Table) -> pa.Table:
        text, h, w = weighted(*shingles(t.column("text").combine_chunks()))
        ends = np.searchsorted(text, np.arange(t.num_rows + 1))
        total = np.bincount(text, w, minlength=t.num_rows)
        nodes = t.column("node").to_pylist()
        out = []
        for i, js in pairs(t, key):
            hi, wi = h[ends[i] : ends[i + 1]], w[ends[i] : ends[i + 1]]
            for j in js.tolist():
                hj, wj = h[ends[j] : ends[j + 1]], w[ends[j] : ends[j + 1]]
                k = np.minimum(np.searchsorted(hj, hi), len(hj) - 1)
                both = np.minimum(wi, wj[k])[hj[k] == hi].sum()
                if both >= similarity * (total[i] + total[j] - both) - 1e-9:
                    out.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})

    rest = members.join(sizes, "node")
    near = blocked(rest).groupBy("band", "bi", "bj").applyInArrow(lambda key, t: candidates(key, t), "band long, node binary").distinct()
    some = rest.join(cut(near), ["band", "node"]).join(texts, "node")
    return blocked(some).groupBy("band", "bi", "bj").applyInArrow(lambda key, t: links(key, t), "a binary, b binary").distinct()


def few(frame: DataFrame, rows: int) -> DataFrame:
    """Stored in as many files as so many rows need: a pass over few links has no use for hundreds of tasks and files."""
    return cut(frame.coalesce(max(frame.sparkSession.sparkContext.defaultParallelism, -(-rows // WRITTEN))))


def classes_of(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, class of every node with a link: the least node it reaches.

    Large and small stars in turn: each pass hangs a node's neighbours on the least of them; a few passes leave only stars.
    Links of an earlier turn may be given as its classes, which are stars already.
    """
    if known is not None:
        links = links.select("a", "b").unionAll(known.select(F.col("node").alias("a"), F.col("class").alias("b")))
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, n = few(edges, links.count()), None
    while True:
        n = edges.count()
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Only stars are left where no node hangs on two others, or on one while others hang on it.
        role = both.groupBy("u").agg(F.count_if(F.col("v") < F.col("u")).alias("up"), F.count_if(F.col("v") > F.col("u")).alias("down"))
        if role.where("up > 1 or up = 1 and down > 0").isEmpty():
            break
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = few(large.where("u <> v").distinct(), n)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = few(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), n)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct())


def classes(docs: DataFrame, signed: DataFrame, similarity: float, stars: int) -> tuple[DataFrame, DataFrame]:
    """(node, class of the nodes that have links; a, b of the links) for the signed documents."""
    nodes = signed.where("node is not null").select("node", "bands").dropDuplicates(["node"])
    slots = nodes.select("node", F.explode("bands").alias("band"))
    shared = slots.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    slots = cut(slots.join(shared.select("band"), "band"))
    n_slots = slots.count()
    texts = cut(texts_of(docs, slots.select("node").distinct()))
    sizes = signed.where("node is not null").select("node", "n", "slots", "bands").dropDuplicates(["node"])
    tried = links = None
    label = None
    for turn in range(stars + 1):
        if turn == 0:
            members = slots.withColumn("class", F.col("node"))
        else:
            members = slots.join(label, "node", "left").withColumn("class", F.coalesce("class", "node"))
        drawn = F.xxhash64("node", "band", F.lit(turn))
        spread = members.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min(F.struct(drawn.alias("h"), "node", "class")).alias("one")).where("low <> high")
        spread = few(spread, n_slots)
        if links is not None and spread.isEmpty():
            break
        if turn == stars:
            # What is left shares bands without being alike, as texts with a passage in common do, or is alike at the edge.
            found = cut(across(members.join(spread.select("band"), "band", "left_semi"), sizes, texts, similarity))
            links = links.unionAll(found)
            label = few(classes_of(found, label), n_slots)
            break
        pairs = members.join(spread, "band").where("class <> one.class").select("node", F.col("one.node").alias("other"))
        pairs = pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = few(pairs, n_slots)
        found = cut(alike(pairs, texts, similarity))
        tried = pairs if tried is None else tried.unionAll(pairs)
        links = found if links is None else links.unionAll(found)
        label = few(classes_of(found, label), n_slots)
    return label, links


def groups(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, stars: int = STARS) -> DataFrame:
    """doc_id, class_id, links_found of every document of doc_id, text.

    links_found counts its copies and the links verified on the way: enough to join the class, not all pairs in it.
    """
    signed = cut(nodes_of(docs, bands, rows))
    label, links = classes(docs, signed, similarity, stars)
    degree = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links_found"))
    copies = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    named = copies.join(label, "node", "left").withColumn("class", F.coalesce("class", "node")).join(degree, "node", "left")
    names = named.groupBy("class").agg(F.min("first").alias("class_id"))
    named = named.join(names, "class").select("node", "class_id", (F.coalesce("links_found", F.lit(0)) + F.col("copies") - 1).alias("links_found"))
    return signed.select("doc_id", "node").join(named, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links_found", F.lit(0)).cast("long").alias("links_found"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, stars: int = STARS) -> DataFrame:
    """The documents, whole, with one of each class: that of the least id, of repeated rows any one."""
    inner, names = renamed(docs)
    signed = cut(nodes_of(inner, bands, rows))
    label, _ = classes(inner, signed, similarity, stars)
    first = F.min(F.struct("doc_id", "_k", "_k2")).alias("first")
    nodes = signed.where("node is not null").groupBy("node").agg(first).join(label, "node", "left")
    stay = nodes.groupBy(F.coalesce("class", "node").alias("class")).agg(F.min("first").alias("first")).select("first._k", "first._k2", F.lit(True).alias("_single"))
    stay = stay.unionAll(signed.where("node is null").select("_k", "_k2", F.lit(False)).distinct())
    kept = inner.select(*names, *row_key()).join(stay, ["_k", "_k2"])
    copy = F.row_number().over(Window.partitionBy("_k", "_k2").orderBy(F.lit(0)))
    return kept.withColumn("_copy", copy).where("not _single or _copy = 1").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
