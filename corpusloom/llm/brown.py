"""Brown class-based bigrams: exchange clustering assigns words to classes; class transitions and word emissions score texts.

Every word of the training texts is clustered. Words whose share of all training tokens is at least `share` (at most 1 / share
of them, whatever the corpus) go first: they exchange classes by the counts of what follows and precedes them. All rarer words
then do the same in shuffled partitions, by the counts of the classes beside them. A turn moves many words at once by the
counts before it, so it only holds if the classes' mutual information with their neighbours has risen by it; two turns in a row
that fail end a stage. Then the transitions between classes are counted over all training texts. A token's probability is that
of its class after the class before it, times that of the word in its class, where a word not seen has the share of half a
count in the class that most words seen once and spelled like it are in.

Results for odd input: null counts as empty, and a text without words is one end token; repeated rows count each; classes of
equal gain go to the one with the smaller number; with nothing to learn from every token is unseen; a long text is worked on
alone, its tokens as arrays; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remainder

SHARE = 1e-4
CLASSES = 64
SPELLINGS = 64
#: Share by which a turn must raise the mutual information.
LEAST_GAIN = 1e-3
#: Texts and bytes of text that a task takes at a time, and bytes of text in a scoring block, about.
TEXTS = 4096
SLICE_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
#: Partitions at most that the blocks are dealt to.
PARTITIONS = 1 << 14
#: Counts of a word's neighbours that are weighed at a time.
COUNTS = 1 << 14
#: Counts up to which gains are looked up.
LOOKED_UP = 16
#: Weight of the class's own frequency against what followed the class before it, in tokens.
PRIOR = 10.0


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(place of each token's word in the list of words, words of each text, distinct words)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = parts.flatten()
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(parts)), lengths)[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False), np.bincount(owner, minlength=len(parts)), coded.dictionary


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, some at a time; one that is longer than a slice stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = min(at + TEXTS, max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))))
        yield texts.slice(at, to - at)
        at = to


def spelling(words: pa.Array) -> np.ndarray:
    """The spelling class of each word, from its last two bytes."""
    if not len(words):
        return np.empty(0, np.int64)
    words = words.cast(pa.large_binary()) if not pa.types.is_large_binary(words.type) else words
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    last = data[ends[1:] - 1].astype(np.int64)
    before = np.where(ends[1:] - ends[:-1] > 1, data[np.maximum(ends[1:] - 2, 0)], 0)
    return (last * 31 + before) % SPELLINGS


def word_counts(train: DataFrame) -> DataFrame:
    """word, c of the training texts' words."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for batch in it:
            for texts in slices(batch.column(0)):
                index, _, words = tokens(texts)
                held.append(pa.table({"word": words, "c": np.bincount(index, minlength=len(words)).astype(np.int64)}))
                if sum(t.num_rows for t in held[1:]) > max(400_000, held[0].num_rows):
                    held = [merged()]
                    if held[0].num_rows > 1_500_000:  # bounds memory; the sums go on in the shuffle
                        yield from held[0].to_batches()
                        held = [held[0].slice(0, 0)]
        if held:
            yield from merged().to_batches()

    return train.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def unit_bigrams(train: DataFrame, frequent: pa.Array) -> DataFrame:
    """u, v, n: how often unit v follows unit u. Units: the frequent words, the spelling classes, the end of a text."""
    size = len(frequent) + SPELLINGS + 1
    end = size - 1

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns = np.empty(0, np.int64), np.empty(0, np.int64)
        new: list[np.ndarray] = []

        def fold() -> None:
            nonlocal keys, ns
            a, b = np.unique(np.concatenate(new), return_counts=True)
            new.clear()
            keys, at = np.unique(np.concatenate([keys, a]), return_inverse=True)
            ns = np.bincount(at, np.concatenate([ns, b]), minlength=len(keys)).astype(np.int64)

        for batch in it:
            for texts in slices(batch.column(0)):
                seq, _ = sequence(*tokens(texts), frequent)
                new.append(np.append(end, seq[:-1]) * size + seq)
                if sum(map(len, new)) > 2_000_000:
                    fold()
        if new:
            fold()
            yield pa.RecordBatch.from_arrays([pa.array(keys // size), pa.array(keys % size), pa.array(ns)], names=["u", "v", "n"])

    return train.select("text").mapInArrow(count, "u long, v long, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


def units(words: pa.Array, frequent: pa.Array) -> np.ndarray:
    at = pc.index_in(words, value_set=frequent).to_numpy(zero_copy_only=False)
    at = np.where(np.isnan(at), -1, at).astype(np.int64) if at.dtype.kind == "f" else at.astype(np.int64)
    return np.where(at >= 0, at, len(frequent) + spelling(words))


def sequence(index: np.ndarray, lengths: np.ndarray, words: pa.Array, frequent: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Units of the texts one after another, an end after each, and the places of the ends."""
    ends = np.cumsum(lengths + 1) - 1
    seq = np.full(int(ends[-1]) + 1 if len(ends) else 0, len(frequent) + SPELLINGS, np.int64)
    inner = np.ones(len(seq), bool)
    inner[ends] = False
    seq[inner] = units(words, frequent)[index]
    return seq, ends


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def best_classes(old: np.ndarray, right: np.ndarray, left: np.ndarray, itself: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """For each word the class that gives the classes the most mutual information, all other words as they are.

    right, left: how often each class follows and precedes the word; itself: how often the word follows itself.
    """
    out = old.copy()
    for k, a in enumerate(old):
        r, l, s = right[k].astype(float), left[k].astype(float), float(itself[k])
        n = table.astype(float)
        n[a] -= r
        n[:, a] -= l
        n[a, a] += s
        r[a] -= s
        l[a] -= s
        rows, cols = n.sum(1), n.sum(0)
        # What joining class b adds: its row and its column grow, their crossing by both and by the word's own pairs.
        head = n[:classes]
        gain = (xlogx(head + r) - xlogx(head)).sum(1) + (xlogx(n[:, :classes] + l[:, None]) - xlogx(n[:, :classes])).sum(0)
        b = np.arange(classes)
        own = n[b, b]
        gain += xlogx(own + r[b] + l[b] + s) - xlogx(own + r[b]) - xlogx(own + l[b]) + xlogx(own)
        tr, tl = r.sum() + s, l.sum() + s
        gain -= xlogx(rows[b] + tr) - xlogx(rows[b]) + xlogx(cols[b] + tl) - xlogx(cols[b])
        best = int(gain.argmax())
        out[k] = best if gain[best] > gain[a] + 1e-9 else a
    return out


def class_table(pairs: DataFrame, of: np.ndarray, total: int) -> np.ndarray:
    """How often each class follows each."""

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(total * total, np.int64)
        for b in it:
            u, v, n = (c.to_numpy() for c in b.columns)
            table += np.bincount(of[u] * total + of[v], n, minlength=total * total).astype(np.int64)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["at", "n"])

    out = np.zeros(total * total, np.int64)
    for row in pairs.mapInArrow(fold, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out.reshape(total, total)


def information(table: np.ndarray) -> float:
    """The mutual information of row and column, summed over what the table counts."""
    table = table.astype(float)
    return float(xlogx(table).sum() - xlogx(table.sum(0)).sum() - xlogx(table.sum(1)).sum() + xlogx(table.sum()))


def cluster(pairs: DataFrame, n_frequent: int, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class table). Exchange: in turn one half of the frequent words moves, each to its best class."""
    total = classes + SPELLINGS + 1
    of = np.concatenate([np.arange(n_frequent) % classes, classes + np.arange(SPELLINGS + 1)])
    sides = pairs.select(F.col("u").alias("w"), F.lit(0).alias("side"), F.col("v").alias("x"), "n").unionAll(pairs.select(F.col("v").alias("w"), F.lit(1).alias("side"), F.col("u").alias("x"), "n"))
    sides = cut(sides.where(F.col("w") < n_frequent).repartition("w"))
    table = class_table(pairs, of, total)
    turn, failed = 0, 0
    while n_frequent and failed < 2:

        def moves(it: Iterator[pa.RecordBatch], of=of, table=table, turn=turn) -> Iterator[pa.RecordBatch]:
            batches = [pa.Table.from_batches([b]) for b in it]
            if not batches:
                return
            w, side, x, n = (c.to_numpy() for c in pa.concat_tables(batches).columns)
            mine = w % 2 == turn % 2
            w, side, x, n = w[mine], side[mine], x[mine], n[mine]
            words, at = np.unique(w, return_inverse=True)
            both = np.zeros((2, len(words), total))
            np.add.at(both, (side, at, of[x]), n)
            itself = np.zeros(len(words))
            same = (w == x) & (side == 0)
            itself[at[same]] = n[same]
            found = best_classes(of[words], both[0], both[1], itself, table, classes)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(found.astype(np.int64))], names=["w", "class"])

        # At most 1 / share rows come back.
        moved = of.copy()
        for row in sides.mapInArrow(moves, "w long, class long").collect():
            moved[row["w"]] = row["class"]
        counted = class_table(pairs, moved, total)
        turn += 1
        if information(counted) > information(table) * (1 + LEAST_GAIN):
            of, table, failed = moved, counted, 0
        else:
            failed += 1
    return of, table


def rare_neighbours(train: DataFrame, frequent: pa.Array, of: np.ndarray, total: int) -> DataFrame:
    """word, codes, ns of each rarer word: how often each class of unit follows it (code) and precedes it (code less total)."""

    def gathered(words: pa.Array, at: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Of counts that are sorted by the word's place."""
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(first, len(at)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(t))) for x, t in ((code, np.int16), (n, np.int32))]
        return pa.RecordBatch.from_arrays([words.take(pa.array(at[first])), *lists], names=["word", "codes", "ns"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for texts in slices(batch.column(0)):
                index, lengths, words = tokens(texts)
                unit = units(words, frequent)
                ends = np.cumsum(lengths + 1) - 1
                inner = np.ones(int(ends[-1]) + 1, bool)
                inner[ends] = False
                kinds = np.full(len(inner) + 1, total - 1)
                kinds[:-1][inner] = of[unit][index]
                at = np.flatnonzero(inner)
                rare = (unit >= len(frequent))[index]
                at, word = at[rare], index[rare].astype(np.int64)
                key, n = np.unique(np.concatenate([word * 2 * total + kinds[at + 1], word * 2 * total + total + kinds[at - 1]]), return_counts=True)
                if len(key):
                    yield gathered(words, key // (2 * total), key % (2 * total), n)

    def merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one word stand together; the last word of a batch may go on in the next."""
        held = None
        for batch in it:
            table = pa.Table.from_batches([batch] if held is None else [held, batch.cast(held.schema)]).combine_chunks()
            words = table.column(0).combine_chunks() if table.column(0).num_chunks != 1 else table.column(0).chunk(0)
            change = np.concatenate([[True], pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)]) if len(words) else np.zeros(0, bool)
            if not len(words):
                continue
            lists = [table.column(k).chunk(0) if table.column(k).num_chunks == 1 else table.column(k).combine_chunks() for k in (1, 2)]
            owner = np.repeat(np.cumsum(change) - 1, pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))
            key, place = np.unique(owner.astype(np.int64) * 2 * total + lists[0].flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            n = np.bincount(place, lists[1].flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
            out = gathered(words.filter(pa.array(change)), key // (2 * total), key % (2 * total), n)
            if out.num_rows > 1:
                yield out.slice(0, out.num_rows - 1)
            held = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in out.slice(out.num_rows - 1).columns], schema=out.schema)
        if held is not None:
            yield held

    schema = "word string, codes array<short>, ns array<int>"
    return train.select("text").mapInArrow(count, schema).repartition("word").sortWithinPartitions("word").mapInArrow(merged, schema)


class Gains:
    """What words add to and take from what the classes tell of their neighbours, by a table of classes x codes."""

    def __init__(self, table: np.ndarray):
        n = np.arange(1, LOOKED_UP + 1)[:, None, None]
        self.table, self.half = table, table.shape[1] // 2
        self.mass = table[:, : self.half].sum(1)
        self.add = (xlogx(table.T + n) - xlogx(table.T)).astype(np.float32)
        self.joins = 2 * (xlogx(self.mass + n[:, 0]) - xlogx(self.mass)).astype(np.float32)

    def of(self, code: np.ndarray, n: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words x classes: gain of joining a class, tokens of each word) of words whose counts begin at the starts."""
        each, often = self.add[np.minimum(n, LOOKED_UP) - 1, code], np.flatnonzero(n > LOOKED_UP)
        here = self.table[:, code[often]].T
        each[often] = xlogx(here + n[often, None]) - xlogx(here)
        c = np.add.reduceat(np.where(code < self.half, n, 0), starts)
        joins, often = self.joins[np.minimum(c, LOOKED_UP) - 1], np.flatnonzero(c > LOOKED_UP)
        joins[often] = 2 * (xlogx(self.mass + c[often, None]) - xlogx(self.mass))
        return np.add.reduceat(each, starts, axis=0) - joins, c


def best_of_rare(old: np.ndarray, codes: np.ndarray, ns: np.ndarray, sizes: np.ndarray, gains: Gains) -> np.ndarray:
    """For each word the class that adds most to what the classes tell of their neighbours; old -1 is in no class yet.

    codes, ns: the words' counts one after another, sizes how many each has.
    """
    out, table, mass = np.empty_like(old), gains.table, gains.mass
    ends = np.cumsum(sizes)
    at = 0
    while at < len(old):
        begin = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + COUNTS, "right")))
        code, n = codes[begin : ends[to - 1]], ns[begin : ends[to - 1]]
        starts = ends[at:to] - sizes[at:to] - begin
        gain, c = gains.of(code, n, starts)
        # What a word adds to the class it is in is what would go without it.
        mine = np.flatnonzero(old[at:to] >= 0)
        if len(mine):
            here = table[np.maximum(np.repeat(old[at:to], sizes[at:to]), 0), code]
            lost = np.add.reduceat(xlogx(here) - xlogx(np.maximum(here - n, 0)), starts)[mine]
            k = old[at:to][mine]
            gain[mine, k] = lost - 2 * (xlogx(mass[k]) - xlogx(np.maximum(mass[k] - c[mine], 0))) + 1e-5
        out[at:to] = gain.argmax(1)
        at = to
    return out


def counts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def exchanged(it: Iterator[pa.RecordBatch], steps: list[tuple[int, np.ndarray]]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple]]:
    """Each batch of word, codes, ns with the words' classes after some turns, and the counts.

    A word's moves hang on its own counts and the tables of the turns alone, so that they are gone through again in place of
    being kept. In the first turn all words take part, later one half.
    """
    gains = [(turn, Gains(table)) for turn, table in steps]
    for b in it:
        if b.num_rows:
            (code, sizes), (n, _) = counts_of(b.column(1)), counts_of(b.column(2))
            kind, side = np.full(b.num_rows, -1), spelling(b.column(0)) % 2
            for turn, table in gains:
                mine = (side == turn % 2) | (turn == 0)
                if mine.any():
                    here = np.repeat(mine, sizes)
                    kind[mine] = best_of_rare(kind[mine], code[here], n[here], sizes[mine], table)
            yield b, kind, (code, n, sizes)


def summed(tables: DataFrame) -> np.ndarray:
    """The sum of tables of counts, one a row, by way of a few tasks; the driver gets a row of each."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in it:
            for row in b.column(0):
                table = np.frombuffer(row.as_py(), np.int64)
                out = table.copy() if out is None else out + table
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["counts"])

    rows = tables.repartition(8).mapInArrow(add, "counts binary").collect()
    return sum((np.frombuffer(r["counts"], np.int64) for r in rows), np.zeros(1, np.int64))


def cluster_rare(rare: DataFrame, table: np.ndarray, classes: int) -> DataFrame:
    """word, c, class: exchange of the rarer words, the classes of the frequent ones as they are.

    table: the frequent words' class table.
    """
    total = len(table)
    fixed = np.concatenate([table[:classes], table[:, :classes].T], axis=1).astype(float)
    worth = lambda t: information(t[:, :total]) + information(t[:, total:])
    steps, held, best, turn, failed = [], fixed, 0.0, 0, 0

    def counted(tried: list) -> np.ndarray:
        def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(classes * 2 * total, np.int64)
            for _, kind, (code, n, sizes) in exchanged(it, tried):
                out += np.bincount(np.repeat(kind, sizes) * 2 * total + code, n, minlength=len(out)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["counts"])

        return fixed + summed(rare.mapInArrow(fold, "counts binary")).reshape(classes, 2 * total)

    while failed < 2:
        tried = [*steps, (turn, held)]
        now = counted(tried)
        turn += 1
        if turn == 1 or worth(now) > best * (1 + LEAST_GAIN):
            steps, held, best, failed = tried, now, worth(now), 0
        else:
            failed += 1

    def named(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, kind, (code, n, sizes) in exchanged(it, steps):
            c = np.add.reduceat(np.where(code < total, n, 0), np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c), pa.array(kind.astype(np.int32))], names=["word", "c", "class"])

    return rare.mapInArrow(named, "word string, c long, class int")


def vocabulary(train: DataFrame, counts: DataFrame, n_words: int, share: float, classes: int) -> DataFrame:
    """word, c, class of every word of the training texts."""
    # The driver gets at most 1 / share words.
    rows = counts.where(F.col("c") >= max(1.0, share * n_words)).orderBy(F.desc("c"), "word").collect()
    frequent = pa.array([r["word"] for r in rows], pa.string())
    pairs = cut(unit_bigrams(train, frequent))
    of, table = cluster(pairs, len(frequent), classes)
    rare = cluster_rare(cut(rare_neighbours(train, frequent, of, len(table))), table, classes)
    known = counts.sparkSession.createDataFrame([(r["word"], r["c"], int(of[i])) for i, r in enumerate(rows)], "word string, c long, class int")
    return cut(rare.unionByName(known))


def class_sizes(vocab: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words of each class, class of unseen words by spelling)."""

    def kinds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((SPELLINGS + 1, classes), np.int64)
        for b in it:
            kind = b.column(2).to_numpy().astype(np.int64)
            np.add.at(n[SPELLINGS], kind, 1)
            once = b.column(1).to_numpy() == 1
            np.add.at(n, (spelling(b.column(0))[once], kind[once]), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n.size)), pa.array(n.ravel())], names=["at", "n"])

    n = np.zeros((SPELLINGS + 1) * classes, np.int64)
    for row in vocab.mapInArrow(kinds, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        n[row["at"]] = row["n"]
    n = n.reshape(-1, classes)
    like = np.where(n[:SPELLINGS].sum(1) > 0, n[:SPELLINGS].argmax(1), n[SPELLINGS].argmax())
    return n[SPELLINGS], like


CODED = "doc_id {0}, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, classes binary"


def coded(docs: DataFrame, vocab: DataFrame, like: np.ndarray, n_all: int, v_all: int, n_texts: int) -> DataFrame:
    """Each text as the classes of its words, with what does not hang on the classes' counts summed up.

    Texts are dealt to blocks; a block's distinct words meet the vocabulary and come back with counts and classes.
    """
    blocks = max(1, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES + 1)
    blocked = docs.select("doc_id", "held_out", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("_block")).repartition(min(blocks, PARTITIONS), "_block")
    base_end = math.log10((n_texts + 0.5) / (n_all + 0.5 * (v_all + 1))) if n_all else math.log10(0.5 / 0.5)
    names = CODED.format(docs.schema["doc_id"].dataType.simpleString())

    def words_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for block in pc.unique(batch.column(3)).to_pylist():
                held = [tokens(texts)[2] for texts in slices(batch.filter(pc.equal(batch.column(3), block)).column(2))]
                words = pc.unique(pa.concat_arrays(held))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block, np.int32)), words], names=["_block", "word"])

    # All columns of the blocks go in, so that both uses read one shuffle of the texts.
    asked = blocked.mapInArrow(words_of, "_block int, word string").join(vocab, "word")

    def encoded(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("word").combine_chunks()
        known = pa.concat_arrays(known.chunks) if isinstance(known, pa.ChunkedArray) else known
        known_c, known_class = right.column("c").to_numpy(), right.column("class").to_numpy().astype(np.int64)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "emitted", "classes")}
        texts = left.column("text").combine_chunks()
        for part in slices(pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts):
            index, lengths, words = tokens(part)
            at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
            c = np.where(at >= 0, known_c[at], 0) if len(known_c) else np.zeros(len(words), np.int64)
            kind = np.where(at >= 0, known_class[at], like[spelling(words)]) if len(known_c) else like[spelling(words)]
            owner = np.repeat(np.arange(len(lengths)), lengths)
            sums = lambda x, owner=owner, lengths=lengths, index=index: np.bincount(owner, x[index], minlength=len(lengths))
            out["n_tokens"].append(lengths + 1)
            out["n_known"].append(sums((c > 0).astype(float)).astype(np.int64) + (n_texts > 0))
            out["base_score"].append(sums(np.log10((c + 0.5) / (n_all + 0.5 * (v_all + 1)))) + base_end)
            out["emitted"].append(sums(np.log10(c + 0.5)))
            flat, ends = kind[index].astype(np.uint8).tobytes(), np.cumsum(lengths)
            out["classes"] += [flat[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
        whole = lambda k, t: pa.array(np.concatenate(out[k]) if out[k] else np.zeros(0), t)
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": whole("n_tokens", pa.int64()), "n_known": whole("n_known", pa.int64()), "base_score": whole("base_score", pa.float64()), "emitted": whole("emitted", pa.float64()), "classes": pa.array(out["classes"], pa.binary())})

    return blocked.groupBy("_block").cogroup(asked.groupBy("_block")).applyInArrow(lambda key, left, right: encoded(key, left, right), names)


def steps(column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before and class of each token, the end's included, and the place of each text's first token)."""
    parts = column.to_pylist()
    lengths = np.array([len(p) + 1 for p in parts], np.int64)
    now = np.frombuffer(b"".join(p + bytes([end]) for p in parts), np.uint8).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    before = np.append(end, now[:-1])
    return before, now, starts


def transitions(texts: DataFrame, classes: int) -> np.ndarray:
    """How often each class follows each in the coded texts; the end has the last number."""
    total = classes + 1

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(total * total, np.int64)
        for b in it:
            for at in range(0, b.num_rows, TEXTS):
                before, now, _ = steps(b.column(0).slice(at, TEXTS), classes)
                table += np.bincount(before * total + now, minlength=total * total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total * total)), pa.array(table)], names=["at", "n"])

    out = np.zeros(total * total, np.int64)
    for row in texts.select("classes").mapInArrow(fold, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out.reshape(total, total)


def score(docs: DataFrame, train: DataFrame, share: float = SHARE, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of doc_id, text, held_out.

    train: the rows of docs that are not held out, or others to learn from. score is the log10 probability of the text.
    """
    counts = cut(word_counts(train))
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_texts = train.count()
    n_all, v_all = n_words + n_texts, n_distinct + (n_texts > 0)
    vocab = vocabulary(train, counts, n_words, share, classes)
    sizes, like = class_sizes(vocab, classes)
    texts = cut(coded(docs, vocab, like, n_all, v_all, n_texts))
    table = transitions(texts.where("not held_out"), classes)
    mass = table.sum(0).astype(float)  # tokens of each class
    alone = (mass + 0.5) / (mass.sum() + 0.5 * len(mass))
    follow = np.log10((table + PRIOR * alone) / (table.sum(1, keepdims=True) + PRIOR))
    # What the classes take from a word's count: its class's tokens, and half a count for each of its words and one unseen.
    cost = follow - np.append(np.log10(mass[:-1] + 0.5 * (sizes + 1)), 0.0)

    def scores(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                before, now, starts = steps(part.column(6), classes)
                value = np.add.reduceat(cost[before, now], starts) + part.column(5).to_numpy()
                n = part.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(np.full(len(n), n_all, np.int64)), part.column(4), pa.array(value), pa.array(10.0 ** np.minimum(300, -value / n))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(scores, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score_corpus(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """Scores every row of doc_id, text, learning from those outside one fold of the ids."""
    rows = docs.select("doc_id", "text", (remainder(F.col("doc_id"), folds) == fold).alias("held_out"))
    return score(rows, rows.where(~F.col("held_out")))
