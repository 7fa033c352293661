"""Source divergence audit: how far the word use of each source of a language is from every other's, in exact arithmetic.

Tasks count the terms of whole texts; counts merge by language, source and term. The terms in enough documents of their
language are numbered and cut into chunks; a group (language and source) packs the counts of a chunk into one vector.
Groups stand in blocks. A vector goes to each tile, a pair of group blocks, that its group is in; a task works out its tile's
submatrix of differences chunk after chunk. Vocabularies of many chunks are cut into slices, whose submatrices are summed.

Results for odd input: null texts, languages and sources are empty ones; an empty text gives its group no terms, but the
group is reported; a language without kept terms has differences of 0; equal values are ranked by item; repeated rows are
documents of their own; very long texts are read in pieces cut between terms; an empty table gives an empty table; other
columns are ignored. A group of 9e15 terms or more is an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered

#: Documents of its language that a term is in at least, the count that smooths, and places after the point.
LEAST_DOCS = 30
SMOOTH = 5
DIGITS = 9
TOP_TERMS = 50
#: Terms in a chunk, chunks in a slice, groups in a block: a task holds two blocks of one chunk.
CHUNK = 2048
SLICE = 64
BLOCK = 64
#: Counts that a task holds before it hands them on, and bytes of a text that it splits at a time.
HELD = 200_000
PIECE = 1 << 20
#: Bytes to the terms' own: letters in lower case, all beyond ASCII as they are, and blanks.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it); each group has a row with a null term too."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (of, by), (times, docs) in held.items():
                words = list(times)
                for at in range(0, max(1, len(words)), 1 << 14):
                    some = words[at : at + (1 << 14)]
                    first = [None] if at == 0 else []
                    columns = [[of] * (len(some) + len(first)), [by] * (len(some) + len(first))]
                    terms = pa.array(first + some, pa.binary()).cast(pa.string())
                    numbers = [pa.array([0] * len(first) + [c[w] for w in some], pa.int64()) for c in (times, docs)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), terms, *numbers], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in it:
            for of, by, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (of, by) not in held:
                    held[of, by] = (Counter(), Counter())
                times, docs = held[of, by]
                size -= len(times)
                low, at, seen = raw.as_py().translate(LETTERS), 0, set()
                while at < len(low):
                    end = low.find(b" ", at + PIECE)
                    end = len(low) if end < 0 else end
                    words = low[at:end].split()
                    times.update(words)
                    seen.update(words)
                    at = end
                docs.update(seen)
                size += len(times)
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    plain = lambda c: F.coalesce(docs[c], F.lit(""))
    return docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).cast("binary").alias("raw")).mapInArrow(count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 (n + 5) / total), three digits at a time, so that no product leaves a long."""
    out, rest = F.lit(0).cast("long"), n + SMOOTH
    for _ in range(DIGITS // 3):
        rest = rest * 1000
        out = out * 1000 + F.call_function("div", rest, total)
        rest = rest % total
    return out + 1


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    out, rest = np.zeros(np.broadcast_shapes(n.shape, total.shape), np.int64), n + SMOOTH
    for _ in range(DIGITS // 3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


class Tile:
    """The submatrix of one tile over one slice of the vocabulary, fed with its groups and then with chunk after chunk."""

    def __init__(self, lang: str, same: bool):
        self.lang, self.same = lang, same
        self.sides: tuple[list, list] = ([], [])  # (source, total) of the groups of either block
        self.place: dict[int, tuple[int, int]] = {}
        self.matrix = self.chunk = None
        self.left = 0  # terms of the slice in no chunk seen yet
        self.rows: list = []

    def add_group(self, side: int, number: int, source: str, total: int, terms: int) -> None:
        if total >= 9 * 10**15:
            raise ValueError("a group of 9e15 terms or more")
        self.place[number] = (side, len(self.sides[side]))
        self.sides[side].append((source, max(total, 1)))
        self.left = terms

    def add_vector(self, chunk: int, size: int, number: int, at: np.ndarray, n: np.ndarray) -> None:
        if chunk != self.chunk:
            self.fold()
            self.chunk, self.size = chunk, size
        self.rows.append((number, at, n))

    def differences(self, size: int) -> np.ndarray:
        """Sums of the differences of all pairs over a chunk with the rows that came."""
        both = []
        for side in (0,) if self.same else (0, 1):
            both.append(np.zeros((len(self.sides[side]), size), np.int64))
        for number, at, n in self.rows:
            side, i = self.place[number]
            both[side][i, at] = n
        both = [shares(x, np.array([t for _, t in self.sides[side]], np.int64)[:, None]) for side, x in enumerate(both)]
        return np.array([np.abs(p - both[-1]).sum(axis=1) for p in both[0]], np.int64).reshape(len(both[0]), len(both[-1]))

    def fold(self) -> None:
        if self.rows:
            part = self.differences(self.size)
            self.matrix = part if self.matrix is None else self.matrix + part
            self.left -= self.size
        self.rows = []

    def pairs(self) -> pd.DataFrame:
        self.fold()
        out = self.left * self.differences(1)  # terms that no group of the tile has
        out = out if self.matrix is None else out + self.matrix
        first, second = self.sides[0], self.sides[0 if self.same else 1]
        i, j = np.triu_indices(len(first), 1) if self.same else (x.ravel() for x in np.indices(out.shape))
        a, b = np.array([s for s, _ in first], object)[i], np.array([s for s, _ in second], object)[j]
        value = out[i, j]
        return pd.DataFrame({"lang": self.lang, "source": np.concatenate([a, b]), "item": np.concatenate([b, a]), "value": np.concatenate([value, value])})


def submatrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of each tile and slice from rows sorted by tile, slice and chunk, the groups themselves first."""
    key, tile = None, None
    for frame in frames:
        for r in frame.itertuples(index=False):
            if key != (r.lang, r.one, r.two, r.slice):
                if tile:
                    yield tile.pairs()
                key, tile = (r.lang, r.one, r.two, r.slice), Tile(r.lang, r.one == r.two)
            if r.chunk < 0:
                tile.add_group(int(r.block != r.one), r.number, r.source, r.total, r.size)
            else:
                tile.add_vector(r.chunk, r.size, r.number, np.asarray(r.at, np.int64), np.asarray(r.n, np.int64))
    if tile:
        yield tile.pairs()


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, chunk: int = CHUNK, slices: int = SLICE, block: int = BLOCK, top: int = TOP_TERMS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value and rank: of each group all other groups of its language, and its own terms."""
    counts = cut(term_counts(docs, lang, source, text))
    terms = counts.where("term is not null")
    kept = numbered(terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs), "lang", "term")
    kept = cut(kept)
    langs = cut(kept.groupBy("lang").agg(F.min("number").alias("first"), F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")))
    place = F.col("number") - F.col("first")
    kept = kept.join(langs, "lang").select("lang", "term", "lang_n", F.call_function("div", place, F.lit(chunk)).alias("chunk"), (place % chunk).cast("int").alias("at"))
    known = cut(terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    groups = numbered(counts.select("lang", "source").distinct(), "lang", "source")
    groups = cut(groups.join(known.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left"))
    sizes = groups.groupBy("lang").agg(F.min("number").alias("begin"), F.count("*").alias("groups"))
    sizes = cut(sizes.join(langs.select("lang", "v", "lang_total"), "lang", "left").fillna(0, ["v", "lang_total"]))
    whole = lambda x, n: F.call_function("div", x + (n - 1), F.lit(n))
    groups = cut(
        groups.join(sizes, "lang").select(
            "lang", "source", "number", (F.coalesce("n", F.lit(0)) + SMOOTH * F.col("v")).alias("total"), "v", (F.col("lang_total") + SMOOTH * F.col("v")).alias("lang_total"),
            F.call_function("div", F.col("number") - F.col("begin"), F.lit(block)).alias("block"), whole(F.col("groups"), block).alias("blocks"),
        )
    )

    def tiles(rows: DataFrame) -> DataFrame:
        """Each row once for every tile that its group is in."""
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return rows.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).select("lang", "one", "two", "slice", "chunk", "number", "block", "source", "total", "size", "at", "n")

    span = chunk * slices
    heads = groups.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), whole(F.col("v"), span)) - 1)))
    heads = heads.withColumns({"chunk": F.lit(-1).cast("long"), "size": F.least(F.lit(span), F.col("v") - F.col("slice") * span), "at": F.array().cast("array<int>"), "n": F.array().cast("array<long>")})
    packed = known.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("counts"))
    vectors = packed.join(groups, ["lang", "source"]).withColumns({
        "slice": F.call_function("div", F.col("chunk"), F.lit(slices)), "size": F.least(F.lit(chunk), F.col("v") - F.col("chunk") * chunk),
        "at": F.col("counts.at"), "n": F.col("counts.n"),
    })
    order = ["lang", "one", "two", "slice"]
    rows = tiles(heads).unionByName(tiles(vectors)).repartition(*order).sortWithinPartitions(*order, "chunk", "number")
    pairs = rows.mapInPandas(submatrices, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    own = known.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    own = own.select("lang", "source", F.col("term").alias("item"), (share(F.col("n"), F.col("total")) - share(F.col("lang_n"), F.col("lang_total"))).alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(own.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")


SQL = r"""with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents
), t as (select id, lang, source, unnest(words) as term from d),
k as (select lang, term, count(*) as c from t group by 1, 2 having count(distinct id) >= 30),
v as (select lang, count(*) as v, sum(c) as total from k group by 1),
g as (select distinct lang, source from d),
n as (select lang, source, term, count(*) as n from t group by 1, 2, 3),
c as (select g.lang, g.source, k.term, coalesce(n.n, 0) as n, k.c from g join k on k.lang = g.lang left join n on n.lang = g.lang and n.source = g.source and n.term = k.term),
p as (
  select c.lang, c.source, c.term, c.n, 1 + (1000000000::hugeint * (c.n + 5)) // (sum(c.n) over (partition by c.lang, c.source) + 5 * v.v) as p,
    1 + (1000000000::hugeint * (c.c + 5)) // (v.total + 5 * v.v) as q
  from c join v on v.lang = c.lang
), f as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(x.p - y.p)), 0) as value
  from g a join g b on b.lang = a.lang and b.source <> a.source left join p x on x.lang = a.lang and x.source = a.source
    left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by 1, 2, 4
  union all select lang, source, 'term', term, p - q from p where n > 0 and p > q
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from f) where part = 'pair' or rank <= 50"""
