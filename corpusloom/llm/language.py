"""Language ID by rank-order profiles: the out-of-place distance between a document's most frequent n-grams and each language's.

Grams are the 1 to 3 letter pieces of words with one blank on either side. Results for odd input: a text that is null
or has no letter gets `und` and score 0; with nothing to learn from every text does; equal distances go to the first
language by code point, equal counts to the first gram; a very long text is one array of grams, some dozens of bytes a
character; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, remainder, renamed

#: Grams in a profile, of a language or a document.
PROFILE = 300
UNKNOWN = "und"
#: No letter is assigned beyond the third plane, so that 20 bits hold any.
LETTERS_END = 1 << 18
#: Characters that training counts at a time; bounds memory only.
CHUNK = 1 << 20


def letter_codes() -> np.ndarray:
    """For each code point the code point of its lower-case letter, or 0 if it is no letter."""
    codes = np.zeros(sys.maxunicode + 1, np.int32)
    for c in range(LETTERS_END):
        if unicodedata.category(x := chr(c))[0] == "L":
            low = x.lower()
            codes[c] = ord(low) if len(low) == 1 else c
    return codes


def grams(text: str, codes: np.ndarray) -> np.ndarray:
    """The n-grams of a text, each packed into a 64-bit number."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = codes[points].astype(np.int64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)  # one blank between words
    c = c[keep]
    if len(c) < 3:
        return np.empty(0, np.int64)
    one = c[c != 0]
    two = (c[:-1] << 20) | c[1:]
    a, b, d = c[:-2], c[1:-1], c[2:]
    three = ((a << 40) | (b << 20) | d)[b != 0]
    # 20 bits a letter and 2 for the length: a blank is 0, so a gram that begins with one would look like a shorter one.
    return np.concatenate([one << 2, (two << 2) | 1, (three << 2) | 2])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, np.empty(0, np.int64)
    keys = np.sort(keys)
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[edges], np.diff(np.append(edges, len(keys)))


def top(keys: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent keys, most frequent first; equal counts by key."""
    if len(counts) > k:
        floor = np.partition(counts, len(counts) - k)[len(counts) - k]
        some = counts >= floor
        keys, counts = keys[some], counts[some]
    return keys[np.argsort(-counts, kind="stable")[:k]]


def profiles(labelled: DataFrame, size: int = PROFILE, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, gram and rank from 0 of each language's most frequent grams, counted over all labelled rows."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = letter_codes()
        held: dict[str, dict[str, list]] = {}

        def fold(name: str) -> None:
            h = held[name]
            keys, counts = counted(grams(" ".join(h["texts"]), codes))
            if h["keys"] is not None:
                keys, at = np.unique(np.concatenate([h["keys"], keys]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([h["counts"], counts])).astype(np.int64)
            held[name] = {"texts": [], "chars": 0, "keys": keys, "counts": counts}

        for batch in it:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                h = held.setdefault(name, {"texts": [], "chars": 0, "keys": None, "counts": None})
                h["texts"].append(t)
                h["chars"] += len(t)
                if h["chars"] >= CHUNK:
                    fold(name)
        for name in held:
            fold(name)
            keys, counts = held[name]["keys"], held[name]["counts"]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    total = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return total.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


def predict(docs: DataFrame, learned: DataFrame, size: int = PROFILE, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, lang_pred and score of every row.

    The profiles hold at most `size` rows a language and go to the tasks as a whole.
    """
    ranks: dict[str, list] = {}
    for row in learned.orderBy("lang", "rank").collect():
        ranks.setdefault(row["lang"], []).append(row["gram"])
    names = sorted(ranks)
    vocabulary = np.array(sorted({g for x in ranks.values() for g in x}), np.int64)
    places = np.full((len(names), len(vocabulary) + 1), size, np.int64)  # the last column is for grams in no profile
    for i, name in enumerate(names):
        places[i, np.searchsorted(vocabulary, np.array(ranks[name], np.int64))] = np.arange(len(ranks[name]))

    def score(t: str | None, codes: np.ndarray) -> tuple[str, float]:
        keys = grams(t, codes) if t else ()
        if not len(keys) or not names:
            return UNKNOWN, 0.0
        best = top(*counted(keys), size)
        at = np.searchsorted(vocabulary, best)
        at[at == len(vocabulary)] = 0
        at = np.where(vocabulary[at] == best, at, len(vocabulary))
        rank = np.arange(len(best))
        far = np.where(places[:, at] == size, size, np.abs(places[:, at] - rank)).sum(axis=1)
        i = int(far.argmin())
        return names[i], float(1 - far[i] / (size * len(best)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = letter_codes()
        for batch in it:
            found = [score(t.as_py(), codes) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(batches, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Learns from labelled rows outside one fold of the ids and predicts every row: doc_id, held_out, lang_pred, score."""
    held = remainder(F.col("doc_id"), folds) == fold
    learned = profiles(docs.where(~held))
    return predict(docs, learned).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, folds: int = 4, fold: int = 2, lang: str = "lang") -> DataFrame:
    """The documents, whole, whose language the profiles tell; a null language becomes the one told.

    Rejected are texts without a letter, and those none of whose grams is in any profile, so that they are as far from every
    language as can be. With nothing to learn from no document is rejected and none is told.
    """
    inner, names = renamed(docs)
    learned = cut(profiles(inner.where(remainder(F.col("doc_id"), folds) != fold)))
    if learned.isEmpty():
        return docs
    kept = predict(inner, learned, keep=tuple(names)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0))
    return kept.select(*[(F.coalesce(F.col(n), F.col("lang_pred")) if c == lang else F.col(n)).alias(c) for n, c in zip(names, docs.columns)])
