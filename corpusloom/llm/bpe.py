"""BPE encoding and decoding with a contiguous rank array per word.

For a word the encoder holds its part boundaries and the rank of each adjacent pair in one array. It looks for the
smallest rank, deletes that boundary and refreshes the two neighbouring ranks until no pair has one. All new words of a
batch go through these steps side by side, as rows of one matrix; long words go one by one with a heap over the same ranks.

Results for odd input: null counts as empty, an empty text has no tokens; equal texts get equal tokens; the strings of
special tokens inside a text become these tokens, as the tokenizers library does by default; repeated rows are encoded each by
itself; a very long text is a list of words and of ids, one long word goes through the heap; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.iinfo(np.int32).max
#: Longest word, in bytes, that the matrix takes; beyond it the heap does.
SHORT = 48
#: Words kept with their tokens by a task; more than these are encoded again when they return.
CACHE = 600_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary as arrays, made from the JSON text of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        ids = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.last = np.array([ids[c + self.suffix] for c in letters], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([(ids[a] << 32) | ids[b] for a, b in merges], np.int64)
        self.order = np.argsort(pairs)
        self.pairs = pairs[self.order]
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where they never merge."""
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == key, self.order[at], NONE).astype(np.int32)

    def encode_same_length(self, words: np.ndarray) -> list[list[int]]:
        """Tokens of words given as rows of bytes, all of one length."""
        n, width = words.shape
        parts = self.inner[words]
        parts[:, -1] = self.last[words[:, -1]]
        done: list[list[int] | None] = [None] * n
        live = np.arange(n)
        rank = self.ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
        size = width
        while len(live):
            # Every live row has the same number of parts: each step deletes one boundary from each.
            if size > 1:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(live)), at]
                ended = best == NONE
            else:
                ended = np.ones(len(live), bool)
            if ended.any():
                for i, row in zip(live[ended].tolist(), parts[ended].tolist()):
                    done[i] = row
                go = ~ended
                live, parts, rank = live[go], parts[go], rank[go]
                if not len(live):
                    break
                at, best = at[go], best[go]
            rows = np.arange(len(live))
            parts[rows, at] = self.made[best]
            keep = np.ones((len(live), size), bool)
            keep[rows, at + 1] = False
            parts = parts[keep].reshape(len(live), size - 1)
            keep[rows, at + 1] = True
            keep = keep[:, 1:]
            keep[rows, at] = False
            rank = rank[keep].reshape(len(live), size - 2)
            size -= 1
            left, right = rows[at > 0], rows[at < size - 1]
            if len(left):
                rank[left, at[left] - 1] = self.ranks(parts[left, at[left] - 1], parts[left, at[left]])
            if len(right):
                rank[right, at[right]] = self.ranks(parts[right, at[right]], parts[right, at[right] + 1])
        return done

    def encode_long(self, word: bytes) -> list[int]:
        """Tokens of a long word: the same choices from a heap of (rank, place)."""
        parts = self.inner[np.frombuffer(word, np.uint8)].tolist()
        parts[-1] = int(self.last[word[-1]])
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        first = self.ranks(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            r = int(self.ranks(np.array([parts[i]]), np.array([parts[j]]))[0])
            if r != NONE:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i] = int(self.made[r])
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word."""
        out: list[list[int]] = [[]] * len(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        by: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            by.setdefault(len(w), []).append(i)
        for width, at in by.items():
            if width > SHORT:
                for i in at:
                    out[i] = self.encode_long(raw[i])
                continue
            for k in range(0, len(at), 1 << 15):
                some = at[k : k + (1 << 15)]
                if width == 1:
                    found = [[int(self.last[raw[i][0]])] for i in some]
                else:
                    found = self.encode_same_length(np.frombuffer(b"".join([raw[i] for i in some]), np.uint8).reshape(-1, width))
                for i, tokens in zip(some, found):
                    out[i] = tokens
        return out


class Encoder:
    """Splits texts into words and joins what the words encode to."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) or r"(?!)")
        self.known: dict[str, list[int]] = {}
        names = {**vocabulary.tokens, **{i: t for t, i in vocabulary.special.items()}}
        self.names = [names.get(i) for i in range(max(names, default=-1) + 1)]
        self.digits = [str(i) for i in range(len(self.names))]

    def pieces(self, text: str | None) -> list[str]:
        """The words of a text; a special token's string stands for itself."""
        if not text:
            return []
        if "<|" not in text:
            return self.find(self.normal(text))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.find(self.normal(text[at : m.start()]))
            out.append((m[0],))
            at = m.end()
        return out + self.find(self.normal(text[at:]))

    @staticmethod
    def normal(text: str) -> str:
        """Composed, each character lower-cased by itself."""
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def learn(self, words: set) -> None:
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        new = [w for w in words if w not in self.known and not isinstance(w, tuple)]
        for w, ids in zip(new, self.v.encode_words(new)):
            self.known[w] = ids
        for w in words:
            if isinstance(w, tuple):
                self.known[w] = [self.v.special[w[0]]]

    def decode(self, ids: list[int]) -> str:
        """The strings of the ids joined by blanks; an id outside the vocabulary has none and is passed over."""
        names, n = self.names, len(self.names)
        return " ".join([names[i] for i in ids if 0 <= i < n and names[i] is not None])

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        pieces = [self.pieces(t) for t in texts]
        new: set = set()
        for p in pieces:
            new.update(p)
        self.learn(new)
        known = self.known
        return [[i for w in p for i in known[w]] for p in pieces]


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns and the outputs asked for: n_tokens, ids (array), decoded, ids_sha256, decoded_sha256.

    What is decoded is the ids. `tokenizer` is the path of a tokenizer file; the driver reads it once and its text goes to the tasks.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    make = {
        "n_tokens": ("long", pa.int64(), lambda e, ids: len(ids)),
        "ids": ("array<int>", pa.list_(pa.int32()), lambda e, ids: ids),
        "decoded": ("string", pa.string(), lambda e, ids: e.decode(ids)),
        "ids_sha256": ("string", pa.string(), lambda e, ids: sha(" ".join([e.digits[i] for i in ids]))),
        "decoded_sha256": ("string", pa.string(), lambda e, ids: sha(e.decode(ids))),
    }

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(shared.value))
        for whole in it:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = encoder.encode(batch.column(batch.num_columns - 1).to_pylist())
                columns = [pa.array([make[o][2](encoder, ids) for ids in found], make[o][1]) for o in outputs]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *outputs])

    rows = docs.select(F.col(doc_id).alias("doc_id"), *[c for c in keep if c not in ("doc_id", *outputs)], F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(batches, f"{fields}, " + ", ".join(f"{o} {make[o][0]}" for o in outputs))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded`: the strings of the ids joined by blanks; an id outside the vocabulary has none and is passed over."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def batches(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary(shared.value))
        for column in it:
            yield pa.array([None if x is None else encoder.decode(x) for x in column.to_pylist()], pa.string())

    return encoded.withColumn("decoded", F.arrow_udf("string")(_typed(batches))(F.col(ids)))


def _typed(f):
    f.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return f
