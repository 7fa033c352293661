"""License scans: an Aho-Corasick automaton over words finds notices and tags; a shunting-yard parser evaluates expressions.

Results for odd input: null and empty texts have no words, no labels and score 0, the score of no licence; a long text is
scanned word by word in one pass;
a malformed expression after a tag still yields the identifiers in it, valued by their minimum;
repeated rows are scanned each by itself; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Notice phrases and their labels. The first three are the contract's.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license v 2": "mpl-2",
    "eclipse public license": "epl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by 4": "cc-by",
    "cc0 1": "cc0",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"

# Labels of identifiers, by their name before version words, and how free a label is (1: no conditions on use).
IDENTIFIERS = {
    "mit": "mit", "apache-2": "apache-2", "bsd": "bsd", "isc": "isc", "cc0": "cc0", "unlicense": "unlicense",
    "agpl-3": "agpl-3", "lgpl": "lgpl", "gpl-3": "gpl-3", "gpl-2": "gpl-2", "mpl-2": "mpl-2", "epl": "epl",
    "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by",
}
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "cc-by": 0.9,
    "mpl-2": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl-2": 0.4, "gpl-3": 0.4, "agpl-3": 0.3,
    "cc-by-nc": 0.1, "all-rights-reserved": 0.05,
}
UNKNOWN_FREEDOM = 0.2
EXCEPTION_GAIN = 0.2

#: Word characters stay, A-Z become lower-case, all else becomes a space; bytes above 127 stay as they are.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
#: What may stand behind the name of a licence: versions and their words.
VERSION = re.compile(r"(?:[.-](?:v?[0-9]+|clause|only|or|later|universal|international))*")
EXPRESSION_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def automaton(phrases: dict[str, object]) -> tuple[list[dict[bytes, int]], list[tuple[tuple[int, object], ...]]]:
    """The complete transitions of each state (a missing word leads to state 0) and the (length, label) pairs that end there."""
    goto: list[dict[bytes, int]] = [{}]
    out: list[list[tuple[int, object]]] = [[]]
    for phrase, label in phrases.items():
        state = 0
        parts = phrase.encode().split()
        for part in parts:
            if part not in goto[state]:
                goto[state][part] = len(goto)
                goto.append({})
                out.append([])
            state = goto[state][part]
        out[state].append((len(parts), label))
    delta: list[dict[bytes, int]] = [dict(goto[0])] + [{} for _ in goto[1:]]
    queue = deque((child, 0) for child in goto[0].values())
    while queue:
        state, fail = queue.popleft()
        out[state] += out[fail]
        delta[state] = delta[fail] | goto[state]
        queue.extend((child, delta[fail].get(word, 0)) for word, child in goto[state].items())
    return delta, [tuple(x) for x in out]


def label_of(identifier: str) -> str:
    name = identifier.lower().rstrip("+")
    known = (label for start, label in sorted(IDENTIFIERS.items(), key=lambda x: -len(x[0])) if name.startswith(start) and VERSION.fullmatch(name, len(start)))
    return next(known, name)


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels in a licence expression and its freedom: and takes the least, or the greatest, with adds what an exception gives.

    Shunting yard with two stacks. A malformed expression is worth the least of its identifiers.
    """
    values: list[float] = []
    operators: list[str] = []
    labels: set[str] = set()

    def reduce() -> None:
        op, right, left = operators.pop(), values.pop(), values.pop()
        values.append({"or": max(left, right), "and": min(left, right), "with": min(1.0, left + EXCEPTION_GAIN)}[op])

    tokens = EXPRESSION_TOKEN.findall(expression)
    seen: list[float] = []
    try:
        expect_value = True
        for token in tokens:
            low = token.lower()
            if low in PRECEDENCE:
                if expect_value:
                    raise IndexError
                while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] >= PRECEDENCE[low]:
                    reduce()
                operators.append(low)
                expect_value = True
            elif token == "(":
                if not expect_value:
                    raise IndexError
                operators.append(token)
            elif token == ")":
                while operators[-1] != "(":
                    reduce()
                operators.pop()
            else:
                if not expect_value:
                    break  # prose after the expression
                expect_value = False
                if operators and operators[-1] == "with":
                    values.append(0.0)
                    continue
                label = label_of(token)
                labels.add(label)
                seen.append(FREEDOM.get(label, UNKNOWN_FREEDOM))
                values.append(seen[-1])
        while operators:
            reduce()
        return labels, values[-1]
    except IndexError:
        return labels, min(seen, default=0.0)


def _machine() -> tuple:
    phrases: dict[str, object] = {p: (label, True) for p, label in BASE_PHRASES.items()}
    phrases |= {p: (label, False) for p, label in NOTICES.items()}
    return automaton(phrases | {TAG: (None, False)})


def scan_text(text: str | None, machine: tuple) -> tuple:
    """(words, base places, first and last start of them, base labels, all labels, score) of one text."""
    delta, out = machine
    tokens = words(text)
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    tagged = False
    state = 0
    for i, word in enumerate(tokens):
        state = delta[state].get(word, 0)
        if state and out[state]:
            for length, (label, is_base) in out[state]:
                if label is None:
                    tagged = True
                    continue
                labels.add(label)
                if is_base:
                    base.add(label)
                    starts.append(i - length + 1)
    worth = [FREEDOM.get(x, UNKNOWN_FREEDOM) for x in labels]
    if tagged:
        for m in TAG_LINE.finditer(text):
            found, value = evaluate(m[1])
            if found:
                labels |= found
                worth.append(value)
    return len(tokens), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(worth, default=0.0)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases, labels and how free the document's licences leave it."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine()
        for batch in it:
            rows = [scan_text(t.as_py(), machine) for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *names])

    schema = f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(batches, schema)
