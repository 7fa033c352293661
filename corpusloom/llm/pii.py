"""PII by bootstrapped contextual extraction, in DataFrame functions only.

Entities found by their form (email, ip, card, phone) are the seeds. The words around an occurrence are its lexical patterns.
Pattern and instance form a graph that is scored in turn: a pattern's confidence in a kind is the share of its distinct
instances that are known to be of that kind, given enough of them; an unknown instance's score is the noisy-or of the
confidences of its patterns. Instances that score high join the known ones, and the next turn starts, until a turn adds
none. What is found in this way adds spans; the seeds' spans stay.

Results for odd input: null counts as empty; a text without digits and @ has no spans; spans of one kind never overlap;
repeated rows each get the same spans; spans sort by start, then by kind; an empty table gives an empty table; other
columns are ignored, and kept by redact(). The work on a text grows with its length, however many spans are in it.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: In the order that breaks ties of start.
KINDS = ("email", "ip", "card", "phone")
#: A pattern needs this many known instances and this share of them among all its instances.
LEAST_KNOWN = 3
LEAST_CONFIDENCE = 0.6
#: Score from which an unknown instance is taken for known.
LEAST_SCORE = 0.6
#: Turns at most; None: until no instance is added, which ends as each turn adds some of the finitely many.
TURNS = None
#: Tasks that the instances of one pattern are dealt to.
SALTS = 16
#: Code points before and after an occurrence in which its context words are looked for.
REACH = 64

# Each pattern begins only where a leftmost match can, so that long runs are read once; the results are those of the
# plain pattern in the comment.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+ with 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: Words with a digit or @: what may turn out to be an identifier.
CANDIDATE = r"(?<!\S)(?=\S*?[0-9@])\S++"
#: Numbers written with single blanks or brackets between their digits. A run begins only where no other goes on, and is read once.
JOINED = r"(?<!\S)(?<![0-9)] )[+(]?[0-9][0-9().-]*+(?: \(?[0-9][0-9().-]*+)++(?![^\s,;:!?])"
#: What an instance must look like, once trimmed, to be taken for a kind.
LOOKS = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9A-Fa-f]*([.:][0-9A-Fa-f]*){3,7}$",
    "card": r"^(?:[^0-9]*[0-9]){12,19}[^0-9]*$",
    "phone": r"^\+?[0-9(](?:[^0-9A-Za-z]*[0-9]){6,14}$",
}

#: Code points of the pieces that a text is read in around places, and elements that are folded at a time.
PIECE = 256
STRETCH = 64

SPAN = "struct<s:int,e:int,m:string>"


def quoted(pattern: str) -> str:
    """A SQL string literal of a pattern."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """SQL: the body, with the value under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(array: str, fold: str) -> str:
    """SQL: for each of an array's whole numbers, 0 or more, the sum (fold +) or the greatest (fold max) of it and all before.

    Folded in stretches, as an array that grows by one at a time is copied each time.
    """
    op = (lambda x, y: f"{x} + {y}") if fold == "+" else (lambda x, y: f"greatest({x}, {y})")
    none = "struct(0 as at, cast(array() as array<int>) as out)"
    value = f"get(a, b * {STRETCH} + i)"
    part = f"aggregate(sequence(0, {STRETCH - 1}), {none}, (acc, i) -> if({value} is null, acc, struct({op('acc.at', value)} as at, concat(acc.out, array({op('acc.at', value)})) as out)))"
    before = f"aggregate(parts, {none}, (acc, x) -> struct({op('acc.at', 'x.at')} as at, concat(acc.out, array(acc.at)) as out)).out"
    whole = let(before, "z", f"flatten(zip_with(parts, z, (x, y) -> transform(x.out, v -> {op('y', 'v')})))")
    return let(array, "a", let(f"transform(sequence(0, (size(a) - 1) div {STRETCH}), b -> {part})", "parts", whole))


def first_of(array: str, holds: str) -> str:
    """SQL: how many of an array's first elements a condition on them, `at` standing for the place, holds for; a binary search."""
    top = f"cast(floor(log2(greatest(1, size({array})))) as int)"
    look = holds.replace("at", f"get({array}, n + shiftleft(1, {top} - i) - 1)")
    return f"aggregate(sequence(0, {top}), 0, (n, i) -> if({look}, n + shiftleft(1, {top} - i), n))"


def found(pattern: str, needs: str) -> str:
    """SQL: start, end (code points, exclusive) and text of the matches. What lies between them gives their places."""
    p = quoted(pattern)
    pieces = f"zip_with(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), (g, m) -> struct(char_length(g) as g, m as m))"
    ends = running("transform(r, x -> x.g + coalesce(char_length(x.m), 0))", "+")
    spans = "filter(transform(r, (x, i) -> struct(get(ends, i) - char_length(x.m) as s, get(ends, i) as e, x.m as m)), x -> x.m is not null)"
    return f"if(text rlike {quoted(needs)}, {let(pieces, 'r', let(ends, 'ends', spans))}, cast(array() as array<{SPAN}>))"


#: SQL tests of a match x.m.
VALID = {
    "email": "true",
    "ip": r"x.m rlike '^(0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(\\.|$)){4}$'",
    "card": """aggregate(
        transform(split(reverse(regexp_replace(x.m, '[^0-9]', '')), ''), (d, i) -> cast(nullif(d, '') as int) * (1 + i % 2)),
        0, (a, d) -> a + if(d > 9, d - 9, coalesce(d, 0))) % 10 = 0""",
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) between 10 and 15",
}


def pieces(text: str) -> str:
    """SQL: the text in pieces of PIECE code points."""
    return f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"


def context(side: str) -> str:
    """SQL: the two words before, or the word after, a span x, lower-cased; what a line begins or ends with has none."""
    near = lambda at, n: f"substring(concat(coalesce(get(_pieces, {at} div {PIECE}), ''), coalesce(get(_pieces, {at} div {PIECE} + 1), '')), {at} % {PIECE} + 1, {n})"
    if side == "left":
        return f"lower(trim(regexp_extract({near(f'greatest(0, x.s - {REACH})', f'least(x.s, {REACH})')}, {quoted(r'(\S+[ \t]+)?\S+[ \t]*\z')}, 0)))"
    return f"lower(regexp_extract({near('x.e', REACH)}, {quoted(r'^[ \t]*(\S+)')}, 1))"


def apart(*others: str) -> str:
    """SQL: whether x overlaps none of the spans of each array, which are in order and apart from each other."""
    return " and ".join(f"(size({o}) = 0 or not coalesce(get({o}, {first_of(o, 'at.s < x.e')} - 1).e > x.s, false))" for o in others)


def occurrences(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, _h, the kept columns, base (array of start, end, kind) and seen (base and candidates with their contexts)."""
    rows = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    for kind in KINDS:
        rows = rows.withColumn(f"_{kind}", F.expr(f"filter({found(PATTERNS[kind], NEEDS[kind])}, x -> {VALID[kind]})"))
    tagged = [f"transform(_{k}, x -> struct(x.s as s, {i} as k, x.e as e, x.m as m))" for i, k in enumerate(KINDS)]
    rows = rows.withColumn("base", F.expr(f"array_sort(concat({', '.join(tagged)}))"))
    # Outer punctuation is no part of an instance.
    trimmed = lambda column: rf"""transform({column}, x -> struct(
        x.s + length(regexp_extract(x.m, '^[^0-9A-Za-z@+(]*', 0)) as s, cast(null as int) as k,
        x.e - length(regexp_extract(x.m, '[^0-9A-Za-z)]*$', 0)) as e,
        regexp_replace(x.m, '^[^0-9A-Za-z@+(]+|[^0-9A-Za-z)]+$', '') as m))"""  # noqa: E731
    bases = [f"_{kind}" for kind in KINDS]
    rows = rows.withColumn("_joined", F.expr(found(JOINED, "[0-9)] [0-9(]"))).withColumn("_loose", F.expr(found(CANDIDATE, "[0-9@]")))
    # A joined run that looks like a number stands for its pieces; all others are left in pieces.
    number = f"(x.m rlike {quoted(LOOKS['phone'])} or x.m rlike {quoted(LOOKS['card'])})"
    rows = rows.withColumn("_joined", F.expr(f"filter({trimmed('_joined')}, x -> x.s < x.e and {number} and {apart(*bases)})"))
    rows = rows.withColumn("_loose", F.expr(f"concat(_joined, filter({trimmed('_loose')}, x -> x.s < x.e and {apart('_joined', *bases)}))"))
    rows = rows.withColumn("_pieces", F.expr(f"if(size(base) + size(_loose) > 0, {pieces('text')}, cast(array() as array<string>))"))
    seen = f"transform(concat(base, _loose), x -> struct(x.s as s, x.k as k, x.e as e, x.m as m, {context('left')} as l, {context('right')} as r))"
    return rows.select("doc_id", "_h", *keep, "text", F.expr("transform(base, x -> struct(x.s as s, x.k as k, x.e as e))").alias("base"), F.expr(seen).alias("seen"))


def discovered(occurred: DataFrame, turns: int | None = TURNS) -> DataFrame:
    """doc_id, _h, more: the spans that patterns add, for the documents that get any."""
    edges = occurred.select("doc_id", "_h", F.explode("seen").alias("o")).select("doc_id", "_h", "o.*")
    patterns = F.array(F.concat(F.lit("2 "), "l"), F.concat(F.lit("1 "), F.element_at(F.split("l", "[ \t]+"), -1), F.lit(" | "), "r"))
    # What begins a line is known by that and the word after it.
    patterns = F.when(F.col("l") != "", patterns).otherwise(F.array(F.concat(F.lit("0 ^ | "), "r")))
    pairs = edges.where("l <> '' or r <> ''").select("m", "k", F.explode(patterns).alias("p")).groupBy("m", "p").agg(F.max("k").alias("seed"))
    # Patterns without enough seeds in the end may get some from what is found, but never without any second instance.
    pairs = cut(pairs)
    known = cut(pairs.where("seed is not null").groupBy("m").agg(F.min("seed").alias("kind")))
    looks = F.lit(False)
    for i, kind in enumerate(KINDS):
        looks = F.when(F.col("kind") == i, F.col("m").rlike(LOOKS[kind])).otherwise(looks)
    for _ in count() if turns is None else range(turns):
        marked = pairs.join(known, "m", "left")
        kinds = [F.count_if(F.col("kind") == i).alias(f"n{i}") for i in range(len(KINDS))]
        counts = marked.groupBy("p").agg(F.count("*").alias("n"), *kinds)
        sure = counts.select("p", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"n{i}").alias("c")) for i in range(len(KINDS))])).alias("x")).select("p", "x.kind", (F.col("x.c") / F.col("n")).alias("confidence"), "x.c")
        # A pattern of a very common word is dealt out over SALTS tasks; few patterns are sure.
        sure = sure.where((F.col("c") >= LEAST_KNOWN) & (F.col("confidence") >= LEAST_CONFIDENCE)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        unknown = marked.where("kind is null").select("m", "p", F.pmod(F.xxhash64("m"), F.lit(SALTS)).cast("int").alias("_salt"))
        votes = unknown.join(sure, ["p", "_salt"]).groupBy("m", "kind").agg((1 - F.exp(F.sum(F.ln(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))).alias("score"))
        new = votes.where((F.col("score") >= LEAST_SCORE) & looks).groupBy("m").agg(F.max(F.struct("score", -F.col("kind"))).alias("best"))
        new = cut(new.select("m", (-F.col("best.col2")).alias("kind")))
        if new.isEmpty():
            break
        known = cut(known.unionAll(new))
    more = edges.where("k is null").drop("k").join(known, "m").where(looks)
    return more.groupBy("doc_id", "_h").agg(F.array_sort(F.collect_set(F.struct("s", F.col("kind").alias("k"), "e"))).alias("more"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def spans(docs: DataFrame, turns: int | None = TURNS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, text, base and more (arrays of start, kind, end) of every row of doc_id, text."""
    occurred = occurrences(docs)
    # The scan's result without the texts feeds the turns; most documents have nothing in it.
    held = cut(occurred.select("doc_id", "_h", "base", "seen"))
    more = discovered(held.where(F.size("seen") > 0), turns)
    rows = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text")) if keep else held
    none = F.lit(None).cast("array<struct<s:int,k:int,e:int>>")
    if keep:
        bases = held.where(F.size("base") > 0).select("doc_id", "_h", "base", none.alias("more"))
        both = bases.unionByName(more.withColumn("base", none)).groupBy("doc_id", "_h")
        more = both.agg(F.first("base", ignorenulls=True).alias("base"), F.first("more", ignorenulls=True).alias("more"))
    more = more.withColumnsRenamed({"doc_id": "_d", "_h": "_g"})
    joined = rows.join(more, (F.col("doc_id").eqNullSafe(F.col("_d"))) & (F.col("_h") == F.col("_g")), "left").drop("_d", "_g", "_h")
    empty = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    return joined.withColumn("base", F.coalesce("base", empty)).withColumn("more", F.coalesce("more", none, empty))


def report(docs: DataFrame, turns: int | None = TURNS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more of every row of doc_id, text."""
    rows = spans(docs, turns)
    of_kind = lambda i: F.filter("base", lambda x: x["k"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    both = F.array_sort(F.concat("base", "more"))
    return rows.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(both).alias("spans"), F.size("more").cast("long").alias("n_more"))


def redact(docs: DataFrame, turns: int | None = TURNS) -> DataFrame:
    """The documents with each span, base or found by patterns, replaced by its kind in brackets; n_chars follows the text."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    # Spans that overlap make one run, named by its first; a run ends with the greatest end in it.
    runs = let("filter(sequence(0, size(x) - 1), i -> i = 0 or get(x, i).s >= get(m, i - 1))", "f", "zip_with(f, slice(f, 2, size(f)), (i, j) -> struct(get(x, i).s as s, get(m, coalesce(j, size(x)) - 1) as e, get(x, i).k as k))")
    runs = let("array_sort(concat(base, more))", "x", let(running("transform(x, y -> y.e)", "max"), "m", runs))
    # Each piece of the text is masked alone; a run's name stands where it begins.
    first, after = first_of("_runs", f"at.e <= j * {PIECE}"), first_of("_runs", f"at.s < (j + 1) * {PIECE}")
    a, z = f"greatest(0, y.s - j * {PIECE})", f"least({PIECE}, y.e - j * {PIECE})"
    mask = f"""aggregate(transform(sequence(k.first, k.after - 1), i -> get(_runs, i)), struct(0 as at, '' as out),
      (acc, y) -> struct({z} as at, concat(acc.out, substring(t, acc.at + 1, {a} - acc.at), if(y.s >= j * {PIECE}, concat('[', element_at(array({names}), y.k + 1), ']'), '')) as out),
      acc -> concat(acc.out, substring(t, acc.at + 1)))"""
    piece = let(f"struct({first} as first, {after} as after)", "k", f"if(k.first < k.after, {mask}, t)")
    masked = f"if(size(_runs) = 0, text, array_join(transform({pieces('text')}, (t, j) -> {piece}), ''))"
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # Names of their own keep the columns of the documents apart from those used here; a null text stays null.
    inner = docs.select("doc_id", "text", F.col("text").isNull().alias("_null"), *[F.col(f"`{c}`").alias(f"_col_{i}") for i, c in enumerate(others)])
    kept = [f"_col_{i}" for i in range(len(others))]
    rows = spans(inner, turns, ("_null", *kept)).withColumn("_runs", F.expr(f"if(size(base) + size(more) = 0, cast(array() as array<struct<s:int,e:int,k:int>>), {runs})"))
    rows = rows.withColumn("text", F.when(~F.col("_null"), F.expr(masked)))
    place = {c: F.col(f"_col_{i}") for i, c in enumerate(others)} | {c: F.col(c) for c in ("doc_id", "text")}
    if "n_chars" in others:
        place["n_chars"] = F.when(~F.col("_null"), F.char_length("text")).otherwise(place["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[place[c].alias(c) for c in docs.columns])
