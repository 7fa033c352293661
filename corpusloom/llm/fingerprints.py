"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Each term of a text weighs as often as it occurs. For every slot a term draws r and c from Gamma(2, 1) and b from
(0, 1), by a hash of term and slot; with t = floor(ln weight / r + b) the term's key is c exp(-r (t - b + 1)), and the slot
holds a code of the (term, t) with the least key, a hash of that key. Two texts agree in a slot with the probability of their generalised Jaccard
similarity. A text and its edited version share the draws of a term; only t and the key are taken for each.

No text travels but to its own row's place and, as far as the edit needs it, to the row before: the order of the documents is
found on hashes, ids and lengths alone.

Results for odd input: null counts as empty; a text without words has an empty fingerprint, like any other such text and
unlike all the rest; equal texts have equal fingerprints; equal ids are ordered by hashes of id and text, null ids come
first; of rows equal in id and text each is followed by the next, the last by what comes after; a single document is its
own next one; a long text is one row of each step, its words one array of hashes; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered

SLOTS = 64
#: Slots that are sampled side by side: with both versions' they stay below the columns that Spark compiles at once.
ABREAST = 8
#: Bits of a slot's code: five hexadecimal digits.
CODE_BITS = 20
SEPARATOR = r"[\x20\x09-\x0D]+"


def uniform(x: Column, low: int) -> Column:
    """A number within (0, 1) from 32 bits of a hash."""
    return (F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << 32) - 1)) + 0.5) * 2.0**-32


def sample(term: Column, slot: Column, logs: list[Column]) -> list[Column]:
    """For each weight, given by its logarithm, the term's key in a slot; null for a null logarithm.

    r is the sum of two exponential draws, which makes it a Gamma(2, 1) draw; the second's part in it is b. With t = 0, as
    for each term that occurs once, the key is then c times the uniform number of the first.
    """
    x = F.xxhash64(term, slot)
    y = F.xxhash64(x)
    u, v = uniform(x, 32), uniform(x, 0)
    once, r = -F.ln(uniform(y, 0) * uniform(y, 32)) * u, -F.ln(u * v)

    def key(log: Column) -> Column:
        # What all weights need stands outside of the cases, where Spark works it out once.
        t = F.floor((log - F.ln(v)) / r)
        return once * F.when(log == 0, 1.0).when(log > 0, F.exp(-r * t))

    return [key(log) for log in logs]


def signatures(terms: DataFrame, keys: list[str], weights: list[str], slots: int = SLOTS) -> DataFrame:
    """keys and, for each column of weights, its signature as text under the same name: each slot's code as five digits.

    A key is a function of slot, term and t, so a hash of the least key is the code. terms: keys, a 64-bit term, its
    weights, of which 0 or null is none. Keys without a weight have an empty signature.
    """
    ones, each = (1 << CODE_BITS) - 1, min(slots, ABREAST)
    rows = terms.select(*keys, "term", *[F.ln(w).alias(f"_log_{w}") for w in weights], F.explode(F.sequence(F.lit(0), F.lit(slots - 1), F.lit(each))).alias("_slot"))
    least = []
    for i in range(each):
        found = sample(F.col("term"), F.col("_slot") + i, [F.col(f"_log_{w}") for w in weights])
        least += [F.min(key).alias(f"_{w}_{i}") for w, key in zip(weights, found)]
    held = rows.groupBy(*keys, "_slot").agg(*least)
    digits = lambda c: F.lower(F.lpad(F.hex(F.xxhash64(c).bitwiseAND(F.lit(ones))), CODE_BITS // 4, "0"))
    parts = [F.when(F.col(f"_{w}_0").isNotNull(), F.concat(*[digits(F.col(f"_{w}_{i}")) for i in range(each)])).alias(w) for w in weights]
    whole = held.select(*keys, "_slot", *parts).groupBy(*keys)
    joined = [F.array_join(F.array_sort(F.collect_list(F.struct("_slot", w))).getField(w), "").alias(w) for w in weights]
    return whole.agg(*joined).select(*keys, *[F.substring(w, 1, slots * CODE_BITS // 4).alias(w) for w in weights])


def hashed_words(text: Column, bit: int) -> Column:
    """Hashes of the lower-cased words, the lowest bit set to the given one."""
    # The empty string beside white space is no term.
    words = F.array_remove(F.split(F.lower(text), SEPARATOR), "")
    return F.transform(words, lambda w: F.shiftleft(F.shiftright(F.xxhash64(w), 1), 1).bitwiseOR(F.lit(bit)))


def counted(texts: DataFrame, keys: list[str], text: str, other: str) -> DataFrame:
    """keys, term, text, other: how often each term occurs in each of two texts of a row; one null term where no word is.

    Counted by the runs of the row's sorted hashes: a task holds the words of one row at a time, however many it has.
    """
    hashes = F.sort_array(F.concat(hashed_words(F.col(text), 0), hashed_words(F.col(other), 1)))
    h, n = F.col("_hashes"), F.size("_hashes")
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
    rows = texts.select(*keys, hashes.alias("_hashes")).select(*keys, "_hashes", F.when(n > 0, first).alias("_first"))
    # What a term's row needs from both arrays is read beside the arrays, where Spark compiles it.
    rows = rows.select(*keys, "_hashes", "_first", F.posexplode_outer("_first").alias("_j", "_at"))
    at, after = F.col("_at"), F.get("_first", F.col("_j") + 1)
    x, term, zero = F.get(h, at), F.shiftright(F.get(h, at), 1), F.lit(0)
    here, beside = F.coalesce(after, n) - at, F.coalesce(F.get("_first", F.col("_j") + 2), n) - after
    second = x.bitwiseAND(F.lit(1).cast("long")) == 1
    # A term's run in the one text stands just before its run in the other.
    rows = rows.where(~F.coalesce(second & (F.shiftright(F.get(h, at - 1), 1) == term), F.lit(False)))
    both = F.when(second, here).when(F.shiftright(F.get(h, after), 1) == term, beside).otherwise(zero)
    return rows.select(*keys, term.alias("term"), F.when(second, zero).otherwise(here).alias(text), both.alias(other))


def likeness(a: Column, b: Column, slots: int = SLOTS) -> Column:
    """Share of slots that agree in two signatures."""
    digits = CODE_BITS // 4
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.substring(a, i * digits + 1, F.lit(digits)) == F.substring(b, i * digits + 1, F.lit(digits)))) / slots
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(same)


def followed(rows: DataFrame) -> DataFrame:
    """_a, _b, _half, _next_a, _next_b: the hashes of each distinct row and of the one after it, from hashes, ids and lengths alone."""
    distinct = cut(rows.groupBy("_a", "_b").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars")))
    placed = numbered(distinct, F.col("doc_id").asc_nulls_first(), "_a", "_b", name="_at").select("_at", "_a", "_b", F.floor(F.col("n_chars") / 2).cast("int").alias("_half"))
    total = distinct.count()
    before = placed.select(F.pmod(F.col("_at") - 1, F.lit(max(1, total))).alias("_at"), F.col("_a").alias("_next_a"), F.col("_b").alias("_next_b"))
    return cut(placed.join(before, "_at").drop("_at"))


def edits(docs: DataFrame) -> DataFrame:
    """_a, _b, _copy, doc_id, n_chars, text, edited, _next_a, _next_b: each row with its edited text.

    The last half's code points are replaced by the first as many of the next document.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumns({"_a": F.xxhash64("doc_id", "text"), "_b": F.xxhash64("text", "doc_id", F.lit(1)), "n_chars": F.char_length("text").cast("long")})
    after = followed(rows)
    # Both joins below read the texts in the same places, so they are moved once.
    asked = after.select(F.col("_next_a").alias("_a"), F.col("_next_b").alias("_b"), F.col("_a").alias("_of_a"), F.col("_b").alias("_of_b"), "_half")
    given = rows.join(asked, ["_a", "_b"]).select(F.col("_of_a").alias("_a"), F.col("_of_b").alias("_b"), F.col("doc_id").alias("_next_id"), "n_chars", F.substring("text", F.lit(1), F.col("_half")).alias("_start"))
    # Of equal next rows one is enough. Ordered by the columns that both joins then read, in one move of the texts.
    given = given.withColumn("_k", F.row_number().over(Window.partitionBy("_a", "_b").orderBy("n_chars", "_next_id"))).where("_k = 1").select("_a", "_b", "_start")
    given = given.join(after, ["_a", "_b"])
    # Of rows that are equal all but the last are followed by their like.
    copies = Window.partitionBy("_a", "_b").orderBy("n_chars")
    both = rows.join(given, ["_a", "_b"]).withColumns({"_copy": F.row_number().over(copies), "_more": F.lead("n_chars").over(copies).isNotNull()})
    start = F.when(F.col("_more"), F.substring("text", F.lit(1), F.col("_half"))).otherwise(F.col("_start"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("_half")).cast("int")), start)
    following = lambda c: F.when(F.col("_more"), F.col(c)).otherwise(F.col(f"_next{c}"))
    return both.select("_a", "_b", "_copy", "doc_id", "n_chars", "text", edited.alias("edited"), following("_a").alias("_next_a"), following("_b").alias("_next_b"))


def compare_with_edits(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of doc_id, text."""
    rows = edits(docs).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumnsRenamed({"text": "fingerprint", "edited": "edited_fingerprint"})
    facts = ["_a", "_b", "_copy", "doc_id", "n_chars", "edited_sha256", "_next_a", "_next_b"]
    signed = cut(signatures(counted(rows, facts, "fingerprint", "edited_fingerprint"), facts, ["fingerprint", "edited_fingerprint"], slots))
    following = signed.where("_copy = 1").select(F.col("_a").alias("_next_a"), F.col("_b").alias("_next_b"), F.col("fingerprint").alias("_following"))
    f = F.col("fingerprint")
    return signed.join(following, ["_next_a", "_next_b"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(f, F.col("edited_fingerprint"), slots).alias("near_edited"), likeness(f, F.col("_following"), slots).alias("near_next"))
