"""Values of model replies and traces as typed columns, and a conversation as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Words for true and false, note categories.
TRUE = ("true", "1", "yes", "y")
FALSE = ("false", "0", "no", "n")
CATEGORIES = ("no_evidence", "weak_evidence", "incomplete_answer", "hallucination", "grounded")


def to_bool(value: Column, default: bool) -> Column:
    """A string as a boolean; the default for null and for all other words."""
    word = F.lower(tx.stripped(value))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False).otherwise(default)


def to_double(value: Column, default: float) -> Column:
    """A string as a number; the default for null and for what is no number."""
    return F.coalesce(value.try_cast("double"), F.lit(default))


def non_negative(value: Column, default: int = 0) -> Column:
    """A string or number as a whole number of at least 0; the default for null and for what is none."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(value.try_cast("long"), F.lit(default).cast("long")))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to 6 places; 0 for nulls, wholes that are not above 0, and negative results."""
    p, w = part.try_cast("double"), whole.try_cast("double")
    sound = p.isNotNull() & ~F.isnan(p) & (w > 0) & ~F.isnan(w)
    return F.when(sound, F.greatest(F.lit(0.0), F.round(p / w, 6))).otherwise(0.0)


def note_category(note: Column) -> Column:
    """The category before a note's first colon, null for any other start."""
    head = F.regexp_extract(F.lower(tx.stripped(note)), r"^([a-z_]+):", 1)
    return F.when(head.isin(*CATEGORIES), head)


def history_lines(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, history: the messages (conv_id, turn, role, text) as numbered lines; "(empty)" for conversations without one.

    messages are those kept by a trim, so a conversation has a bounded number of them. Equal turns go by role and text.
    """
    m = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", tx.stripped(F.col("text")).alias("text")))),
        lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.when(x["role"] == "user", "User").otherwise("Assistant"), F.lit(": "), x["text"]),
    )
    lines = messages.groupBy("conv_id").agg(F.array_join(m, "\n").alias("history"))
    return conversations.select("conv_id").distinct().join(lines, "conv_id", "left").select("conv_id", F.coalesce("history", F.lit("(empty)")).alias("history"))


# The fence of a block of JSON, the states of an answer, and the answer to an empty reply.
FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"
STATES = ("answered", "partial", "insufficient_evidence")
NO_REPLY = "Insufficient evidence to answer reliably."


#: Texts that stand for a number.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?inf(inity)?$|^nan$"


def json_payload(reply: Column) -> Column:
    """The first text in a reply that is JSON: a fenced block, the whole, from the first brace to the last, from the first
    bracket to the last. Null where there is none."""
    text = tx.stripped(F.coalesce(reply, F.lit("")))
    tried = F.concat(
        F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)),
        F.array(text, F.regexp_extract(text, r"(?s)\{.*\}", 0), F.regexp_extract(text, r"(?s)\[.*\]", 0)),
    )
    return F.get(F.filter(tried, lambda x: (x != "") & F.try_parse_json(x).isNotNull()), F.lit(0))


def json_object(reply: Column) -> Column:
    """The payload if it is an object, else null."""
    return tx.let(json_payload(reply), lambda p: F.when(p.startswith("{"), p))


def json_list(reply: Column) -> Column:
    """The payload if it is a list, else null."""
    return tx.let(json_payload(reply), lambda p: F.when(p.startswith("["), p))


def text_field(payload: Column, name: str) -> Column:
    """A field of a JSON object if it is a string, else null."""
    field = F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(field, "$", "string"))


def structured_answer(reply: Column) -> Column:
    """Struct of answer, status and confidence that a reply's JSON object states: the answer is text, once more unwrapped if it
    holds such an object itself; the status is one of STATES (answered where there is none); the confidence is a number, written
    as text or not, or null. An object that breaks any of these says nothing, as does a reply without one: then the whole reply
    is the answer, without a confidence; an empty reply has no evidence and confidence 0.
    """
    plain, v = tx.stripped(F.coalesce(reply, F.lit(""))), F.try_parse_json(json_object(reply))
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("none"))
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    told = tx.stripped(text("confidence"))
    number = F.when(kind("confidence") == "BOOLEAN", (told == "true").cast("double")).otherwise(told.try_cast("double"))
    numeric = (kind("confidence") != "STRING") | F.lower(told).rlike(NUMBER)
    sure = kind("confidence").isin("none", "VOID") | (number.isNotNull() & numeric)
    sound = (kind("answer") == "STRING") & ((kind("status") == "none") | ((kind("status") == "STRING") & text("status").isin(*STATES))) & sure
    nested = tx.let(text("answer"), lambda a: F.coalesce(F.nullif(tx.stripped(text_field(json_object(a), "answer")), F.lit("")), tx.stripped(a)))
    empty = plain == ""
    return F.struct(
        F.when(sound, nested).when(empty, NO_REPLY).otherwise(plain).alias("answer"),
        F.when(sound, F.coalesce(text("status"), F.lit("answered"))).when(empty, "insufficient_evidence").otherwise("answered").alias("status"),
        F.when(sound, number).when(empty, 0.0).alias("confidence"),
    )


def gate_said(reply: Column) -> Column:
    """Struct of need and reason that a model's reply on retrieval states; null where its JSON object has no boolean need."""
    v = F.try_parse_json(json_object(reply))
    need = F.try_variant_get(v, "$.need_retrieval", "variant")
    reason = F.nullif(tx.stripped(text_field(json_object(reply), "reason")), F.lit(""))
    return F.when(F.schema_of_variant(need) == "BOOLEAN", F.struct(F.try_variant_get(need, "$", "boolean").alias("need"), F.coalesce(reason, F.lit("llm_gate")).alias("reason")))


def rendered(template: Column, variables: dict[str, Column]) -> Column:
    """A template with $name and ${name} replaced by values (null: empty); other names stay as they are and $$ is one $.

    A value is never looked at again, so names inside of it stay.
    """
    pieces = F.regexp_extract_all(template, F.lit(r"(?s)(\$\$|\$\{[a-zA-Z_][a-zA-Z0-9_]*\}|\$[a-zA-Z_][a-zA-Z0-9_]*|\$|[^$]+)"), F.lit(1))

    def filled(piece: Column) -> Column:
        out = F.when(piece == "$$", "$")
        for name, value in variables.items():
            out = out.when(piece.isin(f"${name}", f"${{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
        return out.otherwise(piece)

    return F.array_join(F.transform(pieces, filled), "")


def cache_key(*parts: Column) -> Column:
    """The first 24 hexadecimal digits of the SHA-256 of the parts, joined by bars; null reads None."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 24)


def short_error(message: Column, most: int = 240) -> Column:
    """A message with single blanks, cut to a length with dots at its end."""
    text = tx.stripped(F.regexp_replace(F.coalesce(message, F.lit("None")), r"(?U)\s+", " "))
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def reply_latency(reply: Column) -> Column:
    """latency_ms of a reply in JSON; of a compared run without one, that of its first branch that has one, or the branch's last
    compare_total_ms in its trace. Whole and at least 0; null where there is no number."""
    v = F.try_parse_json(reply)

    def number(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        return F.when(kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE"), F.try_variant_get(v, path, "double"))

    def traced(branch: str) -> Column:
        totals = F.transform(F.try_variant_get(v, f"$.{branch}.trace", "array<variant>"), lambda s: F.try_variant_get(s, "$.compare_total_ms", "double"))
        return F.get(F.reverse(F.filter(totals, lambda t: t.isNotNull())), F.lit(0))

    compared = F.lower(tx.stripped(F.coalesce(F.try_variant_get(v, "$.mode", "string"), F.lit("")))) == "compare"
    inner = F.coalesce(*[c for b in ("standard", "advanced") for c in (number(f"$.{b}.latency_ms"), traced(b))])
    found = F.coalesce(number("$.latency_ms"), F.when(compared, inner)).cast("long")
    return F.when(found < 0, 0).otherwise(found)
