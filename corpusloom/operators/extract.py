"""Answers lifted from the first context by rule: titles, articles, clauses, definitions, numbers and verbatim text.

Each detector is a column that is null where it does not apply; the first whose answer is trusted stands.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx

# Patterns of questions, each with and without diacritics; group 1 is what is asked for.
TITLE_QUERY = (r"\btên\s+(?:của\s+)?điều\s+(\d+[a-z]?)\s+là\s+gì\b", r"\bten\s+(?:cua\s+)?dieu\s+(\d+[a-z]?)\s+la\s+gi\b")
ARTICLE_QUERY = (r"\bđiều\s+(\d+[a-z]?)\s+quy\s+định\s+gì\b", r"\bdieu\s+(\d+[a-z]?)\s+quy\s+dinh\s+gi\b")
CLAUSE_QUERY = (r"\bkhoản\s+(\d+[a-z]?)\s+điều\s+(\d+[a-z]?)\b", r"\bkhoan\s+(\d+[a-z]?)\s+dieu\s+(\d+[a-z]?)\b")
DEFINITION_QUERY = (
    r"\bđịnh\s+nghĩa\s+(.+?)(?:\s+là\s+gì|\?|$)", r"\bdinh\s+nghia\s+(.+?)(?:\s+la\s+gi|\?|$)",
    r"\b([A-Za-zÀ-ỹĐđ0-9 _'\-]{2,80})\s+là\s+gì\b", r"\b([A-Za-zÀ-ỹĐđ0-9 _'\-]{2,80})\s+la\s+gi\b",
)
EXPLICIT_TITLE = (
    *TITLE_QUERY, r"\bđiều\s+(\d+[a-z]?)\s+tên\s+là\s+gì\b", r"\bdieu\s+(\d+[a-z]?)\s+ten\s+la\s+gi\b",
    r"\bwhat\s+is\s+the\s+(?:title|name)\s+of\s+article\s+(\d+[a-z]?)\b",
)
NOT_A_TITLE = (
    "phân biệt", "phan biet", "so sánh", "so sanh", "giải thích", "giai thich", "trình bày", "trinh bay",
    "compare", "comparison", "differentiate", "difference", "explain",
)
ARTICLE_LINE = r"^\s*(?:điều|dieu|article)\s+(\d+[a-z]?)\s*[.:\-]\s*(.+?)\s*$"
NUMERIC_WORDS = ("muc phat", "so tien", "thoi han", "ngay", "thang", "nam")
# Words of questions that say nothing about what is asked.
STOP = """
la là gì gi bao nhiêu bao_nhieu điều dieu khoản khoan mức muc phạt phat số so tiền tien thời thoi hạn han ngày ngay
trích trich nguyên nguyen văn van quy định dinh
""".split()
LEAST_OVERLAP, LEAST_SCORE, VERBATIM_CHARS, SENTENCE_CHARS = 0.35, 0.005, 900, 420
FLAGS = "(?iuU)"

#: Letters with marks and the letters below them: all that decompose in the range of the word pattern.
MARKED = {chr(c): b for c in range(0xC0, 0x1EFA) if (b := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")) != chr(c) and len(b) == 1}


def plain(text: Column) -> Column:
    """Trimmed, lower-case, without diacritics."""
    low = F.lower(tx.stripped(F.coalesce(text, F.lit(""))))
    return F.regexp_replace(F.translate(low, "".join(MARKED), "".join(MARKED.values())), r"\p{Mn}", "")


def terms(text: Column) -> Column:
    """Distinct words of the plain text, of two characters or more, that are not stop words."""
    found = F.array_distinct(F.regexp_extract_all(plain(text), F.lit("([A-Za-zÀ-ỹĐđ0-9]+)"), F.lit(1)))
    return F.filter(F.array_except(found, tx.words(STOP)), lambda w: F.char_length(w) > 1)


def first_match(text: Column, patterns: tuple[str, ...], group: int = 1) -> Column:
    """The group of the first pattern that matches, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, FLAGS + p, group), F.lit("")) for p in patterns])


def dynamic(text: Column, pattern: Column, group: int) -> Column:
    """The group of a pattern that differs by row, else null."""
    return F.nullif(F.call_function("regexp_extract", text, pattern, F.lit(group)), F.lit(""))


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), tx.stripped), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), tx.stripped), lambda x: x != "")


def article_title(article: Column, content: Column) -> Column:
    """The title behind an article's number at the beginning of a line."""
    pattern = F.concat(F.lit("(?imuU)^\\s*(?:điều|dieu|article)\\s+"), article, F.lit("\\s*[.:\\-]\\s*(.+?)\\s*$"))
    return F.nullif(F.rtrim(F.regexp_replace(dynamic(content, pattern, 1), r"\.+$", "")), F.lit(""))


def article_text(article: Column, content: Column) -> Column:
    """What stands below an article's line, up to the next article."""
    def below(x: Column) -> Column:
        rest = F.slice(x["lines"], x["at"] + 1, F.size(x["lines"]))
        heads = F.slice(x["heads"], x["at"] + 1, F.size(x["heads"]))
        stop = F.array_position(F.transform(heads, lambda h: h != ""), True)
        kept = F.when(stop > 0, F.slice(rest, 1, (stop - 1).cast("int"))).otherwise(rest)
        return F.when(x["at"] > 0, F.nullif(tx.stripped(F.substring(F.array_join(kept, " "), 1, VERBATIM_CHARS)), F.lit("")))

    heads = lambda ls: F.transform(ls, lambda x: F.upper(F.regexp_extract(x, FLAGS + ARTICLE_LINE, 1)))
    found = lambda ls: F.struct(ls.alias("lines"), heads(ls).alias("heads"), F.array_position(heads(ls), article).cast("int").alias("at"))
    return tx.let(tx.let(lines(content), found), below)


def clause_line(query: Column, content: Column) -> Column:
    """The first line that names the clause and article of the question."""
    clause, article = first_match(query, CLAUSE_QUERY, 1), first_match(query, CLAUSE_QUERY, 2)
    pattern = F.concat(F.lit("(?iuU)(?:khoản|khoan)\\s+"), clause, F.lit("\\s+(?:điều|dieu)\\s+"), article)
    hits = F.filter(lines(content), lambda x: F.call_function("rlike", x, pattern))
    return F.when(clause.isNotNull(), F.substring(F.get(hits, F.lit(0)), 1, SENTENCE_CHARS))


def definition(query: Column, content: Column) -> Column:
    """The first sentence that has three quarters of the term's words and says what it is."""
    term = F.regexp_replace(first_match(query, DEFINITION_QUERY), r"^[ .,:;!?]+|[ .,:;!?]+$", "")

    def says(wanted: Column) -> Column:
        fits = lambda s: (F.size(F.array_intersect(wanted, terms(s))) >= 0.75 * F.size(wanted)) & (F.contains(F.concat(F.lit(" "), plain(s), F.lit(" ")), F.lit(" la ")) | F.contains(s, F.lit(":")))
        return F.when(F.size(wanted) > 0, F.get(F.filter(sentences(content), fits), F.lit(0)))

    asked = F.contains(plain(query), F.lit("la gi")) & (F.char_length(term) >= 2)
    return F.when(asked, tx.stripped(F.substring(tx.let(terms(term), says), 1, SENTENCE_CHARS)))


def numeric(query: Column, content: Column) -> Column:
    """The first sentence with a number, for questions of how much or how long."""
    q = plain(query)
    about = F.lit(False)
    for w in NUMERIC_WORDS:
        about = about | F.contains(q, F.lit(w))
    hit = F.get(F.filter(sentences(content), lambda s: s.rlike(r"(?U)\b\d")), F.lit(0))
    return F.when(F.contains(q, F.lit("bao nhieu")) & about, tx.stripped(F.substring(hit, 1, SENTENCE_CHARS)))


def best_score(*scores: Column) -> Column:
    return F.array_max(F.array(*[F.when(~F.isnan(s), s) for s in scores]))


def trusted_score(score: Column) -> Column:
    """A best score of 0 to 1 must reach the threshold, any other be above 0; none is trusted."""
    return F.when(score.isNull(), True).when((score >= 0) & (score <= 1), score >= LEAST_SCORE).otherwise(score > 0)


def overlap_ratio(query: Column, content: Column) -> Column:
    """Share of the question's words that the content has."""
    return tx.let(terms(query), lambda q: F.when(F.size(q) > 0, F.size(F.array_intersect(q, terms(content))) / F.size(q)).otherwise(0.0))


def extractive(query: Column, content: Column, language: Column, score: Column) -> Column:
    """struct of answer, reason, used for a question and the content of its first context; score is its best retrieval score."""
    vi = language == "vi"
    article, ruled = F.upper(first_match(query, TITLE_QUERY)), F.upper(first_match(query, ARTICLE_QUERY))
    title, body, clause = article_title(article, content), article_text(ruled, content), clause_line(query, content)
    verbatim = F.contains(plain(query), F.lit("trich nguyen van"))
    excerpt = F.nullif(tx.stripped(F.substring(tx.stripped(content), 1, VERBATIM_CHARS)), F.lit(""))
    # Reasons and the wording of answers. Numbered matches are trusted whatever the overlap is.
    found = (
        ("title_article_match", True, F.when(vi, F.concat(F.lit("Tên của Điều "), article, F.lit(" là: "), title, F.lit("."))).otherwise(F.concat(F.lit("The title of Article "), article, F.lit(" is: "), title, F.lit(".")))),
        ("article_content_match", True, F.when(vi, F.concat(F.lit("Điều "), ruled, F.lit(" quy định:\n"), body)).otherwise(F.concat(F.lit("Article "), ruled, F.lit(" provides:\n"), body))),
        ("clause_article_match", True, clause),
        ("definition_sentence_match", False, F.nullif(definition(query, content), F.lit(""))),
        ("numeric_span_match", False, F.nullif(numeric(query, content), F.lit(""))),
        ("verbatim_clause_article_match", True, F.when(verbatim, clause)),
        ("verbatim_excerpt_match", False, F.when(verbatim & clause.isNull(), excerpt)),
    )
    near = overlap_ratio(query, content) >= LEAST_OVERLAP
    listed = F.array(*[F.struct(a.alias("answer"), F.lit(r).alias("reason"), (trusted_score(score) & (near | F.lit(sure))).alias("used")) for r, sure, a in found])

    def pick(xs: Column) -> Column:
        some = F.filter(xs, lambda x: x["answer"].isNotNull())
        good, last = F.get(F.filter(some, lambda x: x["used"]), F.lit(0)), F.get(some, F.size(some) - 1)
        none = F.struct(F.lit(None).cast("string").alias("answer"), F.coalesce(F.concat(last["reason"], F.lit(":low_confidence")), F.lit("not_simple_query")).alias("reason"), F.lit(False).alias("used"))
        return F.when(good.isNotNull(), good).otherwise(F.when(F.coalesce(tx.stripped(content), F.lit("")) == "", F.struct(F.lit(None).cast("string").alias("answer"), F.lit("no_context").alias("reason"), F.lit(False).alias("used"))).otherwise(none))

    return tx.let(listed, pick)


def exact_title(query: Column, contexts: Column, language: Column) -> Column:
    """The answer to a question for an article's title, from the first context that has it; null for any other question."""
    article = F.upper(first_match(query, EXPLICIT_TITLE))
    other = F.lit(False)
    for w in NOT_A_TITLE:
        other = other | F.contains(F.lower(query), F.lit(w))
    at_line = F.concat(F.lit("(?imuU)^\\s*(?:điều|dieu|article)\\s*"), article, F.lit("\\s*[.:\\-]\\s*(.+?)\\s*$"))
    inside = F.concat(F.lit("(?iuU)(?:điều|dieu|article)\\s*"), article, F.lit("\\s*[.:\\-]\\s*([^\\n]+)"))
    clean = lambda t: F.nullif(tx.stripped(F.regexp_replace(tx.stripped(t), r"\.+$", "")), F.lit(""))
    titles = F.transform(contexts, lambda c: F.coalesce(clean(dynamic(c, at_line, 1)), clean(dynamic(c, inside, 1))))
    title = F.get(F.filter(titles, lambda t: t.isNotNull()), F.lit(0))
    said = F.when(language == "vi", F.concat(F.lit("Tên của Điều "), article, F.lit(" là: "), title, F.lit("."))).otherwise(F.concat(F.lit("The title of Article "), article, F.lit(" is: "), title, F.lit(".")))
    return F.when(~other & article.isNotNull(), said)
