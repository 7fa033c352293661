"""Text as columns: tokens, cleaning, keywords, overlap, language and query classes. All are built-in expressions."""

from __future__ import annotations

import itertools
import json
import unicodedata
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode word tokens; plain \w would be ASCII in both engines.
TOKEN = r"[\p{L}\p{N}_]+"
# Characters of words and queries, letters that only Vietnamese has, and those of East Asian scripts.
WORD = r"[A-Za-zÀ-ỹĐđ0-9']+"
OUTSIDE = r"[^A-Za-zÀ-ỹĐđ0-9\s'_+]"
DIACRITIC = r"[àáạảãăắằặẳẵâấầậẩẫèéẹẻẽêếềệểễìíịỉĩòóọỏõôốồộổỗơớờợởỡùúụủũưứừựửữỳýỵỷỹđ]"
CJK = r"[㐀-䶿一-鿿豈-﫿]"

# Common words of the two languages that keywords leave out and that language detection counts.
VI_COMMON = """
la là va và cua của cho trong tai tại voi với duoc được mot một nhung những the thế nao nào gi gì bao nhieu bao_nhieu
vi vì sao hay hãy khong không toi tôi ban bạn nay này do neu nếu theo tren trên duoi dưới dang đang se sẽ da đã can cần
them thêm tu từ den đến day đây kia đó ve về cung cũng len lên xuong xuống roi rồi chi chỉ rat rất co có thong thông tin
""".split()
EN_COMMON = """
the and is are to of in for with on that this it as be from or an by at was were can could should would about into over
under than then also more most very some any all each every such other their there here our your my
""".split()
VI_MARKERS = (" la gi", " nhu the nao", " bao nhieu", " tai sao")
SMALL_TALK = ("hi", "hello", "hey", "thanks", "thank", "bye", "goodbye")

# What makes a query complex, and patterns of queries whose answer can be lifted from the text.
COMPLEX_HINTS = (
    "compare", "contrast", "analyze", "analysis", "summarize", "summary", "pros and cons", "evaluate", "synthesize",
    "trade-off", "tradeoff", "so sánh", "so sanh", "phân biệt", "phan biet", "phân tích", "phan tich", "đánh giá",
    "danh gia", "tổng hợp", "tong hop", "ưu nhược điểm", "uu nhuoc diem",
)
EXTRACTIVE_PATTERNS = (
    r"(?i)\b(title|name)\b.{0,40}\b(article|section|clause)\b",
    r"(?i)\b(article|section|clause)\s+\d+[a-z]?\b.{0,30}\b(title|name)\b",
    r"(?i)\btên\s+(của\s+)?(điều|mục|khoản)\s+\d+[a-z]?\b",
    r"(?i)\bten\s+(cua\s+)?(dieu|muc|khoan)\s+\d+[a-z]?\b",
    r"(?i)\b(what is|define|definition of|meaning of)\b",
    r"\b(là gì|la gi|định nghĩa|dinh nghia|nghĩa là gì|nghia la gi)\b",
    r"(?i)\b(date|day|month|year|number|amount|threshold|deadline|limit|quota|percent|percentage)\b",
    r"\b(ngày|tháng|năm|số|mức|ngưỡng|hạn|hạn chót|hạn cuối|bao nhiêu|bao nhieu|tỷ lệ|ti le)\b",
    r"(?i)\b(quote|quoted|exact text|verbatim|extract)\b",
    r"\b(trích|trich|nguyên văn|nguyen van)\b",
)
ENTITY_PATTERN = r"(?i)\b(article|section|clause|điều|dieu|khoản|khoan|mục|muc)\s+\d+[a-z]?\b"
QUOTED_PATTERN = r"\"[^\"]{2,}\"|'[^']{2,}'"
UPPER_PATTERN = r"\b[A-Z][A-Z0-9_-]{1,}\b"
# Phrases of answers that say nothing.
GENERIC_PHRASES = (
    "không đủ thông tin", "khó xác định", "cần thêm thông tin", "dựa trên ngữ cảnh hiện có", "theo ngữ cảnh hiện có",
    "thông tin liên quan là", "cannot determine", "can not determine", "based on the available context",
    "evidence is limited", "insufficient evidence",
)


def words(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, also where `use` looks at it from within a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space at either end, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case word tokens, in order; null and empty texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def cased_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def cleaned(text: Column) -> Column:
    """One kind of line end, no blanks before it, at most two in a row, trimmed."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    return stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def paragraphs(text: Column) -> Column:
    """Trimmed, non-empty parts between blank lines."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n+"), stripped), lambda p: p != "")


def compositions() -> dict[str, str]:
    """Letters of the language patterns (À to ỹ) by every spelling that is canonically the same: a base letter, or one that is
    composed in part, and the marks that are left in any order that does not matter."""
    out: dict[str, str] = {}
    for point in range(0xC0, 0x1EFA):
        letter = chr(point)
        if unicodedata.category(letter) not in ("Lu", "Ll") or unicodedata.normalize("NFC", letter) != letter:
            continue
        base, *marks = unicodedata.normalize("NFD", letter)
        for order in itertools.permutations(marks):
            if marks and unicodedata.normalize("NFC", base + "".join(order)) == letter:
                out[base + "".join(order)] = letter
                partly = unicodedata.normalize("NFC", base + order[0]) + "".join(order[1:])
                if unicodedata.normalize("NFC", partly) == letter and partly != letter:
                    out[partly] = letter
    return out


#: Buckets of the table of compositions, by a checksum of the spelling: about one spelling in each.
COMPOSED_BUCKETS = 2048


def composed(text: Column) -> Column:
    """Text with letters and the marks after them as single letters, where there is one from À to ỹ; other marks stay as they are.

    Only texts with marks are taken apart, and only pieces that hold a mark are looked up: each in its bucket, as a map compares
    its keys one by one.
    """
    buckets: list[dict[str, str]] = [{} for _ in range(COMPOSED_BUCKETS)]
    known = compositions()
    for spelling, single in known.items():
        buckets[zlib.crc32(spelling.encode()) % COMPOSED_BUCKETS][spelling] = single
    longest = max(len(spelling.encode()) for spelling in known)
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\P{M}\p{M}+|[^\p{M}]+?(?=\P{M}\p{M}|\z)|\p{M}+"), F.lit(0))
    letter = lambda p: F.try_element_at(F.get(table, F.crc32(p.cast("binary")) % COMPOSED_BUCKETS), p)
    # Longer pieces than the longest spelling are text without marks, or marks that no letter takes.
    whole = F.array_join(F.transform(pieces, lambda p: F.when(F.octet_length(p) <= longest, F.coalesce(letter(p), p)).otherwise(p)), "")
    return F.when(F.regexp_like(text, F.lit(r"\p{M}")), whole).otherwise(text)


def normalized_query(query: Column) -> Column:
    """Query text, composed, with only letters, digits, quotes, _ and + left, single-spaced."""
    spaced = F.regexp_replace(composed(F.coalesce(query, F.lit(""))), r"\s+", " ")
    return stripped(F.regexp_replace(F.regexp_replace(spaced, OUTSIDE, " "), r"\s+", " "))


def match_text(text: Column) -> Column:
    """Lower-case text for matching, odd characters blanked."""
    lowered = F.lower(stripped(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    return F.regexp_replace(lowered, OUTSIDE, " ")


def keywords(text: Column) -> Column:
    """Distinct words that mean something: no common words, no single characters."""
    found = F.array_distinct(F.regexp_extract_all(match_text(text), F.lit(WORD), F.lit(0)))
    return F.filter(F.array_except(found, words(sorted({*VI_COMMON, *EN_COMMON}))), lambda w: F.char_length(w) >= 2)


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the matching text, blanks left out."""
    # Characters one by one: looking up the i-th of a long string would count from its start each time.
    runs = lambda c: F.zip_with(F.zip_with(c, F.slice(c, 2, F.size(c)), lambda a, b: F.concat(a, b)), F.slice(c, 3, F.size(c)), lambda ab, d: F.concat(ab, d))
    whole = let(F.filter(F.split(F.regexp_replace(match_text(text), " ", ""), ""), lambda x: x != ""), runs)
    return F.array_distinct(F.filter(whole, lambda r: r.isNotNull()))


def share(part: Column, whole: Column) -> Column:
    """Size of the intersection over the size of the first; 0 for an empty one."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(F.lit(0.0))


def overlap_score(answer: Column, context: Column) -> Column:
    """0.8 of the keyword share and 0.2 of the trigram share; trigrams alone where the answer has no keywords."""
    sets = F.struct(keywords(answer).alias("a"), keywords(context).alias("c"), trigrams(answer).alias("ra"), trigrams(context).alias("rc"))

    def score(x: Column) -> Column:
        runs = F.round(share(x["ra"], x["rc"]), 4)
        return F.when(F.size(x["a"]) > 0, 0.8 * share(x["a"], x["c"]) + 0.2 * runs).otherwise(runs)

    return F.round(let(sets, score), 4)


def language(query: Column) -> Column:
    """vi for Vietnamese letters, marker phrases or two common words; else en."""
    low = F.lower(normalized_query(query))
    marked = F.lit(False)
    for m in VI_MARKERS:
        marked = marked | F.contains(F.concat(F.lit(" "), low), F.lit(m))
    hits = F.size(F.filter(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), lambda w: w.isin(*VI_COMMON)))
    return F.when((low != "") & (low.rlike(DIACRITIC) | marked | (hits >= 2)), "vi").otherwise("en")


def language_mismatch(answer: Column, expected: Column) -> Column:
    """Whether an answer that should be Vietnamese does not look it."""
    text = stripped(F.coalesce(answer, F.lit("")))
    found = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)
    n = F.size(found)
    vi = F.size(F.filter(found, lambda w: w.isin(*VI_COMMON)))
    en = F.size(F.filter(found, lambda w: w.isin(*EN_COMMON)))
    plain = ((vi == 0) & (en >= F.greatest(F.lit(3), F.floor(n / 5)))) | ((vi < 2) & (n >= 8))
    return F.when((text == "") | (expected != "vi"), False).when(text.rlike(CJK), True).when(F.lower(text).rlike(DIACRITIC), False).when(n == 0, False).otherwise(plain)


def gate_reason(query: Column) -> Column:
    """Why retrieval runs or not; it runs for forced_retrieval and default_retrieval."""
    low = F.lower(stripped(F.coalesce(query, F.lit(""))))
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)))
    talk = words(SMALL_TALK)
    return (
        F.when(low == "", "empty_query")
        .when(F.contains(low, F.lit("force retrieval")) | F.contains(low, F.lit("force retry")), "forced_retrieval")
        .when((F.size(found) > 0) & (F.size(F.array_except(found, talk)) == 0), "small_talk")
        .when((F.size(found) <= 2) & F.arrays_overlap(found, talk), "small_talk_short")
        .otherwise("default_retrieval")
    )


# A word's end where only ASCII letters, digits and _ are parts of words. Java's \b has other letters in it with every flag.
ASCII_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def any_match(text: Column, patterns: tuple[str, ...], ascii_words: bool = False) -> Column:
    r"""Whether one of the patterns is found. Words are Unicode's; ascii_words: \b, \s, \d and the dot as RE2 and so the SQL have them."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike("(?ud)" + p.replace(r"\b", ASCII_EDGE).replace(r"\s", r"[\t\n\f\r ]") if ascii_words else "(?U)" + p)
    return out


def complexity(query: Column, ascii_words: bool = False) -> Column:
    """complex, simple_extractive or normal. ascii_words: other letters than ASCII's end a word, as in the SQL of the queries."""
    low = F.lower(stripped(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " ")))
    hinted = F.lit(False)
    for h in COMPLEX_HINTS:
        hinted = hinted | F.contains(low, F.lit(h))
    named = any_match(low, (ENTITY_PATTERN,), ascii_words) | any_match(query, (QUOTED_PATTERN, UPPER_PATTERN), ascii_words)
    short = F.size(F.split(low, " ")) <= 10
    return F.when(low == "", "normal").when(hinted, "complex").when(any_match(query, EXTRACTIVE_PATTERNS, ascii_words) | (short & named), "simple_extractive").otherwise("normal")


def generic(answer: Column) -> Column:
    """Whether an answer is a stock phrase or has at most two keywords."""
    text = match_text(answer)
    phrase = F.lit(False)
    for p in GENERIC_PHRASES:
        phrase = phrase | F.contains(text, F.lit(p))
    return (text == "") | phrase | (F.size(keywords(answer)) <= 2)


def truncated(text: Column, most: Column) -> Column:
    """At most so many characters: up to the last sentence end past a third, else the last blank there, else cut hard."""
    part = F.substring(text, F.lit(1), most.cast("int"))
    sentence = F.char_length(F.regexp_extract(part, r"(?s)^(.*[.!?。]\s+)", 1))
    # The last blank: all before the last piece between blanks.
    blank = F.char_length(part) - F.char_length(F.substring_index(part, " ", -1)) - 1
    third = F.floor(most / 3)
    cut = F.when(sentence > third, F.substring(part, F.lit(1), sentence)).when(blank > third, F.substring(part, F.lit(1), blank)).otherwise(part)
    return F.when(F.char_length(text) <= most, text).otherwise(F.regexp_replace(cut, r"\s+$", ""))


def squashed(score: Column) -> Column:
    """A score on the scale of 0 to 1: negative is 0, above 1 is x / (1 + x); 4 decimals."""
    return F.when(score.isNull() | F.isnan(score), None).when(score <= 0, 0.0).when(score <= 1, F.round(score, 4)).otherwise(F.round(score / (1 + score), 4))
