"""DuckDB SQL for the library's queries."""

from __future__ import annotations

from .functions import text as tx
from .operators import judge
from .queries import K

T = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"
COMMON = ", ".join(f"'{w}'" for w in sorted({*tx.VI_COMMON, *tx.EN_COMMON}))

#: Common table expressions by name, each with those it needs before it.
TOKENS = f"tok as (select doc_id, {T.format('text')} as t from documents)"
QTOKENS = f"qt as (select item_id as query_id, unnest({T.format('text')}) as term from benchmark), q as (select query_id, term, count(*) as qf from qt group by all)"
BM25 = f"""{TOKENS}, {QTOKENS},
st as (select count(*)::double as n, avg(len(t))::double as a from tok),
tf as (select doc_id, term, count(*)::double as tf, any_value(dl)::double as dl from (select doc_id, len(t) as dl, unnest(t) as term from tok) group by doc_id, term),
df as (select term, count(*)::double as df from tf group by term),
sc as (select query_id, doc_id, sum(ln(1::double + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / a)) * qf) as score
  from q join tf using (term) join df using (term), st group by query_id, doc_id)"""


def bm25(k: int) -> str:
    return BM25 + f""",
bm as (select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from sc) where rank <= {k})"""


def hashed(name: str, frame: str, key: str) -> str:
    """Signed token counts by hash bucket of a table."""
    return rf"""{name}0 as (select {key} as id, unnest(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+')) as w from {frame}),
{name}1 as (select id, ('0x' || right(sha1(w), 2))::integer as h from {name}0),
{name} as (select id, h % 64 as bucket, sum(case when (h // 2) % 2 = 1 then -1 else 1 end)::double as c from {name}1 group by all),
{name}n as (select id, sqrt(sum(c * c)) as norm from {name} group by id)"""


def dense(k: int) -> str:
    return f"""{hashed('hd', 'documents', 'doc_id')}, {hashed('hq', 'benchmark', 'item_id')},
dots as (select hq.id as query_id, hd.id as doc_id, sum(hq.c * hd.c) as dot from hq join hd using (bucket) group by all),
cs as (select i.item_id as query_id, d.doc_id, coalesce(dot / (a.norm * b.norm), 0::double) as score from benchmark i cross join documents d
  left join dots on dots.query_id = i.item_id and dots.doc_id = d.doc_id left join hqn a on a.id = i.item_id left join hdn b on b.id = d.doc_id),
dn as (select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from cs) where rank <= {k})"""


FUSED = f"""{bm25(30)}, {dense(30)},
fu as (select coalesce(dn.query_id, bm.query_id) as query_id, coalesce(dn.doc_id, bm.doc_id) as doc_id, dn.score as dense_score, bm.score as sparse_score,
  coalesce(0.5::double / (60 + dn.rank), 0::double) + coalesce(0.5::double / (60 + bm.rank), 0::double) as score
  from dn full join bm on dn.query_id = bm.query_id and dn.doc_id = bm.doc_id),
fr as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id::varchar) as rank from fu) where rank <= {K})"""

CONTENT = f"{bm25(K)}, ct as (select bm.*, text as content from bm join documents using (doc_id))"
SQUASH = "case when {0} <= 0 then 0::double when {0} <= 1 then round({0}, 4) else round({0} / (1 + {0}), 4) end"
STATS = f"""{bm25(K)}, sq as (select query_id, {SQUASH.format('score')} as s, row_number() over (partition by query_id order by {SQUASH.format('score')} desc, rank) as r from bm),
ss as (select query_id, count(*) as n_hits, max(s) as top, round(greatest(0::double, max(s) - max(s) filter (where r = 2)), 4) as gap from sq group by query_id)"""
GOLD = r"""iw as (select item_id as query_id, regexp_extract_all(text, '[^\s]+') as w, least(8, len(regexp_extract_all(text, '[^\s]+'))) as n from benchmark),
ir as (select distinct query_id, n, array_to_string(w[i:i + n - 1], ' ') as run from (select query_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from iw where n > 0)),
dw as (select doc_id, regexp_extract_all(text, '[^\s]+') as w from documents),
dr as (select distinct doc_id, n, array_to_string(w[i:i + n - 1], ' ') as run from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from dw, (select distinct n from ir) where len(w) >= n)),
gold as (select query_id, doc_id from (select query_id, doc_id, count(*) as c from ir join dr using (n, run) group by all) join (select query_id, count(*) as n_runs from ir group by 1) using (query_id) where 2 * c >= n_runs)"""

SPACED = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
OUTSIDE = r"[^A-Za-zÀ-ỹĐđ0-9\s''_+]"
NORMAL = rf"trim(regexp_replace(regexp_replace({SPACED}, '{OUTSIDE}', ' ', 'g'), '\s+', ' ', 'g'))"
MATCH = rf"regexp_replace(lower({SPACED}), '{OUTSIDE}', ' ', 'g')"
KEYWORDS = rf"list_filter(list_distinct(regexp_extract_all({MATCH}, '[A-Za-zÀ-ỹĐđ0-9'']+')), lambda x: length(x) >= 2 and x not in ({COMMON}))"
PACKED = f"replace({MATCH}, ' ', '')"
TRIGRAMS = f"case when length({PACKED}) < 3 then []::varchar[] else list_distinct(list_transform(generate_series(1, length({PACKED}) - 2), lambda i: substring({PACKED}, i, 3))) end"
SHARE = "case when len({0}) > 0 then len(list_intersect({0}, {1}))::double / len({0}) else 0::double end"
TERMS = "list_filter(list_distinct(" + T + "), lambda x: length(x) > 2)"
ANSWERED = f"""{CONTENT}, an as (select query_id, max(case when rank = 1 then content end) as answer,
  coalesce(string_agg(content, ' ' order by rank) filter (where rank > 1), '') as context, count(*) as n_docs from ct where rank <= 3 group by query_id),
aq as (select an.*, text as query from an join benchmark on item_id = query_id)"""

SQL = lambda p: p.replace("'", "''")
LOW = SPACED.join(("lower(", ")"))
HINTED = " or ".join(f"contains({LOW}, '{h}')" for h in tx.COMPLEX_HINTS)
EXTRACT = " or ".join(f"regexp_matches({{0}}, '{SQL(p)}')" for p in tx.EXTRACTIVE_PATTERNS)
NAMED = f"regexp_matches({LOW}, '{SQL(tx.ENTITY_PATTERN)}') or regexp_matches({{0}}, '{SQL(tx.QUOTED_PATTERN)}') or regexp_matches({{0}}, '{SQL(tx.UPPER_PATTERN).replace('{', '{{').replace('}', '}}')}')"
COMPLEXITY = f"case when {LOW} = '' then 'normal' when {HINTED} then 'complex' when {EXTRACT.replace('{1,}', '{{1,}}').replace('{0,40}', '{{0,40}}').replace('{0,30}', '{{0,30}}')} or (len(string_split({LOW}, ' ')) <= 10 and ({NAMED.replace('{2,}', '{{2,}}')})) then 'simple_extractive' else 'normal' end"
MISMATCH = rf"""select conv_id, turn, case when b = '' then false when regexp_matches(b, '{tx.CJK}') then true when regexp_matches(lower(b), '{tx.DIACRITIC}') then false when len(f) = 0 then false
else (vi = 0 and en >= greatest(3, len(f) // 5)) or (vi < 2 and len(f) >= 8) end as mismatch from (select *, len(list_filter(f, lambda x: x in ({', '.join(f"'{w}'" for w in tx.VI_COMMON)}))) as vi, len(list_filter(f, lambda x: x in ({', '.join(f"'{w}'" for w in tx.EN_COMMON)}))) as en
from (select *, list_transform(regexp_extract_all(b, '[A-Za-zÀ-ỹĐđ0-9'']+'), lambda x: lower(x)) as f from (select conv_id, turn, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as b from conversations)))"""
GENERIC = " or ".join(f"contains(m, '{p}')" for p in tx.GENERIC_PHRASES)

EVAL = """ev as (select event_id // 2 as example_id, event_id as seq, case when event_id % 2 = 0 then 'standard' else 'advanced' end as mode,
  event_type as category, value as latency_ms, json_extract_string(props, '$.k')::double / 100 as confidence,
  user_id % 2 = 0 as retried, event_type = 'error' as abstained, value > 10 as cited from events)"""
BRANCH = EVAL + """, br as (select example_id, mode, (seq % 5)::int as citations, least(1::double, latency_ms / 100) as grounded,
  case when abstained then 'insufficient_evidence' when cited then 'answered' else 'partial' end as status,
  latency_ms < 2 as hallucination, seq % 7 = 0 as mismatch, seq % 11 = 0 as fallback, confidence from ev)"""
SCORED = BRANCH + """, sb as (select *, round(1.8::double * least(citations, 4) + 3.2::double * greatest(0::double, least(1::double, coalesce(grounded, 0)))
  + case status when 'answered' then 1.4::double when 'partial' then 0.5::double else -1.4::double end + case when hallucination then -3::double else 0.9::double end
  + case when mismatch then -1.2::double else 0.35::double end + case when fallback then -0.9::double else 0.25::double end
  - case when citations <= 0 then 0.8::double else 0::double end + 0.2::double * greatest(0::double, least(1::double, coalesce(confidence, 0))), 4) as score,
  status = 'insufficient_evidence' or citations <= 0 or hallucination or mismatch or fallback or coalesce(grounded, 0) < 0.08 as weak from br),
pr as (select s.example_id, s as s, a as a from sb s join sb a on s.example_id = a.example_id and s.mode = 'standard' and a.mode = 'advanced')"""


STORED = """st as (select doc_id % 10 as query_id, doc_id::varchar as doc_id, 's3://raw/Docs/F' || doc_id % 7 || '.' || (['md', 'txt', 'docx'])[doc_id % 3 + 1] as source, case when doc_id % 4 = 0 then 'dir/Own' || doc_id % 7 || '.MD' end as file_name,
case when doc_id % 5 = 0 then '.PDF' end as file_type, case when doc_id % 6 = 0 then 'OCR_text' else 'text' end as block_type, doc_id % 11 = 0 as ocr, case when doc_id % 8 <> 0 then '2024-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') end as uploaded_at from documents)"""
STATES = """sl as (select *, list_position(['uploaded', 'splitting', 'embedding', 'indexing', 'ready', 'failed', 'deleted'], status) as place from
(select user_id::varchar as doc_id, case event_type when 'error' then 'failed' when 'login' then 'uploaded' when 'purchase' then 'deleted' else 'ready' end as status, ts, epoch_us(ts) as updated_us from events))"""

GATE = rf"""with n as (select conv_id, turn, lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) as q from conversations), t as (select *, list_distinct({T.format('q')}) as t from n)
select conv_id, turn, case when q = '' then 'empty_query' when contains(q, 'force retrieval') or contains(q, 'force retry') then 'forced_retrieval'
when len(t) > 0 and len(list_filter(t, lambda x: x not in {tx.SMALL_TALK})) = 0 then 'small_talk' when len(t) <= 2 and list_has_any(t, {list(tx.SMALL_TALK)}) then 'small_talk_short' else 'default_retrieval' end as reason from t"""
#: A query's risk: named terms, or a word that asks for interpretation. Word ends are spelled out, as \b knows ASCII alone here.
EDGED = lambda p: p.replace(r"\b(", r"(^|[^\p{L}\p{N}_])(").replace(r")\b", r")($|[^\p{L}\p{N}_])")
HIGH_RISK = " or ".join([*(f"contains(low, '{t}')" for t in judge.HIGH_RISK_TERMS), f"regexp_matches(text, '{EDGED(judge.INTERPRETATION_PATTERN)}')"])
POLICY = rf"""with b as (select conv_id, turn, coalesce(text, '') as text, lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) as low, length(coalesce(text, '')) as n, {COMPLEXITY.format('text')} as k
  from conversations where role = 'user'), g as ({GATE}),
r as (select *, ({HIGH_RISK}) as risky, low <> '' and (len(regexp_split_to_array(low, '\s+')) <= 2 or regexp_matches(text, '{EDGED(judge.AMBIGUOUS_PATTERN)}')) as vague,
  n % 3 as cited, case when n % 4 > 0 then (n % 10)::double / 100 end as score, case when n % 5 > 0 then (n % 7) / 7.0::double end as sure from b)
select r.conv_id, r.turn, g.reason = 'default_retrieval' and (risky or k = 'complex' or vague) as gate,
  risky or cited <= 0 or coalesce(score < 0.06::double, false) or k = 'complex' or n >= 420 or coalesce(sure < 0.35::double, false) as critic,
  n % 2 = 0 and (risky or k = 'complex' or cited <= 0 or coalesce(score < 0.035::double, false)) as refine
from r join g on r.conv_id = g.conv_id and r.turn = g.turn"""


def oracle_sql() -> dict[str, str]:
    return {
        "tokenize_stats": f"with {TOKENS} select doc_id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_distinct from tok",
        "term_frequency": f"with {TOKENS} select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from tok) group by all",
        "document_frequency": f"with {TOKENS} select term, count(*) as df from (select unnest(list_distinct(t)) as term from tok) group by term",
        "bm25_idf": f"with {TOKENS}, n as (select count(*)::double as n from tok), d as (select term, count(*)::double as df from (select unnest(list_distinct(t)) as term from tok) group by term) select term, round(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)), 6) as idf from d, n",
        "corpus_stats": f"with {TOKENS} select count(*) as n_chunks, sum(len(t))::bigint as n_tokens, round(avg(len(t)), 6) as avg_tokens from tok",
        "hash_embedding": f"with {hashed('hd', 'documents', 'doc_id')} select id as doc_id, bucket::int as bucket, round(c / norm, 6) as weight from hd join hdn using (id) where c <> 0",
        "bm25_topk": f"with {bm25(K)} select query_id, rank::int as rank, doc_id, round(score, 6) as score from bm",
        "hash_dense_topk": f"with {dense(K)} select query_id, rank::int as rank, doc_id, round(score, 6) as score from dn",
        "cosine_topk": f"""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
c as (select a.vec_id as query_id, b.vec_id, case when list_inner_product(a.v, a.v) > 0 and list_inner_product(b.v, b.v) > 0 then list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) else 0::double end as score from e a join e b on a.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from c) where rank <= {K}""",
        "flat_ip_topk": f"""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
u as (select vec_id, list_transform(v, lambda x: (x / sqrt(list_inner_product(v, v)))::float::double) as v from e),
c as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) as score from u a join u b on a.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, round(score, 4) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from c) where rank <= {K}""",
        "dense_zero_norm": "select q.vec_id as query_id, r.rank::int as rank, r.vec_id, 0::double as score from embeddings q cross join (select vec_id, row_number() over (order by vec_id) as rank from embeddings) r where q.vec_id % 20 = 0 and r.rank <= 3",
        "rrf_fusion": f"with {FUSED} select query_id, rank::int as rank, doc_id, round(score, 6) as score, round(dense_score, 6) as dense_score, round(sparse_score, 6) as sparse_score from fr",
        "doc_dedupe": f"with {bm25(30)}, f as (select bm.*, source, row_number() over (partition by query_id, source order by rank) as n from bm join documents using (doc_id)) select query_id, row_number() over (partition by query_id order by rank)::int as rank, doc_id, source from f where n = 1",
        "post_filter_topk": f"with {bm25(80)}, f as (select query_id, doc_id, row_number() over (partition by query_id order by rank) as rank from bm join documents using (doc_id) where lang <> 'en') select query_id, rank::int as rank, doc_id from f where rank <= {K}",
        "active_doc_semijoin": f"with {bm25(K)} select query_id, rank::int as rank, doc_id from bm where doc_id in (select doc_id from labels where quality = 1)",
        "score_only_rerank": f"with {FUSED} select query_id, row_number() over (partition by query_id order by round(coalesce(sparse_score, 0), 9) desc, rank)::int as rank, rank::int as pre_rank, doc_id from fr where rank <= 6",
        "score_statistics": f"with {STATS} select query_id, n_hits, top, gap from ss",
        "retrieval_confidence": f"with {FUSED} select query_id, max(greatest({SQUASH.format('score')}, {SQUASH.format('coalesce(dense_score, score)')}, {SQUASH.format('coalesce(sparse_score, score)')})) as confidence from fr group by query_id",
        "context_prefix": f"with {CONTENT} select * from (select query_id, rank::int as rank, doc_id, sum(length(content)) over (partition by query_id order by rank)::bigint as chars from ct) where chars <= 4000",
        "citations": f"with {CONTENT} select query_id, rank::int as place, doc_id, substring(content, 1, 360) as snippet from ct where rank <= 5",
        "clean_text": r"""select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as text_sha256 from documents""",
        "paragraph_split": r"""select doc_id, (i - 1)::int as place, p[i] as paragraph from (select doc_id, p, unnest(generate_series(1, len(p))) as i from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as p from documents))""",
        "overlap_windows": r"""with w as (select doc_id, len(regexp_extract_all(text, '[^\s]+'))::int as n_words from documents), k as (select *, greatest(0, ceil((n_words - 320) / 280.0))::int as k from w where n_words > 0),
l as (select *, case when k > 0 and n_words - k * 280 <= 1 then k - 1 else k end as last from k) select doc_id, n_words, (unnest(generate_series(0, last)) * 280)::int as start from l""",
        "history_trim": r"select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 6 and role in ('user', 'assistant') and regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''",
        "history_render": r"""with m as (select conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') as t, row_number() over (partition by conv_id order by turn desc) as n from conversations),
k as (select *, row_number() over (partition by conv_id order by turn) as i from m where n <= 6 and role in ('user', 'assistant') and t <> ''),
h as (select conv_id, string_agg(i || '. ' || case when role = 'user' then 'User' else 'Assistant' end || ': ' || t, chr(10) order by i) as history from k group by conv_id)
select c.conv_id, coalesce(history, '(empty)') as history from (select distinct conv_id from conversations) c left join h on h.conv_id = c.conv_id""",
        "behavior_metrics": f"with {EVAL} select seq, (seq % 3 = 1) = coalesce(abstained, false) as abstain_match, seq % 4 > 1 or seq % 5 = 0 as retry_used from ev",
        "term_metrics": f"""with {ANSWERED}, k as (select query_id, query, context, {TERMS.format('answer')} as a, {TERMS.format('query')} as q, {TERMS.format('context')} as c from aq)
select query_id, case when trim(query) <> '' then len(list_intersect(a, q)) > 0 end as keyword_hit, case when context <> '' then round(case when len(a) > 0 then len(list_intersect(a, c))::double / len(a) else 0::double end, 6) end as groundedness_proxy from k""",
        "direct_and_branches": f"with {EVAL}, d as (select example_id, mode, seq from ev where seq % 3 = 0) select *, 'direct' as run from d union all select example_id, mode, seq, 'compare' as run from ev where not exists (select 1 from d where d.example_id = ev.example_id and d.mode = ev.mode)",
        "coerced_values": """with e as (select event_id, event_type, json_extract_string(props, '$.k') as k from events)
select event_id, coalesce(lower(k) in ('true', '1', 'yes', 'y'), false) as flag, coalesce(try_cast(k as double), -1) as number, greatest(0, coalesce(try_cast(k as bigint), 0)) as ms,
case when event_id % 8 > 0 then greatest(0, coalesce(round(try_cast(k as double) / (event_id % 8), 6), 0)) else 0::double end as share,
case when event_id % 2 = 0 then 'grounded' when event_type in ('no_evidence', 'weak_evidence', 'incomplete_answer', 'hallucination', 'grounded') then event_type end as category from e""",
        "keyword_overlap": f"with {ANSWERED}, k as (select query_id, {KEYWORDS.format('answer')} as a, {KEYWORDS.format('context')} as c from aq) select query_id, len(a)::int as n_keywords, round({SHARE.format('a', 'c')}, 6) as overlap from k",
        "char_trigram_precision": f"with {ANSWERED}, p as (select query_id, {PACKED.format('answer')} as a, {PACKED.format('context')} as c from aq), g as (select query_id, case when length(a) < 3 then []::varchar[] else list_distinct(list_transform(generate_series(1, length(a) - 2), lambda i: substring(a, i, 3))) end as a, c from p) select query_id, round(case when len(a) > 0 then len(list_filter(a, lambda x: contains(c, x)))::double / len(a) else 0::double end, 6) as precision from g",
        "retrieval_gate": GATE,
        "policy_decisions": POLICY,
        "language_detect": rf"""with n as (select conv_id, turn, lower({NORMAL.format('text')}) as q from conversations)
select conv_id, turn, case when q <> '' and (regexp_matches(q, '{tx.DIACRITIC}') or {' or '.join(f"contains(' ' || q, '{m}')" for m in tx.VI_MARKERS)} or len(list_filter(regexp_extract_all(q, '[A-Za-zÀ-ỹĐđ0-9'']+'), lambda x: x in ({', '.join(f"'{w}'" for w in tx.VI_COMMON)}))) >= 2) then 'vi' else 'en' end as language from n""",
        "critique_heuristic": f"""with {ANSWERED}, t as (select *, {TERMS.format('query')} as q, {TERMS.format('answer')} as a, {TERMS.format('context')} as c, lower(context) as body from aq),
m as (select *, list_sort(list_filter(list_intersect(q, c), lambda x: not list_contains(a, x)))[1:5] as miss, {SHARE.format('q', 'c')} as qc, {SHARE.format('a', 'c')} as ac from t),
k as (select *, case when qc <= 0 then 'no_evidence' when ac < 0.02 then 'hallucination' when ac < 0.12 then 'weak_evidence' when len(miss) > 0 then 'incomplete_answer' else 'grounded' end as category,
n_docs > 1 and ((contains(body, 'however') and contains(body, 'therefore')) or contains(body, 'conflict')) as conflict from m)
select query_id, category, array_to_string(miss, ',') as missing, conflict, category = 'no_evidence' as should_retry, category in ('weak_evidence', 'incomplete_answer', 'hallucination') as should_refine,
case category when 'grounded' then case when conflict then 0.65::double else 0.82::double end when 'incomplete_answer' then 0.62::double when 'weak_evidence' then 0.42::double when 'hallucination' then 0.28::double else 0.35::double end as confidence from k""",
        "dedupe_rewrites": r"""with r as (select conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') as r from conversations), f as (select *, row_number() over (partition by conv_id, lower(r) order by turn) as n from r where r <> ''),
p as (select conv_id, r, row_number() over (partition by conv_id order by turn) - 1 as place from f where n = 1) select conv_id, place::int as place, r as rewrite from p where place < 4""",
        "query_complexity": f"select conv_id, turn, {COMPLEXITY.format('text')} as complexity from conversations where role = 'user'",
        "query_budget": f"""with c as (select conv_id, turn, {COMPLEXITY.format('text')} as k from conversations where role = 'user')
select conv_id, turn, case k when 'simple_extractive' then 3 when 'normal' then 5 else 8 end as hybrid_top_k, case k when 'simple_extractive' then 3 when 'normal' then 5 else 6 end as rerank_top_k, case k when 'simple_extractive' then 2 when 'normal' then 3 else 4 end as context_top_k,
case k when 'simple_extractive' then 1600 when 'normal' then 3000 else 4000 end as context_max_chars, case k when 'simple_extractive' then 384 when 'normal' then 768 else 1536 end as max_tokens from c""",
        "rerank_policy": f"""with {STATS}, p as (select item_id as query_id, coalesce(n_hits, 0) as n, top, gap, {COMPLEXITY.format('text')} as k from benchmark left join ss on ss.query_id = item_id)
select query_id, case when n = 0 then 'skipped/no_candidates' when k = 'simple_extractive' then 'score_only/simple_extractive_skip' when n < 4 then 'score_only/few_candidates_skip' when top >= 0.75 and gap >= 0.2 then 'score_only/high_confidence_clear_gap_skip'
when k in ('normal', 'complex') and (gap is null or gap < 0.2) then 'cross_encoder/ambiguous_scores_use_cross_encoder' else 'score_only/score_only_default' end as policy from p""",
        "language_mismatch": MISMATCH,
        "grounding_class": f"""with {ANSWERED}, k as (select query_id, n_docs, query_id % 2 as cited, {MATCH.format('answer')} as m, {KEYWORDS.format('answer')} as a, {KEYWORDS.format('context')} as c, {PACKED.format('answer')} as pa, {PACKED.format('context')} as pc from aq),
g as (select *, case when length(pa) < 3 then []::varchar[] else list_distinct(list_transform(generate_series(1, length(pa) - 2), lambda i: substring(pa, i, 3))) end as r from k),
t as (select *, round(case when len(r) > 0 then len(list_filter(r, lambda x: contains(pc, x)))::double / len(r) else 0::double end, 4) as runs from g),
v as (select *, round(case when len(a) > 0 then 0.8::double * {SHARE.format('a', 'c')} + 0.2::double * runs else runs end, 4) as s from t)
select query_id, case when cited > 0 then case when s >= 0.12 then 'strong_overlap_with_citations/false' when s >= 0.02 then 'weak_overlap_with_citations/false' when s >= 0.005 then 'very_low_overlap_with_citations/false' else 'almost_no_overlap_even_with_citations/true' end
when m = '' or {GENERIC} or len(a) <= 2 then 'generic_answer_without_citations/true' when s >= 0.12 then 'strong_overlap_without_citations/false' when s >= 0.04 then 'weak_overlap_without_citations/false' else 'low_overlap_without_citations/true' end as grounding from v""",
        "extractive_answer": r"""with l as (select doc_id, doc_id % 50 as n, coalesce(source, 'x') as s, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ls from documents),
b as (select *, regexp_replace(substring(array_to_string(ls, ' '), 1, 900), '^\s+|\s+$', '', 'g') as body from l)
select doc_id, case when doc_id % 3 = 0 then 'title_article_match' when doc_id % 3 = 1 and body <> '' then 'article_content_match' else 'not_simple_query' end as reason,
case when doc_id % 3 = 0 then 'Tên của Điều ' || n || ' là: ' || s || '.' when doc_id % 3 = 1 and body <> '' then 'Điều ' || n || ' quy định:' || chr(10) || body end as answer from b""",
        "gold_selector_metrics": f"""with {bm25(K)}, {GOLD}, g as (select query_id, count(*) as n_gold from gold group by 1), r as (select query_id, count(*) as n_ranked from bm group by 1),
f as (select query_id, min(rank) as first, sum(1 / log2(rank + 1)) as dcg from bm join gold using (query_id, doc_id) group by 1)
select query_id, n_gold, coalesce(n_ranked, 0) as n_ranked, first is not null as hit, round(coalesce(1::double / first, 0), 6) as mrr, round(coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, greatest(1, least(n_gold, n_ranked))), lambda i: 1 / log2(i + 1))), 6) as ndcg from g left join r using (query_id) left join f using (query_id)""",
        "ocr_decision": rf"""with b as (select doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as b, doc_id % 2 as images from documents), t as (select *, {T.format('b')} as t, length(regexp_replace(b, '[^\p{{L}}\p{{N}}]', '', 'g')) as an from b)
select doc_id, case when length(b) < 100 then 'short_text' when contains(b, chr(65533)) then 'replacement_characters' when images > 0 and len(t) <= 6 then 'few_tokens_with_images' when images > 0 and an::double / length(b) < 0.45 then 'low_alnum_with_images'
when len(t) >= 12 and len(list_distinct(t))::double / len(t) < 0.25 then 'repetitive' else 'none' end as decision from t""",
        "retrieval_metrics": f"""with {bm25(K)}, {GOLD}, g as (select query_id, count(*) as n_gold from gold group by 1), r as (select query_id, count(*) as n_ranked from bm group by 1),
f as (select query_id, min(rank) as first, sum(1 / log2(rank + 1)) as dcg from bm join gold using (query_id, doc_id) group by 1),
z as (select item_id as query_id, coalesce(n_gold, 0) as n_gold, coalesce(n_ranked, 0) as n_ranked, first, dcg from benchmark left join g on g.query_id = item_id left join r on r.query_id = item_id left join f on f.query_id = item_id)
select query_id, n_gold, n_ranked, case when n_gold > 0 then first is not null end as hit, case when n_gold > 0 then round(coalesce(1::double / first, 0), 6) end as mrr,
case when n_gold > 0 then round(coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, greatest(1, least(n_gold, n_ranked))), lambda i: 1 / log2(i + 1))), 6) end as ndcg from z""",
        "citation_gold_overlap": f"with {bm25(5)}, {GOLD} select query_id, round(count(bm.doc_id)::double / count(*), 6) as overlap from gold left join bm using (query_id, doc_id) group by query_id",
        "eval_category_summary": f"with {EVAL} select mode, category, count(*) as n, round(avg(latency_ms), 6) as avg_latency_ms, round(avg(confidence), 6) as avg_confidence, round(avg(retried::int), 6) as retried_rate, round(avg(abstained::int), 6) as abstained_rate, round(avg(cited::int), 6) as cited_rate from ev group by mode, category",
        "paired_delta": f"with {EVAL} select count(*) as n_pairs, round(avg(a.latency_ms - s.latency_ms), 6) as latency_delta, round(avg(a.confidence - s.confidence), 6) as confidence_delta from ev s join ev a on s.example_id = a.example_id and s.mode = 'standard' and a.mode = 'advanced'",
        "latency_percentiles_overall": """with e as (select user_id::varchar as "user", value from events union all select 'overall', value from events)
select "user", count(value) as n, round(quantile_cont(value, 0.5), 2) as p50, round(quantile_cont(value, 0.9), 2) as p90, round(quantile_cont(value, 0.95), 2) as p95, round(max(value), 2) as max from e group by 1""",
        "captured_predictions": """select event_id, case when event_id % 7 = 0 then '' else event_type end as answer, case when event_id % 7 > 0 then round(1::double / (event_id % 7), 6) end as confidence,
case when event_id % 7 = 0 then 'error' else 'answered' end as status, case when event_id % 7 = 0 then 'ZeroDivisionError: division by zero' end as error, case when event_id % 7 = 0 then 'evaluation_error' else 'done' end as stop_reason from events""",
        "semantic_blend": f"""with {bm25(6)}, {dense(10)}, s as (select query_id, round(least(1::double, greatest(0::double, max(cs.score))), 4) as semantic from bm join cs using (query_id, doc_id) group by query_id)
select query_id, semantic, case when semantic >= 0.58 then round(greatest(0.1::double, least(1::double, 0.65::double * 0.1::double + 0.35::double * semantic)), 4) else 0.1::double end as grounded from s""",
        "composed_text": """select doc_id, sha256(nfc_normalize(replace(replace(replace(text, 'a', 'a' || chr(770) || chr(803)), 'o', 'o' || chr(795)), 'd', 'd' || chr(803)))) as text_sha256 from documents""",
        "progress_of_runs": """select conv_id::varchar as run_id, 'done' as status, count(*) + 2 as events, coalesce(string_agg(role, ',' order by turn) filter (where role <> 'assistant'), '') as stages,
count(*) filter (where role = 'assistant') as deltas, sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as answer_sha256 from conversations group by conv_id""",
        "latency_percentiles": "select event_type, count(value) as n, round(quantile_cont(value, 0.5), 2) as p50, round(quantile_cont(value, 0.9), 2) as p90, round(quantile_cont(value, 0.95), 2) as p95, round(max(value), 2) as max from events group by event_type",
        "advanced_status": f"with {BRANCH} select example_id, case when mismatch then 'insufficient_evidence' when grounded >= 0.12 then 'answered' when grounded >= 0.02 or (citations > 0 and not hallucination) then 'partial' else 'insufficient_evidence' end as status from br where mode = 'advanced'",
        "compare_verdict": f"""with {SCORED} select example_id, s.score as standard_score, a.score as advanced_score,
case when s.status = 'insufficient_evidence' and a.status <> 'insufficient_evidence' and a.citations > 0 then 'advanced' when a.status = 'insufficient_evidence' and s.status <> 'insufficient_evidence' and s.citations > 0 then 'standard'
when s.hallucination and not a.hallucination then 'advanced' when a.hallucination and not s.hallucination then 'standard' when s.weak and a.weak then 'both_weak'
when a.citations <= 0 and a.score > s.score and s.citations > 0 then 'standard' when abs(a.score - s.score) <= 0.35 then 'tie' when a.score > s.score then 'advanced' else 'standard' end as winner from pr""",
        "metadata_filters": f"""with {STORED}, d as (select *, case when file_name is not null then lower(split_part(file_name, '/', -1)) else lower(split_part(source, '/', -1)) end as name from st),
k as (select *, case when file_type is not null then 'pdf' else split_part(name, '.', -1) end as kind, block_type = 'OCR_text' or ocr as is_ocr from d)
select query_id, doc_id from k where case query_id when 0 then doc_id in ('10', '20') when 1 then name in ('f1.txt', 'f5.md') when 2 then kind in ('md', 'txt')
when 3 then coalesce(uploaded_at between '2024-01-10' and '2024-01-20', false) when 4 then is_ocr when 5 then not is_ocr
when 6 then name in ('own6.md', 'f6.md', 'f6.txt') and kind in ('md', 'pdf') and uploaded_at is not null and not is_ocr else true end""",
        "scope_guard": "select doc_id % 10 as query_id, doc_id::varchar as doc_id from documents where doc_id % 10 >= 7",
        "document_registry": f"""with {STATES}, r as (select doc_id, arg_max(status, (updated_us, place)) as status, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as created_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as updated_at from sl group by doc_id)
select doc_id, case when status = 'ready' and doc_id::int % 3 = 0 then 'failed' else status end as status, case when status = 'ready' and doc_id::int % 3 = 0 then true when status = 'failed' then false end as file_gone, created_at, updated_at from r where status <> 'deleted'""",
        "ready_documents": f"with {STATES} select doc_id from sl group by doc_id having arg_max(status, (updated_us, place)) = 'ready' and doc_id::int % 3 <> 0",
        "block_counts": """select conv_id as doc_id, count(*) as total_blocks, count(*) filter (turn % 4 = 0) as text_blocks, count(*) filter (turn % 4 = 1) as table_blocks, count(*) filter (turn % 4 = 2) as image_blocks,
count(*) filter (turn % 4 = 3 or turn % 5 = 0) as ocr_blocks from conversations group by conv_id""",
        "trace_rankings": """with d as (select conv_id as run_id, turn // 3 as step_no, case when turn // 3 % 2 = 0 then 'retrieve' else 'rerank' end as kind, turn % 3 as doc_no, case when turn % 4 <> 3 then 'D' || turn % 5 || '_chunk_0' else '' end as chunk_id,
case when turn % 4 <> 3 then 'D' || turn % 5 else '' end as doc_id, 'a//S' || turn % 2 || '.md' as path, case when turn % 5 <> 0 then length(text) % 10 end as ds, case when turn % 5 <> 1 then length(text) % 3 end as ss from conversations),
m as (select *, max(step_no) filter (kind = 'retrieve') over (partition by run_id) as l, max(step_no) filter (kind = 'rerank') over (partition by run_id) as r from d),
e as (select *, 'dense' as strategy, -ds as s from m where kind = 'retrieve' and step_no = l and ds is not null union all select *, 'bm25', -ss from m where kind = 'retrieve' and step_no = l and ss is not null
union all select *, 'hybrid', 0 from m where l is null or (kind = 'retrieve' and step_no = l) union all select *, 'hybrid_rerank', 0 from m where kind = 'rerank' and step_no = r),
f as (select *, row_number() over (partition by run_id, strategy, case when chunk_id <> '' then chunk_id else path end order by s, step_no, doc_no) as n from e)
select run_id, strategy, row_number() over (partition by run_id, strategy order by s, step_no, doc_no)::int as rank, chunk_id, doc_id, path from f where n = 1""",
        "strategy_summary": "select event_type as strategy, count(*) as n, round(avg((value > 10)::int::double), 6) as hit_rate, round(avg(1 / (1 + user_id % 4)::double), 6) as avg_mrr, round(avg(case when event_id % 3 > 0 then event_id % 8 / 8.0::double else 0 end), 6) as avg_ndcg from events group by event_type",
        "semantic_policy": """with e as (select event_id, (['standard', 'advanced', 'compare'])[event_id % 3 + 1] as m, (['simple', 'normal', 'complex', 'normal'])[event_id // 3 % 4 + 1] as c, event_id % 50 / 500.0::double as x, case when event_id % 4 > 0 then user_id % 10 / 10.0::double end as f,
case when event_id % 6 > 0 then event_id % 101 / 100.0::double end as y from events),
r as (select *, concat_ws(',', case when event_id % 3 <= 0 then 'no_citations' end, case when event_id % 7 * 60 >= 320 then 'long_answer' end, case when f < 0.35 then 'low_retrieval_confidence' end, case when x < 0.04 then 'low_lexical_score' end) as k from e),
p as (select *, case when event_id % 13 = 0 then 'fast_path_lexical_only' when m = 'standard' and c = 'simple' then 'standard_simple_lexical_only' when m = 'standard' and c = 'complex' then 'standard_complex_semantic_allowed'
when m = 'standard' and k <> '' then 'standard_normal_risky:' || k when m = 'standard' then 'standard_normal_lexical_ok' when m = 'compare' then 'compare_semantic_allowed' else 'advanced_semantic_disabled' end as reason from r)
select event_id, contains(reason, 'allowed') or contains(reason, 'risky') as use, reason, round(case when y >= 0.58 then greatest(x, least(1, 0.65::double * x + 0.35::double * y)) else x end, 4) as score from p""",
        "reply_fields": """with e as (select *, case when event_type <> 'error' then event_type end as t, trim(regexp_replace(repeat(' ' || props || chr(10) || chr(9), (event_id % 40)::int) || event_id, '\\s+', ' ', 'g')) as m from events)
select event_id, 'Q: $kind ' || event_id || ' (' || coalesce(t, '') || ') costs $5, $other$' as prompt, substring(sha256(event_id || '|' || coalesce(t, 'None')), 1, 24) as key,
case when length(m) <= 240 then m else substring(m, 1, 237) || '...' end as error, case event_id % 3 when 0 then event_id % 90 when 1 then 7 else -1 end as latency_ms from e""",
        "citation_lines": """select doc_id, '[' || (doc_id % 5 + 1) || '] ' || coalesce(case when doc_id % 2 = 0 then nullif(lang, '') end, 'Untitled') || ' | source=' || coalesce(source, 'None') || ' | doc_id=' || doc_id || ' | chunk_id=' || doc_id || '_chunk_0'
|| case when doc_id % 4 = 0 then ' | section=S' else '' end || case when doc_id % 6 = 0 then ' | page=' || doc_id else '' end as line from documents""",
        "display_names": "select doc_id, case when doc_id % 3 = 1 then 'a_b.md' else substring(sha256(doc_id::varchar), 1, (doc_id % 3 + 9)::int) || '_a_b.md' end as name from documents",
    }
