"""SQL (DuckDB) that must give the same rows as the registered queries."""

from __future__ import annotations

from ..functions import text as T
from ..operators import evaluation, routing

_WS = r"[\s\x{a0}]"


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _all(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {_q(pattern)}, {group})"


def _tokens(x: str) -> str:
    return _all(f"lower({x})", T.TOKEN)


def _terms(x: str, also: list[str] | None = None) -> str:
    return f"list_distinct(list_filter({_all(f'lower({x})', T.TERM)}, lambda t: length(t) > 2 and not list_contains({_list([*T.STOPWORDS, *(also or [])])}, t)))"


EX = """
ex as (select * exclude (n) from (select *, row_number() over (partition by example_id order by loaded_at desc nulls last) n from examples where example_id is not null) where n = 1)
"""

CK = f"""{EX},
pre as (select example_id, document_id, coalesce(pre_text, []) as pre, coalesce(table_rows, []) as t, coalesce(post_text, []) as post from ex),
ck as (
  select example_id || '::' || section || '::' || number as chunk_id, *, chunk_type || '_' || number as source_id from (
    select example_id, document_id, i as pos, 'text' as chunk_type, 'pre_text' as section, {_strip("coalesce(pre[i + 1], '')")} as content, i as number, i as row_index, i as text_index, false as ragged
      from (select *, unnest(range(len(pre))) as i from pre) where {_strip("coalesce(pre[i + 1], '')")} <> ''
    union all
    select example_id, document_id, len(pre) + i, 'table', 'table',
      'table row. ' || array_to_string(list_transform(range(least(len(t[1]), len(t[i + 2]))), lambda j: coalesce(t[1][j + 1], '') || ': ' || coalesce(t[i + 2][j + 1], '')), '; '), i + 1, i + 1, null, len(t[i + 2]) < len(t[1])
      from (select *, unnest(range(greatest(len(t) - 1, 0))) as i from pre)
    union all
    select example_id, document_id, len(pre) + len(t) + i, 'text', 'post_text', {_strip("coalesce(post[i + 1], '')")}, len(pre) + i, i, len(pre) + i, false
      from (select *, unnest(range(len(post))) as i from pre) where {_strip("coalesce(post[i + 1], '')")} <> ''))
"""

TF = f"""
tok as (select example_id, pos, {_tokens('content')} as tokens from ck),
tf as (select example_id, pos, term, count(*) as tf, any_value(dl) as dl from (select example_id, pos, len(tokens) as dl, unnest(tokens) as term from tok) group by all)
"""


def _bm25(scope: bool) -> str:
    by = "example_id, " if scope else ""
    on = "using (example_id)" if scope else "on true"
    group = "group by example_id" if scope else ""
    join = "e.example_id = c.example_id" if scope else "true"
    same = "a.example_id = t.example_id and " if scope else ""
    return f"""{TF},
st as (select {by}count(*) as n, avg(len(tokens)) as avgdl from tok {group}),
df as (select {by}term, count(*) as df from tf group by all),
pl as (select df.*, st.avgdl, ln(n - df + 0.5) - ln(df + 0.5) as p from df join st {on}),
mn as (select {by}avg(p) as m from pl {group}),
idf as (select pl.*, case when p < 0 then 0.25 * m else p end as idf from pl join mn {on}),
asked as (select example_id as query_id, example_id, term, count(*) as qf from (select example_id, unnest({_tokens('question')}) as term from ex) group by all),
hit as (select a.query_id, p.example_id, p.pos, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / t.avgdl))) as score
  from asked a join idf t on {same} a.term = t.term join tf p on p.term = t.term {'and p.example_id = t.example_id' if scope else ''} group by all),
bmall as (select e.example_id as query_id, c.example_id, c.pos, coalesce(h.score, 0) as score from ex e join ck c on {join} left join hit h on h.query_id = e.example_id and h.example_id = c.example_id and h.pos = c.pos),
bm as (select *, row_number() over (partition by query_id order by round(score, 9) desc, example_id, pos) as rank from bmall)
"""


BM = _bm25(True)

_BUCKETS = f"list_transform({_tokens('x')}, lambda t: (('0x' || substr(md5(t), 1, 4))::int % 64))"
_VECTORS = f"""
cv as (select example_id, pos, list_transform(range(64), lambda i: len(list_filter(b, lambda y: y = i))::double) as v from (select example_id, pos, {_BUCKETS.replace("lower(x)", "lower(content)")} as b from ck)),
qv as (select example_id, list_transform(range(64), lambda i: len(list_filter(b, lambda y: y = i))::double) as v from (select example_id, {_BUCKETS.replace("lower(x)", "lower(coalesce(question, ''))")} as b from ex))
"""


def _dense(scope: bool) -> str:
    return f"""{_VECTORS},
deall as (select q.example_id as query_id, c.example_id, c.pos, case when list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v) = 0 then 0 else list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) end as score
  from qv q join cv c {'using (example_id)' if scope else 'on true'}),
de as (select *, row_number() over (partition by query_id order by round(score, 9) desc, example_id, pos) as rank from deall)
"""


DE = _dense(True)

_SHOW = "query_id, rank, round(score, 6) as score, example_id, pos"

_RRF = """
fu as (select query_id, example_id, pos, sum(1.0 / (60 + rank)) as score, min(no * 1000 + rank) as f from (select 0 as no, * from de where rank <= 10 union all by name select 1 as no, * from bm where rank <= 10) group by all)
"""


def _vectors(metric: str, scoped: bool) -> str:
    score = {"cosine": "list_cosine_similarity(a.embedding::double[], b.embedding::double[])", "l2": "list_distance(a.embedding::double[], b.embedding::double[]) ** 2"}[metric]
    order = "desc" if metric == "cosine" else "asc"
    return f"""with s as (select a.vec_id::varchar as query_id, b.label::varchar as example_id, b.vec_id as pos, {score} as score from embeddings a join embeddings b on {'a.label = b.label' if scoped else 'true'}),
  r as (select *, row_number() over (partition by query_id order by round(score, 9) {order}, example_id, pos) as rank from s) select {_SHOW} from r where rank <= 10"""


_HAS = {
    "out_of_scope": f"len(list_filter({_list(routing.OUT_OF_SCOPE)}, lambda p: contains(lower(question), p))) > 0",
    "calculation": f"(list_has_any({_all('lower(question)', '[a-z]+')}, {_list(routing.CALCULATION_TERMS)}) or regexp_matches(lower(question), {_q(routing.ARITHMETIC.replace('(?d)', ''))}))",
    "table_metric": f"list_has_any({_all('lower(question)', '[a-z]+')}, {_list(routing.TABLE_TERMS)})",
    "exact_term": f"""(regexp_matches(question, {_q(T.YEAR)}) or regexp_matches(question, '[''"].+[''"]') or regexp_matches(question, '\\b[A-Z]{{2,5}}\\b'))""",
    "number": r"regexp_matches(question, '\d')",
}
SIG = "sg as (select example_id, question, list_filter([" + ", ".join(f"case when {t} then '{n}' end" for n, t in _HAS.items()) + "], lambda x: x is not null) as signals from ex)"

_NUMERIC = "(list_contains(signals, 'calculation') or list_contains(signals, 'table_metric'))"


def _numbers(x: str) -> str:
    return _all(f"replace({x}, '$', '')", T.NUMBER)


def _features(results: str) -> str:
    """Features of results (query_id, rank, score, example_id, pos)."""
    return f"""
qf as (select example_id as query_id, signals, {_terms('question')} as qt, {_all('question', T.YEAR)} as qy, {_numbers('question')} as qn from sg),
rs as (select *, count(*) filter (where rank <= 20) over (partition by query_id) as heads, count(*) filter (where rank <= 20) over (partition by query_id, example_id) as own from ({results})),
fe as (select b.query_id, b.example_id, b.pos, b.rank, b.score,
    case when len(qt) = 0 or len({_terms('content')}) = 0 then 0 else len(list_intersect(qt, {_terms('content')})) / len(list_distinct(list_concat(qt, {_terms('content')}))) end as term_overlap,
    case when len(qy) = 0 or list_has_any(qy, {_all('content', T.YEAR)}) then 1.0 else 0.0 end::double as year_support,
    case when list_has_any(qn, {_numbers('lower(content)')}) then 1.0 else 0.0 end::double as number_support,
    case when chunk_type = 'table' and {_NUMERIC} then 1.0 else 0.0 end::double as table_bonus,
    len(list_intersect(list_distinct({_tokens("array_to_string(qt, ' ')")}), list_distinct({_tokens('content')})))::int as exact_tokens,
    case when heads > 0 then own / heads else 0 end::double as cohesion
  from rs b join qf using (query_id) join ck using (example_id, pos)),
rr as (select *, 1.0 / greatest(rank, 1) * 0.30 + case when score <= 0 then 0 else least(score, 1) end * 0.15 + term_overlap * 0.25 + year_support * 0.10 + number_support * 0.05 + table_bonus * 0.05 + least(exact_tokens / 5, 1.0) * 0.05 + cohesion * 0.05 as rr_score from fe)
"""


_FE = _features("select * from bm where rank <= 10")

# fixed values: signals of a grade with their weights, and texts
_SIGNALS = [("metric_overlap", 25), ("year_support", 20), ("numeric_support", 20), ("table_support", 15), ("document_cohesion", 15), ("ranked_evidence", 5)]
_REASON = "case when not sufficient then case when not found then 'No chunks were retrieved.' when len(missing) = 0 then 'Evidence confidence was below the sufficiency threshold.' else 'Missing or weak: ' || array_to_string(missing, ', ') || '.' end end"


def _grades(results: str) -> str:
    """Grades of results; terms, years and chunks are those of the report with most of the first five results."""
    yes = {
        "metric_overlap": "list_has_any(qt, et)", "year_support": "(len(qy) = 0 or list_has_any(qy, ey))", "numeric_support": f"(not {_NUMERIC} or hn)", "table_support": f"(not {_NUMERIC} or ht)",
        "document_cohesion": "(heads >= 2 or all_heads = 1)", "ranked_evidence": "top <> 0",
    }
    points = " + ".join(f"case when {yes[n]} then {w} else 0 end" for n, w in _SIGNALS)
    pick = lambda test, names: "list_filter([" + ", ".join(f"case when {test}({yes[n]}) then '{n}' end" for n, _ in names) + "], lambda x: x is not null)"
    return f"""
each as (select r.query_id, r.example_id, flatten(list({_terms('content', T.DOMAIN_STOPWORDS)})) as et, flatten(list({_all('content', T.YEAR)})) as ey, bool_or(regexp_matches(content, '\\d')) as hn, bool_or(chunk_type = 'table') as ht,
    count(*) filter (where rank <= 5) as heads, min(rank) as first from ({results}) r join ck using (example_id, pos) group by r.query_id, r.example_id),
best as (select *, row_number() over (partition by query_id order by heads desc, first) as n, sum(heads) over (partition by query_id) as all_heads from each),
ev as (select * from best join (select query_id, arg_min(score, rank) as top from ({results}) group by query_id) using (query_id) where n = 1),
gq as (select example_id as query_id, signals, {_terms('question', T.DOMAIN_STOPWORDS)} as qt, {_all('question', T.YEAR)} as qy from sg),
gp as (select query_id, ev.query_id is not null as found, {_NUMERIC} as numeric, case when ev.query_id is null then 0 else {points} end as points,
    case when ev.query_id is null then [] else {pick('', _SIGNALS)} end as matched, case when ev.query_id is null then ['retrieved_evidence'] else {pick('not ', _SIGNALS[:-1])} end as missing
  from gq left join ev using (query_id)),
gr as (select *, found and points >= 65 and not (numeric and list_contains(missing, 'numeric_support')) as sufficient from gp)
"""


PR = "pr as (select * exclude (n) from (select *, row_number() over (partition by prediction_id order by loaded_at desc nulls last) n from predictions where prediction_id is not null) where n = 1)"

_NORM = lambda x: f"regexp_replace(regexp_replace({_strip(f'lower({x})')}, '[,$%]', '', 'g'), '{_WS}+', ' ', 'g')"
_NUMS = lambda x: f"list_transform({_all(x, T.PLAIN_NUMBER)}, lambda t: replace(t, ',', '')::double)"

_MATCH = f"""{PR}, {EX},
am as (select p.*, try_cast(e.metadata.gold_numeric_answer as double) as num, e.metadata.gold_numeric_answer as numeric from pr p left join ex e using (example_id))
"""

_METRICS = """
gold as (select example_id as query_id, example_id || '::' || unnest(map_keys(gold_evidence)) as gold_id from ex),
found as (select r.query_id, min(rank) as rank, c.example_id || '::' || c.source_id as gold_id from bm r join ck c using (example_id, pos) where rank <= 10 group by all),
per as (select query_id, count(*) as n, min(rank) as best, count(*) filter (where rank <= 1) as h1, count(*) filter (where rank <= 3) as h3, count(*) filter (where rank <= 5) as h5, count(*) filter (where rank <= 10) as h10 from gold left join found using (query_id, gold_id) group by query_id),
me as (select e.example_id as query_id, coalesce(1.0 / best, 0) as reciprocal_rank, """ + ", ".join(f"coalesce((h{k} > 0)::int, 0)::double as hit_{k}, coalesce(h{k} / n, 0)::double as recall_{k}" for k in evaluation.CUTOFFS) + """ from ex e left join per on per.query_id = e.example_id)
"""

_FAIL = f"""{PR}, {CK},
go as (select example_id, list_sort(coalesce(map_keys(gold_evidence), [])) as gold_ids from ex),
pg as (select p.*, gold_ids from pr p join go using (example_id)),
fg as (select prediction_id, list_sort(list(distinct c.source_id)) as got from (select prediction_id, example_id, gold_ids, unnest(retrieved_chunk_ids) as chunk_id from pg) u join ck c on c.chunk_id = u.chunk_id and c.example_id = u.example_id and list_contains(u.gold_ids, c.source_id) group by prediction_id),
fl as (select pg.*, coalesce(got, []) as retrieved_gold_ids, list_filter(gold_ids, lambda g: not list_contains(coalesce(got, []), g)) as missing_gold_ids,
  case when coalesce(error, '') <> '' then 'pipeline_error' when coalesce(exact_match, false) or coalesce(numerical_match, false) then 'correct' when not coalesce(citation_valid, false) then 'citation_issue'
    when len(coalesce(got, [])) = 0 then 'retrieval_failure' when len(coalesce(got, [])) < len(gold_ids) then 'partial_retrieval'
    when coalesce(insufficient_evidence, false) or lower(coalesce(predicted_answer, '')) in ('', 'none', 'insufficient evidence') then 'over_abstention' else 'calculation_or_generation_error' end as failure_category
  from pg left join fg using (prediction_id))
"""

_CELL = r"regexp_replace(lower(regexp_replace(cell, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), '[$,%]', '', 'g')"
_PARSE = f"try_cast(regexp_extract(case when {_CELL} like '(%)' then '-' || substr({_CELL}, 2, length({_CELL}) - 2) else {_CELL} end, '-?\\d+(?:\\.\\d+)?') as double)"
_SHOWN = "case when rtrim(rtrim(printf('%.5f', v), '0'), '.') = '-0' then '0' else rtrim(rtrim(printf('%.5f', v), '0'), '.') end"


def _route() -> str:
    r = routing.REASONS
    case = lambda scope, num, exact, other: f"case when list_contains(signals, 'out_of_scope') then {scope} when {_NUMERIC} then {num} when list_contains(signals, 'exact_term') then {exact} else {other} end"
    return f"""with {EX}, {SIG} select example_id as query_id, not list_contains(signals, 'out_of_scope') as related, {case("'dense'", "'dense'", "'hybrid'", "'dense'")} as method,
  {case(0, 10, 10, 10)} as top_k, {case(0, 30, 30, 30)} as candidate_k, {case(0, 1, 0, 0)} as window, {case(*(_q(r[k]) for k in ('out_of_scope', 'calculation', 'exact_term', 'default')))} as reason from sg"""


_REWRITE = f"""with {EX},
parts as (select example_id, question, list_concat(list_transform({_all('question', T.QUOTED, 1)}, lambda t: {_strip('t')}), {_all('question', T.YEAR)}, {_all('question', T.MENTION)},
    list_filter(list_transform(list_filter({_all('lower(question)', T.REWRITE_TERM)}, lambda t: not list_contains({_list(T.REWRITE_STOPWORDS)}, t)), lambda t: trim(t, '.-')), lambda t: length(t) > 2)) as p from ex),
each as (select example_id, i, p[i] as t from (select example_id, p, unnest(range(1, len(p) + 1)) as i from parts) where trim(p[i]) <> ''),
one as (select example_id, lower(t) as l, min(i) as i, arg_min(t, i) as t from each group by all)
select parts.example_id as query_id, coalesce(string_agg(one.t, ' ' order by one.i), {_strip('any_value(question)')}) as query from parts left join one using (example_id) group by parts.example_id"""


_RT = f"""
rt as (select example_id as query_id, case when list_contains(signals, 'out_of_scope') then 'none' when {_NUMERIC} then 'near' when list_contains(signals, 'exact_term') then 'both' else 'dense' end as m from sg),
fu30 as (select query_id, example_id, pos, sum(1.0 / (60 + rank)) as score, min(no * 1000 + rank) as f from (select 0 as no, * from de where rank <= 30 union all by name select 1 as no, * from bm where rank <= 30) group by all),
hy as (select query_id, example_id, pos, score, row_number() over (partition by query_id order by round(score, 12) desc, f) as rank from fu30)
"""


def _found(method: str, rerank: bool) -> str:
    """Results (query_id, rank, score, example_id, pos) of a method, ten of thirty candidates; neighbours beside them where the route asks."""
    k = 30 if rerank else 10
    of = lambda table: f"select query_id, rank, score, example_id, pos from {table} where rank <= {k}"
    seeds = {"dense": of("de"), "bm25": of("bm"), "hybrid": of("hy"), "adaptive": f"{of('de')} and query_id in (select query_id from rt where m in ('near', 'dense')) union all by name {of('hy')} and query_id in (select query_id from rt where m = 'both')"}[method]
    if rerank:
        seeds = f"""with se as ({seeds}), {_features('select * from se')} select query_id, r as rank, rr_score as score, example_id, pos from (select *, row_number() over (partition by query_id order by round(rr_score, 9) desc, rank) as r from rr) where r <= 10"""
    if method != "adaptive":
        return seeds
    return f"""with sd as ({seeds}), al as (select query_id, example_id, pos, 0 as late, rank as seed, 0 as shift, score from sd union all
    select s.query_id, c.example_id, c.pos, 1, s.rank, d, s.score from sd s join rt on rt.query_id = s.query_id and m = 'near' join ck o on o.example_id = s.example_id and o.pos = s.pos join (values (-1), (1)) w(d) on true
      join ck c on c.example_id = s.example_id and c.section = o.section and c.row_index = o.row_index + d),
  fi as (select query_id, example_id, pos, arg_min(score, late * 1000000 + seed * 100 + shift) as score, min(late * 1000000 + seed * 100 + shift) as k from al group by all)
  select query_id, row_number() over (partition by query_id order by k) as rank, score, example_id, pos from fi"""


def _grid() -> str:
    """Metrics of every method against the chunks of all reports."""
    names = ["reciprocal_rank"] + [f"{n}_{k}" for k in (1, 3, 5, 10) for n in ("hit", "recall")]
    rows = []
    for method in ("dense", "bm25", "hybrid", "adaptive"):
        for rerank in (False, True):
            per = f"""select g.query_id, count(*) as n, min(rank) as best, """ + ", ".join(f"count(*) filter (where rank <= {k}) as h{k}" for k in (1, 3, 5, 10)) + f""" from gold g left join
      (select f.query_id, c.example_id || '::' || c.source_id as gold_id, min(rank) as rank from ({_found(method, rerank)}) f join ck c using (example_id, pos) group by all) r on r.query_id = g.query_id and r.gold_id = g.gold_id group by g.query_id"""
            values = "coalesce(1.0 / best, 0) as reciprocal_rank, " + ", ".join(f"coalesce((h{k} > 0)::int, 0)::double as hit_{k}, coalesce(h{k} / n, 0)::double as recall_{k}" for k in (1, 3, 5, 10))
            rows.append(f"select '{method}' as method, {str(rerank).lower()} as rerank, count(*) as examples, {', '.join(f'round(avg({n}), 6) as {n}' for n in names)} from (select {values} from ex e left join ({per}) p on p.query_id = e.example_id)")
    gold = "gold as (select example_id as query_id, example_id || '::' || unnest(map_keys(gold_evidence)) as gold_id from ex)"
    return f"with {CK}, {_bm25(False)}, {_dense(False)}, {SIG}, {_RT}, {gold} " + " union all ".join(rows)


# fixed values: fields of the predictions file by their form
_FIELDS = {
    "texts": "example_id question gold_answer predicted_answer calculation calculation_steps answer_unit answer_scale executed_answer execution_error error evidence_grade_confidence evidence_grade_reason route_method "
    "embedding_calls generation_calls rewrite_calls input_tokens output_tokens total_tokens retrieved_chunks",
    "flags": "exact_match numerical_match citation_valid insufficient_evidence evidence_grade_sufficient used_rerank used_evidence_grader used_corrective_retry",
    "times": "total_ms retrieval_ms generation_ms evidence_grading_ms query_rewrite_ms corrective_retrieval_ms calculation_execution_ms", "lists": "retrieved_chunk_ids cited_chunk_ids",
}
_LINES = ", ".join(
    [f"coalesce({c}::varchar, '') as {c}" for c in _FIELDS["texts"].split()] + [f"coalesce(case when {c} then 'True' else 'False' end, '') as {c}".replace("case when", f"case when {c} is null then null when") for c in _FIELDS["flags"].split()]
    + [f"coalesce(printf('%.2f', {c}), '') as {c}" for c in _FIELDS["times"].split()] + ["coalesce(printf('%.8f', estimated_cost_usd), '') as estimated_cost_usd"] + [f"coalesce(array_to_string({c}, ' '), '') as {c}" for c in _FIELDS["lists"].split()]
)
_WORDS = r"list_filter(regexp_split_to_array(coalesce(array_to_string({}, ' '), ''), '[\s\x{{a0}}]+'), lambda x: x <> '')"


def _ids(cutoff: int) -> str:
    """Gold ids and the ids of the first results of every question."""
    return f"""ids as (select e.example_id as query_id, question, coalesce(array_to_string(list_sort(list_transform(map_keys(gold_evidence), lambda g: e.example_id || '::' || g)), ' '), '') as gold_ids, coalesce(got, '') as retrieved_ids
  from ex e left join (select b.query_id, string_agg(c.example_id || '::' || c.source_id, ' ' order by rank) as got from bm b join ck c using (example_id, pos) where rank <= {cutoff} group by b.query_id) g on g.query_id = e.example_id)"""


def _answers() -> str:
    """Every example answered with the last number of its best chunk."""
    number = r"-?\$?\s?\d+(?:,\d{3})*(?:\.\d+)?%?"
    match = f"""len(list_filter({_NUMS('answer')}, lambda p: len(list_filter(list_concat({_NUMS('gold')}, list_filter([num, case when contains(gold, '%') then num * 100 end], lambda z: z is not null)),
      lambda g: abs(p - g) <= greatest(0.001, abs(g) * 0.001))) > 0)) > 0"""
    return f"""with {CK}, {BM}, {SIG}, {_grades('select * from bm where rank <= 3')},
top as (select b.query_id, list(chunk_id order by rank) as ids, coalesce(list_last({_all("arg_min(content, rank)", number)}), '') as said from bm b join ck using (example_id, pos) where rank <= 3 group by b.query_id),
an as (select e.example_id, question, e.answer as gold, metadata.gold_numeric_answer as numeric, try_cast(metadata.gold_numeric_answer as double) as num, coalesce(said, 'Insufficient evidence') as answer, said is null as none, coalesce(ids, []) as ids,
    sufficient, least(points, 100) / 100 as confidence, {_REASON} as reason from ex e left join top on top.query_id = e.example_id join gr on gr.query_id = e.example_id),
ok as (select *, numeric is null or num is not null as ok from an)
select example_id, question, gold as gold_answer, case when ok then answer else '' end as predicted_answer, ok and coalesce({_NORM('answer')} = {_NORM('gold')}, false) as exact_match, ok and coalesce({match}, false) as numerical_match,
  ok as citation_valid, ok and none as insufficient_evidence, null::varchar as calculation, '' as calculation_steps, null::varchar as answer_unit, null::varchar as answer_scale, null::varchar as executed_answer, null::varchar as execution_error,
  case when not ok then 'could not convert string to float: ' || chr(39) || numeric || chr(39) end as error, case when ok then array_to_string(ids, ' ') else '' end as retrieved_chunk_ids, case when ok and not none then ids[1] else '' end as cited_chunk_ids,
  case when ok then sufficient end as evidence_grade_sufficient, case when ok then confidence end as evidence_grade_confidence, case when ok then reason end as evidence_grade_reason,
  0 as embedding_calls, 1 as generation_calls, 0 as rewrite_calls, 0 as input_tokens, 0 as output_tokens, 0 as total_tokens, null::double as estimated_cost_usd, len(ids)::int as retrieved_chunks,
  false as used_rerank, false as used_evidence_grader, false as used_corrective_retry, 'bm25' as route_method from ok"""


def _shown_number(v: str) -> str:
    """At most five decimals, none for whole numbers."""
    return f"regexp_replace(case when abs({v} - round_even({v}, 0)) <= 1e-9 * abs({v}) then printf('%.0f', {v}) else rtrim(rtrim(printf('%.5f', {v}), '0'), '.') end, '^-0$', '0')"


def _programs() -> str:
    """Programs run step by step in a recursive query."""
    text, number = {}, {}
    s2, s3, s4 = [], [], []
    for k in "ab":
        text[k] = _strip(f"coalesce(case when json_type({k}) <> 'NULL' then {k} ->> '$' end, 'None')")
        number[k] = f"case when json_type({k}) in ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') then {k}::double when json_type({k}) = 'BOOLEAN' then {k}::boolean::int::double end"
        s2 += [f"{text[k]} as t{k}", f"{number[k]} as n{k}"]
        s3 += [f"try_cast(regexp_extract(t{k}, '^#\\s*([+-]?\\d+)$', 1) as int) as f{k}", f"case when starts_with(t{k}, 'const_') then substr(t{k}, 7) else t{k} end as o{k}"]
        place = f"case when f{k} >= 0 then f{k} else f{k} + len(res) end"
        parsed = _PARSE.replace("cell", f"o{k}")
        s4.append(
            f"""case when n{k} is not null then {{'num': n{k}, 'str': null::varchar, 'err': null::varchar}} when t{k} = '' then {{'num': null, 'str': null, 'err': 'Empty calculation operand.'}}
        when starts_with(t{k}, '#') and f{k} is null then {{'num': null, 'str': null, 'err': 'Step reference ' || t{k} || ' is no number.'}}
        when starts_with(t{k}, '#') and ({place} < 0 or {place} >= len(res)) then {{'num': null, 'str': null, 'err': 'Step reference ' || t{k} || ' does not exist.'}}
        when starts_with(t{k}, '#') then {{'num': res[{place} + 1].num, 'str': res[{place} + 1].str, 'err': null}} when {parsed} is null then {{'num': null, 'str': null, 'err': 'Could not parse numeric operand: ' || o{k}}}
        else {{'num': {parsed}, 'str': null, 'err': null}} end as {k}v"""
        )
    shown = lambda v: f"coalesce({v}.str, {_shown_number(v + '.num')})"
    label = lambda c: f"translate(lower({_strip(c)}), ' -', '__')"
    return f"""with recursive {PR},
st as (select prediction_id, answer_unit, answer_scale, p, coalesce(case when json_type(p) = 'ARRAY' then json_array_length(p) end, 0)::int as n from (select *, case when trim(calculation_steps) <> '' then try_cast(calculation_steps as json) end as p from pr)),
run as (select prediction_id, p, n, 0 as i, []::struct(num double, str varchar)[] as res, []::varchar[] as tr, null::varchar as err from st
  union all
  select prediction_id, p, n, i + 1, case when e is null then list_append(res, v) else res end, case when e is null then list_append(tr, '#' || len(res) || ' = ' || name || '(' || {shown('av')} || ', ' || {shown('bv')} || ') = ' || {shown('v')}) else tr end, e
  from (select *, case when name not in ('add', 'subtract', 'multiply', 'divide', 'exp', 'greater') then 'Unsupported operation: ' || raw when args <> 2 then name || ' expects exactly two arguments.' when av.err is not null then av.err when bv.err is not null then bv.err
      when coalesce(av.str, bv.str) is not null then 'could not convert string to float: ' || chr(39) || coalesce(av.str, bv.str) || chr(39) when name = 'divide' and bv.num = 0 then 'Cannot divide by zero.'
      when name <> 'greater' and (v.num is null or isnan(v.num) or isinf(v.num)) then 'Result is not a finite number.' end as e
    from (select *, case when name = 'greater' then {{'num': null::double, 'str': case when av.num > bv.num then 'yes' else 'no' end}} else {{'num': case name when 'add' then av.num + bv.num when 'subtract' then av.num - bv.num when 'multiply' then av.num * bv.num
        when 'divide' then case when bv.num <> 0 then av.num / bv.num end when 'exp' then pow(av.num, bv.num) end, 'str': null::varchar}} end as v
      from (select *, {', '.join(s4)} from (select *, {', '.join(s3)} from (select *, {', '.join(s2)}
        from (select *, coalesce(x ->> 'operation', '') as raw, lower({_strip("coalesce(x ->> 'operation', '')")}) as name, coalesce(json_array_length(x, '$.arguments'), 0) as args, x -> '$.arguments[0]' as a, x -> '$.arguments[1]' as b
          from (select *, json_extract(p, '$[' || i || ']') as x from run where i < n and err is null)))))))),
done as (select prediction_id, arg_max(res, i) as res, arg_max(tr, i) as tr, (arg_max({{'e': err}}, i)).e as err from run group by prediction_id),
fin as (select st.prediction_id, case when err is null then res[len(res)] end as v, tr, case when len(tr) + len(res) = 0 then coalesce(err, 'No calculation steps were provided.') else err end as err, coalesce({label('answer_unit')}, '') as u, coalesce(nullif({label('answer_scale')}, ''), 'auto') as s from st join done using (prediction_id)),
num as (select *, case when u in ('percent', 'percentage') and abs(v.num) <= 1 and s in ('auto', 'ratio_to_percent') then v.num * 100 else v.num end as x from fin)
select prediction_id, v.str as word, coalesce(v.str, case when u in ('dollar', 'dollars') then '$' else '' end || {_shown_number('x')} || case when u in ('percent', 'percentage') then '%' when u = 'percentage_points' then ' percentage points' when u in ('million', 'millions') then ' million'
  when u in ('billion', 'billions') then ' billion' when u in ('share', 'shares') then ' shares' else '' end) as formatted, case when len(tr) > 0 then array_to_string(tr, chr(10)) end as trace, err as error from num"""


def _finished() -> str:
    """Predictions as payloads: programs run unless they abstain, citations made canonical and checked."""
    strip = lambda x: _strip(x)
    bare = f"case when starts_with({strip('x')}, 'CHUNK ') then {strip('substr(' + strip('x') + ', 7)')} else {strip('x')} end"
    of = lambda x: bare.replace("(x,", f"({x},")
    return f"""with {PR}, x as ({_programs()}),
c as (select *, list_transform(coalesce(cited_chunk_ids, []), lambda z: {of("coalesce(z, '')")}) as said, list_filter(coalesce(retrieved_chunk_ids, []), lambda z: z is not null) as got from pr),
r as (select *, list_transform(got, lambda z: {of('z')}) as ids, list_transform(got, lambda z: replace(regexp_extract(z, '(table|text)::(\\d+)\\s*$'), '::', '_')) as sources from c),
k as (select *, list_transform(said, lambda z: case when not list_contains(ids, z) and len(list_filter(sources, lambda y: y = z)) = 1 then ids[list_position(sources, z)] else z end) as cited from r),
w as (select *, list_filter(cited, lambda z, i: not list_contains(ids, z) and list_position(cited, z) = i) as wrong, not coalesce(insufficient_evidence, false) and coalesce(json_array_length(case when trim(calculation_steps) <> '' then try_cast(calculation_steps as json) end), 0) > 0 as runs from k)
select w.prediction_id as query_id, case when runs and x.error is null then x.formatted else coalesce(predicted_answer, '') end as answer, array_to_string(cited, ' ') as cited, coalesce(insufficient_evidence, false) as insufficient_evidence,
  case when runs and x.error is null then x.formatted end as executed_answer, case when runs then x.error end as execution_error,
  case when len(wrong) > 0 then 'Citations are not among the retrieved chunks: ' || array_to_string(wrong, ', ') end as error from w join x using (prediction_id)"""


def oracle_sql() -> dict[str, str]:
    count = lambda src, items: f"select term, count(*) as n from (select unnest({items}) as term from {src}) group by term"
    grid = f"with {CK}, {BM}, {_METRICS}"
    return {
        "adaptive_retrieval": f"with {CK}, {BM}, {DE}, {SIG}, {_RT} select {_SHOW} from ({_found('adaptive', False)})",
        "adaptive_retrieval_corpus": f"with {CK}, {_bm25(False)}, {_dense(False)}, {SIG}, {_RT} select {_SHOW} from ({_found('adaptive', False)})",
        "experiment_grid": _grid(),
        "chunk_corpus": f"with {CK} select chunk_id, example_id, document_id, pos::int as pos, chunk_type, section, content, source_id, row_index::int as row_index, text_index::int as text_index, ragged from ck",
        "chunk_counts": f"with {CK} select chunk_type, section, count(*) as chunks, sum(length(content))::bigint as characters from ck group by all",
        "chunk_gold_overlap": f"with {CK} select e.example_id, count(c.chunk_id) as chunks, count(*) filter (where list_contains(map_keys(e.gold_evidence), c.source_id)) as gold_chunks from ex e left join ck c using (example_id) group by e.example_id",
        "example_profile": f"with {EX} select example_id, document_id, question, answer, coalesce(len(pre_text), 0)::int as pre_paragraphs, coalesce(len(table_rows), 0)::int as table_rows, coalesce(len(post_text), 0)::int as post_paragraphs, coalesce(len(map_keys(gold_evidence)), 0)::int as gold_items, gold_program from ex",
        "examples_limit": f"with {EX} select example_id, document_id, question from ex order by example_id limit 100",
        "token_counts": count("chunks", _tokens("content")),
        "content_term_counts": count("documents", _terms("text")),
        "number_counts": count("chunks", _numbers("content")),
        "year_counts": count("chunks", _all("content", T.YEAR)),
        "parsed_numbers": f"""with {EX}, r as (select example_id, i - 1 as row_no, table_rows[i] as row from (select example_id, table_rows, unnest(range(1, len(table_rows) + 1)) as i from ex)),
          c as (select example_id, row_no, j - 1 as cell_no, row[j] as cell from (select *, unnest(range(1, len(row) + 1)) as j from r)), v as (select *, {_PARSE} as v from c)
          select example_id, row_no::int as row_no, cell_no::int as cell_no, v as number, {_SHOWN} as shown from v""",
        "bm25_corpus_stats": f"with {CK} select count(*) as n, round(avg(len({_tokens('content')})), 6) as avgdl from ck",
        "bm25_term_stats": f"with {CK}, {_bm25(False)} select term, df, round(idf, 6) as idf from idf",
        "bm25_topk_report": f"with {CK}, {BM} select {_SHOW} from bm where rank <= 10",
        "bm25_topk_corpus": f"with {CK}, {_bm25(False)} select {_SHOW} from bm where rank <= 10",
        "dense_topk_cosine": _vectors("cosine", False),
        "dense_topk_l2": _vectors("l2", False),
        "dense_topk_scoped": _vectors("cosine", True),
        "vector_norms": "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, case when list_dot_product(embedding::double[], embedding::double[]) = 0 then 0.0 else 1.0 end::double as unit from embeddings",
        "index_alignment": """select (select count(chunk_id) from chunks) as chunks, (select count(chunk_id) from chunk_vectors) as vectors,
          (select count(*) from (select chunk_id from chunks where chunk_id is not null except select chunk_id from chunk_vectors)) as chunks_without_vector,
          (select count(*) from (select chunk_id from chunk_vectors where chunk_id is not null except select chunk_id from chunks)) as vectors_without_chunk""",
        "dense_topk_report": f"with {CK}, {DE} select {_SHOW} from de where rank <= 10",
        "hybrid_topk_report": f"with {CK}, {BM}, {DE}, {_RRF} select {_SHOW} from (select *, row_number() over (partition by query_id order by round(score, 12) desc, f) as rank from fu) where rank <= 10",
        "neighbor_expansion": f"""with {CK}, {BM}, se as (select bm.*, section, row_index from bm join ck using (example_id, pos) where rank <= 3),
          al as (select query_id, example_id, pos, 0 as late, rank as seed, 0 as shift, score from se union all
            select s.query_id, c.example_id, c.pos, 1, s.rank, d, s.score from se s join (values (-1), (1)) w(d) on true join ck c on c.example_id = s.example_id and c.section = s.section and c.row_index = s.row_index + d),
          fi as (select query_id, example_id, pos, arg_min(score, late * 1000000 + seed * 100 + shift) as score, min(late * 1000000 + seed * 100 + shift) as k from al group by all)
          select query_id, row_number() over (partition by query_id order by k) as rank, round(score, 6) as score, example_id, pos from fi""",
        "merged_results": f"""with {CK}, {BM}, {DE}, b as (select 0 as no, * from de where rank <= 5 union all by name select 1 as no, * from bm where rank <= 5),
          o as (select query_id, example_id, pos, max(score) as score, min(no * 1000 + rank) as k from b group by all)
          select {_SHOW} from (select *, row_number() over (partition by query_id order by round(score, 9) desc, k) as rank from o) where rank <= 5""",
        "route_signals": f"with {EX}, {SIG} select example_id as query_id, array_to_string(signals, ' ') as signals from sg",
        "route_decisions": _route(),
        "rewritten_questions": _REWRITE,
        "rerank_features": f"with {CK}, {BM}, {SIG}, {_FE} select query_id, example_id, pos, rank, round(term_overlap, 6) as term_overlap, year_support, number_support, table_bonus, exact_tokens, cohesion, round(rr_score, 6) as rr_score from rr",
        "reranked": f"with {CK}, {BM}, {SIG}, {_FE} select query_id, r as rank, round(rr_score, 6) as score, example_id, pos from (select *, row_number() over (partition by query_id order by round(rr_score, 9) desc, rank) as r from rr) where r <= 5",
        "evidence_grades": f"""with {CK}, {BM}, {SIG}, {_grades('select * from bm where rank <= 5')} select query_id, sufficient, not sufficient as needs_retry, least(points, 100) / 100 as confidence,
          {_REASON} as reason, array_to_string(matched, ' ') as matched, array_to_string(missing, ' ') as missing from gr""",
        "evidence_grades_corpus": f"""with {CK}, {_bm25(False)}, {SIG}, {_grades('select * from bm where rank <= 5')} select query_id, sufficient, not sufficient as needs_retry, least(points, 100) / 100 as confidence,
          {_REASON} as reason, array_to_string(matched, ' ') as matched, array_to_string(missing, ' ') as missing from gr""",
        "reranked_corpus": f"with {CK}, {_bm25(False)}, {SIG}, {_features('select * from bm where rank <= 20')} select query_id, r as rank, round(rr_score, 6) as score, example_id, pos from (select *, row_number() over (partition by query_id order by round(rr_score, 9) desc, rank) as r from rr) where r <= 10",
        "stored_index_search": f"with {CK}, {DE}, l2 as (select q.example_id as query_id, c.example_id, c.pos, list_distance(q.v, c.v) ** 2 as score from qv q join cv c using (example_id)), r as (select *, row_number() over (partition by query_id order by round(score, 9), example_id, pos) as rank from l2) select {_SHOW} from r where rank <= 10",
        "evidence_texts": f"""with {CK}, {BM} select query_id, string_agg('[CHUNK ' || chunk_id || ']' || chr(10) || 'type: ' || chunk_type || chr(10) || 'section: ' || section || chr(10) || 'source_ids: ' || source_id || chr(10) || 'content:' || chr(10) || content, chr(10) || chr(10) order by rank) as evidence
          from bm join ck using (example_id, pos) where rank <= 3 group by query_id""",
        "answer_matches": f"""with {_MATCH} select prediction_id, coalesce({_NORM('predicted_answer')} = {_NORM('gold_answer')}, false) as exact,
          coalesce(len(list_filter({_NUMS('predicted_answer')}, lambda p: len(list_filter(list_concat({_NUMS('gold_answer')}, list_filter([num, case when contains(gold_answer, '%') then num * 100 end], lambda z: z is not null)),
            lambda g: abs(p - g) <= greatest(0.001, abs(g) * 0.001))) > 0)) > 0, false) as numerical,
          case when coalesce(insufficient_evidence, false) then len(coalesce(cited_chunk_ids, [])) = 0 else len(coalesce(cited_chunk_ids, [])) > 0 and len(list_filter(cited_chunk_ids, lambda c: case when c is null then len(list_filter(coalesce(retrieved_chunk_ids, []), lambda r: r is null)) = 0 else not coalesce(list_contains(retrieved_chunk_ids, c), false) end)) = 0 end as citations,
          numeric is not null and num is null as stopped from am""",
        "answer_summary": f"""with {PR}, d as (select *, coalesce(error, '') = '' as ok from pr) select count(*) as examples, count(*) filter (where ok) as completed, """
        + ", ".join(f"round(coalesce(avg(coalesce({c}, false)::int) filter (where ok), 0), 6) as {n}" for c, n in (("exact_match", "exact_match"), ("numerical_match", "numerical_match"), ("citation_valid", "citation_validity"), ("(executed_answer is not null)", "execution_success_rate"), ("(execution_error is not null)", "execution_error_rate"), ("insufficient_evidence", "insufficient_evidence_rate")))
        + ", round(1 - coalesce(count(*) filter (where ok) / nullif(count(*), 0), 0), 6) as error_rate, "
        + ", ".join(f"round(coalesce(avg({c}) filter (where ok), 0), 6) as avg_{c}" for c in ("total_ms", "retrieval_ms", "generation_ms", "estimated_cost_usd", "embedding_calls", "generation_calls", "retrieved_chunks"))
        + " from d",
        "cost_estimates": f"with {PR} select route_method, count(*) as predictions, round(coalesce(sum(input_tokens / 1000000 * 0.4 + output_tokens / 1000000 * 2.0), 0), 6) as cost from pr group by all",
        "predictions_csv": f"with {PR} select prediction_id, {_LINES} from pr",
        "predictions_read_back": f"""with {PR} select prediction_id, coalesce(exact_match, false) as exact_match, evidence_grade_sufficient, printf('%.2f', total_ms)::double as total_ms, input_tokens, nullif(answer_unit, '') as answer_unit,
          len({_WORDS.format('retrieved_chunk_ids')})::int as retrieved, array_to_string({_WORDS.format('cited_chunk_ids')}, '|') as cited from pr""",
        "answer_evaluation": _answers(),
        "calculation_runs": _programs(),
        "finished_answers": _finished(),
        "retrieval_metrics": f"{grid} select query_id, round(reciprocal_rank, 6) as reciprocal_rank, " + ", ".join(f"round(hit_{k}, 6) as hit_{k}, round(recall_{k}, 6) as recall_{k}" for k in evaluation.CUTOFFS) + " from me",
        "retrieval_failures": f"with {CK}, {BM}, {_METRICS}, {_ids(5)} select query_id as example_id, coalesce(question, '') as question, gold_ids, retrieved_ids from me join ids using (query_id) where hit_5 = 0",
        "grader_file": f"""with {CK}, {BM}, {SIG}, {_METRICS}, {_grades('select * from bm where rank <= 10')}, {_ids(10)}
          select query_id as example_id, coalesce(question, '') as question, gold_ids, retrieved_ids, case when sufficient then 'True' else 'False' end as is_sufficient, case when sufficient then 'False' else 'True' end as needs_retry, (least(points, 100) / 100)::varchar as confidence,
          coalesce({_REASON}, '') as missing_reason, array_to_string(matched, ' ') as matched_signals, array_to_string(missing, ' ') as missing_signals, case when hit_10 > 0 then 'True' else 'False' end as has_any_gold_evidence,
          case when query_id not in (select query_id from gold) or recall_10 >= 1 then 'True' else 'False' end as has_all_gold_evidence from gr join me using (query_id) join ids using (query_id)""",
        "grader_summary": f"""with {CK}, {BM}, {SIG}, {_METRICS}, {_grades('select * from bm where rank <= 10')}, z as (select sufficient, hit_10 > 0 as a, query_id not in (select query_id from gold) or recall_10 >= 1 as l from gr join me using (query_id))
          select count(*) as examples, round(avg(sufficient::int), 6) as sufficient_rate, round(avg(a::int), 6) as any_gold_rate, round(avg(l::int), 6) as all_gold_rate, round(avg((sufficient and not a)::int), 6) as false_sufficient_rate, round(avg((not sufficient and a)::int), 6) as false_insufficient_rate from z""",
        "failure_classes": f"with {_FAIL} select prediction_id, failure_category, array_to_string(gold_ids, ' ') as gold_ids, array_to_string(retrieved_gold_ids, ' ') as retrieved_gold_ids, array_to_string(missing_gold_ids, ' ') as missing_gold_ids from fl",
        "failure_counts": f"with {_FAIL} select failure_category, count(*) as n from fl group by all",
    }


