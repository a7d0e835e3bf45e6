"""SQL pieces for the oracle, in the dialect of DuckDB, written independently of the Spark operators."""

from __future__ import annotations

from faultlens.functions import fixed_values as fv
from faultlens.functions import prompts as pr
from faultlens.sources.views import FAULTS, HOSTS, BLOCK


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def arr(words: list[str]) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"


def pick(words: list[str], index: str) -> str:
    return f"({arr(words)})[1 + CAST(({index}) % {len(words)} AS INT)]"


def fault(index: str) -> str:
    return pick(FAULTS, index)


# --- scalar pieces -------------------------------------------------------------------------------

def mask(text: str) -> str:
    for _, pattern, replacement in fv.MASK_RULES:
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(replacement)}, 'g')"
    return text


def mask_stages(text: str) -> list[tuple[str, str]]:
    """(rule, number of matches on what the earlier rules left)"""
    out = []
    for name, pattern, replacement in fv.MASK_RULES:
        out.append((name, f"len(regexp_extract_all({text}, {lit(pattern)}))"))
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(replacement)}, 'g')"
    return out


def weight(line: str) -> str:
    cases, by_weight = "", {}
    for word, value in fv.LEVEL_WEIGHTS.items():
        by_weight.setdefault(value, []).append(word)
    detail = "(" + " OR ".join(f"starts_with({line}, {lit(p)})" for p in fv.DETAIL_PREFIXES).replace("'\t'", "chr(9)") + ")"
    for value in sorted(by_weight, reverse=True):
        hit = " OR ".join(f"contains(upper({line}), {lit(w)})" for w in by_weight[value])
        floored = max(value, fv.DETAIL_FLOOR)
        cases += f" WHEN {hit} THEN (CASE WHEN {detail} THEN {floored} ELSE {value} END)"
    return f"CAST((CASE{cases} ELSE {fv.NO_LEVEL_WEIGHT} END) AS DOUBLE)"


def tok(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def clip(text: str, n: int) -> str:
    return f"(CASE WHEN length({text}) > {n} THEN left({text}, {n}) || '...' ELSE {text} END)"


def clip_bytes(text: str, n: int) -> str:
    return (
        f"(CASE WHEN strlen({text}) > {n} THEN left({text}, list_max(list_filter(range(0, {n + 1}), "
        f"lambda c: strlen(left({text}, c)) <= {n}))) || '...' ELSE {text} END)"
    )


def key_errors(text: str) -> str:
    return f"(list_filter({arr(fv.KEY_ERRORS)}, lambda p: contains(upper({text}), upper(p))))[1:{fv.MAX_KEY_ERRORS}]"


def first_rule(text: str, rules, default: str) -> str:
    cases = "".join(
        " WHEN " + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + f" THEN {lit(value)}"
        for words, value in rules
    )
    return f"(CASE{cases} ELSE {lit(default)} END)"


# --- derived views -------------------------------------------------------------------------------

_K = "CAST(json_extract_string(props, '$.k') AS INT)"

LINES = f"""
base AS (
  SELECT (event_id // {BLOCK}) * {HOSTS} + user_id % {HOSTS} AS log_id, ts, event_id, user_id, event_type,
         user_id % {HOSTS} AS host, {_K} AS k
  FROM events),
lines AS (
  SELECT log_id, ts, event_id, user_id,
    concat(substr(CAST(ts AS VARCHAR), 1, 19), ' ',
      CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO'
        WHEN 'view' THEN 'DEBUG' ELSE 'TRACE' END,
      ' [svc', host, '] ',
      CASE
        WHEN event_type = 'error' AND k < 50 AND event_id % 3 = 0 THEN concat({fault('log_id + event_id % 2')},
          ' in worker', chr(10), '    at com.shop.Worker.run(Worker.java:', k, ') WARN frame', chr(10),
          'Caused by: java.io.IOException: ', {fault('log_id + event_id % 2')})
        WHEN event_type = 'error' AND k < 50 THEN concat({fault('log_id + event_id % 2')}, ' for user', user_id)
        WHEN event_type = 'error' THEN concat('request failed, retry ', k)
        WHEN event_type = 'purchase' AND k % 2 = 0 THEN
          concat('payment retry user', user_id, '@mail.example.com password=p', event_id)
        WHEN event_type = 'purchase' THEN concat('slow checkout from 10.', k, '.', host, '.', event_id % 256)
        WHEN event_type = 'signup' THEN
          concat('issued token: ', md5(CAST(event_id AS VARCHAR)), ' to user', user_id)
        WHEN event_type = 'view' THEN concat('cache lookup took ', k, ' ms')
        ELSE concat('span closed after ', k, ' us') END) AS line
  FROM base)"""

LOGS = LINES + """,
logs AS (
  SELECT log_id, string_agg(line, chr(10) ORDER BY ts, event_id) AS content, min(ts) AS ts,
    (['zero_shot', 'cot', 'FEW_SHOT', 'unknown'])[1 + CAST(log_id % 4 AS INT)] AS strategy,
    log_id % 3 <> 0 AS use_rag
  FROM lines GROUP BY log_id)"""

KB = f"""
kb AS (
  SELECT doc_id AS id, {clip('text', fv.SEED_TITLE_CHARS)} AS title, text AS content, source AS category,
    concat_ws(',', {fault('doc_id')}, {fault('doc_id + 1')}, {fault('doc_id + 2')}) AS keywords,
    concat_ws(',', {fault('doc_id')}, {fault('doc_id + 7')}) AS symptoms
  FROM documents)"""

KB_STATE = KB + """,
kb_state AS (SELECT kb.*, e.embedding FROM kb LEFT JOIN embeddings e ON e.vec_id = kb.id)"""

CASES = LOGS + f""",
cases AS (
  SELECT concat('case_', lpad(CAST(log_id AS VARCHAR), 6, '0')) AS id, log_id,
    {pick(fv.CASE_CATEGORIES, 'log_id')} AS category, content AS log,
    concat('服务异常 ', {fault('log_id')}, ' 与 ', {fault('log_id + 1')}) AS expected_root_cause,
    ([{', '.join(fault(f'log_id * 3 + {i * 5}') for i in range(6))}])[1:CAST(log_id % 3 + 4 AS INT)]
      AS expected_keywords
  FROM logs)"""

_GOOD = f"""to_json({{'root_cause': concat('Suspected ', {fault('conv_id * 4 + turn')}), 'analysis_process': text,
      'solution_steps': ['check logs', concat('restart svc', conv_id)],
      'confidence': (conv_id % 50)::DOUBLE / 100.0::DOUBLE + 0.5::DOUBLE}})"""
ANSWERS = f"""
answers AS (
  SELECT conv_id, turn,
    CASE (conv_id + turn) % 7
      WHEN 0 THEN CAST({_GOOD} AS VARCHAR)
      WHEN 1 THEN concat('Here is the result:', chr(10), {_GOOD}, chr(10), 'Hope it helps.')
      WHEN 2 THEN concat('{{broken ', translate(text, '{{}}"', ''))
      WHEN 3 THEN concat('{{"root_cause": 5, "confidence": "0.9", "solution_steps": ["a", 7, null], "n": ',
                         conv_id, '}}')
      WHEN 4 THEN 'null'
      WHEN 5 THEN concat('[', {_GOOD}, ']')
      ELSE concat('{{"root_cause": "Suspected ', {fault('conv_id * 4 + turn')},
                  '", "confidence": 1, "solution_steps": "none"}}') END AS raw_content
  FROM conversations WHERE role = 'assistant')"""

RESULTS = f"""
results AS (
  SELECT concat('case_', user_id) AS case_id, event_type AS category,
    {pick(fv.MODES, 'event_id // 4')} AS mode, {pick(fv.STRATEGIES + ['OTHER'], 'event_id')} AS strategy,
    concat('cause "', {fault('event_id')}, '", seen ', k, ' times') AS predicted_cause,
    concat('expected ', {fault('event_id + k')}) AS expected_cause,
    k + event_id % 4 * 10 < 70 AS is_correct, k::DOUBLE / 128.0::DOUBLE AS confidence,
    1500 + k * 37 + event_id % 11 AS latency_ms, k % 5 AS knowledge_used, 400 + k * 7 AS tokens_used,
    concat('log of event ', event_id) AS log_snippet,
    CASE WHEN k = 13 THEN 'no answer after 3 attempts' ELSE '' END AS error
  FROM (SELECT *, {_K} AS k FROM events))"""

HISTORY = f"""
history AS (
  SELECT doc_id AS id, concat('session-', doc_id) AS session_id, sha256(text) AS log_hash,
    {clip('text', fv.SNIPPET_CHARS)} AS log_snippet, concat_ws(',', doc_id % 7, doc_id % 11) AS retrieved_doc_ids,
    {fault('doc_id')} AS root_cause, lang AS analysis_process, [source, 'restart'] AS solution_steps,
    (doc_id % 64)::DOUBLE / 64.0::DOUBLE AS confidence, {lit(fv.MODEL_NAME)} AS model_used,
    {pick(fv.STRATEGIES, 'doc_id')} AS prompt_strategy, n_chars AS total_tokens, doc_id * 13 % 5000 AS latency_ms,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 977 % 86400) AS created_at
  FROM documents)"""


# --- preprocessing -------------------------------------------------------------------------------

def truncated(source: str, key: str, text: str, limit: int, out: str) -> str:
    """CTE ``out``(key, short): the greedy line choice as a fold, without any shortcut for short texts."""
    edge = fv.EDGE_LINES
    outer = f"(e.i < {edge} OR e.i >= n - {edge})"
    return f"""
{out}_split AS (SELECT {key}, {text} AS txt, string_split({text}, chr(10)) AS ls FROM {source}),
{out}_lines AS (
  SELECT {key}, len(ls) AS n, list_transform(range(0, len(ls)),
    lambda j: {{'i': j, 'c': ls[j + 1], 'b': strlen(ls[j + 1]), 'w': {weight('ls[j + 1]')}}}) AS x
  FROM {out}_split),
{out}_used AS (
  SELECT *, CAST(list_sum(list_transform(list_filter(x, lambda e: {outer}), lambda e: e.b + 1)) AS BIGINT) AS used
  FROM {out}_lines),
{out}_kept AS (
  SELECT *, list_reduce(
    list_transform(
      list_sort(list_transform(list_filter(x, lambda e: NOT {outer}), lambda e: {{'w': -e.w, 'i': e.i, 'b': e.b}})),
      lambda e: {{'cur': CAST(e.b AS BIGINT), 'kept': [CAST(e.i AS BIGINT)]}}),
    lambda a, b: CASE WHEN a.cur + b.cur > {limit} THEN a
      ELSE {{'cur': a.cur + b.cur + 1, 'kept': list_concat(a.kept, b.kept)}} END,
    {{'cur': used, 'kept': CAST([] AS BIGINT[])}}).kept AS kept
  FROM {out}_used),
{out} AS (
  SELECT {key}, array_to_string(list_transform(
    list_filter(x, lambda e: {outer} OR list_contains(kept, e.i)), lambda e: e.c), chr(10)) AS short
  FROM {out}_kept)"""


def prepared(source: str = "logs", key: str = "log_id", text: str = "content", limit: int | None = None) -> str:
    """CTE ``prep``(key, masked, short, original_hash, token_count, key_errors, keywords)."""
    limit = limit or fv.MAX_TOKENS * fv.BYTES_PER_TOKEN
    return f"""
masked AS (SELECT {key}, {mask(text)} AS masked FROM {source}),
{truncated('masked', key, 'masked', limit, 'cut').strip()},
prep0 AS (
  SELECT m.{key}, m.masked, c.short, sha256(m.masked) AS original_hash,
    CAST(strlen(c.short) // {fv.BYTES_PER_TOKEN} AS INT) AS token_count, {key_errors('c.short')} AS key_errors
  FROM masked m JOIN cut c ON m.{key} = c.{key}),
prep1 AS (
  SELECT *, list_concat(key_errors, list_filter({arr(fv.RETRIEVAL_WORDS)},
    lambda p: contains(upper(short), upper(p)))) AS found FROM prep0),
prep2 AS (
  SELECT *, list_filter(found, lambda w, i:
    list_position(list_transform(found, lambda z: upper(z)), upper(w)) = i) AS uniq FROM prep1),
prep AS (
  SELECT * EXCLUDE (found, uniq), CASE WHEN len(uniq) = 0 THEN {arr(fv.DEFAULT_WORDS)} ELSE uniq END AS keywords
  FROM prep2)"""


# --- search --------------------------------------------------------------------------------------

def fts(queries: str, qid: str, qtext: str, kb: str = "kb", out: str = "fts", k: int = fv.TOP_K) -> str:
    """CTEs ``out``_all(qid, id, score) and ``out``(qid, id, rank, score)."""
    return f"""
{out}_q AS (SELECT {qid} AS qid, list_distinct({tok(qtext)}) AS qs FROM {queries}),
{out}_qw AS (SELECT qid, len(qs) AS nq, unnest(qs) AS w FROM {out}_q),
{out}_d AS (SELECT id, {tok("coalesce(content, '') || ' ' || coalesce(keywords, '')")} AS ts FROM {kb}),
{out}_dw AS (SELECT id, len(ts) AS n, unnest(ts) AS w FROM {out}_d),
{out}_tf AS (SELECT id, n, w, count(*) AS tf FROM {out}_dw WHERE w IN (SELECT w FROM {out}_qw) GROUP BY ALL),
{out}_all AS (
  SELECT qid, id, CAST(sum(tf) AS DOUBLE) / n AS score
  FROM {out}_qw JOIN {out}_tf USING (w) GROUP BY qid, id, n, nq HAVING count(*) = nq),
{out} AS (
  SELECT qid, id, rank, score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {out}_all)
  WHERE rank <= {k})"""


def like(source: str, key: str, kb: str = "kb", k: int = fv.TOP_K) -> str:
    """CTEs like_all(qid, keyword, id) and like_one(qid, id, rank)."""
    return f"""
like_asked AS (SELECT DISTINCT {key} AS qid, unnest(keywords) AS keyword FROM {source}),
like_kw AS (
  SELECT keyword, id FROM (
    SELECT keyword, id, row_number() OVER (PARTITION BY keyword ORDER BY id) AS r
    FROM (SELECT DISTINCT keyword FROM like_asked WHERE strlen(keyword) >= {fv.MIN_KEYWORD_BYTES}) w
    JOIN {kb} ON symptoms LIKE '%' || keyword || '%')
  WHERE r <= {k}),
like_all AS (SELECT qid, keyword, id FROM like_asked JOIN like_kw USING (keyword)),
like_one AS (
  SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS rank
  FROM (SELECT DISTINCT qid, id FROM like_all))"""


def hashed(source: str, key: str, text: str, out: str) -> str:
    """CTE ``out``(key, embedding): the hashed bag of words."""
    digit = "(strpos('0123456789abcdef', substr(h, {p}, 1)) - 1)"
    d1, d2, d3 = (digit.format(p=p) for p in (1, 2, 3))
    return f"""
{out}_t AS (SELECT {key}, md5(w) AS h FROM (SELECT {key}, unnest({tok(text)}) AS w FROM {source})),
{out}_b AS (
  SELECT {key}, ({d1} % 4) * 16 + {d2} AS j, sum(CASE WHEN {d3} < 8 THEN 1 ELSE -1 END) AS c
  FROM {out}_t GROUP BY ALL),
{out}_m AS (
  SELECT {key}, map_from_entries(list((j, CAST(c AS DOUBLE)))) AS m, sqrt(sum(CAST(c AS DOUBLE) * c)) AS len
  FROM {out}_b GROUP BY {key}),
{out} AS (
  SELECT {key}, CASE WHEN len > 0 THEN list_transform(range(0, 64),
    lambda j: CAST(coalesce(m[j], 0) / len AS FLOAT)) END AS embedding
  FROM {out}_m)"""


def micros(vector: str) -> str:
    return (f"array_to_string(list_transform({vector}, lambda x: "
            "CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), ',')")


def nearest(queries: str, qid: str, articles: str, aid: str, out: str, k: int = fv.TOP_K, where: str = "true") -> str:
    """CTE ``out``(qid, id, similarity, rank) over two relations q and a with an embedding column."""
    return f"""
{out}_s AS (
  SELECT q.{qid} AS qid, a.{aid} AS id,
    round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), 6) AS similarity
  FROM {queries} q, {articles} a WHERE q.embedding IS NOT NULL AND a.embedding IS NOT NULL AND {where}),
{out} AS (
  SELECT qid, id, similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM {out}_s)
  WHERE rank <= {k})"""


def hits(vectors: bool = True, key: str = "log_id", logs: str = "prep", kb: str = "kb", embedded: str = "true") -> str:
    """CTE ``hits``(qid, id, source, p, rank, n_fts) of prepared logs against kb; ``embedded`` says which logs get a vector."""
    text = f"""
ftq AS (SELECT {key} AS qid, array_to_string(keywords, ' ') AS qt FROM {logs}),
{fts('ftq', 'qid', 'qt', kb).strip()},
{like(logs, key, kb).strip()},
text_hits AS (
  SELECT qid, id, 'fts' AS source, 0 AS p, rank FROM fts
  UNION ALL SELECT qid, id, 'like', 1, rank FROM like_one)"""
    every = "SELECT * FROM text_hits"
    if vectors:
        text += f""",
to_embed AS (SELECT {key}, short FROM {logs} WHERE {embedded}),
{hashed('to_embed', key, 'short', 'lvec').strip()},
kbt AS (SELECT id, title || chr(10) || content AS txt FROM {kb}),
{hashed('kbt', 'id', 'txt', 'kvec').strip()},
{nearest('lvec', key, 'kvec', 'id', 'near').strip()},
vec_hits AS (
  SELECT qid, id, 'vector' AS source, 2 AS p,
    row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank
  FROM near WHERE similarity > 0)"""
        every += " UNION ALL SELECT * FROM vec_hits"
    return text + f""",
hits AS (
  SELECT h.*, coalesce(n, 0) AS n_fts FROM ({every}) h
  LEFT JOIN (SELECT qid, count(*) AS n FROM fts GROUP BY qid) f ON f.qid = h.qid)"""


# logs whose vector the service of the catalog gives
EMBEDDED = "md5(short) >= '4'"

FIRST_SOURCE = f"""
merged AS (
  SELECT qid, id, source, p, rank,
    CASE source WHEN 'fts' THEN CAST(n_fts - rank + 1 AS DOUBLE) WHEN 'like' THEN {fv.LIKE_SCORE} END AS ft_score,
    CASE source WHEN 'vector' THEN CAST(rank AS DOUBLE) END AS vec_score
  FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY p, rank) AS o FROM hits) WHERE o = 1),
scored AS (
  SELECT *, CASE WHEN ft_score > 0 THEN 1.0::DOUBLE / ({fv.RRF_K} + ft_score::DOUBLE) ELSE 0 END
    + CASE WHEN vec_score > 0 THEN 1.0::DOUBLE / ({fv.RRF_K} + vec_score) ELSE 0 END AS rrf
  FROM merged)"""

FUSED = f"""
ranks AS (
  SELECT qid, id, min(rank) FILTER (source = 'fts') AS r0, min(rank) FILTER (source = 'like') AS r1,
    min(rank) FILTER (source = 'vector') AS r2, min(p) AS p, arg_min(rank, p) AS rank
  FROM hits GROUP BY qid, id),
scored AS (
  SELECT qid, id, p, rank, (['fts', 'like', 'vector'])[p + 1] AS source,
    coalesce(1.0::DOUBLE / ({fv.RRF_K} + r0::DOUBLE), 0) + coalesce(1.0::DOUBLE / ({fv.RRF_K} + r1::DOUBLE), 0)
      + coalesce(1.0::DOUBLE / ({fv.RRF_K} + r2::DOUBLE), 0) AS rrf
  FROM ranks)"""


def ranked(k: int = fv.TOP_K, threshold: float = fv.SCORE_THRESHOLD) -> str:
    """CTEs ``normed`` and ``final``(qid, hit_rank, id, similarity_score) over ``scored``."""
    return f"""
normed AS (
  SELECT *, rrf / CASE WHEN max(rrf) OVER (PARTITION BY qid) > 0 THEN max(rrf) OVER (PARTITION BY qid) ELSE 1 END
    AS similarity_score FROM scored),
final AS (
  SELECT qid, hit_rank, id, similarity_score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, p, rank, id) AS hit_rank
    FROM normed WHERE similarity_score >= {threshold}) WHERE hit_rank <= {k})"""


# --- answers and prompts -------------------------------------------------------------------------

def parsed(source: str, raw: str, out: str = "read") -> str:
    """CTE ``out``: source columns plus parse_kind and the typed answer fields."""
    part = f"regexp_extract({raw}, '(?s)\\{{.*\\}}', 0)"
    return f"""
{out}_0 AS (
  SELECT *, CASE WHEN json_valid({raw}) THEN json_type({raw}) END AS whole_type,
    CASE WHEN json_valid({part}) THEN {part} END AS part
  FROM {source}),
{out}_1 AS (
  SELECT *, CASE WHEN {raw} IS NULL THEN NULL WHEN whole_type = 'OBJECT' THEN 'whole' WHEN whole_type = 'NULL' THEN 'empty'
    WHEN part IS NOT NULL THEN 'embedded' ELSE 'failed' END AS parse_kind FROM {out}_0),
{out}_2 AS (
  SELECT *, CASE parse_kind WHEN 'whole' THEN {raw} WHEN 'embedded' THEN part ELSE '{{}}' END AS js FROM {out}_1),
{out} AS (
  SELECT * EXCLUDE (whole_type, part),
    CASE WHEN parse_kind = 'failed' THEN {lit(fv.PARSE_FAILED)}
      WHEN json_type(js, '$.root_cause') = 'VARCHAR' THEN json_extract_string(js, '$.root_cause') ELSE '' END AS root_cause,
    CASE WHEN parse_kind = 'failed' THEN {raw}
      WHEN json_type(js, '$.analysis_process') = 'VARCHAR' THEN json_extract_string(js, '$.analysis_process')
      ELSE '' END AS analysis_process,
    CASE WHEN json_type(js, '$.solution_steps') = 'ARRAY' THEN list_transform(
      json_extract(js, '$.solution_steps[*]'),
      lambda v: CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') ELSE '' END)
      ELSE CAST([] AS VARCHAR[]) END AS solution_steps,
    CASE WHEN json_type(js, '$.confidence') IN ('DOUBLE', 'BIGINT', 'UBIGINT')
      THEN CAST(json_extract(js, '$.confidence') AS DOUBLE) ELSE 0.0 END AS confidence
  FROM {out}_2)"""


STRATEGY = "(CASE WHEN upper({s}) IN ('ZERO_SHOT', 'FEW_SHOT', 'COT') THEN upper({s}) ELSE 'FEW_SHOT' END)"


def strategy(name: str) -> str:
    return STRATEGY.replace("{s}", name)


PACKED = f"""
packed AS (
  SELECT f.qid, count(*) AS n_hits, string_agg(CAST(f.id AS VARCHAR), ',' ORDER BY hit_rank) AS retrieved_doc_ids,
    {lit(pr.ARTICLES_TITLE)} || chr(10) || string_agg(concat('- [案例', f.id, '] ', title, ': ', content), chr(10)
      ORDER BY hit_rank) AS block
  FROM final f JOIN kb ON kb.id = f.id GROUP BY f.qid)"""


def prompt(strategy_col: str, log: str, block: str) -> str:
    log_part = f"{lit(pr.LOG_TITLE)} || chr(10) || {log}"

    def layout(name: str) -> str:
        parts = [log_part if b == "log" else block if b == "articles" else lit(b) for b in pr.LAYOUTS[name]]
        return f"concat_ws(chr(10) || chr(10), {', '.join(parts)})"

    return (
        f"(CASE {strategy_col} WHEN 'ZERO_SHOT' THEN {layout('ZERO_SHOT')} WHEN 'COT' THEN {layout('COT')} "
        f"ELSE {layout('FEW_SHOT')} END)"
    )


# --- article texts -------------------------------------------------------------------------------

def category_of(errors: str) -> str:
    rules = [(w, c) for c, w in fv.CATEGORY_WORDS.items()]
    return first_rule(f"upper(array_to_string({errors}, ' '))", rules, fv.LEARNED_CATEGORY)


def trigger_of(words: str) -> str:
    return first_rule(f"lower(array_to_string({words}, ' '))", fv.TRIGGER_RULES, fv.TRIGGER_DEFAULT)


def solution_of(words: str) -> str:
    return first_rule(f"lower(array_to_string({words}, ' '))", fv.SOLUTION_RULES, fv.SOLUTION_DEFAULT)


def impact_of(category: str) -> str:
    cases = "".join(f" WHEN {lit(c)} THEN {lit(t)}" for c, t in fv.IMPACT_BY_CATEGORY.items())
    return f"(CASE {category}{cases} ELSE {lit(fv.IMPACT_DEFAULT)} END)"


def learned(cause: str, analysis: str, steps: str) -> str:
    a, b, c = fv.LEARNED_LABELS
    numbered = f"array_to_string(list_transform({steps}, lambda s, i: concat(i, '. ', s, chr(10))), '')"
    return f"concat({lit(a)}, {cause}, {lit(chr(10) * 2 + b)}, {analysis}, {lit(chr(10) * 2 + c + chr(10))}, {numbered})"


def seeded(category: str, cause: str, words: str, log: str) -> str:
    g, r, t, i, k, s, sample = fv.SEED_LABELS
    two = "chr(10), chr(10)"
    return (
        f"concat({lit(g)}, {category}, {two}, {lit(r)}, {cause}, {two}, {lit(t)}, {trigger_of(words)}, {two}, "
        f"{lit(i)}, {impact_of(category)}, {two}, {lit(k)}, array_to_string({words}, ', '), {two}, {lit(s)}, chr(10), "
        f"{solution_of(words)}, chr(10), {lit(sample)}, chr(10), {log})"
    )


def seed_title(category: str, cause: str) -> str:
    return f"concat('[', {category}, '] ', {clip(cause, fv.SEED_TITLE_CHARS)})"


# --- figures -------------------------------------------------------------------------------------

def figures(ok: str = "coalesce(error, '') = ''") -> list[tuple[str, str]]:
    n = f"count(*) FILTER ({ok})"
    good = f"count(*) FILTER (({ok}) AND is_correct)"

    def total(c: str) -> str:
        return f"coalesce(sum({c}) FILTER ({ok}), 0)"

    def mean(c: str) -> str:
        return f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE {total(f'CAST({c} AS DECIMAL(28,12))')}::DOUBLE / {n} END"

    def whole(c: str) -> str:
        return f"CASE WHEN {n} = 0 THEN 0 ELSE CAST({total(c)} AS BIGINT) // {n} END"

    return [
        ("total", n),
        ("correct", good),
        ("accuracy", f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE {good}::DOUBLE / {n} * 100 END"),
        ("avg_latency_ms", whole("latency_ms")),
        ("avg_confidence", mean("confidence")),
        ("avg_tokens", whole("tokens_used")),
        ("avg_knowledge", mean("knowledge_used")),
    ]
