"""The knowledge table, diagnosis history and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions import articles as art
from faultlens.functions import fixed_values as fv
from faultlens.functions.tagging import key_errors
from faultlens.functions.text import clip_chars, embed_text, log_fingerprint
from faultlens.functions.masking import mask
from faultlens.operators import embedding as emb, history as hist, knowledge as kn
from faultlens.operators.kept_table import BucketedTable
from faultlens.plans.catalog import sql as s
from faultlens.session import work_path
from faultlens.sources import files, views
from faultlens.sources.stage import stage

NOW = "2024-02-01 00:00:00"


def _now():
    return F.to_timestamp(F.lit(NOW))


def _kb(spark, d):
    return views.kb_text(spark, d)


def micros(vector):
    """Comparable form of a vector."""
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string")), ",")


def _table(df):
    """Comparable form of a knowledge table state."""
    return df.select(
        "id", "title", F.md5("content").alias("content_md5"), "category", "keywords", "symptoms",
        F.md5(micros(F.col("embedding"))).alias("embedding_md5"),
        F.col("updated_at").cast("string").alias("updated"),
    )


def _submitted(spark, d):
    """User turns as new articles; some lack a title or text."""
    turns = views.table(spark, d, "conversations").filter(F.col("role") == "user")
    conv = F.col("conv_id")
    return turns.select(
        F.when(conv % 9 == 0, "").otherwise(clip_chars(F.col("text"), fv.TITLE_CHARS)).alias("title"),
        F.when(conv % 10 == 0, None).otherwise(F.col("text")).alias("content"),
        F.col("role").alias("category"),
        views.fault(conv + F.col("turn")).alias("keywords"),
        views.fault(conv).alias("symptoms"),
    )


def _changes(spark, d):
    """Labelled articles get a new text; ids above the table are unknown."""
    shift = F.when(F.col("doc_id") % 5 == 0, F.lit(100000000)).otherwise(F.lit(0))
    return views.table(spark, d, "labels").select(
        (F.col("doc_id") + shift).alias("id"),
        F.concat(F.lit("checked "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("content"),
        F.lit("reviewed").alias("category"), F.lit("OOM").alias("keywords"), F.lit("").alias("symptoms"),
    )


def kb_scan(spark, d):
    return kn.kb_scan(_kb(spark, d)).select("id", "title", "category")


def kb_by_id(spark, d):
    return kn.kb_by_id(_kb(spark, d), 42)


def kb_by_category(spark, d):
    return kn.kb_by_category(_kb(spark, d), "src7").select("id", "title", "category")


def kb_search(spark, d):
    found = kn.kb_search(_kb(spark, d), "disk")
    wild = kn.kb_search(_kb(spark, d), "o_t of m%y")
    return found.select("id", F.lit("disk").alias("keyword")).unionByName(wild.select("id", F.lit("o_t of m%y").alias("keyword")))


def kb_page(spark, d):
    rows, total = kn.kb_page(_kb(spark, d), "memory", page=2, size=7)
    first, _ = kn.kb_page(_kb(spark, d), "", page=0, size=1000)
    named = lambda df, name: df.select(F.lit(name).alias("part"), F.col("id").alias("value"))
    return named(rows, "page2").unionByName(named(first, "page1")).unionByName(
        total.select(F.lit("total").alias("part"), F.col("total").alias("value"))
    )


def kb_missing_embedding(spark, d):
    return kn.kb_missing_embedding(views.kb_state(spark, d)).select("id", "title")


def kb_embedding_count(spark, d):
    return kn.kb_embedding_count(views.kb_state(spark, d))


def kb_count(spark, d):
    return kn.kb_count(_kb(spark, d))


def kb_valid_rows(spark, d):
    rows = _submitted(spark, d)
    keep = ["title", "content", "keywords"]
    return kn.kb_valid_rows(rows).select(*keep, F.lit(True).alias("accepted")).unionByName(
        kn.kb_rejected_rows(rows).select(*keep, F.lit(False).alias("accepted"))
    )


def kb_insert(spark, d):
    return _table(kn.kb_insert(views.kb_state(spark, d), _submitted(spark, d), now=_now()))


def kb_update(spark, d):
    return _table(kn.kb_update(views.kb_state(spark, d), _changes(spark, d), now=_now()))


def kb_bucketed(spark, d):
    """Update, delete and backfill in the bucketed table, one after the other."""
    kept = BucketedTable(spark, work_path(spark, "kept-table"), 16)
    kept.create(views.kb_state(spark, d))
    kept.update(_changes(spark, d), now=_now())
    kept.delete(_changes(spark, d).filter("id % 10 = 3"))
    kept.backfill()
    return _table(kept.read())


def kb_update_rejects(spark, d):
    return kn.kb_update_rejects(_kb(spark, d), _changes(spark, d)).select("id", "title")


def kb_delete(spark, d):
    return _table(kn.kb_delete(views.kb_state(spark, d), _changes(spark, d)))


def kb_backfill(spark, d):
    return _table(kn.kb_backfill(views.kb_state(spark, d)))


def embed_report(spark, d):
    before = views.kb_state(spark, d)
    return emb.embed_report(before, kn.kb_backfill(before))


def kb_seed(spark, d):
    """Seeds an empty part of the table, then once more: the second run must add nothing."""
    kb, cases = views.kb_state(spark, d), stage(views.cases(spark, d), "cases")  # read for keys and for texts, in both runs
    version = files.write_version(kn.kb_seed(kb, cases, now=_now()), work_path(spark, "kb"), 1)
    again = kn.kb_seed(spark.read.parquet(version), cases, now=_now())
    return _table(again)


def history_append(spark, d):
    logs = views.raw_logs(spark, d).select(
        log_fingerprint(mask(F.col("content"))).alias("original_hash"), F.col("content").alias("processed_text"),
        F.lit("1,2").alias("retrieved_doc_ids"), views.fault(F.col("log_id")).alias("root_cause"),
        F.lit("").alias("analysis_process"), F.array(F.lit("restart")).alias("solution_steps"),
        F.lit(0.5).alias("confidence"), F.lit(fv.MODEL_NAME).alias("model_used"), F.upper("strategy").alias("strategy"),
        F.lit(7).alias("total_tokens"), F.lit(9).alias("latency_ms"),
    )
    path = work_path(spark, "history")
    rows = hist.history_rows(logs, hist.stable_session_id(F.col("original_hash"), F.col("strategy")), _now())
    files.append(rows, path)
    return spark.read.parquet(path).select(
        "session_id", "log_hash", "log_snippet", "retrieved_doc_ids",
        F.to_json("diagnosis_result").alias("diagnosis"), "model_used", "prompt_strategy", "total_tokens", "latency_ms",
        F.col("created_at").cast("string").alias("created"),
    )


def feedback_append(spark, d):
    given = views.feedback(spark, d).withColumn("feedback", F.when(F.length("session_id") % 2 == 0, F.col("feedback")).otherwise(F.col("feedback") * 2))
    path = work_path(spark, "feedback")
    files.append(hist.valid_feedback(given, _now()), path)
    return spark.read.parquet(path).select(
        "session_id", F.col("feedback").cast("int").alias("feedback"), "user_comment", F.col("created_at").cast("string").alias("created")
    )


def feedback_stats(spark, d):
    return hist.feedback_stats(views.feedback(spark, d))


def history_by_session(spark, d):
    return hist.history_by_session(views.history(spark, d), "session-42").select("id", "session_id", "log_hash", "prompt_strategy")


def history_page(spark, d):
    rows, total = hist.history_page(views.history(spark, d), page=3, size=25)
    return rows.select(F.lit("page3").alias("part"), F.col("id").alias("value")).unionByName(
        total.select(F.lit("total").alias("part"), F.col("total").alias("value"))
    )


def hash_lookup(spark, d):
    """Documents looked up among the diagnoses of the labelled documents (texts repeat in this table)."""
    docs = views.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("original_hash"))
    known = views.history(spark, d).join(
        views.table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi"
    )
    found = hist.hash_lookup(docs, known)
    return found.select("doc_id", "history_id", F.col("cached_result.root_cause").alias("cached_cause"))


def hash_lookup_24h(spark, d):
    """Event lines looked up among the diagnoses, at most a day old, of every fifth line."""
    body = mask(F.substring("line", 21, 1 << 30))
    lines = stage(views.event_lines(views.table(spark, d, "events")).select(F.sha2(body, 256).alias("original_hash"), "ts", "event_id"), "lines")
    known = lines.filter("event_id % 5 = 0").select(
        F.col("event_id").alias("id"), F.col("original_hash").alias("log_hash"), F.col("ts").alias("created_at"),
        views.fault(F.col("event_id")).alias("diagnosis_result"),
    )
    return hist.lookup_within(lines, known).select("event_id", "history_id", "cached_result")


def kb_page_keyset(spark, d):
    """The second and third page of history, each from the last row of the page before."""
    order, rows = ["created_at", "id"], views.history(spark, d).select("created_at", "id")
    after, parts = None, []
    for name in ("page1", "page2", "page3"):
        page = stage(kn.page_after(rows, order, after, 15).withColumn("part", F.lit(name)), "history-page")
        last = page.orderBy("created_at", "id").first()
        after = after if last is None else (last["created_at"], last["id"])
        parts.append(page.select("part", "id"))
    return parts[1].unionByName(parts[2])


def diagnosis_json(spark, d):
    from faultlens.functions.answers import diagnosis_from_json, diagnosis_to_json

    stored = views.history(spark, d).select("id", diagnosis_to_json(F.col("diagnosis_result")).alias("js"))
    back = stored.select("id", diagnosis_from_json(F.col("js")).alias("r"))
    return back.select(
        "id", "r.root_cause", "r.analysis_process", F.array_join("r.solution_steps", "|").alias("steps"), "r.confidence"
    )


def dedup_24h(spark, d):
    body = mask(F.substring("line", 21, 1 << 30))
    lines = views.event_lines(views.table(spark, d, "events")).select(
        F.sha2(body, 256).alias("log_hash"), "ts", F.col("event_id").alias("log_id")
    )
    return hist.first_per_day(lines).select("log_hash", "log_id", F.substring(F.col("ts").cast("string"), 1, 19).alias("ts"))


def _errors(spark, d):
    return views.raw_logs(spark, d).select("log_id", key_errors(F.col("content")).alias("key_errors"))


def infer_category(spark, d):
    return _errors(spark, d).select("log_id", art.infer_category(F.col("key_errors")).alias("category"))


def _case_text(name, build):
    def query(spark, d):
        return views.cases(spark, d).select("id", build().alias(name))

    return query


def embed_text_query(spark, d):
    return _kb(spark, d).select("id", F.md5(embed_text(F.col("title"), F.col("content"))).alias("text_md5"))


def learned_content(spark, d):
    r = F.col("diagnosis_result")
    return views.history(spark, d).select("id", art.learned_content(r["root_cause"], r["analysis_process"], r["solution_steps"]).alias("content"))


QUERIES = {
    "kb_scan": kb_scan,
    "kb_by_id": kb_by_id,
    "kb_by_category": kb_by_category,
    "kb_search": kb_search,
    "kb_page": kb_page,
    "kb_missing_embedding": kb_missing_embedding,
    "kb_embedding_count": kb_embedding_count,
    "kb_count": kb_count,
    "kb_valid_rows": kb_valid_rows,
    "kb_insert": kb_insert,
    "kb_update": kb_update,
    "kb_bucketed": kb_bucketed,
    "kb_update_rejects": kb_update_rejects,
    "kb_delete": kb_delete,
    "kb_backfill": kb_backfill,
    "embed_report": embed_report,
    "kb_seed": kb_seed,
    "history_append": history_append,
    "feedback_append": feedback_append,
    "feedback_stats": feedback_stats,
    "history_by_session": history_by_session,
    "history_page": history_page,
    "hash_lookup": hash_lookup,
    "hash_lookup_24h": hash_lookup_24h,
    "kb_page_keyset": kb_page_keyset,
    "diagnosis_json": diagnosis_json,
    "dedup_24h": dedup_24h,
    "infer_category": infer_category,
    "infer_trigger": _case_text("trigger_text", lambda: art.infer_trigger(F.col("expected_keywords"))),
    "infer_impact": _case_text("impact_text", lambda: art.infer_impact(F.col("category"))),
    "infer_solution": _case_text("solution_text", lambda: art.infer_solution(F.col("expected_keywords"))),
    "seed_title": _case_text("title", lambda: art.seed_title(F.col("category"), F.col("expected_root_cause"))),
    "seed_content": _case_text("content", lambda: art.seed_content(
        F.col("category"), F.col("expected_root_cause"), F.col("expected_keywords"), F.col("log"))),
    "embed_text": embed_text_query,
    "learned_content": learned_content,
}

_W = s.with_
_FIELDS = "title, content, category, keywords, symptoms"
_SUBMITTED = f"""
submitted AS (
  SELECT CASE WHEN conv_id % 9 = 0 THEN '' ELSE {s.clip('text', fv.TITLE_CHARS)} END AS title,
    CASE WHEN conv_id % 10 = 0 THEN NULL ELSE text END AS content, role AS category,
    {s.fault('conv_id + turn')} AS keywords, {s.fault('conv_id')} AS symptoms
  FROM conversations WHERE role = 'user')"""
_CHANGES = """
changes AS (
  SELECT doc_id + CASE WHEN doc_id % 5 = 0 THEN 100000000 ELSE 0 END AS id, concat('checked ', doc_id) AS title,
    concat('quality ', quality) AS content, 'reviewed' AS category, 'OOM' AS keywords, '' AS symptoms FROM labels)"""
_OLD = "'2024-01-01 00:00:00'"


def _state(source: str, updated: str = _OLD) -> str:
    return (f"SELECT id, title, md5(content) AS content_md5, category, keywords, symptoms, "
            f"md5({s.micros('embedding')}) AS embedding_md5, {updated} AS updated FROM {source}")


def _embedded(source: str, out: str = "fresh") -> str:
    """CTE ``out``: the rows of a relation without vectors, with the hashed one."""
    return f"""
{out}_text AS (SELECT id, title || chr(10) || content AS txt FROM {source}),
{s.hashed(f'{out}_text', 'id', 'txt', f'{out}_vec').strip()},
{out} AS (SELECT s.*, v.embedding FROM {source} s LEFT JOIN {out}_vec v ON v.id = s.id)"""


def _filled(source: str) -> str:
    """CTE ``filled``: a relation whose missing vectors are filled in."""
    return f"""
todo AS (SELECT * EXCLUDE (embedding) FROM {source} WHERE embedding IS NULL),{_embedded('todo', 'done')},
filled AS (SELECT * FROM {source} WHERE embedding IS NOT NULL UNION ALL BY NAME SELECT * FROM done)"""


def _numbered(source: str) -> str:
    return f"""
numbered AS (
  SELECT *, (SELECT max(id) FROM kb) + row_number() OVER (
    ORDER BY md5(concat_ws(chr(1), {_FIELDS}))) AS id FROM {source})"""


ORACLE = {
    "kb_scan": _W(s.KB) + "SELECT id, title, category FROM kb ORDER BY id DESC",
    "kb_by_id": _W(s.KB) + "SELECT * FROM kb WHERE id = 42",
    "kb_by_category": _W(s.KB) + "SELECT id, title, category FROM kb WHERE category = 'src7' ORDER BY id DESC",
    "kb_search": _W(s.KB) + "SELECT id, k AS keyword FROM kb, (VALUES ('disk'), ('o_t of m%y')) v(k) WHERE "
    + " OR ".join(f"{c} LIKE '%' || k || '%'" for c in ["title", "content", "keywords", "symptoms", "category"]),
    "kb_page": _W(s.KB, "found AS (SELECT * FROM kb WHERE " + " OR ".join(
        f"{c} LIKE '%memory%'" for c in ["title", "content", "keywords", "symptoms", "category"]) + ")")
    + """SELECT 'page2' AS part, id AS value FROM (SELECT id FROM found ORDER BY id DESC LIMIT 7 OFFSET 7)
UNION ALL SELECT 'page1', id FROM (SELECT id FROM kb ORDER BY id DESC LIMIT 20)
UNION ALL SELECT 'total', count(*) FROM found""",
    "kb_missing_embedding": _W(s.KB_STATE) + "SELECT id, title FROM kb_state WHERE embedding IS NULL",
    "kb_embedding_count": _W(s.KB_STATE) + "SELECT count(embedding) AS n_embedded FROM kb_state",
    "kb_count": "SELECT count(*) AS n_articles FROM documents",
    "kb_valid_rows": _W(_SUBMITTED) + "SELECT title, content, keywords, title <> '' AND coalesce(content, '') <> '' AS accepted FROM submitted",
    "kb_insert": _W(s.KB_STATE, _SUBMITTED,
                    "good AS (SELECT * FROM submitted WHERE title <> '' AND content <> '')", _numbered("good"), _embedded("numbered"))
    + _state("kb_state") + " UNION ALL " + _state("fresh", f"'{NOW}'"),
    "kb_update": _W(s.KB_STATE, _CHANGES, _embedded("changes"), """
j AS (SELECT k.id, coalesce(c.title, k.title) AS title, coalesce(c.content, k.content) AS content,
  coalesce(c.category, k.category) AS category, coalesce(c.keywords, k.keywords) AS keywords,
  coalesce(c.symptoms, k.symptoms) AS symptoms, c.id IS NOT NULL AS hit,
  coalesce(c.embedding, k.embedding) AS embedding FROM kb_state k LEFT JOIN fresh c ON c.id = k.id)""")
    + _state("j", f"CASE WHEN hit THEN '{NOW}' ELSE {_OLD} END"),
    "kb_bucketed": _W(s.KB_STATE, _CHANGES, _embedded("changes"), """
j AS (SELECT k.id, coalesce(c.title, k.title) AS title, coalesce(c.content, k.content) AS content,
  coalesce(c.category, k.category) AS category, coalesce(c.keywords, k.keywords) AS keywords,
  coalesce(c.symptoms, k.symptoms) AS symptoms, c.id IS NOT NULL AS hit, coalesce(c.embedding, k.embedding) AS embedding
  FROM kb_state k LEFT JOIN fresh c ON c.id = k.id WHERE k.id NOT IN (SELECT id FROM changes WHERE id % 10 = 3))""", _filled("j"))
    + _state("filled", f"CASE WHEN hit THEN '{NOW}' ELSE {_OLD} END"),
    "kb_update_rejects": _W(s.KB, _CHANGES) + "SELECT id, title FROM changes WHERE id NOT IN (SELECT id FROM kb)",
    "kb_delete": _W(s.KB_STATE, _CHANGES) + _state("kb_state") + " WHERE id NOT IN (SELECT id FROM changes)",
    "kb_backfill": _W(s.KB_STATE, _filled("kb_state")) + _state("filled"),
    "embed_report": _W(s.KB_STATE) + f"""SELECT count(*) FILTER (len({s.tok('content')}) > 0) AS success,
  count(*) FILTER (len({s.tok('content')}) = 0) AS failed FROM kb_state WHERE embedding IS NULL""",
    "kb_seed": _W(s.KB_STATE, s.CASES, f"""
seeds AS (SELECT DISTINCT {s.seed_title('category', 'expected_root_cause')} AS title,
  {s.seeded('category', 'expected_root_cause', 'expected_keywords', 'log')} AS content, category,
  array_to_string(expected_keywords, ',') AS keywords, array_to_string(expected_keywords, ',') AS symptoms FROM cases)""",
                  _numbered("seeds"), _embedded("numbered"), _filled("kb_state"))
    + _state("filled") + " UNION ALL " + _state("fresh", f"'{NOW}'"),
    "history_append": _W(s.LOGS, f"h AS (SELECT *, sha256({s.mask('content')}) AS log_hash FROM logs)") + f"""
SELECT substr(sha256(concat_ws('|', log_hash, upper(strategy))), 1, 36) AS session_id, log_hash,
  {s.clip('content', fv.SNIPPET_CHARS)} AS log_snippet, '1,2' AS retrieved_doc_ids,
  concat('{{"root_cause":"', {s.fault('log_id')}, '","analysis_process":"","solution_steps":["restart"],"confidence":0.5}}') AS diagnosis,
  {s.lit(fv.MODEL_NAME)} AS model_used, upper(strategy) AS prompt_strategy, CAST(7 AS BIGINT) AS total_tokens,
  CAST(9 AS BIGINT) AS latency_ms, '{NOW}' AS created FROM h""",
    "feedback_append": f"""SELECT session_id, feedback, user_comment, '{NOW}' AS created FROM (
  SELECT concat('session-', doc_id) AS session_id,
    CASE WHEN length(concat('session-', doc_id)) % 2 = 0 THEN quality ELSE quality * 2 END AS feedback,
    CASE WHEN toxic = 1 THEN 'rude answer' ELSE '' END AS user_comment FROM labels) WHERE feedback IN (0, 1)""",
    "feedback_stats": """SELECT count(*) FILTER (quality = 1) AS feedback_correct,
  count(*) FILTER (quality = 0) AS feedback_incorrect FROM labels""",
    "history_by_session": _W(s.HISTORY) + """SELECT id, session_id, log_hash, prompt_strategy FROM history
WHERE session_id = 'session-42' ORDER BY id LIMIT 1""",
    "history_page": _W(s.HISTORY) + """SELECT 'page3' AS part, id AS value FROM (
  SELECT id FROM history ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50)
UNION ALL SELECT 'total', count(*) FROM history""",
    "hash_lookup": _W(s.HISTORY, """
known AS (SELECT * FROM history WHERE id IN (SELECT doc_id FROM labels)),
firsts AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY log_hash ORDER BY id) = 1)""")
    + """SELECT d.doc_id, f.id AS history_id, f.root_cause AS cached_cause
FROM documents d LEFT JOIN firsts f ON f.log_hash = sha256(d.text)""",
    "hash_lookup_24h": _W(s.LINES, f"""
h AS (SELECT sha256({s.mask('substr(line, 21)')}) AS log_hash, ts, event_id FROM lines)""") + f"""
SELECT h.event_id, k.event_id AS history_id, CASE WHEN k.event_id IS NOT NULL THEN {s.fault('k.event_id')} END AS cached_result
FROM h LEFT JOIN (SELECT * FROM h WHERE event_id % 5 = 0) k ON k.log_hash = h.log_hash AND k.ts <= h.ts AND k.ts >= h.ts - INTERVAL 24 HOURS
QUALIFY row_number() OVER (PARTITION BY h.event_id ORDER BY k.ts DESC, k.event_id DESC) = 1""",
    "kb_page_keyset": _W(s.HISTORY) + """SELECT CASE WHEN r <= 30 THEN 'page2' ELSE 'page3' END AS part, id FROM (
  SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS r FROM history) WHERE r > 15 AND r <= 45""",
    "diagnosis_json": _W(s.HISTORY) + """SELECT id, root_cause, analysis_process,
  array_to_string(solution_steps, '|') AS steps, confidence FROM history""",
    "dedup_24h": _W(s.LINES, f"""
h AS (SELECT sha256({s.mask('substr(line, 21)')}) AS log_hash, ts, event_id FROM lines),
g AS (SELECT *, lag(ts) OVER (PARTITION BY log_hash ORDER BY ts, event_id) AS seen FROM h)""")
    + """SELECT log_hash, event_id AS log_id, substr(CAST(ts AS VARCHAR), 1, 19) AS ts FROM g
WHERE seen IS NULL OR ts > seen + INTERVAL 24 HOURS""",
    "infer_category": _W(s.LOGS) + f"SELECT log_id, {s.category_of(s.key_errors('content'))} AS category FROM logs",
    "infer_trigger": _W(s.CASES) + f"SELECT id, {s.trigger_of('expected_keywords')} AS trigger_text FROM cases",
    "infer_impact": _W(s.CASES) + f"SELECT id, {s.impact_of('category')} AS impact_text FROM cases",
    "infer_solution": _W(s.CASES) + f"SELECT id, {s.solution_of('expected_keywords')} AS solution_text FROM cases",
    "seed_title": _W(s.CASES) + f"SELECT id, {s.seed_title('category', 'expected_root_cause')} AS title FROM cases",
    "seed_content": _W(s.CASES)
    + f"SELECT id, {s.seeded('category', 'expected_root_cause', 'expected_keywords', 'log')} AS content FROM cases",
    "embed_text": _W(s.KB) + "SELECT id, md5(title || chr(10) || content) AS text_md5 FROM kb",
    "learned_content": _W(s.HISTORY) + f"SELECT id, {s.learned('root_cause', 'analysis_process', 'solution_steps')} AS content FROM history",
}
