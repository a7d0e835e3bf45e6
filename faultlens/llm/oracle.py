"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from faultlens.llm import decontam, mixing, resample, rules, sharding

_BLANKS = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _hash32(*parts: str) -> str:
    joined = " || ':' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT)"


def _components(nodes: str, links: str) -> str:
    """CTE comp(node, component) over nodes(node) and links(a, b)."""
    return f"""sym AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
reach(x, y) AS (SELECT node, node FROM {nodes} UNION SELECT r.x, s.b FROM reach r JOIN sym s ON r.y = s.a),
comp AS (SELECT x AS node, min(y) AS component FROM reach GROUP BY x)"""


def near_duplicates(shingle: int, percent: int) -> str:
    window = " || ' ' || ".join(f"ws[i + {j}]" for j in range(shingle))
    return f"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BLANKS}'), lambda x: x <> '') AS ws
  FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {shingle} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {shingle} + 2), lambda i: {window}) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
nodes AS (SELECT doc_id AS node FROM documents),
{_components("nodes", "links")}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component AS component_id, d.doc_id = component AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON node = d.doc_id"""


def similar_vectors(threshold: float) -> str:
    return f"""WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
nodes AS (SELECT vec_id AS node FROM embeddings),
{_components("nodes", "links")},
deg AS (SELECT a, count(*) AS n FROM sym GROUP BY a)
SELECT e.vec_id, coalesce(deg.n, 0) AS n_links, component AS component_id, e.vec_id = component AS kept
FROM embeddings e LEFT JOIN deg ON deg.a = e.vec_id JOIN comp ON node = e.vec_id"""


def overlaps() -> str:
    def seeds(name: str, source: str, key: str) -> str:
        parts = []
        for number, mask in enumerate(decontam.MASKS):
            words = " || ' ' || ".join(f"ws[i + {j}]" for j, c in enumerate(mask) if c == "1")
            parts.append(f"SELECT {key}, i, '{number} ' || {words} AS seed FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {len(mask)} + 2)) AS i FROM {source})")
        return f"{name} AS (" + " UNION ALL ".join(parts) + ")"

    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""WITH d AS (SELECT doc_id, {words} AS ws FROM documents),
b AS (SELECT item_id, {words} AS ws FROM benchmark),
{seeds("ds", "d", "doc_id")}, {seeds("bs", "b", "item_id")},
diag AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS shift FROM ds JOIN bs USING (seed)),
cells AS (SELECT doc_id, item_id, shift, dws, iws, unnest(range(greatest(1, 1 - shift), least(len(iws), len(dws) - shift) + 1)) AS i
  FROM (SELECT diag.*, d.ws AS dws, b.ws AS iws FROM diag JOIN d USING (doc_id) JOIN b USING (item_id))),
sums AS (SELECT doc_id, item_id, shift, i, len(iws) AS n_item, CAST(dws[i + shift] = iws[i] AS INT) AS same,
  sum(CASE WHEN dws[i + shift] = iws[i] THEN 1 ELSE -{decontam.PENALTY} END) OVER (PARTITION BY doc_id, item_id, shift ORDER BY i) AS upto FROM cells),
best AS (SELECT s.doc_id, s.item_id, s.shift, s.n_item, s.i AS first, e.i AS last,
    e.upto - s.upto + CASE WHEN s.same = 1 THEN 1 ELSE -{decontam.PENALTY} END AS score
  FROM sums s JOIN sums e ON s.doc_id = e.doc_id AND s.item_id = e.item_id AND s.shift = e.shift AND s.i <= e.i
  QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.item_id, s.shift ORDER BY score DESC, e.i, s.i DESC) = 1),
found AS (SELECT doc_id, item_id, first - 1 + shift AS doc_start, first - 1 AS item_start, last - first + 1 AS n_words,
    (score + {decontam.PENALTY} * (last - first + 1)) // {decontam.PENALTY + 1} AS n_matches
  FROM best WHERE last - first + 1 >= least({decontam.MIN_WORDS}, n_item))
SELECT doc_id, item_id, CAST(doc_start AS INT) AS doc_start, CAST(item_start AS INT) AS item_start, CAST(n_words AS INT) AS n_words,
  CAST(n_matches AS INT) AS n_matches FROM found
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matches DESC, doc_start, item_start, n_words DESC) = 1"""


def mixing_sql(target_entropy: float = 0.95, max_repetition: float = 4.0, seed: int = 7) -> str:
    power = lambda e: f"list_transform(ps, lambda p: pow(p, {e}))"
    entropy = lambda e: f"(ln(list_sum({power(e)})) - list_sum(list_transform({power(e)}, lambda a: a * ln(a))) / list_sum({power(e)}))"
    # passes over a source at the smallest budget that covers all: shares relative to the largest need
    needs = lambda e: f"list_transform(ps, lambda p: pow(p, {e}) / p)"
    repetition = lambda e: f"(list_max({needs(e)}) / list_min({needs(e)}))"
    return f"""WITH RECURSIVE t AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS skey,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '')) AS n FROM documents),
s AS (SELECT skey, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY skey),
ps AS (SELECT list(CAST(n AS DOUBLE) / total) AS ps, {target_entropy} * ln(count(*)) AS goal
  FROM (SELECT n, sum(n) OVER () AS total FROM s WHERE n > 0)),
r1(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN {entropy("(lo + hi) / 2")} >= goal THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN {entropy("(lo + hi) / 2")} >= goal THEN hi ELSE (lo + hi) / 2 END FROM r1, ps WHERE i < {mixing.STEPS}),
e1 AS (SELECT CASE WHEN len(ps) < 2 OR {entropy("1.0")} >= goal THEN 1.0::DOUBLE ELSE lo END AS e FROM r1, ps WHERE i = {mixing.STEPS}),
r2(i, lo, hi) AS (SELECT 0, e, 1.0::DOUBLE FROM e1 UNION ALL
  SELECT i + 1, CASE WHEN {repetition("(lo + hi) / 2")} <= {max_repetition} THEN lo ELSE (lo + hi) / 2 END,
    CASE WHEN {repetition("(lo + hi) / 2")} <= {max_repetition} THEN (lo + hi) / 2 ELSE hi END FROM r2, ps WHERE i < {mixing.STEPS}),
e2 AS (SELECT CASE WHEN {repetition("e")} > {max_repetition} THEN hi ELSE e END AS e FROM r2, e1, ps WHERE i = {mixing.STEPS}),
w AS (SELECT skey, n, CASE WHEN n > 0 THEN pow(CAST(n AS DOUBLE) / sum(n) OVER (), e) ELSE 0 END AS p FROM s, e2),
w2 AS (SELECT skey, n, p / sum(p) OVER () AS w FROM w),
w3 AS (SELECT skey, n, w, max(CASE WHEN n > 0 THEN n / w END) OVER () AS budget FROM w2),
plan AS (SELECT skey, n, w, CAST(round_even(w * budget, 0) AS BIGINT) AS goal,
  greatest(1, (n + {mixing.BLOCK_TOKENS - 1}) // {mixing.BLOCK_TOKENS}) AS n_blocks FROM w3),
plan2 AS (SELECT *, CASE WHEN n > 0 THEN goal // n ELSE 1 END AS passes, CASE WHEN n > 0 THEN goal % n ELSE 0 END AS rest FROM plan),
k AS (SELECT t.*, w, passes, rest, {_hash32(f"'{seed}b'", "doc_id")} % n_blocks AS block,
  {_hash32(f"'{seed}d'", "doc_id")} AS doc_key FROM t JOIN plan2 USING (skey)),
k2 AS (SELECT *, {_hash32(f"'{seed}o'", "skey", "block")} AS block_key FROM k),
bl AS (SELECT skey, block, block_key, rest, sum(n) AS n FROM k2 GROUP BY ALL),
bl2 AS (SELECT *, sum(n) OVER (PARTITION BY skey ORDER BY block_key, block) AS after FROM bl),
cut AS (SELECT skey, block AS cut_block, block_key AS cut_key, rest - after + n AS room FROM bl2 WHERE after > rest
  QUALIFY row_number() OVER (PARTITION BY skey ORDER BY block_key, block) = 1),
k3 AS (SELECT k2.*, cut_block, cut_key, room,
  sum(CASE WHEN block = cut_block THEN k2.n END) OVER (PARTITION BY k2.skey, block ORDER BY doc_key, doc_id) AS upto FROM k2 LEFT JOIN cut USING (skey))
SELECT doc_id, source, CAST(n AS BIGINT) AS n_tokens, CAST(passes + CAST(coalesce(
    block_key < cut_key OR (block_key = cut_key AND block < cut_block) OR (block = cut_block AND upto <= room), false) AS INT) AS INT) AS copies,
  CAST(block AS BIGINT) AS block, round(w, 6) AS source_weight FROM k3"""


def shards(slots: int = sharding.SLOTS) -> str:
    """The placement; the table itself is filled by its rule and tested apart."""
    owners = ",".join(map(str, sharding.fill_table(SHARDS, slots)))
    return f"""WITH p AS (SELECT doc_id, source, {_hash32("doc_id")} % {slots} AS slot FROM documents),
o AS (SELECT [{owners}] AS owners)
SELECT doc_id, source, slot, CAST(owners[slot + 1] AS INT) AS shard FROM p, o"""


def resampling(buckets: int = resample.BUCKETS, seed: int = resample.SEED) -> str:
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    runs = ", ".join(
        f"list_transform(range(1, len(ws) - {k - 2}), lambda i: {" || ' ' || ".join(f'ws[i + {j}]' for j in range(k))})" for k in range(2, resample.ORDERS + 1)
    )
    as_double = lambda a, b: f"CAST({a} + 1 AS DOUBLE) * CAST(sum({b}) OVER () + {buckets} AS DOUBLE)"
    h = f"(CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)"
    return f"""WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
w AS (SELECT 'raw' AS side, doc_id, {words} AS ws FROM documents UNION ALL SELECT 'target', NULL, {words} FROM benchmark),
f AS (SELECT side, doc_id, unnest(list_concat(ws, {runs})) AS feature FROM w),
grouped AS (SELECT side, doc_id, feature, count(*) AS n FROM f GROUP BY ALL),
hashed AS (SELECT feature, xor(list_reduce(list_transform(regexp_extract_all(hex(feature), '..'), lambda b: CAST('0x' || b AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {buckets} AS bucket
  FROM (SELECT DISTINCT feature FROM f), crc_table),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'raw'), 0) AS s, coalesce(sum(n) FILTER (side = 'target'), 0) AS t
  FROM grouped JOIN hashed USING (feature) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln({as_double('t', 's')} / ({as_double('s', 't')}))) AS BIGINT) AS gain FROM counts),
x AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM grouped JOIN hashed USING (feature) JOIN gains USING (bucket)
  WHERE side = 'raw' GROUP BY doc_id),
r AS (SELECT w.doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln({h} / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN x ON x.doc_id = w.doc_id WHERE side = 'raw'),
p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, {resample.PERCENT} * count(*) OVER () // 100 AS n
  FROM r WHERE n_words >= {resample.MIN_WORDS})
SELECT r.doc_id, n_features, weight, score, CASE WHEN place <= n THEN place END AS rank, n_words FROM r LEFT JOIN p ON p.doc_id = r.doc_id"""


def quality_rules() -> str:
    blank, line = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    keys = "lang_key, source_key"
    bucket = f"value - value % CAST(pow(2, greatest(length(bin(value)) - {rules._BITS}, 0)) AS BIGINT)"
    values = " UNION ALL ".join(
        f"SELECT {keys}, '{name}' AS statistic, {factor} * {a} // {b} AS value FROM c WHERE NOT base_failed"
        for name, (a, b, factor, _, _) in rules.STATISTICS.items()
    )

    def level(i: int, by: str) -> str:
        return f"""l{i} AS (SELECT {by}statistic, max(total) AS total{i}, min(CASE WHEN 4 * upto >= total THEN bucket END) AS low{i},
    min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS high{i}
  FROM (SELECT *, sum(n) OVER (PARTITION BY {by}statistic ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}statistic) AS total
    FROM (SELECT {by}statistic, bucket, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY ALL)"""

    pick = lambda c: f"CASE WHEN total0 >= {rules.MIN_GROUP} THEN {c}0 WHEN total1 >= {rules.MIN_GROUP} THEN {c}1 ELSE {c}2 END"
    least = "CASE statistic " + " ".join(f"WHEN '{n}' THEN {x[3]}" for n, x in rules.STATISTICS.items()) + " END"
    broken = ", ".join(
        f"CASE WHEN {factor} * {a} // {b} > (SELECT high FROM cut WHERE cut.lang_key = c.lang_key AND cut.source_key = c.source_key AND statistic = '{name}')"
        + (f" OR {factor} * {a} // {b} < (SELECT low FROM cut WHERE cut.lang_key = c.lang_key AND cut.source_key = c.source_key AND statistic = '{name}')" if both else "")
        + f" THEN '{name}' END"
        for name, (a, b, factor, _, both) in rules.STATISTICS.items()
    )
    return f"""WITH w AS (SELECT doc_id, coalesce('=' || lang, 'null') AS lang_key, coalesce('=' || source, 'null') AS source_key, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{line}')) AS ls FROM documents),
t AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1), range(3) r(j) GROUP BY doc_id),
c AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM (
  SELECT w.doc_id, {keys}, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{blank}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id)),
sk AS (SELECT {keys}, statistic, {bucket} AS bucket, count(*) AS n FROM ({values}) GROUP BY ALL),
{level(0, keys + ", ")}, {level(1, "lang_key, ")}, {level(2, "")},
cut AS (SELECT {keys}, statistic, high + {rules.FENCE} * greatest(high - low, least) AS high, low - {rules.FENCE} * greatest(high - low, least) AS low
  FROM (SELECT {keys}, statistic, {pick("low")} AS low, {pick("high")} AS high, {least} AS least FROM l0 JOIN l1 USING (lang_key, statistic) JOIN l2 USING (statistic))),
j AS (SELECT c.*, CASE WHEN base_failed THEN 'base' ELSE concat_ws(',', {broken}) END AS failed_rules FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules = '' AS kept, failed_rules FROM j"""


ORACLE = {
    "op2_source_mixing": mixing_sql(),
    "op5_sharding": shards(),
    "op6_embedding_near_dedup": similar_vectors(0.98),
    "op9_minhash_near_dedup": near_duplicates(3, 85),
    "op10_decontamination": overlaps(),
    "op12_quality_rules": quality_rules(),
    "op13_importance_resampling": resampling(),
}
