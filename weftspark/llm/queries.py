"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocation, decontam, exactdup, jpeg, langid, mixing, neardup, repair, sharding, toxicity, urlfilter, warc

#: Fixed values of op8: verdict, host and path of each rule.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(_table(spark, sf_dir, "conversations"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_slots(_table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), least=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_features(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.duplicates(_table(spark, sf_dir, "documents"))


def op12_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(_table(spark, sf_dir, "documents"), least=30, percent=80, first=2000)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_language_id,
        op3_sharding,
        op4_warc,
        op5_media_columns,
        op6_mixing,
        op7_toxicity,
        op8_url_filters,
        op9_benchmark_decontamination,
        op10_minhash_near_dedup,
        op11_exact_dedup,
        op12_phrase_collocation,
        op13_conversation_repair,
    )
}

ORACLE: dict[str, str] = {}

ORACLE["op1_chat_formatting"] = """
WITH conv AS (
  SELECT conv_id, count(*) AS n,
         list(concat(CASE WHEN role IS NULL THEN 'r' ELSE '-' END, CASE WHEN text IS NULL THEN 't' ELSE '-' END, coalesce(role, ''), chr(0), coalesce(text, ''))
              ORDER BY turn NULLS FIRST, role NULLS FIRST, (text IS NULL), md5(coalesce(text, ''))) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
              ORDER BY turn NULLS FIRST, role NULLS FIRST, (text IS NULL), md5(coalesce(text, ''))) AS rendered
  FROM conversations GROUP BY conv_id)
SELECT a.conv_id, 0::BIGINT AS chunk, a.n::BIGINT AS n_turns, a.rendered
FROM conv a
WHERE NOT EXISTS (SELECT 1 FROM conv b WHERE b.turns[1] = a.turns[1] AND b.n > a.n AND b.turns[1:a.n] = a.turns)
  AND NOT EXISTS (SELECT 1 FROM conv b WHERE b.turns[1] = a.turns[1] AND b.n = a.n AND b.turns = a.turns AND (b.conv_id < a.conv_id OR (a.conv_id IS NULL AND b.conv_id IS NOT NULL)))
"""

ORACLE["op8_url_filters"] = """
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
cut AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT c.page_id, c.host, c.path, r.rhost || r.rpath AS rule, r.verdict, length(r.rhost || r.rpath) AS n
  FROM cut c LEFT JOIN rules r ON (c.host = r.rhost OR ends_with(c.host, '.' || r.rhost)) AND starts_with(c.path, r.rpath)),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC NULLS LAST) AS rn FROM fits)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE rn = 1
"""

ORACLE["op9_benchmark_decontamination"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
       FROM iw, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM ig),
dg AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM dw, ks, unnest(range(1, len(w) - k + 2)) AS u(i)),
hits AS (SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN ig USING (k, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n::BIGINT AS item_shingles, shared::BIGINT AS shared_shingles, shared::DOUBLE / n::DOUBLE AS containment
FROM hits JOIN sizes USING (item_id) WHERE shared >= ceil(0.8 * n - 1e-9)
"""

# The CRC's table is built by its rule.
_CRC = """crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
                          lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)) AS v
    FROM unnest(range(0, 256)) AS u(i)))"""

# Capacities are all sums of consecutive groups that can be the least one.
ORACLE["op3_sharding"] = f"""
WITH RECURSIVE {_CRC},
docs AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS key,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT) AS bytes FROM documents),
groups AS (SELECT key, sum(size)::BIGINT AS s FROM docs GROUP BY key),
run AS (SELECT key, s, sum(s) OVER (ORDER BY key)::BIGINT AS e FROM groups),
lim AS (SELECT max(e) AS total, greatest((max(e) + 15) // 16, max(s)) AS low, max(s) AS most FROM run),
cap AS (SELECT DISTINCT y.e - (x.e - x.s) AS c FROM run x JOIN lim ON true JOIN run y ON y.e - (x.e - x.s) BETWEEN lim.low AND lim.low + lim.most),
fill AS (
  SELECT c, 0 AS k, 0::BIGINT AS pos FROM cap
  UNION ALL
  SELECT f.c, f.k + 1, (SELECT max(e) FROM run WHERE e <= f.pos + f.c) FROM fill f, lim WHERE f.k < 16 AND f.pos < lim.total),
best AS (SELECT min(c) AS c FROM fill, lim WHERE pos = total),
cuts AS (SELECT pos FROM fill, best WHERE fill.c = best.c AND k > 0),
placed AS (SELECT r.key, (SELECT count(*) FROM cuts WHERE pos <= r.e - r.s)::INTEGER AS shard FROM run r),
cells AS (
  SELECT d.doc_id, d.size, d.key, d.bytes, p.shard, ('0x' || substr(md5(concat_ws(':', d.doc_id, d.key)), 1, 15))::BIGINT AS place
  FROM docs d JOIN placed p USING (key))
SELECT doc_id, size::BIGINT AS size,
       xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32,
       'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, key) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM cells, crc
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::INTEGER >> {shift}) & 31) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))
ORACLE["op4_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

ORACLE["op10_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM w, unnest(range(1, greatest(len(w), 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY x, y),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT e.x, reach.r FROM reach JOIN edges e ON e.y = reach.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, d.r AS component_id, d.doc_id = d.r AS kept
FROM (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) d LEFT JOIN n USING (doc_id)
"""

ORACLE["op11_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""

ORACLE["op12_phrase_collocation"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, w[i : i + k - 1] AS g FROM words, unnest(range(1, 5)) AS t(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE len(g) > 1 AND f >= 30),
cover AS (
  SELECT c.lang, c.g[s : s + m - 1] AS g, max(c.f) AS longer
  FROM cand c, unnest(range(2, len(c.g))) AS t(m), unnest(range(1, len(c.g) - m + 2)) AS u(s) GROUP BY ALL),
cuts AS (SELECT lang, g, f, k, g[1 : k] AS head, g[k + 1 :] AS tail FROM cand, unnest(range(1, len(g))) AS t(k)),
scores AS (
  SELECT c.lang, c.g, c.f, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f)::HUGEINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.head JOIN f y ON y.lang = c.lang AND y.g = c.tail),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
stay AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN cover c ON c.lang = b.lang AND c.g = b.g
  WHERE NOT coalesce(100::HUGEINT * c.longer >= 80::HUGEINT * b.f, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM stay)
SELECT lang, rank::BIGINT AS rank, phrase, f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def _repair_sql() -> str:
    """Cheapest edits by state (nothing yet, system, user, assistant), row after row: cost, audit, repaired text."""
    cell = lambda s, c, a, t="": f"{{'c': {s}.c + {c}, 'a': {s}.a || '{a}', 't': {s}.t || {t or chr(39) * 2}}}"
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    far = "{'c': 1000000000, 'a': '', 't': ''}"
    # insertions before a row
    closed_u = f"least(x.u, {cell('x.e', 5, 'I', user)}, {cell('x.s', 5, 'I', user)}, {cell('x.a', 5, 'I', user)})"
    both = "chr(10) || 'user:' || chr(10) || 'assistant:'"
    closed_a = f"least(x.a, {cell('x.u', 5, 'I', assistant)}, {cell('x.e', 10, 'II', both)}, {cell('x.s', 10, 'II', both)})"
    more = "CASE WHEN y.fault IN ('blank', 'duplicate') THEN 1000000000 WHEN y.fault = 'truncated' THEN 5 ELSE 0 END"
    keep = lambda s, i: f"CASE WHEN y.i = '{i}' THEN {cell(s, more, 'K', 'chr(10) || y.role || chr(58) || y.text')} ELSE {far} END"
    rerole = lambda s, role: cell(s, f"1 + {more}", "R", f"chr(10) || '{role}:' || y.text")
    to_u = ", ".join(f"{keep(s, 'u')}, {rerole(s, 'user')}" for s in ("z.e", "z.s", "z.a"))
    step = f"""{{'e': {cell('z.e', 2, 'D')}, 's': least({cell('z.s', 2, 'D')}, {keep('z.e', 's')}),
      'u': least({cell('z.u', 2, 'D')}, {to_u}), 'a': least({cell('z.a', 2, 'D')}, {keep('z.u', 'a')}, {rerole('z.u', 'assistant')})}}"""
    return rf"""
WITH RECURSIVE {_CRC},
harmed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::UBIGINT)),
                         lambda x, y: xor(x >> 8, t[(xor(x, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT % 20 AS harm FROM conversations, crc),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy FROM harmed WHERE harm <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n FROM rows_),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' END AS fault,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) || left(role, 1) AS pair
  FROM placed),
convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
         list({{'role': role, 'text': text, 'i': left(role, 1), 'fault': fault}} ORDER BY n) AS rows_ FROM faults GROUP BY conv_id),
parse(conv_id, k, rows_, x) AS (
  SELECT conv_id, 1, rows_, {{'e': {{'c': 0, 'a': '', 't': ''}}, 's': {far}, 'u': {far}, 'a': {far}}} FROM convs
  UNION ALL
  SELECT conv_id, k + 1, rows_, {step} FROM (
    SELECT conv_id, k, rows_, rows_[k] AS y, {{'e': x.e, 's': x.s, 'u': {closed_u}, 'a': {closed_a}}} AS z FROM parse WHERE k <= len(rows_))),
best AS (
  SELECT conv_id, least(x.e, x.a, {cell('x.u', 5, 'I', assistant)}, {cell('x.s', 10, 'II', both)}) AS b FROM parse WHERE k = len(rows_) + 1)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
       coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN convs c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
"""


ORACLE["op13_conversation_repair"] = _repair_sql()
