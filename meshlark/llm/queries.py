"""The registered queries of the operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(table(spark, sf_dir, "documents"))
    return out.withColumns({c: out[c].cast("decimal(12,6)").cast("double") for c in ("weight", "alpha")})


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup_exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).drop("locator")


def op3_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zip import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op7_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_text import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import render_chats

    return render_chats(table(spark, sf_dir, "conversations"))


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .alignment import align_tokens

    return align_tokens(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


ORACLES = {
    "op1_temperature_mixing": r"""
WITH RECURSIVE units AS (
  SELECT doc_id, source, coalesce('=' || source, '?') AS s, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) + 1 AS tokens, count(*) AS copies
  FROM documents GROUP BY ALL),
totals AS (SELECT s, sum(tokens * copies)::DOUBLE AS t FROM units GROUP BY s),
arr AS (SELECT list(t ORDER BY s) AS ts, sum(t) AS total FROM totals),
bis(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
          list_max([pow(x / total, (lo + hi) / 2 - 1) for x in ts]) / list_min([pow(x / total, (lo + hi) / 2 - 1) for x in ts]) <= 1.5 AS ok
        FROM bis, arr WHERE i < 60)),
al AS (SELECT hi AS alpha FROM bis WHERE i = 60),
raw AS (SELECT s, t, pow(t / (SELECT total FROM arr), alpha) AS pa, alpha FROM totals, al),
wts AS (SELECT s, t, alpha, pa / (SELECT sum(pa) FROM raw) AS weight,
          (SELECT max(t * z / pa) FROM raw, (SELECT sum(pa) AS z FROM raw)) AS budget FROM raw),
w AS (SELECT *, round(weight * budget)::BIGINT AS quota, greatest(1, ceil(budget / 65536))::BIGINT AS n_blocks FROM wts),
dealt AS (
  SELECT u.*, w.t, w.alpha, w.weight, w.quota, w.n_blocks, e.epoch,
    md5(concat_ws(':', '0', e.epoch::VARCHAR, coalesce(u.doc_id::VARCHAR, '-'), u.tokens::VARCHAR, u.s)) AS key
  FROM units u JOIN w USING (s), LATERAL (SELECT unnest(range(0, greatest(1, ceil(w.quota / w.t::DOUBLE)::BIGINT))) AS epoch) e),
placed AS (
  SELECT *, epoch * t + coalesce(sum(tokens * copies) OVER (PARTITION BY s, epoch ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM dealt),
blocked AS (SELECT *, least(n_blocks - 1, floor(start / quota * n_blocks))::BIGINT AS block_id FROM placed WHERE start < quota)
SELECT doc_id, source, epoch, (tokens * copies)::BIGINT AS tokens, copies, weight::DECIMAL(12,6)::DOUBLE AS weight, alpha::DECIMAL(12,6)::DOUBLE AS alpha, block_id,
  row_number() OVER (PARTITION BY block_id ORDER BY md5('b' || key), s, doc_id) - 1 AS slot FROM blocked""",
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_chat_snapshots": r"""
WITH c AS (
  SELECT conv_id, count(*) AS n, list((role, text) ORDER BY turn, role, text) AS turns,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations) GROUP BY conv_id, lone),
begun AS (SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM c, LATERAL (SELECT unnest(range(1, n)) AS k))
SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_equal, any_value(rendered) AS rendered FROM c
WHERE turns NOT IN (SELECT turns FROM begun) GROUP BY turns, n""",
}


ORACLES["op3_warc_packages"] = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, octet_length(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS keep FROM p),
c AS (SELECT *, array_to_string([['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', x[i])] for i in range(1, 41)], '') AS bits FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5*i+1]::INT + 8 * bits[5*i+2]::INT + 4 * bits[5*i+3]::INT + 2 * bits[5*i+4]::INT + bits[5*i+5]::INT] for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to FROM c"""

ORACLES["op4_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND list_max([abs(x) for x in e]) > 0 AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0),
l AS (SELECT DISTINCT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT x AS vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, x = c AS kept FROM c LEFT JOIN n USING (x)"""

ORACLES["op8_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, 1 + CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - 4) END)) AS i)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE k / (a.n + b.n - k)::DOUBLE >= 0.8),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x),
m AS (SELECT x, count(*) AS m FROM l GROUP BY x),
e AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS set_id FROM n)
SELECT d.doc_id, c AS class_id, coalesce(e.set_id, d.doc_id) AS set_id, coalesce(m, 0)::BIGINT AS n_links, d.doc_id = c AS kept
FROM d JOIN c ON d.doc_id = c.x LEFT JOIN m ON d.doc_id = m.x LEFT JOIN e ON d.doc_id = e.doc_id"""


ORACLES["op12_prefix_trie"] = r"""
WITH hexed AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r FROM hexed),
tab(b, v) AS (SELECT b, b FROM range(256) x(b)),
step AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM tab),
s2 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM step),
s3 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM s2),
s4 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM s3),
s5 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM s4),
s6 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM s5),
s7 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM s6),
s8 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM s7),
crcs AS (SELECT list(v ORDER BY b) AS tb FROM s8),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
  xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')]),
    lambda a, x: xor(a // 256, tb[1 + xor(a, x) % 256])), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crcs),
firsts AS (SELECT c.conv_id, c.h, list({'r': t.role, 't': t.text} ORDER BY t.r) FILTER (WHERE t.r IS NOT NULL) AS f FROM c LEFT JOIN t ON t.conv_id = c.base AND t.r <= c.h GROUP BY ALL),
rests AS (SELECT c.conv_id, list({'r': t.role, 't': t.text} ORDER BY t.r) FILTER (WHERE t.r IS NOT NULL) AS g FROM c LEFT JOIN t ON t.conv_id = c.conv_id AND t.r > c.h GROUP BY c.conv_id),
p AS (SELECT conv_id, list_concat(coalesce(f, []), coalesce(g, [])) AS q FROM firsts JOIN rests USING (conv_id)),
x AS (SELECT conv_id, len(q) AS n, d, md5(to_json(list_slice(q, 1, d))::VARCHAR) AS key, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(q[d].t, '[^\x20\x09-\x0D]+')) END AS w
  FROM p, LATERAL (SELECT unnest(range(0, len(q) + 1)) AS d)),
nodes AS (SELECT key, d, min(conv_id) AS c, count(*) AS n_convs, max(w) AS w,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = n), '')) AS ends FROM x GROUP BY key, d),
ups AS (SELECT n.key, u.key AS up, u.d AS ud FROM nodes n JOIN x u ON u.conv_id = n.c AND u.d <= n.d),
parent AS (SELECT n.key, u.up FROM nodes n JOIN ups u ON u.key = n.key AND u.ud = n.d - 1),
kids AS (SELECT up AS key, count(*) AS k FROM parent GROUP BY up),
sub AS (SELECT u.up AS key, sum((n.n_convs - 1) * n.w) AS saved, count(*) FILTER (WHERE k IS NULL) AS leaves FROM ups u JOIN nodes n USING (key) LEFT JOIN kids USING (key) GROUP BY u.up)
SELECT n.c AS conv_id, n.d AS depth, m.c AS parent_conv_id, n.n_convs, coalesce(k, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sub USING (key) LEFT JOIN kids USING (key) LEFT JOIN parent USING (key) LEFT JOIN nodes m ON m.key = parent.up"""


def oracle_sql() -> dict[str, str]:
    from .licenses import oracle

    return ORACLES | {"op6_license_scan": oracle()}
