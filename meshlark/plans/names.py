"""Names, tokens, identifiers, prose and the audit chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists, text, values
from ..operators import audit, fuzzy
from ..operators.graph import checkpointed
from .market import CONF, rounded_confusion
from .registry import Tables, query, r6

# Companies are named after parts: their words, their brand and one of these forms.
FORMS = ["Ltd", "Limited", "Pharma GmbH", "Química S.A.", "Laboratories", "(formerly Kelvor) Inc"]


def sql_list(words, sort: bool = True) -> str:
    return "[" + ", ".join(f"'{w}'" for w in (sorted(words) if sort else words)) + "]"


def companies(t: Tables) -> DataFrame:
    """(id, name, country, fei, duns) of each part's maker; countries and identifiers are known for some."""
    k = F.col("p_partkey")
    form = F.element_at(F.array(*map(F.lit, FORMS)), (k % len(FORMS) + 1).cast("int"))
    name = F.when(k % 9 == 0, form).otherwise(F.concat_ws(" ", F.when(k % 4 != 0, F.initcap("p_name")).otherwise(F.upper("p_name")), F.when(k % 5 == 0, F.substring("p_brand", 7, 2)), form))
    country = F.when(k % 3 != 0, F.when(k % 2 == 0, F.lower(F.substring("p_type", 1, 1))).otherwise(F.upper(F.substring("p_type", 1, 1))))
    return t.part.select(k.alias("id"), "p_name", name.alias("name"), country.alias("country"), F.when(k % 7 == 0, F.col("p_brand")).alias("fei"), F.when(k % 11 < 3, F.col("p_name")).alias("duns"))


def pairs(t: Tables, *more: Column) -> DataFrame:
    """Makers that follow each other in an order, with their words (and more of a company); they are truly the same if their
    parts have one name."""
    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b"))
    met = line.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("a"), "b").distinct()
    c = companies(t)
    one = lambda p: c.select(F.col("id").alias(p), F.col("p_name").alias(f"{p}_name"), fuzzy.worded(F.struct("name", "country", "fei", "duns")).alias(f"{p}_side"), *[m.alias(f"{p}_more") for m in more])
    return met.join(one("a"), "a").join(one("b"), "b").withColumn("same", F.col("a_name") == F.col("b_name"))


TOK = lambda c: f"list_filter(string_split_regex(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'), ' +'), lambda w: w <> '' AND NOT list_contains({sql_list(lists.STOP)}, w))"
CORE = sql_list(lists.LEGAL + lists.INDUSTRY + lists.GEO)
COMPARED = f"""f AS (SELECT {sql_list(FORMS, False)} AS forms), m AS (SELECT p_partkey AS k, p_name, CASE WHEN p_partkey % 9 = 0 THEN forms[p_partkey % {len(FORMS)} + 1] ELSE concat_ws(' ', p_name, CASE WHEN p_partkey % 5 = 0 THEN substr(p_brand, 7, 2) END, forms[p_partkey % {len(FORMS)} + 1]) END AS name,
 CASE WHEN p_partkey % 3 <> 0 THEN lower(p_type[1]) END AS country, CASE WHEN p_partkey % 7 = 0 THEN p_brand END AS fei, CASE WHEN p_partkey % 11 < 3 THEN p_name END AS duns FROM part, f),
mt AS (SELECT *, list_distinct({TOK('name')}) AS toks FROM m), mc AS (SELECT *, list_filter(toks, lambda w: NOT list_contains({CORE}, w)) AS core, list_filter(toks, lambda w: NOT list_contains({sql_list(lists.LEGAL)}, w)) AS full FROM mt),
p AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber - 1),
s AS (SELECT p.*, x.p_name = y.p_name AS actual, x.name = y.name AS equal, x.country AS ac, y.country AS bc, x.fei AS af, y.fei AS bf, x.duns AS ad, y.duns AS bd, len(x.core) = 0 OR len(y.core) = 0 AS bare,
 CASE WHEN len(x.core) > 0 AND len(y.core) > 0 THEN greatest(len(list_intersect(x.core, y.core)) / len(list_distinct(x.core || y.core))::DOUBLE, 0.9::DOUBLE * (len(list_intersect(x.core, y.core)) / least(len(x.core), len(y.core))::DOUBLE)) ELSE 0 END AS core,
 CASE WHEN len(x.full) > 0 AND len(y.full) > 0 THEN len(list_intersect(x.full, y.full)) / len(list_distinct(x.full || y.full))::DOUBLE ELSE 0 END AS generic FROM p JOIN mc x ON x.k = a JOIN mc y ON y.k = b),
v AS (SELECT *, CASE WHEN af IS NOT NULL AND bf IS NOT NULL THEN 'fei' WHEN ad IS NOT NULL AND bd IS NOT NULL THEN 'duns' WHEN guarded AND ac <> bc THEN 'country' WHEN bare THEN 'generic' ELSE 'core' END AS method FROM s, (SELECT unnest([true, false]) AS guarded)),
w AS (SELECT a, b, guarded, actual, method, CASE method WHEN 'fei' THEN (af = bf)::INT::DOUBLE WHEN 'duns' THEN (ad = bd)::INT::DOUBLE WHEN 'country' THEN 0 WHEN 'generic' THEN generic ELSE core END AS score FROM v),
z AS (SELECT *, CASE method WHEN 'fei' THEN score = 1 WHEN 'duns' THEN score = 1 WHEN 'country' THEN false WHEN 'generic' THEN score >= 0.85 ELSE score >= 0.6 END AS same FROM w)"""


def sides() -> tuple[Column, Column]:
    return F.col("a_side"), F.col("b_side")


@query("q21_compare_names", f"WITH {COMPARED} SELECT a, b, actual, method, round(score, 6) AS score, same FROM z WHERE guarded")
def q21(t):
    return pairs(t).withColumn("v", fuzzy.compare_worded(*sides())).select("a", "b", F.col("same").alias("actual"), "v.method", r6("v.score").alias("score"), F.col("v.same").alias("same"))


@query("q22_er_threshold_sweep", f"""WITH {COMPARED}, x AS (SELECT h / 100.0::DOUBLE AS threshold, actual, score >= h / 100.0::DOUBLE AS pred FROM z, range(20, 96, 5) AS g(h) WHERE guarded),
cc AS (SELECT threshold, count(*) FILTER (pred AND actual) AS tp, count(*) FILTER (pred AND NOT actual) AS fp, count(*) FILTER (NOT pred AND NOT actual) AS tn, count(*) FILTER (NOT pred AND actual) AS fn FROM x GROUP BY 1),
q AS (SELECT *, {CONF} FROM cc) SELECT *, f1 = max(f1) OVER () AS plateau FROM q""")
def q22(t):
    scored = pairs(t).select("same", fuzzy.compare_worded(*sides())["score"].alias("score"))
    return rounded_confusion(fuzzy.sweep(scored, "score", "same"))


@query("q149_guard_ablation", f"""WITH {COMPARED}, x AS (SELECT CASE WHEN guarded THEN 'guard' ELSE 'no guard' END AS way, actual, same AS pred FROM z UNION ALL SELECT 'equal keys', actual, regexp_replace(lower(strip_accents(x.name)), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(strip_accents(y.name)), '[^a-z0-9]+', '', 'g') FROM s JOIN m x ON x.k = a JOIN m y ON y.k = b),
cc AS (SELECT way, count(*) FILTER (pred AND actual) AS tp, count(*) FILTER (pred AND NOT actual) AS fp, count(*) FILTER (NOT pred AND NOT actual) AS tn, count(*) FILTER (NOT pred AND actual) AS fn FROM x GROUP BY 1)
SELECT *, {CONF} FROM cc""")
def q149(t):
    """What the country guard is worth, beside plain equality of squashed names."""
    key = text.squash(text.strip_accents(F.col("name")))
    same = lambda guard: fuzzy.compare_worded(*sides(), country_guard=guard)["same"]
    ways = F.create_map(F.lit("guard"), same(True), F.lit("no guard"), same(False), F.lit("equal keys"), F.col("a_more") == F.col("b_more"))
    return rounded_confusion(fuzzy.confusion(pairs(t, key).select("same", F.explode(ways).alias("way", "pred")), F.col("pred"), F.col("same"), ["way"]))


@query("q64_resolve_with_refusal", """WITH n AS (SELECT l_partkey AS l, l_suppkey AS r, round(avg(l_quantity) / 50, 2) AS s FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, max(s) OVER (PARTITION BY l) AS top FROM n), g AS (SELECT l, max(top)::DOUBLE AS score, count(*) AS near, count(*) FILTER (r % 10 = 6) AS whole, min(r) AS one, min(r) FILTER (r % 10 = 6) AS held FROM t WHERE top - s < 0.05 GROUP BY 1)
SELECT l AS id_l, CASE WHEN near = 1 THEN one WHEN whole = 1 THEN held END AS id_r, score, CASE WHEN near = 1 OR whole = 1 THEN 'matched' ELSE 'refused' END AS outcome FROM g""")
def q64(t):
    """A near tie is refused; one candidate that holds the whole name (here: a key that ends in 6) settles it."""
    scored = t.lineitem.groupBy(F.col("l_partkey").alias("id_l"), F.col("l_suppkey").alias("id_r")).agg(F.round(F.avg("l_quantity") / 50, 2).alias("score"))
    return fuzzy.refuse_ties(scored, "id_l", "id_r", superset=F.col("id_r") % 10 == 6)


@query("q65_resolve_parts", """WITH a AS (SELECT p_partkey AS name_id, p_name AS name FROM part), b AS (SELECT min(p_partkey) AS match_id, p_name AS name FROM part GROUP BY p_name)
SELECT name_id, CASE WHEN name NOT LIKE 'old %' AND name NOT LIKE 'new %' THEN match_id END AS match_id, 1.0::DOUBLE AS score, CASE WHEN name LIKE 'old %' OR name LIKE 'new %' THEN 'refused' ELSE 'matched' END AS outcome FROM a JOIN b USING (name)""")
def q65(t):
    """Part names among the distinct part names: equal names win; "old" and "new" are no core words, so such names tie and are refused."""
    none = F.lit(None).cast("string")
    extra = [none.alias("country"), none.alias("fei"), none.alias("duns")]
    a = t.part.select(F.col("p_partkey").alias("name_id"), F.col("p_name").alias("name"), *extra)
    b = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("match_id")).select("match_id", "name", *extra)
    return fuzzy.resolve(a, b)


WORDS = lambda c: f"list_distinct(list_filter(string_split_regex(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'), ' +'), lambda w: w <> ''))"


@query("q20_token_block_join_best", f"""WITH d AS (SELECT doc_id, {WORDS('text')} AS w FROM documents), b AS (SELECT item_id, {WORDS('text')} AS w FROM benchmark),
x AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d), y AS (SELECT item_id, len(w) AS m, unnest(w) AS t FROM b),
j AS (SELECT doc_id, item_id, count(*) / (n + m - count(*))::DOUBLE AS score FROM x JOIN y USING (t) GROUP BY doc_id, item_id, n, m),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rn FROM j WHERE score >= 0.1) SELECT doc_id, item_id, round(score, 6) AS score FROM r WHERE rn = 1""")
def q20(t):
    d = text.word_sets(fuzzy.spread(t.documents.select("doc_id", "text")), "doc_id", "text", "core_l")
    b = text.word_sets(t.benchmark, "item_id", "text", "core_r")
    return fuzzy.token_block_join(d, b, "doc_id", "item_id", "core_l", "core_r", 0.1, distinct=True).withColumn("score", r6("score"))


@query("q66_register_search", """WITH a AS (SELECT DISTINCT p_name AS name FROM part), x AS (SELECT name, unnest(string_split(name, ' ')) AS w FROM a), n AS (SELECT name, count(DISTINCT w) AS n FROM x GROUP BY 1),
j AS (SELECT l.name AS l, r.name AS r, count(DISTINCT l.w) AS s FROM x l JOIN x r USING (w) GROUP BY ALL), k AS (SELECT l, r, s / (a.n + b.n - s)::DOUBLE AS score FROM j JOIN n a ON l = a.name JOIN n b ON r = b.name)
SELECT l, r, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS rank FROM k WHERE score >= 0.3) WHERE rank <= 3""")
def q66(t):
    n = t.part.select("p_name").distinct().withColumn("w", F.split("p_name", " "))
    return fuzzy.search(n.select(F.col("p_name").alias("l"), F.col("w").alias("wl")), n.select(F.col("p_name").alias("r"), F.col("w").alias("wr")), "l", "r", "wl", "wr", 0.3, 3).withColumn("score", r6("score"))


@query("q23_normalize_tokens", f"SELECT doc_id, array_to_string({TOK('text')}, ' ') AS toks FROM documents")
def q23(t):
    return t.documents.select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("toks"))


@query("q24_id_normalizers", r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' -- ' || p_brand), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS squash,
 coalesce(nullif(ltrim(p_partkey::VARCHAR, '0'), ''), '0') AS fei, lpad((p_partkey % 10000)::VARCHAR, 5, '0') || lpad((p_size)::VARCHAR, 4, '0') || '0' || (p_partkey % 10) AS ndc, 'ABC' AS iso3, p_type AS bare FROM part""")
def q24(t):
    k = F.col("p_partkey").cast("string")
    code = F.concat_ws("-", (F.col("p_partkey") % 10000).cast("string"), F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"))
    return t.part.select("p_partkey", text.slug(F.concat("p_name", F.lit(" -- "), "p_brand")).alias("slug"), text.squash(F.col("p_brand")).alias("squash"), text.fei(F.concat(F.lit("FEI 000"), k)).alias("fei"), text.ndc11(code).alias("ndc"), text.last_iso3(F.concat("p_name", F.lit(" (XYZ), "), "p_brand", F.lit(" (ABC)"))).alias("iso3"), text.strip_parenthetical(F.concat("p_type", F.lit(" (old) "))).alias("bare"))


@query("q19_same_substance_pairs", """WITH n AS (SELECT DISTINCT p_name AS x FROM part) SELECT a.x AS q, b.x AS c,
 len(list_filter(string_split(a.x, ' '), lambda w: NOT list_contains(string_split(b.x, ' '), w))) = 0 OR len(list_filter(string_split(b.x, ' '), lambda w: NOT list_contains(string_split(a.x, ' '), w))) = 0
 OR starts_with(replace(b.x, ' ', ''), replace(a.x, ' ', '')) OR starts_with(replace(a.x, ' ', ''), replace(b.x, ' ', '')) AS same
FROM n a JOIN n b ON string_split(a.x, ' ')[1] = string_split(b.x, ' ')[1]""")
def q19(t):
    n = t.part.select("p_name", F.split("p_name", " ")[0].alias("w")).distinct()
    a, b = n.select(F.col("p_name").alias("q"), "w"), n.select(F.col("p_name").alias("c"), "w")
    return a.join(b, "w").select("q", "c", text.same_substance(F.col("q"), F.col("c")).alias("same"))


@query("q67_generic_key", f"""WITH x AS (SELECT p_partkey, p_name || ' Tablets ' || p_type || '; extended' AS g FROM part)
SELECT p_partkey, array_to_string(list_filter(string_split_regex(regexp_replace(lower(string_split_regex(g, '[;/]')[1]), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> '' AND NOT list_contains({sql_list(lists.FORM_WORDS)}, w)), ' ') AS key FROM x""")
def q67(t):
    return t.part.select("p_partkey", text.generic_key(F.concat("p_name", F.lit(" Tablets "), "p_type", F.lit("; extended"))).alias("key"))


@query("q47_html_plain_text", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS plain FROM pages""")
def q47(t):
    return t.pages.select("page_id", text.plain_text(F.col("html")).alias("plain"))


@query("q68_dates_and_numbers", """SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, (DATE '1899-12-30' + (o_orderkey % 40000)::INT)::VARCHAR AS excel,
 round((2001 - year(o_orderdate)) * 12 + (3 - month(o_orderdate)) + (15 - day(o_orderdate)) / 30.0::DOUBLE, 6) AS months, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS num, CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'low' END AS band FROM orders""")
def q68(t):
    o = t.orders
    k = F.col("o_orderkey") % 3
    written = F.when(k == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    raw = F.when(k == 0, F.col("o_totalprice").cast("string")).when(k == 1, "NaN").otherwise("n/a")
    return o.select("o_orderkey", values.parse_date(written).cast("string").alias("day"), values.excel_date((F.col("o_orderkey") % 40000).cast("string")).cast("string").alias("excel"), r6(values.months_between_plain(F.lit("2001-03-15").cast("date"), F.col("o_orderdate"))).alias("months"), values.number(raw).alias("num"), values.band(F.col("o_totalprice"), 100000, 300000).alias("band"))


AUDIT = """b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, role, coalesce(text, '') AS text, turn FROM conversations)"""


@query("q46_audit_chain", f"""WITH RECURSIVE {AUDIT}, j AS (SELECT conv_id, seq, sha256(text) AS payload, '{{"actor":"' || role || '","kind":"step","payload":"' || sha256(text) || '","run_id":"r' || conv_id || '","seq":' || seq || ',"ts":"' || turn || '"}}' AS body FROM b),
c AS (SELECT conv_id, seq, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || body) AS hash FROM j WHERE seq = 0 UNION ALL SELECT j.conv_id, j.seq, c.hash, sha256(c.hash || j.body) FROM c JOIN j ON j.conv_id = c.conv_id AND j.seq = c.seq + 1)
SELECT * FROM c""")
def q46(t):
    return chain(t).select("conv_id", "seq", "prev_hash", "hash")


def audit_rows(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.col("turn").cast("string").alias("ts"), F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("run_id"), F.col("role").alias("actor"), F.lit("step").alias("kind"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("payload"))


def chain(t: Tables) -> DataFrame:
    return audit.chain_append(audit_rows(t), ["turn"], by="conv_id")


BODY = """'{"actor":"' || role || '","kind":"step","payload":"' || payload || '","run_id":"r' || conv_id || '","seq":' || seq || ',"ts":"' || turn || '"}'"""


@query("q69_audit_verify_tampered", f"""WITH RECURSIVE {AUDIT}, p AS (SELECT conv_id, seq, role, turn, sha256(text) AS payload, count(*) OVER (PARTITION BY conv_id) AS n FROM b), j AS (SELECT *, {BODY} AS body FROM p),
c AS (SELECT conv_id, seq, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || body) AS hash FROM j WHERE seq = 0 UNION ALL SELECT j.conv_id, j.seq, c.hash, sha256(c.hash || j.body) FROM c JOIN j ON j.conv_id = c.conv_id AND j.seq = c.seq + 1),
l AS (SELECT conv_id, seq, role, turn, prev_hash, hash, CASE WHEN conv_id % 3 = 0 AND seq = 1 AND n >= 3 THEN 'edited' ELSE payload END AS payload FROM c JOIN p USING (conv_id, seq) WHERE NOT (conv_id % 3 = 1 AND seq = 1 AND n >= 3)),
v AS (SELECT *, coalesce(lag(hash) OVER w, repeat('0', 64)) AS was, row_number() OVER w - 1 AS rn FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY seq)),
f AS (SELECT conv_id, seq, CASE WHEN prev_hash <> was THEN 'removed, reordered, or inserted' WHEN sha256(prev_hash || {BODY}) <> hash THEN 'modified' WHEN seq <> rn THEN 'sequence gap' END AS bad FROM v)
SELECT conv_id, count(bad) = 0 AS ok, coalesce(arg_min(bad, seq) FILTER (bad IS NOT NULL), 'intact') AS finding FROM f GROUP BY 1""")
def q69(t):
    """Every third chain has an edited row, every third lacks one: the finding names which."""
    from pyspark.sql import Window

    log = chain(t).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    edited = (F.col("conv_id") % 3 == 0) & (F.col("seq") == 1) & (F.col("n") >= 3)
    log = log.withColumn("payload", F.when(edited, "edited").otherwise(F.col("payload"))).filter(~((F.col("conv_id") % 3 == 1) & (F.col("seq") == 1) & (F.col("n") >= 3)))
    return audit.chain_verify(log, by="conv_id").select("conv_id", "ok", "finding")


@query("q146_audit_resume", f"""WITH RECURSIVE {AUDIT}, j AS (SELECT conv_id, seq, sha256(text) AS payload, '{{"actor":"' || role || '","kind":"step","payload":"' || sha256(text) || '","run_id":"r' || conv_id || '","seq":' || seq || ',"ts":"' || turn || '"}}' AS body FROM b),
c AS (SELECT conv_id, seq, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || body) AS hash FROM j WHERE seq = 0 UNION ALL SELECT j.conv_id, j.seq, c.hash, sha256(c.hash || j.body) FROM c JOIN j ON j.conv_id = c.conv_id AND j.seq = c.seq + 1)
SELECT * FROM c""")
def q146(t):
    """A log that is written in three goes, each after the stored log's last rows, is the log of one go."""
    rows, log = audit_rows(t), None
    for part in (F.col("turn") < 2, F.col("turn") == 2, F.col("turn") > 2):
        new = checkpointed(audit.chain_append(rows.filter(part), ["turn"], by="conv_id", log=log))
        log = new if log is None else log.unionByName(new)
    return log.select("conv_id", "seq", "prev_hash", "hash")


@query("q147_audit_export", f"""WITH RECURSIVE {AUDIT}, j AS (SELECT conv_id, seq, '{{"actor":"' || role || '","kind":"step","payload":"' || sha256(text) || '","run_id":"r' || conv_id || '","seq":' || seq || ',"ts":"' || turn || '"}}' AS body FROM b),
c AS (SELECT conv_id, seq, sha256(repeat('0', 64) || body) AS hash FROM j WHERE seq = 0 UNION ALL SELECT j.conv_id, j.seq, sha256(c.hash || j.body) FROM c JOIN j ON j.conv_id = c.conv_id AND j.seq = c.seq + 1)
SELECT conv_id, true AS ok, 'intact' AS finding, arg_max(hash, seq) AS head, count(*) AS rows, min(turn::VARCHAR) AS begun, max(turn::VARCHAR) AS ended, count(*) AS steps, false AS finished FROM c JOIN b USING (conv_id, seq) GROUP BY 1""")
def q147(t):
    return audit.exported(chain(t), "conv_id")


@query("q148_place_lookup", """WITH g AS (SELECT p_partkey, 'c' || (p_size % 5) AS iso2, replace(p_name, ' ', '') AS name, p_brand AS admin1, p_partkey % 90 AS lat, p_partkey % 179 AS lng, p_retailprice AS population FROM part),
c AS (SELECT p_partkey AS id, 'c' || ((p_size + 1) % 5) AS iso2, admin1, name, unnest([0, 1, 2]) AS ord FROM g JOIN part USING (p_partkey)),
n AS (SELECT id, iso2, admin1, ord, CASE ord WHEN 0 THEN CASE id % 4 WHEN 0 THEN left(name, len(name) - 1) || 'q' WHEN 1 THEN name || 's' WHEN 2 THEN name || 'zz' ELSE left(name, 6) END WHEN 1 THEN CASE WHEN id % 5 = 0 THEN 'nowhereatall' ELSE left(name, len(name) - 2) || 'y' END ELSE name END AS name FROM c),
e AS (SELECT n.*, g.admin1 = n.admin1 AS same, lat, lng, population FROM n JOIN g USING (iso2, name)),
s AS (SELECT n.*, g.admin1 = n.admin1 AS same, lat, lng, population FROM n JOIN g ON g.iso2 = n.iso2 AND starts_with(g.name, left(n.name, len(n.name) - 1)) AND len(g.name) <= len(n.name) + 1 WHERE len(n.name) >= 7 AND NOT EXISTS (SELECT 1 FROM g h WHERE h.iso2 = n.iso2 AND h.name = n.name)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord, same DESC, population DESC, lat, lng) AS rn FROM (SELECT * FROM e UNION ALL SELECT * FROM s))
SELECT id, iso2, name, lat, lng FROM r WHERE rn = 1""")
def q148(t):
    """Part names as places, looked up under misspelt, longer, cut and plain names, best first."""
    name, k = F.regexp_replace("p_name", " ", ""), F.col("p_partkey")
    land = lambda shift: F.concat(F.lit("c"), ((F.col("p_size") + shift) % 5).cast("string"))
    g = t.part.select(land(0).alias("iso2"), name.alias("name"), F.col("p_brand").alias("admin1"), (k % 90).alias("lat"), (k % 179).alias("lng"), F.col("p_retailprice").alias("population"))
    cut = lambda n: F.left(name, F.length(name) - n)
    first = F.when(k % 4 == 0, F.concat(cut(1), F.lit("q"))).when(k % 4 == 1, F.concat(name, F.lit("s"))).when(k % 4 == 2, F.concat(name, F.lit("zz"))).otherwise(F.left(name, F.lit(6)))
    second = F.when(k % 5 == 0, "nowhereatall").otherwise(F.concat(cut(2), F.lit("y")))
    c = t.part.select(k.alias("id"), land(1).alias("iso2"), F.col("p_brand").alias("admin1"), F.array(first, second, name).alias("names"))
    return fuzzy.rank_places(c, g)
