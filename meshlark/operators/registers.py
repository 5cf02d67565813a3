"""Registers of plants, filings and products: profiles, indexes, crosswalks and joins between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists, text


def industry_scope(code: Column, prefixes=tuple(lists.DRUG_INDUSTRIES)) -> Column:
    return F.substring(code, 1, 2).isin(list(prefixes))


def country_or_tag_scope(country: Column, tag: Column, countries=("cn", "in")) -> Column:
    """Rows of some countries, or with a tracked tag whatever the country."""
    return F.lower(country).isin(list(countries)) | tag.isNotNull()


def api_flag(operations: Column) -> Column:
    return F.coalesce(F.contains(F.upper(operations), F.lit("API MANUFACTURE")), F.lit(False))


def active_filings(filings: DataFrame) -> DataFrame:
    """Active type II filings with a holder and a subject."""
    return filings.filter("type = 'II' AND status = 'A' AND trim(coalesce(holder, '')) <> '' AND trim(coalesce(subject, '')) <> ''")


def placeholder(name: Column, registered: Column, made: Column, marker: str = "UNKNOWN") -> Column:
    return F.coalesce(F.nullif(name, F.lit(marker)), registered, made)


def in_scope(title: Column, body: Column, word: str, scoped: Column) -> Column:
    """A scoped query needs the word in the body, any other in the title."""
    return F.contains(F.lower(F.when(scoped, body).otherwise(title)), F.lit(word.lower()))


def facility_profile(rows: DataFrame, key: str, name: str, country: str, city: str, tag: str, order: str) -> DataFrame:
    """One row per facility: its names, the longest one (ties: the last in the alphabet), the first country and city in
    order, its tags and how many rows it has."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    return rows.groupBy(key).agg(
        F.array_sort(F.collect_set(name)).alias("names"), F.max(F.struct(F.length(name).alias("l"), F.col(name).alias("n")))["n"].alias("name"),
        first(country).alias("country"), first(city).alias("city"), F.array_sort(F.collect_set(tag)).alias("tags"), F.count(F.lit(1)).alias("rows"),
    )


def firm_index(register: DataFrame, key: str, fei: str, country: str, operations: str) -> DataFrame:
    """One row per firm: plants, countries, operations (lists split at ;) and whether any is a maker of ingredients."""
    ops = F.filter(F.transform(F.split(F.coalesce(operations, F.lit("")), ";"), lambda o: F.trim(o)), lambda o: o != "")
    exploded = F.array_sort(F.array_distinct(F.flatten(F.collect_set(ops))))
    return register.groupBy(key).agg(F.array_sort(F.collect_set(fei)).alias("feis"), F.array_sort(F.collect_set(country)).alias("countries"), exploded.alias("operations"), F.bool_or(api_flag(F.col(operations))).alias("api"))


def first_match(left: DataFrame, right: DataFrame, key_l: Column, key_r: Column, order: str, cols) -> DataFrame:
    """Left rows with the first right row of an equal key, and how many right rows there are."""
    r = right.withColumn("_k", key_r)
    w = Window.partitionBy("_k")
    r = r.withColumn("_rn", F.row_number().over(w.orderBy(order))).withColumn("sites", F.count(F.lit(1)).over(w)).filter("_rn = 1").select("_k", "sites", *cols)
    return left.withColumn("_k", key_l).join(r, "_k", "left").drop("_k")


def priced_products(products: DataFrame, prices: DataFrame) -> DataFrame:
    """products(generic, packages array of dashed codes) x prices(ndc of 11 digits, price, day): one row per price; of
    the products that share a code, the smallest generic counts."""
    codes = products.select("generic", F.explode("packages").alias("_p")).select("generic", text.ndc11(F.col("_p")).alias("ndc")).filter("ndc IS NOT NULL").groupBy("ndc").agg(F.min("generic").alias("generic"))
    return prices.join(codes, "ndc")


def tagged_drugs(rows: DataFrame, key: str, tags: str, table: dict[str, str], declared: DataFrame) -> DataFrame:
    """(key, drug): tags mapped to drugs that are declared nodes."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    t = rows.select(key, F.explode(F.array_distinct(F.transform(tags, lambda x: F.upper(x)))).alias("_t")).select(key, F.try_element_at(m, F.col("_t")).alias("drug"))
    return t.filter("drug IS NOT NULL").join(declared.select(F.col("id").alias("drug")), "drug", "left_semi").distinct()


def filing_number(holders: DataFrame, filings: DataFrame, chars: int = 8) -> DataFrame:
    """holders(holder, substance) -> filing: by squashed holder and substance, else by the holder's first characters."""
    f = filings.select(text.squash(F.col("holder")).alias("_h"), F.col("substance"), F.col("filing"))
    exact = f.groupBy("_h", "substance").agg(F.min("filing").alias("_f1"))
    near = f.groupBy(F.substring("_h", 1, chars).alias("_p"), "substance").agg(F.min("filing").alias("_f2"))
    h = holders.withColumn("_h", text.squash(F.col("holder"))).withColumn("_p", F.substring("_h", 1, chars))
    return h.join(exact, ["_h", "substance"], "left").join(near, ["_p", "substance"], "left").withColumn("filing", F.coalesce("_f1", "_f2")).drop("_h", "_p", "_f1", "_f2")


def producer_node(holders: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """holders(substance_node, holder) -> node_id of that substance's producer with the same squashed label."""
    made = edges.filter("rel = 'produced_by'").select(F.col("src").alias("substance_node"), F.col("dst").alias("node_id")).distinct()
    labels = nodes.select(F.col("id").alias("node_id"), text.squash(F.col("label")).alias("_s"))
    known = made.join(labels, "node_id").groupBy("substance_node", "_s").agg(F.min("node_id").alias("node_id"))
    return holders.withColumn("_s", text.squash(F.col("holder"))).join(known, ["substance_node", "_s"], "left").drop("_s")


def marketers_per_drug(markets: DataFrame, drugs: DataFrame) -> DataFrame:
    """markets(labeler, product), drugs(product, drug) -> distinct labelers of each drug."""
    return markets.join(drugs, "product").groupBy("drug").agg(F.count_distinct("labeler").alias("labelers"))


def crosswalk_missing(names: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Names that the crosswalk (name, iso2) does not know: a load with any must fail."""
    return names.select(F.col(key).alias("name")).distinct().join(table, "name", "left_anti")


def jurisdictions(parties: DataFrame, others: DataFrame, table: DataFrame) -> DataFrame:
    """(iso2, label, party): parties and their own market, then the others, by the crosswalk."""
    both = parties.select("name", F.lit(True).alias("party")).unionByName(others.select("name", F.lit(False).alias("party")))
    return both.join(table, "name").groupBy("iso2").agg(F.min("name").alias("label"), F.bool_or("party").alias("party")).orderBy(F.desc("party"), "iso2")


def basis_lists(buckets: DataFrame) -> DataFrame:
    """(country, bucket) -> country with all its buckets, sorted."""
    return buckets.groupBy("country").agg(F.array_sort(F.collect_set("bucket")).alias("basis"))


def essential(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes whose label begins an entry of the list as a whole word."""
    first = F.lower(F.regexp_extract("entry", r"^\s*([\p{L}\p{N}-]+)", 1))
    e = entries.select(first.alias("_w"), F.lower("entry").alias("_e"))
    n = nodes.withColumn("_l", F.lower("label")).withColumn("_w", F.regexp_extract(F.lower(F.col("label")), r"^\s*([\p{L}\p{N}-]+)", 1))
    rest = F.substring("_e", F.length("_l") + 1, F.lit(1))
    hit = n.join(e, "_w").filter(F.startswith(F.col("_e"), F.col("_l")) & ~rest.rlike(r"[\p{L}\p{N}]")).select("id").distinct()
    return nodes.join(hit.withColumn("critical", F.lit(True)), "id", "left").withColumn("critical", F.coalesce("critical", F.lit(False)))


def assert_values(df: DataFrame, expected: dict) -> DataFrame:
    """The expectations that a one-row pin does not meet: (field, expected, found)."""
    rows = [df.select(F.lit(k).alias("field"), F.lit(str(v)).alias("expected"), F.col(k).cast("string").alias("found")) for k, v in expected.items()]
    return reduce(DataFrame.unionByName, rows).filter("NOT (expected <=> found)")


def with_bodies(pages: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """Documents with their full text where it was landed, and whether it was."""
    return pages.join(bodies, key, "left").withColumn("has_body", F.col("body").isNotNull())


def resource_url(catalog: DataFrame, year: int) -> DataFrame:
    """The first CSV of a catalog (title, distribution array of struct(format, url)) whose title names the year."""
    d = catalog.filter(F.contains(F.col("title"), F.lit(str(year)))).select("title", F.explode("distribution").alias("d")).filter(F.lower("d.format") == "csv")
    return d.select("title", F.col("d.url").alias("url")).orderBy("title", "url").limit(1)
