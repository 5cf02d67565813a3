"""Readers of landed files: spreadsheets, delimited files in archives, JSON pages and logs, XML, HTML, text lines.

Archives and spreadsheets are read by tasks from binary columns; their rows come back as an array column `cells` or as
maps from header to value.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def empty_or(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json", **options) -> DataFrame:
    """A table, or an empty one of the schema if the path is not there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).options(**options).load(path)


def json_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pages {results: [...]} -> one row per result."""
    return spark.read.schema(f"results array<struct<{schema}>>").json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append log; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def ndjson_serial(lines: DataFrame, schema: str) -> DataFrame:
    """Serial lines (value): comments and what does not parse are dropped. Works on streams."""
    return lines.filter(~F.trim("value").startswith("#")).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).filter("r IS NOT NULL").select("r.*").dropna("all")


def column_index(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: str | None = None) -> Iterator[list[str]]:
    """Rows of a sheet (the first, or by name); gaps are empty strings."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{space['m']}}}t")) for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot().findall("m:si", space)]
        name = "xl/worksheets/sheet1.xml"
        if sheet is not None:
            book = ElementTree.parse(z.open("xl/workbook.xml")).getroot()
            rid = next(s.get(link) for s in book.find("m:sheets", space) if s.get("name") == sheet)
            rels = ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()
            target = next(r.get("Target") for r in rels if r.get("Id") == rid)
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for _, row in ElementTree.iterparse(z.open(name)):
            if not row.tag.endswith("}row"):
                continue
            cells: list[str] = []
            for c in row.findall("m:c", space):
                at = column_index(c.get("r")) if c.get("r") else len(cells)
                cells += [""] * (at - len(cells))
                v = c.find("m:v", space)
                if c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{{{space['m']}}}t")))
                elif v is None or v.text is None:
                    cells.append("")
                else:
                    cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
            row.clear()
            yield cells


def xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(path, row, cells) of spreadsheets; one task per file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = list(sheet_rows(data.as_py(), sheet))
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, row int, cells array<string>")


def zipped_table(spark: SparkSession, path: str, sep: str = "\t", member: str = "") -> DataFrame:
    """(path, fields map) of delimited members (by prefix) of ZIP archives: headers and values trimmed, unnamed columns dropped."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    for name in z.namelist():
                        if not name.upper().startswith(member.upper()):
                            continue
                        lines = csv.reader(io.TextIOWrapper(z.open(name), "utf-8", "replace", newline=""), delimiter=sep)
                        head = [h.strip() for h in next(lines, [])]
                        held: list[list[tuple[str, str]]] = []
                        for row in lines:
                            held.append([(h, v.strip()) for h, v in zip(head, row, strict=False) if h])
                            if len(held) >= 5000:
                                yield batch_of(p, held)
                                held = []
                        if held:
                            yield batch_of(p, held)

    def batch_of(p: str, held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p] * len(held), pa.string()), pa.array(held, pa.map_(pa.string(), pa.string()))], ["path", "fields"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, fields map<string,string>")


def from_fields(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.try_element_at("fields", F.lit(n)).alias(n) for n in names])


def xml_paragraphs(spark: SparkSession, path: str, tags=("P", "FP")) -> DataFrame:
    """(path, pos, text) of paragraphs, blanks collapsed."""
    doc = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    parts = F.regexp_extract_all("value", F.lit(rf"(?s)<(?:{'|'.join(tags)})(?:\s[^>]*)?>(.*?)</(?:{'|'.join(tags)})>"), 1)
    return doc.select("path", F.posexplode(parts).alias("pos", "text")).withColumn("text", F.trim(F.regexp_replace(F.regexp_replace("text", "<[^>]+>", ""), r"\s+", " ")))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(iso2, name key, lat, lng, admin1, population): one row per name or alternate of a place."""
    from ..functions.text import place_key

    raw = spark.read.csv(path, sep="\t", quote="")
    names = F.array_union(F.array("_c1", "_c2"), F.split(F.coalesce("_c3", F.lit("")), ","))
    return raw.select(F.col("_c8").alias("iso2"), F.explode(F.array_distinct(F.transform(names, lambda n: place_key(n)))).alias("name"), F.col("_c4").try_cast("double").alias("lat"), F.col("_c5").try_cast("double").alias("lng"), F.col("_c10").alias("admin1"), F.col("_c14").try_cast("long").alias("population")).filter("name <> ''")


def carried_rows(lines: DataFrame, category: str, terminator: str) -> DataFrame:
    """lines(doc, pos, text) -> (doc, category, row): lines up to a terminator make a row; a category line starts anew."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    is_cat, ends = F.col("text").rlike(category), F.col("text").rlike(terminator)
    d = lines.withColumn("_cat", F.last(F.when(is_cat, F.col("text")), ignorenulls=True).over(run)).withColumn("_c", F.sum(is_cat.cast("int")).over(run))
    d = d.withColumn("_r", F.coalesce(F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.filter(~is_cat & F.col("_cat").isNotNull()).groupBy("doc", "_c", "_cat", "_r").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_l"), F.bool_or(ends).alias("done"))
    return d.filter("done").select("doc", F.col("_cat").alias("category"), F.array_join(F.col("_l.text"), " ").alias("row"))


def paired_items(lines: DataFrame, header: str, bullet: str) -> DataFrame:
    """(doc, header, item): each bullet with the last header before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("header", F.last(F.when(F.col("text").rlike(header), F.col("text")), ignorenulls=True).over(w))
    return d.filter(F.col("text").rlike(bullet)).select("doc", "header", F.regexp_replace("text", bullet, "").alias("item"))


class Page(InputPartition):
    def __init__(self, skip: int, limit: int):
        self.skip, self.limit = skip, limit


class PagedJsonReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def page(self, skip: int, limit: int) -> dict:
        """A page of results, from the cache folder if it is there (a folder that all executors share)."""
        import hashlib
        import json
        import os
        import time
        import urllib.parse
        import urllib.request

        query = {"limit": limit, "skip": skip} | ({"search": self.options["search"]} if "search" in self.options else {})
        cache = self.options.get("cache")
        mark = hashlib.sha256(json.dumps({"url": self.options["url"], **query}, sort_keys=True).encode()).hexdigest()[:16]
        if cache and os.path.exists(f"{cache}/{mark}.json"):
            with open(f"{cache}/{mark}.json", encoding="utf-8") as f:
                return json.load(f)
        time.sleep(float(self.options.get("pause", 0.3)))
        with urllib.request.urlopen(f"{self.options['url']}?{urllib.parse.urlencode(query)}", timeout=60) as r:
            got = json.load(r)
        if cache:
            os.makedirs(cache, exist_ok=True)
            with open(f"{cache}/{mark}.{os.getpid()}", "w", encoding="utf-8") as f:
                json.dump(got, f)
            os.replace(f"{cache}/{mark}.{os.getpid()}", f"{cache}/{mark}.json")
        return got

    def partitions(self) -> list[Page]:
        size = int(self.options.get("pagesize", 100))
        total = int(self.options["total"]) if "total" in self.options else int(self.page(0, 1)["meta"]["results"]["total"])
        return [Page(i, min(size, total - i)) for i in range(0, total, size)]

    def read(self, page: Page):
        import json

        for row in self.page(page.skip, page.limit).get("results", []):
            yield tuple(json.dumps(v) if isinstance(v, (dict, list)) else v if v is None else str(v) for v in (row.get(f) for f in self.schema.fieldNames()))


#: The endpoints of the public drug API, by short name.
ENDPOINTS = {"ndc": "drug/ndc.json", "shortages": "drug/shortages.json", "enforcement": "drug/enforcement.json", "drugsfda": "drug/drugsfda.json"}


def endpoint(spark: SparkSession, base: str, name: str, schema: str, **options) -> DataFrame:
    """One of the four endpoints as a table of its results' fields (strings; nested ones as JSON)."""
    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").schema(schema).option("url", f"{base.rstrip('/')}/{ENDPOINTS[name]}").options(**options).load()


class PagedJson(DataSource):
    """spark.read.format("paged_json").schema(strings).option("url", ...): one partition per page. Options: total (else
    asked for), search, pagesize, pause (seconds before a call), cache (a shared folder of pages)."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedJsonReader(schema, self.options)
