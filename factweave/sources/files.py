"""Connectors for delivered files: CSV with a preamble, HTML tables, JSON payloads, JSON lines, dataset folders.

Fetching stays outside Spark; files are the input. Text files are read whole per file only where their format asks for
it, and such files are provider reports of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractBroken(ValueError):
    """A delivery differs from what its source declares."""


def discovered(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, dataset, snapshot_date, kind of every file below root; the day comes from YYYYMMDD or YYMMDD in the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    long_day, short_day = F.regexp_extract("path", r"(?<![0-9])(20[0-9]{6})(?![0-9])", 1), F.regexp_extract("path", r"(?<![0-9])([0-9]{6})(?![0-9])", 1)
    day = F.coalesce(F.try_to_date(F.nullif(long_day, F.lit("")), "yyyyMMdd"), F.try_to_date(F.concat(F.lit("20"), F.nullif(short_day, F.lit(""))), "yyyyMMdd"))
    return files.select("path", "length", F.nullif(F.regexp_extract("path", r"([A-Z]{4}[0-9]{2}N[0-9]{3})", 1), F.lit("")).alias("dataset"), day.alias("snapshot_date"), F.when(F.lower("path").contains("schema"), "schema").otherwise("data").alias("kind"))


def one_of_each(files: DataFrame) -> DataFrame:
    """Datasets that lack exactly one data or one schema file on a day; must be empty."""
    n = files.where("dataset IS NOT NULL").groupBy("dataset", "snapshot_date").agg(F.count_if(F.col("kind") == "data").alias("data_files"), F.count_if(F.col("kind") == "schema").alias("schema_files"))
    return n.where("data_files <> 1 OR schema_files <> 1")


#: Names of declared types.
DECLARED_TYPES = {"text": T.StringType(), "numeric": T.DecimalType(38, 15), "integer": T.LongType(), "date": T.DateType(), "flag": T.BooleanType()}


def declared_schema(columns: Sequence[tuple[str, str]]) -> T.StructType:
    """A read schema from declared columns; the types are checked after reading, so all are text."""
    unknown = [t for _, t in columns if t not in DECLARED_TYPES]
    if unknown:
        raise ContractBroken(f"unknown type {unknown[0]}")
    return T.StructType([T.StructField(c, T.StringType()) for c, _ in columns])


def declared_csv(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """A CSV whose header must equal the declared columns; the read fails otherwise."""
    return spark.read.schema(declared_schema(columns)).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def report_csv(spark: SparkSession, path: str, header_prefix: str, columns: Sequence[str]) -> DataFrame:
    """Rows of CSV reports with a preamble: ``file``, ``as_of`` (from the second line) and the columns as text.

    The header is the first line with the prefix and must name exactly the columns; rows end at the first blank line.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("l"))
    head = F.array_position(F.transform("l", lambda x: F.startswith(F.regexp_replace(x, '"', ""), F.lit(header_prefix))), True)
    body = whole.select("file", F.element_at("l", 2).alias("second"), F.when(head > 0, F.try_element_at("l", F.greatest(head, F.lit(1)).cast("int"))).alias("header"), F.slice("l", (head + 1).cast("int"), F.size("l")).alias("rows"))
    wanted = ",".join(columns)
    judged = body.withColumn("header", F.when(F.regexp_replace("header", '"', "") == wanted, F.col("header")).otherwise(F.raise_error(F.concat(F.lit("header differs in "), F.col("file")))))
    end = F.coalesce(F.nullif(F.array_position(F.transform("rows", lambda x: F.trim(x) == ""), True), F.lit(0)), F.size("rows") + 1)
    lines = judged.where("header IS NOT NULL").select("file", F.regexp_extract("second", r'([A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4})', 1).alias("as_of"), F.explode(F.slice("rows", F.lit(1), (end - 1).cast("int"))).alias("line"))
    row = F.from_csv("line", F.lit(", ".join(f"`{c}` STRING" for c in columns)))
    return lines.select("file", F.try_to_date(F.nullif(F.col("as_of"), F.lit("")), "MMM d, yyyy").alias("as_of"), row.alias("r")).select("file", "as_of", *[F.col(f"r.`{c}`").alias(c) for c in columns])


class _Cells(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.open = True

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.rows[-1][-1] += data


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def html_cells(html: pd.Series) -> pd.Series:
    """Texts of the table cells of a page, by row."""

    def one(page: str | None):
        if page is None:
            return None
        parser = _Cells()
        parser.feed(page)
        return [[" ".join(c.split()) for c in r] for r in parser.rows if r]

    return html.map(one)


def html_rows(pages: DataFrame, key: str, html: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(rows, problems): table rows of the given width with their number; pages with a row of another width.

    What a page declares as its number of rows is checked by ``declared_totals``.
    """
    parsed = pages.select(key, F.posexplode(html_cells(F.col(html))).alias("row_no", "cells"))
    good = parsed.where(F.size("cells") == width).select(key, "row_no", *[F.col("cells")[i].alias(f"c{i}") for i in range(width)])
    return good, parsed.where(F.size("cells") != width).select(key, "row_no", F.size("cells").alias("cells"))


def declared_totals(rows: DataFrame, key: str, declared: DataFrame, total: str) -> DataFrame:
    """key, declared, found of deliveries whose declared number of rows differs from the rows found; must be empty."""
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    both = declared.select(key, F.col(total).cast("bigint").alias("declared")).join(found, key, "full")
    return both.select(key, "declared", F.coalesce("found", F.lit(0)).alias("found")).where(~F.col("declared").eqNullSafe(F.col("found")))


def paged_items(pages: DataFrame, catalog: str, page: str, payload: str, item: str, total: str = "totalCnt", items: str = "list") -> tuple[DataFrame, DataFrame]:
    """(items, problems) of a catalog delivered in JSON pages: each item once, and catalogs that are not whole.

    ``item`` is the schema of an item and ``page`` a number from 1. A page given twice counts once; a catalog is whole if
    its pages run from 1 without a gap and declare one total, which the items make up.
    """
    parsed = pages.select(catalog, F.col(page).cast("int").alias("_page"), F.from_json(F.col(payload), f"`{total}` int, `{items}` array<{item}>").alias("_p")).dropDuplicates([catalog, "_page"])
    rows = parsed.select(catalog, F.explode(f"_p.{items}").alias("_i")).select(catalog, "_i.*").distinct()
    told = parsed.groupBy(catalog).agg(F.count(F.lit(1)).alias("pages"), F.max("_page").alias("last_page"), F.min(f"_p.{total}").alias("declared"), F.max(f"_p.{total}").alias("_most"))
    both = told.join(rows.groupBy(catalog).agg(F.count(F.lit(1)).alias("found")), catalog, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    whole = (F.col("pages") == F.col("last_page")) & F.col("declared").eqNullSafe(F.col("_most")) & F.col("declared").eqNullSafe(F.col("found"))
    return rows, both.where(~F.coalesce(whole, F.lit(False))).drop("_most")


HOLDINGS_PAYLOAD = "struct<pdf:struct<gijunYMD:string,totalCnt:int,nowCnt:int,list:array<struct<secNm:string,itmNo:string,evalA:string,applyQ:string,curp:string,ratio:string>>>>"


def json_holdings(payloads: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(items, problems) of holdings payloads; a payload whose declared count differs from its list is a problem."""
    parsed = payloads.select(key, F.from_json(F.col(payload), HOLDINGS_PAYLOAD).alias("p"))
    n = F.coalesce(F.size("p.pdf.list"), F.lit(0))
    right = F.coalesce(F.col("p.pdf.totalCnt") == n, F.lit(False))
    items = parsed.where(right).select(key, F.col("p.pdf.gijunYMD").alias("gijunYMD"), F.inline("p.pdf.list"))
    return items, parsed.where(~right).select(key, F.col("p.pdf.totalCnt").alias("declared"), n.alias("found"))


def parallel_value(types: Column, values: Column, wanted: str) -> Column:
    """The value at the place of a type in parallel arrays; NULL if it is there not exactly once."""
    at = F.filter(F.arrays_zip(types.alias("t"), values.alias("v")), lambda x: x["t"] == wanted)
    return F.when(F.size(at) == 1, at[0]["v"])


def merged_lines(rows: DataFrame, key: Sequence[str], content: str) -> tuple[DataFrame, DataFrame]:
    """(merged, clashes): equal repeats count once; keys with differing contents clash."""
    n = rows.groupBy(*key).agg(F.count_distinct(content).alias("contents"), F.min(content).alias(content))
    return n.where("contents <= 1").drop("contents"), n.where("contents > 1").select(*key, "contents")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def pending_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, length, sha256) that the manifest does not hold with the same content: what a resumed load reads."""
    return files.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_anti")
