"""Readers of the formats that reviews, items and catalogues come in."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs  # noqa: F401 - used as pa.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW = T.StructType([
    T.StructField("rating", T.DoubleType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("asin", T.StringType()),
    T.StructField("parent_asin", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("verified_purchase", T.BooleanType()), T.StructField("helpful_vote", T.LongType()),
])
ITEM = T.StructType([
    T.StructField("parent_asin", T.StringType()), T.StructField("title", T.StringType()), T.StructField("store", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("details", T.StringType()),
])
BROKEN = "_broken"

# Where the two kinds of files lie below their root.
LAYOUT = {"raw_review": "raw/review_categories/{category}.jsonl", "raw_meta": "raw/meta_categories/meta_{category}.jsonl"}


def locate(root: str, config: str, category: str) -> str:
    """Path of a category's file; an unknown config is an error."""
    for prefix, layout in LAYOUT.items():
        if config.startswith(prefix):
            return f"{root}/{layout.format(category=category)}"
    raise ValueError(f"unknown config: {config}")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the files at a path or glob, from the file system alone."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = [(s.getPath().toString(), s.getLen()) for s in (fs.globStatus(at) or []) for s in ([s] if s.isFile() else fs.listStatus(s.getPath())) if s.isFile()]
    return spark.createDataFrame(rows, "path string, bytes long")


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True, limit: int | None = None) -> DataFrame:
    """Records of JSON lines, compressed or not.

    strict: a malformed line is an error; otherwise such lines are left out. Blank lines give no record. `limit` keeps
    the first records as Spark meets them. Missing fields are null.
    """
    if strict:
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        df = _tolerant(spark, path, schema).select("r.*")
    return df if limit is None else df.limit(limit)


def _tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(r, at) of the well-formed lines: the record, and the file and byte where its split starts."""
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"))
    return spark.read.text(path).select(parsed(F.col("value"), schema).alias("r"), at.alias("at")).filter("r is not null")


def parsed(payload: Column, schema: T.StructType) -> Column:
    """Struct of a JSON object in a column, null where the text is cut off or no object."""
    whole = F.regexp_replace(payload, r"^\s+|\s+$", "").rlike(r"(?s)^\{.*\}$")
    wide = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    s = F.from_json(payload, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    return F.when(whole & s[BROKEN].isNull(), F.struct(*[s[f].alias(f) for f in schema.fieldNames()]))


def byte_blocks(spark: SparkSession, path: str, schema: T.StructType, limit: int, blocks: int) -> DataFrame:
    """limit // blocks records from the start of each of `blocks` evenly spaced splits of the files, with their `block`.

    Malformed lines are left out and not counted; a remainder of the limit is dropped. With fewer splits than blocks
    every split is one. A split starts at its first whole line.
    """
    df = _tolerant(spark, path, schema).select("r", F.col("at").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    starts = df.groupBy("_at").agg(F.lit(1).alias("_one")).withColumn("_k", F.row_number().over(Window.orderBy("_at")) - 1)  # one row per split
    n = starts.agg(F.count(F.lit(1)).alias("_n"))
    j = starts.crossJoin(F.broadcast(n)).withColumn("block", F.floor(F.col("_k") * F.least(F.lit(blocks), F.col("_n")) / F.col("_n")).cast("int"))
    first = j.groupBy("block").agg(F.min("_at").alias("_at"))
    w = Window.partitionBy("block").orderBy("_id")
    picked = df.join(F.broadcast(first), "_at").withColumn("_r", F.row_number().over(w))  # `blocks` rows
    return picked.filter(F.col("_r") <= limit // blocks).select("r.*", "block")


def byte_ranges(spark: SparkSession, path: str, schema: T.StructType, offsets: list[int], limit: int) -> DataFrame:
    """The first `limit` records from each byte offset of a file of JSON lines, with the `offset`; one task per offset.

    A line that begins before the offset is left out; blank and malformed lines give no record and aren't counted. An
    offset at or behind the file's end gives nothing, and ranges may overlap. Only what the records need is read.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri.removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = pa.fs.FileSystem.from_uri(uri)
        for b in batches:
            for offset in b.column("offset").to_pylist():
                lines: list[str] = []
                with store.open_input_file(name) as f:
                    if offset < f.size():
                        f.seek(max(offset - 1, 0))
                        lines = _records(f, limit, partial=offset > 0)
                yield pa.RecordBatch.from_arrays([pa.array([offset] * len(lines), pa.int64()), pa.array(lines, pa.string())], ["offset", "line"])

    asked = spark.createDataFrame([(int(o),) for o in offsets], "offset long").repartition(max(len(offsets), 1))
    lines = asked.mapInArrow(run, "offset long, line string")
    return lines.select(parsed(F.col("line"), schema).alias("r"), "offset").filter("r is not null").select("r.*", "offset")


def _records(f, limit: int, partial: bool) -> list[str]:
    """Up to `limit` lines holding a JSON object from here on; the rest of a line that began before is skipped."""
    out, rest = [], b""
    while len(out) < limit:
        more = f.read(1 << 20)
        *whole, rest = (rest + more).split(b"\n")
        if not more:
            whole, rest = [rest], b""
        for raw in whole:
            if partial:
                partial = False  # ends the line that holds the byte before the offset
            elif len(out) < limit and _is_object(raw):
                out.append(raw.decode("utf-8", "replace"))
        if not more:
            break
    return out


def _is_object(raw: bytes) -> bool:
    try:
        return isinstance(json.loads(raw), dict)
    except ValueError:
        return False


def scan(spark: SparkSession, path: str, schema: T.StructType, limit: int, sampling: str = "prefix", blocks: int = 24) -> DataFrame:
    """`limit` records of a file of JSON lines with their `offset`: its first ones (`prefix`), or limit // blocks from each
    of `blocks` evenly spaced places (`spread`; a remainder is dropped). Another sampling is an error."""
    if sampling == "prefix":
        return byte_ranges(spark, path, schema, [0], limit)
    if sampling != "spread":
        raise ValueError(f"unknown sampling: {sampling}")
    size = file_sizes(spark, path).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return byte_ranges(spark, path, schema, sorted({size * k // blocks for k in range(blocks)}), limit // blocks)


def csv_by_key(spark: SparkSession, path: str, key: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a CSV file with a header, the last one of each key; all columns are strings unless a schema says more."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path).withColumn("_id", F.monotonically_increasing_id())
    cols = [c for c in df.columns if c not in (key, "_id")]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), "_id").alias("r")).select(key, *[f"r.{c}" for c in cols])


def workbook(spark: SparkSession, path: str, needed: str | None = None) -> DataFrame:
    """Rows of a workbook's first sheet, the header in row 1, as strings; rows whose `needed` is blank are left out.

    Workbooks are labelled by hand, so the driver reads them. Needs openpyxl.
    """
    try:
        from openpyxl import load_workbook
    except ImportError as e:
        raise ImportError("reading workbooks needs openpyxl; save the sheet as CSV and use csv_by_key instead") from e
    rows = load_workbook(path, data_only=True).active.iter_rows(values_only=True)
    names = [str(c) for c in next(rows)]
    df = spark.createDataFrame([[None if v is None else str(v) for v in r] for r in rows], ", ".join(f"`{n}` string" for n in names))
    return df if needed is None else df.filter(F.trim(F.coalesce(needed, F.lit(""))) != "")


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a file that is one JSON object; empty if there is no file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "key string, value string")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")))


def sitemap_locations(xml: Column, kind: str = "url") -> Column:
    """Trimmed, non-empty locations of a sitemap (`url`) or of an index (`sitemap`), whatever the namespace."""
    found = F.xpath(xml, F.lit(f"//*[local-name()='{kind}']/*[local-name()='loc']/text()"))
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"^\s+|\s+$", "")), lambda u: u != "")


def listed(sitemaps: list[DataFrame], url: str) -> DataFrame:
    """The URLs of several sitemaps one after the other, with the number of the `list`; repeats stay."""
    return reduce(DataFrame.unionByName, [df.select(F.col(url).alias("url"), F.lit(k).alias("list")) for k, df in enumerate(sitemaps)])


def cluster_dump(spark: SparkSession, path: str) -> DataFrame:
    """(scenario, cluster_id, n) of a dump of clusters written by sinks.write_clusters."""
    return spark.read.schema("scenario string, cluster_id string, n long").json(path)


def https(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def product_code(url: Column) -> Column:
    """What follows the first /p/ of a URL, null without it."""
    return F.nullif(F.regexp_extract(url, r"/p/([^/?#]+)", 1), F.lit(""))


# The block's anchor, how far it reaches, and its fields.
ANCHOR = r"""['"]pagetype['"]\s*:\s*['"]product['"]"""
REACH = 4000
FIELDS = ["prodid", "baseProduct", "pname", "pvalue", "p_actual_price", "waist", "fit", "cuff", "zipOrButton", "CD_Color", "pcat", "psubcat", "pgender", "sleeve"]


def page_fields(html: Column, fields: list[str] = FIELDS) -> Column:
    """Struct of a product page's metadata fields, or of some of them: null where a field is absent, empty where it is published empty.

    Null without the block's anchor. Values stand in single or double quotes, with escapes kept as written.
    """
    at = F.regexp_instr(html, F.lit(ANCHOR))
    block = F.substring(html, at, F.lit(REACH))

    def field(name: str) -> Column:
        head = rf"""['"]{name}['"]\s*:\s*"""
        single, double = head + r"'((?:[^'\\]|\\.)*)'", head + r'"((?:[^"\\]|\\.)*)"'
        s_at, d_at = F.regexp_instr(block, F.lit(single)), F.regexp_instr(block, F.lit(double))
        first_single = (s_at > 0) & ((d_at == 0) | (s_at < d_at))
        value = F.when(first_single, F.regexp_extract(block, single, 1)).when(d_at > 0, F.regexp_extract(block, double, 1))
        return F.regexp_replace(value, r"^\s+|\s+$", "").alias(name)

    return F.when(at > 0, F.struct(*map(field, fields)))


def result_count(payload: Column) -> Column:
    """pagination.totalNumberOfResults of a response; an error where it is missing."""
    n = F.get_json_object(payload, "$.pagination.totalNumberOfResults").cast("long")
    return F.when(n.isNotNull(), n).otherwise(F.raise_error(F.lit("response without pagination.totalNumberOfResults")).cast("long"))


def catalogue_counts(urls: DataFrame, url: str) -> DataFrame:
    """One row: URLs, those of products, coded ones, distinct variants and distinct styles (the code before its dash)."""
    code = product_code(F.col(url))
    return urls.withColumn("_c", code).agg(
        F.count(F.lit(1)).alias("n_urls"), F.sum(F.when(F.col(url).contains("/p/"), 1).otherwise(0)).alias("n_products"), F.count("_c").alias("n_coded"),
        F.countDistinct("_c").alias("n_variants"), F.countDistinct(F.split("_c", "-")[0]).alias("n_styles"),
    )
