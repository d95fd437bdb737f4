"""Scans: schemas are stated, never inferred; coercion never fails."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions._col import text
from ..functions.text import fix_encoding
from ..operators.numbering import union_all
from ..operators.scale import keep_first


def _strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def scan_csv_union(spark: SparkSession, path, columns, rename: dict[str, str], *, key=None, order=None, encoding="UTF-8") -> DataFrame:
    """Many CSV files of one layout as text columns, projected and renamed; empty text stays ''. With ``key`` one row per key, the first in
    ``order``."""
    df = spark.read.schema(_strings(columns)).option("header", True).option("encoding", encoding).option("emptyValue", "").option("nullValue", "\u0000").option("escape", '"').csv(path)
    df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in rename.items()])
    return keep_first(df, key, order) if key else df


def scan_headerless(spark: SparkSession, path, names, *, dates=(), numbers=(), date_format="MM/dd/yyyy") -> DataFrame:
    """Headerless CSV with positional names; bad dates and numbers become null."""
    df = spark.read.schema(_strings(names)).option("header", False).option("emptyValue", "").option("nullValue", "\u0000").option("escape", '"').csv(path)
    return df.select(*[F.try_to_date(F.trim(n), date_format).alias(n) if n in dates else F.col(n).try_cast("double").alias(n) if n in numbers else F.col(n) for n in names])


def harmonize(df: DataFrame, aliases: dict[str, str], *, pattern=r"^V_(\d\d)$", replacement=r"Violation \1", keep: tuple[str, str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """One schema for layouts of different years: header blanks squeezed, old names mapped, numbered columns renamed by a pattern, rows of the
    wanted class kept (a missing class counts), types tried."""
    import re
    names = [re.sub(r"\s+", " ", c).strip() for c in df.columns]
    out = df.toDF(*[aliases.get(n, re.sub(pattern, replacement, n)) for n in names])
    if keep and keep[0] in out.columns:
        out = out.filter(F.lower(F.trim(F.coalesce(F.col(f"`{keep[0]}`"), F.lit(keep[1])))) == keep[1].lower())
    for c, t in (types or {}).items():
        if c in out.columns:
            out = out.withColumn(c, F.try_to_date(F.col(f"`{c}`")) if t == "date" else F.regexp_replace(F.trim(F.col(f"`{c}`").cast("string")), r"\.0$", "").try_cast(t))
    return out


def scan_schema_evolve(frames, aliases: dict[str, str], **kwargs) -> DataFrame:
    """Harmonised layouts in one table; columns a layout lacks are null."""
    return union_all([harmonize(f, aliases, **kwargs) for f in frames])


def with_file_tag(df: DataFrame, out: str, pattern: str, default: str = "cur") -> DataFrame:
    """Tag from the row's file path."""
    tag = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    return df.withColumn(out, F.when(tag != "", tag).otherwise(F.lit(default)))


def scan_tagged_union(parts: list[tuple[DataFrame, str, str]], out: str = "src") -> DataFrame:
    """Union of (scan, path pattern, default tag) parts, each row tagged from its file name."""
    return union_all([with_file_tag(df, out, rx, default) for df, rx, default in parts])


def scan_bbox(spark: SparkSession, path, *, xmin, xmax, ymin, ymax, box="bbox", columns=("*",)) -> DataFrame:
    """Parquet rows whose bounding box starts inside the box; the nested comparison reaches the file scan."""
    c = lambda n: F.col(f"{box}.{n}")
    return spark.read.parquet(path).filter((c("xmin") >= xmin) & (c("xmin") <= xmax) & (c("ymin") >= ymin) & (c("ymin") <= ymax)).select(*columns)


def array_field(arr, field: str) -> Column:
    """Array of structs to the array of one field."""
    return F.transform(F.col(arr) if isinstance(arr, str) else arr, lambda x: x[field])


def scan_address_points(spark: SparkSession, path, *, levels="address_levels", **box) -> DataFrame:
    """Address points with the first and the last address level."""
    df = scan_bbox(spark, path, **box)
    lv = F.transform(F.col(levels), lambda x: x["value"])
    return df.withColumn("state", F.try_element_at(lv, F.lit(1))).withColumn("muni", F.try_element_at(lv, F.lit(-1)))


def ring_area(ring) -> Column:
    """Shoelace area of a ring."""
    n = F.size(ring)
    at = lambda i, f: F.get(ring, F.pmod(i, n))[f]
    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + at(i, "x") * at(i + 1, "y") - at(i + 1, "x") * at(i, "y"))) / 2


def scan_polygons(df: DataFrame, *, where: Column, name: str, polygons: str, min_area: float, digits: int = 5) -> DataFrame:
    """(name, ring): rings of the selected areas (polygons array<array<struct<x,y>>>), small ones left out, coordinates rounded."""
    r = df.filter(where).select(F.col(name).alias("name"), F.explode(polygons).alias("ring")).filter(ring_area(F.col("ring")) >= min_area)
    return r.select("name", F.transform("ring", lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))).alias("ring"))


def any_category(categories, pattern: str, first_not=()) -> Column:
    """Any category matches and the first one matches none of the other patterns."""
    c = F.coalesce(F.col(categories), F.array().cast("array<string>"))
    out = F.exists(c, lambda x: x.rlike(pattern))
    for rx in first_not:
        out = out & ~F.coalesce(F.get(c, 0), F.lit("")).rlike(rx)
    return out


def scan_jsonl_any(spark: SparkSession, path, schema: str, categories: str, pattern: str, first_not=()) -> DataFrame:
    return spark.read.schema(schema).json(path).filter(any_category(categories, pattern, first_not))


def scan_prefilter_text(spark: SparkSession, path, prefilter: str, schema: str) -> DataFrame:
    """JSON lines where a cheap test of the raw line comes before parsing."""
    return spark.read.text(path).filter(F.col("value").rlike(prefilter)).select(F.from_json("value", schema).alias("r")).select("r.*")


def scan_json_variant(spark: SparkSession, path, item: str, *, wrappers=("places", "restaurants"), whole_files=True) -> tuple[DataFrame, DataFrame]:
    """(items, unreadable): JSON documents that are a list of items or an object with the list under one of the wrapper names. Unreadable
    documents are set aside with their path."""
    docs = spark.read.text(path, wholetext=whole_files).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("doc"))
    arr = f"array<struct<{item}>>"
    wrapped = F.from_json("doc", "struct<" + ",".join(f"{w}:{arr}" for w in wrappers) + ">", {"mode": "PERMISSIVE"})
    items = F.when(F.startswith("doc", F.lit("[")), F.from_json("doc", arr)).otherwise(F.coalesce(*[wrapped[w] for w in wrappers]))
    d = docs.withColumn("ok", F.try_parse_json("doc").isNotNull()).withColumn("items", items)
    return d.filter(F.col("ok") & F.col("items").isNotNull()).select("file", F.explode("items").alias("i")).select("file", "i.*"), d.filter(~F.col("ok") | F.col("items").isNull()).select("file")


def scan_json_quarantine(spark: SparkSession, path, item: str, *, wrappers=("places", "restaurants"), required=(), whole_files=True) -> tuple[DataFrame, DataFrame]:
    """(items, quarantine) of JSON documents that are a list of items or an object with the list under a wrapper name. Items carry their file and their place in it
    (``row``, from 0). The quarantine has one line (file, row, reason, text) for each document that can't be used (row null) and each item that can't: 'empty', 'not JSON',
    'neither list nor wrapped list', 'not an object', 'a field has another type', 'without <field>'. Every document and every item stands on exactly one side.

    Items are split as they were written and parsed one by one, so a bad item costs itself only."""
    docs = spark.read.text(path, wholetext=whole_files).select(F.col("_metadata.file_path").alias("file"), F.btrim("value", F.lit(" \t\r\n")).alias("doc"))
    ok = F.try_parse_json("doc").isNotNull()
    wrapped = F.from_json("doc", "struct<" + ",".join(f"{w}:string" for w in wrappers) + ">")
    body = F.when(F.startswith("doc", F.lit("[")), F.col("doc")).otherwise(F.coalesce(*[F.when(F.trim(wrapped[w]).startswith("["), wrapped[w]) for w in wrappers]))
    reason = F.when(F.coalesce(F.col("doc"), F.lit("")) == "", "empty").when(~ok, "not JSON").when(body.isNull(), "neither list nor wrapped list")
    judged = docs.withColumn("reason", reason).withColumn("body", F.when(reason.isNull(), body))
    one = judged.filter("reason is null").select("file", F.posexplode(F.from_json("body", "array<string>")).alias("row", "text"))
    parsed = one.withColumn("i", F.from_json("text", f"struct<{item}, _bad string>", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    why = F.when(~F.coalesce(F.startswith(F.trim("text"), F.lit("{")), F.lit(False)), "not an object").when(F.col("i._bad").isNotNull(), "a field has another type")
    for field in required:
        why = why.when(F.col(f"i.{field}").isNull(), f"without {field}")
    parsed = parsed.withColumn("reason", why)
    items = parsed.filter("reason is null").select("file", "row", "i.*").drop("_bad")
    bad = judged.filter("reason is not null").select("file", F.lit(None).cast("int").alias("row"), "reason", F.col("doc").alias("text"))
    return items, bad.unionByName(parsed.filter("reason is not null").select("file", "row", "reason", "text"))


def clean_text_columns(df: DataFrame, columns) -> DataFrame:
    return df.select(*[fix_encoding(text(c)).alias(c) if c in columns else F.col(c) for c in df.columns])
