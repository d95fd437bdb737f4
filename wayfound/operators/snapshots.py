"""Snapshot manifests: content hashes per shard, differences, versions, guards, retention."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _row_text(columns) -> Column:
    return F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])


def _lanes(h: Column) -> list[Column]:
    """Four numbers from a row hash; their sums do not depend on row order, so every task can add up its own rows."""
    return [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")) for i in range(4)]


def _combined(n: Column, sums) -> Column:
    return F.md5(F.concat_ws("-", n.cast("string"), *[s.cast("string") for s in sums]))


def manifest(df: DataFrame, *, shard: str, columns, dated=()) -> DataFrame:
    """(shard, rows, bytes, hash, core_hash, file): order-free content hash per shard, and the hash without the ``dated`` columns."""
    h, core = F.md5(_row_text(columns)), F.md5(_row_text([c for c in columns if c not in dated]))
    t = df.select(F.col(shard).alias("shard"), h.alias("h"), core.alias("c"), F.octet_length(_row_text(columns)).alias("b"))
    a = t.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("b").alias("bytes"), *[s.alias(f"h{i}") for i, s in enumerate(_lanes(F.col("h")))], *[s.alias(f"c{i}") for i, s in enumerate(_lanes(F.col("c")))])
    out = a.select("shard", "rows", "bytes", _combined(F.col("rows"), [F.col(f"h{i}") for i in range(4)]).alias("hash"), _combined(F.col("rows"), [F.col(f"c{i}") for i in range(4)]).alias("core_hash"))
    return out.withColumn("file", F.concat(F.col("shard").cast("string"), F.lit("-"), F.substring("hash", 1, 12)))


def build_version(man: DataFrame) -> DataFrame:
    """Manifest with the 12-letter build hash all shards share."""
    h = F.md5(F.concat_ws(":", F.col("shard").cast("string"), F.col("hash")))
    one = man.agg(F.count("*").alias("n"), *[s.alias(f"s{i}") for i, s in enumerate(_lanes(h))]).select(F.substring(_combined(F.col("n"), [F.col(f"s{i}") for i in range(4)]), 1, 12).alias("b"))
    return man.withColumn("build", one.scalar())


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(shard, status): added, removed, unchanged, date only, changed."""
    o, n = old.select("shard", F.col("hash").alias("oh"), F.col("core_hash").alias("oc")), new.select("shard", F.col("hash").alias("nh"), F.col("core_hash").alias("nc"))
    status = F.when(F.col("oh").isNull(), "added").when(F.col("nh").isNull(), "removed").when(F.col("oh") == F.col("nh"), "unchanged").when(F.col("oc") == F.col("nc"), "date only").otherwise("changed")
    return o.join(n, "shard", "full").select("shard", status.alias("status"))


def next_version(history: DataFrame, day: str) -> DataFrame:
    """One row: the next version '<day>.<n>'; null when the history already holds a later day."""
    part = F.split("version", r"\.")
    h = history.select(F.get(part, 0).alias("d"), F.get(part, 1).try_cast("int").alias("n"))
    one = h.agg(F.max("d").alias("last"), F.max(F.when(F.col("d") == day, F.col("n"))).alias("n"))
    return one.select(F.when(F.coalesce(F.col("last") > day, F.lit(False)), F.lit(None).cast("string")).otherwise(F.concat(F.lit(day + "."), (F.coalesce("n", F.lit(0)) + 1).cast("string"))).alias("version"))


def swing_guard(old: DataFrame, new: DataFrame, *, limit: float = 0.15) -> DataFrame:
    """(shard, old_rows, new_rows) of shards whose row count moves more than the limit; empty = publish."""
    j = old.select("shard", F.col("rows").alias("old_rows")).join(new.select("shard", F.col("rows").alias("new_rows")), "shard", "full")
    moved = F.abs(F.coalesce("new_rows", F.lit(0)) - F.coalesce("old_rows", F.lit(0))) > limit * F.coalesce("old_rows", F.lit(0))
    return j.filter(moved).select("shard", "old_rows", "new_rows")


def verify(man: DataFrame, actual: DataFrame) -> DataFrame:
    """(shard, problem): differences between a manifest and the manifest of the data itself."""
    m = man.select("shard", *[F.col(c).alias("m_" + c) for c in ("rows", "bytes", "hash")])
    a = actual.select("shard", *[F.col(c).alias("a_" + c) for c in ("rows", "bytes", "hash")])
    j = m.join(a, "shard", "full")
    gone, stray = F.col("a_hash").isNull(), F.col("m_hash").isNull()
    both = ~gone & ~stray
    checks = [F.when(gone, F.lit("missing")), F.when(stray, F.lit("not in the manifest")), *[F.when(both & (F.col("m_" + c) != F.col("a_" + c)), F.lit(c + " differ" if c != "hash" else "hash differs")) for c in ("rows", "bytes", "hash")]]
    return j.select("shard", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256, rows, generated) of every JSON file of a published folder, read by the executors: a document with an array under ``rows`` counts its items, null where it doesn't
    parse."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    doc = F.decode("content", "UTF-8")
    parsed = F.when(F.try_parse_json(doc).isNotNull(), doc)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"),
                        F.json_array_length(F.get_json_object(parsed, "$.rows")).cast("long").alias("rows"), F.get_json_object(parsed, "$.generated").alias("generated"))


def digest_tree(files: DataFrame, fan: int = 256) -> DataFrame:
    """(level, node, digest) of a tree over (file, sha256): level 0 digests the files of each of ``fan`` buckets in the order of their names, level 1 the buckets. Two copies are equal where
    level 1 is; otherwise only buckets that differ need a look."""
    leaf = files.select(F.pmod(F.crc32(F.col("file").cast("binary")), F.lit(fan)).cast("int").alias("node"), F.concat_ws(":", "file", "sha256").alias("line"))
    low = leaf.groupBy("node").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest")).select(F.lit(0).alias("level"), "node", "digest")
    line = F.concat_ws(":", F.lpad(F.col("node").cast("string"), 6, "0"), "digest")
    top = low.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest")).select(F.lit(1).alias("level"), F.lit(0).alias("node"), "digest")
    return low.unionByName(top)


def verify_published(head: DataFrame, entries: DataFrame, stored: DataFrame, previous: DataFrame, *, schema: int, main: str = "places", max_file: int = 32 << 20, max_files: int = 400,
                     max_total: int = 256 << 20, version: str = r"^(\d{4}-\d{2}-\d{2})\.(\d+)$", name: str = "^[a-z]+(?:-[a-z0-9]+)*$") -> DataFrame:
    """(file, problem) for a published folder that does not hold what its manifest says; nothing where all is well.

    ``head``: the manifest's one row (schema, version, records_through, min_build); ``entries``: its files (name, path, sha256, bytes, rows); ``stored``: what the folder holds, from
    ``file_digests``; ``previous``: the paths (name, path) of the copy before, which readers part way through an update still need.
    Checked: schema number, version "<records_through>.<n>", a real day, least build; names, paths that carry the digest's first 12 letters, missing files, digest, length, caps, rows,
    the main file's day; previous files present and true to their names; files that nobody names. All comparisons are joins by path; sums are added up by Spark."""
    of = lambda file, text_, when: F.when(F.coalesce(when, F.lit(True)), F.struct(F.lit(file).cast("string").alias("file") if isinstance(file, str) else file.alias("file"), F.lit(text_).alias("problem")))
    listed = lambda df, checks: df.select(F.explode(F.array_compact(F.array(*checks))).alias("_p")).select("_p.*")
    day, number = F.regexp_extract("version", version, 1), F.regexp_extract("version", version, 2).try_cast("long")
    real = F.coalesce(F.col("records_through").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("records_through").try_cast("date").isNotNull(), F.lit(False))
    heads = listed(head, [of("manifest", "unknown schema", F.col("schema") != schema), of("manifest", "records_through is no day", ~real),
                          of("manifest", "version is not <day>.<n>", (day != F.col("records_through")) | (day == "") | number.isNull() | (number < 1)),
                          of("manifest", "least build is below 1", F.col("min_build") < 1)])
    good_name, sha = F.coalesce(F.col("name").rlike(name), F.lit(False)), F.lower(F.col("sha256"))
    good_path = F.coalesce(sha.rlike("^[0-9a-f]{64}$") & (F.col("path") == F.concat("name", F.lit("-"), F.substring(sha, 1, 12), F.lit(".json"))), F.lit(False))
    here = stored.select(F.col("file").alias("_file"), F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"), F.col("rows").alias("_rows"), F.col("generated").alias("_generated"))
    j = entries.withColumn("_well", good_name & good_path).join(here, F.col("path") == F.col("_file"), "left").withColumn("_through", head.select("records_through").scalar())
    there = F.col("_well") & F.col("_file").isNotNull()
    file = F.coalesce("path", "name")
    entry = listed(j, [of(file, "bad name", ~good_name), of(file, "path does not carry the digest", good_name & ~good_path), of(file, "missing", F.col("_well") & F.col("_file").isNull()),
                       of(file, "digest differs", there & (F.col("_sha") != sha)), of(file, "bytes differ", there & ~F.col("_bytes").eqNullSafe(F.col("bytes"))),
                       of(file, "too large", there & (F.col("_bytes") > max_file)), of(file, "does not parse", there & F.col("_rows").isNull()),
                       of(file, "rows differ", there & F.col("_rows").isNotNull() & ~F.col("_rows").eqNullSafe(F.col("rows"))),
                       of(file, "generated on another day", there & (F.col("name") == main) & ~F.col("_generated").eqNullSafe(F.col("_through")))])
    sums = j.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(there, F.col("_bytes"))), F.lit(0)).alias("b"), F.count_if(F.col("name") == main).alias("m"))
    whole = listed(sums, [of("manifest", "no files", F.col("n") == 0), of("manifest", "too many files", F.col("n") > max_files), of("manifest", "too large in all", F.col("b") > max_total), of("manifest", "no main file", F.col("m") == 0)])
    p = previous.select("path").distinct().join(here, F.col("path") == F.col("_file"), "left")
    old = listed(p, [of(F.col("path"), "the previous copy's file is missing", F.col("_file").isNull()),
                     of(F.col("path"), "the previous copy's content is not its name's", F.col("_file").isNotNull() & (F.regexp_extract("path", r"-([0-9a-f]{12})\.json$", 1) != F.substring("_sha", 1, 12)))])
    named = entries.select(F.col("path").alias("_file")).unionByName(previous.select(F.col("path").alias("_file"))).filter("_file is not null").distinct()
    stray = here.join(named, "_file", "left_anti").filter("_file <> 'manifest.json'").select(F.col("_file").alias("file"), F.lit("no manifest names it").alias("problem"))
    return heads.unionByName(entry).unionByName(whole).unionByName(old).unionByName(stray)


def retention(current: DataFrame, previous: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored files that neither the current nor the previous manifest names."""
    return stored.join(current.select("file").unionByName(previous.select("file")).distinct(), "file", "left_anti")
