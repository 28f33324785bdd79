"""Sources, landing and sinks over files that Spark reads; paths may lie in any store that Spark opens."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.session import share_code

#: Format and options by file extension.
FORMATS: dict[str, tuple[str, dict[str, str]]] = {
    "csv": ("csv", {"header": "true", "inferSchema": "true", "escape": '"', "multiLine": "true"}),
    "tsv": ("csv", {"header": "true", "inferSchema": "true", "sep": "\t"}),
    "json": ("json", {}),
    "jsonl": ("json", {}),
    "ndjson": ("json", {}),
    "parquet": ("parquet", {}),
    "orc": ("orc", {}),
    "avro": ("avro", {}),
    "xml": ("xml", {"rowTag": "row"}),
    "txt": ("text", {}),
    "md": ("text", {}),
    "log": ("text", {}),
}


def read_any(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Read a file or folder with the reader that its extension names; anything unknown is read as bytes."""
    name = path.rstrip("/").rpartition("/")[2].removesuffix(".gz").removesuffix(".zst")
    fmt, known = FORMATS.get(name.rpartition(".")[2].lower(), ("binaryFile", {}))
    return spark.read.format(fmt).options(**(known | options)).load(path)


def read_many(spark: SparkSession, paths: Sequence[str], **options: str) -> DataFrame:
    """Several paths of any known format as one relation by column name, with each row's file in file_path."""
    parts = [read_any(spark, p, **options).withColumn("file_path", F.col("_metadata.file_path")) for p in paths]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line_no, content) of text files of any size: lines are numbered within each block of a file, after the lines of the blocks before it."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("content"), F.monotonically_increasing_id().alias("_i"))
    before = F.sum("n").over(W.partitionBy("file_path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    blocks = t.groupBy("file_path", "_block").agg(F.count("*").alias("n")).select("file_path", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("file_path", "_block").orderBy("_i"))
    return t.withColumn("_n", own).join(blocks, ["file_path", "_block"]).select("file_path", (F.col("_n") + F.col("_before")).alias("line_no"), "content")


def select_lines(lines: DataFrame, first: int | None = None, last: int | None = None, tail: int | None = None) -> DataFrame:
    """Lines from first to last of every file, or its last tail lines."""
    if tail is not None:
        n = lines.groupBy("file_path").agg(F.max("line_no").alias("_n"))
        return lines.join(n, "file_path").where(F.col("line_no") > F.col("_n") - tail).drop("_n")
    return lines.where(F.col("line_no").between(first or 1, last if last is not None else (1 << 62)))


def discover_fields(lines: DataFrame, column: str = "content") -> DataFrame:
    """(field, n, types, mixed): the top-level fields of JSON lines, how many lines have each, and the kinds of its values.

    One pass over the lines, counted before the shuffle. types: a map from kind to lines; kinds are OBJECT, ARRAY, STRING,
    NUMBER, BOOLEAN and NULL; mixed: more than one kind but NULL. The field null stands for lines that are no JSON
    object. A field that an object repeats refuses the line, as it does in VARIANT.
    """
    v = F.try_parse_json(column)
    kind = F.schema_of_variant("v")
    t = lines.select(v.alias("v")).select("v", F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("good"))
    good = t.where("good")
    fields = good.lateralJoin(good.sparkSession.tvf.variant_explode(F.col("v").outer())).select(F.col("key").alias("field"), F.schema_of_variant("value").alias("s"))
    told = F.when(F.col("s").startswith("OBJECT"), "OBJECT").when(F.col("s").startswith("ARRAY"), "ARRAY").when(F.col("s") == "VOID", "NULL").when(F.col("s").isin("STRING", "BOOLEAN"), F.col("s")).otherwise("NUMBER")
    every = fields.select("field", told.alias("kind")).unionByName(t.where(~F.col("good")).select(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("kind")))
    n = every.groupBy("field", "kind").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n"))))
    return n.groupBy("field").agg(F.sum("n").alias("n"), F.map_from_entries(pairs).alias("types"), (F.count_if(F.col("kind") != "NULL") > 1).alias("mixed"))


def read_ndjson_shallow(spark: SparkSession, path: str, fields: Sequence[str] | None = None) -> DataFrame:
    """JSON lines with their top-level fields as VARIANT columns; lines that are no JSON object are left out.

    fields: which, in this order; if not given, all that any line has, by name (one more pass). Values of mixed kinds
    stay as they are in VARIANT.
    """
    lines = read_lines(spark, path)
    if fields is None:
        fields = sorted(r["field"] for r in discover_fields(lines).where("field is not null").select("field").collect())  # one row a field
    kept = lines.withColumn("v", F.try_parse_json("content")).where(F.schema_of_variant("v").startswith("OBJECT"))
    at = lambda f: '$["' + f.replace("\\", "\\\\").replace('"', '\\"') + '"]'
    return kept.select("file_path", "line_no", *[F.try_variant_get("v", at(f), "variant").alias(f) for f in fields])


def list_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, name, length, modificationTime) of files, with their text if asked; without it no body is read."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return t.select("path", name, "length", "modificationTime", *([F.decode("content", "utf-8").alias("content")] if content else []))


def parquet_stats(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, rows, bytes) of Parquet files, counted by file without reading a column."""
    sizes = list_files(spark, path).select(F.col("path").alias("file_path"), F.col("length").alias("bytes"))
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file_path")).groupBy("file_path").agg(F.count("*").alias("rows"))
    norm = lambda c: F.regexp_replace(c, "^([a-z]+:)/+", "$1/")
    return rows.withColumn("file_path", norm("file_path")).join(sizes.withColumn("file_path", norm("file_path")), "file_path")


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, row_group, rows, bytes, columns): one row a row group of Parquet files, from their footers; no data page is read.

    columns: of every leaf column its compressed bytes, nulls, and least and greatest value as strings, where the writer
    has left them. Files are listed by Spark and their footers read in tasks, with the file systems that Arrow knows
    (file, hdfs, s3, gs); other stores are refused by it. Hidden files are left out.
    """
    share_code(spark)
    paths = list_files(spark, path).where(F.col("path").endswith(".parquet")).select("path")
    kind = "file_path string, row_group int, rows long, bytes long, columns array<struct<name: string, bytes: long, nulls: long, low: string, high: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = pa.struct([("name", pa.string()), ("bytes", pa.int64()), ("nulls", pa.int64()), ("low", pa.string()), ("high", pa.string())])
        for batch in batches:
            out: list[tuple] = []
            for p in batch.column(0).to_pylist():
                store, where = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", p))
                with store.open_input_file(where) as f:
                    meta = pq.read_metadata(f)
                for g in range(meta.num_row_groups):
                    group, columns = meta.row_group(g), []
                    for c in range(group.num_columns):
                        col = group.column(c)
                        s = col.statistics
                        told = s is not None and s.has_min_max
                        columns.append({"name": col.path_in_schema, "bytes": col.total_compressed_size, "nulls": s.null_count if s is not None and s.has_null_count else None, "low": str(s.min) if told else None, "high": str(s.max) if told else None})
                    out.append((p, g, group.num_rows, group.total_byte_size, columns))
            cols = [[r[i] for r in out] for i in range(5)]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(column)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file_path", "row_group", "rows", "bytes", "columns"])

    return paths.repartition(max(1, min(200, paths.count() // 16))).mapInArrow(run, kind)


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
#: Items of a quantile sketch: 400 keep ranks within about 0.7 % (a KLL sketch), in some 4 kB.
SKETCH_K = 400


def profile(df: DataFrame) -> DataFrame:
    """(column, type, n, nulls, distinct, low, high, keys, ranks): one pass over df.

    distinct is approximate. low and high are as strings. keys and ranks are sketches of fixed size, of the values and,
    for numbers, of their order: they can be stored, and profiles of parts merged (merge_profiles) and asked for quantiles
    (quantiles). Columns of nested or binary types are left out.
    """
    cols = [(c, t) for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary", "variant"))]
    aggs = []
    for i, (c, t) in enumerate(cols):
        col = F.col(f"`{c}`")
        number = t.startswith(_NUMBERS)
        ranks = F.kll_sketch_agg_double(col.cast("double"), F.lit(SKETCH_K)) if number else F.lit(None).cast("binary")
        keys = F.hll_sketch_agg(col.cast("string"))
        aggs.append(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count("*").alias("n"), F.count_if(col.isNull()).alias("nulls"), F.hll_sketch_estimate(keys).alias("distinct"), F.min(col).cast("string").alias("low"), F.max(col).cast("string").alias("high"), keys.alias("keys"), ranks.alias("ranks")).alias(f"c{i}"))
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(cols))])).alias("p")).select("p.*")


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """The profile of the whole from profiles of its parts, whose rows are in one table; a column's type has to be the same in all."""
    number = F.col("type").rlike(f"^({'|'.join(_NUMBERS)})")
    order = F.struct(F.when(number, F.col("low").try_cast("double")).alias("x"), F.col("low").alias("y"))
    top = F.struct(F.when(number, F.col("high").try_cast("double")).alias("x"), F.col("high").alias("y"))
    g = profiles.groupBy("column", "type").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.hll_union_agg("keys").alias("keys"), F.min(F.when(F.col("low").isNotNull(), order))["y"].alias("low"),
        F.max(F.when(F.col("high").isNotNull(), top))["y"].alias("high"), F.kll_merge_agg_double("ranks").alias("ranks"), F.count_if(number).alias("_numbers"),
    )
    return g.select("column", "type", "n", "nulls", F.hll_sketch_estimate("keys").alias("distinct"), "low", "high", "keys", F.when(F.col("_numbers") > 0, F.col("ranks")).alias("ranks"))


def quantiles(profiles: DataFrame, at: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, quantiles): of every number column that has values, one value for each rank in at."""
    filled = profiles.where(F.col("ranks").isNotNull() & (F.col("n") > F.col("nulls")))
    return filled.select("column", F.array(*[F.kll_sketch_get_quantile_double("ranks", F.lit(float(q))) for q in at]).alias("quantiles"))


def convert(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), codec: str | None = None) -> DataFrame:
    """Write df in a format, partitioned and compressed, and read it back."""
    w = df.write.mode("overwrite").format(fmt)
    w = w.option("compression", codec) if codec else w
    w = w.option("header", "true") if fmt == "csv" else w
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
    r = df.sparkSession.read.format(fmt).option("header", "true")
    return r.schema(df.schema).load(path)


def export_tables(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write tables under a folder with a manifest of (table, rows, columns); the manifest is written last."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        back = spark.read.parquet(f"{path}/{name}")
        rows.append((name, back.count(), ",".join(back.columns)))
    manifest = spark.createDataFrame(rows, "table string, rows long, columns string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/_manifest")


def import_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a manifest; a table with another row count than the manifest says is refused."""
    out = {}
    for r in spark.read.schema("table string, rows long, columns string").json(f"{path}/_manifest").collect():
        df = spark.read.parquet(f"{path}/{r['table']}")
        if df.count() != r["rows"]:
            raise ValueError(f"{r['table']} is not the table that was exported")
        out[r["table"]] = df
    return out


def append_log(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Append rows to a hive-partitioned folder; every task writes files of its own, so writers never meet."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A hive-partitioned folder with its keys as columns, files of different shapes merged by name."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def fan_out(df: DataFrame, key: str, fn: Callable[[dict], str], parallelism: int, stage: str = "call") -> DataFrame:
    """(key, status, body, error, stage): a function of every row on so many tasks at once; a failed row stays a row."""
    share_code(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append((row[key], "ok", str(fn(row)), None, stage))
                except Exception as e:  # the error is the receipt
                    out.append((row[key], "error", None, repr(e), stage))
            yield pd.DataFrame(out, columns=[key, "status", "body", "error", "stage"])

    return df.repartition(parallelism).mapInPandas(run, f"{key} {kind}, status string, body string, error string, stage string")


def stages(df: DataFrame, key: str, fns: Sequence[tuple[str, Callable[[dict], str]]], parallelism: int) -> DataFrame:
    """Receipts after several stages: bodies of one feed the next, failures are carried with the stage that failed."""
    failed = None
    cur = fan_out(df, key, fns[0][1], parallelism, fns[0][0])
    for name, fn in fns[1:]:
        bad = cur.where("status <> 'ok'")
        failed = bad if failed is None else failed.unionByName(bad)
        cur = fan_out(cur.where("status = 'ok'").select(key, "body"), key, fn, parallelism, name)
    return cur if failed is None else cur.unionByName(failed)


def snapshot_tables(sources: dict[str, Callable[[], DataFrame]], path: str, log_path: str, spark: SparkSession, at: Column, parallel: int = 4) -> DataFrame:
    """Copy each source to a new folder of its own, a few at a time; (table_name, rows, status, error, folder, finished) goes to the pull log.

    The log says which folder of a table is its copy (read_snapshot), so a copy is replaced whole or not at all, and a
    source that fails, at any point, leaves its last copy as it was and an error row in the log.
    """

    def pull(item: tuple[str, Callable[[], DataFrame]]) -> tuple:
        name, source = item
        folder = f"{path}/{name}/{uuid.uuid4().hex}"
        try:
            source().write.parquet(folder)
            return name, spark.read.parquet(folder).count(), "ok", None, folder
        except Exception as e:  # whatever a source raises is its receipt
            return name, None, "error", str(e), None

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(pull, sources.items()))
    log = spark.createDataFrame(rows, "table_name string, rows long, status string, error string, folder string").withColumn("finished", at)
    log.write.mode("append").parquet(log_path)
    return log


def read_snapshot(spark: SparkSession, log_path: str, name: str) -> DataFrame:
    """The last whole copy of a table; one that was never pulled is refused."""
    row = spark.read.parquet(log_path).where((F.col("table_name") == name) & (F.col("status") == "ok")).agg(F.max_by("folder", "finished").alias("f")).first()
    if row["f"] is None:
        raise LookupError(f"{name} was never pulled")
    return spark.read.parquet(row["f"])


def read_jdbc(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in parallel ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def fake_rows(spark: SparkSession, n: int, spec: dict[str, str], seed: int = 0) -> DataFrame:
    """n rows of made-up values: spec gives each column's kind (int, double, word, date, null); the same seed, the same rows."""
    h = lambda c: F.pmod(F.xxhash64("id", F.lit(c), F.lit(seed)), F.lit(1_000_000))
    kinds = {
        "int": lambda c: h(c),
        "double": lambda c: h(c) / 1000.0,
        "word": lambda c: F.concat(F.lit("w"), h(c) % 1000),
        "date": lambda c: F.date_add(F.lit("2024-01-01").cast("date"), (h(c) % 365).cast("int")),
        "null": lambda c: F.lit(None).cast("string"),
    }
    return spark.range(n).select("id", *[kinds[k](c).alias(c) for c, k in spec.items()])


#: Semantic types by pattern, the first that fits a value counts.
SEMANTIC = {"url": r"^https?://\S+$", "email": r"^[^@\s]+@[^@\s]+\.[a-z]+$", "timestamp": r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d", "date": r"^\d{4}-\d\d-\d\d$", "integer": r"^-?\d+$", "number": r"^-?\d+\.\d+$", "json": r"^[\[{].*[\]}]$", "word": r"^\S+$"}


def infer_semantic_types(df: DataFrame, sample: int | None = None) -> DataFrame:
    """(column, semantic, votes): what most values of each column look like, over all rows or so many of them."""
    cols = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary", "variant"))]
    t = (df if sample is None else df.limit(sample)).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols])).alias("x")).select("x.*").where("v is not null")
    kind = F.lit("text")
    for name, pattern in reversed(SEMANTIC.items()):
        kind = F.when(F.col("v").rlike(pattern), name).otherwise(kind)
    g = t.groupBy("column", kind.alias("semantic")).agg(F.count("*").alias("votes"))
    return g.groupBy("column").agg(F.max_by("semantic", F.struct("votes", "semantic")).alias("semantic"), F.max("votes").alias("votes"))


def publish_objects(df: DataFrame, path: str, producer: str, run: str, max_rows: int = 100_000) -> DataFrame:
    """Write df once under its run's name with a manifest of its files; a run that was written is refused.

    The manifest has each file's checksum, length, rows, the schema and the time of publication. Files are bounded by
    max_rows, since a checksum reads a file whole.
    """
    target = f"{path}/producer={producer}/run={run}"
    df.write.mode("errorifexists").option("maxRecordsPerFile", max_rows).parquet(f"{target}/data")
    spark = df.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{target}/data")
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), "length")
    counts = spark.read.parquet(f"{target}/data").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
    names = names.join(counts, "file", "left").withColumns({"rows": F.coalesce("rows", F.lit(0)), "schema": F.lit(df.schema.simpleString()), "published": F.current_timestamp()})
    names.write.mode("errorifexists").parquet(f"{target}/manifest")
    return spark.read.parquet(f"{target}/manifest")


def audit_objects(spark: SparkSession, path: str, producer: str, run: str) -> DataFrame:
    """(file, verdict) of a published run: ok, changed, missing or extra against its manifest."""
    target = f"{path}/producer={producer}/run={run}"
    now = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{target}/data").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("_now"))
    j = spark.read.parquet(f"{target}/manifest").join(now, "file", "full_outer")
    v = F.when(F.col("sha256").isNull(), "extra").when(F.col("_now").isNull(), "missing").when(F.col("sha256") == F.col("_now"), "ok").otherwise("changed")
    return j.select("file", v.alias("verdict"))
