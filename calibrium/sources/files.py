"""Readers and writers of JSON lines, JSON documents, run files, cards and raw responses, all through Spark's file sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset on one machine (tests) in a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="calibrium-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: rows and partition numbers stay as they are, whatever is lost."""
    path = scratch(df.sparkSession, "held")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_name() -> Column:
    return F.col("_metadata.file_name")


def read_jsonl(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """file, ord (line, from 0, blank ones not counted), body (variant). A bad line fails, or gives a null body if tolerant.

    A file is one row at first, which keeps the order of its lines; use it for files that fit a task. Larger ones are read
    in ranges by `ordered_lines`.
    """
    whole = spark.read.text(path, wholetext=True).select(file_name().alias("file"), "value")
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    rows = whole.select("file", F.posexplode(lines).alias("ord", "line"))
    return rows.select("file", "ord", (F.try_parse_json("line") if tolerant else F.parse_json(F.col("line"))).alias("body"))


def ordered_lines(spark: SparkSession, path: str, as_one: bool = False) -> DataFrame:
    """file, ord (line of the file, from 0, blank ones not counted), value; a file is read in byte ranges, by many tasks.
    as_one: the files of a folder, in the order of their names, are one file, called by the folder.

    A range's lines come in their order, so a line's place in it is how far its row number is from the range's first; the
    ranges before it add their counts. Only those, a row per range, are joined with the lines; they are held, so every
    reader sees the same.
    """
    where = F.struct(file_name().alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    lines = spark.read.option("lineSep", "\n").text(path).select(where.alias("at"), F.rtrim(F.col("value"), F.lit("\r")).alias("value")).where(F.trim("value") != "")
    rows = held(lines.withColumn("row", F.monotonically_increasing_id()))
    ranges = rows.groupBy("at").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*([] if as_one else ["at.file"])).orderBy("at.file", "at.begin").rowsBetween(Window.unboundedPreceding, -1)
    name = F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("file") if as_one else F.col("at.file")
    starts = ranges.select("at", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "at").select(name, (F.col("start") + F.col("row") - F.col("first")).alias("ord"), "value")


def parsed_lines(lines: DataFrame, tolerant: bool = False) -> DataFrame:
    """file, ord, body (variant) of ordered lines; a bad line fails, or gives a null body if tolerant."""
    return lines.select("file", "ord", (F.try_parse_json("value") if tolerant else F.parse_json(F.col("value"))).alias("body"))


def write_jsonl(df: DataFrame, path: str, order: list[str], overwrite: bool = False) -> None:
    """Rows as JSON lines in order; ranges of the order become files whose names sort alike. Existing output is an error unless overwritten."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def read_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """A row per JSON file: file, body (variant, null if it isn't JSON)."""
    whole = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return whole.select(file_name().alias("file"), F.try_parse_json("value").alias("body"))


def gauge_results(documents: DataFrame) -> DataFrame:
    """Files that are gauge results: a gauge name and items whose first has a split and scores. Adds gauge, stem, has_exam, calibrated."""
    get = lambda path, kind: F.try_variant_get("body", path, kind)
    splits = F.transform(get("$.items", "array<variant>"), lambda x: F.try_variant_get(x, "$.split", "string"))
    rows = documents.withColumns({"stem": F.regexp_replace("file", r"(\.calib)?\.json$", ""), "is_calib": F.col("file").endswith(".calib.json")})
    results = rows.where(~F.col("is_calib") & get("$.gauge", "string").isNotNull() & get("$.items[0].split", "string").isNotNull() & get("$.items[0].logits_mean", "variant").isNotNull())
    calibs = rows.where("is_calib").select("stem", F.lit(True).alias("calibrated"))
    out = results.select("file", "stem", get("$.gauge", "string").alias("gauge"), F.coalesce(F.array_contains(splits, "exam"), F.lit(False)).alias("has_exam"))
    return out.join(calibs, "stem", "left").withColumn("calibrated", F.coalesce("calibrated", F.lit(False)))


def is_bare_name(name: Column) -> Column:
    """Whether a name may be a file's stem: not empty, no separators, no dot at the start."""
    return F.coalesce((name != "") & ~name.rlike(r"[/\\]") & ~name.startswith("."), F.lit(False))


def result_named(spark: SparkSession, folder: str, name: str) -> str:
    """Path of a result by its bare stem; separators and dots at the start are refused."""
    if not name or "/" in name or "\\" in name or name.startswith("."):
        raise ValueError(f"not a bare name: {name!r}")
    return f"{folder.rstrip('/')}/{name}.json"


def read_run(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Header, items and footer of tagged run files (file, ord, body); a first line that is no header, or two of either, is an error."""
    tagged = lines.withColumn("kind", F.try_variant_get("body", "$.kind", "string"))
    faults = tagged.groupBy("file").agg(F.min_by("kind", "ord").alias("first"), F.count_if(F.col("kind") == "header").alias("h"), F.count_if(F.col("kind") == "footer").alias("f"), F.max_by("kind", "ord").alias("last"))
    bad = faults.where("first <> 'header' OR h <> 1 OR f > 1 OR (f = 1 AND last <> 'footer')").select("file").take(5)
    if bad:
        raise ValueError(f"not run files: {[r.file for r in bad]}")
    return tuple(tagged.where(F.col("kind") == kind).drop("kind") for kind in ("header", "item", "footer"))


def raw_responses(documents: DataFrame, question: str) -> DataFrame:
    """id (of the file name), choice, probabilities, confidence, usage of raw answer files."""
    get = lambda path, kind: F.try_variant_get("body", path, kind)
    answer = f"$.answers.{question}"
    return documents.where(~F.col("file").contains(".err.")).select(
        F.regexp_replace("file", r"\.json$", "").alias("id"), get(f"{answer}.type", "string").alias("type"), get(f"{answer}.choice", "string").alias("choice"),
        F.from_json(F.to_json(get(f"{answer}.probabilities", "variant")), "map<string,double>").alias("probabilities"), get("$.usage.input_tokens", "long").alias("input_tokens"),
        get("$.usage.output_tokens", "long").alias("output_tokens"), get("$.usage.cost", "double").alias("cost"),
    )


def to_do(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a stored result: a restarted job does only these."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def revision(spark: SparkSession, path: str) -> DataFrame:
    """The first line that all files share, as one row; null unless they agree on 40 hexadecimal digits."""
    first = spark.read.text(path, wholetext=True).select(F.trim(F.get(F.split("value", "\n"), F.lit(0))).alias("line"))
    agreed = first.agg(F.collect_set("line").alias("seen"))
    return agreed.select(F.when((F.size("seen") == 1) & F.get("seen", F.lit(0)).rlike("^[0-9a-f]{40}$"), F.get("seen", F.lit(0))).alias("revision"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256, length of each file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length")


def commits(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """History of a file under version control: sha, ts, text. A driver-side reader of one small file's history."""
    import subprocess

    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True).stdout

    log = [line.split(" ", 1) for line in git("log", "--follow", "--format=%H %cI", "--", file).splitlines()]
    rows = [(sha, ts, git("show", f"{sha}:{file}")) for sha, ts in log]
    return spark.createDataFrame(rows, "sha string, ts string, text string").withColumn("ts", F.to_timestamp("ts"))


def write_document(spark: SparkSession, record: dict, path: str) -> None:
    """One small record as an indented JSON file; existing output is an error."""
    import json

    text = json.dumps(record, indent=1, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


LEDGER = "n long, id string, attempt int, status int, error string, elapsed_s double, at string"


def read_ledger(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """An append-only ledger of calls; new files arrive one by one when read as a stream."""
    return (spark.readStream if stream else spark.read).schema(LEDGER).json(path)


def append_ledger(calls: DataFrame, path: str, secrets: list[str]) -> None:
    """Calls appended with secrets blotted out of their errors."""
    from calibrium.functions.text import redact

    calls.withColumn("error", redact(F.col("error"), secrets)).write.mode("append").json(path)


def append_version(block: DataFrame, path: str) -> None:
    """A new version of a metric block: a partition by the time it was made and a mark of its own, so that two writers at
    the same moment make two; older ones are never touched."""
    mark = F.concat(F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmssSSS"), F.lit(f"-{uuid.uuid4().hex[:12]}"))
    block.withColumn("version", mark).write.mode("append").partitionBy("version").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """file, place, features of .npy matrices (little-endian 32-bit, row-major), with each file's sha256: a row per vector."""
    import io

    import numpy as np
    import pyarrow as pa

    def rows(batches):
        for batch in batches:
            for name, sha, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                matrix = np.load(io.BytesIO(content), allow_pickle=False).astype("<f4", copy=False)
                if matrix.ndim != 2:
                    raise ValueError(f"{name} is no matrix")
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1] or 1, dtype=np.int32)), pa.array(matrix.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(matrix)), pa.array([sha] * len(matrix)), pa.array(range(len(matrix)), pa.int64()), flat], names=["file", "sha256", "place", "features"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1), F.sha2("content", 256), "content").mapInArrow(rows, "file string, sha256 string, place long, features array<float>")
