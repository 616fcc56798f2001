"""File sources and sinks. Paths go to Spark's readers, so any store Spark knows will do."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Rows of a JSON Lines file; blank lines are skipped, a missing path is empty, a bad line fails unless not strict."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def corpus(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """(doc_id, text) of a JSON array of strings or of {text} objects, stripped, without empties. Ids follow the order in the array."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("a"))
    x = whole.select(F.posexplode("a").alias("i", "v"))
    obj = F.get_json_object("v", "$.text")
    text = F.trim(F.when(F.col("v").startswith("{") & obj.isNotNull(), obj).otherwise(F.col("v")))
    return x.select((F.col("i") + first).cast("long").alias("doc_id"), text.alias("text")).where("text <> ''")


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(id, category, difficulty, question, reference_answer, source_papers, keywords) of a .jsonl file or a .json file of {questions}."""
    schema = "id string, category string, difficulty string, question string, reference_answer string, source_papers array<string>, keywords array<string>"
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).json(path)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"questions array<struct<{schema.replace(' string', ':string').replace(' array', ':array')}>>").alias("b"))
    return whole.select(F.inline("b.questions"))


def table_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header and # comments; NaN and empty fields are null."""
    r = spark.read.option("header", True).option("comment", "#").option("nanValue", "NaN")
    x = (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)
    return x.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in x.dtypes])


def judged(spark: SparkSession, path: str) -> DataFrame:
    """Judged answers (Parquet or CSV) with an id and an overall score; blank scores are null."""
    x = spark.read.parquet(path) if path.endswith(".parquet") else table_csv(spark, path)
    return x.where("id is not null").withColumn("overall", F.expr("try_cast(overall as double)")).where("overall is not null")


def partitioned(df: DataFrame, segment: str = "by_model") -> DataFrame:
    """df with `part` (the path segment after `segment`) and `file`; of files with one name only the first path counts."""
    p = F.col("_metadata.file_path")
    x = df.select("*", F.regexp_extract(p, rf"/{segment}/([^/]+)/", 1).alias("part"), F.regexp_extract(p, r"([^/]+)$", 1).alias("file"), p.alias("path_"))
    first = x.groupBy("file").agg(F.min("path_").alias("path_"))
    return x.join(first, ["file", "path_"]).drop("path_")


def pdf_like(content: Column) -> Column:
    """Whether bytes start as a PDF does."""
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write JSON Lines, all fields kept, and return how many rows were written. Appending adds files; nothing is half written: the
    writer's commit protocol publishes whole files."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df.mapInArrow(count, df.schema).write.mode(mode).option("ignoreNullFields", False).json(path)
    return seen.value


def write_report(df: DataFrame, path: str, digits: int = 3) -> None:
    """A small report as one CSV file, doubles rounded half to even."""
    x = df.select(*[F.bround(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    x.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows of df whose key the Parquet table at path lacks, and return them as read before the write."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path).select(key)
        new = df.join(old, key, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = df
    new = new.dropDuplicates([key]).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else new.dropDuplicates([key])
    new.write.mode("append").parquet(path)
    return new


def rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows by suffix: JSON Lines (.jsonl), one array of objects or one object (.json), Parquet or CSV; another suffix is an error."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "jsonl":
        return jsonl(spark, path, schema)
    if kind == "json":
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return table_csv(spark, path, schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " "))
    raise ValueError(f"no reader for .{kind}: {path}")


PROFILE = (
    "profile_type string, device string, model_name string, benchmark_prompts array<struct<avg_total_time_s:double>>, "
    "summary struct<question_count:long,avg_total_time_s:double,avg_retrieval_time_s:double,avg_generation_time_s:double,avg_generation_tokens_per_second:double,"
    "avg_tokens_per_second:double,avg_ms_per_token:double,avg_ttft_s:double,peak_gpu_vram_mb:double,peak_cpu_ram_mb:double>, "
    "model_load struct<load_time_s:double,retriever_load_time_s:double,generator_load_time_s:double>"
)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """One flat row a profiling file (inference_<label>.json). Retrieval profiles have their times in the summary, and two load times that
    add up (2 digits); others have the mean over their prompts (4 digits), null without prompts."""
    d = spark.read.schema(PROFILE).option("multiLine", True).json(path).select("*", F.regexp_extract(F.col("_metadata.file_path"), r"inference_([^/]*)\.json$", 1).alias("label"))
    rag = F.coalesce(F.col("profile_type") == "rag", F.lit(False))
    n = F.greatest(F.coalesce(F.size("benchmark_prompts"), F.lit(0)), F.lit(0))
    total = F.aggregate("benchmark_prompts", F.lit(0.0), lambda s, p: s + p["avg_total_time_s"])
    mean = F.when(n > 0, F.bround(total / n, 4))
    s, load = (lambda c: F.col(f"summary.{c}")), (lambda c: F.coalesce(F.col(f"model_load.{c}"), F.lit(0.0)))
    pick = lambda a, b, name: F.when(rag, a).otherwise(b).alias(name)
    none = F.lit(None).cast("double")
    return d.select(
        "label",
        "profile_type",
        "device",
        "model_name",
        pick(s("question_count"), n.cast("long"), "question_count"),
        pick(s("avg_total_time_s"), mean, "avg_total_time_s"),
        pick(s("avg_retrieval_time_s"), none, "avg_retrieval_time_s"),
        pick(s("avg_generation_time_s"), mean, "avg_generation_time_s"),
        pick(s("avg_generation_tokens_per_second"), s("avg_tokens_per_second"), "avg_tokens_per_second"),
        pick(none, s("avg_ms_per_token"), "avg_ms_per_token"),
        pick(none, s("avg_ttft_s"), "avg_ttft_s"),
        s("peak_gpu_vram_mb").alias("peak_gpu_vram_mb"),
        s("peak_cpu_ram_mb").alias("peak_cpu_ram_mb"),
        pick(F.bround(load("retriever_load_time_s") + load("generator_load_time_s"), 2), F.col("model_load.load_time_s"), "load_time_s"),
    )


@F.pandas_udf(StringType())
def _book_digest(content: pd.Series) -> pd.Series:
    """Digest of a zipped workbook's parts by name, without the times of its properties; null if it is no zip."""

    def one(data: bytes) -> str | None:
        h = hashlib.sha256()
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for name in sorted(z.namelist()):
                    part = z.read(name)
                    h.update(name.encode())
                    h.update(re.sub(rb"<dcterms:(created|modified)[^>]*>[^<]*<", b"<", part) if name == "docProps/core.xml" else part)
        except zipfile.BadZipFile:
            return None
        return h.hexdigest()

    return content.map(one)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """file, size, sha256 of every file below path. Times that writers stamp into PDF files and workbooks do not count."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    plain = F.encode(F.regexp_replace(F.decode("content", "ISO-8859-1"), r"/(?:CreationDate|ModDate)\s*\([^)]*\)", ""), "ISO-8859-1")
    x = x.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("size"), "content", plain.alias("plain"))
    kind = F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1))
    books = x.where(kind == "xlsx").select("file", "size", F.coalesce(_book_digest("content"), F.sha2("content", 256)).alias("sha256"))
    others = x.where(kind != "xlsx").select("file", "size", F.sha2(F.when(kind == "pdf", F.col("plain")).otherwise(F.col("content")), 256).alias("sha256"))
    return others.unionByName(books)


def settings(values: dict, kinds: dict[str, type], defaults: dict | None = None) -> dict:
    """A configuration: defaults, then values. Unknown names, missing ones and values of another type are errors; all are named at once."""
    got = {**(defaults or {}), **values}
    bad = [f"unknown: {k}" for k in got if k not in kinds] + [f"missing: {k}" for k in kinds if k not in got]
    for k, kind in kinds.items():
        v = got.get(k)
        if k in got and not (isinstance(v, kind) and not (isinstance(v, bool) and kind is not bool) or kind is float and type(v) is int):
            bad.append(f"{k}: {kind.__name__} expected, not {type(v).__name__}")
    if bad:
        raise ValueError("; ".join(bad))
    return got
