"""Readers: files of recorded runs as DataFrames.

Schemas are given, never inferred, so no reader scans its input twice.  A file that is
missing is an empty table where the reader says so, and an error elsewhere.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.scalars import decoded_body, section


def _or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """The table, or an empty one where the path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _small_text(spark: SparkSession, path: str) -> str | None:
    """Text of one small file, None where there is none.

    Spark's readers skip names that begin with ``_``, so it is opened through the file system.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def traces(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The trace table; the run filter reaches the files' statistics or partitions."""
    df = spark.read.parquet(path)
    return df if run_id is None else df.where(F.col("run_id") == run_id)


def whole_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, stem, modified, text) of all files below a folder whose names fit the pattern."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select(
        "path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text")
    )


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Spilled texts: (path, stem, modified, prompt, response); a section that is absent is null."""
    t = whole_texts(spark, path, "*.md")
    return t.select("path", "stem", "modified", section(F.col("text"), "Prompt").alias("prompt"), section(F.col("text"), "Response").alias("response"))


def payload_hits(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """Stems of the payload files that hold a literal text."""
    return whole_texts(spark, path, "*.md").where(F.col("text").contains(needle)).select("stem")


GOLDEN = "module string, case_id string, recorded_at string, source string, method string, path array<string>, status_code int, body string"


def golden(spark: SparkSession, path: str) -> DataFrame:
    """``<module>/<case>.json`` files; the body stays JSON text, a missing or null one is null."""
    t = whole_texts(spark, path, "*.json").where(~F.col("stem").startswith("_"))

    def get(p: str) -> Column:
        return F.get_json_object("text", p)

    return t.select(
        F.regexp_extract(F.url_decode("path"), r"([^/]+)/[^/]+$", 1).alias("module"),
        F.url_decode("stem").alias("case_id"),
        get("$._meta.recorded_at").alias("recorded_at"),
        get("$._meta.source").alias("source"),
        get("$.request.method").alias("method"),
        F.from_json(get("$.request.path"), "array<string>").alias("path"),
        get("$.response.status_code").cast("int").alias("status_code"),
        get("$.response.body").alias("body"),
    )


METADATA = "recorded_at string, total_cases int, cases array<string>, skipped array<string>, tainted_folders array<struct<folder:string,anomalies:array<struct<case_id:string,status_code:int,body_preview:string>>,excluded_case_ids:array<string>>>"


def recording_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row; none when the file is missing."""
    text = _small_text(spark, path)
    rows = spark.createDataFrame([] if text is None else [(text,)], "text string")
    return rows.select(F.from_json("text", METADATA).alias("m")).select("m.*")


def excluded_cases(metadata: DataFrame) -> DataFrame:
    """(case_id, reason): cases skipped by name or lost with a tainted folder."""
    skipped = metadata.select(F.explode("skipped").alias("case_id"), F.lit("skipped").alias("reason"))
    tainted = metadata.select(F.explode("tainted_folders").alias("t")).select(F.explode("t.excluded_case_ids").alias("case_id"), F.lit("tainted").alias("reason"))
    return skipped.unionByName(tainted).distinct()


EXECUTIONS = "run struct<executions:array<struct<item:struct<name:string,request:struct<method:string,url:struct<path:array<string>>>>,response:struct<code:int,header:array<struct<key:string,value:string>>,stream:struct<type:string,data:array<int>>>>>>"


def executions(spark: SparkSession, path: str, *, one_per_line: bool = False) -> DataFrame:
    """Runner report (``one_per_line``: many of them, each on a line): (pos, name, method, path, status_code, content_type, body); an absent or empty body is null."""
    e = spark.read.schema(EXECUTIONS).option("multiLine", not one_per_line).json(path).select(F.posexplode("run.executions").alias("pos", "e"))
    headers = F.map_from_entries(
        F.transform(F.coalesce("e.response.header", F.array().cast("array<struct<key:string,value:string>>")), lambda h: F.struct(F.lower(h["key"]), h["value"]))
    )
    return e.select(
        "pos", F.col("e.item.name").alias("name"), F.col("e.item.request.method").alias("method"), F.col("e.item.request.url.path").alias("path"),
        F.col("e.response.code").alias("status_code"), headers["content-type"].alias("content_type"), decoded_body(F.col("e.response.stream.data")).alias("body"),
    )


def recorded(execution_rows: DataFrame, mutation: Column) -> DataFrame:
    """Executions as golden candidates: what is kept, what is an anomaly.

    Kept: content type JSON and a body that is blank (stored as null) or valid JSON.  A
    mutation whose status is not 2xx is an anomaly.
    """
    blank = F.col("body").isNull() | (F.trim("body") == "")
    parsed = blank | F.try_parse_json("body").isNotNull()
    json_type = F.coalesce(F.lower("content_type").contains("application/json"), F.lit(False))
    ok = F.col("status_code").between(200, 299)
    return execution_rows.withColumns(
        {"body": F.when(~blank, F.col("body")), "kept": json_type & parsed, "anomaly": mutation & ~F.coalesce(ok, F.lit(False))}
    )


def properties(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a properties file: first ``=`` splits, ``:`` only where there is no ``=``; last wins is left to the caller (``line``)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "t"))
    lines = lines.withColumn("t", F.trim("t")).where("t <> '' and not t like '#%' and not t like '!%'")
    sep = F.when(F.instr("t", "=") > 0, F.instr("t", "=")).when(F.instr("t", ":") > 0, F.instr("t", ":"))
    at = lines.withColumn("at", sep)
    return at.select("line", F.trim(F.when(F.col("at").isNull(), F.col("t")).otherwise(F.expr("substring(t, 1, at - 1)"))).alias("key"), F.trim(F.when(F.col("at").isNull(), F.lit("")).otherwise(F.expr("substring(t, at + 1)"))).alias("value"))


def resolved_property(c: Column) -> Column:
    """``${X:default}`` gives its default, one level deep; a nested placeholder gives the empty text."""
    d = F.regexp_extract(c, r"^\$\{[^:}]+:(.*)\}$", 1)
    return F.when(c.rlike(r"^\$\{[^:}]+:.*\}$"), F.when(d.contains("${"), F.lit("")).otherwise(d)).when(c.rlike(r"^\$\{[^}]*\}$"), F.lit("")).otherwise(c)


def skip_list(spark: SparkSession, path: str, *, one_per_line: bool = False) -> DataFrame:
    """Endpoints of category ``skip``; none when the file is missing."""
    schema = "endpoint string, category string, detail string"
    return _or_empty(spark, lambda: spark.read.schema(schema).option("multiLine", not one_per_line).json(path), schema).where("category = 'skip'").select("endpoint", "detail")


FILLS = "endpoint string, param_schema string, note string, fill_mode string, values map<string,string>, raw_body string, file_paths map<string,string>, decision string, last_apply_error string"


def manual_fills(spark: SparkSession, path: str, *, one_per_line: bool = False) -> DataFrame:
    """Entries of all controller files of a folder with the controller's name."""
    raw = spark.read.schema(FILLS).option("multiLine", not one_per_line).json(path)
    return raw.withColumn("controller", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


def resolved_fill() -> Column:
    """Is an entry settled: skipped, or filled with something and applied without error."""
    hollow = F.lower(F.trim(F.coalesce("raw_body", F.lit("")))).isin("", "null", "{}", "[]")
    filled = F.when(F.col("fill_mode") == "raw_body", ~hollow).when(F.col("fill_mode") == "file", F.size("file_paths") > 0).otherwise(F.size("values") > 0)
    return (F.col("decision") == "skip") | (F.coalesce(filled, F.lit(False)) & F.col("last_apply_error").isNull())


def sources(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(file, text) of a source tree; ``wanted`` (a ``file`` column) keeps what exists of it."""
    t = whole_texts(spark, path, "*.java").select(F.regexp_replace("path", r"^.*?(src/)", "$1").alias("file"), "text")
    return t if wanted is None else t.join(wanted.select("file").distinct(), "file", "left_semi")
