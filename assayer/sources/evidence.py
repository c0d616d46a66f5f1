"""Recorded evidence: source trees, capture logs and traces, as batch tables or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURE = "run_id string, package string, seq bigint, ts timestamp, kind string, method string, url string, host string, port int, address string, headers map<string,string>, body string, scheme string"


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files below `folder/<ecosystem>/<package>/<version>/<label>/...`; the size decides before the text is decoded."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inner = F.regexp_extract("path", r"/(npm|pypi)/((?:@[^/]+/)?[^/]+)/([^/]+)/(package|sdist|wheel)/(.+)$", 5)
    part = lambda k: F.regexp_extract("path", r"/(npm|pypi)/((?:@[^/]+/)?[^/]+)/([^/]+)/(package|sdist|wheel)/(.+)$", k)
    return raw.where(inner != "").select(part(1).alias("ecosystem"), part(2).alias("package"), part(3).alias("version"), part(4).alias("label"), inner.alias("path"), F.element_at(F.split(inner, "/"), -1).alias("name"), F.col("length").alias("size_bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def decode_capture(raw: DataFrame) -> DataFrame:
    """Body from base64; lines that are cut or broken have no kind and are left out."""
    return raw.where(F.col("kind").isin("http", "connect", "blocked")).withColumn("body", F.try_to_binary("body", F.lit("base64")))


def capture_log(spark: SparkSession, folder: str) -> DataFrame:
    return decode_capture(spark.read.schema(CAPTURE).option("mode", "DROPMALFORMED").json(folder))


def capture_stream(spark: SparkSession, folder: str) -> DataFrame:
    return decode_capture(spark.readStream.schema(CAPTURE).option("mode", "DROPMALFORMED").json(folder))


def trace_log(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of `folder/<run_id>/<package>/trace.log`, numbered; a trace is one file and is read as a whole."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).withColumn("file", F.input_file_name())
    part = lambda k: F.regexp_extract("file", r"/([^/]+)/([^/]+)/[^/]+$", k)
    return raw.select(part(1).alias("run_id"), part(2).alias("package"), F.posexplode(F.split("value", r"\r\n|\n|\r", -1)).alias("seq", "line")).withColumn("seq", F.col("seq").cast("long"))
