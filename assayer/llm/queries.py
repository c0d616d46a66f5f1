"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.llm.common import keep, load
from assayer.llm.decontaminate import decontamination_report
from assayer.llm.html_text import extract
from assayer.llm.licenses import scan
from assayer.llm.packing import pack
from assayer.llm.quality import weigh
from assayer.llm.simhash import simhash_components
from assayer.llm.suffix_dedup import removed_spans
from assayer.llm.toxicity import classify
from assayer.llm.warc import damaged, fixity
from assayer.llm.webp import read_features, store


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(load(spark, sf_dir, "documents")).drop("kept")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return fixity(pages, damaged(pages))


def op6_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_features(keep(store(load(spark, sf_dir, "documents")), "media"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), tokenizer_path())


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(load(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_suffix_dedup, op3_quality, op4_decontamination, op5_merkle_fixity, op6_webp, op7_packing, op8_licenses, op9_simhash, op10_html_extraction)}
#: Fixity without trees: what each record is, where it lies, and which faults the damaged replica has.
ORACLE: dict[str, str] = {"op5_merkle_fixity": """
WITH r AS (SELECT page_id, html, CAST(floor(page_id / 128) AS BIGINT) AS archive,
    concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
      'Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ', octet_length(encode(html)), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS rec FROM pages),
  g AS (SELECT page_id, archive, CAST(octet_length(encode(rec)) AS BIGINT) AS record_length, sha256(rec) AS record_sha256, count(*) AS copies, any_value(html) AS html FROM r GROUP BY 1, 2, 3, 4)
SELECT page_id, archive, CAST(sum(record_length) OVER (PARTITION BY archive ORDER BY page_id, record_sha256) - record_length AS BIGINT) AS record_offset, record_length, record_sha256, copies,
  CASE WHEN page_id % 499 = 3 THEN 'missing' WHEN page_id % 101 = 7 AND html <> concat('#', substr(html, 2)) THEN 'changed' ELSE 'intact' END AS status FROM g"""}
