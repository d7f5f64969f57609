"""The corpus operators applied to the test tables: one query for each, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolattice.llm.decontaminate import contaminated
from chronolattice.llm.html_extract import extract_pages
from chronolattice.llm.jaccard_join import jaccard_join
from chronolattice.llm.license_scan import scan_licenses
from chronolattice.llm.mixture import mix_takes
from chronolattice.llm.outliers import quality_rules
from chronolattice.llm.projection_forest import near_embeddings
from chronolattice.llm.quality_mil import classify_quality
from chronolattice.llm.spelling import spelling_variants
from chronolattice.llm.substring_dedup import dedup_substrings
from chronolattice.llm.suffix_dedup import dedup_bytes
from chronolattice.llm.token_coder import encode_documents
from chronolattice.llm.whitening import whiten


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The vocabulary that the queries encode with, by name.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_read(spark, sf_dir, "documents"), tokenizer=tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_read(spark, sf_dir, "pages"))


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_read(spark, sf_dir, "documents"), width=4, num=85, den=100).select("doc_id", "n_shingles", "component_id", "n_links")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "cutoff")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_takes(_read(spark, sf_dir, "documents"), untaken=True)
    per = rows.groupBy("id", "s", "key", "order", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_set("shard")).alias("shards"))
    return per.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.concat_ws(",", "shards").alias("shards"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it is no long."""
    return whiten(_read(spark, sf_dir, "embeddings"), most=32).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents"), times=10)


def op13_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(_read(spark, sf_dir, "embeddings"), least=0.95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_coder": op1_token_coder,
    "op2_html_extract": op2_html_extract,
    "op3_quality_mil": op3_quality_mil,
    "op4_decontaminate": op4_decontaminate,
    "op5_license_scan": op5_license_scan,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_source_mix": op10_source_mix,
    "op11_whitening": op11_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_projection_forest": op13_projection_forest,
}

_W = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLES: dict[str, str] = {
    "op8_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_W} AS ws FROM documents),
        win AS (SELECT doc_id, i, list_slice(ws, i, i + 12) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
        f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE doc_id > m),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f),
        r AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id),
        x AS (SELECT w.doc_id, ws, ps, list_filter(range(1, len(ws) + 1), lambda p: ps IS NULL OR NOT list_contains(ps, p)) AS keep FROM w LEFT JOIN r USING (doc_id))
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(keep) AS BIGINT) AS n_removed,
               sha256(array_to_string(list_transform(keep, lambda p: ws[p]), ' ')) AS kept_sha256 FROM x""",
}
