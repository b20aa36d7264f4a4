"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ephemera.llm.alignment import align_tokens, link_counts
from ephemera.llm.decontaminate import decontaminate
from ephemera.llm.importance import importance_resample
from ephemera.llm.jaccard_join import jaccard_join
from ephemera.llm.license_scan import scan_licenses
from ephemera.llm.lpf_dedup import remove_repeats
from ephemera.llm.oracle import contamination_sql, jaccard_join_sql, license_scans_sql, quality_rules_sql, trade_ranks_sql, url_filters_sql
from ephemera.llm.packing import pack
from ephemera.llm.pii import find_pii
from ephemera.llm.quality_rules import quality_rules
from ephemera.llm.secret_scan import find_secrets
from ephemera.llm.token_counts import count_tokens
from ephemera.llm.url_filter import filter_urls, personalised_pagerank
from ephemera.llm.whitening import whiten


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, _table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def trade_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PageRank of op3 over a graph with many links: parts and suppliers, by quantity, from the suppliers of one nation."""
    lines = _table(spark, sf_dir, "lineitem")
    part, supplier, odd = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"), F.col("l_linenumber") % 2 == 1
    edges = lines.groupBy(F.when(odd, part).otherwise(supplier).alias("src"), F.when(odd, supplier).otherwise(part).alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    seeds = _table(spark, sf_dir, "supplier").where("s_nationkey = 1").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    share = seeds.crossJoin(F.broadcast(seeds.agg(F.count("*").alias("n")))).select("node", (1 / F.col("n")).alias("share"))  # one row
    return personalised_pagerank(edges, share).select("node", F.round("score", 9).alias("score"))


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, kinds), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")), ("email", "ip", "card", "phone"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_resample(docs, _table(spark, sf_dir, "labels"), carry_text=False).select("doc_id", "score", "kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id, so that a source and its languages are directories."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return scan_licenses(_table(spark, sf_dir, "documents"), path).select("doc_id", "path", "license", F.round("cosine", 6).alias("cosine"), "origin")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")), ("assign", "access", "hex"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = align_tokens(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = aligned.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "link_a", "link_b")
    return link_counts(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = white.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"), "explained", "identity_error")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", "at").alias("explained"), "identity_error")


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_filters": op3_url_filters,
    "trade_ranks": trade_ranks,
    "op4_pii": op4_pii,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_packing": op8_packing,
    "op9_license_scans": op9_license_scans,
    "op10_token_counts": op10_token_counts,
    "op11_secret_scans": op11_secret_scans,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_embedding_whitening": op13_embedding_whitening,
}

#: The others train models, follow a library's tokens or cut texts by bytes, which SQL cannot express; tests compare them with plain versions.
ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_decontamination": contamination_sql(),
    "op5_ngram_jaccard_join": jaccard_join_sql(),
    "op2_quality_rules": quality_rules_sql(),
    "op3_url_filters": url_filters_sql(),
    "trade_ranks": trade_ranks_sql(),
    "op9_license_scans": license_scans_sql(),
}
