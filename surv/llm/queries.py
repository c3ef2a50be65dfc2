"""Queries ``opN_<name>``: each operator over its whole table, and their SQL."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surv.llm import bpe, decontam, html_text, langid, licenses, lm_mix, merkle, ngram_join, oracles, packing, quality_nbsvm, quality_rules, spelling, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_of(k: int):
    """crc32 of the id as text, modulo ``k`` (a null id: 0)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % k, F.lit(0))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: the chain junk, toxic, toxic prose."""
    labels = table(spark, sf_dir, "labels")
    toxic, quality = F.col("toxic"), F.col("quality")
    chain = toxicity.fit(table(spark, sf_dir, "documents"), labels,
                         {"junk": quality == 0, "toxic": toxic == 1, "toxic_prose": (toxic == 1) & (quality == 1)})
    out = toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), chain)
    return out.select("doc_id", F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"), "p_junk", "p_toxic_prose")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt where the remainder by 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(part_of(4) != 2))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (part_of(4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: set size, class id, number of links."""
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) match with its best window."""
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      F.array_join("failed_rules", ",").alias("failed_rules"))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt where the remainder by 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(part_of(3) != 1)
    out = quality_nbsvm.classify(docs, quality_nbsvm.fit(docs, labels))
    return out.select("doc_id", (part_of(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with bucket, batch and position."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learnt where the remainder by 5 is not 1."""
    out = lm_mix.score(table(spark, sf_dir, "documents"), part_of(5) != 1)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and the check of the tampered version of every document."""
    out = merkle.documents_manifest(table(spark, sf_dir, "documents")).audit()
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    import public_tokenizers as vocabularies
    ranks = bpe.read_ranks(vocabularies.path("byte_bpe_multi_50k.tiktoken"))
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, vocabularies.PATTERN).drop("text"), ranks)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its near words, form and root."""
    out = spelling.variants(table(spark, sf_dir, "documents"), drop_every=31)
    return out.select("word", "form", "root", "n", "n_near", "form_n")


ORACLE["op11_merkle_manifest"] = oracles.merkle_manifest(10)
ORACLE["op13_spelling_variants"] = oracles.spelling_variants()
