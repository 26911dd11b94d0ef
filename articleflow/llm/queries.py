"""The registered queries of this package: thin bindings of the operators to the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.llm import (alignment, ann, langid, licenses, mixing, packing, prefix_bpe, quality, secrets, simhash, toxicity, warc,
                             whitening)
from articleflow.llm.common import fold, read
from articleflow.session import scratch_path


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents", ["doc_id", "text"]), tokenizer_path(), 2048)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    return secrets.scan(docs, secrets.train_on_corpus(docs))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents", ["doc_id", "text", "source"]))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents", ["doc_id", "text"]), shingle=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return ann.search(vectors, lambda vec_id: vec_id % 100 == 0, k=10)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = read(spark, sf_dir, "labels", ["doc_id", "toxic"]).filter(fold("doc_id", 3) != 1)
    found = toxicity.score(docs, toxicity.train(docs, labels))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op7_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", ["page_id", "url", "html"])
    manifest = warc.write_archives(pages, scratch_path(spark, "warc"))
    # one archive per task: their number, not the manifest's single file, sets the parallelism
    archives = manifest.repartition(max(1, min(manifest.count(), 10_000)), "archive")
    records = warc.read_archives(archives, with_payload=False)
    return records.select(warc.id_of("record_id", "long").alias("page_id"), "payload_bytes", "payload_digest",
                          "record_type", warc.id_of("refers_to", "long").alias("refers_to"),
                          F.col("target_uri").alias("url"), "error")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents", ["doc_id", "text"]))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    model = langid.train(docs.filter(fold("doc_id", 4) != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents", ["doc_id", "text"]))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), components=16, scale=64, offset=1_000_000)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    return alignment.measures(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.digests(read(spark, sf_dir, "documents", ["doc_id", "text"]), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_secret_scan, op3_mix_sources, op4_simhash_near_dedup, op5_permutation_index, op6_toxicity,
                                   op7_warc_zstd, op8_quality_rules, op9_language_id, op10_license_scan,
                                   op11_embedding_whitening, op12_token_alignment, op13_prefix_bpe)}
