"""The registered queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failsift.llm import chat, decontamination, licenses, merkle, mixing, near_dedup, oracle, prefix_trie, quality, repeats, spelling, token_counts, toxicity, warc
from failsift.llm.tables import small_batches, table
from failsift.session import work_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {
    "op2_license_scan": oracle.OP2,
    "op6_warc": oracle.OP6,
    "op8_chat_formatting": oracle.OP8,
    "op9_source_mixing": oracle.OP9,
    "op11_spelling_variants": oracle.OP11,
    "op12_conversation_prefix_trie": oracle.OP12,
    "op13_substring_dedup": oracle.OP13,
}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op2_license_scan(spark, sf):
    return licenses.scan_licences(table(spark, sf, "documents"))


@query
def op8_chat_formatting(spark, sf):
    said = r"\### Assistant: </turn> ok"
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.examples(turns.unionByName(extra)))


@query
def op9_source_mixing(spark, sf):
    mixed = mixing.mix_sources(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_minhash_near_dedup(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents"))


@query
def op1_benchmark_decontamination(spark, sf):
    return decontamination.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op3_quality_classifier(spark, sf):
    return quality.classify_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op7_toxicity(spark, sf):
    return toxicity.classify_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op5_token_counts(spark, sf):
    counts = token_counts.token_counts(
        table(spark, sf, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        token_counts.fresh_cache(spark),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > token_counts.MAX_TOKENS)


@query
def op4_document_fingerprints(spark, sf):
    return merkle.fingerprints(table(spark, sf, "documents"))


@query
def op6_warc(spark, sf):
    folder = work_dir(spark, "warc")
    manifest = warc.write_archives(table(spark, sf, "pages"), folder)
    records = warc.read_archives(manifest, folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


@query
def op11_spelling_variants(spark, sf):
    return spelling.variants(spelling.corpus_words(table(spark, sf, "documents")))


@query
def op12_conversation_prefix_trie(spark, sf):
    return prefix_trie.rebuilt_trie(table(spark, sf, "conversations"))


@query
def op13_substring_dedup(spark, sf):
    return repeats.without_repeats(table(spark, sf, "documents"))
