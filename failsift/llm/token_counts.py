"""Token counts through a cache of digests.

The cache is a table of (digest, tokenizer, n_tokens) in the shared folder: the digest of the
normalised content, and the digest of the tokenizer's file and rules. A count is looked up by
both. Content that is not there is encoded once, whatever number of documents hold it, and
appended. Normalising only takes null as empty: the encoding is of exact text, so any other
change could change a count.

The one document that is encoded for a digest is chosen by narrow rows of digests and ids
before texts move, so copies do not meet in one task; the chosen ids meet the texts by a
join on the id.

Encoding. Counts are those of the ``tokenizers`` library for its file, without added begin,
end or special tokens; special strings inside texts are one token, as is its default. Where
the same vocabulary is given as ranks and every character is below ``PLAIN_LIMIT``, where
both libraries split text alike, the quicker ``tiktoken`` counts; else ``tokenizers`` does.

Defined cases: null and empty texts have 0 bytes and 0 tokens. Every row gives a row, rows
without id and repeated ones too. Appending the same content twice is harmless: look-ups take
one row per digest. No rows give no rows and append nothing. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failsift.llm.tables import small_batches, stored
from failsift.session import work_dir

RULES = "plain-1"  # changes with the way texts are encoded
MAX_TOKENS = 1024
PLAIN_LIMIT = "ɐ"
# The pattern that splits text before the merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = "digest string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(RULES.encode() + Path(path).read_bytes()).hexdigest()


class Counter:
    """Counts tokens of single texts."""

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.quick = None
        if ranks_path:
            import tiktoken

            added = json.loads(Path(path).read_text())["added_tokens"]
            ranks = {
                base64.b64decode(token): int(rank)
                for token, rank in map(bytes.split, Path(ranks_path).read_bytes().splitlines())
            }
            self.quick = tiktoken.Encoding(
                "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added}
            )

    def count(self, text: str) -> int:
        if self.quick is not None and (text.isascii() or max(text) < PLAIN_LIMIT):
            try:
                return len(self.quick.encode(text, allowed_special="all"))
            except ValueError:  # a very long run of blanks, which its pattern cannot go back through
                pass
        return len(self.library.encode(text, add_special_tokens=False).ids)


@cache
def counter(path: str, ranks_path: str | None) -> Counter:
    return Counter(path, ranks_path)


def read_cache(spark, folder: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, path: str, cache_dir: str, ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row; counts of new contents are appended to ``cache_dir``."""
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer_digest(path)
    text = F.coalesce("text", F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long"),
            F.sha2(text.cast("binary"), 256).alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"),
        ),
        "token-digests",
    )

    def known() -> DataFrame:
        return read_cache(spark, cache_dir).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    # Contents that only rows without id hold are told by a null id.
    missing = stored(
        rows.groupBy("digest").agg(F.min("doc_id").alias("id")).join(known(), "digest", "left_anti").select("digest", "id"),
        "token-misses",
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = counter(path, ranks_path)
        for batch in batches:
            counts = [encoder.count(t) for t in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    contents = docs.select(F.col("doc_id").cast("long").alias("d"), text.alias("content")).withColumn(
        "own", F.sha2(F.col("content").cast("binary"), 256)
    )
    chosen = contents.where("d IS NOT NULL").join(missing.where("id IS NOT NULL"), (F.col("d") == F.col("id")) & (F.col("own") == F.col("digest")))
    orphans = contents.where("d IS NULL").join(missing.where("id IS NULL"), F.col("own") == F.col("digest"))
    counted = chosen.select("digest", "content").unionByName(orphans.select("digest", "content")).mapInArrow(encode, "digest string, n_tokens long")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_dir)
    return rows.join(known(), "digest").select("doc_id", "n_bytes", "n_tokens")


def fresh_cache(spark) -> str:
    return work_dir(spark, "token-cache")
