import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from failsift.llm import token_counts as tc

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(JSON, RANKS)


def test_both_libraries_agree_below_the_limit(counter):
    rng = random.Random(8)
    alphabet = [chr(i) for i in range(ord(tc.PLAIN_LIMIT))]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) if rng.random() < 0.5 else rng.choice(" \n\t'ab1 st<|>") for _ in range(rng.randint(0, 14)))
        assert len(counter.quick.encode(text, allowed_special="all")) == len(counter.library.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|><|endoftext|>b", "漢字 текст", " " * 3000, "x" * 5000, "é" * 2000])
def test_counts_of_special_strings_scripts_and_runs(counter, text):
    assert counter.count(text) == len(counter.library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("blanks", [" " * 1_000_000, "a" + " \t" * 1_000_000 + "b", "\n" * 1_200_000])
def test_very_long_blanks(counter, blanks):
    assert counter.count(blanks) == len(counter.library.encode(blanks, add_special_tokens=False).ids)


def test_only_new_contents_are_encoded_and_appended(spark, docs_of):
    cache = tc.fresh_cache(spark)
    rows = [(1, "one two"), (2, "one two"), (3, None), (4, ""), (None, "one two"), (None, "alone"), (None, "alone"), (5, "five"), (5, "five"), (6, "w " * 90_000)]
    got = tc.token_counts(docs_of(rows), JSON, cache, RANKS).collect()
    want = {"one two": 2, "": 0, "alone": len(tc.Counter(JSON).library.encode("alone").ids), "five": 1, "w " * 90_000: 90_001}
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(
        ((i, len(t or ""), want[t or ""]) for i, t in rows), key=key
    )
    first = tc.read_cache(spark, cache)
    assert first.select("digest").distinct().count() == 5
    before = first.count()
    again = tc.token_counts(docs_of([(1, "one two"), (9, "nine")]), JSON, cache, RANKS).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in again) == [(1, 2), (9, 1)]
    assert tc.read_cache(spark, cache).count() == before + 1


def test_a_stored_count_is_used_and_another_tokenizer_is_not(spark, docs_of):
    cache = tc.fresh_cache(spark)
    docs = docs_of([(1, "hello")])
    stored = docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.lit(tc.tokenizer_digest(JSON)).alias("tokenizer"), F.lit(77).cast("long").alias("n_tokens"))
    stored.write.parquet(cache)
    assert tc.token_counts(docs, JSON, cache, RANKS).first().n_tokens == 77
    assert tc.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), cache).first().n_tokens == 1


def test_no_documents(spark, docs_of):
    assert tc.token_counts(docs_of([]), JSON, tc.fresh_cache(spark), RANKS).count() == 0
