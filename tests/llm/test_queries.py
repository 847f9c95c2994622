"""Queries against their SQL on the smallest tables, and brute-force checks where there is none."""

import hashlib
import json

import duckdb
import public_tokenizers
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from failsift.llm import merkle
from failsift.llm.queries import ORACLE, QUERIES
from tests.parity import DATA, compare

SF = "sf0.001"


def table(name, sql):
    return duckdb.sql(sql.format(f"'{DATA}/{SF}/{name}.parquet'")).fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    ok, note = compare(spark, SF, name)
    assert ok, note


def test_every_operator_is_registered():
    names = contract.queries()
    assert {n.partition("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(QUERIES) <= set(names)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_token_counts_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert json.load(open(path))["model"]["type"] == "BPE"
    texts = dict(table("documents", "SELECT doc_id, coalesce(text, '') FROM {}"))
    got = QUERIES["op5_token_counts"](spark, f"{DATA}/{SF}").collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_fingerprints_of_edited_and_next_texts(spark):
    rows = table("documents", "SELECT doc_id, coalesce(text, '') FROM {} ORDER BY doc_id DESC")
    got = {r.doc_id: r for r in QUERIES["op4_document_fingerprints"](spark, f"{DATA}/{SF}").collect()}
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (merkle.fingerprint(text), merkle.fingerprint(edited))
        assert r.near_edited == merkle.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == merkle.likeness(r.fingerprint, merkle.fingerprint(following))


def test_leaks_are_the_documents_that_hold_an_item(spark):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_benchmark_decontamination"](spark, f"{DATA}/{SF}").collect()}
    want = set(
        duckdb.sql(
            f"SELECT d.doc_id, b.item_id FROM '{DATA}/{SF}/documents.parquet' d JOIN '{DATA}/{SF}/benchmark.parquet' b"
            " ON contains(d.text, b.text)"
        ).fetchall()
    )
    assert want <= got


@pytest.mark.parametrize("name, label", [("op3_quality_classifier", "quality"), ("op7_toxicity", "toxic")])
def test_classifiers_on_held_out_documents(spark, name, label):
    sf = "sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{DATA}/{sf}/labels.parquet'").fetchall())
    got = QUERIES[name](spark, f"{DATA}/{sf}").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    judged = [(r.score, r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == t for _, p, t in judged) / len(judged) >= 0.9
    clean = [p for _, p, t in judged if t == 0]
    assert sum(clean) <= 0.05 * len(clean)
