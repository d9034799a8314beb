"""The pipeline against a plain Python version, stage after stage, over the smallest table."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from plateworks.llm import bpe
from plateworks.llm import latent_decontam as L
from tests.llm import test_patience_lines, test_rule_ledger, test_shingle_join
from tests.llm.fixtures import table

FOLDER = "/root/testdata/sf0.001"


def passes(text):
    n, chars, symbols, dups, repeats = test_rule_ledger.brute(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    up, low = (sum(a <= c <= b for c in text) for a, b in ("AZ", "az"))
    return not (n < 50 or 100 * repeats > 50 * n or 100 * symbols > 30 * n or 100 * dups > 60 * len(lines) or not 2 * n <= chars <= 25 * n
                or 100 * text.split().count("|") > 20 * n or 100 * up > 70 * (up + low))


def holds(text, item):
    text, item = (b" " + b" ".join(L.words_of(t.encode())) + b" " for t in (text, item))
    return item in text


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage of one run."""
    tables, stage = [], corpus_pipeline.stage

    def recorded(df, label):
        tables.append(stage(df, label))
        return tables[-1]

    corpus_pipeline.stage = recorded
    try:
        last = corpus_pipeline.run(spark, FOLDER)
    finally:
        corpus_pipeline.stage = stage
    return [[r.asDict() for r in t.collect()] for t in [*tables, last]]


def test_stages_equal_brute_force(spark, stages):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    docs = {d: t for d, t in docs.items() if passes(t)}
    assert {r["doc_id"]: r["text"] for r in stages[0]} == docs

    order, gone = test_patience_lines.brute(list(docs.items()))
    after = {}
    for d, t in docs.items():
        lines = t.split("\n")
        lost = set(range(len(lines))) if d > order[t] and sum(map(len, lines)) >= 160 else gone[t]
        left = "\n".join(x for i, x in enumerate(lines) if i not in lost)
        if not lost or left.split():
            after[d] = left
    assert {r["doc_id"]: r["text"] for r in stages[1]} == after
    docs = after

    docs = dict(test_shingle_join.brute(list(docs.items())))
    assert {r["doc_id"]: r["text"] for r in stages[2]} == docs

    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = {d: t for d, t in docs.items() if not any(holds(t, i) for i in items if len(L.words_of(i.encode())) >= L.LEAST_WORDS)}
    assert {r["doc_id"]: r["text"] for r in stages[3]} == docs

    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = set()
    for d, t in docs.items():
        ids = enc.encode_ordinary(t)
        want.add((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert {tuple(r.values()) for r in stages[4]} == want


def test_stages_take_awkward_rows_and_keep_the_columns(spark):
    docs = df = table(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, FOLDER).count() <= df.count()
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == df.columns
    assert corpus_pipeline.STAGES[-1][1](spark, df, FOLDER).count() == df.count()


def test_stages_leave_a_callers_columns_alone(spark):
    """Columns named like a stage's own measurements or helpers keep their values."""
    own = dict(n_words=7, n_lines=7, n_removed=7, removed_lines=7, failed_bits=7, row=7, node=7, gone=7, __n=7, __words=7, __gone=7, __k1=7)
    text = " ".join(f"word{i % 70}" for i in range(90))
    df = table(spark, [(1, text, "en", "s", 5), (2, f"{text}\nand more", "en", "s", 5), (3, None, None, None, None), (4, text, "en", "s", 5)], **own)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, FOLDER)
        assert out.columns == df.columns, name
        found = out.collect()
        assert found and all(r[c] == 7 for r in found for c in own), name
