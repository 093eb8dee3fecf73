"""The pipeline's stages one after the other against plain Python and SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_pairs import brute_components, brute_repeats
from tests.llm.test_secrets import spans_by_hand
from tests.llm.test_tokens import check_pieces, library_ids
from trackweave.llm import secrets
from trackweave.llm.sql import SQL

AWKWARD = [(None, None), (None, ""), (7, None), (7, "short"), (7, "short")]


def masked(text, spans):
    out, at, end = "", 0, -1
    for s, _, e, _ in spans:
        if s >= end:
            out += text[at:s] + "[SECRET]"
        at = end = max(end, e)
    return out + text[at:]


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({"kept": F.lit("x"), "start": F.lit(1)})
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    functions = dict(corpus_pipeline.STAGES)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")

    def step(name, frame):
        done = functions[name](spark, frame, DATA)
        assert done.columns == columns
        got = {r.doc_id: r.text for r in done.collect()}
        assert done.count() == len(got)
        return done, got

    docs, got = step("quality rules", docs)
    kept = {i for (i,) in con.execute(f"SELECT doc_id FROM ({SQL['op5_quality_rules']}) WHERE kept").fetchall()}
    assert got == {i: t for i, t in rows.items() if i in kept} and 0 < len(got) < len(rows)

    before = got
    docs, got = step("n-gram Jaccard join", docs)
    assert got == {i: before[i] for i, (n, c) in brute_components(list(before.items())).items() if n == 0 or i == c}

    before = got
    docs, got = step("substring dedup", docs)
    assert got == {i: kept if gone else before[i] for i, (_, gone, kept) in brute_repeats(list(before.items())).items()}

    before = got
    model = secrets.train(secrets.samples(docs))
    docs, got = step("secret scans", docs)
    spans = {i: spans_by_hand(t, model) for i, t in before.items()}
    assert got == {i: masked(t, spans[i]) if spans[i] else t for i, t in before.items()}

    pieces = functions["packing"](spark, docs, DATA).collect()
    check_pieces(pieces, dict(zip(got, library_ids(list(got.values())), strict=True)))


def test_run_equals_stages(spark):
    pieces = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    total = lambda x: tuple(x.agg(F.count("*"), F.sum("length"), F.sum("doc_tokens")).first())
    assert total(pieces)[1] == total(docs)[1]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_awkward(spark, name):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    stage = dict(corpus_pipeline.STAGES)[name]
    got = sorted(map(str, stage(spark, docs, DATA).collect()))
    if name == "quality rules":
        assert got == []
    elif name == "n-gram Jaccard join":
        assert got == sorted(map(str, docs.distinct().collect()))
    else:
        assert got == sorted(map(str, docs.collect()))
    assert stage(spark, docs.limit(0), DATA).count() == 0
