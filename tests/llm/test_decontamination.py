"""Benchmark decontamination: awkward rows against SQL, removal, parts of a large benchmark, plan."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from trackweave.llm import decontamination as dc, queries
from verify import normal

ITEM = "One two three four five, six seven eight nine ten ELEVEN twelve"
ITEMS = [
    (1, ITEM), (2, ITEM.upper()), (3, "short item"), (4, None), (5, " .. "), (None, "no id here"), (7, "漢字 ünï"), (8, "word " * 30),
    (9, "a b c d e f g h i j"), (9, "j i h g f e d c b a"), (10, "one two three four five six seven eight nine ten and more of it"),
]
DOCS = [
    (1, None), (2, ""), (3, f"start. {ITEM}! The end."), (4, "one two three four five six seven eight nine"), (5, "a SHORT, item; no id here"),
    (6, "word " * 9), (7, "word " * 50_000), (8, "ünï 漢字 ünï 漢字"), (9, "a b c d e f g h i j i h g f e d c b a"), (10, "x" * 100_000),
    (11, "short\n\n\nitem short item"), (12, f"{ITEM} {ITEM}"), (13, "one two three four five six seven eight nine ten eleven"), (14, ITEM), (15, ITEM),
]


def windows_of(words):
    return {tuple(words[i:i + 10]) for i in range(max(1, len(words) - 9))} if words else set()


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def by_hand(doc):
    mine, hit, items = words(doc), set(), set()
    for item, text in ITEMS:
        for w in windows_of(words(text)):
            for i in range(len(mine) - len(w) + 1):
                if tuple(mine[i:i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    items |= {str(item)} if item is not None else set()
    return len(mine), len(hit), sorted(items)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(DOCS + [(None, DOCS[2][1]), (3, DOCS[2][1])], "doc_id long, text string")
    return docs.withColumns({"spans": F.lit(0), "row": F.lit("x"), "class": F.lit(1)}), spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("most", [dc.SCAN, 5])
def test_equals_plain_python(tables, most):
    docs, items = tables
    got = dc.scan(docs.repartition(3), items, most=most).collect()
    want = sorted((d is None, d or 0, *by_hand(t)) for d, t in DOCS + [(None, DOCS[2][1]), (3, DOCS[2][1])])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.item_ids) for r in got) == want
    assert all(r.n_items == len(r.item_ids) for r in got)


def test_query_equals_sql(spark, tmp_path, tables):
    docs, items = tables
    docs.filter("doc_id <> 3 AND length(text) < 1000").select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    name = "op12_benchmark_decontamination"
    assert normal(queries.QUERIES[name](spark, str(tmp_path)).toPandas()) == normal(con.execute(queries.SQL[name]).df())


def test_removal(tables):
    docs, items = tables
    cut = dc.decontaminate(docs, items)
    assert cut.columns == docs.columns
    rows = {r.doc_id: r.text for r in cut.collect()}
    assert rows[3] == "start! The end." and rows[1] is None and rows[10] == "x" * 100_000 and rows[6] == "word " * 9
    assert rows[5] == "a"
    assert words(rows[7]) == [] and words(rows[12]) == [] and words(rows[11]) == []
    kept = dc.decontaminate(docs, items, remove="documents").collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 4, 6, 10]
    with pytest.raises(ValueError):
        dc.decontaminate(docs, items, remove="lines")


def test_empty_tables(tables):
    docs, items = tables
    assert all(r.n_hit == 0 and r.item_ids == [] for r in dc.scan(docs, items.limit(0)).collect())
    assert dc.scan(docs.limit(0), items).count() == 0


def test_common_passage(spark):
    """A third of all documents hold the whole item: no row per pair of documents, and every one is found."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(f"lead {ITEM} tail")).otherwise(
        F.concat(F.lit("own words "), F.col("id").cast("string"))).alias("text"))
    items = spark.createDataFrame([(i, ITEM) for i in range(500)], "item_id long, text string")
    rows = dc.scan(docs, items).collect()
    assert sum(r.n_hit for r in rows) == 1000 * 12 and {r.n_items for r in rows} == {0, 500}


def test_native(table, capsys):
    docs, items = table("documents"), table("benchmark")
    dc.scan(docs, items).explain("formatted")
    dc.decontaminate(docs, items).explain("formatted")
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
