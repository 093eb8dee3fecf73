import datetime as dt
import json

from pyspark.sql import functions as F

from trackweave.functions import text as tx
from trackweave.functions.models import batch_embedder, complete, hashing_embedder
from trackweave.functions.vectors import cosine_similarity, has_dimension, similarity_to


def one(spark, column, **values):
    row = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")]
    return spark.range(1).select(*row).select(column.alias("x")).first()["x"]


def test_strip_removes_what_python_strips(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).strip() == ""]
    rows = [(f"{c}a{c}b{c}",) for c in spaces] + [("",), (" \t",), (None,)]
    got = spark.createDataFrame(rows, "s string").select("s", tx.strip_text(F.col("s")).alias("t")).collect()
    for row in got:
        assert row["t"] == (row["s"].strip() if row["s"] is not None else None)


def test_remote_flag(spark):
    rows = [(None,), ("",), ("Remote - US",), ("REMOTE",), ("Austin",)]
    got = spark.createDataFrame(rows, "l string").select(tx.remote_flag(F.col("l")).alias("r")).collect()
    assert [row["r"] for row in got] == [True, False, True, True, False]


def test_tolerant_casts(spark):
    rows = [("90000", "2024-05-01T10:00:00+02:00"), ("12 k", "garbage"), (None, None), ("", "")]
    got = spark.createDataFrame(rows, "n string, d string").select(
        tx.to_number(F.col("n")).alias("n"), tx.to_time(F.col("d")).cast("string").alias("d")
    ).collect()
    assert [tuple(r) for r in got] == [(90000.0, "2024-05-01 08:00:00"), (None, None), (None, None), (None, None)]


def test_lists_and_defaults(spark):
    assert one(spark, tx.split_list(F.col("s")), s=" a, b ,, c|d ,") == ["a", "b", "c|d"]
    assert one(spark, tx.split_list(F.col("s"), "|"), s="a|b") == ["a", "b"]
    assert one(spark, tx.text_or(F.col("s"), "d"), s="") == "d"
    assert one(spark, tx.text_or(F.col("s"), "d"), s=" ") == " "
    assert one(spark, tx.text_or(F.lit(None).cast("string"), "d")) == "d"


def test_zip_shortest(spark):
    names, years = F.array(*map(F.lit, [" sql ", "  ", "java", "go"])), F.array(*map(F.lit, ["2.5", "1", ""]))
    got = one(spark, tx.zip_shortest(names, years))
    assert [(p["name"], p["value"]) for p in got] == [("sql", 2.5), ("java", None)]
    assert one(spark, tx.zip_shortest(F.lit(None).cast("array<string>"), years)) == []


def test_json(spark):
    text = one(
        spark,
        tx.row_json(
            F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"),
            F.lit(dt.datetime(2024, 1, 2, 3, 4, 5)).alias("t"), F.array(F.lit("x")).alias("l"),
        ),
    )
    assert json.loads(text) == {"a": 1, "b": None, "t": "2024-01-02 03:04:05", "l": ["x"]}
    rows = spark.createDataFrame([('{"k": 3}',), ("{bad",), ("",), (None,)], "s string")
    got = rows.select(tx.json_fields(F.col("s"), "k bigint").alias("j")).collect()
    assert [r["j"]["k"] for r in got] == [3, None, None, None]


def test_iso_time_and_age(spark):
    t = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, tx.iso_time(F.lit(t))) == "2024-01-02T03:04:05"
    assert one(spark, tx.iso_time(F.lit(t.replace(microsecond=250)))) == "2024-01-02T03:04:05.000250"
    assert one(spark, tx.days_before(F.lit(t), 7)) == dt.datetime(2023, 12, 26, 3, 4, 5)


VECTORS = [
    (1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, None]), (6, [-3.0, -4.0]), (7, [4.0, 3.0]),
]


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame(VECTORS, "id int, v array<float>")
    want = {1: 1.0, 2: None, 3: None, 4: None, 5: None, 6: -1.0, 7: 0.96}
    query = [3.0, 4.0]
    literal = F.array(F.lit(3.0), F.lit(4.0))
    for column in (
        similarity_to(F.col("v"), query),
        similarity_to(F.col("v"), query, "native"),
        cosine_similarity(F.col("v"), literal),
    ):
        got = {r["id"]: r["s"] for r in df.select("id", column.alias("s")).collect()}
        assert {k: v if v is None else round(v, 9) for k, v in got.items()} == want
    zero = df.select("id", similarity_to(F.col("v"), [0.0, 0.0]).alias("s")).collect()
    assert all(r["s"] is None for r in zero)
    sizes = {r["id"]: r["ok"] for r in df.select("id", has_dimension(F.col("v"), 2).alias("ok")).collect()}
    assert sizes == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: True}


def test_models(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "b a!")], "id int, chunk_text string")
    hashed = {r["id"]: r["embedding"] for r in hashing_embedder(dim=16)(df).collect()}
    assert len(hashed[1]) == 16 and abs(sum(x * x for x in hashed[1]) - 1) < 1e-6
    assert hashed[1] == hashed[4] and set(hashed[2]) == {0.0}

    def loader():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    got = {r["id"]: r["embedding"] for r in batch_embedder(loader)(df.filter("chunk_text is not null")).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0], 4: [4.0, 1.0]}
    prompts = spark.createDataFrame([(1, "hi"), (2, "you")], "id int, prompt string")
    done = complete(prompts, lambda: (lambda texts: [t.upper() for t in texts])).orderBy("id").collect()
    assert [r["completion"] for r in done] == ["HI", "YOU"]
