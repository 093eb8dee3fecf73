import math

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trackweave import schemas
from trackweave.operators.chunking import changed_texts, chunk, text_hash, without_chunks
from trackweave.operators.cleaning import clean_listings, not_junk, split_untitled, union_sources, with_payload
from trackweave.sources.listings import impose_schema, parse_listings, query_table, read_listings

NAMES = [f.split()[0] for f in schemas.RAW_LISTING.split(", ")]


def listing(**values):
    base = dict.fromkeys(NAMES)
    base.update(position=" Dev ", description="text", date="2024-01-01T00:00:00")
    return tuple({**base, **values}[n] for n in NAMES)


def raw(spark, *rows):
    return spark.createDataFrame([listing(**r) for r in rows], schemas.RAW_LISTING)


def test_clean_listings(spark):
    df = raw(
        spark,
        {"id": None, "description": "legal notice"},
        {"id": ""},
        {"id": "1", "description": "old", "date": "2024-01-01T00:00:00"},
        {"id": "1", "description": " new ", "date": "2024-02-01T00:00:00"},
        {"id": "1", "description": None, "date": "2024-03-01T00:00:00"},
        {"id": "2", "description": "  ", "location": "", "salary_min": "12 k", "date": "garbage"},
        {"id": "3", "description": "", "location": "Austin"},
        {"id": "4", "description": "x", "location": "Fully REMOTE", "salary_max": "90000", "tags": ["a"]},
        {"id": "5", "description": "y", "position": None, "location": "Austin"},
    )
    got = {r["job_id"]: r for r in clean_listings(df, "feed").collect()}
    assert sorted(got) == ["1", "2", "4", "5"]
    assert got["1"]["description"] == "new" and got["1"]["title"] == "Dev" and got["1"]["remote"] is True
    assert got["2"]["description"] == "" and got["2"]["remote"] is False
    assert got["2"]["salary_min"] is None and got["2"]["posted_at"] is None and got["2"]["tags"] == []
    assert got["4"]["remote"] is True and got["4"]["salary_max"] == 90000.0
    assert got["5"]["remote"] is False
    accepted, rejected = split_untitled(clean_listings(df, "feed"))
    assert accepted.count() == 3 and rejected.first()["job_id"] == "5"


def test_equal_dates_keep_the_same_row_whatever_the_order(spark):
    rows = [{"id": "1", "description": f"text {i}"} for i in range(20)]
    first = clean_listings(raw(spark, *rows), "feed").first()
    again = clean_listings(raw(spark, *reversed(rows)).repartition(7), "feed").first()
    assert first == again


def test_payload_has_null_fields(spark):
    df = with_payload(clean_listings(raw(spark, {"id": "1"}), "feed"), F.lit("2024-01-01").cast("timestamp"))
    row = df.first()
    assert '"company":null' in row["payload"] and '"posted_at":"2024-01-01 00:00:00"' in row["payload"]


def test_junk_filter(spark):
    rows = [
        ("paid", [], "", 5.0, None), ("unpaid", None, None, 0.0, None), ("tags", ["SQL", "Spark"], "x" * 10, None, None),
        ("short", ["sql", "spark"], "x" * 9, None, None), ("one tag", ["sql", "sql"], "x" * 10, None, None),
    ]
    df = spark.createDataFrame(
        rows, "job_id string, tags array<string>, description string, salary_min double, salary_max double"
    )
    kept = not_junk(df, ["sql", "spark"], min_tags=2, min_length=10)
    assert {r["job_id"] for r in kept.collect()} == {"paid", "tags"}


def test_read_many_feeds(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"legal": "x"}, {"id": 7, "position": "A", "salary_min": 10, "extra": {"k": 1}}]')
    (tmp_path / "b.json").write_text('[{"id": "7"}, {"id": "", "position": "B"}, {"id": "8", "tags": ["t"]}]')
    got = read_listings(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    rows = {(r["id"], r["salary_min"], tuple(r["tags"])) for r in got.collect()}
    assert rows == {("7", "10", ()), ("7", None, ()), ("8", None, ("t",))}
    lines = spark.createDataFrame([('{"id": "7"}',), ('{"legal": 1}',), ("{bad",)], "body string")
    assert [r["id"] for r in parse_listings(lines, "body").collect()] == ["7"]
    assert impose_schema(got).columns == NAMES


def test_union_and_bound_query(spark):
    a = spark.createDataFrame([(1, "x")], "id int, only_a string")
    b = spark.createDataFrame([(2,)], "id int")
    both = union_sources({"a": a, "b": b})
    assert {tuple(r) for r in both.select("id", "only_a", "source").collect()} == {(1, "x", "a"), (2, None, "b")}
    got = query_table(spark, "SELECT id FROM {t} WHERE source = :s", {"s": "b' OR '1'='1"}, t=both)
    assert got.count() == 0


def windows(text, size, overlap):
    text = text.strip()
    step = max(size - overlap, 1)
    if len(text) <= size:
        return [text] if text else []
    return [text[i : i + size] for i in range(0, len(text), step)]


def chunked(spark, texts, size, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {}
    for row in chunk(df, ["id"], "text", size, overlap).orderBy("id", "chunk_index").collect():
        assert row["chunk_index"] == len(out.setdefault(row["id"], []))
        out[row["id"]].append(row["chunk_text"])
    return out


def test_chunk_lengths(spark):
    body = "".join(chr(0x61 + i % 26) for i in range(200_000))
    lengths = [1, 799, 800, 801, 1400, 1500, 1501, 2200, 33_047, 200_000]
    texts = [body[:n] for n in lengths] + ["\n lead", " \t　", "", "é\U0001f600" * 900]
    got = chunked(spark, texts, 800, 100)
    for i, text in enumerate(texts):
        assert got.get(i, []) == windows(text, 800, 100)
    assert chunk(spark.createDataFrame([(1, None)], "id int, text string"), ["id"], "text").count() == 0


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.text(st.sampled_from("ab é　\U0001f600"), max_size=120), min_size=1, max_size=30),
    st.integers(1, 12),
    st.integers(0, 14),
)
def test_chunk_property(spark, texts, size, overlap):
    got = chunked(spark, texts, size, overlap)
    step = max(size - overlap, 1)
    for i, text in enumerate(texts):
        assert got.get(i, []) == windows(text, size, overlap)
        whole = text.strip()
        if len(whole) > size:
            assert len(got[i]) == math.ceil(len(whole) / step)
            assert "".join(piece[:step] for piece in got[i]) == whole


def test_choice_of_texts_to_chunk(spark):
    postings = spark.createDataFrame(
        [("a", "one"), ("b", "two"), ("c", " \t"), ("d", None), ("e", "five")], "job_id string, description string"
    )
    stored = spark.createDataFrame([("a", "one"), ("a", "one"), ("e", "old"), ("d", "gone")], "job_id string, t string")
    chunks = stored.select("job_id", F.lit(0).alias("chunk_index"), text_hash(F.col("t")).alias("text_hash"))
    assert {r["job_id"] for r in without_chunks(postings, chunks).collect()} == {"b"}
    single = chunks.dropDuplicates(["job_id"])
    assert {r["job_id"] for r in changed_texts(postings, single).collect()} == {"d", "e"}
