"""JSON array files cut at byte ranges, against the whole-file parse of the json module."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trackweave.sources.arrays import read_array_listings, split_arrays
from trackweave.sources.listings import read_listings

ODD = ['a}b', '},{', '{"id":"x"}', 'quote " and \\ back', '\\"}', "é} ", "", "]}", '",{"']


def listing(rng, i):
    row = {"id": str(i), "description": rng.choice(ODD) + "w" * rng.randrange(60), "company": rng.choice(ODD)}
    if rng.random() < 0.3:
        row["extra"] = [{"a": {"b": rng.choice(ODD)}}, {"c": "}"}, []]
    if rng.random() < 0.3:
        row["tags"] = [rng.choice(ODD), "t"]
    return row


@pytest.fixture()
def small_ranges(spark):
    old = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(n, str(size)) for n in old]
    for name, value in old.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("size", [60, 4096])
@pytest.mark.parametrize("indent", [None, 1])
def test_records_of_every_range_size(spark, tmp_path, small_ranges, size, indent):
    rng = random.Random(size)
    files = {f"f{n}.json": [listing(rng, i) for i in range(n)] for n in (0, 1, 8)}
    for name, rows in files.items():
        (tmp_path / name).write_text(("﻿" if len(rows) == 1 else "") + json.dumps(rows, indent=indent, ensure_ascii=False) + "\r\n", encoding="utf-8")
    small_ranges(size)
    got = {}
    for r in split_arrays(spark, str(tmp_path)).collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append(json.dumps(json.loads(r["record"])))
    want = {name: sorted(json.dumps(x) for x in rows) for name, rows in files.items() if rows}
    assert {name: sorted(rows) for name, rows in got.items()} == want


def test_one_file_is_many_tasks_and_equals_the_whole_file_parse(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    path = str(tmp_path / "feed.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump([listing(rng, i) for i in range(3000)], f)
    want = sorted(map(str, read_listings(spark, path).collect()))
    small_ranges(20_000)
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() >= 8
    listings, rejects = read_array_listings(spark, [path, path])
    assert sorted(map(str, listings.collect())) == want and rejects.count() == 0


@pytest.mark.parametrize("size", [40, 4096])
def test_broken_objects_are_rejects_and_the_others_stay(spark, tmp_path, small_ranges, size):
    good = [{"id": str(i), "description": f"text {i} }} {{"} for i in range(6)]
    text = [json.dumps(x) for x in good]
    (tmp_path / "value.json").write_text("[" + ",".join([*text[:2], '{"id": broken, "a": {"b": 1}}']) + "]")  # balanced
    (tmp_path / "quote.json").write_text("[" + ", ".join([text[2], '{"id": "9, "description": "x"}', text[3]]) + "]\n")
    (tmp_path / "cut.json").write_text("[" + ",\n".join([text[4], text[5], '{"id": "8", "description": "cut o']))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "other.json").write_text('["a}b", 3, null, {"legal": "notice"}]')
    small_ranges(size)
    listings, rejects = read_array_listings(spark, str(tmp_path))
    assert sorted(r["id"] for r in listings.collect()) == [x["id"] for x in good]
    bad = {r["file"].rsplit("/", 1)[1]: r["record"] for r in rejects.collect()}
    assert set(bad) == {"value.json", "quote.json", "cut.json"} and rejects.count() == 3
    assert bad["value.json"] == '{"id": broken, "a": {"b": 1}}' and bad["quote.json"] == '{"id": "9, "description": "x"}'


def test_lines_and_a_single_object(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"id": "1", "description": "a"}\n{"id": "2", "tags": ["x"]}\n')
    (tmp_path / "one.json").write_text('{"id": "3", "company": {"name": "c"}}')
    listings, rejects = read_array_listings(spark, [str(tmp_path / "lines.json"), str(tmp_path / "one.json")])
    got = {r["id"]: (r["company"], r["tags"]) for r in listings.select("id", "company", F.col("tags")).collect()}
    assert got == {"1": (None, []), "2": (None, ["x"]), "3": ('{"name":"c"}', [])} and rejects.count() == 0
