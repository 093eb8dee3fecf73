"""Registered queries against their SQL, and awkward rows for the operators that SQL covers."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from trackweave.llm import licenses, quality_classifier as qc, quality_rules, queries, sharding
from verify import normal

AWKWARD = [
    (1, None), (2, ""), (2, ""), (None, "no id"), (3, " \n\t\x0b "), (4, "word " * 60), (5, "the cat\nthe cat\n\nthe cat " * 20),
    (6, "Licensed under CC BY-NC 4.0. ALL RIGHTS   RESERVED!"), (7, "cc by cc by cc-by, CC\nBY general public license"),
    (8, "This work is under the GNU General Public License, version 3 or later"), (9, "é ü cc by 漢字 🙂 all rights reserved"),
    (10, "x" * 100_000), (11, "all rights reserved " * 4000), (12, "Permission is hereby granted, free of charge, MIT License"),
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert normal(got) == normal(want)


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumns({"n_words": F.lit(-1), "kept": F.lit(None).cast("int")})


@pytest.mark.parametrize("name", ["op4_license_scan", "op5_quality_rules"])
def test_awkward_rows_equal_sql(spark, tmp_path, awkward, name):
    awkward.select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    frame = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    # Ids repeat and are NULL here: rows of distinct ids are compared.
    one = lambda f: normal(f[f.doc_id.notna() & (f.doc_id != 2)])
    assert one(got) == one(frame) and len(got) == len(AWKWARD)


def test_license_scan(awkward):
    rows = {r.text: r for r in licenses.scan(awkward).collect()}
    assert (rows[AWKWARD[7][1]].n_base, rows[AWKWARD[7][1]].base_labels) == (2, "cc-by,reserved")
    assert "cc-by-nc-4.0" in rows[AWKWARD[7][1]].labels and rows[AWKWARD[7][1]].score == 0.95
    assert (rows[AWKWARD[8][1]].n_base, rows[AWKWARD[8][1]].first_word, rows[AWKWARD[8][1]].last_word) == (5, 0, 8)
    assert rows[AWKWARD[9][1]].labels == "gpl,gpl-3"
    assert rows[AWKWARD[12][1]].n_base == 4000 and rows[AWKWARD[12][1]].last_word == 11997
    assert rows[None].n_words == 0 and rows[None].labels == "" and rows[None].score == 0
    assert licenses.scan(awkward.limit(0)).count() == 0


def test_quality_rules(awkward):
    rows = quality_rules.apply_rules(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by_text = {r.text: r for r in rows}
    assert by_text[None].n_words == 0 and not by_text[None].kept and by_text[None].base_failed
    assert by_text["word " * 60].n_repeat_words == 60
    assert quality_rules.apply_rules(awkward.limit(0)).count() == 0
    assert quality_rules.quality_stage(awkward).columns == awkward.columns


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards(spark, awkward, shards):
    hot = spark.range(500).select(F.lit(77).cast("long").alias("doc_id"), F.repeat(F.lit("a"), (F.col("id") % 7).cast("int")).alias("text"))
    docs = awkward.select("doc_id", "text").unionByName(hot).repartition(5)
    rows = sharding.byte_shards(docs, shards).collect()
    assert len(rows) == len(AWKWARD) + 500
    total = sum(r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    for s in range(shards):
        mine = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / shards) <= largest
    texts = [t for _, t in AWKWARD] + ["a" * (i % 7) for i in range(500)]
    want = sorted((len((t or "").encode()) + 16, -1 if t is None else zlib.crc32(t.encode())) for t in texts)
    assert sorted((r["size"], -1 if r.crc is None else r.crc) for r in rows) == want
    # Contiguous in the order of ids.
    order = sorted((r.id is not None, r.id or 0, r.shard) for r in rows)
    assert [s for _, _, s in order] == sorted(s for _, _, s in order)
    assert sharding.byte_shards(docs.limit(0), shards).count() == 0


def test_features_do_not_depend_on_company():
    texts = ["The cat sat.", "", "the the the", None, "ünï 漢字 🙂", "x"]
    ids, first = qc.features(texts)
    for i, text in enumerate(texts):
        alone, _ = qc.features([text])
        assert sorted(alone.tolist()) == sorted(ids[first[i]:first[i + 1]].tolist())
    assert first[2] == first[1] and first[4] == first[3]


def test_classifier_held_out(spark):
    good = ["the cat and the dog of " + " ".join(f"word{(i * j) % 97}" for j in range(40)) for i in range(200)]
    bad = ["### %%% " + " ".join(["spam"] * (20 + i % 9)) for i in range(200)]
    rows = [(i, t, int(i < 200)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").drop("quality")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (9999, 1), (5, None), (6, 7)], "doc_id long, quality int")
    awkward = spark.createDataFrame([(1000, None), (1001, ""), (None, "the")], "doc_id long, text string")
    model = qc.train(docs, labels)
    scored = qc.score(docs.unionByName(awkward).withColumn("score", F.lit("x")), model).collect()
    assert len(scored) == 403 and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and all((r.score >= qc.GOOD) == (r.doc_id < 200) for r in held)
    again = qc.train(docs.repartition(3), labels)
    assert np.array_equal(again.table, model.table)
    assert np.array_equal(qc.train(docs, labels.limit(0)).table, np.zeros(qc.BUCKETS))
    assert qc.score(docs.limit(0), model).count() == 0


def test_classifier_query(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    rows = queries.QUERIES["op10_quality_classifier"](spark, folder).collect()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r.score, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held if x == 1 for b, y in held if y == 0]
    assert sum(pairs) / len(pairs) > 0.9


def test_classifier_sample(spark):
    """One text per id, chosen by hash, whatever the order of rows; the longest go where there are too many characters."""
    rows = [(i, "good words " * (i + 1)) for i in range(60)]
    hot = [(8, f"another text {i} " * 3) for i in range(120)]
    schema = "doc_id long, text string"
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once, again = (spark.createDataFrame(x, schema).repartition(n) for x, n in ((rows + hot, 3), (hot[::-1] + rows, 7)))
    first, second = (qc.training_rows(d, labels, 1000, 10**9).orderBy("doc_id").collect() for d in (once, again))
    fit = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert first == second and [r.doc_id for r in first] == fit
    assert len(qc.training_rows(once, labels, 10, 10**9).collect()) == 10
    assert np.array_equal(qc.train(once, labels).table, qc.train(again, labels).table)
    short = qc.training_rows(spark.createDataFrame(rows, schema), labels, 1000, 2000).collect()
    assert sum(len(r.text) for r in short) <= 2000
    assert max(len(r.text) for r in short) < min(len(t) for i, t in rows if i in fit and i not in {r.doc_id for r in short})
    nothing = spark.createDataFrame([(i, None) for i in range(60)], schema)
    assert len(qc.training_rows(nothing, labels, 1000, 0).collect()) == len(fit)


def features_by_hand(text):
    """Words, word pairs, characters' n-grams and repeats at a distance, one after the other."""
    word_mask, inverse = (1 << 64) - 1, qc.INVERSE

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & word_mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & word_mask
        return x ^ (x >> 31)

    padded, out = f" {text} ", []
    value = lambda c: mix(32 if c in " \t\n\x0b\x0c\r" else ord(c))
    white = lambda c: c in " \t\n\x0b\x0c\r"
    for n in qc.GRAMS:
        for i in range(len(padded) - n + 1):
            gram = padded[i:i + n]
            if not any(map(white, gram[1:-1])) and not (white(gram[0]) and white(gram[-1])):
                total = n
                for c in gram:
                    total = (total * qc.BASE + value(c)) & word_mask
                out.append(mix(total))
    words = []
    for word in text.split():
        total = 0
        for i, c in enumerate(word):
            total += value(c) * pow(qc.BASE, i, 1 << 64)
        words.append(mix(total & word_mask))
    out += words + [mix((a * 3 + b) & word_mask) for a, b in zip(words, words[1:])]
    for n in range(1, qc.REPEATS + 1):
        out += [mix(n)] * sum(a == b for a, b in zip(words, words[n:]))
    return sorted(x % qc.BUCKETS for x in out)


def test_fit_by_hand():
    """Features and gradient steps against loops over plain numbers."""
    texts = ["the cat and the dog", "spam spam spam spam", "", "ünï 漢字 🙂 words\tof a\nline", "spam of the spam"] * 4
    labels = np.array([1, 0, 0, 1, 0] * 4)
    for text in texts[:5]:
        assert sorted(qc.features([text])[0].tolist()) == features_by_hand(text)
    rng = np.random.default_rng(1)
    vectors = rng.uniform(-1 / qc.WIDTH, 1 / qc.WIDTH, (qc.BUCKETS, qc.WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (2, qc.WIDTH)).astype(np.float32).tolist(), [0.0, 0.0]
    learned, step = {}, 0
    for _ in range(qc.EPOCHS):
        for i in rng.permutation(len(texts)):
            now = qc.RATE * (1 - step / (qc.EPOCHS * len(texts)))
            step += 1
            ids = features_by_hand(texts[i])
            share = {x: ids.count(x) / len(ids) for x in ids}
            for x in share:
                learned.setdefault(x, vectors[x].tolist())
            mean = [sum(s * learned[x][d] for x, s in share.items()) for d in range(qc.WIDTH)]
            logits = [sum(w * m for w, m in zip(line, mean)) + b for line, b in zip(layer, bias)]
            parts = [np.exp(z - max(logits)) for z in logits]
            error = [p / sum(parts) - (k == labels[i]) for k, p in enumerate(parts)]
            back = [layer[0][d] * error[0] + layer[1][d] * error[1] for d in range(qc.WIDTH)]
            for k in range(2):
                bias[k] -= now * 0.1 * error[k]
                layer[k] = [w - now * error[k] * m for w, m in zip(layer[k], mean)]
            scale = min(200.0, 1 / max(1e-12, sum(s * s for s in share.values())))
            for x, s in share.items():
                learned[x] = [v - now * scale * s * g for v, g in zip(learned[x], back)]
    difference = [b - a for a, b in zip(*layer)]
    model = qc.fit(texts, labels)
    assert abs(model.bias - (bias[1] - bias[0])) < 1e-3
    for x, v in learned.items():
        assert abs(model.table[x] - sum(a * b for a, b in zip(v, difference))) < 1e-2
    for text, got in zip(texts[:5], model.scores(texts[:5])):
        ids = features_by_hand(text)
        logit = sum(sum(a * b for a, b in zip(learned[x], difference)) for x in ids) / max(1, len(ids)) + bias[1] - bias[0]
        assert abs(got - 1 / (1 + np.exp(-logit))) < 1e-3
