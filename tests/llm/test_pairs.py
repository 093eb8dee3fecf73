"""Substring dedup and the Jaccard join against plain Python, with hot groups, ties and awkward rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from trackweave.llm import jaccard_join as jj, substring_dedup as sd
from trackweave.llm.components import components


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def edited(base, edits, seed):
    rng, out = random.Random(seed), list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return out


def corpus():
    """Near copies around the threshold, exact copies, passages, short and empty texts."""
    base, passage, rows = words(120, 1), words(60, 2), []
    rows += [" ".join(edited(base, i % 9, i)) for i in range(90)]
    rows += [" ".join(base).upper()] * 20
    rows += [" ".join(words(40, 100 + i) + passage + words(i, 200 + i)) for i in range(30)]
    rows += [" ".join(["same"] * n) for n in (1, 4, 5, 19, 20, 21, 60)] + [" ".join(words(20, 5)) + "\n" + " ".join(words(20, 5))]
    rows += [None, "", " \t\n", "one two", "one  two", "ONE two", "a b c d", "é ü 漢字 🙂 x", "é ü 漢字 🙂 x"]
    rows += [" ".join(words(3000, 7)), " ".join(words(3000, 7)[:2900])]
    rng = random.Random(4)
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows, strict=True))


def brute_components(rows, k=5, percent=75):
    sets = {}
    for i, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("longest", "block"), [(64, 100_000), (2, 100_000), (2, 900)])
def test_jaccard(spark, monkeypatch, longest, block):
    monkeypatch.setattr(jj, "LIST", longest)
    monkeypatch.setattr(jj, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit(1)).repartition(3)
    got = {r.id: (r["size"], r.component) for r in jj.join_documents(docs).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("light", [0, 60, 118, 10**6])
def test_jaccard_light_and_heavy(spark, monkeypatch, light):
    """The boundary on either side of, and among, the sizes that link; nothing stays in the work folder but what the result reads."""
    monkeypatch.setattr(jj, "LIST", 2)
    rows = corpus() + [(2000 + i, " ".join(edited(words(60 + i, 77)[:60 + i], i % 3, 400 + i))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    joined = jj.join_documents(docs, light=light)
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert left == {"roots"}
    assert {r.id: (r["size"], r.component) for r in joined.collect()} == brute_components(rows)


def test_jaccard_repeated_null_and_empty(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "x y"), (2, None), (None, None), (None, "q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id is None, r.id or 0, r["size"], r.component) for r in jj.join_documents(docs).collect()), key=str)
    want = [(False, 5, 2, 5), (False, 5, 2, 5), (True, 0, 2, 5), (False, 2, 1, 2), (False, 2, 0, 2), (True, 0, 0, None), (True, 0, 1, None)]
    assert got == sorted(want, key=str)
    assert jj.join_documents(docs.limit(0)).count() == 0


def brute_repeats(rows, window=20):
    first = {}
    cut = {i: (t or "").replace("\n", " ").replace("\t", " ").split(" ") for i, t in rows}
    cut = {i: [w for w in ws if w] for i, ws in cut.items()}
    for i in sorted(cut):
        for j in range(len(cut[i]) - window + 1):
            first.setdefault(tuple(cut[i][j:j + window]), (i, j))
    out = {}
    for i, ws in cut.items():
        gone = set()
        for j in range(len(ws) - window + 1):
            if first[tuple(ws[j:j + window])] != (i, j):
                gone |= set(range(j, j + window))
        out[i] = (len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone))
    return out


@pytest.mark.parametrize(("group", "report", "size"), [(1_000_000, 16, 3 << 20), (10, 1, 3 << 20), (10, 1, 2000)])
def test_substrings(spark, monkeypatch, group, report, size):
    monkeypatch.setattr(sd, "REPORT", report)
    monkeypatch.setattr(sd.slices, "__defaults__", (size,))
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("starts", F.lit("x")).repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in sd.remove_repeats(docs, group=group, per_partition=500).collect()}
    assert got == brute_repeats(rows)


def brute_maximal(rows, window, depth):
    """Every string of window..depth words with two places, not extended alike by all of them; cut at depth."""
    cut = {i: (t or "").split() for i, t in rows}
    places = {}
    for i, ws in cut.items():
        for j in range(len(ws)):
            for n in range(window, min(depth, len(ws) - j) + 1):
                places.setdefault(tuple(ws[j:j + n]), []).append((i, j))
    out = set()
    for key, at in places.items():
        if len(at) < 2:
            continue
        before = {cut[i][j - 1] if j else (i, j) for i, j in at}
        behind = {cut[i][j + len(key)] if j + len(key) < len(cut[i]) else (i, j) for i, j in at}
        if len(before) > 1 and (len(behind) > 1 or len(key) == depth):
            out.add((*min(at), len(key)))
    return out


@pytest.mark.parametrize(("group", "size"), [(1_000_000, 3 << 20), (10, 700)])
def test_maximal_repeats(spark, monkeypatch, group, size):
    monkeypatch.setattr(sd, "REPORT", 1)
    monkeypatch.setattr(sd, "PIECE", 1500)
    monkeypatch.setattr(sd.slices, "__defaults__", (size,))
    rng, base = random.Random(6), words(60, 1)
    rows = [(i, " ".join(edited(base, rng.randrange(4), i)[rng.randrange(9):rng.randrange(40, 61)])) for i in range(40)]
    rows += [(50, " ".join(base)), (51, " ".join(base)), (52, " ".join(["same"] * 25)), (53, None), (54, "a b c")]
    rows += [(60 + i, "x " * (i % 2) + " ".join(words(24, 3)) + " y" * i) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in sd.maximal_repeats(docs.unionAll(docs), 20, 30, group=group, per_partition=400).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_maximal(rows, 20, 30)
    assert sd.maximal_repeats(docs.limit(0)).count() == 0


def test_tree_nodes_are_sorted_intervals():
    """Inner nodes of a tree against all pairs of its suffixes."""
    rng = random.Random(2)
    text = " ".join(rng.choice("ab") for _ in range(60))
    words_, n = text.split(), 60 - 3 + 1
    row = {"doc_ids": (1).to_bytes(8, "little"), "hashes": bytes(4), "counts": sd.short(sd.np.array([1])), "starts": sd.short(sd.np.array([0])),
           "sizes": sd.short(sd.np.array([n])), "lefts": b"\x00", "lengths": sd.short(sd.np.array([len(text)])),
           "text": sd.pa.compress(text.encode(), "zstd", asbytes=True), "bytes": len(text)}
    tree = sd.Tree(sd.pd.DataFrame([row]), 3, 10)
    got = sorted((d, tuple(sorted(tree.starts[a:b].tolist()))) for d, a, b in tree.nodes())
    want = set()
    for i in range(n):
        for j in range(i + 1, n):
            d = next((k for k in range(10) if j + k >= 60 or words_[i + k] != words_[j + k]), 10)
            if d >= 3:
                want.add((d, tuple(x for x in range(n) if words_[x:x + d] == words_[i:i + d] and x + d <= 60)))
    assert got == sorted(want)


def test_substrings_repeated_and_null(spark):
    text = " ".join(words(30, 9))
    rows = [(3, text), (3, text), (None, text), (None, None), (7, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in sd.remove_repeats(docs).collect())
    assert got == [("3", 30, 30), ("3", 30, 30), ("7", 30, 30), ("None", 0, 0), ("None", 30, 0)]
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("size", [3 << 20, 20_000])
def test_jaccard_many_documents_in_a_slice(spark, monkeypatch, size):
    """Enough documents, groups and slices that the order of classes and of shingles differ."""
    monkeypatch.setattr(sd.slices, "__defaults__", (size,))
    monkeypatch.setattr(jj, "PER_PARTITION", 2000)
    rng, rows = random.Random(8), []
    for g in range(150):
        base = words(rng.randrange(30, 90), 1000 + g)
        rows += [" ".join(edited(base, rng.randrange(3), 7000 + 10 * g + j)) for j in range(rng.randrange(1, 5))]
    ids = rng.sample(range(10_000), len(rows))
    rows = list(zip(ids, rows, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.id: (r["size"], r.component) for r in jj.join_documents(docs).collect()} == brute_components(rows)
