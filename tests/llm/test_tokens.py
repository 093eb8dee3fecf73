"""Packing and BPE against the libraries, on given and awkward texts."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackweave.llm import bpe, packing, queries
from tests.conftest import DATA

AWKWARD = [
    None, "", " ", "\n\n  \n", "a", "aaaaaaaaaaaaaaaa" * 40, "  two  spaces ", "it's we'll I'd", "naïve Ünï 漢字かな🙂🙂🏽",
    "x<|endoftext|>y", "tab\tand\r\nlines\x1c\x1f\x85 end", "12345 678.90", "!!??..,,", "word " * 3000, "ab" * 3000, "ß" * 500,
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "no id"), (3, "\n\n  \n"), (3, "\n\n  \n")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))


def library_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pieces(pieces, texts_by_doc, longest=1024):
    """Every id in exactly one piece, windows gapless and at powers of two."""
    docs = {}
    for p in pieces:
        docs.setdefault(p["doc_id"], []).append(p)
    for doc, want in texts_by_doc.items():
        got = sorted(docs[doc], key=lambda p: p["start"])
        assert [i for p in got for i in np.frombuffer(p["ids"], "<u4").tolist()] == want
        assert all(p["doc_tokens"] == len(want) for p in got)
        at = 0
        for p in got:
            assert p["start"] == at
            at += p["length"]
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append(p)
    for of in windows.values():
        at = 0
        for p in sorted(of, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["window"] == of[0]["window"] and p["step_group"] == of[0]["step_group"]
            at += p["length"]
        assert at == of[0]["window"] <= longest and at & (at - 1) == 0
    return windows


def run_pack(docs, **more):
    return packing.pack(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), **more
    ).collect()


@pytest.mark.parametrize("parts", [1, 5])
def test_pack_given(spark, parts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(parts)
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], library_ids([r.text for r in rows]), strict=True))
    pieces = run_pack(docs, buffer=64)
    windows = check_pieces(pieces, want)
    full = sum(1 for of in windows.values() if of[0]["window"] >= 64)
    assert len(windows) - full <= 6 * parts  # short windows only at the end of a partition


def test_pack_awkward(awkward):
    rows = awkward.distinct().collect()
    want = dict(zip([r.doc_id for r in rows], library_ids([r.text for r in rows]), strict=True))
    check_pieces(run_pack(awkward.distinct().coalesce(1)), want)
    assert sum(p["length"] for p in run_pack(awkward)) == sum(map(len, library_ids([r.text for r in awkward.collect()])))
    assert run_pack(awkward.limit(0)) == []


def test_step_groups_balance():
    windows = [[(0, 0, np.zeros(n), 9)] + [(0, 0, np.zeros(1024 - n), 9)] for n in range(1, 1024, 8)]
    done = list(packing.grouped(iter(windows), 1024, 0))
    cost = {}
    for g, _, w in done:
        cost.setdefault(g, []).append(sum(len(p[2]) ** 2 for p in w))
    assert {len(c) for c in cost.values()} == {packing.STEP_WINDOWS}
    first = [sum(c) for g, c in cost.items() if g < packing.STEP_GROUPS]
    assert max(first) < 1.1 * min(first)


def reference(name="byte_bpe_multi_50k.tiktoken"):
    ranks = bpe.read_ranks(public_tokenizers.path(name))
    return tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_given(spark):
    enc = reference()
    got = {r.doc_id: r for r in queries.QUERIES["op9_byte_bpe"](spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = enc.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_bpe_awkward(awkward):
    enc = reference()
    rows = bpe.encode(awkward, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r.ids == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_bpe_random_bytes():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc, rng = reference("byte_bpe_50k.tiktoken"), np.random.default_rng(7)
    words = [bytes(rng.choice(list(b"abcdeoinrst"), rng.integers(1, 40)).astype(np.uint8)) for _ in range(3000)]
    assert bpe.MergeReplay(ranks).encode(words) == [tuple(enc.encode_ordinary(w.decode())) for w in words]


def test_pack_query(spark):
    rows = queries.QUERIES["op1_hierarchical_packing"](spark, DATA).limit(50).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in rows:
        ids = library_ids([texts[r.doc_id]])[0][r.start:r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
