"""Cross-tokenizer alignment against a plain loop over tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from trackweave.llm import alignment, queries

JSON, MODEL, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
TEXTS = [
    None, "", " ", "  two  blanks ", "hello world", "hello world", "▁piece", "<|endoftext|> <s> </s> <0x41>", "\x00\x01\t\r\n",
    "é é 漢字 🙂👩‍👩‍👧 ﬁ  x", "aaaa" * 3000, "the " * 20_000, "x", "ab cd", "\n\n\n   \n", "1234567890" * 50,
]


def plain(rows):
    """Every document's measures by loops: tokens, ends, groups, occurrence pairs."""
    tok, sp = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    tok.encode_special_tokens = True
    to_byte, entry = alignment.byte_level(), {i: e for e, i in tok.get_vocab().items()}
    seen, groups_of = {}, []
    for _, text in rows:
        if text not in seen:
            a = tok.encode(" " + (text or ""), add_special_tokens=False).ids
            b = sp.encode(text or "")
            ta = [entry[i].encode() if entry[i] == "<|endoftext|>" else bytes(to_byte[c] for c in entry[i]) for i in a]
            tb = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in b)]
            want = (" " + (text or "")).encode()
            groups = []
            if text and b"".join(ta) == want and b"".join(tb) == want:
                ia = ib = ea = eb = 0
                group = ([], [])
                while ia < len(a) or ib < len(b):
                    if ea <= eb and ia < len(a):
                        group[0].append(a[ia])
                        ea += len(ta[ia])
                        ia += 1
                    else:
                        group[1].append(b[ib])
                        eb += len(tb[ib])
                        ib += 1
                    if ea == eb:
                        groups.append(group)
                        group = ([], [])
            seen[text] = groups
        groups_of.append(seen[text])
    counts, top = Counter(), defaultdict(int)
    links_of = []
    for groups in groups_of:
        links = Counter()
        for xs, ys in groups:
            for x, n in Counter(xs).items():
                for y, m in Counter(ys).items():
                    links[x, y] += n * m
        links_of.append(links)
        counts.update(links.keys())
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for (doc, _), groups, links in zip(rows, groups_of, links_of, strict=True):
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((
            doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if counts[p] == top[p[0]]), sum(n * counts[p] for p, n in links.items()),
            hashlib.sha256(written.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, int(r.count_sum), r.groups_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_loops(spark, monkeypatch, small):
    if small:  # many slices, runs and pieces of pairs (functions are shipped with the module's values)
        monkeypatch.setattr(alignment, "SLICE", 300)
        monkeypatch.setattr(alignment, "BATCH", 100)
    rows = [(i if i % 7 else None, t) for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k1": F.lit("x"), "slice": F.lit(1), "copies": F.lit(0)})
    assert result(alignment.align_documents(docs.repartition(3), JSON, MODEL, RANKS)) == plain(rows)


def test_without_ranks_and_empty(spark):
    rows = [(1, "<|endoftext|> plain"), (2, "hello    world")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(alignment.align_documents(docs, JSON, MODEL)) == plain(rows)
    assert alignment.align_documents(docs.limit(0), JSON, MODEL, RANKS).count() == 0


def test_pairs_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    in_a, in_b = rng.integers(1, 40, 50), rng.integers(1, 40, 50)
    of = lambda n: np.repeat(np.arange(50), n)
    groups = alignment.Groups(
        rng.integers(0, 30, in_a.sum()), rng.integers(0, 30, in_b.sum()), of(in_a), of(in_b), in_a, in_b, np.array([20, 1, 29])
    )
    whole = groups.pairs(30, 30)
    monkeypatch.setattr(alignment, "PAIRS", 7)
    assert all(np.array_equal(x, y) for x, y in zip(whole, groups.pairs(30, 30), strict=True))
    want = Counter()
    for text, (s, e) in enumerate([(0, 20), (20, 21), (21, 50)]):
        for g in range(s, e):
            for x in groups.a[groups.group_a == g].tolist():
                for y in groups.b[groups.group_b == g].tolist():
                    want[text, x * 30 + y] += 1
    assert want == Counter({(t, p): n for t, p, n in zip(*(x.tolist() for x in whole), strict=True)})


def test_query_on_given_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.QUERIES["op11_cross_alignment"](spark, DATA).withColumnRenamed("doc_id", "id")
    assert result(got) == plain(rows)
