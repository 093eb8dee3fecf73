"""Cross-tokenizer alignment: two tokenizations of the same bytes, tied where both end a token.

Every text is encoded, with a space before it, by two vocabularies A and B.
Byte offsets at which a token of A and a token of B end cut both sequences
into groups; a token of A and one of B link where they share a group.

1. Documents are shuffled by full text, so that copies become one text with a
   number of copies (reduced before the shuffle too). A task tokenises and
   aligns each distinct text once, in slices of bounded size, and stores per
   text its own measures and its distinct linked id pairs with their links.
2. A slice gives its distinct pairs, each with the number of documents that
   hold it linked: texts weighted by their copies. Spark adds them up.
3. The corpus-wide count of a pair, and whether it is the highest of its A id,
   go back to the slices that have the pair, and the sums of each text come out.
4. The measures are joined to the documents by 128 bits of hash of the text.

Of a group with many tokens on both sides only the distinct id pairs are
formed, in pieces of bounded size, never the pairs of occurrences.

Defined cases: a NULL or empty text, and one of which the joined bytes of A's
or B's tokens are not its own after a space (a text that holds U+2581, say),
has no tokens and zeros; special tokens' strings are plain text; repeated rows
and ids are rows like others; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from trackweave.operators.keyed import join_hot
from trackweave.session import materialize

#: Bytes of text that a slice is sized for, and bytes encoded at a time.
SLICE, BATCH = 8_000_000, 2_000_000
#: Pairs formed at a time.
PAIRS = 1 << 21

SLICES = pa.schema([
    ("slice", pa.int64()), ("keys", pa.binary()), ("measures", pa.binary()), ("digests", pa.binary()),
    ("pairs", pa.binary()), ("weights", pa.binary()), ("counts", pa.binary()), ("entries", pa.binary()), ("links", pa.binary()),
])
SLICES_DDL = (
    "slice long, keys binary, measures binary, digests binary, pairs binary, weights binary, counts binary, "
    "entries binary, links binary"
)
MEASURED_DDL = (
    "k1 long, k2 long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum decimal(38,0), groups_sha256 string"
)


def byte_level() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies, by their rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Side:
    """A tokenizer and the bytes of its tokens."""

    encode: Callable[[list[str]], list]  # texts to id sequences
    tokens: pa.Array  # binary, by id

    def __post_init__(self):
        self.lengths = pc.binary_length(self.tokens).to_numpy(zero_copy_only=False).astype(np.int64)


def side_a(json_path: str, ranks_path: str | None) -> Side:
    """A byte-level vocabulary; texts get their space here.

    Where the same vocabulary is there as ranks, tiktoken does the work; a text
    that it refuses goes to the tokenizers library.
    """
    with open(json_path, encoding="utf-8") as file:
        vocabulary = json.load(file)
    to_byte, special = byte_level(), {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
    table = {
        number: entry.encode() if entry in special else bytes(to_byte[c] for c in entry)
        for entry, number in {**vocabulary["model"]["vocab"], **special}.items()
    }
    loaded = []

    def by_library(text: str) -> np.ndarray:
        if not loaded:
            import tokenizers

            loaded.append(tokenizers.Tokenizer.from_file(json_path))
            loaded[0].encode_special_tokens = True
        return np.array(loaded[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    one = by_library
    if ranks_path is not None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def one(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except Exception:  # the library's own panic types: a run of blanks too long for its pattern engine
                return by_library(text)

    tokens = pa.array([table.get(i, b"") for i in range(max(table, default=-1) + 1)], pa.binary())
    return Side(lambda texts: [one(" " + t) for t in texts], tokens)


def side_b(model_path: str) -> Side:
    """A piece vocabulary with bytes; it adds the space itself."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model_path)

    def content(i: int) -> bytes:
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if pieces.is_byte(i) else piece.replace("\u2581", " ").encode()

    tokens = pa.array([content(i) for i in range(pieces.get_piece_size())], pa.binary())
    return Side(lambda texts: [np.array(x, np.uint32) for x in pieces.encode(texts, num_threads=1)], tokens)


def flat(sequences: list) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and the number of each sequence."""
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    ids = np.concatenate(sequences).astype(np.int64) if len(sequences) else np.zeros(0, np.int64)
    return ids, sizes


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def faithful(ids: np.ndarray, sizes: np.ndarray, side: Side, data: np.ndarray, bytes_of: np.ndarray) -> np.ndarray:
    """Which texts (``bytes_of`` bytes each, in ``data``) are what their tokens join to."""
    good = sums(side.lengths[ids], sizes) == bytes_of
    joined = side.tokens.take(pa.array(ids[np.repeat(good, sizes)]))
    begin, end = (joined.buffers()[1], joined.buffers()[2]) if len(joined) else (None, None)
    mine = np.frombuffer(end, np.uint8)[:int(bytes_of[good].sum())] if begin is not None and end is not None else np.zeros(0, np.uint8)
    differs = mine != data[np.repeat(good, bytes_of)]
    good[good] = sums(differs, bytes_of[good]) == 0
    return good


@dataclass
class Groups:
    """The groups of a run of texts that both sides keep."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray  # of each token
    group_b: np.ndarray
    in_a: np.ndarray  # tokens of each group
    in_b: np.ndarray
    per_text: np.ndarray  # groups of each text

    def digests(self) -> list[bytes]:
        """sha256 of the groups written out, for each text."""
        before_b = np.concatenate(([0], np.cumsum(self.in_b)))
        upto_a = np.cumsum(self.in_a)
        at_a = np.arange(len(self.a)) + before_b[self.group_a]
        at_b = np.arange(len(self.b)) + upto_a[self.group_b]
        ids, mark = np.empty(len(at_a) + len(at_b), np.int32), np.zeros(len(at_a) + len(at_b), np.int8)
        ids[at_a], ids[at_b] = self.a, self.b
        both = np.cumsum(self.in_a + self.in_b)
        mark[both - 1], mark[both - self.in_b - 1] = 2, 1
        text_ends = both[np.cumsum(self.per_text) - 1]
        mark[text_ends - 1] = 3
        marks = pa.array([",", "|", ";", ""]).take(pa.array(mark))
        written = pc.binary_join_element_wise(pa.array(ids).cast(pa.string()), marks, "").cast(pa.large_string())
        offsets = np.frombuffer(written.buffers()[1], np.int64)
        data = memoryview(written.buffers()[2])
        cuts = np.concatenate(([0], offsets[text_ends]))
        return [hashlib.sha256(data[s:e]).digest() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]

    def pairs(self, width_a: int, width_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair (a * width_b + b) and links of every distinct linked pair of a text, sorted."""
        text_of = np.repeat(np.arange(len(self.per_text)), self.per_text)
        own_a, times_a = np.unique(self.group_a * width_a + self.a, return_counts=True)
        own_b, times_b = np.unique(self.group_b * width_b + self.b, return_counts=True)
        group, a = own_a // width_a, own_a % width_a
        first_b = np.searchsorted(own_b, np.arange(len(self.in_a) + 1) * width_b)
        partners = (first_b[1:] - first_b[:-1])[group]
        upto = np.cumsum(partners)
        keys, links, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while at < len(own_a):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            n = partners[at:to]
            rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            b = np.repeat(first_b[group[at:to]], n) + rank
            key = np.repeat((text_of[group[at:to]] * width_a + a[at:to]) * width_b, n) + own_b[b] % width_b
            keys, links = added(
                np.concatenate((keys, key)), np.concatenate((links, np.repeat(times_a[at:to], n) * times_b[b]))
            )
            at = to
        return keys // (width_a * width_b), keys % (width_a * width_b), links


def added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def align(texts: list[str], side_a: Side, side_b: Side) -> tuple[np.ndarray, Groups]:
    """Which texts keep their bytes on both sides, and the groups of those."""
    data = np.frombuffer("".join(f" {t}" for t in texts).encode(), np.uint8)
    bytes_of = np.array([len(t.encode()) + 1 for t in texts], np.int64)
    (a, n_a), (b, n_b) = flat(side_a.encode(texts)), flat(side_b.encode(texts))
    good = faithful(a, n_a, side_a, data, bytes_of) & faithful(b, n_b, side_b, data, bytes_of) & (bytes_of > 1)
    a, b, ends = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], np.cumsum(bytes_of[good])
    end_a, end_b = np.cumsum(side_a.lengths[a]), np.cumsum(side_b.lengths[b])
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    per_text = np.diff(np.concatenate(([0], np.searchsorted(cuts, ends, side="right"))))
    return good, Groups(
        a, b, group_a, group_b, np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts)), per_text
    )


class SliceOf:
    """Gathers the aligned texts of one slice."""

    def __init__(self, width_a: int, width_b: int):
        self.width_a, self.width_b, self.parts, self.bytes = width_a, width_b, [], 0

    def add(self, k1: np.ndarray, k2: np.ndarray, copies: np.ndarray, good: np.ndarray, groups: Groups, size: int) -> None:
        text, pair, links = groups.pairs(self.width_a, self.width_b)
        per = groups.per_text
        measures = np.stack([
            sums(groups.in_a, per), sums(groups.in_b, per), per, sums(groups.in_a * groups.in_b, per)
        ], axis=1)
        self.parts.append((
            np.stack((k1[good], k2[good]), axis=1), measures, b"".join(groups.digests()) if len(per) else b"",
            np.bincount(text, minlength=len(per)), pair, links, np.repeat(copies[good], np.bincount(text, minlength=len(per))),
        ))
        self.bytes += size

    def row(self, number: int) -> pa.RecordBatch:
        keys, measures, digests, counts, pair, links, copies = zip(*self.parts, strict=True)
        pair, links = np.concatenate(pair), np.concatenate(links)
        pairs, weights = added(pair, np.concatenate(copies))
        entries = np.searchsorted(pairs, pair)
        self.parts, self.bytes = [], 0
        packed = lambda x, kind: pa.compress(x.astype(kind).tobytes(), "zstd", asbytes=True) if len(x) else b""
        values = [
            number, np.concatenate(keys).astype("<i8").tobytes(), np.concatenate(measures).astype("<i8").tobytes(),
            b"".join(digests), pairs.astype("<i8").tobytes(), weights.astype("<i8").tobytes(),
            np.concatenate(counts).astype("<u4").tobytes(), packed(entries, "<u4"), packed(links, "<i8"),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, SLICES.types, strict=True)], schema=SLICES)


def runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Batches cut into runs of rows of about ``size`` bytes of the first column, with their bytes."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(upto):
            before = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + size, side="right")))
            yield batch.slice(at, to - at), int(upto[to - 1] - before)
            at = to


def aligner(json_path: str, ranks_path: str | None, model_path: str):
    """Map side: (text, k1, k2, copies) to one row per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sides, number = None, TaskContext.get().partitionId() << 32
        for part, size in runs(batches, BATCH):
            if sides is None:
                sides = side_a(json_path, ranks_path), side_b(model_path)
                own = SliceOf(*(len(s.tokens) for s in sides))
            k1, k2, copies = (part.column(i).to_numpy() for i in (1, 2, 3))
            own.add(k1, k2, copies, *align(part.column(0).to_pylist(), *sides), size)
            if own.bytes >= SLICE:
                yield own.row(number)
                number += 1
        if sides is not None and own.parts:
            yield own.row(number)

    return run


def pair_rows(width_b: int):
    """The distinct pairs of stored slices as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, weights in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pair = np.frombuffer(pairs, "<i8")
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(pair), number, np.int64)), pa.array((pair // width_b).astype(np.int32)),
                    pa.array((pair % width_b).astype(np.int32)), pa.array(np.frombuffer(weights, "<i8")),
                ], names=["slice", "a", "b", "weight"])

    return run


def measured(width_b: int):
    """A slice and the counts of its pairs to one row per text."""

    def run(stored: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in stored.itertuples():
            keys, measures = (np.frombuffer(x, "<i8").reshape(-1, w) for x, w in ((r.keys, 2), (r.measures, 4)))
            per = np.frombuffer(r.counts, "<u4").astype(np.int64)
            n = int(per.sum())
            unpacked = lambda x, kind, w: np.frombuffer(pa.decompress(x, n * w, "zstd", asbytes=True) if n else b"", kind)  # noqa: B023, E731
            entries, links = unpacked(r.entries, "<u4", 4), unpacked(r.links, "<i8", 8)
            pair = np.frombuffer(r.pairs, "<i8")
            own = counts["a"].to_numpy(np.int64) * width_b + counts["b"].to_numpy(np.int64)
            order = np.argsort(own)
            at = order[np.searchsorted(own[order], pair)] if n else np.zeros(0, np.int64)
            count, best = counts["count"].to_numpy(np.int64)[at], counts["best"].to_numpy(bool)[at]
            digest = [r.digests[i:i + 32].hex() for i in range(0, len(r.digests), 32)]
            total = sums(links * (count[entries] >> 32), per), sums(links * (count[entries] & 0xFFFFFFFF), per)
            out.append(pd.DataFrame({
                "k1": keys[:, 0], "k2": keys[:, 1], "n_a": measures[:, 0], "n_b": measures[:, 1], "n_groups": measures[:, 2],
                "n_links": measures[:, 3], "n_best": sums(links * best[entries], per),
                "count_sum": [Decimal((int(h) << 32) + int(l)) for h, l in zip(*total, strict=True)], "groups_sha256": digest,
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in MEASURED_DDL.split(", ")])

    return run


def text_keys(text: str = "text") -> tuple:
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair linked) and whether it is the highest of its A id."""
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("weight").alias("count")), "pair_counts")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return join_hot(counts, top, ["a"], "inner").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, json_path: str, model_path: str, ranks_path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 ('' without tokens) of every document.

    ``count_sum`` is decimal(38,0), since links times counts may pass the range of long.
    """
    width_b = len(side_b(model_path).tokens)
    distinct = docs.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies")).select("text", *text_keys(), "copies")
    stored = materialize(distinct.mapInArrow(aligner(json_path, ranks_path, model_path), SLICES_DDL), "aligned")
    pairs = materialize(stored.select("slice", "pairs", "weights").mapInArrow(
        pair_rows(width_b), "slice long, a int, b int, weight long"
    ), "pairs")
    judged = join_hot(pairs.select("slice", "a", "b"), pair_counts(pairs), ["a", "b"], "inner")
    per_text = stored.groupBy("slice").cogroup(judged.groupBy("slice")).applyInPandas(measured(width_b), MEASURED_DDL)
    keyed = docs.select(F.col(id_col).alias("id"), *text_keys())
    joined = join_hot(keyed, materialize(per_text, "measured"), ["k1", "k2"], "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best")]
    return joined.select(
        "id", *numbers, F.coalesce("count_sum", F.lit(0).cast("decimal(38,0)")).alias("count_sum"),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
