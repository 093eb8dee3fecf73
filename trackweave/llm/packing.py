"""Hierarchical packing of documents into windows of several lengths.

A document is its token ids and one end id. Whole windows of the longest tier
are cut off first; what is left is routed to the shortest tier (a power of
two) that holds it. A tier's window takes one such rest, which is longer than
half of it; the gap is filled with the longest rests of shorter tiers that
fit, and where none fits exactly one is cut, so that a window is full.
What a partition has left at its end fills windows at powers of two.
No token is padding, and none is lost or repeated.

Finished windows of one tier are dealt into step groups of equal token count
whose attention cost (sum of squared piece lengths) is balanced: a bounded
buffer of windows is sorted by cost and dealt back and forth over its groups.

Every partition packs its own rows in one pass: no shuffle, no state beyond
``BUFFER`` rests and one group buffer per tier, however long texts are or
whatever a source holds. Partitions of a file scan come out alike when a task
runs again; ids of windows and groups carry the partition's number.

Defined cases: a NULL text is an empty document (its end id only), NULL ids
are kept, repeated rows are packed each, other columns are not read.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Rests that a partition holds while it looks for fits.
BUFFER = 8192
#: Window lengths, longest first.
TIERS = (1024, 512, 256, 128, 64)
#: Windows of the longest tier whose tokens make up one step group; groups per balanced buffer.
STEP_WINDOWS, STEP_GROUPS = 8, 8

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("window", pa.int32()), ("step_group", pa.int64()),
])
PIECES_DDL = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, window int, step_group bigint"
)


def tokenizer(json_path: str, ranks_path: str | None = None):
    """A function from a text to its ids (numpy uint32), as the tokenizers library gives them.

    Where the same vocabulary is there as ranks, tiktoken does the work, which
    is five times as fast and gives the same ids; a text that it refuses goes
    to the tokenizers library.
    """
    loaded = []  # the library's own form of the vocabulary is large; it is read when a text needs it

    def by_library(text: str) -> np.ndarray:
        if not loaded:
            import tokenizers

            loaded.append(tokenizers.Tokenizer.from_file(json_path))
        return np.array(loaded[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if ranks_path is None:
        return by_library
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    with open(json_path, encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"] if t["special"]}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def by_ranks(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # the library's own panic types: a run of blanks too long for its pattern engine
            return by_library(text)

    return by_ranks


class Rests:
    """Rests by length, with a bit for every length that is there."""

    def __init__(self):
        self.of: dict[int, list] = {}
        self.bits = 0
        self.count = 0

    def add(self, length: int, rest: tuple) -> None:
        self.of.setdefault(length, []).append(rest)
        self.bits |= 1 << length
        self.count += 1

    def take(self, length: int) -> tuple:
        rests = self.of[length]
        rest = rests.pop()
        if not rests:
            self.bits ^= 1 << length
        self.count -= 1
        return rest

    def longest(self, limit: int) -> int:
        """The longest length up to the limit; 0 if none."""
        return (self.bits & ((2 << limit) - 1)).bit_length() - 1 if self.bits & ((2 << limit) - 1) else 0

    def shortest(self) -> int:
        return (self.bits & -self.bits).bit_length() - 1


class Packer:
    """Packs one partition; yields finished windows as lists of pieces (doc, start, ids, doc_tokens)."""

    def __init__(self, tiers: tuple[int, ...], buffer: int):
        self.tiers, self.top, self.buffer, self.rests = sorted(tiers), max(tiers), buffer, Rests()

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        whole = len(ids) // self.top * self.top
        for at in range(0, whole, self.top):
            yield [(doc, at, ids[at:at + self.top], len(ids))]
        if whole < len(ids):
            self.rests.add(len(ids) - whole, (doc, whole, ids[whole:], len(ids)))
        if self.rests.count > self.buffer:
            yield from self.drain(self.buffer // 2)

    def drain(self, keep: int) -> Iterator[list]:
        """Pack until so many rests are left; with 0 all of them, the end cut at powers of two."""
        while self.rests.count > keep:
            length = self.rests.longest(self.top)
            window = [self.rests.take(length)]
            gap = next(t for t in self.tiers if t >= length) - length
            while gap and self.rests.count:
                fit = self.rests.longest(gap)
                if fit:
                    window.append(self.rests.take(fit))
                    gap -= fit
                else:
                    long = self.rests.shortest()
                    doc, start, ids, total = self.rests.take(long)
                    window.append((doc, start, ids[:gap], total))
                    self.rests.add(long - gap, (doc, start + gap, ids[gap:], total))
                    gap = 0
            if gap:
                yield from at_powers(window)
            else:
                yield window


def at_powers(pieces: list) -> Iterator[list]:
    """Cut the last pieces of a partition into windows whose lengths are powers of two."""
    left, total = list(reversed(pieces)), sum(len(p[2]) for p in pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        window = []
        while room:
            doc, start, ids, tokens = left.pop()
            if len(ids) > room:
                left.append((doc, start + room, ids[room:], tokens))
                ids = ids[:room]
            window.append((doc, start, ids, tokens))
            room -= len(ids)
        yield window


class StepGroups:
    """Deals windows of one length into groups of equal size and near-equal attention cost."""

    def __init__(self, size: int, groups: int):
        self.size, self.groups, self.windows = size, groups, []

    def add(self, window: list, next_group: Iterator[int]) -> Iterator[tuple[int, list]]:
        self.windows.append(window)
        if len(self.windows) == self.size * self.groups:
            yield from self.deal(next_group)

    def deal(self, next_group: Iterator[int]) -> Iterator[tuple[int, list]]:
        groups = -(-len(self.windows) // self.size)
        ids = [next(next_group) for _ in range(groups)]
        ordered = sorted(self.windows, key=lambda w: sum(len(p[2]) ** 2 for p in w), reverse=True)
        self.windows = []
        for i, window in enumerate(ordered):
            turn, at = divmod(i, groups)
            yield ids[at if turn % 2 == 0 else groups - 1 - at], window


def grouped(windows: Iterator[list], top: int, first: int) -> Iterator[tuple[int, int, list]]:
    """(step group, window length, window) of all windows of a partition."""
    groups: dict[int, StepGroups] = {}
    numbers = iter(range(first, first + (1 << 33)))
    for window in windows:
        length = sum(len(p[2]) for p in window)
        of = groups.setdefault(length, StepGroups(max(1, STEP_WINDOWS * top // length), STEP_GROUPS))
        for number, done in of.add(window, numbers):
            yield number, length, done
    for length in sorted(groups, reverse=True):
        for number, done in groups[length].deal(numbers):
            yield number, length, done


def pack(
    docs: DataFrame, json_path: str, ranks_path: str | None = None, tiers: tuple[int, ...] = TIERS,
    end_id: int = 0, buffer: int = BUFFER, id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece (see ``PIECES_DDL``); ``ids`` are little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokenizer(json_path, ranks_path), Packer(tiers, buffer)
        first = TaskContext.get().partitionId() << 33
        end = np.array([end_id], dtype=np.uint32)

        def windows() -> Iterator[list]:
            for batch in batches:
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = encode(body.as_py() or "")
                    yield from packer.add(doc, np.concatenate([ids, end]))
            yield from packer.drain(0)

        rows, tokens = [], 0
        for sequence, (group, length, window) in enumerate(grouped(windows(), max(tiers), first), first):
            offset = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset, length, group))
                offset += len(ids)
            tokens += offset
            if tokens >= 1 << 20:
                yield as_batch(rows)
                rows, tokens = [], 0
        if rows:
            yield as_batch(rows)

    return docs.select(docs[id_col].cast("long"), docs[text]).mapInArrow(run, PIECES_DDL)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES
    )
