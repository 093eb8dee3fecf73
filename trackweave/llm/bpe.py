"""Byte-level BPE by merge replay over the words of many documents at once.

Texts are cut by the vocabulary's pattern. The distinct new words of an Arrow
batch form one corpus: their bytes lie in one linked list, and an inverted
index leads from the rank of a token pair to all positions where the pair
stands. Ranks are applied in order, all places of a rank at once; a merge touches only
its two neighbours, whose new pairs enter the index. A pair's rank is that of
its joined bytes, so a word gets what merging it alone, lowest rank first and
leftmost first, gives; words in which that order matters inside one rank
(places that touch, a new pair of lower rank) are finished one by one.

Work is per partition, without a shuffle. Words already encoded by a task are
kept up to ``CACHE`` of them, then forgotten; memory does not grow with the data.

Defined cases: a NULL text is an empty one and has no ids; repeated rows are
encoded alike; input columns are kept but for those named like a result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words whose ids a task remembers.
CACHE = 200_000
#: Bytes of text whose new words are encoded together, and whose ids are put together at a time.
WORDS_OF, ASSEMBLE = 6 << 20, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class MergeReplay:
    """Encodes sets of words with one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        pairs = {
            ranks[t[:k]] << 32 | ranks[t[k:]]: r
            for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        }
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of joined tokens; -1 where one is missing or they never merge."""
        if not len(self.pair_keys):
            return np.full(len(left), -1)
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of every word. Words that are tokens themselves need no merges."""
        whole = [self.ranks.get(w) for w in words]
        open_words = [w for w, t in zip(words, whole, strict=True) if t is None]
        merged = iter(self.replay(open_words))
        return [next(merged) if t is None else (t,) for t in whole]

    def token_table(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens by id, joined, and where each begins (with the end)."""
        tokens = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in tokens])))

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # a blank place ends every word
        symbol = self.single.astype(np.int32)[np.frombuffer(b"\0".join([*words, b""]), np.uint8)]
        symbol[starts[1:] - 1] = -1
        pair = np.concatenate((self.rank_of(symbol[:-1], symbol[1:]), [-1])).astype(np.int32)
        after = np.arange(1, len(symbol) + 1, dtype=np.int32)
        before = np.arange(-1, len(symbol) - 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(ranks: np.ndarray, places: np.ndarray) -> None:
            """Add places to the index; a rank that was not in it enters the queue."""
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1], [True]))).tolist()
            for r, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(queue, r)

        live = np.flatnonzero(pair >= 0).astype(np.int32)
        if len(live):
            put(pair[live], live)
        while queue:
            rank = heapq.heappop(queue)
            of = index.pop(rank)
            places = np.sort(np.concatenate(of)) if len(of) > 1 else of[0]
            places = places[pair[places] == rank]  # others have lost one of their tokens
            if not len(places):
                continue
            second = after[places]
            right, left = after[second], before[places]
            new_right = self.rank_of(np.full(len(places), rank), symbol[right])
            new_left = self.rank_of(np.where(left >= 0, symbol[left], -1), np.full(len(places), rank))
            # Places that touch each other, or a merge that opens a lower rank: there the order inside the word matters.
            hard = (pair[second] == rank) | (pair[right] == rank)
            hard |= ((new_right >= 0) & (new_right < rank)) | ((new_left >= 0) & (new_left < rank))
            if hard.any():
                word = np.searchsorted(starts, places, side="right") - 1
                finished = np.unique(word[hard])
                for w in finished.tolist():
                    self.finish(symbol, pair, int(starts[w]), int(starts[w + 1]) - 1)
                easy = ~np.isin(word, finished)
                places, second, right, left = places[easy], second[easy], right[easy], left[easy]
                new_right, new_left = new_right[easy], new_left[easy]
            symbol[places], symbol[second], pair[second] = rank, -2, -1
            after[places], before[right] = right, places
            pair[places] = new_right
            has_left = left >= 0
            pair[left[has_left]] = new_left[has_left]
            ranks = np.concatenate((new_right, new_left))
            keep = ranks >= 0
            if keep.any():
                put(ranks[keep], np.concatenate((places, left))[keep])
        kept = symbol >= 0
        ids, counts = symbol[kept].tolist(), np.add.reduceat(kept, starts[:-1]).tolist()
        ends = np.cumsum(counts).tolist()
        return [tuple(ids[e - n:e]) for e, n in zip(ends, counts, strict=True)]

    def finish(self, symbol: np.ndarray, pair: np.ndarray, start: int, end: int) -> None:
        """Merge one word to its end, lowest rank first and leftmost first, with a queue of its own pairs."""
        tokens = [s for s in symbol[start:end].tolist() if s >= 0]
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        join = lambda a, b: self.ranks.get(self.tokens[tokens[a]] + self.tokens[tokens[b]], -1)
        queue = [(r, i) for i in range(len(tokens) - 1) if (r := join(i, i + 1)) >= 0]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if tokens[i] < 0 or j >= len(tokens) or join(i, j) != rank:
                continue
            tokens[i], tokens[j] = rank, -1
            after[i] = n = after[j]
            if n < len(tokens):
                before[n] = i
                if (r := join(i, n)) >= 0:
                    heapq.heappush(queue, (r, i))
            p = before[i]
            if p >= 0 and (r := join(p, i)) >= 0:
                heapq.heappush(queue, (r, p))
        symbol[start:end], pair[start:end] = -2, -1
        done = [t for t in tokens if t >= 0]
        symbol[start:start + len(done)] = done


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def gather(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat``, joined, and their lengths."""
    lengths = starts[which + 1] - starts[which]
    shift = starts[which] - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(lengths.sum())], lengths


def joined(lengths: np.ndarray, groups: np.ndarray, kind) -> np.ndarray:
    """Offsets of groups of runs: ``groups`` are the counts of runs per group."""
    sums = np.concatenate(([0], np.cumsum(lengths)))
    return sums[np.concatenate(([0], np.cumsum(groups)))].astype(kind)


class Encoder:
    """Encodes slices of texts; remembers the words it has met, up to ``CACHE``."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        self.cut, self.replay = regex.compile(pattern), MergeReplay(read_ranks(ranks_path))
        self.bytes, self.byte_starts = self.replay.token_table()
        self.forget()

    def forget(self) -> None:
        self.words = Numbers()
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def number(self, texts: list[str | None]) -> list[np.ndarray]:
        """The words of every text as numbers; words not met before are encoded together."""
        if len(self.words) > CACHE:
            self.forget()
        known, number = len(self.words), self.words.__getitem__
        numbers = []
        for text in texts:
            words = self.cut.findall(text or "")
            numbers.append(np.fromiter(map(number, words), np.int32, len(words)))
        new = self.replay.encode([w.encode() for w in islice(self.words, known, None)])
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum([len(i) for i in new], dtype=np.int64)))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(new), np.int32)))
        return numbers

    def assemble(self, numbers: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
        """Lists of ids, and the bytes that they stand for."""
        counts = np.array([len(n) for n in numbers])
        ids, lengths = gather(self.flat, self.starts, np.concatenate(numbers))
        at = joined(lengths, counts, np.int32)
        data, sizes = gather(self.bytes, self.byte_starts, ids)
        ends = joined(sizes, np.diff(at), np.int32)
        decoded = pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        return pa.ListArray.from_arrays(pa.array(at), pa.array(ids)), decoded


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids array<int>`` and ``decoded binary``, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, pattern)
        for batch in batches:
            column = batch.schema.get_field_index(text)
            kept = [n for n in batch.schema.names if n not in ("ids", "decoded")]
            for part in slices(batch, column, WORDS_OF):
                numbers, at = encoder.number(part.column(column).to_pylist()), 0
                for few in slices(part, column, ASSEMBLE):
                    done = encoder.assemble(numbers[at:at + few.num_rows])
                    at += few.num_rows
                    yield pa.RecordBatch.from_arrays([*[few.column(n) for n in kept], *done], names=[*kept, "ids", "decoded"])

    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{schema}, ids array<int>, decoded binary")


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text; a longer text is alone."""
    start = size = 0
    for i, value in enumerate(batch.column(column)):
        n = len(value.as_buffer()) if value.is_valid else 0
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)
