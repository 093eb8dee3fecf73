"""Repeated passages by partitioned suffix trees: removal of repeats, and maximal repeats.

A suffix begins at every word that has ``window`` words from it on. Two suffixes
that agree in so many words meet in an inner node of that depth or deeper, and
must meet in one group. The steps:

1. ``split_stretches``: a suffix's group is named by a stretch of its window, the
   one of 4 words with the least hash; where more than ``GROUP`` suffixes have the
   same, by that of 8 words, then by all words of the window. So equal windows
   share a group, and no group outgrows a task. A stretch, not the first words:
   neighbours in a text mostly share the least one, so that they travel as one
   segment, about 3 words of text per suffix instead of a window's 20.
2. Each Arrow batch sends its segments, compressed. Of suffixes that agree to full
   depth a batch sends only its first; the others are known to be repeats
   already. A passage that a third of all rows hold thus costs its group one
   suffix per batch.
3. ``Tree``: the suffixes of a group that share their window with another are
   sorted by their words, with the length of the common prefix of neighbours; inner
   nodes of the suffix tree are the intervals of that array, found with a stack.
   For the removal the tree is cut at the window's depth: of every deep node all
   suffixes but the first, by document and place, are marked. ``maximal_repeats``
   reads deeper trees: a node whose suffixes differ in the word before them too is
   a maximal repeat.
4. Marked starts go back to their documents, whose covered words are removed.

Words are sorted by 32 bits of their fingerprints; that windows are equal is
decided by 64 bits of all their words, as computed from the words that were sent.
Shuffled are about twelve bytes per suffix, and the texts that have repeats.

Defined cases: documents are ordered by id (NULL first), then by a hash of the
text; repeated rows count as one document and get one result. A NULL text has
no words. Other columns are kept; extra names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackweave.llm.sieve import flag_partners
from trackweave.llm.words import INVERSE, BASE, Words, cut, mix, powers, windows
from trackweave.session import materialize

#: Words of a window; a passage of so many words counts as repeated.
WINDOW = 20
#: Lengths of the stretches that name a group, in words; the last is the window.
LEVELS = (4, 8)
#: Suffixes that a stretch may have before it is split.
GROUP = 1_000_000
#: Suffixes that a partition of groups is sized for.
PER_PARTITION = 1_000_000
#: Fewer suffixes of one stretch in a batch are not reported: they cannot fill a group.
REPORT = 16
#: Bytes of text handled at a time, by a slice and by a tree.
SLICE, PIECE = 3 << 20, 1 << 20
#: Words that a maximal repeat is followed to.
DEPTH = 64

SENT = (
    "bucket int, doc_ids binary, hashes binary, counts binary, starts binary, sizes binary, lefts binary, lengths binary, "
    "text binary, bytes int, marked boolean"
)
BACK = "part int, doc_ids binary, hashes binary, counts binary, starts binary"
MARKED = "_id long, _hash int, _starts binary"
REPEAT = "doc_id long, hash int, start int, length int"


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Rows regrouped to about ``limit`` bytes of text; a longer text is in a slice of its own."""
    for batch in batches:
        sizes = batch.column(column).cast(pa.large_binary())
        ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset:sizes.offset + len(sizes) + 1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def least_stretch(hashes: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int, window: int) -> np.ndarray:
    """Of the window at each of ``at``, the least fingerprint of a stretch of ``length`` words."""
    if length >= window:
        raise ValueError("a stretch must be shorter than the window")
    value, where = windows(hashes, doc, length)
    least = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    least[where] = value
    n, size = window - length + 1, 1
    while size < n:  # running minimum over n places, by doubling
        step = min(size, n - size)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least
        size += step
    return least[at]


def suffixes(words: Words, hashes: np.ndarray, window: int):
    """Of every suffix: its first word, the fingerprint of its window and its least stretches."""
    keys, at = windows(hashes, words.doc, window)
    return at, keys, [least_stretch(hashes, words.doc, at, n, window) for n in LEVELS if n < window]


def firsts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first of each key, ascending, and a mask of the others."""
    first = np.sort(np.unique(keys, return_index=True)[1])
    again = np.ones(len(keys), bool)
    again[first] = False
    return first, again


def split_stretches(docs: DataFrame, window: int, group: int) -> tuple[int, list[np.ndarray]]:
    """How many suffixes there are, and per level the stretches that must be split (at most suffixes / group)."""
    levels = sum(n < window for n in LEVELS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for part in slices(batches, 0):
            words = cut(part.column(0))
            _, keys, stretches = suffixes(words, words.hashes(), window)
            total += len(keys)
            first, _ = firsts_of(keys)
            for level, stretch in enumerate(stretches):
                value, n = np.unique(stretch[first], return_counts=True)
                often = n >= REPORT
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(int(often.sum()), level, np.int32)), pa.array(value[often].view(np.int64)),
                    pa.array(n[often].astype(np.int64)),
                ], names=["level", "stretch", "n"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([total], pa.int64())],
            names=["level", "stretch", "n"],
        )

    found = docs.select("text").mapInArrow(count, "level int, stretch long, n long").groupBy("level", "stretch").agg(
        F.sum("n").alias("n")
    ).filter((F.col("level") < 0) | (F.col("n") > group)).collect()
    total = sum(r.n for r in found if r.level < 0)
    return total, [
        np.sort(np.array([r.stretch for r in found if r.level == level], np.int64).view(np.uint64))
        for level in range(levels)
    ]


def holds(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def route(stretches: list[np.ndarray], keys: np.ndarray, split: list[np.ndarray], buckets: int) -> np.ndarray:
    """The group of every suffix, from its shortest stretch that is not split."""
    value, open_ = keys, np.ones(len(keys), bool)
    for stretch, table in zip(stretches, split, strict=True):
        whole = open_ & ~holds(table, stretch)
        value = np.where(whole, stretch, value)
        open_ &= ~whole
    return ((value >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def ordered_batch(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ids (NULL as the smallest), hashes and texts, sorted by both and without repeated rows."""
    ids = part.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    hashes = part.column(1).to_numpy(zero_copy_only=False)
    order = np.lexsort((hashes, ids))
    ids, hashes = ids[order], hashes[order]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])))
    return ids[new], hashes[new], part.column(2).take(pa.array(order[new]))


def context(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the words from ``begin`` to before ``end``, of any length."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(BASE, len(hashes)), out=sums[1:])
    return mix((sums[end] - sums[begin]) * powers(INVERSE, len(hashes) + 1)[begin] + (end - begin).astype(np.uint64))


def send(window: int, split: list[np.ndarray], buckets: int, depth: int):
    """The map side of step 2. Beyond the window's depth, segments also have the word before, and repeats are sent twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.split() for x in SENT.split(", ")]
        kinds = {"int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
        for part in slices(batches, 2):
            ids, hashes, texts = ordered_batch(part)
            words = cut(texts)
            codes = words.hashes()
            at, keys, stretches = suffixes(words, codes, window)
            doc, rows = words.doc[at], []
            if depth == window:
                first, again = firsts_of(keys)
                known = np.flatnonzero(again)
                if len(known):  # repeats inside the batch, passed on as they are
                    packed = documents(ids, hashes, doc[known])
                    rows.append((int(ids[doc[known[0]]] % buckets), *packed, short(at[known] - words.first[doc[known]]), *[b""] * 4, 0, True))
            else:
                begin, end = np.maximum(at - 1, words.first[doc]), np.minimum(at + depth, words.first[doc + 1])
                seen = context(codes, begin, end) ^ (begin == at).astype(np.uint64)
                once, again = firsts_of(seen)
                rest = np.flatnonzero(again)
                first = np.sort(np.concatenate((once, rest[firsts_of(seen[rest])[0]])))
            group = route([x[first] for x in stretches], keys[first], split, buckets)
            order = np.argsort(group, kind="stable")
            group, at, doc = group[order], at[first[order]], doc[first[order]]
            # Segments: runs of neighbours with one group.
            new = np.ones(len(at) + 1, bool)
            new[1:-1] = (group[1:] != group[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
            edge = np.flatnonzero(new)
            head, size = edge[:-1], np.diff(edge)
            begin, doc, group = at[head], doc[head], group[head]
            left = ((depth > window) & (begin > words.first[doc])).astype(np.int64)
            end = np.minimum(begin + size - 1 + depth, words.first[doc + 1])
            from_byte, to_byte = words.starts[begin - left], words.ends[end - 1]
            present, cuts = np.unique(group, return_index=True)
            for b, mine in zip(present.tolist(), np.split(np.arange(len(head)), cuts[1:]), strict=False):  # the groups this slice has
                lengths = to_byte[mine] - from_byte[mine]
                place = np.repeat(from_byte[mine] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                text = words.data[place].tobytes()
                rows.append((
                    b, *documents(ids, hashes, doc[mine]), short(begin[mine] - words.first[doc[mine]]), short(size[mine]),
                    left[mine].astype("u1").tobytes() if depth > window else b"", short(lengths),
                    pa.compress(text, "zstd", asbytes=True), len(text), False,
                ))
            for one in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows[one:one + 64], strict=True), fields, strict=True)],
                    names=[name for name, _ in fields],
                )

    return run


def documents(ids, hashes, doc) -> tuple[bytes, bytes, bytes]:
    """Documents in order, and how often each comes."""
    which, counts = np.unique(doc, return_counts=True)
    return ids[which].astype("<i8").tobytes(), hashes[which].astype("<i4").tobytes(), short(counts)


def short(numbers: np.ndarray) -> bytes:
    """Two bytes each where all fit, else four."""
    return numbers.astype("<u4" if len(numbers) and numbers.max() > 65535 else "<u2").tobytes()


def unshort(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.int64)


def unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id, hash and start of every suffix of a row."""
    ids, hashes = np.frombuffer(row.doc_ids, "<i8"), np.frombuffer(row.hashes, "<i4")
    counts = unshort(row.counts, len(ids))
    return np.repeat(ids, counts), np.repeat(hashes, counts), unshort(row.starts, int(counts.sum()))


def documents_of(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Edges of the runs of one document, with the end."""
    return np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]), [True])))


class Tree:
    """The suffixes of a group that share their window with another, in the order of their words."""

    def __init__(self, rows: pd.DataFrame, window: int, depth: int):
        self.window, self.depth = window, depth
        keys, segment, nth, codes, heads, first, self.ends = self.read(rows)
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        shared = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(order) else order
        del order, same
        keys, segment, nth = keys[shared], segment[shared], nth[shared].astype(np.int64)
        at = first[segment] + nth
        self.ids, self.hashes, self.starts = (x[segment] for x in heads[:3])
        self.starts = self.starts + nth
        # The word before, as a number above 0; 0 where there is none.
        has = (nth > 0) | (heads[3][segment] > 0)
        self.before = np.where(has, codes[np.maximum(at - 1, 0)].astype(np.int64) + 1, 0) if len(at) else at
        # Words to full depth; a suffix that ends before has fewer, and its end equals nothing.
        end = self.ends[segment]
        self.lengths = np.minimum(end - at, depth)
        place = at[:, None] + np.arange(depth)
        matrix = np.where(place < end[:, None], codes[np.minimum(place, max(len(codes) - 1, 0))], 0).astype(np.uint32) if len(at) else (
            np.zeros((0, depth), np.uint32))
        del place
        order = np.lexsort((self.starts, self.hashes, self.ids, keys, *matrix.T[::-1]))
        matrix, keys = matrix[order], keys[order]
        for name in ("ids", "hashes", "starts", "lengths", "before"):
            setattr(self, name, getattr(self, name)[order])
        self.common = self.prefixes(matrix, keys)

    def read(self, rows: pd.DataFrame):
        """Of every suffix its key, segment and place there; all words; of segments document, place, first word and end."""
        keys, segment, nth, codes, heads, first, ends = [], [], [], [], [], [], []
        n_words = n_segments = 0
        for texts, row_ids, row_hashes, row_starts, row_sizes, row_lefts in pieces(rows):
            words = cut(texts)
            full = words.hashes()
            of = np.repeat(np.arange(len(row_sizes)), row_sizes)
            place = np.arange(len(of)) - np.repeat(np.cumsum(row_sizes) - row_sizes, row_sizes)
            begin = words.first[:-1] + row_lefts
            value, where = windows(full, words.doc, self.window)
            keys.append(value[np.searchsorted(where, begin[of] + place)])
            segment.append((of + n_segments).astype(np.int32))
            nth.append(place.astype(np.int32))
            codes.append((full >> np.uint64(32)).astype(np.uint32))
            heads.append((row_ids, row_hashes, row_starts, row_lefts))
            first.append(begin + n_words)
            ends.append(words.first[1:] + n_words)
            n_words, n_segments = n_words + len(full), n_segments + len(row_sizes)
        joined = [np.concatenate(x) for x in (keys, segment, nth, codes)]
        return *joined, [np.concatenate(x) for x in zip(*heads, strict=True)], np.concatenate(first), np.concatenate(ends)

    def prefixes(self, matrix: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Words that each suffix has in common with the one before it."""
        if not len(matrix):
            return np.zeros(0, np.int64)
        differs = matrix[1:] != matrix[:-1]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), self.depth)
        common = np.minimum(common, np.minimum(self.lengths[1:], self.lengths[:-1]))
        common[keys[1:] != keys[:-1]] = np.minimum(common[keys[1:] != keys[:-1]], self.window - 1)
        return np.concatenate(([0], common))

    def later(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every node as deep as the window (an interval, as nothing is deeper), all suffixes but the first occurrence."""
        node = np.cumsum(self.common < self.window)
        order = np.lexsort((self.starts, self.hashes, self.ids, node))
        ids, hashes, starts, node = self.ids[order], self.hashes[order], self.starts[order], node[order]
        head = np.searchsorted(node, node)
        later = (ids != ids[head]) | (hashes != hashes[head]) | (starts != starts[head])
        return ids[later], hashes[later], starts[later]

    def nodes(self) -> Iterator[tuple[int, int, int]]:
        """Inner nodes at least as deep as the window: depth, first suffix and one beyond the last."""
        stack: list[tuple[int, int]] = []
        for i, depth in enumerate([*self.common.tolist(), 0]):
            begin = i - 1
            while stack and stack[-1][0] > depth:
                deep, begin = stack.pop()
                yield deep, begin, i
            if depth >= self.window and (not stack or stack[-1][0] < depth):
                stack.append((depth, begin))

    def maximal(self) -> list[tuple[int, int, int, int]]:
        """The first occurrence of every repeat that no word before or behind extends, with its length."""
        out = []
        for depth, a, b in self.nodes():
            at = {(self.ids[i], self.hashes[i], self.starts[i]): self.before[i] for i in range(a, b)}
            before = set(at.values())
            if len(at) > 1 and (len(before) > 1 or 0 in before):
                out.append((*map(int, min(at)), depth))
        return out


def pieces(rows: pd.DataFrame):
    """Segments of a group, about ``PIECE`` bytes of text at a time: texts, documents, places, suffixes, words before."""
    some, size = [], 0
    for row in rows.itertuples():
        some.append(row)
        size += row.bytes
        if size >= PIECE:
            yield segments(some)
            some, size = [], 0
    if some:
        yield segments(some)


def segments(rows: list):
    ids, hashes, starts = (np.concatenate(x) for x in zip(*map(unpacked, rows), strict=True))
    n = [len(unpacked(row)[0]) for row in rows]
    sizes, lengths = (np.concatenate([unshort(getattr(row, c), k) for row, k in zip(rows, n, strict=True)]) for c in ("sizes", "lengths"))
    lefts = np.concatenate([np.frombuffer(row.lefts, "u1") if row.lefts else np.zeros(k, "u1") for row, k in zip(rows, n, strict=True)])
    data = b"".join(pa.decompress(row.text, row.bytes, "zstd", asbytes=True) for row in rows)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))
    return texts, ids, hashes, starts, sizes, lefts.astype(np.int64)


def subtree(parts: int, window: int):
    """Step 3 of the removal. Marks are sent on by document, a row per part of the documents."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = [unpacked(row) for row in group[group.marked].itertuples()]
        sent = group[~group.marked]
        if len(sent):
            out.append(Tree(sent, window, window).later())
        rows = []
        if out:
            ids, hashes, starts = (np.concatenate(x) for x in zip(*out, strict=True))
            part = part_of(ids, hashes, parts)
            order = np.lexsort((starts, hashes, ids, part))
            ids, hashes, starts, part = ids[order], hashes[order], starts[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                a, b = cuts[p], cuts[p + 1]
                if a < b:
                    edge = documents_of(ids[a:b], hashes[a:b])
                    rows.append((
                        p, ids[a:b][edge[:-1]].tobytes(), hashes[a:b][edge[:-1]].tobytes(), short(np.diff(edge)), short(starts[a:b])
                    ))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in BACK.split(", ")])

    return run


def part_of(ids: np.ndarray, hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) ^ (hashes.astype(np.uint64) << np.uint64(32))) % np.uint64(parts)).astype(np.int64)


def gather(group: pd.DataFrame) -> pd.DataFrame:
    """All marked starts of every document of a part, ascending."""
    ids, hashes, starts = (np.concatenate(x) for x in zip(*map(unpacked, group.itertuples()), strict=True))
    order = np.lexsort((starts, hashes, ids))
    ids, hashes, starts = ids[order], hashes[order], starts[order]
    edge = documents_of(ids, hashes)
    return pd.DataFrame({
        "_id": ids[edge[:-1]], "_hash": hashes[edge[:-1]],
        "_starts": [starts[a:b].astype("<u4").tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)],
    })


def remove(window: int):
    """Step 4: texts with the starts of their repeated windows to the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, marks in zip(texts, batch.column("_starts"), strict=True):
                words = (text or b"").split()  # bytes: splits at the six ASCII blanks only
                n_words.append(len(words))
                if marks.is_valid:
                    edges = np.zeros(len(words) + 1, np.int32)
                    every = np.frombuffer(marks.as_buffer(), "<u4")
                    np.add.at(edges, every, 1)
                    np.add.at(edges, every + window, -1)
                    stays = np.cumsum(edges[:-1]) == 0
                    words = list(compress(words, stays.tolist()))
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            rest = [n for n in batch.schema.names if n != "_starts"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in rest], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*rest, "n_words", "n_removed", "kept"],
            )

    return run


def grouped(docs: DataFrame, window: int, group: int, per_partition: int, depth: int) -> DataFrame:
    """Steps 1 and 2: the segments of all suffixes, in partitions of groups."""
    doc_id, doc_hash = F.coalesce(F.col("doc_id").cast("long"), F.lit(np.iinfo(np.int64).min)), F.hash("text")
    total, split = split_stretches(docs, window, group)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-total // per_partition), min(parts, -(-total // (per_partition // 8))))
    keyed = docs.select(doc_id.alias("id"), doc_hash.alias("hash"), "text")
    return keyed.mapInArrow(send(window, split, buckets, depth), SENT).repartition(buckets, "bucket").groupBy("bucket")


def maximal_repeats(
    docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, group: int = GROUP, per_partition: int = PER_PARTITION
) -> DataFrame:
    """doc_id, start, length of the first occurrence of every maximal repeat of ``window`` words or more.

    A repeat is maximal if neither the word before nor the word behind is the
    same at all its occurrences; a document's ends equal nothing. Repeats are
    followed to ``depth`` words: a length of ``depth`` means so many or more.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(Tree(rows, window, depth).maximal(), columns=[x.split()[0] for x in REPEAT.split(", ")])

    found = grouped(docs, window, group, per_partition, max(depth, window + 1)).applyInPandas(run, REPEAT)
    lowest = F.lit(np.iinfo(np.int64).min)
    return found.select(F.when(F.col("doc_id") != lowest, F.col("doc_id")).alias("doc_id"), "start", "length")


def remove_repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP, per_partition: int = PER_PARTITION) -> DataFrame:
    """Add n_words, n_removed and ``kept`` (the words that stay, joined by one space) to ``docs`` (doc_id, text, ...)."""
    lowest = F.lit(np.iinfo(np.int64).min)
    doc_id, doc_hash = F.coalesce(F.col("doc_id").cast("long"), lowest), F.hash("text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    back = grouped(docs, window, group, per_partition, window).applyInPandas(subtree(parts, window), BACK)
    lists = materialize(back.groupBy("part").applyInPandas(gather, MARKED), "repeats")
    # Texts without a mark need no partner and are not shuffled.
    flagged = flag_partners(docs, F.xxhash64(doc_id, doc_hash), lists, F.xxhash64("_id", "_hash"), "_maybe")
    joined = flagged.filter("_maybe").drop("_maybe").join(
        lists, (doc_id == F.col("_id")) & (doc_hash == F.col("_hash")), "left"
    ).drop("_id", "_hash")
    rest = flagged.filter("NOT _maybe").drop("_maybe").withColumn("_starts", F.lit(None).cast("binary"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.unionByName(rest).mapInArrow(remove(window), f"{schema}, n_words long, n_removed long, kept string")


def substring_stage(docs: DataFrame) -> DataFrame:
    """Documents with repeated passages removed; texts without any stay as they are."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]).alias("_rest")
    done = remove_repeats(docs.select("doc_id", "text", rest))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    own = {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("_rest.n_chars"))
    return done.select(*[own.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns])
