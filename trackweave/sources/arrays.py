"""Large JSON array files, read in parallel: records are found per byte range.

Spark's text source splits a file at ``}`` into pieces, and the file into byte
ranges. A piece's meaning depends on what stands before it: whether a string is
open and how many braces are. So files are read twice:

1. Per byte range, its effect is computed for both beginnings (a string open or
   not): a change of depth, and a floor that closing braces cannot go below. One
   row per range; walking a file's rows in order gives each range its beginning.
2. Every range emits the records that lie in it, and the fragments at its two
   ends, which are joined with those of the next ranges.

Defined cases: a record is an object that no other object holds, with or without
an array around it; nested objects and braces in strings belong to it. A record
that is no valid JSON is a reject. Where a whole file's quotes or braces do not
balance (an object cut off, a quote lost), what stands before cannot be trusted:
there a record begins at every ``{`` that follows, but for white space, a bracket
at the file's start or a brace with a comma or line break, so that only broken
records are rejects; objects nested in arrays are cut apart in such files. Errors that cancel each other join the records between
them to one reject. A last record cut off after a complete value is kept.
Files are UTF-8; a byte order mark, empty files and any white space are allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trackweave.operators.cleaning import drop_notices
from trackweave.schemas import RAW_LISTING
from trackweave.session import materialize
from trackweave.sources.listings import impose_schema

ESCAPE = re.compile(rb"\\.", re.DOTALL)
BEGINS = re.compile(rb"^(\xef\xbb\xbf)?\s*[\[,\n]\s*\{")
END = re.compile(rb"^[\s\],]+$")

RANGE = "file string, block long, length long"
EFFECT = f"{RANGE}, flips boolean, floor_out long, change_out long, floor_in long, change_in long"
STATE = f"{RANGE}, in_string boolean, depth long, loose boolean, last boolean"
FOUND = "file string, block long, kind string, record binary"
ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = [pa.array(c, ARROW[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def outside(piece: bytes, in_string: bool) -> tuple[bool, int, int]:
    """Of a piece up to a ``}``: whether a string is open at its end, how many braces it opens, and where the first is."""
    parts = (ESCAPE.sub(b"..", piece) if b"\\" in piece else piece).split(b'"')
    opens, first, at = 0, -1, 0
    for i, part in enumerate(parts):
        if (i % 2 == 1) == in_string and (n := part.count(b"{")):
            opens += n
            if first < 0:
                first = at + part.find(b"{")
        at += len(part) + 1
    return in_string ^ (len(parts) % 2 == 0), opens, first


def _runs(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[tuple, list[bytes]]]:
    """Pieces with the values of ``columns`` they share, a list at a time, in order."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        values, at = batch.column("value").to_pylist(), 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                yield keys[at], values[at:i]
                at = i


def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: every byte range as a function of how it begins, a row per range and task."""

    class Effect:
        def __init__(self):
            self.state, self.floor, self.change = [False, True], [0, 0], [0, 0]

        def add(self, piece: bytes) -> None:
            for begin in (0, 1):
                self.state[begin], opens, _ = outside(piece, self.state[begin])
                step = opens - (not self.state[begin])
                self.floor[begin] = max(0, self.floor[begin] + step)
                self.change[begin] += step

    found: dict[tuple, Effect] = {}
    for key, pieces in _runs(batches, ["file", "block", "length"]):
        effect = found.setdefault(key, Effect())
        for piece in pieces:
            effect.add(piece)
    if found:
        yield _batch([(*k, e.state[0], e.floor[0], e.change[0], e.floor[1], e.change[1]) for k, e in found.items()], EFFECT)


def walk(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state at the beginning of every range of a file; loose where the file does not end as it began."""
    rows, in_string, depth = [], False, 0
    for r in ranges.sort_values("block").itertuples():
        rows.append((r.file, r.block, r.length, in_string, depth))
        floor, change = (r.floor_in, r.change_in) if in_string else (r.floor_out, r.change_out)
        in_string, depth = in_string ^ r.flips, max(floor, depth + change)
    # The last piece has no brace behind it, which was counted as one: at depth 0 that changes nothing.
    states = pd.DataFrame(rows, columns=["file", "block", "length", "in_string", "depth"])
    return states.assign(loose=bool(in_string or depth), last=states["block"] == states["block"].max())


class _Range:
    """Cuts the pieces of one byte range into records."""

    def __init__(self, file: str, block: int, _length: int, in_string: bool, depth: int, loose: bool, last: bool):
        self.key, self.in_string, self.depth, self.loose, self.last = (file, block), in_string, depth, loose, last
        self.kind = "head" if loose or depth else None  # of what is being gathered; NULL between records
        self.text: list[bytes] = []

    def flush(self, kind: str) -> Iterator[tuple]:
        if self.text:
            yield (*self.key, "head" if self.kind == "head" else kind, b"".join(self.text))
        self.text = []

    def add(self, piece: bytes) -> Iterator[tuple]:
        if self.loose:
            if begins := BEGINS.match(piece):
                yield from self.flush("record")
                self.kind, piece = "record", piece[begins.end() - 1:]
            self.text.append(piece + b"}")
            return
        self.in_string, opens, first = outside(piece, self.in_string)
        if self.kind is None:
            if not opens:
                return
            self.kind, piece = "record", piece[first:]
        self.text.append(piece + b"}")
        self.depth = max(0, self.depth + opens - (not self.in_string))
        if not self.depth and not self.in_string:
            yield from self.flush("record")
            self.kind = None

    def end(self) -> Iterator[tuple]:
        """What is left goes on in the next range."""
        if self.loose and self.last and self.text and END.match(self.text[-1][:-1]):
            self.text.pop()  # the end of the array, with no brace behind it
        yield from self.flush("tail")


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: records and fragments of every byte range."""
    current, last = None, None
    for key, pieces in _runs(batches, ["file", "block", "length", "in_string", "depth", "loose", "last"]):
        rows = []
        if key != last:
            rows += current.end() if current else []
            current, last = _Range(*key), key
        for piece in pieces:
            rows += current.add(piece)
        if rows:
            yield _batch(rows, FOUND)
    if current and (rows := list(current.end())):
        yield _batch(rows, FOUND)


def split_arrays(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file`` and ``record`` (text) of every record in JSON array files; a file is read by many tasks."""
    paths = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    pieces = spark.read.option("lineSep", "}").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"), F.col("value").cast("binary").alias("value"),
    )
    key = ["file", "block", "length"]
    states = materialize(pieces.mapInArrow(effects, EFFECT).groupBy("file").applyInPandas(walk, STATE), "ranges")
    # A range's pieces are in one task, in order; the sort keeps that so, whichever join Spark takes.
    numbered = pieces.withColumn("n", F.monotonically_increasing_id()).join(states, key, "left").withColumn(
        "loose", F.coalesce("loose", F.raise_error(F.lit("byte ranges changed between two scans; run it again")).cast("boolean"))
    )
    found = materialize(numbered.sortWithinPartitions(*key, "n").drop("n").mapInArrow(records, FOUND), "records")
    # A fragment goes to the last range before it in which a record began: the fragments of one record are a group.
    before = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.max(F.when(F.col("kind") == "tail", F.col("block"))).over(before)
    joined = found.filter("kind <> 'record'").withColumn("owner", owner).groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("block", F.col("record").cast("string").alias("text")))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    whole = found.filter("kind = 'record'").select("file", F.col("record").cast("string").alias("record"))
    return whole.unionByName(joined.select("file", text.alias("record")))


def read_array_listings(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Listings of JSON array files with the fixed schema, and rejects: ``file`` and ``record`` of what is no valid JSON."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = split_arrays(spark, paths).select(
        "file", "record", F.from_json("record", f"{RAW_LISTING}, _corrupt string", options).alias("_raw")
    )
    bad = F.col("_raw._corrupt").isNotNull()
    return impose_schema(drop_notices(parsed.filter(~bad).select("_raw.*").drop("_corrupt"))), parsed.filter(bad).select("file", "record")
