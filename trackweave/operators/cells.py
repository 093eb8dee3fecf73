"""Approximate search: cells around centres on the unit sphere, stored as partitions.

A query reads only the partitions of its nearest cells and ranks their chunks
exactly. Probing every cell gives the exact result. New chunks are assigned to
the stored centres and appended.

Where many queries meet many chunks, neither is copied more than a few times: a
small set of queries goes to blocks of chunks by a shuffle, a large one meets
packs of chunks that are written once and read by every task that needs them.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trackweave.functions.vectors import has_dimension, norm, vectors_to_matrix
from trackweave.operators.keyed import join_hot
from trackweave.operators.search import (
    _least_salaries, _PartitionTopK, _unit_rows, best_ranked, filter_columns, search, winner_batch, winner_schema,
)
from trackweave.schemas import SEARCH_LIMIT
from trackweave.session import materialize

NO_CELL = -1  # vectors without direction: zero, non-finite, or of the wrong length
# Chunks that one task ranks, and queries that it ranks them for.
CHUNK_BLOCK, QUERY_BLOCK = 200_000, 4096
# Slack for the rounding of angles, far above it.
MARGIN = 1e-6
# Where all chunks meet all queries: bytes of vectors in a block, chunks in the smallest, and tasks.
BLOCK_BYTES, FINEST, MOST_TASKS = 64 << 20, 4096, 20_000
# Copies of a chunk, on average, that may be shuffled to blocks of queries. Where more would be needed, chunks are packed
# (bytes of vectors in a pack) and a task reads packs of so many chunks for one pack of queries.
MOST_COPIES, PACK_BYTES, GROUP_ROWS = 3, 4 << 20, 2_000_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@dataclass(frozen=True)
class CellIndex:
    """Chunks with their cell, and the cell centres (few, so on the driver)."""

    chunks: DataFrame
    centers: np.ndarray

    def nearest(self, query: Sequence[float], probes: int) -> list[int]:
        """The ``probes`` cells nearest to the query; all of them include NO_CELL."""
        return nearest_cells(self.centers, np.asarray([query], dtype=np.float64), probes)[0]


def nearest_cells(centers: np.ndarray, queries: np.ndarray, probes: int) -> list[list[int]]:
    """Per query its nearest cells by cosine, ties to the lower number."""
    if probes >= len(centers):
        return [[NO_CELL, *range(len(centers))]] * len(queries)
    lengths = np.linalg.norm(centers, axis=1)
    units = centers / np.where(lengths > 0, lengths, np.inf)[:, None]
    scores = np.round(queries @ units.T / np.maximum(np.linalg.norm(queries, axis=1), 1e-300)[:, None], 12)
    if probes == 1 and not np.isnan(scores).any():
        return np.argmax(scores, axis=1)[:, None].tolist()
    return np.argsort(-scores, axis=1, kind="stable")[:, :probes].tolist()


def directed(dim: int) -> Column:
    """The vector has its length, finite elements, and is not zero."""
    length = norm(F.col("embedding"))
    return has_dimension(F.col("embedding"), dim) & F.coalesce((length > 0) & (length < float("inf")), F.lit(False))


def fit_centers(chunks: DataFrame, cells: int, dim: int, seed: int = 7) -> np.ndarray:
    """k-means centres over all vectors with a direction."""
    vectors = chunks.filter(directed(dim)).select(array_to_vector("embedding").alias("_vector"))
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine", featuresCol="_vector").fit(vectors)
    return np.array(model.clusterCenters())


def assign_cells(chunks: DataFrame, centers: np.ndarray) -> DataFrame:
    """Add the cell of every chunk: the nearest centre, or NO_CELL."""
    dim, types = centers.shape[1], chunks.withColumn("cell", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column("_directed").to_numpy(zero_copy_only=False).astype(bool)
            cell = np.full(len(good), NO_CELL, dtype=np.int32)
            if good.any():
                vectors, _ = vectors_to_matrix(batch.column("embedding"), dim)
                cell[good] = [found[0] for found in nearest_cells(centers, vectors[good], 1)] if len(centers) > 1 else 0
            kept = batch.drop_columns(["_directed"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell)], names=[*kept.schema.names, "cell"])

    return chunks.drop("cell").withColumn("_directed", directed(dim)).mapInArrow(run, types)


def build_cells(
    chunks: DataFrame, cells: int, dim: int, seed: int = 7, centers: Sequence[Sequence[float]] | None = None
) -> CellIndex:
    """Assign every chunk to the nearest of the given centres, or of centres fitted on all vectors."""
    middle = fit_centers(chunks, cells, dim, seed) if centers is None else np.array(centers, dtype=np.float64)
    return CellIndex(assign_cells(chunks, middle), middle)


def write_cells(index: CellIndex, path: str) -> None:
    """Store the chunks partitioned by cell; a crowded cell is split over many files."""
    index.chunks.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/chunks")
    spark = index.chunks.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(index.centers)]
    spark.createDataFrame(rows, "cell int, center array<double>").write.parquet(f"{path}/centers")


def add_chunks(spark: SparkSession, path: str, chunks: DataFrame) -> None:
    """Assign new chunks to the stored centres and append them."""
    centers = read_cells(spark, path).centers
    assign_cells(chunks, centers).hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{path}/chunks")


def read_cells(spark: SparkSession, path: str) -> CellIndex:
    """Open stored cells; searches prune the partitions not probed."""
    rows = sorted(spark.read.parquet(f"{path}/centers").collect(), key=lambda row: row["cell"])
    return CellIndex(spark.read.parquet(f"{path}/chunks"), np.array([row["center"] for row in rows]))


def search_cells(
    index: CellIndex,
    postings: DataFrame,
    query: Sequence[float],
    k: int = SEARCH_LIMIT,
    probes: int = 4,
    **filters,
) -> DataFrame:
    """Like :func:`search`, over the nearest cells only."""
    cells = index.nearest(query, probes)
    return search(index.chunks.filter(F.col("cell").isin(cells)), postings, query, k, **filters)


def sample_centers(chunks: DataFrame, cells: int, dim: int) -> list[list[float]]:
    """Centres without a fit: the vectors of ``cells`` chunks, chosen by a hash of their key. For exact searches any will do."""
    key = F.xxhash64("job_id", "chunk_index")
    rows = chunks.filter(directed(dim)).select(key.alias("_h"), "embedding").orderBy("_h", "embedding").limit(cells).collect()
    return [r["embedding"] for r in rows]


def cell_radii(index: CellIndex) -> dict[int, float]:
    """Of every cell with chunks, the largest angle between its centre and a chunk: one pass, a row per task and cell."""
    units = _unit_rows(index.centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, float] = {}
        for batch in batches:
            cell = batch.column(0).to_numpy()
            units_of = _unit_rows(vectors_to_matrix(batch.column(1), units.shape[1])[0])
            for c in np.unique(cell).tolist():
                if c == NO_CELL:
                    least[c] = -1.0
                    continue
                rows = units_of[cell == c]
                least[c] = min(least.get(c, 1.0), float((rows @ units[c]).min()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.float64())], names=["cell", "least"]
        )

    rows = index.chunks.select("cell", "embedding").mapInArrow(run, "cell int, least double").groupBy("cell").agg(
        F.min("least").alias("least")
    ).collect()
    return {r["cell"]: float(np.arccos(np.clip(r["least"], -1.0, 1.0))) for r in rows}


def _per_query(queries: DataFrame) -> list[str]:
    return ["remote_only", "min_salary"] if {"remote_only", "min_salary"} <= set(queries.columns) else []


@dataclass(frozen=True)
class Routes:
    """Queries, a row each, with the ``cells`` that each visits: their vectors are not copied to every cell."""

    queries: DataFrame

    def count(self) -> int:
        """Visits: pairs of a query and a cell."""
        return self.queries.agg(F.sum(F.size("cells"))).first()[0] or 0


def _block_rows(n: int, width: int, spark: SparkSession) -> int:
    """Chunks in a block: bounded in rows and bytes; small tables are cut finer, so that all cores work."""
    return max(1, min(CHUNK_BLOCK, BLOCK_BYTES // (8 * width), max(FINEST, -(-n // spark.sparkContext.defaultParallelism))))


def _block_queries(width: int) -> int:
    return max(1, min(QUERY_BLOCK, BLOCK_BYTES // (8 * width)))


def _block_sets(n: int, width: int) -> int:
    return max(1, -(-n // _block_queries(width)))


@dataclass(frozen=True)
class _Layout:
    """The visited cells in a row, one chunk after the other, cut into parts of ``rows`` chunks; few numbers per cell, on the driver."""

    cells: np.ndarray  # ascending; of each the first and the last part
    first: np.ndarray
    last: np.ndarray
    parts: int

    def visits(self, lists) -> np.ndarray:
        """Queries x cells: who visits which."""
        wanted = [np.asarray(x, dtype=np.int64) for x in lists]
        flat, query = np.concatenate([self.cells[:0], *wanted]), np.repeat(np.arange(len(wanted)), [len(x) for x in wanted])
        there, seen = np.isin(flat, self.cells), np.zeros((len(wanted), len(self.cells)), dtype=bool)
        seen[query[there], np.searchsorted(self.cells, flat[there])] = True
        return seen

    def spans(self) -> Iterator[tuple[int, slice]]:
        """The parts with their cells."""
        for part in range(self.parts):
            yield part, slice(np.searchsorted(self.last, part), np.searchsorted(self.first, part, "right"))


def _meet_in_cells(index: CellIndex, routed: Routes, k: int) -> DataFrame:
    """The k best jobs of every query among the chunks of the cells it is routed to.

    The visited cells stand in a row, one chunk after the other, and this row is
    cut into parts of bounded size: small cells share a part, a crowded cell is
    dealt over several. A query goes once to every part where it visits a cell,
    and a part's chunks once to every block of these queries. Where that would
    copy chunks too often, they are read again instead (:func:`_ranked_packs`).
    """
    extra, spark = _per_query(routed.queries), routed.queries.sparkSession
    asked = materialize(routed.queries, "routed")
    seen = _visited(asked).distinct()
    # One row per cell: how many chunks it has, and how many the cells before it have.
    sizes = index.chunks.groupBy("cell").agg(F.count("*").alias("size")).join(seen, "cell")
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))), "blocks")
    spans = np.array([(r["cell"], r["before"], r["size"]) for r in blocks.collect()], dtype=np.int64).reshape(-1, 3)
    cells, starts, counts = spans[np.argsort(spans[:, 0])].T
    n, width = int(counts.sum()), max(index.centers.shape[1], 1)
    rows, most = _block_rows(n, width, spark), _block_queries(width)
    layout = _Layout(cells, starts // rows, (starts + counts - 1) // rows, max(1, -(-n // rows)))
    place = F.col("before") + F.pmod(F.xxhash64("job_id", "chunk_index"), F.col("size"))
    placed = join_hot(index.chunks.select("cell", *filter_columns(index.chunks, bool(extra))), blocks, ["cell"], "inner").select(
        F.floor(place / rows).cast("int").alias("part"), "cell",
        "job_id", "chunk_index", "embedding", *(["remote", "salary_max"] if extra else []),
    )
    sets = _sets(asked, layout, most)
    if sum(int(x) * min(rows, n - i * rows) for i, x in enumerate(sets)) > MOST_COPIES * n:
        return best_ranked(_ranked_packs(placed, asked, layout, n, width, k), k)
    # A row per part, bounded by the chunks' number over the size of a block.
    dealt = F.broadcast(spark.createDataFrame([(i, int(x)) for i, x in enumerate(sets)], "part int, sets int"))
    chunk_rows = placed.join(dealt, "part").withColumn("set", F.explode(F.sequence(F.lit(0), F.col("sets") - 1))).drop("sets")
    block = F.pmod(F.xxhash64("query_id"), F.col("sets")).cast("int")
    query_rows = _to_parts(asked, layout).join(dealt, "part").withColumn("set", block).drop("sets")
    key, tasks = ["part", "set"], max(1, min(2 * int(sets.sum()), MOST_TASKS))
    return _ranked_blocks(chunk_rows.repartition(tasks, *key), query_rows.repartition(tasks, *key), key, k)


def _visited(asked: DataFrame) -> DataFrame:
    """The cells that occur: a row per cell and batch of queries, not per visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["cell"])

    return asked.select("cells").mapInArrow(run, "cell int")


def _sets(asked: DataFrame, layout: _Layout, most: int) -> np.ndarray:
    """Per part, into how many blocks its queries are cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = layout.visits(batch["cells"])
            asking = [int(seen[:, here].any(axis=1).sum()) for _, here in layout.spans()]
            yield pd.DataFrame({"part": np.arange(layout.parts, dtype=np.int32), "n": asking})

    sets = np.ones(layout.parts, dtype=np.int64)
    counts = asked.select("cells").mapInPandas(run, "part int, n long").groupBy("part").agg(F.sum("n").alias("n"))
    for r in counts.collect():
        sets[r["part"]] = max(1, -(-r["n"] // most))
    return sets


def _to_parts(asked: DataFrame, layout: _Layout) -> DataFrame:
    """A row per query and part where it visits a cell, with these ``cells``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = layout.visits(batch["cells"])
            for part, here in layout.spans():
                query, cell = np.nonzero(seen[:, here])
                asking, starts = np.unique(query, return_index=True)
                if len(asking):
                    some, lists = batch.iloc[asking], np.split(layout.cells[here][cell], starts[1:])
                    yield some.assign(part=part, cells=pd.Series(lists, index=some.index, dtype=object))

    return asked.mapInPandas(run, asked.withColumn("part", F.lit(0)).schema)


def _route(asked: DataFrame, cells_of, columns: list[str]) -> Routes:
    """Every query with its cells; ``cells_of`` gives the cells of a frame of queries, a list each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(cells=pd.Series(cells_of(rows), index=rows.index, dtype=object))[[*columns, "cells"]]

    empty = F.array().cast("array<int>")
    return Routes(asked.mapInPandas(run, asked.select(*columns).withColumn("cells", empty).schema))


def _matrix(rows: pd.DataFrame, dim: int) -> np.ndarray:
    return np.array(rows["embedding"].to_list(), dtype=np.float64).reshape(len(rows), dim)


def search_many_cells(index: CellIndex, queries: DataFrame, k: int = SEARCH_LIMIT, probes: int = 4) -> DataFrame:
    """Like :func:`search_many` for any number of queries, each over its nearest cells only.

    Queries stay a table: each is copied to the blocks of its cells and meets
    the chunks there. Cells and queries are cut into blocks of bounded size; a
    task ranks one block of chunks for one block of queries and emits k jobs
    per query.
    """
    columns = ["query_id", "embedding", *_per_query(queries)]
    asked, centers = materialize(queries.select(*columns), "queries"), index.centers
    routed = _route(asked, lambda rows: nearest_cells(centers, _matrix(rows, centers.shape[1]), probes), columns)
    return _meet_in_cells(index, routed, k)


def reachable_cells(
    centers: np.ndarray, radii: dict[int, float], queries: np.ndarray, floor: np.ndarray, done: list[list[int]]
) -> list[np.ndarray]:
    """Per query the cells, not done yet, that may hold a chunk as near as ``floor`` (NaN: any chunk at all).

    By the triangle inequality no chunk of a cell is nearer to a query, as an
    angle, than the centre less the cell's radius.
    """
    units, to = _unit_rows(queries), _unit_rows(centers)
    with np.errstate(invalid="ignore"):
        angle = np.arccos(np.clip(units @ to.T, -1.0, 1.0))
    known = np.array(sorted(radii), dtype=np.int64)
    cells = known[known != NO_CELL]
    reach = np.array([radii[c] for c in cells.tolist()])
    near = np.cos(np.maximum(0.0, angle[:, cells] - reach)) >= floor[:, None] - MARGIN
    every = np.isnan(floor) | np.isnan(angle).any(axis=1)
    return [
        np.setdiff1d(known if all_of else cells[row], np.array(seen, dtype=np.int64)).astype(np.int32)
        for row, all_of, seen in zip(near, every, done, strict=True)
    ]


def search_many_pruned(
    index: CellIndex, queries: DataFrame, k: int = SEARCH_LIMIT, probes: int = 2, radii: dict[int, float] | None = None
) -> DataFrame:
    """Like :func:`search_many`, exact, for any number of queries, without most of the cells.

    Every query first meets its nearest cells. The similarity of its k-th job
    there is a floor: a cell whose bound (:func:`reachable_cells`) lies below
    it cannot change the result and is not visited. A query with fewer than k
    jobs so far visits all cells. ``radii`` may be kept with a stored index.
    """
    columns = ["query_id", "embedding", *_per_query(queries)]
    asked, centers = materialize(queries.select(*columns), "queries"), index.centers
    radii, dim = cell_radii(index) if radii is None else radii, centers.shape[1]
    near = lambda rows: nearest_cells(centers, _matrix(rows, dim), probes)
    first = materialize(_meet_in_cells(index, _route(asked, near, columns), k), "near")
    floors = first.groupBy("query_id").agg(F.when(F.count("similarity") >= k, F.min("similarity")).alias("floor"))
    rest = _route(
        asked.join(floors, "query_id", "left"),
        lambda rows: reachable_cells(centers, radii, _matrix(rows, dim), rows["floor"].to_numpy(np.float64), near(rows)),
        [*columns, "floor"],
    )
    second = _meet_in_cells(index, rest, k)
    return best_ranked(first.drop("rank").unionByName(second.drop("rank")), k)


def search_many_blocks(chunks: DataFrame, queries: DataFrame, k: int = SEARCH_LIMIT) -> DataFrame:
    """Like :func:`search_many`, exact, for any number of queries.

    Queries stay a table. Chunks and queries are cut into blocks of bounded
    size and each block of the one meets each of the other, one pair of blocks
    at a time in a task that emits k jobs per query. Chunks are copied once
    per ``QUERY_BLOCK`` queries, so this is for more queries than one task holds.
    """
    per_query = {"remote_only", "min_salary"} <= set(queries.columns)
    if per_query and "salary_max" not in chunks.columns:
        raise ValueError("filters need chunks with remote and salary_max: with_filters")
    spark, extra = chunks.sparkSession, ["remote_only", "min_salary"] if per_query else []
    asked = materialize(queries.select("query_id", "embedding", *extra), "queries")
    size = asked.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("ids"), F.max(F.size("embedding")).alias("dim")).first()
    if size["ids"] < size["n"]:
        raise ValueError("query_id must be unique")
    n, width = chunks.count(), max(size["dim"] or 1, 1)
    parts, sets = max(1, -(-n // _block_rows(n, width, spark))), _block_sets(size["n"], width)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n, *ids: F.pmod(F.xxhash64(*ids), F.lit(n)).cast("int")
    chunk_rows = chunks.select(
        block(parts, "job_id", "chunk_index").alias("part"), each(sets).alias("set"), *filter_columns(chunks, per_query)
    )
    query_rows = asked.select(each(parts).alias("part"), block(sets, "query_id").alias("set"), "query_id", "embedding", *extra)
    key, tasks = ["part", "set"], min(2 * parts * sets, MOST_TASKS)  # a number of its own, as small blocks are long work too
    return _ranked_blocks(chunk_rows.repartition(tasks, *key), query_rows.repartition(tasks, *key), key, k)


class _VisitsTopK(_PartitionTopK):
    """The same for chunks sorted by ``cell`` and queries that see some cells only: ``visits`` is queries x numbered cells."""

    def __init__(self, units, query_remote, query_salary, k: int, visits: np.ndarray, floor: np.ndarray | None = None):
        super().__init__(units, query_remote, query_salary, k, floor)
        self.visits = visits

    def _filter(self, scores: np.ndarray, batch: pa.RecordBatch) -> None:
        super()._filter(scores, batch)
        seen = self.visits[:, batch.column("cell").to_numpy()].T
        if not seen.all():
            scores[~seen] = -np.inf

    def _passing(self, batch: pa.RecordBatch, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return super()._passing(batch, rows, q) & self.visits[q, batch.column("cell").to_numpy()[rows]]

    def _candidates(self, batch: pa.RecordBatch, floor: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(self.visits[:, np.unique(batch.column("cell").to_numpy())].any(axis=1))
        if len(at) == len(self.units):
            return super()._candidates(batch, floor)
        some = copy.copy(self)
        some.units, some.rough, some.undirected, some.visits = self.units[at], self.rough[at], self.undirected[at], self.visits[at]
        some.remote = None if self.remote is None else self.remote[at]
        some.salary = None if self.salary is None else self.salary[at]
        found = super(_VisitsTopK, some)._candidates(batch, floor[at])
        return found.assign(q=at[found["q"].to_numpy()])


def _numbered_visits(chunk_cells: pa.Array, query_cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of every chunk's cell in this block, and queries x cells: who visits which."""
    cells, number = np.unique(chunk_cells.to_numpy(), return_inverse=True)
    wanted = query_cells.flatten().to_numpy()
    query = np.repeat(np.arange(len(query_cells)), query_cells.value_lengths().to_numpy())
    there = np.isin(wanted, cells)
    visits = np.zeros((len(query_cells), len(cells)), dtype=bool)
    visits[query[there], np.searchsorted(cells, wanted[there])] = True
    return number, visits


def _ranked_blocks(chunk_rows: DataFrame, query_rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k best jobs of every query, from blocks of chunks and of queries with the same key.

    Queries with ``cells`` see the chunks of these only.
    """
    in_cells, query_sql, job_sql = "cells" in query_rows.columns, query_rows.schema["query_id"].dataType, chunk_rows.schema["job_id"].dataType
    query_type, job_type, schema = to_arrow_type(query_sql), to_arrow_type(job_sql), winner_schema(query_sql, job_sql)
    names = [x.split()[0] for x in schema.split(", ")]

    def rank(chunk_table: pa.Table, query_table: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], t) for n, t in zip(names, (query_type, job_type, pa.int32(), pa.float64()), strict=True)})
        if not chunk_table.num_rows or not query_table.num_rows:
            return empty
        ids, options = _asking(query_table)
        top = _PartitionTopK(**options, k=k)
        if in_cells:
            chunk_table = chunk_table.sort_by("cell")
            number, visits = _numbered_visits(chunk_table["cell"].combine_chunks(), query_table["cells"].combine_chunks())
            chunk_table = _with_cell(chunk_table, number)
            top = _VisitsTopK(**options, k=k, visits=visits)
        found = [winner_batch(rows, ids, query_type, job_type) for rows in top(chunk_table.combine_chunks().to_batches())]
        return pa.Table.from_batches(found) if found else empty

    found = chunk_rows.groupBy(*key).cogroup(query_rows.groupBy(*key)).applyInArrow(rank, schema)
    return best_ranked(found, k)


def _asking(query_table: pa.Table) -> tuple[np.ndarray, dict]:
    """The ids of queries, and what their search goes by."""
    names = set(query_table.column_names)
    flags = np.array([bool(x) for x in query_table["remote_only"].to_pylist()]) if "min_salary" in names else None
    salary = _least_salaries(query_table["min_salary"].to_pylist()) if "min_salary" in names else None
    floor = query_table["floor"].to_numpy().astype(np.float64) if "floor" in names else None  # NULL turns NaN
    ids = np.array(query_table["query_id"].to_pylist(), dtype=object)
    return ids, {"units": _unit_rows(query_table["embedding"].to_pylist()), "query_remote": flags, "query_salary": salary, "floor": floor}


def _with_cell(table: pa.Table, number: np.ndarray) -> pa.Table:
    return table.set_column(table.schema.get_field_index("cell"), "cell", pa.array(number))


def _packed(rows: DataFrame, most: int, deal: int) -> DataFrame:
    """The rows of every partition, in their order, as packs of up to ``most``, dealt over ``deal`` partitions.

    A pack is one row: its number ``at`` and its rows in Arrow's own format.
    """

    def pack(at: int, waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, waiting[0].schema) as writer:
            writer.write_table(pa.Table.from_batches(waiting).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["at", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, held = TaskContext.get().partitionId(), [], 0
        at <<= 32
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - held)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                held += part.num_rows
                if held >= most:
                    yield pack(at, waiting)
                    at, waiting, held = at + 1, [], 0
        if held:
            yield pack(at, waiting)

    packs = rows.mapInArrow(run, "at long, rows binary")
    to = (F.shiftright("at", 32) + F.col("at").bitwiseAND((1 << 32) - 1)) % deal
    return packs.repartitionById(deal, to.cast("int"))


def _unpacked(packed: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all()


def _ranked_packs(placed: DataFrame, asked: DataFrame, layout: _Layout, n: int, width: int, k: int) -> DataFrame:
    """The same winners as of :func:`_ranked_blocks`, for so many queries that shuffled copies of the chunks would fill the disks.

    Chunks and queries are each written once, in packs. Every pack of queries
    meets every group of packs of chunks in a task that reads the group, one
    pack after the other, and keeps k jobs per query; what is written beside
    the packs is k rows per query and group.
    """
    spark, query_sql, job_sql = asked.sparkSession, asked.schema["query_id"].dataType, placed.schema["job_id"].dataType
    query_type, job_type, schema = to_arrow_type(query_sql), to_arrow_type(job_sql), winner_schema(query_sql, job_sql)
    most, rows = _block_queries(width), max(1, PACK_BYTES // (8 * width))
    sets = min(_block_sets(asked.count(), width), MOST_TASKS)
    tasks = 4 * spark.sparkContext.defaultParallelism
    groups = max(1, min(max(-(-tasks // sets), -(-n // GROUP_ROWS)), MOST_TASKS // sets, -(-n // rows)))
    mask = asked.withColumn("cells", F.lit(b"")).schema  # the cells as bits: lists of them would outweigh the vectors

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.packbits(layout.visits(batch.column("cells").to_pandas()), axis=1)
            column = pa.array([x.tobytes() for x in seen], pa.binary())
            yield pa.RecordBatch.from_arrays([column if c == "cells" else batch.column(c) for c in mask.names], names=mask.names)

    # Sorted by all they have, packs are the same when a task is run again.
    queries = asked.repartition(sets, F.xxhash64("query_id")).sortWithinPartitions("query_id", "embedding").mapInArrow(bits, mask)
    chunks = placed.repartition(min(2 * layout.parts, MOST_TASKS), "part").sortWithinPartitions("part", "cell", "job_id", "chunk_index", "embedding")
    pairs = _packed(chunks, rows, groups).select(F.col("rows").alias("chunks")).hint("shuffle_replicate_nl").crossJoin(
        _packed(queries, most + most // 4 + 1, sets).select("at", F.col("rows").alias("queries"))
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, tuple[np.ndarray, _VisitsTopK]] = {}
        for batch in batches:
            for packed, at, asking in zip(*(batch.column(c) for c in ("chunks", "at", "queries")), strict=True):
                if at.as_py() not in tops:
                    table = _unpacked(asking)
                    ids, options = _asking(table)
                    seen = np.frombuffer(b"".join(table["cells"].to_pylist()), np.uint8).reshape(len(ids), -1)
                    visits = np.unpackbits(seen, axis=1, count=len(layout.cells)).astype(bool)
                    tops[at.as_py()] = ids, _VisitsTopK(**options, k=k, visits=visits)
                chunk_table = _unpacked(packed)
                number = np.searchsorted(layout.cells, chunk_table["cell"].to_numpy())
                for part in _with_cell(chunk_table, number).combine_chunks().to_batches():
                    tops[at.as_py()][1].add(part)
        for ids, top in tops.values():
            for found in top(iter(())):
                yield winner_batch(found, ids, query_type, job_type)

    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(PACK_BYTES))  # pairs of packs are large: one or a few at a time
    try:
        return materialize(pairs.mapInArrow(rank, schema), "met")
    finally:
        spark.conf.set(BATCH_BYTES, before)
