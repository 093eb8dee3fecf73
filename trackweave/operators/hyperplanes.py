"""Approximate search by random-hyperplane hashing: no centres, no fit.

A vector's code in a table is one bit per hyperplane, the side it lies on;
vectors at a small angle agree in most bits. Chunks carry a code per table; a
query visits, per table, the buckets that cost least to reach (the squared
distances to the hyperplanes that must be crossed). Chunks and queries meet by
equality of (table, code), so any number of queries is one join, and new chunks
are hashed by themselves and appended.

Defined cases: chunks and queries without direction (NULL, zero, non-finite, of
another length, or with a NULL element) have no codes and are not found; a query
whose buckets hold fewer than k jobs gets fewer rows; with every bucket probed
the result is the exact one, but for chunks without direction.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackweave.functions.vectors import vectors_to_matrix
from trackweave.operators.cells import CellIndex, _matrix, _meet_in_cells, _per_query, _route, directed
from trackweave.operators.search import _unit_rows
from trackweave.schemas import SEARCH_LIMIT
from trackweave.session import materialize

#: Buckets are numbered by one int, and a query's costs are held for all codes of a table.
MOST_BITS = 14
#: Costs are rounded to this many decimals, so that ties fall alike whatever the order of additions.
COST_DECIMALS = 9


def sign_planes(dim: int, tables: int = 4, bits: int = 8) -> np.ndarray:
    """Hyperplanes (tables, bits, dim) with normals of +1 and -1, by a digit of md5 of plane and place."""
    if not 1 <= bits <= MOST_BITS or not 1 <= tables <= 1 << 12:
        raise ValueError(f"between 1 and {MOST_BITS} bits and at most 4096 tables")
    signs = [1.0 if md5(f"{p}-{d}".encode()).hexdigest()[0] >= "8" else -1.0 for p in range(tables * bits) for d in range(dim)]
    return np.array(signs).reshape(tables, bits, dim)


def codes_of(planes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The code of every vector in every table (vectors, tables)."""
    sides = np.einsum("nd,tbd->ntb", vectors, planes) >= 0
    return (sides * (1 << np.arange(planes.shape[1]))).sum(axis=2).astype(np.int32)


def cheapest_codes(planes: np.ndarray, vectors: np.ndarray, probes: int) -> np.ndarray:
    """Per vector and table the ``probes`` codes that cost least to reach, ties to the lower code."""
    products = np.einsum("nd,tbd->ntb", _unit_rows(vectors), planes)
    codes = np.arange(1 << planes.shape[1], dtype=np.int32)
    bits = (codes[:, None] >> np.arange(planes.shape[1])) & 1
    # Crossing a plane costs its squared distance; staying on a side costs nothing.
    up, down = np.where(products < 0, products**2, 0.0), np.where(products >= 0, products**2, 0.0)
    costs = np.round(up @ bits.T + down @ (1 - bits).T, COST_DECIMALS)
    return np.argsort(costs, axis=2, kind="stable")[:, :, :probes].astype(np.int32)


def hash_chunks(chunks: DataFrame, planes: np.ndarray) -> DataFrame:
    """Add ``codes``, one per table (NULL for chunks without direction); store it with the chunks."""
    dim = planes.shape[2]
    types = chunks.drop("codes").withColumn("codes", F.array(F.lit(0))).schema
    types["codes"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column("_directed").to_numpy(zero_copy_only=False).astype(bool)
            matrix, _ = vectors_to_matrix(batch.column("embedding"), dim)
            codes = codes_of(planes, np.where(good[:, None], matrix, 0.0))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, codes.size + 1, len(planes)), pa.int32()), pa.array(codes.ravel()), mask=pa.array(~good)
            )
            kept = batch.drop_columns(["_directed"])
            yield pa.RecordBatch.from_arrays([*kept.columns, lists], names=[*kept.schema.names, "codes"])

    return chunks.drop("codes").withColumn("_directed", directed(dim)).mapInArrow(run, types)


def search_many_hashed(
    hashed: DataFrame, planes: np.ndarray, queries: DataFrame, k: int = SEARCH_LIMIT, probes: int = 48
) -> DataFrame:
    """Like :func:`search_many` for any number of queries, each over its cheapest buckets of every table.

    ``hashed`` comes from :func:`hash_chunks` with the same planes. Buckets
    without a query are left out before chunks are shuffled; crowded buckets and
    crowds of queries are cut into blocks of bounded size, and a task emits k
    jobs per query of its block, so no pairs are written. A chunk that several
    tables bring is one row of the result.
    """
    tables, bits, dim = planes.shape
    columns = ["query_id", "embedding", *_per_query(queries)]
    asked = materialize(queries.select(*columns), "queries").filter(directed(dim))

    def buckets(rows: pd.DataFrame) -> list[list[int]]:
        found = cheapest_codes(planes, _matrix(rows, dim), probes)
        return (found + (np.arange(tables, dtype=np.int32) << bits)[None, :, None]).reshape(len(rows), -1).tolist()

    places = hashed.select("*", F.posexplode("codes").alias("_table", "_code"))
    in_buckets = places.withColumn("cell", (F.shiftleft("_table", bits) + F.col("_code")).cast("int")).drop("_table", "_code", "codes")
    return _meet_in_cells(CellIndex(in_buckets, np.zeros((0, dim))), _route(asked, buckets, columns), k)
