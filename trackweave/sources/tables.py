"""Keyed tables on Spark's own layout: Parquet, partitioned by a hash of the owner, bucketed and sorted by the keys.

* The partition column ``part`` is what a change rewrites: an upsert reads and
  overwrites only the parts its keys fall into (dynamic partition overwrite),
  and Spark's commit puts all of them in place at the end of the job or none.
* Inside a part, rows lie in buckets by key, so the old rows of a join on the
  keys are read already partitioned: only the keys of changes are shuffled to
  them, and wide rows are never sorted for a join.
* What is written is dealt by part and bucket, and a crowded bucket to several
  tasks (and so files), so that the rows a task sorts do not grow with the table.

The layout's numbers are part of the folder's name, so that a table is never
opened with others. Keys are not NULL; a row whose first key is NULL stands for
a part that has lost all its rows and is never shown.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from trackweave.operators.keyed import latest_per_key, not_in
from trackweave.session import folder_names, materialize


# Bytes of shuffled (compressed) rows that a task writes, and tasks over which a bucket of a part may go.
WRITE_BYTES, SPREAD = 16 << 20, 16
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


class KeyedTable:
    """A table below ``root``, unique on ``keys``; ``owner`` columns (the keys, unless told otherwise) choose the part."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: str,
        keys: Sequence[str],
        owner: Sequence[str] | None = None,
        parts: int = 64,
        buckets: int = 64,
    ):
        self.spark, self.schema = spark, StructType.fromDDL(schema)
        self.keys, self.owner, self.parts, self.buckets = list(keys), list(owner or keys), parts, buckets
        layout = f"parts-{parts}-buckets-{buckets}"
        others = [n for n in folder_names(spark, root) if n != layout]
        if others:
            raise ValueError(f"{root} was written as {others}, not as {layout}")
        location = f"{root.rstrip('/')}/{layout}"
        self.name = f"keyed_{hashlib.md5(location.encode()).hexdigest()}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        by = ", ".join(f"`{k}`" for k in self.keys)
        place = location.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, part int) USING parquet PARTITIONED BY (part) "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )

    def part(self) -> Column:
        typed = [F.col(c).cast(self.schema[c].dataType) for c in self.owner]
        return F.pmod(F.xxhash64(*typed), F.lit(self.parts)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The parts that rows fall into; at most ``parts`` numbers."""
        return sorted(r.part for r in rows.select(self.part().alias("part")).distinct().collect())

    def _parts(self, parts: Sequence[int]) -> DataFrame:
        return self._rows().filter(F.col("part").isin(list(parts))).drop("part")

    def _rows(self) -> DataFrame:
        return self.spark.table(self.name).filter(F.col(self.keys[0]).isNotNull())

    def read(self) -> DataFrame:
        return self._rows().drop("part")

    def read_for(self, rows: DataFrame) -> DataFrame:
        """Only the parts that ``rows`` fall into: all the table holds for their owners."""
        return self._parts(self.touched(rows))

    def _typed(self, rows: DataFrame) -> DataFrame:
        shown = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema
        ]
        return rows.select(*shown).withColumn("part", self.part())

    def _insert(self, rows: DataFrame, overwrite: bool) -> None:
        """Write typed rows, dealt by part and bucket: a crowded bucket to up to SPREAD tasks, many small ones to one."""
        place = {"_bucket": F.pmod(F.hash(*self.keys), F.lit(self.buckets)), "_spread": F.pmod(F.xxhash64(*self.keys), F.lit(SPREAD))}
        dealt = rows.withColumns(place).hint("rebalance", "part", *place)
        before = self.spark.conf.get(ADVISORY)
        self.spark.conf.set(ADVISORY, str(WRITE_BYTES))
        try:
            dealt.drop(*place).write.insertInto(self.name, overwrite=overwrite)
        finally:
            self.spark.conf.set(ADVISORY, before)
        self.spark.catalog.refreshTable(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add rows with new keys; nothing is rewritten."""
        self._insert(self._typed(rows), overwrite=False)

    def upsert(self, changes: DataFrame, update: Sequence[str], order: Sequence | None = None) -> None:
        """Insert or update by key; ``order`` picks one of repeated keys. Old rows outside the touched parts are not read."""
        if order is not None:
            changes = latest_per_key(changes, self.keys, order)
        staged = materialize(changes, "changes")
        parts = self.touched(staged)
        if parts:
            self._insert(self._typed(self._changed(self._parts(parts), staged, update)), overwrite=True)

    def _changed(self, old: DataFrame, staged: DataFrame, update: Sequence[str]) -> DataFrame:
        """As ``keyed.upsert``: the old rows without a change, and the changes with what they keep of the old rows.

        Wide rows pass the joins without being sorted: the hashed side holds
        keys, and of the old rows the columns that are not updated, where these
        are the fewer.
        """
        kept = old.join(staged.select(*self.keys).hint("shuffle_hash"), self.keys, "left_anti")
        given = [c for c in old.columns if c not in self.keys and c in staged.columns]
        stay = [c for c in old.columns if c not in self.keys and not (c in update and c in given)]
        held = old.select(*self.keys, *[F.col(c).alias(f"_old_{c}") for c in stay], F.lit(True).alias("_known"))

        def merged(name: str) -> Column:
            after = F.col(name).cast(self.schema[name].dataType) if name in given else F.lit(None).cast(self.schema[name].dataType)
            return after if name not in stay else F.when(F.col("_known").isNotNull(), F.col(f"_old_{name}")).otherwise(after)

        few = 2 * len(stay) <= len(old.columns) - len(self.keys)
        joined = staged.join(held.hint("shuffle_hash") if few else held, self.keys, "left")
        return kept.unionByName(joined.select(*[F.col(c) if c in self.keys else merged(c).alias(c) for c in old.columns]))

    def replace(self, owners: DataFrame, rows: DataFrame) -> None:
        """Drop all rows of the given owners, then add ``rows``."""
        staged = materialize(owners.select(*self.owner).distinct(), "owners")
        parts = self.touched(staged)
        if not parts:
            return
        kept = not_in(self._parts(parts), staged, self.owner, unique=True)
        left = self._typed(kept.unionByName(rows, allowMissingColumns=True))
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        blank = self.spark.range(self.parts).filter(F.col("id").isin(parts)).select(*nothing, F.col("id").cast("int").alias("part"))
        self._insert(left.unionByName(blank), overwrite=True)
