"""Set-based changes to keyed tables: dedupe, upsert, partial update, replace.

Each takes and returns DataFrames; keys are column names. The shuffles are by
key, and every per-key choice is reduced on the map side first, so a key that
holds a third of all changes sends one row per map task, not all its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackweave.session import materialize

Order = Sequence[str | Column]


def rank_within(df: DataFrame, keys: Sequence[str], order: Order, limit: int) -> DataFrame:
    """The first ``limit`` rows of each key under ``order``.

    Spark plans a filter on row_number as a group limit before and after the
    shuffle, so at most ``limit`` rows per key leave each map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= limit)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """One row per key: the first under ``order``."""
    return rank_within(df, keys, order, 1).drop("_rank")


def first_n(df: DataFrame, keys: Sequence[str], order: Order, n: int) -> DataFrame:
    """Up to ``n`` rows per key: the first under ``order``."""
    return rank_within(df, keys, order, n).drop("_rank")


def join_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join ``left``, in which keys may be hot, to a ``right`` computed per key.

    AQE splits a skewed partition only where both join inputs come straight
    from a shuffle. An aggregation on the join keys is already partitioned by
    them, gets no shuffle of its own, and so leaves a hot left key to one task.
    Joining on a hash of the keys as well makes Spark shuffle the small right
    side once more, and the left is split.
    """
    if any(left.schema[k].dataType != right.schema[k].dataType for k in keys):
        return left.join(right, list(keys), how)  # equal keys of two types hash apart
    mark = F.xxhash64(*keys)
    joined = left.withColumn("_mark", mark).join(right.withColumn("_mark", mark), [*keys, "_mark"], how)
    return joined.drop("_mark")


def _by_presence(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str, unique: bool, hot: bool) -> DataFrame:
    present = other.select(*keys)
    if unique:
        joined = df.join(present, list(keys), how)
    elif hot:
        joined = join_hot(df, present.distinct(), keys, how)
    else:
        joined = df.join(present.distinct(), list(keys), how)
    return joined.select(*df.columns)


def not_in(
    df: DataFrame, other: DataFrame, keys: Sequence[str], unique: bool = False, hot: bool = False
) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``.

    ``other`` is reduced to distinct keys first: a key repeated there millions
    of times crosses the network once per map task. ``unique`` says its keys
    are distinct already, ``hot`` that keys repeat in ``df``.
    """
    return _by_presence(df, other, keys, "left_anti", unique, hot)


def only_in(
    df: DataFrame, other: DataFrame, keys: Sequence[str], unique: bool = False, hot: bool = False
) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``; options as in :func:`not_in`."""
    return _by_presence(df, other, keys, "left_semi", unique, hot)


def upsert(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], update: Sequence[str]
) -> DataFrame:
    """Insert new keys; on a known key overwrite only the ``update`` columns.

    ``changes`` holds one row per key (see :func:`latest_per_key`). Columns it
    lacks are NULL in inserted rows. The result has the target's columns.
    """
    rest = [c for c in target.columns if c not in keys]
    given = [c for c in rest if c in changes.columns]
    old = target.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in rest], F.lit(True).alias("_known"))
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in given], F.lit(True).alias("_changed"))
    joined = old.join(new, list(keys), "full_outer")

    def merged(name: str) -> Column:
        before = F.col(f"_old_{name}")
        if name not in given:
            return before.alias(name)
        after = F.col(f"_new_{name}").cast(target.schema[name].dataType)
        takes_new = F.col("_known").isNull()
        if name in update:
            takes_new = F.col("_changed").isNotNull()
        return F.when(takes_new, after).otherwise(before).alias(name)

    return joined.select(*[F.col(c) if c in keys else merged(c) for c in target.columns])


def insert_missing(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add rows with unknown keys; known keys stay as they are."""
    return target.unionByName(not_in(rows, target, keys), allowMissingColumns=True)


def partial_update(
    target: DataFrame,
    updates: DataFrame,
    key: str,
    order: str,
    fields: Sequence[str],
    stamp: Mapping[str, str] | None = None,
    blank_is_missing: bool = False,
) -> DataFrame:
    """Apply partial updates in ``order``: a NULL field means "leave as is".

    Of many updates to one key, each field takes its last non-NULL value.
    ``stamp`` maps a target column to the update column it takes from the last
    update that supplied any field. Updates to unknown keys have no effect.
    ``blank_is_missing`` also reads empty texts and empty arrays as NULL.
    """

    def supplied(name: str) -> Column:
        col = F.col(name)
        if not blank_is_missing:
            return col
        kind = updates.schema[name].dataType.typeName()
        if kind == "string":
            return F.nullif(col, F.lit(""))
        return F.when(F.size(col) > 0, col) if kind == "array" else col

    stamp = dict(stamp or {})
    values = updates.select(
        key, order, *[supplied(f).alias(f"_set_{f}") for f in fields],
        *[F.col(src).alias(f"_stamp_{dst}") for dst, src in stamp.items()],
    )
    any_set = F.coalesce(*[F.when(F.col(f"_set_{f}").isNotNull(), F.col(order)) for f in fields])
    folded = values.groupBy(key).agg(
        *[
            F.max_by(f"_set_{f}", F.when(F.col(f"_set_{f}").isNotNull(), F.col(order))).alias(f"_set_{f}")
            for f in fields
        ],
        *[F.max_by(f"_stamp_{dst}", any_set).alias(f"_stamp_{dst}") for dst in stamp],
    )
    prefix = {**{f: f"_set_{f}" for f in fields}, **{dst: f"_stamp_{dst}" for dst in stamp}}
    return target.join(folded, key, "left").select(
        *[
            F.coalesce(F.col(prefix[c]), F.col(c)).alias(c) if c in prefix else F.col(c)
            for c in target.columns
        ]
    )


def replace_owned(
    target: DataFrame,
    owners: DataFrame,
    rows: DataFrame,
    owner: str,
    item: str,
    order: Order,
) -> DataFrame:
    """Replace everything the given owners hold by ``rows``.

    ``owners`` lists every owner touched, also those left with nothing. Of
    repeated items the first under ``order`` stays.
    """
    kept = not_in(target, owners, [owner], hot=True)
    fresh = latest_per_key(only_in(rows, owners, [owner], hot=True), [owner, item], order)
    return kept.unionByName(fresh.select(*[c for c in target.columns if c in fresh.columns]), allowMissingColumns=True)


def assign_ids(
    rows: DataFrame, keys: Sequence[str], out: str, after: DataFrame | None = None, buckets: int = 1 << 16
) -> DataFrame:
    """Dense surrogate ids, without sending all rows through one task.

    Rows (unique on ``keys``) are numbered inside hash buckets, and each bucket
    starts where the one before it ends. Ids depend on the keys only, so a
    re-run task gives the same ids. ``after`` continues an existing table's ids.
    """
    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    # one row per bucket at most: a table of proven size
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    starts = sizes.withColumn(
        "_start",
        F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
    ).select("_bucket", F.coalesce("_start", F.lit(0)).alias("_start"))
    base = F.lit(0)
    if after is not None:
        base = F.coalesce(after.agg(F.max(out)).scalar(), F.lit(0))
    number = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    return (
        bucketed.withColumn("_number", number)
        .join(F.broadcast(starts), "_bucket")
        .withColumn(out, (base + F.col("_start") + F.col("_number")).cast("bigint"))
        .drop("_bucket", "_number", "_start")
    )


def number_within(rows: DataFrame, owner: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """Add the place (from 1) of every row among its owner's rows under ``order`` (total within an owner).

    Rows are range-partitioned by owner and order, so that an owner of a third
    of all rows is cut over many tasks; each part numbers its own rows, and the
    owner's rows in the parts before (a row per part and owner) are added.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *owner, *order)
    # Stored once: both passes then see the same rows in the same parts.
    stored = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    counts = stored.groupBy(*owner, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*owner).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.row_number().over(Window.partitionBy(*owner, "_part").orderBy(*order))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in owner]
    numbered = stored.withColumn("_number", number).alias("a").join(
        offsets.alias("b"), [F.col("a._part") == F.col("b._part"), *same]
    )
    return numbered.select(*[F.col(f"a.`{c}`") for c in rows.columns], (F.col("_number") + F.col("_before")).cast("long").alias(out))
