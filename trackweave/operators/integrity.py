"""Constraint checks and cascading deletes over parent-child tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trackweave.functions.vectors import has_dimension
from trackweave.operators.keyed import not_in, only_in
from trackweave.schemas import EMBEDDING_DIM, STAGES


@dataclass(frozen=True)
class TableRules:
    """Constraints of one table.

    unique: column groups; not_null: columns; allowed: column -> values;
    dimension: vector column -> length; references: column -> (parent, column).
    """

    df: DataFrame
    unique: Sequence[Sequence[str]] = ()
    not_null: Sequence[str] = ()
    allowed: Mapping[str, Sequence] = field(default_factory=dict)
    dimension: Mapping[str, int] = field(default_factory=dict)
    references: Mapping[str, tuple[DataFrame, str]] = field(default_factory=dict)


def _row_rules(rules: TableRules) -> dict[str, Column]:
    """Name -> condition a violating row meets. NULL passes all but NOT NULL."""
    found = {f"not null {c}": F.col(c).isNull() for c in rules.not_null}
    for c, values in rules.allowed.items():
        found[f"allowed {c}"] = F.col(c).isNotNull() & ~F.col(c).isin(*values)
    for c, n in rules.dimension.items():
        found[f"dimension {c}"] = F.col(c).isNotNull() & ~has_dimension(F.col(c), n)
    return found


def _duplicates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return df.filter(present).groupBy(*cols).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def _orphans(df: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Foreign keys without parent and their row counts; counted before the join."""
    counted = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("rows"))
    return not_in(counted, parent.select(F.col(parent_col).alias(col)), [col])


def _key_text(cols: Sequence[str]) -> Column:
    """Key columns as JSON, NULLs included: different keys give different texts."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def constraint_report(tables: Mapping[str, TableRules]) -> DataFrame:
    """Violations per constraint: table_name, constraint_name, violations.

    Row-level rules of a table share one scan. Uniqueness counts keys that
    occur more than once; references count rows without parent.
    """
    parts = []
    for name, rules in tables.items():
        conditions = _row_rules(rules)
        if conditions:
            counts = rules.df.agg(
                F.array(
                    *[
                        F.struct(F.lit(rule).alias("constraint_name"), F.count_if(bad).alias("violations"))
                        for rule, bad in conditions.items()
                    ]
                ).alias("_all")
            )
            parts.append(counts.select(F.lit(name).alias("table_name"), F.inline("_all")))
        for cols in rules.unique:
            dup = _duplicates(rules.df, cols).agg(F.count("*").alias("violations"))
            parts.append(
                dup.select(
                    F.lit(name).alias("table_name"),
                    F.lit("unique " + ", ".join(cols)).alias("constraint_name"),
                    "violations",
                )
            )
        for col, (parent, parent_col) in rules.references.items():
            lost = _orphans(rules.df, col, parent, parent_col).agg(
                F.coalesce(F.sum("rows"), F.lit(0)).alias("violations")
            )
            parts.append(
                lost.select(
                    F.lit(name).alias("table_name"),
                    F.lit(f"references {col}").alias("constraint_name"),
                    "violations",
                )
            )
    return reduce(DataFrame.unionByName, parts)


def constraint_violations(tables: Mapping[str, TableRules], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """The violating keys: table_name, constraint_name, key, rows.

    ``keys`` names the columns that identify a row of each table.
    """
    parts = []
    shape = ["table_name", "constraint_name", "key", "rows"]
    for name, rules in tables.items():
        for rule, bad in _row_rules(rules).items():
            rows = rules.df.filter(bad).groupBy(*keys[name]).agg(F.count("*").alias("rows")).withColumn("key", _key_text(keys[name]))
            parts.append(rows.withColumns({"table_name": F.lit(name), "constraint_name": F.lit(rule)}).select(*shape))
        for cols in rules.unique:
            dup = _duplicates(rules.df, cols).withColumn("key", _key_text(cols))
            label = F.lit("unique " + ", ".join(cols))
            parts.append(dup.withColumns({"table_name": F.lit(name), "constraint_name": label}).select(*shape))
        for col, (parent, parent_col) in rules.references.items():
            lost = _orphans(rules.df, col, parent, parent_col).withColumn("key", _key_text([col]))
            label = F.lit(f"references {col}")
            parts.append(lost.withColumns({"table_name": F.lit(name), "constraint_name": label}).select(*shape))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Child:
    """A child table: ``column`` refers to ``parent_column`` of table ``parent``."""

    table: str
    column: str
    parent: str
    parent_column: str


# The parent-child links of the tracking tables.
LINKS = (
    Child("profiles", "user_id", "users", "user_id"),
    Child("skills", "user_id", "users", "user_id"),
    Child("saved_jobs", "user_id", "users", "user_id"),
    Child("saved_jobs", "job_id", "postings", "job_id"),
    Child("chunks", "job_id", "postings", "job_id"),
    Child("applications", "saved_job_id", "saved_jobs", "saved_job_id"),
    Child("interview_notes", "saved_job_id", "saved_jobs", "saved_job_id"),
    Child("contacts", "saved_job_id", "saved_jobs", "saved_job_id"),
)


# Declared constraints of the tracking tables.
DECLARED = {
    "users": {"unique": [["user_id"], ["email"]], "not_null": ["email", "created_at"]},
    "profiles": {"unique": [["profile_id"], ["user_id"]], "not_null": ["user_id", "remote_only", "updated_at"]},
    "skills": {"unique": [["skill_id"], ["user_id", "skill_name"]], "not_null": ["user_id", "skill_name"]},
    "postings": {"unique": [["job_id"]], "not_null": ["source", "title", "payload", "synced_at"]},
    "chunks": {
        "unique": [["job_id", "chunk_index"]],
        "not_null": ["job_id", "chunk_index", "chunk_text", "embedding", "model_name", "created_at"],
        "dimension": {"embedding": EMBEDDING_DIM},
    },
    "saved_jobs": {
        "unique": [["saved_job_id"], ["user_id", "job_id"]],
        "not_null": ["user_id", "job_id", "stage", "saved_at", "updated_at"], "allowed": {"stage": STAGES},
    },
    "applications": {"not_null": ["saved_job_id", "last_updated_at"]},
    "interview_notes": {"unique": [["note_id"]], "not_null": ["saved_job_id", "note_text", "created_at"]},
    "contacts": {"unique": [["contact_id"]], "not_null": ["name", "created_at"]},
}


def declared_rules(tables: Mapping[str, DataFrame]) -> dict[str, TableRules]:
    """The declared constraints of the given tables; references to tables that are not given are left out."""
    return {
        name: TableRules(df, references={
            link.column: (tables[link.parent], link.parent_column)
            for link in LINKS if link.table == name and link.parent in tables
        }, **DECLARED[name])
        for name, df in tables.items()
    }


def cascade_delete(
    tables: Mapping[str, DataFrame],
    doomed: Mapping[str, DataFrame],
    links: Sequence[Child] = LINKS,
) -> dict[str, DataFrame]:
    """Tables after deleting the ``doomed`` rows and all that depend on them.

    ``doomed`` maps a table to the rows to delete (a frame with the column its
    children refer to, the primary key). ``links`` list parents before their children. Only key
    columns travel down the tree; rows with a NULL reference stay.
    """
    left: dict[str, DataFrame] = {}
    gone: dict[str, list[tuple[str, DataFrame]]] = {}
    for name, keys in doomed.items():
        column = keys.columns[0]
        gone.setdefault(name, []).append((column, keys.select(column)))
    order = [t for t in tables if t not in {link.table for link in links}]
    order += list(dict.fromkeys(link.table for link in links if link.table in tables))
    lost_rows: dict[str, list[DataFrame]] = {}
    for name in order:
        df = tables[name]
        hits = [(column, keys) for column, keys in gone.get(name, [])]
        for link in links:
            if link.table != name or link.parent not in lost_rows:
                continue
            for lost in lost_rows[link.parent]:
                keys = lost.select(F.col(link.parent_column).alias(link.column))
                hits.append((link.column, keys))
        rest, removed = df, []
        for column, keys in hits:
            # doomed keys are primary keys: distinct, with the children skewed at most
            removed.append(only_in(df, keys, [column], unique=True))
            rest = not_in(rest, keys, [column], unique=True)
        left[name] = rest
        if removed:
            lost_rows[name] = removed
    return left
