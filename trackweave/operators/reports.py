"""Lists and counts over the tracking tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trackweave.functions.text import days_before
from trackweave.operators.keyed import first_n, join_hot, latest_per_key, number_within
from trackweave.schemas import ACTIVE_STAGES, HISTORY_MESSAGES, STALE_DAYS


def tracked_jobs(
    saved: DataFrame, postings: DataFrame, user_id: int | None = None, stage: str | None = None
) -> DataFrame:
    """Saved jobs with their posting; no or empty stage means all. One user's come newest change first."""
    rows = saved if user_id is None else saved.filter(F.col("user_id") == user_id)
    if stage:
        rows = rows.filter(F.col("stage") == stage)
    joined = rows.join(postings.select("job_id", "title", "company", "location", "remote", "url"), "job_id")
    columns = [
        "saved_job_id", "job_id", "stage", "match_score", "saved_at", "updated_at",
        "title", "company", "location", "remote", "url",
    ]
    if user_id is None:
        return joined.select("user_id", *columns)
    return joined.select(*columns).orderBy(F.desc("updated_at"), "saved_job_id")


def stale_jobs(
    saved: DataFrame,
    postings: DataFrame,
    as_of: Column,
    days: int = STALE_DAYS,
    stages: Sequence[str] = ACTIVE_STAGES,
    user_id: int | None = None,
) -> DataFrame:
    """Jobs in an active stage last changed before ``as_of - days``; one user's come oldest first."""
    rows = saved if user_id is None else saved.filter(F.col("user_id") == user_id)
    rows = rows.filter(F.col("stage").isin(*stages) & (F.col("updated_at") < days_before(as_of, days)))
    joined = rows.join(postings.select("job_id", "title", "company"), "job_id")
    columns = ["saved_job_id", "job_id", "stage", "updated_at", "title", "company"]
    if user_id is None:
        return joined.select("user_id", *columns)
    return joined.select(*columns).orderBy("updated_at", "saved_job_id")


def tracked_places(saved: DataFrame, postings: DataFrame, stage: str | None = None) -> DataFrame:
    """Every user's list with each job's ``place`` in it, newest change first (NULL last), ties by id."""
    rows = tracked_jobs(saved, postings, stage=stage)
    return number_within(rows, ["user_id"], [F.desc_nulls_last("updated_at"), F.asc("saved_job_id")], "place")


def stale_places(saved: DataFrame, postings: DataFrame, as_of: Column, days: int = STALE_DAYS) -> DataFrame:
    """Every user's stale jobs with their ``place``, oldest first, ties by id."""
    return number_within(stale_jobs(saved, postings, as_of, days), ["user_id"], ["updated_at", "saved_job_id"], "place")


def stale_banner(stale: DataFrame) -> DataFrame:
    """One row per stale job: its "title at company" label and how many its user has.

    Read a user's rows by (updated_at, saved_job_id): oldest first. No string
    or group grows with a user's history.
    """
    totals = stale.groupBy("user_id").agg(F.count("*").alias("stale_total"))
    label = F.concat(F.col("title"), F.lit(" at "), F.coalesce("company", F.lit("unknown company")))
    return join_hot(stale, totals, ["user_id"], "inner").select(
        "user_id", "stale_total", "saved_job_id", "updated_at", label.alias("label")
    )


def stage_counts(saved: DataFrame, by: str = "stage", owner: str | None = None) -> DataFrame:
    """Rows per stage and the total, which has is_total = 1; with ``owner`` for each of its values."""
    keys = [by] if owner is None else [owner, by]
    rows = saved.rollup(*keys).agg(
        *([] if owner is None else [F.grouping(owner).alias("_all")]),
        F.grouping(by).cast("int").alias("is_total"), F.count("*").alias("jobs"),
    )
    return rows if owner is None else rows.filter("_all = 0").drop("_all")


def tracked_with_drafts(saved: DataFrame, applications: DataFrame) -> DataFrame:
    """Saved jobs with their drafted texts; jobs without any stay."""
    texts = applications.select("saved_job_id", "cover_letter", "resume_bullet", "applied_at", "last_updated_at")
    return saved.join(texts, "saved_job_id", "left")


def followups_due(notes: DataFrame, saved: DataFrame, as_of: Column) -> DataFrame:
    """Per saved job the latest note whose follow-up date has come."""
    due = notes.filter(F.col("follow_up_at") <= as_of)
    last = latest_per_key(due, ["saved_job_id"], [F.desc("follow_up_at"), F.desc("note_id")])
    return last.join(saved.select("saved_job_id", "user_id", "job_id", "stage"), "saved_job_id")


def recent_messages(messages: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """The last ``n`` messages of each conversation."""
    return first_n(messages, ["conv_id"], [F.desc("turn")], n)


def profile_of(profiles: DataFrame, user_id: int) -> DataFrame:
    """One user's profile; no row where there is none."""
    return profiles.filter(F.col("user_id") == user_id)


def skills_of(skills: DataFrame, user_id: int) -> DataFrame:
    """One user's skills by name."""
    mine = skills.filter(F.col("user_id") == user_id)
    return mine.select("skill_name", "years_experience").orderBy("skill_name")


def skill_lists(skills: DataFrame, owner: str = "user_id") -> DataFrame:
    """Per user one text "name (years y), ..." in name order; missing years print the name only.

    A name occurs once per user, so a list is as long as one person's skills.
    """
    label = F.when(
        F.col("years_experience").isNotNull(),
        F.concat("skill_name", F.lit(" ("), F.col("years_experience").cast("string"), F.lit("y)")),
    ).otherwise(F.col("skill_name"))
    collected = skills.groupBy(owner).agg(
        F.sort_array(F.collect_list(F.struct("skill_name", label.alias("label")))).alias("_items")
    )
    return collected.select(
        owner, F.array_join(F.transform("_items", lambda item: item["label"]), ", ").alias("skills")
    )
