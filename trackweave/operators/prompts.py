"""Prompt datasets: one row per (user, job) pair, for batch model runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackweave.functions.text import text_or
from trackweave.operators.keyed import join_hot, not_in
from trackweave.operators.reports import skill_lists

# Characters of the description that go into each kind of prompt.
MATCH_DESCRIPTION = 1500
BULLET_DESCRIPTION = 1000
LETTER_DESCRIPTION = 1500
UNSPECIFIED = "not specified"
UNKNOWN_COMPANY = "unknown company"


def match_context(
    pairs: DataFrame, profiles: DataFrame, skills: DataFrame, postings: DataFrame
) -> DataFrame:
    """Pairs with profile, skill list and posting.

    Pairs without a posting drop out; users without profile or skills stay.
    Every right side has one row per key, so only the pairs can be skewed, and
    those are split.
    """
    people = profiles.select(
        "user_id", "headline", "summary", "target_roles", "min_salary", "remote_only"
    ).join(skill_lists(skills), "user_id", "full_outer")
    # Only as much of the text as any prompt shows goes through the joins.
    listed = postings.select(
        "job_id", "title", "company", _start_of("description", max(MATCH_DESCRIPTION, BULLET_DESCRIPTION, LETTER_DESCRIPTION)).alias("description"),
        "tags", "remote", "salary_min", "salary_max",
    )
    return join_hot(pairs.select("user_id", "job_id"), people, ["user_id"], "left").join(listed, "job_id")


def unknown_jobs(pairs: DataFrame, postings: DataFrame) -> DataFrame:
    """Pairs that get no prompt because the posting does not exist."""
    return not_in(pairs, postings, ["job_id"], unique=True).withColumn("reason", F.lit("job not found"))


def _shown(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("none"))


def _lines(*parts: tuple[str, Column]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), value) for name, value in parts])


def _listed(col: Column) -> Column:
    return text_or(F.array_join(col, ", "), UNSPECIFIED)


def _start_of(description: str, size: int) -> Column:
    return F.substring(F.coalesce(F.col(description), F.lit("")), 1, size)


def match_prompts(context: DataFrame) -> DataFrame:
    """Ask how well a posting fits a profile."""
    body = _lines(
        ("Headline", text_or(F.col("headline"), UNSPECIFIED)),
        ("Summary", text_or(F.col("summary"), UNSPECIFIED)),
        ("Roles wanted", _listed(F.col("target_roles"))),
        ("Skills", text_or(F.col("skills"), UNSPECIFIED)),
        ("Remote only", _shown(F.col("remote_only"))),
        ("Least salary", _shown(F.col("min_salary"))),
        ("Position", F.coalesce("title", F.lit(""))),
        ("Company", text_or(F.col("company"), UNKNOWN_COMPANY)),
        ("Remote", _shown(F.col("remote"))),
        ("Pay from", _shown(F.col("salary_min"))),
        ("Pay to", _shown(F.col("salary_max"))),
        ("Tags", _listed(F.col("tags"))),
        ("Text", _start_of("description", MATCH_DESCRIPTION)),
    )
    task = "Say in a few sentences how well this position fits the person, naming overlaps and gaps."
    return context.select("user_id", "job_id", F.concat(body, F.lit(f"\n\n{task}")).alias("prompt"))


def draft_prompts(context: DataFrame, kind: Column) -> DataFrame:
    """Ask for a resume bullet, or for a cover letter with any other kind."""
    job = (
        ("Position", F.coalesce("title", F.lit(""))),
        ("Company", text_or(F.col("company"), UNKNOWN_COMPANY)),
    )
    skills = ("Skills", text_or(F.col("skills"), UNSPECIFIED))
    either = text_or(F.col("summary"), text_or(F.col("headline"), UNSPECIFIED))
    bullet = F.concat(
        _lines(("Summary", either), skills, *job, ("Text", _start_of("description", BULLET_DESCRIPTION))),
        F.lit("\n\nWrite one resume line that fits this position."),
    )
    letter = F.concat(
        _lines(
            ("Headline", text_or(F.col("headline"), UNSPECIFIED)),
            ("Summary", text_or(F.col("summary"), UNSPECIFIED)),
            skills,
            *job,
            ("Text", _start_of("description", LETTER_DESCRIPTION)),
        ),
        F.lit("\n\nWrite three short paragraphs for a cover letter to this position."),
    )
    is_bullet = F.coalesce(kind == "resume_bullet", F.lit(False))
    return context.select(
        "user_id",
        "job_id",
        F.when(is_bullet, "resume_bullet").otherwise("cover_letter").alias("kind"),
        F.when(is_bullet, bullet).otherwise(letter).alias("prompt"),
    )
