"""Batches of save / stage / draft / note commands folded into tables.

A batch gives the same tables as its commands applied one at a time in ``seq``
order. The folds are min_by / max_by aggregations over fixed-width values, so
they stay hash aggregations with map-side combining: a (user, job) pair with a
third of all commands sends one partial row per map task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trackweave.functions.text import not_blank, strip_text
from trackweave.operators.keyed import assign_ids, join_hot, latest_per_key, not_in, only_in, upsert
from trackweave.schemas import STAGES
from trackweave.session import materialize

PAIR = ["user_id", "job_id"]


def _stage_code(stage: Column) -> Column:
    """1-based position among the valid stages; 0 for anything else or NULL."""
    names = F.array(*[F.lit(s) for s in STAGES])
    return F.coalesce(F.array_position(names, stage), F.lit(0)).cast("int")


def _stage_name(code: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STAGES]), code - 1)


def coded_commands(commands: DataFrame) -> DataFrame:
    """Add ``code`` (0 = invalid stage) and ``is_save``; a save without stage saves as 'saved'."""
    saving = F.coalesce(F.col("op") == "save", F.lit(False))
    stage = F.when(saving, F.coalesce("stage", F.lit("saved"))).otherwise(F.col("stage"))
    known_op = F.coalesce(F.col("op").isin("save", "update"), F.lit(False))
    return commands.withColumns(
        {"code": F.when(known_op, _stage_code(stage)).otherwise(0), "is_save": saving}
    )


def fold_commands(saved: DataFrame, commands: DataFrame) -> DataFrame:
    """The saved-jobs table after the whole batch.

    The last valid command of a pair decides stage and updated_at if the pair
    is in the table or has a valid save in the batch: a save is valid itself,
    so no rejected update can come after the last accepted command. saved_at
    and match_score come from the table, else from the first valid save.
    """
    seq_of_save = F.when(F.col("is_save"), F.col("seq"))
    batch = (
        coded_commands(commands)
        .filter(F.col("code") > 0)
        .groupBy(*PAIR)
        .agg(
            F.min(seq_of_save).alias("_first_save"),
            F.min_by("ts", seq_of_save).alias("_saved_at"),
            F.min_by("match_score", seq_of_save).alias("_score"),
            F.max_by("code", "seq").alias("_code"),
            F.max_by("ts", "seq").alias("_ts"),
        )
    )
    joined = saved.withColumn("_known", F.lit(True)).join(batch, PAIR, "full_outer")
    known = F.col("_known").isNotNull()
    folded = {
        "stage": F.coalesce(_stage_name(F.col("_code")), F.col("stage")),
        "match_score": F.when(known, F.col("match_score")).otherwise(F.col("_score")),
        "saved_at": F.when(known, F.col("saved_at")).otherwise(F.col("_saved_at")),
        "updated_at": F.coalesce("_ts", "updated_at"),
    }
    return joined.filter(known | F.col("_first_save").isNotNull()).select(
        *[folded[c].alias(c) if c in folded else F.col(c) for c in saved.columns]
    )


def _saved_since(saved: DataFrame, coded: DataFrame) -> DataFrame:
    """Per pair the seq from which it counts as saved; one row per pair."""
    before = saved.select(*PAIR, F.lit(-(2**63)).cast("bigint").alias("since"))
    during = coded.filter(F.col("is_save") & (F.col("code") > 0)).select(*PAIR, F.col("seq").alias("since"))
    return before.unionByName(during).groupBy(*PAIR).agg(F.min("since").alias("since"))


def judged_commands(saved: DataFrame, commands: DataFrame) -> DataFrame:
    """Every command with the ``reason`` it is rejected for, or NULL if accepted.

    The join's right side has one row per pair, so only the commands can be
    skewed, and those are split.
    """
    coded = coded_commands(commands)
    judged = join_hot(coded, _saved_since(saved, coded), PAIR, "left")
    late = F.coalesce(F.col("seq") >= F.col("since"), F.lit(False))
    reason = F.when(F.col("code") == 0, "invalid stage").when(~late, "not saved")
    return judged.withColumn("reason", reason).drop("code", "is_save", "since")


def rejected_commands(saved: DataFrame, commands: DataFrame) -> DataFrame:
    return judged_commands(saved, commands).filter(F.col("reason").isNotNull())


def first_applied(saved: DataFrame, commands: DataFrame) -> DataFrame:
    """Per pair the time of the first accepted move to 'applied'."""
    applied = judged_commands(saved, commands).filter(
        F.col("reason").isNull() & (F.col("stage") == "applied")
    )
    return applied.groupBy(*PAIR).agg(F.min_by("ts", "seq").alias("applied_at"))


def record_applied(applications: DataFrame, saved: DataFrame, applied: DataFrame) -> DataFrame:
    """Write applied_at into the applications table; an earlier value stays."""
    changes = applied.join(saved.select(*PAIR, "saved_job_id"), PAIR).select(
        "saved_job_id", "applied_at", F.col("applied_at").alias("last_updated_at")
    )
    fresh = not_in(changes, applications.filter(F.col("applied_at").isNotNull()), ["saved_job_id"], unique=True)
    return upsert(applications, fresh, ["saved_job_id"], ["applied_at", "last_updated_at"])


@dataclass(frozen=True)
class DraftResult:
    saved: DataFrame
    applications: DataFrame
    rejected: DataFrame


def apply_drafts(
    saved: DataFrame, applications: DataFrame, drafts: DataFrame, postings: DataFrame
) -> DraftResult:
    """Store drafted texts, saving unsaved jobs first.

    Any kind but 'resume_bullet' is a cover letter. The last draft of a kind
    wins and leaves the other column alone. An existing stage stays. Drafts for
    unknown postings are rejected.
    """
    bullet = F.coalesce(F.col("kind") == "resume_bullet", F.lit(False))
    accepted = only_in(drafts, postings, ["job_id"], unique=True)
    # One aggregation over fixed-width values; texts are fetched for the winners only.
    pairs = materialize(accepted.groupBy(*PAIR).agg(
        F.min_by("ts", "seq").alias("saved_at"), F.max_by("ts", "seq").alias("_ts"),
        F.max(F.when(~bullet, F.col("seq"))).alias("_letter_seq"), F.max(F.when(bullet, F.col("seq"))).alias("_bullet_seq"),
    ), "draft-pairs")
    implied = pairs.select(*PAIR, "saved_at").withColumns({"stage": F.lit("saved"), "updated_at": F.col("saved_at")})
    # both result tables need the new ids: number the new pairs once and keep them
    numbered = materialize(
        assign_ids(not_in(implied, saved, PAIR, unique=True), PAIR, "saved_job_id", after=saved), "new-pairs"
    )
    all_saved = saved.unionByName(numbered, allowMissingColumns=True)

    last = join_hot(
        drafts.select(*PAIR, "seq", "text", bullet.alias("_bullet")), pairs.select(*PAIR, "_letter_seq", "_bullet_seq"), PAIR, "inner"
    ).filter(F.col("seq") == F.when(F.col("_bullet"), F.col("_bullet_seq")).otherwise(F.col("_letter_seq")))
    texts = last.groupBy(*PAIR).agg(  # two rows per pair
        F.max(F.when(~F.col("_bullet"), F.col("text"))).alias("_cover_letter"),
        F.max(F.when(F.col("_bullet"), F.col("text"))).alias("_resume_bullet"),
    )
    per_pair = texts.join(pairs.select(*PAIR, "_ts"), PAIR)
    changes = per_pair.join(all_saved.select(*PAIR, "saved_job_id"), PAIR)
    rows = applications.withColumn("_known", F.lit(True)).join(
        changes.select("saved_job_id", "_cover_letter", "_resume_bullet", "_ts"),
        "saved_job_id",
        "full_outer",
    )
    merged = {
        "cover_letter": F.coalesce("_cover_letter", "cover_letter"),
        "resume_bullet": F.coalesce("_resume_bullet", "resume_bullet"),
        "last_updated_at": F.coalesce("_ts", "last_updated_at"),
    }
    new_applications = rows.select(
        *[merged[c].alias(c) if c in merged else F.col(c) for c in applications.columns]
    )
    return DraftResult(all_saved, new_applications, rejected_drafts(drafts, postings))


def rejected_drafts(drafts: DataFrame, postings: DataFrame) -> DataFrame:
    """Drafts for postings that do not exist."""
    return not_in(drafts, postings, ["job_id"], unique=True).withColumn("reason", F.lit("job not found"))


def accepted_notes(saved: DataFrame, notes: DataFrame) -> DataFrame:
    """Note rows to append: blank notes skipped, pairs must be saved already."""
    kept = notes.filter(not_blank(F.col("note_text")))
    return kept.join(saved.select(*PAIR, "saved_job_id"), PAIR).select(
        "saved_job_id",
        "seq",
        strip_text(F.col("note_text")).alias("note_text"),
        "follow_up_at",
        F.col("ts").alias("created_at"),
    )


def notes_to_append(stored: DataFrame, saved: DataFrame, notes: DataFrame) -> DataFrame:
    """Accepted notes with ids that continue the stored ones; append these."""
    kept = accepted_notes(saved, notes)
    return assign_ids(kept, ["saved_job_id", "seq"], "note_id", after=stored).drop("seq")


def rejected_notes(saved: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes with their reason: blank text, or a pair that is not saved."""
    blank = ~not_blank(F.col("note_text"))
    return (
        notes.filter(blank)
        .withColumn("reason", F.lit("note is empty"))
        .unionByName(
            not_in(notes.filter(~blank), saved, PAIR, unique=True).withColumn("reason", F.lit("not saved"))
        )
    )


def get_or_create_users(
    users: DataFrame, profiles: DataFrame, wanted: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Users and profiles with every wanted email present; new ones get an empty profile.

    ``wanted`` has email and full_name. Running it twice changes nothing.
    """
    named = latest_per_key(wanted.filter(F.col("email").isNotNull()), ["email"], [F.asc_nulls_last("full_name")])
    new = assign_ids(not_in(named, users, ["email"], unique=True), ["email"], "user_id", after=users)
    new = new.withColumn("created_at", as_of.cast(users.schema["created_at"].dataType))
    all_users = users.unionByName(new.select("user_id", "email", "full_name", "created_at"))
    empty = not_in(new.select("user_id"), profiles, ["user_id"], unique=True)
    numbered = assign_ids(empty, ["user_id"], "profile_id", after=profiles).withColumns(
        {
            "remote_only": F.lit(False),
            "updated_at": as_of.cast(profiles.schema["updated_at"].dataType),
        }
    )
    return all_users, profiles.unionByName(numbered, allowMissingColumns=True)


def skill_rows(forms: DataFrame) -> DataFrame:
    """Explode (user_id, seq, skills array<struct<name, value>>) to one row per skill."""
    return forms.select("user_id", "seq", F.posexplode("skills").alias("pos", "skill")).select(
        "user_id",
        "seq",
        "pos",
        F.col("skill.name").alias("skill_name"),
        F.col("skill.value").alias("years_experience"),
    )


def cleaned_skills(rows: DataFrame) -> DataFrame:
    """Strip skill names and drop the blank ones."""
    return rows.filter(not_blank(F.col("skill_name"))).withColumn(
        "skill_name", strip_text(F.col("skill_name"))
    )
