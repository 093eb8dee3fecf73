import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trackweave import schemas
from trackweave.operators import reports, tracking
from trackweave.operators.integrity import TableRules, cascade_delete, constraint_report, constraint_violations

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def one_by_one(saved, commands):
    """Apply commands in order to {(user, job): row}; returns (table, rejects)."""
    table = {(r[1], r[2]): list(r) for r in saved}
    rejects = []
    for user, job, seq, ts, op, stage, score in sorted(commands, key=lambda c: c[2]):
        if op == "save":
            stage = "saved" if stage is None else stage
            if stage not in schemas.STAGES:
                rejects.append((seq, "invalid stage"))
            elif (user, job) in table:
                row = table[(user, job)]
                row[3], row[6] = stage, ts
            else:
                table[(user, job)] = [None, user, job, stage, score, ts, ts]
        elif op == "update" and stage in schemas.STAGES:
            if (user, job) not in table:
                rejects.append((seq, "not saved"))
            else:
                row = table[(user, job)]
                row[3], row[6] = stage, ts
        else:
            rejects.append((seq, "invalid stage"))
    return {k: tuple(v) for k, v in table.items()}, rejects


COMMAND = st.tuples(
    st.integers(1, 3), st.sampled_from("ab"), st.sampled_from(["save", "update", "update", "drop"]),
    st.sampled_from(["saved", "applied", "interviewing", "rejected", "offer", "bogus", None]),
    st.one_of(st.none(), st.floats(0, 1)),
)


@settings(max_examples=12, deadline=None)
@given(st.lists(COMMAND, max_size=60), st.sets(st.tuples(st.integers(1, 3), st.sampled_from("ab"))), st.integers(0, 60))
def test_fold_equals_one_by_one(spark, drawn, existing, cut):
    saved = [(i + 1, u, j, "applied", 0.5, at(-60), at(-50)) for i, (u, j) in enumerate(sorted(existing))]
    commands = [(u, j, i, at(i), op, stage, score) for i, (u, j, op, stage, score) in enumerate(drawn)]
    want, want_rejects = one_by_one(saved, commands)
    table = spark.createDataFrame(saved, schemas.SAVED_JOBS)
    batch = spark.createDataFrame(commands, schemas.COMMANDS).repartition(3)

    def keyed(df):
        return {(r["user_id"], r["job_id"]): tuple(r) for r in df.collect()}

    assert keyed(tracking.fold_commands(table, batch)) == want
    rejected = tracking.rejected_commands(table, batch).select("seq", "reason").collect()
    assert sorted(map(tuple, rejected)) == sorted(want_rejects)
    first = tracking.fold_commands(table, batch.filter(F.col("seq") < cut))
    assert keyed(tracking.fold_commands(first, batch.filter(F.col("seq") >= cut))) == want
    assert keyed(tracking.fold_commands(tracking.fold_commands(table, batch), batch)).keys() == want.keys()


def test_first_applied_and_recording(spark):
    saved = spark.createDataFrame([(1, 1, "a", "saved", None, at(0), at(0)), (2, 2, "a", "saved", None, at(0), at(0))], schemas.SAVED_JOBS)
    commands = spark.createDataFrame(
        [
            (1, "a", 1, at(1), "update", "applied", None), (1, "a", 2, at(2), "save", "applied", None),
            (2, "a", 3, at(3), "update", "offer", None), (3, "a", 4, at(4), "update", "applied", None),
        ],
        schemas.COMMANDS,
    )
    applied = tracking.first_applied(saved, commands)
    assert [(r["user_id"], r["applied_at"]) for r in applied.collect()] == [(1, at(1))]
    empty = spark.createDataFrame([], schemas.APPLICATIONS)
    recorded = tracking.record_applied(empty, saved, applied)
    assert [(r["saved_job_id"], r["applied_at"]) for r in recorded.collect()] == [(1, at(1))]
    later = applied.withColumn("applied_at", F.lit(at(9)))
    assert tracking.record_applied(recorded, saved, later).first()["applied_at"] == at(1)


def test_drafts(spark):
    saved = spark.createDataFrame([(7, 1, "a", "offer", 0.3, at(0), at(0))], schemas.SAVED_JOBS)
    applications = spark.createDataFrame([(7, "old letter", "old bullet", at(0), at(0))], schemas.APPLICATIONS)
    postings = spark.createDataFrame([("a",), ("b",)], "job_id string")
    drafts = spark.createDataFrame(
        [
            (1, "a", 1, at(1), "resume_bullet", "b1"), (1, "a", 2, at(2), "resume_bullet", "b2"),
            (2, "b", 3, at(3), "cover_letter", "l1"), (2, "b", 4, at(4), "something", "l2"),
            (2, "b", 5, at(5), "resume_bullet", "b3"), (3, "x", 6, at(6), "cover_letter", "lost"),
        ],
        schemas.DRAFTS,
    )
    result = tracking.apply_drafts(saved, applications, drafts, postings)
    stored = {(r["user_id"], r["job_id"]): r for r in result.saved.collect()}
    assert stored[(1, "a")]["stage"] == "offer" and stored[(2, "b")]["stage"] == "saved"
    assert stored[(2, "b")]["saved_job_id"] == 8 and stored[(2, "b")]["saved_at"] == at(3)
    texts = {r["saved_job_id"]: tuple(r) for r in result.applications.collect()}
    assert texts == {7: (7, "old letter", "b2", at(0), at(2)), 8: (8, "l2", "b3", None, at(5))}
    assert [(r["seq"], r["reason"]) for r in result.rejected.collect()] == [(6, "job not found")]


def test_notes_users_and_skills(spark):
    saved = spark.createDataFrame([(7, 1, "a", "saved", None, at(0), at(0))], schemas.SAVED_JOBS)
    notes = spark.createDataFrame(
        [(1, "a", 1, at(1), " call \n", None), (1, "a", 2, at(2), " \t", at(3)), (2, "a", 3, at(3), "x", None), (1, "a", 4, at(4), None, None)],
        schemas.NOTE_COMMANDS,
    )
    assert [(r["saved_job_id"], r["note_text"]) for r in tracking.accepted_notes(saved, notes).collect()] == [(7, "call")]
    reasons = {(r["seq"], r["reason"]) for r in tracking.rejected_notes(saved, notes).collect()}
    assert reasons == {(2, "note is empty"), (3, "not saved"), (4, "note is empty")}

    stored = spark.createDataFrame([(3, 7, "old", None, at(0))], schemas.NOTES)
    assert [(r["note_id"], r["note_text"]) for r in tracking.notes_to_append(stored, saved, notes).collect()] == [(4, "call")]

    users = spark.createDataFrame([(5, "a@x", "A", at(0))], schemas.USERS)
    profiles = spark.createDataFrame([(1, 5, "h", None, None, None, None, True, at(0))], schemas.PROFILES)
    wanted = spark.createDataFrame([("a@x", "other"), ("b@x", "B"), ("b@x", None), (None, "no")], "email string, full_name string")
    now = F.lit(at(9))
    all_users, all_profiles = tracking.get_or_create_users(users, profiles, wanted, now)
    assert {(r["user_id"], r["email"], r["full_name"]) for r in all_users.collect()} == {(5, "a@x", "A"), (6, "b@x", "B")}
    assert {(r["profile_id"], r["user_id"], r["remote_only"]) for r in all_profiles.collect()} == {(1, 5, True), (2, 6, False)}
    again, same = tracking.get_or_create_users(all_users, all_profiles, wanted, now)
    assert again.count() == 2 and same.count() == 2

    forms = spark.createDataFrame([(1, 1, [(" sql ", 2.0), (" ", 1.0)])], "user_id int, seq int, skills array<struct<name string, value double>>")
    assert [r["skill_name"] for r in tracking.cleaned_skills(tracking.skill_rows(forms)).collect()] == ["sql"]
    skills = spark.createDataFrame([(1, "sql", 2.5), (1, "C", None), (2, "go", 4.0)], "user_id int, skill_name string, years_experience double")
    assert [r["skill_name"] for r in reports.skills_of(skills, 1).collect()] == ["C", "sql"]
    assert reports.profile_of(profiles, 5).count() == 1 and reports.profile_of(profiles, 6).count() == 0
    lists = {r["user_id"]: r["skills"] for r in reports.skill_lists(skills).collect()}
    assert lists == {1: "C, sql (2.5y)", 2: "go (4.0y)"}


def tracked(spark):
    week = dt.timedelta(days=7)
    tick = dt.timedelta(microseconds=1)
    saved = spark.createDataFrame(
        [
            (1, 1, "a", "applied", None, START, START - week), (2, 1, "b", "applied", None, START, START - week - tick),
            (3, 1, "a", "saved", None, START, START - 2 * week), (4, 2, "b", "interviewing", None, START, START - 3 * week),
            (5, 1, "gone", "applied", None, START, START - 3 * week), (6, 1, "b", "interviewing", None, START, START - 2 * week),
        ],
        schemas.SAVED_JOBS,
    )
    postings = spark.createDataFrame(
        [("a", "Dev", None, None, True, None), ("b", "Ops", "Acme", "X", None, "u")],
        "job_id string, title string, company string, location string, remote boolean, url string",
    )
    return saved, postings


def test_lists(spark):
    saved, postings = tracked(spark)
    stale = reports.stale_jobs(saved, postings, F.lit(START), user_id=1)
    assert [r["saved_job_id"] for r in stale.collect()] == [6, 2], "strictly older, oldest first"
    listed = reports.tracked_jobs(saved, postings, user_id=1)
    assert [r["saved_job_id"] for r in listed.collect()] == [1, 2, 3, 6]
    assert len(listed.columns) == 11
    assert reports.tracked_jobs(saved, postings, user_id=1, stage="").count() == 4
    assert reports.tracked_jobs(saved, postings, user_id=1, stage="saved").count() == 1
    everyone = reports.stale_jobs(saved, postings, F.lit(START))
    banner = sorted((r["user_id"], r["stale_total"], r["label"]) for r in reports.stale_banner(everyone).collect())
    assert banner == [(1, 2, "Ops at Acme"), (1, 2, "Ops at Acme"), (2, 1, "Ops at Acme")]
    counts = {(r["stage"], r["is_total"]): r["jobs"] for r in reports.stage_counts(saved).collect()}
    assert counts == {("applied", 0): 3, ("saved", 0): 1, ("interviewing", 0): 2, (None, 1): 6}


def test_banner_has_every_job_once(spark):
    stale = spark.range(1000).select(
        F.lit(1).alias("user_id"), F.col("id").alias("saved_job_id"), F.lit(START).alias("updated_at"),
        F.concat(F.lit("t"), "id").alias("title"), F.lit(None).cast("string").alias("company"),
    )
    rows = reports.stale_banner(stale).orderBy("updated_at", "saved_job_id").collect()
    assert [r["label"] for r in rows] == [f"t{i} at unknown company" for i in range(1000)]
    assert {r["stale_total"] for r in rows} == {1000}


def test_followups_history_drafts(spark):
    saved, _ = tracked(spark)
    notes = spark.createDataFrame(
        [(1, 1, "n", at(1), at(0)), (2, 1, "n", at(2), at(0)), (3, 1, "n", at(99), at(0)), (4, 2, "n", None, at(0)), (5, 77, "n", at(1), at(0))],
        schemas.NOTES,
    )
    due = reports.followups_due(notes, saved, F.lit(at(10))).collect()
    assert [(r["saved_job_id"], r["note_id"]) for r in due] == [(1, 2)]
    messages = spark.createDataFrame([(1, i, "user", str(i)) for i in range(13)] + [(2, 0, "user", "x")], schemas.MESSAGES)
    kept = sorted((r["conv_id"], r["turn"]) for r in reports.recent_messages(messages).collect())
    assert kept == [(1, i) for i in range(1, 13)] + [(2, 0)]
    applications = spark.createDataFrame([(1, "letter", None, None, at(0))], schemas.APPLICATIONS)
    drafted = {r["saved_job_id"]: r["cover_letter"] for r in reports.tracked_with_drafts(saved, applications).collect()}
    assert drafted == {1: "letter", 2: None, 3: None, 4: None, 5: None, 6: None}


def test_constraints(spark):
    contacts = spark.createDataFrame(
        [(1, 7, "A", None, None, None, at(0)), (1, None, None, None, None, None, at(0)), (2, 99, "B", None, None, None, at(0)), (None, 99, "C", None, None, None, at(0))],
        schemas.CONTACTS,
    )
    saved, _ = tracked(spark)
    saved = saved.unionByName(spark.createDataFrame([(7, 1, "a", "bogus", None, at(0), at(0)), (8, 1, "q", None, None, at(0), at(0))], schemas.SAVED_JOBS))
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, None]), (4, None)], "id int, embedding array<float>")
    tables = {
        "contacts": TableRules(contacts, unique=[["contact_id"]], not_null=["name"], references={"saved_job_id": (saved, "saved_job_id")}),
        "saved": TableRules(saved, unique=[["user_id", "job_id"]], allowed={"stage": schemas.STAGES}),
        "vectors": TableRules(vectors, dimension={"embedding": 2}),
    }
    got = {(r["table_name"], r["constraint_name"]): r["violations"] for r in constraint_report(tables).collect()}
    assert got == {
        ("contacts", "not null name"): 1, ("contacts", "unique contact_id"): 1, ("contacts", "references saved_job_id"): 2,
        ("saved", "allowed stage"): 1, ("saved", "unique user_id, job_id"): 2, ("vectors", "dimension embedding"): 2,
    }
    keys = {"contacts": ["contact_id"], "saved": ["saved_job_id"], "vectors": ["id"]}
    rows = {(r["constraint_name"], r["key"], r["rows"]) for r in constraint_violations(tables, keys).collect()}
    assert rows == {
        ("not null name", '{"contact_id":1}', 1), ("unique contact_id", '{"contact_id":1}', 2),
        ("references saved_job_id", '{"saved_job_id":99}', 2), ("allowed stage", '{"saved_job_id":7}', 1),
        ("unique user_id, job_id", '{"user_id":1,"job_id":"a"}', 3), ("unique user_id, job_id", '{"user_id":1,"job_id":"b"}', 2),
        ("dimension embedding", '{"id":2}', 1), ("dimension embedding", '{"id":3}', 1),
    }


def test_keys_that_look_alike_stay_apart(spark):
    rows = spark.createDataFrame([("a|b", "c", None), ("a", "b|c", None), ("", "x", None), (None, "x", None)], "p string, q string, v int")
    found = constraint_violations({"t": TableRules(rows, not_null=["v"])}, {"t": ["p", "q"]}).collect()
    assert len({r["key"] for r in found}) == 4 and {r["rows"] for r in found} == {1}


def test_cascade(spark):
    saved, _ = tracked(spark)
    tables = {
        "users": spark.createDataFrame([(1,), (2,)], "user_id int"),
        "postings": spark.createDataFrame([("a",), ("b",)], "job_id string"),
        "saved_jobs": saved,
        "chunks": spark.createDataFrame([("a", 0), ("b", 0)], "job_id string, chunk_index int"),
        "applications": spark.createDataFrame([(i,) for i in range(1, 7)], "saved_job_id int"),
        "contacts": spark.createDataFrame([(1, 1), (2, 4), (3, None)], "contact_id int, saved_job_id int"),
    }
    doomed = {"users": spark.createDataFrame([(2,)], "user_id int"), "postings": spark.createDataFrame([("a",)], "job_id string")}
    left = cascade_delete(tables, doomed)
    ids = {name: sorted(r[0] if r[0] is not None else -1 for r in df.collect()) for name, df in left.items()}
    assert ids["users"] == [1] and ids["postings"] == ["b"] and ids["saved_jobs"] == [2, 5, 6]
    assert ids["chunks"] == ["b"] and ids["applications"] == [2, 5, 6] and ids["contacts"] == [3]
