"""State-change, report and integrity queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from trackweave import schemas
from trackweave.operators import integrity, keyed, reports, tracking
from trackweave.plans.registry import Tables, query
from trackweave.session import work_dir
from trackweave.sources.tables import KeyedTable
from trackweave.streaming import state, streams

# --- commands: events as save / update commands on (user, tens of k) ------------------

# What each event type stands for.
OPS = {
    "view": ("save", "saved"),
    "signup": ("save", "applied"),
    "click": ("update", "interviewing"),
    "purchase": ("update", "offer"),
    "error": ("update", "bogus"),
}


def _tens(col: str = "props"):
    return F.floor(F.get_json_object(col, "$.k").cast("bigint") / 10).cast("string")


def commands_from(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    op, stage = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (its_op, its_stage) in OPS.items():
        op = F.when(kind == name, its_op).otherwise(op)
        stage = F.when(kind == name, its_stage).otherwise(stage)
    return events.select(
        "user_id",
        _tens().alias("job_id"),
        F.col("event_id").alias("seq"),
        "ts",
        op.alias("op"),
        stage.alias("stage"),
        F.col("value").alias("match_score"),
    )


def saved_from_orders(t: Tables) -> DataFrame:
    """Pairs already saved: customer and first digit of the order priority."""
    return t("orders").groupBy(
        F.col("o_custkey").alias("user_id"), F.substring("o_orderpriority", 1, 1).alias("job_id")
    ).agg(
        F.min("o_orderkey").alias("saved_job_id"),
        F.lit("saved").alias("stage"),
        F.min("o_totalprice").alias("match_score"),
        F.min("o_orderdate").alias("saved_at"),
        F.max("o_orderdate").alias("updated_at"),
    ).select("saved_job_id", "user_id", "job_id", "stage", "match_score", "saved_at", "updated_at")


COMMANDS_SQL = """
commands AS (
  SELECT user_id, CAST(CAST(json_extract(props, '$.k') AS BIGINT) // 10 AS VARCHAR) AS job_id, event_id AS seq, ts,
    CASE WHEN event_type IN ('view', 'signup') THEN 'save' ELSE 'update' END AS op,
    CASE event_type WHEN 'view' THEN 'saved' WHEN 'signup' THEN 'applied' WHEN 'click' THEN 'interviewing'
      WHEN 'purchase' THEN 'offer' ELSE 'bogus' END AS stage,
    value AS match_score
  FROM events),
saved AS (
  SELECT min(o_orderkey) AS saved_job_id, o_custkey AS user_id, substr(o_orderpriority, 1, 1) AS job_id, 'saved' AS stage,
    min(o_totalprice) AS match_score, min(o_orderdate) AS saved_at, max(o_orderdate) AS updated_at
  FROM orders GROUP BY o_custkey, substr(o_orderpriority, 1, 1)),
firsts AS (
  SELECT user_id, job_id, min(seq) AS first_save, arg_min(ts, seq) AS first_ts, arg_min(match_score, seq) AS first_score
  FROM commands WHERE op = 'save' AND stage <> 'bogus' GROUP BY user_id, job_id),
judged AS (
  SELECT c.*, CASE WHEN c.stage = 'bogus' THEN 'invalid stage'
      WHEN s.user_id IS NULL AND (f.first_save IS NULL OR c.seq < f.first_save) THEN 'not saved' END AS reason
  FROM commands c LEFT JOIN firsts f USING (user_id, job_id) LEFT JOIN saved s USING (user_id, job_id))
"""
FOLD_SQL = f"""
WITH {COMMANDS_SQL},
lasts AS (
  SELECT user_id, job_id, arg_max(stage, seq) AS stage, arg_max(ts, seq) AS ts
  FROM judged WHERE reason IS NULL GROUP BY user_id, job_id)
SELECT user_id, job_id, coalesce(l.stage, s.stage) AS stage,
  CASE WHEN s.saved_job_id IS NULL THEN first_score ELSE s.match_score END AS match_score,
  CAST(CASE WHEN s.saved_job_id IS NULL THEN first_ts ELSE s.saved_at END AS VARCHAR) AS saved_at,
  CAST(coalesce(l.ts, s.updated_at) AS VARCHAR) AS updated_at
FROM saved s FULL JOIN lasts l USING (user_id, job_id) LEFT JOIN firsts f USING (user_id, job_id)
"""


def _shown(saved: DataFrame) -> DataFrame:
    return saved.select(
        "user_id", "job_id", "stage", "match_score",
        F.col("saved_at").cast("string").alias("saved_at"), F.col("updated_at").cast("string").alias("updated_at"),
    )


@query(FOLD_SQL)
def stage_fold(t: Tables) -> DataFrame:
    return _shown(tracking.fold_commands(saved_from_orders(t), commands_from(t("events"))))


@query(FOLD_SQL)
def stage_fold_two_batches(t: Tables) -> DataFrame:
    """The same commands in two batches, the second on top of the first's table."""
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    events = t("events")
    first = tracking.fold_commands(saved_from_orders(t), commands_from(events.filter(F.col("ts") < cut)))
    return _shown(tracking.fold_commands(first, commands_from(events.filter(F.col("ts") >= cut))))


@query(FOLD_SQL)
def stage_fold_stream(t: Tables) -> DataFrame:
    """The same commands as a stream into a keyed table."""
    folder = f"{work_dir(t.spark)}/fold-{uuid.uuid4().hex}"
    schema = schemas.SAVED_JOBS.replace("timestamp", "timestamp_ntz")
    store = KeyedTable(t.spark, f"{folder}/saved", schema, tracking.PAIR, parts=4, buckets=8)
    store.append(saved_from_orders(t))
    streams.command_stream(
        commands_from(t.stream("events")), store, f"{folder}/rejects", f"{folder}/progress"
    ).awaitTermination()
    return _shown(store.read())


def _folded(t: Tables) -> tuple[DataFrame, str]:
    """The table that the commands start from, and what their stream gave, held as keyed state."""
    saved, folder = saved_from_orders(t), f"{work_dir(t.spark)}/state-{uuid.uuid4().hex}"
    state.fold_stream(commands_from(t.stream("events")), saved, f"{folder}/events", f"{folder}/progress").awaitTermination()
    return saved, f"{folder}/events"


@query(FOLD_SQL)
def stage_fold_state(t: Tables) -> DataFrame:
    """The same commands as a stream into Spark's state store."""
    return _shown(state.folded_table(*_folded(t)))


@query(f"WITH {COMMANDS_SQL} SELECT user_id, job_id, seq, op, stage, reason FROM judged WHERE reason IS NOT NULL")
def stage_rejects_state(t: Tables) -> DataFrame:
    """The rejects of that stream."""
    return state.folded_rejects(t.spark, _folded(t)[1])


@query(f"WITH {COMMANDS_SQL} SELECT user_id, job_id, seq, op, stage, reason FROM judged WHERE reason IS NOT NULL")
def stage_rejects(t: Tables) -> DataFrame:
    rejects = tracking.rejected_commands(saved_from_orders(t), commands_from(t("events")))
    return rejects.select("user_id", "job_id", "seq", "op", "stage", "reason")


@query(f"""
WITH {COMMANDS_SQL}
SELECT saved_job_id, CAST(applied_at AS VARCHAR) AS applied_at FROM saved JOIN (
  SELECT user_id, job_id, arg_min(ts, seq) AS applied_at FROM judged WHERE reason IS NULL AND stage = 'applied'
  GROUP BY user_id, job_id) USING (user_id, job_id)
""")
def first_applied(t: Tables) -> DataFrame:
    saved = saved_from_orders(t)
    applications = t.spark.createDataFrame([], schemas.APPLICATIONS.replace("timestamp", "timestamp_ntz"))
    applied = tracking.first_applied(saved, commands_from(t("events")))
    recorded = tracking.record_applied(applications, saved, applied)
    return recorded.select("saved_job_id", F.col("applied_at").cast("string"))


# --- drafts and notes -----------------------------------------------------------------


def _drafts(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t("events").select(
        "user_id",
        F.get_json_object("props", "$.k").alias("job_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(kind.isin("click", "error"), "resume_bullet").when(kind == "purchase", "other").otherwise("cover_letter").alias("kind"),
        F.concat("event_type", F.lit("-"), "event_id").alias("text"),
    )


def _known_jobs(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_size").cast("string").alias("job_id")).distinct()


DRAFTS_SQL = f"""
WITH {COMMANDS_SQL},
drafts AS (
  SELECT user_id, json_extract_string(props, '$.k') AS job_id, event_id AS seq, ts,
    CASE WHEN event_type IN ('click', 'error') THEN 'resume_bullet' ELSE 'cover_letter' END AS kind,
    event_type || '-' || event_id AS text
  FROM events),
known AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS job_id FROM part),
texts AS (
  SELECT user_id, job_id, arg_max(text, seq) FILTER (WHERE kind = 'cover_letter') AS cover_letter,
    arg_max(text, seq) FILTER (WHERE kind = 'resume_bullet') AS resume_bullet, max(ts) AS ts, min(ts) AS first_ts
  FROM drafts WHERE job_id IN (SELECT job_id FROM known) GROUP BY user_id, job_id)
"""


@query(f"""
{DRAFTS_SQL}
SELECT user_id, job_id, coalesce(s.stage, 'saved') AS stage,
  CAST(coalesce(s.saved_at, first_ts) AS VARCHAR) AS saved_at,
  coalesce(t.cover_letter, CASE WHEN s.user_id IS NOT NULL THEN 'letter ' || s.saved_job_id END) AS cover_letter,
  t.resume_bullet, CAST(coalesce(t.ts, s.updated_at) AS VARCHAR) AS last_updated_at
FROM saved s FULL JOIN texts t USING (user_id, job_id)
""")
def draft_upsert(t: Tables) -> DataFrame:
    """Drafts stored on applications; every job saved before has a letter already."""
    saved = saved_from_orders(t)
    applications = saved.select(
        "saved_job_id",
        F.concat(F.lit("letter "), "saved_job_id").alias("cover_letter"),
        F.lit(None).cast("string").alias("resume_bullet"),
        F.lit(None).cast("timestamp_ntz").alias("applied_at"),
        F.col("updated_at").alias("last_updated_at"),
    )
    result = tracking.apply_drafts(saved, applications, _drafts(t), _known_jobs(t))
    return reports.tracked_with_drafts(result.saved, result.applications).select(
        "user_id", "job_id", "stage", F.col("saved_at").cast("string"), "cover_letter", "resume_bullet",
        F.col("last_updated_at").cast("string"),
    )


@query(f"{DRAFTS_SQL} SELECT user_id, job_id, seq, kind, 'job not found' AS reason FROM drafts WHERE job_id NOT IN (SELECT job_id FROM known)")
def draft_rejects(t: Tables) -> DataFrame:
    rejected = tracking.rejected_drafts(_drafts(t), _known_jobs(t))
    kind = F.when(F.col("kind") == "resume_bullet", "resume_bullet").otherwise("cover_letter")
    return rejected.select("user_id", "job_id", "seq", kind.alias("kind"), "reason")


def _notes(t: Tables) -> DataFrame:
    return t("events").select(
        "user_id",
        _tens().alias("job_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(F.col("event_type") == "error", " \t ").otherwise(F.concat(F.lit(" "), "event_type")).alias("note_text"),
        F.when(F.col("event_type") == "click", F.col("ts")).alias("follow_up_at"),
    )


@query(f"""
WITH {COMMANDS_SQL},
notes AS (SELECT c.user_id, c.job_id, c.seq, event_type FROM commands c JOIN events e ON e.event_id = c.seq)
SELECT seq, saved_job_id, event_type AS note_text, CAST(NULL AS VARCHAR) AS reason, event_type = 'click' AS has_follow_up
FROM notes JOIN saved USING (user_id, job_id) WHERE event_type <> 'error'
UNION ALL
SELECT seq, -1, NULL, CASE WHEN event_type = 'error' THEN 'note is empty' ELSE 'not saved' END, event_type = 'click'
FROM notes n WHERE event_type = 'error'
  OR NOT EXISTS (SELECT 1 FROM saved s WHERE s.user_id = n.user_id AND s.job_id = n.job_id)
""")
def interview_notes(t: Tables) -> DataFrame:
    saved, notes = saved_from_orders(t), _notes(t)
    kept = tracking.accepted_notes(saved, notes).select(
        "seq", "saved_job_id", "note_text", F.lit(None).cast("string").alias("reason"),
        F.col("follow_up_at").isNotNull().alias("has_follow_up"),
    )
    lost = tracking.rejected_notes(saved, notes).select(
        "seq", F.lit(-1).cast("bigint").alias("saved_job_id"), F.lit(None).cast("string").alias("note_text"),
        "reason", F.col("follow_up_at").isNotNull().alias("has_follow_up"),
    )
    return kept.unionByName(lost)


@query(f"""
WITH {COMMANDS_SQL},
notes AS (SELECT c.user_id, c.job_id, c.seq, event_type, c.ts FROM commands c JOIN events e ON e.event_id = c.seq),
added AS (SELECT saved_job_id, event_type AS note_text, CAST(ts AS VARCHAR) AS created_at FROM notes JOIN saved USING (user_id, job_id)
  WHERE event_type <> 'error')
SELECT *, true AS continues FROM added
""")
def notes_appended(t: Tables) -> DataFrame:
    """New notes for a table whose last id is 500: ids go on from there without gaps."""
    stored = t.spark.range(1, 501).select(F.col("id").alias("note_id"))
    added = tracking.notes_to_append(stored, saved_from_orders(t), _notes(t))
    ids = F.countDistinct("note_id")
    dense = added.agg((ids == F.count("*")) & (F.min("note_id") == 501) & (F.max("note_id") == 500 + ids)).scalar()
    return added.select(
        "saved_job_id", "note_text", F.col("created_at").cast("string"), dense.alias("continues")
    )


# --- keyed tables ---------------------------------------------------------------------


@query("""
SELECT coalesce(s_suppkey, c_custkey) AS id, coalesce(c_name, s_name) AS name,
  coalesce(s_nationkey, c_nationkey) AS nation, coalesce(c_acctbal, s_acctbal) AS balance,
  CASE WHEN s_suppkey IS NOT NULL THEN 'supplier' ELSE 'customer' END AS source
FROM supplier FULL JOIN customer ON s_suppkey = c_custkey
""")
def upsert_accounts(t: Tables) -> DataFrame:
    """Customers upserted into suppliers: known keys keep nation and source."""
    target = t("supplier").toDF("id", "name", "nation", "balance").withColumn("source", F.lit("supplier"))
    changes = t("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"), F.lit("customer").alias("source"),
    )
    return keyed.upsert(target, changes, ["id"], ["name", "balance"])


@query("""
SELECT c_custkey AS id, coalesce(last_status, c_mktsegment) AS segment, coalesce(last_price, c_acctbal) AS balance
FROM customer FULL JOIN (
  SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS last_status, arg_max(o_totalprice, o_orderkey) AS last_price
  FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
""")
def upsert_stored(t: Tables) -> DataFrame:
    """Latest order of each customer upserted into a stored, bucketed customer table."""
    folder = f"{work_dir(t.spark)}/accounts-{uuid.uuid4().hex}"
    store = KeyedTable(t.spark, folder, "id bigint, segment string, balance double", ["id"], parts=4, buckets=8)
    store.append(t("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
    ))
    changes = t("orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("segment"),
        F.col("o_totalprice").alias("balance"), "o_orderkey",
    )
    store.upsert(changes, ["segment", "balance"], order=[F.desc("o_orderkey")])
    return store.read()


@query("""
SELECT c_custkey AS user_id, coalesce(headline, c_mktsegment) AS headline, coalesce(min_salary, c_acctbal) AS min_salary,
  CAST(stamp AS VARCHAR) AS updated_at
FROM customer LEFT JOIN (
  SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderpriority <> '5-LOW') AS headline,
    arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS min_salary,
    arg_max(o_orderdate, o_orderkey) FILTER (WHERE o_orderpriority <> '5-LOW' OR o_orderstatus = 'F') AS stamp
  FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
""")
def partial_update(t: Tables) -> DataFrame:
    """Orders as profile updates: '' and NULL leave a field as it is."""
    profiles = t("customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("headline"),
        F.col("c_acctbal").alias("min_salary"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
    updates = t("orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("headline"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("min_salary"),
    )
    changed = keyed.partial_update(
        profiles, updates, "user_id", "seq", ["headline", "min_salary"], {"updated_at": "ts"}, blank_is_missing=True
    )
    return changed.withColumn("updated_at", F.col("updated_at").cast("string"))


@query("""
WITH owners AS (SELECT DISTINCT user_id FROM events WHERE ts >= '2024-01-15' AND value > 150),
old AS (SELECT user_id, event_type AS skill_name, max(value) AS years FROM events WHERE ts < '2024-01-15' GROUP BY ALL),
new AS (SELECT user_id, event_type AS skill_name, arg_max(value, event_id) AS years FROM events
  WHERE ts >= '2024-01-15' AND event_type <> 'error' GROUP BY ALL)
SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM owners)
UNION ALL SELECT * FROM new WHERE user_id IN (SELECT user_id FROM owners)
""")
def replace_set(t: Tables) -> DataFrame:
    """Users with a high value late in the month get a new skill set; the last duplicate wins."""
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    before, after = t("events").filter(F.col("ts") < cut), t("events").filter(F.col("ts") >= cut)
    target = before.groupBy("user_id", F.col("event_type").alias("skill_name")).agg(F.max("value").alias("years"))
    owners = after.filter(F.col("value") > 150).select("user_id")
    rows = tracking.cleaned_skills(
        after.select(
            "user_id",
            F.when(F.col("event_type") == "error", " ").otherwise(F.concat(F.lit(" "), "event_type", F.lit("\t"))).alias("skill_name"),
            F.col("value").alias("years"),
            "event_id",
        )
    )
    return keyed.replace_owned(target, owners, rows, "user_id", "skill_name", [F.desc("event_id")])


@query("""
SELECT count(*) AS rows, count(*) AS ids, (SELECT max(o_orderkey) FROM orders) + 1 AS first_id,
  (SELECT max(o_orderkey) FROM orders) + count(*) AS last_id
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
""")
def surrogate_keys(t: Tables) -> DataFrame:
    lines = t("lineitem").select("l_orderkey", "l_linenumber").distinct()
    existing = t("orders").select(F.col("o_orderkey").alias("id"))
    numbered = keyed.assign_ids(lines, ["l_orderkey", "l_linenumber"], "id", after=existing)
    return numbered.agg(
        F.count("*").alias("rows"),
        F.count_distinct("id").alias("ids"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    )


@query("""
SELECT s_name AS email, 'old' AS full_name, false AS has_new_profile FROM supplier
UNION ALL SELECT DISTINCT c_mktsegment || c_nationkey, c_mktsegment, true FROM customer
""")
def get_or_create_users(t: Tables) -> DataFrame:
    """Suppliers are users; customers' segments and nations make new ones."""
    users = t("supplier").select(
        F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("email"), F.lit("old").alias("full_name"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
    profiles = t.spark.createDataFrame([], schemas.PROFILES)
    wanted = t("customer").select(
        F.concat("c_mktsegment", "c_nationkey").alias("email"), F.col("c_mktsegment").alias("full_name")
    ).unionByName(t("supplier").select(F.col("s_name").alias("email"), F.lit("again").alias("full_name")))
    everyone, all_profiles = tracking.get_or_create_users(
        users, profiles, wanted, F.lit("2024-01-01").cast("timestamp")
    )
    has = all_profiles.select("user_id", F.lit(True).alias("_has"))
    return everyone.join(has, "user_id", "left").select(
        "email", "full_name", F.coalesce("_has", F.lit(False)).alias("has_new_profile")
    )


# --- reports --------------------------------------------------------------------------


def _order_tracking(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders as saved jobs on customers as postings."""
    stage = (
        F.when(F.col("o_orderstatus") == "O", "applied")
        .when(F.col("o_orderstatus") == "P", "interviewing")
        .otherwise("offer")
    )
    saved = t("orders").select(
        F.col("o_orderkey").alias("saved_job_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_custkey").alias("job_id"), stage.alias("stage"), F.col("o_totalprice").alias("match_score"),
        F.col("o_orderdate").alias("saved_at"), F.col("o_orderdate").alias("updated_at"),
    )
    postings = t("customer").select(
        F.col("c_custkey").alias("job_id"), F.col("c_name").alias("title"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("company"),
        F.col("c_nationkey").cast("string").alias("location"), (F.col("c_acctbal") > 0).alias("remote"),
        F.concat(F.lit("/c/"), "c_custkey").alias("url"),
    )
    return saved, postings


TRACKED_SQL = """
tracked AS (
  SELECT o_custkey AS user_id, o_orderkey AS saved_job_id, o_custkey AS job_id,
    CASE o_orderstatus WHEN 'O' THEN 'applied' WHEN 'P' THEN 'interviewing' ELSE 'offer' END AS stage,
    o_totalprice AS match_score, o_orderdate, CAST(o_orderdate AS VARCHAR) AS saved_at, CAST(o_orderdate AS VARCHAR) AS updated_at,
    c_name AS title, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS company,
    CAST(c_nationkey AS VARCHAR) AS location, c_acctbal > 0 AS remote, '/c/' || c_custkey AS url
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""
STALE_WHERE = "stage IN ('applied', 'interviewing') AND o_orderdate < TIMESTAMP '1998-08-02' - INTERVAL 7 DAY"


@query(f"WITH {TRACKED_SQL} SELECT * EXCLUDE (o_orderdate) FROM tracked WHERE stage = 'applied'")
def tracked_list(t: Tables) -> DataFrame:
    saved, postings = _order_tracking(t)
    rows = reports.tracked_jobs(saved, postings, stage="applied")
    return rows.withColumns({c: F.col(c).cast("string") for c in ("saved_at", "updated_at")})


@query(f"WITH {TRACKED_SQL} SELECT user_id, saved_job_id, job_id, stage, updated_at, title, company FROM tracked WHERE {STALE_WHERE}")
def stale_list(t: Tables) -> DataFrame:
    saved, postings = _order_tracking(t)
    rows = reports.stale_jobs(saved, postings, F.lit("1998-08-02").cast("timestamp_ntz"))
    return rows.withColumn("updated_at", F.col("updated_at").cast("string"))


@query(f"""
WITH {TRACKED_SQL} SELECT user_id, count(*) OVER (PARTITION BY user_id) AS stale_total, saved_job_id, updated_at,
  title || ' at ' || coalesce(company, 'unknown company') AS label
FROM tracked WHERE {STALE_WHERE}
""")
def stale_banner(t: Tables) -> DataFrame:
    saved, postings = _order_tracking(t)
    stale = reports.stale_jobs(saved, postings, F.lit("1998-08-02").cast("timestamp_ntz"))
    return reports.stale_banner(stale).withColumn("updated_at", F.col("updated_at").cast("string"))


@query(f"""
WITH {TRACKED_SQL} SELECT stage, CAST(grouping(stage) AS INTEGER) AS is_total, count(*) AS jobs FROM tracked GROUP BY ROLLUP (stage)
""")
def stage_counts(t: Tables) -> DataFrame:
    saved, postings = _order_tracking(t)
    return reports.stage_counts(saved.join(postings.select("job_id"), "job_id"))


@query(f"""
WITH {TRACKED_SQL} SELECT user_id, stage, CAST(grouping(stage) AS INTEGER) AS is_total, count(*) AS jobs
FROM tracked GROUP BY GROUPING SETS ((user_id, stage), (user_id))
""")
def stage_counts_by_user(t: Tables) -> DataFrame:
    saved, postings = _order_tracking(t)
    return reports.stage_counts(saved.join(postings.select("job_id"), "job_id"), owner="user_id")


@query(f"""
WITH {TRACKED_SQL} SELECT user_id, saved_job_id, updated_at, stage,
  row_number() OVER (PARTITION BY user_id ORDER BY o_orderdate DESC, saved_job_id) AS place
FROM tracked
""")
def tracked_of_user(t: Tables) -> DataFrame:
    """Every user's list, newest change first."""
    rows = reports.tracked_places(*_order_tracking(t))
    return rows.select("user_id", "saved_job_id", F.col("updated_at").cast("string"), "stage", "place")


@query(f"""
WITH {TRACKED_SQL} SELECT user_id, saved_job_id, updated_at,
  row_number() OVER (PARTITION BY user_id ORDER BY o_orderdate, saved_job_id) AS place
FROM tracked WHERE {STALE_WHERE}
""")
def stale_of_user(t: Tables) -> DataFrame:
    """Every user's stale jobs, oldest first."""
    rows = reports.stale_places(*_order_tracking(t), F.lit("1998-08-02").cast("timestamp_ntz"))
    return rows.select("user_id", "saved_job_id", F.col("updated_at").cast("string"), "place")


@query("""
SELECT c_custkey AS saved_job_id, c_name AS job_id, first_priority AS cover_letter, CAST(NULL AS VARCHAR) AS resume_bullet,
  CAST(last_order AS VARCHAR) AS last_updated_at
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS first_priority, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
""")
def tracked_with_drafts(t: Tables) -> DataFrame:
    saved = t("customer").select(F.col("c_custkey").alias("saved_job_id"), F.col("c_name").alias("job_id"))
    applications = t("orders").groupBy(F.col("o_custkey").alias("saved_job_id")).agg(
        F.min("o_orderpriority").alias("cover_letter"), F.lit(None).cast("string").alias("resume_bullet"),
        F.lit(None).cast("timestamp_ntz").alias("applied_at"),
        F.max("o_orderdate").alias("last_updated_at"),
    )
    rows = reports.tracked_with_drafts(saved, applications).drop("applied_at")
    return rows.withColumn("last_updated_at", F.col("last_updated_at").cast("string"))


@query("""
SELECT saved_job_id, note_id, CAST(follow_up_at AS VARCHAR) AS follow_up_at, c_custkey AS user_id FROM (
  SELECT user_id AS saved_job_id, event_id AS note_id, ts AS follow_up_at,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE ts <= '2024-01-15') JOIN customer ON c_custkey = saved_job_id WHERE rn = 1
""")
def followups_due(t: Tables) -> DataFrame:
    notes = t("events").select(
        F.col("user_id").alias("saved_job_id"), F.col("event_id").alias("note_id"), F.col("ts").alias("follow_up_at")
    )
    saved = t("customer").select(
        F.col("c_custkey").alias("saved_job_id"), F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("job_id"), F.col("c_mktsegment").alias("stage"),
    )
    due = reports.followups_due(notes, saved, F.lit("2024-01-15").cast("timestamp_ntz"))
    return due.select("saved_job_id", "note_id", F.col("follow_up_at").cast("string"), "user_id")


# --- integrity ------------------------------------------------------------------------

CONSTRAINT_SQL = """
SELECT 'labels' AS table_name, 'not null quality' AS constraint_name, count(*) FILTER (WHERE quality IS NULL) AS violations FROM labels
UNION ALL SELECT 'labels', 'allowed quality', count(*) FILTER (WHERE quality NOT IN (1)) FROM labels
UNION ALL SELECT 'labels', 'unique doc_id', count(*) FROM (SELECT 1 FROM labels GROUP BY doc_id HAVING count(*) > 1)
UNION ALL SELECT 'labels', 'references doc_id', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = l.doc_id)
UNION ALL SELECT 'events', 'allowed event_type', count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'signup')) FROM events
UNION ALL SELECT 'events', 'unique user_id, event_type', count(*) FROM (SELECT 1 FROM events GROUP BY user_id, event_type HAVING count(*) > 1)
UNION ALL SELECT 'events', 'references user_id', count(*) FROM events v WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = v.user_id)
UNION ALL SELECT 'documents', 'not null text', count(*) FILTER (WHERE text IS NULL) FROM documents
UNION ALL SELECT 'documents', 'unique text', count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1)
UNION ALL SELECT 'embeddings', 'dimension embedding', count(*) FILTER (WHERE len(embedding) <> 64) FROM embeddings
"""


def _rules(t: Tables) -> dict[str, integrity.TableRules]:
    return {
        "labels": integrity.TableRules(
            t("labels"), unique=[["doc_id"]], not_null=["quality"], allowed={"quality": [1]},
            references={"doc_id": (t("embeddings"), "vec_id")},
        ),
        "events": integrity.TableRules(
            t("events"), unique=[["user_id", "event_type"]],
            allowed={"event_type": ["view", "click", "signup"]},
            references={"user_id": (t("supplier"), "s_suppkey")},
        ),
        "documents": integrity.TableRules(t("documents"), unique=[["text"]], not_null=["text"]),
        "embeddings": integrity.TableRules(t("embeddings"), dimension={"embedding": 64}),
    }


@query(CONSTRAINT_SQL)
def constraint_report(t: Tables) -> DataFrame:
    return integrity.constraint_report(_rules(t))


@query("""
WITH users AS (SELECT c_custkey AS user_id, c_mktsegment || c_custkey % 1000 AS email, c_acctbal < 0 AS no_time FROM customer),
saved AS (SELECT o_custkey + 100 AS user_id, o_orderpriority AS job_id, o_orderkey AS saved_job_id,
  CASE o_orderstatus WHEN 'F' THEN 'bogus' WHEN 'O' THEN 'applied' END AS stage FROM orders)
SELECT 'users' AS table_name, 'not null email' AS constraint_name, 0 AS violations
UNION ALL SELECT 'users', 'not null created_at', count(*) FILTER (WHERE no_time) FROM users
UNION ALL SELECT 'users', 'unique user_id', 0
UNION ALL SELECT 'users', 'unique email', count(*) FROM (SELECT 1 FROM users GROUP BY email HAVING count(*) > 1)
UNION ALL SELECT 'saved_jobs', unnest(['not null user_id', 'not null job_id', 'not null saved_at', 'not null updated_at', 'unique saved_job_id']), 0
UNION ALL SELECT 'saved_jobs', 'not null stage', count(*) FILTER (WHERE stage IS NULL) FROM saved
UNION ALL SELECT 'saved_jobs', 'allowed stage', count(*) FILTER (WHERE stage = 'bogus') FROM saved
UNION ALL SELECT 'saved_jobs', 'unique user_id, job_id', count(*) FROM (SELECT 1 FROM saved GROUP BY user_id, job_id HAVING count(*) > 1)
UNION ALL SELECT 'saved_jobs', 'references user_id', count(*) FROM saved WHERE user_id NOT IN (SELECT user_id FROM users)
""")
def declared_report(t: Tables) -> DataFrame:
    """The declared constraints of two tracking tables."""
    status, time = F.col("o_orderstatus"), F.col("o_orderdate")
    tables = {
        "users": t("customer").select(
            F.col("c_custkey").alias("user_id"), F.concat("c_mktsegment", F.col("c_custkey") % 1000).alias("email"),
            F.when(~(F.col("c_acctbal") < 0), F.lit("2024-01-01").cast("timestamp")).alias("created_at"),
        ),
        "saved_jobs": t("orders").select(
            F.col("o_orderkey").alias("saved_job_id"), (F.col("o_custkey") + 100).alias("user_id"), F.col("o_orderpriority").alias("job_id"),
            F.when(status == "F", "bogus").when(status == "O", "applied").alias("stage"), time.alias("saved_at"), time.alias("updated_at"),
        ),
    }
    return integrity.constraint_report(integrity.declared_rules(tables))


@query("""
SELECT 'labels' AS table_name, 'allowed quality' AS constraint_name, '{"doc_id":' || doc_id || '}' AS key, count(*) AS rows
  FROM labels WHERE quality <> 1 GROUP BY doc_id
UNION ALL SELECT 'labels', 'references doc_id', '{"doc_id":' || doc_id || '}', count(*) FROM labels
  WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY doc_id
UNION ALL SELECT 'events', 'allowed event_type', '{"event_id":' || event_id || '}', 1 FROM events WHERE event_type NOT IN ('view', 'click', 'signup')
UNION ALL SELECT 'events', 'unique user_id, event_type', '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}', count(*) FROM events
  GROUP BY user_id, event_type HAVING count(*) > 1
UNION ALL SELECT 'events', 'references user_id', '{"user_id":' || user_id || '}', count(*) FROM events
  WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY user_id
UNION ALL SELECT 'documents', 'unique text', CAST(to_json({'text': text}) AS VARCHAR), count(*) FROM documents GROUP BY text HAVING count(*) > 1
""")
def constraint_violations(t: Tables) -> DataFrame:
    keys = {"labels": ["doc_id"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"]}
    return integrity.constraint_violations(_rules(t), keys)


@query("""
WITH c AS (SELECT * FROM customer WHERE NOT c_acctbal < 0),
o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)),
l AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders
  WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)))
SELECT 'customer' AS table_name, c_custkey AS key, -1 AS part FROM c
UNION ALL SELECT 'orders', o_orderkey, -1 FROM o
UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber FROM l
""")
def cascade_delete(t: Tables) -> DataFrame:
    tables = {name: t(name) for name in ("customer", "orders", "lineitem")}
    links = (
        integrity.Child("orders", "o_custkey", "customer", "c_custkey"),
        integrity.Child("lineitem", "l_orderkey", "orders", "o_orderkey"),
    )
    doomed = {"customer": t("customer").filter(F.col("c_acctbal") < 0).select("c_custkey")}
    left = integrity.cascade_delete(tables, doomed, links)
    rows = [
        left[name].select(F.lit(name).alias("table_name"), F.col(key).alias("key"), part.alias("part"))
        for name, key, part in (
            ("customer", "c_custkey", F.lit(-1)), ("orders", "o_orderkey", F.lit(-1)), ("lineitem", "l_orderkey", F.col("l_linenumber")),
        )
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])

