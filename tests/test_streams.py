import datetime as dt
import json

import pandas as pd
from pyspark.sql import functions as F

from trackweave import schemas
from trackweave.functions.models import hashing_embedder
from trackweave.operators import tracking
from trackweave.plans.ingest import EmbedCounts, embed_new, ingest_listings, store_chunks
from trackweave.sources.listings import read_listings
from trackweave.sources.tables import KeyedTable
from trackweave.streaming.state import PairFold, fold_stream, folded_rejects, folded_table
from trackweave.streaming.streams import command_stream, embed_stream, ingest_stream, listing_stream, read_rejects

START = dt.datetime(2024, 1, 1)


def now():
    return F.lit(START)


def land(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps([{"legal": "notice"}, *rows]))


def row(id, text, date="2024-01-01T00:00:00", **more):
    return {"id": id, "position": f"title {id}", "description": text, "date": date, "location": "Austin", **more}


def postings_store(spark, root):
    return KeyedTable(spark, str(root), schemas.POSTINGS, ["job_id"], parts=4, buckets=2)


def chunk_store(spark, root):
    return KeyedTable(spark, str(root), schemas.CHUNKS, ["job_id", "chunk_index"], ["job_id"], parts=4, buckets=2)


def test_ingest_counts_and_kept_source(spark, tmp_path):
    land(tmp_path / "in", "1.json", row("1", "one"), row("2", "two"), row("2", "newer", "2024-02-01T00:00:00"), row("3", ""), {"id": 4, "description": "untitled"})
    store = postings_store(spark, tmp_path / "postings")
    counts = ingest_listings(store, read_listings(spark, str(tmp_path / "in")), "feed", now())
    assert (counts.fetched, counts.kept, counts.rejected) == (5, 2, 1)
    land(tmp_path / "more", "2.json", row("1", "changed"), row("9", "nine"))
    counts = ingest_listings(store, read_listings(spark, str(tmp_path / "more")), "second", now())
    got = {r["job_id"]: (r["source"], r["description"]) for r in store.read().collect()}
    assert got == {"1": ("feed", "changed"), "2": ("feed", "newer"), "9": ("second", "nine")}
    junk = ingest_listings(store, read_listings(spark, str(tmp_path / "more")), "second", now(), vocabulary=["sql"])
    assert junk.kept == 0 and store.read().count() == 3


def test_incremental_embedding(spark, tmp_path):
    shape = "job_id string, description string"
    store = chunk_store(spark, tmp_path / "chunks")
    embed = hashing_embedder(dim=8)
    first = spark.createDataFrame([("a", "x" * 2000), ("b", "short"), ("c", " \t")], shape)
    assert embed_new(first, store, now(), embed=embed) == EmbedCounts(2, 4)
    count = lambda: {r["job_id"]: r["n"] for r in store.read().groupBy("job_id").agg(F.count("*").alias("n")).collect()}
    assert count() == {"a": 3, "b": 1}
    assert embed_new(first, store, now(), embed=embed) == EmbedCounts(0, 0)
    edited = spark.createDataFrame([("a", "y" * 900), ("b", " short "), ("d", "new")], shape)
    embed_new(edited, store, now(), embed=embed)
    assert count() == {"a": 3, "b": 1, "d": 1}, "edited texts stay as they are by default"
    assert embed_new(edited, store, now(), refresh=True, embed=embed) == EmbedCounts(1, 2)
    assert count() == {"a": 2, "b": 1, "d": 1}
    assert {r["chunk_text"][0] for r in store.read().filter("job_id = 'a'").collect()} == {"y"}
    embed_new(spark.createDataFrame([("a", " ")], shape), store, now(), refresh=True, embed=embed)
    assert count() == {"b": 1, "d": 1}


def test_chunk_upsert_keeps_creation(spark, tmp_path):
    store = chunk_store(spark, tmp_path / "chunks")
    row = lambda i, text, at: ("a", i, text, [1.0], "m", "h", at)
    store_chunks(store, spark.createDataFrame([row(0, "x", START), row(1, "y", START)], schemas.CHUNKS))
    later = START + dt.timedelta(days=1)
    store_chunks(store, spark.createDataFrame([row(1, "new", later), row(2, "z", later)], schemas.CHUNKS))
    got = {r["chunk_index"]: (r["chunk_text"], r["created_at"]) for r in store.read().collect()}
    assert got == {0: ("x", START), 1: ("new", START), 2: ("z", later)}


def test_streams_end_to_end(spark, tmp_path):
    folder = tmp_path / "in"
    store = postings_store(spark, tmp_path / "postings")
    chunks = chunk_store(spark, tmp_path / "chunks")

    def run():
        arriving = listing_stream(spark, str(folder))
        ingest_stream(arriving, store, "feed", str(tmp_path / "c1"), now()).awaitTermination()
        listings = listing_stream(spark, str(folder)).select(F.col("id").alias("job_id"), "description")
        embed_stream(listings, chunks, str(tmp_path / "c2"), now(), embed=hashing_embedder(dim=8)).awaitTermination()

    land(folder, "1.json", row("1", "one"), row("2", "t" * 900), row("1", "one"))
    run()
    assert store.read().count() == 2 and chunks.read().count() == 3
    land(folder, "2.json", row("2", "u", "2024-03-01T00:00:00"), row("3", "three"))
    run()
    got = {r["job_id"]: r["description"] for r in store.read().collect()}
    assert got == {"1": "one", "2": "u", "3": "three"}
    assert chunks.read().count() == 4, "known postings keep their chunks"
    before = sorted(str(f) for f in tmp_path.glob("*/parts-*/part=*/*.parquet"))
    run()
    assert before and sorted(str(f) for f in tmp_path.glob("*/parts-*/part=*/*.parquet")) == before, "no new files, nothing written"


def test_repeats_in_flight(spark, tmp_path):
    """Within the bound an equal listing is gone, also after a restart; a fuller copy and an old one that comes late stay."""
    folder, store, seen = tmp_path / "in", postings_store(spark, tmp_path / "postings"), []

    def run():
        ingest_stream(
            listing_stream(spark, str(folder)), store, "feed", str(tmp_path / "c"), now(), within="2 hours",
            report=lambda batch, counts: seen.append(counts),
        ).awaitTermination()

    land(folder, "1.json", row("1", "one"), row("1", "one"), row("2", "two", "garbage"))
    run()
    assert sum(c.fetched for c in seen) == 2
    land(folder, "2.json", row("1", "one"), row("2", "two", "garbage"), row("1", "one", url="/more"), row("3", "late", "1999-01-01T00:00:00"))
    seen.clear()
    run()
    assert sum(c.fetched for c in seen) == 2 and sum(c.kept for c in seen) == 2
    assert {r["job_id"]: r["url"] for r in store.read().collect()} == {"1": "/more", "2": None, "3": None}


def test_empty_listing_then_full_one_is_stored(spark, tmp_path):
    folder, store = tmp_path / "in", postings_store(spark, tmp_path / "postings")
    for name, text in (("1.json", ""), ("2.json", "full")):
        land(folder, name, row("1", text))
        ingest_stream(listing_stream(spark, str(folder)), store, "feed", str(tmp_path / "c"), now()).awaitTermination()
    assert [r["description"] for r in store.read().collect()] == ["full"]


def test_embed_stream_takes_the_newest_text(spark, tmp_path):
    chunks = chunk_store(spark, tmp_path / "chunks")
    rows = [("1", "zzz", START), ("1", "aaa", START + dt.timedelta(days=1)), ("1", "  ", START + dt.timedelta(days=2))]
    spark.createDataFrame(rows, "job_id string, description string, posted_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("job_id string, description string, posted_at timestamp").parquet(str(tmp_path / "in"))
    embed_stream(arriving, chunks, str(tmp_path / "c"), now(), embed=hashing_embedder(dim=8)).awaitTermination()
    assert [r["chunk_text"] for r in chunks.read().collect()] == ["aaa"]


def test_command_stream_and_replay(spark, tmp_path):
    def commands(*rows):
        return spark.createDataFrame(
            [(u, j, s, START + dt.timedelta(minutes=s), op, stage, None) for u, j, s, op, stage in rows], schemas.COMMANDS
        )

    batches = [
        commands((1, "a", 1, "update", "applied"), (1, "a", 2, "save", None), (2, "b", 3, "save", "bogus")),
        commands((1, "a", 4, "update", "offer"), (2, "b", 5, "save", "applied"), (3, "c", 6, "update", "saved")),
    ]
    store = KeyedTable(spark, str(tmp_path / "saved"), schemas.SAVED_JOBS, tracking.PAIR, parts=4, buckets=2)
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schemas.COMMANDS).parquet(str(tmp_path / "in"))
        command_stream(stream, store, str(tmp_path / "rejects"), str(tmp_path / "progress")).awaitTermination()

    def state():
        return {(r["user_id"], r["job_id"]): (r["saved_job_id"], r["stage"], r["updated_at"]) for r in store.read().collect()}

    want = {(1, "a"): (1, "offer", START + dt.timedelta(minutes=4)), (2, "b"): (2, "applied", START + dt.timedelta(minutes=5))}
    assert state() == want
    lost = {(r["batch"], r["seq"], r["reason"]) for r in read_rejects(spark, str(tmp_path / "rejects")).collect()}
    assert lost == {(0, 1, "not saved"), (0, 3, "invalid stage"), (1, 6, "not saved")}

    # the same files again under a new checkpoint: a replay of everything
    stream = spark.readStream.schema(schemas.COMMANDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    command_stream(stream, store, str(tmp_path / "rejects"), str(tmp_path / "again")).awaitTermination()
    assert state() == want
    again = {(r["batch"], r["seq"], r["reason"]) for r in read_rejects(spark, str(tmp_path / "rejects")).collect()}
    assert again == lost


def test_keyed_state_in_two_runs(spark, tmp_path):
    """Two runs with a restart between give the batch fold; every reject is there once; order within a batch is free."""
    def commands(*rows):
        return spark.createDataFrame(
            [(u, j, s, START + dt.timedelta(minutes=s), op, stage, score) for u, j, s, op, stage, score in rows], schemas.COMMANDS
        )

    saved = spark.createDataFrame(
        [(1, 9, "z", "saved", 0.5, START, START), (2, 8, "y", "offer", None, START, None)], schemas.SAVED_JOBS
    )
    batches = [
        commands((1, "a", 4, "update", "offer", None), (1, "a", 2, "save", None, 0.25), (1, "a", 3, "save", "saved", 0.75),
                 (1, "a", 1, "update", "applied", None), (2, "b", 5, "save", "bogus", None), (9, "z", 6, "update", "applied", None),
                 (3, "c", 7, "update", "saved", None), (3, "c", 8, None, "saved", None)),
        commands((1, "a", 12, "update", "rejected", None), (2, "b", 10, "save", "applied", None), (3, "c", 11, "update", "saved", None),
                 (8, "y", 13, "update", "nowhere", None)),
    ]
    root, want, rejects = str(tmp_path), saved, []
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schemas.COMMANDS).parquet(f"{root}/in")
        fold_stream(stream, saved, f"{root}/events", f"{root}/progress").awaitTermination()
        rejects += tracking.rejected_commands(want, batch).select("user_id", "job_id", "seq", "op", "stage", "reason").collect()
        want = tracking.fold_commands(want, batch)
    got = folded_table(saved, f"{root}/events")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert sorted(map(str, folded_rejects(spark, f"{root}/events").collect())) == sorted(map(str, rejects))
    fold_stream(stream, saved, f"{root}/events", f"{root}/progress").awaitTermination()  # nothing new: nothing changes
    assert folded_rejects(spark, f"{root}/events").count() == len(rejects) == 6


class Listed:
    """A list state in memory that counts its calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def __getattr__(self, name):
        self.calls += 1
        return {"exists": lambda: bool(self.rows), "get": lambda: iter(self.rows[:]), "put": lambda rows: self.rows.__init__(rows),
                "appendList": self.rows.extend, "clear": self.rows.clear}[name]


def test_state_is_called_per_group_not_per_pair():
    """1,500 pairs of one group: a few state calls; a missing job, place or score, repeated pairs and pieces in any order."""
    states = {}
    handle = type("Handle", (), {"getListState": lambda self, name, schema: states.setdefault(name, Listed())})()
    fold = PairFold()
    fold.init(handle)

    def told(frame):
        """As Spark sends it: pairs, places and times as text."""
        whole = [c for c in ("user_id", "seq", "ts", "saved_at", "updated_at") if c in frame]
        return frame.assign(**{c: pd.Series([None if x is None or x != x else str(int(x)) for x in frame[c]], dtype=object, index=frame.index) for c in whole})

    def shown(frames):
        out = pd.concat(frames)
        return out.assign(user_id=out["user_id"].astype(int))
    pairs = [(i, f"j{i % 7}" if i % 50 else None) for i in range(1500)]
    first = pd.DataFrame([(u, j, "saved", None if u % 3 else 0.5, u, u) for u, j in pairs[:1000]],
                         columns=["user_id", "job_id", "stage", "match_score", "saved_at", "updated_at"])
    again = first[:1].assign(stage="offer")  # repeated: the first counts
    for piece in (first, again):
        fold.handleInitialState((0,), told(piece), None)
    names = ["user_id", "job_id", "seq", "op", "stage", "match_score", "ts", "code", "is_save"]
    # Pairs from 1000: an update before the save, the save, an update after it; from 1400 no save at all. Pair 1: no place.
    rows = [(u, j, 10 * u + 1, "update", "applied", None, u + 1, 2, False) for u, j in pairs[1000:]]
    rows += [(u, j, 10 * u + 2, "save", "saved", 0.25, u + 2, 1, True) for u, j in pairs[1000:1400]]
    rows += [(u, j, 10 * u + 3, "update", "offer", None, u + 3, 5, False) for u, j in pairs[500:1400]]
    rows += [(*pairs[1], None, "update", "applied", None, 7, 2, False), (*pairs[2], 5, "update", "bogus", None, 7, 0, False)]
    rows += [(*pairs[1499], None, "save", "saved", None, 7, 1, True)]
    batch = told(pd.DataFrame(rows[::-1], columns=names))
    out = shown(fold.handleInputRows((0,), iter([batch[:900], batch[900:]]), None))
    lost = {(r.user_id, r.seq, r.reason) for r in out[out["reason"].notna()].itertuples()}
    assert lost == {(u, 10 * u + 1, "not saved") for u in range(1000, 1500)} | {(2, 5, "invalid stage"), (1499, None, "not saved")}
    got = {(r.user_id, r.job_id): (r.stage, r.match_score, r.saved_at, r.updated_at, r.version) for r in out[out["reason"].isna()].itertuples()}
    want = {(u, j): ("offer", None if u % 3 else 0.5, u, u + 3, 1) for u, j in pairs[500:1000]}
    want |= {(u, j): ("offer", 0.25, u + 2, u + 3, 1) for u, j in pairs[1000:1400]}
    assert got == want
    later = pd.DataFrame([(*pairs[0], 9, "update", "applied", None, 9, 2, False), (*pairs[1399], 1, "update", "applied", None, 9, 2, False)], columns=names)
    out = shown(fold.handleInputRows((0,), iter([told(later)]), None))
    assert [tuple(r) for r in out[["user_id", "stage", "match_score", "saved_at", "version"]].itertuples(index=False)] == [
        (0, "applied", 0.5, 0, 1), (1399, "applied", 0.25, 1401, 2)
    ]
    assert sum(s.calls for s in states.values()) < 25


def test_keyed_state_with_missing_values(spark, tmp_path, monkeypatch):
    """Missing users, jobs, ops and times beside others in a group: as a plain fold has them; large numbers keep their digits."""
    monkeypatch.setattr("trackweave.streaming.state.GROUPS", 1)
    big = 2**60 + 1
    at = lambda n: START + dt.timedelta(minutes=n)
    saved = spark.createDataFrame([(1, None, "x", "saved", 0.5, START, None), (2, 7, "x", "saved", None, None, START)], schemas.SAVED_JOBS)
    commands = [(None, "x", 3, at(3), "update", "offer", None), (None, "y", 4, at(4), "update", "offer", None), (8, None, 5, at(5), "save", "saved", 1.0),
                (big, "z", big + 1, at(6), "update", "applied", None), (big, "z", big + 2, None, "save", "saved", None),
                (7, "x", 9, at(9), None, "offer", None), (7, "x", 10, None, "update", "applied", None)]
    spark.createDataFrame(commands, schemas.COMMANDS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schemas.COMMANDS).parquet(f"{tmp_path}/in")
    fold_stream(stream, saved, f"{tmp_path}/events", f"{tmp_path}/progress").awaitTermination()
    lost = {(r["user_id"], r["job_id"], r["seq"], r["reason"]) for r in folded_rejects(spark, f"{tmp_path}/events").collect()}
    assert lost == {(None, "y", 4, "not saved"), (big, "z", big + 1, "not saved"), (7, "x", 9, "invalid stage")}
    changed = spark.read.parquet(f"{tmp_path}/events").filter("reason IS NULL").collect()
    assert {(r["user_id"], r["job_id"], r["stage"], r["match_score"], r["updated_at"] is None) for r in changed} == {
        (None, "x", "offer", 0.5, False), (8, None, "saved", 1.0, False), (big, "z", "saved", None, True), (7, "x", "applied", None, True)
    }
