"""The command fold as keyed state: the pairs (user, job) in groups by a hash, no stored table to read or rewrite.

``streams.command_stream`` folds each batch into a stored table, which suits
tables that others read at once and pairs with very many commands, as it
aggregates before the shuffle. Here Spark's state store holds the pairs: a
batch reads and writes the groups that its pairs fall into, a restart goes on
from the checkpoint, and every reject is written exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trackweave.operators.keyed import latest_per_key, not_in
from trackweave.operators.tracking import PAIR, coded_commands
from trackweave.schemas import STAGES

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Pairs of a group, as columns: their rows, times in microseconds; ``version`` counts the batches that changed one.
ROWS = ("stage", "match_score", "saved_at", "updated_at", "version")
ROW_TYPES = ("string", "double", "bigint", "bigint", "bigint")
#: A valid update of a pair that was not saved when it came.
WAITING = "seq bigint, op string, stage string"
PAIR_TEXT = ", ".join(f"{c} string" for c in PAIR)
#: What a batch gives: changed rows (no reason) and rejected commands.
EVENTS = "seq bigint, op string, stage string, reason string, match_score double, saved_at bigint, updated_at bigint, version bigint"

#: Rows that are written at a time.
PIECE = 10_000
#: Groups of pairs. A call of Python and of the state store costs as much for a group as for a pair.
GROUPS = 1024


#: Whole numbers that may be missing. They come as text, and so do the pairs: pandas would make them floats, which lose digits.
WHOLE = ("seq", "ts", "saved_at", "updated_at")


def _lists(rows: pd.DataFrame, *names: str) -> list[list]:
    """Columns as lists of Python values, None for a missing one."""
    lists = {n: rows[n].astype(object).where(rows[n].notna(), None).tolist() for n in names}
    return [[None if x is None else int(x) for x in v] if n in WHOLE else v for n, v in lists.items()]


def _as_text(df: DataFrame) -> DataFrame:
    whole = {c: F.col(c).cast("bigint").cast("string") for c in WHOLE if c in df.columns}
    return df.withColumns({**{c: F.col(c).cast("string") for c in PAIR}, **whole})


class PairFold(StatefulProcessor):
    """Folds the commands of a group of pairs, in any order within a batch, as ``fold_commands`` does.

    Rows come in pieces of bounded size. What must wait until the first save of
    its pair in the batch is known goes to a list in the state store, not to
    memory, which holds the pairs of one group at a time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = [*[(c, "string") for c in PAIR], *zip(ROWS, ROW_TYPES, strict=True)]
        self.pairs = handle.getListState("pairs", ", ".join(f"{n} array<{t}>" for n, t in kept))
        self.waiting = handle.getListState("waiting", f"{PAIR_TEXT}, {WAITING}")

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        columns = _lists(initialState, *PAIR, *ROWS[:-1])
        self.pairs.appendList([(*columns, [0] * len(initialState))])

    def _known(self) -> dict[tuple, tuple]:
        """The group's pairs and their rows; of repeated pairs of the first table the first counts."""
        known: dict[tuple, tuple] = {}
        if self.pairs.exists():
            for columns in self.pairs.get():
                for user, job, *row in zip(*columns, strict=True):
                    known.setdefault((user, job), tuple(row))
        return known

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, saves, lasts, out = self._known(), {}, {}, []
        for piece in rows:
            held = []
            columns = _lists(piece, *PAIR, "seq", "op", "stage", "match_score", "ts", "code", "is_save")
            for user, job, seq, op, stage, score, ts, code, is_save in zip(*columns, strict=True):
                pair = (user, job)
                if code <= 0:
                    out.append((*pair, seq, op, stage, "invalid stage", None, None, None, None))
                    continue
                if seq is not None and (pair not in lasts or seq > lasts[pair][0]):
                    lasts[pair] = (seq, code, ts)
                if pair in known:
                    continue
                if not is_save or seq is None:
                    held.append((*pair, seq, op, stage))
                elif pair not in saves or seq < saves[pair][0]:
                    saves[pair] = (seq, score, ts)
            if held:
                self.waiting.appendList(held)
            if len(out) >= PIECE:
                yield self._frame(out)
                out = []
        if self.waiting.exists():
            for user, job, seq, op, stage in self.waiting.get():
                save = saves.get((user, job))
                if save is None or (seq is not None and seq < save[0]):
                    out.append((user, job, seq, op, stage, "not saved", None, None, None, None))
                if len(out) >= PIECE:
                    yield self._frame(out)
                    out = []
            self.waiting.clear()
        changed = False
        for pair, (_, code, ts) in lasts.items():
            if pair in known:
                _, score, saved_at, _, version = known[pair]
            elif pair in saves:
                (_, score, saved_at), version = saves[pair], 0
            else:
                continue
            known[pair], changed = (STAGES[code - 1], score, saved_at, ts, version + 1), True
            stage, score, saved_at, ts, version = known[pair]
            out.append((*pair, None, None, stage, None, score, saved_at, ts, version))
        if changed:
            self.pairs.put([tuple(map(list, zip(*[(*pair, *row) for pair, row in known.items()], strict=True)))])
        for at in range(0, len(out), PIECE):
            yield self._frame(out[at:at + PIECE])

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [*PAIR, *[x.split()[0] for x in EVENTS.split(", ")]]
        return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(names, zip(*rows, strict=True), strict=True)})


def _micros(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.unix_micros(F.col(n).cast("timestamp")) for n in names})


def fold_stream(
    commands: DataFrame, saved: DataFrame, events: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Fold arriving commands; ``saved`` is the table that the first run starts from.

    Changed rows and rejects are appended to the folder ``events``, each once
    (:func:`folded_table`, :func:`folded_rejects`). The checkpoint holds the state.
    """
    spark = commands.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    pair_types = {c: commands.schema[c].dataType.simpleString() for c in PAIR}
    group = F.pmod(F.xxhash64(*PAIR), F.lit(GROUPS)).cast("int").alias("pairs_of")
    coded = _as_text(_micros(coded_commands(commands), "ts").select(
        group, *PAIR, "seq", "op", "stage", "match_score", "ts", "code", "is_save"
    ))
    typed = _micros(saved, "saved_at", "updated_at").withColumns({c: F.col(c).cast(t) for c, t in pair_types.items()})
    start = _as_text(typed.select(group, *PAIR, *ROWS[:-1]))
    folded = coded.groupBy("pairs_of").transformWithStateInPandas(
        PairFold(), f"{PAIR_TEXT}, {EVENTS}", "Append", "None", start.groupBy("pairs_of")
    ).withColumns({c: F.col(c).cast(t) for c, t in pair_types.items()})
    writer = folded.writeStream.format("parquet").option("path", events).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def folded_rejects(spark: SparkSession, events: str) -> DataFrame:
    """All rejected commands with their reason."""
    return spark.read.parquet(events).filter("reason IS NOT NULL").select(*PAIR, "seq", "op", "stage", "reason")


def folded_table(saved: DataFrame, events: str) -> DataFrame:
    """The saved pairs (without ids) after all batches so far: the newest row of a changed pair, the others as they began."""
    spark, kind = saved.sparkSession, {c: saved.schema[c].dataType for c in ("saved_at", "updated_at")}
    changed = spark.read.parquet(events).filter("reason IS NULL")
    newest = latest_per_key(changed, PAIR, [F.desc("version")]).withColumns(
        {c: F.timestamp_micros(c).cast(t) for c, t in kind.items()}
    )
    columns = [*PAIR, "stage", "match_score", "saved_at", "updated_at"]
    return not_in(saved, newest, PAIR, unique=True).select(*columns).unionByName(newest.select(*columns))
