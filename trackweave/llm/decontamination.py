"""Benchmark decontamination: word windows of test items looked up in the windows of all documents.

Words are runs of letters, digits and all beyond ASCII, A-Z lower-cased. A
window is ``WINDOW`` consecutive words of an item; an item of fewer words is
one window. A document's word inside any occurrence of a window is hit.

1. The distinct windows of the items become a hash set: a table of bits that
   every task gets as one value. ``BITS`` bits stand for a window and a scan
   takes at most ``SCAN`` windows, so its size is bounded (8 MB); a benchmark
   of more windows is cut by hash and the documents are scanned once for each
   part, so none is left out.
2. Documents are scanned in place: first the two ends of a window are looked
   up, then, where they are there, all of its words.
3. What the bits let through is verified: the words themselves are joined to
   the items' windows. Only these few windows become rows.
4. Hits are gathered per document; equal items are one class, and the list of
   item ids is made once for each set of classes that occurs, not per document.

``decontaminate`` removes the hit words or the hit documents. All of it is
built-in functions.

Defined cases: a NULL text has no words and is not contaminated; of items, NULL
and wordless ones have no window; an item without id marks words, but is not
listed; ids that several items or documents bear are allowed (an item id
counts once); an empty benchmark leaves all documents clean; other columns are
kept by ``decontaminate`` and not read by ``scan``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trackweave.llm.expressions import let
from trackweave.llm.licenses import LOWER, SEPARATOR, UPPER
from trackweave.llm.sieve import flag_partners
from trackweave.operators.keyed import join_hot
from trackweave.session import materialize

#: Words of a window.
WINDOW = 10
# Fixed value: what separates words in a text whose case is kept.
CASED = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Bits of the hash set for a window, and windows that one scan takes.
BITS, SCAN = 64, 1 << 20


def words_of(text: Column) -> Column:
    """Lower-case words in order."""
    body = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(body, f"[{SEPARATOR}]+"), "")


def gram(words: Column, i: Column, length: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, i + k) for k in range(length)])


def probes(words: Column, i: Column, length: int) -> tuple[Column, Column]:
    """Two 64-bit keys of the window at ``i``: of its ends, and of all its words."""
    every = [F.get(words, i + k) for k in range(length)]
    return F.xxhash64(F.lit(length), every[0], every[-1]), F.xxhash64(F.lit(-length), *every)


def starts(words: Column, length: int) -> Column:
    return F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(
        F.array().cast("array<int>")
    )


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (class, length, gram, ends, whole), and (class, item_id); both stored."""
    classed = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).filter(
        F.size("words") > 0
    ).withColumn("class", F.xxhash64("words"))

    def one(length: int) -> Column:
        return F.transform(starts(F.col("words"), length), lambda i: F.struct(
            F.lit(length).alias("length"), gram(F.col("words"), i, length).alias("gram"),
            probes(F.col("words"), i, length)[0].alias("ends"), probes(F.col("words"), i, length)[1].alias("whole"),
        ))

    by_size = one(window)
    for length in range(1, window):
        by_size = F.when(F.size("words") == length, one(length)).otherwise(by_size)
    found = classed.select("class", F.explode(by_size).alias("w")).select("class", "w.*").distinct()
    names = classed.filter("item_id IS NOT NULL").select("class", "item_id").distinct()
    return materialize(found, "item_windows"), materialize(names, "item_classes")


def bit_table(windows: DataFrame, bits: int) -> Column:
    """The hash set as one array<long> of ``bits`` bits."""
    keys = windows.select(F.explode(F.array("ends", "whole")).alias("key"))
    place = F.col("key").bitwiseAND(bits - 1)
    rows = keys.select(
        F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(key & {bits - 1} & 63 AS int))").alias("bit")
    ).unionByName(windows.sparkSession.range(bits // 64).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bit")))
    dense = rows.groupBy("at").agg(F.bit_or("bit").alias("bit"))
    return dense.agg(F.sort_array(F.collect_list(F.struct("at", "bit"))).alias("t")).select(
        F.transform("t", lambda x: x["bit"])
    ).scalar()


def has(table: Column, key: Column, bits: int) -> Column:
    place = key.bitwiseAND(F.lit(bits - 1))
    word = F.get(table, F.shiftright(place, 6).cast("int"))
    return F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1


def candidates(words: Column, table: Column, lengths: list[int], bits: int) -> Column:
    """array<struct<start, length, gram>> of the windows that the bits let through."""

    def of(length: int) -> Column:
        def listed(i: Column) -> Column:
            ends, whole = probes(words, i, length)
            return has(table, ends, bits) & has(table, whole, bits)

        return F.transform(F.filter(starts(words, length), listed), lambda i: F.struct(
            i.alias("start"), F.lit(length).alias("length"), gram(words, i, length).alias("gram")
        ))

    return F.concat(*[of(length) for length in lengths])


def covered(spans: Column) -> Column:
    """Words inside the union of sorted spans (start, length)."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(spans, state, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(s["start"], a["upto"]))).alias("n"),
        F.greatest(a["upto"], s["start"] + s["length"]).alias("upto"),
    ), lambda a: a["n"])


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: int = SCAN) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, spans (start, length, in words), n_items, item_ids (sorted).

    ``docs`` has doc_id and text, ``items`` item_id and text. The result is stored.
    """
    found, names = item_windows(items, window)
    sizes = found.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``window`` rows
    lengths, total = sorted(r.length for r in sizes), sum(r.n for r in sizes)
    parts = max(1, -(-total // most))
    if parts > 1:  # every scan must number the rows alike
        docs = materialize(docs.select("doc_id", "text"), "scanned")
    text_hash = F.xxhash64("text")
    scanned = docs.select(
        "doc_id", text_hash.alias("text_hash"), F.monotonically_increasing_id().alias("row"), words_of(F.col("text")).alias("words")
    )
    bits = 1 << max(12, (BITS * min(total, most)).bit_length())
    hits = []
    for part in range(parts):
        mine = found.filter(F.pmod("whole", F.lit(parts)) == part)
        listed = let(F.col("bits"), lambda t: let(F.col("words"), lambda w: F.struct(
            F.size(w).alias("n_words"), candidates(w, t, lengths, bits).alias("of") if lengths else F.array().cast(
                "array<struct<start:int,length:int,gram:string>>").alias("of")
        )))
        rows = scanned.withColumn("bits", bit_table(mine, bits)).select("doc_id", "text_hash", "row", listed.alias("s")).select(
            "doc_id", "text_hash", "row", "s.n_words", F.explode_outer("s.of").alias("c")
        ).select(
            "doc_id", "text_hash", "row", "n_words", "c.start", F.coalesce("c.length", F.lit(0)).alias("length"),
            F.coalesce("c.gram", F.col("row").cast("string")).alias("gram"),  # no candidate: spread over the partitions
        )
        hits.append(rows.join(mine.select("length", "gram", "class"), ["length", "gram"], "left"))
    hit = F.col("class").isNotNull()
    gathered = reduce(DataFrame.unionByName, hits).groupBy("row", "doc_id", "text_hash", "n_words").agg(
        F.sort_array(F.collect_set(F.when(hit, F.struct("start", "length")))).alias("spans"),
        F.sort_array(F.collect_set("class")).alias("classes"),
    )
    stored = materialize(gathered.drop("row").withColumn("n_hit", covered(F.col("spans"))), "document_hits")
    touched = stored.filter("n_hit > 0")
    sets = touched.select("classes").distinct()
    listed = sets.withColumn("class", F.explode("classes")).join(names, "class").groupBy("classes").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids")
    )
    full = join_hot(touched, listed, ["classes"], "left")
    clean = stored.filter("n_hit = 0").withColumn("item_ids", F.lit(None).cast("array<string>"))
    return full.unionByName(clean).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>"))).select(
        "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), "n_hit", "spans",
        F.size("item_ids").cast("long").alias("n_items"), "item_ids",
    )


def without_words(text: Column, spans: Column) -> Column:
    """``text`` without the words of the spans and what separates them from the word before."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[{CASED}]*[^{CASED}]+"), F.lit(0))
    tail = F.regexp_extract(text, rf"[{CASED}]*\z", 0)
    hit = F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))

    def joined(p: Column) -> Column:
        rest = F.array_except(F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0))), hit)
        return F.concat(F.array_join(F.transform(rest, lambda i: F.get(p, i)), ""), tail)

    return let(pieces, joined)


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", window: int = WINDOW) -> DataFrame:
    """The documents, all columns kept, without hit words (``remove="spans"``) or without hit documents (``"documents"``)."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove: {remove}")
    found = scan(docs.select("doc_id", "text"), items, window).filter("n_hit > 0")
    hit = materialize(found.select(F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans")).dropDuplicates(["_hash"]), "hit_texts")
    text_hash = F.xxhash64("text")
    flagged = flag_partners(docs, text_hash, hit, F.col("_hash"), "_maybe")  # other texts are not shuffled
    clean = flagged.filter("NOT _maybe").select(*docs.columns)
    joined = flagged.filter("_maybe").join(hit, text_hash == F.col("_hash"), "left")
    if remove == "documents":
        return clean.unionByName(joined.filter("_hash IS NULL").select(*docs.columns))
    text = F.when(F.col("_hash").isNull(), F.col("text")).otherwise(without_words(F.col("text"), F.col("_spans")))
    return clean.unionByName(joined.withColumn("text", text).select(*docs.columns))
