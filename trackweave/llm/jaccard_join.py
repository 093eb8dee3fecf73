"""Exact Jaccard join of documents on word shingles: size-aware, light and heavy sets apart.

A set is the distinct shingles of a text; sets that are equal form one class.
Two sets link at 100 * |A and B| >= 75 * |A or B|, so each holds at least three
quarters (``need``) of the other's shingles. The steps:

1. ``repeated_counts``: how many shingles of each class occur in another set
   too. Slices of documents send 32-bit remainders of their shingles to hash
   groups; a shingle frequent in a slice is sent once. Classes with fewer
   repeated shingles than ``need`` cannot link and are done: nearly all.
2. The others are cut to prefixes, rarest shingles first. Of two linked sets
   the prefixes of ``size - need + 1`` shingles share one, of one more share two.
3. Light sets (up to the boundary) enumerate the pairs of their prefix, heavy
   ones and those that may link with one are scanned by inverted lists. The
   boundary is where least is written: a row per pair of shingles on one side,
   a row per shingle and the candidates of its list (``LIST`` at most) on the other.
4. Lists of at most ``LIST`` classes give candidate pairs, whose sets are
   compared. Classes of longer lists form clusters, cut into blocks; a task
   compares two blocks in memory, never writes out pairs, and returns a
   forest of their links. All links count; none is lost to a cap.
5. Links are contracted to components; a component's id is its smallest doc_id.

Shingles are 64-bit fingerprints of words; classes are 64-bit fingerprints of
sets together with their size.

Defined cases: NULL and blank texts have empty sets, link with nothing and are
their own component; documents with repeated or NULL ids are documents like
others (a component of NULL ids only has id NULL); other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackweave.llm.components import components
from trackweave.llm.sieve import flag_partners
from trackweave.llm.substring_dedup import short, slices, unshort
from trackweave.llm.words import cut, mix, windows
from trackweave.operators.keyed import join_hot
from trackweave.session import forget, materialize

#: Words of a shingle, and the percentage of the union that linked sets share.
SHINGLE, PERCENT = 5, 75
#: Longer lists are joined by blocks.
LIST = 8
#: Cost of a key, in candidates.
KEY_COST = 3
#: Shingles in a block.
BLOCK = 100_000
#: Shingles that a hash group of step 1 is sized for.
PER_PARTITION = 3_000_000

SENT = "bucket int, classes binary, sizes binary, counts binary, rests binary, kind int"
COUNTED = "part int, classes binary, sizes binary, counts binary"


def need(size: Column) -> Column:
    """Shingles that a set must share with any partner."""
    return F.floor((size * PERCENT + 99) / 100).cast("long")


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending inside each document, and the first of each document (one more at the end)."""
    words = cut(texts)
    hashes = words.hashes(lower=True)
    values, at = windows(hashes, words.doc, k)
    doc = words.doc[at]
    counts = words.counts()
    for n in range(1, k):  # fewer words than a shingle: the whole text is one
        short_docs = np.flatnonzero(counts == n)
        if len(short_docs):
            firsts = words.first[short_docs]
            total = np.full(len(firsts), n, np.uint64)
            for i in range(n):
                total = mix(total + hashes[firsts + i])
            values, doc = np.concatenate((values, total)), np.concatenate((doc, short_docs))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.concatenate(([True], (values[1:] != values[:-1]) | (doc[1:] != doc[:-1]))) if len(values) else np.zeros(0, bool)
    values, doc = values[new], doc[new]
    return values, np.searchsorted(doc, np.arange(len(texts) + 1))


def class_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A fingerprint per set; 0 for the empty one."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    sizes = np.diff(first)
    ids = mix(sums[first[1:]] - sums[first[:-1]] + sizes.astype(np.uint64))
    return np.where(sizes > 0, ids, 0).astype(np.uint64).view(np.int64)


def send(k: int, buckets: int):
    """Map side of step 1: remainders of shingles to hash groups, with classes and counts."""

    def row(bucket, classes, sizes, counts, rests, kind):
        return (
            bucket, classes.astype("<i8").tobytes(), b"" if sizes is None else sizes.astype("<u4").tobytes(),
            short(counts), rests.astype("<u4").tobytes(), kind,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            values, first = shingle_sets(part.column(0), k)
            classes, sizes = class_of(values, first), np.diff(first)
            # One set per class.
            keep = np.sort(np.unique(classes, return_index=True)[1])  # in the order of the shingles
            keep = keep[sizes[keep] > 0]
            if not len(keep):
                continue
            owner = np.full(len(classes), -1)
            owner[keep] = np.arange(len(keep))
            doc = np.repeat(owner, sizes)
            values, doc = values[doc >= 0], doc[doc >= 0]
            classes, sizes = classes[keep], sizes[keep]
            _, at, inverse, n = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
            here = np.bincount(doc[n[inverse] > 1], minlength=len(classes))
            own = np.flatnonzero(n[inverse] == 1)
            loose = values[at[n > 1]]  # repeated inside the slice: counted here, sent once without owner
            rows = [row(int(classes[0] % buckets), classes, sizes, here, np.zeros(0), 1)]
            for kind, some, docs in ((0, values[own], doc[own]), (2, loose, None)):
                group = ((some >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                present, cuts = np.unique(group[order], return_index=True)
                for b, mine in zip(present.tolist(), np.split(order, cuts[1:]), strict=False):  # the groups this slice has; without any, split gives one empty piece
                    if docs is None:
                        rows.append(row(b, np.zeros(0), None, np.zeros(0), some[mine], kind))
                    else:
                        which, count = np.unique(docs[mine], return_counts=True)
                        rows.append(row(b, classes[which], None, count, some[mine], kind))
            kinds = [pa.int32(), *[pa.binary()] * 4, pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=[x.split()[0] for x in SENT.split(", ")],
            )

    return run


def count_group(parts: int):
    """Reduce side of step 1: per class, how many of its shingles of this group occur elsewhere too.

    Counts are sent on in one row per part of the classes.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        classes, sizes, n = repeated_in(group)
        part = np.abs(classes % parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = []
        for p in range(parts):
            mine = order[cuts[p]:cuts[p + 1]]
            if len(mine):
                rows.append((p, classes[mine].tobytes(), sizes[mine].astype("<u4").tobytes(), short(n[mine])))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in COUNTED.split(", ")])

    return run


def open_classes(group: pd.DataFrame) -> pd.DataFrame:
    """The classes of a part that have as many repeated shingles as a link needs."""
    classes = [np.frombuffer(r, "<i8") for r in group["classes"]]
    counts = np.concatenate([unshort(r, len(c)) for r, c in zip(group["counts"], classes, strict=True)])
    sizes = np.concatenate([np.frombuffer(r, "<u4").astype(np.int64) for r in group["sizes"]])
    found, size, n = summed(np.concatenate(classes), sizes, counts)
    enough = n >= (size * PERCENT + 99) // 100
    return pd.DataFrame({"class": found[enough], "size": size[enough]})


def summed(classes: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per class: its size, where one is known, and the sum of its counts."""
    found, inverse = np.unique(classes, return_inverse=True)
    most = np.zeros(len(found), np.int64)
    np.maximum.at(most, inverse, sizes)
    return found, most, np.bincount(inverse, n, len(found)).astype(np.int64)


def repeated_in(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, sizes (0 where not told) and counts of repeated shingles of one hash group."""
    out = []
    for r in group[group.kind == 1].itertuples():
        classes = np.frombuffer(r.classes, "<i8")
        out.append((classes, np.frombuffer(r.sizes, "<u4").astype(np.int64), unshort(r.counts, len(classes))))
    owned, loose = group[group.kind == 0], group[group.kind == 2]
    if len(owned):
        classes = [np.frombuffer(r.classes, "<i8") for r in owned.itertuples()]
        counts = [unshort(r.counts, len(c)) for r, c in zip(owned.itertuples(), classes, strict=True)]
        holder = np.repeat(np.concatenate(classes), np.concatenate(counts))
        rests = np.concatenate([np.frombuffer(r, "<u4") for r in owned.rests])
        ordered = np.sort(rests)
        twice = [ordered[1:][ordered[1:] == ordered[:-1]]]
        del ordered
        # Loose ones are repeated whatever their number.
        repeated = np.unique(np.concatenate([*twice, *[np.frombuffer(r, "<u4") for r in loose.rests]]))
        hit = np.isin(rests, repeated)
        found, n = np.unique(holder[hit], return_counts=True)
        out.append((found, np.zeros(len(found), np.int64), n))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return summed(*(np.concatenate(x) for x in zip(*out, strict=True)))


def describe(k: int):
    """Class and size of the set of every document; with ``sets`` the shingles too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            values, first = shingle_sets(part.column(0), k)
            yield pa.RecordBatch.from_arrays([
                *part.columns[1:], pa.array(class_of(values, first)), pa.array(np.diff(first).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64))),
            ], names=[*part.schema.names[1:], "class", "size", "shingles"])

    return run


def candidates(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Every document's class (key, id, class, size), and the sets of the classes that can link."""
    spark = docs.sparkSession
    text_key = F.xxhash64("text")
    members = materialize(
        docs.select("text", F.col("doc_id").cast("long").alias("id"), text_key.alias("hash")).mapInArrow(
            describe(k), "id long, hash long, class long, size long, shingles array<long>"
        ).drop("shingles"), "members",
    )
    shingles = members.agg(F.sum("size")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-shingles // PER_PARTITION), min(parts, -(-shingles // (PER_PARTITION // 8))))
    counted = docs.select("text").mapInArrow(send(k, buckets), SENT).repartition(buckets, "bucket").groupBy(
        "bucket"
    ).applyInPandas(count_group(parts), COUNTED)
    can_link = counted.groupBy("part").applyInPandas(open_classes, "class long, size long")
    one = members.filter("size > 0").groupBy("class", "size").agg(
        F.min(F.struct(F.coalesce("id", F.lit(np.iinfo(np.int64).min)).alias("id"), "hash")).alias("who")
    )
    chosen = materialize(can_link.join(one, ["class", "size"]).select("class", "size", "who.id", "who.hash"), "open")
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(np.iinfo(np.int64).min))
    flagged = flag_partners(
        docs.select(doc_id.alias("id"), text_key.alias("hash"), "text"), F.xxhash64("id", "hash"),
        chosen, F.xxhash64("id", "hash"), "maybe",
    ).filter("maybe").drop("maybe")
    sets = flagged.join(chosen.select("id", "hash"), ["id", "hash"], "left_semi").select("text").mapInArrow(
        describe(k), "class long, size long, shingles array<long>"
    )
    sets = materialize(sets, "sets")
    forget(chosen)
    return members, sets


def prefixes(sets: DataFrame) -> DataFrame:
    """class, size, and the shared shingles rarest first, cut to the longer prefix; classes that can still link only."""
    rows = sets.select("class", "size", F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    shared = join_hot(rows, often, ["shingle"], "inner").groupBy("class", "size").agg(
        F.sort_array(F.collect_set(F.struct("df", "shingle"))).alias("shared")  # bounded by the set
    )
    spare = F.size("shared") - need(F.col("size"))
    return shared.filter(spare >= 0).select(
        "class", "size", F.slice("shared", 1, (spare + 2).cast("int")).alias("prefix"), (spare + 1).cast("int").alias("one")
    )


def boundary(cut_sets: DataFrame) -> int:
    """The largest light size: least sum of rows written for pairs of shingles, for list entries and for their candidates.

    A key is written, shuffled and read again with its list (``KEY_COST``); a
    list entry meets at most ``LIST`` others, since longer lists go to blocks.
    """
    n = F.size("prefix")
    by_size = cut_sets.groupBy(F.ceil(F.log2("size") * 8).alias("step")).agg(  # at most some hundred rows
        F.max("size").alias("size"), F.sum(n * (n - 1) / 2 * KEY_COST).alias("pairs"),
        F.sum(F.aggregate(
            F.slice("prefix", 1, F.col("one")), F.lit(0.0), lambda a, x: a + KEY_COST + F.least(x["df"], F.lit(LIST))
        )).alias("reads"),
    ).orderBy("step").collect()
    best, limit = sum(r.reads for r in by_size), 0
    for i, r in enumerate(by_size):
        # Sets within the ratio of the first heavy size are scanned as well.
        cost = sum(x.pairs for x in by_size[:i + 1]) + sum(x.reads for x in by_size if x.size * 100 > r.size * PERCENT)
        if cost < best:
            best, limit = cost, r.size
    return int(limit)


def keys_of(cut_sets: DataFrame, light: int) -> DataFrame:
    """class, size and key: pairs of the longer prefix of light sets, single shingles of the shorter one of the others."""
    pairs = F.flatten(F.transform(F.col("prefix"), lambda a, i: F.transform(
        F.slice("prefix", i + 2, F.size("prefix")), lambda b: F.xxhash64(F.lit("two"), a["shingle"], b["shingle"])
    )))
    single = F.transform(F.slice("prefix", 1, F.col("one")), lambda a: F.xxhash64(F.lit("one"), a["shingle"]))
    small = cut_sets.filter(F.col("size") <= light).select("class", "size", F.explode(pairs).alias("key"))
    # Light sets that can link with a heavy one stand in the lists too.
    large = cut_sets.filter(F.col("size") * 100 > light * PERCENT).select("class", "size", F.explode(single).alias("key"))
    return small.unionByName(large)


def listed_pairs(entries: DataFrame) -> DataFrame:
    """Distinct pairs of classes that stand in one list of at most ``LIST`` and whose sizes allow a link."""
    grouped = entries.filter(F.col("n") <= LIST).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("size", "class"))).alias("of"))
    partners = F.transform(F.col("of"), lambda a, i: F.struct(
        a["class"].alias("a"),
        F.transform(F.filter(
            F.slice("of", i + 2, LIST), lambda b: a["size"] * 100 >= b["size"] * PERCENT
        ), lambda b: b["class"]).alias("b"),
    ))
    one = grouped.select(F.explode(partners).alias("p")).select("p.a", F.explode("p.b").alias("b"))
    return one.distinct()


def linked(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets link, as edges."""
    one = sets.select("class", "size", "shingles").dropDuplicates(["class"])
    a = one.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    b = one.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - both
    return pairs.join(a, "a").join(b, "b").filter(both * 100 >= union * PERCENT).select(
        F.col("a").alias("u"), F.col("b").alias("v")
    )


def block_links(group: pd.DataFrame) -> pd.DataFrame:
    """A forest of the links among the sets of a work unit; overlaps are counted by inverted lists in memory."""
    group = group.drop_duplicates("class").sort_values("size", kind="stable")
    classes, sizes = group["class"].to_numpy(), group["size"].to_numpy()
    sets = group["shingles"].to_list()
    first = np.concatenate(([0], np.cumsum(sizes)))
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    holders = np.repeat(np.arange(len(sets)), sizes)[order]
    starts = np.searchsorted(token[order], np.arange(token.max() + 2))
    root = np.arange(len(sets))
    edges = []
    for x in range(len(sets)):
        mine = token[first[x]:first[x + 1]]
        spans = [holders[starts[t]:starts[t + 1]] for t in mine]
        shared = np.bincount(np.concatenate(spans), minlength=len(sets))[x + 1:]
        hits = np.flatnonzero(shared * 100 >= (sizes[x] + sizes[x + 1:] - shared) * PERCENT) + x + 1
        for other in np.unique(root[hits]):
            if other != root[x]:
                edges.append((classes[x], classes[hits[root[hits] == other][0]]))
                root[root == other] = root[x]
    return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")


def block_edges(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among classes that share a list longer than ``LIST``; stored."""
    # A class is tied to the first class of each of its lists; most lists of a cluster have the same few firsts.
    ties = entries.filter(F.col("n") > LIST).select(F.col("class").alias("u"), F.col("first").alias("v")).distinct()
    cluster = components(ties)
    members = sets.dropDuplicates(["class"]).join(
        cluster.select(F.col("node").alias("class"), F.col("component").alias("cluster")), "class"
    )
    members = materialize(members, "clusters")
    forget(cluster)
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    # A unit is a pair of blocks; a set goes to the units of its own block.
    units = join_hot(members, blocks, ["cluster"], "inner").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    low, high = F.least("own", "other"), F.greatest("own", "other")
    links = materialize(units.select("cluster", low.alias("low"), high.alias("high"), "class", "size", "shingles").groupBy(
        "cluster", "low", "high"
    ).applyInPandas(block_links, "u long, v long"), "block_links")
    forget(members)
    return links


def class_edges(sets: DataFrame, light: int | None = None) -> DataFrame:
    """The links among the classes of ``sets``, enough of them to connect all that link; stored. ``light`` overrides the boundary."""
    cut_sets = materialize(prefixes(sets), "prefixes")
    keys = materialize(keys_of(cut_sets, boundary(cut_sets) if light is None else light), "keys")
    forget(cut_sets)
    lists = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("first")).filter("n > 1")
    entries = materialize(join_hot(keys, lists, ["key"], "inner"), "entries")
    forget(keys)
    short = materialize(linked(sets, listed_pairs(entries)), "short_links")
    long = block_edges(entries, sets)
    forget(entries)
    edges = materialize(short.unionByName(long), "links")
    forget(short, long)
    return edges


def join_documents(docs: DataFrame, k: int = SHINGLE, light: int | None = None) -> DataFrame:
    """id, hash (of the text), size (of the set), root and component of every document; one row per row of ``docs``."""
    members, sets = candidates(docs, k)
    edges = class_edges(sets, light)
    forget(sets)
    roots = components(edges)
    forget(edges)
    joined = join_hot(
        members, roots.select(F.col("node").alias("class"), "component"), ["class"], "left"
    ).withColumn("root", F.coalesce("component", "class"))
    named = materialize(joined.select("id", "hash", "class", "size", "root"), "roots")
    forget(members, roots)
    least = named.filter("size > 0").groupBy("root").agg(F.min("id").alias("least"))
    full = join_hot(named.filter("size > 0"), least, ["root"], "inner").select(
        "id", "hash", "size", "root", F.col("least").alias("component")
    )
    return full.unionByName(named.filter("size = 0").select("id", "hash", "size", "root", F.col("id").alias("component")))


def jaccard_stage(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest id (NULL last), then hash of the text.

    Documents without words are in no component and all stay; of repeated rows one stays.
    """
    found = join_documents(docs.select("doc_id", "text")).filter("size > 0")
    lowest, key = F.lit(np.iinfo(np.int64).max), ["id", "hash"]
    rows = materialize(found.groupBy("root", F.coalesce("id", lowest).alias("id"), "hash").agg(F.count("*").alias("n")), "rows")
    firsts = rows.groupBy("root").agg(F.min(F.struct(*key)).alias("first"))
    judged = join_hot(rows, firsts, ["root"], "inner").withColumn("stays", F.struct(*key) == F.col("first"))
    # Only rows that go, or that are there more than once, take part in the join with the texts.
    special = materialize(judged.filter("NOT stays OR n > 1").select(*[F.col(c).alias(f"_{c}") for c in (*key, "stays")]), "special")
    doc_id, text_hash = F.coalesce(F.col("doc_id").cast("long"), lowest), F.xxhash64("text")
    flagged = flag_partners(docs, F.xxhash64(doc_id, text_hash), special, F.xxhash64("_id", "_hash"), "_maybe")
    joined = flagged.filter("_maybe").join(special, (doc_id == F.col("_id")) & (text_hash == F.col("_hash")), "left")
    alone = joined.filter("_stays IS NULL").select(*docs.columns)
    repeated = joined.filter("_stays").dropDuplicates(["_id", "_hash"]).select(*docs.columns)
    return flagged.filter("NOT _maybe").select(*docs.columns).unionByName(alone).unionByName(repeated)
