"""Secret scan: fixed patterns, and strings that look random to two character models, built-in functions only.

Two first-order Markov models of characters, one of random strings and one of
ordinary identifiers, are counted from labelled samples; a candidate string is
a secret if the mean log-likelihood ratio of its character pairs is above a
threshold, as a whole or in any window of its shortest length, so that a token
behind a path or a long name is found. Counting is an aggregation over all pairs of the samples; the model
is one array with a number per pair of character classes (fixed size), put
into the scan as a constant. The scan is one projection without a shuffle.

Labelled samples: ordinary identifiers are one to three words of a document,
joined as in code; random strings are digests of the same documents' texts in
hexadecimal, Base64 and letters-and-digits form. They come from about
``SAMPLE`` distinct texts picked by their hash, however many rows hold one; the
bound is a parameter of the fit only, every text is scanned whole.

Defined cases: a NULL text is an empty one; without samples (an empty table)
all ratios are 0 and only the fixed patterns report. Spans are code points,
ends exclusive. Other columns are kept, those named like a result replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from trackweave.llm.expressions import covers, let, matches, replaced

# The base patterns, in the order of kinds; assign has a second group of 12 or more characters.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Strings that the models judge: this long at least, with a letter and a digit.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The length of the shortest of them.
SHORTEST = 20
#: What joins the parts of a candidate; between them are parts.
JOINT = "/_=-"
PART = r"[A-Za-z0-9+]"
#: Digits in numbers: parts of digits only, and three or more digits in a row. Ordinary samples hold none, so that the
#: dates and numbers of a path would look random as soon as they fill a window; there they count as joints.
NUMBERS = (
    r"[0-9](?=[0-9]{2})|(?<=[0-9])[0-9](?=[0-9])|(?<=[0-9]{2})[0-9]|"
    r"(?<![A-Za-z0-9+])[0-9](?=[0-9]?(?![A-Za-z0-9+]))|(?<=(?<![A-Za-z0-9+])[0-9])[0-9](?![A-Za-z0-9+])"
)
#: Parts at the ends of a found stretch that are plain words.
PLAIN = r"(?:[A-Z]?[a-z]*+|[A-Z]*+)"
#: Mean log-likelihood ratio per character pair from which a string counts as random.
THRESHOLD = 1.0
#: Distinct texts that the samples are taken from, about.
SAMPLE = 5_000
#: What each pair of classes is counted with before any sample.
PRIOR = 0.5

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WIDTH = len(ALPHABET)


def class_table() -> list[int]:
    """Class of each ASCII code; the last class holds all other characters."""
    return [ALPHABET.find(chr(c)) if chr(c) in ALPHABET else WIDTH for c in range(128)]


def pairs_of(string: Column) -> Column:
    """Class pairs of neighbouring characters as one number each."""
    table = F.array(*[F.lit(c) for c in class_table()])
    classes = F.transform(
        F.filter(F.split(string, ""), lambda c: c != ""),
        lambda c: F.when(F.ascii(c) < 128, F.get(table, F.ascii(c))).otherwise(F.lit(WIDTH)),
    )
    return let(classes, lambda k: F.when(F.size(k) > 1, F.transform(
        F.sequence(F.lit(0), F.size(k) - 2), lambda i: F.get(k, i) * (WIDTH + 1) + F.get(k, i + 1)
    )).otherwise(F.array().cast("array<int>")))


def samples(docs: DataFrame, limit: int = SAMPLE, text: str = "text") -> DataFrame:
    """(string, random): labelled strings from about ``limit`` distinct texts."""
    bodies = docs.select(F.coalesce(F.col(text), F.lit("")).alias("body"))
    share = max(1, round(bodies.agg(F.approx_count_distinct(F.xxhash64("body"))).first()[0] / limit))
    some = bodies.filter(F.pmod(F.xxhash64("body"), F.lit(share)) == 0).distinct()  # a text of many rows counts once
    phrases = F.regexp_extract_all("body", F.lit(r"[A-Za-z]{2,}(?: [A-Za-z]{2,}){0,2}"), F.lit(0))
    joint = F.get(F.array(F.lit("_"), F.lit("-"), F.lit(""), F.lit("/")), F.pmod(F.hash("phrase"), F.lit(4)))
    ordinary = some.select(F.explode(phrases).alias("phrase")).select(
        F.replace("phrase", F.lit(" "), joint).alias("string"), F.lit(False).alias("random")
    )
    digest = F.unhex(F.sha2("body", 256))
    mixed = F.regexp_replace(F.base64(digest), "[+/=]", "")
    strings = F.array(F.sha2("body", 256), F.base64(digest), mixed, F.upper(mixed), F.sha1("body"))
    return ordinary.unionByName(some.select(F.explode(strings).alias("string"), F.lit(True).alias("random")))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio (random against ordinary) of every pair of classes."""
    counts = labelled.select("random", F.explode(pairs_of(F.col("string"))).alias("pair")).groupBy("random", "pair").agg(
        F.count("*").alias("n")
    ).collect()  # at most two rows per pair of classes
    width = WIDTH + 1
    logs = {}
    for kind in (False, True):
        table = [[PRIOR] * width for _ in range(width)]
        for row in counts:
            if row.random == kind:
                table[row.pair // width][row.pair % width] += row.n
        logs[kind] = [[math.log(x / sum(line)) for x in line] for line in table]
    if not counts:
        return [0.0] * width * width
    return [round(logs[True][a][b] - logs[False][a][b], 6) for a in range(width) for b in range(width)]


def randomness(string: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio over the string's pairs."""
    ratios = constant(model)
    return let(pairs_of(string), lambda p: F.aggregate(
        p, F.lit(0.0), lambda a, i: a + F.get(ratios, i)
    ) / F.greatest(F.size(p), F.lit(1)))


def kind_spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")
    ))


SPANS = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"


def base_spans(body: Column) -> Column:
    """Spans of the three base patterns, by start, then kind."""
    def assigned(text: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
        found = let(values, lambda v: F.filter(
            matches(text, ASSIGN), lambda s, i: F.length(F.get(v, i)) >= LEAST["assign"]
        ))
        return kind_spans(found, "assign")

    # A run's matches that are long enough are the runs with a lower bound in the pattern.
    access = ACCESS.replace("+", f"{{{LEAST['access'] - 4},}}")
    hexes = HEX.replace("+", f"{{{LEAST['hex']},}}")
    none = F.array().cast(SPANS)
    parts = (
        F.when(body.rlike(ASSIGN), assigned(body)).otherwise(none),
        F.when(F.contains(body, F.lit("AKIA")), kind_spans(matches(body, access), "access")).otherwise(none),
        F.when(body.rlike(hexes), kind_spans(matches(body, hexes), "hex")).otherwise(none),
    )
    return F.sort_array(F.concat(*parts))


def window_model(model: list[float]) -> list[float]:
    """The model for windows: a pair with a joint never speaks for random."""
    joints, width = {ALPHABET.index(c) for c in JOINT}, WIDTH + 1
    return [min(x, 0.0) if {i // width, i % width} & joints else x for i, x in enumerate(model)]


def constant(model: list[float]) -> Column:
    """The model as one constant, not as thousands of expressions that every pass over the plan would visit."""
    return F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")


def mixed(string: Column) -> Column:
    return string.rlike("[0-9]") & string.rlike("[A-Za-z]")


def merged(spans: Column) -> Column:
    """Overlapping or touching spans as one; starts and ends must both be in order."""
    def ends(s: Column) -> Column:
        first = F.filter(s, lambda x, i: (i == 0) | (x["start"] > F.get(s, i - 1)["end"]))
        last = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["start"] > x["end"]))
        return F.zip_with(first, last, lambda a, z: F.struct(a["start"].alias("start"), z["end"].alias("end")))

    return let(spans, ends)


def windows(piece: Column, model: list[float], threshold: float) -> Column:
    """Stretches of a piece whose windows of ``SHORTEST`` characters are random, by start.

    Every part that such a window touches is in, but for plain words at the
    ends, where ``SHORTEST`` characters stay without them.
    """
    ratios = constant(window_model(model))

    def random_windows(r: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(r) - SHORTEST + 1), lambda i: (
            F.aggregate(F.slice(r, i + 1, SHORTEST - 1), F.lit(0.0), lambda a, x: a + x) >= threshold * (SHORTEST - 1)
        ) & mixed(F.substring(piece, i + 1, F.lit(SHORTEST))))
        return F.transform(at, lambda i: F.struct(i.alias("start"), (i + SHORTEST).alias("end")))

    def widened(s: Column) -> Column:
        before = F.reverse(F.substring(piece, F.lit(1), s["start"]))
        after = F.substring(piece, s["end"] + 1, F.length(piece))
        return F.struct(
            (s["start"] - F.length(F.regexp_extract(before, f"^{PART}*+", 0))).alias("start"),
            (s["end"] + F.length(F.regexp_extract(after, f"^{PART}*+", 0))).alias("end"),
        )

    def trimmed(s: Column) -> Column:
        string = F.substring(piece, s["start"] + 1, s["end"] - s["start"])
        start = s["start"] + F.length(F.regexp_extract(string, f"^(?:{PLAIN}[{JOINT}])*+", 0))
        end = s["end"] - F.length(F.regexp_extract(string, f"(?:[{JOINT}]{PLAIN})*+$", 0))
        return F.when(end - start >= SHORTEST, F.struct(start.alias("start"), end.alias("end"))).otherwise(s)

    scores = F.transform(pairs_of(F.regexp_replace(piece, NUMBERS, "-")), lambda i: F.get(ratios, i))
    return F.transform(merged(F.transform(merged(let(scores, random_windows)), widened)), trimmed)


def stretches(piece: Column, model: list[float], threshold: float) -> Column:
    """Random stretches of one piece: the whole of it, or those of its windows."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(piece).alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when((F.length(piece) < SHORTEST) | ~mixed(piece), none).when(
        randomness(piece, model) >= threshold, whole
    ).otherwise(windows(piece, model, threshold))


def random_spans(runs: Column, model: list[float], threshold: float) -> Column:
    """Spans of those candidate strings, or of the stretches of them, that the models call random."""
    found = F.flatten(F.transform(runs, lambda r: F.transform(
        let(r["match"], lambda m: stretches(m, model, threshold)),
        lambda s: F.struct((r["start"] + s["start"]).alias("start"), (r["start"] + s["end"]).alias("end")),
    )))
    return kind_spans(found, "random")


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Add ``base`` and ``spans`` (all), arrays of (start, order, end, kind) sorted by start, then kind.

    Candidates are cut at base spans, and what is left is judged on its own:
    base spans become blanks of their length, so that all positions stay.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    some = body.rlike(CANDIDATE)
    blanks = lambda s: F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int"))
    # One column after the other: as a single expression the lambdas nest deeper than the analyzer goes.
    found = docs.withColumn("_base", base_spans(body))
    found = found.withColumn("_cover", F.when(some, covers(F.col("_base"))))
    found = found.withColumn("_rest", F.when(some, replaced(body, F.col("_cover"), blanks)))
    found = found.withColumn("_runs", let(F.col("_rest"), lambda t: F.filter(matches(t, CANDIDATE), lambda s: mixed(s["match"]))))
    more = F.coalesce(random_spans(F.col("_runs"), model, threshold), F.array().cast(SPANS))
    found = found.withColumn("_random", more)
    return found.withColumns({
        "base": F.col("_base"), "spans": F.sort_array(F.concat("_base", "_random")),
    }).drop("_base", "_cover", "_rest", "_runs", "_random")


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def masked(found: DataFrame, mask: str, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add ``masked``, the text with every maximal run of overlapping spans replaced by ``mask``."""
    over = found.withColumn("_cover", covers(F.col(spans)))
    return over.withColumn("masked", replaced(F.col(text), F.col("_cover"), lambda s: F.lit(mask))).drop("_cover")


def secrets_stage(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Documents with every secret masked; texts without one stay as they are."""
    model = train(samples(docs))
    done = masked(scan(docs.select(F.struct("*").alias("_row"), "text"), model), mask)
    own = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.size("spans") > 0, F.length("masked").cast("long")).otherwise(F.col("_row.n_chars"))
    return done.select(*[own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
