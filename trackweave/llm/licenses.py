"""License scan: ordered signature rules behind a keyword prefilter, built-in functions only.

Stages, all inside one projection without a shuffle:

1. ``GATE``, one expression with the rarest keyword of every rule, is tried on
   each text. Only texts that pass are cut into words.
2. Words that can begin a rule (``anchors``) are looked up. At each of them the
   rules of that word, alternatives of one constant expression, are tried in
   order on the next ``SPAN`` words; the first that matches gives one detection.
3. A detection inside a longer or equal one of no lower priority is dropped.
   Detections are at most ``SPAN`` words long and begin at distinct words, so
   only the ``SPAN - 1`` before it have to be compared: the work is linear.

The phrases of ``BASE`` are reported apart from the rules, are never dropped,
and their labels are always among the labels.

Defined cases: a NULL text is an empty one; no words give counts of 0, NULL
places, empty labels and score 0. Repeated rows are scanned alike; columns of
the input are kept, those named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from trackweave.llm.expressions import let

# What separates words (controls, ASCII punctuation), both letter cases allowed in words.
SEPARATOR = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Words that one detection spans at most.
SPAN = 16


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs over lower-case words joined by one space and begins with ``anchor``."""

    anchor: str
    pattern: str
    label: str
    priority: int
    weight: float


LICENCE = "licen[sc]e"
GRANT = "under (?:the |a )?(?:terms (?:and conditions )?of (?:the )?)?"

#: Families: label, how the family is named in words, versions. The first word of a name is its anchor.
FAMILIES = (
    ("cc-by-nc-sa", ("cc by nc sa", "creative commons attribution noncommercial sharealike"), ("2 0", "3 0", "4 0")),
    ("cc-by-nc-nd", ("cc by nc nd", "creative commons attribution noncommercial noderivatives"), ("2 0", "3 0", "4 0")),
    ("cc-by-nc", ("cc by nc", "creative commons attribution noncommercial"), ("2 0", "3 0", "4 0")),
    ("cc-by-sa", ("cc by sa", "creative commons attribution sharealike"), ("2 0", "3 0", "4 0")),
    ("cc-by-nd", ("cc by nd", "creative commons attribution noderivatives"), ("2 0", "3 0", "4 0")),
    ("cc-by", ("cc by", "creative commons attribution"), ("2 0", "3 0", "4 0")),
    ("cc0", ("cc0", "creative commons zero"), ("1 0",)),
    ("lgpl", ("gnu lesser general public license", "lesser general public license", "gnu lgpl", "lgpl"), ("2 1", "2", "3")),
    ("agpl", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("3", "1")),
    ("gpl", ("gnu general public license", "general public license", "gnu gpl", "gpl"), ("1", "2", "3")),
    ("gfdl", ("gnu free documentation license", "gfdl"), ("1 1", "1 2", "1 3")),
    ("apache", ("apache license", "apache software license"), ("1 0", "1 1", "2 0")),
    ("mpl", ("mozilla public license",), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public license",), ("1 0", "2 0")),
    ("eupl", ("european union public license", "eupl"), ("1 1", "1 2")),
    ("cddl", ("common development and distribution license", "cddl"), ("1 0", "1 1")),
    ("osl", ("open software license",), ("2 0", "3 0")),
    ("afl", ("academic free license",), ("2 1", "3 0")),
    ("artistic", ("artistic license",), ("1 0", "2 0")),
    ("boost", ("boost software license",), ("1 0",)),
    ("odbl", ("open database license", "odbl"), ("1 0",)),
    ("ofl", ("sil open font license", "open font license"), ("1 0", "1 1")),
    ("python", ("python software foundation license", "psf license"), ("2",)),
    ("bsd-2", ("bsd 2 clause license", "simplified bsd license"), ()),
    ("bsd-3", ("bsd 3 clause license", "new bsd license", "modified bsd license"), ()),
    ("bsd", ("bsd license", "bsd style license"), ()),
    ("mit", ("mit license", "expat license", "x11 license"), ()),
    ("isc", ("isc license",), ()),
    ("zlib", ("zlib license",), ()),
    ("unlicense", ("unlicense",), ()),
    ("public-domain", ("public domain",), ()),
    ("proprietary", ("proprietary license",), ()),
)

#: Rules outside the families.
SINGLE = (
    Rule("all", "all rights (?:are )?reserved", "reserved", 3, 0.9),
    Rule("some", "some rights reserved", "some-reserved", 3, 0.8),
    Rule("no", "no rights reserved", "public-domain", 3, 0.8),
    Rule("copyright", r"copyright(?: c| ©)?(?: by)? (?:19|20)\d\d", "copyright-notice", 2, 0.6),
    Rule("copyright", r"copyright (?:c|©)", "copyright-notice", 2, 0.5),
    Rule("©", r"© (?:copyright )?(?:19|20)\d\d", "copyright-notice", 2, 0.6),
    Rule("permission", "permission is hereby granted free of charge", "mit", 4, 1.0),
    Rule("redistribution", "redistribution and use in source and binary forms", "bsd", 4, 1.0),
)


# The forms that the frames of the families miss, written one by one: version before the word licence or without it,
# versions glued to the name, bare SPDX ids, header and grant sentences. Label, pattern, and its first words where the
# pattern does not begin with one plain word.
HAND = (
    ("apache-2.0", rf"apache(?: software)?(?: version)? v?2 0(?: {LICENCE})?", ()),
    ("apache-2.0", rf"apache(?: software)? v?2(?: {LICENCE})", ()),
    ("apache-2.0", rf"apache2(?: 0)?(?: {LICENCE})?", ()),
    ("apache-1.1", rf"apache(?: software)?(?: version)? v?1 1(?: {LICENCE})?", ()),
    ("apache-1.0", rf"apache(?: software)?(?: version)? v?1 0(?: {LICENCE})?", ()),
    ("apache-2.0", "asl(?: version)? v?2(?: 0)?", ()),
    ("gpl-1", rf"(?:gnu )?gplv?1(?: 0)?(?: only| or later)?(?: {LICENCE})?", ("gnu", "gplv1", "gpl1")),
    ("gpl-2", rf"(?:gnu )?gplv?2(?: 0)?(?: only| or later)?(?: {LICENCE})?", ("gnu", "gplv2", "gpl2")),
    ("gpl-3", rf"(?:gnu )?gplv?3(?: 0)?(?: only| or later)?(?: {LICENCE})?", ("gnu", "gplv3", "gpl3")),
    ("lgpl-2.1", rf"(?:gnu )?lgplv?2 1(?: only| or later)?(?: {LICENCE})?", ("gnu", "lgplv2", "lgpl2")),
    ("lgpl-2.1", rf"(?:gnu )?lgplv?21(?: {LICENCE})?", ("gnu", "lgplv21", "lgpl21")),
    ("lgpl-2", rf"(?:gnu )?lgplv?2(?: 0)?(?: only| or later)?(?: {LICENCE})?", ("gnu", "lgplv2", "lgpl2")),
    ("lgpl-3", rf"(?:gnu )?lgplv?3(?: 0)?(?: only| or later)?(?: {LICENCE})?", ("gnu", "lgplv3", "lgpl3")),
    ("agpl-1", rf"(?:gnu )?agplv?1(?: 0)?(?: only| or later)?(?: {LICENCE})?", ("gnu", "agplv1", "agpl1")),
    ("agpl-3", rf"(?:gnu )?agplv?3(?: 0)?(?: only| or later)?(?: {LICENCE})?", ("gnu", "agplv3", "agpl3")),
    ("gfdl-1.2", "gfdlv?1 2", ("gfdlv1", "gfdl1")),
    ("gfdl-1.3", "gfdlv?1 3", ("gfdlv1", "gfdl1")),
    ("mpl-1.1", rf"(?:mozilla|mpl)(?: version)? v?1 1(?: {LICENCE})?", ("mozilla", "mpl")),
    ("mpl-2.0", rf"(?:mozilla|mpl)(?: version)? v?2 0(?: {LICENCE})?", ("mozilla", "mpl")),
    ("mpl-2.0", "mplv?2(?: 0)?", ("mplv2", "mpl2")),
    ("epl-1.0", rf"(?:eclipse|epl)(?: version)? v?1 0(?: {LICENCE})?", ("eclipse", "epl")),
    ("epl-2.0", rf"(?:eclipse|epl)(?: version)? v?2 0(?: {LICENCE})?", ("eclipse", "epl")),
    ("bsd-2", rf"bsd 2(?: clause)(?: {LICENCE})?", ()),
    ("bsd-3", rf"bsd 3(?: clause)(?: {LICENCE})?", ()),
    ("bsd-2", rf"(?:2|two) clause bsd(?: {LICENCE})?", ("2", "two")),
    ("bsd-3", rf"(?:3|three) clause bsd(?: {LICENCE})?", ("3", "three")),
    ("bsd-4", rf"bsd 4 clause(?: {LICENCE})?", ()),
    ("bsd-4", rf"(?:4|four) clause bsd(?: {LICENCE})?", ("4", "four")),
    ("bsd-0", rf"(?:0bsd|bsd 0 clause|bsd zero clause)(?: {LICENCE})?", ("0bsd", "bsd")),
    ("bsd-2", "bsd2", ()), ("bsd-3", "bsd3", ()),
    ("bsd-2", f"freebsd {LICENCE}", ()),
    ("mit", rf"mit(?: x11| expat)(?: {LICENCE})?", ()),
    ("mit", "mit licen[sc]ed", ()),
    ("isc", "isc licen[sc]ed", ()),
    ("bsd", "bsd licen[sc]ed", ()),
    ("gpl", "(?:gpl|gplv2|gplv3) licen[sc]ed", ("gpl",)),
    ("apache-2.0", "apache licen[sc]ed", ()),
    ("boost-1.0", "bsl 1 0", ()), ("boost-1.0", "boost(?: software)? v?1 0", ()),
    ("artistic-2.0", "artistic v?2 0", ()), ("artistic-1.0", "artistic v?1 0", ()),
    ("ofl-1.1", "(?:sil )?ofl v?1 1", ("sil", "ofl")),
    ("eupl-1.2", "euplv?1 2", ("euplv1", "eupl1")),
    ("cc0-1.0", "cc0 v?1(?: 0)?", ()),
    ("cc0", "cc zero", ()),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public licen[sc]e)", ("wtfpl", "do")),
    ("mit", "the software is provided as is without warranty of any kind express or implied", ()),
    ("gpl", "this program is free software you can redistribute it and or modify it", ()),
    ("lgpl", "this library is free software you can redistribute it and or modify it", ()),
    ("mpl", "this source code form is subject to the terms of the mozilla public licen[sc]e", ()),
    ("apache-2.0", r"licen[sc]ed under the apache licen[sc]e version 2 0(?: the licen[sc]e)?", ("licensed", "licenced")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ()),
    ("boost-1.0", "distributed under the boost software licen[sc]e(?: version 1 0)?", ()),
    ("zlib", "this software is provided as is without any express or implied warranty", ()),
    ("unlicense", "this is free and unencumbered software released into the public domain", ()),
    ("proprietary", f"under (?:a |the )?commercial {LICENCE}", ()),
    ("proprietary", f"commercial {LICENCE} (?:agreement|terms|key|(?:is )?required)", ()),
    # Addresses, as words.
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", ()), ("cc-by-nc-nd", "creativecommons org licenses by nc nd", ()),
    ("cc-by-nc", "creativecommons org licenses by nc", ()), ("cc-by-sa", "creativecommons org licenses by sa", ()),
    ("cc-by-nd", "creativecommons org licenses by nd", ()), ("cc-by", "creativecommons org licenses by", ()),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", ()), ("public-domain", "creativecommons org publicdomain mark", ()),
    ("apache-2.0", "apache org licenses license 2 0", ()), ("mpl-2.0", "mozilla org (?:en us )?mpl 2 0", ()),
    ("agpl-3", "gnu org licenses agpl(?: 3 0)?", ()), ("lgpl-2.1", "gnu org licenses (?:old licenses )?lgpl 2 1", ()),
    ("lgpl", "gnu org licenses lgpl", ()), ("gpl-2", "gnu org licenses (?:old licenses )?gpl 2 0", ()),
    ("gpl-3", "gnu org licenses gpl 3 0", ()), ("gpl", "gnu org licenses gpl", ()), ("gfdl", "gnu org licenses fdl", ()),
    ("mit", "opensource org licenses? mit", ()), ("isc", "opensource org licenses? isc", ()),
    ("bsd-2", "opensource org licenses? bsd 2 clause", ()), ("bsd-3", "opensource org licenses? bsd 3 clause", ()),
    ("apache-2.0", "opensource org licenses? apache 2 0", ()), ("mpl-2.0", "opensource org licenses? mpl 2 0", ()),
    ("gpl-3", "opensource org licenses? gpl 3 0", ()), ("lgpl-3", "opensource org licenses? lgpl 3 0", ()),
    # Sentences of licence texts.
    ("bsd", "redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice", ()),
    ("bsd", "redistributions of source code must retain", ()),
    ("mit", "the software is provided as is without warranty", ()),
    ("bsd", "this software is provided by the (?:copyright holders and contributors|authors?|regents and contributors) as is", ()),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", ()),
    ("zlib", "the origin of this software must not be misrepresented", ()),
    ("gpl", "you should have received a copy of the gnu general public licen[sc]e", ()),
    ("lgpl", "you should have received a copy of the gnu lesser general public licen[sc]e", ()),
    ("agpl", "you should have received a copy of the gnu affero general public licen[sc]e", ()),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining", ()),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", ()),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation", ()),
    # Licences without a family.
    ("postgresql", f"postgresql {LICENCE}", ()), ("openssl", f"openssl {LICENCE}", ()), ("curl", f"curl {LICENCE}", ()),
    ("ms-pl", f"(?:ms pl|microsoft public {LICENCE})", ("ms", "microsoft")),
    ("ms-rl", f"(?:ms rl|microsoft reciprocal {LICENCE})", ("ms", "microsoft")),
    ("busl-1.1", f"(?:busl|business source {LICENCE})(?: version)? v?1 1", ("busl", "business")),
    ("busl", f"(?:busl|business source {LICENCE})", ("busl", "business")),
    ("sspl", f"(?:sspl|server side public {LICENCE})(?: version)?(?: v?1(?: 0)?)?", ("sspl", "server")),
    ("elastic-2.0", f"elastic {LICENCE}(?: version)? v?2(?: 0)?", ()), ("elastic", f"elastic {LICENCE}", ()),
    ("ncsa", f"(?:university of illinois )?ncsa(?: open source)? {LICENCE}", ("university", "ncsa")),
    ("php-3.01", f"php {LICENCE}(?: version)? v?3 01", ()), ("php", f"php {LICENCE}", ()),
    ("w3c", f"w3c(?: software)?(?: notice and| and document notice and)? {LICENCE}", ()),
    ("unicode", f"unicode(?: data files and software)? {LICENCE}", ()),
    ("cecill-b", "cecill b", ()), ("cecill-c", "cecill c", ()), ("cecill", f"cecill(?: v?2(?: [01])?)?(?: {LICENCE})?", ()),
    ("zpl", f"(?:zpl 2 [01]|zope public {LICENCE})", ("zpl", "zope")), ("vim", f"vim {LICENCE}", ()),
    ("ruby", f"ruby {LICENCE}", ()), ("json", f"json {LICENCE}", ()), ("libpng", f"libpng {LICENCE}", ()),
    ("ibm", f"ibm public {LICENCE}", ()), ("cpl", f"common public {LICENCE}", ()), ("cpal", f"common public attribution {LICENCE}", ()),
    ("sleepycat", f"sleepycat {LICENCE}", ()), ("qpl", f"q public {LICENCE}", ()), ("npl", f"netscape public {LICENCE}", ()),
    ("spl", f"sun public {LICENCE}", ()), ("apsl", f"apple public source {LICENCE}", ()), ("rpl", f"reciprocal public {LICENCE}", ()),
    ("opl", f"open publication {LICENCE}", ()), ("lppl", f"latex project public {LICENCE}", ()), ("openldap", f"openldap public {LICENCE}", ()),
    ("upl", f"universal permissive {LICENCE}", ()), ("mulan", f"mulan permissive software {LICENCE}", ()), ("zend", f"zend {LICENCE}", ()),
    ("blue-oak", f"blue oak model {LICENCE}", ()), ("hippocratic", f"hippocratic {LICENCE}", ()), ("polyform", "polyform [a-z]+ licen[sc]e", ()),
    ("ogl", f"open government {LICENCE}", ()), ("free-art", f"free art {LICENCE}", ()), ("afpl", f"aladdin free public {LICENCE}", ()),
    ("pddl", f"public domain dedication and {LICENCE}", ()), ("odc-by", f"open data commons attribution {LICENCE}", ()),
    ("mit-0", f"mit no attribution(?: {LICENCE})?", ()), ("beerware", f"(?:beerware|beer ware) {LICENCE}", ("beerware", "beer")),
    ("xfree86", f"xfree86 {LICENCE}", ()), ("tcl", f"tcl(?: tk)? {LICENCE}", ()), ("commons-clause", f"commons clause {LICENCE}", ()),
)

#: Grants that name a licence by one word: "released under the MIT".
GRANTED = ("licensed", "licenced", "released", "distributed", "available", "published", "provided", "offered")
GRANTED_AS = (
    ("bsd-0", "bsd (?:0|zero) clause"), ("bsd-2", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"), ("bsd-4", "bsd 4 clause"),
    ("apache-2.0", f"apache(?: software)?(?: {LICENCE})?(?: version)? v?2(?: 0)?"), ("mpl-2.0", "mpl(?: version)? v?2(?: 0)?"),
    ("mpl-1.1", "mpl(?: version)? v?1 1"), ("epl-2.0", "epl(?: version)? v?2(?: 0)?"), ("epl-1.0", "epl(?: version)? v?1(?: 0)?"),
    ("mit", "(?:mit|expat)"), ("bsd", "bsd"), ("isc", "isc"), ("zlib", "zlib"), ("wtfpl", "wtfpl"), ("apache", "apache"),
    ("mpl", "mpl"), ("epl", "epl"), ("unlicense", "unlicense"),
)


def hand_rules() -> list[Rule]:
    """The written forms, last in order, so that they add to the others and replace none."""
    rules = [
        Rule(anchor, pattern, label, 1, 0.65)
        for label, pattern, anchors in HAND for anchor in (anchors or (pattern.split(" ")[0].split("(")[0],))
    ]
    own = {"licen[sc]ed": ("licensed", "licenced")}
    rules = [Rule(a, r.pattern, r.label, r.priority, r.weight) for r in rules for a in own.get(r.anchor, (r.anchor,))]
    return rules + [
        Rule(verb, f"{verb} {GRANT}{name}(?: {LICENCE})?", label, 1, 0.65) for verb in GRANTED for label, name in GRANTED_AS
    ]


def family_rules() -> list[Rule]:
    """The forms of every family, most telling first: tag, grant, name with version, name."""
    rules = []
    for label, names, versions in FAMILIES:
        for version in (*versions, None):
            exact = f"{label}-{version.replace(' ', '.')}" if version else label
            tail = rf"(?: {LICENCE})?(?: international| unported)?(?: version| v)? v?{version}" if version else ""
            tag = label.replace("-", " ") + (f" {version}" if version else "")
            rules.append(Rule("spdx", f"spdx {LICENCE} identifier {tag}", exact, 5, 1.0))
            for name in names:
                words = name.replace(" license", f" {LICENCE}")
                anchor = name.split(" ")[0]
                rules.append(Rule("under", GRANT + words + tail, exact, 4, 0.95))
                rules.append(Rule(anchor, words + tail, exact, 3 if version else 2, 0.8 if version else 0.7))
    return rules


#: All rules in the order in which they are tried.
RULES = tuple(sorted((*SINGLE, *family_rules(), *hand_rules()), key=lambda r: -r.priority))

#: A text without any of these holds no rule and no base phrase.
GATE = (
    rf"(?i)licen[sc]e|reserved|copyright|creative[{SEPARATOR}]+commons|public[{SEPARATOR}]+domain|redistribution|"
    rf"cc[{SEPARATOR}]+by|cc0|gpl|gfdl|cddl|eupl|odbl|hereby|0bsd|bsd[{SEPARATOR}]*[0234]|clause[{SEPARATOR}]+bsd|wtfpl|"
    rf"bsd[{SEPARATOR}]+zero|mit[{SEPARATOR}]+(?:x11|expat)|cc[{SEPARATOR}]+zero|public[{SEPARATOR}]+licen|"
    rf"(?:apache|asl|mpl|mozilla|epl|eclipse|boost|bsl|artistic|ofl)(?:[{SEPARATOR}]+(?:software|version))*[{SEPARATOR}]*v?[12]|"
    rf"under[{SEPARATOR}]+(?:\w+[{SEPARATOR}]+){{0,7}}(?:mit|expat|bsd|isc|zlib|apache|mpl|epl)|"
    rf"software[{SEPARATOR}]+is[{SEPARATOR}]+provided|is[{SEPARATOR}]+free[{SEPARATOR}]+software|"
    rf"permission[{SEPARATOR}]+(?:to[{SEPARATOR}]+use|notice[{SEPARATOR}]+shall)|unencumbered|©|creativecommons|busl|sspl|cecill|"
    rf"ms[{SEPARATOR}]+[pr]l|zpl[{SEPARATOR}]+2|must[{SEPARATOR}]+not[{SEPARATOR}]+be[{SEPARATOR}]+misrepresented|"
    rf"mozilla[{SEPARATOR}]+org|anyone[{SEPARATOR}]+is[{SEPARATOR}]+free|mit[{SEPARATOR}]+no[{SEPARATOR}]+attribution"
)


def by_anchor(rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """The rules of every anchor, in order."""
    groups: dict[str, list[Rule]] = {}
    for rule in rules:
        groups.setdefault(rule.anchor, []).append(rule)
    return groups


def tried(word: Column, window: Column, groups: dict[str, list[Rule]]) -> Column:
    """What the rules of a word make of the window that begins with it; without a match the window itself.

    The rules of an anchor are one constant expression with a group per rule,
    compiled once, that stops at the first alternative that matches. The
    result is the number of the anchor's first rule and, each behind a tilde
    (which no word holds), what each group matched: nothing but for one.
    """
    chain, first = F, 0
    for anchor, of in groups.items():
        one = "|".join(f"({r.pattern})" for r in of)
        parts = "".join(f"~${n}" for n in range(1, len(of) + 1))
        chain = chain.when(word == anchor, F.regexp_replace(window, f"(?s)^(?:{one})(?= |$).*", f"{first}{parts}"))
        first += len(of)
    return chain.otherwise("")


def detections(words: Column, anchors: Column, rules: tuple[Rule, ...]) -> Column:
    """array<struct<start, end, label, priority, weight>>, ends exclusive, in order of start."""
    groups = by_anchor(rules)
    ordered = [r for of in groups.values() for r in of]
    # Constants of one string each, not of a node per rule.
    listed = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    labels, priorities, weights = (
        listed([getattr(r, name) for r in ordered], kind)
        for name, kind in (("label", "string"), ("priority", "int"), ("weight", "double"))
    )

    def report(i: Column, found: Column) -> Column:
        number = F.substring_index(found, "~", 1)
        rest = F.substring(found, F.length(number) + 1, F.length(found))
        rule = number.cast("int") + F.length(rest) - F.length(F.ltrim(rest, F.lit("~"))) - 1
        size = F.size(F.split(F.replace(rest, F.lit("~"), F.lit("")), " "))
        return let(rule, lambda r: F.struct(
            i.cast("long").alias("start"), (i + size).cast("long").alias("end"), F.get(labels, r).alias("label"),
            F.get(priorities, r).alias("priority"), F.get(weights, r).alias("weight"),
        ))

    def first_rule(i: Column) -> Column:
        window = F.array_join(F.slice(words, i + 1, SPAN), " ")
        return let(let(window, lambda w: tried(F.get(words, i), w, groups)), lambda f: F.when(F.contains(f, F.lit("~")), report(i, f)))

    return F.filter(F.transform(anchors, first_rule), lambda h: h.isNotNull())


def uncontained(hits: Column) -> Column:
    """Drop a detection that lies inside another of at least its priority."""

    def kept(h: Column, j: Column) -> Column:
        near = F.slice(hits, F.greatest(j - SPAN + 2, F.lit(1)), F.least(j, F.lit(SPAN - 1)))
        return ~F.exists(near, lambda o: (o["end"] >= h["end"]) & (o["priority"] >= h["priority"]))

    return F.filter(hits, kept)


def scan_words(words: Column, rules: tuple[Rule, ...]) -> Column:
    """Everything found in one array of lower-case words."""
    starts = sorted({r.anchor for r in rules} | {p.split(" ")[0] for p in BASE})
    anchors = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(starts))

    def places(at: Column, phrase: str) -> Column:
        parts = phrase.split(" ")

        def here(i: Column) -> Column:
            same = F.get(words, i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                same = same & F.coalesce(F.get(words, i + k) == part, F.lit(False))
            return same

        return F.filter(at, here)

    def report(at: Column) -> Column:
        base = F.flatten(F.array(*[
            F.transform(places(at, phrase), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))
            for phrase, label in BASE.items()
        ]))
        return F.struct(
            base.alias("base"), let(detections(words, at, rules), uncontained).alias("found")
        )

    return let(anchors, report)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and the spans ``detections``."""
    body = F.coalesce(F.col(text), F.lit(""))
    word = rf"[^{SEPARATOR}]"
    marks = F.regexp_replace(body, rf"[{SEPARATOR}]*+{word}++[{SEPARATOR}]*+", "x")
    n_words = F.when(body.rlike(word), F.length(marks)).otherwise(0).cast("long")
    words = F.array_remove(F.split(F.translate(body, UPPER, LOWER), rf"[{SEPARATOR}]+"), "")
    found = F.when(body.rlike(GATE), let(words, lambda w: F.when(F.size(w) > 0, scan_words(w, rules))))
    labels = let(F.col("_found")["base"], lambda b: F.array_sort(F.array_distinct(F.transform(b, lambda x: x["label"]))))
    more = F.transform(F.col("_found")["found"], lambda x: x["label"])
    score = F.aggregate(
        F.col("_found")["found"], F.when(F.size("_found.base") > 0, 0.7).otherwise(0.0).cast("double"),
        lambda a, x: F.greatest(a, x["weight"].cast("double")),
    )
    return docs.withColumns({"_words": n_words, "_found": found}).withColumns({
        "n_words": F.col("_words"),
        "n_base": F.coalesce(F.size("_found.base"), F.lit(0)).cast("long"),
        "first_word": F.array_min(F.transform(F.col("_found")["base"], lambda x: x["at"])),
        "last_word": F.array_max(F.transform(F.col("_found")["base"], lambda x: x["at"])),
        "base_labels": F.coalesce(F.array_join(labels, ","), F.lit("")),
        "labels": F.coalesce(F.array_join(F.array_sort(F.array_union(labels, more)), ","), F.lit("")),
        "score": F.coalesce(score, F.lit(0.0)),
        "detections": F.col("_found")["found"],
    }).drop("_words", "_found")
