"""Notices as they are written: versions before the word licence or glued, SPDX ids, grants of one word."""

import re
import time

from pyspark.sql import functions as F

from trackweave.llm import licenses

FORMS = {
    "Apache 2.0 License": "apache-2.0", "Apache-2.0": "apache-2.0", "Apache License": "apache", "GPLv3": "gpl-3",
    "the LGPLv2.1 applies": "lgpl-2.1", "GNU GPLv3": "gpl-3", "GPLv2+": "gpl-2", "LGPLv3": "lgpl-3", "AGPLv3": "agpl-3",
    "BSD-3-Clause": "bsd-3", "BSD-2-Clause": "bsd-2", "3-clause BSD": "bsd-3", "released under the MIT": "mit",
    "Released under MIT.": "mit", "distributed under the terms of the BSD": "bsd", "MPL-2.0": "mpl-2.0", "0BSD": "bsd-0",
    "MIT licensed": "mit", "Apache2": "apache-2.0", "EPL 2.0": "epl-2.0", "LGPLv2": "lgpl-2", "WTFPL": "wtfpl",
    "This program is free software: you can redistribute it and/or modify it": "gpl", "GNU LGPLv2.1": "lgpl-2.1",
    "Permission to use, copy, modify, and/or distribute this software for any purpose": "isc",
    "offered under the Apache": "apache", "BSL-1.0": "boost-1.0",
    "https://creativecommons.org/licenses/by-sa/4.0": "cc-by-sa", "https://creativecommons.org/publicdomain/zero/1.0": "cc0-1.0",
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0", "https://opensource.org/licenses/MIT": "mit",
    "https://www.gnu.org/licenses/old-licenses/gpl-2.0.html": "gpl-2", "Redistributions of source code must retain the": "bsd",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY': "mit", "© 2021 Foo": "copyright-notice", "PostgreSQL License": "postgresql",
    "Ms-PL": "ms-pl", "Microsoft Public License": "ms-pl", "BUSL-1.1": "busl-1.1", "Business Source License": "busl",
    "SSPL v1": "sspl", "Server Side Public License": "sspl", "Elastic License 2.0": "elastic-2.0", "NCSA license": "ncsa",
    "University of Illinois/NCSA Open Source License": "ncsa", "PHP License 3.01": "php-3.01", "Unicode License": "unicode",
    "W3C Software Notice and License": "w3c", "OpenSSL License": "openssl", "CeCILL-B": "cecill-b", "CeCILL v2.1": "cecill",
    "Zope Public License": "zpl", "ZPL 2.1": "zpl", "a commercial license is required": "proprietary",
    "used under a commercial license": "proprietary", "altered; the origin of this software must not be misrepresented": "zlib",
    "the above copyright notice and this permission notice shall be included in all copies": "mit",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software": "unlicense",
    "MIT No Attribution": "mit-0", "PolyForm Noncommercial License": "polyform", "Mulan Permissive Software License, v2": "mulan",
    "distributed under the BSD 3-clause": "bsd-3", "Licensed under Apache-2.0": "apache-2.0",
}
PLAIN = ("an apache pilot", "he went to MIT", "a bsd box", "under the bridge", "2 of 3 clauses", "mozilla 20", "released under the sea",
         "a commercial license to drive", "anyone is free to go", "a php box", "the server side", "5 ms pla")


def test_forms(spark):
    docs = spark.createDataFrame([(t,) for t in (*FORMS, *PLAIN)], "text string")
    rows = {r.text: r for r in licenses.scan(docs).collect()}
    wrong = {t: rows[t].labels for t, label in FORMS.items() if rows[t].labels != label or rows[t].score <= 0}
    assert not wrong
    assert not [t for t in PLAIN if rows[t].labels or rows[t].score]


def test_every_rule_begins_with_its_anchor():
    assert all("(" not in r.anchor and "[" not in r.anchor and " " not in r.anchor for r in licenses.RULES)


def by_hand(text):
    """(start, end, label) of the first rule at every anchor, then without those inside one of no lower priority."""
    words = [w for w in re.split(f"[{licenses.SEPARATOR}]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text)) if w]
    found = []
    for i, word in enumerate(words):
        window = " ".join(words[i:i + licenses.SPAN])
        for rule in licenses.RULES:
            if rule.anchor == word and (hit := re.match(f"(?:{rule.pattern})(?= |$)", window)):
                found.append((i, i + len(hit[0].split(" ")), rule.label, rule.priority))
                break
    return [(a, b, label) for j, (a, b, label, p) in enumerate(found)
            if not any(e >= b and q >= p for _, e, _, q in found[:j])]


def test_detections_by_hand(spark):
    every = " and ".join([*FORMS, *PLAIN])
    docs = spark.createDataFrame([(t,) for t in (*FORMS, *PLAIN, every, every.upper(), every.replace(" ", "\n"))], "text string")
    for row in licenses.scan(docs).collect():
        assert [(d.start, d.end, d.label) for d in row.detections or ()] == by_hand(row.text), row.text


def test_time_of_dense_notices(spark):
    """One row takes little; a megabyte of notices is linear in its length."""
    docs = lambda text: spark.createDataFrame([(text,)], "text string")
    licenses.scan(docs("MIT License")).collect()
    began = time.time()
    licenses.scan(docs("MIT License")).collect()
    one, began = time.time() - began, time.time()
    text = " and ".join(FORMS) + " "
    (row,) = licenses.scan(docs(text * (1_000_000 // len(text)))).select(F.size("detections").alias("n")).collect()
    dense = time.time() - began
    print(f"one row {one:.1f} s, a megabyte {dense:.1f} s")
    assert row.n > 20_000 and one < 6 and dense < 12
