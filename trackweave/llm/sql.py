"""DuckDB SQL that the queries must equal, where SQL can say it."""

from __future__ import annotations

from trackweave.llm import licenses
from trackweave.llm.quality_rules import BASE_RULES, RULES, STOP_WORDS, SYMBOLS, Rule

SQL: dict[str, str] = {}

SQL["op2_byte_shards"] = """
WITH crc AS (  -- the table of the check sum, by its rule
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size, xor(list_reduce(list_prepend(4294967295,
    list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc
), ordered AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
    sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id, text_crc32, size) - 1 AS place
  FROM sized
), cut AS (
  SELECT *, least((2 * before + size) * 40 // (2 * total), 39)::INT AS shard FROM ordered
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard
FROM cut
"""


def rule_sql(rule: Rule) -> str:
    value = f"{rule.top}::DOUBLE / greatest({rule.bottom}, 1)" if rule.bottom else rule.top
    sides = [f"{value} < {rule.low}"] * (rule.low is not None) + [f"{value} > {rule.high}"] * (rule.high is not None)
    return f"({' OR '.join(sides)})"


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_FAILED = ", ".join(f"CASE WHEN {rule_sql(r)} THEN '{r.name}' END" for r in RULES)

SQL["op5_quality_rules"] = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
), grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM docs WHERE len(words) >= 3)
), again AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), features AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
    length(text) - length(regexp_replace(text, '!', '', 'g')) AS n_exclamations,
    len(list_filter(words, lambda w: w IN ({_STOP}))) AS n_stop_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, list_filter([{_FAILED}], lambda x: x IS NOT NULL) AS failed FROM features
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({' OR '.join(rule_sql(r) for r in RULES if r.name in BASE_RULES)}) AS base_failed,
  len(failed) = 0 AS kept, coalesce(array_to_string(failed, ','), '') AS failed_rules
FROM judged
"""


def licence_sql() -> str:
    """Detections at anchor words by a join with the rules; containment by a self join."""
    quoted = [(r.anchor, r.pattern.replace("'", "''"), r.label, r.priority, r.weight, n) for n, r in enumerate(licenses.RULES)]
    rules = ",\n    ".join(f"('{a}', '^(?:{p})(?: |$)', '{b}', {c}, {w}, {n})" for a, p, b, c, w, n in quoted)
    base = " UNION ALL ".join(
        f"SELECT k, i, '{label}' AS label FROM spots WHERE "
        + " AND ".join(f"words[i + {j}] = '{w}'" for j, w in enumerate(phrase.split(" "), 1))
        for phrase, label in licenses.BASE.items()
    )
    span = licenses.SPAN
    return rf"""
WITH rules(anchor, pattern, label, priority, weight, n) AS (VALUES
    {rules}
), docs AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), spots AS (
  SELECT k, words, unnest(range(len(words))) AS i FROM docs
), base AS ({base}), tried AS (
  SELECT k, i, rtrim(regexp_extract(array_to_string(words[i + 1:i + {span}], ' '), pattern)) AS hit, label, priority, weight, n
  FROM spots JOIN rules ON anchor = words[i + 1]
), hits AS (
  SELECT k, i, i + len(string_split(hit, ' ')) AS e, label, priority, weight
  FROM tried WHERE hit <> '' QUALIFY row_number() OVER (PARTITION BY k, i ORDER BY n) = 1
), kept AS (
  SELECT k, label, weight FROM hits h WHERE NOT EXISTS (
    SELECT 1 FROM hits o WHERE o.k = h.k AND o.i < h.i AND o.e >= h.e AND o.priority >= h.priority)
), b AS (
  SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY k
), l AS (
  SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT k, label FROM kept UNION SELECT k, label FROM base) GROUP BY k
), s AS (SELECT k, max(weight) AS score FROM kept GROUP BY k)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(coalesce(score, 0), CASE WHEN n_base > 0 THEN 0.7 ELSE 0 END)::DOUBLE AS score
FROM docs LEFT JOIN b USING (k) LEFT JOIN l USING (k) LEFT JOIN s USING (k)
"""


SQL["op4_license_scan"] = licence_sql()

SQL["op7_suffix_trees"] = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
), spots AS (
  SELECT doc_id, i, array_to_string(words[i + 1:i + 20], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(len(words) - 19)) AS i FROM docs WHERE len(words) >= 20)
), repeats AS (
  SELECT doc_id, i FROM spots QUALIFY row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) > 1
), covered AS (
  SELECT DISTINCT doc_id, i + k AS place FROM repeats, range(20) AS o(k)
), words AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM docs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS body, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, place)
  GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

SQL["op8_jaccard_join"] = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{_WORD}') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i + 1:i + 5], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 4, 1))) AS i FROM docs WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT doc_id, b FROM reach JOIN links ON other = a
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN sizes USING (doc_id)
"""

SQL["op12_benchmark_decontamination"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(
    translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, size, array_to_string(words[i + 1:i + size], ' ') AS gram FROM (
    SELECT item, words, least(len(words), 10) AS size, unnest(range(greatest(len(words) - 9, 1))) AS i
    FROM items WHERE len(words) > 0)
), spots AS (
  SELECT k, size, i, array_to_string(words[i + 1:i + size], ' ') AS gram
  FROM (SELECT k, words, size, unnest(range(len(words) - size + 1)) AS i
    FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)
), hits AS (
  SELECT k, i, size, item FROM spots JOIN windows USING (size, gram)
), hit AS (
  SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS place FROM hits) GROUP BY k
), listed AS (
  SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY k
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (k) LEFT JOIN listed USING (k)
"""
