"""DuckDB SQL of the corpus queries that SQL can say, written apart from the operators."""

from __future__ import annotations

# Look-alikes by hand, the Latin letter first.
ALIKE = (
    "AАΑ BВΒ CСϹ EЕΕ HНΗ IІΙ JЈ KКΚ MМΜ NΝ OОΟ PРΡ SЅ TТΤ XХΧ YҮΥ ZΖ aаα cсϲ dԁ eе gց hһ iіι jјϳ lӏ nո oоο pрρ qԛ sѕ uυ vνѵ wԝ xх yуγ ʙв ᴋкκ ᴍм ᴛтτ μµ"
).split()
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# End of the fixed values.


def look(x: str) -> str:
    """What ``x`` looks like: wide signs narrow, look-alikes Latin, one blank and hyphen, nothing invisible."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    narrow = "".join(chr(ord(c) - 0xFEE0) for c in wide).replace("'", "''")
    for sign, letters in LIGATURES.items():
        x = f"replace({x}, '{sign}', '{letters}')"
    x = f"translate({x}, '{wide}‐‑﹣', '{narrow}---')"
    x = f"regexp_replace(regexp_replace({x}, '[\\p{{Cf}}\\x{{34f}}]', '', 'g'), '[\\p{{Zs}}\\t]', ' ', 'g')"
    return f"nfc_normalize(translate(nfc_normalize({x}), '{''.join(w[1:] for w in ALIKE)}', '{''.join(w[0] * (len(w) - 1) for w in ALIKE)}'))"


WORDS = f"regexp_extract_all(lower({look('text')}), '[\\p{{L}}\\p{{N}}]+')"
RUNS = "[array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]"

P6 = f"""
WITH i AS (SELECT item_id, unnest({RUNS}) AS run, len(w) - 4 AS n FROM (SELECT item_id, {WORDS} AS w FROM eval_items)),
d AS (SELECT DISTINCT doc_id, unnest({RUNS}) AS run FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
h AS (SELECT doc_id, item_id, count(*) AS held, any_value(n) AS n FROM i JOIN d USING (run) GROUP BY ALL)
"""

LETTERS = "regexp_replace(lower(line), '[^\\p{L}]+', '', 'g')"
SAME = "key = centre OR (abs(length(key) - length(centre)) <= 2 AND least(length(key), length(centre)) >= 4 AND levenshtein(key, centre) <= CASE WHEN least(length(key), length(centre)) >= 6 THEN 2 ELSE 1 END)"
P3 = f"""
WITH t AS (SELECT DISTINCT dossier_id, document_id, span_id, {look("text")} AS text FROM spans JOIN dossier_documents USING (document_id)
  WHERE location_kind IN ('page', 'paragraph') AND dossier_id IS NOT NULL),
n AS (SELECT dossier_id, greatest(5, ceil(count(DISTINCT document_id) * 0.25)) AS needed FROM t GROUP BY 1),
x AS (SELECT dossier_id, document_id, span_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM t),
l AS (SELECT *, CASE WHEN {LETTERS} <> '' THEN {LETTERS} WHEN regexp_matches(line, '\\S') THEN '#' END AS key FROM x),
k AS (SELECT dossier_id, key, count(DISTINCT document_id) AS docs FROM l WHERE key IS NOT NULL GROUP BY ALL),
c AS (SELECT dossier_id, key AS centre, needed FROM k JOIN n USING (dossier_id) WHERE docs >= greatest(2, ceil(needed / 8))),
near AS (SELECT dossier_id, centre, key, needed FROM c JOIN k USING (dossier_id) WHERE {SAME}),
often AS (SELECT dossier_id, centre FROM near JOIN l USING (dossier_id, key) GROUP BY dossier_id, centre, needed HAVING count(DISTINCT document_id) >= needed),
gone AS (SELECT DISTINCT dossier_id, key FROM near JOIN often USING (dossier_id, centre)),
c2 AS (SELECT dossier_id, key AS centre, needed FROM k JOIN n USING (dossier_id) ANTI JOIN gone USING (dossier_id, key) WHERE length(key) >= 4),
near2 AS (SELECT dossier_id, centre, key, needed FROM c2 JOIN k USING (dossier_id) WHERE {SAME}),
often2 AS (SELECT dossier_id, centre FROM near2 JOIN l USING (dossier_id, key) GROUP BY dossier_id, centre, needed HAVING count(DISTINCT document_id) >= needed)
SELECT DISTINCT span_id, CAST(line_no AS INTEGER) AS line_no FROM l JOIN (SELECT * FROM gone UNION SELECT dossier_id, key FROM near2 JOIN often2 USING (dossier_id, centre)) USING (dossier_id, key)
"""

STOP = "see also cited from after according adapted trial study reference references number table abstract page personal note above unknown folder ibid guideline guidelines recommendation recommendations gdl gdls consensus statement etal et al and und others other".split()
FOLD = f"lower(strip_accents({look('v')}))"
DOTS = r"\b(?:[a-z][.\-] ?){2,}(?:[a-z]\b)?"
PLACES = r"\b(?:pp?|table|fig|figure|chapter|ch|vol|no?)\b\s*[.=]?\s*[0-9]+|\bn\s*=\s*[0-9]+"
TRIAL = r"(?:^|[^a-z])n?ct[^a-z0-9]*((?:[0-9oil][\s.\-]?){7}[0-9oil])(?:[^0-9a-z]|$)"
NUMBERED = r"(?:^|[^a-z])ref(?:erences?|s)?[^a-z0-9]*(?:n[or]\b|number)?[^a-z0-9]*([0-9][0-9oil]{0,5})(?:[^0-9a-z]|$)"
CASES = """
SELECT mention_id AS record_id, CASE WHEN trim(marker_text) <> '' THEN marker_text ELSE normalized_key END AS v FROM citation_mentions
WHERE marker_form NOT LIKE 'numeric\\_%' ESCAPE '\\' AND mention_id IS NOT NULL AND coalesce(normalized_key NOT IN (SELECT citation_key FROM reference_sources WHERE citation_key IS NOT NULL), true)
UNION SELECT record_id, citation_key FROM graph_records WHERE record_type = 'source' AND record_id IS NOT NULL AND citation_key IS NOT NULL
  AND citation_key NOT IN (SELECT citation_key FROM reference_sources WHERE citation_key IS NOT NULL)
"""
PARSED = f"""
SELECT *, CASE WHEN t <> '' THEN 'nct_' || regexp_replace(translate(t, 'oil', '011'), '[^0-9]', '', 'g')
    WHEN r <> '' THEN 'ref_' || CAST(translate(r, 'oil', '011') AS BIGINT) END AS number,
  CASE WHEN y <> '' THEN yl ELSE zl END AS letter,
  CASE WHEN y <> '' THEN CAST(y AS BIGINT) WHEN z <> '' THEN CAST(z AS BIGINT) + CASE WHEN CAST(z AS BIGINT) > 50 THEN 1900 ELSE 2000 END END AS year,
  list_filter(regexp_extract_all(bare, '[a-z]+'), lambda w: length(w) > 1 AND w NOT IN ({', '.join(f"'{w}'" for w in STOP)})) AS names
FROM (SELECT *, regexp_extract(s, '{TRIAL}', 1) AS t, regexp_extract(s, '{NUMBERED}', 1) AS r, regexp_extract(bare, '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:[^0-9]|$)', 1) AS y,
    regexp_extract(bare, '(?:^|[^0-9])(?:19|20)[0-9][0-9]([a-z])(?:[^0-9a-z]|$)', 1) AS yl, regexp_extract(bare, '(?:^|[^0-9])([0-9][0-9])[a-z]?(?:[^0-9a-z]|$)', 1) AS z,
    regexp_extract(bare, '(?:^|[^0-9])[0-9][0-9]([a-z])(?:[^0-9a-z]|$)', 1) AS zl
  FROM (SELECT *, regexp_replace(s, '{PLACES}', ' ', 'g') AS bare
    FROM (SELECT *, CASE WHEN d <> '' THEN replace(j, d, regexp_replace(d, '[. \\-]', '', 'g')) ELSE j END AS s
      FROM (SELECT *, regexp_extract(j, '{DOTS}') AS d FROM (SELECT *, regexp_replace({FOLD}, '([a-z])[-‐]\\s+([a-z])', '\\1\\2', 'g') AS j FROM src)))))
"""
NEAR = "damerau_levenshtein({0}, {1}) <= CASE WHEN length({1}) > 6 THEN 2 WHEN length({1}) > 3 THEN 1 ELSE 0 END"
SAME_YEAR = "c.year = coalesce(e.pub_year, e.year) AND c.letter = e.letter"
LONG = "list_filter(names, lambda w: length(w) > 3)"
P5 = f"""
WITH c AS (WITH src AS ({CASES}) {PARSED}),
e AS (WITH src AS (SELECT ref_id, form, pub_year, citation_key AS v FROM reference_sources WHERE citation_key IS NOT NULL) {PARSED}),
hits AS (
  SELECT record_id, ref_id, 0 AS d FROM c JOIN e ON c.number = e.number
  UNION ALL SELECT record_id, ref_id, damerau_levenshtein(w, e.names[1]) FROM (SELECT record_id, year, letter, unnest(CASE WHEN len(ls) > 1 THEN [ls[1], ls[1] || ls[2], names[1]] ELSE ls[:1] || names[:1] END) AS w FROM (SELECT *, {LONG} AS ls FROM c) WHERE number IS NULL) c
    JOIN e ON e.form = 'author_year' AND {SAME_YEAR} AND {NEAR.format("w", "e.names[1]")}
  UNION ALL SELECT record_id, ref_id, damerau_levenshtein(c.names[1], e.names[1]) FROM c JOIN e ON c.number IS NULL AND e.form = 'named_guideline' AND {SAME_YEAR} AND len(c.names) = 1 AND len(e.names) = 1
    AND {NEAR.format("c.names[1]", "e.names[1]")}
  UNION ALL SELECT record_id, ref_id, damerau_levenshtein(c.names[i], e.names[1]) + damerau_levenshtein(c.names[3 - i], e.names[2]) FROM c, range(1, 3) t(i), e WHERE c.number IS NULL AND e.form = 'named_guideline'
    AND {SAME_YEAR} AND len(c.names) = 2 AND len(e.names) = 2 AND {NEAR.format("c.names[i]", "e.names[1]")} AND {NEAR.format("c.names[3 - i]", "e.names[2]")}),
best AS (SELECT record_id, min(d) AS d FROM hits GROUP BY 1),
one AS (SELECT record_id, min(ref_id) AS ref_id FROM hits JOIN best USING (record_id, d) GROUP BY 1 HAVING count(DISTINCT ref_id) = 1)
SELECT DISTINCT record_id, coalesce(ref_id, 'none') AS ref_id FROM c LEFT JOIN one USING (record_id)
"""

SQL = {
    "p5_found": P5,
    "p3_found": P3,
    "p1_found": f"""
      WITH s AS (SELECT DISTINCT span_id, text, {look("text")} AS look FROM spans WHERE text IS NOT NULL)
      SELECT a.span_id AS key_a, b.span_id AS key_b FROM s a JOIN s b ON a.look = b.look AND a.span_id < b.span_id AND a.text <> b.text
      UNION SELECT anchor_id, trim({look("matched_via")}) FROM source_anchors
      WHERE matched_via NOT IN ('verbatim', 'whitespace_normalised') AND trim({look("matched_via")}) IN ('verbatim', 'whitespace_normalised')""",
    "p6_found": P6 + "SELECT doc_id, item_id FROM h WHERE held * 3 >= n",
    "p6_items": P6 + "SELECT item_id, count(*) AS n_docs FROM h WHERE held * 3 >= n GROUP BY 1",
}
