"""DuckDB SQL of the core's queries, written apart from their Spark expressions."""

from __future__ import annotations

from claimloom.plans.units_sql import P4

# White space, digits and line ends as the Spark patterns see them.
S = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
D = r"\p{Nd}"
BREAK = r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])"
SPANS = "(SELECT DISTINCT span_id, document_id, location_kind, location_index, location_label, section, text FROM spans)"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{S}+', ''), '{S}+$', '')"


def _flat(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{S}+', ' ', 'g')")


def _lines(x: str) -> str:
    split = f"string_split(regexp_replace({x}, '{BREAK}', chr(10), 'g'), chr(10))"
    return f"list_filter(list_transform({split}, lambda l: {_strip('l')}), lambda l: l <> '')"


def _id(prefix: str, *parts: str) -> str:
    def part(p: str) -> str:
        text = f"coalesce(CAST({p} AS VARCHAR), '')"
        return f"unhex(printf('%016x', octet_length(encode({text})))) || encode({text})"

    return f"'{prefix}_' || substr(sha256({' || '.join(map(part, parts))}), 1, 16)"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _count(lines: str, pattern: str) -> str:
    return f"len(list_filter({lines}, lambda l: {_has('l', pattern)}))"


WORD_CELL = "[A-Z][a-z]+(" + S + r"+(et" + S + r"+al\.?|and" + S + "+[A-Z][a-z]+))?"
YEAR = r"((19|20)" + D + "{2})"
NUMBERED = f"(?i)^{S}*{D}{{1,3}}\\.{S}+[A-Z][A-Za-z''\\-]+({S}+[A-Z]\\.|{S}+et{S}+al\\.?)[^\\n]*?[.,;(\\[–—]{S}*(19|20){D}{{2}}\\b"
LEADER = f"^{S}*({D}+(\\.{D}+)*{S}+)?[A-Za-z][A-Za-z0-9 /,&()''\\-]{{2,}}{S}+\\.{{3,}}{S}*{D}+{S}*$"
HEADING = f"^{S}*{D}+(\\.{D}+)*\\.?{S}+[A-Za-z][A-Za-z0-9 /,&()''\\-]{{3,120}}$"

NOISE = f"""
SELECT s.*, d.kind AS document_kind,
  coalesce({_has("coalesce(section, '')", r"(?i)\b(references?|bibliograph(y|ies)|sources)\b")}
    OR {_has("text", f"(?i)^{S}*REF-{D}+\\.{S}")}
    OR coalesce(regexp_replace(lower(ls[1]), ':+$', '') IN ('references', 'reference list', 'bibliography', 'sources'), false)
    OR (location_kind = 'page' AND {_count("ls", NUMBERED)} >= 2), false) AS bibliography,
  coalesce((contains(lower(ls[1]), 'table of contents') AND {_count("ls", LEADER)} >= 1)
    OR (location_kind = 'page' AND {_count("ls", LEADER)} >= 3), false) AS contents,
  coalesce(flat <> '' AND (coalesce(location_kind = 'paragraph' AND {_strip("section")} <> '' AND flat = {_flat("section")}, false)
    OR (location_kind = 'page' AND section IS NULL AND length(flat) <= 140 AND len(string_split(flat, ' ')) <= 12
      AND right(flat, 1) NOT IN ('.', ';', ':') AND {_has("flat", HEADING)})), false) AS heading,
  coalesce(location_kind = 'page' AND len(ls) BETWEEN 1 AND 4
    AND {_has("array_to_string(ls, ' ')", r"(?i)\b(document|rev\.?|revision)\b")}
    AND {_has("array_to_string(ls, ' ')", f"(?i)\\b(page{S}+)?{D}+{S}*(\\({S}*{D}+{S}*\\)|of{S}+{D}+)")}, false) AS chrome,
  coalesce({_has("ls[1]", f"(?i)^{S}*appendix\\b")}
    AND {_count("ls[2:]", f"(?i)^{S}*\\[[^\\]]*(insert|placeholder|to be completed)[^\\]]*\\]{S}*$")} >= 2, false) AS appendix,
  coalesce(coalesce(d.kind = 'OTHER', true)
    AND {_has("flat", f"(?i)\\b(this{S}+guidance|guidance{S}+document|template)\\b")}
    AND {_has("flat", r"(?i)\b(shall|should|recommended)\b")}, false) AS guidance
FROM (SELECT *, {_lines("text")} AS ls, {_flat("text")} AS flat FROM {SPANS}) s
LEFT JOIN (SELECT document_id, any_value(kind) AS kind FROM dossier_documents GROUP BY 1) d USING (document_id)
"""

KIND = """
CASE WHEN contains(stem, 'gspr') THEN 'GSPR_MAPPING'
     WHEN list_contains(words, 'evidence') OR contains(stem, 'evidence_table') THEN 'EVIDENCE_TABLE'
     WHEN list_contains(words, 'pmcf') THEN 'PMCF' WHEN list_contains(words, 'psur') THEN 'PSUR' WHEN list_contains(words, 'pms') THEN 'PMS'
     WHEN list_contains(words, 'sscp') THEN 'SSCP' WHEN list_contains(words, 'cer') OR contains(stem, 'clinical_evaluation') THEN 'CER'
     WHEN lower(path) LIKE '%.pdf' AND (contains(lower(path), 'bibliography/') OR contains(lower(path), 'sources/')) THEN 'SOURCE_PDF'
     ELSE 'OTHER' END
"""
STEM = "lower(replace(replace(regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1'), '-', '_'), ' ', '_'))"
KINDS = f"SELECT document_id, {KIND} AS kind FROM (SELECT *, string_split(stem, '_') AS words FROM (SELECT *, {STEM} AS stem FROM dossier_documents))"
TITLE = "summary of safety and clinical performance"

CLEAR = f"SELECT * FROM ({NOISE}) WHERE text IS NOT NULL AND NOT (bibliography OR contents OR heading OR chrome OR appendix)"
CELL = f"^({WORD_CELL}){S}+{YEAR}({S}+n={D}+)?{S}*$"
GUIDE = f"([A-Z]{{2,10}}(/[A-Z]{{2,10}})*){S}+{YEAR}{S}+[Gg]uidelines?\\b"
PAREN = f"\\(({WORD_CELL}),?{S}*{YEAR}\\)"
LIST = f"\\[({D}{{1,3}}{S}*,{S}*)+{D}{{1,3}}\\]"
NAME = "lower(regexp_extract({}, '[A-Z][a-z]+'))"

FORMS = f"""
WITH clear AS (SELECT span_id, document_id, location_kind, text, {_strip("text")} AS cell FROM ({CLEAR})),
cells AS (SELECT * FROM clear WHERE location_kind = 'table_cell' AND {_has("cell", CELL)}),
rest AS (SELECT * FROM clear WHERE NOT (location_kind = 'table_cell' AND {_has("cell", CELL)})),
found AS (
  SELECT span_id, 'author_year_table_cell' AS marker_form, cell AS marker_text,
    {NAME.format("cell")} || '_' || regexp_extract(cell, '{CELL}', 4) AS normalized_key FROM cells
  UNION ALL SELECT span_id, 'nct_id', m, 'nct_' || regexp_extract(m, 'NCT({D}{{8}})', 1)
    FROM (SELECT span_id, unnest(regexp_extract_all(text, '\\(?NCT{D}{{8}}\\)?')) AS m FROM rest)
  UNION ALL SELECT span_id, 'named_guideline', m, replace(lower(regexp_extract(m, '{GUIDE}', 1)), '/', '_') || '_' || regexp_extract(m, '{GUIDE}', 3)
    FROM (SELECT span_id, unnest(regexp_extract_all(text, '{GUIDE}')) AS m FROM rest)
  UNION ALL SELECT span_id, 'author_year_parenthetical', m, {NAME.format("m")} || '_' || regexp_extract(m, '{YEAR}\\)$', 1)
    FROM (SELECT span_id, unnest(regexp_extract_all(text, '{PAREN}')) AS m FROM rest)
  UNION ALL SELECT span_id, 'numeric_bracketed', '[' || {_strip("n")} || ']', NULL
    FROM (SELECT span_id, unnest(string_split(substr(m, 2, length(m) - 2), ',')) AS n
      FROM (SELECT span_id, unnest(regexp_extract_all(text, '{LIST}')) AS m FROM rest))
  UNION ALL SELECT span_id, 'numeric_bracketed', m, NULL
    FROM (SELECT span_id, unnest(regexp_extract_all(text, '\\[{D}{{1,3}}\\]')) AS m FROM rest)
  UNION ALL SELECT span_id, 'numeric_parenthetical', parts[i], 'footnote_' || short || '_' || substr(parts[i], 2, length(parts[i]) - 2)
    FROM (SELECT span_id, short, parts, unnest(range(2, len(parts), 2)) AS i FROM (
      SELECT span_id, regexp_extract(document_id, '^doc_([0-9a-f]{{8}})[0-9a-f]*$', 1) AS short,
        string_split(regexp_replace(text, '(\\({D}{{1,2}}\\))', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM rest))
    WHERE short <> '' AND NOT {_has("parts[i - 1]", "[A-Za-z%]$")} AND NOT {_has("parts[i + 1]", f"^[A-Za-z%]|^{D}")}
  UNION ALL SELECT span_id, 'ref_id_numeric', m, 'ref_' || substr(m, 5)
    FROM (SELECT span_id, unnest(regexp_extract_all(text, 'REF-{D}{{1,4}}\\b')) AS m FROM rest)
)
SELECT span_id, marker_form, marker_text, normalized_key, count(*) AS n FROM found GROUP BY ALL
"""

COUNTS = f"""
SELECT {_id("claim", "document_id", "span_id", "low", "'extract.numeric.count:v1'", "number")} AS claim_id, span_id, text FROM (
  SELECT *, row_number() OVER (PARTITION BY span_id, low ORDER BY i) AS number FROM (
    SELECT document_id, span_id, i, m[i] AS text, {_flat("lower(m[i])")} AS low FROM (
      SELECT document_id, span_id, m, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT document_id, span_id, regexp_extract_all(text, 'n{S}*={S}*{D}+') AS m
        FROM ({NOISE}) WHERE text IS NOT NULL AND NOT (bibliography OR contents OR heading OR chrome OR appendix OR guidance)))))
"""

ROWS = f"""
SELECT *, CAST(nullif(regexp_extract(location_label, '^[^:]+:[A-Z]([0-9]+)$', 1), '') AS BIGINT) AS "row", coalesce(section, '') AS sec, {_flat("lower(text)")} AS value
FROM ({NOISE})
"""
GAPS = f"""
WITH cells AS ({ROWS}),
rows_ AS (SELECT document_id, "row",
    max_by(value, (location_index, span_id)) FILTER (WHERE {_has("sec", "(?i)C=Applicable")}) AS applies,
    max_by(value, (location_index, span_id)) FILTER (WHERE {_has("sec", "(?i)E=Status")} AND NOT {_has("sec", "(?i)C=Applicable")}) AS status,
    bool_or({_has("sec", "(?i)D=Evidence_Document")}) AS has_evidence
  FROM cells WHERE "row" IS NOT NULL AND text IS NOT NULL GROUP BY ALL)
SELECT c.document_id, c."row", c.span_id FROM cells c JOIN rows_ r ON c.document_id = r.document_id AND c."row" = r."row"
WHERE r.applies IN ('yes', 'y', 'true', '1', 'applicable')
  AND NOT coalesce(r.status IN ('no', 'n', 'false', '0', 'not applicable', 'n/a', 'na'), false) AND NOT r.has_evidence
  AND c.document_kind = 'GSPR_MAPPING' AND {_has("c.sec", "(?i)B=Requirement")} AND c.value <> ''
  AND NOT (bibliography OR contents OR heading OR chrome OR appendix OR guidance)
"""

PDF = f"([A-Z][a-z]+({S}+[A-Z]\\.)?({S}+et{S}+al\\.?)?)({S}|[.,])*\\(?{YEAR}\\)?"
SOURCES = f"""
WITH s AS (SELECT * FROM {SPANS}),
keys AS (SELECT document_id, arg_min({NAME.format(f"regexp_extract(text, '{PDF}', 1)")} || '_' || regexp_extract(text, '{PDF}', 5), (location_index, span_id)) AS citation_key
  FROM s WHERE {_has("text", PDF)} GROUP BY 1),
local AS (SELECT DISTINCT path, citation_key FROM dossier_documents d LEFT JOIN keys USING (document_id) WHERE d.kind = 'SOURCE_PDF'),
known AS (SELECT path FROM dossier_documents UNION SELECT string_split(path, '/')[-1] FROM dossier_documents),
missing AS (SELECT {_strip("text")} AS path, string_agg(DISTINCT span_id, ',' ORDER BY span_id) AS origin_span_ids FROM s
  WHERE location_kind = 'table_cell' AND {_has("section", "(?i)D=Evidence_Document")}
    AND document_id IN (SELECT document_id FROM dossier_documents WHERE kind = 'GSPR_MAPPING') AND {_strip("text")} <> ''
    AND {_strip("text")} NOT IN (SELECT path FROM known WHERE path IS NOT NULL) GROUP BY 1)
SELECT {_id("src", "path", "citation_key")} AS source_id, path, citation_key, 'local_fulltext' AS availability_status, '' AS origin_span_ids FROM local
UNION ALL SELECT {_id("src", "path", "''")}, path, NULL, 'missing_file', origin_span_ids FROM missing
"""

GRAPH_SOURCES = "(SELECT record_id AS source_id, max(path) AS path, max(citation_key) AS citation_key FROM graph_records WHERE record_type = 'source' GROUP BY 1)"
MENTIONS = "(SELECT DISTINCT * FROM citation_mentions)"
BROKEN = f"""
SELECT 'ECO-CITE-' || substr(sha256('CITE|' || array_to_string(list_sort([document_id, span_id, mention_id]), '|')), 1, 8) AS eco_id,
  'unresolved_citation_marker' AS finding_type, document_id || ';' || span_id || ';' || mention_id AS affected_object_ids
FROM {MENTIONS} WHERE marker_form <> 'numeric_parenthetical'
  AND ((normalized_key IS NOT NULL AND normalized_key NOT IN (SELECT citation_key FROM {GRAPH_SOURCES} WHERE citation_key <> ''))
    OR (marker_form = 'numeric_bracketed' AND normalized_key IS NULL))
"""
LINKS = f"""
WITH src AS (SELECT citation_key, list_sort(list(DISTINCT source_id)) AS ids FROM {GRAPH_SOURCES} WHERE citation_key IS NOT NULL GROUP BY 1),
m AS (SELECT * FROM {MENTIONS}),
hit AS (SELECT span_id, mention_id, ids FROM m JOIN src ON normalized_key = citation_key WHERE marker_form IN ('author_year_parenthetical', 'author_year_table_cell')),
per AS (SELECT span_id, arg_min(ids[1], mention_id) FILTER (WHERE len(ids) = 1) AS resolved,
    list_sort(list_distinct(flatten(list(ids) FILTER (WHERE len(ids) > 1)))) AS candidates FROM hit GROUP BY 1),
b AS (SELECT DISTINCT span_id, true AS bracketed FROM m WHERE marker_form = 'numeric_bracketed')
SELECT mention_id AS claim_id, resolved AS source_id,
  CASE WHEN resolved IS NOT NULL THEN 'resolved' WHEN len(candidates) > 0 THEN 'source_ambiguous' WHEN bracketed THEN 'source_unresolved' ELSE 'manual_review_required' END AS status,
  CASE WHEN resolved IS NOT NULL THEN 'explicit_citation' WHEN len(candidates) > 0 THEN 'explicit_citation_ambiguous' ELSE 'no_link_found' END AS linking_method,
  CASE WHEN resolved IS NULL AND len(candidates) > 0 THEN array_to_string(candidates, ',') ELSE '' END AS candidates
FROM m LEFT JOIN per USING (span_id) LEFT JOIN b USING (span_id)
"""

RULES = """
(VALUES ('guidance.sscp.required_section.intended_purpose', 0, 'intended purpose'), ('guidance.sscp.required_section.intended_purpose', 1, 'intended use'),
 ('guidance.sscp.required_section.device_description', 0, 'device description'), ('guidance.sscp.required_section.device_description', 1, 'description of the device'),
 ('guidance.sscp.required_section.device_description', 2, 'operating principles'), ('guidance.sscp.required_section.device_description', 3, 'mode of action'),
 ('guidance.sscp.required_section.device_description', 4, 'mode(s) of action'), ('guidance.sscp.metadata.basic_udi_di_present', 0, 'basic udi-di'),
 ('guidance.sscp.metadata.basic_udi_di_present', 1, 'basic udi di'), ('guidance.sscp.metadata.notified_body_identifier', 0, 'notified body'),
 ('guidance.sscp.metadata.notified_body_identifier', 1, 'nb''s name'), ('guidance.sscp.metadata.notified_body_identifier', 2, 'nb’s name'),
 ('guidance.sscp.metadata.notified_body_identifier', 3, 'single identification number')) p(rule_id, pattern_pos, pattern)
"""
EVIDENCE = f"""
SELECT rule_id, dossier_id, CAST(match_no AS INTEGER) AS match_no, span_id, matched_pattern, left({_flat("text")}, 200) AS span_text_preview FROM (
  SELECT *, row_number() OVER (PARTITION BY rule_id, dossier_id ORDER BY document_id, location_kind, location_index, span_id) AS match_no FROM (
    SELECT rule_id, dossier_id, s.document_id, location_kind, location_index, span_id, text, arg_min(pattern, pattern_pos) AS matched_pattern
    FROM {SPANS} s JOIN (SELECT DISTINCT document_id, dossier_id FROM dossier_documents WHERE kind = 'SSCP') USING (document_id)
    JOIN {RULES} ON contains(lower(text), pattern) GROUP BY ALL)) WHERE match_no <= 5
"""

RUNNING = f"""
WITH l AS (SELECT document_id, location_index AS page, i, {_strip("x[i]")} AS text FROM (
    SELECT document_id, location_index, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS x FROM {SPANS} WHERE location_kind = 'page'))),
pages AS (SELECT document_id, count(DISTINCT page) AS n_pages FROM l GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY i) AS f, row_number() OVER (PARTITION BY document_id, page ORDER BY i DESC) AS t FROM l WHERE text <> ''),
e AS (SELECT document_id, text, 'header' AS place FROM r WHERE f <= 3 UNION ALL SELECT document_id, text, 'footer' FROM r WHERE t <= 3)
SELECT document_id, place, text, count(*) AS n FROM e JOIN pages USING (document_id) GROUP BY document_id, place, text, n_pages
HAVING n_pages >= 3 AND count(*) >= greatest(2, floor(n_pages * 0.8))
"""

Q0 = "text"
Q1 = "translate(text, '“”‘’‚‛', '\"\"''''''''')"
Q2 = f"replace(replace(replace({Q1}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')"
Q3 = f"translate({Q2}, '‐‑–', '---')"
Q4 = f"regexp_replace({Q3}, ' {{2,}}', ' ', 'g')"
Q5 = f"regexp_replace({Q4}, ' ([,;:!?.])', '\\1', 'g')"
NORMAL = f"""
SELECT span_id, e AS text, array_to_string(list_filter([
  CASE WHEN text <> a THEN 'smart_quotes_to_ascii' END, CASE WHEN a <> b THEN 'ligatures_expanded' END, CASE WHEN b <> c THEN 'nb_hyphens_to_ascii' END,
  CASE WHEN c <> d THEN 'double_spaces_collapsed' END, CASE WHEN d <> e THEN 'space_before_punctuation_removed' END], lambda x: x IS NOT NULL), ',') AS applied
FROM (SELECT span_id, text, {Q1} AS a, {Q2} AS b, {Q3} AS c, {Q4} AS d, {Q5} AS e FROM {SPANS})
"""

SQL = {
    "p4_found": P4,
    "document_kinds": KINDS.replace("AS kind", "AS inferred_kind"),
    "document_kinds_refined": f"""
      SELECT document_id, CASE WHEN kind = 'OTHER' AND document_id IN (SELECT document_id FROM {SPANS}
        WHERE {_flat("lower(text)")} = '{TITLE}' OR starts_with({_flat("lower(text)")}, '{TITLE}:') OR starts_with({_flat("lower(text)")}, '{TITLE} -')
          OR starts_with({_flat("lower(text)")}, '{TITLE} –') OR starts_with({_flat("lower(text)")}, '{TITLE} —')) THEN 'SSCP' ELSE kind END AS kind FROM ({KINDS})""",
    "document_ids": f"SELECT document_id, {_id('doc', 'kind', 'path', 'sha256')} AS computed_id FROM dossier_documents",
    "span_ids": f"SELECT span_id, {_id('span', 'document_id', 'location_kind', 'location_index', 'location_label', 'sha256(text)')} AS computed_id FROM {SPANS}",
    "span_noise": f"""
      SELECT span_id, array_to_string(list_filter([CASE WHEN bibliography THEN 'bibliography' END, CASE WHEN contents THEN 'table_of_contents' END,
          CASE WHEN heading THEN 'heading' END, CASE WHEN chrome THEN 'pdf_chrome' END, CASE WHEN appendix THEN 'appendix_template' END,
          CASE WHEN guidance THEN 'guidance_meta' END], lambda x: x IS NOT NULL), ',') AS reasons,
        bibliography OR contents OR heading OR chrome OR appendix OR guidance AS suppress_claims,
        bibliography OR contents OR heading OR chrome OR appendix AS citation_noise, bibliography OR guidance AS retain_as_anchor FROM ({NOISE})""",
    "citation_forms": FORMS,
    "count_claims": COUNTS,
    "requirement_gaps": GAPS,
    "source_rows": SOURCES,
    "broken_citations": BROKEN,
    "mention_links": LINKS,
    "graph_closure": f"SELECT DISTINCT document_id AS record_id FROM {MENTIONS} WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT record_id FROM graph_records WHERE record_id IS NOT NULL)",
    "rule_evidence": EVIDENCE,
    "anchor_pages": r"""
      SELECT anchor_id, CAST(regexp_extract_all(left(markdown_text, char_offset), '<!--\s*page\s*=\s*(\d+)\s*-->', 1)[-1] AS INTEGER) AS page
      FROM source_anchors JOIN (SELECT DISTINCT md_id, markdown_text FROM extracted_markdown) USING (md_id)""",
    "excerpt_anchors": r"""
      SELECT anchor_id AS excerpt_id, CAST(pos AS INTEGER) AS char_offset, CAST(length(left(t, pos)) - length(replace(left(t, pos), chr(10), '')) + 1 AS INTEGER) AS line_number,
        CAST(regexp_extract_all(left(t, pos), '<!--\s*page\s*=\s*(\d+)\s*-->', 1)[-1] AS INTEGER) AS page_anchor, substr(t, pos + 1, 240) AS preview, 'verbatim' AS matched_via
      FROM (SELECT DISTINCT anchor_id, markdown_text AS t, strpos(markdown_text, preview) - 1 AS pos
        FROM source_anchors JOIN (SELECT DISTINCT md_id, markdown_text FROM extracted_markdown) USING (md_id) WHERE preview <> '') WHERE pos >= 0""",
    "layout_normalised": NORMAL,
    "layout_heading_levels": """
      SELECT doc, size, CAST(level AS INTEGER) AS level FROM (SELECT doc, size, row_number() OVER (PARTITION BY doc ORDER BY size DESC) AS level
        FROM (SELECT DISTINCT l_orderkey AS doc, round(CAST(l_quantity AS DOUBLE), 1) AS size FROM lineitem WHERE CAST(l_quantity AS DOUBLE) >= 11.5)) WHERE level <= 3""",
    "layout_running_lines": RUNNING,
    "table_issues": """
      SELECT 'duplicated' AS "check", span_id AS key, 'span_id' AS "column", CAST(count(*) AS VARCHAR) AS value FROM spans WHERE span_id IS NOT NULL GROUP BY span_id HAVING count(*) > 1
      UNION ALL SELECT 'outside', span_id, 'location_kind', location_kind FROM spans WHERE location_kind NOT IN ('paragraph', 'page')
      UNION ALL SELECT 'unknown', anchor_id, 'md_id', md_id FROM source_anchors WHERE md_id NOT IN (SELECT md_id FROM extracted_markdown WHERE md_id IS NOT NULL)
      UNION ALL SELECT 'outside', anchor_id, 'matched_via', matched_via FROM source_anchors WHERE matched_via NOT IN ('verbatim', 'whitespace_normalised')
      UNION ALL SELECT 'absent', document_id, 'metadata', k FROM dossier_documents, (VALUES ('extension'), ('maker')) t(k) WHERE NOT coalesce(list_contains(map_keys(metadata), k), false)
      UNION ALL SELECT 'blank', span_id, 'text', text FROM spans WHERE trim(coalesce(text, ''), ' ') = ''
      UNION ALL SELECT 'blank', span_id, 'location_label', location_label FROM spans WHERE trim(coalesce(location_label, ''), ' ') = ''""",
}
