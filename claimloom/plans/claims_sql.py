"""DuckDB SQL of mentions, claims, links and findings, written apart from their Spark expressions.

Offsets are sums of the lengths of the pieces between matches; what a pattern
must not stand behind or before is a condition on the sign there.
"""

from __future__ import annotations

from claimloom.operators.checkers import EVIDENCE, HINT
from claimloom.plans.sql import GAPS, NOISE, Q5, RUNNING, SOURCES, SPANS, S, _flat, _has, _id, _strip

BLANK = S[1:-1]


def re2(pattern: str, ignore_case: bool = False) -> str:
    """``pattern`` with Unicode digits and white space, as a part of a SQL string."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two in (r"\d", r"\s"):
            out.append(r"\p{Nd}" if two == r"\d" else BLANK if inside else f"[{BLANK}]")
            k += 2
        elif two[0] == "\\":
            out.append(two)
            k += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            k += 1
    return ("(?i)" if ignore_case else "") + "".join(out).replace("'", "''")


def found(rows: str, pattern: str, order: int, where: str = "true", ignore_case: bool = False) -> str:
    """All matches in ``rows``: their columns, ord, i, hit, s, e (offsets), prev and next (the signs around)."""
    p = re2(pattern, ignore_case)
    return f"""(SELECT * FROM (SELECT *, s + length(hit) AS e, CASE WHEN s > 0 THEN substr(text, s, 1) ELSE '' END AS prev, substr(text, s + length(hit) + 1, 1) AS next FROM (
      SELECT * EXCLUDE (m, g), {order} AS ord, m[i] AS hit, CAST(coalesce(list_sum(list_transform(g[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS INTEGER) AS s
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM {rows} WHERE regexp_matches(text, '{p}'))))) WHERE {where})"""


LETTER_OR_DIGIT = r"[A-Za-z\p{Nd}]"
NOT_DIGIT = r"NOT regexp_matches(prev, '\p{Nd}')"

# Patterns of citation forms.
AUTHORS = r"[A-Z][a-z]+(?:\s+(?:et\s+al\.?|and\s+[A-Z][a-z]+))?"
YEAR = r"(?:19|20)\d{2}"
CELL = rf"^({AUTHORS})\s+({YEAR})(?:\s+n=\d+)?\s*$"
TRIAL, GUIDE, PAREN = r"\(?NCT\d{8}\)?", rf"[A-Z]{{2,10}}(?:/[A-Z]{{2,10}})*\s+{YEAR}\s+[Gg]uidelines?\b", rf"\({AUTHORS},?\s*{YEAR}\)"
LIST, ONE, NOTE, REFERENCE = r"\[(?:\d{1,3}\s*,\s*)+\d{1,3}\]", r"\[\d{1,3}\]", r"\(\d{1,2}\)", r"REF-\d{1,4}\b"
# End of the fixed values.

NAME = "lower(regexp_extract({}, '[A-Z][a-z]+'))"
YEARS = re2(rf"({YEAR})")


def mentions(spans: str) -> str:
    """document_id, span_id, marker_form, marker_text, normalized_key, marker, ord, i, k, s, e of the mentions in ``spans``."""
    cells = f"(SELECT * FROM {spans} WHERE location_kind = 'table_cell' AND regexp_matches({_strip('text')}, '{re2(CELL)}'))"
    rest = f"(SELECT * FROM {spans} WHERE NOT coalesce(location_kind = 'table_cell' AND regexp_matches({_strip('text')}, '{re2(CELL)}'), false))"
    head = "SELECT document_id, span_id"
    return f"""(
    WITH rest AS {rest}, trials AS {found("rest", TRIAL, 1)}
    {head}, 'author_year_table_cell' AS marker_form, {_strip("text")} AS marker_text, {NAME.format("text")} || '_' || regexp_extract({_strip("text")}, '{re2(CELL)}', 2) AS normalized_key, lower({_strip("text")}) AS marker, 0 AS ord, 1 AS i, 0 AS k,
      CAST(length(regexp_extract(text, '^[{BLANK}]*')) AS INTEGER) AS s, CAST(length(regexp_extract(text, '^[{BLANK}]*')) + length({_strip("text")}) AS INTEGER) AS e FROM {cells}
    UNION ALL {head}, 'nct_id', hit, 'nct_' || regexp_extract(hit, '\\p{{Nd}}+'), 'nct' || regexp_extract(hit, '\\p{{Nd}}+'), 1, i, 0, s, e FROM trials
    UNION ALL {head}, 'numeric_parenthetical', hit, 'footnote_' || substr(document_id, 5, 8) || '_' || substr(hit, 2, length(hit) - 2), hit, 2, i, 0, s, e
      FROM {found("rest", NOTE, 2, f"NOT regexp_matches(prev, '[A-Za-z%]') AND NOT regexp_matches(next, '[A-Za-z%]|{re2(chr(92) + 'd')}')")} n
      WHERE regexp_matches(document_id, '^doc_[0-9a-f]{{8}}[0-9a-f]*$') AND NOT EXISTS (SELECT 1 FROM trials t WHERE t.span_id = n.span_id AND t.text = n.text AND t.s <= n.s AND n.e <= t.e)
    UNION ALL {head}, 'named_guideline', hit, replace(lower(regexp_extract(hit, '^[A-Z/]+')), '/', '_') || '_' || regexp_extract(hit, '{YEARS}', 1), lower(hit), 3, i, 0, s, e FROM {found("rest", GUIDE, 3)}
    UNION ALL {head}, 'author_year_parenthetical', hit, {NAME.format("hit")} || '_' || regexp_extract(hit, '{YEARS}\\)$', 1), lower(hit), 4, i, 0, s, e FROM {found("rest", PAREN, 4)}
    UNION ALL {head}, 'numeric_bracketed', '[' || {_strip("ns[k]")} || ']', NULL, '[' || {_strip("ns[k]")} || ']', 5, i, k, s, e
      FROM (SELECT *, unnest(range(1, len(ns) + 1)) AS k FROM (SELECT *, string_split(substr(hit, 2, length(hit) - 2), ',') AS ns FROM {found("rest", LIST, 5)}))
    UNION ALL {head}, 'numeric_bracketed', hit, NULL, hit, 6, i, 0, s, e FROM {found("rest", ONE, 6)}
    UNION ALL {head}, 'ref_id_numeric', hit, 'ref_' || substr(hit, 5), lower(hit), 7, i, 0, s, e FROM {found("rest", REFERENCE, 7)})"""


SIGNAL = "bibliography OR contents OR heading OR chrome OR appendix"
MENTION_ROWS = f"""
SELECT {_id("cite", "document_id", "span_id", "marker", "'citation_parser:v1'", "occurrence_index")} AS mention_id, document_id, span_id, marker_text, marker_form, normalized_key, occurrence_index, s AS span_offset_start, e AS span_offset_end
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY span_id, document_id, marker_form, marker ORDER BY ord, i, k) AS INTEGER) AS occurrence_index
  FROM {mentions(f"(SELECT * FROM ({NOISE}) WHERE text IS NOT NULL AND NOT ({SIGNAL}))")})
"""

# Patterns and words of claims.
CI = r"(?:95|90|99)\s*%?\s*CI\s*[:\-]\s*[\d.,\s\-]+"
NUMBER = r"[+-]?\d+(?:[.,]\d+)?"
UNITS = r"(?:mmHg|atm|gauss/cm|W/kg|°C|days?|years?)"
VALUES = (
    rf"{NUMBER}\s+to\s+{NUMBER}\s*{UNITS}\b", rf"{NUMBER}\s*[±]\s*{NUMBER}\s*{UNITS}\b", rf"{NUMBER}\s*mmHg\s+(?:drift\s+)?in\s+{NUMBER}\s*(?:h|hours?|days?)\b",
    rf"(?:up\s+to|maximum\s+of|at\s+least|no\s+more\s+than|less\s+than)\s+{NUMBER}\s*{UNITS}\b", rf"(?:≥|≤|>=|<=|>|<)\s*{NUMBER}\s*{UNITS}\b", rf"{NUMBER}\s*{UNITS}\b",
)
TESLA, BURST = rf"{NUMBER}\s+T\b", r"RBP\s*=\s*\d+\.\d+"
IMAGING = r"magnetic\s+field|static|tesla|mri|MR\s+system|MR\s+conditional"
CLASSES = (r"Class\s+II[ab]?\s+(?:[\w-]+\s+){0,4}medical\s+device", r"Class\s+III\s+(?:[\w-]+\s+){0,4}medical\s+device", r"Class\s+I\b.*?\bmedical\s+device")
BODY = r"\b(?:NB|Notified\s+Body)(?:[:\s]+(?:ID\s+)?(?:number\s+)?)?\d{4}\b"
STANDARD = r"\b(EN\s+ISO|USP-NF|ISO|IEC|ASTM|EN)[ \t]+([A-Za-z0-9<][A-Za-z0-9\-.:/<>]*(?:[ \t]+[0-9<][A-Za-z0-9\-.:/<>]*)?)"
PERFORMANCE = r"\b(?:primary\s+endpoint|response\s+rate|sensitivity|specificity|clinical\s+performance|intended\s+use|intended\s+purpose|primary\s+outcome|efficacy|effectiveness)\b"
HEADERS = (r"^Titel:[^\n]*\n(?:[^\n]*\n){0,4}Seite\s+\d+\s+von\s+\d+\s*\n", r"^[^\n]{0,80}\n[^\n]*(?:Summary\s+of\s+Safety|SSCP)[^\n]*\n[^\n]+\n[^\n]*\bPage\s+\d+\s+of\s+\d+[^\n]*\n")
BOILERPLATE = r"intended\s+to\s+provide\s+public\s+access|main\s+aspects\s+of\s+the\s+safety\s+and\s+clinical\s+performance"
# End of the fixed values.

MODEL = r"\bCP\d{1,2}Z\d{2,3}\b"
SIZING = f"""(regexp_matches(text, '{re2("Foreshortening" + chr(92) + "s+(?:Chart|Table)", True)}') OR (regexp_matches(text, '{re2("Percentage" + chr(92) + "s+Shortening", True)}') AND len(regexp_extract_all(text, '{re2(MODEL)}')) >= 1)
  OR (len(regexp_extract_all(text, '{re2(MODEL)}')) >= 2 AND len(ls) >= 4 AND len(regexp_extract_all(text, '{re2(chr(92) + "b" + chr(92) + "d+[.,]" + chr(92) + "d+" + chr(92) + "s*%")}')) >= 2))"""
BLOCKED = "EXISTS (SELECT 1 FROM both_ b WHERE b.span_id = f.span_id AND b.text = f.text AND ((b.s <= f.s AND f.s < b.e) OR (b.s < f.e AND f.e <= b.e)))"


def _numbered(rows: str, kind: str, method: str, same: str = "low") -> str:
    """Claims of ``rows`` (document_id, span_id, ord, i, shown), numbered among those of equal ``same``."""
    return f"""SELECT document_id, span_id, shown AS text, '{kind}' AS claim_type, 'extract.{method}:v1' AS extraction_method, low, row_number() OVER (PARTITION BY document_id, span_id, {same} ORDER BY ord, i) AS number
    FROM (SELECT *, {_flat("lower(shown)")} AS low FROM ({rows}))"""


def _plain(rows: str, shown: str = "hit", more: str = "") -> str:
    return f"SELECT document_id, span_id, ord, i, {shown} AS shown FROM {rows} f {more}"


VALUE_FOLD = "list_reduce(list_transform(hits, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda r: (r.s <= x[1].s AND x[1].s < r.e) OR (r.s < x[1].e AND x[1].e <= r.e))) > 0 THEN acc ELSE acc || x END)"
MARK = "strpos(text, '(atm)') - 1"
AROUND = "substr(text, greatest(s - 200, 0) + 1, e + 200 - greatest(s - 200, 0))"
CLEAN_BODY = f"CASE WHEN location_kind = 'page' THEN CASE WHEN regexp_matches(text, '{re2(HEADERS[0], True)}') THEN regexp_replace(text, '{re2(HEADERS[0], True)}', '') ELSE regexp_replace(text, '{re2(HEADERS[1], True)}', '') END ELSE text END"

CLAIMS = f"""
WITH ev AS (SELECT document_id, span_id, location_kind, text, ls FROM ({NOISE}) WHERE text IS NOT NULL AND NOT ({SIGNAL} OR guidance)),
both_ AS {found("ev", r"\d{1,3}\.\d+\s*%\s*" + rf"\({CI}\)", 1, NOT_DIGIT)},
pct AS ({_plain("both_", f"regexp_extract(hit, '{re2(r'^' + chr(92) + 'd{1,3}' + chr(92) + '.' + chr(92) + 'd+' + chr(92) + 's*%')}') || ' ' || {_strip(f"regexp_extract(hit, '{re2(chr(92) + '(' + CI + chr(92) + ')')}')")}")}
  UNION ALL {_plain(found("ev", r"\d{1,3}\.\d+\s*%", 2, NOT_DIGIT), _strip("hit"), f"WHERE NOT {SIZING} AND NOT {BLOCKED}")}
  UNION ALL {_plain(found("ev", r"\d{1,3}\.\d+\s+percent(?:[^.()\[\]]{0,40})?", 3, NOT_DIGIT, True), _strip("hit"), f"WHERE NOT {SIZING} AND NOT {BLOCKED}")}),
passes AS ({" UNION ALL ".join(f"SELECT * FROM {found('ev', p, k, (f'NOT regexp_matches(prev, {chr(39)}[A-Za-z/{re2(chr(92) + chr(100))}]{chr(39)})' if k == 6 else 'true'), True)}" for k, p in enumerate(VALUES, 1))}
  UNION ALL SELECT * FROM {found("ev", TESLA, 7, f"regexp_matches(next, '^$|[],.)]|{re2(chr(92) + 's')}') AND regexp_matches({AROUND}, '{re2(IMAGING, True)}')")}
  UNION ALL SELECT * FROM {found("ev", BURST, 8, f"{MARK} >= 0 AND abs(s - ({MARK})) <= 500")}),
shown_ AS (SELECT *, CASE WHEN ord = 8 AND row_number() OVER (PARTITION BY document_id, span_id, text, ord ORDER BY i) = 1 THEN CASE WHEN {MARK} < e THEN substr(text, {MARK} + 1, e - ({MARK})) ELSE '' END ELSE hit END AS shown FROM passes),
folded AS (SELECT document_id, span_id, {VALUE_FOLD} AS kept FROM (SELECT document_id, span_id, text, list({{'s': s, 'e': e, 'shown': shown, 'ord': ord, 'i': i}} ORDER BY ord, i) AS hits FROM shown_ GROUP BY ALL)),
values_ AS (SELECT document_id, span_id, x.ord AS ord, x.i AS i, x.shown AS shown FROM (SELECT document_id, span_id, unnest(kept) AS x FROM folded)),
bodies AS (SELECT * EXCLUDE (text), text AS whole, {CLEAN_BODY} AS text FROM ev WHERE coalesce(location_kind <> 'table_cell', true)),
windows AS (SELECT document_id, span_id, ord, i, {_strip("substr(text, greatest(s - 120, 0) + 1, e + 120 - greatest(s - 120, 0))")} AS shown FROM (SELECT * FROM {found("bodies", PERFORMANCE, 1, "true", True)} UNION ALL SELECT * FROM {found("(SELECT * FROM bodies WHERE whole <> text)", r"\b(?:outcome|incidence)\b", 2, "true", True)})),
cited AS (SELECT document_id, span_id, ord, i, {_strip("marker_text")} AS shown FROM {mentions("ev")} WHERE marker_form <> 'numeric_bracketed'),
made AS (
  {_numbered("SELECT * FROM pct", "numeric", "numeric.percentage")}
  UNION ALL {_numbered(_plain(found("ev", CI, 1), _strip("hit"), f"WHERE NOT {BLOCKED}"), "numeric", "numeric.ci")}
  UNION ALL {_numbered(_plain(found("ev", r"n\s*=\s*\d+", 1)), "numeric", "numeric.count")}
  UNION ALL {_numbered("SELECT * FROM values_", "numeric", "numeric.value_unit")}
  UNION ALL SELECT document_id, span_id, {_strip("hit")}, 'classification', 'extract.classification:v1', {_flat("lower(hit)")}, 1 FROM (SELECT document_id, span_id, unnest([{", ".join(f"regexp_extract(text, '{re2(p, True)}')" for p in CLASSES)}]) AS hit FROM ev) WHERE hit <> ''
  UNION ALL {_numbered(_plain(found("ev", r"\bMR\s+[Cc]onditional\b", 1)), "classification", "classification.mr_conditional", "shown")}
  UNION ALL {_numbered(_plain(found("ev", BODY, 1, "true", True)), "classification", "classification.nb_number", "shown")}
  UNION ALL {_numbered(_plain(found(f"(SELECT * FROM ev WHERE regexp_matches(text, '{re2(chr(92) + 'bBasic' + chr(92) + 's+UDI[-' + chr(92) + 's]DI' + chr(92) + 'b|' + chr(92) + 'bEUDAMED' + chr(92) + 'b', True)}'))", r"\d{10,14}[A-Za-z][A-Za-z0-9]*\b", 1, "NOT regexp_matches(prev, '[A-Za-z/]|" + re2(chr(92) + "d") + "')")), "classification", "classification.basic_udi_di", "shown")}
  UNION ALL {_numbered(_plain(found(f"(SELECT * FROM ev WHERE regexp_matches(text, '{re2(chr(92) + 'bEMDN' + chr(92) + 'b', True)}'))", r"[A-Z]\d{8,12}", 1, "NOT regexp_matches(prev || '.' || next, '[A-Za-z]|" + re2(chr(92) + "d") + "')")), "classification", "classification.emdn_code", "shown")}
  UNION ALL {_numbered(_plain(f"(SELECT *, regexp_extract(hit, '{re2(STANDARD, True)}', 1) AS org, regexp_extract(hit, '{re2(STANDARD, True)}', 2) AS code FROM {found('ev', STANDARD, 1, 'true', True)})", "org || ' ' || code", f"WHERE length(code) >= 3 AND regexp_matches(code, '{re2(chr(92) + 'd')}')"), "standard_reference", "classification.harmonized_standard", "shown")}
  UNION ALL SELECT * FROM ({_numbered(f"SELECT * FROM windows WHERE NOT regexp_matches(shown, '{re2(BOILERPLATE, True)}')", "clinical_performance", "clinical_performance")}) WHERE number = 1
  UNION ALL {_numbered("SELECT * FROM cited", "citation", "citation.author_year")}
  UNION ALL SELECT g.document_id, g.span_id, {_strip("text")}, 'completeness', 'extract.completeness.gspr:v1', {_flat("lower(text)")}, 1 FROM ({GAPS}) g JOIN (SELECT DISTINCT document_id, span_id, text FROM spans) USING (document_id, span_id))
SELECT DISTINCT {_id("claim", "document_id", "span_id", "low", "extraction_method", "number")} AS claim_id, document_id, span_id, text, claim_type, extraction_method, 'high' AS confidence_label FROM made
"""

def _part(x: str) -> str:
    return f"(unhex(printf('%016x', octet_length(encode({x})))) || encode({x}))"


LINK = f"'elink_' || substr(sha256({_part('claim_id')} || {_part("coalesce(source_id, '')")} || {_part('status')} || list_reduce(list_concat([encode('')], list_transform(candidates, lambda c: {_part('c')})), lambda x, y: x || y)), 1, 16)"
LINKS = f"""
WITH claims AS ({CLAIMS}), cited AS (SELECT DISTINCT * FROM ({MENTION_ROWS})), src AS ({SOURCES}),
by_key AS (SELECT citation_key, list_sort(list(DISTINCT source_id)) AS ids FROM src WHERE availability_status = 'local_fulltext' AND citation_key IS NOT NULL GROUP BY 1),
hit AS (SELECT span_id, mention_id, ids FROM cited JOIN by_key ON normalized_key = citation_key WHERE marker_form IN ('author_year_parenthetical', 'author_year_table_cell')),
per AS (SELECT span_id, arg_min(ids[1], mention_id) FILTER (WHERE len(ids) = 1) AS resolved, list_sort(list_distinct(flatten(list(ids) FILTER (WHERE len(ids) > 1)))) AS candidates FROM hit GROUP BY 1),
b AS (SELECT DISTINCT span_id, true AS bracketed FROM cited WHERE marker_form = 'numeric_bracketed'),
cell AS (SELECT document_id, CAST(regexp_extract(location_label, ':[A-Z]+([0-9]+)$', 1) AS BIGINT) AS n, coalesce(section, '') AS sec, span_id, text, location_index FROM (SELECT DISTINCT * EXCLUDE (ingested_at, extraction_warnings) FROM spans) WHERE location_kind = 'table_cell' AND regexp_extract(location_label, ':[A-Z]+([0-9]+)$', 1) <> ''),
pairs AS (SELECT max_by(span_id, (location_index, span_id)) FILTER (WHERE {_has("sec", "(?i)B=Requirement")}) AS span_id, max_by({_strip("text")}, (location_index, span_id)) FILTER (WHERE {_has("sec", "(?i)D=Evidence_Document")} AND NOT {_has("sec", "(?i)B=Requirement")}) AS file FROM cell GROUP BY document_id, n),
missing AS (SELECT path, max(source_id) AS missing_id FROM src WHERE availability_status = 'missing_file' GROUP BY 1),
joined AS (SELECT c.claim_id, c.claim_type, resolved, candidates, bracketed, missing_id, p.span_id IS NOT NULL AND p.file IS NULL AS lacking
  FROM claims c LEFT JOIN per USING (span_id) LEFT JOIN b USING (span_id) LEFT JOIN (SELECT * FROM pairs WHERE span_id IS NOT NULL) p USING (span_id) LEFT JOIN missing ON p.file = missing.path),
chosen AS (SELECT claim_id,
  CASE WHEN resolved IS NOT NULL THEN resolved WHEN len(candidates) > 0 OR bracketed OR claim_type <> 'completeness' THEN NULL ELSE missing_id END AS source_id,
  CASE WHEN resolved IS NOT NULL THEN 'resolved' WHEN len(candidates) > 0 THEN 'source_ambiguous' WHEN bracketed THEN 'source_unresolved' WHEN claim_type = 'completeness' AND (missing_id IS NOT NULL OR lacking) THEN 'source_missing' ELSE 'manual_review_required' END AS status,
  CASE WHEN resolved IS NOT NULL THEN 'explicit_citation' WHEN len(candidates) > 0 THEN 'explicit_citation_ambiguous' WHEN NOT coalesce(bracketed, false) AND claim_type = 'completeness' AND missing_id IS NOT NULL THEN 'filename_reference' ELSE 'no_link_found' END AS linking_method,
  CASE WHEN resolved IS NULL AND len(candidates) > 0 THEN candidates ELSE [] END AS candidates FROM joined)
SELECT {LINK} AS evidence_link_id, claim_id, source_id, status, linking_method, candidates FROM chosen
"""


def _quoted(x: str) -> str:
    body = f"replace(replace(replace(replace({x}, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
    return f"(CASE WHEN {x} IS NULL THEN 'None' WHEN contains({x}, chr(39)) AND NOT contains({x}, chr(34)) THEN chr(34) || {body} || chr(34) ELSE chr(39) || replace({body}, chr(39), chr(92) || chr(39)) || chr(39) END)"


def _said(name: str, *parts: str) -> str:
    out = "'" + EVIDENCE[name].replace("'", "''") + "'"
    for part in parts:
        head, sign, tail = out.partition("%d" if "%d" in out and out.find("%d") < (out.find("%s") if "%s" in out else 1 << 30) else "%s")
        out = f"{head}' || {part} || '{tail}"
    return out


def _finding(token: str, severity: str, checker: str, kind: str, affected: str, evidence: str, hint: str, rows: str) -> str:
    ids = f"list_sort({affected})"
    return f"""SELECT 'ECO-{token}-' || substr(sha256('{token}|' || array_to_string({ids}, '|')), 1, 8) AS eco_id, '{severity}' AS severity, 'checker.{checker}:v1' AS checker_id, {kind} AS finding_type,
      array_to_string({affected}, ';') AS affected_object_ids, {evidence} AS evidence, {hint} AS remediation_hint, 'pending' AS adjudication_state FROM {rows}"""


def _hint(kind: str) -> str:
    return "'" + HINT[kind].replace("'", "''") + "'"


ANCHOR = "[document_id, span_id, claim_id, evidence_link_id]"
NAMED = _quoted("CASE WHEN coalesce(path, '') <> '' THEN path ELSE '(no path)' END")
PARTS = [_quoted(c) for c in ("claim_id", "claim_type", "linking_method")]
FINDINGS = f"""
WITH claims_ AS MATERIALIZED ({CLAIMS}), cited_ AS MATERIALIZED (SELECT DISTINCT * FROM ({MENTION_ROWS})), src_ AS MATERIALIZED ({SOURCES}), links_ AS MATERIALIZED ({LINKS}),
first_ AS (SELECT claim_id, unnest(min({{'text': text, 'document_id': document_id, 'span_id': span_id, 'claim_type': claim_type}})) FROM claims_ GROUP BY 1),
full_ AS (SELECT * FROM links_ JOIN first_ USING (claim_id)),
known AS (SELECT DISTINCT citation_key FROM src_ WHERE citation_key <> ''),
related AS (SELECT source_id, list_sort(list(DISTINCT claim_id)) AS claims, list_sort(list(DISTINCT document_id)) AS docs FROM links_ LEFT JOIN (SELECT claim_id, document_id FROM first_) USING (claim_id) WHERE source_id IS NOT NULL GROUP BY 1),
gone AS (SELECT s.source_id, path, CASE WHEN origin_span_ids = '' THEN [] ELSE string_split(origin_span_ids, ',') END AS spans_, coalesce(claims, []) AS claims, coalesce(docs, []) AS docs FROM src_ s LEFT JOIN related USING (source_id) WHERE availability_status = 'missing_file'),
reviewed AS (SELECT claim_id, unnest(min({{'text': text, 'document_id': document_id, 'span_id': span_id, 'claim_type': claim_type}})) FROM claims_ WHERE claim_type IN ('classification', 'clinical_performance', 'safety', 'benefit_risk') GROUP BY 1)
{_finding("CITE", "Major", "broken_citation_anchor", "'unresolved_citation_marker'", "[document_id, span_id, mention_id]", f"CASE WHEN normalized_key IS NOT NULL THEN {_said('key', _quoted('marker_text'), _quoted('normalized_key'))} ELSE {_said('bracket', _quoted('marker_text'))} END", _hint("unresolved_citation_marker"),
  "cited_ WHERE marker_form <> 'numeric_parenthetical' AND ((normalized_key IS NOT NULL AND normalized_key NOT IN (SELECT citation_key FROM known)) OR (marker_form = 'numeric_bracketed' AND normalized_key IS NULL))")}
UNION ALL {_finding("SRC", "Major", "unresolved_evidence_link", "'claim_with_ambiguous_sources'", f"list_concat({ANCHOR}, list_sort(candidates))", _said("ambiguous", *PARTS), _hint("claim_with_ambiguous_sources"), "full_ WHERE status = 'source_ambiguous'")}
UNION ALL {_finding("SRC", "Major", "unresolved_evidence_link", "'claim_without_resolved_source'", f"list_concat({ANCHOR}, list_sort(candidates))", _said("unresolved", *PARTS), _hint("claim_without_resolved_source"), "full_ WHERE status = 'source_unresolved'")}
UNION ALL {_finding("COMPL", "Major", "source_availability_gap", "'evidence_document_referenced_but_missing'", "list_concat(list_concat(docs, list_sort(spans_)), list_concat([source_id], claims))", f"CASE WHEN len(claims) > 0 THEN {_said('referenced', NAMED, 'len(claims)')} ELSE {_said('unreferenced', NAMED)} END", _said("missing_hint", NAMED), "gone")}
UNION ALL {_finding("COMPL", "Major", "source_availability_gap", "'completeness_gap_applicable_but_no_evidence'", ANCHOR, _said("gap", _quoted("claim_id")), _hint("completeness_gap_applicable_but_no_evidence"), "(SELECT DISTINCT * FROM full_ WHERE status = 'source_missing' AND source_id IS NULL)")}
UNION ALL {_finding("MANUAL", "Informational", "manual_review_required", "CASE WHEN claim_type = 'classification' THEN 'classification_rationale_requires_manual_review' ELSE 'evidence_link_requires_manual_review' END", ANCHOR, f"CASE WHEN claim_type = 'classification' THEN {_said('class', _quoted('text'))} ELSE {_said('manual', _quoted('claim_id'), _quoted('claim_type'))} END",
  f"CASE WHEN claim_type = 'classification' THEN {_hint('classification_rationale_requires_manual_review')} ELSE {_hint('evidence_link_requires_manual_review')} END", "(SELECT l.*, r.* EXCLUDE (claim_id) FROM links_ l JOIN reviewed r USING (claim_id) WHERE status = 'manual_review_required')")}
"""

PAGES = f"""
WITH r AS (SELECT DISTINCT document_id, text FROM ({RUNNING})),
l AS (SELECT document_id, location_index AS page, i, {_strip("x[i]")} AS text FROM (SELECT document_id, location_index, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS x FROM {SPANS} WHERE location_kind = 'page'))),
k AS (SELECT document_id, page, i, {Q5} AS body FROM l WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM r WHERE r.document_id = l.document_id AND r.text = l.text))
SELECT document_id, page, regexp_replace(chr(10) || '<!-- page=' || page || ' -->' || chr(10) || coalesce(string_agg(body || chr(10), '' ORDER BY i, body), ''), '\n{{4,}}', repeat(chr(10), 3), 'g') AS markdown_text
FROM (SELECT DISTINCT document_id, page FROM l) LEFT JOIN (SELECT * FROM k WHERE NOT regexp_matches(body, '{re2(r"^" + chr(92) + "s*" + chr(92) + "d+" + chr(92) + "s*" + chr(92) + "(" + chr(92) + "s*" + chr(92) + "d+" + chr(92) + "s*" + chr(92) + ")" + chr(92) + "s*$")}') AND NOT regexp_matches(body, '{re2(chr(92) + ".{5,}" + chr(92) + "s*" + chr(92) + "d+" + chr(92) + "s*$")}')) USING (document_id, page) GROUP BY document_id, page
"""

SQL = {
    "layout_documents": PAGES,
    "claim_rows": CLAIMS,
    "percentage_claims": f"SELECT span_id, count(*) AS n FROM ({CLAIMS}) WHERE extraction_method = 'extract.numeric.percentage:v1' GROUP BY 1",
    "citation_mention_ids": f"SELECT DISTINCT * FROM ({MENTION_ROWS})",
    "evidence_links": f"SELECT * EXCLUDE (candidates), array_to_string(candidates, ',') AS candidate_source_ids FROM ({LINKS})",
    "pipeline_findings": FINDINGS,
    "findings_by_severity": f"SELECT CAST(pos AS INTEGER) AS severity_pos, severity, count(eco_id) AS n FROM (VALUES (0, 'Critical'), (1, 'Major'), (2, 'Minor'), (3, 'Informational')) s(pos, severity) LEFT JOIN ({FINDINGS}) USING (severity) GROUP BY ALL",
    "graph_counts": f"""
      SELECT CAST(1 AS INTEGER) AS family_pos, 'document' AS record_type, count(*) AS n FROM dossier_documents
      UNION ALL SELECT 2, 'span', count(*) FROM (SELECT DISTINCT span_id, document_id, location_kind, location_index, location_label, section, text FROM spans)
      UNION ALL SELECT 3, 'claim', count(*) FROM ({CLAIMS}) UNION ALL SELECT 4, 'citation', count(*) FROM (SELECT DISTINCT * FROM ({MENTION_ROWS}))
      UNION ALL SELECT 5, 'source', count(*) FROM ({SOURCES}) UNION ALL SELECT 6, 'evidence_link', count(*) FROM ({LINKS}) UNION ALL SELECT 7, 'finding', count(*) FROM ({FINDINGS})""",
}
