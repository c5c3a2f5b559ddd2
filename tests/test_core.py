from __future__ import annotations

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from claimloom.functions import ids, text
from claimloom.operators import checkers, citations, claims, graph, guidance, layout, sources
from claimloom.operators import spans as S

SPAN = "span_id string, document_id string, location_kind string, location_index int, location_label string, section string, text string"
DOC = "doc_0123456789abcdef"
AWKWARD = ["", " ", "a b", "x\u0085y", "l1\r\nl2\rl3\nl4 l5", "١٢", "ſsK", "tab\tend ", " em", "\x1cfs\x1d", "d​e", "İstanbul"]


def spans_of(spark, *texts, kind="paragraph", section=None, label=None, document=DOC):
    rows = [(f"span_{k}", document, kind, k, label, section, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SPAN)


def stable(prefix, *parts):
    digest = hashlib.sha256()
    for p in parts:
        digest.update(len(p.encode()).to_bytes(8, "big") + p.encode())
    return f"{prefix}_{digest.hexdigest()[:16]}"


def test_known_span_ids(spark):
    rows = [(DOC, "page", 3, None, "naïve ½ text"), (DOC, "table_cell", None, "t0:r1:c2", "")]
    df = spark.createDataFrame(rows, "d string, k string, i int, l string, t string")
    made = [r[0] for r in df.select(ids.span_id(*(F.col(c) for c in "dkilt"))).collect()]
    assert made == [stable("span", d, k, "" if i is None else str(i), l or "", hashlib.sha256(t.encode()).hexdigest()) for d, k, i, l, t in rows]
    eco = df.limit(1).select(ids.eco_id("CITE", F.array(F.lit("b"), F.lit("a")))).first()[0]
    assert eco == "ECO-CITE-" + hashlib.sha256(b"CITE|a|b").hexdigest()[:8]
    link = df.limit(1).select(ids.link_id(F.lit("c"), F.lit(None).cast("string"), F.lit("s"), F.array(F.lit("z"), F.lit("y")))).first()[0]
    assert link == stable("elink", "c", "", "s", "y", "z")


def test_text_on_awkward_strings(spark):
    df = spark.createDataFrame([(t,) for t in AWKWARD], "t string")
    for r in df.select("t", text.strip(F.col("t")).alias("s"), text.collapse(F.col("t")).alias("c"), text.lines(F.col("t")).alias("l"), text.quoted(F.col("t")).alias("q")).collect():
        assert r.s == r.t.strip() and r.c == " ".join(r.t.split())
        assert r.l == [x.strip() for x in r.t.splitlines() if x.strip()]
    quotes = spark.createDataFrame([("it's",), ('say "x"',), ("both ' and \"",), ("back\\slash\n",)], "t string")
    assert all(r.q == repr(r.t) for r in quotes.select("t", text.quoted(F.col("t")).alias("q")).collect())


@pytest.mark.parametrize("pattern, py", [(citations.BRACKETED, r"\[(\d{1,3})\]"), (citations.PARENTHESISED, r"(?<![A-Za-z%])\((\d{1,2})\)(?![A-Za-z%\d])"), (claims.PERCENT, r"(?<!\d)\d{1,3}\.\d+\s*%"), (claims.COUNT, r"n\s*=\s*\d+")])
def test_find_all_gives_the_offsets(spark, pattern, py):
    texts = ["[1][22] (3)(4) x(5) 6%(7) [8, 9] 12.5 % 3.25%7.1% n = 5, n=66 \U0001f600 [9] ٣.٤% n = 3", "", None, "(1)"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", text.find_all(F.col("t"), pattern).alias("f")).collect():
        assert [(m.start, m.end, m.text) for m in r.f or []] == [(m.start(), m.end(), m[0]) for m in re.finditer(py, r.t or "")]


REASONS = [
        ("paragraph", "References", "any", ["bibliography"]), ("paragraph", None, "REF-12. Smith", ["bibliography"]), ("paragraph", None, "Bibliography:\nx", ["bibliography"]),
        ("page", None, "1. Smith J. Title. 2020\n2. Jones et al. Work, 2021", ["bibliography"]), ("page", None, "1. Jones A. validated the 2023 protocol\n2. Smith B. used it", []),
        ("page", None, "Intro ..... 4\nBody ..... 5\nEnd ...... 9", ["table_of_contents"]), ("paragraph", None, "Table of Contents\nIntro .... 3", ["table_of_contents"]),
        ("paragraph", "Scope", " Scope ", ["heading"]), ("page", None, "3.2 Clinical background", ["heading"]), ("page", None, "3.2 Clinical background.", []), ("page", "x", "3.2 Clinical background", []),
        ("page", None, "Document 12 Rev. A\nPage 3 of 9", ["pdf_chrome"]), ("paragraph", None, "Appendix B\n[insert text]\n[to be completed]", ["appendix_template"]),
        ("paragraph", None, "This guidance recommends that makers should act.", ["guidance_meta"]), ("paragraph", None, "", []), ("page", None, None, []),

]


def test_span_reasons(spark):
    documents = spark.createDataFrame([(DOC, "OTHER")], "document_id string, kind string")
    rows = [(str(k), DOC, kind, k, None, section, body) for k, (kind, section, body, _) in enumerate(REASONS)]
    for row in S.classified(spark.createDataFrame(rows, SPAN), documents).collect():
        reasons = REASONS[row.location_index][3]
        assert row.reasons == reasons and row.suppress_claims == bool(reasons), row
        assert row.citation_noise == bool(set(reasons) - {"guidance_meta"}) and row.retain_as_anchor == bool({"bibliography", "guidance_meta"} & set(reasons))


def test_mentions(spark):
    body = "(Kerry, 2022) and (Smith et al. 2019), [1], [2, 3], [1] (4) NCT01234567 (NCT01234567) ESC 2021 Guidelines ACC/AHA 2020 guideline REF-012 5%(6) (Kerry, 2022)"
    found = citations.mentions(spans_of(spark, body)).collect()
    rows = sorted((r.span_offset_start, r.marker_form, r.marker_text, r.normalized_key, r.occurrence_index) for r in found)
    assert [r[1:] for r in rows] == [
        ("author_year_parenthetical", "(Kerry, 2022)", "kerry_2022", 1), ("author_year_parenthetical", "(Smith et al. 2019)", "smith_2019", 1), ("numeric_bracketed", "[1]", None, 1),
        ("numeric_bracketed", "[2]", None, 1), ("numeric_bracketed", "[3]", None, 1), ("numeric_bracketed", "[1]", None, 2), ("numeric_parenthetical", "(4)", "footnote_01234567_4", 1),
        ("nct_id", "NCT01234567", "nct_01234567", 1), ("nct_id", "(NCT01234567)", "nct_01234567", 2), ("named_guideline", "ESC 2021 Guidelines", "esc_2021", 1), ("named_guideline", "ACC/AHA 2020 guideline", "acc_aha_2020", 1),
        ("ref_id_numeric", "REF-012", "ref_012", 1), ("author_year_parenthetical", "(Kerry, 2022)", "kerry_2022", 2),
    ]
    for r in found:
        if r.marker_form != "numeric_bracketed":
            assert body[r.span_offset_start : r.span_offset_end] == r.marker_text
            assert r.mention_id == stable("cite", DOC, "span_0", "nct01234567" if r.marker_form == "nct_id" else r.marker_text.lower(), "citation_parser:v1", str(r.occurrence_index))
    cell = citations.mentions(spans_of(spark, "  Kerry et al. 2022 n=12 \n", "Kerry 2022 [1]", kind="table_cell")).collect()
    assert [(r.marker_form, r.normalized_key, r.span_offset_start) for r in cell] == [("author_year_table_cell", "kerry_2022", 2), ("numeric_bracketed", None, 11)]
    assert citations.mentions(spans_of(spark, "(5)", document="plain")).count() == 0 and citations.mentions(spans_of(spark, None)).count() == 0


def claims_of(spark, *texts, kind="paragraph", documents=None, section=None):
    documents = documents or spark.createDataFrame([(DOC, "CER")], "document_id string, kind string")
    return [(r.claim_type, r.extraction_method.split(".", 1)[1], r.text) for r in claims.claims(spans_of(spark, *texts, kind=kind, section=section), documents).collect()]


def test_numeric_claims(spark):
    found = claims_of(spark, "87.4%(95% CI: 82.1-91.6) then 3.2%, 12%, n = 5, 90% CI: 1.0-2.0 and 41.5 percent at 12 months (x)")
    assert found == [
        ("numeric", "numeric.percentage:v1", "87.4% (95% CI: 82.1-91.6)"), ("numeric", "numeric.percentage:v1", "3.2%"), ("numeric", "numeric.percentage:v1", "41.5 percent at 12 months"),
        ("numeric", "numeric.ci:v1", "90% CI: 1.0-2.0"), ("numeric", "numeric.count:v1", "n = 5"),
    ]
    assert claims_of(spark, "Foreshortening Chart 3.2% 4.5%, n=3") == [("numeric", "numeric.count:v1", "n=3")]


def test_value_unit_claims_block_overlaps(spark):
    found = [t for _, m, t in claims_of(spark, "From -40 to +400 mmHg, 24 ± 26 mmHg, 3.0 mmHg drift in 100 h, up to 29 days, ≥ 12 years, 2500 gauss/cm, 1.5 T in an MRI field") if "value_unit" in m]
    assert found == ["-40 to +400 mmHg", "24 ± 26 mmHg", "3.0 mmHg drift in 100 h", "up to 29 days", "≥ 12 years", "2500 gauss/cm", "1.5 T"]
    assert not [t for _, m, t in claims_of(spark, "size 1.5 T of steel") if "value_unit" in m]
    found = [t for _, m, t in claims_of(spark, "Burst (atm) a RBP = 7.0 b RBP = 6.0") if "value_unit" in m]
    assert found == ["(atm) a RBP = 7.0", "RBP = 6.0"]


def test_entity_and_window_claims(spark):
    body = "A Class IIb active medical device, MR Conditional, NB 0123, Notified Body number 0456, Basic UDI-DI 1234567890AB1, EMDN C01040203, EN ISO 14971:2019 and IEC 62304"
    assert claims_of(spark, body) == [
        ("classification", "classification:v1", "Class IIb active medical device"), ("classification", "classification.mr_conditional:v1", "MR Conditional"), ("classification", "classification.nb_number:v1", "NB 0123"),
        ("classification", "classification.nb_number:v1", "Notified Body number 0456"), ("classification", "classification.basic_udi_di:v1", "1234567890AB1"), ("classification", "classification.emdn_code:v1", "C01040203"),
        ("standard_reference", "classification.harmonized_standard:v1", "EN ISO 14971:2019"), ("standard_reference", "classification.harmonized_standard:v1", "IEC 62304"),
    ]
    assert claims_of(spark, "The sensitivity and specificity were high.") == [("clinical_performance", "clinical_performance:v1", "The sensitivity and specificity were high.")]
    assert claims_of(spark, "sensitivity", kind="table_cell") == [] and claims_of(spark, None, "") == []


def mapping(spark):
    """A requirement sheet: row 2 has evidence, row 3 lacks it, row 4 does not apply, row 5 is closed as not applicable."""
    head = {"A": "Id", "B": "Requirement", "C": "Applicable", "D": "Evidence_Document", "E": "Status"}
    cells = {2: ("1", "Need two", "Yes", "PMS.docx", "Met"), 3: ("2", "Need three", "yes", None, None), 4: ("3", "Need four", "No", None, None), 5: ("4", "Need five", "Y", None, "N/A")}
    rows, n = [], 0
    for r, values in cells.items():
        for c, v in zip(head, values):
            if v:
                rows.append((f"span_g{n}", "doc_aaaaaaaa", "table_cell", n, f"GSPR:{c}{r}", f"GSPR:header:{c}={head[c]}", v))
                n += 1
    rows += [("span_p0", "doc_bbbbbbbb", "page", 1, None, None, "Kerry J. 2022. Long title"), ("span_c0", "doc_cccccccc", "paragraph", 0, None, None, "Leaks fell by 3.2% (Kerry, 2022)."), ("span_c1", "doc_cccccccc", "paragraph", 1, None, None, "The efficacy was high [1]."), ("span_c2", "doc_cccccccc", "paragraph", 2, None, None, "A Class III medical device.")]
    documents = [("doc_aaaaaaaa", "GSPR_MAPPING", "GSPR.xlsx"), ("doc_bbbbbbbb", "SOURCE_PDF", "bibliography/a.pdf"), ("doc_cccccccc", "CER", "CER.docx")]
    return spark.createDataFrame(rows, SPAN), spark.createDataFrame(documents, "document_id string, kind string, path string")


def test_end_to_end(spark):
    spans, documents = mapping(spark)
    made, cited, found = (x.cache() for x in (claims.claims(spans, documents), citations.mentions(spans), sources.sources(documents, spans)))
    assert [r.text for r in made.where("claim_type = 'completeness'").collect()] == ["Need three"]
    assert sorted((r.path, r.citation_key, r.availability_status, r.origin_span_ids) for r in found.collect()) == [("PMS.docx", None, "missing_file", ["span_g3"]), ("bibliography/a.pdf", "kerry_2022", "local_fulltext", [])]
    linked = sources.links(made, cited, found, spans).cache()
    assert linked.count() == made.count()
    by = {(r.text, r.claim_type): r.status for r in linked.join(made, "claim_id").collect()}
    assert by["3.2%", "numeric"] == by["(Kerry, 2022)", "citation"] == "resolved" and by["Need three", "completeness"] == "source_missing" and by["Class III medical device", "classification"] == "manual_review_required"
    assert by["The efficacy was high [1].", "clinical_performance"] == "source_unresolved"
    findings = checkers.findings(made, cited, found, linked).cache()
    rows = sorted((r.finding_type, r.severity) for r in findings.collect())
    assert rows == [
        ("claim_without_resolved_source", "Major"), ("classification_rationale_requires_manual_review", "Informational"), ("completeness_gap_applicable_but_no_evidence", "Major"),
        ("evidence_document_referenced_but_missing", "Major"), ("unresolved_citation_marker", "Major"),
    ]
    assert [(r.severity, r.n) for r in checkers.by_severity(findings).orderBy("severity_pos").collect()] == [("Critical", 0), ("Major", 4), ("Minor", 0), ("Informational", 1)]
    families = {"document": documents, "span": spans, "claim": made, "citation": cited, "source": found, "evidence_link": linked, "finding": findings}
    records = graph.records(families)
    assert graph.unresolved_ids(findings, records).count() == 0 and graph.avoided_words(findings).count() == 0
    first = json.loads(records.where("record_type = 'source' and record like '%PMS.docx%'").first().record)
    assert first["citation_key"] is None and first["schema_version"] == "graph.v1"
    for n in (1, 7):
        again = claims.claims(spans.repartition(n).orderBy(F.rand(n)), documents)
        assert sorted(r.claim_id for r in again.collect()) == sorted(r.claim_id for r in made.collect())
    assert graph.run_id(documents.withColumn("sha256", F.lit("x")), {"b": 1, "a": 2}) == graph.run_id(documents.withColumn("sha256", F.lit("x")).repartition(3), {"a": 2, "b": 1})


def test_ambiguous_sources(spark):
    spans, documents = mapping(spark)
    more = documents.unionByName(spark.createDataFrame([("doc_dddddddd", "SOURCE_PDF", "sources/b.pdf")], documents.schema))
    spans = spans.unionByName(spark.createDataFrame([("span_d0", "doc_dddddddd", "page", 1, None, None, "Kerry 2022")], SPAN))
    found = sources.sources(more, spans)
    linked = sources.links(claims.claims(spans, more), citations.mentions(spans), found, spans).where("status = 'source_ambiguous'").collect()
    assert linked and all(r.source_id is None and len(r.candidate_source_ids) == 2 and r.candidate_source_ids == sorted(r.candidate_source_ids) for r in linked)


def test_empty_tables(spark):
    spans, documents = mapping(spark)
    none = spans.limit(0)
    assert claims.claims(none, documents).count() == citations.mentions(none).count() == 0
    assert sources.sources(documents.limit(0), none).count() == 0


@pytest.mark.parametrize("path, kind", [("GSPR-map.xlsx", "GSPR_MAPPING"), ("a/evidence table.docx", "EVIDENCE_TABLE"), ("PMCF_plan.docx", "PMCF"), ("x/psur_1.pdf", "PSUR"), ("pms.pdf", "PMS"), ("my-sscp.docx", "SSCP"), ("CER v2.docx", "CER"), ("clinical_evaluation2.docx", "CER"), ("bibliography/a.pdf", "SOURCE_PDF"), ("bibliography/a.docx", "OTHER"), ("readme", "OTHER"), (".pms", "OTHER")])
def test_document_kinds(spark, path, kind):
    expected = {".pms": "OTHER"}.get(path, kind)
    assert spark.createDataFrame([(path,)], "p string").select(S.inferred_kind(F.col("p"))).first()[0] == expected


def test_titles_refine_the_kind(spark):
    documents = spark.createDataFrame([("a", "OTHER"), ("b", "OTHER"), ("c", "CER")], "document_id string, kind string")
    rows = [("a", "Summary of  Safety and Clinical Performance: X"), ("b", "the summary of safety and clinical performance"), ("c", "Summary of Safety and Clinical Performance"), ("a", "Summary of Safety and Clinical Performance")]
    found = S.refined_kinds(documents, spark.createDataFrame(rows, "document_id string, text string"))
    assert {r.document_id: r.kind for r in found.collect()} == {"a": "SSCP", "b": "OTHER", "c": "CER"}


def test_headers_are_stripped(spark):
    rows = [("Titel: X\nA 1\nSeite 7 von 41 \nBody",), ("Maker\nSSCP – Stents\nFCD-1\nPage 12 of 45\nBody",), ("Plain body",)]
    df = spark.createDataFrame(rows, "t string").select(S.without_header(F.col("t")))
    assert [r[0] for r in df.collect()] == ["Body", "Body", "Plain body"]


def test_locate_excerpts(spark):
    body = "<!-- page=1 -->\nHead\n\n<!-- page=2 -->\nThe “single\n52identification number” is\nkept here.\n"
    rows = [("v", "kept here", body), ("t", 'The "single identification number" is kept', body), ("h", "is kept here. something else entirely", body), ("n", "absent words in text", body), ("e", "", body), ("z", None, body)]
    found = {r.excerpt_id: r for r in guidance.anchors(spark.createDataFrame(rows, "excerpt_id string, excerpt string, text string")).collect()}
    assert found.keys() == {"v", "t"} and found["v"].matched_via == "verbatim" and found["v"].char_offset == body.index("kept here") and found["v"].line_number == 7
    assert found["t"].char_offset == body.index("The “") and found["t"].page_anchor == 2 and found["t"].preview.startswith("The “single")


def test_rule_matches(spark):
    documents = spark.createDataFrame([("a", "SSCP"), ("b", "CER")], "document_id string, kind string")
    rows = [(f"s{k}", "a", "page", k, None, None, "The INTENDED  use and intended use") for k in range(8)] + [("x", "b", "page", 1, None, None, "intended use"), ("n", "a", "page", 9, None, None, None)]
    found = guidance.rule_matches(spark.createDataFrame(rows, SPAN), documents)
    assert [(r.span_id, r.matched_pattern) for r in found.orderBy("match_no").collect()] == [(f"s{k}", "intended use") for k in range(5)]
    status = {r.rule_id.split(".")[-1]: (r.evaluation_status, r.n_matches) for r in guidance.rule_status(found).collect()}
    assert status["intended_purpose"] == ("observed_evidence", 5) and status["device_description"] == ("missing_candidate", 0)


def test_layout(spark):
    chars = [(1, 10.0, float(x), 12.0, c) for x, c in enumerate("Head")] + [(1, 11.9 + 0.2 * x, float(x), 9.0, c) for x, c in enumerate("ab")] + [(1, 20.0, 0.0, 9.0, "z"), (2, 1.0, 0.0, 9.0, "q")]
    two = spark.createDataFrame([("a", 1, 0.0, 0.0, 9.0, "x"), ("b", 1, 0.0, 0.0, 9.0, "y")], "doc string, page int, top double, x0 double, size double, text string")
    assert sorted((r.doc, r.text) for r in layout.lines_of(two, "doc").collect()) == [("a", "x"), ("b", "y")]
    lines = layout.lines_of(spark.createDataFrame(chars, "page int, top double, x0 double, size double, text string"))
    assert [(r.page, r.line_no, r.text) for r in lines.orderBy("page", "line_no").collect()] == [(1, 0, "Heada"), (1, 1, "b"), (1, 2, "z"), (2, 0, "q")]
    sizes = layout.heading_levels(spark.createDataFrame([(s,) for s in (20.04, 20.0, 14.0, 12.0, 11.6, 11.0)], "size double"))
    assert [(r.size, r.level) for r in sizes.orderBy("level").collect()] == [(20.0, 1), (14.0, 2), (12.0, 3)]
    table = spark.createDataFrame([([["a", None], ["1", " 2 ", "3"], ["x"]],)], "c array<array<string>>").select(layout.pipe_table(F.col("c"))).first()[0]
    assert table == "| a |  |\n| --- | --- |\n| 1 | 2 |\n| x |  |"
    box = layout.outside_boxes(spark.createDataFrame([(1, 0.0, 2.0, 0.0, 2.0), (1, 8.0, 9.0, 0.0, 2.0)], "page int, x0 double, x1 double, top double, bottom double"), spark.createDataFrame([(1, 0.0, 5.0, 0.0, 5.0)], "page int, x0 double, x1 double, top double, bottom double"))
    assert [r.x0 for r in box.collect()] == [8.0]


def test_running_lines_and_assembly(spark):
    rows = [(p, k, 14.0 if k == 1 else 9.0, t) for p in range(1, 5) for k, t in enumerate(["Maker file", f"Part {p}", f"Text of page {p} , “x”", "More", f"{p}(24)"])]
    rows += [(1, 9, 9.0, "Intro ........ 4")]
    lines = spark.createDataFrame(rows, "page int, line_no int, size double, text string").withColumn("doc", F.lit("d"))
    running = layout.running_lines(lines, "doc")
    assert {(r.place, r.text) for r in running.collect()} >= {("header", "Maker file"), ("footer", "More")}
    text_ = layout.assembled(lines, layout.heading_levels(lines.select("doc", "size"), "doc"), running, "doc").first().markdown_text
    assert text_.startswith('\n<!-- page=1 -->\n\n# Part 1\n\nText of page 1, "x"\n') and "Maker file" not in text_ and "(24)" not in text_ and "...." not in text_
    assert layout.running_lines(lines.where("page < 3"), "doc").count() == 0


def test_queries_match_their_sql(against_sql):
    from claimloom.plans import queries

    for name, sql in queries.oracle_sql().items():
        against_sql(queries.queries()[name], sql)


def test_every_query_runs(spark, sf_dir):
    from claimloom.plans import queries

    for name, query in queries.queries().items():
        assert query(spark, sf_dir).count() >= 0, name
