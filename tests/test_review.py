from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from claimloom.operators import guidance, review
from claimloom.sources import sinks

TEXT = guidance.with_front_matter({"source_id": "s1", "document_family": "SSCP", "derived_from_source_id": "s0", "derived_md_review_status": "draft"}, [{"source_id": "s2", "relation": "cites", "cited_at": "p. 3"}], "<!-- page=4 -->\nThe “intended\n1purpose” of the device  is stated.\n")


@pytest.fixture()
def pack(tmp_path):
    keyed = "guidance.sscp.required_section.intended_purpose"
    rules = [{"rule_id": keyed, "source_id": "s1", "exact_excerpt": 'The "intended purpose" of the device is stated.', "paraphrase": " Say it. ", "modal_strength": "should"}, {"rule_id": "other", "source_id": "s9", "notes": "Look twice."}, {"rule_id": ""}, {"rule_id": "guidance.sscp.metadata.notified_body_identifier", "source_id": "s3"}, None]
    (tmp_path / "md").mkdir()
    (tmp_path / "rules.json").write_text(json.dumps({"pack_id": "p", "document_family": "SSCP", "rules": rules}))
    (tmp_path / "sources.json").write_text(json.dumps({"sources": [{"source_id": "s1", "title": "One", "derived_md_path_optional": "md/one.md", "derived_md_sha256_optional": "old"}, {"source_id": "s2", "derived_md_path_optional": "md/two.md"}, {"source_id": "s3", "title": "Three"}]}))
    (tmp_path / "md" / "one.md").write_text(TEXT)
    (tmp_path / "md" / "two.md").write_text("---\nbroken\n---\nBody")
    return str(tmp_path)


def test_a_pack_becomes_a_review_list(spark, pack, tmp_path):
    spans = spark.createDataFrame([("d1", "page", 1, "s1", "The Intended Use is here."), ("d2", "page", 1, "s2", "Intended purpose"), ("d1", "page", 2, "s3", None)], "document_id string, location_kind string, location_index int, span_id string, text string")
    documents = spark.createDataFrame([("d1", "SSCP"), ("d2", "CER")], "document_id string, kind string")
    rules, texts = review.rules_of(spark, pack), review.source_texts(review.sources_of(spark, pack), review.texts_of(spark, pack))
    assert [r.rule_id for r in rules.orderBy("pos").collect()][1] == "other" and rules.count() == 3
    found = {r.rule_id: r for r in review.evaluations(rules, spans, documents, texts.where("text is not null")).collect()}
    first, other, third = (found[r.rule_id] for r in rules.orderBy("pos").collect())
    assert first.evaluation_status == "observed_evidence" and [m.span_id for m in first.evidence_matches] == ["s1"] and first.evidence_matches[0].matched_pattern == "intended use"
    assert first.source_anchor.md_path == "md/one.md" and first.source_anchor.page_anchor == 4 and first.source_anchor.matched_via == "whitespace_normalised" and TEXT[first.source_anchor.char_offset :].startswith("The “intended")
    assert (other.evaluation_status, other.evaluation_method, other.evidence_matches, other.source_anchor) == ("not_evaluated", "human_review_only", None, None)
    assert third.evaluation_status == "missing_candidate" and third.evidence_matches == []
    assert {r.source_anchor for r in review.evaluations(rules, spans, documents).collect()} == {None}
    items = review.review_items(rules, review.evaluations(rules, spans, documents, texts.where("text is not null")), "run_1")
    run = review.run_reference({"run_id": "run_1", "artifact_counts": {"claims": 2}, "n_sources": 5})
    assert run["n_claims"] == 2 and run["n_sources"] == 5 and run["n_findings"] is None and review.run_reference(None) is None
    hashes = sinks.write_review(items, {"pack_id": "p", "document_family": "SSCP"}, run, str(tmp_path))
    assert all(hashlib.sha256((tmp_path / f).read_bytes()).hexdigest() == h for f, h in hashes.items())
    listed = json.loads((tmp_path / "guidance_review.json").read_text())
    assert listed["n_review_items"] == 3 and listed["review_items"][0]["review_prompt"] == "Confirm whether the target document satisfies this rule (should): Say it." and listed["review_items"][1]["review_prompt"].endswith("Reviewer notes: Look twice.")
    assert listed["review_items"][0]["evidence_to_review"]["verify_run_id"] == "run_1"
    page = (tmp_path / "guidance_review.md").read_text()
    assert "### 1. `guidance.sscp.required_section.intended_purpose`" in page and f"(line {TEXT[: TEXT.index('The “')].count(chr(10)) + 1}, page 4, matched via `whitespace_normalised`)" in page and "pattern `intended use`: The Intended Use is here." in page


def test_sources_of_a_pack(spark, pack):
    one = review.source(spark, pack, "s1")
    assert one["well_formed"] and one["fields"]["document_family"] == "SSCP" and one["cross_refs"][0]["cited_at"] == "p. 3" and one["body"].startswith("<!-- page=4")
    two = review.source(spark, pack, "s2")
    assert not two["well_formed"] and two["body"] == two["text"] and review.source(spark, pack, "s3")["text"] is None
    with pytest.raises(KeyError):
        review.source(spark, pack, "s4")
    fresh = {r.source_id: (r.derived_md_sha256_optional, r.changed) for r in review.repinned(review.sources_of(spark, pack), review.texts_of(spark, pack)).collect()}
    assert fresh["s1"] == (hashlib.sha256(TEXT.encode()).hexdigest(), True) and fresh["s3"] == (None, False)


def test_front_matter_fields(spark):
    texts = [("good", TEXT), ("bad", "---\nbroken\n---\n"), ("few", "---\nsource_id: x\nderived_md_review_status: odd\ncross_refs:\n  - source_id: y\n---\n"), ("none", None)]
    fronts = guidance.front_matters(spark.createDataFrame(texts, "k string, t string"), "k", "t")
    issues = sorted((r.key, r.field, r.issue) for r in review.front_matter_issues(fronts, ["draft"]).collect())
    assert issues == [("bad", "", "malformed"), ("few", "cross_refs.cited_at", "required"), ("few", "cross_refs.relation", "required"), ("few", "derived_from_source_id", "required"), ("few", "derived_md_review_status", "outside"), ("few", "document_family", "required"), ("none", "", "malformed")]


def test_pages_by_specification(spark):
    pages = spark.createDataFrame([(n, f"page {n}") for n in range(1, 8)], "page int, text string")
    named = lambda spec: [r.page for r in review.page_texts(pages, F.lit(spec)).orderBy("page").collect()]
    assert named("1,3-5") == [1, 3, 4, 5] and named("9, 6-20,6") == [6, 7] and named("") == named(None) == list(range(1, 8)) and named("x") == []
