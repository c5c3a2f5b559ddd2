"""Graph records, closure of ids, run id and manifest figures."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Families in order, schema names and words that reports avoid.
FAMILIES = ("audit_run", "document", "span", "claim", "citation", "source", "evidence_link", "finding")
KEYS = {"audit_run": "run_id", "document": "document_id", "span": "span_id", "claim": "claim_id", "citation": "mention_id", "source": "source_id", "evidence_link": "evidence_link_id", "finding": "eco_id"}
SCHEMA = "graph.v1"
AVOIDED = ("non-compliant", "noncompliant", "regulatory failure", "false claim", "nb will reject", "notified body will reject", "mdr violation", "unsupported", "must ", "shall ")
# End of the fixed values.


def records(families: dict[str, DataFrame]) -> DataFrame:
    """family_pos, record_type, record_id, record (JSON) of every row of ``families``.

    Nulls stay in the JSON. Sort by (family_pos, record_id) at the sink.
    """
    out = None
    for pos, name in enumerate(FAMILIES):
        if name not in families:
            continue
        df, key = families[name], KEYS[name]
        head = [F.lit(name).alias("record_type"), F.col(key).alias("record_id"), F.lit(SCHEMA).alias("schema_version")]
        body = F.to_json(F.struct(*head, *df.columns), {"ignoreNullFields": "false"})
        rows = df.select(F.lit(pos).alias("family_pos"), F.lit(name).alias("record_type"), F.col(key).alias("record_id"), body.alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out


def audit_run(spark: SparkSession, run: str, dossier: str, counts: dict[str, int]) -> DataFrame:
    """The one record of a run itself."""
    return spark.createDataFrame([(run, dossier, dict(sorted(counts.items())))], "run_id string, dossier_path string, artifact_counts map<string,int>")


def unresolved_ids(findings: DataFrame, record_ids: DataFrame) -> DataFrame:
    """Ids that findings name and no record has, once each."""
    named = findings.select(F.explode("affected_object_ids").alias("record_id")).where("record_id is not null").distinct()
    return named.join(record_ids.select("record_id").distinct(), "record_id", "left_anti")


def avoided_words(findings: DataFrame) -> DataFrame:
    """(eco_id, word) of avoided words in the findings' texts; reports need none."""
    text = F.lower(F.concat_ws("\n", "evidence", "remediation_hint"))
    held = F.filter(F.array(*map(F.lit, AVOIDED)), lambda w: F.contains(text, w))
    return findings.select("eco_id", F.explode(held).alias("word"))


def check_language(findings: DataFrame) -> None:
    """Raises if a finding's texts hold an avoided word, naming some of them."""
    if found := avoided_words(findings).orderBy("eco_id", "word").limit(5).collect():
        raise ValueError("avoided words: " + ", ".join(f"{r.word!r} in {r.eco_id}" for r in found))


def sorted_warnings(warnings: str = "parse_warnings"):
    """Warning structs in the order code, path, location, message."""
    return F.array_sort(warnings, lambda a, b: F.when(_key(a) < _key(b), -1).when(_key(a) > _key(b), 1).otherwise(0))


def _key(w):
    return F.struct(w["code"], w["path"], F.coalesce(w["location"], F.lit("")), w["message"])


def run_id(documents: DataFrame, counts: dict[str, int]) -> str:
    """``run_`` and 16 hex digits over the documents' ids and hashes, and the counts.

    Streams the two columns in order; one document at a time reaches the driver.
    """
    digest = hashlib.sha256()
    for row in documents.select("document_id", "sha256").orderBy("document_id").toLocalIterator():
        digest.update(f"|{row[0]}:{row[1] or ''}".encode())
    digest.update(b"|counts=" + json.dumps(counts, sort_keys=True).encode())
    return f"run_{digest.hexdigest()[:16]}"
