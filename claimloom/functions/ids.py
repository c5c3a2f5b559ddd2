"""Identifiers derived from content: equal inputs give equal ids on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(value: Column) -> Column:
    """The bytes of a part behind their count as eight bytes."""
    value = value.cast("string")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(value).cast("bigint")), 16, "0")), value.cast("binary"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and 16 hex digits of the SHA-256 over the length-prefixed ``parts``; null parts count as ""."""
    body = F.concat(*[_part(F.coalesce(p.cast("string"), F.lit(""))) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(body, 256), 1, 16))


def stable_id_of(prefix: str, parts: Column) -> Column:
    """``stable_id`` over an array of parts."""
    body = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, _part(F.coalesce(p, F.lit("")))))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(body, 256), 1, 16))


def document_id(kind: Column, path: Column, sha256: Column) -> Column:
    return stable_id("doc", kind, path, sha256)


def span_id(document: Column, kind: Column, index: Column, label: Column, text: Column) -> Column:
    return stable_id("span", document, kind, index, label, F.sha2(text.cast("binary"), 256))


def claim_id(document: Column, span: Column, normalised: Column, method: Column, occurrence: Column) -> Column:
    return stable_id("claim", document, span, normalised, method, occurrence)


def citation_id(document: Column, span: Column, marker: Column, parser: Column, occurrence: Column) -> Column:
    return stable_id("cite", document, span, marker, parser, occurrence)


def source_id(path: Column, key: Column) -> Column:
    return stable_id("src", path, key)


def link_id(claim: Column, source: Column, status: Column, candidates: Column) -> Column:
    fixed = F.array(claim, F.coalesce(source, F.lit("")), status)
    return stable_id_of("elink", F.concat(fixed, F.array_sort(candidates)))


def eco_id(token: str, affected: Column) -> Column:
    """``ECO-token-`` and 8 hex digits of the SHA-256 over the sorted ``affected`` ids."""
    body = F.concat_ws("|", F.lit(token), F.array_sort(affected))
    return F.concat(F.lit(f"ECO-{token}-"), F.substring(F.sha2(body.cast("binary"), 256), 1, 8))
