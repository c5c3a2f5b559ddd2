from __future__ import annotations

import pytest

from claimloom.operators import units as U

FACTS = "gold_id string, span_id string, label string, value double, unit string, confidence_interval struct<lower:double,upper:double,level:double>"
LABELS = [
    ("pressure_a", "pressure", "kPa", 1), ("length_a", "length", "mm", 2), ("mass_a", "mass", "mg", 2), ("force_a", "force", "N", 1), ("temp_a", "temperature", "degC", 0), ("time_a", "duration", "min", 1),
    ("follow_a", "followup", "month", 0), ("rate_a", "proportion", "percent", 2), ("field_a", "fluxdensity", "T", 2), ("gradient_a", "fieldgradient", "T/m", 1), ("sar_a", "absorption", "W/kg", 2), ("volume_a", "volume", "mL", 1),
]


@pytest.mark.parametrize(
    "text, quantity, numbers, unit",
    [
        ("kPa.", "pressure", [], "kPa"), ("KPA", "pressure", [], "kPa"), ("mm Hg", "pressure", [], "mmHg"), ("×10⁵ Pa", "pressure", [], "10^5 Pa"), ("cmH₂O", "pressure", [], "cmH2O"), ("lb/in²", "pressure", [], "psi"),
        ("MM", "length", [], "mm"), ("μm", "length", [], "µm"), ("″", "length", [], "in"), ("F (French)", "length", [], "Fr"), ("10^-6 m", "length", [], "µm"), ("MG", "mass", [], "mg"), ("kG", "fluxdensity", [], "kG"), ("G", "fluxdensity", [], "G"),
        ("g", "mass", [], "g"), ("℉", "temperature", [], "degF"), ("ºC", "temperature", [], "degC"), ("％", "proportion", [], "percent"), ("(0-1)", "proportion", [], "fraction"), ("per 10 000", "proportion", [], "per 10000"),
        ("Gauss / cm", "fieldgradient", [], "G/cm"), ("W kg-1", "absorption", [], "W/kg"), ("d", "duration", [], "d"), ("d", "followup", [], "day"), ("mN", "force", [], "mN"),
        ("approx. 12.3 min.", "duration", [12.3], "min"), ("= 85,6 millimetres of mercury", "pressure", [85.6], "mmHg"), ("153000µL", "volume", [153000.0], "µL"), ("541 x 10^-3 T", "fluxdensity", [541.0], "mT"), ("0.3%", "proportion", [0.3], "percent"),
        ("kPa 12", "pressure", [12.0], "kPa"), ("mm Hg: 85,6", "pressure", [85.6], "mmHg"), ("kPa (abs)", "pressure", [], None), ("see text", "length", [], None), ("units", "length", [], None), (None, "length", [], None), ("", "length", [], None), ("?", "length", [], None),
    ],
)
def test_fields(text, quantity, numbers, unit):
    found = U.in_field(text, quantity)
    assert found[0][:1] == numbers[:1] and (found[1] and found[1][1]) == unit


def test_other_quantities_are_told_apart():
    assert U.in_field("mm", "pressure")[1] == ("length", "mm") and U.in_field("tesla per metre", "fluxdensity")[1] == ("fieldgradient", "T/m")


def test_texts():
    text = "At 5 mm. The length a was 0.0348 cm for 793 samples, 0,0348 of 9 g. Mass a: 37,08, based on 150 readings."
    assert U.in_text(text, "length_a", 0.0348, "length") == (0.0348, ("length", "cm"))
    assert U.in_text(text, "mass_a", 37.08, "mass") == (37.08, None)
    assert U.in_text(text, "mass_a", None, "mass")[0] == 37.08
    assert U.in_text(None, "mass_a", 1.0, "mass") is None and U.in_text("", "mass_a", None, "mass") is None
    assert U.in_text("length a is ３.５ ｍｍ​ here", "length_a", 3.5, "length") == (3.5, ("length", "mm"))


def test_every_factor_is_consistent():
    seen = {}
    for quantity, unit, factor, added in U.factors():
        assert (quantity, unit) not in seen and factor > 0
        seen[quantity, unit] = factor
    assert seen["length", "in"] == 25.4 and abs(seen["pressure", "mmHg"] * 760 - 101.325) < 1e-4 and abs(seen["followup", "day"] * 30.4375 - 1) < 1e-9


def test_facts(spark):
    rows = [
        ("a", "s", "pressure_a", 2.0, "bar", None), ("a", "s", "pressure_a", 2.0, "bar", None), ("b", "s", "pressure_a", 2.0, "KPa", None), ("c", "s", "length_a", 2.0, "bar", None), ("d", None, "length_a", 2.0, None, None),
        ("e", "s", "length_a", 0.0348, "see text", None), ("f", "s", "temp_a", 212.0, "°F", None), ("g", "s", "temp_a", 300.0, "K", None), ("h", "s", "rate_a", None, "= 2,871 ‰", (2.0, 3.0, 0.9)), ("i", "s", "rate_a", None, "2,871 ‰", (2000.0, 3000.0, 0.9)),
        ("j", "s", "volume_a", 4.61, "ccm", None), ("k", "s", "nothing", 1.0, "mm", None), ("l", "s", None, 1.0, "mm", None), ("m", "gone", "length_a", 1.0, "?", None), ("n", "s", "force_a", None, None, None), ("o", "s", "time_a", float("nan"), "60 s", None), ("p", "s", "sar_a", -1.25, "mW/g", None),
    ]
    spans = spark.createDataFrame([("s", "The length a was 0.0348 cm for 3. " + "word " * 50_000), ("s", "The length a was 0.0348 cm for 3. " + "word " * 50_000), (None, "x"), ("t", None)], "span_id string, text string").withColumn("unit", U.F.lit("clash"))
    labels = spark.createDataFrame(LABELS, "label string, quantity string, common_unit string, decimals int")
    facts = spark.createDataFrame(rows, FACTS).withColumn("text", U.F.lit("clash"))
    for bound in (200_000, 0):
        found = {r.gold_id: r for r in U.common_units(facts, spans, labels, bound).collect()}
        assert len(found) == 16
        assert {k: r.status for k, r in found.items()} == {
            "a": "converted", "b": "common", "c": "other_quantity", "d": "no_unit", "e": "converted", "f": "converted", "g": "converted", "h": "converted", "i": "converted", "j": "converted",
            "k": "unknown_label", "l": "unknown_label", "m": "no_unit", "n": "no_unit", "o": "converted", "p": "converted",
        }
        assert {k: r.value_scaled for k, r in found.items() if r.status == "converted"} == {"a": 2000, "e": 35, "f": 100, "g": 27, "h": 29, "i": 28710, "j": 46, "o": 10, "p": -125}
    assert U.common_units(facts.limit(0), spans, labels).count() == U.common_units(facts, spans.limit(0), labels).where("status = 'converted' and gold_id = 'e'").count() == 0
    assert {r.status for r in U.common_units(facts, spans, labels.limit(0)).collect()} == {"unknown_label"}


def test_the_span_is_read_wherever_the_field_lacks_unit_or_number(spark):
    units = ["N/A", "See text", "see table", "unknown", "–", "\u00a0", "\u200b", "ca.", "0.0348"]
    rows = [(f"u{k}", "s", "length_a", 0.0348, u, None) for k, u in enumerate(units)]
    rows += [(f"v{k}", "t", label, None, u, None) for k, (label, u) in enumerate([("volume_a", "cm3"), ("pressure_a", "N/mm2"), ("pressure_a", "cmH2O"), ("rate_a", "per 1000"), ("pressure_a", "10^5 Pa")])]
    text = "Volume a: 4.5 here. Pressure a: 2.5 there. Rate a: 7.5 of it."
    spans = spark.createDataFrame([("s", "The length a was 0.0348 cm for 3."), ("t", text)], "span_id string, text string")
    labels = spark.createDataFrame(LABELS, "label string, quantity string, common_unit string, decimals int")
    found = {r.gold_id: (r.status, r.value_scaled) for r in U.common_units(spark.createDataFrame(rows, FACTS), spans, labels).collect()}
    assert found == {f"u{k}": ("converted", 35) for k in range(len(units))} | {f"v{k}": ("converted", n) for k, n in enumerate((45, 25000, 2, 75, 2500))}
