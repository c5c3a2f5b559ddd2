"""Problem 4: quantities recorded in many units, brought to one per label.

A multi-pattern automaton over the spellings of all units reads the unit beside
a number, in the fact's own unit field or, where that names none, in the fact's
span. The longest spelling wins; where it stands for several units, the label's
quantity and then the exact letter case decide. The factors of the units found
are joined from a table of fixed size.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from claimloom.sources.tables import small, written

# Quantity | unit | factor to the first unit of the quantity | added before it | spellings.
UNITS = """
pressure | kPa | 1 | 0 | kPa; kilopascal
pressure | Pa | 0.001 | 0 | Pa; pascal
pressure | MPa | 1000 | 0 | MPa; megapascal
pressure | N/mm2 | 1000 | 0 | N/mm2; N/mm^2
pressure | 10^5 Pa | 100 | 0 | 10^5 Pa
pressure | bar | 100 | 0 | bar
pressure | mbar | 0.1 | 0 | mbar; millibar
pressure | atm | 101.325 | 0 | atm; atmosphere
pressure | mmHg | 0.133322387415 | 0 | mmHg; mm Hg; mm of mercury; millimetre of mercury
pressure | torr | 0.13332236842105263 | 0 | torr
pressure | cmH2O | 0.0980665 | 0 | cmH2O; cm H2O; cm of water; centimetres of water
pressure | psi | 6.894757293168361 | 0 | psi; lb/in2; lbf/in2; pound per square inch
length | mm | 1 | 0 | mm; millimetre
length | cm | 10 | 0 | cm; centimetre
length | m | 1000 | 0 | m; metre
length | µm | 0.001 | 0 | µm; um; micron; micrometre; 10^-6 m
length | nm | 0.000001 | 0 | nm; nanometre
length | in | 25.4 | 0 | in; in.; inch; inches; ″; "
length | Fr | 0.3333333333333333 | 0 | Fr; French; F (French); Ch; Charrière; Charriere
mass | mg | 1 | 0 | mg; milligram
mass | g | 1000 | 0 | g; gm; gram
mass | kg | 1000000 | 0 | kg; kilogram
mass | µg | 0.001 | 0 | µg; ug; mcg; microgram
mass | ng | 0.000001 | 0 | ng; nanogram
force | N | 1 | 0 | N; newton
force | mN | 0.001 | 0 | mN; millinewton; 10^-3 N
force | kN | 1000 | 0 | kN; kilonewton
force | kgf | 9.80665 | 0 | kgf; kg-force; kilogram-force; kp; kilopond
force | gf | 0.00980665 | 0 | gf; gram-force; gram force; grams-force
force | lbf | 4.4482216152605 | 0 | lbf; lb-force; pound-force; pounds-force
temperature | degC | 1 | 0 | degC; deg C; °C; Celsius; degrees Celsius
temperature | K | 1 | -273.15 | K; kelvin
temperature | degF | 0.5555555555555556 | -32 | degF; deg F; °F; Fahrenheit; degrees Fahrenheit
duration | min | 1 | 0 | min; minute
duration | s | 0.016666666666666666 | 0 | s; sec; second
duration | ms | 0.000016666666666666667 | 0 | ms; millisecond
duration | h | 60 | 0 | h; hr; hrs; hour
duration | d | 1440 | 0 | d; day
followup | month | 1 | 0 | month; mo; mth
followup | year | 12 | 0 | year; yr; yrs; y
followup | week | 0.22997946611909652 | 0 | week; wk; wks
followup | day | 0.03285420944558522 | 0 | day; d
proportion | percent | 1 | 0 | percent; per cent; pct; %; %age; percentage; per 100
proportion | fraction | 100 | 0 | fraction; proportion; ratio; (0-1)
proportion | per mille | 0.1 | 0 | ‰; per mille; per thousand; per 1000; per 1,000; per 1 000; /1,000; /1000
proportion | per 10000 | 0.01 | 0 | ‱; per 10,000; per 10 000; per 10000; /10000; /10,000; per ten thousand
proportion | ppm | 0.0001 | 0 | ppm; parts per million; per million
fluxdensity | T | 1 | 0 | T; tesla
fluxdensity | mT | 0.001 | 0 | mT; millitesla; 10^-3 T
fluxdensity | G | 0.0001 | 0 | G; Gs; gauss
fluxdensity | kG | 0.1 | 0 | kG; kilogauss
fieldgradient | T/m | 1 | 0 | T/m; tesla/m; tesla per metre
fieldgradient | mT/m | 0.001 | 0 | mT/m; millitesla/m; millitesla per metre
fieldgradient | G/cm | 0.01 | 0 | G/cm; gauss/cm; gauss / cm; gauss per centimetre
absorption | W/kg | 1 | 0 | W/kg; watt/kg; watts/kg; W kg-1; W kg^-1; watt per kilogram
absorption | mW/kg | 0.001 | 0 | mW/kg; milliwatt/kg; milliwatt per kilogram
absorption | mW/g | 1 | 0 | mW/g; milliwatt/g; milliwatt per gram
volume | mL | 1 | 0 | mL; millilitre
volume | cm3 | 1 | 0 | cm3; cm^3; cc; ccm; cubic centimetre; cubic centimetres
volume | L | 1000 | 0 | L; litre
volume | dL | 100 | 0 | dL; decilitre
volume | µL | 0.001 | 0 | µL; uL; microlitre
"""
SIGNS = {"º": "°", "℃": "°C", "℉": "°F", "μ": "µ", "×": "x", "−": "-", "‐": "-", "‑": "-", "′′": "″", "''": "″"}
# End of the fixed values.

NUMBER = re.compile(r"(?<![\w.,])-?\d+(?:[.,]\d+)*")
BEFORE = re.compile(r"^(?:approx\.?|approximately|about|ca\.?|circa|=|~|≈|:)\s*", re.I)
POWER = re.compile(r"10([⁻⁰¹²³⁴-⁹]+)")
FACTORS = "quantity string, unit string, factor double, added double"


def factors() -> list[tuple[str, str, float, float]]:
    """(quantity, unit, factor, added): (value + added) * factor is in the quantity's first unit."""
    rows = [[x.strip() for x in line.split(" | ")] for line in UNITS.strip().splitlines()]
    return [(q, unit, float(f), float(a)) for q, unit, f, a, _ in rows]


@lru_cache(maxsize=None)
def _raised() -> dict[int, str]:
    return {cp: unicodedata.normalize("NFKC", chr(cp)).replace("−", "-") for cp in (*range(0x2070, 0x208F), 0xB2, 0xB3, 0xB9) if unicodedata.category(chr(cp)) != "Cn"}


@lru_cache(maxsize=65536)
def _sign(ch: str) -> str:
    if unicodedata.category(ch) == "Cf":
        return ""
    if ch.isspace():
        return " "
    made = unicodedata.decomposition(ch)
    return unicodedata.normalize("NFKC", ch) if made.startswith(("<wide>", "<narrow>")) else SIGNS.get(ch, ch)


def fold(text: str) -> str:
    """``text`` with one kind of blank, plain digits and one sign for each symbol."""
    if not text.isascii():
        text = "".join(map(_sign, unicodedata.normalize("NFC", text)))
        text = POWER.sub(lambda m: "10^" + m[1].translate(_raised()), text).translate(_raised())
    return re.sub(r"\s+", " ", text).strip()


def spellings(name: str) -> set[str]:
    """``name`` with its plural and in American spelling; powers also behind a times sign."""
    found = {name} | {name.replace("metre", "meter").replace("litre", "liter")}
    if re.fullmatch(r"[a-z]{3,}", name):
        found |= {f"{x}s" for x in found}
    elif re.match(r"[a-z]{4,} (?:of|per) ", name):
        found |= {x.replace(" ", "s ", 1) for x in found}
    return found | {sign + x for x in found for sign in ("x ", "x") if name.startswith("10^")}


@lru_cache(maxsize=None)
def _automaton() -> ahocorasick.Automaton:
    """All spellings without letter case; each with its (quantity, unit, spelling)."""
    found: dict[str, list[tuple[str, str, str]]] = {}
    for line in UNITS.strip().splitlines():
        quantity, unit, _, _, names = (x.strip() for x in line.split(" | "))
        for name in names.split("; "):
            for spelling in sorted(spellings(name)):
                found.setdefault(spelling.lower(), []).append((quantity, unit, spelling))
    made = ahocorasick.Automaton()
    for spelling, units in found.items():
        made.add_word(spelling, (spelling, units))
    made.make_automaton()
    return made


@lru_cache(maxsize=None)
def _longest() -> int:
    return max(map(len, _automaton().keys()))


def _meant(units: list[tuple[str, str, str]], written: str, quantity: str) -> tuple[str, str]:
    """(quantity, unit) of the best reading of ``written``."""
    best = min(units, key=lambda u: (u[0] != quantity, u[2] != written))
    return best[0], best[1]


def unit_at(text: str, at: int, quantity: str) -> tuple[str, str, int] | None:
    """(quantity, unit, end) of the longest spelling that begins at ``at``."""
    best, low = None, text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for last, (spelling, units) in _automaton().iter(low, at, min(len(low), at + _longest())):
        end = last + 1
        if end - len(spelling) == at and (end == len(low) or not spelling[-1].isalnum() or not (low[end].isalnum() or low[end] in "/^")):
            best = (*_meant(units, text[at:end], quantity), end)
    return best


def _readings(number: str) -> list[float]:
    """What a written number may be: its comma is a decimal sign or groups digits."""
    whole = number.replace(",", "")
    grouped = [float(whole)] if whole.count(".") <= 1 else []
    return ([float(number.replace(",", "."))] if number.count(",") == 1 and "." not in number else []) + grouped


def _equal(a: float, b: float) -> bool:
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def in_field(unit: str | None, quantity: str) -> tuple[list[float], tuple[str, str] | None]:
    """Readings of the number, and the unit, that a unit field holds."""
    text = BEFORE.sub("", fold(unit or ""))
    whole = lambda at: (u := unit_at(text, at, quantity)) and text[u[2] :].strip(" .") == "" and u[:2]
    if found := whole(0):
        return [], found
    if m := NUMBER.match(text):
        rest = m.end() + (text[m.end() : m.end() + 1] == " ")
        return _readings(m[0]), whole(rest) or None
    if (found := unit_at(text, 0, quantity)) and (m := NUMBER.fullmatch(text[found[2] :].lstrip(" :="))):
        return _readings(m[0]), found[:2]
    return [], None


def in_text(text: str | None, label: str, value: float | None, quantity: str) -> tuple[float, tuple[str, str] | None] | None:
    """Number and unit that ``text`` gives for ``label``; the number is ``value`` if known.

    Numbers behind a naming of the label come first, the nearest of them before
    others; numbers with no unit beside them count if none has one.
    """
    text = fold(text or "")
    name = label.replace("_", " ").lower()
    low = text.lower()
    named = [m.end() for m in re.finditer(re.escape(name), low)]
    best = None
    for m in NUMBER.finditer(text):
        read = next((x for x in _readings(m[0]) if value is None or _equal(x, value)), None)
        far = min((m.start() - n for n in named if n <= m.start()), default=None)
        if read is None or value is None and far is None:
            continue
        at = m.end() + (text[m.end() : m.end() + 1] in (" ", "-"))
        unit = unit_at(text, at, quantity)
        rank = (unit is None, far is None, far or 0)
        if best is None or rank < best[0]:
            best = (rank, read, unit and unit[:2])
    return best and best[1:]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        out = []
        for value, unit, label, quantity, lower, upper, text in zip(*(df[c] for c in ("value", "unit", "label", "quantity", "lower", "upper", "text"))):
            value = None if value is None or math.isnan(value) else float(value)
            numbers, found = in_field(unit, quantity)
            if value is None and numbers:
                value = next((x for x in numbers if lower <= x <= upper), numbers[0])
            if (found is None or value is None) and (given := in_text(text, label, value, quantity)):
                value, found = given[0], found or given[1]
            out.append((value, *(found or (None, None))))
        df["number"], df["found_quantity"], df["found_unit"] = ([r[k] for r in out] for k in range(3))
        yield df[["gold_id", "label", "number", "found_quantity", "found_unit"]].astype({"number": "float64"})


@F.pandas_udf(BooleanType())
def _lacking(unit: pd.Series, value: pd.Series) -> pd.Series:
    """Whether a field names no unit, or no number where the fact has none."""
    read = [in_field(u, "") for u in unit]
    return pd.Series([found is None or math.isnan(v) and not numbers for (numbers, found), v in zip(read, value.astype("float64"))], dtype="bool")


def common_units(facts: DataFrame, spans: DataFrame, labels: DataFrame, broadcast_ids: int = 200_000) -> DataFrame:
    """Each fact in the common unit of its label.

    Columns: gold_id, label, status, common_unit, unit, value, value_scaled.
    status is "converted", "common" (already in the common unit, in any
    spelling), "no_unit", "no_number", "other_quantity" or "unknown_label";
    value is in the common unit and value_scaled is value times 10^decimals,
    rounded half up, both null unless converted or common.

    Equal repeated facts give one row; facts that share a gold_id but differ
    give one row each; of labels and spans with one id that differ the first in order counts. Null units and values are looked up in the span; a null
    or unknown span_id, or a null text, gives nothing to look up. Spans are read
    only for facts whose field names no unit or number; their ids are broadcast
    if there are at most ``broadcast_ids`` of them, else joined by a shuffle.
    """
    spark = facts.sparkSession
    level = F.col("confidence_interval")
    facts = facts.select("gold_id", "span_id", "label", "value", "unit", level["lower"].alias("lower"), level["upper"].alias("upper")).distinct()
    labels = labels.where("label is not null").groupBy("label").agg(F.min(F.struct("quantity", "common_unit", "decimals")).alias("l")).select("label", "l.*")
    facts = facts.join(small(labels), "label", "left")
    known = facts.where("common_unit is not null")
    known = written(known.withColumn("unsure", _lacking("unit", "value")), "facts")
    lost = known.where("unsure")
    ids = lost.select("span_id").where("span_id is not null").distinct()
    texts = spans.select("span_id", "text").join(small(ids, broadcast_ids), "span_id", "left_semi")
    lost = lost.join(texts.groupBy("span_id").agg(F.min("text").alias("text")), "span_id", "left")
    both = known.where("not unsure").withColumn("text", F.lit(None).cast("string")).unionByName(lost)
    schema = "gold_id string, label string, number double, found_quantity string, found_unit string"
    read = both.select("gold_id", "label", "quantity", "value", "unit", "lower", "upper", "text").mapInPandas(_read, schema)

    table = spark.createDataFrame(factors(), FACTORS)
    read = read.join(small(labels), "label")
    own = table.select(F.col("quantity").alias("found_quantity"), F.col("unit").alias("found_unit"), "factor", "added")
    goal = table.select("quantity", F.col("unit").alias("common_unit"), F.col("factor").alias("goal_factor"), F.col("added").alias("goal_added"))
    read = read.join(F.broadcast(own), ["found_quantity", "found_unit"], "left").join(F.broadcast(goal), ["quantity", "common_unit"], "left")
    status = (
        F.when(F.col("found_unit").isNull(), "no_unit")
        .when(F.col("found_quantity") != F.col("quantity"), "other_quantity")
        .when(F.col("number").isNull(), "no_number")
        .when(F.col("found_unit") == F.col("common_unit"), "common")
        .when(F.col("goal_factor").isNull(), "other_quantity")
        .otherwise("converted")
    )
    value = F.when(status == "common", F.col("number")).when(status == "converted", (F.col("number") + F.col("added")) * F.col("factor") / F.col("goal_factor") - F.col("goal_added"))
    read = read.withColumn("status", status).withColumn("value_out", value)
    times = F.abs("value_out") * F.pow(F.lit(10.0), "decimals") * (1 + 1e-12)
    scaled = (F.floor(times + 0.5) * F.signum("value_out")).cast("bigint")
    done = read.select("gold_id", "label", "status", "common_unit", F.col("found_unit").alias("unit"), F.col("value_out").alias("value"), scaled.alias("value_scaled"))
    rest = facts.where("common_unit is null").select("gold_id", "label", F.lit("unknown_label").alias("status"), "common_unit", F.lit(None).cast("string").alias("unit"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("bigint").alias("value_scaled"))
    return done.unionByName(rest).distinct()
