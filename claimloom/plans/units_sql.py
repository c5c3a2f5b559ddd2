"""DuckDB SQL of p4_found, written apart from the operator: field, or else the text behind the label."""

from __future__ import annotations

# Quantity, unit, factor, added, spellings without case (as patterns); the first unit of a quantity is the common one.
NAMES = (
    ("pressure", "kPa", "1", "0", r"kpa|kilopascal"), ("pressure", "MPa", "1000", "0", r"mpa|megapascal"), ("pressure", "N/mm2", "1000", "0", r"n/mm\^?2"), ("pressure", "10^5 Pa", "100", "0", r"(x ?)?10\^5 pa"),
    ("pressure", "bar", "100", "0", r"bars?"), ("pressure", "atm", "101.325", "0", r"atm|atmospheres?"), ("pressure", "mmHg", "0.133322387415", "0", r"mm ?hg|mm of mercury|millimetres of mercury"), ("pressure", "torr", "0.13332236842105263", "0", r"torr"),
    ("pressure", "cmH2O", "0.0980665", "0", r"cm ?h2o|cm of water"), ("pressure", "psi", "6.894757293168361", "0", r"psi|lbf?/in2|pounds per square inch"),
    ("length", "mm", "1", "0", r"mm|millimet(re|er)s?"), ("length", "cm", "10", "0", r"cm|centimet(re|er)s?"), ("length", "um", "0.001", "0", r"[µu]m|microns?|micrometres?|(x ?)?10\^-6 m"), ("length", "in", "25.4", "0", r"in|inch|inches|″|\x22"), ("length", "Fr", "0.3333333333333333", "0", r"fr|french|f \(french\)|ch|charrière"),
    ("mass", "mg", "1", "0", r"mg|milligrams?"), ("mass", "g", "1000", "0", r"g|gm|grams?"), ("mass", "ug", "0.001", "0", r"[µu]g|mcg|micrograms?"),
    ("force", "N", "1", "0", r"n|newtons?"), ("force", "mN", "0.001", "0", r"mn|millinewtons?|(x ?)?10\^-3 n"), ("force", "kgf", "9.80665", "0", r"kgf|kg-force|kp"), ("force", "gf", "0.00980665", "0", r"gf|gram[- ]force"), ("force", "lbf", "4.4482216152605", "0", r"lbf|lb-force|pound-force"),
    ("temperature", "degC", "1", "0", r"deg ?c|°c|celsius"), ("temperature", "K", "1", "-273.15", r"k|kelvins?"), ("temperature", "degF", "0.5555555555555556", "-32", r"deg ?f|°f|fahrenheit"),
    ("duration", "min", "1", "0", r"min|mins|minutes?"), ("duration", "s", "0.016666666666666666", "0", r"s|sec|secs|seconds?"), ("duration", "h", "60", "0", r"h|hr|hrs|hours?"), ("duration", "d", "1440", "0", r"d|days?"),
    ("followup", "month", "1", "0", r"months?|mo|mths?"), ("followup", "year", "12", "0", r"years?|yrs?|y"), ("followup", "day", "0.03285420944558522", "0", r"d|days?"),
    ("proportion", "percent", "1", "0", r"percent|per cent|pct|%|%age"), ("proportion", "fraction", "100", "0", r"fraction|proportion|ratio|\(0-1\)"), ("proportion", "per mille", "0.1", "0", r"‰|per mille|per thousand|per 1,?000|/1,?000"), ("proportion", "per 10000", "0.01", "0", r"‱|per 10[ ,]?000|/10,?000"),
    ("fluxdensity", "T", "1", "0", r"t|tesla"), ("fluxdensity", "mT", "0.001", "0", r"mt|millitesla|(x ?)?10\^-3 t"), ("fluxdensity", "G", "0.0001", "0", r"g|gs|gauss"), ("fluxdensity", "kG", "0.1", "0", r"kg|kilogauss"),
    ("fieldgradient", "T/m", "1", "0", r"t(esla)?/m|tesla per metre"), ("fieldgradient", "mT/m", "0.001", "0", r"mt/m|millitesla per metre"), ("fieldgradient", "G/cm", "0.01", "0", r"g/cm|gauss ?/ ?cm|gauss per centimetre"),
    ("absorption", "W/kg", "1", "0", r"w(att)?/kg|w kg-1|watts? per kilogram"), ("absorption", "mW/kg", "0.001", "0", r"mw/kg|milliwatts? per kilogram"), ("absorption", "mW/g", "1", "0", r"mw/g|milliwatts? per gram"),
    ("volume", "mL", "1", "0", r"ml|millilit(re|er)s?"), ("volume", "cm3", "1", "0", r"cm3|cc|ccm"), ("volume", "L", "1000", "0", r"l|lit(re|er)s?"), ("volume", "dL", "100", "0", r"dl|decilit(re|er)s?"), ("volume", "uL", "0.001", "0", r"[µu]l|microlit(re|er)s?"),
)
# End of the fixed values.

VALUES = ", ".join(f"('{q}', '{u}', {f}, {a}, '^({p})\\.?$')" for q, u, f, a, p in NAMES)
ANY = "|".join(sorted({p for *_, p in NAMES}, key=lambda p: (" per " not in p, " of " not in p, -len(p), p)))
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE).replace("'", "''")
NUMBER = r"\d+(?:[.,]\d+)?"


def fold(x: str) -> str:
    x = f"regexp_replace(replace(replace({x}, '℃', '°C'), '℉', '°F'), '[\\p{{Cf}}]', '', 'g')"
    x = f"regexp_replace(translate({x}, '{WIDE}ºμ×−‐‑²³₂', '{NARROW}°µx---232'), '10⁵', '10^5', 'g')"
    return f"lower(trim(regexp_replace({x}, '[\\s\\p{{Zs}}]+', ' ', 'g')))"


P4 = f"""
WITH u(quantity, unit, factor, added, pattern) AS (VALUES {VALUES}),
f AS (SELECT DISTINCT gold_id, span_id, label, value, unit AS raw, quantity, common_unit, decimals,
    regexp_replace({fold("coalesce(unit, '')")}, '^(approx\\.|=) ?', '') AS field FROM demo_numeric_facts JOIN measure_labels USING (label)),
s AS (SELECT span_id, any_value({fold("text")}) AS text FROM spans GROUP BY 1),
g AS (SELECT *, CASE WHEN value IS NOT NULL AND NOT isnan(value) THEN value ELSE TRY_CAST(replace(regexp_extract(field, '^({NUMBER})', 1), ',', '.') AS DOUBLE) END AS number,
    CASE WHEN value IS NOT NULL AND NOT isnan(value) THEN field ELSE trim(regexp_replace(field, '^{NUMBER}', '')) END AS name FROM f),
t AS (SELECT g.*, CASE WHEN field IN ('', '-', '?', 'see text', 'units') THEN regexp_extract(text, replace(label, '_', ' ') || '[^0-9]{{0,20}}{NUMBER} ?({ANY})(?:[^a-z0-9/]|$)', 1) ELSE name END AS named FROM g LEFT JOIN s USING (span_id))
SELECT DISTINCT t.gold_id, t.common_unit, CAST(round((number + u.added) * u.factor * power(10, decimals) * (1 + 1e-12)) AS BIGINT) AS value_scaled
FROM t JOIN u ON t.quantity = u.quantity AND regexp_matches(named, u.pattern) WHERE u.unit <> t.common_unit AND number IS NOT NULL
"""
