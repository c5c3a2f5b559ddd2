"""Problem 5: works named in free form, mapped to the entries of a reference list.

An automaton over the names of all entries (author, body or bodies, trial or
reference number) finds them as whole words anywhere in a value; of matches that
overlap the first and then the longest counts. The first match decides, unless
"and", "&", a slash or a hyphen joins it to a word before: then another author
is named first. A body must not be joined to a further body either. What the
automaton leaves goes to a token-set similarity: all words of an entry, in any
order for bodies, the first author for works, against those of the value, each
within the slips that its length allows. Entries with a year match that year
only, letter included; numbers match digit by digit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.lookalike import skeleton
from claimloom.sources.tables import small

# Words that are no name.
LEAD = "see also cited from after according adapted trial study reference references number table abstract page personal note above unknown folder ibid".split()
KIND = "guideline guidelines recommendation recommendations gdl gdls consensus statement".split()
AFTER = "etal et al and und others other".split()
JOINS = "and und et y og".split()
# End of the fixed values.

BREAK = re.compile(r"(?<=[a-z])[-‐]\s+(?=[a-z])")
DOTTED = re.compile(r"(?<![a-z])(?:[a-z][.\-]\s?){2,}[a-z]?(?![a-z])")
PLACE = re.compile(r"\b(?:pp?|table|fig|figure|chapter|ch|vol|no?)\b\s*[.=]?\s*\d+|\bn\s*=\s*\d+")
TRIAL = re.compile(r"(?<![a-z])n?ct[^a-z0-9]*((?:[0-9oil][\s.\-]?){7}[0-9oil])(?![0-9a-z])")
NUMBERED = re.compile(r"(?<![a-z])ref(?:erences?|s)?[^a-z0-9]*(?:n[or]\b|number)?[^a-z0-9]*(\d[0-9oil]{0,5})(?![0-9a-z])")
YEAR = re.compile(r"(?<!\d)((?:19|20)\d\d)(?!\d)([a-z](?![a-z0-9]))?")
SHORT_YEAR = re.compile(r"(?:^|[^0-9a-z]|(?<=[a-z]))(\d\d)([a-z])?(?![0-9a-z])")
DIGITS = str.maketrans("oil", "011")
FIRST = -1_000_000_000  # rank of a number, before all places in a value
NOTHING = 1000  # rank of no entry
Year = tuple[int | None, str]


def fold(text: str) -> str:
    """``text`` without accents, in lower case and Latin letters."""
    text = unicodedata.normalize("NFKD", skeleton(text))
    return "".join(ch for ch in text if not unicodedata.combining(ch)).lower()


def allowed(name: str) -> int:
    """Slips allowed in a name: two, one up to six letters, none up to three."""
    return 2 if len(name) > 6 else 1 if len(name) > 3 else 0


def slips(a: str, b: str, most: int) -> int | None:
    """Letters left out, put in, changed or swapped between ``a`` and ``b``, if at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return None
    return row[-1] if row[-1] <= most else None


def less(name: str, most: int) -> set[str]:
    """``name`` and what is left of it without up to ``most`` letters."""
    found = level = {name}
    for _ in range(most):
        level = {x[:k] + x[k + 1 :] for x in level for k in range(len(x))}
        found = found | level
    return found


class Value:
    """What a freely written value names: a number, or names and a year."""

    def __init__(self, text: str) -> None:
        folded = BREAK.sub("", fold(text))
        folded = DOTTED.sub(lambda m: re.sub(r"[.\-\s]", "", m[0]), folded)
        self.number = None
        if m := TRIAL.search(folded):
            self.number = "nct" + re.sub(r"\D", "", m[1].translate(DIGITS))
        elif m := NUMBERED.search(folded):
            self.number = f"ref{int(m[1].translate(DIGITS))}"
        bare = PLACE.sub(" ", folded)
        self.year: Year = (None, "")
        if m := YEAR.search(bare):
            self.year = (int(m[1]), m[2] or "")
        elif m := SHORT_YEAR.search(bare):
            self.year = (int(m[1]) + (1900 if int(m[1]) > 50 else 2000), m[2] or "")
        self.words: list[str] = []
        self.joined: list[bool] = []  # whether a word is joined to the one before it
        join, end = False, 0
        found = list(re.finditer(r"[a-z]+", bare))
        for m, after in zip(found, [*found[1:], None]):
            join |= re.fullmatch(r"\s*[/&+‐-]\s*", bare[end : m.start()]) is not None
            end = m.end()
            if m[0] in JOINS and not (after and after[0] in ("al", "cols")):
                join = True
                continue
            self.words.append(m[0])
            self.joined.append(join and len(self.words) > 1 and self.words[-2] not in LEAD)
            join = False
        self.names = [w for w in self.words if w not in LEAD and w not in KIND and w not in AFTER and len(w) > 1]


class Entries:
    """The reference list, with its automaton and its index of slips.

    Entries of equal names and year that differ in their keys cannot be told
    apart: they make a tie. Of rows of one key the smallest ref_id stands.
    """

    def __init__(self, rows: tuple[tuple[str, str, str, int | None], ...]) -> None:
        self.by_number: dict[str, str | None] = {}
        self.works: dict[tuple[str, Year], str | None] = {}
        self.bodies: dict[tuple[tuple[str, ...], Year], str | None] = {}
        self.near: dict[str, set[str]] = {}
        self.of_body: dict[tuple[str, Year], set[tuple[str, ...]]] = {}
        self.automaton = ahocorasick.Automaton()
        keys: dict[tuple, str] = {}

        def put(table: dict, at, ref_id: str, key: str) -> None:
            if at not in table:
                table[at], keys[id(table), at] = ref_id, key
            elif keys[id(table), at] != key:
                table[at] = None

        for ref_id, key, form, given in rows:
            value = Value(key)
            year = (given or value.year[0], value.year[1])
            if value.number:
                put(self.by_number, value.number, ref_id, key)
            elif value.names and form == "named_guideline":
                names = tuple(sorted(value.names))
                put(self.bodies, (names, year), ref_id, key)
                self._add(tuple(value.names), True)
                self._add(tuple(reversed(value.names)), True)
                for name in value.names:
                    self.of_body.setdefault((name, year), set()).add(names)
            elif value.names:
                put(self.works, (value.names[0], year), ref_id, key)
                self._add(tuple(value.names[:1]), False)
            for name in value.names if not value.number else ():
                for part in less(name, allowed(name)):
                    self.near.setdefault(part, set()).add(name)
        self.automaton.make_automaton()

    def _add(self, names: tuple[str, ...], body: bool) -> None:
        known = self.automaton.get(text, None) if (text := f"|{'|'.join(names)}|") in self.automaton else None
        self.automaton.add_word(text, (names, body or bool(known and known[1])))

    def _matches(self, value: Value) -> list[tuple[int, tuple[str, ...], bool]]:
        """(place, names, whether of bodies) of the matches, the first and of these the longest before those that overlap it."""
        text = f"|{'|'.join(value.words)}|"
        at = {0: 0}
        for k, word in enumerate(value.words):
            at[sum(map(len, value.words[: k + 1])) + k + 1] = k + 1
        found = []
        for end, (names, body) in self.automaton.iter(text) if len(self.automaton) else ():
            found.append((at[end - sum(map(len, names)) - len(names)], names, body))
        kept, free = [], 0
        for place, names, body in sorted(found, key=lambda m: (m[0], -len(m[1]))):
            if place >= free:
                kept.append((place, names, body))
                free = place + len(names)
        return kept

    def _of(self, table: dict, names, year: Year) -> str | None:
        """The entry of ``year``; a year without a letter also means the only entry of that year with one."""
        if (names, year) in table or year[1]:
            return table.get((names, year))
        lettered = {table[names, (year[0], x)] for x in "abcdefghij" if (names, (year[0], x)) in table}
        return lettered.pop() if len(lettered) == 1 else None

    def embedded(self, value: Value) -> tuple[int, str | None] | None:
        """Rank and entry of the first match in ``value``; the entry is null if none of that name fits."""
        if value.number:
            return (FIRST, self.by_number[value.number]) if value.number in self.by_number else None
        for place, names, body in self._matches(value):
            if value.joined[place]:
                return None
            end = place + len(names)
            ref = self._of(self.bodies, tuple(sorted(names)), value.year) if body and not (end < len(value.words) and value.joined[end]) else None
            if ref is None and len(names) == 1:
                ref = self._of(self.works, names[0], value.year)
            if ref or not set(names) <= {*LEAD, *KIND, *AFTER}:
                return FIRST // 2 + 100 * place - len(names), ref
        return None

    @lru_cache(maxsize=100_000)
    def _alike(self, word: str) -> tuple[tuple[int, str], ...]:
        """(slips, name) of the names within the slips allowed of ``word``."""
        names = {n for part in less(word, 2) for n in self.near.get(part, ())}
        rated = ((slips(word, n, allowed(n)), n) for n in names)
        return tuple(sorted((s, n) for s, n in rated if s is not None))

    def _bodies_like(self, value: Value) -> Iterator[tuple[int, str | None]]:
        """(slips, entry) of the bodies whose names are all among the words of ``value``, none of which is joined to a further one."""
        alike = {w: dict((n, s) for s, n in self._alike(w)) for w in set(value.names)}
        for names in {e for found in alike.values() for n in found for e in self.of_body.get((n, value.year), ())}:

            def least(k: int, free: frozenset[str], names=names) -> tuple[int, frozenset[str]] | None:
                if k == len(names):
                    return 0, free
                found = [(alike[w][names[k]] + r[0], r[1]) for w in free if names[k] in alike[w] and (r := least(k + 1, free - {w}))]
                return min(found, key=lambda x: x[0], default=None)

            if best := least(0, frozenset(alike)):
                used = [w in alike and w not in best[1] for w in value.words]
                if all(used[k] == used[k - 1] for k in range(1, len(used)) if value.joined[k]):
                    yield best[0], self.bodies[names, value.year]

    def similar(self, value: Value) -> tuple[int, str | None] | None:
        """Slips and entry of the year whose token set is the most like the value's; no entry at a tie."""
        if value.number or value.year[0] is None:
            return None
        long = [w for w in value.names if len(w) > 3][:2]
        joined = [*long[:1], *(["".join(long)] if len(long) > 1 else [])]
        best = [(s, ref) for word in joined for s, n in self._alike(word) if (ref := self._of(self.works, n, value.year))]
        best += self._bodies_like(value)
        best.sort(key=lambda x: x[0])
        if not best:
            return None
        return best[0][0], None if any(s == best[0][0] and r != best[0][1] for s, r in best) else best[0][1]

    def resolve(self, text: str) -> tuple[int, str | None] | None:
        """(rank, ref_id): below zero if found as it stands, else the slips; ref_id is null at a tie."""
        value = Value(text)
        return self.embedded(value) or self.similar(value)


@lru_cache(maxsize=4)
def _entries(rows: tuple[tuple[str, str, str, int | None], ...]) -> Entries:
    return Entries(rows)


def _blocks(rows: list[tuple], block: int) -> list[tuple]:
    """``rows`` in blocks of about ``block``; entries of one first name stand in one block, so that ties and letters are seen."""
    named: dict[str, list[tuple]] = {}
    for row in rows:
        value = Value(row[1])
        named.setdefault(value.number or min(value.names, default=""), []).append(row)
    parts: list[list[tuple]] = [[]]
    for found in named.values():
        if len(parts[-1]) >= block:
            parts.append([])
        parts[-1] += found
    return [tuple(p) for p in parts]


def resolve(values: DataFrame, references: DataFrame, block: int = 50_000) -> DataFrame:
    """(record_id, ref_id): for each value the entry meant, or 'none'.

    values: record_id, value. references: ref_id, citation_key, form, pub_year.
    The list is read in blocks of about ``block`` entries, each sent to every
    executor; the same entry wins over several blocks as in one. Null and blank
    values give 'none'; so do values of which two entries are equally similar, or
    cannot be told apart by names, year and letter; of rows with one key the
    smallest ref_id stands; repeated rows count once; null record ids give no
    row; an empty list gives 'none' for every value.
    """
    rows = references.select("ref_id", "citation_key", "form", "pub_year").where("ref_id is not null and citation_key is not null")
    rows = [tuple(r) for r in rows.distinct().orderBy("ref_id", "citation_key").collect()]
    values = values.select("record_id", "value").where("record_id is not null").distinct()
    spark = values.sparkSession

    def run(part: tuple) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            entries, known = _entries(shared.value), {}
            for df in batches:
                for v in set(df["value"]) - known.keys():
                    known[v] = entries.resolve(v) if v else None
                found = [known[v] or (NOTHING, None) for v in df["value"]]
                yield pd.DataFrame({"record_id": df["record_id"], "value": df["value"], "way": [x[0] for x in found], "ref_id": [x[1] for x in found]})
                if len(known) > 200_000:
                    known.clear()

        return values.mapInPandas(scan, "record_id string, value string, way int, ref_id string")

    parts = _blocks(rows, block)
    found = run(parts[0])
    for part in parts[1:]:
        found = found.unionByName(run(part))
    if len(parts) > 1:
        tie = F.count_if((F.col("way") >= 0) & F.col("ref_id").isNull()) > 0  # of equally many slips
        found = found.groupBy("record_id", "value", "way").agg(F.min("ref_id").alias("ref_id"), F.max("ref_id").alias("last"), tie.alias("tie"))
        ref = F.when(~F.col("tie") & (F.col("ref_id") == F.col("last")), F.col("ref_id"))
        found = found.groupBy("record_id", "value").agg(F.min_by(ref, "way").alias("ref_id"))
    return found.select("record_id", F.coalesce("ref_id", F.lit("none")).alias("ref_id"))


def unkeyed(mentions: DataFrame, graph: DataFrame, references: DataFrame) -> DataFrame:
    """(record_id, value) of the mentions and graph sources that name no key literally.

    A mention counts unless its form is null or begins with ``numeric_``; its
    value is the marker, or the key where the marker is null or blank. A graph
    source counts if its key is not null.
    """
    keys = small(references.select(F.col("citation_key").alias("key")).where("key is not null").distinct())
    marker = F.when(F.trim("marker_text") != "", F.col("marker_text")).otherwise(F.col("normalized_key"))
    mentions = mentions.where(~F.col("marker_form").startswith("numeric_"))
    mentions = mentions.select(F.col("mention_id").alias("record_id"), marker.alias("value"), F.col("normalized_key").alias("key"))
    graph = graph.where("record_type = 'source' and citation_key is not null")
    graph = graph.select("record_id", F.col("citation_key").alias("value"), F.col("citation_key").alias("key"))
    return mentions.unionByName(graph).join(keys, "key", "left_anti").select("record_id", "value")
