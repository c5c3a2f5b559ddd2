"""Problem 6: passages of held-out test items inside a corpus.

Pigeonhole edit matching. The error budget of an item is the number of its runs
of five words that a document may lack and still hold the share asked for. As
many runs and ``whole`` more, spread over the item, are its pieces: a document
that lacks no more than the budget holds ``whole`` of them at least. One would do;
half of the runs asked for spare verifying every document that shares a common
phrase. An automaton over all pieces finds their exact hits, blind to case,
punctuation, spacing, look-alike and invisible characters. Items with enough hits
are verified: Myers' bit-parallel
distance, of all runs of the item at once, gives the runs that stand in the
document with at most ``edits`` letters put in, left out or changed; enough of
them make a leak. Of these the runs that stand there exactly are counted too.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.lookalike import skeleton

RUN = 5
WORD = re.compile(r"[^\W_]+")
LEAKS = "doc_id bigint, item_id bigint, runs_held int, runs_near int, runs int"


def words(text: str | None) -> list[str]:
    """The words of ``text``, blind to case, punctuation and look-alikes."""
    return WORD.findall((skeleton(text) or "").lower())


class Myers:
    """Bit-parallel edit distance of many patterns at once against any part of a text.

    Each pattern has a lane of the same width in one long number, led by signs
    that match anything; a bit between the lanes takes the carry of the addition.
    """

    def __init__(self, patterns: list[str], most: int) -> None:
        self.length = max(map(len, patterns), default=1)
        width = max(self.length + 1, 8)
        self.low = sum(1 << width * k for k in range(len(patterns)))
        self.full = self.low * ((1 << self.length) - 1)
        self.top = self.low << (width - 1)
        self.over = self.low * ((1 << (width - 1)) - 1 - most)
        self.any = sum((1 << (self.length - len(p))) - 1 << width * k for k, p in enumerate(patterns))
        self.equal: dict[str, int] = {}
        for k, p in enumerate(patterns):
            for i, ch in enumerate(p, width * k + self.length - len(p)):
                self.equal[ch] = self.equal.get(ch, self.any) | 1 << i
        self.lanes = [1 << width * k + width - 1 for k in range(len(patterns))]

    def within(self, text: str) -> list[bool]:
        """Whether each pattern stands in ``text`` with at most ``most`` edits."""
        full, low, last, found = self.full, self.low, self.length - 1, 0
        up, down, score = full, 0, self.low * self.length
        equal, rest = self.equal, self.any
        for ch in "\0" * self.length + text:
            eq = equal.get(ch, rest)
            across = (((eq & up) + up) ^ up) | eq
            more, fewer = down | (full ^ (full & (across | up))), up & across
            score += ((more >> last) & low) - ((fewer >> last) & low)
            found |= self.top ^ ((score + self.over) & self.top)
            eq |= down
            more, fewer = (more << 1) & full, (fewer << 1) & full
            up, down = fewer | (full ^ (full & (eq | more))), more & eq
        return [bool(found & lane) for lane in self.lanes]


class Item:
    """One test item: its runs, its pieces and the number of runs that make a leak."""

    def __init__(self, item_id: int, text: str | None, share: float, edits: int) -> None:
        self.item_id, found, self.edits = item_id, words(text), edits
        run = min(RUN, len(found))
        self.runs = ["".join(found[k : k + run]) for k in range(len(found) - run + 1)] if found else []
        self.needed = max(1, math.ceil(share * len(self.runs) - 1e-9))
        self.whole = -(-self.needed // 2)
        n = len(self.runs) - self.needed + self.whole
        self.pieces = Counter(self.runs[k * len(self.runs) // n] for k in range(n)) if self.runs else Counter()

    @cached_property
    def distinct(self) -> tuple[list[str], Myers]:
        runs = list(dict.fromkeys(self.runs))
        return runs, Myers(runs, self.edits)

    def verified(self, letters: str) -> set[str]:
        """The runs that stand in ``letters`` within the edits allowed."""
        runs, myers = self.distinct
        return {run for run, near in zip(runs, myers.within(letters)) if near}


def _held(text: str, joins: set[int], run: str) -> bool:
    """Whether ``run`` stands in ``text``, not cut out of a longer number."""
    at = text.find(run)
    while at >= 0:
        end = at + len(run)
        if not (run[0].isdigit() and at and text[at - 1].isdigit() and at not in joins) and not (run[-1].isdigit() and end < len(text) and text[end].isdigit() and end not in joins):
            return True
        at = text.find(run, at + 1)
    return False


SIGNS = bytes(c for c in range(128) if not chr(c).isalnum())


def letters_of(text: str | None) -> str:
    """The words of ``text`` without anything between them."""
    if not text:
        return ""
    if text.isascii():
        return text.encode().translate(None, SIGNS).lower().decode()
    return "".join(words(text))


def search(items: list[Item], automaton: ahocorasick.Automaton, text: str | None) -> Iterator[tuple[int, int, int, int]]:
    """(item_id, runs held, runs near, runs) of each item of which ``text`` holds enough."""
    letters = letters_of(text)
    if not letters:
        return
    hits: dict[int, int] = {}
    for k, n in (x for owners in {id(o): o for _, o in automaton.iter(letters)}.values() for x in owners):
        hits[k] = hits.get(k, 0) + n
    joins: set[int] = set()
    for k in sorted(hits):
        item = items[k]
        if hits[k] < item.whole:
            continue
        near = item.verified(letters)
        n = sum(run in near for run in item.runs)
        if n >= item.needed:
            joins = joins or {0, *itertools.accumulate(map(len, words(text)))}
            held = {run for run in near if _held(letters, joins, run)}
            yield item.item_id, sum(run in held for run in item.runs), n, len(item.runs)


@lru_cache(maxsize=4)
def _prepared(block: tuple[tuple[int, str], ...], share: float, edits: int) -> tuple[list[Item], ahocorasick.Automaton]:
    items = [Item(i, t, share, edits) for i, t in block]
    owners: dict[str, list[tuple[int, int]]] = {}
    for k, item in enumerate(items):
        for piece, n in item.pieces.items():
            owners.setdefault(piece, []).append((k, n))
    automaton = ahocorasick.Automaton()
    for piece, of in owners.items():
        automaton.add_word(piece, of)
    automaton.make_automaton()
    return items, automaton


def leaks(documents: DataFrame, items: DataFrame, share: float = 1 / 3, edits: int = 2, block: int = 20_000_000) -> DataFrame:
    """One row per document and item of which it holds ``share`` of the five-word runs, each with at most ``edits`` edits.

    documents: doc_id, text; items: item_id, text. Columns: doc_id, item_id,
    runs_held (exactly), runs_near (within the edits), runs. Every document with
    enough runs held exactly is found; one with edited runs is found if it holds
    half as many pieces as a whole. Edits count letters and digits only.

    The items are the query set: they are read in blocks of about ``block``
    letters, each of which passes once over all documents. An item of fewer than five
    words is one run; null and empty texts hold and are nothing, nor do null ids; repeated rows
    give repeated rows only if their ids differ; empty tables give no rows.
    """
    rows = items.select("item_id", "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for i, text in rows.toLocalIterator():
        if blocks[-1] and size + len(text) > block:
            blocks.append([])
            size = 0
        blocks[-1].append((i, text))
        size += len(text)
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")

    def run(part: tuple[tuple[int, str], ...]):
        shared = documents.sparkSession.sparkContext.broadcast(part)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            prepared, automaton = _prepared(shared.value, share, edits)
            for df in batches:
                out = [(d, *x) for d, t in zip(df["doc_id"], df["text"]) if len(automaton) for x in search(prepared, automaton, t)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "runs_held", "runs_near", "runs"])

        return texts.mapInPandas(scan, LEAKS)

    found = run(tuple(blocks[0]))
    for part in blocks[1:]:
        found = found.unionByName(run(tuple(part)))
    return found.distinct()


def exactly(found: DataFrame, share: float = 1 / 3) -> DataFrame:
    """The leaks of which the document holds ``share`` of the runs without any edit."""
    return found.where(F.col("runs_held") >= F.greatest(F.lit(1), F.ceil(F.col("runs") * share - 1e-9)))


def leaked_items(found: DataFrame) -> DataFrame:
    """Per leaked item the number of documents that hold it, and the largest share of it."""
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max(F.col("runs_held") / F.col("runs")).alias("most_held"))
