"""Problem 8: how demanding a document is to read, on the scale of its raters.

Gradient-boosted regression trees over distributions, per sentence, of length,
vocabulary, syntax and cohesion. The trees are fitted to a bounded sample of the
rated documents; each prediction used for calibration comes from trees that have
seen no document of its source. Raters whose ratings disagree with these
predictions count less; the grades' bounds are set where the predictions of
unseen sources separate the ratings best.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.lookalike import skeleton
from claimloom.sources.tables import small

# Words that open a dependent clause, and words that address the reader.
CLAUSE = set("although because before after considering if inasmuch insofar irrespective notwithstanding once provided since that unless until when whereas whether which while who".split())
ADDRESS = set("you your yours please".split())
# End of the fixed values.

WORD = re.compile(r"[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*")
VOWELS = re.compile(r"[aeiouyäöüéèáàíóúâêîôûåæø]+")
SENTENCE = re.compile(r"(?<=[.!?:;])\s+|\n+")
NUMBERS = re.compile(r"\d+")
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
MEASURES, EXTRA = 11, 6
N_FEATURES = MEASURES * (3 + len(QUANTILES)) + EXTRA
FOLDS = 5


def n_words(text: str) -> int:
    """Blank-separated strings with a letter or digit."""
    return sum(any(map(str.isalnum, w)) for w in text.split())


@lru_cache(maxsize=200_000)
def _word(word: str) -> tuple[str, int, int, int, int]:
    """The word in lower case, its letters, syllables, and whether it opens a clause or addresses the reader."""
    low = word.lower()
    return low, len(low), len(VOWELS.findall(low)) or 1, int(low in CLAUSE), int(low in ADDRESS)


def features(text: str) -> list[float]:
    """The distributions of ``text``; zeros if it has no words."""
    rows, cohesion, before, seen, total = [], [], set(), set(), 0
    for sentence in SENTENCE.split(text):
        found = WORD.findall(sentence)
        if not found:
            continue
        n = len(found)
        words, long, syllables, clause, address = zip(*map(_word, found))
        commas, numbers = sentence.count(","), len(NUMBERS.findall(sentence))
        rows.append((n, sum(long), sum(x >= 7 for x in long), sum(x >= 11 for x in long), max(long) * n, sum(syllables), sum(x >= 4 for x in syllables), commas, sum(clause), sum(address), numbers))
        now = {w for w, k in zip(words, long) if k > 3}
        shared = len(now & before)
        cohesion.append(shared / max(1, len(now) + len(before) - shared))
        before, total = now, total + n
        seen.update(words)
    if not rows:
        return [0.0] * N_FEATURES
    table = np.array(rows, dtype=float)
    n = table[:, 0].copy()
    table[:, 1:] /= n[:, None]
    ordered = np.sort(table, axis=0)
    place = np.array(QUANTILES) * (len(rows) - 1)
    low = place.astype(int)
    part = (place - low)[:, None]
    quantiles = ordered[low] * (1 - part) + ordered[np.minimum(low + 1, len(rows) - 1)] * part
    mean = table.mean(0)
    figures = [n @ table / total, mean, np.sqrt(((table - mean) ** 2).mean(0)), *quantiles]
    shared = np.array(cohesion)
    extra = [len(rows), total, len(seen) / total**0.8, shared.mean(), shared.std(), text.count("\n\n") / len(rows)]
    return [*np.concatenate(figures).tolist(), *map(float, extra)]


class Trees:
    """Gradient-boosted regression trees on binned features, squared error."""

    def __init__(self, n: int = 150, depth: int = 3, rate: float = 0.1, least: float = 5.0, bins: int = 32, share: float = 0.7) -> None:
        self.n, self.depth, self.rate, self.least, self.bins, self.share = n, depth, rate, least, bins, share

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        rng = np.random.default_rng(7)
        width, least = self.bins + 1, min(self.least, w.sum() / 8)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, width)[1:-1])) for j in range(x.shape[1])]
        binned = self._binned(x)
        codes = binned + np.arange(x.shape[1]) * width
        self.base, self.trees = float(np.average(y, weights=w)), []
        fitted = np.full(len(y), self.base)
        for _ in range(self.n):
            rest, drawn = y - fitted, rng.random(len(y)) < self.share
            splits, node = {}, np.ones(len(y), dtype=np.int64)
            for at in range(1, 2**self.depth):
                here = np.flatnonzero((node == at) & drawn)
                weight = w[here]
                if weight.sum() < 2 * least:
                    continue
                flat, pull = codes[here].ravel(), weight * rest[here]
                left = np.bincount(flat, np.repeat(weight, x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
                sums = np.bincount(flat, np.repeat(pull, x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
                right = weight.sum() - left
                gain = sums**2 / np.maximum(left, 1e-9) + (pull.sum() - sums) ** 2 / np.maximum(right, 1e-9)
                gain = np.where((left >= least) & (right >= least), gain - pull.sum() ** 2 / weight.sum(), 0)
                j, cut = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, cut] > 1e-9:
                    splits[at] = (int(j), int(cut))
                    inside = node == at
                    node[inside] = 2 * at + (binned[inside, j] > cut)
            leaves = np.zeros(2 ** (self.depth + 1))
            for at in np.unique(node):
                here = (node == at) & drawn
                leaves[at] = self.rate * (w[here] * rest[here]).sum() / (w[here].sum() + 1)
            fitted += leaves[node]
            self.trees.append((splits, leaves))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned, fitted = self._binned(x), np.full(len(x), self.base)
        for splits, leaves in self.trees:
            node = np.ones(len(x), dtype=np.int64)
            for at in sorted(splits):
                j, cut = splits[at]
                inside = node == at
                node[inside] = 2 * at + (binned[inside, j] > cut)
            fitted += leaves[node]
        return fitted


@dataclass
class Model:
    """Fitted trees, the grades' upper bounds, and what cross-validation by source gave."""

    trees: Trees
    grades: list[int]
    bounds: list[float]
    raters: dict[str, float]
    accuracy: float

    def level(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.grades)[np.searchsorted(self.bounds, self.trees.predict(x), side="left")]


def _folds(sources: list[str]) -> np.ndarray:
    """A fold per document, none of them sharing a source; by turns if there are too few sources."""
    sizes = pd.Series(sources).value_counts()
    if len(sizes) < FOLDS:
        return np.arange(len(sources)) % FOLDS
    load, of = [0] * FOLDS, {}
    for source in sorted(sizes.index, key=lambda s: (-sizes[s], s)):
        of[source] = k = int(np.argmin(load))
        load[k] += int(sizes[source])
    return np.array([of[s] for s in sources])


def _unseen(x: np.ndarray, y: np.ndarray, w: np.ndarray, folds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(y))
    for k in range(FOLDS):
        held = folds == k
        if held.any():
            out[held] = Trees().fit(x[~held], y[~held], w[~held]).predict(x[held]) if (~held).any() else y.mean()
    return out


def _bound(scores: np.ndarray, above: np.ndarray, w: np.ndarray, around: float) -> float:
    """The bound with the least weight on its wrong side; of equal ones the nearest to ``around``."""
    order = np.argsort(scores, kind="stable")
    s, a, w = scores[order], above[order], w[order]
    wrong = np.concatenate([[0], np.cumsum(w * a)]) + np.concatenate([[0], np.cumsum((w * ~a)[::-1])])[::-1]
    cuts = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    best = cuts[wrong <= wrong.min() + 1e-9]
    return float(best[np.argmin(abs(best - around))])


def train(rated: pd.DataFrame) -> Model:
    """A model from rows of doc_id, source, rater, reading_level, features."""
    rated = rated.sort_values(["doc_id", "rater", "reading_level"], kind="stable")
    ids, place = np.unique(rated["doc_id"], return_inverse=True)
    first = rated.groupby("doc_id", sort=True).first()
    x, folds = np.array(first["features"].tolist()), _folds(first["source"].tolist())
    level, raters = rated["reading_level"].to_numpy(dtype=float), rated["rater"].to_numpy()
    trust = dict.fromkeys(sorted(set(raters)), 1.0)
    for turn in range(2):
        w = np.array([trust[r] for r in raters])
        weight = np.bincount(place, w)
        if turn:
            best = pd.DataFrame({"k": place, "w": -w, "y": level}).sort_values(["k", "w", "y"], kind="stable").groupby("k").first()
            y = best["y"].to_numpy()
        else:
            y = np.bincount(place, w * level) / weight
        unseen = _unseen(x, y, weight, folds)
        if not turn:
            error = {r: float(np.mean((unseen[place[raters == r]] - level[raters == r]) ** 2)) for r in trust}
            trust = {r: (0.05 + min(error.values())) / (0.05 + e) for r, e in error.items()}
    grades = sorted({int(v) for v in y})
    bounds = [_bound(unseen, y > g, weight, (g + h) / 2) for g, h in zip(grades, grades[1:])]
    bounds = list(np.maximum.accumulate(bounds)) if bounds else []
    given = np.array(grades)[np.searchsorted(bounds, unseen, side="left")]
    hit, agrees = given == y, {r: float(np.mean(given[place[raters == r]] == level[raters == r])) for r in trust}
    return Model(Trees().fit(x, y, weight), grades, bounds, agrees, float(np.average(hit, weights=weight)))


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        df["features"] = [features(skeleton(t)) for t in df["text"]]
        yield df[["doc_id", "source", "features"]]


def fit(documents: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model | None:
    """A model from the rated ``documents``, at most ``sample`` ratings; None without any.

    Beyond ``sample`` ratings those of the documents first in hash order count.
    Ratings without a level, or of documents unknown or without text, are left
    out; raters without a name are one rater. Of documents of one id that differ
    the first in order counts.
    """
    labels = labels.select("doc_id", F.coalesce("rater", F.lit("")).alias("rater"), "reading_level").where("doc_id is not null and reading_level is not null").distinct()
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "rater", "reading_level").limit(sample)
    rated = labels.toPandas()
    ids = documents.sparkSession.createDataFrame(rated[["doc_id"]].drop_duplicates(), labels.select("doc_id").schema)
    texts = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").where("doc_id is not null and text is not null")
    texts = texts.join(small(ids, sample), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("source", "text")).alias("d")).select("doc_id", "d.*")
    described = texts.mapInPandas(_described, "doc_id bigint, source string, features array<double>").toPandas()
    rated = rated.merge(described, on="doc_id")
    return train(rated) if len(rated) else None


def levels(documents: DataFrame, labels: DataFrame, lang: str = "en", least_words: int = 30, sample: int = 20_000) -> DataFrame:
    """(doc_id, source, reading_level) of each document in ``lang`` of ``least_words`` words or more.

    Documents of null id, lang or text get no level, those of null source do; equal
    texts get equal levels; equal repeated rows count once. Without any rating
    no document gets a level.
    """
    model = fit(documents, labels, sample)
    texts = documents.where(F.col("lang") == lang).select("doc_id", "source", "text").where("doc_id is not null and text is not null" if model else "false")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            text = df["text"].map(skeleton)
            enough = text.map(n_words) >= least_words
            df = df[enough]
            if len(df):
                grades = shared.value.level(np.array([features(t) for t in text[enough]]))
                yield pd.DataFrame({"doc_id": df["doc_id"], "source": df["source"], "reading_level": grades.astype(np.int32)})

    return texts.mapInPandas(score, "doc_id bigint, source string, reading_level int").distinct()
