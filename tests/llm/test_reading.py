from __future__ import annotations

import numpy as np
import pandas as pd

from claimloom.llm import reading as R

EASY = "Keep the {} dry. Ask the nurse how to hold the {}. You may eat and rest. "
HARD = "Notwithstanding the representativeness of methodologically heterogeneous determinants, the hierarchical specification of {} undermines the interpretability of {}, inasmuch as imputation assumptions presuppose comparability. "


def corpus(n=60):
    rows = []
    for k in range(n):
        easy = k % 2 == 0
        body = (EASY if easy else HARD).format(f"thing{chr(97 + k % 26)}", "clip") * 3
        rows.append((k, f"source{k % 7}", "en", body, 1 if easy else 4))
    return rows


def test_trees_learn_a_step_and_are_deterministic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = np.where(x[:, 2] > 0.3, 3.0, 1.0)
    a, b = (R.Trees().fit(x[:400], y[:400], np.ones(400)).predict(x[400:]) for _ in "ab")
    assert (a == b).all() and np.mean(abs(a - y[400:])) < 0.15


def test_folds_share_no_source():
    sources = ["a"] * 30 + ["b"] * 5 + list("cdefgh") * 4
    folds = R._folds(sources)
    assert all(len({int(f) for f, s in zip(folds, sources) if s == name}) == 1 for name in set(sources)) and len(set(folds)) == R.FOLDS


def test_bound_is_the_best_cut():
    scores, above = np.array([1.0, 1.2, 1.9, 2.1, 3.0]), np.array([False, False, False, True, True])
    assert 1.9 < R._bound(scores, above, np.ones(5), 2.0) < 2.1


def test_unreliable_raters_count_less():
    rows = []
    for k, source, _, text, level in corpus():
        rows.append((k, source, "good", level, R.features(text)))
        if k % 3 == 0:
            rows.append((k, source, "bad", 5 - level, R.features(text)))
    model = R.train(pd.DataFrame(rows, columns=["doc_id", "source", "rater", "reading_level", "features"]))
    assert model.raters["good"] > 0.9 > 0.1 > model.raters["bad"] and model.accuracy > 0.95


def test_levels_and_edges(spark):
    rows = corpus()
    labels = [(k, level, "r") for k, _, _, _, level in rows[:40]] + [(999, 1, "r"), (None, 1, "r"), (3, None, "r"), (0, 1, None)]
    extra = [(100, None, "en", rows[0][3]), (101, "s", None, rows[0][3]), (102, "s", "de", rows[0][3]), (103, "s", "en", "too short"), (104, "s", "en", None), (105, "s", "en", "12 " * 40), (None, "s", "en", HARD), (106, "s", "en", HARD * 2000), (100, None, "en", rows[0][3])]
    documents = spark.createDataFrame([r[:4] for r in rows] + extra, "doc_id bigint, source string, lang string, text string").withColumn("reading_level", R.F.lit("clash"))
    labels = spark.createDataFrame(labels, "doc_id bigint, reading_level int, rater string")
    found = {r.doc_id: r.reading_level for r in R.levels(documents, labels).collect()}
    assert found.keys() == {*range(60), 100, 105, 106} and found[100] == 1 and found[106] == 4
    assert all(found[k] == level for k, _, _, _, level in rows)
    assert R.levels(documents, labels.limit(0)).count() == 0 and R.levels(documents.limit(0), labels).count() == 0
    assert R.fit(documents, labels, sample=10).accuracy >= 0


def test_held_out_accuracy_on_real_ratings(spark):
    data = "/root/testdata/sf0.1"
    model = R.fit(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/reading_labels.parquet"))
    assert model.accuracy > 0.95 and model.grades == [1, 2, 3, 4]
