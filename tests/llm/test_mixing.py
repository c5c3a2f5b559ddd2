from __future__ import annotations

import os

import pytest

from claimloom.llm import mixing as M

COUNTS = "doc_id bigint, source string, n_tokens bigint"
TARGETS = "source string, target_share double, max_repeats int"


def test_shares_and_caps(spark):
    counts = [(k, "large", 100) for k in range(4000)] + [(k, "small", 100) for k in range(4000, 4300)] + [(9, None, 5), (10, "other", 5), (11, "empty", 0)]
    targets = [("large", 0.5, 1), ("small", 0.3, 4), ("gone", 0.1, 2), ("empty", 0.1, 2)]
    mixed, report = M.mix(spark.createDataFrame(counts, COUNTS), spark.createDataFrame(targets, TARGETS))
    rows, shares = mixed.collect(), {r.source: r for r in report.collect()}
    assert shares["small"].rate == 4 and 0 < shares["large"].rate <= 1
    assert abs(shares["small"].reached_share - 0.375) < 0.02 and abs(shares["large"].reached_share - 0.625) < 0.02
    assert shares["gone"].n_copies == shares["empty"].n_copies == 0 and {r.source for r in rows} == {"large", "small"}
    assert len(rows) == len({(r.doc_id, r.copy_no) for r in rows}) == sum(r.n_copies for r in shares.values())
    assert max(r.copy_no for r in rows if r.source == "small") == 4 and sum(r.n_tokens for r in rows) == sum(r.n_tokens for r in shares.values())
    again = M.mix(spark.createDataFrame(counts[::-1], COUNTS), spark.createDataFrame(targets, TARGETS))[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_a_wanted_size_and_the_spread_to_expect(spark):
    counts = spark.createDataFrame([(k, "a" if k % 4 else "b", 50 + k % 100) for k in range(6000)], COUNTS)
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], TARGETS)
    reached = []
    for seed in range(12):
        rows = {r.source: r for r in M.mix(counts, targets, seed, wanted=200_000)[1].collect()}
        reached.append(rows["b"].reached_share)
        assert abs(sum(r.n_tokens for r in rows.values()) - 200_000) < 15_000
    mean = sum(reached) / len(reached)
    seen = (sum((x - mean) ** 2 for x in reached) / (len(reached) - 1)) ** 0.5
    assert abs(mean - 0.5) < 0.02 and 0.2 < seen / rows["b"].spread < 2.5
    sizes = spark.createDataFrame([("a", 100), ("b", 10)], "source string, n_tokens bigint")
    assert {r.source: r.rate for r in M.rates(sizes, targets, 1000).collect()} == {"a": 0.3, "b": 3.0}


def test_enough_of_everything_gives_the_whole(spark):
    counts = [(1, "a", 100), (2, "b", 100)]
    mixed, report = M.mix(spark.createDataFrame(counts, COUNTS), spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], TARGETS))
    assert mixed.count() == 2 and {r.reached_share for r in report.collect()} == {0.5}


def test_edges(spark):
    none = spark.createDataFrame([], COUNTS)
    targets = spark.createDataFrame([("a", 1.0, 2), (None, 0.0, 1), ("b", None, None), ("a", 1.0, 2)], TARGETS)
    mixed, report = M.mix(none, targets)
    assert mixed.count() == 0 and sorted((r.source, r.reached_share) for r in report.collect()) == [("a", 0.0), ("b", 0.0)]
    mixed, report = M.mix(spark.createDataFrame([(1, "a", 5)], COUNTS), targets.limit(0))
    assert mixed.count() == report.count() == 0


@pytest.mark.skipif(not os.path.exists(M.VOCABULARY), reason="no vocabulary here")
def test_tokens(spark):
    rows = [(1, "a", "The lot number is missing."), (None, "a", "x"), (2, "a", None), (3, None, ""), (4, "a", "<|endoftext|>")]
    found = {r.doc_id: r.n_tokens for r in M.token_counts(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()}
    assert found[1] == len(M._tokenizer(M.VOCABULARY).encode_ordinary(rows[0][2])) == 6 and found[2] == found[3] == 0 and found[4] > 1
    assert M._tokenizer(M.VOCABULARY).decode(M._tokenizer(M.VOCABULARY).encode_ordinary("naïve 12 mm²\n")) == "naïve 12 mm²\n"
