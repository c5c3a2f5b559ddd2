from __future__ import annotations

import random
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimloom.llm import siteline as S
from claimloom.llm.lookalike import looks

LINES = "dossier bigint, doc bigint, span_id string, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slipped(rng, text, slips):
    b = list(text)
    for _ in range(slips):
        k = rng.randrange(len(b))
        way = rng.randrange(3)
        b[k : k + (way != 1)] = [] if way == 0 and len(b) > 4 else [rng.choice("abz")]
    return "".join(b)


def lines_of(spark, texts):
    rows = [(1, 2, str(k), text) for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, LINES).repartition(4)


def test_lines_without_foreign_letters_need_no_python(spark, monkeypatch):
    monkeypatch.setattr(S, "looks", lambda text, bare: F.lit(None).cast("string"))
    lines = lines_of(spark, ["Page 3 – of 9\n© 2020 the­ory “x”\n  ​\n12 §\n", None])
    found = {(r.span_id, r.line_no): r.key for r in S.keyed_lines(lines).collect()}
    assert found == {("0", 1): "pageof", ("0", 2): "theoryx", ("0", 3): None, ("0", 4): "#", ("0", 5): None, ("1", None): None}


def test_keys_of_every_sign_are_those_of_its_form(spark):
    signs = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = [sep.join(f"{a}{ch}{b}" for ch in signs[k : k + 500] if ch != "\n") for k in range(0, len(signs), 500) for a, b, sep in (("", "", "\n"), ("Ae", "ó B", "\n"), ("K", "i", "\n"))]
    lines = lines_of(spark, texts)
    form = lines.select("span_id", F.posexplode(F.split(looks(F.col("text"), bare=True), "\n")).alias("pos", "line"))
    letters = F.regexp_replace(F.lower("line"), r"[^\p{L}]+", "")
    want = form.select("span_id", (F.col("pos") + 1).alias("line_no"), F.when(letters != "", letters).when(F.col("line").rlike(r"\S"), "#").alias("key"))
    got = S.keyed_lines(lines).select("span_id", "line_no", "key")
    assert want.count() > 400_000
    assert want.exceptAll(got).count() == got.exceptAll(want).count() == 0


def test_two_slips_as_counted_letter_by_letter():
    rng = random.Random(2)
    pairs = []
    for _ in range(3000):
        a = "".join(rng.choices("ab" if rng.random() < 0.5 else "abcdefgh", k=rng.choice([4, 5, 6, 9, 20, 60, 62, 63, 64])))
        b = slipped(rng, a, rng.randrange(5))
        pairs += [(a, b)] if abs(len(a) - len(b)) <= 2 and len(b) <= 64 else []
    (a, whole), (b, _) = (S._letters(pa.array(["x", None, *side]).slice(2)) for side in zip(*pairs))
    n_a, n_b = (np.array([len(x) for x in side], dtype=np.int32) for side in zip(*pairs))
    found = S.two_slips(a, n_a, b, n_b)
    assert whole.all() and found.tolist() == [distance(x, y) <= 2 for x, y in pairs]
    assert 500 < found.sum() < len(found) - 300
    assert S._letters(pa.array(["é", "a" * 65, None, "abc", ""]))[1].tolist() == [False, False, False, True, False]


def test_counts_compare_alike_as_columns_and_arrays(spark):
    rng = random.Random(4)
    keys = ["".join(rng.choices("etaonsirldxy", k=rng.choice([12, 63, 65]))) for _ in range(150)]
    keys += [slipped(rng, key, 2) for key in keys]
    rows = spark.createDataFrame([(k, key) for k, key in enumerate(keys)], "k int, key string").withColumn("counts", S._counts(F.col("key")))
    counts = np.array([r.counts for r in rows.orderBy("k").collect()])
    both = rows.alias("a").crossJoin(rows.alias("b")).select("a.k", F.col("b.k").alias("o"), S._may_be_near(F.col("a.counts"), F.col("b.counts")).alias("near"))
    want = {(r.k, r.o) for r in both.where("near").collect()}
    a, b = np.divmod(np.arange(len(keys) ** 2), len(keys))
    near = S.may_be_near(counts[a], counts[b])
    assert set(zip(a[near].tolist(), b[near].tolist())) == want
    assert {(k, k + 150) for k in range(150)} <= want and len(want) < len(keys) ** 2 / 2


def pair_rows():
    """Rows as the comparison gets them: some pieces with many rows, some with rows of one side only."""
    rng = random.Random(6)
    rows = []
    for piece in range(-6, 30):
        for k in range(rng.choice([1, 2, 5, 60])):
            n = rng.choice([4, 20, 21, 22, 25, 70, 71])
            is_offered = rng.random() < 0.6 and piece % 7 != 0
            text = "".join(rng.choices(rng.choice(["aaaab", "aaaab", "aaaaé"]), k=n)) if n <= S.SHORT else None
            rows.append((piece, k % 2, is_offered, n, 3 * (k % 2), text, None if is_offered else 9, None if is_offered else 100 * piece + k, None if is_offered else k, rng.choice([None, *range(5)]) if is_offered else None))
    return sorted(rows, key=lambda r: r[:4])


def test_rows_of_a_piece_meet_over_batches(monkeypatch):
    rows = pair_rows()
    names = ["piece", "salt", "is_offered", "n", "counts", "short", "dossier", "class_id", "weight", "id"]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 4]
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    want = set()
    for a in rows:
        for o in rows:
            if a[:2] == o[:2] and not a[2] and o[2] and abs(a[3] - o[3]) <= 2:
                texts = (a[5], o[5]) if a[5] and o[5] else (None, None)
                if a[5] and o[5] and min(a[3], o[3]) >= 6 and (a[5] + o[5]).isascii():
                    if distance(*texts) > 2:
                        continue
                    texts = (None, None)
                want.add((*a[6:9], o[9], *texts))
    assert len(want) > 200 and {x[3] for x in want} == {None, 0, 1, 2, 3, 4}
    for size, at_a_time in ((len(rows), 1 << 17), (7, 1 << 17), (1, 5), (50, 1)):
        monkeypatch.setattr(S, "PAIRS", at_a_time)
        batches = [whole.slice(k, size) for k in range(0, len(rows), size)]
        found = [tuple(r.values()) for b in S._pair_rows(iter([whole.slice(0, 0), *batches])) for r in b.to_pylist()]
        assert set(found) == want
        settled = [x for x in found if x[4] is None]
        assert len(settled) == len(set(settled))
