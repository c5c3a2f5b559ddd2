from __future__ import annotations

import random

import pytest

from claimloom.llm import leakage as L

ITEM = "With 336 users enrolled by October, arm 4 reported sensor drift 28 times, arm 7 never; hospital 173 returned 27 sets."


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_myers_against_the_full_table():
    rng = random.Random(2)
    for _ in range(60):
        patterns = ["".join(rng.choices("abc", k=rng.randrange(1, 70))) for _ in range(rng.randrange(1, 9))]
        text = "".join(rng.choices("abcd", k=rng.randrange(120)))
        for most in (0, 2, 5):
            assert L.Myers(patterns, most).within(text) == [distance(p, text) <= most for p in patterns]


def test_letters_are_those_of_the_words():
    for text in (ITEM, "A_b-c\t1\n", "ÄÖ_ü ß x", "", None, "".join(map(chr, range(128)))):
        assert L.letters_of(text) == "".join(L.words(text))


def held(item, text):
    w, d = L.words(item), L.words(text)
    runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    have = {tuple(d[k : k + 5]) for k in range(len(d) - 4)}
    return sum(r in have for r in runs), len(runs)


def test_against_brute_force(spark):
    rng = random.Random(5)
    filler = [f"filler{k}" for k in range(50)]
    items = [(k, " ".join(rng.choices([f"w{j}" for j in range(40)], k=rng.randrange(12, 60)))) for k in range(12)]
    docs = []
    for d in range(120):
        words = L.words(rng.choice(items)[1])
        a = rng.randrange(len(words))
        part = words[a : a + rng.randrange(1, len(words))]
        part = [rng.choice(filler) if rng.random() < 0.08 else w for w in part]
        if rng.random() < 0.3:
            part = part[len(part) // 2 :] + rng.choices(filler, k=30) + part[: len(part) // 2]
        text = " ".join(rng.choices(filler, k=20) + part + rng.choices(filler, k=20))
        docs.append((d, text.upper() if rng.random() < 0.2 else text))
    found = L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    truth = {(d, i) for d, t in docs for i, x in items if 3 * held(x, t)[0] >= held(x, t)[1]}
    assert {(r.doc_id, r.item_id) for r in L.exactly(found).collect()} == truth and truth
    rows = {(r.doc_id, r.item_id): (r.runs_held, r.runs_near, r.runs) for r in found.collect()}
    assert set(rows) >= truth and all(rows[d, i][0] == held(dict(items)[i], dict(docs)[d])[0] for d, i in rows)
    for d, text in docs:
        letters = "".join(L.words(text))
        for i, x in items:
            w = L.words(x)
            runs = ["".join(w[k : k + 5]) for k in range(len(w) - 4)]
            near = sum(distance(r, letters) <= 2 for r in runs)
            item = L.Item(i, x, 1 / 3, 2)
            enough = sum(n for p, n in item.pieces.items() if p in letters) >= item.whole
            assert ((d, i) in rows) == (enough and 3 * near >= len(runs)) and ((d, i) not in rows or rows[d, i][1] == near)


def test_an_edited_passage_is_verified_by_myers(spark, monkeypatch):
    w = [f"sensor{chr(97 + k)}drift" for k in range(20)]
    edited = [x[:3] + "z" + x[4:] if k in (8, 13, 18) else x for k, x in enumerate(w)]
    docs = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join("qqq" + x if k > 7 else x for k, x in enumerate(w)))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(w))], "item_id bigint, text string")
    assert [tuple(r) for r in L.leaks(docs, items).collect()] == [(1, 1, 4, 16, 16)]
    assert L.exactly(L.leaks(docs, items)).count() == 0
    assert [x[:3] for x in L.search(*L._prepared(((1, " ".join(w)),), 1 / 3, 2), " ".join(w))] == [(1, 16, 16)]
    monkeypatch.setattr(L.Myers, "within", lambda self, text: [False] * len(self.lanes))
    assert not list(L.search(*L._prepared(((1, " ".join(w)),), 1 / 3, 2), " ".join(w)))


def test_a_piece_that_stands_often_counts_for_all_its_runs(spark):
    item = " ".join(f"serial sensor drift a{k} b{k} c{k}" for k in range(6))
    scattered = " filler ".join(f"b{k} c{k} serial sensor drift a{k + 1} b{k + 1}" for k in range(4))
    docs = [(1, scattered), (2, scattered.rsplit(" filler ", 1)[0]), (3, "serial sensor drift " * 9)]
    found = L.exactly(L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string"))).collect()
    assert [held(item, t) for _, t in docs] == [(12, 32), (9, 32), (0, 32)] and [r.doc_id for r in found] == [1]


@pytest.mark.parametrize("share", [1 / 3, 0.5])
def test_every_passage_of_the_runs_needed_is_verified(spark, sf_dir, share):
    for row in spark.read.parquet(f"{sf_dir}/eval_items.parquet").collect():
        item, found = L.Item(row.item_id, row.text, share, 2), L.words(row.text)
        assert sum(item.pieces.values()) == len(item.runs) - item.needed + item.whole
        for k in range(len(item.runs) - item.needed + 1):
            letters = "".join(found[k : k + item.needed + L.RUN - 1])
            assert sum(n for x, n in item.pieces.items() if x in letters) >= item.whole


@pytest.mark.parametrize("block", [20_000_000, 1])
def test_look_case_spacing_and_edges(spark, block):
    docs = [
        (1, ITEM), (2, ITEM.upper().replace(",", " - ").replace(" ", "  ")), (3, ITEM.replace("o", "о").replace("a", "а​")), (4, ITEM.replace("336", "３３６")),
        (5, "unrelated text"), (6, None), (None, ITEM), (7, ""), (8, "x " * 100_000 + ITEM), (9, ITEM.replace("28", "281").replace("7", "75").replace("336", "3361").replace("4", "41").replace("reported", "noted")), (1, ITEM),
    ]
    items = [(10, ITEM), (10, ITEM), (11, None), (12, ""), (13, "only three words"), (None, ITEM)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", L.F.lit(1))
    found = L.exactly(L.leaks(documents, spark.createDataFrame(items, "item_id bigint, text string"), block=block)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, 10) for d in (1, 2, 3, 4, 8)}
    assert held(ITEM, docs[9][1])[0] * 3 < held(ITEM, docs[9][1])[1]  # longer numbers are other words
    assert all(r.runs_held == r.runs_near == r.runs for r in found)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert L.leaks(docs, items).count() == 0
    assert L.leaks(spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string"), items.limit(0)).count() == 0


def test_sql(against_sql):
    from claimloom.llm import queries

    sql = queries.oracle_sql()
    for name in sql:
        against_sql(queries.queries()[name], sql[name])
