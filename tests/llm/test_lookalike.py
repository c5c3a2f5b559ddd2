from __future__ import annotations

import itertools
import unicodedata

from claimloom.llm import lookalike as L

SPANS = "span_id string, text string, extra int"


def test_one_form_settles_the_look_and_nothing_else():
    same = [
        ("verbatim", "vеrbаtіm", "ｖｅｒｂａｔｉｍ", "ver​batim", "νerbatim", "‎verb‏‎atim"),
        ("naïve façade", "naïve façade", "naïve façade", "naïve façade"),
        ("first-in-man office", "ﬁrst‐in‑man oﬃce", "first－in-man office"),
    ]
    for texts in same:
        assert {L.one_form(t) for t in texts} == {texts[0]}
        assert len({L.skeleton(t) for t in texts}) == 1
    for a, b in [("Case", "case"), ("m²", "m2"), ("½", "1/2"), ("resume", "résumé"), ("a.b", "a,b"), ("1", "l"), ("–", "-"), ("a b", "a  b")]:
        assert L.one_form(a) != L.one_form(b)


def test_tokens_take_the_script_that_fits():
    assert L.one_form("Перед использованием прочтите раздел") == "Перед использованием прочтите раздел"
    assert L.one_form("Перед иcпoльзoвaниeм") == "Перед использованием"  # Latin letters inside a Cyrillic word
    assert L.one_form("он и она а также") == L.one_form("oн и oнa a тaкжe")
    assert L.one_form("режим all работы") == "режим all работы"
    assert L.one_form("τον έλεγχο ο χρήστης") == "τον έλεγχο ο χρήστης"


def test_forms_depend_on_the_look_only():
    spelt = L._tables()[1]
    for text in ("Copper coxae oath", "раса сосна мир", "νόσος ο αορτή", "A o p"):
        letters = list(unicodedata.normalize("NFD", text))
        choices = [sorted(set(spelt[c].values())) if c in spelt else [c] for c in letters]
        made = {L.one_form("".join(x)) for x in itertools.islice(itertools.product(*choices), 3000)}
        assert len(made) == 1


def brute(rows):
    rows = {(k, t) for k, t, *_ in rows if k is not None and t is not None}
    return {(a, b) for a, t in rows for b, u in rows if a < b and t != u and L.one_form(t) == L.one_form(u)}


def test_pairs_against_brute_force(spark, sf_dir):
    rows = [("s1", "abc", 1), ("s1", "abc", 2), ("s2", "аbc", 1), ("s3", "abc", 1), ("s4", None, 1), (None, "abc", 1), ("s5", "", 1), ("s6", "​", 1), ("s7", "x" * 200_000, 1), ("s8", "x" * 199_999 + "х", 1)]
    found = L.same_look_pairs(spark.createDataFrame(rows, SPANS), "span_id", "text").collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows)) == [("s1", "s2"), ("s2", "s3"), ("s5", "s6"), ("s7", "s8")]
    rows = [(r.span_id, r.text) for r in spark.read.parquet(f"{sf_dir}/spans.parquet").select("span_id", "text").collect()]
    found = L.same_look_pairs(spark.read.parquet(f"{sf_dir}/spans.parquet"), "span_id", "text").collect()
    by = {}
    for k, t in {r for r in rows if r[1] is not None}:
        by.setdefault(L.one_form(t), []).append((k, t))
    assert sorted(map(tuple, found)) == sorted({(a, b) for g in by.values() for a, t in g for b, u in g if a < b and t != u})


def test_empty_tables_and_clashing_columns(spark):
    assert L.same_look_pairs(spark.createDataFrame([], SPANS), "span_id", "text").count() == 0
    clash = spark.createDataFrame([("a", "o", 1, 1), ("b", "о", 1, 1)], "k string, t string, look int, spelling int")
    assert L.same_look_pairs(clash, "k", "t").count() == 1


def test_words(spark):
    rows = [("a", "verbatim"), ("b", "vеrbatim "), ("c", None), ("d", "other"), ("e", "Verbatim"), ("f", "whitespaсe_normalised"), ("b", "vеrbatim ")]
    found = L.meant_words(spark.createDataFrame(rows, "anchor_id string, w string"), "anchor_id", "w").collect()
    assert sorted(map(tuple, found)) == [("b", "verbatim"), ("f", "whitespace_normalised")]


def test_normalise_keeps_nulls_and_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "аbc"), (3, "аbc")], "id int, text string")
    assert sorted((r.id, r.text) for r in L.normalise(df, "text").collect() if r.text) == [(3, "abc"), (3, "abc")]


def test_a_hot_look_is_split_without_loss(spark, monkeypatch):
    texts = ["Dose", "Dоse", "Dose ", "dose", "Dos\u00ade"]
    rows = [(f"k{n:02}", texts[n % 5]) for n in range(40)] + [("x", "other")]
    df = spark.createDataFrame(rows, "k string, t string")
    pairs = lambda: sorted(map(tuple, L.same_look_pairs(df, "k", "t").collect()))
    whole = pairs()
    assert whole == sorted((a, b) for a, s in rows for b, t in rows if a < b and s != t and L.one_form(s) == L.one_form(t)) and len(whole) > 100
    monkeypatch.setattr(L, "SPLIT", 3)
    assert pairs() == whole
