from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np

from claimloom.llm import siteline as S
from claimloom.llm.lookalike import skeleton

SPANS = "span_id string, document_id string, location_kind string, text string"
DOCS = "document_id string, dossier_id string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def key(line):
    letters = "".join(c for c in skeleton(line).lower() if c.isalpha())
    return letters or ("#" if line.strip() else None)


def brute(spans, documents, share=0.25, least=5):
    of, keys, docs = dict(documents), defaultdict(lambda: defaultdict(set)), defaultdict(set)
    lines = []
    for s, d, kind, text in set(spans):
        if kind in S.KINDS and of.get(d):
            docs[of[d]].add(d)
            for i, line in enumerate((text or "").split("\n") if text is not None else [], 1):
                if key(line):
                    keys[of[d]][key(line)].add(d)
                    lines.append((of[d], s, i, key(line)))
    gone = defaultdict(set)
    for dossier, found in keys.items():
        needed = max(least, -(-len(docs[dossier]) * share // 1))

        def around(centres):
            out = set()
            for centre in centres:
                near = {k for k in found if k == centre or min(len(k), len(centre)) >= 4 and abs(len(k) - len(centre)) <= 2 and distance(k, centre) <= (2 if min(len(k), len(centre)) >= 6 else 1)}
                if len(set().union(*(found[k] for k in near))) >= needed:
                    out |= near
            return out

        gone[dossier] = around(k for k, at in found.items() if len(at) >= max(2, needed * S.CENTRE))
        gone[dossier] |= around(k for k in found if len(k) >= 4 and k not in gone[dossier])
    return {(s, i) for dossier, s, i, k in lines if k in gone[dossier] and s is not None}


def dossier(seed=3):
    rng = random.Random(seed)
    footer = ["Page 3 of 9", "Confidential - property of Harnoss Devices", "Printed copies are not controlled"]
    spans, documents = [], []
    for d in range(24):
        documents.append((f"d{d}", "big" if d < 18 else "small"))
        for p in range(3):
            lines = [f"Body sentence {rng.choice('abcdefgh') * 9} number {rng.random()} of its own kind {d} {p} {''.join(rng.choices('qwertyuiopasdf', k=25))}"]
            for f in footer:
                if rng.random() < 0.6:
                    f = f.upper() if rng.random() < 0.2 else f
                    letters = list(f)
                    for _ in range(rng.choice([0, 0, 0, 1, 2])):
                        letters[rng.randrange(len(letters))] = rng.choice("oclh1")
                    lines.append("".join(letters) + " *" * rng.randrange(2))
            spans.append((f"s{d}_{p}", f"d{d}", rng.choice(["page", "paragraph"]), "\n".join(lines)))
    spans += [("cell", "d1", "table_cell", footer[1]), ("none", "d2", "page", None), ("lost", "dx", "page", footer[1]), ("blank", "d3", "page", "\n\n"), (None, "d4", "page", footer[1]), ("nokind", "d5", None, footer[1]), ("nodoc", None, "page", footer[1]), spans[0]]
    return spans, documents


def test_against_brute_force(spark):
    spans, documents = dossier()
    found = S.repeated_lines(spark.createDataFrame(spans, SPANS), spark.createDataFrame(documents, DOCS)).collect()
    rows = [tuple(r) for r in found]
    assert len(rows) == len(set(rows)) > 50
    assert set(rows) == brute(spans, documents)


NOTICE = "The local safety notice of the lower plant applies"


def misread(n):
    return NOTICE[:n] + "x" + NOTICE[n + 1 :]


def test_a_line_of_rare_spellings_only(spark):
    body = [f"Report {w * 5} about {w[::-1] * 4} of its own" for w in ("abcde", "fghij", "klmno", "pqrst", "uvwxy", "badce", "zyxwa", "efgcd", "hjikl", "nmopq", "srtuv", "wvyzx", "bdfhj", "acegi", "kmoqs", "lnprt", "uwyac", "vxzbd", "cfilo", "dgjmp")]
    lines = [NOTICE, *map(misread, (4, 10, 17, 24))]
    spans = [(f"s{d}", f"d{d}", "page", body[d] + ("\n" + lines[d] if d < len(lines) else "")) for d in range(20)]
    documents = spark.createDataFrame([(f"d{d}", "x") for d in range(20)], DOCS)
    found = S.repeated_lines(spark.createDataFrame(spans, SPANS), documents).collect()
    assert sorted(tuple(r) for r in found) == [(f"s{d}", 2) for d in range(5)]
    fewer = [x if x[0] != "s3" else (*x[:3], body[3]) for x in spans]
    assert S.repeated_lines(spark.createDataFrame(fewer, SPANS), documents).count() == 0


def test_a_clean_spelling_below_the_bar_takes_its_misreadings(spark):
    places = [k for k, ch in enumerate(NOTICE) if ch.isalpha() and ch != "x"]
    twice = [NOTICE[:a] + "q" + NOTICE[a + 1 : b] + "j" + NOTICE[b + 1 :] for a, b in zip(places[:18], places[20:38])]
    lines = [NOTICE] * 2 + twice
    spans = [(f"s{d}", f"d{d}", "page", lines[d] if d < 20 else None) for d in range(80)]
    spans += [(f"other{d}", f"d{d}", "page", "The local safety notice of the upper stand applies") for d in range(3)]
    found = S.repeated_lines(spark.createDataFrame(spans, SPANS), spark.createDataFrame([(f"d{d}", "x") for d in range(80)], DOCS)).collect()
    assert sorted(tuple(r) for r in found) == sorted((f"s{d}", 1) for d in range(20))


def test_digit_lines_are_one_class_and_long_lines_pass(spark):
    spans = [(f"s{d}", f"d{d}", "page", f"{d}{d}\n" + "word " * 3000 + str(d)) for d in range(8)]
    found = S.repeated_lines(spark.createDataFrame(spans, SPANS), spark.createDataFrame([(f"d{d}", "x") for d in range(8)], DOCS)).collect()
    assert {tuple(r) for r in found} == {(f"s{d}", i) for d in range(8) for i in (1, 2)}


def test_empty_tables(spark):
    spans, documents = spark.createDataFrame([], SPANS), spark.createDataFrame([], DOCS)
    assert S.repeated_lines(spans, documents).count() == 0


def test_suffixes_and_common_prefixes():
    rng = np.random.default_rng(1)
    rows, lines, ids = np.sort(rng.integers(0, 9, 60)), np.arange(60), rng.integers(1, 4, 60)
    lines = lines + np.cumsum(rng.random(60) < 0.1)  # some lines have no identifier
    columns = S.suffixes(rows, lines, ids, 4)
    for i in range(60):
        run = [int(ids[i])]
        while len(run) < 4 and i + len(run) < 60 and rows[i + len(run)] == rows[i] and lines[i + len(run)] == lines[i] + len(run):
            run.append(int(ids[i + len(run)]))
        assert columns[:, i].tolist() == run + [0] * (4 - len(run))
    columns = columns[:, np.lexsort(columns[::-1])]
    for i, n in enumerate(S.common_prefixes(columns)[1:], 1):
        a, b = (c[c != 0].tolist() for c in (columns[:, i - 1], columns[:, i]))
        assert n == next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)


def test_a_line_of_two_classes_begins_two_suffixes():
    columns = S.suffixes(np.array([0, 0, 0]), np.array([1, 1, 2]), np.array([7, 8, 9]), 2)
    assert columns.T.tolist() == [[7, 9], [8, 9], [9, 0]]


def block_spans():
    """Twelve documents: a pair of lines in nine of them, its first line also alone, a lone line in ten."""
    out = []
    for d in range(12):
        body = "".join(chr(97 + (d * 7 + k * 5) % 26) for k in range(30))
        pair = ["Printed copies are not controlled", "Ask the register before use"] if d < 9 else ["Printed copies are not controlled"]
        out.append((f"s{d}", f"d{d}", "page", "\n".join([*pair, body, *(["Prepared by the device group"] if d > 1 else [])])))
    return out


def test_the_suffix_array_decides(spark, monkeypatch):
    spans, documents = spark.createDataFrame(block_spans(), SPANS), spark.createDataFrame([(f"d{d}", "x") for d in range(12)], DOCS)
    one = {tuple(r) for r in S.repeated_lines(spans, documents).collect()}
    assert one == brute(block_spans(), [(f"d{d}", "x") for d in range(12)])
    two = {tuple(r) for r in S.repeated_lines(spans, documents, shortest=2).collect()}
    assert two == {(f"s{d}", n) for d in range(9) for n in (1, 2)}
    monkeypatch.setattr(S, "suffixes", lambda rows, lines, ids, longest: np.zeros((longest, len(ids)), dtype=np.int64))
    assert S.repeated_lines(spans, documents).count() == 0


def test_the_same_without_broadcasts(spark, monkeypatch):
    spans, documents = dossier(5)
    monkeypatch.setattr(S, "small", lambda df, *_: df)
    monkeypatch.setattr(S, "SPLIT", 3)
    found = S.repeated_lines(spark.createDataFrame(spans, SPANS), spark.createDataFrame(documents, DOCS)).collect()
    assert {tuple(r) for r in found} == brute(spans, documents)


def test_without_lines(spark):
    spans = spark.createDataFrame([("a", "x\ny\nz"), ("b", "x"), ("c", None)], "span_id string, text string")
    found = spark.createDataFrame([("a", 2), ("b", 1)], "span_id string, line_no int")
    assert {r.span_id: r.text for r in S.without_lines(spans, found).collect()} == {"a": "x\nz", "b": "", "c": None}


def test_real_lines_keep_no_near_copy(spark, sf_dir):
    spans, documents = spark.read.parquet(f"{sf_dir}/spans.parquet"), spark.read.parquet(f"{sf_dir}/dossier_documents.parquet")
    found = {tuple(r) for r in S.repeated_lines(spans, documents).collect()}
    rows = [tuple(r) for r in spans.select("span_id", "document_id", "location_kind", "text").collect()]
    assert found == brute(rows, [tuple(r) for r in documents.select("document_id", "dossier_id").collect()])
    assert all(re.search(r"\S", next(r[3] for r in rows if r[0] == s).split("\n")[i - 1]) for s, i in list(found)[:50])
