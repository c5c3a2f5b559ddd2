from __future__ import annotations

import pytest

from claimloom.llm import markup as M

HTML = """<html><head><style>p { margin: 1px; }</style></head>
<body>
<!-- page=1 -->
<h1 class="t">Scope <em>of</em> lot 1 &amp; more</h1>
<p>In <a href="https://x.example/y">prose</a> p &lt; 0.05<br/>
<div>Open text that never ends
<H2>Broken nesting</h3>
<ul>
<li>First <b>item</b>
<li>Second item</li>
<li>Third<ul><li>Inner</li></ul></li>
</ul>
<pre>for k in x:
    print(k &lt; 3)</pre>
The value follows from \\[a_{1} &lt; b\\] for each lot.
<table><tr><td>cell</td></tr></table>
<script>load(1);</script>
</body></html>"""
MARKDOWN = """# Title with `code` and **bold** ##

Setext _title_
--------------

Text with a_1_b, x <- y, $163 and $441, 5 * 3 and {554}; see [here](https://x.example).

* Item __one__
  continued
1. Item \\*two\\*

- outer
  - inner

```text
# no heading
* no item $x$
```

Read:

    indented <b>code</b>

~~~
tilde
~~~

Sum $\\sqrt{a}$, \\(b\\) and $$
c + d
$$ done.

| a | b |
|---|---|
| 1 | 2 |
"""
LATEX = """\\documentclass{article}
\\begin{document}
\\section*{Results \\textbf{of} lot 7 \\& more}
Share 50\\% of it.~\\cite{k1} See \\href{https://x.example}{this}. % comment
\\begin{itemize}
  \\item {\\bf First} item
  \\item Second
  \\begin{enumerate}
    \\item Inner
  \\end{enumerate}
\\end{itemize}
\\begin{verbatim}
# keep \\item
\\end{verbatim}
\\begin{equation}
x_{1} = 2
\\end{equation}
\\begin{tabular}{ll} 1 & 2 \\\\ \\end{tabular}"""
WIKI = """== Heading ''with'' [[Page 5|link]] ==
Prose.{{check|date=2020}}<ref>note</ref> Score {5}, [3].
* One '''bold'''
** Two [https://x.example/a text]
# Three <small>s</small>
<syntaxhighlight lang="text"><device id="1">
  * x
</device></syntaxhighlight>
The value <math>\\frac{a}{b}</math> holds.
{| class="t"
| cell
|}
=== Uneven ==="""


def test_html():
    assert M.parts(HTML) == [
        ("heading", "Scope of lot 1 & more"), ("heading", "Broken nesting"), ("list_item", "First item"), ("list_item", "Second item"),
        ("list_item", "Third"), ("list_item", "Inner"), ("code_block", "for k in x: print(k < 3)"), ("formula", "a_{1} < b"),
    ]


def test_markdown():
    assert M.parts(MARKDOWN) == [
        ("heading", "Title with code and bold"), ("heading", "Setext title"), ("list_item", "Item one continued"), ("list_item", "Item *two*"),
        ("list_item", "outer"), ("list_item", "inner"), ("code_block", "# no heading * no item $x$"), ("code_block", "indented <b>code</b>"),
        ("code_block", "tilde"), ("formula", "\\sqrt{a}"), ("formula", "b"), ("formula", "c + d"),
    ]


def test_latex():
    assert M.parts(LATEX) == [
        ("heading", "Results of lot 7 & more"), ("list_item", "First item"), ("list_item", "Second"), ("list_item", "Inner"),
        ("code_block", "# keep \\item"), ("formula", "x_{1} = 2"),
    ]


def test_wiki():
    assert M.parts(WIKI) == [
        ("heading", "Heading with link"), ("list_item", "One bold"), ("list_item", "Two text"), ("list_item", "Three s"),
        ("code_block", '<device id="1"> * x </device>'), ("formula", "\\frac{a}{b}"), ("heading", "Uneven"),
    ]


def test_wiki_templates_of_any_depth():
    nested = "{{a|" * 9 + "x\n== No heading ==\n* no item\n" + "}}" * 9
    assert M.parts("== Real ==\n" + nested + "\nProse {5}.") == [("heading", "Real")]
    assert M.clean("== Real ==\n" + nested + "Prose {5} and {{open.") == "## Real\n\nProse {5} and {{open."
    assert M.clean("== Real ==\nProse." + "{{a|" * 50_000 + "}}" * 50_000) == "## Real\n\nProse."


def test_clean_text_keeps_structure():
    text = M.clean(MARKDOWN)
    assert "# Title with code and bold" in text and "- Item one continued" in text and "```\n# no heading\n* no item $x$\n```" in text
    assert "$\\sqrt{a}$" in text and "a_1_b, x <- y, $163 and $441, 5 * 3 and {554}; see here." in text
    assert M.clean(None) is None and M.clean("") == ""
    assert "margin" not in M.clean(HTML) and "load(1)" not in M.clean(HTML) and "p < 0.05" in M.clean(HTML)


def test_density_takes_the_body_and_leaves_link_lists():
    links = "".join(f'<li><a href="x">go to page {k} of this site</a></li>' for k in range(30))
    body = "".join(f"<p>{'Plain running text of the article goes on here for a while. ' * 6}</p>" for _ in range(8))
    root, _ = M.tree(f"<html><body><div><ul>{links}</ul></div><div><h1>Title</h1>{body}<ul><li>kept item</li></ul></div></body></html>")
    kept = " ".join(n.text() for n in M.content(root))
    assert "Plain running text" in kept and "kept item" in kept and "go to page" not in kept


def test_structure_beside_the_body_path_is_kept_in_order():
    body = "".join(f"<p>{'Plain running text of the article goes on. ' * 9}</p>" for _ in range(8))
    page = f"<html><body><p>See \\(x_1\\).</p><h2>First</h2><div>{body}<h2>Second</h2></div><ul><li>last</li></ul></body></html>"
    assert M.parts(page) == [("formula", "x_1"), ("heading", "First"), ("heading", "Second"), ("list_item", "last")]
    assert M.clean(page).index("# First") < M.clean(page).index("Plain") < M.clean(page).index("## Second") < M.clean(page).index("- last")


def test_loose_text_beside_the_body_path_is_rated():
    body = "".join(f"<p>{'Plain running text of the article goes on. ' * 9}</p>" for _ in range(8))
    lead = "The lead <em>itself</em> says in one <b>whole</b> sentence of prose, long enough to count, what this article is about. " * 3
    menu = "".join(f'<a href="x">go to page {k}</a> ' for k in range(30))
    text = M.clean(f"<html><body>{lead}<br><div>{body}</div>{menu}</body></html>")
    assert " ".join(text.split("\n\n")[0].split()).startswith("The lead itself says in one whole sentence") and "Plain" in text and "go to page" not in text
    assert "Lead in." in M.clean(f"<body><section>Lead in. {'Some more of this prose. ' * 40}<div>{body}</div></section></body>")
    items = "".join(f"\\item {'A long item that goes on for quite a while here. ' * 9}\n" for _ in range(9))
    latex = M.clean("\\begin{document}\n\\section{First}\n" + "Prose right after the heading. " * 40 + "\n\\begin{itemize}\n" + items + "\\end{itemize}\n\\end{document}")
    assert "Prose right after the heading." in latex and "# First" in latex
    nested = "".join(f"<li>{'Inner item text of some length here. ' * 9}</li>" for _ in range(9))
    assert ("list_item", "Outer") in M.parts(f"<body><ul><li>Outer<ul>{nested}</ul></li></ul></body>")


def test_deep_and_broken_nesting():
    for text in ("<div>" * 5000 + "<h1>T</h1>" + "</div>" * 9, "<ul><li>" * 5000 + "x", "\\begin{document}" + "\\section{" * 5000 + "T", "\\begin{document}\\textbf{" * 3000, "<h1>" * 3000 + "T", "{{" * 5000, "* " * 9000):
        M.parts(text), M.clean(text)
    assert M.parts("<div>" * 5000 + "<h1>T</h1>") == [("heading", "T")]


@pytest.mark.parametrize("text", ["<p>x", "a <!-- c -->", "x &amp; y", "\\section{a}", "50\\%", "**b**", "see `c`", "[[a]]", "''i''", "# T", "- item", "1. item", "=== T ===", "$$x$$", "| a | b |", "cut <b", "_word_ x", "T\n====", "~~~"])
def test_residue(text):
    assert M.RESIDUE.search(text)


@pytest.mark.parametrize("text", ["p < 0.05, n > 30", "x <- y", "Lot #868 costs $163 and $441 per unit [3].", "Score {554} is R&D, ~213 units", "a_1_b and c_2_d;", "5 * 298 mm, see * in the", "", "plain"])
def test_no_residue(text):
    assert not M.RESIDUE.search(text)


def test_tables(spark, sf_dir):
    rows = [("a", "# T"), ("a", "# T"), ("b", None), (None, "# X"), ("c", ""), ("d", "# T\n" + "word " * 50_000), ("e", "<" * 2000 + "[[" * 2000)]
    df = spark.createDataFrame(rows, "md_id string, markdown_text string").withColumn("text", M.F.lit(1))
    assert sorted(map(tuple, M.structure(df, "md_id", "markdown_text").collect())) == [("a", "heading", "T"), ("d", "heading", "T")]
    assert M.structure(df.limit(0), "md_id", "markdown_text").count() == M.residue(df.limit(0), "md_id", "markdown_text").count() == 0
    assert {r.record_id for r in M.residue(df, "md_id", "markdown_text").collect()} == {"a", "d", "e"}
    assert M.cleaned(df, "md_id", "markdown_text").count() == 6
    found = M.structure(spark.read.parquet(f"{sf_dir}/extracted_markdown.parquet"), "md_id", "markdown_text")
    texts = {r.md_id: r.markdown_text for r in spark.read.parquet(f"{sf_dir}/extracted_markdown.parquet").collect()}
    assert {tuple(r) for r in found.collect()} == {(i, *p) for i, t in texts.items() for p in M.parts(t)}


CHROME = "<ul>" + "".join(f"<li><a href='/{k}'>Section number {k}</a></li>" for k in range(12)) + "</ul>"
LIST = "<ul><li>Rinse the probe</li><li>Dry it</li></ul>"
BODY = "<div>" + "<p>The device was rinsed and dried in moving air before every one of the tests that are told of here.</p>" * 9 + "</div>"


def test_the_density_decides_what_is_kept(monkeypatch):
    page = f"<html><body>{CHROME}{LIST}{BODY}</body></html>"
    items = [t for k, t in M.parts(page) if k == "list_item"]
    assert items == ["Rinse the probe", "Dry it"]
    assert "Section number" not in M.clean(page) and "Rinse the probe" in M.clean(page)
    monkeypatch.setattr(M, "_density", lambda *_: 0.0)
    assert "Section number 3" in M.clean(page)


def test_tables_keep_their_text():
    wiki = "== Doses ==\n{| class='wikitable'\n|+ Per kilogram\n! Drug !! Dose\n|-\n| Aspirin || 3 mg\n|- style='x'\n| align=left | [[Ibuprofen]]\n| 5 mg\n|}\nText after the table."
    found = M.clean(wiki)
    assert [x for x in ("Per kilogram | Drug | Dose", "Aspirin | 3 mg", "Ibuprofen | 5 mg", "Text after the table.") if x not in found] == []
    latex = "\\section{Doses}\n\\begin{tabular}{l|r}\n\\hline\nDrug & Dose \\\\[2pt]\n\\textbf{Aspirin} & 3\\% \\\\ \\hline\n\\end{tabular}\n\nText after the table."
    found = M.clean(latex)
    assert [x for x in ("Drug | Dose", "Aspirin | 3%", "Text after the table.") if x not in found] == []
    assert [k for k, _ in M.parts(wiki)] == [k for k, _ in M.parts(latex)] == ["heading"]


def test_time_grows_with_the_length_of_broken_texts():
    import time

    for piece in ("<a href=x>text ", "<script>x ", "<ref>x ", "\\begin{equation} x ", "<div><p>x ", "{{x ", "[[x ", "<math>x ", "\\[ x ", "\\( x "):
        began = time.process_time()
        M.clean(piece * 20_000)
        assert time.process_time() - began < 6, piece
    assert M.clean("a <script>x</script> b <script>c") == "a b c"
