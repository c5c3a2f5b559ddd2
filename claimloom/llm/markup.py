"""Problem 2: documents with HTML, Markdown, wiki or LaTeX markup, as clean text.

Each document is read into one tree of blocks: code and formulas are set aside
as they stand, the line syntax of Markdown and wiki and the commands of LaTeX
become elements beside those of HTML, broken nesting is closed where the next
block begins. Composite text density then finds the content: for every node the
characters per tag, adjusted for links; the subtree whose children have the
largest density sum is taken, and along its path to the body the siblings that
reach the least density on that path.

Text that stands beside blocks in the same element is a node of its own, rated
as they are. Headings, lists, code and formulas are structure, which the density
rates low; beside the path they are kept if they are as dense as they would be if
half of their text were links.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and command names.
INLINE = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var".split())
VOID = set("area br col embed hr img input link meta source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form header html main nav p section summary".split())
LISTS, TABLE = {"ul", "ol", "menu", "dir"}, {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}
HEADINGS = {f"h{k}" for k in range(1, 7)}
LATEX_LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
LATEX_DROP = set("cite citep citet ref eqref label pageref usepackage documentclass input include bibliographystyle bibliography vspace hspace includegraphics index setlength newcommand renewcommand pagestyle".split())
# End of the fixed values.

HOLD, END = "\ue000", "\ue001"
LOOSE = ""  # the tag of a run of text and inline elements that stands beside blocks
DEEPEST = 100
KEPT = re.compile(f"{HOLD}(\\d+){END}")
NAME = r"[a-zA-Z][\w:-]*"
TAG = re.compile(rf"<(/?)({NAME})((?:\s[^<>]*)?)/?>")
RAW = re.compile(
    r"(?=[<`~\\$ ])(?:(?P<comment><!--.*?(?:-->|\Z))"
    r"|(?P<drop><(?P<dropped>script|style|head|ref)(?:\s[^<>]*)?(?<!/)>.*?</(?P=dropped)\s*>)"
    r"|(?P<pre><(?P<pretag>pre|syntaxhighlight|source|listing|xmp)(?:\s[^<>]*)?>(?P<precode>.*?)(?:</(?P=pretag)\s*>|\Z))"
    r"|(?P<fence>^[ ]{0,3}(?P<ticks>`{3,}|~{3,})[^\n`]*\n(?P<fenced>.*?)(?:^[ ]{0,3}(?P=ticks)[`~]*[ \t]*$|\Z))"
    r"|(?P<verb>\\begin\{(?P<env>verbatim\*?|lstlisting|minted|alltt)\}(?:\[[^\]\n]*\])?(?P<verbatim>.*?)(?:\\end\{(?P=env)\}|\Z))"
    r"|(?P<eq>\\begin\{(?P<eqenv>(?:equation|displaymath|math|align|gather|multline|eqnarray)\*?)\}(?P<eqbody>.*?)\\end\{(?P=eqenv)\})"
    r"|(?P<math><math(?:\s[^<>]*)?>(?P<mathbody>.*?)</math\s*>)"
    r"|(?P<tick>(?<!`)(?P<n>`{1,2})(?!`)(?P<inline>[^\n]*?[^`\n])(?P=n)(?!`))"
    r"|(?P<display>(?<!\\)\$\$(?P<displayed>[^$]+?)\$\$)"
    r"|(?P<bracket>(?<!\\)\\\[(?P<bracketed>(?:(?!\n\s*\n).)+?)\\\])"
    r"|(?P<paren>(?<!\\)\\\((?P<parened>(?:(?!\n\s*\n).)+?)\\\))"
    r"|(?P<dollar>(?<![\\$\w])\$(?=[^\s$])(?P<dollared>(?:\\\$|[^$\n]|\n(?!\s*\n))+?)(?<![\s\\])\$(?![\w$])))",
    re.S | re.M | re.I,
)
PAIRS = [(f"<{x}", re.compile(rf"<{x}(?:\s[^<>]*)?(?<!/)>", re.I), re.compile(rf"</{x}\s*>", re.I)) for x in ("script", "style", "head", "ref", "math")]
PAIRS += [(f"\\begin{{{x}", re.compile(rf"\\begin\{{{x}\*?\}}"), re.compile(rf"\\end\{{{x}\*?\}}")) for x in ("equation", "displaymath", "math", "align", "gather", "multline", "eqnarray")]
PAIRS += [(f"\\{a}", re.compile(rf"(?<!\\)\\\{a}"), re.compile(rf"\\\{b}")) for a, b in ("[]", "()")]
ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
ITEM = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])[ \t]+(.*\S.*)$")
WIKI_HEAD = re.compile(r"^(={1,6})\s*(.*?)\s*(={1,6})\s*$")
WIKI_ITEM = re.compile(r"^([*#:;]+)\s*(.*)$")
COMMAND = re.compile(r"\\([a-zA-Z]+)\*?[ \t]*")
ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
RESIDUE = re.compile(
    rf"<!--|-->|</?{NAME}(?:\s[^<>]*)?/?>|</?[a-zA-Z][^<>\n]*\Z|<!-?\Z"
    r"|\\[a-zA-Z]+|\\[%&#$_{}()\[\]\\*`~]|\\\Z|\{\\"
    r"|&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#\d+|#[xX][0-9a-fA-F]+);"
    r"|'{2,}|\[\[|\]\]|\{\{|\}\}|\{\||\[https?://|\]\(|`|~~|\$\$|\$(?=[a-zA-Z\\])"
    r"|^={1,6} ?\S.*|^[=\-]{3,}[ \t]*$|^\|.*|^[ ]{0,3}#{1,6}[ \t]|^\s*(?:[-*+]|\d{1,9}[.)])[ \t]|^[*#:;]{1,6}[ \t]*[A-Z]|^>[ \t]"
    r"|(?<![\w*])\*{1,3}(?=[^\s*])|(?<=[^\s*])\*{1,3}(?=[\s.,;:!?)]|\Z)|(?<!\w)_{1,3}(?=[^\W_])|(?<=[\w.,:;!?)])_{1,3}(?=[\s.,;:!?)])",
    re.M,
)


class Node:
    """An element with its text, children and the density figures of its subtree."""

    __slots__ = ("tag", "parts", "parent", "depth", "tags", "chars", "links", "linked", "density", "total")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.parts = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.tags = self.chars = self.links = self.linked = 0
        self.density = self.total = 0.0

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def text(self, without: set[str] = frozenset()) -> str:
        return "".join(p if isinstance(p, str) else p.text(without) if p.tag not in without else " " for p in self.parts)


def kind_of(text: str) -> str:
    """The syntax that rules the lines of ``text``: latex, wiki, html or markdown."""
    if re.search(r"\\(?:documentclass|(?:sub)*section|chapter)\b|\\begin\{(?:document|itemize|enumerate|verbatim|lstlisting|tabular)", text):
        return "latex"
    if re.search(r"<(?:html|body)\b", text, re.I):
        return "html"
    wiki = len(re.findall(r"^={1,6}[^=\n]+={1,6}[ \t]*$|'''|\[\[|\[https?://\S+ |^\{\||<syntaxhighlight|<math\b|\{\{\w", text, re.M | re.I))
    markdown = len(re.findall(r"^#{1,6} |^[`~]{3}|\*\*\w|\]\(|^[-+] |^\d+\. |^\|-|^[=-]{4,}$", text, re.M))
    if wiki > markdown:
        return "wiki"
    return "html" if not markdown and re.search(r"<(?:p|h[1-6]|li|div)\b", text, re.I) else "markdown"


def _fence_indented(text: str) -> str:
    """Markdown with its code blocks by indentation put into fences."""
    out, code, closing, before = [], [], None, ""
    for line in [*text.split("\n"), ""]:
        opening = re.match(r"^ {0,3}(`{3,}|~{3,})|(?i:.*<(pre)\b)", line)
        if closing:
            closing = None if re.search(closing, line, re.I) else closing
        elif opening and not code:
            ends = rf"^ {{0,3}}{opening[1]}" if opening[1] else r"</pre\s*>"
            closing = None if opening[2] and re.search(ends, line[opening.end() :], re.I) else ends
        elif line.strip() and re.match(r"^(?: {4}|\t)", line) and (code or not out or not out[-1].strip() and not ITEM.match(before)):
            code.append(re.sub(r"^(?: {4}|\t)", "", line))
            continue
        if code:
            out += ["~" * 8, *code, "~" * 8]
            code = []
        out.append(line)
        before = line if line.strip() else before
    return "\n".join(out)


def _closed(text: str) -> str:
    """``text`` without the tags and environments that are opened but never closed behind, so that none is looked for in vain."""
    low = text.lower()
    for sign, opening, closing in PAIRS:
        if sign not in low:
            continue
        last = max((m.start() for m in closing.finditer(text)), default=-1)
        head, tail = text[: last + 1], text[last + 1 :]
        text = head + opening.sub(lambda m: "\n\n" if "begin" in m[0] else f"&#{ord(m[0][1])};" if len(m[0]) == 2 else "", tail)
    return text


def _set_aside(text: str, kind: str) -> tuple[str, list[tuple[str, str]]]:
    """``text`` with code and formulas replaced by marks, and what the marks stand for."""
    kept: list[tuple[str, str]] = []

    def hold(what: str, body: str, pad: str = "") -> str:
        kept.append((what, body))
        return f"{pad}{HOLD}{len(kept) - 1}{END}{pad}"

    def one(m: re.Match) -> str:
        if m["comment"] is not None or m["drop"] is not None:
            return ""
        if m["pre"] is not None:
            body = m["precode"]
            if m["pretag"].lower() in ("pre", "listing"):
                body = html.unescape(re.sub(r"</?(?:code|span|samp|tt)\b[^<>]*>", "", body))
            return hold("code_block", body, "\n\n")
        if m["tick"] is not None:
            return m[0] if kind in ("latex", "wiki", "html") else hold("text", m["inline"])
        for group, body, what in (("fence", "fenced", "code_block"), ("verb", "verbatim", "code_block")):
            if m[group] is not None:
                return hold(what, m[body], "\n\n")
        body = next(m[b] for b in ("eqbody", "mathbody", "displayed", "bracketed", "parened", "dollared") if m[b] is not None)
        return hold("formula", html.unescape(body) if kind in ("html", "wiki") else body)

    return RAW.sub(one, _closed(text)), kept


def _emphasis(text: str, kept: list[tuple[str, str]]) -> str:
    """Markdown's inline syntax of ``text`` as elements."""

    def escaped(m: re.Match) -> str:
        kept.append(("text", m[1]))
        return f"{HOLD}{len(kept) - 1}{END}"

    text = ESCAPED.sub(escaped, text)
    text = re.sub(r"!\[([^\]\n]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)", r"\1", text)
    text = re.sub(r"\[([^\]\n]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)", r"<a>\1</a>", text)
    text = re.sub(r"<https?://[^<>\s]+>", lambda m: m[0][1:-1], text)
    for sign in (r"\*\*\*", r"\*\*", r"\*"):
        text = re.sub(rf"(?<!\*){sign}(?=[^\s*])(.+?)(?<=[^\s*]){sign}(?!\*)", r"<em>\1</em>", text, flags=re.S)
    for sign in ("___", "__", "_"):
        text = re.sub(rf"(?<![\w]){sign}(?=[^\s_])(.+?)(?<=[^\s_]){sign}(?![\w])", r"<em>\1</em>", text, flags=re.S)
    return re.sub(r"~~(?=\S)(.+?)(?<=\S)~~", r"<em>\1</em>", text)


def _markdown(text: str, kept: list[tuple[str, str]]) -> str:
    lines, out, block, k = text.split("\n"), [], [], 0

    def flush(tag: str = "p") -> None:
        if block:
            out.append(f"<{tag}>{_emphasis(chr(10).join(block), kept)}</{tag}>")
            block.clear()

    while k < len(lines):
        line = lines[k]
        rule = lines[k + 1].strip() if k + 1 < len(lines) else ""
        if m := ATX.match(line):
            flush()
            out.append(f"<h{len(m[1])}>{_emphasis(m[2], kept)}</h{len(m[1])}>")
        elif re.match(r"^\s*\|.*\|\s*$", line):
            flush()
            out.append(f"<table><tr><td>{_emphasis(line, kept)}</td></tr></table>")
        elif m := ITEM.match(line):
            flush()
            item = [m[2]]
            while k + 1 < len(lines) and re.match(r"^\s{2,}\S", lines[k + 1]) and not ITEM.match(lines[k + 1]) and HOLD not in lines[k + 1][:3]:
                k += 1
                item.append(lines[k].strip())
            out.append(f"<ul><li>{_emphasis(' '.join(item), kept)}</li></ul>")
        elif line.strip() and re.fullmatch(r"=+|-{2,}", rule) and not line.lstrip().startswith(("<", "|", ">")) | (TAG.match(line.strip()) is not None and line.strip().startswith(("<p", "<div"))):
            block.append(line)
            flush("h1" if rule[0] == "=" else "h2")
            k += 1
        elif line.strip() and re.fullmatch(r"=+|-{2,}", rule) and re.match(r"\s*<(\w+)", line) and re.match(r"\s*<(\w+)", line)[1].lower() in INLINE:
            block.append(line)
            flush("h1" if rule[0] == "=" else "h2")
            k += 1
        elif not line.strip() or re.fullmatch(r"\s*(?:-\s*){3,}|\s*(?:\*\s*){3,}|\s*(?:_\s*){3,}", line):
            flush()
        elif re.match(r"^\s*</?(?:" + "|".join(sorted(HEADINGS | LISTS | TABLE | BLOCK | {"li"})) + r")\b", line, re.I):
            flush()
            out.append(_emphasis(line, kept))
        else:
            block.append(re.sub(r"^ {0,3}>\s?", "", line))
        k += 1
    flush()
    return "\n".join(out)


def _without_templates(text: str) -> str:
    """``text`` without templates in double braces, the inner ones first, in one pass."""
    out: list[str] = []
    braces: list[int] = []  # places in ``out`` of the braces that stand
    for piece in re.split(r"([{}])", text):
        if not piece:
            continue
        out.append(piece)
        if piece in "{}":
            braces.append(len(out) - 1)
            a, b, c, d = braces[-4:] if len(braces) > 3 else (0, 0, 0, 0)
            if b == a + 1 and d == c + 1 and out[a] == out[b] == "{" and out[c] == out[d] == "}":
                del out[a:], braces[-4:]
    return "".join(out)


def _rows(rows: list[list[str]]) -> str:
    """A table of ``rows`` of cells, each row in a line."""
    lines = [" | ".join(c for c in (" ".join(cell.split()) for cell in row) if c) for row in rows]
    return "\n<table>\n" + "\n".join(f"<tr><td>{x}</td></tr>" for x in lines if x) + "\n</table>\n"


def _wiki_table(m: re.Match) -> str:
    rows: list[list[str]] = [[]]
    for line in m[0].split("\n")[1:]:
        line = line.strip()
        if line.startswith("|}"):
            break
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith(("|", "!")):
            cells = re.split(r"\|\||!!", line[2:] if line.startswith("|+") else line[1:])
            rows[-1] += [re.sub(r"^[^\[\]|{}<>]*=[^\[\]|{}<>]*\|(?!\|)", "", c) for c in cells]
        elif rows[-1]:
            rows[-1][-1] += " " + line
        elif line:
            rows[-1].append(line)
    return _rows(rows)


def _wiki(text: str) -> str:
    text = re.sub(r"\{\|.*?(?:^\|\}|\Z)", _wiki_table, text, flags=re.S | re.M)
    text = _without_templates(text)
    text = re.sub(r"<ref\b[^<>]*/>", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:File|Image|Category):[^\[\]]*\]\]", "", text)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"<a>\1</a>", text)
    text = re.sub(r"\[(?:https?:|ftp:|mailto:)?//\S+\s+([^\[\]\n]*)\]|\[(?:https?|ftp|mailto):\S+\s+([^\[\]\n]*)\]", lambda m: f"<a>{m[1] or m[2] or ''}</a>", text)
    text = re.sub(r"'{2,5}", "", text)
    out = []
    for line in text.split("\n"):
        if m := WIKI_HEAD.match(line):
            n = min(len(m[1]), len(m[3]))
            out.append(f"<h{n}>{'=' * (len(m[1]) - n)}{m[2]}{'=' * (len(m[3]) - n)}</h{n}>")
        elif m := WIKI_ITEM.match(line):
            out.append(f"<ul><li>{m[2]}</li></ul>" if m[1][-1] in "*#" else f"<p>{m[2]}</p>")
        else:
            out.append(line if line.strip() else "<p>")
    return "\n".join(out)


def _braced(text: str, at: int) -> int:
    """The place behind the group that opens at ``at``."""
    depth = 0
    for k in range(at, len(text)):
        if text[k] == "\\":
            continue
        if text[k] == "{" and text[k - 1 : k] != "\\":
            depth += 1
        elif text[k] == "}" and text[k - 1 : k] != "\\":
            depth -= 1
            if not depth:
                return k + 1
    return len(text)


def _latex_table(m: re.Match) -> str:
    at, body = 0, m[1].lstrip()
    while body[at : at + 1] in ("{", "["):  # widths, places and columns
        at = _braced(body, at) if body[at] == "{" else body.find("]", at) + 1 or len(body)
    body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|(?:cline|cmidrule)(?:\([^()]*\))?\{[^{}]*\})", "", body[at:])
    return _rows([re.split(r"(?<!\\)&", row) for row in re.split(r"\\\\(?:\[[^\]\n]*\])?", body)])


def _latex(text: str, kept: list[tuple[str, str]], depth: int = 0) -> str:
    text = re.sub(r"(?<!\\)%[^\n]*", "", text)
    text = re.sub(r"\\begin\{tabular[x*]?\}(.*?)(?:\\end\{tabular[x*]?\}|\Z)", _latex_table, text, flags=re.S)

    def escaped(m: re.Match) -> str:
        kept.append(("text", m[1]))
        return f"{HOLD}{len(kept) - 1}{END}"

    text = re.sub(r"\\([%&#$_{}])", escaped, text)
    text = re.sub(r"\\\\(?:\[[^\]\n]*\])?", " ", text)
    inner = lambda x: _latex(x, kept, depth + 1) if depth < DEEPEST else x
    out, at = [], 0
    for _ in range(len(text) + 1):
        m = COMMAND.search(text, at)
        if not m:
            break
        out.append(text[at : m.start()])
        name, at = m[1], m.end()
        while text[at : at + 1] == "[":
            at = text.find("]", at) + 1 or len(text)
        if name in LATEX_LEVELS and text[at : at + 1] == "{":
            end = _braced(text, at)
            n = LATEX_LEVELS[name]
            out.append(f"\n<h{n}>{inner(text[at + 1 : end - 1])}</h{n}>\n")
            at = end
        elif name in ("begin", "end") and text[at : at + 1] == "{":
            end = _braced(text, at)
            env = text[at + 1 : end - 1]
            out.append(f"<{'/' * (name == 'end')}{'ol' if env == 'enumerate' else 'ul'}>" if env in ("itemize", "enumerate", "description") else "\n\n")
            at = end
        elif name == "item":
            out.append("<li>")
        elif name in ("par", "newpage", "maketitle", "tableofcontents", "clearpage"):
            out.append("\n\n")
        elif name in LATEX_DROP:
            while text[at : at + 1] == "{":
                at = _braced(text, at)
        elif name in ("href", "textcolor", "colorbox") and text[at : at + 1] == "{":
            at = _braced(text, at)
            if text[at : at + 1] == "{":
                end = _braced(text, at)
                out.append(f"<a>{inner(text[at + 1 : end - 1])}</a>")
                at = end
        elif name == "url" and text[at : at + 1] == "{":
            end = _braced(text, at)
            out.append(f"<a>{text[at + 1 : end - 1]}</a>")
            at = end
    out.append(text[at:])
    return re.sub(r"[{}]", "", "".join(out).replace("~", " ")).replace("\n\n", "\n<p>")


def tree(text: str) -> tuple[Node, list[tuple[str, str]]]:
    """The tree of blocks of ``text``, and the code and formulas set aside."""
    kind = kind_of(text)
    text = text.replace("\r\n", "\n").replace(HOLD, "").replace(END, "")
    text, kept = _set_aside(_fence_indented(text) if kind == "markdown" else text, kind)
    if kind == "markdown":
        text = _markdown(text, kept)
    elif kind == "wiki":
        text = _wiki(text)
    elif kind == "latex":
        text = _latex(text, kept)
    root = top = Node("body", None)
    at, link = 0, False

    def close(until: set[str]) -> None:
        nonlocal top
        while top.parent and top.tag in until:
            top = top.parent

    def run() -> Node:
        """Where inline content goes: a run of its own, or the heading or item itself."""
        if top.tag in HEADINGS or top.tag == "li":
            return top
        if not top.parts or not isinstance(top.parts[-1], Node) or top.parts[-1].tag != LOOSE:
            top.parts.append(Node(LOOSE, top))
        return top.parts[-1]

    def add(piece: str) -> None:
        k = 0
        if link:
            run().linked += len(piece)
        for m in KEPT.finditer(piece):
            run().parts.append(piece[k : m.start()])
            what, body = kept[int(m[1])]
            to = top if what == "code_block" else run()
            node = Node(what, to)
            node.parts.append(body)
            to.parts.append(node if what != "text" else body.replace("&", "&amp;"))
            k = m.end()
        run().parts.append(piece[k:])

    for m in TAG.finditer(text):
        add(text[at : m.start()])
        at, name, ends = m.end(), m[2].lower(), bool(m[1])
        if name in ("html", "body"):
            continue
        if name in VOID:
            run().parts.append(" ")
        elif name in HEADINGS | LISTS | TABLE | BLOCK | {"li"}:
            link = False
            if not ends:
                if name == "li":
                    close({"p", "div", "li"} | HEADINGS)
                elif name in LISTS:
                    close({"p"} | HEADINGS)
                elif name in TABLE:
                    close({"p"} | HEADINGS | ({"td", "th"} if name in ("td", "th") else {"td", "th", "tr"} if name == "tr" else set()))
                elif name in HEADINGS:
                    close({"p", "li"} | LISTS | TABLE | HEADINGS)
                else:
                    close({"p"} | HEADINGS)
                if top.tag == "div" and any(isinstance(p, str) and p.strip() for r in top.parts if r.tag == LOOSE for p in r.parts) and name not in LISTS:
                    close({"div"})
                if top.depth < DEEPEST or name in HEADINGS or name == "li":  # other elements nested deeper are passed over
                    node = Node(name, top)
                    top.parts.append(node)
                    top = node
            else:
                up, alike = top, HEADINGS if name in HEADINGS else LISTS if name in LISTS else {"p", "div"} if name in ("p", "div") else {name}
                while up.parent and up.tag not in alike and not (up.tag in LISTS | TABLE and name in ("p", "div")):
                    up = up.parent
                if up.parent and up.tag in alike:
                    top = up.parent
        else:
            inline = run()
            inline.tags += 1
            if name == "a":
                link = not ends
                inline.links += link
    add(text[at:])
    _join_runs(root)
    return root, kept


def _join_runs(root: Node) -> None:
    """Puts runs that are blank, or stand beside no block, into their element itself."""
    todo = [root]
    while todo:
        node = todo.pop()
        blocks = any(p.tag not in (LOOSE, "formula") for p in node.children())
        joined: list[Node | str] = []
        for part in node.parts:
            if isinstance(part, str) or part.tag != LOOSE:
                joined.append(part)
                todo += [part] if isinstance(part, Node) else []
            elif blocks and any(isinstance(p, Node) or p.strip() for p in part.parts):
                joined.append(part)
            else:
                for p in part.parts:
                    if isinstance(p, Node):
                        p.parent = node
                joined += part.parts
                node.tags, node.links, node.linked = node.tags + part.tags, node.links + part.links, node.linked + part.linked
        node.parts = joined


def _measure(node: Node) -> None:
    """Characters, tags, links and linked characters of every subtree."""
    for part in node.parts:
        if isinstance(part, str):
            node.chars += len(part.strip())
        else:
            _measure(part)
            node.chars, node.tags = node.chars + part.chars, node.tags + part.tags + (part.tag != LOOSE)
            node.links, node.linked = node.links + part.links, node.linked + part.linked


def _density(chars: int, tags: int, linked: float, links: float, share: float) -> float:
    """Composite text density: the characters per tag, times a logarithm of
    characters per linked one and tags per link to a base that grows with the
    linked text; ones are added to keep both logarithms above zero.

    share: linked characters of the whole body per character.
    """
    if not chars:
        return 0.0
    tags, plain = max(1, tags), max(1, chars - linked)
    base = math.log(chars / plain * linked + share * chars + math.e)
    return chars / tags * math.log(chars / max(1, linked) * tags / max(1, links) + 1) / max(1e-9, math.log(max(base, 1.0001) + 1))


def _densities(node: Node, share: float) -> None:
    """Composite text density of every node and the sum over its children.

    Loose text does not decide where the body is, so only the formulas in it
    count for the sum.
    """
    node.total = 0.0
    for child in node.children():
        _densities(child, share)
        node.total += child.total if child.tag == LOOSE else child.density
    node.density = _density(node.chars, node.tags, node.linked, node.links, share)


def _dense(node: Node, share: float) -> bool:
    """Whether ``node`` is as dense as it would be if half of its text were links."""
    return node.density >= _density(node.chars, node.tags, node.chars / 2, max(node.tags, 1) / 2, share)


def _holds_structure(node: Node) -> bool:
    return node.tag in HEADINGS or node.tag in ("li", "code_block", "formula") or any(map(_holds_structure, node.children()))


def content(root: Node) -> list[Node]:
    """The subtrees that are the content of the document under ``root``, in its order."""
    _measure(root)
    share = root.linked / max(1, root.chars)
    _densities(root, share)
    best, todo = root, [root]
    while todo:
        node = todo.pop()
        todo += node.children()
        if node.total > best.total and node.tag != LOOSE:
            best = node
    node = best
    while node.parent:  # an item is taken whole
        node = node.parent
        best = node if node.tag == "li" else best
    found, node, least = [best], best, best.density
    while node.parent:
        node = node.parent
        least = min(least, node.density)
    node = best
    while node.parent:
        for child in node.parent.children():
            structure = _holds_structure(child) and _dense(child, share)
            if child is not node and (child.density >= least or structure):
                found.append(child)
            elif child.tag == LOOSE:
                found += child.children()
        node = node.parent
    chosen, ordered, todo = {id(n) for n in found}, [], [root]
    while todo:
        node = todo.pop()
        if id(node) in chosen:
            ordered.append(node)
        else:
            todo += node.children()[::-1]
    return ordered


def tidy(text: str, entities: bool = True) -> str:
    return " ".join((html.unescape(text) if entities else text).split())


def parts(text: str | None) -> list[tuple[str, str]]:
    """(part_kind, plain_text) of each distinct heading, list item, code block and formula."""
    if not text:
        return []
    root, _ = tree(text)
    found: dict[tuple[str, str], None] = {}
    todo = content(root)[::-1]
    while todo:
        node = todo.pop()
        if node.tag in ("code_block", "formula"):
            part = (node.tag, tidy(node.text(), False))
        elif node.tag in HEADINGS:
            part = ("heading", tidy(node.text()))
        elif node.tag == "li":
            part = ("list_item", tidy(node.text(LISTS | {"code_block"})))
        else:
            part = ("", "")
        if part[1]:
            found.setdefault(part)
        todo += node.children()[::-1]
    return list(found)


def clean(text: str | None) -> str | None:
    """``text`` without markup: headings as ``# ``, items as ``- ``, code fenced, formulas in ``$``."""
    if text is None:
        return None
    root, _ = tree(text)
    lines: list[str] = []

    def walk(node: Node) -> str:
        own = ""
        for part in node.parts:
            if isinstance(part, str):
                own += part
            elif part.tag == "formula":
                own += f"${tidy(part.text(), False)}$".replace("&", "&amp;")
            elif part.tag == "code_block":
                put(node, own)
                own = ""
                lines.append("```\n" + part.text().strip("\n") + "\n```")
            else:
                put(node, own)
                own = ""
                put(part, walk(part))
        return own

    def put(node: Node, own: str) -> None:
        if own := tidy(own):
            lines.append("#" * int(node.tag[1]) + " " + own if node.tag in HEADINGS else "- " + own if node.tag == "li" else own)

    for node in content(root):
        put(node, walk(node))
    return "\n\n".join(lines)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = [(i, *p) for i, t in zip(df["record_id"], df["text"]) for p in parts(t)]
        yield pd.DataFrame(rows, columns=["record_id", "part_kind", "plain_text"])


def structure(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(record_id, part_kind, plain_text): the distinct parts of each document.

    Null and empty texts have no parts; texts of one key count as one document;
    null keys give no rows; repeated rows count once.
    """
    rows = documents.select(F.col(key).alias("record_id"), F.col(text).alias("text")).where("record_id is not null and text is not null")
    return rows.mapInPandas(_parts, "record_id string, part_kind string, plain_text string").distinct()


def _residue(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        yield df.loc[df["text"].map(lambda t: RESIDUE.search(t) is not None), ["record_id"]]


def residue(previews: DataFrame, key: str, text: str) -> DataFrame:
    """(record_id): the previews that hold any markup; null and empty ones hold none."""
    rows = previews.select(F.col(key).alias("record_id"), F.col(text).alias("text")).where("record_id is not null and text is not null")
    return rows.mapInPandas(_residue, "record_id string").distinct()


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        yield pd.DataFrame({"record_id": df["record_id"], "clean_text": df["text"].map(clean, na_action="ignore")})


def cleaned(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(record_id, clean_text): each document as clean text, null texts as null; repeated rows count once."""
    rows = documents.select(F.col(key).alias("record_id"), F.col(text).alias("text")).distinct()
    return rows.mapInPandas(_clean, "record_id string, clean_text string")
