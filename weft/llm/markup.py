"""Problem 6: clean text and structure from HTML, Markdown, wiki and LaTeX markup.

A document becomes a tree of containers with blocks as leaves. Paragraphs pass points for length and
commas to their ancestors, discounted by link density; the best container is kept, with those of its
siblings that belong to it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CASES = ("heading", "item", "code", "formula")
_I, _S, _M = re.I, re.S, re.M


@dataclass
class Block:
    kind: str  # heading, item, code, formula, paragraph or table
    content: str
    links: int = 0  # characters inside links


@dataclass
class Node:
    """A container of the tree: its blocks and containers in order."""

    name: str = "body"
    children: list[Block | Node] = field(default_factory=list)
    score: float = 0.0

    def blocks(self) -> Iterator[Block]:
        for child in self.children:
            if isinstance(child, Node):
                yield from child.blocks()
            else:
                yield child


def squeeze(text: str) -> str:
    return " ".join(text.split())


# ---------------------------------------------------------------- formats

_LATEX = re.compile(r"\\documentclass|\\begin\{\w+\*?\}|^[ \t]*\\(?:sub)*section\*?[\[{]|^[ \t]*\\(?:paragraph|chapter)\*?\{|\\(?:textbf|emph|href|texttt)\{", _M)
_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\s].*?)[ \t]*\1[ \t]*(?:<!--.*?-->[ \t]*)?$", _M)
_WIKI_SIGNS = re.compile(r"^\{\||\[\[[^\]\n]+\]\]|<(?:ref|syntaxhighlight|nowiki|math|source)\b|'''?[^'\n]+'''?", _M)
_MD_SIGNS = re.compile(r"^ {0,3}#{1,6}[ \t]+\S.*\n(?!#)|^ {0,3}(?:```|~~~)|\]\(https?://|^(?:=+|-{3,})[ \t]*$|\*\*\w", _M)
_HTML_PAGE = re.compile(r"<!doctype\b|<html\b", _I)
_FENCED = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?^ {0,3}\1[`~]*[ \t]*$", _S | _M)
_VERBATIM_TAGS = re.compile(r"<(pre|source|syntaxhighlight|nowiki|script|style)\b.*?</\1\s*>|<!--.*?-->", _S | _I)
_TEX_VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim)\}.*?\\end\{\1\}", _S)


def markup_format(text: str) -> str:
    """latex, wiki, html (a whole page) or markdown, which may hold HTML; plain text reads as Markdown without marks."""
    if _HTML_PAGE.search(text[:400]):
        return "html"
    bare = _FENCED.sub("", _VERBATIM_TAGS.sub("", text))
    if _LATEX.search(bare):
        return "latex"
    if _WIKI_HEAD.search(bare):
        return "wiki"
    if _WIKI_SIGNS.search(text) and not _MD_SIGNS.search(bare) and not re.search(r"<(?:p|div|h[1-6]|ul|ol)\b", bare, _I):
        return "wiki"
    return "markdown"


# ---------------------------------------------------------------- inline markup

_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s+[^<>]*|\s*/?)>|<!--.*?-->", _S)


def html_inline(text: str) -> str:
    if "<" not in text and "&" not in text:
        return squeeze(text)
    return squeeze(html.unescape(_TAG.sub("", re.sub(r"<br\s*/?>", " ", text, flags=_I))))


_MD_CODE = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)", _S)


_MD_MARK = re.compile(r"[`\\*_\[<&~]")


def markdown_inline(text: str) -> str:
    if not _MD_MARK.search(text):
        return squeeze(text)
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return f"\x00{len(kept) - 1}\x00"

    if "`" in text:
        text = _MD_CODE.sub(lambda m: keep(m[2].strip()), text)
    if "\\" in text:
        text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(m[1]), text)
    if "<" in text:
        text = re.sub(r"<((?:https?|mailto):[^>\s]+)>", r"\1", text)
    if "![" in text:
        text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", text)
    for _ in range(2 if "[" in text else 0):
        text = re.sub(r"\[([^\[\]]*)\]\((?:[^()]|\([^)]*\))*\)|\[([^\[\]]+)\]\[[^\]]*\]", lambda m: m[1] if m[1] is not None else m[2], text)
    if "[^" in text:
        text = re.sub(r"\[\^[^\]]+\]", "", text)
    for _ in range(3 if "*" in text or "_" in text or "~~" in text else 0):
        text = re.sub(r"(\*{1,3})(?=\S)([^*]+?)(?<=\S)\1", r"\2", text)
        text = re.sub(r"(?<!\w)(_{1,3})(?=\S)([^_]+?)(?<=\S)\1(?!\w)", r"\2", text)
        text = re.sub(r"~~(?=\S)(.+?)(?<=\S)~~", r"\1", text)
    text = html_inline(text)
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], text) if kept else text


def wiki_inline(text: str) -> str:
    if not re.search(r"['\[<{&]", text):
        return squeeze(text)
    kept: list[str] = []

    def keep(m: re.Match[str]) -> str:
        kept.append(m[1])
        return f"\x00{len(kept) - 1}\x00"

    text = re.sub(r"<!--.*?-->", "", text, flags=_S)
    text = re.sub(r"<nowiki>(.*?)</nowiki>", keep, text, flags=_S | _I)
    text = re.sub(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>", "", text, flags=_S | _I)
    for _ in range(3):
        text = re.sub(r"\{\{[^{}]*\}\}", "", text)
    text = re.sub(r"\[\[(?:File|Image|Category|Datei|Fichier|Archivo|Bild):[^\[\]]*\]\]", "", text, flags=_I)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", text)
    text = re.sub(r"\[(?:https?:)?//\S+[ \t]+([^\]]*)\]", r"\1", text)
    text = re.sub(r"'{2,5}", "", text)
    return squeeze(re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], html_inline(text)))


_TEX_ARG = r"\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
# Marks for accents and the code points that combine with the letter before them.
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "c": "\u0327"}


def latex_inline(text: str) -> str:
    if not re.search(r"[\\{}~]", text):
        return squeeze(text)
    text = re.sub(r"\\([%&_#$])", lambda m: f"\x00{ord(m[1])}\x00", text)
    text = re.sub(r"\\['`^\"~]\{?(\\?[a-zA-Z])\}?", lambda m: unicodedata.normalize("NFC", m[1].strip("\\") + _ACCENTS[m[0][1]]), text)
    text = re.sub(r"\\(?:label|cite[a-z]*|ref|eqref|vspace|hspace|footnote|index|includegraphics)\*?(?:\[[^\]]*\])?" + _TEX_ARG, "", text)
    for _ in range(4):
        text = re.sub(r"\\href" + _TEX_ARG + _TEX_ARG, r"\2", text)
        text = re.sub(r"\\(?!begin|end|item)[a-zA-Z]+\*?(?:\[[^\]]*\])?" + _TEX_ARG, r"\1", text)
        text = re.sub(r"\{\\(?:em|it|bf|tt|sc|sl|rm|sf|small|large|bfseries|itshape)\b\s*([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\\\(?:\[[^\]]*\])?|\\(?:bigskip|medskip|smallskip|noindent|newpage|par|quad|qquad|,|;|centering|hline|maketitle|tableofcontents)\b", " ", text)
    text = text.replace("~", " ")
    text = re.sub(r"(?<!\\)[{}]", "", text).replace("\\{", "{").replace("\\}", "}")
    return squeeze(re.sub(r"\x00(\d+)\x00", lambda m: chr(int(m[1])), text))


# ---------------------------------------------------------------- Markdown and HTML

_SKIPPED = r"<!--.*?-->|<(?:script|style|title|head|textarea|xmp|template)\b[^>]*>.*?</(?:script|style|title|head|textarea|xmp|template)\s*>"
_TOP_HTML = re.compile(
    rf"(?P<skip>{_SKIPPED})|<pre\b[^>]*>(?P<pre>.*?)</pre\s*>|<math\b[^>]*>(?P<math>.*?)</math\s*>"
    r"|\\\[(?P<display>.+?)\\\]|\\\((?P<inline>.+?)\\\)|<(?P<table>table)\b.*?</table\s*>"
    r"|<h(?P<level>[1-6])\b[^>]*>(?P<head>.*?)</h(?P=level)\s*>|<li\b[^>]*>(?P<item>.*?)(?=<li\b|</li\b|</?[uo]l\b|\Z)"
    r"|<(?P<close>/?)(?P<box>div|section|article|main|nav|aside|footer|header|body|p)\b[^>]*>",
    _S | _I,
)
_TOP_MD = re.compile(
    r"^[ \t]{0,3}(?P<fence>`{3,}|~{3,})(?P<lang>[^\n]*)\n(?P<fenced>.*?)(?:^[ \t]{0,3}(?P=fence)[`~]*[ \t]*$|\Z)"
    r"|(?P<tick>`+)(?!`)(?P<ticked>[^\n]*?[^`\n])(?P=tick)(?!`)|\$\$(?P<double>.+?)\$\$|(?<![\\\w$])\$(?P<single>[^\s$](?:[^$\n]*[^\s$\\])?)\$(?![\w$])|" + _TOP_HTML.pattern,
    _S | _M | _I,
)
_MATHS = re.compile(r"[\\^_=<>+*/]|^[A-Za-z]$")
_LINK = re.compile(r"<a\b[^>]*\bhref\b[^>]*>(.*?)</a\s*>|\[([^\[\]]+)\]\(", _S | _I)


def _linked(raw: str) -> int:
    if "](" not in raw and "<" not in raw:
        return 0
    return sum(len(m[1] or m[2] or "") for m in _LINK.finditer(raw))


def _page(text: str, markdown: bool) -> Node:
    """The tree of an HTML page, or of Markdown with HTML in it."""
    root = Node()
    stack = [root]
    pending: list[str] = []
    top = _TOP_MD if markdown else _TOP_HTML
    at = 0

    def flush() -> None:
        raw = "".join(pending)
        pending.clear()
        if raw.strip():
            stack[-1].children += _markdown_lines(raw) if markdown and len(stack) == 1 else _paragraphs(raw)

    def put(kind: str, content: str, raw: str = "") -> None:
        if content:
            stack[-1].children.append(Block(kind, content, min(len(content), _linked(raw))))

    for m in top.finditer(text):
        pending.append(text[at : m.start()])
        at = m.end()
        got = m.groupdict()
        if markdown and got["ticked"] is not None:
            pending.append(m[0])
            continue
        if markdown and (single := got["single"]) is not None:
            pending.append(m[0])
            if _MATHS.search(single):
                root.children.append(Block("formula", squeeze(single)))
            continue
        if got["inline"] is not None:
            formula = got["inline"] if markdown and len(stack) == 1 and not re.search(r"&\w+;|&#", got["inline"]) else html.unescape(got["inline"])
            root.children.append(Block("formula", squeeze(formula)))
            pending.append(" ")
            continue
        if got["box"] and got["box"].lower() == "p":
            pending.append("\n\n" if markdown else " \x01 ")
            continue
        flush()
        if got["skip"] is not None:
            pass
        elif markdown and got["fenced"] is not None:
            put("code", squeeze(got["fenced"]))
        elif markdown and got["double"] is not None:
            put("formula", squeeze(got["double"]))
        elif got["pre"] is not None:
            put("code", squeeze(html.unescape(_TAG.sub("", got["pre"]))))
        elif got["math"] is not None or got["display"] is not None:
            put("formula", squeeze(html.unescape(_TAG.sub("", got["math"] if got["math"] is not None else got["display"]))))
        elif got["head"] is not None:
            put("heading", html_inline(got["head"]), got["head"])
        elif got["item"] is not None:
            put("item", html_inline(re.sub(r"^\s*<input\b[^>]*>", "", got["item"], flags=_I)), got["item"])
        elif got["table"] is not None:
            put("table", html_inline(re.sub(r"</t[dhr]\s*>|<t[dhr]\b[^>]*>", " ", m[0], flags=_I)))
        elif got["box"]:
            if got["close"]:
                if len(stack) > 1 and any(n.name == got["box"].lower() for n in stack[1:]):
                    while stack[-1].name != got["box"].lower():
                        stack.pop()
                    stack.pop()
            elif got["box"].lower() != "body":
                node = Node(got["box"].lower())
                stack[-1].children.append(node)
                stack.append(node)
    pending.append(text[at:])
    flush()
    return root


def _paragraphs(raw: str) -> list[Block]:
    out = []
    for part in re.split(r"\x01|\n[ \t]*\n", raw):
        if content := html_inline(part):
            out.append(Block("paragraph", content, min(len(content), _linked(part))))
    return out


_ATX = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_BULLET = re.compile(r"^([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(\S.*)$")
_RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")


def _markdown_lines(raw: str) -> list[Block]:
    out: list[Block] = []
    para: list[str] = []
    code: list[str] = []
    in_list = False
    blank = True

    def end() -> None:
        if para:
            text = "\n".join(para)
            para.clear()
            if content := markdown_inline(text):
                out.append(Block("paragraph", content, min(len(content), _linked(text))))

    for line in [*raw.split("\n"), ""]:
        if ">" in line[:4]:
            line = re.sub(r"^ {0,3}(?:> ?)+", "", line)
        if not para and not in_list and (code or blank) and re.match(r"(?: {4}|\t)\S", line):
            code.append(line)
            blank = False
            continue
        if code and line.strip():
            out.append(Block("code", squeeze("\n".join(code))))
            code = []
        if not line.strip():
            end()
            blank = True
            continue
        if m := _ATX.match(line):
            end()
            in_list = False
            if content := markdown_inline(m[1] or ""):
                out.append(Block("heading", content, _linked(line)))
        elif para and re.match(r"^ {0,3}(?:=+|-+)[ \t]*$", line):
            content = markdown_inline("\n".join(para))
            para.clear()
            if content:
                out.append(Block("heading", content))
        elif _RULE.match(line):
            end()
            in_list = False
        elif m := _BULLET.match(line):
            end()
            in_list = True
            if content := markdown_inline(m[2]):
                out.append(Block("item", content, _linked(line)))
        elif re.match(r"^\s*\|.*\|\s*$", line):
            end()
            out.append(Block("table", markdown_inline(line.strip().strip("|").replace("|", " "))))
        elif in_list and not blank and line[:1] in " \t" and out and out[-1].kind == "item":
            out[-1].content = squeeze(out[-1].content + " " + markdown_inline(line))
        else:
            in_list = in_list and line[:1] in " \t"
            para.append(line)
        blank = False
    end()
    if code:
        out.append(Block("code", squeeze("\n".join(code))))
    return out


# ---------------------------------------------------------------- wiki

_TOP_WIKI = re.compile(
    r"(?P<skip><!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>)|<(?P<tag>pre|source|syntaxhighlight)\b[^>]*>(?P<code>.*?)</(?P=tag)\s*>"
    r"|<math\b[^>]*>(?P<math>.*?)</math\s*>|(?P<literal><nowiki>.*?</nowiki>)|^(?P<table>\{\|.*?^\|\})"
    r"|<h(?P<level>[1-6])\b[^>]*>(?P<head>.*?)</h(?P=level)\s*>|<li\b[^>]*>(?P<item>.*?)(?=<li\b|</li\b|</?[uo]l\b|\Z)",
    _S | _I | _M,
)


def _wiki(text: str) -> Node:
    root, pending, at, kept = Node(), [], 0, {}

    def flush() -> None:
        raw = "".join(pending)
        pending.clear()
        para: list[str] = []
        for line in [*raw.split("\n"), ""]:
            line = re.sub(r"\x02(\d+)\x02", lambda m: kept[int(m[1])], line) if "\x02" in line and not line.lstrip().startswith("\x02") else line
            m, item = _WIKI_HEAD.match(line), re.match(r"^[*#]+[:;]*[ \t]*(\S.*)$", line)
            if (m or item or not line.strip() or line.startswith("{|")) and para:
                body = re.sub(r"\x02(\d+)\x02", lambda k: kept[int(k[1])], "\n".join(para))
                para.clear()
                if content := wiki_inline(body):
                    root.children.append(Block("paragraph", content, min(len(content), sum(len(x) for x in re.findall(r"\[\[([^\]]*)\]\]", body)))))
            if m:
                if content := wiki_inline(m[2]):
                    root.children.append(Block("heading", content))
            elif item:
                if content := wiki_inline(item[1]):
                    root.children.append(Block("item", content))
            elif line.strip():
                para.append(line)

    for m in _TOP_WIKI.finditer(text):
        pending.append(text[at : m.start()])
        at = m.end()
        if m["skip"] is not None:
            continue
        if m["literal"] is not None:
            kept[len(kept)] = m[0]
            pending.append(f"\x02{len(kept) - 1}\x02")
            continue
        if m["math"] is not None:
            root.children.append(Block("formula", squeeze(m["math"])))
            pending.append(" ")
            continue
        flush()
        if m["code"] is not None:
            root.children.append(Block("code", squeeze(m["code"])))
        elif m["head"] is not None:
            root.children.append(Block("heading", wiki_inline(m["head"])))
        elif m["item"] is not None:
            root.children.append(Block("item", wiki_inline(m["item"])))
        else:
            root.children.append(Block("table", wiki_inline(re.sub(r"^[{|!][^\n]*?(?:\||$)|\|\||!!", " ", m[0], flags=_M))))
    pending.append(text[at:])
    flush()
    root.children = [b for b in root.children if not isinstance(b, Block) or b.content]
    return root


# ---------------------------------------------------------------- LaTeX

_TOP_TEX = re.compile(
    r"\\begin\{(?P<verb>verbatim\*?|lstlisting|minted|Verbatim)\}(?:[ \t]*\[[^\]]*\])?(?P<minted>(?<=minted\})\{[^}]*\})?(?P<code>.*?)\\end\{(?P=verb)\}"
    r"|(?P<comment>(?<!\\)%[^\n]*)|(?P<literal>\\verb\*?(?P<mark>[^\w\s]).*?(?P=mark))"
    r"|\\begin\{(?P<env>equation\*?|align\*?|gather\*?|displaymath|math|multline\*?|eqnarray\*?)\}(?P<maths>.*?)\\end\{(?P=env)\}"
    r"|\\\[(?P<display>.+?)\\\]|\\\((?P<inline>.+?)\\\)|\$\$(?P<double>.+?)\$\$|(?<!\\)\$(?P<single>[^$\n]+?)(?<!\\)\$"
    r"|\\begin\{(?P<tab>tabular\*?|table|array|longtable)\}.*?\\end\{(?P=tab)\}"
    r"|\\(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?[ \t]*(?:\[[^\]]*\])?[ \t]*" + _TEX_ARG.replace("((?:", "(?P<head>(?:", 1),
    _S,
)


def _latex(text: str) -> Node:
    root, pending, at = Node(), [], 0

    def flush() -> None:
        raw = "".join(pending)
        pending.clear()
        parts = re.split(r"(\\item\b(?:[ \t]*\[[^\]]*\])?|\\(?:begin|end)\{\w+\*?\}(?:\[[^\]]*\])?)", raw)
        in_item = False
        for part in parts:
            if part.startswith("\\item"):
                in_item = True
            elif re.match(r"\\(?:begin|end)\{", part):
                in_item = False
            else:
                # what follows a blank line after an item still belongs to it
                if in_item:
                    if content := latex_inline(part):
                        root.children.append(Block("item", content))
                    in_item = False
                else:
                    for para in re.split(r"\n[ \t]*\n", re.sub(r"\\(?:documentclass|usepackage)(?:\[[^\]]*\])?\{[^}]*\}", "", part)):
                        if content := latex_inline(para):
                            root.children.append(Block("paragraph", content))

    for m in _TOP_TEX.finditer(text):
        pending.append(text[at : m.start()])
        at = m.end()
        if m["comment"] is not None:
            continue
        if m["literal"] is not None:
            pending.append(re.sub(r"[\\{}%$]", " ", m[0][6:-1]))
            continue
        small = m["inline"] if m["inline"] is not None else m["single"]
        if small is not None:
            root.children.append(Block("formula", squeeze(small)))
            pending.append(" ")
            continue
        flush()
        maths = next((m[g] for g in ("maths", "display", "double") if m[g] is not None), None)
        if m["code"] is not None:
            root.children.append(Block("code", squeeze(m["code"])))
        elif maths is not None:
            root.children.append(Block("formula", squeeze(maths)))
        elif m["head"] is not None:
            if content := latex_inline(m["head"]):
                root.children.append(Block("heading", content))
        else:
            root.children.append(Block("table", latex_inline(re.sub(r"[&]|\\\\|\\begin\{\w+\}\{[^}]*\}|\\end\{\w+\}", " ", m[0]))))
    pending.append(text[at:])
    flush()
    root.children = [b for b in root.children if not isinstance(b, Block) or b.content]
    return root


# ---------------------------------------------------------------- tree scoring


def score_tree(root: Node) -> Node:
    """Give every container its points and return the best one."""
    best = root

    def visit(node: Node, above: list[Node]) -> None:
        for child in node.children:
            if isinstance(child, Node):
                visit(child, [node, *above])
            elif child.kind in ("paragraph", "item"):
                length = len(child.content)
                points = (1 + min(length / 100, 3) + sum(child.content.count(c) for c in ",，、；")) * (1 - min(1.0, child.links / max(1, length)))
                for depth, container in enumerate([node, *above][:3]):
                    container.score += points / (1, 2, 6)[depth]

    def look(node: Node) -> None:
        nonlocal best
        if node.score > best.score:
            best = node
        for child in node.children:
            if isinstance(child, Node):
                look(child)

    visit(root, [])
    look(root)
    return best


def _only_links(node: Node) -> bool:
    """Whether a container is little but links and holds no structure, or is a navigation part that is little but links."""
    blocks = list(node.blocks())
    size = sum(len(b.content) for b in blocks)
    if node.name not in ("nav", "aside", "footer", "header") and any(b.kind in CASES for b in blocks):
        return False
    return bool(size) and sum(b.links for b in blocks) > 0.8 * size and not any(b.kind in ("code", "formula") for b in blocks)


def main_blocks(root: Node) -> list[Block]:
    """The blocks of the best container and of the siblings that belong to it, in order.

    A sibling container belongs to it with a fifth of its points, or if it is not mostly links and
    longer than 80 characters; a sibling block if it is not mostly links.
    """
    best = score_tree(root)
    parent = next((n for n in _containers(root) if any(c is best for c in n.children)), None)
    if parent is None:
        return list(best.blocks())
    out: list[Block] = []
    for child in parent.children:
        if isinstance(child, Block):
            if child.links <= 0.5 * len(child.content):
                out.append(child)
            continue
        blocks = list(child.blocks())
        size, links = sum(len(b.content) for b in blocks), sum(b.links for b in blocks)
        if child is best or child.score >= 0.2 * best.score > 0 or size > 80 and links < 0.25 * size:
            out += blocks
    return out


def _containers(node: Node) -> Iterator[Node]:
    yield node
    for child in node.children:
        if isinstance(child, Node):
            yield from _containers(child)


def all_blocks(root: Node) -> list[Block]:
    """The blocks of every container that is more than links, wherever it stands, in order."""

    def walk(node: Node) -> Iterator[Block]:
        for child in node.children:
            if isinstance(child, Block):
                yield child
            elif not _only_links(child):
                yield from walk(child)

    return list(walk(root))


def read_tree(text: str | None) -> Node:
    """The tree of a text in any of the formats; empty for a null or blank text."""
    if not text or not text.strip():
        return Node()
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    form = markup_format(text)
    if form == "latex":
        return _latex(text)
    return _wiki(text) if form == "wiki" else _page(text, form == "markdown")


def read_blocks(text: str | None) -> list[Block]:
    """The blocks of a text's best container and its siblings."""
    return main_blocks(read_tree(text))


def text_blocks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, block, content): the blocks of every text's best container and siblings, in order.

    block is heading, item, code, formula, paragraph or table; content is without inline markup and
    with single spaces. A null, empty or blank text has no rows; repeated rows give their blocks
    each; a null key is kept. Other columns are ignored.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, i, b.kind, b.content) for k, t in zip(frame["_key"], frame["_text"]) for i, b in enumerate(read_blocks(t))]
            yield pd.DataFrame(found, columns=["_key", "position", "block", "content"])

    slim = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    return slim.mapInPandas(run, f"_key {kind}, position int, block string, content string").withColumnRenamed("_key", key)


def structure(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, content): the distinct headings, items, code blocks and formulas of each text's kept blocks."""
    return text_blocks(rows, key, text).where(F.col("block").isin(*CASES)).select(key, "block", "content").distinct()


def heading_text(raw: str | None) -> str | None:
    """A heading without the markup of whatever format it came from; null stays null."""
    if raw is None:
        return None
    for block in all_blocks(read_tree(raw)):
        return block.content
    return ""


def clean_document(text: str | None) -> str | None:
    """Clean text with Markdown marks for structure only: # for headings, - for items, fences and $$."""
    if text is None:
        return None
    marks = {"heading": ("# ", ""), "item": ("- ", ""), "code": ("```\n", "\n```"), "formula": ("$$", "$$")}
    return "\n\n".join(marks.get(b.kind, ("", ""))[0] + b.content + marks.get(b.kind, ("", ""))[1] for b in read_blocks(text))


def _mapped(rows: DataFrame, key: str, text: str, name: str, change: object) -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(change, na_action="ignore")  # type: ignore[call-overload]

    return rows.select(F.col(key), F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(F.col(text)).alias(name))


def clean_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, clean): each row's text cleaned, with marks for structure; null stays null, blank gives ''."""
    return _mapped(rows, key, text, "clean", clean_document)


def clean_headings(rows: DataFrame, key: str, heading: str) -> DataFrame:
    """(key, clean): each row's heading without markup; null stays null."""
    return _mapped(rows, key, heading, "clean", heading_text)
