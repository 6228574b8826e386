"""Markup residue (HTML, Markdown, wiki, LaTeX, or a mix, escaped or malformed) to clean text that keeps structure.

A text is read once, left to right, into a tree: containers (HTML blocks; outside them the sections that headings begin; the page) hold blocks,
and blocks hold their text. Each paragraph passes points for its length and its commas to its container and, falling with the distance, to all
above; a container's points are discounted by its link density. The best container, the siblings that come near it, and what lies in these
without being a poor box, are kept as the clean text. Headings, list items, code blocks, formulas and tables are elements of the tree whichever
container wins; each is reported with whether it was kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LT, GT = r"(?:<|&(?:amp;)*lt;)", r"(?:>|&(?:amp;)*gt;)"
#: Attributes of any length, up to the tag's end; another tag's beginning ends the search, so reading stays linear.
NOT_GT = r"(?:(?![<>]|&(?:amp;)*[lg]t;)[\s\S])"
TAG = re.compile(rf"{LT}(/?)\s*([a-zA-Z][a-zA-Z0-9]*)((?:\s|/){NOT_GT}*)?{GT}")
COMMENT = re.compile(rf"{LT}!--[\s\S]*?(?:--{GT}|\Z)")
FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})[^\n`]*(?:\n|\Z)")
RULE = re.compile(r"[ \t]*([-*_])(?:[ \t]*\1){2,}[ \t]*(?:\n|\Z)")
HASH = re.compile(r"[ ]{0,3}(#{1,6})[ \t]*(?=[^\s#])([^\n]*)")
WIKI_HEAD = re.compile(r"[ ]{0,3}={2,6}[ \t]*(?=[^\s=])([^\n]*?)[ \t]*=*[ \t]*(?=\n|\Z)|[ ]{0,3}=[ \t]*(?=[^\s=])([^\n=]*?)[ \t]*=+[ \t]*(?=\n|\Z)")
SETEXT = re.compile(r"\n[ ]{0,3}(?:={2,}|-{2,})[ \t]*(?=\n|\Z)")
BULLET = re.compile(r"[ \t]*(?:[-*+•]|[*#]+)[ \t]+(?=\S)")
WIKI_ITEM = re.compile(r"[*#]+[:;]?[ \t]*(?=[^\s*#])")
NUMBERED = re.compile(r"[ \t]*(\d{1,3})[.)][ \t]+(?=\S)")
PAGE_MARK = re.compile(r"[ \t]*[-–—]\s*(?:\d{1,4}|[ivxlc]+)\s*[-–—][ \t]*(?:\n|\Z)")
TEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\s*(?:\[[^\]\n]*\])?\s*\{")
TEX_LEVEL = {"part": 1, "chapter": 2, "section": 3, "subsection": 4, "subsubsection": 5}
TEX_BEGIN = re.compile(r"\\begin\s*\{(\w+\*?)\}")
TEX_NOTE = re.compile(r"\\(?:footnote|cite\w*|label|ref)\s*(?:\[[^\]\n]*\])?\s*\{[^{}\n]*\}")
TEX_ITEM = re.compile(r"\\item\b(?:\[[^\]\n]*\])?")
INLINE_CODE = re.compile(r"(`{1,2})(?!`)[^`\n]+\1(?!`)")
DOLLAR = re.compile(r"\$(?=[^\s$])((?:\\.|[^$\\\n]|\n(?!\s*\n))+?)(?<=[^\s\\])\$(?![\w$])")
#: Names of environments and tags by what they hold.
CODE_ENVS, MATH_ENVS, TABLE_ENVS = {"verbatim", "lstlisting", "minted", "Verbatim", "alltt"}, {"equation", "equation*", "align", "align*", "displaymath", "math", "gather", "gather*", "eqnarray", "multline"}, {"tabular", "tabular*", "tabularx", "longtable", "array"}
CODE_TAGS, CONTAINER_TAGS = {"pre", "syntaxhighlight", "source"}, {"div", "section", "article", "main", "nav", "aside", "header", "footer", "body", "td", "blockquote", "ul", "ol", "form"}
PARAGRAPH_TAGS = {"p", "br", "dd", "dt", "figcaption"}


#: Boxes stand beside or within what a page is about; their points begin below others'.
BESIDE = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*[\"']?[^\"'>]*\b(?:sidebar|side|ads?|advert\w*|banner|promo\w*|newsletter|subscribe|menu|nav\w*|breadcrumbs?|footer|comments?|related|share|social|cookies?|popup|sponsor\w*|widget)\b")
BOXES, ASIDE = {"div", "nav", "aside", "header", "footer", "form", "td"}, {"nav", "aside", "header", "footer", "form"}


class Node:
    """A container; ``level`` is that of a section's heading, 0 for HTML containers and the page."""

    __slots__ = ("tag", "parent", "level", "aside", "points", "chars", "link_chars", "structure", "prose", "kept")

    def __init__(self, tag: str, parent: Node | None, level: int = 0, attributes: str = ""):
        self.tag, self.parent, self.level, self.aside = tag, parent, level, tag in ASIDE or bool(attributes and BESIDE.search(attributes))
        self.points, self.chars, self.link_chars, self.structure, self.prose, self.kept = -3.0 if self.aside else 0.0, 0, 0, False, False, None

    @property
    def density(self) -> float:
        return self.link_chars / self.chars if self.chars else 0.0

    @property
    def value(self) -> float:
        return self.points * (1 - self.density)


class Block:
    __slots__ = ("kind", "node", "parts", "links", "start")

    def __init__(self, kind: str, node: Node, start: int):
        self.kind, self.node, self.parts, self.links, self.start = kind, node, [], 0, start

    def text(self) -> str:
        t = "".join(self.parts)
        return t.strip("\n") if self.kind in ("code_block", "table", "formula") else " ".join(t.split())


def _unescaped(t: str) -> str:
    for _ in range(3):
        u = html.unescape(t)
        if u == t:
            break
        t = u
    return t


NOTE_MARK = re.compile(r"\[\^\w+\]")
MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\([^)\[\n]*\)")
WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]")
URL_LINK = re.compile(r"\[https?://\S+ ([^\]\n]*)\]")
TEMPLATE = re.compile(r"\{\{(?:[^{}|\n]*\|)?([^{}\n]*)\}\}")
TEX_STYLE = re.compile(r"\\(?:textbf|textit|emph|texttt|underline|textsc)\s*\{([^{}]*)\}")
QUOTES = re.compile(r"'{2,5}")
STRONG = re.compile(r"(\*\*|__|~~)(?=\S)((?:(?!\1).)+)(?<=\S)\1")
EMPHASIS = re.compile(r"(?<![\w*])([*_])(?=[^\s*_])([^*_\n]+?)(?<=[^\s*_])\1(?![\w*])")
TICKS = re.compile(r"`([^`\n]+)`")
TEX_ESCAPE = re.compile(r"\\([#$%&_{}])")
TILDE = re.compile(r"(?<!\\)~")
MARKED = re.compile(r"[\[{\\'*_~`&]")


def _plain(t: str) -> str:
    """Inline marks taken off a stretch of running text; each pattern is tried only where its sign stands."""
    if not MARKED.search(t):
        return t
    if "[" in t:
        t = NOTE_MARK.sub("", t)
        t = MD_LINK.sub(r"\1", t)
        t = WIKI_LINK.sub(r"\1", t)
        t = URL_LINK.sub(r"\1", t)
    if "{{" in t:
        t = TEMPLATE.sub(r"\1", t)
    if "\\" in t:
        t = TEX_STYLE.sub(r"\1", t)
    if "''" in t:
        t = QUOTES.sub("", t)
    if "**" in t or "__" in t or "~~" in t:
        t = STRONG.sub(r"\2", t)
    if "*" in t or "_" in t:
        t = EMPHASIS.sub(r"\2", t)
    if "`" in t:
        t = TICKS.sub(r"\1", t)
    if "\\" in t:
        t = TEX_ESCAPE.sub(r"\1", t)
        if "\\" in t:
            t = TILDE.sub(" ", t)
    return _unescaped(t) if "&" in t else t


def _close(text: str, pos: int, pattern: re.Pattern, else_blank: bool) -> tuple[int, int]:
    """Where the content ends and where reading goes on; unclosed content ends at the next blank line or the end."""
    m = pattern.search(text, pos)
    if m:
        return m.start(), m.end()
    if else_blank and (m := re.compile(r"\n[ \t]*\n").search(text, pos)):
        return m.start(), m.start()
    return len(text), len(text)


class Reader:
    """Reads one text into blocks; ``blocks`` are in reading order."""

    def __init__(self, text: str):
        self.t, self.pos = text, 0
        self.root = Node("page", None)
        self.node, self.blocks, self.open = self.root, [], None
        self.in_list = False
        self.wiki = bool(re.search(r"(?m)^={2,6}[^=\n]+=+\s*$|'''|\[\[|^\{\||<syntaxhighlight", text)) and not re.search(r"(?m)^[ ]{0,3}#{2,6}\s*\w|^[ ]{0,3}(?:`{3}|~{3})|\*\*", text)

    def start(self, kind: str, at: int) -> Block:
        b = Block(kind, self.node, at)
        self.blocks.append(b)
        self.open = None if kind in ("code_block", "table", "formula") else b
        return b

    def say(self, s: str, link: bool = False) -> None:
        if not s:
            return
        if self.open is None:
            if not s.strip():
                return
            self.start("paragraph", self.pos)
        self.open.parts.append(s)
        if link:
            self.open.links += len(s)

    def element(self, kind: str, at: int, content: str) -> None:
        held = self.open
        b = self.start(kind, at)
        b.parts.append(_unescaped(content) if kind == "code_block" else content)
        self.open = held if kind == "formula" and held is not None else None

    def read(self) -> list[Block]:
        t, n = self.t, len(self.t)
        fresh = True  # the line before is blank, or begins with an element
        while self.pos < n:
            if self.pos == 0 or t[self.pos - 1] == "\n":
                moved, fresh = self.line_start(fresh)
                if moved:
                    continue
            self.inline()
        return self.blocks

    def line_start(self, fresh: bool) -> tuple[bool, bool]:
        t, p = self.t, self.pos
        eol = t.find("\n", p)
        eol = len(t) if eol < 0 else eol
        if not t[p:eol].strip():
            self.open, self.pos, self.in_list = None, min(eol + 1, len(t)), self.in_list
            return True, True
        if m := FENCE.match(t, p):
            mark = m[1]
            end, go = _close(t, m.end(), re.compile(rf"(?m)^[ \t]*{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$\n?"), False)
            self.element("code_block", p, t[m.end() : end])
            self.pos = go
            return True, True
        if t.startswith("{|", p):
            end, go = _close(t, p + 2, re.compile(r"(?m)^[ \t]*\|\}"), True)
            self.element("table", p, t[p:go])
            self.pos = go
            return True, True
        if t[p:eol].lstrip().startswith("|"):
            end = p
            for m in re.compile(r"[ \t]*\|[^\n]*(?:\n|\Z)").finditer(t, p):
                if m.start() != end or not m[0]:
                    break
                end = m.end()
            if t[p:end].strip().count("|") >= 3:
                self.element("table", p, t[p:end])
                self.pos = end
                return True, True
        if PAGE_MARK.match(t, p):
            self.pos = eol
            self.say(_plain(t[p:eol]))
            return True, False
        line = t[p:eol]
        piped = "|" in line and (nl := t.find("\n", eol + 1) if eol < len(t) else -1) and re.fullmatch(r"[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+", t[eol + 1 : nl if nl >= 0 else len(t)])
        if piped:
            end = len(t)
            if m := re.compile(r"\n(?![^\n]*\|)").search(t, p):
                end = m.start() + 1
            self.element("table", p, t[p:end])
            self.pos = end
            return True, True
        if m := RULE.match(t, p):
            self.open, self.pos = None, m.end()
            return True, True
        follows = t[eol + 1 : (t.find("\n", eol + 1) if t.find("\n", eol + 1) >= 0 else len(t))] if eol < len(t) else ""
        if m := HASH.match(t, p):
            run = m[1] == "#" and m[2] and line.lstrip().startswith("# ") and (self.wiki or re.match(r"[ ]{0,3}#[ \t]+\S", follows) or self.in_list)
            if not run or (m[1] != "#" and not self.wiki):
                self.heading(p, m.start(2), len(m[1]))
                return True, True
        if (m := WIKI_HEAD.match(t, p)) and (m[1] or m[2]):
            self.heading(p, m.start(1) if m[1] else m.start(2), max(len(line) - len(line.lstrip(" =")), 1))
            return True, True
        if fresh and (m := SETEXT.match(t, eol)) and not BULLET.match(t, p) and not NUMBERED.match(t, p) and not re.match(rf"[ \t]*(?:{LT}|\\)", line):
            self.heading(p, p, 1 if "=" in m[0] else 2)
            self.setext = m.end()
            stop = eol
            while self.pos < stop:
                self.inline(stop)
            self.pos, self.open, self.in_list = m.end(), None, False
            return True, True
        m = BULLET.match(t, p)
        if not m and self.wiki:
            m = WIKI_ITEM.match(t, p)
        if m and (fresh or self.in_list):
            self.start("list_item", p)
            self.pos, self.in_list = m.end(), True
            return True, False
        if (m := NUMBERED.match(t, p)) and ((fresh and m[1] == "1") or self.in_list):
            self.start("list_item", p)
            self.pos, self.in_list = m.end(), True
            return True, False
        if line.lstrip().startswith("%") and "\\" in t:
            self.pos = eol
            return True, fresh
        if re.match(r"[ ]{0,3}\[\^\w+\]:", line):
            self.pos = eol
            return True, fresh
        if fresh:
            self.in_list = False
        return False, False

    def heading(self, at: int, text_at: int, level: int) -> None:
        """A heading, and the section it begins; within an HTML container it begins none."""
        node = self.node
        while node.level >= level and node.parent is not None:
            node = node.parent
        if node.level or node.parent is None:
            self.node = Node("#", node, level)
        self.start("heading", at)
        self.pos, self.in_list = text_at, False

    NEXT = re.compile(r"<|&(?:amp;)*lt;|\\|\$|`|\n|\]\(|\[\[")

    def inline(self, stop: int | None = None) -> None:
        t, p = self.t, self.pos
        m = self.NEXT.search(t, p)
        at = min(m.start() if m else len(t), len(t) if stop is None else stop)
        if at > p:
            self.say(t[p:at])
            self.pos = at
            return
        if p >= len(t) or (stop is not None and p >= stop):
            return
        c = t[p]
        if c == "\n":
            self.pos += 1
            if self.open is not None and self.open.kind == "heading":
                self.open = None
            else:
                self.say("\n")
            return
        if c == "`" and (m := INLINE_CODE.match(t, p)):
            self.say(m[0])
            self.pos = m.end()
            return
        if c == "$":
            if t.startswith("$$", p):
                end, go = _close(t, p + 2, re.compile(r"\$\$"), True)
                self.element("formula", p, t[p:go])
                self.pos = go
                return
            if (p == 0 or t[p - 1] not in "\\$") and (m := DOLLAR.match(t, p)):
                self.element("formula", p, m[0])
                self.pos = m.end()
                return
        if c == "\\":
            if t.startswith("\\[", p) or t.startswith("\\(", p):
                close = r"\\\]" if t[p + 1] == "[" else r"\\\)"
                end, go = _close(t, p + 2, re.compile(close), True)
                self.element("formula", p, t[p:go])
                self.pos = go
                return
            if m := TEX_BEGIN.match(t, p):
                name = m[1]
                if name in CODE_ENVS or name in MATH_ENVS or name in TABLE_ENVS:
                    end, go = _close(t, m.end(), re.compile(rf"\\end\s*\{{{re.escape(name)}\}}"), name not in CODE_ENVS)
                    kind = "code_block" if name in CODE_ENVS else "formula" if name in MATH_ENVS else "table"
                    self.element(kind, p, t[m.end() : end] if kind == "code_block" else t[p:go])
                    self.pos = go
                    return
                self.open, self.pos = None, m.end()
                return
            if m := re.compile(r"\\end\s*\{\w+\*?\}").match(t, p):
                self.open, self.pos = None, m.end()
                return
            if m := TEX_HEAD.match(t, p):
                self.heading(p, m.end(), TEX_LEVEL.get(m[0].lstrip("\\").split("{")[0].split("[")[0].strip(" *"), 6))
                end = p_end = m.end()
                depth = 1
                while p_end < len(t) and depth and t[p_end] != "\n":
                    depth += {"{": 1, "}": -1}.get(t[p_end], 0)
                    p_end += 1
                end = p_end - 1 if depth == 0 else p_end
                while self.pos < end:
                    self.inline(end)
                self.pos, self.open = p_end, None
                return
            if m := TEX_ITEM.match(t, p):
                self.start("list_item", p)
                self.pos = m.end()
                return
            if m := TEX_NOTE.match(t, p):
                self.pos = m.end()
                return
        if (m := COMMENT.match(t, p)) is not None:
            self.pos = m.end()
            return
        if (c == "<" or c == "&") and (m := TAG.match(t, p)):
            self.tag(m)
            return
        self.say(c)
        self.pos += 1

    def tag(self, m: re.Match) -> None:
        t, closing, name, at = self.t, bool(m[1]), m[2].lower(), m.start()
        self.pos = m.end()
        if re.fullmatch(r"h[1-6]", name):
            if closing:
                self.open = None
            else:
                self.heading(at, self.pos, int(name[1]))
        elif name in CODE_TAGS and not closing:
            end, go = _close(t, m.end(), re.compile(rf"(?i){LT}/\s*{name}\s*{GT}"), False)
            self.element("code_block", at, re.sub(rf"(?i)^\s*{LT}code{NOT_GT}*{GT}|{LT}/code\s*{GT}\s*$", "", t[m.end() : end]))
            self.pos = go
        elif name == "math" and not closing:
            end, go = _close(t, m.end(), re.compile(rf"(?i){LT}/\s*math\s*{GT}"), True)
            self.element("formula", at, t[m.end() : end])
            self.pos = go
        elif name == "table" and not closing:
            end, go = _close(t, m.end(), re.compile(rf"(?i){LT}/\s*table\s*{GT}"), True)
            self.element("table", at, t[at:go])
            self.pos = go
        elif name in ("ref", "script", "style") and not closing and not (m[3] or "").rstrip().endswith("/"):
            _, self.pos = _close(t, m.end(), re.compile(rf"(?i){LT}/\s*{name}\s*{GT}"), True)
        elif name == "a" and not closing:
            end, go = _close(t, m.end(), re.compile(rf"(?i){LT}/\s*a\s*{GT}"), True)
            self.say(t[m.end() : end], link=True)
            self.pos = go
        elif name == "li":
            if closing:
                self.open = None
            else:
                self.start("list_item", at)
        elif name in CONTAINER_TAGS:
            self.open = None
            if not closing:
                self.node = Node(name, self.node, 0, m[3] or "")
            else:
                node = self.node
                while node is not None and node.tag != name:
                    node = node.parent
                self.node = node.parent if node is not None and node.parent is not None else self.node
        elif name in PARAGRAPH_TAGS:
            if name != "br":
                self.open = None
            else:
                self.say(" ")


LINKED = re.compile(r"\[([^\[\]\n]*)\]\([^)\[\n]*\)|\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]")
ENDS = re.compile(r"[.!?][\"'”’»)\]}*_]*(?:\s|$)")


def score_tree(blocks: list[Block], texts: list[str]) -> None:
    """Sets ``kept`` of every container by the points of its paragraphs.

    A paragraph of 25 characters or more gives its container a point, one for each comma and up to three for its length; half of that goes to the container
    above, and a third by the distance to those beyond. The best container wins. What stands beside it is kept if it reaches a fifth of its value, or is not
    marked as standing aside and holds structure or prose that is not made of links. Within what is kept, a box (div, aside, nav and the like) needs a fifth of the best
    value beside it, unless it is not marked as standing aside and holds structure or prose, and anything else less than half links (a list less than four fifths). What stands directly above the winner is kept where it is an element or prose.
    """
    nodes: dict[int, Node] = {}
    children: dict[int, list[Node]] = {}
    for b, text in zip(blocks, texts):
        n, links = len(text), b.links
        if "](" in text or "[[" in text:
            links += sum(len(m[1] or m[2] or "") for m in LINKED.finditer(text))
        running = b.kind in ("paragraph", "list_item")
        points = 1 + text.count(",") + min(n / 100, 3) if n >= 25 and running else 0
        b.links = links
        node, up = b.node, 0
        structure, prose = b.kind in ("code_block", "table", "formula") or (b.kind == "list_item" and links < n / 2), running and _prose(n, links, text)
        while node is not None:
            node.structure, node.prose = node.structure or structure, node.prose or prose
            structure, prose = structure and not node.aside, prose and not node.aside
            if id(node) not in nodes:
                nodes[id(node)] = node
                if node.parent is not None:
                    children.setdefault(id(node.parent), []).append(node)
            node.chars += n
            node.link_chars += links
            node.points += points if up == 0 else points / 2 if up == 1 else points / (3 * up)
            node, up = node.parent, up + 1
    if not nodes:
        return
    best = max(nodes.values(), key=lambda x: x.value)

    def near(x: Node, of: float) -> bool:
        return x.value >= max(0.2 * of, min(2.0, of / 2))

    def within(x: Node) -> None:
        """Keeps x; of what lies in it, all but poor boxes and link lists."""
        x.kept = True
        stack = [x]
        while stack:
            held = stack.pop()
            below = children.get(id(held), [])
            most = max((c.value for c in below), default=0.0)
            for c in below:
                if c.kept is None:
                    c.kept = held.kept and c.density <= (0.8 if c.tag in ("ul", "ol") else 0.5) and (c.tag not in BOXES or ((c.structure or c.prose) and not c.aside) or near(c, max(most, held.value)))
                stack.append(c)

    def beside(x: Node) -> bool:
        return near(x, best.value) or (not x.aside and x.density < 0.33 and (x.structure or x.prose))

    within(best)
    for x in children.get(id(best.parent), []) if best.parent is not None else ():
        if x is not best and beside(x):
            within(x)
    # sections above the winner have no paragraphs of their own to decide by, but their headings and prose lead up to it
    up = best.parent
    while up is not None:
        up.kept = False
        for x in children.get(id(up), []):
            if x.kept is None and beside(x):
                within(x)
        up = up.parent


def _prose(n: int, links: int, text: str) -> bool:
    """Running text that is not made of links: long, or with the end of a sentence and next to no links."""
    return (n > 80 and links < 0.25 * n) or (links <= 0.1 * n and ENDS.search(text) is not None)


def keeps(b: Block, text: str) -> bool:
    """Whether a block is kept: its container is, or stands above the winner and the block is an element or prose, not made of links."""
    if b.node.kept:
        return True
    return b.node.kept is False and b.node.tag in ("page", "#", "body", "main", "article", "section") and (b.kind != "paragraph" or _prose(len(text), b.links, text)) and 2 * b.links <= len(text) and _above(b.node)


def _above(node: Node) -> bool:
    """Whether no container from here up was left out as a box."""
    while node is not None:
        if node.aside:
            return False
        node = node.parent
    return True


def _table_rows(t: str) -> str:
    t = _unescaped(t)
    if re.search(r"(?i)<t[rdh]\b", t):
        rows = [re.findall(r"(?is)<t[dh][^>]*>(.*?)(?=</?t[dhr]\b|</table|\Z)", r) for r in re.split(r"(?i)<tr\b[^>]*>", t)[1:]]
        rows = [[re.sub(r"<[^>]+>", "", c).strip() for c in r] for r in rows]
    elif "\\begin" in t:
        body = re.sub(r"\\(?:begin|end)\s*\{tabular\*?\}(?:\{[^{}]*\})?|\\hline", "", t)
        rows = [[c.strip() for c in r.split("&")] for r in body.split("\\\\") if r.strip()]
    elif t.lstrip().startswith("{|"):
        rows = [re.findall(r"(?m)^[|!](?![-}])\s*(.*)$", r) for r in re.split(r"(?m)^\|-.*$", t)]
        rows = [[c.strip() for x in r for c in re.split(r"\|\||!!", x)] for r in rows if r]
    else:
        rows = [[c.strip() for c in r.strip().strip("|").split("|")] for r in t.strip().split("\n") if not re.fullmatch(r"[\s|:-]+", r)]
    return "\n".join(" | ".join(r) for r in rows if r)


def convert(text: str | None) -> tuple[str, list[tuple[str, str, bool]]]:
    """The clean text, and (kind, text, kept) of each element set by markup, in reading order."""
    if not text or not text.strip():
        return "", []
    blocks = sorted(Reader(text.replace("\r\n", "\n").replace("\r", "\n")).read(), key=lambda b: b.start)
    texts = [b.text() for b in blocks]
    if "" in texts:
        blocks, texts = zip(*[(b, t) for b, t in zip(blocks, texts) if t or b.kind != "paragraph"]) if any(t or b.kind != "paragraph" for b, t in zip(blocks, texts)) else ((), ())
    score_tree(blocks, texts)
    out, elements = [], []
    for b, t in zip(blocks, texts):
        keep = keeps(b, t)
        if b.kind == "code_block":
            shown = "```\n" + t + "\n```"
        elif b.kind == "table":
            t = shown = _table_rows(t)
        elif b.kind == "formula":
            t = re.sub(r"^(?:\$\$?|\\\[|\\\(|\\begin\{[^}]*\})\s*|\s*(?:\$\$?|\\\]|\\\)|\\end\{[^}]*\})$", "", _unescaped(t).strip())
            shown = f"${t}$"
        else:
            t = _plain(t)
            if b.kind == "heading":
                t = re.sub(r"\s*[#=]+\s*$", "", t)
            shown = {"heading": "# ", "list_item": "- "}.get(b.kind, "") + t
        if b.kind != "paragraph":
            elements.append((b.kind, t, keep))
        if keep and shown:
            out.append(shown)
    return "\n\n".join(out), elements


def _convert_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        done = [convert(t) for t in pdf["text"]]
        yield pd.DataFrame({
            "id": pdf["id"], "field": pdf["field"], "clean_text": [d[0] for d in done],
            "elements": [[{"ordinal": i + 1, "kind": k, "text": t, "kept": w} for i, (k, t, w) in enumerate(d[1])] for d in done],
        })


def markup_to_text(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``id, field, clean_text, elements`` (array of ordinal, kind, text, kept) for each row and each text column in ``fields``.

    Kinds are heading, list_item, code_block, formula, table. A null or blank text gives '' and no elements; rows with a
    null id are converted like others; repeated rows give repeated results; extra columns are ignored. Unclosed code runs to the
    end of the text, other unclosed elements to the next blank line. Work is linear in the length of a text.
    """
    kind = df.schema[id_col].dataType.simpleString()
    long = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")).select("id", "x.field", "x.text")
    return long.mapInPandas(_convert_batches, f"id {kind}, field string, clean_text string, elements array<struct<ordinal:int,kind:string,text:string,kept:boolean>>")
