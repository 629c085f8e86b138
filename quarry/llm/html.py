"""HTML extraction by layout-aware rendering: all visible text, with block spacing, lists and aligned table cells.

A tokenizer cuts markup into text, tags and comments by states: a quote opens a value only where a value begins; raw-text elements such
as script end only at their own end tag. The tree builder opens implied elements (tbody, tr), ends head at the first visible
content, closes what a start tag ends (p before a block, li before li, cells before cells, options, dt/dd), and lets an end tag close
down to its own element; one of a formatting element leaves blocks inside it open.

Visibility is computed: ``display:none``, ``hidden``, ``aria-hidden=true``, hidden inputs, elements that never show (script, style, template,
noscript, ...), dialogs without ``open`` and all but the summary of details without it take their subtree away; ``visibility`` is
inherited and may be turned on again inside. Text in math, in svg (but for its title, desc, defs and metadata) and in an object's fallback shows.

The renderer walks the tree with a stack of its own: white space collapses except in pre and textarea; br breaks; blocks stand on lines of
their own, and paragraphs, headings, lists and tables are set off by a blank line; list items have a bullet or their number, nested
ones are indented; images give their alternative text and text inputs their value; a table's cells, with col- and rowspans, are put
side by side with columns padded to equal width. A cell longer than ``CELL`` widens no column: it is kept whole and its row shifts.

Cases: null and empty pages give the empty text; elements that never end run to the end; a quoted value that never ends is read as
names up to the next ``>``; unknown entities stay as they are; repeated rows give repeated results; an empty table gives no rows.
Only the id, url and html columns are read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

CELL = 400
#: The standard's own limits.
COLSPAN, ROWSPAN = 1000, 65534
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link iframe noembed noframes canvas audio video datalist desc defs metadata annotation annotation-xml".split())
IN_HEAD = frozenset("head base link meta title style script noscript template".split())
FORMATTING = frozenset("a abbr b bdi bdo big cite code em font i ins del kbd mark nobr q s samp small span strike strong sub sup tt u var label".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre blockquote figure hr".split())
BLOCKS = SPACED | frozenset("html body div section article header footer nav main aside address fieldset form li dt dd tr caption figcaption details summary dialog center legend tbody thead tfoot option optgroup".split())
#: Start tag -> open elements that it ends, and elements beyond which it doesn't look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
ENDS_P = BLOCKS - {"html", "body", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup"}
#: An end tag doesn't close through these, but for those of the table's own parts.
WALLS = frozenset({"table", "td", "th", "template", "button", "object"})
PARTS = frozenset("table tr tbody thead tfoot td th body html".split())
SHOWN_INPUTS = frozenset(("", "text", "search", "email", "url", "tel", "number", "date", "time", "month", "week", "datetime-local", "submit", "button", "reset"))
SPACE = re.compile(r"[ \t\n\r\f\v]+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute: name, then a value in either quotes or up to a blank; a quote inside an unquoted value is part of it.
ATTR = re.compile(r"[\s/]*(=?[^\s/>=]+|=)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?\s*=?")
GAP = re.compile(r"[\s/]*")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
DIGITS = re.compile(r"\s*\+?0*([1-9]\d{0,8})")


@dataclass(slots=True)
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def displayed(self) -> bool:
        a = self.attrs
        if self.name in UNSEEN:
            return False
        if not a:
            return self.name != "dialog"
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or self.name == "dialog" and "open" not in a:
            return False
        return not ("style" in a and NO_DISPLAY.search(a["style"]))

    def visible(self, inherited: bool) -> bool:
        if "style" in self.attrs and (said := VISIBILITY.findall(self.attrs["style"])):
            return said[-1].lower() == "visible"
        return inherited

    def number(self, name: str, most: int) -> int:
        found = DIGITS.match(self.attrs.get(name, ""))
        return min(int(found[1]), most) if found else 1

    def inside(self) -> list[Node | str]:
        """The children that may show: closed details show their first summary alone."""
        if self.name == "details" and "open" not in self.attrs:
            return [c for c in self.children if isinstance(c, Node) and c.name == "summary"][:1]
        return self.children


def tokens(markup: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("start", name, attributes), ("end", name, {}), ("raw", text, {}) in order. Raw text follows its start tag."""
    at, held, n = 0, 0, len(markup)
    while (lt := markup.find("<", at)) >= 0 and lt + 1 < n:
        c = markup[lt + 1]
        if c == "!" or c == "?":
            if held < lt:
                yield "text", markup[held:lt], {}
            if markup.startswith("<!--", lt):
                stop = markup.find("-->", lt + 2)
                at = held = n if stop < 0 else stop + 3
            else:
                stop = markup.find(">", lt)
                at = held = n if stop < 0 else stop + 1
            continue
        name = NAME.match(markup, lt + 2 if c == "/" else lt + 1)
        if not name:
            at = lt + 1
            continue
        if held < lt:
            yield "text", markup[held:lt], {}
        at, attrs, said = name.end(), {}, name[0].lower()
        while m := ATTR.match(markup, at):
            at = m.end()
            attrs.setdefault(m[1].lower(), entities.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
        at = GAP.match(markup, at).end()
        held = at = min(n, at + 1)
        if c == "/":
            yield "end", said, {}
            continue
        yield "start", said, attrs
        if said in RAW:
            stop = re.compile(rf"</{re.escape(said)}(?=[\s/>])[^>]*>?", re.I).search(markup, at)
            yield "raw", markup[at : stop.start() if stop else n], {}
            held = at = stop.end() if stop else n
    if held < n:
        yield "text", markup[held:], {}


def parse(markup: str) -> Node:
    root = Node("#root")
    stack = [root]
    opened: Counter[str] = Counter()

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        stack.append(node)
        opened[node.name] += 1

    def cut(k: int) -> None:
        for x in stack[k:]:
            opened[x.name] -= 1
        del stack[k:]

    def end(names: set[str], walls: set[str] | frozenset[str]) -> None:
        """Close the nearest open element of names, and all in it, unless a wall stands between; again while there are."""
        while any(opened[x] for x in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in names:
                    cut(k)
                    break
                if stack[k].name in walls:
                    return

    def close(name: str) -> None:
        if not opened[name]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name == name:
                if name in FORMATTING and any(x.name in BLOCKS for x in stack[k + 1 :]):
                    opened[name] -= 1
                    del stack[k]
                else:
                    cut(k)
                return
            if stack[k].name in WALLS and name not in PARTS:
                return

    for kind, said, attrs in tokens(markup):
        if kind == "text":
            if stack[-1].name == "head" and said.strip():
                close("head")
            stack[-1].children.append(entities.unescape(said) if "&" in said else said)
        elif kind == "raw":
            raw = stack[-1].children[-1]
            raw.children.append(entities.unescape(said) if raw.name in ("textarea", "title") else said)
        elif kind == "end":
            close(said)
        else:
            if stack[-1].name == "head" and said not in IN_HEAD:
                close("head")
            if said in ENDS:
                end(*ENDS[said])
            elif said in ENDS_P:
                end({"p"}, WALLS)
            if said == "tr" and stack[-1].name == "table":
                push(Node("tbody"))
            if said in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
                if stack[-1].name == "table":
                    push(Node("tbody"))
                push(Node("tr"))
            node = Node(said, attrs)
            if said in VOID or said in RAW:
                stack[-1].children.append(node)
            else:
                push(node)
    return root


class Lines:
    """Text under way. gap: line ends owed before the next text; room: whether a blank is owed."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.gap, self.room, self.indent, self.lead = 0, False, 0, ""

    def text(self, s: str) -> None:
        words = SPACE.sub(" ", s)
        if words == " " or not words:
            self.room = self.room or bool(words)
            return
        if words[0] == " ":
            self.room = True
        self.write(words.strip(" "))
        self.room = words[-1] == " "

    def write(self, s: str) -> None:
        if self.gap or not self.out:
            if self.out:
                self.out.append("\n" * self.gap)
            self.out.append("  " * self.indent + self.lead)
            self.lead = ""
        elif self.room:
            self.out.append(" ")
        self.gap, self.room = 0, False
        self.out.append(s)

    def brk(self, n: int) -> None:
        if self.out and not self.lead:
            self.gap = max(self.gap, n)
        self.room = False

    def newline(self) -> None:
        self.gap, self.room = (self.gap + 1 if self.out else 0), False

    def verbatim(self, s: str) -> None:
        for k, line in enumerate(s.strip("\r\n").replace("\r\n", "\n").split("\n")):
            if k:
                self.gap = self.gap + 1 if self.out else 0
            if line.strip():
                self.write(line.rstrip())

    def done(self) -> str:
        return "".join(self.out)


def text_of(node: Node, visible: bool) -> str:
    """The text below a preformatted element, as it stands."""
    out: list[str] = []
    stack: list[tuple[Node | str, bool]] = [(c, visible) for c in reversed(node.inside())]
    while stack:
        x, seen = stack.pop()
        if isinstance(x, str):
            out.append(x if seen else "")
        elif x.name == "br":
            out.append("\n")
        elif x.name == "img":
            out.append(x.attrs.get("alt", "") if x.displayed() and x.visible(seen) else "")
        elif x.displayed():
            stack.extend((c, x.visible(seen)) for c in reversed(x.inside()))
    return "".join(out)


class Grid:
    """A table's rows: cells with their columns, those taken by rowspans above left free."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, str]]] = []
        self.below: dict[int, int] = {}  # column -> rows that a cell above still takes

    def row(self, cells: list[tuple[int, int, str]]) -> None:
        """cells: (colspan, rowspan, text)."""
        placed, col, held = [], 0, self.below
        self.below = {c: n - 1 for c, n in held.items() if n > 1}
        for across, down, text in cells:
            while col in held:
                col += 1
            placed.append((col, across, text))
            if down > 1:
                for c in range(col, col + across):
                    self.below[c] = down - 1
            col += across
        self.rows.append(placed)

    def write(self, to: Lines) -> None:
        wide: dict[int, int] = {}
        for row in self.rows:
            for col, across, text in row:
                if across == 1:
                    wide[col] = max(wide.get(col, 0), len(text) if len(text) <= CELL else 0)
        for row in self.rows:
            if not any(text for *_, text in row):
                continue
            parts, at = [], 0
            for k, (col, across, text) in enumerate(row):
                while at < col:  # taken from above, or a gap
                    parts.append(" " * wide.get(at, 0))
                    at += 1
                room = sum(wide.get(c, 0) for c in range(col, col + across)) + 3 * (across - 1)
                parts.append(text.ljust(room) if k + 1 < len(row) else text)
                at = col + across
            to.brk(1)
            to.write(" | ".join(parts).rstrip(" "))


class Renderer:
    """Walks a tree with a stack of nodes and of what is to be done when they end; depth is bounded by memory alone."""

    def __init__(self) -> None:
        self.outs = [Lines()]
        self.todo: list[tuple[Node | str, bool, list[int] | None, str, tuple] | Callable[[], None]] = []

    def run(self, root: Node) -> str:
        self.inside(root, True, None)
        while self.todo:
            job = self.todo.pop()
            if callable(job):
                job()
            else:
                self.node(*job)
        return self.outs[0].done()

    def inside(self, x: Node, visible: bool, ordered: list[int] | None, then: Callable[[], None] | None = None, part: tuple = ()) -> None:
        """Children of x, then a call. ordered: the counter of the list whose items they are; part: what of a table they are in."""
        if then:
            self.todo.append(then)
        self.todo.extend((c, visible, ordered, x.name, part) for c in reversed(x.inside()))

    def node(self, x: Node | str, visible: bool, ordered: list[int] | None, parent: str, part: tuple) -> None:
        to = self.outs[-1]
        if isinstance(x, str):
            if visible and not (part and not x.strip()):
                if part and part[0] == "row":
                    part[2].append((1, 1, SPACE.sub(" ", x).strip()))
                else:
                    to.text(x)
            return
        if not x.displayed():
            return
        name, visible = x.name, x.visible(visible)
        if part and part[0] == "row":
            cell = name in ("td", "th")
            self.outs.append(Lines())
            spans = (x.number("colspan", COLSPAN), x.number("rowspan", ROWSPAN)) if cell else (1, 1)
            self.todo.append(lambda: part[2].append((*spans, SPACE.sub(" ", self.outs.pop().done()))))
            if cell:
                self.inside(x, visible, None)
            else:
                self.todo.append((x, visible, None, "td", ()))
            return
        if part and name == "tr":
            cells: list[tuple[int, int, str]] = []
            self.inside(x, visible, None, lambda: part[1].row(cells), ("row", part[1], cells))
            return
        if part and name in ("tbody", "thead", "tfoot", "colgroup"):
            self.inside(x, visible, None, None, part)
            return
        if name == "br":
            to.newline()
        elif name == "img" or name == "input" and x.attrs.get("type", "").lower() == "image":
            if visible and x.attrs.get("alt"):
                to.text(x.attrs["alt"])
        elif name == "input":
            if visible and x.attrs.get("type", "").lower() in SHOWN_INPUTS and x.attrs.get("value"):
                to.text(x.attrs["value"])
        elif name != "wbr":
            self.element(x, name, visible, ordered, parent, to)

    def element(self, x: Node, name: str, visible: bool, ordered: list[int] | None, parent: str, to: Lines) -> None:
        space = 2 if name in SPACED else 1 if name in BLOCKS else 0
        nested = name in ("ul", "ol", "menu") and parent == "li"
        if space:
            to.brk(1 if nested else space)

        def ends() -> None:
            if space:
                to.brk(1 if nested else space)

        if name in ("pre", "textarea", "xmp"):
            to.verbatim(text_of(x, visible))
            ends()
        elif name == "table":
            grid = Grid()
            self.inside(x, visible, None, lambda: (grid.write(to), ends()), ("table", grid))
        elif name in ("ul", "ol", "menu"):
            start = re.fullmatch(r"\s*(-?\d{1,9})\s*", x.attrs.get("start", ""))
            to.indent += nested

            def leave() -> None:
                to.indent -= nested
                ends()

            self.inside(x, visible, [int(start[1]) if start else 1] if name == "ol" else None, leave)
        elif name == "li":
            mark = "- "
            if ordered is not None:
                mark, ordered[0] = f"{ordered[0]}. ", ordered[0] + 1
            to.lead = mark

            def unmark() -> None:
                to.lead = ""
                ends()

            self.inside(x, visible, None, unmark)
        else:
            self.inside(x, visible, None, ends)


def extract(markup: str | None) -> str:
    if not markup:
        return ""
    return Renderer().run(parse(markup.replace("\x00", "")))


NAMES = ("n_chars", "n_lines", "text_sha256", "text")


def texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, url, n_chars, n_lines, text_sha256, text)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [extract(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([len(t) for t in out], pa.int64()),
                    pa.array([t.count("\n") + 1 if t else 0 for t in out], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in out], pa.string()),
                    pa.array([t.encode("utf-8", "replace").decode() for t in out], pa.string()),
                ],
                names=["page_id", "url", *NAMES],
            )

    bounded_batches(pages.sparkSession, 128)
    kind = dict(pages.dtypes)[id_col]
    return pages.select(F.col(id_col).alias("page_id"), F.col("url").cast("string"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, n_chars long, n_lines long, text_sha256 string, text string")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "pages"))
