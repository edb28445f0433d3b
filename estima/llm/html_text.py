"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder (void elements, raw text, implied end tags and table parts, stray end tags) make a tree.
Visibility rules leave out what a browser doesn't show: head, scripts, templates, hidden elements, closed details, and
what inline styles or the rules of <style> hide (css.py). The rest is laid out: a line for each block, a blank line around paragraphs,
headings, lists and tables, list markers with indents, preformatted text as it is, table cells in aligned columns.
No step recurses, so the depth of a page doesn't matter.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from estima.llm import css
from estima.llm.common import row_chunks

# HTML's element categories.
VOID = frozenset("area base basefont bgsound br col command embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript plaintext".split())
ESCAPABLE_RAW = frozenset("textarea title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr caption ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr listing menu ol p pre table ul dir fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p pre search section summary table ul li dd dt".split())
HIDDEN = frozenset("head script style template noscript noembed noframes iframe object applet audio video canvas datalist title meta link base area param source track map colgroup col rp".split())
#: What isn't drawn inside an svg or math element, beside HIDDEN.
HIDDEN_IN = {
    "svg": frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split()),
    "math": frozenset(["annotation", "annotation-xml", "mphantom"]),
}
#: What holds HTML again inside an svg or math element; which start tags end one; what stands on a line of its own there.
HTML_AGAIN = frozenset("foreignobject mi mo mn ms mtext".split())
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
OWN_LINE = {"svg": frozenset(["text"]), "math": frozenset(["mtr", "mlabeledtr"])}
PREFORMATTED = frozenset("pre listing textarea xmp plaintext".split())
#: A start tag ends the open elements of the first set that it finds before one of the second.
IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset("tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "caption": (frozenset("tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "colgroup": (frozenset("tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
    "rp": (frozenset(["rp", "rt"]), frozenset(["ruby"])),
    "rt": (frozenset(["rp", "rt"]), frozenset(["ruby"])),
}
HEAD_PARTS = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
#: An end tag looks no further than these for its start.
SCOPE = frozenset("table td th caption html template".split())

WIDEST = 80  # of a column that is padded; a wider cell stands as it is
DEEPEST = 24  # levels that are indented
# The most columns and rows that a cell may cover.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|([!?/]))")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_COMMENT_END = re.compile(r"--!?>")
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "within")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, within: str = ""):
        self.tag, self.attributes, self.children = tag, attributes or {}, []
        self.within = within  # svg or math, where it is of that language

    def language_inside(self) -> str:
        return self.tag if self.tag in ("svg", "math") else "" if self.tag in HTML_AGAIN else self.within

    def never_shown(self) -> bool:
        return self.tag in HIDDEN or self.tag in HIDDEN_IN.get(self.within, ())


def _tokens(source: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text" | "start" | "end" | "style" | "closed", name or text, attributes); closed: the start tag before ended with a slash."""
    at, n = 0, len(source)
    foreign = 0  # svg and math elements that are open, about
    quotes = {'"': 0, "'": 0}  # where the next one was last found; n once there is none
    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            yield "text", source[at:], {}
            return
        if m.start() > at:
            yield "text", source[at : m.start()], {}
        at = m.end()
        if m[3]:
            end = _COMMENT_END.search(source, at - 2)
            at = end.end() if end else n
        elif m[4]:
            end = source.find(">", at)
            at = end + 1 if end >= 0 else n
        else:
            name, attributes = m[2].lower(), {}
            while True:
                a = _ATTRIBUTE.match(source, at)
                if a is None or a.end() == at:
                    break
                if a[4] and a[4][0] in quotes and quotes[q := a[4][0]] < n:  # a quote without an end: its value stops at the tag's
                    quotes[q] = n
                attributes.setdefault(a[1].lower(), a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or "")
                at = a.end()
            end = source.find(">", at)
            if end < 0:
                return
            closed = source[at:end].rstrip().endswith("/")
            at = end + 1
            if m[1]:
                foreign -= foreign > 0 and name in ("svg", "math")
                yield "end", name, {}
                continue
            yield "start", name, attributes
            if closed and (foreign or name in ("svg", "math")):
                yield "closed", name, {}
                if foreign and (name in RAW or name in ESCAPABLE_RAW):
                    continue
            elif name in ("svg", "math"):
                foreign += 1
            if name in RAW or name in ESCAPABLE_RAW:
                if closed and name not in ("script", "style", "textarea", "title"):
                    yield "end", name, {}
                    continue
                stop = None if name == "plaintext" else re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                raw = source[at : stop.start() if stop else n]
                if name == "style":
                    yield "style", raw, attributes
                elif name in ESCAPABLE_RAW:
                    yield "text", raw, {}
                elif name in ("xmp", "plaintext"):
                    yield "text", html.escape(raw), {}
                end = source.find(">", stop.start()) if stop else -1
                at = end + 1 if end >= 0 else n
                yield "end", name, {}


def build_tree(source: str) -> tuple[Node, list[str]]:
    """The tree, and the style sheets in it that are for a screen."""
    root = Node("html")
    open_ = [root]
    counts: dict[str, int] = {}  # of open elements by tag, so that most searches of the stack are spared
    styles: list[str] = []

    def push(tag: str, attributes: dict[str, str] | None = None) -> None:
        node = Node(tag, attributes, open_[-1].language_inside())
        open_[-1].children.append(node)
        open_.append(node)
        counts[tag] = counts.get(tag, 0) + 1

    def pop_to(depth: int) -> None:
        while len(open_) > depth:
            counts[open_.pop().tag] -= 1

    def end_if_open(ends: frozenset[str], barriers: frozenset[str]) -> None:
        if any(counts.get(t) for t in ends):
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag in ends:
                    pop_to(i)
                elif open_[i].tag in barriers:
                    return

    for kind, value, attributes in _tokens(source):
        if kind == "text":
            text = html.unescape(value) if "&" in value else value
            if open_[-1].tag == "head" and text.strip():
                pop_to(len(open_) - 1)
            open_[-1].children.append(text)
        elif kind == "style":
            if attributes.get("type", "text/css").strip().lower() in ("", "text/css") and css.holds_on_screen(attributes.get("media", "")):
                styles.append(value)
        elif kind == "start":
            if value == "html":
                root.attributes = attributes | root.attributes
                continue
            if value in BREAKS_OUT and open_[-1].language_inside():
                while open_[-1].language_inside():
                    pop_to(len(open_) - 1)
            if counts.get("head") and value not in HEAD_PARTS and open_[-1].tag == "head":
                pop_to(len(open_) - 1)
            if value == "body" and counts.get("body"):
                continue
            if value in CLOSES_P and counts.get("p"):
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].tag == "p":
                        pop_to(i)
                        break
                    if open_[i].tag in SCOPE or open_[i].tag in ("button", "object"):
                        break
            if value in IMPLIED_END:
                end_if_open(*IMPLIED_END[value])
            if value in ("td", "th") and counts.get("table"):
                if open_[-1].tag in ("table", "tbody", "thead", "tfoot"):
                    if open_[-1].tag == "table":
                        push("tbody")
                    push("tr")
            elif value == "tr" and open_[-1].tag == "table":
                push("tbody")
            if value == "a" and counts.get("a"):  # links don't nest
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].tag == "a":
                        pop_to(i)
                        break
                    if open_[i].tag in SCOPE or open_[i].tag in BLOCK:
                        break
            push(value, attributes)
            if value in VOID:
                pop_to(len(open_) - 1)
        elif kind == "closed":
            if open_[-1].tag == value and (open_[-1].within or value in ("svg", "math")):
                pop_to(len(open_) - 1)
        elif counts.get(value):
            for i in range(len(open_) - 1, 0, -1):
                tag = open_[i].tag
                if tag == value:
                    pop_to(i)
                    break
                if tag in SCOPE and value not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or (tag in BLOCK and value not in BLOCK):
                    break
        elif value == "br":
            open_[-1].children.append(Node("br"))
    return root, styles


class Styles:
    """Display and visibility from hidden attributes, inline styles and the page's rules, as the cascade has them."""

    def __init__(self, root: Node, sheets: list[str]):
        rules = css.Rules(sheets)
        self.said = rules.of_tree(root) if rules.said else {}

    def of(self, node: Node) -> tuple[bool, bool | None]:
        """Whether the element is displayed; whether its own text is visible, None if inherited."""
        a = node.attributes
        if node.never_shown() or node.tag == "input" and a.get("type", "").lower() == "hidden":
            return False, None
        shown = not ("hidden" in a or node.tag == "dialog" and "open" not in a)
        said = self.said.get(id(node), [])
        if not said and "style" not in a:
            return shown, None
        won = css.decided(said, html.unescape(a.get("style", "")))
        if won.get("display", "revert") not in ("revert", "revert-layer"):
            shown = won["display"] != "none"
        return shown, css.VISIBILITIES[won["visibility"]] if "visibility" in won else None


def width_of(text: str) -> int:
    """Columns of a fixed-width font: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of text so far; inline text gathers in parts."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False  # white space waits for what comes next
        self.gap = False  # a blank line waits

    def text(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self._put(first)
            for line in rest:
                self._end(keep_empty=True)
                self._put(line)
            return
        if not text:
            return
        words = _SPACES.split(text)
        if words[0] == "" and len(words) > 1:
            self.space = True
        body = " ".join(w for w in words if w)
        if body:
            if self.space and self.parts:
                self.parts.append(" ")
            self.parts.append(body)
            self.space = words[-1] == ""

    def _put(self, text: str) -> None:
        if text:
            if self.space and self.parts:
                self.parts.append(" ")
            self.space = False
            self.parts.append(text)

    def _end(self, keep_empty: bool = False) -> None:
        if self.parts or keep_empty:
            self._line("".join(self.parts))
        self.parts, self.space = [], False

    def _line(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def new_line(self) -> None:
        self._end()

    def forced_line(self) -> None:
        self._end(keep_empty=bool(self.lines) or bool(self.parts))

    def blank(self) -> None:
        self._end()
        self.gap = True

    def add(self, lines: list[str]) -> None:
        self._end()
        for line in lines:
            self._line(line)

    def done(self) -> list[str]:
        self._end()
        lines = [x.rstrip() for x in self.lines]
        while lines and not lines[-1]:
            lines.pop()
        start = 0
        while start < len(lines) and not lines[start]:
            start += 1
        return lines[start:]


def _number(text: str | None, otherwise: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "", re.ASCII)
    return int(m[1]) if m else otherwise


def lay_out_table(rows: list[list[tuple[list[str], int, int]] | None]) -> list[str]:
    """Rows of cells (lines, colspan, rowspan) as lines with aligned columns, two spaces apart. None: a group of rows begins, where no cell
    reaches into from above."""
    placed: list[list[tuple[int, int, list[str]]]] = []  # (column, span, lines)
    taken: dict[int, int] = {}  # column -> rows below that a cell above still covers
    for row in rows:
        if row is None:
            taken = {}
            continue
        out, column, below = [], 0, {}
        for lines, span, down in row:
            while taken.get(column, 0) > 0:
                column += 1
            out.append((column, span, lines))
            if down > 1:
                below |= dict.fromkeys(range(column, column + span), down)
            column += span
        taken = {c: n - 1 for c, n in (taken | below).items() if n > 1}
        placed.append(out)
    widths: dict[int, int] = {}
    for row in placed:
        for column, span, lines in row:
            if span == 1:
                w = max(map(width_of, lines), default=0)
                widths[column] = max(widths.get(column, 0), w if w <= WIDEST else 0)
    starts, at = {}, 0
    for column in range(max((c + s for r in placed for c, s, _ in r), default=0) if any(placed) else 0):
        starts[column] = at
        if widths.get(column):
            at += widths[column] + 2
    result = []
    for row in placed:
        for i in range(max((len(lines) for _, _, lines in row), default=0)):
            line, used = [], 0
            for column, _, lines in row:
                if i < len(lines) and lines[i]:
                    pad = max(starts.get(column, 0) - used, 2 if used else 0)
                    line.append(" " * pad + lines[i])
                    used += pad + width_of(lines[i])
            result.append("".join(line))
    return result


def render(source: str | None) -> str:
    """The page's visible text, laid out; null and empty pages give an empty text."""
    if not source:
        return ""
    root, sheets = build_tree(source.replace("\0", ""))
    styles = Styles(root, sheets)
    flows = [Flow()]
    lists: list[list] = []  # [ordered, next number]
    tables: list[list] = []  # rows of the tables that are open
    deep = 0
    # (node, visible, preformatted, stage): 0 enter, 1 leave
    todo: list[tuple] = [(root, True, False, 0, None)]
    while todo:
        node, visible, pre, stage, kept = todo.pop()
        if isinstance(node, str):
            if visible:
                flows[-1].text(node.replace("\xa0", " ") if pre else node, pre)
            continue
        tag, a = node.tag, node.attributes
        flow = flows[-1]
        if stage == 0:
            shown, own = styles.of(node)
            if not shown:
                continue
            visible = visible if own is None else own
            if tag == "br":
                flow.forced_line()
                continue
            if tag == "hr":
                flow.blank()
                continue
            if tag == "wbr":
                continue
            if tag == "input":
                if visible and a.get("type", "").lower() in ("submit", "button", "reset") and a.get("value"):
                    flow.text(f" {html.unescape(a['value'])} ", False)
                continue
            children = node.children
            if tag == "details" and "open" not in a:
                children = [x for x in children if isinstance(x, Node) and x.tag == "summary"][:1]
            if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists):
                flow.blank()
            elif tag in BLOCK and tag not in ("td", "th") or tag in OWN_LINE.get(node.within, ()):
                flow.new_line()
            elif tag == "mtd" and node.within:
                flow.text(" ", False)
            state = None
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag == "ol", _number(a.get("start"), 1)])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    lists[-1][1] = _number(a.get("value"), lists[-1][1])
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                state = mark
                flows.append(Flow())
                deep += 1
            elif tag in ("blockquote", "dd"):
                state = "  "
                flows.append(Flow())
                deep += 1
            elif tag == "table":
                tables.append([])
                flows.append(Flow())  # text between the cells
            elif tag in ("tbody", "thead", "tfoot") and tables:
                tables[-1].append(None)
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1] or tables[-1][-1] is None:
                    tables[-1].append([])
                flows.append(Flow())
                state = lists
                lists = []
            if tag in PREFORMATTED and children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
            todo.append((node, visible, pre, 1, state))
            inner = pre or tag in PREFORMATTED
            for child in reversed(children):
                todo.append((child, visible, inner, 0, None))
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag in ("li", "blockquote", "dd"):
            lines = flows.pop().done()
            deep -= 1
            mark = kept if deep < DEEPEST else kept.strip() + " " if tag == "li" else ""
            rest = " " * len(kept) if deep < DEEPEST else ""
            if lines:
                flows[-1].add([(mark if i == 0 else rest if x else "") + x for i, x in enumerate(lines)])
        elif tag in ("td", "th") and tables:
            lists = kept
            down = _number(a.get("rowspan"), 1)  # 0: to the end of its group
            tables[-1][-1].append((flows.pop().done(), min(max(1, _number(a.get("colspan"), 1)), MOST_COLUMNS), MOST_ROWS if down == 0 else min(max(1, down), MOST_ROWS)))
        elif tag == "table":
            between = flows.pop().done()
            flows[-1].add(between)
            flows[-1].add(lay_out_table(tables.pop()))
        flow = flows[-1]
        if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists):
            flow.blank()
        elif tag in BLOCK and tag not in ("td", "th") or tag in OWN_LINE.get(node.within, ()):
            flow.new_line()
    return "\n".join(flows[0].done())


def render_pages(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """pages with the visible text of each page's html in the column out, in place of any of that name; other columns stay.

    Whole pages are read; null and empty ones give an empty text; repeated rows give equal texts.
    """
    if out in pages.columns:
        pages = pages.drop(out)
    schema = T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_chunks(batches, text=column):
            texts = [render(x) for x in part.column(part.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return pages.mapInArrow(run, schema)
