"""What style sheets say of display and visibility: rules in cascade order, matched top down over a whole tree.

Read: comments, strings, escapes, at-rules that group rules (media by a screen of WIDTH x HEIGHT pixels), lists of selectors with all four
combinators, attributes, :not, :is, :where and the pseudo-classes in _pseudo(); specificity, source order, !important, inline styles. A selector
with any other pseudo-class matches nothing, nor do nested rules. No step recurses over the tree and none goes back up it: an element's matches come from
those of its parent, its ancestors and the siblings before it, so the cost is elements times the parts of selectors that fit them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

WIDTH, HEIGHT = 1280, 800

# What the two properties may say; the at-rules that hold rules.
DISPLAYS = frozenset(
    "none contents block inline inline-block flow-root list-item flex inline-flex grid inline-grid table inline-table table-row table-cell table-caption "
    "table-row-group table-header-group table-footer-group table-column table-column-group ruby ruby-base ruby-text run-in flow math inherit initial unset "
    "revert revert-layer -webkit-box -webkit-inline-box -webkit-flex -ms-flexbox".split()
)
VISIBILITIES = {"visible": True, "initial": True, "hidden": False, "collapse": False, "inherit": None, "unset": None, "revert": None, "revert-layer": None}
GROUPS = frozenset("media supports layer container document -moz-document".split())
#: Of a page that nobody touches, these match nothing.
NEVER = frozenset("hover active focus focus-within focus-visible visited target fullscreen autofill modal popover-open playing before after first-line first-letter".split())
#: Media features of a desktop screen.
FEATURES = {"orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference", "scripting": "enabled", "update": "fast", "color": "", "grid": "0"}

_TOKEN = re.compile(r"/\*(?:.*?\*/|.*\Z)|\"(?:\\.|[^\"\\\n])*+\"?|'(?:\\.|[^'\\\n])*+'?|\\.|[{};()\[\],]", re.S)
_IDENT = r"(?:[\w-]|[^\x00-\x7f]|\\[0-9a-fA-F]{1,6}[ \t\n]?|\\[^\n])+"
_PART = re.compile(rf"(?P<type>{_IDENT}|\*)|(?P<mark>[.#]{_IDENT})|\[\s*(?P<name>{_IDENT})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*(?P<fold>[iI])?\s*)?\]|::?(?P<pseudo>[\w-]+)(?P<open>\()?")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})[ \t\n]?|(.))", re.S)
_NTH = re.compile(r"([+-]?\d*)n(?:([+-]\d+))?\Z|([+-]?\d+)\Z")
_FEATURE = re.compile(r"\(\s*([\w-]+)\s*(?::\s*([^()]*?)\s*)?\)")
_LENGTH = re.compile(r"([\d.]+)(px|em|rem)?\Z")


def _plain(name: str) -> str:
    def one(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else 0
        return m[2] or (chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "�")

    return _ESCAPE.sub(one, name) if "\\" in name else name


def split(text: str, mark: str) -> list[str]:
    """text cut at a mark that stands outside strings and brackets."""
    out, start, deep = [], 0, 0
    for m in _TOKEN.finditer(text):
        if m[0] in "([":
            deep += 1
        elif m[0] in ")]":
            deep -= deep > 0
        elif m[0] == mark and not deep:
            out.append(text[start : m.start()])
            start = m.end()
    return [*out, text[start:]]


def holds_on_screen(query: str) -> bool:
    """Whether a media query list holds on a screen of WIDTH x HEIGHT; features that aren't known don't."""
    query = query.strip().lower()
    return not query or any(_one_query(q.strip()) for q in split(query, ","))


def _one_query(query: str) -> bool:
    negated = re.match(r"not\b\s*", query)
    rest = query[negated.end() :] if negated else re.sub(r"^only\s+", "", query)
    kind = re.match(r"[a-z]+", rest)
    held = (not kind or kind[0] in ("all", "screen")) and all(_feature(name, value) for name, value in _FEATURE.findall(rest))
    held = held and not re.sub(r"\band\b|\s", "", _FEATURE.sub("", rest[kind.end() if kind else 0 :]))
    return held != bool(negated)


def _feature(name: str, value: str) -> bool:
    m = re.match(r"(min-|max-)?(?:device-)?(width|height)\Z", name)
    if not m:
        return name in FEATURES and (FEATURES[name] not in ("0", "no-preference") if not value else FEATURES[name] == value)
    size, length = (WIDTH if m[2] == "width" else HEIGHT), _LENGTH.match(value)
    if not length:
        return not value and not m[1]
    try:
        wanted = float(length[1]) * (16 if length[2] in ("em", "rem") else 1)
    except ValueError:
        return False
    return size >= wanted if m[1] == "min-" else size <= wanted if m[1] == "max-" else size == wanted


def style_rules(sheet: str) -> Iterator[tuple[str, list[str]]]:
    """(selectors, declarations) of the rules that hold on a screen, in source order; what is open at the end counts as closed."""
    open_: list[tuple[str, str, list[str]]] = []  # (group, style or skip; selectors; declarations)
    parts: list[str] = []
    at = deep = 0
    for m in _TOKEN.finditer(sheet):
        parts.append(sheet[at : m.start()])
        at, mark = m.end(), m[0]
        if mark in "([":
            deep += 1
        elif mark in ")]":
            deep -= deep > 0
        if mark.startswith("/*"):
            parts.append(" ")
        elif mark not in "{};" or deep:
            parts.append(mark)
        else:
            text, parts = "".join(parts).strip(), []
            kind = open_[-1][0] if open_ else "group"
            if mark == "{":
                text = text.replace("<!--", "").replace("-->", "").strip()
                name = re.match(r"@([\w-]+)", text)
                if kind != "group":
                    open_.append(("skip", "", []))
                elif not name:
                    open_.append(("style", text, []))
                else:
                    rest = text[name.end() :]
                    read = name[1].lower() in GROUPS and (name[1].lower() != "media" or holds_on_screen(rest)) and not (name[1].lower() == "supports" and re.match(r"\s*not\b", rest, re.I))
                    open_.append(("group" if read else "skip", "", []))
            else:
                if kind == "style" and text:
                    open_[-1][2].append(text)
                if mark == "}" and open_:
                    closed = open_.pop()
                    if closed[0] == "style":
                        yield closed[1], closed[2]
    if open_ and open_[-1][0] == "style":
        yield open_[-1][1], [*open_[-1][2], "".join([*parts, sheet[at:]]).strip()]


def declared(declarations: list[str]) -> list[tuple[str, str, bool]]:
    """(property, value, important) of what is said of display and visibility; values that a browser refuses say nothing."""
    out = []
    for d in declarations:
        name, _, value = d.partition(":")
        name = name.strip().lower()
        if name in ("display", "visibility"):
            value, important, _ = re.sub(r"/\*.*?(?:\*/|\Z)", " ", value, flags=re.S).strip().lower().partition("!")
            words = value.split()
            good = bool(words) and all(w in DISPLAYS for w in words) if name == "display" else len(words) == 1 and words[0] in VISIBILITIES
            if good and (not important or _.strip() == "important"):
                out.append((name, words[0], bool(important)))
    return out


class Compound:
    """What one element must be: its type, marks (.class and #id) and further tests, and the specificity of all that."""

    def __init__(self):
        self.tag, self.marks, self.tests, self.weight = "", set(), [], (0, 0, 0)

    def key(self) -> str:
        return min(self.marks) if self.marks else self.tag

    def add(self, weight: tuple[int, int, int]) -> None:
        self.weight = tuple(map(sum, zip(self.weight, weight, strict=True)))

    def fits(self, e: Element) -> bool:
        return (not self.tag or self.tag == e.tag) and self.marks <= e.marks and all(t(e) for t in self.tests)


class Element:
    """A node as selectors see it: place counts its siblings before it, from 1."""

    __slots__ = ("node", "tag", "marks", "place", "last")

    def __init__(self, node, place: int, last: bool):
        a = node.attributes
        self.node, self.tag, self.place, self.last = node, node.tag, place, last
        self.marks = {f".{c}" for c in a.get("class", "").split()} | ({f"#{a['id']}"} if "id" in a else set())


def _attribute(name: str, op: str | None, value: str | None, fold: bool) -> Callable[[Element], bool]:
    name, value = name.lower(), value or ""
    if value[:1] in "\"'" and value[:1]:
        value = value[1:-1]
    value = _plain(value).lower() if fold else _plain(value)
    told = {
        "=": lambda x: x == value, "~=": lambda x: value in x.split(), "|=": lambda x: x == value or x.startswith(value + "-"),
        "^=": lambda x: bool(value) and x.startswith(value), "$=": lambda x: bool(value) and x.endswith(value), "*=": lambda x: bool(value) and value in x,
    }.get(op)

    def test(e: Element) -> bool:
        found = e.node.attributes.get(name)
        return found is not None and (told is None or told(found.lower() if fold else found))

    return test


def _pseudo(name: str, inner: str | None) -> tuple[Callable[[Element], bool], tuple[int, int, int]] | None:
    """Test and weight; None for a pseudo-class that isn't read."""
    if name in ("not", "is", "where", "matches", "any", "-webkit-any", "-moz-any"):
        chains = [chain_of(s) for s in split(inner or "", ",")]
        if any(c is None or len(c) > 1 for c in chains):
            return None
        some = [c[0][1] for c in chains]
        weight = (0, 0, 0) if name == "where" else max((c.weight for c in some), default=(0, 0, 0))
        return (lambda e: any(c.fits(e) for c in some) != (name == "not")), weight
    if name == "nth-child":
        inner = {"odd": "2n+1", "even": "2n"}.get((inner or "").strip().lower(), re.sub(r"\s", "", inner or "").lower())
        m = _NTH.match(inner)
        if not m:
            return None
        step = 0 if m[3] else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
        first = int(m[3] or m[2] or 0)
        return (lambda e: e.place == first if not step else (e.place - first) % step == 0 and (e.place - first) // step >= 0), (0, 1, 0)
    if inner is not None:
        return None
    tests = {
        "first-child": lambda e: e.place == 1, "last-child": lambda e: e.last, "only-child": lambda e: e.place == 1 and e.last, "root": lambda e: e.place == 0,
        "empty": lambda e: not e.node.children, "link": lambda e: e.tag in ("a", "area") and "href" in e.node.attributes,
        "any-link": lambda e: e.tag in ("a", "area") and "href" in e.node.attributes, "checked": lambda e: "checked" in e.node.attributes or "selected" in e.node.attributes,
        "disabled": lambda e: "disabled" in e.node.attributes, "enabled": lambda e: e.tag in ("input", "button", "select", "textarea", "option") and "disabled" not in e.node.attributes,
    }
    if name in NEVER:
        return (lambda e: False), (0, 1, 0)
    return (tests[name], (0, 1, 0)) if name in tests else None


def chain_of(selector: str) -> list[tuple[str, Compound]] | None:
    """A selector's compounds, each with the combinator before it; None for one that isn't read."""
    selector = selector.strip()
    out: list[tuple[str, Compound]] = [("", Compound())]
    at, n, filled = 0, len(selector), False
    while at < n:
        c = out[-1][1]
        m = _PART.match(selector, at)
        if m is None:
            m = _COMBINATOR.match(selector, at)
            if m is None or not filled:
                return None
            out.append((m[1] or " ", Compound()))
            at, filled = m.end(), False
            continue
        at = m.end()
        if m["type"]:
            if filled:
                return None
            if m["type"] != "*":
                c.tag = _plain(m["type"]).lower()
                c.add((0, 0, 1))
        elif m["mark"]:
            c.marks.add(m["mark"][0] + _plain(m["mark"][1:]))
            c.add((1, 0, 0) if m["mark"][0] == "#" else (0, 1, 0))
        elif m["name"]:
            c.tests.append(_attribute(_plain(m["name"]), m["op"], m["value"], bool(m["fold"])))
            c.add((0, 1, 0))
        else:
            inner = None
            if m["open"]:
                deep, start = 1, at
                for t in _TOKEN.finditer(selector, at):
                    deep += (t[0] == "(") - (t[0] == ")")
                    if not deep:
                        break
                if deep:
                    return None
                inner, at = selector[start : t.start()], t.end()
            found = _pseudo(m["pseudo"].lower(), inner)
            if found is None:
                return None
            c.tests.append(found[0])
            c.add(found[1])
        filled = True
    return out if filled else None


class Rules:
    """Rules of all sheets of a page that speak of display or visibility."""

    def __init__(self, sheets: list[str]):
        self.at: dict[str, list[tuple[int, int, str, Compound]]] = {}  # by key: (selector, part, combinator, compound)
        self.said: list[tuple[tuple[int, int, int], list[tuple[str, str, bool]], int]] = []  # by selector: weight, declarations, last part
        self.follows: dict[tuple[int, int], str] = {}  # (selector, part): the combinator after it
        for sheet in sheets:
            for selectors, declarations in style_rules(sheet):
                what = declared(declarations)
                for s in split(selectors, ",") if what else ():
                    chain = chain_of(s)
                    if chain:
                        number = len(self.said)
                        weight = tuple(map(sum, zip(*(c.weight for _, c in chain), strict=True)))
                        self.said.append((weight, what, len(chain) - 1))
                        for i, (combinator, c) in enumerate(chain):
                            self.at.setdefault(c.key(), []).append((number, i, combinator, c))
                            if i:
                                self.follows[number, i - 1] = combinator

    def of_tree(self, root) -> dict[int, list[tuple[tuple, str, str]]]:
        """By id of a node: (rank, property, value) of all that rules say of it."""
        out: dict[int, list] = {}
        none: frozenset = frozenset()
        top = self._matches(Element(root, 0, True), none, none, none, none, out)
        todo = [(root, top, frozenset(x for x in top if self.follows.get(x) == " "))]
        while todo:
            node, own, above = todo.pop()
            children = [x for x in node.children if not isinstance(x, str)]
            before, earlier = none, none
            for i, child in enumerate(children, 1):
                found = self._matches(Element(child, i, i == len(children)), own, above, before, earlier, out)
                below = frozenset(x for x in found if self.follows.get(x) == " ")
                if child.children:
                    todo.append((child, found, above if below <= above else above | below))
                before = found
                after = frozenset(x for x in found if self.follows.get(x) == "~")
                earlier = earlier if after <= earlier else earlier | after
        return out

    def _matches(self, e: Element, parent, above, before, earlier, out) -> frozenset:
        found = []
        source = {" ": above, ">": parent, "+": before, "~": earlier}
        for key in (e.tag, "", *e.marks):
            for number, i, combinator, c in self.at.get(key, ()):
                if (not i or (number, i - 1) in source[combinator]) and c.fits(e):
                    weight, what, last = self.said[number]
                    if i == last:
                        out.setdefault(id(e.node), []).extend(((important, False, weight, number), name, value) for name, value, important in what)
                    else:
                        found.append((number, i))
        return frozenset(found)


def decided(said: list[tuple[tuple, str, str]], inline: str | None) -> dict[str, str]:
    """The value of each property that wins the cascade."""
    if inline:
        said = said + [((important, True, (0, 0, 0), i), name, value) for i, (name, value, important) in enumerate(declared(split(inline, ";")))]
    return {name: value for _, name, value in sorted(said, key=lambda x: x[0])}
