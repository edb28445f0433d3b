"""Secret scans through a trigram inverted index.

Each rule is a regex. From its parse tree a Boolean query over trigrams that any match must hold is derived:
literal runs give ANDs, alternatives give ORs, a part without certain characters gives nothing. Texts are indexed in
segments of some hundred documents: for each trigram that some rule asks for, a posting list of the documents that hold
it. A rule's postings are intersected and united as its query says and only these candidates are verified with
the regex. A rule without a mandatory trigram is run over every text.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from estima.llm.common import row_chunks

SECRETS = "secrets"
MOST_STRINGS = 64  # exact strings of a sub-expression that are followed before it is cut into trigrams

#: None: anything may match. Otherwise ("tri", trigram), ("and", parts) or ("or", parts).
Query = tuple | None


@dataclass(frozen=True)
class Rule:
    """kind, regex (ASCII classes; group: where its length is measured) and least length of that group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The three base kinds, in the order that spans at one place are listed. A maximal run that is long
#: enough is what {32,} finds; an assignment whose value is too short still takes up its place, so it is dropped afterwards.
BASE_RULES = (
    Rule("assign", "(" + "|".join([either_case("password"), either_case("passwd"), either_case("secret"), either_case("token"), either_case("api") + "_?" + either_case("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
_GAP = r"(?:[\s>#*\"'+,;]|\\[nrt])"  # between a key's lines: white space, also escaped, and marks of quotes and comments
#: From a key's BEGIN to its END line; where that is missing, over the header and base64 lines that follow, the last of which may be short.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:{_GAP}++[A-Za-z0-9+/]{{40,}}+={{0,2}}+)*+(?:{_GAP}++[A-Za-z0-9+/]++={{0,2}}+(?=[ \t\"',;]*(?:[\r\n]|\\[nr]|\Z)))?)"
)
#: Further kinds. No text takes time with the square of its length: runs are possessive, and a run after eyJ that begins no JWT is passed
#: over as a whole (its group is empty, so it is dropped). A scheme's bound only limits how far back into it a span may start.
MORE_RULES = (
    Rule("jwt", r"eyJ(?:([A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)|[A-Za-z0-9_-]*+)", 1),
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,15}://[^\x20\x09-\x0D/:@]++:[^\x20\x09-\x0D/:@]++@"),
)


def _join(kind: str, parts: list[Query]) -> Query:
    if kind == "or" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """What must be there if one of these strings is."""
    return _join("or", [_join("and", [("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _lower(strings) -> set[str]:
    return {s.lower() for s in strings}


def _class_strings(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value))
        elif op is C.RANGE and value[1] - value[0] < 4:
            out |= {chr(x) for x in range(value[0], value[1] + 1)}
        else:
            return None
    out = {c for c in out if ord(c) < 128}
    return _lower(out) if 0 < len(out) <= 8 else None


def _walk(tree) -> tuple[set[str] | None, Query]:
    """The strings (in lower case) that a part matches if they are few, and what any match must hold."""
    run: set[str] = {""}  # strings that the current run of exact parts can give
    needs: list[Query] = []

    def cut() -> None:
        nonlocal run
        needs.append(_of_strings(run))
        run = {""}

    whole = True
    for op, value in tree:
        exact: set[str] | None = None
        need: Query = None
        if op is C.LITERAL:
            exact = {chr(value).lower()}
        elif op is C.IN:
            exact = _class_strings(value)
        elif op is C.SUBPATTERN:
            exact, need = _walk(value[-1])
        elif op is C.BRANCH:
            sides = [_walk(x) for x in value[1]]
            need = _join("or", [q if s is None else _join("and", [q, _of_strings(s)]) for s, q in sides])
            exact = set().union(*(s for s, _ in sides)) if all(s is not None for s, _ in sides) else None
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, part = value
            inner, inner_need = _walk(part)
            if low:
                need = inner_need
            if inner is not None and low == high and len(inner) ** min(low, 8) <= MOST_STRINGS and low <= 8:
                exact = {"".join(x) for x in itertools.product(inner, repeat=low)}
            elif inner is not None and (low, high) == (0, 1):
                exact = inner | {""}
            elif inner is not None and low == 1:
                need = _join("and", [inner_need, _of_strings(inner)])
        if exact is not None and len(exact) * len(run) > MOST_STRINGS:
            cut()
            whole = False
        if exact is not None:
            run = {a + b for a in run for b in exact}
        else:
            cut()
            whole = False
        needs.append(need)
    query = _join("and", needs)
    if whole:
        return run, query
    cut()
    return None, _join("and", needs)


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-case trigrams that each match of pattern satisfies; None if there is none."""
    exact, query = _walk(_parser.parse(pattern, re.ASCII))
    return _join("and", [query, _of_strings(exact)]) if exact is not None else query


def trigrams_of(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams_of(q) for q in query[1]))


class Segment:
    """Posting lists, for the wanted trigrams, of some texts that lie one after the other in one byte array."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, wanted: dict[int, int]):
        low = data.copy()
        upper = (data >= 65) & (data <= 90)
        low[upper] |= 32
        self.n = len(ends)
        self.postings: dict[int, np.ndarray] = {}
        if len(low) < 3 or not wanted:
            return
        table = np.zeros(1 << 16, dtype=bool)  # first a coarse look: the low 16 bits of the trigram's code
        codes = np.fromiter(wanted, dtype=np.uint32)
        table[codes & 0xFFFF] = True
        wide = low.astype(np.uint32)
        code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        at = np.flatnonzero(table[code & 0xFFFF])
        at = at[np.isin(code[at], codes)]
        doc = np.searchsorted(ends, at, side="right")
        at, doc = at[ok := at + 3 <= ends[np.minimum(doc, self.n - 1)]], doc[ok]  # none that reaches into the next text
        pairs = np.unique(code[at].astype(np.int64) << 32 | doc)
        for c in np.unique(pairs >> 32):
            self.postings[int(c)] = pairs[pairs >> 32 == c] & 0xFFFFFFFF

    def search(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        if query[0] == "tri":
            return self.postings.get(int.from_bytes(query[1].encode(), "big"), np.empty(0, np.int64))
        sets = [self.search(q) for q in query[1]]
        return _reduce(np.intersect1d if query[0] == "and" else np.union1d, sets)


def _reduce(f: Callable, sets: list[np.ndarray]) -> np.ndarray:
    out = sets[0]
    for s in sets[1:]:
        out = f(out, s)
    return out


def scan_texts(batch_text: pa.Array, rules: tuple[Rule, ...], queries: list[Query], wanted: dict[int, int]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule number, end), in order; offsets in code points."""
    data = np.frombuffer("".join(texts := ["" if t is None else t for t in batch_text.to_pylist()]).encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.cumsum([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts])
    segment = Segment(data, ends, wanted)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        regex, group, least = rule.regex(), rule.group, rule.least
        for i in segment.search(query):
            found[i] += [(m.start(), k, m.end()) for m in regex.finditer(texts[i]) if m.end(group) - m.start(group) >= least]
    for spans in found:
        spans.sort()
    return found


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, rows: int = 512) -> DataFrame:
    """docs with a column secrets: array<struct<kind, start, end>>, by start, then in the order of the rules.

    A column of that name is replaced, all others stay as they are. Offsets are code points, end exclusive. A null text counts as empty and has
    no secrets. Whole texts are read, however long; a segment holds at most `rows` texts and, but for a single
    longer text, 8 MB.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = {int.from_bytes(t.encode(), "big"): 0 for q in queries for t in trigrams_of(q)}
    kinds = [r.kind for r in rules]
    docs = docs.drop(SECRETS)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(SECRETS, T.ArrayType(span))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for part in row_chunks(batches, rows):
            text = part.column(part.schema.get_field_index("text"))
            spans = [[(kinds[k], a, b) for a, k, b in x] for x in scan_texts(text, rules, queries, wanted)]
            flat = pa.array([dict(zip(("kind", "start", "end"), s)) for x in spans for s in x], kind_of.value_type)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in spans])]), pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, flat)], names=[*part.schema.names, SECRETS])

    return docs.mapInArrow(scan, schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mask: str = "[secret]") -> DataFrame:
    """docs, same columns, with each secret's span of the text replaced by mask; spans that overlap count as one.

    If there is a column n_chars, it follows the text. Null texts stay null.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = {int.from_bytes(t.encode(), "big"): 0 for q in queries for t in trigrams_of(q)}

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_chunks(batches, 512):
            at = part.schema.get_field_index("text")
            texts = part.column(at).to_pylist()
            n_at = part.schema.get_field_index("n_chars")
            n_chars = part.column(n_at).to_pylist() if n_at >= 0 else None
            for i, spans in enumerate(scan_texts(part.column(at), rules, queries, wanted)):
                if spans:
                    pieces, done = [], 0
                    for a, _, b in spans:
                        if a >= done:
                            pieces += [texts[i][done:a], mask]
                        done = max(done, b)
                    texts[i] = "".join(pieces) + texts[i][done:]
                    if n_chars:
                        n_chars[i] = len(texts[i])
            columns = list(part.columns)
            columns[at] = pa.array(texts, part.schema.field(at).type)
            if n_chars:
                columns[n_at] = pa.array(n_chars, part.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(clean, docs.schema)
