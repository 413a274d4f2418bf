"""Secret scans: assignment-aware lexing over base patterns.

Base patterns find spans of three kinds wherever they stand.  The lexer reads source and
configuration syntax into (name, literal) pairs: ``=``, ``:``, ``:=`` and ``=>``, also with
a type between, subscripts, quoted, triple-quoted, joined and bare literals, YAML blocks,
XML elements.  Brackets nest: a member called ``value`` belongs to the name around it or to
the literal of the ``name`` or ``key`` before it.  A name assigned to another name takes
the literals that one has, through any chain (constants are propagated); each name is
visited once, from the most sensitive names on.  A literal counts as a secret by the most
sensitive name it reaches and by what it looks like: length, mixture of characters, known
placeholders.  Those spans are added with the kind ``literal`` unless a base span covers
them.

Time is linear in the text: every repetition is possessive and a name starts only where a
run of name characters does.

Spans are in code points, end exclusive.  Defined results: a null text is empty and has
no spans; rows repeat as they do in the input; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import ship

# The base patterns, and the least length of what they must hold.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "literal")

QUOTED = r'''(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`)'''
TRIPLE = r'''(?:"""(?:[^"\\]|\\(?s:.)|"(?!""))*+"""|\'\'\'(?:[^'\\]|\\(?s:.)|'(?!''))*+\'\'\')'''
LITERAL = rf"(?:{TRIPLE}|[bBrRuUfF]{{0,2}}+{QUOTED})"
GAP = r"[\x20\t]*+"
ITEM = re.compile(
    rf"""(?:"(?P<double>[^"\\\n]{{1,80}})"|'(?P<single>[^'\\\n]{{1,80}})'|(?<![\w.$-])(?P<plain>[A-Za-z_$][\w.$-]*+(?:\[["']?[\w.-]{{1,80}}["']?\])?))"""
    rf"""{GAP}(?::{GAP}[\w.\[\]|?]{{1,60}}{GAP}(?==[^=]))?(?::=|=>|=(?![=>])|:(?!:))"""
    rf"""(?:\s*+(?:(?P<literal>{LITERAL}(?:\s*+\+\s*+{LITERAL})*+)|(?P<opened>[{{\[(]))|{GAP}(?:\$\{{(?P<reference>\w++)\}}|(?P<bare>[^\s"'`,;(){{}}\[\]<>]++)|(?P<below>(?=\n))))"""
    r"""|(?P<open>[{\[(])|(?P<close>[}\])])"""
)
LITERALS = re.compile(LITERAL)
QUOTES = re.compile(r"""[bBrRuUfF]{0,2}+(\"{3}|'{3}|["'`])""")
BLOCK = re.compile(
    r"""^(?P<indent>[\x20\t]*+)(?:-\x20++)?["']?(?P<name>[\w.$-]++)["']?\x20*+:\x20*+[|>][+-]?[0-9]?[\x20\t]*+\n(?P<body>(?:(?P=indent)[\x20\t]++[^\n]*+(?:\n|\Z)|[\x20\t]*+\n)++)""", re.M
)
ELEMENT = re.compile(
    r"""<(?P<name>[A-Za-z_][\w.:-]*+)(?:\s[^<>]*?\b(?:name|key|id)=["'](?P<key>[^"'<>]{1,80})["'][^<>]*+|\s[^<>]*+)?>(?P<body>[^<>]*+)</(?P=name)\s*+>"""
)
IDENTIFIER = re.compile(r"[$@]?[A-Za-z_][\w.$]*+\Z")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# Parts of sensitive names, with weights; members that hold a value, and that hold its name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.8,
    "apikey": 1.0, "credential": 0.8, "credentials": 0.8, "auth": 0.5, "private": 0.5, "access": 0.4, "key": 0.4, "api": 0.4,
}
VALUE_NAMES = frozenset("value val default data plain text content".split())
LABEL_NAMES = frozenset("name key id".split())
HINT = re.compile("|".join(SENSITIVE), re.I)
PLACEHOLDER = re.compile(r"(?i)\$\{|\{\{|<[^<>]*+>|changeme|example|placeholder|your[_-]|\A(?:none|null|true|false|undefined)\Z")
LEAST_SCORE = 0.6
Literal = tuple[int, int, str]


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name)]
    return min(1.0, sum(SENSITIVE.get(p, 0.0) for p in dict.fromkeys(parts)))


def likeness(literal: str) -> float:
    """0 to 1: how much a literal looks like a secret, whatever its name."""
    if len(literal) < ASSIGN_CHARS or any(c.isspace() for c in literal) or PLACEHOLDER.search(literal):
        return 0.0
    counts = Counter(literal)
    if len(counts) < 3:
        return 0.0
    bits = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    kinds = sum(any(map(f, counts)) for f in (str.islower, str.isupper, str.isdigit)) / 3
    return 0.5 + 0.25 * min(1.0, bits / 3.5) + 0.25 * kinds


def unwrapped(body: str, start: int) -> Literal:
    """A literal of several lines, such as a key in a block: where it stands, and its lines as one unless they hold words."""
    inner = body.strip()
    start += body.find(inner)
    lines = [line.strip() for line in inner.splitlines()]
    own = [line for line in lines if not line.startswith("-----")]
    return start, start + len(inner), "".join(own) if len(lines) > 1 else inner


def quoted(text: str, start: int, stop: int) -> Literal:
    """What stands in the quotes of a literal or of joined literals."""
    parts = []
    for m in LITERALS.finditer(text, start, stop):
        q = QUOTES.match(m[0])
        parts.append((m.start() + q.end(), m.end() - len(q[1]), len(q[1]) == 3))
    a, b = parts[0][0], parts[-1][1]
    if len(parts) == 1 and parts[0][2]:
        return unwrapped(text[a:b], a)
    return a, b, "".join(text[x:y] for x, y, _ in parts)


class Names:
    """Literals and aliases of a text's names."""

    def __init__(self):
        self.literals: dict[str, list[Literal]] = {}
        self.uses: list[tuple[str, str, int, int]] = []

    def add(self, name: str, literal: Literal) -> None:
        self.literals.setdefault(name, []).append(literal)

    def read(self, text: str) -> None:
        around, label = [""], [""]  # for each open bracket: the name before it, and the last name that waits for a value
        for m in ITEM.finditer(text):
            kind = m.lastgroup
            if kind == "close":
                if len(around) > 1:
                    around.pop()
                    label.pop()
                continue
            if kind == "open":
                around.append(around[-1])
                label.append("")
                continue
            own = m["plain"] or m["double"] or m["single"]
            last = PARTS.findall(own)[-1:]
            if last and last[0].lower() in VALUE_NAMES:
                own = label[-1] or around[-1] or own
            if kind == "opened":
                around.append(own)
                label.append("")
            elif kind == "below":
                label[-1] = own
            elif kind == "literal":
                found = quoted(text, *m.span("literal"))
                self.add(own, found)
                if own.lower() in LABEL_NAMES:
                    label[-1] = found[2][:80]
            elif kind == "reference":
                self.uses.append((own, m["reference"], *m.span("reference")))
            else:
                a, b = m.span("bare")
                value = m["bare"]
                if own.lower() in LABEL_NAMES:
                    label[-1] = value[:80]
                if not IDENTIFIER.match(value):
                    self.add(own, (a, b, value))
                elif text[b : b + 1] != "(":
                    self.uses.append((own, value.lstrip("$@"), a, b))
        for m in BLOCK.finditer(text):
            self.add(m["name"], unwrapped(m["body"], m.start("body")))
        for m in ELEMENT.finditer(text):
            if m["body"].strip():
                self.add(m["key"] or m["name"], unwrapped(m["body"], m.start("body")))

    def reached(self) -> Iterator[tuple[float, Literal]]:
        """Every literal with the sensitivity of the most sensitive name it reaches."""
        known = self.literals.keys() | {name for name, *_ in self.uses}
        by_end = {n.rpartition(".")[2]: n for n in known}
        aliases: dict[str, list[str]] = {}
        for name, value, a, b in self.uses:
            target = value if value in known else by_end.get(value.rpartition(".")[2])
            if target is not None:
                aliases.setdefault(name, []).append(target)
            elif "." not in value and any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
                self.add(name, (a, b, value))
        weight = {n: sensitivity(n) for n in known}
        best: dict[str, float] = {}
        for name in sorted(known, key=weight.__getitem__, reverse=True):
            if weight[name] < LEAST_SCORE:
                break
            todo = [name]
            while todo:
                v = todo.pop()
                if v not in best:
                    best[v] = weight[name]
                    todo += aliases.get(v, ())
        for name, found in self.literals.items():
            if name in best:
                for literal in found:
                    yield best[name], literal


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def lexed_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of literals that count as secrets and lie in no base span."""
    if not HINT.search(text):
        return []
    names = Names()
    names.read(text)
    found = {(a, 3, b) for weight, (a, b, x) in names.reached() if weight * likeness(x) >= LEAST_SCORE}
    starts, reach = [a for a, _, _ in base], [0, *accumulate((b for _, _, b in base), max)]
    return sorted(s for s in found if reach[bisect_right(starts, s[0])] < s[2])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digest, spans = [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = base_spans(text)
            kinds = [k for _, k, _ in base]
            counts.append([kinds.count(k) for k in range(3)])
            digest.append(joined(base))
            spans.append(joined(sorted(base + lexed_spans(text, base))))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans for every row of docs(doc_id, text)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scanned, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")
