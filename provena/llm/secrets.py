"""Secret scans: fixed patterns, and an assignment-aware lexer over source and configuration lines.

The lexer reads ``name = literal`` pairs in the usual spellings (``=``, ``:``, ``:=``, ``=>``,
quoted or bare, with JSON keys, types and ``export``; values in triple quotes, blocks or on the
next lines too), follows names that stand for literals bound
earlier in the same text, joins literals with ``+``, and scores each literal by how sensitive
its target's name is and by how much it looks like a key. Texts are scanned whole; the scan is
linear in a text, and a text costs its own task only its own memory.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import batches

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A quick test that a text has what ASSIGN needs; it only saves time.
HINT = re.compile(r"(?i:pass|secret|token|api)", re.ASCII)
LEAST_ASSIGNED = 6
#: Characters of a value that its score is worked out from.
VALUE_CHARS = 4096

#: How sensitive a part of a name is; qualifiers count only before "key" or "id".
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "pass": 0.7, "pin": 0.4,
}
QUALIFIERS = {"api", "access", "private", "secret", "encryption", "signing", "session", "master", "account"}
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "undefined", "todo", "redacted"}
THRESHOLD = 1.2

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_TYPE = r"(?:&(?:'\w+[ \t]+)?)?[A-Za-z_][A-Za-z_.]*[0-9]{0,2}(?:\[[\w., \t|]*\]|<[\w., \t|]*>)?\??"
#: A name and what binds it; a type between ":" and "=" is passed over, if a quoted literal follows or blanks stand around "=".
HEAD = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])["']?(?P<name>{_NAME})["']?[ \t]*"""
    rf"""(?:\??:[ \t]*{_TYPE}(?:[ \t]*\|[ \t]*{_TYPE})*(?:[ \t]+=(?=\s)|[ \t]*=(?=[ \t]*["']))|(?::=|=>|=(?!=)|:(?!:)))[ \t]*"""
)
_END = r"(?:[ \t]*\\?\r?\n[ \t]*)"
_ONE = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
_TRIPLE = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""' + r"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
_MANY = r"""(?:"(?:[^"\\]|\\[\s\S])*"|'(?:[^'\\]|\\[\s\S])*')(?=[ \t]*[,;)}\]]*[ \t\r]*(?:\n|\Z))"""
_BARE = r"""(?!\\\r?\n)[^\s"',;(){}\[\]+]+"""
_LAST = r"(?![ \t]*[:=])"
#: A value from where its head ends: on the same line, or on the next if it is quoted, or bare and alone on an indented line after "=".
VALUE = re.compile(
    rf"""(?:{_TRIPLE}|{_ONE}|{_BARE}|{_MANY}|(?:\([ \t]*)?{_END}?(?:{_TRIPLE}|{_ONE}){_LAST}|(?<==){_END}(?<=[ \t])[^\s"',;(){{}}\[\]+:=]++(?=[ \t]*;?[ \t\r]*(?:\n|\Z)))"""
    rf"""(?:[ \t]*\+[ \t]*(?:{_ONE}|[A-Za-z_][A-Za-z0-9_.]*)|{_END}?[ \t]*\+[ \t]*{_END}?(?:{_ONE}){_LAST}|[ \t]*\+{_END}[A-Za-z_][A-Za-z0-9_.]*+{_LAST})*"""
)
PART = re.compile(r'"""((?:[^"\\]|\\[\s\S]|"(?!""))*)"""|' + r"""'''((?:[^'\\]|\\[\s\S]|'(?!''))*)'''|"((?:[^"\\]|\\[\s\S])*)"|'((?:[^'\\]|\\[\s\S])*)'|((?!\\\r?\n|\()[^\s"'+]+)""")
#: A configuration value as an element of XML.
ELEMENT = re.compile(rf"<({_NAME})>([^<>]++)</\1>")
#: What opens a block of indented lines in YAML.
BLOCK = re.compile(r"[|>][+\-0-9]*[ \t]*\r?\n")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
IDENTIFIER = re.compile(rf"{_NAME}\Z")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each fixed pattern, as (kind, start, end) in code points."""
    spans: list[Span] = []
    if (":" in text or "=" in text) and HINT.search(text):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(spans)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def name_score(name: str) -> float:
    """How sensitive a target's name is, from 0 to 1."""
    words = [w.lower() for w in WORDS.findall(name)]
    score = max([SENSITIVE.get(w, 0.0) for w in words], default=0.0)
    for a, b in zip(words, words[1:], strict=False):
        if b in ("key", "keys") and a in QUALIFIERS:
            score = max(score, 0.95)
    return score


def literal_score(value: str) -> float:
    """How much a literal looks like a key, from 0 to 1; placeholders and references count 0."""
    low = value.lower()
    if len(value) < 8 or low.strip("<>*") in PLACEHOLDERS or value[:2] in ("${", "{{", "<%") or value[:1] == "<" or len(set(value)) < 4:
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return 0.3 * min(1.0, len(value) / 16) + 0.4 * min(1.0, entropy / 3.5) + 0.3 * min(1.0, (kinds - 1) / 2)


def _lines(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each line that holds a separator."""
    at = 0
    while (m := _SEPARATOR.search(text, at)) is not None:
        start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        end = len(text) if end < 0 else end
        yield max(start, at), end
        at = end


_SEPARATOR = re.compile("[:=]")


class Lines:
    """The lines of a text that aren't blank: where each starts, its first and last sign, and where what is indented deeper ends."""

    def __init__(self, text: str) -> None:
        self.starts: list[int] = []
        self.spans: list[tuple[int, int]] = []
        self.ends: list[int] = []
        indents, at, open_ones = [], 0, []
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            first = _INDENT.match(text, at, end).end()
            last = first + len(text[first:end].rstrip())
            if last > first:
                n = len(self.starts)
                while open_ones and indents[open_ones[-1]] >= first - at:
                    self.ends[open_ones.pop()] = n
                self.starts.append(at)
                self.spans.append((first, last))
                self.ends.append(-1)
                indents.append(first - at)
                open_ones.append(n)
            at = end + 1
        for i in open_ones:
            self.ends[i] = len(self.starts)
        self.left = list(range(len(self.starts) + 1))  # from each line the next that was not taken

    def below(self, at: int) -> tuple[int, int]:
        """The lines, from one to before another, that are indented deeper than the one at a place."""
        i = bisect_right(self.starts, at) - 1
        return i + 1, self.ends[i]

    def take(self, i: int, j: int) -> Iterator[tuple[int, int]]:
        """The spans of some lines that were not taken before."""
        while True:
            k = i
            while self.left[k] != k:
                self.left[k] = self.left[self.left[k]]
                k = self.left[k]
            if k >= j:
                return
            self.left[k] = k + 1
            yield self.spans[k]
            i = k + 1


@dataclass(eq=False)
class Value:
    """What a name stands for: its first characters, the spans of its own literals or the lines of its block, and the values that it is made of besides."""

    head: str = ""
    spans: list[tuple[int, int]] = field(default_factory=list)
    block: tuple[Lines, int, int] | None = None
    made_of: list[Value] = field(default_factory=list)

    def add(self, text: str, start: int, end: int) -> None:
        self.head += text[start : min(end, start + VALUE_CHARS - len(self.head))]
        self.spans.append((start, end))

    def refer(self, other: Value) -> None:
        self.head += other.head[: VALUE_CHARS - len(self.head)]
        self.made_of.append(other)


def literals(value: Value, done: set[int]) -> Iterator[tuple[int, int]]:
    """Spans of all literals of a value; values in ``done`` (by id()) were asked before and give none again."""
    todo = [value]
    while todo:
        v = todo.pop()
        if id(v) not in done:
            done.add(id(v))
            yield from v.spans
            if v.block:
                lines, i, j = v.block
                yield from lines.take(i, j)
            todo += v.made_of


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) of each pair, in order; names that stand for literals are followed."""
    known: dict[str, Value] = {}
    lines: Lines | None = None
    for start, end in _lines(text):
        at = start
        while (head := HEAD.search(text, at, end)) is not None:
            at, name, value = head.end(), head["name"], Value()
            if (block := BLOCK.match(text, at)) is not None:
                if name_score(name):
                    lines = lines or Lines(text)
                    i, j = lines.below(head.start())
                    value.block = (lines, i, j)
                    for a, b in lines.spans[i : min(j, i + VALUE_CHARS)]:
                        value.head += text[a : min(b, a + VALUE_CHARS - len(value.head))]
                        if len(value.head) >= VALUE_CHARS:
                            break
            elif (m := VALUE.match(text, at)) is not None:
                if m.end() > end and text[at] in "\"'" and text.count(text[at], text.rfind("\n", 0, head.start()) + 1, at) % 2:
                    continue  # the quote closes a string that the name is in
                for part in PART.finditer(m[0]):
                    k = part.lastindex
                    first = m.start() + part.start(k)
                    if k == 5 and part[5] in known:
                        value.refer(known[part[5]])
                    elif k != 5 or not IDENTIFIER.match(part[5]) or len(m[0].strip()) == len(part[0]):  # else an unknown name within an expression
                        value.add(text, first, first + len(part[k]))
                at = min(m.end(), end)  # later lines of a value are read for pairs of their own too
            if value.spans or value.made_of or (value.block and value.block[1] < value.block[2]):
                known[name] = value
                yield name, value
    if "</" in text:
        for m in ELEMENT.finditer(text):
            value = Value()
            value.add(text, *m.span(2))
            yield m[1], value


_INDENT = re.compile("[ \t]*")


def lexed_spans(text: str, base: list[Span]) -> list[Span]:
    """Literals bound to sensitive names, unless a base span covers them."""
    if not (":" in text or "=" in text or "</" in text):
        return []
    starts, ends = [s for _, s, _ in base], list(accumulate((e for _, _, e in base), max))
    covered = lambda a, b: (i := bisect_right(starts, a)) > 0 and ends[i - 1] >= b
    out, held, done = [], [], set()
    for name, value in pairs(text):
        score = name_score(name)
        if score and score + literal_score(value.head) >= THRESHOLD:
            held.append(value)  # what is in done by id() must live on
            out += [("lexed", a, b) for a, b in literals(value, done) if b > a and not covered(a, b)]
    return ordered(out)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """A text's base spans and all its spans; null is empty."""
    base = base_spans(text or "")
    return base, ordered(base + lexed_spans(text or "", base)) if text else base


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch covered by spans replaced by ``[SECRET]``."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, text: str = "text", redacted: bool = False) -> DataFrame:
    """``df`` with ``base_spans`` and ``spans`` (arrays of kind, start, end); optionally with its texts redacted.

    Null texts have no spans and stay null, empty ones have none; very long texts are scanned
    whole; repeated rows are rows of their own; an empty table gives none. Spans that start
    together are listed in the order of KINDS. Other columns pass as they are, whatever their
    names, except base_spans and spans, which are replaced.
    """
    batches.bound(df.sparkSession)
    kind = "array<struct<kind:string,start:int,end:int>>"
    result = f"base {kind}, spans {kind}" + ", text string" * redacted

    @F.pandas_udf(f"struct<{result.replace(' ', ':').replace(',:', ',')}>")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, spans = scan(t)
            rows.append((base, spans, redact(t, spans) if redacted and t is not None else None))
        as_dicts = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        out = {"base": [as_dicts(r[0]) for r in rows], "spans": [as_dicts(r[1]) for r in rows]}
        return pd.DataFrame(out | ({"text": [r[2] for r in rows]} if redacted else {}))

    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("base_spans", "spans")]
    (held,) = batches.free_names(df, "scanned")
    found = lambda c: F.col(f"`{held}`")[c]
    if redacted:
        keep = [found("text").alias(text) if c == text else F.col(f"`{c}`") for c in df.columns if c not in ("base_spans", "spans")]
    return df.withColumn(held, scanned(F.col(f"`{text}`"))).select(*keep, found("base").alias("base_spans"), found("spans").alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op6_secrets": op6_secrets}
ORACLE_SQL: dict[str, str] = {}
