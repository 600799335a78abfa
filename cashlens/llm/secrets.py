"""Secrets by assignment-aware lexing, beside three fixed patterns.

Source and configuration syntax is lexed into name-literal pairs: `name = "literal"`, `name: literal`,
`"name": "literal"`, `table["name"] = "literal"`, `name: type = "literal"`, `name := other_name`, `a = b = "literal"`,
`a = b + "tail"`, `a = ("head" "tail")`, `a = call("literal")`. Strings are read with their escapes, prefixes and
triple quotes; a string over several lines gives a piece for each line. Names carry their literals forward, so a
literal that reaches a sensitive name through other names counts as well; its own span is reported. A literal's
score combines how sensitive the name is and how random the literal looks. Operands that are joined are scored as
one value as well, and all of its pieces are reported. Within a call or a list, literals that look like names of
things (no digit, or CAPITALS_WITH_UNDERSCORES) are arguments of a lookup and do not count. The time grows in
proportion to the text.

Defined results: a null text counts as the empty one; overlapping finds of the lexer and of the fixed patterns
are all kept, a lexed literal only where no base span covers it; repeated rows are scanned one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sha256, spans_text, texts

#: The fixed patterns, in the order in which kinds are listed.
KINDS = {"assign": 0, "access": 1, "hex": 2, "lexed": 3}
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a run of at least 24 is what a run of any length gives after shorter ones are dropped
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LETTERS, ACCESS_CHARS = 6, 20

#: Parts of names that hold secrets, and how much each says.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "private": 0.6, "auth": 0.6, "bearer": 0.8, "access": 0.4, "key": 0.5, "signing": 0.6,
    "signature": 0.4, "encryption": 0.6, "client": 0.2, "api": 0.3, "session": 0.4, "salt": 0.5, "cert": 0.4, "dsn": 0.6,
}
#: Least product of the name's and the literal's score.
LEAST_SCORE = 0.45
LEAST_CHARS = 8
#: From this name's score on, literals may hold white space and be as short as SHORT_CHARS.
HIGHLY_SENSITIVE, SHORT_CHARS = 0.9, 5

_NAME = r"[A-Za-z_][A-Za-z0-9_]*+(?:[.-][A-Za-z_][A-Za-z0-9_]*+)*+"
# the left side of a pair and its operator; a type may stand between the two
_TYPE = r"[A-Za-z_][A-Za-z0-9_.]*+(?:\[[^\]\n=\"']*+\]|<[^>\n=\"']*+>)?(?:[ \t]*\|[ \t]*[A-Za-z_][A-Za-z0-9_]*+)*+\??"
_TARGET = re.compile(
    r"(?<![A-Za-z0-9_.-])(?P<quote>[\"']?)(?P<name>" + _NAME + r")(?:(?P=quote)|\\(?P=quote))\]?(?P<gap>[ \t]*)"
    r"(?:\??:[ \t]*(?P<type>" + _TYPE + r")[ \t]+=(?![=~>])|(?P<op>:=|=>|\+=|=(?![=~>])|:(?![:/])))[ \t]*"
)
_STRING = re.compile(
    r"""(?P<prefix>(?:[rRbBuUfF]{1,2}(?=["']))?)(?:(?P<triple>\"{3}|'{3})(?P<long>(?:[^\\]|\\.)*?)(?P=triple)"""
    r"""|(?P<mark>["'`])(?P<short>(?:[^"'`\\\n]|\\.|(?!(?P=mark))["'`])*+)(?P=mark)|(?P<plain>["'])(?P<raw>(?:(?!(?P=plain))[^\n])*+)(?P=plain)"""
    r"""|\\(?P<nested>["'])(?P<inner>[^"'\\\n]*+)\\(?P=nested))""",
    re.S,
)
_BARE = re.compile(r"[A-Za-z0-9_][^\s\"'`,;(){}\[\]<>|&!*%#$]*+")
_BLANKS, _WIDE_BLANKS, _PLUS = re.compile(r"[ \t]*+"), re.compile(r"(?:[ \t\r]|\n(?![ \t\r]*\n))*+"), re.compile(r"[ \t]*+\+(?![+=])[ \t]*+")
_LOOKED_UP = re.compile(r"[^0-9]*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LETTERS]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


class _Lexer:
    """Name, joined operands and loose operands of each assignment of a text.

    The assignments are read from the last to the first, so that one which stands within the value of another
    is read once and then passed over.
    """

    def __init__(self, text: str):
        self.text = text
        self.targets = list(_TARGET.finditer(text))
        self.at = {m.start("name"): i for i, m in enumerate(self.targets)}
        self.values: list = [None] * len(self.targets)
        self.ends = [m.end() for m in self.targets]
        for i in range(len(self.targets) - 1, -1, -1):
            joined, loose = [], []
            self.ends[i] = self.value(self.targets[i].end(), joined, loose)
            self.values[i] = joined, loose

    def pairs(self) -> list:
        found = []
        for m, (joined, loose) in zip(self.targets, self.values, strict=True):
            if joined or loose:
                found.append((m["name"], joined, loose))
                # `note: password = "..."` looks like a type
                if m["type"] and name_score(m["type"]):
                    found.append((m["type"], joined, loose))
        return found

    def string(self, at: int):
        """Pieces of a string and its end: one piece, or one for each line that is not blank."""
        m = _STRING.match(self.text, at)
        if m is None:
            return None
        part = next(p for p in ("long", "short", "raw", "inner") if m[p] is not None)
        if "\n" not in m[part]:
            return [(m.start(part), m.end(part), True)], m.end()
        pieces, start = [], m.start(part)
        for line in m[part].split("\n"):
            kept = line.strip()
            if kept:
                left = start + line.index(kept)
                pieces.append((left, left + len(kept), True))
            start += len(line) + 1
        return pieces, m.end()

    def chained(self, at: int) -> int | None:
        """The assignment that starts here, as in `a = b = value`."""
        i = self.at.get(at)
        if i is None or not self.values[i] or not any(self.values[i]):
            return None
        m = self.targets[i]
        spaced = m["gap"] or m["type"] or self.text[m.end() : m.end() + 1] in ("\"", "'")
        return i if spaced and m["op"] != ":" else None

    def value(self, at: int, joined: list, loose: list) -> int:
        """Reads operands joined by + or standing side by side; returns where they end."""
        text = self.text
        while True:
            string = self.string(at)
            if string:
                pieces, at = string
                joined += pieces
            elif text[at : at + 1] in ("(", "["):
                at = self.enclosed(at, joined if text[at] == "(" else None, loose)
            else:
                inner = self.chained(at)
                bare = _BARE.match(text, at)
                if inner is not None:
                    m = self.targets[inner]
                    joined.append((m.start("name"), m.end("name"), False))
                    return self.ends[inner]
                if bare is None:
                    return at
                at = bare.end()
                if text[at : at + 1] == "(":
                    at = self.enclosed(at, None, loose)
                else:
                    joined.append((bare.start(), bare.end(), False))
            plus = _PLUS.match(text, at)
            if plus:
                at = plus.end()
                continue
            after = _BLANKS.match(text, at).end()
            if not string or not _STRING.match(text, after):
                return at
            at = after

    def enclosed(self, at: int, joined: list | None, loose: list) -> int:
        """Reads up to the closing bracket or a blank line.

        Without commas what a round bracket holds is one joined value; otherwise the literals are loose ones.
        """
        text, depth, pieces, alone = self.text, 0, [], joined is not None
        while at < len(text):
            at = _WIDE_BLANKS.match(text, at).end()
            c = text[at : at + 1]
            if not c or c == "\n":
                break
            i = self.at.get(at, self.at.get(at + 1) if c in "\"'" else None)
            if i is not None and self.values[i] is not None:
                m = self.targets[i]
                if any(self.values[i]):
                    pieces.append((m.start("name"), m.end("name"), False))
                alone, at = False, self.ends[i]
                continue
            string = self.string(at) if c in "\"'`\\rRbBuUfF" else None
            if string:
                pieces += string[0]
                at = string[1]
                continue
            bare = _BARE.match(text, at)
            if bare:
                if text[bare.end() : bare.end() + 1] == "(":
                    alone = False
                else:
                    pieces.append((bare.start(), bare.end(), False))
                at = bare.end()
                continue
            depth += (c in "([{") - (c in ")]}")
            alone = alone and c in "()+"
            at += 1
            if not depth:
                break
        if alone:
            joined += pieces
        else:
            loose += pieces
        return at


def pairs(text: str) -> list[tuple[str, list[tuple[int, int, bool]], list[tuple[int, int, bool]]]]:
    """Name, joined operands and loose ones (start, end, quoted) of each assignment, in order."""
    return _Lexer(text).pairs() if "=" in text or ":" in text else []


def name_score(name: str) -> float:
    """How much a name says that it holds a secret: 1 - the product of what its parts leave open."""
    parts = [p.lower() for p in _SPLIT.split(name) if p]
    left = 1.0
    for part in {*parts, "".join(parts)}:
        left *= 1 - SENSITIVE.get(part, 0.0)
    return 1 - left


def literal_score(value: str | Counter, trusted: bool = False) -> float:
    """How random a literal looks: its entropy a character, and whether it mixes kinds of characters.

    A literal with white space or fewer than LEAST_CHARS characters scores only where its name is `trusted`.
    """
    counts = Counter(value)
    n = sum(counts.values())
    if n < (SHORT_CHARS if trusted else LEAST_CHARS) or (not trusted and any(map(str.isspace, counts))):
        return 0.0
    entropy = -sum(x / n * math.log2(x / n) for x in counts.values())
    every = "".join(counts)
    kinds = sum(map(bool, (re.search("[a-z]", every), re.search("[A-Z]", every), re.search("[0-9]", every), re.search("[^A-Za-z0-9]", every))))
    return min(1.0, entropy / 3.5) * (0.4, 0.4, 0.8, 0.95, 1.0)[kinds]


def _closure(front: set[str], takes: dict[str, set[str]], reached: set[str]) -> set[str]:
    """Names from which constants flow into `front`, itself included, that were not reached before; adds them."""
    new = set()
    while front := front - reached:
        reached |= front
        new |= front
        front = {t for n in front for t in takes.get(n, ())}
    return new


class _Joined:
    """Characters of the value of each assignment, with names replaced by what they hold there.

    A name stands for its latest assignment above, or its first one where there is none above; a name that hangs
    on itself adds nothing.
    """

    def __init__(self, text: str, found: list):
        self.text, self.found, self.known = text, found, {}
        self.lines: dict[str, list[int]] = {}
        for i, (name, _, _) in enumerate(found):
            self.lines.setdefault(name, []).append(i)

    def operands(self, i: int) -> list:
        """Assignments for the operands that are names, and literals for the others."""
        out = []
        for start, end, quoted in self.found[i][1]:
            value = self.text[start:end]
            lines = self.lines.get(value) if not quoted else None
            out.append(value if lines is None else lines[max(0, bisect_left(lines, i) - 1)])
        return out

    def value(self, i: int) -> Counter:
        waiting, opened = [i], set()
        while waiting:
            at = waiting[-1]
            if at in self.known:
                waiting.pop()
                continue
            parts = self.operands(at)
            ahead = [p for p in parts if not isinstance(p, str) and p not in self.known and p not in opened]
            if at not in opened and ahead:
                opened.add(at)
                waiting += ahead
                continue
            total = Counter()
            for p in parts:
                total.update(p if isinstance(p, str) else self.known.get(p, ()))
            self.known[at] = total
            waiting.pop()
        return self.known[i]


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of literals that reach a sensitive name, directly or through names assigned before or after it.

    Joined literals count alone and as the joined value; where that scores, all that flows into it is reported.
    """
    holds: dict[str, set[tuple[int, int]]] = {}
    takes: dict[str, set[str]] = {}
    found = pairs(text)
    names = {name for name, _, _ in found}
    short = set()
    for name, operands, loose in found:
        for start, end, quoted in [*operands, *loose]:
            if not quoted and text[start:end] in names:
                takes.setdefault(name, set()).add(text[start:end])
        for start, end, quoted in operands:
            if quoted or text[start:end] not in names:
                holds.setdefault(name, set()).add((start, end))
                if not quoted and end - start < LEAST_CHARS:
                    short.add((start, end))
        for start, end, quoted in loose:
            if quoted and not _LOOKED_UP.fullmatch(text, start, end):
                holds.setdefault(name, set()).add((start, end))
    # the most sensitive name that each name's constants reach decides
    weights, reached = {}, set()
    for weight, name in sorted(((name_score(n), n) for n in names), reverse=True):
        if not weight:
            break
        weights |= dict.fromkeys(_closure({name}, takes, reached), weight)

    def scores(weight: float, value: str | Counter) -> bool:
        return weight * literal_score(value, weight >= HIGHLY_SENSITIVE) >= LEAST_SCORE

    # a short word without quotes is no literal of its own
    spans = {s for n, weight in weights.items() for s in holds.get(n, ()) if s not in short and scores(weight, text[s[0] : s[1]])}
    joined, whole = _Joined(text, found), set()
    for i, (name, operands, _) in enumerate(found):
        if len(operands) > 1 and name in weights and scores(weights[name], joined.value(i)):
            spans |= {(s, e) for s, e, quoted in operands if quoted or text[s:e] not in names}
            for n in _closure({text[s:e] for s, e, quoted in operands if not quoted and text[s:e] in names}, takes, whole):
                spans |= holds.get(n, set())
    return [(start, end, "lexed") for start, end in spans]


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and those that the lexer adds outside of them."""
    base = base_spans(text)
    covers = sorted((s, e) for s, e, _ in base)
    starts, reach = [s for s, _ in covers], list(accumulate((e for _, e in covers), max))
    more = []
    for span in lexed_spans(text):
        before = bisect_right(starts, span[0])
        if not before or reach[before - 1] < span[1]:
            more.append(span)
    return base, more


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of start, end, kind) and lexed spans of every whole text, in code points."""
    kind = "array<struct<start: long, end: long, kind: string>>"

    def scan(batches):
        for batch in batches:
            found = [all_spans(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                **{name: [[dict(zip(("start", "end", "kind"), s, strict=True)) for s in f[i]] for f in found] for i, name in enumerate(("base", "lexed"))},
            })

    return texts(docs).mapInPandas(scan, f"doc_id long, base {kind}, lexed {kind}")


def contract(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every document."""

    def digest(batches):
        for batch in batches:
            out = []
            for base, lexed in zip(batch["base"], batch["lexed"], strict=True):
                base, lexed = ([(s["start"], s["end"], s["kind"]) for s in x] for x in (base, lexed))
                n = Counter(kind for _, _, kind in base)
                out.append((n["assign"], n["access"], n["hex"], sha256(spans_text(base, KINDS)), spans_text([*base, *lexed], KINDS)))
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            yield pd.DataFrame(out, columns=names).astype({"base_sha256": object, "spans": object}).assign(doc_id=batch["doc_id"].astype("Int64").array)

    columns = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, doc_id long"
    return secret_spans(docs).mapInPandas(digest, columns).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by a mark; a null text stays null, n_chars follows the text."""

    def replace(series: pd.Series) -> pd.Series:
        out = []
        for text in series:
            if text is None:
                out.append(None)
                continue
            base, lexed = all_spans(text)
            parts, at = [], 0
            for start, end, _ in sorted([*base, *lexed]):
                if start >= at:
                    parts += [text[at:start], mark]
                at = max(at, end)
            out.append("".join([*parts, text[at:]]) if parts else text)
        return pd.Series(out, dtype=object)

    cleaned = F.pandas_udf(replace, "string")(F.col("text"))
    rows = docs.withColumn("text", cleaned)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows
