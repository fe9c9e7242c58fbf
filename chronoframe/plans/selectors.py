"""Label selectors, parsed into predicates over a map column of labels.

Grammar: ``name``, ``name{matchers}``, ``{matchers}``, or a bare ``label=value``. Matchers are
joined by commas (and) or ``or``; selectors by ``or``. Operators: ``=``, ``!=`` with a value or
a list ``(a,b)``; ``=~``, ``!~`` anchored regular expressions; ``^=``, ``^~`` starts with one of, or
none of, some prefixes. An absent label is the empty string everywhere.

Regular expressions that are only a word, alternatives of words, or a word and ``.*`` become
comparisons, which need no regular expression at run time.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_LABEL = "__name__"
_TOKEN = re.compile(r"""\s*(?:(?P<op>=~|!~|!=|\^=|\^~|==?|[{}(),])|"(?P<dq>(?:[^"\\]|\\.)*)"|'(?P<sq>(?:[^'\\]|\\.)*)'|(?P<word>[^\s{}(),=!^"'~]+))""")
_LITERAL = re.compile(r"[\w:/@%# -]*")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


class SelectorError(ValueError):
    """A selector that can't be parsed, or a list of them that would match every series."""


@dataclass(frozen=True)
class Matcher:
    label: str
    op: str
    values: tuple[str, ...]

    def column(self, labels: Column) -> Column:
        v = F.coalesce(F.try_element_at(labels, F.lit(self.label)), F.lit(""))
        match self.op:
            case "=" | "!=":
                hit = v.isin(*self.values) if self.values else v == ""
            case "=~" | "!~":
                hit = _regex(v, self.values[0])
            case _:
                hit = F.lit(False)
                for p in self.values:
                    hit = hit | v.startswith(p)
        return ~hit if self.op in ("!=", "!~", "^~") else hit

    def accepts(self, value: str) -> bool:
        """The same test in Python, for one value."""
        match self.op:
            case "=" | "!=":
                hit = value in (self.values or ("",))
            case "=~" | "!~":
                hit = re.fullmatch(self.values[0], value) is not None
            case _:
                hit = value.startswith(self.values)
        return hit ^ (self.op in ("!=", "!~", "^~"))

    @property
    def bounded(self) -> bool:
        """Whether only series that have the label can match, so that the matcher narrows a search."""
        return self.op in ("=", "=~", "^=") and not self.accepts("")


def _regex(v: Column, pattern: str) -> Column:
    if pattern == ".*":
        return F.lit(True)
    if pattern == ".+":
        return v != ""
    if all(map(_LITERAL.fullmatch, parts := pattern.split("|"))):
        return v.isin(*parts)
    for tail, test in ((".*", lambda x: v.startswith(x)), (".+", lambda x: v.startswith(x) & (F.length(v) > len(x)))):
        if pattern.endswith(tail) and _LITERAL.fullmatch(pattern[:-2]):
            return test(pattern[:-2])
    return v.rlike(f"^(?:{pattern})$")


@dataclass(frozen=True)
class Selector:
    """Any of several groups of matchers, all of which must hold."""

    groups: tuple[tuple[Matcher, ...], ...]

    def column(self, labels: Column) -> Column:
        out = F.lit(False)
        for group in self.groups:
            both = F.lit(True)
            for m in group:
                both = both & m.column(labels)
            out = out | both
        return out

    def accepts(self, labels: dict[str, str]) -> bool:
        return any(all(m.accepts(labels.get(m.label, "")) for m in g) for g in self.groups)

    @property
    def bounded(self) -> bool:
        return all(any(m.bounded for m in g) for g in self.groups)


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise SelectorError(f"unexpected {text[at:]!r} in {text!r}")
            if m["op"]:
                self.tokens.append(("op", "=" if m["op"] == "==" else m["op"]))
            elif m["word"] is not None:
                self.tokens.append(("or" if m["word"].lower() == "or" else "word", m["word"]))
            else:
                raw = m["dq"] if m["dq"] is not None else m["sq"]
                self.tokens.append(("string", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), raw)))
            at = m.end()
        self.i = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "")

    def take(self, *kinds: str, op: str | None = None) -> str:
        kind, text = self.peek()
        if op is not None and (kind, text) != ("op", op) or kinds and kind not in kinds:
            raise SelectorError(f"unexpected {text or 'end'!r} in {self.text!r}")
        self.i += 1
        return text

    def matcher(self) -> Matcher:
        label, op = self.take("word", "string"), self.take("op")
        if op not in ("=", "!=", "=~", "!~", "^=", "^~"):
            raise SelectorError(f"unknown operator {op!r} in {self.text!r}")
        values: tuple[str, ...]
        if self.peek() == ("op", "("):
            self.take(op="(")
            found = []
            while self.peek() != ("op", ")"):
                found.append(self.take("word", "string", "or"))
                if self.peek() == ("op", ","):
                    self.take(op=",")
            self.take(op=")")
            values = tuple(found)
        else:
            values = (self.take("word", "string", "or") if self.peek()[0] in ("word", "string", "or") else "",)
        if op in ("=~", "!~"):
            if len(values) > 1:
                values = ("|".join(f"(?:{v})" for v in values),)
            try:
                re.compile(values[0] if values else "")
            except re.error as e:
                raise SelectorError(f"invalid regular expression in {self.text!r}: {e}") from None
        if op in ("^=", "^~") and (not values or "" in values):
            raise SelectorError(f"an empty prefix in {self.text!r}")
        return Matcher(label, op, values)

    def selector(self) -> tuple[tuple[Matcher, ...], ...]:
        name: tuple[Matcher, ...] = ()
        if self.peek()[0] in ("word", "string"):
            nxt = self.tokens[self.i + 1] if self.i + 1 < len(self.tokens) else ("end", "")
            if nxt[0] == "op" and nxt[1] in ("=", "!=", "=~", "!~", "^=", "^~"):
                return ((self.matcher(),),)
            name = (Matcher(NAME_LABEL, "=", (self.take("word", "string"),)),)
            if self.peek() != ("op", "{"):
                return (name,)
        self.take(op="{")
        groups: list[list[Matcher]] = [[]]
        while self.peek() != ("op", "}"):
            groups[-1].append(self.matcher())
            if self.peek() == ("op", ","):
                self.take(op=",")
            elif self.peek()[0] == "or":
                self.take("or")
                groups.append([])
        self.take(op="}")
        if any(not g for g in groups) and not name:
            raise SelectorError(f"an empty selector in {self.text!r}")
        return tuple((*name, *g) for g in groups)


def parse_selector(text: str) -> Selector:
    p = _Parser(text)
    groups = list(p.selector())
    while p.peek()[0] == "or":
        p.take("or")
        groups += p.selector()
    p.take("end")
    return Selector(tuple(groups))


def parse_selectors(texts: Sequence[str], check: bool = True) -> list[Selector]:
    """Selectors of which all must hold; at least one must need a label to be there."""
    found = [parse_selector(t) for t in texts]
    if check and not any(s.bounded for s in found):
        raise SelectorError("at least one matcher must need a value")
    return found


def selector_column(texts: Sequence[str], labels: Column, check: bool = True) -> Column:
    out = F.lit(True)
    for s in parse_selectors(texts, check):
        out = out & s.column(labels)
    return out


def parse_metric(text: str) -> dict[str, str]:
    """Labels of a metric name such as ``cpu{host="a", dc="b"}``."""
    groups = parse_selector(text).groups
    if len(groups) != 1 or any(m.op != "=" or len(m.values) != 1 for m in groups[0]):
        raise SelectorError(f"{text!r} is no metric name")
    labels = {m.label: m.values[0] for m in groups[0]}
    if len(labels) < len(groups[0]) or len(labels) > 128:
        raise SelectorError(f"a repeated label, or too many, in {text!r}")
    return labels
