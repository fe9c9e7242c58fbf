"""The 23 bucket aggregators as Catalyst aggregate expressions.

An aggregator is given as a name, or as name(op operand) for the conditional ones. Every
aggregator has its value, the test whether a sample is accepted (a bucket is reported if one
of its aggregators accepted a sample) and the value of a bucket that EMPTY fills.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import parse_number
from .numeric import NAN, compare, ok

COUNTER = ("increase", "rate", "irate")
PLAIN = ("avg", "sum", "count", "countall", "countnan", "min", "max", "range", "first", "last", "std.p", "std.s", "var.p", "var.s", *COUNTER)
CONDITIONAL = ("countif", "sumif", "share", "all", "any", "none")
TALLIES = ("sum", "count", "countall", "countnan", "countif", "sumif")
#: Not meant for reducing several series: they depend on an order in time.
ORDERED = ("first", "last", "rate")


@dataclass(frozen=True)
class Aggregator:
    name: str
    op: str | None = None
    operand: float | None = None
    alias: str | None = None

    def __post_init__(self) -> None:
        conditional = {"count": "countif", "sum": "sumif"}.get(self.name, self.name) if self.op else self.name
        object.__setattr__(self, "name", conditional)
        if self.name not in PLAIN + CONDITIONAL:
            raise ValueError(f"unknown aggregator {self.name!r}")
        if (self.op is None) == (self.name in CONDITIONAL):
            raise ValueError(f"{self.name} {'needs' if self.op is None else 'takes no'} condition")

    @property
    def column(self) -> str:
        return self.alias or self.name.replace(".", "_")

    @property
    def empty(self) -> float:
        """The value of a filled bucket; last carries instead."""
        return 0.0 if self.name in TALLIES else NAN

    def accepts(self, value: Column) -> Column:
        if self.name == "countnan":
            return F.isnan(value)
        return F.lit(True) if self.name in ("countall", *CONDITIONAL) else ~F.isnan(value)

    def value(self, ts: Column, value: Column, bucket_ms: int | None = None, previous: Column | None = None) -> Column:
        """The aggregate of a group. ``previous`` is a struct (ts, value) of the sample before that is not NaN, for counters."""
        v = ok(value)
        plain = {
            "avg": lambda: F.avg(v),
            "sum": lambda: F.sum(v),
            "count": lambda: F.count(v).cast("double"),
            "countall": lambda: F.count(F.lit(1)).cast("double"),
            "countnan": lambda: F.count_if(F.isnan(value)).cast("double"),
            "min": lambda: F.min(v),
            "max": lambda: F.max(v),
            "range": lambda: F.max(v) - F.min(v),
            "first": lambda: F.min_by(v, F.when(v.isNotNull(), ts)),
            "last": lambda: F.max_by(v, F.when(v.isNotNull(), ts)),
            "std.p": lambda: F.stddev_pop(v),
            "std.s": lambda: F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)),
            "var.p": lambda: F.var_pop(v),
            "var.s": lambda: F.when(F.count(v) == 1, 0.0).otherwise(F.var_samp(v)),
        }
        if self.name in plain:
            out = plain[self.name]()
        elif self.name in COUNTER:
            out = self._counter(ts, v, bucket_ms, previous)
        else:
            hit = compare(self.op, value, F.lit(float(self.operand)))
            n, hits = F.count(F.lit(1)), F.count_if(hit)
            out = {
                "countif": lambda: hits.cast("double"),
                "sumif": lambda: F.coalesce(F.sum(F.when(hit, value)), F.lit(0.0)),
                "share": lambda: hits / n,
                "all": lambda: F.bool_and(hit).cast("double"),
                "any": lambda: F.bool_or(hit).cast("double"),
                "none": lambda: (~F.bool_or(hit)).cast("double"),
            }[self.name]()
        return F.coalesce(out, F.lit(NAN))

    def _counter(self, ts: Column, v: Column, bucket_ms: int | None, previous: Column | None) -> Column:
        if bucket_ms is None or previous is None:
            raise ValueError(f"{self.name} needs buckets")
        rise = F.when(v.isNotNull(), F.greatest(F.coalesce(v - previous["value"], F.lit(0.0)), F.lit(0.0)))
        if self.name == "increase":
            return F.sum(rise)
        if self.name == "rate":
            seconds = bucket_ms // 1000
            return F.sum(rise) / F.lit(float(seconds)) if seconds else F.first(F.lit(NAN))
        pair = F.max_by(F.struct(v.alias("v"), previous["value"].alias("pv"), (ts - previous["ts"]).alias("dt")), F.when(v.isNotNull(), ts))
        return F.when((pair["v"] >= pair["pv"]) & (pair["dt"] > 0), (pair["v"] - pair["pv"]) / (F.when(pair["dt"] > 0, pair["dt"]) / 1000.0))


_CONDITION = re.compile(r"\s*([a-z.]+)\s*(?:\(\s*(==|!=|>=|<=|>|<)\s*([^)\s]+)\s*\))?\s*", re.I)


def parse_aggregator(text: str | Aggregator) -> Aggregator:
    if isinstance(text, Aggregator):
        return text
    m = _CONDITION.fullmatch(text)
    if not m:
        raise ValueError(f"invalid aggregator {text!r}")
    return Aggregator(m[1].lower(), m[2], parse_number(m[3]) if m[3] else None)


def parse_aggregators(items: str | list) -> list[Aggregator]:
    """1 to 16 different aggregators."""
    found = [parse_aggregator(i) for i in (items.split(",") if isinstance(items, str) else items)]
    if not 1 <= len(found) <= 16 or len({a.name for a in found}) < len(found):
        raise ValueError("1 to 16 different aggregators are needed")
    return found
