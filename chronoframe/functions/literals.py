"""Literals of the query language: durations, timestamps, numbers with units, time windows."""

from __future__ import annotations

import math
import re
import time
from dataclasses import dataclass
from datetime import datetime, timezone

# Milliseconds in each duration unit (a year has 365 days).
UNIT_MS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
# Powers of ten and of two for number suffixes.
NUMBER_UNITS = {"k": 1, "m": 2, "g": 3, "t": 4}

_DURATION = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(ms|s|m|h|d|w|y)?")
_NUMBER = re.compile(r"([+-]?)(\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)(?:([kKmMgGtT])([iI]?)[bB]?)?")
MAX_TS = (1 << 63) - 1


def parse_duration(text: str | int) -> int:
    """Milliseconds of ``2h5m``, ``1.5d``, ``-2h5m`` or a plain number; a minus holds for what follows it."""
    if isinstance(text, int):
        return text
    at, total, minus = 0, 0.0, False
    if not text:
        raise ValueError("empty duration")
    while at < len(text):
        m = _DURATION.match(text, at)
        if not m or m.end() < len(text) and not m[2]:
            raise ValueError(f"invalid duration {text!r}")
        value = float(m[1]) * UNIT_MS[m[2] or "ms"]
        total += -value if minus and value > 0 else value
        minus |= value < 0
        at = m.end()
    if abs(total) > 1 << 61:
        raise ValueError(f"duration {text!r} is too large")
    return int(math.floor(abs(total) + 0.5)) * (-1 if total < 0 else 1)


def parse_timestamp(text: str | int) -> int:
    """Milliseconds: an integer is taken as such, a decimal number as seconds (unless it is too large), else RFC 3339."""
    if isinstance(text, int):
        value = text
    elif re.fullmatch(r"[+-]?\d+", text):
        value = int(text)
    elif re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        seconds = float(text)
        value = round(seconds) if seconds >= (1 << 32) - 1 else round(seconds * 1000)
    else:
        try:
            found = datetime.fromisoformat(text)
        except ValueError:
            raise ValueError(f"invalid timestamp {text!r}") from None
        found = found if found.tzinfo else found.replace(tzinfo=timezone.utc)
        value = round(found.timestamp() * 1000)
    if value < 0:
        raise ValueError(f"negative timestamp {text!r}")
    return value


def parse_number(text: str) -> float:
    """``2k`` (1000), ``3Mi`` (2**20), ``1_000``, ``0x1F``, ``0b11``, ``0o17``, ``inf``, ``nan``."""
    low = text.lower()
    if low in ("inf", "+inf", "-inf", "nan"):
        return float(low)
    if re.fullmatch(r"0[xbo][0-9a-f]+", low):
        return float(int(low, 0))
    m = _NUMBER.fullmatch(text)
    if not m:
        raise ValueError(f"invalid number {text!r}")
    value = float(m[2].replace("_", ""))
    if m[3]:
        value *= (1024 if m[4] else 1000) ** NUMBER_UNITS[m[3].lower()]
    return -value if m[1] == "-" else value


@dataclass(frozen=True)
class Window:
    """Inclusive bounds in milliseconds; None is open."""

    start: int | None = None
    end: int | None = None


def parse_window(start: str | int = "-", end: str | int = "+", now: int | None = None) -> Window:
    """``-`` and ``+`` are open, ``*`` is now, a signed duration counts from now; as an end, from the start.

    A window whose start is after its end matches nothing.
    """
    now = int(time.time() * 1000) if now is None else now

    def bound(text: str | int, base: int) -> int | None:
        if isinstance(text, int):
            return parse_timestamp(text)
        if text in "-+" and text:
            return None
        if text == "*":
            return now
        if text[:1] in "-+" and not text[1:].isdigit():
            ms = parse_duration(text[1:])
            return base - ms if text[0] == "-" else base + ms
        return parse_timestamp(text)

    first = bound(start, now)
    if start == "+":
        first = MAX_TS
    relative = isinstance(end, str) and len(end) > 1 and end[0] in "-+" and not end[1:].isdigit()
    last = bound(end, (first or 0) if relative else now)
    return Window(first, 0 if end == "-" else last)
