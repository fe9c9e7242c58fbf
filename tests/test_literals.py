import math

import pytest

from chronoframe.functions.literals import Window, parse_duration, parse_number, parse_timestamp, parse_window


@pytest.mark.parametrize(("text", "ms"), [("1s", 1000), ("2h5m", 7_500_000), ("-2h5m", -7_500_000), ("2h-5m", 6_900_000), ("1.5d", 129_600_000), ("100", 100), ("1ms", 1), ("1w", 604_800_000), ("1y", 31_536_000_000)])
def test_durations(text, ms):
    assert parse_duration(text) == ms


@pytest.mark.parametrize("text", ["", "abc", "1x", "s"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        parse_duration(text)


def test_timestamps():
    assert parse_timestamp("1000") == 1000
    assert parse_timestamp("1562529662.678") == 1562529662678
    assert parse_timestamp("2024-01-01T00:00:00Z") == 1704067200000
    for bad in ("-5", "nonsense"):
        with pytest.raises(ValueError):
            parse_timestamp(bad)


@pytest.mark.parametrize(("text", "value"), [("2k", 2000), ("2.3Kb", 2300), ("3ki", 3072), ("3Mi", 3 * 2**20), ("1_000", 1000), ("0x1F", 31), ("0b11", 3), ("-2k", -2000), ("1e3", 1000)])
def test_numbers(text, value):
    assert parse_number(text) == pytest.approx(value)


def test_special_numbers():
    assert math.isnan(parse_number("NaN")) and parse_number("-inf") == -math.inf
    with pytest.raises(ValueError):
        parse_number("12abc")


def test_windows():
    assert parse_window("-", "+") == Window(None, None)
    assert parse_window("-3h", "*", now=20_000_000) == Window(9_200_000, 20_000_000)
    assert parse_window(1000, "+1s") == Window(1000, 2000)
    assert parse_window("-1000s", 5, now=2_000_000) == Window(1_000_000, 5)
    with pytest.raises(ValueError):
        parse_window("-1000", "+")
