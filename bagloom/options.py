"""Engine options; plain values that plans read when they are built."""

from __future__ import annotations

_OPTIONS = {"empty_is_missing": False, "string_start_code": 0x02, "string_end_code": 0x03}


def get(name: str):
    return _OPTIONS[name]


def put(name: str, value) -> None:
    """Sets an option; string codes must fit one byte."""
    if name not in _OPTIONS:
        raise KeyError(name)
    if name.startswith("string_") and not 0 <= value <= 255:
        raise ValueError("a string code must fit in a byte")
    _OPTIONS[name] = value
