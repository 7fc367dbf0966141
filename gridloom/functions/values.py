"""Cell values and their rules, for one value at a time: what the column forms in columns.py do for whole tables.

A value is a float, a str, a bool, a Fault (one of the error codes) or None for a blank cell.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache


@dataclass(frozen=True)
class Fault:
    code: str


DIV0, NA, VALUE, REF, NAME, NUM, NULL = map(Fault, ("#DIV/0!", "#N/A", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#NULL!"))

Value = float | str | bool | Fault | None

#: Numbers as text. A percent sign divides by 100; commas may stand between digits.
NUMERIC = re.compile(r"[+-]?\$?(?:\d+(?:,\d+)*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?%?$")


def parse_number(text: str) -> float | None:
    text = text.strip()
    if not NUMERIC.match(text):
        return None
    share = text.endswith("%")
    n = float(text.rstrip("%").replace("$", "").replace(",", ""))
    return n / 100 if share else n


def number(v: Value) -> float | Fault:
    if isinstance(v, Fault):
        return v
    if v is None:
        return 0.0
    if isinstance(v, str):
        n = parse_number(v)
        return VALUE if n is None else n
    return float(v)


def general(n: float) -> str:
    """A number as text: whole numbers below 1e15 without a point, else at most 15 digits, never with an exponent."""
    if n == int(n) and abs(n) < 1e15:
        return str(int(n))
    shown = format(Decimal(repr(n)), "f")
    if sum(c.isdigit() for c in shown) <= 15:
        return shown
    whole = len(str(int(abs(n))))
    shown = f"{n:.{max(0, 15 - whole)}f}"
    return shown.rstrip("0").rstrip(".") if "." in shown else shown


def text(v: Value) -> str | Fault:
    if isinstance(v, Fault | str):
        return v
    if v is None:
        return ""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return general(v)


def truth(v: Value) -> bool | Fault:
    if isinstance(v, Fault):
        return v
    if isinstance(v, str):
        return {"true": True, "false": False}.get(v.lower(), VALUE)
    return bool(v)


def finite(n: float) -> float | Fault:
    return n if math.isfinite(n) else NUM


def arithmetic(op: str, a: Value, b: Value) -> Value:
    x, y = number(a), number(b)
    if isinstance(x, Fault):
        return x
    if isinstance(y, Fault):
        return y
    try:
        if op == "+":
            return finite(x + y)
        if op == "-":
            return finite(x - y)
        if op == "*":
            return finite(x * y)
        if op == "/":
            return DIV0 if y == 0 else finite(x / y)
        return power(x, y)
    except OverflowError:
        return NUM


def power(x: float, y: float) -> float | Fault:
    if x == 0 and y == 0:
        return NUM
    if x == 0 and y < 0:
        return DIV0
    if x < 0 and y != int(y):
        return NUM
    try:
        return finite(math.pow(x, y))
    except (OverflowError, ValueError):
        return NUM


def joined(a: Value, b: Value) -> Value:
    x, y = text(a), text(b)
    return x if isinstance(x, Fault) else y if isinstance(y, Fault) else x + y


def rank(v: Value) -> int:
    return 2 if isinstance(v, bool) else 1 if isinstance(v, str) else 0


def compare(a: Value, b: Value) -> int | Fault:
    """-1, 0 or 1: numbers before text before truth values; a blank takes the other side's zero; case doesn't count."""
    if isinstance(a, Fault):
        return a
    if isinstance(b, Fault):
        return b
    zero = lambda other: "" if isinstance(other, str) else False if isinstance(other, bool) else 0.0
    a, b = zero(b) if a is None else a, zero(a) if b is None else b
    if rank(a) != rank(b):
        return -1 if rank(a) < rank(b) else 1
    if isinstance(a, str):
        a, b = a.lower(), b.lower()
    return (a > b) - (a < b)


def compared(op: str, a: Value, b: Value) -> Value:
    c = compare(a, b)
    if isinstance(c, Fault):
        return c
    return {"=": c == 0, "<>": c != 0, "<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[op]


# --- criteria

_OPERATOR = re.compile(r"(>=|<=|<>|>|<|=)?(.*)$", re.S)


def glob(pattern: str) -> str:
    """A wildcard pattern as a regular expression: * any run, ? any character, ~ before a character takes it literally."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return out


def has_wildcard(text_: str) -> bool:
    return any(c in text_ for c in "*?~")


@dataclass(frozen=True)
class Criterion:
    """kind: number, text, wild, blank, nonblank, bool, fault."""

    kind: str
    op: str = "="
    value: object = None

    def matches(self, v: Value) -> bool:
        other = self.op == "<>"
        if self.kind == "number":
            if isinstance(v, float | int) and not isinstance(v, bool):
                return bool(compared(self.op, float(v), self.value))
            if isinstance(v, str) and self.op in ("=", "<>"):  # text that looks like the number
                n = parse_number(v)
                return (n == self.value) != other if n is not None else other
            return False
        if self.kind == "blank":
            return (v is None or v == "") and not isinstance(v, bool)
        if self.kind == "nonblank":
            return v is not None
        if self.kind in ("bool", "fault"):
            return (type(v) is type(self.value) and v == self.value) != other
        if not isinstance(v, str):
            return other
        if self.kind == "wild":
            return bool(re.fullmatch(self.value, v.lower(), re.S)) != other
        return bool(compared(self.op, v, self.value))


@lru_cache(maxsize=10_000)
def _criterion(text_: str) -> Criterion:
    op, rest = _OPERATOR.match(text_).groups()
    if rest == "":
        return Criterion("nonblank") if op == "<>" else Criterion("blank")
    op = op or "="
    if (n := parse_number(rest)) is not None:
        return Criterion("number", op, n)
    if rest.upper() in ("TRUE", "FALSE"):
        return Criterion("bool", op, rest.upper() == "TRUE")
    if rest.upper() in ("#DIV/0!", "#N/A", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#NULL!"):
        return Criterion("fault", op, Fault(rest.upper()))
    if op in ("=", "<>") and has_wildcard(rest):
        return Criterion("wild", op, glob(rest.lower()))
    return Criterion("text", op, rest.lower())


def criterion(v: Value) -> Criterion:
    if isinstance(v, str):
        return _criterion(v)
    if v is None:
        return Criterion("number", "=", 0.0)
    if isinstance(v, bool):
        return Criterion("bool", "=", v)
    if isinstance(v, Fault):
        return Criterion("fault", "=", v)
    return Criterion("number", "=", float(v))


# --- rounding and dates


def rounded(x: float, digits: int) -> float | Fault:
    """Half away from zero, on the number as its 15 significant digits show it."""
    shown = Decimal(f"{x:.14e}")
    if digits > 300 or shown == 0:
        return x
    out = float(shown.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if digits > -300 and shown.adjusted() + digits < 27 else x
    return finite(out)


def scaled(x: float, digits: int, up: bool) -> float | Fault:
    """Toward zero or away from it, by a power of ten."""
    if abs(digits) > 300:
        return x if digits > 0 else 0.0
    f = 10.0**digits
    n = abs(x) * f
    if not math.isfinite(n):
        return x
    return finite(math.copysign((math.ceil(n) if up else math.floor(n)) / f, x) if x else x)


def days_of(year: int, month: int, day: int) -> int:
    """Days since 1970-01-01 in the proleptic Gregorian calendar; month and day may run over."""
    year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
    year -= month <= 2
    era = year // 400
    of_era = year - era * 400
    of_year = (153 * (month + (-3 if month > 2 else 9)) + 2) // 5
    return era * 146097 + of_era * 365 + of_era // 4 - of_era // 100 + of_year + day - 1 - 719468


def date_of(days: int) -> tuple[int, int, int]:
    days += 719468
    era, of_era = divmod(days, 146097)
    year = (of_era - of_era // 1460 + of_era // 36524 - of_era // 146096) // 365
    of_year = of_era - (365 * year + year // 4 - year // 100)
    month = (5 * of_year + 2) // 153
    day = of_year - (153 * month + 2) // 5 + 1
    month += 3 if month < 10 else -9
    return year + era * 400 + (month <= 2), month, day


EPOCH = days_of(1899, 12, 30)


def serial(year: int, month: int, day: int) -> int:
    """The serial of a date; from 1900-03-01 on one more than before, for a day that never was."""
    n = days_of(year, month, day) - EPOCH
    return n if n >= 61 else n - 1


def parts_of_serial(n: int) -> tuple[int, int, int]:
    if n == 60:
        return 1900, 2, 29
    if n == 0:
        return 1900, 1, 0
    return date_of(n + EPOCH + (n < 60))


EPOCH_1904 = 1462
