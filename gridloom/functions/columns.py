"""Cell values as Spark columns: coercions, operators and the scalar functions, for whole tables at once.

A ``Cell`` is a column with a static kind. Faults travel beside the value as a column of codes, which is left out where an
expression can't fail. A null value is a blank cell. Nothing here raises in ANSI mode: what could is guarded or a try_ form.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import values as V
from gridloom.functions.values import Fault

#: The struct of a column whose cells differ in kind: k is n, t or b.
MIXED = "struct<k:string,n:double,t:string,b:boolean>"


@dataclass
class Cell:
    """kind: num, text, bool, blank, fault or mixed; v: the values; e: codes of faults, None if there are none; constant:
    the value itself if it is one; blank: whether v may be null; day: the date column that v's serials come from."""

    kind: str
    v: Column
    e: Column | None = None
    blank: bool = False
    constant: V.Value = None
    is_constant: bool = False
    day: Column | None = None  # the date that a serial number was made from


def constant(value: V.Value) -> Cell:
    if value is None:
        return Cell("blank", F.lit(None).cast("double"), None, True, None, True)
    if isinstance(value, Fault):
        return Cell("fault", F.lit(None).cast("double"), F.lit(value.code), True, value, True)
    kind = "bool" if isinstance(value, bool) else "text" if isinstance(value, str) else "num"
    return Cell(kind, F.lit(float(value) if kind == "num" else value), None, False, value, True)


def fault(code: Fault) -> Cell:
    return constant(code)


def first_fault(*faults: Column | None) -> Column | None:
    """The first code that is there, in the order of the operands."""
    found = [e for e in faults if e is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def when_fault(condition: Column, code: Fault) -> Column:
    return F.when(condition, F.lit(code.code))


def number(v: Column, *faults: Column | None, checked: bool = False) -> Cell:
    """A numeric result; checked: values that aren't finite are #NUM!."""
    own = when_fault(F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull(), V.NUM) if checked else None
    return Cell("num", v, first_fault(*faults, own))


# --- coercions

_NUMERIC = V.NUMERIC.pattern.replace("(?:", "(")


def parsed(t: Column) -> Column:
    """The number that a text shows, else null."""
    t = F.trim(t)
    plain = F.regexp_replace(t, "[$,%]", "").try_cast("double")
    return F.when(t.rlike("^" + _NUMERIC), F.when(t.endswith("%"), plain / 100).otherwise(plain))


def as_number(x: Cell) -> Cell:
    if x.kind == "num":
        return Cell("num", F.coalesce(x.v, F.lit(0.0)) if x.blank else x.v, x.e)
    if x.kind == "bool":
        return Cell("num", F.coalesce(x.v, F.lit(False)).cast("double"), x.e)
    if x.kind == "blank":
        return Cell("num", F.lit(0.0))
    if x.kind == "fault":
        return Cell("num", F.lit(0.0), x.e)
    if x.kind == "text":
        if x.is_constant:
            n = V.parse_number(x.constant)
            return Cell("num", F.lit(0.0), F.lit(V.VALUE.code)) if n is None else constant(n)
        n = F.when(x.v.isNull(), F.lit(0.0)).otherwise(parsed(x.v))
        return Cell("num", n, first_fault(x.e, when_fault(n.isNull(), V.VALUE)))
    s = x.v
    n = F.when(s.isNull(), F.lit(0.0)).when(s["k"] == "n", s["n"]).when(s["k"] == "b", s["b"].cast("double")).otherwise(parsed(s["t"]))
    return Cell("num", n, first_fault(x.e, when_fault(n.isNull(), V.VALUE)))


def general(n: Column) -> Column:
    """A number as a cell shows it."""
    whole = n.try_cast("bigint")
    shown = n.cast("string")
    digits = F.length(F.regexp_replace(shown, "[^0-9]", ""))
    places = F.greatest(F.lit(0), 15 - F.length(F.abs(whole).cast("string")))
    fixed = F.call_function("format_string", F.concat(F.lit("%."), places.cast("string"), F.lit("f")), n)
    fixed = F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when((n == F.floor(n)) & (F.abs(n) < 1e15), whole.cast("string")).when(~shown.contains("E") & (digits <= 15), shown).otherwise(fixed)


def as_text(x: Cell) -> Cell:
    if x.is_constant and x.kind != "fault":
        return constant(V.text(x.constant))
    if x.kind == "text":
        return Cell("text", F.coalesce(x.v, F.lit("")) if x.blank else x.v, x.e)
    if x.kind == "fault":
        return Cell("text", F.lit(""), x.e)
    if x.kind == "num":
        return Cell("text", F.coalesce(general(x.v), F.lit("")) if x.blank else general(x.v), x.e)
    if x.kind == "bool":
        return Cell("text", F.when(x.v, "TRUE").when(~x.v, "FALSE").otherwise(""), x.e)
    s = x.v
    return Cell("text", F.when(s["k"] == "n", general(s["n"])).when(s["k"] == "t", s["t"]).when(s["k"] == "b", F.upper(s["b"].cast("string"))).otherwise(""), x.e)


def as_bool(x: Cell) -> Cell:
    if x.kind == "bool":
        return Cell("bool", F.coalesce(x.v, F.lit(False)) if x.blank else x.v, x.e)
    if x.kind == "blank":
        return constant(False)
    if x.kind == "fault":
        return Cell("bool", F.lit(False), x.e)
    if x.kind == "num":
        return Cell("bool", F.coalesce(x.v != 0, F.lit(False)), x.e)
    if x.kind == "text":
        low = F.lower(x.v)
        b = F.when(low == "true", True).when(low == "false", False).when(x.v.isNull(), False)
        return Cell("bool", b, first_fault(x.e, when_fault(b.isNull(), V.VALUE)))
    s = x.v
    low = F.lower(s["t"])
    b = F.when(s.isNull(), False).when(s["k"] == "b", s["b"]).when(s["k"] == "n", s["n"] != 0).when(low == "true", True).when(low == "false", False)
    return Cell("bool", b, first_fault(x.e, when_fault(b.isNull(), V.VALUE)))


def mixed(x: Cell) -> Cell:
    if x.kind == "mixed":
        return x
    part = {"num": ("n", "n"), "text": ("t", "t"), "bool": ("b", "b")}.get(x.kind)
    if part is None:
        return Cell("mixed", F.lit(None).cast(MIXED), x.e, True)
    fields = [F.lit(part[0]).alias("k")] + [(x.v if f == part[1] else F.lit(None)).cast(t).alias(f) for f, t in (("n", "double"), ("t", "string"), ("b", "boolean"))]
    struct = F.struct(*fields).cast(MIXED)
    return Cell("mixed", F.when(x.v.isNotNull(), struct) if x.blank else struct, x.e, x.blank)


def together(cells: list[Cell]) -> tuple[str, list[Cell]]:
    """The cells in one kind: their own if it is the same, else mixed. Blanks and faults take any kind."""
    kinds = {c.kind for c in cells if c.kind not in ("blank", "fault")}
    if len(kinds) > 1:
        return "mixed", [mixed(c) for c in cells]
    kind = kinds.pop() if kinds else "num"
    empty = F.lit(None).cast({"num": "double", "text": "string", "bool": "boolean", "mixed": MIXED}[kind])
    return kind, [c if c.kind == kind else Cell(kind, empty, c.e, True) for c in cells]


# --- operators


def arithmetic(op: str, a: Cell, b: Cell) -> Cell:
    x, y = as_number(a), as_number(b)
    faults = [x.e, y.e]
    if op == "/":
        return number(F.try_divide(x.v, y.v), *faults, when_fault(y.v == 0, V.DIV0), checked=True)
    if op == "^":
        return power(x, y)
    return number({"+": x.v + y.v, "-": x.v - y.v, "*": x.v * y.v}[op], *faults, checked=True)


def power(x: Cell, y: Cell) -> Cell:
    own = F.when((x.v == 0) & (y.v == 0), V.NUM.code).when((x.v == 0) & (y.v < 0), V.DIV0.code).when((x.v < 0) & (y.v != F.rint(y.v)), V.NUM.code)
    return number(F.pow(x.v, y.v), x.e, y.e, own, checked=True)


def negated(a: Cell) -> Cell:
    x = as_number(a)
    return Cell("num", -x.v, x.e)


def joined(a: Cell, b: Cell) -> Cell:
    x, y = as_text(a), as_text(b)
    return Cell("text", F.concat(x.v, y.v), first_fault(x.e, y.e))


_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def compared(op: str, a: Cell, b: Cell) -> Cell:
    faults = first_fault(a.e, b.e)
    test = _OPS[op]
    if a.kind == b.kind and a.kind in ("num", "text", "bool"):
        zero = {"num": F.lit(0.0), "text": F.lit(""), "bool": F.lit(False)}[a.kind]
        x, y = (F.coalesce(c.v, zero) if c.blank else c.v for c in (a, b))
        if a.kind == "text":
            x, y = F.lower(x), F.lower(y)
        return Cell("bool", test(x, y), faults)
    x, y = mixed(a).v, mixed(b).v
    rank = lambda s: F.when(s["k"] == "n", 0).when(s["k"] == "t", 1).when(s["k"] == "b", 2)
    zero = lambda s: F.when(s["k"] == "t", F.struct(F.lit("t").alias("k"), F.lit(None).cast("double").alias("n"), F.lit("").alias("t"), F.lit(None).cast("boolean").alias("b"))).when(
        s["k"] == "b", F.struct(F.lit("b").alias("k"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("string").alias("t"), F.lit(False).alias("b"))
    ).otherwise(F.struct(F.lit("n").alias("k"), F.lit(0.0).alias("n"), F.lit(None).cast("string").alias("t"), F.lit(None).cast("boolean").alias("b")))
    p, q = F.coalesce(x, zero(y)), F.coalesce(y, zero(x))
    same = F.when(p["k"] == "n", test(p["n"], q["n"])).when(p["k"] == "t", test(F.lower(p["t"]), F.lower(q["t"]))).otherwise(test(p["b"], q["b"]))
    return Cell("bool", F.when(rank(p) != rank(q), test(rank(p), rank(q))).otherwise(same), faults)


# --- criteria


def matches(criterion: V.Criterion, x: Cell) -> Column:
    """Whether each cell meets a criterion known beforehand; never null, and false for faults unless they are asked for."""
    op, other = criterion.op, criterion.op == "<>"
    here = x.v.isNotNull() if x.blank else F.lit(True)
    if x.e is not None:
        here = here & x.e.isNull()
    is_fault = x.e.isNotNull() if x.e is not None else F.lit(False)
    if x.kind == "mixed":
        k = x.v["k"]
        parts = [(k == "n", Cell("num", x.v["n"])), (k == "t", Cell("text", x.v["t"])), (k == "b", Cell("bool", x.v["b"]))]
        out = F.when(~here, F.lit(criterion.kind == "blank") & ~is_fault if criterion.kind == "blank" else is_fault if criterion.kind == "nonblank" else F.lit(other and criterion.kind != "number"))
        for is_kind, cell in parts:
            out = out.when(is_kind, matches(criterion, cell))
        return F.coalesce(out, F.lit(False))
    if criterion.kind == "blank":
        empty = ~here & ~is_fault
        return (empty | (here & (x.v == ""))) if x.kind == "text" else empty
    if criterion.kind == "nonblank":
        return here | is_fault
    if criterion.kind == "fault":
        same = F.coalesce(x.e == criterion.value.code, F.lit(False)) if x.e is not None else F.lit(False)
        return same != F.lit(other)
    if criterion.kind == "bool":
        return F.coalesce(here & (x.v == F.lit(criterion.value)), F.lit(False)) != F.lit(other) if x.kind == "bool" else F.lit(other)
    if criterion.kind == "number":
        if x.kind == "num":
            return F.coalesce(here & _OPS[op](x.v, F.lit(criterion.value)), F.lit(False))
        if x.kind == "text" and op in ("=", "<>"):
            n = parsed(x.v)
            return F.coalesce(F.when(~here, F.lit(False)).when(n.isNull(), F.lit(other)).otherwise((n == criterion.value) != F.lit(other)), F.lit(False))
        return F.lit(False)
    if x.kind != "text":
        return F.lit(other)
    low = F.lower(x.v)
    if criterion.kind == "wild":
        hit = low.rlike("(?s)^(" + _java(criterion.value) + ")$")
        return F.coalesce(F.when(~here, F.lit(other)).otherwise(hit != F.lit(other)), F.lit(other))
    test = _OPS[op](low, F.lit(criterion.value))
    return F.coalesce(F.when(~here, F.lit(other)).otherwise(test), F.lit(other))


def _java(pattern: str) -> str:
    """Python's escapes are Java's, but for some that Java doesn't know."""
    return "".join(pattern)


def glob(pattern: Column) -> Column:
    """A column of wildcard patterns as regular expressions. A ~ takes the next character literally; at the end it is itself."""
    out = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|])", r"\\$1")
    for mark, held in (("~", "\u0003"), ("*", "\u0001"), ("?", "\u0002")):
        out = F.replace(out, F.lit("~" + mark), F.lit(held))
    out = F.regexp_replace(out, r"~(?=.)", "")
    for held, plain in (("*", ".*"), ("?", "."), ("\u0001", r"\*"), ("\u0002", r"\?"), ("\u0003", "~")):
        out = F.replace(out, F.lit(held), F.lit(plain))
    return out


# --- functions of numbers


def rounded(x: Column, digits: Column | int) -> Column:
    """Half away from zero on 15 significant digits; digits known beforehand. Only what is near a tie, or has many digits
    before the place that is rounded, is written out."""
    d = int(digits)
    shown = F.format_string("%.14e", x).try_cast("decimal(38,18)")
    if -15 <= d <= 15:
        exact = F.round(shown, d).cast("double")
        scale = F.lit(10.0 ** abs(d))
        n = F.abs(x) * scale if d >= 0 else F.abs(x) / scale
        up = F.floor(n + 0.5).cast("double")
        clear = (n < 1e8) & (F.abs(n - F.floor(n) - 0.5) > 1e-6)  # 15 digits of n reach further than that
        quick = F.signum(x) * (up / scale if d >= 0 else up * scale)
        return F.when(clear, quick).when(shown.isNull() | (F.abs(x) >= 1e19), x).otherwise(exact)
    return x if d > 0 else F.lit(0.0)


def scaled(x: Column, digits: int, up: bool) -> Column:
    f = 10.0 ** int(digits)
    n = F.abs(x) * f
    away = F.when(n < 9e15, (F.ceil(n) if up else F.floor(n)).cast("double")).otherwise(n)
    return F.signum(x) * away / f


def floored(x: Column) -> Column:
    return F.when(F.abs(x) < 9e15, F.floor(x).cast("double")).otherwise(x)


def truncated(x: Column) -> Column:
    return F.signum(x) * floored(F.abs(x))


def modulo(n: Column, d: Column) -> Column:
    return n - d * floored(F.try_divide(n, d))


@F.pandas_udf(T.DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return x.map(math.erf)


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc)


@F.pandas_udf(T.StringType())
def proper(t: pd.Series) -> pd.Series:
    from gridloom.plans.interp import proper as one

    return t.map(lambda x: None if x is None else one(x))


def normal_cdf(z: Column) -> Column:
    return 0.5 * erfc(-z / math.sqrt(2))


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


# --- dates

_EPOCH = "1899-12-30"


def serial_of(day: Column) -> Column:
    """A date or timestamp as a serial number; a timestamp's time is the fraction."""
    date = F.to_date(day)
    whole = F.datediff(date, F.lit(_EPOCH).cast("date")).cast("double")
    whole = F.when(whole < 61, whole - 1).otherwise(whole)
    seconds = F.unix_micros(day.cast("timestamp")) - F.unix_micros(date.cast("timestamp"))
    return whole + seconds.cast("double") / 86_400_000_000


def day_of(serial: Column) -> Column:
    """The date of a whole serial from 1 on."""
    n = serial.cast("int")
    return F.date_add(F.lit(_EPOCH).cast("date"), F.when(n < 60, n + 1).otherwise(n))


def date_part(serial: Column, part: str) -> Column:
    n = F.floor(serial).cast("int")
    odd = {"year": (1900, 1900), "month": (2, 1), "day": (29, 0)}[part]
    real = {"year": F.year, "month": F.month, "day": F.day}[part](day_of(F.greatest(n, F.lit(1))))
    return F.when(n == 60, odd[0]).when(n == 0, odd[1]).otherwise(real).cast("double")


def part_of_day(day: Column, part: str) -> Column:
    """``date_part`` of serials that come from dates, straight from the date; a blank, and the day before 1900 began, are serial 0."""
    real, first = {"year": (F.year, 1900), "month": (F.month, 1), "day": (F.day, 0)}[part]
    return F.when(day > F.lit("1899-12-31").cast("date"), real(day)).otherwise(first).cast("double")


def seconds_of(serial: Column) -> Column:
    return F.pmod(F.floor((serial - F.floor(serial)) * 86400 + 0.5), F.lit(86400))


def date_serial(y: Column, m: Column, d: Column) -> Column:
    """DATE: months and days may run over."""
    first = F.make_date(y.cast("int"), F.lit(1), F.lit(1))
    day = F.date_add(F.add_months(first, m.cast("int") - 1), d.cast("int") - 1)
    n = F.datediff(day, F.lit(_EPOCH).cast("date"))
    return F.when(n < 61, n - 1).otherwise(n).cast("double")
