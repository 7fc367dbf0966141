"""The scalar functions over cells: name -> fewest and most arguments, and the compiled form."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.functions import values as V
from gridloom.functions.columns import Cell
from gridloom.functions.values import DIV0, NA, NAME, NUM, REF, VALUE, Fault
from gridloom.plans import syntax as S

SCALARS: dict[str, tuple[int, int, Callable]] = {}


def scalar(*names: str, least: int = 0, most: int = 255):
    def register(f):
        for n in names:
            SCALARS[n] = least, most, f
        return f

    return register


def numbers(own, args, stage: bool = False) -> list[Cell]:
    """The arguments as numbers; stage: what isn't a cell or constant gets a column of its own."""
    cells = [C.as_number(own.cell(a)) for a in args]
    return [own.staged(x) if stage and isinstance(a, S.Call | S.Binary | S.Paren) else x for a, x in zip(args, cells, strict=True)]


def texts(own, args) -> list[Cell]:
    return [C.as_text(own.cell(a)) for a in args]


def whole(x: Cell) -> Column:
    """A number's whole part as an integer column."""
    return C.truncated(x.v).cast("int")


def fixed(own, node, otherwise: float) -> float | Fault:
    """An argument that must be known beforehand."""
    if node is None:
        return otherwise
    x = own.cell(node)
    return V.number(x.constant if x.is_constant else own.known(node))


def text(v: Column, *faults: Column | None) -> Cell:
    return Cell("text", v, C.first_fault(*faults))


def truth(v: Column, *faults: Column | None) -> Cell:
    return Cell("bool", v, C.first_fault(*faults))


# --- logic


@scalar("IF", least=1, most=3)
def _if(own, args):
    c = C.as_bool(own.cell(args[0]))
    yes = C.constant(0.0) if len(args) < 2 or args[1] is None else own.cell(args[1])
    no = C.constant(False) if len(args) < 3 else C.constant(0.0) if args[2] is None else own.cell(args[2])
    return either(c, yes, no)


def either(c: Cell, yes: Cell, no: Cell) -> Cell:
    kind, (yes, no) = C.together([yes, no])
    none = F.lit(None).cast("string")
    branch = None if yes.e is None and no.e is None else F.when(c.v, yes.e if yes.e is not None else none).otherwise(no.e if no.e is not None else none)
    return Cell(kind, F.when(c.v, yes.v).otherwise(no.v), C.first_fault(c.e, branch), yes.blank or no.blank)


def _if_fault(test: Callable[[Column], Column]):
    def run(own, args):
        x = own.cell(args[0])
        if x.e is None:
            return x
        other = C.constant("") if len(args) < 2 or args[1] is None else own.cell(args[1])
        return either(truth(F.coalesce(test(x.e), F.lit(False))), other, Cell(x.kind, x.v, F.when(~F.coalesce(test(x.e), F.lit(False)), x.e), x.blank))

    return run


SCALARS["IFERROR"] = 1, 2, _if_fault(lambda e: e.isNotNull())
SCALARS["IFNA"] = 1, 2, _if_fault(lambda e: e == NA.code)


def _fold(pick: Callable[[list[Column]], Column], over: Callable[[Column], Column]):
    def run(own, args):
        parts = own.parts(args)
        if isinstance(parts, Fault):
            return C.fault(parts)
        own_truths, faults, seen = [], [], []
        for r, x in parts[0]:
            if x.kind not in ("num", "bool"):
                continue  # text in ranges doesn't take part
            b = C.as_bool(Cell(x.kind, x.v, x.e))
            v = F.when(x.v.isNotNull(), b.v)
            own_truths.append(own.total(r, over(v), v))
            seen.append(own.total(r, F.count(x.v), x.v.isNotNull().cast("int")) > 0)
        for x in parts[1]:
            b = C.as_bool(x)
            own_truths.append(b.v)
            faults.append(b.e)
        if not own_truths:
            return C.fault(VALUE)
        missing = None
        if not parts[1]:
            some = seen[0]
            for s in seen[1:]:
                some = some | s
            missing = C.when_fault(~some, VALUE)
        return truth(pick(own_truths), *faults, missing)

    return run


def _all(parts: list[Column]) -> Column:
    out = F.coalesce(parts[0], F.lit(True))
    for p in parts[1:]:
        out = out & F.coalesce(p, F.lit(True))
    return out


def _any(parts: list[Column]) -> Column:
    out = F.coalesce(parts[0], F.lit(False))
    for p in parts[1:]:
        out = out | F.coalesce(p, F.lit(False))
    return out


def _odd(parts: list[Column]) -> Column:
    out = F.coalesce(parts[0], F.lit(False))
    for p in parts[1:]:
        out = out != F.coalesce(p, F.lit(False))
    return out


SCALARS["AND"] = 1, 255, _fold(_all, F.bool_and)
SCALARS["OR"] = 1, 255, _fold(_any, F.bool_or)
SCALARS["XOR"] = 1, 255, _fold(_odd, lambda b: F.bit_xor(b.cast("int")) == 1)


@scalar("NOT", least=1, most=1)
def _not(own, args):
    b = C.as_bool(own.cell(args[0]))
    return truth(~b.v, b.e)


def _is(kinds: tuple, blank: bool | None = None, negative: bool = False):
    def run(own, args):
        x = own.cell(args[0])
        here = x.v.isNotNull() if x.blank else F.lit(True)
        if x.e is not None:
            here = here & x.e.isNull()
        if blank:
            out = ~x.v.isNotNull() if x.blank else F.lit(False)
            out = out & x.e.isNull() if x.e is not None else out
        elif x.kind == "mixed":
            out = here & x.v["k"].isin([{"num": "n", "text": "t", "bool": "b"}[k] for k in kinds])
        else:
            out = here & F.lit(x.kind in kinds)
        out = F.coalesce(out, F.lit(False))
        return truth(~out if negative else out)

    return run


SCALARS |= {"ISBLANK": (1, 1, _is((), True)), "ISTEXT": (1, 1, _is(("text",))), "ISNONTEXT": (1, 1, _is(("text",), None, True)), "ISNUMBER": (1, 1, _is(("num",))), "ISLOGICAL": (1, 1, _is(("bool",)))}


def _is_fault(test: Callable[[Column], Column]):
    def run(own, args):
        x = own.cell(args[0])
        return truth(F.lit(False) if x.e is None else F.coalesce(test(x.e), F.lit(False)))

    return run


SCALARS |= {"ISNA": (1, 1, _is_fault(lambda e: e == NA.code)), "ISERR": (1, 1, _is_fault(lambda e: e != NA.code)), "ISERROR": (1, 1, _is_fault(lambda e: e.isNotNull()))}


def _parity(odd: bool):
    def run(own, args):
        (x,) = numbers(own, args)
        return truth((F.pmod(C.truncated(F.abs(x.v)), F.lit(2.0)) != 0) == F.lit(odd), x.e)

    return run


SCALARS |= {"ISEVEN": (1, 1, _parity(False)), "ISODD": (1, 1, _parity(True))}


@scalar("N", least=1, most=1)
def _n(own, args):
    x = own.cell(args[0])
    if x.kind in ("num", "bool"):
        return C.as_number(x)
    if x.kind == "mixed":
        return Cell("num", F.when(x.v["k"] == "n", x.v["n"]).when(x.v["k"] == "b", x.v["b"].cast("double")).otherwise(0.0), x.e)
    return Cell("num", F.lit(0.0), x.e)


@scalar("T", least=1, most=1)
def _t(own, args):
    x = own.cell(args[0])
    v = x.v if x.kind == "text" else F.when(x.v["k"] == "t", x.v["t"]) if x.kind == "mixed" else F.lit("")
    return Cell("text", F.coalesce(v, F.lit("")), x.e)


SCALARS |= {"TRUE": (0, 0, lambda own, a: C.constant(True)), "FALSE": (0, 0, lambda own, a: C.constant(False)), "PI": (0, 0, lambda own, a: C.constant(math.pi))}


@scalar("CHOOSE", least=2)
def _choose(own, args):
    i = C.as_number(own.cell(args[0]))
    kind, cells = C.together([C.constant(0.0) if a is None else own.cell(a) for a in args[1:]])
    at, v, e = C.truncated(i.v), F.lit(None), F.lit(None).cast("string")
    out, faults = F.when(F.lit(False), cells[0].v), F.when(F.lit(False), e)
    for k, c in enumerate(cells, 1):
        out = out.when(at == k, c.v)
        faults = faults.when(at == k, c.e if c.e is not None else F.lit(None).cast("string"))
    _ = v
    return Cell(kind, out, C.first_fault(i.e, faults.otherwise(VALUE.code)), any(c.blank for c in cells))


@scalar("HYPERLINK", least=1, most=2)
def _hyperlink(own, args):
    return own.cell(args[-1])


@scalar("ROW", most=1)
def _row(own, args):
    if args:
        r = own.ranges(args[0])
        if not isinstance(r, list):
            return C.fault(r or VALUE)
        if r[0].top is None or r[0].shape == "fixed":
            return C.constant(float(r[0].top or 1))
        own.needs_rows = True
        if r[0].shape == "anchored":
            return Cell("num", F.least(F.col("_row") + r[0].bottom, F.lit(r[0].top)).cast("double"))
        return Cell("num", F.col("_row").cast("double") + float(r[0].top))
    if own.host is None:
        return C.constant(1.0)
    own.needs_rows = True
    return Cell("num", F.col("_row").cast("double"))


@scalar("COLUMN", least=1, most=1)
def _column(own, args):
    r = own.ranges(args[0])
    return C.constant(float(r[0].first + 1)) if isinstance(r, list) else C.fault(r or VALUE)


@scalar("COLUMNS", least=1, most=1)
def _columns(own, args):
    r = own.one_range(args[0])
    return C.fault(r) if isinstance(r, Fault) else C.constant(float(r.last - r.first + 1))


@scalar("ROWS", least=1, most=1)
def _rows(own, args):
    r = own.one_range(args[0])
    if isinstance(r, Fault):
        return C.fault(r)
    if r.shape == "anchored":
        own.needs_rows = True
        return Cell("num", F.abs(F.col("_row") + r.bottom - r.top).cast("double") + 1.0)
    if r.top is not None:
        return C.constant(float(r.height))
    return Cell("num", own.total(r, F.count("*").cast("double")))


# --- text


def _edge(right: bool):
    def run(own, args):
        t = C.as_text(own.cell(args[0]))
        n = C.as_number(own.cell(args[1])) if len(args) > 1 else C.constant(1.0)
        k = F.greatest(whole(n), F.lit(0))
        v = F.when(k == 0, "").otherwise(F.right(t.v, k) if right else F.left(t.v, k))
        return text(v, t.e, n.e, None if n.is_constant and n.constant >= 0 else C.when_fault(whole(n) < 0, VALUE))

    return run


SCALARS |= {"LEFT": (1, 2, _edge(False)), "RIGHT": (1, 2, _edge(True))}


@scalar("MID", least=3, most=3)
def _mid(own, args):
    t = C.as_text(own.cell(args[0]))
    start, n = numbers(own, args[1:])
    bad = (whole(start) < 1) | (whole(n) < 0)
    return text(F.substring(t.v, F.greatest(whole(start), F.lit(1)), F.greatest(whole(n), F.lit(0))), t.e, start.e, n.e, C.when_fault(bad, VALUE))


def _text1(f: Callable[[Column], Column], kind: str = "text"):
    def run(own, args):
        t = C.as_text(own.cell(args[0]))
        return Cell(kind, f(t.v), t.e)

    return run


SCALARS |= {
    "LEN": (1, 1, _text1(lambda t: F.char_length(t).cast("double"), "num")), "LOWER": (1, 1, _text1(F.lower)), "UPPER": (1, 1, _text1(F.upper)), "PROPER": (1, 1, _text1(C.proper)),
    "TRIM": (1, 1, _text1(lambda t: F.regexp_replace(F.regexp_replace(t, "^ +| +$", ""), " +", " "))),
}


def quoted(t: Column) -> Column:
    """A text as a regular expression for itself."""
    return F.regexp_replace(t, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


@scalar("SUBSTITUTE", least=3, most=4)
def _substitute(own, args):
    t, old, new = texts(own, args[:3])
    if len(args) < 4:
        return text(F.when(old.v == "", t.v).otherwise(F.replace(t.v, old.v, new.v)), t.e, old.e, new.e)
    k = C.as_number(own.cell(args[3]))
    parts = F.split(t.v, quoted(old.v), -1)
    n = F.greatest(whole(k), F.lit(1))
    cut = F.concat(F.array_join(F.slice(parts, F.lit(1), n), "\u0001"), F.lit("\u0002"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "\u0001"))
    out = F.replace(F.replace(cut, F.lit("\u0001"), old.v), F.lit("\u0002"), new.v)
    return text(F.when((old.v == "") | (F.size(parts) <= n), t.v).otherwise(out), t.e, old.e, new.e, k.e, C.when_fault(whole(k) < 1, VALUE))


@scalar("REPLACE", least=4, most=4)
def _replace(own, args):
    t, new = texts(own, (args[0], args[3]))
    start, n = numbers(own, args[1:3])
    a, b = F.greatest(whole(start), F.lit(1)), F.greatest(whole(n), F.lit(0))
    v = F.concat(F.substring(t.v, F.lit(1), a - 1), new.v, F.substring(t.v, a + b, F.char_length(t.v)))
    return text(v, t.e, start.e, n.e, new.e, C.when_fault((whole(start) < 1) | (whole(n) < 0), VALUE))


@scalar("CONCAT", "CONCATENATE", least=1)
def _concat(own, args):
    own_texts = texts(own, args)
    return text(F.concat(*(t.v for t in own_texts)), *(t.e for t in own_texts))


@scalar("TEXTJOIN", least=3)
def _textjoin(own, args):
    between = C.as_text(own.cell(args[0]))
    skip = True if args[1] is None else bool(V.truth(own.known(args[1])))
    parts = own.parts(args[2:])
    if isinstance(parts, Fault):
        return C.fault(parts)
    pieces = []
    for r, x in parts[0]:  # a whole column: its cells in the order of rows
        if r is None:
            pieces.append(F.array(C.as_text(x).v))
            continue
        sheet = own.book.sheets[r.sheet]
        t = C.as_text(x).v
        listed = F.array_sort(F.collect_list(F.struct(*(F.col(k) for k in sheet.key), t.alias("_t"))))
        pieces.append(own.total(r, F.transform(listed, lambda p: p["_t"])))
    direct = [C.as_text(x) for x in parts[1]]
    if direct:
        pieces.append(F.array(*(x.v for x in direct)))
    every = F.concat(*pieces) if len(pieces) > 1 else pieces[0]
    every = F.filter(every, lambda p: p != "") if skip else every
    return text(F.call_function("array_join", every, between.v), between.e, *(x.e for x in direct))


def _around(after: bool):
    def run(own, args):
        t, d = texts(own, args[:2])
        k = fixed(own, args[2], 1.0) if len(args) > 2 else 1.0
        if isinstance(k, Fault):
            return C.fault(k)
        k = int(k)
        if k == 0:
            return C.fault(VALUE)
        parts = F.split(t.v, quoted(d.v), -1)
        at = F.lit(k) if k > 0 else F.size(parts) + k  # pieces before the delimiter
        found = (at > 0) & (at < F.size(parts))
        piece = F.slice(parts, at + 1, F.size(parts)) if after else F.slice(parts, F.lit(1), at)
        v = F.when(found & (d.v != ""), F.call_function("array_join", piece, d.v))
        return text(v, t.e, d.e, C.when_fault(d.v == "", VALUE), C.when_fault(~found, NA))

    return run


SCALARS |= {"TEXTAFTER": (2, 3, _around(True)), "TEXTBEFORE": (2, 3, _around(False))}


@scalar("VALUE", least=1, most=1)
def _value(own, args):
    x = own.cell(args[0])
    return C.fault(VALUE) if x.kind == "bool" else C.as_number(x)


@scalar("EXACT", least=2, most=2)
def _exact(own, args):
    a, b = texts(own, args)
    return truth(a.v == b.v, a.e, b.e)


@scalar("FIND", least=2, most=3)
def _find(own, args):
    needle, hay = texts(own, args[:2])
    start = C.as_number(own.cell(args[2])) if len(args) > 2 else C.constant(1.0)
    s = whole(start)
    rest = F.substring(hay.v, F.greatest(s, F.lit(1)), F.char_length(hay.v))
    at = F.call_function("instr", rest, needle.v)
    at = F.when(needle.v == "", 1).otherwise(at)
    bad = (s < 1) | (s > F.char_length(hay.v) + 1) | (at == 0)
    return Cell("num", (at + s - 1).cast("double"), C.first_fault(needle.e, hay.e, start.e, C.when_fault(bad, VALUE)))


@scalar("SEARCH", least=2, most=3)
def _search(own, args):
    pattern, hay = texts(own, args[:2])
    start = C.as_number(own.cell(args[2])) if len(args) > 2 else C.constant(1.0)
    s = whole(start)
    low = F.lower(F.substring(hay.v, F.greatest(s, F.lit(1)), F.char_length(hay.v)))
    own_pattern = F.lit(V.glob(pattern.constant.lower())) if pattern.is_constant else C.glob(F.lower(pattern.v))
    before = F.call_function("regexp_extract", low, F.concat(F.lit("(?s)^(.*?)("), own_pattern, F.lit(")")), F.lit(1))
    hit = F.call_function("rlike", low, F.concat(F.lit("(?s)"), own_pattern))
    bad = (s < 1) | (s > F.char_length(hay.v) + 1) | ~hit
    return Cell("num", (F.char_length(before) + s).cast("double"), C.first_fault(pattern.e, hay.e, start.e, C.when_fault(bad, VALUE)))


@scalar("REPT", least=2, most=2)
def _rept(own, args):
    t, n = C.as_text(own.cell(args[0])), C.as_number(own.cell(args[1]))
    k = whole(n)
    bad = (k < 0) | (F.octet_length(t.v) * k.cast("long") > 131068)
    return text(F.when(bad, F.lit(None)).otherwise(F.call_function("repeat", t.v, F.greatest(k, F.lit(0)))), t.e, n.e, C.when_fault(bad, VALUE))


@scalar("CHAR", least=1, most=1)
def _char(own, args):
    (n,) = numbers(own, args)
    k = whole(n)
    return text(F.call_function("char", F.greatest(F.least(k, F.lit(255)), F.lit(1)).cast("long")), n.e, C.when_fault(~k.between(1, 255), VALUE))


@scalar("CODE", least=1, most=1)
def _code(own, args):
    t = C.as_text(own.cell(args[0]))
    return Cell("num", F.ascii(t.v).cast("double"), C.first_fault(t.e, C.when_fault(t.v == "", VALUE)))


# --- dates


@scalar("DATE", least=3, most=3)
def _date(own, args):
    y, m, d = numbers(own, args, stage=True)
    held = lambda v: own.staged(Cell("num", v)).v  # noqa: E731  what is read many times is computed once
    given = held(C.truncated(y.v))
    year = held(F.when(given.between(0, 1899), given + 1900).otherwise(given))
    bad = held(~year.between(1900, 9999) | (F.abs(m.v) > 100_000) | (F.abs(d.v) > 1_000_000))
    n = held(C.date_serial(F.when(bad, 2000.0).otherwise(year), F.when(bad, 1.0).otherwise(C.truncated(m.v)), F.when(bad, 1.0).otherwise(C.truncated(d.v))))
    return Cell("num", n, C.first_fault(y.e, m.e, d.e, C.when_fault(bad | (n < 0), NUM)))


@scalar("TIME", least=3, most=3)
def _time(own, args):
    h, m, s = numbers(own, args)
    n = C.truncated(h.v) * 3600 + C.truncated(m.v) * 60 + C.truncated(s.v)
    return Cell("num", F.pmod(n, F.lit(86400.0)) / 86400, C.first_fault(h.e, m.e, s.e, C.when_fault(n < 0, NUM)))


def _of_serial(f: Callable[[Column], Column]):
    def run(own, args):
        (x,) = numbers(own, args, stage=True)
        return Cell("num", f(F.greatest(x.v, F.lit(0.0))).cast("double"), C.first_fault(x.e, C.when_fault(x.v < 0, NUM)))

    return run


def _part(part: str):
    plain = _of_serial(lambda n: C.date_part(n, part))

    def run(own, args):
        x = own.cell(args[0])
        if x.day is None:
            return plain(own, args)
        return Cell("num", C.part_of_day(x.day, part), C.first_fault(x.e, C.when_fault(x.day < F.lit("1899-12-31").cast("date"), NUM)))

    return run


SCALARS |= {p.upper(): (1, 1, _part(p)) for p in ("year", "month", "day")}
SCALARS |= {
    "HOUR": (1, 1, _of_serial(lambda n: F.floor(C.seconds_of(n) / 3600))), "MINUTE": (1, 1, _of_serial(lambda n: F.pmod(F.floor(C.seconds_of(n) / 60), F.lit(60)))), "SECOND": (1, 1, _of_serial(lambda n: F.pmod(C.seconds_of(n), F.lit(60)))),
}


@scalar("DAYS", least=2, most=2)
def _days(own, args):
    a, b = numbers(own, args)
    return Cell("num", C.truncated(a.v) - C.truncated(b.v), C.first_fault(a.e, b.e))


@scalar("WEEKDAY", least=1, most=2)
def _weekday(own, args):
    from gridloom.plans.interp import WEEK_TYPES

    (x,) = numbers(own, args[:1], stage=True)
    kind = fixed(own, args[1], 1.0) if len(args) > 1 else 1.0
    if isinstance(kind, Fault) or int(kind) not in WEEK_TYPES:
        return C.fault(kind if isinstance(kind, Fault) else NUM)
    first, base = WEEK_TYPES[int(kind)]
    return Cell("num", (F.pmod(F.floor(x.v) - 1 - first, F.lit(7)) + base).cast("double"), C.first_fault(x.e, C.when_fault(x.v < 0, NUM)))


# --- mathematics


def _math(f: Callable[..., Column], bad: Callable[..., Column] | None = None, code: Fault = NUM, checked: bool = False):
    def run(own, args):
        xs = numbers(own, args)
        v = f(*(x.v for x in xs))
        own_fault = None if bad is None else C.when_fault(bad(*(x.v for x in xs)), code)
        return C.number(v, *(x.e for x in xs), own_fault, checked=checked)

    return run


SCALARS |= {
    "ABS": (1, 1, _math(F.abs)), "INT": (1, 1, _math(C.floored)), "SIGN": (1, 1, _math(F.signum)), "SQRT": (1, 1, _math(lambda x: F.sqrt(F.abs(x)), lambda x: x < 0)), "EXP": (1, 1, _math(F.exp, checked=True)),
    "LN": (1, 1, _math(lambda x: F.ln(x), lambda x: x <= 0)), "LOG10": (1, 1, _math(lambda x: F.log10(x), lambda x: x <= 0)), "SIN": (1, 1, _math(F.sin)), "COS": (1, 1, _math(F.cos)), "TAN": (1, 1, _math(F.tan)),
    "ASIN": (1, 1, _math(F.asin, lambda x: F.abs(x) > 1)), "ACOS": (1, 1, _math(F.acos, lambda x: F.abs(x) > 1)), "ATAN": (1, 1, _math(F.atan)), "RADIANS": (1, 1, _math(F.radians)), "DEGREES": (1, 1, _math(F.degrees)),
    "ATAN2": (2, 2, _math(lambda x, y: F.atan2(y, x), lambda x, y: (x == 0) & (y == 0), DIV0)), "MOD": (2, 2, _math(C.modulo, lambda n, d: d == 0, DIV0)),
    "LOG": (1, 2, _math(lambda x, b=None: F.log10(x) if b is None else F.ln(x) / F.ln(b), lambda x, b=None: (x <= 0) if b is None else (x <= 0) | (b <= 0) | (b == 1))),
    "EVEN": (1, 1, _math(lambda x: F.signum(x) * 2 * F.ceil(F.abs(x) / 2))), "ODD": (1, 1, _math(lambda x: F.when(x < 0, -1.0).otherwise(1.0) * F.greatest(2 * F.ceil((F.abs(x) - 1) / 2) + 1, F.lit(1)))),
    "ERF": (1, 2, _math(lambda lo, hi=None: C.erf(lo) if hi is None else C.erf(hi) - C.erf(lo))), "ERFC": (1, 1, _math(C.erfc)), "ERFC.PRECISE": (1, 1, _math(C.erfc)), "NORMSDIST": (1, 1, _math(C.normal_cdf)),
}


@scalar("POWER", least=2, most=2)
def _power(own, args):
    return C.power(*numbers(own, args))


def _rounding(f: Callable[[Column, int], Column], least: int):
    def run(own, args):
        x = C.as_number(own.cell(args[0]))
        d = fixed(own, args[1], 0.0) if len(args) > 1 else 0.0
        return C.fault(d) if isinstance(d, Fault) else Cell("num", f(x.v, int(d)), x.e)

    return least, 2, run


SCALARS |= {
    "ROUND": _rounding(C.rounded, 2), "ROUNDUP": _rounding(lambda x, d: C.scaled(x, d, True), 2), "ROUNDDOWN": _rounding(lambda x, d: C.scaled(x, d, False), 2), "TRUNC": _rounding(lambda x, d: C.scaled(x, d, False), 1),
}


def _step(up: bool):
    def run(own, args):
        x = C.as_number(own.cell(args[0]))
        s = C.as_number(own.cell(args[1])) if len(args) > 1 else C.constant(1.0)
        n = F.try_divide(x.v, s.v)
        v = F.when(s.v == 0, 0.0).otherwise((-C.floored(-n) if up else C.floored(n)) * s.v)
        own_fault = F.when((x.v > 0) & (s.v < 0), NUM.code)
        own_fault = own_fault if up else own_fault.when((s.v == 0) & (x.v != 0), DIV0.code)
        return Cell("num", v, C.first_fault(x.e, s.e, own_fault))

    return run


SCALARS |= {n: (1, 2, _step(False)) for n in ("FLOOR", "FLOOR.MATH")} | {n: (1, 2, _step(True)) for n in ("CEILING", "CEILING.MATH")}


@scalar("NORMDIST", "NORM.DIST", least=4, most=4)
def _normdist(own, args):
    x, m, s = numbers(own, args[:3])
    below = bool(V.truth(own.known(args[3])))
    z = F.try_divide(x.v - m.v, s.v)
    v = C.normal_cdf(z) if below else F.try_divide(C.normal_pdf(z), s.v)
    return Cell("num", v, C.first_fault(x.e, m.e, s.e, C.when_fault(s.v <= 0, NUM)))


@scalar("NORM.S.DIST", least=1, most=2)
def _norm_s_dist(own, args):
    (z,) = numbers(own, args[:1])
    below = len(args) < 2 or bool(V.truth(own.known(args[1])))
    return Cell("num", C.normal_cdf(z.v) if below else C.normal_pdf(z.v), z.e)


_ = NAME, REF
