"""COUNTIF and its kin as plans: filtered aggregates for criteria known beforehand, joins for criteria read from the row.

Criteria read from the row take the cheapest of these ways that holds them all:

* equality: the range is grouped by what its cells are equal to, and joined;
* one comparison of numbers with a constant operator, beside equalities: the range is ordered together with what the rows
  ask, and running totals are carried along; the same goes for ranges from a fixed row to the row's own, in the order of rows;
* counts between two such comparisons of one column, beside equalities: the difference of two running counts;
* anything else (wildcards, operators inside cells, texts in order, several other comparisons): the distinct criteria meet the
  distinct cells of the range, grouped beforehand; their product is what that costs. A text whose own content turns out to
  be an operator or a wildcard goes this way alone, all other rows go the ways above. A blank after a comparison finds blanks.

Ranges that move along with the row are arrays that the row carries, tested element by element.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.functions import values as V
from gridloom.functions.columns import Cell
from gridloom.functions.values import DIV0, VALUE, Fault
from gridloom.operators import ordered
from gridloom.plans import syntax as S
from gridloom.plans.compiler import Compiler, Range, Unsupported, numeric

COMPARISONS = (">=", "<=", ">", "<")


@dataclass
class Test:
    """A criterion and the column it is put to. known: the criterion, if it doesn't differ by row; cell: what the row says,
    after the constant operator ``op``."""

    cell_of: Cell
    column: int
    known: V.Criterion | None = None
    op: str = ""
    cell: Cell | None = None

    @property
    def plain_number(self) -> bool:
        """Whether the row gives a number that is never blank after its operator (a blank alone is 0)."""
        return self.cell.kind == "num" and (not self.cell.blank or self.op == "")

    @property
    def kind(self) -> str:
        if self.op in COMPARISONS:
            if self.cell.kind != "num" or self.cell_of.kind != "num":
                return "any"
            return "order" if self.plain_number else "mostly order"
        if self.op == "<>":
            return "any"
        return "equal" if self.plain_number or self.cell.kind == "bool" else "mostly equal"


def told(own: Compiler, node: S.Node | None) -> tuple[str, Cell] | V.Criterion:
    """The criterion, or its constant operator and what the row says after it."""
    x = own.cell(node)
    if x.is_constant:
        return V.criterion(x.constant)
    if not own.reads_row(node):
        v = own.book.scalar(node, own.home)
        return V.criterion(float(v) if isinstance(v, int) and not isinstance(v, bool) else v)
    while isinstance(node, S.Paren):
        node = node.of
    if isinstance(node, S.Binary) and node.op == "&":
        first, rest = leading(node)
        if isinstance(first, S.Text) and first.value in (*COMPARISONS, "<>", "="):
            rest = [own.cell(r) for r in rest]
            return first.value, own.staged(rest[0] if len(rest) == 1 else reduce(C.joined, rest))
    return "", own.staged(x)


def leading(node: S.Node) -> tuple[S.Node, list[S.Node]]:
    """The first of the operands that & joins, and the others."""
    if isinstance(node, S.Binary) and node.op == "&":
        first, rest = leading(node.left)
        return first, [*rest, node.right]
    return node, []


# --- criteria whose content is known row by row only


def asked(t: Test) -> Column:
    """What the row says: a struct of op, kind, n, t and p, as ``values.criterion`` reads it; null if it is a fault."""

    def spec(kind, op=None, n=None, t=None, p=None) -> Column:
        given = {"kind": (kind, "string"), "op": (op, "string"), "n": (n, "double"), "t": (t, "string"), "p": (p, "string")}
        return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast(c).alias(k) for k, (v, c) in given.items()))

    def of_text(v: Column, op: str) -> Column:
        o = F.lit(op) if op else F.regexp_extract(v, r"^(>=|<=|<>|>|<|=)", 1)
        rest = v if op else F.substring(v, F.length(o) + 1, F.length(v))
        o = F.when(o == "", "=").otherwise(o)
        n, upper = C.parsed(rest), F.upper(rest)
        return (
            F.when(rest == "", F.when(o == "<>", spec("nonblank")).otherwise(spec("blank", "=")))
            .when(n.isNotNull(), spec("number", o, n=n))
            .when(upper.isin("TRUE", "FALSE"), spec("bool", o, t=F.lower(upper)))
            .when(upper.isin(*(f.code for f in FAULTS)), spec("fault", o, t=upper))
            .when(o.isin("=", "<>") & rest.rlike(r"[*?~]"), spec("wild", o, p=C.glob(F.lower(rest))))
            .otherwise(spec("text", o, t=F.lower(rest)))
        )

    x, number = t.cell, lambda v: spec("number", t.op or "=", n=v)
    if t.plain_number:
        out = number(F.coalesce(x.v, F.lit(0.0)) if x.blank else x.v)
    elif x.kind == "bool" and not t.op:
        out = F.when(x.v.isNull(), number(F.lit(0.0))).otherwise(spec("bool", "=", t=x.v.cast("string")))
    elif x.kind == "mixed" and not t.op:
        k = x.v["k"]
        out = F.when(x.v.isNull(), number(F.lit(0.0))).when(k == "n", number(x.v["n"])).when(k == "b", spec("bool", "=", t=x.v["b"].cast("string"))).otherwise(of_text(x.v["t"], ""))
    elif x.kind == "text" and not t.op:
        out = F.when(x.v.isNull(), number(F.lit(0.0))).otherwise(of_text(x.v, "")) if x.blank else of_text(x.v, "")
    elif x.kind == "num":  # what & makes of a number is a number again, rounded to its digits
        text = C.as_text(Cell("num", x.v, None)).v
        out = F.when(x.v.isNull(), spec("nonblank") if t.op == "<>" else spec("blank", "=")).when(F.abs(x.v) < float("inf"), number(text.try_cast("double"))).otherwise(spec("text", t.op, t=F.lower(text)))
    else:
        out = of_text(C.as_text(x).v, t.op)
    return out if x.e is None else F.when(x.e.isNull(), out)


FAULTS = (V.DIV0, V.NA, V.VALUE, V.REF, V.NAME, V.NUM, V.NULL)


def fits(q: Column, x: Cell) -> Column:
    """Whether a cell meets a criterion of ``asked``; never null."""
    if x.kind == "mixed":
        k = x.v["k"]
        none = fits(q, Cell("blank", F.lit(None).cast("double"), None, True))
        return F.when(k == "n", fits(q, Cell("num", x.v["n"]))).when(k == "t", fits(q, Cell("text", x.v["t"]))).when(k == "b", fits(q, Cell("bool", x.v["b"]))).otherwise(none)
    op, other = q["op"], q["op"] == "<>"
    here = x.v.isNotNull() if x.blank else F.lit(True)
    compared = lambda a, b: F.when(op == "=", a == b).when(other, a != b).when(op == "<", a < b).when(op == "<=", a <= b).when(op == ">", a > b).otherwise(a >= b)
    blank = ~here
    number = boolean = text = wild = None
    if x.kind == "num":
        number = F.when(here, compared(x.v, q["n"])).otherwise(False)
    elif x.kind == "text":
        blank, low, n = ~here | (x.v == ""), F.lower(x.v), C.parsed(x.v)
        number = F.when(~here | ~op.isin("=", "<>"), False).when(n.isNull(), other).otherwise((n == q["n"]) != other)
        text = F.when(here, compared(low, q["t"])).otherwise(other)
        wild = F.when(here, F.rlike(low, F.concat(F.lit("(?s)^("), q["p"], F.lit(")$"))) != other).otherwise(other)
    elif x.kind == "bool":
        boolean = F.when(here, (x.v.cast("string") == q["t"]) != other).otherwise(other)
    rest = {"number": number if number is not None else F.lit(False), "bool": boolean if boolean is not None else other, "text": text if text is not None else other, "wild": wild if wild is not None else other}
    out = F.when(q["kind"] == "blank", blank).when(q["kind"] == "nonblank", here)
    for kind, test in rest.items():
        out = out.when(q["kind"] == kind, test)
    return F.coalesce(out.when(q["kind"] == "fault", other), F.lit(False))


# --- what cells and criteria are equal to


def key_of(x: Cell, number: bool) -> Column:
    """What a cell is equal to: a number, or a text that begins with its kind; null if no criterion of equality finds it."""
    if x.kind == "mixed":
        k = x.v["k"]
        parts = [key_of(Cell(kind, x.v[f]), number) for f, kind in (("n", "num"), ("t", "text"), ("b", "bool"))]
        out = F.when(k == "n", parts[0]).when(k == "t", parts[1]).when(k == "b", parts[2])
        return out if number else out.otherwise("z")
    if number:
        return x.v + 0.0 if x.kind == "num" else C.parsed(x.v) if x.kind == "text" else F.lit(None).cast("double")
    if x.kind == "num":
        key = F.concat(F.lit("n"), (x.v + 0.0).cast("string"))
    elif x.kind == "bool":
        key = F.concat(F.lit("b"), x.v.cast("string"))
    else:
        n = C.parsed(x.v)
        key = F.when(x.v == "", "z").when(n.isNotNull(), F.concat(F.lit("n"), (n + 0.0).cast("string"))).otherwise(F.concat(F.lit("t"), F.lower(x.v)))
    return F.when(x.v.isNull(), "z").otherwise(key) if x.blank else key


def key_asked(q: Column, number: bool) -> Column:
    """What a criterion of equality asks for; null for all others."""
    if number:
        return F.when((q["kind"] == "number") & (q["op"] == "="), q["n"] + 0.0)
    key = F.when(q["kind"] == "blank", "z").when(q["kind"] == "number", F.concat(F.lit("n"), (q["n"] + 0.0).cast("string"))).when(q["kind"] == "bool", F.concat(F.lit("b"), q["t"])).when(q["kind"] == "text", F.concat(F.lit("t"), q["t"]))
    return F.when(q["op"] == "=", key)


# --- plans


def ifs(own: Compiler, where: Range | None, pairs: list, kind: str, spread: bool) -> Cell:
    """where: the range that is added up; spread: it takes the criteria's shape from its first cell, as SUMIF's does."""
    if not pairs or len(pairs) % 2:
        return C.fault(VALUE)
    ranges, criteria = [own.one_range(p) for p in pairs[::2]], pairs[1::2]
    if found := next((r for r in ranges if isinstance(r, Fault)), None):
        return C.fault(found)
    first, where = ranges[0], where or ranges[0]
    wide, size = first.last - first.first, lambda r: (r.last - r.first, r.height, r.shape)
    if any(size(r) != size(first) for r in (ranges if spread else [*ranges, where])):
        return C.fault(VALUE)
    if spread and where.top is not None and first.top is not None:
        where = Range(where.sheet, where.first, where.first + wide, where.top, where.top + first.height - 1 if first.height else where.bottom, where.shape)
    if any((r.sheet, r.rows) != (first.sheet, first.rows) for r in (*ranges, where)):
        if first.shape != "window" or where.shape != "window":
            raise Unsupported("criteria over ranges in different rows or sheets")
    told_ = [told(own, c) for c in criteria]
    parts = []
    for j in range(wide + 1):
        tests = [Test(own.column(r, r.first + j), r.first + j, q) if isinstance(q, V.Criterion) else Test(own.column(r, r.first + j), r.first + j, None, *q) for r, q in zip(ranges, told_, strict=True)]
        if where.first + j >= own.book.sheets[where.sheet].width():
            raise Unsupported("a range to add up beyond the sheet's last column")
        parts.append(summed(own, ranges, tests, where, where.first + j, kind))
    count, s, n = (reduce(lambda a, b: a + b, x) for x in zip(*parts, strict=True))
    if kind == "count":
        return C.number(count)
    return C.number(s) if kind == "sum" else C.number(F.try_divide(s, n), C.when_fault(n == 0, DIV0))


def summed(own: Compiler, ranges: list[Range], tests: list[Test], where: Range, column: int, kind: str) -> tuple[Column, Column, Column]:
    """How many cells fit, and the sum and count of the numbers beside them, as far as ``kind`` needs them."""
    first = ranges[0]
    if first.shape == "window":
        return in_window(own, ranges, tests, where, column)
    value = numeric(own.column(where, column))
    value = F.lit(None).cast("double") if value is None else value
    known = reduce(lambda a, b: a & b, (C.matches(t.known, t.cell_of) for t in tests if t.known is not None), F.lit(True))
    if all(t.known is not None for t in tests):
        zero = F.lit(0.0)
        one = lambda c: F.when(c, 1.0).otherwise(0.0)
        total = lambda fold, v: own.total(first, fold, None, ("sum", v, zero))
        there = known & value.isNotNull()
        return total(F.count_if(known).cast("double"), one(known)), total(F.coalesce(F.sum(F.when(known, value)), zero), F.when(known, value)), total(F.count_if(there).cast("double"), one(there))
    return joined(own, first, [t for t in tests if t.known is None], known, value, kind)


def in_window(own: Compiler, ranges: list[Range], tests: list[Test], where: Range, column: int) -> tuple[Column, Column, Column]:
    """Over the array of the cells that the row sees."""
    if any((r.sheet, r.rows) != (where.sheet, where.rows) for r in ranges):
        raise Unsupported("criteria over windows in different rows or sheets")
    seen, name = own.seen(where, column, *(t.column for t in tests)), own.name("hits")
    asks = {f"{name}_q{i}": asked(t) for i, t in enumerate(tests) if t.known is None}

    def all_fit(cell) -> Column:
        """cell: what test i is put to."""
        return reduce(lambda a, b: a & b, (C.matches(t.known, cell(t)) if t.known is not None else fits(F.col(f"{name}_q{i}"), cell(t)) for i, t in enumerate(tests)))

    found = F.filter(seen, lambda x: all_fit(lambda t: own.element(where, t.column, x)))
    own.joins.append(lambda df: df.withColumns(asks).withColumn(name, found) if asks else df.withColumn(name, found))
    blanks = where.height - F.size(seen)  # rows beyond the sheet are blank
    empty = all_fit(lambda t: Cell("blank", F.lit(None).cast("double"), None, True))
    count = F.size(name).cast("double") + F.when(empty, blanks).otherwise(0)
    n = numeric(own.element(where, column, F.lit(None))) if own.column(where, column).kind in ("num", "mixed") else None
    if n is None:
        return count, F.lit(0.0), F.lit(0.0)
    numbers = F.filter(F.transform(name, lambda x: numeric(own.element(where, column, x))), lambda v: v.isNotNull())
    return count, F.aggregate(numbers, F.lit(0.0), lambda t, v: t + v), F.size(numbers).cast("double")


def joined(own: Compiler, r: Range, tests: list[Test], known: Column, value: Column, kind: str) -> tuple[Column, Column, Column]:
    """Criteria of the row: the three totals as columns that a join brings."""
    name = own.name("if")
    asks = [f"{name}_q{i}" for i in range(len(tests))]
    totals = {f"{name}_c": F.lit(1.0), f"{name}_s": value, f"{name}_n": F.when(value.isNotNull(), 1.0)}
    anchored = r.shape == "anchored"
    if anchored:
        own.needs_rows = True
    place = [f"{name}_dir", f"{name}_far"] if anchored else []
    orders = [i for i, t in enumerate(tests) if t.kind in ("order", "mostly order")]
    equal = [i for i, t in enumerate(tests) if t.kind in ("equal", "mostly equal")]
    # only counts: they are whole numbers, while a difference of two running sums loses digits
    between = kind == "count" and not anchored and len(orders) == 2 and len({tests[i].column for i in orders}) == 1 and {tests[i].op[0] for i in orders} == set("<>")
    if between:
        totals = {f"{name}_c": F.lit(1.0)}
    simple = len(equal) + len(orders) == len(tests) and (between or len(orders) + anchored <= 1)
    special = not simple or any(tests[i].kind == "mostly equal" for i in equal)
    blanks = [f"{name}_b"] * (simple and any(t.kind == "mostly order" for t in tests))  # key: blank cells, asked for by a blank
    numbers = [t.plain_number for t in tests]

    def lanes() -> DataFrame:
        columns = [t.cell_of.v.alias(f"_x{i}") for i, t in enumerate(tests)]
        values = [v.alias(k) for k, v in totals.items()]
        if anchored:
            return own.reached(r.sheet, r.top, *columns, *values, known.alias("_known")).where("_known").drop("_known")
        return own.rows_of(r.sheet, r.rows).where(known).select(*columns, *values)

    def cell(i: int) -> Cell:
        return Cell(tests[i].cell_of.kind, F.col(f"_x{i}"), None, tests[i].cell_of.blank)

    def met(df: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
        found = found.withColumnsRenamed({k: f"{k}_r" for k in on})
        match = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"{k}_r") for k in on))
        return df.join(found, match, "left").drop(*(f"{k}_r" for k in on))

    def carried(df: DataFrame, rows: DataFrame, keys: list[str], i: int, down: bool, strict: bool) -> DataFrame:
        """The totals of equal keys on one side of what test i asks."""
        at, x = F.col(asks[i])["n"], cell(i).v
        at, x = (-at, -x) if down else (at, x)
        if blanks:  # they stand at 0, and what asks for them finds all of them, or none of them too low
            too_low = between and tests[i].op[0] == ">"
            at, x = F.when(F.col(blanks[0]), -1.0 if too_low else 1.0).otherwise(at), F.coalesce(x, F.lit(0.0))
        rows, df = rows.withColumn(f"{name}_at", x), df.withColumn(f"{name}_at", at)
        return met(df, ordered.asof(rows, df, keys, f"{name}_at", dict.fromkeys(totals, "sum"), strict), [*keys, f"{name}_at"]).drop(f"{name}_at")

    def by_key(df: DataFrame) -> DataFrame:
        """Equalities, and at most one order, of numbers or of rows, or a count between two."""
        keys = [f"{name}_k{i}" for i in equal]
        df = df.withColumns({k: key_asked(F.col(asks[i]), numbers[i]) for k, i in zip(keys, equal, strict=True)})
        rows = lanes().withColumns({k: key_of(cell(i), numbers[i]) for k, i in zip(keys, equal, strict=True)})
        for b in blanks:
            df = df.withColumn(b, reduce(lambda x, y: x & y, (tests[i].cell.v.isNull() for i in orders)))
            rows = rows.withColumn(b, cell(orders[0]).v.isNull())
        keys += blanks
        if between:
            low, high = sorted(orders, key=lambda i: tests[i].op[0] == "<")
            c, under = f"{name}_c", f"{name}_u"
            df = carried(df, rows, keys, low, False, len(tests[low].op) == 2).withColumnRenamed(c, under)  # what is too low
            df = carried(df, rows, keys, high, False, len(tests[high].op) == 1)
            n = F.greatest(F.coalesce(F.col(c), F.lit(0.0)) - F.coalesce(F.col(under), F.lit(0.0)), F.lit(0.0))
            both = reduce(lambda a, b: a & b, (F.col(asks[i])["n"].isNotNull() for i in orders))
            both = reduce(lambda a, b: a | F.col(b), blanks, both)
            df = df.withColumn(c, F.when(reduce(lambda a, k: a & F.col(k).isNotNull(), keys, both), n)).drop(under)
        elif orders:
            op = tests[orders[0]].op
            df = carried(df, rows, keys, orders[0], op[0] == ">", len(op) == 1)
        elif anchored:
            rows = rows.withColumnsRenamed({"_dir": place[0], "_far": place[1]})
            df = met(df, ordered.asof(rows, df, [*keys, place[0]], place[1], dict.fromkeys(totals, "sum")), [*keys, *place])
        else:
            df = met(df, rows.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in totals)), keys)
        return df.drop(*keys)

    def by_test(df: DataFrame, only: Column | None) -> DataFrame:
        """Distinct criteria against distinct cells."""
        rows = lanes()
        rows = rows if anchored else rows.groupBy(*(f"_x{i}" for i in range(len(tests)))).agg(*(F.sum(v).alias(v) for v in totals))
        rows = rows.withColumnsRenamed({v: f"{v}_v" for v in totals})
        given = (df if only is None else df.where(only)).select(*asks, *place).distinct()
        match = [fits(F.col(asks[i]), cell(i)) for i in range(len(tests))]
        match += [F.col(asks[i])["n"] == cell(i).v + 0.0 for i in equal if tests[i].kind == "equal" and numbers[i] and tests[i].cell_of.kind == "num"]
        if anchored:
            match += [F.col(place[0]) == F.col("_dir"), F.col("_far") <= F.col(place[1])]
        met = given.join(rows, reduce(lambda a, b: a & b, match)).groupBy(*asks, *place).agg(*(F.sum(f"{v}_v").alias(f"{v}_w") for v in totals))
        met = met.withColumnsRenamed({k: f"{k}_r" for k in (*asks, *place)})
        on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"{k}_r") for k in (*asks, *place)))
        df = df.join(met, on, "left").drop(*(f"{k}_r" for k in (*asks, *place)))
        have = {v: F.coalesce(F.col(v), F.col(f"{v}_w")) if v in df.columns else F.col(f"{v}_w") for v in totals}
        return df.withColumns(have).drop(*(f"{v}_w" for v in totals))

    def join(df: DataFrame) -> DataFrame:
        df = df.withColumns({k: asked(t) for k, t in zip(asks, tests, strict=True)})
        if anchored:
            df = own.reaching(df, r.top, r.bottom, name)
        if simple:
            df = by_key(df)
        if special:
            odd = None
            if simple:  # rows whose cells hold an operator or a wildcard
                odd = reduce(lambda a, b: a | b, (F.col(asks[i]).isNotNull() & key_asked(F.col(asks[i]), numbers[i]).isNull() for i in equal))
            df = by_test(df, odd)
        return df.drop(*asks, *place)

    own.joins.append(join)
    found = [F.coalesce(F.col(v), F.lit(0.0)) for v in totals]
    return tuple(found * 3 if between else found)


def if_one(kind: str):
    def run(own: Compiler, args: list) -> Cell:
        where = own.one_range(args[2]) if len(args) > 2 and args[2] is not None else None
        return C.fault(where) if isinstance(where, Fault) else ifs(own, where, args[:2], kind, True)

    return run


def if_many(kind: str):
    def run(own: Compiler, args: list) -> Cell:
        where = own.one_range(args[0])
        return C.fault(where) if isinstance(where, Fault) else ifs(own, where, args[1:], kind, False)

    return run


CRITERIA = {
    "COUNTIF": lambda own, a: ifs(own, None, a[:2], "count", False), "COUNTIFS": lambda own, a: ifs(own, None, a, "count", False),
    "SUMIF": if_one("sum"), "AVERAGEIF": if_one("mean"), "SUMIFS": if_many("sum"), "AVERAGEIFS": if_many("mean"),
}
