"""Compiles formulas over bound tables to DataFrame plans.

A formula that stands in a row of a table becomes one column expression for all rows: references to the row's cells are
columns, whole-column ranges become aggregates of one row, criteria that depend on the row become grouped aggregates with
a join, and lookups become joins. What formulas share is planned once. Formulas outside any table give one row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.functions import values as V
from gridloom.functions.columns import Cell
from gridloom.functions.values import DIV0, NA, NAME, NUM, REF, VALUE, Fault
from gridloom.operators import ordered
from gridloom.plans import syntax as S
from gridloom.sources.tables import Sheet


#: Rows of a range that moves along with the row, at most, and cells that a plain aggregate of it may have.
MOVING, MOVING_CELLS = 4096, 256


class Unsupported(ValueError):
    """The formula is valid but has no plan over tables."""


@dataclass(frozen=True)
class Range:
    """Columns of a sheet, whole or from row to row (from 1). shape: fixed; window: both ends move along with the formula's
    row and are counted from it; anchored: between the fixed row ``top`` and the one ``bottom`` rows below the formula's."""

    sheet: str
    first: int
    last: int
    top: int | None = None
    bottom: int | None = None
    shape: str = "fixed"

    @property
    def rows(self) -> tuple:
        return self.top, self.bottom, self.shape

    @property
    def height(self) -> int | None:
        return None if self.top is None or self.shape == "anchored" else self.bottom - self.top + 1

    def columns(self) -> range:
        return range(self.first, self.last + 1)


class Book:
    """Sheets by name, and defined names."""

    def __init__(self, spark: SparkSession, sheets: list[Sheet], names: dict[str, str] | None = None):
        self.spark, self.sheets = spark, {s.name.upper(): s for s in sheets}
        self.order = [s.name.upper() for s in sheets]
        self.names = {k.upper(): v for k, v in (names or {}).items()}

    def evaluate(self, formulas: dict[str, str]) -> DataFrame:
        """One row: a column for each formula."""
        own = Compiler(self, None, 1)
        cells = {name: own.cell(S.parse(f.removeprefix("="))) for name, f in formulas.items()}
        return own.attach(self.spark.range(1)).select(*outputs(cells))

    def fill(self, sheet: str, formulas: dict[str, str], row: int = 1, keep: list[str] | None = None) -> DataFrame:
        """The kept columns of a sheet and a column for each formula, which is written as it stands in ``row``."""
        host = self.sheets[sheet.upper()]
        own = Compiler(self, host, row)
        cells = {name: own.cell(S.parse(f.removeprefix("="))) for name, f in formulas.items()}
        base = host.placed() if own.needs_rows else host.df
        return own.attach(base).select(*(keep if keep is not None else host.df.columns), *outputs(cells))

    def scalar(self, node: S.Node, home: Sheet | None = None) -> V.Value:
        """A formula's value, now. For what a plan must know beforehand. home: the sheet of references that name none."""
        own = Compiler(self, None, 1, home=home)
        cell = own.cell(node)
        if cell.is_constant:
            return cell.constant
        r = own.attach(self.spark.range(1)).select(cell.v.alias("v"), (cell.e if cell.e is not None else F.lit(None)).cast("string").alias("e")).first()
        return Fault(r["e"]) if r["e"] else r["v"]


def outputs(cells: dict[str, Cell]) -> list[Column]:
    """A value column for each cell, and a column of fault codes for those that can fail."""
    out = []
    for name, x in cells.items():
        v = x.v
        if x.kind == "mixed":
            v = C.as_text(x).v
        elif x.blank and x.kind in ("num", "blank"):
            v = F.coalesce(v, F.lit(0.0))  # a blank result is 0
        if x.e is not None:
            out += [F.when(x.e.isNull(), v).alias(name), x.e.cast("string").alias(f"{name}_err")]
        else:
            out.append(v.alias(name))
    return out


class Compiler:
    def __init__(self, book: Book, host: Sheet | None, row: int, array: bool = False, home: Sheet | None = None):
        self.book, self.host, self.row, self.array, self.home = book, host, row, array, host or home
        self.totals: dict[tuple, dict[str, Column]] = {}
        self.single_rows: list[DataFrame] = []
        self.joins: list = []
        self.windows: dict[tuple, tuple[str, set[int]]] = {}
        self.runs: dict[tuple, tuple[str, dict[str, tuple[str, Column]]]] = {}
        self.given: dict[int, Cell] = {}
        self.made = 0
        self.needs_rows = False
        self.open: list[str] = []

    def name(self, what: str) -> str:
        self.made += 1
        return f"_{what}{self.made}"

    # --- plans

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with everything that the compiled cells read."""
        for (sheet, rows), columns in self.totals.items():
            source = self.rows_of(sheet, rows)
            df = df.crossJoin(source.agg(*(c.alias(n) for n, c in columns.items())))  # one row
        for one in self.single_rows:
            df = df.crossJoin(one)  # one row
        for (sheet, top, bottom), (name, columns) in self.windows.items():
            own = self.book.sheets[sheet]
            cells = {f"c{i}": own.cell(i).v for i in sorted(columns)}
            rows = own.placed().select("_row", F.struct(F.col("_row").alias("row"), *(v.alias(k) for k, v in cells.items())).alias("_cells"))
            seen = ordered.windows(rows, self.host.placed().select("_row"), top, bottom, "_cells", name)
            df = df.join(seen, "_row")
        for (sheet, anchor, step), (name, values) in self.runs.items():
            df = self.run(df, sheet, anchor, step, name, values)
        for join in self.joins:
            df = join(df)
        return df

    def rows_of(self, sheet: str, rows: tuple) -> DataFrame:
        own = self.book.sheets[sheet]
        top, bottom, shape = rows
        if top is None:
            return own.df
        if shape != "fixed":
            raise Unsupported("this function over a range that moves along with the row")
        return own.placed().where(F.col("_row").between(top, bottom))

    # --- ranges that move along with the row

    def seen(self, r: Range, *columns: int) -> Column:
        """The cells of a window as an array of structs: row, and c0, c1, ... by column."""
        self.needs_rows = True
        if r.bottom - r.top >= MOVING:
            raise Unsupported(f"ranges of over {MOVING} rows that move along with the row")
        name, own = self.windows.setdefault((r.sheet, r.top, r.bottom), (self.name("w"), set()))
        own.update(columns or r.columns())
        return F.col(name)

    def element(self, r: Range, i: int, x: Column) -> Cell:
        """Column i of a window's element."""
        own = self.book.sheets[r.sheet].cell(i)
        return Cell(own.kind, x[f"c{i}"], None, True)

    def cells_of(self, r: Range) -> list[Cell]:
        """The cells of a window one by one, row by row; those above the sheet's first row or below its last are blank."""
        if r.height * (r.last - r.first + 1) > MOVING_CELLS:
            raise Unsupported(f"ranges of over {MOVING_CELLS} cells that move along with the row")
        own = self.host is not None and r.sheet == self.host.name.upper()
        if r.height == 1 and own and r.top == 0:
            return [self.host.cell(i) for i in r.columns()]
        seen = self.seen(r)
        missing = F.greatest(F.lit(1) - F.col("_row") - r.top, F.lit(0)) if r.top < 0 else F.lit(0)  # rows above the sheet
        return [self.element(r, i, F.get(seen, (F.lit(k) - missing).cast("int"))) for k in range(r.height) for i in r.columns()]

    def running(self, r: Range, kind: str, value: Column, none: Column | None) -> Column:
        """A fold over the rows between the anchor and the row that the range reaches."""
        self.needs_rows = True
        name, values = self.runs.setdefault((r.sheet, r.top, r.bottom), (self.name("run"), {}))
        own = self.name("v")
        values[own] = (kind, value)
        return F.col(own) if none is None else F.coalesce(F.col(own), none)

    def reached(self, sheet: str, anchor: int, *columns: Column) -> DataFrame:
        """The rows of a sheet with ``_dir`` and ``_far``: on which side of the anchor, and how far from it. The anchor's row
        is on both sides."""
        own = self.book.sheets[sheet].placed()
        rows = own.select("*", (F.col("_row") >= anchor).alias("_dir"), F.abs(F.col("_row") - anchor).alias("_far"))
        if anchor > 1:
            rows = rows.unionByName(own.where(F.col("_row") == anchor).select("*", F.lit(False).alias("_dir"), F.lit(0).cast("long").alias("_far")))
        return rows.select("_dir", "_far", *columns)

    def reaching(self, df: DataFrame, anchor: int, step: int, name: str) -> DataFrame:
        """``df`` with the side and distance that each row's range reaches to."""
        at = F.greatest(F.col("_row") + step, F.lit(1))
        return df.withColumns({f"{name}_dir": at >= anchor, f"{name}_far": F.abs(at - anchor).cast("long")})

    def run(self, df: DataFrame, sheet: str, anchor: int, step: int, name: str, values: dict[str, tuple[str, Column]]) -> DataFrame:
        df = self.reaching(df, anchor, step, name)
        lanes = self.reached(sheet, anchor, *(v.alias(k) for k, (_, v) in values.items()))
        asks = self.reaching(self.host.placed().select("_row"), anchor, step, name).select(F.col(f"{name}_dir").alias("_dir"), F.col(f"{name}_far").alias("_far"))
        found = ordered.asof(lanes, asks, ["_dir"], "_far", {k: kind for k, (kind, _) in values.items()})
        found = found.withColumnsRenamed({"_dir": f"{name}_d", "_far": f"{name}_f"})
        return df.join(found, (F.col(f"{name}_dir") == F.col(f"{name}_d")) & (F.col(f"{name}_far") == F.col(f"{name}_f")), "left").drop(f"{name}_d", f"{name}_f")

    def total(self, r: Range | None, column: Column, alone: Column | None = None, run: tuple | None = None) -> Column:
        """An aggregate over a range; alone: what it is for a single cell of the row; run: its fold, the value that is
        folded and what it is over nothing, for ranges from a fixed row on."""
        if r is None:
            return alone
        if r.shape == "anchored" and run is not None:
            return self.running(r, *run)
        if r.shape != "fixed":
            raise Unsupported("this function over a range that moves along with the row")
        own = self.totals.setdefault((r.sheet, r.rows), {})
        name = self.name("t")
        own[name] = column
        return F.col(name)

    def staged(self, x: Cell) -> Cell:
        """The cell as a column of its own, so that what reads it many times doesn't repeat how it is computed."""
        if x.is_constant or self.array:
            return x
        name, code = self.name("x"), None
        columns = {name: x.v}
        if x.e is not None:
            code = f"{name}_e"
            columns[code] = x.e
        self.joins.append(lambda df: df.withColumns(columns))
        return Cell(x.kind, F.col(name), F.col(code) if code else None, x.blank, day=x.day)

    # --- references

    def sheets(self, ref: S.Ref) -> list[Sheet] | Fault:
        if ref.dead or (ref.sheet and (ref.sheet.dead or ref.sheet.book is not None)):
            return REF
        if ref.sheet is None:
            return [self.home] if self.home else REF
        order = self.book.order
        first, last = ref.sheet.name.upper(), (ref.sheet.last or ref.sheet.name).upper()
        if first not in order or last not in order:
            return REF
        a, b = sorted((order.index(first), order.index(last)))
        return [self.book.sheets[n] for n in order[a : b + 1]]

    def ranges(self, node: S.Node | None) -> list[Range] | Fault | None:
        """The ranges a reference stands for; None if the node is no reference."""
        if isinstance(node, S.Paren):
            return self.ranges(node.of)
        if isinstance(node, S.Name) and node.name.upper() in self.book.names and node.name.upper() not in self.open:
            self.open.append(node.name.upper())
            try:
                return self.ranges(S.parse(self.book.names[node.name.upper()]))
            finally:
                self.open.pop()
        if isinstance(node, S.Ref):
            sheets = self.sheets(node)
            if isinstance(sheets, Fault):
                return sheets
            out = []
            for s in sheets:
                if node.col is None:  # whole rows
                    out.append(self.between(Range(s.name.upper(), 0, s.width() - 1, *self.line(node.row)), Range(s.name.upper(), 0, s.width() - 1, *self.line(node.row2))))
                    continue
                first, last = sorted((node.col.at, (node.col2 or node.col).at))
                rows = (None, None, "fixed") if node.row is None else self.line(node.row)
                out.append(Range(s.name.upper(), first, min(last, s.width() - 1), *rows))
            return out
        if isinstance(node, S.Call) and S.plain_name(node.name) == "INDEX" and len(node.args) in (2, 3) and not any(self.reads_row(a) for a in node.args[1:]):
            return self.indexed(node.args)
        if isinstance(node, S.Binary) and node.op in (":", ",", " "):
            a = self.ranges(node.left)
            right = node.right
            if node.op == ":" and isinstance(node.left, S.Ref) and isinstance(right, S.Ref) and right.sheet is None and node.left.sheet:
                right = S.Ref(right.pieces, node.left.sheet, right.row, right.col, right.row2, right.col2, right.dead)
            b = self.ranges(right)
            for x in (a, b):
                if isinstance(x, Fault):
                    return x
            if a is None or b is None:
                if any(isinstance(n, S.Call) and S.plain_name(n.name) == "INDEX" for n in (node.left, node.right)):
                    raise Unsupported("INDEX as a reference where the place differs by row")
                return VALUE
            if node.op == ",":
                return [*a, *b]
            if node.op == ":":
                if len(a) != 1 or len(b) != 1 or a[0].sheet != b[0].sheet:
                    return VALUE
                return [self.between(a[0], b[0])]
            out = []
            for p in a:
                for q in b:
                    if "window" in (p.shape, q.shape) or "anchored" in (p.shape, q.shape):
                        raise Unsupported("intersections of ranges that move along with the row")
                    first, last = max(p.first, q.first), min(p.last, q.last)
                    tops, bottoms = [x for x in (p.top, q.top) if x is not None], [x for x in (p.bottom, q.bottom) if x is not None]
                    top, bottom = max(tops, default=None), min(bottoms, default=None)
                    if p.sheet == q.sheet and first <= last and (top is None or top <= bottom):
                        out.append(Range(p.sheet, first, last, top, bottom))
            return out or V.NULL
        return None

    def line(self, axis: S.Axis) -> tuple[int, int, str]:
        """Where one row lies: fixed, or moving along with the formula's row. References in names stay where they are."""
        if self.host is None or axis.absolute or self.open:
            return axis.at + 1, axis.at + 1, "fixed"
        return axis.at + 1 - self.row, axis.at + 1 - self.row, "window"

    def between(self, p: Range, q: Range) -> Range:
        """The least range that holds both."""
        first, last = min(p.first, q.first), max(p.last, q.last)
        if p.top is None or q.top is None:
            return Range(p.sheet, first, last)
        if p.shape == q.shape != "anchored":
            return Range(p.sheet, first, last, min(p.top, q.top), max(p.bottom, q.bottom), p.shape)
        fixed, moving = (p, q) if p.shape == "fixed" else (q, p)
        if moving.shape != "window" or fixed.height != 1 or moving.height != 1:
            raise Unsupported("ranges between blocks that move and blocks that don't")
        return Range(p.sheet, first, last, fixed.top, moving.top, "anchored")

    def indexed(self, args: list) -> list[Range] | Fault:
        """INDEX as a reference: its row and column must be known beforehand; 0 is the whole column or row."""
        r = self.one_range(args[0])
        if isinstance(r, Fault):
            return r
        if r.shape == "anchored":
            raise Unsupported("INDEX of a range from a fixed row to the row's own")
        place = [0 if a is None else V.number(self.known(a)) for a in args[1:3]]
        if found := next((x for x in place if isinstance(x, Fault)), None):
            return found
        row, col = int(place[0]), int(place[1]) if len(place) > 1 else 0
        if len(place) == 1 and r.height == 1:
            row, col = 0, row
        if row < 0 or col < 0:
            return VALUE
        if col > r.last - r.first + 1 or (r.height is not None and row > r.height):
            return REF
        first, last = (r.first + col - 1,) * 2 if col else (r.first, r.last)
        start = 1 if r.top is None else r.top
        top, bottom = (start + row - 1,) * 2 if row else (r.top, r.bottom)
        return [Range(r.sheet, first, last, top, bottom, r.shape)]

    def one_range(self, node: S.Node | None) -> Range | Fault:
        r = self.ranges(node)
        if isinstance(r, Fault):
            return r
        return r[0] if r and len(r) == 1 else VALUE

    def column(self, r: Range, i: int) -> Cell:
        return self.book.sheets[r.sheet].cell(i)

    # --- expressions

    def cell(self, node: S.Node | None) -> Cell:
        if node is None:
            return C.constant(None)
        if id(node) in self.given:
            return self.given[id(node)]
        if self.array and (isinstance(node, S.Ref) or (isinstance(node, S.Call) and S.plain_name(node.name) in AGGREGATES)):
            return C.constant(self.book.scalar(node, self.home))
        match node:
            case S.Number() | S.Text() | S.Bool():
                return C.constant(node.value)
            case S.Error():
                return C.fault(Fault(node.code))
            case S.Paren():
                return self.cell(node.of)
            case S.Ref():
                return self.reference(node)
            case S.Name():
                return self.named(node)
            case S.Table():
                return C.fault(NAME)
            case S.Array():
                return self.cell(node.rows[0][0])
            case S.Unary():
                return self.unary(node)
            case S.Binary():
                if node.op in (":", ",", " "):
                    return self.intersected(node)
                return operate(node.op, self.cell(node.left), self.cell(node.right))
            case S.Call():
                return self.call(node)
        return C.fault(NAME)

    def unary(self, node: S.Unary) -> Cell:
        if node.op == "#":
            return C.fault(NAME)
        x = self.cell(node.of)
        if node.op == "-" and x.is_constant and x.kind == "num":
            return C.constant(-x.constant)
        return {"+": lambda: x, "@": lambda: x, "-": lambda: C.negated(x), "%": lambda: C.arithmetic("/", x, C.constant(100.0))}[node.op]()

    def named(self, node: S.Name) -> Cell:
        key = node.name.upper()
        if key not in self.book.names or key in self.open:
            return C.fault(NAME)
        self.open.append(key)
        try:
            return self.cell(S.parse(self.book.names[key]))
        finally:
            self.open.pop()

    def reference(self, ref: S.Ref) -> Cell:
        found = self.ranges(ref)
        if isinstance(found, Fault):
            return C.fault(found)
        r = found[0]
        if len(found) > 1:
            return C.fault(VALUE)
        if r.first > r.last:  # beyond the sheet
            return C.constant(None)
        if ref.row is None or ref.col is None:
            return self.of_range(r)
        return self.one_cell(r)

    def one_cell(self, r: Range) -> Cell:
        """A range of one cell as its value."""
        if r.shape == "fixed":
            return self.fixed(r)
        if r.top or self.host is None or r.sheet != self.host.name.upper():
            return self.other_row(r.sheet, r.first, r.top)
        return self.staged(self.host.cell(r.first)) if self.host.is_time(r.first) else self.host.cell(r.first)

    def other_row(self, sheet: str, i: int, step: int) -> Cell:
        """The cell so many rows below: a join on row numbers, not a window over the whole sheet."""
        self.needs_rows = True
        from_ = self.book.sheets[sheet]
        own, name = from_.cell(i), self.name("r")
        right = from_.placed().select((F.col("_row") - step).alias(f"{name}_at"), own.v.alias(name))
        self.joins.append(lambda df: df.join(right, df["_row"] == F.col(f"{name}_at"), "left").drop(f"{name}_at"))
        return Cell(own.kind, F.col(name), None, True)

    def fixed(self, r: Range) -> Cell:
        own, name = self.column(r, r.first), self.name("f")
        one = self.book.sheets[r.sheet].placed().where(F.col("_row") == r.top).agg(F.first(own.v).alias(name))
        self.single_rows.append(one)
        return Cell(own.kind, F.col(name), None, True)

    def intersected(self, node: S.Node) -> Cell:
        """A range where a value is wanted: of one column the row's own cell."""
        r = self.one_range(node)
        return C.fault(r) if isinstance(r, Fault) else self.of_range(r)

    def of_range(self, r: Range) -> Cell:
        if r.top is not None and r.height == 1 and r.first == r.last:
            return self.one_cell(r)
        if self.host is None or r.sheet != self.host.name.upper() or r.first != r.last:
            return C.fault(VALUE)
        own = self.host.cell(r.first)
        if r.top is None:
            return own
        if r.shape == "window":
            return own if r.top <= 0 <= r.bottom else C.fault(VALUE)
        if r.shape == "anchored":
            raise Unsupported("a single value of a range from a fixed row to the row's own")
        self.needs_rows = True
        return Cell(own.kind, own.v, C.first_fault(own.e, C.when_fault(~F.col("_row").between(r.top, r.bottom), VALUE)), own.blank)

    def call(self, node: S.Call) -> Cell:
        name = S.plain_name(node.name)
        if name in AGGREGATES:
            return AGGREGATES[name](self, node.args)
        if name not in SCALARS:
            return C.fault(NAME)
        least, most, f = SCALARS[name]
        if not least <= len(node.args) <= most:
            return C.fault(NAME if most == 0 else VALUE)
        return f(self, node.args)

    # --- arguments of aggregates

    def parts(self, args: list, arrays: bool = False) -> tuple[list[tuple[Range | None, Cell]], list[Cell]] | Fault:
        """Columns of ranges, each with where it lies (none: a cell of the row), and direct values. arrays: other arguments
        spread over the sheet whose columns they name."""
        columns, direct = [], []
        for a in args:
            found = self.ranges(a)
            if isinstance(found, Fault):
                return found
            if found is not None:
                for r in found:
                    columns += [(None, x) for x in self.cells_of(r)] if r.shape == "window" else [(r, self.column(r, i)) for i in r.columns()]
                continue
            over = self.arrays_in(a) if arrays else {}
            if over:
                columns += self.spread(a, over)
            else:
                direct.append(self.cell(a))
        return columns, direct

    def arrays_in(self, node: S.Node | None) -> dict[int, Range]:
        """The ranges of more than one cell that an expression runs over, by the id of their node; those inside aggregates
        are theirs."""
        if node is None or (isinstance(node, S.Call) and S.plain_name(node.name) in AGGREGATES):
            return {}
        found = self.ranges(node)
        if isinstance(found, Fault):
            return {}
        if found is not None:
            return {} if len(found) == 1 and found[0].height == 1 and found[0].first == found[0].last else {id(node): r for r in found}
        return {k: r for n in node.children() for k, r in self.arrays_in(n).items()}

    def spread(self, node: S.Node, over: dict[int, Range]) -> list[tuple[Range | None, Cell]]:
        """An expression element by element: a column for each column of the ranges, or a cell for each cell of a window."""
        shapes = {(r.height, r.last - r.first, r.shape) for r in over.values()}
        if len(shapes) > 1:
            raise Unsupported("arrays of different shapes in one expression")
        (height, wide, shape), = shapes
        if shape == "window":
            cells = {k: self.cells_of(r) for k, r in over.items()}
            return [(None, self.within({k: c[i] for k, c in cells.items()}, node)) for i in range(height * (wide + 1))]
        if len({(r.sheet, r.rows) for r in over.values()}) > 1 or shape == "anchored":
            raise Unsupported("arrays of ranges in different rows or sheets, or from a fixed row to the row's own")
        if self.host is not None and any(self.reads_row(n) for n in outside(node, over)):
            raise Unsupported("arrays that read the row's own cells too")
        first, out = next(iter(over.values())), []
        for j in range(wide + 1):
            inner = Compiler(self.book, None, 1, array=True, home=self.home)
            out.append((Range(first.sheet, first.first + j, first.first + j, *first.rows), inner.within({k: self.column(r, r.first + j) for k, r in over.items()}, node)))
        return out

    def within(self, given: dict[int, Cell], node: S.Node) -> Cell:
        before, self.given = self.given, given
        try:
            return self.cell(node)
        finally:
            self.given = before

    def known(self, node: S.Node | None) -> V.Value:
        """The value of an argument that the plan itself depends on."""
        if self.reads_row(node):
            raise Unsupported("an argument that must be known beforehand differs by row")
        return None if node is None else self.book.scalar(node, self.home)

    def reads_row(self, node: S.Node | None) -> bool:
        """Whether the node's value may differ by row: it names cells that move along, a column's own cell, or ROW()."""
        if node is None or self.host is None:
            return False
        if isinstance(node, S.Ref):
            return not node.row.absolute if node.row is not None else node.sheet is None
        if isinstance(node, S.Call):
            name = S.plain_name(node.name)
            if name == "ROW" and not node.args:
                return True
            if name in AGGREGATES:  # whole columns are ranges there
                return any(self.reads_row(a) for a in node.args if a is not None and not (isinstance(a, S.Ref) and a.row is None))
        return any(self.reads_row(n) for n in node.children())


def outside(node: S.Node, over: dict[int, Range]) -> list[S.Node]:
    """The leaves of an expression that aren't in its ranges."""
    if id(node) in over:
        return []
    below = list(node.children())
    return [n for b in below for n in outside(b, over)] if below and not isinstance(node, S.Ref) and not (isinstance(node, S.Call) and S.plain_name(node.name) in AGGREGATES) else [node]


def operate(op: str, a: Cell, b: Cell) -> Cell:
    if a.is_constant and b.is_constant:
        from gridloom.plans.interp import operate as one

        return C.constant(one(op, a.constant, b.constant))
    if op == "&":
        return C.joined(a, b)
    return C.arithmetic(op, a, b) if op in "+-*/^" else C.compared(op, a, b)


# --- aggregates


def numeric(x: Cell) -> Column | None:
    """The numbers of a column as an aggregate sees them: text, truth values and blanks are none."""
    if x.kind == "num":
        return x.v
    return F.when(x.v["k"] == "n", x.v["n"]) if x.kind == "mixed" else None


def guarded(x: Cell, v: Column) -> Column:
    return v if x.e is None else F.when(x.e.isNull(), v)


def add(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def gather(own: Compiler, args: list, aggregate, arrays: bool, alone=lambda n: F.coalesce(n, F.lit(0.0)), run=("sum", lambda n: n, 0.0)) -> tuple[list[Column], list[Cell], Column | None] | Fault:
    """An aggregate of each column, the direct values as numbers, and the first fault. alone: the aggregate of one cell; run:
    its fold, what of each number is folded, and what it is over nothing."""
    parts = own.parts(args, arrays)
    if isinstance(parts, Fault):
        return parts
    columns, direct = parts
    out, faults = [], []
    for r, x in columns:
        n = numeric(x)
        if n is not None:
            out.append(own.total(r, aggregate(guarded(x, n)), alone(n), (run[0], run[1](n), None if run[2] is None else F.lit(run[2]))))
        if x.e is not None:
            faults.append(own.total(r, F.min(x.e), x.e))
    direct = [C.as_number(x) for x in direct]
    return out, direct, C.first_fault(*faults, *(x.e for x in direct))


def one_if_there(v: Column) -> Column:
    return F.when(v.isNotNull(), 1.0).otherwise(0.0)


def running_range(own: Compiler, args: list) -> Cell | None:
    """SUM from the sheet's first row to the row's own, in one column: a running total."""
    node = args[0] if len(args) == 1 else None
    if own.host is None or not isinstance(node, S.Binary) or node.op != ":" or not all(isinstance(e, S.Ref) and e.single and e.sheet is None for e in (node.left, node.right)):
        return None
    a, b = node.left, node.right
    if not (a.row.absolute and a.row.at == 0 and not b.row.absolute and b.row.at + 1 == own.row and a.col.at == b.col.at):
        return None
    n = numeric(own.host.cell(a.col.at))
    if n is None:
        return C.constant(0.0)
    name, key = own.name("run"), own.host.key
    own.joins.append(lambda df: ordered.running(df, F.col(key[0]), [F.col(k).asc_nulls_first() for k in key[1:]], n, "sum", name))
    return C.number(F.coalesce(F.col(name), F.lit(0.0)))


def _sum(own: Compiler, args: list) -> Cell:
    run = running_range(own, args)
    if run is not None:
        return run
    got = gather(own, args, lambda n: F.coalesce(F.sum(n), F.lit(0.0)), True)
    if isinstance(got, Fault):
        return C.fault(got)
    out, direct, faults = got
    return C.number(add([*out, *(x.v for x in direct)]), faults)


def _product(own: Compiler, args: list) -> Cell:
    got = gather(own, args, lambda n: F.coalesce(F.product(n), F.lit(1.0)), True, lambda n: F.coalesce(n, F.lit(1.0)), ("product", lambda n: n, 1.0))
    if isinstance(got, Fault):
        return C.fault(got)
    out, direct, faults = got
    v = F.lit(1.0)
    for p in [*out, *(x.v for x in direct)]:
        v = v * p
    return C.number(v, faults, checked=True)


def counts(own: Compiler, args: list, arrays: bool) -> tuple[Column, Column, Column | None] | Fault:
    """Sum and count of the numbers."""
    got = gather(own, args, lambda n: F.coalesce(F.sum(n), F.lit(0.0)), arrays)
    if isinstance(got, Fault):
        return got
    n = gather(own, args, lambda n: F.count(n).cast("double"), arrays, one_if_there, ("sum", one_if_there, 0.0))
    return add([*got[0], *(x.v for x in got[1])]), add([*n[0], *(F.lit(1.0) for _ in n[1])]), got[2]


def _average(own: Compiler, args: list) -> Cell:
    got = counts(own, args, True)
    if isinstance(got, Fault):
        return C.fault(got)
    total, n, faults = got
    return C.number(F.try_divide(total, n), faults, C.when_fault(n == 0, DIV0))


def _count(own: Compiler, args: list) -> Cell:
    parts = own.parts(args)
    if isinstance(parts, Fault):
        return C.constant(0.0)
    out = [own.total(r, F.count(guarded(x, n)).cast("double"), one_if_there(n), ("sum", one_if_there(n), F.lit(0.0))) for r, x in parts[0] if (n := numeric(x)) is not None]
    for x in parts[1]:
        n = C.as_number(x)
        out.append(F.lit(1.0) if n.e is None else F.when(n.e.isNull(), 1.0).otherwise(0.0))
    return C.number(add(out))


def _counta(own: Compiler, args: list) -> Cell:
    parts = own.parts(args)
    if isinstance(parts, Fault):
        return C.constant(1.0)
    return C.number(add([own.total(r, F.count(x.v).cast("double"), one_if_there(x.v), ("sum", one_if_there(x.v), F.lit(0.0))) for r, x in parts[0]] + [F.lit(1.0) for _ in parts[1]]))


def _countblank(own: Compiler, args: list) -> Cell:
    parts = own.parts(args)
    if isinstance(parts, Fault):
        return C.fault(parts)
    empty = lambda x: x.v.isNull() | (x.v == "") if x.kind == "text" else x.v.isNull()
    return C.number(add([own.total(r, F.count_if(empty(x)).cast("double"), empty(x).cast("double"), ("sum", empty(x).cast("double"), F.lit(0.0))) for r, x in parts[0]]))


def _extreme(fold, pick, kind: str):
    def run(own: Compiler, args: list) -> Cell:
        got = gather(own, args, fold, False, lambda n: n, (kind, lambda n: n, None))
        if isinstance(got, Fault):
            return C.fault(got)
        parts = [*got[0], *(x.v for x in got[1])]
        v = parts[0] if len(parts) == 1 else pick(*parts) if parts else F.lit(0.0)
        return C.number(F.coalesce(v, F.lit(0.0)), got[2])

    return run


def stacked(own: Compiler, args: list) -> tuple[DataFrame, Column | None] | Fault:
    """One column v of all numbers, for aggregates that need them together."""
    parts = own.parts(args)
    if isinstance(parts, Fault):
        return parts
    if any(r is None for r, _ in parts[0]):
        raise Unsupported("order statistics of the row's own cells and of whole ranges together")
    frames = [own.rows_of(r.sheet, r.rows).select(guarded(x, numeric(x)).alias("v")) for r, x in parts[0] if numeric(x) is not None]
    numbers = [C.as_number(x) for x in parts[1]]
    frames += [own.book.spark.range(1).select(x.v.alias("v")) for x in numbers]
    out = frames[0] if frames else own.book.spark.range(0).select(F.lit(0.0).alias("v"))
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.where("v is not null"), C.first_fault(*(x.e for x in numbers))


def row_numbers(own: Compiler, args: list) -> tuple[Column, Column | None] | None:
    """The numbers of the row's own cells and of direct values as an array, if the arguments are nothing else."""
    found = [own.ranges(a) for a in args]
    if isinstance(own.host, Sheet) and any(isinstance(f, list) for f in found) and all(not isinstance(f, list) or all(r.shape == "window" for r in f) for f in found):
        parts = own.parts(args)
        if not isinstance(parts, Fault):
            direct = [C.as_number(x) for x in parts[1]]
            every = [n for r, x in parts[0] if (n := numeric(x)) is not None] + [x.v for x in direct]
            return F.array_compact(F.array(*every) if every else F.array().cast("array<double>")), C.first_fault(*(x.e for x in direct))
    return None


def middle(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def deviation(sample: bool, root: bool):
    def of(a: Column) -> Column:
        n = F.size(a)
        mean = F.try_divide(F.aggregate(a, F.lit(0.0), lambda t, x: t + x), n)
        square = F.aggregate(a, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean))
        v = F.when(n >= 1 + sample, F.try_divide(square, n - int(sample)))
        return F.sqrt(v) if root else v

    return of


def _stacked(fold, missing: Fault, rowwise):
    """An aggregate over all numbers at once; null is the fault. rowwise: the same of an array."""

    def run(own: Compiler, args: list) -> Cell:
        if (cells := row_numbers(own, args)) is not None:
            x = own.staged(Cell("num", rowwise(cells[0])))
            return C.number(x.v, cells[1], C.when_fault(x.v.isNull(), missing))
        got = stacked(own, args)
        if isinstance(got, Fault):
            return C.fault(got)
        name = own.name("s")
        own.single_rows.append(got[0].agg(fold(F.col("v")).alias(name)))
        return C.number(F.col(name), got[1], C.when_fault(F.col(name).isNull(), missing))

    return run


def _median(own: Compiler, args: list) -> Cell:
    if row_numbers(own, args) is not None:
        return _stacked(None, NUM, middle)(own, args)
    got = stacked(own, args)
    if isinstance(got, Fault):
        return C.fault(got)
    name = own.name("s")
    own.single_rows.append(ordered.median(got[0], "v").withColumnRenamed("v", name))
    return C.number(F.col(name), got[1], C.when_fault(F.col(name).isNull(), NUM))


def _kth(largest: bool):
    def run(own: Compiler, args: list) -> Cell:
        if (cells := row_numbers(own, args[:1])) is not None:
            k = C.as_number(own.cell(args[1]))
            x = own.staged(Cell("num", F.get(F.sort_array(cells[0], not largest), (F.ceil(k.v) - 1).cast("int"))))
            return C.number(x.v, cells[1], k.e, C.when_fault(x.v.isNull(), NUM))
        got = stacked(own, args[:1])
        if isinstance(got, Fault):
            return C.fault(got)
        if own.host is not None and own.reads_row(args[1]):
            raise Unsupported("LARGE or SMALL of a whole range with a place that differs by row")
        k = V.number(own.known(args[1]))
        if isinstance(k, Fault):
            return C.fault(k)
        name = own.name("k")
        own.single_rows.append(ordered.kth(got[0], "v", math.ceil(k), largest).select(F.col("v").alias(name)))
        return C.number(F.col(name), got[1], C.when_fault(F.col(name).isNull(), NUM))

    return run


def _rank(own: Compiler, args: list) -> Cell:
    r = own.one_range(args[1])
    if isinstance(r, Fault):
        return C.fault(r)
    up = len(args) > 2 and bool(V.truth(own.known(args[2]) if args[2] is not None else False))
    x, name = C.as_number(own.cell(args[0])), own.name("rank")
    if (cells := row_numbers(own, args[1:2])) is not None:
        better = F.size(F.filter(cells[0], lambda n: n < x.v if up else n > x.v))
        return C.number(F.when(F.array_contains(cells[0], x.v), better + 1.0), x.e, C.when_fault(~F.array_contains(cells[0], x.v), NA))
    values = own.rows_of(r.sheet, r.rows).select(own.column(r, r.first).v.alias("_rv"))
    places = ordered.ranked(values, "_rv", name, up).select("_rv", name).distinct()
    value = own.name("x")
    own.joins.append(lambda df: df.withColumn(value, x.v).join(places, F.col(value) == F.col("_rv"), "left").drop("_rv"))
    return C.number(F.col(name), x.e, C.when_fault(F.col(name).isNull(), NA))


SUBTOTALS = ("AVERAGE", "COUNT", "COUNTA", "MAX", "MIN", "PRODUCT", "STDEV", "STDEVP", "SUM", "VAR", "VARP")


def _subtotal(own: Compiler, args: list) -> Cell:
    code = V.number(own.known(args[0])) if args else VALUE
    if isinstance(code, Fault):
        return C.fault(code)
    code = int(code) - 100 if 101 <= code <= 111 else int(code)
    return AGGREGATES[SUBTOTALS[code - 1]](own, args[1:]) if 1 <= code <= 11 and len(args) > 1 else C.fault(VALUE)


def _sumproduct(own: Compiler, args: list) -> Cell:
    found = [own.ranges(a) for a in args]
    if len(args) == 1 and found[0] is None:
        return _sum(own, args)
    rs = [r[0] if isinstance(r, list) and len(r) == 1 else VALUE for r in found]
    if any(isinstance(r, Fault) for r in rs) or len({(r.last - r.first, r.height) for r in rs}) > 1:
        return C.fault(VALUE)
    if any(r.shape == "window" for r in rs):
        if not all(r.shape == "window" for r in rs):
            raise Unsupported("SUMPRODUCT of ranges that move along with the row and ranges that don't")
        products = []
        for row in zip(*(own.cells_of(r) for r in rs), strict=True):
            v = F.lit(1.0)
            for x in row:
                v = v * (F.lit(0.0) if numeric(x) is None else F.coalesce(numeric(x), F.lit(0.0)))
            products.append(v)
        return C.number(add(products))
    if len({(r.rows, r.sheet) for r in rs}) > 1:
        raise Unsupported("SUMPRODUCT of ranges in different rows or sheets")
    out = []
    for j in range(rs[0].last - rs[0].first + 1):
        v = F.lit(1.0)
        for r in rs:
            n = numeric(own.column(r, r.first + j))
            v = v * (F.lit(0.0) if n is None else F.coalesce(n, F.lit(0.0)))
        out.append(own.total(rs[0], F.coalesce(F.sum(v), F.lit(0.0)), None, ("sum", v, F.lit(0.0))))
    return C.number(add(out))


# --- lookups


def normal_key(x: Cell, kind: str) -> tuple[Column, Column | None]:
    """A key as a lane of one kind compares it; null where the kinds differ."""
    if x.kind == "mixed":
        part = x.v["n"] if kind == "num" else F.lower(x.v["t"])
        return F.when(x.v["k"] == ("n" if kind == "num" else "t"), part), x.e
    if x.kind == "blank":
        x = C.constant(0.0)
    if x.kind != kind:
        return F.lit(None).cast("double" if kind == "num" else "string"), x.e
    return (F.coalesce(x.v, F.lit(0.0)) if x.blank and kind == "num" else x.v) if kind != "text" else F.lower(x.v), x.e


def pattern_of(key: Column) -> Column:
    """The regular expression that a text with wildcards stands for."""
    return F.concat(F.lit("(?s)^("), C.glob(F.lower(key)), F.lit(")$"))


def equal_to(own: Cell, key: Cell) -> Column:
    """Whether a cell is what an exact lookup looks for: of one kind and equal, wildcards in the key's text allowed."""
    asked, _ = normal_key(key, own.kind)
    same = (F.lower(own.v) if own.kind == "text" else own.v) == asked
    if own.kind == "text" and key.kind in ("text", "mixed"):
        same = F.when(asked.rlike(r"[*?~]"), F.rlike(F.lower(own.v), pattern_of(asked))).otherwise(same)
    return F.coalesce(same, F.lit(False))


def ordered_by(own: Cell, key: Cell, up: bool) -> Column:
    asked, _ = normal_key(key, own.kind)
    v = F.lower(own.v) if own.kind == "text" else own.v
    return F.coalesce(v <= asked if up else v >= asked, F.lit(False))


def located(own: Compiler, key: Cell, r: Range, mode: int, values: list[Cell], columns: list[int]) -> tuple[list[Cell], Cell, Column | None]:
    """For each row's key the values beside the lane's fitting cell, and its place in the range (from 1). mode 0: the first
    equal cell; 1: the last that isn't above; -1: the last of the first run that isn't below. columns: where the values lie."""
    if r.shape == "window":
        return in_window(own, key, r, mode, columns)
    lane, sheet = own.column(r, r.first), own.book.sheets[r.sheet]
    asked, e = normal_key(key, lane.kind)
    source = sheet.placed()
    if r.shape == "anchored":
        if mode or r.top != 1:
            raise Unsupported("lookups in a range from a fixed row to the row's own, but exact ones from the first row")
        own.needs_rows = True
    elif r.top is not None:
        source = source.where(F.col("_row").between(r.top, r.bottom))
    base = (r.top or 1) - 1
    ask, at = own.name("ask"), own.name("at")
    names = [own.name("v") for _ in values]
    text = lane.kind == "text"
    wild = text and mode == 0 and (not key.is_constant or (isinstance(key.constant, str) and V.has_wildcard(key.constant))) and key.kind in ("text", "mixed")
    lanes = source.select((F.lower(lane.v) if text else lane.v).alias("_lane"), (F.col("_row") - base).alias("_place"), *(x.v.alias(n) for n, x in zip(names, values, strict=True))).where("_lane is not null")
    best = [F.min("_place").alias(at), *(F.min_by(n, "_place").alias(n) for n in names)]
    if mode == 0 and wild and key.is_constant:
        if r.shape == "anchored":
            raise Unsupported("wildcards in a range from a fixed row to the row's own")
        hit = lanes.where(F.col("_lane").rlike("(?s)^(" + V.glob(key.constant.lower()) + ")$"))
        own.single_rows.append(hit.agg(*best))
    elif mode == 0:
        first = lanes.groupBy("_lane").agg(*best)

        def equal(df: DataFrame) -> DataFrame:
            df = df.withColumn(ask, asked)
            plain = F.col(ask) == F.col("_lane")
            df = df.join(first, plain & ~F.col(ask).rlike(r"[*?~]") if wild else plain, "left").drop("_lane")
            if wild:  # distinct patterns against distinct texts
                given = df.where(F.col(ask).rlike(r"[*?~]")).select(F.col(ask).alias("_ask")).distinct()
                met = given.join(first.withColumnRenamed(at, "_place"), F.rlike(F.col("_lane"), pattern_of(F.col("_ask"))))
                met = met.groupBy("_ask").agg(F.min("_place").alias("_p"), *(F.min_by(n, "_place").alias(f"{n}_w") for n in names))
                df = df.join(met, F.col(ask) == F.col("_ask"), "left")
                df = df.withColumns({at: F.coalesce(at, "_p")} | {n: F.coalesce(n, f"{n}_w") for n in names}).drop("_ask", "_p", *(f"{n}_w" for n in names))
            if r.shape == "anchored":
                df = df.withColumn(at, F.when(F.col(at) <= F.col("_row") + r.bottom, F.col(at)))
            return df

        own.joins.append(equal)
    elif mode < 0:
        if not key.is_constant:
            raise Unsupported("MATCH with -1 and a key that differs by row")
        own.single_rows.append(first_run_end(source.select((F.lower(lane.v) if text else lane.v).alias("_lane"), (F.col("_row") - base).alias("_place")), asked, at))
    else:
        plain = lanes.select("_lane", "_place")
        beside = lanes.select(F.col("_place").alias(f"{at}_p"), *names)

        def join(df: DataFrame) -> DataFrame:
            df = df.withColumn(ask, asked)
            df = ordered.last_not_above(df, ask, plain, "_lane", "_place", at)
            return df.join(beside, F.col(at) == F.col(f"{at}_p"), "left").drop(f"{at}_p") if names else df

        own.joins.append(join)
    missing = C.when_fault(F.col(at).isNull(), NA)
    faults = C.first_fault(e, missing)
    return [Cell(x.kind, F.col(n), faults, True) for n, x in zip(names, values, strict=True)], Cell("num", F.col(at).cast("double"), faults), faults


def in_window(own: Compiler, key: Cell, r: Range, mode: int, columns: list[int]) -> tuple[list[Cell], Cell, Column | None]:
    """A lookup in the cells that the row sees."""
    seen, key = own.seen(r, r.first, *columns), own.staged(key)
    fits = lambda x: equal_to(own.element(r, r.first, x), key) if mode == 0 else ordered_by(own.element(r, r.first, x), key, mode > 0)
    if mode < 0:
        start = F.coalesce(F.get(F.filter(seen, fits), F.lit(0))["row"], F.lit(1 << 60))
        after = F.filter(seen, lambda x: (x["row"] > start) & ~fits(x))
        end = F.coalesce(F.get(after, F.lit(0))["row"], F.lit(1 << 61))
        hits = F.filter(seen, lambda x: (x["row"] >= start) & (x["row"] < end))
    else:
        hits = F.filter(seen, fits)
    name = own.name("hit")
    pick = F.get(hits, F.lit(0)) if mode == 0 else F.get(F.reverse(hits), F.lit(0))
    own.joins.append(lambda df: df.withColumn(name, pick))
    hit = F.col(name)
    faults = C.first_fault(key.e, C.when_fault(hit.isNull(), NA))
    place = (hit["row"] - F.col("_row") - r.top + 1).cast("double")
    return [Cell(x.kind, x.v, faults, True) for x in (own.element(r, i, hit) for i in columns)], Cell("num", place, faults), faults


def line(own: Compiler, r: Range, down: int) -> list[Cell]:
    """The cells of one row of a range, so many rows below its first."""
    if r.shape == "anchored":
        raise Unsupported("a row of a range from a fixed row to the row's own")
    if r.shape == "window":
        return own.cells_of(Range(r.sheet, r.first, r.last, r.top + down, r.top + down, "window"))
    out, columns = [], []
    for i in r.columns():
        x, name = own.column(r, i), own.name("h")
        columns.append(F.max(x.v).alias(name))
        out.append(Cell(x.kind, F.col(name), None, True))
    own.single_rows.append(own.book.sheets[r.sheet].placed().where(F.col("_row") == (r.top or 1) + down).agg(*columns))
    return out


def along(heads: list[Cell], key: Cell, mode: int) -> list[Column]:
    """Which of the cells a lookup along a row takes, if any: one at most is true."""
    fits = [equal_to(x, key) if mode == 0 else ordered_by(x, key, mode > 0) for x in heads]
    out, before = [], F.lit(False)
    if mode > 0:
        for hit in reversed(fits):
            out.append(hit & ~before)
            before = before | hit
        return out[::-1]
    if mode == 0:
        for hit in fits:
            out.append(hit & ~before)
            before = before | hit
        return out
    for i, hit in enumerate(fits):  # the end of the first run
        run = hit & ~before
        out.append(run & ~fits[i + 1] if i + 1 < len(fits) else run)
        before = before | out[-1]
    return out


def first_run_end(lanes: DataFrame, key: Column, name: str) -> DataFrame:
    """One row: the last place of the first run of lanes that aren't below the key; null if there is none."""
    fits = F.coalesce(F.col("_lane") >= key, F.lit(False))
    start = lanes.agg(F.min(F.when(fits, F.col("_place"))).alias("_start"), F.max("_place").alias("_end"))
    miss = lanes.crossJoin(start).where((F.col("_place") > F.col("_start")) & ~fits).agg(F.min("_place").alias("_miss"))
    return start.crossJoin(miss).select(F.when(F.col("_start").isNotNull(), F.coalesce(F.col("_miss") - 1, F.col("_end"))).alias(name))


def is_near(own: Compiler, args: list) -> bool:
    return len(args) < 4 or (args[3] is not None and bool(V.truth(own.known(args[3]))))


def _hlookup(own: Compiler, args: list) -> Cell:
    """Along the first row of a table of few columns: its cells and those of the row asked for are one row of values."""
    r, k = own.one_range(args[1]), V.number(own.known(args[2]))
    for x in (r, k):
        if isinstance(x, Fault):
            return C.fault(x)
    if k < 1:
        return C.fault(VALUE)
    if r.height is not None and int(k) > r.height:
        return C.fault(REF)
    heads, (kind, found) = line(own, r, 0), C.together(line(own, r, int(k) - 1))
    key = own.staged(own.cell(args[0]))
    out, some = F.lit(None), F.lit(False)
    for hit, x in zip(along(heads, key, 1 if is_near(own, args) else 0), found, strict=True):
        out, some = F.when(hit, x.v).otherwise(out), some | hit
    return Cell(kind, out, C.first_fault(key.e, C.when_fault(~some, NA)), True)


def _vlookup(own: Compiler, args: list) -> Cell:
    r = own.one_range(args[1])
    if isinstance(r, Fault):
        return C.fault(r)
    mode, wide = 1 if is_near(own, args) else 0, r.last - r.first + 1
    if own.reads_row(args[2]):  # the column differs by row
        k = own.staged(C.as_number(own.cell(args[2])))
        cells, _, faults = located(own, own.cell(args[0]), r, mode, [own.column(r, i) for i in r.columns()], list(r.columns()))
        kind, cells = C.together(cells)
        out = F.lit(None)
        for i, x in enumerate(cells):
            out = F.when(F.floor(k.v) == i + 1, x.v).otherwise(out)
        return Cell(kind, out, C.first_fault(k.e, C.when_fault(k.v < 1, VALUE), C.when_fault(k.v >= wide + 1, REF), faults), True)
    k = V.number(own.known(args[2]))
    if isinstance(k, Fault):
        return C.fault(k)
    if k < 1:
        return C.fault(VALUE)
    if int(k) > wide:
        return C.fault(REF)
    at = r.first + int(k) - 1
    return located(own, own.cell(args[0]), r, mode, [own.column(r, at)], [at])[0][0]


def match_mode(own: Compiler, args: list) -> int:
    mode = V.number(own.known(args[2])) if len(args) > 2 else 1.0
    return int((mode > 0) - (mode < 0))


def _match(own: Compiler, args: list) -> Cell:
    r = own.one_range(args[1])
    if isinstance(r, Fault):
        return C.fault(r)
    mode = match_mode(own, args)
    if r.first == r.last:
        return located(own, own.cell(args[0]), r, mode, [], [])[1]
    if r.height != 1:
        return C.fault(NA)
    heads, key = line(own, r, 0), own.staged(own.cell(args[0]))
    out = F.lit(None).cast("double")
    for i, hit in enumerate(along(heads, key, mode)):
        out = F.when(hit, float(i + 1)).otherwise(out)
    return Cell("num", out, C.first_fault(key.e, C.when_fault(out.isNull(), NA)))


def _index(own: Compiler, args: list) -> Cell:
    if len(args) not in (2, 3):
        return C.fault(VALUE)
    if not any(own.reads_row(a) for a in args[1:]):
        found = own.indexed(args)
        return C.fault(found) if isinstance(found, Fault) else own.of_range(found[0])
    r = own.one_range(args[0])
    if isinstance(r, Fault):
        return C.fault(r)
    inner = args[1]
    while isinstance(inner, S.Paren):
        inner = inner.of
    if len(args) == 2 and r.height == 1:
        return picked(line(own, r, 0), own.staged(C.as_number(own.cell(inner))))
    if len(args) > 2 and own.reads_row(args[2]):
        raise Unsupported("INDEX with a column that differs by row")
    col = int(V.number(own.known(args[2]))) if len(args) > 2 and args[2] is not None else 0
    if col < 0:
        return C.fault(VALUE)
    if col > r.last - r.first + 1:
        return C.fault(REF)
    if col == 0 and r.first != r.last:
        raise Unsupported("INDEX of a whole row of a table where the row differs")
    column = r.first + max(col, 1) - 1
    value = own.column(r, column)
    if isinstance(inner, S.Call) and S.plain_name(inner.name) == "MATCH" and len(inner.args) in (2, 3):
        lane = own.one_range(inner.args[1])
        if isinstance(lane, Range) and lane.sheet == r.sheet and lane.rows == r.rows and lane.first == lane.last:
            return located(own, own.cell(inner.args[0]), lane, match_mode(own, inner.args), [value], [column])[0][0]
    place, name, at = C.as_number(own.cell(args[1])), own.name("i"), own.name("at")
    here = own.host is not None and r.sheet == own.host.name.upper()  # place 0 is the whole column: its cell in the own row
    if r.shape == "anchored":
        raise Unsupported("INDEX of a range from a fixed row to the row's own")
    if r.shape == "window":
        place = own.staged(place)
        zero = F.floor(place.v) == 0
        target = F.col("_row") + F.when(zero, 0).otherwise(r.top + F.floor(place.v) - 1)
        hit = F.get(F.filter(own.seen(r, column), lambda x: x["row"] == target), F.lit(0))
        missing = F.when(place.v < 0, VALUE.code).when(F.floor(place.v) > r.height, REF.code).when(zero & F.lit(not (here and r.top <= 0 <= r.bottom)), VALUE.code)
        return Cell(value.kind, own.element(r, column, hit).v, C.first_fault(place.e, missing), True)
    source = own.book.sheets[r.sheet].placed()
    base = (r.top or 1) - 1
    if r.top is not None:
        source = source.where(F.col("_row").between(r.top, r.bottom))
    rows = source.select((F.col("_row") - base).alias(f"{at}_p"), value.v.alias(name), F.lit(True).alias(f"{at}_is"))
    own.joins.append(lambda df: df.withColumn(at, F.floor(place.v)).join(rows, F.col(at) == F.col(f"{at}_p"), "left").drop(f"{at}_p"))
    zero = F.col(at) == 0
    if here and r.top is not None:
        own.needs_rows = True
    outside = F.lit(not here) if r.top is None or not here else ~F.col("_row").between(r.top, r.bottom)
    missing = F.when(F.col(at) < 0, VALUE.code).when(zero & outside, VALUE.code).when(~zero & F.col(f"{at}_is").isNull(), REF.code)
    v = F.when(zero, own.host.cell(column).v).otherwise(F.col(name)) if here else F.col(name)
    return Cell(value.kind, v, C.first_fault(place.e, missing), True)


def picked(cells: list[Cell], place: Cell) -> Cell:
    """One of a row's cells by its place."""
    kind, cells = C.together(cells)
    out = F.lit(None)
    for i, x in enumerate(cells):
        out = F.when(F.floor(place.v) == i + 1, x.v).otherwise(out)
    return Cell(kind, out, C.first_fault(place.e, C.when_fault(place.v < 1, VALUE), C.when_fault(place.v >= len(cells) + 1, REF)), True)


def _lookup(own: Compiler, args: list) -> Cell:
    r = own.one_range(args[1])
    out = own.one_range(args[2]) if len(args) > 2 else r
    for x in (r, out):
        if isinstance(x, Fault):
            return C.fault(x)
    if r.height is not None and r.height < r.last - r.first + 1:  # along a row
        heads, key = line(own, r, 0), own.staged(own.cell(args[0]))
        if len(args) > 2 and (out.height != 1 or out.last - out.first != r.last - r.first):
            raise Unsupported("LOOKUP along a row with results down a column")
        kind, found = C.together(line(own, out, 0 if len(args) > 2 else r.height - 1))
        v, some = F.lit(None), F.lit(False)
        for hit, x in zip(along(heads, key, 1), found, strict=True):
            v, some = F.when(hit, x.v).otherwise(v), some | hit
        return Cell(kind, v, C.first_fault(key.e, C.when_fault(~some, NA)), True)
    if (out.sheet, out.rows) != (r.sheet, r.rows):
        raise Unsupported("LOOKUP with keys and results in different rows or sheets")
    at = out.first if len(args) > 2 else out.last
    return located(own, own.cell(args[0]), r, 1, [own.column(out, at)], [at])[0][0]


AGGREGATES = {
    "SUM": _sum, "PRODUCT": _product, "AVERAGE": _average, "COUNT": _count, "COUNTA": _counta, "COUNTBLANK": _countblank, "MIN": _extreme(F.min, F.least, "min"), "MAX": _extreme(F.max, F.greatest, "max"),
    "MEDIAN": _median, "STDEV": _stacked(F.stddev_samp, DIV0, deviation(True, True)), "STDEV.S": _stacked(F.stddev_samp, DIV0, deviation(True, True)), "STDEVP": _stacked(F.stddev_pop, DIV0, deviation(False, True)), "STDEV.P": _stacked(F.stddev_pop, DIV0, deviation(False, True)),
    "VAR": _stacked(F.var_samp, DIV0, deviation(True, False)), "VAR.S": _stacked(F.var_samp, DIV0, deviation(True, False)), "VARP": _stacked(F.var_pop, DIV0, deviation(False, False)), "VAR.P": _stacked(F.var_pop, DIV0, deviation(False, False)),
    "LARGE": _kth(True), "SMALL": _kth(False), "RANK": _rank, "RANK.EQ": _rank, "SUBTOTAL": _subtotal, "SUMPRODUCT": _sumproduct,
    "VLOOKUP": _vlookup, "HLOOKUP": _hlookup, "MATCH": _match, "INDEX": _index, "LOOKUP": _lookup,
}

from gridloom.plans.criteria import CRITERIA  # noqa: E402  they use the compiler's cells
from gridloom.plans.scalars import SCALARS  # noqa: E402

AGGREGATES |= CRITERIA
