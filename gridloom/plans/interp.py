"""Evaluates a formula in one cell against a workbook's stored values.

The cell plane's reference semantics: receipts, scenario cells that have no column form, and the tests of the column
compiler use it. Evaluation never raises for a formula's sake: faults are values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cmp_to_key

from gridloom.functions import values as V
from gridloom.functions.values import DIV0, NA, NAME, NULL, NUM, REF, VALUE, Fault, Value
from gridloom.plans import syntax as S
from gridloom.plans.workbook import Workbook


@dataclass(frozen=True)
class Rect:
    sheet: int
    r0: int
    c0: int
    r1: int
    c1: int

    @property
    def height(self) -> int:
        return self.r1 - self.r0 + 1

    @property
    def width(self) -> int:
        return self.c1 - self.c0 + 1


class Rects(list):
    """A reference: rectangles one after another, repeats included."""


@dataclass
class Grid:
    """An array of values in a formula, row by row."""

    height: int
    width: int
    values: list[Value]


class Stop(Exception):
    """Carries a fault out of nested argument handling."""

    def __init__(self, fault: Fault):
        self.fault = fault


FUNCTIONS: dict[str, Callable[[Evaluator, list], object]] = {}


def function(*names: str, least: int = 0, most: int = 255):
    def register(f):
        def checked(ev, args):
            if not least <= len(args) <= most:
                return VALUE
            return f(ev, args)

        for n in names:
            FUNCTIONS[n] = checked
        return f

    return register


class Evaluator:
    """extents: where the sheets end, as far as known; evaluators of one book that doesn't change may share it."""

    def __init__(self, book: Workbook, sheet: int = 0, row: int = 0, col: int = 0, overlay: Callable | None = None, extents: dict[int, tuple[int, int]] | None = None):
        self.book, self.sheet, self.row, self.col = book, sheet, row, col
        self.overlay = overlay
        self.open_names: list[str] = []
        self.extents = {} if extents is None else extents

    # --- cells and references

    def cell(self, sheet: int, row: int, col: int) -> Value:
        if self.overlay is not None:
            found = self.overlay(sheet, row, col)
            if found is not Ellipsis:
                return found
        return self.book.sheets[sheet].values.get((row, col))

    def extent(self, sheet: int) -> tuple[int, int]:
        if sheet not in self.extents:
            self.extents[sheet] = self.book.sheets[sheet].extent()
        return self.extents[sheet]

    def positions(self, r: Rect) -> Iterator[tuple[int, int]]:
        for row in range(r.r0, r.r1 + 1):
            for col in range(r.c0, r.c1 + 1):
                yield row, col

    def each(self, rects: Rects) -> Iterator[Value]:
        for r in rects:
            for row, col in self.positions(r):
                yield self.cell(r.sheet, row, col)

    def resolve(self, ref: S.Ref) -> Rects | Fault:
        sheets = [self.sheet]
        if ref.dead or (ref.sheet and (ref.sheet.dead or ref.sheet.book is not None)):
            return REF
        if ref.sheet:
            first = self.book.index(ref.sheet.name or "")
            last = first if ref.sheet.last is None else self.book.index(ref.sheet.last)
            if first is None or last is None:
                return REF
            sheets = range(min(first, last), max(first, last) + 1)
        out = Rects()
        for s in sheets:
            if ref.single:
                out.append(Rect(s, ref.row.at, ref.col.at, ref.row.at, ref.col.at))
            elif ref.row is None:
                a, b = sorted((ref.col.at, ref.col2.at))
                out.append(Rect(s, 0, a, max(self.extent(s)[0], 0), b))
            else:
                a, b = sorted((ref.row.at, ref.row2.at))
                out.append(Rect(s, a, 0, b, max(self.extent(s)[1], 0)))
        return out

    def combine(self, op: str, left: S.Node, right: S.Node) -> Rects | Fault:
        a, b = self.operand(left), self.operand(right)
        for x in (a, b):
            if isinstance(x, Fault):
                return x
        if not isinstance(a, Rects) or not isinstance(b, Rects):
            return VALUE
        if op == ",":
            return Rects([*a, *b])
        if op == ":":
            if len(a) != 1 or len(b) != 1:
                return VALUE
            p, q = a[0], b[0]
            if p.sheet != q.sheet and not (isinstance(right, S.Ref) and right.sheet is None):
                return VALUE
            return Rects([Rect(p.sheet, min(p.r0, q.r0), min(p.c0, q.c0), max(p.r1, q.r1), max(p.c1, q.c1))])
        out = Rects()
        for p in a:
            for q in b:
                r = Rect(p.sheet, max(p.r0, q.r0), max(p.c0, q.c0), min(p.r1, q.r1), min(p.c1, q.c1))
                if p.sheet == q.sheet and r.height > 0 and r.width > 0:
                    out.append(r)
        return out or NULL

    def pick(self, x: object) -> Value:
        """A single value: of a larger range the cell in the formula's own row or column."""
        if isinstance(x, Grid):
            return x.values[0] if x.values else VALUE
        if not isinstance(x, Rects):
            return x
        if len(x) != 1:
            return VALUE
        r = x[0]
        if r.height == r.width == 1:
            return self.cell(r.sheet, r.r0, r.c0)
        if r.width == 1 and r.r0 <= self.row <= r.r1:
            return self.cell(r.sheet, self.row, r.c0)
        if r.height == 1 and r.c0 <= self.col <= r.c1:
            return self.cell(r.sheet, r.r0, self.col)
        return VALUE

    # --- expressions

    def formula(self, node: S.Node) -> Value:
        """The formula's value; a blank becomes 0."""
        try:
            v = self.value(node)
        except Stop as s:
            v = s.fault
        except RecursionError:
            v = NAME
        return 0.0 if v is None else v

    def value(self, node: S.Node | None) -> Value:
        return self.pick(self.operand(node))

    def operand(self, node: S.Node | None) -> object:
        if node is None:
            return None
        match node:
            case S.Number() | S.Text() | S.Bool():
                return node.value
            case S.Error():
                return Fault(node.code)
            case S.Paren():
                return self.operand(node.of)
            case S.Ref():
                return self.resolve(node)
            case S.Name():
                return self.named(node)
            case S.Table():
                return NAME
            case S.Array():
                width = max(map(len, node.rows))
                if any(len(r) != width for r in node.rows):
                    return VALUE
                return Grid(len(node.rows), width, [self.operand(x) for r in node.rows for x in r])
            case S.Call():
                name = S.plain_name(node.name)
                found = FUNCTIONS.get(name)
                return found(self, node.args) if found else NAME
            case S.Unary():
                if node.op == "#":
                    return NAME
                v = self.value(node.of)
                if node.op in "+@":
                    return v
                if node.op == "%":
                    return V.arithmetic("/", v, 100.0)
                n = V.number(v)
                return n if isinstance(n, Fault) else -n
            case S.Binary():
                if node.op in (":", ",", " "):
                    return self.combine(node.op, node.left, node.right)
                return operate(node.op, self.value(node.left), self.value(node.right))
        return NAME

    def named(self, node: S.Name) -> object:
        key = node.name.upper()
        body = self.book.names.get(key)
        if body is None or key in self.open_names or (node.sheet and node.sheet.book is not None):
            return REF if node.sheet and node.sheet.book is not None else NAME
        self.open_names.append(key)
        try:
            tree = S.parses(body)
            return NAME if tree is None else self.operand(tree)
        finally:
            self.open_names.pop()

    # --- arrays inside SUM, PRODUCT and AVERAGE

    def is_plain(self, node: S.Node | None) -> bool:
        """Whether an argument is a reference as it stands."""
        if isinstance(node, S.Paren):
            return self.is_plain(node.of)
        if isinstance(node, S.Ref):
            return True
        if isinstance(node, S.Binary):
            return node.op in (":", ",", " ")
        if isinstance(node, S.Call):
            return S.plain_name(node.name) == "INDEX"
        if isinstance(node, S.Name):
            tree = S.parses(self.book.names.get(node.name.upper(), ""))
            return tree is not None and node.name.upper() not in self.open_names and self.is_plain(tree)
        return False

    def grid(self, node: S.Node | None) -> Grid | Value:
        """Element by element: operators, IF and the functions of one argument spread over ranges."""
        if isinstance(node, S.Paren):
            return self.grid(node.of)
        if isinstance(node, S.Unary) and node.op in "+-%":
            return spread(lambda v: self.unary(node.op, v), self.grid(node.of))
        if isinstance(node, S.Binary) and node.op not in (":", ",", " "):
            return spread(lambda a, b: operate(node.op, a, b), self.grid(node.left), self.grid(node.right))
        if isinstance(node, S.Call):
            name = S.plain_name(node.name)
            if name == "IF" and 1 <= len(node.args) <= 3:
                parts = [self.grid(a) if a is not None else 0.0 for a in node.args]
                parts += [True, False][len(parts) - 1 :] if len(parts) < 3 else []
                return spread(choose, *parts)
            if name in ELEMENTWISE and len(node.args) == 1:
                return spread(ELEMENTWISE[name], self.grid(node.args[0]))
        x = self.operand(node)
        if isinstance(x, Rects):
            if len(x) != 1:
                return VALUE
            r = x[0]
            if r.height * r.width > 4_000_000:
                return VALUE
            if r.height == r.width == 1:
                return self.cell(r.sheet, r.r0, r.c0)
            return Grid(r.height, r.width, list(self.each(x)))
        return x

    def unary(self, op: str, v: Value) -> Value:
        if op == "+":
            return v
        if op == "%":
            return V.arithmetic("/", v, 100.0)
        n = V.number(v)
        return n if isinstance(n, Fault) else -n

    # --- arguments

    def num(self, node: S.Node | None, otherwise: float | None = None) -> float:
        if node is None and otherwise is not None:
            return otherwise
        n = V.number(self.value(node))
        if isinstance(n, Fault):
            raise Stop(n)
        return n

    def txt(self, node: S.Node | None) -> str:
        t = V.text(self.value(node))
        if isinstance(t, Fault):
            raise Stop(t)
        return t

    def yes(self, node: S.Node | None) -> bool:
        b = V.truth(self.value(node))
        if isinstance(b, Fault):
            raise Stop(b)
        return b

    def rects(self, node: S.Node | None) -> Rects:
        x = self.operand(node)
        if isinstance(x, Fault):
            raise Stop(x)
        if not isinstance(x, Rects):
            raise Stop(VALUE)
        return x

    def rect(self, node: S.Node | None) -> Rect:
        x = self.rects(node)
        if len(x) != 1:
            raise Stop(VALUE)
        return x[0]

    def numbers(self, args: list, spread_arrays: bool = False) -> Iterator[float]:
        """The numbers among arguments: in ranges only numbers count and faults stop; direct values are coerced."""
        for a in args:
            if spread_arrays and not self.is_plain(a):
                x: object = self.grid(a)
            else:
                x = self.operand(a)
            if isinstance(x, Rects | Grid):
                for v in x.values if isinstance(x, Grid) else self.each(x):
                    if isinstance(v, Fault):
                        raise Stop(v)
                    if isinstance(v, float | int) and not isinstance(v, bool):
                        yield float(v)
            else:
                n = V.number(x)
                if isinstance(n, Fault):
                    raise Stop(n)
                yield n


def stopping(f):
    """A function whose raised faults become its value."""

    def wrapped(ev, args):
        try:
            return f(ev, args)
        except Stop as s:
            return s.fault

    return wrapped


def operate(op: str, a: Value, b: Value) -> Value:
    if op == "&":
        return V.joined(a, b)
    if op in "+-*/^":
        return V.arithmetic(op, a, b)
    return V.compared(op, a, b)


def choose(c: Value, yes: Value, no: Value) -> Value:
    b = V.truth(c)
    return b if isinstance(b, Fault) else yes if b else no


def spread(f, *parts):
    shapes = {(p.height, p.width) for p in parts if isinstance(p, Grid)}
    if not shapes:
        return f(*parts)
    if len(shapes) > 1:
        return VALUE
    (h, w), = shapes
    columns = [p.values if isinstance(p, Grid) else [p] * (h * w) for p in parts]
    return Grid(h, w, [f(*vs) for vs in zip(*columns, strict=True)])


# --- aggregates


@function("SUM", least=1)
@stopping
def _sum(ev, args):
    total = 0.0
    for n in ev.numbers(args, True):
        total += n
    return V.finite(total)


@function("PRODUCT", least=1)
@stopping
def _product(ev, args):
    total = 1.0
    for n in ev.numbers(args, True):
        total *= n
    return V.finite(total)


@function("AVERAGE", least=1)
@stopping
def _average(ev, args):
    own = list(ev.numbers(args, True))
    return V.finite(_fold(own) / len(own)) if own else DIV0


def _fold(own: list[float]) -> float:
    total = 0.0
    for n in own:
        total += n
    return total


@function("COUNT", least=1)
def _count(ev, args):
    n = 0
    for a in args:
        x = ev.operand(a)
        if isinstance(x, Rects | Grid):
            n += sum(isinstance(v, float | int) and not isinstance(v, bool) for v in (x.values if isinstance(x, Grid) else ev.each(x)))
        elif not isinstance(x, Fault) and a is not None:
            n += not isinstance(V.number(x), Fault)
    return float(n)


@function("COUNTA", least=1)
def _counta(ev, args):
    n = 0
    for a in args:
        x = ev.operand(a)
        n += sum(v is not None for v in (x.values if isinstance(x, Grid) else ev.each(x))) if isinstance(x, Rects | Grid) else 1
    return float(n)


@function("COUNTBLANK", least=1, most=1)
@stopping
def _countblank(ev, args):
    return float(sum(v is None or v == "" for v in ev.each(ev.rects(args[0])) if not isinstance(v, bool)))


def _extreme(best):
    @stopping
    def run(ev, args):
        own, fault = [], None
        for a in args:
            x = ev.operand(a)
            if isinstance(x, Rects):
                for v in ev.each(x):
                    if isinstance(v, Fault):
                        fault = fault or v
                    elif isinstance(v, float | int) and not isinstance(v, bool):
                        own.append(float(v))
            else:
                n = V.number(ev.pick(x))
                if isinstance(n, Fault):
                    return n
                own.append(n)
        return fault or (best(own) if own else 0.0)

    return run


function("MIN", least=1)(_extreme(min))
function("MAX", least=1)(_extreme(max))
FUNCTIONS["MIN"], FUNCTIONS["MAX"] = (lambda f: lambda ev, a: f(ev, a) if a else VALUE)(_extreme(min)), (lambda f: lambda ev, a: f(ev, a) if a else VALUE)(_extreme(max))


@function("MEDIAN", least=1)
@stopping
def _median(ev, args):
    own = sorted(ev.numbers(args))
    if not own:
        return NUM
    m = len(own) // 2
    return own[m] if len(own) % 2 else (own[m - 1] + own[m]) / 2


def _kth(largest: bool):
    @stopping
    def run(ev, args):
        own = sorted(ev.numbers(args[:1]), reverse=largest)
        k = math.ceil(ev.num(args[1])) if len(args) > 1 else 0
        return own[k - 1] if 1 <= k <= len(own) else NUM

    return run


function("LARGE", least=2, most=2)(_kth(True))
function("SMALL", least=2, most=2)(_kth(False))


def _spread_of(sample: bool, root: bool):
    @stopping
    def run(ev, args):
        own = list(ev.numbers(args))
        n = len(own)
        if n < 1 + sample:
            return DIV0
        mean = _fold(own) / n
        square, rest = _fold([(x - mean) ** 2 for x in own]), _fold([x - mean for x in own])
        var = (square - rest * rest / n) / (n - sample)
        return V.finite(math.sqrt(max(var, 0.0)) if root else var)

    return run


for _names, _sample, _root in ((("STDEV", "STDEV.S"), 1, 1), (("STDEVP", "STDEV.P"), 0, 1), (("VAR", "VAR.S"), 1, 0), (("VARP", "VAR.P"), 0, 0)):
    function(*_names, least=1)(_spread_of(bool(_sample), bool(_root)))


@function("RANK", "RANK.EQ", least=2, most=3)
@stopping
def _rank(ev, args):
    x, own = ev.num(args[0]), list(ev.numbers(args[1:2]))
    up = len(args) > 2 and ev.num(args[2], 0.0) != 0
    return float(1 + sum(n < x if up else n > x for n in own)) if x in own else NA


#: What SUBTOTAL's codes stand for.
SUBTOTALS = ("AVERAGE", "COUNT", "COUNTA", "MAX", "MIN", "PRODUCT", "STDEV", "STDEVP", "SUM", "VAR", "VARP")


@function("SUBTOTAL", least=2)
@stopping
def _subtotal(ev, args):
    code = int(ev.num(args[0]))
    code = code - 100 if 101 <= code <= 111 else code
    return FUNCTIONS[SUBTOTALS[code - 1]](ev, args[1:]) if 1 <= code <= 11 else VALUE


@function("SUMPRODUCT", least=1)
@stopping
def _sumproduct(ev, args):
    if len(args) == 1 and not ev.is_plain(args[0]):
        x = ev.grid(args[0])
        parts = [x.values if isinstance(x, Grid) else [x]]
    else:
        rects = [ev.rect(a) for a in args]
        if len({(r.height, r.width) for r in rects}) > 1:
            return VALUE
        parts = [list(ev.each(Rects([r]))) for r in rects]
    total = 0.0
    for row in zip(*parts, strict=True):
        product = 1.0
        for v in row:
            if isinstance(v, Fault):
                return v
            product *= float(v) if isinstance(v, float | int) and not isinstance(v, bool) else 0.0
        total += product
    return V.finite(total)


# --- criteria


def _masked(ev, pairs: list) -> tuple[list[bool], tuple[int, int]]:
    if not pairs or len(pairs) % 2:
        raise Stop(VALUE)
    mask, shape = None, None
    for where, what in zip(pairs[::2], pairs[1::2], strict=True):
        r = ev.rect(where)
        own = V.criterion(ev.value(what))
        hit = [own.matches(v) for v in ev.each(Rects([r]))]
        if shape not in (None, (r.height, r.width)):
            raise Stop(VALUE)
        shape, mask = (r.height, r.width), hit if mask is None else [a and b for a, b in zip(mask, hit, strict=True)]
    return mask, shape


@function("COUNTIF", least=2, most=2)
@function("COUNTIFS", least=2)
@stopping
def _countifs(ev, args):
    return float(sum(_masked(ev, args)[0]))


def _chosen(ev, mask, shape, where: Rect) -> list[float]:
    own = Rect(where.sheet, where.r0, where.c0, where.r0 + shape[0] - 1, where.c0 + shape[1] - 1)
    return [float(v) for v, ok in zip(ev.each(Rects([own])), mask, strict=True) if ok and isinstance(v, float | int) and not isinstance(v, bool)]


def _totalled(own: list[float], mean: bool) -> Value:
    if not mean:
        return V.finite(_fold(own))
    return V.finite(_fold(own) / len(own)) if own else DIV0


def _if_one(mean: bool):
    @stopping
    def run(ev, args):
        mask, shape = _masked(ev, args[:2])
        return _totalled(_chosen(ev, mask, shape, ev.rect(args[2] if len(args) > 2 and args[2] is not None else args[0])), mean)

    return run


def _if_many(mean: bool):
    @stopping
    def run(ev, args):
        if len(args) % 2 == 0:
            return VALUE
        where = ev.rect(args[0])
        mask, shape = _masked(ev, args[1:])
        return VALUE if shape != (where.height, where.width) else _totalled(_chosen(ev, mask, shape, where), mean)

    return run


function("SUMIF", least=2, most=3)(_if_one(False))
function("AVERAGEIF", least=2, most=3)(_if_one(True))
function("SUMIFS", least=3)(_if_many(False))
function("AVERAGEIFS", least=3)(_if_many(True))

# --- lookups


def same_family(a: Value, b: Value) -> bool:
    kind = lambda v: "fault" if isinstance(v, Fault) else "blank" if v is None else V.rank(v)
    return kind(a) == kind(b)


def find(key: Value, own: list[Value], mode: int) -> int | None:
    """0: the first equal one, wildcards in text allowed; 1: the last that isn't greater; -1: the last of the first run of
    those that aren't smaller."""
    if key is None:
        key = 0.0
    if mode == 0:
        if isinstance(key, str) and V.has_wildcard(key):
            pattern = V.Criterion("wild", "=", V.glob(key.lower()))
            return next((i for i, v in enumerate(own) if isinstance(v, str) and pattern.matches(v)), None)
        return next((i for i, v in enumerate(own) if same_family(v, key) and V.compare(v, key) == 0), None)
    best = None
    for i, v in enumerate(own):
        fits = same_family(v, key) and (V.compare(v, key) <= 0 if mode > 0 else V.compare(v, key) >= 0)
        if fits:
            best = i
        elif mode < 0 and best is not None:
            break
    return best


def _table_lookup(down: bool):
    @stopping
    def run(ev, args):
        key, table = ev.value(args[0]), ev.rect(args[1])
        if isinstance(key, Fault):
            return key
        k = int(ev.num(args[2]))
        near = len(args) < 4 or (args[3] is not None and ev.yes(args[3]))
        if k < 1:
            return VALUE
        if k > (table.width if down else table.height):
            return REF
        lane = Rect(table.sheet, table.r0, table.c0, table.r1, table.c0) if down else Rect(table.sheet, table.r0, table.c0, table.r0, table.c1)
        at = find(key, list(ev.each(Rects([lane]))), 1 if near else 0)
        if at is None:
            return NA
        return ev.cell(table.sheet, table.r0 + at, table.c0 + k - 1) if down else ev.cell(table.sheet, table.r0 + k - 1, table.c0 + at)

    return run


function("VLOOKUP", least=3, most=4)(_table_lookup(True))
function("HLOOKUP", least=3, most=4)(_table_lookup(False))


@function("MATCH", least=2, most=3)
@stopping
def _match(ev, args):
    key, lane = ev.value(args[0]), ev.rect(args[1])
    if isinstance(key, Fault):
        return key
    if lane.height > 1 and lane.width > 1:
        return NA
    mode = ev.num(args[2], 0.0) if len(args) > 2 else 1.0
    at = find(key, list(ev.each(Rects([lane]))), (mode > 0) - (mode < 0))
    return NA if at is None else float(at + 1)


@function("INDEX", least=2, most=3)
@stopping
def _index(ev, args):
    r = ev.rect(args[0])
    row = int(ev.num(args[1], 0.0))
    col = int(ev.num(args[2], 0.0)) if len(args) > 2 else 0
    if len(args) == 2 and r.height == 1:
        row, col = 0, row
    if row < 0 or col < 0:
        return VALUE
    if row > r.height or col > r.width:
        return REF
    rows = (r.r0 + row - 1,) * 2 if row else (r.r0, r.r1)
    cols = (r.c0 + col - 1,) * 2 if col else (r.c0, r.c1)
    return Rects([Rect(r.sheet, rows[0], cols[0], rows[1], cols[1])])


@function("LOOKUP", least=2, most=3)
@stopping
def _lookup(ev, args):
    key, r = ev.value(args[0]), ev.rect(args[1])
    if isinstance(key, Fault):
        return key
    down = r.height >= r.width
    lane = Rect(r.sheet, r.r0, r.c0, r.r1, r.c0) if down else Rect(r.sheet, r.r0, r.c0, r.r0, r.c1)
    at = find(key, list(ev.each(Rects([lane]))), 1)
    if at is None:
        return NA
    if len(args) > 2:
        out = ev.rect(args[2])
        return ev.cell(out.sheet, out.r0 + at, out.c0) if out.height >= out.width else ev.cell(out.sheet, out.r0, out.c0 + at)
    return ev.cell(r.sheet, r.r0 + at, r.c1) if down else ev.cell(r.sheet, r.r1, r.c0 + at)


@function("CHOOSE", least=2)
@stopping
def _choose(ev, args):
    k = int(ev.num(args[0]))
    if not 1 <= k < len(args):
        return VALUE
    return 0.0 if args[k] is None else ev.operand(args[k])


@function("ROW", most=1)
@stopping
def _row(ev, args):
    return float((ev.rects(args[0])[0].r0 if args else ev.row) + 1)


@function("COLUMN", most=1)
@stopping
def _column(ev, args):
    return float((ev.rects(args[0])[0].c0 if args else ev.col) + 1)


@function("ROWS", least=1, most=1)
@stopping
def _rows(ev, args):
    return float(ev.rect(args[0]).height)


@function("COLUMNS", least=1, most=1)
@stopping
def _columns(ev, args):
    return float(ev.rect(args[0]).width)


@function("HYPERLINK", least=1, most=2)
def _hyperlink(ev, args):
    return ev.value(args[-1])


# --- logic and information


@function("IF", least=1, most=3)
@stopping
def _if(ev, args):
    if ev.yes(args[0]):
        return 0.0 if len(args) < 2 or args[1] is None else ev.operand(args[1])
    if len(args) < 3:
        return False
    return 0.0 if args[2] is None else ev.operand(args[2])


def _if_fault(which):
    def run(ev, args):
        try:
            v = ev.value(args[0])
        except Stop as s:
            v = s.fault
        if isinstance(v, Fault) and which(v):
            return "" if len(args) < 2 or args[1] is None else ev.value(args[1])
        return v

    return run


function("IFERROR", least=1, most=2)(_if_fault(lambda v: True))
function("IFNA", least=1, most=2)(_if_fault(lambda v: v == NA))


def _truths(ev, args) -> list[bool]:
    out = []
    for a in args:
        x = ev.operand(a)
        if isinstance(x, Rects | Grid):
            for v in x.values if isinstance(x, Grid) else ev.each(x):
                if isinstance(v, Fault):
                    raise Stop(v)
                if isinstance(v, bool | float | int):
                    out.append(bool(v))
        else:
            b = V.truth(x)
            if isinstance(b, Fault):
                raise Stop(b)
            out.append(b)
    if not out:
        raise Stop(VALUE)
    return out


function("AND", least=1)(stopping(lambda ev, args: all(_truths(ev, args))))
function("OR", least=1)(stopping(lambda ev, args: any(_truths(ev, args))))
function("XOR", least=1)(stopping(lambda ev, args: sum(_truths(ev, args)) % 2 == 1))
function("NOT", least=1, most=1)(stopping(lambda ev, args: not ev.yes(args[0])))


def _is_number(v: Value) -> bool:
    return isinstance(v, float | int) and not isinstance(v, bool)


INFORMATION = {
    "ISBLANK": lambda v: v is None, "ISTEXT": lambda v: isinstance(v, str), "ISNONTEXT": lambda v: not isinstance(v, str), "ISNUMBER": _is_number, "ISLOGICAL": lambda v: isinstance(v, bool),
    "ISNA": lambda v: v == NA, "ISERR": lambda v: isinstance(v, Fault) and v != NA, "ISERROR": lambda v: isinstance(v, Fault),
}


def _information(test):
    def run(ev, args):
        try:
            return test(ev.value(args[0]))
        except Stop as s:
            return test(s.fault)

    return run


for _name, _test in INFORMATION.items():
    function(_name, least=1, most=1)(_information(_test))
function("ISEVEN", least=1, most=1)(stopping(lambda ev, a: math.trunc(ev.num(a[0])) % 2 == 0))
function("ISODD", least=1, most=1)(stopping(lambda ev, a: math.trunc(ev.num(a[0])) % 2 != 0))


def n_of(v: Value) -> Value:
    return v if isinstance(v, Fault) else float(v) if isinstance(v, bool | float | int) else 0.0


def t_of(v: Value) -> Value:
    return v if isinstance(v, Fault | str) else ""


function("N", least=1, most=1)(lambda ev, a: n_of(ev.value(a[0])))
function("T", least=1, most=1)(lambda ev, a: t_of(ev.value(a[0])))
FUNCTIONS["TRUE"] = lambda ev, a: NAME if a else True
FUNCTIONS["FALSE"] = lambda ev, a: NAME if a else False
FUNCTIONS["PI"] = lambda ev, a: NAME if a else math.pi

# --- text


def trimmed(t: str) -> str:
    return " ".join(x for x in t.split(" ") if x)


def proper(t: str) -> str:
    out, up = "", True
    for c in t:
        out += (c.upper() if up else c.lower()) if c.isalpha() else c
        up = not c.isalpha()
    return out


def valued(v: Value) -> Value:
    return VALUE if isinstance(v, bool) else V.number(v)


@function("LEFT", least=1, most=2)
@stopping
def _left(ev, a):
    t, n = ev.txt(a[0]), int(ev.num(a[1], 0.0)) if len(a) > 1 else 1
    return VALUE if n < 0 else t[:n]


@function("RIGHT", least=1, most=2)
@stopping
def _right(ev, a):
    t, n = ev.txt(a[0]), int(ev.num(a[1], 0.0)) if len(a) > 1 else 1
    return VALUE if n < 0 else t[max(0, len(t) - n) :]


@function("MID", least=3, most=3)
@stopping
def _mid(ev, a):
    t, start, n = ev.txt(a[0]), int(ev.num(a[1])), int(ev.num(a[2]))
    return VALUE if start < 1 or n < 0 else t[start - 1 : start - 1 + n]


for _name, _f in (("LOWER", str.lower), ("UPPER", str.upper), ("PROPER", proper), ("TRIM", trimmed), ("LEN", lambda t: float(len(t)))):
    function(_name, least=1, most=1)(stopping(lambda ev, a, f=_f: f(ev.txt(a[0]))))


@function("SUBSTITUTE", least=3, most=4)
@stopping
def _substitute(ev, a):
    t, old, new = (ev.txt(x) for x in a[:3])
    if len(a) < 4:
        return t.replace(old, new) if old else t
    k = int(ev.num(a[3]))
    if k < 1:
        return VALUE
    parts = t.split(old) if old else [t]
    return t if len(parts) <= k else old.join(parts[:k]) + new + old.join(parts[k:])


@function("REPLACE", least=4, most=4)
@stopping
def _replace(ev, a):
    t, start, n, new = ev.txt(a[0]), int(ev.num(a[1])), int(ev.num(a[2])), ev.txt(a[3])
    return VALUE if start < 1 or n < 0 else t[: start - 1] + new + t[start - 1 + n :]


function("CONCATENATE", "CONCAT", least=1)(stopping(lambda ev, a: "".join(ev.txt(x) for x in a)))


@function("TEXTJOIN", least=3)
@stopping
def _textjoin(ev, a):
    between, skip = ev.txt(a[0]), True if a[1] is None else ev.yes(a[1])
    own = []
    for x in a[2:]:
        found = ev.operand(x)
        for v in ev.each(found) if isinstance(found, Rects) else found.values if isinstance(found, Grid) else [found]:
            t = V.text(v)
            if isinstance(t, Fault):
                return t
            if t or not skip:
                own.append(t)
    return between.join(own)


def _around(after: bool):
    @stopping
    def run(ev, a):
        t, d, k = ev.txt(a[0]), ev.txt(a[1]), int(ev.num(a[2], 1.0)) if len(a) > 2 else 1
        if not d or not k:
            return VALUE
        parts = t.split(d)
        at = k if k > 0 else len(parts) + k
        if not 0 < at < len(parts):
            return NA
        return d.join(parts[at:]) if after else d.join(parts[:at])

    return run


function("TEXTAFTER", least=2, most=3)(_around(True))
function("TEXTBEFORE", least=2, most=3)(_around(False))
function("VALUE", least=1, most=1)(lambda ev, a: valued(ev.value(a[0])))
function("EXACT", least=2, most=2)(stopping(lambda ev, a: ev.txt(a[0]) == ev.txt(a[1])))


@function("FIND", least=2, most=3)
@stopping
def _find(ev, a):
    needle, hay, start = ev.txt(a[0]), ev.txt(a[1]), int(ev.num(a[2], 1.0)) if len(a) > 2 else 1
    if not 1 <= start <= len(hay) + 1:
        return VALUE
    at = hay.find(needle, start - 1)
    return VALUE if at < 0 else float(at + 1)


@function("SEARCH", least=2, most=3)
@stopping
def _search(ev, a):
    import re

    pattern, hay, start = ev.txt(a[0]).lower(), ev.txt(a[1]).lower(), int(ev.num(a[2], 1.0)) if len(a) > 2 else 1
    if not 1 <= start <= len(hay) + 1:
        return VALUE
    m = re.compile(V.glob(pattern), re.S).search(hay, start - 1)
    return VALUE if m is None else float(m.start() + 1)


@function("REPT", least=2, most=2)
@stopping
def _rept(ev, a):
    t, n = ev.txt(a[0]), int(ev.num(a[1]))
    return VALUE if n < 0 or len(t.encode()) * n > 131068 else t * n


@function("CHAR", least=1, most=1)
@stopping
def _char(ev, a):
    n = int(ev.num(a[0]))
    return chr(n) if 1 <= n <= 255 else VALUE


@function("CODE", least=1, most=1)
@stopping
def _code(ev, a):
    t = ev.txt(a[0])
    return float(ord(t[0])) if t else VALUE


# --- dates


@function("DATE", least=3, most=3)
@stopping
def _date(ev, a):
    y, m, d = (math.trunc(ev.num(x)) for x in a)
    y += 1900 if 0 <= y < 1900 else 0
    if not 1900 <= y <= 9999 or abs(m) > 10**6 or abs(d) > 10**7:
        return NUM
    n = V.serial(y, m, 1) + d - 1
    if m != 1 or d != 1:
        n = V.serial(y, m, d)
    n -= V.EPOCH_1904 if ev.book.epoch_1904 else 0
    return NUM if n < 0 else float(n)


@function("TIME", least=3, most=3)
@stopping
def _time(ev, a):
    h, m, s = (math.trunc(ev.num(x)) for x in a)
    seconds = h * 3600 + m * 60 + s
    return NUM if seconds < 0 else seconds % 86400 / 86400


def _of_date(k: int):
    @stopping
    def run(ev, a):
        n = math.floor(ev.num(a[0]))
        if n < 0:
            return NUM
        return float(V.parts_of_serial(n + (V.EPOCH_1904 if ev.book.epoch_1904 else 0))[k])

    return run


def _of_time(f):
    @stopping
    def run(ev, a):
        n = ev.num(a[0])
        return NUM if n < 0 else float(f(math.floor((n - math.floor(n)) * 86400 + 0.5) % 86400))

    return run


for _k, _name in enumerate(("YEAR", "MONTH", "DAY")):
    function(_name, least=1, most=1)(_of_date(_k))
for _name, _f in (("HOUR", lambda s: s // 3600), ("MINUTE", lambda s: s // 60 % 60), ("SECOND", lambda s: s % 60)):
    function(_name, least=1, most=1)(_of_time(_f))
function("DAYS", least=2, most=2)(stopping(lambda ev, a: float(math.trunc(ev.num(a[0])) - math.trunc(ev.num(a[1])))))

#: WEEKDAY's types: which day of the week (Sunday 0) counts first, and its number.
WEEK_TYPES = {1: (0, 1), 17: (0, 1), 2: (1, 1), 11: (1, 1), 3: (1, 0)}


@function("WEEKDAY", least=1, most=2)
@stopping
def _weekday(ev, a):
    n, kind = math.floor(ev.num(a[0])), int(ev.num(a[1], 1.0)) if len(a) > 1 else 1
    if n < 0 or kind not in WEEK_TYPES:
        return NUM
    first, base = WEEK_TYPES[kind]
    return float((n - 1 + (V.EPOCH_1904 if ev.book.epoch_1904 else 0) - first) % 7 + base)


# --- mathematics


def _math(f):
    @stopping
    def run(ev, a):
        try:
            out = f(*(ev.num(x) for x in a))
        except (OverflowError, ValueError):
            return NUM
        return out if isinstance(out, Fault) else V.finite(float(out))

    return run


MATH1: dict[str, Callable[[float], float | Fault]] = {
    "ABS": abs, "INT": math.floor, "SIGN": lambda x: (x > 0) - (x < 0), "SQRT": math.sqrt, "EXP": math.exp, "LN": math.log, "LOG10": math.log10, "SIN": math.sin, "COS": math.cos, "TAN": math.tan,
    "ASIN": math.asin, "ACOS": math.acos, "ATAN": math.atan, "RADIANS": math.radians, "DEGREES": math.degrees, "ERFC": math.erfc, "ERFC.PRECISE": math.erfc, "NORMSDIST": lambda z: 0.5 * math.erfc(-z / math.sqrt(2)),
    "EVEN": lambda x: math.copysign(2 * math.ceil(abs(x) / 2), x), "ODD": lambda x: math.copysign(max(1, 2 * math.ceil((abs(x) - 1) / 2) + 1), x),
}
for _name, _f in MATH1.items():
    function(_name, least=1, most=1)(_math(_f))


def logarithm(x: float, b: float = 10.0) -> float | Fault:
    return NUM if x <= 0 or b <= 0 or b == 1 else math.log10(x) if b == 10 else math.log(x) / math.log(b)


def modulo(n: float, d: float) -> float | Fault:
    return DIV0 if d == 0 else n - d * math.floor(n / d)


def floor_to(x: float, s: float = 1.0) -> float | Fault:
    return 0.0 if x == 0 and s == 0 else DIV0 if s == 0 else NUM if x > 0 > s else math.floor(x / s) * s


def ceiling_to(x: float, s: float = 1.0) -> float | Fault:
    return 0.0 if s == 0 else NUM if x > 0 > s else math.ceil(x / s) * s


for _names, _f, _least, _most in (
    (("ROUND",), lambda x, d: V.rounded(x, int(d)), 2, 2), (("ROUNDUP",), lambda x, d: V.scaled(x, int(d), True), 2, 2), (("ROUNDDOWN",), lambda x, d: V.scaled(x, int(d), False), 2, 2),
    (("TRUNC",), lambda x, d=0.0: V.scaled(x, int(d), False), 1, 2), (("LOG",), logarithm, 1, 2), (("POWER",), V.power, 2, 2), (("MOD",), modulo, 2, 2),
    (("FLOOR", "FLOOR.MATH"), floor_to, 1, 2), (("CEILING", "CEILING.MATH"), ceiling_to, 1, 2), (("ATAN2",), lambda x, y: DIV0 if x == y == 0 else math.atan2(y, x), 2, 2),
    (("ERF",), lambda lo, hi=None: math.erf(lo) if hi is None else math.erf(hi) - math.erf(lo), 1, 2),
):
    function(*_names, least=_least, most=_most)(_math(_f))


def density(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


@function("NORMDIST", "NORM.DIST", least=4, most=4)
@stopping
def _normdist(ev, a):
    x, m, s = (ev.num(v) for v in a[:3])
    if s <= 0:
        return NUM
    z = (x - m) / s
    return 0.5 * math.erfc(-z / math.sqrt(2)) if ev.yes(a[3]) else density(z) / s


@function("NORM.S.DIST", least=1, most=2)
@stopping
def _norm_s_dist(ev, a):
    z = ev.num(a[0])
    return 0.5 * math.erfc(-z / math.sqrt(2)) if len(a) < 2 or ev.yes(a[1]) else density(z)


def _abs(v: Value) -> Value:
    n = V.number(v)
    return n if isinstance(n, Fault) else abs(n)


def _not(v: Value) -> Value:
    b = V.truth(v)
    return b if isinstance(b, Fault) else not b


def _on_text(f):
    def run(v: Value) -> Value:
        t = V.text(v)
        return t if isinstance(t, Fault) else f(t)

    return run


#: What spreads over arrays by itself.
ELEMENTWISE: dict[str, Callable[[Value], Value]] = INFORMATION | {
    "NOT": _not, "ABS": _abs, "N": n_of, "T": t_of, "VALUE": valued, "TRIM": _on_text(trimmed), "LEN": _on_text(lambda t: float(len(t))), "UPPER": _on_text(str.upper), "LOWER": _on_text(str.lower),
}

ordering = cmp_to_key(lambda a, b: V.compare(a, b))


def evaluate(book: Workbook, source: str, sheet: int = 0, row: int = 99, col: int = 99) -> Value:
    return Evaluator(book, sheet, row, col).formula(S.parse(source))
