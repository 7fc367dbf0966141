"""Models swept over scenarios: Monte Carlo, what-if, response curves, sensitivities and goal seek.

The planner works on one workbook: which cells the inputs reach, and in which order. A sweep is then ``spark.range`` over
scenarios; each Arrow batch is a tile that a numpy kernel carries through the cells, and results leave as columns. A tile's
arrays are dropped when their last reader is done, so memory is bounded by the model's width and not by its length. Cells
that have no vector form, or whose values leave the plain numbers in some scenario, are evaluated one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import values as V
from gridloom.functions.random import Distribution
from gridloom.functions.values import Fault, Value
from gridloom.operators import ordered
from gridloom.plans import syntax as S
from gridloom.plans.graph import Cell, Graph
from gridloom.plans.interp import Evaluator, Rects
from gridloom.plans.workbook import Workbook

#: Scenarios in a tile, and outputs that are watched where none are named.
TILE, SINKS = 8192, 12
SWEPT = "scenario long, cell string, value double, text string, error string"


class NoVector(Exception):
    """A cell or its values have no vector form."""


def cell_id(book: Workbook, cell: Cell) -> str:
    return f"{book.sheets[cell[0]].name}!{S.cell_name(cell[1], cell[2])}"


def cell_of(book: Workbook, name: str) -> Cell:
    """From Sheet!A1, or A1 on the first sheet."""
    sheet, mark, at = name.rpartition("!")
    found = S.as_cell(at.replace("$", ""))
    index = book.index(sheet.strip("'")) if mark else 0
    if found is None or index is None:
        raise ValueError(f"no cell {name!r}")
    return index, found[0].at, found[1].at


@dataclass
class Plan:
    """What a sweep computes: inputs, the cone's cells in order, the watched ones, and those in cycles, which keep their
    stored values."""

    book: Workbook
    inputs: list[Cell]
    order: list[Cell]
    watch: list[Cell]
    circular: list[Cell] = field(default_factory=list)
    last_use: dict[Cell, int] = field(default_factory=dict)


def prepare(book: Workbook, inputs: list[Cell], watch: list[Cell] | None = None, graph: Graph | None = None) -> Plan:
    graph = graph or Graph(book)
    cone = graph.cone(inputs)
    levels, circular = graph.levels(cone)
    order = [c for level in levels for c in level]
    if watch is None:  # what nothing else reads, the deepest first
        depth = {c: i for i, level in enumerate(levels) for c in level}
        sinks = [c for c in order if not (graph.readers(c) & cone)]
        watch = sorted(sinks, key=lambda c: (depth[c], c))[-SINKS:]
    last_use: dict[Cell, int] = {}
    place = {c: i for i, c in enumerate(order)}
    for c in [*inputs, *order]:
        last_use[c] = max((place[r] for r in graph.readers(c) if r in place), default=-1)
    return Plan(book, inputs, order, watch, sorted(circular), last_use)


# --- the kernel


class Tile:
    """Carries arrays of scenario values through a plan's cells."""

    def __init__(self, plan: Plan, size: int):
        self.plan, self.book, self.size = plan, plan.book, size
        self.held: dict[Cell, np.ndarray | list[Value]] = {}
        self.slow = 0

    def static(self, cell: Cell) -> Value:
        return self.book.sheets[cell[0]].values.get(cell[1:])

    def run(self, given: dict[Cell, np.ndarray], keep: set[Cell] | None = None) -> dict[Cell, np.ndarray | list[Value]]:
        self.held = dict(given)
        wanted = set(self.plan.watch) if keep is None else keep
        done = [(use, c) for c, use in self.plan.last_use.items() if c not in wanted]
        free: dict[int, list[Cell]] = {}
        for use, c in done:
            free.setdefault(use, []).append(c)
        for i, cell in enumerate(self.plan.order):
            self.held[cell] = self.cell(cell)
            for c in free.get(i, ()) if keep is None else ():
                self.held.pop(c, None)
        return self.held

    def cell(self, cell: Cell) -> np.ndarray | list[Value]:
        tree = S.parses(self.book.sheets[cell[0]].formulas[cell[1:]])
        if tree is None:
            return [V.NAME] * self.size
        try:
            with np.errstate(all="ignore"):
                v = np.asarray(self.vector(tree, cell), float)
            if not np.isfinite(v).all():
                raise NoVector
            return np.broadcast_to(v, (self.size,)).copy() if v.shape != (self.size,) else v
        except NoVector:
            self.slow += 1
            return self.one_by_one(tree, cell)

    def one_by_one(self, tree: S.Node, cell: Cell) -> np.ndarray | list[Value]:
        out: list[Value] = []
        for k in range(self.size):

            def overlay(s: int, r: int, c: int, k=k):
                own = self.held.get((s, r, c), Ellipsis)
                if own is Ellipsis:
                    return own
                v = own[k]
                return float(v) if isinstance(v, np.floating) else v

            out.append(Evaluator(self.book, *cell, overlay=overlay).formula(tree))
        if all(isinstance(v, float) for v in out):
            return np.array(out)
        return out

    def lookup(self, cell: Cell) -> np.ndarray | float:
        own = self.held.get(cell)
        if own is not None:
            if isinstance(own, list):
                raise NoVector
            return own
        v = self.static(cell)
        if v is None:
            return 0.0
        if isinstance(v, float) and not isinstance(v, bool):
            return v
        raise NoVector

    def vector(self, node: S.Node, at: Cell):
        """A node's values for all scenarios; plain numbers only."""
        match node:
            case S.Number():
                return node.value
            case S.Paren():
                return self.vector(node.of, at)
            case S.Ref():
                found = Evaluator(self.book, *at).resolve(node)
                if not isinstance(found, Rects) or len(found) != 1 or found[0].height != 1 or found[0].width != 1:
                    raise NoVector
                return self.lookup((found[0].sheet, found[0].r0, found[0].c0))
            case S.Unary() if node.op in "+-%":
                x = self.vector(node.of, at)
                return x if node.op == "+" else -x if node.op == "-" else x / 100.0
            case S.Binary() if node.op in ("+", "-", "*", "/"):
                return self.arithmetic(node.op, self.vector(node.left, at), self.vector(node.right, at))
            case S.Name():
                body = S.parses(self.book.names.get(node.name.upper(), ""))
                if body is None or isinstance(body, S.Name):
                    raise NoVector
                return self.vector(body, at)
            case S.Call() if S.plain_name(node.name) == "SUM" and node.args:
                total = 0.0
                for x in self.each(node.args, at):
                    total = total + x  # in the order of the cells, as the cell plane adds
                return total
            case S.Call() if S.plain_name(node.name) in ("MIN", "MAX") and node.args:
                own = list(self.each(node.args, at))
                fold = np.minimum if S.plain_name(node.name) == "MIN" else np.maximum
                if not own:
                    return 0.0
                out = own[0]
                for x in own[1:]:
                    out = fold(out, x)
                return out
            case S.Call() if S.plain_name(node.name) == "ABS" and len(node.args) == 1 and node.args[0] is not None:
                return np.abs(self.vector(node.args[0], at))
            case S.Call() if S.plain_name(node.name) == "IF" and len(node.args) == 3 and None not in node.args:
                return np.where(self.test(node.args[0], at), self.vector(node.args[1], at), self.vector(node.args[2], at))
        raise NoVector

    def test(self, node: S.Node, at: Cell):
        while isinstance(node, S.Paren):
            node = node.of
        if isinstance(node, S.Binary) and node.op in ("=", "<>", "<", "<=", ">", ">="):
            a, b = self.vector(node.left, at), self.vector(node.right, at)
            return {"=": np.equal, "<>": np.not_equal, "<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}[node.op](a, b)
        return np.asarray(self.vector(node, at)) != 0

    def arithmetic(self, op: str, a, b):
        if op == "/" and np.any(np.asarray(b) == 0):
            raise NoVector
        out = a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else np.true_divide(a, b)
        if not np.all(np.isfinite(out)):
            raise NoVector
        return out

    def each(self, args: list, at: Cell):
        own = Evaluator(self.book, *at)
        for a in args:
            if a is None:
                raise NoVector
            if not own.is_plain(a):
                yield self.vector(a, at)
                continue
            found = own.operand(a) if not isinstance(a, S.Call) else None
            if not isinstance(found, Rects):
                raise NoVector
            for r in found:
                for row, col in own.positions(r):
                    cell = (r.sheet, row, col)
                    if cell in self.held:
                        yield self.lookup(cell)
                        continue
                    v = self.static(cell)
                    if isinstance(v, Fault):
                        raise NoVector
                    if isinstance(v, float) and not isinstance(v, bool):
                        yield v


def results(plan: Plan, scenarios: np.ndarray, held: dict) -> pa.RecordBatch:
    """The watched cells as rows of SWEPT."""
    n, out = len(scenarios), {k: [] for k in ("scenario", "cell", "value", "text", "error")}
    for c in plan.watch:
        own = held.get(c)
        if own is None:
            v = plan.book.sheets[c[0]].values.get(c[1:])
            own = [0.0 if v is None else v] * n
        values = [float(x) if isinstance(x, float | np.floating) else float(x) if isinstance(x, bool) else None for x in own]
        out["scenario"].append(pa.array(scenarios, pa.int64()))
        out["cell"].append(pa.array([cell_id(plan.book, c)] * n, pa.string()))
        out["value"].append(pa.array(values, pa.float64()))
        out["text"].append(pa.array([x if isinstance(x, str) else None for x in own], pa.string()))
        out["error"].append(pa.array([x.code if isinstance(x, Fault) else None for x in own], pa.string()))
    return pa.RecordBatch.from_pydict({k: pa.concat_arrays(v) if v else pa.array([], {"scenario": pa.int64(), "value": pa.float64()}.get(k, pa.string())) for k, v in out.items()})


def swept(spark: SparkSession, plan: Plan, n: int, given: Callable[[np.ndarray], dict[Cell, np.ndarray]], tile: int = TILE) -> DataFrame:
    """Rows of SWEPT for scenarios 0..n-1, whose inputs ``given`` makes from their numbers."""
    import pyarrow.compute as pc

    def step(batches):
        for batch in batches:
            column = batch.column(0)
            for at in range(0, len(column), tile):
                k = np.asarray(pc.cast(column.slice(at, tile), pa.int64()))
                yield results(plan, k, Tile(plan, len(k)).run(given(k)))

    return spark.range(n).mapInArrow(step, SWEPT)


def sampler(inputs: list[tuple[Cell, Distribution]], seed: int) -> Callable[[np.ndarray], dict[Cell, np.ndarray]]:
    """Draws by the inputs' places in the list: another order of inputs gives other draws."""
    return lambda k: {cell: d.sample(seed, i, k) for i, (cell, d) in enumerate(inputs)}


def monte_carlo(spark: SparkSession, book: Workbook, inputs: list[tuple[Cell, Distribution]], n: int, seed: int = 1, watch: list[Cell] | None = None) -> DataFrame:
    plan = prepare(book, [c for c, _ in inputs], watch)
    return swept(spark, plan, n, sampler(inputs, seed))


def scenario(book: Workbook, inputs: list[tuple[Cell, Distribution]], k: int, seed: int = 1, watch: list[Cell] | None = None) -> dict[Cell, Value]:
    """One scenario alone; the same values as in a sweep."""
    plan = prepare(book, [c for c, _ in inputs], watch)
    held = Tile(plan, 1).run(sampler(inputs, seed)(np.array([k])))
    return {c: held[c][0] for c in plan.watch if c in held}


def what_if(book: Workbook, values: dict[Cell, float], watch: list[Cell] | None = None) -> dict[Cell, Value]:
    """The watched cells with explicit inputs."""
    plan = prepare(book, list(values), watch)
    held = Tile(plan, 1).run({c: np.array([float(v)]) for c, v in values.items()})
    return {c: held[c][0] if c in held else plan.book.sheets[c[0]].values.get(c[1:]) for c in plan.watch}


def curve(spark: SparkSession, book: Workbook, cell: Cell, low: float, high: float, steps: int = 81, watch: list[Cell] | None = None) -> DataFrame:
    """x, cell, value: the watched cells along an input; values that aren't numbers are left out."""
    steps = max(2, min(201, steps))
    plan = prepare(book, [cell], watch)
    x = lambda k: low + (high - low) * k / (steps - 1)
    out = swept(spark, plan, steps, lambda k: {cell: x(k.astype(float))})
    return out.where("value is not null").select((F.lit(float(low)) + F.lit(float(high - low)) * F.col("scenario") / (steps - 1)).alias("x"), "cell", "value")


def tornado(spark: SparkSession, book: Workbook, candidates: list[Cell], output: Cell, share: float = 0.1, top: int = 10) -> DataFrame:
    """input, low, high, swing: the output with each candidate down and up by a share, by swing; what doesn't move it is
    left out."""
    base = {c: book.sheets[c[0]].values[c[1:]] for c in candidates}
    plan = prepare(book, candidates, [output])
    factor = np.array([1 - share, 1 + share])

    def given(k: np.ndarray) -> dict[Cell, np.ndarray]:
        return {c: base[c] * np.where(k // 2 == i, factor[k % 2], 1.0) for i, c in enumerate(candidates)}

    rows = swept(spark, plan, 2 * len(candidates), given).where("value is not null")
    names = F.array(*(F.lit(cell_id(book, c)) for c in candidates))
    own = rows.groupBy(F.floor(F.col("scenario") / 2).alias("i")).agg(F.max(F.when(F.col("scenario") % 2 == 0, F.col("value"))).alias("low"), F.max(F.when(F.col("scenario") % 2 == 1, F.col("value"))).alias("high"))
    own = own.withColumn("swing", F.abs(F.col("high") - F.col("low"))).where("swing >= 1e-12")
    return own.select(F.element_at(names, (F.col("i") + 1).cast("int")).alias("input"), "low", "high", "swing").orderBy(F.desc("swing"), "input").limit(top)


def goal_seek(spark: SparkSession, book: Workbook, cell: Cell, output: Cell, target: float, low: float, high: float, steps: int = 81, rounds: int = 60) -> float | None:
    """An input value that gives the target: the first change of sign between neighbours of a curve, then bisection."""
    points = [(r["x"], r["value"] - target) for r in curve(spark, book, cell, low, high, steps, [output]).orderBy("x").collect()]
    grid = (high - low) / (max(2, min(201, steps)) - 1)
    for (a, fa), (b, fb) in zip(points, points[1:], strict=False):
        if fa == 0:
            return a
        if b - a > grid * 1.5 or (fa < 0) == (fb < 0) and fb != 0:
            continue
        for _ in range(rounds):
            m = (a + b) / 2
            v = what_if(book, {cell: m}, [output])[output]
            if not isinstance(v, float | np.floating):
                return None
            fm = float(v) - target
            if abs(fm) <= 1e-13 * max(1.0, abs(target)) or b - a <= 1e-13 * max(1.0, abs(m)):
                return m
            a, fa, b = (m, fm, b) if (fm < 0) == (fa < 0) else (a, fa, m)
        return (a + b) / 2
    return None


def interpolated(points: list[tuple[float, float]], x: float) -> float:
    """A slider's value on a curve: straight between points, level beyond the ends."""
    xs, ys = zip(*sorted(points), strict=True)
    return float(np.interp(x, xs, ys))


def slider(current: float) -> tuple[float, float]:
    """The range a slider spans: half the value either way, five near zero."""
    return (current - 5, current + 5) if abs(current) < 1e-9 else tuple(sorted((current * 0.5, current * 1.5)))


# --- statistics of a sweep


def statistics(rows: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """n, mean, sd (of the population), and quantiles p5, p50, p95: the value at place floor((n - 1) p) in order."""
    by = by or []
    own = rows.where(F.col(value).isNotNull()).select(*by, value)
    placed = ordered.numbered(own, by, value, "_k", "_n")
    at = lambda p: F.max(F.when(F.col("_k") == F.floor((F.col("_n") - 1) * p), F.col(value)))
    quantiles = [at(p).alias(name) for name, p in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))]
    found = placed.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), *quantiles)
    return found if by else found.where("n > 0")


def histogram(rows: DataFrame, value: str = "value", bins: int = 40) -> DataFrame:
    """bin, low, high, n, share and cumulative share over equal bins between the least and the greatest value."""
    own = rows.where(F.col(value).isNotNull())
    ends = own.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(1.0)
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counts = own.crossJoin(ends).groupBy(at.alias("bin"), "_lo", "_hi", "_n").agg(F.count("*").alias("n"))
    every = own.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(ends)
    full = every.join(counts.select("bin", "n"), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as bins
    return full.select("bin", (F.col("_lo") + F.col("bin") * width).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "n", (F.sum("n").over(order) / F.col("_n")).alias("cumulative"))


def moves(plan: Plan, n: int, tile: int = TILE) -> dict[str, float]:
    """What a sweep writes and reads, in bytes: a double for each cone cell and input and scenario."""
    per = 8 * (len(plan.order) + len(plan.inputs))
    live = 8 * tile * (len(plan.order) + len(plan.inputs))
    return {"bytes_per_scenario": per, "bytes": per * n, "peak_tile_bytes": live}


def finite_difference(book: Workbook, cell: Cell, output: Cell, h: float | None = None) -> float:
    """A central difference of the output by an input."""
    x = book.sheets[cell[0]].values[cell[1:]]
    h = h or max(1e-6, abs(x) * 1e-6)
    up, down = (float(what_if(book, {cell: x + d}, [output])[output]) for d in (h, -h))
    return (up - down) / (2 * h)

