"""Draws, sweeps, sensitivities, gradients, differences, dependency order and streamed edits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import random as R
from gridloom.operators import diff, gradients, scenario
from gridloom.operators.ordered import ordered_sum, with_positions
from gridloom.plans import graph
from gridloom.plans.interp import Evaluator
from gridloom.plans.syntax import parse
from gridloom.streaming.edits import LiveModel, follow
from tests.books import book, chain

A1, KINDS = (0, 0, 0), ("normal(3,2)", "lognormal(0.2,0.5)", "uniform(-1,5)", "triangular(1,4,11)", "pert(1,4,11)")


def test_philox_is_the_published_generator():
    assert [int(x[0]) for x in R.philox([np.zeros(1, np.uint64)] * 4, 0)] == [0x6627E8D5, 0xE169C58D, 0xBC57AC4C, 0x9B00DBD8]
    full = np.full(1, 0xFFFFFFFF, np.uint64)
    assert [int(x[0]) for x in R.philox([full] * 4, 0xFFFFFFFFFFFFFFFF)] == [0x408F276D, 0x41C83B0E, 0xA20BC7C6, 0x6D5451FD]


def test_inverse_normal():
    assert R.inverse_normal(np.array([0.5, 0.975, 0.025])) == pytest.approx([0, 1.959963984540054, -1.959963984540054], abs=1e-12)
    assert R.inverse_normal(np.array([0.999999]))[0] == pytest.approx(4.753424308822899, abs=1e-9) and R.inverse_normal(np.array([1e-12]))[0] < -6.9


@pytest.mark.parametrize("text", KINDS)
def test_moments(text):
    d, n = R.parse_distribution(text), 400_000
    x = d.sample(7, 1, np.arange(n))
    assert abs(x.mean() - d.mean()) < 5 * np.sqrt(d.variance() / n) and x.var() == pytest.approx(d.variance(), rel=0.02)
    assert d.sample(7, 1, np.array([123]))[0] == x[123]


def test_distribution_texts():
    assert R.parse_distribution("5") == R.Distribution("point", (5.0,)) and R.parse_distribution("uniform(5,1)").p == (1.0, 5.0)
    for bad in ("normal(1)", "gauss(1,2)", "triangular(3,2,1)", "x"):
        with pytest.raises(ValueError):
            R.parse_distribution(bad)


def test_columns_draw_what_arrays_draw(spark):
    df = R.with_uniform(spark.range(500), "id", (7 << 32) | 42, 3, "u")
    got = np.array([r["u"] for r in df.orderBy("id").collect()])
    assert np.array_equal(got, R.uniforms((7 << 32) | 42, 3, np.arange(500))[0])
    for text in KINDS[:4]:
        d = R.parse_distribution(text)
        x = np.array([r[0] for r in df.orderBy("id").select(d.column(F.col("u"))).collect()])
        assert x == pytest.approx(d.sample((7 << 32) | 42, 3, np.arange(500)), rel=1e-12)


def test_cones_and_levels():
    own = graph.Graph(chain(20))
    cone = own.cone([A1])
    assert len(cone) == 20 and [len(x) for x in own.levels(cone)[0]] == [1] * 20
    loop = graph.Graph(book({"A1": 1, "B1": "=A1+C1", "C1": "=B1", "D1": "=C1", "E1": "=A1"}, evaluate=False))
    levels, circular = loop.levels(loop.cone([A1]))
    assert levels == [[(0, 0, 4)]] and circular == {(0, 0, 1), (0, 0, 2), (0, 0, 3)}


@pytest.mark.parametrize(("edges", "want"), [
    ({1: [2], 2: [3], 3: []}, [[3], [2], [1]]), ({1: [2], 2: [1]}, [[1, 2]]), ({1: [1]}, [[1]]), ({1: [2], 2: [3], 3: [1, 4], 4: [5], 5: [4]}, [[4, 5], [1, 2, 3]]), ({1: [2, 3], 2: [4], 3: [4], 4: []}, [[4], [2], [3], [1]]),
])
def test_strong_components(edges, want):
    assert graph.strong_components(edges) == want


def test_long_chains_have_components():
    n = 300_000
    assert len(graph.strong_components({i: [i + 1] if i < n else [] for i in range(n + 1)})) == n + 1
    assert graph.is_cyclic([1], {1: [1]}) and not graph.is_cyclic([1], {1: [2]})


def plain(own, cell):
    return Evaluator(own, *cell).formula(parse(own.sheets[cell[0]].formulas[cell[1:]]))


def test_one_scenario_is_the_cell_plane():
    own = book({**{f"A{r}": r * 1.1 for r in range(1, 21)}, "B1": "=A1*2", **{f"B{r}": f"=A{r}*2+B{r - 1}" for r in range(2, 21)}, "B21": "=SUM(B1:B20)", "B22": "=ROUND(B21,4)", "C1": '=IF(A1>5,"big",A1/0)', "C2": "=IF(A1>0,B1,B2)", "C3": "=MAX(A1:A3,B1)"})
    cells = [(0, r, c) for r, c in own.sheets[0].formulas]
    got = scenario.what_if(own, {A1: 1.1}, cells)
    assert {c: v for c, v in got.items()} == {c: plain(own, c) for c in cells}


def test_sweep(spark):
    own = chain(20)
    inputs = [(A1, R.parse_distribution("normal(10,2)")), ((0, 4, 0), R.parse_distribution("uniform(0,1)"))]
    out = scenario.monte_carlo(spark, own, inputs, 3000, 99, [(0, 19, 1)]).persist()
    assert out.count() == 3000 and out.where("value is null").count() == 0
    for k in (0, 1, 2999):
        assert out.where(f"scenario = {k}").first()["value"] == scenario.scenario(own, inputs, k, 99, [(0, 19, 1)])[0, 19, 1]
    values = np.sort([r["value"] for r in out.collect()])
    s = scenario.statistics(out).first()
    assert (s["n"], s["p5"], s["p50"], s["p95"]) == (3000, values[149], values[1499], values[2849]) and s["sd"] == pytest.approx(values.std())
    assert scenario.statistics(out, by=["cell"]).first()["p95"] == values[2849]
    bins = scenario.histogram(out).orderBy("bin").collect()
    assert [r["n"] for r in bins] == np.histogram(values, 40)[0].tolist() and bins[-1]["cumulative"] == 1
    assert scenario.moves(scenario.prepare(own, [A1]), 10)["bytes_per_scenario"] == 8 * 21


def test_faults_and_text_in_sweeps(spark):
    own = book({"A1": 1, "B1": "=1/(A1-5)", "B2": '=IF(A1>5,"hi","lo")', "B3": "=IFERROR(B1,0)"})
    plan = scenario.prepare(own, [A1], [(0, 0, 1), (0, 1, 1), (0, 2, 1)])
    rows = scenario.swept(spark, plan, 11, lambda k: {A1: k.astype(float)}).where("scenario = 5").orderBy("cell").collect()
    assert [(r["cell"], r["value"], r["text"], r["error"]) for r in rows] == [("S!B1", None, None, "#DIV/0!"), ("S!B2", None, "lo", None), ("S!B3", 0.0, None, None)]
    assert [scenario.cell_id(own, c) for c in scenario.prepare(own, [A1]).watch] == ["S!B2", "S!B3"]


def test_curves_and_goal_seek(spark):
    own = book({"A1": 2, "A2": 3, "B1": "=A1*A1-A2", "B2": "=A1*0"})
    points = [(r["x"], r["value"]) for r in scenario.curve(spark, own, A1, 0, 10, 5, [(0, 0, 1)]).orderBy("x").collect()]
    assert points == [(x, x * x - 3) for x in (0, 2.5, 5, 7.5, 10)]
    assert scenario.interpolated(points, 1.25) == pytest.approx(0.125) and scenario.interpolated(points, 99) == 97
    assert scenario.goal_seek(spark, own, A1, (0, 0, 1), 0.0, 0, 10) == pytest.approx(3**0.5, abs=1e-12)
    assert scenario.goal_seek(spark, own, A1, (0, 1, 1), 5.0, 0, 10) is None
    assert scenario.slider(10.0) == (5.0, 15.0) and scenario.slider(0.0) == (-5.0, 5.0)


def test_tornado_and_inputs(spark):
    own = book({"A1": 10, "A2": 1, "A3": 5, "B1": "=A1*3+A2", "B2": "=B1+A1", "B3": "=A3*0+SUM(A1:A2)"})
    assert [c for c, _ in graph.auto_inputs(own)] == [A1, (0, 1, 0), (0, 2, 0)]
    out = scenario.tornado(spark, own, [A1, (0, 1, 0), (0, 2, 0)], (0, 1, 1)).collect()
    assert [(r["input"], r["swing"]) for r in out] == [("S!A1", pytest.approx(8)), ("S!A2", pytest.approx(0.2))]


def test_gradients():
    g = gradients.gradient(book({"A1": 3, "A2": 4, "B1": "=A1*2+A2", "B2": "=B1*A2"}), {A1: 3.0, (0, 1, 0): 4.0}, (0, 1, 1))
    assert (g.values[0], g.by[A1][0], g.by[0, 1, 0][0]) == (40, 8, 14)
    own = book({**{f"A{r}": r for r in (1, 2, 3)}, **{f"B{r}": f"=A{r}*{r}" for r in (1, 2, 3)}, "B4": "=SUM(B1:B3)"})
    g = gradients.gradient(own, {(0, r, 0): r + 1.0 for r in range(3)}, (0, 3, 1))
    assert [g.by[0, r, 0][0] for r in range(3)] == [1, 2, 3]
    g = gradients.gradient(book({"A1": 2.25, "B1": "=ROUND(A1,1)*3"}), {A1: 2.25}, (0, 0, 1))
    assert g.by[A1][0] == 0 and g.structural == {(0, 0, 1): True}


@pytest.mark.parametrize("seed", range(12))
def test_gradients_are_central_differences(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 8))
    cells: dict = {f"A{i + 1}": float(rng.uniform(1, 3)) for i in range(n)}
    for i in range(30):
        known = list(cells)
        a, b = rng.choice(known, 2)
        cells[f"B{i + 1}"] = {0: f"={a}+{b}*0.5", 1: f"={a}-{b}*0.3", 2: f"={a}*0.5+{b}*0.1", 3: f"={a}/(2+{b}*{b})", 4: f"=SUM(A1:A{n})*0.1+{a}"}[int(rng.integers(0, 5))]
    own = book(cells)
    inputs, output = {(0, i, 0): cells[f"A{i + 1}"] for i in range(n)}, (0, 29, 1)
    g = gradients.gradient(own, inputs, output)
    for c in inputs:
        assert g.by[c][0] == pytest.approx(scenario.finite_difference(own, c, output), rel=1e-5, abs=1e-7)


def test_diff(spark):
    make = lambda k: book({**{f"A{r}": r for r in range(1, 21)}, "B1": f"=A1*{k}", **{f"B{r}": f"=A{r}*{k}+B{r - 1}" for r in range(2, 21)}})
    inputs = [(A1, R.parse_distribution("normal(10,2)"))]
    out = diff.report(spark, make(1.1), make(1.11), inputs, (0, 19, 1), 500, 99)
    assert (out["scenarios"], out["diverged"], out["witness"]["scenario"]) == (500, 500, 0) and out["witness"]["inputs"][A1] == inputs[0][1].sample(99, 0, np.array([0]))[0]
    assert diff.report(spark, make(1.1), make(1.1), inputs, (0, 19, 1), 200)["diverged"] == 0
    own = diff.default_inputs(make(1.1), make(1.11), 5)
    assert [c for c, _ in own] == [(0, r, 0) for r in range(5)] and own[1][1].p == (2.0, 0.1 * 2.0 + 1e-9)


def test_streamed_edits(spark, tmp_path):
    own = book({"A1": 1, "A2": 2, "B1": "=A1*10", "B2": "=A2+B1", "C1": "=7"})
    rows = [(1, 0, 0, 0, 5.0), (2, 0, 0, 0, 6.0)]
    spark.createDataFrame(rows, "at long, sheet int, row int, col int, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at long, sheet int, row int, col int, value double").parquet(str(tmp_path / "in"))
    follow(stream, LiveModel(own), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["cell"]: r["value"] for r in out} == {"S!B1": 60.0, "S!B2": 62.0} and own.sheets[0].values[1, 1] == 62


def test_exact_sums_beyond_a_million_rows(spark):
    n = 1_100_000
    df = spark.range(n).select("id", F.expr("CAST((id * 7919) % 1000003 AS DOUBLE) * 0.1").alias("v")).repartition(5)
    total = 0.0
    for i in range(n):
        total += float((i * 7919) % 1000003) * 0.1
    assert ordered_sum(df, ["id"], "v").first()["v"] == total
    assert ordered_sum(df.limit(0), ["id"], "v").first()["v"] == 0.0


def test_exact_sums_and_positions(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=3000) * 10.0 ** rng.integers(-8, 8, 3000)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "k long, v double").repartition(7)
    total = 0.0
    for x in v:
        total += float(x)
    assert ordered_sum(df, ["k"], "v").first()["v"] == total
    with pytest.raises(ValueError):
        ordered_sum(df, ["k"], "v", most=10)
    assert with_positions(df, ["k"]).where("_row <> k + 1").count() == 0
