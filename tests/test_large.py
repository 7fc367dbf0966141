"""What must not grow with the square of a table, and places beyond a small table's."""

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.columns import Cell
from gridloom.operators import lint, receipt
from gridloom.plans.compiler import Book  # isort: skip (the compiler brings in the criteria)
from gridloom.plans import criteria, model_queries
from gridloom.plans import syntax as S
from gridloom.plans.workbook import SheetData, Workbook
from gridloom.sources.tables import Sheet


def test_receipts_measure_a_sheet_once(monkeypatch):
    book, measured, extents = Workbook(), [], {}
    own = book.add("S")
    own.values |= {(r, 0): float(r) for r in range(20)} | {(r, 1): 2.0 * r for r in range(20)} | {(r, 2): 190.0 for r in range(20)}
    own.formulas |= {(r, 1): f"A{r + 1}*2" for r in range(20)}
    extent = SheetData.extent
    monkeypatch.setattr(SheetData, "extent", lambda self: measured.append(1) or extent(self))
    assert all(receipt.judged(book, s, r, c, text, extents)[2:] == ("pass", "exact") for s, r, c, text in book.formula_cells())
    assert not measured  # single cells don't ask where the sheet ends
    assert all(receipt.judged(book, 0, r, 2, "SUM(A:A)", extents)[2:] == ("pass", "exact") for r in range(20))
    assert len(measured) == 1


CELLS = "wb string, sheet int, sheet_name string, row int, col int, kind string, num double, text string, formula string, is_array boolean"


def python_steps(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def sheet(spark, slip: int):
    rows = [("w", 0, "S", r, c, "n", 1.0, None, f"A{r + 1 + (c == 1 and r == slip)}*2" if c else None, False) for r in range(20) for c in range(3)]
    return spark.createDataFrame(rows, CELLS)


def test_findings_read_shapes_once(spark):
    own = sheet(spark, 7)
    found = lint.findings(own)
    assert python_steps(found) == 1
    assert [(r["detector"], r["cell"]) for r in found.collect()] == [("inconsistent-region", "B8")]
    lost = own.withColumn("num", own["row"] + 0.0).where("not (row = 6 and col = 1)")
    around = {r["cell"]: [(x["cell"], x["value"]) for x in r["around"]] for r in lint.audit(found, lost).collect()}
    assert around == {"B8": [("A8", "7.0"), ("B9", "8.0"), ("C8", "7.0")]}
    assert not lint.audit(found, own.where("not (row = 7 and col = 1)")).count()  # no such cell


def test_families_read_shapes_once(spark):
    own = lint.coarsened(sheet(spark, 7))
    assert python_steps(own) == 1
    lanes = {(r["family"], r["lanes"]) for r in own.collect()}
    assert lanes == {("v:B1", 7), ("h:B8", 1), ("v:B9", 12), ("v:C1", 20)}


def test_comparisons_with_blank_cells_are_ordered(spark):
    blank = Cell("num", F.lit(1.0), None, True)
    assert criteria.Test(blank, 0, None, ">", blank).kind == "mostly order"  # was put to each cell
    rows = [(i, i % 3, None if i % 7 == 0 else float(i * 37 % 50) / 4) for i in range(60)]
    book = Book(spark, [Sheet("t", spark.createDataFrame(rows, "k int, g int, v double"), ["k"])])
    formulas = {
        "above": 'COUNTIF(C:C,">"&C1)', "upto": 'COUNTIF(C:C,"<="&C1)', "total": 'SUMIF(C:C,">="&C1,A:A)', "band": 'COUNTIFS(C:C,">"&C1,C:C,"<"&C1+3)', "closed": 'COUNTIFS(C:C,">="&C1,B:B,B1,C:C,"<="&C1+3)',
        "none": 'COUNTIFS(C:C,"<"&C1,C:C,">="&C1+1)', "sums": 'SUMIFS(A:A,C:C,">"&C1,C:C,"<"&C1+3)',
    }
    got: dict = {}
    for name, text in formulas.items():
        for r in book.fill("t", {name: text}, keep=["k"]).collect():
            got.setdefault(r["k"], {})[name] = r[name]
    known = [(k, g, v) for k, g, v in rows if v is not None]
    for k, g, v in rows:
        r = got[k]
        if v is None:  # a blank after the operator finds blank cells
            assert (r["above"], r["upto"], r["total"]) == (9, 9, sum(x for x, _, w in rows if w is None))
            assert (r["band"], r["closed"], r["none"], r["sums"]) == (0, 0, 0, 0)
            continue
        assert r["above"] == sum(w > v for _, _, w in known) and r["upto"] == sum(w <= v for _, _, w in known)
        assert r["total"] == sum(x for x, _, w in known if w >= v)
        assert r["band"] == sum(v < w < v + 3 for _, _, w in known) and r["sums"] == sum(x for x, _, w in known if v < w < v + 3)
        assert r["closed"] == sum(v <= w <= v + 3 and h == g for _, h, w in known)
        assert r["none"] == 0


def test_counts_between_bounds_meet_no_cells_one_by_one(spark):
    rows = [(i, float(i * 37 % 50)) for i in range(60)]
    book = Book(spark, [Sheet("t", spark.createDataFrame(rows, T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("v", T.DoubleType(), False)])), ["k"])])
    df = book.fill("t", {"n": 'COUNTIFS(B:B,">"&B1,B:B,"<="&B1+9)'}, keep=["k"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["k"]: r["n"] for r in df.collect()} == {k: sum(v < w <= v + 9 for _, w in rows) for k, v in rows}


def test_names_beyond_the_last_column(spark):
    cols = [25, 26, 701, 702, 16383, 129_817, 129_818, 1_199_999]
    names = [r[0] for r in spark.createDataFrame([(c,) for c in cols], "c long").select(lint.cell_name(F.lit(4), F.col("c"))).collect()]
    assert names[:5] == ["Z5", "AA5", "ZZ5", "AAA5", "XFD5"]
    assert [ord(n[0]) for n in names[5:]] == [65 + (c - 702) // 676 for c in cols[5:]]


def test_shapes_beyond_the_last_row_of_files(spark, tmp_path):
    keys = [0, 1, *range(S.MAX_ROWS - 6, S.MAX_ROWS + 3), 1_199_999, 20_000_000]
    parts = [(k, size, "Brand#11") for k in keys for size in range(1, 5)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = {(r["full"], r["n"]) for r in model_queries.QUERIES["q_shapes"](spark, str(tmp_path)).collect()}
    assert got == set(duck.execute(model_queries.SQL["q_shapes"]).fetchall())


@pytest.mark.parametrize(("text", "in_a_file", "in_a_table"), [
    ("A1048576", "R[1048570]C[-3]", "R[1048570]C[-3]"), ("A1048577", "A1048577", "R[1048571]C[-3]"), ("SUM(A1048576:B1048577)", "SUM(R[1048570]C[-3]:B1048577)", "SUM(R[1048570]C[-3]:R[1048571]C[-2])"),
    ("$A$12000000", None, "R12000000C1"), ("SUM($1:$1048577)", None, "SUM(R1C1:R1048577C16384)"), ("TAX20000000000000000000", "TAX20000000000000000000", "TAX20000000000000000000"),
])
def test_where_sheets_end(text, in_a_file, in_a_table):
    for want, rows in ((in_a_file, S.MAX_ROWS), (in_a_table, S.TABLE_ROWS)):
        tree = S.parses(text, rows)
        assert (tree and S.shape(tree, 5, 3).full) == want
        assert tree is None or tree.text() == text
    assert S.parses(text) == S.parses(text, S.MAX_ROWS)
