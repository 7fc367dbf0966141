"""Defects in copied formulas, coarsening of formula families, and what a sheet's formulas look like.

Cells are a table (wb, sheet, sheet_name, row, col, formula); shapes are one Python step over it, everything after that
windows and aggregates within a sheet's rows and columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators import ordered
from gridloom.plans import syntax as S

BORDER = T.StructType([T.StructField("kind", T.StringType()), T.StructField("n", T.LongType())])
EXTENT = T.StructType([T.StructField("sheet", T.StringType()), *(T.StructField(x, BORDER) for x in ("r0", "c0", "r1", "c1")), T.StructField("single", T.BooleanType()), T.StructField("shown", T.StringType())])
SHAPE = T.StructType([T.StructField("full", T.StringType()), T.StructField("structural", T.StringType()), T.StructField("ranges", T.ArrayType(EXTENT)), T.StructField("ref_error", T.BooleanType()), T.StructField("parsed", T.BooleanType())])
#: Runs shorter than this, deviants beyond this and majorities below this share are left alone.
SHORTEST, MOST_DEVIANTS, MAJORITY = 6, 2, 0.75


def shape_row(formula: str, row: int, col: int, rows: int) -> dict:
    tree = S.parses(formula, rows)
    if tree is None:
        return {"full": None, "structural": None, "ranges": [], "ref_error": False, "parsed": False}
    own = S.shape(tree, row, col)
    border = lambda b: {"kind": b[0], "n": b[1]}
    ranges = [{"sheet": x.sheet, "r0": border(x.r0), "c0": border(x.c0), "r1": border(x.r1), "c1": border(x.c1), "single": x.single, "shown": x.text()} for x in own.ranges]
    return {"full": own.full, "structural": own.structural, "ranges": ranges, "ref_error": own.ref_error, "parsed": True}


@F.pandas_udf(SHAPE)
def shape_of(formula: pd.Series, row: pd.Series, col: pd.Series, rows: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([shape_row(*x) for x in zip(formula, row, col, rows, strict=True)], columns=["full", "structural", "ranges", "ref_error", "parsed"])


def shapes(cells: DataFrame, rows: int = S.MAX_ROWS) -> DataFrame:
    """The formula cells with their shapes. rows: where sheets end; sheets made from tables go on beyond those of files."""
    own = cells.where("formula is not null").select("wb", "sheet", "sheet_name", "row", "col", "formula")
    once = shape_of.asNondeterministic()  # else filters on a shape move below it and read it a second time
    return own.select("*", once("formula", "row", "col", F.lit(rows).cast("long")).alias("s")).select("wb", "sheet", "sheet_name", "row", "col", "formula", "s.*")


def runs(df: DataFrame, lane: list[str], at: str, name: str, *also: str) -> DataFrame:
    """``df`` with a number for each maximal run of neighbouring places ``at`` in a lane, and of equal ``also``. A lane is a
    sheet's row or column, 1,048,576 cells at most; a table without lanes is dealt into ranges."""
    if not lane:
        return ordered.numbered(df, list(also), at, name).withColumn(name, F.col(at) - F.col(name) - 1)
    w = Window.partitionBy(*lane, *also).orderBy(at)
    return df.withColumn(name, F.col(at) - F.row_number().over(w))


def cell_name(row: Column, col: Column) -> Column:
    """A1 names from places that count from 0. Beyond three letters, where sheets have no columns, the first one goes on
    through Unicode."""
    first = (65 + F.floor((col - 702) / 676)).cast("long")
    wide = F.decode(F.unhex(F.lpad(F.hex(first), 8, "0")), "UTF-32")  # char() takes 256 codes only
    letters = F.concat(
        F.when(col >= 702, F.when(first < 128, F.char(first)).otherwise(wide)).otherwise(""),
        F.when(col >= 26, F.char((65 + F.pmod(F.floor((col - 26) / 26), F.lit(26))).cast("long"))).otherwise(""),
        F.char((65 + F.pmod(col, F.lit(26))).cast("long")),
    )
    return F.concat(letters, (row + 1).cast("string"))


def place_of(name: Column) -> tuple[Column, Column]:
    """Row and column of an A1 name, from 0."""
    letters = F.split(F.regexp_extract(name, "^([A-Z]+)", 1), "")
    return F.regexp_extract(name, "([0-9]+)$", 1).cast("int") - 1, F.aggregate(letters, F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64) - 1


def coarsened(cells: DataFrame) -> DataFrame:
    """The cells with the family each belongs to: down a column first, runs of two or more of one shape; then along rows;
    what is left is alone. Columns family (wb, sheet, axis and first cell) and lanes."""
    own = runs(shapes(cells).where("parsed"), ["wb", "sheet", "col"], "row", "_run", "full")
    down = Window.partitionBy("wb", "sheet", "col", "full", "_run")
    own = own.withColumns({"_n": F.count("*").over(down), "_top": F.min("row").over(down)}).withColumn("_alone", F.col("_n") < 2)
    own = runs(own, ["wb", "sheet", "row"], "col", "_run", "full", "_alone")
    along = Window.partitionBy("wb", "sheet", "row", "full", "_alone", "_run")
    vertical, horizontal = F.concat(F.lit("v:"), cell_name(F.col("_top"), F.col("col"))), F.concat(F.lit("h:"), cell_name(F.col("row"), F.min("col").over(along)))
    lanes = F.when(F.col("_alone"), F.count("*").over(along)).otherwise(F.col("_n"))
    return own.withColumns({"family": F.when(F.col("_alone"), horizontal).otherwise(vertical), "lanes": lanes}).drop("_run", "_n", "_top", "_alone")


def coarsening(cells: DataFrame) -> DataFrame:
    """By workbook: cells, families and cells for each family."""
    own = coarsened(cells)
    return own.groupBy("wb").agg(F.count("*").alias("cells"), F.countDistinct("sheet", "family").alias("families")).withColumn("ratio", F.col("cells") / F.col("families"))


def border_step(a: Column, b: Column) -> Column:
    """How far apart two borders are; null between relative and absolute ones."""
    return F.when(a["kind"] == b["kind"], a["n"] - b["n"])


def beside_majority(own: DataFrame, along_rows: bool, name: str) -> DataFrame:
    """``own`` with a struct for the cells inside long runs that differ from the run's majority, one or two in a run: _len,
    _majority, ex (the majority's first cell), _first and _last of the run. It is null for all other cells."""
    lane, at = ("row", "col") if along_rows else ("col", "row")
    own = runs(own, ["wb", "sheet", lane], at, "_run")
    keys = ["wb", "sheet", lane, "_run"]
    run = Window.partitionBy(*keys)
    own = own.withColumn("_same", F.count("*").over(Window.partitionBy(*keys, "full")))
    cell = F.struct("row", "col", "formula", "structural", "ranges", "full", "_same")
    own = own.withColumns({"_len": F.count("*").over(run), "_first": F.min(at).over(run), "_last": F.max(at).over(run), "_ex": F.max_by(cell, F.struct("_same", "full", -F.col(at))).over(run)})
    n, most, here = F.col("_len"), F.col("_ex._same"), F.col(at)
    odd = (n >= SHORTEST) & (most >= n * MAJORITY) & (most < n) & (n - most <= MOST_DEVIANTS) & (F.col("full") != F.col("_ex.full")) & (here > F.col("_first")) & (here < F.col("_last"))
    own = own.withColumn(name, F.when(odd, F.struct("_len", F.col("_ex.full").alias("_majority"), F.col("_ex").alias("ex"), "_first", "_last")))
    return own.drop("_run", "_same", "_len", "_first", "_last", "_ex")


def deviants(own: DataFrame, along_rows: bool) -> DataFrame:
    """The cells inside long runs that differ from the run's majority, one or two in a run, each beside an exemplar."""
    return beside_majority(own, along_rows, "_beside").where("_beside is not null").select("*", "_beside.*").drop("_beside")


def findings(cells: DataFrame) -> DataFrame:
    """detector, wb, sheet, cell, formula, proof for every defect:

    ref-error: a reference to cells or a sheet that are gone; range-off-by-one: one border of one range is one off from the
    siblings'; inconsistent-region: another slipped reference.
    """
    own = shapes(cells).where("parsed").withColumn("_repeats", F.count("*").over(Window.partitionBy("wb", "sheet", "full")))
    own = beside_majority(beside_majority(own, False, "_down"), True, "_along")
    # a row for each defect: a lost reference, a run down a column, a run along a row; shapes are read once for all three
    way = F.col("_way")
    kinds = F.array_compact(F.array(F.when(F.col("ref_error"), 0), F.when(F.col("_down").isNotNull(), 1), F.when(F.col("_along").isNotNull(), 2)))
    odd = own.withColumn("_way", F.explode(kinds)).withColumn("_beside", F.when(way == 1, F.col("_down")).when(way == 2, F.col("_along"))).drop("_down", "_along").select("*", "_beside.*")
    is_lost = way == 0
    odd = odd.where(is_lost | ((F.col("structural") == F.col("ex.structural")) & (F.size("ranges") == F.size("ex.ranges"))))
    pairs = F.arrays_zip(F.col("ranges").alias("a"), F.col("ex.ranges").alias("b"))
    borders = ("r0", "c0", "r1", "c1")
    steps = lambda p: [border_step(p["a"][x], p["b"][x]) for x in borders]
    odd = odd.withColumn("_pairs", F.filter(pairs, lambda p: p["a"] != p["b"]))
    flipped = F.exists("_pairs", lambda p: steps(p)[0].isNull() | steps(p)[1].isNull() | steps(p)[2].isNull() | steps(p)[3].isNull())
    odd = odd.where(is_lost | ~flipped)
    moved = lambda p: F.filter(F.array(*steps(p)), lambda d: d != 0)
    one_off = (F.size("_pairs") == 1) & F.forall("_pairs", lambda p: (F.size(moved(p)) == 1) & (F.abs(F.element_at(moved(p), 1)) == 1))
    odd = odd.withColumn("_one", one_off)
    vector = lambda r, across: (r["r0"] == r["r1"]) & (r["c0"] != r["c1"]) if across else (r["c0"] == r["c1"]) & (r["r0"] != r["r1"])
    turned = F.exists("_pairs", lambda p: ~p["a"]["single"] & ~p["b"]["single"] & ((vector(p["a"], True) & vector(p["b"], False)) | (vector(p["a"], False) & vector(p["b"], True))))
    reordered = (F.col("ranges") != F.col("ex.ranges")) & (F.array_sort("ranges") == F.array_sort(F.col("ex.ranges")))
    odd = odd.where(is_lost | F.col("_one") | ((F.col("_repeats") == 1) & ~turned & ~reordered))
    # a lane flagged in several runs is a second layout
    odd = odd.withColumn("_lane", F.when(way == 2, F.col("col")).otherwise(F.col("row")))
    odd = odd.withColumn("_flags", F.count("*").over(Window.partitionBy("wb", "sheet", "_way", "_lane"))).where(is_lost | F.col("_one") | (F.col("_flags") == 1))
    name, ex = cell_name(F.col("row"), F.col("col")), cell_name(F.col("ex.row"), F.col("ex.col"))
    place = lambda p: F.when(way == 2, cell_name(F.col("row"), F.col(p))).otherwise(cell_name(F.col(p), F.col("col")))
    others = (F.col("_len") - 1).cast("string")
    size = F.col("_len").cast("string")
    where = F.concat("sheet_name", F.lit("!"), place("_first"), F.lit(":"), place("_last"))
    lost = F.concat("sheet_name", F.lit("!"), name, F.lit(" = "), "formula", F.lit(" refers to #REF!"))
    first = F.element_at("_pairs", 1)
    off = F.concat(where, F.lit(": "), others, F.lit(" of "), size, F.lit(" cells use the pattern of "), ex, F.lit(" = "), "ex.formula", F.lit("; "), name, F.lit(" = "), "formula", F.lit(" — its range spans "), first["a"]["shown"], F.lit(" where siblings span "), first["b"]["shown"], F.lit(" (one boundary short/long by one)"))
    odd_one = F.concat(where, F.lit(": "), others, F.lit(" of "), size, F.lit(" cells share the copied formula pattern (e.g. "), ex, F.lit(" = "), "ex.formula", F.lit("), but "), name, F.lit(" = "), "formula")
    detector = F.when(is_lost, "ref-error").when(F.col("_one"), "range-off-by-one").otherwise("inconsistent-region")
    proof = F.when(is_lost, lost).when(F.col("_one"), off).otherwise(odd_one)
    return odd.select(detector.alias("detector"), "wb", F.col("sheet_name").alias("sheet"), name.alias("cell"), "formula", proof.alias("proof"))


def key(detector: str = "detector", sheet: str = "sheet", cell: str = "cell") -> Column:
    return F.concat_ws("|", detector, sheet, cell)


def new_findings(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Without those whose key (detector|sheet|cell) a baseline or a list of suppressions holds."""
    return found.join(baseline.select(F.col("key").alias("_key")), key() == F.col("_key"), "left_anti")


@F.pandas_udf(T.LongType())
def fnv1a(text: pd.Series) -> pd.Series:
    """The 64-bit FNV-1a hash, as a signed integer."""

    def one(t: str) -> int:
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >> 63 else h

    return text.map(one)


def sampled(found: DataFrame, n: int = 200) -> DataFrame:
    """For each detector the n findings that come first by a hash of where they are: the same on each run."""
    h = fnv1a(F.concat_ws("|", "wb", "sheet", "cell"))
    order = Window.partitionBy("detector").orderBy(F.expr("_h >= 0").desc(), "_h", "wb", "sheet", "cell")  # as unsigned numbers
    return found.withColumn("_h", h).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_h", "_k")


def audit(found: DataFrame, cells: DataFrame) -> DataFrame:
    """The findings beside the stored values of the cells around them, one up, down, left and right."""
    v = F.coalesce(F.col("text"), F.col("num").cast("string"))
    near = cells.select(F.col("wb").alias("_wb"), F.col("sheet_name").alias("_sheet"), F.col("row").alias("_row"), F.col("col").alias("_col"), F.struct(cell_name(F.col("row"), F.col("col")).alias("cell"), v.alias("value")).alias("_near"))
    row, col = place_of(F.col("cell"))
    # the cell itself is looked up too: findings of cells that aren't there are left out
    steps = found.withColumn("_d", F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))))))
    steps = steps.select("*", (row + F.col("_d.dr")).alias("_r"), (col + F.col("_d.dc")).alias("_c"), ((F.col("_d.dr") == 0) & (F.col("_d.dc") == 0)).alias("_own"))
    joined = steps.join(near, (F.col("wb") == F.col("_wb")) & (F.col("sheet") == F.col("_sheet")) & (F.col("_r") == F.col("_row")) & (F.col("_c") == F.col("_col")))
    out = joined.groupBy("detector", "wb", "sheet", "cell", "formula", "proof").agg(F.sort_array(F.collect_list(F.when(~F.col("_own"), F.col("_near")))).alias("around"), F.bool_or("_own").alias("_there"))
    return out.where("_there").drop("_there")


def caret(formula: str, proof: str, row: int, col: int) -> str:
    """The formula with carets under the range that the proof names."""
    tree = S.parses(formula)
    spot = (0, len(formula))
    if tree is not None:
        at = 0
        for n in tree.walk():
            if isinstance(n, S.Ref | S.Binary) and (not isinstance(n, S.Binary) or n.op == ":"):
                own = S.shape(n, row, col)
                if own.ranges and f"spans {own.ranges[0].text()} " in proof:
                    at = formula.find(n.text().strip())
                    spot = at, at + len(n.text().strip())
                    break
    return f"{formula}\n{' ' * spot[0]}{'^' * max(1, spot[1] - spot[0])}"
