"""Do two versions of a model agree? The same scenarios through both, and the first one in which they don't."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.random import Distribution
from gridloom.operators.scenario import prepare, sampler, swept
from gridloom.plans.graph import Cell
from gridloom.plans.workbook import Workbook


def both(spark: SparkSession, one: Workbook, two: Workbook, inputs: list[tuple[Cell, Distribution]], output: Cell, n: int, seed: int = 1) -> DataFrame:
    """scenario, v1, v2, differs: values that aren't bit for bit equal differ. An output that the inputs don't reach in a
    version keeps the value stored there."""

    def side(book: Workbook, name: str) -> DataFrame:
        rows = swept(spark, prepare(book, [c for c, _ in inputs], [output]), n, sampler(inputs, seed))
        return rows.select("scenario", F.col("value").alias(name), F.coalesce("error", "text", F.lit("")).alias(f"{name}_other"))

    pairs = side(one, "v1").join(side(two, "v2"), "scenario")
    differs = ~(F.col("v1").eqNullSafe(F.col("v2")) & (F.col("v1_other") == F.col("v2_other")))
    return pairs.withColumn("differs", differs)


def report(spark: SparkSession, one: Workbook, two: Workbook, inputs: list[tuple[Cell, Distribution]], output: Cell, n: int, seed: int = 1) -> dict:
    """scenarios, diverged, share, and a witness: the first scenario in which the versions differ, with its inputs, drawn
    again from seed and number."""
    r = both(spark, one, two, inputs, output, n, seed).agg(F.count("*").alias("n"), F.count_if("differs").alias("d"), F.min(F.when(F.col("differs"), F.struct("scenario", "v1", "v2"))).alias("w")).first()
    witness = None
    if r["w"] is not None:
        k = r["w"]["scenario"]
        drawn = sampler(inputs, seed)(np.array([k]))
        witness = {"scenario": k, "inputs": {c: float(v[0]) for c, v in drawn.items()}, "v1": r["w"]["v1"], "v2": r["w"]["v2"]}
    return {"scenarios": r["n"], "diverged": r["d"], "share": r["d"] / r["n"] if r["n"] else 0.0, "witness": witness}


def default_inputs(one: Workbook, two: Workbook, most: int = 64) -> list[tuple[Cell, Distribution]]:
    """Fixed numbers that both versions share, each spread by a tenth of its size."""
    out = []
    for s, (a, b) in enumerate(zip(one.sheets, two.sheets, strict=False)):
        for at, v in a.values.items():
            if isinstance(v, float) and not isinstance(v, bool) and at not in a.formulas and at not in b.formulas and b.values.get(at) == v:
                out.append(((s, *at), Distribution("normal", (v, 0.1 * abs(v) + 1e-9))))
    return sorted(out, key=lambda x: x[0])[:most]


def cell_changes(one: DataFrame, two: DataFrame) -> DataFrame:
    """sheet, row, col, change (added, removed, formula, value) between two tables of cells."""
    v = lambda p: F.struct(f"{p}.kind", f"{p}.num", f"{p}.text")
    a, b = one.alias("a"), two.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("sheet_name", "row", "col")]
    joined = a.join(b, same[0] & same[1] & same[2], "full")
    change = F.when(F.col("a.sheet_name").isNull(), "added").when(F.col("b.sheet_name").isNull(), "removed").when(~F.col("a.formula").eqNullSafe(F.col("b.formula")), "formula").when(~v("a").eqNullSafe(v("b")), "value")
    return joined.select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("sheet_name", "row", "col")), change.alias("change")).where("change is not null")
