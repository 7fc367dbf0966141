"""What formulas a corpus of workbooks uses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.plans import syntax as S


@F.pandas_udf(T.ArrayType(T.StringType()))
def functions_of(formula: pd.Series) -> pd.Series:
    return formula.map(S.functions_in)


@F.pandas_udf(T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("printed", T.StringType()), T.StructField("error", T.StringType())]))
def round_trip(formula: pd.Series) -> pd.DataFrame:
    def one(text):
        try:
            printed = S.parse(text).text()
            return printed == text, printed, None
        except S.FormulaError as e:
            return False, None, str(e)

    return pd.DataFrame([one(f) for f in formula], columns=["ok", "printed", "error"])


def parse_corpus(cells: DataFrame) -> DataFrame:
    """formula, count, kind, detail, example for every text that doesn't parse or doesn't print as it was, most frequent
    first. Texts repeat, so each is parsed once."""
    texts = cells.where("formula is not null").groupBy("formula").agg(F.count("*").alias("count"), F.min("wb").alias("example"))
    own = texts.withColumn("r", round_trip("formula")).where("not r.ok")
    kind = F.when(F.col("r.error").isNotNull(), "parse").otherwise("print")
    return own.select("formula", "count", kind.alias("kind"), F.coalesce("r.error", "r.printed").alias("detail"), "example").orderBy(F.desc("count"), "formula")


def combos(cells: DataFrame) -> DataFrame:
    """wb, functions, cells: how many formulas of a workbook call which set of functions."""
    own = cells.where("formula is not null").groupBy("wb", "formula").agg(F.count("*").alias("n"))
    return own.withColumn("functions", functions_of("formula")).groupBy("wb", "functions").agg(F.sum("n").alias("cells"))


def census(combos_: DataFrame) -> DataFrame:
    """function, cells, workbooks, by rank."""
    own = combos_.select("wb", "cells", F.explode("functions").alias("function"))
    return own.groupBy("function").agg(F.sum("cells").alias("cells"), F.countDistinct("wb").alias("workbooks")).orderBy(F.desc("cells"), "function")


def volatile(combos_: DataFrame) -> DataFrame:
    """wb, functions: the functions of a workbook that give another value each time."""
    own = combos_.select("wb", F.explode("functions").alias("f")).where(F.col("f").isin(*S.VOLATILE))
    return own.groupBy("wb").agg(F.sort_array(F.collect_set("f")).alias("functions"))


def covering(ranked: DataFrame, share: float = 0.99) -> DataFrame:
    """The most used functions that together make up a share of all mentions, with the running share."""
    total = ranked.agg(F.sum("cells")).first()[0] or 0
    order = Window.orderBy(F.desc("cells"), "function").rowsBetween(Window.unboundedPreceding, 0)  # a few hundred names
    own = ranked.withColumn("running", F.sum("cells").over(order) / F.lit(float(total or 1)))
    before = F.col("running") - F.col("cells") / F.lit(float(total or 1))
    return own.where(before < share)


def projection(combos_: DataFrame, supported: list[str]) -> DataFrame:
    """One row: the share of workbooks that a set of functions serves fully, in part and not at all, and of cells."""
    ok = F.size(F.array_except("functions", F.array(*(F.lit(f) for f in supported)))) == 0
    per = combos_.groupBy("wb").agg(F.sum("cells").alias("n"), F.sum(F.when(ok, F.col("cells")).otherwise(0)).alias("good"))
    return per.agg(
        F.count("*").alias("workbooks"), F.avg((F.col("good") == F.col("n")).cast("double")).alias("full"), F.avg(((F.col("good") < F.col("n")) & (F.col("good") > 0)).cast("double")).alias("partial"),
        F.avg((F.col("good") == 0).cast("double")).alias("refusal"), (F.sum("good") / F.sum("n")).alias("cell_coverage"),
    )
