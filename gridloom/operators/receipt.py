"""Receipts: every formula evaluated again and held against the value that its file stores."""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.values import NAME, Fault, Value
from gridloom.plans import syntax as S
from gridloom.plans.interp import Evaluator
from gridloom.plans.rebase import moved
from gridloom.plans.workbook import Workbook
from gridloom.sources.xlsx import books_of

REPORT = "wb string, sheet string, row int, col int, formula string, expected string, got string, outcome string, class string, functions array<string>"


def ulps(a: float, b: float) -> int:
    """How many doubles apart; a lot across signs."""
    if a == b:
        return 0
    if a != a or b != b or (a < 0) != (b < 0):
        return 1 << 62
    bits = lambda x: struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return abs(bits(a) - bits(b))


def classify(expected: Value, got: Value) -> tuple[str, str]:
    """pass (exact, ulp1, sig15) or mismatch (numeric, text, type, error)."""
    number = lambda v: isinstance(v, float | int) and not isinstance(v, bool)
    if number(expected) and number(got):
        n = ulps(float(expected), float(got))
        if n <= 1:
            return "pass", "exact" if n == 0 else "ulp1"
        return ("pass", "sig15") if f"{expected:.14e}" == f"{got:.14e}" else ("mismatch", "numeric")
    for kind, name in ((str, "text"), (bool, "type"), (Fault, "error")):
        if isinstance(expected, kind) and isinstance(got, kind):
            return ("pass", "exact") if expected == got else ("mismatch", name)
    return "mismatch", "type"


def outside(node: S.Node) -> bool:
    """Whether a formula reads another workbook."""
    return any(getattr(n, "sheet", None) is not None and n.sheet.book is not None for n in node.walk()) or any(isinstance(n, S.Call) and any(isinstance(p, str) and p.startswith("[") for p in n.pieces) for n in node.walk())


def judged(book: Workbook, sheet: int, row: int, col: int, formula: str, extents: dict | None = None) -> tuple[Value, Value, str, str]:
    """Expected and got values, outcome and class. Cells are evaluated against the stored values of their neighbours."""
    tree = S.parses(formula)
    if tree is None:
        return None, None, "excluded", "parse"
    if outside(tree) or any(isinstance(n, S.Name) and n.name.upper() in book.external_names for n in tree.walk()):
        return None, None, "excluded", "external_ref"
    if (row, col) in book.sheets[sheet].arrays:
        return None, None, "excluded", "array_formula"
    if set(S.functions_in(formula)) & set(S.VOLATILE):
        return None, None, "excluded", "volatile"
    expected = book.sheets[sheet].values.get((row, col))
    if expected is None:
        return None, None, "no_cached", ""
    got = Evaluator(book, sheet, row, col, extents=extents).formula(tree)
    if got == NAME and expected != NAME:
        return expected, got, "excluded", "unimplemented"
    return expected, got, *classify(expected, got)


def shown(v: Value) -> str | None:
    return None if v is None else v.code if isinstance(v, Fault) else str(v).upper() if isinstance(v, bool) else v if isinstance(v, str) else repr(float(v))


def report(cells: DataFrame) -> DataFrame:
    """A row of REPORT for each formula cell. A workbook is evaluated where its cells meet; it is one file's size."""

    def one(frame):
        import pandas as pd

        out = []
        for wb, book in books_of(frame.astype(object).where(frame.notna(), None).itertuples(index=False)).items():
            extents: dict = {}
            for s, r, c, text in book.formula_cells():
                expected, got, outcome, kind = judged(book, s, r, c, text, extents)
                out.append((wb, book.sheets[s].name, r, c, text, shown(expected), shown(got), outcome, kind, S.functions_in(text)))
        return pd.DataFrame(out, columns=[f.split()[0] for f in REPORT.split(", ")])

    return cells.groupBy("wb").applyInPandas(one, REPORT)


def families_agree(cells: DataFrame) -> DataFrame:
    """wb, family, lanes, differing: every lane of a family, evaluated by the family's first formula moved there, against its
    own formula, bit for bit."""
    from gridloom.operators.lint import coarsened

    families = coarsened(cells).select(F.struct("sheet", "row", "col", "family").alias("lane"), F.col("wb").alias("of"))
    families = families.groupBy("of").agg(F.collect_list("lane").alias("lanes"))  # a workbook's cells

    def one(key, frame, lanes):
        lanes = pd.DataFrame([dict(x) for own in lanes["lanes"] for x in own], columns=["sheet", "row", "col", "family"])
        out: Counter = Counter()
        size: Counter = Counter()
        book, extents = books_of(frame.astype(object).where(frame.notna(), None).itertuples(index=False)).get(key[0]), {}
        for (sheet, family), own in lanes.groupby(["sheet", "family"]):
            own = own.sort_values(["row", "col"])
            r0, c0 = int(own["row"].iloc[0]), int(own["col"].iloc[0])
            first = S.parse(book.sheets[sheet].formulas[r0, c0])
            for r, c in zip(own["row"].astype(int), own["col"].astype(int), strict=True):
                there = Evaluator(book, sheet, r, c, extents=extents)
                a, b = there.formula(S.parse(moved(first, r - r0, c - c0))), there.formula(S.parse(book.sheets[sheet].formulas[r, c]))
                size[sheet, family] += 1
                out[sheet, family] += repr(a) != repr(b)
        return pd.DataFrame([(key[0], f, n, out[s, f]) for (s, f), n in size.items()], columns=["wb", "family", "lanes", "differing"])

    return cells.groupBy("wb").cogroup(families.groupBy("of")).applyInPandas(one, "wb string, family string, lanes long, differing long")


def summary(reports: DataFrame) -> DataFrame:
    """One row: cells, no_cached, excluded by reason, pass by class, mismatches by class, verifiable and the pass rate."""
    n = lambda test: F.count_if(test)
    outcome = F.col("outcome")
    reasons = ("parse", "external_ref", "array_formula", "volatile", "unimplemented")
    out = reports.agg(
        F.count("*").alias("cells"), n(outcome == "no_cached").alias("no_cached"), *(n((outcome == "excluded") & (F.col("class") == r)).alias(f"excluded_{r}") for r in reasons), n(outcome == "pass").alias("passed"),
        *(n((outcome == "pass") & (F.col("class") == c)).alias(c) for c in ("ulp1", "sig15")), *(n((outcome == "mismatch") & (F.col("class") == c)).alias(f"mismatch_{c}") for c in ("numeric", "text", "type", "error")),
    )
    verifiable = F.col("cells") - F.col("no_cached") - sum((F.col(f"excluded_{r}") for r in reasons[1:]), F.col("excluded_parse"))
    return out.withColumn("verifiable", verifiable).withColumn("pass_rate", F.try_divide(F.col("passed"), F.col("verifiable")))


def by_function(reports: DataFrame) -> DataFrame:
    """For each function that formulas mention: how many cells passed of those that were compared."""
    own = reports.where(F.col("outcome").isin("pass", "mismatch")).select(F.explode("functions").alias("function"), (F.col("outcome") == "pass").alias("ok"))
    return own.groupBy("function").agg(F.count_if("ok").alias("passed"), F.count("*").alias("total")).withColumn("rate", F.col("passed") / F.col("total"))


def failures(reports: DataFrame, most: int = 50_000) -> DataFrame:
    """The mismatches, at most so many lines of a report."""
    own = reports.where("outcome = 'mismatch'").select("wb", "sheet", "row", "col", "formula", "expected", "got", "class")
    return own.orderBy("wb", "sheet", "row", "col").limit(most)


def capability(cells: DataFrame) -> DataFrame:
    """How many formulas can't be verified, and why: unparseable, external_ref, volatile_nondeterministic, array_formula."""
    own = report(cells).where("outcome = 'excluded'")
    return own.groupBy("class").count()


@F.pandas_udf(T.StringType())
def column_class(expected: pd.Series, got: pd.Series) -> pd.Series:
    """``classify`` for numeric columns: exact, ulp1, sig15 or numeric. Distances are between the doubles' bits; only what is
    further apart is written out in 15 digits."""
    a, b = expected.to_numpy(float), got.to_numpy(float)
    apart = np.abs(np.abs(a).view(np.int64) - np.abs(b).view(np.int64))
    out = np.where(a == b, "exact", np.where((np.signbit(a) == np.signbit(b)) & (apart <= 1), "ulp1", "")).astype(object)
    for i in np.flatnonzero(out == ""):
        out[i] = "sig15" if f"{a[i]:.14e}" == f"{b[i]:.14e}" else "numeric"
    return pd.Series(out)


def vote(stored: Column, ours: Column, third: Column, tolerance: float = 1e-9) -> Column:
    """Who is right where stored and computed values differ and a third engine has an opinion: noise if the third agrees
    with the computed one, real if with the stored one, else three-way."""
    close = lambda a, b: F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.when(close(third, ours), "noise").when(close(third, stored), "real").otherwise("three-way")


def tallies(reports: list[tuple]) -> Counter:
    return Counter((r[7], r[8]) for r in reports)
