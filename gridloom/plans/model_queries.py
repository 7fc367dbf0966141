"""Registered queries of the operators beyond single formulas: families and findings, receipts, the census, dependencies,
draws, scenarios, gradients and differences. Where SQL can say the same over the test tables it does."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import random as R
from gridloom.functions.values import Fault
from gridloom.operators import census, dependencies, diff, gradients, lint, ordered, receipt, scenario
from gridloom.plans.formula_queries import book as tables
from gridloom.plans.formula_queries import tidy
from gridloom.plans.interp import Evaluator
from gridloom.plans.syntax import TABLE_ROWS, as_cell, parse
from gridloom.plans.workbook import Workbook
from gridloom.sources import xlsx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model(cells: dict[str, float | str]) -> Workbook:
    """One sheet from A1 names to numbers and formulas; formulas get their values."""
    out = Workbook()
    own = out.add("S")
    for at, v in cells.items():
        row, col = as_cell(at)
        place = row.at, col.at
        if isinstance(v, str):
            own.formulas[place] = v
            own.values[place] = Evaluator(out, 0, *place).formula(parse(v))
        else:
            own.values[place] = float(v)
    return out


# --- families and findings


@query("""SELECT event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (
SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM events)
GROUP BY event_type, run HAVING count(*) >= 2""")
def q_coarsen_runs(spark, sf_dir):
    own = lint.runs(table(spark, sf_dir, "events"), [], "event_id", "run", "event_type")
    return own.groupBy("event_type", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last")).where("n >= 2").drop("run")


_PLACED = "SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row FROM orders"


def order_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a sheet: a column for each customer, whose formulas are the orders' states."""
    own = table(spark, sf_dir, "orders")
    row = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    same = F.lit(None).cast("array<int>").alias("ranges")
    return own.select(F.lit("w").alias("wb"), F.lit(0).alias("sheet"), row.alias("row"), F.col("o_custkey").alias("col"), F.col("o_orderstatus").alias("full"), F.col("o_orderstatus").alias("formula"), F.lit("s").alias("structural"), same)


@query(f"""WITH p AS ({_PLACED}), n AS (SELECT o_custkey, count(*) AS len, max(row) AS last FROM p GROUP BY 1),
c AS (SELECT o_custkey, o_orderstatus, count(*) AS same FROM p GROUP BY 1, 2),
m AS (SELECT o_custkey, max(same) AS most, arg_max(o_orderstatus, same) AS major FROM c GROUP BY 1)
SELECT p.o_custkey AS col, p.row::INTEGER AS row, p.o_orderstatus AS "full", m.major AS majority, n.len FROM p JOIN n USING (o_custkey) JOIN m USING (o_custkey)
WHERE len >= 6 AND most >= 0.75 * len AND most < len AND len - most <= 2 AND p.o_orderstatus <> m.major AND row > 0 AND row < last""")
def q_lint_majority(spark, sf_dir):
    found = lint.deviants(order_sheet(spark, sf_dir), False)
    return found.select("col", F.col("row").cast("int").alias("row"), "full", F.col("_majority").alias("majority"), F.col("_len").alias("len"))


#: The parts of each brand as a file: sizes, names, and two copied formulas of which some slip, lose their reference or
#: have a wrong stored value. The same in SQL: a row for each part, k its place in the file.
_FILES = """WITH p AS (SELECT p_brand || '.xlsx' AS wb, p_size, p_name, row_number() OVER f AS k, count(*) OVER (PARTITION BY p_brand) AS n, lag(p_size) OVER f AS above FROM part WINDOW f AS (PARTITION BY p_brand ORDER BY p_partkey)),
c AS (SELECT *, k = 4 AND n >= 8 AS slipped, p_size % 10 = 3 AS wrong, p_size = 13 AS lost FROM p),
s AS (SELECT wb, k, 3 AS col, slipped AS odd FROM c UNION ALL SELECT wb, k, 4 AS col, lost AS odd FROM c), i AS (SELECT wb, col, odd, k - row_number() OVER (PARTITION BY wb, col, odd ORDER BY k) AS island FROM s),
v AS (SELECT *, ((CASE WHEN slipped THEN above ELSE p_size END + 1) * 2 + wrong::INTEGER)::DOUBLE AS stored FROM c) """


def brand_file(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    book = Workbook()
    own = book.add("Parts")
    own.values |= {(0, c): t for c, t in enumerate(("size", "name", "sum", "double"))}
    parts = parts.sort_values("p_partkey")
    sizes = [float(x) for x in parts["p_size"]]
    for k, (size, name) in enumerate(zip(sizes, parts["p_name"], strict=True), 1):
        from_ = k - 1 if k == 4 and len(sizes) >= 8 else k
        own.values |= {(k, 0): size, (k, 1): name, (k, 2): (sizes[from_ - 1] + 1) * 2 + (size % 10 == 3), (k, 3): Fault("#REF!") if size == 13 else size * 2}
        own.formulas |= {(k, 2): f"SUM(A{from_ + 1},1)*2", (k, 3): "#REF!*2" if size == 13 else f"A{k + 1}*2"}
    return pd.DataFrame({"wb": [f"{key[0]}.xlsx"], "content": [xlsx.write(book)]})


def file_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the brands' files, written and read."""
    own = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_name")
    return xlsx.read_binary(own.groupBy("p_brand").applyInPandas(brand_file, "wb string, content binary"))


@query(_FILES + "SELECT wb, 'Parts' AS sheet_name, 4 + 4 * count(*) AS cells, 2 * count(*) AS formulas, 4 + count(*) AS texts FROM c GROUP BY wb")
def q_xlsx_scan(spark, sf_dir):
    return file_cells(spark, sf_dir).groupBy("wb", "sheet_name").agg(F.count("*").alias("cells"), F.count("formula").alias("formulas"), F.count_if(F.col("kind") == "t").alias("texts"))


@query(_FILES + """SELECT wb, 'inconsistent-region' AS detector, 'Parts' AS sheet, 'C5' AS cell, 'SUM(A4,1)*2' AS formula FROM c WHERE slipped
UNION ALL SELECT wb, 'ref-error', 'Parts', 'D' || (k + 1), '#REF!*2' FROM c WHERE lost""")
def q_lint_findings(spark, sf_dir):
    return lint.findings(file_cells(spark, sf_dir)).select("wb", "detector", "sheet", "cell", "formula")


@query(_FILES + "SELECT wb, 'ref-error' AS detector, 'D' || (k + 1) AS cell FROM c WHERE lost")
def q_lint_baseline(spark, sf_dir):
    known = spark.createDataFrame([("inconsistent-region|Parts|C5",)], "key string")
    return lint.new_findings(lint.findings(file_cells(spark, sf_dir)), known).select("wb", "detector", "cell")


@query(_FILES + """SELECT wb, 'C5' AS cell, 'B5=' || max(p_name) FILTER (WHERE k = 4) || '; C4=' || max(stored) FILTER (WHERE k = 3) || '; C6=' || max(stored) FILTER (WHERE k = 5) || '; D5=' || CASE WHEN bool_or(lost) FILTER (WHERE k = 4) THEN '#REF!' ELSE (max(p_size) FILTER (WHERE k = 4) * 2)::DOUBLE::VARCHAR END AS around
FROM v GROUP BY wb HAVING bool_or(slipped)""")
def q_lint_audit(spark, sf_dir):
    own = file_cells(spark, sf_dir)
    found = lint.audit(lint.sampled(lint.findings(own)), own).where("detector = 'inconsistent-region'")
    shown = F.transform("around", lambda x: F.concat(x["cell"], F.lit("="), F.coalesce(x["value"], F.lit(""))))
    return found.select("wb", "cell", F.array_join(shown, "; ").alias("around"))


_ISLANDS = "(SELECT count(*) FROM (SELECT DISTINCT col, odd, island FROM i WHERE i.wb = c.wb))"


@query(_FILES + f"SELECT wb, 2 * count(*) AS cells, any_value({_ISLANDS}) AS families, round(2 * count(*) / any_value({_ISLANDS})::DOUBLE, 4) AS ratio FROM c GROUP BY wb")
def q_coarsening(spark, sf_dir):
    return tidy(lint.coarsening(file_cells(spark, sf_dir)))


@query(_FILES + f"SELECT wb, any_value({_ISLANDS}) AS families, 2 * count(*) AS lanes, 0::BIGINT AS differing FROM c GROUP BY wb")
def q_families_agree(spark, sf_dir):
    return receipt.families_agree(file_cells(spark, sf_dir)).groupBy("wb").agg(F.count("*").alias("families"), F.sum("lanes").alias("lanes"), F.sum("differing").alias("differing"))


_FORMULA = "CASE p_size % 4 WHEN 0 THEN 'SUM(A' || (p_partkey + 1) || ':B' || (p_partkey + 4) || ')' WHEN 1 THEN 'IF(C' || (p_partkey + 1) || '>0,MAX($A$1:$A$9),ROUND(B' || (p_partkey + 1) || ',2))' WHEN 2 THEN 'VLOOKUP(A' || (p_partkey + 1) || ',Sheet2!A:C,2,FALSE)' ELSE '_xlfn.XLOOKUP(A1,[1]X!B:B,\"IF(\"&C1)' END"


def formula_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas made from parts: a workbook for each brand, down the fourth column."""
    own = table(spark, sf_dir, "part")
    return own.select(F.col("p_brand").alias("wb"), F.lit(0).alias("sheet"), F.lit("S").alias("sheet_name"), F.col("p_partkey").cast("int").alias("row"), F.lit(3).alias("col"), F.expr(_FORMULA.replace('\\"', '"')).alias("formula"))


@query("""WITH f AS (SELECT p_brand AS wb, unnest(CASE p_size % 4 WHEN 0 THEN ['SUM'] WHEN 1 THEN ['IF', 'MAX', 'ROUND'] WHEN 2 THEN ['VLOOKUP'] ELSE ['XLOOKUP', '[EXTREF]'] END) AS function FROM part)
SELECT function, count(*) AS cells, count(DISTINCT wb) AS workbooks FROM f GROUP BY 1""")
def q_census_functions(spark, sf_dir):
    return census.census(census.combos(formula_cells(spark, sf_dir)))


@query("""WITH f AS (SELECT p_brand AS wb, p_size % 4 = 3 AS bad FROM part), w AS (SELECT wb, count(*) AS n, count(*) FILTER (WHERE NOT bad) AS good FROM f GROUP BY 1)
SELECT count(*) AS workbooks, round(avg((good = n)::INTEGER), 4) + 0.0 AS full, round(avg((good < n AND good > 0)::INTEGER), 4) + 0.0 AS partial, round(avg((good = 0)::INTEGER), 4) + 0.0 AS refusal, round(sum(good) / sum(n), 4) + 0.0 AS cell_coverage FROM w""")
def q_projection(spark, sf_dir):
    return tidy(census.projection(census.combos(formula_cells(spark, sf_dir)), ["SUM", "IF", "MAX", "ROUND", "VLOOKUP"]))


@query("""WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS function, count(*) AS cells FROM part GROUP BY 1), r AS (SELECT function, cells, sum(cells) OVER (ORDER BY cells DESC, function ROWS UNBOUNDED PRECEDING) / (SELECT sum(cells) FROM w) AS running FROM w)
SELECT function, cells, round(running, 4) + 0.0 AS running FROM r WHERE running - cells / (SELECT sum(cells) FROM w) < 0.8""")
def q_projection_topk(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("function")).groupBy("function").agg(F.count("*").alias("cells"))
    return tidy(census.covering(words, 0.8))


@query("SELECT count(*) AS formulas, count(*) AS ok FROM part")
def q_parse_round_trip(spark, sf_dir):
    own = formula_cells(spark, sf_dir).select(census.round_trip("formula").alias("r"))
    return own.agg(F.count("*").alias("formulas"), F.count_if("r.ok").alias("ok"))


@query("""SELECT CASE p_size % 4 WHEN 0 THEN 'SUM(RC[-3]:R[3]C[-2])' WHEN 1 THEN 'IF(RC[-1]>0.0,MAX(R1C1:R9C1),ROUND(RC[-2],2.0))' WHEN 2 THEN 'VLOOKUP(RC[-3],SHEET2!R1C[-3]:R1048576C[-1],2.0,FALSE)' ELSE replace('XLOOKUP(R[-#]C[-3],[1]X!R1C[-2]:R1048576C[-2],"IF("&R[-#]C[-1])', '[-#]', CASE WHEN p_partkey = 0 THEN '' ELSE '[-' || p_partkey || ']' END) END AS full, count(*) AS n FROM part GROUP BY 1""")
def q_shapes(spark, sf_dir):
    own = lint.shapes(formula_cells(spark, sf_dir), TABLE_ROWS)
    return own.groupBy("full").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, (CASE WHEN p_partkey >= 702 THEN chr((65 + (p_partkey - 702) // 676)::INTEGER) ELSE '' END) || (CASE WHEN p_partkey >= 26 THEN chr((65 + ((p_partkey - 26) // 26) % 26)::INTEGER) ELSE '' END) || chr((65 + p_partkey % 26)::INTEGER) || (p_size + 1) AS name FROM part""")
def q_cell_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", lint.cell_name(F.col("p_size"), F.col("p_partkey")).alias("name"))


# --- receipts

@query("""SELECT class, count(*) AS n FROM (SELECT CASE WHEN e = x THEN 'exact' WHEN e = nextafter(x, 1e300::DOUBLE) OR e = nextafter(x, -1e300::DOUBLE) THEN 'ulp1'
WHEN printf('%.14e', e) = printf('%.14e', x) THEN 'sig15' ELSE 'numeric' END AS class FROM (SELECT x, CASE l_linenumber % 4 WHEN 0 THEN x WHEN 1 THEN nextafter(x, 1e300::DOUBLE) WHEN 2 THEN x * (1 + 1.3e-15::DOUBLE) ELSE x * 1.01::DOUBLE END AS e
FROM (SELECT l_linenumber, l_extendedprice * (1 - l_discount) AS x FROM lineitem))) GROUP BY 1""")
def q_receipt_classify(spark, sf_dir):
    @F.pandas_udf("double")
    def above(x):
        return pd.Series(np.nextafter(x.to_numpy(), 1e300))

    x, k = F.col("x"), F.col("l_linenumber") % 4
    own = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    own = own.withColumn("e", F.when(k == 0, x).when(k == 1, above(x)).when(k == 2, x * (1 + 1.3e-15)).otherwise(x * 1.01))
    return own.groupBy(receipt.column_class(F.col("e"), x).alias("class")).agg(F.count("*").alias("n"))


@query(_FILES + "SELECT 2 * count(*) AS cells, 0::BIGINT AS no_cached, 2 * count(*) - count(*) FILTER (WHERE wrong) AS passed, count(*) FILTER (WHERE wrong) AS mismatch_numeric, 2 * count(*) AS verifiable, round(1 - count(*) FILTER (WHERE wrong) / (2 * count(*))::DOUBLE, 4) + 0.0 AS pass_rate FROM c")
def q_receipt_workbook(spark, sf_dir):
    return tidy(receipt.summary(receipt.report(file_cells(spark, sf_dir))).select("cells", "no_cached", "passed", "mismatch_numeric", "verifiable", "pass_rate"))


@query(_FILES + "SELECT 'SUM' AS function, count(*) - count(*) FILTER (WHERE wrong) AS passed, count(*) AS total, round(1 - count(*) FILTER (WHERE wrong) / count(*)::DOUBLE, 4) + 0.0 AS rate FROM c")
def q_receipt_functions(spark, sf_dir):
    return tidy(receipt.by_function(receipt.report(file_cells(spark, sf_dir))))


@query(_FILES + "SELECT wb, 'C' || (k + 1) AS cell, stored::VARCHAR AS expected, (stored - 1)::VARCHAR AS got FROM v WHERE wrong")
def q_receipt_failures(spark, sf_dir):
    found = receipt.failures(receipt.report(file_cells(spark, sf_dir)), 1 << 30)
    return found.select("wb", lint.cell_name(F.col("row"), F.col("col")).alias("cell"), "expected", "got")


@query("SELECT vote, count(*) AS n FROM (SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'noise' WHEN l_linenumber % 3 = 1 THEN 'real' ELSE 'three-way' END AS vote FROM lineitem) GROUP BY 1")
def q_receipt_vote(spark, sf_dir):
    x = F.col("l_extendedprice")
    third = F.when(F.col("l_linenumber") % 3 == 0, x * 2).when(F.col("l_linenumber") % 3 == 1, x).otherwise(x * 3)
    return table(spark, sf_dir, "lineitem").select(receipt.vote(x, x * 2, third).alias("vote")).groupBy("vote").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey::VARCHAR AS file FROM supplier WHERE s_suppkey % 10 = 0 OR s_suppkey % 7 = 0""")
def q_manifest_verify(spark, sf_dir):
    own = table(spark, sf_dir, "supplier")
    sha = F.sha2("s_name", 256)
    files = own.where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").cast("string").alias("path"), sha.alias("sha256"))
    manifest = own.select(F.col("s_suppkey").cast("string").alias("file"), F.when(F.col("s_suppkey") % 7 == 0, "changed").otherwise(sha).alias("sha256"))
    return xlsx.verified(manifest, files).select("file")


@query("""SELECT sha256, path FROM (SELECT sha256(c_mktsegment || c_nationkey) AS sha256, min('f' || c_custkey) AS path FROM customer WHERE c_acctbal > 0 GROUP BY 1) ORDER BY sha256 LIMIT 20""")
def q_corpus_subset(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.sha2(F.concat("c_mktsegment", "c_nationkey"), 256).alias("sha256"), F.concat(F.lit("f"), "c_custkey").alias("path"), F.when(F.col("c_acctbal") > 0, "ok").otherwise("open_error").alias("status"), F.lit(10).alias("formula_cells"))
    return xlsx.subset(own, 10, 20).select("sha256", "path")


# --- dependencies


@query("""SELECT 0 AS sheet, p_partkey AS row, 0 AS col, (SELECT count(*) FROM supplier WHERE p_partkey BETWEEN s_suppkey AND s_suppkey + s_nationkey) AS n FROM part ORDER BY n DESC, row LIMIT 20""")
def q_auto_inputs(spark, sf_dir):
    cells = table(spark, sf_dir, "part").select(F.lit(0).alias("sheet"), F.col("p_partkey").alias("row"), F.lit(0).alias("col"))
    rects = table(spark, sf_dir, "supplier").select(F.lit(0).alias("sheet"), F.col("s_suppkey").alias("r0"), F.lit(0).alias("c0"), (F.col("s_suppkey") + F.col("s_nationkey")).alias("r1"), F.lit(0).alias("c1"))
    return dependencies.auto_inputs(cells, rects)


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS dst, p_partkey // 3 AS src FROM part WHERE p_partkey > 0), r(node, level) AS (SELECT 5::BIGINT, 0 UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node)
SELECT node, min(level)::INTEGER AS level FROM r GROUP BY 1""")
def q_dep_cone(spark, sf_dir):
    edges = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("dst"), F.floor(F.col("p_partkey") / 3).alias("src"))
    return dependencies.reach(edges, spark.range(5, 6).withColumnRenamed("id", "node"))


@query("SELECT list_reduce(list(o_totalprice * 0.1::DOUBLE ORDER BY o_orderkey), lambda a, b: a + b) AS total FROM orders")
def q_exact_sum(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * 0.1).alias("x"))
    return ordered.ordered_sum(own, ["o_orderkey"], "x").withColumnRenamed("v", "total")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS total FROM orders")
def q_running_total(spark, sf_dir):
    """B_r = B_(r-1) + D_r down a column, as one running sum."""
    own = ordered.with_positions(table(spark, sf_dir, "orders"), ["o_orderkey"], "row")
    out = ordered.running(own, F.col("o_orderkey"), [], F.col("o_totalprice").cast("decimal(18,2)"), "sum", "total")
    return out.select("o_orderkey", "row", F.col("total").cast("double").alias("total"))


# --- draws and scenarios

DRAWS, SEED = 2000, (3 << 32) | 20240607


def philox_sql(index: int, n: int = DRAWS, seed: int = SEED) -> str:
    """The uniform draws in SQL: 128-bit products, rounds unrolled as nested selects."""
    word = 1 << 32
    sql = f"SELECT k, {index}::HUGEINT AS a, k::HUGEINT AS b, 0::HUGEINT AS c, {R.TAG}::HUGEINT AS d FROM range({n}) r(k)"
    low, high = seed & R.WORD, seed >> 32 & R.WORD
    for _ in range(R.ROUNDS):
        p, q = f"({R.MULTIPLIERS[0]}::HUGEINT * a)", f"({R.MULTIPLIERS[1]}::HUGEINT * c)"
        x = lambda *parts: "xor(" * (len(parts) - 1) + f"({parts[0]})::UBIGINT" + "".join(f", ({p})::UBIGINT)" for p in parts[1:])
        sql = f"SELECT k, {x(f'{q} // {word}', 'b', str(low))}::HUGEINT AS a, {q} % {word} AS b, {x(f'{p} // {word}', 'd', str(high))}::HUGEINT AS c, {p} % {word} AS d FROM ({sql})"
        low, high = (low + R.INCREMENTS[0]) & R.WORD, (high + R.INCREMENTS[1]) & R.WORD
    return f"SELECT k, (xor((a * {1 << 21})::UBIGINT, b::UBIGINT) % {1 << 53}::UBIGINT + 0.5::DOUBLE) * {2.0**-53!r}::DOUBLE AS u FROM ({sql})"


def horner_sql(coefficients, x: str) -> str:
    out = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def normal_sql(u: str) -> str:
    q, r = f"({u} - 0.5::DOUBLE)", f"({R.SQUARE}::DOUBLE - ({u} - 0.5::DOUBLE) * ({u} - 0.5::DOUBLE))"
    t = f"sqrt(-ln(CASE WHEN {u} < 0.5 THEN {u} ELSE 1 - {u} END))"
    near, far = f"({t} - {R.STEP}::DOUBLE)", f"({t} - {R.NEAR}::DOUBLE)"
    tail = f"(CASE WHEN {t} <= {R.NEAR} THEN {horner_sql(R.AS241[1][0], near)} / {horner_sql(R.AS241[1][1], near)} ELSE {horner_sql(R.AS241[2][0], far)} / {horner_sql(R.AS241[2][1], far)} END)"
    return f"(CASE WHEN abs{q} <= {R.MIDDLE} THEN {q} * {horner_sql(R.AS241[0][0], r)} / {horner_sql(R.AS241[0][1], r)} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"


DISTRIBUTIONS = {
    "normal": ("normal(50,5)", f"50 + 5 * {normal_sql('u')}"), "lognormal": ("lognormal(0.2,0.5)", f"exp(0.2::DOUBLE + 0.5::DOUBLE * {normal_sql('u')})"), "uniform": ("uniform(-1,5)", "-1 + 6 * u"),
    "triangular": ("triangular(1,4,11)", "CASE WHEN u < 0.3 THEN 1 + sqrt(30 * u) ELSE 11 - sqrt(70 * (1 - u)) END"),
}


def stats_sql(inner: str) -> str:
    place = lambda p: f"max(x) FILTER (WHERE rn = floor((n - 1) * {p}::DOUBLE))"
    return (
        f"SELECT max(n) AS n, round(avg(x), 4) + 0.0 AS mean, round(stddev_pop(x), 4) + 0.0 AS sd, round({place(0.05)}, 4) + 0.0 AS p5, round({place(0.5)}, 4) + 0.0 AS p50, round({place(0.95)}, 4) + 0.0 AS p95 "
        f"FROM (SELECT x, count(*) OVER () AS n, row_number() OVER (ORDER BY x) - 1 AS rn FROM ({inner}))"
    )


@query(f"SELECT k AS scenario, round(u, 12) AS u FROM ({philox_sql(3)})")
def q_philox_uniform(spark, sf_dir):
    own = R.with_uniform(spark.range(DRAWS).withColumnRenamed("id", "scenario"), "scenario", SEED, 3, "u")
    return own.select("scenario", F.round("u", 12).alias("u"))


def _stats(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = R.with_uniform(spark.range(DRAWS), "id", SEED, 0, "u")
        return tidy(scenario.statistics(own.select(R.parse_distribution(text).column(F.col("u")).alias("value"))))

    QUERIES[f"q_mc_{name}_stats"] = run
    SQL[f"q_mc_{name}_stats"] = stats_sql(f"SELECT {sql} AS x FROM ({philox_sql(0)})")


for _name, (_text, _sql) in DISTRIBUTIONS.items():
    _stats(_name, _text, _sql)


@query()
def q_mc_pert(spark, sf_dir):
    own = model({"A1": 4.0, "B1": "A1*2"})
    return tidy(scenario.statistics(scenario.monte_carlo(spark, own, [((0, 0, 0), R.parse_distribution("pert(1,4,11)"))], DRAWS, SEED)))


PRICES = {"A1": 50.0, "A2": 3.0, "B1": "A1*1.5+A2", "B2": "IF(B1>80,B1*0.9,B1)", "B3": "SUM(B1:B2)"}


@query(stats_sql(f"SELECT b + CASE WHEN b > 80 THEN b * 0.9::DOUBLE ELSE b END AS x FROM (SELECT (50 + 5 * {normal_sql('u')}) * 1.5::DOUBLE + 3 AS b FROM ({philox_sql(0)}))"))
def q_mc_model(spark, sf_dir):
    return tidy(scenario.statistics(scenario.monte_carlo(spark, model(PRICES), [((0, 0, 0), R.parse_distribution("normal(50,5)"))], DRAWS, SEED, [(0, 2, 1)])))


_BINS = """SELECT b.bin::INTEGER AS bin, round(lo + b.bin * w, 4) + 0.0 AS low, round(lo + (b.bin + 1) * w, 4) + 0.0 AS high, coalesce(n, 0) AS n, round(sum(coalesce(n, 0)) OVER (ORDER BY b.bin ROWS UNBOUNDED PRECEDING) / total, 4) + 0.0 AS cumulative
FROM range(40) b(bin) CROSS JOIN (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 40 AS w, count(*) AS total FROM orders) e
LEFT JOIN (SELECT least(floor((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT (max(o_totalprice) - min(o_totalprice)) / 40 FROM orders)), 39) AS bin, count(*) AS n FROM orders GROUP BY 1) c ON c.bin = b.bin"""


@query(_BINS)
def q_histogram(spark, sf_dir):
    return tidy(scenario.histogram(table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("value"))))


def segments(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Revenue by order state, by criteria sums."""
    sums = {s: f'ROUND(SUMIF(orders!C:C,"{s}",orders!D:D),2)' for s in "FOP"}
    own = tables(spark, sf_dir, sums.values()).evaluate(sums).first()
    return {s: float(own[s]) for s in "FOP"}


def revenue(spark: SparkSession, sf_dir: str) -> Workbook:
    by = segments(spark, sf_dir)
    return model({"A1": by["F"], "A2": by["O"], "A3": by["P"], "A4": 0.06, "B1": "A1*(1-A4)", "B2": "A2*(1-A4*2)", "B3": "A3", "B4": "SUM(B1:B3)"})


_BY = "SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS f, sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'O')::DOUBLE AS o, sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'P')::DOUBLE AS p FROM orders"


@query(f"SELECT round(x, 4) + 0.0 AS x, 'S!B4' AS cell, round(f * (1 - x) + o * (1 - 2 * x) + p, 2) + 0.0 AS value FROM ({_BY}) CROSS JOIN (SELECT i * 0.2::DOUBLE / 20 AS x FROM range(21) r(i))")
def q_whatif_curve(spark, sf_dir):
    out = scenario.curve(spark, revenue(spark, sf_dir), (0, 3, 0), 0.0, 0.2, 21, [(0, 3, 1)])
    return out.select((F.round("x", 4) + 0.0).alias("x"), "cell", (F.round("value", 2) + 0.0).alias("value"))


@query(f"SELECT input, round(abs(high - low), 2) + 0.0 AS swing FROM (SELECT unnest(['S!A1', 'S!A2', 'S!A3', 'S!A4']) AS input, unnest([f * 0.94 * 0.9, o * 0.88 * 0.9, p * 0.9, f * (1 - 0.054) + o * (1 - 0.108)]) AS low, unnest([f * 0.94 * 1.1, o * 0.88 * 1.1, p * 1.1, f * (1 - 0.066) + o * (1 - 0.132)]) AS high FROM ({_BY}))")
def q_tornado(spark, sf_dir):
    out = scenario.tornado(spark, revenue(spark, sf_dir), [(0, i, 0) for i in range(4)], (0, 3, 1))
    return out.select("input", (F.round("swing", 2) + 0.0).alias("swing"))


@query("SELECT round(sqrt(3), 9) AS x")
def q_goal_seek(spark, sf_dir):
    x = scenario.goal_seek(spark, model({"A1": 2.0, "A2": 3.0, "B1": "A1*A1-A2"}), (0, 0, 0), (0, 0, 1), 0.0, 0.0, 10.0)
    return spark.createDataFrame([(x,)], "x double").select(F.round("x", 9).alias("x"))


@query(f"SELECT round(f * -1 + o * -2, 2) + 0.0 AS by_discount, round(0.94::DOUBLE, 6) AS by_f, round(f * 0.94 + o * 0.88 + p, 2) + 0.0 AS value FROM ({_BY})")
def q_ad_gradient(spark, sf_dir):
    own = revenue(spark, sf_dir)
    g = gradients.gradient(own, {(0, 3, 0): 0.06, (0, 0, 0): own.sheets[0].values[0, 0]}, (0, 3, 1))
    row = spark.createDataFrame([(float(g.by[0, 3, 0][0]), float(g.by[0, 0, 0][0]), float(g.values[0]))], "a double, b double, v double")
    return row.select((F.round("a", 2) + 0.0).alias("by_discount"), F.round("b", 6).alias("by_f"), (F.round("v", 2) + 0.0).alias("value"))


@query(f"SELECT 500::BIGINT AS scenarios, 500::BIGINT AS diverged, 0::BIGINT AS witness, round((50 + 5 * {normal_sql('u')}), 6) AS input FROM ({philox_sql(0, 1)})")
def q_diff_witness(spark, sf_dir):
    two = dict(PRICES) | {"B1": "A1*1.51+A2"}
    r = diff.report(spark, model(PRICES), model(two), [((0, 0, 0), R.parse_distribution("normal(50,5)"))], (0, 2, 1), 500, SEED)
    w = r["witness"]
    row = spark.createDataFrame([(r["scenarios"], r["diverged"], w["scenario"], w["inputs"][0, 0, 0])], "scenarios long, diverged long, witness long, input double")
    return row.withColumn("input", F.round("input", 6))


@query("SELECT s.s_suppkey, CASE WHEN c.s_suppkey % 5 = 0 THEN 'removed' WHEN c.s_suppkey % 7 = 0 THEN 'value' END AS change FROM supplier s JOIN supplier c USING (s_suppkey) WHERE s.s_suppkey % 5 = 0 OR s.s_suppkey % 7 = 0")
def q_cell_changes(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(F.lit("S").alias("sheet_name"), F.col("s_suppkey").alias("row"), F.lit(0).alias("col"), F.lit("n").alias("kind"), F.col("s_acctbal").alias("num"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("formula"))
    other = own.where("row % 5 <> 0").withColumn("num", F.when(F.col("row") % 7 == 0, F.col("num") + 1).otherwise(F.col("num")))
    return diff.cell_changes(own, other).select(F.col("row").alias("s_suppkey"), "change")


# --- the flagship: revenue by region under an uncertain discount


def flagship(spark: SparkSession, sf_dir: str, n: int = 1000) -> DataFrame:
    """region, n, mean, sd, p5, p50, p95: each customer's region by nested lookups and revenue by criteria sums, then a sweep
    over discounts."""
    formulas = {"region": "VLOOKUP(VLOOKUP(C1,nation!A:C,3,FALSE),region!A:B,2,FALSE)", "revenue": "SUMIFS(orders!D:D,orders!B:B,A1)"}
    customers = tables(spark, sf_dir, formulas.values(), "customer").fill("customer", formulas, keep=["c_custkey"])
    base = customers.groupBy("region").agg(F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("revenue"))
    draws = R.with_uniform(spark.range(n).withColumnRenamed("id", "scenario"), "scenario", SEED, 0, "u")
    draws = draws.select("scenario", R.parse_distribution("normal(0.06,0.02)").column(F.col("u")).alias("discount"))
    swept = base.crossJoin(draws).select("region", (F.col("revenue") * (1 - F.col("discount"))).alias("value"))  # five regions
    return tidy(scenario.statistics(swept, by=["region"]), 2)


_REVENUE = "SELECT r_name AS region, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS revenue FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1"


@query(
    "SELECT region, max(n) AS n, round(avg(x), 2) + 0.0 AS mean, round(stddev_pop(x), 2) + 0.0 AS sd, round(max(x) FILTER (WHERE rn = floor((n - 1) * 0.05::DOUBLE)), 2) + 0.0 AS p5, round(max(x) FILTER (WHERE rn = floor((n - 1) * 0.5::DOUBLE)), 2) + 0.0 AS p50, round(max(x) FILTER (WHERE rn = floor((n - 1) * 0.95::DOUBLE)), 2) + 0.0 AS p95 "
    f"FROM (SELECT region, x, count(*) OVER (PARTITION BY region) AS n, row_number() OVER (PARTITION BY region ORDER BY x) - 1 AS rn FROM (SELECT region, revenue * (1 - (0.06::DOUBLE + 0.02::DOUBLE * {normal_sql('u')})) AS x FROM ({_REVENUE}) CROSS JOIN ({philox_sql(0, 1000)}))) GROUP BY region"
)
def q_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

