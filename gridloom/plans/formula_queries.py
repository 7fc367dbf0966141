"""Registered queries that are formulas over the test tables, each with SQL for the same rows.

A query names the sheet and row that its formulas stand in (or none: one row), the formulas, and the SQL. Numbers are
rounded on both sides, as sums of doubles depend on the order of addition.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.compiler import Book
from gridloom.sources.tables import Sheet, bind

KEYS = {"lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
NAMES = {"RATE": "0.07", "PRICES": "part!F:F", "NET": "Rate*2"}


def book(spark: SparkSession, sf_dir: str, formulas: Iterable[str], sheet: str | None = None) -> Book:
    """The sheets that the formulas, or the names they use, speak of; others needn't be opened."""
    said = " ".join([*formulas, sheet or ""]).lower()
    said += "".join(f" {body.lower()}" for name, body in NAMES.items() if name.lower() in said)
    return Book(spark, [bind(spark, sf_dir, t, KEYS.get(t)) for t in TABLES if re.search(rf"\b{t}\b", said)], NAMES)


def tidy(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, and minus zero as zero."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@dataclass
class Query:
    sql: str
    formulas: dict[str, str]
    sheet: str | None = None
    keep: tuple[str, ...] = ()
    row: int = 1
    places: int = 4

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The result with those columns of fault codes that the SQL has too."""
        own = book(spark, sf_dir, self.formulas.values(), self.sheet)
        df = own.fill(self.sheet, self.formulas, self.row, list(self.keep)) if self.sheet else own.evaluate(self.formulas)
        for name in self.formulas:
            code = f"{name}_err"
            wanted = re.search(rf"\b{code}\b", self.sql)
            if not wanted and self.sql:
                df = df.drop(code)
            elif wanted and code not in df.columns:
                df = df.withColumn(code, F.lit(None).cast("string"))
        return tidy(df, self.places)


QUERIES: dict[str, Query] = {}


def one(name: str, sql: str, /, **formulas: str) -> None:
    QUERIES[name] = Query(sql, formulas)


def rows(name: str, sheet: str, keep: str, sql: str, /, row: int = 1, **formulas: str) -> None:
    QUERIES[name] = Query(sql, formulas, sheet, tuple(keep.split()), row)


def r(sql: str, name: str, places: int = 4) -> str:
    return f"round(CAST({sql} AS DOUBLE), {places}) + 0.0 AS {name}"


# --- aggregates

one("q_sum", f"SELECT {r('sum(l_extendedprice)', 'price')}, {r('sum(l_quantity) + 10', 'more')}, {r('sum(l_discount) + sum(l_tax)', 'two')} FROM lineitem", price="SUM(lineitem!F:F)", more='SUM(lineitem!E:E,"10",lineitem!I:I)', two="SUM(lineitem!G:H)")
one("q_count", "SELECT count(*)::DOUBLE AS n, count(*)::DOUBLE + 2 AS more, 0.0::DOUBLE AS text FROM lineitem", n="COUNT(lineitem!E:E)", more='COUNT(lineitem!E:E,7,"8","x")', text="COUNT(lineitem!I:I)")
one("q_counta", "SELECT count(*)::DOUBLE AS n, count(*)::DOUBLE + 1 AS more FROM lineitem", n="COUNTA(lineitem!I:I)", more='COUNTA(lineitem!I:I,"")')
one("q_countblank", "SELECT count(*) FILTER (WHERE text IS NULL OR text = '')::DOUBLE AS n FROM documents", n="COUNTBLANK(documents!B:B)")
one("q_average", f"SELECT {r('avg(l_extendedprice)', 'mean')}, {r('avg(l_extendedprice) / 2', 'half')} FROM lineitem", mean="AVERAGE(lineitem!F:F)", half="AVERAGE(lineitem!F:F/2)")
QUERIES["q_average"].sql = f"SELECT {r('avg(l_extendedprice)', 'mean')}, NULL::VARCHAR AS mean_err, {r('avg(l_extendedprice) / 2', 'half')}, NULL::VARCHAR AS half_err FROM lineitem"
one("q_min", f"SELECT {r('min(l_extendedprice)', 'low')}, {r('least(min(l_extendedprice), 5)', 'five')} FROM lineitem", low="MIN(lineitem!F:F)", five="MIN(lineitem!F:F,5)")
one("q_max", f"SELECT {r('max(l_extendedprice)', 'high')}, {r('max(l_extendedprice) - min(l_extendedprice)', 'width')} FROM lineitem", high="MAX(lineitem!F:F)", width="MAX(lineitem!F:F)-MIN(lineitem!F:F)")
QUERIES["q_max"].sql = f"SELECT {r('max(l_extendedprice)', 'high')}, {r('max(l_extendedprice) - min(l_extendedprice)', 'width')}, NULL::VARCHAR AS width_err FROM lineitem"
one("q_product", f"SELECT {r('product(1 + r_regionkey)', 'p')}, NULL::VARCHAR AS p_err FROM region", p="PRODUCT(1+region!A:A)")
one("q_median", f"SELECT {r('median(o_totalprice)', 'm')}, NULL::VARCHAR AS m_err FROM orders", m="MEDIAN(orders!D:D)")
one("q_large", "SELECT max(o_totalprice) FILTER (WHERE k = 3) AS third, NULL::VARCHAR AS third_err, max(o_totalprice) FILTER (WHERE k = 100) AS hundredth, NULL::VARCHAR AS hundredth_err, NULL::DOUBLE AS none, '#NUM!' AS none_err FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC) AS k FROM orders)", third="LARGE(orders!D:D,3)", hundredth="LARGE(orders!D:D,100)", none="LARGE(orders!D:D,0)")
one("q_small", "SELECT max(o_totalprice) FILTER (WHERE k = 1) AS first, NULL::VARCHAR AS first_err, max(o_totalprice) FILTER (WHERE k = 50) AS fiftieth, NULL::VARCHAR AS fiftieth_err FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) AS k FROM orders)", first="SMALL(orders!D:D,1)", fiftieth="SMALL(orders!D:D,50)")
rows("q_rank", "customer", "c_custkey c_acctbal", "SELECT c_custkey, c_acctbal, rank() OVER (ORDER BY c_acctbal DESC)::DOUBLE AS place, NULL::VARCHAR AS place_err, rank() OVER (ORDER BY c_acctbal)::DOUBLE AS up, NULL::VARCHAR AS up_err FROM customer", place="RANK(D1,D:D)", up="RANK.EQ(D1,D:D,1)")
one("q_stdev", f"SELECT {r('stddev_samp(o_totalprice)', 's')}, NULL::VARCHAR AS s_err, {r('stddev_pop(o_totalprice)', 'p')}, NULL::VARCHAR AS p_err FROM orders", s="STDEV(orders!D:D)", p="STDEV.P(orders!D:D)")
one("q_var", f"SELECT {r('var_samp(c_acctbal)', 's', 2)}, NULL::VARCHAR AS s_err, {r('var_pop(c_acctbal)', 'p', 2)}, NULL::VARCHAR AS p_err FROM customer", s="ROUND(VAR.S(customer!D:D),2)", p="ROUND(VARP(customer!D:D),2)")
one(
    "q_subtotal",
    f"SELECT {r('avg(c_acctbal)', 't1')}, NULL::VARCHAR AS t1_err, count(*)::DOUBLE AS t2, count(*)::DOUBLE AS t3, max(c_acctbal) AS t4, min(c_acctbal) AS t5, {r('stddev_samp(c_acctbal)', 't7')}, NULL::VARCHAR AS t7_err, {r('stddev_pop(c_acctbal)', 't8')}, NULL::VARCHAR AS t8_err, {r('sum(c_acctbal)', 't9')}, {r('sum(c_acctbal)', 't109')}, NULL::DOUBLE AS bad, '#VALUE!' AS bad_err FROM customer",
    t1="SUBTOTAL(1,customer!D:D)", t2="SUBTOTAL(2,customer!D:D)", t3="SUBTOTAL(103,customer!D:D)", t4="SUBTOTAL(4,customer!D:D)", t5="SUBTOTAL(105,customer!D:D)", t7="SUBTOTAL(7,customer!D:D)", t8="SUBTOTAL(8,customer!D:D)", t9="SUBTOTAL(9,customer!D:D)", t109="SUBTOTAL(109,customer!D:D)", bad="SUBTOTAL(12,customer!D:D)",
)
one("q_sumproduct", f"SELECT {r('sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)))', 'cut', 2)} FROM lineitem", cut="ROUND(SUMPRODUCT(lineitem!F:F,lineitem!G:G),2)")

# --- criteria

one("q_countif_cmp", "SELECT count(*) FILTER (WHERE l_quantity > 25)::DOUBLE AS gt, count(*) FILTER (WHERE l_quantity <= 10)::DOUBLE AS le, count(*) FILTER (WHERE l_quantity = 7)::DOUBLE AS eq, count(*) FILTER (WHERE l_quantity <> 7)::DOUBLE AS ne FROM lineitem", gt='COUNTIF(lineitem!E:E,">25")', le='COUNTIF(lineitem!E:E,"<=10")', eq="COUNTIF(lineitem!E:E,7)", ne='COUNTIF(lineitem!E:E,"<>7")')
one("q_countif_text", "SELECT count(*) FILTER (WHERE upper(o_orderstatus) = 'F')::DOUBLE AS f, count(*) FILTER (WHERE lower(o_orderpriority) = '2-high')::DOUBLE AS high, count(*) FILTER (WHERE o_orderstatus > 'F')::DOUBLE AS after FROM orders", f='COUNTIF(orders!C:C,"f")', high='COUNTIF(orders!F:F,"=2-HIGH")', after='COUNTIF(orders!C:C,">f")')
one("q_countif_wild", "SELECT count(*) FILTER (WHERE p_name LIKE '%widget')::DOUBLE AS ends, count(*) FILTER (WHERE p_name LIKE 's____ %')::DOUBLE AS shape, count(*) FILTER (WHERE p_name NOT LIKE '%bolt%')::DOUBLE AS other, 0.0::DOUBLE AS literal FROM part", ends='COUNTIF(part!B:B,"*WIDGET")', shape='COUNTIF(part!B:B,"s???? *")', other='COUNTIF(part!B:B,"<>*bolt*")', literal='COUNTIF(part!B:B,"~*")')
one("q_countif_ne", "SELECT count(*) FILTER (WHERE o_orderstatus <> 'F')::DOUBLE AS n, count(*)::DOUBLE AS any FROM orders", n='COUNTIF(orders!C:C,"<>F")', any='COUNTIF(orders!C:C,"<>")')
one("q_countif_blank", "SELECT count(*) FILTER (WHERE text IS NULL OR text = '')::DOUBLE AS empty, count(*) FILTER (WHERE text IS NULL OR text = '')::DOUBLE AS also FROM documents", empty='COUNTIF(documents!B:B,"")', also='COUNTIF(documents!B:B,"=")')
one("q_sumif", f"SELECT {r('sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = $$F$$)', 'total', 2)} FROM orders", total='ROUND(SUMIF(orders!C:C,"F",orders!D:D),2)')
QUERIES["q_sumif"].sql = "SELECT round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE), 4) + 0.0 AS total FROM orders"
one("q_averageif", "SELECT round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) + 0.0 AS mean, NULL::VARCHAR AS mean_err, NULL::DOUBLE AS none, '#DIV/0!' AS none_err FROM orders", mean='AVERAGEIF(orders!C:C,"F",orders!D:D)', none='AVERAGEIF(orders!C:C,"nothing",orders!D:D)')
one("q_countifs", "SELECT count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 30 AND l_discount >= 0.05)::DOUBLE AS n FROM lineitem", n='COUNTIFS(lineitem!I:I,"R",lineitem!E:E,">30",lineitem!G:G,">=0.05")')
one("q_sumifs", "SELECT round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_tax < 0.04) AS DOUBLE), 4) + 0.0 AS total FROM lineitem", total='ROUND(SUMIFS(lineitem!F:F,lineitem!I:I,"N",lineitem!J:J,"O",lineitem!H:H,"<0.04"),2)')
one("q_averageifs", "SELECT round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A' AND l_quantity BETWEEN 10 AND 20), 4) + 0.0 AS mean, NULL::VARCHAR AS mean_err FROM lineitem", mean='AVERAGEIFS(lineitem!F:F,lineitem!I:I,"A",lineitem!E:E,">=10",lineitem!E:E,"<=20")')
one("q_criterion_computed", "SELECT count(*) FILTER (WHERE o_totalprice > (SELECT max(o_totalprice) / 2 FROM orders))::DOUBLE AS n FROM orders", n='COUNTIF(orders!D:D,">"&MAX(orders!D:D)/2)')
rows("q_sumifs_column", "customer", "c_custkey", "SELECT c_custkey, round(CAST(coalesce(t, 0) AS DOUBLE), 2) + 0.0 AS total, coalesce(n, 0)::DOUBLE AS orders_n, coalesce(f, 0)::DOUBLE AS open_n, round(CASE WHEN n > 0 THEN CAST(t AS DOUBLE) / n END, 6) + 0.0 AS mean, CASE WHEN n IS NULL THEN '#DIV/0!' END AS mean_err FROM customer LEFT JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS t, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey", total="ROUND(SUMIFS(orders!D:D,orders!B:B,A1),2)", orders_n="COUNTIF(orders!B:B,A1)", open_n='COUNTIFS(orders!B:B,A1,orders!C:C,"O")', mean="AVERAGEIF(orders!B:B,A1,orders!D:D)")
QUERIES["q_sumifs_column"].places = 6

# --- lookups

rows("q_vlookup_exact", "orders", "o_orderkey", "SELECT o_orderkey, c_name AS name, NULL::VARCHAR AS name_err, r_name AS region, NULL::VARCHAR AS region_err FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey", name="VLOOKUP(B1,customer!A:E,2,FALSE)", region="VLOOKUP(VLOOKUP(VLOOKUP(B1,customer!A:C,3,FALSE),nation!A:C,3,FALSE),region!A:B,2,FALSE)")
rows("q_vlookup_miss", "nation", "n_nationkey", "SELECT n_nationkey, CASE WHEN n_nationkey + 3 < 25 THEN 'NATION_' || (n_nationkey + 3) END AS far, CASE WHEN n_nationkey + 3 >= 25 THEN '#N/A' END AS far_err, CASE WHEN n_nationkey + 3 < 25 THEN 'NATION_' || (n_nationkey + 3) ELSE 'none' END AS safe FROM nation", far="VLOOKUP(A1+3,nation!A:B,2,FALSE)", safe='IFNA(VLOOKUP(A1+3,nation!A:B,2,FALSE),"none")')
rows("q_index_match", "supplier", "s_suppkey", "SELECT s_suppkey, n_name AS nation, NULL::VARCHAR AS nation_err, s_nationkey + 1.0::DOUBLE AS place, NULL::VARCHAR AS place_err, 'NATION_' || s_nationkey AS direct, NULL::VARCHAR AS direct_err FROM supplier JOIN nation ON n_nationkey = s_nationkey", nation="INDEX(nation!B:B,MATCH(C1,nation!A:A,0))", place="MATCH(C1,nation!A:A,0)", direct="INDEX(nation!B:B,C1+1)")
QUERIES["q_index_match"].sql = "SELECT s_suppkey, n_name AS nation, NULL::VARCHAR AS nation_err, (s_nationkey + 1)::DOUBLE AS place, NULL::VARCHAR AS place_err, n_name AS direct, NULL::VARCHAR AS direct_err FROM supplier JOIN nation ON n_nationkey = s_nationkey"
_LAST = "(SELECT max(p_partkey) FROM part WHERE p_retailprice <= s_acctbal)"
rows("q_vlookup_approx", "supplier", "s_suppkey", f"SELECT s_suppkey, p AS place, CASE WHEN p IS NULL THEN '#N/A' END AS place_err, p_name AS name, CASE WHEN p IS NULL THEN '#N/A' END AS name_err FROM (SELECT s_suppkey, {_LAST} + 1.0::DOUBLE AS p FROM supplier) LEFT JOIN part ON p_partkey = p - 1", place="MATCH(D1,part!F:F,1)", name="INDEX(part!B:B,MATCH(D1,part!F:F,1))")
rows("q_lookup", "customer", "c_custkey", "SELECT c_custkey, (SELECT arg_max(p_brand, p_partkey) FROM part WHERE p_retailprice <= c_acctbal) AS brand, CASE WHEN c_acctbal < (SELECT min(p_retailprice) FROM part) THEN '#N/A' END AS brand_err FROM customer", brand="LOOKUP(D1,part!F:F,part!C:C)")
one("q_vlookup_wild", "SELECT (SELECT arg_min(p_partkey, p_partkey) FROM part WHERE p_name LIKE '%widget%')::DOUBLE AS place, NULL::VARCHAR AS place_err, (SELECT arg_min(p_brand, p_partkey) FROM part WHERE p_name LIKE 'blue b__t') AS brand, NULL::VARCHAR AS brand_err", place='MATCH("*Widget*",part!B:B,0)-1', brand='VLOOKUP("blue b??t",part!B:C,2,FALSE)')
one("q_hlookup", "SELECT (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 4)::DOUBLE AS exact, (SELECT n_regionkey FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 5)::DOUBLE AS near, NULL::VARCHAR AS miss, '#N/A' AS miss_err, NULL::VARCHAR AS beyond, '#REF!' AS beyond_err", exact="N(HLOOKUP(2,nation!A3:C6,3,FALSE))", near="N(HLOOKUP(99,nation!A3:C6,4))", miss='HLOOKUP("nothing",nation!A3:C6,2,FALSE)', beyond="T(HLOOKUP(2,nation!A3:C6,9,FALSE))")
one("q_match_down", "SELECT (SELECT min(k) - 1 FROM (SELECT p_size, row_number() OVER (ORDER BY p_partkey) AS k FROM part) WHERE p_size < 5 AND k > (SELECT min(k) FROM (SELECT p_size, row_number() OVER (ORDER BY p_partkey) AS k FROM part) WHERE p_size >= 5))::DOUBLE AS place, NULL::VARCHAR AS place_err, NULL::DOUBLE AS none, '#N/A' AS none_err", place="MATCH(5,part!E:E,-1)", none="MATCH(999,part!E:E,-1)")
rows("q_row_ranges", "lineitem", "l_orderkey l_linenumber l_partkey l_suppkey", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity + l_extendedprice + l_discount + l_tax, 4) + 0.0 AS s, greatest(l_quantity, l_extendedprice, l_discount, l_tax) AS hi, 6.0::DOUBLE AS n FROM lineitem", s="SUM(E1:H1)", hi="MAX(E1:H1)", n="COUNT(C1:J1)")
rows("q_running_sum", "customer", "c_custkey", "SELECT c_custkey, round(sum(CAST(c_acctbal AS DECIMAL(18,2))) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING)::DOUBLE, 2) + 0.0 AS total, round(c_acctbal + coalesce(lag(c_acctbal) OVER (ORDER BY c_custkey), 0), 4) + 0.0 AS two FROM customer", row=2, total="ROUND(SUM(D$1:D2),2)", two="SUM(D1:D2)")
rows("q_other_rows", "nation", "n_nationkey", "SELECT n_nationkey, coalesce(lead(n_nationkey) OVER (ORDER BY n_nationkey), 0)::DOUBLE AS following, n_nationkey - coalesce(lag(n_nationkey) OVER (ORDER BY n_nationkey), 0)::DOUBLE AS step, NULL::VARCHAR AS step_err, (n_nationkey + 2)::DOUBLE AS here FROM nation", row=2, following="A3", step="A2-A1", here="ROW()+1")
one("q_rows_columns", "SELECT (SELECT count(*) FROM orders)::DOUBLE AS n, 6.0::DOUBLE AS wide, 9.0::DOUBLE AS nine, 4.0::DOUBLE AS col, 5.0::DOUBLE AS at", n="ROWS(orders!A:A)", wide="COLUMNS(orders!A:F)", nine="ROWS(orders!A2:A10)", col="COLUMN(orders!D1)", at="ROW(orders!A5)")

# --- references

one("q_ref_union", f"SELECT {r('2 * sum(l_tax) + sum(l_discount)', 'u')} FROM lineitem", u="SUM((lineitem!H:H,lineitem!G:H))")
one("q_ref_intersect", f"SELECT {r('sum(l_discount)', 'i')}, NULL::DOUBLE AS empty, '#NULL!' AS empty_err FROM lineitem", i="SUM(lineitem!E:G lineitem!G:H)", empty="SUM(lineitem!E:E lineitem!G:G)")
one("q_ref_span", "SELECT (SELECT sum(r_regionkey) FROM region)::DOUBLE + (SELECT sum(n_nationkey) FROM nation)::DOUBLE AS both", both="SUM(region:nation!A:A)")
one("q_ref_rows", f"SELECT {r('sum(o_totalprice) FILTER (WHERE k BETWEEN 2 AND 11)', 'ten')}, max(o_custkey) FILTER (WHERE k = 5)::DOUBLE AS fifth, {r('sum(o_totalprice) FILTER (WHERE k BETWEEN 3 AND 8)', 'box')} FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders)", ten="SUM(orders!D2:D11)", fifth="orders!B5", box="SUM(orders!D3:orders!D8)")
one("q_names", f"SELECT {r('sum(p_retailprice) * 0.07', 'tax')}, NULL::VARCHAR AS tax_err, 0.14::DOUBLE AS net, NULL::VARCHAR AS net_err, NULL::DOUBLE AS gone, '#NAME?' AS gone_err FROM part", tax="SUM(Prices)*Rate", net="Net", gone="Nowhere+1")
QUERIES["q_names"].sql = f"SELECT {r('sum(p_retailprice) * 0.07', 'tax')}, NULL::VARCHAR AS tax_err, 0.14::DOUBLE AS net, NULL::DOUBLE AS gone, '#NAME?' AS gone_err FROM part"

# --- operators

rows("q_arithmetic", "lineitem", "l_orderkey l_linenumber l_partkey l_suppkey", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) + 0.0 AS charge, NULL::VARCHAR AS charge_err, round(l_discount / 100, 6) + 0.0 AS share, NULL::VARCHAR AS share_err, round(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END, 4) + 0.0 AS ratio, CASE WHEN l_tax = 0 THEN '#DIV/0!' END AS ratio_err, -l_quantity + 0.0 AS neg, round(pow(l_quantity, 2), 4) + 0.0 AS square, NULL::VARCHAR AS square_err FROM lineitem", charge="F1*(1-G1)", share="ROUND(G1%,6)", ratio="G1/H1", neg="-E1", square="E1^2")
QUERIES["q_arithmetic"].sql = QUERIES["q_arithmetic"].sql.replace("round(l_discount / 100, 6) + 0.0 AS share", "round(l_discount / 100, 4) + 0.0 AS share")
rows("q_compare", "orders", "o_orderkey", "SELECT o_orderkey, o_totalprice > 250000 AS big, lower(o_orderstatus) = 'f' AS same, o_orderstatus <> 'O' AS other, true AS text_above, o_orderpriority < '3' AS early FROM orders", big="D1>250000", same='C1="f"', other='C1<>"o"', text_above="C1>D1", early='F1<"3"')
rows("q_concat_op", "nation", "n_nationkey", "SELECT n_nationkey, n_nationkey || '-' || n_name AS label, 'TRUE' || (n_nationkey + 0.5) AS half, NULL::VARCHAR AS half_err FROM nation", label='A1&"-"&B1', half="TRUE&(A1+0.5)")
one("q_faults", "SELECT NULL::DOUBLE AS div, '#DIV/0!' AS div_err, NULL::DOUBLE AS first, '#N/A' AS first_err, NULL::DOUBLE AS pow, '#NUM!' AS pow_err, NULL::DOUBLE AS val, '#VALUE!' AS val_err, NULL::DOUBLE AS ref, '#REF!' AS ref_err, NULL::DOUBLE AS unknown, '#NAME?' AS unknown_err, 3.0::DOUBLE AS text, NULL::VARCHAR AS text_err", div="1/0", first="#N/A+1/0", pow="0^0", val='"abc"+1', ref="#REF!+1", unknown="NOSUCH(1)", text='"2"+1')
one("q_array_sum_if", f"SELECT {r('sum(CASE WHEN o_totalprice > 100000 THEN o_totalprice ELSE 0 END)', 's')}, {r('sum(length(trim(o_orderstatus)))', 'n')}, {r('avg(CASE WHEN o_custkey > 500 THEN o_totalprice * 2 ELSE o_totalprice END)', 'm')}, NULL::VARCHAR AS m_err FROM orders", s="SUM(IF(orders!D:D>100000,orders!D:D,0))", n="SUM(LEN(TRIM(orders!C:C)))", m="AVERAGE(IF(orders!B:B>500,orders!D:D*2,orders!D:D))")

# --- logic and information

rows("q_if", "orders", "o_orderkey", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS paid, CASE WHEN o_custkey > 100 THEN 'yes' ELSE 'FALSE' END AS loose FROM orders", size='IF(D1>200000,"big",IF(D1>100000,"mid","small"))', paid='IF(C1="F",D1,)', loose='IF(B1>100,"yes")')
rows("q_iferror", "lineitem", "l_orderkey l_linenumber l_partkey l_suppkey", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_tax = 0 THEN -1 ELSE l_discount / l_tax END, 4) + 0.0 AS ratio, l_tax = 0 AS failed, false AS na FROM lineitem", ratio="IFERROR(G1/H1,-1)", failed="ISERROR(G1/H1)", na="ISNA(G1/H1)")
rows("q_and_or_xor", "lineitem", "l_orderkey l_linenumber l_partkey l_suppkey", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity > 10 AND l_tax > 0.02 AS a, l_quantity > 40 OR l_discount = 0 AS o, (l_quantity > 25) <> (l_tax > 0.04) AS x, NOT (l_quantity > 25) AS n FROM lineitem", a="AND(E1>10,H1>0.02)", o="OR(E1>40,G1=0)", x="XOR(E1>25,H1>0.04)", n="NOT(E1>25)")
one("q_and_ranges", "SELECT bool_and(o_custkey <> 0) AS every, NULL::VARCHAR AS every_err, bool_or(o_custkey <> 0) AS some, NULL::VARCHAR AS some_err FROM orders", every="AND(orders!B:B)", some="OR(orders!B:B)")
rows("q_is_family", "customer", "c_custkey", "SELECT c_custkey, true AS num, false AS num_t, true AS txt, false AS nontext, false AS blank, false AS logical, c_acctbal < 0 AS err, c_acctbal::DOUBLE AS n, '' AS t FROM customer", num="ISNUMBER(D1)", num_t="ISNUMBER(B1)", txt="ISTEXT(E1)", nontext="ISNONTEXT(E1)", blank="ISBLANK(D1)", logical="ISLOGICAL(D1)", err="ISERR(SQRT(D1))", n="N(D1)", t="T(D1)")
rows("q_parity", "part", "p_partkey", "SELECT p_partkey, p_size % 2 = 0 AS even, p_size % 2 <> 0 AS odd FROM part", even="ISEVEN(E1)", odd="ISODD(E1)")
rows("q_choose", "nation", "n_nationkey", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS pick, CASE WHEN n_regionkey > 2 THEN '#VALUE!' END AS pick_err FROM nation", pick='CHOOSE(C1+1,"a","b","c")')
rows("q_hyperlink", "nation", "n_nationkey", "SELECT n_nationkey, n_name AS label, 'http://x/' || n_nationkey AS bare FROM nation", label='HYPERLINK("http://x/"&A1,B1)', bare='HYPERLINK("http://x/"&A1)')

# --- text

rows("q_text_cut", "part", "p_partkey", "SELECT p_partkey, left(p_name, 4) AS l, right(p_name, 5) AS r, substr(p_name, 2, 3) AS m, length(p_name)::DOUBLE AS n, left(p_name, 1) AS first FROM part", l="LEFT(B1,4)", r="RIGHT(B1,5)", m="MID(B1,2,3)", n="LEN(B1)", first="LEFT(B1)")
QUERIES["q_text_cut"].sql = QUERIES["q_text_cut"].sql.replace(" AS m,", " AS m, NULL::VARCHAR AS m_err,")
rows("q_text_case", "part", "p_partkey", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, upper(p_name[1]) || substr(p_name, 2, instr(p_name, ' ') - 1) || upper(substr(p_name, instr(p_name, ' ') + 1, 1)) || substr(p_name, instr(p_name, ' ') + 2) AS p FROM part", u="UPPER(B1)", l="LOWER(D1)", p="PROPER(B1)")
rows("q_text_trim", "part", "p_partkey", "SELECT p_partkey, p_name || ' x' AS t FROM part", t='TRIM("  "&B1&"   x ")')
rows("q_text_substitute", "part", "p_partkey", "SELECT p_partkey, replace(p_name, 'l', 'LL') AS every, CASE WHEN length(p_name) - length(replace(p_name, 'l', '')) >= 2 THEN regexp_replace(p_name, '^([^l]*l[^l]*)l', '\\1#') ELSE p_name END AS second, NULL::VARCHAR AS second_err FROM part", every='SUBSTITUTE(B1,"l","LL")', second='SUBSTITUTE(B1,"l","#",2)')
rows("q_text_replace", "part", "p_partkey", "SELECT p_partkey, substr(p_name, 1, 1) || 'XY' || substr(p_name, 5) AS t, NULL::VARCHAR AS t_err FROM part", t='REPLACE(B1,2,3,"XY")')
rows("q_text_concat", "part", "p_partkey", "SELECT p_partkey, p_name || '/' || p_size AS a, p_brand || p_type AS b FROM part", a='CONCAT(B1,"/",E1)', b="CONCATENATE(C1,D1)")
one("q_text_textjoin", "SELECT string_agg(r_name, '; ' ORDER BY r_regionkey) AS names, 'a-b' AS direct FROM region", names='TEXTJOIN("; ",TRUE,region!B:B)', direct='TEXTJOIN("-",TRUE,"a","","b")')
rows("q_text_around", "customer", "c_custkey", "SELECT c_custkey, split_part(c_name, '#', 2) AS after, NULL::VARCHAR AS after_err, split_part(c_name, '#', 1) AS before, NULL::VARCHAR AS before_err, NULL::VARCHAR AS none, '#N/A' AS none_err FROM customer", after='TEXTAFTER(B1,"#")', before='TEXTBEFORE(B1,"#")', none='TEXTAFTER(B1,"?")')
rows("q_text_find", "part", "p_partkey", "SELECT p_partkey, CASE WHEN instr(p_name, 'l') > 0 THEN instr(p_name, 'l') END::DOUBLE AS f, CASE WHEN instr(p_name, 'l') = 0 THEN '#VALUE!' END AS f_err, instr(p_name, ' ')::DOUBLE AS s, NULL::VARCHAR AS s_err FROM part", f='FIND("l",B1)', s='SEARCH(" ?",B1)')
rows("q_text_rept", "nation", "n_nationkey", "SELECT n_nationkey, repeat('ab', n_regionkey) AS t, NULL::VARCHAR AS t_err FROM nation", t='REPT("ab",C1)')
rows("q_text_char_code", "part", "p_partkey", "SELECT p_partkey, chr((64 + p_size % 26 + 1)::INTEGER) AS c, NULL::VARCHAR AS c_err, ascii(p_name)::DOUBLE AS n, NULL::VARCHAR AS n_err FROM part", c="CHAR(65+MOD(E1,26))", n="CODE(B1)")
QUERIES["q_text_char_code"].sql = "SELECT p_partkey, chr((65 + p_size % 26)::INTEGER) AS c, NULL::VARCHAR AS c_err, ascii(p_name)::DOUBLE AS n, NULL::VARCHAR AS n_err FROM part"
rows("q_text_value", "customer", "c_custkey", "SELECT c_custkey, c_custkey::DOUBLE AS id, NULL::VARCHAR AS id_err, NULL::DOUBLE AS bad, '#VALUE!' AS bad_err, 0.5::DOUBLE AS half FROM customer", id='VALUE(RIGHT(B1,9))', bad="VALUE(B1)", half='VALUE("50%")')
rows("q_text_exact", "customer", "c_custkey", "SELECT c_custkey, false AS no, true AS yes FROM customer", no="EXACT(E1,LOWER(E1))", yes="EXACT(E1,UPPER(E1))")
rows("q_text_documents", "documents", "doc_id", "SELECT doc_id, length(text)::DOUBLE AS n, left(text, 20) AS head, length(text) - length(replace(text, 'e', ''))::DOUBLE AS es, NULL::VARCHAR AS es_err FROM documents", n="LEN(B1)", head="LEFT(B1,20)", es='LEN(B1)-LEN(SUBSTITUTE(B1,"e",""))')

# --- dates

_SERIAL = "date_diff('day', DATE '1899-12-30', o_orderdate::DATE)"
rows("q_date_ymd", "orders", "o_orderkey", f"SELECT o_orderkey, {_SERIAL}::DOUBLE AS serial, year(o_orderdate)::DOUBLE AS y, NULL::VARCHAR AS y_err, month(o_orderdate)::DOUBLE AS m, NULL::VARCHAR AS m_err, day(o_orderdate)::DOUBLE AS d, NULL::VARCHAR AS d_err FROM orders", serial="E1", y="YEAR(E1)", m="MONTH(E1)", d="DAY(E1)")
rows("q_date_build", "orders", "o_orderkey", "SELECT o_orderkey, date_diff('day', DATE '1899-12-30', make_date(year(o_orderdate), month(o_orderdate), 1) + INTERVAL 2 MONTH + INTERVAL 40 DAY)::DOUBLE AS later, NULL::VARCHAR AS later_err FROM orders", later="DATE(YEAR(E1),MONTH(E1)+2,41)")
rows("q_date_hms", "events", "event_id", "SELECT event_id, hour(t)::DOUBLE AS h, NULL::VARCHAR AS h_err, minute(t)::DOUBLE AS m, NULL::VARCHAR AS m_err, second(t)::DOUBLE AS s, NULL::VARCHAR AS s_err FROM (SELECT event_id, date_trunc('second', ts + INTERVAL 500 MILLISECOND) AS t FROM events)", h="HOUR(B1)", m="MINUTE(B1)", s="SECOND(B1)")
one("q_date_time", "SELECT 0.5::DOUBLE AS noon, 0.0417::DOUBLE AS wraps, NULL::DOUBLE AS bad, '#NUM!' AS bad_err, 60.0::DOUBLE AS leap, 61.0::DOUBLE AS march, 29.0::DOUBLE AS phantom", noon="TIME(12,0,0)", wraps="TIME(25,0,0)", bad="TIME(-1,0,0)", leap="DATE(1900,3,1)-1", march="DATE(1900,3,1)", phantom="DAY(60)")
rows("q_date_weekday", "orders", "o_orderkey", "SELECT o_orderkey, dayofweek(o_orderdate) + 1.0::DOUBLE AS sunday, NULL::VARCHAR AS sunday_err, isodow(o_orderdate)::DOUBLE AS monday, NULL::VARCHAR AS monday_err, isodow(o_orderdate) - 1.0::DOUBLE AS zero, NULL::VARCHAR AS zero_err FROM orders", sunday="WEEKDAY(E1)", monday="WEEKDAY(E1,2)", zero="WEEKDAY(E1,3)")
rows("q_date_days", "orders", "o_orderkey", "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS n FROM orders", n="DAYS(E1,34700)")

# --- mathematics

rows("q_math_round", "lineitem", "l_orderkey l_linenumber l_partkey l_suppkey", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(CAST(l_extendedprice AS DECIMAL(18,4)), 1) AS DOUBLE) AS one, CAST(round(CAST(l_extendedprice AS DECIMAL(18,4)) / 100, 0) * 100 AS DOUBLE) AS hundreds, CAST(round(CAST(l_discount AS DECIMAL(18,4)) / 2, 2) AS DOUBLE) AS half FROM lineitem", one="ROUND(F1,1)", hundreds="ROUND(F1,-2)", half="ROUND(G1/2,2)")
QUERIES["q_math_round"].sql = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)), 1) AS DOUBLE) AS one, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)), -2) AS DOUBLE) AS hundreds, CAST(((CAST(round(l_discount * 100) AS INTEGER) + 1) // 2) / 100.0 AS DOUBLE) AS half, NULL::VARCHAR AS half_err FROM lineitem"
rows("q_math_roundup", "part", "p_partkey", "SELECT p_partkey, (ceil(p_size / 10.0) * 10)::DOUBLE AS up, (floor(p_size / 10.0) * 10)::DOUBLE AS down, -ceil(p_size / 4.0)::DOUBLE AS neg, NULL::VARCHAR AS neg_err FROM part", up="ROUNDUP(E1,-1)", down="ROUNDDOWN(E1,-1)", neg="ROUNDUP(-E1/4,0)")
QUERIES["q_math_roundup"].sql = "SELECT p_partkey, (ceil(p_size / 10.0) * 10)::DOUBLE AS up, (floor(p_size / 10.0) * 10)::DOUBLE AS down, (0.0 - ceil(p_size / 4.0))::DOUBLE AS neg, NULL::VARCHAR AS neg_err FROM part"
rows("q_math_mod", "part", "p_partkey", "SELECT p_partkey, (p_size % 7)::DOUBLE AS m, NULL::VARCHAR AS m_err, (-p_size - (-7) * floor(-p_size / -7.0))::DOUBLE AS neg, NULL::VARCHAR AS neg_err, (p_size + 7 * floor(-p_size / 7.0))::DOUBLE AS mixed, NULL::VARCHAR AS mixed_err FROM part", m="MOD(E1,7)", neg="MOD(-E1,-7)", mixed="-MOD(-E1,7)")
QUERIES["q_math_mod"].sql = "SELECT p_partkey, (p_size % 7)::DOUBLE AS m, NULL::VARCHAR AS m_err, 0.0 - (p_size % 7)::DOUBLE AS neg, NULL::VARCHAR AS neg_err, (7 - p_size % 7) % 7 + 0.0::DOUBLE AS mixed, NULL::VARCHAR AS mixed_err FROM part"
QUERIES["q_math_mod"].formulas["mixed"] = "MOD(-E1,7)"
rows("q_math_steps", "part", "p_partkey", "SELECT p_partkey, (floor(p_size / 4.0) * 4)::DOUBLE AS f, NULL::VARCHAR AS f_err, (ceil(p_size / 4.0) * 4)::DOUBLE AS c, NULL::VARCHAR AS c_err, (p_size + p_size % 2)::DOUBLE AS e, (p_size + 1 - p_size % 2)::DOUBLE AS o FROM part", f="FLOOR(E1,4)", c="CEILING(E1,4)", e="EVEN(E1)", o="ODD(E1)")
rows("q_math_log_exp", "part", "p_partkey", "SELECT p_partkey, round(ln(p_retailprice), 4) AS l, NULL::VARCHAR AS l_err, round(log10(p_retailprice), 4) AS l10, NULL::VARCHAR AS l10_err, round(ln(p_retailprice) / ln(2), 4) AS l2, NULL::VARCHAR AS l2_err, round(exp(p_size / 10.0::DOUBLE), 4) AS e, NULL::VARCHAR AS e_err, round(sqrt(p_size), 4) AS s, NULL::VARCHAR AS s_err FROM part", l="LN(F1)", l10="LOG10(F1)", l2="LOG(F1,2)", e="EXP(E1/10)", s="SQRT(E1)")
rows("q_math_trig", "part", "p_partkey", "SELECT p_partkey, round(sin(p_size), 4) + 0.0 AS s, round(cos(p_size), 4) + 0.0 AS c, round(tan(p_size), 4) + 0.0 AS t, round(asin(p_size / 100.0::DOUBLE), 4) + 0.0 AS a_s, NULL::VARCHAR AS a_s_err, round(acos(p_size / 100.0::DOUBLE), 4) + 0.0 AS a_c, NULL::VARCHAR AS a_c_err, round(atan(p_size), 4) + 0.0 AS a_t, round(atan2(2, p_size), 4) + 0.0 AS a_2, NULL::VARCHAR AS a_2_err, round(radians(p_size), 4) + 0.0 AS rad, round(degrees(p_size), 4) + 0.0 AS deg, 3.1416::DOUBLE AS pi FROM part", s="SIN(E1)", c="COS(E1)", t="TAN(E1)", a_s="ASIN(E1/100)", a_c="ACOS(E1/100)", a_t="ATAN(E1)", a_2="ATAN2(E1,2)", rad="RADIANS(E1)", deg="DEGREES(E1)", pi="PI()")
rows("q_math_power", "part", "p_partkey", "SELECT p_partkey, round(pow(p_size, 1.5), 4) AS p, NULL::VARCHAR AS p_err, NULL::DOUBLE AS bad, '#NUM!' AS bad_err FROM part", p="POWER(E1,1.5)", bad="POWER(-E1,0.5)")
rows("q_math_parts", "customer", "c_custkey", "SELECT c_custkey, trunc(c_acctbal) + 0.0 AS t, floor(c_acctbal) + 0.0 AS i, sign(c_acctbal)::DOUBLE AS s, abs(c_acctbal) AS a FROM customer", t="TRUNC(D1)", i="INT(D1)", s="SIGN(D1)", a="ABS(D1)")
rows("q_norm", "part", "p_partkey", "SELECT p_partkey, round(exp(-power((p_size - 25) / 10.0::DOUBLE, 2) / 2) / sqrt(2 * pi()) / 10, 4) + 0.0 AS pdf, NULL::VARCHAR AS pdf_err, round(exp(-power(p_size / 25.0::DOUBLE, 2) / 2) / sqrt(2 * pi()), 4) + 0.0 AS z, NULL::VARCHAR AS z_err FROM part", pdf="NORM.DIST(E1,25,10,FALSE)", z="NORM.S.DIST(E1/25,FALSE)")
_ERF = "(SELECT sum(2 / sqrt(pi()) * (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * power({x}, 2 * k + 1) / (factorial(k::INTEGER)::DOUBLE * (2 * k + 1))) FROM range(31) s(k))"
_ERF_OF = lambda x: _ERF.format(x=f"({x})::DOUBLE")  # noqa: E731  its power series
rows("q_erf", "part", "p_partkey", f"SELECT p_partkey, round(0.5 * (1 + {_ERF_OF('(p_size - 25) / 10.0 / sqrt(2)')}), 4) + 0.0 AS cdf, NULL::VARCHAR AS cdf_err, round(0.5 * (1 + {_ERF_OF('p_size / 25.0 / sqrt(2)')}), 4) + 0.0 AS z, round({_ERF_OF('p_size / 50.0')}, 4) + 0.0 AS e, round({_ERF_OF('p_size / 50.0')} - {_ERF_OF('p_size / 100.0')}, 4) + 0.0 AS between, round(1 - {_ERF_OF('p_size / 50.0')}, 4) + 0.0 AS c FROM part", cdf="NORM.DIST(E1,25,10,TRUE)", z="NORMSDIST(E1/25)", e="ERF(E1/50)", between="ERF(E1/100,E1/50)", c="ERFC(E1/50)")

rows("q_aliases", "part", "p_partkey", "SELECT p_partkey, (ceil(p_size / 4.0) * 4)::DOUBLE AS up, (floor(p_size / 4.0) * 4)::DOUBLE AS down, true AS yes, false AS no, round(exp(-power((p_size - 25) / 10.0::DOUBLE, 2) / 2) / sqrt(2 * pi()) / 10, 4) + 0.0 AS pdf FROM part", up="CEILING.MATH(E1,4)", down="FLOOR.MATH(E1,4)", yes="TRUE()", no="FALSE()", pdf="NORMDIST(E1,25,10,FALSE)")
one("q_spread_aliases", f"SELECT {r('stddev_samp(o_totalprice)', 's')}, {r('stddev_pop(o_totalprice)', 'p')}, {r('var_samp(o_totalprice) / 1000000', 'v')}, {r('var_pop(o_totalprice) / 1000000', 'w')} FROM orders", s="STDEV.S(orders!D:D)", p="STDEVP(orders!D:D)", v="VAR(orders!D:D)/1000000", w="VAR.P(orders!D:D)/1000000")
rows("q_unary", "customer", "c_custkey", "SELECT c_custkey, round(c_acctbal, 4) + 0.0 AS same, round(-c_acctbal, 4) + 0.0 AS minus, round(c_acctbal, 4) + 0.0 AS own, round(c_acctbal / 100, 4) + 0.0 AS share, c_mktsegment AS text FROM customer", same="+D1", minus="-D1", own="@D:D", share="D1%", text="+E1")
one("q_array_functions", f"SELECT {r('sum(abs(c_acctbal))', 'a')}, {r('sum(floor(c_acctbal))', 'i')}, {r('sum(length(c_name))', 'l')}, {r('sum(sqrt(abs(c_acctbal)))', 'q')}, {r('sum(sign(c_acctbal))', 's')}, {r('sum(-c_acctbal)', 'm')}, {r('sum(CASE WHEN c_acctbal > (SELECT avg(c_acctbal) FROM customer) THEN c_acctbal ELSE 0 END)', 'above')} FROM customer", a="SUM(ABS(customer!D:D))", i="SUM(INT(customer!D:D))", l="SUM(LEN(customer!B:B))", q="SUM(SQRT(ABS(customer!D:D)))", s="SUM(SIGN(customer!D:D))", m="SUM(-customer!D:D)", above="SUM(IF(customer!D:D>AVERAGE(customer!D:D),customer!D:D,0))")

# --- criteria, ranges and lookups that differ by row

rows("q_countif_row_cmp", "customer", "c_custkey", "SELECT c_custkey, n - count(*) OVER (ORDER BY c_acctbal) + 0.0::DOUBLE AS above, count(*) OVER (ORDER BY c_acctbal)::DOUBLE AS upto FROM customer, (SELECT count(*) AS n FROM customer)", above='COUNTIF(D:D,">"&D1)', upto='COUNTIF(D:D,"<="&D1)')
rows("q_sumif_row_cmp", "supplier", "s_suppkey", f"SELECT s_suppkey, {r('coalesce((SELECT sum(p_size) FROM part WHERE p_retailprice < s_acctbal), 0)', 'below')}, {r('(SELECT avg(p_size) FROM part WHERE p_retailprice >= s_acctbal)', 'mean')}, CASE WHEN s_acctbal > (SELECT max(p_retailprice) FROM part) THEN '#DIV/0!' END AS mean_err FROM supplier", below='SUMIF(part!F:F,"<"&D1,part!E:E)', mean='AVERAGEIF(part!F:F,">="&D1,part!E:E)')
rows("q_countifs_row_two", "customer", "c_custkey", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 20)::DOUBLE AS n, (SELECT count(*) FROM supplier WHERE s_acctbal > c_acctbal AND s_acctbal < c_acctbal + 1000)::DOUBLE AS band FROM customer", n='COUNTIFS(orders!B:B,A1,orders!D:D,">"&D1*20)', band='COUNTIFS(supplier!D:D,">"&D1,supplier!D:D,"<"&D1+1000)')
rows("q_countif_row_wild", "nation", "n_nationkey", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_name LIKE '%' || n_nationkey)::DOUBLE AS ends, (SELECT count(*) FROM supplier WHERE s_name LIKE '%' || n_nationkey || '_')::DOUBLE AS shape, (SELECT count(*) FROM part WHERE p_size <> n_nationkey)::DOUBLE AS other FROM nation", ends='COUNTIF(customer!B:B,"*"&A1)', shape='COUNTIF(supplier!B:B,"*"&A1&"?")', other='COUNTIF(part!E:E,"<>"&A1)')
rows("q_countif_running", "orders", "o_orderkey", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::DOUBLE AS nth, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE), 4) + 0.0 AS paid, count(*) FILTER (WHERE o_totalprice > 200000) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS big FROM orders", nth="COUNTIF(B$1:B1,B1)", paid="SUMIF(B$1:B1,B1,D$1:D1)", big='COUNTIF(D$1:D1,">200000")')
rows("q_running_extremes", "customer", "c_custkey", "SELECT c_custkey, max(c_acctbal) OVER w AS high, min(c_acctbal) OVER w AS low, round(avg(c_acctbal) OVER w, 4) + 0.0 AS mean, count(*) OVER w::DOUBLE AS n FROM customer WINDOW w AS (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING)".replace("OVER w::DOUBLE", "OVER w + 0.0::DOUBLE"), high="MAX(D$1:D1)", low="MIN(D$1:D1)", mean="AVERAGE(D$1:D1)", n="COUNT(D$1:D1)")
rows("q_windows", "customer", "c_custkey", "SELECT c_custkey, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) OVER w AS DOUBLE), 4) + 0.0 AS week, max(c_acctbal) OVER w AS high, round(median(c_acctbal) OVER w, 4) + 0.0 AS mid, count(*) FILTER (WHERE c_acctbal > 0) OVER w + 0.0::DOUBLE AS positive, round(coalesce(sum(c_acctbal) FILTER (WHERE c_acctbal < 0) OVER w, 0), 4) + 0.0 AS owed FROM customer WINDOW w AS (ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)", week="SUM(D1:D7)", high="MAX(D1:D7)", mid="MEDIAN(D1:D7)", positive='COUNTIF(D1:D7,">0")', owed='SUMIF(D1:D7,"<0")')
rows("q_row_statistics", "lineitem", "l_orderkey l_linenumber l_partkey l_suppkey", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((list_sort([l_quantity, l_extendedprice, l_discount, l_tax])[2] + list_sort([l_quantity, l_extendedprice, l_discount, l_tax])[3]) / 2, 4) + 0.0 AS mid, round(list_stddev_samp([l_discount, l_tax]), 4) + 0.0 AS sd, list_reverse_sort([l_quantity, l_extendedprice, l_discount, l_tax])[2] AS second FROM lineitem", mid="MEDIAN(E1:H1)", sd="STDEV(G1:H1)", second="LARGE(E1:H1,2)")
rows("q_vlookup_moving", "nation", "n_nationkey", "SELECT n_nationkey, lead(n_name) OVER (ORDER BY n_nationkey) AS next, CASE WHEN n_nationkey = 24 THEN '#N/A' END AS next_err, CASE WHEN n_nationkey < 23 THEN 3.0::DOUBLE END AS third, CASE WHEN n_nationkey >= 23 THEN '#N/A' END AS third_err FROM nation", next="VLOOKUP(A1+1,A1:C3,2,FALSE)", third="MATCH(A1+2,A1:A5,0)")
rows("q_text_near", "nation", "n_nationkey", "SELECT n_nationkey, (SELECT max(r_regionkey) + 1 FROM region WHERE lower(r_name) <= lower(n_name))::DOUBLE AS place, CASE WHEN NOT EXISTS (SELECT 1 FROM region WHERE lower(r_name) <= lower(n_name)) THEN '#N/A' END AS place_err, (SELECT arg_max(r_regionkey, r_regionkey) FROM region WHERE lower(r_name) <= 'm')::DOUBLE AS m FROM nation", place="MATCH(B1,region!B:B,1)", m='LOOKUP("m",region!B:B,region!A:A)')
rows("q_lookup_row_wild", "nation", "n_nationkey", "SELECT n_nationkey, (SELECT min(s_suppkey) FROM supplier WHERE s_name LIKE '%' || n_nationkey)::DOUBLE AS first, CASE WHEN NOT EXISTS (SELECT 1 FROM supplier WHERE s_name LIKE '%' || n_nationkey) THEN '#N/A' END AS first_err FROM nation", first='INDEX(supplier!A:A,MATCH("*"&A1,supplier!B:B,0))')
one("q_hlookup_wild", "SELECT (SELECT n_name FROM nation WHERE n_nationkey = 4) AS name, NULL::VARCHAR AS name_err, (SELECT n_nationkey FROM nation WHERE n_nationkey = 3)::DOUBLE AS own, NULL::VARCHAR AS own_err, 2.0::DOUBLE AS place, NULL::VARCHAR AS place_err, '#N/A' AS miss_err, NULL::DOUBLE AS miss", name='HLOOKUP("NAT*",nation!A3:C6,3,FALSE)', own="N(HLOOKUP(2,nation!A3:C6,2,FALSE))", place='MATCH("?ation*",nation!A3:C3,0)', miss='HLOOKUP("x*",nation!A3:C6,2,FALSE)')
one("q_index_reference", f"SELECT {r('sum(o_totalprice) FILTER (WHERE k BETWEEN 3 AND 10)', 'dynamic')}, {r('sum(o_totalprice)', 'whole')}, {r('sum(o_orderkey + o_custkey) FILTER (WHERE k = 5)', 'across')}, {r('max(o_totalprice) FILTER (WHERE k BETWEEN 2 AND 4)', 'both')} FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders)", dynamic="SUM(INDEX(orders!D:D,3):orders!D10)", whole="SUM(INDEX(orders!D:D,0))", across="SUM(INDEX(orders!A:B,5,0))", both="MAX(INDEX(orders!D:D,2):INDEX(orders!D:D,4))")
one("q_whole_rows", f"SELECT {r('sum(n_nationkey + n_regionkey) FILTER (WHERE k BETWEEN 3 AND 9)', 'some')}, count(*) FILTER (WHERE k = 2) * 2 + 0.0::DOUBLE AS n FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation)", some="SUM(nation!3:9)", n="COUNT(nation!2:2)")


# --- blanks


def with_blanks(spark: SparkSession, sf_dir: str) -> Book:
    """Customers whose negative balances and whose names at every third key are missing."""
    own = spark.read.parquet(f"{sf_dir}/customer.parquet")
    own = own.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))
    return Book(spark, [Sheet("customer", own, ["c_custkey"])])


def q_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas over columns with nulls: blank cells."""
    own = {"more": "C1+1", "label": 'B1&"!"', "len": "LEN(B1)", "blank": "ISBLANK(C1)", "none": 'B1=""', "zero": "C1=0", "later": "COUNTBLANK(C$1:C1)", "seen": 'COUNTIF(B1:B3,"")'}
    return tidy(with_blanks(spark, sf_dir).fill("customer", own, keep=["c_custkey"]).drop(*(f"{k}_err" for k in own)))


BLANKS_SQL = """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS b, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c FROM customer)
SELECT c_custkey, round(coalesce(c, 0) + 1, 4) + 0.0 AS more, coalesce(b, '') || '!' AS label, length(coalesce(b, ''))::DOUBLE AS len, c IS NULL AS blank, b IS NULL AS none, coalesce(c, 0) = 0 AS zero,
count(*) FILTER (WHERE c IS NULL) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) + 0.0::DOUBLE AS later,
(count(*) FILTER (WHERE b IS NULL) OVER w + 3 - count(*) OVER w) + 0.0::DOUBLE AS seen FROM t WINDOW w AS (ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()} | {"q_blanks": q_blanks}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql} | {"q_blanks": BLANKS_SQL}
