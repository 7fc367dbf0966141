"""Compiled columns against the single-cell evaluator, blanks and faults included."""

import math

import pytest

from gridloom.functions import values as V
from gridloom.functions.values import Fault
from gridloom.plans.compiler import Book, Unsupported
from gridloom.plans.interp import evaluate
from gridloom.plans.workbook import Workbook
from gridloom.sources.tables import Sheet

ROWS = [
    (1, 5.0, "apple", True, 2.5), (2, None, None, None, -3.0), (3, 0.0, "", False, 0.0), (4, -7.25, "50%", True, 1234567.891), (5, 100.0, "12.5", False, 1e-7), (6, 3.0, "TRUE", None, 43831.75),
    (7, 2.675, "a*b?c", True, 60.0), (8, 1e15, " x  y ", False, 59.5), (9, 1.0, "Apple", True, 0.1), (10, 8.0, "1,234", None, -0.5),
]
COLUMNS = ["k", "n", "t", "b", "m"]

SCALAR = """
B1+E1;B1-E1;B1*E1;B1/E1;B1^E1;E1^2;-B1;B1%;B1&C1;C1&D1;E1&"";B1=E1;B1<>0;C1="APPLE";C1<D1;D1>=B1;B1=C1;C1>E1;D1=TRUE;B1=D1;C1+1;D1+1;"x"&E1&"y"
IF(B1>2,C1,"no");IF(B1,1,2);IF(D1,B1,E1);IF(B1>2,1);IF(B1>2,,5);IF(C1="","e",C1);IF(B1>2,C1,B1);IFERROR(B1/E1,-1);IFERROR(1/B1,"bad");IFNA(B1/E1,9);AND(B1>1,E1>0);OR(B1>1,E1>0);XOR(B1>1,E1>0);NOT(B1);NOT(D1)
ISBLANK(B1);ISBLANK(C1);ISTEXT(C1);ISNONTEXT(B1);ISNUMBER(B1);ISNUMBER(C1);ISLOGICAL(D1);ISERROR(1/B1);ISERR(SQRT(E1));ISNA(1/B1);ISEVEN(A1);ISODD(A1);N(B1);N(D1);N(C1);T(C1);T(B1)
LEFT(C1,2);LEFT(C1);RIGHT(C1,3);MID(C1,2,2);MID(C1,A1-1,2);LEN(C1);LEN(B1);LOWER(C1);UPPER(C1);PROPER(C1);TRIM(C1);SUBSTITUTE(C1,"p","--");SUBSTITUTE(C1,"p","--",2);SUBSTITUTE(C1,"p","-",A1);REPLACE(C1,2,2,"ZZ");CONCAT(A1,"-",C1,D1)
TEXTAFTER(C1,"p");TEXTBEFORE(C1,"p",2);TEXTAFTER(C1,"p",-1);VALUE(C1);EXACT(C1,"apple");FIND("p",C1);FIND("p",C1,3);SEARCH("P?",C1);SEARCH("~*",C1);REPT(C1,2);REPT("a",A1-2);CHAR(A1+64);CODE(C1);TEXTJOIN("-",TRUE,A1,C1)
DATE(2000+A1,A1*3,A1*7);DATE(1900,A1,A1);TIME(A1,A1*5,A1*7);YEAR(E1);MONTH(E1);DAY(E1);HOUR(E1);MINUTE(E1);SECOND(E1);WEEKDAY(E1);WEEKDAY(A1,2);DAYS(E1,A1);YEAR(A1*6000)
ROUND(B1,2);ROUND(E1,-1);ROUND(E1,0);ROUNDUP(E1,1);ROUNDDOWN(E1,1);TRUNC(E1);TRUNC(E1,1);INT(E1);ABS(E1);SIGN(E1);SQRT(E1);EXP(A1);EXP(E1);LN(E1);LOG10(A1);LOG(A1,2);LOG(A1,1);POWER(E1,2);POWER(E1,0.5);MOD(E1,3);MOD(E1,-3);MOD(A1,E1)
FLOOR(E1,2);FLOOR(E1,-2);FLOOR(E1,0);CEILING(E1,2);CEILING(A1,-2);EVEN(E1);ODD(E1);RADIANS(A1);DEGREES(A1);SIN(A1);COS(A1);TAN(A1);ASIN(E1);ACOS(A1/10);ATAN(E1);ATAN2(B1,E1);NORM.DIST(E1,1,2,TRUE);NORM.DIST(A1,1,E1,FALSE);NORMSDIST(A1/3);ERF(A1/5);ERFC(A1/5);NORM.S.DIST(A1/3,FALSE)
CHOOSE(A1,"a","b",C1);HYPERLINK("u",C1);ROW();COLUMN(C1);A1:A10*2;@B1:B10;B2;A2+B1;SUM(B1,E1,"3");SUM(B1:E1);AVERAGE(A1:E1);MAX(B1:E1,4);MIN(A1:B2);COUNT(A1:E1);COUNTA(A1:E1);COUNTBLANK(B1:D1);PRODUCT(A1:B1);SUM(A$1:A1);SUM(B$1:B1);AND(A1:B1);TEXTJOIN("-",FALSE,A1:C1);SUM(A$2:A$4);MATCH(4,A:A,-1);HLOOKUP(5,$A$5:$E$7,2,FALSE);HLOOKUP(A1,$A$1:$E$3,3);SUM(B:B);AVERAGE(B:B,A1);MAX(E:E);MIN(B:B,E:E);COUNT(B:B);COUNTA(C:C);COUNTBLANK(C:C);COUNTBLANK(B:B);COUNTIF(C:C,"a*");COUNTIF(C:C,"");COUNTIF(B:B,"<>5")
COUNTIF(B:B,">2");COUNTIF(D:D,TRUE);SUMIF(C:C,"apple",B:B);SUMIF(B:B,">2");AVERAGEIF(B:B,"<0",E:E);SUM(IF(B:B>2,E:E,0));SUM(LEN(C:C));PRODUCT(A:A);MEDIAN(B:B);LARGE(B:B,2);SMALL(B:B,20);STDEV(B:B);VARP(E:E);RANK(A1,A:A);RANK(B1,B:B);SUMPRODUCT(A:A,B:B);SUBTOTAL(9,B:B)
MATCH(A1,A:A,0);MATCH("APPLE",C:C,0);INDEX(C:C,A1);VLOOKUP(A1+1,A:C,3,FALSE);VLOOKUP(A1+0.5,A:E,5);LOOKUP(A1,A:A,E:E);MATCH(E1,A:A,1);INDEX(B:B,MATCH(A1,A:A,0));COUNTIF(A:A,A1);SUMIFS(E:E,A:A,A1);COUNTIFS(C:C,C1);#N/A;1/0+#N/A;NOSUCH(1);#REF!*2
""".replace("\n", ";").strip(";").split(";")

#: Criteria and ranges that differ by row.
MOVING = """
COUNTIF(E:E,">"&A1);COUNTIF(E:E,"<="&E1);COUNTIF(B:B,">="&B1);COUNTIF(B:B,"<>"&A1);COUNTIF(C:C,"<>"&C1);COUNTIF(C:C,"*"&RIGHT(C1,1)&"*");COUNTIF(C:C,LEFT(C1,1)&"*");COUNTIF(C:C,">"&C1);COUNTIF(C:C,"<"&A1);COUNTIF(B:B,B1);COUNTIF(B:B,C1);COUNTIF(D:D,D1);COUNTIF(C:C,C1);COUNTIF(C:C,"="&C1);COUNTIF(B:B,"="&B1)
SUMIF(E:E,">"&E1);SUMIF(E:E,"<"&E1,A:A);SUMIF(A:A,">="&B1,E:E);AVERAGEIF(A:A,">"&A1,E:E);SUMIFS(E:E,A:A,">"&A1,A:A,"<"&A1+4);COUNTIFS(A:A,">"&A1,E:E,"<"&E1);COUNTIFS(D:D,D1,A:A,"<="&A1);COUNTIFS(C:C,C1,B:B,">0");SUMIFS(E:E,D:D,D1,E:E,">"&E1);COUNTIF(A:B,">2");COUNTIF(A:B,">"&A1);COUNTIFS(A:A,">"&A1,C:C,"?*")
COUNTIF(A$1:A1,A1);COUNTIF(C$1:C1,C1);COUNTIF(B$1:B1,">2");COUNTIF(E$1:E1,">"&E1);COUNTIF(E$3:E1,">0");COUNTIF(D$3:D1,D1);SUMIF(E$1:E1,">0");SUMIF(D$1:D1,D1,E$1:E1);COUNTIFS(D$1:D1,D1,E$1:E1,">0");COUNTIF(C$1:C1,"a*");COUNTIF(A1:A$10,A1);COUNTIF(C$1:C1,LEFT(C1,1)&"*");COUNTIF(A2:A$5,">"&A1)
COUNTIF(A1:A3,">2");SUMIF(A1:A2,">=0",A1:A2);COUNTIF(C1:C4,C1);COUNTIF(B1:B3,">"&A1);SUMIF(B1:B3,"<>"&B1,E1:E3);AVERAGEIF(E1:E3,">0");COUNTIFS(A1:A3,">"&A1,D1:D3,TRUE);COUNTIF(C1:C3,"");COUNTIF(B1:B3,"");SUMIFS(E1:E3,C1:C3,"a*")
MIN(A$1:A1);MAX(E$1:E1);MAX(B$4:B1);AVERAGE(E$1:E1);COUNT(B$1:B1);COUNTA(C$1:C1);COUNTBLANK(B$1:B1);PRODUCT(A$1:A1);SUM(E$5:E1);SUM(E1:E$10);SUM(A$1:B1);MIN(A$2:A3);SUMPRODUCT(A$1:A1,A$1:A1)
SUM(A1:A3);MAX(E1:E4);AVERAGE(B1:B3);COUNTBLANK(B1:B3);MEDIAN(E1:E3);MEDIAN(B1:E1);STDEV(E1:E4);VARP(E1:E2);LARGE(E1:E4,2);SMALL(B1:B3,A1);RANK(E1,E1:E4);SUMPRODUCT(A1:A3,E1:E3);SUMPRODUCT(A1:A3,B2:B4);SUM(A1:A3*2);SUM(IF(E1:E3>0,E1:E3,0));STDEV(A1:A1);LARGE(B1:E1,1)
VLOOKUP(A1,A1:C3,3,FALSE);VLOOKUP(A2,A1:C3,3,FALSE);VLOOKUP(A1+0.5,A1:E3,5);MATCH(A3,A1:A5,0);MATCH(A1+1,A1:A4);MATCH(A1,A1:A4,-1);MATCH(C1,C$1:C1,0);VLOOKUP(A1,A$1:E1,5,FALSE);INDEX(A1:B3,2,1);INDEX(E1:E4,A1-8);LOOKUP(A1+1,A1:A4,E1:E4);VLOOKUP("*p*",C1:E3,3,FALSE)
VLOOKUP("b",C:E,3);MATCH("b",C:C,1);LOOKUP(C1,C:C,E:E);VLOOKUP(C1,C:E,3);VLOOKUP(C1,C:E,3,FALSE);MATCH(LEFT(C1,1)&"*",C:C,0);MATCH("?p*",C:C,0);VLOOKUP(A1,A:E,A1,FALSE);MATCH("zz~*",C:C,0);MATCH("a~*b*",C:C,0)
HLOOKUP("A*",$A$1:$E$3,2,FALSE);HLOOKUP("ap?le",$A$1:$E$3,3,FALSE);HLOOKUP(A1,A1:E2,2,FALSE);HLOOKUP(C1,A1:E2,2,FALSE);MATCH(A1,A1:E1,0);MATCH(E1,A1:E1,1);MATCH("a*",A1:E1,0);HLOOKUP(LEFT(C1,2)&"*",$A$1:$E$9,9,FALSE);LOOKUP(A1,A1:B1);MATCH(2,$A$1:$E$1,-1)
SUM(INDEX(E:E,2):E1);SUM(INDEX(E:E,0));SUM(INDEX(A:E,0,5));SUM(INDEX(A:E,3,0));INDEX(A:E,2,5);INDEX(A:E,2,9);INDEX(E:E,A1);INDEX(E:E,A1-4);INDEX(A:E,A1,1);SUM(INDEX(E:E,2):INDEX(E:E,4));INDEX(A1:E1,2);INDEX($A$2:$E$2,A1);SUM(1:1);SUM(3:4);SUM($2:$3);COUNT(1:2);MAX(2:2);SUM($1:1);ROWS(A$1:A1);ROWS(A1:A3);ROW(A5);SUM(IF(E:E>AVERAGE(E:E),E:E,0));SUM(E:E*$A$2);SUM($E$2:$E$5*2);SUM($A$2:$B$5*$D$2:$E$5)
TEXTJOIN("-",TRUE,A1:B2);AND(A1:A3);OR(D1:D3);A3;C2&A2;B3+1;SUM(A1,A2:A3,$A$1)
""".replace("\n", ";").strip(";").split(";")


@pytest.fixture(scope="module")
def sides(spark):
    df = spark.createDataFrame(ROWS, "k int, n double, t string, b boolean, m double")
    own = Workbook()
    sheet = own.add("T")
    for r, row in enumerate(ROWS):
        for c, v in enumerate(row):
            if v is not None:
                sheet.values[r, c] = float(v) if isinstance(v, int) and not isinstance(v, bool) else v
    compiled = Book(spark, [Sheet("T", df, ["k"])])
    formulas = {f"f{i}": f for i, f in enumerate([*SCALAR, *MOVING])}
    groups = [range(at, min(at + 24, len(SCALAR))) for at in range(0, len(SCALAR), 24)] + [range(at, min(at + 3, len(formulas))) for at in range(len(SCALAR), len(formulas), 3)]
    found = {}
    for group in groups:
        part = {f"f{i}": formulas[f"f{i}"] for i in group}
        out = compiled.fill("T", part, keep=["k"]).orderBy("k")
        for r in out.collect():
            r = r.asDict()
            for n in part:
                found[formulas[n], r["k"]] = (r[n], r.get(f"{n}_err"))
    return own, found


@pytest.mark.parametrize("formula", [*SCALAR, *MOVING])
def test_columns_equal_cells(sides, formula):
    own, found = sides
    from gridloom.plans.rebase import moved
    from gridloom.plans.syntax import parse

    for k in range(1, len(ROWS) + 1):
        want = evaluate(own, moved(parse(formula), k - 1, 0), row=k - 1, col=9)
        v, code = found[formula, k]
        if isinstance(want, Fault):
            assert code == want.code, (k, v, code)
            continue
        assert code is None, (k, want, code)
        if isinstance(want, bool):
            assert v is want or str(v).upper() == str(want).upper(), k
        elif isinstance(want, float) and isinstance(v, float | int):
            assert math.isclose(v, want, rel_tol=1e-9, abs_tol=1e-12), (k, v, want)
        elif isinstance(want, float):  # a blank in a column of text shows as 0 in a cell
            assert v in (None, "") and want == 0 or v == V.general(want), (k, v, want)
        else:
            assert v == want, (k, v, want)


def test_mixed_kinds_show_as_text(sides):
    assert V.general(-0.13793103448275862) == "-0.13793103448276"


def test_what_has_no_plan(spark):
    own = Book(spark, [Sheet("T", spark.createDataFrame(ROWS, "k int, n double, t string, b boolean, m double"), ["k"])])
    with pytest.raises(Unsupported):
        own.fill("T", {"x": "MATCH(A1,A:A,-1)"})
    for formula in ("VLOOKUP(A1,A$1:B1,2)", "COUNTIF(A1:A9999,1)", "SUM(B:B*A1)", "INDEX(A:C,1,A1)", "SUMIF(A1:A3,1,B$1:B1)", "LARGE(A:A,A1)"):
        with pytest.raises(Unsupported):
            own.fill("T", {"x": formula})
