"""Parsing, values and single-cell evaluation."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gridloom.functions import values as V
from gridloom.functions.values import DIV0, NA, NAME, NULL, NUM, REF, VALUE
from gridloom.plans import interp
from gridloom.plans import syntax as S
from gridloom.plans.interp import evaluate
from gridloom.plans.rebase import moved
from gridloom.plans.workbook import Workbook
from tests.books import book

# --- formulas from a grammar

_blank = st.sampled_from(["", "", "", " ", "  "])
_cell = st.builds(lambda a, c, b, r: f"{a}{S.column_letters(c)}{b}{r}", st.sampled_from(["", "$"]), st.integers(0, 800), st.sampled_from(["", "$"]), st.integers(1, 99_999))
_sheet = st.sampled_from(["", "", "", "Data!", "'Two words'!", "'It''s'!", "First:Last!", "[2]Other!"])
_area = st.one_of(
    st.builds("{}{}".format, _sheet, _cell), st.builds("{}{}:{}".format, _sheet, _cell, _cell), st.builds(lambda s, a, b: f"{s}{S.column_letters(min(a, b))}:${S.column_letters(max(a, b))}", _sheet, st.integers(0, 700), st.integers(0, 700)),
    st.builds(lambda a, b: f"{min(a, b)}:{max(a, b)}", st.integers(1, 5000), st.integers(1, 5000)), st.sampled_from(["Rate", "Orders[Price]", "Orders[[#Totals],[Price]]", "Data!Limit", "#REF!"]),
)
_number = st.one_of(st.integers(0, 10**9).map(str), st.floats(0, 1e12, allow_nan=False).map(lambda x: f"{x:.3f}"), st.sampled_from(["2E+3", "7e-2", ".25"]))
_text = st.text(st.sampled_from('ab "(),;!'), max_size=6).map(lambda t: '"' + t.replace('"', '""') + '"')
_leaf = st.one_of(_area, _area, _number, _text, st.sampled_from(["TRUE", "False", "#DIV/0!", "#VALUE!", "{1,2;3,-4}", '{"p","q"}']))
_NAMES = ["SUM", "Round", "IFERROR", "_xlfn.CONCAT", "VLOOKUP", "TODAY", "NoSuchName"]


def _grown(inner):
    call = st.builds(lambda f, gap, args: f"{f}({gap}{','.join(args)}{gap})", st.sampled_from(_NAMES), _blank, st.lists(st.one_of(inner, inner, st.just("")), min_size=1, max_size=4))
    two = st.builds("{}{}{}{}{}".format, inner, _blank, st.sampled_from(["+", "-", "*", "/", "^", "&", "=", "<>", "<=", ">=", "<", ">"]), _blank, inner)
    return st.one_of(call, two, st.builds("({}{}{})".format, _blank, inner, _blank), st.builds("-{}".format, inner), st.builds("{}%".format, inner))


FORMULA = st.recursive(_leaf, _grown, max_leaves=10)


@given(FORMULA)
def test_printing_gives_the_source(text):
    assert S.parse(text).text() == text


@given(FORMULA, st.sampled_from(["{}+", "{}*", "({}", "{})", "SUM({}", "{},{}", "{} {{", "&{}", '{}"', "{}!"]))
def test_what_is_no_formula(text, broken):
    assert S.parses(broken.format(text, text)) is None


@given(FORMULA)
def test_copies_there_and_back(text):
    there = moved(S.parse(text), 3, 2)
    assert "#REF!" in there or moved(S.parse(there), -3, -2).upper() == text.upper()


@given(FORMULA, st.integers(0, 50), st.integers(0, 50))
def test_copied_formulas_have_one_shape(text, row, col):
    tree = S.parse(text)
    there = moved(tree, row, col)
    if "#REF!" not in there:
        assert S.shape(S.parse(there), 9 + row, 9 + col).full == S.shape(tree, 9, 9).full


def test_precedence():
    power = S.parse("-2^2")
    assert power.op == "^" and power.left.op == "-"
    assert S.parse("1+2*3").right.op == "*" and S.parse('"a"&1+2').op == "&" and S.parse("A1+1>B1*2").op == ">"
    assert S.parse("A1:A5 B2:B6").op == " " and S.parse("A1 + 1").op == "+"
    assert isinstance(S.parse("TRUE()"), S.Call) and isinstance(S.parse("TRUE"), S.Bool)


@given(st.integers(0, 16383))
def test_column_letters(n):
    assert S.column_number(S.column_letters(n)) == n


@given(st.text(alphabet="A1$:!,()+-*'\"#@%{};[] sum", max_size=14))
def test_any_text_parses_or_not_but_never_breaks(text):
    tree = S.parses(text)
    assert tree is None or tree.text() == text


@given(st.lists(st.sampled_from(["SUM", "MAX", "_xlfn.XOR", "Left"]), min_size=1, max_size=4), st.booleans(), st.booleans())
def test_function_names(names, quoted, external):
    text = "A1"
    for n in names:
        text = f"{n}({text})"
    text += '&"MIN(1)"' if quoted else ""
    text += "+[4]Far!B2" if external else ""
    want = {n.upper().removeprefix("_XLFN.") for n in names} | ({"[EXTREF]"} if external else set())
    assert S.functions_in(text) == sorted(want)


def full(text, row, col):
    return S.shape(S.parse(text), row, col)


def test_shapes():
    assert full("A1*B1", 0, 2).full == full("A2*B2", 1, 2).full != full("A1*B2", 1, 2).full
    assert full("$A$1*2", 5, 5) == full("$A$1*2", 9, 9)
    assert full("SUM(D5:D20)", 20, 3).full == full("SUM(E5:E20)", 20, 4).full == full("sum(D5:D20)", 20, 3).full
    a, b = full("SUM(D5:D20)", 20, 3), full("SUM(D5:D19)", 20, 3)
    assert a.full != b.full and a.structural == b.structural and a.ranges[0].r1[1] - b.ranges[0].r1[1] == 1
    assert full("SUM(#REF!)", 0, 0).ref_error and full("#REF!A1+1", 0, 0).ref_error and not full("A1+1", 0, 0).ref_error


def test_copies():
    assert moved(S.parse("A1*$B$2 + Sheet2!C3:D4"), 1, 1) == "B2*$B$2 + Sheet2!D4:E5"
    assert moved(S.parse("A1+A:A"), -1, 0) == "#REF!+A:A"


def num(cells, formula, **at):
    return evaluate(book(cells), formula, **at)


@pytest.mark.parametrize(("formula", "want"), [
    ("SUM(A1:A5)", 10.0), ("SUM(A:A)", 10.0), ("SUM(A1:A5,10)", 20.0), ("SUM((A1:A2,A4))", 10.0), ('SUM("7",A1)', 9.0), ("AVERAGE(B1:B5)", DIV0), ("COUNT(A1:A5)", 3.0), ("MIN(A1:A5)", 2.0), ("MAX(A1:A5)", 5.0),
    ('IF(A1>0,"yes","no")', "yes"), ("IF(A1>0,,5)", 0.0), ("IF(A1<0,5)", False), ("SUM(1/0,5)", DIV0), ("IF(1/0,1,2)", DIV0), ("#N/A*2", NA), ("NOSUCH(1)", NAME), ("_xlfn.XLOOKUP(1,A1:A2,B1:B2)", NAME), ("SUM(A1:A2 C1:C2)", NULL),
    ("SUM(INDEX(A1:A5,2):A4)", 8.0), ("MATCH(3,A1:A5,0)", 2.0), ("MATCH(4,A1:A4)", 2.0), ("VLOOKUP(4,A1:A5,1)", 3.0), ("LARGE(A1:A5,1)", 5.0), ("SMALL(A1:A5,9)", NUM), ("RANK(3,A1:A5)", 2.0), ("RANK(4,A1:A5)", NA), ("MEDIAN(A1:A5)", 3.0),
    ("SUBTOTAL(9,A1:A5)", 10.0), ("SUBTOTAL(12,A1:A5)", VALUE), ("SUMPRODUCT(A1:A2,A1:A2)", 13.0), ("COUNTBLANK(A1:A5)", 2.0), ("SUM(IF(ISBLANK(A1:A4),1,A1:A4*2))", 21.0), ("PRODUCT(A1:A5)", 30.0),
    ("SIGN(0)", 0.0), ("MOD(7,-3)", -2.0), ("ODD(2)", 3.0), ("EVEN(-1)", -2.0), ("FLOOR(-7,2)", -8.0), ("CEILING(7,0)", 0.0), ("FLOOR(7,0)", DIV0), ("FLOOR(7,-2)", NUM), ("LOG(8,2)", 3.0), ("LN(0)", NUM), ("ATAN2(0,0)", DIV0), ("POWER(0,-1)", DIV0),
    ('COUNTIF(A1:A5,">2")', 2.0), ('COUNTIF(A1:A5,"")', 2.0), ('SUMIF(A1:A5,"<>3")', 7.0), ('AVERAGEIF(A1:A5,">9")', DIV0), ("CHOOSE(2,1,,3)", 0.0), ("CHOOSE(4,1,2,3)", VALUE), ("ROWS(A1:B7)", 7.0), ("COLUMNS(A1:B7)", 2.0), ("IFERROR(1/0)", ""),
    ("IFNA(1/0,2)", DIV0), ("AND(A1:A5)", True), ("XOR(TRUE,TRUE,TRUE)", True), ("OR(A3)", VALUE), ('TEXTJOIN("-",TRUE,A1:A5)', "2-3-5"), ('TEXTAFTER("a-b-c","-",-1)', "c"), ('TEXTBEFORE("a-b-c","-",2)', "a-b"), ('TEXTAFTER("abc","-")', NA),
    ('SUBSTITUTE("aXbXc","X","-",2)', "aXb-c"), ('REPLACE("abcdef",2,3,"-")', "a-ef"), ('PROPER("o\'neil x-y 2nd")', "O'Neil X-Y 2Nd"), ('SEARCH("b?d","ABCD")', 2.0), ('FIND("B","abc")', VALUE), ('MID("abc",0,1)', VALUE), ('REPT("ab",-1)', VALUE),
    ("CHAR(200)", "È"), ('CODE("é")', 233.0), ('CODE("")', VALUE), ("T(5)", ""), ("N(TRUE)", 1.0), ('VALUE("1,234%")', 12.34), ("VALUE(TRUE)", VALUE), ("DATE(2020,13,1)", 44197.0), ("DATE(1900,3,1)", 61.0), ("DAY(60)", 29.0), ("MONTH(0)", 1.0),
    ("YEAR(-1)", NUM), ("TIME(25,0,0)", 1 / 24), ("HOUR(0.999999)", 0.0), ("WEEKDAY(1)", 1.0), ("WEEKDAY(1,4)", NUM), ("DAYS(10.9,3.2)", 7.0), ("NORMSDIST(0)", 0.5), ("ERFC(0)", 1.0), ("NORMDIST(1,1,0,TRUE)", NUM), ("#REF!+1", REF), ("{1,2;3,4}", 1.0),
    ("HYPERLINK(\"u\",\"l\")", "l"), ("PI(1)", NAME), ("LOOKUP(4,A1:A2,A1:A2)", 3.0), ("INDEX(A1:A5,9)", REF), ("INDEX(A1:A5,-1)", VALUE), ("COLUMN(C1)", 3.0), ("EXACT(\"a\",\"A\")", False), ("A1:B2 B2:C3", 0.0),
])
def test_cells(formula, want):
    got = num({"A1": 2, "A2": 3, "A4": 5}, formula)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


@given(st.integers(-10**9, 10**9), st.integers(0, 5), st.integers(-3, 6))
def test_rounding(whole, places, digits):
    from decimal import ROUND_DOWN, ROUND_HALF_UP, ROUND_UP, Decimal

    x = Decimal(whole).scaleb(-places)
    for name, way in (("ROUND", ROUND_HALF_UP), ("ROUNDUP", ROUND_UP), ("ROUNDDOWN", ROUND_DOWN)):
        want = float(x.quantize(Decimal(1).scaleb(-digits), way))
        got = num({}, f"{name}({x:f},{digits})")
        if name == "ROUND" or (float(x) * 10.0**digits) % 1 in (0.0, 0.5):
            assert got == pytest.approx(want, abs=1e-9)
        else:
            assert abs(got - want) <= 10.0**-digits * 1.0000001


def test_a_single_value_of_a_range():
    cells = {f"A{i}": 10 * i for i in range(1, 6)}
    assert num(cells, "A1:A5*2", row=2, col=5) == 60 and num(cells, "@A1:A5", row=2, col=5) == 30
    assert num(cells, "A1:A5*2", row=9, col=5) == VALUE


def test_names_and_sheets():
    own = Workbook(names={"RATE": "0.5", "LOOP": "LOOP+1", "ALL": "One:Two!A1"})
    own.add("One").values[0, 0] = 1.0
    own.add("Two").values[0, 0] = 2.0
    assert evaluate(own, "Rate*2") == 1 and evaluate(own, "Loop") == NAME and evaluate(own, "SUM(All)") == 3 and evaluate(own, "Gone!A1") == REF and evaluate(own, "Two!A1") == 2


def test_values():
    assert V.arithmetic("+", "2", 1.0) == 3 and V.arithmetic("+", True, 1.0) == 2 and V.arithmetic("+", None, 1.0) == 1 and V.arithmetic("+", "abc", 1.0) == VALUE
    assert [V.number(t) for t in (" 2.5 ", "50%", "$3", "1,234", "inf", "--5", ",1", "1e3")] == [2.5, 0.5, 3, 1234, VALUE, VALUE, VALUE, 1000]
    assert V.arithmetic("+", NA, DIV0) == NA and V.arithmetic("+", DIV0, NA) == DIV0 and V.arithmetic("^", -8.0, 0.5) == NUM and V.arithmetic("^", -8.0, 2.0) == 64
    assert V.compare("2", 1000.0) == 1 and V.compare(True, "zzz") == 1 and V.compare("Apple", "aPPLE") == 0 and V.compare(None, "0") == -1
    assert all(V.compare(None, z) == 0 for z in (0.0, "", False))
    assert [V.general(x) for x in (3.0, -3.0, 0.5, 1234567890.0, 0.1)] == ["3", "-3", "0.5", "1234567890", "0.1"]


@pytest.mark.parametrize(("text", "yes", "no"), [
    (">=12.5", [12.5, 40.0], [12.0, "13", False, None]), ("<>8", [9.0], [8.0, "8"]), ("17", [17.0, "17.0"], ["17x", None]), ("00042", ["42", 42.0], ["420"]), ("<>00042", ["word"], ["42"]), ("North", ["NORTH", "north"], ["northern", 1.0]),
    ("r*r", ["River", "rr"], ["rivers", 2.0]), ("?at", ["cat", "Bat"], ["chat"]), ("??*", ["ab", "abc"], ["a", 12.0]), ("50~%~?", ["50%?"], ["50%!"]), ("<>s*", ["north"], ["South"]), ("", ["", None], [False, 0.0]), ("=", ["", None], ["x"]), ("<>", ["", 3.0], [None]), ("false", [False], ["false", 0.0, True]),
])
def test_criteria(text, yes, no):
    own = V.criterion(text)
    assert all(own.matches(v) for v in yes) and not any(own.matches(v) for v in no)


def test_dates():
    assert [V.serial(*d) for d in ((1900, 1, 1), (1900, 2, 28), (1900, 3, 1), (2020, 1, 1), (1999, 12, 31), (2000, 2, 29))] == [1, 59, 61, 43831, 36525, 36585]
    assert V.parts_of_serial(60) == (1900, 2, 29) and V.parts_of_serial(V.EPOCH_1904) == (1904, 1, 1)
    assert all(V.serial(*V.parts_of_serial(n)) == n for n in range(1, 80_000) if n != 60)
    assert V.serial(2020, 0, 5) == V.serial(2019, 12, 5) and V.serial(2020, 1, 32) == V.serial(2020, 2, 1)


def test_every_function_is_there():
    assert len(interp.FUNCTIONS) == 130


def test_normal_distribution():
    assert num({}, "NORM.DIST(1,0,1,FALSE)") == pytest.approx(math.exp(-0.5) / math.sqrt(2 * math.pi))
    assert num({}, "NORM.S.DIST(1.96,TRUE)") == pytest.approx(0.9750021048517795)
