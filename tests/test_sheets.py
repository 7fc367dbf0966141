"""Workbook files, receipts, findings, coarsening, the census and reports."""

import pytest

from gridloom.functions.values import DIV0
from gridloom.operators import census, lint, receipt, report
from gridloom.plans import syntax as S
from gridloom.plans.workbook import Workbook
from gridloom.sources import xlsx
from tests.books import book, budget


def cells(spark, **books):
    return spark.createDataFrame([r for n, b in books.items() for r in xlsx.rows_of(n, b)], xlsx.CELLS)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("books")
    (top / "deep").mkdir()
    (top / "budget.xlsx").write_bytes(xlsx.write(budget()))
    (top / "deep" / "basic.xlsx").write_bytes(xlsx.write(book({"A1": 2, "A2": 3, "A3": "=SUM(A1:A2)", "B1": "=A3*2"})))
    (top / "copy.xlsx").write_bytes(xlsx.write(budget()))
    (top / "junk.xlsx").write_bytes(b"PK but no archive")
    (top / "notes.txt").write_bytes(b"text")
    return top


def test_files_read_as_written():
    own = book({"A1": 1.5, "A2": "x & <y>", "A3": True, "A4": "=1/0", "B1": '=A1&"é"', "C9": "=SUM(A1:A2)"})
    own.sheets[0].arrays.add((8, 2))
    own.names["RATE"] = "S!$A$1"
    own.epoch_1904 = True
    back = xlsx.File(xlsx.write(own)).workbook()
    assert back == own and back.sheets[0].values[3, 0] == DIV0


def test_shared_formulas_and_strings(tmp_path):
    import zipfile

    plain = xlsx.write(book({"A1": 1}))
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><f t="shared" ref="B1:B3" si="0">A1*$C$1</f><v>2</v></c></row><row r="2"><c r="B2"><f t="shared" si="0"/><v>4</v></c></row><row><c><v>7</v></c><c t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row></sheetData></worksheet>'
    path = tmp_path / "s.xlsx"
    with zipfile.ZipFile(path, "w") as out, zipfile.ZipFile(__import__("io").BytesIO(plain)) as z:
        for n in z.namelist():
            out.writestr(n, sheet if "sheet1" in n and "worksheets" in n else z.read(n))
        out.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>one</t><rPh><t>no</t></rPh></si></sst>')
    own = xlsx.File(path.read_bytes()).workbook().sheets[0]
    assert own.formulas == {(0, 1): "A1*$C$1", (1, 1): "A2*$C$1"} and own.values[0, 0] == "one" and own.values[2, 0] == 7 and own.values[2, 1] == "ab"


def test_scans(spark, folder):
    spark.dataSource.register(xlsx.WorkbookSource)
    one = spark.read.format("workbook").load(str(folder))
    two = xlsx.read_binary(xlsx.binaries(spark, str(folder)))
    assert one.count() == two.count() > 150 and one.where("formula is not null").groupBy("wb").count().count() == 3


def test_survey_subset_manifest(spark, folder):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder))
    own = xlsx.surveyed(files).persist()
    assert {r["path"].rsplit("/")[-1]: r["status"] for r in own.collect()} == {"budget.xlsx": "ok", "basic.xlsx": "ok", "copy.xlsx": "ok", "junk.xlsx": "open_error", "notes.txt": "not_zip"}
    assert [r["formula_cells"] for r in xlsx.subset(own).collect()] == [29]
    assert {r["path"].rsplit("/")[-1] for r in xlsx.unloadable(own).collect()} == {"junk.xlsx", "notes.txt"}
    manifest = own.select(own["path"].alias("file"), "sha256").union(spark.createDataFrame([("gone", "x")], "file string, sha256 string"))
    assert [r["file"] for r in xlsx.verified(manifest, own).collect()] == ["gone"]


def test_budget(spark):
    own = cells(spark, budget=budget())
    row = receipt.summary(receipt.report(own)).first()
    assert (row["cells"], row["passed"], row["verifiable"], row["pass_rate"]) == (29, 29, 29, 1.0)
    found = {r["cell"]: r for r in lint.findings(own).collect()}
    assert {c: r["detector"] for c, r in found.items()} == {"F9": "range-off-by-one", "G7": "inconsistent-region"}
    assert "one boundary short/long by one" in found["F9"]["proof"] and found["G7"]["proof"].startswith("Budget!G4:G15: 11 of 12 cells")
    assert lint.caret("SUM(B9:D9)", found["F9"]["proof"], 8, 5).endswith("    ^^^^^")


def formulas(pairs):
    own = Workbook()
    sheet = own.add("S")
    for (r, c), text in pairs.items():
        sheet.formulas[r, c] = text
    return own


def row_run(short, n=8, start=2):
    return formulas({(9, c): f"SUM({S.column_letters(c)}1:{S.column_letters(c)}{7 if c == short else 8})" for c in range(start, start + n)})


def column_run(odd, n=8, col=2):
    return formulas({(r, col): odd.get(r, f"A{r + 1}*2").replace("#", str(r + 1)) for r in range(n)})


@pytest.mark.parametrize(("own", "want"), [
    (row_run(6), [("range-off-by-one", "G10")]), (row_run(9), []), (column_run({3: "A#*3"}), []), (column_run({3: "B#*2"}), [("inconsistent-region", "C4")]), (column_run({3: "B#*2", 9: "B#*2"}, 12), []), (column_run({3: "$C$1*2"}), []),
    (column_run({}, 20), []), (formulas({(0, 0): "SUM(#REF!)"}), [("ref-error", "A1")]), (row_run(4, 5), []),
])
def test_findings(spark, own, want):
    assert [(r["detector"], r["cell"]) for r in lint.findings(cells(spark, w=own)).collect()] == want


def test_baselines_samples_and_audits(spark, tmp_path):
    own = cells(spark, budget=budget())
    found = lint.findings(own)
    report.baseline(found.where("cell = 'F9'"), str(tmp_path / "b"))
    assert [r["cell"] for r in lint.new_findings(found, spark.read.parquet(str(tmp_path / "b"))).collect()] == ["G7"]
    assert lint.sampled(found, 1).count() == 2
    beside = {r["cell"]: [x["cell"] for x in r["around"] if x] for r in lint.audit(found, own).collect()}
    assert beside["F9"] == ["E9", "F10", "F8", "G9"]
    assert "warning [range-off-by-one]" in report.diagnostics(found)
    text = report.markdown("Budget", {"cells": 29}, found.collect(), [{"cell": "B!A1", "mean": 1.0, "sd": 2.0, "p5": 0.0, "p50": 1.0, "p95": 2.0}])
    assert "**range-off-by-one** Budget!F9" in text and "| B!A1 |" in text


def test_coarsening(spark):
    fifty = formulas({(r, 1): f"A{r + 1}*2" for r in range(50)})
    mixed = formulas({(r, 1): f"A{r + 1}*{2 if r < 5 else 3}" for r in range(10)})
    across = formulas({(0, c): "A$1*2" if c == 1 else f"{S.column_letters(c - 1)}$1*2" for c in range(1, 4)} | {(5, 0): "1+1"})
    out = {r["wb"]: (r["cells"], r["families"]) for r in lint.coarsening(cells(spark, fifty=fifty, mixed=mixed, across=across)).collect()}
    assert out == {"fifty": (50, 1), "mixed": (10, 2), "across": (4, 2)}


def test_families_are_their_cells(spark):
    out = receipt.families_agree(cells(spark, budget=budget(), w=column_run({3: "B#*2"}))).collect()
    assert sum(r["lanes"] for r in out) == 29 + 8 and all(r["differing"] == 0 for r in out)


def test_receipt_classes(spark):
    own = book({"A1": 1, "B1": "=A1+1", "B2": "=NOW()", "B3": "=[1]X!A1", "B4": "=XLOOKUP(1,A1,A1)", "B5": "=A1*0.1*3", "B6": "=SUM(", "B7": "=A1", "B8": '="a"&"b"', "B9": "=1/0", "B10": "=A1"}, evaluate=False)
    sheet = own.sheets[0]
    sheet.values |= {(0, 1): 2.0, (1, 1): 5.0, (2, 1): 1.0, (3, 1): 1.0, (4, 1): 0.3, (5, 1): 1.0, (7, 1): "xx", (8, 1): DIV0, (9, 1): "1"}
    out = {(r["row"] + 1): (r["outcome"], r["class"]) for r in receipt.report(cells(spark, w=own)).collect()}
    assert out == {1: ("pass", "exact"), 2: ("excluded", "volatile"), 3: ("excluded", "external_ref"), 4: ("excluded", "unimplemented"), 5: ("pass", "ulp1"), 6: ("excluded", "parse"), 7: ("no_cached", ""), 8: ("mismatch", "text"), 9: ("pass", "exact"), 10: ("mismatch", "type")}
    rates = {r["function"]: (r["passed"], r["total"]) for r in receipt.by_function(receipt.report(cells(spark, b=budget()))).collect()}
    assert rates == {"SUM": (17, 17)}
    assert receipt.failures(receipt.report(cells(spark, w=own))).count() == 2
    assert receipt.classify(1.0, 1.0 + 1e-16) == ("pass", "exact") and receipt.classify(1.0, 1.0 + 1e-14) == ("mismatch", "numeric") and receipt.classify(0.1, 0.10000000000000009) == ("pass", "sig15")


def test_census(spark):
    a = book({"A1": "=SUM(B1:B2)", "A2": "=SUM(B2:B3)", "A3": '=IF(A1>0,"SUM(",0)', "A4": "=TODAY()+RAND()"}, evaluate=False)
    b = book({"A1": "=SUM(B1:B2)", "A2": "=SUM((", "A3": "=SUM(("}, evaluate=False)
    own = cells(spark, a=a, b=b)
    combos = census.combos(own).persist()
    assert [tuple(r) for r in census.census(combos).collect()] == [("SUM", 5, 2), ("IF", 1, 1), ("RAND", 1, 1), ("TODAY", 1, 1)]
    assert [tuple(r) for r in census.volatile(combos).collect()] == [("a", ["RAND", "TODAY"])]
    assert [(r["formula"], r["count"], r["kind"]) for r in census.parse_corpus(own).collect()] == [("SUM((", 2, "parse")]
    assert [r["function"] for r in census.covering(census.census(combos), 0.6).collect()] == ["SUM"]
    row = census.projection(combos, ["SUM"]).first()
    assert (row["workbooks"], row["full"], row["partial"], row["refusal"]) == (2, 0.5, 0.5, 0.0) and row["cell_coverage"] == pytest.approx(5 / 7)
