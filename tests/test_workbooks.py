"""Workbook files, evaluation over Spark, audits and inspection."""

import io
import random
import zipfile

import pytest

from cellweave.formula.values import Refusal, address, column_number
from cellweave.functions.formats import format_number
from cellweave.operators import cells as ops
from cellweave.operators.audit import find_hardcoded
from cellweave.operators.book import Book
from cellweave.sources import xlsx
from cellweave.sources.html import render, safe_link

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def package(rows, workbook="", shared=None, sheets=("S",), extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="http://r"><sheets>{names}</sheets>{workbook}</workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        for name, data in extra:
            z.writestr(name, data)
    return out.getvalue()


ROWS = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="b"><v>1</v></c><c r="C1" t="e"><v>#N/A</v></c><c r="D1" t="d"><v>2026-01-01</v></c><c r="E1" t="inlineStr"><is><t>in</t></is></c><c r="F1"><v>oops</v></c></row>'
    '<row r="2"><c r="A2"><v>1</v></c><c r="B2"><f t="shared" si="0" ref="B2:B4">A2*2</f><v>2</v></c><c r="C2" t="str"><f>""</f><v></v></c><c r="D2"><f>A2+1</f></c></row>'
    '<row r="3"><c r="A3"><v>2</v></c><c r="B3"><f t="shared" si="0"/><v>5</v></c><c r="C3"><f t="array">SUM(A2:A4)</f><v></v></c></row>'
    '<row r="4"><c r="A4"><v>3</v></c><c r="B4"><f t="shared" si="9"/><v>7</v></c><c><v>1</v></c></row>'
)


def test_reader_types_shared_formulas_and_caches():
    data = package(ROWS, '<definedNames><definedName name="Rate">0.5</definedName><definedName name="_xlnm.Print_Area">A1</definedName></definedNames><workbookPr date1904="1"/><calcPr iterate="1" fullCalcOnLoad="1"/>', ["<r><t>ri</t></r><r><t>ch &#x1;</t></r>"], extra=[("xl/calcChain.xml", "<c/>")])
    found = {address(r[3], r[4]): r for r in xlsx.read_cells("w", data)}
    assert found["A1"][6:8] == (None, "rich &#x1;") and found["B1"][8] is True and found["C1"][9] == "#N/A" and found["D1"][7] == "2026-01-01" and found["E1"][7] == "in" and found["F1"][7] == "oops"
    assert found["B3"][10] == "A3*2" and found["B3"][12] and found["B3"][6] == 5.0 and found["C3"][13] and found["C3"][10] == "SUM(A2:A4)"
    assert found["C2"][11] is True and found["D2"][11] is False and found["C3"][11] is False
    assert found["B4"][10] is None and found["B4"][6] == 7.0  # a sibling without its master is a literal
    facts = xlsx.read_facts("w", data)
    assert facts[1] == ["S"] and [n["name"] for n in facts[2]] == ["Rate"] and facts[3:7] == (True, True, True, True)
    with pytest.raises(ValueError):
        xlsx.Package(package(ROWS)[:0] or _empty())


def _empty():
    out = io.BytesIO()
    zipfile.ZipFile(out, "w").close()
    return out.getvalue()


def test_files_are_evaluated_reported_and_rendered(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(package(ROWS.replace("A2+1", "OFFSET(A2,0,0)"), shared=["<t>x</t>"]))
    (tmp_path / "b.xlsx").write_bytes(package('<row r="1"><c r="A1"><f>1/0</f></c><c r="B1"><f>TEXT(0.5,"0.0%")</f></c><c r="C1"><f>C1+1</f></c></row>'))
    cells = xlsx.cells(spark, str(tmp_path)).cache()
    overlay = ops.evaluate_workbooks(cells).cache()
    rows = {(r.workbook_id[-6:], address(r.row, r.col)): r for r in overlay.collect()}
    assert rows["a.xlsx", "B2"].number == 2 and not rows["a.xlsx", "B2"].stale and rows["a.xlsx", "B3"].number == 4 and rows["a.xlsx", "B3"].stale
    assert rows["a.xlsx", "D2"].provenance == "unsupported" and rows["a.xlsx", "D2"].number is None and rows["b.xlsx", "A1"].err == "#DIV/0!" and rows["b.xlsx", "B1"].text == "50.0%"
    assert rows["b.xlsx", "C1"].provenance == "circular"
    assert {(r.code, r.subject) for r in ops.gaps(overlay).collect()} == {("FN_UNIMPLEMENTED", "OFFSET"), ("CYCLE", "circular reference")}
    counts = {(r.workbook_id[-6:], r.provenance): r.cells for r in ops.provenance_counts(overlay).collect()}
    assert counts["a.xlsx", "computed"] == 4 and counts["b.xlsx", "computed"] == 2
    uses = {r.function: (r.uses, r.supported) for r in ops.function_uses(cells).collect()}
    assert uses["OFFSET"] == (1, False) and uses["SUM"] == (1, True)
    reads = ops.precedents(cells).filter("row = 3 and col = 3").collect()
    assert sorted((r.reads_row, r.reads_col) for r in reads) == [(2, 1), (3, 1), (4, 1)]
    page = render(overlay, rows["a.xlsx", "B2"].workbook_id, "S")
    assert "⚠" in page and ">4<" in page
    assert xlsx.workbooks(spark, str(tmp_path)).count() == 2


def grid(**cells):
    b = Book()
    b.add_sheet("S")
    for name, v in cells.items():
        row, col = int("".join(x for x in name if x.isdigit())), column_number("".join(x for x in name if x.isalpha()))
        b.set_formula(0, row, col, v) if isinstance(v, str) and v[:1] == "=" else b.set_value(0, row, col, v)
    b.evaluate_all()
    return [(address(f.row, f.col), f.stated, f.expected) for f in find_hardcoded(b)]


def band(rnd, width, typed, at=11, value=None):
    """Two rows of inputs over a row of sums, in which the columns in ``typed`` hold numbers (by default wrong ones)."""
    cells = {}
    for i in range(width):
        c = "CDEFGHIJ"[i]
        x, y = rnd.randint(1, 60), rnd.randint(61, 99)
        cells |= {f"{c}{at}": x, f"{c}{at + 1}": y, f"{c}{at + 2}": (x + y + 500 if value is None else value(x + y)) if i in typed else f"=SUM({c}{at}:{c}{at + 1})"}
    return cells


@pytest.mark.parametrize("seed", range(12))
def test_typed_totals_that_must_be_found(seed):
    """A number among formulas of one shape, or right after them, that differs from what the shape gives."""
    rnd = random.Random(seed)
    width = rnd.randint(4, 8)
    at = rnd.randrange(1, width)  # the first place has no formula before it
    cells = band(rnd, width, {at})
    c = "CDEFGHIJ"[at]
    assert grid(**cells) == [(f"{c}13", cells[f"{c}13"], cells[f"{c}11"] + cells[f"{c}12"])]
    # the same table turned: along a column
    flipped = {}
    for name, v in cells.items():
        row, col = int(name[1:]), column_number(name[0])
        flipped[address(col, row)] = f"=K{col}*1+L{col}" if isinstance(v, str) else v
    assert [f[0] for f in grid(**flipped)] == [address(column_number(c), 13)]


@pytest.mark.parametrize("seed", range(12))
def test_shapes_that_must_not_be_reported(seed):
    rnd = random.Random(seed)
    assert grid(**band(rnd, 6, {3}, value=float)) == []  # the number is what the formula would give
    assert grid(**band(rnd, 6, {0})) == []  # it stands before the band
    assert grid(**band(rnd, 6, {1, 2, 3, 4})) == []  # formulas fill less than half of the span
    alone = band(rnd, 5, {4})
    del alone["F13"], alone["F11"], alone["F12"]
    assert grid(**alone) == []  # a gap lies between it and the formulas
    words = band(rnd, 6, {4}) | {"F13": "see note"}
    assert grid(**words) == []  # so does a text
    single = {k: v for k, v in band(rnd, 3, {2}).items() if k[0] != "D"}
    assert grid(**single) == []  # one formula is no band
    # a year whose inputs are blank is another series, typed in as a whole
    prior = band(rnd, 4, {3})
    del prior["F11"], prior["F12"]
    assert grid(**prior) == []


def test_number_formats():
    want = {(5, "000"): "005", (0.125, "0.0%"): "12.5%", (1234.5, "#,##0"): "1,235", (-5, "#,##0;(#,##0)"): "(5)", (1234.5, "$#,##0"): "$1,235", (46228, "yyyy-mm-dd"): "2026-07-25", (46228, "mmm-yy"): "Jul-26", (46228, "d mmm yyyy"): "25 Jul 2026", (2.675, "0.00"): "2.68", (-0.001, "0.0"): "0.0", (1.5, "General"): "1.5", (46228, "yyyymm"): "202607"}
    for (x, code), text in want.items():
        assert format_number(x, code) == text, code
    with pytest.raises(Refusal):
        format_number(1, "[Red]0")


def test_links():
    assert safe_link("https://x") and safe_link("mailto:a@b") and not safe_link("java\tscript:x") and not safe_link("file:///x")


def test_capabilities(spark):
    from cellweave.operators.capabilities import capabilities

    rows = {r.function: r for r in capabilities(spark).collect()}
    assert len(rows) == 230 and rows["SUM"].compiled and rows["SUM"].most is None and rows["OFFSET"].refusal and not rows["OFFSET"].compiled and rows["NOW"].volatile
    assert sum(r.compiled for r in rows.values()) > 180 and all(rows[n].compiled for n in ("VLOOKUP", "SUMPRODUCT", "RANK", "NORM.INV")) and not any(rows[n].compiled for n in ("HLOOKUP", "IRR", "RAND"))


def test_snapshot(spark, tmp_path):
    from cellweave.sources import snapshot

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(package('<row r="1"><c r="A1"><f>1/0</f></c><c r="B1"><f>2*3</f></c></row>'))
    overlay = ops.evaluate_workbooks(xlsx.cells(spark, str(tmp_path / "in")))
    snapshot.save(overlay, str(tmp_path / "out"))
    assert sorted(map(str, snapshot.load(spark, str(tmp_path / "out")).collect())) == sorted(map(str, overlay.collect()))


def test_arrivals(spark, tmp_path):
    from cellweave.streaming.workbooks import evaluate_arrivals

    (tmp_path / "in").mkdir()
    for name, n in (("a", 2), ("b", 5)):
        (tmp_path / "in" / f"{name}.xlsx").write_bytes(package(f'<row r="1"><c r="A1"><v>{n}</v></c><c r="B1"><f>A1*10</f></c></row>'))
        evaluate_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).filter("col = 2").collect()
    assert sorted((r.batch, r.number) for r in rows) == [(0, 20.0), (1, 50.0)]


def test_a_wide_workbook_with_holes():
    """Columns read as arrays agree with cells read one by one, whatever changes while evaluating."""
    import random

    rnd = random.Random(8)
    b = Book()
    b.add_sheet("S")
    for r in range(1, 60):
        for c in range(1, 5):
            kind = rnd.random()
            if kind < 0.5:
                b.set_value(0, r, c, rnd.randrange(9))
            elif kind < 0.6:
                b.set_value(0, r, c, rnd.choice(["x", True, None]))
            elif kind < 0.8 and r > 3:
                b.set_formula(0, r, c, f"=SUM({'ABCD'[c - 1]}1:{'ABCD'[c - 1]}{r - 1})-SUM({'ABCD'[c - 1]}2:{'ABCD'[c - 1]}{r - 1})+COUNT({'ABCD'[c - 1]}1:{'ABCD'[c - 1]}{r - 1})+IFERROR(MATCH(3,{'ABCD'[c - 1]}1:{'ABCD'[c - 1]}{r - 1},0),0)")
    for r in range(1, 60):
        b.set_formula(0, r, 8, f"=SUM(A$1:A{r})")
        b.set_formula(0, r, 9, f"=VLOOKUP({rnd.randrange(1, 9)},A1:D59,3,FALSE)")
    b.evaluate_all()
    fast = {k: r.value for k, r in b.cells.items()}
    b.numbers = b.position = lambda *a: None
    b.evaluate_all()
    assert fast == {k: r.value for k, r in b.cells.items()}


def test_names_and_the_1904_calendar(spark, tmp_path):
    head = '<workbookPr date1904="1"/><definedNames><definedName name="Rate">0.5</definedName></definedNames>'
    rows = '<row r="1"><c r="A1"><f>Rate*4</f></c><c r="B1"><f>YEAR(0)</f></c><c r="C1"><f>DATE(1904,1,2)</f></c><c r="D1"><f>WEEKDAY(0,2)</f></c><c r="E1"><f>EOMONTH(0,1)</f></c></row>'
    (tmp_path / "old.xlsx").write_bytes(package(rows, head))
    (tmp_path / "new.xlsx").write_bytes(package(rows))
    got = {(r.workbook_id[-8:], r.col): r.err or r.number for r in ops.evaluate_files(spark, str(tmp_path)).collect()}
    assert [got["old.xlsx", c] for c in range(1, 6)] == [2, 1904, 1, 5, 59]
    assert [got["new.xlsx", c] for c in range(1, 6)] == ["#NAME?", 1900, 1463, 6, 60]
    # files that arrive bring their names and calendars along
    from cellweave.streaming.workbooks import evaluate_arrivals

    evaluate_arrivals(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    arrived = {(r.workbook_id[-8:], r.col): r.err or r.number for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert arrived == got


def test_inspection_and_lists_without_limits(spark, tmp_path):
    rows = "".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c><c r="B{r}"><f>SUM($A$1:A{r})</f></c></row>' for r in range(1, 701)) + '<row r="701"><c r="A701"><f>OFFSET(A1,1,0)</f><v>2</v></c><c r="B701"><f t="array">SUM(A1:A2*2)</f></c></row>'
    (tmp_path / "w.xlsx").write_bytes(package(rows))
    cells = xlsx.cells(spark, str(tmp_path))
    found = ops.inspect_workbooks(cells).first()
    assert (found.cells, found.formulas, found.array_formulas, found.uncached, found.unsupported, found.fully_covered) == (1402, 702, 1, 701, 1, False)
    assert ops.precedents(cells).filter("row = 700 and col = 2").count() == 700 and ops.precedents(cells, 5).filter("row = 700 and col = 2").count() == 5
    overlay = ops.evaluate_workbooks(cells).cache()
    book = overlay.first().workbook_id
    assert "cut:" in render(overlay, book, "S", rows_shown=10) and "cut:" in render(overlay, book, "S", cols_shown=1) and "cut:" not in render(overlay, book, "S")
    typed = {f"{c}{r}": v for r in range(1, 260) for c, v in (("A", r), ("B", f"=A{r}*2"), ("C", f"=A{r}*2") , ("D", -1.0), ("E", f"=A{r}*2"))}
    assert len(grid(**{k: (v.replace("A", "$A") if isinstance(v, str) else v) for k, v in typed.items()})) == 259
