"""Workbooks that are made here, read back as tables."""

import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

import pytest

from reviewmill.sources import tables
from reviewmill.sources.xlsx import header_names, read_xlsx

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letters(i):
    return (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)


def write(path, sheets, shared=True, since_1904=False):
    """sheets: name to rows of cells; datetimes are numbers with a date style, None is a blank cell."""
    strings, parts = [], {}
    for n, rows in enumerate(sheets.values(), 1):
        xml = []
        for i, row in enumerate(rows, 1):
            cells = []
            for j, v in enumerate(row):
                at = f'r="{letters(j)}{i}"'
                if v is None:
                    continue
                if isinstance(v, bool):
                    cells.append(f'<c {at} t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, datetime):
                    cells.append(f'<c {at} s="{1 + j % 2}"><v>{(v - datetime(1904, 1, 1) if since_1904 else v - datetime(1899, 12, 30)).total_seconds() / 86400}</v></c>')
                elif isinstance(v, (int, float)):
                    cells.append(f'<c {at} s="3"><v>{v}</v></c>')
                elif v == "#N/A":
                    cells.append(f'<c {at} t="e"><v>{v}</v></c>')
                elif shared:
                    strings.append(f"<si><r><t>{escape(v[:1])}</t></r><r><t>{escape(v[1:])}</t></r><rPh><t>reading</t></rPh></si>")
                    cells.append(f'<c {at} t="s"><v>{len(strings) - 1}</v></c>')
                else:
                    cells.append(f'<c {at} t="inlineStr"><is><t>{escape(v)}</t></is></c>')
            xml.append(f'<row r="{i}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{n}.xml"] = f"<worksheet {NS}><sheetData>{''.join(xml)}</sheetData></worksheet>"
    named = "".join(f'<sheet name="{escape(s)}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook {NS}><workbookPr date1904="{int(since_1904)}"/><sheets>{named}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i % 2 else ""}worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>"
    parts["xl/styles.xml"] = f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd &quot;x&quot;"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    if strings:
        parts["xl/sharedStrings.xml"] = f"<sst {NS}>{''.join(strings)}</sst>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)


ROWS = [
    ["content", "star", "date", " id ", "ok", "content", None, "mixed", "blank"],
    ["很好 <&>", 4, datetime(2025, 4, 18), 1, True, "a", "x", 1, None],
    [None, 4.5, datetime(2025, 4, 18, 13, 30), 2, None, None, None, "00123", None],
    [None] * 9,
    ["#N/A", None, None, 3, False, "c", None, None, None, "beyond"],
]


@pytest.mark.parametrize("shared, since_1904", [(True, False), (False, True)])
def test_round_trip(spark, tmp_path, shared, since_1904):
    write(tmp_path / "r.xlsx", {"first": [[None], *ROWS], "总表": [["a"], [1]]}, shared, since_1904)
    got = tables.read_reviews(spark, str(tmp_path / "r.xlsx"))
    assert got.dtypes == [
        ("content", "string"), ("star", "double"), ("date", "timestamp"), ("id", "bigint"), ("ok", "boolean"), ("content.1", "string"), ("Unnamed: 6", "string"), ("mixed", "string"), ("blank", "string"), ("Unnamed: 9", "string"),
    ]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[3]) == [
        ("很好 <&>", 4.0, datetime(2025, 4, 18), 1, True, "a", "x", "1", None, None), (None, 4.5, datetime(2025, 4, 18, 13, 30), 2, None, None, None, "00123", None, None), (None, None, None, 3, False, "c", None, None, None, "beyond"),
    ]
    assert read_xlsx(spark, str(tmp_path / "r.xlsx"), "总表").collect() == read_xlsx(spark, str(tmp_path / "r.xlsx"), 1).collect() and read_xlsx(spark, str(tmp_path / "r.xlsx"), 1).first().a == 1


def test_folders_and_bad_sheets(spark, tmp_path):
    write(tmp_path / "a.xlsx", {"s": [["x", "y"], [1, "p"]]})
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/b.XLSX", {"s": [["y", "z"], ["q", 2.5], ["r", None]], "t": []})
    got = read_xlsx(spark, str(tmp_path))
    assert dict(got.dtypes) == {"x": "bigint", "y": "string", "z": "double"}
    assert sorted((r.x, r.y, r.z) for r in got.filter("x is not null").collect()) == [(1, "p", None)] and sorted((r.y, r.z) for r in got.filter("x is null").collect()) == [("q", 2.5), ("r", None)]
    write(tmp_path / "in/only.xlsx", {"s": [["h1", "h2"]]})
    assert read_xlsx(spark, str(tmp_path / "in/only.xlsx")).columns == ["h1", "h2"] and read_xlsx(spark, str(tmp_path / "in/only.xlsx")).count() == 0
    with pytest.raises(Exception, match="has no sheet nope; there are: s"):
        read_xlsx(spark, str(tmp_path / "a.xlsx"), "nope")
    (tmp_path / "bad.xlsx").write_text("no zip")
    with pytest.raises(Exception, match="bad.xlsx is no workbook"):
        read_xlsx(spark, str(tmp_path / "bad.xlsx"))
    with pytest.raises(ValueError, match="no workbook in"):
        (tmp_path / "none").mkdir()
        (tmp_path / "none/a.txt").write_text("x")
        read_xlsx(spark, str(tmp_path / "none"))


def test_header_names():
    assert header_names({0: "sa", 2: "sa", 3: "i7", 4: "s "}) == ["a", "Unnamed: 1", "a.1", "7", "Unnamed: 4"]


def test_many_rows(spark, tmp_path):
    write(tmp_path / "m.xlsx", {"s": [["k", "v"], *([i, f"v{i}"] for i in range(20_000))]})
    got = read_xlsx(spark, str(tmp_path / "m.xlsx"))
    assert got.selectExpr("count(*)", "sum(k)", "count(distinct v)").first() == (20_000, sum(range(20_000)), 20_000)
