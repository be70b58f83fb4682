"""Spreadsheets in both formats: sheets, blank rows, shared and inline strings, numbers, repeats, broken files, a long sheet."""

import zipfile

import pytest

from kgspark.sources import spreadsheets as X

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def xlsx(path, sheets, strings=""):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        rel = "".join(f'<Relationship Id="r{k}" Target="{"/xl/" if k % 2 else ""}worksheets/s{k}.xml"/>' for k in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rel}</Relationships>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        for k, (_, body) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')


def ods(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("content.xml", '<o:document-content xmlns:o="urn:office" xmlns:t="urn:table" xmlns:x="urn:text"><o:body><o:spreadsheet>' + body + "</o:spreadsheet></o:body></o:document-content>")


STRINGS = "<si><t>name</t></si><si><r><t>Ti</t></r><r><t>n </t></r><rPh><t>no</t></rPh></si><si><t xml:space='preserve'> 산화 </t></si>"
ONE = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>mass</t></is></c></row><row r="2"/>'
    '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"/><c r="C3"><v>118.710</v></c><c r="D3" t="b"><v>1</v></c><c r="E3" t="e"><v>#N/A</v></c></row>'
    '<row r="4"><c r="A4" t="str"><f>A1</f><v>  </v></c></row><row r="9"><c r="A9" t="s"><v>2</v></c><c r="B9"><v>4.0E1</v></c><c r="C9"><v>1e-9</v></c></row>'
)


def test_workbooks_of_both_formats(spark, tmp_path):
    xlsx(tmp_path / "a.xlsx", [("One", ONE), ("None", ""), ("둘", '<row><c><v>1</v></c></row><row><c><v>2</v></c></row>'), ("Blank", '<row r="5"><c r="A5"/></row>')], STRINGS)
    ods(tmp_path / "b.ods", (
        '<t:table t:name="First"><t:table-row><t:table-cell o:value-type="string" t:number-columns-repeated="2"><x:p>a<x:s x:c="2"/>b</x:p></t:table-cell>'
        '<t:table-cell t:number-columns-repeated="16000"/></t:table-row><t:table-row t:number-rows-repeated="1000000"><t:table-cell/></t:table-row>'
        '<t:table-row t:number-rows-repeated="2"><t:table-cell o:value-type="float" o:value="2.50"><x:p>2.5 kg</x:p></t:table-cell></t:table-row></t:table>'
        '<t:table t:name="Second"><t:table-row><t:table-cell o:value-type="boolean" o:boolean-value="true"/></t:table-row></t:table>'
    ))
    (tmp_path / "c.txt").write_text("passed over")
    rows = X.read_spreadsheets(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 6  # a sheet each
    got = {(r["path"].rsplit("/")[-1], r["sheet"], r["row"]): r["cells"] for r in rows.collect()}
    assert got == {
        ("a.xlsx", "One", 0): [], ("a.xlsx", "One", 1): ["name", "mass"], ("a.xlsx", "One", 3): ["Tin", "118.71", "true"], ("a.xlsx", "One", 9): ["산화", "40", "1e-9"],
        ("a.xlsx", "둘", 0): [], ("a.xlsx", "둘", 1): ["1"], ("a.xlsx", "둘", 2): ["2"], ("a.xlsx", "Blank", 0): [],
        ("b.ods", "First", 0): [], ("b.ods", "First", 1): ["a  b", "a  b"], ("b.ods", "First", 1000002): ["2.5"], ("b.ods", "First", 1000003): ["2.5"],
        ("b.ods", "Second", 0): [], ("b.ods", "Second", 1): ["true"],
    }
    text = {r["path"].rsplit("/")[-1]: r["text"] for r in X.text(rows).collect()}
    assert text["a.xlsx"] == "[시트: One]\nname\tmass\nTin\t118.71\ttrue\n산화\t40\t1e-9\n[시트: 둘]\n1\n2\n[시트: Blank]"
    assert text["b.ods"] == "[시트: First]\na  b\ta  b\n2.5\n2.5\n[시트: Second]\ntrue"
    whole = X.read_spreadsheets(spark, f"file://{tmp_path}", "file")
    assert whole.rdd.getNumPartitions() == 2 and whole.drop("path").exceptAll(rows.drop("path")).isEmpty() and whole.count() == rows.count()


@pytest.mark.parametrize("split", ["sheet", "file"])
def test_a_broken_file_is_named(spark, tmp_path, split):
    xlsx(tmp_path / "good.xlsx", [("One", ONE)], STRINGS)
    (tmp_path / "torn.xlsx").write_bytes((tmp_path / "good.xlsx").read_bytes()[:200])
    with pytest.raises(Exception, match="torn.xlsx"):
        X.read_spreadsheets(spark, str(tmp_path), split).collect()


def test_no_file_and_a_missing_folder(spark, tmp_path):
    assert X.read_spreadsheets(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        X.read_spreadsheets(spark, str(tmp_path / "nowhere")).collect()


def test_a_long_sheet_is_a_stream(tmp_path):
    import tracemalloc

    n = 60_000
    xlsx(tmp_path / "long.xlsx", [("S", "".join(f'<row r="{k}"><c><v>{k}</v></c><c t="inlineStr"><is><t>some text</t></is></c></row>' for k in range(1, n + 1)))])
    tracemalloc.start()
    count = sum(1 for _ in X.Reader(str(tmp_path), "sheet").read(X.Sheet(str(tmp_path / "long.xlsx"), 0)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == n + 1 and peak < 4 << 20
