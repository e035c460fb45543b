"""Office files made here, byte by byte, and what is read from them."""

import io
import zipfile

from corvane.sources import office, parsers

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def book(*sheets, old=""):
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    files = {
        "xl/workbook.xml": f'<workbook {MAIN} {rel}>{old}<sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>",
        "xl/sharedStrings.xml": f'<sst {MAIN}><si><t>Item</t></si><si><r><t>rich </t></r><r><t xml:space="preserve">text</t></r><rPh><t>hint</t></rPh></si></sst>',
        "xl/styles.xml": f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.00&quot;days&quot;"/><numFmt numFmtId="166" formatCode="[h]:mm"/></numFmts><cellXfs>' + "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 164, 165, 166, 20)) + "</cellXfs></styleSheet>",
        **{f"xl/worksheets/s{i}.xml": f'<worksheet {MAIN}>{body}</worksheet>' for i, (_, body) in enumerate(sheets)},
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_sheets():
    rows = (
        '<dimension ref="A1:D9"/><sheetData>'
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
        '<row r="2"><c r="A2"><v>5</v></c><c r="B2"><v>2.5</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" t="e"><v>#N/A</v></c></row>'
        '<row r="3"><c r="A3" t="inlineStr"><is><t> </t></is></c></row>'
        '<row r="5"><c r="A5" s="1"><v>45292</v></c><c r="B5" s="2"><v>45292.5</v></c><c r="C5" s="3"><v>3</v></c><c r="D5" s="4"><v>1.5</v></c></row>'
        '<row r="6"><c r="A6" s="5"><v>0.25</v></c><c r="B6" t="str"><f>1+1</f><v>two</v></c><c r="C6"><f>A1</f></c><c r="D6" t="d"><v>2024-02-03T04:05:06</v></c></row>'
        "</sheetData>"
    )
    plain = '<sheetData><row><c><v>1</v></c><c t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row></sheetData>'
    assert office.sheet_markdown(book(("First", rows), ("Second", plain))).split("\n") == [
        "## First", "Item |  | rich text | ", "5 | 2.5 | True | #N/A", "2024-01-01 00:00:00 | 2024-01-01 12:00:00 | 3 | 1 day, 12:00:00", "06:00:00 | two |  | 2024-02-03 04:05:06", "## Second", "1 | ab",
    ]
    dated = '<sheetData><row><c r="A1" s="1"><v>1</v></c></row></sheetData>'
    assert office.sheet_markdown(book(("D", dated), old='<workbookPr date1904="1"/>')) == "## D\n1904-01-02 00:00:00"
    assert office.sheet_markdown(book(("D", dated))) == "## D\n1900-01-01 00:00:00"


def test_a_large_sheet_is_read_row_by_row():
    rows = "<sheetData>" + "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 60_001)) + "</sheetData>"
    found = office.sheet_markdown(book(("L", rows))).split("\n")
    assert len(found) == 60_001 and found[-1] == "60000"


def p(text, style=None, number=False):
    about = (f'<w:pStyle w:val="{style}"/>' if style else "") + ("<w:numPr/>" if number else "")
    return f'<w:p><w:pPr>{about}</w:pPr><w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


def cell(text, about=""):
    return f"<w:tc><w:tcPr>{about}</w:tcPr>{p(text)}</w:tc>"


def test_documents():
    table = (
        f'<w:tbl><w:tr>{cell("Name")}{cell("Sum", "<w:gridSpan w:val=&quot;2&quot;/>".replace("&quot;", chr(34)))}</w:tr>'
        f'<w:tr>{cell("Rent", "<w:vMerge w:val=&quot;restart&quot;/>".replace("&quot;", chr(34)))}{cell("1")}{cell("a|b")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("2")}{cell("")}</w:tr></w:tbl>'
    )
    body = p("The  title", "T") + p("Part", "H1") + p("plain ") + p("") + "<w:p><w:r><w:t>two</w:t><w:br/><w:t>lines</w:t><w:tab/></w:r></w:p>" + p("one", number=True) + p("two", "ListBullet") + table + p("Sub", "Own") + p("end")
    styles = f'<w:styles {WORD}><w:style w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Own"><w:name w:val="mine"/><w:basedOn w:val="H2"/></w:style><w:style w:styleId="H2"><w:name w:val="Heading 2"/></w:style></w:styles>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {WORD}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)
    assert office.document_markdown(out.getvalue()).split("\n\n") == [
        "# The  title".replace("  ", " "), "## Part", "plain", "two\nlines", "- one\n- two", "| Name | Sum | Sum |\n|---|---|---|\n| Rent | 1 | a\\|b |\n| Rent | 2 |  |", "### Sub", "end",
    ]


def test_files_that_are_broken_are_their_rows_errors(spark):
    good = book(("S", '<sheetData><row><c><v>1</v></c></row></sheetData>'))
    sheet = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
    document = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    files = spark.createDataFrame([("a", bytearray(good), sheet), ("b", bytearray(b"no zip"), sheet), ("c", bytearray(good[:200]), sheet), ("d", bytearray(good), document), ("e", bytearray(book()), sheet)], "path string, content binary, content_type string")
    got = {r["path"]: (r["markdown"], r["error"]) for r in parsers.parse(files).collect()}
    assert got == {"a": ("## S\n1", None), "b": (None, "PARSE_FAILED"), "c": (None, "PARSE_FAILED"), "d": (None, "PARSE_FAILED"), "e": (None, "EMPTY_DOCUMENT")}
