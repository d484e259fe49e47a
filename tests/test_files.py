"""PDF texts and workbooks: round trips, the parts of the formats, broken files."""

import base64
import io
import random
import zipfile
import zlib

import pytest

from archivolt.sources import pdf, readers, sinks, workbook


def pages(content):
    return pdf.PdfExtractor().pages(content)


def expected(text, per_page=45):
    lines = text.split("\n")
    return {n: "\n".join(x for x in lines[n * per_page : (n + 1) * per_page] if x).strip() for n in range((len(lines) + per_page - 1) // per_page)}


@pytest.mark.parametrize("compact", [False, True])
def test_texts_come_back(compact):
    r = random.Random(5)
    texts = ["", "uno", "ñ (a) \\ b\r x", "中文 \U0001f642 a\n\n  b  \n", "a\tb\x85c", "\x00\x01é€", "(((", "\\", "x" * 5000, "\n" * 100 + "fin"]
    texts += ["\n".join("".join(r.choice("ab ()\\ñ€中\U0001f642\x80\xad") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 120))) for _ in range(30)]
    for text in texts:
        assert pages(sinks.pdf("", text.split("\n"), 45, compact)) == expected(text)


def file(contents, fonts="/F1 3 0 R", objects=(), resources="", trailer=""):
    """A file of one page without cross references: the reader searches for its objects."""
    stream = contents if isinstance(contents, tuple) else ("", contents)
    body = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [4 0 R] /Count 1 /Resources << /Font << " + fonts.encode() + b" >> " + resources.encode() + b" >> >>", b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>"]
    body += [b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", f"<< /Length {len(stream[1])} {stream[0]} >>\nstream\n".encode() + stream[1] + b"\nendstream", *objects]
    return b"%PDF-1.4\n" + b"".join(f"{n} 0 obj\n".encode() + b + b"\nendobj\n" for n, b in enumerate(body, 1)) + f"trailer << /Root 1 0 R {trailer} >>".encode()


def shown(operators, **more):
    return pages(file(b"BT /F1 10 Tf " + operators + b" ET", **more))[0]


def test_text_operators():
    assert shown(b"(a) Tj 0 -12 Td (b) Tj T* (c) ' 12 TL T* (d) Tj 1 2 (e) \"") == "a\nbc\nd\ne"
    assert shown(b"[(ca) -50 (sa) -400 (dos)] TJ") == "casa dos"
    assert shown(b"(uno) Tj 60 0 Td (dos) Tj") == "uno dos"
    assert shown(b"1 0 0 1 10 700 Tm (a) Tj 1 0 0 1 15 700 Tm (b) Tj 1 0 0 1 10 680 Tm (c) Tj") == "ab\nc"
    assert shown(b"0 1 -1 0 100 100 Tm (up) Tj 0 1 -1 0 112 100 Tm (next) Tj") == "up\nnext"
    assert shown(rb"(\101\102\(\)\\ x\
y) Tj <4D4E4> Tj % (comment)") == "AB()\\ xyMN@"
    assert shown(b"(a) Tj BI /W 1 ID (zz) Tj EI (b) Tj") == "ab"
    form = b"<< /Subtype /Form /Matrix [1 0 0 1 0 -50] /Length 22 >>\nstream\nBT /F1 9 Tf (in) Tj ET\nendstream"
    assert shown(b"(out) Tj ET q /X Do Q BT", objects=[form], resources="/XObject << /X 6 0 R >>") == "out\nin"


def test_fonts():
    named = b"<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /ntilde /eacute /uni00E7 /fi 70 /Euro.alt /qqq] >> >>"
    assert shown(b"(ABCDEFG) Tj", fonts="/F1 6 0 R", objects=[named]) == "ñéçfiE€�"
    program = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <00660069> <0002> <D83DDE42> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00E1> <00E9>] endbfrange endcmap"
    wide = [b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 7 0 R >>", f"<< /Length {len(program)} >>\nstream\n".encode() + program + b"\nendstream"]
    assert shown(b"<000100020010001100120020002100FF> Tj", fonts="/F1 6 0 R", objects=wide) == "fi\U0001f642abcáé�"
    mac = b"<< /Type /Font /Subtype /TrueType /Encoding /MacRomanEncoding /FirstChar 97 /Widths [1000 0] >>"
    assert shown(b"(a\x96) Tj 15 0 Td (b) Tj", fonts="/F1 6 0 R", objects=[mac]) == "añb"


def lzw(data):
    """Plain codes, cleared before the table asks for wider ones."""
    bits, out = "", []
    for n, byte in enumerate(data):
        if n % 200 == 0:
            out.append(256)
        out.append(byte)
    bits = "".join(f"{c:09b}" for c in [*out, 257])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_filters():
    plain = b"BT /F1 10 Tf (hola que tal) Tj ET" + b" " * 7
    assert len(plain) % 8 == 0
    rows = [plain[i : i + 8] for i in range(0, len(plain), 8)]

    def predicted(kind):
        out, above = b"", bytes(8)
        for row in rows:
            coded = []
            for i in range(8):
                left, up, corner = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
                guess = left + up - corner
                paeth = min((left, up, corner), key=lambda v: abs(guess - v))
                coded.append((row[i] - [0, left, up, (left + up) // 2, paeth][kind]) & 255)
            out, above = out + bytes([kind, *coded]), row
        return zlib.compress(out)

    runs = b"".join(bytes([len(r) - 1]) + r for r in rows) + b"\x80"
    tiff = zlib.compress(b"".join(bytes((row[i] - (row[i - 1] if i else 0)) & 255 for i in range(8)) for row in rows))
    coded = {
        "/Filter /FlateDecode": zlib.compress(plain), "/Filter [/ASCIIHexDecode]": plain.hex().encode() + b">", "/Filter /LZWDecode": lzw(plain), "/Filter /RunLengthDecode": runs,
        "/Filter [/ASCII85Decode /FlateDecode]": base64.a85encode(zlib.compress(plain)) + b"~>", "/Filter /FlateDecode /DecodeParms << /Predictor 2 /Columns 8 >>": tiff,
    }
    for how, data in coded.items():
        assert pages(file((how, data)))[0] == "hola que tal"
    for kind in range(5):
        assert pages(file(("/Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns 8 >>", predicted(kind))))[0] == "hola que tal"
    assert pdf.unlzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])  # the format's own example


def test_broken_files_tell_an_error():
    whole = sinks.pdf("", ["uno", "dos"], compact=True)
    assert pages(whole[:-60]) == pages(b"junk" + whole) == pages(whole.replace(b"startxref\n", b"startxref\n9")) == {0: "uno\ndos"}
    loop = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [2 0 R 2 0 R] >> endobj trailer << /Root 1 0 R >>"
    assert pages(loop) == {}
    for bad in (b"", b"none", b"%PDF-1.4 nothing", file(b"BT (open Tj"), file(("/Filter /JPXDecode", b"x")), file(b"", trailer="/Encrypt 9 0 R"), file(("/Filter /FlateDecode", b"xx")), b"%PDF-1.4 1 0 obj " + b"[" * 5000):
        with pytest.raises(pdf.PdfError):
            pages(bad)
    r = random.Random(9)
    for _ in range(300):  # whatever is damaged, there is a text or an error of the file
        damaged = bytearray(whole)
        for _ in range(r.randint(1, 8)):
            damaged[r.randrange(len(damaged))] = r.randrange(256)
        try:
            pages(bytes(damaged))
        except ValueError:
            pass


def test_one_bad_file_is_one_row(spark):
    rows = [(1, bytearray(sinks.pdf("", [str(n) for n in range(100)]))), (2, bytearray(b"%PDF-x")), (3, None)]
    got = readers.page_texts(spark.createDataFrame(rows, "file_id int, content binary")).orderBy("file_id", "page").collect()
    assert [(r.file_id, r.page) for r in got] == [(1, 0), (1, 1), (1, 2), (2, None), (3, None)]
    assert got[1].text.startswith("45\n46") and got[3].error and got[4].error == "no content"


def test_workbooks_of_all_rows(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id", "concat('a', id, '<&>') AS t", "CASE WHEN id % 3 = 0 THEN concat(char(1), '_x0041_', char(13), char(10), ' ñ') END AS odd")
    (tmp_path / "one.xlsx").write_bytes(sinks.workbook({"all & every": df, "none": df.limit(0)}, most=9_000))
    rows = workbook.sheets(spark, str(tmp_path / "one.xlsx"))
    assert rows.select("sheet").distinct().count() == 4 and rows.where("row = 1").count() == 4
    got = rows.where("row > 1").select(*[rows.cells[n] for n in range(3)]).collect()
    assert sorted(map(tuple, got)) == sorted((str(r.id), r.t, r.odd or "") for r in df.collect())
    sinks.write_workbooks(df, str(tmp_path / "many"))
    assert workbook.sheets(spark, str(tmp_path / "many")).where("row > 1").count() == 20_000


def book(path, sheet, strings=None):
    buffer = io.BytesIO()
    workbook.write(buffer, [("S", [], iter([]))])
    with zipfile.ZipFile(buffer) as z, zipfile.ZipFile(path, "w") as out:
        for name in z.namelist():
            data = z.read(name) if "sheet1" not in name else f'<worksheet xmlns="{workbook.SHEET_NS}"><sheetData>{sheet}</sheetData></worksheet>'.encode()
            out.writestr(name, data)
        if strings:
            out.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbook.SHEET_NS}">{strings}</sst>')


def test_cells_of_other_writers(spark, tmp_path):
    strings = "<si><t>uno</t></si><si><r><t>do</t></r><r><t>s</t></r><rPh><t>no</t></rPh></si>"
    sheet = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="4"><c r="B4"><v>1.5</v></c><c t="b"><v>1</v></c><c t="str"><f>A1</f><v>x_x000D_y</v></c></row><row/>'
    book(tmp_path / "a.xlsx", sheet, strings)
    assert list(workbook.rows_of(str(tmp_path / "a.xlsx"), "xl/worksheets/sheet1.xml")) == [(1, ["uno", None, "dos"]), (4, [None, "1.5", "TRUE", "x\ry"]), (5, [])]
    with zipfile.ZipFile(tmp_path / "a.xlsx", "a") as z:
        assert workbook.column_of("AB12") == 27 and z.testzip() is None


def test_synonyms_of_sheets(spark, tmp_path):
    one = spark.createDataFrame([("fiebre ", " calentura"), ("fiebre", "calentura"), ("dolor", None), (" ", "x"), (None, "y"), ("tos", "")], "canonical string, synonym string")
    (tmp_path / "s.xlsx").write_bytes(sinks.workbook({"signos": one, "otros": one.limit(1)}))
    known = spark.createDataFrame([("tos", "tos")], "canonical string, synonym string")
    got = {tuple(r) for r in readers.synonym_sheets(spark, str(tmp_path / "s.xlsx"), known).collect()}
    assert got == {("fiebre", "calentura", "signos"), ("dolor", "dolor", "signos")}


def test_letters_of_a_font_are_read_by_tables():
    """A page's letters are looked up together; fonts and their programs are made once for a file, not for a page."""
    from archivolt.sources import pdf as reader

    lines = ["The quick brown fox (jumps) over" * 3, "ñandú €", "中文 text"] * 40
    made = [sinks.pdf("", lines, 5, compact) for compact in (False, True)]
    calls, code, start = [], reader.Font._code, reader.Font.__init__
    try:
        reader.Font._code = lambda self, c: calls.append("code") or code(self, c)
        reader.Font.__init__ = lambda self, *a: calls.append("font") or start(self, *a)
        for file in made:
            calls.clear()
            pages = reader.PdfExtractor().pages(file)
            assert "\n".join(pages[n] for n in sorted(pages)) == "\n".join(x.strip() for x in lines)
            assert calls.count("font") == 2 and calls.count("code") < 400
    finally:
        reader.Font._code, reader.Font.__init__ = code, start


def test_pages_of_many_files_travel_together(spark, monkeypatch):
    """A batch of small files gives one batch of pages, not one for each file."""
    from archivolt.sources import readers as module

    files = spark.createDataFrame([], "file_id int, content binary")
    captured = {}
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, f, schema, **k: captured.setdefault("f", f) and self)
    module.page_texts(files)
    batch = module.pa.record_batch([module.pa.array(range(21)), module.pa.array([sinks.pdf("", [f"line {n}"]) for n in range(20)] + [None])], names=["file_id", "content"])
    out = list(captured["f"](iter([batch])))
    assert len(out) == 1 and out[0].num_rows == 21 and out[0].column("text").to_pylist()[:20] == [f"line {n}" for n in range(20)]
    assert out[0].column("error").to_pylist()[20] == "no content"
