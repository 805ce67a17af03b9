import codecs
import io
import random
import zipfile

import pytest

from lexmill.sources import encodings, office, readers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
ODF = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


DOCX = packed(**{"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:tabs><w:tab w:val="left" w:pos="720"/></w:tabs></w:pPr><w:r><w:t>Zpráva</w:t><w:tab/><w:t xml:space="preserve"> o stavu</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a &amp; b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t><w:br/><w:t>d</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/></w:body></w:document>'})
ODT = packed(**{"content.xml": f'<office:document-content {ODF}><office:body><office:text><text:tracked-changes><text:p>gone</text:p></text:tracked-changes><text:h>Nadpis</text:h><text:p>dvě<text:s text:c="3"/><text:span>slova<text:tab/></text:span>a<text:line-break/>konec</text:p><table:table><table:table-row><table:table-cell><text:p>buňka</text:p></table:table-cell></table:table-row></table:table></office:text></office:body></office:document-content>'})
XLSX = packed(**{
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="A" sheetId="1" r:id="r2"/><sheet name="B" sheetId="2" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/one.xml"/><Relationship Id="r2" Target="worksheets/two.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>jméno</t></si><si><r><t>spo</t></r><r><t>jené</t></r></si></sst>",
    "xl/worksheets/one.xml": f'<worksheet {S}><sheetData><row><c r="A1"><v>3.5</v></c></row></sheetData></worksheet>',
    "xl/worksheets/two.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
})
RTF = rb"{\rtf1\ansi\ansicpg1250\deff0{\fonttbl{\f0 Arial;}}{\colortbl;\red0;}{\*\generator Some Writer;}\pard P\'f8\'edli\'9a \b tu\'e8n\'fd\b0\par\tab \u382?lu\uc2\u357 tt{\uc1 \u269\'e8}\{\}\line e{\header H}nd}"


def test_office_texts():
    assert office.docx_text(DOCX) == "Zpráva\t o stavu\na & b\nc\nd\n\n"
    assert office.odt_text(ODT) == "Nadpis\ndvě   slova\ta\nkonec\nbuňka\n"
    assert office.xlsx_text(XLSX) == "jméno\t\tspojené\n\tx\n3.5\n"
    assert office.rtf_text(RTF) == "Příliš tučný\n\tžluťč{}\nend"


@pytest.mark.parametrize("read", [office.docx_text, office.odt_text, office.xlsx_text, office.rtf_text])
def test_broken_office_files_say_why(read):
    good = {office.docx_text: DOCX, office.odt_text: ODT, office.xlsx_text: XLSX, office.rtf_text: RTF}[read]
    rng = random.Random(3)
    for raw in [b"", b"PK", good[: len(good) // 2], packed(other="x"), *[bytes(b ^ (rng.random() < 0.02) for b in good) for _ in range(60)]]:
        try:
            assert isinstance(read(raw), str)
        except office.Unreadable as e:
            assert str(e)


TEXTS = {
    "cs": "Pacient byl přijat pro bolesti na hrudi. Žádné známky krvácení, řídká stolice, šelest nad srdcem. ÚTERÝ: příští kontrola, léky třikrát denně.",
    "de": "Der Patient wurde wegen Übelkeit überwiesen; größere Schäden wurden „nicht“ gefunden. ÄRZTE prüfen weiter.",
    "fr": "Le malade a été hospitalisé à l'hôpital, où l'on a noté « une forte fièvre » et des œdèmes.",
    "es": "El niño señaló dolor de corazón; mañana habrá más análisis según el médico. ¿Cuándo vendrá?",
}
PAGES = {"cs": ("cp1250", "iso8859-2"), "de": ("cp1252",), "fr": ("cp1252",), "es": ("cp1252",)}


@pytest.mark.parametrize("lang", TEXTS)
def test_encodings_are_detected(lang):
    text = TEXTS[lang]
    for page in (*PAGES[lang], "utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-32"):
        assert encodings.text_of(text.encode(page))[0] == text, page


def test_short_files_follow_the_code_page_of_those_beside_them(spark):
    # Alone, È at the start of a word reads as Č, which Czech has more often; a line that repeats is no more evidence.
    texts = [*[TEXTS[lang] for lang in ("de", "fr", "es")] * 3, "Èoi, oieau, aiouon.", "Le ètre oimentvi oipale oure.\n" * 200]
    files = [(i, t, t.encode("cp1252")) for i, t in enumerate(texts)]
    files += [(90, "šelest", "šelest".encode()), (91, TEXTS["cs"], TEXTS["cs"].encode("cp1250")), (92, None, None)]
    got = readers.decoded_bytes(spark.createDataFrame(files, "id int, said string, content binary")).collect()
    assert {r.id: r.text for r in got} == {i: t for i, t, _ in files}
    assert {r.encoding for r in got if r.id < 90} == {"cp1252"}


def test_bytes_in_no_encoding_have_no_text():
    assert encodings.text_of(b"\x00\x01\x02\xff\x80\x81") == ("", None)
    assert encodings.text_of(b"") == ("", "utf-8") and encodings.text_of(codecs.BOM_UTF8) == ("", "utf-8-sig")
    assert encodings.text_of(codecs.BOM_UTF16_LE + b"a") == ("", None)


def test_every_file_has_a_row(spark, tmp_path):
    files = {"a.docx": DOCX, "b.odt": ODT, "c.rtf": RTF, "d.xlsx": XLSX, "e.pptx": b"PK", "f.pdf": b"one\x0ctwo", "g.txt": "žluť".encode("cp1250"), "h.docx": b"broken", "i.txt": b"\x00\x01\x02\xff\x81", "j.doc": b"\xd0\xcf", "k.exe": b"MZ"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.text_files(spark, f"file://{tmp_path}", lambda raw: raw.decode().split("\x0c")).collect()}
    assert sorted(got) == sorted(set(files) - {"k.exe"})
    assert got["a.docx"].text.startswith("Zpráva") and got["f.pdf"].text == f"one{readers.BETWEEN_PAGES}two"
    assert got["d.xlsx"].text == readers.SPREADSHEET_NOTE and got["e.pptx"].text == readers.SLIDES_NOTE
    assert (got["g.txt"].text, got["g.txt"].encoding) == ("žluť", "cp1250")
    assert {n: got[n].problem is not None for n in got} == {n: n in ("h.docx", "i.txt", "j.doc") for n in got}
    assert all(got[n].text == "" for n in ("h.docx", "i.txt", "j.doc"))
    sheets = {r.path.rsplit("/", 1)[1]: r.text for r in readers.text_files(spark, f"file://{tmp_path}", spreadsheets=True).collect()}
    assert sheets["d.xlsx"].startswith("jméno\t") and sheets["f.pdf"] == readers.UNKNOWN_NOTE % "pdf"


def test_failed_files_are_rows(spark):
    def pages(raw):
        if raw == b"bad":
            raise ValueError("no pages here")
        return raw.decode().split("|") if raw else []

    files = spark.createDataFrame([("a", b"x| y "), ("b", b"bad"), ("c", b"")], "path string, content binary")
    assert sorted((r.doc, r.page, r.text) for r in readers.page_texts(files, pages).collect()) == [("a", 0, "x"), ("a", 1, "y")]
    assert [tuple(r) for r in readers.failed_files(files, pages).collect()] == [("b", "no pages here")]
    assert sorted((r.doc, r.page is None) for r in readers.extracted(files, pages).collect()) == [("a", False), ("a", False), ("b", True), ("c", True)]
