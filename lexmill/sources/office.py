"""Text of word-processor and spreadsheet files: docx, odt and xlsx, which are XML parts in a zip container, and rtf.

Paragraphs end in a line feed, table cells are paragraphs of their own, spreadsheet rows are lines of cells separated by
tabs. What is no such file, a broken or locked one, or one whose XML grows over MAX_PART_BYTES raises Unreadable with the
reason, for the reader that calls this to put into the file's row.
"""

from __future__ import annotations

import codecs
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import wraps
from xml.etree import ElementTree

MAX_PART_BYTES = 1 << 28
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: What zip, XML and number parsing raise on damaged bytes.
_FAULTS = (ElementTree.ParseError, zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, ValueError, OverflowError, struct.error)
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Unreadable(Exception):
    """Why a file has no text."""


def _opened(raw: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except _FAULTS as e:
        raise Unreadable(f"no zip container: {e}") from None


def _events(box: zipfile.ZipFile, name: str) -> Iterator[tuple[str, ElementTree.Element]]:
    """Start and end of the elements of a part, which are not kept."""
    try:
        if box.getinfo(name).file_size > MAX_PART_BYTES:
            raise Unreadable(f"{name} is over {MAX_PART_BYTES} bytes")
        with box.open(name) as part:
            yield from ElementTree.iterparse(part, ("start", "end"))
    except KeyError:
        raise Unreadable(f"no {name} in the container") from None
    except _FAULTS as e:
        raise Unreadable(f"{name}: {e}") from None


def _checked(read: Callable[[bytes], str]) -> Callable[[bytes], str]:
    @wraps(read)
    def checked(raw: bytes) -> str:
        try:
            return read(raw)
        except _FAULTS as e:
            raise Unreadable(str(e)) from None

    return checked


@_checked
def docx_text(raw: bytes) -> str:
    out: list[str] = []
    for event, e in _events(_opened(raw), "word/document.xml"):
        if event == "start":
            continue
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag == f"{_W}tab":
            # A tab stop of a paragraph's properties has the same name and a position.
            out.append("" if f"{_W}val" in e.attrib or f"{_W}pos" in e.attrib else "\t")
        elif e.tag in (f"{_W}br", f"{_W}cr", f"{_W}p"):
            out.append("\n")
            e.clear()
        elif e.tag == f"{_W}noBreakHyphen":
            out.append("-")
    return "".join(out)


@_checked
def odt_text(raw: bytes) -> str:
    out, hidden = [], 0
    for event, e in _events(_opened(raw), "content.xml"):
        if e.tag == f"{_T}tracked-changes":
            hidden += 1 if event == "start" else -1
        elif event == "end" and e.tag in (f"{_T}p", f"{_T}h"):
            if not hidden:
                out.append(f"{_inner(e)}\n")
            tail = e.tail
            e.clear()
            e.tail = tail
    return "".join(out)


def _inner(block: ElementTree.Element) -> str:
    """The text of a paragraph in order, with its tabs, breaks and counted blanks."""
    out = [block.text or ""]
    for e in block:
        mark = {f"{_T}tab": "\t", f"{_T}line-break": "\n", f"{_T}s": " " * int(e.get(f"{_T}c", "1"))}.get(e.tag)
        # A note's own paragraphs are blocks, which have been said already.
        out.append(mark if mark is not None else "" if e.tag == f"{_T}note" else _inner(e))
        out.append(e.tail or "")
    return "".join(out)


@_checked
def xlsx_text(raw: bytes) -> str:
    box = _opened(raw)
    shared, text = [], []
    if "xl/sharedStrings.xml" in box.namelist():
        for event, e in _events(box, "xl/sharedStrings.xml"):
            if event == "end" and e.tag == f"{_S}t":
                text.append(e.text or "")
            elif event == "end" and e.tag == f"{_S}rPh":
                text = text[:-1]
            elif event == "end" and e.tag == f"{_S}si":
                shared.append("".join(text))
                text = []
                e.clear()
    sheets = [e.get(f"{_R}id") for event, e in _events(box, "xl/workbook.xml") if event == "end" and e.tag == f"{_S}sheet"]
    links = {e.get("Id"): e.get("Target", "") for event, e in _events(box, "xl/_rels/workbook.xml.rels") if event == "end"} if "xl/_rels/workbook.xml.rels" in box.namelist() else {}
    names = [links.get(s, f"worksheets/sheet{i}.xml").removeprefix("/xl/") for i, s in enumerate(sheets, 1)]
    out = []
    for name in names:
        for event, e in _events(box, f"xl/{name}"):
            if event == "end" and e.tag == f"{_S}row":
                out.append("\t".join(_cells(e, shared)).rstrip("\t"))
                e.clear()
    return "".join(f"{line}\n" for line in out)


def _cells(row: ElementTree.Element, shared: list[str]) -> list[str]:
    out: list[str] = []
    for cell in row.iter(f"{_S}c"):
        letters = re.match(r"[A-Z]{1,3}", cell.get("r", ""))
        column = 0
        for c in letters[0] if letters else "":
            column = 26 * column + ord(c) - 64
        out += [""] * (column - 1 - len(out))
        kind, value = cell.get("t"), cell.findtext(f"{_S}v") or ""
        if kind == "s":
            if not value.isdigit() or int(value) >= len(shared):
                raise Unreadable("a cell names a string that is not there")
            value = shared[int(value)]
        elif kind == "inlineStr":
            value = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
        out.append(value.replace("\t", " ").replace("\n", " "))
    return out


_TOKEN = re.compile(rb"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.DOTALL)
# Groups of a rich text that are not its text, and words that stand for characters.
_ASIDE = frozenset(b"fonttbl colortbl stylesheet info pict header footer headerl headerr headerf footerl footerr footerf object filetbl listtable listoverridetable revtbl rsidtbl generator xmlnstbl themedata colorschememapping datastore latentstyles fldinst".split())
_SAID = {b"par": "\n", b"line": "\n", b"sect": "\n", b"page": "\n", b"row": "\n", b"cell": "\n", b"tab": "\t", b"emdash": "—", b"endash": "–", b"lquote": "‘", b"rquote": "’", b"ldblquote": "“", b"rdblquote": "”", b"bullet": "•", b"emspace": " ", b"enspace": " "}
_ESCAPED = {b"~": " ", b"_": "-", b"-": "", b"\\": "\\", b"{": "{", b"}": "}", b"\n": "\n", b"\r": "\n"}


@_checked
def rtf_text(raw: bytes) -> str:
    if not raw.lstrip().startswith(b"{\\rtf"):
        raise Unreadable("no rich text")
    out: list[str] = []
    pending, page = bytearray(), "cp1252"
    # By open group: whether it is text, and how many characters follow a Unicode one for older readers.
    stack, shown, fallback, skip, starred = [], True, 1, 0, False

    def flush() -> None:
        out.append(pending.decode(page, "replace"))
        pending.clear()

    for m in _TOKEN.finditer(raw):
        word, number, code, escaped, brace, plain = m.groups()
        if brace == b"{":
            stack.append((shown, fallback))
            starred = skip = 0
        elif brace == b"}":
            if not stack:
                break
            shown, fallback = stack.pop()
            skip = 0
        elif escaped == b"*":
            starred = True
        elif word is not None:
            if word in _ASIDE or starred:
                shown = False
            starred = False
            if word == b"ansicpg" and number:
                flush()
                page = _page(int(number))
            elif word == b"uc" and number:
                fallback = int(number)
            elif word == b"bin":
                raise Unreadable("binary data inside the rich text")
            elif word == b"u" and number and shown:
                flush()
                out.append(chr(int(number) % 0x10000))
                skip = fallback
            elif word in _SAID and shown:
                flush()
                out.append(_SAID[word])
        elif code is not None:
            if skip:
                skip -= 1
            elif shown:
                pending.append(int(code, 16))
        elif escaped is not None:
            if shown:
                flush()
                out.append(_ESCAPED.get(escaped, ""))
        elif plain is not None:
            said = plain[skip:]
            skip = max(0, skip - len(plain))
            if shown:
                pending += said
    if stack:
        raise Unreadable("the rich text ends inside a group")
    flush()
    # Characters beyond the basic plane come as two halves.
    return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _page(number: int) -> str:
    name = f"cp{number}"
    try:
        codecs.lookup(name)
    except LookupError:
        return "cp1252"
    return name


EXTRACTORS = {"docx": docx_text, "odt": odt_text, "rtf": rtf_text}
