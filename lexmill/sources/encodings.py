"""Which encoding bytes are text in: marks of order, zero bytes, UTF-8, then code pages by likelihood.

A byte-order mark decides. Without one, UTF-16 shows by zero bytes in every other place. What is valid UTF-8 is UTF-8. The
rest is in one of CODE_PAGES, for Czech and its neighbours or for western languages: each decodes the bytes, and pairs of
neighbouring characters are weighed by the likelihood of their kinds in running text, in which accented letters stand
between letters of the same case, are those of one language, and signs stand between words. A short file often leaves that
open, as È and Č are one byte: where it is known in which code pages the files beside it seem to be, that is weighed in.
Bytes that no code page has, or that decode to control characters, are in none: such files have no text.
"""

from __future__ import annotations

import codecs
import math
import re
from collections.abc import Sequence
from functools import cache

#: Code pages, with the accented letters of the languages that are written in them.
CENTRAL, WESTERN = "áčďéěíňóřšťúůýžäôĺľŕąćęłńśźżőűöüß", "àâäáãåçèéêëìíîïñòóôõöœùúûüÿßæø"
CODE_PAGES = {"cp1250": CENTRAL, "iso8859-2": CENTRAL, "cp1252": WESTERN}
#: How often the letters beyond ASCII are met in a thousand of them, in Czech and in western texts; others once.
COMMON = {CENTRAL: {"í": 150, "á": 140, "é": 90, "ě": 90, "ř": 75, "č": 65, "ý": 65, "ž": 65, "š": 55, "ů": 40, "ú": 10, "ó": 5}, WESTERN: {"é": 220, "ü": 90, "ä": 80, "ö": 50, "à": 60, "è": 50, "ó": 60, "í": 60, "á": 50, "ñ": 30, "ß": 40, "ê": 25, "ç": 20, "ú": 15, "ô": 10, "î": 8, "û": 8, "ù": 8, "â": 8, "ë": 4, "ï": 4}}
# Typographic signs that western and central texts both use.
SIGNS = "„“”‚‘’–—…«»‹›•§°€ ´"
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
_CONTROL = re.compile("[\x00-\x08\x0e-\x1b\x7f]")
#: Bytes of which the likelihood is taken, the first that are not ASCII with their neighbours; the whole text is decoded.
EVIDENCE = 1 << 16
_WITH_NEIGHBOURS = re.compile(rb"(?s)(?=(.[\x80-\xff].))")


def _utf16(raw: bytes) -> str | None:
    """UTF-16 without a mark: most characters of the lower half of the alphabet have a zero byte on one side only."""
    some = raw[: 1 << 12]
    if len(raw) % 2 or not some:
        return None
    even, odd = some[::2].count(0), some[1::2].count(0)
    need = max(1, len(some) // 5)
    name = "utf-16-le" if odd >= need and even * 4 < odd else "utf-16-be" if even >= need and odd * 4 < even else None
    try:
        # Binary data have zero bytes, too, but then also control characters.
        return None if name is None or _CONTROL.search(raw.decode(name)) else name
    except UnicodeDecodeError:
        return None


@cache
def _weights(page: str) -> tuple[list[float | None], list[str]]:
    """For each byte its logarithm as a letter or sign (null: impossible in text), and its kind: a letter's case, sign, blank."""
    alphabet = CODE_PAGES[page]
    common = COMMON[alphabet]
    values, kinds = [], []
    for b in range(256):
        try:
            c = bytes([b]).decode(page)
        except UnicodeDecodeError:
            c = None
        if c is None or (not c.isprintable() and c not in "\t\n\r\f\v ­"):
            values.append(None)
            kinds.append("none")
        elif c.isalpha():
            values.append(math.log((common.get(c.lower(), 1) if c.lower() in alphabet else 0.01) / 1000) - 1.5 * c.isupper() if b > 127 else 0.0)
            kinds.append("upper" if c.isupper() else "lower")
        else:
            values.append((math.log(0.02) if c in SIGNS else math.log(0.0005)) if b > 127 else 0.0)
            kinds.append("blank" if c.isspace() else "sign")
    return values, kinds


#: Logarithms for a character beyond ASCII next to another, by kinds.
_BETWEEN = {("lower", "lower"): 0.0, ("upper", "upper"): 0.0, ("upper", "lower"): -0.5, ("lower", "upper"): -4.0, ("lower", "sign"): -1.0, ("sign", "lower"): -2.5, ("upper", "sign"): -2.0, ("sign", "upper"): -1.0}


def likelihood(raw: bytes, page: str) -> float | None:
    """Logarithm of how likely the bytes beyond ASCII, with the bytes next to them, are in this code page; null if one is
    impossible in text. What repeats counts once: a line that is there a thousand times says no more than one."""
    values, kinds = _weights(page)
    if any(values[b] is None for b in set(raw)):
        return None
    total = 0.0
    for before, b, behind in list(dict.fromkeys(_WITH_NEIGHBOURS.findall(b" " + raw + b" ")))[:EVIDENCE]:
        total += values[b] + _BETWEEN.get((kinds[before], kinds[b]), -0.5) + _BETWEEN.get((kinds[b], kinds[behind]), -0.5)
    return total


def code_page_of(raw: bytes, beside: Sequence[int] | None = None) -> str | None:
    """The likeliest of CODE_PAGES; null where none is possible. `beside`: how many files of the same origin seem to be in
    each of them."""
    prior = [math.log(n + 1) for n in beside] if beside is not None else [0.0] * len(CODE_PAGES)
    found = [(value + prior[i], -i, page) for i, page in enumerate(CODE_PAGES) if (value := likelihood(raw, page)) is not None]
    return max(found)[2] if found else None


def sure_encoding_of(raw: bytes) -> str | None:
    """The name of a Unicode encoding that the bytes show; null where they are in a code page or in none."""
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return name
    if name := _utf16(raw):
        return name
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return None


def encoding_of(raw: bytes, beside: Sequence[int] | None = None) -> str | None:
    """The name of the encoding, for bytes.decode; null where none fits. Empty input is UTF-8."""
    return sure_encoding_of(raw) or code_page_of(raw, beside)


def text_of(raw: bytes, beside: Sequence[int] | None = None) -> tuple[str, str | None]:
    """(text, encoding); the text is empty where no encoding fits."""
    name = encoding_of(raw, beside)
    try:
        return (raw.decode(name), name) if name else ("", None)
    except UnicodeDecodeError:
        return "", None
