"""Personal data in whole texts: offset-preserving deobfuscation.

`base_spans` finds plain e-mail addresses, IPv4 addresses, card and phone numbers. `added_spans` finds disguised ones:
transducers rewrite homoglyphs, at/dot disguises and spelled digits one after another, each keeping for every
character of its output the source range it stands for. The same detectors then run on the normalised text, and the
ranges map what they find back to code points of the source. Base spans always stay; an added span that touches a
base span is dropped. Texts without any trace of a disguise skip the transducers.

A spoken address has at most five names before the "at" and six behind it, of at most 64 and 63 characters, and ends in
one of `SPOKEN_ENDS`: a sentence holds many words around "at" and "dot" that are no address.

Null and empty texts have no spans. Spans at one place sort by kind, as KINDS lists them. Equal rows have equal results
each, a null doc_id is kept, an empty table gives an empty one, and columns other than doc_id and text are not read (by
redact: pass through, whatever their names). All scans take time linear in the text, also on long runs of digits,
letters or blanks.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters that look like ASCII letters, with what they look like.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ѐ": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ԁ": "d", "ӏ": "l",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "℮": "e", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".",
}
# Characters without width.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Words for the digits 0 to 9 in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Last labels that a spoken address may end in.
SPOKEN_ENDS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "eu", "de", "fr", "es", "uk", "us", "ca", "au", "ch", "at", "be", "nl", "it", "pl", "cz", "se", "dev", "app", "example", "test")
AT_WORDS = ("at", "arroba", "arobase")
DOT_WORDS = ("dot", "punkt", "point", "punto")


def _folded() -> dict[str, str]:
    """LOOKALIKES, and by rule what compatibility folding makes one ASCII character: full-width forms, mathematical
    letters, small forms, and the decimal digits of every script."""
    out = dict(LOOKALIKES)
    for lo, hi in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0xFE50, 0xFE70), (0x0660, 0x1020), (0x1040, 0x1AA0), (0xA620, 0xABFA)):
        for code in range(lo, hi):
            c = chr(code)
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii() and plain != c:
                out.setdefault(c, plain)
            elif unicodedata.category(c) == "Nd":
                out.setdefault(c, str(unicodedata.decimal(c)))
    return out | dict.fromkeys(INVISIBLE, "")


FOLDED = _folded()
_any = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
_FOLD = re.compile("[" + "".join(map(re.escape, FOLDED)) + "]")
_AT, _DOT, _DIGIT = _any(AT_WORDS), _any(DOT_WORDS), _any(DIGIT_WORDS)
#: A mark in brackets. Blanks around it are measured by hand: in front of a bracket a pattern would try each of them anew.
_BRACKETED = re.compile(rf"[(\[{{<]\s*+(?:(?P<at>{_AT}|@)|{_DOT}|\.)\s*+[)\]}}>]", re.IGNORECASE)
_BLANKS = re.compile(r"\s*+")
_ATOM = r"[A-Za-z0-9_%+-]{1,64}"
#: name at host dot tld, with real or spelled dots inside the name; a spelled dot is needed behind the "at".
_AT_HOST = rf"\s(?:{_AT}|@)\s+(?:[A-Za-z0-9-]{{1,63}}(?:\.|\s+(?:{_DOT}|\.)\s+)){{1,5}}(?:{_any(SPOKEN_ENDS)})(?![A-Za-z0-9-])"
_SPOKEN = re.compile(rf"(?<![A-Za-z0-9_%+-])(?:{_ATOM}(?:\.|\s+(?:{_DOT})\s+)){{0,4}}{_ATOM}\s*{_AT_HOST}", re.IGNORECASE)
_SPOKEN_PART = re.compile(rf"\s+(?:(?P<at>{_AT}|@)|{_DOT}|\.)\s+", re.IGNORECASE)
#: No number and no dot word begins with a character of a gap, so gaps are possessive and are read once.
_GAP = rf"[\s,.-]++(?:(?:{_DOT})[\s,.-]*+)?"
_RUN = re.compile(rf"(?<![^\W_])(?:plus\s++|\+\s*+)?(?:(?:{_DIGIT}|[0-9]+){_GAP}){{3,}}(?:{_DIGIT}|[0-9]+)(?![^\W_])", re.IGNORECASE)
_RUN_TOKEN = re.compile(rf"(?P<plus>plus\s+|\+\s*)|(?P<word>{_DIGIT})|(?P<digits>[0-9]+)|(?P<dot>[\s,.-]*+\b(?:{_DOT})\b[\s,.-]*+|(?<=\S)\.(?=\S))|(?P<gap>[\s,.-]++)", re.IGNORECASE)
#: A spelled number and what follows it in its run, or a dot word that touches a number (and may hold one, as "punto").
_RUN_TRACE = re.compile(rf"(?:{_DIGIT}){_GAP}(?:{_DIGIT}|[0-9])|[\s,.-](?:{_DOT})(?:{_DIGIT}|[0-9])")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, int]]:
    """Leftmost matches, one '@' after another: the name is the run of its characters before the '@'."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, EMAIL, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; leftmost and not overlapping within each kind."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            out.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), PHONE, m.end()))
    return sorted(out)


class Mapped:
    """A text, and for each of its characters the range of the source that it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewritten(self, edits) -> Mapped:
        """edits: (start, end, replacement), ascending. A replacement stands for all that it replaces."""
        parts, starts, ends, at = [], [], [], 0
        for lo, hi, new in edits:
            parts += [self.text[at:lo], new]
            starts += self.starts[at:lo] + [self.starts[lo]] * len(new)
            ends += self.ends[at:lo] + [self.ends[hi - 1]] * len(new)
            at = hi
        if not parts:
            return self
        self.text = "".join(parts) + self.text[at:]
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]
        return self


def fold_lookalikes(m: Mapped) -> Mapped:
    return m.rewritten((x.start(), x.end(), FOLDED[x[0]]) for x in _FOLD.finditer(m.text))


def _bracketed(text: str) -> Iterator[tuple[int, int, str]]:
    done = 0
    for x in _BRACKETED.finditer(text):
        lo = x.start()
        while lo > done and text[lo - 1].isspace():
            lo -= 1
        done = _BLANKS.match(text, x.end()).end()
        yield lo, done, "@" if x["at"] else "."


def undo_at_and_dot(m: Mapped) -> Mapped:
    m = m.rewritten(_bracketed(m.text))
    edits = []
    for spoken in _SPOKEN.finditer(m.text):
        inner = [(spoken.start() + x.start(), spoken.start() + x.end(), "@" if x["at"] else ".") for x in _SPOKEN_PART.finditer(spoken[0])]
        behind = [new for _, _, new in inner[[new for _, _, new in inner].index("@") + 1 :]]
        if "." in behind or re.match(r"[A-Za-z0-9_%+-]*[.0-9_][A-Za-z0-9_%+.-]*\s", spoken[0]):
            edits += inner
    return m.rewritten(edits)


def undo_spelled_digits(m: Mapped) -> Mapped:
    edits = []
    for run in _RUN.finditer(m.text):
        tokens = [(x.lastgroup, run.start() + x.start(), run.start() + x.end(), x[0]) for x in _RUN_TOKEN.finditer(run[0])]
        if sum(kind == "word" for kind, *_ in tokens) < 3:
            continue
        for kind, lo, hi, said in tokens:
            if kind != "digits":
                edits.append((lo, hi, {"plus": "+", "dot": ".", "gap": ""}.get(kind, DIGIT_WORDS.get(said.lower(), ""))))
    return m.rewritten(edits)


# Traces are read in the lower-case text. Each is a part that every match of its transducer has, so that a text without
# traces is one that no transducer changes.
_BRACKET_TRACE = re.compile(rf"[(\[{{<]\s*(?:{_AT}|@|{_DOT}|\.)\s*[)\]}}>]")
_AT_TRACE = re.compile(_AT_HOST)
#: Characters that match a letter without regard to case, but are not its upper case.
_ODD_CASE = frozenset("\u017f\u0130\u212a")


def _traces(text: str) -> bool:
    """Whether a text may hold a disguise; cheap tests that a clean text mostly fails at once."""
    if not text.isascii() and not (FOLDED.keys().isdisjoint(text) and _ODD_CASE.isdisjoint(text)):
        return True
    low = text.lower()
    return bool(_BRACKET_TRACE.search(low) or _RUN_TRACE.search(low) or _AT_TRACE.search(low))


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not _traces(text):
        return []
    m = undo_spelled_digits(undo_at_and_dot(fold_lookalikes(Mapped(text))))
    if m.text == text:
        return []
    out = []
    for start, kind, end in base_spans(m.text):
        if kind == EMAIL and not re.fullmatch(r"[^@]*[A-Za-z][^@]*@.*\.[A-Za-z]{2,24}", m.text[start:end]):
            continue
        lo, hi = m.starts[start], m.ends[end - 1]
        if all(hi <= a or b <= lo for a, _, b in base):
            out.append((lo, kind, hi))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _row(text: str | None) -> tuple:
    text = text or ""
    base = base_spans(text)
    added = added_spans(text, base)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
    return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(added))


_OUT = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def find_pii(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, base counts by kind, the digest of the base spans, all spans, and n_added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            rows = [_row(x.as_py()) for x in batch.column(1)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_OUT])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str | None) -> str | None:
    """text with every span replaced by its kind in angle brackets; spans that overlap become one."""
    if not text:
        return text
    base = base_spans(text)
    parts, at, open_to = [], 0, -1
    for lo, kind, hi in sorted(base + added_spans(text, base)):
        if lo >= open_to:
            parts += [text[at:lo], f"<{KINDS[kind].upper()}>"]
            open_to = hi
        at = open_to = max(open_to, hi)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with masked texts; n_chars, where there is one, follows the text. Other columns are left as they are."""

    @F.pandas_udf("string")
    def mask(texts):  # noqa: ANN001, ANN202
        return texts.map(masked)

    out = docs.withColumn("text", mask("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
