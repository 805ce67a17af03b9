"""Line and text functions as Column -> Column, all inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.rows import bound

#: Blanks as the analysed texts know them: Unicode separators and line ends, not only U+0020.
BLANK = r"[\s\p{Z}\x{85}]"
TRIM = rf"^{BLANK}+|{BLANK}+$"
#: The same characters one by one, by their Unicode category.
BLANK_CHARS = "".join(c for c in map(chr, range(0x10000)) if c in "\t\n\x0b\f\r\x85" or unicodedata.category(c) in ("Zs", "Zl", "Zp"))
LINE_END = r"[\n\x0B\f\r\x85\x{2028}\x{2029}]"

# The boilerplate classifiers, valid for Java and RE2.
PAGE_NUMBER = r"^strana[\s\p{Z}]+\p{Nd}+|^stránka[\s\p{Z}]+\p{Nd}+|^str\.[\s\p{Z}]*\p{Nd}+|^page[\s\p{Z}]+\p{Nd}+|^\p{Nd}+[\s\p{Z}]*/[\s\p{Z}]*\p{Nd}+$|^\p{Nd}+[\s\p{Z}]+(z|of)[\s\p{Z}]+\p{Nd}+$|^-[\s\p{Z}]*\p{Nd}+[\s\p{Z}]*-$|^\p{Nd}+$"
SIGNATURE = r"^(mudr[. ]|prim[. ]|primář|doc[. ]|prof[. ]|podpis[: ]|razítko[: ]|vypracoval|provedl|zapsal|ověřil|overil|kontroloval|podepsán|vedoucí lékař|vedouci lekar|ošetřující lékař|osetrujici lekar|atestovaný lékař)"
CREDENTIAL = r"ph\.d\.|ph\. d\.|csc\.|dr\.sc\."
VISUAL_NOISE = r"^(logo[ :]|www\.|https?://|fakultní nemocnice|fakultni nemocnice|nemocnice |hospital )"
DEPARTMENT = r"^(oddělení|klinika|ambulance)[ :]"
CONTACT = r"^(tel\.?:|telefon:|fax\.?:|e-mail:|email:|mail:|ičo[: ]|ičz[: ]|ičp[: ]|dič[: ])"
EMAIL_ONLY = r"^[\s\p{Z}]*[^\s\p{Z}]+@[^\s\p{Z}]+\.[^\s\p{Z}]+[\s\p{Z}]*$"
POSTCODE = r"^[\s\p{Z}]*\p{Nd}{3}[\s\p{Z}]?\p{Nd}{2}[\s\p{Z}]+[^\s\p{Z}]"
AUDIT = r"vytištěno dne|vytisteno dne|vystaveno dne|datum tisku|datum vyhotovení|datum vyhotoveni|č\. ?j\.:|c\.j\.:|cj:|spisová značka|spisova znacka|formulář č\.|formular c\.|verze dokumentu|verze formuláře|copyright|©|všechna práva vyhrazena"
RULE = r"^[=\-_*─━·•° ]{3,}$"
NOT_ALNUM = r"[^\p{L}\p{M}\p{Nd}]"

# Keywords that tell a prompt's mode, by priority.
MODE_KEYWORDS = {
    "CONSOLIDATE": (
        "celý vstup jako jeden", "jako jeden společný", "jako jeden datový", "celý batch", "celý vstup", "napříč soubory", "napříč dokumenty",
        "všech dokumentů dohromady", "nevytvářej odpověď po jednotlivých", "nevytvářej odpověď po souborech", "jediný json array", "jediný json",
        "jediné json pole", "jedno pole objektů", "konsoliduj", "konsolidova", "agreguj", "deduplikuj", "deduplikaci", "slouč údaje",
        "slouč do jednoho", "across all documents", "single json array", "one json array", "aggregate", "consolidate", "deduplicate",
    ),
    "FAST": ("pro každý soubor", "pro každý dokument", "pro každou zprávu", "každý soubor samostatně", "každý dokument zvlášť", "per file", "per document", "one response per document"),
    "SEARCH": ("semantic", "semanticky", "vyhledej relevantní", "najdi relevantní pasáže", "retrieval", "rag"),
}
# First lines that switch a model's thinking on or off, and the marks of the two-section format.
THINKING_MARKS = ("/no_think", "/think", "nothinking", "thinking", "no thinking", "no-thinking")
CSV_MARK, TXT_MARK = "=====CSV=====", "=====TXT====="
PAGE_BREAK = "[[PAGE_BREAK]]"
#: What stands between the pages of an extracted text.
BETWEEN_PAGES = f"\n\n{PAGE_BREAK}\n\n"
# Phrases of a context overflow, names and endings of the engine's own outputs, file types.
OVERFLOW_PHRASES = ("context length", "context window", "number of tokens to keep", "provide a shorter input", "prompt is too long", "exceeded the context")
OWN_OUTPUT = r"\.lm\.txt$|^(log--|vystup--|souhrn--)|^\.[^/]*-checkpoint\.json$"
PLAIN_TEXT_TYPES = (
    "c", "cfg", "conf", "cpp", "cs", "css", "csv", "env", "fnc", "html", "htm", "ini", "java", "js", "json", "md", "pck", "pkb", "pks", "pls",
    "prc", "properties", "psql", "py", "sql", "swift", "toml", "trg", "ts", "txt", "vw", "xml", "yaml", "yml",
)
OTHER_TYPES = ("doc", "docx", "odt", "pdf", "ppt", "pptx", "rtf", "xls", "xlsx")
CODE_TYPES = tuple(x for x in PLAIN_TEXT_TYPES if x not in ("csv", "md", "txt"))
WORD_TYPES = ("docx", "doc", "odt", "rtf")


def trim_blanks(x: Column) -> Column:
    return F.trim(x, F.lit(BLANK_CHARS))


def lines_of(text: Column) -> Column:
    """Trimmed lines of a text, without empty ones; none for null."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), trim_blanks)
    return F.filter(parts, lambda x: x != "")


def is_page_number(line: Column) -> Column:
    return F.lower(line).rlike(PAGE_NUMBER)


def is_signature(line: Column) -> Column:
    low = F.lower(line)
    return low.rlike(SIGNATURE) | ((F.length(line) < 80) & low.rlike(CREDENTIAL))


def is_visual_noise(line: Column) -> Column:
    low = F.lower(line)
    return low.rlike(VISUAL_NOISE) | ((F.length(line) < 32) & low.rlike(DEPARTMENT))


def is_contact(line: Column) -> Column:
    return F.lower(line).rlike(CONTACT) | ((F.length(line) < 60) & line.rlike(EMAIL_ONLY)) | line.rlike(POSTCODE)


#: The same as plain phrases, which are found faster than a pattern of so many branches: escapes and optional blanks gone.
AUDIT_PHRASES = tuple(way.replace("\\", "") for x in AUDIT.split("|") for way in ({x.replace(" ?", ""), x.replace(" ?", " ")}))


def _holds_audit(low: Column) -> Column:
    return reduce(Column.__or__, [low.contains(x) for x in AUDIT_PHRASES])


def is_audit_trail(line: Column) -> Column:
    return bound(F.lower(line), _holds_audit)


def is_glyph_noise(line: Column) -> Column:
    return (F.length(line) >= 3) & (F.length(line) - F.regexp_count(line, F.lit(NOT_ALNUM)) < 0.25 * F.length(line))


def is_rule(line: Column) -> Column:
    return line.rlike(RULE)


CLASSIFIERS = {
    "page_number": is_page_number,
    "signature": is_signature,
    "visual_noise": is_visual_noise,
    "contact": is_contact,
    "audit": is_audit_trail,
    "glyph": is_glyph_noise,
    "rule": is_rule,
}


# One pattern for each kind of condition: a line's lower-case form is matched against all anchored patterns at once, with
# one anchor before them, so that all other places of a line fail at once.
_anchored = lambda *patterns: f"^(?:{'|'.join(p.removeprefix('^').replace('|^', '|') for p in patterns)})"
_ANCHORED = _anchored(PAGE_NUMBER, SIGNATURE, VISUAL_NOISE, CONTACT)
_AS_IT_IS = _anchored(POSTCODE, RULE)


def is_boilerplate(line: Column) -> Column:
    """Whether any of CLASSIFIERS takes a line, with the line's lower-case form made once."""

    def any_of(low: Column) -> Column:
        size = F.length(line)
        hit = low.rlike(_ANCHORED) | line.rlike(_AS_IT_IS) | _holds_audit(low) | is_glyph_noise(line)
        return hit | ((size < 80) & low.rlike(CREDENTIAL)) | ((size < 60) & line.rlike(EMAIL_ONLY)) | ((size < 32) & low.rlike(DEPARTMENT))

    return bound(F.lower(line), any_of)


def normalize_whitespace(x: Column) -> Column:
    for pattern, new in (("\r\n", "\n"), ("[ \t]+\n", "\n"), ("\n{3,}", "\n\n"), ("[ \t]{2,}", " "), ("\\x{FEFF}", "")):
        x = F.regexp_replace(x, pattern, new)
    return trim_blanks(x)


def csv_field(x: Column) -> Column:
    flat = F.regexp_replace(x, "\r\n|\r", "\n")
    return F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))


def xml_text(x: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(plain), F.lit(entity))
    return x


def log_field(x: Column) -> Column:
    return F.translate(x, "|\r\n", "¦  ")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    base = F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")
    return F.when(base == "", F.lit("document")).otherwise(base)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def prompt_mode(prompt: Column) -> Column:
    """Mode of the first list that has a keyword in the prompt; null for blank prompts and without a hit."""

    def first(low: Column) -> Column:
        out = None
        for mode, words in MODE_KEYWORDS.items():
            hit = F.lit(False)
            for w in words:
                hit = hit | low.contains(w)
            out = F.when(hit, F.lit(mode)) if out is None else out.when(hit, F.lit(mode))
        return out

    return bound(F.lower(trim_blanks(prompt)), first)


def without_thinking_mark(prompt: Column) -> Column:
    """Leading blank lines and one line that is a thinking mark go; the rest is trimmed."""
    marks = "|".join(THINKING_MARKS)
    return trim_blanks(F.regexp_replace(prompt, rf"(?i)\A(?:{BLANK}*{LINE_END})?[ \t]*(?:{marks})[ \t]*(?:{LINE_END}|\z)", ""))


def with_thinking(prompt: Column, think: bool) -> Column:
    return F.concat(F.lit("/think\n" if think else "/no_think\n"), without_thinking_mark(prompt))


def sections(text: Column) -> tuple[Column, Column]:
    """The CSV and the TXT section, both null unless both are there in that order and not blank."""
    size = len(CSV_MARK)

    def cut(at: Column, to: Column) -> Column:
        csv = trim_blanks(F.substring(text, at + size, to - at - size))
        txt = trim_blanks(F.substring(text, to + size, F.length(text)))
        both = bound(F.array(csv, txt), lambda x: F.when((x[0] != "") & (x[1] != ""), x))
        return F.when((at > 0) & (to >= at + size), both)

    pair = bound(F.array(F.locate(CSV_MARK, text), F.locate(TXT_MARK, text)), lambda x: cut(x[0], x[1]))
    return F.get(pair, F.lit(0)), F.get(pair, F.lit(1))


def has_usable_text(text: Column) -> Column:
    """Whether a text layer is worth reading: 50 characters or more, and of the first 500 two fifths letters or digits
    and at most a tenth replacement characters."""

    def good(head: Column) -> Column:
        size = F.length(head)
        alnum = F.length(F.regexp_replace(head, NOT_ALNUM, ""))
        odd = size - F.length(F.replace(head, F.lit("�"), F.lit("")))
        return (size >= 50) & (10 * alnum >= 4 * size) & (odd <= F.floor(size / 10))

    return bound(F.substring(trim_blanks(F.coalesce(text, F.lit(""))), 1, 500), good)


def is_context_overflow(text: Column) -> Column:
    return F.lower(text).rlike("|".join(OVERFLOW_PHRASES))


def is_cacheable(responses: Column) -> Column:
    one = F.get(responses, F.lit(0))
    return (F.size(responses) == 1) & (one != "") & ~one.startswith("[Chyba") & ~one.startswith("[Žádná")


def windows_of(text: Column, size: int) -> Column:
    """The text cut every `size` characters, the rest last; one empty window for an empty text. One pass over the text,
    where a substring for each window would begin at its start each time."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(cut)


def _repeats(items: Column, least: int) -> Column:
    """Whether an element stands in an array `least` times or more: equal ones are neighbours once sorted."""
    return bound(F.array_sort(items), lambda s: F.exists(F.transform(s, lambda x, i: F.coalesce(F.get(s, i + (least - 1)) == x, F.lit(False))), lambda hit: hit))


def output_warnings(text: Column, input_chars: Column) -> Column:
    """Codes of what is wrong with an output: empty, only_errors, short, long, repeated."""

    def of(bare: Column) -> Column:
        size = F.length(bare)
        rows = F.filter(F.split(bare, "\n"), lambda x: F.trim(x) != "")
        errors = bound(rows, lambda r: (F.size(r) > 0) & F.forall(r, lambda x: F.trim(x).startswith("[Chyba")))
        found = F.array(
            F.when(bare.startswith("[Chyba") & errors, F.lit("only_errors")),
            F.when((input_chars > 200) & (size < F.floor(input_chars / 20)), F.lit("short")),
            F.when((input_chars > 200) & (size > 2 * input_chars), F.lit("long")),
            F.when((size > 500) & _repeats(windows_of(bare, 100), 3), F.lit("repeated")),
        )
        return F.when(bare == "", F.array(F.lit("empty"))).otherwise(F.array_compact(found))

    return bound(trim_blanks(F.coalesce(text, F.lit(""))), of)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, for which Spark has no function."""
    return text.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def dominant_language(detect, first: int = 1000):  # noqa: ANN001, ANN201
    """Column -> Column: what a detector str -> str | None makes of a text's first characters, else "unknown"."""

    @F.pandas_udf(T.StringType())
    def of(text: pd.Series) -> pd.Series:
        return text.map(lambda t: (detect(t[:first]) if t else None) or "unknown")

    return of


def snippet(text: Column, most: int = 240) -> Column:
    """The text, or its beginning and a mark that more follows."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def natural_key(name: Column) -> Column:
    """A key that sorts digit runs as numbers and ignores case."""
    spaced = F.regexp_replace(F.lower(name), r"(\p{Nd}+)", "\u0001$1\u0001")
    parts = F.split(spaced, "\u0001")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\p{Nd}+$"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p)), "")


def binary_answer(text: Column) -> Column:
    """true, false or null by the first yes or no word."""
    words = F.split(F.upper(text), r"[\s\p{Z}\p{P}]+")
    known = F.filter(words, lambda w: w.isin("ANO", "YES", "TRUE", "NE", "NO", "FALSE"))
    return F.get(known, F.lit(0)).isin("ANO", "YES", "TRUE")


def profile_of_extension(ext: Column) -> Column:
    low = F.lower(ext)
    return F.when(low.isin(*CODE_TYPES), F.lit("code")).when(low == "csv", F.lit("tabular")).when(low.isin(*WORD_TYPES), F.lit("word")).otherwise(F.lit("medical"))
