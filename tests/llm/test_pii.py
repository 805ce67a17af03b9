import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    def luhn(s):
        d = [int(c) for c in s][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else True, 10 <= len(digits) <= 15][kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.1 +-()507é_%", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4524132264652876", "4111 1111 1111 1111", "10.0.0.1", "300.1.1.1", "+1 (269) 555-3296", "a.b@c.de", "x_@y.z", " ", "\n", "@", ".", "word", "é", "7"]), max_size=12).map("".join))
def test_base_spans_in_runs_of_identifiers(text):
    assert pii.base_spans(text) == brute(text)


DISGUISES = [
    ("write to john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
    ("write to john [at] mail [dot] example [dot] org.", "email", "john [at] mail [dot] example [dot] org"),
    ("mail jane dot roe at example dot com today", "email", "jane dot roe at example dot com"),
    ("jаne@exаmple.com", "email", "jаne@exаmple.com"),
    ("x ｊｏｅ＠ｍａｉｌ．ｃｏｍ y", "email", "ｊｏｅ＠ｍａｉｌ．ｃｏｍ"),
    ("server １０.0.0.１ down", "ip", "１０.0.0.１"),
    ("at one nine two dot one six eight dot one dot five it is", "ip", "one nine two dot one six eight dot one dot five"),
    ("call plus one five five five two six nine three two nine six please", "phone", "plus one five five five two six nine three two nine six"),
    ("card four one one one 1111 1111 one one one one ends", "card", "four one one one 1111 1111 one one one one"),
    ("card 4111​1111​1111​1111 ends", "card", "4111​1111​1111​1111"),
]


@pytest.mark.parametrize(("text", "kind", "said"), DISGUISES)
def test_disguises_map_back_to_source_characters(text, kind, said):
    added = pii.added_spans(text, pii.base_spans(text))
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in added] == [(kind, said)]
    assert said not in pii.masked(text)


CLEAN = ["He was at home. The dot was small, at most one two three of them.", "Meet me at noon.Then go", "look at this dot on that", "un deux trois quatre cinq six sept", "3 @ 5.00 each", "Γειά σου κόσμε", "Привет, мир. 12 345", "one. two. three. four."]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_get_no_span(text):
    assert pii.base_spans(text) == [] and pii.added_spans(text, []) == [] and pii.masked(text) == text


GAPS = {n: f"one{' ' * n}2{' ' * n}3{' ' * n}4th" for n in (60, 120, 60_000)}
LONG = ["9", "a", "a.", "1.", "+1", "@", "one ", "a at ", "a dot ", "(at)", "é", "1-", "plus one ", " ", "one  ", "1 , ", " (", "one . ", "\n", "one,-", "+ ", "a  at  "]
BLANKS = ["а" + " " * 200_000, "one two" + " " * 200_000 + "x", "а (" + " " * 200_000 + "at", "one dot" + " ." * 100_000 + "x", "plus" + " " * 200_000, "а + " * 50_000, "john" + " " * 200_000 + "at x", *GAPS.values()]


@pytest.mark.parametrize("text", [u * (200_000 // len(u)) for u in LONG] + BLANKS, ids=[*LONG, *(f"blanks{i}" for i in range(len(BLANKS)))])
def test_long_runs_take_linear_time(text):
    import time

    began = time.process_time()
    pii._row(text)
    assert time.process_time() - began < 2


def test_blanks_around_a_bracket_belong_to_the_disguise():
    assert list(pii._bracketed("a  ( at )  (dot) b [.]")) == [(1, 11, "@"), (11, 17, "."), (18, 22, ".")]


def test_rows_and_odd_values(spark):
    texts = [None, "", "a@b.cd and a@b.cd", "😀 a@b.cd " + "x " * 50000, "a@b.cd and a@b.cd"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, "1.2.3.4", "s")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].spans == "email:0:6,email:11:17" and got[2].n_email == 2
    assert got[2].base_sha256 == hashlib.sha256(b"email:0:6,email:11:17").hexdigest()
    assert got[3].spans == "email:2:8" and got[None].n_ip == 1
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns
    assert {r.doc_id: r.text for r in redacted.collect()}[2] == "<EMAIL> and <EMAIL>"
    assert pii.find_pii(docs.limit(0)).collect() == []


UNTRACED = ["juan.perez arroba ejemplo.com", "jean.dupont arobase exemple.fr", "jane\nat example dot com", "john.doe @\nexample.com", "call\none\ntwo\nthree\nfour\nfive\nsix\nseven\neight\nnine\none", "jo.e AT\texample.IO", "jo.e ſ at example.uſ", "+1 punto1 punto2 puntofive 55 punto5 26 93296"]
PARTS = [*pii.AT_WORDS, "@", *pii.DOT_WORDS, ".", "one", "UN", "Zéro", "plus", "7", "4111", "jane", "x.y", "example", "com", "fr", "us", " ", "  ", "\n", "\t", " ", "(", "]", ",", "-", "+", "é", "ſ", "K", "İ"]


def ungated(text, base):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pii, "_traces", lambda text: True)
        return pii.added_spans(text, base)


@pytest.mark.parametrize("text", UNTRACED)
def test_the_gate_keeps_disguises_across_white_space(text):
    base = pii.base_spans(text)
    assert pii.added_spans(text, base) == ungated(text, base)


def test_an_address_with_another_at_word_is_masked():
    assert pii.masked("a juan.perez arroba ejemplo.com b") == "a <EMAIL> b" and pii.masked("john.doe @\nexample.com") == "<EMAIL>"


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=16), st.sampled_from(["", " ", "\n"]))
def test_the_gate_never_changes_spans(parts, glue):
    text = glue.join(parts)
    base = pii.base_spans(text)
    assert pii.added_spans(text, base) == ungated(text, base)
    if not pii._traces(text):
        assert pii.undo_spelled_digits(pii.undo_at_and_dot(pii.fold_lookalikes(pii.Mapped(text)))).text == text
