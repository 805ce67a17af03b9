import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import jsonio, keys, text, vectors


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("name", "hits", "misses"),
    [
        ("page_number", ["Strana 1/2", "3 z 7", "- 4 -", "12", "page 9"], ["CRP 4", "1.2", "na straně 3"]),
        ("signature", ["MUDr. Novák", "Podpis: x", "Jan Novák, Ph.D."], ["předáno MUDr. Novákovi"]),
        ("visual_noise", ["www.x.cz", "Logo: a", "Oddělení kardiologie"], ["oddělení" + " x" * 20, "web www.x.cz"]),
        ("contact", ["tel.: 1", "a@b.cz", "150 06 Praha"], ["leukocytů 10 340 /µl", "volal tel: 1"]),
        ("audit", ["Vytištěno dne 1.1.", "© x"], ["vytištěno"]),
        ("glyph", ["###", "a#$%&"], ["ab", "abc#"]),
        ("rule", ["=====", "- - -"], ["--", "a---"]),
    ],
)
def test_classifiers(spark, name, hits, misses):
    got = values(spark, hits + misses, text.CLASSIFIERS[name])
    assert got == [True] * len(hits) + [False] * len(misses)


def test_text_functions(spark):
    assert values(spark, ["  a b\r\n\n c  d", None], text.lines_of) == [["a b", "c", "d"], []]
    assert values(spark, ["x \r\n\r\n\r\n\r\ny  z﻿ "], text.normalize_whitespace) == ["x\n\ny z"]
    assert values(spark, ['a"b\r\nc\rd'], text.csv_field) == ['"a""b\nc\nd"']
    assert values(spark, ["a|b\nc"], text.log_field) == ["a¦b c"]
    assert values(spark, ["<a & 'b'>"], text.xml_text) == ["&lt;a &amp; &apos;b&apos;&gt;"]
    assert values(spark, ["in/a.b.pdf", ".pdf", "x/y", ""], text.stem) == ["a.b", ".pdf", "y", "document"]
    assert values(spark, ["Agreguj", "one per file, rag", "fragment", "x", " "], text.prompt_mode) == ["CONSOLIDATE", "FAST", "SEARCH", None, None]
    assert values(spark, ["\n /THINK \nq ", "thinking hard", "q"], text.without_thinking_mark) == ["q", "thinking hard", "q"]
    assert values(spark, ["Ano.", "NE!", "možná, yes", "nevím", None], text.binary_answer) == [True, False, True, None, None]
    names = ["b10", "B2", "a", "b02x", "b2"]
    keyed = values(spark, names, text.natural_key)
    assert [n for _, n in sorted(zip(keyed, names))] == ["a", "B2", "b2", "b02x", "b10"]


def test_sections(spark):
    rows = ["x =====CSV===== a =====TXT===== b ", "=====TXT===== b =====CSV===== a", "=====CSV===== =====TXT===== b", "none"]
    assert values(spark, rows, lambda x: F.concat_ws("/", *text.sections(x))) == ["a/b", "", "", ""]


def test_keys(spark):
    want = hashlib.sha256(b"schema=v3\0s\0p\0cleaner=v2\0a\x01b\x01\0model=m\0embModel=e\0rerankerModel=r\0mode=fast\0").hexdigest()
    made = keys.inference_key(F.lit("s"), F.lit("p"), F.array(F.lit("b"), F.lit("a")), F.lit("m"), F.lit("e"), F.lit("r"), F.lit("fast"))
    assert spark.range(1).select(made).first()[0] == want
    assert spark.range(1).select(keys.document_key(F.lit("h"), F.lit("sig"))).first()[0] == hashlib.sha256(b"h\0sig").hexdigest()


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([float("nan"), 1.0], [1.0, 0.0]), ([], []), (None, [1.0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<double>, b array<double>")
    got = [tuple(r) for r in df.orderBy("i").select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine_or_minus_one(F.col("a"), F.col("b"))).collect()]
    assert got[0] == (1.0, 1.0) and abs(got[1][0] - 0.5**0.5) < 1e-12
    assert got[2:] == [(0.0, -1.0)] * 5


def balanced(s):
    return all(s.count(a) == s.count(b) for a, b in ["{}"])


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3)).filter(lambda x: isinstance(x, dict)), st.sampled_from(["", "Answer: ", "}} "]), st.sampled_from(["", " end {", " {}"]))
def test_object_in_finds_the_first_object(value, before, after):
    said = json.dumps(value)
    assert jsonio.object_in(before + said + after) == said


def test_strict_and_lenient():
    full = jsonio.empty_result("a.pdf") | {"confidence": 0.91}
    assert jsonio.strict("x " + json.dumps(full) + " y") == full
    for broken in ({k: v for k, v in full.items() if k != "discharge_status"}, full | {"confidence": True}, full | {"patient_name": None}, full | {"warnings": [1]}):
        assert jsonio.strict(json.dumps(broken)) is None
    assert jsonio.lenient('{"patient_id": "7", "confidence": "no"}')["patient_id"] == "7"
    assert jsonio.object_in("no object") == "no object" and jsonio.found({"a": [{"b": 3}]}, "b") == 3
