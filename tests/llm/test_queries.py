"""Every registered query opN over small whole tables, against brute force or its SQL."""

import hashlib
import math
import os
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from test_embeddings import brute as brute_links
from test_mixing import brute_targets
from test_pii import brute as brute_spans
from test_simhash import brute_components, brute_fingerprint
from test_tiff import brute as brute_media

from lexmill.llm import pii, queries, tiff, toxicity

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}
WORDS = {
    "en": ["the", "stone", "river", "light", "paper", "garden", "window", "summer"],
    "de": ["der", "stein", "fluß", "straße", "über", "schön", "fenster", "zwölf"],
    "fr": ["le", "été", "château", "où", "garçon", "fenêtre", "très", "lumière"],
}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    docs = []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        parts = [" ".join(rng.choice(WORDS[lang]) for _ in range(9)) for _ in range(rng.randint(4, 12))]
        if i % 4 == 0:
            parts.insert(2, "grumbach vileness you")
        text = ". ".join(parts)
        if i % 9 == 0:
            text += " mail jo@ex.com, 10.0.0.1 or +1 (269) 555-3296; x at mail dot com"
        docs.append((i, text, lang, f"s{i % 5}", len(text)))
    docs += [(300 + i, docs[i][1] + ("\n" if i % 2 else ""), docs[i][2], "s9", 1) for i in range(8)]
    docs += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, "123 ...", "en", "s1", 7), (403, "same again " * 300, "en", "s1", 1), (404, "  two  blanks\n\n lead", "en", "s2", 1)]
    gen = np.random.default_rng(2)
    vectors = list(gen.normal(size=(60, 8)))
    vectors += [v + gen.normal(size=8) * 0.05 for v in vectors[:20]]
    vectors += list(gen.normal(size=(40, 64)))
    page = "<p>é</p>" * 200
    return {
        "documents": docs,
        "labels": [(i, 1, int(i % 4 == 0)) for i in range(240)],
        "embeddings": [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)] + [(900, None, 1), (901, [0.0] * 8, 1)],
        "pages": [(i, f"http://x/{i}", page if i % 3 == 0 else "short" if i % 3 == 1 else f"{page}{i}") for i in range(30)] + [(99, "data:" + "x" * 100_000, None)],
        "conversations": [(c, t, ["system", "user", "assistant", "tool"][(c + t) % 4], [None, "[a] <b> \\c", "é\n"][(c * t) % 3]) for c in range(12) for t in range(1 + c % 6)],
    }


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


def texts(rows):
    return {i: t or "" for i, t, *_ in rows["documents"]}


def by_id(frame, key="doc_id"):
    out = {r[key]: r for r in frame.collect()}
    assert len(out) == frame.count()
    return out


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_op1(spark, rows, folder):
    got = by_id(queries.op1_pii(spark, folder))
    for i, t in texts(rows).items():
        base = brute_spans(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert got[i].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert got[i].n_added == int(" at mail dot com" in t) and set(pii.joined(base).split(",")) <= set(got[i].spans.split(",")) | {""}
    assert len(got) == len(rows["documents"])


def test_op2(spark, rows, folder):
    want = brute_links([(i, v, None) for i, v, _ in rows["embeddings"]])
    assert sorted(tuple(r) for r in queries.op2_embedding_near_dedup(spark, folder).collect()) == want
    assert sum(n for _, n, *_ in want) > 30


def test_op4(spark, rows, folder):
    got = by_id(queries.op4_toxicity(spark, folder))
    assert set(got) == set(texts(rows))
    for i, t in texts(rows).items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].predicted == int(got[i].score >= toxicity.THRESHOLD) == int("grumbach" in t)


def test_op5(spark, rows, folder):
    library = pytest.importorskip("sentencepiece")
    if not os.path.exists(queries.MODEL_PATH):
        pytest.skip("needs the public model file")
    model = library.SentencePieceProcessor(model_file=queries.MODEL_PATH)
    got = by_id(queries.op5_sentencepiece(spark, folder))
    assert set(got) == set(texts(rows))
    for i, t in texts(rows).items():
        assert got[i].ids == model.encode(t) and got[i].n_tokens == len(got[i].ids) and got[i].round_trip


def test_op6(spark, rows, folder):
    prints = {i: brute_fingerprint(t) for i, t in texts(rows).items()}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = by_id(queries.op6_simhash_near_dedup(spark, folder))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_op8(spark, rows, folder):
    got = by_id(queries.op8_language_id(spark, folder))
    langs = {i: lang for i, _, lang, *_ in rows["documents"]}
    for i, t in texts(rows).items():
        letters = any(c.isalpha() for c in t)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1
        assert got[i].lang_pred == (langs[i] if letters and i not in (403, 404) else got[i].lang_pred if letters else "und")


def test_op10(spark, rows, folder):
    frame = queries.op10_mixing(spark, folder)
    got, sizes, taken = by_id(frame), {}, {}
    own = {i: (s, len((t or "").split())) for i, t, _, s, _ in rows["documents"]}
    for s, n in own.values():
        sizes[s] = sizes.get(s, 0) + n
    want = brute_targets(sizes)
    for i, (s, n) in own.items():
        assert (got[i]["size"], got[i].source_size) == (n, sizes[s]) and math.isclose(got[i].target, want[s], rel_tol=1e-9) and got[i].taken <= 3 * n
        taken[s] = taken.get(s, 0) + got[i].taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(repr, frame.collect())) == sorted(map(repr, queries.op10_mixing(spark, folder).collect()))
    places = [r.position for r in frame.collect() if r.position is not None]
    assert places == sorted(places)


def test_op13(spark, rows, folder):
    got = by_id(queries.op13_tiff(spark, folder))
    assert set(got) == set(texts(rows))
    for i, t in texts(rows).items():
        r, file = got[i], tiff.store(t.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == brute_media(t)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    plain = lambda frame: sorted(repr([None if pd.isna(v) else float(v) if not isinstance(v, str | bool | np.bool_) else str(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))
    got, want = queries.queries()[name](spark, folder).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert plain(got) == plain(want) and len(got) > 10
