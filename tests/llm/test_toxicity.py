import math
import random
import zlib

from lexmill.llm import toxicity


def made(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        said = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(6)) for _ in range(rng.randint(1, 40))]
        if i % 4 == 0:
            said[rng.randrange(len(said))] += " " + rng.choice(["grumbach", "vileness"])
        texts.append(". ".join(said))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_learns_words_from_document_labels_and_locates_sentences():
    model = toxicity.fit(*made(400, 1))
    texts, labels = made(200, 2)
    scores = [model.score(t) for t in texts]
    assert [int(s >= toxicity.THRESHOLD) for s, _ in scores] == labels
    for t, y, (_, places) in zip(texts, labels, scores):
        assert all("grumbach" in t[a:b] or "vileness" in t[a:b] for a, b, _ in places) and bool(places) == bool(y)


def test_score_is_the_noisy_or_of_all_sentences():
    model = toxicity.Model({"bad": 8.0, "badl*": 1.0, "worse": 3.0}, -5.0)
    text = "One bad thing. Nothing? A worse, BAD day! Badlands are " + "long " * 9 + "\n\nEnd"
    z = [-5 + 8, -5, -5 + 11, -5 + 1, -5]
    want = 1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in z)
    assert abs(model.score(text)[0] - want) < 1e-9
    assert [text[a:b].strip() for a, b, _ in model.score(text)[1]] == ["One bad thing", "A worse, BAD day"]
    assert model.score(None) == (0.0, []) and model.score("") == (0.0, []) and model.score(". . .")[0] < 0.05
    odd = "İİİ calm. Bad day"
    assert [odd[a:b] for a, b, _ in model.score(odd)[1]] == [" Bad day"]


def test_held_out_labels_are_never_read(spark):
    texts, labels = made(300, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (5, "", "x")], "doc_id long, text string, score string")
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2}
    table = lambda flip: spark.createDataFrame([(i, 1 - y if flip and i in held else y) for i, y in enumerate(labels)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    one, two = (toxicity.train(docs, table(flip)) for flip in (False, True))
    assert one.weights == two.weights
    got = toxicity.score_documents(docs, one).collect()
    assert {r.doc_id for r in got if r.held_out} == held and len(got) == 302
    assert all(r.predicted == labels[r.doc_id] for r in got if r.doc_id not in (None, 5))


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text. more")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score_documents(docs, toxicity.train(docs, none)).collect()] == [0]
    assert toxicity.score_documents(docs.limit(0), toxicity.train(docs.limit(0), none)).collect() == []


def test_a_clean_document_is_not_toxic_by_its_length(spark):
    model = toxicity.fit(*made(400, 1))
    rng = random.Random(5)
    mixed = ". ".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(6)) for _ in range(20_000))
    plain = "nothing known here. " * 20_000
    docs = spark.createDataFrame(list(enumerate([mixed, plain, mixed + " grumbach", plain + "grumbach", "alpha"])), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert [got[i].predicted for i in range(5)] == [0, 0, 1, 1, 0]
    assert [len(got[i].offending) for i in range(5)] == [0, 0, 1, 1, 0]
    assert math.isclose(model.score("nothing known here. " * 50)[0], got[1].score)


def test_the_sample_is_the_same_in_every_run(spark, monkeypatch):
    texts, labels = made(300, 9)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2 + [(1, "x" * 200_000)], "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 40)
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 60)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append((texts, toxic)))
    toxicity.train(docs, table)
    toxicity.train(docs.repartition(5), table.repartition(3))
    assert seen[0] == seen[1] and sum(seen[0][1]) == 40 and len(seen[0][1]) == 100 and max(map(len, seen[0][0])) < 100_000
