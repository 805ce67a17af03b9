"""Modes, caches and the older orchestration: what is asked, how often, and what becomes of it."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lexmill import config
from lexmill.operators import cache, cleaning, metrics, models, modes, orchestration, packing
from lexmill.sources import readers, sinks
from lexmill.streaming import incremental


@pytest.fixture
def calls(tmp_path):
    """(a way to count from executors, the calls so far)."""
    folder = tmp_path / "calls"
    folder.mkdir()
    path = str(folder)

    def count(what: str) -> None:
        with open(f"{path}/{os.urandom(8).hex()}", "w", encoding="utf-8") as f:
            f.write(what)

    return count, lambda: sorted(p.read_text(encoding="utf-8") for p in folder.iterdir())


def counting(count, said):
    def make():
        def chat(system, user):
            count(user)
            return said(user)

        return chat

    return make


def test_each_miss_is_computed_once(spark, tmp_path, calls):
    count, seen = calls

    def compute(rows):
        @F.pandas_udf("string")
        def answer(keys):
            for k in keys:
                count(k)
            return keys.str.upper()

        return rows.withColumn("response", answer("key"))

    asked = spark.createDataFrame([(k,) for k in "abcdeab"], "key string")
    empty = spark.createDataFrame([], "key string, response string, created_at timestamp")
    answers, fresh = cache.fill(asked, empty, compute)
    assert sorted(r.response for r in answers.collect()) == list("AABBCDE") and fresh.count() == 5
    assert seen() == list("abcde")
    store = cache.Store(spark, f"file://{tmp_path}/store", "key string, response string, created_at timestamp")
    assert store.count() == 0
    store.put(fresh)
    assert store.count() == 5
    again, _ = cache.fill(asked, store.read(), compute)
    assert again.count() == 7 and len(seen()) == 5
    (tmp_path / "store" / "broken.parquet").write_bytes(b"no parquet")
    assert store.count() == 5
    cache.clear_all(store)
    assert store.count() == 0


def folder(spark, n=6, chars=900, key=lambda i: f"k{i}"):
    return spark.createDataFrame([("run", key(i), f"in/{i}.pdf", chr(97 + i) * chars) for i in range(n)], "run string, id string, path string, text string")


def test_consolidation_asks_once_for_each_request(spark, tmp_path, calls):
    count, seen = calls
    store = cache.Store(spark, f"file://{tmp_path}/store")
    make = counting(count, lambda user: "merged" if "Dílčí výstupy" in user else "part")
    go = lambda **o: modes.consolidated(folder(spark), "run", "id", "path", "text", "prompt", make, context=1024, model="m", store=store, **o).collect()
    (row,) = go()
    asked = seen()
    maps = [u for u in asked if u.startswith("[Toto je dávka #")]
    assert len(asked) == len(maps) + 1 and len(maps) == 6
    assert all("=== Dokument #1: " in u and "Vstupní dokumenty v této dávce (1):" in u for u in maps)
    (last,) = [u for u in asked if u.startswith("[Dříve jsi zpracoval stejnou úlohu v 6 dávkách.")]
    assert "Původní zadání:\nprompt\n\nDílčí výstupy:\n=== Výstup dávky #1/6 ===\npart\n\n=== Výstup dávky #2/6" in last
    assert row.raw_response == "merged" and row.source_file == "Consolidated (6 dokumentů)" and row.warnings == [modes.REDUCED % 6]
    assert go()[0].raw_response == "merged" and len(seen()) == len(asked)
    go(bypass=True)
    assert len(seen()) == 2 * len(asked)


def test_a_run_that_fits_is_one_request_numbered_from_one(spark, tmp_path, calls):
    count, seen = calls
    store = cache.Store(spark, f"file://{tmp_path}/store")
    docs = folder(spark, 3, 5, lambda i: f"doc {7 - i}")
    make = counting(count, lambda user: "all")
    (row,) = modes.consolidated(docs, "run", "id", "path", "text", "prompt", make, store=store).collect()
    assert seen() == ["prompt\n\nVstupní dokumenty (3):\n=== Dokument #1: 2.pdf ===\nccccc\n\n=== Dokument #2: 1.pdf ===\nbbbbb\n\n=== Dokument #3: 0.pdf ===\naaaaa"]
    assert row.raw_response == "all" and row.warnings == []
    # What the store has over a run comes before its size is looked at.
    modes.consolidated(docs, "run", "id", "path", "text", "prompt", make, context=1, store=store).collect()
    assert len(seen()) == 1


def test_failures_of_map_and_reduce(spark):
    def make():
        def chat(system, user):
            if "aaa" in user or "Dílčí" in user:
                raise RuntimeError("down")
            return "part"

        return chat

    (row,) = modes.consolidated(folder(spark, 2, 2000), "run", "id", "path", "text", "p", make, context=1024).collect()
    assert row.raw_response == "=== Dávka #1/2 ===\n[CHYBA dávky 1: down]\n\n=== Dávka #2/2 ===\npart" and row.warnings == [modes.REDUCE_FAILED % "down"]


def test_sizes_of_requests_from_lengths(spark):
    for n in (1, 9, 10, 101):
        docs = folder(spark, n, 3, lambda i: f"{i:03}") if n < 20 else spark.range(n).selectExpr("'run' run", "lpad(id, 3, '0') id", "'x' path", "'t' text")
        user = modes.single_requests(docs, "run", "id", "path", "text", "prompt").first().user
        tokens = modes.run_totals(docs, "run", "id", "path", "text", "prompt").first().tokens
        assert tokens == -(-(len(user) + packing.SYSTEM_CHARS) // 3) and len(modes.SYSTEM) == packing.SYSTEM_CHARS


def test_prompts_are_merged_in_their_order(spark, tmp_path, calls):
    count, seen = calls
    store = cache.Store(spark, f"file://{tmp_path}/store")
    docs = spark.createDataFrame([(1, "f/a.pdf", "same"), (2, "f/b.pdf", "same"), (3, "f/c.pdf", "other")], "id int, path string, text string")

    def said(user):
        return json.dumps(models.empty_result() | ({"patient_name": "first"} if user.startswith("one") else {"patient_name": "second", "patient_id": "7"}) | {"confidence": 0.5})

    got = {r.id: r for r in modes.fast(docs, "id", "path", "text", ["one", "two"], counting(count, said), store=store).collect()}
    assert {(r.patient_name, r.patient_id) for r in got.values()} == {("first", "7")} and got[3].source_file == "f/c.pdf"
    assert got[1].raw_response.count("\n---\n") == 1
    assert len(seen()) == 4  # two texts, two prompts
    assert store.count() == 4
    none = modes.fast(docs, "id", "path", "text", [], counting(count, said)).collect()
    assert [r.warnings for r in none] == [[modes.NO_PROMPT]] * 3 and len(seen()) == 4


def test_search_with_models_passed_in(spark, tmp_path):
    words = ["apple", "pear", "plum", "fig", "kiwi", "lime", "date", "sloe"]
    body = "".join((w + " ") * (1250 // (len(w) + 1)) + "." * (1250 % (len(w) + 1)) for w in words)
    docs = spark.createDataFrame([(1, "f/a.pdf", body), (2, "f/b.pdf", "short"), (3, "f/c.pdf", "")], "id int, path string, text string")
    embed = lambda texts: [[float(t.count(w)) + 0.01 for w in words] for t in texts]
    flaky = lambda texts: embed(texts) if len(texts) == 1 else 1 / 0
    context = lambda **o: {r.id: r["__context"] for r in modes.retrieved(docs, "id", "text", "kiwi kiwi lime", **o).collect()}
    store = cache.Store(spark, f"file://{tmp_path}/vectors", cache.VECTORS)
    plain = context(make_embedder=lambda: embed, vectors=store)
    assert plain[1].split(" ")[0] == "kiwi" and plain[2] == "short" and plain[3] == ""
    assert context(make_embedder=lambda: flaky) == plain
    n = store.count()
    assert context(make_embedder=lambda: (lambda texts: 1 / 0), vectors=store) == plain and store.count() == n
    ranked = context(make_embedder=lambda: embed, make_reranker=lambda: (lambda q, texts: [(99, 9.0), *((i, float("fig" in t)) for i, t in enumerate(texts))]))
    assert "fig" in ranked[1][:1600] and ranked[1] != plain[1]
    assert context(make_embedder=lambda: embed, make_reranker=lambda: (lambda q, texts: 1 / 0)) == plain
    first = context(make_embedder=None)
    assert first[1].startswith("apple") and context(make_embedder=lambda: (lambda texts: 1 / 0)) == first
    assert {r.id for r in modes.search(docs, "id", "path", "text", ["kiwi", "fig"], make_embedder=lambda: embed).collect()} == {1, 2, 3}


def test_cancelled_rows_keep_the_others(spark, tmp_path):
    flag = tmp_path / "stop"
    stop, path = str(flag), str(flag)

    def make():
        def chat(system, user):
            if user == "b":
                open(stop, "w").close()
            return user

        return chat

    rows = spark.createDataFrame([(x,) for x in "abcd"], "user string").coalesce(1)
    got = [(r.response, r.error) for r in models.ask_model(rows, "user", make, cancelled=lambda: os.path.exists(path)).collect()]
    assert got == [("a", None), ("b", None), ("", models.CANCELLED), ("", models.CANCELLED)]
    assert models.ask_model(rows, "user", lambda: models.echo_chat, concurrency=3).rdd.getNumPartitions() == 3


def test_answers_of_services():
    assert models.vectors_in_order([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], 2) == [[1.0], [2.0]]
    for broken in ([{"embedding": [1.0]}], [{"embedding": []}, {"embedding": [1.0]}]):
        with pytest.raises(ValueError):
            models.vectors_in_order(broken, 2)
    assert models.relevances({"data": [{"index": 1, "score": 0.5}, {"index": 5, "score": 1}, {"score": 1}, {"index": 0, "relevance_score": 0.25, "score": 9}]}, 2) == [(1, 0.5), (0, 0.25)]
    assert [models.token_count(x) for x in ({"count": 0}, {"token_count": 3}, {"tokens": [1, 2]}, {})] == [0, 3, 2, None]
    assert models.snippet("x" * 240) == "x" * 240 and models.snippet("x" * 241) == "x" * 240 + "…"
    waits = [models.OLDER_CHAT.pause(n, TimeoutError()) for n in (1, 2)] + [models.OLDER_EMBEDDING.pause(2, TimeoutError()), models.OLDER_STORE.pause(3, TimeoutError())]
    assert waits == [2.0, 4.0, 3.0, 4.0]
    assert models.image_message("look", [b"png"])["content"][1]["image_url"]["url"] == "data:image/png;base64,cG5n"


def test_http_client():
    seen, failures = [], [503]

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body):
            code = failures.pop() if failures else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode() if code == 200 else b"e" * 300)

        def do_GET(self):  # noqa: N802
            self.answer({"data": [{"id": "m", "state": "loaded", "loaded_context_length": 4096}] if "v0" in self.path else [{"id": "m"}]})

        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            if self.path.endswith("embeddings"):
                self.answer({"data": [{"index": i, "embedding": [float(i)] * 2} for i in range(1 if isinstance(body["input"], str) else len(body["input"]))]})
            elif self.path.endswith("rerank"):
                self.answer({"results": [{"index": 1, "relevance_score": 1.0}]})
            elif body.get("stream"):
                self.send_response(200)
                self.end_headers()
                self.wfile.write(b'data: {"choices":[{"delta":{"content":"a"}}]}\r\n\r\ndata: {"choices":[{"delta":{"content":"b"}}]}\n\ndata: [DONE]\n')
            else:
                self.answer({"choices": [{"message": {"content": "", "reasoning_content": " said "}}]})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/v1"
    assert models.http_chat(base, "m", "key")("s", "u") == " said " and len(seen) == 2
    assert models.http_embedder(base, "m")(["a"]) == [[0.0, 0.0]] and seen[-1][1]["input"] == "a"
    assert models.http_embedder(base, "m")(["a", "b"]) == [[0.0, 0.0], [1.0, 1.0]]
    assert models.http_reranker(base, "m")("q", ["a", "b"]) == [(1, 1.0)] and models.http_vision(base, "m")("s", "u", [b"x"]) == "said"
    assert models.list_models(base) == [{"id": "m"}] and models.server_context(base, "m") == 4096
    assert models.http_chat(base, "m", stream=True)("s", "u") == "ab"
    failures.append(400)
    with pytest.raises(Exception, match="HTTP 400: e{240}…"):
        models.http_chat(base, "m")("s", "u")
    server.shutdown()


def test_older_orchestration(spark):
    files = spark.createDataFrame([("a", "\n\n".join(f"para {i} " + "x" * 900 for i in range(8))), ("b", "short"), ("c", "broken"), ("d", "")], "path string, text string")

    def make():
        def chat(system, user):
            if "broken" in user:
                raise RuntimeError("down")
            return "whole" if user.startswith("Na základě") else f"said {user.count('para')} " * 60

        return chat

    got = {r.path: r for r in orchestration.analyse(files, "path", "text", "do", make, size=2000, overlap=0).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].response, got["a"].n_chunks, got["b"].response) == ("whole", 4, ("said 0 " * 60).strip())
    assert got["c"].response == "[Chyba: down]" and got["c"].error == "down"
    votes = orchestration.analyse(files.filter("path = 'a'"), "path", "text", "odpověz ano/ne", lambda: (lambda s, u: "Ne."), size=2000, overlap=0)
    assert votes.first().response == "NE"
    answers = spark.createDataFrame([("b", "ok", None), ("c", "x", "down")], "path string, response string, error string")
    again = {r.path: r for r in orchestration.retry_failed(answers, files, "path", "text", "do", lambda: (lambda s, u: "now")).collect()}
    assert (again["c"].response, again["c"].error, again["c"].status) == ("now", None, "RETRY_OK") and again["b"].status == "OK"
    failed = {r.path: r for r in orchestration.retry_failed(answers, files, "path", "text", "do", make).collect()}
    assert (failed["c"].response, failed["c"].status) == ("x", "RETRY_ERR")
    short = orchestration.run_summary(answers, "path", "response", " do ", make)
    assert short is None  # fewer characters than a summary is asked for
    said = orchestration.run_summary(answers.withColumn("response", F.repeat("response", 2000)), "path", "response", " do ", make)
    assert said == "Prompt:\n\ndo\n\n=== Celkový souhrn dávky ===\n\nwhole"
    assert orchestration.run_summary(answers.limit(0), "path", "response", "do", make) is None
    assert orchestration.summary_limit("x" * 4, 4096, 1) == (4096 - 901 - 1 - 96) * 4 and orchestration.summary_limit("", None, 7000) == 7000
    shown = orchestration.analyse_pages(spark.createDataFrame([("p", bytearray(b"123"))], "path string, content binary"), "path", "content", "q", lambda: (lambda s, u, images: str(len(images))), lambda raw: [raw] * 5, 2)
    assert shown.first().response == "2\n\n2\n\n1"


def test_names_that_are_taken(spark):
    rows = spark.createDataFrame([(i, f"in/{n}.pdf") for i, n in enumerate(["a", "A", "a_2", "b", "b", "a", "a_2_2"])], "i int, path string")
    got = [r.name for r in sinks.unique_names(rows, "path", "i", ".json").orderBy("i").collect()]
    assert got == ["a.json", "A_2.json", "a_2_2.json", "b.json", "b_2.json", "a_3.json", "a_2_2_2.json"]
    assert len({n.lower() for n in got}) == len(got)


def test_raw_export(spark, tmp_path):
    said = ["=====CSV===== a;b =====TXT===== note", ' {"b": 1, "a": [2]} ', "prose", "", '"text"']
    rows = spark.createDataFrame([(f"{i}/x.pdf", t) for i, t in enumerate(said)], "source_file string, raw_response string")
    sinks.write_raw(rows, str(tmp_path))
    got = {p.name: p.read_text(encoding="utf-8") for p in tmp_path.iterdir()}
    assert got["x_raw.csv"] == "﻿a;b" and got["x_raw.txt"] == "note" and json.loads(got["x_raw_2.json"]) == {"a": [2], "b": 1}
    assert got["x_raw_2.json"].index('"a"') < got["x_raw_2.json"].index('"b"') and got["x_raw_3.txt"] == "prose"
    assert json.loads(got["raw_responses.json"]) == {"x": "text"} and len(got) == 6


def test_batch_log(spark, tmp_path):
    row = dict.fromkeys(sinks.BATCH_COLUMNS) | {"soubor": "a.pdf", "stav": "OK", "extrakce_s": 1.234, "model": "m | p"}
    schema = ", ".join(f"`{c}` {'double' if c.endswith('_s') or c == 'čas_celkem_s' else 'string'}" for c in sinks.BATCH_COLUMNS)
    rows = spark.createDataFrame([row], schema)
    sinks.append_batch_log(rows, f"file://{tmp_path}/log")
    assert spark.read.text(f"file://{tmp_path}/log").first().value == "a.pdf;OK;;;;1.23;;;;;m | p"
    with pytest.raises(Exception, match="unknown status"):
        sinks.append_batch_log(rows.withColumn("stav", F.lit("?")), f"file://{tmp_path}/log2")


def test_layout_blocks_and_prompt_errors(spark, tmp_path):
    said = {"md": " a ", "pageIndex": "3", "label": "Table", "kind": "other", "bbox": {"page": 2}, "kids": [{"content": "b", "page": "²", "bbox": {"page": 2.0}}, {"text": "", "value": "x" * 20_001}, {"markdown": "a", "page": 3, "type": "TABLE"}]}
    assert readers.blocks(json.dumps(said)) == [(3, "table", "a"), (2, None, "b")]
    assert readers.blocks("broken") == []
    with pytest.raises(readers.PromptError, match="no_access"):
        readers.prompt_folder(spark, f"file://{tmp_path}/none")
    (tmp_path / "p.md").write_text("# p")
    with pytest.raises(readers.PromptError, match="no_folder"):
        readers.prompt_folder(spark, f"file://{tmp_path}/p.md")
    assert readers.prompt_content(spark, f"file://{tmp_path}/p.md") == "# p"
    with pytest.raises(readers.PromptError, match="no_file"):
        readers.prompt_content(spark, f"file://{tmp_path}/q.md")
    pages = readers.recognised(spark.createDataFrame([("d", bytearray(b"ab"))], "path string, content binary"), lambda raw: [raw[:1], b"", raw[1:]], lambda image: image.decode() if image != b"b" else 1 / 0)
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(0, "a"), (1, ""), (2, "")]


def test_text_or_ocr_by_page(spark):
    long = "readable text of a page " * 5
    rows = spark.createDataFrame([("d", 1, "??", "ocr"), ("d", 0, long, "x"), ("d", 2, None, None)], "doc string, page int, layer string, ocr string")
    assert cleaning.layer_or_ocr_by_page(rows).first().text == f"{long}\n\n[[PAGE_BREAK]]\n\nocr\n\n[[PAGE_BREAK]]\n\n"
    primary = spark.createDataFrame([("a", 0, "long enough text"), ("a", 1, "x"), ("b", 0, "long enough text")], "doc string, page int, text string")
    read = lambda weak: weak.select("doc", F.lit(1).alias("page"), F.lit("from ocr").alias("text"))
    got = {(r.doc, r.page): r.text for r in cleaning.with_ocr_fallback(primary, read).collect()}
    assert got == {("a", 0): "long enough text", ("a", 1): "from ocr", ("b", 0): "long enough text"}


def test_run_control(spark):
    runner, order = config.Runner(), []

    def work():
        order.append(runner.run(lambda: None)[0])
        return 7

    assert runner.run(work) == (config.Outcome.SUCCESS, 7) and order == [config.Outcome.NOT_STARTED]
    assert runner.run(lambda: 1, ["model"]) == (config.Outcome.NOT_STARTED, ["model"])
    assert runner.run(lambda: 1 / 0)[0] == config.Outcome.FAILED

    def cancelled():
        raise config.Cancelled

    assert runner.run(cancelled)[0] == config.Outcome.CANCELLED and runner.run(lambda: 2) == (config.Outcome.SUCCESS, 2)
    servers = config.Servers()
    servers.put(config.Server("a", "http://a"))
    servers.put(config.Server("a", "http://b"))
    assert config.Servers.from_json(servers.to_json()) == servers and servers.current().base_url == "http://b"
    assert config.Servers.from_json("[]") == config.Servers() and config.Servers().current() is None
    assert [config.context_label(n) for n in (900, 32_768, 2_500_000)] == ["900 tok.", "32k tok.", "2M tok."]
    c = config.RunConfig(context_tokens=1000)
    assert config.refreshed_context(c, 500, lambda: 1 / 0) is c and config.refreshed_context(c, 501, lambda: 4096).context_tokens == 4096 and config.refreshed_context(c, 501, lambda: None) is c
    log = spark.createDataFrame([("scan", 10.0, 4, 0), ("ocr", 20.0, 0, 3), ("inference", 30.0, 0, 2)], "phase string, ms double, docs int, pages int")
    row = metrics.rollup(log, "phase", "ms", "docs", "pages").first()
    assert (row.avg_page_ms, row.avg_doc_ms, row.docs_per_minute) == (10.0, 15.0, 4000.0)
    none = metrics.rollup(log.limit(0), "phase", "ms", "docs", "pages", F.lit(100.0)).first()
    assert (none.avg_page_ms, none.avg_doc_ms, none.docs_per_minute) == (0.0, 0.0, 0.0)
    base = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 0.0)], "ended_at int, avg_doc_ms double")
    assert metrics.estimate(base, 10).first().estimate_ms == 70.0


def test_streams_pause_and_tell(spark, tmp_path):
    schema = "key string, text string"
    source, store = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    told = []
    listener = incremental.Progress(lambda n, so_far: told.append((n, so_far)))
    spark.streams.addListener(listener)

    def start():
        return incremental.process_new(incremental.parquet_stream(spark, source, schema), "key", lambda d: d, store, schema, f"file://{tmp_path}/check")

    run = incremental.PausableRun(start)
    assert not run.running
    spark.createDataFrame([("a", "x")], schema).write.mode("append").parquet(source)
    run.resume().awaitTermination()
    run.pause()
    spark.createDataFrame([("b", "y")], schema).write.mode("append").parquet(source)
    run.resume().awaitTermination()
    spark.streams.removeListener(listener)
    assert sorted(r.key for r in spark.read.parquet(store).collect()) == ["a", "b"]


def test_one_very_long_text(spark):
    from lexmill.functions import text
    from lexmill.operators import chunking

    df = spark.range(1).select(F.repeat(F.lit("some words of a very long text. "), 600_000).alias("t"))
    out = df.select(F.size(chunking.chunk_array(F.col("t"))).alias("n"), text.output_warnings(F.col("t"), F.length("t")).alias("w"), text.has_usable_text(F.col("t")).alias("u")).first()
    assert out.n == -(-(600_000 * 32 - 250) // 1250) and out.u and out.w == ["repeated"]
    pages = spark.createDataFrame([([f"Header\nline {i}\nfoot" for i in range(1000)],)], "pages array<string>")
    assert cleaning.clean_pages(pages).first().cleaned_text.startswith("line 0\n\nline 1")


def test_chunks_that_are_alike_are_asked_about_once(spark, calls):
    count, seen = calls
    rows = [("g", i, [1.0, 0.01 * i], f"text {i}") for i in range(4)] + [("g", 9, [0.0, 1.0], "bad"), ("g", 10, [0.0, 1.0], "bad too"), ("h", 0, [1.0, 0.0], "other group")]
    chunks = spark.createDataFrame(rows, "g string, k int, v array<double>, t string")
    said = lambda user: "[Chyba x" if "bad" in user else user.upper()
    got = {(r.g, r.k): r for r in orchestration.asked_by_likeness(chunks, "g", "k", "v", "p", "t", counting(count, said), 0.95).collect()}
    assert [got["g", i].answer for i in range(4)] == ["P\n\nTEXT 0"] * 4 and [got["g", i].reused for i in range(4)] == [False, True, True, True]
    assert got["g", 10].answer == "[Chyba x" and not got["g", 10].reused and len(got) == 7
    assert len(seen()) == 4


def test_places_in_a_global_order(spark):
    rows = spark.range(1000).selectExpr("cast((id * 37) % 500 as int) x", "id").repartition(5)
    got = metrics.ranked(rows, F.col("x"), "place").collect()
    assert sorted(r.place for r in got) == list(range(1, 1001))
    assert [r.x for r in sorted(got, key=lambda r: r.place)] == sorted(r.x for r in got)
    assert metrics.ranked(rows.limit(0), F.col("x"), "place").collect() == []
