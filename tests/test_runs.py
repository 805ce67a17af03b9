import os
import threading
import time

from lexmill.config import RunConfig
from lexmill.operators import runs
from lexmill.operators.models import CANCELLED, ask_model


def asking(folder, slow=0.0):
    """A chat that leaves a file for each request, with the time at which it came and went."""

    def make():
        def chat(system, user):
            began = time.time()
            time.sleep(slow)
            if user == "bad":
                raise RuntimeError("down")
            with open(os.path.join(folder, f"{user}-{time.time_ns()}"), "w") as f:
                f.write(f"{began} {time.time()}")
            return user.upper()

        return chat

    return make


def requests(spark, n):
    return spark.createDataFrame([(f"k{i}", f"u{i}") for i in range(n)], "key string, user string")


def test_a_cancelled_run_keeps_what_is_answered_and_goes_on_later(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    progress = []
    run = runs.ModelRun(spark, f"file://{tmp_path}/store", RunConfig(concurrency=2, throttle_ms=0), chunk_rows=10)

    def told(done, total, failed):
        progress.append((done, total, failed))
        if len(progress) == 2:
            threading.Timer(0.7, run.cancel).start()

    run.told = told
    rows = requests(spark, 40)
    got = {r.key: r for r in run.ask(rows, asking(str(seen), 0.3)).collect()}
    answered = {k for k, r in got.items() if r.response}
    assert len(got) == 40 and len(answered) == progress[-1][0] >= 10 and len(answered) < 40
    assert all(got[k].error is None and got[k].response == got[k].user.upper() for k in answered)
    assert all(got[k].error == CANCELLED and got[k].response is None for k in got.keys() - answered)
    before = {f.split("-")[0] for f in os.listdir(seen)}
    again = runs.ModelRun(spark, f"file://{tmp_path}/store", RunConfig(concurrency=4, throttle_ms=0), chunk_rows=100)
    assert {r.response for r in again.ask(rows, asking(str(seen))).collect()} == {f"U{i}" for i in range(40)}
    stored = [f for f in os.listdir(seen) if f"k{f.split('-')[0][1:]}" in answered]
    assert len(stored) == len(answered), "an answer that was stored was asked for again"
    assert before


def test_errors_are_answers_and_equal_keys_are_asked_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "bad")], "key string, user string")
    told = []
    run = runs.ModelRun(spark, f"file://{tmp_path}/store", RunConfig(throttle_ms=0), told=lambda *n: told.append(n))
    got = sorted((r.key, r.response, r.error) for r in run.ask(rows, asking(str(seen))).collect())
    assert got == [("a", "X", None), ("a", "X", None), ("b", "", "down")] and told == [(2, 2, 1)] and len(os.listdir(seen)) == 1
    assert run.ask(rows.limit(0), asking(str(seen))).collect() == []


def test_no_more_requests_at_a_time_than_the_configuration_says(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    runs.ModelRun(spark, f"file://{tmp_path}/store", RunConfig(concurrency=2, throttle_ms=50)).ask(requests(spark, 12), asking(str(seen), 0.1)).collect()
    spans = [tuple(map(float, (seen / f).read_text().split())) for f in os.listdir(seen)]
    assert max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= 2


def test_the_rate_is_shared_by_the_tasks(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    ask_model(requests(spark, 12), "user", asking(str(seen)), concurrency=3, per_second=6).write.format("noop").mode("overwrite").save()
    began = sorted(float((seen / f).read_text().split()[0]) for f in os.listdir(seen))
    # Twelve requests at six a second: each of three tasks waits between its own.
    assert began[-1] - began[0] > 0.9
