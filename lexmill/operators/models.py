"""Model calls: protocols, deterministic built-ins that stand in for models offline, and an HTTP client.

A model stage is mapInPandas over rows: the client is made once a task, concurrency is the number of partitions, an
error becomes a warning in its own row. Hits and misses of a cache are split before, so that only misses get here.
"""

from __future__ import annotations

import base64
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexmill.config import context_of, loaded_model, native_endpoint
from lexmill.functions.jsonio import empty_result
from lexmill.functions.text import OVERFLOW_PHRASES
from lexmill.functions.vectors import LETTERS

CANCELLED = "Přerušeno uživatelem"
SNIPPET_CHARS = 240


class Chat(Protocol):
    def __call__(self, system: str, user: str) -> str: ...


class Vision(Protocol):
    """A chat that is shown images (PNG bytes)."""

    def __call__(self, system: str, user: str, images: list[bytes]) -> str: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def __call__(self, query: str, texts: list[str]) -> list[tuple[int, float]]: ...


def letter_embedder(texts: list[str]) -> list[list[float]]:
    return [[float(t.count(c)) for c in LETTERS] for t in texts]


def echo_chat(system: str, user: str) -> str:
    """A canonical result whose fields are functions of the document in the message."""
    body = re.split(r"(?:Text dokumentu|Vstupní dokumenty[^\n]*|Dílčí výstupy):\n", user, maxsplit=1)[-1]
    return json.dumps(empty_result() | {"patient_name": f"chars {len(body)}", "confidence": 0.5}, ensure_ascii=False)


def overlap_reranker(query: str, texts: list[str]) -> list[tuple[int, float]]:
    terms = set(query.lower().split())
    return sorted(((i, float(len(terms & set(t.lower().split())))) for i, t in enumerate(texts)), key=lambda x: (-x[1], x[0]))


def overflows(answer: str) -> bool:
    return any(p in answer.lower() for p in OVERFLOW_PHRASES)


def snippet(text: str) -> str:
    """What of an error's body goes into a message."""
    return text[:SNIPPET_CHARS] + "…" if len(text) > SNIPPET_CHARS else text


@dataclass(frozen=True)
class Retry:
    """Which failures are tried again, how often, and after how many seconds (a function of the attempt, from 1)."""

    codes: tuple[int, ...] = (502, 503, 504)
    attempts: int = 3
    wait: Callable[[int], float] = lambda n: min(10.0, 3.0 ** (n - 1))
    heeds_server: bool = False

    def transient(self, e: Exception) -> bool:
        return e.code in self.codes if isinstance(e, urllib.error.HTTPError) else isinstance(e, urllib.error.URLError | TimeoutError)

    def pause(self, attempt: int, e: Exception) -> float:
        said = e.headers.get("Retry-After", "") if self.heeds_server and isinstance(e, urllib.error.HTTPError) and e.headers else ""
        return float(said) if re.fullmatch(r"[0-9]+(\.[0-9]+)?", said) else self.wait(attempt)


#: The older rules, for answers, embeddings and the vector store.
OLDER_CHAT = Retry((429, 503), 3, lambda n: 2.0 * 2 ** (n - 1), True)
OLDER_EMBEDDING = Retry((429, 503), 3, lambda n: 1.5 * 2 ** (n - 1))
OLDER_STORE = Retry((429, 503), 3, lambda n: 1.0 * 2 ** (n - 1))


def retried(call: Callable[[], str], attempts: int | None = None, sleep: Callable[[float], None] = time.sleep, retry: Retry = Retry()) -> str:  # noqa: B008
    """call(), with transient failures tried again."""
    most = attempts or retry.attempts
    for n in range(1, most + 1):
        try:
            return call()
        except (urllib.error.HTTPError, urllib.error.URLError, TimeoutError) as e:
            if n == most or not retry.transient(e):
                raise
            sleep(retry.pause(n, e))
    raise AssertionError


def _sent(base_url: str, path: str, body: dict | None, key: str, timeout: float, read: Callable = json.load):  # noqa: ANN202
    """The answer of a service, as JSON unless it is read otherwise; the body of an HTTP error becomes part of its
    message."""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(base_url.rstrip("/") + path, None if body is None else json.dumps(body).encode(), head)
    try:
        with urllib.request.urlopen(request, timeout=min(max(timeout, 60), 3600)) as answer:
            return read(answer)
    except urllib.error.HTTPError as e:
        e.msg = f"HTTP {e.code}: {snippet(e.read().decode('utf-8', 'replace'))}"
        raise


def _said(answer: dict) -> str:
    message = answer["choices"][0]["message"]
    return message.get("content") or message.get("reasoning_content") or ""


def http_chat(base_url: str, model: str, key: str = "", timeout: float = 600, stream: bool = False, retry: Retry = Retry()) -> Chat:  # noqa: B008
    """A chat client of the common completions interface; a streamed answer is put together as it comes in. The older rules
    are those of retry=OLDER_CHAT; the other clients have the same parameter."""

    def ask(system: str, user: str) -> str:
        body = {"model": model, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        if stream:
            return _sent(base_url, "/chat/completions", body | {"stream": True}, key, timeout, lambda lines: folded_events(x.decode().rstrip("\r\n") for x in lines))
        return _said(_sent(base_url, "/chat/completions", body, key, timeout))

    return lambda system, user: retried(lambda: ask(system, user), retry=retry)


def image_message(user: str, images: list[bytes]) -> dict:
    """A message of a text and images as data addresses."""
    shown = [{"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(x).decode()}} for x in images]
    return {"role": "user", "content": [{"type": "text", "text": user}, *shown]}


def http_vision(base_url: str, model: str, key: str = "", timeout: float = 600, retry: Retry = Retry()) -> Vision:  # noqa: B008
    def ask(system: str, user: str, images: list[bytes]) -> str:
        body = {"model": model, "temperature": 0, "messages": [{"role": "system", "content": system}, image_message(user, images)]}
        return _said(_sent(base_url, "/chat/completions", body, key, timeout)).strip()

    return lambda system, user, images: retried(lambda: ask(system, user, images), retry=retry)


def vectors_in_order(items: list[dict], n: int) -> list[list[float]]:
    """The n vectors of an answer by their index, else by their place; all must be there and none empty."""
    placed = sorted(enumerate(items), key=lambda x: x[0] if x[1].get("index") is None else x[1]["index"])
    vectors = [x.get("embedding") or [] for _, x in placed]
    if len(vectors) != n or not all(vectors):
        raise ValueError("an embedding is missing")
    return vectors


def http_embedder(base_url: str, model: str, key: str = "", timeout: float = 600, retry: Retry = Retry()) -> Embedder:  # noqa: B008
    def ask(texts: list[str]) -> list[list[float]]:
        body = {"model": model, "input": texts[0] if len(texts) == 1 else texts}
        return vectors_in_order(_sent(base_url, "/embeddings", body, key, timeout)["data"], len(texts)) if texts else []

    return lambda texts: retried(lambda: ask(texts), retry=retry)


def relevances(answer: dict, n: int) -> list[tuple[int, float]]:
    """(place, score) of a reranker's answer; places that are not among the n texts are left out."""
    rows = answer.get("results") if answer.get("results") is not None else answer.get("data") or []
    score = lambda x: next((x[k] for k in ("relevance_score", "score") if x.get(k) is not None), 0.0)
    return [(x["index"], float(score(x))) for x in rows if isinstance(x.get("index"), int) and 0 <= x["index"] < n]


def http_reranker(base_url: str, model: str, top_n: int = 6, key: str = "", timeout: float = 600, retry: Retry = Retry()) -> Reranker:  # noqa: B008
    def ask(query: str, texts: list[str]) -> list[tuple[int, float]]:
        body = {"model": model, "query": query, "documents": texts, "top_n": top_n}
        return relevances(_sent(base_url, "/rerank", body, key, timeout), len(texts)) if texts else []

    return lambda query, texts: retried(lambda: ask(query, texts), retry=retry)


def list_models(base_url: str, key: str = "", timeout: float = 60) -> list[dict]:
    """What a server's list of models says, ids and whatever else."""
    return _sent(base_url, "/models", None, key, timeout).get("data") or []


def server_context(base_url: str, model: str, key: str = "", timeout: float = 60) -> int | None:
    """The context length of a model by the server's own interface, as it is loaded if it says so."""
    found = loaded_model(_sent(native_endpoint(base_url, ""), "/api/v0/models", None, key, timeout).get("data") or [], model)
    return context_of(found) if found else None


def token_count(answer: dict) -> int | None:
    """The number of tokens in a tokenizer's answer, whichever of its forms it has."""
    listed = answer.get("tokens")
    return next((n for n in (answer.get("count"), answer.get("token_count"), None if listed is None else len(listed)) if n is not None), None)


def split_on_overflow(chat: Chat, system: str, prompt: str, text: str, size: int | None = None) -> str:
    """The answer; if it tells of an overflow and the chunk has over 500 characters, those of its halves put together."""
    answer = chat(system, f"{prompt}\n\n{text}")
    if not overflows(answer) or len(text) <= 500:
        return answer
    half = -(-len(text) // 2)
    overlap = min(120, max(40, len(text) // 8))
    parts = [text[:half], text[max(0, half - overlap) :]]
    return "\n\n".join(split_on_overflow(chat, system, prompt, p) for p in parts)


def shrinking(chat: Chat, system: str, prompt: str, text: str, limit: int) -> str | None:
    """Tries ever shorter prefixes, by 0.65, as long as the answer tells of an overflow; none below the floor."""
    floor, answer = max(1200, min(limit, 2400)), None
    while limit >= floor:
        answer = chat(system, f"{prompt}\n\n{text[:limit]}")
        if not overflows(answer):
            break
        limit = int(limit * 0.65)
    return answer


def folded_events(lines: Iterable[str]) -> str:
    """The text of a stream of server-sent deltas, up to its end mark."""
    out = []
    for line in lines:
        if not line.startswith("data: "):
            continue
        if line[6:].strip() == "[DONE]":
            break
        try:
            out.append(json.loads(line[6:])["choices"][0]["delta"].get("content") or "")
        except (ValueError, KeyError, IndexError):
            continue
    return "".join(out)


def ask_model(rows: DataFrame, user: str, make_chat: Callable[[], Chat], system: str = "", per_second: float = 0, concurrency: int = 0, cancelled: Callable[[], bool] | None = None, pause_s: float = 0) -> DataFrame:
    """rows with response and error. concurrency is the number of tasks that ask at a time (0: as the rows come);
    per_second limits the requests of all of them together where concurrency is given, else of each; pause_s is waited
    after each request. Rows that come up after `cancelled` says so are not asked: it is asked in the workers, so it has
    to look at something they share (see runs.ModelRun for a driver's cancel)."""
    per_second = per_second / max(1, concurrency)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat, last = make_chat(), 0.0
        for pdf in frames:
            answers, errors = [], []
            for message in pdf[user]:
                if cancelled is not None and cancelled():
                    answers.append("")
                    errors.append(CANCELLED)
                    continue
                if per_second:
                    time.sleep(max(0.0, last + 1 / per_second - time.monotonic()))
                    last = time.monotonic()
                try:
                    answers.append(chat(system, message))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a row's failure is that row's warning
                    answers.append("")
                    errors.append(str(e))
                if pause_s:
                    time.sleep(pause_s)
            yield pdf.assign(response=answers, error=errors)

    dealt = rows.repartition(concurrency) if concurrency else rows
    return dealt.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())]))


def embed_texts(texts: DataFrame, make_embedder: Callable[[], Embedder], batch: int = 64) -> DataFrame:
    """texts (key, text) to (key, vector), in batches; texts of a batch that fails are embedded one by one, and those
    that fail again have no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make_embedder()

        def each(some: list[str]) -> list[list[float] | None]:
            try:
                found = embed(some)
                if len(found) == len(some) and all(found):
                    return found
            except Exception:  # noqa: BLE001  a text's failure leaves that text out
                pass
            return [None] if len(some) == 1 else [v for t in some for v in each([t])]

        for pdf in frames:
            said = pdf.text.tolist()
            vectors = [v for i in range(0, len(said), batch) for v in each(said[i : i + batch])]
            yield pd.DataFrame({"key": pdf.key, "vector": pd.Series(vectors, index=pdf.index, dtype=object)}).dropna()

    return texts.select("key", "text").mapInPandas(run, "key string, vector array<double>")


def rerank_texts(groups: DataFrame, key: str, query: str, make_reranker: Callable[[], Reranker], k: int) -> DataFrame:
    """groups (key, texts) to (key, best: the places of the k best texts by score); failures and empty answers have no
    row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = make_reranker()
        for pdf in frames:
            keys, best = [], []
            for name, texts in zip(pdf[key], pdf.texts, strict=True):
                try:
                    scored = rank(query, list(texts))
                except Exception:  # noqa: BLE001  the ranking by vectors stays
                    continue
                places = [i for i, _ in sorted((x for x in scored if 0 <= x[0] < len(texts)), key=lambda x: -x[1])][:k]
                if places:
                    keys.append(name)
                    best.append(places)
            yield pd.DataFrame({key: pd.Series(keys, dtype=pdf[key].dtype), "best": pd.Series(best, dtype=object)})

    return groups.select(key, "texts").mapInPandas(run, T.StructType([groups.schema[key], T.StructField("best", T.ArrayType(T.IntegerType()))]))
