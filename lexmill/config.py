"""Settings on the driver: a run's configuration, service addresses, and texts for people."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, fields
from enum import Enum


@dataclass
class RunConfig:
    mode: str = "FAST"
    model: str = ""
    embedding_model: str = ""
    reranker_model: str = ""
    concurrency: int = 4
    throttle_ms: int = 50
    context_tokens: int = 32_768
    timeout_s: float = 600

    def __post_init__(self) -> None:
        self.concurrency = min(max(self.concurrency, 1), 16)
        self.throttle_ms = min(max(self.throttle_ms, 0), 2000)
        self.timeout_s = min(max(self.timeout_s, 60), 3600)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str | None) -> RunConfig:
        """Defaults for whatever cannot be read."""
        try:
            value = json.loads(text or "")
        except ValueError:
            return cls()
        known = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: v for k, v in value.items() if k in known and isinstance(v, known[k])}) if isinstance(value, dict) else cls()

    def conflicts(self, suggested: str | None) -> list[str]:
        out = ["mode"] if suggested and suggested != self.mode else []
        out += ["no_embedding_model"] if self.mode == "SEARCH" and not self.embedding_model else []
        return out + (["one_answer_for_all"] if self.mode == "CONSOLIDATE" else [])

    def missing(self, prompt: str, output: str, n_docs: int, server: str) -> list[str]:
        """What keeps a run from starting."""
        have = {"server": server.strip(), "model": self.model.strip(), "prompt": prompt.strip(), "output": output.strip(), "documents": n_docs}
        return [k for k, v in have.items() if not v]


@dataclass(frozen=True)
class Server:
    id: str
    base_url: str
    api_key: str = ""


@dataclass
class Servers:
    """Services by id, and which is chosen; kept as JSON, and empty where that cannot be read."""

    known: list[Server] = field(default_factory=list)
    chosen: str = ""

    def put(self, server: Server) -> None:
        self.known = [s for s in self.known if s.id != server.id] + [server]

    def current(self) -> Server | None:
        return next((s for s in self.known if s.id == self.chosen), self.known[0] if self.known else None)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str | None) -> Servers:
        try:
            value = json.loads(text or "")
            return cls([Server(**s) for s in value["known"]], str(value["chosen"]))
        except (ValueError, KeyError, TypeError):
            return cls()


class Outcome(Enum):
    """How a run ended."""

    SUCCESS = "success"
    CANCELLED = "cancelled"
    FAILED = "failed"
    NOT_STARTED = "not_started"


class Cancelled(Exception):
    """Raised by work that was told to stop."""


class Runner:
    """Lets one run go at a time. A second one, and one that lacks something, does not start."""

    def __init__(self) -> None:
        self._lock = threading.Lock()

    @contextmanager
    def _only(self) -> Iterator[bool]:
        got = self._lock.acquire(blocking=False)
        try:
            yield got
        finally:
            if got:
                self._lock.release()

    def run(self, work: Callable[[], object], missing: list[str] | None = None) -> tuple[Outcome, object]:
        """(outcome, what work returned, or the error)."""
        with self._only() as free:
            if not free or missing:
                return Outcome.NOT_STARTED, missing or ["another run"]
            try:
                return Outcome.SUCCESS, work()
            except Cancelled as e:
                return Outcome.CANCELLED, e
            except Exception as e:  # noqa: BLE001  the caller gets the error with the outcome
                return Outcome.FAILED, e


def refreshed_context(config: RunConfig, estimated_tokens: int, ask: Callable[[], int | None]) -> RunConfig:
    """The configuration with the context that the server tells of, asked for where an estimate takes over half of it."""
    if 2 * estimated_tokens <= config.context_tokens:
        return config
    found = ask()
    return config if not found or found <= 0 else RunConfig(**(asdict(config) | {"context_tokens": found}))


def context_label(tokens: int) -> str:
    if tokens >= 1_000_000:
        return f"{tokens // 1_000_000}M tok."
    return f"{tokens // 1024}k tok." if tokens >= 1024 else f"{tokens} tok."


def endpoint(base: str, path: str) -> str:
    return base.strip().rstrip("/") + "/" + path.lstrip("/")


def native_endpoint(base: str, path: str) -> str:
    """The address of a server's own interface, beside the common one below /v1."""
    return endpoint(base.strip().rstrip("/").removesuffix("/v1"), path)


def loaded_model(models: list[dict], wanted: str) -> dict | None:
    """The model of that id, else one that is loaded, else the first."""
    ranked = sorted(range(len(models)), key=lambda i: (models[i].get("id") != wanted, models[i].get("state") != "loaded", i))
    return models[ranked[0]] if ranked else None


def context_of(model: dict) -> int | None:
    return model.get("loaded_context_length") or model.get("max_context_length")


def human_eta(seconds: float) -> str:
    if seconds <= 0:
        return "—"
    s = int(seconds + 0.5)
    if s < 60:
        return f"~{s} s"
    minutes, s = divmod(s, 60)
    if minutes < 60:
        return f"~{minutes} min" + (f" {s} s" if s else "")
    return f"~{minutes // 60} h {minutes % 60} min"


def progress_health(running: bool, done: int, elapsed_s: float, silent_s: float) -> str:
    if not running:
        return "finished" if done else "idle"
    if not done and elapsed_s < 15:
        return "starting"
    return "stuck" if silent_s > 30 else "ok"
