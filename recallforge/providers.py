"""Language-model providers: requests, their hashes, recorded answers, an HTTP client with a cache.

Providers are plain objects that are sent to tasks; connections and files are opened there on first use.
"""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict, dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LlmError(Exception):
    """A model that can't be asked or whose answer can't be read."""


@dataclass
class Message:
    role: str
    content: str


@dataclass
class Request:
    messages: list[Message]
    model: str = ""
    temperature: float = 0.0
    max_tokens: int = 512
    prompt_version: str = "v1"


@dataclass
class Config:
    """Where and how to ask; ``timeout`` is in seconds."""

    provider: str = "fixture"
    model: str = ""
    base_url: str = ""
    api_key: str = ""
    path: str = ""
    timeout: float = 60.0
    max_tokens: int = 16384
    extra: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, prefix: str = "RECALLFORGE_LLM", env: Mapping[str, str] | None = None, fallback: Config | None = None) -> Config:
        """Of variables ``prefix_PROVIDER``, ``_MODEL``, ``_BASE_URL``, ``_API_KEY``, ``_PATH``, ``_TIMEOUT``, ``_MAX_TOKENS``; then of ``fallback``."""
        env, base = os.environ if env is None else env, fallback or cls()
        text = {k: env.get(f"{prefix}_{k.upper()}") or getattr(base, k) for k in ("provider", "model", "base_url", "api_key", "path")}
        try:
            timeout, tokens = float(env.get(f"{prefix}_TIMEOUT") or base.timeout), int(env.get(f"{prefix}_MAX_TOKENS") or base.max_tokens)
        except ValueError as e:
            raise LlmError(f"bad setting: {e}") from e
        return cls(**text, timeout=timeout, max_tokens=tokens if tokens > 0 else base.max_tokens)


def extractor_config(env: Mapping[str, str] | None = None) -> Config:
    """Settings of the extractor, where unset those of all models."""
    return Config.from_env("RECALLFORGE_EXTRACTOR", env, Config.from_env(env=env))


def request_hash(request: Request) -> str:
    """The cache key of a request: a digest of all its fields, the same on every machine."""
    return hashlib.sha256(json.dumps(asdict(request), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


class LlmProvider(Protocol):
    def complete(self, request: Request) -> str: ...

    def metadata(self) -> dict[str, str]: ...


def read_records(path: str) -> dict[str, str]:
    """Recorded answers of a JSONL file by request hash; the last one of a hash wins; none if there is no file."""
    if not os.path.exists(path):
        return {}
    out = {}
    with open(path, encoding="utf-8") as lines:
        for n, text in enumerate(lines, 1):
            if text.strip():
                try:
                    record = json.loads(text)
                    out[record["request_hash"]] = record["response"]
                except (ValueError, KeyError, TypeError) as e:
                    raise LlmError(f"{path}, line {n}: {e}") from e
    return out


def append_record(path: str, key: str, response: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as out:
        out.write(json.dumps({"request_hash": key, "response": response}, ensure_ascii=False) + "\n")


class FixtureProvider:
    """Replays recorded answers; a request without one is an error."""

    def __init__(self, records: dict[str, str], model: str = "fixture"):
        self.records, self.model = records, model

    @classmethod
    def open(cls, path: str) -> FixtureProvider:
        if not os.path.exists(path):
            raise LlmError(f"no such file: {path}")
        return cls(read_records(path))

    def complete(self, request: Request) -> str:
        key = request_hash(request)
        if key not in self.records:
            raise LlmError(f"no recorded answer for {key}")
        return self.records[key]

    def metadata(self) -> dict[str, str]:
        return {"provider": "fixture", "model": self.model}


def message_content(body: Any) -> str:
    """The text of a chat completion: its content, else its reasoning."""
    try:
        message = body["choices"][0]["message"]
    except (KeyError, IndexError, TypeError) as e:
        raise LlmError("an answer without a message") from e
    for name in ("content", "reasoning_content"):
        text = message.get(name)
        if isinstance(text, str) and text.strip():
            return text
    raise LlmError("an answer without text")


def post_json(url: str, body: dict, headers: dict[str, str], timeout: float) -> Any:
    data = json.dumps(body).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json", **headers}), timeout=timeout) as got:
            return json.loads(got.read())
    except (OSError, ValueError) as e:
        raise LlmError(f"{url}: {e}") from e


class ChatProvider:
    """Asks an HTTP endpoint of chat completions; answers are cached in a JSONL file if ``path`` is set."""

    def __init__(self, config: Config, post: Callable[[str, dict, dict[str, str], float], Any] = post_json):
        if not config.base_url:
            raise LlmError("base_url is not set")
        self.config, self.post, self.cache = config, post, read_records(config.path) if config.path else {}

    def complete(self, request: Request) -> str:
        key = request_hash(request)
        if key not in self.cache:
            body = {"model": request.model or self.config.model, "messages": [asdict(m) for m in request.messages], "temperature": request.temperature, "max_tokens": request.max_tokens}
            headers = {"Authorization": f"Bearer {self.config.api_key}"} if self.config.api_key else {}
            self.cache[key] = message_content(self.post(self.config.base_url.rstrip("/") + "/chat/completions", body, headers, self.config.timeout))
            if self.config.path:
                append_record(self.config.path, key, self.cache[key])
        return self.cache[key]

    def metadata(self) -> dict[str, str]:
        return {"provider": "chat", "model": self.config.model}


#: Providers by name; others can be added.
PROVIDERS: dict[str, Callable[[Config], LlmProvider]] = {"fixture": lambda c: FixtureProvider.open(c.path), "chat": ChatProvider}


def provider(config: Config) -> LlmProvider:
    if config.provider not in PROVIDERS:
        raise LlmError(f"unknown provider: {config.provider}")
    return PROVIDERS[config.provider](config)


def fixture_table(spark: SparkSession, path: str) -> DataFrame:
    """(request_hash, response) of recorded answers; the last one of a hash wins, in the order of the file."""
    rows = spark.read.schema("request_hash string, response string").json(path).withColumn("_seq", F.monotonically_increasing_id())
    return rows.filter("request_hash is not null").groupBy("request_hash").agg(F.max_by("response", "_seq").alias("response"))


def answered(requests: DataFrame, ask: LlmProvider, prompt: Callable[[dict], Request], schema: str = "response string, error string") -> DataFrame:
    """``requests`` with ``response`` and ``error``: each row is asked once, by Arrow batches; an error does not end the job."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got: list[tuple[str | None, str | None]] = []
            for row in batch.to_dict("records"):
                try:
                    got.append((ask.complete(prompt(row)), None))
                except LlmError as e:
                    got.append((None, str(e)))
            yield batch.assign(response=[r for r, _ in got], error=[e for _, e in got])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(run, f"{fields}, {schema}")

