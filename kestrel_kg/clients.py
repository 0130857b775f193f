"""Language-model and embedding clients: protocols, deterministic doubles, an HTTP client for each task, a judge."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TextModel(Protocol):
    def complete(self, prompt: str, schema: str | None = None) -> str: ...


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class RuleModel:
    """Answers by exact prompt, then by a part of the prompt, then by the schema's name."""

    answers: dict[str, object] = field(default_factory=dict)

    def complete(self, prompt: str, schema: str | None = None) -> str:
        for test in (lambda k: k == prompt, lambda k: k in prompt, lambda k: k == schema):
            for key, value in self.answers.items():
                if test(key):
                    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        raise KeyError(f"no answer for the prompt {prompt[:80]!r}")


@dataclass
class HashEmbedder:
    """Known vectors by text, by the longest key inside a text, else bytes of its SHA-256."""

    known: dict[str, list[float]] = field(default_factory=dict)
    dimensions: int = 3
    unit: bool = False

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        keys = {k.casefold(): v for k, v in self.known.items()}
        found = keys.get(text.casefold())
        if found is None:
            inside = [k for k in keys if k in text.casefold()]
            found = keys[max(inside, key=len)] if inside else [b / 255 for b in hashlib.sha256(text.encode()).digest()[: self.dimensions]]
        length = sum(x * x for x in found) ** 0.5
        return [x / length for x in found] if self.unit and length else list(found)


@dataclass
class HttpModel:
    """A chat or embedding endpoint with retries and a least interval between requests; it is made anew in each task."""

    url: str
    model: str
    key: str | None = None
    timeout: float = 60
    retries: int = 2
    interval: float = 0.0
    single: bool = False
    temperature: float = 0.0
    _last: float = 0.0

    def __repr__(self) -> str:
        return f"HttpModel(url={self.url!r}, model={self.model!r}, key={'***' if self.key else None})"

    def post(self, body: dict) -> dict:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {}))
        for attempt in range(self.retries + 1):
            time.sleep(max(0.0, self._last + self.interval - time.monotonic()))
            self._last = time.monotonic()
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(0.5 * 2**attempt)
        raise AssertionError

    def complete(self, prompt: str, schema: str | None = None) -> str:
        found = self.post({"model": self.model, "stream": False, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}]})
        return found["choices"][0]["message"]["content"] if "choices" in found else found["message"]["content"]

    def encode(self, texts: list[str]) -> list[list[float]]:
        """Vectors of a batch (``data`` with indexes, or ``embeddings``); an endpoint that takes one text a request answers with ``embedding``."""
        if self.single:
            found = [self.post({"model": self.model, "prompt": t})["embedding"] for t in texts]
        else:
            reply = self.post({"model": self.model, "input": texts})
            found = reply["embeddings"] if "embeddings" in reply else [r["embedding"] for r in sorted(reply["data"], key=lambda r: r["index"])]
        if len(found) != len(texts):
            raise ValueError("as many vectors as texts are due")
        return [[float(x) for x in v] for v in found]


def complete_all(requests: DataFrame, make: Callable[[], TextModel], schema: str | None = None, at_once: int | None = None) -> DataFrame:
    """key, payload for requests (key, prompt); ``at_once`` limits the tasks that ask at the same time."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "payload": [client.complete(p, schema) for p in frame["prompt"]]})

    rows = requests.select("key", "prompt")
    return (rows.coalesce(at_once) if at_once else rows).mapInPandas(ask, "key string, payload string")


def embed_all(texts: DataFrame, make: Callable[[], Embedder], batch: int = 64) -> DataFrame:
    """doc, embedding for texts (doc, text)."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                yield pd.DataFrame({"doc": part["doc"], "embedding": client.encode(part["text"].tolist())})

    return texts.select("doc", "text").mapInPandas(ask, "doc string, embedding array<double>")


def loose_json(text: str) -> dict:
    """An object from an answer that may fence it or wrap it in words; else an empty one."""
    bare = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text)
    for candidate in (bare, *re.findall(r"(?s)\{.*\}", bare)[:1]):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return {}


def judge_score(answer: str, name: str) -> tuple[float, str]:
    """A judge's score within 0 and 1, and its comment."""
    found = loose_json(answer)
    try:
        value = float(found.get(name, found.get("score", 0.0)))
    except (TypeError, ValueError):
        value = 0.0
    return min(max(value, 0.0), 1.0), str(found.get("comment", ""))


def judge_prompt(name: str, question: str, context: str, answer: str) -> str:
    asks = {"faithfulness": "How far do the context's facts support the answer?", "context_precision": "How much of the context does the question need?"}
    return f'{asks[name]}\nReturn JSON {{"{name}": 0..1, "comment": "..."}}.\nQuestion: {question}\nContext:\n{context}\nAnswer: {answer}'


def judge_all(rows: DataFrame, make: Callable[[], TextModel], name: str) -> DataFrame:
    """query, score, comment for rows (query, question, context, answer)."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for frame in frames:
            found = [judge_score(client.complete(judge_prompt(name, *r), name), name) for r in zip(frame["question"], frame["context"], frame["answer"], strict=True)]
            yield pd.DataFrame({"query": frame["query"], "score": [s for s, _ in found], "comment": [c for _, c in found]})

    return rows.select(F.col("query").cast("string").alias("query"), "question", "context", "answer").mapInPandas(ask, "query string, score double, comment string")
