"""Settings of models, embeddings and graph stores from the environment and an .env file."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from . import clients
from .sources import files

#: Chat endpoints by the prefix of their variables, with their usual address and model.
CHATS = {"GEMMA": ("http://localhost:11434", "gemma4:latest"), "OPENAI": ("https://api.openai.com/v1", "gpt-4o-mini"), "DEEPSEEK": ("https://api.deepseek.com", "deepseek-chat")}
#: Embedding models by provider.
EMBEDDINGS = {"demo": "", "ollama": "mxbai-embed-large", "openai": "text-embedding-3-small"}


@dataclass(frozen=True)
class ChatSettings:
    model: str
    base_url: str
    api_key: str = field(default="", repr=False)
    max_retries: int = 2
    interval: float = 0.5
    temperature: float = 0.0
    timeout: float = 600.0

    def client(self) -> clients.HttpModel:
        """Endpoints with a key take ``/chat/completions``, local ones ``/api/chat``."""
        path = "/chat/completions" if self.api_key else "/api/chat"
        return clients.HttpModel(self.base_url + path, self.model, self.api_key or None, self.timeout, self.max_retries, self.interval, temperature=self.temperature)


@dataclass(frozen=True)
class EmbeddingSettings:
    provider: str
    model: str
    base_url: str
    api_key: str = field(default="", repr=False)
    timeout: float = 120.0

    def client(self) -> clients.Embedder:
        if self.provider == "demo":
            return clients.HashEmbedder()
        single = self.provider == "ollama"
        return clients.HttpModel(self.base_url + ("/api/embeddings" if single else "/embeddings"), self.model, self.api_key or None, self.timeout, single=single)


@dataclass(frozen=True)
class StoreSettings:
    uri: str
    user: str
    password: str = field(repr=False)
    database: str | None = None


def number(environ: dict[str, str], name: str, usual: float) -> float:
    value = environ.get(name, "").strip()
    try:
        return float(value) if value else usual
    except ValueError:
        raise ValueError(f"{name} must be a number") from None


def read(path: str | None, environ: dict[str, str] | None) -> dict[str, str]:
    environ = dict(os.environ) if environ is None else environ
    if path:
        files.load_dotenv(path, environ=environ)
    return environ


def chat(prefix: str, path: str | None = ".env", environ: dict[str, str] | None = None) -> ChatSettings:
    """The settings of one of ``CHATS``; one that isn't local needs a key."""
    env = read(path, environ)
    url, model = CHATS[prefix]
    get = lambda name, usual="": env.get(f"{prefix}_{name}", "").strip() or usual
    key = get("API_KEY")
    if prefix != "GEMMA" and not key:
        raise ValueError(f"{prefix}_API_KEY is not set")
    return ChatSettings(
        get("MODEL", model), get("BASE_URL", url).rstrip("/"), key, int(number(env, f"{prefix}_MAX_RETRIES", 2)), number(env, f"{prefix}_MIN_REQUEST_INTERVAL_SECONDS", 0.5),
        number(env, f"{prefix}_TEMPERATURE", 0.0), number(env, f"{prefix}_REQUEST_TIMEOUT_SECONDS", 600.0),
    )


def embedding(path: str | None = ".env", environ: dict[str, str] | None = None) -> EmbeddingSettings:
    env = read(path, environ)
    provider = env.get("EMBEDDING_PROVIDER", "").strip().casefold() or "demo"
    if provider not in EMBEDDINGS:
        raise ValueError(f"unknown embedding provider {provider}")
    url = CHATS["GEMMA"][0] if provider == "ollama" else env.get("OPENAI_BASE_URL", CHATS["OPENAI"][0])
    return EmbeddingSettings(
        provider, env.get("EMBEDDING_MODEL", "").strip() or EMBEDDINGS[provider], (env.get("EMBEDDING_BASE_URL", "").strip() or url).rstrip("/"),
        env.get("EMBEDDING_API_KEY", env.get("OPENAI_API_KEY", "")).strip(), number(env, "EMBEDDING_REQUEST_TIMEOUT_SECONDS", 120.0),
    )


def store(path: str | None = ".env", environ: dict[str, str] | None = None) -> StoreSettings:
    env = read(path, environ)
    get = lambda name, usual: env.get(f"NEO4J_{name}", usual).strip()
    return StoreSettings(get("URI", "bolt://localhost:7687"), get("USER", "neo4j"), get("PASSWORD", ""), get("DATABASE", "neo4j") or None)
