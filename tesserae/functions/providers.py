"""Model providers: embedding, generation and judging behind one interface.

``Offline`` answers deterministically without a network. ``Http`` talks to any service with the
common chat and embedding endpoints; a failure gives None, never an exception, so that a search
degrades to what does not need a model.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from tesserae.functions import models
from tesserae.functions.tracing import span


class Provider:
    """The interface of a model provider."""

    name = "none"

    def embed(self, texts: list[str], *, is_query: bool = False) -> list[list[float] | None]:
        raise NotImplementedError

    def generate(self, prompt: str, *, max_tokens: int = 256, temperature: float = 0.7) -> str | None:
        raise NotImplementedError

    def judge(self, query: str, body: str) -> bool:
        """Yes or no on a document's first 1000 characters; raises where there is no answer."""
        reply = self.generate(f"Query: {query}\n\nDocument: {body[:1000]}\n\nIs the document relevant to the query? Answer Yes or No.", max_tokens=3, temperature=0.0)
        if not reply:
            raise RuntimeError("no judgement")
        return reply.strip().lower().startswith("yes")

    def model_exists(self, model: str) -> bool:
        return False

    def available(self) -> bool:
        return False

    def close(self) -> None:
        pass


@dataclass
class Offline(Provider):
    dim: int = 64
    name = "offline"

    def embed(self, texts, *, is_query=False):
        return [v.tolist() for v in models.hashing_embedder(self.dim)(list(texts))]

    def generate(self, prompt, *, max_tokens=256, temperature=0.7):
        return None

    def judge(self, query, body):
        return models.lexical_judge(query, body)

    def model_exists(self, model):
        return model == "hashing"

    def available(self):
        return True


@dataclass
class Http(Provider):
    """A service with ``/models``, ``/embeddings`` and ``/chat/completions``. ``query_prefix`` and
    ``document_prefix`` go before texts to embed, for models that want them."""

    base: str
    embedding_model: str = "default"
    chat_model: str = "default"
    key: str = ""
    timeout: float = 30.0
    query_prefix: str = ""
    document_prefix: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    name = "http"

    def _call(self, path: str, body: dict | None = None):
        head = {"Content-Type": "application/json", **self.headers}
        if self.key:
            head["Authorization"] = f"Bearer {self.key}"
        data = None if body is None else json.dumps(body).encode()
        with span(f"provider{path}"):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.base.rstrip("/") + path, data, head), timeout=self.timeout) as reply:  # noqa: S310
                    return json.loads(reply.read())
            except (OSError, ValueError):
                return None

    def embed(self, texts, *, is_query=False):
        prefix = self.query_prefix if is_query else self.document_prefix
        reply = self._call("/embeddings", {"model": self.embedding_model, "input": [prefix + t for t in texts]})
        rows = {d.get("index", i): d.get("embedding") for i, d in enumerate((reply or {}).get("data", []))}
        return [rows.get(i) for i in range(len(texts))]

    def generate(self, prompt, *, max_tokens=256, temperature=0.7):
        reply = self._call("/chat/completions", {"model": self.chat_model, "messages": [{"role": "user", "content": prompt}], "max_tokens": max_tokens, "temperature": temperature})
        try:
            return reply["choices"][0]["message"]["content"]
        except (TypeError, KeyError, IndexError):
            return None

    def model_exists(self, model):
        return any(m.get("id") == model for m in (self._call("/models") or {}).get("data", []))

    def available(self):
        return self._call("/models") is not None


PROVIDERS: dict[str, Callable[..., Provider]] = {"offline": Offline, "http": Http}


def create(kind: str, **options) -> Provider:
    if kind not in PROVIDERS:
        raise ValueError(f"unknown provider {kind!r}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[kind](**options)


def embedder(provider: Provider) -> Callable[[list[str]], np.ndarray]:
    """A provider as the batch function that ``models.embed`` takes. A text that it does not embed
    gets null; the task goes on."""
    return lambda texts: provider.embed([t or "" for t in texts])


def expander(provider: Provider, most: int = 2) -> Callable[[str], list[str]]:
    """The query and up to ``most`` variations that are not the query itself."""

    def run(query: str) -> list[str]:
        prompts = [f"Write {most} other ways to ask for: {query}\nOne a line, without explanations."]
        found = models.expand(query, lambda q: provider.generate(prompts[0]) or "", most)
        return list(dict.fromkeys(found))

    return run


def from_environment(prefix: str = "TESSERAE_") -> Provider:
    """``<prefix>PROVIDER`` and the service's settings; the offline one where none is named."""
    kind = os.environ.get(f"{prefix}PROVIDER", "offline")
    if kind != "http":
        return create(kind)
    return Http(os.environ[f"{prefix}SERVICE"], os.environ.get(f"{prefix}EMBEDDING_MODEL", "default"), os.environ.get(f"{prefix}CHAT_MODEL", "default"), os.environ.get(f"{prefix}KEY", ""))
