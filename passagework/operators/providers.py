"""What embeds texts and writes answers: the interface, the offline one, a registry, retries, and settings."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np

from ..functions import plain
from ..functions.vectors import embedded
from . import answer as A


class Provider(Protocol):
    """Embeds texts and writes answers; passages below the threshold are not shown to it."""

    relevance_threshold: float
    embedding_model: str
    chat_model: str

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...

    def generate(self, question: str, sources: list[A.Source], mode: str) -> A.Answer: ...


class Offline:
    """Hashed embeddings, and answers made of the sources' own sentences; needs no network."""

    relevance_threshold = 0.05
    embedding_model = "hashed-512"
    chat_model = "extractive"

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        return embedded([plain.tokenize(t) for t in texts])

    def generate(self, question: str, sources: list[A.Source], mode: str) -> A.Answer:
        return A.overview(sources) if mode == "overview" else A.answer(question, sources)


class Chat:
    """A model behind a function that takes messages and returns the reply's text, with the offline embeddings. A reply that is no answer is asked for once more, with the reason."""

    relevance_threshold = Offline.relevance_threshold
    embedding_model = Offline.embedding_model

    def __init__(self, send: Callable[[list[dict[str, str]]], str], model: str) -> None:
        self.send, self.chat_model = send, model

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        return Offline().embed(texts)

    def generate(self, question: str, sources: list[A.Source], mode: str) -> A.Answer:
        asked = A.messages(question, sources, mode)
        reply = self.send(asked)
        try:
            return A.replied(reply)
        except ValueError as problem:
            again = [{"role": "assistant", "content": reply}, {"role": "user", "content": f"This could not be read: {problem}. Send the JSON object alone."}]
            return A.replied(self.send([*asked, *again]))


class Mixed:
    """One provider's embeddings with another one's answers."""

    def __init__(self, embeds: Provider, writes: Provider) -> None:
        self.embeds, self.writes = embeds, writes
        self.relevance_threshold, self.embedding_model, self.chat_model = embeds.relevance_threshold, embeds.embedding_model, writes.chat_model

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        return self.embeds.embed(texts)

    def generate(self, question: str, sources: list[A.Source], mode: str) -> A.Answer:
        return self.writes.generate(question, sources, mode)


PROVIDERS: dict[str, Callable[[], Provider]] = {"offline": Offline}


def provider(name: str = "offline", embeddings: str | None = None) -> Provider:
    """A registered provider, or one that writes with `name` and embeds with `embeddings`."""
    for wanted in (name, embeddings or name):
        if wanted not in PROVIDERS:
            raise ValueError(f"no provider is called {wanted}")
    writes = PROVIDERS[name]()
    return writes if embeddings in (None, name) else Mixed(PROVIDERS[embeddings](), writes)


class Transient(Exception):
    """A failure that may pass: too many requests, a server's error, a lost connection."""


def with_retry(of: Callable[[], object], attempts: int = 3, delay: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> object:
    """What `of` returns, tried again after Transient failures, each time after twice the delay; other failures are raised at once."""
    for turn in range(attempts):
        try:
            return of()
        except Transient:
            if turn + 1 == attempts:
                raise
            sleep(delay * 2**turn)
    raise ValueError("attempts must be at least 1")


@dataclass(frozen=True)
class Settings:
    """What a deployment sets; an empty value counts as none."""

    provider: str = "offline"
    embeddings: str | None = None
    max_upload_mb: int = 10
    store: str = "store"

    @classmethod
    def read(cls, values: Mapping[str, str | None]) -> Settings:
        given = {k.lower(): v.strip() for k, v in values.items() if v is not None and v.strip()}
        size = int(given.get("max_upload_mb", cls.max_upload_mb))
        if size < 1:
            raise ValueError("MAX_UPLOAD_MB must be at least 1")
        return cls(given.get("provider", cls.provider), given.get("embeddings"), size, given.get("store", cls.store))
