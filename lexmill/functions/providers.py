"""Model providers: what embeds texts and answers messages. They run inside Arrow batches, one instance a task.

A provider is chosen from PROVIDERS by name, the first usable of a list. The development provider needs no model; the
HTTP one speaks the common chat-completions form to a local server.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

from lexmill.functions.text import normalized
from lexmill.params import DEFAULT, Params

DIMS = 512
#: How a server is asked to answer.
DEFAULT_TEMPERATURE, DEFAULT_TOKENS = 0.1, 400


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...
    def stream(self, messages: list[dict]) -> Iterator[str]: ...
    def diagnose(self) -> str: ...


def grams(text: str, n: int = 3) -> list[str]:
    return [text] if len(text) < n else [text[k : k + n] for k in range(len(text) - n + 1)]


def bucket(gram: str, dims: int = DIMS) -> int:
    """Fixed rule: the 4-byte BLAKE2b digest as a big-endian number, modulo the number of dimensions."""
    return int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=4).digest(), "big") % dims


class DevProvider:
    """Hashed trigrams of the normalised text as embeddings, an echo as answer: deterministic, for tests and dry runs."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * DIMS
            for g in grams(normalized(text)):
                v[bucket(g)] += 1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    def stream(self, messages: list[dict]) -> Iterator[str]:
        last = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "")
        yield from ("[development answer] ", last)

    def diagnose(self) -> str:
        return "development provider: no model"


class HttpProvider:
    """A local server with /v1/models, /v1/embeddings and /v1/chat/completions.

    base: one address, or several with commas between, of which the first that answers is taken, when it is first needed.
    Models that aren't named are chosen from the server's catalogue then: one whose name tells that it embeds, and the
    first other one to chat; the first of all where there is no such one. A full name or a beginning of one will do.
    """

    def __init__(self, base: str, chat_model: str = "", embed_model: str = "", timeout: float = 60.0):
        self.bases, self.timeout = [x.strip().rstrip("/").removesuffix("/v1") for x in base.split(",") if x.strip()], timeout
        self.chat_model, self.embed_model = chat_model, embed_model
        self._base, self._catalogue = "", None

    @property
    def base(self) -> str:
        """The address that answers; an OSError with all reasons if none does."""
        if not self._base:
            said = []
            for address in self.bases:
                try:
                    with urllib.request.urlopen(f"{address}/v1/models", timeout=min(self.timeout, 2.0)):
                        self._base = address
                        break
                except OSError as e:
                    said.append(f"{address}: {e}")
            else:
                raise OSError("no server: " + "; ".join(said))
        return self._base

    def catalogue(self) -> list[str]:
        """Names of the server's models, asked for once."""
        if self._catalogue is None:
            self._catalogue = [m["id"] for m in self._call("/v1/models")["data"]]
        return self._catalogue

    def model(self, wanted: str, embeds: bool) -> str:
        names = [m for m in self.catalogue() if m.startswith(wanted)] if wanted else [m for m in self.catalogue() if ("embed" in m.lower()) == embeds] or self.catalogue()
        if not names:
            raise ValueError(f"no model {wanted or ('to embed' if embeds else 'to chat')} among {', '.join(self.catalogue()) or 'none'}")
        return wanted if wanted in names else names[0]

    def _call(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"{self.base}{path}", data, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.load(reply)
        except urllib.error.HTTPError as e:
            raise OSError(f"{path}: {e.code} {e.read()[:400].decode(errors='replace')}") from e

    def embed(self, texts: list[str]) -> list[list[float]]:
        rows = self._call("/v1/embeddings", {"model": self.model(self.embed_model, True), "input": texts})["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]

    def stream(self, messages: list[dict]) -> Iterator[str]:
        body = {"model": self.model(self.chat_model, False), "messages": messages, "temperature": DEFAULT_TEMPERATURE, "max_tokens": DEFAULT_TOKENS}
        yield self._call("/v1/chat/completions", body)["choices"][0]["message"]["content"]

    def diagnose(self) -> str:
        return "models: " + ", ".join(self.catalogue())


PROVIDERS: dict[str, Callable[..., Provider]] = {"dev": DevProvider, "http": HttpProvider}


def choose(candidates: Iterable[tuple[str, dict]]) -> Provider:
    """The first of (name, arguments) that says what it is; the reasons of the others are in the error if none does."""
    said = []
    for name, arguments in candidates:
        try:
            provider = PROVIDERS[name](**arguments)
            provider.diagnose()
            return provider
        except (KeyError, OSError, urllib.error.URLError, ValueError) as e:
            said.append(f"{name}: {e}")
    raise RuntimeError("no provider: " + "; ".join(said))


def loops(text: str, p: Params = DEFAULT) -> bool:
    return len(text) >= p.loop_tail and text.count(text[-p.loop_tail :]) >= p.loop_times


def budgeted(pieces: Iterator[str], p: Params = DEFAULT, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic) -> str:
    """A streamed answer up to its budget of characters or time, or until it repeats itself; the stream is closed."""
    began, text = clock(), ""
    try:
        for piece in pieces:
            text += piece
            if len(text) >= p.answer_chars or clock() - began > seconds or loops(text, p):
                break
    finally:
        if hasattr(pieces, "close"):
            pieces.close()
    return text


def ask(provider: Provider, messages: list[dict], p: Params = DEFAULT, keep: int = 120) -> str:
    """One answer; a cancelled stream is tried once more, and a partial answer of ``keep`` characters is kept with a mark."""
    for attempt in (1, 2):
        text = ""

        def taken() -> Iterator[str]:
            nonlocal text
            for piece in provider.stream(messages):
                text += piece
                yield piece

        try:
            return budgeted(taken(), p)
        except (OSError, RuntimeError) as e:
            if len(text) >= keep:
                return f"{text}\n\n[incomplete: {e}]"
            if attempt == 2 or "cancel" not in str(e).lower():
                raise
    raise AssertionError
