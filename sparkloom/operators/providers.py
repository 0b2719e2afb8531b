"""Completion and embedding providers. The defaults are deterministic, offline and native; a remote one is a Python
object used inside an Arrow-batched iterator, with retries around each call."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import first_sentence, hash_embedding, top_terms


class Completion(Protocol):
    def get_completion(self, prompt: str) -> str: ...


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


_completions: dict[str, Callable[..., Completion]] = {}


def register(name: str, make: Callable[..., Completion]) -> None:
    _completions[name] = make


def completion(name: str, **settings) -> Completion:
    if name not in _completions:
        raise ValueError(f"unknown backend {name!r}; registered: {sorted(_completions)}")
    return _completions[name](**settings)


class Echo:
    """Offline: replies with an object that holds the prompt's first words."""

    def __init__(self, words: int = 8):
        self.words = words

    def get_completion(self, prompt: str) -> str:
        return json.dumps({"answer": " ".join(prompt.split()[: self.words])})


def empty_value(kind: str | None):
    """What a field of a JSON schema holds when nothing is known."""
    return {"array": [], "string": "", "object": {}, "number": 0, "boolean": False}.get(kind or "")


def empty_reply(schema: dict | None) -> str:
    """The reply that has every property of a schema, empty; without a schema the empty object."""
    return json.dumps({name: empty_value(p.get("type")) for name, p in ((schema or {}).get("properties") or {}).items()})


SYSTEM = "You must respond with a JSON object."


class HttpCompletion:
    """A chat service over HTTP: request errors are tried again after 2 and 4 seconds, then the empty reply is given."""

    def __init__(self, url: str, model: str, headers: dict[str, str] | None = None, timeout: float = 300, attempts: int = 3, pause: float = 2.0, system: str | None = SYSTEM, temperature: float | None = None, max_tokens: int | None = None, schema: dict | None = None, send: Callable[[str, bytes, dict], bytes] | None = None):
        self.url, self.model, self.headers, self.timeout, self.attempts, self.pause = url, model, headers or {}, timeout, attempts, pause
        self.system, self.schema = system, schema
        self.options = {k: v for k, v in (("temperature", temperature), ("max_tokens", max_tokens)) if v is not None}
        self.send = send or self._post

    def _post(self, url: str, body: bytes, headers: dict) -> bytes:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, body, headers | {"Content-Type": "application/json"}), timeout=self.timeout) as r:
            return r.read()

    def request(self, prompt: str) -> dict:
        before = [{"role": "system", "content": self.system}] if self.system else []
        form = {"response_format": {"type": "json_schema", "json_schema": {"name": "response", "schema": self.schema}}} if self.schema else {}
        return {"model": self.model, "messages": [*before, {"role": "user", "content": prompt}]} | self.options | form

    def reply(self, answer: dict) -> str:
        return answer["choices"][0]["message"]["content"]

    def get_completion(self, prompt: str) -> str:
        body = json.dumps(self.request(prompt)).encode()
        for attempt in range(self.attempts):
            try:
                return self.reply(json.loads(self.send(self.url, body, self.headers)))
            except OSError:
                if attempt + 1 < self.attempts:
                    time.sleep(self.pause * 2**attempt)
        return empty_reply(self.schema)


def openai(model: str = "gpt-4", api_key: str | None = None, base_url: str | None = None, temperature: float = 0.7, max_tokens: int = 1000, **settings) -> HttpCompletion:
    """An OpenAI-compatible service; the key is given or in the environment."""
    key = api_key or os.environ.get("OPENAI_API_KEY")
    if not key:
        raise ValueError("no API key: give one or set OPENAI_API_KEY")
    base = base_url or os.environ.get("OPENAI_API_BASE") or "https://api.openai.com/v1"
    return HttpCompletion(f"{base.rstrip('/')}/chat/completions", model, {"Authorization": f"Bearer {key}"}, temperature=temperature, max_tokens=max_tokens, **settings)


class Ollama(HttpCompletion):
    """A local Ollama service; any error gives the empty reply, the temperature is the model's own."""

    def __init__(self, model: str = "llama2", url: str = "http://localhost:11434/api/chat", **settings):
        super().__init__(url, model, attempts=1, **settings)

    def request(self, prompt: str) -> dict:
        plain = super().request(prompt)
        return {"model": plain["model"], "messages": plain["messages"], "stream": False} | ({"format": self.schema} if self.schema else {})

    def reply(self, answer: dict) -> str:
        return answer["message"]["content"]

    def get_completion(self, prompt: str) -> str:
        try:
            return super().get_completion(prompt)
        except (ValueError, KeyError, TypeError, IndexError):
            return empty_reply(self.schema)


class LocalModel:
    """A text-generation pipeline of a local model (the transformers library, if it is installed)."""

    def __init__(self, model_path: str, max_new_tokens: int = 1000, make: Callable[[str], Callable] | None = None):
        self.max_new_tokens = max_new_tokens
        self.generate = (make or self._make)(model_path)

    @staticmethod
    def _make(path: str) -> Callable:
        try:
            from transformers import pipeline
        except ImportError as e:
            raise ImportError("the local backend needs the transformers library") from e
        return pipeline("text-generation", model=path)

    def get_completion(self, prompt: str) -> str:
        out = self.generate(f"{SYSTEM}\n{prompt}", max_new_tokens=self.max_new_tokens, return_full_text=False)
        return out[0]["generated_text"]


def fetch_models(names: list[str], load: Callable[[str], object] | None = None) -> dict[str, str]:
    """Load models once so that later runs find them locally: name -> "ready", or why not."""
    out = {}
    for name in names:
        try:
            if load is None:
                from sentence_transformers import SentenceTransformer as load  # noqa: N813
            load(name)
            out[name] = "ready"
        except (ImportError, OSError) as e:
            out[name] = f"{type(e).__name__}: {e}"
    return out


register("echo", Echo)
register("http", HttpCompletion)
register("openai", openai)
register("ollama", Ollama)
register("local", LocalModel)


def complete(df: DataFrame, prompt: str, out: str, backend: str, **settings) -> DataFrame:
    """df with a column of replies. A worker makes its provider once and keeps it for the whole partition."""
    if backend not in _completions:
        completion(backend)  # raises
    make = _completions[backend]  # goes to the workers, which don't know what the driver has registered

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make(**settings)
        for prompts in batches:
            yield prompts.map(lambda p: provider.get_completion(p or ""))

    return df.withColumn(out, ask(F.col(prompt)))


def embed(df: DataFrame, text: str, out: str, make: Callable[[], Embedder] | None = None) -> DataFrame:
    """df with a column of vectors; without a provider the native offline embedder, which needs no Python."""
    if make is None:
        return df.withColumn(out, hash_embedding(text))

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in model.encode([t or "" for t in texts])])

    return df.withColumn(out, encode(F.col(text)))


def annotate(text: Column | str, n: int = 3) -> Column:
    """Keywords, context and tags without a model: most frequent terms, the first sentence. Stands in for one; its quality
    isn't comparable."""
    terms = top_terms(text, n)
    return F.struct(terms.alias("keywords"), first_sentence(text).alias("context"), F.slice(terms, 1, 1).alias("tags"))
