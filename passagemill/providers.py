"""What calls out of Spark: embedders, language models and token counters.

A provider is a picklable object; it is sent to the Python workers once per task, loads what is
heavy on first use, and is called with whole batches.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import EmbeddingError, ModelError
from .functions.text import TOKENS_PER_WORD
from .schema import REPLIES


class Embedder(Protocol):
    """Texts to vectors."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """A row per text; an empty matrix for no texts."""
        ...


def embed_one(embedder: Embedder, text: str) -> np.ndarray:
    return embedder.embed([text])[0]


@dataclass
class HashEmbedder:
    """Word counts in ``dim`` hashed places: deterministic, needs no model."""

    dim: int = 384

    def embed(self, texts: list[str]) -> np.ndarray:
        from hashlib import md5

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                out[i, int(md5(word.encode()).hexdigest()[:8], 16) % self.dim] += 1
        return out


@dataclass
class SentenceTransformerEmbedder:
    """A sentence-transformers model, where that library is installed; loaded on first use."""

    model: str = "all-MiniLM-L6-v2"
    device: str | None = None
    batch: int = 32
    dim: int = 384
    _loaded: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dim), np.float32)
        try:
            if self._loaded is None:
                from sentence_transformers import SentenceTransformer

                self._loaded = SentenceTransformer(self.model, device=self.device)
                self.dim = self._loaded.get_sentence_embedding_dimension()
            return np.asarray(self._loaded.encode(texts, batch_size=self.batch, show_progress_bar=False), np.float32)
        except Exception as e:
            raise EmbeddingError(f"embedding failed: {e}", self.model) from e


def embed(embedder: Embedder, texts: Column) -> Column:
    """Vectors of an array of texts; a batch of rows is one call."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            lists = [[] if r is None else list(r) for r in rows]
            flat = [t for r in lists for t in r]
            vectors = embedder.embed(flat).astype(np.float32).tolist() if flat else []
            out, at = [], 0
            for r in lists:
                out.append(vectors[at : at + len(r)])
                at += len(r)
            yield pd.Series(out)

    # Iterator of series in, iterator of series out: the model is loaded once per task.
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<array<float>>").asNondeterministic()(texts)


@dataclass
class Reply:
    content: str
    tokens_used: int = 0
    model: str = ""
    success: bool = True
    error: str | None = None


class ChatModel(Protocol):
    """A language model that completes prompts."""

    name: str

    def complete(self, prompt: str, system: str = "") -> Reply: ...


def complete_json(model: ChatModel, prompt: str, system: str = "") -> dict:
    """The model's reply as a JSON object; a fence around it is taken off."""
    reply = model.complete(prompt, system)
    if not reply.success:
        raise ModelError(f"model call failed: {reply.error}")
    text = reply.content.strip()
    if text.startswith("```"):
        text = text.split("```")[1]
        text = text.split("\n", 1)[1] if "\n" in text else text
    try:
        return json.loads(text)
    except ValueError as e:
        raise ModelError(f"reply is not JSON: {text[:500]}") from e


@dataclass
class HttpChatModel:
    """A chat-completions endpoint over HTTP. Never raises: a failure is a reply that says so."""

    name: str = "gpt-4o"
    api_key: str = field(default="", repr=False)
    base_url: str = "https://api.openai.com/v1"
    temperature: float = 0.1
    max_tokens: int = 1000
    timeout: float = 60.0

    def complete(self, prompt: str, system: str = "") -> Reply:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        body = {"model": self.name, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens}
        request = urllib.request.Request(
            f"{self.base_url.rstrip('/')}/chat/completions",
            json.dumps(body).encode(),
            {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"},
        )
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as response:
                data = json.load(response)
            return Reply(data["choices"][0]["message"]["content"] or "", int(data.get("usage", {}).get("total_tokens", 0)), self.name)
        except (OSError, ValueError, KeyError, IndexError, TypeError, urllib.error.URLError) as e:
            return Reply("", 0, self.name, False, str(e))


@dataclass
class FixedModel:
    """Always the same reply; for tests and dry runs."""

    content: str = '{"verdict": "KEEP", "reason": "", "confidence": 0.9}'
    name: str = "fixed"
    fails: bool = False

    def complete(self, prompt: str, system: str = "") -> Reply:
        return Reply("", 0, self.name, False, "told to fail") if self.fails else Reply(self.content, len(prompt.split()), self.name)


@dataclass
class FunctionModel:
    """A model made of a function from prompt to reply text."""

    function: Callable[[str], str]
    name: str = "function"

    def complete(self, prompt: str, system: str = "") -> Reply:
        try:
            return Reply(self.function(prompt), len(prompt.split()), self.name)
        except Exception as e:
            return Reply("", 0, self.name, False, str(e))


@dataclass
class Retry:
    """``attempts`` calls in all (none at all for 0), with delays that double up to ``most`` seconds."""

    attempts: int = 2
    delay: float = 1.0
    most: float = 30.0
    sleep: Callable[[float], None] = time.sleep

    def wait(self, tried: int) -> float:
        return min(self.delay * 2**tried, self.most)

    def run(self, call: Callable, *args, on_retry: Callable[[int, Exception], None] | None = None):
        error: Exception = ModelError("no attempt allowed")
        for tried in range(self.attempts):
            try:
                return call(*args)
            except Exception as e:
                error = e
                if tried + 1 < self.attempts:
                    if on_retry:
                        on_retry(tried + 1, e)
                    self.sleep(self.wait(tried))
        raise error

    def decorate(self, call: Callable) -> Callable:
        return lambda *args: self.run(call, *args)

    async def run_async(self, call: Callable, *args):
        import asyncio

        error: Exception = ModelError("no attempt allowed")
        for tried in range(self.attempts):
            try:
                return await call(*args)
            except Exception as e:
                error = e
                if tried + 1 < self.attempts:
                    await asyncio.sleep(self.wait(tried))
        raise error


def ask(model: ChatModel, prompts: Column, system: str = "", retry: Retry | None = None, threads: int = 4) -> Column:
    """Replies to an array of prompts, in order: (content, tokens_used, success, error).

    All prompts of a batch of rows go through a bounded pool of threads per task, whichever rows they
    are of. Calls are marked nondeterministic; write
    what comes out before it is read twice, or the model is asked twice. A failure is a reply.
    """
    retry = retry or Retry(1)

    def one(prompt: str) -> dict:
        def call() -> Reply:
            reply = model.complete(prompt, system)
            if not reply.success:
                raise ModelError(reply.error or "model call failed")
            return reply

        try:
            reply = retry.run(call)
            return {"content": reply.content, "tokens_used": reply.tokens_used, "success": True, "error": None}
        except Exception as e:
            return {"content": "", "tokens_used": 0, "success": False, "error": str(e)}

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(threads) as pool:
            for rows in batches:
                lists = [[] if r is None else list(r) for r in rows]
                made = pool.map(one, [p for r in lists for p in r])
                yield pd.Series([[next(made) for _ in r] for r in lists])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, REPLIES).asNondeterministic()(prompts)


class TokenCounter(Protocol):
    """Texts to numbers of tokens."""

    def count(self, text: str) -> int: ...


# How the public encodings cut a text before merging.
PATTERNS = {
    "r50k_base": r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "cl100k_base": r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s",
}
DEFAULT_ENCODING = "cl100k_base"


def encoding_of(model: str) -> str:
    """The name of a model's public encoding; that of a model nobody knows is DEFAULT_ENCODING."""
    try:
        import tiktoken

        return tiktoken.encoding_name_for_model(model)
    except (ImportError, KeyError):
        return DEFAULT_ENCODING


@dataclass
class BpeCounter:
    """Tokens by a byte-pair vocabulary file of ranks (base64 token, rank), as tiktoken reads it.

    Where the file or the library is missing, or fails, words times 1.3 stand in.
    """

    path: str
    pattern: str = PATTERNS["r50k_base"]
    _loaded: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def count(self, text: str) -> int:
        if not text:
            return 0
        try:
            if self._loaded is None:
                self._loaded = self._load()
            return len(self._loaded.encode_ordinary(text))
        except Exception:
            return int(len(text.split()) * TOKENS_PER_WORD)

    def truncate(self, text: str, tokens: int) -> str:
        """The text of the first so many tokens; by words, 1.3 tokens each, where they can't be had."""
        if not text:
            return ""
        try:
            if self._loaded is None:
                self._loaded = self._load()
            found = self._loaded.encode_ordinary(text)
            return text if len(found) <= tokens else self._loaded.decode(found[:tokens])
        except Exception:
            return " ".join(text.split()[: int(tokens / TOKENS_PER_WORD)])

    @classmethod
    def for_model(cls, model: str, folder: str) -> BpeCounter:
        """The counter of a model's encoding, whose file ``<encoding>.tiktoken`` is in a folder that all machines see."""
        name = encoding_of(model)
        return cls(f"{folder.rstrip('/')}/{name}.tiktoken", PATTERNS.get(name, PATTERNS[DEFAULT_ENCODING]))

    def _load(self):
        import base64

        import tiktoken

        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("file", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})


def truncate_tokens(counter: BpeCounter, text: Column, tokens: int) -> Column:
    """A column of texts, each cut to so many tokens."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda t: None if t is None else counter.truncate(t, tokens))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string").asNondeterministic()(text)


def count_tokens(counter: TokenCounter, texts: Column) -> Column:
    """Tokens of each text of an array, by a counter that is loaded once per task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda ts: [] if ts is None else [counter.count(t or "") for t in ts])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>").asNondeterministic()(texts)
