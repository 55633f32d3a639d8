"""Embedding providers as iterator pandas UDFs: the provider is opened once per Python worker."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Dimensions of hosted models, request timeouts in seconds and the token window of the local model.
DIMENSIONS = {
    "openai": {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536},
    "voyage": {"voyage-code-3": 1024, "voyage-3": 1024, "voyage-3-lite": 512, "voyage-code-2": 1536},
}
TIMEOUTS = {"ollama": 60, "openai": 30, "voyage": 30}
LOCAL_DIM, LOCAL_WINDOW = 384, 512


class Provider:
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError


class Hash(Provider):
    """Deterministic vectors from SHA-256 of the text: bytes repeated to the dimension, centred, scaled and L2-normalised."""

    def __init__(self, dim: int = LOCAL_DIM):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = np.frombuffer(hashlib.sha256(t.encode("utf-8")).digest(), np.uint8)
            v = (np.resize(raw, self.dim).astype(np.float64) - 128) / 128
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class Local(Provider):
    """An ONNX sentence encoder: truncated and padded to the window, mean pooled over the mask, L2-normalised."""

    def __init__(self, model_dir: str):
        import onnxruntime
        from tokenizers import Tokenizer

        self.dim = LOCAL_DIM
        self.tok = Tokenizer.from_file(os.path.join(model_dir, "tokenizer.json"))
        self.tok.enable_truncation(LOCAL_WINDOW)
        self.tok.enable_padding(length=LOCAL_WINDOW)
        self.run = onnxruntime.InferenceSession(os.path.join(model_dir, "onnx", "model.onnx"))

    def embed(self, texts: list[str]) -> list[list[float]]:
        enc = self.tok.encode_batch(texts)
        ids = np.array([e.ids for e in enc], np.int64)
        mask = np.array([e.attention_mask for e in enc], np.int64)
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        names = {i.name for i in self.run.get_inputs()}
        return pooled(self.run.run(None, {k: v for k, v in feed.items() if k in names})[0], mask).tolist()


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors under the mask, scaled to length one."""
    m = mask[..., None].astype(np.float64)
    mean = (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)


def post(url: str, body: dict, timeout: float, key: str | None = None) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as r:
        return json.loads(r.read())


class Hosted(Provider):
    """A hosted API that takes a list of inputs and returns data[].embedding."""

    def __init__(self, kind: str, url: str, model: str, key: str, send: Callable = post):
        if not key:
            raise ValueError(f"an API key is needed for {kind}")
        self.kind, self.url, self.model, self.key, self.send = kind, url, model, key, send
        self.dim = DIMENSIONS[kind][model]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for i in range(0, len(texts), REQUEST):
            got = self.send(self.url, {"model": self.model, "input": texts[i : i + REQUEST]}, TIMEOUTS[self.kind], self.key)
            out += [d["embedding"] for d in got["data"]]
        return out


class Ollama(Provider):
    """A local server: the current endpoint first, the older one if that is missing; the one that works is remembered."""

    def __init__(self, url: str, model: str, send: Callable = post):
        self.url, self.model, self.send, self.old = url.rstrip("/"), model, send, None

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for i in range(0, len(texts), REQUEST):
            out += self.some(texts[i : i + REQUEST])
        return out

    def some(self, texts: list[str]) -> list[list[float]]:
        if self.old is not True:
            try:
                got = self.send(f"{self.url}/api/embed", {"model": self.model, "input": texts}, TIMEOUTS["ollama"])["embeddings"]
                self.old = False
                return got
            except (urllib.error.HTTPError, KeyError):
                if self.old is False:
                    raise
        got = [self.send(f"{self.url}/api/embeddings", {"model": self.model, "prompt": t}, TIMEOUTS["ollama"])["embedding"] for t in texts]
        self.old = True
        return got

    @property
    def dim(self) -> int:
        return len(self.embed(["dimension"])[0])


@dataclass(frozen=True)
class Spec:
    """What a worker needs to open a provider."""

    kind: str = "hash"
    dim: int = LOCAL_DIM
    model: str = ""
    url: str = ""
    key: str = ""


def open_provider(spec: Spec) -> Provider:
    if spec.kind == "hash":
        return Hash(spec.dim)
    if spec.kind == "onnx":
        return Local(spec.model)
    if spec.kind == "ollama":
        return Ollama(spec.url, spec.model)
    if spec.kind in DIMENSIONS:
        return Hosted(spec.kind, spec.url, spec.model, spec.key)
    raise ValueError(f"unknown embedding provider {spec.kind!r}")


REQUEST = 128  # texts of one request to a server
_open: dict[Spec, Provider] = {}
_failed: dict[Spec, Exception] = {}


def provider(spec: Spec) -> Provider:
    """The provider of this process. One that could not be opened (a model that does not load) is not tried again until `reset`."""
    if spec in _failed:
        raise _failed[spec]
    if spec not in _open:
        try:
            _open[spec] = open_provider(spec)
        except Exception as e:
            _failed[spec] = e
            raise
    return _open[spec]


def reset() -> None:
    _open.clear()
    _failed.clear()


def embed(text: Column, spec: Spec = Spec()) -> Column:
    """The vector of each text (ARRAY<FLOAT>); NULL for NULL."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = provider(spec)
        for s in batches:
            known = s.notna()
            got = iter(p.embed(s[known].tolist()))
            yield pd.Series([next(got) if k else None for k in known], dtype=object)

    return run(text)
