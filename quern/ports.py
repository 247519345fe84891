"""Ports to models, and deterministic stand-ins; no network is used."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np

from quern.errors import ConfigError, EmbeddingMismatch
from quern.functions.embed import Embedder, HashEmbedder
from quern.operators import chunking


@dataclass(frozen=True)
class Capabilities:
    structured: bool = False
    tools: bool = False


class ChatModel(Protocol):
    name: str

    def complete(self, prompt: str) -> str: ...

    def structured(self, prompt: str, schema: dict[str, Any]) -> dict[str, Any]: ...

    def capabilities(self) -> Capabilities: ...


class CannedChat:
    """Answers by prompt, or made from the prompt's hash; never uses tools."""

    name = "canned"

    def __init__(self, answers: dict[str, str] | None = None):
        self.answers = answers or {}

    def complete(self, prompt: str) -> str:
        return self.answers.get(prompt) or "answer " + hashlib.sha256(prompt.encode()).hexdigest()[:12]

    def structured(self, prompt: str, schema: dict[str, Any]) -> dict[str, Any]:
        if prompt in self.answers:
            return json.loads(self.answers[prompt])
        blank = {"string": "", "number": 0.0, "integer": 0, "boolean": False, "array": [], "object": {}}
        return {k: blank.get(v.get("type", "string"), None) for k, v in schema.get("properties", {}).items()}

    def capabilities(self) -> Capabilities:
        return Capabilities(structured=True, tools=False)


class Chunker(Protocol):
    """Cuts a parsed and sanitised version into chunks."""

    def chunk(self, text: str, headings: list[tuple[int, int, str]], page_offsets: list[int]) -> list[chunking.Chunk]: ...


@dataclass(frozen=True)
class StructureChunker:
    """The library's own: by headings, paragraphs and sentences."""

    limits: chunking.Limits = chunking.Limits()

    def chunk(self, text: str, headings: list[tuple[int, int, str]] = (), page_offsets: list[int] = ()) -> list[chunking.Chunk]:
        return chunking.chunk_text(text, headings, page_offsets, self.limits)


class OnnxEmbedder:
    """A local ONNX sentence encoder: the mean of its token vectors, brought to length 1.

    The folder holds ``model.onnx`` and ``tokenizer.json``; both are loaded at the first
    text, on each worker.  A model of another width than said is an error."""

    def __init__(self, folder: str, dimensions: int, most_tokens: int = 512):
        self.folder, self.dimensions, self.most_tokens = folder, dimensions, most_tokens
        self.name = "onnx-" + os.path.basename(folder.rstrip("/"))
        self._loaded: tuple[Any, Any] | None = None

    def __getstate__(self) -> dict[str, Any]:
        return self.__dict__ | {"_loaded": None}  # a session does not travel

    def _load(self) -> tuple[Any, Any]:
        if self._loaded is None:
            paths = [os.path.join(self.folder, n) for n in ("model.onnx", "tokenizer.json")]
            missing = [p for p in paths if not os.path.isfile(p)]
            if missing:
                raise ConfigError(f"no local model: {', '.join(missing)}")
            try:
                import onnxruntime
                import tokenizers
            except ImportError as e:
                raise ConfigError(f"local models need {e.name}") from e
            reader = tokenizers.Tokenizer.from_file(paths[1])
            reader.enable_truncation(self.most_tokens)
            reader.enable_padding()
            self._loaded = onnxruntime.InferenceSession(paths[0], providers=["CPUExecutionProvider"]), reader
        return self._loaded

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        session, reader = self._load()
        read = reader.encode_batch(texts)
        mask = np.array([e.attention_mask for e in read], np.int64)
        given = {"input_ids": np.array([e.ids for e in read], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
        wanted = {i.name for i in session.get_inputs()}
        hidden = np.asarray(session.run(None, {k: v for k, v in given.items() if k in wanted})[0], np.float64)
        mean = (hidden * mask[..., None]).sum(1) / np.maximum(mask.sum(1), 1)[:, None]
        if mean.shape[1] != self.dimensions:
            raise EmbeddingMismatch(f"{self.name} is {mean.shape[1]} wide, not {self.dimensions}")
        size = np.linalg.norm(mean, axis=1, keepdims=True)
        return (mean / np.where(size > 0, size, 1)).astype(np.float32).tolist()


def embedder(model: str, dimensions: int) -> Embedder:
    """The embedder that settings name."""
    if model.startswith("hash-"):
        return HashEmbedder(dimensions)
    if model.startswith("onnx:"):
        return OnnxEmbedder(model.removeprefix("onnx:"), dimensions)
    raise ConfigError(f"no embedder named {model} is installed")
