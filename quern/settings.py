"""Settings: sections with tiers, profiles, transitions.

FREE settings change at will; a changed GATED one asks for a named rebuild; a
changed LOCKED one is refused, as it needs a command that destroys an index.
"""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from quern.errors import ConfigError

FREE, GATED, LOCKED = "free", "gated", "locked"
FILE = "quern.toml"


def knob(default: Any, tier: str, rebuild: str = "") -> Any:
    return field(default=default, metadata={"tier": tier, "rebuild": rebuild})


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = knob(512, GATED, "chunks")
    overlap: int = knob(64, GATED, "chunks")
    structure_first: bool = knob(True, GATED, "chunks")
    contextual_headers: bool = knob(False, GATED, "headers")
    tokenizer: str = knob("estimate", LOCKED)

    def __post_init__(self) -> None:
        _need(64 <= self.max_tokens <= 8192, "chunking.max_tokens must be 64 to 8192")
        _need(0 <= self.overlap < self.max_tokens, "chunking.overlap must be below max_tokens")


@dataclass(frozen=True)
class Embeddings:
    model: str = knob("hash-64", LOCKED)
    dimensions: int = knob(64, LOCKED)
    batch_size: int = knob(64, FREE)

    def __post_init__(self) -> None:
        _need(self.dimensions > 0 and self.batch_size > 0, "embeddings: dimensions and batch_size must be positive")


@dataclass(frozen=True)
class Retrieval:
    dense_k: int = knob(50, FREE)
    sparse_k: int = knob(50, FREE)
    rrf_k: int = knob(60, FREE)
    fuse_to: int = knob(30, FREE)
    rerank_to: int = knob(8, FREE)

    def __post_init__(self) -> None:
        _need(min(self.dense_k, self.sparse_k, self.rrf_k, self.fuse_to, self.rerank_to) >= 1, "retrieval: every number must be 1 at least")
        _need(self.rerank_to <= self.fuse_to <= self.dense_k + self.sparse_k, "retrieval: rerank_to <= fuse_to <= dense_k + sparse_k must hold")


@dataclass(frozen=True)
class Resolution:
    trigram: float = knob(0.85, GATED, "entities")
    band_low: float = knob(0.80, GATED, "entities")
    band_high: float = knob(0.92, GATED, "entities")
    auto_merge: bool = knob(False, GATED, "entities")

    def __post_init__(self) -> None:
        _need(0 <= self.band_low <= self.trigram <= self.band_high <= 1, "resolution: trigram must lie in the band")


@dataclass(frozen=True)
class Budget:
    max_docs_per_run: int = knob(1000, FREE)
    max_cost_usd_per_run: float = knob(5.0, FREE)


@dataclass(frozen=True)
class Profile:
    name: str = knob("default", GATED, "assertions")
    entity_types: tuple[str, ...] = knob(("person", "organisation", "place", "project", "document", "event", "role", "asset", "topic", "budget"), GATED, "entities")
    predicates: tuple[str, ...] = knob(("owns", "member_of", "located_in", "status", "amount", "deadline", "decided", "depends_on", "condition", "mentions"), GATED, "assertions")
    doc_types: tuple[str, ...] = knob(("minutes", "policy", "briefing", "report", "register", "email"), GATED, "metadata")
    stale_days: int = knob(180, FREE)


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = Chunking()
    embeddings: Embeddings = Embeddings()
    retrieval: Retrieval = Retrieval()
    resolution: Resolution = Resolution()
    budget: Budget = Budget()
    profile: Profile = Profile()

    @staticmethod
    def of(data: dict[str, Any]) -> Settings:
        """Settings from nested tables; an unknown name is an error."""
        made = {}
        sections = {f.name: f for f in fields(Settings)}
        for name, values in data.items():
            if name not in sections:
                raise ConfigError(f"unknown section {name}")
            kind = type(sections[name].default)
            known = {f.name for f in fields(kind)}
            if not isinstance(values, dict) or (extra := sorted(set(values) - known)):
                raise ConfigError(f"unknown in {name}: {', '.join(extra) if isinstance(values, dict) else values!r}")
            made[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
        return Settings(**made)


def merged(low: dict[str, Any], high: dict[str, Any]) -> dict[str, Any]:
    """Nested tables; the second wins."""
    out = dict(low)
    for k, v in high.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def discover(start: str) -> Path | None:
    """The settings file of a folder or of the nearest one above."""
    at = Path(start).resolve()
    return next((p / FILE for p in (at, *at.parents) if (p / FILE).is_file()), None)


def load(path: str | None = None, overlay: dict[str, Any] | None = None) -> Settings:
    data: dict[str, Any] = {}
    if path:
        try:
            data = tomllib.loads(Path(path).read_text())
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ConfigError(f"{path}: {e}") from e
    return Settings.of(merged(data, overlay or {}))


def tier_table() -> list[tuple[str, str, Any]]:
    """(name, tier, default) of every setting."""
    return [(f"{s.name}.{f.name}", f.metadata["tier"], f.default) for s in fields(Settings) for f in fields(type(s.default))]


def check_transition(old: Settings, new: Settings) -> list[str]:
    """The rebuilds that a change asks for; a changed LOCKED setting is an error."""
    rebuilds: set[str] = set()
    for s in fields(Settings):
        a, b = getattr(old, s.name), getattr(new, s.name)
        for f in fields(type(a)):
            if getattr(a, f.name) != getattr(b, f.name):
                if f.metadata["tier"] == LOCKED:
                    raise ConfigError(f"{s.name}.{f.name} is locked; rebuild the index to change it")
                if f.metadata["tier"] == GATED:
                    rebuilds.add(f.metadata["rebuild"])
    return sorted(rebuilds)


def stamp(settings: Settings) -> dict[str, Any]:
    """What is stored beside the tables, to report drift."""
    return dataclasses.asdict(settings)
