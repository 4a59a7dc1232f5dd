"""Settings of a chunking run: a frozen value on the driver, sent to tasks by closure."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

from .errors import ConfigError

#: Where nested sections of a settings file keep which field.
SECTIONS = {
    "chunking": {"similarity_threshold": "similarity_threshold", "min_tokens": "min_chunk_tokens", "max_tokens": "max_chunk_tokens",
                 "atomize_sentences_per_paragraph": "atomize_sentences_per_paragraph", "atomize_min_sentences": "atomize_min_sentences",
                 "granularity_planning_enabled": "granularity_planning_enabled", "granularity_max_paragraphs": "granularity_max_paragraphs",
                 "granularity_max_chars_per_paragraph": "granularity_max_chars_per_paragraph"},
    "behavior": {"retry_attempts": "retry_attempts", "fallback_enabled": "fallback_enabled", "continue_on_error": "continue_on_error", "verbose": "verbose"},
    "embedding": {"model": "embedding_model", "device": "embedding_device"},
    "llm": {"model": "llm_model", "temperature": "llm_temperature"},
}


@dataclass(frozen=True)
class Config:
    similarity_threshold: float = 0.5
    min_chunk_tokens: int = 50
    max_chunk_tokens: int = 500
    #: Attempts in all, the first included.
    retry_attempts: int = 2
    retry_delay: float = 1.0
    fallback_enabled: bool = True
    continue_on_error: bool = False
    verbose: bool = False
    short_document_threshold: int = 5
    embedding_model: str = "all-MiniLM-L6-v2"
    embedding_device: str | None = None
    token_model: str = "gpt-4"
    llm_model: str = "gpt-4o"
    llm_temperature: float = 0.1
    llm_max_tokens: int = 1000
    atomize_sentences_per_paragraph: int = 2
    atomize_min_sentences: int = 6
    granularity_planning_enabled: bool = True
    granularity_max_paragraphs: int = 60
    granularity_max_chars_per_paragraph: int = 280

    def __post_init__(self) -> None:
        checks = [
            ("similarity_threshold", 0.0 <= self.similarity_threshold <= 1.0, "must lie between 0 and 1"),
            ("min_chunk_tokens", self.min_chunk_tokens >= 0, "must not be negative"),
            ("max_chunk_tokens", self.max_chunk_tokens >= self.min_chunk_tokens, "must be at least min_chunk_tokens"),
            ("retry_attempts", self.retry_attempts >= 0, "must not be negative"),
            ("short_document_threshold", self.short_document_threshold >= 1, "must be at least 1"),
            ("atomize_sentences_per_paragraph", self.atomize_sentences_per_paragraph >= 0, "must not be negative"),
            ("atomize_min_sentences", self.atomize_min_sentences >= 0, "must not be negative"),
            ("granularity_max_paragraphs", self.granularity_max_paragraphs >= 1, "must be at least 1"),
            ("granularity_max_chars_per_paragraph", self.granularity_max_chars_per_paragraph >= 1, "must be at least 1"),
        ]
        for key, fine, rule in checks:
            if not fine:
                raise ConfigError(f"{key} {rule}, not {getattr(self, key)}", key)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Config:
        """Flat keys fill what no section sets; a section present sets all of its fields, by default if need be."""
        known = {f.name: f.default for f in fields(cls)}
        out: dict[str, Any] = {}
        for section, keys in SECTIONS.items():
            if section in data:
                given = data[section] or {}
                out |= {field: given.get(key, known[field]) for key, field in keys.items()}
        out |= {k: v for k, v in data.items() if k in known and k not in out}
        return cls(**out)

    @classmethod
    def from_yaml(cls, path: str | Path) -> Config:
        """Settings of a YAML file; ``${NAME}`` as a whole value is the environment's, or empty."""
        import yaml

        try:
            data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        except (OSError, yaml.YAMLError) as e:
            raise ConfigError(f"cannot read settings from {path}: {e}") from e

        def resolve(x: Any) -> Any:
            if isinstance(x, dict):
                return {k: resolve(v) for k, v in x.items()}
            if isinstance(x, list):
                return [resolve(v) for v in x]
            if isinstance(x, str) and x.startswith("${") and x.endswith("}"):
                return os.environ.get(x[2:-1], "")
            return x

        return cls.from_dict(resolve(data))

    def to_dict(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self)}
