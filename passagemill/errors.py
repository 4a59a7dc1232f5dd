"""Errors that reach the caller. What goes wrong with one document becomes an event row instead."""

from __future__ import annotations


class ChunkingError(Exception):
    """Base of all errors of this package."""


class ConfigError(ChunkingError):
    def __init__(self, message: str, key: str | None = None):
        super().__init__(message)
        self.key = key


class ParseError(ChunkingError):
    def __init__(self, message: str, path: str | None = None, position: int | None = None):
        super().__init__(message)
        self.path, self.position = path, position


class UnsupportedTypeError(ChunkingError):
    def __init__(self, extension: str, supported: list[str]):
        super().__init__(f"unsupported file type {extension!r}; supported: {', '.join(supported)}")
        self.extension, self.supported = extension, supported


class ModelError(ChunkingError):
    """A language model's reply is missing or unusable."""

    def __init__(self, message: str, retries: int = 0):
        super().__init__(message)
        self.retries = retries


class EmbeddingError(ChunkingError):
    def __init__(self, message: str, model: str | None = None):
        super().__init__(message)
        self.model = model
