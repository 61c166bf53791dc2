"""Errors that the engine raises itself, with the code a service would answer and whether trying again may help."""

from __future__ import annotations


class EngineError(Exception):
    code = 500
    retriable = False


class ConfigurationError(EngineError):
    pass


class DocumentError(EngineError):
    """A document that can't be processed."""


class EmbeddingError(EngineError):
    pass


class SearchError(EngineError):
    pass


class AuthenticationError(EngineError):
    code = 401


class AuthorizationError(EngineError):
    code = 403


class NotFoundError(EngineError):
    code = 404


class VectorStoreError(EngineError):
    retriable = True


class ModelError(EngineError):
    retriable = True


class ExternalServiceError(EngineError):
    retriable = True


class ValidationError(EngineError, ValueError):
    code = 400

    def __init__(self, field: str, message: str):
        super().__init__(f"{field}: {message}")
        self.field = field


def table() -> list[tuple[str, int, bool]]:
    """Name, code and whether it is worth another try, of every error."""
    return [(c.__name__, c.code, c.retriable) for c in (EngineError, *EngineError.__subclasses__())]
