"""Errors with a code, a context and whether trying again may help."""

from __future__ import annotations

from dataclasses import dataclass


class LodestoneError(Exception):
    code = "ERROR"
    recoverable = False

    def __init__(
        self, message: str, *, code: str | None = None, context: dict | None = None, recoverable: bool | None = None
    ):
        super().__init__(message)
        self.code = code or self.code
        self.context = context or {}
        self.recoverable = self.recoverable if recoverable is None else recoverable

    def to_dict(self) -> dict:
        return {
            "name": type(self).__name__,
            "message": str(self),
            "code": self.code,
            "context": self.context,
            "recoverable": self.recoverable,
        }


def _kind(name: str, base: type, code: str, recoverable: bool = False) -> type:
    return type(name, (base,), {"code": code, "recoverable": recoverable, "__module__": __name__})


StoreError = _kind("StoreError", LodestoneError, "STORE_ERROR")
StoreConnectionError = _kind("StoreConnectionError", StoreError, "STORE_CONNECTION_ERROR")
StoreQueryError = _kind("StoreQueryError", StoreError, "STORE_QUERY_ERROR")
StoreSchemaError = _kind("StoreSchemaError", StoreError, "STORE_SCHEMA_ERROR")
EmbeddingError = _kind("EmbeddingError", LodestoneError, "EMBEDDING_ERROR")
ModelInitializationError = _kind("ModelInitializationError", EmbeddingError, "MODEL_INITIALIZATION_ERROR")
EmbeddingGenerationError = _kind("EmbeddingGenerationError", EmbeddingError, "EMBEDDING_GENERATION_ERROR", True)
ModelError = _kind("ModelError", LodestoneError, "MODEL_ERROR", True)
ModelAPIError = _kind("ModelAPIError", ModelError, "MODEL_API_ERROR", True)
ModelParseError = _kind("ModelParseError", ModelError, "MODEL_PARSE_ERROR")
QueryError = _kind("QueryError", LodestoneError, "QUERY_ERROR")
InvalidQueryError = _kind("InvalidQueryError", QueryError, "INVALID_QUERY")
QueryTimeoutError = _kind("QueryTimeoutError", QueryError, "QUERY_TIMEOUT", True)
ToolServerError = _kind("ToolServerError", LodestoneError, "TOOL_SERVER_ERROR")
ToolError = _kind("ToolError", ToolServerError, "TOOL_ERROR")
ConfigurationError = _kind("ConfigurationError", LodestoneError, "CONFIGURATION_ERROR")
FileSystemError = _kind("FileSystemError", LodestoneError, "FILE_SYSTEM_ERROR")
ValidationError = _kind("ValidationError", LodestoneError, "VALIDATION_ERROR")


@dataclass(frozen=True)
class Recovery:
    can_retry: bool
    max_retries: int = 0
    backoff_ms: tuple[int, ...] = ()


def recovery(error: Exception) -> Recovery:
    """How often to try again, and how long to wait before each time."""
    if not is_recoverable(error):
        return Recovery(False)
    if isinstance(error, ModelAPIError) and error.context.get("status_code") == 429:
        return Recovery(True, 3, (1000, 5000, 15000))
    if isinstance(error, QueryTimeoutError):
        return Recovery(True, 2, (2000, 5000))
    return Recovery(True, 3, (1000, 2000, 4000))


def wrap(error: object, context: str | None = None) -> LodestoneError:
    if isinstance(error, LodestoneError):
        return error
    found = LodestoneError(str(error), code="UNKNOWN_ERROR", context={"context": context} if context else {})
    if isinstance(error, BaseException):
        found.__cause__ = error
    return found


def is_recoverable(error: object) -> bool:
    return isinstance(error, LodestoneError) and error.recoverable
