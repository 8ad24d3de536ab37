"""Errors with stable codes. Build errors are raised while a query value is made, the rest when it runs."""

from __future__ import annotations

#: Code -> meaning.
MEANINGS = {
    4001: "an aggregate in WHERE",
    4002: "a window function in WHERE or HAVING",
    4003: "a frame bound that points the wrong way",
    4004: "a grouped query fetched as whole rows",
    4005: "a row lock with a set operation",
    4006: "a field type that dynamic filters cannot hold",
    4007: "two sides of a join with one name",
    4101: "the transaction was rolled back, not committed",
    4102: "no repository in this context",
    4103: "one row was asked for and several matched",
    4104: "the stored row is gone or newer",
    4105: "the entity has no deletion column",
    4106: "the stored columns are not the declared ones",
    4107: "a value does not fit the declared type",
    4108: "an unknown enum label",
    4109: "the association was not preloaded",
    4110: "the stream was read after its block",
    4111: "a clause that a bulk write refuses",
    4112: "an unknown filter field",
    4113: "a bad filter value",
    4115: "ANALYZE of a statement that may write",
}


class RelqError(Exception):
    """code is one of MEANINGS, or None for errors without one."""

    def __init__(self, code: int | None, detail: str = "") -> None:
        self.code = code
        meaning = MEANINGS.get(code, "") if code else ""
        super().__init__(": ".join(x for x in (f"RELQ-{code}" if code else "", meaning, detail) if x))

    @property
    def client_input(self) -> bool:
        return self.code in (4112, 4113)


class InvalidProjection(RelqError):
    def __init__(self, detail: str) -> None:
        super().__init__(None, f"invalid projection: {detail}")


class DanglingReference(RelqError):
    def __init__(self, detail: str) -> None:
        super().__init__(None, f"dangling reference: {detail}")


class InvalidConflictClause(RelqError):
    def __init__(self, detail: str) -> None:
        super().__init__(None, f"invalid conflict clause: {detail}")


class Unsupported(RelqError):
    def __init__(self, detail: str) -> None:
        super().__init__(None, f"unsupported: {detail}")


class VersionConflict(RelqError):
    """Another writer published a version since this transaction read: retry."""

    def __init__(self, detail: str) -> None:
        super().__init__(None, f"version conflict: {detail}")


class StatementTimeout(RelqError):
    """A statement ran longer than its limit and was cancelled."""

    def __init__(self, seconds: float) -> None:
        super().__init__(None, f"statement cancelled after {seconds} s")


#: Error conditions of Spark by what a caller should do about them.
_TRANSIENT = ("ExecutorLostFailure", "FetchFailed", "Connection reset", "Connection refused", "Py4JNetworkError")
_CLIENT =("DIVIDE_BY_ZERO", "ARITHMETIC_OVERFLOW", "CAST_INVALID_INPUT", "CAST_OVERFLOW", "SCALAR_SUBQUERY_TOO_MANY_ROWS", "NUMERIC_VALUE_OUT_OF_RANGE")


def classify(error: BaseException) -> str:
    """retryable (the transaction, as others were first), transient (lost executors and connections), client_input, or other."""
    if isinstance(error, VersionConflict):
        return "retryable"
    if isinstance(error, RelqError):
        return "client_input" if error.client_input else "other"
    if isinstance(error, ConnectionError) or any(x in type(error).__name__ or x in str(error) for x in _TRANSIENT):
        return "transient"
    condition = getattr(error, "getCondition", lambda: None)() or ""
    if any(c in condition or c in str(error) for c in _CLIENT):
        return "client_input"
    return "other"
