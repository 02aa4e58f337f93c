"""Errors in five categories, so that a client can act on the kind."""

from __future__ import annotations


class FactflowError(Exception):
    category = "fault"

    def as_dict(self) -> dict[str, str]:
        return {"category": self.category, "message": str(self)}


class IncorrectError(FactflowError):
    """The request or plan is wrong as written."""

    category = "incorrect"


class NotFoundError(FactflowError):
    """A named attribute, rule or interest does not exist."""

    category = "not-found"


class ConflictError(FactflowError):
    """The request contradicts what is there already."""

    category = "conflict"


class FaultError(FactflowError):
    """Something broke inside."""

    category = "fault"


class UnsupportedError(FactflowError):
    """A legal request that this engine does not serve."""

    category = "unsupported"
