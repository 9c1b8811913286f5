"""Diagnostics: coded messages with source positions, and the error that carries them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    severity: str = "error"
    locations: tuple = ()

    def as_dict(self) -> dict:
        return {"code": self.code, "severity": self.severity, "message": self.message, "locations": [dict(x) for x in self.locations]}


class LoomError(Exception):
    """An error with a stable code and, for texts, the offsets it refers to."""

    def __init__(self, code: str, message: str, start: int | None = None, end: int | None = None):
        super().__init__(f"{code}: {message}")
        place = ({"start": start, "end": end},) if start is not None else ()
        self.diagnostic = Diagnostic(code, message, "error", place)

    @property
    def code(self) -> str:
        return self.diagnostic.code


@dataclass
class Diagnostics:
    """Collected diagnostics of one query."""

    items: list[Diagnostic] = field(default_factory=list)

    def add(self, code: str, message: str, severity: str = "error", **location) -> None:
        self.items.append(Diagnostic(code, message, severity, (location,) if location else ()))

    @property
    def failed(self) -> bool:
        return any(x.severity == "error" for x in self.items)
