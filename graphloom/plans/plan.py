"""The explain tree: twelve operators, ordering and buffering."""

from __future__ import annotations

from dataclasses import dataclass, field

OPERATORS = ("source", "filter", "project", "flat-map", "distinct", "take", "count", "group", "sort", "capture", "join", "traverse")
BUFFERING = ("group", "sort", "join")


@dataclass(frozen=True)
class PlanNode:
    operator: str
    ordering: str
    details: dict = field(default_factory=dict)
    inputs: tuple[PlanNode, ...] = ()

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator}")

    @property
    def buffering(self) -> bool:
        return self.operator in BUFFERING or any(i.buffering for i in self.inputs)

    def logical(self) -> dict:
        return {"operator": self.operator, "ordering": self.ordering, "details": dict(self.details), "inputs": [i.logical() for i in self.inputs]}

    def physical(self) -> dict:
        return {**self.logical(), "inputs": [i.physical() for i in self.inputs], "buffering": self.buffering}

    def explain(self) -> dict:
        return {"logical": self.logical(), "physical": self.physical()}
