"""A registry of query builders by name, with checked parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of types in JSON schemas.
JSON_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}
# Stages that a call goes through.
STAGES = ("discovery", "validation", "permission", "abort", "execution", "formatting")


@dataclass
class Tool:
    """A builder (spark, **parameters) -> DataFrame, the types of its parameters, and what it may be called for."""

    build: Callable[..., DataFrame]
    parameters: dict[str, type]
    required: tuple[str, ...] = ()
    priority: int = 5
    concurrent: bool = False
    category: str = "other"
    calls: int = field(default=0)

    def schema(self) -> dict:
        """The parameters as a JSON schema."""
        return {"type": "object", "properties": {p: {"type": JSON_TYPES.get(t, "object")} for p, t in self.parameters.items()}, "required": list(self.required)}


class Tools:
    """Tools by name; a call is looked up, validated, permitted, and only then built."""

    def __init__(self) -> None:
        self.tools: dict[str, Tool] = {}

    def add(self, name: str, tool: Tool) -> None:
        """Register a tool once."""
        if name in self.tools:
            raise ValueError(f"{name} is registered twice")
        self.tools[name] = tool

    def call(self, spark: SparkSession, name: str, parameters: dict, allowed: Callable[[str], bool] = lambda _: True, aborted: Callable[[], bool] = lambda: False) -> DataFrame:
        """The DataFrame of a tool; errors name the stage that failed."""
        if name not in self.tools:
            raise LookupError(f"discovery: no tool {name}")
        tool = self.tools[name]
        if missing := [p for p in tool.required if p not in parameters]:
            raise ValueError(f"validation: {', '.join(missing)} missing")
        if wrong := [p for p, v in parameters.items() if p not in tool.parameters or not isinstance(v, tool.parameters[p])]:
            raise ValueError(f"validation: {', '.join(wrong)} unknown or of another type")
        if not allowed(name):
            raise PermissionError(f"permission: {name}")
        if aborted():
            raise InterruptedError(f"abort: {name}")
        tool.calls += 1
        try:
            return tool.build(spark, **parameters)
        except Exception as e:
            raise RuntimeError(f"execution: {name}: {e}") from e

    def formatted(self, spark: SparkSession, name: str, parameters: dict, most: int = 20, **checks: Callable) -> str:
        """A call's first `most` rows as lines of JSON, or its error as a line."""
        try:
            rows = self.call(spark, name, parameters, **checks).limit(most)
            return "\n".join(r.line for r in rows.select(F.to_json(F.struct("*")).alias("line")).collect())
        except (LookupError, ValueError, PermissionError, InterruptedError, RuntimeError) as e:
            return f"Error: {e}"

    def by_category(self) -> dict[str, int]:
        """Tools of each category."""
        out: dict[str, int] = {}
        for t in self.tools.values():
            out[t.category] = out.get(t.category, 0) + 1
        return out
