"""Extraction specs: what to extract, as frozen dataclasses, and their Spark types.

Kinds: `simple` (one struct), `nested` (an array of structs under a container
name) and `multiple` (named specs, of any kind, side by side). The kinds are
kept in one registry, which `register` extends.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import types as T

from .errors import ConfigError

SCALARS: dict[str, T.DataType] = {
    "string": T.StringType(),
    "number": T.DoubleType(),
    "integer": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.StringType(),
}


@dataclass(frozen=True)
class Variable:
    name: str
    description: str = ""
    data_type: str = "string"
    required: bool = False
    allowed_values: tuple | None = None
    validate_in_text: bool = False

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> Variable:
        kind = d.get("data_type", "string")
        if isinstance(kind, list):  # `[string]` without quotes is a list in YAML
            kind = f"[{kind[0]}]"
        allowed = d.get("allowed_values")
        return cls(
            d["name"],
            d.get("description", ""),
            kind,
            bool(d.get("required", False)),
            None if allowed is None else tuple(allowed),
            bool(d.get("validate_in_text", False)),
        )

    @property
    def is_list(self) -> bool:
        return self.data_type.startswith("[")

    @property
    def item_type(self) -> str:
        return self.data_type[1:-1] if self.is_list else self.data_type

    @property
    def spark_type(self) -> T.DataType:
        one = SCALARS.get(self.item_type, T.StringType())
        return T.ArrayType(one) if self.is_list else one

    def line(self) -> str:
        out = f"- {self.name}: {self.description} ({self.data_type})"
        if self.required:
            out += " [REQUIRED]"
        if self.allowed_values:
            out += " (allowed values: " + ", ".join(f'"{v}"' for v in self.allowed_values) + ")"
        return out


class Spec:
    """What the kinds have in common."""

    kind: str

    @property
    def spark_type(self) -> T.DataType:
        """Type of an answer."""
        raise NotImplementedError

    @property
    def cleaned_type(self) -> T.DataType:
        """Type after cleaning, which unwraps containers inside `multiple`."""
        return self.spark_type

    def required(self, parent: tuple[str, ...] = (), strict: bool = True) -> dict[str, bool]:
        """Dotted path of each variable: is it required. strict keeps container names in paths below `multiple`, as the metric rules have it."""
        raise NotImplementedError


def _struct(variables: tuple[Variable, ...]) -> T.StructType:
    return T.StructType([T.StructField(v.name, v.spark_type, True, {"description": v.description, "required": v.required}) for v in variables])


@dataclass(frozen=True)
class SimpleSpec(Spec):
    variables: tuple[Variable, ...]
    kind: str = field(default="simple", init=False)

    @property
    def spark_type(self) -> T.StructType:
        return _struct(self.variables)

    def required(self, parent: tuple[str, ...] = (), strict: bool = True) -> dict[str, bool]:
        return {".".join((*parent, v.name)): v.required for v in self.variables}


@dataclass(frozen=True)
class NestedSpec(Spec):
    variables: tuple[Variable, ...]
    container: str = "instances"
    kind: str = field(default="nested", init=False)

    @property
    def item_type(self) -> T.StructType:
        return _struct(self.variables)

    @property
    def spark_type(self) -> T.StructType:
        return T.StructType([T.StructField(self.container, T.ArrayType(self.item_type))])

    def required(self, parent: tuple[str, ...] = (), strict: bool = True) -> dict[str, bool]:
        inner = (*parent, self.container) if strict or not parent else parent
        return {".".join((*inner, v.name)): v.required for v in self.variables}


@dataclass(frozen=True)
class MultipleSpec(Spec):
    specs: tuple[tuple[str, Spec], ...]
    kind: str = field(default="multiple", init=False)

    @property
    def spark_type(self) -> T.StructType:
        return T.StructType([T.StructField(n, s.spark_type) for n, s in self.specs])

    @property
    def cleaned_type(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.ArrayType(s.item_type) if isinstance(s, NestedSpec) else s.cleaned_type) for n, s in self.specs])

    def required(self, parent: tuple[str, ...] = (), strict: bool = True) -> dict[str, bool]:
        out: dict[str, bool] = {}
        for n, s in self.specs:
            out |= s.required((*parent, n), strict)
        return out


def _variables(d: Mapping[str, Any]) -> tuple[Variable, ...]:
    return tuple(Variable.from_dict(v) for v in d.get("variables", []))


_KINDS: dict[str, Callable[[Mapping[str, Any]], Spec]] = {
    "simple": lambda d: SimpleSpec(_variables(d)),
    "nested": lambda d: NestedSpec(_variables(d), d.get("container_name", "instances")),
    "multiple": lambda d: MultipleSpec(tuple((k, from_dict(v)) for k, v in d.items() if k != "schema_type")),
}


def register(kind: str, build: Callable[[Mapping[str, Any]], Spec]) -> None:
    _KINDS[kind] = build


def kinds() -> list[str]:
    return list(_KINDS)


def from_dict(d: Mapping[str, Any]) -> Spec:
    kind = d.get("schema_type", "simple")
    if kind not in _KINDS:
        raise ConfigError(f"unknown schema_type {kind!r}; known: {', '.join(_KINDS)}", schema_type=kind)
    return _KINDS[kind](d)


def load(path: str | Path) -> Spec:
    """A spec from a YAML or JSON file."""
    p = Path(path)
    text = p.read_text(encoding="utf-8")
    if p.suffix.lower() in (".yml", ".yaml"):
        d = yaml.safe_load(text)
    elif p.suffix.lower() == ".json":
        d = json.loads(text)
    else:
        raise ConfigError(f"a spec is .yaml, .yml or .json, not {p.suffix!r}", path=str(p))
    return from_dict(d or {})


def variables_text(spec: SimpleSpec | NestedSpec) -> str:
    return "\n".join(v.line() for v in spec.variables)
