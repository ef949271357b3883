"""Configurations, as frozen dataclasses that are checked when they are made.

The sections and keys are those of the YAML files that users have:
llm_extraction, data_preprocessing, schema, semantic_cache.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml

from .errors import ConfigError
from .functions import score, text
from .functions.conditions import condition
from .operators.prompts import SYSTEM, TEMPLATE
from .spec import Spec, from_dict

BACKENDS = ("parquet", "sqlite", "filesystem", "lmdb")


def _need(ok: object, message: str, **detail: object) -> None:
    if not ok:
        raise ConfigError(message, **detail)


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _made(cls: type, d: Mapping[str, Any] | None) -> Any:
    """A section from its keys; unknown ones are an error."""
    d = dict(d or {})
    known = {f.name for f in fields(cls) if f.init}
    _need(set(d) <= known, f"unknown keys: {', '.join(sorted(set(d) - known))}", keys=sorted(set(d) - known))
    return cls(**d)


@dataclass(frozen=True)
class ModelConfig:
    """Whom to ask, and how."""

    provider: str = "openai"
    name: str = "gpt-4o-mini"
    temperature: float = 0.0
    max_retries: int = 3
    base_delay: float = 1.0
    batch_size: int = 10
    max_workers: int = 1
    dotenv_path: str | None = None
    track_cost: bool = True
    max_budget: float | None = None
    model_input_cost_per_1M_tokens: float | None = None  # noqa: N815
    model_output_cost_per_1M_tokens: float | None = None  # noqa: N815

    def __post_init__(self) -> None:
        _need(isinstance(self.provider, str) and self.provider, "provider is a name", provider=self.provider)
        _need(isinstance(self.name, str) and self.name, "name is that of a model", name=self.name)
        _need(_number(self.temperature) and 0 <= self.temperature <= 2, "temperature is from 0 to 2", temperature=self.temperature)
        _need(self.max_retries >= 0, "max_retries isn't negative", max_retries=self.max_retries)
        _need(self.base_delay >= 0, "base_delay isn't negative", base_delay=self.base_delay)
        _need(self.batch_size > 0, "batch_size is positive", batch_size=self.batch_size)
        _need(self.max_workers > 0, "max_workers is positive", max_workers=self.max_workers)
        _need(self.dotenv_path is None or Path(self.dotenv_path).exists(), "dotenv_path doesn't exist", dotenv_path=self.dotenv_path)
        _need(isinstance(self.track_cost, bool), "track_cost is true or false", track_cost=self.track_cost)
        if self.max_budget is not None:
            _need(self.track_cost, "a budget needs track_cost", max_budget=self.max_budget)
            _need(_number(self.max_budget), "max_budget is a number", max_budget=self.max_budget)

    @property
    def model(self) -> str:
        return f"{self.provider}/{self.name}"


@dataclass(frozen=True)
class PrepConfig:
    """How records become chunks."""

    target_column: str = "raw_text"
    drop_target_column: bool = False
    pandas_score_filter: str | None = None
    preprocessed_data_path: str | None = None
    splitting: Mapping[str, Any] | None = None
    scoring: Mapping[str, Any] | None = None

    def __post_init__(self) -> None:
        if self.preprocessed_data_path:
            given = [f.name for f in fields(self) if f.name != "preprocessed_data_path" and getattr(self, f.name) != f.default]
            _need(not [g for g in given if g not in ("splitting", "scoring") or (getattr(self, g) or {}).get("type")], f"{', '.join(given)} can't be given with preprocessed_data_path", keys=given)
            return
        _need(isinstance(self.target_column, str) and self.target_column, "target_column is a name", target_column=self.target_column)
        _need(isinstance(self.drop_target_column, bool), "drop_target_column is true or false", drop_target_column=self.drop_target_column)
        _ = self.splitter, self.scorer
        if self.pandas_score_filter is not None:
            _need(isinstance(self.pandas_score_filter, str), "pandas_score_filter is a query string", query=self.pandas_score_filter)

    def check_filter(self, columns: list[str] | None = None) -> None:
        """Of the columns, or of the score alone. Needs a session."""
        if self.pandas_score_filter:
            condition(self.pandas_score_filter, columns or ["score"])

    @property
    def splitter(self) -> text.Splitter | None:
        return text.splitter(dict(self.splitting or {}))

    @property
    def scorer(self) -> score.Scorer | None:
        return score.scorer(dict(self.scoring or {}))


@dataclass(frozen=True)
class SpecConfig:
    """What to extract: the path of a spec, or the spec itself."""

    spec_path: str | None = None
    prompt_template: str = TEMPLATE
    system_prompt: str = SYSTEM
    spec: Mapping[str, Any] | None = None

    def __post_init__(self) -> None:
        _need(self.spec is not None or self.spec_path, "a spec or its path is needed")
        _need(self.spec is not None or Path(self.spec_path).exists(), f"{self.spec_path} doesn't exist", path=self.spec_path)
        _need(isinstance(self.prompt_template, str) and self.prompt_template, "prompt_template is a text")
        _need(isinstance(self.system_prompt, str), "system_prompt is a text")

    def spec_dict(self) -> dict[str, Any]:
        return dict(self.spec) if self.spec is not None else read_file(self.spec_path)

    def load(self) -> Spec:
        return from_dict(self.spec_dict())


@dataclass(frozen=True)
class CacheConfig:
    """Where answers are kept. All backends are one Parquet table; the names of others are taken as that."""

    backend: str = "parquet"
    path: str = ".answer_cache"
    max_size_mb: int = 512
    synchronous: str = "normal"

    def __post_init__(self) -> None:
        _need(self.backend in BACKENDS, f"backend is one of {', '.join(BACKENDS)}", backend=self.backend)
        _need(isinstance(self.max_size_mb, int) and self.max_size_mb > 0, "max_size_mb is a positive whole number", max_size_mb=self.max_size_mb)
        _need(self.synchronous in ("normal", "full"), "synchronous is normal or full", synchronous=self.synchronous)


def read_file(path: str | Path) -> dict[str, Any]:
    """A mapping from a YAML or JSON file."""
    p = Path(path)
    _need(p.exists(), f"{p} doesn't exist", path=str(p))
    kind = p.suffix.lower()
    _need(kind in (".yml", ".yaml", ".json"), f"a configuration is .yaml, .yml or .json, not {kind!r}", path=str(p))
    raw = p.read_text(encoding="utf-8")
    return (json.loads(raw) if kind == ".json" else yaml.safe_load(raw)) or {}


@dataclass(frozen=True)
class Config:
    llm_extraction: ModelConfig = field(default_factory=ModelConfig)
    data_preprocessing: PrepConfig = field(default_factory=PrepConfig)
    schema: SpecConfig = field(default_factory=lambda: SpecConfig(spec={"variables": []}))
    semantic_cache: CacheConfig | None = None

    @classmethod
    def from_dict(cls, d: Mapping[str, Any] | None) -> Config:
        d = dict(d or {})
        known = {f.name for f in fields(cls)}
        _need(set(d) <= known, f"unknown sections: {', '.join(sorted(set(d) - known))}")
        cache = d.get("semantic_cache")
        return cls(
            _made(ModelConfig, d.get("llm_extraction")),
            _made(PrepConfig, d.get("data_preprocessing")),
            _made(SpecConfig, d.get("schema")),
            None if cache is None else _made(CacheConfig, cache),
        )

    @classmethod
    def from_file(cls, path: str | Path) -> Config:
        return cls.from_dict(read_file(path))

    @classmethod
    def from_any(cls, config: Config | Mapping[str, Any] | str | Path) -> Config:
        if isinstance(config, Config):
            return config
        return cls.from_dict(config) if isinstance(config, Mapping) else cls.from_file(config)

    def to_dict(self) -> dict[str, Any]:
        plain = lambda x: None if x is None else {k: dict(v) if isinstance(v, Mapping) else v for k, v in asdict(x).items()}
        return {f.name: plain(getattr(self, f.name)) for f in fields(self)}
