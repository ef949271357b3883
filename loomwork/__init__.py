"""Typed, queryable tables out of large collections of text, on Spark."""

from .config import CacheConfig, Config, ModelConfig, PrepConfig, SpecConfig
from .errors import ConfigError, LoomworkError, MissingDependency, SourceError, StoreError
from .functions.score import FuzzyScorer, KeywordScorer
from .functions.text import FixedWindowSplit, ParagraphSplit, RegexSplit
from .operators.cache import AnswerCache
from .operators.extraction import Caller, Rules
from .pipeline import Pipeline, estimate_performance, estimate_total_cost
from .sources.readers import load, register, register_converter, supported
from .sources.store import MemoryStore, Store
from .spec import MultipleSpec, NestedSpec, SimpleSpec, Variable

__version__ = "0.2.0"

__all__ = [
    "AnswerCache", "CacheConfig", "Caller", "Config", "ConfigError", "FixedWindowSplit", "FuzzyScorer", "KeywordScorer", "LoomworkError", "MemoryStore", "MissingDependency", "ModelConfig",
    "MultipleSpec", "NestedSpec", "ParagraphSplit", "Pipeline", "PrepConfig", "RegexSplit", "Rules", "SimpleSpec", "SourceError", "SpecConfig", "Store", "StoreError", "Variable",
    "estimate_performance", "estimate_total_cost", "load", "register", "register_converter", "supported",
]
