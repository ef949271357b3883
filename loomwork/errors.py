"""Exceptions of the library."""


class LoomworkError(Exception):
    """Base of all errors raised here; `detail` holds what it is about."""

    def __init__(self, message: str, **detail: object):
        super().__init__(message)
        self.detail = detail


class ConfigError(LoomworkError, ValueError):
    """A setting is out of range or contradicts another."""


class SourceError(LoomworkError, ValueError):
    """An input can't be read as asked."""


class MissingDependency(LoomworkError, ImportError):
    """A reader needs a package that isn't installed."""


class StoreError(LoomworkError, RuntimeError):
    """An experiment's folder isn't in the state that was asked for."""
