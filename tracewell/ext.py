"""Extension points: own sources, intelligence providers and sinks.

Registered pieces take part in the same plans as the built-in ones: a source is
a rule and a mapping over the variant record, a provider is a function from the
response column to a verdict struct, a sink is a function of a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Source:
    detect: Callable[[Column], Column]
    mapping: dict = field(default_factory=dict)


_SOURCES: dict[str, Source] = {}
_PROVIDERS: dict[str, tuple[list[str], Callable]] = {}
_SINKS: dict[str, Callable[[DataFrame], object]] = {}


def register_source(name: str, detect: Callable[[Column], Column], mapping: dict) -> None:
    """``detect(record) -> Column`` and a mapping of event columns, as in :mod:`tracewell.sources.mappings`."""
    if "class_uid" not in mapping or "activity_name" not in mapping:
        raise ValueError("a source must map class_uid and activity_name")
    _SOURCES[name] = Source(detect, dict(mapping))


def register_provider(name: str, ioc_types: list[str], verdict: Callable[[Column], dict[str, Column]]) -> None:
    """``verdict(response) -> {field: Column}``; fields left out take the defaults of a verdict.

    A column may be the result of a ``pandas_udf`` where built-in functions do not suffice.
    """
    _PROVIDERS[name] = (list(ioc_types), verdict)


def register_sink(name: str, write: Callable[[DataFrame], object]) -> None:
    _SINKS[name] = write


def unregister(name: str) -> None:
    for registry in (_SOURCES, _PROVIDERS, _SINKS):
        registry.pop(name, None)


def custom_sources() -> dict[str, Source]:
    return dict(_SOURCES)


def custom_providers() -> dict[str, tuple[list[str], Callable]]:
    return dict(_PROVIDERS)


def export(df: DataFrame, sink: str) -> object:
    """Hand a result to a registered sink."""
    if sink not in _SINKS:
        raise KeyError(f"no sink {sink!r}; registered: {sorted(_SINKS)}")
    return _SINKS[sink](df)
