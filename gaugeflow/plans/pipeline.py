"""Pipelines as plugins: named steps from DataFrames to a DataFrame, with checked parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from gaugeflow.sources.settings import Parameter, SettingsError, parameters


@dataclass
class Pipeline:
    """name, parameters, and run(inputs, values) -> DataFrame; configure() checks values before any data is read."""

    name: str
    run: Callable[[Mapping[str, DataFrame], Mapping[str, Any]], DataFrame]
    known: Sequence[Parameter] = ()
    values: dict[str, Any] = field(default_factory=dict)

    def configure(self, **given: Any) -> Pipeline:
        self.values = parameters(given, self.known)
        return self

    def __call__(self, **inputs: DataFrame) -> DataFrame:
        return self.run(inputs, self.values or parameters({}, self.known))


class Registry:
    """Pipelines by name."""

    def __init__(self) -> None:
        self.pipelines: dict[str, Pipeline] = {}

    def add(self, pipeline: Pipeline) -> Pipeline:
        if pipeline.name in self.pipelines:
            raise SettingsError(f"{pipeline.name} is taken")
        self.pipelines[pipeline.name] = pipeline
        return pipeline

    def get(self, name: str) -> Pipeline:
        if name not in self.pipelines:
            raise SettingsError(f"no pipeline {name}; there are {sorted(self.pipelines)}")
        return self.pipelines[name]
