"""Named functions over tables: libraries of DataFrame transforms and column functions that queries call by name."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Functions:
    """FUNCTION and SCRIPT: libraries by name, functions by name and by the SHA-1 of their source."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.libraries: dict[str, dict[str, tuple[Callable, bool]]] = {}

    def load(self, library: str, functions: dict[str, Callable], read_only: bool = False, replace: bool = False) -> dict[str, str]:
        """FUNCTION LOAD: function -> SHA-1. A name is in one library only."""
        if library in self.libraries and not replace:
            raise ValueError(f"library {library} is there already")
        for other, own in self.libraries.items():
            if other != library and (clash := own.keys() & functions.keys()):
                raise ValueError(f"functions {sorted(clash)} are in library {other}")
        self.libraries[library] = {name: (f, read_only) for name, f in functions.items()}
        return {name: self.sha(f) for name, f in functions.items()}

    @staticmethod
    def sha(function: Callable) -> str:
        return hashlib.sha1(inspect.getsource(function).encode()).hexdigest()

    def _find(self, name: str) -> tuple[Callable, bool]:
        for own in self.libraries.values():
            for known, entry in own.items():
                if name in (known, self.sha(entry[0])):
                    return entry
        raise KeyError(f"no function {name}")

    def call(self, name: str, *tables: DataFrame, read_only: bool = False, **arguments) -> DataFrame:
        """FCALL, EVALSHA: a transform of DataFrames, planned by Spark; the read-only forms refuse others."""
        function, harmless = self._find(name)
        if read_only and not harmless:
            raise PermissionError(f"{name} may write")
        return function(*tables, **arguments)

    def register_sql(self, name: str, parameters: str, returns: str, body: str) -> None:
        """A column function for SQL; its body is an expression, so that it stays inside generated code."""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")

    def names(self) -> list[tuple[str, str]]:
        """FUNCTION LIST."""
        return sorted((library, name) for library, own in self.libraries.items() for name in own)

    def delete(self, library: str) -> None:
        del self.libraries[library]

    def flush(self) -> None:
        self.libraries.clear()
