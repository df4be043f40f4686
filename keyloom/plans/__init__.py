"""Registered queries: each operator over the test tables, with the same rows stated in DuckDB SQL where SQL can."""

from keyloom.plans import bits, containers, keys, locks, places, scored, search, streams, variants, vectors  # noqa: F401
