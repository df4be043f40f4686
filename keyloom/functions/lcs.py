"""Longest common subsequence of two texts: length and matched ranges, batch by batch in Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def table(a: str, b: str) -> np.ndarray:
    """Lengths for all pairs of prefixes; each row from the one before with whole-array steps."""
    codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    out = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, c in enumerate(a, 1):
        grown = np.where(codes == ord(c), out[i - 1, :-1] + 1, out[i - 1, 1:])
        out[i, 1:] = np.maximum.accumulate(grown)
    return out


def ranges(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """(start, end) in a and in b of each run of matches, from the front; ends inclusive."""
    lengths, i, j = table(a, b), len(a), len(b)
    found: list[list[int]] = []
    while i and j:
        if a[i - 1] == b[j - 1] and lengths[i, j] == lengths[i - 1, j - 1] + 1:
            if found and found[-1][0] == i and found[-1][2] == j:
                found[-1][0], found[-1][2] = i - 1, j - 1
            else:
                found.append([i - 1, i - 1, j - 1, j - 1])
            i, j = i - 1, j - 1
        elif lengths[i - 1, j] >= lengths[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return [tuple(x) for x in reversed(found)]


def with_lcs(pairs: DataFrame, a: str, b: str, name: str = "lcs") -> DataFrame:
    """LCS: ``pairs`` with the length and the text of the longest common subsequence of two columns (null: empty)."""

    def run(batches):
        for batch in batches:
            texts = []
            for x, y in zip(batch.column(batch.schema.get_field_index(a)).to_pylist(), batch.column(batch.schema.get_field_index(b)).to_pylist(), strict=True):
                texts.append("".join((x or "")[s : e + 1] for s, e, _, _ in ranges(x or "", y or "")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(t) for t in texts], pa.int32()), pa.array(texts, pa.string())], names=[*batch.schema.names, f"{name}_len", name])

    schema = type(pairs.schema)(list(pairs.schema.fields)).add(f"{name}_len", "integer").add(name, "string")
    return pairs.mapInArrow(run, schema)
