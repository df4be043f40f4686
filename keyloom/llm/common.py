"""Helpers that the training-data operators share: shared folder, checkpoints, Arrow slices, words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.sources import shared

#: Rows whose values Python holds at once; texts may be long, so batches are walked in slices.
SLICE_ROWS = 256
#: Bytes of a worker's cache of word hashes before it starts anew, and what an entry takes besides its word.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 180


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it; set here where only the setting is there."""
    return shared.shared_dir(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows kept in the shared folder, so that a lost executor costs no recomputation and lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has, in any case of letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def narrowed(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return docs.select(*(docs[n] for n in names))


#: What workers keep between tasks of one kind of work; work of another kind gives it up.
KEPT: list[dict] = []


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a bounded number of rows; without ``keep`` the worker's kept lookups are dropped first."""
    if not keep:
        for held in KEPT:
            held.clear()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _alnum_table() -> bytes:
    kept = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
    return bytes(b if b in kept else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


#: Lower-cases A-Z and turns every ASCII byte that is neither letter nor digit into a blank.
ALNUM = _alnum_table()


def alnum_words(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters, as UTF-8."""
    return text.encode().translate(ALNUM).split() if text else []


def spaced_words(text: str | None) -> list[bytes]:
    """Runs free of blank, tab, LF, VT, FF and CR, with A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


class WordHash(dict):
    """word -> 64-bit hash, filled on first sight and started anew when it takes too many bytes."""

    taken = 0

    def __missing__(self, word: bytes) -> int:
        self.taken += len(word) + ENTRY_BYTES
        if self.taken > CACHE_BYTES:
            self.clear()
            self.taken = len(word) + ENTRY_BYTES
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, count=len(words))
