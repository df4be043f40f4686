"""Exact token counts with a two-tier lookup, map-side: a broadcast table of frequent pre-tokens, then worker caches.

A pre-token group is what stands between two blanks, with the blank before it: the byte-level pattern joins a blank to
the non-blank that follows and never crosses from there into the next blank, so counts of groups add up. Groups that
touch other white space at an end are set apart, and such texts are split by the pattern's own white-space rules; texts
with special strings or separators that the libraries see differently go to the tokenizer whole. No pre-token is
shuffled: the table comes from per-task heavy hitters, and misses are encoded by the worker that meets them.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import KEPT, slices

#: Entries of the broadcast table, and the longest pre-token in it: at most some 17 MB.
TABLE_ENTRIES = 65_536
TABLE_CHARS = 64
#: A task reports pre-tokens that make up at least this share of its own.
HEAVY_SHARE = 1 / 20_000
#: Bytes of each of the two generations of a worker's cache, and what an entry takes besides its own bytes.
CACHE_BYTES, ENTRY_BYTES = 80 << 20, 200
#: Groups that are encoded in one call.
JOINED = 1_000
PUNCTUATION = "!\"#$%&()*+,-./:;=>?@[\\]^_`{}~"
#: Set in the table and caches for groups whose count depends on what stands beside them.
APART = 1 << 40
GROUPS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Separators that Python and the patterns see differently, and how special strings begin.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")

_loaded: dict[str, object] = {}
_lookups: dict[str, Lookup] = {}
KEPT.append(_lookups)


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


class Lookup:
    """What is known of groups: a fixed table and learnt ones, bounded in bytes; when full, what is used is kept."""

    def __init__(self, make: Callable[[list[str]], list], fixed: dict | None = None, most: int = CACHE_BYTES):
        self.make, self.fixed, self.most = make, fixed or {}, most
        self.known, self.old, self.taken = dict(self.fixed), {}, 0

    def learn(self, groups: set[str]) -> dict:
        """A dict that has all of ``groups``."""
        if self.taken > self.most:
            self.old, self.known, self.taken = self.known, dict(self.fixed), 0
        missing = groups.difference(self.known)
        back = {g: v for g in missing if (v := self.old.get(g)) is not None} if self.old else {}
        self.add(list(back), list(back.values()))
        new = list(missing.difference(back)) if back else list(missing)
        self.add(new, self.make(new))
        return self.known

    def add(self, groups: list[str], values: list) -> None:
        self.known.update(zip(groups, values, strict=True))
        held = sum(map(len, values)) if values and isinstance(values[0], bytes) else 0
        self.taken += sum(map(len, groups)) + held + ENTRY_BYTES * len(groups)


def lookups(makes: dict[str, tuple[Callable[[list[str]], list], dict | None]], most: list[int] | None = None) -> list[Lookup]:
    """The worker's lookups of these kinds, with their bytes. They outlive tasks, until a task of another kind of work begins."""
    for kind in [k for k in _lookups if k not in makes]:
        del _lookups[kind]
    for (kind, (make, fixed)), size in zip(makes.items(), most or [CACHE_BYTES] * len(makes), strict=True):
        if kind not in _lookups:
            _lookups[kind] = Lookup(make, fixed, size)
    return [_lookups[kind] for kind in makes]


def odd(text: str) -> bool:
    """Whether only the tokenizer itself can take the text apart."""
    return any(x in text for x in ODD)


def ids_between(path: str, texts: list[str], separator: str, joiner: str) -> list[bytes]:
    """Ids of each text as 32-bit bytes, encoded many at a time with a separator between them.

    ``separator`` is a character that is one token wherever ``joiner`` puts it, and that no other text yields. Texts
    with that character, or with special strings, are encoded alone.
    """
    own = tokenizer(path)
    (mark,) = own.encode(separator, add_special_tokens=False).ids
    out: dict[str, bytes] = {}
    for at in range(0, len(texts), JOINED):
        part = texts[at : at + JOINED]
        if odd("\n".join(part)) or any(separator in t for t in part):
            for t in part:
                if separator in t or odd(t):
                    out[t] = np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            part = [t for t in part if t not in out]
            if not part:
                continue
        (found,) = own.encode_batch_fast([joiner.join(part)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        raw, marks = ids.tobytes(), (np.flatnonzero(ids == mark) * 4).tolist()
        out.update((t, raw[i:k]) for t, i, k in zip(part, [0, *(m + 4 for m in marks)], [*marks, len(raw)], strict=True))
    return [out[t] for t in texts]


def two_parts(groups: list[str]) -> list[tuple[str, str]]:
    """For each group its letters and the punctuation after them, which the patterns take apart anyway; or itself and ''."""
    out = []
    for group in groups:
        if not group.isalpha():
            core = group.rstrip(PUNCTUATION)
            # a dotted I ends in a mark in lower case, which is one pre-token with the punctuation
            if core.isalpha() and core[-1] != "\u0130":
                out.append((core, group[len(core) :]))
                continue
        out.append((group, ""))
    return out


def frequent(docs: DataFrame, text_col: str, entries: int = TABLE_ENTRIES) -> DataFrame:
    """pre-token group, n: heavy hitters of all texts, from each task's own heavy hitters."""

    def count(batches):
        seen: Counter = Counter()
        total, floor = 0, 0
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                if text:
                    groups = text.split(" ")[1:]
                    seen.update(g for g in groups if len(g) <= TABLE_CHARS)
                    total += len(groups)
            if len(seen) > 8 * entries:
                floor = total * HEAVY_SHARE / 4
                seen = Counter({k: n for k, n in seen.items() if n > floor})
        heavy = [(k, n) for k, n in seen.items() if n >= total * HEAVY_SHARE and 0 < len(k) <= TABLE_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in heavy], pa.string()), pa.array([n for _, n in heavy], pa.int64())], names=["part", "n"])

    found = docs.select(docs[text_col].alias("text")).mapInArrow(count, "part string, n long")
    return found.groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(entries)


def length_table(spark_docs: DataFrame, text_col: str, path: str, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """The broadcast table: frequent group -> its tokens, or APART."""
    own = tokenizer(path)
    parts = [r["part"] for r in frequent(spark_docs, text_col, entries).collect()]
    counts = own.encode_batch([f" {p}" for p in parts], add_special_tokens=False) if parts else []
    return {p: APART if p[0].isspace() or p[-1].isspace() else len(c.ids) for p, c in zip(parts, counts, strict=True)}


class Counts:
    """Token counts of texts, by table, cache and tokenizer in that order."""

    def __init__(self, path: str, table: dict[str, int], version: str):
        self.path = path
        kinds = {f"lengths {path} {version}": (self.lengths, table), f"whole {path}": (lambda groups: [self.whole(g) for g in groups], None)}
        self.rest, self.other = lookups(kinds)

    def whole(self, text: str) -> int:
        return len(tokenizer(self.path).encode(text, add_special_tokens=False).ids)

    def lengths(self, parts: list[str]) -> list[int]:
        """Tokens of groups that follow a blank; letters and punctuation are learnt apart."""
        inner = [p for p in parts if p and not p[0].isspace() and not p[-1].isspace()]
        split = two_parts(inner)
        wanted = list({f" {core}" for core, _ in split})
        n = dict(zip(wanted, ids_between(self.path, wanted, "\n", "\n"), strict=True))
        tails = self.other.learn({t for _, t in split if t})
        found = {p: len(n[f" {core}"]) // 4 + (tails[tail] if tail else 0) for p, (core, tail) in zip(inner, split, strict=True)}
        return [found.get(p, APART) for p in parts]

    def counts(self, texts: list[str | None]) -> list[int]:
        found: list[int | None] = [0 if not t else self.whole(t) if odd(t) else None for t in texts]
        parts = [t.split(" ") if n is None else [] for t, n in zip(texts, found, strict=True)]
        firsts = [p[0] if p else "" for p in parts]
        known = self.rest.learn(set().union(*(p[1:] for p in parts))).__getitem__
        other = self.other.learn(set(firsts))
        for k, own in enumerate(parts):
            if own:
                n = sum(map(known, own[1:])) if own[0] and not own[0][-1].isspace() else APART
                found[k] = n + other[own[0]] if n < APART else self.by_white_space(texts[k])
        return found

    def by_white_space(self, text: str) -> int:
        groups = GROUPS.findall(text)
        known = self.other.learn(set(groups))
        return sum(map(known.__getitem__, groups))


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; a null text counts as empty; equal rows give equal rows."""
    lengths = length_table(docs, text_col, path)
    version = xxhash.xxh3_64_hexdigest("\0".join(sorted(lengths)))
    table = docs.sparkSession.sparkContext.broadcast(lengths)

    def run(batches):
        counts = Counts(path, table.value, version)
        for part in slices(batches, keep=True):
            sizes = counts.counts(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
