"""Personal data: fixed patterns, and terms that give the found values away by their co-occurrence in the corpus.

Values of the four base kinds are the protected entities. For every entity e and every term t of a document that holds
it, corpus counts of documents give PMI(e; t) = log2(N * n(e,t) / (n(e) * n(t))), and IC(e) = -log2(n(e) / N). A term
that tells most of an entity's information, PMI >= theta * IC, in ``min_support`` documents at least, discloses it, and
is a span wherever it stands outside the values, in documents without the value too. Counts are over all documents.

As n(e,t) <= n(e), only terms with n(t) <= n(e)**theta * N**(1 - theta) can pass; others are sifted out without loss.
Values that stand in the same documents have the same counts with every term, and so have such terms: pairs are made of
classes of them, so a document of many values seen once and many words seen once gives one pair. A filter of bounded
size tells the scan of all texts which words to report; a join with the disclosing terms themselves decides.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import WordHash, alnum_words, checkpointed, fresh, slices

KINDS = ("email", "ip", "card", "phone", "term")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents that must hold value and term where the caller does not say (once or twice may be chance), and the share of
#: the value's information that a term may tell.
MIN_SUPPORT = 3
THETA = 0.9
#: Bits of the map that preselects terms for counting; more terms only make it select less sharply.
BITS = 1 << 22
SEEN_ENTRIES = 500_000
#: Bits of the filter of disclosing terms: so many for each term, rounded up to a power of two, LEAST_BITS and MOST_BITS (32 MB) at the ends.
BITS_PER_TERM, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
#: What stands in a cleaned text for each kind.
STANDS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Chains of numbers and dots taken four numbers at a time, as the leftmost matches fall."""
    out = []
    for m in CHAIN.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start; nothing for a null text."""
    if not text:
        return []
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [*(("ip", *s) for s in ips(text)), *(("card", *s) for s in cards(text))]
        out += [("phone", *s) for s in phones(text)] if "+" in text else []
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def entity_hash(kind: str, value: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(f"{kind}:{value.lower()}".encode()))


def open_words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the words that no value touches, in order."""
    values = iter([*sorted((s, e) for _, s, e in spans), (len(text) + 1, 0)])
    start, end = next(values)
    out, edge = [], 0
    for m in WORD.finditer(text):
        while start < m.end():
            edge = max(edge, end)
            start, end = next(values)
        if m.start() >= edge:
            out.append(m.span())
    return out


def found_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_hash, counts by kind, the base spans, the entities, and the text where it has any."""
    schema = "doc_id long, text_hash long, counts array<long>, base string, base_sha256 string, entities array<long>, held string"

    def run(batches):
        for part in slices(batches):
            rows = []
            for text in part.column(2).to_pylist():
                spans = base_spans(text)
                base = joined(spans)
                kinds = Counter(k for k, _, _ in spans)
                rows.append(([kinds[k] for k in KINDS[:4]], base, hashlib.sha256(base.encode()).hexdigest(), sorted({entity_hash(k, text[s:e]) for k, s, e in spans}), text if spans else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds_of = (pa.list_(pa.int64()), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds_of, strict=True))],
                names=["doc_id", "text_hash", "counts", "base", "base_sha256", "entities", "held"],
            )

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, schema)


def _marked(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(BITS)
    return (marks[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _bitmap(terms: DataFrame) -> np.ndarray:
    """The terms' bits; as large as BITS says, whatever the number of terms."""
    bit = F.pmod(F.col("t"), F.lit(BITS))
    words = terms.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(pmod(t, 64))))").alias("b"))
    out = np.zeros(BITS // 64, np.uint64)
    for r in words.collect():
        out[r["w"]] = r["b"] % (1 << 64)
    return out


def term_rows(texts: DataFrame, marks: np.ndarray | None = None) -> DataFrame:
    """k, m, t: the distinct terms of each text, of marked ones if marks are given."""
    bits = None if marks is None else texts.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        hashes = WordHash()
        for part in slices(batches):
            for k, m, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = {w for s, e in open_words(text, base_spans(text)) for w in alnum_words(text[s:e])}
                own = hashes.array(list(words))
                own = own if bits is None else own[_marked(own, bits.value)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int64)), pa.array(np.full(len(own), m, np.int64)), pa.array(own.view(np.int64))], names=["k", "m", "t"])

    return texts.select("k", "m", "held").mapInArrow(run, "k long, m long, t long")


def term_counts(docs: DataFrame, marks: np.ndarray, text_col: str = "text") -> DataFrame:
    """t, n: documents that hold each marked term, over all documents; other terms may be among them."""
    bits = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        hashes, seen = WordHash(), Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(np.array(list(seen), np.uint64).view(np.int64)), pa.array(list(seen.values()), pa.int64())], names=["t", "n"])
            seen.clear()
            return out

        for part in slices(batches):
            for text in part.column(0).to_pylist():
                own = hashes.array(list(set(alnum_words(text))))
                seen.update(own[_marked(own, bits.value)].tolist())
            if len(seen) > SEEN_ENTRIES:
                yield flush()
        yield flush()

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, found: DataFrame, total: int, text_col: str = "text", theta: float = THETA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """t: hashes of the terms that tell ``theta`` of some value's information, of ``total`` documents."""
    texts = found.where(F.size("entities") > 0).groupBy(F.col("text_hash").alias("k")).agg(F.count(F.lit(1)).alias("m"), F.first("entities").alias("entities"), F.first("held").alias("held"))
    texts = checkpointed(texts)
    # values and terms by the set of texts they stand in
    place = F.sum(F.xxhash64("k").cast("decimal(20,0)")).alias("place")
    entities = texts.select("k", "m", F.explode("entities").alias("e"))
    values = checkpointed(entities.groupBy("e").agg(F.sum("m").alias("n_e"), place))
    most = values.agg(F.max("n_e")).first()[0] or 0
    bound = most**theta * max(total, 1) ** (1 - theta) + 1
    counts = checkpointed(term_counts(docs, _bitmap(term_rows(texts)), text_col).where((F.col("n") <= bound) & (F.col("n") >= min_support)))
    rows = checkpointed(term_rows(texts, _bitmap(counts)))
    terms = counts.join(rows.groupBy("t").agg(place), "t").select("t", "n", F.xxhash64("n", "place", F.lit(0)).alias("c_t"))
    terms = checkpointed(terms)
    rows = rows.join(terms, "t")
    of_values = entities.join(values, "e").select("k", F.xxhash64("n_e", "place", F.lit(1)).alias("c_e"), "n_e").where(F.col("n_e") < total).distinct()
    pairs = rows.select("k", "m", "c_t", "n").distinct().join(of_values, "k").where(F.col("n") <= F.pow(F.col("n_e").cast("double"), F.lit(theta)) * float(max(total, 1)) ** (1 - theta) + 1)
    pmi = F.log2(F.col("both") * F.lit(float(total)) / (F.col("n_e") * F.col("n")))
    told = pairs.groupBy("c_e", "c_t", "n_e", "n").agg(F.sum("m").alias("both")).where(F.col("both") >= min_support)
    # the slack is rounding: a term that stands with its value and nowhere else tells exactly all of it
    told = told.where(pmi >= theta * F.log2(F.lit(float(total)) / F.col("n_e")) - 1e-9).select("c_e", "c_t")
    return checkpointed(terms.join(told.select("c_t").distinct(), "c_t").select("t").distinct())


def filter_places(terms: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each term in the filter."""
    return terms % np.uint64(bits), (terms >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) % np.uint64(bits)


def term_filter(told: DataFrame) -> np.ndarray:
    """A filter of the terms' hashes; its size follows their number up to a bound, beyond which it only tells less."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (told.count() * BITS_PER_TERM).bit_length()))

    def run(batches):
        for batch in batches:
            places = np.unique(np.concatenate(filter_places(np.array(batch.column(0)).view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], names=["w", "b"])

    out = np.zeros(bits // 64, np.uint64)
    rows = told.select("t").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b"))
    for r in rows.toLocalIterator():
        out[r["w"]] = np.uint64(r["b"] % (1 << 64))
    return out


def term_spans(docs: DataFrame, told: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, terms: sorted spans (s, x) of the terms ``told`` in each text that has any, one row for equal rows."""
    sieve = docs.sparkSession.sparkContext.broadcast(term_filter(told))

    def run(batches):
        hashes, known = WordHash(), sieve.value
        bits = len(known) * 64

        def passed(words: list[bytes]) -> np.ndarray:
            own = hashes.array(words)
            hit = np.ones(len(own), bool)
            for places in filter_places(own, bits):
                hit &= (known[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) == 1
            return hit

        for part in slices(batches):
            rows, starts, ends, terms = [], [], [], []
            for k, text in enumerate(part.column(2).to_pylist()):
                words = list(set(alnum_words(text)))
                some = {w for w, x in zip(words, passed(words).tolist(), strict=True) if x} if words else ()
                if some:
                    for s, e in open_words(text, base_spans(text)):
                        for w in alnum_words(text[s:e]):
                            if w in some:
                                rows.append(k)
                                starts.append(s)
                                ends.append(e)
                                terms.append(hashes[w])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(np.array(terms, np.uint64).view(np.int64))], names=["doc_id", "text_hash", "s", "x", "t"]
            )

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    seen = narrow.mapInArrow(run, "doc_id long, text_hash long, s int, x int, t long").distinct()
    return seen.join(told, "t", "left_semi").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("s", "x"))).alias("terms"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", theta: float = THETA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (of all kinds).

    Null and empty texts have no spans; long ones are taken whole. Equal rows get equal spans, null ids too. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    found = checkpointed(found_rows(docs, id_col, text_col))
    told = disclosing(docs, found, found.count(), text_col, theta, min_support)
    terms = term_spans(docs, told, id_col, text_col).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "terms")
    key = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("text_hash").eqNullSafe(F.col("_h"))
    words = F.array_join(F.transform("terms", lambda p: F.concat_ws(":", F.lit("term"), p["s"], p["x"])), ",")
    counts = [F.col("counts")[i].alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    both = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, words))
    n = (F.coalesce(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)) + F.coalesce(F.size("terms"), F.lit(0))).cast("long")
    return found.drop("held").join(terms, key, "left").select("doc_id", *counts, "base_sha256", both.alias("spans"), n.alias("n_spans"))


def replaced(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every span generalised to its kind; overlapping spans become one, of the kind that starts first."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], STANDS[kind]]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", theta: float = THETA, length_col: str = "n_chars", min_support: int = MIN_SUPPORT) -> DataFrame:
    """``docs`` with values and disclosing terms generalised.

    All rows and columns stay, whatever their names; the length column, where there is one, follows the text. Null and
    empty texts stay as they are, repeated rows are treated alike, and an empty table gives no rows.
    """
    found = checkpointed(found_rows(docs, id_col, text_col).where(F.size("entities") > 0))
    told = disclosing(docs, found, docs.count(), text_col, theta, min_support)
    of_id, of_text, own = (fresh(n, docs) for n in ("doc", "text_hash", "terms"))
    terms = term_spans(docs, told, id_col, text_col).select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_text), F.col("terms").alias(own))
    key = docs[id_col].cast("long").eqNullSafe(F.col(of_id)) & F.xxhash64(docs[text_col]).eqNullSafe(F.col(of_text))
    both = docs.join(terms, key, "left").drop(of_id, of_text)

    def run(batches):
        for part in slices(batches):
            place, extra = part.schema.get_field_index(text_col), part.schema.get_field_index(own)
            texts = []
            for text, words in zip(part.column(place).to_pylist(), part.column(extra).to_pylist(), strict=True):
                all_spans = base_spans(text) + [("term", x["s"], x["x"]) for x in words or []]
                texts.append(replaced(text, all_spans) if all_spans else text)
            part = part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))
            yield pa.RecordBatch.from_arrays([c for k, c in enumerate(part.columns) if k != extra], names=[n for n in part.schema.names if n != own])

    out = both.mapInArrow(run, docs.schema)
    return out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out
