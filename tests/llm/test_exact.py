"""Operators with exact results against brute force over the awkward table."""

import random
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyloom.llm import decontam, fingerprints, licenses, packing, sharding, tokens
from keyloom.llm.common import alnum_words
from tests.llm import cases


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_fingerprints_tell_equal_texts_and_edits(spark):
    docs = cases.docs(spark)
    rows = docs.select("doc_id", "text").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    found = fingerprints.compare_with_next(docs).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in rows)
    order = sorted(r["doc_id"] for r in rows)
    for r in found:
        own = texts[r["doc_id"]]
        later = [i for i in order if i > r["doc_id"]]
        following = {texts[later[0] if later else order[0]]} | ({own} if order.count(r["doc_id"]) > 1 else set())
        cut = len(own) // 4
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] in {hashlib.sha256((own[: len(own) - cut] + t[:cut]).encode()).hexdigest() for t in following}
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert (r["near_edited"] == 1) == (r["fingerprint"] == r["edited_fingerprint"])
    prints = defaultdict(set)
    for r in found:
        prints[r["fingerprint"]].add(texts[r["doc_id"]])
    assert all(len(t) == 1 for t in prints.values()) and len(prints) == len(set(texts.values()))
    assert fingerprints.compare_with_next(cases.empty(spark)).count() == 0


def test_fingerprint_branches_locate_edits(spark):
    a, b = "one two\nthree four\n\nfive\nsix", "one two\nthree 4\n\nfive\nsix"
    df = spark.createDataFrame([(a, b)], "text string, other string")
    both = fingerprints.with_fingerprint(df)
    other = F.flatten(fingerprints.paragraph_nodes(F.col("other")))
    assert both.select(fingerprints.edited_paragraphs(F.col("paragraph_nodes"), other)).first()[0] == [1]


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards_are_gapless_and_near_equal(spark, shards):
    docs = cases.docs(spark, [*enumerate(cases.texts()), *((100 + k, "copy of one text " * 20) for k in range(300))])
    found = sharding.sharded_digest(docs, shards).collect()
    assert len(found) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    slots, sizes = defaultdict(list), [0] * shards
    for r in found:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    longest = max(r["size"] for r in found)
    assert max(sizes) - sum(sizes) / shards <= 1.02 * longest
    assert sharding.sharded_digest(cases.empty(spark), shards).count() == 0


def test_sharding_keeps_other_columns(spark):
    names = ("_id", "_hash", "_at", "key_hash", "KEY_ID", "key_row", "h", "i", "q", "at", "at0", "leaf", "slot0", "p")
    docs = cases.docs(spark).drop("shard").withColumns({c: F.lit(k) for k, c in enumerate(names)})
    out = sharding.shard_by_bytes(docs, 3)
    assert set(out.columns) == {*docs.columns, "size", "text_crc32", "shard", "slot"}
    assert {tuple(r[c] for c in names) for r in out.collect()} == {tuple(range(len(names)))}


def test_rows_that_repeat_text_and_id_are_parted(spark):
    rows = [(None, "one text of null ids " * 5)] * 400 + [(k, cases.prose(k, 20)) for k in range(100)] + [(3, "x" * 300)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sharding.sharded_digest(docs, 10).collect()
    slots, sizes = defaultdict(list), [0] * 10
    for r in found:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert len(found) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(abs(x - sum(sizes) / 10) for x in sizes) <= max(r["size"] for r in found)


def brute_contamination(text, items):
    words = alnum_words(text)
    hit, found = set(), set()
    for item, other in items:
        own = alnum_words(other)
        for gram in {tuple(own[i : i + 10]) for i in range(max(1, len(own) - 9))} if own else ():
            for i in range(len(words) - len(gram) + 1):
                if tuple(words[i : i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, cases.prose(5, 14)), (10, cases.prose(6, 40)), (2, "one TWO"), (3, None), (4, "!!"), (5, cases.prose(7, 3)), (5, "d"), (None, "one")]


@pytest.mark.parametrize("block", [5, 10**6])
def test_contamination_against_brute_force(spark, monkeypatch, block):
    planted = [(200 + k, f"before {t} after, {t.upper() if t else ''} the end") for k, (_, t) in enumerate(ITEMS)]
    docs = cases.docs(spark, [*enumerate(cases.texts()), *planted])
    monkeypatch.setattr(decontam.blocks, "__defaults__", (block,))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    found = decontam.contamination(docs, items).collect()
    assert len(found) == docs.count()
    for r in found:
        assert tuple(r)[1:] == brute_contamination(texts[r["doc_id"]], [x for x in ITEMS if x[0] is not None and x[1]])
    assert decontam.contamination(cases.empty(spark), items).count() == 0
    assert not any(r["contaminated"] for r in decontam.contamination(docs, items.limit(0)).collect())


@pytest.mark.parametrize("block", [5, 10**6])
def test_contamination_tells_rows_apart_whatever_the_blocks(spark, monkeypatch, block):
    one, two = cases.prose(5, 14), cases.prose(6, 40)
    rows = [(1, f"x {one}"), (1, f"{two} y y"), (1, f"{two} y y"), (1, None), (None, f"{one} {two}"), (None, "one two"), (None, None), (2, f"{two} z {one}")]
    monkeypatch.setattr(decontam.blocks, "__defaults__", (block,))
    found = decontam.contamination(cases.docs(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    items = [x for x in ITEMS if x[0] is not None and x[1]]
    assert Counter(map(tuple, found)) == Counter((i, *brute_contamination(t, items)) for i, t in [*rows, rows[-1]])


def test_decontaminate_cuts_spans_and_keeps_clean_rows(spark):
    item = cases.prose(6, 12)
    docs = cases.docs(spark, [(1, cases.prose(30, 80)), (2, f"{cases.prose(31, 60)} {item} {cases.prose(32, 60)}"), (3, item), (4, None), (5, ""), (6, f"{cases.prose(33, 60).title()}. {item.upper()}. {cases.prose(34, 60).upper()}")])
    out = by_id(decontam.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")))
    before = by_id(docs)
    assert brute_contamination(out[6]["text"], [(1, item)])[1] == 0 and out[6]["text"].startswith(cases.prose(33, 60).title()) and out[6]["text"].endswith(cases.prose(34, 60).upper())
    assert set(out) == {1, 2, 4, 5, 6} and all(out[k]["text"] == before[k]["text"] for k in (1, 4, 5))
    assert brute_contamination(out[2]["text"], [(1, item)])[1] == 0 and cases.prose(32, 60) in out[2]["text"]
    assert out[2]["n_chars"] == len(out[2]["text"]) and out[2].asDict().keys() == before[2].asDict().keys()


@pytest.mark.parametrize("block", [5, 10**6])
def test_what_is_cut_or_dropped_does_not_depend_on_the_blocks(spark, monkeypatch, block):
    one, two, three = cases.prose(5, 12), cases.prose(6, 12), cases.prose(7, 12)
    around = f"{cases.prose(33, 20)} {one} {cases.prose(34, 20)}"
    nested = f"{cases.prose(35, 30)} {' '.join(two.split()[:6])} {one} {' '.join(two.split()[6:])} {cases.prose(36, 30)}"
    rows = [(1, f"{one} {cases.prose(30, 12)} {two}"), (2, around), (2, around), (None, f"{three} {cases.prose(31, 30)}"), (None, None), (3, nested), (4, ""), (5, cases.prose(38, 20))]
    monkeypatch.setattr(decontam.blocks, "__defaults__", (block,))
    docs = cases.docs(spark, rows).withColumns({c: F.lit(1) for c in ("row", "held", "cleaned", "hit")})
    items = [(1, one), (2, two), (3, three)]
    out = decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == docs.columns
    found = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert found == Counter((r["doc_id"], decontam.clean_text(r["text"], decontam.Index(items)) if r["text"] else r["text"]) for r in docs.collect() if r["doc_id"] != 1)
    assert all(t is None or not brute_contamination(t, items)[1] for _, t in found) and sum(found.values()) == docs.count() - 1


def test_licences_against_brute_force(spark):
    extra = ["CC-BY cc by; all rights reserved", "general public license version 3 general public license", *(t for _, t in licenses.TEMPLATES)]
    docs = cases.docs(spark, [*enumerate(cases.texts()), *enumerate(extra, 300)])
    phrases = [(k.encode().split(), v) for k, v in licenses.PHRASES.items()]
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in licenses.scan(docs).collect():
        words = alnum_words(texts[r["doc_id"]])
        places = [(i, v) for p, v in phrases for i in range(len(words)) if words[i : i + len(p)] == p]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({v for _, v in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        if r["doc_id"] >= 302:
            assert licenses.TEMPLATES[r["doc_id"] - 302][0] in r["labels"].split(",") and r["score"] == 1
    assert licenses.scan(cases.empty(spark)).count() == 0


def test_licences_report_every_place_of_a_notice(spark):
    notice, other = licenses.TEMPLATES[5][1], licenses.TEMPLATES[13][1]
    words = notice.split()
    edited = " ".join([*words[:12], "edited", *words[13:]])
    filler = " ".join(f"filler{k}" for k in range(500))
    half = " ".join(words[: len(words) // 2])
    parts = [notice, filler, notice, edited, notice, other, filler, half, filler, other, other, edited]
    texts = [" ".join(parts), " ".join([notice] * 40)]
    expected = []
    for own in (parts, [notice] * 40):
        at, places = 0, []
        for part in own:
            size = len(alnum_words(part))
            places += [("bsd" if part in (notice, edited) else "cc-by-nc-4.0", at, at + size)] if part in (notice, edited, other) else []
            at += size
        expected.append(places)
    for r in licenses.scan(cases.docs(spark, [*enumerate(texts)])).collect():
        own = [tuple(x) for x in r["spans"] if x["label"] in ("bsd", "cc-by-nc-4.0")]
        assert own == expected[r["doc_id"]] and r["score"] == 1


def test_matching_statistics_against_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(60):
        templates = [("x", " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))) for _ in range(3)]
        scanner = licenses.Scanner(templates, {"a b": "y"})
        inside = [t.encode().split() for _, t in templates] + [b"a b".split()]
        words = [rng.choice("abcde").encode() for _ in range(30)]
        ids = [scanner.numbers.get(w, 0) for w in words]
        for at, _, matched in scanner.automaton.matches(ids):
            fits = lambda n, at=at: any(t[i : i + n] == words[at - n + 1 : at + 1] for t in inside for i in range(len(t) - n + 1))
            assert matched == max((n for n in range(1, at + 2) if fits(n)), default=0)


def test_token_counts_are_the_librarys(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = cases.docs(spark)
    own = Tokenizer.from_file(path)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    found = tokens.count_tokens(docs, path, 1024).collect()
    assert len(found) == docs.count()
    for r in found:
        n = len(own.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)
    assert tokens.count_tokens(cases.empty(spark), path, 1024).count() == 0


def test_signs_set_apart_keep_the_ids():
    """Words, signs, marks and blanks in any order give the library's ids; a word with commas and stops is one group."""
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rng = random.Random(12)
    parts = ["word", "Don't", "'s", "42", "_", ",", ".", ", ", ". ", "...", ".'", "|", " ", "\n", "\u0085", "e\u0301", "\u200b", "\u00b2", "\u24b6", "\u4e2d", "\u0130", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    tokens._lookups.clear()
    want = [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.token_ids(path)(texts) == want
    tokens._lookups.clear()
    words = [f"w{''.join(rng.choice('abcdefgh') for _ in range(9))}" for _ in range(500)]
    packing.token_ids(path)([f"{w}, {w}. {w} end" for w in words])
    assert sum(len(held.known) for held in tokens._lookups.values()) <= len(set(words)) + 3
    tokens._lookups.clear()


def test_packing_is_whole_gapless_and_tight(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = cases.docs(spark)
    own = Tokenizer.from_file(path)
    ids = {r["doc_id"]: [*own.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.select("doc_id", "text").collect()}
    rows = docs.select("doc_id").collect()
    found = packing.pack(docs, path).collect()
    assert sum(r["length"] for r in found) == sum(len(ids[r["doc_id"]]) for r in rows)
    sequences, lengths = defaultdict(list), Counter()
    for r in found:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and r["length"] == len(piece) and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        lengths[r["length"]] += 1
    for own_pieces in sequences.values():
        at = 0
        for offset, length in sorted(own_pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= packing.lower_bound(lengths) + 1
    assert packing.pack(cases.empty(spark), path).count() == 0


def test_dominance_and_best_fit_against_best_fit_decreasing():
    import random

    for seed in range(200):
        rng = random.Random(seed)
        capacity = rng.choice([7, 10, 50, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        bins = []
        for length in sorted(lengths, reverse=True):
            fitting = [k for k, room in enumerate(bins) if room >= length]
            if fitting:
                bins[min(fitting, key=bins.__getitem__)] -= length
            else:
                bins.append(capacity - length)
        patterns = packing.plan(Counter(lengths), capacity)
        used = Counter()
        for pattern, n in patterns:
            assert n > 0 and sum(pattern) <= capacity
            for x in pattern:
                used[x] += n
        assert used == Counter(lengths)
        assert packing.lower_bound(Counter(lengths), capacity) <= sum(n for _, n in patterns) <= len(bins)


def test_word_classes_agree():
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for text in cases.texts():
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        assert [w.decode() for w in alnum_words(text)] == pattern.findall(lowered)
