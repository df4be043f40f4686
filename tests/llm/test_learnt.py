"""Archives, learnt and corpus-dependent operators, and the pipeline, on small tables."""

import hashlib
import io
import re
import struct
import zipfile
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import common, neardup, pii, quality, warc
from tests.llm import cases


def page_rows():
    long = "x" * 150
    bodies = [None, "", "short", "short", long, long, long + "é", "<p>" * 400, None, "a\r\n\r\nb" * 30, "a\r\n\r\nb" * 30]
    return [(k, None if k == 2 else f"http://example.com/{k}?q=a b\r\n", b) for k, b in enumerate(bodies)]


def expected_pages(rows):
    firsts = {}
    for i, _, html in sorted(rows):
        firsts.setdefault((html or "").encode(), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = len(raw) >= 100 and firsts[raw] != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", firsts[raw] if revisit else None))
    return sorted(out, key=str)


def test_packages_round_trip(spark):
    rows = [*page_rows(), page_rows()[4]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).withColumns({"digest": F.lit(1), "payload": F.lit("x")})
    found = warc.round_trip(spark, pages)
    assert sorted(map(tuple, found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected_pages(rows)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_packages_are_plain_zip_and_payloads_whole(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").coalesce(1)
    folder = f"{common.shared_dir(spark)}/test-packages"
    written = warc.write_packages(warc.with_record_types(pages), folder).collect()
    store, path = warc.open_store(written[0]["path"])
    with zipfile.ZipFile(io.BytesIO(store.open_input_file(path).read())) as z:
        assert z.namelist() == [warc.DATA_MEMBER, warc.INDEX_MEMBER] and z.testzip() is None
    read = warc.read_packages(spark.createDataFrame(written), with_payload=True).collect()
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in read if r["record_type"] == "response"}
    assert all(payloads[i] == (html or "") for i, _, html in page_rows() if i in payloads)


def test_zip64_directory_and_walk_without_index(tmp_path):
    record = warc.record_bytes(7, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), 7, None)
    body, name = record * 3, warc.DATA_MEMBER.encode()
    local = struct.pack("<4sHHHHHIIIHH", warc.LOCAL, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body))
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", warc.CENTRAL, 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    start = len(local) + len(body)
    end64 = struct.pack("<4sQHHIIQQQQ", warc.END64, 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    locator = struct.pack("<4sIQI", warc.LOCATOR64, 0, start + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", warc.END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (tmp_path / "x.zip").write_bytes(local + body + entry + end64 + locator + end)
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x.zip")) as file:
        members = warc.central_directory(file)
        places = list(warc.record_places(file, members))
        assert [n for _, n in places] == [len(record)] * 3
        import zlib

        assert warc.parse_record(zlib.decompress(file.read_at(places[1][1], places[1][0]), 31))["payload"] == b"payload"


def test_quality_on_held_out_rows_and_awkward_texts(spark):
    rng = np.random.default_rng(1)
    junk = lambda k: ("WORD!! " * 40) if k % 2 else " ".join(f"{w}###" for w in cases.prose(k, 40).split())
    good = [rng.random() < 0.8 for _ in range(400)]
    rows = [(1000 + k, cases.prose(k + 50, 60) if g else junk(k)) for k, g in enumerate(good)]
    docs = cases.docs(spark, [*enumerate(cases.texts()), *rows])
    labels = spark.createDataFrame([(1000 + k, int(g)) for k, g in enumerate(good)] + [(None, 1)], "doc_id long, quality int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    held = [r for r in found if r["held_out"] and 1000 <= r["doc_id"] < 1400]
    assert np.mean([r["predicted"] == good[r["doc_id"] - 1000] for r in held]) > 0.95
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert quality.classify(cases.empty(spark), labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_samples_are_bounded_whatever_ids_repeat(spark, monkeypatch):
    rows = [(k, cases.prose(k)) for k in range(30)] + [(5, cases.prose(100 + k)) for k in range(60)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    sizes, matrix = [], quality._matrix

    def noted(sample):
        found = matrix(sample)
        sizes.append(len(found))
        return found

    monkeypatch.setattr(quality, "_matrix", noted)
    quality.train(cases.docs(spark, rows), labels, positives=25, unlabelled=28)
    import zlib

    assert sizes == [min(25, sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(30))), 28]


def test_descent_follows_the_slope_of_the_non_negative_risk(monkeypatch):
    rng = np.random.default_rng(4)
    positive, unlabelled = rng.normal(1, 1, (80, 5)), np.vstack([rng.normal(1, 1, (90, 5)), rng.normal(-1, 1, (60, 5))])
    p, u = (quality.ready(x, positive.mean(0), positive.std(0)) for x in (positive, unlabelled))
    loss = lambda z: np.log1p(np.exp(z))

    def parts(w, prior):
        """Risk of positives, and the negative part, row by row."""
        plus = prior * np.mean([loss(-(x @ w)) for x in p])
        return plus, np.mean([loss(x @ w) for x in u]) - prior * np.mean([loss(x @ w) for x in p])

    descend, seen = quality._descend, []
    monkeypatch.setattr(quality, "_descend", lambda gradient, size, steps: seen.append(gradient) or descend(gradient, size, steps))
    below = 0
    for prior in (0.3, 0.6, 0.9):
        model = quality.fit(positive, unlabelled, prior)
        found = np.append(model.weights, model.bias)
        assert sum(max(0.0, x) for x in parts(found, prior)) < sum(parts(np.zeros(6), prior))
        for at in (rng.normal(size=6) * 0.1, rng.normal(size=6), found, np.full(6, 1.5)):
            # where the negative part is below 0 the method goes against its slope, else down that of the whole risk
            negative = parts(at, prior)[1] < 0
            below += negative
            aim = lambda w, prior=prior, negative=negative: -parts(w, prior)[1] if negative else sum(parts(w, prior))
            slope = np.array([(aim(at + 1e-5 * d) - aim(at - 1e-5 * d)) / 2e-5 for d in np.eye(6)]) + 1e-4 * at
            assert np.allclose(seen[-1](at), slope, atol=1e-4)
    assert below


def test_the_descent_over_all_rows_lowers_the_risk_of_all_rows(spark):
    texts = [(k, cases.prose(k, 40) if k % 4 else "WORD!! " * (5 + k % 7)) for k in range(240)] + list(enumerate(cases.texts()))
    x = quality._batch([t for _, t in texts]).astype(float)
    positive = x[[k for k in range(240) if k % 4][:90]]
    kept = quality.with_features(spark.createDataFrame(texts, "id long, text string").select("text").repartition(5))
    assert sorted(map(tuple, quality._matrix(spark.createDataFrame([(t,) for _, t in texts], "text string")).tolist())) == sorted(map(tuple, x.tolist()))
    for prior in (0.4, 0.75):
        start = quality.fit(positive, x[:40], prior)
        u, p = quality.ready(x, start.mean, start.scale), quality.ready(positive, start.mean, start.scale)
        loss = lambda z: float(np.mean(np.logaddexp(0, z)))

        def standing(m):
            w = np.append(m.weights, m.bias)
            negative = loss(u @ w) - m.prior * loss(p @ w)
            return max(0.0, -negative), m.prior * loss(-p @ w) + max(0.0, negative) + 1e-4 / 2 * (w @ w)

        w = np.append(start.weights, start.bias)
        found, local = quality.sums_over(kept, start)([w, 2 * w]), [quality.Sums.of(u, w), quality.Sums.of(u, 2 * w)]
        assert all(np.allclose(a.flat(), b.flat()) for a, b in zip(found, local, strict=True))
        over_spark = quality.refine(start, positive, quality.sums_over(kept, start), passes=3)
        in_memory = quality.refine(start, positive, lambda tried: [quality.Sums.of(u, w) for w in tried], passes=3)
        assert np.allclose(over_spark.weights, in_memory.weights, atol=1e-5) and standing(over_spark) < standing(start), prior


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            out += [(kind, *m.span())] if good[kind] else []
    return out


def test_base_patterns_against_the_plain_ones():
    import random

    parts = ["a", "b@c.de", "@", ".", "@x.y", "1", "25", "255", "256", ".", "-", " ", "+", "+1 (555) 010-2030", "4111 1111 1111 1111", "4111111111111112", "1.2.3.4", "(", ")", "%", "é", "00"]
    for seed in range(6000):
        rng = random.Random(seed)
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute_spans(text), text


def pii_docs(spark):
    rows = [(k, f"{cases.prose(k, 20)} write zanzibar person{k % 3}@mail.example.com SecretWord{k % 3} {cases.prose(k + 40, 20)}") for k in range(500, 512)]
    rows += [(600, "1.2.3.4 and 4111 1111 1111 1111 and +1 555 010 2030"), (601, "9" * 6_000), (602, "a@" * 2000), (603, "zanzibar was an island " * 3)]
    return cases.docs(spark, [*enumerate(cases.texts()), *rows])


def test_spans_and_disclosing_terms(spark):
    docs = pii_docs(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    found = pii.spans(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        base = brute_spans(texts[r["doc_id"]])
        told = pii.joined(base)
        kinds = Counter(k for k, _, _ in base)
        assert [r[f"n_{k}"] for k in PATTERNS] == [kinds[k] for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest() and (r["spans"] + ",").startswith(told + "," if told else "")
        terms = {texts[r["doc_id"]][int(s) : int(e)] for s, e in re.findall(r"term:(\d+):(\d+)", r["spans"])}
        # a term that stands with one address only tells it; one that stands with all of them does not
        assert terms == ({f"SecretWord{r['doc_id'] % 3}"} if 500 <= r["doc_id"] < 512 else set())
    assert pii.spans(cases.empty(spark)).count() == 0


def brute_terms(texts, theta):
    """Spans of disclosing terms by text: every value against every word of all documents."""
    import math

    held = [(t, {(k, t[s:e].lower()) for k, s, e in brute_spans(t)}, set(common.alnum_words(t)), {w for s, e in pii.open_words(t or "", brute_spans(t)) for w in common.alnum_words(t[s:e])}) for t in texts]
    n_e, n_t, both = Counter(), Counter(), Counter()
    for _, values, words, free in held:
        n_e.update(values)
        n_t.update(words)
        both.update((e, w) for e in values for w in free)
    told = {w for (e, w), n in both.items() if n_e[e] < len(held) and math.log2(n * len(held) / (n_e[e] * n_t[w])) >= theta * math.log2(len(held) / n_e[e]) - 1e-9}
    return {t: [(m.start(), m.end()) for m in pii.WORD.finditer(t or "") if not any(s < m.end() and m.start() < e for _, s, e in brute_spans(t)) and told.intersection(common.alnum_words(m[0]))] for t, _, _, _ in held}


@pytest.mark.parametrize("theta", [0.5, 0.9])
def test_terms_of_values_seen_once_or_twice_anywhere_in_the_document(spark, theta):
    far = f"Rumpelstilz {cases.prose(700, 40)}"
    rows = [(700, f"{far} once@mail.example.com"), (701, f"Pimpernel {cases.prose(701, 40)} 10.11.12.13"), (702, f"10.11.12.13 {cases.prose(702, 40)} pimpernel"), (703, f"{cases.prose(703, 30)} {'w' * 90} 1.1.1.1 2.2.2.2 1.1.1.1x {cases.prose(704, 30)}")]
    rows += [(704, rows[-1][1]), (None, rows[0][1]), (705, f"10.11.12.13 1.1.1.1 {cases.prose(705, 9)}")]
    # a term that six documents with one value hold tells it in a seventh without the value too
    rows += [(710 + k, f"Codename {cases.prose(710 + k, 12)}" + " six@mail.example.com" * (k < 6)) for k in range(7)]
    docs = cases.docs(spark, [*enumerate(cases.texts()), *rows, *((r[0], r[1]) for r in pii_docs(spark).where("doc_id >= 500").collect())])
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    expected, found = brute_terms([t for _, t in texts], theta), {}
    for r in pii.spans(docs, theta=theta, min_support=1).collect():
        found.setdefault(r["doc_id"], set()).add(tuple((int(s), int(e)) for s, e in re.findall(r"term:(\d+):(\d+)", r["spans"])))
    assert all(found[i] == {tuple(expected[t]) for j, t in texts if j == i} for i, _ in texts)
    assert (0, 11) in expected[rows[0][1]] and (0, 9) in expected[rows[1][1]]
    # at half of the information a term of several values is one, at nine tenths it is not; the seventh's codename always is
    assert bool(expected["zanzibar was an island " * 3]) == (theta == 0.5) and (0, 8) in expected[rows[-1][1]]


def test_sanitise_generalises_and_keeps_the_rest(spark):
    docs = pii_docs(spark)
    before = {r["doc_id"]: r for r in docs.collect()}
    after = pii.sanitise(docs).collect()
    assert len(after) == docs.count()
    for r in after:
        old = before[r["doc_id"]]
        assert r.asDict().keys() == old.asDict().keys()
        if r["text"] is not None:
            assert not brute_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if 500 <= r["doc_id"] < 512:
            assert "[EMAIL] [TERM]" in r["text"] and "zanzibar" in r["text"]
        elif not brute_spans(old["text"]):
            assert r["text"] == old["text"]


def brute_classes(rows):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    to = {i: i for i in sets}

    def top(i):
        while to[i] != i:
            i = to[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                to[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def near_rows():
    import random

    rows = list(enumerate(cases.texts()))
    for group in range(6):
        words = cases.prose(900 + group, 70).split()
        for k in range(14):
            rng = random.Random(100 * group + k)
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(3)}"
            rows.append((1000 + 100 * group + k, " ".join(own)))
    return rows


def test_classes_against_brute_force(spark):
    rows = near_rows()
    want = brute_classes(rows)
    found = neardup.near_duplicates(cases.docs(spark, [*rows, (None, rows[3][1])])).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert neardup.near_duplicates(cases.empty(spark)).count() == 0


def test_family_around_one_text_with_many_members_that_link_with_nothing(spark):
    import random

    words = cases.prose(77, 150).split()
    rows = [(3000, " ".join(words))]
    for k in range(260):
        rng, own = random.Random(k), list(words)
        for _ in range(k % 13):
            own[rng.randrange(len(own))] = f"w{rng.randrange(6)}"
        rows.append((2000 + k, " ".join(own if k % 5 else own[: 150 - rng.randrange(40)])))
    want = brute_classes(rows)
    sizes = Counter(c for _, c in want.values())
    assert sizes.most_common(1)[0][1] > 60 and sum(n == 1 for n in sizes.values()) > 60
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want


def test_an_id_is_one_document_whatever_texts_it_repeats_with(spark):
    one, two, other = cases.prose(60, 40), cases.prose(61, 40), cases.prose(62, 40)
    rows = [(5, one), (5, two), (3, f"{one} end"), (8, two), (9, other), (9, other), (9, other), (None, one), (4, ""), (4, None), (6, "a b"), (6, "c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(5, 3), (3, 3), (8, 3), (9, 9), (None, None), (4, 4), (6, 6)}
    clash = docs.withColumns({c: F.lit("x") for c in ("gone", "gone_", "_gone", "k", "kept", "component_id", "a", "b")})
    left = neardup.deduplicate(clash)
    assert left.columns == clash.columns and {r["gone"] for r in left.collect()} == {"x"}
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(3, f"{one} end"), (9, other), (None, one), (4, ""), (6, "a b")], key=str)
    assert neardup.deduplicate(clash.limit(0)).count() == 0


def test_sketches_tell_high_similarities():
    rng = np.random.default_rng(3)
    for shared in (0.75, 0.85, 0.95):
        told, least = [], []
        for _ in range(60):
            n = 600
            both = int(2 * n * shared / (1 + shared))
            x = rng.integers(0, 1 << 63, 2 * n - both, np.uint64)
            a, b = (neardup.odd_sketch(neardup.min_hashes(np.sort(s))) for s in (x[:n], x[n - both :]))
            ones = sum(int(v).bit_count() if v >= 0 else int(v + (1 << 64)).bit_count() for v in map(int, a ^ b))
            told.append(neardup.sketch_similarity(ones))
            least.append(ones)
        assert abs(np.mean(told) - shared) < 0.02 and max(least) <= neardup.most_ones()


def test_long_chains_of_links_become_one_class(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 200), (200, 150)], "a long, b long")
    found = {r["id"]: r["component"] for r in neardup.classes(edges).collect()}
    assert found == {k: 0 for k in range(61)} | {100: 100, 150: 100, 200: 100}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows = [*near_rows(), (5000, f"{cases.prose(70, 50)} {cases.prose(6, 30)} {cases.prose(71, 50)} mail a@b.cd")]
    rows += [(6000 + k, "JUNK!! " * 30) for k in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], cases.SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, cases.prose(6, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, int(i < 6000), 0) for i, t in rows if t and len(t) > 40]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_stages_take_effect(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = common.checkpointed(stage(spark, docs, corpus))
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        held[name] = (before, after)
    before, after = held["quality_classifier"]
    assert not [i for i in after if i >= 6000] and all(i in after for i in before if 1000 <= i < 6000)
    before, after = held["near_dedup"]
    assert set(after) == {i for i, (_, c) in brute_classes(before.items()).items() if c == i} and all(after[i] == before[i] for i in after)
    before, after = held["decontamination"]
    assert after[5000] != before[5000] and "mail a@b.cd" in after[5000]
    before, after = held["pii"]
    assert "mail [EMAIL]" in after[5000]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, corpus)
    assert Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == Counter(list(after))
    assert sorted(map(tuple, corpus_pipeline.run(spark, corpus).drop("sequence_id", "offset").collect())) == sorted(map(tuple, packed.drop("sequence_id", "offset").collect()))


def test_pipeline_stages_on_awkward_rows_and_clashing_names(spark, corpus):
    names = ("quality", "_quality", "gone", "_gone", "_d", "_h", "terms", "_terms", "doc", "text_hash", "row", "held", "cleaned", "_key", "score", "id", "n", "kept", "_salt", "_row", "_rank", "length")
    made = cases.docs(spark, [*enumerate(cases.texts()), (None, cases.prose(44, 30)), (None, None), (7, "a@b.cd wrote"), (7, "a@b.cd wrote")])
    made = made.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    for docs in (made, made.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, corpus)
            assert out.columns == docs.columns
            assert {tuple(r[c] for c in names) for r in out.collect()} <= {tuple(range(len(names)))}
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, corpus)
        assert packed.where("piece = 0").count() == docs.count()
