"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled rows outside the held-out third; the unlabelled set is the web text itself, without its
labels. A first model that tells positives from unlabelled text orders the documents; a low ratio of the corpus's to the
positives' mass above any of its thresholds, counted over all documents, estimates the class prior. The second model
minimises the risk pi*R_p(+) + max(0, R_u(-) - pi*R_p(-)). Both start from a bounded sample (the rows with the smallest
hashes of their ids); then Newton steps on the risk follow whose unlabelled part is summed over all documents, so the
sample decides only where the descent begins. Only the trusted positives stay a bounded sample. Scores are given to every
row. Features are shares of character and word classes of the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import checkpointed, slices

#: Rows of the training sample: trusted positives, and the unlabelled text that the descent over all text starts from.
SAMPLE_POSITIVE = 4_000
SAMPLE_UNLABELLED = 8_000
#: Characters whose shares of a text are features, class by class.
CLASSES = tuple(map(str.encode, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*@^~_=+", "|<>{}[]\\/", "!", "?", ".", ",;:", "\"'()-", " \t", "\n")))
LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256))
FEATURES = len(CLASSES) + 8
CLIP = 8.0
#: Most passes over all documents' features, and the shares of a Newton step that one pass tries.
PASSES = 8
STRIDES = (1.0, 0.5, 0.25, 0.0625)


def features(text: str | None) -> list[float]:
    """Shares and ratios of one text; all 0 for a null or empty one."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * FEATURES
    n, k = len(raw), len(words)
    lines = raw.split(b"\n")
    shares = [(n - len(raw.translate(None, c))) / n for c in CLASSES]
    return [
        *shares,
        len(raw.translate(None, LETTERS)) / n,
        sum(map(eq, words, words[1:])) / k,
        sum(map(eq, words, words[2:])) / k,
        1 - len(set(words)) / k,
        1 - len(set(lines)) / len(lines),
        min(n / k, 40.0) / 10,
        float(np.log1p(k)) / 10,
        raw.count(b"!!") / k,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _descend(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam on a full-batch gradient."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def ready(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((x - mean) / scale, -CLIP, CLIP), np.ones((len(x), 1))])


def separate(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, ridge: float = 1e-4) -> Model:
    """A logistic model of positives against unlabelled rows, to order documents by."""
    mean, scale = positive.mean(0), np.maximum(positive.std(0), 1e-3)
    p, u = ready(positive, mean, scale), ready(unlabelled, mean, scale)
    w = _descend(lambda w: -p.T @ _sigmoid(-p @ w) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + ridge * w, p.shape[1], steps)
    return Model(mean, scale, w[:-1], float(w[-1]), 0.5)


def thresholds(margins: np.ndarray) -> np.ndarray:
    """Margins that keep from all to half of the positives."""
    return np.quantile(margins, np.linspace(0.0, 0.5, 51))


def estimate_prior(positive: np.ndarray, share_above: np.ndarray) -> float:
    """A low quantile of the ratios of the corpus's to the positives' share at or above each threshold."""
    own = np.array([(positive >= c).mean() for c in thresholds(positive)])
    return float(np.clip(np.quantile(share_above / own, 0.1), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, ridge: float = 1e-4) -> Model:
    """The classifier of least non-negative unbiased risk; without positives or unlabelled rows every score is 0.5."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 0.5)
    mean, scale = positive.mean(0), np.maximum(positive.std(0), 1e-3)
    p, u = ready(positive, mean, scale), ready(unlabelled, mean, scale)

    def risk(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_negative = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
        as_positive = -prior * (p.T @ _sigmoid(-zp)) / len(p)
        return (as_positive + as_negative if negative >= 0 else -as_negative) + ridge * w

    w = _descend(risk, p.shape[1], steps)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


@dataclass
class Sums:
    """Over unlabelled rows: their number, sum of losses as negatives, its gradient and its curvature."""

    rows: float
    loss: float
    gradient: np.ndarray
    curvature: np.ndarray

    @staticmethod
    def of(u: np.ndarray, w: np.ndarray) -> Sums:
        z = u @ w
        s = _sigmoid(z)
        return Sums(len(u), float(np.logaddexp(0, z).sum()), u.T @ s, (u * (s * (1 - s))[:, None]).T @ u)

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.rows, self.loss], self.gradient, self.curvature.ravel()])

    @staticmethod
    def unflat(x: np.ndarray, size: int) -> Sums:
        return Sums(x[0], x[1], x[2 : 2 + size], x[2 + size :].reshape(size, size))


def refine(model: Model, positive: np.ndarray, sums: Callable[[list[np.ndarray]], list[Sums]], passes: int = PASSES, ridge: float = 1e-4) -> Model:
    """Newton steps on the non-negative risk from ``model``; ``sums`` adds up all unlabelled rows at several weights in one pass.

    Of the shares of a step that with the least risk is taken, first of those whose negative part is not below 0; where
    the model itself is below 0, the step goes against the slope of that part. A second direction leaves that part as it
    is. No better share of either ends the descent.
    """
    p, prior = ready(positive, model.mean, model.scale), model.prior

    def standing(w: np.ndarray, s: Sums) -> tuple[float, float]:
        z = p @ w
        negative = s.loss / s.rows - prior * np.logaddexp(0, z).mean()
        return max(0.0, -negative), prior * np.logaddexp(0, -z).mean() + max(0.0, negative) + ridge / 2 * (w @ w)

    w = np.append(model.weights, model.bias)
    here = sums([w])[0]
    for _ in range(passes):
        below, risk = standing(w, here)
        as_negative = here.gradient / here.rows - prior * (p.T @ _sigmoid(p @ w)) / len(p)
        as_positive = -prior * (p.T @ _sigmoid(-(p @ w))) / len(p)
        slope = -as_negative if below else as_positive + as_negative + ridge * w
        step, across = np.linalg.solve(here.curvature / here.rows + ridge * np.eye(len(w)), np.stack([slope, as_negative], 1)).T
        # the second direction leaves the negative part as it is, to go on where that part is 0
        along = step - across * (as_negative @ step) / max(as_negative @ across, 1e-12)
        tried = [w - share * d for d in (step, along) for share in STRIDES]
        (below_then, risk_then), k, found = min(((standing(t, s), k, s) for k, (t, s) in enumerate(zip(tried, sums(tried), strict=True))), key=lambda x: x[:2])
        if (below_then, risk_then + 1e-9) >= (below, risk):
            break
        w, here = tried[k], found
    # sums come in any order: what differs by it is rounded away
    w = np.round(w, 7)
    return Model(model.mean, model.scale, w[:-1], float(w[-1]), prior)


def held_out(doc_id: Column) -> Column:
    """Rows of which no label is learnt."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _batch(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float32).reshape(len(texts), FEATURES)


def with_features(texts: DataFrame) -> DataFrame:
    """x: the features of each row's text, the one column of ``texts``."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = _batch(part.column(0).to_pylist())
            ends = pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["x"])

    return texts.mapInArrow(run, "x array<float>")


def _arrays(batches) -> Iterator[np.ndarray]:
    """Features kept in a table, as matrices of a bounded number of rows."""
    for part in slices(batches, 4096):
        if part.num_rows:
            yield part.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, FEATURES)


def _matrix(rows: DataFrame) -> np.ndarray:
    """Features of a bounded sample of texts, on the driver."""
    found = [r["x"] for r in with_features(rows).collect()]
    return np.array(sorted(found)) if found else np.zeros((0, FEATURES))


def _added(kept: DataFrame, add: Callable[[Iterator[np.ndarray]], np.ndarray]) -> np.ndarray:
    """Sum over all tasks of the vector that each makes of its rows; a task sends one row for each place of it."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = add(_arrays(batches))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], names=["at", "v"])

    held = {r["at"]: r["v"] for r in kept.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    return np.array([held[k] for k in range(len(held))])


def shares_above(kept: DataFrame, model: Model, cuts: np.ndarray) -> np.ndarray:
    """Share of all documents, given by their features, with a margin at or above each cut."""

    def add(parts: Iterator[np.ndarray]) -> np.ndarray:
        above = np.zeros(len(cuts) + 1)
        for x in parts:
            margins = np.sort(model.margin(x))
            above += np.append(len(margins) - np.searchsorted(margins, cuts), len(margins))
        return above

    found = _added(kept, add)
    return found[:-1] / max(1.0, found[-1])


def sums_over(kept: DataFrame, model: Model) -> Callable[[list[np.ndarray]], list[Sums]]:
    """What ``refine`` asks for: sums over all documents at each of the weights, in one pass."""
    size = FEATURES + 1

    def at(tried: list[np.ndarray]) -> list[Sums]:
        def add(parts: Iterator[np.ndarray]) -> np.ndarray:
            total = np.zeros((len(tried), 2 + size + size * size))
            for x in parts:
                u = ready(x, model.mean, model.scale)
                total += np.array([Sums.of(u, w).flat() for w in tried])
            return total.ravel()

        return [Sums.unflat(x, size) for x in _added(kept, add).reshape(len(tried), -1)]

    return at


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = SAMPLE_POSITIVE, unlabelled: int = SAMPLE_UNLABELLED) -> Model:
    """Starts from at most ``positives`` trusted ids and ``unlabelled`` ids of the corpus, those with the smallest hashes, one row of each.

    Of an id's rows the one with the least text is taken. The class prior and the unlabelled part of the risk are taken
    over all documents, every row of them, whose features are kept in the shared folder for the passes.
    """
    ids = docs.select(docs[id_col].alias("id"))
    order = lambda seed: F.xxhash64(F.col("id"), F.lit(seed))
    trusted = labels.where((labels["quality"] == 1) & ~held_out(labels[id_col])).select(labels[id_col].alias("id")).distinct().orderBy(order(1), "id").limit(positives)
    crowd = ids.where("id IS NOT NULL").distinct().orderBy(order(2), "id").limit(unlabelled)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    pick = lambda chosen: _matrix(texts.join(F.broadcast(chosen), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")).select("text"))
    p, u = pick(trusted), pick(crowd)
    if not len(p) or not len(u):
        return fit(p, u, 0.5)
    kept = checkpointed(with_features(docs.select(docs[text_col].alias("text"))))
    first = separate(p, u)
    margins = first.margin(p)
    model = fit(p, u, estimate_prior(margins, shares_above(kept, first, thresholds(margins))))
    return refine(model, p, sums_over(kept, model))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row, empty and null texts too; a column of that name is replaced."""
    base = docs.drop(score_col)

    def run(batches):
        for part in slices(batches):
            texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
            scores = model.score(_batch(texts)) if texts else []
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, score_col])

    schema = base.schema
    return base.mapInArrow(run, type(schema)(list(schema.fields)).add(score_col, "double"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    scored = with_score(narrow, train(docs, labels, id_col, text_col), "text", "score")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
