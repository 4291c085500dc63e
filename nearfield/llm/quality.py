"""Quality classification by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1, the unlabelled set is a sample of all documents. A linear model
over hashed character n-gram presence and shape statistics minimises the non-negative unbiased risk
    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])
with the sigmoid loss. The class prior is estimated: with a first model's outputs it is the smallest ratio of the
shares of unlabelled and held-back positive rows above a cut. Scores are then calibrated on labelled training rows.
Every sample is bounded by Settings; all rows are scored by whole text. Null texts count as empty, and empty texts are scored
like others. A doc_id that repeats in labels is learned from once for each label, with one of its texts (the one whose features
sort first); repeated rows are scored alike. Very long texts are sets of n-grams and statistics like others. Without labelled
positives, or with empty tables, there is no model and all texts score 1/2. Columns named score and predicted are replaced; others
but the text stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import map_slices, unit_hash
from nearfield.llm.grams import held_out, presence


@dataclass(frozen=True)
class Settings:
    longest: int = 3
    bits: int = 12
    #: Rows to learn from; these bound what is broadcast and what the driver gets.
    positives: int = 2400
    unlabelled: int = 4800
    negatives: int = 800
    #: The estimate is an upper bound, which few rows leave above 1; a prior of 1 would say that nothing is negative, and teach nothing.
    most_prior: float = 0.95
    epochs: int = 60
    batch: int = 512
    rate: float = 0.01
    seed: int = 7


SHAPES = 14


def shape(text: str) -> list[float]:
    """Statistics of form, each roughly between 0 and 1."""
    n = max(1, len(text))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    words = text.split()
    lines = text.split("\n")
    w = max(1, len(words))
    letters = sum(map(len, words)) or 1
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    lower = int(((codes >= 97) & (codes <= 122)).sum())
    digit = int(((codes >= 48) & (codes <= 57)).sum())
    stop = int(((codes == 46) | (codes == 44)).sum())
    symbol = int(((codes > 32) & (codes < 127)).sum()) - upper - lower - digit - stop
    return [
        min(1, np.log1p(len(text)) / 12), min(1, np.log1p(len(words)) / 10), min(1, letters / w / 20), upper / n, digit / n, stop / n, symbol / n,
        len(set(words)) / w, len(set(lines)) / len(lines), min(1, n / len(lines) / 1000), min(1, upper / max(1, upper + lower)),
        sum(x[-1:] in ".!?\"'" for x in lines) / len(lines), sum(len(x) < 20 for x in lines) / len(lines), sum(not x.isalpha() for x in words) / w,
    ]


def packed(text: str | None, s: Settings) -> bytes:
    """Presence bits, then the statistics."""
    text = text or ""
    return np.packbits(presence(text, s.longest, s.bits)).tobytes() + np.array(shape(text), np.float32).tobytes()


def unpacked(data: bytes, s: Settings) -> np.ndarray:
    cut = (1 << s.bits) // 8
    seen = np.unpackbits(np.frombuffer(data[:cut], np.uint8)).astype(np.float32)
    seen *= np.float32(1 / np.sqrt(max(1, np.count_nonzero(seen))))
    return np.concatenate([seen, np.frombuffer(data[cut:], np.float32), np.ones(1, np.float32)])


def features(text: str | None, s: Settings) -> np.ndarray:
    return unpacked(packed(text, s), s)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float
    slope: float
    offset: float
    settings: Settings

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.offset, -30, 30)))


def _minimise(p: np.ndarray, u: np.ndarray, prior: float, s: Settings) -> np.ndarray:
    """Adam on the non-negative risk; where the part in max() is negative, a step is taken that raises it."""
    rng = np.random.default_rng(s.seed)
    w, m, v, t = *(np.zeros(p.shape[1], np.float32) for _ in range(3)), 0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    n_batches = max(1, len(u) // s.batch)
    for _ in range(s.epochs):
        for a, b in zip(np.array_split(rng.permutation(len(p)), n_batches), np.array_split(rng.permutation(len(u)), n_batches), strict=True):
            xp, xu = (p[a] if len(a) else p), u[b]
            sp, su = sig(xp @ w), sig(xu @ w)  # the loss of label -1; that of label 1 is one less it
            rest = su.mean() - prior * sp.mean()
            dp, du = (sp * (1 - sp)) @ xp / len(xp), (su * (1 - su)) @ xu / len(xu)
            g = -prior * dp + du - prior * dp if rest >= 0 else -(du - prior * dp)
            g = g + 1e-4 * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = (w - s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, most: float = 0.95) -> float:
    """Outputs of held-back positives and of unlabelled rows; the share of positives among the latter, from the best cut, and at most
    `most`."""
    best = 1.0
    n_p, n_u = len(positive), len(unlabelled)
    for cut in np.quantile(positive, np.linspace(0, 0.9, 46)):
        share_p, share_u = (positive >= cut).mean(), (unlabelled >= cut).mean()
        best = min(best, (share_u + np.sqrt(np.log(20) / (2 * n_u))) / max(1e-9, share_p - np.sqrt(np.log(20) / (2 * n_p)))) if share_p > 0.1 else best
    return float(min(most, best))


def fit(positive: np.ndarray, unlabelled: np.ndarray, negative: np.ndarray, s: Settings) -> Model:
    mean, deviation = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = 1 / np.where(deviation > 1e-6, np.maximum(deviation, 0.01), 1)
    mean, scale = mean.copy(), scale / np.sqrt(len(mean))
    shapes = slice(len(mean) - SHAPES - 1, len(mean) - 1)
    scale[shapes] *= 1.5 * np.sqrt(len(mean) / SHAPES)  # few and telling, against thousands of n-grams
    mean[-1], scale[-1] = 0, 1
    mean, scale = mean.astype(np.float32), scale.astype(np.float32)

    def to(x: np.ndarray) -> np.ndarray:
        x -= mean  # in place: samples are the driver's largest arrays
        x *= scale
        return x

    p, u = to(positive), to(unlabelled)
    cut = max(1, len(p) * 7 // 10)
    back = p[cut:] if len(p) > cut else p
    w = _minimise(p[:cut], u, 0.7, s)
    prior = estimate_prior(back @ w, u @ w, s.most_prior)
    w = _minimise(p, u, prior, s)
    slope, offset = 1.0, 0.85  # without labelled negatives: the boundary scores 0.7
    if len(negative) >= 5:
        z, y = np.concatenate([p @ w, to(negative) @ w]).astype(float), np.repeat([1.0, 0.0], [len(p), len(negative)])
        weight = np.where(y == 1, 0.5 / len(p), 0.5 / len(negative))
        spread = float(z.std()) or 1.0
        a, b = 1.0, 0.0
        for _ in range(300):  # logistic regression on one balanced variable
            q = 1 / (1 + np.exp(-np.clip(a * z / spread + b, -30, 30)))
            a, b = a - 4 * ((weight * (q - y)) @ z / spread + 1e-4 * a), b - 4 * (weight @ (q - y))
        slope, offset = max(a, 1e-3) / spread, b + 0.85  # the balanced boundary scores 0.7
    return Model(w, mean, scale, prior, float(slope), float(offset), s)


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model | None:
    """Learns from rows that are not held out; samples are taken by hash of the id, labels first, so only small tables are broadcast."""

    def make():
        return lambda r: {"kind": r["kind"], "u": r["u"], "x": [packed(t, s) for t in r["text"]]}

    def sample(rows: DataFrame, n: int, most: int) -> DataFrame:
        return rows.filter(F.col("u") < most / max(1, n))

    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").alias("kind"), unit_hash("doc_id", seed="quality").alias("u"))
    known = known.distinct()
    counts = {r[0]: r[1] for r in known.groupBy("kind").count().collect()}
    if not counts.get(1):
        return None
    chosen = sample(known.filter("kind = 1"), counts[1], s.positives).union(sample(known.filter("kind = 0"), counts.get(0, 0), s.negatives))
    texts = docs.filter(~held_out()).select("doc_id", "text")
    free = texts.withColumn("u", unit_hash("doc_id", "text", seed="unlabelled"))
    free = sample(free, texts.count(), s.unlabelled).select(F.lit(2).alias("kind"), "u", "text")
    # drawn by hash of the id, so at most about positives + negatives ids once each is one row
    rows = texts.join(F.broadcast(chosen.distinct()), "doc_id").select("kind", "u", "text").union(free)
    drawn = map_slices(rows, make, "kind int, u double, x binary").groupBy("kind", "u").agg(F.min("x").alias("x"))
    got = sorted(drawn.collect(), key=lambda r: (r.kind, r.u, bytes(r.x)))

    def of(kind: int) -> np.ndarray:
        rows = [r.x for r in got if r.kind == kind]
        out = np.empty((len(rows), (1 << s.bits) + SHAPES + 1), np.float32)
        for i, x in enumerate(rows):
            out[i] = unpacked(bytes(x), s)
        return out

    positive, unlabelled, negative = of(1), of(2), of(0)
    return fit(positive, unlabelled, negative, s) if len(positive) and len(unlabelled) else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold), replacing columns of these names. Without a model all score 1/2."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept if c != text), "score double, predicted int"])

    def make():
        m = sent.value

        def each(rows: dict[str, list]) -> dict[str, list]:
            got = m.score(np.stack([features(t, m.settings) for t in rows[text]])).tolist() if m else [0.5] * len(rows[text])
            return {c: rows[c] for c in kept if c != text} | {"score": got, "predicted": [int(x >= threshold) for x in got]}

        return each

    return map_slices(docs.select(*kept), make, schema)
