"""Language identification with string kernels.

The kernel of two texts is the number of n-grams of 1 to `longest` characters (blended spectrum) that both hold,
over the root of the product of their own numbers (presence, not counts). A bounded sample of labelled rows gives
Nystroem landmarks and a one-versus-rest kernel ridge regression. As the kernel is a dot product of presence
vectors, landmarks and coefficients fold into one matrix, and texts are scored by a product of matrices per batch.
N-grams are hashed into 2**bits buckets, the same for all texts, so the kernel is exact on buckets.

The scores of a text sum to 1, so the best is never under 1 / languages. What rejects a text is how far its score is
from that of a text without any known n-gram towards that of training rows of the language.

Null and empty texts and texts without a letter are `und` with score 0. If nothing can be learned (an empty table, or no
labels), all are `und`. Of equal scores the language that sorts first wins. Repeated rows are learned from once and predicted
alike; the same text under two languages is an example of both. Very long texts are sets of n-grams like others. Columns named
lang_pred and score are replaced by predict() and kept by accepted(); others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import map_slices, unit_hash
from nearfield.llm.grams import held_out, presence

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    longest: int = 3
    bits: int = 16
    #: Labelled texts a language to learn from, about, and how many of them are landmarks.
    per_language: int = 240
    landmarks: int = 48
    #: Where languages are many, they share so many texts and landmarks, but each has some. This bounds what the driver gets.
    texts: int = 4800
    marks: int = 960
    least: int = 4
    ridge: float = 1e-3


@dataclass(frozen=True)
class Model:
    languages: list[str]
    columns: np.ndarray  # buckets that any landmark has
    weights: np.ndarray  # columns x languages
    bias: np.ndarray  # the values of a text without a known n-gram
    settings: Settings
    usual: np.ndarray  # the value for its own language that 99 % of a language's training rows reach


def features(text: str, s: Settings) -> np.ndarray:
    return presence(text.lower(), s.longest, s.bits)


def kernel_ridge(seen: np.ndarray, labels: np.ndarray, landmark: np.ndarray, s: Settings, languages: list[str]) -> Model:
    """seen: rows x buckets as packed bits; landmark: which rows are landmarks."""
    bits = lambda rows: np.unpackbits(rows, axis=1, count=1 << s.bits)
    any_mark = np.bitwise_or.reduce(seen[landmark], axis=0)
    columns = np.flatnonzero(bits(any_mark[None])[0])
    parts = (bits(seen[i : i + 256]) for i in range(0, len(seen), 256))
    size = np.sqrt(np.maximum(np.bitwise_count(seen).sum(axis=1), 1)).astype(np.float64)
    marks = np.concatenate([bits(seen[landmark[i : i + 256]])[:, columns].astype(np.float32) for i in range(0, len(landmark), 256)]) / size[landmark, None].astype(np.float32)
    k_nm = np.concatenate([x[:, columns].astype(np.float32) @ marks.T for x in parts]).astype(np.float64) / size[:, None]
    values, vectors = np.linalg.eigh(k_nm[landmark])
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = k_nm @ root
    target = np.where(labels[:, None] == np.arange(len(languages))[None], 1.0, -1.0)
    mean_phi, mean_y = phi.mean(axis=0), target.mean(axis=0)
    centred = phi - mean_phi
    w = np.linalg.solve(centred.T @ centred + s.ridge * len(phi) * np.eye(phi.shape[1]), centred.T @ (target - mean_y))
    own = centred @ w + mean_y
    usual = np.array([np.quantile(own[labels == i, i], 0.01) if (labels == i).any() else 1.0 for i in range(len(languages))])
    return Model(languages, columns, (marks.T.astype(np.float64) @ (root @ w)).astype(np.float32), mean_y - mean_phi @ w, s, usual)


def train(docs: DataFrame, s: Settings = Settings()) -> Model | None:
    """Learns from rows with text and lang that are not held out; about per_language texts each, chosen by hash."""
    rows = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out()).select("lang", "text", unit_hash("text", seed="langid").alias("u"))
    counts = sorted((r[0], r[1]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("u")).collect())  # a row a language
    if not counts:
        return None
    languages = [x for x, _ in counts]
    most = max(s.least, min(s.per_language, s.texts // len(languages)))
    share = F.create_map(*[F.lit(x) for name, n in counts for x in (name, most / max(1, n))])

    def make():
        return lambda x: {"lang": x["lang"], "u": x["u"], "seen": [np.packbits(features(t, s)).tobytes() for t in x["text"]]}

    chosen = map_slices(rows.filter(F.col("u") < share[F.col("lang")]), make, "lang string, u double, seen binary").groupBy("lang", "u").agg(F.min("seen").alias("seen"))
    got = sorted(chosen.collect(), key=lambda r: (r.lang, r.u, bytes(r.seen)))
    if not got:
        return None
    seen = np.stack([np.frombuffer(r.seen, np.uint8) for r in got])
    at = {name: i for i, name in enumerate(languages)}
    labels = np.array([at[r.lang] for r in got])
    marks = max(s.least, min(s.landmarks, s.marks // len(languages)))
    landmark = np.concatenate([np.flatnonzero(labels == i)[:marks] for i in range(len(languages))])
    return kernel_ridge(seen, labels, landmark, s, languages)


def scores(texts: list[str], model: Model) -> np.ndarray:
    """One row a text: the regression's value for each language."""
    hold = np.empty((len(texts), len(model.columns)), np.float32)
    size = np.empty(len(texts))
    for i, text in enumerate(texts):
        seen = features(text, model.settings)
        hold[i] = seen[model.columns]
        size[i] = max(1, np.count_nonzero(seen))
    return hold @ model.weights / np.sqrt(size)[:, None] + model.bias


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1: 1/2 is the regression's decision boundary), replacing columns of these names."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "lang_pred string, score double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**bits x languages numbers

    def make():
        m = sent.value

        def each(rows: dict[str, list]) -> dict[str, list]:
            n = len(rows[text])
            names, values = [UNKNOWN] * n, [0.0] * n
            if m is not None:
                known = [i for i, t in enumerate(rows[text]) if t and any(map(str.isalpha, t))]
                if known:
                    f = scores([rows[text][i] for i in known], m)
                    for i, k, v in zip(known, f.argmax(axis=1), f.max(axis=1), strict=True):
                        names[i], values[i] = m.languages[k], min(1.0, max(0.0, (float(v) + 1) / 2))
            return {c: rows[c] for c in kept} | {"lang_pred": names, "score": values}

        return each

    return map_slices(docs.select(*kept), make, schema)


def least_scores(model: Model, least: float) -> dict[str, float]:
    """For each language the score at this part of the way from a text without a known n-gram to training rows."""
    at = model.bias + least * np.maximum(model.usual - model.bias, 0)
    return {name: (float(v) + 1) / 2 - 1e-6 for name, v in zip(model.languages, at, strict=True)}


def accepted(docs: DataFrame, model: Model | None, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs whose language is known: not `und`, and the score is at least that of least_scores()."""
    rows = predict(docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns if c in ("lang_pred", "score")}), model, text)
    enough = F.lit(False)
    if model is not None:
        enough = F.col("score") >= F.create_map(*[F.lit(x) for pair in least_scores(model, least).items() for x in pair])[F.col("lang_pred")]
    return rows.filter((F.col("lang_pred") != UNKNOWN) & enough).drop("lang_pred", "score").toDF(*docs.columns)
