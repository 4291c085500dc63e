"""Fitted codes for vectors: scalar, uniform, half precision, product and one-bit quantizers, and transforms.

fit_* return small model objects; encode and decode are column expressions or Arrow functions over them. decoder() makes a function
for tasks that search codes: from an Arrow column of codes to a matrix, and squared lengths where these are known better.
"""

from __future__ import annotations

from dataclasses import dataclass

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.errors import InvalidArgument

EPSILON = 1e-12


@dataclass(frozen=True)
class Scalar:
    """low and width for each dimension, or one of each (uniform)."""

    low: list[float]
    width: list[float]
    bits: int

    @property
    def top(self) -> int:
        return (1 << self.bits) - 1

    def _model(self, v: Column) -> tuple[Column, Column]:
        if len(self.low) == 1:
            return (F.array_repeat(F.lit(x[0]), F.size(v)) for x in (self.low, self.width))
        return (F.array(*map(F.lit, x)) for x in (self.low, self.width))

    def encode(self, v: Column) -> Column:
        """Integers 0 .. top: the share of the range, cut to it and rounded down; a dimension without range gives top."""
        low, width = self._model(v)
        share = F.zip_with(F.zip_with(v, low, lambda x, l: x.cast("double") - l), width, lambda x, w: F.when(w < EPSILON, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / w))))
        return F.transform(share, lambda s: F.floor(s * self.top).cast("int"))

    def decode(self, c: Column) -> Column:
        low, width = self._model(c)
        return F.zip_with(F.zip_with(c, width, lambda x, w: x / self.top * w), low, lambda x, l: x + l)


    def decoder(self):
        low, width, top = np.array(self.low), np.array(self.width), self.top
        return lambda codes: (_matrix(codes) / top * width + low, None)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def drawn(vectors: DataFrame, most: int | None, seed: int = 42) -> DataFrame:
    """About `most` rows to train on, by hash of the id; all if None or if there are no more."""
    n = vectors.count() if most else 0
    if not most or n <= most:
        return vectors
    return vectors.filter(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) * F.lit(2.0**-53) < most / n)


def fit_scalar(vectors: DataFrame, bits: int = 8) -> Scalar:
    rows = vectors.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi")).orderBy("at").collect()
    return Scalar([r.lo for r in rows], [r.hi - r.lo for r in rows], bits)


def fit_uniform(vectors: DataFrame, bits: int = 8, tail: float = 0.0) -> Scalar:
    """One range for all dimensions; tail: the share of values cut off at each end."""
    x = vectors.select(F.explode(F.col("vector").cast("array<double>")).alias("x"))
    if tail:
        lo, hi = x.agg(F.percentile("x", tail), F.percentile("x", 1 - tail)).first()
    else:
        lo, hi = x.agg(F.min("x"), F.max("x")).first()
    return Scalar([lo], [hi - lo], bits)


def _flat(s: pd.Series) -> tuple[np.ndarray, list[int]]:
    return (np.concatenate([np.asarray(a, np.float32) for a in s]) if len(s) else np.zeros(0, np.float32)), [len(a) for a in s]


def _split(flat: np.ndarray, sizes: list[int]) -> pd.Series:
    return pd.Series(np.split(flat, np.cumsum(sizes)[:-1]) if sizes else [], dtype=object)


def bf16(v: Column) -> Column:
    """Values with the low 16 bits of their float32 form cut off."""

    @F.pandas_udf("array<double>")
    def cut(s: pd.Series) -> pd.Series:
        flat, sizes = _flat(s)
        return _split((flat.view(np.uint32) & np.uint32(0xFFFF0000)).view(np.float32).astype(float), sizes)

    return cut(v)


def fp16(v: Column) -> Column:
    """Values rounded to IEEE half precision."""

    @F.pandas_udf("array<double>")
    def cut(s: pd.Series) -> pd.Series:
        flat, sizes = _flat(s)
        return _split(flat.astype(np.float16).astype(float), sizes)

    return cut(v)


def int8(v: Column, by: float = 127.0) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(x.cast("double") * by))).cast("byte"))


def leading(v: Column, n: int, renormalize: bool = False) -> Column:
    """The first n dimensions, for cosine brought to length 1 again."""
    from nearfield.functions.distance import normalize

    cut = F.slice(v, 1, n)
    return normalize(cut) if renormalize else F.transform(cut, lambda x: x.cast("double"))


@dataclass(frozen=True)
class Product:
    """centroids: parts x centres x dimensions of a part."""

    centroids: np.ndarray

    def encode(self, v: Column) -> Column:
        c = self.centroids

        @F.pandas_udf("array<int>")
        def run(s: pd.Series) -> pd.Series:
            if not len(s):
                return pd.Series([], dtype=object)
            x = np.stack(s.to_numpy()).astype(float).reshape(len(s), len(c), -1)
            step = max(1, (1 << 20) // c.size)  # rows x parts x centres x dimensions at a time
            return pd.Series([r.tolist() for at in range(0, len(x), step) for r in ((x[at : at + step, :, None] - c[None]) ** 2).sum(axis=3).argmin(axis=2)])

        return run(v)

    def decode(self, codes: Column) -> Column:
        c = self.centroids

        @F.pandas_udf("array<double>")
        def run(s: pd.Series) -> pd.Series:
            if not len(s):
                return pd.Series([], dtype=object)
            return pd.Series(list(c[np.arange(len(c))[None], np.stack(s.to_numpy())].reshape(len(s), -1)))

        return run(codes)

    def decoder(self):
        c = self.centroids
        return lambda codes: (c[np.arange(len(c))[None], _matrix(codes).astype(int)].reshape(len(codes), -1) if len(codes) else np.zeros((0, 0)), None)

    def table(self, metric: str = "l2") -> np.ndarray:
        """parts x centres x centres distances between centroids (products for ip)."""
        c = self.centroids
        if metric == "l2":
            return ((c[:, :, None] - c[:, None]) ** 2).sum(axis=3)
        return np.einsum("pad,pbd->pab", c, c)

    def between(self, a: Column, b: Column, metric: str = "l2") -> Column:
        """Distance of two codes, from tables; ip is 1 - dot here as everywhere."""
        t = self.table(metric)

        @F.pandas_udf("double")
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            i, j = np.stack(x.to_numpy()), np.stack(y.to_numpy())
            total = t[np.arange(len(t))[None], i, j].sum(axis=1)
            return pd.Series(total if metric == "l2" else 1 - total)

        return run(a, b)

    def lookup(self, codes: Column, query: list[float], metric: str = "l2") -> Column:
        """Distance of a query to codes, from a table made for the query."""
        q = np.asarray(query, float).reshape(len(self.centroids), 1, -1)
        t = ((self.centroids - q) ** 2).sum(axis=2) if metric == "l2" else (self.centroids * q).sum(axis=2)

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            total = t[np.arange(len(t))[None], np.stack(x.to_numpy())].sum(axis=1)
            return pd.Series(total if metric == "l2" else 1 - total)

        return run(codes)


def fit_product(vectors: DataFrame, parts: int, centres: int = 256, rounds: int = 8, sample: int = 65_536, seed: int = 42) -> Product:
    """k-means in each part, on at most `sample` rows chosen by hash (a fixed bound, 65,536 by default)."""
    drawn = vectors.filter("vector is not null").orderBy(F.xxhash64(F.lit(seed), "id")).limit(sample).select("vector").collect()
    x = np.array([r.vector for r in drawn], float)
    rng = np.random.default_rng(seed)
    out = []
    for p in np.split(x, parts, axis=1):
        k = min(centres, len(p))
        c = p[rng.choice(len(p), k, replace=False)]
        for _ in range(rounds):
            near = np.concatenate([((p[i : i + 1024, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(p), 1024)])
            for j in range(k):
                if (near == j).any():
                    c[j] = p[near == j].mean(axis=0)
        out.append(c)
    return Product(np.stack(out))


@dataclass(frozen=True)
class Linear:
    """y = (x - mean) @ matrix + offset."""

    mean: np.ndarray
    matrix: np.ndarray
    offset: np.ndarray | float = 0.0

    def apply(self, v: Column) -> Column:
        mean, m, offset = self.mean, self.matrix, self.offset

        @F.pandas_udf("array<double>")
        def run(s: pd.Series) -> pd.Series:
            if not len(s):
                return pd.Series([], dtype=object)
            return pd.Series(list(((np.stack(s.to_numpy()).astype(float) - mean) @ m + offset).tolist()))

        return run(v)


def fit_pca(vectors: DataFrame, n: int) -> Linear:
    """From sums and products by dimension, gathered as one partial matrix a task."""

    def run(batches):
        total = None
        for b in batches:
            x = np.stack(b["vector"].to_numpy()).astype(float) if len(b) else None
            if x is not None:
                part = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"part": [total.tolist()]})

    parts = vectors.filter("vector is not null").select("vector").mapInPandas(run, "part array<double>")
    sums = parts.select(F.posexplode("part").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    flat = np.array([r.x for r in sums])
    d = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
    mean = flat[1 : d + 1] / flat[0]
    values, vectors_ = np.linalg.eigh(flat[d + 1 :].reshape(d, d) / flat[0] - np.outer(mean, mean))
    return Linear(mean, vectors_[:, np.argsort(-values)[:n]])


def random_rotation(dim: int, seed: int = 42) -> Linear:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return Linear(np.zeros(dim), q * np.sign(np.diag(r)))


def hadamard_rotation(dim: int, seed: int = 42, rounds: int = 3) -> Linear:
    """Random signs and a normalised Hadamard transform, a few times; dim a power of two."""
    h = np.ones((1, 1))
    while len(h) < dim:
        h = np.block([[h, h], [h, -h]])
    if len(h) != dim:
        raise ValueError("dim must be a power of two")
    rng, m = np.random.default_rng(seed), np.eye(dim)
    for _ in range(rounds):
        m = m @ np.diag(rng.choice([-1.0, 1.0], dim)) @ h / np.sqrt(dim)
    return Linear(np.zeros(dim), m)


@dataclass(frozen=True)
class OneBit:
    """Signs of the rotated, centred and normalised vector, its norm, and how well the signs point along it."""

    centre: np.ndarray
    rotation: np.ndarray

    def encode(self, v: Column) -> Column:
        c, r = self.centre, self.rotation

        @F.pandas_udf("signs binary, norm double, fit double")
        def run(s: pd.Series) -> pd.DataFrame:
            x = (np.stack(s.to_numpy()).astype(float) - c) @ r if len(s) else np.zeros((0, len(c)))
            norm = np.linalg.norm(x, axis=1)
            unit = x / np.maximum(norm, EPSILON)[:, None]
            signs = unit >= 0
            fit = (unit * np.where(signs, 1, -1)).sum(axis=1) / np.sqrt(x.shape[1])
            return pd.DataFrame({"signs": [b.tobytes() for b in np.packbits(signs, axis=1)], "norm": norm, "fit": fit})

        return run(v)

    def distance(self, code: Column, query: list[float]) -> Column:
        """Estimated squared distance: b^2 + q^2 - 2 b q <signs, q> / fit."""
        q = (np.asarray(query, float) - self.centre) @ self.rotation
        qn = float(np.linalg.norm(q))
        unit, d = q / max(qn, EPSILON), len(q)

        @F.pandas_udf("double")
        def run(s: pd.DataFrame) -> pd.Series:
            bits = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in s["signs"]]), axis=1)[:, :d] if len(s) else np.zeros((0, d))
            dot = np.where(bits, 1.0, -1.0) @ unit / np.sqrt(d)
            b = s["norm"].to_numpy()
            return pd.Series(b * b + qn * qn - 2 * b * qn * dot / np.maximum(s["fit"].to_numpy(), EPSILON))

        return run(code)


    def decoder(self):
        c, r, d = self.centre, self.rotation, len(self.centre)

        def run(codes: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
            signs = np.stack([np.frombuffer(b, np.uint8) for b in codes.field("signs").to_pylist()]) if len(codes) else np.zeros((0, -(-d // 8)), np.uint8)
            v = np.where(np.unpackbits(signs, axis=1)[:, :d], 1.0, -1.0) / np.sqrt(d)
            return _estimated(v, np.asarray(codes.field("norm")), np.asarray(codes.field("fit")), c, r)

        return run


def _estimated(v: np.ndarray, norm: np.ndarray, fit: np.ndarray, centre: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """v: unit vectors that stand for rotated directions. A matrix y and numbers s such that s + |q|^2 - 2 <y, q> is the estimate
    norm^2 + |q - centre|^2 - 2 norm <direction, q - centre> / fit."""
    x = (norm / np.maximum(fit, EPSILON))[:, None] * (v @ rotation.T)
    return x + centre, norm * norm + centre @ centre + 2 * (x @ centre)


@dataclass(frozen=True)
class Rotated:
    """Levels of 1 to 8 bits for each dimension of the centred and rotated direction, scaled by its largest one; the norm; and the
    cosine between the direction and its levels, by which products are set right."""

    centre: np.ndarray
    rotation: np.ndarray
    bits: int

    def encode(self, v: Column) -> Column:
        c, r, half = self.centre, self.rotation, 1 << (self.bits - 1)

        @F.pandas_udf("levels binary, norm double, fit double")
        def run(s: pd.Series) -> pd.DataFrame:
            x = (np.stack(s.to_numpy()).astype(float) - c) @ r if len(s) else np.zeros((0, len(c)))
            norm = np.linalg.norm(x, axis=1)
            unit = x / np.maximum(norm, EPSILON)[:, None]
            most = np.maximum(np.abs(unit).max(axis=1, initial=0), EPSILON)[:, None]
            levels = np.clip(np.floor((unit / most + 1) * half), 0, 2 * half - 1).astype(np.uint8)
            fit = (unit * self._unit(levels)).sum(axis=1)
            return pd.DataFrame({"levels": [b.tobytes() for b in levels], "norm": norm, "fit": fit})

        return run(v)

    def _unit(self, levels: np.ndarray) -> np.ndarray:
        v = (levels + 0.5) / (1 << (self.bits - 1)) - 1
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def decoder(self):
        c, r = self.centre, self.rotation

        def run(codes: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
            levels = np.stack([np.frombuffer(b, np.uint8) for b in codes.field("levels").to_pylist()]) if len(codes) else np.zeros((0, len(c)), np.uint8)
            return _estimated(self._unit(levels), np.asarray(codes.field("norm")), np.asarray(codes.field("fit")), c, r)

        return run


def fit_rotated(vectors: DataFrame, bits: int = 4, seed: int = 42) -> Rotated:
    if not 1 <= bits <= 8:
        raise InvalidArgument("codes have 1 to 8 bits")
    one = fit_one_bit(vectors, seed)
    return Rotated(one.centre, one.rotation, bits)


@dataclass(frozen=True)
class Chain:
    """Transforms one after another, folded into one linear map, and the quantizer of what comes out."""

    linear: Linear
    bottom: Scalar | Product | Rotated | None

    def apply(self, v: Column) -> Column:
        return self.linear.apply(v)

    def encode(self, v: Column) -> Column:
        out = self.apply(v)
        return out if self.bottom is None else self.bottom.encode(out)

    def decoder(self):
        return (lambda codes: (_matrix(codes), None)) if self.bottom is None else self.bottom.decoder()


def fit_chain(vectors: DataFrame, text: str) -> Chain:
    """'pca:32,rom,fht,mrle:16,sq8': pca and mrle (leading dimensions) with how many stay, rom (random rotation), fht (signs and
    Hadamard transforms), and last a quantizer, if any. What does not name either raises."""
    dim = vectors.select(F.size("vector")).first()[0]
    linear, bottom = Linear(np.zeros(dim), np.eye(dim)), None
    for i, part in enumerate(names := [x.strip() for x in text.split(",")]):
        name, _, n = part.partition(":")
        now = vectors.withColumn("vector", linear.apply(F.col("vector"))) if name == "pca" or name in FITS else None
        size = linear.matrix.shape[1]
        if name == "pca":
            step = fit_pca(now, int(n))
        elif name == "rom":
            step = random_rotation(size)
        elif name == "fht":
            step = hadamard_rotation(size)
        elif name == "mrle":
            step = Linear(np.zeros(size), np.eye(size)[:, : int(n)])
        elif name in FITS and i == len(names) - 1:
            bottom = fit_codes(now, name)
            continue
        else:
            raise InvalidArgument(f"no transform {name!r}")
        # (x - a) A, then (y - b) B, is (x - a) A B - b B
        linear = _then(linear, step)
    return Chain(linear, bottom)


def _then(first: Linear, second: Linear) -> Linear:
    shift = second.mean @ second.matrix
    offset = -first.mean @ first.matrix @ second.matrix - shift
    matrix = first.matrix @ second.matrix
    return Linear(np.zeros(len(first.mean)), matrix, offset)


FITS = {
    "sq8": lambda v: fit_scalar(v, 8), "sq4": lambda v: fit_scalar(v, 4), "sq8_uniform": lambda v: fit_uniform(v, 8), "sq4_uniform": lambda v: fit_uniform(v, 4),
    "sq8_uniform_trunc": lambda v: fit_uniform(v, 8, 0.001), "pq": lambda v: fit_product(v, max(1, v.select(F.size("vector")).first()[0] // 8), 256),
    "pqfs": lambda v: fit_product(v, max(1, v.select(F.size("vector")).first()[0] // 4), 16), **{f"rabitq{b}": lambda v, b=b: fit_rotated(v, b) for b in range(1, 9)},
}


def fit_codes(vectors: DataFrame, name: str):
    """A quantizer by name, or a chain of transforms and one."""
    if "," in name or name.split(":")[0] in ("pca", "rom", "fht", "mrle"):
        return fit_chain(vectors, name)
    if name not in FITS:
        raise InvalidArgument(f"no codes {name!r}; there are {sorted(FITS)} and chains")
    return FITS[name](vectors)


def to_json(model) -> str:
    """A model as text, for a manifest."""
    plain = lambda x: {"array": x.tolist()} if isinstance(x, np.ndarray) else to_json(x) if hasattr(x, "__dataclass_fields__") else x
    return json.dumps({"kind": type(model).__name__, "fields": {f: plain(getattr(model, f)) for f in model.__dataclass_fields__}})


def from_json(text: str):
    got = json.loads(text)
    kind = {c.__name__: c for c in (Scalar, Product, Linear, OneBit, Rotated, Chain)}[got["kind"]]
    rich = lambda x: np.array(x["array"]) if isinstance(x, dict) else from_json(x) if isinstance(x, str) and x.startswith("{") else x
    return kind(**{f: rich(x) for f, x in got["fields"].items()})


def inversions(found: DataFrame) -> DataFrame:
    """One row: pairs, and the share of them that exact and coded distances order differently, of (qid, id, exact, coded)."""
    a = found.select("qid", F.col("id").alias("_i"), F.col("exact").alias("_e"), F.col("coded").alias("_c"))
    pairs = found.join(a, "qid").filter("exact < _e")
    return pairs.agg(F.count("*").alias("pairs"), F.avg((F.col("coded") > F.col("_c")).cast("double")).alias("inverted"))


def fit_one_bit(vectors: DataFrame, seed: int = 42) -> OneBit:
    rows = vectors.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("at").collect()
    c = np.array([r.x for r in rows])
    return OneBit(c, random_rotation(len(c), seed).matrix)


def error(vectors: DataFrame, decoded: Column) -> DataFrame:
    """One row: mean and largest absolute error of decoded values."""
    rows = vectors.select(F.explode(F.zip_with("vector", decoded, lambda x, y: F.abs(x.cast("double") - y))).alias("e"))
    return rows.agg(F.avg("e").alias("mean_error"), F.max("e").alias("max_error"))
