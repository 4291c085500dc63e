"""Search requests and index configurations, checked before anything runs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from nearfield.errors import InvalidArgument, UnsupportedOperation
from nearfield.functions.distance import METRICS

DTYPES = ("float32", "float16", "bfloat16", "int8", "sparse")
REPRESENTATIONS = ("dense", "sparse", "multi_vector")
#: Depend on timing or the order of visits, so their results can't be repeated.
UNSUPPORTED = ("timeout_ms", "filter_callback_limit", "skip_strategy")


@dataclass(frozen=True)
class IndexConfig:
    kind: str
    dim: int | None = None
    metric: str = "l2"
    dtype: str = "float32"
    representation: str = "dense"
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise InvalidArgument(f"metric_type must be one of {METRICS}")
        if self.dtype not in DTYPES:
            raise InvalidArgument(f"dtype must be one of {DTYPES}")
        if self.representation not in REPRESENTATIONS:
            raise InvalidArgument(f"representation must be one of {REPRESENTATIONS}")
        if self.dim is None and self.dtype != "sparse" and self.representation == "dense":
            raise InvalidArgument("dim is needed for dense vectors")
        if self.dim is not None and self.dim <= 0:
            raise InvalidArgument("dim must be positive")
        if self.dtype == "sparse" and self.metric != "ip":
            raise InvalidArgument("sparse vectors take ip only")

    @classmethod
    def from_json(cls, kind: str, text: str) -> IndexConfig:
        try:
            given = json.loads(text)
        except ValueError as e:
            raise InvalidArgument(f"the parameters are not JSON: {e}") from e
        return cls(kind.lower(), given.get("dim"), given.get("metric_type", "l2"), given.get("dtype", "float32"), given.get("representation", "sparse" if given.get("dtype") == "sparse" else "dense"), given.get("index_param", {}))


def quick(text: str) -> dict:
    """'hgraph|32|sq8|fp32' as parameters: kind, degree or buckets, coarse and precise codes."""
    parts = text.split("|")
    if not 2 <= len(parts) <= 4 or not parts[1].isdigit():
        raise InvalidArgument(f"can't read {text!r}")
    return {"kind": parts[0].lower(), "degree": int(parts[1]), "codes": parts[2] if len(parts) > 2 else "fp32", "precise": parts[3] if len(parts) > 3 else None}


@dataclass
class SearchRequest:
    """mode is knn or range. exclude and keep name the polarity of filters; all that are given must pass."""

    queries: DataFrame
    mode: str = "knn"
    k: int = 10
    radius: float | None = None
    limit: int = -1
    threshold: float | None = None
    where: str | None = None
    keep: Column | None = None
    exclude: Column | None = None
    exclude_ids: DataFrame | None = None
    paths: list[str] | None = None
    hierarchy: str = ""
    bucket_ids: list[int] | None = None
    distance: Callable[[Column, Column], Column] | None = None
    expected: DataFrame | None = None
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in ("knn", "range"):
            raise InvalidArgument("mode must be knn or range")
        if self.mode == "knn" and self.k <= 0:
            raise InvalidArgument("k must be positive")
        if self.mode == "range":
            if self.radius is None or self.radius < 0:
                raise InvalidArgument("a range search needs a radius of 0 or more")
            if self.limit == 0:
                raise InvalidArgument("limit must not be 0")
        if self.bucket_ids is not None and len(set(self.bucket_ids)) != len(self.bucket_ids):
            raise InvalidArgument("bucket ids repeat")
        for name in UNSUPPORTED:
            if name in self.params:
                raise UnsupportedOperation(f"{name} makes results depend on timing")
