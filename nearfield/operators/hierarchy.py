"""Search under category paths: a row belongs to every prefix of its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.errors import InvalidArgument
from nearfield.operators.search import candidates, ranked


def prefixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(path.isNotNull() & (path != ""), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def under(column: str, paths: str) -> Column:
    """Rows below any of the paths, which `|` separates; no path: all rows."""
    wanted = [p.strip("/") for p in paths.split("|") if p.strip("/")]
    out = F.lit(not wanted)
    for p in wanted:
        out = out | (F.col(column) == p) | F.startswith(F.col(column), F.lit(p + "/"))
    return F.coalesce(out, F.lit(False))


def column(base: DataFrame, hierarchy: str) -> str:
    """The path column of a hierarchy; raises if there is none."""
    name = f"path_{hierarchy}" if hierarchy else "path"
    if name not in base.columns:
        raise InvalidArgument(f"no hierarchy {hierarchy!r}")
    return name


def knn(base: DataFrame, queries: DataFrame, k: int, paths: str, metric: str = "l2", hierarchy: str = "") -> DataFrame:
    rows = base.filter(under(column(base, hierarchy), paths))
    return ranked(candidates(rows, queries, metric, k), k).select("qid", "rank", "id", "distance")


def range_search(base: DataFrame, queries: DataFrame, radius: float, paths: str, metric: str = "l2", hierarchy: str = "") -> DataFrame:
    rows = base.filter(under(column(base, hierarchy), paths))
    return ranked(candidates(rows, queries, metric, None, radius)).select("qid", "rank", "id", "distance")


def combined(base: DataFrame, queries: DataFrame, k: int, wanted: dict[str, str], how: str = "union", metric: str = "l2") -> DataFrame:
    """Several hierarchies at once: rows under any (union) or all (intersection) of their paths."""
    if how not in ("union", "intersection"):
        raise InvalidArgument("how must be union or intersection")
    cond = None
    for h, p in wanted.items():
        c = under(column(base, h), p)
        cond = c if cond is None else (cond | c if how == "union" else cond & c)
    return ranked(candidates(base.filter(cond), queries, metric, k), k).select("qid", "rank", "id", "distance")


def node_sizes(base: DataFrame, column: str = "path") -> DataFrame:
    """(prefix, n_rows)."""
    return base.select(F.explode(prefixes(F.col(column))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n_rows"))
