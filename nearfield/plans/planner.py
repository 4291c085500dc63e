"""Strategy rules, decided from numbers before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Choice:
    strategy: str
    why: str


def search_strategy(rows: int, valid_ratio: float = 1.0, brute_force_threshold: float = 0.02, graph_at: int = 10_000, has_graph: bool = True) -> Choice:
    """Exact scan for selective filters and for small indexes, else the graph."""
    if not has_graph or rows < graph_at:
        return Choice("flat", f"{rows} rows, the graph pays from {graph_at}")
    if valid_ratio <= brute_force_threshold:
        return Choice("flat", f"a share of {valid_ratio} passes the filter")
    return Choice("graph", "default")


def candidates_for(k: int, factor: float, default: float = 1.0) -> int:
    """How many coarse candidates go to reranking."""
    f = factor if factor > 1 else max(default, 1.0)
    return max(k, int(k * f))


def probes(buckets: int, wanted: int) -> int:
    return max(1, min(buckets, wanted))


def visit_ratio(valid_ratio: float, skip: float) -> float:
    """Share of nodes that a walk looks at when it skips rejected ones with probability skip."""
    return valid_ratio + (1 - valid_ratio) * (1 - skip)
