"""Choice between exact and approximate search, from counts."""

from __future__ import annotations

import math

EXACT, SCAN, GRAPH = "exact", "id_scan", "graph"


def access_path(live: int, k: int, ef: int = 0, ef_search: int = 64, allowed: int | None = None, m: int = 16, cutoff: int = 2048) -> str:
    """All rows if the beam would hold them; only the allowed rows if these are few; else the graph.

    ``allowed`` counts an allow list; deny lists have none. A cutoff of 0 switches both exact paths off.
    """
    width = max(ef or ef_search, k)
    if cutoff and live <= width:
        return EXACT
    if cutoff and allowed is not None and allowed <= max(cutoff, math.sqrt(m * width * live)):
        return SCAN
    return GRAPH
