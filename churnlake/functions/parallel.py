"""Submit independent Spark jobs (model fits, restarts, folds) from a few driver threads."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from churnlake import config as C


def parallel_map(fn: Callable, items: Sequence, workers: int = C.ML_PARALLELISM) -> list:
    """``[fn(i) for i in items]`` with up to ``workers`` concurrent Spark jobs; results in input order."""
    items = list(items)
    if workers <= 1 or len(items) <= 1:
        return [fn(i) for i in items]
    with ThreadPoolExecutor(max_workers=min(workers, len(items))) as ex:
        return list(ex.map(fn, items))
