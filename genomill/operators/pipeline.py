"""Ordered steps over a table: one lazy plan, whose counts and histograms are asked for afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .filters import Filtered
from .table import CHUNK, Variations


class Pipeline:
    """Steps are filters, or functions of a table that give a table or any other result."""

    def __init__(self):
        self.steps: list[tuple[str, Callable]] = []

    def append(self, step: Callable, id_: str | None = None) -> Pipeline:
        name = id_ or f"{len(self.steps)}-{getattr(step, '__name__', type(step).__name__)}"
        if any(n == name for n, _ in self.steps):
            raise ValueError(f"two steps of one name: {name}")
        self.steps.append((name, step))
        return self

    def run(self, v: Variations, kept_fields: list[str] | None = None, ignored_fields: list[str] | None = None, max_chunks_to_process: int | None = None, chunk_size: int = CHUNK) -> tuple[Variations, dict]:
        """The table after all steps and, by step, its name, order, and its Filtered or result."""
        if kept_fields or ignored_fields:
            v = v.fields(kept_fields, ignored_fields)
        if max_chunks_to_process is not None:
            v = v.chunk(0, max_chunks_to_process * chunk_size)
        results = {}
        for order, (name, step) in enumerate(self.steps):
            result = step(v)
            results[name] = {"name": name, "order": order, "result": result}
            if isinstance(result, Filtered):
                v = result.kept
            elif isinstance(result, Variations):
                v = result
        return v, results

    @staticmethod
    def stats(results: dict) -> DataFrame:
        """name, order, n_kept, n_filtered_out, tot of the filters."""
        from pyspark.sql import functions as F

        out = None
        for r in results.values():
            if isinstance(r["result"], Filtered):
                one = r["result"].stats.select(F.lit(r["name"]).alias("name"), F.lit(r["order"]).alias("order"), "*")
                out = one if out is None else out.unionByName(one)
        return out
