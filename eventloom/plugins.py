"""User code: named producers, filters, analyzers, outputs and tools, and the hooks around a job."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("producer", "filter", "analyzer", "output", "source", "service", "tool", "results", "metadata")


class Registry:
    """Plugins by kind and name. A producer is df -> df, a filter () -> Column, an analyzer df -> df (an aggregate), a tool any callable."""

    def __init__(self):
        self.known: dict[tuple[str, str], Callable] = {}
        self.hooks: dict[str, list[Callable]] = defaultdict(list)

    def add(self, kind: str, name: str) -> Callable:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")

        def put(f: Callable) -> Callable:
            if (kind, name) in self.known:
                raise ValueError(f"{kind} {name} exists")
            self.known[kind, name] = f
            return f

        return put

    def make(self, kind: str, name: str, **parameters):
        if (kind, name) not in self.known:
            raise ValueError(f"no {kind} is called {name!r}")
        return self.known[kind, name](**parameters) if parameters else self.known[kind, name]

    def listing(self) -> list[tuple[str, str, str]]:
        """(kind, name, first line of its description)."""
        return sorted((k, n, (f.__doc__ or "").strip().split("\n")[0]) for (k, n), f in self.known.items())

    def watch(self, signal: str, f: Callable) -> None:
        self.hooks[signal].append(f)

    def emit(self, signal: str, *args) -> None:
        """Calls what watches a signal: first come first for those named pre..., and post_begin_job; the last first for others named post..."""
        own = self.hooks[signal]
        for f in reversed(own) if signal.startswith("post") and signal != "post_begin_job" else own:
            f(*args)


class Products:
    """Declared products of a job and what is put into an event table under them."""

    def __init__(self):
        self.declared: dict[tuple[str, str], bool] = {}

    def produces(self, kind: str, instance: str = "", persistable: bool = True) -> None:
        if (kind, instance) in self.declared:
            raise ValueError(f"{kind} {instance!r} is declared twice")
        self.declared[kind, instance] = persistable

    def put(self, df: DataFrame, kind: str, column, instance: str = "") -> DataFrame:
        """Adds a product column; undeclared or repeated products are errors, and null products too when the job runs."""
        if (kind, instance) not in self.declared:
            raise ValueError(f"{kind} {instance!r} is not declared")
        name = f"{kind}_{instance}" if instance else kind
        if name in df.columns:
            raise ValueError(f"{kind} {instance!r} is put twice")
        return df.withColumn(name, F.coalesce(column, F.raise_error(F.lit(f"null product {name}"))))


def check_consumes(declared: set[tuple[str, str]], asked: set[tuple[str, str]], strict: bool = False) -> list[tuple[str, str]]:
    """Lookups without a declaration: returned, or an error if strict."""
    gaps = sorted(asked - declared)
    if gaps and strict:
        raise ValueError(f"lookups without a declaration: {gaps}")
    return gaps
