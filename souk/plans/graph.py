"""Models and what they are made from: build order, what depends on what, who reads it, and which models a change makes stale."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that differ between loads of the same rows.
VOLATILE = ("_loaded_at",)


@dataclass(frozen=True)
class Model:
    """make gets the frames of all inputs, models and sources alike, by name."""

    name: str
    inputs: tuple[str, ...]
    make: Callable[[Mapping[str, DataFrame]], DataFrame]


class Graph:
    """Inputs that no model makes are sources. exposures: who reads the models, and which."""

    def __init__(self, models: Iterable[Model], exposures: Mapping[str, Iterable[str]] | None = None):
        listed = list(models)
        self.models = {m.name: m for m in listed}
        self.exposures = {n: tuple(x) for n, x in (exposures or {}).items()}
        if len(self.models) < len(listed):
            raise ValueError("a model has two makers")
        unknown = {x for own in self.exposures.values() for x in own} - set(self.models)
        if unknown:
            raise ValueError(f"read by someone, made by none: {sorted(unknown)}")
        self.sources = tuple(dict.fromkeys(x for m in listed for x in m.inputs if x not in self.models))
        self.order = self._order()

    def _order(self) -> tuple[str, ...]:
        """Every model after those it is made from; else as they were listed."""
        done: dict[str, None] = {}
        waiting = dict(self.models)
        while waiting:
            ready = [n for n, m in waiting.items() if all(x in done or x in self.sources for x in m.inputs)]
            if not ready:
                raise ValueError(f"models are made from each other: {sorted(waiting)}")
            done |= dict.fromkeys(ready)
            for n in ready:
                del waiting[n]
        return tuple(done)

    def downstream(self, names: Iterable[str]) -> tuple[str, ...]:
        """The models that are made from these, at any remove, in build order; models that are named are among them."""
        reached = set(names)
        for n in self.order:
            if reached & set(self.models[n].inputs):
                reached.add(n)
        return tuple(n for n in self.order if n in reached)

    def upstream(self, names: Iterable[str]) -> tuple[str, ...]:
        """The models and sources that these are made from, at any remove, themselves among them: sources first, then in build order."""
        reached = {x for n in names for x in self.exposures.get(n, (n,))}
        for n in reversed(self.order):
            if n in reached:
                reached |= set(self.models[n].inputs)
        return tuple(x for x in (*self.sources, *self.order) if x in reached)

    def readers(self, names: Iterable[str]) -> tuple[str, ...]:
        """The exposures that a change of these models or sources reaches."""
        reached = set(self.downstream(names)) | set(names)
        return tuple(n for n, own in self.exposures.items() if reached & set(own))

    def edges(self) -> list[tuple[str, str, str]]:
        """(from, to, kind of to) of the whole graph."""
        made = [(x, n, "model") for n in self.order for x in self.models[n].inputs]
        return made + [(x, n, "exposure") for n, own in self.exposures.items() for x in own]

    def stale(self, now: Mapping[str, str], before: Mapping[str, str], stored: Iterable[str]) -> tuple[str, ...]:
        """The models to build, in order: what depends on a source whose fingerprint has changed, or on a model that is not stored."""
        changed = {s for s in self.sources if now.get(s) != before.get(s)}
        return self.downstream(changed | (set(self.models) - set(stored)))


def fingerprint(df: DataFrame) -> str:
    """A text that two frames share if they hold the same rows, in any order: columns, number of rows and the sum of their hashes."""
    columns = sorted(n for n in df.columns if n not in VOLATILE)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
    kinds = ",".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in columns)
    return f"{r['n']}:{r['h']}:{kinds}"
