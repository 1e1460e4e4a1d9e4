"""The boundary behind which a trained model runs: rows in, rows out, in Arrow batches.

A model is loaded once for each Python worker, by a factory found by name. A row that fails gets a status instead of
ending the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Predict = Callable[[pd.DataFrame], pd.DataFrame]
_FACTORIES: dict[str, Callable[..., Predict]] = {}
_LOADED: dict[tuple, Predict] = {}


def register(name: str) -> Callable[[Callable[..., Predict]], Callable[..., Predict]]:
    """Names a factory; factories must be importable where tasks run."""

    def put(factory: Callable[..., Predict]) -> Callable[..., Predict]:
        _FACTORIES[name] = factory
        return factory

    return put


def names() -> list[str]:
    return sorted(_FACTORIES)


def predicted(df: DataFrame, model: str, schema: str, **options: str | int | float) -> DataFrame:
    """df through the model; schema is that of its output, and gets status and error columns."""
    if model not in _FACTORIES:
        raise KeyError(f"no model {model!r}; there are {names()}")
    factory = _FACTORIES[model]
    key = (model, *sorted(options.items()))
    want = [*(c.strip().split()[0] for c in schema.split(",")), "status", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _LOADED:
            _LOADED[key] = factory(**options)
        predict = _LOADED[key]
        for b in batches:
            try:
                yield predict(b).assign(status="done", error=None)
            except Exception:  # one bad row must not fail its batch: try the rows alone
                for i in range(len(b)):
                    one = b.iloc[i : i + 1]
                    try:
                        yield predict(one).assign(status="done", error=None)
                    except Exception as e:
                        yield one.assign(status="failed", error=str(e)).reindex(columns=want)

    return df.mapInPandas(run, f"{schema}, status string, error string")


@register("threshold")
def threshold(least: float = 0.5) -> Predict:
    """The smallest model: the highest class of a score column, 0 below `least`."""

    def predict(b: pd.DataFrame) -> pd.DataFrame:
        top = b["score"].map(max)
        return b.assign(label=[list(s).index(t) if t >= least else 0 for s, t in zip(b["score"], top, strict=True)])

    return predict
