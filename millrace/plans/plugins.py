"""Places where a host plugs in models: re-rankers, question classifiers, answer writers. Without one, each step has a
defined default."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("reranker", "classifier", "writer", "embedder")
_registry: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


def register(kind: str, name: str):
    """Decorator: a callable under a name. Rerankers take (question, texts) and give scores; classifiers take
    (question, history, domain names) and give JSON ``{"domains": [...]}``; writers take (prompt, context) and give text."""
    if kind not in _registry:
        raise ValueError(f"unknown kind {kind}")

    def add(f: Callable) -> Callable:
        _registry[kind][name] = f
        return f

    return add


def find(kind: str, name: str | None = None) -> Callable | None:
    known = _registry[kind]
    return known.get(name) if name else next(iter(known.values()), None)


def unregister(kind: str, name: str) -> None:
    _registry[kind].pop(name, None)


def rerank(hits: DataFrame, question: str, id_col: str, text_col: str, n: int, name: str | None = None) -> DataFrame:
    """A short hit list ``(id, score, text)`` in the order of a re-ranker; as it is without one. Only the candidates,
    at most four times ``n`` and at least 20, are scored."""
    model = find("reranker", name)
    order = [F.desc("score"), id_col]
    if model is None:
        return hits.select(id_col, "score").orderBy(*order).limit(n)
    rows = hits.orderBy(*order).limit(max(4 * n, 20)).collect()
    scores = model(question, [r[text_col] for r in rows])
    kind = hits.schema[id_col].dataType.simpleString()
    scored = hits.sparkSession.createDataFrame([(r[id_col], float(s)) for r, s in zip(rows, scores, strict=True)], f"`{id_col}` {kind}, score double")
    return scored.orderBy(*order).limit(n)


def classify(question: str, history: list[dict], domains: list[str], default: list[str], name: str | None = None) -> list[str]:
    """Domains by a classifier; its answer counts as far as it names known domains, else ``default``."""
    model = find("classifier", name)
    if model is None:
        return default
    try:
        named = json.loads(model(question, history, domains)).get("domains", [])
    except (ValueError, AttributeError):
        return default
    return [d for d in named if d in domains] or default


class Cache:
    """Values by key, at most ``size`` of them and each for ``seconds``; a changed ``stamp`` makes a value stale."""

    def __init__(self, size: int = 128, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.held: OrderedDict[Hashable, tuple[float, object, object]] = OrderedDict()

    def get(self, key: Hashable, make: Callable[[], object], stamp: object = None):
        now = self.clock()
        if key in self.held:
            at, old, value = self.held[key]
            if now - at < self.seconds and old == stamp:
                self.held.move_to_end(key)
                return value
        value = make()
        self.held[key] = (now, stamp, value)
        self.held.move_to_end(key)
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return value

    def clear(self) -> None:
        self.held.clear()
