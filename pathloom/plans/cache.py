"""Results of earlier requests: kept by request and version, grown from, and shown with the active row in view."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame

from ..functions.text import Typed, candidate_query, normal_query
from ..operators.search import Request, scored, search, top


class LruCache:
    """Least recently used first out; 0 keeps nothing."""

    def __init__(self, size: float):
        self.size, self.items = max(0, int(size)), OrderedDict()

    def get(self, key):
        if key in self.items:
            self.items.move_to_end(key)
        return self.items.get(key)

    def put(self, key, value) -> None:
        if self.size:
            self.items[key] = value
            self.items.move_to_end(key)
            while len(self.items) > self.size:
                self.items.popitem(last=False)


def request_key(request: Request, version: object, history_version: object = None) -> tuple:
    """What a result depends on: the request with its query normalized, the version of the index and that of the history."""
    scope = request.typed.scope.replace("\\", "/").lower().removeprefix("./").removesuffix("/")
    return replace(request, typed=Typed(scope, normal_query(request.typed.query), request.typed.everywhere), now_ms=0), version, history_version


class Searcher:
    """Searches one version of an index, with results kept, and longer queries answered from what shorter ones matched.

    Every match of a longer query is one of a query it begins with, by each tier of the ladder; so where nothing was
    cut off by a budget and the query had 3 characters, its matches, kept in memory on the executors, stand for the
    index. Queries over whole paths and with history go to the index.
    """

    def __init__(self, paths: DataFrame, version: object, size: int = 32):
        self.paths, self.version, self.kept = paths, version, LruCache(size)
        self.grown: tuple[tuple, str, DataFrame] | None = None
        self.reused = 0

    def __call__(self, request: Request, history: Callable[[], DataFrame] | None = None, history_version: object = None) -> list:
        """Rows of the result, at most k."""
        key = request_key(request, self.version, history_version)
        if (hit := self.kept.get(key)) is not None:
            return hit
        if history is not None or request.most is not None or request.typed.everywhere:
            rows = search(self.paths, request, history() if history else None).collect()
        else:
            rows = self.from_grown(request)
        self.kept.put(key, rows)
        return rows

    def from_grown(self, request: Request) -> list:
        query = normal_query(request.typed.query)
        context = request_key(replace(request, typed=Typed(request.typed.scope, "")), self.version)
        if self.grown and self.grown[0] == context and len(query) > len(self.grown[1]) and query.startswith(self.grown[1]):
            self.reused += 1
            return top(scored(self.grown[2], query, request.fuzzy), request.k).collect()
        if len(candidate_query(request.typed)) < 3:
            return search(self.paths, request).collect()
        from ..operators.search import candidates

        self.forget()
        matches = scored(candidates(self.paths, request), query, request.fuzzy).drop("score").persist()
        self.grown = context, query, matches
        return top(scored(matches, query, request.fuzzy), request.k).collect()

    def forget(self) -> None:
        if self.grown:
            self.grown[2].unpersist()
        self.grown = None


def identity(row) -> tuple:
    return row["workspace"], row["kind"], row["relative_path"]


def same_order(a: Sequence, b: Sequence) -> bool:
    """Whether two results list the same entries in the same order."""
    return [identity(r) for r in a] == [identity(r) for r in b]


def with_active(rows: Sequence, active, k: int) -> list:
    """The first k rows, the active one among them: at the end, in place of the last if there is no room."""
    shown = list(rows[: max(0, k)])
    if k <= 0 or active is None or identity(active) in map(identity, shown):
        return shown
    return [*shown[: k - 1], active]
