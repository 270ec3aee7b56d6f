"""Ranking and the whole search: history first, then the index, one deterministic top k."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import boost, ladder, may_match
from ..functions.text import Typed, candidate_query, normal_query, parse_typed, with_normal
from .history import newest
from .index import by_path
from .retrieve import budget, directory_by_suffix, in_scope, most_candidates, pool, pooled

COLUMNS = ["score", "kind", "relative_path", "workspace", "seq"]


@dataclass(frozen=True)
class Request:
    """most: how many candidates of the index are looked at, besides history; None for all."""

    typed: Typed
    k: int = 50
    files: bool = True
    directories: bool = True
    fuzzy: bool = True
    workspace: str | None = None
    now_ms: int = 0
    most: int | None = None
    history_most: int = 200
    keep_missing: bool = False


def scored(paths: DataFrame, query: str, use_fuzzy: bool = True) -> DataFrame:
    """Paths that match, with score."""
    ws = F.col("norm_workspace")
    some = paths.where(may_match(F.col("norm_path"), ws, query, use_fuzzy)) if query else paths
    return some.withColumn("score", ladder(F.col("kind"), F.col("norm_path"), F.col("norm_name"), ws, query, use_fuzzy)).where("score is not null")


def top(rows: DataFrame, k: int) -> DataFrame:
    """rank, relative_path, workspace, kind, score of the best k: by score, directories first, path in dictionary order, workspace, input order."""
    order = [F.desc("score"), F.col("kind") != "directory", F.expr("collate(relative_path, 'UNICODE')"), F.col("workspace"), F.col("seq")]
    best = rows.select(COLUMNS).orderBy(*order).limit(max(0, k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select("rank", "relative_path", "workspace", "kind", "score")


def rank_paths(paths: DataFrame, query: str, k: int, use_fuzzy: bool = True) -> DataFrame:
    return top(scored(paths, normal_query(query), use_fuzzy), k)


def plan_request(paths: DataFrame, text: str, **options) -> Request:
    """What a typed text asks for: a chain that names one directory means its children; a scope that is no directory means a query over whole paths."""
    request = Request(parse_typed(text), **options)
    typed = request.typed
    if typed.everywhere or not typed.scope:
        return request
    chain = f"{typed.scope}/{typed.query}" if typed.query else typed.scope
    found = directory_by_suffix(paths, chain, request.workspace).select("relative_path", "workspace").take(1) if "/" in chain else []
    if found:
        return replace(request, typed=Typed(found[0][0], ""), workspace=request.workspace or found[0][1])
    if by_path(paths, typed.scope, request.workspace).where("kind = 'directory'").isEmpty():
        return replace(request, typed=Typed("", chain, True))
    return request


def allowed(rows: DataFrame, request: Request) -> DataFrame:
    """Rows of the kinds, the workspace and the scope that are asked for."""
    kinds = [k for k, on in (("file", request.files), ("directory", request.directories)) if on]
    some = rows.where(F.col("kind").isin(kinds)).where(in_scope(request.typed.scope, not normal_query(request.typed.query)))
    return some if request.workspace is None else some.where(F.col("workspace") == request.workspace)


def used(paths: DataFrame, request: Request, history: DataFrame) -> DataFrame:
    """What history gives: entries that match, whatever the pools, with score and boost.

    The newest `history_most` rows of history count. A row means the entry of its path, of exact case, else the
    first that differs in case only, if that is of its kind; rows without one count only if keep_missing.
    """
    query = normal_query(request.typed.query)
    h = newest(history, request.history_most)
    h = h.select(F.col("workspace").alias("_w"), F.col("kind").alias("_kind"), F.col("relative_path").alias("_path"), "last_ms", "opens", "pinned", "affinity" if "affinity" in history.columns else F.lit(None).cast("long").alias("affinity"))
    mine = with_normal(h.select("*", F.col("_path").alias("relative_path"), F.col("_w").alias("workspace"))).select(*h.columns, F.col("norm_path").alias("_norm"))
    hit = paths.join(F.broadcast(mine), (F.col("workspace") == F.col("_w")) & (F.col("norm_path") == F.col("_norm")))  # history_most rows
    first = Window.partitionBy("_w", "_kind", "_path").orderBy(F.col("relative_path") != F.col("_path"), "seq", "relative_path")
    hit = hit.withColumn("_k", F.row_number().over(first)).where("_k = 1 and kind = _kind")
    rows = allowed(hit, request)
    if request.keep_missing:
        missing = h.join(hit.select("_w", "_kind", "_path"), ["_w", "_kind", "_path"], "left_anti")
        missing = missing.withColumns({"workspace": F.col("_w"), "kind": F.col("_kind"), "relative_path": F.col("_path"), "seq": F.lit(-1).cast("long")})
        rows = rows.unionByName(allowed(with_normal(missing), request), allowMissingColumns=True)
    gain = boost(F.col("pinned"), F.col("last_ms"), F.col("opens"), F.col("affinity"), request.now_ms)
    gained = scored(rows, query, request.fuzzy).withColumn("score", F.round(F.col("score") + gain, 6))
    # two rows of history may mean one entry; its best score counts
    return gained.groupBy("kind", "relative_path", "workspace", "seq").agg(F.max("score").alias("score")).select(COLUMNS)


def candidates(paths: DataFrame, request: Request, mine: DataFrame | None = None) -> DataFrame:
    """Entries that the index is searched for, without those that history gave, in pools if there is a budget."""
    query = candidate_query(request.typed)
    rows = allowed(paths, request)
    if mine is not None:
        rows = rows.join(F.broadcast(mine.select("workspace", "kind", "relative_path")), ["workspace", "kind", "relative_path"], "left_anti")  # history_most rows
    if request.most is None:
        return pool(rows, query)
    index = paths if request.workspace is None else paths.where(F.col("workspace") == request.workspace)
    return pooled(rows, index, query, normal_query(request.typed.query) if request.typed.everywhere else None)


def search(paths: DataFrame, request: Request, history: DataFrame | None = None) -> DataFrame:
    """The best k of history and index. history: workspace, kind, relative_path, last_ms, opens, pinned and maybe affinity."""
    mine = used(paths, request, history) if history is not None else None
    some = candidates(paths, request, mine)
    if request.most is not None:
        some = budget(some, most_candidates(candidate_query(request.typed), request.most))
    found = scored(some, normal_query(request.typed.query), request.fuzzy)
    if mine is None:
        return top(found, request.k)
    return top(mine.unionByName(found.select(COLUMNS).withColumn("score", F.round("score", 6))), request.k)


def from_history(paths: DataFrame, request: Request, history: DataFrame) -> DataFrame:
    """The first answer of a search, before the index is looked at."""
    return top(used(paths, request, history), request.k)


def progress(paths: DataFrame, request: Request, history: DataFrame | None = None) -> DataFrame:
    """One row: processed, the candidates that were looked at, and truncated, whether the budget left some out."""
    mine = used(paths, request, history) if history is not None else None
    n = candidates(paths, request, mine).agg(F.count("*").alias("n"))
    most = F.lit(2**63 - 1 if request.most is None else most_candidates(candidate_query(request.typed), request.most))
    return n.select(F.least("n", most).alias("processed"), (F.col("n") > most).alias("truncated"))
