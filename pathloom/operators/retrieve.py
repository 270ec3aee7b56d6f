"""Fetching candidates: by the closed form of the pools, by postings, by directory suffix, under a budget."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_query, segment_prefixes
from .index import by_path

#: The most candidates for queries of one and two characters, and the lists that an intersection takes.
MOST_BY_LENGTH = {1: 2_000, 2: 5_000}
LISTS = 3


def in_scope(scope: str, children_only: bool) -> Column:
    scope = re.sub(r"^\./", "", scope.replace("\\", "/")).lower().removesuffix("/")
    if children_only:
        return F.col("norm_parent") == scope
    return F.lit(True) if not scope else F.col("norm_path").startswith(scope + "/")


def pool(paths: DataFrame, query: str) -> DataFrame:
    """Rows of the index that a candidate query looks at; an empty one looks at the children of the scope."""
    if len(query) == 1:
        return paths.where(F.col("norm_name").startswith(query))
    return paths.where(F.col("norm_name").contains(query)) if len(query) == 2 else paths


def query_grams(query: str) -> list[str]:
    """Distinct pairs of characters, in order."""
    return list(dict.fromkeys(query[i : i + 2] for i in range(len(query) - 1)))


def gram_lists(paths: DataFrame, query: str) -> DataFrame:
    """For each workspace, by how many names hold each pair of the query: common, the pairs whose lists are intersected (null if fewer than two occur), and rare, the rarest (null if one occurs nowhere).

    Ties go to the pair that comes first in the query. One pass that counts, combined before the shuffle.
    """
    tokens = query_grams(query)
    n = paths.groupBy("workspace").agg(*(F.count_if(F.col("norm_name").contains(g)).alias(f"_{i}") for i, g in enumerate(tokens)))
    every = F.array(*(F.struct(F.col(f"_{i}").alias("n"), F.lit(i).alias("at"), F.lit(g).alias("token")) for i, g in enumerate(tokens)))
    present = F.array_sort(F.filter(every, lambda x: x["n"] > 0))
    common = F.when(F.size(present) >= 2, F.transform(F.slice(present, 1, LISTS), lambda x: x["token"]))
    return n.select("workspace", common.alias("common"), F.when(F.size(present) == len(tokens), present[0]["token"]).alias("rare"))


def pooled(rows: DataFrame, paths: DataFrame, query: str, whole: str | None = None) -> DataFrame:
    """rows that a candidate query looks at, with pool, the number of the first pool that holds each.

    The order: for a query over whole paths (`whole`), paths that hold its segments; exact names; beginnings of
    names; then, of a query of two characters, names that hold them, and of a longer one the intersection of the
    rarest lists, the rarest list, and all. Lists are those of the whole index `paths`, not of rows alone.
    """
    name = F.col("norm_name")
    if not query:
        return rows.withColumn("pool", F.lit(0))
    some = pool(rows, query)
    if len(query) < 3:
        return some.withColumn("pool", F.when(name == query, 1).when(name.startswith(query[:3]), 2).otherwise(3))
    some = some.join(gram_lists(paths, query), "workspace", "left")
    order = F.when(name == query, 1).when(name.startswith(query[:3]), 2)
    order = order.when(F.col("common").isNotNull() & F.forall(F.coalesce("common", F.array().cast("array<string>")), lambda g: F.contains(name, g)), 3)
    order = order.when(F.col("rare").isNotNull() & F.contains(name, F.col("rare")), 4).otherwise(5)
    if whole is not None and (held := holds_segments(whole)) is not None:
        order = F.when(held, 0).otherwise(order)
    return some.withColumn("pool", order).drop("common", "rare")


def most_candidates(query: str, most: int) -> int:
    return max(0, min(most, MOST_BY_LENGTH.get(len(query), most)))


def budget(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` of pooled rows, in order of pool, workspace and seq."""
    return rows.orderBy("pool", "workspace", "seq", "relative_path").limit(max(0, most))


def rarest_gram(posts: DataFrame, query: str) -> DataFrame:
    """Paths on the list of the query's rarest pair in each workspace, the first of equally rare ones; a pair that is absent empties the result there."""
    want = query_grams(query)
    n = posts.where(F.col("token").isin(want)).groupBy("workspace", "token").agg(F.count("*").alias("n"))
    at = F.array_position(F.array(*map(F.lit, want)), F.col("token"))
    best = n.groupBy("workspace").agg(F.count("*").alias("have"), F.min(F.struct("n", at.alias("at"), "token"))["token"].alias("token")).where(F.col("have") == len(want))
    return posts.join(best.select("workspace", "token"), ["workspace", "token"]).select("workspace", "relative_path")


def common_grams(posts: DataFrame, query: str, most: int = LISTS) -> DataFrame:
    """Paths on the lists of the `most` rarest present pairs of each workspace; absent pairs don't count, but two must be there. Queries of two characters have none."""
    want = query_grams(query)
    n = posts.where(F.col("token").isin(want)).groupBy("workspace", "token").agg(F.count("*").alias("n"))
    at = F.array_position(F.array(*map(F.lit, want)), F.col("token"))
    best = n.withColumn("k", F.row_number().over(Window.partitionBy("workspace").orderBy("n", at))).where(F.col("k") <= most)
    best = best.withColumn("need", F.count("*").over(Window.partitionBy("workspace"))).where("need > 1").select("workspace", "token", "need")
    got = posts.join(best, ["workspace", "token"]).groupBy("workspace", "relative_path").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    return got.where("n = need").select("workspace", "relative_path")


def holds_segments(query: str) -> Column | None:
    """Whether a path holds the first 3 characters of every query segment as the beginning of some segment, in any order; none for fewer than two."""
    want = list(dict.fromkeys(s[:3] for s in query.split("/") if s))
    if len(want) < 2:
        return None
    return reduce(Column.__and__, (F.array_contains(segment_prefixes(F.col("norm_path")), w) for w in want))


def all_segments(paths: DataFrame, query: str) -> DataFrame:
    """Paths that hold the segments of a query."""
    held = holds_segments(query)
    return paths.limit(0) if held is None else paths.where(held)


def directory_by_suffix(paths: DataFrame, typed: str, workspace: str | None = None, same_name_most: int = 2000) -> DataFrame:
    """The directory that a typed chain means: the only one of that path, one a workspace, else the only one that ends so; none if several, or if too many entries share its name."""
    q = normal_query(typed).strip("/")
    some = paths if workspace is None else paths.where(F.col("workspace") == workspace)
    dirs = some.where("kind = 'directory'")
    if "/" not in q:
        return dirs.limit(0)
    exact = by_path(some, q).where("kind = 'directory'")
    n_exact = exact.limit(2).count()
    if n_exact:
        return exact.where(F.lit(n_exact == 1))
    if some.where(F.col("norm_name") == q.rpartition("/")[2]).limit(same_name_most + 1).count() > same_name_most:
        return dirs.limit(0)
    ends = dirs.where(F.col("norm_path").endswith("/" + q))
    return ends.where(F.lit(ends.limit(2).count() == 1))
