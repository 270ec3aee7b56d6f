"""Building the index: first of equal paths, ids, postings, exclusions, depth, quotas, lookups and counters."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grams, name_prefixes, segment_prefixes, suffix_list

#: Directory names that are left out by default.
EXCLUDED_NAMES = (".git", "node_modules", ".next", ".turbo", ".venv", "venv", ".cache", ".pytest_cache", ".mypy_cache", ".ruff_cache", "__pycache__", "coverage", "dist", "out", "build", "target")


@dataclass(frozen=True)
class Settings:
    """What decides which paths an index holds; most and depth: 0 for no limit."""

    excluded_names: tuple[str, ...] = EXCLUDED_NAMES
    excluded_suffixes: tuple[str, ...] = ()
    most: int = 500_000
    depth: int = 0

    def fingerprint(self, workspace: str) -> str:
        """Text that differs where a saved index of the workspace can't be used; the order of lists doesn't count."""
        names, suffixes = sorted({n.strip().lower() for n in self.excluded_names if n.strip()}), sorted(suffix_list(list(self.excluded_suffixes)))
        return json.dumps({**asdict(self), "excluded_names": names, "excluded_suffixes": suffixes, "workspace": workspace, "version": 1}, sort_keys=True)


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, parts: int = 256) -> DataFrame:
    """rows with `name`, counting up from 1 in each group by `order`, which must be total; the first of it must be a number.

    Rows are cut into at most `parts` ranges at quantiles of that number. Each range of a group counts its own, and
    one row for each group and range says where it starts, so a group of any size is spread over tasks.
    """
    spark = rows.sparkSession
    n = min(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = rows.agg(F.percentile_approx(order[0], [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    edges = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<long>")
    placed = rows.withColumn("_part", F.size(F.filter(edges, lambda b: b <= F.coalesce(F.col(order[0]), F.lit(-(2**63))))))
    sizes = placed.groupBy("_part", *group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = placed.withColumn("_here", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(starts, same).withColumn(name, F.col("_start") + F.col("_here")).drop("_part", "_here", "_p", "_start", *(f"_g{i}" for i in range(len(group))))


def first_of_equal(paths: DataFrame) -> DataFrame:
    """One row for each (workspace, relative_path), the first by seq, kind ignored; entry_id counts up within the workspace."""
    one = paths.withColumn("_k", F.row_number().over(Window.partitionBy("workspace", "relative_path").orderBy("seq", "kind"))).where("_k = 1").drop("_k")
    return numbered(one, ["workspace"], ["seq", "relative_path"], "entry_id")


def postings(paths: DataFrame, kind: str) -> DataFrame:
    """(workspace, token, relative_path): beginnings of names, pairs of characters of names, or beginnings of segments."""
    of = {"prefix": name_prefixes(F.col("norm_name")), "bigram": grams(F.col("norm_name"), 2), "segment": segment_prefixes(F.col("norm_path"))}[kind]
    return paths.select("workspace", F.explode(of).alias("token"), "relative_path")


def exclude(paths: DataFrame, directories: list[str] = EXCLUDED_NAMES, suffixes: list[str] = ()) -> DataFrame:
    """Without paths under, or directories of, the given names, and without files of the given suffixes."""
    segments = F.split("norm_path", "/")
    dirs = F.when(F.col("kind") == "directory", segments).otherwise(F.slice(segments, F.lit(1), F.size(segments) - 1))
    names = sorted({d.strip().lower() for d in directories if d.strip()})
    out = paths.where(~F.arrays_overlap(dirs, F.array(*map(F.lit, names)))) if names else paths
    for s in suffix_list(list(suffixes)):
        out = out.where((F.col("kind") != "file") | ~F.col("norm_path").endswith(s))
    return out


def to_depth(paths: DataFrame, most: int) -> DataFrame:
    """Paths of at most `most` segments (0: all), with cut: whether what is below a directory is left out for that. An index with a cut directory is partial."""
    if not most:
        return paths.withColumn("cut", F.lit(False))
    return paths.where(F.col("depth") <= most).withColumn("cut", (F.col("depth") == most) & (F.col("kind") == "directory"))


def shares(sizes: DataFrame, most: int) -> DataFrame:
    """workspace, share, limited, from (workspace, n): what each may hold of `most` (0: no limit).

    In order of name, a workspace gets an equal part, rounded up, of what those before left; limited: that it has more.
    One row a workspace comes to the driver; workspaces are roots that a user opens, so they are few.
    """
    got, left = [], most
    rows = sizes.orderBy("workspace").collect()
    for i, (name, n) in enumerate(rows):
        part = -(-left // (len(rows) - i)) if most else n
        got.append((name, min(n, part), n > part))
        left -= min(n, part)
    return sizes.sparkSession.createDataFrame(got, "workspace string, share long, limited boolean")


def quota(paths: DataFrame, most: int) -> DataFrame:
    """At most `most` entries (0: no limit) over all workspaces, by their shares; the lowest ids stay. limited: whether the row's workspace lost entries."""
    allowed = shares(paths.groupBy("workspace").agg(F.count("*").alias("n")), most)
    return paths.join(F.broadcast(allowed), "workspace").where(F.col("entry_id") <= F.col("share")).drop("share")


def same_entry(workspace: str, kind: str, relative_path: str) -> Column:
    return (F.col("workspace") == workspace) & (F.col("kind") == kind) & (F.col("relative_path") == relative_path)


def by_id(paths: DataFrame, workspace: str, entry_id: int) -> DataFrame:
    return paths.where((F.col("workspace") == workspace) & (F.col("entry_id") == entry_id))


def by_path(paths: DataFrame, path: str, workspace: str | None = None) -> DataFrame:
    """The entry of a path in each workspace (or the one given): of exact case, else the first that differs in case only."""
    from ..functions.text import normal_path

    path = path.removesuffix("/")
    some = paths.where(F.col("norm_path") == normal_path(F.lit(path)))
    if workspace is not None:
        some = some.where(F.col("workspace") == workspace)
    best = Window.partitionBy("workspace").orderBy(F.col("relative_path") != path, "seq", "relative_path")
    return some.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def by_identity(paths: DataFrame, workspace: str, kind: str, relative_path: str) -> DataFrame:
    """The entry of a path, as by_path finds it, if it is of that kind."""
    return by_path(paths, relative_path, workspace).where(F.col("kind") == kind)


def counters(paths: DataFrame, capacity: int | None = None) -> DataFrame:
    """workspace, files, directories, size; with the capacity of ids given, also what share of them was removed, over all."""
    out = paths.groupBy("workspace").agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "directory").alias("directories"), F.count("*").alias("size"))
    if capacity is None:
        return out
    total = out.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    return total.select("size", F.lit(capacity).alias("capacity"), F.when(F.lit(capacity) > 0, 1 - F.col("size") / capacity).otherwise(0.0).alias("removed_share"))
