"""Keeping the index up to date by create and delete events, and snapshots of it by workspace."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_path, with_normal
from . import store
from .index import by_path, numbered

#: Fixed value: the share of removed ids from which a workspace is numbered anew.
COMPACT_FROM = 0.2


def last_change(changes: DataFrame) -> DataFrame:
    """One change for each (workspace, relative_path): the last by seq, all columns."""
    rest = [c for c in changes.columns if c not in ("workspace", "relative_path")]
    last = changes.groupBy("workspace", "relative_path").agg(F.max_by(F.struct(*rest), "seq").alias("_last"))
    return last.select("workspace", "relative_path", *(F.col("_last")[c].alias(c) for c in rest))


def remove_subtree(paths: DataFrame, workspace: str, relative_path: str) -> DataFrame:
    """Without the entry of that path in the workspace (case as given, else any case) and, if it is a directory, all below it."""
    root = by_path(paths, relative_path, workspace).select(F.col("relative_path").alias("_r"), F.col("norm_path").alias("_n"), F.col("kind").alias("_kind"))
    below = (F.col("_kind") == "directory") & F.col("norm_path").startswith(F.concat("_n", F.lit("/")))
    return paths.join(F.broadcast(root), (F.col("workspace") == workspace) & ((F.col("relative_path") == F.col("_r")) | below), "left_anti")  # one row


def discard(paths: DataFrame, entry: tuple[str, str]) -> DataFrame:
    """Without an entry (workspace, relative_path) that a search gave and that is no longer there, and all below it."""
    return remove_subtree(paths, *entry)


def _spot(workspace: Column, norm: Column) -> Column:
    return F.concat(workspace, F.lit("\0"), norm)


def _below(gone: list[str]) -> Column:
    """Whether a directory above the path is among `gone`, spots of directories."""
    parts = F.split("norm_parent", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: _spot(F.col("workspace"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.exists(above, lambda a: a.isin(gone)) if gone else F.lit(False)


def _without(live: DataFrame, roots: list[tuple]) -> DataFrame:
    """live without the entries (workspace, relative_path, norm_path, kind) and what is below those that are directories."""
    if not roots:
        return live
    gone = live.sparkSession.createDataFrame([r[:2] for r in roots], "workspace string, relative_path string")
    left = live.join(F.broadcast(gone), ["workspace", "relative_path"], "left_anti")  # a row or two a change
    return left.where(~_below([f"{w}\0{n}" for w, _, n, kind in roots if kind == "directory"]))


def _at(live: DataFrame, spots: list[str]) -> dict[str, list]:
    """The entries at some spots, whatever their case, by seq."""
    if not spots:
        return {}
    out: dict[str, list] = {}
    for r in live.where(_spot(F.col("workspace"), F.col("norm_path")).isin(spots)).select("workspace", "relative_path", "norm_path", "kind", "seq").orderBy("seq", "relative_path").collect():  # variants in case of the changed paths
        out.setdefault(f"{r[0]}\0{r[2]}", []).append((r[0], r[1], r[2], r[3]))
    return out


def apply_changes(live: DataFrame, changes: DataFrame, most: int = 2000, rebuild: Callable[[], DataFrame] | None = None, listing: DataFrame | None = None, entries_most: int = 0) -> DataFrame | None:
    """live (seq, workspace, kind, relative_path) after a batch of changes (seq, change, workspace, kind, relative_path).

    Deletes come first. Each takes away the entry of its path (of exact case, else the first that differs in case
    only) and what is below a directory. Creates follow, shorter paths first; each takes away the entry of its path
    in the same way and puts a new one there, unless another that differs in case only is left. With `listing`, the
    paths that are there now, what it has below created directories is added too, unless a path that differs in
    case only is there. No more entries are added than entries_most allows (0: any number).

    A batch of more than `most` paths isn't applied: the result is that of `rebuild`, or None without one. So the
    driver holds at most `most` changes. Changes whose path is null or empty are ignored.
    """
    last = last_change(changes.where("workspace is not null and relative_path <> ''"))
    batch = last.select("change", "workspace", "kind", F.regexp_replace("relative_path", "/$", "").alias("relative_path"), "seq").limit(most + 1).collect()
    if len(batch) > most:
        return rebuild() if rebuild else None
    columns = ["seq", "workspace", "kind", "relative_path"]
    spark, now = live.sparkSession, with_normal(live.select(columns))
    norms = {r["relative_path"]: r["n"] for r in spark.createDataFrame([(r["relative_path"],) for r in batch], "relative_path string").select("relative_path", normal_path(F.col("relative_path")).alias("n")).collect()}
    spot = lambda r: f"{r['workspace']}\0{norms[r['relative_path']]}"

    def take(there: list, path: str):
        """Takes the entry of a path out of those at its spot."""
        hit = next((e for e in there if e[1] == path), there[0] if there else None)
        if hit:
            there.remove(hit)
        return hit

    deletes = sorted((r for r in batch if r["change"] == "delete"), key=lambda r: r["seq"])
    there = _at(now, sorted({spot(r) for r in deletes}))
    now = _without(now, [hit for r in deletes if (hit := take(there.get(spot(r), []), r["relative_path"]))])

    creates = sorted((r for r in batch if r["change"] == "create"), key=lambda r: (len(r["relative_path"]), r["seq"]))
    there, gone, new = _at(now, sorted({spot(r) for r in creates})), [], {}
    for r in creates:
        mine = there.setdefault(spot(r), [])
        hit = take(mine, r["relative_path"])
        if hit and new.pop(hit[:2], None) is None:
            gone.append(hit)
        if not mine:
            mine.append((r["workspace"], r["relative_path"], norms[r["relative_path"]], r["kind"] or "file"))
            new[r["workspace"], r["relative_path"]] = (r["workspace"], r["kind"] or "file", r["relative_path"])
    now = _without(now, gone)
    added = spark.createDataFrame([(i, *e) for i, e in enumerate(new.values())], "_new long, workspace string, kind string, relative_path string")
    if listing is not None:
        made = [f"{w}\0{norms[p]}" for w, kind, p in new.values() if kind == "directory"]
        fresh = with_normal(listing.select(columns)).where(_below(made)).join(F.broadcast(added), ["workspace", "relative_path"], "left_anti")
        spots = now.select("workspace", "norm_path").unionByName(with_normal(added.withColumn("seq", F.lit(0))).select("workspace", "norm_path"))
        fresh = fresh.join(spots, ["workspace", "norm_path"], "left_anti").dropDuplicates(["workspace", "norm_path"])
        fresh = fresh.withColumn("_by", F.xxhash64("workspace", "relative_path"))
        added = added.unionByName(numbered(fresh, [], ["_by", "workspace", "relative_path"], "_new").select((F.col("_new") + len(new)).alias("_new"), "workspace", "kind", "relative_path"))
    if entries_most:
        added = added.orderBy("_new").limit(max(0, entries_most - now.count()))
    top = now.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
    return now.select(columns).unionByName(added.select((F.col("_new") + top).alias("seq"), "workspace", "kind", "relative_path"))


def add_scope(live: DataFrame, listing: DataFrame, workspace: str, scope: str) -> DataFrame:
    """live with a directory of the listing and all below it, for an index that was cut at a depth; paths there in any case stay as they are."""
    norm = normal_path(F.lit(scope.strip("/")))
    some = with_normal(listing).where(F.col("workspace") == workspace).where((F.col("norm_path") == norm) | F.col("norm_path").startswith(F.concat(norm, F.lit("/"))))
    held = with_normal(live).select("workspace", "norm_path")
    fresh = some.join(held, ["workspace", "norm_path"], "left_anti").dropDuplicates(["workspace", "norm_path"])
    top = live.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    columns = ["seq", "workspace", "kind", "relative_path"]
    fresh = fresh.drop("seq").withColumn("_by", F.xxhash64("workspace", "relative_path"))
    return live.select(columns).unionByName(numbered(fresh, [], ["_by", "workspace", "relative_path"], "seq").withColumn("seq", F.col("seq") + top).select(columns))


# --- snapshots: where/<workspace>/v<version>/ and where/manifest.json


def folder(workspace: str) -> str:
    """A name for the files of a workspace."""
    plain = "".join(c if c.isascii() and (c.isalnum() or c in ".-") else "_" for c in workspace)[:80]
    return f"{plain}-{zlib.crc32(workspace.encode()):08x}"


def manifest(spark: SparkSession, where: str) -> dict:
    """What is in force: batch, and for each workspace its version, fingerprint, at_ms, capacity (highest id), size, partial, limited."""
    return store.get(spark, f"{where}/manifest.json") or {"batch": -1, "workspaces": {}}


def save(paths: DataFrame, where: str, fingerprints: dict[str, str], batch: int = -1, at_ms: int | None = None, drop: list[str] = (), partial: bool = False, limited: bool = False) -> None:
    """New versions of the workspaces that `fingerprints` names, from paths (seq, workspace, kind, relative_path); the others stay as they are, those in `drop` go.

    The manifest, put in place by one rename after all else, switches to them. Ids are the seq of rows that have
    one each; a workspace of which a share of COMPACT_FROM ids is unused, and a new one, is numbered anew from 1.
    Versions that are two old go.
    """
    spark = paths.sparkSession
    entries = dict(manifest(spark, where)["workspaces"])
    at_ms = int(time.time() * 1000) if at_ms is None else at_ms
    for workspace, fingerprint in fingerprints.items():
        version = entries.get(workspace, {"version": 0})["version"] + 1
        mine = paths.where(F.col("workspace") == workspace).dropDuplicates(["relative_path"])
        size, ids, top = mine.agg(F.count("*"), F.count_distinct("seq"), F.coalesce(F.max("seq"), F.lit(0))).first()
        if version == 1 or ids < size or top - size >= COMPACT_FROM * top:
            mine, top = numbered(mine, [], ["seq", "relative_path"], "entry_id"), size
        else:
            mine = mine.withColumn("entry_id", F.col("seq"))
        mine.select("entry_id", "kind", "relative_path").write.mode("overwrite").parquet(f"{where}/{folder(workspace)}/v{version}")
        entries[workspace] = {"version": version, "fingerprint": fingerprint, "at_ms": at_ms, "capacity": top, "size": size, "partial": partial, "limited": limited}
    for workspace in drop:
        entries.pop(workspace, None)
    store.put(spark, f"{where}/manifest.json", {"batch": batch, "workspaces": entries})
    for workspace in fingerprints:
        for name in store.names(spark, f"{where}/{folder(workspace)}"):
            if name[1:].isdigit() and int(name[1:]) < entries[workspace]["version"] - 1:
                store.delete(spark, f"{where}/{folder(workspace)}/{name}")
    for workspace in drop:
        store.delete(spark, f"{where}/{folder(workspace)}")


def load(spark: SparkSession, where: str, fingerprints: dict[str, str], now_ms: int = 0, age_most_ms: int = 0) -> tuple[DataFrame, list[str]]:
    """The entries (seq, workspace, kind, relative_path) of the workspaces whose snapshot was made for the same settings and isn't too old (0: any age), and the names of those that have none.

    Rows without a path or of an unknown kind are skipped.
    """
    entries, missing = manifest(spark, where)["workspaces"], []
    out = spark.createDataFrame([], "seq long, workspace string, kind string, relative_path string")
    for workspace, fingerprint in fingerprints.items():
        m = entries.get(workspace)
        if not m or m["fingerprint"] != fingerprint or (age_most_ms and now_ms - m["at_ms"] > age_most_ms):
            missing.append(workspace)
            continue
        rows = spark.read.schema("entry_id long, kind string, relative_path string").parquet(f"{where}/{folder(workspace)}/v{m['version']}")
        rows = rows.where("kind in ('file', 'directory') and relative_path is not null")
        out = out.unionByName(rows.select(F.col("entry_id").alias("seq"), F.lit(workspace).alias("workspace"), "kind", "relative_path"))
    return out, missing


def dirty(before: DataFrame, after: DataFrame) -> list[str]:
    """Names of the workspaces whose entries differ; workspaces are few."""
    columns = ["workspace", "kind", "relative_path"]
    digest = lambda df: df.select(*columns, F.xxhash64(*columns).alias("h")).groupBy("workspace").agg(F.count("*").alias("n"), F.sum(F.pmod("h", F.lit(2**31 - 1))).alias("s"))
    both = digest(before).join(digest(after).withColumnsRenamed({"n": "n2", "s": "s2"}), "workspace", "full")
    return [r[0] for r in both.where(~(F.col("n").eqNullSafe(F.col("n2")) & F.col("s").eqNullSafe(F.col("s2")))).select("workspace").collect()]
