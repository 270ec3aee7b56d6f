"""What was opened and chosen, by entry: counting, the newest, pinning, keeping.

An entry is (workspace, kind, relative_path); the same path in another workspace, or of another kind, is another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, normal_query, normal_query_column, relative_to

ENTRY = ["workspace", "kind", "relative_path"]
HISTORY = "workspace string, kind string, relative_path string, last_ms long, opens long, pinned boolean"
CHOICES = "query string, workspace string, kind string, relative_path string, affinity long, last_ms long"


def opened(log: DataFrame, workspaces: DataFrame) -> DataFrame:
    """workspace, kind, relative_path, at_ms from (uri, at_ms) and (workspace, root): the file's path below the deepest root that holds it; files outside all roots are left out."""
    roots = F.broadcast(workspaces.select("workspace", "root"))  # roots that a user opens are few
    below = log.join(roots, relative_to(F.col("uri"), F.col("root")).isNotNull())
    below = below.withColumns({"relative_path": relative_to(F.col("uri"), F.col("root")), "kind": F.lit("file")})
    deepest = Window.partitionBy("uri", "at_ms").orderBy(F.desc(F.length("root")), "workspace")
    below = below.where(base_name(F.col("relative_path")) != "").withColumn("_k", F.dense_rank().over(deepest)).where("_k = 1")
    return below.select(*ENTRY, "at_ms")


def count_opens(log: DataFrame, apart_ms: int = 1000) -> DataFrame:
    """workspace, kind, relative_path, last_ms, opens from a log with at_ms: an event under a second after the one before doesn't count, but moves last_ms."""
    gap = F.col("at_ms") - F.lag("at_ms").over(Window.partitionBy(*ENTRY).orderBy("at_ms"))
    counts = F.when(gap.isNull() | (gap >= apart_ms), 1).otherwise(0)
    return log.withColumn("n", counts).groupBy(*ENTRY).agg(F.max("at_ms").alias("last_ms"), F.sum("n").alias("opens"))


def newest(history: DataFrame, n: int = 200) -> DataFrame:
    """At most n: pinned first, then newest first, then by entry."""
    return history.orderBy(F.coalesce("pinned", F.lit(False)).desc(), F.desc("last_ms"), "relative_path", "workspace", "kind").limit(max(0, n))


def choices(log: DataFrame) -> DataFrame:
    """query, the entry, affinity, last_ms from a log of (query, the entry, at_ms): how often an entry was chosen for a query; normalized queries of 2 characters or more count."""
    asked = log.withColumn("query", normal_query_column(F.col("query"))).where(F.length("query") >= 2)
    return asked.groupBy("query", *ENTRY).agg(F.count("*").alias("affinity"), F.max("at_ms").alias("last_ms"))


def newest_choices(chosen: DataFrame, n: int = 500) -> DataFrame:
    """At most n, newest first."""
    return chosen.orderBy(F.desc("last_ms"), "query", "relative_path", "workspace", "kind").limit(max(0, n))


def with_affinity(history: DataFrame, chosen: DataFrame, query: str) -> DataFrame:
    """history with affinity: how often each entry was chosen for just this query; null for never, and for queries of a character."""
    q = normal_query(query)
    if len(q) < 2:
        return history.withColumn("affinity", F.lit(None).cast("long"))
    return history.join(chosen.where(F.col("query") == q).select(*ENTRY, "affinity"), ENTRY, "left")


def toggle_pin(history: DataFrame, workspace: str, kind: str, relative_path: str) -> DataFrame:
    """Flips the pin of an entry, and keeps the other columns; one without history gets a row that was never opened."""
    one = history.sparkSession.createDataFrame([(workspace, kind, relative_path, True)], "workspace string, kind string, relative_path string, _flip boolean")
    out = history.join(one, ENTRY, "full")
    pinned = F.coalesce("pinned", F.lit(False))
    fresh = {"last_ms": F.coalesce("last_ms", F.lit(0)), "opens": F.coalesce("opens", F.lit(0)), "pinned": F.when(F.col("_flip"), ~pinned).otherwise(F.col("pinned"))}
    return out.withColumns(fresh).select(history.columns)


def keep(rows: DataFrame, where: str) -> None:
    """Writes history or choices as JSON lines; the reader sees the old or the new ones whole."""
    from .store import replace_table

    replace_table(rows, where, "json")


def kept(spark: SparkSession, where: str, schema: str = HISTORY) -> DataFrame:
    """What keep wrote, or an empty table; rows that aren't as they should be are skipped, the last of an entry counts."""
    from .store import table_in

    rows = table_in(spark, where, "json", schema)
    if "pinned" in rows.columns:
        return rows.where("workspace is not null and kind in ('file', 'directory') and relative_path is not null and last_ms is not null and opens is not null").dropDuplicates(ENTRY)
    return rows.where("query is not null and workspace is not null and kind in ('file', 'directory') and relative_path is not null and affinity is not null and last_ms is not null").dropDuplicates(["query", *ENTRY])
