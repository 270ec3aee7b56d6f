"""Change events as a stream: each micro-batch makes new versions of the workspaces that it touches, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.maintain import apply_changes, load, manifest, save


def keep_up(changes: DataFrame, where: str, fingerprints: dict[str, str], rebuild: Callable[[str], DataFrame], most: int = 2000, listing: DataFrame | None = None):
    """A started query over streaming changes (seq, change, workspace, kind, relative_path).

    A batch that was already applied is skipped, so replays change nothing. Workspaces without a valid snapshot, and
    all that a batch of more than `most` paths touches, are made anew by rebuild(workspace), which gives (seq,
    workspace, kind, relative_path). Changes in workspaces that fingerprints doesn't name are ignored.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        if manifest(spark, where)["batch"] >= number:
            return
        some = df.where(F.col("workspace").isin(list(fingerprints)))
        touched = [r[0] for r in some.select("workspace").distinct().collect()]  # at most as many as fingerprints
        live, missing = load(spark, where, fingerprints)
        after = apply_changes(live.where(F.col("workspace").isin(touched)), some.where(~F.col("workspace").isin(missing)) if missing else some, most, listing=listing)
        anew = missing if after is not None else sorted({*missing, *touched})
        if after is None:
            after = live.limit(0)
        for workspace in anew:
            after = after.where(F.col("workspace") != workspace).unionByName(rebuild(workspace).select("seq", "workspace", "kind", "relative_path"))
        save(after, where, {w: fingerprints[w] for w in {*touched, *anew}}, number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start()
