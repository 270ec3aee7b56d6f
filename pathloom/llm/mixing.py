"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source are shuffled by a hash of their id and queue up once per pass, up to `repeats`
passes. A word that is the k-th of its source's queue has virtual finish time k / weight. In the order of
finish times the sources' words interleave by weight; a source that has run dry leaves its share to the
rest. The order is cut where the total budget is used up, at virtual time t with
sum(min(weight * t, repeats * size)) = budget, so each source gets min(weight * t, repeats * size) words,
its target, to the word. A document at the cut gives its first words only.

Null text has size 0; a null source is a source of its own, last in order. Equal rows queue one behind the
other. An empty table gives an empty mix. Columns besides those named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, running


def words(text: str = "text"):
    """Number of words: the starts, i.e. non-space code points at the start or after a space."""
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> tuple[DataFrame, float]:
    """From (source, source_size): (source, source_size, weight, target), and the virtual time of the cut.

    Weights repeat over the sources in code point order, null last. The cut's time rises by Newton's method
    on the concave total min(weight * t, repeats * size), one aggregated row a round; that is the rule of
    resharing the excess by weight until no target is above its bound.
    """
    ranked = running(sizes.withColumns({"one": F.lit(1), "last": F.col("source").isNull()}), [F.col("last"), F.col("source")], {"place": "one"})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * repeats).cast("double").alias("bound")))
    budget = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    t = 0.0
    while True:
        over = F.col("bound") <= F.col("weight") * F.lit(t)
        full, open_weight = ranked.agg(F.sum(F.when(over, F.col("bound"))), F.sum(F.when(over, None).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        at = (budget - (full or 0.0)) / open_weight
        if at <= t:
            break
        t = at
    target = F.least(F.col("bound"), F.col("weight") * F.lit(t))
    return ranked.withColumn("target", target), t


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix-1") -> DataFrame:
    """The mix in order: a row for each pass of a document that gives words.

    docs: doc_id, source, size. Returns doc_id, source, pass, size, words (given), virtual_start,
    virtual_finish, source_size, target, range-partitioned and sorted by virtual finish time; documents that
    give nothing are absent.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "source", F.col("size").cast("long").alias("size"), F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("long").alias("shuffled"))
    docs = cut(docs)
    targets, t = source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    # A source's queue is cut by shuffled position, evenly whatever the source's share; totals of the cuts
    # give their starts.
    cuts = 4 * partitions(spark)
    docs = docs.withColumn("slot", F.floor(F.col("shuffled") / F.lit((16**13) / cuts)).cast("int"))
    same = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    docs = docs.withColumns({"_s": same[0], "_n": same[1]})
    before = Window.partitionBy("_s", "_n").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = docs.groupBy("_s", "_n", "slot").agg(F.sum("size").alias("slot_size")).withColumn("slot_start", F.coalesce(F.sum("slot_size").over(before), F.lit(0)))
    slots = slots.join(targets.withColumns({"_s": same[0], "_n": same[1]}).drop("source"), ["_s", "_n"])
    inside = Window.partitionBy("_s", "_n", "slot").orderBy("shuffled", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(slots.select("_s", "_n", "slot", "slot_start", "source_size", "weight", "target"), ["_s", "_n", "slot"])
    placed = placed.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    start = F.col("slot_start") + F.col("before") + (F.col("pass") - 1) * F.col("source_size")
    placed = placed.withColumns({"start": start, "words": F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target").cast("long") - start))})
    placed = placed.withColumns({"virtual_start": F.col("start") / F.col("weight"), "virtual_finish": (F.col("start") + F.col("size")) / F.col("weight")})
    taken = placed.where((F.col("virtual_start") < F.lit(t)) & (F.col("words") > 0))
    ordered = taken.repartitionByRange(partitions(spark), "virtual_finish", "shuffled", "doc_id").sortWithinPartitions("virtual_finish", "shuffled", "doc_id", "pass")
    return ordered.select("doc_id", "source", "pass", "size", "words", "virtual_start", "virtual_finish", "source_size", "target"), targets


def mix_digest(docs: DataFrame, **params) -> DataFrame:
    """One row per row of docs (doc_id, source, text): size, its source's size and target, words taken."""
    sized = cut(docs.select("doc_id", "source", words().alias("size")))
    mixed, targets = mix(sized, **params)
    taken = mixed.groupBy("doc_id", "source", "size").agg(F.sum("words").alias("all_taken"))
    rows = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    null_safe = (rows.doc_id.eqNullSafe(taken.doc_id)) & rows.source.eqNullSafe(taken.source) & (rows.size == taken.size)
    out = rows.join(taken, null_safe, "left").select(rows.doc_id, rows.source, rows.size, "copies", F.coalesce("all_taken", F.lit(0)).alias("all_taken"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    # what equal rows give together is told apart by fullness, so that no row exceeds its passes
    passes = params.get("repeats", 2)
    out = out.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("size") * passes, F.col("all_taken") - (F.col("copy") - 1) * F.col("size") * passes)))
    t = targets.select(F.col("source").alias("_src"), "source_size", "target")
    return out.join(t, out.source.eqNullSafe(t._src)).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.col("taken").cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """Whole documents of the mix, columns as given, whatever their names: a row for each pass of which at least half is taken."""
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"], docs["source"], words().alias("size"))
    mixed, _ = mix(rows.select("doc_id", "source", "size"), **params)
    chosen = mixed.where(F.col("words") * 2 >= F.col("size")).groupBy("doc_id").agg(F.count("*").alias("copies"))
    same = rows.groupBy("doc_id").agg(F.count("*").alias("rows"))
    # rows that share an id share its passes
    chosen = chosen.join(same, chosen.doc_id.eqNullSafe(same.doc_id)).select(chosen.doc_id.alias("id"), F.greatest(F.lit(1), F.ceil(F.col("copies") / F.col("rows")).cast("int")).alias("times"))
    out = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")))
    return out.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
