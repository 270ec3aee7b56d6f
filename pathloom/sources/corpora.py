"""Path tables derived from the driver's tables: workspace, kind, relative path, in a fixed input order `seq`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ancestors, with_normal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    path = F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), F.translate("p_name", " ", "_"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".item"))
    return p.select(F.col("p_partkey").alias("seq"), F.lit("parts").alias("workspace"), F.lit("file").alias("kind"), path.alias("relative_path"))


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and the directories above them; a directory's seq is below all files'."""
    files = part_files(spark, sf_dir)
    dirs = files.select("workspace", F.explode(ancestors(F.col("relative_path"))).alias("relative_path")).distinct()
    dirs = dirs.select(F.lit(-1).cast("long").alias("seq"), "workspace", F.lit("directory").alias("kind"), "relative_path")
    return with_normal(files.unionByName(dirs))


def brand_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts again, with brands as workspaces: files and the directories above them; seq counts files, directories have -1."""
    files = brand_files(spark, sf_dir)
    dirs = files.select("workspace", F.explode(ancestors(F.col("relative_path"))).alias("relative_path")).distinct()
    dirs = dirs.select(F.lit(-1).cast("long").alias("seq"), "workspace", F.lit("directory").alias("kind"), "relative_path")
    return with_normal(files.unionByName(dirs))


def brand_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    path = F.concat("p_type", F.lit("/"), F.translate("p_name", " ", "_"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".item"))
    return p.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("workspace"), F.lit("file").alias("kind"), path.alias("relative_path"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as workspaces, paths without query, fragment and outer slashes; the same path may come again."""
    rest = F.regexp_extract("url", r"^[^:]+://(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.regexp_extract(rest, r"^([^/?#]*)", 1).alias("workspace"), F.lit("file").alias("kind"), path.alias("relative_path"))


ENTRY = ["workspace", "kind", "relative_path"]


def opens(spark: SparkSession, sf_dir: str, files=part_files) -> DataFrame:
    """lineitem as a log of opened part files: the entry, at_ms."""
    paths = files(spark, sf_dir).select(F.col("seq").alias("l_partkey"), *ENTRY)
    log = table(spark, sf_dir, "lineitem").select("l_partkey", F.expr("unix_millis(cast(l_shipdate as timestamp))").alias("at_ms"))
    return log.join(paths, "l_partkey").select(*ENTRY, "at_ms")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of chosen part files: query, as typed, the entry, at_ms."""
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    typed = F.element_at(F.array(F.lit("ge"), F.lit(" G EAR"), F.lit("n")), (F.col("event_id") % 3 + 1).cast("int"))
    e = table(spark, sf_dir, "events").where("event_type = 'click'").join(F.broadcast(n))  # one row
    e = e.select((F.col("event_id") % F.col("n")).alias("seq"), typed.alias("query"), F.expr("unix_millis(cast(ts as timestamp))").alias("at_ms"))
    return e.join(part_files(spark, sf_dir), "seq").select("query", *ENTRY, "at_ms")


def changes(spark: SparkSession, sf_dir: str, files=part_files) -> DataFrame:
    """events as changes of part files: an error deletes, a signup creates."""
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup")).join(F.broadcast(n))  # one row
    e = e.select(F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", "delete").otherwise("create").alias("change"), (F.col("event_id") % F.col("n")).alias("seq"))
    return e.join(files(spark, sf_dir), "seq").select(F.col("at").alias("seq"), "change", *ENTRY)


def unborn(changes: DataFrame) -> DataFrame:
    """The entries that the log creates first: those that weren't there before it."""
    return changes.groupBy(*ENTRY).agg(F.min_by("change", "seq").alias("first")).where("first = 'create'").drop("first")
