"""Tables in versions: a write makes a new folder beside the old one, and one rename of a small file switches to it.

A crash between the two leaves the old version in force, and what it left is removed by the next write. Readers
that began on the version before last may lose it; a version is kept until the second write after it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def put(spark: SparkSession, path: str, value: dict) -> None:
    """Writes a small JSON file whole: a hidden file first, then a rename over the old one."""
    fs, p = _fs(spark, path)
    temp = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), "." + p.getName() + ".new")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    # FileContext renames over what is there in one step
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), "OVERWRITE")
    context.rename(fs.makeQualified(temp), fs.makeQualified(p), options)


def get(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    with_scheme = fs.makeQualified(p).toString()
    text = "".join(r[0] for r in spark.read.text(with_scheme, wholetext=True).collect())  # one small file
    return json.loads(text)


def replace_table(rows: DataFrame, where: str, form: str) -> None:
    spark = rows.sparkSession
    now = get(spark, f"{where}/current.json")
    version = (now["version"] if now else 0) + 1
    rows.write.mode("overwrite").format(form).save(f"{where}/v{version}")
    put(spark, f"{where}/current.json", {"version": version})
    for name in names(spark, where):
        if name.startswith("v") and name[1:].isdigit() and int(name[1:]) < version - 1:
            delete(spark, f"{where}/{name}")


def table_in(spark: SparkSession, where: str, form: str, schema: str) -> DataFrame:
    now = get(spark, f"{where}/current.json")
    if now is None:
        return spark.createDataFrame([], schema)
    return spark.read.format(form).schema(schema).load(f"{where}/v{now['version']}")
