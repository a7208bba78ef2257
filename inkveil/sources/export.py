"""Export of many documents at once, under names that collide with none that stand there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIX = r"^(.*) \(([1-9][0-9]{0,8})\)$"


def safe_name(name: Column) -> Column:
    """A file name without folders, control characters or characters that file systems refuse; `document` if nothing is left."""
    base = F.regexp_replace(F.coalesce(name, F.lit("")), "^.*[/\\\\\\\\]", "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(base, '[\\x00-\\x1f<>:"|?*]', "_"), "^\\.+", ""))
    return F.when(clean == "", "document").otherwise(clean)


def is_document_id(value: Column) -> Column:
    """Whether a value is an id that may stand in a path: letters, digits, - and _, 1 to 64 of them."""
    return F.coalesce(value.rlike("^[A-Za-z0-9_-]{1,64}\\z"), F.lit(False))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """name of every file in a folder (and below), by Spark's own file source; none if there is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "name string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"))


def numbered_names(wanted: DataFrame, standing: DataFrame) -> DataFrame:
    """wanted (doc_id, stem, extension) with file_name: the stem where it is free, else the stem with the least free numbers,
    "stem (1)", "stem (2)" and so on, by doc_id; standing has the names that are there.

    Numbers are counted within a stem and extension; those that stand there are passed over by an anti-join with the
    numbers that can be dealt: as many as are wanted and stand there. A wanted stem that looks numbered keeps clear of
    the numbers dealt to others, as it is taken for number n of its own stem."""
    parts = lambda stem: (F.when(stem.rlike(SUFFIX), F.regexp_extract(stem, SUFFIX, 1)).otherwise(stem), F.when(stem.rlike(SUFFIX), F.regexp_extract(stem, SUFFIX, 2).cast("long")).otherwise(F.lit(0).cast("long")))
    root, _ = parts(F.col("stem"))
    asked = wanted.withColumn("__root", root)
    order = Window.partitionBy("__root", "extension").orderBy("stem", "doc_id")
    asked = asked.withColumn("__turn", F.row_number().over(order))
    name = F.regexp_replace("name", r"\.[^.]*$", "")
    there_root, there_n = parts(name)
    there = standing.select(there_root.alias("__root"), F.regexp_extract("name", r"(\.[^.]*)$", 1).alias("extension"), there_n.alias("__n")).distinct()
    counts = asked.groupBy("__root", "extension").agg(F.count("*").alias("__asked"))
    held = there.groupBy("__root", "extension").agg(F.count("*").alias("__held"))
    most = counts.join(held, ["__root", "extension"], "left").select("__root", "extension", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__asked") + F.coalesce("__held", F.lit(0)))).alias("__n"))
    free = most.join(there, ["__root", "extension", "__n"], "left_anti")
    free = free.withColumn("__turn", F.row_number().over(Window.partitionBy("__root", "extension").orderBy("__n")))
    out = asked.join(free, ["__root", "extension", "__turn"])
    file_name = F.concat("__root", F.when(F.col("__n") > 0, F.format_string(" (%d)", "__n")).otherwise(""), "extension")
    return out.select(*wanted.columns, file_name.alias("file_name"))


def export_texts(pages: DataFrame, names: DataFrame, folder: str, extension: str = ".txt") -> DataFrame:
    """Write each document's pages (doc_id, page_number, text) as rows of a partition of `folder` named by its file, and
    give doc_id and file_name. names has doc_id and original_filename; documents without a name are `document`.

    One Spark write appends all documents; names follow from what stands in the folder, so a second run overwrites nothing."""
    spark = pages.sparkSession
    stem = F.regexp_replace(safe_name(F.col("original_filename")), r"\.[^.]*$", "")
    asked = pages.select("doc_id").distinct().join(names.groupBy("doc_id").agg(F.min("original_filename").alias("original_filename")), "doc_id", "left")
    asked = asked.select("doc_id", F.concat(stem, F.lit("_anonymized")).alias("stem"), F.lit(extension).alias("extension"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []  # names of files, as a listing has them
    standing = spark.createDataFrame([(spark._jvm.java.net.URLDecoder.decode(n.partition("=")[2], "UTF-8"),) for n in there if n.startswith("file_name=")], "name string")
    dealt = numbered_names(asked, standing).select("doc_id", "file_name")
    from inkveil.operators.store import stored

    dealt = stored(dealt)
    rows = pages.join(dealt, "doc_id").select("file_name", "doc_id", "page_number", "text")
    rows.repartition("file_name").sortWithinPartitions("file_name", "page_number").write.partitionBy("file_name").mode("append").parquet(folder)
    return dealt
