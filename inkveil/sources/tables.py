"""Sources: tables of pages in, whatever holds them.

A page is (doc_id, page_number, text). `documents` rows are pages of the document that `source`
names; `pages` rows are web pages whose tags are stripped; text and JSON folders are read as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = ("pdf", "jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp", "docx", "xlsx", "pptx", "doc", "xls", "ppt")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def document_pages(docs: DataFrame) -> DataFrame:
    """Rows of documents as pages: the source is the document, the id the page number."""
    return docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))


def strip_tags(html: Column) -> Column:
    """The text of a web page: scripts, styles and tags out, the commonest entities resolved."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def web_pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.coalesce("url", F.lit("")).alias("doc_id"), F.col("page_id").alias("page_number"), strip_tags(F.coalesce("html", F.lit(""))).alias("text"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One page per text or CSV file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.lit(1).cast("long").alias("page_number"), F.col("value").alias("text"))


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents stored as JSON, one per file; broken ones are skipped. Returns their pages."""
    kind = "doc_id string, pages array<struct<page_number:long,full_text:string>>"
    read = spark.read.schema(kind).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
    return read.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page_number", F.col("p.full_text").alias("text"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Words of a word list or a spelling dictionary (flags after a slash): lower case, two letters at least, no digits."""
    word = F.lower(F.trim(F.element_at(F.split("value", "/"), 1)))
    return spark.read.text(path).select(word.alias("word")).where((F.length("word") >= 2) & ~F.col("word").rlike("[0-9]")).distinct()


def mime_type(name: Column) -> Column:
    """The MIME type by extension, as far as the engine knows it."""
    # Extensions and their types.
    known = {"pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "webp": "image/webp", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint"}
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = F.lit("application/octet-stream")
    for k, v in known.items():
        out = F.when(ext == k, v).otherwise(out)
    return out
