"""Token counts through a digest cache.

Contents are named by SHA-256, tokenizers by the SHA-256 of their file. Counts already stored for a
(content, tokenizer) pair are joined; each distinct content that misses is encoded once, and its
count is appended to the cache before the join. Counting normalises nothing but null (taken as
empty): a tokenizer may count two texts differently that differ in one byte.

Defined results: null and empty texts have 0 bytes and 0 tokens; every input row gives one row,
repeated rows and null ids included; columns other than the id and the text are ignored, whatever
their names; an empty table gives an empty result. A content's text passes one task at a time;
copies are merged before the shuffle, so a text that a third of all rows share is one row a task, and
its count is sent to where its copies stand.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.common import Scratch, arrow, hot_keys, join_each, load, tune, whole

CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])
_LOADED: dict[str, object] = {}


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def counter(path: str):
    """texts -> token counts, by the library that the file is for; loaded once a worker."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_padding()
            tok.no_truncation()
            _LOADED[path] = lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    return _LOADED[path]


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table at path; an empty one is made where there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        spark.createDataFrame([], CACHE).write.mode("ignore").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def count_tokens(docs: DataFrame, cache_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, digest for every row; new contents are added to the cache first.

    Two runs that append at once may store a pair twice with the same count; reads take one."""
    spark = docs.sparkSession
    tune(spark)
    version = tokenizer_version(model_path)
    named = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = open_cache(spark, cache_path).where(F.col("tokenizer") == version)
    misses = named.groupBy("digest").agg(F.first("text").alias("text")).join(known.select("digest"), "digest", "left_anti")

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = counter(model_path)(batch.column("text").to_pylist())
        return pa.record_batch([batch.column("digest"), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    arrow(misses.select("digest", "text"), encode, CACHE.simpleString()[7:-1].replace(":", " ")).write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = named.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return join_each(rows, stored, "digest", hot_keys(rows, "digest")).select("doc_id", "n_bytes", "n_tokens", "digest")


def op1(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    import public_tokenizers

    cache = Scratch(spark, "token-counts").path("cache")
    out = count_tokens(load(spark, sf_dir, "documents"), cache, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
