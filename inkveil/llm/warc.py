"""WARC archives: a deterministic sharded writer, and a reader.

Pages are range-sorted by id and digest. The ranges are cut where exact running sums of payload bytes
over all rows pass multiples of `range_bytes`, so they depend on the rows alone, not on how Spark dealt
them; each range is written as gzip members, one per record, and rolls to a new file when the
compressed size is reached. Headers, record ids and digests are regenerated from the row alone, so
equal input gives equal files, byte for byte, in whatever partitions it comes. Files are written under
temporary names that no other attempt uses; the manifest, a table that Spark commits as a whole, lists
those of attempts that succeeded; only then are they renamed, by tasks that may run again, and readers
follow the manifest alone. A lost executor or a second attempt therefore leaves stray temporary files
at most. Files are opened by pyarrow's file systems: file, hdfs, s3, gs and abfs paths.

Of records with equal payloads of at least `min_revisit` bytes the one with the smallest id is a
response, the others revisit it. The revisit marks travel as rows of their own through the same
range sort, so payloads are shuffled once and no group of equal payloads meets in one task.

Defined results: a null payload is empty; a null id is written without an id and never referred to;
rows that repeat the smallest id are responses too; a null URL is written as urn:none; other columns
are ignored, whatever their names; an empty table gives no files and an empty result. Rows that repeat
both id and payload stand in one range.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.common import Scratch, load, tune

#: Ranges are made larger where there would be more.
MOST_RANGES = 100_000
MANIFEST = "name string, temporary string, records long, bytes long, sha256 string"
READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}'.encode()).digest()[:16])}>"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member without a time stamp."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + squeeze.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c for c in url or "urn:none" if c not in "\r\n")
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return member(headers, block)


class _Roller:
    """Writes members to files of limited compressed size, none of which holds records of two ranges."""

    def __init__(self, root: str, limit: int):
        self.fs, self.base = pafs.FileSystem.from_uri(root)
        self.part, self.limit, self.turn, self.out, self.done = -1, limit, 0, None, []

    def write(self, raw: bytes, part: int) -> None:
        if part != self.part:
            self.close()
            self.part, self.turn = part, 0
        if self.out is None:
            self.name = f"pages-{self.part + 64:06d}-{self.turn:06d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.base}/_temporary", recursive=True)
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(f"{self.base}/{self.temporary}", compression=None), 0, 0, hashlib.sha256()
            info = f"software: inkveil\r\nformat: WARC File Format 1.1\r\nname: {self.name}\r\n".encode()
            self._put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(raw)
        self.records += 1
        if self.size >= self.limit:
            self.close()

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.sha.update(raw)
        self.size += len(raw)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.temporary, self.records, self.size, self.sha.hexdigest()))
            self.out, self.turn = None, self.turn + 1


def _writer(root: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, mark = _Roller(root, limit), None
        for batch in batches:
            for part, page_id, digest, kind, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("part", "page_id", "digest", "kind", "url", "payload", "refers_to")), strict=True):
                if kind == 0:
                    mark = (page_id, digest, refers_to)
                    continue
                revisit = mark is not None and mark[:2] == (page_id, digest)
                roller.write(page_record(page_id, url, payload.encode(), digest, mark[2] if revisit else None, revisit), part)
        roller.close()
        if roller.done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*roller.done, strict=True)], names=["name", "temporary", "records", "bytes", "sha256"])

    return run


def _commit(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
                if fs.get_file_info(f"{base}/{temporary}").type != pafs.FileType.NotFound:
                    fs.move(f"{base}/{temporary}", f"{base}/{name}")
                elif fs.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{base}/{name}")
            yield batch

    return run


def prefix(digest: str):
    """The first 60 bits of a digest, as a number that sorts alike."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def range_starts(rows: DataFrame, range_bytes: int, scratch: Scratch) -> list[tuple[int, int]]:
    """(page_id, prefix of the digest) of the first row of each range but the first. rows: (page_id, p, size), ids not null.

    Sums per partition and of the partitions before give each row its place among all bytes; a range
    starts with the first row at or beyond a multiple of range_bytes. One key of 16 bytes for each range
    comes to the driver, MOST_RANGES at most."""
    spark = rows.sparkSession
    once = rows.groupBy("page_id", "p").agg(F.sum("size").alias("size"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = scratch.save(scratch.save(once, "sizes").repartitionByRange(parts, "page_id", "p").withColumn("dealt", F.spark_partition_id()), "dealt")
    before = Window.orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("dealt").agg(F.sum("size").alias("bytes")).select("dealt", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("dealt").orderBy("page_id", "p").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("own")).join(F.broadcast(totals), "dealt")  # a row for each partition
    every = max(range_bytes, (dealt.agg(F.sum("size")).first()[0] or 0) // MOST_RANGES)
    placed = placed.select("page_id", "p", F.expr(f"(before + own) div {every}").alias("k"))
    starts = placed.where("k > 0").groupBy("k").agg(F.min(F.struct("page_id", "p")).alias("s")).select("s.page_id", "s.p").collect()
    return sorted((r.page_id, r.p) for r in starts)


def _range_of(starts: list[tuple[int, int]]):
    """Column function: the number of the range of (page_id, prefix); null ids stand in range -1 - (one of 64, by digest)."""
    ids, digests = (np.array([s[k] for s in starts], np.int64) for k in (0, 1))

    @F.pandas_udf("long")
    def number(page: pd.Series, p: pd.Series) -> pd.Series:
        null, page, p = page.isna().to_numpy(), page.fillna(0).to_numpy(np.int64), p.to_numpy(np.int64)
        lo, hi = np.searchsorted(ids, page, "left"), np.searchsorted(ids, page, "right")
        for k in np.flatnonzero(hi > lo):  # an id at which a range starts
            lo[k] += np.searchsorted(digests[lo[k] : hi[k]], p[k], "right")
        return pd.Series(np.where(null, -1 - (p & 63), lo))

    return number


def write_warc(pages: DataFrame, root: str, roll_bytes: int = 8 << 20, min_revisit: int = 100, range_bytes: int = 16 << 20, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all rows of pages to WARC files under root (a URI that all executors reach); returns the manifest."""
    spark = pages.sparkSession
    tune(spark)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    small = rows.select("page_id", "digest", F.octet_length("payload").alias("n"))
    scratch = Scratch(spark, "warc")
    starts = range_starts(small.where("page_id IS NOT NULL").select("page_id", prefix("digest").alias("p"), (F.col("n") + 400).cast("long").alias("size")), range_bytes, scratch)
    small = small.where(F.col("n") >= min_revisit).select("page_id", "digest")
    firsts = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    firsts = scratch.save(firsts, "firsts")
    marks = small.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    marks = marks.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), F.col("first").alias("refers_to"))
    rows = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = marks.union(rows).withColumn("part", _range_of(starts)("page_id", prefix("digest")))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "page_id", "digest", "kind", "url")
    written = scratch.save(dealt.mapInArrow(_writer(root, roll_bytes), MANIFEST), "written")
    written.mapInArrow(_commit(root), MANIFEST).write.parquet(f"{root}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped WARC stream, one member at a time."""
    left = b""
    while True:
        expand, parts = zlib.decompressobj(31), []
        while not expand.eof:
            left = left or stream.read(1 << 20)
            if not left:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(expand.decompress(left))
            left = expand.unused_data if expand.eof else b""
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def _reader(root: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for head, block in records(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        if f"sha256:{hashlib.sha256(block).hexdigest()}" != head["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: a block does not match its digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: a payload does not match its digest")
                        page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), head["WARC-Target-URI"], payload if with_payload and head["WARC-Type"] == "response" else None, size, digest, head["WARC-Type"], refers and int(refers)))
                        if len(rows) == 500:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_warc(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """All records of the files that the manifest lists; digests are verified. A file is one task's work."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")
    parts = max(1, min(manifest.count(), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("name").repartition(parts, "name").mapInArrow(_reader(root, with_payload), READ)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "warc-files").root
    write_warc(load(spark, sf_dir, "pages"), root)
    return read_warc(spark, root, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN first < page_id THEN first END AS refers_to FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
