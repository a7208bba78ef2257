"""BPE encoding and decoding through a table of distinct words.

Documents are split into words as the tokenizer's pre-tokenizer does; each block of documents keeps
its own word list, and a document becomes positions in its block's list. The lists are dealt out by
a hash of the word, so that all rows of a word meet: there each distinct word is encoded once, and
its ids go back to every block and position that asked. A document's ids are put together by
position. Decoding joins ids to pieces: the distinct ids of a block, as rows, meet the tokenizer's table
of pieces (whose size is a constant of the tokenizer, so it is broadcast), and the block's documents are put
together from the pieces that came back, a row a block, at most as many as there are ids.

Blocks hold at most BLOCK_WORDS distinct words and BLOCK_POSITIONS words, or one document. The
distinct words grow with the corpus and are never broadcast; a frequent word is one entry a block,
not one an occurrence. Lists and positions travel packed (byte planes, zstandard), a row for many
words, since rows of single words would take several times the size of the texts.

For word-level BPE whose pieces never cross words (Split pre-tokenizer, no decoder), as in
word_bpe_49k.json. Defined results: null and empty texts have no ids and decode to an empty text;
every row gives one row, repeated rows and null ids included; other columns are carried in `row`,
whatever their names; an empty table gives an empty result. Special strings inside a text are
special ids, as the library's default has it.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.common import Scratch, load, release, tune, whole

BLOCK_WORDS, BLOCK_POSITIONS = 1 << 18, 1 << 21
#: Characters of whose class and case all Unicode versions agree, and which NFC leaves alone.
UNSAFE = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ‐-‧€]")
#: The pre-tokenizer's words, for such characters.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\s\w]|_)+")
NAMES = ["block", "rows", "at", "bucket", "words", "kind"]
_TOKENIZERS: dict[str, tuple] = {}


def tokenizer(path: str):
    """The tokenizer and a pattern of its special strings."""
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        specials = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        _TOKENIZERS[path] = tok, re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
    return _TOKENIZERS[path]


def split_words(text: str, path: str) -> list[str]:
    """The words of a text, normalised; special strings are words of their own."""
    tok, specials = tokenizer(path)
    out: list[str] = []
    for k, part in enumerate(specials.split(text) if specials else [text]):
        if k % 2:
            out.append(part)
        elif not UNSAFE.search(part):
            out += WORD.findall(part.lower())
        elif part:
            normal = tok.normalizer.normalize_str(part)
            out += [normal[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(normal)]
    return out


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values as compressed byte planes."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _split(path: str, buckets: int):
    """Rows of documents (`rows`: some documents of a block, `words`: how many words each has, `at`:
    their positions in the block's list) and, at the end of a block, rows of its list: per bucket
    the words, joined by a byte that UTF-8 never has, and the steps between their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, turn, known, held = TaskContext.get().partitionId() << 32, 0, {}, 0

        def listed(row_type: pa.DataType) -> pa.RecordBatch:
            dealt: dict[int, list[tuple[bytes, int]]] = {}
            for word, pos in known.items():
                raw = word.encode()
                dealt.setdefault(zlib.crc32(raw) % buckets, []).append((raw, pos))
            squeeze = zstandard.ZstdCompressor(level=3).compress
            words = [squeeze(b"\xff".join(w for w, _ in x)) for x in dealt.values()]
            at = [pack(np.diff([p for _, p in x], prepend=0)) for x in dealt.values()]
            n = len(dealt)
            return pa.RecordBatch.from_arrays([pa.array([part + turn] * n, pa.int64()), pa.nulls(n, pa.list_(row_type)), pa.array(at, pa.binary()), pa.array(list(dealt), pa.int32()), pa.array(words, pa.binary()), pa.array([1] * n, pa.int32())], names=NAMES)

        def stored(rows: pa.Array, positions: list[np.ndarray]) -> pa.RecordBatch:
            counts, at = pack(np.array([len(x) for x in positions])), pack(np.concatenate(positions))
            many = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([pa.array([part + turn]), many, pa.array([at], pa.binary()), pa.nulls(1, pa.int32()), pa.array([counts], pa.binary()), pa.array([0], pa.int32())], names=NAMES)

        row_type = pa.null()
        for batch in batches:
            rows, first, positions = batch.column("row"), 0, []
            row_type = rows.type
            for k, text in enumerate(batch.column("text").to_pylist()):
                words = split_words(text, path)
                fresh = set(words).difference(known)
                if held and (len(known) + len(fresh) > BLOCK_WORDS or held + len(words) > BLOCK_POSITIONS):
                    if positions:
                        yield stored(rows.slice(first, k - first), positions)
                    yield listed(row_type)
                    turn, known, held, first, positions = turn + 1, {}, 0, k, []
                    fresh = set(words)
                held += len(words)
                for word in dict.fromkeys(w for w in words if w in fresh):
                    known[word] = len(known)
                positions.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
            if positions:
                yield stored(rows.slice(first), positions)
        if known:
            yield listed(row_type)

    return run


def _encode(path: str):
    """All lists of some buckets: each distinct word is encoded once; its ids go back, packed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, _ = tokenizer(path)
        now, table = None, {}
        for batch in batches:
            for block, bucket, words, at in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "words", "at")), strict=True):
                if bucket != now:  # rows are sorted: a bucket's words are forgotten once it is done
                    now, table = bucket, {}
                listed = [w.decode() for w in zstandard.ZstdDecompressor().decompress(words).split(b"\xff")]
                fresh = [w for w in dict.fromkeys(listed) if w not in table]
                table |= {w: x.ids for w, x in zip(fresh, tok.encode_batch(fresh, add_special_tokens=False), strict=True)}
                ids = [table[w] for w in listed]
                flat = np.fromiter((i for x in ids for i in x), np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([at], pa.binary()), pa.array([pack(np.array([len(x) for x in ids]))], pa.binary()), pa.array([pack(flat)], pa.binary())], names=["owner", "pos", "counts", "ids"])

    return run


def _used(words: pa.Table) -> pa.Table:
    """The distinct ids of a block."""
    ids = np.unique(np.concatenate([unpack(x) for x in words.column("ids").to_pylist()]))
    return pa.table({"owner": pa.array([words.column("owner")[0].as_py()] * len(ids), pa.int64()), "id": pa.array(ids, pa.int64())})


def _assemble():
    def kernel(docs: pa.Table, words: pa.Table) -> pa.Table:
        """Documents of a block with the ids of its words, and the pieces of these."""
        name, found = {}, {}
        for pos, counts, ids, pieces in zip(*(words.column(c).to_pylist() for c in ("pos", "counts", "ids", "pieces")), strict=True):
            if pieces is not None:
                name = {p["id"]: p["piece"] for p in pieces}
                continue
            ends = np.cumsum(unpack(counts))
            for p, part in zip(np.cumsum(unpack(pos)).tolist(), np.split(unpack(ids), ends[:-1]), strict=True):
                found[p] = part.tobytes()
        of = [found[p] for p in range(len(found))]
        out_ids, out_text = [], []
        for raw, sizes in zip(docs.column("at").to_pylist(), docs.column("words").to_pylist(), strict=True):
            for at in np.split(unpack(raw), np.cumsum(unpack(sizes))[:-1]):
                joined = b"".join([of[k] for k in at.tolist()])
                out_ids.append(joined)
                out_text.append(" ".join([name[i] for i in np.frombuffer(joined, "<u4").tolist()]))
        counts = pa.array([len(x) // 4 for x in out_ids], pa.int64())
        return pa.table({"row": docs.column("rows").combine_chunks().flatten(), "n_tokens": counts, "ids": pa.array(out_ids, pa.binary()), "decoded": pa.array(out_text, pa.string())})

    return kernel


def id_pieces(path: str) -> list[str]:
    """The piece of each id of the whole vocabulary, its special strings included."""
    with open(path) as f:
        spec = json.load(f)
    if spec.get("decoder") is not None:
        raise ValueError("pieces are joined by spaces only where the file has no decoder")
    rows = {i: w for w, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [rows.get(i, "") for i in range(max(rows) + 1)]


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: `row` (a struct of the columns in carry, all by default), n_tokens,
    ids (little-endian unsigned 32-bit) and decoded."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "bpe")
    base = docs.select(F.struct(*[docs[c] for c in carry or docs.columns]).alias("row"), whole(text_col).alias("text"))
    kind = base.schema["row"].dataType
    full = T.StructType([T.StructField(n, t) for n, t in (("block", T.LongType()), ("rows", T.ArrayType(kind)), ("at", T.BinaryType()), ("bucket", T.IntegerType()), ("words", T.BinaryType()), ("kind", T.IntegerType()))])
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Bucketed by block: the documents are later read in place, and only the ids are shuffled to them.
    table = "inkveil_bpe_" + uuid.uuid4().hex
    split = base.mapInArrow(_split(path, 4 * parts), full).write.option("compression", "zstd").option("path", scratch.path("split"))
    split.partitionBy("kind").bucketBy(parts, "block").saveAsTable(table)
    release(spark)
    lists = spark.table(table).where("kind = 1").select("block", "at", "bucket", "words").repartition(parts, "bucket").sortWithinPartitions("bucket")
    back = scratch.save(lists.mapInArrow(_encode(path), "owner long, pos binary, counts binary, ids binary"), "back")
    scratch.drop("split/kind=1")
    out = T.StructType([T.StructField("row", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    pieces = spark.createDataFrame(list(enumerate(id_pieces(path))), "id long, piece string")
    used = back.select("owner", "ids").groupBy("owner").applyInArrow(_used, "owner long, id long").join(F.broadcast(pieces), "id")  # as many as the tokenizer has ids
    named = used.groupBy("owner").agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))
    none = F.lit(None).cast("binary")
    found = back.withColumn("pieces", F.lit(None).cast(named.schema["pieces"].dataType)).unionByName(named.select("owner", none.alias("pos"), none.alias("counts"), none.alias("ids"), "pieces"))
    stored = spark.table(table).where("kind = 0").select("block", "rows", "at", "words")
    return stored.groupBy("block").cogroup(found.groupBy("owner")).applyInArrow(_assemble(), out)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
    return out.select("row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
