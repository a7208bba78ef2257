"""Parts of confirmed firm names: found on all pages of the document, and places or persons that are such parts retyped."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import QUOTES, strip_accents_py
from inkveil.operators.detect import _NAMES
from inkveil.operators.document import value_key
from inkveil.operators.value_index import occurrences

FACTOR = 0.85
# Words that never make a part by themselves, and legal forms that never stand alone.
FUNCTION_WORDS = frozenset(strip_accents_py(w) for w in "the a an of and or for in on at to by with from as is are was were le la les de du des et ou en au aux un une sur dans pour par avec der die das den dem und oder für fuer mit von zu auf ein eine am im bei aus nach über ueber el los las del y o para con por al uno il lo gli della dello dei degli delle e di da alla alle ai nel nella sul sulla dal dalla het een van voor met op te uit os do dos das com em no na nos nas ao aos um uma".split())
LEGAL_ALONE = frozenset("inc corp ltd llc lp gmbh ag sa nv bv plc spa srl oy ab aps as".split())
_SPACES = str.maketrans(QUOTES, " " * len(QUOTES))


def _number(word: str) -> bool:
    return word.translate(str.maketrans("", "", ",.-")).isdigit()


def groups_of(words: list[str]) -> list[list[str]]:
    """Words that stay together: a number belongs to the word before it, a leading one to the word after it."""
    out: list[list[str]] = []
    for w in words:
        if out and _number(w):
            out[-1].append(w)
        else:
            out.append([w])
    if len(out) > 1 and all(map(_number, out[0])):
        out[:2] = [out[0] + out[1]]
    return out


def parts_of(name: str, common: frozenset[str] = frozenset()) -> list[str]:
    """Normalised parts of a firm name of three words or more: runs of two words or more, and single
    words of four letters or more that are capitalised and neither common nor a legal form."""
    plain = " ".join(strip_accents_py(name).translate(_SPACES).split())
    words = plain.split()
    if len(words) < 3:
        return []
    groups, found = groups_of(words), []
    for n in range(1, len(groups)):
        for i in range(len(groups) - n + 1):
            run = [w.lower() for g in groups[i : i + n] for w in g]
            if len(run) >= 2 and not FUNCTION_WORDS.issuperset(run):
                found.append(" ".join(run))
    for w in words:
        low = w.lower()
        if len(w) >= 4 and w[0].isupper() and not w.isdigit() and low not in FUNCTION_WORDS | LEGAL_ALONE | common:
            found.append(low)
    return list(dict.fromkeys(found))


def _rows(common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, key, conf, round(conf * FACTOR, 4), source) for doc, text, conf, source in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "confidence", "source")), strict=True) for key in parts_of(text, common)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()), strict=True)], names=["doc_id", "key", "confidence", "less", "source"])

    return run


def propagate_parts(regions: DataFrame, pages: DataFrame, common: frozenset[str] = frozenset()) -> DataFrame:
    """Regions with places and persons that are parts of firms retyped, and further occurrences of the parts.

    common: words of a dictionary that single words must not be (empty by default)."""
    firms = regions.where("pii_type = 'ORG'").select("doc_id", "text", "confidence", "source")
    parts = firms.mapInArrow(_rows(common), "doc_id string, key string, confidence double, less double, source string")
    best = parts.groupBy("doc_id", "key").agg(F.max(F.struct("confidence", "less", "source")).alias("b")).select("doc_id", "key", "b.*")
    keyed = regions.withColumn("key", value_key(F.trim("text")))
    fresh = best.join(keyed.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti")
    whole = keyed.where("pii_type = 'ORG'").groupBy("doc_id", "key").agg(F.max("confidence").alias("c"))
    known = best.select("doc_id", "key", F.col("confidence").alias("c")).union(whole).groupBy("doc_id", "key").agg(F.max("c").alias("c"))
    joined = keyed.join(known, ["doc_id", "key"], "left")
    other = F.col("pii_type").isin("LOCATION", "PERSON") & F.col("c").isNotNull()
    retyped = joined.withColumn("confidence", F.when(other, F.greatest("confidence", F.round(F.col("c") * FACTOR, 4))).otherwise(F.col("confidence"))).withColumn("pii_type", F.when(other, "ORG").otherwise(F.col("pii_type"))).select(*_NAMES)
    keys = fresh.select("doc_id", "key", F.lit("ORG").alias("pii_type"), F.col("less").alias("confidence"), "source", (-F.length("key")).alias("turn"))
    return retyped.unionByName(occurrences(keys, retyped, pages, 2_000_000))
