"""The ledger of token numbers: ranges that were ever reserved, for each letter; none is given twice.

A folder of numbered entries, each a line of JSON a letter: where its next short and wide numbers start. An
entry is written under a temporary name and renamed to the next number, which fails if another writer has taken it; then
the writer reads again and reserves anew. Entries are never changed or deleted, so numbers of deleted tokens are
not used again: a text redacted with one never gets another value.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: For a letter: the first short rank and the first wide number that were never reserved.
Cursors = dict[str, tuple[int, int]]


class TokenLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def entries(self) -> list[int]:
        """The numbers of all entries, in order."""
        folder = self._hadoop.Path(self.path)
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0].isdigit())

    def cursors(self, entry: int | None) -> Cursors:
        """Cursors after an entry, which holds those of all letters met so far."""
        if entry is None:
            return {}
        rows = self.spark.read.schema("letter string, short long, wide long").json(f"{self.path}/{entry:012d}.json").collect()  # a row a letter
        return {r.letter: (r.short, r.wide) for r in rows}

    def _append(self, entry: int, cursors: Cursors) -> bool:
        """Whether the entry could be written: no other writer has its number."""
        held = self._hadoop.Path(f"{self.path}/_{uuid.uuid4().hex}")
        out = self._fs.create(held, False)
        try:
            lines = "".join(json.dumps({"letter": k, "short": s, "wide": w}) + "\n" for k, (s, w) in sorted(cursors.items()))
            out.write(bytearray(lines.encode()))
        finally:
            out.close()
        options = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0)
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(held, self._hadoop.Path(f"{self.path}/{entry:012d}.json"), options)
            return True
        except Py4JJavaError as e:
            if "already exists" not in str(e):
                raise
            self._fs.delete(held, False)
            return False

    def reserve(self, advance: Callable[[Cursors], Cursors]) -> Cursors:
        """Reserve what lies between the cursors and advance(cursors); gives the cursors that it started from."""
        while True:
            last = (self.entries() or [None])[-1]
            now = self.cursors(last)
            if self._append((last or 0) + 1, now | advance(now)):
                return now
