"""Token counts: rollups that are maintained from deltas.

A change row says that the count of a document under one tokenizer version
was inserted, deleted or revised; it carries the old and the new count, so a
batch reduces to signed sums by (source, lang, tokenizer) without looking at
any earlier row.  A commit writes the reduced batch into a folder of its own
and then claims the batch id by creating a small file, commits/<id>, that
names the folder.  That file is created by one writer only, so a batch that is
retried, replayed or committed by two jobs at once counts once, and nothing
that was committed is ever written over.  Totals are the sum of all deltas, a
few rows per batch; compact() folds them into one.

The counts may come from any tokenizer: from `bpe_counts` for vocabularies of
the encoder, or from the expressions below.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.bpe import Codec
from docloom.llm.common import bounded_batches, tidy
from docloom.llm.textvec import text_parts

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])
CHANGES = ["op", "source", "lang", "tokenizer", "old_tokens", "new_tokens"]


def signed(changes: DataFrame) -> DataFrame:
    """Signed totals of one batch.

    op is insert (+new), delete (-old) or revise (+new -old, no change of
    documents); any other or null op adds nothing.  A null count is 0; null
    keys form a group of their own; repeated rows count each time; an empty
    table has no totals; columns other than those named in CHANGES are not
    looked at.
    """
    op = F.lower(F.col("op"))
    old, new = F.coalesce("old_tokens", F.lit(0)).cast("long"), F.coalesce("new_tokens", F.lit(0)).cast("long")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0).cast("long")
    tokens = F.when(op == "insert", new).when(op == "delete", -old).when(op == "revise", new - old).otherwise(F.lit(0).cast("long"))
    return changes.select(*CHANGES).groupBy(*KEYS).agg(F.sum(docs).alias("n_docs"), F.sum(tokens).alias("n_tokens"))


class Rollup:
    """The rollup kept in one folder that all executors share.

    Batches may be empty and their rows repeat or hold nulls, see `signed`; the
    totals of a folder without batches are empty.  Of several writers of one
    batch id the first to claim it counts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _text(self, name: str) -> str:
        """What a small file holds; nothing if it isn't there."""
        fs, p = self._fs(name)
        if not fs.exists(p):
            return ""
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _claim(self, name: str, text: str) -> bool:
        """Creates a small file; false if it is there already. One that is empty was left by a writer that died, and is replaced."""
        fs, p = self._fs(name)
        try:
            stream = fs.create(p, fs.exists(p) and not self._text(name))
        except Py4JJavaError:
            if self._text(name):
                return False
            raise
        stream.writeBytes(text)
        stream.close()
        return True

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _write(self, rows: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.folder}/{name}")
        return name

    def _drop(self, name: str) -> None:
        fs, p = self._fs(name)
        fs.delete(p, True)

    def committed(self, batch: str) -> bool:
        return bool(self._text(f"commits/{batch}"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch; False if it was there already."""
        if not batch or batch.startswith((".", "_")) or any(c in batch for c in "/=\\:"):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.committed(batch):
            return False
        name = self._write(signed(changes))
        if self._claim(f"commits/{batch}", name):
            return True
        self._drop(name)
        return False

    def batches(self) -> list[str]:
        return [b for b in self._names("commits") if not b.startswith(".") and self.committed(b)]

    def _base(self) -> tuple[int, str, dict[str, str]]:
        """Number, folder and batches (with their folders) of the last compaction."""
        numbers = [int(n) for n in self._names("bases") if n.isdigit() and self._text(f"bases/{n}")]
        if not numbers:
            return 0, "", {}
        found = json.loads(self._text(f"bases/{max(numbers)}"))
        return max(numbers), found["data"], found["batches"]

    def _rows(self) -> tuple[DataFrame | None, int, dict[str, str], dict[str, str]]:
        """All that counts now; and the last compaction's number and batches, and all batches."""
        number, base, folded = self._base()
        every = {b: self._text(f"commits/{b}") for b in self.batches()}
        paths = [f"{self.folder}/{x}" for x in [base, *(v for b, v in every.items() if b not in folded)] if x]
        return (self.spark.read.schema(SCHEMA).parquet(*paths) if paths else None), number, folded, every

    def totals(self) -> DataFrame:
        """Current totals; keys whose documents and tokens are both 0 again are left out. Without batches there are none."""
        rows = self._rows()[0]
        return self.spark.createDataFrame([], SCHEMA) if rows is None else _summed(rows)

    def compact(self) -> bool:
        """Folds all batches into one table; False if there was nothing to fold or another compaction came first.

        Batch ids stay known.  The deltas that the compaction before this one
        folded are deleted; those of this one stay until the next, for
        readers that have begun.
        """
        rows, number, folded, every = self._rows()
        if rows is None or every.keys() == folded.keys():
            return False
        name = self._write(_summed(rows))
        if not self._claim(f"bases/{number + 1}", json.dumps({"data": name, "batches": every})):
            self._drop(name)
            return False
        for old in folded.values():
            self._drop(old)
        return True


def _summed(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return out.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def bpe_counts(docs: DataFrame, vocabularies: dict[str, str]) -> DataFrame:
    """(doc_id, source, lang, a column for each tokenizer version): tokens of each row under the vocabulary in the file named.

    A null or empty text has none; rows that repeat are counted each, and null
    ids and keys stay null.
    """
    bounded_batches(docs.sparkSession)
    files = {}
    for version, path in vocabularies.items():
        with open(path, "rb") as f:
            files[version] = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(files)
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), *((v, pa.int64()) for v in vocabularies)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = [Codec(data) for data in shared.value.values()]
        for batch in batches:
            for part, texts in text_parts(batch, 3):
                some = [t or "" for t in texts]
                counts = [pa.array(c.encode_block(some)[1]) for c in codecs]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(part.start, len(some)) for k in range(3)] + counts, schema=schema)

    kind = ", ".join(["doc_id long, source string, lang string", *(f"`{v}` long" for v in vocabularies)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(tidy(run), kind)


def space_tokens(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\r\\f]+")).cast("long")


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[\\p{L}\\p{N}]+")).cast("long")


def piece_tokens(text: Column) -> Column:
    """Runs of letters and digits, and each other mark by itself."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[\\p{L}\\p{N}]+|[^ \\t\\n\\r\\f\\p{L}\\p{N}]")).cast("long")


def change(op: str, tokenizer: str, docs: DataFrame, old: Column | None = None, new: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    return docs.select(F.lit(op).alias("op"), F.col("source"), F.col("lang"), F.lit(tokenizer).alias("tokenizer"), (none if old is None else old).alias("old_tokens"), (none if new is None else new).alias("new_tokens"))
