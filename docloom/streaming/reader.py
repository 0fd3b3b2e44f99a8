"""Documents as a stream: the same parsers over files that arrive in a directory."""

from __future__ import annotations

from pyspark.sql import SparkSession

from docloom.plans.corpus import Corpus
from docloom.sources.reader import parse_files

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_documents(spark: SparkSession, path: str, glob: str | None = None, files_per_batch: int | None = None, **kwargs) -> Corpus:
    """The corpus of a directory as it grows; selections, filters and searches on it run in append mode."""
    reader = spark.readStream.format("binaryFile").schema(_SCHEMA).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_files(reader.load(path), **kwargs)
