"""Readers: files or columns of text become a corpus of parsed documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.plans.corpus import Corpus
from docloom.sources import data, formats, html, markdown, pdf
from docloom.sources.structure import ELEMENTS, SCALARS, Structure

Parser = Callable[..., Structure]


class Registry:
    """Parsers by format; each takes text, that of PDF takes bytes, and the options of the reader that it knows."""

    def __init__(self):
        self._parsers: dict[str, tuple[Parser, frozenset[str]]] = {}
        self._extensions: dict[str, list[Callable[[Structure, str | bytes], None]]] = {}
        self.register("markdown", markdown.parse)
        self.register("html", html.parse, "readability", "base_url", "max_depth", "open_references")
        self.register("json", data.parse_json, "want", "readable")
        self.register("jsonl", data.parse_jsonl, "max_lines", "want", "readable")
        self.register("yaml", data.parse_yaml, "want", "readable")
        self.register("pdf", pdf.parse, "infer", "detect_tables", "min_ratio")

    def register(self, name: str, parser: Parser, *options: str) -> None:
        self._parsers[name] = parser, frozenset(options)

    def extend(self, name: str, *extensions: Callable[[Structure, str | bytes], None]) -> None:
        """Adds to what the parser of a format finds: each extension gets the structure and the content and may change the former."""
        if name not in self._parsers:
            raise ValueError(f"no parser for {name}")
        self._extensions[name] = [*self._extensions.get(name, []), *extensions]

    def has(self, name: str) -> bool:
        return name in self._parsers

    def parse(self, name: str, content: bytes, **options) -> Structure:
        parser, known = self._parsers[name]
        if self._extensions.get(name):  # they get all that is found
            options = {k: v for k, v in options.items() if k not in ("want", "readable")}
        text = content if name == "pdf" else content.decode("utf-8", "replace")
        out = parser(text, **{k: v for k, v in options.items() if k in known})
        for extension in self._extensions.get(name, []):
            extension(out, text)
        return out


def schema(want: list[str], keep: list[T.StructField]) -> T.StructType:
    fields = [*keep, T.StructField("format", T.StringType())]
    fields += [T.StructField(k, v) for k, v in SCALARS.items()]
    return T.StructType(fields + [T.StructField(k, T.ArrayType(ELEMENTS[k])) for k in want])


def _lists(values: list[list[dict]], kind: pa.ListType) -> pa.Array:
    """An array of lists of structs, made column by column, once for a list that comes up again; a key that a struct lacks is null."""
    index: dict[int, int] = {}
    which = [index.setdefault(id(v), len(index)) for v in values]
    if 2 * len(index) < len(values):
        by_id = {id(v): v for v in values}
        return _lists([by_id[k] for k in index], kind).take(pa.array(which))
    flat = list(chain.from_iterable(values))
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values], dtype=np.int64))).astype(np.int32)
    fields = list(kind.value_type)
    columns = [pa.array([x.get(f.name) for x in flat], f.type) for f in fields]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=fields), type=kind)


def parse_documents(df: DataFrame, content: str = "content", path: str = "path", format: str | None = None, default: str = "markdown", want: list[str] | None = None, strict: bool = False, registry: Registry | None = None, readable: bool = True, **options) -> Corpus:
    """Parses a column of texts or bytes, which is called source from then on; the other columns of df stay.

    Columns whose names the corpus needs for itself (format, source, title,
    headings and so on, in any case) are kept together in a struct, `input`.
    format forces one for all rows; else it is told from path and content, and
    is `default` where no parser is registered for it.  want names the element
    tables that will be asked for, so that no others leave the parser; without
    readable, neither does readable_text, which then is null.  A
    document that can't be parsed is empty and has its parse_error set, or
    fails the job if strict.  A null content is an empty document.
    """
    if default not in ("markdown",) and not (registry or Registry()).has(default):
        raise ValueError(f"no parser for {default}")
    registry, want = registry or Registry(), list(want or ELEMENTS)
    unknown = set(want) - set(ELEMENTS)
    if unknown:
        raise ValueError(f"no such elements: {sorted(unknown)}")
    taken = {"format", "source", *SCALARS, *ELEMENTS} - {path}
    others = [c for c in df.columns if c != content]
    clash = [c for c in others if c.lower() in taken]
    clash += [c for c in others if clash and c.lower() == "input"]
    kept = [f"`{c}`" for c in others if c not in clash] + ([] if path in df.columns else [F.lit("").alias(path)])
    df = df.select(*kept, *([F.struct(*(f"`{c}`" for c in clash)).alias("input")] if clash else []), F.col(f"`{content}`").alias("source"))
    out = schema(want, df.schema.fields)
    added = to_arrow_schema(T.StructType(out.fields[len(df.columns) :]))
    at_path = df.columns.index(path)
    options |= {"want": frozenset(want), "readable": readable}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in added]
            for p, c in zip(batch.column(at_path).to_pylist(), batch.column(batch.num_columns - 1)):
                c = c.as_py()
                raw = b"" if c is None else c.encode() if isinstance(c, str) else bytes(c)
                kind = format or formats.detect(p or "", raw)
                kind = kind if registry.has(kind) else default
                try:
                    s = registry.parse(kind, raw, **options).finish()
                except Exception as e:  # any parser, also one plugged in
                    if strict:
                        raise ValueError(f"{p}: not {kind}: {e}") from e
                    s = Structure(parse_error=f"{type(e).__name__}: {e}"[:500])
                if not readable:
                    s.readable_text = None
                for column, value in zip(made, [kind, *(getattr(s, k) for k in SCALARS), *(getattr(s, k) for k in want)]):
                    column.append(value)
            columns = [_lists(v, f.type) if pa.types.is_list(f.type) else pa.array(v, f.type) for v, f in zip(made, added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added.names])

    return Corpus(df.mapInArrow(run, out).withColumn("source", F.col("source").cast("string")), want)


def read_documents(spark: SparkSession, path: str, glob: str | None = None, hidden: bool = False, **kwargs) -> Corpus:
    """Every file under a path, or one file, as a corpus; doc_id is the file's path.

    Hidden files, and all in hidden directories, are left out unless asked for.  One task reads whole files, so
    the unit of work is a file and any number of them is read in parallel.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return parse_files(reader.load(path), hidden, path, **kwargs)


def parse_files(files: DataFrame, hidden: bool = False, root: str = "", **kwargs) -> Corpus:
    """The corpus of a table of files (path, content), batch or streaming; whether one is hidden is told from its path below root."""
    files = files.select("path", "content")
    if not hidden:
        below = F.substring_index("path", root.rstrip("/"), -1) if root.strip("/") else F.col("path")
        files = files.filter(~below.rlike(r"/\.[^/]"))
    return parse_documents(files.withColumn("doc_id", F.col("path")), **kwargs)
