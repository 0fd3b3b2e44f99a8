"""python -m docloom PATH [QUERY]: a query over a file or a directory, or a summary of the file or the tree of the directory."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

from docloom import render
from docloom.lang.syntax import Literal, QueryError, Selector, parse
from docloom.operators import structure
from docloom.plans.compiler import compile as compiled
from docloom.plans.compiler import query_one
from docloom.sources.reader import read_documents

#: What .tree of a directory shows by its argument.
DIRECTORY_MODES = {"": "", "compact": "", "expand": "preview", "preview": "preview", "full": "full"}


def argument(text: str, name: str) -> str | None:
    """The argument of a query that is that one selector, "" for none; else null."""
    node = parse(text)
    if not isinstance(node, Selector) or node.name != name:
        return None
    return str(node.args[0].value) if node.args and isinstance(node.args[0], Literal) else ""


def answer(spark: SparkSession, path: str, text: str = "") -> str:
    """What the command prints."""
    folder = os.path.isdir(path)
    corpus = read_documents(spark, path, glob="*.[mM][dD]" if folder else None)
    if folder:
        mode = argument(text, "tree") if text else ""
        if mode is not None:
            if mode not in DIRECTORY_MODES:
                raise QueryError(f"a directory has no tree of mode {mode!r}; it has {', '.join(filter(None, DIRECTORY_MODES))}")
            root = "file:" + os.path.abspath(path)
            return render.files(structure.files(corpus, DIRECTORY_MODES[mode]).collect(), root)
        relation = compiled(corpus, text)
        return render.result(relation.kind, relation.rows(order=True).collect(), argument(text, "search") or text)
    if not text:
        return "\n\n".join(render.document_info(r) for r in structure.details(corpus).collect())
    rows: DataFrame = query_one(corpus, text)
    return render.result(compiled(corpus, text).kind, rows.collect(), argument(text, "search") or text)


def main(args: list[str]) -> int:
    if not args or args[0] in ("-h", "--help"):
        print(__doc__)
        return 0 if args else 2
    print(answer(SparkSession.builder.appName("docloom").getOrCreate(), *args[:2]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
