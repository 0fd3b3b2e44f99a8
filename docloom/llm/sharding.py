"""Sharding: a hierarchical weighted hash tree.

Each document descends region, rack and shard.  At a node every child draws
u in (0, 1) from the MD5 of (key, child path) and the child with the least
-ln(u) / weight wins, so a child is chosen in proportion to its weight.  A
draw depends on the key and the child alone: changing a weight moves keys
only into or out of that child, and nothing below the other children moves.

All levels are plain column expressions: no shuffle, no Python, and only the
key column is read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; an inner node weighs what its children weigh unless weight is given."""

    name: str
    weight: float | None = None
    children: tuple[Node, ...] = field(default=())

    def total(self) -> float:
        if self.weight is not None:
            return float(self.weight)
        return sum(c.total() for c in self.children) if self.children else 1.0


def tree(spec: dict) -> tuple[Node, ...]:
    """{"r1": {"k1": {"s1": 2.0, ...}, ...}, ...} as nodes."""
    return tuple(Node(k, None, tree(v)) if isinstance(v, dict) else Node(k, float(v)) for k, v in spec.items())


#: Three regions of unlike size; 24 shards.
PRODUCTION_TREE = {
    "eu": {"r1": {"s1": 2.0, "s2": 1.0, "s3": 1.0}, "r2": {"s1": 1.0, "s2": 1.0, "s3": 1.0}, "r3": {"s1": 1.0, "s2": 3.0}},
    "us": {"r1": {"s1": 2.0, "s2": 2.0, "s3": 2.0}, "r2": {"s1": 1.0, "s2": 1.0}, "r3": {"s1": 4.0, "s2": 1.0, "s3": 1.0}, "r4": {"s1": 1.5, "s2": 0.5}},
    "ap": {"r1": {"s1": 1.0, "s2": 1.0, "s3": 0.5}, "r2": {"s1": 2.5, "s2": 1.0}},
}

_SPAN = float(1 << 52)


def draw(key: Column, path: str) -> Column:
    """A number in (0, 1) that depends on key and path alone."""
    digits = F.substring(F.md5(F.concat(key, F.lit("|" + path)).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(_SPAN)


def _pick(key: Column, children: tuple[Node, ...], prefix: str) -> Column:
    """Name of the winning child; on a tie, the one listed first."""
    live = [c for c in children if c.total() > 0]
    if not live:
        raise ValueError(f"no child of {prefix or 'the root'} has a weight above 0")
    if len(live) == 1:
        return F.lit(live[0].name)
    scored = [F.struct((-F.ln(draw(key, prefix + c.name)) / F.lit(c.total())).alias("s"), F.lit(i).alias("i"), F.lit(c.name).alias("name")) for i, c in enumerate(live)]
    return F.array_min(F.array(*scored))["name"]


def _descend(key: Column, nodes: tuple[Node, ...], chosen: list[Column], prefix: str, depth: int) -> Column:
    """The pick at `depth`, given the columns chosen above it."""
    if depth == 0:
        return _pick(key, nodes, prefix)
    out = None
    for n in nodes:
        below = _descend(key, n.children, chosen[1:], f"{prefix}{n.name}/", depth - 1)
        out = F.when(chosen[0] == n.name, below) if out is None else out.when(chosen[0] == n.name, below)
    return out


def assign(docs: DataFrame, spec: dict = PRODUCTION_TREE, key: str = "doc_id") -> DataFrame:
    """(doc_id, region, rack, shard) of every row of docs.

    A null key draws as the empty string, so all such rows share one shard.
    Repeated keys get the same shard; of children that draw the same the first
    in the tree is taken.  Columns of docs other than the key are
    not looked at, whatever their names; an empty table gives an empty table.
    """
    nodes = tree(spec)
    out = docs.select(F.col(key).alias("doc_id"))
    k = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    out = out.withColumn("region", _descend(k, nodes, [], "", 0))
    out = out.withColumn("rack", _descend(k, nodes, [F.col("region")], "", 1))
    return out.withColumn("shard", _descend(k, nodes, [F.col("region"), F.col("rack")], "", 2))


def assign_sql(spec: dict = PRODUCTION_TREE, table: str = "documents") -> str:
    """The same assignment for DuckDB."""

    def pick(children: tuple[Node, ...], prefix: str) -> str:
        live = [c for c in children if c.total() > 0]
        if len(live) == 1:
            return f"'{live[0].name}'"
        items = ", ".join(f"{{'s': -ln((('0x' || substr(md5(k || '|{prefix}{c.name}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {_SPAN!r}) / {c.total()!r}, 'i': {i}, 'name': '{c.name}'}}" for i, c in enumerate(live))
        return f"list_min([{items}])['name']"

    nodes = tree(spec)
    racks = " ".join(f"WHEN region = '{r.name}' THEN {pick(r.children, r.name + '/')}" for r in nodes)
    shards = " ".join(f"WHEN region = '{r.name}' AND rack = '{k.name}' THEN {pick(k.children, f'{r.name}/{k.name}/')}" for r in nodes for k in r.children)
    return f"""
WITH keyed AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM {table}),
 one AS (SELECT *, {pick(nodes, "")} AS region FROM keyed),
 two AS (SELECT *, CASE {racks} END AS rack FROM one)
SELECT doc_id, region, rack, CASE {shards} END AS shard FROM two"""


def moved(docs: DataFrame, before: dict, after: dict, key: str = "doc_id") -> DataFrame:
    """Rows whose shard differs between two trees: (doc_id, from_path, to_path).

    As to null and repeated keys, ties, empty tables and other columns it is
    as `assign`; each repeated row that moves is in the result.
    """
    path = F.concat_ws("/", "region", "rack", "shard")
    a, b = tree(before), tree(after)
    out = docs.select(F.col(key).alias("doc_id"))
    k = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    for name, nodes in (("from_path", a), ("to_path", b)):
        out = out.withColumn("region", _descend(k, nodes, [], "", 0))
        out = out.withColumn("rack", _descend(k, nodes, [F.col("region")], "", 1))
        out = out.withColumn("shard", _descend(k, nodes, [F.col("region"), F.col("rack")], "", 2))
        out = out.withColumn(name, path).drop("region", "rack", "shard")
    return out.filter(~F.col("from_path").eqNullSafe(F.col("to_path")))
