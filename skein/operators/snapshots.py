"""What changed between full snapshots of a table.

Full snapshots are compared with the one before by a Merkle tree over hash ranges of
the record key. A row is reduced to a 128-bit digest; rows are bucketed by the leading
bits of the key's hash; leaf digests are the XOR of the digests of the distinct rows in
the range, inner nodes hash their children. Digests are compared from the root down and
only below nodes that differ, and rows are compared only inside leaves that differ. The
number of leaves follows the size of the largest snapshot of a chain, so a leaf holds
about ``LEAF_ROWS`` rows at any scale and a snapshot that holds a third of all rows is
spread over all tasks.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.common import broadcast_if_small, cut, instant

LEAF_ROWS = 64
MAX_BITS = 30


def chain(meta: DataFrame) -> DataFrame:
    """(chain_id, graph_id, prev_id, commit_sha): snapshots in the order of their instants.

    A commit delivered twice for one (repo, branch) is one snapshot, the delivery with the
    least ``graph_id`` standing for it. Snapshots whose ``generated_at`` is no instant come
    before the others, in the order of the text. Null repo, branch or commit are values
    like any other. ``prev_id`` is null for the first snapshot.
    """
    one = meta.groupBy("repo", "branch", "commit_sha").agg(
        F.min(F.struct("graph_id", "generated_at")).alias("m")
    )
    one = one.select(
        F.xxhash64(F.coalesce("repo", F.lit("\0")), F.coalesce("branch", F.lit("\0"))).alias("chain_id"),
        "repo", "branch", "commit_sha",
        F.col("m.graph_id").alias("graph_id"), F.col("m.generated_at").alias("generated_at"),
    )
    order = Window.partitionBy("repo", "branch").orderBy(instant("generated_at"), "generated_at", "graph_id")
    return one.select("chain_id", "graph_id", F.lag("graph_id").over(order).alias("prev_id"), "commit_sha")


def _normal(field: T.StructField, times: set[str]) -> list[Column]:
    """The parts of a column that enter the digest: null equals '', 0 and the empty array."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.ArrayType):
        bag = F.array_sort(F.transform(F.coalesce(c, F.array().cast(field.dataType)), lambda x: F.coalesce(x.cast("string"), F.lit(""))))
        return [F.size(bag), bag]
    if field.name in times:
        return [F.coalesce(instant(c).cast("string"), c.cast("string"), F.lit(""))]
    if isinstance(field.dataType, (T.StringType, T.NullType)):
        return [F.coalesce(c.cast("string"), F.lit(""))]
    if isinstance(field.dataType, T.NumericType):
        return [F.coalesce(c, F.lit(0).cast(field.dataType))]
    return [F.coalesce(c.cast("string"), F.lit(""))]


def digests(rows: DataFrame, key: str, times: set[str] = frozenset(), ignore: set[str] = frozenset(), kind: str = "row") -> DataFrame:
    """(graph_id, record_kind, record_key, spot, twin, d1, d2): the row digests of every snapshot.

    ``spot`` and ``twin`` are the 128-bit hash of the key; its first bits place the row in the
    tree. A null key equals ''. Arrays are compared as bags, ``times`` as instants (as text
    where they are none).
    """
    parts = [p for f in rows.schema.fields if f.name not in {"graph_id", key, *ignore} for p in _normal(f, set(times))]
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    return rows.select(
        F.col("graph_id"), F.lit(kind).alias("record_kind"), name.alias("record_key"), F.xxhash64(F.lit(kind), name).alias("spot"), F.xxhash64(F.lit(41), F.lit(kind), name).alias("twin"),
        F.xxhash64(F.lit(11), name, *parts).alias("d1"), F.xxhash64(F.lit(97), name, *parts).alias("d2"),
    )


def _xor() -> list[Column]:
    return [F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2")]


def _lift(nodes: DataFrame, *to: str) -> DataFrame:
    """Parents of tree nodes; a parent's digest is made of its children's places and digests."""
    mixed = nodes.withColumns({"d1": F.xxhash64("node", "d1"), "d2": F.xxhash64("node", "d2")})
    return mixed.groupBy(*to).agg(*_xor())


def _differing(nodes: DataFrame, active: DataFrame, on: list[str], node: str) -> DataFrame:
    """(pair, node) of the nodes under ``active`` whose two sides differ or of which one is missing."""
    both = nodes.join(active, on).groupBy("pair", node).agg(*_xor(), F.count("*").alias("n"))
    return both.filter((F.col("n") < 2) | (F.col("d1") != 0) | (F.col("d2") != 0))


def changes(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(graph_id, <key columns>, change_kind) of each snapshot against the one before.

    ``rows`` come from :func:`digests` (columns between graph_id and spot are the key),
    ``snapshots`` from :func:`chain`. Repeated rows in a snapshot count once; a key with
    several different rows is compared as their set. A snapshot without rows is a valid,
    empty snapshot. Rows of unknown snapshots are ignored.

    Only hashes are shuffled, once, by leaf: all versions of a row lie in one partition, where
    repeated rows are dropped, leaf digests made and, of leaves that differ, rows compared.
    The keys' text is read again for the rows that changed.
    """
    spark = rows.sparkSession
    key = [c for c in rows.columns if c not in ("graph_id", "spot", "twin", "d1", "d2")]
    pairs = snapshots.filter("prev_id is not null").select("chain_id", F.col("graph_id").alias("pair"), "prev_id")
    sides = pairs.select("chain_id", "pair", F.col("pair").alias("graph_id"), F.lit(1).alias("side")).union(
        pairs.select("chain_id", "pair", "prev_id", F.lit(2))
    )
    # leaves of a chain: a power of two, by its largest snapshot
    sizes = rows.groupBy("graph_id").count().join(sides.select("graph_id", "chain_id").distinct(), "graph_id")
    most = sizes.withColumn("n", F.max("count").over(Window.partitionBy("chain_id")))
    bits = F.least(F.lit(MAX_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF_ROWS)))).cast("int")
    placed = cut(most.select("graph_id", "chain_id", bits.alias("bits")))
    # a leaf is the first `bits` bits of the key's hash, its parent the first half of them
    leaf = F.expr("case when bits = 0 then 0 else cast(shiftrightunsigned(spot, 64 - bits) as int) end")
    thin = rows.select("graph_id", "spot", "twin", "d1", "d2").join(broadcast_if_small(placed), "graph_id")
    thin = thin.select("chain_id", leaf.alias("node"), "graph_id", "spot", "twin", "d1", "d2")
    thin = thin.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chain_id", "node").distinct().persist(StorageLevel.MEMORY_AND_DISK)

    leaves = thin.groupBy("chain_id", "node", "graph_id").agg(*_xor()).drop("chain_id").join(broadcast_if_small(placed.drop("chain_id")), "graph_id")
    leaves = cut(leaves.withColumn("up", F.expr("shiftrightunsigned(node, bits - bits div 2)")).drop("bits"))
    inner = _lift(leaves, "graph_id", "up")
    root = _lift(inner.withColumnRenamed("up", "node"), "graph_id").withColumn("root", F.lit(0))

    tops = sides.drop("chain_id")
    top = _differing(root, tops, ["graph_id"], "root").select("pair")
    active = tops.join(top, "pair", "left_semi")
    mid = _differing(inner, active, ["graph_id"], "up").select("pair", "up")
    low = _differing(leaves, active.join(mid, "pair"), ["graph_id", "up"], "node").select("pair", "node")
    active = broadcast_if_small(cut(sides.join(low, "pair")))

    seen = thin.join(active, ["chain_id", "node", "graph_id"]).groupBy("chain_id", "node", "pair", "spot", "twin").agg(
        *_xor(), F.max(F.when(F.col("side") == 1, F.col("graph_id"))).alias("now"), F.max(F.when(F.col("side") == 2, F.col("graph_id"))).alias("before")
    )
    kind = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    odd = seen.filter(F.col("now").isNull() | F.col("before").isNull() | (F.col("d1") != 0) | (F.col("d2") != 0))
    odd = cut(odd.select("pair", F.coalesce("now", "before").alias("graph_id"), "spot", "twin", kind.alias("change_kind")))
    thin.unpersist()
    named = rows.select("graph_id", "spot", "twin", *key).join(broadcast_if_small(odd), ["graph_id", "spot", "twin"])
    return named.select(F.col("pair").alias("graph_id"), *key, "change_kind").distinct()


def graph_changes(meta: DataFrame, entities: DataFrame, files: DataFrame) -> DataFrame:
    """Changes of entities and file timestamps: commit_sha, record_kind, record_key, change_kind."""
    order = cut(chain(meta))
    rows = digests(entities, "id", {"last_modified"}, {"ord"}, kind="entity").union(digests(files, "path", {"modified"}, kind="file"))
    out = changes(rows, order).join(broadcast_if_small(order.select("graph_id", "commit_sha")), "graph_id")
    return out.select("commit_sha", "record_kind", "record_key", "change_kind").distinct()
