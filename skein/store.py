"""Graph tables: normalised entities and edges of one or many repositories."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein import schema
from skein.common import cut, outdated, repeated, table, with_places, without


def normalise(df: DataFrame) -> DataFrame:
    """Null text, arrays and numbers become '', [] and 0; null elements become ''."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            out[f.name] = F.coalesce(c, F.lit(""))
        elif isinstance(f.dataType, T.ArrayType):
            out[f.name] = F.transform(F.coalesce(c, F.array().cast(f.dataType)), lambda x: F.coalesce(x, F.lit("")))
        elif isinstance(f.dataType, (T.IntegerType, T.LongType)) and f.name not in ("ord", "ent_id", "rel_id"):
            out[f.name] = F.coalesce(c, F.lit(0).cast(f.dataType))
    return df.withColumns(out)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order; a hash aggregate, so combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    key = F.struct(*[F.col(c) for c in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), key).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


@dataclass
class Graph:
    """Entities and edges. Ids are unique: in tables of many repositories they begin with
    the repository (``repo/kind:name``), so nothing joins across repositories.

    ``raw``: the rows behind them, where filters reach the files.
    """

    entities: DataFrame
    edges: DataFrame
    raw: tuple[DataFrame, DataFrame] | None = None
    spark: SparkSession = field(init=False)

    def __post_init__(self):
        self.spark = self.entities.sparkSession

    @cached_property
    def names(self) -> DataFrame:
        return self.entities.select("id", "name", "kind")

    def nodes(self, *ids: str) -> DataFrame:
        """The entities of some ids."""
        if self.raw is None:
            return self.entities.filter(F.col("id").isin(*ids))
        return _qualified(self.raw[0].filter(_placed("id", ids)), ["id"])

    def links(self, end: str, *ids: str) -> DataFrame:
        """The edges that begin (``end`` 'src') or end ('dst') at some ids."""
        if self.raw is None:
            return self.edges.filter(F.col(end).isin(*ids))
        return _qualified(self.raw[1].filter(_placed(end, ids)), ["id", "src", "dst"])

    def persist(self) -> Graph:
        """Keep entities, and edges clustered by source; both come back from the lineage if lost."""
        self.entities = self.entities.persist()
        self.edges = self.edges.repartition("src").persist()
        return self


def _placed(column: str, ids: tuple[str, ...]) -> F.Column:
    """The filter of qualified ids on the columns they are made of, which files can apply:
    a repository may hold slashes, so an id is tried as cut at each of its own."""
    either = F.lit(False)
    for id_ in ids:
        for at in (i for i, c in enumerate(id_) if c == "/"):
            repo, local = id_[:at], id_[at + 1 :]
            here = (F.col("repo") == repo) if repo else (F.col("repo").isNull() | (F.col("repo") == ""))
            either = either | here & ((F.col(column) == local) if local else (F.col(column).isNull() | (F.col(column) == "")))
    return either


def _qualified(rows: DataFrame, columns: list[str]) -> DataFrame:
    rows = normalise(rows)
    if columns == ["id"]:
        rows = rows.withColumn("local_id", F.col("id"))
    return rows.withColumns({c: F.concat_ws("/", "repo", c) for c in columns})


def standing(rows: DataFrame, key: str, by: str = "loaded_at") -> DataFrame:
    """The rows of a Parquet table that stand, with all columns but ``by``.

    Rows delivered again (same ``key``) count once, the latest by ``by``; of several rows of
    one id in a repository the first by (ord, key) stands. Of equal ones the first by place in
    the files. Null keys, repositories and ids are values like any other; a null id equals ''.

    Only key columns are read to decide, once: the rows that do *not* stand are few, they are
    written to the shared folder as places in the files (hash of the file's path, row number),
    and every later reading leaves them out, with its own filters and columns reaching the files.
    """
    rows = with_places(rows)
    late = outdated(rows, key, by)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    keys = without(rows, late).select("_file", "_row", F.col(key).alias("_key"), text("repo").alias("repo"), text("id").alias("id"), "ord")
    twice = repeated(keys, ["repo", "id"])
    best = twice.groupBy("repo", "id").agg(F.min_by(F.struct("_file", "_row"), F.struct("ord", "_key", "_file", "_row")).alias("w")).select("w._file", "w._row")
    further = twice.join(best, ["_file", "_row"], "left_anti").select("_file", "_row")
    return without(rows, cut(late.unionByName(further))).drop("_file", "_row", by)


def delivered(spark: SparkSession, folder: str) -> Graph:
    """The graph of the delivered tables ``entities`` and ``relationships``, of the rows that
    stand (:func:`standing`). Ends of edges are qualified like the ids."""
    e = standing(table(spark, folder, "entities"), "ent_id")
    r = standing(table(spark, folder, "relationships"), "rel_id")
    return Graph(_qualified(e, ["id"]), _qualified(r, ["id", "src", "dst"]), (e, r))


def merged(entities: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Dedup-merge: the first row's scalars; arrays in ``schema.MERGED`` united in order.

    An element that occurs twice in one array is kept once.
    """
    scalars = [c for c in entities.columns if c not in key + schema.MERGED]
    by = F.struct(*order)
    parts = [F.min_by(F.struct(*scalars), by).alias("_s")]
    parts += [F.array_sort(F.collect_list(F.struct(by.alias("o"), F.col(c).alias("v")))).alias(f"_{c}") for c in schema.MERGED]
    out = entities.groupBy(*key).agg(*parts)
    united = [F.array_distinct(F.flatten(F.transform(f"_{c}", lambda x: x["v"]))).alias(c) for c in schema.MERGED]
    return out.select(*key, *[F.col("_s")[c].alias(c) for c in scalars], *united)


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in an order; all of them if n is not positive."""
    df = df.orderBy(*order)
    return df.limit(n) if n > 0 else df


def numbered(df: DataFrame, keys: list[str], *order, name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
