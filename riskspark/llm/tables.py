"""Helpers on tables that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import stage

BROADCAST_ROWS = 1_000_000
"""Tables of ids are sent to every executor up to this many counted rows, about 16 MB; larger ones are shuffled."""

PART_EDGES = 100_000
"""Edges of a graph in one partition, about 1.6 MB; small graphs are held in a partition for each core."""

HELD_EDGES = 50_000
"""The smallest neighbours in a graph of at most so many edges are sent to every executor, at most 1.6 MB."""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def col(df: DataFrame, name: str) -> Column:
    """The column of that very name, also when it holds dots."""
    return df["`" + name.replace("`", "``") + "`"]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it has at most ``rows`` rows. Give narrow staged tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is not in the staged one-column table ``ids``; rows without an id stay."""
    key = free_name(df, "dropped_id")
    ids = ids.toDF(key).distinct()
    return df.join(small(ids), col(df, id_col) == F.col(key), "left_anti")


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): root is the smallest node reachable.

    Alternates two star contractions: every node points its larger neighbours, then its smaller ones, at the
    smallest neighbour. Each contraction ends in a written table; rounds grow with the logarithm of the diameter.
    Neither makes more edges than it gets, so the partitions that edges are written in follow their first count.
    """

    def contracted(e: DataFrame, larger: bool) -> DataFrame:
        both = e if not larger else e.unionByName(e.selectExpr("b as a", "a as b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(parts)
        hung = both.join(F.broadcast(low) if rows <= HELD_EDGES else low, "a")
        if larger:
            hung = hung.where("b > a").selectExpr("b as a", "m as b")
        else:
            hung = hung.where("b <> m").selectExpr("b as a", "m as b").unionByName(low.selectExpr("a", "m as b"))
        return hung.where("a <> b").distinct().coalesce(parts)

    def is_stars(e: DataFrame) -> bool:
        """Every larger end has one smaller end, which is no larger end itself: contractions would change nothing."""
        ends = e.selectExpr("a as node", "1 as up").unionByName(e.selectExpr("b as node", "0 as up"))
        ends = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).coalesce(parts)
        return ends.where("ups > 1 or ups = 1 and least = 0").isEmpty()

    now = stage(edges.selectExpr("greatest(a, b) as a", "least(a, b) as b").where("a <> b").distinct(), name)
    rows = now.count()
    parts = max(now.sparkSession.sparkContext.defaultParallelism, rows // PART_EDGES + 1)
    for _ in range(rounds):
        if is_stars(now):
            break
        # Each contraction reads its edges several times, so it gets a table of its own: plans stay small for the driver.
        now = stage(contracted(stage(contracted(now, True), name), False), name)
    else:
        raise RuntimeError("components did not converge")
    return now.selectExpr("a as node", "b as root").unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def hash_sample(rows: DataFrame, group: str, counts: dict, most: int, h: Column, tie: str, once: list[str] | None = None) -> DataFrame:
    """The ``most`` rows of each group that come first by the hash ``h``; ``counts`` has the rows of every group. Of rows
    equal in the columns ``once`` one is ranked, and ``counts`` should count them so.

    A threshold on the hash leaves about three times as many rows before they are ranked, so the ranking of a group
    is as small for any input. Equal hashes may leave fewer rows.
    """
    steps = 1_000_000
    limit = F.lit(steps)
    for key, n in counts.items():
        if n > 3 * most:
            limit = F.when(F.col(group) == key, F.lit(3 * most * steps // n + 1)).otherwise(limit)
    place = free_name(rows, "place")
    first = rows.withColumn(place, F.pmod(h, F.lit(steps))).where(F.col(place) < limit)
    first = first.dropDuplicates(once) if once else first
    nth = F.row_number().over(Window.partitionBy(group).orderBy(place, h, tie))
    return first.withColumn(place, nth).where(F.col(place) <= most).drop(place)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most ``per_class`` distinct texts of each label, of at most ``chars`` characters, and the rows of each label.

    Ids are drawn from the narrow table of labels in the order of a hash, so documents are only read once, against
    a set of ids of known size. Null labels, ids and texts are left out.
    """
    rows = labels.select(col(labels, id_col).alias("k"), col(labels, label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = stage(hash_sample(rows, "y", counts, per_class, F.xxhash64("k"), "k").select("k", "y"), "drawn")
    texts = docs.select(col(docs, id_col).alias("k"), F.substring(col(docs, text_col), 1, chars).alias("text")).where("text is not null")
    found = texts.join(F.broadcast(drawn), "k").select("text", "y").collect()  # two classes of per_class ids
    return sorted({(r.text, r.y) for r in found}), counts
