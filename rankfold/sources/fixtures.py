"""The driver's tables as matrix pairs (ours; see README "fixtures").

* lineitem: A = order x part, B = order x supplier, value = quantity.
* embeddings: coordinates are rows; vectors with label < 5 are the columns
  of A, label >= 5 those of B (cross-covariance of two groups); PCA when
  both sides take every vector.
* events: row = event hour, A column = user, B column = event type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.functions.hashing import hash52
from rankfold.sources.tables import cells_from_vectors, cells_pair_from_table, stored_pair_from_table, vecs_from_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return cells_pair_from_table(li, "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


def stored_lineitem_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    """The same cells stored, for jobs that read them often; and whether they lie in buckets of their row."""
    li = table(spark, sf_dir, "lineitem")
    return stored_pair_from_table(li, "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


def embeddings_side(label_col="label"):
    return F.when(F.col(label_col) < 5, F.lit("A")).otherwise(F.lit("B"))


def embeddings_vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vecs(mat, col, vec), whole vectors."""
    return vecs_from_table(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", embeddings_side())


def vector_width(vecs: DataFrame) -> int:
    """Coordinates of the longest vector (1 where there is none)."""
    return max(1, int(vecs.agg(F.max(F.size("vec"))).first()[0] or 1))


def embeddings_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", embeddings_side())


def event_type_id(col="event_type"):
    """Stable BIGINT id for an event type (same md5 rule as all hashing)."""
    return hash52(0, "etype", F.col(col))


def events_cells_rows(events: DataFrame) -> DataFrame:
    """Un-aggregated cell contributions of the event stream: each event adds
    ``value`` to A(hour, user) and to B(hour, event type)."""
    # hours since 1970-01-01 from the wall-clock fields: independent of the session time zone
    hour = (F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint") * F.lit(24)
            + F.hour("ts")).cast("bigint")
    return events.select(
        hour.alias("row"), F.col("value").cast("double").alias("val"), F.col("ts"),
        F.explode(F.array(
            F.struct(F.lit("A").alias("mat"), F.col("user_id").cast("bigint").alias("col")),
            F.struct(F.lit("B").alias("mat"), event_type_id().alias("col")),
        )).alias("c"),
    ).select(F.col("c.mat").alias("mat"), "row", F.col("c.col").alias("col"), "val", "ts")


def user_hour_vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vecs(mat, col, vec): a user's event values summed by hour of day (24 entries)."""
    ev = table(spark, sf_dir, "events").where(F.col("value").isNotNull())
    h = ev.groupBy(F.col("user_id").cast("bigint").alias("col"), F.hour("ts").alias("h")).agg(
        F.sum(F.col("value").cast("double")).alias("v"))
    by_user = h.groupBy("col").agg(F.map_from_entries(F.collect_list(F.struct("h", "v"))).alias("m"))  # 24 entries at most
    return by_user.select(F.lit("A").alias("mat"), "col", F.transform(
        F.sequence(F.lit(0), F.lit(23)), lambda x: F.coalesce(F.element_at("m", x), F.lit(0.0))).alias("vec"))
