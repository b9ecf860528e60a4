"""Click events derived from the given tables.

The tables hold no ad clicks, so the raw click columns are computed from
`events` (and, for the large frame, from `lineitem` and `orders`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickward.sources.events import EVENT_COLUMNS

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def as_clicks(events: DataFrame) -> DataFrame:
    """Nine string columns and `event_id` from an events frame, batch or stream."""
    bought = F.col("event_type") == "purchase"
    k = F.col("k")
    return events.withColumn("k", props_k()).select(
        "event_id",
        F.date_format("ts", TIME_FORMAT).alias("click_time"),
        F.col("user_id").cast("string").alias("ip"),
        (F.floor("value").cast("int") % 12).cast("string").alias("app"),
        (k % 4).cast("string").alias("device"),
        (F.lit(9) + F.floor(k / 4).cast("int") % 8).cast("string").alias("os"),
        (F.lit(100) + k % 40).cast("string").alias("channel"),
        F.lit(None).cast("string").alias("is_fraud"),
        F.when(bought, "1").otherwise("0").alias("is_attributed"),
        F.when(bought, F.date_format(F.col("ts") + F.expr("INTERVAL 5 MINUTES"), TIME_FORMAT))
        .otherwise("")
        .alias("attributed_time"),
    )


def clicks_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_clicks(table(spark, sf_dir, "events"))


def clicks_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean clicks with bad times, texts, missing values and duplicates.

    One scan: a row with a duplicate is exploded into itself and an unedited
    copy under a shifted id.
    """
    clean = clicks_clean(spark, sf_dir)
    copies = F.when(F.col("event_id") % 97 == 0, F.array(F.lit(False), F.lit(True))).otherwise(
        F.array(F.lit(False))
    )
    rows = clean.withColumn("copy", F.explode(copies))
    edit = ~F.col("copy")

    def hit(n: int) -> Column:
        return edit & (F.col("event_id") % n == 0)

    return rows.select(
        (F.col("event_id") + F.when(F.col("copy"), 1_000_000_000).otherwise(0)).alias("event_id"),
        F.when(hit(107), "bad").when(hit(131), "1999-12-31 23:59:59").otherwise(F.col("click_time")).alias("click_time"),
        "ip",
        F.when(hit(103), "-1").otherwise(F.col("app")).alias("app"),
        F.when(hit(109), "abc").otherwise(F.col("device")).alias("device"),
        "os",
        F.when(hit(101), F.lit(None))
        .when(hit(113), F.concat("channel", F.lit(".0")))
        .otherwise(F.col("channel"))
        .alias("channel"),
        "is_fraud",
        F.when(hit(127), F.lit(None)).otherwise(F.col("is_attributed")).alias("is_attributed"),
        "attributed_time",
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, p) with 100 distinct scores, so that ties matter."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        (props_k() / F.lit(100.0)).alias("p"),
    )


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, split, id, y, p): three score rules on a validation and a test half."""
    events = table(spark, sf_dir, "events").withColumn("k", props_k())
    y = (F.col("event_type") == "purchase").cast("int")
    rules = F.array(
        F.struct(F.lit("by_k").alias("model"), (F.col("k") / F.lit(100.0)).alias("p")),
        F.struct(F.lit("by_value").alias("model"), ((F.floor("value").cast("int") % 100) / F.lit(100.0)).alias("p")),
        F.struct(F.lit("by_mix").alias("model"), ((F.col("k") + 37 * y) / F.lit(200.0)).alias("p")),
    )
    split = F.when(F.col("event_id") % 2 == 0, "val").otherwise("test")
    return events.select(
        F.col("event_id").alias("id"), split.alias("split"), y.alias("y"), F.explode(rules).alias("r")
    ).select("r.model", "split", "id", "y", "r.p")


def clicks_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed clicks from line items and their orders, with many equal times."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    quantity = F.col("l_quantity").cast("int")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
        F.col("l_shipdate").cast("timestamp").alias("click_time_ts"),
        F.col("o_custkey").alias("ip"),
        F.col("l_linenumber").alias("app"),
        (quantity % 4).alias("device"),
        (F.lit(9) + quantity % 8).alias("os"),
        F.col("l_suppkey").cast("int").alias("channel"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_attributed"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("is_fraud"),
    )


def as_raw(clicks: DataFrame) -> DataFrame:
    """Only the nine raw columns, as a file or topic would carry them."""
    return clicks.select(*EVENT_COLUMNS)
