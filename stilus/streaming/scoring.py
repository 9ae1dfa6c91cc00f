"""Optional streaming: texts scored, posts taken once and counted as files arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stilus.operators.skew import word_count

POSTS = "post_id long, author_id int, post_date string, text string, loaded_at timestamp_ntz"
#: How late a post may come.
LATE = "60 days"


def stream_word_counts(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Words per row of every new Parquet file in `source`, appended to `target`; stateless, so a
    restart from the checkpoint repeats nothing."""
    rows = spark.readStream.schema("row_id long, text string").parquet(source)
    out = rows.select("row_id", word_count(F.col("text")).alias("n_words"))
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _posts(spark: SparkSession, source: str, files: int):
    rows = spark.readStream.schema(POSTS).option("maxFilesPerTrigger", files).parquet(source)
    return rows.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", LATE)


def stream_unique_posts(spark: SparkSession, source: str, target: str, checkpoint: str, files: int = 100):
    """Each post once, however often it is delivered within LATE: its first delivery is appended to
    `target`. The state holds the ids of that stretch only."""
    once = _posts(spark, source, files).dropDuplicatesWithinWatermark(["post_id"])
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_daily_words(spark: SparkSession, source: str, target: str, checkpoint: str, files: int = 100):
    """(day, n_posts, n_words) by day of loading, appended once no post of the day can come any more;
    posts later than LATE don't count."""
    day = F.window("loaded_at", "1 day")
    counts = _posts(spark, source, files).groupBy(day).agg(F.count(F.lit(1)).alias("n_posts"), F.sum(word_count(F.col("text"))).alias("n_words"))
    out = counts.select(F.col("window.start").alias("day"), "n_posts", "n_words")
    return out.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
