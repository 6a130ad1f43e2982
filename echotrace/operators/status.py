"""What is stored of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _some(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def status(messages: DataFrame, *, group: str = "group_id") -> DataFrame:
    """Counts of a group's messages: all, with an embedding, images and their hashes, videos and their fingerprints by kind, bundles
    and their hashes, URLs and their hashes.  Videos are counted one by one, without a row for each."""
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    videos = lambda c, name: F.coalesce(F.sum(F.size(F.filter("videos", lambda v: F.coalesce(c(v), F.lit(False))))), F.lit(0)).alias(name)
    return messages.withColumn("videos", F.coalesce("videos", F.expr("cast(array() as " + messages.schema["videos"].dataType.simpleString() + ")"))).groupBy(group).agg(
        F.count("*").alias("messages"), count(F.size("embedding") > 0, "embedded"), count(F.col("has_image"), "images"), count(_some("image_hash"), "image_hashes"), count(F.col("has_video"), "video_messages"),
        videos(lambda v: v["sha256"] != "", "video_files"), videos(lambda v: F.size(v["frame_hashes"]) > 0, "video_frames"), videos(lambda v: v["analysis"] == "metadata", "video_metadata"),
        count(_some("forward_id"), "forwards"), count(_some("forward_hash"), "forward_hashes"), count(_some("forward_text_hash"), "forward_text_hashes"), count(F.col("forward_partial"), "forwards_partial"),
        count(F.col("url_only"), "urls"), count(_some("url_hash"), "url_hashes"),
    )
