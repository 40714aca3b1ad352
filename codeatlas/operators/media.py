"""Image assets: routing, key-frame attachment, payload shape and token totals per instance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.media import image_tokens, media_route

FRAME_SUFFIX = r"_\d+\.png$"
VIDEO_MIN_FRAMES = 4


def route_assets(assets: DataFrame, name_col: str = "name") -> DataFrame:
    kind, mime = media_route(F.col(name_col))
    return assets.withColumn("kind", kind).withColumn("mime", mime)


def frames_of_gif(frames: DataFrame, frame_col: str = "frame") -> DataFrame:
    """Key frames carry their gif's name: ``<gif>_<n>.png``; the gif name is recovered from the
    frame name, turning the original prefix test into an equi-join key."""
    return frames.withColumn("gif", F.regexp_replace(F.col(frame_col), FRAME_SUFFIX, ""))


def frames_payload(gifs: DataFrame, frames: DataFrame, key_cols: list[str], frame_col: str = "frame") -> DataFrame:
    """Per gif asset: its key frames (ordered by frame number) sent as separate images when there
    are fewer than 4, else as one video.  ``key + (gif, n_frames, payload, frames)``.  Frames carry
    ``key_cols``: gifs of two instances may share a name."""
    fr = frames_of_gif(frames, frame_col).withColumn(
        "_no", F.regexp_extract(F.col(frame_col), r"_(\d+)\.png$", 1).cast("long"))
    j = gifs.select(*key_cols, F.col("name").alias("gif")).join(
        fr.select(*key_cols, "gif", "_no", frame_col), [*key_cols, "gif"])
    g = j.groupBy(*key_cols, "gif").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.array_sort(F.collect_list(F.struct("_no", frame_col))).alias("_f"))
    return g.select(*key_cols, "gif", "n_frames",
                    F.when(F.col("n_frames") < VIDEO_MIN_FRAMES, "image_url").otherwise("video").alias("payload"),
                    F.array_join(F.transform("_f", lambda s: s[frame_col]), ",").alias("frames"))


def instance_image_tokens(assets: DataFrame, frames: DataFrame, key_cols: list[str],
                          frame_col: str = "frame") -> DataFrame:
    """Vision tokens per instance: every non-gif asset by its own size, every gif by the sum over
    its key frames of the same instance (frames carry ``key_cols``).  Missing sizes count 0.  Sums are partial aggregations
    (no skew on a hot key); gifs of one name are counted and their frames summed before they meet, so that
    a name which many gifs and frames of an instance share costs one pair."""
    still = assets.filter(~F.col("name").endswith(".gif")).select(
        *key_cols, image_tokens(F.col("height"), F.col("width")).alias("t"))
    fr = frames_of_gif(frames, frame_col).groupBy(*key_cols, "gif").agg(F.sum(image_tokens(F.col("height"), F.col("width"))).alias("t"))
    gif = assets.filter(F.col("name").endswith(".gif")).groupBy(*key_cols, F.col("name").alias("gif")).agg(F.count(F.lit(1)).alias("_n")) \
        .join(fr, [*key_cols, "gif"]).select(*key_cols, (F.col("_n") * F.col("t")).alias("t"))
    return still.unionByName(gif).groupBy(*key_cols).agg(F.sum("t").cast("long").alias("image_tokens"))
