"""Box operators over rows: suppression, matching, the largest face."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from galleria.functions.geometry import area, greedy_nms, iou, one_shot_nms

#: Candidates of one image at most that are suppressed together: a limit of the detector, by score. It bounds the arrays.
MOST_CANDIDATES = 2000


def candidates(boxes: DataFrame, group: str, least_score: float = 0.5) -> DataFrame:
    """Boxes of at least a score, the best MOST_CANDIDATES of each image. boxes: group, id, score, box."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    return boxes.where(F.col("score") >= least_score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MOST_CANDIDATES)


def nms(boxes: DataFrame, group: str, threshold: float = 0.4, mode: str = "greedy") -> DataFrame:
    """Boxes that stay, by greedy or one-shot suppression. boxes: group, id, score, box; at most MOST_CANDIDATES a group."""
    packed = boxes.groupBy(group).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "score", "box.x1", "box.y1", "box.x2", "box.y2"))).alias("b"))
    kept = {"greedy": greedy_nms, "oneshot": one_shot_nms}[mode](F.col("b"), threshold)
    return packed.select(group, F.explode(kept).alias("k")).select(group, "k.id", "k.score", F.struct("k.x1", "k.y1", "k.x2", "k.y2").alias("box"))


def largest(boxes: DataFrame, group: str) -> DataFrame:
    """The box with the largest area of each image, the first by id on ties."""
    return boxes.groupBy(group).agg(F.max_by(F.struct("id", "score", "box"), F.struct(area(F.col("box")), -F.col("id"))).alias("r")).select(group, "r.*")


def best_match(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """For each box of left the box of right in the same image with the largest overlap (null if none overlaps)."""
    x = left.select(group, F.col("id").alias("left_id"), F.col("box").alias("u"))
    y = right.select(group, F.col("id").alias("right_id"), F.col("box").alias("v"))
    scored = x.join(y, group).withColumn("iou", iou(F.col("u"), F.col("v"))).where("iou > 0")
    best = scored.groupBy(group, "left_id").agg(F.max_by(F.struct("right_id", "iou"), F.struct("iou", -F.col("right_id"))).alias("r"))
    return x.select(group, "left_id").join(best.select(group, "left_id", "r.*"), [group, "left_id"], "left")
