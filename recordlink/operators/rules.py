"""List legality, data quality and box geometry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.functions import text

# ---- fixed values -------------------------------------------------------------------------------
MAIN_LEAST, MAIN_MOST, EXTRA_MOST, SIDE_MOST = 40, 60, 15, 15
AREA, ASPECT, ASPECT_SLACK, RECTANGULAR, SAME_BOX = (0.02, 0.45), 59 / 86, 0.18, 0.75, 0.6
BLANK_DEVIATION, BLANK_EDGES = 8.0, 4.0
# -------------------------------------------------------------------------------------------------


def deck_legality(deck_cards: DataFrame, card: DataFrame) -> DataFrame:
    """Per deck: zone sizes, cards over their limit, and legal."""
    per_card = deck_cards.groupBy("deck_id", "card_id").agg(*[F.sum(F.when(F.col("zone") == z, F.col("quantity")).otherwise(0)).alias(z) for z in ("main", "extra", "side")])
    over = F.col("main") + F.col("extra") + F.col("side") > text.copy_limit(F.col("ban_tcg"))
    g = per_card.join(card.select("card_id", "ban_tcg"), "card_id").groupBy("deck_id").agg(F.sum("main").alias("main"), F.sum("extra").alias("extra"), F.sum("side").alias("side"), F.count_if(over).alias("over_limit"))
    return g.withColumn("legal", F.col("main").between(MAIN_LEAST, MAIN_MOST) & (F.col("extra") <= EXTRA_MOST) & (F.col("side") <= SIDE_MOST) & (F.col("over_limit") == 0))


def deck_issues(deck_cards: DataFrame, card: DataFrame) -> DataFrame:
    """(deck_id, issues): a list of what breaks a rule, empty for a legal list; cards over their limit as ``copies id:number,...``."""
    zone = lambda z: F.sum(F.when(F.col("zone") == z, F.col("quantity")).otherwise(0)).alias(z)
    per_card = deck_cards.groupBy("deck_id", "card_id").agg(zone("main"), zone("extra"), zone("side"), F.sum("quantity").alias("n")).join(card.select("card_id", "ban_tcg"), "card_id")
    over = F.when(F.col("n") > text.copy_limit(F.col("ban_tcg")), F.struct("card_id", F.concat_ws(":", "card_id", F.col("n").cast("long")).alias("t")))
    g = per_card.groupBy("deck_id").agg(*[F.sum(z).alias(z) for z in ("main", "extra", "side")], F.sort_array(F.collect_list(over)).alias("over"))
    copies = F.array_join(F.transform("over", lambda x: x["t"]), ",")
    issues = [
        F.when(F.col("main") < MAIN_LEAST, f"main below {MAIN_LEAST}"), F.when(F.col("main") > MAIN_MOST, f"main above {MAIN_MOST}"), F.when(F.col("extra") > EXTRA_MOST, f"extra above {EXTRA_MOST}"),
        F.when(F.col("side") > SIDE_MOST, f"side above {SIDE_MOST}"), F.when(copies != "", F.concat(F.lit("copies "), copies)),
    ]
    return g.select("deck_id", F.array_compact(F.array(*issues)).alias("issues"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """One row: how many child rows name no parent (a null key names none on purpose)."""
    bad = child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti")
    return bad.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): how many rows meet each bad condition, all in one pass; null is no violation."""
    g = df.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
    return g.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("r")).select("r.*")


def repeated_keys(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """One row: how many keys stand more than once, null being equal to null."""
    return df.groupBy(*key).count().filter("count > 1").agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))


def wrong_translations(alt: DataFrame, card: DataFrame) -> DataFrame:
    j = alt.select("card_id", "language", "name_en").join(card.select("card_id", "name"), "card_id")
    return j.filter(~F.col("name_en").eqNullSafe(F.col("name"))).select("card_id", "language", "name_en", "name")


def candidate_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes whose area, aspect and rectangularity (``filled``, the contour's area, over the box's) could be a card's. A contour of exactly that share counts, so the product is taken share first, as contours are scaled."""
    area = F.col("w") * F.col("h")
    return boxes.filter(area.between(*AREA) & (F.abs(F.col("w") / F.col("h") - ASPECT) <= ASPECT_SLACK) & (F.col("filled") >= F.lit(RECTANGULAR) * F.col("w") * F.col("h")))


def filled_cells(cells: DataFrame) -> DataFrame:
    """Grid cells (image_id, cell, deviation, edges) without the blank ones (smooth and without edges); an image of blank cells only keeps all."""
    blank = (F.col("deviation") <= BLANK_DEVIATION) & (F.col("edges") <= BLANK_EDGES)
    some = F.bool_or(~blank).over(W.partitionBy("image_id"))
    return cells.withColumn("_some", some).filter(~blank | ~F.col("_some")).drop("_some")


def pixel_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A relative box in whole pixels, cut at the image's borders."""
    at = lambda x, n: (x * n).cast("int")  # towards zero
    zero = lambda c: F.greatest(F.lit(0), c)
    return F.struct(zero(at(left, width)).alias("left"), zero(at(top, height)).alias("top"), F.least(width, at(right, width)).alias("right"), F.least(height, at(bottom, height)).alias("bottom"))


def ordered_boxes(boxes: DataFrame) -> DataFrame:
    """Per image: overlaps dropped (largest first, IoU >= 0.6), then reading order (rows by centre within half the mean height, then x). An image has a few hundred boxes at most."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for b in sorted(pdf.itertuples(index=False), key=lambda b: (-b.w * b.h, b.box_id)):
            def iou(k, b=b):
                wide, high = min(b.x + b.w, k.x + k.w) - max(b.x, k.x), min(b.y + b.h, k.y + k.h) - max(b.y, k.y)
                inter = max(wide, 0) * max(high, 0)
                return inter / (b.w * b.h + k.w * k.h - inter)
            if all(iou(k) < SAME_BOX for k in kept):
                kept.append(b)
        half = sum(b.h for b in kept) / len(kept) / 2
        rows: list[list] = []
        for b in sorted(kept, key=lambda b: (b.y + b.h / 2, b.box_id)):
            middle = b.y + b.h / 2
            if rows and abs(middle - sum(k.y + k.h / 2 for k in rows[-1]) / len(rows[-1])) <= half:
                rows[-1].append(b)
            else:
                rows.append([b])
        order = [b for r in rows for b in sorted(r, key=lambda b: (b.x, b.box_id))]
        return pd.DataFrame({"image_id": [b.image_id for b in order], "box_id": [b.box_id for b in order], "position": range(1, len(order) + 1)})

    return boxes.groupBy("image_id").applyInPandas(one, "image_id long, box_id long, position int")
