"""Words and endings that many names share, learned from the names: they tell a kind, not an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An ending tells a kind if so many names, and this part of all, share it; its length is 2 to so many.
ENDING_NAMES, ENDING_PART, ENDING_LETTERS = 4, 0.002, 8
#: A word is common if it goes with so many distinct names proper, and with this part of them.
WORD_NAMES, WORD_PART = 3, 0.001
#: A word that this part of the names hold is a form of vehicle and tells nothing.
VEHICLE_PART = 0.5


def learned_endings(names: DataFrame, name: str) -> dict[str, str]:
    """Endings that many names share, each meaning itself.

    Where one letter goes before most names of an ending, it is part of a longer one and none itself; where a shorter
    one qualifies, the longer adds nothing. An ending holds at least ENDING_PART of the companies, which bounds what
    reaches the driver.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\(주\)|㈜|주식회사", ""), r"[\s.,]+", "")
    one = names.select(plain.alias("_n")).where(F.length("_n") > 2).distinct()
    sizes = F.sequence(F.lit(2), F.least(F.length("_n") - 1, F.lit(ENDING_LETTERS)))
    cut = one.select("_n", F.explode(sizes).alias("_k")).select(F.right("_n", F.col("_k")).alias("ending"), F.right("_n", F.col("_k") + 1).alias("longer"))
    found = cut.groupBy("ending", "longer").agg(F.count(F.lit(1)).alias("n")).groupBy("ending").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    least = F.greatest(F.lit(float(ENDING_NAMES)), ENDING_PART * one.agg(F.count(F.lit(1))).scalar())
    kept = {r["ending"] for r in found.where((F.col("n") >= least) & (F.col("most") < 0.5 * F.col("n"))).select("ending").collect()}
    return {e: e for e in sorted(kept) if not any(e[i:] in kept for i in range(1, len(e)))}


def common_words(products: DataFrame, name: str, manager: str, least_words: int = 5) -> tuple[dict[str, str], list[str]]:
    """(themes, others): words shared by many product names; others are managers and forms of vehicle.

    Full names are "manager brand theme vehicle number class", so the second word is the name proper. A word without
    digits is common if it stands beside many different such words; it is a manager if it begins the manager's name in
    most of its products. Both lists hold words of at least WORD_PART of the names proper, which bounds what reaches the
    driver.
    """
    one = products.select(F.trim(F.lower(name)).alias("_n"), F.lower(F.trim(manager)).alias("_m")).where("_n IS NOT NULL").distinct().withColumn("_s", F.split("_n", r"\s+"))
    words = one.where(F.size("_s") >= least_words).select("_m", F.col("_s")[1].alias("_own"), F.explode(F.array_distinct("_s")).alias("_w"))
    told = words.where((F.col("_w") != F.col("_own")) & ~F.col("_w").rlike("[0-9]") & (F.length("_w") > 1)).groupBy("_w").agg(F.count_distinct("_own").alias("beside"), F.count(F.lit(1)).alias("n"), F.count_if(F.startswith("_m", F.col("_w"))).alias("as_manager"))
    total = words.agg(F.count_distinct("_own")).scalar()
    least = F.greatest(F.lit(float(WORD_NAMES)), WORD_PART * total)
    rows = told.where(F.col("beside") >= least).select("_w", (F.col("as_manager") > 0.5 * F.col("n")).alias("m"), (F.col("beside") >= VEHICLE_PART * total).alias("v")).collect()
    return {r["_w"]: r["_w"] for r in rows if not r["m"] and not r["v"]}, sorted(r["_w"] for r in rows if r["m"] or r["v"])
