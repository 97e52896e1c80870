"""Tracking accuracy of every class: localisation, association and classification counted apart (TETA).

Gold and predicted frames come as rows (video_id, track_id, category_id, frame, x, y, w, h). Predictions are matched by
place alone; their class only counts among the matched. A class is judged on the tracks that overlap its gold by half
in some frame, less those that, in that frame, belong to gold of another class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.materialize import written
from .frame_pairs import aligned_matches, near_any
from .tracks import cornered

#: Localisation thresholds are 0, 0.05 .. 0.95; those from 0.5 also count classes.
LEVELS, FIRST_CLASS_LEVEL, OVERLAP = 20, 10, 0.5
EPS = 2.220446049250313e-16
COUNTS = ["loc_tp", "loc_fn", "loc_fp", "cls_tp", "cls_fn", "cls_fp"]
SHARES = ["assoc_a", "assoc_re", "assoc_pr"]
KEY = ["video_id", "category_id"]


def _level(sim: Column) -> Column:
    """The highest threshold's number that a similarity reaches."""
    return F.aggregate(F.array(*[F.lit(i / LEVELS) for i in range(1, LEVELS)]), F.lit(0), lambda n, x: n + (sim >= x - EPS).cast("int"))


def _upto(levels: DataFrame, by: list[str], value: str, first: int = 0) -> DataFrame:
    """``value`` summed over all rows whose ``level`` reaches each threshold: a row of level 7 counts at 0 to 7."""
    summed = levels.groupBy(*by, "level").agg(F.sum(value).alias(value))
    at = F.explode(F.sequence(F.lit(first), F.col("level"))).alias("at")
    return summed.where(F.col("level") >= first).select(*by, value, at).groupBy(*by, "at").agg(F.sum(value).alias(value))


def teta_counts(gt: DataFrame, dt: DataFrame, exhaustive: bool = False) -> DataFrame:
    """(video_id, category_id, alpha) with localisation counts, association shares and, from alpha 0.5 on, class counts.

    At alpha 0 every gold box of a frame takes some kept track while there are any: those without overlap pair up in
    the order of their ids. ``exhaustive`` also counts predicted boxes of a class that overlap none of its gold as
    wrong in class; where a class has no overlapping track in a video, wrong classes of smaller ids aren't added to
    these. Cases: rows with a null key take no part; a track id occurs once a frame; classes are those of either table,
    and a pair of video and class that neither has nor gets counts is not listed; an empty table on one side is all
    misses or none.
    """
    gold = cornered(gt.select("video_id", F.col("track_id").alias("g"), "category_id", "frame", *"xywh"))
    seen = cornered(dt.select("video_id", F.col("track_id").alias("t"), F.col("category_id").alias("guess"), "frame", *"xywh"))
    g_n = gold.groupBy("video_id", "g").agg(F.count("*").alias("g_n"))
    t_n = seen.groupBy("video_id", "t").agg(F.count("*").alias("t_n"))
    sized, counted = gold.join(g_n, ["video_id", "g"]), seen.join(t_n, ["video_id", "t"])

    # whom each track belongs to, frame by frame, when all gold competes
    owned = aligned_matches(sized, counted, ["video_id"], OVERLAP).where(F.col("sim") >= OVERLAP - EPS)
    owner = owned.join(gold.select("video_id", "frame", "g", "category_id"), ["video_id", "frame", "g"]).select("video_id", "frame", "t", F.col("category_id").alias("owner"))

    near = near_any(gold, seen, KEY, ["video_id"], OVERLAP).distinct().join(owner, ["video_id", "frame", "t"], "left")
    near = written(near.where(F.col("owner").isNull() | (F.col("owner") == F.col("category_id"))).drop("owner"))
    kept = near.select(*KEY, "t").distinct()
    own = aligned_matches(sized, counted.join(kept, ["video_id", "t"]), KEY)
    best = written(own.join(seen.select("video_id", "frame", "t", "guess"), ["video_id", "frame", "t"]))
    matched = best.select(*KEY, "frame", "g", "t", "guess", "g_n", "t_n", _level(F.col("sim")).alias("level"))

    # at alpha 0 the others pair up by rank
    def ranked_rest(rows: DataFrame, item: str) -> DataFrame:
        rest = rows.join(best.select(*KEY, "frame", item), [*KEY, "frame", item], "left_anti")
        return rest.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY, "frame").orderBy(item)))

    present = seen.select("video_id", "frame", "t", "guess").join(kept, ["video_id", "t"])
    idle = ranked_rest(gold.select(*KEY, "frame", "g"), "g").join(ranked_rest(present.select(*KEY, "frame", "t", "guess"), "t"), [*KEY, "frame", "rank"])
    idle = idle.join(g_n, ["video_id", "g"]).join(t_n, ["video_id", "t"])
    matched = written(matched.unionByName(idle.select(*KEY, "frame", "g", "t", "guess", "g_n", "t_n", F.lit(0).alias("level"))))

    one = lambda rows: rows.withColumn("n", F.lit(1))
    tp = _upto(one(matched), KEY, "n").withColumnRenamed("n", "loc_tp")
    ids = _upto(one(matched), [*KEY, "g", "t", "g_n", "t_n"], "n")
    n = F.col("n")
    assoc = ids.groupBy(*KEY, "at").agg(
        F.sum(n * n / (F.col("g_n") + F.col("t_n") - n)).alias("assoc_a"), F.sum(n * n / F.col("g_n")).alias("assoc_re"), F.sum(n * n / F.col("t_n")).alias("assoc_pr")
    )
    # an overlapping track is a false positive at every threshold above the one it matches at
    missed = near.join(matched.select(*KEY, "frame", "t", "level"), [*KEY, "frame", "t"], "left")
    hit = _upto(one(missed.where("level IS NOT NULL")), KEY, "n").withColumnRenamed("n", "hit")
    right = _upto(one(matched).withColumn("n", (F.col("guess") == F.col("category_id")).cast("long")), KEY, "n", FIRST_CLASS_LEVEL).withColumnRenamed("n", "cls_tp")
    wrong = _upto(one(matched.where("guess <> category_id").select("video_id", F.col("guess").alias("category_id"), F.col("category_id").alias("of"), "level")), [*KEY, "of"], "n", FIRST_CLASS_LEVEL)
    extra = None
    if exhaustive:
        alone = kept.select(*KEY).distinct().withColumn("judged", F.lit(True))
        wrong = wrong.join(alone, KEY, "left").where(F.col("judged") | (F.col("of") > F.col("category_id")))
        stray = seen.select("video_id", F.col("guess").alias("category_id"), "frame", "t").join(near, [*KEY, "frame", "t"], "left_anti")
        extra = stray.groupBy(*KEY).agg(F.count("*").alias("extra"))
    wrong = wrong.groupBy(*KEY, "at").agg(F.sum("n").alias("cls_fp"))

    totals = gold.groupBy(*KEY).agg(F.count("*").alias("gold"))
    pairs = gold.select(*KEY).union(seen.select("video_id", "guess")).distinct()
    out = pairs.select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("at")).join(totals, KEY, "left").join(near.groupBy(*KEY).agg(F.count("*").alias("near")), KEY, "left")
    for part in (tp, assoc, hit, right, wrong):
        out = out.join(part, [*KEY, "at"], "left")
    out = out.join(extra, KEY, "left") if extra is not None else out.withColumn("extra", F.lit(0))
    out = out.fillna(0, ["gold", "near", "loc_tp", "hit", "cls_tp", "cls_fp", "extra"]).fillna(0.0, SHARES)
    classed = F.col("at") >= FIRST_CLASS_LEVEL
    return out.select(
        *KEY, (F.col("at") / LEVELS).alias("alpha"), "loc_tp", (F.col("gold") - F.col("loc_tp")).alias("loc_fn"), (F.col("near") - F.col("hit")).alias("loc_fp"),
        *[(F.col(c) / F.greatest(F.lit(1), F.col("loc_tp"))).alias(c) for c in SHARES],
        F.when(classed, F.col("cls_tp")).alias("cls_tp"), F.when(classed, F.col("loc_tp") - F.col("cls_tp")).alias("cls_fn"), F.when(classed, F.col("cls_fp") + F.col("extra")).alias("cls_fp"),
    )


def teta_scores(counts: DataFrame, by: list[str]) -> DataFrame:
    """Scores a value of ``by`` and alpha: LocA/Re/Pr and AssocA/Re/Pr by alpha, ClsA/Re/Pr averaged over their alphas,
    and their mean, TETA. ``counts`` must hold one row a value of ``by`` and alpha, as ``combine`` gives it."""

    def ratio(of: str, *others: str) -> Column:
        whole = F.col(of)
        for c in others:
            whole = whole + F.col(c)
        return F.col(of) / F.greatest(F.lit(1), whole)

    out = counts.withColumns({"loc_a": ratio("loc_tp", "loc_fn", "loc_fp"), "loc_re": ratio("loc_tp", "loc_fn"), "loc_pr": ratio("loc_tp", "loc_fp")})
    classes = {"cls_a": ratio("cls_tp", "cls_fn", "cls_fp"), "cls_re": ratio("cls_tp", "cls_fn"), "cls_pr": ratio("cls_tp", "cls_fp")}
    whole = Window.partitionBy(*by)
    out = out.withColumns({c: F.avg(x).over(whole) for c, x in classes.items()})  # a fixed number of rows a value
    return out.withColumn("teta", (F.col("loc_a") + F.col("assoc_a") + F.col("cls_a")) / 3)
