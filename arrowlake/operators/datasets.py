"""Training-set assembly from arrows, boxes and questions."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.materialize import checkpointed


def seeded(seed: int, *keys: str) -> Column:
    """An order that looks random, but is the same on every run."""
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def ordered_join(order: str, text: Column, sep: str) -> Column:
    """Aggregate: the texts joined in the given order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), sep)


def arrow_samples(arrows: DataFrame, prompt: str, located: bool = False) -> DataFrame:
    """One chat sample per arrow: id, image and a question with its three-line (with locations five-line) answer."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit("None")))
    fields = [("source_node", "src"), *([("source_location", "src_loc")] if located else []), ("target_node", "dst"), *([("target_location", "dst_loc")] if located else []), ("condition", "cond")]
    talk = F.array(F.struct(F.lit("human").alias("from"), F.lit(prompt).alias("value")), F.struct(F.lit("gpt").alias("from"), F.concat_ws("\n", *[line(n, c) for n, c in fields]).alias("value")))
    return arrows.select(F.concat_ws("_", F.col("graph_id").cast("string"), F.col("arrow_id").cast("string")).alias("id"), "image", talk.alias("conversations"))


def image_triplets(arrows: DataFrame, order: str = "arrow_id") -> DataFrame:
    """Per diagram all ``<A, rel, B>`` lines once, in order of first appearance; parts joined by `` || `` are laid side by side."""
    parts = lambda c: F.split(c, r" \|\| ")
    s, r, d = parts("src"), parts("rel"), parts("dst")
    n = F.greatest(F.size(s), F.size(r), F.size(d))
    at = lambda a, i: F.get(a, F.least(i, F.size(a) - 1))
    rel = lambda i: F.when(F.lower(F.trim(at(r, i))).isin("", "none"), "connectedTo").otherwise(at(r, i))
    lines = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("<"), at(s, i), F.lit(", "), rel(i), F.lit(", "), at(d, i), F.lit(">")))
    rows = arrows.select("graph_id", order, F.posexplode(lines).alias("p", "line")).groupBy("graph_id", "line").agg(F.min(F.struct(order, "p")).alias("pos"))
    return rows.groupBy("graph_id").agg(ordered_join("pos", F.col("line"), "\n").alias("triplets"))


def k_groups_sliding(arrows: DataFrame, k: int) -> DataFrame:
    """Consecutive blocks of ``k`` arrows of a diagram in order of id."""
    w = Window.partitionBy("graph_id").orderBy("arrow_id")
    return arrows.withColumn("group_no", F.floor((F.row_number().over(w) - 1) / k))


def unranked(rank: int, k: int) -> list[int]:
    """The ``rank``-th k-subset of 0, 1, 2 ... in the combinatorial number system: rank is the sum of C(c_i, i)."""
    out = []
    for i in range(k, 0, -1):
        low, high = i - 1, i
        while math.comb(high, i) <= rank:
            low, high = high, 2 * high
        while high - low > 1:  # the largest c with C(c, i) <= rank
            mid = (low + high) // 2
            low, high = (mid, high) if math.comb(mid, i) <= rank else (low, mid)
        out.append(low)
        rank -= math.comb(low, i)
    return out[::-1]


def _drawn_ranks(k: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for graph, n, every, j in zip(rows.graph_id, rows.n, rows.every, rows.j, strict=True):
                mark = hashlib.blake2b(f"{seed}/{graph}/{j}".encode(), digest_size=16).digest()
                rank = int(j) if every else int.from_bytes(mark, "big") % math.comb(int(n), k)
                out.append((unranked(rank, k), int.from_bytes(mark[:8], "big", signed=True) if every else int(j)))
            yield rows[["graph_id"]].assign(places=[x for x, _ in out], turn=[x for _, x in out])

    return run


def k_groups_combos(arrows: DataFrame, k: int, mul: int | None = None, seed: int = 42) -> DataFrame:
    """``k``-subsets of each diagram's arrows, at most ``mul * ceil(n / k)`` of them (``mul`` is k if not given; negative:
    all) by a seeded draw; a diagram of fewer arrows gives one short group.

    Where there are more subsets than wanted, ranks are drawn and unranked, so the work grows with the groups that are
    kept: up to four times as many ranks are tried, each from a hash of diagram and turn, and of equal ones the first counts.
    """
    items = arrows.select("graph_id", "arrow_id")
    numbered = items.withColumn("place", (F.row_number().over(Window.partitionBy("graph_id").orderBy("arrow_id")) - 1).cast("long"))
    sizes = items.groupBy("graph_id").agg(F.count("*").alias("n"))
    short = items.join(sizes.where(F.col("n") < k), "graph_id").groupBy("graph_id").agg(F.sort_array(F.collect_list("arrow_id")).alias("ids"))
    every = mul is not None and mul < 0
    subsets = F.lit(1.0)
    for i in range(1, k + 1):
        subsets = subsets * (F.col("n") - k + i) / i  # near enough to compare with, and whole below 2^53
    plan = sizes.where(F.col("n") >= k).withColumn("wanted", (k if mul is None else max(mul, 0)) * F.ceil(F.col("n") / k))
    tried = 4 * F.col("wanted") + 64
    plan = plan.withColumn("every", F.lit(True) if every else subsets <= tried).withColumn("turns", F.when(F.col("every"), F.round(subsets)).otherwise(tried).cast("long"))
    draws = plan.select("graph_id", "n", "every", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("j")).repartition("graph_id", "j")
    kind = f"graph_id {items.schema['graph_id'].dataType.simpleString()}, places array<long>, turn long"
    found = draws.mapInPandas(_drawn_ranks(k, seed), kind).groupBy("graph_id", "places").agg(F.min("turn").alias("turn"))
    if not every:
        w = Window.partitionBy("graph_id").orderBy("turn", "places")
        found = found.withColumn("r", F.row_number().over(w)).join(plan.select("graph_id", "wanted"), "graph_id").where("r <= wanted")
    each = found.select("graph_id", "places", F.explode("places").alias("place")).join(numbered, ["graph_id", "place"])
    full = each.groupBy("graph_id", "places").agg(F.sort_array(F.collect_list("arrow_id")).alias("ids"))
    return full.select("graph_id", "ids").unionByName(short)


def k_answers(groups: DataFrame, answers: DataFrame) -> DataFrame:
    """``arrow_i:`` blocks of each group (graph_id, ids) joined by a blank line; groups with a missing answer are dropped."""
    rows = groups.select("graph_id", "ids", F.posexplode("ids").alias("p", "arrow_id")).join(answers, ["graph_id", "arrow_id"])
    block = F.concat(F.lit("arrow_"), (F.col("p") + 1).cast("string"), F.lit(":\n"), F.col("answer"))
    whole = rows.groupBy("graph_id", "ids").agg(F.count("answer").alias("c"), ordered_join("p", block, "\n\n").alias("text"))
    return whole.where(F.col("c") == F.size("ids")).drop("c")


def split_train_val(df: DataFrame, key: list[str], ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """``df`` with ``part``: exactly max(1, floor(n * ratio)) rows, first in a seeded order, are val.

    The cut is found from counts of hash ranges, so only one range is ever sorted.
    """
    hashed = df.withColumn("h", seeded(seed, *key))
    n = hashed.count()
    if n == 0:
        return hashed.select(*df.columns, F.lit("train").alias("part"))
    want = max(1, math.floor(n * ratio))
    top = F.shiftright("h", 48)
    counts = sorted((r[0], r[1]) for r in hashed.groupBy(top.alias("t")).count().collect())  # at most 65,536 rows
    total = 0
    for cut, c in counts:
        if total + c >= want:
            break
        total += c
    edge = hashed.where(top == cut).withColumn("r", F.row_number().over(Window.orderBy("h", *key))).where(F.col("r") == want - total)
    last = edge.select(F.struct("h", *key).alias("last"))
    return hashed.join(F.broadcast(last)).select(*df.columns, F.when(F.struct("h", *key) <= F.col("last"), "val").otherwise("train").alias("part"))


def leave_one_out(samples: DataFrame, source: str = "dataset") -> DataFrame:
    """For each data set, all samples of the others, tagged ``target`` and ``_src``."""
    targets = samples.select(F.col(source).alias("target")).distinct()
    others = targets.join(samples.select(F.col(source).alias("_src")).distinct(), F.col("target") != F.col("_src"))
    return samples.withColumnRenamed(source, "_src").join(others, "_src")


def to_messages(samples: DataFrame) -> DataFrame:
    """Chat samples in the role form: user or assistant, images as an array or null."""
    role = lambda t: F.struct(F.when(F.lower(t["from"]).isin("user", "human"), "user").otherwise("assistant").alias("role"), t["value"].alias("content"))
    return samples.select("id", F.transform("conversations", role).alias("messages"), F.when(F.col("image").isNotNull(), F.array("image")).alias("images"))


def to_openai_roles(conversations: Column, token: str = "<image>", instead: str = "[image]") -> Column:
    """human becomes user, gpt assistant; the media token is replaced."""
    who = lambda t: F.when(t["from"] == "human", "user").when(t["from"] == "gpt", "assistant").otherwise(t["from"])
    return F.transform(conversations, lambda t: F.struct(who(t).alias("role"), F.replace(t["value"], F.lit(token), F.lit(instead)).alias("content")))


def dense_ids(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """``df`` with ids from 1 in order of ``key``, sorted range by range and offset by the sizes of the ranges before."""
    distinct = df.select(*key).distinct()
    parts = distinct.repartitionByRange(*key).withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy(*key)
    ranked = checkpointed(parts.withColumn("r", F.row_number().over(w)))
    sizes = ranked.groupBy("part").agg(F.count("*").alias("c"))
    before = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    ids = ranked.join(F.broadcast(before), "part").select(*key, (F.col("r") + F.col("before")).cast("long").alias(name))
    return df.join(ids, key)


def build_coco(boxes: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) with dense ids for images that have a box: xywh, area, iscrowd 0."""
    used = images.join(boxes.select("image_id").distinct(), "image_id", "left_semi")
    numbered = dense_ids(used, ["image_id"], "id")
    rows = dense_ids(boxes, ["image_id", "box_id"], "ann_id").join(numbered.select("image_id", F.col("id").alias("new_image_id")), "image_id")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    anns = rows.select(F.col("ann_id").alias("id"), F.col("new_image_id").alias("image_id"), "category_id", F.array("x1", "y1", w, h).alias("bbox"), (w * h).alias("area"), F.lit(0).alias("iscrowd"))
    return numbered, anns


def coco_to_yolo(images: DataFrame, anns: DataFrame, cats: DataFrame) -> DataFrame:
    """(image_id, label): one line ``class cx cy w h`` per box, clamped and with six decimals; images without any have an empty label."""
    classes = cats.withColumn("cls", F.row_number().over(Window.orderBy("category_id")) - 1)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rows = anns.join(images, "image_id").join(classes, "category_id")
    rows = rows.withColumns({"cx": clamp((F.col("x1") + F.col("x2")) / 2 / F.col("width")), "cy": clamp((F.col("y1") + F.col("y2")) / 2 / F.col("height")), "w": clamp((F.col("x2") - F.col("x1")) / F.col("width")), "h": clamp((F.col("y2") - F.col("y1")) / F.col("height"))})
    rows = rows.where("w > 0 AND h > 0").withColumn("line", F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "cx", "cy", "w", "h"))
    labels = rows.groupBy("image_id").agg(ordered_join("box_id", F.col("line"), "\n").alias("label"))
    return images.select("image_id").join(labels, "image_id", "left").withColumn("label", F.coalesce("label", F.lit("")))


def reindex_one_based(tables: dict[str, DataFrame], references: dict[str, list[tuple[str, str]]]) -> dict[str, DataFrame]:
    """Adds 1 to the ids of every table that has an id 0, and to ``references[table]``: (table, column) pairs that point there."""
    shift = {name: int(not df.where("id = 0").isEmpty()) for name, df in tables.items()}
    out = {name: df.withColumn("id", F.col("id") + shift[name]) for name, df in tables.items()}
    for name, uses in references.items():
        for other, column in uses:
            out[other] = out[other].withColumn(column, F.col(column) + shift[name])
    return out


def category_queries(images: DataFrame, anns: DataFrame, cats: DataFrame, negatives: bool = True, chunk: int | None = None) -> DataFrame:
    """Per image and category one query with the ids of its objects; ``negatives`` keeps those without any.

    With ``chunk`` the categories, in order of id, are cut into chunks of so many, and a query has its ``chunk`` and its
    number ``query_no`` within image and chunk, both from 0.
    """
    held = anns.groupBy("image_id", "category_id").agg(F.sort_array(F.collect_list("box_id")).alias("objects"))
    if negatives:
        every = images.select("image_id").join(cats.select("category_id"))  # the contract: a row for each
        out = every.join(held, ["image_id", "category_id"], "left").withColumn("objects", F.coalesce("objects", F.array().cast("array<bigint>")))
    else:
        out = held.join(images.select("image_id"), "image_id").join(cats.select("category_id"), "category_id", "left_semi")
    if chunk is None:
        return out
    ranks = dense_ids(cats.select("category_id").distinct(), ["category_id"], "rank").select("category_id", F.floor((F.col("rank") - 1) / chunk).alias("chunk"))
    w = Window.partitionBy("image_id", "chunk").orderBy("category_id")
    return out.join(ranks, "category_id").withColumn("query_no", (F.row_number().over(w) - 1).cast("long"))


def filter_queries(queries: DataFrame, rules: list[Column]) -> DataFrame:
    """Queries that no rule rejects (a rule is a boolean Column), with their stages renumbered from 0 per image."""
    kept = queries
    for rule in rules:
        kept = kept.where(~F.coalesce(rule, F.lit(False)))
    return kept.withColumn("stage", F.dense_rank().over(Window.partitionBy("image_id").orderBy("stage")) - 1)


def cap_queries(queries: DataFrame, n: int, key: str, positive: Column | None = None, seed: int = 42) -> DataFrame:
    """At most ``n`` queries per image in a seeded order, positives first if asked."""
    order = [*([F.desc(positive.cast("int"))] if positive is not None else []), seeded(seed, "image_id", key), F.col(key)]
    return queries.withColumn("r", F.row_number().over(Window.partitionBy("image_id").orderBy(*order))).where(F.col("r") <= n).drop("r")


def sample_stages(frames: DataFrame, n: int, stride: int, seed: int = 42) -> DataFrame:
    """``n`` frames of each video at a stride, lowered to floor((T - 1) / (n - 1)) if it doesn't fit, from a seeded start."""
    ranked = frames.select("video_id", "frame").distinct().withColumn("t", F.row_number().over(Window.partitionBy("video_id").orderBy("frame")) - 1)
    sizes = ranked.groupBy("video_id").agg(F.count("*").alias("size"))
    fit = F.floor((F.col("size") - 1) / max(n - 1, 1))
    step = F.greatest(F.lit(1), F.least(F.lit(stride), fit))
    room = F.greatest(F.col("size") - (n - 1) * step, F.lit(1))
    plan = sizes.select("video_id", step.alias("step"), F.pmod(F.xxhash64(F.lit(seed), "video_id"), room).alias("start"))
    kept = ranked.join(plan, "video_id").where((F.col("t") >= F.col("start")) & ((F.col("t") - F.col("start")) % F.col("step") == 0))
    return kept.withColumn("stage", ((F.col("t") - F.col("start")) / F.col("step")).cast("long")).where(F.col("stage") < n).select("video_id", "frame", "stage")


def uniform_sample(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """``n`` evenly spaced rows of each group: positions round(i (N - 1) / (n - 1)), halves to even."""
    ranked = df.withColumn("t", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).withColumn("size", F.count("*").over(Window.partitionBy(group)))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("size") - 1) / (n - 1)).cast("long"))
    return ranked.where((F.col("size") <= n) | F.array_contains(wanted, F.col("t").cast("long"))).drop("t", "size")


def class_counts(labels: DataFrame, label: str, n: int) -> DataFrame:
    """Rows per class 0..n-1, with zeros."""
    return labels.sparkSession.range(n).withColumnRenamed("id", label).join(labels.groupBy(label).agg(F.count("*").alias("count")), label, "left").withColumn("count", F.coalesce("count", F.lit(0)))


def tile_image(objects: DataFrame, n: int) -> DataFrame:
    """One image's objects repeated over ``n`` frames."""
    return objects.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
