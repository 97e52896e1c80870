"""Threshold-scaled document fingerprints.

A fingerprint retains every shingle hash below a fixed fraction of the hash range. As the threshold is the same
for all documents, sketches of very unequal documents can be intersected, united and compared directly:
``|A n B| / |A|`` of two sketches estimates containment, ``|A n B| / |A u B|`` similarity, and a union of sketches is
the sketch of the union. A short text may retain nothing; the digest of the whole text, which a fingerprint carries
beside its sketch, then tells equal texts from others. All work is done by built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORDS = 5
#: Hashes are hex MD5 digests; those that sort before this are kept, an eighth of all.
BELOW = "2"
DIGITS = 12
#: Rows a bucket holds while there are fewer than ``MOST_STARTS`` buckets; beyond that, buckets grow instead, and the
#: broadcast table of their first rows does not (40 bytes each). Their cuts are found in two levels, the first of ``COARSE``.
BUCKET_ROWS, MOST_STARTS, COARSE = 2000, 1_000_000, 1000


def shingles(text: Column, k: int = WORDS) -> Column:
    """All k-word shingles of a text; one of fewer words is one shingle, a wordless one the empty shingle."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # the words travel as the accumulator's initial value, so that splitting is done once
    return F.aggregate(
        F.array(words),
        F.array().cast("array<string>"),
        lambda _, w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, F.lit(k)), " ")),
    )


def sketch(text: Column, k: int = WORDS, below: str = BELOW) -> Column:
    """Sorted distinct hashes of the shingles below the threshold; there may be none."""
    hashes = F.transform(shingles(text, k), lambda s: F.substring(F.md5(s.cast("binary")), 1, DIGITS))
    return F.array_sort(F.array_distinct(F.filter(hashes, lambda x: x < below)))


def whole(text: Column) -> Column:
    """The digest that a fingerprint carries beside its sketch."""
    return F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, DIGITS)


def share(common: Column, of: Column, same: Column | None) -> Column:
    """``common / of``; where nothing was retained, 1 for equal texts and 0 for others, or null if that isn't known."""
    return F.when(of > 0, common / of).otherwise(F.lit(None) if same is None else same.cast("double"))


def likeness(a: Column, b: Column, same: Column | None = None) -> Column:
    """Estimated Jaccard similarity of two sketches; ``same``: whether the whole texts are equal."""
    return share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), same)


def containment(a: Column, b: Column, same: Column | None = None) -> Column:
    """Estimated share of a's shingles that b has."""
    return share(F.size(F.array_intersect(a, b)), F.size(a), same)


def packed(hashes: Column, digest: Column) -> Column:
    """A fingerprint in print: the whole text's digest, then the retained hashes."""
    return F.concat(digest, F.array_join(hashes, ""))


def unpacked(fingerprint: Column) -> Column:
    """The retained hashes of a printed fingerprint."""
    n = (F.length(fingerprint) / DIGITS).cast("int") - 1
    at = F.slice(F.sequence(F.lit(0), n), 2, n)
    return F.transform(at, lambda i: F.substring(fingerprint, i * DIGITS + 1, F.lit(DIGITS)))


def merge_sketches(a: Column, b: Column) -> Column:
    """The sketch of both documents' shingles together."""
    return F.array_sort(F.array_union(a, b))


def bucketed(rows: DataFrame, order: str, fine: str, bucket_rows: int) -> DataFrame:
    """``rows`` with ``bucket``: numbers that rise with (order, fine), of about ``bucket_rows`` rows each.

    ``order`` is a whole number and ``fine`` an even hash. Approximate quantiles of ``order`` cut at most ``COARSE``
    ranges; a range is cut again by even steps of ``order``, and the rows of a value that fills quantiles of its own
    (it is the first of its range) by even steps of ``fine``.
    """
    n = rows.count()
    coarse = min(COARSE, max(1, n // bucket_rows))
    found = rows.agg(F.percentile_approx(order, [i / coarse for i in range(1, coarse)], 20 * coarse).alias("c")).first().c if coarse > 1 else []
    found = sorted(found or [])
    cuts = sorted(set(found))
    bounds = F.lit(cuts).cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))]).cast("array<int>")
    there = lambda place, step: (place + step <= len(cuts)) & (F.get(bounds, place + step - 1) <= F.col(order))
    # a binary search in the sorted cuts, in one expression: the planner repeats a chain of columns in each that uses it
    place = F.aggregate(steps, F.lit(0), lambda place, step: F.when(there(place, step), place + step).otherwise(place))
    rows = rows.withColumn("coarse", place)
    each, at, ranges = n / coarse, 0, []
    for c in range(len(cuts) + 1):
        low, high = (cuts[c - 1] if c else None), (cuts[c] if c < len(cuts) else None)
        firsts = max(1, round(found.count(low) * each / bucket_rows)) if c else 0
        others = max(1, round(each / bucket_rows)) if low is not None and high is not None else 1
        ranges.append((c, at, low if low is not None else 0, firsts, others, float(max(1, (high or 0) - (low or 0))) if others > 1 else 1.0))
        at += firsts + others
    table = rows.sparkSession.createDataFrame(ranges, "coarse int, at long, low long, firsts long, others long, width double")
    even = (F.col(fine).cast("double") + F.lit(float(1 << 63))) / F.lit(float(1 << 64))
    step_of = lambda share, steps: F.least(F.floor(share * steps), steps - 1)
    first = F.col("at") + step_of(even, F.col("firsts"))
    other = F.col("at") + F.col("firsts") + F.when(F.col("others") > 1, step_of((F.col(order).cast("double") - F.col("low").cast("double")) / F.col("width"), F.col("others"))).otherwise(F.lit(0))
    number = F.when((F.col("firsts") > 0) & (F.col(order) == F.col("low")), first).otherwise(other)
    return rows.join(F.broadcast(table), "coarse").withColumn("bucket", number.cast("long")).drop("coarse", "at", "low", "firsts", "others", "width")


def with_next(rows: DataFrame, key: str, tie: str, carried: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``next_<c>`` for each carried column: its value in the next row by key, after the last the first.

    Rows of one key follow each other by the hash of ``tie``, then ``tie`` itself; a null key comes first. Rows are
    put in buckets by range, and the first row of each bucket also goes, as a guard, to the bucket before it; only
    buckets are sorted, never the whole table.
    """
    kept = rows.columns
    bucket_rows = max(bucket_rows, -(-rows.count() // MOST_STARTS))
    ordered = rows.withColumn("order", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))).withColumn("fine", F.xxhash64(tie))
    placed = bucketed(ordered, "order", "fine", bucket_rows)
    starts = placed.groupBy("bucket").agg(F.min(F.struct("order", "fine")).alias("start"))
    by_bucket = Window.orderBy("bucket")  # of the buckets' first rows, at most MOST_STARTS and a few
    every = by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = starts.select(F.col("start.order").alias("order"), F.col("start.fine").alias("fine"), F.coalesce(F.lag("bucket").over(by_bucket), F.max("bucket").over(every)).alias("before"))
    both = placed.join(F.broadcast(starts), ["order", "fine"], "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guard"))
    guard = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guard"))
    spread = both.withColumn("place", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guard))))
    spread = spread.select(*kept, "order", "fine", F.col("place.bucket").alias("bucket"), F.col("place.guard").alias("guard"))
    w = Window.partitionBy("bucket").orderBy("guard", "order", "fine", tie)
    led = spread.select(*kept, "guard", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return led.where("guard = 0").drop("guard")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited form, with their likeness and containment, and that of the next document.

    The edited text has its last floor(n/2) code points replaced by as many (or all) of the first of the next
    document's. Cases: a null text is empty; a null id sorts first; rows repeating an id are ordered by a hash of the
    text, then the text; a single document is its own successor; extra columns are ignored; an empty table gives an
    empty result. A fingerprint is the text's digest and the retained hashes, sorted and joined, so equal texts have
    equal ones; where two texts retain nothing, they are alike (1) if equal, else not (0).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("own", packed(sketch(F.col("text")), whole(F.col("text"))))
    rows = with_next(rows, "id", "text", ["text", "own"])
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("id", chars.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    rows = rows.withColumn("changed", packed(sketch(F.col("edited")), whole(F.col("edited"))))
    both = {"edited": F.col("changed"), "next": F.col("next_own")}
    digest = lambda x: F.substring(x, 1, DIGITS)
    measured = {
        f"{name}_{other}": measure(unpacked(F.col("own")), unpacked(x), digest(F.col("own")) == digest(x))
        for name, measure in (("near", likeness), ("contained", containment))
        for other, x in both.items()
    }
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("own").alias("fingerprint"),
        F.col("changed").alias("edited_fingerprint"),
        *[column.alias(name) for name, column in measured.items()],
    )


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS nxt FROM d
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, text)
), e AS (
  SELECT row_number() OVER () AS r, doc_id, length(text) AS n, text, nxt,
    concat(left(text, CAST(length(text) - length(text) // 2 AS BIGINT)), left(nxt, CAST(length(text) // 2 AS BIGINT))) AS edited FROM o
), w AS (
  SELECT r, which, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws
  FROM (SELECT r, 0 AS which, text AS t FROM e UNION ALL SELECT r, 1, edited FROM e UNION ALL SELECT r, 2, nxt FROM e) u
), h AS (
  SELECT r, which, [md5(array_to_string(ws[i + 1:i + 5], ' '))[1:12] FOR i IN range(0, greatest(len(ws) - 5, 0) + 1)] AS h FROM w
), k AS (SELECT r, which, list_sort(list_distinct([x FOR x IN h IF x < '2'])) AS s FROM h),
m AS (
  SELECT e.doc_id, e.n, e.text, e.edited, e.nxt, a.s AS a, b.s AS b, c.s AS c, len(list_intersect(a.s, b.s)) AS ab, len(list_intersect(a.s, c.s)) AS ac
  FROM e JOIN k a ON a.r = e.r AND a.which = 0 JOIN k b ON b.r = e.r AND b.which = 1 JOIN k c ON c.r = e.r AND c.which = 2
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, concat(md5(text)[1:12], array_to_string(a, '')) AS fingerprint,
  concat(md5(edited)[1:12], array_to_string(b, '')) AS edited_fingerprint,
  CASE WHEN len(a) + len(b) > 0 THEN ab / (len(a) + len(b) - ab) ELSE CAST(text = edited AS DOUBLE) END AS near_edited,
  CASE WHEN len(a) + len(c) > 0 THEN ac / (len(a) + len(c) - ac) ELSE CAST(text = nxt AS DOUBLE) END AS near_next,
  CASE WHEN len(a) > 0 THEN ab / len(a) ELSE CAST(text = edited AS DOUBLE) END AS contained_edited,
  CASE WHEN len(a) > 0 THEN ac / len(a) ELSE CAST(text = nxt AS DOUBLE) END AS contained_next
FROM m
"""
