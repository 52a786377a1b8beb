"""Mixing sources to target weights by Pareto order sampling (native).

Each source has a target number of words (see :func:`source_targets`). A
document takes ``floor(target / source size)`` certain whole copies; what is
left of the target is filled by an order sample with unequal probabilities, in
proportion to the documents' words: a document of s words has the inclusion
probability ``l = min(1, rate * s)``, and the source's rate is such that the
words expected are those left (:func:`inclusion_rates`). It gets the rank
``q = odds(u) / odds(l)`` from its own random number ``u``, and the documents
of the smallest ranks are taken until their words come nearest to what is
left. ``u`` is a hash of doc_id and the seed, so reruns agree wherever and in
whatever order rows are read.

Scale: the running sum of words by rank is not one sort per source. Ranks are
cut into buckets of equal width; words by (source, bucket) are pre-aggregated
on the map side, the running sum over buckets finds the one bucket per source
that holds the cut, and only its documents are sorted. A hot source thus costs
no more per task than any other. Rates come from counts by (source, size),
combined on the map side: a row for each length that a source's texts have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, partitions, table

#: Weights of the sources in code point order, repeating; the share
#: of all words that the mix takes; the most copies of one document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Documents that the bucket of a cut holds on average, and the most rows of a broadcast table of sources.
ROWS_PER_BUCKET = 20_000
BROADCAST_SOURCES = 100_000
#: The rank of a document that has no chance.
NEVER = 1e6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Targets are in proportion to weights, sum to ``share`` of all sizes and stop
    at ``most`` times the source's size; what is above is shared again by weight
    until none is above. Closed form: in the order of cap / weight, a source is
    capped if its cap is at most its weight times the level of what is left.
    The table has a row for each source, so one task orders it.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((n - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    every = Window.partitionBy()
    t = t.withColumn("words", F.lit(share) * F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("capped", F.col("cap") <= F.col("weight") * (left / left_weight))
    spent = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    spent_weight = F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0.0)).over(every)
    level = F.try_divide(F.col("words") - spent, F.col("all_weight") - spent_weight)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level)
    return t.select("source", "source_size", target.alias("target"))


def random_number(doc_id: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of a hash."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def inclusion_rates(slim: DataFrame, info: DataFrame) -> DataFrame:
    """(rate_of, rate): of each source with words left, the rate at which ``min(1, rate * size)``,
    times size and summed over its documents, gives the words left.

    The longest documents may be certain; the rest share what those leave. Of
    the sizes in descending order, the first that stays below 1 tells how many
    are certain. Sums of squares are decimals, so exact in any order.
    """
    by_size = slim.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    rows = by_size.join(info.filter("left > 0").select("of", "left"), F.col("source").eqNullSafe(F.col("of")))
    words, squares = F.col("n") * F.col("size"), (F.col("n") * F.col("size")).cast("decimal(19,0)") * F.col("size").cast("decimal(18,0)")
    longer = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("squares", squares.cast("decimal(28,0)"))
    rows = rows.withColumn("above", F.coalesce(F.sum(words).over(longer), F.lit(0)))
    rest = F.sum("squares").over(Window.partitionBy("source")) - F.coalesce(F.sum("squares").over(longer), F.lit(0).cast("decimal(28,0)"))
    rows = rows.withColumn("rate", (F.col("left") - F.col("above").cast("double")) / rest.cast("double"))
    return rows.filter(F.col("rate") * F.col("size") <= 1).groupBy(F.col("source").alias("rate_of")).agg(F.max_by("rate", "size").alias("rate"))


def mix(docs: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (0 to ``most``) of every row of ``docs``.

    Needs doc_id, source and text; other columns, whatever their names, are not
    read, but those of ``carry`` come along as the struct ``row``, without a join. Null and empty
    text has size 0; null is a source of its own, after all others. Rows that
    repeat a doc_id share its random number; equal ranks are ordered by doc_id
    and size. Documents without words are never taken beyond the certain
    copies. A document longer than what is left of its source's target is
    taken if its words come nearer to it than none. An empty table gives no rows.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []))
    slim = scratch.save(sized.drop("row"))
    by_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sizes = scratch.save(by_source.coalesce(-(-partitions(slim.sparkSession) // 32)))
    n_sources, n_rows = sizes.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda df: df)
    buckets = max(256, n_rows // ROWS_PER_BUCKET)
    parts = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    targets = (
        source_targets(sizes.drop("rows"), weights, share, most)
        .withColumn("base", F.floor(parts))
        .withColumn("left", F.col("target") - (F.col("base") * F.col("source_size")).cast("double"))
        .select(F.col("source").alias("of"), "source_size", "target", "base", "left")
    )
    targets = scratch.save(targets, n_sources)
    rates = inclusion_rates(slim, small(targets))
    info = scratch.save(targets.join(small(rates), F.col("of").eqNullSafe(F.col("rate_of")), "left").drop("rate_of"), n_sources)

    def ranked(rows: DataFrame) -> DataFrame:
        u = random_number(F.col("doc_id"), seed)
        chance = F.when(F.col("size") > 0, F.least(F.lit(1.0), F.coalesce(F.col("rate") * F.col("size"), F.lit(1.0)))).otherwise(0.0)
        return (
            rows.join(small(info), F.col("source").eqNullSafe(F.col("of")))
            .withColumn("u", u)
            .withColumn("chance", chance)
            .withColumn("q", F.coalesce(F.try_divide(F.col("u") * (F.lit(1.0) - F.col("chance")), (F.lit(1.0) - F.col("u")) * F.col("chance")), F.lit(NEVER)))
            .withColumn("bucket", F.least(F.floor(F.col("q") * buckets), F.lit(4 * buckets)))
        )

    words = ranked(slim).filter("left > 0").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        words.withColumn("after", F.sum("words").over(upto))
        .filter(F.col("after") > F.col("left"))
        .groupBy("source")
        .agg(F.min(F.struct("bucket", (F.col("after") - F.col("words")).alias("before"))).alias("cut"))
        .select(F.col("source").alias("cut_of"), F.col("cut.bucket").alias("cut"), F.col("cut.before").alias("before"))
    )
    cut = scratch.save(cut, n_sources)
    placed = ranked(sized if carry else slim).join(small(cut), F.col("source").eqNullSafe(F.col("cut_of")), "left")
    out = ["doc_id", "source", "size", "source_size", "target", *(["row"] if carry else [])]
    # Without a cut every document of the source fits into what is left.
    inside = F.when((F.col("left") <= 0) | (F.col("size") == 0), 0).when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), 1).otherwise(0)
    at_cut = (F.col("left") > 0) & (F.col("size") > 0) & (F.col("bucket") == F.col("cut"))
    clear = placed.filter(~F.coalesce(at_cut, F.lit(False))).select(*out, (F.col("base") + inside).alias("copies"))
    by_rank = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto_doc = F.col("before") + F.sum("size").over(by_rank)
    near = placed.filter(at_cut).withColumn("upto", upto_doc)
    near = near.select(*out, (F.col("base") + F.when(2 * F.col("upto") - F.col("size") <= 2 * F.col("left"), 1).otherwise(0)).alias("copies"))
    return clear.unionByName(near)


def mixed(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it; columns stay. Rows are repeated as they pass, without a join."""
    rows = mix(docs, scratch, carry=tuple(docs.columns), **how).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, Scratch(spark, "op8")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


#: The documents that a pipeline stage of this operator gives, from any table ``docs`` of SQL.
MIX_SQL = r"""
sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
    1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS words FROM sums),
levels AS (
  SELECT *, sum(weight) OVER () AS all_weight,
    (words - coalesce(sum(cap) OVER o, 0.0::DOUBLE)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER o, 0.0::DOUBLE)) AS fair
  FROM weighted WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap <= weight * fair AS is_capped FROM levels),
rest AS (
  SELECT *, words - sum(CASE WHEN is_capped THEN cap ELSE 0.0::DOUBLE END) OVER () AS left_words,
    all_weight - sum(CASE WHEN is_capped THEN weight ELSE 0.0::DOUBLE END) OVER () AS left_weight FROM capped),
targets AS (
  SELECT source, source_size,
    CASE WHEN is_capped THEN cap ELSE weight * (left_words / left_weight) END AS target FROM rest),
parts AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size::DOUBLE END AS part FROM targets),
plan AS (
  SELECT *, floor(part)::BIGINT AS base, target - (floor(part)::BIGINT * source_size)::DOUBLE AS left_over FROM parts),
by_size AS (
  SELECT s.source, s.size, p.left_over, count(*)::HUGEINT * s.size AS words, count(*)::HUGEINT * s.size * s.size AS squares
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source WHERE s.size > 0 AND p.left_over > 0 GROUP BY s.source, s.size, p.left_over),
shares AS (
  SELECT source, size, (left_over - coalesce(sum(words) OVER longer, 0)::DOUBLE)
    / ((sum(squares) OVER (PARTITION BY source)) - coalesce(sum(squares) OVER longer, 0))::DOUBLE AS rate
  FROM by_size WINDOW longer AS (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rates AS (SELECT source, arg_max(rate, size) AS rate FROM shares WHERE rate * size <= 1 GROUP BY source),
chances AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.base, p.left_over,
    (('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
    CASE WHEN s.size > 0 THEN least(1.0::DOUBLE, coalesce(r.rate * s.size, 1.0::DOUBLE)) ELSE 0.0::DOUBLE END AS chance
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
ranked AS (
  SELECT *, CASE WHEN chance > 0 THEN (u * (1.0::DOUBLE - chance)) / ((1.0::DOUBLE - u) * chance) ELSE 1e6::DOUBLE END AS q FROM chances),
running AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked),
mixed AS (
  SELECT doc_id, source, size, source_size, target,
    base + CASE WHEN left_over > 0 AND size > 0 AND 2 * upto - size <= 2 * left_over THEN 1 ELSE 0 END AS copies FROM running)
"""

ORACLE = "WITH " + MIX_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM mixed"
