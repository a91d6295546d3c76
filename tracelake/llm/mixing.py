"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document's expected copies are proportional to its importance (by default it grows with size, so
short texts are taken less often), up to max_copies: from the greatest importance down, documents are fixed at max_copies until the rate that the
rest of the target leaves for the others puts none of them above it. The whole part is allocated for certain, the fractional part is
its inclusion probability pi. Documents are ranked by Pareto's statistic, the random odds u / (1 - u) over the
inclusion odds pi / (1 - pi), and the ranking is taken up to the size that fills the rest of the target: a
fixed-size sample with unequal probabilities, within half a text of the target.

Defined results: null text or text without words has size 0 and takes 0 words; null sources are a source of their
own, after all others; an empty table gives an empty result; repeated rows (equal doc_id and text) count as often as they occur, and are taken together
or not at all. Ranks depend on doc_id, the text and the seed alone, so reruns and any partitioning agree, and rows without doc_id are ranked each by its text.
Documents of importance 0 are never taken; a source's target counts its others twice at most. Columns of the input beside doc_id, source and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, small, table, ws_words

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_COPIES = 2
SEED = "mix-1"
#: Words at which a document has half of the greatest importance.
HALF_SIZE = 100
#: Importance is a whole number up to this; what is given above it counts as it.
MAX_IMPORTANCE = 1_000
#: A rank's place has so many digits of so many bits; the cut is found digit by digit.
PLACE_BITS, PLACE_LEVELS = 8, 3


def targets(by_source: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size -> with target: min(max_copies * source_size, level * weight), the level sharing all.

    Sources are few beside documents, and come here as one row each.
    """
    ranked = by_source.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_w", F.element_at(cycle, (F.col("_k") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", max_copies * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", "_k")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    share = F.sum("source_size").over(everything) * F.lit(share_percent) / F.lit(100.0)
    level = (share - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(onward)
    ranked = ranked.withColumn("_level", level).withColumn("_free", F.col("_ratio") > F.col("_level"))
    common = F.max(F.when(F.col("_free"), F.col("_level"))).over(everything)
    target = F.when(F.col("_free"), F.col("_w") * common).otherwise(F.col("_cap").cast("double"))
    return ranked.withColumn("target", target).select("source", "source_size", "target")


def filled(levels: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """_source, target and, by importance _imp, the words _n -> each source's _bar and _rate: documents of importance above the bar get max_copies, others _rate x importance.

    There are at most MAX_IMPORTANCE levels of a source. Where the target asks for all, the bar is 0.
    """
    order = Window.partitionBy("_source").orderBy(F.col("_imp").desc())
    above = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    mass = F.sum((F.col("_n") * F.col("_imp")).cast("decimal(38,0)")).over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    levels = levels.where("_imp > 0").withColumn("_r", (F.col("target") - max_copies * above) / mass)
    # The greatest importance that its own rate does not put above max_copies.
    fits = F.when(F.col("_r") * F.col("_imp") < max_copies, F.struct(F.col("_imp").alias("_bar"), F.col("_r").alias("_rate")))
    best = levels.groupBy("_source").agg(F.max(fits).alias("_best"))
    return best.select(F.col("_source").alias("_fs"), F.coalesce("_best._bar", F.lit(0)).alias("_bar"), F.coalesce("_best._rate", F.lit(0.0)).alias("_rate"))


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the first 52 bits of md5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def by_size(size: Column) -> Column:
    """Importance of a document, 0 to 999: short ones count less, as their share of HALF_SIZE words more."""
    return F.floor(size * 1000 / (size + HALF_SIZE)).cast("bigint")


class Plan:
    """How many copies of each document a mix takes: a few numbers for each source, found in passes over doc_id, source and size.

    importance (whole numbers, 0 to MAX_IMPORTANCE) scales a document's expected copies within its source, so inclusion probabilities differ by document.
    """

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, max_copies: int = MAX_COPIES, seed: str = SEED, importance: Column | None = None):
        self.max_copies, self.seed, self.importance = max_copies, seed, importance
        self.sized = materialize(self.measured(docs.select("*")).select(*COLUMNS), "mix-sizes")
        levels = materialize(self.sized.groupBy("_source", "_imp").agg(F.sum("_size").alias("_n")), "mix-levels")
        by_source = levels.groupBy(F.col("_source").alias("source")).agg(F.sum("_n").alias("source_size"))
        goal = targets(by_source, weights, share_percent, max_copies)
        rates = filled(levels.join(goal.select("source", "target"), F.col("source").eqNullSafe(F.col("_source"))), max_copies)
        goal = goal.join(rates, F.col("source").eqNullSafe(F.col("_fs")), "left").drop("_fs").na.fill({"_bar": 0, "_rate": 0.0})
        self.goal = materialize(goal.withColumnRenamed("source", "_s"), "mix-targets")
        drop_scratch(levels)
        self.cuts = materialize(self._cuts(), "mix-cuts")

    def measured(self, docs: DataFrame) -> DataFrame:
        """docs with what a plan needs, under names of its own."""
        docs = docs.withColumns({"_id": F.col("doc_id"), "_source": F.col("source"), "_size": F.size(ws_words(F.col("text"))).cast("bigint")})
        imp = by_size(F.col("_size")) if self.importance is None else F.least(F.greatest(F.coalesce(self.importance.cast("bigint"), F.lit(0)), F.lit(0)), F.lit(MAX_IMPORTANCE))
        return docs.withColumns({"_imp": imp, "_u": uniform(F.col("doc_id"), F.col("text"), self.seed)})

    def ranked(self, df: DataFrame) -> DataFrame:
        """df with its source's numbers, its whole copies, its rank _q (null: no further copy) and the rank's place _p."""
        df = df.join(small(self.goal), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
        expected = F.when(F.col("_imp") > F.col("_bar"), F.lit(float(self.max_copies))).otherwise(F.col("_rate") * F.col("_imp"))
        df = df.withColumn("_expected", expected).withColumn("_whole", F.floor("_expected")).withColumn("_pi", F.col("_expected") - F.col("_whole"))
        u = F.col("_u")
        odds = F.when(F.col("_pi") > 0, (u / (1.0 - u)) / (F.col("_pi") / (1.0 - F.col("_pi"))))
        df = df.withColumn("_q", F.when(F.col("_whole") >= self.max_copies, F.lit(None).cast("double")).otherwise(F.coalesce(odds, F.lit(float("inf")))))
        place = F.when(F.col("_q") == float("inf"), F.lit(1.0)).otherwise(F.col("_q") / (1.0 + F.col("_q")))
        last = (1 << PLACE_BITS * PLACE_LEVELS) - 1
        return df.withColumn("_p", F.least(F.floor(place * float(last + 1)), F.lit(last)).cast("bigint"))

    def _cuts(self) -> DataFrame:
        """Of each source: the size that is left to take, all that can be ranked, the place that the cut falls into, and the last rank below it.

        The place is found digit by digit, so what is put in order at the end is one of 2**24 parts of a source, however large that is.
        """
        ranked = self.ranked(self.sized)
        sure = F.sum(F.col("_whole") * F.col("_size"))
        rests = ranked.groupBy(F.col("_source").alias("_cs")).agg((F.first("target") - sure).alias("_rest"), F.coalesce(F.sum(F.when(F.col("_q").isNotNull(), F.col("_size"))), F.lit(0)).alias("_all"))
        cuts = materialize(rests.withColumns({"_cp": F.lit(0).cast("bigint"), "_cbegin": F.lit(0).cast("bigint")}), "mix-rests")
        for level in range(PLACE_LEVELS):
            rest = PLACE_BITS * (PLACE_LEVELS - 1 - level)
            # Cuts of sources whose digits so far are known; none is left where nothing holds the cut.
            mine = ranked.join(small(cuts), F.col("_source").eqNullSafe(F.col("_cs"))).where(F.col("_q").isNotNull() & (F.shiftright("_p", rest + PLACE_BITS) == F.col("_cp")))
            parts = mine.groupBy("_cs", F.shiftright("_p", rest).alias("_digit")).agg(F.sum("_size").alias("_n"), F.first("_rest").alias("_rest"), F.first("_cbegin").alias("_from"))
            parts = parts.withColumn("_end", F.col("_from") + F.sum("_n").over(Window.partitionBy("_cs").orderBy("_digit"))).withColumn("_begin", F.col("_end") - F.col("_n"))
            held = parts.where((F.col("_begin") < F.col("_rest")) & (F.col("_end") >= F.col("_rest"))).select(F.col("_cs").alias("_hs"), F.col("_digit"), F.col("_begin"))
            before, joined = cuts, cuts.join(held, F.col("_cs").eqNullSafe(F.col("_hs")), "left")
            cuts = materialize(joined.select("_cs", "_rest", "_all", F.col("_digit").alias("_cp"), F.col("_begin").alias("_cbegin")), "mix-cut")
            drop_scratch(before)
        edge = ranked.join(small(cuts), F.col("_source").eqNullSafe(F.col("_cs"))).where((F.col("_p") == F.col("_cp")) & F.col("_q").isNotNull())
        # Repeated rows have one rank, and go in together.
        edge = edge.groupBy("_source", "_q", "_id", "_size").agg(F.sum("_size").alias("_n"), F.first("_cbegin").alias("_cbegin"), F.first("_rest").alias("_rest"))
        in_order = Window.partitionBy("_source").orderBy("_q", "_id", "_size")
        edge = edge.withColumn("_mid", F.col("_cbegin") + F.sum("_n").over(in_order) - F.col("_size") / 2.0)
        last = edge.where(F.col("_mid") <= F.col("_rest")).groupBy(F.col("_source").alias("_ls")).agg(F.max(F.struct("_q", "_id", "_size")).alias("_last"))
        return cuts.join(last, F.col("_cs").eqNullSafe(F.col("_ls")), "left").drop("_ls")

    def copies(self, df: DataFrame) -> DataFrame:
        """df (from measured) with source_size, target and copies."""
        df = self.ranked(df).join(small(self.cuts), F.col("_source").eqNullSafe(F.col("_cs")))
        within = (F.col("_p") < F.col("_cp")) | ((F.col("_p") == F.col("_cp")) & F.coalesce(F.struct("_q", "_id", "_size") <= F.col("_last"), F.lit(False)))
        # Without a place that holds the cut, nothing is left to take or more than can be ranked.
        taken = F.when(F.col("_cp").isNotNull(), within).otherwise((F.col("_rest") > 0) & (F.col("_all") <= F.col("_rest")))
        more = F.when(F.col("_q").isNotNull() & F.coalesce(taken, F.lit(False)), 1).otherwise(0)
        return df.withColumn("copies", (F.col("_whole") + more).cast("bigint"))


COLUMNS = ("_id", "_source", "_size", "_imp", "_u")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs."""
    plan = Plan(docs.select("doc_id", "source", "text"), **options)
    out = plan.copies(plan.sized)
    return out.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    plan = Plan(docs.select("doc_id", "source", "text"), **options)
    # The whole row travels in one column, so no name can clash.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", "text")
    out = plan.copies(plan.measured(held)).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op2_mixing": op2_mixing}

ORACLES = {
    "op2_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, size, floor(size * 1000 / (size + 100)::DOUBLE)::BIGINT AS imp,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents)),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(k % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM per),
ratios AS (SELECT *, cap / w AS ratio FROM weighed),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 150 / 100.0::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(w) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ratios),
goal AS (
  SELECT source, source_size, CASE WHEN ratio > level THEN w * (max(CASE WHEN ratio > level THEN level END) OVER ()) ELSE cap::DOUBLE END AS target FROM levels),
steps AS (SELECT source, imp, sum(size)::BIGINT AS n FROM sized WHERE imp > 0 GROUP BY ALL),
rates AS (
  SELECT s.source, s.imp, (target - 2 * coalesce(sum(n) OVER (PARTITION BY s.source ORDER BY imp DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(n * imp) OVER (PARTITION BY s.source ORDER BY imp DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS r FROM steps s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
bars AS (SELECT source, max(imp) AS bar, arg_max(r, imp) AS rate FROM rates WHERE r * imp < 2 GROUP BY source),
joined AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target, s.u, CASE WHEN s.imp > coalesce(b.bar, 0) THEN 2.0::DOUBLE ELSE coalesce(b.rate, 0.0::DOUBLE) * s.imp END AS rate
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN bars b ON s.source IS NOT DISTINCT FROM b.source),
ranked AS (
  SELECT *, floor(rate) AS whole,
    CASE WHEN floor(rate) >= 2 THEN NULL WHEN rate > floor(rate)
      THEN (u / (1.0::DOUBLE - u)) / ((rate - floor(rate)) / (1.0::DOUBLE - (rate - floor(rate)))) ELSE 'infinity'::DOUBLE END AS q FROM joined),
placed AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS rest,
    sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, size) - size / 2.0::DOUBLE AS mid FROM ranked)
SELECT doc_id, size, source_size, target,
  (CASE WHEN q IS NOT NULL AND mid <= rest THEN whole + 1 ELSE whole END * size)::BIGINT AS taken FROM placed
"""
}
