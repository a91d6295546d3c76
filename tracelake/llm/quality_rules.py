"""Quality rules with host-level verdicts.

Every document gets counts, failures of five rules, and a base verdict from its own text. Each rule's failures are summed by domain, its rates shrunk
with a beta prior fitted to all hosts by moments, and a host of which one shrunk rate passes the limit loses all its documents; verdicts
join back to the documents. The domain is the source column, as documents have no address of their own.

Counts stay inside the row (higher-order functions over its words), so no text is shuffled and a very long text
costs its own task only in proportion to n log n. Hosts are pre-aggregated; their table is broadcast only below a counted size.

Defined results: null and blank texts have no words and fail; a null source is a host of its own; an empty table
gives an empty result; repeated rows are judged each. Only doc_id, source and text are read, so other columns may
have any name. Only DataFrame operations run on the main path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, materialize, release, small, table, ws_words

MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
#: Repeated lines a hundred words.
MAX_LINE_PERCENT = 5
#: Least and greatest mean length of words.
WORD_LENGTH = (3, 12)
HOST_LIMIT = 0.5


def repeated_words(words: Column, windows: Column) -> Column:
    """Words in windows found twice or more; windows: the hash of each window, in order. Windows of equal hash are compared word by word."""
    n = F.size(windows)
    ranked = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def equal(e: Column, o: Column) -> Column:
        return (o["w"] == e["w"]) & (F.slice(words, o["i"] + 1, WINDOW) == F.slice(words, e["i"] + 1, WINDOW))

    def covered(s: Column) -> Column:
        twice = F.transform(s, lambda e, k: F.when(equal(e, F.get(s, k - 1)) | equal(e, F.get(s, k + 1)), e["i"]))
        return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

    def words_of(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    # A one-element array carries each step's value into the next, so it is made once.
    steps = F.transform(F.transform(F.array(ranked), covered), words_of)
    return F.when(F.size(F.array_distinct(windows)) == n, F.lit(0)).otherwise(F.get(steps, F.lit(0)))


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The kept columns with n_words, the four counts and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, whole.alias("_text"), ws_words(F.col(text)).alias("_words"))
    starts = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(0), F.size("_words") - WINDOW))
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    windows = F.get(F.transform(F.array(hashes), lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))), F.lit(0))
    windows = F.coalesce(windows, F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.select(*keep, "_text", "_words", windows.alias("_windows"), lines.alias("_lines"))
    n_words = F.size("_words").cast("bigint")
    n_repeat = repeated_words(F.col("_words"), F.col("_windows")).cast("bigint")
    rows = rows.select(
        *keep, n_words.alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("bigint"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", RULES["few_words"]() | RULES["repeated_words"]())


#: A document's failures. The first two are its base verdict; by host all count.
RULES = {
    "few_words": lambda: F.col("n_words") < MIN_WORDS,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
    "symbols": lambda: 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"),
    "repeated_lines": lambda: 100 * F.col("n_dup_lines") > MAX_LINE_PERCENT * F.col("n_words"),
    "word_length": lambda: (F.col("word_chars") < WORD_LENGTH[0] * F.col("n_words")) | (F.col("word_chars") > WORD_LENGTH[1] * F.col("n_words")),
}


def failures(keep: tuple[str, ...]) -> list[Column]:
    """The kept columns and each rule's failure as 0 or 1."""
    return [*[F.col(c) for c in keep], *[rule().cast("bigint").alias(f"_f_{name}") for name, rule in RULES.items()]]


def host_verdicts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """_host, _docs, _failed_RULE, _rate_RULE and _rejected from rows with source and the failures of every rule.

    A rule's prior is fitted to all hosts, each with its weight in documents (moments of the beta-binomial): m is the share of failing documents,
    rho what hosts differ beyond chance, and the prior counts as (1 - rho) / rho documents. Where hosts do not differ, every rate is m.
    """
    hosts = judged.groupBy(F.col("source").alias("_host")).agg(F.count("*").alias("_docs"), *[F.sum(f"_f_{name}").alias(f"_failed_{name}") for name in RULES])
    hosts = materialize(hosts, "hosts")
    n = F.col("_docs").cast("double")
    sums = [F.sum(F.col(f"_failed_{name}")).alias(f"f_{name}") for name in RULES] + [F.sum(F.col(f"_failed_{name}") * F.col(f"_failed_{name}") / n).alias(f"s_{name}") for name in RULES]
    # One row of moments: a bound by construction.
    row = hosts.agg(F.count("*").alias("h"), F.sum("_docs").alias("n"), F.sum(n * n).alias("nn"), *sums).first()
    rates = {}
    for name in RULES:
        m, weight = _prior(row["h"], row["n"] or 0, row["nn"] or 0.0, row[f"f_{name}"] or 0, row[f"s_{name}"] or 0.0)
        rates[f"_rate_{name}"] = F.lit(m) if weight is None else (F.col(f"_failed_{name}") + m * weight) / (F.col("_docs") + weight)
    return hosts.withColumns(rates).withColumn("_rejected", F.greatest(*[F.col(c) for c in rates]) > limit)


def _prior(hosts: int, docs: int, squares: float, failed: int, spread: float) -> tuple[float, float | None]:
    """A rule's mean and its prior's weight in documents; None: hosts do not differ beyond chance."""
    if not docs or not 0 < failed < docs:
        return (failed / docs if docs else 0.0), None
    m = failed / docs
    room = docs - squares / docs - (hosts - 1)
    rho = ((spread - docs * m * m) / (m * (1 - m)) - (hosts - 1)) / room if room > 0 else 0.0
    return m, ((1 - rho) / rho if 0 < rho < 1 else None if rho <= 0 else 0.0)


def judge(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """doc_id, the counts, base_failed, host_rate and kept for every row."""
    rows = materialize(measured(docs), "quality")
    hosts = host_verdicts(rows.select(*failures(("source",))), limit).select("_host", "_rejected", F.greatest(*[F.col(f"_rate_{name}") for name in RULES]).alias("_rate"))
    rows = rows.join(small(hosts), F.col("source").eqNullSafe(F.col("_host")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("_rejected")).alias("kept"),
    )


def keep_good(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    The texts are measured once; verdicts come back by doc_id and the text's hash.
    """
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    held = docs.select("doc_id", "source", "text", tag.alias("_tag"))
    judged = materialize(measured(held, keep=("doc_id", "source", "_tag")).select("base_failed", *failures(("doc_id", "source", "_tag"))), "quality")
    hosts = host_verdicts(judged, limit).where("_rejected").select("_host")
    failed = judged.where("base_failed").select(F.struct(F.col("doc_id").alias("id"), F.col("_tag").alias("tag")).alias("_failed")).distinct()
    kept = hold(docs).join(small(hosts), F.col("_row").getField("source").eqNullSafe(F.col("_host")), "left_anti")
    return release(kept.join(small(failed), F.col("_key").eqNullSafe(F.col("_failed")), "left_anti"), docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op6_quality_rules": op6_quality_rules}

#: From a relation docs_in(rid, doc_id, source, text): judged(rid, ..., kept). The pipeline's SQL uses it too.
JUDGED_SQL = r"""
split_words AS (
  SELECT rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM docs_in),
five AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM split_words)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM five) WHERE n > 1),
spread AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS n FROM twice),
rep AS (SELECT rid, sum(n)::BIGINT AS n_repeat_words FROM spread GROUP BY rid),
lined AS (
  SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM split_words),
counted AS (
  SELECT s.rid, s.doc_id, s.source, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l.lines) - len(list_distinct(l.lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM split_words s JOIN lined l USING (rid) LEFT JOIN rep USING (rid)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
failing AS (
  SELECT source, unnest([(n_words < 10)::INT, (100 * n_repeat_words > 20 * n_words)::INT, (100 * n_symbols > 10 * word_chars)::INT,
    (100 * n_dup_lines > 5 * n_words)::INT, (word_chars < 3 * n_words OR word_chars > 12 * n_words)::INT]) AS failed, unnest(range(5)) AS rule FROM based),
hosts AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(failed)::DOUBLE AS f FROM failing GROUP BY source, rule),
moments AS (
  SELECT rule, count(*) AS h, sum(n) AS n, sum(n * n) AS nn, sum(f) / sum(n) AS m, sum(f * f / n) - sum(n) * (sum(f) / sum(n)) * (sum(f) / sum(n)) AS s FROM hosts GROUP BY rule),
rhos AS (
  SELECT rule, m, CASE WHEN m > 0 AND m < 1 AND n - nn / n - (h - 1) > 0 THEN (s / (m * (1 - m)) - (h - 1)) / (n - nn / n - (h - 1)) ELSE 0 END AS rho FROM moments),
verdicts AS (
  SELECT source, max(CASE WHEN rho <= 0 THEN m WHEN rho >= 1 THEN f / n ELSE (f + m * (1 - rho) / rho) / (n + (1 - rho) / rho) END) > 0.5 AS rejected
  FROM hosts JOIN rhos USING (rule) GROUP BY source),
judged AS (
  SELECT b.*, NOT b.base_failed AND NOT v.rejected AS kept FROM based b JOIN verdicts v ON b.source IS NOT DISTINCT FROM v.source)
"""

ORACLES = {
    "op6_quality_rules": "WITH docs_in AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),"
    + JUDGED_SQL
    + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
}
