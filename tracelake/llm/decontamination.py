"""Benchmark decontamination by a distributed positional inverted index.

The index stores a posting (term, document, position) for every training token whose term the benchmark can ask for,
as segments sorted by term, and a header posting for each document. A phrase is looked up from its rarest term: the list of that term,
shifted by its offset in the phrase, is intersected with the shifted list of the second rarest, and what is left
with the lists of all the other terms. Windows that overlap share their terms' lists and their alignments.

Defined results: null and wordless texts have no words and no hits; an item without words has no window; repeated
documents and repeated doc_ids are judged row by row; items that repeat an item_id count once; an empty benchmark or
an empty table gives no hits or no rows. Other columns are not read. Only DataFrame operations run on the main path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hold, materialize, release, small, table

#: Words of the text before lower-casing: A-Z belong to words too.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: The term of header postings; no word is empty.
HEADER = 0


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lower_az(term: Column) -> Column:
    """Lower-case A-Z alone; lower() does the same, faster, where all is ASCII."""
    return F.when(F.octet_length(term) == F.char_length(term), F.lower(term)).otherwise(F.translate(term, UPPER, LOWER))


def vocabulary(texts: DataFrame) -> DataFrame:
    """term, tid from rows of words."""
    terms = texts.select(F.explode("words").alias("term")).distinct()
    return materialize(terms.select("term", (F.monotonically_increasing_id() + 1).alias("tid")), "terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings tid, rid, pos (from 1); a header has tid 0 and the document's doc_id, the hash of its text and n_words.

    rid numbers the rows. Each task writes one segment in term order; tokens of other terms are not stored, as no query of
    this vocabulary can reach them.
    """
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), words(F.col("text")).alias("_w"), F.monotonically_increasing_id().alias("rid"))
    tokens = rows.select("doc_id", "tag", "rid", F.size("_w").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), F.col("_w"))).alias("pos", "_t"))
    tokens = tokens.withColumn("term", lower_az(F.col("_t")))
    header = docs.sparkSession.createDataFrame([("", HEADER)], "term string, tid long")
    known = small(terms.select("term", "tid").unionByName(header))
    head = F.col("tid") == HEADER
    postings = tokens.join(known, "term").select(
        "tid", "rid", "pos", F.when(head, F.col("doc_id")).alias("doc_id"), F.when(head, F.col("tag")).alias("tag"), F.when(head, F.col("n_words")).alias("n_words"),
    )
    return materialize(postings.sortWithinPartitions("tid", "rid", "pos"), "postings")


def windows(items: DataFrame, terms: DataFrame, frequency: DataFrame, length: int = WINDOW) -> DataFrame:
    """Every window of the items with its two rarest terms: key, s, n, p1, t1, p2, t2 (positions in the item, from 0).

    A window that has a term without postings can occur nowhere and is left out.
    """
    tokens = items.select("key", F.size("words").alias("_n"), F.posexplode("words").alias("p", "term"))
    tokens = tokens.join(small(terms), "term").join(small(frequency), "tid")
    last = F.greatest(F.col("_n") - length, F.lit(0))
    starts = F.sequence(F.greatest(F.col("p") - (length - 1), F.lit(0)), F.least(F.col("p"), last))
    each = tokens.select("key", "_n", "p", "tid", "n_postings", F.explode(starts).alias("s"))
    span = F.least(F.lit(length), F.col("_n"))
    found = each.groupBy("key", "s", "_n").agg(F.count("*").alias("_have"), F.sort_array(F.collect_list(F.struct("n_postings", "p", "tid"))).alias("_r"))
    found = found.where(F.col("_have") == span)
    first, second = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    return found.select("key", "s", span.alias("n"), first["p"].alias("p1"), first["tid"].alias("t1"), F.coalesce(second["p"], first["p"]).alias("p2"), F.coalesce(second["tid"], first["tid"]).alias("t2"))


def frequencies(index: DataFrame) -> DataFrame:
    return materialize(index.where(F.col("tid") != HEADER).groupBy("tid").agg(F.count("*").alias("n_postings")), "frequency")


def phrase_matches(index: DataFrame, items: DataFrame, terms: DataFrame, length: int = WINDOW) -> DataFrame:
    """rid, key, first, last: the runs of words of document rid that occurrences of item windows cover, one run a line-up."""
    wins = materialize(windows(items, terms, frequencies(index), length), "windows")
    lists = index.where(F.col("tid") != HEADER).select("tid", "rid", "pos")

    rarest = small(wins.select("key", "p1", "p2", "t1", "t2").distinct())
    at = lists.join(rarest, F.col("tid") == F.col("t1")).select("rid", "key", "p1", "p2", "t2", (F.col("pos") - F.col("p1")).alias("shift"))
    second = lists.join(small(wins.select(F.col("t2").alias("tid")).distinct()), "tid", "left_semi")
    second = second.select(F.col("rid").alias("_r"), F.col("tid").alias("_t"), F.col("pos").alias("_p"))
    both = at.join(second, (F.col("rid") == F.col("_r")) & (F.col("t2") == F.col("_t")) & (F.col("shift") + F.col("p2") == F.col("_p")), "left_semi")
    both = materialize(both.select("rid", "key", "p1", "p2", "shift"), "aligned")

    # All the other terms of the windows that are left, each once for a line-up.
    spans = small(wins.select("key", "p1", "p2", "s", "n"))
    open_ = both.join(spans, ["key", "p1", "p2"]).groupBy("rid", "key", "shift").agg(F.collect_set(F.struct("s", "n")).alias("_w"))
    asked = F.array_distinct(F.flatten(F.transform("_w", lambda w: F.sequence(w["s"], w["s"] + w["n"] - 1))))
    open_ = open_.select("rid", "key", "shift", F.explode(asked).alias("p"))
    tokens = small(items.select("key", F.posexplode("words").alias("p", "term")).join(small(terms), "term").select("key", "p", "tid"))
    open_ = open_.join(tokens, ["key", "p"]).withColumn("pos", F.col("shift") + F.col("p"))
    documents = small(both.select("rid").distinct())
    near = lists.join(documents, "rid", "left_semi")
    matched = open_.join(near, ["rid", "tid", "pos"], "left_semi")

    # Islands of matched words; those as long as a window are made of occurrences.
    line = Window.partitionBy("rid", "key", "shift").orderBy("p")
    runs = matched.withColumn("_g", F.col("p") - F.row_number().over(line))
    runs = runs.groupBy("rid", "key", "shift", "_g").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    sizes = small(items.select("key", F.least(F.lit(length), F.size("words")).alias("_need")))
    return runs.join(sizes, "key").where(F.col("last") - F.col("first") + 1 >= F.col("_need")).select("rid", "key", "first", "last")


def proximity_matches(index: DataFrame, items: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """rid, key, pos: postings of an item's rarest term with all the item's terms within slop words of it, in any order."""
    tokens = items.select("key", F.explode(F.array_distinct("words")).alias("term")).join(small(terms), "term")
    counts = tokens.join(small(frequencies(index)), "tid", "left")
    wanted = counts.groupBy("key").agg(F.min(F.struct(F.coalesce("n_postings", F.lit(0)).alias("n"), "tid")).alias("_x"), F.count("*").alias("_need"))
    rare = small(wanted.select("key", "_need", F.col("_x.tid").alias("_rare")))
    lists = index.where(F.col("tid") != HEADER).select("tid", "rid", "pos")
    seeds = lists.join(rare, F.col("tid") == F.col("_rare")).select("rid", "key", "_need", F.col("pos").alias("at"))
    # Postings near a seed lie in its bin of slop + 1 words or in a neighbour.
    width = slop + 1
    asked = seeds.join(small(tokens.select("key", "tid")), "key").withColumn("_b", F.floor(F.col("at") / width))
    asked = asked.withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
    near = lists.withColumn("_b", F.floor(F.col("pos") / width))
    met = asked.join(near, ["rid", "tid", "_b"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
    done = met.groupBy("rid", "key", "at", "_need").agg(F.count_distinct("tid").alias("_n")).where(F.col("_n") == F.col("_need"))
    return done.select("rid", "key", F.col("at").alias("pos"))


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the text's hash (tag) for every row of docs."""
    items = benchmark.select("item_id", F.transform(words(F.col("text")), lower_az).alias("words"))
    items = materialize(items.where(F.size("words") > 0).withColumn("key", F.monotonically_increasing_id()), "items")
    terms = vocabulary(items)
    index = build_index(docs, terms)
    found = materialize(phrase_matches(index, items, terms, length), "matches")
    hit = found.select("rid", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    named = found.select("rid", "key").distinct().join(small(items.select("key", F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"))), "key")
    named = named.groupBy("rid").agg(F.collect_set("item").alias("_items"))
    heads = index.where(F.col("tid") == HEADER).select("rid", "doc_id", "tag", "n_words")
    out = heads.join(hit, "rid", "left").join(named, "rid", "left")
    own = F.coalesce(F.array_sort("_items"), F.array().cast("array<string>"))
    return out.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(own).cast("bigint").alias("n_items"), F.sha2(F.array_join(own, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "tag",
    )


def clean(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """The rows of docs without any benchmark window."""
    bad = contamination(docs, benchmark, length).where("contaminated").select(F.struct(F.col("doc_id").alias("id"), "tag").alias("_bad")).distinct()
    bad = small(materialize(bad, "contaminated"))
    return release(hold(docs).join(bad, F.col("_key").eqNullSafe(F.col("_bad")), "left_anti"), docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tag")


QUERIES = {"op1_decontamination": op1_decontamination}

#: From docs_in(rid, doc_id, text) and benchmark: hits(rid, pos, item_id) and doc_tokens(rid, doc_id, words).
HITS_SQL = r"""
doc_tokens AS (
  SELECT rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM docs_in),
item_tokens AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(words[s:s + n - 1], ' ') AS w FROM (
    SELECT item_id, words, least(10, len(words)) AS n, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM item_tokens WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT rid, s, n, array_to_string(words[s:s + n - 1], ' ') AS w FROM (
    SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM doc_tokens, lengths)),
occurring AS (SELECT rid, s, n, item_id FROM doc_windows JOIN item_windows USING (n, w)),
hits AS (SELECT DISTINCT rid, unnest(range(s, s + n)) AS pos, item_id FROM occurring)
"""

ORACLES = {
    "op1_decontamination": "WITH docs_in AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),"
    + HITS_SQL
    + r""",
per AS (
  SELECT rid, count(DISTINCT pos) AS n_hit, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT item_id::VARCHAR)) AS own FROM hits GROUP BY rid)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(array_to_string(own, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_tokens d LEFT JOIN per USING (rid)
"""
}
