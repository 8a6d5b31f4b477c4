"""Benchmark decontamination by a distributed positional inverted index.

The index is dealt by document, as large search engines deal theirs: next to each training document stand its postings
(term and position) of all its terms, sorted by term, so a term's list is in one piece. It is built without a shuffle,
stored, and reused by later searches. A document with a third of all occurrences of a term is a row like others.

A search reads the index at most three times, whatever the number of test items:

1. how often each term of the items occurs;
2. the lists of the items' rarest terms. For each window of an item these are its rarest two; each posting is shifted by
   its term's offset in the item, and the two lists are intersected on the shifted position. The NEAR_TERMS rarest terms of
   each item that occur at all are read too, whatever its windows hold;
3. for the few documents and shifts that are left, the lists of the window's other terms, intersected alike.

A run of agreeing words as long as a window is an exact phrase match and covers all windows in it. Two different ones
of an item's rarest terms that agree on a document within SLOP positions are a proximity match.

What is shuffled is postings of rare terms and of the documents that are left, never the training text. Only DataFrame
functions are used. Test terms are broadcast while they are few, by their count, else joined by a shuffle; documents are
never collected.

Defined results: null text has no words; an item without words or with a null id has no window; an item shorter than a
window is one window; equal items count once for each id; repeated rows keep their number and get equal results; rows
with a null doc_id come back like others; without items nothing is hit; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgewatch.llm.common import discard, fresh, store

#: Words of a window.
WINDOW = 13
#: A document is contaminated when hit words times this are at least its words.
SHARE = 20
#: Rows up to which terms, offsets or documents may be broadcast (about 10 MB).
BROADCAST_ROWS = 200_000
#: Positions that terms of a proximity match may differ by.
SLOP = 8
#: Terms of an item that are looked for besides the rarest of each window.
NEAR_TERMS = 4
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text, with A-Z in lower case and other letters as they are."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _CAPITALS, _CAPITALS.lower())
    return F.array_remove(F.split(lower, _BETWEEN, -1), "")  # empty only before the first and after the last word


def build_index(documents: DataFrame) -> DataFrame:
    """Per document: ref (a number of its own), doc_id, text_key, n_words and postings (term, at), sorted; stored."""
    tokens = documents.select(
        "doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"), words(F.col("text")).alias("tokens")
    )
    # Without this the words are split once for each column that is made from them.
    rows = tokens.select("doc_id", "text_key", F.explode(F.array("tokens")).alias("tokens"))
    placed = F.arrays_zip(F.col("tokens").alias("term"), F.sequence(F.lit(0), F.size("tokens") - 1).alias("at"))
    listed = F.when(F.size("tokens") > 0, F.sort_array(placed)).otherwise(F.array().cast("array<struct<term:string,at:int>>"))
    index = rows.select(
        F.monotonically_increasing_id().alias("ref"), "doc_id", "text_key", F.size("tokens").cast("bigint").alias("n_words"),
        listed.alias("postings"),
    )
    return store(index, "decontamination-index")


def _small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def test_items(benchmark: DataFrame) -> DataFrame:
    """Per item with words: number (its own), item_id, size and its words; stored."""
    rows = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("item"))
    rows = rows.where(F.size("item") > 0).distinct()
    return store(rows.select(F.monotonically_increasing_id().alias("number"), "item_id", F.size("item").alias("size"), "item"), "decontamination-items")


def term_counts(index: DataFrame, tokens: DataFrame) -> DataFrame:
    """How often each term of the items occurs in all documents; terms that never occur have no row."""
    vocabulary = _small(tokens.select("term").distinct())
    return index.select(F.inline("postings")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def rarest(tokens: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to look up: the windows by their rarest two offsets (number, first, second, begin, end; second null in a window
    of one word), and the offsets (number, offset, term, near). tokens: number, size, offset, term.

    Windows with a term that no document has can't occur and are left out; near marks offsets for proximity matches.
    """
    counted = store(tokens.join(_small(counts), "term", "left").withColumn("n", F.coalesce("n", F.lit(0))), "decontamination-tokens")
    ahead = Window.partitionBy("number").orderBy("offset").rowsBetween(0, WINDOW - 1)
    rank = F.struct("n", F.col("offset").alias("at"), "term")
    windows = (
        counted.withColumn("ranks", F.sort_array(F.collect_list(rank).over(ahead)))
        .where(F.col("offset") <= F.greatest(F.col("size") - WINDOW, F.lit(0))).where(F.col("ranks")[0]["n"] > 0)
        .select("number", "offset", "size", F.col("ranks")[0].alias("a"), F.get("ranks", F.lit(1)).alias("b"))
    )
    pairs = windows.groupBy("number", F.col("a.at").alias("first"), F.col("b.at").alias("second")).agg(
        F.min("offset").alias("begin"), F.max(F.col("offset") + F.least("size", F.lit(WINDOW))).alias("end")
    )
    few = Window.partitionBy("number").orderBy("n", "term")
    near = counted.where("n > 0").withColumn("place", F.dense_rank().over(few)).where(F.col("place") <= NEAR_TERMS)
    side = lambda part, near: windows.where(f"{part} is not null").select("number", F.col(f"{part}.at").alias("offset"), F.col(f"{part}.term").alias("term"), F.lit(near).alias("near"))
    offsets = side("a", True).unionByName(side("b", False)).unionByName(near.select("number", "offset", "term", F.lit(True).alias("near")))
    return pairs, offsets.groupBy("number", "offset", "term").agg(F.bool_or("near").alias("near"))


def search(index: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The exact matches (ref, number, low, high exclusive; of the longest runs) and the proximity matches (ref, number)."""
    tokens = items.select("number", "size", F.posexplode("item").alias("offset", "term"))
    pairs, offsets = rarest(tokens, store(term_counts(index, tokens), "decontamination-terms"))
    pairs, offsets = store(pairs, "decontamination-windows"), store(offsets, "decontamination-offsets")
    hits = store(
        index.select("ref", F.inline("postings")).join(_small(offsets), "term")
        .select("ref", "number", "offset", "term", "near", (F.col("at") - F.col("offset")).alias("shift")),
        "decontamination-hits",
    )
    firsts = hits.join(_small(pairs.withColumnRenamed("first", "offset")), ["number", "offset"])
    seconds = hits.select("ref", "number", "shift", F.col("offset").alias("second")).distinct()
    both = firsts.where("second is not null").join(seconds, ["ref", "number", "shift", "second"], "left_semi")
    spots = ["ref", "number", "shift", "begin", "end"]
    left = store(firsts.where("second is null").select(*spots).unionByName(both.select(*spots)), "decontamination-left")
    asked = left.select("ref", "number", "shift", F.explode(F.sequence("begin", F.col("end") - 1)).alias("offset")).distinct()
    asked = asked.join(_small(tokens.select("number", "offset", "term", "size")), ["number", "offset"])
    asked = asked.withColumn("at", F.col("shift") + F.col("offset"))
    lists = index.select("ref", "postings").join(_small(left.select("ref").distinct()), "ref", "left_semi")
    agreed = asked.join(lists.select("ref", F.inline("postings")), ["ref", "at", "term"])
    run = F.col("offset") - F.row_number().over(Window.partitionBy("ref", "number", "shift").orderBy("offset"))
    exact = (
        agreed.withColumn("run", run).groupBy("ref", "number", "shift", "size", "run")
        .agg(F.min("at").alias("low"), (F.max("at") + 1).alias("high"))
        .where(F.col("high") - F.col("low") >= F.least("size", F.lit(WINDOW))).select("ref", "number", "low", "high")
    )
    band = F.floor(F.col("shift") / SLOP)
    near = (
        hits.where("near").select("ref", "number", "term", F.explode(F.array(band, band + 1)).alias("band"))
        .groupBy("ref", "number", "band").agg(F.count_distinct("term").alias("met"))
        .where("met > 1").select("ref", "number").distinct()
    )
    out = store(exact, "decontamination-exact"), store(near, "decontamination-near")
    discard(pairs, offsets, hits, left)
    return out


def _hit_words(exact: DataFrame) -> DataFrame:
    """Per document with matches: the words that lie in any of them."""
    own = Window.partitionBy("ref").orderBy("low", "high")
    spans = exact.select("ref", "low", "high").distinct()
    reach = F.max("high").over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("high") - F.greatest(F.col("low"), F.coalesce(reach, F.lit(0))))
    return spans.withColumn("new", new).groupBy("ref").agg(F.sum("new").alias("hit"))


def report(index: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document of an index: n_words, n_hit, n_items, items_sha256, contaminated, n_near, and the ids of the items with
    an exact and with a proximity match (items, near_items)."""
    items = test_items(benchmark)
    exact, near = search(index, items)
    names = _small(items.select("number", F.col("item_id").cast("string").alias("name")))
    listed = lambda found, name: found.select("ref", "number").join(names, "number").groupBy("ref").agg(
        F.array_sort(F.collect_set("name")).alias(name)
    )
    out = index.select("ref", "doc_id", "text_key", "n_words")
    for part in (_hit_words(exact), listed(exact, "items"), listed(near, "near_items")):
        out = out.join(part, "ref", "left")
    none = F.array().cast("array<string>")
    hit, found, close = F.coalesce("hit", F.lit(0)).cast("bigint"), F.coalesce("items", none), F.coalesce("near_items", none)
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(found).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (SHARE * hit >= F.col("n_words"))).alias("contaminated"),
        F.size(close).cast("bigint").alias("n_near"), "text_key", found.alias("items"), close.alias("near_items"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their columns."""
    bad_id, bad_text = fresh(documents, "bad_id"), fresh(documents, "bad_text")
    index = build_index(documents.select("doc_id", "text"))
    bad = store(
        report(index, benchmark).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_text)).distinct(),
        "decontamination-bad",
    )
    discard(index)
    on = documents["doc_id"].eqNullSafe(F.col(bad_id)) & (F.xxhash64(documents["text"].cast("string")) == F.col(bad_text))
    return documents.join(_small(bad), on, "left_anti")
