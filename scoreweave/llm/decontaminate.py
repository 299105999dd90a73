"""Benchmark decontamination by a prefix-filtered join, in DataFrame functions alone."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.llm import query
from scoreweave.session import cut_lineage

#: Words of a window.
WINDOW = 10
#: Rows of a table made from the items that may be broadcast; a larger one takes a shuffled join.
BROADCAST_ROWS = 200_000
#: Everything in ASCII but digits and lower-case letters; upper case is lowered before.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, lower-cased in ASCII; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, GAPS), "")


def _bounded(df: DataFrame) -> DataFrame:
    """A table written once, marked for broadcast if it is small enough."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """(window, items): each distinct window of words, and the ids that hold it as sorted strings.

    An item shorter than `size` words is one window; one without words has none.
    """
    split = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    single = split.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.lit(size)))).alias("window"))
    return single.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def contained_windows(docs: DataFrame, items: DataFrame, size: int = WINDOW, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(_h1, _h2, _found) per distinct text with candidates: where in its words which window may lie.

    Words are ordered by the number of documents they are in. A window lies in
    a document only if its rarest word does, so that word is its whole prefix;
    a window with a word no document has is dropped. The joins keep rows of
    (text hash, place, word), never texts; the place in the window and the
    lengths bound where it can start.
    """
    windows = cut_lineage(item_windows(items, size, item_col, "text" if text_col not in items.columns else text_col))
    vocabulary = _bounded(windows.select(F.explode("window").alias("word")).distinct())
    texts = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h1"), F.hash(F.coalesce(F.col(text_col), F.lit(""))).alias("_h2"), words(F.col(text_col)).alias("w"))
    seen = texts.select(F.explode(F.array_distinct("w")).alias("word"))
    rarity = _bounded(seen.join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("docs")))
    ranked = windows.select("window", "items", F.posexplode("window").alias("at", "word")).join(rarity, "word", "left")
    first = ranked.groupBy("window").agg(
        F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "word", "at")).alias("rarest"), F.first("items").alias("items")
    )
    prefixes = _bounded(
        first.where("rarest.docs > 0").select(F.col("rarest.word").alias("word"), F.col("rarest.at").alias("at"), "window", "items")
    )
    places = texts.select("_h1", "_h2", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    found = (
        places.join(prefixes, "word")
        .where("pos >= at and pos - at + size(window) <= n")
        .select("_h1", "_h2", (F.col("pos") - F.col("at")).alias("start"), "window", "items")
        .distinct()
    )
    return found.groupBy("_h1", "_h2").agg(F.collect_list(F.struct("start", "window", "items")).alias("_found"))


def decontaminate(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256 and contaminated; all columns and rows stay.

    A document word is hit if it lies inside an occurrence of a window of
    `size` item words. Candidates of `contained_windows` are verified word by
    word against the document, once per text. Null and empty texts have no
    words and no hits; items without id or words are passed over; several rows
    of one item count once. Columns of these names in `docs` are replaced.
    """
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    keep = [c for c in docs.columns if c.lower() not in made]
    # Written before it is joined: then copies of one text are split by adaptive execution.
    candidates = cut_lineage(contained_windows(docs, items, size, text_col, item_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, F.xxhash64(text).alias("_h1"), F.hash(text).alias("_h2"))
    joined = rows.join(candidates, ["_h1", "_h2"], "left")
    # A generated column stays one: a projected one may be moved into the lambda below and split the text for every hit.
    joined = joined.select("*", F.explode(F.array(words(F.col(text_col)))).alias("_w"))
    sure = joined.withColumn(
        "_hits",
        F.filter(
            F.coalesce("_found", F.array().cast(candidates.schema["_found"].dataType)),
            lambda h: F.slice(F.col("_w"), h["start"] + 1, F.size(h["window"])) == h["window"],
        ),
    )
    places = F.flatten(F.transform("_hits", lambda h: F.sequence(h["start"], h["start"] + F.size(h["window"]) - 1)))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: h["items"]))))
    return sure.select(*keep, F.size("_w").cast("long").alias("n_words"), F.size(F.array_distinct(places)).cast("long").alias("n_hit"), ids.alias("_ids")).select(
        *keep,
        "n_words",
        "n_hit",
        F.size("_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in ten-word windows of benchmark items."""
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate(docs.select("doc_id", "text"), items).drop("text")
