"""Reply structure of conversations from quoted passages, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreweave.llm import query
from scoreweave.llm.storage import bounded
from scoreweave.session import cut_lineage

#: A line that is quoted: marks, each after at most one blank, and one blank more.
QUOTED = r"^((?:[ ]?>)+)[ ]?"
#: Stretches of quoted lines, with a line before them that says who wrote.
STRETCH = r"(?m)(?:^[^\n>]{0,300}(?:wrote|schrieb|a écrit|escribió):[ \t]*\n)?(?:^[ ]?>[^\n]*(?:\n|\z))+"

#: The line that says who wrote, or two of them.
WROTE = r"^[^>]{0,300}(?:wrote|schrieb|a écrit|escribió):[ \t]*$"
WROTE_TWO = r"^[^>\n]{0,300}\b(?:wrote|schrieb|a écrit|escribió)[ \t]*\n[^>\n]{1,100}:[ \t]*$"

#: Between two sentences.
SENTENCE = r"(?<=[.!?…])\s+|(?<=[。！？])"


def normalised(text: Column) -> Column:
    """Lower case, blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def without_quotes(text: Column) -> Column:
    """A message's own words: quoted lines and the line that introduces them are gone."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    return F.when(quotes(text), F.regexp_replace(F.regexp_replace(plain, STRETCH, ""), r"^\n+|\s+\z", "")).otherwise(F.coalesce(text, F.lit("")))


def quotes(text: Column) -> Column:
    """Whether any line is quoted."""
    return F.coalesce(F.regexp_like(text, F.lit(r"(?m)(?:^|\r)[ ]?>")), F.lit(False))


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), F.length(text).alias("chars")]


def _fine(text: Column) -> Column:
    """(rank, par, unit) of each paragraph, as 1, and each of its sentences, as 2; both may be wrapped anew."""
    pars = F.transform(F.split(text, r"\n\s*\n"), normalised)
    unit = lambda rank, par, x: F.struct(F.lit(rank).alias("rank"), par.alias("par"), x.alias("unit"))
    return F.flatten(
        F.transform(pars, lambda p, i: F.concat(F.array(unit(1, i, p)), F.transform(F.split(p, SENTENCE), lambda x: unit(2, i, x))))
    )


def _passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, msg, passages) of messages that quote: their lines (level, body, raw), cut where the level changes."""
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    marked = F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, QUOTED, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(x, QUOTED, "").alias("body"),
            x.alias("raw"),
        ),
    )
    quoting = messages.where(quotes(F.col("text"))).select("conv_id", "turn", F.xxhash64("text").alias("msg"), marked.alias("lines"))
    # Where the level changes, a passage begins; it ends where the next one does.
    starts = F.filter(
        F.sequence(F.lit(1), F.size("lines")),
        lambda i: (i == 1) | (F.get("lines", i - 1)["level"] != F.get("lines", i - 2)["level"]),
    )
    cut = quoting.withColumn("starts", starts)
    passages = F.transform("starts", lambda s, i: F.slice("lines", s, F.coalesce(F.get("starts", i + 1), F.size("lines") + 1) - s))
    return cut.select("conv_id", "turn", "msg", passages.alias("passages"))


def quoted_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, msg, level, stretch, par, rank, k1, k2, chars) of every quoted passage, and of its lines, paragraphs and sentences.

    A passage is a stretch of lines of one quote level; the text inside is
    normalised and hashed. Passages of blanks alone are left out. The rank is 0
    for passages, -1 for lines, 1 for paragraphs and 2 for sentences. msg is a
    hash of the message, for rows that repeat a conv_id and turn.
    """
    single = _passages(messages).select("conv_id", "turn", "msg", F.posexplode("passages").alias("stretch", "p")).where("p[0].level > 0")
    unit = lambda rank, x: F.struct(F.lit(rank).alias("rank"), F.lit(0).alias("par"), x.alias("unit"))
    units = F.concat(F.array(unit(0, F.array_join(F.col("p.body"), " "))), F.transform(F.col("p.body"), lambda x: unit(-1, x)), _fine(F.array_join(F.col("p.body"), "\n")))
    texts = single.select("conv_id", "turn", "msg", "stretch", F.col("p")[0]["level"].alias("level"), F.explode(units).alias("u"))
    texts = texts.select("conv_id", "turn", "msg", "level", "stretch", "u.par", "u.rank", normalised(F.col("u.unit")).alias("unit")).where("unit <> ''")
    return texts.select("conv_id", "turn", "msg", "level", "stretch", "par", "rank", *_key(F.col("unit"))).distinct()


def original_units(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, k1, k2, chars): whole own texts, their lines, paragraphs and sentences, which others may quote."""
    own = messages.select("conv_id", "turn", without_quotes(F.col("text")).alias("own"))
    units = own.select("conv_id", "turn", F.explode(F.array_union(F.array_union(F.array("own"), F.split("own", "\n")), _fine(F.col("own"))["unit"])).alias("unit"))
    return units.select("conv_id", "turn", normalised(F.col("unit")).alias("unit")).where("unit <> ''").select("conv_id", "turn", *_key(F.col("unit")))


def sourced_passages(messages: DataFrame) -> DataFrame:
    """`quoted_passages` with `source`, the (conv, turn) that each unit is quoted from, or null.

    A unit is sought in its own conversation first, as the earliest turn before
    the quoting one that has it, and else anywhere, as the smallest (conv_id,
    turn) that has it. Each side keeps one row per hash before it is joined, so
    a line that a third of all messages have makes no more links than it is
    quoted.
    """
    passages = cut_lineage(quoted_passages(messages))
    wanted = bounded(passages.select("k1", "k2", "chars").distinct())
    units = original_units(messages).join(wanted, ["k1", "k2", "chars"])
    near = cut_lineage(units.groupBy("conv_id", "k1", "k2", "chars").agg(F.min("turn").alias("first")))
    anywhere = cut_lineage(near.groupBy("k1", "k2", "chars").agg(F.min(F.struct(F.col("conv_id").alias("conv"), F.col("first").alias("turn"))).alias("far")))
    own = passages.join(near, ["conv_id", "k1", "k2", "chars"], "left").withColumn("inside", F.col("first") < F.col("turn"))
    both = cut_lineage(own.join(anywhere, ["k1", "k2", "chars"], "left"))
    # Where the smallest source is in the own conversation, but not before the quote, the smallest of another one.
    late = both.where("far.conv = conv_id and not inside").select("k1", "k2", "chars", F.col("far.conv").alias("not_conv")).distinct()
    other = near.join(bounded(late), ["k1", "k2", "chars"]).where("conv_id <> not_conv").groupBy("k1", "k2", "chars").agg(
        F.min(F.struct(F.col("conv_id").alias("conv"), F.col("first").alias("turn"))).alias("other")
    )
    both = both.join(bounded(other), ["k1", "k2", "chars"], "left")
    source = F.when(F.col("inside"), F.struct(F.col("conv_id").alias("conv"), F.col("first").alias("turn"))).otherwise(
        F.when(F.col("far.conv") != F.col("conv_id"), F.col("far")).otherwise(F.col("other"))
    )
    return cut_lineage(both.select(*passages.columns, source.alias("source")))


def link_quotations(sourced: DataFrame) -> DataFrame:
    """(conv_id, turn, level, from_conv, from_turn, chars): which earlier message each quoting message quotes, and how much.

    Paragraphs of a passage count where the passage is not found whole, and
    sentences where their paragraph is not found either.
    """
    part = ["conv_id", "turn", "level", "stretch"]
    found = sourced.where("source is not null")
    whole = F.max(F.col("rank") == 0).over(Window.partitionBy(*part))
    paragraph = F.max(F.col("rank") == 1).over(Window.partitionBy(*part, "par"))
    found = found.withColumns({"whole": whole, "paragraph": paragraph}).where("rank <= 0 or not whole and (rank = 1 or not paragraph)")
    found = found.select("conv_id", "turn", "level", "k1", "k2", "chars", "source").distinct()
    return found.groupBy("conv_id", "turn", "level", F.col("source.conv").alias("from_conv"), F.col("source.turn").alias("from_turn")).agg(
        F.sum("chars").alias("chars")
    )


def settled_passages(sourced: DataFrame) -> DataFrame:
    """(conv_id, turn, msg, settled, lines): numbers of a message's passages that stand elsewhere, every word of them, and hashes of single lines that do.

    A passage does if it is found whole, or each of its lines is, or each of its
    paragraphs is found or consists of found sentences. What was not found, such
    as a part of a sentence or a line that merely begins with the mark, does not.
    """
    here = F.col("source").isNotNull()
    every = lambda rank: F.coalesce(F.bool_and(F.when(F.col("rank") == rank, here)), F.lit(False))
    some = lambda rank: F.coalesce(F.bool_or(F.when(F.col("rank") == rank, here)), F.lit(False))
    of = ["conv_id", "turn", "msg", "stretch"]
    pars = sourced.where("rank > 0").groupBy(*of, "par").agg((some(1) | every(2)).alias("fine")).groupBy(*of).agg(F.bool_and("fine").alias("fine"))
    wholes = sourced.groupBy(*of).agg((some(0) | every(-1)).alias("whole"))
    settled = wholes.join(pars, of, "left").where("whole or fine").select("conv_id", "turn", "msg", "stretch", F.lit(None).cast("long").alias("line"))
    single = sourced.where("rank = -1 and source is not null").select("conv_id", "turn", "msg", F.lit(None).cast("int").alias("stretch"), F.col("k1").alias("line"))
    # Passages and lines of one message.
    return settled.unionByName(single).groupBy("conv_id", "turn", "msg").agg(F.collect_set("stretch").alias("settled"), F.collect_set("line").alias("lines"))


def _without(settled: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, turn, msg, own): the texts of these messages without their settled passages and lines and the lines that introduce them."""

    def kept(p: Column, i: Column) -> Column:
        found = lambda x: F.array_contains("lines", F.xxhash64(normalised(x["body"])))
        blank = (p[0]["level"] > 0) & ~F.exists(p, lambda x: (F.trim(x["body"]) != "") & ~found(x))
        last, n = p[F.size(p) - 1]["raw"], F.size(p)
        two = F.concat_ws("\n", F.get(p, n - 2)["raw"], last)
        wrote = F.when((n > 1) & F.regexp_like(two, F.lit(WROTE_TWO)), F.lit(2)).when(F.regexp_like(last, F.lit(WROTE)), F.lit(1)).otherwise(F.lit(0))
        introduces = (p[0]["level"] == 0) & F.array_contains("settled", i + 1)
        raw = F.transform(F.filter(p, lambda x: (x["level"] == 0) | ~found(x)), lambda x: x["raw"])
        return F.when(F.array_contains("settled", i) | blank, F.array().cast("array<string>")).otherwise(
            F.slice(raw, F.lit(1), F.size(raw) - F.when(introduces, wrote).otherwise(F.lit(0)))
        )

    quoting = _passages(messages).distinct().join(settled, ["conv_id", "turn", "msg"])
    lines = F.array_join(F.flatten(F.transform("passages", kept)), "\n")
    return quoting.select("conv_id", "turn", "msg", F.regexp_replace(lines, r"^\n+|\s+\z", "").alias("own"))


def reply_paths(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root, path): for messages with a parent, the turns from the first ancestor down.

    Doubles the known stretch of every path until all reach their roots.
    """
    known = cut_lineage(parents.select("conv_id", "turn", F.col("parent_turn").alias("root"), F.array("parent_turn", "turn").alias("path")))
    while True:
        up = known.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("path").alias("upper"))
        longer = known.join(up, ["conv_id", "root"], "left").select(
            "conv_id",
            "turn",
            F.coalesce("above", "root").alias("root"),
            F.when(F.col("upper").isNotNull(), F.concat("upper", F.slice("path", 2, F.size("path")))).otherwise(F.col("path")).alias("path"),
            F.col("above").isNotNull().alias("moved"),
        )
        longer = cut_lineage(longer)
        known = longer.drop("moved")
        if not longer.where("moved").limit(1).count():
            return known


def link_replies(messages: DataFrame) -> DataFrame:
    """Messages in reply order without quotes: conv_id, turn, role, text, parent_turn, depth, reply_path, quoted_conv, quoted_turn, n_quoted.

    Of the text those quoted passages and lines go that stand in another message,
    with the line or two that say who wrote a passage; quotes whose original is
    not there, and other lines that begin with the mark, stay.

    The parent is the earlier message of the conversation that the outermost
    quotes draw most characters from, the latest of several such. A message
    without one stands for itself. Sorting by (conv_id, reply_path) puts every
    reply after what it answers, in the order of turns. quoted_conv and
    quoted_turn name the message most quoted where it is in another
    conversation; n_quoted counts quoted messages. Null texts become empty;
    messages whose conv_id or turn is null stay as they are, unlinked.
    Repeated rows stay, each linked alike. Other columns are dropped.
    """
    known = messages.where("conv_id is not null and turn is not null and text is not null").select("conv_id", "turn", "text")
    sourced = sourced_passages(known)
    links = cut_lineage(link_quotations(sourced))
    own = bounded(_without(bounded(settled_passages(sourced)), known))
    inner = links.where("from_conv = conv_id")
    best = inner.groupBy("conv_id", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("level"), "chars", "from_turn")).alias("best")
    )
    parents = cut_lineage(best.select("conv_id", "turn", F.col("best.from_turn").alias("parent_turn")))
    paths = reply_paths(parents)
    outer = links.where("from_conv <> conv_id").groupBy("conv_id", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("level"), "chars", F.col("from_conv").alias("quoted_conv"), F.col("from_turn").alias("quoted_turn"))).alias("o")
    )
    counts = links.groupBy("conv_id", "turn").agg(F.countDistinct("from_conv", "from_turn").alias("n_quoted"))
    facts = counts.join(outer, ["conv_id", "turn"], "left").join(parents, ["conv_id", "turn"], "left").join(paths.drop("root"), ["conv_id", "turn"], "left")
    facts = bounded(facts.select("conv_id", "turn", "parent_turn", "path", "o.quoted_conv", "o.quoted_turn", "n_quoted"))
    joined = messages.select("conv_id", "turn", "role", "text").join(facts, ["conv_id", "turn"], "left")
    joined = joined.withColumn("msg", F.xxhash64("text")).join(own, ["conv_id", "turn", "msg"], "left")
    path = F.coalesce("path", F.array("turn"))
    return joined.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("own", "text", F.lit("")).alias("text"),
        "parent_turn",
        (F.size(path) - 1).alias("depth"),
        path.alias("reply_path"),
        "quoted_conv",
        "quoted_turn",
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
    )


@query()
def op10_quotation_linking(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations in reply order, without quotes."""
    return link_replies(spark.read.parquet(f"{folder}/conversations.parquet"))
