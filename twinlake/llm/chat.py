"""Quotation linking of conversations, in DataFrame operations only.

A line's quote level is the number of ``>`` marks before it (spaces may stand between).  Lines of one level in a row form a quoted
passage, and its blank lines part it into paragraphs.  Passages, their paragraphs and lines, and the messages' own units (the whole text without quotes, its paragraphs, its lines) are normalised (lower case,
white space as one space) and hashed; a passage is linked to the latest earlier message of its conversation that has a unit of its
hash, by a running maximum over the rows of each hash, so no pairs arise within a common one.  A message replies to the latest link
of its passages of the lowest linked level.  Roots, depths and places follow by pointer jumping: a place is a message's number in the
walk of its thread that goes depth first with replies by turn, so that sorted by (conv_id, root, place) every message stands after what
it replies to and its own replies follow it.  Quotes, and a line that introduces one ("... wrote:"), are taken out of the text.

Messages stay rows; ``chats`` joins them into texts of bounded size.  Only conversations with quotes take part in the links.

Cases: null text is empty; null turn comes first (place 0) and can neither be quoted nor reply; null conv_id is one conversation; repeated rows
each keep theirs with one place, and a link names a turn, whatever number of rows have it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

_MARKS = r"^(?:[ \t]{0,3}+>)++"  # possessive: matched in a loop, where a group that may be given back takes stack by mark

#: What tells a message with quotes, key being its text's digest.  Repeated rows share their links.  Row numbers wouldn't do: rows that
#: come from a join or a shuffle get others each time that a plan is run.
_MESSAGE = ["conv_id", "turn", "key"]


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _messages(conversations: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r\n?", "\n")
    lines = F.split(text, "\n", -1)
    quoted = lambda x: x.rlike(_MARKS)
    df = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"), lines.alias("lines"))
    df = df.withColumn("quotes", F.exists("lines", quoted))
    introduces = lambda x, i: x.rlike(r"(?i)\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$") & F.coalesce(quoted(F.get("lines", i + 1)), F.lit(False))
    own = F.array_join(F.filter("lines", lambda x, i: ~quoted(x) & ~introduces(x, i)), "\n")
    df = df.withColumn("key", F.when(F.col("quotes"), F.unhex(F.md5(F.col("text").cast("binary")))))
    return df.withColumn("own", F.when(F.col("quotes"), F.btrim(F.regexp_replace(own, r"\n{3,}", "\n\n"), F.lit(" \t\n\x0b\f\r"))).otherwise(F.col("text"))).drop("text")


def _passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, key, level, hash of each quoted passage, and of each of its paragraphs and lines."""
    each = messages.where("quotes AND turn IS NOT NULL").dropDuplicates(_MESSAGE).select(*_MESSAGE, F.posexplode("lines").alias("at", "line"))
    marks = F.regexp_extract("line", _MARKS, 0)
    each = each.select(*_MESSAGE, "at", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.substr("line", F.length(marks) + 1).alias("line"))
    order = Window.partitionBy(*_MESSAGE).orderBy("at")
    blank = ~F.col("line").rlike(r"\S")
    each = each.withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(-1))).cast("int")).withColumn("run", F.sum("new").over(order)).withColumn("part", F.sum(blank.cast("int")).over(order)).where("level > 0")
    joined = lambda df, *by: df.groupBy(*_MESSAGE, "level", "run", *by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("unit")).select(*_MESSAGE, "level", "unit")
    units = joined(each).unionByName(joined(each.where(~blank), "part")).unionByName(each.select(*_MESSAGE, "level", F.col("line").alias("unit")))
    return units.withColumn("unit", _normal(F.col("unit"))).where("unit <> ''").select(*_MESSAGE, "level", F.md5(F.col("unit").cast("binary")).alias("hash")).distinct()


def _units(messages: DataFrame) -> DataFrame:
    """conv_id, turn, hash of each unit of a message's own text."""
    parts = F.array_distinct(F.concat(F.array("own"), F.split("own", r"\n\s*\n"), F.split("own", "\n")))
    each = messages.where("turn IS NOT NULL").select("conv_id", "turn", F.explode(parts).alias("unit")).withColumn("unit", _normal(F.col("unit")))
    return each.where("unit <> ''").select("conv_id", "turn", F.md5(F.col("unit").cast("binary")).alias("hash")).distinct()


def replies(messages: DataFrame) -> DataFrame:
    """conv_id, turn, key, reply_to, n_quotes, n_linked of the messages with quotes."""
    passages = common.checkpoint(_passages(messages))
    some = passages.select("conv_id").distinct()
    units = _units(messages.join(some, messages.conv_id.eqNullSafe(some.conv_id), "left_semi"))
    both = units.select("conv_id", "turn", "hash", F.lit(1).alias("original"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("int").alias("level"))
    both = both.unionByName(passages.select("conv_id", "turn", "hash", F.lit(0).alias("original"), "key", "level"))
    so_far = Window.partitionBy("conv_id", "hash").orderBy("turn", "original").rowsBetween(Window.unboundedPreceding, -1)
    linked = both.withColumn("source", F.max(F.when(F.col("original") == 1, F.col("turn"))).over(so_far)).where("original = 0")
    best = F.max(F.when(F.col("source").isNotNull(), F.struct((-F.col("level")).alias("near"), "source")))
    return linked.groupBy(*_MESSAGE).agg(best["source"].alias("reply_to"), F.count("*").alias("n_quotes"), F.count("source").alias("n_linked"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent, root, depth of every message that replies, by pointer jumping: each round doubles the way up that is known."""
    up = common.checkpoint(links.where("reply_to IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("parent")).withColumns({"root": F.col("parent"), "depth": F.lit(1).cast("long")}))
    while True:
        above = up.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root").alias("beyond"), F.col("depth").alias("more"))
        joined = up.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("root") == F.col("t")), "left")
        after = common.checkpoint(joined.select("conv_id", "turn", "parent", F.coalesce("beyond", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0).cast("long"))).alias("depth"), F.col("beyond").isNotNull().alias("moved")))
        moved = after.where("moved").limit(1).count()
        up = after.drop("moved")
        if not moved:
            return up


def places(ways: DataFrame) -> DataFrame:
    """conv_id, turn, place of every message that replies: how many of its thread the depth-first walk meets before it.

    The walk enters and leaves every message once; each step knows the one before it, and rounds that double the way back that is known
    count the messages entered on it.  No thread is gathered, however long or wide it is."""
    siblings = Window.partitionBy("conv_id", "parent").orderBy("turn")
    roots = ways.where("depth = 1").select("conv_id", F.col("root").alias("turn")).distinct()
    nodes = ways.select("conv_id", "turn", "parent", F.lag("turn").over(siblings).alias("sibling")).unionByName(roots, allowMissingColumns=True)
    last = ways.groupBy(F.col("conv_id").alias("c"), F.col("parent").alias("p")).agg(F.max("turn").alias("child"))
    nodes = nodes.join(last, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("p")), "left")
    entered, left = F.lit(0), F.lit(1)
    enter = F.struct(entered.alias("side"), F.lit(1).cast("long").alias("n"), F.coalesce("sibling", "parent").alias("to"), F.when(F.col("sibling").isNotNull(), left).otherwise(entered).alias("to_side"))
    leave = F.struct(left.alias("side"), F.lit(0).cast("long").alias("n"), F.coalesce("child", "turn").alias("to"), F.when(F.col("child").isNotNull(), left).otherwise(entered).alias("to_side"))
    steps = common.checkpoint(nodes.select("conv_id", "turn", F.inline(F.array(enter, leave))))
    while steps.where("to IS NOT NULL").limit(1).count():
        before = steps.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("side").alias("s"), F.col("n").alias("more"), F.col("to").alias("far"), F.col("to_side").alias("far_side"))
        joined = steps.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("to") == F.col("t")) & (F.col("to_side") == F.col("s")), "left")
        steps = common.checkpoint(joined.select("conv_id", "turn", "side", (F.col("n") + F.coalesce("more", F.lit(0).cast("long"))).alias("n"), F.col("far").alias("to"), F.col("far_side").alias("to_side")))
    return steps.where("side = 0 AND n > 1").select("conv_id", "turn", (F.col("n") - 1).alias("place"))


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, root, depth, place, n_quotes, n_linked, own (the text without quotes) and chat (a role header and
    own).

    Sorted by (conv_id, root, place) a conversation reads in the order of replies."""
    messages = _messages(conversations)
    links = common.checkpoint(replies(messages))
    ways = threads(links)
    at = places(ways).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("place").alias("way_place"))
    ways = ways.select("conv_id", "turn", F.col("root").alias("way_root"), F.col("depth").alias("way_depth"))
    ways = ways.join(at, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t"))).select("c", "t", "way_root", "way_depth", "way_place")
    found = links.join(ways, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left").select("reply_to", "n_quotes", "n_linked", F.col("key").alias("way_key"), F.col("conv_id").alias("way_conv"), F.col("turn").alias("way_turn"), "way_root", "way_depth", "way_place")
    zero = F.lit(0).cast("long")
    mine = F.col("conv_id").eqNullSafe(F.col("way_conv")) & (F.col("turn") == F.col("way_turn")) & (F.col("key") == F.col("way_key"))
    joined = messages.drop("lines").join(found, mine, "left")
    own = F.col("own")
    numbers = (F.coalesce(c, zero).alias(n) for c, n in (("way_depth", "depth"), ("way_place", "place"), ("n_quotes", "n_quotes"), ("n_linked", "n_linked")))
    return joined.select("conv_id", "turn", "role", "reply_to", F.coalesce("way_root", "turn").alias("root"), *numbers, own.alias("own"), F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), own, F.lit("\n")).alias("chat"))


def chats(formatted: DataFrame, part_chars: int = 1 << 20) -> DataFrame:
    """conv_id, root, part, n_messages, chat: the chats of each thread joined in reply order.

    A part ends with the message that fills it, so it holds less than ``part_chars`` characters and one message more; a thread of any
    length only meets as rows that stream in order.  Repeated rows of a message stand together, by text."""
    order = Window.partitionBy("conv_id", "root").orderBy("place", "turn", "chat")
    size = F.length("chat").cast("long")
    df = formatted.withColumn("part", F.floor((F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size) / part_chars)).withColumn("nth", F.row_number().over(order))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "chat"))), lambda x: x["chat"]), "")
    return df.groupBy("conv_id", "root", "part").agg(F.count("*").alias("n_messages"), joined.alias("chat"))
