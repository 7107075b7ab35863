"""Quotation linking: conversations in reply order from messages that quote each other.

A message's lines have a quote level, the number of `>` that they begin with. Lines, and passages of successive
lines of one level, are hashed in a normalised form and joined to the messages that say them at level 0. Lines
are looked for first; lines that nobody has as they stand are looked for as the passage that they make up, so
new wrapping is no hindrance.

A quoted line counts, with its length, for every earlier message of the thread that says it, however many do; a
line found by its passage counts for the latest message that has the passage. At each quote level the message
with the most such characters is linked, of equals the latest; that of level 1 is the message replied to. What a
message itself says is its level 0 lines.

Votes for lines that few messages say are counted one by one. For lines that many say, messages are taken
together by which of these lines they say, and quotations by which they quote: a thread has few such
combinations, and of the holders of the best one the latest is enough. The result is the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import cut

#: Messages of a thread that are numbered by themselves.
RANGE = 4096
#: Messages of a thread that say a line from which on its votes are counted by combinations of lines.
MANY = 16


def normalised(text: Column) -> Column:
    """Lower case, with marks and blanks as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """(thread, seq, at, pos, level, body, hash, size) for each line of messages(thread, seq, at, text): pos numbers a message's lines.

    Lines without letters or digits have no hash; size is the length of the normalised form.
    """
    lines = messages.select("thread", "seq", "at", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\r?\n|\r")).alias("pos", "line"))
    marks = F.regexp_extract("line", r"^(\s*>[\s>]*)", 1)
    level = F.length(F.translate(marks, " \t ", ""))
    rows = lines.select("thread", "seq", "at", "pos", level.alias("level"), F.expr("substring(line, length(regexp_extract(line, '^(\\\\s*>[\\\\s>]*)', 1)) + 1)").alias("body"))
    rows = rows.withColumn("plain", normalised(F.col("body")))
    return rows.select("thread", "seq", "at", "pos", "level", "body", F.when(F.col("plain") != "", F.xxhash64("plain")).alias("hash"), F.length("plain").alias("size"))


def _latest_holders(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """quoted(thread, seq, at, level, hash, size) with the latest holder, of own(thread, hash, seq, at), that stands earlier.

    Holders and quotations of a line stand in one order, in ranges of the thread: within a range by a window, from
    the ranges before by their maxima. So a line that a whole thread says and quotes isn't one task's.
    """
    both = own.select("thread", "hash", "at", "seq", F.lit(0).alias("kind"), F.lit(0).alias("level"), F.lit(0).alias("size")).union(
        quoted.select("thread", "hash", "at", "seq", F.lit(1), "level", "size")).withColumn("range", F.floor(F.col("at") / RANGE).cast("bigint"))
    said = F.when(F.col("kind") == 0, F.struct("at", "seq"))
    of_range = both.groupBy("thread", "hash", "range").agg(F.max(said).alias("said"))
    ranges = W.partitionBy("thread", "hash").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = of_range.select("thread", "hash", "range", F.max("said").over(ranges).alias("before"))
    within = W.partitionBy("thread", "hash", "range").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    found = both.withColumn("inside", F.max(said).over(within)).where("kind = 1").join(before, ["thread", "hash", "range"])
    return found.select("thread", "seq", "level", "hash", "size", F.coalesce("inside", "before")["seq"].alias("holder"))


def _by_passage(unheld: DataFrame, messages: DataFrame) -> DataFrame:
    """unheld(thread, seq, level, hash, size) with the latest holder of each line's passage, where it is a passage of an earlier message."""
    lines = passages(messages).where("hash is not null").withColumn("plain", normalised(F.col("body")))
    w = W.partitionBy("thread", "seq").orderBy("pos")
    fresh = (F.col("pos") - F.lag("pos").over(w) != 1) | (F.col("level") != F.lag("level").over(w))
    lines = lines.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "plain"))), lambda x: x["plain"]), " ")
    runs = cut(lines.groupBy("thread", "seq", "at", "run", "level").agg(F.xxhash64(text).alias("whole"), F.collect_set("hash").alias("hashes")))
    quoted = runs.where("level > 0").select("thread", "seq", "at", "level", F.col("whole").alias("hash"), F.lit(0).alias("size")).distinct()
    own = runs.where("level = 0").select("thread", F.col("whole").alias("hash"), "seq", "at").distinct()
    held = _latest_holders(own, quoted).where("holder is not null").select("thread", "seq", "level", F.col("hash").alias("whole"), "holder")
    told = runs.join(held, ["thread", "seq", "level", "whole"]).select("thread", "seq", "level", F.explode("hashes").alias("hash"), "holder")
    return unheld.join(told.groupBy("thread", "seq", "level", "hash").agg(F.max("holder").alias("holder")), ["thread", "seq", "level", "hash"])


def holders(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(quoted, found, votes): quoted lines (thread, seq, at, level, hash, size); those of them that an earlier message says,
    (thread, seq, level, hash); and (thread, seq, level, holder, held) of the messages that may be linked, the best among them."""
    lines = cut(passages(messages).where("hash is not null").select("thread", "seq", "at", "level", "hash", "size"))
    quoted = lines.where("level > 0").groupBy("thread", "seq", "at", "level", "hash").agg(F.max("size").alias("size"))
    # only lines that someone quotes
    own = lines.where("level = 0").select("thread", "hash", "seq", "at").distinct().join(quoted.select("thread", "hash").distinct(), ["thread", "hash"], "left_semi")
    counts = own.groupBy("thread", "hash").agg((F.count("*") > MANY).alias("common"))
    quoted, own = cut(quoted.join(counts, ["thread", "hash"], "left")), cut(own.join(counts, ["thread", "hash"]))
    sayings = own.where("not common").select("thread", "hash", F.col("seq").alias("holder"), F.col("at").alias("said"))
    rare = quoted.where("not common").join(sayings, ["thread", "hash"]).where("said < at").select("thread", "seq", "level", "hash", "size", "holder")
    often, said = quoted.where("common").drop("common"), own.where("common").drop("common")
    latest = _latest_holders(said, often).where("holder is not null")
    rare = cut(rare)
    keys = ["thread", "seq", "level", "hash"]
    found = cut(rare.select(*keys).distinct().union(latest.select(*keys)))
    unheld = cut(quoted.select(*keys, "size").join(found, keys, "left_anti"))
    open_threads = unheld.select("thread").distinct()
    if not unheld.isEmpty():
        passage = cut(_by_passage(unheld, messages.join(open_threads, "thread", "left_semi")).select(*rare.columns))
        rare, found = rare.union(passage), found.union(passage.select(*keys))
    one_by_one = rare.groupBy("thread", "seq", "level", "holder").agg(F.sum("size").alias("held"))
    if often.isEmpty():
        return quoted, found, one_by_one
    # whoever holds a rare line is counted in full, with the common ones that it holds
    heard = said.select("thread", "hash", F.col("seq").alias("holder"))
    more = one_by_one.drop("held").join(often.drop("at"), ["thread", "seq", "level"]).join(heard, ["thread", "hash", "holder"])
    full = one_by_one.union(more.select("thread", "seq", "level", "holder", F.col("size").cast("bigint"))).groupBy("thread", "seq", "level", "holder").agg(F.sum("held").alias("held"))
    return quoted, found, full.unionByName(_together(often, said))


def _together(often: DataFrame, said: DataFrame) -> DataFrame:
    """(thread, seq, level, holder, held): of the messages before each, the latest that says most of the common lines it quotes.

    often(thread, seq, at, level, hash, size), said(thread, hash, seq, at). Quotations are taken together by the lines that
    they quote (asked), messages by those that they say (kind), so the join has a row for each two combinations of a
    thread that share a line.
    """
    lines = F.array_sort(F.collect_list(F.struct("hash", "size")))
    quotations = cut(often.groupBy("thread", "seq", "at", "level").agg(lines.alias("lines")).withColumn("asked", F.xxhash64("lines")))
    sayings = cut(said.groupBy("thread", "seq", "at").agg(F.array_sort(F.collect_set("hash")).alias("hashes")).withColumn("kind", F.xxhash64("hashes")))
    asked = quotations.select("thread", "asked", "lines").distinct().select("thread", "asked", F.explode("lines").alias("x")).select("thread", "asked", "x.hash", "x.size")
    kinds = sayings.select("thread", "kind", "hashes").distinct().select("thread", "kind", F.explode("hashes").alias("hash"))
    weights = asked.join(kinds, ["thread", "hash"]).groupBy("thread", "asked", "kind").agg(F.sum("size").alias("held"))
    able = cut(weights.join(sayings.select("thread", "kind", "seq", "at"), ["thread", "kind"]).select("thread", F.xxhash64("asked", "held").alias("hash"), "asked", "held", "seq", "at"))
    since = able.groupBy("thread", "asked", "held").agg(F.min("at").alias("since"))
    best = quotations.join(since, ["thread", "asked"]).where("since < at").groupBy("thread", "seq", "at", "level", "asked").agg(F.max("held").alias("size"))
    wanted = best.select("thread", "seq", "at", "level", F.xxhash64("asked", "size").alias("hash"), "size")
    return _latest_holders(able.select("thread", "hash", "seq", "at"), wanted).where("holder is not null").select("thread", "seq", "level", "holder", F.col("size").alias("held"))


def links(messages: DataFrame) -> DataFrame:
    """(thread, seq, level, linked): the message linked at each quote level: it says most of its characters, of equals the latest."""
    return _linked(holders(messages)[2])


def _linked(votes: DataFrame) -> DataFrame:
    return votes.groupBy("thread", "seq", "level").agg(F.max(F.struct("held", "holder"))["holder"].alias("linked"))


def replies(messages: DataFrame) -> DataFrame:
    """(thread, seq, parent, links, n_quoted, n_linked) of each quoting message: links are (level, message) by level."""
    quoted, found, votes = holders(messages)
    linked = F.array_sort(F.collect_list(F.struct("level", F.col("linked").alias("message"))))  # as many as levels
    by_message = _linked(votes).groupBy("thread", "seq").agg(linked.alias("links"), F.max(F.when(F.col("level") == 1, F.col("linked"))).alias("parent"))
    told = quoted.groupBy("thread", "seq").agg(F.count("*").alias("n_quoted"))
    held = found.groupBy("thread", "seq").agg(F.count("*").alias("n_linked"))
    return told.join(held, ["thread", "seq"], "left").join(by_message, ["thread", "seq"], "left")


def depths(linked: DataFrame) -> DataFrame:
    """(thread, seq, root, depth) of (thread, seq, parent), by doubling jumps.

    The rounds grow with the logarithm of the longest chain, and a round takes only the messages whose root isn't
    known yet: few long chains cost the many short ones nothing.
    """
    now = cut(linked.select("thread", "seq", F.coalesce("parent", "seq").alias("root"), F.col("parent").isNotNull().cast("bigint").alias("depth"), F.col("parent").isNull().alias("known")))
    known, open_rows = now.where("known"), now.where("not known")
    while not open_rows.isEmpty():
        up = known.union(open_rows).select("thread", F.col("seq").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("known").alias("settled"))
        jumped = open_rows.join(up, ["thread", "root"])
        now = cut(jumped.select("thread", "seq", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("settled").alias("known")))
        known, open_rows = known.union(now.where("known")), now.where("not known")
    return known.drop("known")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds position, from 0 in each thread in the order of seq; long threads are numbered by ranges of seq, without their texts."""
    rows = rows.withColumn("__range", F.floor(F.col("at") / RANGE).cast("bigint"))
    sizes = rows.groupBy("thread", "__range").agg(F.count("*").alias("__n"))
    before = sizes.select("thread", "__range", (F.sum("__n").over(W.partitionBy("thread").orderBy("__range")) - F.col("__n")).alias("__before"))
    at = F.row_number().over(W.partitionBy("thread", "__range").orderBy("seq")) - 1
    return rows.withColumn("__at", at).join(before, ["thread", "__range"]).withColumn("position", (F.col("__before") + F.col("__at")).cast("bigint")).drop("__range", "__before", "__at", "at")


def conversations(messages: DataFrame, every: bool = True) -> DataFrame:
    """(thread, seq, position, parent, root, depth, links, n_quoted, n_linked, role, text): one row for each message.

    messages(thread, seq, role, text). Replies stand after what they answer, since position follows seq. links are
    the messages that each quote level goes back to, as `level:seq/tie`. text is the message's own lines without
    quotations. A message that quotes nothing known is a root. No message is left out: different ones of equal thread
    and seq (role or text differ) are told apart by tie, from 0 in the order of text and role, and don't hold each
    other's quotations; only equal rows are one. Adds tie, parent_tie and root_tie. Each row without thread or seq is a
    root without a position whose quotations aren't looked up. Null and empty texts stay as empty messages; an empty
    table gives no rows; other columns aren't read.

    Without `every`, a thread has one message for each seq, the first by text (nulls first), rows without thread or seq
    are left out, and there are no ties.
    """
    rows = messages.select(F.col("thread").cast("bigint"), F.col("seq").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    keyless = rows.where("thread is null or seq is null")
    rows = rows.where("thread is not null and seq is not null")
    if every:
        tie = F.row_number().over(W.partitionBy("thread", "seq").orderBy(F.asc_nulls_first("text"), F.asc_nulls_first("role"))) - 1
        rows = rows.distinct().withColumn("tie", tie)
        rows = cut(rows.select("thread", F.struct("seq", "tie").alias("seq"), F.col("seq").alias("at"), "role", "text"))
    else:
        least = F.min(F.struct("text", "role")).alias("m")
        rows = cut(rows.groupBy("thread", "seq").agg(least).select("thread", "seq", F.col("seq").alias("at"), "m.role", "m.text"))
    linked = cut(rows.select("thread", "seq", "at").join(replies(rows), ["thread", "seq"], "left"))
    placed = linked.join(depths(linked), ["thread", "seq"])
    own_lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\r?\n|\r"), lambda x: ~x.rlike(r"^\s*>"))
    clean = F.regexp_replace(F.trim(F.array_join(own_lines, "\n")), r"^\s+|\s+$", "").alias("text")
    name = (lambda m: F.concat_ws("/", m["seq"].cast("string"), m["tie"].cast("string"))) if every else (lambda m: m.cast("string"))
    told = F.array_join(F.transform(F.coalesce("links", F.array()), lambda x: F.concat_ws(":", x["level"].cast("string"), name(x["message"]))), " ").alias("links")
    out = _numbered(placed).join(rows.select("thread", "seq", "role", clean), ["thread", "seq"]).select(
        "thread", "seq", "position", "parent", "root", "depth", told, F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "role", "text")
    if not every:
        return out
    keys = [c for n in ("parent", "root") for c in (F.col(f"{n}.seq").alias(n), F.col(f"{n}.tie").alias(f"{n}_tie"))]
    out = out.select("thread", F.col("seq.seq").alias("seq"), F.col("seq.tie").alias("tie"), "position", *keys, "depth", "links", "n_quoted", "n_linked", "role", "text")
    none = {"tie": F.lit(0), "root": F.col("seq"), "root_tie": F.lit(0), "depth": F.lit(0), "links": F.lit(""), "n_quoted": F.lit(0), "n_linked": F.lit(0)}
    alone = keyless.select("thread", "seq", "role", clean)
    return out.union(alone.select(*[(F.col(f.name) if f.name in alone.columns else none.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in out.schema]))


def as_mail(turns: DataFrame) -> DataFrame:
    """(thread, seq, role, text): turns(conv_id, turn, role, text) as a mail thread.

    Each turn quotes the turn before it, and under it, one level deeper, the one before that.
    """
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    quote = lambda c, mark: F.regexp_replace(c, "(?m)^", f"{mark} ")
    rows = turns.select("conv_id", "turn", "role", "text", F.lag("text").over(w).alias("one"), F.lag("text", 2).over(w).alias("two"))
    return rows.select(F.col("conv_id").alias("thread"), F.col("turn").alias("seq"), "role", F.concat_ws("\n", quote(F.col("two"), ">>"), quote(F.col("one"), ">"), "text").alias("text"))
