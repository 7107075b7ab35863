"""Where a paged listing ends, on tables of captured pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.lineage import cut
from gleaner.operators.links import page_pagers


def pages_with_news(found: DataFrame, most: int = 50) -> DataFrame:
    """(board, page_no, found, added): the pages that a walk over found(board, page_no, key) reads.

    added counts the keys that no earlier page of the board has. A walk reads pages from 0 on and ends after
    the first that adds nothing, at a missing page, or at `most` pages.
    """
    first = found.groupBy("board", "key").agg(F.min("page_no").alias("page_no"))
    added = first.groupBy("board", "page_no").agg(F.count("*").alias("added"))
    pages = found.groupBy("board", "page_no").agg(F.count("*").alias("found")).join(added, ["board", "page_no"], "left").fillna(0, ["added"])
    w = W.partitionBy("board").orderBy("page_no")
    gap = (F.row_number().over(w) - 1) != F.col("page_no")
    dry = (F.lag("added", 1, 1).over(w) == 0) | gap | (F.col("page_no") >= most)
    ended = F.max(dry.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = pages.withColumn("gap", gap).withColumn("dry", dry).withColumn("ended", ended)
    return marked.where("ended = 0").select("board", "page_no", "found", "added")


def next_chain(edges: DataFrame, starts: DataFrame, most: int = 25) -> DataFrame:
    """(board, step, url): pages reached from starts(board, url) by edges(board, url, next_url, place).

    From each page the first link, by place, to a page not yet visited is followed, up to `most` pages. All
    boards take a step at a time: a step is one join of the boards still under way, each with the at most
    `most` URLs that it has visited, and is written to the checkpoint folder.
    """
    first = edges.groupBy("board", "url", "next_url").agg(F.min("place").alias("place"))
    # of `most` targets one at least isn't visited yet
    targets = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "next_url"))), lambda x: x["next_url"]), 1, most)
    listed = cut(first.groupBy("board", "url").agg(targets.alias("targets")))
    now = cut(starts.select("board", "url").distinct().withColumn("visited", F.array("url")))
    steps = [now]
    for _ in range(most - 1):
        fresh = F.try_element_at(F.filter("targets", lambda t: ~F.array_contains("visited", t)), F.lit(1))
        found = now.join(listed, ["board", "url"]).select("board", fresh.alias("url"), "visited").where("url is not null")
        now = cut(found.withColumn("visited", F.array_append("visited", F.col("url"))))
        if now.isEmpty():
            break
        steps.append(now)
    walked = [x.select("board", F.lit(i).cast("bigint").alias("step"), "url") for i, x in enumerate(steps, 1)]
    return reduce(DataFrame.unionByName, walked)


def page_walk(pages: DataFrame, start: str, most: int = 25) -> DataFrame:
    """(board, step, url): the walk along the pagers of pages(board, page_id, url, html), from start, in which {k} is the board."""
    boards = pages.select("page_id", "board", "url")
    edges = page_pagers(pages.select("page_id", "url", "html")).join(boards.select("page_id", "board"), "page_id")
    starts = boards.select("board").distinct().withColumn("url", F.replace(F.lit(start), F.lit("{k}"), F.col("board").cast("string")))
    return next_chain(edges.select("board", F.col("base").alias("url"), F.col("url").alias("next_url"), "place"), starts, most)


def incomplete_boards(found: DataFrame) -> DataFrame:
    """(board, n, total) of boards whose distinct keys are fewer than the total that their pages tell."""
    rows = found.groupBy("board").agg(F.countDistinct("key").alias("n"), F.max("total").alias("total"))
    return rows.where("n < total")


def offsets_read(pages: DataFrame, size: int, most: int) -> DataFrame:
    """(board, page_no, n, ends): the pages of pages(board, page_no, n, total) that a walk by offset reads.

    It ends at an empty or short page, when the offset reaches the total, or after `most` pages; a board that
    then isn't at its end is marked as not ended.
    """
    w = W.partitionBy("board").orderBy("page_no").rowsBetween(W.unboundedPreceding, 0)
    total = F.first("total", True).over(w)
    stop = (F.col("n") < size) | F.coalesce(F.sum("n").over(w) >= total, F.lit(False))
    rows = pages.where(F.col("page_no") < most).withColumn("stop", stop.cast("int"))
    before = F.coalesce(F.max("stop").over(W.partitionBy("board").orderBy("page_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    read = rows.withColumn("before", before).where("before = 0")
    return read.select("board", "page_no", "n", (F.col("stop") == 1).alias("ends"))


def walk(starts: DataFrame, pages: DataFrame, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """(board, step, url) of the captured pages that boards lead to, and (board, reason) why each walk ends.

    starts(board, url, template): a template names the next pages by {i}, the page's number from 1, or {offset:n}, n for
    each page before; without one (null), a page's pager is followed, the first link to a page not yet visited.
    pages(url, html) are those captured. All boards take a step at a time, a step is one join of those still under way.
    A start that wasn't captured is in neither. Reasons: no next page, back to a page, page missing, page limit.
    """
    known = cut(pages.select("url").distinct())
    numbered = pages.select(F.monotonically_increasing_id().alias("page_id"), "url", "html")
    edges = page_pagers(numbered).groupBy(F.col("base").alias("url"), F.col("url").alias("to")).agg(F.min("place").alias("place"))
    targets = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "to"))), lambda x: x["to"]), 1, most)
    listed = cut(edges.groupBy("url").agg(targets.alias("targets")))
    first = starts.select("board", "url", F.col("template").cast("string").alias("template")).join(known, "url", "left_semi")
    now = cut(first.withColumn("visited", F.array("url")))
    steps, ends = [now.select("board", F.lit(1).cast("bigint").alias("step"), "url")], []
    for step in range(2, most + 2):
        fresh = F.try_element_at(F.filter("targets", lambda t: ~F.array_contains("visited", t)), F.lit(1))
        size = F.regexp_extract("template", r"[{]offset:(\d+)[}]", 1)
        offset = (F.when(size != "", size).otherwise("0").cast("bigint") * (step - 1)).cast("string")
        named = F.regexp_replace(F.replace(F.col("template"), F.lit("{i}"), F.lit(str(step))), F.lit(r"[{]offset:\d+[}]"), offset)
        ahead = now.join(listed, "url", "left").select(
            "board", "template", "visited", F.when(F.col("template").isNotNull(), F.concat(F.element_at("visited", 1), named)).otherwise(fresh).alias("url"),
            F.when(F.size(F.coalesce("targets", F.array())) > 0, "back to a page").otherwise("no next page").alias("reason"))
        ahead = cut(ahead.join(known.withColumn("there", F.lit(True)), "url", "left"))
        ends.append(ahead.where("url is null or there is null").select("board", F.when(F.col("url").isNull(), F.col("reason")).otherwise("page missing").alias("reason")))
        now = ahead.where("there").select("board", "template", F.array_append("visited", F.col("url")).alias("visited"), "url")
        if step == most + 1:
            ends.append(now.select("board", F.lit("page limit").alias("reason")))
            break
        if now.isEmpty():
            break
        steps.append(now.select("board", F.lit(step).cast("bigint").alias("step"), "url"))
    return cut(reduce(DataFrame.unionByName, steps)), cut(reduce(DataFrame.unionByName, ends))


def read_until_dry(found: DataFrame, steps: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What walks read of found(board, step, key): (board, key, step), each key where it is first read, and (board, pages, keys, reason).

    A walk ends after the first page that adds no key that its board hasn't had: nothing new. Later steps aren't read.
    """
    first = found.groupBy("board", "key").agg(F.min("step").alias("step"))
    added = first.groupBy("board", "step").agg(F.count("*").alias("added"))
    dry = steps.join(added, ["board", "step"], "left").where("added is null").groupBy("board").agg(F.min("step").alias("dry"))
    read = first.join(dry, "board", "left").where("dry is null or step < dry").drop("dry")
    counts = steps.join(dry, "board", "left").where("dry is null or step <= dry").groupBy("board").agg(F.count("*").alias("pages"), F.first("dry").alias("dry"))
    keys = read.groupBy("board").agg(F.count("*").alias("keys"))
    told = counts.join(keys, "board", "left").join(ends, "board", "left")
    return read, told.select("board", "pages", F.coalesce("keys", F.lit(0)).cast("bigint").alias("keys"), F.when(F.col("dry").isNotNull(), "nothing new").otherwise(F.col("reason")).alias("reason"))


def token_chains(pages: DataFrame, found: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(board, token, step, key) of the boards whose chain of pages is whole, and (board, pages, state, error) of every board.

    pages(board, token, next_token), where the first page's token is null or empty; found(board, token, key) are their
    postings. A chain ends at a page without a next token or without postings. One that loses a page, comes back to one,
    has a page of known postings only, or has more than `most` pages isn't a shorter list but an error. Steps are found by
    doubling jumps, so the rounds grow with the logarithm of `most`; boards without a first page are cut at it.
    """
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    found = found.select("board", name("token").alias("token"), "key").distinct()
    full = found.groupBy("board", "token").agg(F.count("*").alias("n"))
    one = pages.select("board", name("token").alias("token"), name("next_token").alias("next")).groupBy("board", "token").agg(F.min("next").alias("next"))
    known = cut(one.join(full, ["board", "token"], "left").select("board", "token", F.when((F.col("next") != "") & (F.col("n") > 0), F.col("next")).alias("to")))
    jump = cut(known.where("to is not null"))
    reached = known.select("board").distinct().select("board", F.lit("").alias("token"), F.lit(1).cast("bigint").alias("step"), F.lit(False).alias("again"))
    length = 1
    while length <= most:
        further = reached.join(jump, ["board", "token"]).select("board", F.col("to").alias("token"), (F.col("step") + length).alias("step"), "again")
        steps = reached.unionByName(further).groupBy("board", "token").agg(F.min("step").alias("step"), F.max("step").alias("last"), F.max("again").alias("again"))
        reached = cut(steps.select("board", "token", "step", (F.col("again") | (F.col("step") < F.col("last"))).alias("again")))
        onward = jump.select("board", F.col("token").alias("to"), F.col("to").alias("beyond"))
        jump = cut(jump.join(onward, ["board", "to"]).select("board", "token", F.col("beyond").alias("to")))
        length *= 2
    read = cut(reached.join(known.withColumn("there", F.lit(True)), ["board", "token"], "left"))
    first = cut(read.where("there").select("board", "token", "step").join(found, ["board", "token"]).groupBy("board", "key").agg(F.min(F.struct("step", "token")).alias("x")).select("board", "key", "x.step", "x.token"))
    fresh = first.select("board", "step").distinct().withColumn("fresh", F.lit(True))
    # what ends a chain, by the step at which it shows
    at = read.join(fresh, ["board", "step"], "left").join(full, ["board", "token"], "left")
    event = F.when(F.col("step") > most, F.struct("step", F.lit("endless").alias("state"))).when(F.col("there").isNull(), F.struct("step", F.lit("cut").alias("state"))).when(
        (F.col("n") > 0) & F.col("fresh").isNull(), F.struct("step", F.lit("repeated").alias("state"))).when(F.col("to").isNull(), F.struct("step", F.lit("complete").alias("state")))
    ends = at.groupBy("board").agg(F.min(event).alias("end"), F.max("step").alias("deepest"))
    told = ends.select("board", F.coalesce("end.step", F.col("deepest") + 1).alias("step"), F.coalesce("end.state", F.lit("cyclic")).alias("state"))
    error = (F.when(F.col("state") == "cut", F.concat(F.lit("AdapterHttpError: page "), F.col("step").cast("string"), F.lit(" is missing")))
             .when(F.col("state") == "repeated", F.concat(F.lit("AdapterHttpError: page "), F.col("step").cast("string"), F.lit(" repeats known postings")))
             .when(F.col("state") != "complete", "AdapterHttpError: paging did not terminate"))
    status = cut(told.select("board", F.when(F.col("state") == "complete", F.col("step")).otherwise(F.col("step") - 1).alias("pages"), "state", error.alias("error")))
    return first.join(status.where("state = 'complete'").select("board"), "board", "left_semi").select("board", "token", "step", "key"), status
