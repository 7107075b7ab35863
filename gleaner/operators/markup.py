"""Postings of captured pages. Each page is parsed once in a task; which links, objects and fields are
postings is then decided by DataFrame operations.

pages: (page_id, url, html, company_name, platform, career_page_url); other columns aren't read. A page is known by a
key of its own (page_key), so pages without page_id, or two captures under one, stay apart.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import texts, urls
from gleaner.functions.fixed import COUNTRY_KEYS, LOCATION_KEYS, LOCATION_TEXT, SIGNAL_KEYS, TITLE_KEYS, URL_KEYS
from gleaner.functions.binding import held, once
from gleaner.functions.lineage import cut
from gleaner.operators import dom
from gleaner.operators.jobs import dedupe, stated_jobs, with_countries

PAGE = ["page_key", "page_id", "url", "company_name", "platform", "career_page_url"]
_PAGE_TYPES = "page_key bigint, page_id bigint, url string, company_name string, platform string, career_page_url string"
_NODES = _PAGE_TYPES + ", kind string, pos int, href string, text string, inner string, shape string, card string, near array<string>, heads array<string>, places array<string>, body string, title string, place string"
#: Ranks of the ways to read a page; the first that yields postings counts.
PATTERN, LINKED_DATA, MICRODATA, CARDS, APPLY, STATE = range(6)


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(types: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split(" ") for x in types.split(", "))])


def spread(rows: DataFrame) -> DataFrame:
    """rows in at least as many partitions as there are cores: few files of pages would be parsed in few tasks."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def parsed(pages: DataFrame, layouts: dict[str, dict] | None = None) -> DataFrame:
    """One row for each link, linked-data object, microdata item and payload of a page (`kind`), in document order.

    Pages whose platform has a layout (see vendor_rows) give its rows too. URLs are resolved and titles tested once, here:
    `target`, whether it reads like a posting's (`job`), and titles in and near the link (`titled`, `inner_titled`,
    `lead`, `head`). The result is laid down, so that no page is parsed, and no link resolved, again for each way.
    """
    schema = _arrow(_NODES)
    layouts = layouts or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for page in b.to_pylist():
                key += 1
                tree = dom.Tree(page.pop("html") or "")
                page["page_key"] = key
                if layout := layouts.get(page["platform"]):
                    rows += [page | {"kind": "row"} | x for x in dom.rows(tree, **layout)]
                rows += [page | {"kind": "link"} | x for x in dom.links(tree)]
                for kind, found in (("ld", dom.linked_data(tree)), ("item", dom.microdata(tree))):
                    rows += [page | {"kind": kind, "pos": i, "body": json.dumps(x)} for i, x in enumerate(found)]
                rows += [page | {"kind": "payload", "pos": i, "body": x} for i, x in enumerate(dom.payloads(tree))]
                if len(rows) > 10_000:
                    yield _table(rows, schema)
                    rows = []
            if rows:
                yield _table(rows, schema)

    cols = [F.col("page_id").cast("bigint").alias("page_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in PAGE[2:]], F.col("html").cast("string").alias("html")]
    nodes = spread(pages.select(*cols)).mapInArrow(run, _NODES)
    is_link = F.col("kind") == "link"
    nodes = held(nodes, {"target": F.when(is_link | (F.col("kind") == "row"), once("href at url", lambda: urls.absolute(F.col("url"), F.col("href"))))})
    first_title = lambda c: F.try_element_at(F.filter(c, texts.looks_like_title), F.lit(1))
    told = once("links told", lambda: {
        "job": is_link & texts.looks_like_job_url(F.col("target")), "titled": is_link & texts.looks_like_title(F.col("text")),
        "inner_titled": is_link & (F.col("text") == "") & texts.looks_like_title(F.col("inner")), "lead": F.when(is_link, first_title("near")), "head": F.when(is_link, first_title("heads"))})
    return cut(held(nodes, told).drop("near", "heads"))


def _place(title: Column) -> Column:
    """The first hinted text that isn't the title, else a "City, ST" in the card."""
    hinted = F.filter("places", lambda x: (x != "") & (x != title) & (F.length(x) <= 120))
    rest = F.replace(F.col("card"), title, F.lit(" "))
    return F.coalesce(F.try_element_at(hinted, F.lit(1)), F.trim(F.regexp_extract(rest, LOCATION_TEXT, 1)))


def _raw(rows: DataFrame, rank: int, title: Column, url: Column, place: Column, country: Column | None = None, order: str = "pos") -> DataFrame:
    return rows.select(*[c for c in PAGE if c != "url"], F.lit(rank).alias("rank"), F.col(order).alias("pos"), title.alias("title"), url.alias("url"),
                       place.alias("location"), (country if country is not None else F.lit("")).alias("country"), F.col("url").alias("page_url"))


def from_linked_data(nodes: DataFrame) -> DataFrame:
    """Postings of schema.org objects."""
    field = lambda path, kind="string": F.try_variant_get("v", path, kind)
    text = lambda *paths: F.coalesce(*[F.nullif(texts.clean(field(p)), F.lit("")) for p in paths], F.lit(""))
    rows = nodes.where("kind = 'ld'").withColumn("v", F.try_parse_json("body"))
    kinds = F.coalesce(field("$['@type']", "array<string>"), F.array(F.coalesce(field("$['@type']"), field("$.type"))))
    rows = rows.where(F.exists(kinds, lambda k: F.lower(F.trim(k)) == "jobposting"))
    first = lambda name: [f"$.{name}[0]", f"$.{name}"]  # noqa: E731  a list's first member, or the value itself
    place = F.coalesce(*[F.when(field(p, "map<string,variant>").isNotNull(), F.lit(p)) for p in first("jobLocation")])
    parts = []
    for base in first("jobLocation"):
        for address in (f"{base}.address[0]", f"{base}.address"):
            whole = F.when(field(address, "map<string,variant>").isNull(), text(address))
            joined = F.array_join(F.filter(F.array(text(f"{address}.addressLocality"), text(f"{address}.addressRegion"),
                                                   F.when(field(f"{address}.addressCountry", "map<string,variant>").isNull(), text(f"{address}.addressCountry")).otherwise(
                                                       text(f"{address}.addressCountry.name", f"{address}.addressCountry.identifier"))), lambda x: x != ""), ", ")
            parts += [F.nullif(whole, F.lit("")), F.nullif(joined, F.lit(""))]
        parts.append(F.nullif(text(f"{base}.name"), F.lit("")))
    remote = F.when(place.isNull(), text("$.applicantLocationRequirements.name"))
    target = F.coalesce(*[F.nullif(field(p), F.lit("")) for p in ("$.url", "$['@id']", "$.sameAs")], F.lit(""))
    return _raw(rows, LINKED_DATA, text("$.title", "$.name"), urls.absolute(F.col("url"), target), F.coalesce(*parts, remote, F.lit("")))


def from_microdata(nodes: DataFrame) -> DataFrame:
    rows = nodes.where("kind = 'item'").withColumn("m", F.from_json("body", "map<string,string>"))
    get = lambda *names: F.coalesce(*[F.nullif(F.try_element_at("m", F.lit(n)), F.lit("")) for n in names], F.lit(""))
    return _raw(rows, MICRODATA, get("title", "name"), urls.absolute(F.col("url"), get("url")), get("jobLocation", "addressLocality"))


def _links(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'link' and target <> ''")


def from_cards(nodes: DataFrame) -> DataFrame:
    """Postings of a page's largest group of links that stand alike; of all its links if no group has three.

    Groups are those of one page, so their windows are as small as a page.
    """
    rows = _links(nodes).where("job and (titled or inner_titled)").withColumn("title", F.when(F.col("text") != "", F.col("text")).otherwise(F.col("inner")))
    group = W.partitionBy("page_key", "shape")
    rows = rows.withColumn("n", F.count("*").over(group)).withColumn("first", F.min("pos").over(group))
    best = F.max(F.struct("n", -F.col("first"))).over(W.partitionBy("page_key"))
    chosen = rows.withColumn("best", best).where("best.n < 3 or (n = best.n and first = -best.col2)")
    return _raw(chosen, CARDS, F.col("title"), F.col("target"), _place(F.col("title")))


def from_apply_links(nodes: DataFrame) -> DataFrame:
    """Postings of links that only say "Apply": the title stands near them; of one URL the first counts."""
    rows = _links(nodes).where("job and not titled and lead is not null")
    first = rows.withColumn("again", F.row_number().over(W.partitionBy("page_key", "target").orderBy("pos"))).where("again = 1")
    return _raw(first, APPLY, F.col("lead"), F.col("target"), _place(F.col("lead")))


def from_pattern(nodes: DataFrame, pattern: Column) -> DataFrame:
    """Postings of links whose URL the vendor's pattern takes (null: none), but for links to the page itself."""
    own = [urls.without_fragment(F.col(c)) for c in ("url", "career_page_url")]
    rows = _links(nodes).where("titled or head is not null").where(F.regexp_like(F.col("target"), pattern) & ~urls.without_fragment(F.col("target")).isin(own))
    title = F.when(F.col("titled"), F.col("text")).otherwise(F.col("head"))
    return _raw(rows, PATTERN, title, F.col("target"), _place(title))


def from_layout(nodes: DataFrame) -> DataFrame:
    """Postings of the rows that a vendor's layout took."""
    rows = nodes.where("kind = 'row'").withColumn("found", F.when(F.col("place") == F.col("title"), "").otherwise(F.col("place")))
    return _raw(rows, PATTERN, F.col("title"), F.col("target"), F.col("found"))


_OBJECTS = _PAGE_TYPES + ", pos int, seq int, keys array<string>, title string, targets array<string>, place string, country string, identity string"


def shaped_objects(payloads: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Every object in payloads(PAGE, pos, body) with its keys and the texts of its telling fields.

    identity is the first text of the fields `ids`. Bodies that aren't JSON have no objects.
    """
    schema = _arrow(_OBJECTS)

    def target(key: str, value: object) -> str:
        if isinstance(value, dict):
            value = value.get("href") or value.get("url") or value.get("value")
        value = value.strip() if isinstance(value, str) else ""
        return "" if key == "slug" and "/" not in value else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                rows = []
                for seq, found in enumerate(dom.objects(dom.decoded(row.pop("body") or ""))):
                    flat = dom.flat_keys(found)
                    title = dom.first_of(flat, TITLE_KEYS)
                    if title:
                        rows.append(row | {"seq": seq, "keys": sorted(flat), "title": title, "targets": [target(k, flat[k]) for k in URL_KEYS if k in flat],
                                           "place": dom.first_of(flat, LOCATION_KEYS), "country": dom.first_of(flat, COUNTRY_KEYS), "identity": dom.first_of(flat, ids or [])})
                if rows:
                    yield _table(rows, schema)

    return payloads.select(*PAGE, "pos", "body").mapInArrow(run, _OBJECTS)


def from_payloads(payloads: DataFrame, ids: list[str] | None = None, link: Column | None = None) -> DataFrame:
    """Postings of the payloads' largest group of objects with equal keys, one of which only postings have.

    Of groups of one size, that with most such keys counts, then the one seen first. link is the URL of objects
    that name none, by their column identity (see shaped_objects).
    """
    rows = shaped_objects(payloads, ids).where(texts.plausible_title(F.col("title")))
    signals = F.size(F.array_intersect("keys", F.array(*map(F.lit, sorted(SIGNAL_KEYS)))))
    rows = rows.withColumn("shape", F.array_join("keys", "\x1f")).withColumn("signals", signals).where("signals > 0")
    group = W.partitionBy("page_key", "pos", "shape")
    rows = rows.withColumn("n", F.count("*").over(group)).withColumn("first", F.min("seq").over(group))
    best = F.max(F.struct("n", "signals", -F.col("first"))).over(W.partitionBy("page_key", "pos"))
    rows = rows.withColumn("best", best).where("best.col3 = -first")
    found = F.filter(F.transform("targets", lambda t: urls.absolute(F.col("url"), t)), lambda t: t != "")
    own = F.coalesce(F.try_element_at(found, F.lit(1)), link if link is not None else F.lit(""))
    rows = held(rows, {"target": own})
    return _raw(rows.withColumn("order", F.col("pos").cast("bigint") * F.lit(1 << 32) + F.col("seq")), STATE, F.col("title"), F.col("target"), F.col("place"), F.col("country"), "order").withColumn("payload", F.shiftright("pos", 32))


def from_state(nodes: DataFrame) -> DataFrame:
    """Postings of the first payload of a page, the longest first, that yields any."""
    rows = from_payloads(nodes.where("kind = 'payload'").select(*PAGE, "pos", "body")).where("trim(title) <> '' and url <> ''")
    return rows.withColumn("first", F.min("payload").over(W.partitionBy("page_key"))).where("payload = first").drop("payload", "first")


def ways(nodes: DataFrame, pattern: Column | None = None, state: bool = True, layout: bool = False) -> DataFrame:
    """Raw postings of parsed pages by every way of reading them, for first_way."""
    read = [from_linked_data(nodes), from_microdata(nodes), from_cards(nodes), from_apply_links(nodes)]
    if pattern is not None:
        read.insert(0, from_pattern(nodes, pattern))
    if layout:
        read.insert(0, from_layout(nodes))
    if state:
        read.append(from_state(nodes))
    return reduce(DataFrame.unionByName, read)


def chain(nodes: DataFrame, pattern: Column | None = None, state: bool = True, layout: bool = False) -> DataFrame:
    """(page_id, rank, pos, posting fields): postings of each page by the first way of reading it that yields any."""
    return finished(ways(nodes, pattern, state, layout))


def first_way(rows: DataFrame, *keep: str) -> DataFrame:
    """(page_key, page_id, rank, pos, posting fields) of rows read in any ways: of each page those of the first way that yields any, without countries."""
    board = F.when(F.col("career_page_url") != "", F.col("career_page_url")).otherwise(F.col("page_url"))
    jobs = cut(stated_jobs(rows.withColumn("career_page_url", board), "page_key", "page_id", "rank", "pos", *keep))
    least = jobs.groupBy("page_key").agg(F.min("rank").alias("rank"))
    return dedupe(jobs.join(least, ["page_key", "rank"], "left_semi"), ["rank", "pos"], ["page_key"])


def finished(rows: DataFrame) -> DataFrame:
    """(page_id, rank, pos, posting fields): first_way with countries."""
    return with_countries(first_way(rows)).drop("page_key")


def extract_jobs(pages: DataFrame, state: bool = True) -> DataFrame:
    """Postings of pages of any kind."""
    return chain(parsed(pages), None, state)


def vendor_rows(pages: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Postings by the row layout of a page's platform (platform -> rule, as vendors.ROW_RULES), else by any page's ways."""
    return chain(parsed(pages, layouts_of(rules)), state=False, layout=True)


def layouts_of(rules: dict[str, dict]) -> dict[str, dict]:
    """Rules with all fields that dom.rows takes."""
    names = ("href", "row_class", "place_class", "title_class")
    return {k: {n: r.get(n, "") for n in names} | {"row_tags": r.get("row_tags", []), "title_tags": r.get("title_tags", [])} for k, r in rules.items()}
