"""URL expressions. They are regular expressions rather than parse_url, which rejects blanks in paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\n\x0b\f\r\xa0"
_VALID_HOST = r"^[^\s./\\?#@:]+([.][^\s./\\?#@:]+)+$"
_HEAD = r"^([A-Za-z][A-Za-z0-9+.-]*)://"


def stripped(text: Column) -> Column:
    """Without blanks at both ends; null is empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))


def normalised(url: Column) -> Column:
    """A pasted URL with a scheme, unless it names another one; empty for nothing."""
    bare = F.regexp_replace(F.regexp_replace(stripped(url), '^"+|"+$', ""), "^'+|'+$", "")
    return (
        F.when(bare == "", "")
        .when(bare.startswith("//"), F.concat(F.lit("https:"), bare))
        .when(bare.contains("://"), bare)
        .when(F.substring_index(bare, "/", 1).contains(":"), bare)
        .otherwise(F.concat(F.lit("https://"), bare))
    )


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HEAD, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    """Host name in lower case without login and port; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":.*$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*[?]([^#]*)", 1)


def site_host(url: Column) -> Column:
    """Host of a normalised http(s) URL without a leading www. and trailing dots; null if it isn't one."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"[.]+$", ""), r"^www[.]", "")
    return F.when(scheme(url).isin("http", "https") & host.rlike(_VALID_HOST), host)


def site_path(url: Column) -> Column:
    """Path with its query in lower case."""
    query = query_of(url)
    return F.lower(F.concat(path_of(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.coalesce(url, F.lit("")), "#", 1), "/+$", "")


def last_labels(url: Column) -> Column:
    """The last two labels of a URL's host."""
    return F.regexp_extract(host_of(url), r"([^.]*[.])?[^.]*$", 0)


def same_site(a: Column, b: Column) -> Column:
    return last_labels(a) == last_labels(b)


def _without_dots(path: Column) -> Column:
    """A path without its `.` and `..` steps."""
    steps = F.filter(F.split(path, "/"), lambda s: s != ".")
    kept = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(path.rlike(r"(^|/)[.]{1,2}$"), "/").otherwise("")
    joined = F.concat(F.array_join(kept, "/"), tail)
    return F.when(path.rlike(r"(^|/)[.]{1,2}(/|$)"), F.regexp_replace(joined, "^/?", "/")).otherwise(path)


def absolute(base: Column, href: Column) -> Column:
    """A link resolved against its page; empty for fragments, scripts, mail and telephone links."""
    link = stripped(href)
    low = F.lower(link)
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    bare, rest = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"[?#].*$", 0)
    return (
        F.when((link == "") | link.startswith("#") | low.rlike("^(javascript|mailto|tel):"), "")
        .when(low.rlike(r"^[a-z][a-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0), link))
        .when(link.startswith("?"), F.concat(origin, path_of(base), link))
        .when(link.startswith("/"), F.concat(origin, _without_dots(bare), rest))
        .otherwise(F.concat(origin, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), bare)), rest))
    )


def segments(url: Column) -> Column:
    """Non-empty steps of a URL's path."""
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")


def parameter(url: Column, name: str) -> Column:
    """The first value of a query parameter; empty if it isn't there."""
    value = F.regexp_extract(F.concat(F.lit("&"), query_of(url)), f"&{name}=([^&]*)", 1)
    return F.trim(F.coalesce(F.try_url_decode(value), value))
