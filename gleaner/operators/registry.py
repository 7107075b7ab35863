"""Adapters as data: the vendors that a run knows, and more of a user's own.

A rule is a dictionary as in vendors.API_RULES (an interface), a posting URL's pattern as in HOSTED_RULES, or a row
layout as in ROW_RULES. It is tried out when it is registered; one that doesn't load is skipped with its reason, and
boards of its vendor then have no adapter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.operators import markup, vendors

#: What each of a rule's fields may be; the first three have to be there.
_FIELDS = {"board": str, "title": list, "location": list, "lists": list, "urls": list, "id": list, "template": str, "country": list, "parts": dict, "xml": bool, "shape": bool, "http": bool, "relative": bool, "more": str, "also": str}


class Registry:
    """Readers by platform. `skipped` holds the reason for each rule that didn't load."""

    def __init__(self, api: dict[str, dict] | None = None, hosted: list[tuple] | None = None, rows: dict[str, dict] | None = None, hosts: list[tuple] | None = None):
        self.api, self.hosted, self.row_rules, self.hosts = dict(api or {}), list(hosted or []), dict(rows or {}), list(hosts or [])
        self.skipped: dict[str, str] = {}

    def copy(self) -> Registry:
        other = Registry(self.api, self.hosted, self.row_rules, self.hosts)
        other.skipped = dict(self.skipped)
        return other

    def _add(self, label: str, hosts: list[str], why: str | None) -> bool:
        if not why and (not label or not hosts or not all(re.fullmatch(r"[a-z0-9-]+([.][a-z0-9-]+)+", h) for h in hosts)):
            why = "no label, or hosts that aren't lower-case domain names"
        if why:
            self.skipped[label] = why
            return False
        self.skipped.pop(label, None)
        self.hosts.insert(0, (label, hosts, []))
        return True

    def register_interface(self, label: str, hosts: list[str], rule: dict) -> bool:
        """Adds a vendor's interface; `parts` names the pieces of a board's URL by patterns with one group each."""
        missing = [f for f in ("board", "title", "location") if f not in rule]
        wrong = [f for f, v in rule.items() if f not in _FIELDS or not isinstance(v, _FIELDS[f])]
        why = f"without {', '.join(missing)}" if missing else f"not understood: {', '.join(map(str, wrong))}" if wrong else None
        if not why and not rule.get("xml") and not rule.get("lists"):
            why = "without lists"
        if not why:
            try:
                groups = {n: re.compile(p).groups for n, p in rule.get("parts", {}).items()}
                why = next((f"part {n} has {g} groups" for n, g in groups.items() if g != 1), None)
            except re.error as e:
                why = f"a part's pattern: {e}"
        if not why:
            known = {"id", "url", *rule.get("parts", {})}
            loose = [x for t in (rule["board"], rule.get("template", "")) for x in re.findall(r"[{](\w+)[}]", t) if x not in known]
            why = f"no part {loose[0]}" if loose else None
        if self._add(label, hosts, why):
            self.api[label] = {"urls": [], "id": [], "parts": {}} | rule
        return label in self.api and label not in self.skipped

    def register_pattern(self, label: str, hosts: list[str], pattern: str, follow: str = "next") -> bool:
        """Adds a vendor whose posting URLs match a pattern; `follow` says how its pages follow: next, one, or an ending with {i}."""
        try:
            re.compile(pattern)
            why = None
        except re.error as e:
            why = f"the pattern: {e}"
        if self._add(label, hosts, why):
            self.hosted.append((label, hosts, pattern, follow))
            return True
        return False

    def register_rows(self, label: str, hosts: list[str], rule: dict) -> bool:
        """Adds a vendor whose boards are read row by row."""
        names = {"href", "row_class", "place_class", "title_class", "row_tags", "title_tags"}
        wrong = [f for f in rule if f not in names]
        if self._add(label, hosts, f"not understood: {', '.join(wrong)}" if wrong else None):
            self.row_rules[label] = rule
            return True
        return False

    def has(self, label: str) -> bool:
        return label in self.api or label in self.row_rules or label == fixed.GENERIC or any(r[0] == label for r in self.hosted)

    def rules(self) -> list[tuple]:
        """Host rules for detection, a user's own first."""
        return [*self.hosts, *fixed.RULES] if self.hosts else fixed.RULES

    def pattern(self, platform: Column) -> Column:
        return vendors.pattern_of(platform, self.hosted)

    def layouts(self) -> dict[str, dict]:
        return markup.layouts_of(self.row_rules)

    def page_template(self, platform: Column) -> Column:
        """How the pages of a platform's boards follow, for paging.walk: an ending for the board's URL, or null for pagers."""
        out = F.lit(None).cast("string")
        for label, _, _, follow in self.hosted:
            if follow not in ("next", "one"):
                out = F.when(platform == label, follow.replace("{10*i}", "{offset:10}")).otherwise(out)
        return out

    def api_postings(self, payloads: DataFrame, label: str, keep: list[str] | None = None) -> DataFrame:
        """Postings with the countries that their vendor states; others aren't derived yet."""
        return vendors.api_postings(payloads, label, keep, self.api[label], countries=False)

    def api_errors(self, payloads: DataFrame, label: str, keep: list[str] | None = None) -> DataFrame:
        return vendors.api_errors(payloads, label, keep, self.api[label])


#: All vendors that this library knows.
BUILT_IN = Registry(vendors.API_RULES, vendors.HOSTED_RULES, vendors.ROW_RULES)
