"""robots.txt bodies as nested columns.

A body is read inside its own row, so parsing needs no shuffle and no window,
however many lines or snapshots one host has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from gleanery.functions.text import trim_text


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def robots_lines(body: Column) -> Column:
    """Lines as array<struct<pos, field, value>>: comments, blank lines and lines
    without a colon removed."""

    def read(line: Column, i: Column) -> Column:
        text = F.substring_index(line, "#", 1)
        return F.struct(
            i.alias("pos"),
            F.when(
                F.contains(text, F.lit(":")), trim_text(F.lower(F.substring_index(text, ":", 1)))
            ).alias("field"),
            trim_text(F.regexp_extract(text, r"(?s)^[^:]*:(.*)$", 1)).alias("value"),
        )

    return F.filter(F.transform(F.split(body, "\n"), read), lambda x: x["field"].isNotNull())


def robots_groups(body: Column) -> Column:
    """array<struct<agents, rules>>: consecutive User-agent lines share the rules
    below them; agent names are lower-cased; rules keep their line number."""

    def grouped(lines: Column) -> Column:
        # A group starts at an agent line that does not follow another agent line.
        def start(line: Column, i: Column) -> Column:
            opens = (line["field"] == "user-agent") & (
                (i == 0) | (F.get(lines, i - 1)["field"] != "user-agent")
            )
            return F.when(opens, i)

        starts = F.filter(F.transform(lines, start), lambda s: s.isNotNull())

        def one_group(s: Column, g: Column, all_starts: Column) -> Column:
            stop = F.coalesce(F.get(all_starts, g + 1), F.size(lines))
            part = F.slice(lines, s + 1, stop - s)
            agents = F.transform(
                F.filter(part, lambda x: x["field"] == "user-agent"), lambda x: F.lower(x["value"])
            )
            rules = F.transform(
                F.filter(
                    part, lambda x: x["field"].isin("allow", "disallow") & (x["value"] != "")
                ),
                lambda x: F.struct(
                    x["value"].alias("path"),
                    (x["field"] == "allow").alias("allow"),
                    x["pos"].alias("pos"),
                ),
            )
            return F.struct(
                F.array_distinct(F.filter(agents, lambda a: a != "")).alias("agents"),
                rules.alias("rules"),
            )

        return _bind(
            starts,
            lambda all_starts: F.transform(all_starts, lambda s, g: one_group(s, g, all_starts)),
        )

    return _bind(robots_lines(body), grouped)


def rules_for_agent(groups: Column, agent: Column) -> Column:
    """Rules of the named agent (ignoring case), else of `*`, else none.

    An agent that is named without rules has an empty list: everything is allowed.
    """

    def pick(name: Column) -> Column:
        return F.filter(groups, lambda g: F.array_contains(g["agents"], name))

    def rules(selected: Column) -> Column:
        return F.flatten(F.transform(selected, lambda g: g["rules"]))

    own = pick(F.lower(agent))
    return F.when(F.size(own) > 0, rules(own)).otherwise(rules(pick(F.lit("*"))))


def prepared_rules(rules: Column) -> Column:
    """Rules as prefixes, in structs that sort by precedence: longer prefix, then
    earlier line. A trailing `*` stands for any rest."""

    def prepare(rule: Column) -> Column:
        prefix = F.regexp_replace(rule["path"], r"[*]$", "")
        return F.struct(
            F.length(prefix).alias("n"),
            (-rule["pos"]).alias("p"),
            rule["allow"].alias("allow"),
            prefix.alias("prefix"),
        )

    return F.transform(rules, prepare)


def is_allowed(prepared: Column, path: Column) -> Column:
    """Verdict of the rule of highest precedence that matches; none: allowed."""
    best = F.array_max(F.filter(prepared, lambda r: F.startswith(path, r["prefix"])))
    return F.coalesce(best["allow"], F.lit(True))


def robots_sitemap_urls(body: Column) -> Column:
    lines = F.filter(
        robots_lines(body), lambda x: (x["field"] == "sitemap") & (x["value"] != "")
    )
    return F.transform(lines, lambda x: x["value"])


def robots_delay_seconds(body: Column) -> Column:
    """The last positive whole number given as crawl delay, null if none."""
    lines = F.filter(robots_lines(body), lambda x: x["field"] == "crawl-delay")
    numbers = F.transform(
        lines, lambda x: F.regexp_extract(x["value"], r"^[+]?(\d+)", 1).try_cast("int")
    )
    return F.try_element_at(F.filter(numbers, lambda n: n > 0), F.lit(-1))
