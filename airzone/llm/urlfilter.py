"""Dated URL lists joined as of the time of each capture.

List events (add or remove an entry from a date on) become validity intervals; a capture meets the interval that
holds at its fetch time, for the most specific of the entries that cover its URL. Column expressions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airzone.llm.common import only


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dots; null where the URL has none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def covering(url: Column) -> Column:
    """Every entry that would cover ``url``: its host and the domains above it, and its host with each leading part of the path."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(
        host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.concat(domains, paths)).otherwise(F.array().cast("array<string>"))


def intervals(events: DataFrame) -> DataFrame:
    """(entry, category, since, until) while an entry is listed; ``until`` is open (exclusive) or null.

    ``events`` has entry, action (add or remove), since and category. On one date a removal comes after an addition, so it
    wins; a further addition starts a new interval. An entry's categories are listed and removed on their own; a removal
    without a category ends them all. Entries are compared in lower case of the host; rows with a null entry, date or
    action count for nothing, repeated events once.
    """
    entry = F.regexp_replace(F.col("entry"), r"/+$", "")
    slash = F.instr(entry, "/")
    entry = F.when(slash > 0, F.concat(F.lower(F.left(entry, slash)), F.substring(entry, slash + 1, F.length(entry)))).otherwise(F.lower(entry))
    dated = only(events, entry=entry, action="action", since="since", category="category").where(
        "entry IS NOT NULL AND since IS NOT NULL AND action IN ('add', 'remove')").distinct()
    after = Window.partitionBy("entry", "category").orderBy("since", "action")
    wide = Window.partitionBy("entry").orderBy("since", "action", "category").rowsBetween(1, Window.unboundedFollowing)
    ends = F.min(F.when((F.col("action") == "remove") & F.col("category").isNull(), F.col("since"))).over(wide)
    return (dated.withColumn("until", F.least(F.lead("since").over(after), ends))
            .where("action = 'add' AND (until IS NULL OR until > since)").drop("action"))


def as_of(captures: DataFrame, events: DataFrame) -> DataFrame:
    """(page_id, url, fetched, listed, entry, category, since) of every capture (page_id, url, fetched).

    ``entry`` is the longest entry listed at ``fetched`` that covers the URL; of equal ones that since latest, then the
    last category. Equal captures are judged once: distinct (url, fetched) are joined with the intervals, only the
    few that meet one are shuffled on, and a very frequent URL is one row from then on.

    A null or malformed URL and a null time are listed by nothing. Repeated rows get equal answers, empty tables
    on either side give no row or nothing listed.
    """
    captures = only(captures, page_id="page_id", url="url", fetched="fetched")
    listed = intervals(events)
    seen = captures.select("url", "fetched").where("url IS NOT NULL AND fetched IS NOT NULL").distinct()
    met = (seen.select("url", "fetched", F.explode(covering(F.col("url"))).alias("entry")).join(listed, "entry")
           .where("fetched >= since AND (until IS NULL OR fetched < until)"))
    best = met.groupBy("url", "fetched").agg(F.max_by(
        F.struct("entry", "category", "since"), F.struct(F.length("entry"), F.col("entry"), F.col("since"), F.col("category"))).alias("hit"))
    return (captures.join(best, ["url", "fetched"], "left")
            .select("page_id", "url", "fetched", F.col("hit").isNotNull().alias("listed"), "hit.entry", "hit.category", "hit.since"))
