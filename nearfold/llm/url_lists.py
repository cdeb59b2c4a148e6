"""URL filters by dated lists: validity intervals and an as-of join. DataFrame functions only.

A list changes by dated entries (add or remove a key). Entries become intervals in
which a key is on a list; a capture is evaluated against the intervals that hold on the day it
was fetched, for its host and every parent domain of two labels or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from nearfold.plans.storage import written

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, "" if it has none, null for null."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def host_keys(host: Column) -> Column:
    """The host and its parent domains of two labels or more; the host alone if it has one label."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), "."))
    return F.when(host != "", parents).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, key, from_day, to_day): ``entries`` has list, verdict, key, day and added (boolean).

    A key is on the list from the day it is added to the day it is removed (not included), or for good. Of entries of
    one list, verdict, key and day "added" wins; entries that change nothing are merged; a removal before any addition
    is ignored. Entries with a null field are ignored.
    """
    known = entries.select("list", "verdict", "key", "day", "added").dropna()
    daily = known.groupBy("list", "verdict", "key", "day").agg(F.max("added").alias("added"))
    by = Window.partitionBy("list", "verdict", "key").orderBy("day")  # the entries of one key
    changed = daily.withColumn("before", F.coalesce(F.lag("added").over(by), F.lit(False))).where("added <> before")
    return (
        changed.withColumn("to_day", F.lead("day").over(by))
        .where("added")
        .select("list", "verdict", "key", F.col("day").alias("from_day"), "to_day")
    )


def evaluate(captures: DataFrame, id_col: str, url_col: str, day_col: str, listed: DataFrame) -> DataFrame:
    """One row per capture: its id, host, fetch day, the entries active then and the decision.

    n_block and n_allow count active intervals, lists names their lists in order; decision is "allow" if an allow entry is
    active, else "block" if a block entry is, else "pass". A null URL or a URL without a host matches nothing, as does a null
    day. Repeated rows come back as often as they occur; other columns are ignored.
    """
    rows = captures.select(
        F.col(id_col).alias("capture_id"), host_of(F.col(url_col)).alias("host"), F.col(day_col).cast("date").alias("fetch_day")
    )
    # captures of one host and day have one answer: counted first, so that a hot host is few rows in the join
    asked = rows.where("host is not null and fetch_day is not null").select("host", "fetch_day").distinct()
    asked = asked.withColumn("key", F.explode(host_keys(F.col("host"))))
    hits = asked.join(listed, "key").where("fetch_day >= from_day and (to_day is null or fetch_day < to_day)")
    found = hits.groupBy("host", "fetch_day").agg(
        F.count(F.when(F.col("verdict") == "block", 1)).alias("n_block"),
        F.count(F.when(F.col("verdict") == "allow", 1)).alias("n_allow"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
    )
    # written, so that the captures of a hot host and day come straight from a shuffle and can be split
    joined = rows.join(written(found, "verdicts").hint("merge"), ["host", "fetch_day"], "left")
    block, allow = F.coalesce("n_block", F.lit(0)), F.coalesce("n_allow", F.lit(0))
    return joined.select(
        "capture_id",
        "host",
        "fetch_day",
        block.alias("n_block"),
        allow.alias("n_allow"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        F.when(allow > 0, "allow").when(block > 0, "block").otherwise("pass").alias("decision"),
    )


def derived_entries(pages: DataFrame, url_col: str) -> DataFrame:
    """Dated list entries for the hosts and domains of a table of pages, which has no lists of its own.

    The md5 of a key decides: a first digit 0-5 puts it on "abuse" (block), 6-8 on "adult" (block), 9 on "trusted"
    (allow). It is added on day 16 * second digit + third digit of 2024, removed 30 + fourth digit days later, and
    added again 60 days after that if the fifth digit is 0-7.
    """
    keys = pages.select(F.explode(host_keys(host_of(F.col(url_col)))).alias("key")).distinct()
    digit = lambda i: F.conv(F.substring("m", i, 1), 16, 10).cast("int")
    named = keys.withColumn("m", F.md5(F.encode("key", "UTF-8"))).withColumn(
        "list", F.when(digit(1) <= 5, "abuse").when(digit(1) <= 8, "adult").when(digit(1) == 9, "trusted")
    )
    added = F.date_add(F.lit("2024-01-01").cast("date"), 16 * digit(2) + digit(3))
    removed = F.date_add(added, 30 + digit(4))
    events = F.array(
        F.struct(added.alias("day"), F.lit(True).alias("added")),
        F.struct(removed.alias("day"), F.lit(False).alias("added")),
        F.struct(F.when(digit(5) <= 7, F.date_add(removed, 60)).alias("day"), F.lit(True).alias("added")),
    )
    rows = named.where("list is not null").select(
        "list", F.when(F.col("list") == "trusted", "allow").otherwise("block").alias("verdict"), "key", F.explode(events).alias("e")
    )
    return rows.select("list", "verdict", "key", "e.day", "e.added")
