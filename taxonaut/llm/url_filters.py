"""URL filters: a sort-merge range join of pages with nested host and path rules."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, lower_ascii, written

#: Ends every label of a key. In a label it is written as two others, so it never comes from a host.
END, NEXT = "\x01", "\x02"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels of a host in reverse, each ended by END: all hosts under a rule's lie in one interval."""
    safe = F.replace(F.replace(host, F.lit(NEXT), F.lit(NEXT + "b")), F.lit(END), F.lit(NEXT + "a"))
    return F.concat(F.array_join(F.reverse(F.split(safe, r"\.")), END), F.lit(END))


def holders(key: Column, depth: Column) -> Column:
    """The keys of a host and of the hosts that it lies under, of ``depth`` labels at most."""
    labels = F.split(key, END)
    return F.transform(F.sequence(F.lit(1), F.least(depth, F.size(labels) - 1)), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), END), F.lit(END)))


def sweep(pages: list[tuple], rules: list[tuple]) -> Iterator[tuple]:
    """Merges pages (key, path, ...) with rules (key, path, rule, verdict), both sorted by key.

    The stack holds the rule hosts whose interval the sweep is in, outermost
    first, each with its paths sorted. A page asks the innermost host first.
    """
    stack: list[tuple[str, list[str], list[tuple]]] = []
    at = 0
    for page in pages:
        key, path = page[0], page[1]
        while at < len(rules) and rules[at][0] <= key:
            host = rules[at][0]
            while stack and not host.startswith(stack[-1][0]):
                stack.pop()
            own = []
            while at < len(rules) and rules[at][0] == host:
                own.append(rules[at][1:])
                at += 1
            own.sort()
            stack.append((host, [r[0] for r in own], own))
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        hit = None
        for _, paths, own in reversed(stack):
            # prefixes of one path are nested: the longest is the nearest before it that fits
            i = bisect_right(paths, path) - 1
            while i >= 0 and not path.startswith(paths[i]):
                common = next((k for k, (a, b) in enumerate(zip(paths[i], path)) if a != b), min(len(paths[i]), len(path)))
                i = bisect_right(paths, path[:common], 0, i) - 1
            if i >= 0:
                hit = own[i]
                break
        yield page, hit


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", per_segment: int = 20_000, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """The verdict on every page: that of the longest rule that fits, else ``default``.

    ``rules`` has host, path (a prefix; '' or null fits every path) and
    verdict. A rule fits its host and all subdomains. Of several, the one with
    the longest host wins, then the longest path; of equal rules the last by
    verdict. Pages and rules are range-partitioned together by reversed host,
    path and id, so a hot host, or one url, spreads over many segments. A rule
    goes to the segment that it lies in; to later ones it goes, by an
    equi-join, where their first host is its own or lies under it. Segments
    hold about ``per_segment`` rows.

    Returns page_id, host, path, rule (host and path of the rule, or null) and
    verdict. A null url or one without :// has empty host and path; a null id
    stays null. Rules with a null host or verdict are ignored. Repeated rows
    stay. No rules: all pages get the default; no pages: no rows. Other
    columns are ignored.
    """
    known = rules.filter("host is not null and verdict is not null").select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict")).distinct()
    known = known.select(host_key(F.col("host")).alias("key"), "path", F.lit(None).cast(pages.schema[page_id].dataType).alias("page_id"), "host", F.concat("host", "path").alias("rule"), "verdict")
    none = F.lit(None).cast("string")
    keyed = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keyed = keyed.select(host_key(F.col("host")).alias("key"), "path", "page_id", "host", none.alias("rule"), none.alias("verdict")).union(known)
    segments = buckets_for(pages.count(), per_segment)
    keyed = keyed.repartitionByRange(segments, F.col("key"), F.col("path"), F.col("rule").isNull(), F.col("page_id")).withColumn("segment", F.spark_partition_id())
    keyed = written(keyed, "url-segments")  # fixes which row is in which segment
    dealt = keyed.filter("rule is not null").select(F.col("segment").alias("to"), F.col("key").alias("rule_key"), F.col("path").alias("rule_path"), F.col("rule").alias("fits"), F.col("verdict").alias("says"))
    asked = keyed.filter("rule is null").drop("rule", "verdict")
    depth = dealt.select(F.max(F.size(F.split("rule_key", END)) - 1).alias("depth"))  # one row
    firsts = asked.groupBy(F.col("segment").alias("to")).agg(F.min("key").alias("lo")).crossJoin(F.broadcast(depth))
    firsts = firsts.filter("depth > 0").select("to", F.explode(holders(F.col("lo"), F.col("depth"))).alias("rule_key"))
    dealt = dealt.union(firsts.join(dealt.drop("to"), "rule_key").select(dealt.columns)).distinct()

    def judge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["key", "path"], kind="stable")
        right = right.sort_values(["rule_key", "rule_path", "says"])
        order = left[["key", "path", "page_id", "host"]].itertuples(index=False, name=None)
        out = [(p[2], p[3], p[1], *(hit[1:3] if hit else (None, default))) for p, hit in sweep(order, list(right[["rule_key", "rule_path", "fits", "says"]].itertuples(index=False, name=None)))]
        return pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)[page_id]
    return asked.groupBy("segment").cogroup(dealt.groupBy("to")).applyInPandas(judge, f"page_id {kind}, host string, path string, rule string, verdict string")
