"""Url rules as a sort-merge range join.

A host is keyed by its labels in reverse, each followed by a dot (``www.example.com`` is ``com.example.www.``), so
a rule's host and all its subdomains are the interval of keys with one prefix.  Such intervals nest or are
disjoint.  Urls and rules are dealt into key ranges and sorted; one sweep per range keeps the rules whose interval is
open on a stack, and each url takes the longest rule on it whose path fits.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE_SCHEMA = "host string, path string, verdict string"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse, each followed by a dot; an empty host has the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Stack:
    """Open rules, outermost first; a level holds the paths of one rule host by length, longest first."""

    def __init__(self):
        self.levels: list[tuple[str, dict[str, str]]] = []

    def close_before(self, key: str) -> None:
        while self.levels and not key.startswith(self.levels[-1][0]):
            self.levels.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self.close_before(key)
        if not self.levels or self.levels[-1][0] != key:
            self.levels.append((key, {}))
        paths = self.levels[-1][1]
        if path not in paths or verdict > paths[path][1]:  # of equal rules the greater verdict
            paths[path] = (host + path, verdict)

    def longest(self, path: str) -> tuple[str, str] | None:
        best, size = None, (-1, -1)
        for key, paths in self.levels:
            for n in sorted({len(p) for p in paths}, reverse=True):
                if (len(key) + n, len(key)) <= size:
                    break
                if n <= len(path) and path[:n] in paths:
                    best, size = paths[path[:n]], (len(key) + n, len(key))
                    break
        return best


def _range_bounds(keys: DataFrame, ranges: int, sample: int) -> list[str]:
    """At most ``ranges`` cut keys from a bounded, hash-chosen sample; they steer balance only, never results."""
    share = min(1.0, sample / max(1, keys.count()))
    picked = keys.where(F.pmod(F.xxhash64("sort"), F.lit(1_000_000)) < F.lit(int(np.ceil(share * 1_000_000))))
    values = sorted(r[0] for r in picked.select("sort").limit(2 * sample).collect())
    return sorted({values[len(values) * i // ranges] for i in range(1, ranges)}) if values else []


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", unreadable: str = "block",
               ranges: int | None = None, sample: int = 20_000) -> DataFrame:
    """(id, url, host, path, rule, verdict): one row per input row, whatever repeats.

    The longest rule (host and path together, then host) wins; of two equal rules with different verdicts the
    greater word.  Without a rule the verdict is ``default``, or ``unreadable`` for a url without a host.  Null
    urls have an empty host and path.  Rules with a null or empty host, null path or null verdict are ignored.  No rules: all by default.
    A hot host spreads over ranges, as a hash of the url follows the host in the sort key.  A rule is copied to the
    ranges that its interval meets; ``ranges`` defaults to the session's shuffle partitions.
    """
    ranges = ranges or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col)
    urls = pages.select(F.col(id_col).alias("id"), url.alias("url"), url_host(url).alias("host"), url_path(url).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("sort", F.concat("key", F.lit("\0"), F.hex(F.xxhash64(F.col("id"), F.col("url")))))
    low = F.translate("host", UPPER, UPPER.lower())
    starts = rules.where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL").select(
        low.alias("host"), "path", "verdict", host_key(low).alias("key")).distinct()
    bounds = _range_bounds(urls.select("sort"), ranges, sample)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect.bisect_right(bounds, k)).astype("int32")

    # The interval of a prefix that ends in a dot: from itself up to the same with a slash, the next character.
    after = F.concat(F.substring("key", F.lit(1), F.length("key") - 1), F.lit("/"))
    rule_rows = starts.withColumn("part", F.explode(F.sequence(place(F.col("key")), place(after)))).select(
        "part", F.col("key").alias("sort"), F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("id"), F.col("verdict").alias("url"), "host", "path", "key")
    url_rows = urls.select(place(F.col("sort")).alias("part"), "sort", F.lit(1).alias("kind"), "id", "url", "host", "path", "key")
    both = rule_rows.unionByName(url_rows).repartition(F.col("part")).sortWithinPartitions("part", "sort", "kind")

    def sweep(batches):
        stack, at = Stack(), None
        for batch in batches:
            part, kind, url_, host, path, key = (batch.column(c).to_pylist() for c in ("part", "kind", "url", "host", "path", "key"))
            keep, rule, verdict = [], [], []
            for i in range(len(part)):
                if part[i] != at:
                    stack, at = Stack(), part[i]
                if kind[i] == 0:
                    stack.open(key[i], host[i], path[i], url_[i])
                    continue
                stack.close_before(key[i])
                found = stack.longest(path[i])
                keep.append(i)
                rule.append(found[0] if found else None)
                verdict.append(found[1] if found else default if host[i] else unreadable)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("id", "url", "host", "path")] + [pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             names=["id", "url", "host", "path", "rule", "verdict"])

    return both.mapInArrow(sweep, f"id {id_type}, url string, host string, path string, rule string, verdict string")
