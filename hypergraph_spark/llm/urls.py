"""URL filters: a sort-merge range join of reversed-host keys with nested rule intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypergraph_spark.llm.common import ascii_lower, hidden, partitions

#: Rules travel to every task; more are refused rather than broadcast unchecked.
MAX_RULE_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    """block or allow every url whose host is `host` or a subdomain and whose path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; empty for null or no `://`."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return ascii_lower(rest)


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or end."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    slash = F.instr(rest, "/")
    return F.when(slash > 0, rest.substr(slash, F.length(rest))).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def reversed_host(host: Column) -> Column:
    """`a.example.com` as `com.example.a.`: a domain and its subdomains are one interval of keys."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def sweep(rules: Sequence[Rule], keys: list[str], paths: list[str]) -> list[int]:
    """For keys in ascending order: the index of each one's longest fitting rule, or -1.

    The sweep merges both sorted sides and keeps a stack of the rule hosts whose interval is open: a host's
    interval starts at its own key and ends after all keys it prefixes, so open intervals nest.
    """
    at: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        at.setdefault(".".join(reversed(r.host.split("."))) + ".", []).append(i)
    for own in at.values():
        own.sort(key=lambda i: -len(rules[i].path))
    starts = sorted(at)
    out, stack, nxt, seen = [], [], 0, None
    for key, path in zip(keys, paths, strict=True):
        if key != seen:
            while nxt < len(starts) and starts[nxt] <= key:
                while stack and not starts[nxt].startswith(stack[-1]):
                    stack.pop()
                stack.append(starts[nxt])
                nxt += 1
            while stack and not key.startswith(stack[-1]):
                stack.pop()
            seen = key
        best, size = -1, (-1, -1)
        for start in stack:
            for i in at[start]:
                if path.startswith(rules[i].path):
                    if (n := (len(rules[i].host) + len(rules[i].path), len(rules[i].host))) > size:
                        best, size = i, n
                    break
        out.append(best)
    return out


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url_col: str = "url") -> DataFrame:
    """pages with host, path, rule (its name, null if none fits) and verdict (the rule's, else `default`).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest (host and path
    together, then host) wins, the first given among equals. Rows are range-partitioned by reversed host, path
    and a hash of the row, so a host with a third of all rows spreads over many tasks; each task sweeps its
    sorted rows once. Null urls and urls without `://` have an empty host and path and fit no rule. Repeated
    rows stay, extra columns too (host, path, rule, verdict are replaced); an empty table gives an empty result.
    """
    rules = list(dict.fromkeys(rules))
    if sum(len(r.host) + len(r.path) for r in rules) > MAX_RULE_BYTES:
        raise ValueError("rules exceed MAX_RULE_BYTES")
    if any(not r.host for r in rules):
        raise ValueError("a rule needs a host")
    made = ("host", "path", "rule", "verdict")
    pages, own = hidden(pages, (url_col,), made)
    names = pages.columns
    df = pages.withColumn("host", url_host(F.col(url_col))).withColumn("path", url_path(F.col(url_col)))
    df = df.withColumn("__key", reversed_host(F.col("host"))).withColumn("__row", F.xxhash64(*names))
    df = df.repartitionByRange(partitions(pages.sparkSession), "__key", "path", "__row").sortWithinPartitions("__key", "path")

    @F.pandas_udf("int")
    def fitting(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for keys, paths in parts:
            # Spark sorts by UTF-8 bytes, which is code point order, as Python compares.
            yield pd.Series(sweep(rules, keys.tolist(), paths.tolist()), dtype="int32")

    df = df.withColumn("__rule", fitting("__key", "path"))
    named = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    # element_at() of a null index over a constant array is not null in generated code, so the index is never null.
    pick = lambda values: F.when(F.col("__rule") >= 0, F.get(values, F.greatest(F.col("__rule"), F.lit(0))))
    return df.select(*names, "host", "path", pick(named).alias("rule"), F.coalesce(pick(verdicts), F.lit(default)).alias("verdict")).toDF(*own, *made)
