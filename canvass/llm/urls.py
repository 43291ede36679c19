"""URL filter: a trie over reversed host labels and path segments, with the longest matching rule deciding.

A rule is a host and a path, cut at the first slash. It fits its host and all subdomains of it if the URL's path starts with the rule's path, as text: the
last segment of a rule's path may end within a URL's segment. Of the rules that fit, the one of the longest host wins, then the one of the
longest path; of allow and block for one rule, block. Where none fits the default holds.

Hosts are walked label by label from the right and paths segment by segment from the left, so a URL's cost follows its own length and not the number of rules.
The trie is broadcast if the rules' measured bytes are within TRIE_BYTES. Longer lists are joined instead: rules by host and whole segments, URLs by each
such prefix of theirs (no deeper than any rule), each distinct host and path once.

Cases: a null URL, or one without ``://``, has an empty host and path, and the default; an empty path starts with no rule's path but an empty one (a rule
without a slash); rules that are null or empty, or of another action than allow or block, are an error; rows stay as they are, repeated ones too; an empty table
gives an empty result; further columns are carried along by ``filtered`` and ignored by ``judged``.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Bytes of all rules' texts up to which a trie is broadcast; its dictionaries take some twenty times as much in a worker.
TRIE_BYTES = 8 << 20
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first :// and the next slash, question mark or number sign, A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the host's end to the query or fragment."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


class Trie:
    """Rules by reversed host labels, then by path segments. A node: [children by label or segment, paths from here, actions by unfinished segment]."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root = {}
        for action, rule in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            *whole, part = (slash + path).split("/")
            node = node.setdefault(None, {})  # no label: the paths of this host
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})
            # Of rules for one place block goes before allow.
            ends[part] = max(ends.get(part, (rule, action)), (rule, action), key=lambda x: (x[1] == BLOCK, x[0]))

    def longest(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The rule that decides and its action."""
        node, found = self.root, (None, None)
        segments = path.split("/")
        for label in reversed(host.split(".")):
            if (node := node.get(label)) is None:
                break
            if None in node:
                found = self._deepest(node[None], segments) or found
        return found

    @staticmethod
    def _deepest(node: dict, segments: list[str]) -> tuple[str, str] | None:
        found = None
        for depth, segment in enumerate(segments):
            ends = node.get(None, {})
            if (part := max(_prefixes(segment, ends), key=len, default=None)) is not None:
                found = ends[part]
            # A whole segment ends with a slash, which the last one doesn't.
            node = node.get(segment) if depth < len(segments) - 1 else None
            if node is None:
                break
        return found


def _prefixes(text: str, known: dict) -> Iterator[str]:
    """The keys that the text starts with, by whichever is shorter to go through."""
    if len(known) <= len(text):
        return (x for x in known if text.startswith(x))
    return (x for x in (text[:n] for n in range(len(text) + 1)) if x in known)


def _walked(spark, rules: list[tuple[str, str]]):
    """A function of host and path to (rule, action), over a broadcast trie."""
    trie = spark.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, action string")
    def walk(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        longest = trie.value.longest
        for hosts, paths in parts:
            yield pd.DataFrame([longest(h, p) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "action"], dtype="object")

    return walk


def _joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path) -> (host, path, rule, action) of the distinct ones that a rule fits, without a trie."""
    labels, segments = (lambda x: F.split(x, "[.]", -1)), (lambda x: F.split(x, "/", -1))
    rest = F.col("rule").substr(F.length(F.substring_index("rule", "/", 1)) + 1, F.length("rule"))
    kept = rules.select("action", "rule", F.translate(F.substring_index("rule", "/", 1), string.ascii_uppercase, string.ascii_lowercase).alias("on"), rest.alias("start"))
    kept = kept.withColumn("cut", segments(F.col("start")))
    depth = F.size("cut") - 1
    kept = kept.select("action", "rule", "on", "start", depth.alias("depth"), F.array_join(F.slice("cut", 1, depth), "/").alias("under"), F.size(labels(F.col("on"))).alias("labels"))
    deepest = kept.agg(F.max("labels"), F.max("depth")).first()
    if deepest[0] is None:
        return urls.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action")).limit(0)
    of = urls.distinct().withColumns({"names": labels(F.col("host")), "cut": segments(F.col("path"))})
    of = of.withColumn("labels", F.explode(F.sequence(F.lit(1), F.least(F.size("names"), F.lit(deepest[0])))))
    of = of.withColumn("depth", F.explode(F.sequence(F.lit(0), F.least(F.size("cut") - 1, F.lit(deepest[1])))))
    names = F.slice("names", F.size("names") - F.col("labels") + 1, F.col("labels"))
    of = of.select("host", "path", "depth", F.array_join(names, ".").alias("on"), F.array_join(F.slice("cut", 1, F.col("depth")), "/").alias("under"))
    fits = of.join(kept, ["on", "depth", "under"]).where(F.startswith(F.col("path"), F.col("start")))
    order = F.struct("labels", F.length("start").alias("size"), (F.col("action") == BLOCK).alias("blocks"), "rule", "action")
    return fits.groupBy("host", "path").agg(F.max(order).alias("best")).select("host", "path", "best.rule", "best.action")


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = ALLOW, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """pages -> (key, host, path, rule, verdict). rules: (action, rule), each rule as host, slash, start of the path; verdict: allow or block."""
    if key in ("host", "path", "rule", "verdict"):
        raise ValueError(f"the key has the name of a result, {key}")
    given = rules.select("action", "rule")
    wrong = ~F.coalesce(F.col("action").isin(ALLOW, BLOCK) & (F.col("rule") != ""), F.lit(False))
    seen = given.agg(F.count_if(wrong), F.sum(F.octet_length("rule") + 16)).first()
    if seen[0]:
        raise ValueError(f"{seen[0]} rules are empty or of no known action")
    verdict = F.coalesce("action", F.lit(default))
    parts = pages.select(F.col(f"`{key}`"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    if (seen[1] or 0) <= trie_bytes:
        walk = _walked(pages.sparkSession, [tuple(r) for r in given.collect()])  # within trie_bytes
        found = parts.withColumn("found", walk("host", "path"))
        return found.select(key, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.action", F.lit(default)).alias("verdict"))
    return parts.join(_joined(parts.select("host", "path"), given), ["host", "path"], "left").select(key, "host", "path", "rule", verdict.alias("verdict"))


def filtered(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows of pages that are allowed, with their own columns."""
    held = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(f"`{url}`").alias("url"))
    return judged(held, rules, "url", "row", default, trie_bytes).where(F.col("verdict") == ALLOW).select("row.*")
