"""Near duplicates by exact Jaccard similarity of word shingles: fingerprints, candidates, verification, components.

A document's set holds the 64-bit hashes of its SHINGLE-word shingles (of all its words, if there are fewer). Documents of equal
sets are one class. Each class has the SimHash fingerprint of its set; the pivot distance table (``pivot_table``) finds fingerprints within two
bits, and such classes link if their sets are similar. Similar sets may have fingerprints further apart, without a bound: a join finds those, among
the pairs that the links so far don't connect.

For the join: two sets whose similarity is at least s share an element among the first n - ceil(s n) + 1 of each,
whatever the order of elements, so classes that share one of those are all the candidates there are: none is missed.
Elements that are common in a sample of texts come last in that order, which keeps the groups small; the sample affects speed alone.

A candidate pair is first tried on sketches: the counts of a set's elements in BINS bins by hash. The sum of the lesser counts is at least the number
of common elements, so that a pair whose sketches leave no room for the similarity is discarded and none is missed. The similarity of
each pair that is left is computed from the whole sets before it links. In groups of over CROWD classes not all pairs are
needed, as only components count: all meet the most central class, for as long as that links some; a group whose classes then are in one component is
settled, and in the others the classes outside the largest component meet those of the other components, as far as the smaller of two sets
has the element within its first n - ceil(2 s n / (1 + s)) + 1, which the first one that two similar sets share always is.

Cases: null and empty texts are one class; equal texts link; rows with a null doc_id keep a null component and link nothing; rows of one
doc_id with different texts link by their texts alone; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import Scratch, broadcast_by_bytes, broadcast_if_small
from canvass.llm.components import connected_components
from canvass.llm.pivot_table import bit_counts, majority
from canvass.llm.pivot_table import links as within_radius
from canvass.llm.spans import mix, phrase_hashes

SHINGLE, SIMILARITY, CROWD, ROUNDS, BROADCAST_ROWS = 5, 0.8, 32, 3, 500_000
#: One text in SAMPLE is looked at for common elements; those in at least COMMON of them, COMMON_ROWS at most, come last.
SAMPLE, COMMON, COMMON_ROWS = 16, 4, 500_000
#: Bins of a sketch.
BINS = 128
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def elements(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(phrase_hashes(words, min(shingle, len(words))))


def signature(found: np.ndarray) -> int:
    """A hash of the whole set, signed."""
    return int(mix(np.array([mix(found).sum(dtype=np.uint64) + np.uint64(len(found))], np.uint64)).view(np.int64)[0])


def sketch(found: np.ndarray) -> bytes:
    return np.bincount((found >> np.uint64(57)).astype(np.int64), minlength=BINS).astype(np.uint32).tobytes()


def most_similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketches, row by row -> upper bounds of the similarities of their sets."""
    common = np.minimum(a, b).sum(axis=1)
    return common / np.maximum(a.sum(axis=1) + b.sum(axis=1) - common, 1)


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def index_size(n: int, similarity: float) -> int:
    """How far into its prefix the first element can stand that a set shares with a similar one of its size or more."""
    return n - math.ceil(2 * similarity / (1 + similarity) * n - 1e-9) + 1 if n else 0


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements common in the sample, sorted, and their counts."""
    sample = docs.select("text", F.xxhash64("text").alias("content")).where(F.pmod("content", F.lit(SAMPLE)) == 0).dropDuplicates(["content"])

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for text in part.text:
                yield pd.DataFrame({"h": elements(text, shingle).view(np.int64)})

    counted = sample.select("text").mapInPandas(of, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    found = counted.orderBy(F.desc("n"), "h").limit(COMMON_ROWS).toPandas()
    hashes = found.h.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.n.to_numpy(np.int64)[order]


def _prefixes(docs: DataFrame, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, sig, fp, n, prefix, sketch): the set's hash, fingerprint and size, and the elements that candidates share one of."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, counts = shared.value
        for part in parts:
            rows = []
            for doc_id, text in zip(part.doc_id, part.text, strict=True):
                found = elements(text, shingle)
                rank = np.zeros(len(found), np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                    rank = np.where(hashes[at] == found, counts[at], 0)
                first = found[np.lexsort((found, rank))[: prefix_size(len(found), similarity)]]
                rows.append((doc_id, signature(found), majority(bit_counts(found), len(found)), len(found), index_size(len(found), similarity), first.view(np.int64), sketch(found)))
            yield pd.DataFrame(rows, columns=["doc_id", "sig", "fp", "n", "early", "prefix", "sketch"])

    return docs.select("doc_id", "text").mapInPandas(of, "doc_id long, sig long, fp long, n int, early int, prefix array<long>, sketch binary")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (text) -> (sig, elements)."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [elements(x, shingle) for x in part.text]
            yield pd.DataFrame({"sig": [signature(x) for x in found], "elements": [x.view(np.int64) for x in found]})

    return docs.select("text").mapInPandas(of, "sig long, elements array<long>")


@dataclass
class Classes:
    """What pairs are verified with: sketches (sig, sketch), a document of each class (sig, doc_id) and the texts (doc_id, text).

    Sets are made from the texts of those classes alone whose pairs get past the sketches.
    """

    sketches: DataFrame
    ids: DataFrame
    docs: DataFrame
    shingle: int
    scratch: Scratch

    def verified(self, pairs: DataFrame, similarity: float, name: str) -> DataFrame:
        """pairs (a, b) -> those whose sets are similar."""

        @F.pandas_udf("boolean")
        def room(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for x, y in parts:
                a, b = (np.frombuffer(b"".join(c), np.uint32).reshape(-1, BINS).astype(np.int64) for c in (x, y))
                yield pd.Series(most_similar(a, b) >= similarity - 1e-9)

        of = lambda table, value, key, new: table.select(F.col("sig").alias(key), F.col(value).alias(new))
        both = pairs.join(of(self.sketches, "sketch", "a", "x"), "a").join(of(self.sketches, "sketch", "b", "y"), "b")
        likely = self.scratch.save(f"{name}_likely", both.where(room("x", "y")).select("a", "b"))
        ends = self.scratch.save(f"{name}_ends", likely.select(F.col("a").alias("sig")).union(likely.select("b")).distinct())
        ids = self.scratch.save(f"{name}_ids", self.ids.join(ends, "sig").select("doc_id").distinct())
        texts = self.docs.join(broadcast_by_bytes(ids), "doc_id", "left_semi")
        # A doc_id with several texts gives the sets of all of them.
        few = _sets(texts, self.shingle).join(broadcast_by_bytes(ends), "sig", "left_semi").dropDuplicates(["sig"])
        few = self.scratch.save(f"{name}_sets", few)
        found = likely.join(of(few, "elements", "a", "x"), "a").join(of(few, "elements", "b", "y"), "b")
        shared = F.size(F.array_intersect("x", "y"))
        found = found.where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")
        found = self.scratch.save(name, found)
        self.scratch.drop(f"{name}_likely", f"{name}_ends", f"{name}_ids", f"{name}_sets")
        return found


def _fit(similarity: float):
    """Sizes that leave room for the similarity."""
    return F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9


def _pairs(left: DataFrame, right: DataFrame, similarity: float, *apart) -> DataFrame:
    """Members (h, sig, n, ...) of one group -> distinct pairs (a, b)."""
    a = left.select("h", *[F.col(c).alias(f"{c}_a") for c in left.columns if c != "h"])
    b = right.select("h", *[F.col(c).alias(f"{c}_b") for c in right.columns if c != "h"])
    met = a.join(b, "h").where((F.col("sig_a") != F.col("sig_b")) & _fit(similarity))
    for condition in apart:
        met = met.where(condition)
    return met.select(F.least("sig_a", "sig_b").alias("a"), F.greatest("sig_a", "sig_b").alias("b")).distinct()


def _early(a: str, b: str):
    """Whichever of two members is not the larger set has the element early enough for it to be the first they share."""
    return ((F.col(f"n_{a}") > F.col(f"n_{b}")) | F.col(f"early_{a}")) & ((F.col(f"n_{b}") > F.col(f"n_{a}")) | F.col(f"early_{b}"))


def close_links(prints: DataFrame, classes: Classes, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """prints (sig, fp) -> links (a, b): similar classes of one fingerprint or of two that the pivot distance table links.

    The least class of a fingerprint stands for it in the table, and the others are tried with that one.
    """
    firsts = scratch.save("firsts", prints.groupBy("fp").agg(F.min("sig").alias("id"), F.count("*").alias("n")))
    several = broadcast_by_bytes(firsts.where("n > 1").select("fp", "id"))
    equal = prints.join(several, "fp").where("sig <> id").select(F.col("id").alias("a"), F.col("sig").alias("b"))
    pairs = equal.union(within_radius(firsts.select("fp", "id"), scratch))
    pairs = scratch.save("closepairs", pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    scratch.drop("firsts", "keyed", "crowd")
    return classes.verified(pairs, similarity, "close")


def links(members: DataFrame, classes: Classes, close: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """members (h, sig, n, k: elements in the prefix, early: within index_size), close: links so far -> links (a, b), enough to connect all similar pairs.

    A similar pair meets in the group of the first element they share at the latest, where the smaller of the two is early.
    """
    groups = connected_components(close, Scratch(scratch.spark, "jaccard-close")).withColumnRenamed("node", "sig")
    members = members.join(broadcast_by_bytes(groups), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    apart = F.col("component_a") != F.col("component_b")
    sizes = members.groupBy("h").agg(F.count("*").alias("members"))
    members = scratch.save("members", members.join(sizes, "h"))
    few = members.where(F.col("members") <= crowd).select("h", "sig", "n", "early", "component")
    pairs = scratch.save("pairs", _pairs(few, few, similarity, F.col("sig_a") < F.col("sig_b"), apart, _early("a", "b")))
    found = close.union(classes.verified(pairs, similarity, "links"))
    many = members.where(F.col("members") > crowd)
    # A class with few elements of its own has most of its prefix in crowded groups.
    central = many.groupBy("sig").agg((F.count("*") / F.first("k")).alias("central"))
    many = scratch.save("many", many.join(central, "sig").select("h", "sig", "n", "early", "component", "central"))
    if many.isEmpty():
        return found
    outside = placed = many
    for turn in range(ROUNDS):
        hub = outside.groupBy("h").agg(F.max_by(F.struct("sig", "n", "component"), F.struct("central", "sig")).alias("hub")).select("h", "hub.*")
        star = scratch.save(f"star{turn}", _pairs(hub, placed.select("h", "sig", "n", "component"), similarity, apart))
        fresh = classes.verified(star, similarity, f"links{turn}")
        found = found.union(fresh)
        groups = connected_components(found, Scratch(scratch.spark, "jaccard-round"))
        placed = many.drop("component").join(groups.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        placed = scratch.save(f"placed{turn}", placed)
        held = placed.groupBy("h", "component").agg(F.count("*").alias("held"))
        largest = held.groupBy("h").agg(F.max_by("component", F.struct("held", "component")).alias("largest"))
        outside = scratch.save(f"outside{turn}", placed.join(largest, "h").where("component <> largest").drop("largest"))
        if (turn and fresh.isEmpty()) or outside.groupBy("h").count().where(F.col("count") > crowd).isEmpty():
            break
    # Only early members look for larger sets, so that pages of one template, whose own words come first, don't all meet.
    columns, met = ["h", "sig", "n", "early", "component"], (apart, F.col("n_a") <= F.col("n_b"), _early("a", "b"))
    rest = _pairs(outside.where("early").select(columns), placed.select(columns), similarity, *met)
    rest = rest.union(_pairs(placed.where("early").select(columns), outside.select(columns), similarity, *met)).distinct()
    return found.union(classes.verified(scratch.save("restpairs", rest), similarity, "rest"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """docs -> (doc_id, component_id): one row for each document; the component is its least doc_id."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = own.where("doc_id is not null")
    prefixes = scratch.save("prefixes", _prefixes(known, shingle, similarity, _common(known, shingle)))
    rows = prefixes.select("doc_id", "sig")
    placed = prefixes.select("sig", "n", F.size("prefix").alias("k"), "early", F.posexplode("prefix").alias("at", "h")).withColumn("early", F.col("at") < F.col("early")).drop("at")
    met = scratch.save("met", placed.groupBy("h").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high").select("h"))
    members = placed.join(broadcast_if_small(met, met.count(), BROADCAST_ROWS), "h").select("h", "sig", "n", "k", "early").distinct()
    members = scratch.save("grouped", members)
    wanted = scratch.save("wanted", members.select("sig").distinct())
    n_wanted = wanted.count()
    near = broadcast_if_small(wanted, n_wanted, BROADCAST_ROWS)
    ids = scratch.save("ids", rows.join(near, "sig").groupBy("sig").agg(F.min("doc_id").alias("doc_id")))
    sketches = scratch.save("sketches", prefixes.select("sig", "sketch").join(near, "sig").groupBy("sig").agg(F.min("sketch").alias("sketch")))
    known_classes = Classes(sketches, ids, known, shingle, scratch)
    prints = prefixes.groupBy("sig").agg(F.min("fp").alias("fp"))
    close = close_links(prints, known_classes, scratch, similarity)
    groups = connected_components(links(members, known_classes, close, scratch, similarity, crowd), scratch)
    classes = rows.groupBy("sig").agg(F.min("doc_id").alias("least")).join(groups.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    out = scratch.save("out", rows.join(classes.join(least, "component").select("sig", "component_id"), "sig").select("doc_id", "component_id"))
    scratch.drop("prefixes", "met", "grouped", "wanted", "sketches", "ids", "members", "closepairs", "pairs", "many", "restpairs", *[f"{x}{i}" for x in ("star", "placed", "outside") for i in range(ROUNDS)])
    return out.unionByName(own.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component_id")))
