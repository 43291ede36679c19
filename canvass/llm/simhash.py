"""SimHash near-duplicates: fingerprints, links within a Hamming distance, components.

Links are found with a pivot distance table (see ``pivot_table``).

Cases: null and empty texts have fingerprint zero and link with each other; equal texts have equal
fingerprints; rows with a null doc_id keep a null component; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm import jaccard
from canvass.llm.common import Scratch
from canvass.llm.components import connected_components
from canvass.llm.pivot_table import bit_counts, links, majority
from canvass.llm.spans import word_bounds

SHINGLE, SEED = 3, 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PIECE = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    starts, ends = word_bounds(words)
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, counts = functools.partial(xxhash.xxh64_intdigest, seed=SEED), np.zeros(64, np.int64)
    for at in range(0, len(starts), _PIECE):
        cut = [joined[a:b] for a, b in zip(starts[at : at + _PIECE], ends[at : at + _PIECE], strict=True)]
        hashes = np.fromiter(map(digest, cut), np.dtype("<u8"), len(cut))
        counts += bit_counts(hashes)
    return majority(counts, len(starts))


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([fingerprint(x, shingle) for x in part], dtype="int64")

    return of(text)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """docs -> (doc_id, fp, component_id): one row for each document.

    With a similarity, links of the pivot distance table are verified by the Jaccard similarity of the documents' shingles, and similar pairs whose
    fingerprints are further apart, which no distance bounds, are found by a join that misses none (see ``jaccard``); there is no fp then.
    """
    if similarity is not None:
        return jaccard.near_duplicates(docs, text, key, shingle, similarity)
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save("prints", docs.select(F.col(key).alias("doc_id"), fingerprints(F.col(text), shingle).alias("fp")))
    classes = scratch.save("classes", prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = scratch.save("links", links(classes, scratch))
    scratch.drop("keyed", "crowd")
    groups = connected_components(found, scratch)
    classes = classes.join(groups.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(classes, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
