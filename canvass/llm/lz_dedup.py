"""Substring dedup of words by relative Lempel-Ziv parsing against every earlier document.

The reference of a document is all documents of smaller id. Its index is spread over Spark's partitions in blocks by hash and has two levels:
anchors (winnowed GRAM-word phrases, of which every window has one) tell
which parts of a document can occur elsewhere at all; for those parts alone, each WINDOW-word phrase is
indexed with the document and the place where it stands first. A document is then factored greedily from left to right: a factor starts at
a phrase that the reference has and goes on as long as the next phrase stands at the next place of the same reference document. Phrases across a factor's
boundary are looked up like any other, so neighbouring factors may overlap. Factors have WINDOW words or more by construction. The words of each factor are
then compared, by SHA-256, with the words at its place in the reference document; those that agree become duplicate spans.
The 64-bit hashes of phrases only find candidates: one that agrees by chance removes nothing, and hides a repeat with a probability near 2**-64 a pair.

A reference document that very many factors copy is read in several tasks, each for a bounded share of its distinct spans.

Cases: null and empty texts have no words; texts of fewer than WINDOW words keep all; of several rows
with one doc_id each is judged against smaller ids alone (places carry a hash of the row's text, so that rows are told apart); rows with a null doc_id keep all and are no
reference; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import Scratch
from canvass.llm.spans import U, anchors, mix, phrase_hashes, pieces, signed

WINDOW, GRAM = 13, 7
#: Spans of one reference document that a task compares.
SPANS_A_TASK = 512
_PIECE = 1 << 18


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def phrases(words: list[bytes], window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, hashes of the grams from that word on, for each window the hash of its anchor), piece by piece."""
    for low, high in pieces(len(words), _PIECE, window - 1):
        part = words[low:high]
        if len(part) < window:
            continue
        grams = phrase_hashes(part, gram)
        yield low, grams, grams[anchors(grams, window - gram + 1)]


def window_hashes(grams: np.ndarray, at: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Of the windows that start at some words, from those of the grams that cover them."""
    out = np.full(len(at), window, np.uint64)
    for k in [*range(0, window - gram, gram), window - gram]:
        out = mix(out * U(0x9E3779B97F4A7C15) + grams[at + k])
    return out


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _hash_rows(ids: list[int], found: list[np.ndarray], name: str) -> pa.RecordBatch:
    values = np.concatenate(found) if found else np.zeros(0, np.uint64)
    keys = np.repeat(np.array(ids, np.int64), [len(x) for x in found])
    return pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(keys)], names=[name, "doc_id"])


def _anchor_rows(window: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [x for _, _, x in phrases(split_words(text), window, gram)]
                if own:
                    ids.append(key)
                    found.append(np.unique(np.concatenate(own)))
            yield _hash_rows(ids, found, "anchor")

    return rows


def row_base(data: bytes) -> int:
    """What is added to the places in a row's text: a number of 31 bits above those of any place."""
    return (xxhash.xxh64_intdigest(data) >> 33) << 32


def _phrase_rows(window: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, places = [], [], []
            for key, text, shared in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), strict=True):
                shared, words = shared.values.to_numpy().view(np.uint64), split_words(text)
                base = row_base((text or "").encode("utf-8", "surrogatepass"))
                for low, grams, anchor in phrases(words, window, gram):
                    at = np.flatnonzero(np.isin(anchor, shared))
                    ids.append(np.full(len(at), key, np.int64))
                    found.append(window_hashes(grams, at, window, gram))
                    places.append(at + (low + base))
            columns = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((found, np.uint64), (ids, np.int64), (places, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(signed(columns[0])), pa.array(columns[1]), pa.array(columns[2])], names=["phrase", "doc_id", "place"])

    return rows


def factorise(places: np.ndarray, sources: np.ndarray, source_places: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Phrases that the reference has, by place -> greedy factors (first word, words, reference document, its first word)."""
    if not len(places):
        return []
    follows = (np.diff(places) == 1) & (np.diff(sources) == 0) & (np.diff(source_places) == 1)
    first = np.concatenate([[0], np.flatnonzero(~follows) + 1])
    count = np.diff(np.concatenate([first, [len(places)]])) + window - 1
    return list(zip(places[first].tolist(), count.tolist(), sources[first].tolist(), source_places[first].tolist(), strict=True))


def _factor_rows(window: int):
    """(doc_id, known: places with their sources) -> a row for each factor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(5)]
            for key, known in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                fields = [known.values.field(i).to_numpy() for i in range(3)]
                order = np.unique(fields[0], return_index=True)[1]  # rows that are equal give a place twice
                for factor in factorise(*(x[order] for x in fields), window):
                    for values, value in zip(out, (key, *factor), strict=True):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "place", "words", "source", "source_place"])

    return rows


def _digest(words: list[bytes], first: int, count: int) -> bytes:
    return hashlib.sha256(b" ".join(words[first : first + count])).digest()


def _own(spans, base: int) -> Iterator[tuple[int, dict]]:
    """Of spans with a place, those of this row, with the word they start at."""
    return ((x["place"] - base, x) for x in spans if x["place"] >> 32 == base >> 32)


def _reference_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> the digest of each span of the reference document."""
    for batch in batches:
        out = [[] for _ in range(4)]
        for key, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words, base = split_words(text), row_base((text or "").encode("utf-8", "surrogatepass"))
            for first, x in _own(spans, base):
                for values, value in zip(out, (key, x["place"], x["words"], _digest(words, first, x["words"])), strict=True):
                    values.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["source", "source_place", "words", "digest"])


def _outcome(with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "spans")}
            for key, text, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, base, spans = split_words(text), row_base((text or "").encode("utf-8", "surrogatepass")), []
                gone = np.zeros(len(words) + 1, np.int64)
                for first, x in _own(found or (), base):
                    if _digest(words, first, x["words"]) == x["digest"]:
                        gone[first] += 1
                        gone[first + x["words"]] -= 1
                        spans.append({"first_word": first, "words": x["words"], "source_doc_id": x["source"], "source_first_word": x["source_place"] & 0xFFFFFFFF})
                gone = np.cumsum(gone[:-1]) > 0
                kept = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x]) if spans else b" ".join(words)
                out["doc_id"].append(key)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["spans"].append(kept.decode("utf-8", "surrogatepass") if with_text else sorted(spans, key=lambda x: x["first_word"]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if with_text else _SPANS)
            yield _batch({k: (v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    return rows


_SPANS = pa.list_(pa.struct([(x, pa.int64()) for x in ("first_word", "words", "source_doc_id", "source_first_word")]))
_SUMMARY = "doc_id long, n_words long, n_removed long, kept_sha256 string, "


def substring_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, output: str = "spans") -> DataFrame:
    """docs -> (doc_id, n_words, n_removed, kept_sha256, and spans: its factors, or kept: the words left).

    output: "spans" or "kept".
    """
    scratch = Scratch(docs.sparkSession, "lz")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    usable = docs.where("doc_id is not null and text is not null")
    seeds = usable.mapInArrow(_anchor_rows(window, gram), "anchor long, doc_id long")
    seeds = scratch.save("anchors", seeds)
    repeated = seeds.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    shared = seeds.join(repeated.select("anchor"), "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("shared"))
    shared = scratch.save("shared", shared)
    scratch.drop("anchors")
    rows = usable.join(shared, "doc_id").select("doc_id", "text", "shared").mapInArrow(_phrase_rows(window, gram), "phrase long, doc_id long, place long")
    rows = scratch.save("phrases", rows)
    scratch.drop("shared")
    # Written on its own, so that Spark can split a crowded phrase in the join that follows.
    index = rows.groupBy("phrase").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("source_place"))
    index = scratch.save("index", index.where("source < last").drop("last"))
    known = rows.join(index, "phrase").where("source < doc_id")
    known = known.groupBy("doc_id").agg(F.collect_list(F.struct("place", "source", "source_place")).alias("known"))
    factors = known.mapInArrow(_factor_rows(window), "doc_id long, place long, words long, source long, source_place long")
    factors = scratch.save("factors", factors)
    scratch.drop("phrases", "index")
    # The distinct spans of each reference document, dealt to as many tasks as their number needs.
    asked = factors.select("source", "source_place", "words").distinct()
    shares = factors.groupBy("source").agg(F.approx_count_distinct(F.struct("source_place", "words")).alias("n")).select("source", (F.col("n") / SPANS_A_TASK + 1).cast("int").alias("of"))
    asked = asked.join(shares, "source").withColumn("share", F.pmod(F.xxhash64("source_place", "words"), F.col("of")))
    asked = asked.groupBy(F.col("source").alias("doc_id"), "share").agg(F.collect_list(F.struct(F.col("source_place").alias("place"), "words")).alias("spans"))
    reference = usable.join(asked, "doc_id").select("doc_id", "text", "spans").mapInArrow(_reference_rows, "source long, source_place long, words long, digest binary")
    reference = scratch.save("reference", reference.distinct())
    checked = factors.join(reference, ["source", "source_place", "words"]).groupBy("doc_id").agg(F.collect_list(F.struct("place", "words", "source", "source_place", "digest")).alias("found"))
    checked = scratch.save("checked", checked)
    scratch.drop("factors", "reference")
    kept = output == "kept"
    return docs.join(checked, "doc_id", "left").select("doc_id", "text", "found").mapInArrow(
        _outcome(kept),
        _SUMMARY + ("kept string" if kept else "spans array<struct<first_word:long,words:long,source_doc_id:long,source_first_word:long>>"),
    )
