"""Exact byte-substring dedup: suffixes at winnowed offsets, bucketed by q-gram and refined by bucket.

A WINDOW-byte string is a duplicate if it starts at two places. Each such string has one anchor: its
q-gram of least hash. The suffixes that start at anchors are put into buckets by that q-gram; buckets of
one suffix hold no duplicate. The others are refined by the buckets of what stands at later (and earlier) offsets: first by the
whole stretch of bytes that an anchor's windows cover, then, where stretches of a bucket differ, by blocks
of window offsets and at last by single ones. In each round a bucket is judged by the stretch that its windows
share (alone: none is a duplicate) and by the one they cover (repeated: all are); only buckets
that neither settles go on, and each round reuses the rows that the one before left.

Buckets are counted with map-side combining, so a passage in a third of all documents makes no large
group. Anchors and buckets go by a fast hash that may collide, and only find candidates; strings count as equal by 64-bit XXH3 of their bytes.

Cases: null and empty texts have no bytes; texts under WINDOW bytes keep all; rows of equal texts are
duplicates of each other, whatever their doc_id, also where it is null or repeated; an empty table gives
an empty result; further columns are ignored.
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
from canvass.llm.spans import PIECE, SpanHasher, U, anchors, mix, pieces, signed

WINDOW, GRAM, BLOCK, SEED = 200, 32, 13, 0x5DEECE66D


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def stretches(data: bytes, window: int, gram: int):
    """(bytes, base, anchor positions, first and last window start of each, anchor hashes), piece by piece."""
    for low, high in pieces(len(data), PIECE, window - 1):
        if high - low < window:
            continue
        part = data[low:high]
        span = SpanHasher(part)
        grams = span.grams(gram)
        at = anchors(grams, window - gram + 1)
        edge = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], edge])
        last = np.concatenate([edge, [len(at)]]) - 1
        yield part, low, at[first], first, last, grams[at[first]]


def _digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit XXH3 of each span's bytes: strings count as equal by these."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter([digest(data[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64, len(starts))


def _stretch_hashes(data, at, first, last, window) -> np.ndarray:
    """Of the bytes that each anchor's windows cover, with the anchor's place in them."""
    return mix(_digests(data, first, last + window) + (at - first).astype(np.uint64) * U(0x9E3779B97F4A7C15))


def _counted(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(values), return_counts=True)


def _bucket_rows(window: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values, counts = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [x[5] for x in stretches(_encode(text), window, gram)]
                if own:
                    value, count = _counted(own)
                    keys.append(np.full(len(value), row, np.int64))
                    values.append(value)
                    counts.append(count)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(values))), pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))], names=["bucket", "row", "n"])

    return rows


def _stretch_rows(window: int, gram: int):
    """(bucket, stretch, row, n) for the anchors in buckets of several suffixes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for row, text, shared in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), strict=True):
                shared, own = shared.values.to_numpy().view(np.uint64), []
                for part, _, at, first, last, bucket in stretches(_encode(text), window, gram):
                    keep = np.isin(bucket, shared)
                    own.append(np.stack([bucket[keep], _stretch_hashes(part, at[keep], first[keep], last[keep], window)]))
                pair, count = np.unique(np.concatenate(own, axis=1), axis=1, return_counts=True)
                parts.append((pair[0], pair[1], np.full(len(count), row, np.int64), count))
            if parts:
                bucket, stretch, row, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(signed(bucket)), pa.array(signed(stretch)), pa.array(row), pa.array(n)], names=["bucket", "stretch", "row", "n"])

    return rows


def _context_rows(window: int, gram: int):
    """(stretch, place of the anchor, bytes) of the wanted stretches, each once a row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [])
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, (wanted, buckets) = _encode(text), (wanted.values.field(i).to_numpy().view(np.uint64) for i in (0, 1))
                for part, low, at, first, last, bucket in stretches(data, window, gram):
                    keep = np.isin(bucket, buckets)
                    at, first, last = at[keep], first[keep], last[keep]
                    hashes = _stretch_hashes(part, at, first, last, window)
                    _, once = np.unique(hashes, return_index=True)
                    once = once[np.isin(hashes[once], wanted)]
                    out[0].extend(signed(hashes[once]).tolist())
                    out[1].extend((at[once] - first[once]).tolist())
                    out[2].extend(data[low + a : low + b] for a, b in zip(first[once].tolist(), (last[once] + window).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["stretch", "place", "data"])

    return rows


def _refined_rows(window: int, block: int):
    """(stretch, n, place, data, low, high) -> a row for each block of window offsets from low to high.

    A window's offset is the number of its bytes before the anchor. core: hash of the bytes that all the
    block's windows share; full: of those that they cover.
    """

    digest = xxhash.xxh3_64_intdigest

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in range(6)]
            stretches_, counts, lows, highs, cores, fulls = columns
            for stretch, n, place, data, low, high in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                least = max(low, place - (len(data) - window))
                most = min(high, place)
                for first in range(least // block * block, most + 1, block):
                    lo, hi = max(first, least), min(first + block - 1, most)
                    stretches_.append(stretch)
                    counts.append(n)
                    lows.append(lo)
                    highs.append(hi)
                    # The core holds for the block as a whole, so that stretches which cover different parts of it compare. Seeds tell offsets apart.
                    begin = place - first
                    cores.append(digest(data[begin : max(begin, begin - block + 1 + window)], SEED + first))
                    fulls.append(digest(data[place - hi : place - lo + window], SEED + (lo + 1 << 20 | hi << 8)))
            arrays = [np.array(x, np.int64) for x in columns[:4]] + [signed(np.array(x, np.uint64)) for x in columns[4:]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["stretch", "n", "low", "high", "core", "full"])

    return rows


_BLOCKS = "stretch long, n long, low long, high long, core long, full long"


def _judged(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows that are not ruled out, with sure: all their windows are duplicates."""
    several = lambda x, key: x.groupBy(key).agg(F.sum("n").alias("of")).where("of > 1").select(key)
    kept = scratch.save(f"{name}_kept", rows.join(several(rows, "core"), "core"))
    sure = several(kept, "full").withColumn("sure", F.lit(True))
    return scratch.save(f"{name}_judged", kept.join(sure, "full", "left").withColumn("sure", F.coalesce("sure", F.lit(False))))


def _still_open(judged: DataFrame) -> DataFrame:
    """(stretch, n, low, high): blocks not settled, and of the settled ones that may match them one for each content."""
    cores = judged.groupBy("core").agg(F.bool_and("sure").alias("settled")).where("not settled").select("core")
    rows = judged.join(cores, "core")
    settled = rows.where("sure").groupBy("core", "full").agg(F.min(F.struct("stretch", "low", "high")).alias("s"))
    settled = settled.select("s.stretch", F.lit(2).cast("long").alias("n"), "s.low", "s.high")
    return rows.where("not sure").select("stretch", "n", "low", "high").union(settled)


def _outcome(window: int, gram: int, with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest")}
            for key, text, found in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), strict=True):
                data = _encode(text)
                gone = np.zeros(len(data), bool)
                if found.is_valid and len(data) >= window:
                    steps = np.zeros(len(data) + 1, np.int64)
                    known, low, high, buckets = (found.values.field(i).to_numpy() for i in range(4))
                    buckets = np.unique(buckets.view(np.uint64))
                    order = np.argsort(known.view(np.uint64), kind="stable")
                    known, low, high = known.view(np.uint64)[order], low[order], high[order]
                    for part, base, at, first, last, bucket in stretches(data, window, gram):
                        keep = np.isin(bucket, buckets)
                        at, first, last = at[keep], first[keep], last[keep]
                        hashes = _stretch_hashes(part, at, first, last, window)
                        a, b = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
                        which = np.repeat(np.arange(len(at)), b - a)
                        entry = np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[which]
                        start = np.maximum(at[which] - high[entry], first[which])
                        end = np.minimum(at[which] - low[entry], last[which]) + window
                        np.add.at(steps, base + start, 1)
                        np.add.at(steps, base + end, -1)
                    gone = np.cumsum(steps[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out["doc_id"].append(key)
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(kept))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["rest"].append(kept if with_text else [{"start": a, "end": b} for a, b in spans])
            types = (*[pa.int64()] * 4, pa.string(), pa.binary() if with_text else pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return rows


def byte_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, output: str = "spans") -> DataFrame:
    """docs -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans: removed byte spans, or kept: the bytes left).

    output: "spans" or "kept".
    """
    scratch, widest = Scratch(docs.sparkSession, "suffix"), window - gram
    # Rows are told apart by key and text, so that repeated keys cause no mix-up: equal texts of one key may share what is found.
    row = F.xxhash64(F.col(key).cast("string"), F.col(text), F.length(text))
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), row.alias("row"))
    usable = docs.where(F.octet_length("text") >= window).select("row", "text")
    seeds = scratch.save("seeds", usable.mapInArrow(_bucket_rows(window, gram), "bucket long, row long, n long"))
    several = seeds.groupBy("bucket").agg(F.sum("n").alias("of")).where("of > 1").select("bucket")
    shared = scratch.save("shared", seeds.join(several, "bucket").groupBy("row").agg(F.collect_set("bucket").alias("shared")))
    scratch.drop("seeds")
    found = usable.join(shared, "row").select("row", "text", "shared")
    found = scratch.save("stretches", found.mapInArrow(_stretch_rows(window, gram), "bucket long, stretch long, row long, n long"))
    scratch.drop("shared")
    # A stretch seen once is not settled yet, nor are windows that it shares with others of its bucket.
    weights = scratch.save("weights", found.groupBy("bucket", "stretch").agg(F.sum("n").alias("n"), F.min("row").alias("row")))
    open_buckets = weights.groupBy("bucket").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
    to_refine = scratch.save("to_refine", weights.join(open_buckets.select("bucket"), "bucket").groupBy("stretch").agg(F.max("n").alias("n"), F.min(F.struct("row", "bucket")).alias("first")).select("stretch", "n", "first.row", "first.bucket"))
    wanted = to_refine.groupBy("row").agg(F.collect_set(F.struct("stretch", "bucket")).alias("wanted"))
    contexts = usable.join(wanted, "row").select("text", "wanted").mapInArrow(_context_rows(window, gram), "stretch long, place long, data binary")
    contexts = scratch.save("contexts", contexts.dropDuplicates(["stretch"]))
    columns = ("stretch", "n", "place", "data", "low", "high")
    first = contexts.join(to_refine.select("stretch", "n"), "stretch").withColumns({"low": F.lit(0), "high": F.lit(widest)}).select(*columns)
    first = _judged(scratch.save("blocks", first.mapInArrow(_refined_rows(window, BLOCK), _BLOCKS)), scratch, "blocks")
    scratch.drop("blocks", "blocks_kept")
    second = contexts.join(scratch.save("open", _still_open(first)), "stretch").select(*columns)
    second = _judged(scratch.save("offsets", second.mapInArrow(_refined_rows(window, 1), _BLOCKS)), scratch, "offsets")
    scratch.drop("offsets", "offsets_kept", "contexts", "open")
    part = first.where("sure and n = 1").union(second.where("sure and n = 1")).select("stretch", "low", "high")
    part = part.groupBy("stretch").agg(F.collect_list(F.struct("low", "high")).alias("parts"))
    whole = weights.where("n > 1").select("stretch").distinct().select("stretch", F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(widest).cast("long").alias("high"))).alias("parts"))
    known = found.select("row", "stretch", "bucket").distinct().join(part.union(whole), "stretch").select("row", "stretch", "bucket", F.explode("parts").alias("p"))
    known = scratch.save("known", known.groupBy("row").agg(F.collect_set(F.struct("stretch", "p.low", "p.high", "bucket")).alias("known")))
    scratch.drop("stretches", "weights", "to_refine", "blocks_judged", "offsets_judged")
    kept = output == "kept"
    return docs.join(known, "row", "left").select("doc_id", "text", "known").mapInArrow(
        _outcome(window, gram, kept),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, " + ("kept binary" if kept else "spans array<struct<start:long,end:long>>"),
    )
