"""Document fingerprints by content-defined chunking.

A text's UTF-8 bytes are cut where a gear hash of the last 32 bytes has leading zero bits: eight
before a chunk has reached its normal size, four after it (normalised chunking), so chunk lengths
stay close together and boundaries depend on nearby bytes only: after an insertion the cuts fall
into step again. The fingerprint is the sorted set of the chunks' 48-bit digests with their
lengths, 15 hexadecimal digits for each. How much of one text another holds (containment) is the
share, by length, of its chunks that are in the other's set.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import partitions, table

SMALLEST, NORMAL, LARGEST = 16, 48, 384
STRICT, LOOSE = 8, 4
WINDOW = 32
#: Ranges of doc_id for each shuffle partition.
RANGES = 4
#: The gear: a 32-bit number for each byte, by rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)

Chunks = dict[int, int]


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte, the sum of the gear of the last 32 bytes, each shifted by its distance."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, width * 2
    return h


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks."""
    if len(data) <= SMALLEST:
        return [len(data)] if data else []
    h = gear_hashes(data)
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0)
    strict = (loose[h[loose] >> np.uint32(32 - STRICT) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    ends, at, n, i, j = [], 0, len(data), 0, 0
    while n - at > SMALLEST:
        i = bisect_left(strict, at + SMALLEST, i)
        if i < len(strict) and strict[i] < at + NORMAL:
            at = strict[i]
        else:
            j = bisect_left(loose, at + NORMAL, j)
            most = min(at + LARGEST, n)
            at = loose[j] if j < len(loose) and loose[j] < most else most
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> Chunks:
    """Digest and length of each distinct chunk."""
    digest, begin, out = xxhash.xxh3_64_intdigest, 0, {}
    for end in cuts(data):
        out[digest(data[begin:end]) >> 16] = end - begin
        begin = end
    return out


def written(found: Chunks) -> str:
    return "".join([f"{digest:012x}{length:03x}" for digest, length in sorted(found.items())])


def containment(a: Chunks, b: Chunks) -> float:
    """The share, by length, of the chunks of ``a`` that ``b`` has; without any, 1 if neither has one."""
    if not a:
        return float(not b)
    return sum([a[x] for x in a.keys() & b.keys()]) / sum(a.values())


def _bounds(docs: DataFrame, ranges: int) -> list:
    accuracy = max(10_000, 20 * ranges)
    at = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], accuracy)
    return sorted(set(docs.select(at).first()[0] or [])) if ranges > 1 else []


def _range_of(bounds: list) -> Column:
    """The number of bounds at or below doc_id, by binary search; a null doc_id comes last."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    sorted_bounds = F.array(*map(F.lit, bounds))
    place = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda low, s: F.when(F.try_element_at(sorted_bounds, low + s) <= F.col("doc_id"), low + s).otherwise(low),
    )
    return F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(place)


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, _range, _guest: dealt by ranges of doc_id and sorted.

    Each range ends with a guest, a copy of the row that comes next: the first of the next range,
    and after the last range the first of all.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = _bounds(rows, RANGES * n)
    placed = rows.withColumn("_range", _range_of(bounds)).withColumn("_guest", F.lit(False))
    first = [
        tuple(r) for r in placed.groupBy("_range").agg(F.min("doc_id").alias("d")).orderBy("_range").collect()
    ]  # at most one row for each range
    next_of = [(first[(i + 1) % len(first)][1], r) for i, (r, _) in enumerate(first)]
    if any(d is None for d, _ in next_of):  # only null ids in the last range
        known = [d for _, d in first if d is not None]
        next_of = [(d if d is not None else known[0] if known else None, r) for d, r in next_of]
    if next_of:
        kind = docs.schema["doc_id"].dataType.simpleString()
        wanted = docs.sparkSession.createDataFrame(next_of, f"doc_id {kind}, _range int")
        guests = rows.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "_range").agg(
            F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
        )
        placed = placed.unionByName(guests.select("doc_id", "text", "_range", F.lit(True).alias("_guest")))
    return placed.repartition(n, "_range").sortWithinPartitions(
        "_range", "_guest", F.asc_nulls_last("doc_id"), F.xxhash64("text")
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text, and of its edited text, with their likenesses.

    The edited text has, in place of the last floor(n_chars / 2) code points, the first as many (or
    all) of the next document by doc_id. Rows of one doc_id follow one another by the hash of their
    texts; null ids come last, and what follows the last row is the first with an id (without any,
    nothing). Null texts are empty; a text of any length is chunked whole; an empty table gives an
    empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def finished(row: tuple, text: str, found: Chunks) -> tuple:
            doc_id, own, own_chunks, own_written = row
            n = len(own)
            edited = (own[: n - n // 2] + text[: n // 2]).encode()
            changed = chunks(edited)
            return (
                doc_id, n, hashlib.sha256(edited).hexdigest(), own_written, written(changed),
                containment(own_chunks, changed), containment(own_chunks, found),
            )

        for batch in batches:
            out = []
            columns = (batch.column(c) for c in ("doc_id", "text", "_range", "_guest"))
            for doc_id, text, place, guest in zip(*columns):
                text, place = text.as_py(), place.as_py()
                found = chunks(text.encode())
                if held is not None and held[0] != place:  # a last range without a guest
                    out.append(finished(held[1], "", {}))
                    held = None
                if held is not None:
                    out.append(finished(held[1], text, found))
                held = None if guest.as_py() else (place, (doc_id.as_py(), text, found, written(found)))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if held is not None:
            out = [finished(held[1], "", {})]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = (
        f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return in_order(docs).mapInArrow(run, schema)


def op10_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the whole ``documents`` table and of its edited texts."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
