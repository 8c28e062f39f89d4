"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has a bit set where over half of its shingle hashes have it. Documents
are first folded to distinct fingerprints, so copies cost one row. For radius ``r``, a random map
sends each bit to a non-zero vector of r + 1 bits; every non-zero vector v gives the mask of the
bits whose vector has an odd overlap with v. Of two fingerprints that differ in at most r bits,
some mask skips all differing bits (r vectors can't span r + 1 dimensions), so the pair surely
shares the masked value in one of the 2^(r+1) - 1 tables. Buckets are searched by expanding each
fingerprint once against those not yet reached: that gives a spanning forest of the bucket's
links, never its pairs. Buckets over ``max_bucket`` distinct fingerprints are refined with
further independent mask families (a pair still meets in some finer bucket), and what is still
over the bound after ``levels`` families is cut into blocks that meet two by two. Nothing is
dropped.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; a
text shorter than one shingle is one shingle. Rows with a null doc_id get a fingerprint and the
smallest doc_id of their component (null if it has none). Repeated rows each get a row. Texts are
hashed whole, in chunks of shingles. No documents give no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivesearch.llm.components import components
from archivesearch.llm.shared import col, discard, free_name, shared_path, stored

SHINGLE = 3
RADIUS = 3
SEED = 42
_BITS = np.array([[byte >> bit & 1 for bit in range(8)] for byte in range(256)], np.int64)
_CHUNK = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    hash_of = xxhash.xxh64_intdigest
    counts, pairs = np.zeros(64, np.int64), zip(starts, ends)
    while hashes := [hash_of(joined[s:e], seed) for s, e in islice(pairs, _CHUNK)]:
        parts = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        for byte in range(8):  # little-endian: byte 0 has the lowest bits
            counts[8 * byte:8 * byte + 8] += np.bincount(parts[:, byte], minlength=256) @ _BITS
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * counts > len(ends)))


def masks(radius: int, family: int = 0, width: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks of a covering family; ``family`` numbers independent ones."""
    rnd = random.Random(f"covering {radius} {family}")
    size = 1 << (radius + 1)
    # A balanced deal of the non-zero vectors, so that each mask keeps about half of the bits.
    vectors = [1 + bit % (size - 1) for bit in range(width)]
    rnd.shuffle(vectors)
    return [sum(1 << bit for bit, vector in enumerate(vectors) if (vector & v).bit_count() & 1)
            for v in range(1, size)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with a column ``fp`` (signed 64-bit) in a free name; see ``fp_name``."""
    name = free_name(docs, "fp")

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_signed(fingerprint(t, shingle, seed)) for t in texts], dtype="int64")

    return docs.withColumn(name, hashed.asNondeterministic()(col("text")))


def bucket_forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links within ``values`` (distinct, unsigned)."""
    found, rest = [], np.arange(len(values))
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(values[rest] ^ values[at]) <= radius
            if near.any():
                reached = rest[near]
                found += [(int(at), int(x)) for x in reached]
                todo += reached.tolist()
                rest = rest[~near]
    return found


def _forests(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; the last bucket of a batch waits for the next batch."""
    held_key, held = None, []

    def edges(values: np.ndarray) -> list:
        values = np.unique(values)
        return [(values[a], values[b]) for a, b in bucket_forest(values, radius)] if len(values) > 1 else []

    def batch(pairs: list) -> pa.RecordBatch:
        both = np.array(pairs, np.uint64).reshape(-1, 2).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    for rows in batches:
        keys = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in ("family", "bucket", "block")])
        values = rows.column("fp").to_numpy(zero_copy_only=False).astype(np.uint64)
        if not len(values):
            continue
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist(), len(values)]
        sizes = np.diff(bounds)
        pairs = []
        for number in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
            start, end = bounds[number], bounds[number + 1]
            key = tuple(keys[:, start].tolist())
            if key == held_key:
                held.append(values[start:end])
            elif number in (0, len(sizes) - 1):
                if held:
                    pairs += edges(np.concatenate(held))
                held_key, held = key, [values[start:end]]
            else:
                pairs += edges(values[start:end])
        if pairs:
            yield batch(pairs)
    if held and (pairs := edges(np.concatenate(held))):
        yield batch(pairs)


def _tables(rows: DataFrame, radius: int, family: int) -> DataFrame:
    """One row per fingerprint and mask of a family: ``path`` names the masks so far."""
    each = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(_signed(m)).alias("m"))
                     for n, m in enumerate(masks(radius, family))])
    return (rows.withColumn("t", F.explode(each))
            .select("fp", (F.col("family") * 64 + F.col("t.n") + 1).alias("family"),
                    F.col("kept").bitwiseOR(F.col("t.m")).alias("kept"))
            .withColumn("bucket", F.col("fp").bitwiseAND(F.col("kept"))))


def links(distinct: DataFrame, radius: int = RADIUS, max_bucket: int = 1 << 14, levels: int = 3) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints ``fp`` at up to ``radius`` differing bits:
    per bucket a spanning forest, so their components are those of all links."""
    spark = distinct.sparkSession
    rows = distinct.select("fp", F.lit(0).cast("long").alias("family"), F.lit(0).cast("long").alias("kept"))
    parts = []
    for level in range(levels):
        tables = _tables(rows, radius, level)
        large = tables.groupBy("family", "bucket").count().filter(F.col("count") > max_bucket)
        large = stored(large, shared_path(spark, "large_buckets"))
        if large.isEmpty():
            parts.append(tables.withColumn("block", F.lit(0)))
            break
        parts.append(tables.join(large, ["family", "bucket"], "left_anti").withColumn("block", F.lit(0)))
        rows = tables.join(large.drop("count"), ["family", "bucket"], "left_semi")
        if level + 1 == levels:
            sized = tables.join(large, ["family", "bucket"])
            n = F.ceil(2 * F.col("count") / F.lit(max_bucket)).cast("int")
            own = F.pmod(F.xxhash64("fp"), n).cast("int")
            # Blocks meet two by two: a row goes to all pairs that its block is in.
            parts.append(sized.withColumn("block", F.explode(F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda other: F.least(own, other) * n + F.greatest(own, other)))).drop("count"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.select("fp", "family", "bucket", "block")
    return (out.repartition("family", "bucket", "block").sortWithinPartitions("family", "bucket", "block")
            .mapInArrow(lambda batches: _forests(batches, radius), "u long, v long"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row ``(doc_id, fp, component_id)`` per row of ``docs``."""
    spark = docs.sparkSession
    one = fingerprints(docs.select(col("doc_id").alias("doc_id"), col("text").alias("text")), shingle, seed)
    prints = stored(one.select("doc_id", "fp"), shared_path(spark, "fingerprints"))
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), shared_path(spark, "distinct_fingerprints"))
    path = shared_path(spark, "fingerprint_links")
    groups = components(stored(links(least, radius), path))
    # Fingerprints without a link are components of their own.
    of = (least.join(groups, least["fp"] == groups["vertex"], "left")
          .select("fp", "least", F.coalesce("component", "fp").alias("component")))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = stored(of.join(ids, "component").select("fp", "component_id"), shared_path(spark, "fingerprint_components"))
    discard(spark, path)
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The document with the smallest doc_id of each component, with its own columns. Documents
    without a doc_id stay. Of rows that repeat a doc_id, all stay or all go."""
    found, name = near_duplicates(docs, shingle, radius), free_name(docs, "_gone")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, col("doc_id") == F.col(name), "left_anti")
