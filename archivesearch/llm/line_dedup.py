"""Reversible line dedup: exact reference tables with sharded cuckoo filters in front.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of at least
``min_chars`` code points count, as the 128-bit BLAKE2b digest of their bytes. The state holds

* ``refs``: one row (key, doc_id) per key and document, the exact references,
* ``counts``: (key, n_docs, owner): reference count and largest doc_id of each key,
* ``filters``: one cuckoo filter per shard of the key space, holding the keys with at least
  ``min_docs`` references; fingerprints can be taken out again.

Inserting or deleting documents changes references, recounts the touched keys from the
references, and then adds or removes the filter entries of the keys that crossed ``min_docs``.
Deleting what was inserted thus gives back the former decisions. Dropping lines looks up the
batch's distinct keys in the filters, checks what passes against the exact counts, and sends the
dropped keys to their documents. Each change writes a new generation of tables in the shared
folder, so a failed or repeated job leaves the former one whole.

Defined results: a null or empty text is one empty line, kept. A document with a null doc_id is
no reference and loses no line. Rows that repeat a doc_id are one document: a key counts once,
each row loses its lines alike. No documents give no rows. A very frequent key is partial counts
and one row of the exact table; the join with its references is left to adaptive splitting. Extra
columns are carried along; those named like a result column are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivesearch.llm.shared import col, free_name, shared_path, stored, without

MIN_CHARS = 40
MIN_DOCS = 5
KEYS_PER_SHARD = 1 << 13
COLUMNS = ("doc_id", "text", "n_lines", "n_dropped")
_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit key of a line, None if the line is too short to count."""
    if len(line) < min_chars:
        return None
    line = line.strip(_SPACE).lower()
    if len(line) < min_chars or len(line.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints. A key's two buckets follow from either of them and the
    fingerprint, so entries can move and be deleted. What finds no place after ``KICKS`` moves
    goes to an exact stash, so that an insertion never fails."""

    KICKS, SLOTS = 200, 4

    def __init__(self, table: np.ndarray, stash: np.ndarray):
        self.table, self.stash = table, stash

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        buckets = 1 << max(64, int(n_keys / cls.SLOTS / 0.5)).bit_length()
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16), np.zeros((0, 2), np.uint32))

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        buckets, stashed = np.frombuffer(blob, np.uint32, 2).tolist()
        at = 8 + buckets * cls.SLOTS * 2
        return cls(np.frombuffer(blob, np.uint16, buckets * cls.SLOTS, 8).reshape(-1, cls.SLOTS).copy(),
                   np.frombuffer(blob, np.uint32, 2 * stashed, at).reshape(-1, 2).copy())

    def dump(self) -> bytes:
        return np.array([len(self.table), len(self.stash)], np.uint32).tobytes() + self.table.tobytes() + self.stash.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``keys``: (n, 2) unsigned 64-bit halves. Fingerprint and both buckets of each."""
        mask = np.uint64(len(self.table) - 1)
        print_ = (keys[:, 0] & np.uint64(0xFFFF)).astype(np.uint16)
        print_[print_ == 0] = 1  # zero marks a free slot
        first = (keys[:, 0] >> np.uint64(16)) & mask
        return print_, first.astype(np.int64), (first ^ self._jump(print_)).astype(np.int64)

    def _jump(self, print_):
        return (print_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(len(self.table) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, one, two = self._places(keys)
        found = (self.table[one] == print_[:, None]).any(axis=1) | (self.table[two] == print_[:, None]).any(axis=1)
        for stashed, bucket in self.stash.tolist():
            found |= (print_ == stashed) & ((one == bucket) | (two == bucket))
        return found

    def insert(self, keys: np.ndarray) -> None:
        for print_, one, two in zip(*(x.tolist() for x in self._places(keys))):
            for bucket in (one, two):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = print_
                    break
            else:
                bucket = one
                for kick in range(self.KICKS):
                    slot = (print_ + kick) % self.SLOTS
                    print_, self.table[bucket, slot] = int(self.table[bucket, slot]), print_
                    bucket ^= int(self._jump(np.array([print_], np.uint16))[0])
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = print_
                        break
                else:
                    self.stash = np.vstack([self.stash, np.array([[print_, bucket]], np.uint32)])

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted."""
        for print_, one, two in zip(*(x.tolist() for x in self._places(keys))):
            for bucket in (one, two):
                slots = np.flatnonzero(self.table[bucket] == print_)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break
            else:
                at = np.flatnonzero((self.stash[:, 0] == print_) & np.isin(self.stash[:, 1], (one, two)))
                self.stash = np.delete(self.stash, at[:1], axis=0)


def _halves(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct ``(key, doc_id)`` of the lines long enough to count."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lines = (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                found = {line_key(line, min_chars) for line in lines} - {None}
                keys += found
                ids += [doc_id] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())],
                                             names=["key", "doc_id"])

    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text")).filter("doc_id is not null")
    return rows.mapInArrow(of, "key binary, doc_id long").distinct()


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("owner"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")


@dataclass(frozen=True)
class LineIndex:
    """One generation of the state. ``build``, ``insert`` and ``delete`` return a new one."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame | None
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS
    keys_per_shard: int = KEYS_PER_SHARD

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
              keys_per_shard: int = KEYS_PER_SHARD) -> LineIndex:
        spark = docs.sparkSession
        base = shared_path(spark, "line_index")
        refs = stored(references(docs, min_chars), f"{base}/refs")
        counts = stored(_counted(refs), f"{base}/counts")
        shards = max(1, -(-counts.count() // keys_per_shard))
        return cls(refs, counts, None, shards, min_docs, min_chars, keys_per_shard)._sharded(refs, counts, shards, base)

    def _sharded(self, refs: DataFrame, counts: DataFrame, shards: int, base: str) -> LineIndex:
        hot = counts.filter(F.col("n_docs") >= self.min_docs).select(_shard(shards), "key", F.lit(True).alias("add"))
        filters = stored(self._refiltered(hot, None), f"{base}/filters")
        return replace(self, refs=refs, counts=counts, filters=filters, shards=shards)

    def _refiltered(self, changes: DataFrame, filters: DataFrame | None) -> DataFrame:
        """The filters after ``changes(shard, key, add)``; shards without a change stay."""
        schema = "shard int, blob binary"

        def apply(rows: pd.DataFrame, blob: bytes | None) -> bytes:
            add, gone = rows[rows["add"]], rows[~rows["add"]]
            one = CuckooFilter.load(blob) if blob is not None else CuckooFilter.sized(len(add))
            if len(gone):
                one.delete(_halves(gone["key"]))
            if len(add):
                one.insert(_halves(add["key"]))
            return one.dump()

        if filters is None:
            return changes.groupBy("shard").applyInPandas(
                lambda key, rows: pd.DataFrame({"shard": [key[0]], "blob": [apply(rows, None)]}), schema)

        def merged(key, rows: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            blob = old["blob"].iloc[0] if len(old) else None
            return pd.DataFrame({"shard": [key[0]], "blob": [apply(rows, blob) if len(rows) else blob]})

        return changes.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(merged, schema)

    def _changed(self, touched: DataFrame, refs: DataFrame, base: str) -> LineIndex:
        """The generation with references ``refs``, of which those of the keys ``touched`` changed."""
        now = _counted(refs.join(touched, "key", "left_semi"))
        was = self.counts.join(touched, "key", "left_semi")
        counts = stored(self.counts.join(touched, "key", "left_anti").unionByName(now), f"{base}/counts")
        if (shards := max(1, -(-counts.count() // self.keys_per_shard))) > 2 * self.shards:
            # Outgrown: the filters are derived data, made anew from the exact counts.
            return self._sharded(refs, counts, shards, base)
        hot, cold = F.coalesce("n_now", F.lit(0)) >= self.min_docs, F.coalesce("n_was", F.lit(0)) >= self.min_docs
        changes = (now.select("key", F.col("n_docs").alias("n_now"))
                   .join(was.select("key", F.col("n_docs").alias("n_was")), "key", "full_outer")
                   .filter(hot != cold).select(_shard(self.shards), "key", hot.alias("add")))
        filters = stored(self._refiltered(changes, self.filters), f"{base}/filters")
        return replace(self, refs=refs, counts=counts, filters=filters)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the references of ``docs``; references already there change nothing."""
        base = shared_path(docs.sparkSession, "line_index")
        added = stored(references(docs, self.min_chars), f"{base}/added")
        refs = stored(self.refs.unionByName(added).distinct(), f"{base}/refs")
        return self._changed(added.select("key").distinct(), refs, base)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of ``doc_ids``; unknown ids change nothing."""
        base = shared_path(doc_ids.sparkSession, "line_index")
        gone = doc_ids.select(col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
        touched = stored(self.refs.join(gone, "doc_id", "left_semi").select("key").distinct(), f"{base}/touched")
        refs = stored(self.refs.join(gone, "doc_id", "left_anti").select("key", "doc_id"), f"{base}/refs")
        return self._changed(touched, refs, base)

    def probe(self, keys: DataFrame) -> DataFrame:
        """Those of the distinct ``keys`` that the filter of their shard may hold."""
        def passed(rows: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(old):
                return pd.DataFrame({"key": pd.Series([], dtype=object)})
            return rows.loc[CuckooFilter.load(old["blob"].iloc[0]).contains(_halves(rows["key"])), ["key"]]

        return (keys.select(_shard(self.shards), "key").groupBy("shard")
                .cogroup(self.filters.groupBy("shard")).applyInPandas(passed, "key binary"))

    def dropped(self, refs: DataFrame) -> DataFrame:
        """``(doc_id, keys)``: the keys that each document of ``refs`` loses."""
        maybe = self.probe(refs.groupBy("key").agg(F.count("*").alias("n")).select("key"))
        sure = self.counts.filter(F.col("n_docs") >= self.min_docs).join(maybe, "key", "left_semi")
        lost = refs.join(sure.select("key", "owner"), "key").filter("doc_id <> owner")
        return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))  # at most its own lines

    def apply(self, docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """``docs`` without the dropped lines: doc_id, text, n_lines (before), n_dropped and the
        other columns. ``refs``: the references of ``docs``, if they are at hand."""
        refs = refs if refs is not None else references(docs, self.min_chars)
        carried, keys, lost_id = without(docs, list(COLUMNS)), free_name(docs, "_keys"), free_name(docs, "_lost_id")
        lost = self.dropped(refs).select(F.col("doc_id").alias(lost_id), F.col("keys").alias(keys))
        joined = (docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text"), *[col(c) for c in carried])
                  .join(lost, F.col("doc_id") == F.col(lost_id), "left").drop(lost_id))
        schema = T.StructType([*joined.drop(keys).schema.fields, T.StructField("n_lines", T.LongType()),
                               T.StructField("n_dropped", T.LongType())])
        min_chars = self.min_chars

        def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept, n_lines, n_dropped = [], [], []
                for text, drop in zip(batch.column("text"), batch.column(keys)):
                    text = text.as_py() or ""
                    drop = set(drop.as_py() or ())
                    if not drop:
                        kept.append(text)
                        n_lines.append(text.count("\n") + 1)
                        n_dropped.append(0)
                        continue
                    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                    left = [line for line in lines if line_key(line, min_chars) not in drop]
                    kept.append(b"\n".join(left).decode("utf-8", "surrogatepass"))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(left))
                arrays = [pa.array(kept, field.type) if field.name == "text" else batch.column(field.name)
                          for field in batch.schema if field.name != keys]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                    names=[f.name for f in batch.schema if f.name != keys] + ["n_lines", "n_dropped"])

        return joined.mapInArrow(rewritten, schema)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Build the index of ``docs`` and drop its repeated lines from them."""
    index = LineIndex.build(docs, min_docs, min_chars)
    return index.apply(docs, index.refs)
