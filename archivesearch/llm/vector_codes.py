"""Vector code compression by member-resident Lloyd rounds.

Vectors are cut into equal parts, and each part position gets a codebook. The members of a codebook
entry (row number and integer part) are stored with their owner, the group (position, entry, salt);
a hot entry has as many owners as there are shuffle partitions. In a round the owners compare
their resident members with the new codebooks. A member that keeps its entry stays in the file
where it is; only those that change entry go through the next shuffle, into a table of migrants
(generation r) that is resident from then on. The sums and counts of an entry are those of
the round before, plus arrivals, less departures, so an update reads migrants only.

A table of generation g was assigned by codebooks g. A member of it is still resident in round r if
the codebooks g+1 to r all give its entry; otherwise it has left, and stands in a later table.

The driver holds codebooks, sums and counts: parts x entries x part length numbers, whatever the
number of rows. Every table that a later step reads is stored in the shared folder.

Defined results: rows whose vector is null or holds null or non-finite components are dropped.
Vectors are extended with zeros to the longest kept one and to a multiple of ``parts``. Repeated
rows are coded each for itself; of rows that share one of the first vec_ids the least vector is
the start of the entry. A null vec_id counts as the largest. With fewer ids than entries, the codebooks are
smaller. No kept rows give no rows. Components beyond ``vectors.LIMIT`` are clamped. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivesearch.llm.shared import col, discard, shared_path, stored
from archivesearch.llm.vectors import matrix, scaled, usable

_VECTORS = 8192  # vectors whose parts are grouped at a time
_CELLS = 2_000_000  # differences held at a time
_MEMBERS = "position int, entry int, old int, salt int, ids binary, parts binary"
_WORD = 7  # codes of a byte in a long


@dataclass(frozen=True)
class Settings:
    parts: int = 16
    entries: int = 64  # 256 at most
    rounds: int = 2


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part (ties to the lower index) and its squared distance."""
    entry, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    step = max(1, _CELLS // max(1, book.size))
    for a in range(0, len(parts), step):
        far = ((parts[a:a + step, None, :] - book) ** 2).sum(axis=2)
        entry[a:a + step] = best = far.argmin(axis=1)
        error[a:a + step] = far[np.arange(len(best)), best]
    return entry, error


def _blocks(position: int, ids: np.ndarray, parts: np.ndarray, new: np.ndarray, old: np.ndarray, salts: int) -> list[tuple]:
    """The members as rows of ``_MEMBERS``, one for each pair of entries. The salt of a row comes from its first member."""
    key = new * 256 + old
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order], prepend=-1))
    out = []
    for a, b in zip(cut, [*cut[1:], len(order)]):
        own = order[a:b]
        salt = int(ids[own[0]]) * 2654435761 % 4294967291 % salts
        out.append((position, int(new[own[0]]), int(old[own[0]]), salt, ids[own].tobytes(), parts[own].astype("<i4").tobytes()))
    return out


def _member_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    names = [f.split()[0] for f in _MEMBERS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _residents(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[tuple]:
    """(position, ids, parts, entry) of the members of a stored table which the codebooks ``books``
    have left at their entry, some rows at a time."""
    for batch in batches:
        position, entry, ids, parts = (batch.column(n) for n in ("position", "entry", "ids", "parts"))
        where = position.to_numpy()
        for p in np.unique(where):
            rows = np.flatnonzero(where == p)
            raw = [ids[r].as_py() for r in rows.tolist()]
            own_ids = np.frombuffer(b"".join(raw), "<i8")
            own_parts = np.frombuffer(b"".join(parts[r].as_py() for r in rows.tolist()), "<i4").reshape(len(own_ids), -1).astype(np.int64)
            own = np.repeat(entry.to_numpy()[rows], [len(x) // 8 for x in raw]).astype(np.int64)
            for book in books:
                stays = nearest(own_parts, book[p])[0] == own
                own_ids, own_parts, own = own_ids[stays], own_parts[stays], own[stays]
            yield int(p), own_ids, own_parts, own


class _Rounds:
    """The stored generations of members, and the codebooks so far (entries by position)."""

    def __init__(self, spark: SparkSession, vectors: DataFrame, book: np.ndarray):
        self.spark, self.vectors, self.books = spark, vectors, [book]
        self.salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths: list[str] = []
        self.tables: list[DataFrame] = []
        self.counts = np.zeros(book.shape[:2], np.int64)
        self.sums = np.zeros(book.shape, np.int64)

    def settle(self, members: DataFrame) -> DataFrame:
        """Send members to their owners and store them there."""
        self.paths.append(shared_path(self.spark, f"members-{len(self.tables)}"))
        owned = members.repartition("position", "entry", "salt").sortWithinPartitions("position", "entry")
        self.tables.append(stored(owned, self.paths[-1]))
        return self.tables[-1]

    def first(self) -> None:
        """Assign all parts to the first codebooks."""
        book, salts = self.books[0], self.salts
        parts, _, length = book.shape

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, _VECTORS):
                    some = batch.slice(a, _VECTORS)
                    ids = some.column(0).to_numpy()
                    cut = matrix(some.column(1), parts * length).reshape(len(ids), parts, length)
                    rows: list[tuple] = []
                    for p in range(parts):
                        entry = nearest(cut[:, p], book[p])[0]
                        rows += _blocks(p, ids, cut[:, p], entry, entry, salts)
                    yield _member_batch(rows)

        self.add(self.settle(self.vectors.select("id", "v").mapInArrow(members, _MEMBERS)), departures=False)

    def add(self, members: DataFrame, departures: bool) -> None:
        """Take arrivals of members, and with ``departures`` what they leave behind, into the sums."""
        shape = self.sums.shape

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((*shape[:2], shape[2] + 1), np.int64)  # the last place counts
            for batch in batches:
                for p, new, old, parts in zip(*(batch.column(n).to_pylist() for n in ("position", "entry", "old", "parts"))):
                    own = np.frombuffer(parts, "<i4").reshape(-1, shape[2])
                    change = np.append(own.sum(axis=0, dtype=np.int64), len(own))
                    sums[p, new] += change
                    if departures:
                        sums[p, old] -= change
            at = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int32()) for x in at], pa.array(sums[at], pa.int64())],
                                             names=["position", "entry", "place", "total"])

        found = (members.mapInArrow(totals, "position int, entry int, place int, total long")
                 .groupBy("position", "entry", "place").agg(F.sum("total").alias("total")).toArrow())
        at = tuple(found[n].to_numpy() for n in ("position", "entry", "place"))
        change = np.zeros((*shape[:2], shape[2] + 1), np.int64)
        change[at] = found["total"].to_numpy()
        self.sums += change[:, :, :-1]
        self.counts += change[:, :, -1]

    def update(self) -> None:
        """New codebooks: the floor of each entry's mean; an unused entry stays."""
        mean = self.sums // np.maximum(self.counts, 1)[:, :, None]
        self.books.append(np.where(self.counts[:, :, None] > 0, mean, self.books[-1]))

    def move(self) -> None:
        """Assign by the last codebooks: members that change entry become the next generation."""
        salts, moved = self.salts, []
        for number, table in enumerate(self.tables):
            before, book = self.books[number + 1:-1], self.books[-1]

            def migrants(batches: Iterator[pa.RecordBatch], before=before, book=book) -> Iterator[pa.RecordBatch]:
                for p, ids, parts, old in _residents(batches, before):
                    new = nearest(parts, book[p])[0]
                    go = new != old
                    if go.any():
                        yield _member_batch(_blocks(p, ids[go], parts[go], new[go], old[go], salts))

            moved.append(table.mapInArrow(migrants, _MEMBERS))
        out = moved[0]
        for more in moved[1:]:
            out = out.unionAll(more)
        self.add(self.settle(out), departures=True)

    def assigned(self) -> DataFrame:
        """The codes by the last codebooks. No owner reads the members after this, so what changes entry
        does not move again: each member's entry goes straight to its vector."""
        parts = self.books[0].shape[0]
        words = [f"w{n}" for n in range(-(-parts // _WORD))]
        schema = "id long, error long, " + ", ".join(f"{w} long" for w in words)
        out = self.vectors.select("id", F.lit(0).cast("long").alias("error"), *[F.lit(0).cast("long").alias(w) for w in words],
                                  "vec_id", "label")
        kinds = dict(self.vectors.dtypes)
        for number, table in enumerate(self.tables):
            before = self.books[number + 1:-1]

            def codes(batches: Iterator[pa.RecordBatch], before=before, last=self.books[-1]) -> Iterator[pa.RecordBatch]:
                for p, ids, own, _ in _residents(batches, before):
                    entry, error = nearest(own, last[p])
                    columns = [np.zeros(len(ids), np.int64) for _ in words]
                    columns[p // _WORD] = entry << (8 * (_WORD - 1 - p % _WORD))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, error, *columns)], names=["id", "error", *words])

            out = out.unionByName(table.mapInArrow(codes, schema).select(
                "*", F.lit(None).cast(kinds["vec_id"]).alias("vec_id"), F.lit(None).cast(kinds["label"]).alias("label")))
        text = F.concat(*[F.lpad(F.lower(F.hex(w)), 2 * _WORD, "0") for w in words])
        return (out.groupBy("id").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.sum("error").alias("error"),
                                      *[F.sum(w).alias(w) for w in words])
                .select("vec_id", F.substring(text, 1, 2 * parts).alias("code"), "error", "label"))


def fit(rows: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, np.ndarray | None]:
    """Codes of ``rows`` (columns vec_id, embedding, label): vec_id, code, error, label, as a stored table; and the
    final codebooks (position, entry, place; None without rows)."""
    spark = rows.sparkSession
    kept = rows.filter(usable(col("embedding"))).select(
        F.monotonically_increasing_id().alias("id"), col("vec_id").cast("long").alias("vec_id"), col("label").alias("label"),
        scaled(col("embedding")).alias("v"))
    path = shared_path(spark, "vectors")
    vectors = stored(kept, path)  # the row numbers are fixed from here on
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "label"), None
    length = max(1, -(-width // settings.parts))
    ids = vectors.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(settings.entries)
    seeds = (vectors.join(F.broadcast(ids.withColumnRenamed("vec_id", "seed")), F.col("vec_id").eqNullSafe(F.col("seed")))
             .groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last("vec_id")).select("v").toArrow())
    book = matrix(seeds["v"].combine_chunks(), settings.parts * length).reshape(-1, settings.parts, length).transpose(1, 0, 2)
    rounds = _Rounds(spark, vectors, book)
    rounds.first()
    for number in range(settings.rounds):
        if number:
            rounds.move()
        rounds.update()
    codes = stored(rounds.assigned(), shared_path(spark, "codes"))
    for done in (path, *rounds.paths):
        discard(spark, done)
    return codes, rounds.books[-1]


def digest(codes: DataFrame, book: np.ndarray | None) -> DataFrame:
    """The codes with the error of all rows of their label, and the checksum of the codebooks."""
    numbers = "" if book is None else ",".join(map(str, book.reshape(-1).tolist()))
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return (codes.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
            .select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256")))
