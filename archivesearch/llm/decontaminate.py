"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are compared as lower-cased words joined by single blanks. An item of m
bytes may occur with up to k = ``rate`` * m edits. By the q-gram lemma such an occurrence keeps at
least m - q + 1 - k * q of the item's q-grams, and they lie on diagonals (text position minus item
position) that span at most k. Diagonals are cut into bands that overlap by k, so one band has
them all: bands with enough distinct shared q-grams are retained, all others can hold no
occurrence. Each retained region is verified by a banded alignment with free text ends. An item takes the
longest q up to ``q`` with which the lemma says anything; items under ``exact_under`` bytes match without edits, as whole words.

The lemma has room to spare, and that bounds the work: of an item's needed q-grams all but one may go
unindexed, if the number needed falls with them. Left out are repeats of a q-gram within an item beyond
``_REPEATS``, then q-grams that very many items share. Items that repeat themselves too much for that are searched by
counting: an occurrence holds as many text positions with q-grams of the item as it needs, wherever they belong.

Benchmark items are normalized and packed into blocks of bounded bytes by a Spark job and stored; one block at
a time is read and broadcast, each against all documents; there is no shuffle of documents and no
pair that does not share enough q-grams.

Defined results: null or empty texts and items match nothing. Items under ``min_chars`` bytes
(after normalizing) identify no text and are left out. Rows that repeat an item or a document
each match. Long texts are searched whole. Items are found whole only, not in parts. An occurrence is reported once per item and place,
places are code points of the text (start inclusive, end exclusive); of several equally good
alignments of a region the first is reported. Words of other scripts are compared in lower case
if lower-casing keeps the text's length, else only A-Z are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivesearch.llm.shared import col, shared_path, stored

RATE = 0.1
Q = 8
MIN_CHARS = 8
EXACT_UNDER = 24
#: Bytes of item texts in one block: what is broadcast at a time.
BLOCK_BYTES = 2 << 20
_BLOCKS_ALIVE = 16  # broadcasts that one plan holds
_TEXT_BYTES = 1 << 20  # texts filtered at a time
_PAIRS = 2_000_000  # pairs of equal q-grams held at a time
_REPEATS, _COMMON = 16, 256
_REGION = 4096  # bytes aligned at a time, unless an item needs more
_BITS = 22
_IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _lowered(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = text.translate({c: c + 32 for c in range(65, 91)})
    return low


def normalized(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts' words joined by blanks, a zero byte after each text; the place of each
    byte in the joined UTF-8; where each text begins there (one more entry than texts)."""
    raws = [_lowered(t).encode("utf-8", "surrogatepass") for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]).astype(np.int64)
    raw = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)
    word = _IS_WORD[raw]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first byte after a word becomes the blank
    ends = begins[1:] - 1
    keep[ends] = True
    places = np.flatnonzero(keep)
    out = np.where(word[places], raw[places], 0x20).astype(np.uint8)
    out[np.searchsorted(places, ends)] = 0
    return out, places, begins


def normal_item(text: str | None) -> bytes:
    return normalized([text or ""])[0].tobytes().rstrip(b"\0").strip(b" ")


def align(item: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of ``item`` in ``region`` with at most ``k``
    edits; a row per item byte, one column per diagonal of the band."""
    m, shift = len(item), 32
    width = max(0, len(region) - m + k) + k + 1  # diagonals -k to len(region) - m + k
    text = np.concatenate([np.full(k, -1, np.int16), region.astype(np.int16), np.full(width + m, -1, np.int16)])
    edit = np.int64(1 << shift)  # a cell is edits and start of its alignment in one number
    ramp = np.arange(width, dtype=np.int64) * edit
    row = np.arange(width, dtype=np.int64) - k
    row[:k] = edit * (m + k + 1)  # nothing starts before the region
    for i in range(m):
        new = row + np.where(text[i:i + width] == item[i], 0, edit)
        new[:-1] = np.minimum(new[:-1], row[1:] + edit)
        row = np.minimum.accumulate(new - ramp) + ramp
    ends = m + np.arange(width) - k
    row = np.where((ends >= 0) & (ends <= len(region)), row, np.iinfo(np.int64).max)
    at = int(np.argmin(row >> shift))
    edits = int(row[at] >> shift)
    return (edits, int(row[at] & ((1 << shift) - 1)), int(ends[at])) if edits <= k else None


def _codes(text: np.ndarray, q: int) -> np.ndarray:
    """The q-gram at each byte as a number; the last ones run into zero bytes."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    out = np.empty(len(text) + 8, np.uint64)
    for shift in range(8):
        part = padded[shift:]
        out[shift::8][:len(part) // 8] = part[:len(part) // 8 * 8].view("<u8")[:len(out[shift::8])]
    return out[:len(text)] & np.uint64((1 << 8 * q) - 1)


def _pairs(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Numbers of the entries first, first + 1, ... of each of several hits, ``times`` of them."""
    ends = np.cumsum(times)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - times - first, times)


class _Grams:
    """The q-grams of the items of a block that share one q. ``members``: (number, bytes, edits)."""

    def __init__(self, members: list[tuple[int, np.ndarray, int]], q: int):
        self.q, self.members = q, {n: (item, k) for n, item, k in members}
        own = {n: _codes(item, q)[:len(item) - q + 1] for n, item, _ in members}
        every, total = np.unique(np.concatenate(list(own.values())), return_counts=True)
        self.needed: dict[int, int] = {}
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # indexed codes in order, and their places
        self.periodic: dict[int, np.ndarray] = {}
        for n, item, k in members:
            codes = own[n]
            needed = len(codes) - k * q
            order = np.argsort(codes, kind="stable")
            line = codes[order]
            new = np.concatenate([[True], line[1:] != line[:-1]])
            repeat = np.empty(len(codes), np.int64)
            repeat[order] = np.arange(len(codes)) - np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
            keep = repeat < _REPEATS
            spare = needed - 1 - int((~keep).sum())
            if spare < 0:
                self.periodic[n], self.needed[n] = line[new], needed
                continue
            shared = total[np.searchsorted(every, codes)]
            common = np.flatnonzero(keep & (shared > _COMMON))
            keep[common[np.argsort(-shared[common], kind="stable")][:spare]] = False
            self.needed[n] = needed - int((~keep).sum())
            kept = order[keep[order]]
            self.grams[n] = codes[kept], kept
        if not self.grams:
            return
        codes = np.concatenate([c for c, _ in self.grams.values()])
        owner = np.concatenate([np.full(len(c), n, np.int64) for n, (c, _) in self.grams.items()])
        place = np.concatenate([p for _, p in self.grams.values()])
        order = np.argsort(codes, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.codes, self.first, self.count = np.unique(codes[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self._slot(self.codes)] = True
        top = max(self.members) + 1
        self.sizes, self.edits, self.bars = (np.zeros(top, np.int64) for _ in range(3))
        for n in self.grams:
            self.sizes[n], self.edits[n], self.bars[n] = len(self.members[n][0]), self.members[n][1], self.needed[n]
        self.widths = np.array([1 << max(4, int(k).bit_length()) for k in self.edits], np.int64)

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * _FACTOR) >> np.uint64(64 - _BITS)

    def regions(self, text: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, from, to) of the retained regions of a normalized text."""
        codes = _codes(text, self.q)
        out = self._by_bands(text, codes) if self.grams else []
        for n in self.periodic:
            out += self._by_counts(n, codes, len(text))
        return out

    def _by_bands(self, text: np.ndarray, codes: np.ndarray) -> list[tuple[int, int, int]]:
        hits = np.flatnonzero(self.seen[self._slot(codes)])
        found = np.searchsorted(self.codes, codes[hits])
        found = np.minimum(found, len(self.codes) - 1)
        exact = self.codes[found] == codes[hits]
        hits, found = hits[exact], found[exact]
        if not len(hits):
            return []
        offset = int(self.sizes.max()) + int(self.widths.max())  # so that no diagonal is negative
        bits = ((len(text) + offset) // 16 + 2).bit_length()
        ends = np.cumsum(self.count[found])
        borders = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]), _PAIRS)))
        keys, sums = [], []
        for a, b in zip(borders, [*borders[1:], len(hits)]):  # so many hits that their pairs are about _PAIRS
            times = self.count[found[a:b]]
            entry = _pairs(self.first[found[a:b]], times)
            item = self.owner[entry]
            diagonal = np.repeat(hits[a:b], times) - self.place[entry] + offset
            width = self.widths[item]
            band = diagonal // width
            overlap = diagonal - band * width < self.edits[item]  # also in the band before
            key = np.concatenate([(item << bits) | band, (item[overlap] << bits) | (band[overlap] - 1)])
            key, n = np.unique(key, return_counts=True)
            keys.append(key)
            sums.append(n)
        key, which = np.unique(np.concatenate(keys), return_inverse=True)
        enough = np.bincount(which, np.concatenate(sums)) >= self.bars[key >> bits]
        out = []
        for value in key[enough].tolist():
            n = value >> bits
            low = (value & ((1 << bits) - 1)) * int(self.widths[n]) - offset
            if self._distinct(n, codes, low) >= self.needed[n]:
                k, m = int(self.edits[n]), int(self.sizes[n])
                out.append((n, max(0, low - k), min(len(text), low + int(self.widths[n]) + m + 2 * k)))
        return out

    def _distinct(self, n: int, codes: np.ndarray, low: int) -> int:
        """Distinct indexed q-grams of an item that a band holds, the band before its next one's first diagonals too."""
        own, place = self.grams[n]
        high = low + int(self.widths[n]) + int(self.edits[n])
        start = max(0, low)
        part = codes[start:max(0, high + len(self.members[n][0]))]
        first = np.searchsorted(own, part, "left")
        times = np.searchsorted(own, part, "right") - first
        at = place[_pairs(first, times)]
        diagonal = np.repeat(np.arange(start, start + len(part)), times) - at
        return len(np.unique(at[(diagonal >= low) & (diagonal < high)]))

    def _by_counts(self, n: int, codes: np.ndarray, size: int) -> list[tuple[int, int, int]]:
        hits, needed = np.flatnonzero(np.isin(codes, self.periodic[n])), self.needed[n]
        if len(hits) < needed:
            return []
        item, k = self.members[n]
        longest = len(item) + k
        first, last = hits[:len(hits) - needed + 1], hits[needed - 1:]
        near = last - first <= longest - self.q
        starts, ends = np.maximum(0, last[near] + self.q - longest), np.minimum(size, first[near] + longest)
        if not len(starts):
            return []
        new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
        return [(n, int(starts[a]), int(ends[b - 1])) for a, b in zip(new, [*new[1:], len(starts)])]


class Finder:
    """The index of a block of items."""

    def __init__(self, items: tuple[bytes, ...], rate: float = RATE, q: int = Q, exact_under: int = EXACT_UNDER):
        if not 1 <= q <= 8:
            raise ValueError("q must be 1 to 8")
        self.same: dict[bytes, list[int]] = {}  # equal items are searched once
        for n, raw in enumerate(items):
            self.same.setdefault(raw, []).append(n)
        self.items, self.raw = [np.frombuffer(b, np.uint8) for b in items], items
        self.sizes = np.array([len(b) for b in items], np.int64)
        self.exact = self.sizes < exact_under
        self.edits = np.where(self.exact, 0, (rate * self.sizes).astype(np.int64))
        groups: dict[int, list] = {}
        for raw, (n, *_) in self.same.items():
            k = int(self.edits[n])
            own = min(q, len(raw) // (k + 1))  # the lemma needs m + 1 - q * (k + 1) >= 1
            groups.setdefault(max(1, own), []).append((n, self.items[n], k))
        self.grams = [_Grams(members, own) for own, members in sorted(groups.items())]

    def _regions(self, text: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, from, to) of the retained regions; overlapping ones of an item are one."""
        merged: list[tuple[int, int, int]] = []
        for n, start, end in sorted(r for grams in self.grams for r in grams.regions(text)):
            if merged and merged[-1][0] == n and start <= merged[-1][2] - int(self.sizes[n]) + 2 * int(self.edits[n]):
                merged[-1] = (n, merged[-1][1], max(end, merged[-1][2]))
            else:
                merged.append((n, start, end))
        return merged

    def _verified(self, text: np.ndarray, n: int, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(edits, from, to) of the occurrences of item ``n`` in a region, text by text."""
        cuts = [start, *(np.flatnonzero(text[start:end] == 0) + start + 1).tolist(), end + 1]
        for a, b in zip(cuts, cuts[1:]):
            yield from self._whole_words(text, n, a, b - 1) if self.exact[n] else self._aligned(text, n, a, b - 1)

    def _whole_words(self, text: np.ndarray, n: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        raw, m, at = text[low:high].tobytes(), int(self.sizes[n]), -1
        while (at := raw.find(self.raw[n], at + 1)) >= 0:
            before, after = low + at - 1, low + at + m
            if (before < 0 or text[before] in (0, 0x20)) and (after >= len(text) or text[after] in (0, 0x20)):
                yield 0, low + at, low + at + m

    def _aligned(self, text: np.ndarray, n: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        """Long regions are aligned stretch by stretch. What ends within ``k`` of a stretch's end might go on there, and is left to
        the next one, which begins before it."""
        k, m = int(self.edits[n]), int(self.sizes[n])
        step = max(_REGION, 4 * (m + 4 * k))
        while high - low >= m - k:
            stop = min(high, low + step)
            found = [f for f in self._best_first(text, n, low, stop) if stop == high or f[2] <= stop - k]
            yield from found
            if stop == high:
                return
            low = max([stop - m - 3 * k, *(f[2] for f in found)])

    def _best_first(self, text: np.ndarray, n: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        k, m = int(self.edits[n]), int(self.sizes[n])
        todo = [(low, high)]
        while todo:
            low, high = todo.pop()
            if high - low < m - k:
                continue
            at = text[low:high].tobytes().find(self.raw[n])
            best = (0, at, at + m) if at >= 0 else align(self.items[n], text[low:high], k)
            if best:
                yield best[0], low + best[1], low + best[2]
                todo += [(low, low + best[1]), (low + best[2], high)]

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) with places in code points."""
        text, places, begins = normalized(texts)
        out = set()
        for n, start, end in self._regions(text):
            for edits, a, b in self._verified(text, n, start, end):
                which = int(np.searchsorted(begins, places[a], side="right")) - 1
                raw = _lowered(texts[which]).encode("utf-8", "surrogatepass")
                first, last = int(places[a] - begins[which]), int(places[b - 1] - begins[which]) + 1
                points = [len(raw[:x].decode("utf-8", "replace")) for x in (first, last)]
                out.update((which, same, points[0], points[1], edits) for same in self.same[self.raw[n]])
        return sorted(out)


@lru_cache(maxsize=2)
def _finder(items: tuple[bytes, ...], rate: float, q: int) -> Finder:
    return Finder(items, rate, q)


def _blocks(benchmark: DataFrame, block_bytes: int, min_chars: int) -> Iterator[tuple[list, tuple[bytes, ...]]]:
    """The items in blocks of bounded size: ids and normalized texts. Spark normalizes, packs and stores
    them; the driver reads one block at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select(col("item_id").cast("long").alias("item_id"), col("text").alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))],
                                              names=["ids", "texts"])

        ids, texts, size = [], [], 0
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = normal_item(text)
                if len(text) >= min_chars:
                    ids.append(item_id)
                    texts.append(text)
                    size += len(text)
                if size >= block_bytes:
                    yield block()
                    ids, texts, size = [], [], 0
        if ids:
            yield block()

    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = (rows.repartition(max(1, -(-total // block_bytes))).mapInArrow(packed, "ids array<long>, texts array<binary>")
              .withColumn("number", F.monotonically_increasing_id()))
    blocks = stored(blocks, shared_path(spark, "benchmark_blocks"))
    for (number,) in blocks.select("number").orderBy("number").collect():  # a number for each block_bytes of items
        row = blocks.filter(F.col("number") == number).first()
        yield row["ids"], tuple(bytes(t) for t in row["texts"])


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows with up to ``_TEXT_BYTES`` of text, or one longer text."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        start = size = 0
        for row in range(batch.num_rows):
            size += len(texts[row].as_buffer() or b"") if texts[row].is_valid else 0
            if size >= _TEXT_BYTES or row + 1 == batch.num_rows:
                part = batch.slice(start, row + 1 - start)
                yield part, [t or "" for t in texts.slice(start, row + 1 - start).to_pylist()]
                start, size = row + 1, 0


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, q: int = Q, min_chars: int = MIN_CHARS,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row ``(doc_id, item_id, start, end, edits)`` per place of ``docs`` where an item occurs. The hits of a block
    are stored before the next one is broadcast."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, start long, end long, edits int"
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text"))
    base, paths = shared_path(spark, "leaks"), []
    for ids, items in _blocks(benchmark, block_bytes, min_chars):
        shared = spark.sparkContext.broadcast((ids, items))

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, items = shared.value
            finder = _finder(items, rate, q)
            for part, texts in _slices(batches, "text"):
                if hits := finder.find(texts):
                    doc_ids = part.column(0).to_pylist()
                    columns = zip(*((doc_ids[w], ids[n], a, b, e) for w, n, a, b, e in hits))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                                     names=["doc_id", "item_id", "start", "end", "edits"])

        paths.append(f"{base}/{len(paths)}")
        rows.mapInArrow(found, schema).write.parquet(paths[-1])
        shared.destroy()
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, q: int = Q, min_chars: int = MIN_CHARS,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns. After ``_BLOCKS_ALIVE`` blocks
    the rows that are left are stored and the broadcasts released."""
    out, spark, alive = docs, docs.sparkSession, []
    text = next(c for c in docs.columns if c.lower() == "text")
    for ids, items in _blocks(benchmark, block_bytes, min_chars):
        if len(alive) == _BLOCKS_ALIVE:
            out = stored(out, shared_path(spark, "clean"))
            for shared in alive:
                shared.destroy()
            alive = []
        shared = spark.sparkContext.broadcast((ids, items))
        alive.append(shared)

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = _finder(shared.value[1], rate, q)
            for part, texts in _slices(batches, text):
                leaked = {hit[0] for hit in finder.find(texts)}
                yield part.filter(pa.array([row not in leaked for row in range(part.num_rows)]))

        out = out.mapInArrow(kept, docs.schema)
    return out
