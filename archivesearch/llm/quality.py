"""Quality rules by compression bands.

A text is compressed whole and in fixed chunks with zstandard. Its ratio (compressed bytes over
bytes) must lie inside a band that depends on the length: short texts compress badly, so their
band is higher and wider. A ratio below the band means repetition, above it means noise. The
base counts (words, symbols, repeated lines and windows) are computed beside it.

The fixed bands are wide. Noise over a small alphabet (random letters, hex) lies within them, but above all
ordinary text of its length, so ``fit_limits`` lowers the upper limits to the table's own ratios: per
length class (half an octave) the median plus ``spread`` median deviations, over all rows of the table. It
takes one pass that leaves a histogram; median and deviation are untouched by noise or copies as long as they are less
than half of a class. Classes of under ``least`` texts take the limit of the next shorter class.

Defined results: a null text counts as empty; an empty text has no ratio (null) and no chunk; texts and
last chunks shorter than the first band have no verdict. Every row gets one result row, repeated rows
each their own. The text is never cut: chunks cover it whole, and the last one, which may be shorter, is held against the
band of its own length. Extra columns are carried along; those named like a result column are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivesearch.llm.shared import col, free_name, without

#: (bytes from, lowest ratio, highest ratio) of a whole text; below the first, no verdict.
BANDS = ((64, 0.50, 1.25), (128, 0.42, 1.00), (256, 0.38, 0.85), (512, 0.34, 0.78),
         (1024, 0.30, 0.72), (2048, 0.27, 0.68), (4096, 0.24, 0.64), (16384, 0.20, 0.62))
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "ratio double, n_chunks long, n_bad_chunks long, verdict string")
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio",
           "n_chunks", "n_bad_chunks", "verdict", "base_failed", "kept")


@dataclass(frozen=True)
class Limits:
    """``chunk``: bytes of a chunk. A text fails when over ``max_bad_share`` of its bytes are in chunks
    outside the band of their length, widened by ``chunk_slack``. ``upper``: fitted upper limits by
    length class."""

    bands: tuple = BANDS
    chunk: int = 4096
    chunk_slack: float = 0.04
    max_bad_share: float = 0.5
    level: int = 3
    spread: float = 10.0
    least_deviation: float = 0.005
    least: int = 100
    upper: dict = field(default_factory=dict)

    def band(self, size: int) -> tuple[float, float] | None:
        """Lowest and highest ratio of ``size`` bytes; None if there is no verdict."""
        fixed = band_of(size, self.bands)
        return fixed and (fixed[0], min(fixed[1], self.upper.get(length_class(size), fixed[1])))


def length_class(size: int) -> int:
    """Half octaves: 2 * log2 of the size, rounded down."""
    octave = size.bit_length() - 1
    return 2 * octave + (size * size >= 1 << 2 * octave + 1)


def band_of(size: int, bands: tuple = BANDS) -> tuple[float, float] | None:
    found = None
    for start, low, high in bands:
        if size >= start:
            found = (low, high)
    return found


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    # The rank of each window: windows of 2, 4, ... words are numbered from their two halves.
    rank, have = ids, 1
    while have < window:
        step = min(have, window - have)
        left, right = rank[: len(rank) - step], rank[step:]
        _, rank = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)
        have += step
    again = np.bincount(rank)[rank] > 1
    starts = np.zeros(len(words) + 1, np.int64)
    starts[:n] += again
    starts[window:] -= again
    return int(np.count_nonzero(np.cumsum(starts)[:-1]))


def measure(text: str, compress, limits: Limits) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_symbols = len(text) - len(text.translate(_SYMBOLS))
    lines, dup = set(), 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line and not line.isspace():
                before = len(lines)
                lines.add(line)
                dup += len(lines) == before
    space = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    ratio, chunks, bad, verdict = None, 0, 0, "ok"
    if raw:
        ratio = len(compress(raw)) / len(raw)
        band = limits.band(len(raw))
        if band and ratio < band[0]:
            verdict = "repetitive"
        elif band and ratio > band[1]:
            verdict = "incompressible"
        bad_bytes = 0
        for at in range(0, len(raw), limits.chunk):
            chunk = raw[at:at + limits.chunk]
            chunks += 1
            band = limits.band(len(chunk)) if at or len(chunk) == limits.chunk else None  # a text of one short chunk is judged above
            r = len(compress(chunk)) / len(chunk) if band else 0.0
            if band and not band[0] - limits.chunk_slack <= r <= band[1] + limits.chunk_slack:
                bad += 1
                bad_bytes += len(chunk)
        if verdict == "ok" and bad_bytes > limits.max_bad_share * len(raw):
            verdict = "bad_chunks"
    return (len(words), len(text) - space, n_symbols, dup, repeat_words(words), ratio, chunks, bad, verdict)


def fit_limits(docs: DataFrame, limits: Limits = Limits()) -> Limits:
    """``limits`` with upper limits fitted to the ratios of all texts of ``docs``. What comes to the driver is a
    histogram: some 40 classes of about 1,000 ratios."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, seen = zstandard.ZstdCompressor(level=limits.level).compress, Counter()
        for batch in batches:
            for text in batch.column(0):
                raw = text.as_buffer() if text.is_valid else b""
                if (size := len(raw)) and band_of(size, limits.bands):
                    seen[length_class(size), int(1000 * len(compress(raw)) / size)] += 1
        pa.default_memory_pool().release_unused()  # the worker lives on
        rows = [(*key, n) for key, n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))],
                                         names=["class", "ratio", "n"])

    rows = (docs.select(col("text").alias("text")).mapInArrow(counted, "class int, ratio int, n long")
            .groupBy("class", "ratio").agg(F.sum("n").alias("n")).toPandas())
    upper: dict[int, float] = {}
    shorter = None
    for size_class in range(int(rows["class"].min()) if len(rows) else 0, 2 * 40):
        own = rows[rows["class"] == size_class].sort_values("ratio")
        if own["n"].sum() >= limits.least:
            middle = _median(own["ratio"], own["n"])
            off = pd.DataFrame({"off": (own["ratio"] - middle).abs(), "n": own["n"]}).sort_values("off")
            deviation = max(_median(off["off"], off["n"]) / 1000, limits.least_deviation)
            fitted = middle / 1000 + limits.spread * deviation
            shorter = fitted if shorter is None else min(shorter, fitted)  # longer texts compress better
        if shorter is not None:
            upper[size_class] = shorter
    return replace(limits, upper=upper)


def _median(values: pd.Series, counts: pd.Series) -> float:
    """Of sorted values with their counts."""
    return float(values.iloc[int(np.searchsorted(counts.cumsum(), counts.sum() / 2))])


def _udf(limits: Limits):
    @F.pandas_udf(_RESULT)
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compress = zstandard.ZstdCompressor(level=limits.level).compress
        names = [part.split()[0] for part in _RESULT.split(", ")]
        for texts in batches:
            found = pd.DataFrame([measure(t or "", compress, limits) for t in texts], columns=names)
            del texts
            pa.default_memory_pool().release_unused()  # the next batch, or another task, may be a large one
            yield found

    return quality.asNondeterministic()  # else a filter on its result would run it twice


def quality(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """All rows and columns of ``docs`` (but those named as in ``COLUMNS``) with the counts,
    ``verdict`` (ok, repetitive, incompressible, bad_chunks), ``base_failed`` and ``kept``. Without
    ``limits`` they are fitted to ``docs``."""
    limits = limits or fit_limits(docs)
    carried = without(docs, list(COLUMNS))
    tmp = free_name(docs, "_quality")
    out = docs.withColumn(tmp, _udf(limits)(col("text")))
    failed = ((F.col(f"{tmp}.n_words") < MIN_WORDS)
              | (100 * F.col(f"{tmp}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{tmp}.n_words")))
    return out.select(*[col(c) for c in carried], f"{tmp}.*", failed.alias("base_failed"),
                      (~failed & (F.col(f"{tmp}.verdict") == "ok")).alias("kept"))


def keep_good(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The documents that pass, with their own columns."""
    limits = limits or fit_limits(docs)
    tmp = free_name(docs, "_quality")
    out = docs.withColumn(tmp, _udf(limits)(col("text")))
    n, again = F.col(f"{tmp}.n_words"), F.col(f"{tmp}.n_repeat_words")
    good = (n >= MIN_WORDS) & (100 * again <= MAX_REPEAT_PERCENT * n) & (F.col(f"{tmp}.verdict") == "ok")
    return out.filter(good).select(*[col(c) for c in docs.columns])
