"""Toxic spans and scores by a linear-chain conditional random field.

Labels say only whether a document is toxic, so token labels are inferred first: a feature (a
word, or a prefix of one) that nearly only toxic documents have marks the tokens that carry it,
within toxic documents; all other tokens are clean. A two-label chain is fitted to segments of
such tokens (features, bias, transitions): L-BFGS steps on the exact likelihood, whose value and slope are summed
per partition by Spark; the driver holds parameters only. Forward and
backward sums give each token's marginal; marginals over one half form the offending spans, and
the largest marginal and the sum of the sizeable ones give the document's score through a
logistic curve fitted to the training documents.

Fitting uses a bounded sample of the labelled training rows (``Settings``) and all segments of
them, those without a feature too: equal segments are one row with their count as weight. Scoring
reads every whole text. Inputs of a score are words only. A text is tagged in segments that end with a
sentence or line, or after ``segment`` words; a segment without a known feature has the same
small marginals everywhere, so it is not run.

Defined results: null and empty texts have no tokens, no spans and the score of a text without
features. Rows that repeat a doc_id are scored each for itself; of conflicting labels of one
doc_id, toxic holds; rows with a null doc_id or label teach nothing. Without any toxic or any
clean training row all scores are the share of toxic ones (0.5 if there are no labels). Span
places are code points of the text. Extra columns are carried along; those named like a result
column are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivesearch.llm.shared import col, discard, free_name, hashed_sample, shared_path, stored, without

COLUMNS = ("score", "predicted", "spans")
_RESULT = "score double, predicted int, spans array<struct<start: int, end: int, p: double>>"
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_ASCII_LETTERS = "".join(chr(b) if chr(b).isalpha() else " " for b in range(128))
_FIT_ROWS = 2048  # segments whose sums are held at a time while fitting


@dataclass(frozen=True)
class Settings:
    """``sample_docs``: labelled rows that fit the model, with all their segments. A feature needs
    ``min_toxic`` toxic documents and a share of toxic among its (class-weighted) documents of
    ``min_share``; one of ``marker_share`` marks toxic tokens. ``max_features`` bounds the model: those
    with the highest share times root of toxic documents stay. ``steps``: at most so many steps of the fit."""

    sample_docs: int = 20_000
    max_features: int = 8192
    min_toxic: int = 5
    min_share: float = 0.7
    marker_share: float = 0.9
    prefixes: tuple = (4, 5, 6, 7, 8)
    segment: int = 32
    steps: int = 150
    l2: float = 1.0


def words_of(low: str) -> list[str]:
    """Runs of letters of a lower-cased text."""
    return low.translate(_ASCII_LETTERS).split() if low.isascii() else _WORD.findall(low)


def features_of(word: str, prefixes: tuple) -> list[str]:
    return [word, *(f"{word[:k]}~" for k in prefixes if len(word) > k)]


def held_out(doc_id):
    """Rows that may not teach: crc32 of the doc_id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    settings: Settings
    weights: dict = field(default_factory=dict)  # feature -> weight of label 1
    chain: np.ndarray = field(default_factory=lambda: np.zeros(5))  # bias, then 0->0, 0->1, 1->0, 1->1
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))  # of the score

    def __post_init__(self):
        self._words: dict[str, float] = {}  # words with a feature, and their summed weight
        self._seen: set[str] = set()

    def __getstate__(self):
        return {"settings": self.settings, "weights": self.weights, "chain": self.chain, "curve": self.curve}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def known(self, words: set[str]) -> set[str]:
        """Those of ``words`` that have a feature of the model; each new word is looked at once."""
        if new := words.difference(self._seen):
            if len(self._seen) > 500_000:
                self._seen.clear()
                self._words.clear()
                new = words
            weights, prefixes = self.weights, self.settings.prefixes
            for word in new:
                own = [weights[f] for f in features_of(word, prefixes) if f in weights]
                if own:
                    self._words[word] = sum(own)
            self._seen |= new
        return words & self._words.keys()

    def tag(self, texts: list[str | None]) -> list[list[tuple[int, int, float]]]:
        """Per text (start, end, marginal) of the tokens of all segments with a known feature. The
        chain runs over many segments of one length class at a time."""
        out: list[list] = [[] for _ in texts]
        runs: list[tuple[int, list, list]] = []
        for number, text in enumerate(texts):
            low = (text or "").lower()
            if len(low) != len(text or ""):
                low = text.translate({c: c + 32 for c in range(65, 91)})
            known = self.known(set(words_of(low)))
            if known:
                runs += [(number, tokens, [self._words.get(w, 0.0) for w, _, _ in tokens])
                         for tokens in segments(low, self.settings.segment, known)]
        runs.sort(key=lambda r: len(r[1]))  # stable: the segments of a text are put in order below
        for a in range(0, len(runs), _FIT_ROWS):
            part = runs[a:a + _FIT_ROWS]
            sizes = np.array([len(weights) for *_, weights in part])
            emissions = np.zeros((len(part), int(sizes.max())))
            for row, (*_, weights) in enumerate(part):
                emissions[row, :len(weights)] = weights
            marginals = _sums(emissions + self.chain[0], self.chain[1:], sizes)[0].tolist()
            for (number, tokens, _), p in zip(part, marginals):
                out[number] += [(start, end, x) for (_, start, end), x in zip(tokens, p)]
        for tagged in out:
            tagged.sort()
        return out

    def evidence(self, tagged: list[tuple[int, int, float]]) -> tuple[float, float]:
        top = max((p for *_, p in tagged), default=0.0)
        return (math.log((top + 1e-4) / (1 - top + 1e-4)), math.log1p(sum(p for *_, p in tagged if p >= 0.05)))

    def score(self, tagged: list[tuple[int, int, float]]) -> float:
        z = self.curve[0] + float(np.dot(self.curve[1:], self.evidence(tagged)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def result(self, tagged: list[tuple[int, int, float]]) -> tuple[float, int, list]:
        spans: list[dict] = []
        inside = False
        for start, end, p in tagged:
            if p >= 0.5 and inside:  # toxic tokens side by side are one span
                spans[-1].update(end=end, p=max(p, spans[-1]["p"]))
            elif p >= 0.5:
                spans.append({"start": start, "end": end, "p": p})
            inside = p >= 0.5
        score = self.score(tagged)
        return score, int(score >= 0.5), spans


def segments(low: str, size: int, known: set[str] | None = None) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of (word, start, end) that end with a sentence, a line or after ``size`` words; with
    ``known`` only those that hold one of its words (sentences without are passed over whole)."""
    for sentence in _SENTENCE.finditer(low):
        if known is not None and known.isdisjoint(words_of(sentence.group())):
            continue
        run = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(low, sentence.start(), sentence.end())]
        for at in range(0, len(run), size):
            part = run[at:at + size]
            if known is None or not known.isdisjoint(w for w, _, _ in part):
                yield part


def _sums(emissions: np.ndarray, moves: np.ndarray, sizes: np.ndarray, labels: np.ndarray | None = None,
          counts: np.ndarray | None = None):
    """Marginals of label 1 of padded rows; with ``labels`` also the log-likelihood and the observed
    less the expected moves, each row ``counts`` times (once, if there are none)."""
    n, width = emissions.shape
    inside = (np.arange(width) < sizes[:, None]).T
    # Probabilities instead of logarithms, a token's two scaled to sum 1 and each step of the sums scaled by ``scale``, so that nothing
    # overflows; tokens come first in all arrays.
    one = 1 / (1 + np.exp(-np.clip(emissions.T, -500, 500)))
    zero = 1 - one
    shift = moves.max()
    (m00, m01), (m10, m11) = np.exp(moves - shift).reshape(2, 2)
    ahead0, ahead1, scale = zero.copy(), one.copy(), np.ones((width, n))
    for t in range(1, width):
        a0, a1 = ahead0[t - 1], ahead1[t - 1]
        ahead0[t] *= a0 * m00 + a1 * m10
        ahead1[t] *= a0 * m01 + a1 * m11
        scale[t] = ahead0[t] + ahead1[t]
        ahead0[t] /= scale[t]
        ahead1[t] /= scale[t]
    behind0, behind1 = np.ones((width, n)), np.ones((width, n))
    for t in range(width - 2, -1, -1):
        b0, b1 = zero[t + 1] * behind0[t + 1] / scale[t + 1], one[t + 1] * behind1[t + 1] / scale[t + 1]
        behind0[t] = np.where(inside[t + 1], m00 * b0 + m01 * b1, 1.0)
        behind1[t] = np.where(inside[t + 1], m10 * b0 + m11 * b1, 1.0)
    p = np.where(inside, ahead1 * behind1, 0.0)
    if labels is None:
        return p.T, None, None
    counts = np.ones(n) if counts is None else counts
    both = inside[1:]
    times = np.where(both, counts / scale[1:], 0.0)
    into0, into1 = zero[1:] * behind0[1:] * times, one[1:] * behind1[1:] * times
    expected = np.array([m00 * (ahead0[:-1] * into0).sum(), m01 * (ahead0[:-1] * into1).sum(),
                         m10 * (ahead1[:-1] * into0).sum(), m11 * (ahead1[:-1] * into1).sum()])
    index = labels[:, :-1] * 2 + labels[:, 1:]
    observed = np.bincount(index[both.T], np.repeat(counts, sizes - 1), minlength=4)
    total = np.where(inside, np.log(scale) + np.logaddexp(0, emissions.T), 0.0).sum(axis=0) + shift * (sizes - 1)
    likely = float((counts * ((emissions * labels).T * inside).sum(axis=0) - counts * total).sum() + observed @ moves)
    return p.T, likely, observed - expected


def _lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the lists of a column (and the end), and their elements one after the other."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), lists.flatten().to_numpy(zero_copy_only=False)


def chain_slope(rows: pa.RecordBatch, params: np.ndarray) -> np.ndarray:
    """Slope of the log-likelihood of ``rows`` of distinct segments at ``params`` (weights, bias, moves), the likelihood
    itself, and the number of segments. Columns: size (number of tokens), places of features, their numbers,
    places of toxic tokens, n (how often the segment is there). Rows in order of size make narrow blocks."""
    sizes = rows.column("size").to_numpy().astype(np.int64)
    counts = rows.column("n").to_numpy().astype(float)
    (first_place, places), (_, which), (first_toxic, toxic) = (_lists(rows.column(k)) for k in ("places", "numbers", "toxic"))
    n_features = len(params) - 5
    weights, chain = params[:n_features], params[n_features:]
    out = np.zeros(len(params) + 2)
    for a in range(0, len(sizes), _FIT_ROWS):
        part = slice(a, a + _FIT_ROWS)
        own, own_counts = sizes[part], counts[part]
        b, width = a + len(own), int(own.max())
        line = np.arange(len(own)) * width
        at = slice(first_place[a], first_place[b])
        where = np.repeat(line, np.diff(first_place[a:b + 1])) + places[at]
        labels = np.zeros((len(own), width), np.int64)
        labels.reshape(-1)[np.repeat(line, np.diff(first_toxic[a:b + 1])) + toxic[first_toxic[a]:first_toxic[b]]] = 1
        emissions = np.bincount(where, weights[which[at]], minlength=labels.size).reshape(labels.shape) + chain[0]
        p, likely, moved = _sums(emissions, chain[1:], own, labels, own_counts)
        off = (labels - p) * (np.arange(width) < own[:, None]) * own_counts[:, None]
        out[:n_features] += np.bincount(which[at], off.reshape(-1)[where], minlength=n_features)
        out[n_features] += off.sum()
        out[n_features + 1:-2] += moved
        out[-2] += likely
        out[-1] += own_counts.sum()
    return out


def climb(total, params: np.ndarray, l2: float, steps: int) -> np.ndarray:
    """L-BFGS steps to the maximum of the mean likelihood less the ridge. ``total(params)`` is the sum of ``chain_slope``."""

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        *slope, likely, n = total(x)
        return (0.5 * l2 * float(x @ x) - likely) / n, (l2 * x - np.array(slope)) / n

    value, slope = at(params)
    past: list[tuple] = []
    for _ in range(steps):
        direction = -slope
        held = []
        for s, y, r in reversed(past):
            held.append(r * float(s @ direction))
            direction = direction - held[-1] * y
        if past:
            s, y, r = past[-1]
            direction = direction / (r * float(y @ y))
        else:
            direction = direction / max(1.0, float(np.abs(direction).sum()))
        for (s, y, r), a in zip(past, reversed(held)):
            direction = direction + (a - r * float(y @ direction)) * s
        down, size = float(slope @ direction), 1.0
        while True:
            new, new_slope = at(params + size * direction)
            if new <= value + 1e-4 * size * down or size < 1e-6:
                break
            size /= 2
        moved, change = size * direction, new_slope - slope
        if new > value:
            break
        gain, params, value, slope = value - new, params + moved, new, new_slope
        if float(moved @ change) > 1e-16:
            past = [*past, (moved, change, 1 / float(moved @ change))][-10:]
        if gain < 1e-6 * abs(value) or np.abs(slope).max() < 1e-7:
            break
    return params


def _slopes(rows: DataFrame):
    """The sum of ``chain_slope`` over the partitions of stored ``rows``, as a function of the parameters."""
    sc = rows.sparkSession.sparkContext

    def total(params: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(params)  # at most max_features + 5 numbers

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(shared.value) + 2)
            for batch in batches:
                out += chain_slope(batch, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        found = rows.coalesce(64).mapInArrow(summed, "sums binary").collect()  # at most 64 vectors
        shared.destroy()
        return sum(np.frombuffer(r["sums"]) for r in sorted(found))

    return total


def fit_chain(rows: DataFrame | pa.Table, n_features: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and chain parameters from ``rows`` of segments (see ``chain_slope``): a stored table, or a local one."""
    total = _slopes(rows) if isinstance(rows, DataFrame) else (
        lambda params: sum(chain_slope(b, params) for b in rows.combine_chunks().to_batches()))
    params = np.zeros(n_features + 5)
    params[n_features] = -2.0
    params = climb(total, params, settings.l2, settings.steps)
    return params[:n_features], params[n_features:]


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic curve by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit a model on a bounded sample of the labelled rows that are not held out."""
    ids = (labels.select(col("doc_id").cast("long").alias("_id"), col("toxic").cast("int").alias("_toxic"))
           .dropna().filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic")))
    ids = hashed_sample(ids, ["_id"], settings.sample_docs)
    rows = docs.select(col("doc_id").cast("long").alias("_id"), col("text").alias("text")).filter("text is not null")
    # At most sample_docs short rows are broadcast; the sample is read several times.
    spark, places = docs.sparkSession, [shared_path(docs.sparkSession, f"toxicity-{n}") for n in ("sample", "segments")]
    sample = stored(rows.join(F.broadcast(ids), "_id").select("text", F.col("_toxic").alias("toxic")), places[0])
    model, prefixes = Model(settings), settings.prefixes

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, n = Counter(), Counter(), [0, 0]

        def batch() -> pa.RecordBatch:
            names = list(toxic.keys() | clean.keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(names + [""], pa.string()), pa.array([toxic[f] for f in names] + [n[1]], pa.int64()),
                 pa.array([clean[f] for f in names] + [n[0]], pa.int64())], names=["feature", "n_toxic", "n_clean"])

        for rows in batches:
            for text, mark in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                words = set(words_of(text.lower()))
                (toxic if mark else clean).update({f for w in words for f in features_of(w, prefixes)})
                n[bool(mark)] += 1
                if len(toxic) + len(clean) > 1_000_000:
                    yield batch()
                    toxic, clean, n = Counter(), Counter(), [0, 0]
        yield batch()

    counts = (sample.mapInArrow(counted, "feature string, n_toxic long, n_clean long").groupBy("feature")
              .agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean")))
    counts = counts.filter((F.col("n_toxic") >= settings.min_toxic) | (F.col("feature") == "")).persist()
    whole = counts.filter("feature = ''").first()
    n_toxic, n_clean = (whole["n_toxic"], whole["n_clean"]) if whole else (0, 0)
    if not n_toxic or not n_clean:
        share = min(max(n_toxic / (n_toxic + n_clean), 1e-6), 1 - 1e-6) if n_toxic + n_clean else 0.5
        model.curve = np.array([math.log(share / (1 - share)), 0.0, 0.0])
        counts.unpersist()
        discard(spark, places[0])
        return model
    # Share of toxic documents among those with the feature, as if both classes were equally large.
    a, b = F.col("n_toxic") / n_toxic, (F.col("n_clean") + 0.5) / n_clean
    chosen = (counts.filter("feature <> ''").withColumn("share", a / (a + b)).filter(F.col("share") >= settings.min_share)
              .orderBy(F.desc(F.col("share") * F.sqrt("n_toxic")), "feature").limit(settings.max_features).collect())
    counts.unpersist()
    number = {r["feature"]: n for n, r in enumerate(chosen)}
    marker = {r["feature"] for r in chosen if r["share"] >= settings.marker_share}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[tuple] = []
            for text, mark in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                for run in segments(text.lower(), settings.segment):
                    own = [(t, f) for t, (w, _, _) in enumerate(run) for f in features_of(w, prefixes) if f in number]
                    toxic = sorted({t for t, f in own if mark and f in marker})
                    out.append((len(run), [t for t, _ in own], [number[f] for _, f in own], toxic))
            kinds = (pa.int32(), *[pa.list_(pa.int32())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)],
                                             names=["size", "places", "numbers", "toxic"])

    # All segments: equal ones are one row with their count.
    runs = sample.mapInArrow(cut, "size int, places array<int>, numbers array<int>, toxic array<int>")
    rows = stored(runs.groupBy(*runs.columns).agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions(*runs.columns), places[1])
    if number and not rows.isEmpty():
        weights, model.chain = fit_chain(rows, len(number), settings)
        model.weights = {f: float(weights[n]) for f, n in number.items() if abs(weights[n]) > 1e-3}
    model.curve = np.zeros(3)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [model.evidence(tagged) for tagged in model.tag(rows.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.float64()),
                                              pa.array([x[1] for x in found], pa.float64()), rows.column(1)],
                                             names=["top", "total", "toxic"])

    # Rounded counts, not rows, come back: what repeats is one row with its number.
    points = (sample.mapInArrow(seen, "top double, total double, toxic int")
              .groupBy(F.round("top", 1).alias("top"), F.round("total", 1).alias("total"), "toxic").count()
              .orderBy("top", "total", "toxic").toPandas())
    x = np.repeat(points[["top", "total"]].to_numpy(), points["count"], axis=0)
    model.curve = fit_curve(x, np.repeat(points["toxic"].to_numpy().astype(float), points["count"]))
    for place in places:
        discard(spark, place)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` (but those named as in ``COLUMNS``) with the score, the
    prediction and the toxic spans."""
    carried, tmp = without(docs, list(COLUMNS)), free_name(docs, "_toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features weights

    @F.pandas_udf(_RESULT)
    def scored(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        found = [model.result(tagged) for tagged in model.tag(texts.tolist())]
        return pd.DataFrame(found, columns=list(COLUMNS))

    return docs.withColumn(tmp, scored.asNondeterministic()(col("text"))).select(*[col(c) for c in carried], f"{tmp}.*")
