"""The whole pipeline against a plain computation of its stages on a small corpus."""
import random
import tempfile

import zstandard
from test_dedup_operators import brute_components, brute_lines, brute_print, distance
from test_stores import crc, direct

import corpus_pipeline
from archivesearch.llm import decontaminate, packing, quality


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    items = [" ".join(word() for _ in range(12)) for _ in range(3)]
    shared = "this very line stands in many documents and is long enough to count"
    texts = []
    for n in range(36):
        lines = [" ".join(word() for _ in range(rnd.randint(6, 14))) for _ in range(rnd.randint(4, 9))]
        if n % 4 == 0:
            lines.insert(1, shared if n % 8 else f"  {shared.upper()}\t")
        if n % 9 == 5:
            lines.append("then " + items[n % 3].replace("a", "", 1) + " end")
        texts.append("\n".join(lines))
    texts += [texts[2], texts[3].upper(), "  " + texts[6].replace("\n", "\n\n")]
    texts += ["again and again " * 60, "too short", "", None, "x" * 500]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return [(i, texts[i], "en", "s", len(texts[i] or "")) for i in order], items


def plain_pipeline(rows, items):
    compress = zstandard.ZstdCompressor(level=3).compress
    kept = []
    for doc_id, text, *_ in rows:
        n_words, _, _, _, again, *_, verdict = quality.measure(text or "", compress, quality.Limits())
        if n_words >= 20 and 100 * again <= 30 * n_words and verdict == "ok":
            kept.append((doc_id, text))
    lines = sorted((r[0], r[3]) for r in brute_lines(kept))
    first = brute_components([brute_print(t) for _, t in lines])
    unique = [row for n, row in enumerate(lines) if first[n] == n]
    normal = [decontaminate.normal_item(i) for i in items]
    limits = [int(decontaminate.Finder((i,)).edits[0]) for i in normal]
    clean = [(d, t) for d, t in unique
             if all(distance(i, decontaminate.normal_item(t)) > k for i, k in zip(normal, limits))]
    sizes = [len(x) for x in (rows, kept, lines, unique, clean)]
    pieces = []
    for doc_id, text in clean:
        ids, start = direct(text, 1), 0
        for length in packing.cuts(len(ids)):
            pieces.append((doc_id, start, length, crc(ids[start:start + length]), len(ids), 0))
            start += length
    return sorted(pieces), sizes


def test_pipeline_equals_plain_computation(spark):
    rows, items = corpus()
    folder = tempfile.mkdtemp(prefix="run-")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    want, sizes = plain_pipeline(rows, items)
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4]  # each filter has something to do
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in got) == want
    assert len({r.sequence_id for r in got}) == len(got)
