"""Line dedup, SimHash, components, decontamination: against brute force and on odd inputs."""
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from archivesearch.llm import decontaminate as D
from archivesearch.llm import line_dedup as L
from archivesearch.llm import simhash as S
from archivesearch.llm.components import components

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, N_Lines int"


def brute_lines(rows, min_docs=5, min_chars=40):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    holders = {}
    for doc_id, text in rows:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def lines():
    rnd = random.Random(2)
    common = ["Shared Line %d with enough characters to be counted é" % i for i in range(12)]
    rows = [(None, common[0]), (500, None), (501, ""), (502, "\n\n"), (503, "short\n" * 5), (504, common[1] + "\r\n" + common[1])]
    for i in range(60):
        own = [f"line {i} {j} that only this document has, also rather long" for j in range(rnd.randint(0, 4))]
        own += [f"  {c.upper() if rnd.random() < 0.3 and 'é' not in c else c}\t" for c in rnd.sample(common, rnd.randint(0, 6))]
        rnd.shuffle(own)
        rows.append((i, "\n".join(own)))
    return rows + rows[10:13]


def as_rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


def test_lines_against_brute_force(spark, lines):
    docs = spark.createDataFrame([(i, t, 9) for i, t in lines], DOCS)
    out = L.dedup_lines(docs)
    assert as_rows(out) == brute_lines(lines)
    assert sum(r[2] for r in as_rows(out)) > 20


def test_line_index_is_reversible(spark, lines):
    docs = spark.createDataFrame([(i, t, 9) for i, t in lines if i is not None], DOCS)
    first, rest = docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 = 0")
    plain = [(r.doc_id, r.text) for r in first.collect()]
    index = L.LineIndex.build(first, keys_per_shard=16)
    before = as_rows(index.apply(first))
    assert before == brute_lines(plain)
    more = index.insert(rest)
    assert as_rows(more.apply(docs)) == brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    again = more.insert(rest)  # nothing new
    assert again.counts.exceptAll(more.counts).isEmpty()
    back = again.delete(rest.select("doc_id"))
    assert as_rows(back.apply(first)) == before
    assert back.refs.exceptAll(index.refs).isEmpty() and index.counts.exceptAll(back.counts).isEmpty()
    assert back.delete(spark.createDataFrame([(10 ** 9,), (None,)], "doc_id long")).counts.exceptAll(back.counts).isEmpty()


def test_cuckoo_filter_holds_and_forgets():
    rnd = np.random.default_rng(1)
    keys = rnd.integers(0, 1 << 63, size=(3000, 2)).astype(np.uint64)
    small = L.CuckooFilter(np.zeros((64, 4), np.uint16), np.zeros((0, 2), np.uint32))
    small.insert(keys[:400])  # more than it has room for: the rest is in the stash
    assert len(small.stash) and small.contains(keys[:400]).all()
    small = L.CuckooFilter.load(small.dump())
    small.delete(keys[:200])
    assert small.contains(keys[200:400]).all()
    full = L.CuckooFilter.sized(1000)
    full.insert(keys[:1000])
    assert full.contains(keys[:1000]).all() and full.contains(keys[1000:]).mean() < 0.01
    full.delete(keys[:1000])
    assert not full.table.any() and not full.contains(keys).any()


def test_lines_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    least = list(range(len(prints)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                least[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_masks_cover_every_pair_within_the_radius():
    import itertools
    for radius, width in ((1, 12), (2, 12), (3, 16)):
        for family in (0, 1):
            own = S.masks(radius, family, width)
            for bits in itertools.combinations(range(width), radius):
                assert any(not m & sum(1 << b for b in bits) for m in own)


def test_fingerprints_and_components(spark):
    rnd = random.Random(4)
    base = " ".join(f"w{rnd.randint(0, 400)}" for _ in range(300))
    texts = [None, "", "  ", "one", "two words", "Three little words", "three LITTLE words", "é ü", base, base.upper(), "x " * 50_000]
    texts += [base + f" tail{i}" for i in range(25)]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)] + [(None, base, "b"), (3, "one", "c")],
                                 "doc_id long, text string, fp string")
    out = S.near_duplicates(docs).collect()
    assert len(out) == len(texts) + 2
    prints = [brute_print(t) for t in texts]
    want = brute_components(prints)
    for r in out:
        if r.doc_id is not None:
            assert r.fp & (1 << 64) - 1 == prints[r.doc_id] and r.component_id == want[r.doc_id]
    assert [r.component_id for r in out if r.doc_id is None] == [want[8]]
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted([*set(want), 3])


@pytest.mark.parametrize("max_bucket,levels", [(1 << 14, 3), (8, 3), (4, 1)])
def test_links_keep_components_when_buckets_are_refined(spark, max_bucket, levels):
    rnd = random.Random(6)
    prints = set()
    for _ in range(12):
        chain = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 30)):
            prints.add(chain)
            for _ in range(rnd.randint(1, 5)):
                chain ^= 1 << rnd.randrange(64)
    prints = sorted(prints)
    rows = spark.createDataFrame([(S._signed(p), 0) for p in prints], "fp long, least long")
    edges = S.links(rows, 3, max_bucket=max_bucket, levels=levels)
    got = {r.vertex & (1 << 64) - 1: r.component for r in components(edges).collect()}
    want = brute_components(prints)
    groups = {}
    for p, w in zip(prints, want):
        groups.setdefault(w, set()).add(p)
    for members in groups.values():
        if len(members) > 1:
            assert len({got[p] for p in members}) == 1
        else:
            assert not members & got.keys()
    assert len({got[p] for p in got}) == sum(len(m) > 1 for m in groups.values())


def test_simhash_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_random_graphs(spark):
    rnd = random.Random(9)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(1000, 1060)]
    pairs += [(5000, 5001 + i) for i in range(50)] + [(7, 7)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(pairs + [(None, 3)], "u long, v long")).collect()}
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        least[max(x, y)] = min(x, y)
    assert got == {v: find(v) for p in pairs if p[0] != p[1] for v in p}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_against_alignment(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    items = [" ".join(word() for _ in range(rnd.randint(8, 20))) for _ in range(6)] + ["tiny", "", None]
    texts = [None, "", "nothing here at all " * 3000]
    for _ in range(60):
        chars = list(rnd.choice(items[:6]))
        for _ in range(rnd.randint(0, 14)):
            at = rnd.randrange(len(chars))
            chars[at] = rnd.choice(["", "z", "zz", chars[at].upper()])
        texts.append(f"Start, {word()}; {''.join(chars)}! -- {word()}")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, items[0]), (3, texts[3])], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = D.find_leaks(docs, bench).collect()
    normal = [D.normal_item(t) for t in texts]
    want = set()
    for n, item in enumerate(items[:6]):
        raw = D.normal_item(item)
        k = int(D.Finder((raw,)).edits[0])
        want |= {(i, n) for i, t in enumerate(normal) if distance(raw, t) <= k}
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id is not None} == want and len(want) > 20
    assert [(r.item_id, r.start, r.end, r.edits) for r in found if r.doc_id is None] == [(0, 0, len(items[0]), 0)]
    for r in found:
        if r.doc_id is not None and r.edits == 0:
            assert D.normal_item(texts[r.doc_id][r.start:r.end]) == D.normal_item(items[r.item_id])
    small = D.find_leaks(docs, bench, block_bytes=100)  # a block for each item
    assert sorted(map(str, small.collect())) == sorted(map(str, found))
    clean = D.keep_clean(docs, bench, block_bytes=100)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i in [*range(len(texts)), 3] if i not in {i for i, _ in want})


def test_leaks_odd_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_leaks(docs, none).count() == 0 and D.keep_clean(docs, none).count() == 1
    one = spark.createDataFrame([(1, "a benchmark item of some length, really")], "item_id long, text string")
    assert D.find_leaks(docs.limit(0), one).count() == 0
    accents = spark.createDataFrame([(1, "vor A BENCHMARK item, of some-length ÄÖ RÉALLY danach")], "doc_id long, text string")
    item = spark.createDataFrame([(4, "a benchmark item of some length äö réally")], "item_id long, text string")
    hit = D.find_leaks(accents, item).first()
    assert (hit.start, hit.end, hit.edits) == (4, 46, 0)


def test_kept_hash_is_of_the_text(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(1, None), (2, "é\nb")], "doc_id long, text string")
    got = {r.doc_id: r.h for r in L.dedup_lines(docs).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).collect()}
    assert got == {1: hashlib.sha256(b"").hexdigest(), 2: hashlib.sha256("é\nb".encode()).hexdigest()}
