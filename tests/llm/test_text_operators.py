"""Quality bands, licence scan, toxicity: against brute force and on odd inputs."""
import re
from collections import Counter

import pytest
import zstandard

from archivesearch.llm import license_scan as licenses
from archivesearch.llm import quality as Q
from archivesearch.llm import toxicity as X

SCHEMA = "doc_id long, text string, Score string, `odd.name` int"
TEXTS = [None, "", " \n\t", "one", "word " * 50, "a b c d e f g h\n" * 9 + "tail", "é" * 300, "x#y $ 1 < 2 | &",
         "cc by CC-BY all rights reserved General Public License", "Licensed under the Apache License, Version 2.0.",
         "All\x00rights\nreserved cc by by", " ".join(f"w{i % 13}" for i in range(400)), "long " * 60_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", 1) for i, t in enumerate(TEXTS)] + [(3, "one", "again", 2), (None, "no id", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again))


def test_quality_counts_and_verdicts(docs):
    out = Q.quality(docs)
    assert "odd.name" in out.columns and "Score" in out.columns
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2
    by_text = dict(enumerate(TEXTS))
    for r in rows:
        if r.doc_id is None:
            continue
        text = by_text[r.doc_id]
        want = brute_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and r.verdict == "ok")
        if text:
            raw = text.encode()
            assert r.ratio == len(zstandard.ZstdCompressor(level=3).compress(raw)) / len(raw)
        else:
            assert r.ratio is None
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_quality_bands_reject_noise_and_repetition():
    import base64
    import random
    rnd = random.Random(1)
    noise = base64.b64encode(rnd.randbytes(6000)).decode()
    compress = zstandard.ZstdCompressor(level=3).compress
    assert Q.measure(noise, compress, Q.Limits())[-1] == "incompressible"
    assert Q.measure("the same again. " * 500, compress, Q.Limits())[-1] == "repetitive"
    half = " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) + str(rnd.randint(0, 99)) for _ in range(3000))
    mixed = half + "0" * 3 * len(half)
    assert Q.measure(mixed, compress, Q.Limits(bands=((64, 0.0, 9.0), (4096, 0.0, 9.0), (5000, 0.0, 9.0)), chunk=4096))[-1] == "ok"
    assert Q.measure(mixed, compress, Q.Limits(bands=((64, 0.0, 9.0), (4096, 0.2, 9.0), (5000, 0.0, 9.0)), chunk=4096))[-1] == "bad_chunks"


def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in licenses.BASE.items():
        want = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(want)] == want]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in found})))


def test_license_base_counts(docs):
    for r in licenses.license_scan(docs.drop("Score")).collect():
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_places(TEXTS[r.doc_id])
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
            assert 0 <= r.score <= 1


def test_license_random_texts_against_brute_force():
    import random
    rnd, one = random.Random(7), licenses.scanner(licenses.Rules())
    parts = ["under the gnu", "general public license", "cc by", "all rights", "reserved", "by", "x", "the mit license"]
    for _ in range(800):
        text = " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        assert one.scan(text)[:5] == brute_places(text)


def test_license_spans_and_gaps():
    one = licenses.scanner(licenses.Rules())
    text = "intro words here. Licensed under the terms of the Apache License, Version 2.0 and more"
    assert one.scan(text)[5] == "apache-2.0"
    body = licenses.TEMPLATES[0][1]
    spans = one.scan("before " + body + " after")[7]
    assert any(s["label"] == "mit" and s["first_word"] == 1 and s["coverage"] == 1.0 for s in spans)
    assert one.scan("the of and to a program in the text " * 50)[5] == ""


def test_license_templates_inside_longer_matches():
    one = licenses.scanner(licenses.Rules())
    notice = "Licensed under the Apache License, Version 2.0"
    for after in ("", " and more", ". The rest of the text", ' (the "Licence holder")'):
        scanned = one.scan(notice + after)
        assert (scanned[5], scanned[6]) == ("apache-2.0", 1.0)  # and not mit, for 'licensed under the'
        assert {(s["first_word"], s["last_word"], s["coverage"]) for s in scanned[7]} == {(0, 7, 1.0)}
    # Every template that stands whole in a text is a span, whatever words of templates stand around it.
    for label, text in licenses.TEMPLATES:
        size = len(licenses.words_of(text))
        for word in sorted(one.automaton.ids):
            word = word.decode()
            got = {(s["label"], s["last_word"]) for s in one.scan(f"{word} zzz {text} {word}")[7] if s["coverage"] == 1.0}
            assert any(name == label and last >= size + 1 for name, last in got), (text, word)
    sharealike = next(text for label, text in licenses.TEMPLATES if label == "cc-by-sa")
    assert one.scan(sharealike)[5] == "cc-by-sa"
    assert one.scan("Licensed under the GNU General Public License")[5] == "gpl"
    # A link of one template inside a longer match of another joins its chain.
    rules = licenses.Rules(templates=(("a", "p q r s t u v"), ("b", "x q r s t y z w")), min_cover=0.7)
    assert licenses.scanner(rules).scan("x q r s t y z w")[5] == "b"
    rules = licenses.Rules(templates=(("a", "p q r s t u v w"), ("b", "k p q r m n o"), ("c", "j s t u v w")), min_cover=1.0)
    assert "a" in licenses.scanner(rules).scan("k p q r x s t u v w")[5]


def test_matching_statistics_are_longest_matches():
    import random
    rnd = random.Random(3)
    strings = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(1, 12))] for _ in range(5)]
    automaton = licenses.Automaton(strings)
    inside = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(300):
        words = [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randint(0, 20))]
        got = {at: (state, n) for at, state, n in automaton.statistics(words)}
        for at in range(len(words)):
            want = max((n for n in range(1, at + 2) if tuple(words[at + 1 - n:at + 1]) in inside), default=0)
            assert got.get(at, (0, 0))[1] == want
            if want:
                ends = {(k, e) for k, s in enumerate(strings) for e in range(want, len(s) + 1)
                        if s[e - want:e] == words[at + 1 - want:at + 1]}
                assert automaton.ends[got[at][0]] == ends


def test_toxicity_learns_and_handles_odd_rows(spark):
    import random
    rnd = random.Random(5)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rnd.randrange(40)] = rnd.choice(["nastybad", "nastyword", "vilething"])
        rows.append((i, " ".join(words), "x", 1))
        labels.append((i, int(toxic)))
    odd = [(9001, None, "x", 1), (9002, "", "x", 1), (9003, "nastybad " * 20_000, "x", 1), (9004, "!!", "x", 1)]
    docs = spark.createDataFrame(rows + odd + rows[:1], SCHEMA)
    lab = spark.createDataFrame(labels + [(9001, 1), (None, 1), (77, None)], "doc_id long, toxic int")
    model = X.train(docs, lab, X.Settings(sample_docs=500))
    out = X.score(docs, model)
    assert "Score" not in out.columns  # clashes with the result's own
    got = out.select("doc_id", "score", "predicted", "spans", X.held_out(out.doc_id).alias("held")).collect()
    assert len(got) == len(rows) + 5
    truth = dict(labels)
    held = [r for r in got if r.held and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    texts = {r[0]: r[1] for r in rows}
    marked = [r for r in got if truth.get(r.doc_id)]
    assert all(texts[r.doc_id][s.start:s.end].startswith(("nasty", "vile")) for r in marked for s in r.spans)
    by_id = {r.doc_id: r for r in got}
    assert by_id[9001].score == by_id[9002].score == by_id[9004].score < 0.5 < by_id[9003].score
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_counts_of_equal_segments_are_weights():
    import numpy as np
    import pyarrow as pa
    rows = [(3, [0, 2], [0, 1], [0]), (1, [], [], []), (5, [4], [2], [4]), (2, [1], [1], []), (1, [0], [0], [0])]
    times = [3, 7, 2, 4, 1]

    def fitted(rows, times):
        table = pa.table({k: pa.array([r[n] for r in rows], pa.int32() if n == 0 else pa.list_(pa.int32()))
                          for n, k in enumerate(("size", "places", "numbers", "toxic"))} | {"n": pa.array(times, pa.int64())})
        return X.fit_chain(table, 3, X.Settings())

    single = [r for r, n in zip(rows, times) for _ in range(n)]
    for a, b in zip(fitted(rows, times), fitted(single, [1] * len(single))):
        assert np.allclose(a, b, atol=1e-6)


def test_toxicity_copies_crowd_out_no_segment(spark):
    copied = " ".join(f"nasty {a}{b}{a}{b}." for a in "abcdefghij" for b in "klmnopqrst")  # 100 segments
    rare = [f"z{a}q{b}" for a in "bcdfg" for b in "hjkl"]
    texts = [(copied, 1)] * 400 + [(f"some {w} words", 1) for w in rare for _ in range(12)]
    texts += [(f"some other words number {'abcdefghij'[i % 10]}", 0) for i in range(800)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, mark) for i, (_, mark) in enumerate(texts)], "doc_id long, toxic int")
    model = X.train(docs, labels)
    assert set(rare) <= {f for f, w in model.weights.items() if w > 0}
    found = X.score(docs, model).select("doc_id", "predicted").collect()
    assert all(r.predicted == texts[r.doc_id][1] for r in found)


def test_toxicity_keeps_small_weights(spark, monkeypatch):
    import numpy as np
    steps = []

    def fitted(rows, n_features, settings):
        steps.append(settings.steps)
        return np.full(n_features, 0.05), np.zeros(5)

    monkeypatch.setattr(X, "fit_chain", fitted)
    docs = spark.createDataFrame([(i, "vile thing" if i % 2 else "fair thing") for i in range(60)], "doc_id long, text string")
    model = X.train(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    assert model.weights.get("vile") == 0.05 and steps == [150]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.score(docs, X.train(docs, none)).first().score == 0.5
    assert X.score(docs.limit(0), X.train(docs, none)).count() == 0


def test_chain_sums_match_enumeration():
    import itertools

    import numpy as np
    rnd = np.random.default_rng(0)
    emissions, moves = rnd.normal(size=(1, 5)), rnd.normal(size=4)
    paths = list(itertools.product((0, 1), repeat=5))
    weight = [np.exp(sum(emissions[0, t] * y for t, y in enumerate(p)) + sum(moves[2 * a + b] for a, b in zip(p, p[1:])))
              for p in paths]
    want = [sum(w for w, p in zip(weight, paths) if p[t]) / sum(weight) for t in range(5)]
    labels = np.array([[0, 1, 1, 0, 1]])
    p, loglik, moved = X._sums(emissions, moves, np.array([5]), labels)
    assert np.allclose(p[0], want)
    assert np.isclose(loglik, np.log(weight[paths.index((0, 1, 1, 0, 1))] / sum(weight)))
    expect = [sum(w * sum((a, b) == (x, y) for a, b in zip(p, p[1:])) for w, p in zip(weight, paths)) / sum(weight)
              for x in (0, 1) for y in (0, 1)]
    assert np.allclose(moved, np.array([0, 2, 1, 1]) - expect)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert Q.quality(none).count() == 0 and licenses.license_scan(none).count() == 0
