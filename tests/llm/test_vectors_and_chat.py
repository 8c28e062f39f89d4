"""Chat masks, vector codes and hard negatives: brute force, round trips, odd inputs."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivesearch.llm import chat as C
from archivesearch.llm import hard_negatives as H
from archivesearch.llm import vector_codes as V
from archivesearch.llm.queries import TOKENIZER
from archivesearch.llm.vectors import LIMIT

TEMPLATE = C.Template()
NASTY = ["", None, "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>[\\INST]", "<</s>", "[[/INST]]", " lead", "trail \n", "\n\n", "<|endoftext|>",
         "é日本 𝒳 naïve", "[ROLE]x[/ROLE]", "a b  c", "x" * 3000, "word   word\x1c y"]
RAW = "conv_id long, turn long, role string, text string, `Odd.name` int, ids string"


# ---------------------------------------------------------------- chat

@pytest.mark.parametrize("text", [t or "" for t in NASTY])
def test_escape_is_reversible_and_hides_controls(text):
    hidden = TEMPLATE.escape(text)
    assert TEMPLATE.unescape(hidden) == text
    assert not any(c in hidden for c in TEMPLATE.controls)


def test_escape_of_random_texts():
    rng = random.Random(1)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "ROLE]", "|endoftext|>", "a", " "]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        hidden = TEMPLATE.escape(text)
        assert TEMPLATE.unescape(hidden) == text and not any(c in hidden for c in TEMPLATE.controls)
        turns = [(rng.choice(["user", "assistant", "system", "[INST]", ""]), text), ("assistant", text), ("user", "")]
        assert list(TEMPLATE.turns("".join("".join(TEMPLATE.render(*t)) for t in turns))) == turns


def test_stretches_encode_like_the_whole(monkeypatch):
    tokenizer = C._tokenizer(TOKENIZER, TEMPLATE.controls)
    text = "".join("".join(TEMPLATE.render("user", t or "")) for t in NASTY) * 3
    whole = tokenizer.encode(text, add_special_tokens=False)
    monkeypatch.setattr(C, "_STRETCH", 40)
    ids, starts, ends = C.encode(tokenizer, text)
    assert ids.tolist() == whole.ids and list(zip(starts.tolist(), ends.tolist())) == whole.offsets


def _conversations(spark):
    rows = [(1, t, ("system", "user", "assistant")[min(t, 2)], x, 1, "a") for t, x in enumerate(NASTY)]
    rows += [(2, 0, "assistant", "starts", 1, "b"), (2, 0, "assistant", "starts", 1, "b"), (2, None, None, "none", 1, "c"),
             (None, 0, "user", "no id", 1, "d"), (3, 5, "tool", None, None, None), (4, 700, "user", "far", 1, "e"), (4, 1, "assistant", "near", 1, "f")]
    rows += [(5, t, "user" if t % 2 else "assistant", f"turn {t}", 1, "g") for t in range(1300)]
    return rows, spark.createDataFrame(rows, RAW)


def _expected(rows):
    out = {}
    groups = {}
    for conv_id, turn, role, text, *_ in rows:
        groups.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv_id, turns in groups.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv_id] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                        hashlib.sha256(loss.encode()).hexdigest(), sum(len("".join(TEMPLATE.render(r, t))) for r, t in turns))
    return out


@pytest.mark.parametrize("part", [1 << 20, 50])
def test_chat_digest_against_plain_python(spark, monkeypatch, part):
    """Also with conversations over several blocks and parts, repeated turns, nulls and clashing columns."""
    rows, df = _conversations(spark)
    real = C.format_conversations

    def formatted(*a, **k):
        return real(*a, **k)

    monkeypatch.setattr(C, "_PART", part)
    monkeypatch.setattr(C, "format_conversations", formatted)
    got = {r[0]: tuple(r[1:]) for r in C.digest(df, TOKENIZER).collect()}
    assert got == _expected(rows)


def test_masks_are_the_assistants_tokens(spark):
    rows, df = _conversations(spark)
    tokenizer = C._tokenizer(TOKENIZER, TEMPLATE.controls)
    out = C.format_conversations(df, TOKENIZER).collect()
    assert {(r.conv_id, r.block) for r in out} >= {(5, 0), (5, 1), (5, 2), (2, None), (4, 1)}
    for r in out:
        assert tokenizer.encode(r.text, add_special_tokens=False).ids == r.ids and len(r.ids) == len(r.loss)
        assert sum(1 for _ in TEMPLATE.turns(r.text)) == r.n_turns
        said = "".join(TEMPLATE.escape(t) for role, t in TEMPLATE.turns(r.text) if role == "assistant")
        assert tokenizer.decode([i for i, m in zip(r.ids, r.loss) if m], skip_special_tokens=False) == said


def test_chat_empty_table(spark):
    df = spark.createDataFrame([], RAW)
    assert C.digest(df, TOKENIZER).collect() == [] and C.format_conversations(df, TOKENIZER).collect() == []


# ---------------------------------------------------------------- vectors

VEC = "vec_id long, embedding array<float>, label int, `Code.x` int, id string"
BAD = [(9000, None, 1, 0, "x"), (9001, [1.0, None], 1, 0, "x"), (9002, [float("nan")], 1, 0, "x"), (9003, [float("inf")], 1, 0, "x")]


def _vectors(n=150, dim=20, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, dim)], None if i % 11 == 0 else i % 4, 0, "x") for i in range(n)]


def _scaled(v):
    return [max(-LIMIT, min(LIMIT, math.floor(x * 256))) for x in v]


def _plain_codes(rows, settings):
    kept = [(i, _scaled(v), lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // settings.parts)) * settings.parts
    step = width // settings.parts
    cut = lambda v: [tuple((v + [0] * width)[p * step:(p + 1) * step]) for p in range(settings.parts)]
    kept = [(i, cut(v), lab) for i, v, lab in kept]
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    books = [[v[p] for v in list(first.values())[:settings.entries]] for p in range(settings.parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(settings.rounds):
        for p in range(settings.parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(v[p], books[p]), []).append(v[p])
            books[p] = [tuple(sum(c) // len(members[e]) for c in zip(*members[e])) if e in members else x for e, x in enumerate(books[p])]
    out, total = [], {}
    for i, v, lab in kept:
        own = [near(v[p], books[p]) for p in range(settings.parts)]
        error = sum(far(v[p], books[p][e]) for p, e in enumerate(own))
        out.append((i, "".join(f"{e:02x}" for e in own), error, lab))
        total[lab] = total.get(lab, 0) + error
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return sorted(((i, c, e, total[lab], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, lab in out), key=str)


@pytest.mark.parametrize("settings", [V.Settings(), V.Settings(parts=3, entries=7, rounds=4), V.Settings(parts=16, entries=5, rounds=0)])
def test_codes_against_plain_lloyd(spark, settings):
    rows = _vectors() + BAD + [(None, [0.5] * 20, 2, 0, "x"), (3, [0.1] * 20, 2, 0, "x"), (3, [0.1] * 20, 2, 0, "x"),
                               (500, [0.3] * 7, None, 0, "x"), (501, [], 1, 0, "x"), (502, [1e30, -1e30], 1, 0, "x")]
    rows += [(1000 + k, [0.25] * 20, 3, 0, "x") for k in range(80)]  # a hot entry
    codes, book = V.fit(spark.createDataFrame(rows, VEC).repartition(5), settings)
    got = V.digest(codes, book)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _plain_codes(rows, settings)


def test_only_movers_are_stored_again(spark):
    """Members that keep their entry stay in the first table; later tables hold changed ones only."""
    rows = _vectors(300)
    vectors = spark.createDataFrame([(i, _scaled(v)) for i, v, *_ in rows], "id long, v array<int>").withColumns(
        {"vec_id": F.col("id"), "label": F.lit(0)})
    book = np.array([_scaled(v) for _, v, *_ in rows[:8]]).reshape(8, 4, 5).transpose(1, 0, 2)
    r = V._Rounds(spark, vectors, book)
    r.first()
    r.update()
    r.move()
    size = lambda t: sum(len(x.ids) // 8 for x in t.collect())
    moved = r.tables[1].collect()
    assert size(r.tables[0]) == 300 * 4 and 0 < size(r.tables[1]) < 600
    assert all(x.entry != x.old for x in moved)
    assert r.counts.sum(axis=1).tolist() == [300] * 4


def test_codes_of_nothing(spark):
    for rows in ([], BAD):
        codes, book = V.fit(spark.createDataFrame(rows, VEC))
        assert book is None and V.digest(codes, book).collect() == []


def _plain_negatives(rows, s=H.Settings()):
    kept = [(i, lab, _scaled(v)) for i, v, lab, *_ in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, asked = [], []
    for anchor in kept:
        if anchor[0] % 100 or anchor in asked:
            continue
        asked.append(anchor)
        i, lab, v = anchor
        scored = sorted((-dot(v, w), j, other) for j, other, w in kept)
        positives = [(j, -x) for x, j, other in scored if other == lab and j != i][:s.positives]
        for n, (p, score) in enumerate(positives, 1):
            near = [(j, -x) for x, j, other in scored if other != lab and s.low * score <= -100 * x <= s.high * score][:s.negatives]
            out += [(i, p, k, j, score, x, n) for k, (j, x) in enumerate(near, 1)]
    return sorted(out)


def _mined(df, settings=H.Settings()):
    out = H.mine(df, F.col("vec_id") % 100 == 0, settings)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score, r.positive_rank) for r in out.collect())


@pytest.mark.parametrize("settings", [H.Settings(), H.Settings(positives=2, negatives=9, low=10, block=2)])
def test_negatives_against_all_pairs(spark, settings):
    rows = _vectors(500, seed=5) + BAD + [(None, [1.0], 1, 0, "x"), (100, [0.2] * 20, 1, 0, "x"), (100, [0.2] * 20, 1, 0, "x"),
                                          (7, [0.4] * 25, 2, 0, "x"), (8, [], 2, 0, "x")]
    rows += [(k, [0.2] * 20, k % 2, 0, "x") for k in range(2000, 2040)]  # copies: ties
    df = spark.createDataFrame(rows, VEC).repartition(6)
    got = _mined(df, settings)
    assert got == _plain_negatives(rows, settings) and len(got) > 20


def test_negatives_of_nothing(spark):
    for rows in ([], BAD, [(100, [1.0], 1, 0, "x")], [(100, [1.0], 1, 0, "x"), (101, [1.0], 2, 0, "x")]):
        assert _mined(spark.createDataFrame(rows, VEC)) == []


@pytest.mark.parametrize("size", [3, 200, 1 << 21])
def test_packed_products_are_exact(size):
    rng = np.random.default_rng(0)
    rows, anchors = rng.integers(-size, size, (70, 33)), rng.integers(-size, size, (9, 33))
    packed = H.Packed(rows, int(np.abs(anchors).sum(axis=1).max()))
    for a in anchors:
        assert packed.products(a.tolist()).tolist() == (rows @ a).tolist()
    assert packed.products([0] * 33).tolist() == [0] * 70
