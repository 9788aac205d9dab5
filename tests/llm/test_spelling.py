"""Spelling variants against brute force over all pairs, on nulls, empty and long texts, ties, repeats, crowded subtries and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from candlewick.llm import spelling

R = random.Random(11)
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def _expected(rows, least=6, often=5, ratio=5):
    n = Counter()
    for d, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= often}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and _near(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def _rows():
    base = ["".join(R.choice("abcdé") for _ in range(R.randint(6, 12))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "×÷ÿÀàè", "straße", "strasse", "maçonnerie", "maconnerie"]

    def wrong(w):
        k = R.randrange(len(w))
        return R.choice([w[:k] + w[k + 1 :], w[:k] + R.choice("abcdéx") + w[k:], w[:k] + R.choice("abcdéx") + w[k + 1 :], w.title(), w.upper(), w.lower()])

    words = [w for w in base for _ in range(R.choice([5, 30, 200]))]
    words += [v for w in base for _ in range(6) for v in [wrong(w)] * R.choice([1, 5, 8])] + [v for w in base[:20] for v in [wrong(wrong(w))] * 5]
    words += ["chainab"] * 6 + ["chainac"] * 35 + ["chaindc"] * 200  # a form of a form
    R.shuffle(words)
    texts = [None, "", " 12 αβ Ābcdefg ", "short of it"] * 2
    sep = [" ", ", ", "-", "\n", "α", "7", "œ", "\U0001f600"]
    while words:
        k = R.choice([1, 5, 50, 400])
        texts.append("".join(w + R.choice(sep) for w in words[:k]))
        words = words[k:]
    long_ = "ab" * 500
    texts += [f"{long_} {long_[:300]}x{long_[301:]} {long_}c"] * 6  # runs beyond those whose checksums are computed together
    rows = [(k * 7, t) for k, t in enumerate(texts)]
    rows += [(None, "repeated words repeated words"), (None, "repeated words repeated words"), (3, "repeatet"), (3, "repeatet")] + [(3, "repeatet")] * 4
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "2 as key", "'y' as a", "3 as m").repartition(3)


@pytest.mark.parametrize("subtrie", [spelling.SUBTRIE, 200, 8])
def test_groups_equal_brute_force(spark, subtrie):
    rows = _rows()
    out = spelling.variant_groups(_frame(spark, rows), subtrie=subtrie)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got, expected = [tuple(r) for r in out.collect()], _expected(rows)
    assert len(got) == len(set(got)) and set(got) == expected
    assert sum(r[1] is not None for r in expected) > 20 and any(r[1] not in (None, r[2]) for r in expected)


def test_long_text_and_nothing(spark):
    words = ["".join(R.choice("abc") for _ in range(7)) for _ in range(300)]
    rows = [(1, " ".join(R.choice(words) for _ in range(700_000)))]  # longer than a piece
    assert {tuple(r) for r in spelling.variant_groups(_frame(spark, rows)).collect()} == _expected(rows)
    assert spelling.variant_groups(_frame(spark, [])).count() == 0
    assert spelling.variant_groups(_frame(spark, [(1, None), (None, "")])).count() == 0


def test_pairs_of_every_position():
    words = sorted({"abcdef", *("abcdef"[:k] + x + "abcdef"[k:] for k in range(7) for x in "abz"), *("abcdef"[:k] + x + "abcdef"[k + 1 :] for k in range(6) for x in ("", "a", "z"))} | {"aa", "aaa", "aaaa", ""})
    found = {tuple(sorted((words[i], words[j]))) for i, j in spelling.near_pairs(words)}
    assert found == {(u, v) for u in words for v in words if u < v and _near(u, v)}


def test_checksums_equal_zlib():
    texts = [bytes(R.randrange(256) for _ in range(R.choice([0, 1, 7, 63, 64, 65, 200]))) for _ in range(50)]
    heads = [zlib.crc32(str(k).encode()) for k in range(50)]
    end = np.cumsum([len(t) for t in texts])
    got = spelling.checksums(np.frombuffer(b"".join(texts), np.uint8), end - [len(t) for t in texts], end, np.array(heads, np.uint32))
    assert got.tolist() == [zlib.crc32(t, h) for t, h in zip(texts, heads)]
