"""Fingerprints against sets of paragraphs in plain Python, on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import pytest

from candlewick.llm import fingerprints

R = random.Random(13)


def _paragraphs(text):
    return {p.strip(" ") for p in re.split(r"\n|(?<=[.!?]) ", text)} - {""}


def _like(a, b):
    a, b = _paragraphs(a), _paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def _expected(rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = sorted({(d is None, d or 0, sha(t or ""), t or "") for d, t in rows})
    copies = Counter((d is None, d or 0, sha(t or "")) for d, t in rows)
    out = Counter()
    for k, (none, d, h, text) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][3]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out[None if none else d, len(text), sha(edited), round(_like(text, edited), 9), round(_like(text, following), 9)] += copies[none, d, h]
    return out


def _rows():
    word = lambda: "".join(R.choice("abcdé\U0001f600") for _ in range(R.randint(1, 5)))
    sentence = lambda: " ".join(word() for _ in range(R.randint(1, 8))) + R.choice([".", "!", "?", ""])
    text = lambda n: "".join(sentence() + R.choice([" ", "\n", "\n\n", "  "]) for _ in range(n))
    base = text(30)
    texts = [None, "", " ", "\n\n", "a", "ab", "One. Two. One. Two.", "no end", base, base, base + text(3), text(3) + base, "éé\U0001f600é. x"]
    texts += [text(R.choice([1, 2, 5, 20, 80])) for _ in range(60)] + [text(3000), "x" * 100_000, text(2500)]
    rows = [(k * 2, t) for k, t in enumerate(texts)]
    rows += [(4, "other text of one doc_id."), (4, "other text of one doc_id."), (None, base), (None, base), (None, "last"), (None, None), (None, "")]
    rows += [(1001, "hot row. twice.")] * 50
    R.shuffle(rows)
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as k", "1 as n", "2 as id", "'y' as h", "3 as part", "4 as copies", "5 as pair").repartition(3)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.fixture(scope="module")
def found(spark):
    rows = _rows()
    out = fingerprints.fingerprinted(_frame(spark, rows))
    assert out.columns == COLUMNS
    return rows, out.collect()


def test_likeness_equals_sets(found):
    rows, got = found
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == _expected(rows)


def test_equal_texts_have_equal_fingerprints(spark, found):
    rows, got = found
    by_id = {}
    for d, t in rows:
        by_id.setdefault(d, set()).add(t or "")
    prints = {}
    for r in got:
        if r.doc_id is not None and len(by_id[r.doc_id]) == 1:
            prints.setdefault(next(iter(by_id[r.doc_id])), set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    same = {}
    for text, (p,) in prints.items():
        same.setdefault(p, set()).add(frozenset(_paragraphs(text)))
    assert all(len(s) == 1 for s in same.values())  # of these texts, other paragraphs give another fingerprint
    assert prints[""] == {""}


def test_edited_fingerprint_is_that_of_the_edited_text(spark):
    rows = [(1, "One. Two. Three. Four."), (2, "Five. Six. Seven. Eight."), (3, "Nine.")]
    edited = {d: t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1])}
    got = {r.doc_id: r for r in fingerprints.fingerprinted(_frame(spark, rows)).collect()}
    again = {r.doc_id: r for r in fingerprints.fingerprinted(_frame(spark, list(edited.items()))).collect()}
    assert {d: r.edited_fingerprint for d, r in got.items()} == {d: r.fingerprint for d, r in again.items()}


def test_nothing_and_one(spark):
    assert fingerprints.fingerprinted(_frame(spark, [])).count() == 0
    (r,) = fingerprints.fingerprinted(_frame(spark, [(1, "One. Two.")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"One. One.").hexdigest() and r.near_next == 1.0 and r.near_edited == 0.5


@pytest.mark.parametrize("spare", [fingerprints.SPARE, 0.2])
def test_sketches_find_what_differs(spark, spare, monkeypatch):
    """Pairs of sets of many sizes; narrow sketches fail at first and are tried again with wider ones."""
    monkeypatch.setattr(fingerprints, "LEAST", 4 if spare < 1 else fingerprints.LEAST)

    def some(n):
        return [R.getrandbits(63) - 2**62 for _ in range(n)]

    pairs = []
    for k, (common, left, right) in enumerate([(0, 0, 0), (50, 0, 0), (50, 1, 0), (50, 3, 2), (5, 12, 11), (0, 40, 40), (1000, 200, 300), (0, 5000, 0), (3, 0, 700)] * 4):
        both = some(common)
        pairs.append((k, both + some(left), both + some(right), left + right))
    texts = [(k, first, [second, first, []]) for k, first, second, _ in pairs]
    got = {(k, side): n for k, side, n in fingerprints.compared(spark.createDataFrame(texts, "k long, first array<long>, others array<array<long>>"), spare).collect()}
    for k, first, _, differ in pairs:
        assert [got.get((k, side), 0) for side in range(3)] == [differ, 0, len(first)]
