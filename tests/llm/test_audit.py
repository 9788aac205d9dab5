"""The filter audit against a plain count of every order, on nulls, ties, repeats, long texts and clashing columns."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from candlewick.llm import audit
from candlewick.llm.common import text_buffer, word_bounds

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = random.Random(12)


def _rows():
    word = lambda: "".join(R.choice("abcdeéX") for _ in range(R.randint(1, 5)))
    texts = [None, "", " \n ", "# a", "A B C", "w " * 99 + "w", "é " * 200, "AB" * 300, "a\x0bb\x0cc|"]
    texts += [" ".join(word() for _ in range(R.choice([20, 99, 100, 150, 300]))) for _ in range(40)]
    texts += [" ".join(f"w{k}" for k in range(120)), " ".join(f"W{k}$" for k in range(120)), "x" * 70 + " " + "x" * 69 + "y " + "x" * 70]
    texts += [" ".join(f"long{k}" for k in range(300_000))]  # over two pieces
    rows = [(k, t, R.choice(["en", "de", "", None])) for k, t in enumerate(texts)]
    rows += [(None, texts[20], "en"), (None, texts[20], "en"), (None, "alone", None), (7, texts[21], "de"), (7, texts[21], "de"), (500, texts[21], "en"), (501, texts[21], None), (502, None, "en")]
    rows += [(600 + k, texts[22], "hot") for k in range(60)]
    R.shuffle(rows)
    return rows


LABELS = [(k, R.choice([0, 1, None]), R.choice([0, 1, None])) for k in range(0, 40)] + [(605, 1, 1), (606, 1, 0), (606, 0, 1), (None, 1, 1), (9999, 1, 1)]


def _expected(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    at = lambda d: (d is None, d or 0)
    first = {}
    for d, t, _ in rows:
        first[t or ""] = min(first.get(t or "", at(d)), at(d))
    parts = {}
    for d, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = "".join(f for f, failed in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), at(d) > first[t])) if failed)
        parts.setdefault(lang or "", Counter())[(fails, d in good, d in toxic)] += 1
    out = set()
    for part, masks in parts.items():
        found, shapley = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                n = lambda keep, what=None: sum(c for (m, g, t), c in masks.items() if keep(set(m)) and (what is None or (g, t)[what]))  # noqa: B023, E731
                here = lambda m: f in m and not m & before  # noqa: B023, E731
                removed = n(here)
                shapley[f] += removed
                found.append((part, order, k + 1, n(lambda m: not m & (before | {f})), removed, n(lambda m: f in m and m & before), n(lambda m: m == {f}), n(here, 0), n(here, 1)))  # noqa: B023
        out |= {(*row, shapley[row[1][row[2] - 1]]) for row in found}
    return out


def _frames(spark, rows, labels):
    extra = ["cast(null as int) part", "1 as mask", "'x' as digest", "2 as n", "true as good", "3 as spread"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", *extra).repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' as part", "1 as spread")


def test_audit_equals_plain_counts(spark):
    rows = _rows()
    out = audit.audited(*_frames(spark, rows, LABELS))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == 600 * len({r[2] or "" for r in rows}) and set(got) == _expected(rows, LABELS)


def test_audit_of_nothing(spark):
    assert audit.audited(*_frames(spark, [], [])).count() == 0
    assert {tuple(r) for r in audit.audited(*_frames(spark, [(1, "a", "en")], [])).collect()} == _expected([(1, "a", "en")], [])


def test_equal_hashes_are_no_equal_words():
    texts = ["a b a c", "", "x" * 70 + " " + "y" * 70 + " " + "x" * 70, "ab cd ab" * 5, "abcdefghij abcdefghik abcdefghij"]
    buf, off = text_buffer(pa.array(texts))
    start, end, counts = word_bounds(buf, off)
    expected = [len(set(WORD.findall(t))) for t in texts]
    assert audit.distinct_words(buf, start, end, counts).tolist() == expected
    for hashes in (lambda b, s, e: np.zeros(len(s), np.uint64), lambda b, s, e: (e - s).astype(np.uint64)):  # all words, or all of one length, share a hash
        assert audit.distinct_words(buf, start, end, counts, hashes).tolist() == expected
