"""Names in texts by automaton and by index, many searches, and the first independent set, against plain loops."""

import random

import pytest

from candlewick.operators import names, text

R = random.Random(9)


def _strings(n, low, high):
    return ["".join(R.choice("abé\U0001f600 ") for _ in range(R.randint(low, high))) for _ in range(n)]


@pytest.mark.parametrize("most", [names.MOST_CHARS, 0])
def test_names_in_texts(spark, most):
    texts = [(k, t) for k, t in enumerate([None, "", "a", "ab", "aa" * 2000, *_strings(60, 0, 30)])]
    wanted = sorted({"a", "b ", "é", "aaa", "not there", *_strings(200, 1, 6)} - {""})
    df, asked = spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame([(w,) for w in [*wanted, wanted[0], "", None]], "name string")
    got = names.contained(df, "id", "text", asked, most).collect()
    want = {(k, w) for k, t in texts for w in wanted if t and w in t}
    assert {(r.id, r.name) for r in got} == want and len(got) == len(want)
    assert names.contained(df, "id", "text", asked.filter("name = ''"), most).count() == 0
    assert names.contained(df.filter("false"), "id", "text", asked, most).count() == 0


def test_searches(spark):
    rows = [(f"S{k}", f"Company {k % 7}", float(k * 37 % 11)) for k in range(120)] + [("AB", None, None), ("AB CO", "x", 5.0)]
    asked = ["s1", " S11 ", "company 3", "ab", "", None, "zz", "1"]
    got = names.search_many(spark.createDataFrame(rows, "symbol string, name string, market_cap double"), spark.createDataFrame([(q,) for q in asked], "query string"), 15).collect()
    for q in asked:
        u = (q or "").strip().upper()
        tier = lambda s, n: 1 if s.upper() == u else 2 if s.upper().startswith(u) else 3 if u in s.upper() or u in (n or "").upper() else None  # noqa: B023, E731
        want = sorted(((tier(s, n), -(c if c is not None else -1), s) for s, n, c in rows if u and tier(s, n)))[:15]
        assert [(r.tier, r.symbol) for r in sorted(got, key=lambda r: r["rank"]) if r.query == q] == [(t, s) for t, _, s in want]


def test_listings_that_share_a_company_share_its_articles(spark):
    articles = spark.createDataFrame([(k, f"Reliance news {k}", None, f"2024-01-{k:02d}") for k in range(1, 15)] + [(20, "tcs rises", "x", "2024-02-01")], "article_id long, title string, description string, published string")
    asked = spark.createDataFrame([("RELIANCE.NS", "Reliance"), ("RELIANCE.BO", "Reliance"), ("TCS.NS", "Tata Consultancy"), ("", None), (".NS", "")], "symbol string, alias string")
    got = text.stock_news(articles, asked).collect()
    for s in ("RELIANCE.NS", "RELIANCE.BO"):
        assert [(r["rank"], r.article_id) for r in sorted(got, key=lambda r: r["rank"]) if r.symbol == s] == [(n, 15 - n) for n in range(1, 11)]
    assert [r.article_id for r in got if r.symbol == "TCS.NS"] == [20] and not [r for r in got if r.symbol in ("", ".NS")]


def _first(rows, threshold=0.8):
    out = set()
    for g in {r[1] for r in rows}:
        kept = []
        for k, _, title, url in sorted((r for r in rows if r[1] == g), key=lambda r: r[0]):
            words = set((title or "").lower().split())
            if not any((url is not None and u == url) or (words | w and len(words & w) / len(words | w) >= threshold) for u, w in kept):
                kept.append((url, words))
                out.add((g, k))
    return out


def test_first_in_rounds_equals_a_loop(spark):
    vocabulary = [f"w{k}" for k in range(12)]
    rows = [(k, R.choice("xy"), " ".join(R.sample(vocabulary, R.randint(0, 9))) if R.random() < 0.95 else None, R.choice([None, *[f"u{n}" for n in range(60)]])) for k in range(300)]
    chain = [f"c{k}" for k in range(40)]  # each is like the one before and after it
    rows += [(1000 + k, "z", " ".join(chain[k : k + 10]), None) for k in range(30)] + [(2000 + k, "z", "same title here", f"v{k}") for k in range(20)]
    df = spark.createDataFrame(rows, "article_id long, grp string, title string, url string").repartition(3)
    got = text.keep_first_in_rounds(df, "grp").collect()
    assert {(r.grp, r.article_id) for r in got} == _first(rows) and len(got) == len(_first(rows))
    assert text.keep_first_in_rounds(df.filter("false"), "grp").count() == 0
