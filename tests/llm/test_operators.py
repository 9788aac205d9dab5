"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candlewick.llm import blocks, bpe, html, licenses, minhash, mixing, quality, recompression, suffixes, urls, vectors
from candlewick.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names operators use inside.
EXTRA = "part int, key int, size string, block string, kept string, copies string, rules string, __text string"
R = random.Random(5)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randint(1, 7))) for _ in range(60)]


def _texts():
    sentence = lambda n: " ".join(R.choice(VOCAB) for _ in range(n))
    shared, line = sentence(40), sentence(12)
    base = sentence(120)
    out = [None, "", " \n\t ", "x", "a b", "a b c d", "a b c d e", "ab" * 100, "x " * 45, "x" * 49, "x" * 50, "x" * 51, "é" * 60, "a b " * 60 + "z", "b a " * 60 + "z", "<|endoftext|>", "Hi<|endoftext|> there's   '\n\n x"]
    out += [base, base, base + " end", base.replace(VOCAB[0], VOCAB[1]), base.upper()]
    out += [f"{sentence(R.randint(0, 60))} {shared} {sentence(R.randint(0, 60))}\n{line}\n{line}" for _ in range(15)]
    out += [sentence(3000), sentence(500) + " " + shared]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3, t, R.choice(["en", "de", None]), R.choice(["s1", "s2", None])) for k, t in enumerate(_texts())]
    R.shuffle(rows)
    rows.append(rows[0])  # a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", *[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in EXTRA.split(", ")]).repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture()
def nothing(docs):
    return docs.filter("false")


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (30, 30)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 230)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[k] for k in (1, 2, 3, 7, 8, 9)} == {1} and got[21] == 20 and got[159] == 100 and got[230] == 200 and 30 not in got


def _byte_repeats(texts):
    seen, out = {}, {}
    for d in sorted(texts):
        b = texts[d].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], d) < d:
                gone[p : p + 50] = b"\1" * 50
        spans = len(bytes(gone).replace(b"\0", b" ").split())
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [None, 2, "ranges", "blocks"])
def test_suffix_array(docs, plain, nothing, monkeypatch, hot):
    if hot == 2:  # all common grams take the way of hot ones
        monkeypatch.setattr(suffixes, "HOT", 0.0)
        monkeypatch.setattr(suffixes, "HOT_LEAST", hot)
    if hot == "ranges":  # fewer ranges than buckets, and fewer tasks than parts
        monkeypatch.setattr(suffixes, "MOST_SAMPLE", 3 * suffixes.EACH)
        monkeypatch.setattr(blocks, "MOST_TASKS", 3)
    if hot == "blocks":  # what two blocks hold is hot, though no sample tells it
        monkeypatch.setattr(suffixes, "HOT_BLOCKS", 2)
        monkeypatch.setattr(suffixes, "MOST_SAMPLE", 3 * suffixes.EACH)
    want = _byte_repeats(plain)
    got = suffixes.repeat_digests(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    if not hot:
        assert suffixes.repeat_digests(nothing).count() == 0
        kept = suffixes.without_repeats(docs)
        assert kept.columns == [*docs.columns, "n_removed"]
        assert {r.doc_id: r.n_removed for r in kept.collect()} == {d: w[1] for d, w in want.items()}


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (5000, 21), dtype=np.uint8)
    order = suffixes.multikey_quicksort(suffixes.words_of(rows), small=16)
    ordered = [rows[k].tobytes() for k in order]
    assert ordered == sorted(ordered) and sorted(order.tolist()) == list(range(5000))


def test_licenses(spark, nothing):
    mit, isc = licenses.TEMPLATES["mit"], licenses.TEMPLATES["isc"]
    rows = [(1, "é " + mit.replace("free of charge", "FREE  of any charge") + " é"), (2, None), (3, ""), (4, isc * 2), (5, "Released under the MIT License."), (6, "released the license")]
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.template) for r in got) == [(1, "mit"), (4, "isc"), (4, "isc"), (5, "mit-notice")]
    for r in got:
        assert r.coverage == 1.0 and rows[r.doc_id - 1][1][r.start_char : r.end_char].lower().startswith(("permission", "released"))
    assert licenses.scanned(nothing).count() == 0


def _aligned_fully(t, w):
    best = 0
    score = [[0] * (len(w) + 1) for _ in range(len(t) + 1)]
    for i in range(1, len(t) + 1):
        for j in range(1, len(w) + 1):
            score[i][j] = max(0, score[i - 1][j - 1] + (2 if t[i - 1] == w[j - 1] else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
            best = max(best, score[i][j])
    return best


def test_banded_alignment():
    rng = np.random.default_rng(1)
    for _ in range(30):
        t = rng.integers(0, 9, 30)
        w = np.concatenate([rng.integers(10, 20, 4), np.delete(t, rng.integers(0, 30, 3)), rng.integers(10, 20, 5)])
        matched, first, end = licenses.aligned(t, w, 4)
        assert matched <= 30 and 2 * matched >= _aligned_fully(t.tolist(), w.tolist()) and 0 <= first < end <= len(w)


def test_mixing(docs, nothing):
    got = mixing.mixed(docs).collect()
    again = mixing.mixed(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert len(got) == docs.count() and sorted(map(key, got)) == sorted(map(key, again))
    sources = sorted({r.source for r in got}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in got if r.source == s) for s in sources]
    want = mixing.targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(sources))])
    for s, size, target in zip(sources, sizes, want):
        own = [r for r in got if r.source == s]
        assert all(r.source_size == size and abs(r.target - target) < 1e-6 and r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
    assert mixing.mixed(nothing).count() == 0


def test_targets_share_out_the_excess():
    assert mixing.targets([10, 1000, 1000], [3, 1, 2]) == pytest.approx([20, 998.3333333, 1996.6666667])


def test_pivotal_keeps_expectations():
    rng = np.random.default_rng(2)
    sizes, share = rng.integers(1, 50, 40).astype(float), rng.random(40)
    total = np.zeros(40)
    for _ in range(3000):
        s, taken = share.copy(), np.zeros(40, np.int64)
        held = mixing._transfer(sizes, s, rng.random(40), taken)
        left = 0.0
        if held >= 0:
            left, taken[held] = s[held], rng.random() < s[held]
        assert abs((taken * sizes).sum() - (share * sizes).sum()) <= sizes.max() and left <= 1
        total += taken
    assert np.abs(total / 3000 - share).max() < 0.05


def _pages(spark):
    link = lambda *u: "".join(f"<a class=x href='{x}'>y</a>" for x in u)
    rows = [(1, None, None), (2, "no scheme/de/x", ""), (3, "HTTP://X.EXAMPLE.COM/de/1?x#y", link("https://bad.net/")), (4, "http://net", None), (5, "http://bad.net/a", ""), (6, "http://shady.io/a", link("http://bad.net/z", "/x") * 3), (7, "http://fine.io/a", link("http://other.io/z")),
            (8, "http://a.b.example.net/en/x", ""), (9, "x://y.org/fr/?a://b", ""), (10, "http://www.net?x", ""), (11, "http://É.NET/ü/#", ""), (12, "http://notexample.com/de/", ""), (12, "http://notexample.com/de/", "")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")


def test_urls(spark):
    pages = _pages(spark)
    got = {r.page_id: r for r in urls.judged(pages).collect()}
    for r in pages.collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url) if r.url else None
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, a) for a, h, p in urls.RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, max(fit)[1] if fit else None)
        if fit:
            assert g.verdict == max(fit)[2]
    assert got[6].distrust > 0 and got[7].distrust == 0 and got[7].verdict == "allow"
    assert urls.judged(pages.filter("false")).count() == 0


def _propagated(seeds, edges, rounds, restart):
    """Plain personalised PageRank, both kinds."""
    out = {}
    for kind, links in (("trust", edges), ("distrust", [(b, a, w) for a, b, w in edges])):
        k = 0 if kind == "trust" else 1
        score = {h: s[k] * restart for h, s in seeds.items() if s[k] > 0}
        total = {}
        for a, _, w in links:
            total[a] = total.get(a, 0) + w
        for _ in range(rounds):
            new = {h: s[k] * restart for h, s in seeds.items() if s[k] > 0}
            for a, b, w in links:
                if a in score:
                    new[b] = new.get(b, 0) + (1 - restart) * score[a] * w / total[a]
            score = new
        for h, v in score.items():
            out.setdefault(h, [0, 0])[k] = v
    return out


def test_propagation_matches_a_plain_loop(spark):
    rng = random.Random(4)
    hosts = [f"h{k}" for k in range(12)]
    edges = [(a, b, rng.randint(1, 3)) for a in hosts for b in hosts if a != b and rng.random() < 0.25]
    seeds = {h: (rng.choice([0, 0, 1.0]), rng.choice([0, 0, 0.5])) for h in hosts}
    got = urls.propagated(spark.createDataFrame([(h, float(a), float(b)) for h, (a, b) in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame(edges, "src string, dst string, links long"), rounds=6)
    want = _propagated(seeds, edges, 6, urls.RESTART)
    for r in got.collect():
        assert (r.trust, r.distrust) == pytest.approx(want[r.host], abs=1e-9)


def _vector_links(rows, least=0.9):
    groups = {}
    for k, e in rows:
        if e and all(z is not None and np.isfinite(z) for z in e) and any(e):
            groups.setdefault(len(e), []).append((k, np.array(e, np.float64)))
    n, up = {k: 0 for k, _ in rows}, {k: k for k, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for own in groups.values():
        m = np.array([v for _, v in own])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= least, 1))):
            a, b = own[a][0], own[b][0]
            n[a] += 1
            n[b] += 1
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {k: (n[k], find(k), find(k) == k) for k in n}


@pytest.mark.parametrize("interval", [40, 8192])
def test_vectors(spark, interval):
    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    rows = [(k, rng.normal(size=16).astype(np.float32).tolist()) for k in range(120)]
    rows += [(1000 + k, (base + 0.25 * rng.normal(size=16)).astype(np.float32).tolist()) for k in range(90)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [float("inf")] * 16), (2005, [None] + base[1:].tolist()), (2006, (base * 1e30).astype(np.float32).tolist()), (2007, (base * 1e-30).astype(np.float32).tolist()), (2008, [1.0, 2.0]), (2009, [2.0, 4.1]), (2010, (-base).tolist())]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, part string")
    want = _vector_links([(r.vec_id, r.embedding) for r in df.collect()])
    got = vectors.near_duplicates(df, interval=interval).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want
    if interval == 40:
        assert vectors.near_duplicates(df.filter("false")).count() == 0


def test_bpe(docs, plain, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    got = bpe.encode_digests(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = t.encode(plain[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in bpe.encode_decode(docs).collect():
        assert r.decoded == plain[r.doc_id]
    assert bpe.encode_digests(nothing).count() == 0


def test_bpe_splits_odd_text(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    rng = random.Random(2)
    bits = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "a", "B", "9", "½", "é", "!", "...", "<|endoftext|>", "<|endof", "\u00a0", "\u3000", "日本", "𝒳", "'ve", "\x1c", "\x85", "'S", "\x00"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for k in range(800)]
    for r in bpe.encode_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert list(r.ids) == t.encode(rows[r.doc_id][1], add_special_tokens=False).ids


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies, yes, no.</div><nav><a href=/>Home</a></nav>
<div id=wrap><div class="content"><h1>A &amp; B</h1><p>Some text, long,   here with\n spaces and more words.<p>Second &#8212; <a href=x>link</a> more.<ul><li>one<li>two</ul><script>if (a<b) "</p>"</script><div class="ad-slot">buy, now</div></div><aside>side</aside></div>
<section id="comments"><p>I, too, think, that, this is a long comment, with, many, commas.</p></section><form>x</form><footer>f</footer></body></html>"""


def test_html(spark, data):
    assert html.main_text(PAGE) == "A & B\nSome text, long, here with spaces and more words.\nSecond — link more.\none\ntwo"
    for odd in (None, "", "<", "<p", "<p>", "plain text only, no tags", "<!-- x", "<script>", "<div><div><div>", "&amp;&bogus;&#0;&#x110000;", "</p></div>", "<a " + "'" * 50):
        assert isinstance(html.main_text(odd), str)
    assert html.main_text("plain text only, no tags") == "plain text only, no tags" and html.main_text(None) == ""
    rows = html.extracted(spark.read.parquet(f"{data}/pages.parquet").selectExpr("*", "'x' as text")).collect()
    assert all(r.n_chars == len(r.text) and "track(" not in r.text and "&copy;" not in r.text for r in rows) and any(r.text for r in rows)
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _shingles(text):
    w = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("block", [3, 2048])
def test_minhash(docs, plain, nothing, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash.in_blocks, "__defaults__", (block,))
    sets = {d: _shingles(t) for d, t in plain.items()}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {d: (len(sets[d]), find(d), find(d) == d) for d in sets}
    if block == 3:
        assert minhash.near_duplicates(nothing).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.sort(pool[:300]), np.sort(pool[100:])
    s = minhash.sketches(np.concatenate([a, b, a[:1]]), np.array([300, 300, 1]))
    assert (s != minhash._EMPTY).all() and abs((s[0] == s[1]).mean() - 0.5) < 0.2


def test_quality(docs, plain, nothing):
    got = quality.robust_outliers(quality.text_statistics(docs, ["doc_id", "lang", "source"])).collect()
    assert len(got) == docs.count()
    for r in got:
        t = plain[r.doc_id]
        w = WORD.findall(t)
        windows = {}
        for k in range(len(w) - 2):
            windows.setdefault(tuple(w[k : k + 3]), []).append(k)
        repeat = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.robust_outliers(quality.text_statistics(nothing, ["doc_id", "lang", "source"])).count() == 0


def test_quality_rejects_junk_and_keeps_clean(spark):
    rng = random.Random(1)
    clean = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(200)), "en", "a") for k in range(300)]
    junk = [(1000 + k, " ".join(w + rng.choice(["###", "***", "%%%"]) for w in t.split()), "en", "a") for k, t, *_ in clean[:20]]
    got = quality.robust_outliers(quality.text_statistics(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string"), ["doc_id", "lang", "source"])).collect()
    assert {r.doc_id for r in got if not r.kept} == {j[0] for j in junk}


def test_quality_rejects_graded_junk(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    lines = lambda n: [" ".join(word() for _ in range(rng.randint(6, 14))) for _ in range(n)]
    rows = [(k, "\n".join(lines(20)), "en", "a") for k in range(400)]
    symbols = lambda share: "\n".join(" ".join(w + "#" * (rng.random() < share) for w in x.split()) for x in lines(40))
    repeated = lambda share, text: "\n".join(lines(round(20 * (1 - share))) + [text] * round(20 * share))
    junk = [symbols(share) for share in (0.15, 0.2, 0.3, 0.4) for _ in range(5)] + [repeated(share, text) for share in (0.35, 0.45, 0.6, 0.9) for text in ("read more", " ".join(lines(1))) for _ in range(2)]
    rows += [(1000 + k, t, "en", "a") for k, t in enumerate(junk)]
    got = quality.robust_outliers(quality.text_statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id", "lang", "source"])).collect()
    assert {r.doc_id for r in got if not r.kept and r.doc_id >= 1000} == set(range(1000, 1000 + len(junk)))
    assert sum(not r.kept for r in got if r.doc_id < 1000) <= 2


def test_recompression(docs, plain, nothing):
    seen, want = set(), {}
    for d in sorted(plain):
        w = WORD.findall(plain[d])
        gone = [0] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = [1] * 20
            seen.add(k)
        want[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    got = [r for r in recompression.repeat_digests(docs).collect()]
    assert len(got) == docs.count() and {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert recompression.repeat_digests(nothing).count() == 0


def test_equal_windows_have_equal_marks():
    rng = np.random.default_rng(4)
    for span in (2, 5, 1000):
        words = rng.integers(0, span, 3000).astype(np.uint64) + np.uint64(1)
        words[2000:2100] = words[100:200]
        begin, number, marks = recompression.window_marks(words, np.array([1500, 0, 1500]))
        by = {}
        for b, m in zip(begin, marks[number]):
            by.setdefault(words[b : b + 20].tobytes(), set()).add(int(m))
        assert all(len(m) == 1 for m in by.values())


def test_html_marks_of_layout_and_headers_inside_an_article():
    page = '<body class="page"><div class="layout with-sidebar"><article><header class="entry-header"><h1>Title</h1></header><p>One, two, three and more.</p></article><div class="sidebar">menu, menu</div></div></body>'
    assert html.main_text(page) == "Title\nOne, two, three and more."


def test_deep_and_unclosed_pages():
    assert html.main_text("<div>" * 20_000 + "x") == "x"
    assert html.main_text("<b>y " * 20_000).count("y") == 20_000
    assert html.main_text("<div><section>" * 5_000 + "</article>z" * 20_000) == "z" * 20_000


def test_html_keeps_all_sections_and_slugs():
    text = [f"Part {k}, with some words, and a few more, so that it counts." for k in range(3)]
    sections = "".join(f"<section><div><p>{t}</p></div></section>" for t in text)
    menu = "<nav><a href=/>Home</a></nav>"
    for page in (f"<body>{menu}<article>{sections}</article><footer>f</footer></body>", f"<body>{menu}<div id=root><div>{sections}</div></div></body>"):
        assert html.main_text(page) == "\n".join(text)
    deep = "<article>" + "".join("<div>" * 6 + f"<p>{t}</p>" + "</div>" * 6 for t in text) + "</article>"
    assert html.main_text(f"<body><div>{deep}</div></body>") == "\n".join(text)
    uneven = f"<body><div><section><div><p>{text[0] * 9}</p></div></section><section><div><p>{text[1]}</p></div></section></div></body>"
    assert html.main_text(uneven) == f"{text[0] * 9}\n{text[1]}"
    assert html.main_text(f"<body><div><div><p>{text[0] * 3}</p></div><ul><li>short<li>list</ul><table><tr><td>cell</table></div></body>") == f"{text[0] * 3}\nshort\nlist\ncell"
    slugs = f'<body><article><h2 id="search">Search</h2><section id="how-to-search-logs"><p>{text[0]}</p></section><div class="social-history"><p>{text[1]}</p></div><div class="article-share-tools"><a href=x>Mail</a> <a href=y>Post</a></div><div class="left-sidebar">side</div></article></body>'
    assert html.main_text(slugs) == f"Search\n{text[0]}\n{text[1]}"


def test_unclosed_tags_cost_linear_time():
    began = time.perf_counter()
    for unit in ("<a ", '<a "', "<a x='", "<a x='\"", "<a '\"", "<", "<b x=\"'\" ", "<a b='c' "):
        page = "<article><p>" + "Words, and more words. " * 9 + "</p></article>" + unit * 400_000
        assert html.main_text(page).startswith("Words, and")
    assert time.perf_counter() - began < 60


def test_html_finds_planted_articles():
    """Pages are built from a known article and known chrome around it; what comes out is the article, whole."""
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    sentence = lambda n: ", ".join(words(rng.randint(3, 8)) for _ in range(n)) + "."
    found = planted = both = 0
    for _ in range(150):
        lines = [sentence(rng.randint(3, 9)) for _ in range(rng.randint(3, 12))]
        marked = [f"<p>{t.replace(',', ', <b>x</b>', 1)}</p>" if rng.random() < 0.3 else f"<p>\n {t} <!-- c --></p>" if rng.random() < 0.5 else f"<p>{t}" for t in lines]
        lines = [t.replace(",", ", x", 1) if "<b>" in m else t for t, m in zip(lines, marked)]
        for _ in range(rng.randint(0, 2)):  # sections around parts of the article
            a = rng.randint(0, len(marked) - 2)
            marked[a], marked[-1] = "<section><div>" + marked[a], marked[-1] + "</div></section>"
        tag = rng.choice(["article", "main", "div", 'div class="content"'])
        article = f"<{tag}>{''.join(marked)}</{tag.split()[0]}>"
        links = "".join(f"<li><a href=/{k}>{words(2)}</a>" for k in range(8))
        chrome = [f"<nav><ul>{links}</ul></nav>", f"<header><h1>{words(3)}</h1></header>", f"<aside>{sentence(2)}</aside>", f'<div class="cookie-banner">{sentence(3)}</div>', f'<div id="sidebar"><ul>{links}</ul></div>', f"<script>if (a < b) {{ '{words(3)}' }}</script>"]
        after = [f"<footer>{sentence(2)}</footer>", f'<section class="comments"><p>{sentence(9)}</p></section>', f"<form><input value={words(1)}>{words(2)}</form>", f'<div class="related"><ul>{links}</ul></div>']
        page = f"<html><body>{''.join(rng.sample(chrome, rng.randint(0, 6)))}<div id=page>{article}</div>{''.join(rng.sample(after, rng.randint(0, 4)))}</body></html>"
        got = html.main_text(page).split("\n")
        found, planted, both = found + len(got), planted + len(lines), both + len([t for t in got if t in set(lines)])
    assert both >= 0.99 * planted and both >= 0.99 * found


def test_suffix_array_of_texts_longer_than_blocks(spark):
    rng = np.random.default_rng(4)
    noise = rng.integers(97, 123, 1_200_000).astype(np.uint8).tobytes().decode()
    texts = {1: "a" * 4_500_000, 2: noise, 3: "ab" * 300_000 + "a" * 200, 4: "x" + noise[600_000:1_100_000] + "y" + noise[:49], 5: "b" * 30 + "ab" * 5000 + "a" * 70_000 + noise[-50:], 6: "ab" * 300_000}
    got = suffixes.repeat_digests(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == _byte_repeats(texts)


def test_one_repeated_character_makes_few_suffixes():
    from candlewick.llm.blocks import Block

    block = Block(np.full(1 << 20, 97, np.uint8), np.array([0, 1 << 20]), np.array([1]))
    places, *_ = suffixes._grams(block)
    assert len(places) > 1_000_000 and len(suffixes.Suffixes.at(block, places)) < 200


def test_recompression_decides_what_is_compared(spark, monkeypatch):
    """Only windows whose symbols the rounds name as shared reach the comparison: without names nothing is removed."""
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    shared = words(60)
    docs = spark.createDataFrame([(k, f"{words(rng.randint(30, 200))} {shared} {words(50)}") for k in range(40)] + [(100, "a b " * 300), (101, "c " * 90 + words(30))], "doc_id long, text string").repartition(4)
    assert sum(r.n_removed for r in recompression.repeat_digests(docs).collect()) >= 39 * 60
    named = recompression._named

    def nothing_shared(by_words):
        run = named(by_words)

        def blank(batches):
            for b in run(batches):
                yield b.set_column(2, "data", recompression.blobs([recompression.packed("r", 0 * recompression.unpacked("r", d)[0]) for d in b.column("data").to_pylist()]))

        return blank

    monkeypatch.setattr(recompression, "_named", nothing_shared)
    assert sum(r.n_removed for r in recompression.repeat_digests(docs).collect()) == 0


def test_contents_with_equal_hashes_are_told_apart():
    buf = np.frombuffer(b"ab cd ab ef", np.uint8)
    start, end = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    first, number = recompression.exact_words(buf, start, end, np.zeros(4, np.uint64))
    assert number[0] == number[2] and len(set(number)) == 3 and len(first) == 3
    _, number = recompression.distinct_rows(np.zeros(3, np.uint64), [np.array([1, 1, 1]), np.array([2, 3, 2])])
    assert number[0] == number[2] != number[1]
    codes, words = bpe._distinct(np.frombuffer("abcd".encode("utf-32-le"), np.uint32), "abcd", np.array([0, 2]), np.array([2, 4]))
    assert [words[k] for k in codes] == ["ab", "cd"]


def test_license_query_finds_edited_copies_and_nothing_else(spark):
    rng = random.Random(9)
    word = lambda: "w" + "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, want = [], set()
    for k in range(60):
        before, after = " ".join(word() for _ in range(rng.randint(0, 80))), " ".join(word() for _ in range(rng.randint(0, 80)))
        if k % 3 == 0:
            rows.append((k, before + " " + after))
            continue
        name = rng.choice([n for n, t in licenses.TEMPLATES.items() if len(t.split()) > 25])
        words = licenses.TEMPLATES[name].split()
        edits = rng.sample(range(4, len(words) - 4), len(words) // 15)
        for e in edits:
            words[e] = word()
        copy = " ".join(words).replace(", ", " ,\n") if k % 2 else " ".join(words)
        rows.append((k, f"{before} {copy} {after}"))
        tokens = re.findall(r"[0-9a-z\x80-\U0010ffff]+", licenses.TEMPLATES[name].lower())
        lost = sum(len(re.findall(r"[0-9a-z\x80-\U0010ffff]+", licenses.TEMPLATES[name].split()[e].lower())) for e in edits)
        start = len(before) + 1 if before else 1
        want.add((k, name, len(tokens) - lost, start))
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = {(r.doc_id, r.template, r.matched, r.start_char + (not rows[r.doc_id][1][r.start_char].isalnum())) for r in got if len(licenses.TEMPLATES[r.template].split()) > 25}
    assert {x[:3] for x in found} == {x[:3] for x in want}
    assert all(abs(a[3] - b[3]) <= 1 for a in found for b in want if a[:2] == b[:2])
    again = [(None, licenses.TEMPLATES["isc"]), (None, licenses.TEMPLATES["isc"]), (1, None)]
    assert len(licenses.scanned(spark.createDataFrame([(*r, "x", 1) for r in again], "doc_id long, text string, template string, matched int")).collect()) == 2


def _url_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url) if url else None
    return (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")


def test_url_verdicts_equal_a_plain_propagation(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").unionByName(_pages(spark).drop("host"))
    rows = pages.collect()
    seeds, edges = {}, {}
    best = lambda host, path: max(((len(h + p), h + p, a) for a, h, p in urls.RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    for r in rows:
        host, path = _url_parts(r.url)
        if not host:
            continue
        fit = best(host, path)
        n = seeds.setdefault(host, [0, 0, 0])
        n[2] += 1
        if fit:
            n[fit[2] == "block"] += 1
        for link in re.findall(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'>]+)""", r.html or ""):
            other = _url_parts("http:" + link if link.startswith("//") else link)[0]
            if other and other != host:
                edges[host, other] = edges.get((host, other), 0) + 1
    scores = _propagated({h: (a / n, b / n) for h, (a, b, n) in seeds.items()}, [(a, b, w) for (a, b), w in edges.items()], 300 if edges else 0, urls.RESTART)
    want = []
    for r in rows:
        host, path = _url_parts(r.url)
        fit, (trust, distrust) = best(host, path), scores.get(host, (0.0, 0.0)) if host else (0.0, 0.0)
        want.append((r.page_id, fit[2] if fit else "block" if distrust >= urls.THRESHOLD and distrust > trust else "allow"))
    assert sorted((r.page_id, r.verdict) for r in urls.judged(pages).collect()) == sorted(want)


def test_quality_verdicts_equal_plain_estimates(spark, data):
    """The same estimates, group by group, in numpy."""
    stats = quality.text_statistics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet") if os.path.isdir("/root/testdata/sf0.01") else spark.read.parquet(f"{data}/documents.parquet"), ["doc_id", "lang", "source"])
    pdf = stats.toPandas()
    words, lines = pdf.n_words.clip(lower=1), pdf.n_lines.clip(lower=1)
    x = np.stack([np.log(pdf.word_chars.clip(lower=1) / words), np.sqrt(pdf.n_symbols / words), np.sqrt(pdf.n_dup_lines / lines), np.sqrt(pdf.n_repeat_words / words)], 1)
    failed = ((pdf.n_words < 50) | (100 * pdf.n_repeat_words > 50 * pdf.n_words)).to_numpy()
    own = (pdf.lang.fillna("-") + "\x1f" + pdf.source.fillna("-")).to_numpy()
    pool = pdf.lang.fillna("-").to_numpy()
    size = {g: int(((own == g) & ~failed).sum()) for g in set(own)}
    small = np.array([size[g] < 100 for g in own])
    rest = {p: int(((pool == p) & small & ~failed).sum()) for p in set(pool)}
    group = np.array([o if not s else f"pool:{p}" if rest[p] >= 100 else "rest" for o, s, p in zip(own, small, pool)], object)
    middle = lambda v, share: np.sort(v)[max(0, int(np.ceil(share * len(v))) - 1)]
    floor = np.diag(np.square(quality.FLOOR))
    floor[2, 3] = floor[3, 2] = quality.SHARED * quality.FLOOR[2] * quality.FLOOR[3]
    state = {}
    for g in set(group[~failed]):
        v = x[(group == g) & ~failed]
        centre = np.array([middle(c, 0.5) for c in v.T])
        state[g] = [v, centre, np.linalg.inv(np.diag([(1.4826 * middle(np.abs(c - m), 0.5)) ** 2 for c, m in zip(v.T, centre)]) + floor)]
    far = lambda v, m, p: np.einsum("ij,jk,ik->i", v - m, p, v - m)
    while True:
        moved = 0.0
        for g, (v, m, p) in state.items():
            d = far(v, m, p)
            near = v[d <= middle(d, quality.INNER)]
            new, inverse = near.mean(axis=0), np.linalg.inv(np.cov(near.T, bias=True) * quality.CONSISTENCY + floor)
            moved = max(moved, (np.abs(new - m) * np.sqrt(np.diag(inverse))).max(), (np.abs(np.log(np.diag(inverse) / np.diag(p))) / 2).max())
            state[g] = [v, new, inverse]
        if moved <= quality.TOLERANCE:
            break
    want = {}
    for k, f, g, row in zip(pdf.doc_id, failed, group, x):
        want[k] = bool(not f and far(row[None], *state[g][1:])[0] <= quality.CUTOFF)
    got = {r.doc_id: r.kept for r in quality.robust_outliers(stats).collect()}
    differ = [k for k in want if want[k] != got[k]]
    assert set(want) == set(got) and len(differ) <= 0.002 * len(want), differ


def test_sections_of_an_article_stay():
    """Marks and lists of links inside an article: names of its sections and its references stay, menus and notices go."""
    prose = "The measured values agree with what the earlier work found, apart from two that were read twice and are left out here."
    links = lambda n: "".join(f'<li><a href="/p{k}">Paper {k}</a></li>' for k in range(n))
    page = f"""<body><nav><a href=/>Home</a></nav><article><h1>On values</h1><p>{prose}</p>
      <section id="discussion"><h2>Discussion</h2><p>{prose} A.</p></section><section id="related"><h2>Related work</h2><p>{prose} B.</p></section>
      <div class="form"><p>{prose} C.</p></div><div class="notice">Cookies here.</div><div class="related"><a href=/x>More of this</a> <a href=/y>And this</a></div>
      <h2>References</h2><ul>{links(3)}</ul><h3>Related articles</h3><ul>{links(2)}</ul><p>{prose} D.</p><ul>{links(4)}</ul>
      <ol><li><a href=/long>{prose[:60]}</a></li><li><a href=/long2>{prose[:70]}</a></li></ol>
      <section class="comments"><p>{prose} E.</p></section></article><footer>End</footer></body>"""
    assert html.main_text(page).split("\n") == ["On values", prose, "Discussion", f"{prose} A.", "Related work", f"{prose} B.", f"{prose} C.", "References", "Paper 0", "Paper 1", "Paper 2", f"{prose} D.", prose[:60].strip(), prose[:70].strip()]


def test_many_lists_of_links_cost_linear_time():
    page = "<article>" + "<ul><li><a href=/>x</a></li></ul>" * 20_000 + "<p>text</p></article>"
    began = time.time()
    assert html.main_text(page) == "text" and html.main_text("<div>" * 20_000 + "<a href=/>x</a>") is not None
    assert time.time() - began < 20


def test_unclosed_links_cost_linear_time(spark):
    pages = [(1, "http://a.org/", "<a " * 400_000), (2, "http://a.org/", "<a href=" + " " * 400_000), (3, "http://a.org/", "<a " + "href " * 200_000), (4, "http://a.org/", "<a title=x href='//B.org/x'>b</a> <A\nHREF = \"https://c.org\">")]
    began = time.time()
    edges = urls.link_edges(urls.with_host_and_path(spark.createDataFrame(pages, "page_id long, url string, html string")))
    assert {(r.src, r.dst, r.links) for r in edges.collect()} == {("a.org", "b.org", 1), ("a.org", "c.org", 1)}
    assert time.time() - began < 30


def test_scans_cut_alike_whatever_columns_they_read(spark):
    """Long rows and wide further columns: record batches end elsewhere, blocks don't."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    shared = " ".join(rng.choice(words) for _ in range(30))
    rows = [(k, " ".join(rng.choice(words) for _ in range(1700)) + (shared if k % 50 == 0 else ""), "u" * 3000) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string").coalesce(1)
    got = suffixes.without_repeats(docs).select("doc_id", "n_removed", F.length("url").alias("u")).collect()
    assert len(got) == 6000 and all(r.u == 3000 and (r.n_removed >= len(shared) - 2) == (r.doc_id % 50 == 0 and r.doc_id > 0) for r in got)


def test_blocks_are_cut_by_text_alone(monkeypatch):
    rng = random.Random(7)
    texts = [rng.choice([None, "", "é", "x" * rng.randint(1, 90)]) for _ in range(500)] + ["y" * 300] + [""] * 50
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 100)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)

    def cut(sizes):
        table, out, at = pa.table({"doc_id": pa.array([None if k % 9 == 0 else k for k in range(len(texts))], pa.int64()), "text": pa.array(texts, pa.string()), "__more": pa.array([str(k) for k in range(len(texts))])}), [], 0
        while at < table.num_rows:
            n = next(sizes)
            out += table.slice(at, n).combine_chunks().to_batches()
            at += n
        return list(blocks.cut(iter(out)))

    whole = cut(iter([len(texts)]))
    for sizes in (iter(lambda: 1, 0), iter(lambda: rng.randint(1, 40), 0)):
        again = cut(sizes)
        assert [b.name for b in again] == [b.name for b in whole] and [b.columns().column("more").to_pylist() for b in again] == [b.columns().column("more").to_pylist() for b in whole]
    assert b"".join(b.buf.tobytes() for b in whole).decode() == "".join(t or "" for t in texts)
    assert all(len(b.doc) <= 7 and (len(b.buf) <= 100 or len(b.doc) == 1) for b in whole)


def test_mixing_tells_rows_without_ids_apart(spark):
    rows = [(None, "s", " ".join(f"w{k}" for _ in range(10))) for k in range(5000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len(got) == 5000 and abs(sum(r.taken for r in got) - got[0].target) <= 10
