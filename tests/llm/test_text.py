"""Extraction, URL verdicts, packing, quality, toxicity."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.llm.html_text import extract_pages, main_text
from fleetpulse.llm.kneser_ney import perplexities, quality
from fleetpulse.llm.sequence_pack import TIERS, pack, pack_documents
from fleetpulse.llm.toxicity_knn import toxicity
from fleetpulse.llm.url_templates import judge_urls

ARTICLE = "<h1>Title &amp; more</h1><p>First   paragraph\nwith <b>bold</b> text, and words enough.<p>Second<br>line &#233;t&eacute;.</p><ul><li>one<li>two</ul>"
TEXT = "Title & more\nFirst paragraph with bold text, and words enough.\nSecond line été.\none\ntwo"


@pytest.mark.parametrize("page", [
    f"<html><head><title>x</title><script>var a='<p>no</p>'</script></head><body><nav><a href=/>Home</a></nav><article>{ARTICLE}</article>"
    "<footer>&copy; us</footer></body></html>",
    f"<body><div class='sidebar'>side</div><div id=main>{ARTICLE}</div><div class='cookie-notice'>We use cookies</div><form>name <input></form>"
    "<section id=comments><p>a reader's long comment that says very much about it all, again and again and again</p></section>",
    f"<main>{ARTICLE}",
    f"<div><header>Site name</header><div><div>{ARTICLE}<aside>more</aside></div></div><div class=ads>buy</div></div>",
])
def test_main_text_of_pages(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize("page", ["<body><nav><a href=/>Home</a></nav><div>{}</div><footer>us</footer>", "<body><nav><a href=/>Home</a></nav>{}<footer>us</footer>",
                                  "<body><div><a href=/>Home</a> <a href=/a>News of the day</a> <a href=/b>Weather and traffic</a></div>{}"])
@pytest.mark.parametrize("sizes", [(300, 300, 300), (300, 150, 200)])
def test_main_text_of_sections_without_article(page, sizes):
    parts = [(f"Part {i}", *(f"{i}{j} " + "word " * (n // 5) + "end." for j in range(4))) for i, n in enumerate(sizes)]
    story = "".join(f"<section><h2>{h}</h2>" + "".join(f"<p>{p}</p>" for p in ps) + "</section>" for h, *ps in parts)
    assert main_text(page.format(story)) == "\n".join(line for part in parts for line in part)


def test_extraction_of_odd_pages(spark):
    deep = "<div>" * 30_000 + "deep" + "</div>" * 10
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p></p>"), (None, "u", "plain  text"), (5, "u", deep), (5, "u", deep), (6, "u", "<p>a<!-- x --><p>&lt;b&gt;")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract_pages(pages).collect())
    assert got == [(0, "u", "plain text", 10), (1, "u", "", 0), (2, "", "", 0), (3, "u", "", 0), (5, "u", "deep", 4), (5, "u", "deep", 4), (6, "u", "a\n<b>", 5)]
    assert extract_pages(pages.limit(0)).count() == 0


def test_url_rules_and_templates(spark):
    urls = [
        "http://A.Example.ORG/es/5?x", "https://example.org/en/12", "https://example.org/en/22", "http://notexample.org/es/1", "http://x.com/fr/1#a", "x.com/fr/1",
        None, "http://b.com/de/", "http://b.com", "http://c.net/a?b://d/e", "ftp://org/", "http://u:p@h.com:80/de/1"]
    bad = [f"http://shop.net/spam/{i}" for i in range(40)]
    good = [f"http://shop.net/news/{i}" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls + bad + good)), "page_id bigint, url string")
    marks = spark.createDataFrame([(u, 1) for u in bad[:20]] + [(u, 0) for u in good[:20]] + [(None, None)], "url string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, marks).collect()}
    assert got[0] == ("a.example.org", "/es/5", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("example.org", "/en/22", "org/", "allow")
    assert got[3] == ("notexample.org", "/es/1", "org/", "allow")
    assert got[4] == ("x.com", "/fr/1", "com/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("b.com", "/de/", "com/de/", "block") and got[8] == ("b.com", "", None, "allow")
    assert got[9][:3] == ("c.net", "/a", None) and got[10] == ("org", "/", "org/", "allow") and got[11][:2] == ("u:p@h.com:80", "/de/1")
    n = len(urls)
    assert {got[i][3] for i in range(n, n + 40)} == {"block"} and {got[i][3] for i in range(n + 40, n + 80)} == {"allow"}
    assert len(got) == n + 80
    assert judge_urls(pages.limit(0), marks).count() == 0 and judge_urls(pages, marks.limit(0)).count() == n + 80


@pytest.mark.parametrize("layout", ["page no-sidebar", "layout with-sidebar", "has_sidebar", "without-ads page"])
def test_layout_classes_are_no_asides(spark, layout):
    html = f'<body><div class="{layout}"><p>{"The story goes on here. " * 9}</p><div class="left-sidebar">Links and more</div></div></body>'
    got = extract_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()
    assert got.text == ("The story goes on here. " * 9).strip()


def test_url_branches_below_a_variable_segment(spark):
    """What stands below a wildcard is counted over all values of the wildcard."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("ghijklmnop") for _ in range(9))
    urls = [(f"http://h.net/{word()}/{end}{tail}", end) for end in ("spam", "news") for k in range(200) for tail in ["/" + "d/" * 5000 if k < 6 else ""]]
    pages = spark.createDataFrame([(i, u, "x") for i, (u, _) in enumerate(urls)], "page_id long, url string, host string")
    marks = spark.createDataFrame([(u, int(end == "spam")) for u, end in urls[::2]], "url string, bad int")
    got = {g.page_id: g for g in judge_urls(pages, marks).collect()}
    assert len(got) == len(urls)
    for i, (u, end) in enumerate(urls):
        if u.endswith(end):
            assert (got[i].template, got[i].verdict) == (f"/*/{end}", "block" if end == "spam" else "allow")


def test_pack_holds_every_token_once():
    r = random.Random(1)
    for sizes in ([1], [4096], [4097, 1], [0], [], [3] * 50, [r.choice([1, 7, 300, 1000, 5000, 20_000]) for _ in range(400)]):
        seen = defaultdict(list)
        for seq in pack(sizes):
            total = sum(n for _, _, n in seq)
            assert 0 < total <= 4096 and not total & (total - 1)
            for doc, at, n in seq:
                seen[doc].append((at, n))
        for doc, size in enumerate(sizes):
            at = 0
            for start, n in sorted(seen[doc]):
                assert start == at and n > 0
                at += n
            assert at == size


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["It's we'll HELLO, world's 12345 a1b2!!", "<|endoftext|> x<|startoftext|>", "Straße ÉTÉ naïve ﬁ e\u0301 İ ²½ \u00a0nbsp\u2003em", "日本語 текст Ωμέγα", None, "",
             "x" * 300, "a " * 9000, "\x1c\x1d mixed\x0bwhite\x0cspace\r\n", "&&& *** $$$ ### c++ it’s 'll"] * 2
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "no id", 0)], "doc_id bigint, text string, length int").repartition(3)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in pack_documents(docs).collect():
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for i, t in [*enumerate(texts), (None, "no id")]:
        ids, at = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == own[0].tier <= TIERS[-1]
    assert pack_documents(docs.limit(0)).count() == 0


def brute_kneser_ney(trusted, order):
    """p(gram) from the definition, with the same discounts."""
    from collections import Counter

    levels = {order: Counter()}
    for t in trusted:
        s = "\x02" * (order - 1) + t + "\x03"
        levels[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discounts(k):
        n = [sum(c == i for c in levels[k].values()) for i in (1, 2, 3, 4)]
        if not all(n):
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / (len(levels[1]) + 1)
        d = discounts(k)
        same = {h: c for h, c in levels[k].items() if h[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return below
        c = levels[k][g]
        return (max(c - d[min(c, 3)], 0) + sum(d[min(c, 3)] for c in same.values()) * below) / total

    return p


def test_perplexity_equals_definition(spark):
    trusted = ["abra cadabra abra", "cadabra cab", "bad cab dab", "abc abd abe aaaa bbbb"]
    others = ["abra zebra", "", "xyz"]
    rows = [(i, "l", t) for i, t in enumerate(trusted + others)] + [(90, "none", "abra")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    ids = spark.createDataFrame([(i,) for i in range(len(trusted))], "doc_id bigint")
    got = {r.doc_id: (r.symbols, r.log_sum) for r in perplexities(docs, ids, order=3, block_chars=40).collect()}
    p = brute_kneser_ney(trusted, 3)
    for i, _, t in rows[:-1]:
        s = "\x02\x02" + t + "\x03"
        want = sum(np.log(p(s[j : j + 3])) for j in range(len(t) + 1))
        assert got[i][0] == len(t) + 1 and got[i][1] == pytest.approx(want)
    assert got[90] == (5, None)


def test_quality_rejects_noise(spark):
    r = random.Random(2)
    words = "the quick brown fox jumps over lazy dogs while small birds sing".split()
    clean = [(i, "en", " ".join(r.choice(words) for _ in range(40)) + ".") for i in range(120)]
    noise = [(200 + i, "en", "".join(chr(r.randrange(33, 126)) for _ in range(150))) for i in range(10)]
    odd = [(300, None, None), (301, "xx", "any"), (None, "en", "the quick brown fox"), (302, "en", "the lazy dogs " * 3000)]
    docs = spark.createDataFrame(clean + noise + odd, "doc_id bigint, lang string, text string").withColumn("kept", F.lit("own column"))
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(200, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    got = [(x.doc_id, x.kept) for x in quality(docs, labels, high=1.0).collect()]
    kept = dict(got)
    assert len(got) == docs.count()
    assert not any(kept[200 + i] for i in range(10)) and sum(kept[i] for i in range(120)) >= 112
    assert kept[300] and kept[301]


def test_toxicity_learns_words(spark):
    r = random.Random(4)
    plain, foul = [f"w{i}" for i in range(60)], ["vile", "nasty", "rotten", "awful"]
    rows, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [r.choice(plain) for _ in range(30)]
        if toxic:
            words[3], words[11] = r.sample(foul, 2)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "Vile!"), (902, "Vile!"), (None, "w1 w2"), (903, "w1 " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame(marks + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    held = [g for g in got if g.doc_id is not None and g.doc_id < 400 and g.held_out]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got if g.doc_id is not None)
    right = sum(g.predicted == (g.doc_id % 4 == 0) for g in held)
    assert right >= 0.95 * len(held)
    assert toxicity(docs.limit(0), labels).count() == 0
    assert {g.predicted for g in toxicity(docs, labels.limit(0)).collect()} == {0}


def test_rows_of_one_id_or_none_go_by_their_own_text(spark):
    from fleetpulse.llm.kneser_ney import keep_good

    good = [(i, "the cat sat on the mat and the dog", "en") for i in range(40)]
    rows = good + [(5, "zqx#" * 9, "en"), (None, "zqx#" * 9, "en"), (None, "the cat sat on the mat and the dog", "en"), (900, None, "en"), (901, "zqx#" * 9, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, digest string, __id int")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, quality int")
    kept = keep_good(docs, labels, high=1.0).drop("digest", "__id").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text[:3] if r.text else "") for r in kept) == sorted(
        [(False, i, "the") for i in range(40)] + [(True, 0, "the"), (False, 901, "zqx")] + ([(False, 900, "")] if any(r.doc_id == 900 for r in kept) else []))
