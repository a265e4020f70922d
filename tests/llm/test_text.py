"""Text operators against brute force, with null, empty, long, tied and repeated rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprmat.llm import decontaminate as dc
from exprmat.llm import html_template as ht
from exprmat.llm import jaccard, url_lists

WORDS = [f"w{i}" for i in range(400)]


def _words(text, pattern):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(pattern, (text or "").translate(low))


def test_decontaminate_equals_brute_force(spark):
    item = " ".join(WORDS[:20])
    items = [(1, item), (2, "Short Ünit"), (3, None), (4, ""), (10, " ".join(WORDS[5:30])), (1, item), (None, " ".join(WORDS[100:113]))]
    docs = [(1, item.upper()), (2, "x, " * 50 + " ".join(WORDS[3:18]) + " y"), (3, None), (4, ""), (5, " ".join(WORDS[:12])),
            (6, "short ünit! Short ünit"), (7, "clean text only"), (8, "pad " * 20_000 + item), (9, " ".join(WORDS[100:113])),
            (1, item.upper()), (None, item), (11, " ".join(WORDS[:12] + ["z"] + WORDS[12:20])), (12, "short Ünit"), (13, "w0 " * 40)]
    d = spark.createDataFrame([(i, t, "clash", 0) for i, t in docs], "doc_id long, text string, word string, n int")
    b = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, win string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in dc.decontaminate(d, b).collect()), key=str)
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wins = set()
    for i, t in items:
        w = _words(t, pattern)
        wins |= {(i, tuple(w[s:s + 13])) for s in range(max(1, len(w) - 12)) if w}
    want = []
    for i, t in docs:
        w, hit, found = _words(t, pattern), set(), set()
        for item_id, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s] == win[0] and tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(item_id)
        names = sorted(str(x) for x in found if x is not None)
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert dc.decontaminate(d.where("false"), b).count() == 0
    assert dc.decontaminate(d, b.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    # the shuffle-join plan beyond the broadcast bounds gives the same rows
    keep = dc.WINDOW_ROWS, dc.WORD_ROWS
    dc.WINDOW_ROWS = dc.WORD_ROWS = 0
    try:
        again = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in dc.decontaminate(d, b).collect()), key=str)
    finally:
        dc.WINDOW_ROWS, dc.WORD_ROWS = keep
    assert again == got


def _brute_components(docs):
    sets = []
    for _, t in docs:
        w = _words(t, r"[^\x20\x09-\x0D]+")
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(docs):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(docs))


def test_jaccard_components_equal_brute_force(spark):
    import random

    rnd = random.Random(5)
    passage = [rnd.choice(WORDS) for _ in range(60)]
    docs = []
    for g in range(12):
        base = [rnd.choice(WORDS) for _ in range(rnd.choice([20, 60, 150]))]
        for _ in range(rnd.choice([1, 2, 6, 12])):  # chains of copies at many distances, some just at the threshold
            copy = list(base)
            for _ in range(rnd.randint(0, len(copy) // 12)):
                copy[rnd.randrange(len(copy))] = rnd.choice(WORDS)
            docs.append((len(docs) + 10, " ".join(copy)))
            if rnd.random() < 0.3:
                base = copy
    docs += [(900 + i, " ".join(passage + [rnd.choice(WORDS) for _ in range(n)])) for i, n in enumerate([3, 10, 20, 30, 60, 200])]
    docs += [(950 + i, " ".join(passage)) for i in range(30)]
    docs += [(1, "a b"), (2, "A  B"), (3, ""), (4, None), (5, "a b c d e"), (6, "a b c d"), (7, "x " * 20_000), (8, " x" * 10_000), (9, "é É"), (9, "é É")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, cls string, size int").repartition(5)
    out = jaccard.jaccard_components(df)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == _brute_components(docs)
    kept = jaccard.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in _brute_components(docs)})
    assert kept.columns == df.columns
    assert jaccard.jaccard_components(df.where("false")).count() == 0


def test_jaccard_lists_keep_only_pairs_that_can_reach_the_overlap(spark):
    by_hash = sorted(WORDS, key=lambda w: int(jaccard.shingle_sets([w.encode()], 1)[0][0]))
    # the only common word: place 8 of 11 posted ones (31 of 40 held from there on), then place 2
    late = [by_hash[:40], by_hash[60:68] + [by_hash[8]] + by_hash[100:131]]
    early = [by_hash[200:240], [by_hash[202]] + by_hash[240:279]]
    frequent = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for sets, rows in ((late, 0), (early, 2)):
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(sets)], "doc_id long, text string")
        assert jaccard.prefix_lists(docs, "doc_id", "text", frequent, 16, 1).count() == rows


def test_jaccard_shuffled_forms_are_small_and_whole():
    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 24, 2000), [0, 65534, 65535, 65536, (1 << 24) - 1]])).astype(np.uint64)
    packed = jaccard._pack(keys)
    assert (jaccard._unpack(packed) == keys).all() and len(packed) < 3 * len(keys)
    assert len(jaccard._unpack(jaccard._pack(keys[:0]))) == 0
    posts = np.zeros(2000, jaccard._POSTING)
    posts["token"], posts["cls"] = (7 << 32) + rng.integers(0, 1 << 32, 2000), rng.integers(-(1 << 63), (1 << 63) - 1, 2000)
    posts["size"], posts["at"] = rng.integers(1, 1 << 32, 2000), rng.integers(0, 1 << 32, 2000)
    columns = jaccard._columns(posts, np.uint64(7 << 32))
    assert (jaccard._postings(columns, np.uint64(7 << 32)) == posts).all() and len(columns) == 20 * len(posts)


def test_jaccard_families_near_the_threshold(spark, monkeypatch):
    rng, docs = random.Random(7), []
    for family in range(6):
        base = [f"f{family}x{i}" for i in range(60)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(60)] = rng.choice(WORDS)
            docs.append((len(docs), " ".join(words[: rng.randint(48, 60)])))
    compared, whole = [], jaccard.distances
    monkeypatch.setattr(jaccard, "distances", lambda pairs, sets: compared.append(pairs.count()) or whole(pairs, sets))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()) == _brute_components(docs)
    assert sum(compared) < 300  # 225; 509 without the place of the common shingle


def test_jaccard_order_does_not_matter(spark):
    """The prefix order from corpus counts changes candidates, never links."""
    docs = [(i, " ".join(WORDS[:40] + WORDS[40 + i % 3 * 5:60])) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    keep = jaccard.FREQUENT
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()) == _brute_components(docs)
    assert jaccard.FREQUENT == keep


PAGE = ("<html><head><title>no</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href='/'>no</a></ul></nav>{0}"
        "<footer>no</footer></body></html>")


@pytest.mark.parametrize(("html", "want"), [
    (PAGE.format("<article><h1>T</h1><p>a<b>b</b>c&nbsp; d&amp;amp;<br>e<p>f<!-- no --></article>"), "T abc d&amp; e f"),
    (PAGE.format("<div id=sidebar>no</div><div id='main-content'><p>yes</p><div class='comments'><p>no</div><form>no</form></div>"), "yes"),
    ("<p>just <i>te</i>xt &lt;b&gt; a < b", "just text <b> a < b"), ("<article><p>cut <scr", "cut"), ("", ""), (None, ""),
    ("<article><p>kept</p><aside>no</aside><div class='cookie-notice'>no</div><script>x", "kept"), ("<script>only", ""),
])
def test_main_text(html, want):
    assert ht.main_text(html or "", frozenset(), frozenset()) == want


def test_template_deduction(spark):
    """Without any mark, text that all pages of a host share and slots of links go; what differs stays."""
    def page(i):
        links = "".join(f"<li><a href='/{i}{j}'>link {i} {j}</a></li>" for j in range(3))
        return f"<html><body><div class=x1><ul>{links}</ul></div><div class=x2>Welcome to us</div><div class=x3><p>Story {i}</p><p>Same end</p></div></body></html>"

    rows = [(i, f"http://One.org/{i}", page(i)) for i in range(6)] + [(10, "http://two.org/", page(99)), (11, None, None), (12, "x", ""),
            (0, "http://One.org/0", page(0)), (13, "http://three.org/a", "<article>" + "long " * 50_000 + "</article>")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in ht.extract_text(df).collect()}
    assert ht.extract_text(df).count() == len(rows)
    for i in range(6):
        assert got[i, f"http://One.org/{i}"] == (f"Story {i}", len(f"Story {i}"))
    assert got[10, "http://two.org/"][0].startswith("Story 99") or "Story 99" in got[10, "http://two.org/"][0]
    assert got[11, None] == ("", 0) and got[12, "x"] == ("", 0)
    assert got[13, "http://three.org/a"][1] == 5 * 50_000 - 1
    assert ht.extract_text(df.where("false")).count() == 0


def test_template_decides_on_marked_pages(spark):
    """Text repeated within the mark goes, link slots too; a mark that holds little loses to the host's other slots."""
    def page(i):
        return (f"<html><body><div class='w-1/2'>Hello all</div><article><p>Story {i}</p><p>Same end</p><ul><li><a href='/{i}'>more {i}</a></li></ul>"
                "</article></body></html>")

    def shell(i):
        return f"<html><body><article><p>Teaser {i}</p></article><div class=x4><p>{f'body of {i} ' * 20}</p><p>Same end</p></div></body></html>"

    rows = [(i, f"http://one.org/{i}", page(i)) for i in range(6)] + [(10 + i, f"http://two.org/{i}", shell(i)) for i in range(6)]
    got = {r.page_id: r.text for r in ht.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Story {i}"
        assert got[10 + i] == f"Teaser {i} " + " ".join([f"body of {i}"] * 20)


def test_copies_are_no_template(spark):
    """Hosts made of copies of one page, marked or not, keep its text."""
    def page(i, tag):
        return f"<html><body><script>var id={i}</script><!-- {i} --><{tag}><p>One story</p><p>Its end</p></{tag}></body></html>"

    rows = [(10 * h + i, f"http://{name}.org/{i}", page(i, tag)) for h, (name, tag) in enumerate([("a", "div"), ("b", "article"), ("c", "div")]) for i in range(6)]
    got = ht.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 18 and {r.text for r in got} == {"One story Its end"}


def test_template_text_is_nested(spark):
    """Text as frequent as an element elsewhere on the page, but in none that comes with it, is no template text."""
    rows = [(i, f"http://one.org/{i}", "<html><body>" + ("<hr-x>a</hr-x>" if i < 3 else "") + f"<p>Story {i}</p>" + ("<p>Told thrice</p>" if i < 3 else "")
             + "</body></html>") for i in range(6)]
    got = {r.page_id: r.text for r in ht.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} Told thrice" if i < 3 else f"Story {i}" for i in range(6)}


def test_equivalence_classes(spark):
    pages = spark.createDataFrame([("h", i, f"<html><body><div class=a>fixed</div><p>{i}</p>" + "<p>x</p>" * (i % 2) + "</body></html>") for i in range(1, 9)],
                                  "host string, page long, html string")
    n = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    got = ht.valid_classes(ht.token_vectors(pages), n)
    texts = [r.token for r in got.where("text").collect()]
    assert ht._key("/html/body/div.a", "fixed") in texts and ht._key("/html/body/p", "1") not in texts
    assert got.where("nested_in is not null").count() >= 1  # p varies, below the root class


def test_url_lists(spark):
    t = "2024-0{}-01 00:00:00".format
    entries = [("host", "a.com", "block", t(2)), ("host", "a.com", "remove", t(4)), ("domain", "B.org", "block", t(1)),
               ("path", "x.b.org/ok", "allow", t(1)), ("word", "pills", "block", t(3)), ("host", "tie.com", "block", t(1)),
               ("host", "tie.com", "allow", t(1)), ("host", None, "block", t(1)), ("host", "a.com", "block", None), ("domain", "sub.b.org", "allow", t(5))]
    captures = [(1, "http://a.com/", t(1)), (2, "http://a.com/", t(2)), (3, "HTTPS://user@WWW.A.com.:8080/x?y#z", t(3)), (4, "http://a.com", t(4)),
                (5, "http://x.b.org/ok/1", t(6)), (6, "http://x.b.org/no", t(6)), (7, "http://b.org", t(1)), (8, "http://cheap-pills.net/", t(3)),
                (9, "http://cheap-pills.net/", t(2)), (10, "http://tie.com", t(2)), (11, None, t(2)), (12, "not a url", t(2)), (13, "http://a.com/", None),
                (14, "http://deep.sub.b.org/", t(6)), (14, "http://deep.sub.b.org/", t(6)), (15, "http://notb.org/", t(6)), (None, "http://b.org", t(3))]
    e = spark.createDataFrame([(*r, 0) for r in entries], "kind string, pattern string, action string, dated string, ends int").withColumn("dated", F.col("dated").cast("timestamp"))
    c = spark.createDataFrame([(*r, "c") for r in captures], "page_id long, url string, fetched_at string, kind string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    got = sorted(((r.page_id, r.verdict, r.pattern) for r in url_lists.filter_urls(c, e).collect()), key=str)
    want = [(1, "unlisted", None), (2, "blocked", "a.com"), (3, "blocked", "a.com"), (4, "unlisted", None), (5, "allowed", "x.b.org/ok"),
            (6, "blocked", "b.org"), (7, "blocked", "b.org"), (8, "blocked", "pills"), (9, "unlisted", None), (10, "allowed", "tie.com"),
            (11, "unlisted", None), (12, "unlisted", None), (13, "unlisted", None), (14, "allowed", "sub.b.org"), (14, "allowed", "sub.b.org"),
            (15, "unlisted", None), (None, "blocked", "b.org")]
    assert got == sorted(want, key=str)
    assert url_lists.filter_urls(c, e.where("false")).where("not kept").count() == 0
    assert url_lists.filter_urls(c.where("false"), e).count() == 0


def test_url_lists_see_the_whole_url(spark):
    """Deep paths, words of later segments, query and fragment, capitals, and ``www.`` in patterns."""
    entries = [("path", "h.com/en/7", "block"), ("path", "h.com/en/7/ok", "allow"), ("path", "WWW.Caps.com/En/", "block"), ("word", "pills", "block"),
               ("host", "www.w.com", "block"), ("domain", "www.D.org.", "block")]
    captures = {"http://h.com/en/7": "h.com/en/7", "http://h.com/en/7/x?q": "h.com/en/7", "http://h.com/en/7/ok/1": "h.com/en/7/ok", "http://h.com/en/70": None,
                "http://h.com/en": None, "http://caps.com/EN/1": "caps.com/en", "http://k.com/en/cheap-PILLS": "pills", "http://k.com/en/7?q=pills": "pills",
                "http://k.com?pills": "pills", "http://k.com/a#pills": "pills", "http://k.com/spills": None, "http://www.w.com/": "w.com",
                "http://a.d.org/": "d.org", "http://k.com//en/7/": None}
    e = spark.createDataFrame(entries, "kind string, pattern string, action string").withColumn("dated", F.lit("2024-01-01").cast("timestamp"))
    c = spark.createDataFrame(list(enumerate(captures)), "page_id long, url string").withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp"))
    out = url_lists.filter_urls(c, e).collect()
    assert {r.url: r.pattern for r in out} == captures
    assert {r.url for r in out if r.verdict == "allowed"} == {"http://h.com/en/7/ok/1"}
