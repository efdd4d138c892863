"""Main text of pages, the registered queries, and the stages of the pipeline."""

import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from taktspur.llm import html_text, pii
from taktspur.llm.queries import ORACLE, QUERIES

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<div id="cookie-notice">We use cookies</div>
<main><article class="post"><h1>Title &amp; more</h1><p>First <b>bold</b>
 text&nbsp;here.<br>Next</p><script>var t="</p>";</script><!-- no --><aside>Aside</aside>
<div class="ad">Buy</div><p>Second&#33;<p>Third</article>
<section class="comments"><p>Nice!</p></section></main>
<form><p>Mail</p><button>Go</button></form><footer>&copy; x</footer></body></html>"""


def text_of(page):
    lines, states = html_text.page_lines(page)
    return "\n".join(t for t, v in zip(lines, html_text.settled(states)) if v >= 0)


def test_article_without_furniture():
    assert text_of(ARTICLE) == "Title & more\nFirst bold text here. Next\nSecond!\nThird"
    assert text_of(ARTICLE[:ARTICLE.index("Second")]) == "Title & more\nFirst bold text here. Next"
    assert text_of("") == "" and text_of("<p") == "" and text_of("plain &lt; text") == "plain < text"


@pytest.mark.parametrize("page, text", [
    ('<article class="post social-science"><p>Body</p></article>', "Body"),
    ('<article><h1 id="search">Searching</h1><h2 id="related-work">Related work</h2><p id="notice">x</article>',
     "Searching\nRelated work\nx"),
    ('<article><p class="notice">N<p>Real text<p>More</article>', "Real text\nMore"),
    ('<article><ul><li class="ad">Ad<li>Point one<li>Two</ul></article>', "Point one\nTwo"),
    ('<article><table><tr class="ad"><td>Buy<td>now<tr><td>a<td>b</table></article>', "a b"),
    ('<article><dl><dt class="ad">t<dd>d<dt>u</dl></article>', "d\nu"),
    ('<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</article>', "So x=1 holds"),
    ('<article><p class="ad">Buy<div>Text</div></article>', "Text"),
    ('<article><p>one <span>two</span> three<sup>4</sup> <span class="ad">Buy</span>five</article>', "one two three4\nfive"),
    ('<article><div class="ad-slot-3">Buy</div><div class="top_menu">M</div><div class="menus-of-france">Text</div></article>',
     "Text"),
    ('<article><ul><li class="ad">Ad<ul><li>inner</ul><li>Point</ul></article>', "Point"),
])
def test_names_of_furniture_are_whole_and_ends_may_be_left_out(page, text):
    assert text_of(page) == text


def mostly(n, pages):
    """Half is outside the two-sided test of the share, on the lower side (the same interval, the other way round)."""
    return n / pages > 0.5 and (n / pages - 0.5) ** 2 >= 1.959964 ** 2 * 0.25 / pages


def plain_text(rows):
    """The whole operator over a list: sort, align by a full table, count on the host, keep or drop."""
    hosts = {}
    for i, (host, path, page) in enumerate(rows):
        lines, states = html_text.page_lines(page)
        hosts.setdefault(host, {}).setdefault(tuple(lines), []).append((path, i, html_text.settled(states)))
    out = {}
    for versions in hosts.values():
        ordered = sorted(versions, key=lambda v: min(p for p, _, _ in versions[v]))
        shared = []
        for k, lines in enumerate(ordered):
            found = set()
            for other in ordered[max(k - 1, 0):k] + ordered[k + 1:k + 2]:
                found |= set(html_text.common_lines(list(lines), list(other)))
            shared.append(found)
        count = Counter(x for k, lines in enumerate(ordered) for x in {lines[i] for i in shared[k]})
        for k, lines in enumerate(ordered):
            for _, i, verdict in versions[lines]:
                inside = [j for j in shared[k] if verdict[j] == 1 and mostly(count[lines[j]], len(ordered))]
                if 2 * len(inside) >= sum(v == 1 for v in verdict):
                    inside = []
                out[i] = "\n".join(x for j, x in enumerate(lines) if verdict[j] >= 0 and j not in inside
                                   and not (verdict[j] == 0 and j in shared[k]))
    return out


def test_pages_equal_the_plain_version(spark):
    rng = random.Random(12)
    rows = []
    for h in range(9):
        menu, rate = [f"<div>Menu {h} {i}</div>" for i in range(5)], f"<p>Rate {h}</p>"
        for n in range(rng.choice([1, 2, 3, 4, 9, 30])):
            body = "".join(f"<p>Text {rng.randrange(40)} of {h}</p>" for _ in range(rng.randrange(7)))
            inner = f"<article><h1>Story {n}</h1>{rate}{body}</article>" if h % 2 else body
            page = "".join(rng.sample(menu, rng.randrange(6))) + inner + "<div>Seen</div><footer>f</footer>"
            rows += [(f"h{h}.example", f"/p/{n:03d}", page)] * rng.choice([1, 1, 1, 3])
    pages = spark.createDataFrame([(i, f"http://{h}{p}", x) for i, (h, p, x) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages.repartition(4)).collect()}
    assert got == plain_text(rows)


def test_long_lists_of_few_kinds_are_aligned_in_time():
    import time
    rng = random.Random(2)
    times = []
    for n in (5_000, 10_000, 20_000):
        a, b = ([rng.randrange(3) for _ in range(n)] for _ in range(2))
        start = time.perf_counter()
        assert len(html_text.common_lines(a, b)) > 0.6 * n
        times.append(time.perf_counter() - start)
    assert times[-1] < 20


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.choice([3, 12, 70, 130]))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html_text.common_lines(a, b)
        assert got == sorted(set(got)) and len(got) == best[-1][-1]
        rest = iter(b)
        assert all(any(a[k] == y for y in rest) for k in got)


def test_neighbours_show_what_is_furniture(spark):
    def page(n):
        return f"<body><div>Shop of things</div><div>Story {n} begins</div><p>Body {n}</p><div>Call us</div></body>"
    rows = [(n, f"http://a.example/x/{n}?q=1", page(n)) for n in range(1, 6)]
    rows += [(10, "http://b.example/only", page(10)), (11, "http://c.example/1", page(11)),
             (12, "http://c.example/2", page(11)), (13, None, None), (None, None, ""), (14, "http://d.example/", None),
             (1, "http://a.example/x/1?q=1", page(1))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = {}
    for r in html_text.extract_text(pages).collect():
        got.setdefault((r.page_id, r.url), []).append(r.text)
    for n in range(1, 6):
        assert set(got[n, f"http://a.example/x/{n}?q=1"]) == {f"Story {n} begins\nBody {n}"}
    assert len(got[1, "http://a.example/x/1?q=1"]) == 2
    whole = "Shop of things\nStory {0} begins\nBody {0}\nCall us"
    assert got[10, "http://b.example/only"] == [whole.format(10)]
    assert got[11, "http://c.example/1"] == [whole.format(11)]  # the neighbour is a copy
    assert got[13, None] == got[None, None] == got[14, "http://d.example/"] == [""]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_articles_are_aligned_too(spark):
    def page(n):
        return (f"<body><div>Shop of things</div><article><h1>Story {n}</h1><p>Rate this story</p><p>Quoted {n // 2}</p>"
                f"<p>Body {n}</p></article><div>Seen on page {n}</div><div>Call us</div></body>")
    rows = [(n, f"http://a.example/x/{n}", page(n)) for n in range(1, 10)]
    rows += [(n, f"http://b.example/x/{n}", page(n)) for n in (20, 21)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for n in range(1, 10):  # the whole host has one line of the articles, neighbours have another
        assert got[n] == f"Story {n}\nQuoted {n // 2}\nBody {n}\nSeen on page {n}"
    for n in (20, 21):  # two pages do not show what is furniture inside an article
        assert got[n] == f"Story {n}\nRate this story\nQuoted 10\nBody {n}\nSeen on page {n}"


def test_copies_in_a_row_are_cleaned_alike(spark):
    def page(n):
        return f"<body><div>Shop of things</div><div>Story {n} begins</div><p>Body {n}</p><div>Call us</div></body>"
    rows = [(n, f"http://a.example/x/{n}", page(n if n < 3 or n > 7 else 3)) for n in range(1, 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got == {n: "Story {0} begins\nBody {0}".format(n if n < 3 or n > 7 else 3) for n in range(1, 10)}


def test_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_whole_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name in ("op2_personal_data", "op6_toxicity", "op7_quality", "op8_token_counts"):
        out = QUERIES[name](spark, sf_dir)
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        assert out.count() == docs.count()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = QUERIES["op1_main_text"](spark, sf_dir)
    assert texts.count() == pages.count()
    # The pages are made of the documents: title, then the document line by line.
    body = texts.select(F.regexp_replace("text", "^[^\n]*\n", "").alias("text"))
    assert body.join(docs.select("text").distinct(), "text", "left_anti").count() == 0


def test_stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids, columns = [set(r[0] for r in docs.select("doc_id").collect())], docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    from .test_pairs import plain_components, plain_hits
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        before = docs
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        ids.append(set(r[0] for r in docs.select("doc_id").collect()))
        if name != "packing":
            assert docs.columns == columns and docs.schema == before.schema
        if name == "near_duplicates":
            rows = plain_components([(r.doc_id, r.text) for r in before.collect()])
            assert ids[-1] == {d for d, _, c in rows if d == c}
        if name == "decontamination":
            hits = {r.doc_id: plain_hits(r.text, bench) for r in before.collect()}
            assert ids[-1] == {d for d, (n, h, _) in hits.items() if not (h and 20 * h >= n)}
        if name == "personal_data":
            old = {r.doc_id: r.text for r in before.collect()}
            for r in docs.collect():
                assert r.text == pii.redact(old[r.doc_id], pii.find_spans(old[r.doc_id]))
                assert r.n_chars == len(r.text) or r.text == old[r.doc_id]
        if name == "packing":
            assert ids[-1] == ids[-2]
            whole = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
            assert whole.where("n <> m").count() == 0
    assert ids[1] < ids[0] and ids[2] < ids[1]


def rows_left(spark, stage, rows, sf_dir):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return sorted(map(tuple, dict(corpus_pipeline.STAGES)[stage](spark, docs, sf_dir).collect()), key=repr)


def test_near_duplicates_are_removed_by_row(spark, sf_dir):
    base = [f"word{i}" for i in range(120)]
    long, near, other = " ".join(base), " ".join(base[:-1] + ["end"]), " ".join(f"else{i}" for i in range(50))
    rows = [(7, long, "a"), (3, near, "b"), (None, long, "c"), (9, other, "d"), (9, other, "d"), (9, long, "e"),
            (None, "alone without an id", "f"), (None, "alone without an id", "f"), (4, None, "g"), (4, None, "g"), (5, None, "h"),
            (3, "another text of the same id", "i")]
    assert rows_left(spark, "near_duplicates", rows, sf_dir) == sorted([
        (3, near, "b"), (9, other, "d"), (None, "alone without an id", "f"), (4, None, "g"), (5, None, "h"),
        (3, "another text of the same id", "i")], key=repr)


def test_contamination_is_decided_by_row(spark, sf_dir):
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = "a clean text that shares its id with another one " * 3
    rows = [(1, passage, "a"), (1, clean, "b"), (None, passage, "c"), (None, clean, "d"), (2, None, "e")]
    assert rows_left(spark, "decontamination", rows, sf_dir) == sorted(
        [(1, clean, "b"), (None, clean, "d"), (2, None, "e")], key=repr)


def test_run_leaves_nothing_but_its_result(spark, sf_dir, tmp_path):
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    docs = corpus_pipeline.run(spark, sf_dir)
    assert docs.count() > 0
    left = set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before
    assert all(name.startswith("pipeline-packing-") for name in left) and len(left) == 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_edge_rows(spark, sf_dir, edge_docs, empty_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, empty_docs, sf_dir).count() == 0
    out = stage(spark, edge_docs, sf_dir)
    rows = out.collect()
    assert any(r.doc_id is None for r in rows)
    if name != "packing":
        assert out.columns == edge_docs.columns
    assert zlib.crc32(b"") == 0
