"""Lexical search, filter audit and line removal against plain versions and SQL."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from taktspur.llm import filter_audit as fa, lexical
from taktspur.llm.lines import drop_common_lines
from taktspur.llm.queries import ORACLE, QUERIES
from tools.check_oracle import compare


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_filter_audit", "op13_line_dedup"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    assert compare(QUERIES[name](spark, sf_dir), duck.execute(ORACLE[name])).startswith("ok")


# --- search -----------------------------------------------------------------------------

def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def plain_search(docs, items, k):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 75 + (25 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t in plain_terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if missing else i, -s) for r, (s, missing, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def zipf_texts(rng, n, words=400):
    vocabulary = [f"t{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("sizes", [(1 << 21, 1 << 16, 1024, 8), (150, 40, 8, 2), (4000, 200, 16, 10 ** 9)])
def test_search_finds_what_the_full_scoring_finds(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK_POSTINGS", "BLOCK_DOCS", "STRIDE", "SHORT_SHARE"), sizes):
        monkeypatch.setattr(lexical, name, size)
    rng = random.Random(7)
    texts = zipf_texts(rng, 500)
    texts += [texts[3]] * 60 + [texts[9] + " t399"] * 30
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    items = [(f"q{i}", t) for i, t in enumerate(zipf_texts(rng, 12))] + [
        ("copy", texts[3]), ("rare", "t399 t398 T399"), ("none", "zz yy"), ("signs", "?! --")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                         spark.createDataFrame(items, "item_id string, text string"), k=20)
    assert rows_of(got) == plain_search(docs, items, 20)


def test_search_in_several_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 100)
    rng = random.Random(8)
    docs, items = list(enumerate(zipf_texts(rng, 80))), [(i, t) for i, t in enumerate(zipf_texts(rng, 6))]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert rows_of(got) == plain_search(docs, items, 5)


def test_search_of_edge_rows(spark, edge_docs, empty_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    items = [("a", "one TWO two words same"), ("b", None), ("c", ""), (None, "ünï x"), ("a", "one TWO two words same")]
    queries = spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(1))
    got = lexical.search(edge_docs, queries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == plain_search(docs, items, 20)
    assert lexical.search(empty_docs, queries).isEmpty() and lexical.search(edge_docs, queries.limit(0)).isEmpty()
    words = spark.createDataFrame([("k1", "same word"), ("k2", "same")], "doc_id string, text string")
    assert [tuple(r) for r in lexical.search(words, queries.limit(1)).collect()] == [
        (i, r, d, s) for i, r, d, s in lexical.search(words, queries.limit(1)).collect()]


def test_search_in_a_very_long_text(spark):
    docs = [(1, "alpha beta " * 200_000), (2, "alpha"), (3, None)]
    items = [("q", "alpha gamma")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id string, text string"))
    assert rows_of(got) == plain_search(docs, items, 20)


# --- audit ------------------------------------------------------------------------------

def plain_audit(docs, labels):
    first, good, toxic = {}, defaultdict(bool), defaultdict(bool)
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    parts = defaultdict(list)
    for i, text, source in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {c for c, f in {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": re.search("[#$%&*|]", text),
            "E": i is not None and first[text] < i}.items() if f}
        parts[source or ""].append((fails, i is not None and good[i], i is not None and toxic[i]))
    out = []
    for part, rows in parts.items():
        taken, shapley = [], Counter()
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[:step - 1])
                here = [r for r in rows if x in r[0] and not r[0] & before]
                shapley[x] += len(here)
                taken.append((part, "".join(order), step, x, sum(not r[0] & (before | {x}) for r in rows), len(here),
                              sum(x in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {x} for r in rows),
                              sum(r[1] for r in here), sum(r[2] for r in here)))
        out += [(p, o, s, *rest, shapley[x]) for p, o, s, x, *rest in taken]
    return sorted(out)


def test_audit_equals_going_through_all_orders(spark):
    rng = random.Random(3)
    docs = []
    for i in range(160):
        words = [f"w{rng.randrange(rng.choice([20, 4000]))}" for _ in range(rng.choice([10, 150, 260]))]
        text = " ".join(words) + rng.choice(["", " #", " SHOUTING WORDS OF MANY CAPITALS" * 5])
        docs.append((i, text, rng.choice(["a", "b", None])))
    docs += [(200 + i, docs[i % 4][1], rng.choice(["a", "c"])) for i in range(30)]
    docs += [(300, None, "a"), (301, "", None), (None, docs[0][1], "a"), (5, docs[5][1], "b"), (302, "x y " * 90_000, "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 240, 2)] + [(4, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns(
        {n: F.lit("x") for n in ("part", "mask", "good", "id", "t1", "quality", "toxic")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = fa.filter_audit(table, marks)
    assert rows_of(got) == sorted(plain_audit(docs, labels), key=repr)
    assert fa.filter_audit(table.limit(0), marks).isEmpty()
    assert fa.filter_audit(table, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_orders_through_each_edge_add_up():
    for n in range(1, 7):
        forward, backward = fa.path_counts(n)
        assert forward[-1] == backward[0] == math.factorial(n)
        for size in range(n):
            states = [s for s in range(1 << n) if s.bit_count() == size]
            assert sum(forward[s] * backward[s | 1 << f] for s in states for f in range(n)
                       if not s >> f & 1) == math.factorial(n)


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([("p", 1, False, True), ("p", 3, True, False), ("p", 0, True, True)],
                                 "part string, mask int, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): r for r in fa.audit(rows, "XY").collect()}
    assert len(got) == 4 and got["XY", 1].removed == 2 and got["YX", 1].removed == 1
    assert got["XY", 1].shapley == 3 and got["YX", 1].shapley == 1 and got["XY", 2].redundant == 1
    with pytest.raises(ValueError):
        fa.audit(rows, "ABCDEFGH")


# --- lines ------------------------------------------------------------------------------

def plain_lines(docs, chars=40, most=5):
    blanks = " \t\n\x0b\x0c\r"
    split = [(i, (t or "").split("\n")) for i, t in docs]
    count, last = Counter(), {}
    for i, lines in split:
        for key in {lower(x.strip(blanks)) for x in lines}:
            if len(key) >= chars:
                count[key] += 1
                rank = (i is not None, i or 0)
                last[key] = max(last.get(key, rank), rank)
    out = []
    for i, lines in split:
        kept = [x for x in lines if count[lower(x.strip(blanks))] < most
                or last[lower(x.strip(blanks))] == (i is not None, i or 0)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_equal_the_plain_version(spark, edge_docs, empty_docs):
    rng = random.Random(4)
    common = [f"{'a shared line of the site number'} {i} which is long é" for i in range(12)]
    docs = []
    for i in range(80):
        lines = [rng.choice([rng.choice(common), rng.choice(common).upper().replace("É", "é"), "", "short",
                             f"  {rng.choice(common)}\t\r", f"own line {i} {rng.random()} that is long enough to count"])
                 for _ in range(rng.randrange(12))]
        docs.append((i, "\n".join(lines)))
    docs += [(3, docs[3][1]), (None, "\n".join(common)), (None, None), (90, "\n".join([common[0]] * 3 + ["", "x"]))]
    docs += [(None, "only rows without an id hold this line, so all keep it")] * 6
    docs += [(100 + i, "x" * 40) for i in range(5)] + [(200 + i, "y" * 39) for i in range(9)] + [(300 + i, "z" * 44) for i in range(4)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {n: F.lit("x") for n in ("id", "k1", "k2", "lines", "at", "key", "line", "dropped", "last", "n")})
    assert rows_of(drop_common_lines(table)) == plain_lines(docs)
    edge = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert rows_of(drop_common_lines(edge_docs)) == plain_lines(edge)
    assert drop_common_lines(empty_docs).isEmpty()


def test_lines_of_a_very_long_text(spark):
    shared = "the same long footer line in all of the documents"
    long = "\n".join(f"{shared}" if i % 2 else f"line {i} of the long text" for i in range(60_000))
    docs = [(1, long)] + [(i, shared) for i in range(2, 8)]
    got = {r.doc_id: r for r in drop_common_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (got[1].n_lines, got[1].n_dropped) == (60_000, 30_000) and shared not in got[1].kept
    assert got[7].kept == shared and got[2].kept == ""


def test_lines_stay_out_of_python(spark, sf_dir):
    plan = QUERIES["op13_line_dedup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
