"""Near duplicates, contamination and repeated byte strings against plain versions."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from taktspur.llm import graph, near_dup, spans
from taktspur.llm.contamination import contaminated, find_contamination
from taktspur.llm.graph import components
from taktspur.llm.queries import ORACLE, QUERIES


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(words) < 5:
        return frozenset([" ".join(words)] if words else [])
    return frozenset(" ".join(words[i:i + 5]) for i in range(len(words) - 4))


def plain_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is None or rows[j][0] is None or not a or not b:
                continue
            if 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted(((d, len(sets[i]), None if d is None else min(least[find(i)]))
                   for i, (d, _) in enumerate(rows)), key=str)


def near_copies(rng, groups, copies, length):
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(length)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(length)] = f"w{rng.randrange(500)}"
            out.append(" ".join(words))
    return out


def test_components_of_near_copies(spark, edge_docs):
    rng = random.Random(11)
    texts = near_copies(rng, 12, 6, 90) + near_copies(rng, 1, 40, 120) + near_copies(rng, 10, 3, 8)
    # A chain: neighbours are linked, the ends are not.
    base = [f"v{i}" for i in range(100)]
    texts += [" ".join(base[k:k + 60]) for k in range(0, 40, 4)]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs).collect()), key=str)
    assert got == plain_components(rows)


def test_near_duplicates_of_edge_rows(edge_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = near_dup.near_duplicates(edge_docs)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == plain_components(rows)
    assert got.where("doc_id is null").first().kept
    assert near_dup.near_duplicates(empty_docs).count() == 0


def test_sketches_screen_only_far_pairs():
    rng = np.random.default_rng(1)
    most = near_dup.most_differing_bits(0.5)
    for share, low, high in ((0.75, 0.999, 1), (0.2, 0, 0.05)):
        passed = []
        for _ in range(300):
            common = int(400 * share)
            both = rng.integers(1, 1 << 62, common).astype(np.uint64)
            own = rng.integers(1, 1 << 62, (2, (400 - common) // 2)).astype(np.uint64)
            a, b = (near_dup.odd_sketch(near_dup.min_hashes(np.concatenate([both, o]))) for o in own)
            passed.append(sum(bin(int(x) & (2**64 - 1)).count("1") for x in a ^ b) <= most)
        assert low <= np.mean(passed) <= high


def test_stars_find_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(250)]
    pairs += [(1_000, k) for k in range(1_001, 1_050)] + [(7, 7), (0, 1)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(i, find(i)) for i in root if find(i) != i}
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == want and len(got) == len(want)


def test_no_round_after_the_last_star(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "stored", lambda df, name, f=graph.stored: written.append(name) or f(df, name))
    stars = [(10, 1), (1, 11), (12, 1), (12, 1), (20, 2), (3, 3)]
    found = components(spark.createDataFrame(stars, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == [(10, 1), (11, 1), (12, 1), (20, 2)]
    assert len(written) == 1
    path = components(spark.createDataFrame([(3, 2), (2, 1), (4, 3)], "a long, b long")).collect()
    assert sorted(map(tuple, path)) == [(2, 1), (3, 1), (4, 1)]


def test_block_pairs_against_plain_pairs():
    rng = np.random.default_rng(3)
    base, rows = rng.integers(0, 2**63, 200, np.uint64), []
    for cid in range(40):
        own = rng.integers(0, 2**63, 200, np.uint64)
        h = np.unique(np.where(rng.random(200) < 0.1, own, base))
        least = near_dup.min_hashes(h, near_dup.SHARP_SAMPLES)
        rows.append({"cid": cid * 7919 % 40, "root": int(rng.integers(0, 4)), "main": 0, "n": len(h),
                     "common": len(h) - int(rng.integers(0, 60)), "sharp": near_dup.odd_sketch(least, near_dup.SHARP_BITS),
                     "sketch": near_dup.odd_sketch(near_dup.min_hashes(h)), "bands": near_dup.band_keys(near_dup.min_hashes(h))})
    apart = lambda x, y: sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y)
    most, sharp = near_dup.most_differing_bits(0.5), near_dup.most_differing_bits(0.675, near_dup.SHARP_SAMPLES, near_dup.SHARP_BITS)
    whole, got = set(), []
    for band in range(near_dup.BANDS):
        for key in {int(r["bands"][band]) for r in rows}:
            members = [r for r in rows if r["bands"][band] == key]
            outside = [r for r in members if r["root"] != 0]
            for x in outside:
                for y in members:
                    both = min(x["common"], y["common"])
                    if (x["root"] != y["root"] and 100 * both >= 75 * (x["n"] + y["n"] - both)
                            and apart(x["sketch"], y["sketch"]) <= most and apart(x["sharp"], y["sharp"]) <= sharp):
                        whole.add((x["cid"], y["cid"]) if y["root"] == 0 else tuple(sorted((x["cid"], y["cid"]))))
            table = near_dup.pa.Table.from_pylist
            for x in (outside[::2], outside[1::2]):
                for y in (members[:5], members[5:]):
                    if x and y:
                        found = near_dup.block_pairs(key, table(x), table(y), 75, most, sharp)
                        got += zip(found["a"].to_pylist(), found["b"].to_pylist())
    assert len(whole) > 20 and len(got) == len(set(got)) and set(got) == whole
    one = table(rows[:1])
    assert near_dup.block_pairs(int(rows[0]["bands"][0]), one, one.slice(1), 75, most, sharp).num_rows == 0


def test_third_round_compares_by_blocks(spark, monkeypatch):
    # Copies near the threshold: many share buckets without a link, so they are left to the third round.
    rng, rows = random.Random(11), []
    base = [f"w{k}" for k in range(300)]
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(300), 6 + k % 7):
            words[at] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(near_dup, "PAIR_BLOCK", 4)
    monkeypatch.setattr(near_dup, "PAIRS_AT_ONCE", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(docs)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == plain_components(rows)


def plain_hits(text, items, size=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    words, hit, found = find(text), set(), set()
    for item, other in items:
        w = find(other)
        n = min(len(w), size)
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i:i + n]) in windows:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_contamination_of_edge_rows(spark, edge_docs, empty_docs):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    items = [(10, text), (9, text.upper()), (9, "zero " + text), (None, "same word the same"), (3, "b"), (4, None),
             (5, ""), (6, "the same word " * 8), (7, "two three four five six"), (8, "row without an id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = sorted(((r.doc_id, *plain_hits(r.text, items)) for r in edge_docs.collect()), key=str)
    found = find_contamination(edge_docs, bench)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()), key=str) == rows
    flags = found.withColumn("c", contaminated(found)).collect()
    assert all(r.c == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in flags)
    assert find_contamination(edge_docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert find_contamination(empty_docs, bench).count() == 0


def plain_removal(rows, size):
    least = {}
    for d, t in rows:
        body = (t or "").encode()
        if d is not None:
            for p in range(len(body) - size + 1):
                s = body[p:p + size]
                least[s] = min(least.get(s, d), d)
    out = []
    for d, t in rows:
        body, gone = (t or "").encode(), set()
        if d is not None:
            for p in range(len(body) - size + 1):
                if least[body[p:p + size]] < d:
                    gone.update(range(p, p + size))
        out.append((d, len(body), bytes(b for i, b in enumerate(body) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, 1_000])
@pytest.mark.parametrize("size", [50, 12])
def test_removal_of_repeats(spark, edge_docs, size, hot):
    rng = random.Random(size)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(40, 200))) for _ in range(6)]
    rows = [(r.doc_id, r.text[:400] if r.text else r.text) for r in edge_docs.collect()]
    for i in range(60):
        parts = [rng.choice(passages)[rng.randrange(20):] if rng.random() < 0.6
                 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(80))) for _ in range(4)]
        rows.append((1_000 - i, "".join(parts)))
    rows += [(2_000, rows[-1][1]), (2_000, rows[-2][1]), (2_001, "ab" * 300), (2_002, "ab" * 200 + "c" + "ab" * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spans.remove_repeats(docs, window=size, block_bytes=2_000, hot_blocks=hot).collect()
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got), key=str) == plain_removal(rows, size)
    for r in got:
        ends = [x for s in r.spans for x in (s.start, s.end)]
        assert ends == sorted(set(ends))


def test_suffixes_come_out_sorted():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(0, 30, 12)
        data = rng.integers(97, 100, lengths.sum()).astype(np.uint8)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        places, same = spans.sorted_suffixes(data, offsets, 4)
        string = np.searchsorted(offsets, places, "right") - 1
        got = [bytes(data[p:offsets[s + 1]]) for p, s in zip(places, string)]
        assert got == sorted(got)
        assert len(got) == sum(max(0, n - 3) for n in lengths)
        assert [bool(x) for x in same] == [i > 0 and got[i][:4] == got[i - 1][:4] for i in range(len(got))]


def test_suffixes_with_letters_of_every_width():
    rng = np.random.default_rng(3)
    cases = [(rng.integers(0, 200, 1_500 * 60), 60, 50),  # more than 65,534 letters of four bytes
             (rng.integers(0, 256, 160_000), 80, 50),  # nearly all letters of two bytes, and the byte 255
             (np.arange(256**2) >> 8 * (1 - np.arange(2)[:, None]) & 255, 2, 2),  # all letters of two bytes
             (rng.integers(0, 2, 3_000), 10, 1), (rng.integers(0, 2, 3_000), 10, 3)]
    for data, size, window in cases:
        data = np.asarray(data, np.uint8).T.ravel()
        offsets = np.arange(0, len(data) + 1, size)
        places, same = spans.sorted_suffixes(data, offsets, window)
        raw = data.tobytes()
        got = [raw[p:p - p % size + size] for p in places.tolist()]
        assert got == sorted(got) and len(set(places.tolist())) == len(data) // size * (size - window + 1)
        assert same.tolist() == [i > 0 and got[i][:window] == got[i - 1][:window] for i in range(len(got))]


def test_suffix_sorting_counts_few_letters_per_byte(monkeypatch):
    rng = np.random.default_rng(4)
    data, rows, argsort = rng.integers(97, 123, 500 * 75).astype(np.uint8), [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *args, **more: (rows.append(len(a)), argsort(a, *args, **more))[1])
    spans.sorted_suffixes(data, np.arange(0, len(data) + 1, 75), 50)
    assert sum(rows) < 16 * len(data)  # a round a byte took 40


def passage_rows(seed, n):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdefghé \n") for _ in range(150)) for _ in range(20)]
    return [(i, "".join(rng.choice(passages)[rng.randrange(60):rng.randrange(90, 150)] for _ in range(6))
             + "".join(rng.choice("abcdefgh ") for _ in range(300))) for i in range(n)]


def test_buckets_of_anchors_are_even():
    rows = passage_rows(5, 300)
    table = pa.table({"id": [i for i, _ in rows], "text": [t for _, t in rows]})
    found = spans.anchors_of_block(table, 50, 4, 0)
    sizes = [len(a) // 6 for a in found["anchors"].to_pylist()]
    assert len(sizes) == 16 and max(sizes) < 1.5 * sum(sizes) / 16


@pytest.mark.parametrize("most", [1, 2_000, 1 << 17])
def test_sorting_by_runs_of_anchors(monkeypatch, most):
    monkeypatch.setattr(spans, "SORT_BYTES", most)
    sorted_suffixes, calls = spans.sorted_suffixes, []
    monkeypatch.setattr(spans, "sorted_suffixes", lambda d, *args: (calls.append(len(d)), sorted_suffixes(d, *args))[1])
    rows, bits = passage_rows(6, 120), 2
    blocks = [pa.table({"id": [i for i, _ in rows[k::3]], "text": [t for _, t in rows[k::3]]}) for k in range(3)]

    def by(table, key, value):
        return table.filter(pc.equal(table[key], value))

    met = pa.concat_tables(spans.anchors_of_block(t, 50, bits, k) for k, t in enumerate(blocks))
    met = pa.concat_tables(spans.shared_anchors(by(met, "b", b), bits, 1_000) for b in range(4))
    sent = pa.concat_tables(spans.stretches_of_block(t, by(met, "g", k), 50, bits, k) for k, t in enumerate(blocks))
    answers = pa.concat_tables(spans.least_ids(by(sent, "b", b), 50) for b in range(4))
    got = [r for k, t in enumerate(blocks)
           for r in spans.removed_in_block(t, by(answers, "g", k), 50, pa.int64()).to_pylist()]
    assert sorted(((r["id"], r["n_bytes"], r["kept"]) for r in got), key=str) == plain_removal(rows, 50)
    assert sum(r["n_bytes"] - len(r["kept"]) for r in got) > 10_000
    assert (len(calls) > 4) == (most < 1 << 17) and max(calls) < 50_000 + most


def test_removal_of_an_empty_table(empty_docs):
    assert spans.remove_repeats(empty_docs).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want = con.execute(ORACLE[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_contaminated_text_takes_time_in_proportion(spark):
    import time
    item = " ".join(f"word{i}" for i in range(40))
    times = []
    for n in (500, 500, 2_000, 8_000):
        docs = spark.createDataFrame([(1, f"{item} " * n), (2, "clean text " * 30)], "doc_id long, text string")
        start = time.perf_counter()
        got = {r.doc_id: r for r in find_contamination(docs, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()}
        times.append(time.perf_counter() - start)
        assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (40 * n, 40 * n, ["a"]) and got[2].n_hit == 0
    # Sixteen times the words of the second run.
    assert times[3] < 16 * times[1] + 5
