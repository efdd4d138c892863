"""Near duplicates: banded MinHash proposes pairs, odd sketches screen them, full sets confirm them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import (BASE, ascii_lower, byte_slices, mix, prefix_hash, span_hash, stored,
                     word_spans)
from .graph import components

SHINGLE = 5
#: 42 bands of 3: a pair at similarity 0.75 is missed with probability (1 - 0.75**3)**42 = 1e-10.
BANDS, ROWS = 42, 3
#: Samples and bits of the sketches of all classes, and of the sharper ones of the last round. An estimate
#: at 0.75 has a deviation of 0.039 or 0.0135; pairs estimated to lie further below the threshold
#: than the margin, five and a half to six deviations, are let go.
SAMPLES, SKETCH_BITS, MARGIN = BANDS * ROWS, 512, 0.25
SHARP_SAMPLES, SHARP_BITS, SHARP_MARGIN = 1024, 4096, 0.075
BLOCK = 2048
#: Classes with which a class is compared in each of the first two rounds; the third has no such bound.
LEADS = 3
#: The third round compares the classes of a bucket by blocks of about so many, so many pairs at once.
PAIR_BLOCK, PAIRS_AT_ONCE = 2048, 1 << 20


def text_sets(column: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles (five words, or all if fewer)."""
    out = []
    for _, _, data, offsets in byte_slices(column):
        data = ascii_lower(data)
        starts, ends, first = word_spans(data, offsets)
        words = mix(span_hash(prefix_hash(data), starts, ends))
        joined = words.copy()
        for _ in range(SHINGLE - 1):
            # After k rounds an entry holds the words from it to k further on.
            joined = joined[:-1] * BASE + words[len(words) - len(joined) + 1:] if len(joined) else joined
        joined = mix(joined)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= SHINGLE:
                h = np.sort(joined[a:b - SHINGLE + 1])
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                out.append(h[new])
            elif b > a:
                # Fewer words: one shingle of all, told apart from others by their number.
                h = np.array([b - a], np.uint64)
                for k in range(a, b):
                    h = h * BASE + words[k]
                out.append(mix(h))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_number(hashes: np.ndarray) -> int:
    """64-bit name of a set; texts with the same set share it."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def min_hashes(hashes: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    odd = mix(np.arange(1, samples + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(samples, np.iinfo(np.uint64).max, np.uint64)
    block = max(1, BLOCK * SAMPLES // samples)
    for k in range(0, len(hashes), block):
        np.minimum(least, (hashes[k:k + block, None] * odd).min(0), out=least)
    return mix(least)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[:BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = key * BASE + rows[:, k]
    return mix(key).view(np.int64)


def odd_sketch(least: np.ndarray, size: int = SKETCH_BITS) -> np.ndarray:
    """Parity bits: sample i flips the bit chosen by its number and its minimum."""
    at = mix(least + np.arange(len(least), dtype=np.uint64) * BASE) % np.uint64(size)
    bits = (np.bincount(at.astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def most_differing_bits(similarity: float, samples: int = SAMPLES, size: int = SKETCH_BITS) -> int:
    """Expected differing sketch bits at a similarity: a pair with more is below it."""
    differing = 2 * samples * (1 - similarity)
    return int(np.ceil(size / 2 * (1 - (1 - 2 / size) ** differing)))


def signature_column(text: Column) -> Column:
    @F.arrow_udf("n long, cid long, bands array<long>, sketch array<long>")
    def signatures(texts: pa.Array) -> pa.Array:
        sets = text_sets(texts)
        known: dict[int, tuple] = {}
        n, cid, bands, sketch = [], [], [], []
        for h in sets:
            n.append(len(h))
            if not len(h):
                row = (None, None, None)
            else:
                number = set_number(h)
                row = known.get(number)
                if row is None:
                    least = min_hashes(h)
                    row = known[number] = (number, band_keys(least), odd_sketch(least))
            for c, v in zip((cid, bands, sketch), row):
                c.append(v)
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
             pa.array(sketch, pa.list_(pa.int64()))], ["n", "cid", "bands", "sketch"])
    return signatures(text)


def set_column(text: Column) -> Column:
    @F.arrow_udf("own long, hashes array<long>")
    def sets(texts: pa.Array) -> pa.Array:
        rows = text_sets(texts)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays(
            [pa.array([set_number(r) if len(r) else None for r in rows], pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["own", "hashes"])
    return sets(text)


def sharp_sketch_column(hashes: Column) -> Column:
    @F.arrow_udf("array<long>")
    def sketches(sets: pa.Array) -> pa.Array:
        rows = (np.array(s, np.int64).view(np.uint64) for s in sets.to_pylist())
        return pa.array([odd_sketch(min_hashes(h, SHARP_SAMPLES), SHARP_BITS) for h in rows],
                        pa.list_(pa.int64()))
    return sketches(hashes)


def _sketches_near(a: str, b: str, most: int) -> Column:
    bits = " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(SKETCH_BITS // 64))
    return F.expr(f"{bits} <= {most}")


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of arrays of one length as rows of 64-bit words."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.view(np.uint64).reshape(len(column), -1)


def _bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def block_pairs(key: int, x: pa.Table, y: pa.Table, percent: int, most: int, most_sharp: int) -> pa.Table:
    """Pairs (a, b) of rows of two blocks of the bucket ``key`` that may reach the threshold.

    Left out are pairs of one component, pairs that meet the other way round too, pairs below the bound
    by sizes and common shingles or far by their sketches, and pairs that share an earlier band.
    """
    (a, p, n1, c1), (b, q, n2, c2) = ([t[c].to_numpy() for c in ("cid", "root", "n", "common")] for t in (x, y))
    first = (q == y["main"].to_numpy()) if len(y) else np.zeros(0, bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(x) and len(y):
        x_sketch, y_sketch = _words(x["sketch"]), np.ascontiguousarray(_words(y["sketch"]).T)
        x_bands, y_bands = _words(x["bands"]), _words(y["bands"])
        x_sharp, y_sharp = _words(x["sharp"]), _words(y["sharp"])
        band = int(np.flatnonzero(x_bands[0].view(np.int64) == key)[0])
        step = max(1, PAIRS_AT_ONCE // len(y))
        for low in range(0, len(x), step):
            at = slice(low, low + step)
            apart = np.zeros((len(a[at]), len(y)), np.uint16)
            for k, words in enumerate(y_sketch):
                apart += np.bitwise_count(x_sketch[at, k, None] ^ words)
            shared = np.minimum(c1[at, None], c2)
            i, j = np.nonzero((apart <= most) & (p[at, None] != q) & (first | (a[at, None] < b))
                              & (100 * shared >= percent * (n1[at, None] + n2 - shared)))
            i += low
            for k in range(band):
                new = x_bands[i, k] != y_bands[j, k]
                i, j = i[new], j[new]
            for k in range(0, len(i), BLOCK):
                one, other = i[k:k + BLOCK], j[k:k + BLOCK]
                near = _bits_apart(x_sharp[one], y_sharp[other]) <= most_sharp
                found.append((a[one[near]], b[other[near]]))
    return pa.table({c: np.concatenate([np.zeros(0, np.int64), *f])
                     for c, f in zip(("a", "b"), list(zip(*found)) or [(), ()])})


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets overlap enough; similarity as intersection over union."""
    both = (pairs.join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("x")), "a")
            .join(sets.select(F.col("cid").alias("b"), F.col("hashes").alias("y")), "b")
            .withColumn("shared", F.expr("size(array_intersect(x, y))")))
    return both.where(f"100 * shared >= {percent} * (size(x) + size(y) - shared)").select("a", "b")


def _united(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(cid, root) after the links (a, b) have joined the components of ``roots``."""
    return _joined(roots, links.join(roots.toDF("a", "p"), "a").join(roots.toDF("b", "q"), "b")
                   .select(F.col("p").alias("a"), F.col("q").alias("b")))


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(cid, root) after the links (a, b) between roots."""
    return stored(roots.join(components(edges).toDF("root", "top"), "root", "left")
                  .select("cid", F.coalesce("top", "root").alias("root")), "roots")


def _several_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the buckets with several components: key, cid, root, main (the largest component there),
    classes in all and those outside main."""
    rooted = members.select("key", "cid").join(roots, "cid")
    keys = (rooted.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key")
            .agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("size").alias("all"),
                 (F.sum("size") - F.max("size")).alias("outside"))
            .where("outside > 0"))
    return rooted.join(keys, "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = 75) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reached over links), kept.

    Texts with equal shingle sets form one class, so copies are one node. Classes that share a band
    meet in a bucket. A pair goes on to its full sets unless its odd sketches differ in more bits
    than expected at a similarity well below the threshold. Buckets
    are worked off in three rounds, each only where a bucket still holds several components:

    1. Each class is compared with the smallest classes of its buckets, the three of them with
       which it shares most buckets.
    2. The same with the most central classes: of all shingles of classes in such buckets
       those that occur in one class alone cannot be shared, and the class of a bucket with
       the smallest part of them is nearest to all others.
    3. Each class outside the bucket's largest component is compared with the classes of other
       components, as far as the shingles that either could share at all reach the threshold. That
       bound is exact, so no link between components is left out. Large buckets go in pairs of
       blocks, dealt over all tasks.

    So a bucket of thousands of near copies costs a few comparisons a class. Only classes that
    stay near the threshold without reaching it are compared with many others.

    A very long text is one set, worked out whole. Texts without words (null too) have an empty set and link with nothing. Rows with a null id
    link with nothing either, get a null component and are kept. Rows of one id share their
    component if their texts do; ties go to the smaller id. Other columns are neither read nor
    returned. An empty table gives an empty table.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stored(texts.select("id", signature_column(F.col("text")).alias("s")).select("id", "s.*"),
                    "signatures")
    classes = stored(
        signed.where("cid is not null and id is not null").groupBy("cid")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"),
             F.first("sketch").alias("sketch")), "classes")
    most = most_differing_bits(percent / 100 - MARGIN)

    rows = classes.select("cid", F.explode("bands").alias("key"))
    buckets = (rows.groupBy("key").agg(F.min("cid").alias("lead"), F.max("cid").alias("last"))
               .where("lead <> last").drop("last"))
    members = stored(rows.join(buckets, "key"), "members")

    # Full sets of the classes that meet another one, from the texts of their smallest ids.
    met = members.select("cid").distinct()
    needed = met.join(classes.select("cid", "rep"), "cid")
    sets = stored(
        texts.join(needed, F.col("id") == F.col("rep")).select("cid", set_column(F.col("text")).alias("s"))
        .select("cid", "s.*").where("cid = own").select("cid", "hashes").dropDuplicates(["cid"]), "sets")
    sketches = classes.select("cid", "sketch")

    def linked(pairs: DataFrame) -> DataFrame:
        order = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
        first = (pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
                 .withColumn("nth", F.row_number().over(order)).where(f"nth <= {LEADS}").select("a", "b"))
        near = (first.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b")
                .where(_sketches_near("x", "y", most)).select("a", "b"))
        return _confirmed(near, sets, percent)

    stars = members.where("cid <> lead").select(F.col("cid").alias("a"), F.col("lead").alias("b"))
    # At first every class with a set is its own root, and links are links between roots.
    roots = _joined(sets.select("cid", F.col("cid").alias("root")), linked(stars))

    open_rows = _several_roots(members, roots)
    alone = (sets.join(open_rows.select("cid").distinct(), "cid").select("cid", F.explode("hashes").alias("t"))
             .groupBy("t").agg(F.count("*").alias("k"), F.min("cid").alias("cid")).where("k = 1")
             .groupBy("cid").agg(F.count("*").alias("alone")))
    # ``common``: shingles that another class of these buckets has too.
    able = (open_rows.select("cid").distinct().join(classes.select("cid", "n"), "cid").join(alone, "cid", "left")
            .select("cid", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
            .where(f"100 * common >= {percent} * n"))
    open_rows = stored(open_rows.select("key", "cid", "root").join(able, "cid"), "open")
    central = open_rows.groupBy("key").agg(
        F.max_by(F.struct("cid", "root"), F.struct(F.col("common") / F.col("n"), "n", "cid")).alias("lead"))
    stars = (open_rows.select("key", "cid", "root").join(central, "key").where("root <> lead.root")
             .select(F.col("cid").alias("a"), F.col("lead.cid").alias("b")))
    roots = _united(roots, linked(stars))

    left = stored(_several_roots(open_rows, roots).join(open_rows.select("key", "cid", "n", "common"), ["key", "cid"]),
                  "left")
    sharp = stored(left.select("cid").distinct().join(sets, "cid")
                   .select("cid", sharp_sketch_column(F.col("hashes")).alias("sharp"))
                   .join(classes.select("cid", "sketch", "bands"), "cid"), "sharp")
    most_sharp = most_differing_bits(percent / 100 - SHARP_MARGIN, SHARP_SAMPLES, SHARP_BITS)

    def near(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        return block_pairs(key[0].as_py(), x, y, percent, most, most_sharp)

    # Block i of the classes outside the largest component meets block j of all of the bucket.
    left = (left.join(sharp, "cid").withColumn("i", F.expr(f"ceil(outside / {PAIR_BLOCK})"))
            .withColumn("j", F.expr(f"ceil(all / {PAIR_BLOCK})")))
    own = {k: F.expr(f"pmod(xxhash64(cid), {k})") for k in "ij"}
    each = {k: F.explode(F.expr(f"sequence(0L, {k} - 1)")) for k in "ij"}
    meet = ("key", "i", "j")
    pairs = (left.where("root <> main").withColumn("i", own["i"]).withColumn("j", each["j"]).groupBy(*meet)
             .cogroup(left.toDF(*left.columns).withColumn("j", own["j"]).withColumn("i", each["i"]).groupBy(*meet))
             .applyInArrow(near, "a long, b long"))
    roots = _united(roots, _confirmed(pairs, sets, percent))

    final = (classes.select("cid", "rep").join(roots, "cid", "left")
             .select("cid", "rep", F.coalesce("root", "cid").alias("root")))
    smallest = final.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = final.join(smallest, "root").select("cid", "component_id")
    return (signed.select("id", "n", "cid").join(named, "cid", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))
