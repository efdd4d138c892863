"""Repeated byte strings: documents lose what a document with a smaller id already has.

Blocks of documents send the anchors of their windows to meet in buckets; the stretches around
shared anchors are then sorted there by a column-wise Burrows-Wheeler construction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_slices, mix, prefix_hash, span_hash, with_small_batches

WINDOW = 50
GRAM = 20
#: Text bytes of a block, and of all texts for each bucket.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
LEAST_BUCKET_BITS = 6
#: A stretch holds at most so many windows, so the construction has a fixed number of rounds.
STRETCH_WINDOWS = 32
#: A bucket sorts whole anchors together up to so many bytes, which stay near the processor.
SORT_BYTES = 1 << 17
#: Anchors found in more blocks are looked at window by window, spread over all buckets.
HOT_BLOCKS = 1024
LENGTH_MIX = np.uint64(0xA24BAED4963EE407)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    if have < width:
        rest = width - have
        values = np.minimum(values[:-rest], values[rest:])
    return values


def stretches(texts: pa.Array, window: int):
    """Per slice: (first row, bytes, prefix hashes, row, first window, windows, anchor) of all stretches.

    The anchor of a window is the least hash of the grams in it, so equal windows have equal anchors. It is
    hashed again, since least values crowd at the lower end and buckets go by leading bits. A stretch is a
    run of windows of one text with one anchor, cut after 32 windows.
    """
    gram = min(GRAM, window)
    for low, _, data, offsets in byte_slices(texts):
        n = len(data)
        if n < window:
            continue
        sums = prefix_hash(data)
        grams = span_hash(sums, slice(0, n - gram + 1), slice(gram, n + 1))
        least = sliding_least(mix(grams), window - gram + 1)
        inside = np.zeros(n - window + 2, bool)
        for a, b in zip(offsets[:-1], offsets[1:]):
            if b - a >= window:
                inside[a:b - window + 1] = True
        new = inside.copy()
        new[1:-1] &= ~inside[:-2] | (least[1:] != least[:-1])
        firsts = offsets[:-1][np.diff(offsets) >= window]
        new[firsts] = True
        starts = np.flatnonzero(new)
        if not len(starts):
            continue
        breaks = np.flatnonzero(~inside)
        stops = np.minimum(np.append(starts[1:], n), breaks[np.searchsorted(breaks, starts)])
        count = stops - starts
        parts = -(-count // STRETCH_WINDOWS)
        head = np.repeat(starts, parts)
        step = np.arange(len(head)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = head + step * STRETCH_WINDOWS
        size = np.minimum(np.repeat(stops, parts) - first, STRETCH_WINDOWS)
        row = np.searchsorted(offsets, first, "right") - 1
        yield low, data, sums, offsets, row, first, size, mix(least[head])


def content_hash(sums: np.ndarray, first: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    length = (size + window - 1).astype(np.uint64)
    return mix(span_hash(sums, first, first + size + window - 1) ^ (length * LENGTH_MIX))


def cut_value(values: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits that travel: those of the bucket and 48 more. Chance equals cost work, not errors."""
    shift = np.uint64(max(0, 16 - bits))
    return values >> shift << shift


def _packed(values: np.ndarray, bits: int) -> bytes:
    """The 48 bits after those of the bucket, six bytes each."""
    rest = (values << np.uint64(bits)) >> np.uint64(16)
    return np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes, bucket: int, bits: int) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    eight = np.zeros((len(six), 8), np.uint8)
    eight[:, :6] = six
    rest = eight.view("<u8").ravel()
    return (rest << np.uint64(16) >> np.uint64(bits)) | np.uint64(bucket << (64 - bits))


def _buckets(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int32)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _cut_rows(bucket: np.ndarray):
    """(bucket, first, last) of the runs of a sorted array."""
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    return zip(bucket[edges].tolist(), edges.tolist(), np.append(edges[1:], len(bucket)).tolist())


def anchors_of_block(table: pa.Table, window: int, bits: int, block: int) -> pa.Table:
    """Rows (b, g, anchors, several): the distinct anchors of the block, and which lie in several of its ids."""
    ids = _column(table, "id").to_numpy()
    value, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, _, _, _, row, _, _, anchor in stretches(_column(table, "text"), window):
        value.append(cut_value(anchor, bits))
        owner.append(ids[low + row])
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.lexsort((owner, value))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    edges = np.flatnonzero(new)
    several = owner[edges] != owner[np.append(edges[1:], len(value)) - 1] if len(edges) else new
    value = value[edges]
    rows = [(b, block, _packed(value[i:j], bits), np.packbits(several[i:j]).tobytes())
            for b, i, j in _cut_rows(_buckets(value, bits))]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(
        (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["b", "g", "anchors", "several"])


def shared_anchors(table: pa.Table, bits: int, hot_blocks: int) -> pa.Table:
    """Rows (g, b, anchors, hot): for each block its anchors that lie in several ids."""
    bucket = table.column("b")[0].as_py() if table.num_rows else 0
    blocks, lists = table.column("g").to_pylist(), []
    flags = []
    for data, several in zip(table.column("anchors").to_pylist(), table.column("several").to_pylist()):
        lists.append(_unpacked(data, bucket, bits))
        flags.append(np.unpackbits(np.frombuffer(several, np.uint8), count=len(lists[-1])).astype(bool))
    values, group = np.unique(np.concatenate(lists), return_inverse=True)
    seen = np.bincount(group, minlength=len(values))
    shared = (seen > 1) | (np.bincount(group, np.concatenate(flags), len(values)) > 0)
    out, at = [], 0
    for g, own in zip(blocks, lists):
        mine = group[at:at + len(own)]
        at += len(own)
        keep = shared[mine]
        if keep.any():
            out.append((g, bucket, _packed(own[keep], bits),
                        np.packbits(seen[mine[keep]] > hot_blocks).tobytes()))
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(
        (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["g", "b", "anchors", "hot"])


def _blob(*arrays: np.ndarray) -> bytes:
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    # Level 3 takes a tenth less room than pyarrow's default of 1, in the same time.
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(body, asbytes=True)


def _unblob(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 ... for all runs, one after another."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def stretches_of_block(table: pa.Table, reply: pa.Table, window: int, bits: int, block: int) -> pa.Table:
    """Rows (b, g, n, entries): the distinct stretches with shared anchors, with least and largest id."""
    shared, hot = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for b, data, flags in zip(*(reply.column(c).to_pylist() for c in ("b", "anchors", "hot"))):
        shared.append(_unpacked(data, b, bits))
        hot.append(np.unpackbits(np.frombuffer(flags, np.uint8), count=len(shared[-1])).astype(bool))
    shared, hot = np.concatenate(shared), np.concatenate(hot)
    order = np.argsort(shared)
    shared, hot = shared[order], hot[order]
    kinds = ("anchor", "content", "low", "high", "length", "spread")
    parts: dict[str, list] = {k: [] for k in kinds}
    bodies: dict[int, bytes] = {}
    ids = _column(table, "id").to_numpy()
    for low, data, sums, _, row, first, size, anchor in stretches(_column(table, "text"), window):
        if not len(shared):
            break
        value = cut_value(anchor, bits)
        at = np.minimum(np.searchsorted(shared, value), len(shared) - 1)
        met = shared[at] == value
        alone = met & hot[at]
        met &= ~alone
        first = np.concatenate([first[met], _spread(first[alone], size[alone])])
        owner = ids[low + np.concatenate([row[met], np.repeat(row[alone], size[alone])])]
        anchor = np.concatenate([anchor[met], np.repeat(anchor[alone], size[alone])])
        spread = np.arange(len(first)) >= met.sum()
        size = np.concatenate([size[met], np.ones(int(size[alone].sum()), size.dtype)])
        content = content_hash(sums, first, size, window)
        order = np.lexsort((owner, content))
        first, owner, anchor, size, content, spread = (
            x[order] for x in (first, owner, anchor, size, content, spread))
        edges = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]])[:len(content)])
        last = np.append(edges[1:], len(content)) - 1
        raw = data.tobytes()
        for c, s, n in zip(content[edges].tolist(), first[edges].tolist(), size[edges].tolist()):
            if c not in bodies:
                bodies[c] = raw[s:s + n + window - 1]
        for k, v in zip(kinds, (anchor[edges], content[edges], owner[edges], owner[last],
                                (size + window - 1)[edges], spread[edges])):
            parts[k].append(v)
    rows = []
    if parts["anchor"]:
        anchor, content, least, largest, length, spread = (np.concatenate(parts[k]) for k in kinds)
        target = np.where(spread, mix(content), anchor)
        order = np.lexsort((content, target))
        anchor, content, least, largest, length, spread, target = (
            x[order] for x in (anchor, content, least, largest, length, spread, target))
        edges = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]]))
        least, largest = np.minimum.reduceat(least, edges), np.maximum.reduceat(largest, edges)
        anchor, content, length, spread, target = (x[edges] for x in (anchor, content, length, spread, target))
        for b, i, j in _cut_rows(_buckets(target, bits)):
            text = b"".join(map(bodies.__getitem__, content[i:j].tolist()))
            rows.append((b, block, j - i, _blob(
                anchor[i:j], content[i:j], least[i:j], largest[i:j], length[i:j].astype(np.uint32),
                spread[i:j], np.frombuffer(text, np.uint8))))
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(
        (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["b", "g", "n", "entries"])


def _letters(data: np.ndarray, starts: np.ndarray, wide: int) -> np.ndarray:
    """``wide`` bytes from each place as one number, in their order."""
    grams = np.zeros(len(starts), np.uint32)
    for k in range(wide):
        grams = grams << np.uint32(8) | data[starts + k]
    return grams


def sorted_suffixes(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, same): suffixes of at least ``window`` bytes in order, and whether each agrees with the
    one before it in its first ``window`` bytes.

    Column-wise construction over the whole collection, with letters of four bytes (fewer, if more than
    65,534 different ones occur): round 0 sorts the suffixes shorter than a letter, and each round
    puts those that are one letter longer than the last ones among those of the rounds before. The
    transform holds the letter in front of each suffix; a stable count of its letters gives the place of every
    suffix that starts with one of them, so no two suffixes are ever compared. Common prefixes are read off
    neighbours at the end.
    """
    n, length = len(offsets) - 1, np.diff(offsets)
    # A byte between strings, so that the empty suffix of each has a place of its own.
    place = np.int32 if len(data) + n < 2**31 else np.int64
    string = np.repeat(np.arange(n, dtype=place), length + 1)
    last = (offsets[1:] + np.arange(n)).astype(place)
    left = last[string] - np.arange(len(string), dtype=place)
    text = np.zeros(len(string) + 4, np.uint8)
    text[:len(string)][left > 0] = data
    for wide in (4, 2, 1):
        whole = np.flatnonzero(left >= wide)
        grams, number = np.unique(_letters(text, whole, wide), return_inverse=True)
        if wide == 1 or wide <= window and len(grams) < 2**16 - 1:
            break
    # Letters are numbered from 1; 0 stands where a string has less than a letter left, and its suffix is not extended.
    ahead = np.zeros(len(string), np.uint16)
    ahead[whole + wide] = number + 1

    where = np.flatnonzero(left < wide)
    short = _letters(text, where, wide).astype(np.int64)
    hidden = 8 * (wide - left[where])
    short = short >> hidden << hidden
    order = np.lexsort((left[where], short))
    where, short = where[order].astype(place), short[order]
    # Short suffixes before all suffixes that start with a letter.
    below = np.concatenate([[0], np.searchsorted(short, grams, "right")])
    front, fresh = ahead[where], np.ones(len(where), bool)
    while True:
        order = np.argsort(front, kind="stable")
        ended = len(front) - np.count_nonzero(front)
        rank = np.flatnonzero(fresh[order])
        rank = rank[np.searchsorted(rank, ended):]
        if not len(rank):
            break
        source = order[rank]
        places = rank - ended + below[front[source]]
        start = where[source] - place(wide)
        fresh = np.zeros(len(front) + len(places), bool)
        fresh[places] = True
        older = ~fresh
        grown, moved = np.empty(len(fresh), front.dtype), np.empty(len(fresh), place)
        grown[places], grown[older] = ahead[start], front
        moved[places], moved[older] = start, where
        front, where = grown, moved
    where = where[left[where] >= window].astype(np.int64)
    same = np.ones(len(where), bool)
    same[:1] = False
    letters = _letters(text, np.arange(len(string)), wide)
    for k in sorted({*range(0, window - wide, wide), window - wide}):
        column = letters[where + k]
        same[1:] &= column[1:] == column[:-1]
    return where - string[where], same


def least_ids(table: pa.Table, window: int) -> pa.Table:
    """Rows (g, entries): for each block its stretches with, window by window, the least id that has it."""
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.uint32, np.bool_)
    columns: list[list] = [[] for _ in kinds]
    block, bodies = [], []
    for g, n, blob in zip(*(table.column(c).to_pylist() for c in ("g", "n", "entries"))):
        body, at = _unblob(blob), 0
        for c, kind in zip(columns, kinds):
            c.append(np.frombuffer(body, kind, n, at))
            at += n * np.dtype(kind).itemsize
        bodies.append(np.frombuffer(body, np.uint8, offset=at))
        block.append(np.full(n, g, np.int64))
    anchor, content, low, high, length, spread = map(np.concatenate, columns)
    data, block = np.concatenate(bodies), np.concatenate(block)
    offsets = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])

    # One string for each distinct stretch, with the least id over all blocks.
    _, take, string = np.unique(content, return_index=True, return_inverse=True)
    least = np.full(len(take), np.iinfo(np.int64).max)
    np.minimum.at(least, string, low)
    windows = (length[take] - window + 1).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(windows)])
    result = np.repeat(least, windows)

    # Where an anchor stands in one stretch alone, that is the answer; the others are sorted, whole anchors
    # at a time, as windows of different anchors differ.
    _, group, size = np.unique(anchor[take], return_inverse=True, return_counts=True)
    mixed = np.flatnonzero((size[group] > 1) & ~spread[take])
    mixed = mixed[np.argsort(group[mixed], kind="stable")]
    ends = np.cumsum(length[take[mixed]], dtype=np.int64)
    new = np.flatnonzero(np.diff(group[mixed], prepend=-1))
    # Runs of whole anchors, begun anew where an anchor begins in another stretch of SORT_BYTES.
    begun = np.concatenate([[0], ends])[new] // SORT_BYTES
    cuts = new[np.flatnonzero(np.diff(begun, prepend=-1))].tolist()
    for i, j in zip(cuts, [*cuts[1:], len(mixed)]):
        some = mixed[i:j]
        part = length[take[some]].astype(np.int64)
        own = np.concatenate([[0], np.cumsum(part)])
        joined = data[_spread(offsets[take[some]], part)]
        places, same = sorted_suffixes(joined, own, window)
        number = np.searchsorted(own, places, "right") - 1
        groups = np.flatnonzero(~same)
        lowest = np.minimum.reduceat(least[some[number]], groups)
        target = begin[some[number]] + places - own[number]
        result[target] = np.repeat(lowest, np.diff(np.append(groups, len(places))))

    # Runs of equal answers within a stretch.
    cut = np.ones(len(result), bool)
    cut[1:] = result[1:] != result[:-1]
    cut[begin[:-1]] = True
    edges = np.flatnonzero(cut)
    run_size = np.diff(np.append(edges, len(result)))
    run_from = np.searchsorted(edges, begin)
    lowest = np.minimum.reduceat(result, begin[:-1])
    useful = np.flatnonzero(lowest[string] < high)
    useful = useful[np.argsort(block[useful], kind="stable")]
    rows = []
    for g, i, j in _cut_rows(block[useful]):
        chosen = useful[i:j]
        s = string[chosen]
        runs = _spread(run_from[s], run_from[s + 1] - run_from[s])
        rows.append((g, _blob(
            np.array([len(chosen), len(runs)], np.int64), content[chosen], anchor[chosen], spread[chosen],
            (run_from[s + 1] - run_from[s]).astype(np.int32), run_size[runs].astype(np.int32),
            result[edges[runs]])))
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                    ["g", "entries"])


def _answers(reply: pa.Table):
    """Sorted contents with their runs, and the anchors that were looked at window by window."""
    content, hot, runs, size, least = [], [np.zeros(0, np.uint64)], [], [], []
    for blob in reply.column("entries").to_pylist():
        body = _unblob(blob)
        n, m = np.frombuffer(body, np.int64, 2).tolist()
        at = 16
        out = []
        for kind, count in ((np.uint64, n), (np.uint64, n), (np.bool_, n), (np.int32, n), (np.int32, m), (np.int64, m)):
            out.append(np.frombuffer(body, kind, count, at))
            at += count * np.dtype(kind).itemsize
        content.append(out[0])
        hot.append(out[1][out[2]])
        runs.append(out[3])
        size.append(out[4])
        least.append(out[5])
    if not content:
        return None
    content, runs, size, least = map(np.concatenate, (content, runs, size, least))
    first = np.cumsum(runs) - runs
    order = np.argsort(content)
    return content[order], first[order], runs[order].astype(np.int64), size, least, np.unique(np.concatenate(hot))


def removed_in_block(table: pa.Table, reply: pa.Table, window: int, id_type: pa.DataType) -> pa.Table:
    """Rows (id, n_bytes, spans, kept): the byte ranges that go and what is left."""
    ids, texts = _column(table, "id").to_numpy(), _column(table, "text")
    answers = _answers(reply)
    gone: dict[int, list] = {}
    if answers is not None:
        content, run_first, run_count, run_size, run_least, hot = answers
        for low, _, sums, offsets, row, first, size, anchor in stretches(texts, window):
            alone = np.isin(anchor, hot)
            row = np.concatenate([row[~alone], np.repeat(row[alone], size[alone])])
            first = np.concatenate([first[~alone], _spread(first[alone], size[alone])])
            size = np.concatenate([size[~alone], np.ones(int(size[alone].sum()), size.dtype)])
            own = content_hash(sums, first, size, window)
            at = np.minimum(np.searchsorted(content, own), len(content) - 1)
            met = np.flatnonzero(content[at] == own)
            at, row, first = at[met], row[met], first[met]
            runs = _spread(run_first[at], run_count[at])
            stretch = np.repeat(np.arange(len(at)), run_count[at])
            stop = np.cumsum(run_size[runs])
            within = stop - run_size[runs]
            base = within[np.cumsum(run_count[at]) - run_count[at]] if len(at) else within
            begin = first[stretch] + within - base[stretch]
            remove = run_least[runs] < ids[low + row[stretch]]
            begin, end, owner = begin[remove], (begin + run_size[runs])[remove] + window - 1, row[stretch][remove]
            order = np.lexsort((begin, owner))
            begin, end, owner = begin[order], end[order], owner[order]
            for r, i, j in _cut_rows(owner):
                spans: list[list[int]] = []
                for s, e in zip((begin[i:j] - offsets[r]).tolist(), (end[i:j] - offsets[r]).tolist()):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                gone[low + r] = spans
    n_bytes, span_rows, kept = [], [], []
    for i, text in enumerate(texts.to_pylist()):
        body = (text or "").encode("utf-8", "surrogatepass")
        spans = gone.get(i, [])
        n_bytes.append(len(body))
        span_rows.append([{"start": s, "end": e} for s, e in spans])
        at, parts = 0, []
        for s, e in spans:
            parts.append(body[at:s])
            at = e
        parts.append(body[at:])
        kept.append(b"".join(parts))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.table([pa.array(ids, id_type), pa.array(n_bytes, pa.int64()),
                     pa.array(span_rows, pa.list_(span)), pa.array(kept, pa.binary())],
                    ["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
                   hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row per input row: id, n_bytes, spans (byte ranges that go), kept (the other bytes).

    Byte ranges go if they are covered by a string of ``window`` bytes that also starts in a row with a
    smaller id; judged on the input. Steps, all over blocks of documents dealt by a hash of the id:

    1. Every window has an anchor (least hash of the 20-byte grams in it); each block sends its
       distinct anchors to buckets, which answer with those that lie in several ids.
    2. Each block sends its distinct stretches (runs of windows of one anchor) with such anchors.
       A bucket finds the least id for every window: a column-wise construction sorts all
       suffixes of the stretches, and windows with a common prefix of full length are equal.
    3. Each block marks its windows that a smaller id has.

    A block sends an anchor or stretch once however many of its documents have it, so a group of
    copies costs an entry a block. Anchors in more than ``hot_blocks`` blocks travel window by
    window and are dealt by the window's own hash. Nothing is capped.

    A null text is empty. A very long text is one block's work. Of equal ids neither is smaller, so ties
    keep their bytes. Ids must be whole numbers; rows of one id do not remove from each other; rows
    with a null id neither lose nor cause anything. Other columns are neither read nor returned; an
    empty table gives an empty table.
    """
    with_small_batches(docs)
    id_type = docs.schema[id_col].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    bits = max(LEAST_BUCKET_BITS, int(total // bucket_bytes).bit_length())
    named = docs.where(F.col(id_col).isNotNull()).select(
        F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("g"),
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def anchors(key, table):
        return anchors_of_block(table, window, bits, key[0].as_py())

    def shared(table):
        return shared_anchors(table, bits, hot_blocks)

    def chosen(key, table, reply):
        return stretches_of_block(table, reply, window, bits, key[0].as_py())

    def least(table):
        return least_ids(table, window)

    def removed(key, table, reply):
        return removed_in_block(table, reply, window, pa.int64())

    met = (named.groupBy("g").applyInArrow(anchors, "b int, g int, anchors binary, several binary")
           .groupBy("b").applyInArrow(shared, "g int, b int, anchors binary, hot binary"))
    answers = (named.groupBy("g").cogroup(met.groupBy("g"))
               .applyInArrow(chosen, "b int, g int, n int, entries binary")
               .groupBy("b").applyInArrow(least, "g int, entries binary"))
    span = "array<struct<start: bigint, end: bigint>>"
    out = (named.groupBy("g").cogroup(answers.groupBy("g"))
           .applyInArrow(removed, f"id long, n_bytes long, spans {span}, kept binary"))
    nameless = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("id"),
        F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_bytes"),
        F.array().cast(span).alias("spans"), F.coalesce(text_col, F.lit("")).cast("binary").alias("kept"))
    return (out.unionByName(nameless)
            .select(F.col("id").cast(id_type).alias(id_col), "n_bytes", "spans", "kept"))
