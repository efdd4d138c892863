"""Personal data, token counts, packing and quality counts against plain versions."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taktspur.llm import packing, pii, quality
from taktspur.llm.linear import constant_model
from taktspur.llm.tokens import PieceCounter, count_tokens

PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
COUNTER = PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def base_spans(text):
    return [(s, pii.KINDS.index(k), e) for s, e, k, _ in pii.find_spans(text) if k in pii.BASE_KINDS]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*"0123456789.- +@ab_%()é\n", "4041894974608795", "1.2.3.4", "a@b.c",
                                 "+1 (988) 555-2485"]), max_size=24).map("".join))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert base_spans(text) == plain_spans(text)


def test_added_kinds_need_checksum_or_context():
    def kinds(text):
        return [(k, text[s:e]) for s, e, k, _ in pii.find_spans(text)]
    assert kinds("iban DE89 3704 0044 0532 0130 00 ok") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("iban DE88 3704 0044 0532 0130 00 ok") == []
    assert kinds("ssn 123-45-6789") == [("national_id", "123-45-6789")]
    assert kinds("see 123-45-6789") == []
    assert kinds("order 555-123-4567, phone") == []
    assert kinds("phone 555-123-4567") == [("local_phone", "555-123-4567")]
    assert kinds("+1 (988) 555-2485 10.0.0.255") == [("phone_inner", "+1 (988) 555-2485"), ("ip", "10.0.0.255")]
    assert kinds("7 4041894974608795") == [("card_inner", "4041894974608795")]
    assert kinds("password=abcdef123") == [("secret", "password=abcdef123")]
    long = "token: " + "eyJhbGciOi.x-Y_" * 20
    assert kinds(f"a {long}, b") == [("secret", long)]
    mixed = f"{long}+4041894974608795+{long[7:]}"  # a card inside a secret leaves both ends to it
    assert kinds(mixed) == [("secret", f"{long}+"), ("card", "4041894974608795"), ("secret", f"+{long[7:]}")]


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a." * 100_000 + "@" + "b" * 100_000, "AB12" + "C" * 200_000, "+1" + "-1" * 200_000):
        assert base_spans(text) in ([], plain_spans(text[:0]))


def test_personal_data_of_edge_rows(edge_docs, empty_docs):
    rows = pii.find_personal_data(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    texts = edge_docs.select("text").collect()
    for r, t in zip(rows, texts):
        assert [(s.start, s.end) for s in r.found if s.kind in pii.BASE_KINDS] == [
            (s, e) for s, _, e in plain_spans(t.text or "")]
    assert pii.find_personal_data(empty_docs).count() == 0


def test_masked_text_has_no_span_left(edge_docs):
    out = pii.mask_personal_data(edge_docs.withColumn("n_chars", F.char_length("text").cast("long")))
    assert out.columns == [*edge_docs.columns, "n_chars"]
    for r in out.collect():
        assert (r.text is None) == (r.n_chars is None)
        if r.text is not None:
            assert not pii.find_spans(r.text) and r.n_chars == len(r.text)
    six = [r.text for r in out.collect() if r.doc_id == 6][0]
    assert "[EMAIL] [PHONE_INNER] [IP]" in six


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from([*" \n\t▁ab1é中😀\r\x00<s>", "é"]), max_size=40))
def test_piece_counts_are_those_of_the_library(text):
    assert COUNTER.splits
    assert COUNTER.count(text) == len(PIECES.encode(text))


def test_token_counts(small_docs, edge_docs, empty_docs):
    for docs in (small_docs, edge_docs):
        want = Counter((r.doc_id, len((r.text or "").encode()), len(PIECES.encode(r.text or "")))
                       for r in docs.collect())
        got = count_tokens(docs).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert count_tokens(empty_docs).count() == 0


def test_plain_code_points_split_alike():
    encoder = packing.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and packing.PLAIN.fullmatch(chr(c))]
    assert len(plain) > 30_000
    for k in range(0, len(plain), 50):
        text = "".join(f"a{c}1{c} {c}'{c}" for c in plain[k:k + 50])
        assert encoder.ids(text).tolist() == BYTES.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("parts", [1, 5, 150])
def test_packing_keeps_every_id_once(small_docs, edge_docs, parts):
    docs = small_docs.select("doc_id", "text").unionByName(
        edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
        .select(F.col("doc_id") + 10_000_000, "text").toDF("doc_id", "text"))
    want = {r.doc_id: BYTES.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    rows = packing.pack(docs.repartition(parts)).collect()
    seen, windows = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc])
        seen.setdefault(r.doc, {})[r.start] = ids
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, ids in want.items():
        assert sum((seen[doc][s] for s in sorted(seen[doc])), []) == ids
    total, padding = sum(map(len, want.values())), 0
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        padding += packing.WINDOW - at
    assert padding < packing.WINDOW and total + padding == len(windows) * packing.WINDOW


def test_packing_of_edge_rows(edge_docs, empty_docs):
    rows = packing.pack(edge_docs).collect()
    assert sum(r.length for r in rows if r.doc == 1) == 1  # the end alone
    assert sum(r.length == 0 for r in rows) == 0
    assert packing.pack(empty_docs).count() == 0


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) for k in range(3)
               if windows[tuple(words[i:i + 3])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_quality_counts(small_docs, edge_docs, empty_docs):
    for docs in (small_docs, edge_docs):
        texts = docs.select("doc_id", "text").collect()
        rows = quality.rate_quality(docs.select("doc_id", "text"), constant_model(1, 0)).collect()
        for t, r in zip(texts, rows):
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_quality(t.text or "")
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept == (not r.base_failed)
    assert quality.rate_quality(empty_docs, constant_model(1, 0)).count() == 0


def plain_overlaps(spans):
    """The rule for added kinds, span against span."""
    kept = []
    for start, end, kind, score in spans:
        if kind in pii.BASE_KINDS or not any(s < end and start < e and pii.KINDS.index(k) < pii.KINDS.index(kind)
                                             for s, e, k, _ in kept):
            kept.append((start, end, kind, score))
    return kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=25), st.integers(0, 60), st.integers(1, 12))
def test_covered_stretches(spans, start, size):
    spans = [(a, a + n) for a, n in spans]
    covered = pii.Covered(spans)
    cells = {i for a, b in spans for i in range(a, b)}
    assert {i for a, b in zip(covered.starts, covered.ends) for i in range(a, b)} == cells
    assert covered.meets(start, start + size) == any(i in cells for i in range(start, start + size))
    assert all(a < start + size and start < b for a, b in covered.within(start, start + size))
    assert bool(covered.within(start, start + size)) == covered.meets(start, start + size)


def test_texts_full_of_spans_take_time_in_proportion():
    import time
    unit = "mail a.b@c.example.org call +1 (988) 555-2485 host 10.0.0.1 iban DE89370400440532013000 password: geheim123 ssn 123-45-6789\n"
    times, counts = [], []
    for n in (1_000, 2_000, 4_000, 8_000):
        start = time.perf_counter()
        found = pii.find_spans(unit * n)
        times.append(time.perf_counter() - start)
        counts.append(len(found))
        assert plain_overlaps(found[:300]) == found[:300]
    assert counts[3] == 8 * counts[0] > 8 * 5_000
    assert times[3] < 2.5 ** 3 * times[0] + 0.5


def test_counts_kept_by_a_worker_are_bounded_in_bytes():
    counter = PieceCounter(public_tokenizers.path("piece_bpe_32k.model"), COUNTER.prove())
    assert counter.proven == COUNTER.proven and len(counter.proven) > 1_000
    for i in range(40):
        text = "".join(chr(0x4E00 + (i * 977 + j * 31) % 20_000) for j in range(5_000))
        assert counter.count(text) == len(PIECES.encode(text))
    assert len(counter.known) == len(counter.proven)
    text = " ".join(f"w{i}x{i * 7919 % 10_007}" for i in range(500_000))
    assert counter.count(text) == len(PIECES.encode(text))
    extra = [k for k in counter.known if k not in counter.proven]
    assert 0 < len(extra) < 400_000 and counter.kept <= (48 << 20) + 400
