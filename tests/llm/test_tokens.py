"""Byte-level BPE, prefix counts and packing against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidekeep.llm import bpe, packing, token_counts
from tidekeep.llm.textbatch import blocks

from .helpers import corpus, frame

RANKS, JSON, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
PARTS = ["'s", "'", "'re", "'ll", " ", "  ", "\n", "\t", "a", "the", " the", "1", "é", "ß", "中", "😀", "!", "...", " ", "　", "▁", "<s>", "<0x0A>", "<|endoftext|>", "́", "ing", "tion"]
TEXT = st.one_of(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts, added=False):
    coder, out = bpe.load(JSON if added else RANKS), []
    for block in blocks(pa.array(texts, pa.string()), 300):
        ids, bounds = (coder.encode_with_added if added else coder.encode_block)(block)
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=8))
def test_ids_and_counts_equal_the_libraries(texts):
    plain = [t or "" for t in texts]
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = _encoding(ranks)
    got = ids_of(texts)
    assert got == [own.encode_ordinary(t) for t in plain]
    coder = bpe.load(RANKS)
    assert [coder.decode(np.array(x, np.int32)).tobytes().decode() for x in got] == plain
    assert ids_of(texts, added=True) == [e.ids for e in _tokenizer().encode_batch(plain, add_special_tokens=False)]
    counter = token_counts.load(PIECES)
    counts = [int(n) for block in blocks(pa.array(texts, pa.string()), 300) for n in counter.totals(block)]
    assert counts == [len(x) for x in _pieces().encode(plain)]
    for t in plain[:2]:
        assert counter.prefixes(t).tolist() == [len(_pieces().encode(t[:k])) for k in range(len(t) + 1)]


_cache = {}


def _encoding(ranks):
    return _cache.setdefault("t", tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))


def _tokenizer():
    return _cache.setdefault("h", Tokenizer.from_file(JSON))


def _pieces():
    return _cache.setdefault("s", sentencepiece.SentencePieceProcessor(model_file=PIECES))


def test_long_matches(reference):
    rng = random.Random(2)
    texts = ["a" * 4000, "ab" * 1500, "aab" * 900 + "\n\n", "!" * 1200, " " * 3000, "é" * 700, *("".join(rng.choices("abcdethin", k=rng.randint(257, 900))) for _ in range(30))]
    assert ids_of(texts) == [reference.encode_ordinary(t) for t in texts]
    counter = token_counts.load(PIECES)
    counts = [int(n) for block in blocks(pa.array(texts)) for n in counter.totals(block)]
    assert counts == [len(x) for x in _pieces().encode(texts)]


def test_budget_is_read_off_the_prefix_counts():
    counter, text = token_counts.load(PIECES), "The quick brown fox jumps over thirteen lazy dogs. " * 5
    for budget in (0, 1, 7, 30):
        k = counter.fit(text, budget)
        assert len(_pieces().encode(text[:k])) <= budget and all(len(_pieces().encode(text[:j])) > budget for j in range(k + 1, len(text) + 1))


def test_round_trip_query(spark, reference):
    rows = corpus(40)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(frame(spark, rows), RANKS).collect()}
    want = set()
    for r in rows:
        ids = reference.encode_ordinary(r[1] or "")
        want.add((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == want
    back = bpe.decode(bpe.encode(frame(spark, rows), RANKS), RANKS)
    assert {(r.doc_id, bytes(r.data).decode()) for r in back.collect()} == {(r[0], r[1] or "") for r in rows}
    assert bpe.round_trip(frame(spark, []), RANKS).count() == 0


def test_token_count_query(spark):
    rows = corpus(40)
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(frame(spark, rows), PIECES, limit=100).collect()}
    want = {(r[0], len((r[1] or "").encode()), n := len(_pieces().encode(r[1] or "")), n > 100) for r in rows}
    assert got == want
    lists = {r.doc_id: r.counts for r in token_counts.prefix_counts(frame(spark, rows[:5]), PIECES).collect()}
    assert all(lists[r[0]][-1] == len(_pieces().encode(r[1] or "")) and len(lists[r[0]]) == len(r[1] or "") + 1 for r in rows[:5])


def check_packing(rows, placed, capacity):
    ids = {(r[0], r[1]): _tokenizer().encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    want = []
    for (doc, _), own in ((k, ids[k]) for k in [(r[0], r[1]) for r in rows]):
        head = (len(own) - 1) % capacity + 1
        cuts = [0, *range(head, len(own) + 1, capacity)]
        want += [(doc, k, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == sorted(want)
    sequences = {}
    for r in placed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(spark, capacity):
    rows = corpus(60)
    placed = packing.pack(frame(spark, rows), JSON, 2, capacity).collect()
    n = check_packing(rows, placed, capacity)
    assert n <= 1.05 * sum(r.length for r in placed) / capacity + 2
    whole = packing.sequences(frame(spark, rows), JSON, 2, capacity).collect()
    assert len(whole) == n and max(len(r.ids) for r in whole) <= capacity and sum(len(r.ids) for r in whole) == sum(r.length for r in placed)
    assert packing.pack(frame(spark, []), JSON, 2).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1, max_size=25), st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_sweep_is_best_fit_by_rank(pieces, gaps):
    taken, used = {k: [] for k in pieces}, {k: [] for k in gaps}
    for m in packing.sweep(pieces, gaps, dict.fromkeys(pieces, 7)):
        taken[m.length] += range(m.first_piece, m.first_piece + m.each * m.gaps)
        used[m.size] += range(m.first_gap, m.first_gap + m.gaps)
        assert m.each >= 1 and m.gaps >= 1 and m.each * m.length <= m.size
    assert all(v == list(range(7, 7 + len(v))) and len(v) <= pieces[k] for k, v in taken.items())
    assert all(v == list(range(len(v))) and len(v) <= gaps[k] for k, v in used.items())
    # one at a time, from the longest: each into the least size that holds it, filled up with its equals
    free, want = dict(gaps), {}
    for length in sorted(pieces, reverse=True):
        left = pieces[length]
        while left and (size := min((g for g, n in free.items() if n and g >= length), default=None)):
            free[size] -= 1
            left -= min(size // length, left)
        want[length] = pieces[length] - left
    assert {k: len(v) for k, v in taken.items()} == want


@pytest.mark.parametrize("seed", range(3))
def test_rounds_place_every_piece_once(spark, seed):
    rng = random.Random(seed)
    capacity, counts = 64, {n: rng.randint(1, 90) for n in rng.sample(range(1, 65), [3, 12, 40][seed])}
    placed = packing.place(counts, spark, capacity).collect()
    assert sorted((r.length, r.rank) for r in placed) == sorted((n, k) for n, c in counts.items() for k in range(c))
    sequences = {}
    for r in placed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    # not worse than one at a time by more than a few
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((g for g in gaps if g >= length), default=None)
            if fit is not None:
                gaps.remove(fit)
            gaps.append((capacity if fit is None else fit) - length)
    assert len(sequences) <= 1.01 * len(gaps) + 2
