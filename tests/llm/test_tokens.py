"""Token files, token counts and packing against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer, models

from quarry.llm import bpe, packing, token_counts, token_store
from quarry.llm.queries import tokenizer_path

ALPHABET = [" ", "  ", "\n", "a", "the", "é", "1", ".", ",", "a.", "x,", ".,", "'s", "日", "\t", " x", "<|endoftext|>", "\x1c", "　", "I’m", "▁", "🙂", "ation"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_encoder_equals_library(library, monkeypatch, size):
    monkeypatch.setattr(bpe, "SLICE", size)
    rng, encoder = random.Random(1), bpe.BpeEncoder(tokenizer_path(), kept=50)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(encoder.ids([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_added_tokens_keep_their_ids(library):
    encoder = bpe.BpeEncoder(tokenizer_path())
    texts = ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|> a", "a  <|endoftext|>\n", "<|endoftext", "", "plain", "<|endoftext|> " * 500 + "z"]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.ids(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts] and 50256 in got[0]


def ids_of(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def test_store_round_trip(spark, odd, none, library):
    store = token_store.write_store(odd, tokenizer_path(), 2)
    got = token_store.read_store(spark, token_store.open_store(store.uri)).orderBy("start").collect()
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for r, row in zip(got, rows, strict=True):
        ids = ids_of(library, row.text, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.read_store(spark, token_store.write_store(none, tokenizer_path(), 2)).count() == 0


def test_ranges_read_what_a_map_holds(spark, odd, monkeypatch):
    store = token_store.write_store(odd, tokenizer_path(), 2)
    for x in store.files:
        mapped, offsets, keys = token_store.read_file(store.uri, x["file"])
        with monkeypatch.context() as m:
            m.setattr(token_store, "local_path", lambda uri: None)
            ranges, *rest = token_store.read_file(store.uri, x["file"])
        assert len(ranges) == len(mapped) == offsets[-1] and rest[1] == keys
        for a, b in [(0, len(mapped)), (3, 9), (5, 5), *zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]:
            assert np.array_equal(ranges[a:b], mapped[a:b])


def test_pieces(odd, none, library):
    whole = defaultdict(list)
    for r in odd.select("doc_id", "text").collect():
        whole[r.doc_id].append(ids_of(library, r.text, 1))
    pieces = packing.pack_documents(odd.coalesce(1), tokenizer_path(), 1, block_tokens=5000).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        assert any(p.ids_crc32 == zlib.crc32(np.array(w[p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(w) for w in whole[p.doc_id])
    assert sum(p.length for p in pieces) == sum(len(w) for ws in whole.values() for w in ws)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack_documents(none, tokenizer_path(), 1).count() == 0


def test_pack_fills_windows():
    rng = random.Random(2)
    for n in (0, 1, 5, 300):
        lengths = [rng.choice([1, 7, 100, 255, 256, 900, 1500, 2048, 5000]) for _ in range(n)]
        windows, left = packing.pack(lengths)
        assert all(sum(p[2] for p in w) in packing.TIERS for w in windows)
        assert sum(p[2] for w in [*windows, left] for p in w) == sum(lengths)
        sizes = [sum(p[2] for p in w) for w in packing.powers(left)]
        assert sum(sizes) == sum(p[2] for p in left) and all(s & (s - 1) == 0 for s in sizes)
        covered = sorted((p[0], p[1], p[2]) for w in [*windows, left] for p in w)
        for a, b in zip(covered, covered[1:], strict=False):
            assert a[0] != b[0] or a[1] + a[2] == b[1]


def test_counts_equal_library(spark, odd, none):
    pieces, unknown = token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    library, counter = Tokenizer(models.Unigram(pieces, unk_id=unknown, byte_fallback=True)), token_counts.Counter(pieces, unknown, kept=40)

    def count(text):
        return len(library.encode((" " + text).replace(" ", "▁"), add_special_tokens=False).ids) if text else 0

    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice([*ALPHABET, "☃", "<s>", "<0x41>"]) for _ in range(rng.randint(0, 14)))
        assert counter.counts([text]) == [count(text)], text
    got = token_counts.token_counts(odd, tokenizer_path("piece_bpe_32k.model")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r.doc_id), count(r.text or "")) for r in odd.select("doc_id", "text").collect())
    assert token_counts.token_counts(none, tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_ties_take_the_longest_last_piece():
    pieces = [("<unk>", -50.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0)]
    library, counter = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False)), token_counts.Counter(pieces, 0, byte_fallback=False)
    for text in ("aab", "aaaa", "abab", "zz", "azza"):
        assert counter.counts([text]) == [len(library.encode("▁" + text).ids)]
