"""Operators 1, 2 and 10 against the public libraries and exact round trips."""

import base64
import hashlib
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardlog.llm import byte_bpe, packing, planes
from wardlog.llm.common import WordEncoder, word_encoder
from wardlog.session import new_folder

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = st.text(st.sampled_from("aAbetherß é中'sd12,.!|  \t\n\x0b\x1c\x85\xa0́\x01ﬁ😀"), max_size=60)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tiktoken_library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def unmodified():
    return Tokenizer.from_file(WORDS)


def expected_ids(rows, library):
    return sorted(
        ((doc, [*library(text or ""), 2]) for doc, text in ((r.doc_id, r.text) for r in rows)), key=lambda x: (x[0], len(x[1]))
    )


@given(st.lists(ALPHABET, max_size=5))
@settings(max_examples=150, deadline=None)
def test_word_cache_equals_library(library, texts):
    found = word_encoder(WORDS).encode_bytes(pa.array(texts, pa.string()))
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [library(t) for t in texts]


@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "a", "B1", " ", "\n", "<|", "é", "\x01"]), max_size=12).map("".join), max_size=4))
@settings(max_examples=150, deadline=None)
def test_special_strings_equal_unmodified_library(texts):
    plain = unmodified()
    found = word_encoder(WORDS).encode_bytes(pa.array(texts, pa.string()))
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_cache_is_bounded(library):
    encoder = WordEncoder(WORDS, limit=10)
    for k in range(5):
        encoder.encode_bytes(pa.array([" ".join(f"w{k}x{i}" for i in range(8))]))
        assert len(encoder.cache) <= 20


@given(ALPHABET)
@settings(max_examples=200, deadline=None)
def test_segment_tree_equals_library(tiktoken_library, text):
    bpe = byte_bpe.byte_bpe(RANKS, public_tokenizers.PATTERN)
    ids = np.frombuffer(next(bpe.encode_batch([text])), "<i4").tolist()
    assert ids == tiktoken_library.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_segment_tree_on_one_long_match(tiktoken_library):
    bpe = byte_bpe.byte_bpe(RANKS, public_tokenizers.PATTERN)
    piece = "abcdefghijé" * 5_000
    assert bpe.merge(piece.encode()) == tiktoken_library.encode_ordinary(piece)


def test_byte_bpe_query(docs, no_docs, tiktoken_library):
    ids = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    found = sorted(tuple(r) for r in byte_bpe.digests(ids, RANKS, public_tokenizers.PATTERN).collect())
    wanted = []
    for row in docs.select("doc_id", "text").collect():
        text = row.text or ""
        own = tiktoken_library.encode_ordinary(text)
        decimal = " ".join(map(str, own)).encode()
        wanted.append((row.doc_id, len(own), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert found == sorted(wanted)
    decoded = byte_bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in decoded) == sorted((r.text or "").encode() for r in docs.collect())
    assert byte_bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("plane", ["byte", "bit"])
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=200))
@settings(max_examples=40, deadline=None)
def test_planes_round_trip(plane, ids):
    values = np.array(ids, "<u4")
    assert planes.from_planes(planes.to_planes(values, plane), len(values), plane).tolist() == ids


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_plane_files(spark, docs, library, plane):
    folder = new_folder(spark, "planes-test")
    planes.write_planes(docs, folder, WORDS, plane=plane, block_ids=7, chunk_ids=50)
    read = planes.read_planes(spark, folder)
    found = planes.with_starts(spark, folder, planes.digests(read)).orderBy("start").collect()
    wanted = expected_ids(docs.collect(), library)
    assert [r.doc_id for r in found] == [doc for doc, _ in wanted]
    assert [r.n_tokens for r in found] == [len(ids) for _, ids in wanted]
    assert [r.start for r in found] == np.cumsum([0, *(len(ids) for _, ids in wanted[:-1])]).tolist()
    assert [r.ids_crc32 for r in found] == [zlib.crc32(np.array(ids, "<u4").tobytes()) for _, ids in wanted]


def test_plane_files_of_nothing(spark, no_docs):
    folder = new_folder(spark, "planes-test")
    planes.write_planes(no_docs, folder, WORDS)
    assert planes.with_starts(spark, folder, planes.read_planes(spark, folder)).count() == 0


@pytest.mark.parametrize(("length", "windows"), [(64, 2), (16, 3), (4096, 64)])
def test_packing(docs, library, length, windows):
    rows = packing.pack(docs, WORDS, length=length, windows=windows).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    counts = {}
    for doc, ids in expected_ids(docs.collect(), library):
        counts.setdefault((doc, len(ids)), []).append(ids)
    assert set(counts) == set(by_doc)
    for key, copies in counts.items():
        pieces = sorted(by_doc[key], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == sum(map(len, copies))
        for r in pieces:
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == copies[0][r.start : r.start + r.length]
    total = sum(r.length for r in rows)
    full = sum(1 for p in by_sequence.values() if sum(r.length for r in p) == length)
    assert full >= total // length - 3 * windows - 1


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, WORDS).count() == 0
