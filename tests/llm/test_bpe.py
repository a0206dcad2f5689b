import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from regiotally.llm import id_planes, tree_bpe
from tests.llm.cases import RANKS, TOKENIZER, documents, empty

LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={}
)
OTHER = Tokenizer.from_file(TOKENIZER)
OTHER.encode_special_tokens = True
MIXED = ["a", "b", " ", "  ", "\n", "'", "'re", "'s", "1", "２", "é", "日本", "\x1c", "\x85", "\xa0", "!", "?", " the", "<|endoftext|>", "\t", "\x00", "²", "😀", "́"]


@given(st.lists(st.sampled_from(MIXED), max_size=60), st.integers(1, 9))
@settings(max_examples=400, deadline=None)
def test_trees_of_any_leaf_give_the_library_ids(parts, leaf):
    text, own = "".join(parts), tree_bpe.codec(RANKS, public_tokenizers.PATTERN)
    kept, tree_bpe.LEAF = tree_bpe.LEAF, leaf
    try:
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
    finally:
        tree_bpe.LEAF = kept
    assert ids == LIBRARY.encode_ordinary(text)
    assert own.decode(ids).decode() == text


def test_joining_is_associative():
    own = tree_bpe.codec(RANKS, public_tokenizers.PATTERN)
    pick = random.Random(2)
    for _ in range(200):
        a, b, c = (own.leaf("".join(pick.choice(MIXED) for _ in range(pick.randint(0, 12)))) for _ in range(3))
        left, right = own.join(own.join(a, b), c), own.join(a, own.join(b, c))
        assert b"".join(left[1]) == b"".join(right[1])


@given(st.lists(st.sampled_from(MIXED), max_size=60))
@settings(max_examples=200, deadline=None)
def test_segments_give_the_tokenizer_ids(parts):
    text = "".join(parts)
    assert np.frombuffer(id_planes.encoder(TOKENIZER).encode([text])[0], "<u4").tolist() == OTHER.encode(text, add_special_tokens=False).ids


def test_round_trip_of_all_rows(spark):
    docs = documents(spark)
    encoded = tree_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    got = sorted(map(tuple, tree_bpe.digests(tree_bpe.decode_ids(encoded, RANKS, public_tokenizers.PATTERN)).collect()), key=str)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert tree_bpe.encode_texts(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50_256), max_size=300))
@settings(max_examples=100, deadline=None)
def test_planes_round_trip(ids):
    own = np.array(ids, dtype="<u4")
    sizes, planes = id_planes.pack(own)
    assert len(sizes) == 32 and sum(sizes) == len(planes)
    assert id_planes.unpack(len(ids), sizes, planes).tolist() == ids


def test_files_hold_the_stream(spark, tmp_path):
    docs = documents(spark)
    path = str(tmp_path / "planes")
    id_planes.write_planes(docs, path, TOKENIZER, slices=3, block_ids=500)  # documents span blocks
    got = [tuple(r) for r in id_planes.read_documents(spark, path).orderBy("start").collect()]
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start, stream = [], 0, []
    for doc_id, text in rows:
        ids = np.array([*OTHER.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
        stream += ids.tolist()
    assert got == want
    read = sorted((r.start, r.ids) for r in id_planes.read_ids(spark, path).collect())
    assert [i for _, ids in read for i in ids] == stream
    none = str(tmp_path / "none")
    id_planes.write_planes(empty(spark), none, TOKENIZER, slices=2)
    assert id_planes.read_documents(spark, none).count() == 0


def test_blocks_have_a_fixed_size(spark, tmp_path):
    path = str(tmp_path / "planes")
    id_planes.write_planes(documents(spark), path, TOKENIZER, slices=2, block_ids=256)
    blocks = spark.read.parquet(f"{path}/blocks")
    last = blocks.groupBy("slice").agg(F.max("block").alias("block"))
    assert blocks.join(last, ["slice", "block"], "left_anti").filter("n_ids <> 256").count() == 0


@pytest.mark.parametrize("text", ["One,\nTwo.\nÉtés", "a\n\nb c\n", "\nx y'\ns it's\n's", "A.\n1\nB", "ab\r\ncd\n\u00a0e"])
def test_line_feeds_between_letters_are_matches_of_their_own(text):
    assert np.frombuffer(id_planes.SegmentEncoder(TOKENIZER).encode([text])[0], "<u4").tolist() == OTHER.encode(text, add_special_tokens=False).ids


def test_letters_are_merged_once_whatever_follows(monkeypatch):
    own, asked, whole = id_planes.SegmentEncoder(TOKENIZER), [], []
    merged, library = own.merged, own.library_ids
    monkeypatch.setattr(own, "merged", lambda piece: asked.append(piece) or merged(piece))
    monkeypatch.setattr(own, "library_ids", lambda texts: whole.extend(texts) or library(texts))
    own.encode(["x word word, word. word.\nWord\nword word!\nWord"])
    assert sorted(asked) == sorted({"x", " word", ",", ".", "Word", "word", "!"}) and not whole
