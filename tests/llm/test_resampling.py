import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from regiotally.llm import segment_resampling as sr
from tests.llm.cases import documents, empty, prose

HOW = sr.Resampling()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    """All runs of 1 to 3 words of the whole text, with no lines and no checksum that goes on."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plainly(rows, targets):
    s = Counter(bucket(f) for _, text in rows for f in features(text)[0])
    t = Counter(bucket(f) for text in targets for f in features(text)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000.0) / ((s[b] + 1.0) * (big_t + 10000.0))))
    out = []
    for doc_id, text in rows:
        found, n = features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@given(st.lists(st.text(st.sampled_from("ab Z.9é😀\n\t\r"), max_size=30), max_size=5), st.sampled_from(["\n", " ", "."]))
@settings(max_examples=300, deadline=None)
def test_lines_and_seams_are_all_runs(texts, separator):
    how = sr.Resampling(separator=separator)
    got = Counter()
    for text in texts:
        raw = text.encode()
        got.update(sr.runs([sr.words_of(line) for line in raw.split(separator.encode())], 3, 10_000)[0].tolist())
        got.update(sr.seam_runs(raw, how).tolist())
    assert got == Counter(bucket(f) for t in texts for f in features(t)[0])


def test_other_lengths():
    for longest in (1, 2, 4):
        how = sr.Resampling(longest=longest)
        raw = b"a b\nc\n\nd e f g h i j\nk"
        words = sr.words_of(raw)
        got = Counter(sr.runs([sr.words_of(x) for x in raw.split(b"\n")], longest, 10_000)[0].tolist()) + Counter(sr.seam_runs(raw, how).tolist())
        assert got == Counter(zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    with pytest.raises(ValueError):
        sr.Resampling(separator="a")


def test_every_row_against_brute_force(spark):
    more = [(100 + k, "\n".join([prose(12 + k % 7, k // 2), "a shared line of words", prose(9, k)]), *[None] * 14) for k in range(90)]
    docs = documents(spark, more)
    targets = [prose(40, 77), None, "", "A Shared\nline"]
    target = spark.createDataFrame([(t, 1) for t in targets], "text string, score int")
    got = sorted((tuple(r) for r in sr.resampled(docs, target).collect()), key=str)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got == plainly(rows, targets)
    assert sum(r[4] is not None for r in got) == 5 * sum(features(t)[1] >= 20 for _, t in rows) // 100 > 3


def test_ties_repeats_and_empty_tables(spark):
    text = prose(30, 1)
    docs = spark.createDataFrame([(i, text) for i in [7, 7, 7, None, None, *range(20, 55)]], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = sorted((tuple(r) for r in sr.resampled(docs, none, sr.Resampling(share=100)).collect()), key=lambda r: r[4])
    assert [r[4] for r in got] == list(range(1, 41))
    assert [(-r[3], r[0] is None, r[0] or 0) for r in got] == sorted((-r[3], r[0] is None, r[0] or 0) for r in got)
    assert sr.resampled(empty(spark), none).count() == 0


def test_gains_are_floors():
    s, t = np.zeros(10_000, dtype=np.int64), np.zeros(10_000, dtype=np.int64)
    s[3], t[5] = 9, 4
    gain = sr.gains(s, t)
    assert gain[3] == math.floor(1000 * math.log(1.0 * 10009 / (10.0 * 10004))) < 0 < gain[5]
