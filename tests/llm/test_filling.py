import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from regiotally.llm import fill_middle
from regiotally.llm.fill_middle import Filling
from tests.llm.cases import documents, empty

HOW = Filling()


def plainly(text, key):
    """The rule step by step, with a loop over lines and no capture."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 100:
        return n, "plain", text, None, None
    a, b = h1 % (n + 1), h2 % (n + 1)
    a, b = min(a, b), max(a, b)
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


@given(st.text(st.sampled_from("ab\n\r<PSM>é 😀 "), max_size=40), st.integers(0, 10_000))
@settings(max_examples=500, deadline=None)
def test_forms_and_round_trip(text, key):
    got = fill_middle.fill(text, str(key), HOW)
    assert got == plainly(text, key)
    assert fill_middle.unfill(got[2], got[1], HOW.marks) == text


def test_long_texts_are_one_match():
    assert fill_middle.unit_ends("\n" * 300_000) == list(range(1, 300_001))
    assert fill_middle.unit_ends("x" * 3_000_000) == [3_000_000]
    assert fill_middle.unit_ends("") == []


def test_other_units_rates_and_marks():
    words = Filling(unit=r"\S+\s*|\s+", rate=0)
    assert fill_middle.fill("one two", "1", words)[:2] == (2, "plain")
    always = Filling(unit=r"\S+\s*|\s+", spm=100, marks=("[p]", "(s)", "{m}"))
    made = fill_middle.fill("one two  three", "5", always)
    assert made[1] == "spm" and fill_middle.unfill(made[2], "spm", always.marks) == "one two  three"
    with pytest.raises(ValueError):
        Filling(marks=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        Filling(marks=("<P>", "P<", "<M>"))
    with pytest.raises(ValueError):
        fill_middle.unit_ends("ab", "a")


def test_rows(spark):
    docs = documents(spark, [(20, "a\nb\n<P>\n", *[None] * 14), (21, "\n\n\n", *[None] * 14)])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in docs.select("doc_id", "text").collect():
        n, form, output, prefix, middle = plainly(r.text or "", "" if r.doc_id is None else r.doc_id)
        want.append((r.doc_id, n, form, prefix, middle, sha(output), sha(r.text or "")))
    got = [tuple(r) for r in fill_middle.digests(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digests(empty(spark)).count() == 0
    renamed = docs.withColumnsRenamed({"doc_id": "output", "text": "form"})
    again = fill_middle.filled(renamed.select("output", "form").withColumnRenamed("output", "key").withColumnRenamed("form", "body"), HOW, "key", "body")
    assert again.count() == docs.count()
