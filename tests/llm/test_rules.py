import re
from collections import Counter

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from regiotally.llm import decision_list as rules
from tests.llm.cases import changed, documents, empty, prose, row

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered)


texts = st.lists(st.lists(st.sampled_from(["a", "b", "c#", " ", "\n", "\t", "\x0b", "é", "  ", "|", "\xa0"]), max_size=40).map(" ".join), min_size=1, max_size=30)


@given(texts)
@settings(max_examples=15, deadline=None)
def test_statistics_equal_brute_force(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, text string").coalesce(1)
    got = {r.i: tuple(r.s[f] for f in FIELDS) for r in df.select("i", rules.statistics(F.col("text")).alias("s")).collect()}
    assert got == {i: brute(v) for i, v in enumerate(values)}


def _labelled(spark):
    good = [row(1000 + k, prose(60 + k % 40, 300 + k)) for k in range(160)]
    noisy = [row(2000 + k, " ".join(w + "#$%"[i % 3] * 2 for i, w in enumerate(prose(60 + k % 40, 700 + k).split()))) for k in range(60)]
    shouted = [row(3000 + k, prose(60 + k % 40, 800 + k).upper()) for k in range(60)]
    docs = documents(spark, good + noisy + shouted)
    labels = [(r[0], 1) for r in good] + [(r[0], 0) for r in noisy + shouted] + [(None, 0), (7777, None), (1001, None)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_are_learned_and_applied(spark):
    docs, labels = _labelled(spark)
    found = rules.learn(docs, labels)
    assert found.rules and all(len(r) <= 3 for r in found.rules)
    assert {c.measure for r in found.rules for c in r} & {"symbols_per_word", "upper_per_character", "marks_per_word"}
    got = {}
    for r in rules.judged(docs, found).collect():
        got.setdefault(r.doc_id, r)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert sum(got[k].kept for k in range(1000, 1160)) >= 158
    assert sum(got[k].kept for k in [*range(2000, 2060), *range(3000, 3060)]) <= 4
    assert got[5].base_failed and got[5].n_words == 0 and got[6].base_failed
    assert rules.judged(docs, found).count() == docs.count()


def test_nothing_to_learn(spark):
    docs, labels = _labelled(spark)
    for bad in (labels.limit(0), labels.filter("quality = 1")):
        found = rules.learn(docs, bad)
        assert found.rules == ()
        assert rules.judged(docs, found).filter("NOT kept AND NOT base_failed").count() == 0
    assert rules.learn(empty(spark), labels).rules == () and rules.judged(empty(spark), found).count() == 0


def test_conditions_read_in_order(spark):
    listed = rules.DecisionList(((rules.Condition("words", True, 50.0), rules.Condition("symbols_per_word", True, 0.5)), (rules.Condition("words", False, 12.0),)))
    df = spark.createDataFrame([(0, "a " * 60), (1, "a# " * 60), (2, "a b c d e f g h i j k")], "doc_id int, text string")
    got = {r.doc_id: r.x for r in df.select("doc_id", listed.rejects(rules.statistics(F.col("text"))).alias("x")).collect()}
    assert got == {0: False, 1: True, 2: True}
    assert str(listed.rules[0][1]) == "symbols_per_word >= 0.5"
    assert changed("a b", 2) == "a changed"
