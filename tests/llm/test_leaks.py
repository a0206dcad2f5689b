import random

from regiotally.llm import latent_leaks as leaks
from tests.llm.cases import documents, empty, prose, row


def lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(line[j - 1] + 1 if x == y else max(line[j], new[-1]))
        line = new
    return line[-1]


def test_common_subsequence():
    pick = random.Random(4)
    for _ in range(300):
        a, b = ([pick.choice("abcd") for _ in range(pick.randint(0, 80))] for _ in range(2))
        assert leaks.common_subsequence(a, b) == lcs(a, b)


def _benchmark(spark, n=30):
    texts = [" ".join(f"q{k}w{i}" if i % 3 else "the" for i in range(30)) + f". answer{k} is of{k}" for k in range(n)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(100, None, "x"), (101, "", "x"), (102, "too short", "x"), (None, "null id item of seven words here", "x")]
    return texts, spark.createDataFrame(rows, "item_id long, text string, item string")


def test_leaks_and_paraphrases_are_found(spark):
    texts, benchmark = _benchmark(spark)
    pick = random.Random(6)
    more = []
    for k, text in enumerate(texts):
        words = text.split()
        if k % 3 == 1:  # a paraphrase: every eighth word is another one
            words = [w if i % 8 else "other" for i, w in enumerate(words)]
        if k % 3 == 2:  # only the first half
            words = words[: len(words) // 2]
        around = prose(pick.randint(0, 400), 500 + k).split()
        at = pick.randint(0, len(around))
        more.append(row(200 + k, " ".join(around[:at] + words + around[at:])))
    docs = documents(spark, more)
    got = {(r.doc_id, r.item_id) for r in leaks.contaminations(docs, benchmark).collect()}
    assert got == {(200 + k, k) for k in range(len(texts)) if k % 3 != 2}
    kept = docs.filter(~leaks.leaking(docs, benchmark))
    assert kept.columns == docs.columns and kept.count() == docs.count() - 20


def test_common_words_are_looked_for_verbatim(spark):
    item = "the house and the river"  # words that every passage has
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [row(k, prose(60, k)) for k in range(20)] + [row(50, prose(40, 60) + " The house, and the River! " + prose(40, 61))]
    docs = spark.createDataFrame(rows, documents(spark).schema)
    assert [(r.doc_id, r.item_id) for r in leaks.contaminations(docs, benchmark).collect()] == [(50, 1)]


def test_nothing_to_find(spark):
    texts, benchmark = _benchmark(spark)
    assert leaks.contaminations(empty(spark), benchmark).count() == 0
    none = benchmark.limit(0)
    assert leaks.contaminations(documents(spark), none).count() == 0
    assert documents(spark).filter(~leaks.leaking(documents(spark), none)).count() == documents(spark).count()


def test_every_verbatim_item_of_the_tables(spark, small):
    import re

    words = lambda t: f" {' '.join(re.findall(r'\w+', t.lower()))} "
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    from regiotally.llm.queries import op4_latent_leaks

    got = {(r.doc_id, r.item_id) for r in op4_latent_leaks(spark, small).collect()}
    assert got == {(d, i) for d, x in docs.items() for i, y in items.items() if y in x}


def test_widespread_paraphrases_are_found(spark):
    """A paraphrase in a third of the documents makes its own words frequent; it is found as a single one is."""
    item = [f"q{i}" for i in range(24)]
    said = " ".join("other" if i % 8 == 3 else w for i, w in enumerate(item))
    for many in (1, 100):
        docs = spark.createDataFrame([row(k, prose(40, k) + (f" {said} " if k < many else " ") + prose(40, k + 900)) for k in range(300)], documents(spark).schema)
        benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
        assert {r.doc_id for r in leaks.contaminations(docs, benchmark).collect()} == set(range(many))
        assert docs.filter(~leaks.leaking(docs, benchmark)).count() == 300 - many


def test_recall_equals_brute_force(spark):
    """Paraphrases without their rarest words, and lists of short items, among other words of the same language."""
    pick = random.Random(9)
    usual = [f"w{int(pick.paretovariate(0.6)) % 3000}" for _ in range(60_000)]
    items = [pick.sample(usual, n) for n in [*range(5, 65), *[5, 6, 7, 8, 9] * 8]]
    texts = []
    for k in range(150):
        around = [pick.choice(usual) for _ in range(pick.randint(20, 700))]
        planted = [pick.randrange(len(items)) for _ in range(pick.choice([1, 1, 8]))]
        inside = []
        for p in planted:
            words = list(items[p])
            for i in sorted(range(len(words)), key=lambda i: -int(words[i][1:]))[: len(words) // 5 if k % 2 else 0]:
                words[i] = "changed"
            inside += words
        at = pick.randint(0, len(around))
        texts.append((around[:at] + inside + around[at:], planted))
    docs = spark.createDataFrame([row(k, " ".join(words)) for k, (words, _) in enumerate(texts)], documents(spark).schema)
    benchmark = spark.createDataFrame([(k, " ".join(words)) for k, words in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.contaminations(docs, benchmark).collect()}
    assert got >= {(k, p) for k, (_, planted) in enumerate(texts) for p in planted}
    for k, (words, _) in enumerate(texts[:25]):
        for p, item in enumerate(items):
            span = len(item) * 4 // 3 if len(item) < leaks.SHORT else leaks.PASSAGE + 2 * len(item)
            starts = range(0, len(words)) if len(item) < leaks.SHORT else range(0, len(words), 7)
            if any(leaks.common_subsequence(item, words[i : i + span]) >= 0.75 * len(item) for i in starts):
                assert (k, p) in got
