import random

from pyspark.sql import functions as F

from regiotally.llm import secret_forest as secrets
from tests.llm.cases import documents, empty, prose, row


def _hex(pick, n=40):
    return "".join(pick.choice("0123456789abcdef") for _ in range(n))


def _docs(spark):
    pick, more = random.Random(8), []
    for k in range(60):
        more.append(row(100 + k, f'{prose(40, k)} token = "{_hex(pick)}" {prose(20, k + 90)}', source=f"src/app{k % 5}.py"))
        more.append(row(200 + k, f"{prose(30, k + 200)} {pick.randint(10**15, 10**16 - 1)} {prose(20, k + 300)} water.{k}@mail{k}.example.com", source="docs/x.md"))
    return documents(spark, more)


def test_true_findings_are_told_from_false_ones(spark):
    found = secrets.scan(_docs(spark))
    rows = found.collect()
    assert found.columns == ["doc_id", "place", "value", "path", "score", "is_secret"]
    assert all(0 <= r.score <= 1 and r.is_secret == (r.score >= 0.5) for r in rows)
    true, false = [r for r in rows if 100 <= (r.doc_id or 0) < 200], [r for r in rows if (r.doc_id or 0) >= 200]
    assert len(true) == 60 and len(false) == 120
    assert all(r.is_secret for r in true) and not any(r.is_secret for r in false)


def test_labels_may_be_given(spark):
    rows = secrets.scan(_docs(spark), F.when(F.col("id") >= 100, (F.col("value").contains("@")).cast("int"))).collect()
    assert all(r.is_secret == ("@" in r.value) for r in rows if (r.doc_id or 0) >= 100)


def test_candidates_and_measures(spark):
    docs = spark.createDataFrame([(1, 'a "password": "hunter2x" in ./deadbeef00112233/ now', None, "x"), (2, None, "p", "x"), (3, "", "p", "x")], "doc_id long, text string, source string, value string")
    got = [tuple(r)[1:7] for r in secrets.candidates(docs).orderBy("place").collect()]
    assert got == [(2, "hunter2x", "a", "password", "in", ""), (4, "deadbeef00112233", "hunter2x", "in", "now", "")]
    words = secrets.dictionary(documents(spark), least=1)
    costs = secrets.pair_costs(words)
    assert len(costs) == secrets.CLASSES**2 and max(costs) <= 0
    found = spark.createDataFrame([(1, 0, "housewater12abc", "", "token", "the", "tests/a/b.py", True)], "id long, place int, value string, before2 string, before string, after string, path string, assigned boolean")
    r = secrets.measured(found, spark.createDataFrame([("housewater", 5), ("the", 9)], "word string, n long"), costs).first()
    assert (r.size, r.digits, r.coverage, r.harmless_path, r.path_depth, r.named) == (15.0, 2 / 15, 10 / 15, 1.0, 3.0, 1.0)
    assert r.word_after > 0 and r.word_before == 0 and r.changes == 3 / 15


def test_nothing_to_train_on(spark):
    assert secrets.scan(empty(spark)).count() == 0
    rows = secrets.scan(documents(spark, [row(50, 'x token = "abcdef0123456789abcd"')])).collect()  # true findings only
    assert [(r.doc_id, r.is_secret) for r in rows] == [(50, True)]


FORMS = ['TOKEN={}', "api_key: '{}'", '"client_secret": "{}"', "accessToken := {}", "db.password => `{}`"]


def test_five_ways_to_give_a_value(spark):
    """Every form is found whole and told from numbers, addresses, UUIDs and words; bare values of a kind seen nowhere are judged."""
    pick = random.Random(9)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/!$%#&*="
    secret = lambda: "".join(pick.choice(signs) for _ in range(28)) + "=="
    uuid = lambda: "-".join(_hex(pick, n) for n in (8, 4, 4, 4, 12))
    rows, planted, bare = [], {}, {}
    for k in range(200):
        planted[k] = secret()
        rows.append(row(k, f"{prose(20, k)} {FORMS[k % 5].format(planted[k])}, {prose(20, k + 500)}", source="src/app.py"))
        rows.append(row(1000 + k, f"{prose(20, k + 900)} id {uuid()} {pick.randint(10**17, 10**18)} mail{k}@mail{k}.example.com {prose(9, k)}", source="src/app.py"))
    for k in range(40):
        bare[2000 + k] = _hex(pick, 6) + "".join(pick.choice(signs[:62]) for _ in range(24))
        rows.append(row(2000 + k, f"{prose(20, k + 1500)} {bare[2000 + k]} {prose(9, k)}", source="src/app.py"))
    docs = spark.createDataFrame(rows, documents(spark).schema)
    held = secrets.candidates(docs).filter("assigned").collect()
    assert {r.id: r.value for r in held} == planted  # whole values, no other one
    found = secrets.scan(docs).collect()
    hits = {(r.doc_id, r.value) for r in found if r.is_secret}
    true = set(planted.items())
    recall, wrong = len(hits & true) / len(true), [h for h in hits - true if h[0] < 2000]
    assert recall >= 0.98 and len(wrong) <= 0.02 * len(true)
    assert len(hits & set(bare.items())) >= 0.8 * len(bare)  # without a name, by their looks alone


def test_labels_are_sure_or_none(spark):
    cases = [
        ("x9f8Q2mLk3", True, 0.0, 0.0, 1), ("changeme", True, 1.0, 0.0, 0), ("x9f8Q2mLk3", True, 0.0, 1.0, None), ("4068516892505468", False, 0.0, 0.0, 0),
        ("a.b@c.example.com", False, 0.3, 0.0, 0), ("123e4567-e89b-12d3-a456-426614174000", False, 0.0, 0.0, 0), ("9dd3c80004c73dc9e548fee51b23b527780d4f20", False, 0.0, 0.0, None),
    ]
    df = spark.createDataFrame([(*c, 0.0) for c in cases], "value string, assigned boolean, coverage double, harmless_path double, want int, harmless_near double")
    assert all(r.got == r.want for r in df.withColumn("got", secrets.sure_labels()).collect())
