import hashlib

from regiotally.llm import merkle_audit as audit, queries

SCHEMA = "page_id long, url string, html string, offset long, digest string, node long"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", 2) for i, u, h in rows], SCHEMA)


def record(url, html):
    body = (html or "").encode()
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


ROWS = [(k, f"http://x/{k % 7}", "é" * (k * 37 % 900)) for k in range(300)] + [(300, None, None), (301, "u", ""), (302, "long", "w" * 300_000), (5, "twice", "z"), (5, "twice", "z"), (None, "n", "q")]


def test_offsets_and_digests(spark):
    got = sorted((r.offset, r.length, r.digest) for r in audit.leaves(frame(spark, ROWS), "page_id").collect())
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(record(*r[1:])).hexdigest()))
    want, at = [], 0
    for _, url, html in order:
        text = record(url, html)
        want.append((at, len(text), hashlib.sha256(text).hexdigest()))
        at += len(text)
    assert got == want


def test_damage_is_located(spark):
    own = audit.written(audit.leaves(frame(spark, ROWS), "page_id"), "test")
    rows = own.collect()
    assert audit.damage(audit.tree(own, 4096, 4), audit.tree(own, 4096, 4), 4).count() == 0
    worse, want = [], []
    for r in rows:
        if r.key is not None and r.key % 50 == 3:
            want.append((r.key, r.offset, r.length, "missing"))
        elif r.key is not None and r.key % 50 == 11:
            worse.append((r.key, r.offset, r.length, "bad"))
            want.append((r.key, r.offset, r.length, "changed"))
        elif r.key is not None and r.key % 50 == 20:
            worse.append((r.key, r.offset, r.length - 1, r.digest))
            want.append((r.key, r.offset, r.length, "changed"))
        else:
            worse.append(tuple(r))
    worse.append((999, 10**9, 5, "new"))
    want.append((999, 10**9, 5, "extra"))
    other = spark.createDataFrame(worse, own.schema)
    got = [tuple(r) for r in audit.damage(audit.tree(own, 4096, 4), audit.tree(other, 4096, 4), 4).collect()]
    assert sorted(got) == sorted(want)


def test_order_counts(spark):
    own = [(k, 100 * k, 100, f"d{k}") for k in range(50)]
    other = [(k, 100 * k, 100, f"d{ {7: 8, 8: 7}.get(k, k)}") for k in range(50)]
    trees = [audit.tree(spark.createDataFrame(r, "key long, offset long, length long, digest string"), 1000, 2) for r in (own, other)]
    assert [r.key for r in audit.damage(*trees, 2).orderBy("key").collect()] == [7, 8]


def test_empty_archives(spark):
    none = audit.leaves(frame(spark, []), "page_id")
    assert none.count() == 0
    some = audit.leaves(frame(spark, ROWS[:3]), "page_id")
    assert audit.damage(audit.tree(none), audit.tree(none)).count() == 0
    assert {r.status for r in audit.damage(audit.tree(some), audit.tree(none)).collect()} == {"missing"}


def test_query_leaves_undamaged_pages_alone(spark, tmp_path):
    """Pages without an id, repeated ids and repeated pages: only what the replica lost or changed is told."""
    pages = [(k, "u", f"body {k} " * 20) for k in range(600)] + [(None, "n", "q"), (None, "n", "q"), (None, "m", "r")]
    pages += [(7, "other", "second page of one id"), (8, "u", "body 8 " * 20), (9, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in queries.op5_merkle_audit(spark, str(tmp_path)).select("page_id", "status").collect()]
    want = []
    for k, _, html in pages:
        kind = hashlib.md5(str(k).encode()).hexdigest()[:2] if k is not None else ""
        if kind == "00":
            want.append((k, "missing"))
        elif kind in ("01", "02") and html:
            want.append((k, "changed"))
    assert want and sorted(got) == sorted(want)
