import base64
import hashlib
import os
from collections import defaultdict

import pytest
from prefspark.llm import warc
from prefspark.session import work_path

SCHEMA = "page_id bigint, url string, html string, key string, payload string, role int, shard int"


def pages(spark, rows):
    return spark.createDataFrame([(*row, "k", "p", 7, 9) for row in rows], SCHEMA)


def corpus():
    rows = [(i, f"http://x/{i}\r\nInjected: y", f"<p>{i % 40}</p>" * (1 + i % 5)) for i in range(300)]
    rows += [(i, None, "<html>a very common page é</html>") for i in range(300, 600)]
    rows += [(600, "u", None), (601, "u", ""), (602, "u", "x" * 300_000), (602, "v", "y"), (603, "u", "twice")]
    rows += [(603, "u", "twice"), (None, "u", "twice"), (None, None, "only without an id"), (None, None, None)]
    return rows


def expected(rows, least=0):
    keeper = defaultdict(lambda: None)
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None and len(body) >= least:
            keeper[body] = i if keeper[body] is None else max(i, keeper[body])
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        refers = keeper[body] if keeper[body] is not None and keeper[body] != i else None
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def read(spark, manifest, root):
    return warc.read_archives(spark, manifest, root).collect()


@pytest.mark.parametrize("least", [0, 40])
def test_round_trip(spark, least):
    root = work_path(spark, "warc-test")
    manifest = warc.write_archives(pages(spark, corpus()), root, min_bytes=least, shard_bytes=20_000, roll_bytes=3_000)
    rows = read(spark, manifest, root)
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(found, key=str) == expected(corpus(), least)
    bodies = {(r.page_id, r.payload_digest): bytes(r.payload) for r in rows if r.payload is not None}
    for i, _, html in corpus():
        digest = warc.payload_digest((html or "").encode())
        assert bodies.get((i, digest), (html or "").encode()) == (html or "").encode()
    files = sorted(r.path for r in manifest.collect())
    assert len(files) > 5 and all(os.path.exists(f) for f in files)
    assert sum(r.records for r in manifest.collect()) == len(corpus())


def test_same_rows_give_the_same_files(spark):
    described = []
    for parts in (1, 7):
        root = work_path(spark, "warc-test")
        manifest = warc.write_archives(pages(spark, corpus()).repartition(parts), root, shard_bytes=20_000)
        described.append(sorted((os.path.basename(r.path), r.bytes, r.sha256) for r in manifest.collect()))
    assert described[0] == described[1]


def test_a_changed_payload_is_noticed():
    record = warc.record(1, "u", b"hello", None)
    assert warc.parse(record)["payload"] == b"hello"
    with pytest.raises(ValueError):
        warc.parse(record.replace(b"hello", b"jello"))


def test_empty_table(spark):
    root = work_path(spark, "warc-test")
    manifest = warc.write_archives(pages(spark, []), root)
    assert manifest.count() == 0 and read(spark, manifest, root) == []


def test_rows_without_an_id_and_of_one_id_are_dealt(spark):
    """A third of the bytes without an id and a third of one id: several shards each, of about equal bytes."""
    text = lambda i: f"<p>{hashlib.sha256(str(i).encode()).hexdigest() * 20}</p>"
    rows = [(page, "u", text(3 * i + n)) for i in range(200) for n, page in enumerate((None, 7, 1_000 + i))]
    rows += [(-5, "u", text(0)), (-(2**63), "u", "least"), (2**63 - 1, "u", "largest")]
    root = work_path(spark, "warc-test")
    manifest = warc.write_archives(pages(spark, rows), root, shard_bytes=40_000, roll_bytes=300)
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read(spark, manifest, root)]
    assert sorted(found, key=str) == expected(rows)
    held = defaultdict(int)
    for r in manifest.collect():
        held[r.shard] += r.records
    total = sum(len(t) for _, _, t in rows)
    assert len(held) == -(-total // 40_000) and max(held.values()) < 2 * len(rows) / len(held)
    assert all(manifest.where(f"shard = {shard}").count() > 1 for shard in list(held)[:2])
