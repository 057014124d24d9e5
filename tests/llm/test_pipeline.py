"""The stages, one after another, each against a plain version on what the one before kept."""

import hashlib
import os
from collections import Counter

import pytest

import corpus_pipeline
from prefspark.llm import bpe, mixing, near_dedup
from prefspark.session import settle
from tests.llm.common import EDGES, documents
from tests.llm.test_near_dedup import expected as near_expected

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def test_stages_against_plain_versions(spark):
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before, docs = [tuple(r) for r in given.collect()], given
    for name, stage in corpus_pipeline.STAGES:
        result = settle(stage(spark, docs, SF_DIR), f"test_{name}")
        rows = [tuple(r) for r in result.collect()]
        if name != "bpe":
            assert result.columns == COLUMNS and set(rows) <= set(before)
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
            kept = {r[0] for r in rows}
            known = [(labels[r[0]], r[0] in kept) for r in before if r[0] in labels]
            assert sum(stays == (not toxic) for toxic, stays in known) >= 0.9 * len(known)
        elif name == "exact_dedup":
            last = {}
            for r in before:
                last[r[1]] = max(last.get(r[1], r[0]), r[0])
            assert sorted(r[0] for r in rows) == sorted(last.values())
        elif name == "near_dedup":
            assert sorted(r[0] for r in rows) == [i for i, _, _, kept in near_expected(before) if kept]
        elif name == "source_mix":
            times = {r.doc_id: r.taken // max(1, r["size"]) for r in mixing.mix(docs)[1].collect()}
            assert Counter(r[0] for r in rows) == {i: n for i, n in times.items() if n}
        else:
            library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.load(None).path)
            texts = {r[0]: r[1] for r in before}
            assert Counter(r[0] for r in rows) == Counter(r[0] for r in before)
            for r in result.collect():
                ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
                assert r.n_tokens == len(ids)
                assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
                assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        before, docs = rows, result


@pytest.mark.parametrize("rows", [EDGES, []])
def test_edges_pass_every_stage(spark, tmp_path, rows):
    spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    docs = settle(documents(spark, rows, clashing=True), "edge_docs")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, str(tmp_path)), f"edge_{name}")
        assert name == "bpe" or docs.columns == columns
        if name == "exact_dedup" and rows:
            assert docs.groupBy("text").count().where("count > 1").count() <= 1
    assert docs.count() <= 3 * len(rows)


def test_near_copies_without_an_id_are_dropped(spark):
    words = {name: [f"{name}{i}" for i in range(150)] for name in "abc"}

    def copy(name, at):
        return " ".join([*words[name][:at], "other", *words[name][at + 1 :]])

    rows = [(7, copy("a", 20)), (None, copy("a", 20).upper()), (None, copy("a", 90)), (None, copy("b", 30))]
    rows += [(None, copy("b", 60)), (None, copy("b", 60).upper()), (None, copy("b", 110)), (None, copy("c", 5)), (None, "")]
    docs = documents(spark, rows, clashing=True)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    first = sorted(r.text[:1].lower() for r in kept.collect())
    assert first == ["", "a", "b", "c"]
    assert [r.text for r in kept.where("doc_id = 7").collect()] == [copy("a", 20)]
    decided = near_dedup.near_dedup(docs).collect()
    assert len(decided) == len(rows) and sum(r.kept for r in decided) == 4
    assert [r.component_id for r in decided].count(7) == 3
