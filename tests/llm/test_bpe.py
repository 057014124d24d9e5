import hashlib
import random

import pytest
from prefspark.llm import bpe
from tests.llm.common import EDGES, documents

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_random_texts_against_the_library(reference):
    rng = random.Random(4)
    ranges = [(32, 127), (32, 0x500), (0x300, 0x370), (0x1100, 0x1200), (0x1F00, 0x2100), (0, 0xD800), (0x10000, 0x20000)]
    texts = [
        "".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(50))) for _ in range(600)
    ]
    texts += ["", "a" * 3_000, "ab" * 2_001, "<|endoftext|>A<|startoftext|>", "ΑΣ ΣΑΣ İ K", "it's THEY'RE 'sad", "!" * 999]
    model = bpe.load(PATH)
    for (pieces, written), wanted in zip(model.encode(texts), reference.encode_batch(texts, add_special_tokens=False)):
        ids = [int(i) for piece in pieces for i in piece]
        assert ids == wanted.ids
        assert " ".join(written) == " ".join(map(str, wanted.ids))


def test_columns(spark, reference):
    rows = bpe.encode_decode(documents(spark, EDGES, clashing=True), tuple(bpe.OUTPUTS), path=PATH).collect()
    assert len(rows) == len(EDGES)
    texts = {}
    for i, text, *_ in EDGES:
        texts.setdefault(i, []).append(text or "")
    for r in rows:
        options = [reference.encode(t, add_special_tokens=False).ids for t in texts[r.doc_id]]
        assert r.ids in options and r.n_tokens == len(r.ids)
        text = reference.decode(r.ids, skip_special_tokens=False)
        assert r.decoded == text and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()


def test_stored_ids_decode_alike(spark):
    rows = bpe.encode_decode(documents(spark, EDGES[:4]), ("ids", "decoded"), path=PATH)
    again = bpe.decode(rows.select("doc_id", "ids"), path=PATH)
    assert sorted((r.doc_id, r.decoded) for r in again.collect()) == sorted((r.doc_id, r.decoded) for r in rows.collect())


def test_empty_table(spark):
    assert bpe.encode_decode(documents(spark, []), path=PATH).count() == 0
