import random
import re

import numpy as np
from prefspark.llm import secret_scan
from tests.llm.common import EDGES, documents

_PLAIN = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]


def plain(text):
    found = []
    for n, (kind, pattern, group, least) in enumerate(_PLAIN):
        for m in re.finditer(pattern, text or "", re.ASCII | (re.IGNORECASE if kind == "assign" else 0)):
            if len(m.group(group)) >= least:
                if kind == "assign":
                    assert re.fullmatch("[A-Za-z0-9+/_.=-]+", m.group(2))
                found.append((m.start(), n, m.end()))
    return [(_PLAIN[n][0], a, b) for a, n, b in sorted(found)]


def texts():
    rng = random.Random(8)
    parts = ["password", "API_KEY", "apikey", "Token", "secret", "pass", ":", "=", " ", '"', "'", "AKIA", "ſecret"]
    parts += ["ABCDEFGH1234567", "deadbeef0123", "0123456789abcdef", "hello", "é", "\n", "x-y_z.w/+", "K", "AKIAAKIA"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(400)]


def model(spark, rows):
    return secret_scan.fit(secret_scan.corpus_samples(documents(spark, rows)))


def test_base_spans_against_plain_patterns(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(1_000 + i, row[1]) for i, row in enumerate(EDGES)]
    scanned = secret_scan.scan(documents(spark, rows, clashing=True), model(spark, rows)).collect()
    known = dict(rows)
    assert len(scanned) == len(rows)
    for r in scanned:
        base = [(s.kind, s.start, s.end) for s in r.spans if s.kind != secret_scan.MARKOV]
        assert base == plain(known[r.doc_id])
        for s in r.spans:
            if s.kind == secret_scan.MARKOV:
                assert not any(a < s.end and s.start < b for _, a, b in base)


def test_models_tell_random_strings_from_identifiers(spark):
    names = "getDocumentIdentifier MAX_CONNECTION_RETRY_COUNT documentation_of_interest internationalization".split()
    prose = "the configuration of connections between documents is an identifier of interest " * 50
    learnt = model(spark, [(1, prose), (2, " ".join(names)), (3, "token = 3fa94be07c1d5826ab90cd73ef41")])
    rng = random.Random(5)
    secrets = ["".join(rng.choices(secret_scan.ALPHABET[:62], k=32)) for _ in range(50)]
    assert all(secret_scan.find([f"key {s} end"], learnt) == [[("markov", 4, 36)]] for s in secrets)
    assert secret_scan.find(names + [prose, "-" * 80, "=" * 40], learnt) == [[]] * 7


def test_empty_table(spark):
    learnt = model(spark, [])
    assert secret_scan.scan(documents(spark, []), learnt).count() == 0
    assert secret_scan.scan(documents(spark, [(1, None)]), learnt).first().spans == []


def prose_model(spark):
    names = "getDocumentIdentifier MAX_CONNECTION_RETRY_COUNT documentation_of_interest internationalization".split()
    prose = "the configuration of connections between documents is an identifier of interest " * 50
    paths = "https://example.com/some/long/ordinary/path/of-documents/index_page users/home/projects/reports " * 20
    return model(spark, [(1, prose + paths), (2, " ".join(names)), (3, "token = 3fa94be07c1d5826ab90cd73ef41")])


def test_tokens_inside_longer_runs_are_found_and_ordinary_runs_are_not(spark):
    learnt, rng = prose_model(spark), random.Random(6)
    prefixes = ["https://example.com/some/long/ordinary/path/of-documents/", "key=", "users/home/projects/", "documentation_of_interest-", "index_page/"]
    for size, share in ((20, 0.8), (24, 0.95), (32, 0.98)):
        hits = 0
        for n in range(300):
            prefix, token = prefixes[n % len(prefixes)], "".join(rng.choices(secret_scan.ALPHABET[:62], k=size))
            spans = [(a, b) for k, a, b in secret_scan.find([f"see {prefix}{token}/index end"], learnt)[0] if k == "markov"]
            start = 4 + len(prefix)
            hits += any(min(b, start + size) - max(a, start) >= 0.8 * size and b - a <= 1.5 * size for a, b in spans)
        assert hits >= share * 300, (size, hits)
    ordinary = [f"{p}{q}" for p in prefixes for q in prefixes] + ["internationalization_of_documents/configuration-of-connections" * 5]
    assert secret_scan.find(ordinary, learnt) == [[]] * len(ordinary)


def test_base_spans_are_cut_out_of_a_run_and_several_tokens_are_apart(spark):
    learnt, rng = prose_model(spark), random.Random(7)
    one, two = ("".join(rng.choices(secret_scan.ALPHABET[:62], k=32)) for _ in range(2))
    found = secret_scan.find([f"deadbeefdeadbeef00/{one}", f"x {one}/some/long/ordinary/path/of-documents/{two}", "", "q" * 200_000], learnt)
    assert found[0] == [("hex", 0, 18), ("markov", 19, 51)]
    assert [k for k, _, _ in found[1]] == ["markov", "markov"] and found[1][0][1:] == (2, 34) and found[1][1][2] == len(f"x {one}/some/long/ordinary/path/of-documents/{two}")
    assert found[2] == []


def test_the_best_sum_of_each_segment_and_dense_stretches():
    rng = random.Random(1)
    for _ in range(200):
        lengths = np.array([rng.randint(1, 12) for _ in range(rng.randint(1, 5))])
        scores = np.array([rng.choice([-2.0, -1.0, 0.0, 0.5, 1.0, 3.0]) for _ in range(lengths.sum())])
        best = secret_scan._best_sums(scores, lengths)
        for i, base in enumerate(np.cumsum(lengths) - lengths):
            own = scores[base : base + lengths[i]]
            assert best[i] == max(own[a:b].sum() for a in range(len(own)) for b in range(a + 1, len(own) + 1))
    dense, sparse = [3.0] * 20, [-2.0] * 12
    assert secret_scan._dense_stretches(sparse + dense + sparse + dense + [0.0] * 3) == [(12, 32), (44, 64)]
    assert secret_scan._dense_stretches(dense + [0.0] * 3 + dense) == [(0, 43)] and secret_scan._dense_stretches(sparse) == []
