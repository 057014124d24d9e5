from collections import defaultdict

from prefspark.llm.line_dedup import line_dedup
from tests.llm.common import EDGES, documents

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, chars=40, docs=5):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(_LOWER)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars and i is not None:
                holders[key(line)].add(i)
    common = {k: max(v) for k, v in holders.items() if len(v) >= docs}
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common or common[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=str)


SHARED = "This line belongs to a licence that MANY documents repeat É"


def test_against_plain_python(spark):
    rows = list(EDGES)
    for i in range(100, 112):
        spaced = f"  {SHARED.upper() if i % 2 else SHARED.lower()}\t" if i % 3 else SHARED
        rows.append((i, f"own {i}\n{spaced}\nshort shared\n{SHARED}\n" + ("tail " * 10 if i > 108 else "")))
    rows += [(None, SHARED), (110, f"{SHARED}\nanother text of a known id")]
    assert found(line_dedup(documents(spark, rows, clashing=True))) == expected(rows)


def test_one_line_below_the_limit_stays(spark):
    rows = [(i, SHARED) for i in range(4)] + [(0, SHARED)]
    assert all(r.n_dropped == 0 for r in line_dedup(documents(spark, rows)).collect())


def test_empty_table(spark):
    assert line_dedup(documents(spark, [])).count() == 0
