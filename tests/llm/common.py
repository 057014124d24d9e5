"""Small tables with the cases every operator has to bear."""

from __future__ import annotations

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "digest string, _id string, _text string, key string, n int, size int, draw string, label int, lines int"


def documents(spark, rows, clashing: bool = False):
    """Rows of (doc_id, text[, lang[, source]]); on request with columns named like the operators' own."""
    filled = [(*row, *(None,) * (4 - len(row)), len(row[1] or "")) for row in rows]
    if not clashing:
        return spark.createDataFrame(filled, DOCUMENTS)
    return spark.createDataFrame(
        [(*row, "x", "y", "z", "k", 1, 2, "d", 1, 3) for row in filled], f"{DOCUMENTS}, {CLASHING}"
    )


EDGE_TEXTS = [None, "", " \t\n", "one", "é" * 30, "word " * 60_000, "a\nb\n", "x" * 100_000]
EDGES = [
    *[(i, text, "en", "s") for i, text in enumerate(EDGE_TEXTS, start=1)],
    (None, "without an id", None, None),
    (None, None, None, None),
    (50, "said twice over", "en", None),
    (50, "said twice over", "en", None),
    (51, "said twice over", "en", "t"),
]
