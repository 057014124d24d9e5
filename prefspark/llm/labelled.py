"""Help for operators that learn from labelled documents and score whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.session import settle

BLOCK_CHARS = 1_000_000


def remainder(id_col: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, *columns: str
) -> DataFrame:
    """``doc_id, label`` and columns of about ``rows`` labelled documents for which ``learn`` holds, written once.

    Chosen by a hash of the id, so every run takes the same ones. The chosen labels number about ``rows`` at any size of
    the corpus; that bound is what allows to broadcast them, and no text is shuffled. Labels other than 0 and 1 do not
    teach; of several labels of one document the largest counts.
    """
    valid = labels.where(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("long").alias("label"))
    share = min(1.0, rows / max(1, valid.count()))
    chosen = valid.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    return settle(documents.select("doc_id", *columns).join(F.broadcast(chosen), "doc_id"), f"sample_{label}")


def text_blocks(batch: pa.RecordBatch, column: str, chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch, at least one row and about ``chars`` characters at a time; null is empty."""
    start, texts, held = 0, [], 0
    for at, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        if texts and held + len(text) > chars:
            yield start, texts
            start, texts, held = at, [], 0
        texts.append(text)
        held += len(text)
    if texts:
        yield start, texts
