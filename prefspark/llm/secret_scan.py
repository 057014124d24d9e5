"""Secrets in whole texts: three fixed patterns, and character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.labelled import text_blocks

#: Fixed patterns by kind, in the order in which spans that start together are listed: (pattern, group, least length).
KINDS = {
    "assign": (
        re.compile(
            r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
            r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        ),
        2,
        12,
    ),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile("[0-9a-f]+"), 0, 16),
}
#: Runs of at least 16 hex digits are found faster than all runs, and are the same ones.
_FAST = {"hex": re.compile("[0-9a-f]{16,}")}
MARKOV = "markov"
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
STATES = len(ALPHABET) + 1
ORDINARY, RANDOM = 0, 1
ORDINARY_LENGTH = 6
CANDIDATE_LENGTH = 16
MIN_LOG_RATIO = 24.0
MIN_MEAN_RATIO = 1.5
#: A dip of this much, below the mean asked for, ends a stretch.
DIP = 12.0
BACK_OFF = 10.0
RANDOM_SAMPLES = 2_000


def _states() -> np.ndarray:
    """State of a code point: 1 and up for the alphabet, 0 for all others, which end a run."""
    table = np.zeros(129, dtype=np.uint8)
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i + 1
    return table


STATE_OF = _states()
SEPARATORS = [int(STATE_OF[ord(c)]) for c in "+/_=-"]


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    for number, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        for match in _FAST.get(kind, pattern).finditer(text):
            if match.end(group) - match.start(group) >= least:
                found.append((match.start(), number, match.end(), match.start(group)))
    return sorted(found)


def _runs(texts: list[str]):
    """States of all characters, a 0 after each text; first and past-last position of each run; start of each text."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    states = STATE_OF[np.minimum(codes, 128)]
    edges = np.diff(np.r_[np.int8(0), (states > 0).astype(np.int8)])
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    lengths = np.array([len(t) + 1 for t in texts])
    return states, first, last, np.cumsum(lengths) - lengths


def _steps(states: np.ndarray) -> np.ndarray:
    """Number of the move into each character; a run's first character is reached from state 0."""
    before = np.r_[np.uint8(0), states[:-1]].astype(np.int64)
    return before * STATES + states


def count_moves(texts: list[str]) -> np.ndarray:
    """Moves in ordinary and random strings of texts: values of the fixed patterns are random, other runs ordinary."""
    states, first, last, starts = _runs(texts)
    role = np.zeros(len(states), dtype=np.int8)
    lengths = last - first
    role[np.repeat(first, lengths) + _within(lengths)] = np.repeat(np.where(lengths >= ORDINARY_LENGTH, 1, 0), lengths)
    for text, offset in zip(texts, starts):
        for start, _, end, value in base_spans(text):
            role[offset + start : offset + value] = 0
            role[offset + value : offset + end] = 2
    moves = _steps(states)
    return np.stack([np.bincount(moves[role == r], minlength=STATES * STATES) for r in (1, 2)])


def _within(lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def corpus_samples(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``is_random, move, n``: moves of all labelled strings of the corpus, summed by Spark; at most 2 x 68 x 68 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, STATES * STATES), dtype=np.int64)
        for batch in batches:
            for _, texts in text_blocks(batch, "_text"):
                total += count_moves(texts)
        role, move = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(role.astype(np.int32)), pa.array(move.astype(np.int32)), pa.array(total[role, move])],
            names=["is_random", "move", "n"],
        )

    counted = df.select(F.col(text_col).alias("_text")).mapInArrow(run, "is_random int, move int, n bigint")
    return counted.groupBy("is_random", "move").agg(F.sum("n").alias("n"))


def generated_samples(samples: int = RANDOM_SAMPLES, seed: int = 3) -> np.ndarray:
    """Moves of uniform random strings over the alphabet, so that random kinds rare in the corpus are known too."""
    rng = random.Random(seed)
    total = np.zeros(STATES * STATES, dtype=np.int64)
    for _ in range(samples):
        run = STATE_OF[[ord(c) for c in rng.choices(ALPHABET[:62], k=32)]]
        total += np.bincount(_steps(run), minlength=STATES * STATES)
    return total


@dataclass
class MarkovModel:
    """Log-likelihood ratio, random against ordinary, of each move."""

    ratio: np.ndarray


def fit(samples: DataFrame, extra: np.ndarray | None = None) -> MarkovModel:
    """Both first-order models from counted moves of labelled strings, backed off to the frequency of characters.

    Moves to and from a separator join parts of either kind and are no evidence.
    """
    counts = np.zeros((2, STATES * STATES))
    for row in samples.collect():
        counts[row.is_random, row.move] = row.n
    counts[RANDOM] += generated_samples() if extra is None else extra
    tables = counts.reshape(2, STATES, STATES)[:, :, 1:]
    single = tables.sum(axis=1, keepdims=True) + 1
    single /= single.sum(axis=2, keepdims=True)
    logs = np.log((tables + BACK_OFF * single) / (tables.sum(axis=2, keepdims=True) + BACK_OFF))
    ratio = np.zeros((STATES, STATES))
    ratio[:, 1:] = logs[RANDOM] - logs[ORDINARY]
    ratio[:, SEPARATORS], ratio[SEPARATORS, :] = 0, 0
    return MarkovModel(ratio.ravel())


def _best_sums(scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Highest sum of any stretch inside each segment of ``scores``, by one cumulative sum for all."""
    segment, starts = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
    upto = np.cumsum(scores)
    before = upto - scores
    # Each segment lies below all earlier ones, so that the running minimum starts anew.
    below = segment * (np.ptp(before) + 1.0)
    return np.maximum.reduceat(upto - (np.minimum.accumulate(before - below) + below), starts)


def _dense_stretches(ratio: list[float]) -> list[tuple[int, int]]:
    """Stretches whose ratio stays above MIN_MEAN_RATIO a character, apart from dips of less than DIP, left to right."""
    found, start, total, best, end, at = [], 0, 0.0, 0.0, 0, 0
    while at < len(ratio):
        total += ratio[at] - MIN_MEAN_RATIO
        at += 1
        if total > best:
            best, end = total, at
        if total <= 0 or total < best - DIP or at == len(ratio):
            if best > 0:
                found.append((start, end))
                at = end
            start, total, best, end = at, 0.0, 0.0, at
    return found


def _random_spans(states: np.ndarray, model: MarkovModel, least: float) -> list[tuple[int, int]]:
    """Stretches of ``states`` that the random model explains better, none of them touching another.

    A run none of whose stretches reaches ``least`` is done with. In the others dense stretches are looked for; each takes in the rest
    of the parts, between separators, that it lies in where the mean allows, and counts if its ratio reaches ``least``. So a secret is
    found behind an ordinary path and beside another secret.
    """
    edges = np.diff(np.r_[np.int8(0), (states > 0).astype(np.int8), np.int8(0)])
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = last - first >= CANDIDATE_LENGTH
    first, last = first[long], last[long]
    if not len(first):
        return []
    ratio, lengths, found = model.ratio[_steps(states)], last - first, []
    hit = _best_sums(ratio[np.repeat(first, lengths) + _within(lengths)], lengths) >= least
    for low, high in zip(first[hit].tolist(), last[hit].tolist()):
        free = low
        for start, end in _dense_stretches(ratio[low:high].tolist()):
            a, b = max(low + start, free), low + end
            wide, far = a, b
            while wide > free and states[wide - 1] not in SEPARATORS:
                wide -= 1
            while far < high and states[far] not in SEPARATORS:
                far += 1
            if ratio[wide:far].sum() >= MIN_MEAN_RATIO * (far - wide):
                a, b = wide, far
            if b - a >= CANDIDATE_LENGTH and ratio[a:b].sum() >= max(least, MIN_MEAN_RATIO * (b - a)):
                found.append((a, b))
                free = b
    return found


def find(texts: list[str], model: MarkovModel, least: float = MIN_LOG_RATIO) -> list[list[tuple[str, int, int]]]:
    """Spans (kind, start, end) per text: those of the fixed patterns, and random stretches of what these leave."""
    states, _, _, starts = _runs(texts)
    states, names = states.copy(), list(KINDS)
    spans = [[(start, number, end) for start, number, end, _ in base_spans(text)] for text in texts]
    for base, offset in zip(spans, starts.tolist()):
        for start, _, end in base:
            states[offset + start : offset + end] = 0
    added = _random_spans(states, model, least)
    owner = np.searchsorted(starts, [a for a, _ in added], side="right") - 1
    for i, (a, b) in zip(owner.tolist(), added):
        spans[i].append((a - int(starts[i]), len(names), b - int(starts[i])))
    return [[([*names, MARKOV][number], start, end) for start, number, end in sorted(own)] for own in spans]


def scan(df: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans`` for every row; ``spans`` lists (kind, start, end) in code points, by start, end exclusive.

    Whole texts are read. Null and empty texts have no spans. Null ids and repeated rows pass through; other columns
    are ignored. No rows in, no rows out. The model is two small tables, whatever the corpus.
    """
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_blocks(batch, "_text"):
                spans = [
                    [{"kind": k, "start": a, "end": b} for k, a, b in found] for found in find(texts, model)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(start, len(texts)), pa.array(spans, span)], names=[id_col, "spans"]
                )

    chosen = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
