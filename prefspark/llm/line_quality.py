"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.labelled import text_blocks

TRAIN_ROWS = 6_000
#: Lines of a training sequence; longer texts teach as several sequences. Scoring takes whole texts.
TRAIN_LINES = 64
STEPS = 120
THRESHOLD = 0.7
UPPER, DIGIT, SPACE, BAR, SYMBOL, LETTER = range(6)
OWN = ("upper", "symbol", "digit", "bars", "echo", "repeats", "length", "word_length", "seen", "empty")
#: A line's own features, those of its neighbours, whether it has them, and a constant.
WIDTH = 3 * len(OWN) + 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Kind of a character below U+3000; all above count as letters."""
    kinds = np.full(0x3001, LETTER, dtype=np.uint8)
    for code in range(0x3000):
        c = chr(code)
        if c.isspace():
            kinds[code] = SPACE
        elif c == "|":
            kinds[code] = BAR
        elif c.isupper():
            kinds[code] = UPPER
        elif c.isdigit():
            kinds[code] = DIGIT
        elif not c.isalpha():
            kinds[code] = SYMBOL
    return kinds


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters, lines per text) of all lines of the texts, in order."""
    lines, counts, words_rows = [], [], []
    for text in texts:
        own = text.split("\n")
        lines.extend(own)
        counts.append(len(own))
        seen: set[str] = set()
        for line in own:
            words = line.split()
            n = max(1, len(words))
            echo = sum(map(eq, words, words[1:])) / n
            words_rows.append((n, echo, 1 - len(set(words)) / n if words else 0.0, line in seen))
            if words:
                seen.add(line)
    lengths = np.array([len(line) for line in lines])
    joined = "\n".join(lines) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _classes()[np.minimum(codes, 0x3000)]
    starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    count = {k: np.add.reduceat((kinds == k).astype(np.int32), starts) for k in (UPPER, DIGIT, BAR, SYMBOL, LETTER)}
    words = np.array(words_rows, dtype=np.float64).reshape(-1, 4)
    chars, size = np.maximum(lengths, 1), words[:, 0]
    own = np.stack(
        [
            count[UPPER] / np.maximum(count[UPPER] + count[LETTER], 1),
            count[SYMBOL] / chars,
            count[DIGIT] / chars,
            np.minimum(count[BAR] / size, 1),
            words[:, 1],
            words[:, 2],
            np.minimum(np.log1p(lengths) / 8, 1),
            np.minimum(lengths / size / 20, 1),
            words[:, 3],
            lengths == 0,
        ],
        axis=1,
    ).astype(np.float32)
    return own, chars, np.array(counts)


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features beside those of the line before and after inside the same text (zeros where there is none)."""
    ends = np.cumsum(counts)
    first = np.zeros(len(own), dtype=bool)
    first[ends - counts] = True
    last = np.zeros(len(own), dtype=bool)
    last[ends - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after, first[:, None], last[:, None], np.ones((len(own), 1), dtype=own.dtype)])


def _chain(unary: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of 'good' per line; all texts advance together, one line at a time."""
    order = np.argsort(-counts, kind="stable")
    starts, sizes = (np.cumsum(counts) - counts)[order], counts[order]
    forward, backward = unary.astype(np.float64).copy(), np.zeros(len(unary))
    live = np.searchsorted(-sizes, -np.arange(2, sizes.max() + 1), side="right")
    for step, n in enumerate(live, start=1):
        at = starts[:n] + step
        odds = forward[at - 1]
        forward[at] += np.logaddexp(moves[0, 1], odds + moves[1, 1]) - np.logaddexp(moves[0, 0], odds + moves[1, 0])
    for step, n in zip(range(len(live), 0, -1), live[::-1]):
        at = starts[:n] + step
        odds = unary[at] + backward[at]
        backward[at - 1] = np.logaddexp(moves[1, 0], odds + moves[1, 1]) - np.logaddexp(
            moves[0, 0], odds + moves[0, 1]
        )
    return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class QualityModel:
    """Weights of the field, and slope and offset from mean marginal to score."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float
    offset: float

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        unary = with_neighbours(features, counts) @ self.weights
        forward, backward = _chain(unary, counts, self.moves)
        return _sigmoid(forward + backward)

    def means(self, features: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Marginals of 'good' averaged over the lines of a text, weighted by their length."""
        starts = np.cumsum(counts) - counts
        good = np.add.reduceat(self.marginals(features, counts) * chars, starts)
        return good / np.add.reduceat(chars, starts)

    def scores(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(self.slope * self.means(*line_features(texts)) + self.offset)


def train(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> tuple:
    """Weights and transitions by Adam on the penalised likelihood; a line's label is that of its text."""
    pieces = [[TRAIN_LINES] * (n // TRAIN_LINES) + ([n % TRAIN_LINES] if n % TRAIN_LINES else []) for n in counts]
    x, y = with_neighbours(features, counts).astype(np.float64), np.repeat(labels, counts)
    runs = np.array([n for piece in pieces for n in piece])
    inner = np.ones(len(y), dtype=bool)
    inner[np.cumsum(runs) - 1] = False
    inner = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner].astype(int), y[inner + 1].astype(int)), 1)
    weights, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (weights, moves)]
    for step in range(1, steps + 1):
        unary = x @ weights
        forward, backward = _chain(unary, runs, moves)
        d_weights = x.T @ (_sigmoid(forward + backward) - y) / len(y) + 1e-4 * weights
        after = unary[inner + 1] + backward[inner + 1]
        joint = np.stack(
            [moves[i, j] + i * forward[inner] + j * after for i in (0, 1) for j in (0, 1)], axis=0
        ).reshape(2, 2, -1)
        joint = np.exp(joint - joint.max(axis=(0, 1)))
        d_moves = ((joint / joint.sum(axis=(0, 1))).sum(axis=2) - seen) / len(y) + 1e-4 * moves
        for p, g, (m, v) in zip((weights, moves), (d_weights, d_moves), state):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights, moves


def calibrate(means: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve that passes THRESHOLD at the cut with the best balanced accuracy."""
    order = np.argsort(means, kind="stable")
    bad = np.cumsum(1 - labels[order]) / max(1, (1 - labels).sum())
    good = np.cumsum(labels[order]) / max(1, labels.sum())
    best = int((bad - good).argmax())
    above = means[order[min(best + 1, len(order) - 1)]]
    cut, slope = (means[order[best]] + above) / 2, 10.0
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut)


def fit(labelled: DataFrame) -> QualityModel:
    """Model from a bounded sample ``doc_id, text, label``; the driver receives line features, no texts.

    Null texts do not teach. Without both labels every text scores alike: 1 if only good ones are known, else 0.
    """
    schema = "doc_id bigint, label bigint, features array<float>, chars array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_blocks(batch, "text"):
                features, chars, counts = line_features(texts)
                ends = np.cumsum(counts)[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, len(texts)),
                        batch.column("label").slice(start, len(texts)),
                        pa.array([f.ravel() for f in np.split(features, ends)], pa.list_(pa.float32())),
                        pa.array(np.split(chars, ends), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "label", "features", "chars"],
                )

    known = labelled.where(F.col("text").isNotNull()).select("doc_id", "text", "label")
    rows = known.mapInArrow(run, schema).toArrow().sort_by("doc_id")
    labels = rows["label"].to_numpy().astype(np.float64)
    if len(set(labels)) < 2:
        return QualityModel(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, 40.0 if labels.all() and len(labels) else -40.0)
    flat = rows["features"].combine_chunks().flatten().to_numpy().reshape(-1, len(OWN))
    chars = rows["chars"].combine_chunks().flatten().to_numpy()
    counts = np.diff(np.r_[0, np.cumsum(rows["chars"].combine_chunks().value_lengths().to_numpy())])
    model = QualityModel(*train(flat, counts, labels), 1.0, 0.0)
    model.slope, model.offset = calibrate(model.means(flat, chars, counts), labels)
    return model


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, n_lines`` for every row from its whole text; THRESHOLD is the learnt cut.

    Null counts as empty, and an empty text is one empty line. Null ids and repeated rows pass through; other columns
    are ignored. No rows in, no rows out.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_blocks(batch, "_text"):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(start, len(texts)),
                        pa.array(model.scores(texts), pa.float64()),
                        pa.array([t.count("\n") + 1 for t in texts], pa.int64()),
                    ],
                    names=[id_col, "score", "n_lines"],
                )

    chosen = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, score double, n_lines bigint")
