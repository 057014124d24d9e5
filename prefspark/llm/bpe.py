"""Byte-pair encoding and decoding of whole texts with a public vocabulary, by batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
WORD_END = "</w>"
#: Fixed by the vocabulary: how its tokenizer splits a normalised text.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Words kept with their ids by one task, and characters that are split at a time; neither changes a result.
CACHED_WORDS = 300_000
PIECE_CHARS = 500_000
NO_RANK = np.int64(2**31)
OUTPUTS = {
    "ids": pa.list_(pa.int32()),
    "n_tokens": pa.int64(),
    "ids_sha256": pa.string(),
    "decoded": pa.string(),
    "decoded_sha256": pa.string(),
}
_SQL_TYPES = {
    "ids": "array<int>",
    "n_tokens": "bigint",
    "ids_sha256": "string",
    "decoded": "string",
    "decoded_sha256": "string",
}


def byte_symbols() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


@lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """By code point: unknown to this Python's tables; the library's newer ones may know it."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


class WordBpe:
    """Vocabulary, merges and a bounded cache of encoded words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model, self.path = described["model"], path
        vocabulary, size = model["vocab"], len(model["vocab"])
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        tokens = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.tokens = np.array([tokens[i] for i in range(max(tokens) + 1)], dtype=object)
        symbols = byte_symbols()
        self.inner = np.array([vocabulary[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocabulary[s + WORD_END] for s in symbols], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocabulary[b] for _, b in merges], dtype=np.int64)
        self.width, self.product = size, np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        keys = left * size + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        # A round merges every occurrence of a word's lowest pair at once. That equals one merge at a time
        # as long as a new symbol only enters later merges.
        made = np.full(size, -1)
        made[self.product] = np.arange(len(merges))
        if (np.maximum(made[left], made[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a symbol that a later merge makes")
        self.words: dict[str, tuple[np.ndarray, str]] = {}

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], NO_RANK)

    def merge(self, words: Sequence[str]) -> list[np.ndarray]:
        """Ids of each word. All words lie in one flat array; a round merges the lowest-ranked pair of each."""
        data = [w.encode("utf-8") for w in words]
        lengths = np.array([len(d) for d in data])
        raw = np.frombuffer(b"".join(data), dtype=np.uint8)
        last = np.zeros(len(raw), dtype=bool)
        last[np.cumsum(lengths) - 1] = True
        symbols = np.where(last, self.final[raw], self.inner[raw])
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(raw), NO_RANK)
        inside = np.flatnonzero(~last)
        rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
        done_symbols, done_words = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            open_ = lowest < NO_RANK
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_words.append(word[~open_])
                symbols, word, rank, last, lowest = (x[open_] for x in (symbols, word, rank, last, lowest))
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == lowest)
            # In a run of overlapping hits ("aaaa") every second one merges, from the left.
            head = np.r_[True, np.diff(hits) != 1]
            offset = np.arange(len(hits)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            hits = hits[offset % 2 == 0]
            symbols[hits] = self.product[rank[hits]]
            last[hits] = last[hits + 1]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hits + 1] = False
            moved = (np.cumsum(keep) - 1)[hits]
            symbols, word, rank, last = symbols[keep], word[keep], rank[keep], last[keep]
            rank[moved] = NO_RANK
            before = moved[(moved > 0)] - 1
            changed = np.unique(np.r_[moved[~last[moved]], before[~last[before]]])
            if len(changed):
                rank[changed] = self.ranks(symbols[changed], symbols[changed + 1])
        flat, owner = np.concatenate(done_symbols), np.concatenate(done_words)
        flat = flat[np.argsort(owner, kind="stable")].astype(np.int32)
        ends = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def split(self, text: str) -> Iterator[list[str]]:
        """Lists of words of a text without special tokens; long texts in pieces that end at white space."""
        if not text.isascii():
            if unassigned()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)].any():
                normal = self.library.normalizer.normalize_str(text)
                back = {s: b for b, s in enumerate(byte_symbols())}
                pieces = self.library.pre_tokenizer.pre_tokenize_str(normal)
                yield [bytes(back[c] for c in piece).decode("utf-8") for piece, _ in pieces]
                return
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text, start = text.lower(), 0
        while len(text) - start > PIECE_CHARS:
            gap = text.find(" ", start + PIECE_CHARS)
            if gap < 0:
                break
            yield SPLIT.findall(text, start, gap)
            start = gap
        yield SPLIT.findall(text, start)

    def encode(self, texts: Sequence[str]) -> Iterator[tuple[list[np.ndarray], list[str]]]:
        """Per text its ids and the same ids as text, both in pieces (one for each word or special token)."""
        waiting: list[list] = []
        for text in texts:
            words = []
            for part in self.at_special.split(text):
                if part in self.special:
                    words.append(part)
                else:
                    for found in self.split(part):
                        words.extend(found)
            waiting.append(words)
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        fresh = sorted({w for words in waiting for w in words if w not in self.words and w not in self.special})
        for at in range(0, len(fresh), 50_000):
            block = fresh[at : at + 50_000]
            for w, ids in zip(block, self.merge(block)):
                self.words[w] = (ids, " ".join(map(str, ids.tolist())))
        for content, number in self.special.items():
            self.words[content] = (np.array([number], dtype=np.int32), str(number))
        for words in waiting:
            encoded = [self.words[w] for w in words]
            yield [e[0] for e in encoded], [e[1] for e in encoded]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by blanks, special ones included, as a vocabulary without decoder prescribes."""
        return " ".join(self.tokens[ids].tolist())


@lru_cache(maxsize=2)
def load(path: str | None) -> WordBpe:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return WordBpe(path)


def _blocks(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, list[str]]]:
    """Rows of a batch with at most PIECE_CHARS characters at a time, one row at least."""
    start, texts, held = 0, [], 0
    for at, value in enumerate(batch.column(text_col)):
        text = value.as_py() or ""
        if texts and held + len(text) > PIECE_CHARS:
            yield start, texts
            start, texts, held = at, [], 0
        texts.append(text)
        held += len(text)
    if texts:
        yield start, texts


def encode_decode(
    df: DataFrame,
    outputs: Sequence[str] = ("ids", "n_tokens"),
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
) -> DataFrame:
    """``id_col`` and the chosen columns of ``OUTPUTS`` for every row; ``path`` names the vocabulary file on executors.

    Words are found by the vocabulary's own rule, and each distinct word of a block is merged once; ids are decoded
    again token by token. A task holds one block of texts and a cache of bounded size. Null and empty texts have no
    token and decode to the empty text. Long texts are split in pieces at blanks and hashed whole. Null ids and repeated
    rows pass through; other columns are ignored. No rows in, no rows out.
    """
    schema = pa.schema([(name, OUTPUTS[name]) for name in outputs])
    kind = df.schema[id_col].dataType.simpleString()
    need_text = "decoded" in outputs or "decoded_sha256" in outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for start, texts in _blocks(batch, "_text"):
                columns: dict[str, list] = {name: [] for name in outputs}
                for pieces, written in model.encode(texts):
                    ids = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int32)
                    text = model.decode(ids) if need_text else ""
                    values = {
                        "ids": lambda: ids,
                        "n_tokens": lambda: len(ids),
                        "ids_sha256": lambda: hashlib.sha256(" ".join(written).encode("ascii")).hexdigest(),
                        "decoded": lambda: text,
                        "decoded_sha256": lambda: hashlib.sha256(text.encode("utf-8")).hexdigest(),
                    }
                    for name in outputs:
                        columns[name].append(values[name]())
                keys = batch.column("_id").slice(start, len(texts))
                arrays = [pa.array(columns[n], type=schema.field(n).type) for n in outputs]
                yield pa.RecordBatch.from_arrays([keys, *arrays], names=[id_col, *outputs])

    fields = ", ".join(f"`{n}` {_SQL_TYPES[n]}" for n in outputs)
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, {fields}"
    )


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``id_col, decoded`` from stored ids; a null list decodes to null."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [
                None if v.as_py() is None else model.decode(np.array(v.as_py(), dtype=np.int64)) for v in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded string")
