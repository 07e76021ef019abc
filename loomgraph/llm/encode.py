"""Token ids of a byte-level BPE vocabulary, by a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files are; every function takes another folder too.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: The split of the text before any merge: a fixed value of this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces kept with their ids in each Python worker; longer pieces are encoded anew each time.
CACHED, CACHED_CHARS = 200_000, 48
#: Tokens handed back to Spark at once.
BATCH_TOKENS = 1_000_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [signs[b] for b in range(256)]


class Encoder:
    """Encodes text with the merges of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.bytes = [vocab[c] for c in byte_alphabet()]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: (left id, right id) -> (rank, id of the merged token)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.split = regex.compile(SPLIT)
        self.cache: dict[str, list[int]] = {}

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece.

        Leaf i of the tree holds rank * n + i of the pair that starts at symbol i; the least leaf,
        at the root, is the leftmost pair of the lowest rank. A merge changes three leaves, each
        in logarithmic time, so a piece of n bytes takes n log n steps whatever it repeats.
        """
        ids = [self.bytes[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges, none = self.merges, 1 << 62
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [none] * (2 * width)
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m:
                tree[width + i] = m[0] * n + i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after = list(range(1, n + 1))  # of a symbol that still stands: the next one
        before = list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    return
                tree[k] = least

        while tree[1] != none:
            i = tree[1] % n
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                put(j, none)
            if k < n:
                before[k] = i
                m = merges.get((ids[i], ids[k]))
                put(i, m[0] * n + i if m else none)
            else:
                put(i, none)
            h = before[i]
            if h >= 0:
                m = merges.get((ids[h], ids[i]))
                put(h, m[0] * n + h if m else none)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one. Special tokens' names are ordinary text."""
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for piece in self.split.findall(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.piece(piece.encode("utf-8"))
                if len(piece) <= CACHED_CHARS:
                    if len(cache) >= CACHED:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


@functools.lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Encoder:
    """One encoder per Python worker, with the cache it has gathered."""
    return Encoder(os.path.join(folder, vocabulary))


def encode_column(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array of int) of each row, as the vocabulary encodes ``text``.

    Null and empty texts have the empty list; blank texts have the ids of their blanks. No special
    tokens are added or recognised. Every row gives a row: repeated keys or texts stay repeated. Whole
    texts are encoded, whatever their length. No shuffle; a worker keeps the ids of frequent pieces.
    """
    kind = df.schema[key].dataType.simpleString()
    arrow = _arrow_type(df, key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary).encode
        for batch in batches:
            start, flat, ends = 0, [], [0]
            for i, text in enumerate(batch.column(1)):
                flat += encode(text.as_py())
                ends.append(len(flat))
                if len(flat) >= BATCH_TOKENS or i == batch.num_rows - 1:
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start).cast(arrow), ids], ["key", "ids"])
                    start, flat, ends = i + 1, [], [0]

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, keys: list[str], text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys`` and ``tokens``: how many ids each text has; 0 for null and empty texts."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", tokens bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary).encode
        for batch in batches:
            sizes = pa.array([len(encode(t.as_py())) for t in batch.column(len(keys))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], [*keys, "tokens"])

    return df.select(*keys, F.col(text)).mapInArrow(run, schema)


def _arrow_type(df: DataFrame, key: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[key].dataType)
