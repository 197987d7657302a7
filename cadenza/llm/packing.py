"""Cost-balanced packing of tokenised documents into sequences of a fixed number of tokens.

Attention over a piece of n tokens costs ``linear * n + quadratic * n**2``. Pieces are dealt in
descending order of cost, each to the sequence of lowest cost that has room for it. Each task packs
the documents of its own input split, a bounded number of tokens at a time, so nothing is shuffled,
memory is bounded and a lost task is simply run again. A piece that fits nowhere is cut.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"
#: Sequences of one task are numbered from the task's number times this.
STRIDE = 1 << 32

#: Fixed values of byte-level BPE: printable Latin-1 bytes stand for themselves, the others for U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: A comma or full stop at the end of a word; a space before it changes no token.
_TAIL = re.compile(rb"(?<=[a-z])([,.])(?=[ \n]|$)")


class WordTokenizer:
    """Token ids of whole texts as little-endian bytes, by a cache of the words between white space.

    Exact for tokenizers that lower-case, drop white space and never join across it. A-Z are lowered
    first, which doubles the use of the cache. Texts that may hold a special token go to the
    tokenizer whole. The cache has two generations of ``most`` words each; frequent words move on to
    the younger one.
    """

    def __init__(self, path: str, end_id: int, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], "<u4").tobytes()
        self.most = most
        self.young = _Generation(self.tokenizer, {})

    def encode(self, text: str) -> bytes:
        raw = text.encode("utf-8", "replace")
        if b"<|" in raw:
            return _bytes(self.tokenizer, text) + self.end
        if len(self.young) > self.most:
            self.young = _Generation(self.tokenizer, dict(self.young))
        return b"".join(map(self.young.__getitem__, _TAIL.sub(rb" \1", raw.lower()).split())) + self.end


class _Generation(dict):
    """Words to ids; looks into an older generation before it asks the tokenizer."""

    def __init__(self, tokenizer, older: dict[bytes, bytes]):
        super().__init__()
        self.tokenizer, self.model, self.older = tokenizer, tokenizer.model, older

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.ids(word.decode())
        self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Words of letters only go straight to the merges; the tokenizer takes the rest apart."""
        plain = text
        if not text.isascii():
            plain = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
        if plain[-1] in ",." and plain[:-1].isalpha():
            return self[plain[:-1].encode()] + self[plain[-1].encode()]
        if not plain.isalpha():
            return _bytes(self.tokenizer, text)
        if not plain.isascii():
            plain = "".join(map(BYTE_LETTERS.__getitem__, plain.encode()))
        return np.array([t.id for t in self.model.tokenize(plain)], "<u4").tobytes()


def _bytes(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str, end_id: int) -> WordTokenizer:
    """One per Python worker, so that its cache outlives a task."""
    return WordTokenizer(path, end_id)


def pack(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Pieces ``(document, start, length, sequence, offset)`` and the cost of each sequence.

    As many sequences are open as the tokens need. Documents are first cut at multiples of
    ``capacity``; ties go by position. Every sequence but one at most ends up full, or nearly so.
    """
    docs, starts, sizes = [], [], []
    for d, n in enumerate(lengths):
        for s in range(0, int(n), capacity):
            docs.append(d)
            starts.append(s)
            sizes.append(min(capacity, int(n) - s))
    count = -(-int(np.sum(lengths)) // capacity)
    cost, room = np.zeros(count), np.full(count, capacity, np.int64)
    out = []

    def put(i: int, q: int, shift: int, n: int) -> None:
        out.append((docs[i], starts[i] + shift, n, q, capacity - int(room[q])))
        room[q] -= n
        cost[q] += linear * n + quadratic * n * n

    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n, shift = sizes[i], 0
        q = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[q] >= n:
            put(i, q, 0, n)
            continue
        while shift < n:  # fits nowhere: cut
            q = int(np.argmax(room))
            part = min(n - shift, int(room[q]))
            put(i, q, shift, part)
            shift += part
    return out, cost


def packed_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    group_tokens: int = 4_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece, columns as in ``SCHEMA``.

    A document is its token ids and ``end_id``; a null or empty text is ``end_id`` alone. Sequences
    hold ``capacity`` tokens at most, offsets have no gaps. Every ``group_tokens`` tokens of a
    task leave at most one sequence that is not full. Ids may be null or repeat: each row is its own
    document. A text longer than ``group_tokens`` is packed alone. Extra columns are ignored. No
    rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path, end_id)
        base = TaskContext.get().partitionId() * STRIDE
        held: list[tuple[int | None, bytes]] = []
        total = 0

        def flush():
            nonlocal base, total
            pieces, cost = pack(np.array([len(t) // 4 for _, t in held]), capacity, linear, quadratic)
            columns = [[] for _ in range(8)]
            for d, start, n, q, offset in pieces:
                name, ids = held[d]
                for c, v in zip(columns, (name, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, base + q, offset, float(cost[q])), strict=True):
                    c.append(v)
            base += len(cost)
            held.clear()
            total = 0
            kinds = [pa.int64()] * 7 + [pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()
            for name, text in zip(ids, texts, strict=True):
                held.append((name, tokenizer.encode(text)))
                total += len(held[-1][1]) // 4
                if total >= group_tokens:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(lean(run), SCHEMA)
