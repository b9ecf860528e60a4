"""Best-fit packing of tokenized documents into sequences of a fixed length.

Texts become token ids inside tasks; only (doc_id, piece, length) rows move.
Pieces are dealt out by a hash into tasks of about `task_tokens` tokens, and
each task packs its pieces as they come, with a fixed number of open bins. The
open bins are a bitset keyed by free space: the best fit for a piece is the
lowest set bit at or above its length, and when one bin too many is open the
fullest, the lowest set bit, closes first. A bin without free space closes at
once. A task holds its open bins and nothing else.

Defined cases: a null or empty text is the end id alone; a text longer than a
sequence is cut into full pieces, the last may be shorter; repeated rows are
packed as often as they occur; a null doc_id is carried along; an empty table
gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickward.llm.common import whole_text
from clickward.session import materialize

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 512
TASK_TOKENS = 1 << 26
WORD_MEMORY = 250_000

_PUNCTUATION = b"!#$%&*,.:;?|"
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of texts, one lookup per word seen before.

    The tokenizer drops white space and never merges across it, so the ids of
    a text are those of its words in order. White space here is ASCII's; other
    white space stays inside a word and the tokenizer handles it. A text that
    holds a special token's name is encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [str(t.content) for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._words: dict[bytes, bytes] = {}
        self._stems: dict[bytes, bytes] = {}
        self._letters = _byte_letters()

    def _whole(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _stem(self, stem: bytes) -> bytes:
        """A run of a-z is one piece for the tokenizer's model; all else takes the full path."""
        found = self._stems.get(stem)
        if found is None:
            if stem.isalpha():
                found = np.asarray([t.id for t in self._tokenizer.model.tokenize(stem.decode())], "<u4").tobytes()
            else:
                text = stem.decode()
                if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
                    spelled = "".join([self._letters[b] for b in text.encode()])
                    found = np.asarray([t.id for t in self._tokenizer.model.tokenize(spelled)], "<u4").tobytes()
                else:
                    found = self._whole(text)
            if len(self._stems) >= WORD_MEMORY:
                self._stems.clear()
            self._stems[stem] = found
        return found

    def _word(self, word: bytes) -> bytes:
        """Trailing punctuation after a letter or digit is always a piece of its own."""
        stem = word.rstrip(_PUNCTUATION)
        if stem and len(stem) < len(word) and _ends_in_letter(stem):
            found = self._stem(_lower(stem)) + self._stem(word[len(stem) :])
        else:
            found = self._stem(_lower(word))
        if len(self._words) >= WORD_MEMORY:
            self._words.clear()
        self._words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if any(name in text for name in self._special):
            return self._whole(text)
        known, add = self._words.get, self._word
        return b"".join([known(w) or add(w) for w in text.encode().split()])


def _ends_in_letter(stem: bytes) -> bool:
    return stem[-1:].isalnum() or (stem[-1] >= 0x80 and stem.decode()[-1].isalpha())


def _lower(word: bytes) -> bytes:
    """Lower case where that is certain to change neither length nor composition: ASCII and Latin-1 letters."""
    if word.isascii():
        return word.lower()
    text = word.decode()
    return text.lower().encode() if max(text) <= "ÿ" else word


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(others)) for b in range(256)]


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, so that words learnt in one task serve the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, twin long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, twin); `twin` tells rows with equal doc_id apart."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("piece", pa.int32()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids_crc32", pa.int64()),
        ]
    )
    last = np.asarray([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + last
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    pieces = whole_text(docs).mapInArrow(cut, PIECES.rpartition(",")[0])
    return pieces.withColumn("twin", F.monotonically_increasing_id())


class OpenBins:
    """A fixed number of open bins in a bitset keyed by free space."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self._capacity, self._most = capacity, most
        self._bits = 0
        self._bins: dict[int, list[int]] = {}
        self._open = 0
        self._next = 0

    def _put(self, free: int, number: int) -> None:
        self._bins.setdefault(free, []).append(number)
        self._bits |= 1 << free
        self._open += 1

    def _take(self, free: int) -> int:
        stack = self._bins[free]
        number = stack.pop()
        if not stack:
            self._bits &= ~(1 << free)
        self._open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fitting = self._bits >> length
        if fitting:
            free = length + ((fitting & -fitting).bit_length() - 1)
            number = self._take(free)
        else:
            free, number = self._capacity, self._next
            self._next += 1
        if free > length:
            self._put(free - length, number)
            if self._open > self._most:
                self._take((self._bits & -self._bits).bit_length() - 1)
        return number, self._capacity - free


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Pieces with `sequence_id` and `offset`."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = -(-total // task_tokens) or 1
    order = F.xxhash64("doc_id", "piece", "twin")
    dealt = pieces.withColumn("deal", order).repartition(tasks, "deal").sortWithinPartitions("deal")
    names = [f.name for f in pieces.schema.fields]
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            if not batch.num_rows:
                continue
            placed = [bins.place(n) for n in batch.column(names.index("length")).to_pylist()]
            task = batch.column(len(names)).to_numpy()
            number = pa.array([b for b, _ in placed], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array((task << 33) | number.to_numpy()), pa.array([o for _, o in placed], pa.int64())],
                schema=out,
            )

    numbered = dealt.drop("deal").withColumn("task", F.spark_partition_id().cast("long"))
    return numbered.mapInArrow(fill, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All documents as pieces in sequences of at most `capacity` tokens."""
    return pack(materialize(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
