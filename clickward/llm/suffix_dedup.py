"""Removal of long byte strings that a smaller document holds too.

Every byte covered by a `LENGTH`-byte string that also starts in a document
with a smaller doc_id goes. Column-wise construction of the collection's
suffix order takes as many rounds over all documents as the longest document
has bytes. So the collection is first cut into short fragments that equal
strings cut alike, and the columns are inserted per fragment:

1. The anchor of a string is the least hash among its `KMER`-byte substrings.
   Neighbouring strings with one anchor form a fragment, so each string lies
   in one fragment, at a place that its own bytes decide. Documents are dealt
   into blocks; a block sends (anchor hash, fragment hash, smallest doc_id) of
   each class of equal fragments to the anchor's bucket.
2. A bucket answers per block with one bit a class: whether a smaller document
   elsewhere holds the whole fragment. Where one anchor has several classes it
   also asks for the bytes of one fragment of each.
3. Blocks send those fragments, and a bucket inserts them column by column
   from the anchor outwards, one symbol of every fragment each round, keeping
   the order of the collection and, as ranks, the common prefixes of every
   depth. Two ranks, left and right, then tell which strings are shared, and
   the least doc_id among the sharers which go.
4. Blocks apply the answers to their texts.

Texts move once, by block; the three passes over them reuse that exchange. A
class costs one entry per block however many documents hold it, so no group
grows with its copies. Fragment classes are told apart by 104 hash bits,
strings of different classes by their bytes.

Defined cases: null or empty texts and texts shorter than `LENGTH` lose
nothing; repeated rows of one doc_id do not count against each other; rows
without doc_id are left out; an empty table gives an empty result; further
columns are ignored. A cut may fall inside a character, so `kept` is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickward.llm.common import CHUNK_BYTES, PolyHash, constants, mix, whole_text

LENGTH = 50
KMER = 24
WINDOWS = LENGTH - KMER + 1
BLOCK_BYTES = 4 << 20

_FRAGMENT = PolyHash(401)
_STEP = constants(409, KMER // 8)
_PLACE_BITS = np.uint64(30)
_PLACE = np.uint64((1 << 30) - 1)
_ANCHOR_BITS = np.uint64((1 << 56) - 1)
_FRAGMENT_BITS = np.uint64((1 << 48) - 1)

ASKED = "bucket int, block int, width int, entries binary"
ANSWER = "block int, bucket int, kind int, bits binary"
PIECES = "bucket int, block int, pieces binary"


def _kmers(buffer: np.ndarray) -> np.ndarray:
    """Hash of the KMER bytes from every place; the last places read zeros."""
    n = len(buffer)
    padded = np.zeros(n + KMER + 8, np.uint8)
    padded[:n] = buffer
    eight = np.empty((n + KMER) // 8 * 8 + 8, np.uint64)
    for j in range(8):
        part = padded[j : j + (len(padded) - j) // 8 * 8].view("<u8")
        room = eight[j::8]
        room[: len(part)] = part[: len(room)]
    return mix(sum(eight[8 * i : 8 * i + n] * _STEP[i] for i in range(KMER // 8)))


def anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Fragments of all texts: text number, start, number of strings, anchor place, both hashes."""
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("text", "start", "count", "anchor", "h", "f")}
    group: list[int] = []
    size = 0
    for i, text in enumerate([*texts, None]):
        if group and (text is None or size + len(text) > CHUNK_BYTES):
            _anchors([texts[g] for g in group], group[0], found)
            group, size = [], 0
        if text is not None:
            group.append(i)
            size += len(text)
    kinds = {"h": np.uint64, "f": np.uint64}
    return {k: np.concatenate(v) if v else np.zeros(0, kinds.get(k, np.int64)) for k, v in found.items()}


def _anchors(texts: list[bytes], number: int, found: dict[str, list[np.ndarray]]) -> None:
    lengths = np.asarray([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buffer)
    if n < LENGTH:
        return
    h = _kmers(buffer)
    least = (h >> _PLACE_BITS << _PLACE_BITS) | np.arange(n, dtype=np.uint64)
    # Least of WINDOWS neighbours by doubling; of equal hashes the first place.
    width = 1
    while 2 * width <= WINDOWS:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = WINDOWS - width
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    strings = n - LENGTH + 1
    place = (least[:strings] & _PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)[:strings]
    whole = np.arange(strings) + LENGTH <= offsets[owner + 1]
    fresh = whole.copy()
    fresh[1:] &= (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | ~whole[:-1]
    start = np.flatnonzero(fresh)
    if not len(start):
        return
    # A fragment ends before the next one or at the last whole string of its text.
    last = offsets[owner[start] + 1] - LENGTH
    end = np.minimum(np.append(start[1:], strings) - 1, last)
    at = place[start]
    own = owner[start]
    found["text"].append(own + number)
    found["start"].append(start - offsets[own])
    found["count"].append(end - start + 1)
    found["anchor"].append(at - offsets[own])
    found["h"].append(h[at] & _ANCHOR_BITS)
    prefix = _FRAGMENT.prefix(buffer)
    # The place of the anchor in the fragment is part of what makes fragments equal.
    shape = mix((at - start).astype(np.uint64) * np.uint64(WINDOWS) + (end - start).astype(np.uint64))
    found["f"].append(mix(_FRAGMENT.between(prefix, start, end + LENGTH) ^ shape) & _FRAGMENT_BITS)


class Block:
    """Fragments of a block's texts in classes, listed by bucket."""

    def __init__(self, rows: pd.DataFrame, buckets: int):
        self.docs = rows["doc_id"].to_numpy(np.int64)
        self.texts = [t.encode() for t in rows["text"]]
        self.found = anchors(self.texts)
        h, f = self.found["h"], self.found["f"]
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((f, h, bucket))
        h, f, bucket = h[self.order], f[self.order], bucket[self.order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1])
        self.first = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        self.h, self.f, self.bucket = h[self.first], f[self.first], bucket[self.first]
        doc = self.docs[self.found["text"]][self.order]
        self.doc = doc
        self.low = np.minimum.reduceat(doc, self.first) if len(doc) else doc
        self.edges = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])) if len(self.h) else []

    def ranges(self) -> Iterator[tuple[int, int, int]]:
        """(bucket, first class, end) of every bucket with classes."""
        ends = [*self.edges[1:], len(self.h)]
        return ((int(self.bucket[a]), int(a), int(b)) for a, b in zip(self.edges, ends, strict=True))

    def marked(self, answers: pd.DataFrame, kind: int) -> np.ndarray:
        """Values per class of the answers of one kind: bits, or a mask per class."""
        out = np.zeros(len(self.h), np.uint32)
        at = {bucket: (a, b) for bucket, a, b in self.ranges()}
        for bucket, bits in zip(answers["bucket"][answers["kind"] == kind], answers["bits"][answers["kind"] == kind], strict=True):
            a, b = at[bucket]
            if kind == MASK:
                pairs = np.frombuffer(bits, "<u4").reshape(-1, 2)
                out[a + pairs[:, 0]] = pairs[:, 1]
            else:
                out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        return out


GONE, WANTED, MASK = 0, 1, 2


def _low_bytes(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _from_bytes(columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(columns), 8), np.uint8)
    out[:, : columns.shape[1]] = columns
    return out.view("<u8").reshape(-1)


def shared_strings_removed(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row with a doc_id."""
    texts = whole_text(docs).where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    size = texts.agg(F.sum(F.octet_length("text")), F.min("doc_id")).first()
    blocks = max(1, -(-(size[0] or 0) // block_bytes))
    signed = (size[1] or 0) < 0
    blocked = texts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))

    def as_number(doc: np.ndarray) -> np.ndarray:
        return doc.astype(np.uint64) ^ np.uint64(signed << 63)

    def ask(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows, blocks)
        low = as_number(block.low)
        width = max(1, (int(low.max()).bit_length() + 7) // 8) if len(low) else 1
        sent = [
            (
                bucket,
                key[0],
                width,
                np.hstack([_low_bytes(block.h[a:b], 7), _low_bytes(block.f[a:b], 6), _low_bytes(low[a:b], width)]).tobytes(),
            )
            for bucket, a, b in block.ranges()
        ]
        return pd.DataFrame(sent, columns=["bucket", "block", "width", "entries"])

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [
            np.frombuffer(e, np.uint8).reshape(-1, 13 + w) for e, w in zip(rows["entries"], rows["width"], strict=True)
        ]
        h = np.concatenate([_from_bytes(p[:, :7]) for p in parts])
        f = np.concatenate([_from_bytes(p[:, 7:13]) for p in parts])
        low = np.concatenate([_from_bytes(p[:, 13:]) for p in parts])
        order = np.lexsort((low, f, h))
        h, f, low = h[order], f[order], low[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1])
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        gone = np.zeros(len(h), bool)
        gone[order] = low > low[first][of]
        # Several classes under one anchor: the first entry of each is asked for.
        same = h[first][1:] == h[first][:-1]
        several = np.append(same, False) | np.append(False, same) if len(first) else np.zeros(0, bool)
        wanted = np.zeros(len(h), bool)
        wanted[order[first[several]]] = True
        sent, at = [], 0
        for block, part in zip(rows["block"], parts, strict=True):
            for kind, flags in ((GONE, gone), (WANTED, wanted)):
                own = flags[at : at + len(part)]
                if own.any():
                    sent.append((block, key[0], kind, np.packbits(own).tobytes()))
            at += len(part)
        return pd.DataFrame(sent, columns=["block", "bucket", "kind", "bits"])

    def send(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        sent = []
        if len(rows) and (answers["kind"] == WANTED).any():
            block = Block(rows, blocks)
            wanted = block.marked(answers, WANTED).astype(bool)
            low = as_number(block.low)
            # Of each wanted class the first fragment in its smallest document.
            lowest = block.doc == block.low[block.of]
            for bucket, a, b in block.ranges():
                chosen = np.flatnonzero(wanted[a:b]) + a
                if not len(chosen):
                    continue
                head = np.zeros((len(chosen), 5), "<u8")
                body = []
                for row, c in enumerate(chosen.tolist()):
                    end = block.first[c + 1] if c + 1 < len(block.first) else len(block.of)
                    one = block.order[block.first[c] + int(np.argmax(lowest[block.first[c] : end]))]
                    text, start, count, anchor = (int(block.found[k][one]) for k in ("text", "start", "count", "anchor"))
                    head[row] = (block.h[c], low[c], c - a, anchor - start, count)
                    body.append(block.texts[text][start : start + count + LENGTH - 1])
                sent.append((bucket, key[0], len(chosen).to_bytes(8, "little") + head.tobytes() + b"".join(body)))
        return pd.DataFrame(sent, columns=["bucket", "block", "pieces"])

    def insert(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        heads, owners, grids = [], [], []
        for block, data in zip(rows["block"], rows["pieces"], strict=True):
            n = int.from_bytes(data[:8], "little")
            head = np.frombuffer(data, "<u8", 5 * n, 8).reshape(n, 5)
            grid = np.full((n, WINDOWS - 1 + LENGTH), 256, np.int64)
            at = 8 + 40 * n
            for i, (left, count) in enumerate(head[:, 3:].astype(np.int64).tolist()):
                size = count + LENGTH - 1
                grid[i, WINDOWS - 1 - left : WINDOWS - 1 - left + size] = np.frombuffer(data, np.uint8, size, at)
                at += size
            heads.append(head)
            owners.append(np.full(n, block))
            grids.append(grid)
        head, owner, grid = np.concatenate(heads), np.concatenate(owners), np.concatenate(grids)
        masks = column_masks(head[:, 0], head[:, 1], head[:, 3].astype(np.int64), head[:, 4].astype(np.int64), grid)
        sent = []
        for block in np.unique(owner[masks > 0]).tolist():
            own = (owner == block) & (masks > 0)
            pairs = np.stack([head[own, 2].astype("<u4"), masks[own].astype("<u4")], axis=1)
            sent.append((block, key[0], MASK, pairs.tobytes()))
        return pd.DataFrame(sent, columns=["block", "bucket", "kind", "bits"])

    def cut(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows, blocks)
        gone = block.marked(answers, GONE).astype(bool)
        masks = block.marked(answers, MASK)
        found = {k: v[block.order] for k, v in block.found.items() if k in ("text", "start", "count")}
        entire = gone[block.of] | (block.doc > block.low[block.of]) if len(block.of) else np.zeros(0, bool)
        part = np.where(entire, np.uint32((1 << WINDOWS) - 1), masks[block.of] if len(block.of) else 0)
        touched = np.flatnonzero(part)
        by_text: dict[int, list[int]] = {}
        for i in touched.tolist():
            by_text.setdefault(int(found["text"][i]), []).append(i)
        out = []
        for number, (doc_id, text) in enumerate(zip(block.docs.tolist(), block.texts, strict=True)):
            own = by_text.get(number)
            if own is None:
                out.append((doc_id, len(text), 0, 0, text))
                continue
            cover = np.zeros(len(text) + 1, np.int64)
            for i in own:
                start, count, bits = int(found["start"][i]), int(found["count"][i]), int(part[i])
                if entire[i]:
                    cover[start] += 1
                    cover[start + count + LENGTH - 1] -= 1
                else:
                    for j in range(count):
                        if bits >> j & 1:
                            cover[start + j] += 1
                            cover[start + j + LENGTH] -= 1
            lost = np.cumsum(cover[:-1]) > 0
            spans = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum())
            out.append((doc_id, len(text), int(lost.sum()), spans, np.frombuffer(text, np.uint8)[~lost].tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    asked = blocked.groupBy("block").applyInPandas(ask, ASKED)
    answers = asked.groupBy("bucket").applyInPandas(answer, ANSWER)
    pieces = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(send, PIECES)
    inserted = pieces.groupBy("bucket").applyInPandas(insert, ANSWER)
    every = answers.where(F.col("kind") == GONE).unionByName(inserted)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return blocked.groupBy("block").cogroup(every.groupBy("block")).applyInPandas(cut, result)


def _ranks(columns: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Rank of every fragment after 0, 1, 2... inserted columns: equal ranks have equal prefixes of that depth."""
    ranks = [start]
    for column in columns.T:
        ranks.append(np.unique(ranks[-1] * 257 + column, return_inverse=True)[1])
    return ranks


def column_masks(h: np.ndarray, low: np.ndarray, left: np.ndarray, count: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Which strings of each fragment a fragment of a smaller document holds too; bit j is the j-th string.

    The columns of `grid` are aligned at the anchor, which starts in column
    WINDOWS - 1. A string that starts b bytes before it is a left prefix of
    depth b and a right prefix of depth LENGTH - b.
    """
    middle = WINDOWS - 1
    group = np.unique(h, return_inverse=True)[1]
    to_left, to_right = _ranks(grid[:, :middle][:, ::-1], group), _ranks(grid[:, middle:], group)
    masks = np.zeros(len(h), np.uint32)
    for before in range(WINDOWS):
        place = left - before
        here = np.flatnonzero((place >= 0) & (place < count))
        if len(here) < 2:
            continue
        string = to_left[before][here] * (len(h) + 1) + to_right[LENGTH - before][here]
        order = np.lexsort((low[here], string))
        string, sorted_low = string[order], low[here][order]
        new = np.ones(len(here), bool)
        new[1:] = string[1:] != string[:-1]
        least = sorted_low[np.flatnonzero(new)][np.cumsum(new) - 1]
        lost = here[order[sorted_low > least]]
        masks[lost] |= np.uint32(1) << place[lost].astype(np.uint32)
    return masks
