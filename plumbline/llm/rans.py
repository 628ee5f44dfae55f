"""Static range asymmetric numeral system over token ids, vectorised over blocks and interleaved lanes.

A frame holds a shared frequency table and independent blocks of BLOCK symbols. Each block has LANES
interleaved coder states, one stream of 32-bit words, a checkpoint (its final states and where its words
start), a CRC-32 of its words and one of its symbols: any block decodes alone, or all of them at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np

BLOCK = 16_384
LANES = 16
#: Frequencies add up to 2 ** BITS at least; a frame with more symbols takes as many bits as they need.
BITS = 18
LOW = np.uint64(1 << 31)
_U = np.uint64


@dataclass
class Frame:
    """The encoded form; ``table`` holds symbols and frequencies, ``states`` and ``starts`` the checkpoints."""

    n: int
    table: bytes
    states: bytes
    starts: bytes
    words: bytes
    word_crcs: bytes
    id_crcs: bytes


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts (all positive) scaled to a sum of 2**bits with none below 1; bits grow with the number of symbols."""
    n = len(counts)
    total = 1 << max(BITS, n.bit_length() + 1)
    freq = 1 + np.floor(counts * ((total - n) / counts.sum())).astype(np.int64)
    freq[int(np.argmax(freq))] += total - int(freq.sum())
    return freq


def encode(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> Frame:
    """Encode unsigned ids. Empty input gives an empty frame."""
    n = len(ids)
    if n == 0:
        return Frame(0, b"", b"", b"", b"", b"", b"")
    if int(ids.max()) < 1 << 24:  # a vocabulary's ids: counted without sorting
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        place = np.zeros(len(counts), np.int32)
        place[symbols] = np.arange(len(symbols))
        dense, freq = place[ids], frequencies(counts[symbols])
    else:
        symbols, dense, counts = np.unique(ids, return_inverse=True, return_counts=True)
        freq = frequencies(counts)
    cum, bits = np.concatenate([[0], np.cumsum(freq)[:-1]]), int(freq.sum()).bit_length() - 1
    blocks, steps = -(-n // block), block // lanes
    padded = np.zeros(blocks * block, np.int32)
    padded[:n] = dense
    rows = np.ascontiguousarray(padded.reshape(blocks, steps, lanes).transpose(1, 0, 2).reshape(steps, -1))
    f_of, c_of = freq.astype(np.uint64), cum.astype(np.uint64)
    x = np.full(blocks * lanes, LOW, np.uint64)
    given, words = np.zeros(rows.shape, bool), np.zeros(rows.shape, np.uint32)
    for s in range(steps - 1, -1, -1):
        f, c = f_of[rows[s]], c_of[rows[s]]
        over = x >= f << _U(63 - bits)
        given[s] = over
        words[s] = x.astype(np.uint32)
        x = np.where(over, x >> _U(32), x)
        q = x // f
        x = (q << _U(bits)) + (x - q * f) + c
    per = given.reshape(steps, blocks, lanes).transpose(1, 0, 2)
    stream = words.reshape(steps, blocks, lanes).transpose(1, 0, 2)[per].astype("<u4")
    starts = np.concatenate([[0], np.cumsum(per.sum(axis=(1, 2)))]).astype("<u8")
    raw = stream.tobytes()
    word_crcs = [crc32(raw[int(a) * 4 : int(b) * 4]) for a, b in zip(starts[:-1], starts[1:])]
    flat = np.ascontiguousarray(ids, "<u4")
    id_crcs = [crc32(flat[i * block : (i + 1) * block].tobytes()) for i in range(blocks)]
    table = np.concatenate([symbols.astype("<u4"), freq.astype("<u4")]).tobytes()
    return Frame(n, table, x.astype("<u8").tobytes(), starts.tobytes(), raw, np.array(word_crcs, "<u4").tobytes(), np.array(id_crcs, "<u4").tobytes())


def decode(frame: Frame, only: list[int] | None = None, block: int = BLOCK, lanes: int = LANES) -> np.ndarray:
    """The ids of a frame, or of the blocks named by ``only``, one after the other. Raises on a wrong checksum."""
    if frame.n == 0:
        return np.zeros(0, np.uint32)
    blocks, steps = -(-frame.n // block), block // lanes
    chosen = np.arange(blocks) if only is None else np.asarray(only)
    table = np.frombuffer(frame.table, "<u4")
    symbols, freq = table[: len(table) // 2], table[len(table) // 2 :].astype(np.uint64)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    bits = int(freq.sum()).bit_length() - 1
    slots = np.repeat(np.arange(len(symbols), dtype=np.int32), freq.astype(np.int64))
    starts = np.frombuffer(frame.starts, "<u8").astype(np.int64)
    for b, crc in zip(chosen, np.frombuffer(frame.word_crcs, "<u4")[chosen]):
        if crc32(frame.words[starts[b] * 4 : starts[b + 1] * 4]) != crc:
            raise ValueError(f"block {b}: its words are damaged")
    stream = np.concatenate([np.frombuffer(frame.words, "<u4"), np.zeros(1, "<u4")]).astype(np.uint64)
    x = np.frombuffer(frame.states, "<u8").reshape(blocks, lanes)[chosen].astype(np.uint64)
    at = starts[chosen]
    out = np.empty((steps, len(chosen), lanes), np.int32)
    mask = _U((1 << bits) - 1)
    for s in range(steps):
        low = x & mask
        sym = slots[low.astype(np.int64)]
        out[s] = sym
        x = freq[sym] * (x >> _U(bits)) + low - cum[sym]
        need = x < LOW
        took = np.cumsum(need, axis=1)
        pos = np.minimum(at[:, None] + took - 1, len(stream) - 1)
        x = np.where(need, (x << _U(32)) | stream[pos], x)
        at = at + took[:, -1]
    ids = symbols[out.transpose(1, 0, 2).reshape(len(chosen), -1)]
    crcs = np.frombuffer(frame.id_crcs, "<u4")
    parts = []
    for row, b in zip(ids, chosen):
        row = np.ascontiguousarray(row[: min(block, frame.n - int(b) * block)], "<u4")
        if crc32(row.tobytes()) != crcs[b]:
            raise ValueError(f"block {b}: its ids are damaged")
        parts.append(row)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
