"""Token ids from public tokenizer files, by a cache of pieces that never depend on what stands around them."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import worker_model

@dataclass(frozen=True)
class Room:
    """What a worker may hold; results don't depend on it.

    lot: bytes of text whose chunks are found at a time (a longer text makes a longer lot); known: chunks whose ids
    are known (beyond that only those of the last lot stay); runs: letter runs inside them (beyond that the
    generation before is dropped).
    """

    lot: int = 3_000_000
    known: int = 300_000
    runs: int = 100_000


#: White space beyond ASCII.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Python takes these for white space, the tokenizers' patterns don't.
_ODD = "\x1c\x1d\x1e\x1f"

#: Letters and then these marks are the common case; anything else is encoded by the library as it stands.
_MARKS = ".,;:!?|()*#%&+-"

#: Byte-level models show a byte as a printable character: those that print stand for themselves, the others
#: follow from code point 256 on.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINT)}

def default_path(name: str) -> str:
    """The place of a public vocabulary file; operators take any other path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encodes whole texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    kind "word": white space separates pieces and is dropped; kind "byte": byte-level pieces with their
    leading space. The chunks of many texts are found at once on their bytes, distinct ones are looked up together
    in a sorted-out store of known chunks, and only new ones are encoded.
    Texts that hold the string of an added token, or white space on which the rules differ, go to the library as
    a whole.
    """

    def __init__(self, path: str, kind: str, room: Room = Room()):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.lib = Tokenizer.from_file(path)
        self.model, self.kind, self.room = self.lib.model, kind, room
        self.odd = [*_ODD, *(x.content for x in self.lib.get_added_tokens_decoder().values())]
        self.known = pa.array([b"\xff"], pa.binary())  # the end of a text, which has no ids
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(1, np.int32)
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return list(self.stream(texts))

    def stream(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The same one by one, in order, while few texts at a time are held as ids."""
        held, size = [], 0
        for text in texts:
            odd = any(x in text for x in self.odd) or not text.isascii() and bool(_WIDE.search(text))
            raw = text if odd else text.encode()
            held.append((odd, raw))
            size += len(raw)
            if size >= self.room.lot:
                yield from self._lot(held)
                held, size = [], 0
        yield from self._lot(held)

    def _lot(self, held: list[tuple[bool, str | bytes]]) -> Iterator[bytes]:
        plain = [raw for odd, raw in held if not odd]
        ids, ends = self._join(plain) if plain else (None, None)
        at, n = 0, 0
        for odd, raw in held:
            if odd:
                yield self._whole(raw)
            else:
                yield ids[at : ends[n]].tobytes()
                at, n = ends[n], n + 1

    def _join(self, plain: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """All ids of several texts, and where those of each end."""
        raw = b"\xff".join(plain) + b"\xff"  # a byte that UTF-8 never holds
        x = np.frombuffer(raw, np.uint8)
        end, space = x == 0xFF, (x == 32) | ((x >= 9) & (x <= 13))
        first = np.ones(len(x), bool)  # where a chunk begins
        if self.kind == "byte":
            # of white space before a word the last character stands alone, or leads the word if it is a space
            first[1:] = end[1:] | end[:-1] | space[1:] & ~space[:-1] | ~space[1:] & space[:-1] & (x[:-1] != 32)
            last = np.flatnonzero(space[:-1] & ~space[1:] & ~end[1:])
            first[last] = True
        else:
            first[1:] = end[1:] | end[:-1] | (space[1:] != space[:-1])
        starts = np.flatnonzero(first)
        offsets = np.append(starts, len(x)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        which = self._look_up(chunks.dictionary)[chunks.indices.to_numpy()]
        del chunks, first, space
        ids, upto = self._gather(which)
        return ids, upto[end[starts]].tolist()

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known chunks one after the other, and where those of each end."""
        n = self.sizes[which]
        kind = np.int32 if int(n.sum(dtype=np.int64)) < 1 << 31 else np.int64
        upto = np.cumsum(n, dtype=kind)
        begins = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes).astype(kind)
        at = np.repeat(begins[which] - upto + n, n)
        at += np.arange(len(at), dtype=kind)
        return self.flat[at], upto

    def _look_up(self, distinct: pa.Array) -> np.ndarray:
        """The place of each chunk among the known ones; new ones are encoded and become known."""
        if len(self.pieces) > self.room.runs:
            self.older, self.pieces = self.pieces, {}
        at = pc.index_in(distinct, value_set=self.known)
        new = distinct.filter(pc.is_null(at))
        made = [self.chunk(c.decode()) for c in new.to_pylist()]
        at = pc.fill_null(at, -1).to_numpy()
        place = np.where(at < 0, len(self.known) - 1 + np.cumsum(at < 0), at)
        self.known = pa.concat_arrays([self.known, new])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), "<u4")])
        self.sizes = np.concatenate([self.sizes, np.array([len(x) // 4 for x in made], np.int32)])
        if len(self.known) > self.room.known:
            self.flat, _ = self._gather(place)
            self.known, self.sizes, place = distinct, self.sizes[place], np.arange(len(distinct))
        return place

    def _whole(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def chunk(self, c: str) -> bytes:
        """The ids of a chunk that is not known."""
        core = c.rstrip(_MARKS)
        word = self.kind == "word"
        head = core.lower() if word else core
        ids = self.pieces.get(head) or self.older.get(head)
        if ids is None or word:
            if word and c.isspace():
                return b""
            if not ((core.isalpha() or core[1:].isalpha() and core[0] == " ") and (core.isascii() or max(core) < "\u0250")):
                return self._whole(c)
            ids = ids or self._piece(head)
        if len(core) < len(c):
            tail = c[len(core):]
            ids += self.pieces.get(tail) or self._piece(tail)
        return ids

    def _piece(self, piece: str) -> bytes:
        """A letter run or a punctuation run: the pre-tokenizer would leave it whole."""
        shown = piece.replace(" ", "\u0120") if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN)
        held = self.pieces[piece] = array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()
        return held


def encoder(path: str, kind: str, room: Room = Room()) -> ChunkEncoder:
    return worker_model((path, kind, room), lambda: ChunkEncoder(path, kind, room))
