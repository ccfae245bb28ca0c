"""Cutting texts where no pre-token can cross, so that each distinct piece is encoded once per process.

A cut before a space that follows a non-space is safe for GPT-2-like patterns: no alternative reaches from a non-space over
a space, and the look-ahead after white space never sees the cut. Texts of any length are handled in segments.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

SEGMENT = 1 << 18
WAITING = 4 << 20
CACHED_PIECES = 400_000
CACHED_LENGTH = 48
_SAFE = re.compile(r"(?<=\S) ")
_RUN = re.compile(r"\s ")
_LINES = re.compile(r"\S+(?:\n\S+)+")
#: Symbols that are a match of their own between letters and a white space or the text's end.
_SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def segments(text: str) -> Iterator[str]:
    """The text in runs of about SEGMENT characters; every run but the first has lost the space it was cut at."""
    at = 0
    while len(text) - at > SEGMENT and (cut := _SAFE.search(text, at + SEGMENT)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def split(segment: str) -> list[str]:
    """Pieces; all but the first have lost the space they start with."""
    return _SAFE.split(segment) if segment[:1] == " " or _RUN.search(segment) else segment.split(" ")


class PieceEncoder:
    """Token ids of texts as little-endian uint32 bytes. ``encode_pieces`` maps a list of pieces to such bytes.

    A piece is looked up in parts, so that more are alike: its lines, and symbols that follow a line's letters. The cache lives as
    long as the process. It is emptied before it would hold more than CACHED_PIECES, but always holds those of a run of WAITING
    characters; pieces of more than CACHED_LENGTH characters leave it after each run.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]]):
        self.encode_pieces = encode_pieces
        self.cache: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> list[str]:
        """Bring the ids of the pieces, with their leading space, into the cache. Returns the long ones, to be forgotten after use."""
        cache, others = self.cache, self.others
        new = pieces.difference(cache)
        if len(cache) + len(others) + len(new) > CACHED_PIECES:
            cache.clear()
            others.clear()
            new = pieces
        wanted, ended, lined, rest = {}, [], [], {}
        for p in new:
            if p.isalpha():
                wanted[p] = None
            elif (stem := p.rstrip(_SYMBOLS)).isalpha():
                ended.append((p, stem))
                if stem not in cache:
                    wanted[stem] = None
            elif "\n" in p and _LINES.fullmatch(p):
                first, *lines = p.split("\n")
                parts = [(first, first.rstrip(_SYMBOLS)), *(("\n" + x, "\n" + x.rstrip(_SYMBOLS)) for x in lines)]
                parts = [(x, stem) if stem[i > 0 :].isalpha() else (x, x) for i, (x, stem) in enumerate(parts)]
                lined.append((p, parts))
                if (stem := parts[0][1]) not in cache:
                    wanted[stem] = None
                rest.update((stem, None) for _, stem in parts[1:] if stem not in others)
            else:
                wanted[p] = None
        made = self.encode_pieces([*[" " + p for p in wanted], *rest])
        cache.update(zip(wanted, made, strict=False))
        others.update(zip(rest, made[len(wanted) :], strict=True))
        for p, stem in ended:
            cache[p] = cache[stem] + self._symbols(p[len(stem) :])
        for p, parts in lined:
            ids = [cache[parts[0][1]], *(others[stem] for _, stem in parts[1:])]
            cache[p] = b"".join([y for x, (part, stem) in zip(ids, parts, strict=True) for y in (x, self._symbols(part[len(stem) :]))])
        for p in [p for p in rest if len(p) > CACHED_LENGTH]:
            del others[p]
        return [p for p in {*new, *wanted} if len(p) > CACHED_LENGTH]

    def _forget(self, pieces: list[str]) -> None:
        for p in pieces:
            del self.cache[p]

    def _symbols(self, run: str) -> bytes:
        if not run:
            return b""
        known = self.marks.get(run)
        if known is None:
            known = self.encode_pieces([run])[0]
            if len(self.marks) < CACHED_PIECES and len(run) <= CACHED_LENGTH:
                self.marks[run] = known
        return known

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """One result for each text, in order. Nothing here makes cycles, and a collector would walk the whole cache again and again."""
        was_on = gc.isenabled()
        gc.disable()
        try:
            return list(self._encoded(texts))
        finally:
            if was_on:
                gc.enable()

    def _encoded(self, texts: Iterable[str]) -> Iterator[bytes]:
        waiting: list[str] = []
        size = 0
        for text in texts:
            if len(text) > SEGMENT:
                yield from self._flush(waiting)
                waiting, size = [], 0
                yield b"".join(self._long(text))
                continue
            waiting.append(text)
            size += len(text)
            if size >= WAITING:
                yield from self._flush(waiting)
                waiting, size = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[str]) -> Iterator[bytes]:
        """Texts are split twice, as all their pieces at once would take many times their size."""
        heads, pieces = [], set()
        for text in waiting:
            first, *rest = split(text)
            heads.append(first)
            pieces.update(rest)
        if not heads:
            return
        long = self._learn(pieces)
        found = self.cache.__getitem__
        for head, text in zip(self.encode_pieces(heads), waiting, strict=True):
            _, *rest = split(text)
            yield head + b"".join(map(found, rest))
        self._forget(long)

    def _long(self, text: str) -> Iterator[bytes]:
        for i, segment in enumerate(segments(text)):
            pieces = split(segment)
            if i == 0:
                yield self.encode_pieces(pieces[:1])[0]
                pieces = pieces[1:]
            long = self._learn(set(pieces))
            yield b"".join(map(self.cache.__getitem__, pieces))
            self._forget(long)


def list_array(buffers: list[bytes]):
    """An Arrow list<int32> array of uint32 byte buffers."""
    import pyarrow as pa

    offsets = np.zeros(len(buffers) + 1, np.int32)
    np.cumsum([len(b) // 4 for b in buffers], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(buffers))]))
