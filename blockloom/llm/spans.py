"""Cutting the bytes of many texts between pre-tokens of GPT-2's pattern at once, so that each distinct span is encoded once.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. A cut stands only where a match
must end and the part before ends in no white space, or in one line end only, whose match no look-ahead changes: between letters,
digits and symbols, before a space or line end, and after a line end. No cut stands between an apostrophe and a letter
(contractions), after a space (it joins what follows), or beside characters of a kind not known here, except before the space or
line end that follows one. Known are ASCII and the letters from U+00C0 to U+00FF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Bytes of text that are cut at a time; more where they hold no cut.
BLOCK = 4 << 20
#: Spans in each of two caches.
GENERATION = 300_000
CACHED_LENGTH = 48
#: Kinds of bytes. OTHER is the last byte of any other character that is no white space.
UNKNOWN, LETTER, DIGIT, SYMBOL, QUOTE, SPACE, LINE, OTHER = range(8)


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = SYMBOL
    for first, last, kind in (("a", "z", LETTER), ("A", "Z", LETTER), ("0", "9", DIGIT), ("'", "'", QUOTE), (" ", " ", SPACE), ("\n", "\n", LINE)):
        kinds[ord(first) : ord(last) + 1] = kind
    return kinds


def _pairs(after: dict[int, tuple[int, ...]]) -> np.ndarray:
    """By 8 * left + right: may a cut stand there?"""
    allowed = np.zeros((8, 8), bool)
    for left, right in after.items():
        allowed[left, list(right)] = True
    return allowed.ravel()


_KINDS = _kinds()
_CUT = _pairs({LETTER: (DIGIT, SYMBOL, QUOTE, SPACE, LINE), DIGIT: (LETTER, SYMBOL, QUOTE, SPACE, LINE), SYMBOL: (LETTER, DIGIT, SPACE, LINE), QUOTE: (SPACE, LINE), OTHER: (SPACE, LINE)})
_CUT_AFTER_LINE = _pairs({LINE: (LETTER, DIGIT, SYMBOL, QUOTE)})
#: The white space beyond ASCII, by the last three bytes or two.
_SPACES = np.array([int.from_bytes(chr(c).encode()) for c in (0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)], np.int32)
_SHORT_SPACES = np.array([0xC285, 0xC2A0], np.int32)


def cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where spans of these UTF-8 bytes begin, ascending, ``starts`` (of texts) included. ``raw`` begins and ends between characters,
    or its end is cut off anywhere and what follows its last cut is not used."""
    kinds = _KINDS[raw]
    letters = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    kinds[:-1] |= letters.view(np.uint8)
    kinds[1:] |= letters.view(np.uint8)
    if len(last := np.flatnonzero((raw >= 0x80) & (kinds == UNKNOWN))):
        last = last[(raw[np.minimum(last + 1, len(raw) - 1)] & 0xC0 != 0x80) & (last >= 1)]
        two = raw[last - 1].astype(np.int32) << 8 | raw[last]
        three = np.where(last >= 2, raw[last - 2], 0).astype(np.int32) << 16 | two
        kinds[last[~np.isin(three, _SPACES) & ~np.isin(two, _SHORT_SPACES)]] = OTHER
    pairs = kinds[:-1] << 3 | kinds[1:]
    cut = np.zeros(len(raw), bool)
    cut[1:] = _CUT[pairs]
    cut[starts] = True
    cut[1:] |= _CUT_AFTER_LINE[pairs] & cut[:-1]
    return np.flatnonzero(cut)


def _blocks(raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, borders of spans from there) of runs of about BLOCK bytes."""
    at = 0
    while at < len(raw):
        size = BLOCK
        while True:
            stop = min(at + size, len(raw))
            own = starts[np.searchsorted(starts, at) : np.searchsorted(starts, stop)] - at
            borders = cuts(raw[at:stop], np.append(own, 0))
            if stop == len(raw):
                borders = np.append(borders, stop - at)
            if len(borders) > 1:
                break
            size *= 2
        yield at, borders.astype(np.int32)
        at += int(borders[-1])


class SpanEncoder:
    """Token ids of texts as little-endian uint32 bytes. ``encode_spans`` maps a list of spans (UTF-8) to such bytes.

    Ids stay known in two caches that live as long as the process: a full one takes the place of the older one, whose spans come
    back when they are met again. Spans of more than CACHED_LENGTH bytes aren't kept.
    """

    def __init__(self, encode_spans: Callable[[list[bytes]], list[bytes]]):
        self.encode_spans = encode_spans
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, spans: list[bytes]) -> list[bytes]:
        ids = [*map(self.young.get, spans)]
        missing = [i for i, x in enumerate(ids) if x is None]
        for i in missing:
            ids[i] = self.old.get(spans[i])
        new = [i for i in missing if ids[i] is None]
        for i, x in zip(new, self.encode_spans([spans[i] for i in new]), strict=True):
            ids[i] = x
        kept = {spans[i]: ids[i] for i in missing if len(spans[i]) <= CACHED_LENGTH}
        if len(self.young) + len(kept) > GENERATION:
            self.old, self.young = self.young, {}
        self.young.update(kept)
        return ids

    def encode(self, texts):
        """An Arrow array large_binary for an Arrow array of strings; null texts are empty."""
        import pyarrow as pa

        texts = texts.fill_null("").cast(pa.string())
        _, offsets, data = texts.buffers()
        rows = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data or b"", np.uint8)[rows[0] : rows[-1]]
        rows = rows - rows[0]
        begins, made, total = np.zeros(len(rows), np.int64), [], 0
        for at, borders in _blocks(raw, rows):
            spans = pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(raw[at : at + borders[-1]])]).dictionary_encode()
            ids = self._ids(spans.dictionary.to_numpy(zero_copy_only=False).tolist())
            ends = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)), out=ends[1:])
            taken = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(ids))]).take(spans.indices)
            ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(borders)]
            lo, hi = np.searchsorted(rows, (at, at + int(borders[-1])))
            begins[lo:hi] = total + ends[np.searchsorted(borders, rows[lo:hi] - at)]
            made.append(memoryview(taken.buffers()[2] or b"")[: ends[-1]])
            total += int(ends[-1])
            begins[hi:] = total
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(begins), pa.py_buffer(b"".join(made))])
