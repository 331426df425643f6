"""Splitting text into pre-tokens with a finite-state transducer that numpy runs over many chunks at once.

The transducer implements the published byte-level BPE split pattern (``public_tokenizers.PATTERN``:
contractions, letters, numbers and other marks with one optional leading space, white space). It reads
character classes and annotates each transition with the starts it reveals: at this character, or - once
a look-ahead is settled - at the one before.

A text block is cut into equal chunks regardless of content. Each chunk's map from every start state to its
end state is found, the maps are composed by a parallel prefix scan, and a second pass from the then
known start states emits the starts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

# character classes
_LETTER, _STMD, _R, _V, _E, _L, _NUMBER, _APOS, _BLANK, _SPACE, _OTHER, _END = range(12)
# states: fresh token; in letters, numbers, other; white space ending in a blank or otherwise; after ' 'r 'v 'l
_FRESH, _IN_L, _IN_N, _IN_O, _W_BLANK, _W_OTHER, _A, _AR, _AV, _AL = range(10)
HERE, BACK = 1, 2
#: Symbols in a chunk, and how many of its last ones usually settle its end state.
LANE, TAIL = 128, 12


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, _OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, at = "".join(map(chr, points)), np.array(points)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, text):
            table[at[m.start() : m.end()]] = kind
    for chars, kind in (("stmd", _STMD), ("r", _R), ("v", _V), ("e", _E), ("l", _L), ("'", _APOS), (" ", _BLANK)):
        for c in chars:
            table[ord(c)] = kind
    return table


@lru_cache(1)
def white_space() -> str:
    """All characters of white space."""
    return "".join(map(chr, np.flatnonzero(np.isin(classes(), (_BLANK, _SPACE))).tolist()))


@lru_cache(1)
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted starts by state and class."""
    into = {_LETTER: _IN_L, _STMD: _IN_L, _R: _IN_L, _V: _IN_L, _E: _IN_L, _L: _IN_L, _NUMBER: _IN_N, _APOS: _A, _BLANK: _W_BLANK, _SPACE: _W_OTHER, _OTHER: _IN_O, _END: _FRESH}
    letters, space = {_LETTER, _STMD, _R, _V, _E, _L}, {_BLANK, _SPACE}
    state, emit = np.zeros((10, 12), np.uint8), np.zeros((10, 12), np.uint8)
    for s in range(10):
        for c, fresh in into.items():
            to, out = fresh, HERE  # what a token begun here leads to
            if s == _IN_L and c in letters or s == _IN_N and c == _NUMBER:
                out = 0
            elif s == _IN_O and c in (_OTHER, _APOS):
                to, out = _IN_O, 0
            elif s in (_W_BLANK, _W_OTHER):
                if c in space:
                    out = 0
                elif c != _END:  # the last white space parts from the run; a blank joins what follows
                    out = BACK if s == _W_BLANK else BACK | HERE
                    to = _IN_O if s == _W_BLANK and c == _APOS else fresh
            elif s == _A:
                if c in (_STMD, _R, _V, _L):
                    to, out = {_STMD: _FRESH, _R: _AR, _V: _AV, _L: _AL}[c], 0
                elif c in (_OTHER, _APOS):
                    to, out = _IN_O, 0
            elif s in (_AR, _AV, _AL):
                if c == (_L if s == _AL else _E):
                    to, out = _FRESH, 0
                else:  # no contraction: the letter began a token of its own
                    out = BACK if c in letters else BACK | HERE
            state[s, c], emit[s, c] = to, out
    return state, emit


@lru_cache(1)
def steps() -> bytes:
    """``transitions`` as a byte table: of state (high four bits) and class (low), to next state and emitted starts."""
    state, emit = transitions()
    table = np.zeros((16, 16), np.uint8)
    table[:10, :12] = state << 4 | emit
    return table.tobytes()


def _step(now: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One step of many chunks; ``now`` has their states in its high four bits."""
    return np.frombuffer((now | row).tobytes().translate(steps()), np.uint8).reshape(now.shape)


def _end_states(symbols: np.ndarray) -> np.ndarray:
    """End state by start state (rows) of every chunk (columns); ``symbols`` has a row for each step."""
    now = np.repeat(np.arange(10, dtype=np.uint8)[:, None] << 4, symbols.shape[1], 1)
    for row in symbols:
        now = _step(now, row) & 0xF0
    return now >> 4


def start_states(symbols: np.ndarray) -> np.ndarray:
    """Each chunk's start state: chunk maps composed by a parallel (doubling) prefix scan."""
    maps = _end_states(symbols[-TAIL:])
    open_ = np.flatnonzero((maps != maps[0]).any(0))  # their last symbols don't settle the end
    if len(open_):
        maps[:, open_] = _end_states(symbols[:, open_])
    reach = 1
    while reach < maps.shape[1] and (maps != maps[0]).any():
        ahead = maps[:, reach:]
        maps = np.concatenate([maps[:, :reach], np.take_along_axis(ahead, maps[:, :-reach], 0)], 1)
        reach *= 2
    return np.concatenate([[np.uint8(_FRESH)], maps[_FRESH, :-1]])


def split(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the pre-tokens of valid UTF-8 rows start, and each row's first pre-token number.

    ``offs`` bounds the rows in ``data`` (rows + 1 values); the second result has as many values.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    lead = np.flatnonzero(np.ascontiguousarray(data).view(np.int8) >= -64)  # not 0x80 to 0xBF
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    rows = len(offs) - 1
    ends = np.searchsorted(lead, offs[1:])  # in characters
    total = len(points) + rows
    lanes = -(-total // LANE)
    flat = np.full(lanes * LANE, _END, np.uint8)
    real = np.ones(total, np.bool_)
    real[ends + np.arange(rows)] = False
    flat[:total][real] = classes()[points]
    symbols = np.ascontiguousarray(flat.reshape(lanes, LANE).T)
    now = start_states(symbols) << 4
    out = np.empty_like(symbols)
    for step, row in enumerate(symbols):
        out[step] = _step(now, row)
        now = out[step] & 0xF0
    out = np.ascontiguousarray(out.T).reshape(-1)
    begun = (out & HERE) > 0
    begun[:-1] |= (out[1:] & BACK) > 0
    starts = lead[begun[:total][real]]
    return starts, np.searchsorted(starts, offs)


def pieces(data: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> pa.DictionaryArray:
    """The pre-tokens as a dictionary-encoded binary array, without copying the text."""
    bounds = np.append(starts, len(data)).astype(np.int32)
    raw = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return raw.dictionary_encode()
