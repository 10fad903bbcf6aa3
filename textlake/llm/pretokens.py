"""Cutting texts into the pre-tokens of byte-level vocabularies, over whole byte buffers.

The cuts are those of the pattern ``bpe.PATTERN``: a contraction; a run of letters, of digits
or of other signs, each with one blank before it; white space, whose last character stays
apart where something follows. All of it depends on neighbouring classes only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from .textcore import mix

LETTER, DIGIT, SIGN, BLANK, SPACE = 1, 2, 3, 4, 5


@lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    out = np.full(0x110000, SIGN, np.uint8)
    kinds = [(kind, regex.compile(pattern)) for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+"))]
    for first in range(0, len(out), 4096):  # blocks, as each worker makes this table
        codes = [c for c in range(first, first + 4096) if not 0xD800 <= c < 0xE000]
        every = "".join(map(chr, codes))
        for kind, pattern in kinds:
            for run in pattern.finditer(every):
                out[codes[run.start()] : codes[run.end() - 1] + 1] = kind
    out[32] = BLANK
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first bytes of the pre-tokens of documents laid end to end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.int32)
    wide = np.flatnonzero(code >= 0xC0)
    if len(wide):
        lead, p = code[wide], at[wide]
        more = [(data[np.minimum(p + k, n - 1)] & 63).astype(np.int32) for k in (1, 2, 3)]
        two, three = ((lead & 31) << 6) | more[0], ((lead & 15) << 12) | (more[0] << 6) | more[1]
        code[wide] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, ((lead & 7) << 18) | (more[0] << 12) | (more[1] << 6) | more[2]))
    kind = _classes()[code]
    begins = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])  # of documents, in characters
    edge = np.zeros(len(at) + 1, bool)
    edge[begins] = True
    edge[-1] = True
    before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
    before[begins] = 0
    after = np.append(kind[1:], 0).astype(np.uint8)
    after[edge[1:]] = 0
    white = kind >= BLANK
    start = np.where(white, (before < BLANK) | ((after > 0) & (after < BLANK)), (kind != before) & (before != BLANK))
    quote = np.flatnonzero((code == 39) & (before != BLANK) & (before != SIGN) & (after == LETTER))
    if len(quote):
        one = code[quote + 1]
        second = quote + 2
        inside = (second < len(at)) & ~edge[np.minimum(second, len(at))]
        two = np.where(inside, code[np.minimum(second, len(at) - 1)], 0)
        size = np.where(np.isin(one, [115, 116, 109, 100]), 2, np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        rest = quote + size
        rest = rest[(rest < len(at))]
        start[rest[(kind[rest] == LETTER)]] = True
    return at[start]


def hashes(data: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each pre-token."""
    from .textcore import _BASE, _POWERS

    n = len(data)
    up, down = _POWERS.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    end = np.append(cut[1:], n)
    return mix((total[end] - total[cut]) * down[cut] + (end - cut).astype(np.uint64) * _BASE)


def distinct(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct pre-token (an index into ``cut``), and which of these
    each pre-token is."""
    coded = pa.array(hashes(data, cut)).dictionary_encode()
    which = coded.indices.to_numpy()
    first = np.empty(len(coded.dictionary), np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    return first, which
