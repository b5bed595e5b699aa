"""Letter-and-digit tokens of many texts at once, as feature hashes with byte offsets."""

from __future__ import annotations

import numpy as np

from sondeflow.llm.common import U64, joined, mix64, span_hasher

_PART = np.zeros(256, bool)
_PART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_UPPER, _DIGIT, _HIGH = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B] = _DIGIT[0x30:0x3A] = _HIGH[0x80:] = True
#: Lengths in bytes of the beginnings, and of the end, that are features beside the whole token.
PREFIXES, SUFFIX = (4, 5, 6, 7), 4
#: Columns of the features that tell what a token is, and of all with its end, its neighbours and its shape.
OWN, ALL = 1 + len(PREFIXES), 1 + len(PREFIXES) + 4
_SALT = tuple(U64(0x9E3779B97F4A7C15 * k % (1 << 64)) for k in range(1, 5))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes (a row for each token: itself, its beginnings, its end, the tokens before and after it, its shape; 0 for those it lacks),
    text number, start and end within the text of each token, and the tokens' number for each text.

    A token is a run of ASCII letters and digits and of bytes above 0x7F; A-Z count as lower-case but in the shape: whether the first byte and the
    last are capitals, whether it holds digits or bytes above 0x7F, and its length up to 15.
    """
    data, at = joined(texts)
    edge = np.flatnonzero(np.diff(_PART[data], prepend=False)) if len(data) else np.zeros(0, np.int64)
    start, end = edge[0::2], edge[1::2]
    doc = np.searchsorted(at, start, "right") - 1
    h = np.zeros((len(start), ALL), U64)
    if len(start):
        hashed = span_hasher(data)
        h[:, 0] = hashed(start, end)
        for k, n in enumerate(PREFIXES):
            long = np.flatnonzero(end - start > n)
            h[long, k + 1] = mix64(hashed(start[long], start[long] + n) ^ U64(n))
        long = np.flatnonzero(end - start > SUFFIX + 1)
        h[long, OWN] = mix64(hashed(end[long] - SUFFIX, end[long]) ^ _SALT[0])
        same = np.flatnonzero(doc[1:] == doc[:-1])
        h[same + 1, OWN + 1] = mix64(h[same, 0] ^ _SALT[1])
        h[same, OWN + 2] = mix64(h[same + 1, 0] ^ _SALT[2])
        holds = lambda kind: np.add.reduceat(kind[data], start, dtype=np.int64) > 0  # noqa: E731 (what parts two tokens is neither)
        shape = _UPPER[data[start]] + 2 * _UPPER[data[end - 1]] + 4 * holds(_DIGIT) + 8 * holds(_HIGH) + 16 * np.minimum(end - start, 15)
        h[:, OWN + 3] = mix64(shape.astype(U64) ^ _SALT[3])
    return h, doc, start - at[doc], end - at[doc], np.bincount(doc, minlength=len(texts))
