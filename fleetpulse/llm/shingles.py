"""Sets of hashed word shingles, computed for many texts at once."""

from __future__ import annotations

import numpy as np

from fleetpulse.llm.common import BYTE_KEYS, doc_slices, mix64

STEP = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray, offsets: np.ndarray, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of the texts; A-Z count as a-z.

    Words end at ASCII white space and at the text's end, with ``letters_only`` also at any other
    ASCII character than letters and digits.
    """
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    if letters_only:
        solid = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    else:
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = solid[edges]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.flatnonzero(first[at])
    lengths = np.diff(np.append(starts, len(at)))
    inside = np.arange(len(at)) - np.repeat(starts, lengths)
    # A random odd factor for each place: with powers of one number, some patterns of letters always clash.
    places = mix64(np.arange(1, int(lengths.max()) + 1, dtype=np.uint64) * STEP) | np.uint64(1)
    sums = np.add.reduceat(BYTE_KEYS[data[at]] * places[inside], starts)
    return mix64(sums + lengths.astype(np.uint64)), np.searchsorted(offsets, at[starts], side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """For each text, in order, the sorted array of the 64-bit hashes of its distinct k-word shingles.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    for i, j in doc_slices(offsets):
        words, owner = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        per_text = np.bincount(owner, minlength=j - i)
        n = max(len(words) - k + 1, 0)
        acc = np.zeros(n, np.uint64)
        for step in range(k):
            acc = mix64(acc * STEP + words[step : step + n])
        whole = owner[:n] == owner[k - 1 : k - 1 + n]
        hashes, texts = acc[whole], owner[:n][whole]
        cuts = np.searchsorted(texts, np.arange(j - i + 1))
        begin = np.concatenate([[0], np.cumsum(per_text)])
        for t in range(j - i):
            if 0 < per_text[t] < k:
                own = np.array([per_text[t]], np.uint64)
                for w in words[begin[t] : begin[t + 1]]:
                    own = mix64(own * STEP + w)
            else:
                own = np.sort(hashes[cuts[t] : cuts[t + 1]])
                new = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool)
                own = own if new.all() else own[new]
            yield own


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each hash in a map of 4096 to 65,536 bits, four or more per shingle up to that size."""
    width = 4096
    while width < 4 * len(hashes) and width < 1 << 16:
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of any widths as rows of the smallest of their widths."""
    least = min(map(len, maps))
    out = np.empty((len(maps), least), np.uint8)
    for r, m in enumerate(maps):
        a = np.frombuffer(m, np.uint8)
        out[r] = a if len(a) == least else np.bitwise_or.reduce(a.reshape(-1, least), axis=0)
    return out.view(np.uint64)
