"""Token ids of whole text columns, encoded once per distinct segment.

A byte-level BPE vocabulary file (``tokenizers`` JSON) is read from a path given by the
caller.  A space or line feed between two characters that are no white space is always
the start of a pre-token of the byte-level pattern, so a text can be cut there and the
ids of its parts strung together.  Parts repeat a lot; Arrow's dictionary encoding finds
the distinct ones, each is encoded once, and numpy gathers the rest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

from .textops import SPACE, binary_array, ragged

#: The fixed pre-token pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Segments remembered from batch to batch by a worker; beyond it they are encoded anew.
_REMEMBERED = 200_000
#: Bytes of a very long text that are encoded at once.
_MOST = 4 << 20


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            letters[chr(spare)] = b
            spare += 1
    return letters


class SegmentEncoder:
    """Encodes concatenated UTF-8 texts to flat id arrays.

    With ``special`` the strings of special tokens in a text become their ids, as the library
    does by default; without it they are ordinary text.
    """

    def __init__(self, path: str, special: bool = False):
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        self._encode = _rank_encoder(vocabulary["model"]) or _library_encoder(path)
        self._special = [x["content"].encode() for x in vocabulary.get("added_tokens", [])] if special else []
        self._path, self._whole = path, None  # the library is loaded once a text needs it
        self._seen: dict[bytes, list[int]] = {}

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and where each row's ids start (one more at the end)."""
        ids, at = self._plain(data, off)
        raw = data.tobytes() if self._special else b""
        places = [m for x in self._special for m in _places(raw, x)]
        if not places:
            return ids, at
        self._whole = self._whole or _library_encoder(self._path, True)
        parts, done = [], 0  # the few texts that hold such a string are encoded whole
        sizes = np.diff(at)
        for row in np.unique(np.searchsorted(off, places, side="right") - 1).tolist():
            own = self._whole(raw[off[row] : off[row + 1]].decode("utf-8", "replace"))
            parts += [ids[done : at[row]], np.array(own, np.uint32)]
            done, sizes[row] = at[row + 1], len(own)
        return np.concatenate([*parts, ids[done:]]), np.concatenate(([0], np.cumsum(sizes)))

    def _plain(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without special tokens; very long texts are cut where a segment starts."""
        if len(data) <= 2 * _MOST:
            return self._few(data, off)
        ids, counts = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            lo, most, count = a, _MOST, 0
            while lo < b:
                hi = min(lo + most, b)
                if hi < b:
                    cuts = _cuts(data[lo:hi], np.array([0, hi - lo]))
                    if cuts[-1] == 0:  # one segment so far
                        most *= 2
                        continue
                    hi = lo + int(cuts[-1])
                ids.append(self._few(data[lo:hi], np.array([0, hi - lo]))[0])
                lo, most, count = hi, _MOST, count + len(ids[-1])
            counts.append(count)
        return np.concatenate(ids), np.concatenate(([0], np.cumsum(counts)))

    def _few(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        cuts = _cuts(data, off)
        bounds = np.append(cuts, len(data))
        coded = binary_array(data, bounds).dictionary_encode()
        parts, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        seen, encode = self._seen, self._encode
        ids = []
        for part in parts:
            got = seen.get(part)
            if got is None:
                got = encode(part.decode("utf-8", "replace"))
                if len(seen) < _REMEMBERED:
                    seen[part] = got
            ids.append(got)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        per = lengths[which]
        out = flat[ragged((np.cumsum(lengths) - lengths)[which], per)]
        before = np.concatenate(([0], np.cumsum(per)))
        return out, before[np.searchsorted(cuts, off)]


def _cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted starts of segments: row starts, and lone spaces and line feeds between plain characters.

    A neighbour is plain if it is no control character and no part of a character that
    might be white space (lead bytes C2, E1, E2 and E3 hold all of those).
    """
    n = len(data)
    plain = (data > 32) & (data != 127)
    lead = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
    ends = plain.copy()  # the character that ends here is plain
    for back in (0, 1, 2):
        ends[back:] &= ~(lead[: n - back] & (data[back:] >= 0x80))
    begins = plain & ~lead
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at < n - 1)]
    at = at[ends[at - 1] & begins[at + 1]]
    after = at[data[at] == 10] + 1
    mark = np.zeros(n + 1, dtype=bool)
    mark[at] = True
    mark[after] = True
    mark[off] = True
    mark[n] = False
    return np.flatnonzero(mark)


def _rank_encoder(model: dict):
    """The vocabulary as merge ranks, if its ids are the ranks of its merges; else None."""
    import tiktoken

    letters, vocab = _byte_letters(), model["vocab"]
    for place, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        if vocab.get(a + b) != 256 + place:
            return None
    ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if i < 256 + len(model["merges"])}
    return tiktoken.Encoding("from-json", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _library_encoder(path: str, special: bool = False):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = not special
    return lambda text: own.encode(text, add_special_tokens=False).ids


def _places(raw: bytes, part: bytes) -> Iterator[int]:
    at = raw.find(part)
    while at >= 0:
        yield at
        at = raw.find(part, at + 1)


@lru_cache(maxsize=2)
def encoder(path: str, special: bool = False) -> SegmentEncoder:
    """The worker's encoder for a vocabulary file."""
    return SegmentEncoder(path, special)
