"""Words and shingles of many texts at once, for operators on white-space words (inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

from lectern.llm import workers

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_B = np.uint64(0xD6E8FEB86659FD93)
_B_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
CHUNK = 4_000_000  # bytes hashed at a time; a longer text is a chunk of its own


def _forget_powers() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


workers.keeps("powers", _forget_powers)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_B, _B_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and stop (bytes, in its text) of every word of every text, and where each text's words begin (n + 1).

    Words are runs of bytes other than space and \\t-\\r; `fold` reads A-Z as a-z.
    """
    hashes, starts, stops, counts = [], [], [], []
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) < CHUNK):
            size += len(texts[to]) + 1
            to += 1
        part = texts[at:to]
        data = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        word = ~_WHITE[data]
        edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _power_arrays(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _TABLE)[data] * power, out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
        begins = np.cumsum([0] + [len(t) + 1 for t in part])
        of = np.searchsorted(begins, s, side="right") - 1
        starts.append(s - begins[of])
        stops.append(e - begins[of])
        counts.append(np.bincount(of, minlength=len(part)))
        at = to
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(stops), np.r_[0, np.cumsum(np.concatenate(counts))]


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive elements (fewer by n - 1), from elements' hashes."""
    out, k = h, 1
    bits = bin(n)[3:]
    c = np.uint64(0x9FB21C651E98DF25)
    for bit in bits:  # doubling, and one more where the number's binary form has a 1
        out = mix(out[:-k] * c + out[k:] + np.uint64(k)) if len(out) > k else out[:0]
        k *= 2
        if bit == "1":
            m = len(out) - 1
            out = mix(out[:m] * c + h[k : k + m] + np.uint64(k)) if m > 0 else out[:0]
            k += 1
    return out


_digests: dict[bytes, bytes] = {}


workers.keeps("digests", _digests.clear)


def digest_of(word: bytes) -> bytes:
    """A word's 128-bit BLAKE2b digest, remembered for the words met last."""
    found = _digests.get(word)
    if found is None:
        if len(_digests) > 100_000:
            _digests.clear()
        found = _digests[word] = blake2b(word, digest_size=16).digest()
    return found


def chunks(texts: list[str | None], rows: int, size: int = CHUNK // 2) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, up to `rows` and about `size` bytes at a time, and the place of the first of them."""
    at, held, n = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and (len(held) >= rows or n + len(data) > size):
            yield at, held
            at, held, n = i, [], 0
        held.append(data)
        n += len(data)
    if held:
        yield at, held


class Shingles:
    """The sets of n consecutive words (A-Z as a-z) of some texts: numbers that are equal just for equal words.

    A text of fewer words has its whole sequence as one.  `sets` are sorted arrays of numbers, `first` the place of each
    in `words`; word i is number words[i] in `known`, and `begins` says where each text's words begin.
    """

    def __init__(self, texts: list[bytes], n: int):
        numbers: dict[bytes, int] = {}
        number = numbers.setdefault
        lists = [[number(w, len(numbers)) for w in t.lower().split()] for t in texts]
        self.n, self.known = n, list(numbers)
        self.begins = np.cumsum([0, *map(len, lists)])
        self.words = np.concatenate([np.zeros(0, np.int64), *(np.array(own, np.int64) for own in lists)])
        codes = self._codes(len(numbers))
        short: dict[tuple[int, ...], int] = {}
        self.sets, self.first = [], []
        for s, e, own in zip(self.begins[:-1].tolist(), self.begins[1:].tolist(), lists, strict=True):
            if e - s >= n:
                found, at = np.unique(codes[s : e - n + 1], return_index=True)
                self.sets.append(found)
                self.first.append(at + s)
            else:
                self.sets.append(np.array([-1 - short.setdefault(tuple(own), len(short))] if own else [], np.int64))
                self.first.append(np.array([s] if own else [], np.int64))

    def _codes(self, kinds: int) -> np.ndarray:
        codes, size = self.words, kinds
        for j in range(1, self.n):
            if size * kinds >= 2**63:  # numbers anew, in the order of the old ones
                codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
                size = len(codes)
            codes = codes[:-1] * kinds + self.words[j:] if len(codes) > 1 else codes[:0]
            size *= kinds
        return codes

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each shingle of each set, all in a row; from 128-bit digests of the words."""
        lanes = np.frombuffer(b"".join(map(digest_of, self.known)), np.uint64).reshape(-1, 2)
        at = np.concatenate([np.zeros(0, np.int64), *self.first])
        found = []
        for lane in (0, 1):
            of_word = np.ascontiguousarray(lanes[:, lane])[self.words]
            every = combine(of_word, self.n)
            out = np.zeros(len(at), np.uint64)
            whole = at < len(every)
            out[whole] = every[at[whole]]
            place = 0
            for i, own in enumerate(self.first):
                s, e = int(self.begins[i]), int(self.begins[i + 1])
                if e > s and e - s < self.n:
                    out[place] = combine(of_word[s:e], e - s)[0] ^ np.uint64(e - s)
                place += len(own)
            found.append(out)
        return found[0], found[1]
