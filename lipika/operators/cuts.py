"""Texts cut in blocks inside tasks: the distinct tokens of lexical.tokens(), and hashed runs of words. A block of texts is one array of characters, so no token is an object of its own."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts in a block; a longer text is a block of its own.
BLOCK, SMALL = 1 << 21, 1 << 18
#: Below this, an array by value finds the places of values; above, a search among them.
BY_VALUE = 1 << 24
MOST = (1 << 63) - 1
#: White space of regular expressions with (?U).
UNICODE_SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """First row and texts, null as empty, of about size bytes each."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        done = ends[a - 1] if a else 0
        z = max(a + 1, int(np.searchsorted(ends, done + size, "right")))
        yield a, texts.slice(a, z - a)
        a = z


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes one after the other, and the places between the texts (one more than texts)."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _strings(chars: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings of characters (code points) that end at these places."""
    wide = np.flatnonzero(chars > 0x7F)
    more = np.concatenate([[0], np.cumsum(1 + (chars[wide] > 0x7FF) + (chars[wide] > 0xFFFF))])
    at = np.concatenate([[0], ends + more[np.searchsorted(wide, ends)]]).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(at), pa.py_buffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode()))


def _places(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and of each value its place among them."""
    if bound > BY_VALUE:
        own = _distinct(values)
        return own, np.searchsorted(own, values)
    seen = np.zeros(bound, bool)
    seen[values] = True
    own = np.flatnonzero(seen)
    place = np.zeros(bound, np.int32)
    place[own] = np.arange(len(own))
    return own, place[values]


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting (numpy's unique hashes, which takes several times as long)."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _apart(keys: np.ndarray, n: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """i and k of sorted keys i * bound + k with i < n, without a division a key."""
    between = np.searchsorted(keys, (np.arange(n + 1) * bound).astype(keys.dtype))
    at = np.repeat(np.arange(n), np.diff(between))
    return at, keys[: between[-1]] - np.repeat((np.arange(n) * bound).astype(keys.dtype), np.diff(between))


@dataclass(frozen=True)
class Cut:
    """Distinct tokens of the texts of a block: a pair (text, token) each, by places in the block and in the vocabulary."""

    n: int
    text: np.ndarray
    token: np.ndarray
    vocabulary: pa.Array

    def lengths(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n)

    def counts(self) -> pa.Table:
        """token and n, the texts that have it."""
        return pa.table({"token": self.vocabulary, "n": np.bincount(self.token, minlength=len(self.vocabulary))})


class Cutter:
    """Cuts blocks of texts as lexical.tokens() does, by code points: words without their edges, n-grams of the characters without spaces, and both with short vowels. empty: the one token of a text without any (None: it has none)."""

    def __init__(self, n: int, hybrid: bool, edges: str, long: str, short: str, empty: str | None = None) -> None:
        self.n, self.hybrid, self.empty, self.folds = n, hybrid, empty, str.maketrans(long, short)
        self.kind = np.zeros(0x110000, np.uint8)  # 1: white space, 2: edge, 4: long vowel
        for flag, chars in ((1, UNICODE_SPACES), (2, edges), (4, long)):
            self.kind[[ord(x) for x in chars]] |= flag
        self.fold = np.arange(0x110000, dtype=np.uint32)
        self.fold[[ord(x) for x in long]] = [ord(x) for x in short]

    def cut(self, texts: pa.Array) -> Cut:
        try:
            listed = texts.to_pylist()
        except UnicodeDecodeError:
            listed = [x.decode(errors="replace") for x in texts.cast(pa.binary()).to_pylist()]
        joined = "\n".join([*listed, ""])  # white space ends every text
        sizes = np.fromiter(map(len, listed), np.int64, len(listed))
        gaps = np.fromiter((x.count(" ") for x in listed), np.int64, len(listed))
        grams = self._grams(np.frombuffer(joined.replace(" ", "").encode("utf-32-le"), "<u4"), np.cumsum(sizes - gaps + 1) - 1)
        # a text too short for n-grams is its own only one, and goes with the words
        rest = [(i, listed[i].replace(" ", "")) for i in np.flatnonzero((sizes > 0) & (sizes - gaps < self.n)).tolist()]
        if self.empty is not None:
            rest += [(i, self.empty) for i in np.flatnonzero(sizes == 0).tolist()]
        words = self._words(np.frombuffer(joined.encode("utf-32-le"), "<u4"), np.cumsum(sizes + 1), rest)
        return Cut(len(listed), np.concatenate([grams[0], words[0]]), np.concatenate([grams[1], words[1] + len(grams[2])]), pa.concat_arrays([grams[2], words[2]]))

    def _grams(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Pairs as in Cut, of texts that end before these places. An n-gram is a number in the block's own alphabet; prefixes are numbered anew where it would not fit 63 bits."""
        n, m = self.n, len(chars) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
        seen = np.zeros(0x110000, bool)
        seen[chars] = True
        seen[self.fold[seen.nonzero()[0]]] = True
        alphabet, number = np.flatnonzero(seen), np.cumsum(seen, dtype=np.int32) - 1
        place, fold, size = number[chars], number[self.fold[alphabet]], len(alphabet)
        kind = np.int32 if size**n * (len(ends) + 1) < 1 << 31 else np.int64
        # n-grams with a long vowel, once more with short ones
        long = np.flatnonzero((self.kind[alphabet] == 4)[place])
        some = np.zeros(m, bool)
        for j in range(n):
            some[(long - j)[(long >= j) & (long - j < m)]] = True
        across = (ends[:, None] - np.arange(n)).ravel()
        across = across[(across >= 0) & (across < m)]
        some[across] = False
        some = np.flatnonzero(some)
        short = fold[place]
        key, bound, levels = np.concatenate([place[:m], short[some]]).astype(kind), size, []
        for j in range(1, n):
            own = None
            if bound > MOST // size:
                own, key = _places(key, bound)
                bound = len(own)
            levels.append(own)
            key = key.astype(kind, copy=False) * kind(size)
            key[:m] += place[j : m + j]
            key[m:] += short[some + j]
            bound *= size
        own = None
        if bound > MOST // (len(ends) + 1):
            own, key = _places(key, bound)
            bound = len(own)
        levels.append(own)
        key = key.astype(kind, copy=False)
        firsts = (np.arange(len(ends)) * bound).astype(kind)
        key[:m] += np.repeat(firsts, np.diff(ends, prepend=-1))[:m]
        key[m:] += firsts[np.searchsorted(ends, some)]
        key[across] = len(ends) * bound  # no text's: cut off as the last
        at, key = _apart(_distinct(key), len(ends), bound)
        names, token = _places(key, bound)
        spelt = np.empty((len(names), n), np.uint32)
        for j in range(n - 1, -1, -1):
            if levels[j] is not None:
                names = levels[j][names]
            spelt[:, j] = alphabet[names % size]
            names = names // size
        return at, token, _strings(spelt.ravel(), np.arange(1, len(spelt) + 1) * n)

    def _words(self, chars: np.ndarray, ends: np.ndarray, rest: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Pairs as in Cut, of words that are no n-grams by their length, and of rest. A text and the white space after it end at these places."""
        rest = [(i, y) for i, x in rest for y in (x, x.translate(self.folds))]
        at, listed = np.array([i for i, _ in rest], np.int64), pa.array([x for _, x in rest], pa.string())
        if self.hybrid and len(chars):
            kind = self.kind[chars]
            turns = np.diff((kind != 1).view(np.int8), prepend=np.int8(0))
            first, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
            edge = kind == 2
            more = np.arange(len(first))
            for _ in range(100):  # few words have many edges
                first[more] += edge[first[more]]
                end[more] -= edge[end[more] - 1] & (first[more] < end[more])
                more = more[(edge[first[more]] | edge[end[more] - 1]) & (first[more] < end[more])]
                if not len(more):
                    break
            else:
                core = np.concatenate([[-1], np.flatnonzero(kind & 3 == 0), [len(chars)]])
                first[more], end[more] = core[np.searchsorted(core, first[more])], core[np.searchsorted(core, end[more]) - 1] + 1
            fits = (end > first) & (end - first != self.n)
            first, end = first[fits], end[fits]
            text = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(first, ends), prepend=0))
            inside = np.zeros(len(chars) + 1, np.int8)
            inside[first] = 1
            inside[end] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
            # words with long vowels, once more with short ones
            long = np.flatnonzero(kind == 4)
            long = _distinct(np.searchsorted(end, long[inside[long]], "right"))
            size = (end - first)[long]
            own = np.arange(size.sum()) + np.repeat(first[long] - (np.cumsum(size) - size), size)
            spelt = _strings(np.concatenate([chars[inside], self.fold[chars[own]]]), np.cumsum(np.concatenate([end - first, size])))
            at, listed = np.concatenate([at, text, text[long]]), pa.concat_arrays([listed, spelt])
        coded = listed.dictionary_encode()
        names, token = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        size = max(1, len(names))
        return *_apart(_distinct(at * size + token), len(ends), size), names


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Runs:
    """64-bit hashes of width consecutive words (what has no ASCII white space) of texts. Equal words give equal hashes in every text and task."""

    def __init__(self, width: int) -> None:
        self.width, self.powers, self.inverse = width, _powers(ODD, SMALL), _powers(ODD_INVERSE, SMALL)
        self.space = np.zeros(256, bool)
        self.space[list(b"\t\n\x0b\x0c\r ")] = True

    def hashes(self, texts: pa.Array, inner: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, hash and bytes (of the words alone) of each run; inner: without the first and the last word of a text."""
        data, at = _bytes_of(texts)
        none = np.zeros(0, np.int64)
        if not len(data):
            return none, none, none
        if len(data) > len(self.powers):
            self.powers, self.inverse = _powers(ODD, len(data)), _powers(ODD_INVERSE, len(data))
        word = ~self.space[data]
        before = np.concatenate([[False], word[:-1]])
        before[at[:-1][at[:-1] < len(data)]] = False
        after = np.concatenate([word[1:], [False]])
        after[at[1:][at[1:] > 0] - 1] = False
        first, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        text = np.searchsorted(at, first, "right") - 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], dtype=np.uint64)])
        h = (total[end] - total[first]) * self.inverse[first]
        h = (h ^ (h >> np.uint64(32))) * ODD
        h ^= h >> np.uint64(29)
        m = len(h) - self.width + 1
        if m <= 0:
            return none, none, none
        run, size = np.zeros(m, np.uint64), np.zeros(m, np.int64)
        for j in range(self.width):
            run = (run ^ (run >> np.uint64(31))) * ODD + h[j : m + j]
            size += (end - first)[j : m + j]
        fits = text[:m] == text[self.width - 1 :]
        if inner:
            fits &= np.concatenate([[False], text[: m - 1] == text[1:m]])
            fits &= np.concatenate([text[self.width - 1 : -1] == text[self.width :], [False]])
        fits = np.flatnonzero(fits)
        return text[fits], run[fits].view(np.int64), size[fits]


class Found:
    """Which of many values are among a few: most are told by some bits of theirs alone."""

    def __init__(self, few: np.ndarray) -> None:
        self.few = _distinct(few)
        bits = max(16, min(24, 4 + int(len(self.few)).bit_length()))
        self.shift, self.seen = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.seen[self.few.view(np.uint64) >> self.shift] = True

    def at(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the values of those found, and their places among the few (sorted)."""
        maybe = np.flatnonzero(self.seen[values.view(np.uint64) >> self.shift])
        if not len(self.few):
            return maybe, maybe
        place = np.minimum(np.searchsorted(self.few, values[maybe]), len(self.few) - 1)
        same = self.few[place] == values[maybe]
        return maybe[same], place[same]
