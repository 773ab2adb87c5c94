"""Vectorised byte-pair encoding equal to the ``tokenizers`` library's.

A slice of texts is cut into words on its code points (the split patterns of
the two vocabulary files, as run-boundary rules), words are told apart by a
64-bit hash of their bytes, and only words that the task has not met before
are encoded: from a transducer lexicon (see ``transducer``) or by exact
merges, many words of equal length at a time."""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np

from .textbuf import Slice, SpanHash

#: Words kept per Python worker before its cache starts afresh (about 50 MB).
CACHE_WORDS = 1 << 18
#: Longer words merge one by one with a heap instead of in a matrix.
MATRIX_BYTES = 96
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
# Code points with the White_Space property.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def char_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte where each begins."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.int32), np.arange(len(data))
    pos = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[pos].astype(np.int32)
    cp = lead.copy()
    at = lambda sel, k: data[pos[sel] + k].astype(np.int32) & 0x3F
    two, three, four = (np.flatnonzero((lead >= lo) & (lead < hi)) for lo, hi in ((0xC0, 0xE0), (0xE0, 0xF0), (0xF0, 0x100)))
    cp[two] = (lead[two] & 0x1F) << 6 | at(two, 1)
    cp[three] = (lead[three] & 0x0F) << 12 | at(three, 1) << 6 | at(three, 2)
    cp[four] = (lead[four] & 0x07) << 18 | at(four, 1) << 12 | at(four, 2) << 6 | at(four, 3)
    return cp, pos


def split_words(s: Slice, keep_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a slice.

    ``keep_space``: the byte-level split, where a space opens the next word and
    other white space forms words; else white space is dropped and each digit
    stands alone. In both, 's 't 're 've 'm 'll 'd are cut off at an apostrophe
    that begins a word."""
    cp, pos = code_points(s.data)
    n = len(cp)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = char_classes()[cp]
    row = np.zeros(n + 1, bool)
    row[np.searchsorted(pos, s.offsets)] = True  # the row's first char; the end of all
    start = np.r_[True, c[1:] != c[:-1]] | row[:-1]
    space = c == SPACE
    if keep_space:
        after = np.flatnonzero(start[1:] & ~row[1:-1] & ~space[1:] & space[:-1]) + 1
        start[after - 1] = True
        start[after] = cp[after - 1] != 32
    else:
        start |= c == NUMBER
        start &= ~space
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        ahead = lambda k: np.where(quote + k < n, cp[np.minimum(quote + k, n - 1)], 0)
        cut = lambda k: np.searchsorted(np.flatnonzero(row), quote, "right") == np.searchsorted(np.flatnonzero(row), quote + k, "right")
        one, two = ahead(1), ahead(2)
        short = np.isin(one, [ord(x) for x in "stmd"]) & cut(1)
        long = ((((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))) & cut(2)
        for sel, k in ((short, 2), (long, 3)):
            q = quote[sel]
            start[q + 1] = False
            inner = q[q + k < n] + k
            start[inner] |= ~space[inner] if not keep_space else True
    first = np.flatnonzero(start)
    pos = np.r_[pos, len(s.data)]
    if keep_space:
        end = np.r_[first[1:], n]
    else:
        stop = np.flatnonzero(np.r_[start | space, True] | row)
        end = stop[np.searchsorted(stop, first, "right")]
    return pos[first], pos[end]


class Vocabulary:
    """Symbols and merge ranks of a ``tokenizers`` BPE file over bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = [b for b in range(256) if b not in set(printable)]
        char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(spare)}
        back = {c: b for b, c in char.items()}
        self.byte_id = np.array([vocab[char[b]] for b in range(256)])
        self.last_id = np.array([vocab[char[b] + self.suffix] for b in range(256)])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        by = np.argsort(key)
        self.pair = np.r_[key[by], np.int64((1 << 63) - 1)]
        self.rank = np.r_[by, len(key)]
        self.none = len(key)
        self.merged = np.array([vocab[a + b] for a, b in pairs] + [0])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        text = [b""] * size
        for t, i in vocab.items():
            if t not in self.special:
                text[i] = bytes(back[c] for c in t.removesuffix(self.suffix)) if self.suffix else bytes(back[c] for c in t)
        for t, i in self.special.items():
            text[i] = t.encode()
        self.text_offsets = np.r_[0, np.cumsum([len(t) for t in text])]
        self.text_bytes = np.frombuffer(b"".join(text), np.uint8)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a << 32 | b
        at = np.searchsorted(self.pair, k)
        return np.where(self.pair[at] == k, self.rank[at], self.none)

    def _merge_matrix(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Words of one length as rows of bytes -> (row numbers, ids) parts."""
        out, left = [], np.arange(len(w))
        sym = self.byte_id[w]
        sym[:, -1] = self.last_id[w[:, -1]]
        rank = self.ranks(sym[:, :-1], sym[:, 1:])
        while sym.shape[1] > 1:
            p = rank.argmin(1)
            best = rank[np.arange(len(p)), p]
            go = best < self.none
            if not go.all():
                out.append((left[~go], sym[~go]))
                left, sym, rank, p, best = left[go], sym[go], rank[go], p[go], best[go]
            if not len(left):
                return out
            r, m = np.arange(len(p)), sym.shape[1]
            sym[r, p] = self.merged[best]
            keep = np.arange(m)[None, :] != (p + 1)[:, None]
            sym = sym[keep].reshape(len(p), m - 1)
            keep = np.arange(m - 1)[None, :] != p[:, None]
            rank = rank[keep].reshape(len(p), m - 2)
            if m > 2:
                q = p > 0
                rank[r[q], p[q] - 1] = self.ranks(sym[r[q], p[q] - 1], sym[r[q], p[q]])
                q = p < m - 2
                rank[r[q], p[q]] = self.ranks(sym[r[q], p[q]], sym[r[q], p[q] + 1])
        out.append((left, sym))
        return out

    def _merge_long(self, w: bytes) -> list[int]:
        import heapq
        a = np.frombuffer(w, np.uint8)
        sym = self.byte_id[a].tolist()
        sym[-1] = int(self.last_id[a[-1]])
        n = len(sym)
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = self.ranks(np.array(sym[:-1]), np.array(sym[1:]))
        heap = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(rank.tolist()) if r < self.none]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = right[i]
            if sym[i] != x or j < 0 or sym[j] != y:
                continue
            sym[i], sym[j], right[i] = int(self.merged[r]), -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for u, v in ((left[i], i), (i, right[i])):
                if u >= 0 and v >= 0:
                    k = int(self.ranks(np.array([sym[u]]), np.array([sym[v]]))[0])
                    if k < self.none:
                        heapq.heappush(heap, (k, u, sym[u], sym[v]))
        return [x for x in sym if x >= 0]

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact ids of byte spans: (flat ids, offsets)."""
        size = end - start
        count = np.zeros(len(start), np.int64)
        parts = []
        for m in np.unique(size).tolist():
            which = np.flatnonzero(size == m)
            if m > MATRIX_BYTES:
                for i in which.tolist():
                    ids = np.array([self._merge_long(data[start[i]:end[i]].tobytes())])
                    parts.append((np.array([i]), ids))
            else:
                for at in range(0, len(which), 1 << 16):
                    own = which[at:at + (1 << 16)]
                    got = self._merge_matrix(data[start[own][:, None] + np.arange(m)])
                    parts += [(own[r], ids) for r, ids in got if len(r)]
        for r, ids in parts:
            count[r] = ids.shape[1]
        offsets = np.r_[0, np.cumsum(count)]
        flat = np.zeros(offsets[-1], np.int32)
        for r, ids in parts:
            flat[offsets[r][:, None] + np.arange(ids.shape[1])] = ids
        return flat, offsets


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def ragged(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of the ranges ``which`` one after another, and their ends
    (one more than ranges, from 0)."""
    size = offsets[which + 1] - offsets[which]
    ends = np.r_[0, np.cumsum(size)]
    return np.arange(ends[-1]) + np.repeat(offsets[which] - ends[:-1], size), ends


class Encoder:
    """Encodes slices; holds a bounded cache of encoded words."""

    def __init__(self, path: str, lexicon=None):
        self.v = vocabulary(path)
        self.keep_space = not self.v.suffix
        self.lexicon = lexicon
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.flat, self.offsets = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    def _add(self, hashes: np.ndarray, data, start, end) -> None:
        ids, off = None, None
        if self.lexicon is not None:
            number = self.lexicon.find(data, start, end)
            known = number >= 0
            for sel, (f, o) in ((known, self.lexicon.ids(number[known])), (~known, self.v.merge(data, start[~known], end[~known]))):
                self._store(hashes[sel], f, o)
            return
        ids, off = self.v.merge(data, start, end)
        self._store(hashes, ids, off)

    def _store(self, hashes: np.ndarray, ids: np.ndarray, off: np.ndarray) -> None:
        n, used = len(self.place), self.offsets[len(self.place)]
        while len(self.flat) < used + len(ids):
            self.flat = np.r_[self.flat, np.empty_like(self.flat)]
        while len(self.offsets) < n + len(off):
            self.offsets = np.r_[self.offsets, np.empty_like(self.offsets)]
        self.flat[used:used + len(ids)] = ids
        self.offsets[n:n + len(off)] = off + used
        self.place.update(zip(hashes.tolist(), range(n, n + len(hashes)), strict=True))

    def normalise(self, s: Slice) -> Slice:
        """NFC and lower case per code point, for the vocabulary with word ends."""
        rows = []
        for i in range(len(s)):
            t = s.text(i)
            if not t.isascii():
                t = unicodedata.normalize("NFC", t).replace("Σ", "σ")
            rows.append(t.lower().encode("utf-8", "surrogatepass"))
        return Slice(s.start, np.frombuffer(b"".join(rows), np.uint8), np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64))

    def _special(self, s: Slice):
        """The slice with rows cut at special strings: pieces, and per row its
        list of piece numbers (>= 0) and special ids (as -1 - id)."""
        import re
        cut = re.compile(b"(" + b"|".join(re.escape(t.encode()) for t in sorted(self.v.special, key=len, reverse=True)) + b")")
        pieces, plan = [], []
        for i in range(len(s)):
            own = []
            for x in cut.split(s.data[s.offsets[i]:s.offsets[i + 1]].tobytes()):
                if (t := x.decode("utf-8", "replace")) in self.v.special:
                    own.append(-1 - self.v.special[t])
                elif x:
                    own.append(len(pieces))
                    pieces.append(x)
            plan.append(own)
        off = np.r_[0, np.cumsum([len(p) for p in pieces])].astype(np.int64)
        return Slice(0, np.frombuffer(b"".join(pieces), np.uint8), off), plan

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows (int32) and each row's first id (one more than rows)."""
        raw = s.data.tobytes()
        if any(t.encode() in raw for t in self.v.special):
            cut, plan = self._special(s)
            ids, at = self._plain(cut)
            rows = [np.concatenate([[-1 - x] if x < 0 else ids[at[x]:at[x + 1]] for x in own]) if own else np.empty(0, np.int32) for own in plan]
            return np.concatenate(rows).astype(np.int32), np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
        return self._plain(s)

    def _plain(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        if not self.keep_space:
            s = self.normalise(s)
        start, end = split_words(s, self.keep_space)
        first = np.searchsorted(start, s.offsets)
        if not len(start):
            return np.empty(0, np.int32), np.zeros(len(s) + 1, np.int64)
        h = SpanHash(s.data)(start, end)
        uniq, example, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.place) + len(uniq) > CACHE_WORDS:
            self._clear()
        keys = uniq.tolist()
        get = self.place.get
        new = np.fromiter((get(k) is None for k in keys), bool, len(keys))
        if new.any():
            e = example[new]
            self._add(uniq[new], s.data, start[e], end[e])
        number = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))
        where, ends = ragged(self.offsets, number[which])
        return self.flat[where], ends[first]

    def token_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and where each id's begin."""
        where, ends = ragged(self.v.text_offsets, ids)
        return self.v.text_bytes[where], ends


@functools.cache
def worker_encoder(path: str) -> Encoder:
    """One encoder per Python worker: later tasks find its words encoded."""
    return Encoder(path)
