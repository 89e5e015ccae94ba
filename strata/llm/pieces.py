"""SentencePiece encoding and decoding with a batched Viterbi in numpy.

Texts are cut into words where no piece can cross: before a space mark that
follows another character, and around characters that stand alone in every
piece. Equal words of a run are encoded once; words of equal length advance
together, one end position at a time, and a bounded number of words is
remembered for the next runs. Hashes of all substrings probe the sorted
keys of the pieces of that length, and the best candidate for each end position
is kept by a vectorised maximum with its length as backpointer.

- Unigram models: a candidate's value is the best sum of scores before it plus
  its own score.
- BPE models: scores order merges and do not add up, so the best sum would not
  be the model's encoding. A prefix of an encoding is the encoding of its text,
  and a chain of pieces is an encoding exactly if every adjacent pair, merged on
  its own, stays that pair. A candidate's value is therefore whether its pair
  with the best last piece before it is stable; exactly one is. Stable pairs are
  found by merging the pair's characters, and remembered in a bounded table.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import load, pick
from strata.llm.words import flat, mix, runs

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RUN_CHARS = 1 << 20
PAIRS = 1 << 20  #: remembered pairs of a task
WORDS, WORD_CHARS = 1 << 18, 32  #: remembered words of a task, and their length at most
BLOCK, OVERLAP = 1024, 128  #: blocks of longer words, and how far each starts before its place
SPACE = "▁"
FEW = 48  #: pairs that are faster merged one by one
NO_CHARACTER = np.uint32(0xFFFFFFFF)

# Numbers of the public model format.
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _fields(raw: bytes):
    """(number, value) of every field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {5: 4, 1: 8}[kind]
            yield tag >> 3, raw[at:at + size]
            at += size


class Vocabulary:
    """Pieces, scores and flags of a model file."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], bpe: bool, prefix: bool = True, byte_fallback: bool = True):
        self.pieces, self.scores, self.kinds, self.bpe, self.prefix = pieces, np.array(scores), kinds, bpe, prefix
        if _USER in kinds:
            raise ValueError("user-defined pieces are not supported")
        self.unknown = kinds.index(_UNKNOWN) if _UNKNOWN in kinds else 0
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == _BYTE} if byte_fallback else {}
        self.id = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == _NORMAL}
        self.crosses = any(SPACE in p.lstrip(SPACE) for p in self.id)
        joined = sorted({ord(c) for p in self.id if len(p) > 1 for c in p})
        self.joins = np.array(joined, np.uint32)  # characters that some longer piece holds
        self.keys = {}
        for length in sorted({len(p) for p in self.id}):
            names = [p for p in self.id if len(p) == length]
            h = _hash(np.array([[ord(c) for c in p] for p in names], np.uint32))
            order = np.argsort(h)
            self.keys[length] = (h[order], np.array([self.id[p] for p in names])[order])
        # for merging many pairs at once: characters of every piece as ids, and what two pieces merge into
        self.longest = max((len(p) for p in self.id), default=1)
        self.chars = np.full((len(pieces), self.longest), -1, np.int32)
        self.width = np.zeros(len(pieces), np.int32)  # 0: a piece with a character that is none
        merges = {}
        for p, i in self.id.items():
            if all(c in self.id for c in p):
                self.chars[i, :len(p)], self.width[i] = [self.id[c] for c in p], len(p)
            for k in range(1, len(p)):
                if p[:k] in self.id and p[k:] in self.id:
                    merges[self.id[p[:k]] * len(pieces) + self.id[p[k:]]] = i
        self.merge_keys = np.array(sorted(merges), np.int64)
        self.merge_ids = np.array([merges[k] for k in sorted(merges)], np.int32)
        self.raw = [bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(SPACE, " ").encode() if k == _NORMAL else b"" for p, k in zip(pieces, kinds, strict=True)]
        self.raw[self.unknown] = " ⁇ ".encode()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            raw = f.read()
        pieces, scores, kinds, kind, prefix, squeeze, fallback, chars = [], [], [], _UNIGRAM, True, True, False, b""
        for number, value in _fields(raw):
            if number == 1:
                got = dict(_fields(value))
                pieces.append(got[1].decode())
                scores.append(struct.unpack("<f", got.get(2, bytes(4)))[0])
                kinds.append(got.get(3, _NORMAL))
            elif number == 2:
                got = dict(_fields(value))
                kind, fallback = got.get(3, _UNIGRAM), bool(got.get(35, 0))
            elif number == 3:
                got = dict(_fields(value))
                chars, prefix, squeeze = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1))
        if kind not in (_UNIGRAM, _BPE) or chars or squeeze:
            raise ValueError("only unigram and BPE models without normalisation are supported")
        return cls(pieces, scores, kinds, kind == _BPE, prefix, fallback)


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hash of every row of characters."""
    up = np.full(codes.shape[1], _BASE, np.uint64)
    up[:1] = 1
    return (mix(codes.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(up)).sum(axis=1, dtype=np.uint64)


def _gather(pool: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches pool[at:at + count] behind each other, and where each starts now."""
    count = count.astype(np.int64)
    begin = np.cumsum(count) - count
    return pool[np.repeat(at - begin, count) + np.arange(int(count.sum()))], begin


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known = np.full(PAIRS, -1, np.int64)
        self.stable = np.zeros(PAIRS, bool)
        self.size = len(vocabulary.pieces)
        self.byte_ids = np.array([vocabulary.bytes.get(b, vocabulary.unknown) for b in range(256)])
        # remembered words: keys in order, when last used, and the place and number of their ids in one array
        self.seen, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.seen_at, self.seen_count, self.seen_ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.turn, self.memo = 0, {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair, leftmost first, until none is left."""
        parts, ids, scores = list(text), self.v.id, self.v.scores
        while len(parts) > 1:
            options = [(-scores[ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids]
            if not options:
                break
            _, i = min(options)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _merged(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that a and b side by side merge into, and their scores; -inf: none."""
        keys = self.v.merge_keys
        if not len(keys):
            return np.zeros(a.shape, np.int32), np.full(a.shape, -np.inf)
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = (keys[at] == key) & (a >= 0) & (b >= 0)
        piece = self.v.merge_ids[at]
        return piece, np.where(hit, self.v.scores[piece], -np.inf)

    def _merge_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the characters of left and right ends with just these two pieces (left = -1: right alone).

        All pairs take their best merge, leftmost first, in the same step; a pair
        whose best merge crosses its boundary is out.
        """
        out = np.zeros(len(left), bool)
        wl, wr = np.where(left >= 0, self.v.width[left], 0).astype(np.int64), self.v.width[right].astype(np.int64)
        odd = (wr == 0) | ((left >= 0) & (wl == 0)) | (len(left) < FEW)
        for k in np.flatnonzero(odd).tolist():
            parts = ([self.v.pieces[left[k]]] if left[k] >= 0 else []) + [self.v.pieces[right[k]]]
            out[k] = self.merge("".join(parts)) == parts
        rows = np.flatnonzero(~odd)
        if not len(rows):
            return out
        wl, total = wl[rows], (wl + wr)[rows]
        place = np.arange(int(total.max()))
        m = np.full((len(rows), len(place)), -1, np.int32)
        first, second = place < wl[:, None], (place >= wl[:, None]) & (place < total[:, None])
        cols = np.arange(self.v.longest)
        m[first] = self.v.chars[left[rows]][cols < wl[:, None]]
        m[second] = self.v.chars[right[rows]][cols < (total - wl)[:, None]]
        piece, score = self._merged(m[:, :-1], m[:, 1:])
        bound, count = wl, total  # parts before the boundary, and all
        while len(rows) and m.shape[1] > 1:
            each = np.arange(len(rows))
            best = score.argmax(axis=1)
            value = score[each, best]
            done = value == -np.inf
            out[rows[done]] = (count[done] - bound[done] == 1) & (bound[done] <= 1)
            live = ~done & (best != bound - 1)  # a merge across the boundary ends it
            rows, best, bound, count, m, piece, score = rows[live], best[live], bound[live], count[live], m[live], piece[live], score[live]
            if not len(rows):
                return out
            each, cols = np.arange(len(rows)), np.arange(m.shape[1] - 1)
            m[each, best] = piece[each, best]
            m = np.take_along_axis(m, cols + (cols > best[:, None]), axis=1)
            bound, count = bound - (best < bound - 1), count - 1
            cols = cols[:-1]
            shift = cols + (cols > best[:, None])
            piece, score = np.take_along_axis(piece, shift, axis=1), np.take_along_axis(score, shift, axis=1)
            for at in (best - 1, best):  # both neighbours of the new part
                here = np.flatnonzero((at >= 0) & (at < m.shape[1] - 1))
                piece[here, at[here]], score[here, at[here]] = self._merged(m[here, at[here]], m[here, at[here] + 1])
        out[rows] = (count - bound == 1) & (bound <= 1)
        return out

    def _pairs_stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a and b side by side stay what they are (a = -1: b alone)."""
        key = (a + 1) * self.size + b
        slot = (mix(key.astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
        out = self.stable[slot]
        missing = np.flatnonzero(self.known[slot] != key)
        if len(missing):
            new, back = np.unique(key[missing], return_inverse=True)
            answer = np.concatenate([self._merge_pairs(part // self.size - 1, part % self.size) for part in np.split(new, range(1 << 14, len(new), 1 << 14))])
            out[missing] = answer[back]
            place = (mix(new.astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
            self.known[place] = new
            # two new keys may share a place: only the one that stands there last is remembered
            here = self.known[place] == new
            self.stable[place[here]] = answer[here]
        return out

    def _matches(self, codes: np.ndarray):
        """All pieces in (n, length) words as (row, start, size, piece) in order of their ends, and the first of each end."""
        n, length = codes.shape
        up = np.full(length + 1, _BASE, np.uint64)
        up[:1] = 1
        up = np.multiply.accumulate(up)
        down = np.full(length + 1, pow(int(_BASE), -1, 2**64), np.uint64)
        down[:1] = 1
        down = np.multiply.accumulate(down)
        total = np.zeros((n, length + 1), np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:length], axis=1, out=total[:, 1:])
        found = []
        for size, (keys, ids) in self.v.keys.items():
            if size <= length:
                h = (total[:, size:] - total[:, :-size]) * down[:length - size + 1]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                row, start = np.nonzero(keys[at] == h)
                found.append((row, start, np.full(len(row), size), ids[at[row, start]]))
        row, start, size, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        order = np.argsort(start + size, kind="stable")
        row, start, size, piece = row[order], start[order], size[order], piece[order]
        return row, start, size, piece, np.searchsorted(start + size, np.arange(length + 2))

    def _advance(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length + 1, n): the last piece of the encoding of each word's every prefix, and its size."""
        n, length = codes.shape
        row, start, size, piece, first = self._matches(codes)
        alone = np.ones((n, length), bool)  # characters without a piece of their own
        one = size == 1
        alone[row[one], start[one]] = False
        some = alone.any(axis=0)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        last = np.full((length + 1, n), -1, np.int32)
        step = np.ones((length + 1, n), np.int32)
        worst = float(self.v.scores.min()) - 10
        for end in range(1, length + 1):
            if some[end - 1]:  # a character without piece: always open, at a price in unigram models
                bare = alone[:, end - 1]
                best[end] = np.where(bare, best[end - 1] + (0 if self.v.bpe else worst), -np.inf)
                last[end] = np.where(bare, self.size + codes[:, end - 1].astype(np.int64), -1).astype(np.int32)
            here = slice(first[end], first[end + 1])
            r, at, z, p = row[here], start[here], size[here], piece[here]
            before = best[at, r]
            ok = before > -np.inf
            if not ok.all():
                r, at, z, p, before = r[ok], at[ok], z[ok], p[ok], before[ok]
            if not len(r):
                continue
            if self.v.bpe:
                q = last[at, r]
                # nothing merges with a character without piece: beside it, the piece stands alone
                ok = self._pairs_stable(np.where(q >= self.size, -1, q), p)
                r, z, p = r[ok], z[ok], p[ok]
                best[end, r], last[end, r], step[end, r] = 1.0, p, z
            else:
                value = before + self.v.scores[p]
                order = np.lexsort((-z, value, r))  # the best of each row comes last; of equal ones the shortest
                r, z, p, value = r[order], z[order], p[order], value[order]
                keep = np.append(r[1:] != r[:-1], True)
                keep &= value > best[end, r]
                r = r[keep]
                best[end, r], last[end, r], step[end, r] = value[keep], p[keep], z[keep]
        return last, step

    def words(self, codes: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of (n, length) words behind each other, and how many each has; a character without piece is size + its code.

        ``lengths``: where shorter words are, filled up with characters that are in no piece.
        """
        n, length = codes.shape
        if n == 1 and self.v.bpe and length > 2 * BLOCK:
            ids = self._long(codes[0])
            return ids, np.array([len(ids)])
        last, step = self._advance(codes)
        out = np.full((n, length), -1, np.int32)
        at = np.full(n, length) if lengths is None else lengths.copy()
        column = length - 1
        while (at > 0).any():
            live = at > 0
            row = np.flatnonzero(live)
            out[row, column] = last[at[row], row]
            at[row] -= step[at[row], row]
            column -= 1
        return out[out >= 0], (out >= 0).sum(axis=1)

    def _long(self, codes: np.ndarray) -> np.ndarray:
        """Piece ids of one long word (BPE), its blocks advancing together.

        The last piece of a prefix depends only on those of the prefixes that
        are shorter by up to the longest piece. Every block starts a little
        before its place, as if a word began there; if its last pieces have met
        those of the block before by then, all that follows is right. Otherwise
        the block is followed character by character from the block before.
        """
        n, reach = len(codes), self.v.longest
        last, step = np.full(n + 1, -1, np.int64), np.ones(n + 1, np.int64)
        a, b = self._advance(codes[None, :BLOCK])
        last[:BLOCK + 1], step[:BLOCK + 1] = a[:, 0], b[:, 0]
        starts = np.arange(BLOCK, n, BLOCK)
        for k in range(0, len(starts), 128):
            group = starts[k:k + 128]
            whole = group[group + BLOCK <= n]
            for part in (whole, group[len(whole):]):
                if not len(part):
                    continue
                width = min(BLOCK, n - int(part[-1]))
                a, b = self._advance(codes[part[:, None] + np.arange(-OVERLAP, width)])
                for c, at in enumerate(part.tolist()):
                    if (last[at - reach + 1:at + 1] == a[OVERLAP - reach + 1:OVERLAP + 1, c]).all():
                        last[at + 1:at + width + 1], step[at + 1:at + width + 1] = a[OVERLAP + 1:, c], b[OVERLAP + 1:, c]
                    else:
                        self._follow(codes, last, step, at, at + width)
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at -= step[at]
        return np.array(out[::-1], np.int64)

    def _follow(self, codes: np.ndarray, last: np.ndarray, step: np.ndarray, lo: int, hi: int) -> None:
        """Last pieces and their sizes at the ends lo + 1 .. hi, from those before."""
        from_ = max(0, lo - self.v.longest)
        _, start, size, piece, first = self._matches(codes[None, from_:hi])
        start, size, piece, first = (start + from_).tolist(), size.tolist(), piece.tolist(), first.tolist()
        have = dict(zip(range(from_, lo + 1), last[from_:lo + 1].tolist(), strict=True))
        for end in range(lo + 1, hi + 1):
            here = range(first[end - from_], first[end - from_ + 1])
            have[end] = self.size + int(codes[end - 1])
            step[end] = 1
            for e in here:
                q = have.get(start[e], -1) if start[e] else -1
                key = (-1 if q >= self.size else q, piece[e])
                if key not in self.memo:
                    if len(self.memo) > PAIRS:
                        self.memo.clear()
                    self.memo[key] = bool(self._pairs_stable(np.array([key[0]]), np.array([key[1]]))[0])
                if self.memo[key]:
                    have[end], step[end] = piece[e], size[e]
                    break
            last[end] = have[end]

    def expand(self, ids: np.ndarray) -> np.ndarray:
        """Characters without piece become their UTF-8 bytes' pieces, or unknown."""
        wide = ids >= self.size
        if not wide.any():
            return ids
        ids = ids.astype(np.int64)
        if not self.v.bytes:  # a run of unknown characters is one piece
            first = ~wide
            first[:1] = True
            first[1:] |= ~wide[:-1]
            return np.where(wide, self.v.unknown, ids)[first]
        codes = ids[wide] - self.size
        count = np.ones(len(ids), np.int64)
        count[wide] += (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        out = np.repeat(ids, count)
        raw = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
        out[np.repeat(wide, count)] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        return out

    def _remember(self, keys: np.ndarray, at: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Keep the ids of new words for the next runs; a full memory loses the half not used for longest."""
        keys, at, count = keys[:WORDS // 2], at[:WORDS // 2], count[:WORDS // 2]
        keys = np.concatenate([self.seen, keys])
        used = np.concatenate([self.used, np.full(len(at), self.turn, np.int32)])
        place = np.concatenate([self.seen_at, at + len(self.seen_ids)])
        count = np.concatenate([self.seen_count, count.astype(np.int32)])
        order = np.argsort(keys)
        if len(keys) > WORDS:
            keep = np.zeros(len(keys), bool)
            keep[np.argsort(-used, kind="stable")[:WORDS // 2]] = True
            order = order[keep[order]]
        self.seen, self.used = keys[order], used[order]
        self.seen_ids, self.seen_at = _gather(np.concatenate([self.seen_ids, ids]), place[order], count[order])
        self.seen_count = count[order]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; memory for a run of texts or the longest one."""
        out: list[np.ndarray] = []
        batch: list[str] = []
        size = 0
        for t in texts:
            batch.append(t)
            size += len(t)
            if size >= RUN_CHARS:
                out += self._run(batch)
                batch, size = [], 0
        return out + (self._run(batch) if batch else [])

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        ready = [((SPACE if self.v.prefix else "") + t.replace(" ", SPACE)) if t else "" for t in texts]
        codes = np.frombuffer("".join(ready).encode("utf-32-le"), np.uint32)
        off = np.cumsum([0, *[len(t) for t in ready]])
        if not len(codes):
            return [np.zeros(0, np.int32) for _ in texts]
        first = np.zeros(len(codes), bool)
        first[off[:-1][off[:-1] < len(codes)]] = True
        if not self.v.crosses:
            mark = codes == ord(SPACE)
            first[1:] |= mark[1:] & ~mark[:-1]
        single = ~np.isin(codes, self.v.joins)
        first |= single
        first[1:] |= single[:-1]
        starts = np.flatnonzero(first)
        length = np.diff(np.append(starts, len(codes)))
        doc = np.searchsorted(off, starts, "right") - 1
        up = np.full(int(length.max()), _BASE, np.uint64)
        up[:1] = 1
        h = mix(codes.astype(np.uint64) + np.uint64(1))
        h *= np.multiply.accumulate(up)[np.arange(len(codes)) - np.repeat(starts, length)]
        h = np.add.reduceat(h, starts)
        keys, one, back = np.unique(mix(h + length.astype(np.uint64) * _BASE), return_index=True, return_inverse=True)
        # for every distinct word: how many ids, and where they stand in the pool
        count, at, new = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), np.ones(len(one), bool)
        self.turn += 1
        if len(self.seen):
            there = np.minimum(np.searchsorted(self.seen, keys), len(self.seen) - 1)
            new = self.seen[there] != keys
            self.used[there[~new]] = self.turn
            count[~new], at[~new] = self.seen_count[there[~new]], self.seen_at[there[~new]]
        pool, filled = [self.seen_ids], len(self.seen_ids)
        # words of up to WORD_CHARS by their length; of the few longer ones, those of like length together, filled up
        size = length[one]
        like = np.where(size <= WORD_CHARS, size, (2.0 ** (np.ceil(np.log2(np.maximum(size, 1)) * 4) / 4)).astype(np.int64) + 1)
        like = np.where(size > 2 * BLOCK, size, like)
        for n in np.unique(like[new]):
            rows = np.flatnonzero(new & (like == n))
            step = max(1, (1 << 17) // int(n)) if n <= 2 * BLOCK else 1
            for k in range(0, len(rows), step):
                part = rows[k:k + step]
                begin, own = starts[one[part]], size[part]
                widest = int(own.max())
                grid = codes[np.minimum(begin[:, None] + np.arange(widest), len(codes) - 1)]
                if own.min() < widest:
                    grid = np.where(np.arange(widest) < own[:, None], grid, NO_CHARACTER)
                got, many = self.words(grid, own)
                pool.append(got.astype(np.int32))
                count[part], at[part] = many, filled + np.cumsum(many) - many
                filled += len(got)
        pool = np.concatenate(pool)
        fresh = np.flatnonzero(new & (size <= WORD_CHARS))
        stream, _ = _gather(pool, at[back], count[back])
        ids, place = _gather(pool, at[fresh], count[fresh])
        self._remember(keys[fresh], place, count[fresh], ids)
        cuts = np.cumsum(np.bincount(doc, weights=count[back], minlength=len(texts)).astype(np.int64))[:-1]
        return [self.expand(x) for x in np.split(stream, cuts)]

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join([self.v.raw[i] for i in ids])
        if self.v.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _slices(batches):
    """Batches cut to about RUN_CHARS bytes of text; a longer text is alone."""
    for batch in batches:
        _, off = flat(batch.column("text"))
        for first, last in runs(off, RUN_CHARS):
            yield batch.slice(first, last - first)


def _encode(vocabulary: Vocabulary):
    def run(batches):
        encoder = Encoder(vocabulary)
        for batch in _slices(batches):
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            rest = [c for c in batch.schema.names if c != "text"]
            cuts = pa.array(np.cumsum([0, *[len(x) for x in ids]]), pa.int32())
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.ListArray.from_arrays(cuts, flat)], names=[*rest, "ids"])

    return run


def _decode(vocabulary: Vocabulary):
    def run(batches):
        encoder = Encoder(vocabulary)
        for batch in batches:
            text = [None if x is None else encoder.decode(x) for x in batch.column("ids").to_pylist()]
            rest = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(text, pa.string())], names=[*rest, "text"])

    return run


def _digests(vocabulary: Vocabulary):
    """Encodes, decodes again and keeps only what identifies the ids."""

    def run(batches):
        encoder = Encoder(vocabulary)
        for batch in _slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = encoder.encode(texts)
            rest = [c for c in batch.schema.names if c != "text"]
            columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([len(np.unique(x)) for x in ids], pa.int64()),
                       pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]),
                       pa.array([encoder.decode(x.tolist()) == t.replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *columns], names=[*rest, "n_tokens", "n_distinct", "ids_sha256", "round_trip"])

    return run


def _apply(df: DataFrame, made, added: str, value: str, keep: tuple) -> DataFrame:
    d = pick(df, *keep, value).toDF(*[f"keep_{i}" for i in range(len(keep))], "ids" if value == "ids" else "text")
    fields = ", ".join(f"keep_{i} {d.schema[f'keep_{i}'].dataType.simpleString()}" for i in range(len(keep)))
    out = d.mapInArrow(made, f"{fields}, {added}")
    return out.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], *[c for c in out.columns if not c.startswith("keep_")])


def encode_texts(docs: DataFrame, model: str = MODEL, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ids array<int> of every whole text.

    Null and empty texts have no ids. Repeated rows are rows of their own; an
    empty table gives no rows. The model file is read on the driver only.
    """
    return _apply(docs, _encode(Vocabulary.read(model)), "ids array<int>", text_col, keep)


def decode_ids(encoded: DataFrame, model: str = MODEL, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and text of every row's ids; null ids give a null text."""
    return _apply(encoded, _decode(Vocabulary.read(model)), "text string", "ids", keep)


def token_digests(docs: DataFrame, model: str = MODEL, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, n_distinct, ids_sha256 (of the ids as little-endian int32) and round_trip.

    round_trip: decoding gives the text again, space marks as spaces.
    """
    return _apply(docs, _digests(Vocabulary.read(model)), "n_tokens long, n_distinct long, ids_sha256 string, round_trip boolean", text_col, keep)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents``, encoded and decoded."""
    return token_digests(load(spark, sf_dir, "documents"))
