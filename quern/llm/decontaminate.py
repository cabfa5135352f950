"""Benchmark passages in documents, whole or lightly edited.

An item is found where a stretch of a document is within edit distance max_share * length of it. Texts are
lower-cased and runs of white space made one blank; distances count code points.

1. CGK embedding. A random walk reads a window: at step j it writes the character it stands on, and a random bit of
   (j, character) says whether it moves on. Windows at a small edit distance give strings at a small Hamming
   distance, as the walks fall into step again after an edit.
2. Bit sampling. Each of TABLES keys of a walk hashes SAMPLES random places of its string; WALKS walks with other
   bits repeat it. Documents are read at every STRIDE-th character; items at every one, so that some window of any
   occurrence starts exactly at a window of the item, and an item of n characters has about (n - WINDOW) / STRIDE
   of them in each occurrence, each with WALKS * TABLES chances.
3. Verification. Where a key agrees and the Hamming distance of the two strings leaves LEAST_AGREEMENT of their
   places equal, the item is aligned with the stretch around it by exact bit-parallel edit distance with free ends.

Recall: a key is found if its SAMPLES places agree; with a share h of the places differing in a window, one
occurrence of n characters is missed with probability (1 - (1 - h) ** SAMPLES) ** (WALKS * TABLES * (n - WINDOW) / STRIDE).
Windows overlap, so the chances of one occurrence are not independent and the figures are measured ones. Exact
copies are always found. Target: 98 % of the occurrences edited in 20 % of their characters, the full limit, for
each length from WINDOWED_ITEM on; README gives what was measured.

Items of fewer than WINDOWED_ITEM characters are held against every stretch, so that none within the limit is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, WINDOW, STRIDE = 64, 44, 8
WALKS, TABLES, SAMPLES = 2, 12, 7
#: Of the places of two strings of a walk, the share that must agree before an item is aligned. Strings of
#: unrelated windows agree in a tenth of their places.
LEAST_AGREEMENT = 0.62
#: Items of fewer characters have too few windows and are held against every stretch.
WINDOWED_ITEM = 96
#: Items of fewer characters must occur exactly: none.
SHORT_ITEM = 1
#: Candidates of short items are told by runs of SPAN characters and looked for in pieces of PIECE of them, a whole
#: number of blocks in which grams are counted.
SPAN, PIECE, BLOCK, LANES_A_WORD = 480, 160, 16, 8
GRAMS = (3, 4)
#: Characters of the items that are held against the documents at a time; more items take more passes.
BLOCK_CHARS = 200_000
FILTER_BITS = 21
#: Parts of items that are held against their stretches at a time; of short items, against pieces of text.
LANES, SHORT_LANES = 4_096, 16_384
CHUNK = 1 << 15
SEED = 4_823


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    """A byte for each code point."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return ((c ^ (c >> 8)) & 0xFF).astype(np.uint8)


def edit_distance_within(item: str, text: str) -> tuple[int, int]:
    """(least edit distance of the item to any stretch of text, end of the first such stretch): Myers' bit vectors."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _grams(c: np.ndarray, q: int) -> np.ndarray:
    """A 16-bit hash of the q characters from each place."""
    w, n = c.astype(np.uint16), max(0, len(c) - q + 1)
    out = np.zeros(n, np.uint16)
    for j, f in zip(range(q), (0x9E35, 0x6C8F, 0x3A2D, 0xB4D1)):
        out += w[j : j + n] * np.uint16(f)
    return out


def _rows(string: np.ndarray) -> np.ndarray:
    """Strings (steps by windows) as a row of words for each window, eight places a word."""
    out = np.empty((string.shape[1], STEPS // 8), np.uint64)
    for k in range(STEPS // 8):
        word = string[8 * k].astype(np.uint64)
        for j in range(1, 8):
            word |= string[8 * k + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, k] = word
    return out


def _bit_rows(item: str) -> list[tuple[int, np.ndarray]]:
    """(length, the bit vector of each byte) of an item's parts of at most 64 characters."""
    out = []
    c = codes(item)
    for part in np.array_split(c, -(-len(c) // 64)):
        row = np.zeros(256, np.uint64)
        np.bitwise_or.at(row, part, np.uint64(1) << np.arange(len(part), dtype=np.uint64))
        out.append((len(part), row))
    return out


class Walks:
    """The random bits of the walks and the places that each table samples."""

    def __init__(self):
        g = np.random.Generator(np.random.PCG64(SEED))
        self.move = g.integers(0, 2, (WALKS, STEPS, 256)).astype(np.int64)
        # by two characters, the second in the high byte: how far two steps move, and 8 if the first of them does
        code = np.arange(1 << 16)
        one, two = code & 0xFF, code >> 8
        first = [[self.move[w, j][one] for j in range(0, STEPS, 2)] for w in range(WALKS)]
        self.two_steps = np.array([[m + self.move[w, 2 * j + 1][np.where(m, two, one)] + 8 * m for j, m in enumerate(first[w])] for w in range(WALKS)], np.uint8)
        self.place = np.array([[np.sort(g.choice(STEPS, SAMPLES, replace=False)) for _ in range(TABLES)] for _ in range(WALKS)])
        self.factor = g.integers(1, 1 << 31, (WALKS, TABLES, SAMPLES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def strings(self, text: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """For each walk the strings (steps by windows) of the windows of `text` (padded by STEPS at its end) at starts, in ascending order, and the keys of each table."""
        base, last = (int(starts[0]), int(starts[-1])) if len(starts) else (0, 0)
        piece = text[base : last + STEPS + 1].astype(np.uint16)
        both = piece[:-1] | piece[1:] << np.uint16(8)
        for w in range(WALKS):
            out, product = np.empty((STEPS, len(starts)), np.uint8), np.empty(len(starts), np.uint32)
            at = starts - base
            for j in range(0, STEPS, 2):
                seen = both.take(at, mode="clip")
                moved = self.two_steps[w, j // 2].take(seen, mode="clip")
                out[j] = seen & np.uint16(0xFF)
                out[j + 1] = seen >> (moved & np.uint8(8)) & np.uint16(0xFF)
                at += moved & np.uint8(3)
            keys = []
            for t in range(TABLES):
                key = np.full(len(starts), (w * TABLES + t) * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
                for j, f in zip(self.place[w, t], self.factor[w, t]):
                    key += np.multiply(out[j], f, out=product)
                key ^= key >> np.uint32(13)
                key *= np.uint32(0x5BD1E995)
                keys.append(key ^ (key >> np.uint32(15)))
            yield out, keys


class Short:
    """Items held against every stretch of a text.

    Pieces of text without enough of an item's grams of characters are left out first. An item is cut into parts of at most
    64 characters; if it is within k edits of a stretch, one of its p parts is within k // p. The bit vectors of
    many parts and pieces advance together. Bytes stand for characters, which can only make a distance less.
    """

    def __init__(self, items: list[str], allowed: list[int]):
        self.codes, self.allowed = [codes(t) for t in items], allowed
        parts = [(k, piece, allowed[k] // n) for k, c in enumerate(self.codes) for n in [-(-len(c) // 64)] for piece in np.array_split(c, n)]
        self.owner = np.array([k for k, _, _ in parts], np.int64)
        self.length = np.array([[len(c)] for _, c, _ in parts], np.uint64).reshape(-1, 1)
        self.edits = np.array([[e] for _, _, e in parts], np.int32).reshape(-1, 1)
        self.peq = np.zeros((len(parts), 256), np.uint64)
        for i, (_, c, _) in enumerate(parts):
            for j, x in enumerate(c.tolist()):
                self.peq[i, x] |= np.uint64(1 << j)
        #: A stretch that begins in a run ends within as many characters after it.
        self.longest = max((len(t) + a for t, a in zip(items, allowed)), default=0)
        self.width = SPAN + self.longest

    def shared(self, text: np.ndarray, pieces: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each item with the pieces in which a stretch within its edits may begin.

        An edit changes at most q of an item's n - q + 1 grams of q characters, so a stretch within k edits has at
        least n - q + 1 - q * k places whose gram is one of the item's. They are counted in the blocks that a
        stretch beginning in a block can reach, for LANES_A_WORD items together, a byte of a word for each. Grams
        stand for one another where their hashes are equal, which can only make a count more.
        """
        blocks = pieces * (PIECE // BLOCK)
        grams = [(q, _grams(np.concatenate([text, np.zeros(blocks * BLOCK + q - 1 - len(text), np.uint8)]), q)) for q in GRAMS]
        for i in range(0, len(self.codes), LANES_A_WORD):
            own = self.codes[i : i + LANES_A_WORD]
            passed = np.ones((len(own), blocks), bool)
            for q, gram in grams:
                known = np.zeros((1 << 16, LANES_A_WORD), np.uint8)
                for lane, c in enumerate(own):
                    known[_grams(c, q), lane] = 1
                counts = known.view(np.uint64).ravel().take(gram).reshape(blocks, BLOCK).sum(1).view(np.uint8).reshape(blocks, LANES_A_WORD)
                sums = np.zeros((blocks + 1, LANES_A_WORD), np.int32)
                np.cumsum(counts, 0, dtype=np.int32, out=sums[1:])
                for lane, c in enumerate(own):
                    k = self.allowed[i + lane]
                    least = len(c) - q + 1 - q * k
                    if least > 0:
                        # the first gram stands anywhere in a block, the last at most len(c) + k - q places on
                        reach = (len(c) + k - q + BLOCK - 1) // BLOCK + 1
                        ahead = sums[np.minimum(np.arange(blocks) + reach, blocks), lane] - sums[:-1, lane]
                        passed[lane] &= ahead >= least
            for lane in range(len(own)):
                yield i + lane, np.flatnonzero(passed[lane].reshape(pieces, -1).any(1))

    def candidates(self, text: np.ndarray) -> set[tuple[int, int]]:
        """(item, start of a run) for all runs of width characters that may hold an item."""
        pieces, one, out = -(-len(text) // PIECE), np.uint64(1), set()
        width = PIECE + self.longest
        padded = np.concatenate([text, np.zeros(pieces * PIECE + width - len(text), np.uint8)])
        chars = np.lib.stride_tricks.sliding_window_view(padded, width)[: pieces * PIECE : PIECE]
        flat = self.peq.ravel()
        for part, piece in self._lanes(text, pieces):
            found, place = np.unique(piece, return_inverse=True)
            base, length = part * 256, self.length[part, 0]
            last = length - one
            pv, mv = np.full(len(part), 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(len(part), np.uint64)
            score = length.astype(np.int64)
            best = score.copy()
            for row in np.ascontiguousarray(chars[found].T):
                eq = flat.take(base + row.take(place))
                xv = eq | mv
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                score += (ph >> last & one).view(np.int64)
                score -= (mh >> last & one).view(np.int64)
                np.minimum(best, score, out=best)
                ph <<= one
                mh <<= one
                pv, mv = mh | ~(xv | ph), ph & xv
            near = best <= self.edits[part, 0]
            out.update(zip(self.owner[part[near]].tolist(), (piece[near] * PIECE // SPAN * SPAN).tolist()))
        return out

    def _lanes(self, text: np.ndarray, pieces: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(parts, pieces) to be held against each other, at most SHORT_LANES at a time."""
        parts, places, held = [], [], 0
        for k, piece in self.shared(text, pieces):
            own = np.arange(*np.searchsorted(self.owner, (k, k + 1)))
            for i in range(0, len(piece), SHORT_LANES // len(own)):
                some = piece[i : i + SHORT_LANES // len(own)]
                if held + len(own) * len(some) > SHORT_LANES:
                    yield np.concatenate(parts), np.concatenate(places)
                    parts, places, held = [], [], 0
                parts.append(np.repeat(own, len(some)))
                places.append(np.tile(some, len(own)))
                held += len(own) * len(some)
        if held:
            yield np.concatenate(parts), np.concatenate(places)


class Index:
    """Keys of all windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]], max_share: float):
        self.walks, self.items, self.max_share = Walks(), [], max_share
        self.short: list[tuple[int, str]] = []
        for k, text in items:
            n = normal(text)
            if n:
                (self.items if len(n) >= WINDOWED_ITEM else self.short).append((k, n))
        sizes = [len(n) - WINDOW + 1 for _, n in self.items]
        text = np.concatenate([*(codes(n) for _, n in self.items), np.zeros(STEPS + 1, np.uint8)])
        begin = np.cumsum([0] + [len(n) for _, n in self.items])[:-1]
        self.item = np.repeat(np.arange(len(sizes)), sizes)
        self.shift = np.concatenate([np.arange(s) for s in sizes]) if sizes else np.zeros(0, np.int64)
        starts = begin[self.item] + self.shift if sizes else np.zeros(0, np.int64)
        self.strings, self.tables = [], []
        self.pieces: dict[int, list] = {}
        for string, keys in self.walks.strings(text, starts):
            self.strings.append(_rows(string))
            self.tables.append([])
            for key in keys:
                order = np.argsort(key, kind="stable")
                known = np.zeros(1 << FILTER_BITS, bool)
                known[key >> np.uint32(32 - FILTER_BITS)] = True
                values, first = np.unique(key[order], return_index=True)
                self.tables[-1].append((values, np.append(first, len(key)), order, np.packbits(known, bitorder="little")))
        self.shortest = min([len(n) - int(max_share * len(n)) for _, n in self.items + self.short], default=None)
        allowed = [int(max_share * len(n)) for _, n in self.short]
        #: Places in short of the items that may be edited; the others must occur exactly.
        self.loose = [k for k, a in enumerate(allowed) if a]
        self.near = Short([self.short[k][1] for k in self.loose], [allowed[k] for k in self.loose])

    def candidates(self, text: np.ndarray) -> set[tuple[int, int]]:
        """(item, place where it would start, in steps of 16) for all keys that agree; text is padded by STEPS."""
        out: set[tuple[int, int]] = set()
        if not self.items:
            return out
        one = np.uint8(1)
        for begin in range(0, len(text) - STEPS, STRIDE * CHUNK):
            starts = np.arange(begin, min(len(text) - STEPS, begin + STRIDE * CHUNK), STRIDE)
            for (string, keys), tables, known_strings in zip(self.walks.strings(text, starts), self.tables, self.strings):
                rows = None
                for key, (known, first, order, among) in zip(keys, tables):
                    bit = one << (key >> np.uint32(32 - FILTER_BITS) & np.uint32(7)).astype(np.uint8)
                    hit = np.flatnonzero(among.take(key >> np.uint32(35 - FILTER_BITS)) & bit)
                    lo = np.searchsorted(known, key[hit], "left")
                    met = known.take(lo, mode="clip") == key[hit]
                    hit, lo = hit[met], lo[met]
                    if not len(hit):
                        continue
                    lo, n = first[lo], first[lo + 1] - first[lo]
                    ends = np.cumsum(n)
                    if rows is None:
                        rows = _rows(string)
                    for i in range(0, int(ends[-1]), 1 << 16):  # the pairs (window, item's window) in slices
                        k = np.arange(i, min(int(ends[-1]), i + (1 << 16)))
                        h = np.repeat(np.arange(len(n)), n) if len(k) == ends[-1] else np.searchsorted(ends, k, "right")
                        window = order[lo[h] + k - (ends[h] - n[h])]
                        equal = (rows.take(hit[h], 0).view(np.uint8) == known_strings.take(window, 0).view(np.uint8)).view(np.uint64).sum(1)
                        near = (equal * np.uint64(0x0101010101010101) >> np.uint64(56)) >= LEAST_AGREEMENT * STEPS  # its bytes added up
                        at = starts[hit[h[near]]] - self.shift[window[near]]
                        out.update(zip(self.item[window[near]].tolist(), (at // 16).tolist()))
        return out

    def matches(self, texts: list[str | None]) -> list[dict[int, tuple[int, int]]]:
        """For each text its items, by place in the block: (edits, end in the normalised text)."""
        found: list[dict] = [{} for _ in texts]
        if self.shortest is None:
            return found
        plain = [normal(t) if t else "" for t in texts]
        use = [i for i, p in enumerate(plain) if len(p) >= self.shortest]
        for i in use:
            for k, (_, n) in enumerate(self.short):
                at = plain[i].find(n)
                if at >= 0:
                    found[i][len(self.items) + k] = (0, at + len(n))
        if not use:
            return found
        gap = np.zeros(STEPS + 1, np.uint8)
        joined = np.concatenate([x for i in use for x in (codes(plain[i]), gap)])
        begin = np.cumsum([0] + [len(plain[i]) + len(gap) for i in use])
        for loose, start in sorted(self.near.candidates(joined) if self.loose else ()):
            k = self.loose[loose]
            n = self.short[k][1]
            doc = int(np.searchsorted(begin, start, "right")) - 1
            while doc < len(use) and begin[doc] < start + self.near.width:
                held = found[use[doc]].get(len(self.items) + k)
                if held is None or held[0]:
                    left = max(0, start - int(begin[doc]))
                    stretch = plain[use[doc]][left : max(0, start - int(begin[doc]) + self.near.width)]
                    edits, end = edit_distance_within(n, stretch)
                    if edits <= int(self.max_share * len(n)) and (held is None or (edits, left + end) < held):
                        found[use[doc]][len(self.items) + k] = (edits, left + end)
                doc += 1
        asked = []
        for item, doc, first, last in self._stretches(sorted(self.candidates(joined)), begin, len(joined)):
            n = self.items[item][1]
            allowed = int(self.max_share * len(n))
            slack = allowed + 16
            own, base = plain[use[doc]], int(begin[doc])
            left = max(0, first * 16 - base - slack)
            stretch = own[left : max(0, last * 16 - base + 16 + len(n) + slack)]
            if len(stretch) >= len(n) - allowed:
                asked.append((item, doc, left, stretch))
        least = self._least_edits([(a[0], a[3]) for a in asked])
        for (item, doc, left, stretch), few in zip(asked, least):
            n = self.items[item][1]
            allowed = int(self.max_share * len(n))
            if few > allowed:
                continue
            exact = stretch.find(n)
            edits, end = (0, exact + len(n)) if exact >= 0 else edit_distance_within(n, stretch)
            if edits <= allowed:
                held = found[use[doc]].get(item)
                if held is None or (edits, left + end) < held:
                    found[use[doc]][item] = (edits, left + end)
        return found

    def _stretches(self, places: list[tuple[int, int]], begin: np.ndarray, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(item, document, first place, last place): neighbouring places of an item, aligned together."""
        held = None
        for item, place in places:
            # the document in which most of the stretch lies
            doc = int(np.searchsorted(begin, min(max(place * 16 + len(self.items[item][1]) // 2, 0), end - 1), "right")) - 1
            if held and held[:2] == (item, doc) and place - held[3] <= 2 and place - held[2] <= 8:
                held = (*held[:3], place)
                continue
            if held:
                yield held
            held = (item, doc, place, place)
        if held:
            yield held

    def _least_edits(self, asked: list[tuple[int, str]]) -> np.ndarray:
        """For each (item, stretch) a number that the edit distance can't be less than.

        An item is cut into parts of at most 64 characters, and the distances of the parts to the stretch, each
        with free ends, add up to no more than the item's. Bit vectors of many parts advance together; bytes
        stand for characters, which can only make a distance less.
        """
        out = np.zeros(len(asked), np.int64)
        order = sorted(range(len(asked)), key=lambda k: len(asked[k][1]))
        at, one = 0, np.uint64(1)
        while at < len(order):
            some, peq, place, length, owner = [], [], [], [], []
            first: dict[int, int] = {}
            while at < len(order) and (not some or len(owner) < LANES):
                item = asked[order[at]][0]
                if item not in self.pieces:
                    self.pieces[item] = _bit_rows(self.items[item][1])
                if item not in first:
                    first[item] = len(peq)
                    peq += [row for _, row in self.pieces[item]]
                for k, (n, _) in enumerate(self.pieces[item], first[item]):
                    place.append(k)
                    length.append(n)
                    owner.append(len(some))
                some.append(order[at])
                at += 1
            texts = [codes(asked[k][1]) for k in some]
            chars = np.zeros((max(map(len, texts)), len(texts)), np.uint8)
            for i, t in enumerate(texts):
                chars[: len(t), i] = t
            flat, base, lane = np.concatenate(peq), np.array(place) * 256, np.array(owner)
            last = np.array(length, np.uint64) - one
            pv, mv = np.full(len(lane), 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(len(lane), np.uint64)
            score = np.array(length, np.int64)
            best = score.copy()
            for row in chars:
                eq = flat.take(base + row.take(lane))
                xv = eq | mv
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                score += (ph >> last & one).view(np.int64)
                score -= (mh >> last & one).view(np.int64)
                np.minimum(best, score, out=best)
                ph <<= one
                mh <<= one
                pv, mv = mh | ~(xv | ph), ph & xv
            out[some] = np.bincount(lane, best, len(some)).astype(np.int64)
        return out

    def item_id(self, k: int) -> int:
        return self.items[k][0] if k < len(self.items) else self.short[k - len(self.items)][0]


_KEPT: dict = {}


def _index(items: tuple, max_share: float) -> Index:
    key = hash((items, max_share))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Index(list(items), max_share)
    return _KEPT[key]


def item_blocks(items: DataFrame, item_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[tuple]:
    """The items in blocks of at most block_chars characters (or one item), read one after the other."""
    block: list[tuple] = []
    size = 0
    for r in items.select(F.col(item_col).alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null").orderBy("k", "t").toLocalIterator():
        if block and size + len(r.t) > block_chars:
            yield tuple(block)
            block, size = [], 0
        block.append((r.k, r.t))
        size += len(r.t)
    if block:
        yield tuple(block)


def find_leaks(docs: DataFrame, items: DataFrame, max_share: float = 0.2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item_id, edits, end): items that occur in documents within an edit distance of max_share * their length.

    edits is the least distance found, end the place in the normalised text where that stretch ends. Whole texts
    are searched, map-side, without a shuffle; items go to the workers in blocks of BLOCK_CHARS characters, one
    pass over the documents for each block. Items of fewer than WINDOWED_ITEM characters are held against every stretch. Null and
    empty texts, of documents or items, match nothing; repeated rows are reported each; equal items each; an
    empty table gives no rows; other columns are not read.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, edits int, end long"
    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
    out = None
    for block in item_blocks(items, item_col):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _index(block, max_share)
            for b in batches:
                for part in _by_size(b):
                    ids, found = part.column(0), index.matches(part.column(1).to_pylist())
                    rows = [(i, index.item_id(k), *f) for i, own in enumerate(found) for k, f in sorted(own.items())]
                    if rows:
                        at, item, edits, end = zip(*rows)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(item, item_type), pa.array(edits, pa.int32()), pa.array(end, pa.int64())], names=["id", "item", "edits", "end"])

        one = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
        out = one if out is None else out.union(one)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def _by_size(b: pa.RecordBatch, at: int = 1, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about a MB of text."""
    from quern.llm.token_counts import byte_batches

    sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(at)), 0).to_pylist()
    for i, j in byte_batches([s + 1 for s in sizes], limit):
        yield b.slice(i, j - i)


def without_leaks(docs: DataFrame, items: DataFrame, max_share: float = 0.2, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs, all columns as they are, in which find_leaks finds no item."""
    out = docs
    for block in item_blocks(items, item_col):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _index(block, max_share)
            for b in batches:
                at = b.schema.get_field_index(text_col)
                for part in _by_size(b, at):
                    yield part.filter(pa.array([not f for f in index.matches(part.column(at).to_pylist())], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


import pyarrow.compute  # noqa: E402, F401
