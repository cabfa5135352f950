"""Exact, fast encoding of whole texts with public tokenizers.

Texts are cut at safe boundaries, places no token of the tokenizer can span, and the tokens of each
unit between them are remembered. Units repeat, so most of a text costs one dictionary look-up a word;
the library itself encodes each unit that is new. The memory is bounded: it is emptied when full, and that of a
BpeEncoder at the end of each task (`borrowed`), so that idle Python workers hold none while other stages run.

Safe boundaries:
* byte-level BPE with the usual pattern: before a single blank between two characters that are not white
  space. The pattern's letter, number and symbol runs take at most one leading blank and none inside.
* pieces with U+2581 for blanks: the same place, if no piece of the vocabulary has U+2581 after another
  character, the normaliser is the identity and a dummy prefix is added (all checked on loading).
"""

from __future__ import annotations

import os
from codecs import charmap_decode
from collections.abc import Iterator
from contextlib import contextmanager

#: The most entries of an encoder's memory, all of its dictionaries together: some 200 MB.
MEMO_UNITS = 1_200_000
MEMO_CHARS = 48
_SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LOADED: dict = {}


def byte_alphabet() -> list[str]:
    """The visible character of each byte in byte-level BPE: itself if printable, else the next from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = [], 0
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class BpeEncoder:
    """Ids of a byte-level BPE .json tokenizer as little-endian unsigned 16-bit bytes (vocabularies up to 65,536)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        if self.full.get_vocab_size(True) > 65_536:
            raise ValueError("ids need more than 16 bits")
        self.bpe = self.full.model
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.alphabet = "".join(byte_alphabet())
        self.packed = [i.to_bytes(2, "little") for i in range(65_536)]
        self.units: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.newline = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _unit(self, memo: dict, blank: str, word: str) -> bytes:
        core = word if word.isalpha() else word.rstrip(_SYMBOLS)
        if core.isalpha() and (core.isascii() or max(core) < "ɐ"):
            if core is not word:
                rest = word[len(core):]
                return (memo.get(core) or self._remembered(memo, blank, core)) + (self.first.get(rest) or self._remembered(self.first, "", rest))
            # one match of the tokenizer's pattern
            packed = self.packed
            return b"".join([packed[t.id] for t in self.bpe.tokenize(charmap_decode((blank + word).encode(), "strict", self.alphabet)[0])])
        if "\n" in word:
            lines = word.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                # a lone newline between two characters that are not white space is a match of its own
                out = [memo.get(lines[0]) or self._remembered(memo, blank, lines[0])]
                for x in lines[1:]:
                    out += (self.newline, self.first.get(x) or self._remembered(self.first, "", x))
                return b"".join(out)
        return self._whole(blank + word)

    def _remembered(self, memo: dict, blank: str, word: str) -> bytes:
        got = self._unit(memo, blank, word)
        if len(word) <= MEMO_CHARS and "\n" not in word:
            if len(self.units) + len(self.first) >= MEMO_UNITS:
                self.forget()
            memo[word] = got
        return got

    def forget(self) -> None:
        self.units.clear()
        self.first.clear()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._whole(text)
        words = text.split(" ")
        out = list(map(self.units.get, words))
        out[0] = self.first.get(words[0])
        memo, packed, tokens, blank = self.units, self.packed, self.bpe.tokenize, self.alphabet[32]
        i = -1
        for _ in range(out.count(None)):  # units that are new, or that are never remembered
            i = out.index(None, i + 1)
            w = words[i]
            got = memo.get(w) if i else None
            if got is None:
                if i and w.isalpha() and w.isascii():  # the usual word: one match, and no byte but the blank is shown as another
                    got = b"".join([packed[t.id] for t in tokens(blank + w)])
                    if len(w) <= MEMO_CHARS:
                        if len(memo) + len(self.first) >= MEMO_UNITS:
                            self.forget()
                        memo[w] = got
                elif not w or w[0].isspace() or w[-1].isspace():
                    return self._merged(words)
                else:
                    got = self._remembered(memo, " ", w) if i else self._remembered(self.first, "", w)
            out[i] = got
        return b"".join(out)

    def _merged(self, words: list[str]) -> bytes:
        """The same where some blanks are no safe boundary: words around such blanks stay together."""
        out, held, blank = [], [words[0]], ""
        for w in [*words[1:], None]:
            last = held[-1]
            if w is not None and (not w or not last or w[0].isspace() or last[-1].isspace()):
                held.append(w)
                continue
            if len(held) > 1:
                out.append(self._whole(blank + " ".join(held)))
            elif last:
                memo = self.units if blank else self.first
                if last[0].isspace() or last[-1].isspace():
                    out.append(self._whole(blank + last))
                else:
                    out.append(memo.get(last) or self._remembered(memo, blank, last))
            held, blank = [w], " "
        return b"".join(out)

    def counts(self, texts: list) -> list[int]:
        return [len(self.encode(t)) // 2 for t in texts]


class PieceCounter:
    """Token counts of a sentencepiece .model, without begin and end tokens."""

    BATCH_BYTES = 1 << 20

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        n, bar = proto.normalizer_spec, "▁"
        inner = any(bar in p.piece.lstrip(bar) for p in proto.pieces)
        defined = any(p.type == 4 for p in proto.pieces)
        self.safe = n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not inner and not defined and not proto.trainer_spec.treat_whitespace_as_suffix
        self.memo: dict[str, int] = {}

    def _units(self, text: str) -> list[str]:
        """Words; further blanks before a word stay with it, those at the end of the text with the last word."""
        words = text.split(" ")
        if "" not in words:
            return words
        out, lead = [], 0
        for w in words:
            if w:
                out.append(" " * lead + w)
                lead = 0
            else:
                lead += 1
        if lead:
            return [*out[:-1], out[-1] + " " * lead] if out else [text]
        return out

    def counts(self, texts: list) -> list[int]:
        """Counts of whole texts. New units are encoded in batches of about BATCH_BYTES."""
        n = [0] * len(texts)
        units: list[list[str] | None] = [None] * len(texts)
        memo, new, held = self.memo, {}, []

        def settle() -> None:
            if new:
                found = list(new)
                for w, ids in zip(found, self.model.encode(found, num_threads=1)):
                    new[w] = len(ids)
            for i in held:
                n[i] = sum([new[u] if u in new else memo[u] for u in units[i]])
                units[i] = None
            if len(memo) + len(new) > MEMO_UNITS:
                memo.clear()
            memo.update((w, k) for w, k in new.items() if len(w) <= MEMO_CHARS)
            new.clear()
            held.clear()

        size = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.safe or "▁" in t:
                n[i] = len(self.model.encode(t, num_threads=1))
                continue
            own = self._units(t)
            known = list(map(memo.get, own))
            if None not in known:
                n[i] = sum(known)
                continue
            for u, k in zip(own, known):
                if k is None and u not in new:
                    new[u] = 0
                    size += len(u)
            units[i] = own
            held.append(i)
            if size >= self.BATCH_BYTES:
                settle()
                size = 0
        settle()
        return n


def loaded(path: str):
    """The encoder of a tokenizer file, kept for the life of the Python worker."""
    if path not in _LOADED:
        _LOADED[path] = BpeEncoder(path) if path.endswith(".json") else PieceCounter(path)
    return _LOADED[path]


@contextmanager
def borrowed(path: str) -> Iterator[BpeEncoder]:
    """The encoder of a .json file for one task: what it remembers is given back to the system when the task ends."""
    import ctypes

    import pyarrow as pa

    encoder = loaded(path)
    try:
        yield encoder
    finally:
        encoder.forget()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed blocks unless told
        if trim:
            trim(0)
