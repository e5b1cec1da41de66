"""Token ids of whole texts, by a tokenizers file.

A byte-level pre-tokenizer never joins text across a lone space or newline
between two other characters, so a text is cut there and each distinct piece is
encoded once per worker; texts are cut, and their ids put together, many at once.
Pieces are kept up to CACHE_PIECES; texts with any other white space are encoded
whole. Either way the ids are those of one encode call.
"""

from __future__ import annotations

import re
import string
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept by a worker in each of two generations, about 200 bytes each.
CACHE_PIECES = 320_000
#: Texts that callers pass at once, at most.
TEXTS = 2048
#: Texts whose ids are put together at once.
GATHERED = 128
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
SPACED = ("  ", " \n", "\n ", "\n\n")
#: A run of these after a word of letters is a token run of its own.
PUNCTUATION = string.punctuation
_LOADED: dict[str, Encoder] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file is on this machine; asked anew on each worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuttable(text: str, special: list[str]) -> bool:
    return not (not text or text[0] in " \n" or text[-1] in " \n" or any(s in text for s in SPACED) or any(s in text for s in special) or OTHER_SPACE.search(text))


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, those of one plain encode call: the string of a special token is that token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        #: By id, whether its token begins with a space or a newline, in the byte-level alphabet.
        self.begins = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t[:1] in "ĠĊ" or i == newline]] = True
        self.inner: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    @classmethod
    def of(cls, name: str) -> Encoder:
        """The worker's own encoder of a vocabulary file, by name or path."""
        if name not in _LOADED:
            _LOADED[name] = cls(name if "/" in name else vocabulary(name))
        return _LOADED[name]

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in found]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that each begin with the one space or newline they have. They are encoded in a row and cut apart where a token begins so."""
        out: list[bytes] = []
        for i in range(0, len(pieces), 4096):
            some = pieces[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            raw, begins = ids.tobytes(), (np.flatnonzero(self.begins[ids]) * 4).tolist()
            if len(begins) != len(some):
                return self._encode(pieces)
            out += [raw[a:b] for a, b in zip(begins, [*begins[1:], len(raw)], strict=True)]
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Make inner hold all pieces: from the older generation, from a known word and its closing punctuation, or encoded anew."""
        if len(self.inner) > CACHE_PIECES:
            self.older, self.inner, self.tails = self.inner, {}, {}
        known, older, tails = self.inner, self.older, self.tails
        cut, words, lines, ends = [], {}, [], set()
        for p in pieces:
            if p in known:
                continue
            if (ids := older.get(p)) is not None:
                known[p] = ids
            elif p.isalpha():
                words[p] = None
            elif p[:1] == "\n":
                lines.append(p)
            else:
                word = p.rstrip(PUNCTUATION)
                if len(word) < len(p) and word.isalpha():
                    cut.append((p, word, p[len(word) :]))
                    words[word] = None
                    ends.add(p[len(word) :])
                else:
                    words[p] = None
        words = [w for w in words if w not in known]
        known.update(zip(words + lines, self._pieces([" " + w for w in words] + lines), strict=True))
        ends = [e for e in ends if e not in tails]
        tails.update(zip(ends, self._encode(ends), strict=True))
        known.update((p, known[w] + tails[e]) for p, w, e in cut)

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be cut. The first piece of each is taken as a line, whose newline is then left out."""
        pieces = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        coded, bounds = pieces.flatten().dictionary_encode(), pieces.offsets.to_numpy()
        del pieces
        distinct = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False)
        del coded
        pa.default_memory_pool().release_unused()
        self._learn(distinct)
        found = list(map(self.inner.__getitem__, distinct))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, pool = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(found), "<u4")
        del distinct, found
        out: list[bytes] = []
        for i in range(0, len(texts), GATHERED):
            own = bounds[i : i + GATHERED + 1]
            some, firsts = code[own[0] : own[-1]], own[:-1] - own[0]
            at, n = starts[some], lengths[some]
            at[firsts] += 1
            n[firsts] -= 1
            ends = np.cumsum(n)
            raw = pool[np.repeat(at - ends + n, n) + np.arange(ends[-1])].tobytes()
            stops = (ends[own[1:] - own[0] - 1] * 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *stops], stops)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """NULL counts as empty."""
        texts = [t or "" for t in texts]
        out: list[bytes | None] = [None] * len(texts)
        whole, cut = [], []
        for i, t in enumerate(texts):
            (cut if _cuttable(t, self.special) else whole).append(i)
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        if cut:
            for i, ids in zip(cut, self._cut([texts[i] for i in cut]), strict=True):
                out[i] = ids
        return out
