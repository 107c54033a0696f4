"""Byte-pair encoding of whole texts with the tokenizers library, one cached piece at a time."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import runs_of

#: The Unicode White_Space characters; the tokenizer never joins what stands on both sides of such a boundary.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin letters: a run of them, with its leading space, is one token group wherever no letter follows; white space and ASCII signs and digits are none.
LATIN, SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "!-@\\[-`{-~"
PIECE = re.compile(f" ?[{LATIN}]++(?=[{WHITE}{SIGNS}]|\\Z)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
WORD = re.compile(f" ?[{LATIN}]+")
#: One bit for each kind of character; END stands behind each text.
LETTER, SIGN, OTHER, BLANK, SPACE, END = 1, 2, 4, 8, 16, 32
#: The kind of each code point up to the last white one; all beyond are OTHER. A byte that is no character of its own is OTHER at first.
KIND = np.full(0x3002, OTHER, dtype=np.uint8)
for _chars, _kind in ((LATIN, LETTER), (SIGNS, SIGN), (WHITE, BLANK), (" ", SPACE)):
    KIND[[m.start() for m in re.finditer(f"[{_chars}]", "".join(map(chr, range(0x3002))))]] = _kind
BYTES = KIND[:128].tobytes() + bytes([OTHER] * 128)
#: The character that stands for each byte in a byte-level vocabulary: itself where printable, else the next from U+0100 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = np.zeros(256, dtype="<u2")
ALPHABET[_SEEN] = _SEEN
ALPHABET[ALPHABET == 0] = 0x100 + np.arange(256 - len(_SEEN))


def kinds(data: bytes) -> np.ndarray:
    """The kind of the character that each byte of UTF-8 text belongs to. The text ends with an ASCII character."""
    raw, kind = np.frombuffer(data, np.uint8), np.frombuffer(bytearray(data.translate(BYTES)), np.uint8)
    if not data.isascii():
        lead = np.flatnonzero((raw >= 0xC2) & (raw < 0xF0))
        a, b, c = (raw[lead + i].astype(np.int32) for i in range(3))
        three = a >= 0xE0
        own = KIND.take(np.where(three, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 31) << 6 | b & 63), mode="clip")
        kind[lead] = kind[lead + 1] = own
        kind[lead[three] + 2] = own[three]
    return kind


def cut(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts in UTF-8 with a line end behind each, the bytes where pieces begin, and which piece is the line end behind each text.

    Pieces are those that PIECE finds in each text, told for all bytes at once.
    """
    parts = [t.encode() for t in texts]
    data = b"\n".join([*parts, b""])
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    kind = kinds(data)
    kind[ends] = END
    before = np.concatenate((np.array([END], np.uint8), kind[:-1]))
    word, white = (kind & (LETTER | SIGN | OTHER)) != 0, (kind & (BLANK | SPACE)) != 0
    first = ((kind | before) & END) != 0
    first |= white & ((before & (BLANK | SPACE)) == 0)
    last = white[:-1] & word[1:]  # the last byte of white space before a word
    first[:-1] |= last & (kind[:-1] == SPACE)
    at = np.flatnonzero(last & (kind[:-1] == BLANK))
    raw = np.frombuffer(data, np.uint8)
    for _ in range(2):  # to the first byte of that character
        at = at - ((raw[at] & 0xC0) == 0x80)
    first[at] = True
    first |= word & (before == BLANK)  # only a space leads a word
    at = np.flatnonzero((kind == SIGN) & (before == LETTER))
    rest = np.flatnonzero(kind != LETTER)  # the letters before a sign begin behind one of these; before the first stands none, and the last is an END
    first[at[(kind[rest[np.searchsorted(rest, at) - 1]] & (BLANK | SPACE | END)) != 0]] = True
    starts = np.flatnonzero(first)
    return data, starts, np.searchsorted(starts, ends)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    A text is cut only where the tokenizer's own pre-tokenizer always cuts: before a word with its leading space, after
    letters that a sign or digit follows, and around runs of white space. The distinct pieces of a run of texts are looked up once. Each distinct piece is
    encoded once by the library, a word of letters by its model alone, and kept in two generations of
    bounded size; texts that hold an added token's string go to the library whole. The ids equal those of encoding the text.
    """

    def __init__(self, path: str, limit: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit, self.cache, self.old = limit, {}, {}
        cuts, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        # Such a tokenizer hands a word of letters to its model whole, in byte-level characters.
        self.plain = self.tokenizer.normalizer is None and isinstance(self.model, models.BPE) and isinstance(cuts, pre_tokenizers.ByteLevel) and cuts.use_regex and not cuts.add_prefix_space

    def _encode(self, texts: list[str]) -> list[bytes]:
        return _packed([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _words(self, words: list[bytes]) -> list[bytes]:
        text = ALPHABET[np.frombuffer(b"\n".join(words), np.uint8)].tobytes().decode("utf-16-le")
        tokenize = self.model.tokenize
        return _packed([[t.id for t in tokenize(w)] for w in text.split(chr(ALPHABET[ord("\n")]))])

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct pieces; those not known yet are learned."""
        cache, old = self.cache, self.old
        out = list(map(cache.get, pieces))
        words, rest = [], []
        new = [(i, p) for i, (p, x) in enumerate(zip(pieces, out, strict=True)) if x is None]
        for _, p in new:
            if p in old:
                cache[p] = old[p]
            elif self.plain and (p.removeprefix(b" ").isalpha() or WORD.fullmatch(p.decode())):
                words.append(p)
            else:
                rest.append(p)
        for i in range(0, len(words), 4096):
            cache.update(zip(words[i : i + 4096], self._words(words[i : i + 4096]), strict=True))
        for i in range(0, len(rest), 4096):
            cache.update(zip(rest[i : i + 4096], self._encode([p.decode() for p in rest[i : i + 4096]]), strict=True))
        for i, p in new:
            out[i] = cache[p]
        return out

    def _run(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.limit:
            self.old, self.cache = self.cache, {}
        data, starts, stops, size, many = [], [], [], 0, 0
        for a, b in runs_of([len(t) for t in texts]):  # what cutting holds is several times the text
            part, firsts, ends = cut(texts[a:b])
            data.append(part)
            starts.append(firsts + size)
            stops.append(ends + many)
            size, many = size + len(part), many + len(firsts)
        stops = np.concatenate(stops)
        coded = _binary(np.concatenate([*starts, [size]]), b"".join(data)).dictionary_encode()
        del data, starts
        _, ends, flat = coded.dictionary.buffers()
        ends, flat = np.frombuffer(ends, "<i8", len(coded.dictionary) + 1).tolist(), flat.to_pybytes()
        values = self._known([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        ids = _binary(np.cumsum([0, *map(len, values)]), b"".join(values)).take(coded.indices)
        del values, coded
        _, ends, flat = ids.buffers()
        ends, flat = np.frombuffer(ends, "<i8"), memoryview(flat)
        return [flat[a:b].tobytes() for a, b in zip(ends[np.append(0, stops[:-1] + 1)].tolist(), ends[stops].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, own = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if text and any(a in text for a in self.added):
                out[i] = self._encode([text])[0]
            elif text:
                own.append(i)
        for a, b in runs_of([len(texts[i]) for i in own], 1 << 22):
            for i, ids in zip(own[a:b], self._run([texts[i] for i in own[a:b]]), strict=True):
                out[i] = ids
        return out


def _binary(ends: np.ndarray, data: bytes) -> pa.LargeBinaryArray:
    """The slices of data between each two neighbours of ends."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i8", copy=False)), pa.py_buffer(data)])


def _packed(ids: list[list[int]]) -> list[bytes]:
    """Each list as little-endian unsigned 32-bit ids."""
    flat, out, at = np.fromiter(chain.from_iterable(ids), dtype="<u4").tobytes(), [], 0
    for x in ids:
        out.append(flat[at : at + 4 * len(x)])
        at += 4 * len(x)
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, so that its cache serves all tasks of that worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
