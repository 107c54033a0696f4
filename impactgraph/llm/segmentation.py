"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

A text is a lattice of pieces between its characters. Forward Viterbi scores are exact heuristics for a backward A-star search, which then yields
paths in order of their score without detours. No piece spans a word boundary, so a text's lattice is a chain of its words' lattices. Each distinct
word's best path and its loss to the second best are kept; only the N - 1 words of least loss can change in the text's N best, and only those are searched further.
A long word without a boundary is cut where no piece goes across; a run of one repeated letter has no such place, and its lattice is held whole.

The model file that is at hand was made for merges, so its scores are ranks of merges. They are used here as unigram scores: results are the N best paths by these scores, and
not the merges that the library makes of such a model.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import documents, small_batches

SPACE, ESCAPED = "▁", "\ud800"
LETTERS, SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ".,;:!?|"
LONG = 1 << 13  # characters of a word from which its lattice is cut
OUT = ("n_pieces", "score", "n_found", "next_score", "ids_crc32", "nbest_crc32", "round_trip")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Segmenter:
    """Pieces and scores of a model file; scores are the model's own, higher is better.

    A space is the piece sign, with one put before the text. A character no single piece covers becomes the pieces of its UTF-8 bytes, at 10 below the
    least score of an ordinary piece; a piece sign in the text itself takes that way too, so decoding gives back every text.
    """

    def __init__(self, path: str, nbest: int = 4, limit: int = 600_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in range(size) if not special[i] and not model.is_byte(i)}
        self.text = {i: p for p, (i, _) in self.pieces.items()}
        self.table = {p[:n]: (-1, 0.0, True) for p in self.pieces for n in range(1, len(p))}  # prefixes: (id, score, goes on)
        for piece, (i, score) in self.pieces.items():
            self.table[piece] = (i, score, piece in self.table)
        signs = "".join(c for c in SIGNS if not any(re.search(f"[{LETTERS}]{re.escape(c)}", q) for q in self.pieces))
        cut = f"{SPACE}?[{LETTERS}]++(?=[{SPACE}{signs}]|\\Z)|" if not any(SPACE in q.lstrip(SPACE) for q in self.pieces) else ""
        self.words = re.compile(f"{cut}{SPACE}*[^{SPACE}]+|{SPACE}+") if cut else re.compile("(?s).+")
        self.fallback = min(s for _, s in self.pieces.values() if s > -1e8) - 10
        self.raw = {i: p.replace(SPACE, " ").encode() for i, p in self.text.items()} | {i: bytes((b,)) for b, i in self.bytes.items()}
        self.nbest, self.limit, self.cache, self.old, self.more = nbest, limit, {}, {}, {}

    def lattice(self, word: str) -> tuple[list[float], list[tuple[int, int, float, int | str]], list[int]]:
        """Forward Viterbi scores by place, the pieces as (start, end, score, id or uncovered character), and the last piece of the best path to each place."""
        n, get, edges = len(word), self.table.get, []
        best, back = [float("-inf")] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, j, covered = best[i], i, False
            while j < n:
                j += 1
                found = get(word[i:j])
                if found is None:
                    break
                piece, score, more = found
                if piece >= 0:
                    covered |= j == i + 1
                    if here + score > best[j]:
                        best[j], back[j] = here + score, len(edges)
                    edges.append((i, j, score, piece))
                if not more:
                    break
            if not covered:
                if here + self.fallback > best[i + 1]:
                    best[i + 1], back[i + 1] = here + self.fallback, len(edges)
                edges.append((i, i + 1, self.fallback, word[i]))
        return best, edges, back

    def cut(self, word: str) -> list[str]:
        """A long word cut where no piece goes across, which all paths pass; so its lattice is held part by part."""
        out, start, reach, get = [], 0, 0, self.table.get
        for i in range(len(word)):
            if reach <= i and i - start >= LONG // 4:
                out.append(word[start:i])
                start = i
            reach, j = max(reach, i + 1), i
            while j < len(word):
                j += 1
                found = get(word[i:j])
                if found is None:
                    break
                if found[0] >= 0:
                    reach = max(reach, j)
                if not found[2]:
                    break
        return [*out, word[start:]]

    def _ids(self, pieces: list[int | str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            if isinstance(p, str):
                out += [self.bytes[b] for b in (SPACE if p == ESCAPED else p).encode()]
            else:
                out.append(p)
        return struct.pack(f"<{len(out)}I", *out)

    def first(self, word: str) -> tuple[float, bytes, float]:
        """Score and ids of the best path, and the loss to the second best (infinite if there is none)."""
        best, edges, back = self.lattice(word)
        at, path = len(word), []
        while at:
            path.append(back[at])
            at = edges[back[at]][0]
        if len(edges) == len(path):
            return best[-1], self._ids([edges[e][3] for e in reversed(path)]), float("inf")
        own, second = set(path), float("-inf")
        behind = [float("-inf")] * len(word) + [0.0]
        for e in range(len(edges) - 1, -1, -1):
            i, j, score, _ = edges[e]
            through = behind[j] + score
            if through > behind[i]:
                behind[i] = through
            if e not in own and best[i] + through > second:
                second = best[i] + through
        return best[-1], self._ids([edges[e][3] for e in reversed(path)]), best[-1] - second

    def search(self, word: str, count: int) -> list[tuple[float, bytes]]:
        """The count best paths as (score, little-endian unsigned 32-bit ids), best first, by backward A-star."""
        best, edges, _ = self.lattice(word)
        ends: list[list] = [[] for _ in range(len(word) + 1)]
        for i, j, score, piece in edges:
            ends[j].append((i, score, piece))
        heap, made, out = [(-best[-1], 0, len(word), 0.0, None)], 0, []
        while heap and len(out) < count:
            _, _, at, behind, tail = heapq.heappop(heap)
            if at == 0:
                pieces = []
                while tail:
                    pieces.append(tail[0])
                    tail = tail[1]
                out.append((behind, self._ids(pieces)))
                continue
            for start, score, piece in ends[at]:
                made += 1
                heapq.heappush(heap, (-(best[start] + score + behind), made, start, score + behind, (piece, tail)))
        return out

    def _word(self, word: str):
        found = self.old.get(word) or self.first(word)
        if len(self.cache) >= self.limit:
            self.old, self.cache = self.cache, {}
        if len(word) <= 64:
            self.cache[word] = found
        return found

    def _others(self, word: str, best: bytes) -> list[tuple[float, bytes]]:
        """The word's further paths as (loss, ids)."""
        found = self.more.get(word)
        if found is None:
            paths = self.search(word, self.nbest)
            found = [(paths[0][0] - s, ids) for s, ids in paths if ids != best][: self.nbest - 1]
            if len(self.more) >= 20_000:
                self.more.clear()
            self.more[word] = found
        return found

    def encode(self, text: str | None) -> list[tuple[float, bytes]]:
        """The text's nbest segmentations as (score, ids), best first; an empty or null text has one, without pieces."""
        if not text:
            return [(0.0, b"")]
        cache, own = self.cache, self._word
        words = self.words.findall(SPACE + text.replace(SPACE, ESCAPED).replace(" ", SPACE))
        if max(map(len, words)) > LONG:
            words = [part for w in words for part in (self.cut(w) if len(w) > LONG else (w,))]
        found = [cache.get(w) or own(w) for w in words]
        base, ids = sum(f[0] for f in found), [f[1] for f in found]
        out = [(base, b"".join(ids))]
        losses = [f[2] for f in found]
        changes = [i for i in heapq.nsmallest(self.nbest - 1, range(len(found)), key=losses.__getitem__) if losses[i] < float("inf")]
        others = {i: self._others(words[i], ids[i]) for i in changes}
        heap, seen = [], {(0,) * len(changes)}

        def push(state):
            if state not in seen:
                seen.add(state)
                heapq.heappush(heap, (sum(others[i][r - 1][0] for i, r in zip(changes, state, strict=True) if r), state))

        def grow(state):
            for j, i in enumerate(changes):
                if state[j] < len(others[i]):
                    push((*state[:j], state[j] + 1, *state[j + 1 :]))

        grow((0,) * len(changes))
        while heap and len(out) < self.nbest:
            loss, state = heapq.heappop(heap)
            own_ids = list(ids)
            for i, r in zip(changes, state, strict=True):
                if r:
                    own_ids[i] = others[i][r - 1][1]
            out.append((base - loss, b"".join(own_ids)))
            grow(state)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: byte pieces become their bytes, piece signs spaces, and the first space goes."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode().removeprefix(" ")


_SEGMENTERS: dict = {}


def segmenter(path: str, nbest: int) -> Segmenter:
    if (path, nbest) not in _SEGMENTERS:
        _SEGMENTERS[path, nbest] = Segmenter(path, nbest)
    return _SEGMENTERS[path, nbest]


def segment(docs: DataFrame, path: str | None = None, nbest: int = 4, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """docs with its N best segmentations: n_pieces, score and ids_crc32 of the best, n_found, next_score (null if there is one only), nbest_crc32 (of all ids in
    order), round_trip (the best decodes to the text), and, with_ids, nbest array<struct<score, ids>>.

    Null and empty texts have one segmentation without pieces. Whole texts are segmented. Input columns that bear an output's name are replaced;
    repeated rows get equal results; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*OUT, *["nbest"] * with_ids)
    path = path or default_path()
    fields = [T.StructField(n, t) for n, t in zip(OUT, (T.LongType(), T.DoubleType(), T.IntegerType(), T.DoubleType(), T.LongType(), T.LongType(), T.BooleanType()), strict=True)]
    if with_ids:
        fields.append(T.StructField("nbest", T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("ids", T.BinaryType())]))))

    def run(batches):
        own = segmenter(path, nbest)
        types = [pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            rows, full = [], []
            for text in batch.column(text_col).to_pylist():
                found = own.encode(text)
                score, ids = found[0]
                crc = zlib.crc32(ids)
                every = crc
                for _, more in found[1:]:
                    every = zlib.crc32(more, every)
                rows.append((len(ids) // 4, score, len(found), found[1][0] if len(found) > 1 else None, crc, every, own.decode(ids) == (text or "")))
                if with_ids:
                    full.append([{"score": s, "ids": i} for s, i in found])
            cols = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
            if with_ids:
                cols.append(pa.array(full, pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.binary())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *OUT, *["nbest"] * with_ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def op5_nbest(spark, sf_dir):
    return segment(documents(spark, sf_dir).select("doc_id", "text"), with_ids=False).drop("text")
