"""Parts of the operators in plain Python, held against brute force."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from impactgraph.llm import ann, common, encoding, minhash, packing, quality, segmentation, sharding, substring, toxicity, wavelet


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_words_and_windows():
    words = "A b\tb\n c  a b".encode().split()
    hashes = common.words_of(b" A b\tb\n c  a\x0b\x0cb\r")
    assert hashes.shape == (len(words), 2)
    for half in (0, 1):
        assert all((hashes[i, half] == hashes[j, half]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    for size in (1, 2, 3):
        w = common.windows_of(hashes[:, 0], size)
        grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        assert all((w[i] == w[j]) == (grams[i] == grams[j]) for i in range(len(w)) for j in range(len(w)))
    assert len(common.words_of(b"")) == len(common.words_of(b" \n")) == 0 and len(common.windows_of(hashes[:, 0], 99)) == 0
    assert (common.words_of(b"AB \xc3\x89", lower=True) == common.words_of(b"ab \xc3\x89")).all()


def test_long_texts_are_split_in_blocks(monkeypatch):
    r = random.Random(1)
    words = [str(r.randrange(10**9)) * r.choice([1, 1, 40]) for _ in range(300)]
    whole = common.words_of(" ".join(words).encode())
    monkeypatch.setattr(common, "_BLOCK", 50)
    assert (common.words_of("\n ".join(words).encode()) == whole).all()


def thue_morse(n):
    """A word and its complement: different texts that agree under every polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_regular_words_and_windows_differ():
    a, b = thue_morse(1024)
    x, y = (common.words_of(t.encode())[0] for t in (a, b))
    assert (x != y).all()
    one, two = (common.words_of(" ".join(t).encode()) for t in (a, b))
    for size in (16, 20, 64, 1024):
        for p, q in zip(common.wide_windows(one, size), common.wide_windows(two, size), strict=True):
            assert p[0] != q[0]


def test_jump_moves_only_to_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    a, b = sharding.jump(keys.copy(), 40), sharding.jump(keys.copy(), 41)
    assert ((a == b) | (b == 40)).all() and len(set(a)) == 40 and np.bincount(a).max() < 200
    assert sorted(sharding.fisher_yates(np.random.default_rng(3), 50)) == list(range(50))


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 200, n).astype(np.uint32)
    w = wavelet.WaveletMatrix(wavelet.build(ids, 8), n)
    assert (w.all() == ids).all() and all(w.access(i) == ids[i] for i in range(0, n, 71))
    for v in (0, 7, 199, 5000):
        at = np.flatnonzero(ids == v)
        assert w.count(v) == len(at) and w.count(v, n // 2) == (ids[: n // 2] == v).sum()
        assert [w.locate(v, k) for k in range(min(5, len(at)))] == list(at[:5]) and w.locate(v, len(at)) is None


@pytest.mark.parametrize("planes", [17, 20])
def test_wavelet_keeps_wide_ids(planes):
    ids = np.array([65543, 7, 65543, 100_000, 0], np.uint32)
    w = wavelet.WaveletMatrix(wavelet.build(ids, planes), len(ids))
    assert w.all().tolist() == ids.tolist() and [w.access(i) for i in range(5)] == ids.tolist() and w.count(65543) == 2 and w.locate(65543, 1) == 2


def test_wavelet_refuses_ids_that_do_not_fit():
    with pytest.raises(ValueError):
        wavelet.build(np.array([65536], np.uint32), 16)


ENCODER = encoding.Encoder(encoding.default_path(), limit=40)
BITS = [" ", "  ", "$$", "it'll", "x-y", "a1", "ſ", "ǆ", "é", "@", "`", "[b]", "~", "\n", "\t", "a", "foo", "Été", "'s", "don't", ".", "..", "!?", "1", "中文", "\x85", " ", "　", "́", "|", "<|endoftext|>", "\x1c", "\x00", "🙂", "x²", "_"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=12).map("".join), max_size=4))
def test_encoder_equals_whole_texts(texts):
    for t, ids in zip([*texts, None], ENCODER.encode([*texts, None]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ENCODER.tokenizer.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*BITS, "\u2003", "\u3000", "、", "Ω"]), max_size=12).map("".join), min_size=1, max_size=4))
def test_cuts_equal_the_pattern(texts):
    data, starts, stops = encoding.cut(texts)
    pieces = [data[a:b].decode() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
    at = 0
    for t, stop in zip(texts, stops, strict=True):
        assert [*pieces[at:stop], pieces[stop]] == [*encoding.PIECE.findall(t), "\n"]
        at = stop + 1
    assert at == len(pieces)


def test_words_are_learned_by_the_model_alone():
    class Spy:
        def __init__(self, tokenizer):
            self.tokenizer, self.asked = tokenizer, []

        def encode_batch_fast(self, texts, **kw):
            self.asked += texts
            return self.tokenizer.encode_batch_fast(texts, **kw)

    enc = encoding.Encoder(encoding.default_path())
    enc.tokenizer = spy = Spy(enc.tokenizer)
    letters = [c for c in map(chr, range(0x250)) if encoding.WORD.fullmatch(c)]
    texts = [*letters, " ".join(letters), "".join(letters), "Unheard wordlings; été unheard's 42 wordlings"]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ENCODER.tokenizer.encode(t, add_special_tokens=False).ids
    assert set(spy.asked) == {"\n", ";", "'s", " 42"}


def test_a_run_of_texts_looks_each_piece_up_once():
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    enc = encoding.Encoder(encoding.default_path())
    enc.cache = Counted()
    found = enc.encode(["some words, some words"] * 50)
    assert len(found) == 50 and set(found) == {np.array(ENCODER.tokenizer.encode("some words, some words").ids, "<u4").tobytes()}
    assert enc.cache.asked <= 5  # "some", " words", ",", " some" and the line end between texts


def brute_windows(docs, size):
    """Words covered by a window that also starts earlier; docs in order."""
    seen, out = set(), []
    for words in docs:
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            w = tuple(words[i : i + size])
            if w in seen:
                gone[i : i + size] = [True] * size
            seen.add(w)
        out.append(gone)
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=4, max_size=60))
def test_anchors_lose_no_repeat(word_ids):
    """Equal windows have equal anchors at every level, so repeats survive."""
    hashes = common.words_of(" ".join(map(str, word_ids)).encode())[:, 0]
    full = common.windows_of(hashes, 4)
    inner, least, chosen = substring.level(hashes, 4, 2, np.ones(len(full), dtype=bool))
    for i in range(len(full)):
        assert any(inner[p] == least[i] for p in chosen if i <= p <= i + 2)
        for j in range(len(full)):
            if full[i] == full[j]:
                assert least[i] == least[j]
    assert substring.survivors(inner, least, chosen, 3).all()


def test_many_texts_at_once_equal_one_by_one():
    r = random.Random(4)
    texts = [" ".join(str(r.randrange(50)) * r.randint(1, 12) for _ in range(r.choice([0, 1, 3, 4, 5, 30]))).encode() for _ in range(40)] + [b"", b" \n", b"x"]
    hashes, starts = common.words_of_many(texts)
    valid = substring.within(starts, 4)
    for i, t in enumerate(texts):
        own = common.words_of(t)
        assert (hashes[starts[i] : starts[i + 1]] == own).all() and len(own) == len(t.split())
        assert valid[starts[i] : starts[i + 1]].sum() == max(0, len(own) - 3)
        assert (minhash.shingle_sets(texts)[i] == minhash.shingle_set(t)).all()
    assert [(a, b) for a, b in common.runs_of([5, 5, 20, 1, 1], 10)] == [(0, 2), (2, 3), (3, 5)]


def test_minhash_estimates():
    r = random.Random(5)
    a = [str(r.random()) for _ in range(400)]
    for keep in (400, 360, 300):
        b = a[:keep] + [str(r.random()) for _ in range(400 - keep)]
        x, y = minhash.shingle_set(" ".join(a)), minhash.shingle_set(" ".join(b))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        sig = [(minhash.minima(s) & np.uint32(255)).astype(np.uint8) for s in (x, y)]
        assert abs(minhash.estimate(*sig) - true) < 0.16
    tm = thue_morse(1024)
    assert not len(np.intersect1d(*(minhash.shingle_set(f"word one two three {t}") for t in tm)))
    assert minhash.node_of(minhash.shingle_set("a b")) != minhash.node_of(minhash.shingle_set("a c"))
    assert len(minhash.shingle_set("a b c")) == 1 and len(minhash.shingle_set(" \n")) == 0 and len(minhash.shingle_set(None)) == 0
    assert (minhash.shingle_set("A b C d e f") == minhash.shingle_set("a B c D e f")).all()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 25), max_size=25))
def test_packing_plan(histogram):
    runs = packing.best_plan(histogram, 60)
    got = {}
    for many, items in runs:
        assert many > 0 and sum(n * q for n, q in items) <= 60
        for n, q in items:
            got[n] = got.get(n, 0) + many * q
    assert got == {k: v for k, v in histogram.items() if v}
    table = packing.places(runs)
    used = set()
    for length, first, q, sequence, offset in table.tolist():
        assert (length, first) not in used
        used.add((length, first))


def test_packing_is_tight():
    r = random.Random(2)
    histogram = {n: r.randint(0, 40) for n in range(1, 2049)}
    bound = -(-sum(n * c for n, c in histogram.items()) // 2048)
    assert sum(m for m, _ in packing.best_plan(histogram)) <= 1.01 * bound


SEGMENTER = segmentation.Segmenter(segmentation.default_path(), 4)


def brute_paths(text):
    s = SEGMENTER
    t = segmentation.SPACE + text.replace(segmentation.SPACE, segmentation.ESCAPED).replace(" ", segmentation.SPACE)
    out = []

    def rec(i, score, ids):
        if i == len(t):
            out.append((score, tuple(ids)))
            return
        covered = False
        for j in range(i + 1, min(len(t), i + 16) + 1):
            if found := s.pieces.get(t[i:j]):
                covered |= j == i + 1
                rec(j, score + found[1], [*ids, found[0]])
        if not covered:
            char = segmentation.SPACE if t[i] == segmentation.ESCAPED else t[i]
            rec(i + 1, score + s.fallback, [*ids, *(s.bytes[b] for b in char.encode())])

    rec(0, 0.0, [])
    return dict((ids, score) for score, ids in out)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "in", " ", "  ", "é", "\n", "🙂", "▁", "ing", "中", "1", "."]), min_size=1, max_size=6).map("".join))
def test_nbest_equals_all_paths(text):
    every = brute_paths(text)
    found = SEGMENTER.encode(text)
    assert [s for s, _ in found] == sorted(every.values(), reverse=True)[:4]
    assert len({i for _, i in found}) == len(found)
    for score, ids in found:
        assert every[tuple(np.frombuffer(ids, "<u4").tolist())] == score and SEGMENTER.decode(ids) == text


def test_block_max_search_is_exact():
    r = random.Random(3)
    vectors = []
    for _ in range(400):
        v = {t: r.random() for t in r.sample(range(30), r.randint(0, 4))}
        n = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / n for t, x in v.items()})
    index = toxicity.BlockMaxIndex(vectors, 30, block=16)
    for q in vectors[:60]:
        every = sorted((-round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors))
        assert index.search(q, 7) == [(-s, i) for s, i in every if s < 0][:7]


def test_probes_come_in_order():
    """All valid perturbations of one table, the least sum of squared wall distances first; each bucket once."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 5))
    hashes = ann.Hashes(x, 1, 3, 0.5)
    assert len(hashes.sets) == 27 and not hashes.sets[0].any()
    for q in x[:20]:
        cells = hashes.cells(q[None])[0][0]
        floors, places = np.floor(cells), cells - np.floor(cells)
        every = []
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                for c in (-1, 0, 1):
                    step = np.array([a, b, c])
                    score = float((np.where(step < 0, places, np.where(step > 0, 1 - places, 0)) ** 2).sum())
                    every.append((score, int(hashes.keys((floors + step)[None], np.zeros(1))[0])))
        assert hashes.probe_keys(q, 27).tolist() == [k for _, k in sorted(every)]
        assert hashes.probe_keys(q, 5).tolist() == [k for _, k in sorted(every)][:5]
        assert int(hashes.bucket_keys(q[None])[0, 0]) == hashes.probe_keys(q, 1)[0]


def test_recall_target_or_everything():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((500, 24))
    hashes, count, recall = ann.tuned(x, 500, 10, 0.97)
    hit = total = 0
    keys = hashes.bucket_keys(x)
    for q in range(0, 500, 10):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += np.isin(keys[np.argsort(d)[:10]], hashes.probe_keys(x[q], count)).any(axis=1).sum()
        total += 10
    assert hit / total >= 0.95 and recall >= 0.97
    hashes, count, recall = ann.tuned(x, 500, 10, 1.1)  # a target that no probes reach: one bucket
    assert (hashes.a.shape[1], count, recall) == (0, 1, 1.0)
    assert len({int(k) for k in hashes.bucket_keys(x)[:, 0]} | set(hashes.probe_keys(x[0], 1).tolist())) == 1


def test_rules_fit():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality.NAMES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    b, rules = quality.fit(x, y, np.ones(600))
    p = b + sum(w * quality.applies(r, x) for r, w in rules)
    assert ((p > 0) == (y > 0)).mean() > 0.97
    assert quality.fit(x[:0], y[:0], y[:0])[1] == [] and quality.fit(x, np.ones(600), np.ones(600))[1] == []


def test_vectors_votes_and_scores_by_brute_force():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    vocabulary = ["".join(chr(97 + int(d)) for d in w[1:]) * 2 for w in vocabulary]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 12))), int(i % 3 == 0)) for i in range(80)]
    for telling in (False, True):
        model = toxicity.Model([toxicity.example(*x) for x in rows], (0.5, 1.0), k=7, telling=telling)
        texts = [x[1].split() for x in rows]
        df = {w: sum(w in t for t in texts) for w in vocabulary}
        factor = (lambda w: 1.0) if not telling else (lambda w: model.idf[model.vocabulary[w]] / (np.log(81 / (1 + df[w])) + 1))

        def vector(words):
            v = {w: (1 + np.log(words.count(w))) * (np.log(81 / (1 + df[w])) + 1) * factor(w) for w in set(words) if w in model.vocabulary}
            n = sum(x * x for x in v.values()) ** 0.5
            return {w: x / n for w, x in v.items()}

        index = [vector(t) for t in texts]
        assert all(f >= 1 - 1e-12 for f in map(factor, model.vocabulary))
        for _ in range(25):
            text = " ".join(r.choices(vocabulary, k=r.randint(1, 9)))
            q = vector(text.split())
            every = sorted((-round(sum(x * v.get(w, 0.0) for w, x in q.items()), 9), i) for i, v in enumerate(index))
            want = [(-s, i) for s, i in every if s < 0][:7]
            score, evidence = model.score(text, {})
            assert np.allclose([e["cosine"] for e in evidence], [s for s, _ in want])
            assert {e["label"] for e in evidence} <= {0, 1} and all(e["label"] == rows[e["doc_id"]][2] for e in evidence)
            vote = sum(e["cosine"] ** 2 * e["label"] for e in evidence) / sum(e["cosine"] ** 2 for e in evidence)
            assert np.isclose(score, 1 / (1 + np.exp(-(model.fit[0] + model.fit[1] * vote))))


def test_long_words_are_cut_where_no_piece_goes_across(monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice("aeioutrnsl中é0#") for _ in range(n)) for n in (50, 300, 900)]
    whole = [SEGMENTER.encode(t) for t in texts]
    monkeypatch.setattr(segmentation, "LONG", 16)
    assert any(len(SEGMENTER.cut(t)) > 1 for t in texts)
    for t, x in zip(texts, whole, strict=True):
        assert "".join(SEGMENTER.cut(t)) == t
        found = segmentation.Segmenter(segmentation.default_path(), 4).encode(t)
        assert np.allclose([s for s, _ in found], [s for s, _ in x]) and all(SEGMENTER.decode(i) == t for _, i in found)


def test_crc_of_ids():
    ids = ENCODER.encode(["a test"])[0]
    assert zlib.crc32(ids) == zlib.crc32(np.array(ENCODER.tokenizer.encode("a test").ids, "<u4").tobytes())
