"""Toxicity by nearest labelled examples.

A bounded sample of labelled rows of both labels is the example set. Its TF-IDF vectors hold all words of the texts and live in an inverted index whose postings are cut
into blocks of example numbers; each (term, block) knows its largest weight. A search adds these up to bounds, visits blocks from the highest bound down and
stops when no bound can beat the k-th cosine, so neighbours are exact. Neighbours vote with the square of their cosine; a logistic
fit on leave-one-out votes turns votes into probabilities.

With plain TF-IDF weights a text's neighbours are those of its topic, whatever its few insults, and most toxic texts are missed (figures in the README). So a word's weight has a
further factor, 1 at least, that grows with how surely it goes with label 1 (supervised term weighting); `telling=False` leaves it out. No word is left out either way.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, release, small_batches
from .minhash import shingle_set

WORD = re.compile(r"[^\W\d_]+")
OUT = ("score", "predicted", "evidence")
EVIDENCE = "array<struct<doc_id:long,cosine:double,label:int>>"


Example = tuple[int, str, list[int], list[int], int]  # id, words joined by spaces, how often each occurs, marks of the text, label


def counted(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def example(doc_id: int, text: str | None, label: int) -> Example:
    """A labelled text as its word counts and the least of its shingles, which near copies share."""
    words = counted(text)
    return doc_id, " ".join(words), list(words.values()), [int(h) for h in shingle_set(text)[:8].view(np.int64)], label


def remainder(id_col: str, m: int):
    """crc32 of the id as text, modulo m."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % m


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)


def sparse(vector) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of a vector that may be a dict."""
    return (np.fromiter(vector.keys(), np.int64, len(vector)), np.fromiter(vector.values(), np.float64, len(vector))) if isinstance(vector, dict) else vector


class BlockMaxIndex:
    """An inverted index over normalised sparse vectors with the largest weight of each (term, block of examples) that has one.

    A term that at least one in `common` examples has is a dense row instead; a search adds up such rows for all examples first.
    """

    def __init__(self, vectors, terms: int, block: int = 64, common: int = 4):
        found = [sparse(v) for v in vectors]
        self.block, self.size = block, len(found)
        self.blocks = max(1, -(-self.size // block))
        term = np.concatenate([t for t, _ in found] or [np.zeros(0, np.int64)]).astype(np.int32)
        order = np.argsort(term, kind="stable")  # by term, then by example
        term = term[order]
        ids = np.repeat(np.arange(self.size, dtype=np.int32), [len(t) for t, _ in found])[order]
        weights = np.concatenate([w for _, w in found] or [np.zeros(0)])[order]
        often = np.flatnonzero(np.bincount(term, minlength=terms) * common >= max(self.size, 1))
        self.row = np.full(terms, -1, dtype=np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.blocks * block))
        own = self.row[term] >= 0
        self.dense[self.row[term[own]], ids[own]] = weights[own]
        term, self.ids, self.weights = term[~own], ids[~own], weights[~own]
        at = self.ids // block
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (at[1:] != at[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.cuts = np.r_[first, len(term)].astype(np.int32)
        self.at, self.top = at[first], np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.pairs = np.searchsorted(term[first], np.arange(terms + 1)).astype(np.int32)

    def search(self, query, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k highest cosines above 0 as (cosine, example), ties to the smaller example; `skip` is left out."""
        terms, weights = sparse(query)
        if not len(terms):
            return []
        row = self.row[terms]
        partial = weights[row >= 0] @ self.dense[row[row >= 0]]
        terms, weights = terms[row < 0], weights[row < 0]
        x, y = self.pairs[terms], self.pairs[terms + 1]
        pairs, weights = spans(x, y), np.repeat(weights, y - x)
        at = self.at[pairs]
        bounds = partial.reshape(self.blocks, self.block).max(axis=1) + np.bincount(at, weights * self.top[pairs], self.blocks)
        order = np.lexsort((np.arange(self.blocks), -bounds))
        best: list[tuple[float, int]] = []
        done, step = 0, 8
        while done < self.blocks:
            now = order[done : done + step]
            now = now[(bounds[now] > 0) & ((bounds[now] >= -best[-1][0] - 1e-12) if len(best) == k else True)]
            if not len(now):
                break
            chosen = np.zeros(self.blocks, dtype=bool)
            chosen[now] = True
            here = chosen[at]
            x, y = self.cuts[pairs[here]], self.cuts[pairs[here] + 1]
            own = spans(x, y)
            scores = partial + np.bincount(self.ids[own], np.repeat(weights[here], y - x) * self.weights[own], len(partial))
            if skip >= 0:
                scores[skip] = 0
            scores = np.where(np.repeat(chosen, self.block), np.round(scores, 12), 0)
            hits = np.flatnonzero(scores > 0)
            if len(hits) > k:
                hits = hits[scores[hits] >= np.partition(scores[hits], -k)[-k]]
            best = sorted(best + [(-float(scores[i]), int(i)) for i in hits])[:k]
            done, step = done + step, self.blocks
        return [(-s, i) for s, i in best]


class Model:
    """Examples, vocabulary, index and calibration; of bounded size, and the same on every executor."""

    def __init__(self, rows: list[Example], rates: tuple[float, float], k: int = 30, telling: bool = True):
        """rates: of all labelled rows, the share kept in the sample by label, to undo its balance."""
        rows = sorted(rows, key=lambda r: (r[0], r[1]))
        self.k, self.ids, self.labels = k, [r[0] for r in rows], np.array([r[4] for r in rows], dtype=float)
        self.vocabulary: dict[str, int] = {}
        for _, words, _, _, _ in rows:
            for w in words.split():
                self.vocabulary.setdefault(w, len(self.vocabulary))
        counts = [self._terms(dict(zip(words.split(), times, strict=True))) for _, words, times, _, _ in rows]
        frequency = np.zeros(len(self.vocabulary))
        for t, _ in counts:
            frequency[t] += 1
        self.idf = np.log((1 + len(rows)) / (1 + frequency)) + 1
        if telling:
            self.idf *= self._telling(rows, [t for t, _ in counts], len(self.vocabulary))
        vectors = [self._vector(c) for c in counts]
        self.index = BlockMaxIndex(vectors, len(self.vocabulary))
        weight = np.array([1 / rates[int(y)] for y in self.labels]) if len(rows) else np.zeros(0)
        found = [self.index.search(v, k, skip=i) for i, v in enumerate(vectors)]
        none = np.array([not f for f in found], dtype=bool)
        pos, all_ = float((weight * self.labels)[none].sum()), float(weight[none].sum())
        self.prior = (pos + 0.1) / (all_ + 1.0)
        self.fit = self._calibrate(np.array([self._vote(f) for f in found])[~none] if len(rows) else np.zeros(0), self.labels[~none], weight[~none])

    @staticmethod
    def _telling(rows, terms, size: int) -> np.ndarray:
        """Each word's factor, 1 at least: the more, the surer and the more often it goes with label 1, with near copies counted once."""
        group, seen = [], {}
        for _, _, _, marks, y in rows:
            marks = [(h, y) for h in marks]
            g = next((seen[m] for m in marks if m in seen), len(group))
            for m in marks:
                seen.setdefault(m, g)
            group.append(g)
        holds = defaultdict(list)
        for (_, _, _, _, y), t, g in zip(rows, terms, group, strict=True):
            holds[y, g].append(t)
        n, count = np.zeros(2), np.zeros((2, size))
        for (y, _), own in holds.items():
            n[y] += 1
            count[y, np.unique(np.concatenate(own))] += 1
        p0, p1 = (count[y] / max(1, n[y]) for y in (0, 1))
        p = count.sum(axis=0) / max(1, n.sum())
        error = np.sqrt(p * (1 - p) * (1 / max(1, n[0]) + 1 / max(1, n[1])))
        z = np.divide(p1 - p0, error, out=np.zeros(size), where=error > 0)
        lift = np.log((count[1] + 0.5) / (n[1] + 1) / ((count[0] + 0.5) / (n[0] + 1)))
        return 1 + np.maximum(0, z) * np.maximum(0, lift)

    def _terms(self, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the vocabulary's words and how often each occurs."""
        found = [(t, n) for t, n in zip(map(self.vocabulary.get, words), words.values(), strict=True) if t is not None]
        terms, times = np.array(found, dtype=np.int64).reshape(-1, 2).T
        return terms, times

    def _vector(self, counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        v = (1 + np.log(counts[1])) * self.idf[counts[0]]
        return counts[0], v / np.sqrt((v * v).sum()) if len(v) else v

    def _vote(self, found) -> float:
        """The share of label 1 among the neighbours, weighted by the squares of their cosines."""
        total = sum(s * s for s, _ in found)
        return sum(s * s * self.labels[i] for s, i in found) / total if total else 0.0

    @staticmethod
    def _calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
        """Weighted logistic regression of the label on the vote, by Newton steps with a small ridge."""
        a = np.stack([np.ones(len(x)), x], axis=1) if len(x) else np.zeros((0, 2))
        beta = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a @ beta)))
            h = (a * (w * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(2)
            step = np.linalg.solve(h, a.T @ (w * (y - p)) - 0.05 * beta)
            beta = beta + np.clip(step, -5, 5)
        return float(beta[0]), float(beta[1])

    def found(self, text: str | None, memo: dict) -> tuple[float, np.ndarray, np.ndarray]:
        """The score, the neighbours' numbers, nearest first, and their cosines; equal texts are searched once while memo holds them."""
        key = hashlib.blake2b((text or "").lower().encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key not in memo:
            near = self.index.search(self._vector(self._terms(counted(text))), self.k)
            value = 1 / (1 + np.exp(-(self.fit[0] + self.fit[1] * self._vote(near)))) if near else self.prior
            if len(memo) > 2_000:
                memo.clear()
            memo[key] = min(1.0, max(0.0, float(value))), np.array([i for _, i in near], dtype=np.int64), np.array([s for s, _ in near])
        return memo[key]

    def score(self, text: str | None, memo: dict) -> tuple[float, list]:
        """The score and its evidence."""
        value, near, cosines = self.found(text, memo)
        return value, [{"doc_id": self.ids[i], "cosine": float(s), "label": int(self.labels[i])} for i, s in zip(near, cosines, strict=True)]


def examples(docs: DataFrame, labels: DataFrame, label: str, train, per_label: int, features, id_col: str = "doc_id", text_col: str = "text") -> tuple[list, tuple[float, float]]:
    """(id, label, features) of at most per_label labelled rows of either label, chosen by a hash of the id, and the shares of all labelled rows kept.

    features makes rows (id, label, text, h) into (id, label, h, x) on the executors, so whole texts of any length are learnt from and none goes to the driver. Of
    several rows of one id, the one whose text has the least hash counts.
    """
    known = labels.where(train & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    ids = [known.where(F.col("label") == y).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    picked = F.broadcast(ids[0].unionByName(ids[1]).withColumnRenamed("doc_id", "__picked"))  # at most 2 * per_label rows
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = features(rows.join(picked, F.col("id") == F.col("__picked")).select("id", "label", "text", "h"))
    rows = rows.groupBy("id", "label").agg(F.min_by("x", "h").alias("x")).collect()
    return [(r["id"], r["label"], r["x"]) for r in rows], tuple(min(1.0, per_label / max(1, totals.get(y, 0))) for y in (0, 1))


def _word_counts(rows: DataFrame) -> DataFrame:
    kind = pa.struct([("words", pa.string()), ("times", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            found = [example(0, t, 0) for t in batch.column("text").to_pylist()]
            x = pa.array([{"words": w, "times": n, "marks": m} for _, w, n, m, _ in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("h"), x], ["id", "label", "h", "x"])

    return rows.mapInArrow(run, "id long, label int, h long, x struct<words:string,times:array<long>,marks:array<long>>")


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1), predicted (score >= 0.7) and evidence (the neighbours, nearest first).

    Null, empty and wordless texts, and texts without a term of any example, get the rate of such examples and no evidence. Input columns that
    bear an output's name are replaced. Repeated rows get equal scores. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(*OUT)
    shared = spark.sparkContext.broadcast(model)
    from pyspark.sql import types as T

    out = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("evidence", T._parse_datatype_string(EVIDENCE))])

    def run(batches):
        model, memo = shared.value, {}
        ids, labels = np.array(model.ids, dtype=np.int64), model.labels.astype(np.int32)
        for batch in batches:
            found = [model.found(t, memo) for t in batch.column(text_col).to_pylist()]
            near = np.concatenate([n for _, n, _ in found] or [np.zeros(0, dtype=np.int64)])
            cosines = np.concatenate([c for _, _, c in found] or [np.zeros(0)])
            offsets = pa.array(np.cumsum([0, *(len(n) for _, n, _ in found)]), pa.int32())
            kind = pa.StructArray.from_arrays([pa.array(ids[near] if len(ids) else near, pa.int64()), pa.array(cosines, pa.float64()), pa.array(labels[near] if len(ids) else near, pa.int32())], ["doc_id", "cosine", "label"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _, _ in found], pa.float64()), pa.ListArray.from_arrays(offsets, kind)], [*batch.schema.names, "score", "evidence"])
        del model, memo
        release()

    return docs.mapInArrow(run, out).withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 1500, learn_from: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", telling: bool = True) -> DataFrame:
    """Scores docs by models learnt from at most per_label labelled rows of either label of learn_from (docs by default).

    Rows whose crc32(id as text) modulo 3 is 1 are held out of learning and marked held_out. Without usable labels every score is a low prior. A column held_out is replaced;
    for the rest see `score`.
    """
    small_batches(docs.sparkSession)
    rows, rates = examples(docs if learn_from is None else learn_from, labels, "toxic", remainder("doc_id", 3) != 1, per_label, _word_counts, id_col, text_col)
    model = Model([(i, x["words"], x["times"], x["marks"], y) for i, y, x in rows], rates, telling=telling)
    del rows
    scored = score(docs.drop("held_out"), model, text_col)
    del model  # executors have it; the driver gives its memory back
    release()
    return scored.withColumn("held_out", F.coalesce(remainder(id_col, 3) == 1, F.lit(False)))


def op8_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
