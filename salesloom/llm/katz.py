"""Katz back-off language model of word pairs, and its score of every document.

Counts are discounted by Good-Turing; what a history's seen successors leave goes to the unseen ones in proportion to
their own probability, with a weight that makes the history sum to one. A word that training lacks shares the mass that
the discounted single words leave.

Texts are tokenised once into chunks of a bounded number of bytes. A chunk asks for each of its distinct words, and
for each of its distinct pairs, once: its requests are sorted arrays, one per bucket of the model's tables, and the bucket
answers in the same order, so that a chunk holds the part of the model that its own texts need, whatever the model's size.

    chunks --words--> word buckets --ids, counts--> chunks --pairs--> pair buckets --pair counts--> chunks
                      word buckets <--sums by history-- pair buckets
                      word buckets --back-off weights--> chunks --> scores
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import id_and_text, staged

#: The token after the last word of a document; also the history of its first.
END = b"\n"

#: Counts up to here are discounted.
DISCOUNTED = 5


@dataclass(frozen=True)
class Sizes:
    """Bytes of text in a chunk; requests for words, and tokens, per bucket; occurrences of a history per part of it."""

    chunk_bytes: int = 16 << 20
    words: int = 1_000_000
    tokens: int = 3_000_000
    history: int = 2_000_000


def held_out(doc_id: Column) -> Column:
    """Rows that the model may not learn from. A null id's text is empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def pack(a: np.ndarray) -> bytes:
    """Eight-byte numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, dtype=np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(dtype).ravel()


def mixed_bits(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.uint64)
    for _ in range(2):
        a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return a ^ (a >> np.uint64(29))


def slices(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in order) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]]))
    for s, e in zip(bounds[:-1], bounds[1:]):
        yield int(bucket[order[s]]), order[s:e]


# --- chunks

CHUNKS = (
    "chunk long, n_tokens long, n_words long, n_trained long, ids binary, no_id binary, trained binary, lengths binary, "
    "tokens binary, hashes binary, counts binary"
)


def _chunk(number: int, ids: list, trained: list, lengths: list, tokens: list, words: dict) -> dict:
    stream = np.concatenate(tokens)
    in_training = np.repeat(np.array(trained, bool), lengths)
    total = np.bincount(stream, minlength=len(words))
    by_use = np.argsort(-total, kind="stable")  # frequent words get small numbers
    rank = np.empty(len(words), np.int64)
    rank[by_use] = np.arange(len(words))
    stream = rank[stream]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)[by_use]
    return {
        "chunk": number,
        "n_tokens": len(stream),
        "n_words": len(words),
        "n_trained": int(in_training.sum()),
        "ids": pack(np.array([i or 0 for i in ids], np.int64)),
        "no_id": np.array([i is None for i in ids], np.uint8).tobytes(),
        "trained": np.array(trained, np.uint8).tobytes(),
        "lengths": pack(np.array(lengths, np.int64)),
        "tokens": pack(stream),
        "hashes": pack(hashes),
        "counts": pack(np.bincount(stream, weights=in_training, minlength=len(words)).astype(np.int64)),
    }


def chunked(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """One row per chunk: its documents, their tokens as numbers, and the distinct words with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        made, size = 0, 0
        state: tuple = ([], [], [], [], {})

        def table() -> pa.RecordBatch:
            row = _chunk(first + made, *state)
            return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()})

        for batch in batches:
            for doc, text, trained in zip(*(c.to_pylist() for c in batch.columns)):
                ids, flags, lengths, tokens, words = state
                raw = text.encode("utf-8")
                found = raw.lower().split()  # bytes: only A-Z change, only ASCII white space parts
                found.append(END)
                tokens.append(np.array([words.setdefault(w, len(words)) for w in found], np.int64))
                ids.append(doc)
                flags.append(trained)
                lengths.append(len(found))
                size += len(raw) + 16
                if size >= sizes.chunk_bytes:
                    yield table()
                    made, size, state = made + 1, 0, ([], [], [], [], {})
        if state[0]:
            yield table()

    rows = id_and_text(docs).withColumn("trained", ~held_out(F.col("doc_id")))
    return rows.mapInArrow(run, CHUNKS)


# --- words

ANSWERS = "kind string, target long, bucket long, a binary, b binary, c binary, n array<long>"
_NONE = np.zeros(0, np.int64)


def _answer(kind: str, target: int, bucket: int, a=_NONE, b=_NONE, c=_NONE, n=()) -> dict:
    return {"kind": kind, "target": target, "bucket": bucket, "a": pack(a), "b": pack(b), "c": pack(c), "n": [int(x) for x in n]}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "target", "bucket", "a", "b", "c", "n"])


def _counts_of_counts(total: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]


def word_requests(chunks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for chunk, hashes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                hashes, counts = unpack(hashes, np.uint64), unpack(counts)
                for bucket, at in slices((hashes % np.uint64(buckets)).astype(np.int64)):
                    rows.append((bucket, chunk, pack(hashes[at]), pack(counts[at])))
            names = ["bucket", "chunk", "hashes", "counts"]
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(names)}, schema=schema)

    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
    return chunks.select("chunk", "hashes", "counts").mapInArrow(
        run, "bucket long, chunk long, hashes binary, counts binary"
    )


def word_answers(requests: DataFrame, buckets: int) -> DataFrame:
    """Ids and total counts in the order of each request. Frequent words have small ids; id % buckets is the bucket."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])
        hashes = [unpack(h, np.uint64) for h in frame["hashes"]]
        counts = np.concatenate([unpack(c) for c in frame["counts"]])
        known, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(known)).astype(np.int64)
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((known, -total))] = np.arange(len(known))
        ids = rank * buckets + bucket
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        rows = [
            _answer("word", chunk, bucket, ids[part], total[part])
            for chunk, part in zip(frame["chunk"].tolist(), np.split(at, ends))
        ]
        rows.append(_answer("stats", -1, bucket, n=[total.sum(), (total > 0).sum(), *_counts_of_counts(total)]))
        return _frame(rows)

    return requests.groupBy("bucket").applyInPandas(run, ANSWERS)


def discounts(n: list[int]) -> np.ndarray:
    """Katz's factors for the counts 0 to DISCOUNTED + 1 from the numbers of types seen once, twice, and so on.

    Where the counts of counts don't give a factor between 0 and 1 (small or odd corpora), a half is taken off a count.
    """
    k = DISCOUNTED
    out = np.ones(k + 2)
    cut = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        d = 0.0
        if n[r - 1] and cut < 1:
            d = ((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut)
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


@dataclass(frozen=True)
class WordModel:
    """Probabilities of single words: discounted, and what is left for all words that training lacks together."""

    tokens: int
    types: int
    factors: np.ndarray
    scale: float
    unknown: float

    @classmethod
    def of(cls, n: list[int]) -> "WordModel":
        tokens, types, seen = n[0], n[1], n[2:]
        factors = discounts(seen)
        if not tokens:
            return cls(0, 0, factors, 1.0, 1.0)
        left = sum((1 - factors[r]) * r * seen[r - 1] for r in range(1, DISCOUNTED + 1)) / tokens
        if left <= 0:
            return cls(tokens, types, factors, tokens / (tokens + 1), 1 / (tokens + 1))
        return cls(tokens, types, factors, 1.0, left)

    def probability(self, count: np.ndarray) -> np.ndarray:
        seen = self.scale * self.factors[np.minimum(count, DISCOUNTED + 1)] * count / max(1, self.tokens)
        return np.where(count > 0, seen, self.unknown)


# --- pairs


class Chunk:
    """A chunk with its words' ids and counts: its distinct pairs, their order, and each token's pair."""

    def __init__(self, row, answers: pd.DataFrame, buckets: int):
        hashes = unpack(row.hashes, np.uint64)
        self.by_bucket = list(slices((hashes % np.uint64(buckets)).astype(np.int64)))
        given = {b: (a, t) for b, a, t in zip(answers["bucket"], answers["a"], answers["b"])}
        self.ids, self.count = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        for bucket, at in self.by_bucket:
            self.ids[at], self.count[at] = (unpack(x) for x in given[bucket])
        self.tokens, self.lengths = unpack(row.tokens), unpack(row.lengths)
        self.trained = np.repeat(np.frombuffer(row.trained, np.uint8), self.lengths)
        # every document ends in END, so that the token before a first word is END too
        before = np.empty_like(self.tokens)
        before[0], before[1:] = self.tokens[-1], self.tokens[:-1]
        pairs, self.pair = np.unique(before * len(hashes) + self.tokens, return_inverse=True)
        self.history, self.word = np.divmod(pairs, len(hashes))

    def pair_slices(self, parts: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """Positions of the pairs by bucket: by history, and for a frequent one by word as well."""
        split = 1 + self.count[self.history] // most
        with np.errstate(over="ignore"):
            key = mixed_bits(self.ids[self.history]) + mixed_bits(self.ids[self.word] % split + 1)
            bucket = (mixed_bits(key) % np.uint64(parts)).astype(np.int64)
        yield from slices(bucket)


def pair_requests(chunks: DataFrame, words: DataFrame, buckets: int, parts: int, sizes: Sizes) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in left.itertuples():
            c = Chunk(row, right, buckets)
            seen = np.bincount(c.pair, weights=c.trained, minlength=len(c.history)).astype(np.int64)
            for part, at in c.pair_slices(parts, sizes.history):
                h, w = c.history[at], c.word[at]
                rows.append((part, row.chunk, pack(c.ids[h]), pack(c.ids[w]), pack(c.count[w]), pack(seen[at])))
        return pd.DataFrame(rows, columns=["part", "chunk", "h", "w", "cw", "n"])

    needed = chunks.select("chunk", "tokens", "lengths", "trained", "hashes")
    return (
        needed.groupBy("chunk")
        .cogroup(words.where("kind = 'word'").withColumnRenamed("target", "chunk").groupBy("chunk"))
        .applyInPandas(run, "part long, chunk long, h binary, w binary, cw binary, n binary")
    )


def pair_answers(requests: DataFrame, model: WordModel, buckets: int) -> DataFrame:
    """Training counts in the order of each request; and by history, for the bucket of its word: how many successors
    were seen once, twice and so on, and the probability of all seen successors as single words."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        h, w, cw, n = (np.concatenate([unpack(x) for x in frame[k]]) for k in ("h", "w", "cw", "n"))
        ends = np.cumsum([len(unpack(x)) for x in frame["n"]])[:-1]
        order = np.lexsort((w, h))
        h, w, cw, n = h[order], w[order], cw[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(n, first)
        aligned = np.empty(len(h), np.int64)
        aligned[order] = total[np.cumsum(new) - 1]
        rows = [
            _answer("pair", chunk, part, a=x) for chunk, x in zip(frame["chunk"].tolist(), np.split(aligned, ends))
        ]
        seen = total > 0
        h, cw, total = h[first][seen], cw[first][seen], total[seen]
        if len(h):
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            few = np.stack([np.add.reduceat((total == r).astype(np.int64), head) for r in range(1, DISCOUNTED + 1)], axis=1)
            mass = np.add.reduceat(model.probability(cw), head)
            for bucket, at in slices(h[head] % buckets):
                rows.append(_answer("history", bucket, part, h[head][at], few[at].ravel(), mass[at]))
        rows.append(_answer("stats", -1, part, n=_counts_of_counts(total)))
        return _frame(rows)

    return requests.groupBy("part").applyInPandas(run, ANSWERS)


def weights(words: DataFrame, pairs: DataFrame, factors: np.ndarray, buckets: int) -> DataFrame:
    """For each word as a history, in the order of each request: back-off weight and factor of the seen successors.

    The factor is 1 unless no successor's count is discounted; then one occurrence is set aside for the others.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = [(row, unpack(row.a), unpack(row.b)) for row in left.itertuples()]
        if not rows:
            return _frame([])
        size = max(int(ids.max()) for _, ids, _ in rows) // buckets + 1
        few, mass = np.zeros((size, DISCOUNTED)), np.zeros(size)
        for row in right.itertuples():
            at = unpack(row.a) // buckets
            few[at] += unpack(row.b).reshape(-1, DISCOUNTED)
            mass[at] += unpack(row.c, np.float64)
        taken = few @ ((1 - factors[1 : DISCOUNTED + 1]) * np.arange(1, DISCOUNTED + 1))
        out = []
        for row, ids, count in rows:
            at = ids // buckets
            n = np.maximum(count, 1)
            kept = np.where(taken[at] > 0, 1.0, n / (n + 1))
            left_over = np.where(taken[at] > 0, taken[at] / n, 1 / (n + 1))
            alpha = np.where(count > 0, left_over / np.maximum(1 - mass[at], 1e-300), 1.0)
            out.append(_answer("weight", row.target, row.bucket, alpha, kept))
        return _frame(out)

    return (
        words.where("kind = 'word'")
        .groupBy("bucket")
        .cogroup(pairs.where("kind = 'history'").groupBy("target"))
        .applyInPandas(run, ANSWERS)
    )


# --- scores

SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def scores(chunks: DataFrame, answers: DataFrame, model: WordModel, factors, buckets: int, parts: int, sizes: Sizes):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for row in left.itertuples():
            c = Chunk(row, right[right["kind"] == "word"], buckets)
            alpha, kept = np.empty(len(c.ids)), np.empty(len(c.ids))
            given = right[right["kind"] == "weight"]
            by_bucket = {b: (x, y) for b, x, y in zip(given["bucket"], given["a"], given["b"])}
            for bucket, at in c.by_bucket:
                alpha[at], kept[at] = (unpack(x, np.float64) for x in by_bucket[bucket])
            seen = np.empty(len(c.history), np.int64)
            given = right[right["kind"] == "pair"]
            by_part = dict(zip(given["bucket"], given["a"]))
            for part, at in c.pair_slices(parts, sizes.history):
                seen[at] = unpack(by_part[part])
            h, w = c.history, c.word
            direct = kept[h] * factors[np.minimum(seen, DISCOUNTED + 1)] * seen / np.maximum(c.count[h], 1)
            back = alpha[h] * model.probability(c.count[w])
            of_pair = np.log10(np.where(seen > 0, direct, back))
            base = np.log10((c.count + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
            starts = np.concatenate([[0], np.cumsum(c.lengths)[:-1]])
            ids = pd.array(unpack(row.ids), dtype="Int64")
            ids[np.frombuffer(row.no_id, np.uint8).astype(bool)] = pd.NA
            frames.append(
                pd.DataFrame(
                    {
                        "doc_id": ids,
                        "held_out": np.frombuffer(row.trained, np.uint8) == 0,
                        "n_tokens": c.lengths,
                        "n_known": np.add.reduceat((c.count[c.tokens] > 0).astype(np.int64), starts),
                        "train_tokens": model.tokens,
                        "base_score": np.add.reduceat(base[c.tokens], starts),
                        "score": np.add.reduceat(of_pair[c.pair], starts),
                    }
                )
            )
        return pd.concat(frames) if frames else pd.DataFrame(columns=[f.split()[0] for f in SCORES.split(", ")])

    rows = chunks.drop("n_tokens", "n_words", "n_trained", "counts")
    return (
        rows.groupBy("chunk")
        .cogroup(answers.withColumnRenamed("target", "chunk").groupBy("chunk"))
        .applyInPandas(run, SCORES)
    )


def _sum_of_stats(answers: DataFrame, size: int) -> list[int]:
    stats = answers.where("kind = 'stats'")
    row = stats.agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(size)]).first()
    return [int(x or 0) for x in row]


def score_documents(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts have one token, the end. Words are told apart by 64-bit hashes. A null doc_id counts as the
    empty text when learning rows are chosen. Repeated rows are documents of their own; an empty table gives an empty one.
    """
    chunks = staged(chunked(docs, sizes), "chunks")
    asked = chunks.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    buckets = max(8, -(-(asked[0] or 0) // sizes.words))
    parts = max(8, -(-(asked[1] or 0) // sizes.tokens))
    words = staged(word_answers(word_requests(chunks, buckets), buckets), "words")
    model = WordModel.of(_sum_of_stats(words, DISCOUNTED + 3))
    pairs = staged(pair_answers(pair_requests(chunks, words, buckets, parts, sizes), model, buckets), "pairs")
    factors = discounts(_sum_of_stats(pairs, DISCOUNTED + 1))
    back_off = weights(words, pairs, factors, buckets)
    answers = words.where("kind = 'word'").unionByName(pairs.where("kind = 'pair'")).unionByName(back_off)
    return scores(chunks, answers.drop("n", "c"), model, factors, buckets, parts, sizes)
