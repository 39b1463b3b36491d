"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed bigram model. Every word is a state; a seen bigram is an arc that carries
``log10((c(h, w) + m * p(w)) / (c(h) + m))``; every state has a failure arc ``log10(m / (c(h) + m))`` to the root, whose
arcs carry ``p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))``. A text is read once from left to right: the current state is
carried along, failure arcs are taken where no arc fits, and the weights add up. A text starts in the state of the end
token, so that first words have their own distribution.

The automaton of the whole corpus is never held in one place. Texts are packed into chunks of ``CHUNK_TOKENS`` tokens;
a chunk asks for the counts of its own distinct words and bigrams only. Requests are grouped by a hash of the n-gram
(every n-gram occurs once per chunk, so a frequent one costs a row entry per chunk), summed, and answered to each chunk,
which then builds the part of the automaton that its texts can reach. Words are named by 64 bits of hash.

Defined results: a null text is empty and has the end token only; rows whose ``doc_id`` is null train the model;
repeated rows count and are scored each; without training rows every score comes from the smoothing alone; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.stage import groups_for, stage

CHUNK_TOKENS = 1 << 20
BUCKET_KEYS = 1 << 22
PRIOR = 32.0
_LOWER = bytes.maketrans(bytes(range(65, 91)) + bytes(range(9, 14)), bytes(range(97, 123)) + b" " * 5)
END = b""  # no word is empty


def tokens(text: str | None) -> list[bytes]:
    """Words, then the end token."""
    found = [w for w in (text or "").encode().translate(_LOWER).split(b" ") if w]
    found.append(END)
    return found


def chunks(docs: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """One row per chunk of texts: ids, lengths, local token numbers and the hash of every local word."""

    def pack(doc_id: list, held: list, size: list, numbers: list, words: dict) -> pd.DataFrame:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        return pd.DataFrame({
            "chunk": [uuid.uuid4().hex], "doc_id": [doc_id], "held_out": [held], "size": [np.array(size, np.int32).tobytes()],
            "tokens": [np.concatenate(numbers).tobytes()], "words": [hashes.tobytes()],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc_id, held, size, numbers, words, n = [], [], [], [], {}, 0
        for pdf in batches:
            for key, out, body in zip(pdf["doc_id"], pdf["held"], pdf["text"]):
                found = tokens(body)
                numbers.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found)))
                doc_id.append(key)
                held.append(bool(out))
                size.append(len(found))
                n += len(found)
                if n >= CHUNK_TOKENS:
                    yield pack(doc_id, held, size, numbers, words)
                    doc_id, held, size, numbers, words, n = [], [], [], [], {}, 0
        if size:
            yield pack(doc_id, held, size, numbers, words)

    # Ids as text: a null among them would turn a column of longs into doubles.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), held_out.alias("held"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "chunk string, doc_id array<string>, held_out array<boolean>, size binary, tokens binary, words binary")


class Reading:
    """The n-grams of one chunk, in an order that both passes derive alike."""

    def __init__(self, row, buckets: int):
        self.size = np.frombuffer(row.size, np.int32)
        self.tokens = np.frombuffer(row.tokens, np.int32).astype(np.int64)
        self.words = np.frombuffer(row.words, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.end = int(self.tokens[self.starts[0] + self.size[0] - 1])
        before = np.concatenate([[self.end], self.tokens[:-1]])  # the token before a text's first is an end token
        self.pair = before * len(self.words) + self.tokens
        self.pairs, self.pair_at = np.unique(self.pair, return_inverse=True)
        first, second = self.words[self.pairs // len(self.words)], self.words[self.pairs % len(self.words)]
        h = (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + second
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        self.pair_keys = h ^ (h >> np.uint64(29))
        self.parts = [self._split(keys, buckets) for keys in (self.words, self.pair_keys)]

    @staticmethod
    def _split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((keys, bucket))
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def requests(chunked: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, keys and training counts of words and of bigrams)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                r = Reading(row, buckets)
                trains = np.repeat(~np.array(row.held_out, bool), r.size)
                counts = (np.bincount(r.tokens[trains], minlength=len(r.words)), np.bincount(r.pair_at[trains], minlength=len(r.pairs)))
                (word_order, word_cut), (pair_order, pair_cut) = r.parts
                out = []
                for b in range(buckets):
                    w, p = word_order[word_cut[b] : word_cut[b + 1]], pair_order[pair_cut[b] : pair_cut[b + 1]]
                    if len(w) or len(p):
                        out.append((b, row.chunk, r.words[w].tobytes(), counts[0][w].astype(np.int32).tobytes(), r.pair_keys[p].tobytes(), counts[1][p].astype(np.int32).tobytes()))
                yield pd.DataFrame(out, columns=["bucket", "chunk", "words", "word_n", "pairs", "pair_n"])

    return chunked.select("chunk", "held_out", "size", "tokens", "words").mapInPandas(
        run, "bucket long, chunk string, words binary, word_n binary, pairs binary, pair_n binary")


def answers(asked: DataFrame) -> DataFrame:
    """(chunk, bucket, corpus counts in the order asked, distinct trained words of the bucket on its first row)."""

    def total(keys: list[bytes], counts: list[bytes]) -> tuple[list[np.ndarray], int]:
        parts = [np.frombuffer(k, np.uint64) for k in keys]
        unique, at = np.unique(np.concatenate(parts), return_inverse=True)
        summed = np.bincount(at, np.concatenate([np.frombuffer(c, np.int32) for c in counts]), minlength=len(unique)).astype(np.int64)
        return np.split(summed[at], np.cumsum([len(p) for p in parts])[:-1]), int((summed > 0).sum())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words, distinct = total(list(pdf["words"]), list(pdf["word_n"]))
        pairs, _ = total(list(pdf["pairs"]), list(pdf["pair_n"]))
        return pd.DataFrame({
            "chunk": pdf["chunk"], "bucket": pdf["bucket"], "word_n": [x.tobytes() for x in words],
            "pair_n": [x.tobytes() for x in pairs], "vocabulary": [distinct] + [0] * (len(pdf) - 1),
        })

    return asked.groupBy("bucket").applyInPandas(run, "chunk string, bucket long, word_n binary, pair_n binary, vocabulary long")


def traverse(sequences: list[list[int]], states: int, arcs: dict[int, float], failure: list[float], root: list[float], start: int) -> list[float]:
    """Log-probability of each sequence. An arc of state ``s`` for word ``w`` has the key ``s * states + w``."""
    out = []
    for sequence in sequences:
        state, weight = start, 0.0
        for w in sequence:
            arc = arcs.get(state * states + w)
            weight += failure[state] + root[w] if arc is None else arc
            state = w
        out.append(weight)
    return out


def score(docs: DataFrame, held_out: Column, text: str = "text", prior: float = PRIOR) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``."""
    chunked = stage(chunks(docs, held_out, text))
    n_chunks = chunked.count()
    buckets = groups_for(n_chunks * CHUNK_TOKENS, BUCKET_KEYS)
    replies = stage(answers(requests(chunked, buckets)))
    vocabulary = int(replies.agg(F.sum("vocabulary")).first()[0] or 0)

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"n": [int(np.frombuffer(s, np.int32)[~np.array(h, bool)].sum()) for s, h in zip(pdf["size"], pdf["held_out"])]})

    n_train = int(chunked.select("size", "held_out").mapInPandas(trained, "n long").agg(F.sum("n")).first()[0] or 0)

    def run(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        row = next(rows.itertuples(index=False))
        r = Reading(row, buckets)
        counts = counts.sort_values("bucket")
        n1, n2 = np.zeros(len(r.words), np.int64), np.zeros(len(r.pairs), np.int64)
        n1[r.parts[0][0]] = np.frombuffer(b"".join(counts["word_n"]), np.int64)
        n2[r.parts[1][0]] = np.frombuffer(b"".join(counts["pair_n"]), np.int64)
        p1 = (n1 + 0.5) / (n_train + 0.5 * (vocabulary + 1))
        context = r.pairs // len(r.words)
        seen = n2 > 0
        weight = np.log10((n2 + prior * p1[r.pairs % len(r.words)]) / (n1[context] + prior))
        arcs = dict(zip(r.pairs[seen].tolist(), weight[seen].tolist()))
        root = np.log10(p1)
        sequences = [s.tolist() for s in np.split(r.tokens, r.starts[1:])]
        return pd.DataFrame({
            "doc_id": pd.array([None if x is None else int(x) for x in row.doc_id], dtype="Int64"), "held_out": list(row.held_out), "n_tokens": r.size.astype(np.int64),
            "n_known": np.add.reduceat((n1 > 0)[r.tokens].astype(np.int64), r.starts), "train_tokens": n_train,
            "base_score": np.add.reduceat(root[r.tokens], r.starts),
            "score": traverse(sequences, len(r.words), arcs, np.log10(prior / (n1 + prior)).tolist(), root.tolist(), r.end),
        })

    return chunked.groupBy("chunk").cogroup(replies.select("chunk", "bucket", "word_n", "pair_n").groupBy("chunk")).applyInPandas(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))
