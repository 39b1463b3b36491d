"""Best-fit packing of token sequences under several capacities.

Every sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces are
placed longest first. Among the open sequences that have room in every dimension, the tightest wins: the one with the
smallest weighted dot product of the piece and the residual capacities (the largest would be worst fit), or with the
smallest weighted norm of what is left. Pieces of equal length are placed in one vectorised step.

Texts are tokenized where they lie; only piece lengths travel. Pieces are dealt by a hash into groups of about
``GROUP_PIECES``, each packed by one task, so that a hot source or length is spread like any other. A full piece is a
sequence of its own.

Defined results: a null text is empty and has the end token only; a null ``doc_id`` keeps its row; repeated rows are
packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.stage import groups_for, shuffled, stage

MAX_TOKENS = 2048
MAX_DOCUMENTS = 2048
WEIGHTS = (1.0, 0.01, 0.01)
GROUP_PIECES = 1 << 16
CACHE_ENTRIES = 1 << 18
TURN_CHARS = 1 << 22
POINTS = ".,;:!?"
END_ID = 0


class Encoder:
    """Token ids of texts as unsigned 32-bit numbers, with the end id appended.

    The tokenizer never joins anything across white space or from a letter to a point behind it, so the parts between are
    encoded on their own and remembered. It lowers letters; texts of characters below U+0100, which its normalisation
    leaves as they are, are lowered as a whole first, unless they may hold a special token. A part of such letters is one word
    to the tokenizer and goes straight to its model. Arrow splits a batch, numbers its distinct parts, finds the known ones and
    gathers the ids, with a step of Python for new parts only. Words and ids are two Arrow arrays; when they are full, those
    of the batch at hand stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model = tokenizer.encode, tokenizer.model.tokenize
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)}
        # No part is a space: it stands for the end.
        self.words, self.ids = pa.array([" "], pa.string()), pa.array([[END_ID]], pa.large_list(pa.uint32()))

    def _new(self, part: str) -> list[int]:
        if part.isalpha():
            if part.isascii():
                return [t.id for t in self.model(part.lower())]
            if max(part) < "\u0100":
                return [t.id for t in self.model(part.lower().translate(self.bytes))]
        return self.encode(part, add_special_tokens=False).ids

    def _places(self, parts: pa.Array) -> pa.Array:
        """Where the distinct ``parts`` stand among the known words; new ones are added."""
        places = pc.index_in(parts, self.words)
        if len(self.words) > CACHE_ENTRIES:
            kept = pa.concat_arrays([pa.array([0], pa.int32()), places.drop_null()])
            self.words, self.ids = self.words.take(kept), self.ids.take(kept)
            places = pc.index_in(parts, self.words)
        new = parts.filter(places.is_null())
        found = pa.array([self._new(p) for p in new.to_pylist()], self.ids.type)
        added = np.cumsum(places.is_null().to_numpy(zero_copy_only=False)) + len(self.words) - 1
        self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, found])
        return pc.coalesce(places, pa.array(added, pa.int32()))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text ends. Every distinct part is looked up once."""
        texts = pc.fill_null(texts, "")
        lowered = pc.if_else(pc.match_substring_regex(texts, "[^\\x00-\\xFF]|<\\|"), texts, pc.utf8_lower(texts))
        spaced = pc.replace_substring_regex(pc.replace_substring_regex(lowered, "[\\t-\\r]", " "), f"(\\pL)([{POINTS}])", "\\1 \\2")
        parts = pc.split_pattern(spaced, " ")
        coded = parts.flatten().dictionary_encode()
        last = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()
        codes = np.insert(self._places(coded.dictionary).take(coded.indices).to_numpy(), last, 0)
        found = self.ids.take(pa.array(codes))
        return found.flatten().to_numpy(), found.offsets.to_numpy()[1:][last + np.arange(len(last))]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process, so that later tasks find the parts that earlier ones met."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32 [, ids]); ``row`` names the row of ``docs`` a piece comes from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, at, named = batch.column(1), 0, uuid.uuid4().hex
            # Batches of long texts are taken in turns, so that the ids of few of them are in memory together.
            size = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            turn = np.cumsum(size) // TURN_CHARS
            for stop in [*(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows] if batch.num_rows else []:
                ids, ends = encoder(tokenizer_path).batch(column.slice(at, stop - at))
                length = np.diff(ends, prepend=0)
                pieces = -(-length // max_tokens)
                doc = np.repeat(np.arange(stop - at), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * max_tokens
                kept = np.minimum(length[doc] - start, max_tokens)
                first = (ends - length)[doc] + start
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                cut = [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), (first + kept).tolist())]
                columns = [
                    pa.array([f"{named}-{at + i}" for i in doc.tolist()], pa.string()), batch.column(0).slice(at, stop - at).take(pa.array(doc)),
                    pa.array(nth.astype(np.int32)), pa.array(start), pa.array(kept), pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                    *([pa.array([bytes(c) for c in cut], pa.binary())] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
                at = stop

    schema = "row string, doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack_lengths(
    lengths: np.ndarray, max_tokens: int = MAX_TOKENS, max_documents: int = MAX_DOCUMENTS, max_attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS, rule: str = "dot",
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece. Equal lengths are placed together, longest first."""
    room = np.array([max_tokens, max_documents, max_attention or max_tokens**2], float)
    weight = np.array(weights, float) / room**2
    order = np.argsort(-lengths, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(lengths[order]) != 0, True])
    sequence = np.zeros(len(lengths), np.int64)
    least = int(lengths.min()) if len(lengths) else 0
    numbers, left, n_bins = np.zeros(0, np.int64), np.zeros((0, 3)), 0  # the open sequences
    for a, b in zip(cuts[:-1], cuts[1:]):
        run, size = order[a:b], int(lengths[order[a]])
        need = np.array([size, 1, size * size], float)
        if (need > room).any():
            raise ValueError(f"a piece of {size} tokens exceeds a capacity")
        fits = np.floor((left / need).min(axis=1)).astype(np.int64)
        able = np.flatnonzero(fits > 0)
        after = left[able] - need
        cost = (weight * after**2).sum(axis=1) if rule == "norm" else (weight * need * left[able]).sum(axis=1)
        able = able[np.argsort(cost, kind="stable")]
        # The best sequence stays the best until it is full, as its residual only shrinks; then comes the next.
        ends = np.minimum(np.cumsum(fits[able]), len(run))
        put = np.diff(ends, prepend=0)
        left[able] -= put[:, None] * need
        placed = int(ends[-1]) if len(ends) else 0
        sequence[run[:placed]] = np.repeat(numbers[able], put)
        if placed < len(run):
            each = int((room / need).min())
            fresh = -(-(len(run) - placed) // each)
            put = np.full(fresh, each)
            put[-1] = len(run) - placed - each * (fresh - 1)
            own = np.arange(n_bins, n_bins + fresh)
            sequence[run[placed:]] = np.repeat(own, put)
            numbers, left, n_bins = np.r_[numbers, own], np.r_[left, room - put[:, None] * need], n_bins + fresh
        keep = (left >= (least, 1, least * least)).all(axis=1)
        numbers, left = numbers[keep], left[keep]
    by_bin = np.argsort(sequence, kind="stable")
    before = np.cumsum(lengths[by_bin]) - lengths[by_bin]
    first = np.flatnonzero(np.diff(sequence[by_bin], prepend=-1))
    offset = np.zeros(len(lengths), np.int64)
    offset[by_bin] = before - np.repeat(before[first], np.diff(np.r_[first, len(lengths)]))
    return sequence, offset


def pack(
    docs: DataFrame, tokenizer_path: str, text: str = "text", max_tokens: int = MAX_TOKENS, max_documents: int = MAX_DOCUMENTS,
    max_attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "dot", with_ids: bool = False,
) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``."""
    cut = stage(pieces(docs, tokenizer_path, text, max_tokens, with_ids))
    groups = groups_for(cut.filter(F.col("length") < max_tokens).count(), GROUP_PIECES)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row", "piece"], ignore_index=True)  # reruns of a task agree
        sequence, offset = pack_lengths(pdf["length"].to_numpy(), max_tokens, max_documents, max_attention, weights, rule)
        return pd.DataFrame({"row": pdf["row"], "piece": pdf["piece"], "sequence_id": sequence * groups + int(key[0]), "offset": offset})

    group = F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).alias("group")
    short = cut.filter(F.col("length") < max_tokens)
    placed = short.select("row", "piece", "length").groupBy(group).applyInPandas(run, "row string, piece int, sequence_id long, offset long")
    # Full pieces take negative numbers: they need no group.
    full = cut.filter(F.col("length") >= max_tokens).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return shuffled(short).join(placed, ["row", "piece"]).unionByName(full).drop("row")
