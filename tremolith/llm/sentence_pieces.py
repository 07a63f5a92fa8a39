"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

A text's segmentations are the paths through the lattice of its vocabulary
pieces.  A path's weight is the product of its pieces' weights; forward
filtering sums the weights of all paths up to each place, backward sampling then
draws the last piece, the one before it and so on, so that each segmentation
comes with exactly its share of the total weight.  The draws are a hash of the
row's key and the place in the text, hence a row always gets the same sample, on
whatever partition, attempt or batch it is worked on.

The lattice falls apart exactly where no piece crosses: before a run of spaces,
around line ends, and wherever else a look-up of all pieces shows it.  Stretches
of all lengths go through one forward pass together, a step for each character;
each sum is kept as a mantissa and an exponent, so nothing underflows, however
long a stretch is.  The few longest ones are finished one by one with the same
operations in the same order, hence with the same sums.  No text is cut off.

Weights: a BPE model's scores are ranks, not log-probabilities, so a piece of
rank r weighs (r + 2) ** -alpha; characters that the vocabulary lacks are spelt
in byte pieces, each weighing as the last rank.

Decoding is lossless: spaces are kept as they are, a literal U+2581 is spelt in
bytes, and the one space that encoding puts before a text is taken off again.

Defined results: a null or empty text has no pieces and decodes to the empty
text; a null key counts as 0; rows that repeat key and text get the same pieces;
an empty table gives an empty result; :func:`encode` ignores further columns,
:func:`decode` keeps them and replaces one that has the text's name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table
from .words import mix, row_slices

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, ALPHA = 7, 1.0
SCHEMA = "doc_id bigint, ids array<int>, n_pieces int, lossless boolean"
_PART = re.compile(r"\n| *[^ \n]+| +")
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Characters of distinct parts that go through the lattice at once.
_SLICE = 1 << 15
#: Stretches under which the pass goes on one by one.
_FEW = 8
_NONE = np.iinfo(np.int32).min


def load_vocabulary(path: str = DEFAULT_MODEL) -> dict:
    """What the workers need of a model; a few hundred KB."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, first_byte = [], model.piece_to_id("<0x00>")
    for i in range(model.vocab_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            rank = min(-model.get_score(i), model.vocab_size())
            pieces.append((i, model.id_to_piece(i).replace("▁", " "), float(rank)))
    if any(not _PART.fullmatch(p) for _, p, _ in pieces):
        raise ValueError("a piece of this model goes across words")
    return {"pieces": pieces, "first_byte": first_byte, "size": model.vocab_size()}


class Lattice:
    """Segmentations under one vocabulary."""

    def __init__(self, vocabulary: dict, alpha: float = ALPHA, seed: int = SEED):
        self.seed, self.size, self.first_byte = np.uint64(seed), vocabulary["size"], vocabulary["first_byte"]
        self.byte_weight = (self.size + 2.0) ** -alpha
        self.ids = {p: i for i, p, _ in vocabulary["pieces"]}
        self.weights = {p: (r + 2.0) ** -alpha for _, p, r in vocabulary["pieces"]}
        self.longest = max(map(len, self.ids))
        self.spelt = {i: p.encode() for p, i in self.ids.items()} | {self.first_byte + b: bytes([b]) for b in range(256)}
        # Beginnings of pieces are entries too, of weight 0: where even the beginning is unknown no longer piece can follow.
        texts = list(self.ids)
        texts += list({t[:k] for t in texts for k in range(1, len(t))} - self.ids.keys())
        keys = self._hash_all(texts)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.keys = keys
        self.key_ids = np.array([self.ids.get(t, 0) for t in texts], np.int32)
        self.key_weights = np.array([self.weights.get(t, 0.0) for t in texts])
        # A slot table over the top bits; entries whose slot is taken go to a second one over other bits, the rest are searched for.
        self.bits = 22
        self.slots = [np.full(1 << self.bits, -1, np.int32) for _ in range(2)]
        rest = np.arange(len(keys))
        for k in range(2):
            at = self._slot(self.keys[rest], k)
            self.slots[k][at] = rest
            rest = rest[self.slots[k][at] != rest]
        self.rest = {int(self.keys[i]): int(i) for i in rest}

    def _slot(self, keys: np.ndarray, k: int) -> np.ndarray:
        return ((keys >> np.uint64(64 - self.bits * (k + 1))) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _hash_all(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.uint64)
        for n in {len(t) for t in texts}:
            which = [i for i, t in enumerate(texts) if len(t) == n]
            codes = np.array([texts[i] for i in which], f"U{n}").view(np.uint32).reshape(-1, n)
            h = np.zeros(len(which), np.uint64)
            for j in range(n):
                h = h * _MULT + codes[:, j] + np.uint64(1)
            out[which] = mix(h)
        return out

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each piece hash, or -1."""
        out = self.slots[0][self._slot(keys, 0)]
        wrong = np.flatnonzero((self.keys[out] != keys) & (out >= 0))
        if len(wrong):
            some = keys[wrong]
            second = self.slots[1][self._slot(some, 1)]
            out[wrong] = np.where(self.keys[second] == some, second, -1)
            for key, entry in self.rest.items():
                out[wrong[some == np.uint64(key)]] = entry
        return out

    def _edges(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of flat characters, each in a part up to ``stop``: the weights and ids of
        the pieces that end at each, the longest first, and where none crosses."""
        n, most = len(codes), self.longest
        weights, ids = np.zeros((n, most)), np.zeros((n, most), np.int32)
        change = np.zeros(n + 2, np.int64)
        wide = codes.astype(np.uint64) + np.uint64(1)
        rows, h = np.arange(n), np.zeros(n, np.uint64)
        for k in range(1, most + 1):
            h = h * _MULT + wide[rows + (k - 1)]
            entry = self._find(mix(h))
            weight = np.where(entry >= 0, self.key_weights[entry], 0.0)
            hit = weight > 0
            some = rows[hit]
            weights[some + (k - 1), most - k] = weight[hit]
            ids[some + (k - 1), most - k] = self.key_ids[entry[hit]]
            if k == 1:  # spelt in bytes: minus the character
                odd = rows[~hit]
                c = codes[odd].astype(np.int64)
                weights[odd, most - 1] = self.byte_weight ** _utf8_length(c)
                ids[odd, most - 1] = -1 - c
            else:
                change += np.bincount(some + 1, minlength=n + 2) - np.bincount(some + k, minlength=n + 2)
            go = (entry >= 0) & (rows + k < stop[rows])
            rows, h = rows[go], h[go]
            if not len(rows):
                break
        return weights, ids, np.cumsum(change[: n + 1]) == 0

    def _forward(self, sums: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Turns the weights of the edges into each character, in place, into the
        cumulated shares of the paths that come by them."""
        most = self.longest
        mantissa, exponent = np.ones(len(sums)), np.zeros(len(sums), np.int64)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        t = 0
        while len(start):
            t += 1
            m = int(np.searchsorted(-length, -t, "right"))
            if m < _FEW:
                for a, n in zip(start[:m].tolist(), length[:m].tolist(), strict=True):
                    self._forward_one(sums[a : a + n], t - 1, mantissa[a : a + t - 1].tolist(), exponent[a : a + t - 1].tolist())
                return
            end = start[:m] + (t - 1)
            k = np.arange(min(t, most), 0, -1)
            before = end[:, None] - k[None, :]
            w, power = mantissa[before], exponent[before]
            if t <= most:  # from the stretch's start
                w[:, 0], power[:, 0] = 1.0, 0
            edge = sums[end, most - len(k) :]
            top = np.where(edge > 0, power, np.iinfo(np.int64).min).max(axis=1)
            w = np.cumsum(np.ldexp(w * edge, np.maximum(np.minimum(power - top[:, None], 0), -4000).astype(np.int32)), axis=1)
            sums[end, most - len(k) :] = w
            mantissa[end], more = np.frexp(w[:, -1])
            exponent[end] = top + more

    def _forward_one(self, sums: np.ndarray, done: int, mantissa: list[float], exponent: list[int]) -> None:
        """The rest of one stretch, of which ``done`` characters are through."""
        ends, columns = np.nonzero(sums[done:])
        weights, backs = sums[done:][ends, columns].tolist(), (ends + done - (self.longest - columns)).tolist()
        bounds = np.searchsorted(ends, np.arange(len(sums) - done + 1)).tolist()
        mantissa, exponent = [*mantissa, *[0.0] * (len(sums) - done), 1.0], [*exponent, *[0] * (len(sums) - done + 1)]  # the last: before the first
        cumulated = []
        for end in range(done, len(sums)):
            a, b = bounds[end - done], bounds[end - done + 1]
            top = max([exponent[i] for i in backs[a:b]])
            total = 0.0
            for w, i in zip(weights[a:b], backs[a:b], strict=True):
                total += math.ldexp(mantissa[i] * w, max(exponent[i] - top, -4000))
                cumulated.append(total)
            mantissa[end], more = math.frexp(total)
            exponent[end] = top + more
        sums[done:][ends, columns] = cumulated
        np.maximum.accumulate(sums[done:], axis=1, out=sums[done:])

    def draws(self, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        h = mix(mix(keys + self.seed) + places.astype(np.uint64) * _MULT)
        return (h >> np.uint64(11)) * 2.0**-53

    def encode_batch(self, texts: list[str | None], keys: list[int | None]) -> list[np.ndarray]:
        parts: dict[str, int] = {}
        number, counts = [], []
        for text in texts:
            found = _PART.findall(f" {text}") if text else []
            number += [parts.setdefault(p, len(parts)) for p in found]
            counts.append(len(found))
        number, names = np.array(number, np.int64), list(parts)
        length = np.array([len(p) for p in names], np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        ends = np.cumsum(length[number]) if len(number) else np.zeros(0, np.int64)
        begin = ends - length[number] if len(number) else ends  # where the part starts in the batch
        bases = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]  # and each text
        row_key = np.array([(k or 0) & (2**64 - 1) for k in keys], np.uint64)
        # By part, where it occurs.
        order = np.argsort(number, kind="stable")
        at = np.searchsorted(number[order], np.arange(len(names) + 1))
        out = np.full(int(bases[-1]), _NONE, np.int32)
        for part, offset, codes, stop, stretches in self._slices(names, length):
            weights, ids, free = self._edges(codes, stop)
            start = np.flatnonzero(free[: len(codes)])
            size = np.diff(np.append(start, len(codes)))
            keep = start < stretches
            start, size = start[keep], size[keep]
            self._forward(weights, start, size)
            # Each stretch in each place where its part occurs.
            of = part[start]
            times = at[of + 1] - at[of]
            which = np.repeat(np.arange(len(start)), times)
            occurrence = order[np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + at[of][which]]
            row = owner[occurrence]
            moved = begin[occurrence] + offset[start][which] - start[which]  # from here to the batch
            self._backward(weights, ids, start[which], (start + size)[which], moved, moved - bases[row], row_key[row], out)
        chosen = out != _NONE
        cuts = np.concatenate(([0], np.cumsum(chosen)))[bases]
        flat, cuts = self._spell(out[chosen].astype(np.int64), cuts)
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _slices(self, names: list[str], length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """Of distinct parts, about _SLICE characters at a time: the part and the
        place in it of each character, the characters, where their parts end, and
        up to where stretches count (the rest comes again)."""
        total, a = np.cumsum(length), 0
        while a < len(names):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _SLICE, "right")))
            codes = np.frombuffer("".join(names[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)
            part = np.repeat(np.arange(a, b), length[a:b])
            first = np.repeat(total[a:b] - length[a:b], length[a:b]) - (total[a - 1] if a else 0)
            place = np.arange(len(codes)) - first
            if len(codes) <= 2 * _SLICE:
                yield part, place, codes, first + length[part], len(codes)
            else:
                at, wide = 0, _SLICE
                while at < len(codes):
                    some = codes[at : at + wide + self.longest]
                    until = len(some)
                    if at + until < len(codes):
                        free = np.flatnonzero(self._edges(some, np.full(len(some), len(some)))[2][1 : wide + 1])
                        if not len(free):
                            wide *= 2
                            continue
                        until = int(free[-1]) + 1
                    yield part[at : at + until], place[at : at + until], some[:until], np.full(until, until), until
                    at, wide = at + until, _SLICE
            a = b

    def _backward(self, sums, ids, first, end, moved, places, key, out) -> None:
        while len(end):
            mine = sums[end - 1]
            draw = self.draws(key, places + end) * mine[:, -1]
            column = np.minimum((mine <= draw[:, None]).sum(axis=1), self.longest - 1)
            out[moved + end - 1] = ids[end - 1, column]
            end = end - (self.longest - column)
            go = end > first
            first, end, moved, places, key = first[go], end[go], moved[go], places[go], key[go]

    def _spell(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that have no piece become their bytes' pieces."""
        odd = flat < 0
        if not odd.any():
            return flat, at
        c = np.where(odd, -1 - flat, 0)
        width = np.where(odd, _utf8_length(c), 1)
        new = np.concatenate(([0], np.cumsum(width)))
        out = np.repeat(flat, width)
        where = np.flatnonzero(odd)
        for j in range(4):
            some = where[width[where] > j]
            out[new[some] + j] = self.first_byte + _utf8_byte(c[some], width[some], j)
        return out, new[at]

    def decode(self, ids) -> str:
        return b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def _utf8_length(c: np.ndarray) -> np.ndarray:
    return 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)


def _utf8_byte(c: np.ndarray, width: np.ndarray, j: int) -> np.ndarray:
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[width]
    shifted = c >> (6 * (width - 1 - j))
    return np.where(width == 1, c, lead + shifted if j == 0 else 0x80 | (shifted & 0x3F))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, alpha: float = ALPHA, seed: int = SEED, decoded: bool = False) -> DataFrame:
    """Per row ``doc_id, ids, n_pieces, lossless`` (the ids were decoded again),
    and the decoded ``text`` if asked for."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value, alpha, seed)
        for whole in batches:
            for batch in row_slices(whole, 512):
                texts = batch.column(1).to_pylist()
                ids = lattice.encode_batch(texts, batch.column(0).to_pylist())
                again = [lattice.decode(i.tolist()) for i in ids]
                same = [a == (t or "") for a, t in zip(again, texts, strict=True)]
                ends = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends).astype(np.int32)), pa.array(same)]
                names = ["doc_id", "ids", "n_pieces", "lossless"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(again, pa.string())], names=[*names, "text"]) if decoded else pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{SCHEMA}, text string" if decoded else SCHEMA
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """``df`` with the decoded text of each row's ids (null ids: empty)."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(shared.value)
        for ids in batches:
            yield pd.Series(["" if i is None else lattice.decode(i.tolist()) for i in ids], dtype=object)

    return df.withColumn(text_col, text(F.col(ids_col)))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
