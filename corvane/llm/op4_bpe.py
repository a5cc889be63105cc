"""Byte-level BPE encoding and decoding with a pair occurrence index.

A task gathers the distinct pieces of a block of texts (the tokenizer's split pattern), lays all their bytes out as one
symbol array with linked neighbours, and keeps an index from each adjacent pair that has a rank to all its positions.
Active ranks are applied in ascending order, each at all its positions at once; the neighbours' new pairs join the
lists of their ranks.  A pair that holds a merged symbol always ranks after the merge that made the symbol, so one
ascending pass gives the same tokens as merging each piece on its own.  Encoded pieces are kept for later blocks of the
task, up to CACHE of them; a block holds about BLOCK_BYTES of text, so memory doesn't follow the size of a partition.

There is no shuffle: a lost executor costs its tasks only.  The merge table is read on the driver (its size is the
tokenizer's) and travels with the tasks.

Edge cases: null text is an empty text and has no ids; added tokens written out in a text become their ids, as the
tokenizers library has it by default; very long texts form a block of their own.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

BLOCK_BYTES = 6 << 20
BLOCK_IDS = 1 << 20
CACHE = 300_000
#: The split pattern of byte-level BPE, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END, DEAD = -1, -2


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary's strings: printable Latin-1 for itself, the others moved up to 256 and on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, up = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else up))
        up += b not in plain
    return out


class Tokenizer:
    """The tables of a byte-level BPE file of the tokenizers library, as arrays."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        of = {c: b for b, c in enumerate(byte_letters())}
        vocab = model["vocab"]
        self.bytes = [b""] * (max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = len(self.bytes)
        self.first = np.array([vocab[c] for c in byte_letters()], np.int32)
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        keys = left * self.size + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where it has none."""
        key = a.astype(np.int64) * self.size + b
        key[(a < 0) | (b < 0)] = -1
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the pieces in turn, and the number of tokens of each."""
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths + 1)  # a sentinel follows each piece
        n = int(ends[-1]) + 1
        sym = np.full(n, END, np.int32)
        inside = np.ones(n, bool)
        inside[0] = False
        inside[ends] = False
        sym[inside] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[-1] = n - 1
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(rank: np.ndarray, at: np.ndarray) -> None:
            has = rank >= 0
            rank, at = rank[has], at[has]
            if not len(rank):
                return
            o = np.argsort(rank, kind="stable")
            rank, at = rank[o], at[o]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate(([0], cut))].tolist(), np.split(at, cut) if len(cut) else [at], strict=True):
                if r in lists:
                    lists[r].append(part)
                else:
                    lists[r] = [part]
                    heapq.heappush(active, r)

        at = np.flatnonzero(inside).astype(np.int32)
        enter(self.ranks(sym[at], sym[nxt[at]]), at)
        while active:
            r = heapq.heappop(active)
            parts = lists.pop(r)
            a, b = self.left[r], self.right[r]
            p = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            p = p[(sym[p] == a) & (sym[nxt[p]] == b)]
            if not len(p):
                continue
            if a == b and len(p) > 1:  # of a run of overlapping places, every other one from the left
                follows = np.concatenate(([False], nxt[p[:-1]] == p[1:]))
                start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(p))))
                p = p[(np.arange(len(p)) - start) % 2 == 0]
            q = nxt[p]
            after = nxt[q]
            sym[p], sym[q] = self.made[r], DEAD
            nxt[p] = after
            prv[after] = p
            before = prv[p]
            enter(self.ranks(np.concatenate((sym[before], sym[p])), np.concatenate((sym[p], sym[after]))), np.concatenate((before, p)))
        tokens = np.zeros(n, np.int64)
        np.cumsum(sym >= 0, out=tokens)
        upto = np.concatenate(([0], tokens[ends]))
        return sym[sym >= 0], np.diff(upto)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


class _Numbers(dict):
    """A number for each piece, given as it is first met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def _take(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length], one after the other."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(length) else 0)]


class Encoder:
    """Encodes blocks of texts, and keeps what it has encoded: pieces of the split pattern, and units that texts are cut into first.

    A unit is what stands between two spaces, with the space before it.  Where every space is followed by something that
    isn't white space, no piece reaches over the end of a unit, so the split pattern has to run on distinct units only.
    Other texts, and texts with added tokens, are split by the pattern as a whole.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.t = tokenizer
        self.find = regex.compile(PATTERN).findall
        self.odd_space = regex.compile(r" (?:\s|\Z)").search
        self.special = regex.compile("|".join(map(regex.escape, sorted(tokenizer.added, key=len, reverse=True)))) if tokenizer.added else None
        self.clear()

    def clear(self) -> None:
        self.pieces, self.units = _Numbers(), _Numbers()
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.unit_flat, self.unit_start, self.unit_length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, text: str) -> list:
        if self.special is None or not any(s in text for s in self.t.added):
            return self.find(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.find(text[at : m.start()])
            out.append(("added", self.t.added[m.group()]))
            at = m.end()
        return out + self.find(text[at:])

    def _learn_units(self, new: list) -> None:
        """Tokens of units not met before.  A unit is a string (with a space before it), ("head", string) or ("whole", pieces...)."""
        found, many, known = [], [], len(self.pieces)
        for u in new:
            got = self.split(" " + u) if isinstance(u, str) else self.split(u[1])
            found += got
            many.append(len(got))
        which = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        fresh = list(self.pieces)[known:]
        flat, length = self.t.encode_pieces([b"" if isinstance(p, tuple) else p.encode() for p in fresh])
        fixed = [k for k, p in enumerate(fresh) if isinstance(p, tuple)]
        if fixed:
            flat = np.insert(flat, (np.cumsum(length) - length)[fixed], [fresh[k][1] for k in fixed])
            length[fixed] = 1
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(length) - length))
        self.flat, self.length = np.concatenate((self.flat, flat)), np.concatenate((self.length, length))
        upto = np.concatenate(([0], np.cumsum(self.length[which])))
        ends = np.cumsum(np.array(many, np.int64))
        length = upto[ends] - upto[ends - np.array(many, np.int64)]
        self.unit_start = np.concatenate((self.unit_start, len(self.unit_flat) + np.cumsum(length) - length))
        self.unit_flat = np.concatenate((self.unit_flat, _take(self.flat, self.start[which], self.length[which])))
        self.unit_length = np.concatenate((self.unit_length, length))

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.units) > CACHE:
            self.clear()
        known, number = len(self.units), self.units.__getitem__
        which, whole = [], []
        for text in texts:
            if self.odd_space(text) or (self.special is not None and any(s in text for s in self.t.added)):
                whole.append(text)
                which.append(None)
                continue
            units = text.split(" ")
            units[0] = ("head", units[0])
            which.append(np.fromiter(map(number, units), np.int64, len(units)))
        new = list(self.units)[known:]
        self._learn_units([*new, *(("whole", x) for x in whole)])
        first, out = len(self.unit_length) - len(whole), []
        for w in which:
            if w is None:
                at = self.unit_start[first]
                out.append(self.unit_flat[at : at + self.unit_length[first]].copy())
                first += 1
            else:
                out.append(_take(self.unit_flat, self.unit_start[w], self.unit_length[w]))
        if whole:  # whole texts aren't kept
            keep = len(self.unit_length) - len(whole)
            self.unit_flat = self.unit_flat[: self.unit_start[keep]].copy()
            self.unit_start, self.unit_length = self.unit_start[:keep], self.unit_length[:keep]
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of about BLOCK_BYTES of text, with their texts."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)) if len(batch) else np.zeros(0)
        total, first = 0, 0
        for k in range(len(batch)):
            total += int(lengths[k])
            if total >= BLOCK_BYTES or k == len(batch) - 1:
                yield batch.slice(first, k + 1 - first), [x or "" for x in texts.slice(first, k + 1 - first).to_pylist()]
                total, first = 0, k + 1


def encode(docs: DataFrame, tokenizer: Tokenizer, keep: list[str]) -> DataFrame:
    """The columns of keep and ids, an array of ints."""
    kept = docs.select(*keep, "text")
    names = [f.name for f in kept.schema.fields][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  gives pa.compute

        coder = Encoder(tokenizer)
        for part, texts in _blocks(batches):
            ids = coder.block(texts)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], column], [*names, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, ids array<int>")


def decode(tokens: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """tokens (with a column ids) with the decoded text as a last column ``decoded``; null ids are an empty text."""
    fields = tokens.schema.fields
    at = [f.name for f in fields].index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum([0, *(x or 0 for x in batch.column(at).value_lengths().to_pylist())])
            flat = np.asarray(batch.column(at).flatten())
            first = 0
            while first < len(batch):  # at most BLOCK_IDS ids or one row at a time, so memory doesn't follow the size of a batch
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK_IDS, "right")) - 1)
                part = batch.slice(first, last - first)
                text = [tokenizer.decode(flat[ends[k] : ends[k + 1]]) for k in range(first, last)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [*batch.schema.names, "decoded"])
                first = last

    return tokens.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", decoded string")


def digests(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the text decoded from them; ids go from encoder to decoder inside a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        coder = Encoder(tokenizer)
        for part, texts in _blocks(batches):
            ids = coder.block(texts)
            columns = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                       pa.array([hashlib.sha256(tokenizer.decode(x).encode()).hexdigest() for x in ids])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_tokenizer() -> Tokenizer:
    import public_tokenizers

    return Tokenizer.load(public_tokenizers.path("byte_bpe_50k.json"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_tokenizer())
