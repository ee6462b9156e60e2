"""Operator 5, SentencePiece encoding and decoding with vectorised BPE merge rounds.

A text becomes units: a run of blank marks (U+2581, each blank and the dummy prefix) with the characters up to the
next one. No piece of the vocabulary spans two units, which ``Vocabulary`` checks, so each distinct unit of a chunk
is encoded once. Units are laid out flat as numpy symbol arrays and merged in rounds: the smallest pair rank of each
unit (a segmented minimum), all its leftmost non-overlapping occurrences at once, then compaction, until no pair of
any unit is a piece. A piece that another piece with as good a rank extends is merged once a round, at its leftmost
place, since the longer one may come next there; elsewhere merging at once gives what merging one by one gives.
Words are done after some twenty rounds. A unit that is not after ``ROUNDS`` (a long run of blanks or of letters without
a blank, whose merges chain from left to right) is finished from where it stands by a queue of its pairs, in time
n log n, as each further round could be one merge. Characters that are no piece end as their bytes' pieces.

Defined results: null is as empty, which has no ids and decodes to the empty text. Lone surrogates cannot occur in
Spark strings. Repeated rows get the same answer; an empty table gives an empty
result. Columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import append, give_back, table
from ._text import CHUNK, chunks

MARK = "▁"
SLOT_BITS = 21
#: Bytes of texts that are encoded together: more share more units, but each takes some 60 bytes in arrays meanwhile.
TEXT_BYTES = CHUNK // 2
#: Merge rounds over all units of a chunk.
ROUNDS = 64
_NEVER = np.int64(1 << 40)


class Vocabulary:
    """The pieces of a SentencePiece BPE model with byte fallback and no normalisation rules."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or not model.trainer_spec.byte_fallback or model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation rules")
        normal = {p.piece: (k, p.score) for k, p in enumerate(model.pieces) if p.type == 1}
        if any(p.type in (4, 5) for p in model.pieces) or any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("user-defined or unused pieces, or pieces that span units")
        ranks = {s: r for r, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == 6}
        self.chars = {p: k for p, (k, _) in normal.items() if len(p) == 1}
        #: Of each id, the bytes it decodes to.
        self.plain = [p.piece.replace(MARK, " ").encode() if p.type == 1 else b"" for p in model.pieces]
        for value, k in self.bytes.items():
            self.plain[k] = bytes([value])
        pairs, alone = tuple(array("q") for _ in range(3)), {k: True for _, (k, _) in normal.items()}
        for p, (k, s) in normal.items():
            for j in range(1, len(p)):
                if p[:j] in normal and p[j:] in normal:
                    left, right = normal[p[:j]][0], normal[p[j:]][0]
                    for column, value in zip(pairs, (left << 32 | right, ranks[s], k), strict=True):
                        column.append(value)
                    for part in (p[:j], p[j:]):
                        if ranks[normal[part][1]] >= ranks[s]:
                            alone[normal[part][0]] = False
        order = np.argsort(np.array(pairs[0], np.int64))  # pairs are distinct
        self.keys, self.ranks, self.made = (np.array(x, np.int64)[order] for x in pairs)
        self.at_once = np.zeros(len(model.pieces), bool)
        self.at_once[[k for k, ok in alone.items() if ok]] = True
        # a slot for each hashed pair; where several meet, the sorted keys are searched
        slots = self._slot(self.keys)
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.slots[slots] = np.arange(len(order))
        self.shared = np.zeros(1 << SLOT_BITS, bool)
        self.shared[slots[self.slots[slots] != np.arange(len(order))]] = True
        self.char_id = np.full(0x110000, -1, np.int32)
        for ch, k in self.chars.items():
            self.char_id[ord(ch)] = k
        self._table: dict[int, tuple[int, int]] = {}
        self.decimal = [str(k).encode() + b"," for k in range(len(model.pieces))]
        self.decimal_flat, self.plain_flat = _Flat(self.decimal), _Flat(self.plain)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id of the merged piece) of each pair of symbols; rank NEVER where they make no piece."""
        key = left << 32 | right
        slot = self._slot(key)
        at = self.slots[slot].astype(np.int64)
        found = self.keys[at] == key
        again = np.flatnonzero(~found & self.shared[slot])
        if len(again):
            other = np.minimum(np.searchsorted(self.keys, key[again]), len(self.keys) - 1)
            at[again] = other
            found[again] = self.keys[other] == key[again]
        found &= (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at], _NEVER), self.made[at]


    def finish(self, symbols: list[int]) -> list[int]:
        """One unit's symbols merged to the end: always the pair of the smallest rank, the leftmost of equal ones."""
        if not self._table:
            self._table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        known, n = self._table, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and symbols[i] >= 0 and symbols[j] >= 0:
                found = known.get(symbols[i] << 32 | symbols[j])
                if found:
                    heapq.heappush(queue, (found[0], i, symbols[i] << 32 | symbols[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, key, made = heapq.heappop(queue)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] < 0 or symbols[i] << 32 | symbols[j] != key:
                continue  # one of the two has merged since
            symbols[i], symbols[j], after[i] = made, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x in symbols if x is not None]


class _Flat:
    """Byte strings of ids side by side, to be gathered for many ids at once."""

    def __init__(self, parts: list[bytes]):
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(p) for p in parts])
        self.start = np.cumsum(self.size) - self.size

    def gather(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The joined strings of ids[at[k]:at[k + 1]] for each k."""
        n = self.size[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.data[np.arange(total[-1]) + np.repeat(self.start[ids] - total[:-1], n)].tobytes()
        ends = total[at].tolist()
        return [out[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]


def merge(v: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offset of each unit) by merge rounds over all units at once."""
    points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
    symbols = v.char_id[points].astype(np.int64)
    strange = symbols < 0  # characters without a piece stay below 0, which no pair has
    symbols[strange] = -1 - points[strange]
    owner = np.repeat(np.arange(len(units)), np.fromiter(map(len, units), np.int64, len(units)))
    n = len(symbols)
    rank, made = np.full(n, _NEVER), np.zeros(n, np.int64)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    rank[inner], made[inner] = v.pair(symbols[inner], symbols[inner + 1])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rounds = 0
    while len(symbols):
        if (rounds := rounds + 1) > ROUNDS:
            for unit, part in zip(*np.unique(owner, return_index=True), strict=True):
                left = np.array(v.finish(symbols[part : np.searchsorted(owner, unit, "right")].tolist()), np.int64)
                done.append((np.full(len(left), unit), left))
            break
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        least = np.minimum.reduceat(rank, starts)
        wide = np.repeat(least, np.diff(np.append(starts, len(owner))))
        over = wide == _NEVER
        if over.any():  # units without a pair leave
            done.append((owner[over], symbols[over]))
            stay = ~over
            symbols, owner, rank, made, wide = symbols[stay], owner[stay], rank[stay], made[stay], wide[stay]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == wide)
        unit = owner[hit]
        fresh = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (unit[1:] != unit[:-1])])
        run = np.flatnonzero(fresh)
        even = (np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0
        first = np.concatenate([[True], unit[1:] != unit[:-1]])
        # a unit any of whose hits makes a piece that may be extended at once takes its leftmost hit alone
        careful = np.zeros(len(units), bool)
        careful[unit[~v.at_once[made[hit]]]] = True
        hit = hit[even & (first | ~careful[unit])]
        symbols[hit] = made[hit]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
        # only pairs beside a merge change
        at = hit - np.arange(len(hit))
        at = np.concatenate([at, at - 1])  # some twice, which costs less than telling
        at = at[at >= 0]
        rank[at] = _NEVER
        at = at[at + 1 < len(symbols)]
        at = at[owner[at] == owner[at + 1]]
        rank[at], made[at] = v.pair(symbols[at], symbols[at + 1])
    if not done:
        return np.zeros(0, np.int64), np.zeros(len(units) + 1, np.int64)
    owner, symbols = (np.concatenate([d[k] for d in done]) for k in range(2))
    order = np.argsort(owner, kind="stable")
    owner, symbols = owner[order], symbols[order]
    odd = np.flatnonzero(symbols < 0)
    if len(odd):  # characters without a piece, as their bytes' pieces
        which, back = np.unique(symbols[odd], return_inverse=True)
        parts = [[v.bytes[x] for x in chr(-1 - int(c)).encode()] for c in which]
        size = np.ones(len(symbols), np.int64)
        size[odd] = np.array([len(p) for p in parts])[back]
        starts = np.cumsum(size) - size
        out = np.repeat(symbols, size)
        for k in range(4):
            has = np.array([len(p) > k for p in parts])[back]
            out[starts[odd[has]] + k] = np.array([p[k] if len(p) > k else 0 for p in parts])[back[has]]
        owner, symbols = np.repeat(owner, size), out
    return symbols, np.searchsorted(owner, np.arange(len(units) + 1))


class Codec:
    """Encoder and decoder over a vocabulary. Nothing is kept between calls but the vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    @staticmethod
    def units(text: str) -> list[str]:
        """The units of a text. A mark before another starts no unit of its own: runs stay whole."""
        if not text:
            return []
        parts = (MARK + text.replace(" ", MARK)).split(MARK)[1:]
        if "" not in parts:
            return [MARK + p for p in parts]
        out, run = [], ""
        for p in parts:
            run += MARK
            if p:
                out.append(run + p)
                run = ""
        if run:
            out.append(run)
        return out

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offset of each text); each distinct unit is merged once."""
        index: dict[str, int] = {}
        use, sizes = [], []
        for t in texts:
            units = self.units(t)
            sizes.append(len(units))
            use += [index.setdefault(u, len(index)) for u in units]
        ids, at = merge(self.v, list(index))
        use = np.array(use, np.int64)
        n = np.diff(at)[use] if len(use) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.arange(total[-1]) + np.repeat(at[use] - total[:-1], n)] if len(use) else ids[:0]
        return out, total[np.concatenate([[0], np.cumsum(sizes)])]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def plain(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The decoded bytes of each text: pieces joined, marks as blanks, without the dummy prefix."""
        return [p[1:] if p[:1] == b" " else p for p in self.v.plain_flat.gather(ids, at)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; broken byte runs as U+FFFD."""
        return self.plain(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """One per process and model."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(Vocabulary(model_file))
        give_back()  # the model's messages
    return _codecs[model_file]


def tokenize(docs: DataFrame, model_file: str, text: str = "text", ids: bool = True, drop: tuple = ()) -> DataFrame:
    """docs with ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256`` and, if asked for, ``ids``.

    One narrow pass. The model file must be at that path on every executor, as an installed package has it.
    """

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        c = codec(model_file)
        n, encoded, decoded, lists = [], [], [], []
        for part in chunks(b.column(text), TEXT_BYTES):
            found, at = c.encode_all([t or "" for t in b.column(text).slice(part.lo, part.hi - part.lo).to_pylist()])
            n += np.diff(at).tolist()
            encoded += [hashlib.sha256(x[:-1]).hexdigest() for x in c.v.decimal_flat.gather(found, at)]
            decoded += [hashlib.sha256(x).hexdigest() for x in c.plain(found, at)]
            if ids:
                lists.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found, pa.int32())))
        return [pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())] + ([pa.concat_arrays(lists)] if ids else [])

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return append(docs, make, fields + ([("ids", T.ArrayType(T.IntegerType()))] if ids else []), drop)


def decode(df: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """df with ``decoded``, the text of its ids; null ids are as none."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        c = codec(model_file)
        return [pa.array([c.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())]

    return append(df, make, [("decoded", T.StringType())])


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenize(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=False, drop=("text",))
