"""SentencePiece encoding by sampling: forward filtering and backward sampling over the piece lattice, and lossless decoding."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, ALPHA = 20_240_604, 1.0
#: Characters that one step works on, and lattice nodes that are remembered; both bound a task's memory.
STEP_CHARS, MOST_NODES = 700_000, 1_200_000
#: Units up to this length are filtered GROUP at a time with plain weights, longer ones with logarithms.
PLAIN, GROUP = 64, 4096

_G1, _P0 = 0x9E3779B97F4A7C15, 0x9E6C63D0876A9A63
_P = np.uint64(_P0)
_G2, _M1, _M2 = (np.uint64(x) for x in (0xD1B54A32D192ED03, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with a space in place of the model's mark, their ids and log weights, and the ids of the 256 byte pieces."""

    ids: dict[str, int]
    logs: dict[str, float]
    byte_ids: tuple[int, ...]
    byte_log: float
    surface: tuple[bytes, ...]
    longest: int


def load(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    """Read on the driver; only the pieces travel to the tasks. Merge ranks become weights 1 / (rank + 1), scores of a
    unigram model are used as they are; ``alpha`` sharpens (above 1) or flattens the distribution."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    pieces = {sp.id_to_piece(i).replace("▁", " "): i for i in plain}
    scores = {p: sp.get_score(i) for p, i in pieces.items()}
    ranks = min(scores.values()) <= -100 and all(s == int(s) for s in scores.values())
    logs = {p: alpha * (-math.log1p(-s) if ranks else s) for p, s in scores.items()}
    bytes_ = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    surface = [b""] * n
    for p, i in pieces.items():
        surface[i] = p.encode()
    for b, i in enumerate(bytes_):
        surface[i] = bytes([b])
    inner = [p for p in pieces if " " in p.lstrip(" ") or ("\n" in p and len(p) > 1)]
    if inner:
        raise ValueError(f"pieces cross words: {inner[:3]}")
    return Vocabulary(pieces, logs, bytes_, min(logs.values()) - alpha * math.log(10), tuple(surface), max(map(len, pieces)))


#: No piece has a space behind another character or a line feed beside one, so every lattice is a chain of such units.
_UNIT = re.compile(r" *[^ \n]+|\n| +")


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * _P0 + ord(c)) & ((1 << 64) - 1)
    return h


class Lattices:
    """Lattices of distinct units, filtered once: all nodes of all units in one array of cumulative edge probabilities."""

    def __init__(self, v: Vocabulary):
        self.v = v
        pieces = list(v.logs)
        self.byte_ids = np.array(v.byte_ids, np.int64)
        self.ids = np.array([v.ids[p] for p in pieces], np.int32)
        #: 32 to the length is the same for all segmentations of a unit and keeps products near one.
        self.by_place = np.array([math.exp(x) * 32.0 ** len(p) for p, x in v.logs.items()])
        self.hashes = np.array([_hash(p) for p in pieces], np.uint64)
        slot = ((self.hashes * _M1) >> np.uint64(44)).astype(np.int64)
        self.slots = np.zeros(1 << 20, np.int32)
        self.slots[slot] = np.arange(len(pieces))
        self.crowd = np.bincount(slot, minlength=1 << 20) > 1
        self.order = np.argsort(self.hashes)
        self.sorted_hashes = self.hashes[self.order]
        self._clear()

    def _clear(self):
        self.index: dict[str, int] = {}
        self.first: list[int] = []
        self.last: list[int] = []
        self.nodes = 0
        #: Per edge its cumulative probability within its end node, its length and its piece; per node its number of edges.
        self.edges = [np.zeros(0, np.float32), np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.uint8)]
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.edge = np.zeros(0, np.int32)

    def add(self, units: list[str]) -> np.ndarray:
        """Numbers of the units; forward filtering for those that are new."""
        if self.nodes > MOST_NODES:
            self._clear()
        known = self.index
        new = [u for u in dict.fromkeys(units) if u not in known]
        by_length: dict[int, list[str]] = {}
        for u in new:
            by_length.setdefault(len(u), []).append(u)
        for n, group in by_length.items():
            for i in range(0, len(group), GROUP):
                part = group[i : i + GROUP]
                known.update(zip(part, range(len(self.first), len(self.first) + len(part)), strict=True))
                if n <= PLAIN:
                    self._filter_group(part, n)
                else:
                    for u in part:
                        self._filter(u)
        if self.new:
            self.edges = [np.concatenate([a, *b]) for a, b in zip(self.edges, zip(*self.new, strict=True), strict=True)]
            self.new = []
            self.edge = np.cumsum(self.edges[3], dtype=np.int32) - self.edges[3]
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def _filter_group(self, units: list[str], n: int) -> None:
        """Forward filtering of units of one length: one pass over the positions for all of them."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        longest, rows = min(n, self.v.longest), len(units)
        weight = np.zeros((rows, n + 1, longest + 1))
        piece = np.zeros((rows, n + 1, longest + 1), np.int32)
        h = np.zeros((rows, n), np.uint64)
        for k in range(1, longest + 1):
            h = h[:, : n - k + 1] * _P + codes[:, k - 1 :]
            found = self.lookup(h)
            piece[:, k:, k] = np.where(found >= 0, self.ids[found], 0)
            weight[:, k:, k] = np.where(found >= 0, self.by_place[found], 0.0)
        #: A character without a piece of its own is spelled in bytes; -1 - c stands for it if there are several.
        spelled = weight[:, 1:, 1] == 0
        long = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        weight[:, 1:, 1] = np.where(spelled, 32.0 * np.exp(self.v.byte_log * long), weight[:, 1:, 1])
        one = self.byte_ids[np.minimum(codes, 0x7F)]
        piece[:, 1:, 1] = np.where(spelled, np.where(long == 1, one, -1 - codes.astype(np.int64)), piece[:, 1:, 1])
        f = np.ones((rows, n + 1))
        for j in range(1, n + 1):
            m = min(j, longest)
            weight[:, j, 1 : m + 1] *= f[:, j - m : j][:, ::-1]
            f[:, j] = weight[:, j].sum(axis=1)
            if j % 8 == 0:
                #: Only ratios of neighbouring values matter, so they are brought back to the range of floats.
                f[:, max(0, j - longest) : j + 1] /= f[:, j : j + 1]
        #: Long pieces first: they are the likelier ones.
        weight, piece = weight[:, 1:, :0:-1], piece[:, 1:, :0:-1]
        cum = np.cumsum(weight, axis=2)
        base = self.nodes + (n + 1) * np.arange(rows)
        some = weight > 0
        back = np.broadcast_to(np.arange(longest, 0, -1, dtype=np.uint8), some.shape)
        number = np.zeros((rows, n + 1), np.uint8)
        number[:, 1:] = some.sum(axis=2)
        self.new.append(((cum / cum[:, :, -1:])[some].astype(np.float32), back[some], piece[some], number.ravel()))
        self.first += base.tolist()
        self.last += (base + n).tolist()
        self.nodes += rows * (n + 1)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the pieces, -1 for none."""
        slot = ((h * _M1) >> np.uint64(44)).astype(np.int64)
        at = self.slots[slot]
        out = np.where(self.hashes[at] == h, at, -1)
        #: Slots that several pieces share are searched by hash.
        r, c = np.nonzero(self.crowd[slot] & (out < 0))
        if len(r):
            at = np.minimum(np.searchsorted(self.sorted_hashes, h[r, c]), len(self.order) - 1)
            out[r, c] = np.where(self.sorted_hashes[at] == h[r, c], self.order[at], -1)
        return out

    def _filter(self, u: str) -> None:
        """Forward filtering of one long unit, with logarithms."""
        n, base = len(u), self.nodes
        cum, back, piece, number = [], [], [], [0]
        ids, longest, logs = self.v.ids, self.v.longest, self.v.logs
        f = [0.0] * (n + 1)
        for j in range(1, n + 1):
            found = [(i, f[i] + logs[u[i:j]], ids[u[i:j]]) for i in range(max(0, j - longest), j) if u[i:j] in logs]
            if u[j - 1] not in ids:
                c = ord(u[j - 1])
                found.append((j - 1, f[j - 1] + self.v.byte_log * len(u[j - 1].encode("utf-8", "surrogatepass")), self.v.byte_ids[c] if c < 0x80 else -1 - c))
            top = max(x for _, x, _ in found)
            part = np.cumsum([math.exp(x - top) for _, x, _ in found])
            f[j] = top + math.log(part[-1])
            cum += (part / part[-1]).tolist()
            number.append(len(found))
            back += [j - i for i, _, _ in found]
            piece += [p for _, _, p in found]
        self.new.append((np.array(cum, np.float32), np.array(back, np.uint8), np.array(piece, np.int32), np.array(number, np.uint8)))
        self.first.append(base)
        self.last.append(base + n)
        self.nodes = base + n + 1

    def sample(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling for all units at once: (pieces in text order, pieces per unit). ``key`` seeds each unit."""
        start, at = np.array(self.first, np.int64)[unit], np.array(self.last, np.int64)[unit]
        cum, back, piece, _ = self.edges
        open_ = np.arange(len(unit))
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(unit), np.int64)
        step = 0
        while len(open_):
            u = uniform(key[open_], step)
            e = self.edge[at[open_]]
            on = np.flatnonzero(cum[e] <= u)
            while len(on):
                e[on] += 1
                on = on[cum[e[on]] <= u[on]]
            taken.append((open_, piece[e]))
            count[open_] += 1
            at[open_] -= back[e]
            open_ = open_[at[open_] > start[open_]]
            step += 1
        end = np.cumsum(count)
        out = np.zeros(int(end[-1]) if len(end) else 0, np.int64)
        for k, (rows, p) in enumerate(taken):
            out[end[rows] - 1 - k] = p
        return out, count


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on key and step only."""
    x = key + np.uint64(_G1 * (step + 1) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sample_batch(lattices: Lattices, keys: list[str], texts: list[str], seed: int) -> list[np.ndarray]:
    """Sampled ids of each text. A space is put in front, as the model expects; its key and the place seed each unit."""
    units, sizes = [], []
    for t in texts:
        u = _UNIT.findall(" " + t) if t else []
        units += u
        sizes.append(len(u))
    unit = lattices.add(units)
    row = np.fromiter((xxhash.xxh3_64_intdigest(k.encode(), seed) for k in keys), np.uint64, len(keys))
    size = np.array(sizes, np.int64)
    place = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
    pieces, count = lattices.sample(unit, np.repeat(row, size) ^ (place.astype(np.uint64) * _G2))
    per = np.zeros(len(texts), np.int64)
    np.add.at(per, np.repeat(np.arange(len(texts)), size), count)
    out = np.split(pieces, np.cumsum(per)[:-1]) if len(texts) else []
    return [_spelled(x, lattices.v) if (x < 0).any() else x.astype(np.int32) for x in out]


def _spelled(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    flat: list[int] = []
    for i in ids.tolist():
        flat += [i] if i >= 0 else [v.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
    return np.array(flat, np.int32)


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of a sequence of ids: bytes of its pieces, without the space put in front."""
    return b"".join(map(v.surface.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", seed: int = SEED) -> DataFrame:
    """``docs`` with ``piece_ids`` (a sampled segmentation) and ``decoded`` (its text again). Columns so named are replaced.

    A segmentation is drawn with the probability that its pieces' weights give it among all segmentations of the
    whole text, seeded by the doc_id (NULL is a key too): reruns and repeated rows agree, whatever the partitioning.
    Characters without a piece are spelled in bytes, so decoding restores every text exactly. NULL texts stay NULL,
    empty ones have no pieces. Texts are cut at word ends, where no piece crosses, so very long ones need little memory.
    """
    own = [c for c in docs.columns if c not in ("piece_ids", "decoded")]
    at, key = own.index(text), own.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(vocabulary)
        for b in batches:
            sizes = np.asarray(pc.fill_null(pc.utf8_length(b.column(at)), 0), np.int64)
            start = 0
            while start < b.num_rows:
                stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), STEP_CHARS, side="right")))
                part = b.slice(start, stop - start)
                start = stop
                texts = part.column(at).to_pylist()
                ids = sample_batch(lattices, [str(k) for k in part.column(key).to_pylist()], [t or "" for t in texts], seed)
                back = [None if t is None else decode(x, vocabulary) for t, x in zip(texts, ids, strict=True)]
                ids_ = pa.array([None if t is None else x for t, x in zip(texts, ids, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids_, pa.array(back, pa.string())], [*own, "piece_ids", "decoded"])

    fields = [T.StructField(f.name, f.dataType, True) for f in docs.select(*own).schema.fields]
    return docs.select(*own).mapInArrow(run, T.StructType([*fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))


def op1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    out = encode_and_decode(table(spark, folder, "documents").select("doc_id", "text"), load())
    return digest(out)


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("pieces_hash"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
