"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often corpus-wide.

A text is cut into units at spaces behind other characters, where neither tokenizer has a token across. Each distinct unit
of a task is encoded and aligned once; a document's links are the links of its units.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import cut_lineage, table

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Characters aligned together, links and characters of units that a task remembers: all bound a task's memory.
STEP_CHARS, MOST_LINKS, MOST_CHARS = 500_000, 2_000_000, 8_000_000
#: Irregular pairs whose counts are sent to the tasks at most: those with the most documents.
HOT_PAIRS = 100_000

#: Neither tokenizer has a token with a space behind another character.
_CUT = re.compile(r"(?<=\S)(?= )")
_ODD_SPACE = re.compile(r"\s ")


def units_of(text: str) -> list[str]:
    """Parts of a space and the text, each with a space in front."""
    s = " " + text
    if s[-1] != " " and not _ODD_SPACE.search(s):
        return [" " + x for x in text.split(" ")]
    return _CUT.split(s)


@dataclass(frozen=True)
class Tokenizers:
    """The files' contents; only these travel to the tasks (about 2 MB)."""

    a: str
    b: bytes


def load(a: str = A_FILE, b: str = B_FILE) -> Tokenizers:
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        return Tokenizers(f.read(), g.read())


def _byte_of_char() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def surfaces(t: Tokenizers):
    """(tokenizer A, its bytes per id, tokenizer B, its bytes per id, for each A id the B id of the same bytes or -1)."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_str(t.a)
    ta.encode_special_tokens = True
    to_byte = _byte_of_char()
    a_bytes = [b""] * ta.get_vocab_size(with_added_tokens=True)
    for token, i in ta.get_vocab(with_added_tokens=False).items():
        a_bytes[i] = bytes(map(to_byte.__getitem__, token))
    tb = sentencepiece.SentencePieceProcessor(model_proto=t.b)
    b_bytes, by_bytes = [b""] * tb.get_piece_size(), {}
    for byte_piece in (True, False):
        for i in range(tb.get_piece_size()):
            if tb.is_byte(i) == byte_piece and not (tb.is_control(i) or tb.is_unknown(i) or tb.is_unused(i)):
                p = tb.id_to_piece(i)
                b_bytes[i] = bytes([int(p[3:5], 16)]) if byte_piece else p.replace("▁", " ").encode()
                by_bytes[b_bytes[i]] = i
    same = np.array([by_bytes.get(x, -1) if x else -1 for x in a_bytes], np.int64)
    return ta, a_bytes, tb, b_bytes, same


def _ragged(parts: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.fromiter((x for p in parts for x in p), np.int64, int(size.sum()))
    return flat, size


class Aligner:
    """Aligned units of one task, each worked out once."""

    def __init__(self, t: Tokenizers):
        self.ta, self.a_bytes, self.tb, self.b_bytes, self.same = surfaces(t)
        self.va, self.vb = len(self.a_bytes), len(self.b_bytes)
        self.a_len = np.fromiter(map(len, self.a_bytes), np.int64, self.va)
        self.b_len = np.fromiter(map(len, self.b_bytes), np.int64, self.vb)
        self.space = [self.tb.piece_to_id("▁")]
        names = [f"{i}{end}" for ends, n in ((",|", self.va), (",;", self.vb)) for end in ends for i in range(n)]
        self.names = np.array(names, object)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        #: Per unit: tokens of A, of B, groups, links, first link, 1 where both tokenizers restore its bytes.
        self.facts = np.zeros((0, 6), np.int64)
        self.links = np.zeros(0, np.int64)

    def add(self, units: list[str]) -> np.ndarray:
        """Numbers of the units."""
        if len(self.links) > MOST_LINKS or self.chars > MOST_CHARS:
            self._clear()
        new = [u for u in dict.fromkeys(units) if u not in self.index]
        if new:
            self.index.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
            self.chars += sum(map(len, new))
            self._align(new)
        return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.ta.encode_batch(units, add_special_tokens=False)]
        b = self.tb.encode([u[1:] for u in units], num_threads=1)
        return a, [self.space if u == " " else x for u, x in zip(units, b, strict=True)]

    def _align(self, units: list[str]) -> None:
        a, b = self.encode(units)
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        ok = np.array(
            [b"".join(map(self.a_bytes.__getitem__, x)) == r and b"".join(map(self.b_bytes.__getitem__, y)) == r for x, y, r in zip(a, b, raw, strict=True)], bool
        )
        ids_a, n_a = _ragged([x if k else () for x, k in zip(a, ok, strict=True)])
        ids_b, n_b = _ragged([y if k else () for y, k in zip(b, ok, strict=True)])
        end_a, end_b = np.cumsum(self.a_len[ids_a]), np.cumsum(self.b_len[ids_b])
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        #: Between two neighbouring ends of either kind lies the overlap of exactly one pair of tokens.
        ends = np.union1d(end_a, end_b)
        links = ids_a[np.searchsorted(end_a, ends)] * self.vb + ids_b[np.searchsorted(end_b, ends)]
        unit_end = np.cumsum(np.where(ok, [len(r) for r in raw], 0))
        per = lambda x: np.diff(np.searchsorted(x, unit_end, side="right"), prepend=0)
        n_groups, n_links = per(shared), per(ends)
        first = len(self.links) + np.cumsum(n_links) - n_links

        size_a, size_b = np.bincount(group_a, minlength=len(shared)), np.bincount(group_b, minlength=len(shared))
        upto_a, upto_b = np.cumsum(size_a), np.cumsum(size_b)
        at_a, at_b = np.arange(len(ids_a)), np.arange(len(ids_b))
        order = np.zeros(len(ids_a) + len(ids_b), np.int64)
        order[at_a + (upto_b - size_b)[group_a]] = ids_a + self.va * (at_a + 1 == upto_a[group_a])
        order[at_b + upto_a[group_b]] = 2 * self.va + ids_b + self.vb * (at_b + 1 == upto_b[group_b])
        names = self.names[order].tolist()
        stop = np.cumsum(n_a + n_b).tolist()
        self.groups += ["".join(names[i:j]) for i, j in zip([0, *stop[:-1]], stop, strict=True)]
        self.links = np.concatenate([self.links, links])
        self.facts = np.concatenate([self.facts, np.stack([n_a, n_b, n_groups, n_links, first, ok], axis=1)])

    def documents(self, texts: list[str]) -> dict[str, pa.Array]:
        """Columns for some texts; those with a unit that a tokenizer does not restore have no tokens."""
        split = [units_of(t) if t else [] for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        unit = self.add([u for s in split for u in s])
        doc = np.repeat(np.arange(len(texts)), size)
        facts = self.facts[unit]
        good = np.ones(len(texts), bool)
        good[doc[facts[:, 5] == 0]] = False
        facts[~good[doc], :4] = 0
        sums = np.zeros((len(texts), 4), np.int64)
        np.add.at(sums, doc, facts[:, :4])
        number = unit.tolist()
        stop = np.cumsum(size).tolist()
        digest = []
        for i, j, k in zip([0, *stop[:-1]], stop, good, strict=True):
            digest.append(hashlib.sha256("".join(map(self.groups.__getitem__, number[i:j]))[:-1].encode()).hexdigest() if k and j > i else "")
        n = facts[:, 3]
        at = np.repeat(facts[:, 4] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        span = self.va * self.vb
        key, times = np.unique(np.repeat(doc, n) * span + self.links[at], return_counts=True)
        doc, key = key // span, key % span
        regular = self.same[key // self.vb] == key % self.vb

        def lists(values: np.ndarray, rows: np.ndarray, kind: pa.DataType) -> pa.Array:
            offsets = np.searchsorted(doc[rows], np.arange(len(texts) + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[rows], kind))

        return {
            "n_a": pa.array(sums[:, 0]), "n_b": pa.array(sums[:, 1]), "n_groups": pa.array(sums[:, 2]), "n_links": pa.array(sums[:, 3]),
            "groups_sha256": pa.array(digest, pa.string()),
            "same_a": lists(key // self.vb, regular, pa.int32()), "same_n": lists(times, regular, pa.int32()),
            "odd_pair": lists(key, ~regular, pa.int64()), "odd_n": lists(times, ~regular, pa.int32()),
        }


_OWN = "_row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same_a array<int>, same_n array<int>, odd_pair array<long>, odd_n array<int>"


def align(docs: DataFrame, tokenizers: Tokenizers, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep`` and counts, the digest of its groups, and its distinct linked id pairs.

    ``same_a``/``same_n``: A ids linked with the B id of the same bytes, and how often; ``odd_pair``/``odd_n``: all other
    pairs as a * (size of B) + b. NULL and empty texts, and texts that either tokenizer does not give back byte by byte,
    have no tokens. Repeated rows are documents of their own, named by ``_row``. Only ``keep`` is read beside the text,
    so other columns may have any name. Work and memory of a text grow with its length; nothing is cut off.
    """
    keep = [c for c in keep if c not in T._parse_datatype_string(_OWN).fieldNames()]
    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner, row = None, TaskContext.get().partitionId() << 40
        for b in batches:
            aligner = aligner or Aligner(tokenizers)
            sizes = np.asarray(pc.fill_null(pc.utf8_length(b.column(0)), 0), np.int64)
            start = 0
            while start < b.num_rows:
                stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), STEP_CHARS, side="right")))
                part = b.slice(start, stop - start)
                cols = aligner.documents([t or "" for t in part.column(0).to_pylist()])
                rows = pa.array(np.arange(row, row + part.num_rows))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], rows, *cols.values()], [*keep, "_row", *cols])
                start, row = stop, row + part.num_rows

    return docs.select(F.col(text).alias("_text"), *keep).mapInArrow(run, T.StructType([*fields, *T._parse_datatype_string(_OWN).fields]))


def same_counts(aligned: DataFrame, size: int) -> np.ndarray:
    """Documents per A id that link it with the B id of the same bytes: a vector per task, added up; ``size`` numbers reach
    the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.asarray(b.column(0).flatten()), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["a", "n"])

    found = aligned.select("same_a").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    return _vector(found, size)


def _vector(found: pa.Table, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    out[found["a"].to_numpy()] = found["n"].to_numpy()
    return out


def odd_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: documents of each irregular pair; added up before the shuffle, so a pair of all documents costs a row a task."""
    return aligned.select(F.explode("odd_pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


@dataclass
class Alignment:
    documents: DataFrame
    odd: DataFrame
    same: np.ndarray
    best: np.ndarray
    size_b: int
    partner: np.ndarray

    def pairs(self) -> DataFrame:
        """a, b, n: every linked id pair with its number of documents: the translation table of the two vocabularies."""
        spark = self.documents.sparkSession
        some = np.flatnonzero(self.same)
        regular = spark.createDataFrame(pa.table({"a": some, "b": self.partner[some], "n": self.same[some]}), "a long, b long, n long")
        size = F.lit(self.size_b)
        odd = self.odd.select(F.floor(F.col("pair") / size).cast("long").alias("a"), (F.col("pair") % size).cast("long").alias("b"), "n")
        return regular.unionByName(odd)


def corpus_alignment(docs: DataFrame, tokenizers: Tokenizers, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> Alignment:
    """Aligned documents and corpus-wide counts. Documents are encoded once; the aligned rows are written and read again."""
    _, a_bytes, _, b_bytes, partner = surfaces(tokenizers)
    documents = cut_lineage(align(docs, tokenizers, text, keep))
    same = same_counts(documents, len(a_bytes))
    odd = cut_lineage(odd_counts(documents))
    top = odd.groupBy(F.floor(F.col("pair") / F.lit(len(b_bytes))).cast("long").alias("a")).agg(F.max("n").alias("n")).toArrow()
    return Alignment(documents, odd, same, np.maximum(same, _vector(top, len(a_bytes))), len(b_bytes), partner)


def link_counts(x: Alignment, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The aligned documents with ``n_best`` (links whose count is the highest of their A id) and ``count_sum``.

    Regular links are looked up in vocabulary-length vectors. Of the irregular pairs the most frequent are sent to the
    tasks: with R pair rows, fewer than ``hot_pairs`` + 1 pairs can have R / ``hot_pairs`` documents or more. All others
    meet their counts in a join, whose most frequent key has fewer than that share of all rows.
    """
    size = F.lit(x.size_b)
    rows = x.odd.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(2, -(-rows // hot_pairs))
    hot = x.odd.where(F.col("n") >= limit).orderBy("pair").toArrow()
    hot_pair, hot_n = hot["pair"].to_numpy(), hot["n"].to_numpy()
    same, best, size_b = x.same, x.best, x.size_b
    sums = "n_best long, count_sum long, cold_pair array<long>, cold_n array<int>"
    kept = [f for f in x.documents.schema.fields if f.name not in ("same_a", "same_n", "odd_pair", "odd_n")]
    names = [f.name for f in kept]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, top = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)

            def count(lists: pa.Array, times: pa.Array, of):
                doc = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(lists)))
                n, (c, is_best) = np.asarray(times.flatten()).astype(np.int64), of(np.asarray(lists.flatten()).astype(np.int64))
                np.add.at(total, doc, n * c)
                np.add.at(top, doc, n * is_best)
                return doc, n, c

            def warm(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                if not len(hot_pair):
                    return np.zeros(len(p), np.int64), np.zeros(len(p), bool)
                at = np.minimum(np.searchsorted(hot_pair, p), len(hot_pair) - 1)
                c = np.where(hot_pair[at] == p, hot_n[at], 0)
                return c, (c > 0) & (c == best[p // size_b])

            count(b.column("same_a"), b.column("same_n"), lambda a: (same[a], same[a] == best[a]))
            doc, n, c = count(b.column("odd_pair"), b.column("odd_n"), warm)
            cold = c == 0
            offsets = pa.array(np.searchsorted(doc[cold], np.arange(b.num_rows + 1)).astype(np.int32))
            pair = np.asarray(b.column("odd_pair").flatten())[cold]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, kind)) for v, kind in ((pair, pa.int64()), (n[cold], pa.int32()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(top), pa.array(total), *lists], [*names, "n_best", "count_sum", "cold_pair", "cold_n"])

    seen = x.documents.mapInArrow(look_up, T.StructType([*kept, *T._parse_datatype_string(sums).fields]))
    cold = seen.select("_row", F.explode(F.arrays_zip("cold_pair", "cold_n")).alias("c")).select("_row", F.col("c.cold_pair").alias("pair"), F.col("c.cold_n").alias("times"))
    rare = x.odd.where(F.col("n") < limit)
    top = x.documents.sparkSession.createDataFrame(pa.table({"_a": np.arange(len(best)), "_best": best}), "_a long, _best long")
    rare = rare.withColumn("_a", F.floor(F.col("pair") / size).cast("long")).join(top, "_a").select("pair", "n", (F.col("n") == F.col("_best")).alias("is_best"))
    late = cold.join(rare, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("n")).cast("long").alias("count_sum")
    )
    whole = [c for c in names if c != "_row"]
    first = seen.select("_row", F.struct(*whole).alias("_doc"), "n_best", "count_sum")
    both = first.unionByName(late.withColumn("_doc", F.lit(None).cast(first.schema["_doc"].dataType)))
    out = both.groupBy("_row").agg(F.first("_doc", ignorenulls=True).alias("_doc"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select(*[F.col("_doc")[c].alias(c) for c in whole], "n_best", "count_sum")


def op11_align(spark: SparkSession, folder: str) -> DataFrame:
    out = link_counts(corpus_alignment(table(spark, folder, "documents").select("doc_id", "text"), load()))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
