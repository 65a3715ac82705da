"""Periodic runs of words, found through string synchronising sets.

At scale s (a power of two) a set of positions is chosen by hashes of s-word contexts: a position belongs to it when the
least hash among the next s + 1 positions is at its first or last one. Equal contexts of 2s words thus choose alike, and every
stretch of s positions outside highly periodic regions holds one. A run of period s to 2s - 1 that spans four periods has
two chosen positions one period apart with equal contexts, and no nearer pair of equal contexts; so each chosen position and
the next one of the same context propose a period, which is then checked word by word. Positions whose s words repeat with a
period of at most s / 4 are left out: the runs of those periods are known from the smaller scales, and periods below FIRST
from comparing words with their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import WORD, table

#: Periods below FIRST are found by direct comparison; FIRST is the smallest scale.
FIRST = 4
LEAST, POWER = 6, 4
#: Characters whose documents are searched together; a longer document is searched alone, and whole.
STEP_CHARS = 2_000_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _reach(w: np.ndarray, i: int, p: int, step: int) -> int:
    """First place from i on, going by ``step``, whose word differs from the one p words further (or the border)."""
    size, n = 64, len(w) - p
    while 0 <= i < n:
        if step > 0:
            j = min(n, i + size)
            differ = w[i:j] != w[i + p : j + p]
        else:
            j = max(-1, i - size)
            differ = (w[j + 1 : i + 1] != w[j + 1 + p : i + 1 + p])[::-1]
        if differ.any():
            return i + step * int(np.argmax(differ))
        i, size = j, size * 4
    return i


def _synchronising(h: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """Positions of the set at ``scale``; ``h`` are hashes of contexts of that many words, ``periodic`` positions left out."""
    if len(h) <= scale:
        return np.zeros(0, np.int64)
    rank = np.where(periodic, _NONE, h)
    least, width = rank, 1
    while width < scale:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: len(rank) - scale], rank[scale:])
    first, last = rank[: len(least)], rank[scale:]
    return np.flatnonzero((least != _NONE) & ((first == least) | (last == least)))


def find_runs(words: np.ndarray, sizes: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, period) of all maximal runs of at least POWER periods.

    ``words`` are numbers, equal where the words are. ``sizes``: lengths of several texts, longest first, each followed by
    a number that occurs once; texts too short for a scale are passed over.
    """
    sizes = sizes or [len(words)]
    most = sizes[0] // POWER
    stop = np.cumsum(np.array(sizes) + 1)
    runs: list[tuple[int, int, int]] = []
    for p in range(1, min(FIRST, most + 1)):
        start, end = _stretches(words[:-p] == words[p:])
        enough = end + p - start >= POWER * p
        for s, e in zip(start[enough].tolist(), (end[enough] + p).tolist(), strict=True):
            # a stretch of four periods with a smaller period repeats with a divisor of it
            if not any(p % q == 0 and np.array_equal(words[s : s + p - q], words[s + q : s + p]) for q in range(1, p)):
                runs.append((s, e, p))
    h, width = _mix((words.astype(np.uint64) + np.uint64(1)) * _M1), 1
    while width < FIRST:
        h, width = _mix(h[: len(h) - width] * _M1 + (h[width:] ^ (h[width:] >> np.uint64(29)))), width * 2
    scale = FIRST
    while scale <= most:
        words = words[: stop[np.searchsorted(-np.array(sizes), -POWER * scale, side="right") - 1]]
        h = h[: max(0, len(words) - scale + 1)]
        double = _mix(h[: len(h) - scale] * _M1 + (h[scale:] ^ (h[scale:] >> np.uint64(29)))) if len(h) > scale else h[:0]
        periodic = np.zeros(len(h), bool)
        for s, e, q in runs:
            if POWER * q <= scale <= e - s:
                periodic[s : e - scale + 1] = True
        chosen = _synchronising(h, scale, periodic)
        chosen = chosen[chosen < len(double)]
        order = np.argsort(double[chosen], kind="stable")
        at, context = chosen[order], double[chosen][order]
        gap = np.diff(at)
        near = (context[1:] == context[:-1]) & (gap >= scale) & (gap < 2 * scale)
        proposed = sorted(zip(gap[near].tolist(), at[:-1][near].tolist(), strict=True))
        known = (0, -1)
        for p, i in proposed:
            if known[0] == p and i < known[1]:
                continue
            if words[i] != words[i + p]:
                continue
            e = _reach(words, i, p, 1)
            known = (p, e)
            s = _reach(words, i, p, -1) + 1
            if e + p - s >= POWER * p:
                runs.append((s, e + p, p))
        h, scale = double, scale * 2
    return runs


def documents(texts: list[str]) -> dict[str, list]:
    """Result columns of some texts."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    number: dict[bytes, int] = {}
    ids = [[number.setdefault(w, len(number)) for w in s] for s in split]
    order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
    order = [i for i in order if len(ids[i]) >= LEAST]
    starts, flat = [], []
    for k, i in enumerate(order):
        starts.append(len(flat))
        flat += ids[i]
        flat.append(len(number) + k)
    per: dict[int, list[tuple[int, int, int]]] = {}
    if flat:
        found = find_runs(np.array(flat, np.int64), [len(ids[i]) for i in order])
        owner = np.searchsorted(np.array(starts), [s for s, _, _ in found], side="right") - 1
        for (s, e, p), k in zip(found, owner.tolist(), strict=True):
            if e - s >= LEAST:
                per.setdefault(order[k], []).append((s - starts[k], e - starts[k], p))
    out: dict[str, list] = {c: [] for c in ("n_words", "runs", "kept")}
    for i, s in enumerate(split):
        runs = sorted(per.get(i, []), key=lambda r: (r[0], r[2]))
        if runs:
            drop = np.zeros(len(s), bool)
            for a, e, p in runs:
                drop[a + p : e] = True
            s = [w for w, d in zip(s, drop.tolist(), strict=True) if not d]
        out["n_words"].append(len(split[i]))
        out["runs"].append([{"start": a, "length": e - a, "period": p} for a, e, p in runs])
        out["kept"].append(b" ".join(s).decode("utf-8", "surrogatepass"))
    return out


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of start, length, period, by start and period) and ``collapsed``.

    A run is a stretch of words with smallest period q, at least max(6, 4 q) words long, that no neighbouring word extends;
    ``collapsed`` are the words outside the repetitions, joined by spaces. NULL, empty and blank texts have no words, no
    runs and an empty ``collapsed``. Each row stands for itself, so repeated rows get equal results. Columns named like
    the new ones are replaced, all others kept. An empty table gives an empty result. Texts are searched whole: time and
    memory of a text of n words grow with n log n and n.
    """
    own = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    at = own.index(text)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(pc.fill_null(pc.utf8_length(b.column(at)), 0), np.int64)
            start = 0
            while start < b.num_rows:
                stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), STEP_CHARS, side="right")))
                part = b.slice(start, stop - start)
                start = stop
                x = documents([t or "" for t in part.column(at).to_pylist()])
                new = [pa.array(x["n_words"], pa.int64()), pa.array(x["runs"], kind), pa.array(x["kept"], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*own, "n_words", "runs", "collapsed"])

    fields = [T.StructField(f.name, f.dataType, True) for f in docs.select(*own).schema.fields]
    new = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())]
    return docs.select(*own).mapInArrow(run, T.StructType([*fields, *new]))


def planted(doc_id: Column, text: Column) -> Column:
    """The text; in a tenth of the documents, by a hash of the id, its words from some place on repeat with a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / F.lit(10)).cast("long")

    def edited(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        place = F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).alias("p"))
        return F.transform(F.array(place), lambda x: F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, (x["a"] + F.pmod(i - x["a"], x["p"])).cast("int")))))[0]

    # the argument of a lambda function is worked out once, however often its body uses it
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    again = F.transform(F.array(words), lambda w: F.array_join(edited(w), " "))[0]
    return F.when(F.pmod(h, F.lit(10)) == 0, again).otherwise(text)


def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    out = periodic_runs(docs)
    longest = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.array_join(F.array(*[r[c].cast("string") for c in ("start", "length", "period")]), ","), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("b"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    length, period = -F.col("b.l"), F.col("b.p")
    return out.select(
        "doc_id", "n_runs", F.col("b.s").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
