"""Toxicity: a support vector machine on a gap-weighted subsequence kernel of words, with Nyström landmarks."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut_lineage, free_name, table

#: Labelled documents that the model is fitted on at most, taken in the order of a hash of their ids.
TRAIN_DOCS = 8000
LANDMARKS, BACKGROUND, NEGATIVES, HARD = 160, 16, 20_000, 5_000
#: Subsequences have three or four characters that span at most SPAN; each character spanned costs a factor DECAY. They
#: are numbered by a hash of SLOTS values for each length.
SPAN, DECAY, CODES, PIECE = 7, 0.6, 64, 32
SLOTS = 1 << 18
#: Words whose kernel rows, and words whose decision values, are worked out together.
ROWS, WORDS = 512, 20_000
CUT = 0.3
#: Characters whose words are held and decided together.
STEP_CHARS = 2_000_000
#: Least log-likelihood ratio of a word that counts as toxic by itself: chance gives it to one word in 400,000.
EXCESS = 13.0

_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)] + [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
_TABLE = np.array([29 + ch % (CODES - 29) for ch in range(0x3000)], np.int32)
_TABLE[97:123] = np.arange(3, 29)
_TABLE[[94, 36]] = 1, 2


def _codes(points: np.ndarray) -> np.ndarray:
    """Code of each character; those behind the table (kana, Han, Hangul, emoji) are spread over the codes that are not letters."""
    far = (29 + ((points * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(CODES - 29)).astype(np.int32)
    return np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], far)


def units(text: str | None) -> set[str]:
    """Distinct words of a text, lower-cased; three or more single characters in a row count as one word."""
    words = (text or "").lower().split()
    out, run = set(words), []
    ones = [i for i, w in enumerate(words) if len(w) == 1]
    for i, nxt in zip(ones, [*ones[1:], None]):
        run.append(words[i])
        if nxt != i + 1:
            if len(run) >= 3:
                out.add("".join(run))
            run = []
    return out


def _bare(word: str) -> str:
    """The letters and digits of a word between a mark for its start and one for its end."""
    return "^" + (word if word.isalnum() else "".join(filter(str.isalnum, word))) + "$"


def _pieces(words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Codes of the words, long ones in overlapping pieces, grouped by length: (owner of each piece, [(rows, codes)])."""
    cut, owner = [], []
    for i, w in enumerate(map(_bare, words)):
        parts = [w] if len(w) <= PIECE else [w[j : j + PIECE] for j in range(0, len(w) - PIECE // 2, PIECE // 2)]
        cut += parts
        owner += [i] * len(parts)
    lengths = np.fromiter(map(len, cut), np.int64, len(cut))
    groups = []
    for n in np.unique(lengths[lengths >= 3]):
        rows = np.flatnonzero(lengths == n)
        points = np.frombuffer("".join([cut[r] for r in rows]).encode("utf-32-le", "surrogatepass"), np.uint32)
        groups.append((rows, _codes(points).reshape(-1, n)))
    return np.array(owner, np.int64), groups


def _scale(n: int) -> float:
    """Norm of a word of n characters whose subsequences all differ; any positive scale keeps the kernel definite."""
    return max(1e-9, sum(max(0, n - g[-1]) * _weight(g) ** 2 for g in _GAPS)) ** 0.5


def _weight(gaps: tuple[int, ...]) -> float:
    """Each length starts from weight one, so that longer subsequences are not drowned by shorter ones."""
    return DECAY ** (gaps[-1] - len(gaps))


def _runs(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Numbers of the subsequences of a group of words of one length, by gap pattern, with their weight."""
    n = codes.shape[1]
    for gaps in _GAPS:
        m = n - gaps[-1]
        if m > 0:
            x = codes[:, :m]
            for g in gaps:
                x = x * CODES + codes[:, g : g + m]
            #: Three codes fill SLOTS exactly; four are hashed into the slots behind them.
            yield (x if len(gaps) == 2 else SLOTS + ((x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(14)).astype(np.int32)), _weight(gaps)


def _word_max(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, owner, values)
    return out


@dataclass
class Kernel:
    """Kernel values between words and landmarks, through the subsequences that the landmarks have."""

    landmarks: list[str]

    def __post_init__(self):
        owner, groups = _pieces(self.landmarks)
        weights: dict[tuple[int, int], float] = {}
        for rows, codes in groups:
            for t, w in _runs(codes):
                for r, row in zip(rows, t, strict=True):
                    for u in row.tolist():
                        weights[owner[r], u] = weights.get((owner[r], u), 0.0) + w / _scale(codes.shape[1])
        found = sorted({u for _, u in weights})
        self.index = np.full(2 * SLOTS, -1, np.int32)
        self.index[found] = np.arange(len(found))
        self.features = np.zeros((len(found) + 1, len(self.landmarks)))
        for (i, u), w in weights.items():
            self.features[self.index[u], i] = w
        self.found = np.array(found, np.int64)

    def rows(self, words: list[str]) -> np.ndarray:
        """(words, landmarks); of a word in pieces the piece nearest to any landmark."""
        owner, groups = _pieces(words)
        k = np.zeros((len(owner), len(self.landmarks)))
        for rows, codes in groups:
            for i in range(0, len(rows), ROWS):
                part = np.zeros((len(rows[i : i + ROWS]), len(self.landmarks)))
                for t, w in _runs(codes[i : i + ROWS]):
                    part += w * self.features[self.index[t]].sum(axis=1)
                k[rows[i : i + ROWS]] = part / _scale(codes.shape[1])
        if len(owner) == len(words):
            return k
        out = np.zeros((len(words), len(self.landmarks)))
        np.maximum.at(out, owner, k)
        return out

    def weights(self, alpha: np.ndarray) -> np.ndarray:
        """What each subsequence adds to the decision value, so that words are scored without visiting the landmarks."""
        beta = np.zeros(2 * SLOTS, np.float32)
        beta[self.found] = self.features[:-1] @ alpha
        return beta


@dataclass
class Model:
    beta: np.ndarray
    bias: float
    slope: float
    shift: float

    def decide(self, words: list[str]) -> np.ndarray:
        if len(words) > WORDS:
            return np.concatenate([self.decide(words[i : i + WORDS]) for i in range(0, len(words), WORDS)])
        owner, groups = _pieces(words)
        f = np.zeros(len(owner))
        for rows, codes in groups:
            total = np.zeros(len(rows))
            for t, w in _runs(codes):
                total += w * self.beta[t].sum(axis=1)
            f[rows] = total / _scale(codes.shape[1])
        return _word_max(f + self.bias, owner, len(words))

    def probability(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * f + self.shift, -500, 500)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights (the last one is the bias) of a linear machine with squared hinge loss, by damped Newton steps on the primal."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    unit = np.full(x.shape[1], ridge)
    unit[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        return float(unit @ w**2 + weight @ np.maximum(0, 1 - y * (x @ w)) ** 2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(50):
        h, g = np.diag(unit), np.zeros(len(w))
        active = np.flatnonzero(y * (x @ w) < 1)
        for i in range(0, len(active), 4096):
            rows = active[i : i + 4096]
            a = x[rows].astype(np.float64)
            h += a.T @ (a * weight[rows, None])
            g += a.T @ (weight[rows] * y[rows])
        step = np.linalg.solve(h, g) - w
        t = 1.0
        while t > 1e-4 and (new := loss(w + t * step)) >= now:
            t /= 2
        if t <= 1e-4 or now - new < 1e-7 * now:
            break
        w, now = w + t * step, new
    return w


def _calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with targets drawn in by one case a class."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([f, np.ones(len(f))], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-4 * w)
        w += step / max(1.0, np.abs(step).max() / 2)
    return float(w[0]), float(w[1])


def _disguised(words: list[str], rng: np.random.Generator) -> list[str]:
    """The words with a letter or digit inserted, and with one letter written twice."""
    out = []
    for w in words:
        if 4 <= len(w) < PIECE // 2:
            i, j = rng.integers(1, len(w), 2)
            out += [w[:i] + "xzq01"[int(rng.integers(5))] + w[i:], w[:j] + w[j - 1] + w[j:]]
    return out


def _crc(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def _order(words) -> list[str]:
    return sorted(words, key=lambda w: (_crc(w), w))


_PERMS = 16


def _minima(words: list[str]) -> list[int]:
    """The least of the word hashes under each of _PERMS permutations; none without words."""
    a, b = np.random.default_rng(11).integers(1, 1 << 32, (2, _PERMS, 1), dtype=np.uint64)
    h = np.fromiter(map(_crc, words), np.uint64, len(words))
    return ((h * a + b) % np.uint64(4294967291)).min(axis=1).tolist() if words else []


def _unlike(minima: list[list[int]], most: int = 8) -> list[int]:
    """Numbers of the documents without those that agree with an earlier one in more than ``most`` of their minima.

    Copies of one toxic document would make each of its rare words look toxic.
    """
    seen: dict[tuple[int, int], list[int]] = {}
    out = []
    for i, least in enumerate(minima):
        if max(Counter(j for key in enumerate(least) for j in seen.get(key, ())).values(), default=0) <= most:
            out.append(i)
            for key in enumerate(least):
                seen.setdefault(key, []).append(i)
    return out


def _parts(rows: list[tuple[int, bool, list[int]]]) -> tuple[list[int], list[int]] | None:
    """(documents to learn from, documents to calibrate on) by number, from (label, chosen for calibration, minima).

    Near copies are left out. A quarter of the documents calibrates, all of them where one class would be missing; None
    without documents of both classes.
    """
    kept = _unlike([least for _, _, least in rows])
    both = lambda x: len({rows[i][0] for i in x}) == 2
    learn, held = [i for i in kept if not rows[i][1]], [i for i in kept if rows[i][1]]
    if not both(learn):
        learn, held = kept, []
    return (learn, held if both(held) else kept) if both(learn) else None


class Bags:
    """Labelled documents in memory: the plain form of what ``Sample`` asks of Spark."""

    def __init__(self, bags: list[tuple[list[str], int]]):
        bags = sorted(((sorted(b), y) for b, y in bags), key=lambda x: (x[0][:3], len(x[0]), x[1]))
        self.parts = _parts([(y, _calibrates(b), _minima(b)) for b, y in bags])
        if self.parts is None:
            return
        self.learn, self.held = ([bags[i] for i in part] for part in self.parts)
        self.n, self.toxic = len(self.learn), sum(y for _, y in self.learn)
        self.inside = Counter(w for b, y in self.learn if y for w in b)
        self.outside = Counter(w for b, y in self.learn if not y for w in b)

    def suspects(self) -> list[tuple[str, int, int]]:
        return [(w, n, self.outside[w]) for w, n in self.inside.items() if n >= 2 and n > self.outside[w]]

    def first_inside(self, n: int) -> list[str]:
        return sorted(self.inside)[:n]

    def common(self, n: int) -> list[str]:
        return [w for w, _ in sorted(self.outside.items(), key=lambda x: (-x[1], x[0])) if len(w) >= 3][:n]

    def clean(self, n: int) -> list[str]:
        return _order(self.outside)[:n]

    def hardest(self, model: Model, n: int) -> list[str]:
        words = _order(self.outside)
        return [words[i] for i in np.argsort(-model.decide(words), kind="stable")[:n]]

    def unexplained(self, strong: list[str]) -> list[list[str]]:
        return [[w for w in b if w not in self.outside] for b, y in self.learn if y and not set(b) & set(strong)]

    def decided(self, model: Model) -> list[tuple[float, int]]:
        return [(_bag(model, b), y) for b, y in self.held]


def _calibrates(words: list[str]) -> bool:
    return _crc("".join(words)) % 4 == 0


class Sample:
    """Labelled documents as a table of their words, written once. Counts, orders and decisions over all words are Spark
    jobs; what reaches the driver is 16 numbers a document and the words that the machine is fitted on."""

    def __init__(self, documents: DataFrame):
        """documents(y, text)"""

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            i = TaskContext.get().partitionId() << 40
            for b in batches:
                words = [sorted(units(t.as_py())) for t in b.column(1)]
                ids = np.arange(i, i + len(words))
                i += len(words)
                least = pa.array([_minima(w) for w in words], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), b.column(0), pa.array(words, pa.list_(pa.string())), least, pa.array(list(map(_calibrates, words)), pa.bool_())], ["id", "y", "words", "least", "calibrates"])

        self.bags = cut_lineage(documents.select("y", "text").mapInArrow(split, "id long, y int, words array<string>, least array<long>, calibrates boolean"))
        rows = self.bags.select(F.slice("words", 1, 3).alias("first"), F.size("words").alias("n"), "y", "least", "calibrates", "id").orderBy("first", "n", "y", "least", "id").toArrow()
        self.parts = _parts(list(zip(*(rows[c].to_pylist() for c in ("y", "calibrates", "least")), strict=True)))
        if self.parts is None:
            return
        ids, y = rows["id"].to_numpy(), rows["y"].to_numpy()
        self.learn, self.held = (set(ids[part].tolist()) for part in self.parts)
        self.n, self.toxic = len(self.parts[0]), int(y[self.parts[0]].sum())
        inside, outside = F.count_if(F.col("y") == 1).alias("inside"), F.count_if(F.col("y") == 0).alias("outside")
        each = self._some(self.learn).select("y", F.explode("words").alias("word")).groupBy("word").agg(inside, outside)
        self.words = cut_lineage(each.withColumn("crc", F.crc32(F.col("word").cast("binary"))))

    def _some(self, ids: set[int]) -> DataFrame:
        """The bags of some documents, at most as many as the sample has."""
        spark = self.bags.sparkSession
        return self.bags.select("id", "y", "words").join(F.broadcast(spark.createDataFrame(pa.table({"id": sorted(ids)}), "id long")), "id")

    @staticmethod
    def _list(words: DataFrame) -> list[str]:
        return words.select("word").toArrow()["word"].to_pylist()

    def suspects(self) -> list[tuple[str, int, int]]:
        return [tuple(r) for r in self.words.where("inside >= 2 AND inside > outside").select("word", "inside", "outside").toLocalIterator()]

    def first_inside(self, n: int) -> list[str]:
        return self._list(self.words.where("inside > 0").orderBy("word").limit(n))

    def common(self, n: int) -> list[str]:
        return self._list(self.words.where("outside > 0 AND char_length(word) >= 3").orderBy(F.desc("outside"), "word").limit(n))

    def clean(self, n: int) -> list[str]:
        return self._list(self.words.where("outside > 0").orderBy("crc", "word").limit(n))

    def hardest(self, model: Model, n: int) -> list[str]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.decide(b.column(0).to_pylist()))], ["word", "crc", "f"])

        return self._list(self.words.where("outside > 0").select("word", "crc").mapInArrow(run, "word string, crc long, f double").orderBy(F.desc("f"), "crc", "word").limit(n))

    def unexplained(self, strong: list[str]) -> list[list[str]]:
        known = set(strong)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([known.isdisjoint(w) for w in b.column(1).to_pylist()], pa.bool_()))

        open_ = self._some(self.learn).where("y = 1").select("id", "words").mapInArrow(run, "id long, words array<string>")
        rare = open_.select("id", F.explode("words").alias("word")).join(self.words.where("outside > 0").select("word"), "word", "left_anti")
        return [r["words"] for r in rare.groupBy("id").agg(F.sort_array(F.collect_list("word")).alias("words")).orderBy("id").toLocalIterator()]

    def decided(self, model: Model) -> list[tuple[float, int]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_best_words(model, b.column(1).to_pylist()), pa.float64()), b.column(2)], ["id", "f", "y"])

        rows = self._some(self.held).select("id", "words", "y").mapInArrow(run, "id long, f double, y int").orderBy("id").toArrow()
        return list(zip(rows["f"].to_pylist(), rows["y"].to_pylist(), strict=True))


def fit(sample: Bags | Sample) -> Model | None:
    """The model from labelled documents, each a set of words; None without documents of both classes.

    A label holds for the whole document, so which word makes it toxic is found in turns: the machine starts
    from words with many more toxic documents than chance gives, and takes in the most toxic word of each toxic
    document that has none of them, as far as no clean document has it; the clean words nearest to the border are added too.
    Where no word exceeds chance by EXCESS the 20 with the largest excess start, else the first 20 words of toxic documents.
    Of the clean words, NEGATIVES in the order of a hash and, in each turn, the HARD nearest to the border enter the machine.
    """
    if sample.parts is None:
        return None
    rate = sample.toxic / sample.n

    def excess(k: int, out: int) -> float:
        """Log-likelihood ratio of a word's toxic and clean documents against chance; 0 for a word of clean ones."""
        n = k + out
        if k <= rate * n:
            return 0.0
        return k * np.log(k / (rate * n)) + (out * np.log(out / ((1 - rate) * n)) if out else 0.0)

    ranked = sorted(((excess(k, out), w) for w, k, out in sample.suspects()), key=lambda x: (-x[0], x[1]))
    strong = [w for e, w in ranked if e > EXCESS] or [w for _, w in ranked[:20]] or sample.first_inside(20)
    marks: list[str] = []
    for w in strong:
        if len(marks) < LANDMARKS - BACKGROUND and (not marks or Kernel(marks).rows([w]).max() < 0.8 * Kernel([w]).rows([w])[0, 0]):
            marks.append(w)
    marks += sample.common(BACKGROUND)
    kernel = Kernel(marks)
    values, vectors = np.linalg.eigh(kernel.rows(marks))
    values = np.maximum(values, 1e-3)
    root = vectors / np.sqrt(values) @ vectors.T

    first = set(strong)
    clean = lambda words, n: [w for w in words if w not in first][:n]
    negative, positive = clean(sample.clean(NEGATIVES + len(strong)), NEGATIVES), strong
    unexplained = [b for b in sample.unexplained(strong) if b]
    model = Model(np.zeros(2 * SLOTS, np.float32), 0.0, 1.0, 0.0)
    known: dict[str, np.ndarray] = {}

    def rows(words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in known]
        known.update(zip(new, (kernel.rows(new) @ root).astype(np.float32), strict=True)) if new else None
        return np.stack([known[w] for w in words])

    for _ in range(4):
        pos, neg = positive + _disguised(positive, np.random.default_rng(7)), negative
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        w = _svm(rows(pos + neg), y, np.where(y > 0, len(neg) / len(pos) / 4, 1.0))
        model.beta, model.bias = kernel.weights(root @ w[:-1]), float(w[-1])
        negative = _order({*negative, *clean(sample.hardest(model, HARD + len(strong)), HARD)})
        best = (max(zip(model.decide(b), b, strict=True)) for b in unexplained)
        positive = strong + sorted({w for f, w in best if f > 0} - first)
    f, y = zip(*sample.decided(model), strict=True)
    model.slope, model.shift = _calibrate(np.array(f), np.array(y))
    return model


def _bag(model: Model, bag: set[str] | list[str]) -> float:
    return float(max(model.decide(list(bag)), default=-2.0)) if bag else -2.0


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = TRAIN_DOCS) -> Model | None:
    """Fits on at most ``limit`` labelled documents outside the held-out part, in the order of a hash of their ids."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", (F.col(label) > 0).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(limit)
    #: The sample has a fixed bound, so it is broadcast.
    return fit(Sample(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")))


def _best_words(model: Model, bags: list[set[str]] | list[list[str]]) -> list[float]:
    """Decision value of the most toxic word of each bag; every distinct word is decided once."""
    words = list(set().union(*bags))
    f = dict(zip(words, model.decide(words).tolist(), strict=True)) if words else {}
    return [max(map(f.__getitem__, b), default=-2.0) for b in bags]


def score_texts(docs: DataFrame, model: Model | None, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``out`` (0 to 1): the probability of its most toxic word. A column of that name is replaced.

    NULL and empty texts and texts without words get the probability of a word far on the clean side. Without a model
    (no labels of both classes) every score is 0. Each distinct word of a batch is scored once; words of any length
    are read whole, in overlapping pieces.
    """
    if model is None:
        return docs.withColumn(out, F.lit(0.0))

    @F.pandas_udf("double")
    def score(texts):
        best, bags, size = [], [], 0
        for t in texts:
            bags.append(units(t))
            size += len(t or "")
            if size >= STEP_CHARS:
                best += _best_words(model, bags)
                bags, size = [], 0
        best += _best_words(model, bags)
        return type(texts)(model.probability(np.array(best, float)))

    return docs.withColumn(out, score(F.col(text)))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_texts(docs, train(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` without the rows whose score reaches ``cut``.

    All columns stay as they are, whatever their names. NULL, empty and blank texts are clean and stay, repeated rows share
    their fate, an empty table gives an empty result; without labels of both classes every row stays.
    """
    out = free_name(docs, "_toxicity")
    return score_texts(docs, train(docs, labels), out=out).where(F.col(out) < cut).select(*docs.columns)
