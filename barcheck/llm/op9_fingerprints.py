"""Document fingerprints: a threshold-scaled sketch keeps every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import BLANKS, cut_lineage, table

WORDS = 5
#: One shingle in SCALE is kept; hashes have HASH_BITS bits, written as hexadecimal digits.
SCALE, HASH_BITS = 4, 48
_DIGITS = HASH_BITS // 4
#: Rows of one chunk of the order by doc_id.
CHUNK_ROWS = 1000


def shingle_hashes(text: Column, k: int = WORDS) -> Column:
    """HASH_BITS-bit hashes of the k-word shingles of a text; a shorter text is one shingle, one without words none."""
    words = F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")

    def over(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        few = F.when(n == 0, F.array().cast("array<long>")).otherwise(F.array(F.xxhash64(w)))
        return F.transform(F.when(n >= k, many).otherwise(few), lambda h: F.shiftrightunsigned(h, 64 - HASH_BITS))

    #: One pass over a one-element array binds the words once, instead of splitting the text at every use.
    return F.element_at(F.transform(F.array(words), over), 1)


def sketch(text: Column, scale: int = SCALE, k: int = WORDS) -> Column:
    """Sorted distinct hashes below ``2**HASH_BITS / scale``; where none is, the smallest hash alone; empty without words.

    Sketches of the same scale merge by union (``merge``); every text keeps the same hashes wherever it occurs.
    """
    limit = F.lit((1 << HASH_BITS) // scale)

    def cut(h: Column) -> Column:
        low = F.filter(h, lambda x: x < limit)
        return F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(low)

    return F.element_at(F.transform(F.array(shingle_hashes(text, k)), cut), 1)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of two texts together: the union, without stand-ins above the limit if a hash below it is there."""
    both = F.sort_array(F.array_union(a, b))
    low = F.filter(both, lambda x: x < F.lit((1 << HASH_BITS) // scale))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles in all shingles of two texts; 1 for two empty sketches, 0 for one."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has, however unequal they are; 1 for an empty ``a``."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def packed(s: Column) -> Column:
    """A sketch as a string: its hashes as hexadecimal numbers of equal width, in order, joined by commas."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), _DIGITS, "0")), ",")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by descending doc_id, after the last one that of the first.

    Rows go to chunks of the doc_id range; a chunk finds its neighbours in one window. The last row of a chunk takes
    the text of the first row of the next chunk that has rows, looked up by its row key, so no task orders more
    than a chunk. A chunk's width follows the number of rows; ids far apart only make chunks uneven.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stat = base.agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    chunks = max(1, math.ceil(stat["n"] / CHUNK_ROWS))
    lo, width = stat["lo"] or 0, max(1, -(-((stat["hi"] or 0) - (stat["lo"] or 0) + 1) // chunks))
    #: Larger ids come first, rows without an id last.
    chunk = F.coalesce(F.lit(chunks) - F.floor((F.col("doc_id") - lo) / width), F.lit(chunks + 1)).cast("long")
    keyed = base.withColumn("chunk", chunk)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    local = keyed.withColumn("next_text", F.lead("text").over(Window.partitionBy("chunk").orderBy(*order)))
    heads = keyed.groupBy("chunk").agg(F.min(F.struct((-F.col("doc_id")).alias("neg"), F.xxhash64("text").alias("h"))).alias("k"))
    after = F.coalesce(F.lead("k").over(Window.orderBy("chunk")), F.first("k").over(Window.orderBy("chunk")))
    turn = cut_lineage(heads.select("chunk", after.alias("k")).select(F.col("chunk").alias("c"), F.col("k.neg").alias("neg"), F.col("k.h").alias("h")))
    edge = base.join(turn, (-F.col("doc_id")).eqNullSafe(F.col("neg")) & (F.xxhash64("text") == F.col("h"))).select("c", F.col("text").alias("edge_text")).dropDuplicates(["c"])
    #: Rows are still partitioned and sorted by chunk; only a chunk's last row matches.
    last = local.join(edge, (F.col("chunk") == F.col("c")) & F.col("next_text").isNull(), "left")
    return last.select("doc_id", "text", F.coalesce("next_text", "edge_text").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the next one."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, scale: int = SCALE, k: int = WORDS) -> DataFrame:
    """doc_id, text, sketch (array of long) for every row of ``docs`` (doc_id, text).

    NULL texts count as empty. Texts without words have an empty sketch, shorter ones than k words or ones without a
    hash below the limit have one hash, so equal texts always agree and different ones practically never. Texts of any
    length are handled in their task. Repeated rows and NULL ids stay rows of their own; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), sketch(text, scale, k).alias("sketch"))


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    pairs = with_next(table(spark, folder, "documents"))
    e = edited(F.col("text"), F.col("next_text"))
    out = pairs.select("doc_id", "text", "next_text", e.alias("edited"))
    out = out.select("*", sketch(F.col("text")).alias("s"), sketch(F.col("edited")).alias("t"), sketch(F.col("next_text")).alias("u"))
    return out.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("s")).alias("fingerprint"),
        packed(F.col("t")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("t")).alias("near_edited"),
        likeness(F.col("s"), F.col("u")).alias("near_next"),
        containment(F.col("s"), F.col("t")).alias("contained_in_edited"),
    )
