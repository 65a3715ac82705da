"""Secret scan: candidates by format, then a random forest that removes false positives."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut_lineage, table

#: Candidates: long runs of letters, digits and the characters of keys, or what a word for a secret is set to.
CANDIDATE = r"[A-Za-z0-9_+/=.\-]{16,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "credential", "bearer", "auth")
#: What a word for a secret is set to, of any length: the word and the rest of its name (camel or snake case, or a plural),
#: = or :, and a value in quotes or up to the next blank, without the quotes and commas that end it there.
SET_BY = r"(?i:" + "|".join(KEYWORDS) + r")(?i:orization|entication)?s?(?:[A-Z0-9_\-][A-Za-z0-9_\-]*)?[\"'`]?[ \t]*(?:=>|:=|[=:])[ \t]*(?:(?i:bearer|basic)[ \t]+)?"
VALUE = r"""(?:"[^"\r\n]+(?=")|'[^'\r\n]+(?=')|`[^`\r\n]+(?=`)|["'`]?[^\s"'`]\S*?(?=["'`,;]{0,3}(?:\s|$)|[&,;][A-Za-z_]\w*=))"""
#: A value's lead takes in its opening quote; a value with other characters is also searched for runs.
LEAD, OTHER = SET_BY + "[\"'`]?", r"[^A-Za-z0-9_+/=.\-]"
#: Provider formats whose match is a labelled finding, and shapes that look random without being secret.
FORMATS = r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35})"
#: A run may take in the dot of a sentence or a path around a key.
PROVIDER = rf"(?:^|[./=]){FORMATS}(?:$|[./=])|^[./=\-]+{FORMATS}[./=\-]*$|^{FORMATS}[./=\-]+$"
HARMLESS = r"^[0-9.\-]+$|^[A-Za-z.\-_/+=]+$|@|^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$|\.(com|net|org)\b"
SOFT_WORDS = ("example", "sample", "dummy", "placeholder", "sha1", "sha256", "md5", "commit", "checksum", "uuid", "http", "www", "mail")
TEST_PATHS = r"(?i)test|mock|fixture|example|sample|doc"
#: Letter pairs that are common in words of the corpus's languages; their share tells words from random letters.
PAIRS = ("th", "he", "in", "er", "an", "re", "on", "en", "at", "es", "ed", "te", "ti", "or", "st", "ar", "nd", "to", "nt", "is", "de", "le", "qu", "ou", "ch", "ei", "ie", "ge", "ci", "la")
NEAR = 40
#: Pieces of a text that are placed together; a full block is longer than NEAR, as every second piece is a candidate of at
#: least one character behind a name of at least four, or of 16.
BLOCK = 64
#: Words of three letters or more, at humps and capitals; the dictionary is the corpus's words in one of this many documents.
WORDS = r"\p{Lu}?\p{Ll}{2,}|\p{Lu}{3,}(?!\p{Ll})|\p{Lo}{3,}"
FREQUENT = 2_000
#: Findings that the forest is fitted on at most, by hash of their place, and how many of them with either label.
TRAIN_FINDINGS, TREES, DEPTH, SEED = 20_000, 40, 6, 20_240_603

FEATURES = ("length", "digits", "upper", "classes", "changes", "pairs", "dictionary", "spread", "hexlike", "keyword", "assigned", "quoted", "soft", "test_path", "dotted")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _in_block(pieces: Column, start: Column, before: Column, after: Column) -> Column:
    """start, piece, hit, before, after of the pieces of a block: places are running sums of lengths, and the neighbours are
    carried over pieces shorter than NEAR. Every step copies what it has so far, so a block is short."""
    part = "start:bigint,piece:string,hit:boolean,before:string"
    there = F.aggregate(
        pieces,
        F.struct(start.cast("long").alias("next"), before.alias("tail"), F.array().cast(f"array<struct<{part}>>").alias("out")),
        lambda s, p: F.struct(
            (s["next"] + F.char_length(p["piece"])).alias("next"),
            F.right(F.concat(s["tail"], p["piece"]), F.lit(NEAR)).alias("tail"),
            F.concat(s["out"], F.array(F.struct(s["next"].alias("start"), p["piece"].alias("piece"), p["hit"].alias("hit"), s["tail"].alias("before")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    return F.aggregate(
        F.reverse(there),
        F.struct(after.alias("head"), F.array().cast(f"array<struct<{part},after:string>>").alias("out")),
        lambda s, x: F.struct(
            F.left(F.concat(x["piece"], s["head"]), F.lit(NEAR)).alias("head"),
            F.concat(s["out"], F.array(F.struct(*[x[c].alias(c) for c in ("start", "piece", "hit", "before")], s["head"].alias("after")))).alias("out"),
        ),
        lambda s: s["out"],
    )


def _placed(pieces: Column, start: Column, before: Column, after: Column) -> Column:
    """The same for all pieces of a text, in blocks: a block's length and ends place the next ones, so that no step copies
    what stands before its block."""

    def blocks(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(p) - 1) / BLOCK).cast("int"), F.lit(0))), lambda i: F.slice(p, i * BLOCK + 1, F.lit(BLOCK)))

    def placed(cut: Column) -> Column:
        whole = F.transform(cut, lambda b: F.struct(F.array_join(F.transform(b, lambda x: x["piece"]), "").alias("piece"), F.lit(True).alias("hit")))
        ends = F.transform(whole, lambda x: F.struct(F.char_length(x["piece"]).alias("n"), F.left(x["piece"], F.lit(NEAR)).alias("head"), F.right(x["piece"], F.lit(NEAR)).alias("tail")))
        return F.flatten(F.element_at(F.transform(F.array(ends), lambda e: F.zip_with(cut, _around(e, start, before, after), lambda b, a: _in_block(b, a["start"], a["before"], a["after"]))), 1))

    return F.element_at(F.transform(F.array(F.element_at(F.transform(F.array(pieces), blocks), 1)), placed), 1)


def _around(ends: Column, start: Column, before: Column, after: Column) -> Column:
    """(start, before, after) of each block from the (n, head, tail) of all: only the last block may be shorter than NEAR."""
    starts = F.aggregate(
        ends,
        F.struct(start.cast("long").alias("next"), F.array().cast("array<bigint>").alias("out")),
        lambda s, e: F.struct((s["next"] + e["n"]).alias("next"), F.concat(s["out"], F.array(s["next"])).alias("out")),
        lambda s: s["out"],
    )
    last = F.size(ends) - 1

    def one(at: Column, i: Column) -> Column:
        ahead = F.when(i == last, after).when(i == last - 1, F.left(F.concat(F.get(ends, i + 1)["head"], after), F.lit(NEAR))).otherwise(F.get(ends, i + 1)["head"])
        return F.struct(at.alias("start"), F.when(i == 0, before).otherwise(F.get(ends, i - 1)["tail"]).alias("before"), ahead.alias("after"))

    return F.transform(starts, one)


def _pieces(text: Column, pattern: str, lead: str | None = None) -> Column:
    """The text cut at the matches of a pattern: (piece, hit). What ``lead`` finds at the start of a match stands before it."""
    found, gaps = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)
    pairs = F.transform(found, lambda c: F.struct((F.regexp_extract(c, f"^({lead})", 1) if lead else F.lit("")).alias("lead"), c.alias("c")))
    piece = lambda p, hit: F.struct(p.alias("piece"), F.lit(hit).alias("hit"))
    cut = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)),
        pairs,
        lambda g, z: F.array(piece(F.concat(g, z["lead"]), False), piece(F.substring(z["c"], F.char_length(z["lead"]) + 1, F.char_length(z["c"])), True)),
    )
    return F.concat(F.flatten(cut), F.array(piece(F.element_at(gaps, -1), False)))


def candidates(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, position (code points from 1), candidate, before, after, path: every candidate of every whole text.

    First the values that a word for a secret is set to are cut out, then the long runs of key characters are found in what
    stands between them, and in values that also have other characters. ``before`` and ``after`` are the next characters of
    the whole text, other candidates included.
    """
    where = F.col(path) if path else F.lit("").cast("string")
    whole = docs.select("doc_id", F.col(text).alias("text"), F.coalesce(where, F.lit("")).alias("path"))
    #: Texts without a long run of key characters or a value set by a word for a secret are passed over in the scan itself.
    some = whole.where(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(SET_BY + VALUE))
    parts = some.select("doc_id", "path", F.explode(_placed(_pieces(F.col("text"), SET_BY + VALUE, LEAD), F.lit(1), F.lit(""), F.lit(""))).alias("p"))
    value = F.col("p.hit") & (F.col("p.piece") != "")
    runs_in = F.when(~F.col("p.hit") | F.col("p.piece").rlike(OTHER), F.col("p.piece")).otherwise(F.lit(""))
    runs = F.filter(_placed(_pieces(runs_in, CANDIDATE), F.col("p.start"), F.col("p.before"), F.col("p.after")), lambda x: x["hit"])
    found = parts.select("doc_id", "path", F.explode(F.concat(F.filter(F.array("p"), lambda x: value), runs)).alias("x"))
    return found.select("doc_id", "path", F.col("x.start").alias("position"), F.col("x.piece").alias("candidate"), "x.before", "x.after")


def with_features(found: DataFrame) -> DataFrame:
    """Adds the FEATURES but ``dictionary`` as doubles: length, character classes and their changes, common pairs, path and neighbours."""
    c, low = F.col("value"), F.lower("value")
    n = F.greatest(F.char_length("value"), F.lit(1)).cast("double")
    before, after = F.lower("before"), F.lower("after")
    has = lambda text, words: F.greatest(*[F.contains(text, F.lit(w)).cast("double") for w in words])
    #: ``password=...`` is one run of key characters: what stands before the last = is its name, the rest the value.
    set_by = F.col("before").rlike(f"(?:{LEAD})$")
    d = found.withColumn("name", F.when(set_by, "").otherwise(F.lower(F.regexp_extract("candidate", r"^([A-Za-z_\-]+)=[^=]", 1))))
    d = d.withColumn("value", F.when(F.col("name") != "", F.expr("substring(candidate, char_length(name) + 2)")).otherwise(F.col("candidate")))
    return d.withColumns(
        {
            "length": n,
            "digits": _count(c, "[0-9]") / n,
            "upper": _count(c, "[A-Z]") / n,
            "classes": (c.rlike("[0-9]").cast("int") + c.rlike("[A-Z]").cast("int") + c.rlike("[a-z]").cast("int") + c.rlike("[^A-Za-z0-9]").cast("int")).cast("double"),
            "changes": (_count(c, "[0-9](?=[A-Za-z])") + _count(c, "[A-Za-z](?=[0-9])") + _count(c, "[a-z](?=[A-Z])")) / n,
            "pairs": _count(low, "(?=" + "|".join(PAIRS) + ")") / n,
            "spread": F.size(F.array_distinct(F.split(c, ""))).cast("double") / n,
            "hexlike": c.rlike("^[0-9a-f]+$").cast("double"),
            "keyword": F.greatest(has(F.right(before, F.lit(20)), KEYWORDS), has(F.col("name"), KEYWORDS), set_by.cast("double")),
            "assigned": F.greatest(before.rlike(r"[=:]\s*[\"']?$").cast("double"), set_by.cast("double"), (F.col("name") != "").cast("double")),
            "quoted": before.rlike("[\"'`]$").cast("double"),
            "soft": F.greatest(has(before, SOFT_WORDS), has(after, SOFT_WORDS), has(low, SOFT_WORDS)),
            "test_path": F.col("path").rlike(TEST_PATHS).cast("double"),
            "dotted": _count(c, r"[./]") / n,
        }
    )


def dictionary(docs: DataFrame, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """word: the lower-cased words found in at least one of ``frequent`` documents, and in two. Counts run over all whole texts
    and are combined before they are shuffled."""
    words = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0)), F.lower))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= 2) & (F.col("n") * frequent >= docs.agg(F.count("*")).scalar())).select("word")


def with_coverage(featured: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``dictionary``, the share of a value's characters that stand in words of the dictionary. Each distinct value is
    looked up once; a value on very many rows meets its one share in the last join, which Spark splits or broadcasts."""
    pieces = featured.select("value").distinct().select("value", F.explode(F.regexp_extract_all("value", F.lit(WORDS), F.lit(0))).alias("w"))
    known = pieces.withColumn("word", F.lower("w")).join(words, "word").groupBy("value").agg(F.sum(F.char_length("w")).alias("_covered"))
    share = F.coalesce("_covered", F.lit(0)) / F.greatest(F.char_length("value"), F.lit(1))
    return featured.join(known, "value", "left").withColumn("dictionary", share.cast("double")).drop("_covered")


def label(featured: DataFrame) -> DataFrame:
    """Adds ``label``: 1 for findings in a provider's format or set as a value by a word for a secret, 0 for harmless shapes, else NULL."""
    value = F.col("value")
    sure = value.rlike(PROVIDER) | ((F.col("keyword") == 1) & (F.col("assigned") == 1) & value.rlike("[0-9]") & (F.col("soft") == 0) & ~value.rlike(HARMLESS))
    return featured.withColumn("label", F.when(sure, 1.0).when(value.rlike(HARMLESS) | (F.col("soft") == 1), 0.0))


def fit(labelled: DataFrame, limit: int = TRAIN_FINDINGS) -> PipelineModel | None:
    """The forest, on at most ``limit`` labelled findings in the order of a hash of their place; None without both labels."""
    rows = labelled.where("label IS NOT NULL").select("label", *FEATURES, F.xxhash64("doc_id", "position").alias("h"))
    half = limit // 2
    known = cut_lineage(rows.where("label = 1").orderBy("h").limit(half).union(rows.where("label = 0").orderBy("h").limit(half)))
    if known.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="x"), forest]).fit(known)


def scan_secrets(docs: DataFrame, text: str = "text", path: str | None = None, cut: float = 0.5) -> DataFrame:
    """doc_id, position, candidate, score, is_secret for every candidate of ``docs`` (doc_id, text and perhaps a path).

    Candidates are found in whole texts, described by numbers (their share of frequent corpus words among them), and judged by a random forest that is fitted on the
    findings whose format or setting settles their label. Without findings of both labels the score is the rule's own
    answer. NULL and empty texts have no candidates. Every occurrence is a row; repeated rows give repeated findings.
    Other columns are not read. An empty table gives an empty result. Only DataFrame functions and Spark's own forest
    are used.
    """
    found = cut_lineage(with_features(candidates(docs, text, path)))
    found = cut_lineage(label(with_coverage(found, dictionary(docs, text))))
    model = fit(found)
    if model is None:
        scored = found.withColumn("score", F.coalesce("label", F.lit(0.0)))
    else:
        scored = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "position", "candidate", "score", (F.col("score") >= cut).alias("is_secret"))


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(table(spark, folder, "documents"), path="source")
