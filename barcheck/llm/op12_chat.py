"""Chat formatting: conversations in windows of a token budget, cut between turns, with a mask for the loss.

Prefix sums of turn tokens lay a grid of ``stride`` tokens over the turns: turns inside one cell of the grid share a window, a
turn across a grid line has a window of its own. Every window starts with the system turn and the last turns before it, as
far as the history limits allow; such repeats are outside the loss mask. Turn numbers are cut into blocks, which meet
only in the rows that the next block repeats, so a conversation of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, table, word_count

BUDGET, HISTORY, HISTORY_TURNS, BLOCK, LEAST_STRIDE = 1024, 192, 4, 64, 64
#: Tokens that a turn's marks count for.
MARK_TOKENS = 3
SYSTEM, TRAINED = "system", "assistant"
#: Turn number of rows without one: before all others.
_FIRST = -(1 << 62)


def escape(c: Column) -> Column:
    """Text without ``<``, so without any mark; every backslash is followed by the letter that names the character meant."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _head(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit(">\n"))


def _piece(role: Column, text: Column) -> Column:
    return F.concat(_head(role), escape(text), F.lit("</turn>\n"))


def _blocks(turns: DataFrame, history_turns: int, block: int) -> DataFrame:
    """Rows of each block (kind 2), repeats of the rows before it (kind 1), and for later blocks the system turn (kind 0)."""
    own = turns.withColumn("_b", F.floor(F.col("_t") / F.lit(block)))
    tail = F.pmod(F.col("_t"), F.lit(block)) >= block - history_turns
    home = lambda kind, b: F.struct(F.lit(kind).alias("_kind"), b.alias("_b"))
    homes = F.when(tail, F.array(home(2, F.col("_b")), home(1, F.col("_b") + 1))).otherwise(F.array(home(2, F.col("_b"))))
    rows = own.withColumn("_h", F.explode(homes)).select("_conv", "_h.*", "_t", "_role", "_text")
    keys = own.select("_conv", "_b", F.struct("_t", "_role").alias("_row"))
    long = keys.groupBy("_conv").agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"), F.min("_row").alias("_head")).where("_lo < _hi").withColumnRenamed("_conv", "_of")
    same = F.col("_conv").eqNullSafe(F.col("_of"))
    later = keys.select("_conv", "_b").distinct().join(long.select("_of", "_lo"), same).where("_b > _lo").select("_conv", "_b")
    first = turns.where(F.col("_role") == SYSTEM).join(long.where(F.col("_head._role") == SYSTEM), same & (F.col("_t") == F.col("_head._t")))
    system = first.groupBy("_of").agg(F.min("_text").alias("_text"))
    marks = later.join(system, same, "left").select("_conv", F.lit(0).alias("_kind"), "_b", F.lit(_FIRST - 1).alias("_t"), F.when(F.col("_text").isNotNull(), F.lit(SYSTEM)).otherwise("").alias("_role"), "_text")
    return rows.unionByName(marks)


def windows(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, block: int = BLOCK,
) -> DataFrame:
    """One row per window: ``conv``, ``block``, ``window``, ``formatted``, ``n_repeated``, ``n_turns``, ``n_tokens``, ``loss``.

    ``n_repeated`` turns come first in ``formatted``, then ``n_turns`` of its own; ``loss`` are (start, length) in code points
    of the texts of the window's own assistant turns. Tokens are words and MARK_TOKENS a turn. A window has at most ``budget``
    tokens unless the system turn or one turn alone is too large for it: such a turn is kept whole, in a window of its own.
    History are turns numbered at most ``history_turns`` before the window's first and within ``history`` tokens of it.

    Turns are ordered by number, role, text; a NULL number comes first, a NULL role or text is empty, a NULL conversation
    is one conversation. Repeated rows are turns of their own. Windows do not cross multiples of ``block`` turn numbers.
    Other columns are not read, so their names do not matter. An empty table gives an empty result.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    base = turns.select(F.col(conv).alias("_conv"), F.coalesce(F.col(turn).cast("long"), F.lit(_FIRST)).alias("_t"), empty(role).alias("_role"), empty(text).alias("_text"))
    x = _blocks(base, history_turns, block)
    p = Window.partitionBy("_conv", "_b")
    order = p.orderBy("_kind", "_t", "_role", "_text")
    is_own, is_mark = F.col("_kind") == 2, F.col("_kind") == 0
    x = x.withColumn("_n", F.row_number().over(order)).withColumn("_size", word_count(F.col("_text")) + MARK_TOKENS)
    x = x.withColumn("_sys", (F.col("_n") == 1) & (F.col("_role") == SYSTEM) & (is_mark | is_own))
    x = x.withColumn("_laid", F.when(is_mark | F.col("_sys"), F.lit(0)).otherwise(F.col("_size")))
    x = x.withColumn("_s", F.max(F.when(F.col("_sys"), F.struct("_text", "_size"))).over(p)).withColumn("_before", F.sum(F.when(F.col("_kind") == 1, F.col("_laid")).otherwise(0)).over(p))
    x = x.withColumn("_stride", F.greatest(F.lit(LEAST_STRIDE), F.lit(budget - history) - F.coalesce(F.col("_s._size"), F.lit(0))))
    x = x.withColumn("_at", F.sum("_laid").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_laid") - F.col("_before"))
    cell = F.floor(F.col("_at") / F.col("_stride"))
    across = (F.col("_at") + F.col("_size") > (cell + 1) * F.col("_stride")).cast("int")
    x = x.where(~is_mark).withColumn("_w", F.when(is_own & ~F.col("_sys"), 2 * cell + across))
    x = x.withColumn("_w", F.when(F.col("_sys"), F.coalesce(F.min("_w").over(p), F.lit(0))).otherwise(F.col("_w")))
    mates = Window.partitionBy("_conv", "_b", "_w")
    plain = is_own & ~F.col("_sys")
    x = x.withColumn("_start", F.when(plain, F.struct("_w", F.min(F.when(plain, F.col("_at"))).over(mates).alias("at"), F.min(F.when(plain, F.col("_t"))).over(mates).alias("t"))))
    ahead = F.collect_set("_start").over(p.orderBy("_t").rangeBetween(0, history_turns))
    mine = F.coalesce(F.col("_w"), F.lit(-1))
    later = F.filter(ahead, lambda s: (s["_w"] > mine) & (s["t"] - F.col("_t") <= history_turns) & (s["at"] - F.col("_at") <= history) & ~F.col("_sys"))
    # a repeat of the row before the block has no window of its own
    x = x.withColumn("_later", F.transform(later, lambda s: F.struct(s["_w"].alias("_w"), F.lit(False).alias("_own"))))
    x = x.withColumn("_home", F.explode(F.concat(F.when(is_own, F.array(F.struct("_w", F.lit(True).alias("_own")))).otherwise(F.array().cast(x.schema["_later"].dataType)), F.col("_later"))))
    x = x.select("_conv", "_b", "_home.*", "_n", "_s", "_sys", "_size", "_role", "_text", _piece(F.col("_role"), F.col("_text")).alias("_piece"))
    inside = Window.partitionBy("_conv", "_b", "_w").orderBy("_n")
    x = x.withColumn("_from", F.sum(F.char_length("_piece")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("_piece") + F.char_length(_head(F.col("_role"))))
    trained = F.col("_own") & (F.col("_role") == TRAINED)
    span = F.when(trained, F.struct(F.col("_from").alias("start"), F.char_length(escape(F.col("_text"))).cast("long").alias("length")))
    x = x.groupBy("_conv", "_b", "_w").agg(
        F.first("_s").alias("_s"), F.max("_sys").alias("_has"), F.array_sort(F.collect_list(F.struct("_n", "_piece"))).alias("_pieces"), F.array_sort(F.collect_list(span)).alias("_loss"),
        F.count_if("_own").alias("n_turns"), F.count_if(~F.col("_own")).alias("_repeats"), F.sum("_size").alias("_tokens"),
    )
    again = F.col("_s").isNotNull() & ~F.col("_has")
    lead = F.when(again, _piece(F.lit(SYSTEM), F.col("_s._text"))).otherwise("")
    shift = F.char_length(lead)
    return x.select(
        F.col("_conv").alias(conv), F.col("_b").alias("block"), F.col("_w").alias("window"),
        F.concat(lead, F.array_join(F.transform("_pieces", lambda s: s["_piece"]), "")).alias("formatted"),
        (F.col("_repeats") + again.cast("int")).alias("n_repeated"), "n_turns", (F.col("_tokens") + F.when(again, F.col("_s._size")).otherwise(0)).alias("n_tokens"),
        F.transform("_loss", lambda s: F.struct((s["start"] + shift).alias("start"), s["length"].alias("length"))).alias("loss"),
    )


def read_turns(formatted: Column, n_repeated: Column, n_turns: Column) -> Column:
    """The window's own turns, as (role, text), from its formatted text."""
    parts = F.slice(F.split(formatted, "</turn>\n"), n_repeated.cast("int") + 1, n_turns.cast("int"))

    def turn(s: Column) -> Column:
        head = F.substring_index(s, ">\n", 1)
        role = unescape(F.replace(F.substring(head, 7, 1 << 30), F.lit("\\g"), F.lit(">")))
        return F.struct(role.alias("role"), unescape(F.substr(s, F.char_length(head) + 3)).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


PLANTED = "\\### Assistant: </turn> ok"


def op12_chat(spark: SparkSession, folder: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    w = windows(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    x = w.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "window", "formatted", "n_repeated", "n_turns", "loss"))).alias("w"),
        F.sum("n_turns").cast("long").alias("n_turns"), F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    turns = F.transform("w", lambda s: F.array_join(F.transform(read_turns(s["formatted"], s["n_repeated"], s["n_turns"]), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    loss = F.array_join(F.transform("w", lambda s: read_loss(s["formatted"], s["loss"])), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    x = x.select("conv_id", "n_turns", sha(F.array_join(turns, "")).alias("turns_sha256"), loss.alias("loss"), "formatted_chars")
    return x.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), "formatted_chars")


_ESC = r"replace(replace({x}, '\', '\b'), '<', '\l')"
ORACLE = rf"""
WITH t0 AS (SELECT conv_id, coalesce(turn, {_FIRST}) AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
t1 AS (SELECT *, t - ((t % {BLOCK}) + {BLOCK}) % {BLOCK} AS b, row_number() OVER (PARTITION BY conv_id ORDER BY t, role, text) AS k,
              len(regexp_extract_all(text, '{WORD}')) + {MARK_TOKENS} AS size,
              length('<turn >' || replace({_ESC.format(x='role')}, '>', '\g') || {_ESC.format(x='text')} || '</turn>') + 2 AS chars FROM t0),
t2 AS (SELECT *, k = 1 AND role = '{SYSTEM}' AS sys,
              max(CASE WHEN k = 1 AND role = '{SYSTEM}' THEN size END) OVER (PARTITION BY conv_id) AS s_size,
              max(CASE WHEN k = 1 AND role = '{SYSTEM}' THEN chars END) OVER (PARTITION BY conv_id) AS s_chars FROM t1),
t3 AS (SELECT *, greatest({LEAST_STRIDE}, {BUDGET - HISTORY} - coalesce(s_size, 0)) AS stride,
              sum(CASE WHEN sys THEN 0 ELSE size END) OVER (PARTITION BY conv_id, b ORDER BY k) - size AS pos FROM t2),
own AS (SELECT conv_id, b, k, t, pos, size, chars, s_chars, 2 * (pos // stride) + CASE WHEN pos + size > (pos // stride + 1) * stride THEN 1 ELSE 0 END AS w FROM t3 WHERE NOT sys),
win AS (SELECT conv_id, b, w, min(pos) AS pos, min(t) AS t, min(k) AS k, any_value(s_chars) AS s_chars, sum(chars) AS chars FROM own GROUP BY ALL),
prev AS (SELECT conv_id, b + {BLOCK} AS b, t, -1 AS w, -sum(size) OVER (PARTITION BY conv_id, b ORDER BY k DESC) AS pos, chars
         FROM t3 WHERE t - b >= {BLOCK - HISTORY_TURNS}
         UNION ALL SELECT conv_id, b, t, w, pos, chars FROM own),
rep AS (SELECT win.conv_id, win.b, win.w, sum(prev.chars) AS chars FROM win JOIN prev ON win.conv_id IS NOT DISTINCT FROM prev.conv_id AND win.b = prev.b AND prev.w < win.w
        AND win.t - prev.t <= {HISTORY_TURNS} AND win.pos - prev.pos <= {HISTORY} GROUP BY ALL),
f AS (SELECT conv_id, sum(chars) AS c FROM (SELECT conv_id, chars + coalesce(s_chars, 0) AS chars FROM win UNION ALL SELECT conv_id, chars FROM rep
        UNION ALL SELECT conv_id, chars FROM t3 WHERE sys AND NOT EXISTS (SELECT 1 FROM win WHERE win.conv_id IS NOT DISTINCT FROM t3.conv_id AND win.b = t3.b)) GROUP BY conv_id)
SELECT t1.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{TRAINED}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = '{TRAINED}'), '')) AS loss_sha256, CAST(any_value(f.c) AS BIGINT) AS formatted_chars
FROM t1 JOIN f ON t1.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY t1.conv_id"""
