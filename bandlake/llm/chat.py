"""Chat formatting into budgeted, turn-aligned windows with a loss mask. Only DataFrame functions run here.

Template: ``[TURN]role[TEXT]text[END]`` per turn. Texts and roles are escaped so that no ``[`` or ``<`` is left in them:
backslash becomes ``\\e``, ``[`` becomes ``\\k`` and ``<`` becomes ``\\l``. Marks can therefore be found by plain splitting, and
chat control strings of any model (``</s>``, ``[INST]``, ``<|im_end|>``) never reach a tokenizer as such.

A window has room for the opening system turn and, beside it, for ``C`` tokens. A turn of more than ``C / 2`` is a window of its own; the
turns between those are cut where their prefix sums pass a multiple of ``C / 2``, so that a window's turns never exceed ``C``.

Prefix sums over turn tokens are taken in two levels, blocks of turn numbers first, so that a conversation with a large part of
all turns is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .mixing import word_count

TURN, TEXT, END = "[TURN]", "[TEXT]", "[END]"
#: Tokens that the marks of a turn count for.
MARK_TOKENS = 4
#: Turn numbers in a block of the prefix sums.
BLOCK = 64


def escape(text: Column) -> Column:
    """Reversible: no ``[`` and no ``<`` is left."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("["), F.lit("\\k")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\k"), F.lit("[")), F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escape(role), F.lit(TEXT), escape(text), F.lit(END))


def number_turns(turns: DataFrame, budget: int) -> DataFrame:
    """Adds ``idx`` (place in the conversation, from 0), ``before`` (tokens of the turns before it), ``system`` (tokens of an opening
    system turn of at most half the budget, else 0), ``long`` (too long to share a window) and ``longs`` (long turns before it).
    """
    held = turns.withColumn("tokens", word_count(F.col("text")) + MARK_TOKENS).withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 62))) / BLOCK))
    heads = held.groupBy("conv_id", "block").agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("head")).groupBy("conv_id").agg(F.min_by("head", "block").alias("head"))
    opens = (F.col("head.role") == "system") & (2 * F.col("head.tokens") <= budget)
    heads = heads.select(F.col("conv_id").alias("c"), F.when(opens, F.col("head.tokens")).otherwise(0).alias("system"))
    held = held.join(heads, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").withColumn("long", 2 * F.col("tokens") > budget - F.col("system"))
    blocks = held.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("c"), F.count_if("long").alias("l"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("conv_id", "block", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}0") for x in "tcl"])
    placed = held.alias("h").join(starts.alias("s"), F.col("h.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("h.block") == F.col("s.block")))
    inside = Window.partitionBy("h.conv_id", "h.block").orderBy("h.turn", "h.role", "h.text")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    idx = F.col("s.c0") + F.row_number().over(inside) - 1
    opening = (idx == 0) & (F.col("h.system") > 0)
    return placed.select(
        "h.conv_id", "h.turn", "h.role", "h.text", "h.tokens", "h.system", idx.alias("idx"),
        (F.col("s.t0") + F.coalesce(F.sum("h.tokens").over(upto), F.lit(0))).alias("before"), (F.col("h.long") & ~opening).alias("long"),
        # an opening system turn of above C / 2 is the first of all, so it is one too many for every turn after it, which changes no order
        (F.col("s.l0") + F.coalesce(F.sum(F.col("h.long").cast("long")).over(upto), F.lit(0))).alias("longs"),
    )


def chat_windows(turns: DataFrame, *, budget: int = 512, history: int = 2, target_role: str = "assistant") -> DataFrame:
    """One row per window: conv_id, window, tokens, text, spans (array of idx, start, length, loss, carried), ordered as in the text.

    ``turns`` has conv_id, turn, role, text. Every turn is its own in one window, which is named by its first own turn's idx. Later
    windows first repeat the conversation's opening system turn, if it has half the budget at most, and up to ``history`` of the turns before them, the last ones
    that fit; those are ``carried`` and never in the loss. ``tokens`` are words plus ``MARK_TOKENS`` of each turn, own and carried, and are
    ``budget`` at most, but for a window that has one own turn above the budget and nothing else; a system turn that doesn't fit
    beside a long turn is left out there. ``loss`` marks the target role's texts in the window that owns
    them: ``start`` and ``length`` are code points of the escaped text inside ``text``. Null text or role is empty; a null
    conv_id is a conversation of its own; equal turn numbers are ordered by role and text, and repeated rows all stay;
    an empty table gives no rows; further columns are ignored.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    room = budget - F.col("system")
    part = F.when(F.col("long"), F.struct((2 * F.col("longs") + 1).alias("run"), F.lit(0).cast("long").alias("bin")))
    part = part.otherwise(F.struct((2 * F.col("longs")).alias("run"), F.floor(2 * F.greatest(F.col("before") - F.col("system"), F.lit(0)) / room).alias("bin")))
    numbered = settle(number_turns(clean, budget).withColumn("part", part), "chat-turns")
    first = settle(numbered.groupBy("conv_id", "part").agg(F.min("idx").alias("window"), F.sum("tokens").alias("own"), F.max("system").alias("system")), "chat-parts")
    same = F.col("n.conv_id").eqNullSafe(F.col("f.conv_id"))
    own = numbered.alias("n").join(first.alias("f"), same & (F.col("n.part") == F.col("f.part"))).select("n.conv_id", "f.window", "n.idx", "n.role", "n.text", "n.tokens", F.lit(False).alias("carried"))
    later = first.where("window > 0").withColumn("fixed", F.when(F.col("system") + F.col("own") <= budget, F.col("system")).otherwise(0))
    opening = numbered.where("idx = 0 AND system > 0")
    system = opening.alias("n").join(later.where("fixed > 0").alias("f"), same).select("n.conv_id", "f.window", "n.idx", "n.role", "n.text", "n.tokens", F.lit(True).alias("carried"))
    pieces = own.unionByName(system)
    if history:
        spare = later.withColumn("spare", budget - F.col("fixed") - F.col("own")).where(F.col("spare") >= MARK_TOKENS)
        wanted = spare.select("conv_id", "window", "spare", F.explode(F.sequence(F.greatest(F.col("window") - history, F.lit(0)), F.col("window") - 1)).alias("at"))
        back = numbered.where("idx > 0 OR system = 0").alias("n").join(wanted.alias("f"), same & (F.col("n.idx") == F.col("f.at")))
        total = F.sum("tokens").over(Window.partitionBy("conv_id", "window").orderBy(F.desc("idx")))
        back = back.select("n.conv_id", "f.window", "n.idx", "n.role", "n.text", "n.tokens", F.lit(True).alias("carried"), "f.spare").withColumn("total", total)
        pieces = pieces.unionByName(back.where("total <= spare").drop("total", "spare"))
    piece = F.struct("idx", "role", _render(F.col("role"), F.col("text")).alias("text"), F.length(escape(F.col("role"))).alias("skip"), "carried")
    grouped = pieces.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.sum("tokens").cast("long").alias("tokens"))
    lengths = F.transform("p", lambda x: F.length(x["text"]))
    placed = F.transform(
        "p",
        lambda x, i: F.struct(
            x["idx"].alias("idx"),
            (F.aggregate(F.slice(lengths, 1, i), F.lit(1), lambda s, v: s + v) + x["skip"] + len(TURN + TEXT)).alias("start"),
            (F.length(x["text"]) - x["skip"] - len(TURN + TEXT + END)).alias("length"),
            ((x["role"] == target_role) & ~x["carried"]).alias("loss"),
            x["carried"].alias("carried"),
        ),
    )
    return grouped.select("conv_id", "window", "tokens", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), placed.alias("spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, parsed from the windows' text by its marks and from the loss spans.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline per turn), loss_chars, loss_sha256, formatted_chars.
    """
    parts = F.filter(F.split("text", r"\[TURN\]"), lambda x: x != "")
    owned = F.slice(parts, F.size(F.filter("spans", lambda s: s["carried"])) + 1, F.greatest(F.size(parts), F.lit(1)))
    plain = F.transform(owned, lambda x: F.concat(unescape(F.substring_index(x, TEXT, 1)), F.lit("\n"), unescape(F.replace(F.substring_index(x, TEXT, -1), F.lit(END), F.lit(""))), F.lit("\n")))
    loss = F.transform(F.filter("spans", lambda s: s["loss"]), lambda s: unescape(F.substring("text", s["start"], s["length"])))
    each = windows.select("conv_id", "window", F.size(owned).alias("n"), F.array_join(plain, "").alias("turns"), F.array_join(loss, "").alias("loss"), F.length("text").alias("chars"))
    joined = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"))
    return whole.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(joined("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
