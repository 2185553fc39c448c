"""Chat formatting into budgeted windows, in DataFrame functions only.

A turn is written as `<|im_start|>role\\ntext<|im_end|>\\n`. Inside texts a backslash is doubled and `<|` becomes `<\\|`, so no control
string can occur there; roles are percent-encoded.

1. A conversation is cut into parts of `part_turns` to twice as many turns, so one with a third of all rows is many rows of bounded length. Turns are counted by blocks of turn numbers; blocks with gaps are
   put together by running sums of their counts, and one that holds more turns than numbers (equal ones) is cut by the turns' ranks. Only conversations that need it travel for that.
2. Prefix sums of a part's tokens choose spans of whole turns that fit the budget; a span doesn't cross parts.
3. Every window starts with the leading system turn, repeats some turns before its span as history (of the part before, where the span
   starts a part) and then has the span itself. The loss mask covers the assistant texts of the span alone: each target once over all windows.

Only the first turn and the last few of each part travel between parts, and only for conversations of several parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskframe.operators.collections import with_group_index, with_running_sums

from .common import saved

#: Bytes of history that are broadcast at most.
BROADCAST = 8_000_000
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def token_estimate(text: Column) -> Column:
    """One token for four bytes and four for the marks of a turn."""
    return F.ceil(F.octet_length(text) / 4) + 4


def _fixed(df: DataFrame, **columns: str) -> DataFrame:
    """df with SQL columns that are computed once a row: without the generator between, a lambda that reads one would compute it again for each element."""
    one = F.explode(F.array(F.struct(*(F.expr(e).alias(n) for n, e in columns.items())))).alias("__fixed")
    return df.select("*", one).select(*df.columns, *(F.col("__fixed")[n].alias(n) for n in columns))


def _before(parts: DataFrame, history: int) -> DataFrame:
    """conv_id, part, n_before (parts before it), lead (the conversation's system turn; null if none) and past (the last turns before the part), for all parts but
    the first of each conversation."""
    long = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    ends = parts.join(long, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select(
        "conv_id", "part", F.col("turns")[0].alias("first"),
        F.expr(f"slice(turns, greatest(size(turns) - {history} + 1, 1), {history})").alias("tail"), F.expr(f"slice(turns, greatest(size(turns) - {history} + 1, 2), {history})").alias("rest"),
    )
    by = W.partitionBy("conv_id").orderBy(F.col("part").asc_nulls_first())
    ends = ends.withColumns({"n_before": F.row_number().over(by) - 1, "lead": F.first("first").over(by)})
    lead = F.when(F.col("lead.role") == "system", F.col("lead"))
    # the system turn stands in front of every window and is not history as well; parts may be shorter than the history
    ends = ends.withColumns({"lead": lead, "tail": F.when((F.col("n_before") == 0) & lead.isNotNull(), F.col("rest")).otherwise(F.col("tail"))})
    past = F.flatten(F.collect_list("tail").over(by.rowsBetween(-max(history, 1), -1)))
    found = ends.withColumn("past", past).where("n_before > 0")
    return found.select("conv_id", "part", "n_before", "lead", F.expr(f"slice(past, greatest(size(past) - {history} + 1, 1), {history})").alias("past"))


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast where it is measured to be small."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST else df


def _parted(turn: DataFrame, part_turns: int) -> DataFrame:
    """turn (conv_id, block, t) with `part` in the place of block. A conversation whose blocks are parts as they stand keeps their numbers."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    blocks = saved(turn.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")), "chat-blocks")
    several = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("blocks"), F.max("n").alias("most")).where((F.col("blocks") > 1) | (F.col("most") > 2 * part_turns))
    summed = with_running_sums(blocks.join(several.select(F.col("conv_id").alias("c")), same("conv_id", "c"), "left_semi"), {"upto": "n"}, "conv_id", "block")
    start = summed.groupBy(F.col("conv_id").alias("c")).agg(F.min(F.col("upto") - F.col("n")).alias("start"))
    placed = summed.join(start, same("conv_id", "c")).select("conv_id", "block", "n", (F.col("upto") - F.col("n") - F.col("start")).alias("offset"))
    placed = saved(placed.withColumn("at", F.floor(F.col("offset") / part_turns)), "chat-places")
    odd = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("at").alias("parts"), F.max("n").alias("most")).where((F.col("parts") < F.col("n")) | (F.col("most") > 2 * part_turns))
    place = saved(placed.join(odd.select(F.col("conv_id").alias("o")), same("conv_id", "o"), "left_semi").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "n", "offset", "at"), "chat-odd")
    if place.isEmpty():
        return turn.withColumnRenamed("block", "part")
    met = turn.join(_small(place, 48), same("conv_id", "c") & same("block", "b"), "left")
    fits = met.where(F.coalesce(F.col("n") <= 2 * part_turns, F.lit(True))).select("conv_id", F.when(F.col("n").isNull(), F.col("block")).otherwise(F.col("at")).alias("part"), "t")
    if place.where(F.col("n") > 2 * part_turns).isEmpty():
        return fits
    long = with_group_index(met.where(F.col("n") > 2 * part_turns).select("conv_id", "block", "offset", "t"), "rank", ["conv_id", "block"], "t.turn", "t.role", "t.text")
    return fits.unionByName(long.select("conv_id", F.floor((F.col("offset") + F.col("rank")) / part_turns).alias("part"), "t"))


def chat_windows(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = 512, history_tokens: int = 128, history_turns: int = 4, tokens: Column | None = None, part_turns: int = 64,
) -> DataFrame:
    """conv_id, part, window (number within the part), n_context (turns repeated in front), n_turns (turns of the span), n_tokens, formatted, loss
    (start, length of each masked-in text, in code points from 0). Windows of a conversation are in order by (part, window).

    Turns are ordered by turn (a whole number; nulls first), then role, then text; repeated rows are turns of their own. Null texts and roles are empty. A null
    conv_id is a conversation like any other. No turn is cut: where the system turn and one other exceed the budget, or one turn does,
    the window exceeds it too. Gaps in the numbers and equal numbers change no part's bound. An empty table gives an empty
    result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turn = turns.select(
        F.col(conv_col).alias("conv_id"), F.floor(F.col(turn_col).cast("long") / part_turns).alias("block"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), text.alias("text"), (token_estimate(text) if tokens is None else tokens).cast("long").alias("tokens")).alias("t"),
    )
    parts = saved(_parted(turn, part_turns).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns")), "chat-parts")
    known = saved(_before(parts, history_turns).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "n_before", "lead", "past"), "chat-history")
    held = known.agg(F.sum(F.octet_length(F.to_json(F.struct("lead", "past"))) + 64)).first()[0] or 0
    if held <= BROADCAST:  # measured; beyond it the join shuffles the parts once more
        known = F.broadcast(known)
    met = parts.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    # own: 1 where the system turn is the part's first turn
    met = _fixed(
        met.select("conv_id", F.coalesce("n_before", F.lit(0)).alias("part"), "lead", "past", "turns", F.expr("int(n_before is null and turns[0].role = 'system')").alias("own")),
        system="if(own = 1, turns[0], lead)", line="if(past is null, turns, concat(past, turns))", low="if(past is null, own, size(past))",
    )
    met = _fixed(
        met.select("conv_id", "part", "own", "system", "line", "low"),
        room=f"greatest({budget}L - coalesce(system.tokens, 0L), 1L)",
        # sums[k] is the number of tokens before turn k
        sums="aggregate(line, array(0L), (s, t) -> array_append(s, element_at(s, -1) + t.tokens))",
    )
    # first turn of each span: a turn starts a new one when it would take the span past the room that history leaves
    met = _fixed(
        met,
        starts=f"""aggregate(sequence(low, greatest(size(line) - 1, low)),
            named_struct('base', sums[low], 'room', if(part = 0, room, greatest(room - {history_tokens}L, 1L)), 'at', array(low)),
            (s, k) -> if(k > low and k < size(line) and sums[k + 1] - s.base > s.room,
                named_struct('base', sums[k], 'room', greatest(room - {history_tokens}L, 1L), 'at', array_append(s.at, k)), s)).at""",
    )
    met = _fixed(met, spans="transform(starts, (f, i) -> struct(f as first, coalesce(get(starts, i + 1), size(line)) as next))")
    past = f"filter(sequence(greatest(s.first - {history_turns}, own), s.first), k -> k = s.first or sums[s.first] - sums[k] <= least({history_tokens}L, room - sums[s.next] + sums[s.first]))[0]"
    met = _fixed(met, cuts=f"transform(spans, s -> struct(s.first, s.next, {past} as past))")
    picked = """transform(cuts, (s, i) -> struct(
        if(own = 1 and i = 0, 0, int(system is not null)) + s.first - s.past as context,
        concat(if(system is null, array(), array(struct(system as t, own = 1 and i = 0 as own))),
            transform(slice(line, s.past + 1, s.next - s.past), (t, j) -> struct(t, j >= s.first - s.past as own))) as picked))"""
    spans = met.select("conv_id", "part", F.posexplode(F.expr(picked)).alias("window", "w"))
    piece = F.transform(
        "w.picked",
        lambda p: F.struct(
            F.concat(F.lit(START), F.url_encode(p["t"]["role"]), F.lit("\n")).alias("head"),
            escaped(p["t"]["text"]).alias("body"),
            (p["own"] & (p["t"]["role"] == "assistant")).alias("target"),
            p["t"]["tokens"].alias("tokens"),
        ),
    )
    spans = spans.select("conv_id", "part", "window", F.col("w.context").alias("n_context"), F.explode(F.array(piece)).alias("pieces"))
    tail = F.lit(END + "\n")
    size = len(END) + 1
    loss = f"""aggregate(pieces, named_struct('at', 0L, 'loss', cast(array() as array<struct<start: bigint, length: bigint>>)),
        (s, p) -> named_struct('at', s.at + length(p.head) + length(p.body) + {size}L,
            'loss', if(p.target, array_append(s.loss, named_struct('start', s.at + length(p.head), 'length', bigint(length(p.body)))), s.loss))).loss"""
    return spans.select(
        "conv_id", "part", "window", "n_context", (F.size("pieces") - F.col("n_context")).alias("n_turns"),
        F.expr("aggregate(pieces, 0L, (s, p) -> s + p.tokens)").alias("n_tokens"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], tail)), "").alias("formatted"), F.expr(loss).alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Windows read back from their text: conv_id, turns (role, text; repeated turns left out), loss_text, formatted_chars. One row a conversation, which
    its whole text is gathered for."""
    parts = F.expr(f"slice(split(formatted, '{START.replace('|', '[|]')}'), 2, 1000000000)")
    turn = F.transform(
        parts,
        lambda x: F.struct(
            F.url_decode(F.substring_index(x, "\n", 1)).alias("role"),
            unescaped(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x) - F.length(F.substring_index(x, "\n", 1)) - len(END) - 2)).alias("text"),
        ),
    )
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    one = windows.select("conv_id", "part", "window", F.length("formatted").alias("chars"), F.array_join(masked, "").alias("loss_text"), F.slice(turn, F.col("n_context") + 1, 1000000000).alias("turns"))
    whole = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "window", "turns", "loss_text", "chars"))).alias("w"))
    return whole.select(
        "conv_id", F.flatten(F.col("w.turns")).alias("turns"), F.array_join(F.col("w.loss_text"), "").alias("loss_text"),
        F.expr("aggregate(w, 0L, (s, x) -> s + x.chars)").alias("formatted_chars"),
    )
