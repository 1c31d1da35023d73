"""Chat formatting into budgeted windows, in DataFrame functions only.

A conversation's turns (ordered by turn, then role and text) become training
windows of at most BUDGET tokens.  Prefix sums of turn tokens choose
turn-aligned spans; each window holds the system turn, up to HISTORY_TURNS
turns (at most HISTORY_TOKENS tokens) repeated from the span before, and its
own span.  Only assistant texts of the window's own span are under the loss
mask, so every assistant text is a target exactly once.

Turn tokens are an estimate, code points divided by four.  Spans are cut at
multiples of a stride, half of what the budget leaves after the system turn
and the history, and a turn longer than the stride is a span of its own.  A
span of shorter turns starts below one multiple and ends below the next but
one, so it fits; history is repeated where the window has room for it.  So
`over_budget` means a turn that doesn't fit into the budget together with the
system turn.  A system turn longer than half the budget is not repeated.

Template: `### Role: text </turn>` and a newline, `~` before the role of a
repeated turn.  In roles and texts `\\` becomes `\\\\`, `###` becomes `\\h`
and `</turn>` becomes `\\e` (in roles also `:` `\\c` and `~` `\\s`), so no
control string survives inside a turn and reading back is exact.

All window functions share one exchange on the conversation.  A window's
row is bounded by the budget; `read_back` gathers windows, and its caller may
gather a conversation, whose size is that of its own text.

Defined results: null text and null role are empty; turns with equal numbers
are ordered by role and text and all kept; a null conv_id is a conversation;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY_TOKENS, HISTORY_TURNS = 2048, 256, 2
CHARS_PER_TOKEN = 4
OPEN, REPEATED, SEP, CLOSE = "### ", "~", ": ", " </turn>\n"
_SYSTEM, _HISTORY, _OWN = 0, 1, 2
#: plain -> code, in the order of escaping
_CODES = [("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e")]
_ROLE_CODES = [*_CODES, (":", "\\c"), ("~", "\\s")]


def escaped(c: Column, codes=_CODES) -> Column:
    for plain, code in codes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, codes=_CODES) -> Column:
    """Exact inverse: doubled backslashes are split off first, from the left."""
    def plain(part):
        for text, code in codes[1:]:
            part = F.replace(part, F.lit(code), F.lit(text))
        return part
    return F.array_join(F.transform(F.split(c, r"\\\\"), plain), "\\")


def format_windows(turns: DataFrame, *, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS,
                   history_turns: int = HISTORY_TURNS) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss (array of
    start, length in code points, from 0), n_own, tokens, over_budget."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = F.concat(escaped(role, _ROLE_CODES), F.lit(SEP))
    rows = turns.select(
        "conv_id", F.col("turn").alias("__turn"), role.alias("__role"), text.alias("__text"),
        body.alias("__head"), escaped(text).alias("__body"))
    rows = rows.withColumn("__cost", F.ceil((F.length("__head") + F.length("__body") + len(OPEN) + len(CLOSE))
                                            / CHARS_PER_TOKEN).cast("long"))
    conv = Window.partitionBy("conv_id").orderBy("__turn", "__role", "__text")
    whole = Window.partitionBy("conv_id")
    rows = (rows.withColumn("__rn", F.row_number().over(conv))
            .withColumn("__before", F.coalesce(F.sum("__cost").over(
                conv.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("__system", (F.col("__rn") == 1) & (F.col("__role") == "system")
                        & (F.col("__cost") <= budget // 2)))
    rows = rows.withColumn("__reserve", F.max(F.when(F.col("__system"), F.col("__cost")).otherwise(0)).over(whole))
    stride = F.greatest(F.floor((budget - history_tokens - F.col("__reserve")) / 2), F.lit(1))
    rows = rows.withColumn("__cell", F.floor(F.col("__before") / stride))
    in_order = Window.partitionBy("conv_id").orderBy("__rn")
    rows = rows.withColumn("__long", F.col("__cost") > stride)
    step = ((F.col("__cell") != F.lag("__cell", 1).over(in_order)) | F.col("__long")
            | F.lag("__long", 1).over(in_order)).cast("int")
    step = F.when(F.col("__rn") > 1, step)
    rows = rows.withColumn("__step", F.coalesce(step, F.lit(0)))
    rows = rows.withColumn("__span", F.sum("__step").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__last", F.max("__span").over(whole))
    from_end = Window.partitionBy("conv_id", "__span").orderBy(F.desc("__rn"))
    rows = (rows.withColumn("__from_end", F.row_number().over(from_end))
            .withColumn("__tail", F.sum("__cost").over(from_end.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("__next", F.sum("__cost").over(Window.partitionBy("conv_id").orderBy("__span").rangeBetween(1, 1))))
    def place(span, kind):
        return F.struct(span.cast("long").alias("window"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<window:bigint,kind:int>>")
    follows = F.col("__span") < F.col("__last")
    places = F.concat(
        F.array(place(F.col("__span"), _OWN)),
        F.when(follows & ~F.col("__system") & (F.col("__from_end") <= history_turns)
               & (F.col("__tail") <= F.least(F.lit(history_tokens), budget - F.col("__reserve") - F.col("__next"))), F.array(place(F.col("__span") + 1, _HISTORY))).otherwise(none),
        F.when(F.col("__system") & (F.col("__last") > 0), F.transform(
            F.sequence(F.lit(1).cast("long"), F.greatest(F.col("__last").cast("long"), F.lit(1).cast("long"))),
            lambda s: place(s, _SYSTEM))).otherwise(none))
    rows = rows.withColumn("__at", F.explode(places)).select("*", "__at.window", "__at.kind")
    head = F.concat(F.lit(OPEN), F.when(F.col("kind") == _OWN, "").otherwise(REPEATED), F.col("__head"))
    rows = rows.withColumn("__open", head).withColumn(
        "__size", (F.length("__open") + F.length("__body") + len(CLOSE)).cast("long"))
    inside = Window.partitionBy("conv_id", "window").orderBy("kind", "__rn")
    rows = rows.withColumn("__start", F.coalesce(F.sum("__size").over(
        inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("__open"))
    target = (F.col("kind") == _OWN) & (F.col("__role") == "assistant")
    piece = F.struct("kind", "__rn", F.concat("__open", "__body", F.lit(CLOSE)).alias("s"), target.alias("target"),
                     F.col("__start").cast("long").alias("start"), F.length("__body").cast("long").alias("length"))
    out = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(piece)).alias("__p"), F.sum("__cost").alias("tokens"),
        F.sum((F.col("kind") == _OWN).cast("long")).alias("n_own"))
    return out.select(
        "conv_id", "window", F.array_join(F.transform("__p", lambda p: p["s"]), "").alias("formatted"),
        F.transform(F.filter("__p", lambda p: p["target"]),
                    lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("loss"),
        "n_own", "tokens", (F.col("tokens") > budget).alias("over_budget"))


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted windows hold: conv_id, window, turns (array of
    role, text: the window's own turns) and targets (the unmasked texts)."""
    parts = F.filter(F.split("formatted", CLOSE), lambda p: p.startswith(OPEN))
    own = F.filter(parts, lambda p: ~p.startswith(OPEN + REPEATED))
    def turn(p):
        p = F.substring(p, len(OPEN) + 1, 2147483647)
        role = F.substring_index(p, SEP, 1)
        return F.struct(unescaped(role, _ROLE_CODES).alias("role"),
                        unescaped(p.substr(F.length(role) + len(SEP) + 1, F.length(p))).alias("text"))
    def masked(m):
        return unescaped(F.col("formatted").substr((m["start"] + 1).cast("int"), m["length"].cast("int")))
    return windows.select("conv_id", "window", F.length("formatted").cast("long").alias("formatted_chars"),
                          F.transform(own, turn).alias("turns"), F.transform("loss", masked).alias("targets"))


def digests(read: DataFrame) -> DataFrame:
    """Per conversation the digests of what was read back.  One row gathers a
    conversation, because a digest runs over its whole text."""
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.select("conv_id", "window", "formatted_chars", F.size("turns").cast("long").alias("n"),
                       spoken.alias("spoken"), F.array_join("targets", "").alias("loss"))
    got = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "spoken", "loss"))).alias("w"),
        F.sum("n").alias("n_turns"), F.sum(F.length("loss").cast("long")).alias("loss_chars"),
        F.sum("formatted_chars").alias("formatted_chars"))
    def joined(field):
        return F.sha2(F.array_join(F.transform("w", lambda x: x[field]), "").cast("binary"), 256)
    return got.select("conv_id", "n_turns", joined("spoken").alias("turns_sha256"), "loss_chars",
                      joined("loss").alias("loss_sha256"), "formatted_chars")
