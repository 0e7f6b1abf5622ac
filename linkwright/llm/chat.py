"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation at turns into spans: a turn
belongs to the span in which its first token falls, so a span holds about
``budget`` new tokens and turns are never split. Each window has the system turn,
then the last turns of the span before it (up to ``history`` tokens) as masked
context, then its own turns. The loss mask covers assistant turns of the window's
own span only, so every assistant text is a target once.

Control strings in roles and texts get one more backslash after their first
character, which reading back takes away again: the map is one to one.

Edge cases: a null text or role is empty; rows are ordered by turn (null
first), then role, then text; repeated rows are turns of their own; a null
conv_id is a conversation; an empty table gives no windows; other columns are
ignored. A conversation's text is one value per window, so one window has to fit
in memory; the digest of a conversation needs its own turns together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.shared import word_count

#: Control strings: an opening character, backslashes, then one of these rests.
CONTROL = r"([<\[])(\\*)(?=\||/?s>|/?INST\])"
CONTROL_READ = r"([<\[])(\\*)\\(?=\||/?s>|/?INST\])"
TURN = r"(?s)<\|(ctx|new)\|>(.*?)\n(.*?)<\|end\|>\n"
HEAD = {True: "<|new|>", False: "<|ctx|>"}
FOOT = "<|end|>\n"
TURN_OVERHEAD = 4


def escape(text: Column) -> Column:
    """Texts in which no control string of the template remains."""
    return F.regexp_replace(text, CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_READ, r"$1$2")


def escape_role(role: Column) -> Column:
    """As escape(), and on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<|nl|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|nl|>"), F.lit("\n")))


def windows(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per window: conv_id, window, formatted, loss.

    ``loss`` lists [start, end) in code points of ``formatted``.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", word_count(F.col("text")) + TURN_OVERHEAD)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("ord", F.row_number().over(order)).withColumn("end", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("start", F.col("end") - F.col("tokens"))
    t = t.withColumn("_cut", F.floor(F.col("start") / budget))
    t = t.withColumn("span", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("_cut")) - 1)
    whole = Window.partitionBy("conv_id")
    t = t.withColumn("spans", F.max("span").over(whole) + 1)
    t = t.withColumn("span_end", F.max("end").over(Window.partitionBy("conv_id", "span")))
    leads = (F.col("ord") == 1) & (F.col("role") == "system")
    own = F.array(F.struct(F.col("span").alias("w"), F.lit(True).alias("new")))
    later = F.struct((F.col("span") + 1).alias("w"), F.lit(False).alias("new"))
    is_history = (F.col("span") + 1 < F.col("spans")) & (F.col("span_end") - F.col("start") <= history)
    kept = F.transform(F.sequence(F.lit(1), F.greatest(F.col("spans") - 1, F.lit(1))), lambda w: F.struct(w.alias("w"), F.lit(False).alias("new")))
    places = F.when(leads & (F.col("spans") > 1), F.concat(own, kept)).when(is_history & ~leads, F.concat(own, F.array(later))).otherwise(own)
    placed = t.select("conv_id", "ord", "role", "text", F.explode(places).alias("p")).select("conv_id", "ord", "role", "text", F.col("p.w").alias("window"), F.col("p.new").alias("new"))
    body = F.concat(F.when(F.col("new"), HEAD[True]).otherwise(HEAD[False]), escape_role(F.col("role")), F.lit("\n"))
    placed = placed.select("conv_id", "window", F.struct("ord", body.alias("head"), escape(F.col("text")).alias("body"), (F.col("new") & (F.col("role") == "assistant")).alias("target")).alias("t"))
    made = placed.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    made = made.withColumn("sizes", F.transform("ts", lambda x: (F.length(x["head"]) + F.length(x["body"]) + len(FOOT)).cast("long")))
    at = F.transform("ts", lambda x, i: F.struct(x["target"].alias("target"), (F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b) + F.length(x["head"])).alias("from"), F.length(x["body"]).cast("long").alias("n")))
    loss = F.transform(F.filter(at, lambda x: x["target"]), lambda x: F.struct(x["from"].alias("start"), (x["from"] + x["n"]).alias("end")))
    text = F.array_join(F.transform("ts", lambda x: F.concat(x["head"], x["body"], F.lit(FOOT))), "")
    return made.select("conv_id", "window", text.alias("formatted"), loss.alias("loss"))


def read_back(made: DataFrame) -> DataFrame:
    """Parses windows again: per window its own turns and the texts under the loss mask, unescaped."""
    new = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1))
    turns = F.arrays_zip(new.alias("kind"), F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2)).alias("role"), F.regexp_extract_all("formatted", F.lit(TURN), F.lit(3)).alias("text"))
    own = F.transform(F.filter(turns, lambda x: x["kind"] == "new"), lambda x: F.struct(unescape_role(x["role"]).alias("role"), unescape(x["text"]).alias("text")))
    loss = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int"))))
    return made.select("conv_id", "window", own.alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("long").alias("chars"))


def digest_conversations(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row per conversation, all read back from the formatted windows."""
    back = read_back(windows(turns, budget, history))
    text = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    per = back.select("conv_id", F.struct("window", F.size("turns").alias("n"), text.alias("text"), "loss_text", "chars").alias("w"))
    per = per.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    joined = lambda name: F.array_join(F.transform("ws", lambda w: w[name]), "")
    total = lambda name: F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w[name])
    return per.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(joined("text").cast("binary"), 256).alias("turns_sha256"),
        F.length(joined("loss_text")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss_text").cast("binary"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )
