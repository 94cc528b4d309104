r"""Chat formatting in budgeted windows.

A turn becomes ``<|:role|>\n`` text ``<|end|>\n``.  Inside roles and texts a backslash
goes into every control string (``<|``, ``|>``, ``</s>``, ``[INST]`` and their kin), one
more than the text had there, which ``unescape`` takes away again.

Prefix sums of turn tokens choose the window of each turn, so a window is a whole
number of turns and no turn waits for the choice made for another.  A conversation's
first turn, if it is the system's, stands in front of every window.  The turn before
a window is repeated in it if it fits the history budget.  Repeats are masked: each
assistant text is under the loss mask once.

The prefix sums run in two levels, inside segments of a conversation and over the
segments' sums, so one long conversation is spread over many tasks, and a window,
the only thing gathered, is bounded by the budget.  A caller that needs conversations
in one place anyway asks for them ``together`` and saves that.

Defined results: null texts and roles count as empty; a null conversation id is a
conversation of its own; rows with the same turn are taken by role and text; null
turns come first.  A window whose last turn is longer than half the budget may exceed
it and says so in ``over_budget``; turns are never cut.  An empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET = 1024
HISTORY = 192
#: Turn numbers in one segment of the prefix sums.
SEGMENT = 64
#: Tokens that a turn's marks count.
MARKS = 4

#: What opens a control string, and what follows it.
OPENERS, TAILS = r"[<\[|]", r"(?=\||>|/?s>|/?INST\])"
END = "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({OPENERS})(\\*){TAILS}", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({OPENERS})\\(\\*){TAILS}", "$1$2")


def n_tokens(text: Column) -> Column:
    """Words and punctuation marks; a stand-in for a tokenizer that SQL can run."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")).cast("long") + MARKS


def place(turns: DataFrame, together: bool) -> DataFrame:
    """``turns`` with ``start``, the tokens of their conversation before them, its total, its system turn and that of the row before."""
    number = F.coalesce("turn", F.lit(-(1 << 63)))
    system = F.when(F.col("role") == "system", F.struct(number.alias("turn"), "text", "tokens"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    leads = F.col("system.turn") == F.col("first")
    lead = {"lead": F.coalesce(F.when(leads, F.col("system.tokens")), F.lit(0)), "system": F.when(leads, F.col("system.text"))}
    if together:
        whole = Window.partitionBy("key")
        inside = whole.orderBy(*order)
        found = turns.withColumns({
            "start": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"),
            "ahead": F.lag("tokens").over(inside),
        })
        found = found.withColumns({"total": F.sum("tokens").over(whole), "first": F.min(number).over(whole), "system": F.min(system).over(whole)})
        return found.withColumns(lead).drop("first")
    turns = turns.withColumn("segment", F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 62))) / SEGMENT).cast("long"))
    inside = Window.partitionBy("key", "segment").orderBy(*order)
    within = turns.withColumns({"within": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"), "ahead": F.lag("tokens").over(inside)})
    sums = turns.groupBy("key", "segment").agg(F.sum("tokens").alias("sum"), F.min(number).alias("first"), F.min(system).alias("system"))
    whole = Window.partitionBy("key")
    running = whole.orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({"before": F.sum("sum").over(running) - F.col("sum"), "total": F.sum("sum").over(whole), "first": F.min("first").over(whole), "system": F.min("system").over(whole)})
    sums = sums.withColumns(lead).drop("sum", "first")
    return within.join(sums, ["key", "segment"]).withColumn("start", F.col("before") + F.col("within")).drop("segment", "within", "before")


def format_chats(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    together: bool = False,
) -> DataFrame:
    """(conversation, conv_id, window, formatted, n_turns, n_repeated, loss_spans, n_tokens, over_budget), a row per window.

    ``loss_spans`` are (start, end) code points of ``formatted``; the first
    ``n_repeated`` turns are repeats.  ``conversation`` is the id as text that tells
    null apart.  With ``together`` a conversation's windows are made in one task, which
    moves texts once; without, a long conversation is spread and texts move twice.
    """
    conv = F.col(f"`{conv_col}`")
    turns = df.select(
        F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("key"),
        conv.alias("conv"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    ).withColumn("tokens", n_tokens(F.col("text")))

    # A window takes the turns that start in its share; the last may reach into the next.
    quota = F.greatest(F.floor((F.lit(budget) - F.col("lead") - history) / 2), F.lit(budget // 4))
    end = F.col("start") + F.col("tokens")
    own, after = F.floor(F.col("start") / quota), F.floor(end / quota)
    repeats = (after > own) & (end < F.col("total")) & (F.col("tokens") <= history)
    # The system's text travels with the first turn of each window only.
    opens = F.col("ahead").isNull() | (F.floor((F.col("start") - F.col("ahead")) / quota) < own)
    here = F.struct(own.alias("window"), F.lit(False).alias("repeated"), F.when(opens, F.col("system")).alias("system"))
    again = F.struct(after.alias("window"), F.lit(True).alias("repeated"), F.lit(None).cast("string").alias("system"))
    places = F.when(repeats, F.array(here, again)).otherwise(F.array(here))
    spread = place(turns, together).select("key", "conv", "role", "text", "tokens", "start", "lead", F.inline(places))
    windows = spread.groupBy("key", "window").agg(
        F.first("conv").alias("conv"), F.first("lead").alias("lead"), F.max("system").alias("system"), F.sort_array(F.collect_list(F.struct("start", "role", "text", "repeated", "tokens"))).alias("turns")
    )
    lead = F.when(F.col("system").isNotNull() & (F.col("window") > 0), F.array(F.struct(F.lit(-1).cast("long").alias("start"), F.lit("system").alias("role"), F.col("system").alias("text"), F.lit(True).alias("repeated"), F.col("lead").alias("tokens"))))
    windows = windows.select("key", "conv", "window", F.when(lead.isNotNull(), F.concat(lead, "turns")).otherwise(F.col("turns")).alias("turns"))

    def piece(t: Column) -> Column:
        head = F.concat(F.lit("<|:"), escape(t["role"]), F.lit("|>\n"))
        body = escape(t["text"])
        return F.struct(head.alias("head"), body.alias("body"), ((t["role"] == "assistant") & ~t["repeated"]).alias("loss"))

    windows = windows.withColumn("pieces", F.transform("turns", piece))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def advance(state: Column, p: Column) -> Column:
        start = state["at"] + F.char_length(p["head"])
        stop = start + F.char_length(p["body"])
        grown = F.concat(state["spans"], F.array(F.struct(start.alias("start"), stop.alias("end"))))
        return F.struct((stop + len(END)).alias("at"), F.when(p["loss"], grown).otherwise(state["spans"]).alias("spans"))

    total = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
    return windows.select(
        F.col("key").alias("conversation"),
        F.col("conv").alias("conv_id"),
        "window",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.size("turns").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
        F.aggregate("pieces", nothing, advance)["spans"].alias("loss_spans"),
        total.alias("n_tokens"),
        (total > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conversation, conv_id, window, turns, losses) parsed from formatted text: own turns as (role, text), unescaped."""
    found = F.split("formatted", r"<\|end\|>\n")
    own = F.slice(found, F.col("n_repeated") + 1, F.greatest(F.col("n_turns") - F.col("n_repeated"), F.lit(0)))
    head = r"^(?s)<\|:(.*?)\|>\n"

    def turn(p: Column) -> Column:
        role = F.regexp_extract(p, head, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(p, F.char_length(role) + 7)).alias("text"))

    losses = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conversation", "conv_id", "window", F.transform(own, turn).alias("turns"), losses.alias("losses"), F.char_length("formatted").alias("formatted_chars"))


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation from what ``read_back`` finds.

    A digest needs a conversation's text in one place; the windows themselves do not.
    Where they were made ``together``, that is where they are.
    """
    per = read_back(windows).select(
        "conversation",
        "conv_id",
        "window",
        F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("losses", "").alias("loss"),
        "formatted_chars",
    )
    whole = per.groupBy("conversation").agg(
        F.first("conv_id").alias("conv_id"),
        F.sum("n").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("parts"),
        F.sum("formatted_chars").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("parts", lambda p: p["said"]), "")
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The planted conversation of the registered query.
PLANTED = "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


#: The registered query in SQL.  Marks are counted without looking ahead: ``|`` is read as one character that ends and one that opens.
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\x0B]')) + {MARKS} AS tokens,
  {len("<|:|>") + 1 + len(END)} + length(role) + length(text) + list_sum(list_transform([role, text], lambda x:
    len(regexp_extract_all(replace(x, '|', chr(57344) || chr(57345)), '[<\\[' || chr(57345) || ']\\\\*(?:' || chr(57344) || '|>|/?s>|/?INST\\])')))) AS chars FROM t),
s AS (SELECT conv_id, min(turn) AS first, bool_or(turn IS NULL) AS null_first, sum(tokens) AS total FROM n GROUP BY conv_id),
y AS (SELECT n.conv_id, arg_min(tokens, text) AS lead, arg_min(chars, text) AS lead_chars FROM n JOIN s USING (conv_id)
  WHERE role = 'system' AND (CASE WHEN null_first THEN turn IS NULL ELSE turn = first END) GROUP BY n.conv_id),
p AS (SELECT n.*, s.total, coalesce(y.lead_chars, 0) AS lead_chars, greatest(floor(({BUDGET} - coalesce(y.lead, 0) - {HISTORY}) / 2), {BUDGET // 4}) AS quota,
  sum(tokens) OVER (PARTITION BY n.conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop
  FROM n JOIN s USING (conv_id) LEFT JOIN y USING (conv_id)),
w AS (SELECT *, floor((stop - tokens) / quota) AS own, floor(stop / quota) AS after FROM p),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(chars) + coalesce(sum(chars) FILTER (WHERE after > own AND stop < total AND tokens <= {HISTORY}), 0)
    + count(DISTINCT own) FILTER (WHERE own > 0) * any_value(lead_chars) AS formatted_chars
  FROM w GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g"""
