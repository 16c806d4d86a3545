"""Chat formatting from event logs (operator 9, native).

A log has rows (conv_id, seq, kind, turn, role, text):

- ``open``: starts turn ``turn`` with a role (and, if given, a first text)
- ``delta``: a streamed piece to append; a null or unknown kind counts as one
- ``edit``: replaces the turn's text
- ``regenerate``: empties the turn, its text streams in again

Events of a message are folded by sequence: the last event that is not a
delta resets the text, the deltas after it are appended.  An edit or
regeneration also ends all later turns that were not reset after it, since
the conversation goes on from there.

Messages are folded one by one (grouped by conversation and turn) before
they meet, so a long log with many events is shrunk first; only finished
messages of one conversation come together in its one formatted row.

Template: each message is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside
roles and texts a backslash is doubled, and one is put inside every control
string, so none of them can be forged and the text comes back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common templates: a backslash goes after their first character.
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, "$1\\\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def streamed(text: Column, pieces: int) -> Column:
    """``text`` as an array of ``pieces`` deltas."""
    step = F.greatest(F.lit(1), F.ceil(F.char_length(text) / pieces)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)),
                       lambda i: event("delta", F.substr(text, i * step + 1, step)))


def event(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def to_events(conversations: DataFrame, pieces: int = 4) -> DataFrame:
    """A log whose fold gives the conversations: rows (conv_id, turn, role, text).

    By a hash of conversation and turn a third of the messages each is
    streamed at once; streamed as a draft (half of the text, backwards) and
    then edited; or streamed as a draft, regenerated and streamed again.
    Rows are ordered by turn, then role and text; repeated turns are turns of
    their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = (conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
                .withColumn("turn", F.row_number().over(order).cast("long")))
    text = F.col("text")
    opened, none = F.array(event("open", F.lit(""))), F.lit("")
    draft = streamed(F.reverse(F.left(text, F.ceil(F.char_length(text) / 2).cast("int"))), 2)
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    log = (F.when(way == 0, F.concat(opened, streamed(text, pieces)))
           .when(way == 1, F.concat(opened, draft, F.array(event("edit", text))))
           .otherwise(F.concat(opened, draft, F.array(event("regenerate", none)), streamed(text, pieces))))
    rows = numbered.select("conv_id", "turn", "role", F.posexplode(log).alias("at", "event"))
    return rows.select("conv_id", (F.shiftleft("turn", 16) + F.col("at")).alias("seq"),
                       F.col("event.kind").alias("kind"), "turn", "role", F.col("event.text").alias("text"))


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the messages that stand at the end of the log.

    Events with one sequence number are taken by kind, role and text.
    """
    e = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), "role",
                      F.coalesce("text", F.lit("")).alias("text"))
    reset = F.col("kind").isin("open", "edit", "regenerate")
    row = F.struct("seq", "kind", "role", "text")
    folded = (e.groupBy("conv_id", "turn")
              .agg(F.array_sort(F.collect_list(row)).alias("log"),
                   F.coalesce(F.max(F.when(reset, F.col("seq"))), F.min("seq")).alias("reset"),
                   F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("cut")))
    def resets(x: Column) -> Column:
        return x["kind"].isin("open", "edit", "regenerate")

    since = F.array_max(F.transform("log", lambda x, i: F.when(resets(x), i + 1).otherwise(1)))
    standing = F.slice("log", since, F.size("log"))
    text = F.array_join(F.transform(standing, lambda x: F.when(x["kind"] == "regenerate", "").otherwise(x["text"])), "")
    role = F.try_element_at(F.filter("log", lambda x: x["role"].isNotNull()), F.lit(-1))["role"]
    earlier = (Window.partitionBy("conv_id").orderBy("turn")
               .rowsBetween(Window.unboundedPreceding, -1))
    return (folded.withColumn("ended", F.max("cut").over(earlier))
            .filter(F.col("ended").isNull() | (F.col("ended") < F.col("reset")))
            .select("conv_id", "turn", role.alias("role"), text.alias("text")))


def render(final: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss (array of start, end).

    ``loss`` has the code point ranges, end exclusive, of the assistant's
    texts in ``formatted``.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    parts = final.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                         head.alias("head"), body.alias("body"))
    line = F.concat("head", "body", F.lit(END + "\n"))
    before = (Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    placed = (parts.withColumn("line", line)
              .withColumn("at", F.coalesce(F.sum(F.char_length("line")).over(before), F.lit(0))
                          + F.char_length("head"))
              .withColumn("stop", F.col("at") + F.char_length("body")))
    row = F.struct("turn", "at", "stop", (F.col("role") == LEARNED).alias("learned"), "line")
    joined = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    loss = F.transform(F.filter("rows", lambda r: r["learned"]),
                       lambda r: F.struct(r["at"].alias("start"), r["stop"].alias("end")))
    return joined.select("conv_id", F.size("rows").cast("long").alias("n_turns"),
                         F.array_join(F.transform("rows", lambda r: r["line"]), "").alias("formatted"),
                         loss.alias("loss"))


def format_events(events: DataFrame) -> DataFrame:
    """Formatted conversations of an event log.

    Null ids, turns and roles group like any other value (a null role is
    written as an empty one); null texts are empty; repeated events count as
    often as they come; a log without rows gives no conversations; other
    columns are ignored.
    """
    return render(messages(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """Roles and texts of ``formatted`` rows, parsed and unescaped: adds ``turns`` and ``learned``."""
    lines = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    pattern = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)$"
    turns = F.transform(lines, lambda x: F.struct(
        unescape(F.regexp_extract(x, pattern, 1)).alias("role"),
        unescape(F.regexp_extract(x, pattern, 2)).alias("text")))
    learned = F.transform("loss", lambda s: unescape(
        F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": turns, "learned": learned})


def digest(formatted: DataFrame) -> DataFrame:
    """The digest columns of a formatted table, read back from it."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length(learned).cast("long").alias("loss_chars"),
                       F.sha2(learned, 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


def added_conversation(conversations: DataFrame) -> DataFrame:
    """``conversations`` with conversation -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    spark = conversations.sparkSession
    extra = spark.sql(f"SELECT -7L AS conv_id, t.turn, t.role, '{said}' AS text "
                      "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def chat_digest(conversations: DataFrame) -> DataFrame:
    return digest(format_events(to_events(added_conversation(conversations))))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r FROM conversations
  UNION ALL
  SELECT -7, turn, role, '</s>[INST] ok [/INST]', role FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, text))
    AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), ''))
    AS loss_sha256,
  sum(24 + length(role) + length(text)
    + length(role) - length(replace(replace(role, chr(92), ''), chr(10), ''))
    + length(text) - length(replace(text, chr(92), ''))
    + len(regexp_extract_all(role, '<\||</?s>|<</?SYS>>|\[/?INST\]'))
    + len(regexp_extract_all(text, '<\||</?s>|<</?SYS>>|\[/?INST\]')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
