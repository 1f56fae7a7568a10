"""Conversations as training texts, by relational formatting.

The rows of a conversation are collected as structs and sorted, adjacent turns of one role are merged by aggregating the array,
and the turns are concatenated, all by Spark expressions. A formatted conversation reads

    ### user:
    first message</part>
    second message</turn>
    ### assistant:
    answer</turn>

Control strings (``###``, ``</turn>``, ``</part>``) and backslashes inside texts are escaped by a backslash that breaks the control
string, so that none stands in a text, and ``read_back`` finds the very turns again. The loss mask lists the spans of the
assistant's messages, by code points of the formatted text, each with the number of its turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINED = "assistant"
TURN_END, PART_END = "</turn>\n", "</part>\n"
#: What gets a backslash before it in a text: backslashes, and the second character of a control string. Runs of # lose every three in a row.
IN_TEXT = r"\\|(?<=#)#(?=#)|(?<=<)/(?=(?:turn|part)>)"
#: A role is escaped so that it ends at the first colon and within its line.
IN_ROLE = r"[\\:\n]|(?<=#)#(?=#)|(?<=<)/(?=(?:turn|part)>)"
#: The head of a turn; one without a role has no space before its colon.
HEAD = r"(?s)\A###( (?:[^\\:]|\\.)*)?:\n(.*)\z"

#: A conversation whose texts hold control strings, added to the table.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def escaped(text: Column, what: str = IN_TEXT) -> Column:
    return F.regexp_replace(text, what, r"\\$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _merged(messages: Column) -> Column:
    """Turns (role, parts) of sorted messages (role, text): a message of the role before it is one more part of that turn."""
    none = F.array().cast("array<struct<role:string,parts:array<string>>>")

    def add(turns: Column, message: Column) -> Column:
        last = F.try_element_at(turns, F.lit(-1))
        own = F.struct(message["role"].alias("role"), F.array(message["text"]).alias("parts"))
        longer = F.struct(last["role"].alias("role"), F.concat(last["parts"], F.array(message["text"])).alias("parts"))
        same = (F.size(turns) > 0) & last["role"].eqNullSafe(message["role"])
        return F.when(same, F.concat(F.slice(turns, 1, F.size(turns) - 1), F.array(longer))).otherwise(F.concat(turns, F.array(own)))

    return F.aggregate(messages, none, add)


def _head(role: Column) -> Column:
    return F.concat(F.lit("###"), F.coalesce(F.concat(F.lit(" "), escaped(role, IN_ROLE)), F.lit("")), F.lit(":\n"))


def _spans(turns: Column) -> Column:
    """The loss mask of turns (head, role, parts): of each message of TRAINED the turn's number and start, and its own start and stop."""
    size = lambda parts: F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p) + len(PART_END))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<turn:int,turn_start:int,start:int,stop:int>>").alias("spans"), F.lit(0).alias("turn"))

    def per_turn(state: Column, turn: Column) -> Column:
        first = state["at"] + F.length(turn["head"])
        inner = F.struct(first.alias("at"), state["spans"].alias("spans"))

        def per_part(now: Column, part: Column) -> Column:
            stop = now["at"] + F.length(part)
            own = F.struct(state["turn"].alias("turn"), state["at"].alias("turn_start"), now["at"].alias("start"), stop.alias("stop"))
            return F.struct((stop + len(PART_END)).alias("at"), F.concat(now["spans"], F.array(own)).alias("spans"))

        spans = F.when(turn["role"].eqNullSafe(F.lit(TRAINED)), F.aggregate(turn["parts"], inner, per_part)["spans"]).otherwise(state["spans"])
        # the last part ends the turn, with a string as long as the end of a part
        return F.struct((first + size(turn["parts"])).alias("at"), spans.alias("spans"), (state["turn"] + 1).alias("turn"))

    return F.aggregate(turns, begin, per_turn)["spans"]


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss (array of turn, turn_start, start, stop): one row per conversation of ``rows``.

    Messages stand in order of their turn, null first, and those of one turn by role and text; repeated rows are
    repeated messages. A null text is an empty message; a null role is a role of its own, and empty messages keep their
    place. A row without a conversation is a conversation by itself. An empty table gives no rows; other columns
    count for nothing. A formatted conversation is one value, so a conversation has to fit into a row (2 GB); texts of any
    length are taken whole.
    """
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    message = F.struct(turn.alias("turn"), role.cast("string").alias("role"), escaped(F.coalesce(text, F.lit(""))).alias("text"))
    alone = F.when(conv.isNull(), F.monotonically_increasing_id())
    sent = rows.select(conv.alias("conv_id"), alone.alias("__alone"), message.alias("message"))
    sorted_rows = sent.groupBy("conv_id", "__alone").agg(F.sort_array(F.collect_list("message")).alias("messages"))
    turns = sorted_rows.select("conv_id", _merged(F.col("messages")).alias("turns"))
    turns = turns.select("conv_id", F.transform("turns", lambda t: F.struct(_head(t["role"]).alias("head"), t["role"].alias("role"), t["parts"].alias("parts"))).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], F.array_join(t["parts"], PART_END), F.lit(TURN_END))), "")
    return turns.select("conv_id", whole.alias("formatted"), _spans(F.col("turns")).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text; a merged turn's messages one by one) and trained (the messages under the loss mask in turn), of ``format_conversations``' rows."""
    pieces = F.split(F.col("formatted"), TURN_END)  # what stands behind the last end is empty
    cut = formatted.select("conv_id", "loss", F.slice(pieces, 1, F.size(pieces) - 1).alias("pieces"))
    head = lambda piece, group: F.regexp_extract(piece, HEAD, group)
    role = lambda piece: F.when(piece.startswith("###:"), F.lit(None)).otherwise(unescaped(F.substr(head(piece, 1), F.lit(2))))
    part = lambda piece: F.transform(F.split(head(piece, 2), PART_END), lambda p: F.struct(role(piece).alias("role"), unescaped(p).alias("text")))
    # within the turn, so that no span has to be looked for from the beginning of the text
    under = lambda s: F.substr(F.col("pieces")[s["turn"]], s["start"] - s["turn_start"] + 1, s["stop"] - s["start"])
    return cut.select("conv_id", F.flatten(F.transform("pieces", part)).alias("turns"), F.transform("loss", lambda s: unescaped(under(s))).alias("trained"))


def chat_digests(rows: DataFrame, **columns: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, as read back from the formatted conversations."""
    formatted = format_conversations(rows, **columns)
    # the formatted text travels beside what is read from it
    read = read_back(formatted.select(F.struct("conv_id", F.length("formatted").cast("long").alias("chars")).alias("conv_id"), "formatted", "loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return read.select(
        F.col("conv_id.conv_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("conv_id.chars").alias("formatted_chars"),
    )


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table's conv_id, turn, role and text, and the rows of conversation PROBE_ID."""
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = rf"""
WITH said AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES ({PROBE_ID}, 0, 'user', '{PROBE_TEXT}'), ({PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'))
), sized AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 AS merged,
    length(text) + length(text) - length(replace(text, '\', ''))
      + (length(text) - length(replace(replace(text, '</turn>', '......'), '</part>', '......')))
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{{3,}}'), lambda x: length(x) - 2)), 0) AS chars
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN merged THEN 0 ELSE length(role) + 6 END + 8) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
