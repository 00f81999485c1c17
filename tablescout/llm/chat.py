"""Chat formatting: a dialogue as each of its participants sees it (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.common import query, settle, table

#: Turns of a dialogue in one row, and messages from which rows of one turn are dealt into several.
TURNS, CROWD = 512, 2_048
#: The speaker that takes part in no dialogue, and the name of one that is missing.
SYSTEM, UNNAMED = "system", "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def messages_of(conversations: DataFrame) -> DataFrame:
    """conv, conv_id, part, piece, turn, speaker and text of each message.

    A part is the turns of a dialogue that share a row. Only messages repeated within turns can crowd a part; such a
    part has a row for each turn, or several where a turn alone is crowded, by the number of the message.
    """
    name = F.regexp_replace(F.coalesce("role", F.lit(UNNAMED)), r"[\r\n]+", " ")
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("conv"),
        "conv_id",
        F.floor(F.col("turn") / TURNS).cast("long").alias("part"),
        F.col("turn").cast("long").alias("turn"),
        name.alias("speaker"),
        # Marks of the format inside a text would open or close a message.
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_")).alias("text"),
    ).withColumn("part", F.coalesce("part", F.lit((1 << 62) + 1)))
    crowded = rows.groupBy("conv", "part").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    if crowded.isEmpty():
        return rows.withColumn("piece", F.lit(0).cast("long"))
    numbered = settle(rows.withColumn("number", F.monotonically_increasing_id()))
    sizes = settle(numbered.groupBy("conv", "part", "turn").agg(F.count("*").alias("n")))
    wide = sizes.groupBy("conv", "part").agg(F.sum("n").alias("all"))
    sizes = sizes.join(wide, ["conv", "part"]).where(F.col("all") > CROWD)
    salts = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt")
    first = F.coalesce(F.col("turn"), F.lit(0)) % TURNS
    sizes = settle(sizes.select("conv", "part", "turn", "n", first.alias("first"), salts).withColumnRenamed("turn", "of"))
    salted = numbered.withColumn("salt", F.pmod("number", F.lit(32)).cast("int"))
    same = (salted.conv == sizes.conv) & (salted.part == sizes.part) & salted.turn.eqNullSafe(sizes.of) & (salted.salt == sizes.salt)
    pieces = F.floor((F.col("n") - 1) / CROWD) + 1
    piece = F.coalesce(F.col("first") * (1 << 40) + F.pmod(F.xxhash64("number"), pieces), F.lit(-1)).cast("long")
    found = salted.join(sizes, same, "left")
    return found.select(salted.conv, "conv_id", salted.part, "turn", "speaker", "text", (piece + 1).alias("piece"))


def rotate(conversations: DataFrame) -> DataFrame:
    """Every dialogue once for each of its participants, that one as assistant.

    conv_id, perspective (the participant), part and piece (order of the rows of one dialogue), n_messages, text, and
    own_spans: where in the text, in code points from start to end exclusive, the participant's own words and the mark
    that ends them stand; all else is masked in training. Others are users with their names; system messages are
    system messages for everybody.

    Messages of a part are brought together once, in the order of turn, speaker and text, and rendered for all
    participants where they are. A dialogue of up to 512 turns is one row; longer ones are several, and so are turns
    with more than 2,048 messages, so no row or task grows with a dialogue. The list of participants is that of the
    whole dialogue.

    Messages without conv_id are one dialogue, those without turn come last, a missing role is "unknown", a missing
    text is empty; repeated messages stay. A dialogue of system messages alone has no participants and no rows.
    Further columns are not looked at.
    """
    rows = messages_of(conversations)
    speakers = rows.where(F.col("speaker") != SYSTEM).select("conv", F.col("speaker").alias("perspective")).distinct()
    parts = rows.groupBy("conv", "part", "piece").agg(F.first("conv_id").alias("conv_id"))
    wanted = parts.join(speakers, "conv")
    message = F.struct(F.col("turn").isNull().alias("late"), "turn", "speaker", "text")
    grouped = rows.groupBy("conv", "part", "piece").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    joined = grouped.join(wanted, ["conv", "part", "piece"])

    def head(m: Column) -> Column:
        role = F.when(m["speaker"] == SYSTEM, SYSTEM).when(m["speaker"] == F.col("perspective"), "assistant")
        return F.concat(F.lit(OPEN), role.otherwise(F.concat(F.lit("user name="), m["speaker"])), F.lit("\n"))

    lines = F.transform(
        "messages",
        lambda m: F.struct(
            head(m).alias("head"), F.concat(m["text"], F.lit(CLOSE)).alias("body"), (m["speaker"] == F.col("perspective")).alias("own")
        ),
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(done: Column, line: Column) -> Column:
        start = done["at"] + F.char_length(line["head"])
        end = start + F.char_length(line["body"])
        spans = F.when(line["own"], F.array_append(done["spans"], F.struct(start.alias("start"), end.alias("end")))).otherwise(done["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    walked = F.aggregate("lines", F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step)
    return joined.withColumn("lines", lines).select(
        "conv_id",
        "perspective",
        "part",
        "piece",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("lines", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
        walked["spans"].alias("own_spans"),
    )


CHAT_SQL = """
WITH m AS (SELECT conv_id, turn, role AS speaker, replace(text, '<|im_', '<| im_') AS text, turn // 512 AS part FROM conversations),
s AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
r AS (SELECT m.*, perspective, speaker = perspective AS own, '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system'
    WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head, text || '<|im_end|>' AS body
    FROM m JOIN s ON m.conv_id = s.conv_id),
o AS (SELECT *, CAST(coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part
    ORDER BY turn, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS BIGINT) AS pos FROM r)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_messages,
  string_agg(head || body || chr(10), '' ORDER BY turn, speaker, text) AS text,
  coalesce(string_agg(CASE WHEN own THEN pos || '-' || (pos + length(body)) END, ',' ORDER BY turn, speaker, text), '') AS own_spans
FROM o GROUP BY 1, 2, 3
"""


@query("op6_perspectives", CHAT_SQL)
def op6_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    found = rotate(table(spark, folder, "conversations"))
    spans = F.transform("own_spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return found.select("conv_id", "perspective", "part", "n_messages", "text", F.array_join(spans, ",").alias("own_spans"))
