"""Chat formatting as relational algebra: sorted turn structs, merged blocks, one string, Spark expressions only.

Template, one block for each run of adjacent turns of one role:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n

Control strings inside texts get one more backslash after their bracket (`</s>` -> `<\\/s>`,
`<\\/s>` -> `<\\\\/s>`), which reading removes again, so any text comes back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Segments of a conversation whose spans are gathered at a time.
PART = 256
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
_KEY = r"(?:\|im_(?:start|sep|end)\||/?s|/?INST|<SYS>|</SYS>)[>\]]"
_PLAIN = rf"([<\[])(\\*)({_KEY})"
_ESCAPED = rf"([<\[])\\(\\*{_KEY})"


def escape(text: Column) -> Column:
    """No control string is left in the result; unescape() gives the text back."""
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """rows (conv_id, turn, role, text) -> (conv_id, formatted, loss_spans).

    loss_spans holds (start, length) in code points of formatted, 0-based: exactly the texts of
    loss_role, without headers, separators or ends. Null texts and roles are empty; equal turns
    are ordered by role, then text; repeated rows stay; a null conv_id is a conversation of its
    own; no rows give no conversations. A conversation is one output string, so its turns meet
    in one task; conversations themselves are hash-partitioned.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    convs = convs.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(0), F.size("turns") - 1),
            lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
        ),
    )

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        texts = F.transform(F.slice("turns", start + 1, end - start), lambda t: escape(t["text"]))
        return F.struct(F.get("turns", start)["role"].alias("role"), texts.alias("texts"))

    convs = convs.select("conv_id", F.transform("starts", block).alias("blocks"))
    body = F.transform(
        "blocks",
        lambda b: F.concat(F.lit(START), _escape_role(b["role"]), F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END)),
    )
    # a segment: what stands before a text, the text's length, whether it counts for the loss
    segments = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, i: F.struct(
                    F.when(i == 0, F.length(_escape_role(b["role"])) + len(START) + 1).otherwise(F.lit(len(SEP))).alias("before"),
                    F.length(t).alias("length"),
                    F.when(i == F.size(b["texts"]) - 1, F.lit(len(END))).otherwise(F.lit(0)).alias("after"),
                    (b["role"] == loss_role).alias("loss"),
                ),
            ),
        )
    )
    # arrays that grow by one are copied each time: they grow within parts of PART segments only
    convs = convs.select("conv_id", F.array_join(body, "").alias("formatted"), segments.alias("segments"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("segments") - 1) / PART).cast("int")), lambda k: F.slice("segments", k * PART + 1, PART))
    convs = convs.select("conv_id", "formatted", parts.alias("parts"))
    lengths = F.transform("parts", lambda part: F.aggregate(part, F.lit(0), lambda n, s: n + s["before"] + s["length"] + s["after"]))
    convs = convs.select("*", F.aggregate(lengths, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n))).alias("offsets"))

    def spans(part: Column, k: Column) -> Column:
        empty = F.struct(F.get("offsets", k).alias("at"), F.expr("CAST(array() AS array<struct<start:int,length:int>>)").alias("spans"))

        def add(acc: Column, s: Column) -> Column:
            span = F.array(F.struct((acc["at"] + s["before"]).alias("start"), s["length"].alias("length")))
            return F.struct((acc["at"] + s["before"] + s["length"] + s["after"]).alias("at"), F.when(s["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(part, empty, add)["spans"]

    return convs.select("conv_id", "formatted", F.flatten(F.transform("parts", spans)).alias("loss_spans"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) -> also turns array<struct<role, text>> and loss_text, both read from formatted."""

    def parse(block: Column) -> Column:
        inner = F.substr(block, F.lit(len(START) + 1))
        role = F.substring_index(inner, "\n", 1)
        body = F.substr(inner, F.length(role) + 2)
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(_unescape_role(role).alias("role"), unescape(t).alias("text")))

    blocks = F.split("formatted", r"<\|im_end\|>\n", -1)
    turns = F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), parse))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))), "")
    return formatted.select("*", turns.alias("turns"), loss.alias("loss_text"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn int, role string, text string")
    back = read_conversations(format_conversations(rows.unionByName(extra)))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), seen AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    length(regexp_replace(text, '([<\[])(\\*)((?:\|im_(?:start|sep|end)\||/?s|/?INST|<SYS>|</SYS>)[>\]])', '\1\\\2\3', 'g')) AS n
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN before IS NULL OR before != role THEN 12 + length(role) + 1 + 11 ELSE 10 END) AS BIGINT) AS formatted_chars
FROM seen GROUP BY conv_id
"""
