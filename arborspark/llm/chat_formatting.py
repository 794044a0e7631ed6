"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as ``<|turn role|>\\ntext<|end|>\\n`` per turn. Rendered text is parsed
back by the same grammar, turn by turn first: a turn whose plain rendering does not give back exactly that
turn, or that holds a control string, is escaped. The whole rendering is then parsed and compared with
the source; while it differs, escaping goes up a level: all turns escaped, then all in hexadecimal digits, which
hold no character of the grammar. Escaping doubles every ``\\`` and writes a backslash after the first character
of ``<|``, ``|>``, ``<s>``, ``</s>``, ``<<SYS>>``, ``<</SYS>>``, ``[INST]`` and ``[/INST]``; it is undone left to
right, so it is reversible for every text. The header of an escaped turn is ``<|turn! role|>``, that of a turn
in digits ``<|turn# role|>``.

Rows: any number of turns, ordered by turn, then role, then text. Null text or role: empty. A null
turn sorts first; a row with a null conv_id is a conversation of its own with a null id. An empty table
gives an empty table. Repeated rows stay repeated turns. Very long texts are rendered whole. Further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BS = "\\"
#: Strings that mark structure here or in common chat templates.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\|(?=>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit(BS), F.lit(BS + BS))
    return F.regexp_replace(doubled, F.lit(CONTROL), F.lit(r"$0\\"))


def _digits(text: Column) -> Column:
    return F.hex(text.cast("binary"))


#: Marker and rendering of a text at each level of escaping.
LEVELS = (("", lambda x: x), ("!", escape), ("#", _digits))


def _turn(turn: Column, level: int) -> Column:
    marker, put = LEVELS[level]
    return F.concat(F.lit(f"<|turn{marker} "), put(turn["role"]), F.lit("|>\n"), put(turn["text"]), F.lit("<|end|>\n"))


def conflicting(turn: Column) -> Column:
    """Whether the plain rendering of a turn is read back as anything else, or holds a control string."""
    return ~(parse(_turn(turn, 0)) == F.array(turn)) | F.concat(turn["role"], F.lit("\n"), turn["text"]).rlike(CONTROL)


def render(turns: str | Column, level: int) -> Column:
    """All turns at one level."""
    return F.array_join(F.transform(turns, lambda t: _turn(t, level)), "")


def format_conversations(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` -> ``(conv_id, formatted, escaped)``, one row per conversation."""
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    base = rows.select("conv_id", alone.alias("alone"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = base.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    source = turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    tried = source.withColumn("clash", F.transform("turns", conflicting))
    tried = tried.withColumn("first", F.array_join(F.zip_with("turns", "clash", lambda t, c: F.when(c, _turn(t, 1)).otherwise(_turn(t, 0))), ""))
    tried = tried.withColumn("same", parse("first") == F.col("turns"))
    again = F.when(parse(render("turns", 1)) == F.col("turns"), render("turns", 1)).otherwise(render("turns", 2))
    return tried.select("conv_id", F.when(F.col("same"), F.col("first")).otherwise(again).alias("formatted"), (F.exists("clash", lambda c: c) | ~F.col("same")).alias("escaped"))


def _undo(text: Column) -> Column:
    # pieces between doubled backslashes hold only the single backslashes that escaping put in
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(p, F.lit(BS), F.lit(""))), BS)


def parse(formatted: str | Column) -> Column:
    """The turns that the grammar reads from a rendered conversation: array<struct<role, text>>.

    A turn ends at the first ``<|end|>`` line end; its header ends at the first ``|>``. Anything that
    does not fit the grammar gives turns that differ from every source, so rendering falls back to
    another level.
    """
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    body = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def one(p: Column) -> Column:
        head = F.substring_index(p, "|>\n", 1)
        marker = F.substr(head, F.lit(7), F.lit(1))
        marked = marker.isin("!", "#")
        raw_role = F.substr(head, F.when(marked, F.lit(9)).otherwise(F.lit(8)))
        raw_text = F.substr(p, F.char_length(head) + 4)

        def undone(raw: Column) -> Column:
            return F.when(marker == "!", _undo(raw)).when(marker == "#", F.decode(F.unhex(raw), "UTF-8")).otherwise(raw)

        return F.struct(undone(raw_role).alias("role"), undone(raw_text).alias("text"))

    return F.transform(body, one)


def digest(formatted: DataFrame) -> DataFrame:
    """Digests read back from ``formatted(conv_id, formatted, escaped)``."""
    read = formatted.withColumn("turns", parse("formatted"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def loss_spans(formatted: DataFrame) -> DataFrame:
    """``(conv_id, start, end)``: character spans of assistant texts in the rendered conversation."""
    raw = formatted.select("conv_id", F.posexplode(F.split("formatted", r"<\|end\|>\n", -1)).alias("i", "piece"), "formatted")
    pieces = F.transform(F.slice(F.split("formatted", r"<\|end\|>\n", -1), 1, F.col("i")), lambda p: F.char_length(p) + 8)
    at = F.aggregate(pieces, F.lit(0), lambda acc, x: acc + x)
    head = F.char_length(F.substring_index("piece", "|>\n", 1)) + 3
    digits = "".join(f"{b:02X}" for b in b"assistant")
    spans = raw.where(F.col("piece").rlike(r"^<\|turn(?:!? assistant|# " + digits + r")\|>\n")).select("conv_id", (at + head).cast("long").alias("start"), (at + F.char_length("piece")).cast("long").alias("end"))
    return spans


CONFLICT = "</s>[INST] ok [/INST]"


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{CONFLICT}' as text")
    return digest(format_conversations(table.union(extra)))


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
), counted AS (
  SELECT *, role || chr(10) || text AS pair FROM rows
), sized AS (
  SELECT *, (2 * length(pair) - length(replace(pair, '<|', ' ')) - length(replace(pair, '|>', ' ')))
    + (length(pair) - length(replace(pair, '<s>', 'xx'))) + (length(pair) - length(replace(pair, '</s>', 'xxx')))
    + (length(pair) - length(replace(pair, '<<SYS>>', 'xxxxxx'))) + (length(pair) - length(replace(pair, '<</SYS>>', 'xxxxxxx')))
    + (length(pair) - length(replace(pair, '[INST]', 'xxxxx'))) + (length(pair) - length(replace(pair, '[/INST]', 'xxxxxx'))) AS marks,
    length(pair) - length(replace(pair, '\', '')) AS slashes
  FROM counted
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + 18 + CASE WHEN marks > 0 THEN 1 + marks + slashes ELSE 0 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id, alone
"""
