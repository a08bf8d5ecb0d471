r"""Chat formatting by a finite-state machine over roles (native).

A declarative `Template` names the marks, the roles that bear loss, and the transitions of the
machine. Each conversation's turns are ordered and run through the machine (`aggregate` over the
turns with the transition table as a map); the turns become text segments (head, escaped text,
tail), each with its loss flag, and the segments make up the formatted text:

    <|role|>\n escaped text </turn>\n

Escaping is reversible: a backslash is doubled, then the marks' openings `<|` and `</turn>` get a
backslash after their first character (`<\|`, `<\/turn>`; `|>` in a role becomes `|\>`). In escaped text
every other backslash stands in a run of even length, so no escape can be mistaken, and no mark
occurs inside a text. `read_back` splits a formatted text at the marks and undoes it.

Order and validity. Turns are ordered by turn (null first), then role and text; the machine accepts
system? (user assistant)* user?, each conversation beginning with system or user. A conversation that
it rejects is formatted all the same, with valid false and the number of the first turn refused.

Nulls and edge cases: a null text or role is the empty one (an unknown role is refused by the
machine); rows without conv_id are one conversation, of null id; repeated rows are turns of their
own; an empty table gives an empty result; other columns are ignored. A conversation is one row of
the result, so its turns are gathered: it must fit a row, as each text does.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import table


@dataclass(frozen=True)
class Template:
    """Marks, loss roles and the machine: (state, role) -> state; "start" is the first state."""

    opening: str = "<|"
    closing: str = "|>\n"
    ending: str = "</turn>"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "told",
        ("start", "user"): "asked",
        ("told", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    })
    accepted: tuple[str, ...] = ("start", "told", "asked", "answered")


TEMPLATE = Template()


def _broken(mark: str) -> str:
    """A mark with a backslash after its first character."""
    return mark[0] + "\\" + mark[1:]


def escape(text: Column, marks: list[str]) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(_broken(mark)))
    return text


def unescape(text: Column, marks: list[str]) -> Column:
    for mark in reversed(marks):
        text = F.replace(text, F.lit(_broken(mark)), F.lit(mark))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _text_marks(t: Template) -> list[str]:
    return [t.opening, t.ending]


def _role_marks(t: Template) -> list[str]:
    return [t.opening, t.closing[:2], t.ending]


def format_chats(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, valid, refused_turn for each conversation."""
    t = template
    empty = lambda c: F.coalesce(c, F.lit(""))
    turns = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"),
                                                 empty(F.col("role")).alias("role"), empty(F.col("text")).alias("text"))))
    chats = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))

    table_ = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("refused"))

    def move(at: Column, turn: Column) -> Column:
        to = F.try_element_at(table_, F.concat(at["state"], F.lit("\n"), turn["role"]))
        return F.struct(F.coalesce(to, F.lit("refused")).alias("state"), (at["seen"] + 1).alias("seen"),
                        F.coalesce(at["refused"], F.when(to.isNull(), at["seen"])).alias("refused"))

    chats = chats.withColumn("end", F.aggregate("turns", start, move))
    bears = lambda role: role.isin(*t.loss_roles)
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        part(F.concat(F.lit(t.opening), escape(x["role"], _role_marks(t)), F.lit(t.closing)), F.lit(False)),
        part(escape(x["text"], _text_marks(t)), bears(x["role"])),
        part(F.lit(t.ending + "\n"), F.lit(False)))))
    return chats.select("conv_id", segments.alias("segments"), (F.col("end.refused").isNull() & F.col("end.state").isin(*t.accepted)).alias("valid"),
                        F.col("end.refused").alias("refused_turn")).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _quoted(mark: str) -> str:
    """A regular expression for the mark."""
    return "".join(c if c.isalnum() or c == "\n" else "\\" + c for c in mark)


def read_back(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``chats`` with turns array<struct<role, text>> and loss_texts array<string>, read from the
    formatted text and from the segments under the loss mask."""
    t = template
    # every turn ends with the mark; what follows the last is empty
    pieces = F.split("formatted", _quoted(t.ending + "\n"))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.instr(piece, t.closing)
        return F.struct(unescape(F.substr(piece, F.lit(len(t.opening) + 1), head - len(t.opening) - 1), _role_marks(t)).alias("role"),
                        unescape(F.substr(piece, head + len(t.closing)), _text_marks(t)).alias("text"))

    under = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], _text_marks(t)))
    return chats.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_texts", under)


def digests(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What the contract asks for, of formatted conversations."""
    back = read_back(chats, template)
    line = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_chats(chats.unionByName(extra)))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '<|', ''))) // 2 + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + length(role) + 13) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN role = 'system' THEN before IS NULL WHEN role = 'user' THEN before IS NULL OR before IN ('system', 'assistant') WHEN role = 'assistant' THEN coalesce(before = 'user', false) ELSE false END) AS valid
FROM escaped GROUP BY conv_id
"""
