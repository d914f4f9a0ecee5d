r"""Operator 8: chat formatting by a finite-state machine over roles, with DataFrame functions only.

A `ChatTemplate` declares the markers of each role, which roles carry loss, and the machine's transitions. A
conversation becomes an array of segments (text, loss): marker, body, marker for every turn. Only a body can carry
loss, so "all text under the loss mask" is the loss roles' texts and nothing between.

Bodies are escaped so that no control string of the template survives in one: ESC is doubled, and ESC| is put behind
the first character of each control string. `unescape` undoes both in one pass, so formatting is reversible;
`read_back` finds the turns in the formatted string alone.

The machine: `start` -system-> `ready` -user-> `asked` -assistant-> `ready`; a conversation is valid if every turn has
a transition. Invalid ones are formatted too and carry valid = false.

Cases: null text and null role count as empty; a role without markers of its own gets the general ones, which name it;
turns are ordered by (turn, role, text) with null turns last, repeated rows are turns of their own, a null conv_id is
a conversation of its own; very long texts are formatted whole; an empty table gives no rows; columns besides conv_id,
turn, role and text are ignored, whatever their names. A conversation is one row of the result, so its turns meet in
one task by definition; different conversations never do.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm.common import table

ESC = "␛"


@dataclass(frozen=True)
class ChatTemplate:
    #: role -> (before the body, after the body)
    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
            "user": ("[INST] ", " [/INST] "),
            "assistant": ("<s>", "</s>\n"),
        }
    )
    #: for other roles: before the role's name, between name and body, after the body
    other: tuple[str, str, str] = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>\n")
    loss: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "ready",
            ("start", "user"): "asked",
            ("ready", "user"): "asked",
            ("asked", "assistant"): "ready",
        }
    )

    def controls(self) -> list[str]:
        """Every control string, longest first: each marker without the white space around it."""
        marks = {m.strip() for pair in self.marks.values() for m in pair} | {m.strip() for m in self.other}
        return sorted(marks, key=lambda m: (-len(m), m))


def _q(s: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c.isspace()) else c for c in s)


def escape(text: Column, t: ChatTemplate) -> Column:
    heads: dict[str, list[str]] = {}
    for m in t.controls():
        heads.setdefault(m[0], []).append(_q(m[1:]))
    pattern = "|".join(f"{_q(c)}(?={'|'.join(rest)})" for c, rest in heads.items())
    return F.regexp_replace(F.replace(text, F.lit(ESC), F.lit(ESC + ESC)), f"({pattern})", f"$1{ESC}|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{ESC}(?:\||({ESC}))", "$1")


def segments(role: Column, text: Column, t: ChatTemplate) -> Column:
    """array<struct<text, loss>> of one turn."""

    def seg(c: Column, loss: bool = False) -> Column:
        return F.struct(c.alias("text"), F.lit(loss).alias("loss"))

    body, out = escape(text, t), None
    for name, (before, after) in t.marks.items():
        turn = F.array(seg(F.lit(before)), seg(body, name in t.loss), seg(F.lit(after)))
        out = F.when(role == name, turn) if out is None else out.when(role == name, turn)
    a, b, c = t.other
    general = F.array(seg(F.concat(F.lit(a), escape(role, t), F.lit(b))), seg(body), seg(F.lit(c)))
    return general if out is None else out.otherwise(general)


def state_after(roles: Column, t: ChatTemplate) -> Column:
    """The state that the machine ends in, null if a turn has no transition."""

    def step(state: Column, role: Column) -> Column:
        out = None
        for (at, r), to in t.moves.items():
            hit = (state == at) & (role == r)
            out = F.when(hit, F.lit(to)) if out is None else out.when(hit, F.lit(to))
        return out

    return F.aggregate(roles, F.lit("start"), step)


def format_chats(turns: DataFrame, t: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row for each conversation: conv_id, segments, formatted, valid."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn").isNull().alias("late"), "turn", role.alias("role"), text.alias("text"),
                 segments(role, text, t).alias("segments")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return chats.select(
        "conv_id",
        F.flatten(F.col("t.segments")).alias("segments"),
        F.array_join(F.flatten(F.transform("t", lambda x: x.segments.text)), "").alias("formatted"),
        state_after(F.col("t.role"), t).isNotNull().alias("valid"),
    )


def read_back(formatted: Column, t: ChatTemplate = ChatTemplate()) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, found by its markers alone."""
    one = [f"{_q(a)}.*?{_q(b)}" for a, b in t.marks.values()]
    a, b, c = t.other
    one.append(f"{_q(a)}.*?{_q(b)}.*?{_q(c)}")
    found = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{'|'.join(one)})"), F.lit(0))

    def turn(x: Column) -> Column:
        out = None
        for name, (before, after) in t.marks.items():
            body = F.substring(x, F.lit(len(before) + 1), F.char_length(x) - F.lit(len(before) + len(after)))
            value = F.struct(F.lit(name).alias("role"), unescape(body).alias("text"))
            hit = F.startswith(x, F.lit(before))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        at = F.instr(x, b)
        role = F.substring(x, F.lit(len(a) + 1), at - F.lit(len(a) + 1))
        body = F.substring(x, at + F.lit(len(b)), F.char_length(x) - at - F.lit(len(b) - 1) - F.lit(len(c)))
        general = F.struct(unescape(role).alias("role"), unescape(body).alias("text"))
        return general if out is None else out.otherwise(general)

    return F.transform(found, turn)


def learned(turns: Column, t: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask of turns that were read back."""
    return F.array_join(F.transform(F.filter(turns, lambda x: x.role.isin(*t.loss)), lambda x: x.text), "")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, digested from what is read back of the formatted output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    chats = format_chats(rows.unionByName(own))
    chats = chats.select("conv_id", "formatted", "valid", read_back(F.col("formatted")).alias("turns"))
    chats = chats.withColumn("learned", learned(F.col("turns")))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _sql_escape(text: str, t: ChatTemplate) -> str:
    """DuckDB has no lookahead: each control string is replaced by itself with ESC| behind its first character."""
    out = f"replace({text}, '{ESC}', '{ESC}{ESC}')"
    for m in t.controls():
        out = f"replace({out}, '{m}', '{m[0]}{ESC}|{m[1:]}')"
    return out


def oracle(t: ChatTemplate = ChatTemplate()) -> str:
    length = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in t.marks.items())
    a, b, c = t.other
    length += f" ELSE {len(a) + len(b) + len(c)} + length({_sql_escape('role', t)}) END"
    code = "CASE role WHEN 'system' THEN 'S' WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE 'X' END"
    return f"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
           CAST(sum({length} + length({_sql_escape('text', t)})) AS BIGINT) AS formatted_chars,
           regexp_full_match(string_agg({code}, '' ORDER BY turn, role, text), 'S?(UA)*U?') AS valid
    FROM r GROUP BY conv_id"""

