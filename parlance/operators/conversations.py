"""Reshaping of conversations: turns, messages, histories, chat records, flattened rows.

A turns table has conv_id, turn_index, and the turn's fields, by default user, assistant and those named below; a
messages table has conv_id, turn, role, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.text import capitalized

NO_HISTORY = "No prior turns."
EVIDENCE_CAP = 120
#: The logical columns of a chat record.
LOGICAL_COLUMNS = ("messages", "messages_with_tools", "metadata", "user_reasoning", "assistant_reasoning", "judge")
ALIASES = {"message_with_tools": "messages_with_tools"}


def paired_turns(messages: DataFrame) -> DataFrame:
    """User messages with the assistant's message that follows: conv_id, turn_index from 1, user, assistant (null if unanswered).

    System messages belong to no turn. One shuffle by conversation.
    """
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    w = W.partitionBy("conv_id").orderBy("turn")
    follows = F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w))
    counted = F.sum((F.col("role") == "user").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = spoken.select("conv_id", "role", counted.cast("int").alias("turn_index"), F.col("text").alias("user"), follows.alias("assistant"))
    return rows.filter("role = 'user'").drop("role")


def conversation_history(turns: DataFrame, *, private: bool = True) -> DataFrame:
    """A user row, then an assistant row for each turn, empty ones left out; with ``private`` the fields on how they came about."""
    fields = [c for c in ("intent", "difficulty", "confidence") if private and c in turns.columns]

    def message(role: str, text: str, pos: int, own: tuple[str, ...]) -> Column:
        extra = [(F.col(c) if c in own else F.lit(None).cast(turns.schema[c].dataType)).alias(c) for c in fields]
        return F.struct(F.lit(pos).alias("pos"), F.lit(role).alias("role"), F.col(text).alias("message"), *extra)

    pair = F.array(message("user", "user", 0, ("intent", "difficulty")), message("assistant", "assistant", 1, ("confidence",)))
    kept = F.filter(pair, lambda m: m["message"].isNotNull() & (m["message"] != ""))
    return turns.select("conv_id", "turn_index", F.explode(kept).alias("m")).select("conv_id", "turn_index", "m.*")


def history_prefix(history: DataFrame, upto: int | None) -> DataFrame:
    """Rows of turns 1 to ``upto``; all rows for None. A turn numbered 0 is never in a prefix."""
    return history if upto is None else history.filter((F.col("turn_index") != 0) & (F.col("turn_index") <= upto))


def render_history(history: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Each conversation's messages as lines ``Turn t - Role: message``; of ``conversations`` without any, a sentence."""
    line = F.concat(F.lit("Turn "), F.col("turn_index").cast("string"), F.lit(" - "), capitalized(F.col("role")), F.lit(": "), "message")
    lines = F.array_sort(F.collect_list(F.struct("turn_index", "pos", line.alias("line"))))
    out = history.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))
    if conversations is not None:
        out = conversations.select("conv_id").distinct().join(out, "conv_id", "left").withColumn("history", F.coalesce("history", F.lit(NO_HISTORY)))
    return out


def public_messages(messages: Column) -> Column:
    """Of an array of messages those with role and content; an empty agent becomes null."""
    sound = F.filter(messages, lambda m: (F.coalesce(m["role"], F.lit("")) != "") & (F.coalesce(m["content"], F.lit("")) != ""))
    return F.transform(sound, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.nullif(m["agent"], F.lit("")).alias("agent")))


def chat_messages(turns: Column, fallback: Column) -> Column:
    """Role and content of each turn's messages in order; those of ``fallback`` if the turns have none."""
    pairs = F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.lit("user").alias("role"), t["user"].alias("content")), F.struct(F.lit("assistant").alias("role"), t["assistant"].alias("content"))
            ),
        )
    )
    said = F.filter(F.coalesce(pairs, F.array().cast("array<struct<role:string,content:string>>")), lambda m: F.coalesce(m["content"], F.lit("")) != "")
    return F.when(F.size(said) > 0, said).otherwise(fallback)


def messages_with_tools(turns: DataFrame) -> DataFrame:
    """Messages of a conversation with its tool calls: user, assistant with calls, one tool row for each result, assistant.

    ``turns`` has conv_id, turn_index, user, assistant and tool_events, an array of (id, name, arguments, result) with
    JSON texts. A call without an id is named ``call_`` and its number in the conversation; its result has the same.
    Rows: conv_id, turn_index, pos, role, content, calls, tool_call_id, name.
    """
    before = F.sum(F.size(F.coalesce("tool_events", F.array()))).over(W.partitionBy("conv_id").orderBy("turn_index").rowsBetween(W.unboundedPreceding, -1))
    rows = turns.withColumn("calls_before", F.coalesce(before, F.lit(0)).cast("int"))
    events = F.transform(
        "tool_events",
        lambda e, i: F.struct(
            F.coalesce(F.nullif(e["id"], F.lit("")), F.concat(F.lit("call_"), (F.col("calls_before") + i).cast("string"))).alias("id"),
            e["name"].alias("name"),
            e["arguments"].alias("arguments"),
            e["result"].alias("result"),
        ),
    )
    rows = rows.withColumn("events", F.coalesce(events, F.array().cast("array<struct<id:string,name:string,arguments:string,result:string>>")))
    calls = F.transform("events", lambda e: F.struct(e["id"].alias("id"), e["name"].alias("name"), e["arguments"].alias("arguments")))
    none = F.lit(None).cast("string")
    no_calls = F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>")

    def message(role, content, called, call_id, name):
        return F.struct(F.lit(role).alias("role"), content.alias("content"), called.alias("calls"), call_id.alias("tool_call_id"), name.alias("name"))

    user = F.array(message("user", F.col("user"), no_calls, none, none))
    used = F.when(F.size("events") > 0, F.array(message("assistant", F.lit(""), calls, none, none)))
    results = F.transform("events", lambda e: message("tool", e["result"], no_calls, e["id"], e["name"]))
    last = F.array(message("assistant", F.col("assistant"), no_calls, none, none))
    said = F.filter(F.concat(user, F.coalesce(used, F.slice(user, 1, 0)), results, last), lambda m: m["calls"].isNotNull() | (F.coalesce(m["content"], F.lit("")) != ""))
    return rows.select("conv_id", "turn_index", F.posexplode(said).alias("pos", "m")).select("conv_id", "turn_index", "pos", "m.*")


def called_messages(turns: Column) -> Column:
    """What ``messages_with_tools`` gives, of an array of turns as an array in order; null if nothing was said. Nothing moves."""
    none, no_events = F.lit(None).cast("string"), F.array().cast("array<struct<id:string,name:string,arguments:string,result:string>>")
    no_calls = F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>")
    told = F.transform(turns, lambda t: F.struct(t["turn_index"].alias("turn_index"), t["user"].alias("user"), t["assistant"].alias("assistant"), F.coalesce(t["tool_events"], no_events).alias("events")))
    told = F.array_sort(told)
    counts = F.transform(told, lambda t: F.size(t["events"]))
    before = F.slice(F.aggregate(counts, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n))), 1, F.size(told))

    def message(role, content, called, call_id, name):
        return F.struct(F.lit(role).alias("role"), content.alias("content"), called.alias("calls"), call_id.alias("tool_call_id"), name.alias("name"))

    def said(t, n):
        own = lambda e, i: F.coalesce(F.nullif(e["id"], F.lit("")), F.concat(F.lit("call_"), (n + i).cast("string")))
        calls = F.transform(t["events"], lambda e, i: F.struct(own(e, i).alias("id"), e["name"].alias("name"), e["arguments"].alias("arguments")))
        user, last = (F.array(message(role, t[role], no_calls, none, none)) for role in ("user", "assistant"))
        used = F.filter(F.array(message("assistant", F.lit(""), calls, none, none)), lambda m: F.size(m["calls"]) > 0)
        results = F.transform(t["events"], lambda e, i: message("tool", e["result"], no_calls, own(e, i), e["name"]))
        kept = F.filter(F.concat(user, used, results, last), lambda m: m["calls"].isNotNull() | (F.coalesce(m["content"], F.lit("")) != ""))
        names = ("role", "content", "calls", "tool_call_id", "name")
        return F.transform(kept, lambda m, pos: F.struct(t["turn_index"].alias("turn_index"), pos.alias("pos"), *[m[c].alias(c) for c in names]))

    out = F.array_sort(F.flatten(F.zip_with(told, before, said)))
    return F.get(F.filter(F.array(out), lambda x: F.size(x) > 0), F.lit(0))


def flatten_turns(conversations: DataFrame) -> DataFrame:
    """A row for each turn of a conversation's array, its structs opened one level: names joined by an underscore."""
    rows = conversations.select(*[c for c in conversations.columns if c != "turns"], F.explode("turns").alias("t"))
    fields = []
    for f in conversations.schema["turns"].dataType.elementType.fields:
        if f.dataType.typeName() == "struct":
            fields += [F.col(f"t.{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
        else:
            fields.append(F.col(f"t.{f.name}"))
    return rows.select(*[c for c in rows.columns if c != "t"], *fields)


def sft_metadata(turns: Column) -> Column:
    """Per-turn sequences without blanks, and the greatest difficulty."""

    def said(name: str) -> Column:
        return F.filter(F.transform(turns, lambda t: t[name]), lambda x: F.coalesce(x, F.lit("")) != "").alias(f"{name}_sequence")

    names = ("difficulty", "intent", "coverage_target", "question_mode", "seed_topic")
    return F.struct(*[said(n) for n in names], max_difficulty(F.transform(turns, lambda t: t["difficulty"])).alias("difficulty_max"))


def max_difficulty(levels: Column) -> Column:
    """The hardest of easy, medium, hard in an array; other words don't count; blank if none does."""
    rank = F.array_max(F.transform(levels, lambda x: F.coalesce(F.array_position(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), F.lower(F.trim(x))), F.lit(0))))
    return F.when(rank == 3, "hard").when(rank == 2, "medium").when(rank == 1, "easy").otherwise("")


def user_reasoning(turns: Column) -> Column:
    """Of each turn what its question was made from."""
    names = ("turn_index", "user", "intent", "difficulty", "grounding_facts", "coverage_target", "notes_for_assistant", "question_mode", "seed_topic", "seed_question")
    return F.transform(turns, lambda t: F.struct(*[t[n].alias(n) for n in names]))


def assistant_reasoning(turns: Column) -> Column:
    """Of each turn the answer, whether it searched the web, and its reasoning trace."""
    names = ("turn_index", "assistant", "did_web_search", "reasoning_trace")
    return F.transform(turns, lambda t: F.struct(*[t[n].alias(n) for n in names]))


def evidence(turns: Column, cap: int = EVIDENCE_CAP) -> Column:
    """Facts and trace evidence of the turns as (source, content), the first ``cap``."""
    facts = F.flatten(F.transform(turns, lambda t: F.transform(t["grounding_facts"], lambda f: F.struct(f["source_descriptor"].alias("source"), f["fact"].alias("content")))))
    traced = F.flatten(
        F.transform(
            turns,
            lambda t: F.transform(
                t["evidence"], lambda e: F.struct(F.coalesce(F.nullif(e["cue"], F.lit("")), e["id"]).alias("source"), e["content"].alias("content"))
            ),
        )
    )
    return F.slice(F.concat(facts, traced), 1, cap)


def prior_turns(turns: DataFrame, *columns: str) -> DataFrame:
    """Each turn with the turns before it, in order, as an array ``prior``: what a judge of that turn may see."""
    w = W.partitionBy("conv_id").orderBy("turn_index").rowsBetween(W.unboundedPreceding, -1)
    return turns.withColumn("prior", F.collect_list(F.struct("turn_index", *columns)).over(w))


def emits_judged(conversation_judge: Column, judge_enabled: Column, turn_judges: Column) -> Column:
    """Whether a judged record is due: a conversation's verdict, judging switched on, or some turn's verdict; verdicts that
    only note that judging is disabled don't count. Verdicts are structs with notes, null where there is none."""
    real = lambda j: j.isNotNull() & (F.coalesce(j["notes"], F.lit("")) != "disabled")
    return real(conversation_judge) | F.coalesce(judge_enabled, F.lit(False)) | F.coalesce(F.exists(turn_judges, real), F.lit(False))


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Logical column names as configured; unknown names are ignored, a blank one keeps the default."""
    wanted = {ALIASES.get(k, k): v.strip() for k, v in names.items() if v and v.strip()}
    return df.withColumnsRenamed({k: v for k, v in wanted.items() if k in LOGICAL_COLUMNS and k in df.columns})


def persona_line(name: Column, traits: Column, style: Column) -> Column:
    """``name | traits, in a row | style``, without the parts that are empty."""
    parts = F.array(F.coalesce(name, F.lit("")), F.coalesce(F.array_join(traits, ", "), F.lit("")), F.coalesce(style, F.lit("")))
    return F.array_join(F.filter(parts, lambda p: p != ""), " | ")


def conversation_id(run: Column, index: Column) -> Column:
    return F.format_string("%s-%04d", run, index.cast("int"))
