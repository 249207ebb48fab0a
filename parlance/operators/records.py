"""Finished conversations as records: verdicts, flattened turns, traces as they are written, inputs of questions and slots.

A turn is a struct of turn_index, user, assistant, intent, difficulty, coverage_target, grounding_facts,
notes_for_assistant, question_mode, seed_topic, seed_question, did_web_search, reasoning_trace, judge and tool_events;
a verdict a struct of score, reasons, notes, question_ok and answer_ok, null where nothing was judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import is_object, strip
from parlance.operators.canonical import get, items_of, kind_of, text_of
from parlance.operators.conversations import NO_HISTORY, evidence

VERDICT = "struct<score:double,reasons:array<string>,notes:string,question_ok:boolean,answer_ok:boolean>"
#: The entries of a reasoning trace that are normalised when it is written.
NORMALISED = ("thinking", "premises")


def judge_payload(turns: Column, conversation: Column) -> Column:
    """The verdicts of a conversation: those of its judged turns with their texts, their mean score, and its own."""
    judged = F.filter(turns, lambda t: t["judge"].isNotNull())
    per_turn = F.transform(
        judged,
        lambda t: F.struct(
            t["turn_index"].alias("turn_index"), t["user"].alias("user_message"), t["assistant"].alias("assistant_message"), t["judge"]["score"].alias("score"),
            F.coalesce(t["judge"]["reasons"], F.array().cast("array<string>")).alias("reasons"), t["judge"]["notes"].alias("notes"),
            t["judge"]["question_ok"].alias("question_ok"), t["judge"]["answer_ok"].alias("answer_ok"),
        ),
    )
    scores = F.filter(F.transform(per_turn, lambda t: t["score"]), lambda s: s.isNotNull())
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.size(scores))
    return F.struct(per_turn.alias("per_turn"), mean.alias("avg_score"), conversation.alias("conversation"))


def judgeable(conversations: DataFrame) -> DataFrame:
    """Conversations with a turn at least; the rest has nothing to judge."""
    return conversations.filter(F.size(F.coalesce("turns", F.array())) > 0)


def over_base(slot: Column, base: Column) -> Column:
    """Union of two maps in which the slot's values win; a null map is empty."""
    none = F.create_map().cast("map<string,string>")
    own, shared = F.coalesce(slot, none), F.coalesce(base, none)
    return F.map_concat(F.map_filter(shared, lambda k, _: ~F.map_contains_key(own, k)), own)


def compact_json(x: Column) -> Column:
    """A struct, array or map as one line of JSON, null entries kept."""
    return F.to_json(x, {"ignoreNullFields": "false"})


def string_map(m: Column) -> Column:
    """Keys and values stripped and in lower case, blank ones left out; of keys that become alike the last wins."""
    low = lambda x: F.lower(strip(F.coalesce(x.cast("string"), F.lit(""))))
    entries = F.transform(F.map_entries(m), lambda e: F.struct(low(e["key"]).alias("key"), low(e["value"]).alias("value")))
    entries = F.filter(entries, lambda e: (e["key"] != "") & (e["value"] != ""))
    backward = F.reverse(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(backward, e["key"]) == F.size(entries) - i))


def written_trace(v: Column) -> Column:
    """A reasoning trace (a variant) as it is written with a turn: thinking, premises, and the other entries as JSON texts.

    Thinking is a list of texts whatever it was; a list's premises get their four entries, the first of assumption, note
    and text_note that is there standing for the assumption; what is missing stays null. Null unless ``v`` is an object.
    """
    thought, held = get(v, "$.thinking"), get(v, "$.premises")
    there = lambda x: x.isNotNull() & (kind_of(x) != "VOID")
    thinking = F.transform(items_of(thought), lambda e: F.struct(F.when(is_object(e), text_of(get(e, "$.text"))).otherwise(text_of(e)).alias("text")))
    some = lambda e, name: F.when(there(get(e, f"$.{name}")), text_of(get(e, f"$.{name}")))
    refs = lambda e: F.filter(F.transform(items_of(get(e, "$.evidence_refs")), text_of), lambda r: strip(r) != "")
    premises = F.transform(
        items_of(held),
        lambda e: F.struct(
            F.when(is_object(e), text_of(get(e, "$.id"))).otherwise("").alias("id"),
            F.when(is_object(e), text_of(get(e, "$.text"))).otherwise(text_of(e)).alias("text"),
            F.when(is_object(e), refs(e)).otherwise(F.array().cast("array<string>")).alias("evidence_refs"),
            F.when(is_object(e), F.coalesce(some(e, "assumption"), some(e, "note"), some(e, "text_note"), F.lit(""))).otherwise("").alias("assumption"),
        ),
    )
    rest = F.map_filter(v.cast("map<string,variant>"), lambda k, _: ~k.isin(*NORMALISED))
    return F.when(
        is_object(v),
        F.struct(
            F.when(there(thought), thinking).alias("thinking"),
            F.when(kind_of(held) == "ARRAY", premises).alias("premises"),
            F.transform_values(rest, lambda _, x: F.to_json(x)).alias("rest"),
        ),
    )


def turn_rows(conversations: DataFrame) -> DataFrame:
    """A row of 23 columns for each turn; ``conversations`` has conversation_id, timestamp, judge_granularity, conversation_judge and turns."""
    t = conversations.select("conversation_id", "timestamp", "judge_granularity", "conversation_judge", F.explode("turns").alias("t"))
    plain = ("question_mode", "seed_topic", "seed_question", "intent", "difficulty", "coverage_target")
    verdict = [F.col(f"t.judge.{c}").alias(f"judge_{c}") for c in ("score", "reasons", "notes", "question_ok", "answer_ok")]
    return t.select(
        "conversation_id", "timestamp", "t.turn_index", F.col("t.user").alias("user_message"), F.col("t.assistant").alias("assistant_message"),
        *[f"t.{c}" for c in plain], "t.grounding_facts", "t.notes_for_assistant", "t.reasoning_trace", "t.did_web_search", "judge_granularity", *verdict,
        F.col("conversation_judge.score").alias("conversation_judge_score"), F.col("conversation_judge.reasons").alias("conversation_judge_reasons"),
    )


def question_inputs(slots: DataFrame, snippets: DataFrame, seeds: DataFrame, ledger_recent: list[str]) -> DataFrame:
    """What a slot's next question is asked with, in one record.

    ``slots`` has slot, mode, forced (whether the mode was), last_assistant and own_questions; ``snippets`` slot, rank and
    text of the topics' passages, some for each slot; ``seeds`` slot, topic and question of seed questions. A seed makes the mode seeded
    unless it is forced. Recent questions are the ledger's (its last few, a short list) and then the conversation's own, the last ten.
    """
    found = F.array_sort(F.collect_list(F.struct("rank", "text")))
    by_slot = snippets.groupBy("slot").agg(F.transform(found, lambda s: s["text"]).alias("topic_snippets"))
    seeded = seeds.select("slot", F.col("topic").alias("seed_topic"), F.col("question").alias("seed_question"))
    rows = slots.join(seeded, "slot", "left").join(by_slot, "slot", "left")
    use = F.coalesce(F.col("seed_question") != "", F.lit(False)) & ~F.col("forced")
    both = F.concat(F.array(*map(F.lit, ledger_recent)).cast("array<string>"), F.coalesce("own_questions", F.array().cast("array<string>")))
    return rows.select(
        "slot",
        F.when(use, "seeded").otherwise(F.col("mode")).alias("question_mode"),
        F.coalesce(F.nullif("last_assistant", F.lit("")), F.lit("No prior assistant answer.")).alias("last_assistant_message"),
        F.coalesce("topic_snippets", F.array().cast("array<string>")).alias("topic_snippets"),
        F.slice(both, F.greatest(F.lit(1), F.size(both) - 9), 10).alias("recent_user_questions"),
        F.when(use, F.col("seed_topic")).otherwise("").alias("seed_topic"),
        F.when(use, F.col("seed_question")).otherwise("").alias("seed_question"),
    )


def conversation_judge_inputs(conversations: DataFrame) -> DataFrame:
    """What a judge of whole conversations is given: conversation_id, public_history as lines, turns and evidence as JSON, turn_count.

    ``conversations`` has conversation_id and turns; all is made within the row.
    """
    said = lambda t, role, name: F.when(F.coalesce(t[name], F.lit("")) != "", F.concat(F.lit("Turn "), t["turn_index"].cast("string"), F.lit(f" - {role}: "), t[name]))
    lines = F.flatten(F.transform("turns", lambda t: F.array(said(t, "User", "user"), said(t, "Assistant", "assistant"))))
    history = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
    told = F.transform("turns", lambda t: F.struct(t["turn_index"].alias("turn_index"), t["user"].alias("user_message"), t["assistant"].alias("assistant_message")))
    as_json = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    return conversations.select(
        "conversation_id", F.when(history == "", NO_HISTORY).otherwise(history).alias("public_history"), as_json(told).alias("turns_json"), as_json(evidence(F.col("turns"))).alias("evidence_json"), F.size("turns").alias("turn_count"),
    )
