"""More queries over the test tables: records of conversations, choices, parsing, stages, sinks and sources."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions.tables import shared_folder
from parlance.operators import canonical, chunking, conversations, coverage, dedup, records, retrieval, sampling, stats
from parlance.plans import config, state
from parlance.plans.catalog import CHUNKS, PAIRED, norm_sql, paired_turns, query, read, u_sql
from parlance.sources import adapters

#: A turn's fields, in words that both engines have.
FIELDS = {
    "intent": "CASE WHEN (conv_id + turn_index) % 4 = 0 THEN '' WHEN length(said) % 2 = 0 THEN 'learn' ELSE 'compare' END",
    "difficulty": "CASE WHEN length(said) % 5 = 0 THEN 'hard' WHEN length(said) % 5 = 1 THEN 'medium' WHEN length(said) % 5 = 2 THEN 'easy' ELSE '' END",
    "coverage_target": "CASE WHEN turn_index % 2 = 0 THEN concat('doc ', conv_id) ELSE '' END",
    "question_mode": "CASE WHEN turn_index = 1 THEN 'seeded' WHEN length(said) % 3 = 0 THEN 'fresh' ELSE 'followup' END",
    "seed_topic": "CASE WHEN turn_index = 1 THEN concat('topic ', conv_id % 7) ELSE '' END",
    "seed_question": "CASE WHEN turn_index = 1 THEN concat('seed ', conv_id) END",
    "did_web_search": "length(said) % 7 = 0",
    "score": "CASE WHEN turn_index % 4 = 0 OR turn_index % 3 = 0 THEN NULL ELSE length(said) % 11 END",
    "notes": "CASE WHEN conv_id % 2 = 0 THEN 'disabled' ELSE concat('n', turn_index) END",
}
WIDE = f"""SELECT *, {', '.join(f'{x} AS {n}' for n, x in FIELDS.items())} FROM (SELECT conv_id, turn_index, "user" AS said, assistant AS answer FROM ({PAIRED}))"""


def wide(spark, d) -> DataFrame:
    rows = paired_turns(spark, d).select("conv_id", "turn_index", F.col("user").alias("said"), F.col("assistant").alias("answer"))
    return rows.select("*", *[F.expr(x).alias(n) for n, x in FIELDS.items()])


def nested(spark, d) -> DataFrame:
    """Conversations with their turns as an array: each third turn has no facts, each fourth no verdict."""
    verdict = "CASE WHEN turn_index % 4 <> 0 THEN named_struct('score', cast(score as double), 'reasons', array(concat('r', turn_index)), 'notes', notes, 'question_ok', length(said) % 2 = 0, 'answer_ok', turn_index % 2 = 0) END"
    facts = "filter(array(named_struct('fact', concat('f', turn_index), 'source_descriptor', concat('d', conv_id))), x -> turn_index % 3 <> 0)"
    found = "filter(array(named_struct('id', 'e1', 'cue', '', 'content', concat('c', turn_index)), named_struct('id', 'e2', 'cue', 'cue', 'content', intent)), x -> turn_index % 2 = 0)"
    event = "filter(array(named_struct('id', CASE WHEN turn_index % 2 = 0 THEN 'given' ELSE '' END, 'name', 'search', 'arguments', '{}', 'result', concat('found ', turn_index))), x -> conv_id % 3 = 0)"
    turn = F.struct(
        "turn_index", F.col("said").alias("user"), F.col("answer").alias("assistant"), *[n for n in FIELDS if n not in ("score", "notes")], F.expr(verdict).alias("judge"), F.expr(facts).alias("grounding_facts"),
        F.expr("array(concat('n', turn_index))").alias("notes_for_assistant"), F.expr("concat('{\"question\":\"', turn_index, '\"}')").alias("reasoning_trace"), F.expr(found).alias("evidence"), F.expr(event).alias("tool_events"),
    )
    return wide(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def done(spark, d) -> DataFrame:
    """Finished conversations, as they are written."""
    whole = F.struct((F.col("conv_id") % 10).cast("double").alias("score"), F.array(F.lit("all")).alias("reasons"), F.lit("whole").alias("notes"), F.lit(True).alias("question_ok"), F.lit(None).cast("boolean").alias("answer_ok"))
    return nested(spark, d).select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("conversation_id"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.concat(F.lit("q"), F.col("conv_id")).alias("question"), F.lit("en").alias("language"),
        F.when(F.col("conv_id") % 2 == 0, 9).alias("n_turns"), F.lit("a | b").alias("personas"), (F.col("conv_id") % 5 == 0).alias("judge_enabled"), F.lit("turn").alias("judge_granularity"),
        F.when(F.col("conv_id") % 3 == 0, whole).alias("conversation_judge"), "turns",
    )


@query(
    f"""SELECT concat('c', conv_id) AS conversation_id, '2024-01-01T00:00:00Z' AS "timestamp", turn_index, said AS user_message, answer AS assistant_message, question_mode, seed_topic, seed_question, intent, difficulty, coverage_target,
    CASE WHEN turn_index % 3 <> 0 THEN concat('f', turn_index, '@d', conv_id) ELSE '' END AS grounding_facts, concat('n', turn_index) AS notes_for_assistant, concat('{{"question":"', turn_index, '"}}') AS reasoning_trace, did_web_search,
    'turn' AS judge_granularity, CASE WHEN turn_index % 4 <> 0 THEN score::DOUBLE END AS judge_score, CASE WHEN turn_index % 4 <> 0 THEN concat('r', turn_index) ELSE '' END AS judge_reasons, CASE WHEN turn_index % 4 <> 0 THEN notes END AS judge_notes,
    CASE WHEN turn_index % 4 <> 0 THEN length(said) % 2 = 0 END AS judge_question_ok, CASE WHEN turn_index % 4 <> 0 THEN turn_index % 2 = 0 END AS judge_answer_ok,
    CASE WHEN conv_id % 3 = 0 THEN (conv_id % 10)::DOUBLE END AS conversation_judge_score, CASE WHEN conv_id % 3 = 0 THEN 'all' ELSE '' END AS conversation_judge_reasons FROM ({WIDE})"""
)
def flattened_turns(spark, d):
    rows = records.turn_rows(done(spark, d))
    facts = F.array_join(F.transform("grounding_facts", lambda f: F.concat(f["fact"], F.lit("@"), f["source_descriptor"])), ",")
    rows = rows.withColumn("grounding_facts", facts)
    return rows.withColumns({c: F.coalesce(F.array_join(c, ","), F.lit("")) for c in ("notes_for_assistant", "judge_reasons", "conversation_judge_reasons")})


@query(f"SELECT conv_id, turn_index, said AS \"user\", intent, difficulty, coverage_target, question_mode, seed_topic, seed_question, CASE WHEN turn_index % 3 <> 0 THEN 1 ELSE 0 END AS n_facts FROM ({WIDE})")
def user_reasoning_rows(spark, d):
    rows = nested(spark, d).select("conv_id", F.explode(conversations.user_reasoning(F.col("turns"))).alias("r")).select("conv_id", "r.*")
    return rows.withColumn("n_facts", F.size("grounding_facts")).drop("grounding_facts", "notes_for_assistant")


@query(f"SELECT conv_id, turn_index, answer AS assistant, did_web_search, concat('{{\"question\":\"', turn_index, '\"}}') AS reasoning_trace FROM ({WIDE})")
def assistant_reasoning_rows(spark, d):
    return nested(spark, d).select("conv_id", F.explode(conversations.assistant_reasoning(F.col("turns"))).alias("r")).select("conv_id", "r.*")


@query(
    f"""SELECT conv_id, count(*) FILTER (turn_index % 4 <> 0) AS n_judged, round(avg(score::DOUBLE) FILTER (turn_index % 4 <> 0), 9) AS avg_score,
    coalesce(string_agg(concat('r', turn_index), ',' ORDER BY turn_index) FILTER (turn_index % 4 <> 0), '') AS reasons, any_value(CASE WHEN conv_id % 3 = 0 THEN 'whole' END) AS conversation FROM ({WIDE}) GROUP BY conv_id"""
)
def judge_payloads(spark, d):
    rows = done(spark, d).select(F.substring("conversation_id", 2, 20).cast("long").alias("conv_id"), records.judge_payload(F.col("turns"), F.col("conversation_judge")).alias("p"))
    reasons = F.array_join(F.flatten(F.transform("p.per_turn", lambda t: t["reasons"])), ",")
    return rows.select("conv_id", F.size("p.per_turn").cast("long").alias("n_judged"), F.round("p.avg_score", 9).alias("avg_score"), reasons.alias("reasons"), F.col("p.conversation.notes").alias("conversation"))


@query(
    f"""WITH t AS ({WIDE}), e AS (SELECT conv_id, 0 AS part, turn_index, 0 AS k, concat('d', conv_id, ':f', turn_index) AS x FROM t WHERE turn_index % 3 <> 0
    UNION ALL SELECT conv_id, 1, turn_index, 1, concat('e1:c', turn_index) FROM t WHERE turn_index % 2 = 0 UNION ALL SELECT conv_id, 1, turn_index, 2, concat('cue:', intent) FROM t WHERE turn_index % 2 = 0)
    SELECT c.conv_id, coalesce(string_agg(x, '|' ORDER BY part, turn_index, k), '') AS evidence FROM (SELECT DISTINCT conv_id FROM t) c LEFT JOIN e USING (conv_id) GROUP BY c.conv_id"""
)
def evidence_union(spark, d):
    lines = F.transform(conversations.evidence(F.col("turns")), lambda e: F.concat(e["source"], F.lit(":"), e["content"]))
    return nested(spark, d).select("conv_id", F.array_join(lines, "|").alias("evidence"))


@query(
    f"""SELECT conv_id, turn_index, 0 AS pos, 'user' AS role, said AS message, intent, difficulty FROM ({WIDE}) WHERE said <> ''
    UNION ALL SELECT conv_id, turn_index, 1, 'assistant', answer, NULL, NULL FROM ({WIDE}) WHERE answer <> ''"""
)
def private_history(spark, d):
    return conversations.conversation_history(wide(spark, d).withColumnsRenamed({"said": "user", "answer": "assistant"}))


@query(f"SELECT conv_id, turn_index, 0 AS pos, 'user' AS role, said AS message FROM ({WIDE}) WHERE said <> '' UNION ALL SELECT conv_id, turn_index, 1, 'assistant', answer FROM ({WIDE}) WHERE answer <> ''")
def public_history(spark, d):
    return conversations.conversation_history(wide(spark, d).withColumnsRenamed({"said": "user", "answer": "assistant"}), private=False)


@query(
    """SELECT conv_id, coalesce(string_agg(concat(role, ':', length(text), ':', coalesce(agent, '-')), '|' ORDER BY turn) FILTER (turn % 5 <> 4), '') AS messages FROM (
    SELECT *, CASE WHEN turn % 3 = 1 THEN 'kb' END AS agent FROM conversations) GROUP BY conv_id"""
)
def public_message_list(spark, d):
    message = F.struct("turn", F.when(F.col("turn") % 5 == 4, "").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"), F.expr("CASE turn % 3 WHEN 1 THEN 'kb' WHEN 2 THEN '' END").alias("agent"))
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    line = lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"), F.lit(":"), F.coalesce(m["agent"], F.lit("-")))
    return rows.select("conv_id", F.array_join(F.transform(conversations.public_messages(F.col("m")), line), "|").alias("messages"))


@query(
    """WITH c AS (SELECT doc_id % 40 AS slot, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id)::INT AS rank, source, doc_id FROM documents),
    r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents WHERE source <> ''), q AS (SELECT source, string_agg(doc_id, ',' ORDER BY doc_id) AS recent FROM r WHERE n <= 5 GROUP BY source)
    SELECT slot, rank, doc_id, coalesce(recent, '') AS recent FROM c LEFT JOIN q USING (source) WHERE rank <= 6"""
)
def topic_snippet_rows(spark, d):
    docs = read(spark, d, "documents")
    order = F.row_number().over(W.partitionBy("slot").orderBy("doc_id"))
    found = docs.select((F.col("doc_id") % 40).alias("slot"), "source", "doc_id").withColumn("rank", order)
    ledger = docs.select(F.col("source").alias("source_path"), "source", F.col("doc_id").cast("string").alias("question"), F.col("doc_id").alias("seq"))
    rows = coverage.topic_snippets(found, coverage.recent_per_source(ledger))
    return rows.select("slot", "rank", "doc_id", F.array_join("recent_questions", ",").alias("recent"))


@query("SELECT conv_id, count(*) AS chat, max(turn) AS metadata, min(turn) AS tools FROM conversations GROUP BY conv_id")
def renamed_columns(spark, d):
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("metadata"), F.min("turn").alias("messages_with_tools"))
    return conversations.rename_columns(rows, {"messages": " chat ", "message_with_tools": "tools", "metadata": " ", "other": "x"})


@query("SELECT doc_id, concat(lang, CASE WHEN doc_id % 2 = 0 THEN concat(' | ', source, ', x', doc_id % 3) ELSE '' END, CASE WHEN doc_id % 4 = 1 THEN ' | calm' ELSE '' END) AS persona FROM documents")
def persona_lines(spark, d):
    traits = F.when(F.col("doc_id") % 2 == 0, F.array("source", F.concat(F.lit("x"), F.col("doc_id") % 3)))
    return read(spark, d, "documents").select("doc_id", conversations.persona_line(F.col("lang"), traits, F.when(F.col("doc_id") % 4 == 1, "calm")).alias("persona"))


@query("SELECT c_custkey, concat(replace(c_name, '#', '{{ k }}#'), ' of ', c_nationkey, ': ', CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END, '.') AS text FROM customer")
def rendered_templates(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.regexp_replace("c_name", "#", "{{ k }}#").alias("name"), "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))

    def render(batches):
        for b in batches:
            values = [{"name": n, "nation": int(k), "segment": s} for n, k, s in zip(b["name"], b["c_nationkey"], b["segment"])]
            yield pd.DataFrame({"c_custkey": b["c_custkey"], "text": [config.render_template("{{name}} of {{ nation }}: {{segment}}{{ missing }}.", v) for v in values]})

    return rows.mapInPandas(render, "c_custkey long, text string")


@query(f"SELECT conv_id, count(*) AS n FROM ({PAIRED}) WHERE conv_id % 3 <> 0 GROUP BY conv_id")
def judgeable_conversations(spark, d):
    rows = nested(spark, d).withColumn("turns", F.when(F.col("conv_id") % 3 == 0, F.when(F.col("conv_id") % 2 == 0, F.slice("turns", 1, 0))).otherwise(F.col("turns")))
    return records.judgeable(rows).select("conv_id", F.size("turns").cast("long").alias("n"))


SLOTS = """SELECT doc_id::INT AS conversation_index, CASE doc_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'completed' WHEN 2 THEN 'dropped' ELSE 'odd' END AS status, (doc_id % 3)::INT AS n_turns, (doc_id % 5)::INT AS target FROM documents"""


def _slots(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("active", "completed", "dropped", "odd"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, d, "documents").select(
        F.col("doc_id").cast("int").alias("conversation_index"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("id"), "doc_id")).otherwise(" ").alias("conversation_id"), (F.col("doc_id") % 5).cast("int").alias("target_n_turns"),
        status.alias("status"), F.lit(None).cast("string").alias("drop_reason"), (F.col("doc_id") % 3).cast("int").alias("n_turns"),
    )


@query(f"SELECT conversation_index FROM ({SLOTS}) WHERE n_turns > 0")
def persistable_slots(spark, d):
    return state.persistable(_slots(spark, d)).select("conversation_index")


@query(f"SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'dropped') AS dropped FROM ({SLOTS})")
def slot_outcomes(spark, d):
    return state.outcome_counts(_slots(spark, d))


@query(
    f"""SELECT i::INT AS conversation_index, CASE WHEN s.conversation_index IS NOT NULL AND i % 2 = 0 THEN concat('id', i) ELSE format('run-{{:04d}}', i) END AS conversation_id, CASE WHEN target > 0 THEN target ELSE 7 END AS target_n_turns,
    CASE WHEN status IN ('active', 'completed', 'dropped') THEN status ELSE 'active' END AS status, '' AS drop_reason, coalesce(n_turns, 0) AS n_turns
    FROM range(1500) r(i) LEFT JOIN ({SLOTS}) s ON s.conversation_index = i"""
)
def restored_slots(spark, d):
    return state.restore_slots(spark, "run", _slots(spark, d), 1500, 7)


@query(
    f"""SELECT conversation_index, target AS target_n_turns, CASE WHEN conversation_index % 11 = 0 THEN 'dropped' WHEN status = 'active' AND n_turns + (conversation_index % 2) >= target THEN 'completed' ELSE status END AS status,
    CASE WHEN conversation_index % 11 = 0 THEN 'dedup_exhausted' END AS drop_reason, (n_turns + (conversation_index % 2))::INT AS n_turns FROM ({SLOTS})"""
)
def advanced_slots(spark, d):
    slots = _slots(spark, d)
    gone = slots.filter("conversation_index % 11 = 0").select("conversation_index", F.lit("dedup_exhausted").alias("drop_reason"))
    return state.advance(slots, slots.filter("conversation_index % 2 = 1"), gone).drop("conversation_id")


@query(
    """WITH s AS (SELECT doc_id AS slot, source AS topic_id FROM documents), n AS (SELECT doc_id AS slot, CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE source END AS topic_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '/data/' || source END AS p, CASE WHEN doc_id % 5 <> 0 THEN source || '#1' END AS d FROM documents)
    SELECT slot, topic_id, coalesce(nullif(p, ''), d, '') AS source_path FROM s LEFT JOIN n USING (slot, topic_id)"""
)
def resolved_sources(spark, d):
    docs = read(spark, d, "documents")
    topic = F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.col("source"))
    path, name = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("/data/"), "source")), F.when(F.col("doc_id") % 5 != 0, F.concat("source", F.lit("#1")))
    found = docs.select(F.col("doc_id").alias("slot"), topic.alias("topic_id"), F.lit(1).alias("rank"), path.alias("source_path"), name.alias("source_descriptor"))
    later = found.withColumns({"rank": F.lit(2), "source_path": F.lit("/later"), "source_descriptor": F.lit("later")})
    return coverage.resolve_source(docs.select(F.col("doc_id").alias("slot"), F.col("source").alias("topic_id")), found.unionByName(later))


@query(f"SELECT doc_id, substr(sha256({norm_sql('text')}), 1, 16) AS question_hash, TRUE AS is_utc FROM documents WHERE trim(text) <> '' AND doc_id % 2 = 0")
def ledger_appends(spark, d):
    rows = coverage.ledger_rows(read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("question")))
    return rows.select("doc_id", "question_hash", F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z$").alias("is_utc"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM events")
def utc_texts(spark, d):
    return read(spark, d, "events").select("event_id", T.utc_text(F.col("ts")).alias("at"))


SEEDS = """s AS (SELECT source AS topic, 's' || doc_id AS question, substr(sha256('s' || doc_id), 1, 16) AS h FROM documents WHERE source <> ''),
    l AS (SELECT DISTINCT doc_id, source AS topic, substr(sha256('s' || doc_id), 1, 16) AS h FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND source <> '')"""


def _seeds(spark, d):
    docs = read(spark, d, "documents").filter("source <> ''").select("doc_id", F.col("source").alias("topic"), F.concat(F.lit("s"), "doc_id").alias("question"))
    used = read(spark, d, "labels").filter("quality = 1").select("doc_id").distinct().join(docs, "doc_id").select(F.col("topic").alias("seed_topic"), T.question_hash(F.col("question")).alias("seed_question_hash"))
    return docs.drop("doc_id"), used


@query(
    f"""WITH {SEEDS}, u AS (SELECT topic, count(*) AS used FROM l GROUP BY topic), e AS (SELECT s.*, coalesce(used, 0) AS used FROM s LEFT JOIN u USING (topic) WHERE h NOT IN (SELECT h FROM l)),
    n AS (SELECT topic, question, h, row_number() OVER (ORDER BY md5('4:' || h), topic, question) - 1 AS place, count(*) OVER () AS n FROM e WHERE used = (SELECT min(used) FROM e)),
    a AS (SELECT slot, floor({u_sql('4-q', 'slot')} * (SELECT max(n) FROM n))::INT AS place FROM (SELECT DISTINCT conv_id AS slot FROM conversations) WHERE {u_sql('4-p', 'slot')} <= 0.6)
    SELECT slot, topic, question FROM a JOIN n USING (place)"""
)
def seed_questions(spark, d):
    asked, used = _seeds(spark, d)
    slots = read(spark, d, "conversations").select(F.col("conv_id").alias("slot")).distinct()
    return sampling.seed_question(asked, used, slots, seed=4, probability=0.6).select("slot", "topic", "question")


@query("SELECT c.conv_id, array_to_string(list_slice(q, greatest(1, len(q) - 9), len(q)), ',') AS recent FROM (SELECT conv_id, list_concat(['l1', 'l2', 'l3'], coalesce(list('t' || turn ORDER BY turn) FILTER (role = 'user'), [])) AS q FROM conversations GROUP BY conv_id) c")
def recent_questions(spark, d):
    own = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.col("turn")))), lambda t: F.concat(F.lit("t"), t.cast("string")))
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(own.alias("own"))
    return rows.select("conv_id", F.array_join(coverage.recent_questions(F.array(F.lit("l1"), F.lit("l2"), F.lit("l3")), F.col("own")), ",").alias("recent"))


@query("SELECT source, round(avg(10.0::DOUBLE * quality), 9) AS mean FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def mean_scores(spark, d):
    both = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return stats.mean_by(both, 10.0 * F.col("quality"), "source").select("source", F.round("mean", 9).alias("mean"))


@query(f"SELECT md5(q) AS question FROM (SELECT {norm_sql('text')} AS q FROM conversations WHERE role = 'user' UNION SELECT {norm_sql('text')} FROM benchmark) WHERE q <> ''")
def question_registry(spark, d):
    asked = dedup.registry(read(spark, d, "conversations").filter("role = 'user'").select(F.col("text").alias("question")), read(spark, d, "benchmark").select(F.col("text").alias("question")))
    return asked.select(F.md5("question").alias("question"))


@query(
    """WITH a AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS n, doc_id % 50 AS q FROM documents), r1 AS (SELECT doc_id FROM a WHERE n > 1 OR q = 7),
    b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 80 ORDER BY doc_id) AS n FROM r1)
    SELECT doc_id::INT AS conversation_index, 'Q' || q AS question, 0 AS attempt FROM a WHERE n = 1 AND q <> 7 UNION ALL SELECT doc_id::INT, 'R' || (doc_id % 80), 1 FROM b WHERE n = 1
    UNION ALL SELECT doc_id::INT, 'dedup_exhausted', NULL FROM b WHERE n > 1"""
)
def retried_questions(spark, d):
    slots = read(spark, d, "documents").select(F.col("doc_id").cast("int").alias("conversation_index"))
    ask = lambda s, n: s.withColumn("question", F.concat(F.lit("QR"[n]), (F.col("conversation_index") % (50, 80)[n]).cast("string")))
    good, gone = dedup.commit_with_retries(slots, ask, spark.createDataFrame([("q7 ",)], "question string"), retries=1)
    return good.select("conversation_index", "question", "attempt").unionByName(gone.select("conversation_index", F.col("drop_reason").alias("question"), F.lit(None).cast("int").alias("attempt")))


@query(
    """WITH c AS (SELECT doc_id % 20 AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id)::INT AS rank, length(text) % 97 AS s FROM documents)
    SELECT query_id, doc_id, new_rank AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank)::INT AS new_rank FROM c WHERE rank <= 12) WHERE new_rank <= 4"""
)
def reranked(spark, d):
    order = F.row_number().over(W.partitionBy("query_id").orderBy("doc_id"))
    found = read(spark, d, "documents").select((F.col("doc_id") % 20).alias("query_id"), "doc_id", F.lit("q").alias("query"), "text").withColumn("rank", order).filter("rank <= 12")
    return retrieval.rerank(found, lambda q, t: t.str.len() % 97).select("query_id", "doc_id", "rank")


SEARCH = """SELECT q.vec_id AS query_id, c.vec_id AS id, list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings c"""


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({SEARCH})), k AS (SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY id % 7 DESC, rank) AS n FROM r WHERE rank <= 12)
    SELECT query_id, id, n::INT AS rank, concat('t', id) AS text FROM k WHERE n <= 3"""
)
def passage_search(spark, d):
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.concat(F.lit(" t"), "vec_id", F.lit(" ")).alias("text"), F.lit("s").alias("source"))
    asked = read(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit(" q"), "vec_id").alias("query"))
    embed = lambda df: df.join(vectors.select(F.col("id").alias("query_id"), "v"), "query_id")
    found = retrieval.search(asked, vectors, embed, k=0, default_k=3, score=lambda q, t: t.str.strip().str[1:].astype(int) % 7)
    return found.select("query_id", "id", "rank", "text")


FENCED = ['{"a": "x@"}', '```json\n{"a": "x@"}\n```', 'Sure: {"a": "x@"} done', "[1, @]", "no json", '{"a": 1} {"a": 2}', "", '```\ntext\n```\n{"a": "x@", }']


def _raw_sql(texts, key="item_id"):
    cases = " ".join(f"WHEN {k} THEN replace('{x}', '@', {key}::VARCHAR)" for k, x in enumerate(texts))
    return f"CASE {key} % {len(texts)} {cases} END"


def _raw(texts, key="item_id"):
    out = F
    for k, x in enumerate(texts):
        out = out.when(F.col(key) % len(texts) == k, F.replace(F.lit(x), F.lit("@"), F.col(key).cast("string")))
    return out


@query(
    f"""SELECT item_id, array_to_string(list_filter(string_split(raw, chr(10)), lambda x: NOT starts_with(x, '```')), chr(10)) AS bare, CASE item_id % 8 WHEN 1 THEN concat('{{"a": "x', item_id, '"}}') WHEN 2 THEN concat('{{"a": "x', item_id, '"}}') WHEN 0 THEN raw WHEN 5 THEN raw WHEN 7 THEN concat('{{"a": "x', item_id, '", }}') END AS outer_,
    CASE WHEN item_id % 8 < 3 THEN concat('x', item_id) END AS a FROM (SELECT item_id, {_raw_sql(FENCED)} AS raw FROM benchmark)"""
)
def fenced_texts(spark, d):
    rows = read(spark, d, "benchmark").select("item_id", _raw(FENCED).alias("raw"))
    return rows.select("item_id", T.strip_code_fences(F.col("raw")).alias("bare"), T.outer_object(F.col("raw")).alias("outer_"), canonical.get(T.parse_object(F.col("raw")), "$.a", "string").alias("a"))


WORDS = ["true", " YES ", "0", "off", "maybe", "", "2.5", "-1", "1e3", "99"]


@query(
    f"""SELECT event_id, coalesce(CASE lower(trim(w)) WHEN 'true' THEN TRUE WHEN 'yes' THEN TRUE WHEN '0' THEN FALSE WHEN 'off' THEN FALSE WHEN '' THEN FALSE END, TRUE) AS flag,
    greatest(0.0, least(10.0, coalesce(try_cast(trim(w) AS DOUBLE), 4.0))) AS held, w AS text FROM (SELECT event_id, CASE event_id % 10 {' '.join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(WORDS))} END AS w FROM events)"""
)
def lenient_casts(spark, d):
    w = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("event_id") % 10 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", T.as_bool(w, True).alias("flag"), T.clamp(w, 0.0, 10.0, 4.0).alias("held"), T.as_text(w).alias("text"))


NUMBERS = ["3", "2.5", '"7"', "true", '"x"', "null", "[1]", '{"a": 1}']


@query(f"SELECT event_id, CASE event_id % {len(NUMBERS)} WHEN 0 THEN 3.0 WHEN 1 THEN 2.5 WHEN 2 THEN 7.0 END::DOUBLE AS number FROM events")
def lenient_numbers(spark, d):
    raw = F.element_at(F.array(*map(F.lit, NUMBERS)), (F.col("event_id") % len(NUMBERS) + 1).cast("int"))
    return read(spark, d, "events").select("event_id", canonical.lenient_float(F.parse_json(raw)).alias("number"))


@query("SELECT event_id, concat('a=', lower(event_type), CASE WHEN user_id % 2 = 0 THEN ',b=y' ELSE '' END) AS entries FROM events")
def string_maps(spark, d):
    m = F.create_map(F.lit(" A "), F.lit("first"), F.lit("b"), F.when(F.col("user_id") % 2 == 0, " Y").otherwise(" "), F.lit("a"), F.upper("event_type"), F.lit(" "), F.lit("z"))
    rows = read(spark, d, "events").select("event_id", records.string_map(m).alias("m"))
    return rows.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("entries"))


@query("""SELECT event_id, concat('{"a":"', event_type, '","b":', CASE WHEN user_id % 2 = 0 THEN 'null' ELSE user_id::VARCHAR END, '}') AS line FROM events""")
def compact_lines(spark, d):
    value = F.struct(F.col("event_type").alias("a"), F.when(F.col("user_id") % 2 != 0, F.col("user_id")).alias("b"))
    return read(spark, d, "events").select("event_id", records.compact_json(value).alias("line"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'base' END AS a, 'kept' AS b, CASE WHEN doc_id % 2 = 0 THEN lang END AS c FROM documents")
def slots_over_base(spark, d):
    own = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("a"), F.col("source"), F.lit("c"), F.col("lang")))
    m = records.over_base(own, F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), F.lit("kept")))
    return read(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"])


MANIFEST = "SELECT sha256(concat_ws('|', concat(source, '/', doc_id), n_chars::VARCHAR, doc_id::VARCHAR)) AS line FROM documents"


@query(
    f"""WITH p AS (SELECT substr(line, 1, 3) AS head, sha256(string_agg(line, '|' ORDER BY line)) AS part FROM ({MANIFEST}) GROUP BY substr(line, 1, 3))
    SELECT sha256(concat_ws('|', string_agg(part, '|' ORDER BY head), '[(''size'', 750)]')) AS fingerprint FROM p"""
)
def corpus_fingerprint(spark, d):
    manifest = read(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))
    return spark.createDataFrame([(chunking.fingerprint(manifest, {"size": 750}),)], "fingerprint string")


@query(f"SELECT doc_id, chunk_index, char_start, char_end FROM ({CHUNKS})")
def cached_chunks(spark, d):
    docs, cache = read(spark, d, "documents"), shared_folder(spark)
    manifest = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(0).alias("mtime"))
    chunking.refresh(manifest, chunking.chunk(docs), cache, {})
    # What is written is read, whatever is given as the chunks now.
    return chunking.refresh(manifest, chunking.chunk(docs).filter("false"), cache, {}).select("doc_id", "chunk_index", "char_start", "char_end")


@query("SELECT item_id, CASE WHEN item_id % 4 = 0 THEN '' ELSE concat('[t', item_id, '](No link) s', chr(10), '[No title](u) No snippet provided.') END AS rendered FROM benchmark")
def web_results(spark, d):
    def call(text: str, n: int) -> list[dict]:
        if int(text) % 4 == 0:
            raise OSError("no network")
        return [{"title": f"t{text}", "snippet": "s"}, {"link": "u", "title": None}, {"title": "third"}]

    asked = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query"))
    return adapters.web_search(asked, call, num_results=2).select(F.col("query").cast("long").alias("item_id"), "rendered")


@query("SELECT item_id, 16 AS dims, 1.0::DOUBLE AS norm FROM benchmark")
def hashed_embeddings(spark, d):
    rows = adapters.embed(read(spark, d, "benchmark").select("item_id", F.concat("text", F.lit(" word")).alias("text")), adapters.hashing_embedder(16))
    return rows.select("item_id", F.size("v").alias("dims"), F.round(F.sqrt(retrieval.dot(F.col("v"), F.col("v"))), 4).alias("norm"))


@query(
    """WITH t AS (SELECT doc_id % 30 AS slot, doc_id AS id, row_number() OVER (PARTITION BY doc_id % 30 ORDER BY doc_id) AS rank FROM documents)
    SELECT slot, id FROM t WHERE slot % 3 = 0 AND rank <= 6 UNION ALL SELECT slot, id FROM (SELECT slot, id, row_number() OVER (PARTITION BY slot ORDER BY rank DESC) AS n FROM t WHERE slot % 3 <> 0) WHERE n <= 6"""
)
def snippet_priority(spark, d):
    rows = read(spark, d, "documents").select((F.col("doc_id") % 30).alias("slot"), F.col("doc_id").alias("id")).withColumn("rank", F.row_number().over(W.partitionBy("slot").orderBy("id")))
    return sampling.snippets([rows.filter("slot % 3 = 0"), rows.withColumn("rank", -F.col("rank"))]).select("slot", "id")


def _poisson(mean: float, high: int) -> str:
    p = total = math.exp(-mean)
    out = f"WHEN u <= {total!r}::DOUBLE THEN 0"
    for k in range(1, high + 1):
        p *= mean / k
        total += p
        out += f" WHEN u <= {total!r}::DOUBLE THEN {k}"
    return f"CASE {out} ELSE {high} END"


@query(
    f"""SELECT conv_id, least(8, greatest(1, {_poisson(4.5, 8)}))::INT AS poisson, least(9, greatest(2, round_even(-ln(1 - u) * 3.0, 0)))::INT AS exponential FROM (SELECT conv_id, {u_sql('9', 'conv_id')} AS u FROM (SELECT DISTINCT conv_id FROM conversations))"""
)
def drawn_turn_counts(spark, d):
    u = T.uniform(F.col("conv_id"), seed=9)
    ids = read(spark, d, "conversations").select("conv_id").distinct()
    return ids.select("conv_id", sampling.turn_count(u, 1, 8).alias("poisson"), sampling.turn_count(u, 2, 9, distribution="exp", mean=3.0).alias("exponential"))


TRACES = [
    '{"thinking": "@", "premises": [{"id": 1, "text": "p@", "evidence_refs": ["r1", "", null], "note": true}], "x": 1}',
    '{"thinking": [{"text": null}, "b@", null, 3], "premises": ["s@", null]}',
    '{"thinking": {"text": "t@"}, "premises": {"id": 2}}',
    '{"evidence": [{"id": "e", "cue": null, "content": "c@"}, "free", 5], "premises": [{"text_note": "last", "evidence_refs": "one"}]}',
    '["no object"]',
]


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN concat('|b', event_id, '||3') WHEN 2 THEN concat('t', event_id) END AS thinking,
    CASE event_id % 5 WHEN 0 THEN concat('1/p', event_id, '/r1/true') WHEN 1 THEN concat('/s', event_id, '//;///') WHEN 3 THEN '//one/last' END AS premises,
    CASE event_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'evidence' END AS rest FROM events"""
)
def written_traces(spark, d):
    rows = read(spark, d, "events").select("event_id", records.written_trace(F.parse_json(_raw(TRACES, "event_id"))).alias("t"))
    line = lambda p: F.concat_ws("/", p["id"], p["text"], F.array_join(p["evidence_refs"], "+"), p["assumption"])
    return rows.select("event_id", F.array_join(F.transform("t.thinking", lambda x: x["text"]), "|").alias("thinking"), F.array_join(F.transform("t.premises", line), ";").alias("premises"), F.array_join(F.map_keys("t.rest"), ",").alias("rest"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 3 THEN concat('e//c', event_id, ';//free;//5') WHEN 4 THEN NULL ELSE '' END AS evidence,
    CASE event_id % 5 WHEN 0 THEN concat('1/p', event_id, '/r1/true') WHEN 1 THEN concat('/s', event_id, '//;///') WHEN 2 THEN '2///' WHEN 3 THEN '//one/last' END AS premises FROM events"""
)
def trace_parts(spark, d):
    rows = read(spark, d, "events").select("event_id", canonical.trace(F.parse_json(_raw(TRACES, "event_id"))).alias("t"))
    line = lambda *names: lambda p: F.concat_ws("/", *[F.array_join(p[n], "+") if n == "evidence_refs" else p[n] for n in names])
    return rows.select("event_id", F.array_join(F.transform("t.evidence", line("id", "cue", "content")), ";").alias("evidence"), F.array_join(F.transform("t.premises", line("id", "text", "evidence_refs", "assumption")), ";").alias("premises"))


LINES = ['{"id": @, "assistant_reasoning": [{"turn_index": 1, "more": "m", "reasoning_trace": {"question": "q@", "thinking": ["a"], "extra": 7}}, {"turn_index": 2}]}', "not json @", '{"id": @, "assistant_reasoning": "none"}', '[1, @]']


@query(
    """SELECT event_id, event_id % 4 <> 0 AS unchanged, CASE WHEN event_id % 4 = 0 THEN event_id END AS id, CASE WHEN event_id % 4 = 0 THEN concat('q', event_id) END AS question, CASE WHEN event_id % 4 = 0 THEN 'a' END AS thought, CASE WHEN event_id % 4 = 0 THEN 7 END AS extra,
    CASE WHEN event_id % 4 = 0 THEN 'm' END AS more, CASE WHEN event_id % 4 = 0 THEN '' END AS confidence, CASE WHEN event_id % 4 = 0 THEN 2 END AS second FROM events"""
)
def sanitized_json_lines(spark, d):
    raw = _raw(LINES, "event_id")
    rows = canonical.sanitized_lines(read(spark, d, "events").select("event_id", raw.alias("value"), raw.alias("raw")))
    parsed = rows.withColumn("v", F.when(F.col("value") != F.col("raw"), T.strict_variant(F.col("value"))))
    get, turn = lambda p, kind: canonical.get(F.col("v"), p, kind), "$.assistant_reasoning[0]"
    return parsed.select(
        "event_id", (F.col("value") == F.col("raw")).alias("unchanged"), get("$.id", "long").alias("id"), get(f"{turn}.reasoning_trace.question", "string").alias("question"), get(f"{turn}.reasoning_trace.thinking[0].text", "string").alias("thought"),
        get(f"{turn}.reasoning_trace.extra", "int").alias("extra"), get(f"{turn}.more", "string").alias("more"), get(f"{turn}.reasoning_trace.confidence", "string").alias("confidence"), get("$.assistant_reasoning[1].turn_index", "int").alias("second"),
    )
