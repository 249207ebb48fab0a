"""Queries over the test tables that run stages, streams, sinks and sources, and the rules that settings follow."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions.tables import shared_folder, written
from parlance.operators import conversations, records, seeds, stats
from parlance.plans import config, dataset, export, state
from parlance.plans.catalog import HISTORY, PAIRED, paired_turns, query, read
from parlance.plans.catalog_records import WIDE, done
from parlance.sources import adapters, calls, files, stages
from parlance.streaming import questions


def table_of(rows: list[tuple], columns: str) -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame(rows, columns)


def values_sql(rows: list[tuple], *names: str) -> str:
    literal = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({', '.join(names)})"


def outcome(call) -> str:
    """What a call gives, as text; of an error its kind."""
    try:
        return str(call())
    except Exception as error:
        return type(error).__name__


# Streams: extensions on Structured Streaming.


def _source(spark, d):
    """The events as a stream of files."""
    events, folder = read(spark, d, "events"), shared_folder(spark)
    events.write.parquet(folder)
    return spark.readStream.schema(events.schema).parquet(folder)


def _stream(spark, d, start):
    """The rows that a stream over the events ends with."""
    source = _source(spark, d)
    name = f"s{uuid.uuid4().hex}"
    writer, mode = start(source.withColumn("ts", F.col("ts").cast("timestamp")))
    writer.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS count FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    rows = _stream(spark, d, lambda s: (questions.window_counts(s, "event_type"), "complete"))
    return rows.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("day"), "count")


@query("SELECT DISTINCT lower(event_type) AS normalized FROM events")
def stream_first_questions(spark, d):
    rows = _stream(spark, d, lambda s: (questions.first_questions(s.withColumn("question", F.col("event_type")), delay="400 days"), "append"))
    return rows.select("normalized")


@query("SELECT event_id FROM events WHERE user_id % 3 <> 0")
def stream_ledger(spark, d):
    folder = shared_folder(spark)
    asked = _source(spark, d).select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("event_type")).alias("question"))
    questions.append_ledger(asked, f"{folder}/ledger", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/ledger").select("event_id")


# Model stages, with models that answer by rule.


def _model():
    """Says what the last words of the request call for: tools first, broken JSON, refusals of JSON mode."""

    def call(request: dict) -> dict:
        said = request["messages"]
        n = int(said[0]["content"])
        rounds = sum(m["role"] == "tool" for m in said)
        if n % 7 == 0 and request["response_format"] == "json_object":
            raise ValueError("response_format json_object is not supported")
        if n % 3 == 1 and rounds == 0:
            return {"content": None, "tool_calls": [{"id": f"k{n}", "function": {"name": "web_search" if n % 2 else "vector_db_search", "arguments": {"query": n}}}, {"function": {"name": "unknown"}}]}
        if n % 5 == 0:
            return {"content": "never json"}
        if n % 3 == 2 and said[-1]["content"] != stages.REPAIR:
            return {"content": "no json yet"}
        return {"content": [{"text": "```json\n"}, json.dumps({"assistant_message": f"a{n}", "score": n % 11, "reasons": ["r"], "question_ok": True}), {"text": "\n```"}]}

    return call


TOOLS = {"web_search": lambda a: {"found": a["query"]}, "vector_db_search": lambda a: {}["missing"]}


@query(
    """SELECT item_id, CASE WHEN item_id % 5 = 0 THEN '' ELSE concat('a', item_id) END AS assistant_message, item_id % 3 = 1 AND item_id % 2 = 1 AND item_id % 5 <> 0 AS did_web_search,
    CASE WHEN item_id % 3 = 1 THEN concat('k', item_id, CASE WHEN item_id % 2 = 1 THEN concat('=web_search:{"found": ', item_id, '}') ELSE '=vector_db_search:{"error": "''missing''"}' END, '|=unknown:{"error": "Unknown tool: unknown"}') ELSE '' END AS events,
    CASE WHEN item_id % 5 = 0 THEN 8 WHEN item_id % 3 = 0 THEN 1 ELSE 2 END AS rounds FROM benchmark"""
)
def assistant_stage(spark, d):
    rows = stages.assistant_turns(read(spark, d, "benchmark").select("item_id"), _model, lambda r: [{"role": "user", "content": str(r["item_id"])}], TOOLS)
    line = lambda e: F.concat(e["id"], F.lit("="), e["name"], F.lit(":"), e["result"])
    return rows.select("item_id", "assistant_message", "did_web_search", F.array_join(F.transform("tool_events", line), "|").alias("events"), "rounds")


@query(
    f"""SELECT item_id, CASE WHEN item_id % 5 = 0 OR item_id % 3 <> 0 THEN 0.0 ELSE item_id % 11 END::DOUBLE AS score, CASE WHEN item_id % 5 = 0 OR item_id % 3 <> 0 THEN 'other' ELSE 'r' END AS reasons,
    CASE WHEN item_id % 5 = 0 OR item_id % 3 <> 0 THEN '{stages.UNPARSED}' END AS notes, item_id % 5 <> 0 AND item_id % 3 = 0 AS question_ok FROM benchmark"""
)
def judge_stage(spark, d):
    rows = stages.judged(read(spark, d, "benchmark").select("item_id"), _model, lambda r: [{"role": "user", "content": str(r["item_id"])}])
    return rows.select("item_id", "judge.score", F.array_join("judge.reasons", ",").alias("reasons"), "judge.notes", "judge.question_ok")


@query("SELECT item_id, 0.0::DOUBLE AS score, 'other' AS reasons, 'disabled' AS notes FROM benchmark")
def judge_stage_off(spark, d):
    rows = stages.judged(read(spark, d, "benchmark").select("item_id"), _model, lambda r: [], enabled=False)
    return rows.select("item_id", "judge.score", F.array_join("judge.reasons", ",").alias("reasons"), "judge.notes")


@query("SELECT item_id, CASE WHEN item_id % 4 <> 3 THEN concat('{\"q\": ', item_id, '}') END AS reply, CASE WHEN item_id % 4 = 0 THEN 1 ELSE 2 END AS attempts FROM benchmark")
def user_stage(spark, d):
    def call(row: dict) -> str:
        n = int(row["item_id"])
        return f'{{"q": {n}}}' if n % 4 == 0 or row["repair"] and n % 4 != 3 else "broken"

    return adapters.complete(read(spark, d, "benchmark").select("item_id"), call, lambda x: stages.parse_object(x) or None)


def _shapes(item_id: int, text: str) -> tuple[object, object]:
    """A message's content and its calls in one of the shapes that services use."""
    contents = [
        None, text, [{"text": text}, "b", {"image": 1}, {"content": "c"}, None], {"text": None, "content": text}, {"z": item_id}, [{"text": item_id}, {"content": 5}], item_id, {"text": item_id}, True,
    ]
    named = {"id": item_id, "function": {"name": "f", "arguments": {"q": text[:5]}}}
    calls = [None, named, [named, {"function": {"name": "g"}}], [{"id": "x", "function": {"arguments": None}}, {"id": None}], {"function": {"name": None, "arguments": "[1]"}}]
    return contents[item_id % len(contents)], calls[item_id % len(calls)]


@query(
    """SELECT item_id, CASE item_id % 9 WHEN 1 THEN text WHEN 2 THEN concat(text, 'bc') WHEN 3 THEN text WHEN 4 THEN concat('{"z": ', item_id, '}') WHEN 5 THEN item_id::VARCHAR WHEN 6 THEN item_id::VARCHAR WHEN 7 THEN item_id::VARCHAR WHEN 8 THEN 'true' ELSE '' END AS content,
    CASE item_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat(item_id, ':f:{"q": "', left(text, 5), '"}') WHEN 2 THEN concat(item_id, ':f:{"q": "', left(text, 5), '"}|:g:{}') WHEN 3 THEN 'x::{}|::{}' ELSE '::[1]' END AS calls FROM benchmark"""
)
def answer_shapes(spark, d):
    def told(batches):
        for batch in batches:
            shapes = [_shapes(int(k), t) for k, t in zip(batch["item_id"], batch["text"])]
            called = ["|".join(f"{c['id']}:{c['name']}:{c['arguments']}" for c in stages.tool_calls(x)) for _, x in shapes]
            yield pd.DataFrame({"item_id": batch["item_id"], "content": [stages.content_text(x) for x, _ in shapes], "calls": called})

    return read(spark, d, "benchmark").select("item_id", "text").mapInPandas(told, "item_id long, content string, calls string")


@query("SELECT item_id, concat(length(text), ' ', item_id % 3) AS answer, 1 AS attempts, TRUE AS asked_once FROM benchmark")
def answered_requests(spark, d):
    """Answers are asked for, and asked for again with a service that would answer otherwise."""
    folder = f"{shared_folder(spark)}/answers"
    rows = read(spark, d, "benchmark").select("item_id", "text")
    request = lambda r: {"text": r["text"], "kind": int(r["item_id"]) % 3}
    ask = lambda said: calls.answered(rows, lambda: lambda q: f"{len(q['text']) if said else 'none'} {q['kind']}", request, folder)
    first, again = written(ask(True), "first"), ask(False).select("item_id", F.col("reply").alias("kept"))
    return first.join(again, "item_id").select("item_id", F.regexp_replace("reply", '"', "").alias("answer"), "attempts", (F.col("kept") == F.col("reply")).alias("asked_once"))


@query(
    f"""SELECT conv_id AS slot, CASE WHEN conv_id % 3 = 0 AND conv_id % 4 <> 0 THEN 'seeded' ELSE 'fresh' END AS question_mode, coalesce(nullif(last, ''), 'No prior assistant answer.') AS last_assistant_message, CASE WHEN conv_id % 2 = 0 THEN 's1,s2' ELSE '' END AS topic_snippets,
    array_to_string(list_slice(q, greatest(1, len(q) - 9), len(q)), ',') AS recent, CASE WHEN conv_id % 3 = 0 AND conv_id % 4 <> 0 THEN concat('seed ', conv_id) ELSE '' END AS seed_question
    FROM (SELECT conv_id, arg_max(assistant, turn_index) AS last, list_concat(['l1', 'l2'], list('t' || turn_index ORDER BY turn_index)) AS q FROM ({PAIRED}) GROUP BY conv_id)"""
)
def question_input_records(spark, d):
    turns = paired_turns(spark, d)
    own = F.transform(F.array_sort(F.collect_list("turn_index")), lambda t: F.concat(F.lit("t"), t.cast("string")))
    slots = turns.groupBy(F.col("conv_id").alias("slot")).agg(F.max_by("assistant", F.when(F.col("assistant").isNotNull(), F.col("turn_index"))).alias("last_assistant"), own.alias("own_questions"))
    slots = slots.select("slot", F.lit("fresh").alias("mode"), (F.col("slot") % 4 == 0).alias("forced"), "last_assistant", "own_questions")
    even = slots.filter("slot % 2 = 0").select("slot")
    found = even.select("slot", F.lit(2).alias("rank"), F.lit("s2").alias("text")).unionByName(even.select("slot", F.lit(1).alias("rank"), F.lit("s1").alias("text")))
    seeded = slots.filter("slot % 3 = 0").select("slot", F.lit("t").alias("topic"), F.concat(F.lit("seed "), "slot").alias("question"))
    rows = records.question_inputs(slots, found, seeded, ["l1", "l2"])
    return rows.select("slot", "question_mode", "last_assistant_message", F.array_join("topic_snippets", ",").alias("topic_snippets"), F.array_join("recent_user_questions", ",").alias("recent"), "seed_question")


TURN_SOURCES = """SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN (conv_id % 9)::VARCHAR WHEN 1 THEN '2.7' WHEN 2 THEN 'odd' END AS said, CASE WHEN conv_id % 3 = 0 THEN 5 ELSE 0 END AS judged, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY conv_id"""


@query(f"SELECT conv_id, coalesce(trunc(try_cast(said AS DOUBLE))::BIGINT, nullif(judged, 0), nullif(asked, 0))::BIGINT AS n_turns FROM ({TURN_SOURCES})")
def turn_count_sources(spark, d):
    said = F.expr("CASE conv_id % 4 WHEN 0 THEN cast(conv_id % 9 AS string) WHEN 1 THEN '2.7' WHEN 2 THEN 'odd' END")
    rows = read(spark, d, "conversations")
    return stats.turn_counts(rows, rows.select("conv_id").distinct().select("conv_id", said.alias("n_turns"), F.when(F.col("conv_id") % 3 == 0, 5).otherwise(0).alias("judged_turns")))


# Sinks, read again.


@query(
    f"""WITH c AS (SELECT conv_id, count(*) AS n, bool_or(turn_index % 4 <> 0 AND notes <> 'disabled') AS verdict FROM ({WIDE}) GROUP BY conv_id)
    SELECT 'synthetic_qa' AS "table", 2 * count(*) AS n_rows FROM c UNION ALL SELECT 'conversations', 2 * count(*) FROM c UNION ALL SELECT 'conversations_index', 2 * count(*) FROM c UNION ALL SELECT 'conversations_sft', 2 * count(*) FROM c
    UNION ALL SELECT 'conversations_sft_judged', 2 * count(*) FILTER (conv_id % 3 = 0 OR conv_id % 5 = 0 OR verdict) FROM c UNION ALL SELECT 'turns', 2 * sum(n)::BIGINT FROM c"""
)
def dataset_tables(spark, d):
    folder = shared_folder(spark)
    for _ in range(2):
        dataset.write_conversations(done(spark, d), folder, columns={"messages": "chat"})
    out = None
    for name in dataset.TABLES:
        rows = spark.read.json(f"{folder}/{name}")
        rows = rows.filter("chat is not null") if "sft" in name else rows
        n = rows.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    return out


@query(f"SELECT concat('c', conv_id) AS conversation_id, CASE WHEN conv_id % 2 = 0 THEN 9 ELSE count(*) END::BIGINT AS n_turns, concat('q', conv_id) AS seed_question, 'en' AS language FROM ({PAIRED}) GROUP BY conv_id")
def conversation_index(spark, d):
    folder = shared_folder(spark)
    dataset.write_conversations(done(spark, d), folder)
    return spark.read.json(f"{folder}/conversations_index").select("conversation_id", "n_turns", "seed_question", "language")


def _appended(spark, d, table):
    """A table that finished conversations were written to, read again from its files."""
    folder = shared_folder(spark)
    dataset.write_conversations(done(spark, d), folder, columns={"messages": "chat"})
    return spark.read.json(f"{folder}/{table}")


def _said(messages):
    """A digest of the roles and texts of messages in their order."""
    return F.md5(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n"))


SAID = f"""SELECT conv_id, md5(string_agg(role || ':' || message, chr(10) ORDER BY turn_index, pos)) AS said, count(*) AS n_messages FROM ({HISTORY}) GROUP BY conv_id"""


@query(
    f"""SELECT concat('c', conv_id) AS conversation_id, said, n_messages::INT AS n_messages, said AS said_in_turns, questions FROM ({SAID})
    JOIN (SELECT conv_id, string_agg("user", chr(10) ORDER BY turn_index) AS questions FROM ({PAIRED}) GROUP BY conv_id) USING (conv_id)"""
)
def written_artifacts(spark, d):
    """Of each artifact its messages, and the same made again from its turns."""
    rows = _appended(spark, d, "conversations")
    again = F.filter(
        F.flatten(F.transform("turns", lambda t: F.array(F.struct(F.lit("user").alias("role"), t["user"].alias("content")), F.struct(F.lit("assistant").alias("role"), t["assistant"].alias("content"))))),
        lambda m: m["content"] != "",
    )
    asked = F.array_join(F.transform("user_reasoning", lambda t: t["user"]), "\n")
    return rows.select("conversation_id", _said("messages").alias("said"), F.size("messages").alias("n_messages"), _said(again).alias("said_in_turns"), asked.alias("questions"))


@query(
    f"""SELECT concat('c', conv_id) AS conversation_id, concat('q', conv_id) AS question, last("user" ORDER BY turn_index) AS last_question, last(assistant ORDER BY turn_index) AS final_answer
    FROM ({PAIRED}) GROUP BY conv_id"""
)
def written_answers(spark, d):
    return _appended(spark, d, "synthetic_qa").select("conversation_id", "question", "last_question", "final_answer")


@query(
    f"""SELECT concat('c', conv_id) AS conversation_id, turn_index::BIGINT AS turn_index, said AS user_message, answer AS assistant_message, CASE WHEN turn_index % 4 <> 0 THEN score::DOUBLE END AS judge_score,
    CASE WHEN turn_index % 4 <> 0 THEN notes END AS judge_notes FROM ({WIDE})"""
)
def written_turns(spark, d):
    return _appended(spark, d, "turns").select("conversation_id", "turn_index", "user_message", "assistant_message", F.col("judge_score").cast("double").alias("judge_score"), "judge_notes")


@query(
    f"""SELECT said, judged, avg_score FROM ({SAID}) JOIN (
      SELECT conv_id, count(*) FILTER (turn_index % 4 <> 0)::INT AS judged, round(avg(score) FILTER (turn_index % 4 <> 0), 6) AS avg_score,
        coalesce(bool_or(turn_index % 4 <> 0 AND notes <> 'disabled'), FALSE) AS verdict FROM ({WIDE}) GROUP BY conv_id) USING (conv_id)
    WHERE conv_id % 3 = 0 OR conv_id % 5 = 0 OR verdict"""
)
def written_judged_chats(spark, d):
    """Chat records carry no id: their messages tell them apart."""
    rows = _appended(spark, d, "conversations_sft_judged")
    return rows.select(_said("chat").alias("said"), F.size("judge.per_turn").alias("judged"), F.round("judge.avg_score", 6).alias("avg_score"))


@query("SELECT doc_id, source FROM documents WHERE doc_id % 2 = 1")
def replaced_table(spark, d):
    path = f"{shared_folder(spark)}/rows"
    for rest in (0, 1):
        dataset.replace_table(read(spark, d, "documents").filter(f"doc_id % 2 = {rest}").select("doc_id", "source"), path)
    return spark.read.parquet(path)


@query("SELECT doc_id, 'completed' AS run_status, TRUE AS same FROM documents UNION ALL SELECT NULL, 'none', TRUE")
def run_state_tables(spark, d):
    folder, slots = shared_folder(spark), read(spark, d, "documents").select("doc_id")
    dataset.save_run_state(slots.limit(3), folder, "r1", "started")
    dataset.save_run_state(slots, folder, "r1", "completed")
    same = dataset.load_run_state(spark, folder).count() == dataset.load_run_state(spark, folder, "r1").count()
    none = dataset.load_run_state(spark, folder, "r2") is None
    return dataset.load_run_state(spark, folder).withColumn("same", F.lit(same)).unionByName(table_of([(None, "none", none)], "doc_id long, run_status string, same boolean"))


@query("SELECT n_name AS topic, 0 AS pos, concat('what of ', n_name) AS question, 'refused' AS again FROM nation")
def written_seeds(spark, d):
    path = f"{shared_folder(spark)}/seeds"
    table = read(spark, d, "nation").select(F.col("n_name").alias("topic"), F.lit(0).alias("pos"), F.concat(F.lit("what of "), "n_name").alias("question"))
    dataset.write_seeds(table, path)
    again = outcome(lambda: dataset.write_seeds(table, path))
    return spark.read.parquet(path).withColumn("again", F.lit("refused" if again == "AnalysisException" else again))


@query(
    """SELECT item_id, concat('q', item_id) AS question FROM benchmark"""
)
def export_bundle_rows(spark, d):
    folder = shared_folder(spark)
    line = F.format_string('{"item_id": %d, "assistant_reasoning": [{"reasoning_trace": {"question": "q%d"}}]}', "item_id", "item_id")
    report = table_of([("records", "", 2.0), ("turn_count_distribution", "5", 1.0), ("turn_count_distribution", "6", 1.0), ("languages", "en", 2.0)], "metric string, bucket string, value double")
    names = export.write_bundle(read(spark, d, "benchmark").select(line.alias("value")), report, folder, repo_id="me/set")
    if names != ["dataset_stats.json", "README.md", "plots/turn_count_distribution.svg"]:
        raise ValueError(f"unexpected files: {names}")
    rows = spark.read.parquet(f"{folder}/train")
    return rows.select(F.get_json_object("value", "$.item_id").cast("long").alias("item_id"), F.col("assistant_reasoning")[0]["reasoning_trace"]["question"].alias("question"))


# Sources, over files written for the purpose.


@query("SELECT '.txt' AS suffix, sum(length(trim(text)) + 1)::BIGINT - 1 AS n_chars, 1 AS n_files FROM (SELECT regexp_replace(text, '\\s+', ' ', 'g') AS text FROM benchmark)")
def knowledge_folder(spark, d):
    folder = shared_folder(spark)
    read(spark, d, "benchmark").select(T.collapse(F.col("text")).alias("value")).coalesce(1).write.text(folder)
    rows = files.knowledge_files(spark, folder)
    return rows.groupBy("suffix").agg(F.sum(F.length("text")).alias("n_chars"), F.count("*").cast("int").alias("n_files"))


@query("SELECT count(*) FILTER (item_id % 4 = 0) AS objects, sum(CASE WHEN item_id % 4 = 0 THEN item_id END)::BIGINT AS ids, count(*) AS lines FROM benchmark")
def json_line_files(spark, d):
    path = shared_folder(spark)
    line = F.expr("CASE item_id % 4 WHEN 0 THEN concat('{\"id\": ', item_id, '}') WHEN 1 THEN '' WHEN 2 THEN '[1]' ELSE '{broken' END")
    read(spark, d, "benchmark").select(line.alias("value")).write.text(path)
    rows = files.json_lines(spark, path).agg(F.count("*").alias("objects"), F.sum(F.try_variant_get("row", "$.id", "long")).alias("ids"))
    return rows.withColumn("lines", F.lit(files.line_count(spark, path)).cast("long"))


@query("SELECT item_id AS id FROM benchmark WHERE item_id % 3 = 0")
def json_document_files(spark, d):
    path = shared_folder(spark)
    rows = read(spark, d, "benchmark")
    text = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit('{\n "id": '), "item_id", F.lit("\n}"))).otherwise("[no object]")
    n = rows.count()
    rows.select(text.alias("value"), "item_id").repartitionByRange(n, "item_id").select("value").write.text(path)
    return files.json_documents(spark, path).select(F.try_variant_get("row", "$.id", "long").alias("id"))


# Seeds and settings in files, a file for each region or customer.

#: The layouts of seed files, by region: a topic for each nation, with its questions in one or two variants.
SEED_JSON = """CASE r_regionkey % 5
  WHEN 0 THEN concat('{"variants": {"English": {', one, '}, "msa": {', two, '}}}')
  WHEN 1 THEN concat('{', nested, '}')
  WHEN 2 THEN concat('{', one, '}')
  WHEN 3 THEN concat('{"version": 1, "topics": {" ENGLISH ": {', one, '}}, "defaults": {"by_target_language": {"AR": "English"}}}')
  ELSE concat('{"english": {', one, '}, "gulf": {', two, '}}') END"""
SEED_ROWS = """SELECT r_regionkey, n_name AS topic, unnest(CASE r_regionkey % 5
    WHEN 0 THEN [{'variant': 'english', 'mark': ''}, {'variant': 'msa', 'mark': ' msa'}] WHEN 1 THEN [{'variant': 'msa', 'mark': ' msa'}, {'variant': 'english', 'mark': ''}]
    WHEN 4 THEN [{'variant': 'english', 'mark': ''}, {'variant': 'gulf', 'mark': ' msa'}] ELSE [{'variant': 'english', 'mark': ''}] END) AS v
  FROM nation JOIN region ON n_regionkey = r_regionkey"""
SEED_TABLE = f"SELECT r_regionkey::VARCHAR AS path, v.variant AS variant, topic, pos::INT AS pos, concat(CASE pos WHEN 0 THEN 'what of ' ELSE 'where is ' END, topic, v.mark) AS question FROM ({SEED_ROWS}), (VALUES (0), (2)) p(pos)"


def _seed_files(spark, d):
    questions = lambda mark: F.format_string(f'["  what of %s{mark} ", "", "where is %s{mark}", 3]', "n_name", "n_name")
    entry = lambda value: F.concat(F.lit('"'), "n_name", F.lit('": '), value)
    both = F.concat(F.lit('{"msa": '), questions(" msa"), F.lit(', "english": '), questions(""), F.lit("}"))
    joined = lambda x: F.array_join(F.array_sort(F.collect_list(x)), ", ")
    rows = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    files_ = rows.groupBy("r_regionkey").agg(joined(entry(questions(""))).alias("one"), joined(entry(questions(" msa"))).alias("two"), joined(entry(both)).alias("nested"))
    return files_.select(F.col("r_regionkey").cast("string").alias("path"), F.expr(SEED_JSON).alias("text"))


@query(SEED_TABLE)
def seed_layouts(spark, d):
    return seeds.seed_files(_seed_files(spark, d)).select("path", "variant", "topic", "pos", "question")


@query(f"SELECT path, count(DISTINCT variant) AS variants, count(DISTINCT topic) AS topics, count(*) AS questions FROM ({SEED_TABLE}) GROUP BY path")
def seed_summaries(spark, d):
    return seeds.summary(seeds.seed_files(_seed_files(spark, d)), "path")


@query(
    f"""SELECT path, topic, pos, question FROM (SELECT *, min(CASE variant WHEN 'msa' THEN 0 WHEN 'english' THEN 1 ELSE 2 END) OVER (PARTITION BY path, topic) AS best FROM ({SEED_TABLE}))
    WHERE best = CASE variant WHEN 'msa' THEN 0 WHEN 'english' THEN 1 ELSE 2 END"""
)
def seed_fallbacks(spark, d):
    rows = seeds.for_variant(seeds.seed_files(_seed_files(spark, d)), " MSA ", keys=("path",))
    return rows.select("path", "topic", "pos", "question")


@query("SELECT r_regionkey::VARCHAR AS path, CASE r_regionkey % 5 WHEN 0 THEN 'msa' WHEN 4 THEN 'english' WHEN 1 THEN 'msa' ELSE 'english' END AS ar, CASE WHEN r_regionkey % 5 = 4 THEN 'gulf' WHEN r_regionkey % 5 IN (0, 1) THEN 'english' ELSE 'english' END AS gulf FROM region")
def seed_variants(spark, d):
    """The variant of each file for a language, and for a wish that not all have."""

    def found(batches):
        for batch in batches:
            held = [json.loads(t) for t in batch["text"]]
            yield pd.DataFrame({"path": batch["path"], "ar": [seeds.chosen_variant(x, language=" AR ") for x in held], "gulf": [seeds.chosen_variant(x, explicit="GULF") for x in held]})

    return _seed_files(spark, d).mapInPandas(found, "path string, ar string, gulf string")


def _settings(key: int, segment: str) -> dict:
    """A customer's settings: some exact, some a range, some wrong."""
    n = key % 7
    turns = [{"exact": key % 5 + 1}, {"mode": "range", "min": n, "max": n + 3}, {"exact": 2, "min": 1}, {"min": 5, "max": 2}][key % 4]
    return {"run": {"turns": turns, "languages": f" {segment}, en,{segment},"}, "judge": {"mode": "offline" if key % 3 == 0 else "online"}}


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 IN (2, 3) OR (c_custkey % 4 = 1 AND c_custkey % 7 = 0) THEN 'ValueError' ELSE 'ok' END AS outcome,
    CASE c_custkey % 4 WHEN 0 THEN c_custkey % 5 + 1 WHEN 1 THEN nullif(c_custkey % 7, 0) END::INT AS least, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 5 + 1 WHEN c_custkey % 4 = 1 AND c_custkey % 7 > 0 THEN c_custkey % 7 + 3 END::INT AS most,
    CASE WHEN c_custkey % 4 = 0 OR (c_custkey % 4 = 1 AND c_custkey % 7 > 0) THEN concat(c_mktsegment, ',en') END AS languages, CASE WHEN c_custkey % 4 = 0 OR (c_custkey % 4 = 1 AND c_custkey % 7 > 0) THEN c_custkey % 3 <> 0 END AS judged FROM customer"""
)
def driver_rules(spark, d):
    """Settings of each customer, checked and brought into form where the row is."""

    def checked(batches):
        for batch in batches:
            rows = []
            for key, segment in zip(batch["c_custkey"], batch["c_mktsegment"]):
                try:
                    held = config.run_settings(_settings(int(key), segment))
                    rows.append((key, "ok", held.turns.least, held.turns.most, ",".join(held.languages), held.judged))
                except ValueError:
                    rows.append((key, "ValueError", None, None, None, None))
            yield pd.DataFrame(rows, columns=["c_custkey", "outcome", "least", "most", "languages", "judged"]).astype({"least": "Int32", "most": "Int32", "judged": "boolean"})

    return read(spark, d, "customer").select("c_custkey", "c_mktsegment").mapInPandas(checked, "c_custkey long, outcome string, least int, most int, languages string, judged boolean")


@query("SELECT concat('p', n_nationkey) AS id, n_name AS name, concat('from ', n_regionkey, ',', lower(n_name)) AS traits, CASE WHEN n_nationkey % 2 = 0 THEN 'calm' ELSE '' END AS style FROM nation UNION ALL SELECT 'f', 'fallback', '', ''")
def persona_sources(spark, d):
    """Personas of settings that name one for each nation, and the fallback of settings without any."""
    rows = read(spark, d, "nation").collect()
    named = [{"id": f"p{r.n_nationkey}", "name": r.n_name, "traits": [f"from {r.n_regionkey}", r.n_name.lower()], "style": "" if r.n_nationkey % 2 else "calm"} for r in rows]
    given = files.persona_table(spark, {"personas": {"user": named}}, "user", [])
    both = given.unionByName(files.persona_table(spark, {}, "user", [{"id": "f", "name": "fallback"}]))
    return both.withColumn("traits", F.array_join("traits", ","))


@query("SELECT c_custkey::INT AS conversation_index, CASE WHEN c_custkey % 10 < 5 THEN 'completed' ELSE 'dropped' END AS status, CASE WHEN c_custkey % 10 < 5 THEN 2 ELSE 0 END AS n_turns FROM customer")
def batch_run(spark, d):
    """Two turns of a batch: a slot's question repeats another's unless its last digit is under five."""
    targets = read(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("conversation_index"), F.lit("2").alias("target_n_turns"))
    slots = state.init_slots(spark, "run", targets)
    own = F.col("conversation_index") % 10 < 5
    ask = lambda s, t, n: s.withColumn("question", F.when(own, F.concat(F.lit(f"t{t} "), "conversation_index")).otherwise("again"))
    seen = table_of([("again",)], "question string")
    after, _ = state.run_batch(slots, seen, ask, lambda asked: asked.withColumn("assistant", F.lit("a")), folder=shared_folder(spark), run_id="run", last_turn=2, retries=1)
    return after.select("conversation_index", "status", "n_turns")
