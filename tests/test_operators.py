import pytest
import random

from pyspark.sql import functions as F

from parlance.operators import chunking, conversations, coverage, dedup, retrieval, sampling, seeds, stats
from parlance.plans import config, export, state
from parlance.sources import adapters, files
from parlance.streaming import questions


@pytest.mark.parametrize("size", [0, 1, 750, 751, 1350, 1351, 5000])
def test_chunks_cover_the_text(spark, size):
    text = "".join(chr(97 + i % 26) for i in range(size))
    rows = chunking.chunk(spark.createDataFrame([("s", text)], "source string, text string")).orderBy("chunk_index").collect()
    want, start = [], 0
    while start < size:
        want.append((start, min(size, start + 750)))
        if start + 750 >= size:
            break
        start += 600
    assert [(r.char_start, r.char_end) for r in rows] == want
    assert [r.text for r in rows] == [text[a:b] for a, b in want]


def test_blank_chunk_is_not_numbered(spark):
    text = "a" * 600 + " " * 750 + "b" * 600
    rows = chunking.chunk(spark.createDataFrame([("s", text)], "source string, text string")).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and all(r.text for r in rows)


def test_first_wins(spark):
    batch = spark.createDataFrame([(0, "What?"), (1, " what? "), (2, ""), (3, None), (4, "Old"), (5, "new")], "conversation_index int, question string")
    seen = spark.createDataFrame([("OLD ",)], "question string")
    got = {r.conversation_index: r.outcome for r in dedup.first_wins(batch, seen).collect()}
    assert got == {0: "accepted", 1: "in_batch", 2: "blank", 3: "blank", 4: "in_run", 5: "accepted"}
    once = dedup.accepted(batch, seen).select("conversation_index", "question")
    assert dedup.accepted(once).count() == once.count()


def test_retries_drop_what_repeats(spark):
    slots = spark.createDataFrame([(0,), (1,)], "conversation_index int")
    ask = lambda s, n: s.withColumn("question", F.when(F.col("conversation_index") == 0, "a").otherwise(F.lit("a" if n < 1 else "b")))
    good, gone = dedup.commit_with_retries(slots, ask, spark.createDataFrame([], "question string"), retries=1)
    assert {(r.conversation_index, r.question, r.attempt) for r in good.collect()} == {(0, "a", 0), (1, "b", 1)} and gone.count() == 0


def test_histogram_as_published(spark):
    for values, want in (([729, 1557], {"729-798": 1, "1499-1557": 1}), ([1064, 2259], {"1064-1163": 1, "2164-2259": 1}), ([7, 7], {"7-7": 2}), ([], {})):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        assert {r.label: r["count"] for r in stats.histogram(df, "v").collect()} == want


def test_score_buckets(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-1.0,), (11.0,), (None,)], "s double")
    assert [r[0] for r in df.select(stats.score_bucket(F.col("s"))).collect()] == [2, 4, 0, 10, None]


def test_turns_and_tools(spark):
    messages = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"), (2, 1, "user", "")], "conv_id long, turn long, role string, text string"
    )
    turns = conversations.paired_turns(messages)
    assert {(r.conv_id, r.turn_index, r.user, r.assistant) for r in turns.collect()} == {(1, 1, "q1", "a1"), (1, 2, "q2", None), (2, 1, "", None)}
    text = {r.conv_id: r.history for r in conversations.render_history(conversations.conversation_history(turns), messages).collect()}
    assert text == {1: "Turn 1 - User: q1\nTurn 1 - Assistant: a1\nTurn 2 - User: q2", 2: "No prior turns."}
    event = "array<struct<id:string,name:string,arguments:string,result:string>>"
    tools = spark.createDataFrame([(1, 1, "q", "a", [("", "f", "{}", "r0"), ("x", "g", "{}", "r1")]), (1, 2, "q2", "", None)], f"conv_id long, turn_index int, user string, assistant string, tool_events {event}")
    rows = conversations.messages_with_tools(tools).orderBy("turn_index", "pos").collect()
    assert [(r.role, r.content, r.tool_call_id) for r in rows] == [("user", "q", None), ("assistant", "", None), ("tool", "r0", "call_0"), ("tool", "r1", "x"), ("assistant", "a", None), ("user", "q2", None)]
    assert [c.id for c in rows[1].calls] == ["call_0", "x"]


def test_personas_are_used_equally(spark):
    personas = spark.createDataFrame([(x,) for x in "abc"], "id string")
    rows = sampling.assign_personas(spark.range(7).withColumnRenamed("id", "slot"), personas).collect()
    first = {r.persona_id for r in rows if r.slot < 3}
    assert first == {"a", "b", "c"} and len(rows) == 7
    assert sampling.assign_personas(spark.range(2).withColumnRenamed("id", "slot"), personas.filter("false")).filter("persona_id is null").count() == 2


def test_seed_questions_are_fresh_and_least_used(spark):
    table = spark.createDataFrame([("t", "q1"), ("t", "q2"), ("u", "q3"), ("u", "q4")], "topic string, question string")
    ledger = spark.createDataFrame([("t", "q1")], "seed_topic string, question string").withColumn("seed_question_hash", dedup.question_hash(F.col("question")))
    rows = sampling.seed_question(table, ledger, spark.range(20).withColumnRenamed("id", "slot")).collect()
    assert len(rows) == 20 and {r.question for r in rows} == {"q3", "q4"}
    assert sampling.seed_question(table, ledger, spark.range(5).withColumnRenamed("id", "slot"), probability=-1.0).count() == 0


def test_turn_counts_stay_in_bounds(spark):
    df = spark.range(500).withColumn("u", F.col("id") / 500)
    for kind in ("uniform", "poisson", "exponential"):
        low, high = df.agg(F.min(c := sampling.turn_count(F.col("u"), 2, 6, distribution=kind)), F.max(c)).first()
        assert low == 2 and high == 6


def test_prefer_and_rerank(spark):
    found = spark.createDataFrame([(1, 1, "a", "x", "q"), (1, 2, "b", "yy", "q"), (2, 1, "c", "z", "q")], "query_id int, rank int, source string, text string, query string")
    preferred = spark.createDataFrame([("b",)], "source string")
    assert {(r.query_id, r.source) for r in retrieval.prefer_sources(found, preferred).collect()} == {(1, "b"), (2, "c")}
    assert {r.source for r in retrieval.prefer_sources(found, preferred, allow_fallback=False).collect()} == {"b"}
    best = retrieval.rerank(found, lambda q, t: t.str.len(), 1).collect()
    assert {(r.query_id, r.source, r.rank) for r in best} == {(1, "b", 1), (2, "c", 1)}


def test_coverage(spark):
    ledger = spark.createDataFrame([("a", "", "q1", 1), ("", "a", "q2", 2), ("", "", "q3", 3), ("b", None, "q4", 4)], "source_path string, source string, question string, seq long")
    assert {r.source: r.usage for r in coverage.usage(ledger).collect()} == {"a": 2, "b": 1}
    assert {r.source: r.questions for r in coverage.recent_per_source(ledger).collect()} == {"a": ["q1", "q2"], "b": ["q4"]}
    ratios = coverage.coverage_ratio(spark.createDataFrame([("a", 4), ("b", 1), ("c", 2)], "source string, chunks long"), coverage.usage(ledger))
    assert [r.source for r in coverage.source_pool(ratios, balance=True, draw=0.5).collect()] == ["c"]
    assert coverage.source_pool(ratios, balance=True, draw=0.1).count() == 3


def test_seed_layouts(spark):
    wide = {"variants": {"english": {"t": [" a ", "", 3, "b"]}, "msa": {"t": ["c"], "u": []}}}
    topic_first = {"t": {"english": ["a", "b"], "msa": ["c"]}}
    for payload in (wide, topic_first):
        rows = {(r.variant, r.topic, r.question) for r in seeds.seed_table(spark, payload).collect()}
        assert rows == {("english", "t", "a"), ("english", "t", "b"), ("msa", "t", "c")}
    assert seeds.pivot(seeds.seed_table(spark, wide)).collect()[0].topics == {"t": ["a", "b"]}
    assert {r.variant for r in seeds.seed_table(spark, {"t": ["a"]}).collect()} == {"english"}
    assert seeds.resolve_variant({"english", "msa"}, language="ar") == "msa" and seeds.resolve_variant({"x"}) == ""


def test_run_of_a_batch(spark, tmp_path):
    slots = state.init_slots(spark, "run", spark.createDataFrame([(0, "2"), (1, "bad"), (2, "0")], "conversation_index int, target_n_turns string"))
    assert {r.conversation_id for r in slots.collect()} == {"run-0000", "run-0001", "run-0002"}
    ask = lambda s, turn, n: s.withColumn("question", F.concat(F.lit(f"q{turn} "), F.when(F.col("conversation_index") == 2, "1").otherwise(F.col("conversation_index").cast("string"))))
    done, turns = state.run_batch(slots, spark.createDataFrame([], "question string"), ask, lambda a: a.withColumn("assistant", F.lit("ok")), folder=str(tmp_path), run_id="run", last_turn=2, retries=0)
    assert {(r.conversation_index, r.status, r.n_turns) for r in done.collect()} == {(0, "completed", 2), (1, "completed", 1), (2, "dropped", 0)}
    assert turns.count() == 3 and state.persistable(done).count() == 2
    back = state.restore_slots(spark, "run", done, 4, 3).orderBy("conversation_index").collect()
    assert [r.status for r in back] == ["completed", "completed", "dropped", "active"] and back[3].target_n_turns == 3


def test_export_bundle(spark, tmp_path):
    lines = spark.createDataFrame([('{"messages":[]}',)], "value string")
    report = spark.createDataFrame([("records", "", 1.0), ("words_histogram", "1-2", 3.0), ("languages", "en", 1.0)], "metric string, bucket string, value double")
    names = export.write_bundle(lines, report, str(tmp_path), repo_id="me/set")
    card = (tmp_path / "README.md").read_text()
    assert "config_name: default" in card and "split: train" in card and "# set" in card and names[-1] == "plots/word_count_distribution.svg"
    assert export.gutter(["x"]) == 140 and export.gutter(["x" * 99]) == 360


def test_settings():
    run = config.run_settings({"run": {"turns": {"mode": "range", "min": 2, "max": 5, "distribution": "pois"}, "languages": "en, fr,en"}, "retrieval": {"top_k": 7, "chunk_size": 900, "overlap": 120}})
    assert (run.turns.least, run.turns.most, run.turns.distribution, run.languages, run.retrieval.top_k) == (2, 5, "poisson", ("en", "fr"), 7)
    with pytest.raises(ValueError):
        config.run_settings({"run": {"turns": {"exact": 2, "min": 1}}})
    assert config.render_template("{{ a }} {{b}}", {"a": "{{ b }}"}) == "{{ b }} "
    assert config.load_secrets("A_TOKEN='x'\n#B_KEY=1\nPLAIN=2\nexport C_API_KEY=y", {}) == {"A_TOKEN": "x", "C_API_KEY": "y"}
    assert sampling.plan_waves(5, 2, ["en"]) == [("en", 0, 2), ("en", 1, 2), ("en", 2, 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("é ".encode("latin-1"))
    (tmp_path / "b.md").write_text(" x\n")
    (tmp_path / "c.json").write_text("{}")
    assert {r.text for r in files.knowledge_files(spark, str(tmp_path)).collect()} == {"é", "x"}
    lines = tmp_path / "l"
    lines.mkdir()
    (lines / "a.jsonl").write_text('{"a":1}\n\nbad\n[1]\n{"b":2}\n')
    assert files.json_lines(spark, str(lines)).count() == 2 and files.line_count(spark, str(lines)) == 5
    tail = coverage.ledger_tail(files.numbered_lines(spark, str(lines)), 3).orderBy("seq").collect()
    assert [r.value for r in tail] == ["bad", "[1]", '{"b":2}']
    found = adapters.web_search(spark.createDataFrame([("q",)], "query string"), lambda q, n: [{"title": "t"}] * 9, num_results=2).first()
    assert len(found.results) == 2 and found.results[0].link == "No link"
    vectors = adapters.embed(spark.createDataFrame([("a b",), (None,)], "text string"), adapters.hashing_embedder(8)).collect()
    assert abs(sum(x * x for x in vectors[0].v) - 1) < 1e-6 and len(vectors[1].v) == 8


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:00:00", "A?"), ("2024-01-01 00:01:00", " a? "), ("2024-01-02 00:00:00", "b")], "ts string, question string")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, question string").parquet(str(tmp_path / "in"))
    run = questions.first_questions(stream).writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r.normalized for r in spark.table("firsts").collect()} == {"a?", "b"}
    writer = questions.append_ledger(stream, str(tmp_path / "ledger"), str(tmp_path / "checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 3


def test_snippet_cascade_falls_back_step_by_step(spark):
    chunks = spark.createDataFrame([(k, f"s{k % 4}") for k in range(40)], "id long, source string")
    slots = spark.createDataFrame([(1, "seeded"), (2, "followup"), (3, "fresh"), (4, "adjacent")], "slot long, mode string")
    found = spark.createDataFrame([(1, 1, 0, "s0"), (1, 2, 1, "s1"), (1, 3, 4, "s0"), (2, 1, 2, "s2"), (3, 1, 5, "s1"), (4, 1, 7, "s3")], "slot long, rank int, id long, source string")
    used, pool = spark.createDataFrame([(4,), (7,)], "id long"), lambda *s: spark.createDataFrame([(x,) for x in s], "source string")

    def told(preferred):
        rows = sampling.snippet_cascade(slots, found, chunks, used, preferred).collect()
        return {s: ({r.way for r in rows if r.slot == s}, sorted(r.id for r in rows if r.slot == s), {r.source for r in rows if r.slot == s}) for s in (1, 2, 3, 4)}

    got = told(pool("s0"))
    # Preferred hits only; no preferred hit, so all; never searched; all hits used.
    assert got[1] == ({0}, [0], {"s0"}) and got[2] == ({0}, [2], {"s2"})
    assert all(got[s][0] == {1} and got[s][2] == {"s0"} and len(set(got[s][1])) == 6 and not {4, 7} & set(got[s][1]) for s in (3, 4))
    got = told(pool("none"))
    assert got[1][1] == [0, 1] and got[3][0] == {2} and len(got[3][1]) == 6
    asked = sampling.snippet_queries(spark.createDataFrame([(1, "seeded", "q", "a"), (2, "followup", "q", ""), (3, "adjacent", "q", "a"), (4, "fresh", "q", "a")], "slot long, mode string, seed_query string, last_assistant string"))
    assert {r.slot: r.query for r in asked.collect()} == {1: "q", 2: "q", 3: "a"}
    assert sampling.draws(slots, chunks.filter("false"), 3).count() == 0 and sampling.draws(slots, chunks.limit(2), 8).count() == 8


def test_many_queries_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 10)
    rng = random.Random(4)
    vectors = [(k, [rng.random() for _ in range(4)]) for k in range(60)]
    found = retrieval.nearest(spark.createDataFrame(vectors[:25], "query_id long, q array<double>"), spark.createDataFrame(vectors, "id long, v array<double>"), 3)
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(q, n + 1, i) for q, a in vectors[:25] for n, (i, _) in enumerate(sorted(vectors, key=lambda v: (-score(a, v[1]), v[0]))[:3])}
    rows = [(r.query_id, r["rank"], r.id) for r in found.collect()]
    assert len(rows) == 75 and set(rows) == want
