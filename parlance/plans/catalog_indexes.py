"""Queries over the test tables that keep indexes, versions and commits up to date."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.snapshots import Snapshots
from parlance.functions.tables import shared_folder, written
from parlance.functions.text import normalize_question, simple_upper
from parlance.operators import records, sampling, shapes, sketches, stats, vector_index
from parlance.plans import chunk_index, dataset, export
from parlance.plans.catalog import CHUNKS, PAIRED, PER_CONV, norm_sql, query, read, u_sql
from parlance.plans.catalog_records import done
from parlance.sources import files, search_source, stages
from parlance.streaming import commits, fan_out

# A corpus in two states: one source comes later, another goes, and the texts of a language change.
LATER, GONE, CHANGED = "src5", "src3", "fr"
STATES = f"""SELECT doc_id, source, lang, CASE WHEN lang = '{CHANGED}' THEN upper(text) ELSE text END AS text, n_chars FROM documents WHERE source IS DISTINCT FROM '{GONE}'"""


def _states(spark, d):
    """Both states' files: path, size, mtime, and a row's other columns."""
    docs = read(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string"))
    changed = F.col("lang").eqNullSafe(CHANGED)
    first = docs.filter(~F.col("source").eqNullSafe(LATER)).withColumn("mtime", F.lit("1"))
    second = docs.filter(~F.col("source").eqNullSafe(GONE)).withColumn("mtime", F.when(changed, "2").otherwise("1")).withColumn("text", F.when(changed, simple_upper(F.col("text"))).otherwise(F.col("text")))
    return first, second


def _refreshed(spark, d):
    """An index brought to the first state, to the second, and to the second again; what each refresh did."""
    folder, done = f"{shared_folder(spark)}/chunks", []
    first, second = _states(spark, d)
    for files in (first, second, second):
        load = lambda paths, f=files: f.select("path", "text", "doc_id").join(paths, "path", "left_semi")
        done.append(chunk_index.refresh(spark, folder, files.select("path", F.col("n_chars").alias("size"), "mtime"), load))
    return folder, done


@query(f"SELECT doc_id, chunk_index, md5(doc_id::VARCHAR) || '-' || chunk_index AS id, sha256(text) AS hash, char_start, char_end FROM ({CHUNKS.replace('FROM documents', f'FROM ({STATES})')})")
def chunk_index_rows(spark, d):
    folder, _ = _refreshed(spark, d)
    return chunk_index.chunks(spark, folder).select("doc_id", "chunk_index", "id", F.sha2("text", 256).alias("hash"), "char_start", "char_end")


@query(f"SELECT doc_id, chunk_index, char_start, char_end FROM ({CHUNKS.replace('FROM documents', f'''FROM (SELECT * FROM documents WHERE source IS DISTINCT FROM '{LATER}')''')})")
def chunk_index_version(spark, d):
    """The first state, read by its version after the second was committed."""
    folder, done = _refreshed(spark, d)
    return chunk_index.chunks(spark, folder, done[0].version).select("doc_id", "chunk_index", "char_start", "char_end")


@query(
    f"""SELECT 0 AS step, count(*) FILTER (source IS DISTINCT FROM '{LATER}') AS cut, 0 AS removed, 0 AS kept FROM documents
    UNION ALL SELECT 1, count(*) FILTER (source IS DISTINCT FROM '{GONE}' AND (source = '{LATER}' OR lang = '{CHANGED}')), count(*) FILTER (source = '{GONE}'), count(*) FILTER (source IS DISTINCT FROM '{GONE}' AND source IS DISTINCT FROM '{LATER}' AND lang IS DISTINCT FROM '{CHANGED}') FROM documents
    UNION ALL SELECT 2, 0, 0, count(*) FILTER (source IS DISTINCT FROM '{GONE}') FROM documents"""
)
def chunk_index_refreshes(spark, d):
    _, done = _refreshed(spark, d)
    return spark.createDataFrame([(k, r.cut, r.removed, r.kept) for k, r in enumerate(done)], "step int, cut long, removed long, kept long")


@query("SELECT 1 AS version, source, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 2, source, count(*) FROM documents WHERE lang = 'en' GROUP BY source")
def table_versions(spark, d):
    """Both versions of a table, read after the second was committed."""
    held, docs = Snapshots(spark, f"{shared_folder(spark)}/table"), read(spark, d, "documents")
    counts = lambda rows: rows.groupBy("source").agg(F.count("*").alias("n"))
    first, second = held.publish(counts(docs)), held.publish(counts(docs.filter("lang = 'en'")))
    return held.read(first).withColumn("version", F.lit(first)).unionByName(held.read(second).withColumn("version", F.lit(second)))


@query("SELECT source, count(*) AS n, 4 AS versions FROM documents GROUP BY source")
def concurrent_commits(spark, d):
    """Four writers at once: each gets a version of its own."""
    held, docs = Snapshots(spark, f"{shared_folder(spark)}/table"), read(spark, d, "documents")
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(held.publish, [docs.groupBy("source").agg(F.count("*").alias("n"))] * 4))
    return held.read().withColumn("versions", F.lit(len(set(made))))


@query("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1 THEN 'accepted' ELSE 'in_batch' END AS outcome FROM events")
def stream_first_wins(spark, d):
    """Events in files of mixed order, read as many at a time as there are cores; the stream stops half way and goes on from its checkpoint."""
    folder, rows, cores = shared_folder(spark), read(spark, d, "events"), spark.sparkContext.defaultParallelism
    asked = rows.select("event_id", F.concat_ws(" ", "event_type", "user_id").alias("question"), F.col("ts").cast("timestamp").alias("ts"))
    half = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    commits.use_store(spark)
    # A row long after all others tells that no more of them come.
    end = asked.agg(F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("question"), (F.max("ts") + F.expr("INTERVAL 2000 DAYS")).alias("ts"))
    for part in (asked.filter(half), asked.filter(~half), end):
        part.repartition(2 * cores, "question").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", cores).parquet(f"{folder}/in")
        told = commits.first_wins_stream(stream, order="event_id", delay="800 days")
        told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").filter("event_id >= 0").select("event_id", "outcome")


EXACT = """SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS score
  FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings c)) WHERE rank <= 20"""


def _vector_index(spark, d):
    vectors, folder = read(spark, d, "embeddings"), f"{shared_folder(spark)}/vectors"
    vector_index.build(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), folder)
    return vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), folder


@query(EXACT)
def vector_index_all_probes(spark, d):
    """All buckets of a table are looked into: the exact neighbours."""
    asked, folder = _vector_index(spark, d)
    return vector_index.nearest(asked, folder, 20, probes=1 << vector_index.MOST_BITS, digits=6)


@query()
def vector_index_neighbours(spark, d):
    """The neighbours found by the probes that the index was built for; the tests hold its recall against the exact ones."""
    asked, folder = _vector_index(spark, d)
    return vector_index.nearest(asked, folder, 20)


# Tables of finished conversations, with their contents.

MESSAGES = f"""SELECT concat('c', conv_id) AS conversation_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn_index, role DESC) - 1)::INT AS pos, role, content FROM (
  SELECT conv_id, turn_index, 'user' AS role, "user" AS content FROM ({PAIRED}) UNION ALL SELECT conv_id, turn_index, 'assistant', assistant FROM ({PAIRED})) WHERE content <> ''"""


def _messages(rows):
    return rows.select("conversation_id", F.posexplode("messages").alias("pos", "m")).select("conversation_id", "pos", "m.role", "m.content")


@query(MESSAGES)
def written_messages(spark, d):
    folder = shared_folder(spark)
    dataset.write_conversations(done(spark, d), folder)
    return _messages(spark.read.json(f"{folder}/conversations"))


def _fanned_out(spark, d):
    """Two streams over halves of the conversations, as many files at a time as there are cores; the last batch of each comes twice."""
    folder, rows, cores = shared_folder(spark), written(done(spark, d), "done"), spark.sparkContext.defaultParallelism
    for run, rest in (("first", 0), ("second", 1)):
        part = rows.filter(F.pmod(F.xxhash64("conversation_id"), F.lit(2)) == rest)
        part.repartition(2 * cores).write.parquet(f"{folder}/in/{run}")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", cores).parquet(f"{folder}/in/{run}")
        fan_out.fan_out(stream, f"{folder}/out", run, f"{folder}/at/{run}").trigger(availableNow=True).start().awaitTermination()
        fan_out.sink(f"{folder}/out", run)(part, 0)
    return f"{folder}/out"


@query(MESSAGES)
def stream_fan_out(spark, d):
    return _messages(fan_out.table(spark, _fanned_out(spark, d), "conversations"))


@query(
    f"""SELECT concat('c', conv_id) AS conversation_id, turn_index::INT AS turn_index, "user" AS user_message, assistant AS assistant_message FROM ({PAIRED})"""
)
def stream_fan_out_turns(spark, d):
    return fan_out.table(spark, _fanned_out(spark, d), "turns").select("conversation_id", F.col("turn_index").cast("int").alias("turn_index"), "user_message", "assistant_message")


# Statistics of parts, merged.


def _kept_parts(spark, d):
    """Summaries of five parts, the first of which is stored twice."""
    folder, rows = f"{shared_folder(spark)}/parts", read(spark, d, "conversations")
    for k in (0, 1, 2, 3, 4, 0):
        sketches.keep(spark, folder, f"part{k}", rows.filter(F.pmod(F.xxhash64("conv_id"), F.lit(5)) == k))
    return sketches.merged(sketches.kept(spark, folder))


@query(
    f"""SELECT count(*) AS conversations, sum(n_messages)::BIGINT AS messages, sum(words)::BIGINT AS words_sum, count(*) FILTER (words > 0) AS words_n, min(words) FILTER (words > 0) AS words_min, max(words) FILTER (words > 0) AS words_max,
    sum(tokens)::BIGINT AS tokens_sum, min(tokens) FILTER (tokens > 0) AS tokens_min, max(tokens) FILTER (tokens > 0) AS tokens_max FROM ({PER_CONV})"""
)
def merged_statistics(spark, d):
    names = ("conversations", "messages", "words_sum", "words_n", "words_min", "words_max", "tokens_sum", "tokens_min", "tokens_max")
    return _kept_parts(spark, d).select(*names)


@query(
    f"""WITH s AS (SELECT words FROM ({PER_CONV}) WHERE words > 0), q AS (SELECT count(DISTINCT {norm_sql("text")}) AS n FROM conversations WHERE role = 'user' AND {norm_sql("text")} <> '')
    SELECT 'words ' || q AS metric, TRUE AS within FROM (VALUES ('0.25'), ('0.5'), ('0.75')) v(q) UNION ALL SELECT 'questions', n >= 0 FROM q UNION ALL SELECT 'histogram', TRUE"""
)
def merged_sketches(spark, d):
    """Whether quartiles, distinct questions and the histogram from merged sketches lie within the stated bounds of exact ones."""
    rows, summary = read(spark, d, "conversations"), _kept_parts(spark, d)
    told = {(r.metric, r.bucket): r.value for r in sketches.report(summary).collect()}
    sizes = stats.conversation_sizes(rows).filter("words > 0")
    marks = [F.avg((F.col("words") <= told["words_quantile", q]).cast("int")).alias(f"le_{q}") for q in ("0.25", "0.5", "0.75")]
    below = [F.avg((F.col("words") < told["words_quantile", q]).cast("int")).alias(f"lt_{q}") for q in ("0.25", "0.5", "0.75")]
    exact = sizes.agg(F.count("*").alias("n"), *marks, *below).first()
    slack = sketches.RANK_ERROR + 1 / exact.n
    out = [(f"words {q}", exact[f"lt_{q}"] - slack <= float(q) <= exact[f"le_{q}"] + slack) for q in ("0.25", "0.5", "0.75")]
    questions = rows.filter("role = 'user'").select(normalize_question(F.col("text")).alias("q")).filter("q <> ''").agg(F.countDistinct("q").alias("n")).first().n
    out.append(("questions", abs(told["distinct_questions", ""] - questions) <= 4 * sketches.DISTINCT_ERROR * questions + 1))
    want = {r.label: r["count"] for r in stats.histogram(sizes, "words").collect()}
    bins = set(want) | {b for m, b in told if m == "words_histogram"}
    out.append(("histogram", all(abs(told.get(("words_histogram", b), 0) - want.get(b, 0)) <= 2 * sketches.RANK_ERROR * exact.n + 1 for b in bins)))
    return spark.createDataFrame(out, "metric string, within boolean")


# Web search as a source.


def echo(query_: str, n: int) -> list[dict]:
    """Stands in for a service: as many results as the query has letters in its first word, none for queries of a length that four divides."""
    if len(query_) % 4 == 0:
        raise ValueError("no answer")
    word = query_.split(" ")[0]
    return [{"title": f"{word} {k}", "link": "" if k == 1 else f"l{k}"} for k in range(len(word))][:n]


def _search(spark, d, way):
    folder = shared_folder(spark)
    read(spark, d, "benchmark").select(F.col("text").alias("query")).repartition(3).write.parquet(folder)
    search_source.register(spark)
    return way.format(search_source.NAME).option("path", folder).option("search", f"{__name__}:echo")


ECHO = """SELECT text AS query, rank::INT AS rank, concat(w, ' ', rank - 1) AS title, CASE WHEN rank = 2 THEN 'No link' ELSE concat('l', rank - 1) END AS link, 'No snippet provided.' AS snippet
  FROM (SELECT text, split_part(text, ' ', 1) AS w, unnest(range(1, least(5, length(split_part(text, ' ', 1))) + 1)) AS rank FROM benchmark WHERE length(text) % 4 <> 0)"""


@query(ECHO)
def search_source_rows(spark, d):
    return _search(spark, d, spark.read).load()


@query(f"SELECT query, rank, title FROM ({ECHO}) WHERE rank <= 2 AND query IN (SELECT min(text) FROM benchmark UNION SELECT max(text) FROM benchmark)")
def search_source_filters(spark, d):
    """A filter on query and rank, pushed down: other queries are not asked."""
    ends = read(spark, d, "benchmark").agg(F.min("text").alias("a"), F.max("text").alias("b")).first()
    return _search(spark, d, spark.read).load().filter(F.col("query").isin(ends.a, ends.b) & (F.col("rank") <= 2)).select("query", "rank", "title")


@query(ECHO)
def search_source_stream(spark, d):
    folder, stream = shared_folder(spark), _search(spark, d, spark.readStream).load()
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


# Choices that need more than one table.

CASCADE = f"""WITH slots AS (SELECT c_custkey AS slot, c_custkey % 5 IN (0, 1, 2) AS searched FROM customer),
free AS (SELECT doc_id AS id, source FROM documents WHERE lang IS DISTINCT FROM 'de'),
found AS (SELECT slot, rank, id, source, source < 'src15' AS wanted FROM (SELECT slot, searched, row_number() OVER (PARTITION BY slot ORDER BY doc_id) AS rank, doc_id AS id, source FROM slots JOIN documents ON doc_id % 100 = slot % 100)
  JOIN free USING (id, source) WHERE searched),
hits AS (SELECT slot, rank, id, source, 0 AS way FROM (SELECT *, bool_or(coalesce(wanted, FALSE)) OVER (PARTITION BY slot) AS met FROM found) WHERE wanted OR NOT met),
laid AS (SELECT id, source, row_number() OVER (ORDER BY md5(concat('0:', id)), id) - 1 AS place, count(*) OVER () AS n FROM free WHERE source < 'src15'),
asked AS (SELECT slot, rank, floor({u_sql("0-draw", "slot")})::BIGINT AS zero, {u_sql("0-draw", "slot")} AS u FROM slots, range(1, 9) r(rank) WHERE slot NOT IN (SELECT slot FROM hits)),
near AS (SELECT slot, rank, id, source, 1 AS way FROM asked, (SELECT max(n) AS n FROM laid) c JOIN laid ON place = (floor(u * c.n)::BIGINT + rank - 1) % c.n WHERE rank <= c.n)
SELECT slot, id, source, way FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY rank, id) AS k FROM (FROM hits UNION ALL FROM near)) WHERE k <= 6"""


@query(CASCADE)
def snippet_cascade(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    mode = F.element_at(F.array(*map(F.lit, ("seeded", "followup", "adjacent", "fresh", "off_topic"))), (F.col("slot") % 5 + 1).cast("int"))
    slots = read(spark, d, "customer").select(F.col("c_custkey").alias("slot")).withColumns({"mode": mode, "search": F.col("slot") % 100})
    asked = docs.drop("lang").withColumn("search", F.col("id") % 100)
    # Slots that ask the same share what it finds.
    found = asked.withColumn("rank", F.row_number().over(W.partitionBy("search").orderBy("id")))
    used, wanted = docs.filter("lang = 'de'").select("id"), docs.filter("source < 'src15'").select("source").distinct()
    return sampling.snippet_cascade(slots, found, docs.drop("lang"), used, wanted, search="search").select("slot", "id", "source", "way")


@query(
    f"""WITH t AS (SELECT conv_id, turn_index, "user" AS u, assistant AS a FROM ({PAIRED})),
    lines AS (SELECT conv_id, turn_index, 0 AS pos, concat('Turn ', turn_index, ' - User: ', u) AS line FROM t WHERE u <> '' UNION ALL SELECT conv_id, turn_index, 1, concat('Turn ', turn_index, ' - Assistant: ', a) FROM t WHERE a <> '')
    SELECT concat('c', conv_id) AS conversation_id, md5(coalesce(h, 'No prior turns.')) AS history, n::INT AS turn_count, length(coalesce(h, 'No prior turns.'))::DOUBLE AS score, CASE WHEN n % 2 = 0 THEN 'conversation judge parse failure' END AS notes_if_broken
    FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id) c LEFT JOIN (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn_index, pos) AS h FROM lines GROUP BY conv_id) USING (conv_id)"""
)
def conversation_judges(spark, d):
    """Verdicts by a model that scores a transcript's length, and those of one whose answers break for even numbers of turns."""
    inputs = records.conversation_judge_inputs(done(spark, d))

    def load(broken):
        def call(request):
            said = request["messages"][-1]["content"]
            history = said.split("Conversation:\n", 1)[1].rsplit("\n\nTurns as JSON:", 1)[0]
            n = int(said.split(" turns.", 1)[0].rsplit(" ", 1)[1])
            return {"content": "no json" if broken and n % 2 == 0 else json.dumps({"score": len(history), "notes": None})}

        return lambda: call

    first = stages.judged_conversations(inputs, load(False)).select("conversation_id", F.md5("public_history").alias("history"), "turn_count", "judge.score")
    second = stages.judged_conversations(inputs, load(True), system="s").select("conversation_id", F.col("judge.notes").alias("notes_if_broken"))
    return first.join(second, "conversation_id")


@query("SELECT item_id::VARCHAR AS name, concat('é ', length(text)) AS text FROM benchmark")
def latin_files(spark, d):
    """Knowledge files in UTF-8 and in Latin-1, a file for each item."""
    folder, rows = shared_folder(spark), read(spark, d, "benchmark")
    for k, charset in enumerate(("UTF-8", "ISO-8859-1")):
        some = rows.filter(F.col("item_id") % 2 == k)
        parts = some.select("item_id", F.format_string("é %d", F.length("text")).alias("value")).withColumn("name", F.col("item_id").cast("string"))
        parts.select("name", "value").write.partitionBy("name").option("encoding", charset).option("quote", "").option("escapeQuotes", "false").option("extension", "txt").csv(f"{folder}/{k}")
    found = files.knowledge_files(spark, folder)
    return found.select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), "text")


#: Rows of several shapes: a key of two types, one that is null, one that few have, and rows that are no objects.
RAGGED = """CASE event_id % 4 WHEN 0 THEN concat('{"id":', event_id, ',"kind":"', event_type, '","user":{"id":', user_id, '}}')
  WHEN 1 THEN concat('{"id":"', event_id, '","kind":"', event_type, '"}') WHEN 2 THEN concat('{"id":', event_id, ',"kind":null,"tags":[', user_id, ',"', event_type, '"]}') ELSE concat('[', event_id, ']') END"""


@query(
    f"""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_type END AS kind, CASE WHEN event_id % 4 = 0 THEN user_id END AS user_id, CASE WHEN event_id % 4 = 2 THEN 2 END::INT AS n_tags,
    CASE event_id % 4 WHEN 2 THEN 'kind=null' WHEN 3 THEN concat('$=[', event_id, ']') ELSE '' END AS rest, {RAGGED} AS json FROM events"""
)
def ragged_shapes(spark, d):
    """Typed columns by the schema that the rows agree on, what doesn't fit, and the whole put together again."""
    rows = read(spark, d, "events").select("event_id", F.expr(f"parse_json({RAGGED})").alias("v"))
    out = shapes.restored(shapes.shaped(rows, "v"))
    rest = F.array_join(F.transform(F.map_entries("rest"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("event_id", "typed.kind", F.col("typed.user.id").alias("user_id"), F.nullif(F.coalesce(F.size("typed.tags"), F.lit(-1)), F.lit(-1)).alias("n_tags"), rest.alias("rest"), "json")


TURN_COUNTS = "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id"


@query(
    f"""SELECT 'languages' AS metric, lang AS bucket, count(*)::DOUBLE AS value FROM documents GROUP BY lang UNION ALL SELECT 'turn_count_distribution', n::VARCHAR, count(*) FROM ({TURN_COUNTS}) GROUP BY n
    UNION ALL SELECT 'records', '', count(*) FROM documents UNION ALL SELECT 'bars', '', count(DISTINCT n) FROM ({TURN_COUNTS}) UNION ALL SELECT 'card lines', '', count(DISTINCT lang) + 1 FROM documents"""
)
def export_files(spark, d):
    """The statistics, the chart and the card of a bundle as they were written, read again."""
    folder, docs = shared_folder(spark), read(spark, d, "documents")
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    row = lambda metric, bucket, df: df.select(F.lit(metric).alias("metric"), bucket.cast("string").alias("bucket"), F.col("count").cast("double").alias("value"))
    report = row("languages", F.col("lang"), stats.distribution(docs, "lang")).unionByName(row("turn_count_distribution", F.col("n"), stats.distribution(turns, "n")))
    report = report.unionByName(row("records", F.lit(""), docs.agg(F.count("*").alias("count"))))
    line = F.to_json(F.struct(F.col("doc_id").alias("item_id")))
    export.write_bundle(docs.select(line.alias("value")), report, folder, repo_id="me/set")
    told = spark.read.option("multiLine", True).schema("metric string, bucket string, value double").json(f"{folder}/dataset_stats.json")
    bars = spark.read.text(f"{folder}/plots/turn_count_distribution.svg", wholetext=True).select(F.regexp_count("value", F.lit("<rect ")).alias("count"))
    lines = spark.read.text(f"{folder}/README.md").filter("value LIKE '- _%: _%' AND value NOT LIKE '- config%' AND value NOT LIKE '%split%'").agg(F.count("*").alias("count"))
    return told.unionByName(row("bars", F.lit(""), bars)).unionByName(row("card lines", F.lit(""), lines))
