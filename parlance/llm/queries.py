"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anagrams, decontamination, html_text, jaccard_join, merkle, mixing, nearest, passages, quality, sharding, tokens, toxicity, url_filter
from .common import save, table
from .learning import fold

#: The rules of the URL query: verdict, host, path.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
N_SHARDS = 40
#: The vocabulary that tokens are counted by, and the most tokens that a text should have.
VOCABULARY, MOST_TOKENS = "byte_bpe_50k.json", 1024


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=("page_id",))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = toxicity.score(docs, lexicon)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("text_key")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = quality.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the library's rules; null and empty texts have none."""
    out = tokens.counted(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > MOST_TOKENS).alias("over_limit"))


def misspelt(doc_id: str | None, run: str) -> str:
    """The run without one of its letters if 97 divides the hash of id and run, else as it is."""
    hashed = zlib.crc32(f"{doc_id or ''}:{run}".encode())
    at = hashed % len(run)
    return run if hashed % 97 else run[:at] + run[at + 1 :]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that occur three times and more, with the form that each may be a variant of."""
    counts = anagrams.word_counts(table(spark, sf_dir, "documents"), least_length=5, rewrite=misspelt)
    return anagrams.variants(save(counts.filter("n >= 3"), "words"), times=2)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof that each document is part of the dataset, tried on a fifth of the documents with their letters changed."""
    docs = table(spark, sf_dir, "documents")
    folded_text = F.translate("text", ascii_uppercase, ascii_lowercase)
    leaf_of = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_of(folded_text))
    out = merkle.manifest(docs.select("doc_id", "source", leaf_of(F.col("text")).alias("leaf"), tampered.alias("tampered")))
    out = out.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("places"), F.col("siblings")))
    proof = F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256")
    return out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_url_filters": op2_url_filters,
        "op3_toxicity": op3_toxicity,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_sharding": op5_sharding,
        "op6_mixing": op6_mixing,
        "op7_nearest_neighbours": op7_nearest_neighbours,
        "op8_decontamination": op8_decontamination,
        "op9_quality_classifier": op9_quality,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_token_counts": op11_token_counts,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


OP2_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), rules(action, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), longest AS (
  SELECT page_id, host, path,
    (SELECT max_by(struct_pack(rule := rhost || rpath, action := action), length(rhost || rpath) * 1000 + length(rhost)) FROM rules
     WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS r
  FROM parts
)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.action, 'allow') AS verdict FROM longest
"""

OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('6:' || coalesce(doc_id::VARCHAR, '~') || ':' || coalesce(md5(text), '~')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT + 1]::DOUBLE AS weight
  FROM sized GROUP BY source
), leveled AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    1.5::DOUBLE * sum(source_size) OVER () AS whole,
    coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS capped,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight
  FROM sources
  WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
    least(cap, coalesce((SELECT arg_min((whole - capped) / open_weight, cap / weight) FROM leveled WHERE (whole - capped) / open_weight * weight <= cap) * weight, cap)) AS target
  FROM leveled
), parts AS (
  SELECT source, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS sure,
    CASE WHEN source_size > 0 THEN greatest(0, target - floor(target / source_size) * source_size) ELSE 0 END AS part
  FROM targets
), classes AS (
  SELECT d.source, part, ceil(sqrt(size::DOUBLE))::BIGINT AS x, sum(size)::BIGINT AS words
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source WHERE size > 0 AND part > 0 GROUP BY ALL
), tried AS (
  SELECT source, x, part - coalesce(sum(words) OVER (PARTITION BY source ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    (sum(x * words) OVER (PARTITION BY source ORDER BY x DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weight
  FROM classes
), levels AS (
  SELECT source, arg_max(rest / weight, x) AS level, arg_max(rest, x) AS rest FROM tried WHERE rest / weight * x < 1 GROUP BY source
), odds AS (
  SELECT doc_id, d.source, size, source_size, target, sure, l.rest, u, level * ceil(sqrt(size::DOUBLE)) AS chance
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN levels l ON d.source IS NOT DISTINCT FROM l.source
), ranked AS (
  SELECT *, CASE WHEN chance > 0 AND chance < 1 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank FROM odds
), run AS (
  SELECT *, coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, u, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM ranked
)
SELECT doc_id, size, source_size, target,
  ((sure + CASE WHEN chance >= 1 OR (rank IS NOT NULL AND 2 * ahead + size <= 2 * rest) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM run
"""

# crc32 by its table of 256 values; near words share what is left when one letter at the same place is taken out.
OP12_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), bytes AS (
  SELECT doc_id, run, n, list_transform(range(0, octet_length(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) * 2, 2),
    lambda i: ('0x' || substr(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), i::INT + 1, 2))::BIGINT) AS b FROM counted
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM bytes, crc_table
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), cut AS (
  SELECT word, n, length(word) AS l, unnest(range(1, length(word) + 1)) AS p, substr(word, 1, p::INT - 1) || substr(word, p::INT + 1) AS rest FROM words
), pairs AS (
  SELECT a.word AS word, b.word AS near FROM cut a JOIN cut b ON a.l = b.l AND a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT p.word, count(*) AS n_near, max(w.n) AS top FROM pairs p JOIN words w ON p.near = w.word GROUP BY p.word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
    CASE WHEN b.top >= 2 * w.n THEN (SELECT min(p.near) FROM pairs p JOIN words v ON p.near = v.word WHERE p.word = w.word AND v.n = b.top) END AS form,
    CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  WITH RECURSIVE steps(word, tip) AS (
    SELECT word, word FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.tip = f.word WHERE f.form IS NOT NULL
  )
  SELECT s.word, s.tip FROM steps s JOIN forms f ON s.tip = f.word WHERE f.form IS NULL
)
SELECT f.word, f.form, c.tip AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN chain c ON f.word = c.word
"""

def op13_sql(levels: int = 6, source_levels: int = 3) -> str:
    """The manifest level by level, for sources of 16 ** levels rows and 16 ** source_levels sources at most."""
    told = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR END"
    row = lambda text: "sha256(" + " || ".join(map(told, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    parts = [
        f"""crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), hashed AS (
  SELECT doc_id, source, {row("text")} AS leaf, {row("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS folded,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc
  FROM documents, crc_table
), a0 AS (
  SELECT doc_id, source AS tree, leaf, leaf AS h, CASE WHEN crc % 5 = 0 THEN folded ELSE leaf END AS tried,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed
)"""
    ]
    run = "PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"

    def climb(name: str, n: int) -> None:
        for k in range(n):
            parts.append(f"""{name}s{k} AS (
  SELECT tree, pos, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}
), {name}{k + 1} AS (
  SELECT tree, pos // 16 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h, ((max(n) + 15) // 16)::BIGINT AS n FROM {name}{k} GROUP BY tree, pos // 16
)""")  # fmt: skip

    climb("a", levels)
    parts.append(f"b0 AS (SELECT tree AS of, '' AS tree, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a{levels})")
    climb("b", source_levels)
    parts.append("p0 AS (SELECT doc_id, tree, leaf, tried, '' AS proof, pos FROM a0)")
    last = 0
    step = lambda s: f"CASE WHEN {s}.n > 1 THEN sha256({s}.l || p.tried || {s}.r) ELSE p.tried END AS tried, p.proof || {s}.l || {s}.r AS proof"
    for k in range(levels):
        parts.append(f"p{last + 1} AS (SELECT doc_id, p.tree, leaf, {step('s')}, p.pos // 16 AS pos FROM p{last} p JOIN as{k} s ON p.tree IS NOT DISTINCT FROM s.tree AND p.pos = s.pos)")
        last += 1
    parts.append(f"p{last + 1} AS (SELECT doc_id, p.tree, leaf, tried, proof, b0.pos, b0.h AS subroot FROM p{last} p JOIN b0 ON p.tree IS NOT DISTINCT FROM b0.of)")
    last += 1
    for k in range(source_levels):
        parts.append(f"p{last + 1} AS (SELECT doc_id, subroot, leaf, {step('s')}, p.pos // 16 AS pos FROM p{last} p JOIN bs{k} s ON p.pos = s.pos)")
        last += 1
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, tried AS folded_root, tried = h AS verified FROM p{last}, b{source_levels}"


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op6_mixing": OP6_SQL, "op12_spelling_variants": OP12_SQL, "op13_merkle_manifest": op13_sql()}
