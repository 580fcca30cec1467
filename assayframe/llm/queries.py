"""The operators over their whole tables; one query each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.llm import (
    chat_format,
    decontamination,
    language_id,
    lm_scoring,
    merkle_manifest,
    packing,
    periodic_runs,
    quality_crf,
    simhash_dedup,
    substring_dedup,
    token_files,
    topk_search,
    url_filters,
)
from assayframe.llm.common import crc_of_id, table
from assayframe.llm.registry import QUERIES, SQL, query  # noqa: F401

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    held_out = crc_of_id(F.col("doc_id")) % 4 == 2
    model = language_id.train(docs.where(~held_out))
    texts = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language_id.predict(texts, model).select("doc_id", "held_out", "lang_pred", "score")


OP2_SQL = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
    FROM scored
)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 5
"""


@query("op2_topk_search", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk_search.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
OP3_SQL = r"""
WITH rules(host, path, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
           ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), located AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), fitting AS (
    SELECT l.page_id, l.host, l.path, r.host || r.path AS rule, r.verdict,
        row_number() OVER (PARTITION BY l.page_id
            ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
    FROM located l LEFT JOIN rules r
      ON (l.host = r.host OR ends_with(l.host, '.' || r.host)) AND starts_with(l.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM fitting WHERE place = 1
"""


@query("op3_url_filters", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, folder, "pages"), rules)


@query("op5_simhash_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_dedup.classes(simhash_dedup.fingerprints(table(spark, folder, "documents")))
    return found.select(
        "doc_id", simhash_dedup.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id"
    )


@query("op9_token_files")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.new_folder(spark)
    manifest = token_files.write(table(spark, folder, "documents"), files, TOKENIZER, end_id=1)
    return token_files.read(manifest, files).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op10_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), TOKENIZER, end_id=2).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query("op4_lm_scoring")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = crc_of_id(F.col("doc_id")) % 10 == 0
    scored = lm_scoring.score(docs, docs.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), *scored.columns[1:])


@query("op7_substring_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, folder, "documents")).drop("key_a")


OP8_SQL = r"""
WITH items AS (
    SELECT DISTINCT item_id, words, len(words) AS size FROM (
        SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'),
                                    lambda w: w <> '') AS words FROM benchmark)
    WHERE len(words) >= 5
), docs AS (
    SELECT DISTINCT doc_id, words FROM (
        SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'),
                                   lambda w: w <> '') AS words FROM documents)
    WHERE len(words) >= 5
), item_places AS (
    SELECT item_id, size, place, array_to_string(words[place + 1:place + 5], ' ') AS shingle
    FROM (SELECT *, unnest(range(size - 4)) AS place FROM items)
), doc_places AS (
    SELECT doc_id, words, place, array_to_string(words[place + 1:place + 5], ' ') AS shingle
    FROM (SELECT *, unnest(range(len(words) - 4)) AS place FROM docs)
), laid AS (
    SELECT DISTINCT doc_id, size, greatest(d.place - i.place, 0) AS first_word,
        words[greatest(d.place - i.place, 0) + 1:greatest(d.place - i.place, 0) + size] AS win
    FROM doc_places d JOIN (SELECT DISTINCT size, place, shingle FROM item_places) i USING (shingle)
), windows AS (
    SELECT DISTINCT size, win FROM laid WHERE len(win) >= 5
), window_counts AS (
    SELECT size, win, array_to_string(win[place + 1:place + 5], ' ') AS shingle, count(*) AS n
    FROM (SELECT *, unnest(range(len(win) - 4)) AS place FROM windows) GROUP BY ALL
), item_counts AS (
    SELECT item_id, size, shingle, count(*) AS n FROM item_places GROUP BY ALL
), matches AS (
    SELECT win, size, item_id, sum(least(w.n, i.n))::BIGINT AS shared
    FROM window_counts w JOIN item_counts i USING (size, shingle) GROUP BY ALL
), found AS (
    SELECT *, shared::DOUBLE / (len(win) + size - 8 - shared)::DOUBLE AS similarity FROM matches
)
SELECT doc_id, item_id, first_word::INTEGER AS first_word, similarity FROM (
    SELECT doc_id, item_id, first_word, similarity,
        row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, first_word) AS place
    FROM laid JOIN found USING (win, size) WHERE similarity >= 0.8)
WHERE place = 1
"""


@query("op8_decontamination", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    ).drop("text_key")


TOOL_SCHEMAS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", True),
    ("lookup", "query", "string", True),
    ("forecast", "query", "string", True),
    ("forecast", "limit", "integer", False),
    ("forecast", "unit", "string", True),
    ("weather", "query", "string", True),
    ("weather", "limit", "boolean", True),
]
TOOLS = ["search", "lookup", "forecast", "weather"]
OP6_SQL = r"""
WITH roles AS (
    SELECT conv_id, turn, role, text,
        CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'text' END AS kind,
        lag(role) OVER w = 'user' AND lag(turn) OVER w = turn - 1 AS goes_on,
        lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), named AS (
    SELECT *,
        CASE kind WHEN 'call' THEN 'c' || turn WHEN 'result' THEN 'c' || (turn - 1) END AS call_id,
        CASE kind WHEN 'call' THEN ['search', 'lookup', 'forecast', 'weather'][(turn // 2) % 4 + 1]
            WHEN 'result' THEN CASE WHEN goes_on THEN ['search', 'lookup', 'forecast', 'weather'][((turn - 1) // 2) % 4 + 1] END
        END AS name
    FROM roles
)
SELECT conv_id, turn, call_id, kind, turn AS place, 0 AS level,
    CASE kind WHEN 'call' THEN coalesce(next_turn = turn + 1 AND next_role = 'assistant', false)
        WHEN 'result' THEN coalesce(goes_on, false) ELSE false END AS linked,
    CASE WHEN kind = 'call' THEN CASE name WHEN 'lookup' THEN 'unexpected limit'
        WHEN 'forecast' THEN 'missing unit' WHEN 'weather' THEN 'type of limit' END END AS problem,
    '{' || CASE WHEN kind = 'call'
        THEN '"arguments":{"limit":' || (length(text) % 10) || ',"query":' || to_json(text)::VARCHAR || '},' ELSE '' END
    || '"content":' || to_json(text)::VARCHAR
    || CASE WHEN kind <> 'text' THEN ',"id":"' || call_id || '","name":' || coalesce('"' || name || '"', 'null') ELSE '' END
    || ',"role":"' || role || '"}' AS json
FROM named
"""


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations read as tool use: a user's turn calls a tool with its text and uses
    the result before it, an assistant's turn is the result of the call before it."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    call_id = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    turn = F.col("turn")
    name = F.element_at(F.array(*map(F.lit, TOOLS)), (F.floor(turn / 2) % 4 + 1).cast("int"))
    # Neither compact nor in order, for the operator to mend.
    arguments = F.concat(
        F.lit('{ "query": '),
        chat_format.quoted(F.col("text")),
        F.lit(', "limit": '),
        (F.length("text") % 10).cast("string"),
        F.lit(" }"),
    )
    return conversations.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(user, "call").when(assistant, "result").alias("kind"),
        F.when(user, call_id(turn)).when(assistant, call_id(turn - 1)).alias("call_id"),
        F.when(user, name).alias("name"),
        F.when(user, arguments).alias("arguments"),
        F.when(user, F.array(call_id(turn - 2))).alias("after"),
    )


@query("op6_chat_format", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    schemas = spark.createDataFrame(TOOL_SCHEMAS, "name string, field string, kind string, required boolean")
    return chat_format.format_chats(tool_messages(table(spark, folder, "conversations")), schemas)



@query("op11_quality_classifier")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = crc_of_id(F.col("doc_id")) % 5 == 0
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_crf.train(docs, labels.where(~held_out))
    scored = quality_crf.score(docs, model)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


OP12_SQL = r"""
WITH RECURSIVE given AS (
    SELECT doc_id, lang,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
        || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') AS before,
        n_chars,
        coalesce(strlen(text) || ':' || text, '-') AS behind,
        -- CRC-32, bit by bit: a byte goes in, then eight shifts (-1).
        xor(4294967295, list_reduce(
            flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''),
                lambda c: CASE WHEN c = '' THEN []::BIGINT[] ELSE
                    [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] END)),
            lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
                WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END,
            4294967295::BIGINT)) % 7 = 0 AS touched
    FROM documents
), leaves AS (
    SELECT doc_id, lang,
        sha256(before || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || behind) AS leaf,
        CASE WHEN touched THEN sha256(before
            || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || behind) END AS other
    FROM given
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
    FROM leaves
), nodes(lang, level, place, digest, n) AS (
    SELECT lang, 0, place, leaf, count(*) OVER (PARTITION BY lang) FROM numbered
    UNION ALL
    SELECT lang, any_value(level) + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)),
        any_value((n + 1) // 2)
    FROM nodes WHERE n > 1 GROUP BY lang, place // 2
), subroots AS (
    SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place,
        count(*) OVER () AS n
    FROM nodes WHERE n = 1
), upper_nodes(level, place, digest, n) AS (
    SELECT 0, place, subroot, n FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)),
        any_value((n + 1) // 2)
    FROM upper_nodes WHERE n > 1 GROUP BY place // 2
), steps AS (
    SELECT x.lang, x.place AS leaf_place, x.level, s.digest AS sibling, (x.own % 2 = 1) AS is_left
    FROM (SELECT d.lang, d.place, v.level, d.place // (1 << v.level)::BIGINT AS own
          FROM numbered d JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) v
            ON d.lang IS NOT DISTINCT FROM v.lang) x
    LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM x.lang AND s.level = x.level
        AND s.place = xor(x.own, 1)
    UNION ALL
    SELECT d.lang, d.place, 1000 + v.level, s.digest, (r.place // (1 << v.level)::BIGINT) % 2 = 1
    FROM numbered d JOIN subroots r ON d.lang IS NOT DISTINCT FROM r.lang
    CROSS JOIN (SELECT DISTINCT level FROM upper_nodes WHERE n > 1) v
    LEFT JOIN upper_nodes s ON s.level = v.level AND s.place = xor(r.place // (1 << v.level)::BIGINT, 1)
), paths AS (
    SELECT lang, leaf_place, count(*) AS height,
        sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256,
        list(sibling ORDER BY level) AS siblings, list(is_left ORDER BY level) AS sides
    FROM steps GROUP BY lang, leaf_place
), folds(lang, place, taken, digest) AS (
    SELECT lang, place, 0, coalesce(other, leaf) FROM numbered
    UNION ALL
    SELECT f.lang, f.place, f.taken + 1, sha256(CASE WHEN p.siblings[f.taken + 1] IS NULL THEN f.digest
        WHEN p.sides[f.taken + 1] THEN p.siblings[f.taken + 1] || f.digest
        ELSE f.digest || p.siblings[f.taken + 1] END)
    FROM folds f JOIN paths p ON p.lang IS NOT DISTINCT FROM f.lang AND p.leaf_place = f.place
    WHERE f.taken < p.height
)
SELECT d.doc_id, d.leaf, r.subroot, u.digest AS root,
    coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root,
    f.digest = u.digest AS verified
FROM numbered d
JOIN subroots r ON r.lang IS NOT DISTINCT FROM d.lang
JOIN (SELECT digest FROM upper_nodes WHERE n = 1) u ON true
LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM d.lang AND p.leaf_place = d.place
JOIN folds f ON f.lang IS NOT DISTINCT FROM d.lang AND f.place = d.place AND f.taken = coalesce(p.height, 0)
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    leaves = merkle_manifest.document_leaves(docs, crc_of_id(F.col("doc_id")) % 7 == 0)
    return merkle_manifest.manifest(leaves).drop("grp")


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth repeats from some word on, as their ids' hashes say."""
    key = crc_of_id(F.col("doc_id"))
    chosen = docs.select("doc_id", "text", key.alias("_key")).withColumn(
        "_words",
        F.when(
            F.col("_key") % 10 == 0,
            F.filter(
                F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != F.lit("")
            ),
        ),
    )
    n, g = F.size("_words").cast("long"), F.floor(F.col("_key") / 10)
    begun = chosen.withColumn("_n", n).withColumn("_first", F.when(F.col("_n") > 0, g % F.col("_n")))
    period = 1 + F.floor((F.col("_n") - F.col("_first")) / (3 + g % 8))
    places = begun.withColumn("_period", period).withColumn(
        "_places", F.when(F.col("_n") > 0, F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    )
    first = F.col("_first")
    source = lambda i: F.when(i < first, i).otherwise(first + (i - first) % F.col("_period"))
    changed = F.array_join(
        F.transform("_places", lambda i: F.element_at("_words", (source(i) + 1).cast("int"))), " "
    )
    return places.select("doc_id", F.coalesce(changed, "text").alias("text"))


def _stronger(a: Column, b: Column) -> Column:
    """Order of runs: more periods first, then by start and period."""
    mine, other = a["length"] * b["period"], b["length"] * a["period"]
    before = (mine > other) | (
        (mine == other)
        & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"])))
    )
    return F.when(before, F.lit(-1)).otherwise(F.lit(1))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_periods(table(spark, folder, "documents")))
    best = found.withColumn("best", F.get(F.array_sort("runs", _stronger), F.lit(0)))
    milli = 1000 * F.col("best.length")
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        ((milli - milli % F.col("best.period")) / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
