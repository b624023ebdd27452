"""The queries of the thirteen operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.llm import (
    chat,
    decontamination,
    hnsw,
    jaccard_join,
    language_id,
    packing,
    quality,
    resampling,
    sharding,
    substring_dedup,
    token_counts,
    url_filters,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fold(n: int) -> Column:
    """The fold of a document: the checksum of its id as text, modulo ``n``; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


@query
def op1_token_counts(spark, d):
    """Tokens of every line of every document."""
    return token_counts.count_tokens(table(spark, d, "documents"))


@query
def op2_language_id(spark, d):
    """Language of every document, learned from three folds of four."""
    docs = table(spark, d, "documents")
    model = language_id.train(docs.where(fold(4) != 2))
    return language_id.predict(docs, model, keep=["doc_id", (fold(4) == 2).alias("held_out")])


@query
def op3_jaccard_join(spark, d):
    """Class of near duplicates of every document, with its number of links."""
    return jaccard_join.join_similar(table(spark, d, "documents"))


@query
def op4_nearest(spark, d):
    """The 20 nearest other vectors of every twentieth vector."""
    return hnsw.nearest(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op5_chat(spark, d):
    """All conversations in the turn template, and one whose texts are full of control strings.

    Prefixes of one earlier turn are compared at every turn, whole ones at turns 1, 2, 4, 8, ... and the last.
    """
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], rows.schema)
    return chat.digest_turns(chat.format_turns(rows.unionByName(hard), context="doubling"))


@query
def op6_packing(spark, d):
    """All documents in sequences of 1024 tokens."""
    return packing.pack(table(spark, d, "documents"), capacity=1024, end_id=2)


def list_history(captures: DataFrame) -> DataFrame:
    """Dated entries drawn from the captures themselves: hosts, domains and directories go on and off lists."""
    url = F.col("url")
    host = url_filters.host_of(url)
    directory = F.regexp_extract(url_filters.path_of(url), "^(/[^/]+)", 1)
    kinds = {
        "hosts": (F.concat(F.lit("host:"), host), 3, 0),
        "domains": (F.concat(F.lit("domain:"), F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)), 5, 1),
        "paths": (F.concat(F.lit("prefix:"), host, directory), 4, 2),
    }
    every = F.array(*(F.struct(F.lit(name).alias("list"), key.alias("key"), F.lit(m).alias("m"), F.lit(r).alias("r")) for name, (key, m, r) in kinds.items()))
    firsts = captures.where(host != "").select("page_id", F.inline(every)).groupBy("list", "key", "m", "r").agg(F.min("page_id").alias("p"))
    day = (F.col("p") * 31) % 600
    steps = [(day, True), (day + 50 + F.col("p") % 100, False), (day + 200, True)]
    events = F.array(*(F.struct(when.alias("day"), F.lit(on).alias("active")) for when, on in steps))
    return firsts.where("p % m = r").select("list", "key", F.inline(events))


@query
def op7_url_filters(spark, d):
    """Every page against the list entries that were active on the day of its fetch."""
    captures = table(spark, d, "pages").select("page_id", "url", ((F.col("page_id") * 7919) % 730).alias("day"))
    return url_filters.filter_urls(captures, url_filters.validity(list_history(captures))).drop("url")


SQL["op7_url_filters"] = r"""
WITH c AS (
    SELECT page_id, url, (page_id * 7919) % 730 AS day,
           regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1) AS host,
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
    FROM pages
), f AS (
    SELECT 'hosts' AS list, 'host' AS kind, host AS entry, min(page_id) AS p FROM c WHERE host <> '' GROUP BY host HAVING min(page_id) % 3 = 0
    UNION ALL
    SELECT 'domains', 'domain', regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS e, min(page_id) FROM c WHERE host <> '' GROUP BY e HAVING min(page_id) % 5 = 1
    UNION ALL
    SELECT 'paths', 'prefix', host || regexp_extract(path, '^(/[^/]+)', 1) AS e, min(page_id) FROM c WHERE host <> '' GROUP BY e HAVING min(page_id) % 4 = 2
), i AS (
    SELECT list, kind, entry, (p * 31) % 600 AS a, (p * 31) % 600 + 50 + p % 100 AS b FROM f
    UNION ALL
    SELECT list, kind, entry, (p * 31) % 600 + 200, NULL FROM f
), h AS (
    SELECT page_id, list FROM c JOIN i ON a <= day AND (b IS NULL OR day < b) AND CASE kind
        WHEN 'host' THEN host = entry
        WHEN 'domain' THEN host = entry AND contains(host, '.') OR ends_with(host, '.' || entry)
        ELSE contains(entry, '/') AND (host || path = entry OR starts_with(host || path, entry || '/')) END
    WHERE host <> '' AND entry <> ''
)
SELECT c.page_id, c.day, count(h.list) > 0 AS blocked, count(h.list) AS n_entries,
       coalesce(string_agg(DISTINCT h.list, ',' ORDER BY h.list), '') AS lists
FROM c LEFT JOIN h ON c.page_id = h.page_id GROUP BY c.page_id, c.day
"""


@query
def op8_substring_dedup(spark, d):
    """Every document without the words that an earlier document has in a row."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op9_decontamination(spark, d):
    """Every document and benchmark item that it holds."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    found = decontamination.find_leaks(docs, items, keep=["doc_id"])
    return found.select("doc_id", F.inline("leaks"))


@query
def op10_quality(spark, d):
    """Quality of every document, learned from four folds of five."""
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels").where(fold(5) != 0).select("doc_id", "quality")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model, keep=["doc_id", (fold(5) == 0).alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


CRC_TABLE = """crc_table AS MATERIALIZED (
    SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
        lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs)"""
"""The 256 entries of CRC-32, for SQL."""


def sql_crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text beside ``crc_table``, in SQL."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: xor(crcs[xor(c, b) % 256 + 1], c >> 8)), 4294967295)"


@query
def op11_sharding(spark, d):
    """All documents in 16 shards of near equal bytes."""
    placed = sharding.shard(table(spark, d, "documents"), shards=16)
    crc = F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32")
    return placed.select("doc_id", "size", crc, "law", "shard", "slot", "grown_shard")


SQL["op11_sharding"] = f"""
WITH {CRC_TABLE}, d AS (
    SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size,
           ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k
    FROM documents
), o AS (
    SELECT *, sum(size) OVER (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS below FROM d
), all_bytes AS (
    SELECT sum(size) AS total FROM d
), b AS (
    SELECT s.s, arg_min(p.below, abs(p.below - total * s.s // 16) * 2 + CASE WHEN p.below > total * s.s // 16 THEN 1 ELSE 0 END) AS cut
    FROM (SELECT unnest(range(1, 16)) AS s) s, all_bytes, (SELECT below FROM o UNION ALL SELECT total FROM all_bytes) p GROUP BY s.s
), placed AS (
    SELECT *, (SELECT count(*) FROM b WHERE cut <= below) AS shard FROM o
)
SELECT doc_id, size, {sql_crc32('text')} AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY below) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM placed, crc_table
"""


@query
def op12_resampling(spark, d):
    """All documents with their weight towards the benchmark, a tenth of them drawn."""
    return resampling.resample(table(spark, d, "documents"), table(spark, d, "benchmark"), percent=10, min_words=20, buckets=10_000, seed=2024)


SQL["op12_resampling"] = rf"""
WITH {CRC_TABLE}, texts AS (
    SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), w AS (
    SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), v AS (
    SELECT word, {sql_crc32('word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), crc_table
), f AS MATERIALIZED (
    SELECT side, id, bucket, count(*) AS n FROM w JOIN v USING (word) GROUP BY ALL
), g AS (
    SELECT b.bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t
    FROM (SELECT unnest(range(0, 10000)) AS bucket) b LEFT JOIN f ON b.bucket = f.bucket GROUP BY b.bucket
), gain AS (
    SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM g
), weighed AS (
    SELECT id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
    SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
               (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM documents LEFT JOIN weighed ON id = doc_id
), ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 10 * count(*) OVER () // 100 AS k FROM scored WHERE n_features >= 20
)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN r <= k THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


@query
def op13_whitening(spark, d):
    """Every embedding on the first four whitened components."""
    rows = table(spark, d, "embeddings")
    return whitening.whiten(rows, whitening.fit_whitening(rows, components=4), components=4)
