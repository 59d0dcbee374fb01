"""The queries opN_<name> and their SQL: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import arc, decontamination, exact_dedup, langid, packing, prefix_trie, repair, setsketch, sharding, simhash, token_counts, token_store, toxicity


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file; it is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return token_store.read_store(spark, store)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = arc.read_archives(spark, *arc.write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("node")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))
    lines = F.transform("repaired", lambda t: F.concat(t.role, F.lit(":"), t.text))
    return found.withColumn("repaired_sha256", F.sha2(F.coalesce(F.array_join(lines, "\n"), F.lit("")), 256)).drop("repaired")


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on op3's result: what must hold of it whatever the hash is."""
    rows = op3_sharding(spark, sf_dir)
    shards = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), (F.max("slot") + 1).alias("end"), F.sum("slot").alias("places"))
    gapless = (F.col("n") == F.col("end")) & (F.col("places") * 2 == F.col("n") * (F.col("n") - 1))
    near = F.max("bytes") - F.min("bytes") <= F.lit(0.01) * F.avg("bytes")
    return shards.agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.count("*").alias("shards"), F.bool_and(gapless).alias("gapless"), near.alias("near_equal"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_store": op2_token_store,
    "op3_sharding": op3_sharding,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_langid": op10_langid,
    "op11_setsketch": op11_setsketch,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_repair": op13_repair,
    "sharding_law": sharding_law,
}


def _crc32(s: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII string, a bit at a time."""
    codes = f"list_transform(range(len({s})), lambda i: CAST(ascii(substr({s}, CAST(i + 1 AS INT), 1)) AS BIGINT))"
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {byte}), 4294967295)"


ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "sharding_law": "SELECT count(*) AS rows, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, CAST(8 AS BIGINT) AS shards, true AS gapless, true AS near_equal FROM documents",
    # pairs of distinct sets by the shingles that they share, then the least doc_id that is reachable
    "op11_setsketch": """
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM words),
        named AS (SELECT doc_id, len(s) AS n, s, CASE WHEN len(s) > 0 THEN sha256(array_to_string(s, chr(10))) END AS name FROM sets),
        nodes AS (SELECT name, min(doc_id) AS node, any_value(n) AS n, any_value(s) AS s FROM named WHERE name IS NOT NULL GROUP BY name),
        flat AS (SELECT node, n, hash(unnest(s)) AS x FROM nodes),
        links AS (
          SELECT a.node AS u, b.node AS v FROM flat a JOIN flat b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
          GROUP BY u, v, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
        reach(u, v) AS (SELECT node, node FROM nodes UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON b.u = r.v),
        roots AS (SELECT u AS node, min(v) AS root FROM reach GROUP BY u)
        SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, d.doc_id = coalesce(r.root, d.doc_id) AS kept
        FROM named d LEFT JOIN nodes n ON n.name = d.name LEFT JOIN roots r ON r.node = n.node
    """,
    # a prefix's key is the chain of its turns' digests; a leaf and what a node saves count at every prefix of the node's least conversation
    "op12_prefix_trie": f"""
        WITH turns AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
          FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT conv_id, conv_id - conv_id % 20 AS lender, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
        rebuilt AS (
          SELECT c.conv_id, t.role, t.text, 0 AS own, t.k FROM convs c JOIN turns t ON t.conv_id = c.lender AND t.k <= c.h
          UNION ALL SELECT c.conv_id, t.role, t.text, 1, t.k FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h),
        placed AS (
          SELECT conv_id, row_number() OVER w AS depth, sha256(len(role) || ':' || role || text) AS token,
                 len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
          FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, k)),
        prefixes AS (
          SELECT conv_id, depth, words, sha256(string_agg(token, '' ) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS node FROM placed
          UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
        whole AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM prefixes),
        nodes AS (
          SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
          FROM whole GROUP BY node),
        children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
        sums AS (
          SELECT p.node, count(*) FILTER (c.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
          FROM nodes n LEFT JOIN children c USING (node) JOIN whole p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node)
        SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM nodes n JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN nodes up ON up.node = n.parent
    """,
    # row by row, the least (cost, audit) of each last initial; at most two turns are inserted after a row
    "op13_repair": f"""
        WITH RECURSIVE hurt AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations),
        damaged AS (
          SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                 CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
          FROM hurt, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
        judged AS (
          SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                   WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
                 lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS last FROM ordered),
        counts AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
                 count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) AS n,
                 count(*) FILTER (i > 1 AND last || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
        moves(a, letter, b) AS (VALUES ('', 'K', 's'), ('', 'K', 'u'), ('s', 'K', 'u'), ('u', 'K', 'a'), ('a', 'K', 'u'), ('', 'R', 'u'), ('s', 'R', 'u'), ('u', 'R', 'a'),
          ('a', 'R', 'u'), ('', 'D', ''), ('s', 'D', 's'), ('u', 'D', 'u'), ('a', 'D', 'a')),
        inserts(a, b, k) AS (VALUES ('', '', 0), ('s', 's', 0), ('u', 'u', 0), ('a', 'a', 0), ('', 'u', 1), ('', 'a', 2), ('s', 'u', 1), ('s', 'a', 2), ('u', 'a', 1), ('a', 'u', 1)),
        best(conv_id, i, last, way) AS (
          SELECT conv_id, CAST(0 AS BIGINT), b, {{'cost': CAST(5 * k AS BIGINT), 'audit': repeat('I', k)}} FROM counts, inserts WHERE a = ''
          UNION ALL
          SELECT s.conv_id, s.i + 1, n.b,
                 min({{'cost': CAST(s.way.cost + CASE m.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN r.fault = 3 AND m.letter <> 'D' THEN 5 ELSE 0 END + 5 * n.k AS BIGINT),
                      'audit': s.way.audit || m.letter || repeat('I', n.k)}})
          FROM best s JOIN judged r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1 JOIN moves m ON m.a = s.last JOIN inserts n ON n.a = m.b
          WHERE m.letter = 'D' OR (r.fault NOT IN (1, 2) AND (m.letter = 'R' OR r.initial = m.b))
          GROUP BY s.conv_id, s.i, n.b),
        chosen AS (SELECT c.*, w.way FROM counts c JOIN (SELECT conv_id, i, min(way) AS way FROM best WHERE last IN ('', 'a') GROUP BY ALL) w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n),
        letters AS (SELECT conv_id, p, substr(way.audit, CAST(p AS INT), 1) AS letter FROM chosen, range(1, len(way.audit) + 1) t(p)),
        read AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM letters),
        turned AS (
          SELECT x.conv_id, x.p, x.letter, row_number() OVER (PARTITION BY x.conv_id ORDER BY x.p) AS q, r.role, CASE WHEN x.letter = 'I' THEN '' ELSE r.text END AS text
          FROM read x LEFT JOIN judged r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = x.i WHERE x.letter <> 'D'),
        spoken AS (
          SELECT *, CASE WHEN letter = 'K' THEN role
            WHEN (q - CASE WHEN first_value(letter = 'K' AND role[1] = 's') OVER (PARTITION BY conv_id ORDER BY q) THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END AS speaker FROM turned),
        digests AS (SELECT conv_id, sha256(string_agg(speaker || ':' || text, chr(10) ORDER BY q)) AS repaired_sha256 FROM spoken GROUP BY conv_id)
        SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(c.way.cost, 0) AS cost, coalesce(c.way.audit, '') AS audit, coalesce(g.repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN digests g ON g.conv_id IS NOT DISTINCT FROM d.conv_id
    """,
    # five hexadecimal digits are four of base32
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
        FROM p WINDOW w AS (PARTITION BY html)
    """,
}
