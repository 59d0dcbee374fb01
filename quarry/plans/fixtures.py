"""Views that give the test tables the shape of a repository's tables; one text serves Spark and, for the checks, DuckDB.

{name} stands for a base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "v_files": """
        SELECT doc_id AS file_id, source AS repo,
          concat(
            CASE WHEN doc_id % 17 = 0 THEN 'web/node_modules/' WHEN doc_id % 13 = 0 THEN 'src/Build/'
                 WHEN doc_id % 11 = 0 THEN '' ELSE concat('src/', source, '/') END,
            CASE WHEN doc_id % 7 = 0 THEN 'service_' WHEN doc_id % 5 = 0 THEN 'config_' ELSE 'file_' END,
            CAST(doc_id AS STRING),
            CASE WHEN doc_id % 19 = 0 THEN '.min.js' WHEN doc_id % 23 = 0 THEN '.md' WHEN doc_id % 29 = 0 THEN ''
                 WHEN lang = 'en' THEN '.py' WHEN lang = 'fr' THEN '.js' WHEN lang = 'de' THEN '.go' ELSE '.TS' END) AS path,
          n_chars * CASE WHEN doc_id % 31 = 0 THEN 1000 ELSE 1 END AS size_bytes,
          text AS content
        FROM {documents}""",
    "v_edges": """
        SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst
        FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        WHERE a.l_partkey <> b.l_partkey""",
    "v_nodes": """
        SELECT p_partkey AS id, p_name AS name, p_brand AS file, p_type AS layer, p_size AS complexity FROM {part}""",
    "v_turns": """
        SELECT conv_id, turn, text AS question, answer FROM (
          SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer,
                 lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM {conversations}) x
        WHERE role = 'user' AND next_role = 'assistant'""",
    "v_jobs": """
        SELECT event_id AS job_id,
          CASE event_id % 5 WHEN 0 THEN 'ingest' WHEN 1 THEN 'parse' WHEN 2 THEN 'chunk' WHEN 3 THEN 'diagram' ELSE 'story' END AS phase,
          concat('owner__repo', CAST(user_id AS STRING)) AS repo_key,
          CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'view' THEN 'running'
                          WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS status,
          CAST(floor(value) AS INT) - 50 AS raw_progress, ts AS created_at
        FROM {events}""",
    # a small repository for each document, # being its number
    "m_functions": """
        SELECT replace(file_path, '#', CAST(doc_id AS STRING)) AS file_path, replace(name, '#', CAST(doc_id AS STRING)) AS name,
               replace(qualified_name, '#', CAST(doc_id AS STRING)) AS qualified_name, replace(call_list, '#', CAST(doc_id AS STRING)) AS call_list
        FROM (SELECT doc_id FROM {documents}) d CROSS JOIN (VALUES
          ('main#.py', 'main#', 'main#', 'print,load#,process,helper#'),
          ('services#/user#.py', 'process', 'UserService#.process', 'find#,helper#'),
          ('services#/order#.py', 'process', 'OrderService#.process', 'find#'),
          ('repo#/store#.py', 'find#', 'UserRepo#.find#', 'open'),
          ('utils#.py', 'helper#', 'helper#', ''),
          ('utils#.py', 'load#', 'load#', 'helper#'),
          ('utils#.py', 'unused', 'unused', '')) AS t(file_path, name, qualified_name, call_list)""",
    "m_imports": """
        SELECT replace(file_path, '#', CAST(doc_id AS STRING)) AS file_path, replace(module, '#', CAST(doc_id AS STRING)) AS module, language,
               replace(items, '#', CAST(doc_id AS STRING)) AS items
        FROM (SELECT doc_id FROM {documents}) d CROSS JOIN (VALUES
          ('main#.py', './utils#', 'Python', 'load#'),
          ('main#.py', 'requests', 'Python', ''),
          ('main#.py', 'os.path', 'Python', ''),
          ('main#.py', 'services#.user#', 'Python', ''),
          ('services#/user#.py', '..repo#/store#', 'Python', 'find#'),
          ('services#/order#.py', 'store#', 'Python', ''),
          ('services#/order#.py', 'requests', 'Python', 'helper#'),
          ('web#/a#.js', './b#', 'JavaScript', ''),
          ('web#/b#.js', './a#', 'JavaScript', ''),
          ('web#/a#.js', '@scope/kit', 'JavaScript', ''),
          ('web#/a#.js', 'fs', 'JavaScript', ''),
          ('cmd#/x#.go', 'fmt', 'Go', ''),
          ('cmd#/x#.go', 'github.com/a/b', 'Go', ''),
          ('lib#.rs', 'crate::m#', 'Rust', ''),
          ('App#.java', 'com.acme.Tool', 'Java', '')) AS t(file_path, module, language, items)""",
    "m_paths": """
        SELECT replace(path, '#', CAST(doc_id AS STRING)) AS path
        FROM (SELECT doc_id FROM {documents}) d CROSS JOIN (VALUES
          ('main#.py'), ('services#/user#.py'), ('services#/order#.py'), ('repo#/store#.py'), ('utils#.py'),
          ('web#/a#.js'), ('web#/b#.js'), ('cmd#/x#.go'), ('lib#.rs'), ('App#.java')) AS t(path)""",
}
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    return spark.sql(text, **{b: table(spark, sf_dir, b) for b in BASE if f"{{{b}}}" in text})


def ddb(*names: str) -> str:
    """The views as DuckDB's WITH list."""
    return ",\n".join(f"{n} AS ({VIEWS[n].format(**{b: b for b in BASE}).replace('STRING', 'VARCHAR')})" for n in names)


def each_document(rows: str, *columns: str) -> str:
    """DuckDB SQL of these rows for each document, # being its number."""
    shown = ", ".join(f"replace({c}, '#', CAST(doc_id AS VARCHAR)) AS {c}" for c in columns)
    return f"SELECT {shown} FROM documents, (VALUES {rows}) AS t({', '.join(columns)})"


def planted(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """doc_id and these rows for each document, # in their texts being its number: what each_document() states in SQL."""
    made = table(spark, sf_dir, "documents").select("doc_id").crossJoin(F.broadcast(spark.createDataFrame(rows, schema)))
    filled = lambda x: F.replace(x, F.lit("#"), F.col("doc_id").cast("string"))
    kinds = {"string": lambda c: filled(F.col(c)), "array<string>": lambda c: F.transform(c, filled)}
    return made.select("doc_id", *[kinds[kind](c).alias(c) if kind in kinds else c for c, kind in made.dtypes[1:]])


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
