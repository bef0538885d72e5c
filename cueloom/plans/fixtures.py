"""Cue, attempt, segment, take, file and event tables derived from the given tables, for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "conversations", "orders", "lineitem", "events")

_CUES = """l AS ({lines}),
n AS (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY ln) - 1 AS BIGINT) AS pos, {trim} AS text FROM l WHERE {trim} <> ''),
d AS (SELECT *, 400000 + 60000 * least(length(text), 200) AS dur, ((video_id * 31 + pos * 17) % 7) * 50000 AS gap FROM n),
e AS (SELECT *, CAST(sum(dur + gap) OVER (PARTITION BY video_id ORDER BY pos) AS BIGINT) AS end_us FROM d),
cues AS (SELECT video_id, pos AS cue_id, pos, CAST(end_us - dur AS BIGINT) AS start_us, end_us, text FROM e)"""
SPARK = {
    "cues": _CUES.format(lines=r"SELECT doc_id AS video_id, ln, line FROM documents LATERAL VIEW posexplode(split(text, '\n')) t AS ln, line", trim="trim(line)"),
    "files": """files AS (SELECT dir, concat(v + 1, '. Topic ', v) AS stem,
  CASE r WHEN 0 THEN concat(v + 1, '. Topic ', v, '.srt') WHEN 1 THEN concat(v + 1, '. Topic ', v, '.', lang, '.vtt') ELSE concat('Topic ', v, '_', lang, '.ass') END AS filename,
  CASE r WHEN 0 THEN '.srt' WHEN 1 THEN '.vtt' ELSE '.ass' END AS ext, CASE r WHEN 2 THEN concat('[Events]', chr(10), 'Format: Start, End, Text', chr(10), 'Dialogue: 0:00:01.00,0:00:02.00,', replace(text, chr(10), concat(chr(10), 'Dialogue: 0:00:01.00,0:00:02.00,'))) ELSE text END AS content
  FROM (SELECT concat('src', CAST(doc_id % 20 AS STRING)) AS dir, (doc_id div 20) div 3 AS v, (doc_id div 20) % 3 AS r, lang, text FROM documents))""",
}
DUCK = {
    "cues": _CUES.format(lines="SELECT doc_id AS video_id, generate_subscripts(string_split(text, chr(10)), 1) AS ln, unnest(string_split(text, chr(10))) AS line FROM documents", trim="trim(line, ' ')"),
    "files": SPARK["files"].replace(" div ", " // ").replace("STRING", "VARCHAR"),
}
_BOTH = {
    "attempts": """s AS (SELECT conv_id AS video_id, turn AS segment_id, text AS src, (conv_id * 3 + turn) AS k,
  CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 15) AS BIGINT) AS batch_no,
  translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '的一是在不了有和人这中大为上个国我以要他时来用们生到') AS zh FROM conversations),
a AS (SELECT s.*, CAST(t.attempt_no AS BIGINT) AS attempt_no FROM s CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS t(attempt_no)),
attempts AS (SELECT video_id, segment_id, batch_no, attempt_no, src,
  CASE WHEN attempt_no = 1 THEN CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN src ELSE zh END
       WHEN attempt_no = 2 THEN CASE WHEN k % 5 = 0 THEN src ELSE substring(zh, 1, 20) END
       WHEN attempt_no = 3 THEN CASE WHEN k % 7 = 0 THEN concat('Well ', src) ELSE zh END
       ELSE CASE WHEN k % 14 = 0 THEN src ELSE zh END END AS raw
FROM a)""",
    "segments": """o AS (SELECT o_orderkey % 50 AS video_id, o_orderkey AS segment_id, 1000000 + (o_orderkey % 30) * 100000 AS window_us FROM orders),
c AS (SELECT *, CAST(sum(window_us + 50000) OVER (PARTITION BY video_id ORDER BY segment_id) AS BIGINT) AS e FROM o),
segments AS (SELECT video_id, segment_id, CAST(e - window_us - 50000 AS BIGINT) AS start_us, CAST(e - 50000 AS BIGINT) AS deadline_us, CAST(window_us AS BIGINT) AS window_us FROM c)""",
    "takes": """takes AS (SELECT l_orderkey % 50 AS video_id, l_orderkey AS segment_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS attempt_no,
  CAST(l_quantity * 100000 AS BIGINT) AS duration_us FROM lineitem)""",
    "task_events": """task_events AS (SELECT user_id AS task_id, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'translating' WHEN 'purchase' THEN 'synthesizing' WHEN 'signup' THEN 'completed' ELSE 'error' END AS status,
  CAST(least(100, floor(value)) AS BIGINT) AS progress, props AS detail FROM events)""",
}
SPARK |= _BOTH
DUCK |= _BOTH
GLOSSARY = [(1, "the", "这"), (2, "and", "与"), (3, "of", "之"), (4, "x", "单"), (5, "tion", "化"), (6, " an ", "一")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture over the tables at sf_dir."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in SPARK[name]}
    query = SPARK[name].replace("{", "{{").replace("}", "}}")
    for t in used:
        query = query.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(f"WITH {query} SELECT * FROM {name}", **used)


def with_sql(names: list[str], body: str, recursive: bool = False) -> str:
    """DuckDB SQL with the named fixtures in front of body, which may begin with more common tables."""
    if not names:
        return body
    front = ",\n".join(DUCK[n] for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{front}{',' if not body.lstrip().upper().startswith('SELECT') else ''}\n{body}"
