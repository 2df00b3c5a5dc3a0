"""The driver's tables as the engine's logical tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DRAWERS = """
select 'team-' || cast(doc_id % 2 as string) as team_id, sha2(concat('team-', cast(doc_id % 2 as string), chr(0), 'w', lpad(cast(cast(floor(doc_id / 50.0) as int) as string), 3, '0'), chr(0),
    case when doc_id % 10 = 0 then 'general' else concat('r', lpad(cast(cast(floor(doc_id / 35.0) as int) as string), 3, '0')) end, chr(0), 'src/doc-', cast(doc_id as string), '.md', chr(0), '0', chr(0), text, chr(0)), 256) as id,
    concat('w', lpad(cast(cast(floor(doc_id / 50.0) as int) as string), 3, '0')) as wing,
    case when doc_id % 10 = 0 then 'general' else concat('r', lpad(cast(cast(floor(doc_id / 35.0) as int) as string), 3, '0')) end as room,
    concat('src/doc-', cast(doc_id as string), '.md') as source_file, 0 as chunk_index, text as content,
    concat('2024-01-', lpad(cast(1 + doc_id % 28 as string), 2, '0'), 'T00:00:', lpad(cast(doc_id % 60 as string), 2, '0'), 'Z') as filed_at,
    case when doc_id % 3 = 0 then '' else concat('2023-', lpad(cast(1 + doc_id % 12 as string), 2, '0'), '-15') end as content_date, doc_id
from documents"""
JOURNAL = """
select role as agent, concat('wing_', cast(conv_id % 5 as string)) as wing, 'diary' as room, 'general' as topic, text as content,
    concat('2024-02-', lpad(cast(1 + conv_id % 28 as string), 2, '0'), 'T00:', lpad(cast(turn as string), 2, '0'), ':00.', lpad(cast(conv_id as string), 9, '0'), 'Z') as filed_at,
    concat(cast(conv_id as string), '-', cast(turn as string)) as id
from conversations"""
FACTS = """
select concat('t_', cast(event_id as string)) as id, concat('user_', cast(user_id as string)) as subject, event_type as predicate, concat('k_', regexp_extract(props, '([0-9]+)', 1)) as object,
    cast(cast(ts as date) as string) as valid_from,
    coalesce(cast(cast(lead(ts) over (partition by user_id, event_type order by ts, event_id) as date) as string), '') as valid_to
from events"""
REQUESTS = """
select concat('team-', cast(user_id as string)) as team_id, substr(cast(cast(ts as date) as string), 1, 7) as period, cast(ts as string) as moment, event_id from events"""
VECTORS = """
select d.team_id as namespace, d.id as id, e.embedding as vec, d.doc_id from drawers d join embeddings e on d.doc_id = e.vec_id"""
VIEWS = {"drawers": DRAWERS, "journal": JOURNAL, "facts": FACTS, "requests": REQUESTS, "vectors": VECTORS}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One logical table."""
    needs = {"drawers": ["documents"], "journal": ["conversations"], "facts": ["events"], "requests": ["events"], "vectors": ["embeddings"]}[name]
    frames = {t: read(spark, sf_dir, t) for t in needs}
    if name == "vectors":
        frames["drawers"] = view(spark, sf_dir, "drawers")
    text = VIEWS[name]
    for t in frames:
        text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(text, **frames)


def with_views(sql: str, *names: str) -> str:
    """DuckDB text with the named views before it."""
    order = [n for n in VIEWS if n in names or (n == "drawers" and "vectors" in names)]
    ctes = ", ".join(f"{n} as ({_duck(VIEWS[n])})" for n in order)
    return f"with recursive {ctes}, {sql[5:]}" if sql.startswith("with ") else f"with recursive {ctes} {sql}"


def _duck(text: str) -> str:


    return re.sub(r"sha2\((.*), 256\) as id", r"sha256(\1) as id", text, flags=re.S)
