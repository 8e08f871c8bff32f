"""The p1 and p3 queries: state of a change feed, and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.operators.changes import apply_changes, live
from lexoria.operators.hierarchy import descendants, hierarchy
from lexoria.plans.runtime import publish, read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live annotations: the change in force for each user and word, where that is no tombstone."""
    return live(apply_changes(read(spark, sf_dir, "annotations"))).select("user_id", "word", "seq")


def p1_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole state with tombstones and the marks themselves; tags joined by '|'."""
    a = read(spark, sf_dir, "annotations").withColumn("tags", F.array_join("tags", "|"))
    state = apply_changes(a, payload=("bookmarked", "note", "tags"))
    return state.select(
        "user_id", "word", "seq", "deleted", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"), "bookmarked"
    )


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, t = read(spark, sf_dir, "meanings", "tag")
    return m.select(
        F.lit("meanings").alias("space"), F.col("meaning_id").alias("node"), F.col("parent_id").alias("parent"),
        F.col("tree_id").alias("scope"), F.col("breadcrumb").alias("crumb"), F.col("mod_date").alias("version"),
    ).unionByName(
        t.select(
            F.lit("tag").alias("space"), F.col("id").alias("node"), F.col("parentId").alias("parent"),
            F.lit(0).cast("long").alias("scope"), F.lit(None).cast("string").alias("crumb"), F.col("modDate").alias("version"),
        )
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of both tables with root, path and state."""
    state = (
        F.when(F.col("root") == 0, "cycle")
        .when((F.col("marks") > 0) & (F.col("marks") != F.col("depth")), "crumb")
        .otherwise("ok")
    )
    return hierarchy(_nodes(spark, sf_dir), below=False).select(
        F.col("space").alias("table_name"), F.col("node").alias("node_id"), F.col("root").alias("root_id"),
        F.col("path").alias("node_path"), state.alias("state"),
    )


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a node and a node below it, with their distance."""
    got = descendants(publish(hierarchy(_nodes(spark, sf_dir), below=False), "tree"))
    return got.withColumnsRenamed({"space": "table_name", "node": "node_id", "descendant": "descendant_id"})


def p3_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes on or under a cycle, and the link that closes each cycle."""
    return (
        hierarchy(_nodes(spark, sf_dir), below=False).where("root = 0")
        .select(F.col("space").alias("table_name"), F.col("node").alias("node_id"), "on_cycle", "back_edge")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_state, p3_found, p3_descendants, p3_cycles)}

_EDGES = """
with recursive n as (
  select 'meanings' as table_name, meaning_id as node_id, coalesce(arg_max(parent_id, mod_date), 0) as parent,
         any_value(tree_id) as scope, arg_max(coalesce(breadcrumb, ''), coalesce(mod_date, -1)) as crumb
  from meanings group by meaning_id
  union all
  select 'tag', id, coalesce(arg_max(parentId, modDate), 0), 0, '' from tag group by id),
e as (
  select c.table_name, c.node_id, c.crumb, p.node_id as par
  from n c left join n p on p.table_name = c.table_name and p.node_id = c.parent and p.scope = c.scope),
r as (
  select table_name, node_id, node_id as root_id, cast(node_id as varchar) as node_path, 1 as depth, crumb from e where par is null
  union all
  select e.table_name, e.node_id, r.root_id, r.node_path || '/' || e.node_id, r.depth + 1, e.crumb
  from e join r on e.table_name = r.table_name and e.par = r.node_id)
"""

_STATE = """
from (select *, row_number() over (partition by user_id, word order by updated_at desc, seq, deleted desc) as k
      from annotations where word is not null and updated_at is not null and user_id is not null) where k = 1"""

ORACLES = {
    "p1_found": f"select user_id, word, seq {_STATE} and deleted = 0",
    "p1_state": f"select user_id, word, seq, deleted, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') as updated_at, bookmarked {_STATE}",
    "p3_found": _EDGES
    + """
select e.table_name, e.node_id, coalesce(r.root_id, 0) as root_id, coalesce(r.node_path, '') as node_path,
  case when r.root_id is null then 'cycle'
       when len(regexp_extract_all(e.crumb, '[0-9]+')) > 0 and len(regexp_extract_all(e.crumb, '[0-9]+')) <> r.depth then 'crumb'
       else 'ok' end as state
from e left join r on e.table_name = r.table_name and e.node_id = r.node_id""",
    "p3_descendants": _EDGES
    + """, d as (select table_name, node_id as descendant_id, depth, unnest(string_split(node_path, '/')) as a,
       generate_subscripts(string_split(node_path, '/'), 1) as pos from r)
select table_name, cast(a as bigint) as node_id, descendant_id, cast(depth - pos as int) as distance from d where pos < depth""",
    "p3_cycles": _EDGES
    + """, c as (select e.table_name, e.node_id, e.par from e left join r on e.table_name = r.table_name and e.node_id = r.node_id where r.node_id is null),
w as (select table_name, node_id as s, par as up from c union select w.table_name, w.s, c.par from w join c on c.table_name = w.table_name and c.node_id = w.up)
select table_name, s as node_id, bool_or(up = s) as on_cycle, bool_or(up = s) and min(up) = s as back_edge from w group by table_name, s""",
}
