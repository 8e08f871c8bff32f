"""Sense trees as ordered units with their citations."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexoria.functions import text as X
from lexoria.operators.rank import global_rank
from lexoria.plans.runtime import publish

SENSE, ETYMOLOGY, CITATION, COMMENT, COMPOUND, EXPRESSION = range(6)


def units(nodes: DataFrame) -> DataFrame:
    """(tree_id, meaning_id, word, text, type, ord): nodes with a text that are shown; senses in the order
    of their breadcrumb's numbers, then compounds and expressions in display order."""
    shown = nodes.where(F.col("type").isin(SENSE, COMPOUND, EXPRESSION) & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0))
    rank = F.when(F.col("type") == SENSE, 0).otherwise(1)
    crumb = F.when(F.col("type") == SENSE, X.crumb_key("breadcrumb")).otherwise(F.array().cast("array<bigint>"))
    keyed = shown.select("tree_id", "meaning_id", "word", "text", "type", rank.alias("_r"), crumb.alias("_c"), F.coalesce("display_order", F.lit(0)).alias("_d"))
    placed = global_rank(keyed, ["_r", "_c", "_d", "meaning_id"], "ord", ["tree_id"])
    return placed.select("tree_id", "meaning_id", "word", "text", "type", (F.col("ord") - 1).alias("ord"))


def attach(tree: DataFrame, shown: DataFrame, hung: DataFrame) -> DataFrame:
    """(meaning_id, unit_id): the nearest node above that is shown, for each node to hang; none, no row.

    `tree`: node, path of `hierarchy`; `shown` and `hung`: meaning_id.
    """
    up = tree.join(hung.select(F.col("meaning_id").alias("node")), "node", "left_semi").where("path <> ''")
    up = up.select("node", F.posexplode(F.split("path", "/")).alias("pos", "above")).withColumn("above", F.col("above").cast("long")).where("above <> node")
    hit = up.join(shown.select(F.col("meaning_id").alias("above")), "above", "left_semi")
    return hit.groupBy(F.col("node").alias("meaning_id")).agg(F.max_by("above", "pos").alias("unit_id"))


def merge_homonyms(u: DataFrame) -> DataFrame:
    """(word, meaning_id, ord): units of all trees of a word in one numbering, tree after tree."""
    rows = u.where("word is not null").select("word", "meaning_id", "tree_id", F.col("ord").alias("_o"))
    return global_rank(rows, ["tree_id", "_o", "meaning_id"], "ord", ["word"]).select("word", "meaning_id", (F.col("ord") - 1).alias("ord"))


def render(u: DataFrame, citations: DataFrame) -> DataFrame:
    """(tree_id, text): units joined by ' | ', each with its citations after ' ◊ '. `citations`: unit_id,
    meaning_id, text; a tree is as large as what is written of it."""
    c = citations.groupBy(F.col("unit_id").alias("meaning_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("meaning_id", "text"))), lambda x: x["text"]), " ◊ ").alias("quoted")
    )
    full = u.join(c, "meaning_id", "left").withColumn("full", F.concat_ws(" ◊ ", "text", "quoted"))
    return full.groupBy("tree_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "full"))), lambda x: x["full"]), " | ").alias("text"))


def entry_text(meanings: list[tuple]) -> str:
    """Meanings (id, parent, type, display_order, breadcrumb, text) as one text: senses, compounds and
    expressions depth first, joined by ' | ', each with the citations (' ◊ ') and etymologies (' – ') right
    under it; senses of a single word are pointers to other trees and left out."""
    ids, below, units, seen = {m[0] for m in meanings}, defaultdict(list), [], set()
    meanings = sorted(meanings, key=lambda m: (m[3], m[0]))
    for m in meanings:
        below[m[1]].append(m)
    shown = [m for m in meanings if m[2] in (SENSE, COMPOUND, EXPRESSION)]
    for top in [m for m in shown if m[1] not in ids] + shown:
        stack = [top]
        while stack:
            m = stack.pop()
            if m[0] not in seen:
                seen.add(m[0])
                units.append(m)
                stack += [c for c in reversed(below[m[0]]) if c[2] in (SENSE, COMPOUND, EXPRESSION)]
    parts = []
    for m in units:
        if m[2] == SENSE and m[5] and " " not in m[5]:
            continue
        body = f"{m[4]} {m[5]}".strip()
        for c in below[m[0]]:
            if c[2] in (ETYMOLOGY, CITATION) and c[5]:
                body += (" – " if c[2] == ETYMOLOGY else " ◊ ") + c[5]
        if body:
            parts.append(body)
    return " | ".join(parts)


def definitions_from_trees(definitions: DataFrame, entry_definitions: DataFrame, tree_entries: DataFrame, meanings: DataFrame) -> DataFrame:
    """(def_id, status, definition): each definition's text from the trees of its entries, or what is
    missing on the way: no_entry, no_tree, no_meanings, no_text. `definitions`: def_id; `entry_definitions`:
    def_id, entry_id; `tree_entries`: entry_id, tree_id; `meanings`: one row per meaning_id, with tree_id,
    parent_id, type, display_order, breadcrumb, text."""
    entries = entry_definitions.join(definitions.select("def_id"), "def_id", "left_semi").distinct()
    trees = publish(entries.join(tree_entries, "entry_id").select("def_id", "tree_id").distinct(), "def-trees")
    text = X.clean_markup("text")
    text = F.trim(F.regexp_replace(F.replace(F.regexp_replace(text, r"\[\d+\]", ""), F.lit("__"), F.lit("")), r"\s+", " "))
    zero, none = F.lit(0), F.lit("")
    m = meanings.select(
        "tree_id", "meaning_id", F.coalesce("parent_id", zero).alias("parent_id"), F.coalesce("type", F.lit(-1)).alias("type"),
        F.coalesce("display_order", zero).alias("display_order"), F.coalesce("breadcrumb", none).alias("breadcrumb"), F.coalesce(text, none).alias("text"),
    )

    def render_all(key, rows: pd.DataFrame) -> pd.DataFrame:
        cols = ("meaning_id", "parent_id", "type", "display_order", "breadcrumb", "text")
        return pd.DataFrame({"def_id": [key[0]], "text": [entry_text(list(zip(*[rows[c] for c in cols], strict=True)))]})

    texts = trees.join(m, "tree_id").groupBy("def_id").applyInPandas(render_all, "def_id long, text string")
    flag = lambda df, c: df.select("def_id").distinct().withColumn(c, F.lit(True))
    got = definitions.join(flag(entries, "e"), "def_id", "left").join(flag(trees, "t"), "def_id", "left").join(texts, "def_id", "left")
    status = (
        F.when(F.col("e").isNull(), "no_entry").when(F.col("t").isNull(), "no_tree").when(F.col("text").isNull(), "no_meanings")
        .when(F.col("text") == "", "no_text").otherwise("ok")
    )
    return got.select(*definitions.columns, status.alias("status"), F.nullif("text", none).alias("definition"))
