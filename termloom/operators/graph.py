"""Graphs and relations between terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.plans.shared import materialize


def page_rank(edges: DataFrame, seeds: DataFrame | None = None, alpha: float = 0.85, rounds: int = 10, every: int = 5) -> DataFrame:
    """(node, rank) after a fixed number of rounds over undirected weighted edges (a, b, w); restarts at the seeds (node), or anywhere.

    Each round is one join and one aggregation; the lineage is cut every few rounds by a table in the shared folder.
    """
    both = edges.select("a", "b", "w").union(edges.select("b", "a", "w"))
    out = both.groupBy("a").agg(F.sum("w").alias("t"))
    steps = materialize(both.join(out, "a").select("a", "b", (F.col("w") / F.col("t")).alias("p")), "rank-steps")
    nodes = steps.select(F.col("a").alias("node")).distinct()
    home = nodes.withColumn("s", F.lit(1.0)) if seeds is None else nodes.join(seeds.select("node").distinct().withColumn("s1", F.lit(1.0)), "node", "left").select("node", F.coalesce("s1", F.lit(0.0)).alias("s"))
    total = home.agg(F.sum("s").alias("z"))
    home = materialize(home.crossJoin(F.broadcast(total)).select("node", (F.col("s") / F.col("z")).alias("h")), "rank-home")  # one row
    rank = home.select("node", F.col("h").alias("rank"))
    for k in range(rounds):
        moved = steps.join(rank, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("m"))
        rank = home.join(moved, "node", "left").select("node", ((1 - alpha) * F.col("h") + alpha * F.coalesce("m", F.lit(0.0))).alias("rank"))
        if (k + 1) % every == 0 and k + 1 < rounds:
            rank = materialize(rank, "rank")
    return rank


def role_relations(roles: DataFrame) -> DataFrame:
    """Per document pairs i-ca, i-ct and ca-ca (first smaller) of roles (doc, term, role)."""
    r = roles.distinct()
    a, b = r.select("doc", F.col("term").alias("t1"), F.col("role").alias("r1")), r.select("doc", F.col("term").alias("t2"), F.col("role").alias("r2"))
    keep = ((F.col("r1") == "i") & F.col("r2").isin("ca", "ct")) | ((F.col("r1") == "ca") & (F.col("r2") == "ca") & (F.col("t1") < F.col("t2")))
    return a.join(b, "doc").where(keep).select("doc", F.concat_ws("-", "r1", "r2").alias("relation"), "t1", "t2")


def hierarchy(phrases: DataFrame) -> DataFrame:
    """(term, parent): the longest proper suffix that is itself a phrase."""
    w = F.split("term", " ")
    suffixes = phrases.select("term").distinct().where(F.size(w) > 1).select("term", F.explode(F.transform(F.sequence(F.lit(2), F.size(w)), lambda i: F.array_join(F.slice(w, i, F.size(w)), " "))).alias("parent"))
    known = phrases.select(F.col("term").alias("parent")).distinct()
    return suffixes.join(known, "parent", "left_semi").groupBy("term").agg(F.max_by("parent", F.length("parent")).alias("parent"))


def bracket_trigrams(trigrams: DataFrame, bigrams: DataFrame) -> DataFrame:
    """L, R or U for three-word compounds by the document frequencies of their bigrams; balanced if the smaller is below half of the larger by ratio."""
    w = F.split("term", " ")
    x = trigrams.select("term", F.col("df").alias("df3"), F.concat_ws(" ", w[0], w[1]).alias("ab"), F.concat_ws(" ", w[1], w[2]).alias("bc"), F.concat_ws(" ", w[0], w[2]).alias("ac"))
    for c in ("ab", "bc", "ac"):
        x = x.join(bigrams.select(F.col("term").alias(c), F.col("df").alias(f"df_{c}")), c, "left").withColumn(f"df_{c}", F.coalesce(f"df_{c}", F.lit(0)))
    label = F.when(F.col("df_ab") > F.col("df_bc"), "L").when(F.col("df_ab") < F.col("df_bc"), "R").otherwise("U")
    top = F.when((F.col("df3") > F.col("df_ab")) & (F.col("df3") > F.col("df_bc")), "T").otherwise("")
    return x.select("term", "df3", "df_ab", "df_bc", "df_ac", label.alias("label"), top.alias("top"))


def collocations(sentence_terms: DataFrame, target: str) -> DataFrame:
    """Terms that share a sentence with the target, counted once a document; rows (doc, sent, term)."""
    own = sentence_terms.where(F.col("term") == target).select("doc", "sent").distinct()
    return sentence_terms.where(F.col("term") != target).join(own, ["doc", "sent"]).groupBy("term").agg(F.countDistinct("doc").alias("docs"))


def phrase_search(index: DataFrame, must: dict[str, str] | None = None, filters: dict | None = None, fields: list[str] | None = None) -> DataFrame:
    """Conjunctive search: phrases contained at word boundaries in text fields, exact values in others, chosen fields."""
    out = index
    for f, phrase in (must or {}).items():
        out = out.where(F.concat(F.lit(" "), F.col(f), F.lit(" ")).contains(f" {phrase} "))
    for f, value in (filters or {}).items():
        out = out.where(F.col(f) == value)
    return out.select(*fields) if fields else out
