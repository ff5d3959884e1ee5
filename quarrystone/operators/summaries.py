"""Recursive cluster summaries: k-means within bounded groups, a summary per cluster, level upon level.

A document's nodes are dealt by hash into groups of about ``group`` nodes before they are clustered, so a document
that holds a tenth of all chunks is many tasks and never one. Levels are built for all documents at once; each
level is checkpointed and is at most a share of the one below, so the number of rounds is logarithmic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .providers import Provider, call, lead_sentences

SEPARATOR = "\n\n---\n\n"
NODES = "doc_id string, node_id string, level int, text string, vec array<float>, children array<string>"


def lloyd(x: np.ndarray, k: int, seed: int = 42, tries: int = 10, rounds: int = 25) -> np.ndarray:
    """Labels of the best of several seeded k-means runs."""
    best, labels = np.inf, np.zeros(len(x), int)
    for t in range(tries):
        rng = np.random.default_rng(seed + t)
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            d = ((x[:, None, :] - c[None]) ** 2).sum(-1)
            lab = d.argmin(1)
            new = np.stack([x[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = d.min(1).sum()
        if cost < best - 1e-9:
            best, labels = cost, lab
    return labels


def clusters(nodes: DataFrame, size: int = 5, group: int = 200) -> DataFrame:
    """(doc_id, node_id, cluster) of nodes (doc_id, node_id, vec): about ``size`` nodes a cluster."""
    parts = nodes.groupBy("doc_id").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"))
    n = nodes.join(parts, "doc_id").withColumn("part", F.pmod(F.xxhash64("node_id"), F.col("parts")).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        lab = lloyd(np.stack(pdf["vec"].to_numpy()).astype("f8"), max(1, len(pdf) // size))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "node_id": pdf["node_id"], "cluster": pdf["part"].astype(str) + "-" + lab.astype(str)})

    return n.select("doc_id", "part", "node_id", "vec").groupBy("doc_id", "part").applyInPandas(run, "doc_id string, node_id string, cluster string")


def summary_tree(leaves: DataFrame, summarise: Provider | None = None, size: int = 5, most_levels: int = 40) -> DataFrame:
    """All summaries (doc_id, node_id, level, text, vec, children) above leaves (doc_id, node_id, text, vec).

    Levels are built while a document has more than ``size`` nodes; a document left with several nodes gets a root.
    """
    summarise = summarise or lead_sentences()
    now, out = cut_lineage(leaves.select("doc_id", "node_id", "text", "vec")), None

    def parents(members: DataFrame, level: int) -> DataFrame:
        one = members.withColumn("m", F.struct("node_id", F.coalesce("text", F.lit("")).alias("text"), "vec"))
        g = one.groupBy("doc_id", "cluster").agg(F.array_sort(F.collect_list(F.struct(F.col("m.node_id").alias("i"), F.col("m.text").alias("t"), F.col("m.vec").alias("v")))).alias("g"))
        dims = F.size(F.col("g")[0]["v"])
        vec = F.transform(F.sequence(F.lit(1), dims), lambda i: (F.aggregate("g", F.lit(0.0), lambda a, x: a + F.element_at(x["v"], i).cast("double")) / F.size("g")).cast("float"))
        g = g.select("doc_id", "cluster", vec.alias("vec"), F.transform("g", lambda x: x["i"]).alias("children"), F.array_join(F.transform("g", lambda x: x["t"]), SEPARATOR).alias("joined"))
        ident = F.concat_ws("/", "doc_id", F.lit(f"level{level}"), "cluster")
        return g.select("doc_id", ident.alias("node_id"), F.lit(level).alias("level"), call(summarise, "string", "joined").alias("text"), "vec", "children")

    for level in range(1, most_levels):
        n = now.groupBy("doc_id").agg(F.count("*").alias("n"))
        many, few = n.filter(F.col("n") > size).select("doc_id"), n.filter((F.col("n") > 1) & (F.col("n") <= size)).select("doc_id")
        wide, last = now.join(many, "doc_id", "left_semi"), now.join(few, "doc_id", "left_semi")
        made = parents(wide.join(clusters(wide, size), ["doc_id", "node_id"]), level)
        roots = parents(last.withColumn("cluster", F.lit("root")), level)
        made = cut_lineage(made.unionByName(roots))
        if made.isEmpty():
            break
        out = made if out is None else out.unionByName(made)
        now = made.select("doc_id", "node_id", "text", "vec")
    return leaves.sparkSession.createDataFrame([], NODES) if out is None else out
