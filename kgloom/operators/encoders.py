"""Text encoders, label and graph embeddings."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..functions import iri
from ..functions.vectors import mean_by
from .triples import bnode_closure

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Encoder(Protocol):
    """Anything with encode(list of texts) -> (n, dim) array; it is made once per worker from a pickled object."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedEncoder:
    """Character 3-grams of the lower-cased text hashed to `dim` signed counts, of length 1.  Needs no model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            t = f"  {text.lower()} "
            for i in range(len(t) - 2):
                h = zlib.crc32(t[i : i + 3].encode())
                out[row, (h >> 1) % self.dim] += 1.0 if h & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def encoded(text: Column, encoder: Encoder | None = None) -> Column:
    encoder = encoder or HashedEncoder()

    @pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(encoder.encode(part.fillna("").tolist())))

    return run(text)


def label_embeddings(triples: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """(subject, embedding), one row per label; each distinct label is encoded once."""
    rows = triples.filter((F.col("p") == iri.RDFS_LABEL) & (F.col("o_kind") == "literal")).select(F.col("s").alias("subject"), F.col("o").alias("label"))
    vectors = rows.select("label").distinct().withColumn("embedding", encoded(F.col("label"), encoder))
    return rows.join(vectors, "label").select("subject", "embedding")


def graph_embeddings(triples: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """(subject, edge_embedding, label_embedding): means over a subject's predicates and non-blank objects and those of
    the blank nodes each blank object reaches; a blank node reached from two of them counts twice.  Without any, the empty text's vector."""
    reach = bnode_closure(triples).select(F.col("root").alias("subject"), "node")
    own = triples.filter("s_kind <> 'bnode'").select(F.col("s").alias("subject"), "p", "o", "o_kind")
    far = reach.join(triples.select(F.col("s").alias("node"), "p", "o", "o_kind"), "node").select("subject", "p", "o", "o_kind")
    rows = own.unionByName(far)
    edges, labels = rows.select("subject", F.col("p").alias("text")), rows.filter("o_kind <> 'bnode'").select("subject", F.col("o").alias("text"))
    vectors = edges.select("text").unionByName(labels.select("text")).distinct().withColumn("v", encoded(F.col("text"), encoder))
    mean = lambda texts, name: mean_by(texts.join(vectors, "text"), ["subject"], "v", name)
    empty = triples.sparkSession.createDataFrame([("",)], "text string").select(encoded(F.col("text"), encoder).alias("empty"))
    out = mean(edges, "edge_embedding").join(mean(labels, "label_embedding"), "subject", "left").crossJoin(F.broadcast(empty))
    return out.select("subject", "edge_embedding", F.coalesce("label_embedding", "empty").alias("label_embedding"))


def kmeans(vectors: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """vectors (subject, embedding) -> (subject, cluster_id); no rows without vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("subject", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    if rows.isEmpty():
        return rows.select("subject", F.lit(0).alias("cluster_id")).limit(0)
    model = KMeans(k=k, seed=seed).fit(rows)
    return model.transform(rows).select("subject", F.col("prediction").alias("cluster_id"))
