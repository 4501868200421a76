"""Entity alignment: invokers that embed a query graph, and a two-stage search over clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import iri
from ..functions.vectors import dot, mean_by
from . import pairs
from . import triples as graph
from .encoders import Encoder, encoded
from .lineage import cut, kept
from .lookup import first_of

THRESHOLD, MOST_CENTROIDS = 0.8, 4096


class EmptyAlignmentError(TypeError):
    """Nothing could be aligned."""


class Invokers:
    """Named functions (query graph, namespace, encoder, modules) -> (subject, embedding)."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str):
        def add(f):
            self.known[name] = f
            return f

        return add

    def invoke(self, name: str, *args, **kwargs) -> DataFrame:
        if name not in self.known:
            raise AttributeError(f"no invoker {name!r}")
        if not callable(self.known[name]):
            raise TypeError(f"invoker {name!r} can't be called")
        return self.known[name](*args, **kwargs)


invokers = Invokers()


def _coded(query: DataFrame, namespace: str, code) -> DataFrame:
    """(subject, code) of the IRI objects of the namespace predicate that hold a code."""
    rows = graph.match(query, p=namespace).filter("o_kind = 'uri'")
    return rows.select(F.col("s").alias("subject"), code(F.col("o")).alias("code")).filter("code is not null")


def _titled(rows: DataFrame, module: DataFrame, key: str, title: str, encoder: Encoder | None) -> DataFrame:
    """The first title of each code, encoded once per distinct title."""
    order = "ord" if "ord" in module.columns else title
    names = first_of(module.select(F.col(key).cast("string").alias("code"), F.col(title).alias("title"), F.col(order).alias("_ord")), ["code"], ["_ord"])
    found = rows.join(names.select("code", "title"), "code")
    vectors = found.select("title").distinct().withColumn("embedding", encoded(F.col("title"), encoder))
    return found.join(vectors, "title").select("subject", "embedding")


@invokers.register("icd9tosnomed_old")
def icd9_titles(query: DataFrame, namespace: str, encoder: Encoder | None, modules) -> DataFrame:
    return _titled(_coded(query, namespace, iri.icd9_of), modules("icd9"), "ICD9_CODE", "LONG_TITLE", encoder)


@invokers.register("icd9tosnomed")
def icd9_titles_strict(query: DataFrame, namespace: str, encoder: Encoder | None, modules) -> DataFrame:
    out = icd9_titles(query, namespace, encoder, modules)
    if out.isEmpty():
        raise ValueError("no code of the query graph has a title")
    return out


@invokers.register("labresults2snomed")
def lab_labels(query: DataFrame, namespace: str, encoder: Encoder | None, modules) -> DataFrame:
    return _titled(_coded(query, namespace, iri.trailing_number), modules("labresults"), "ITEMID", "LABEL", encoder)


@invokers.register("snomedtoicd9")
def concept_iris(query: DataFrame, namespace: str, encoder: Encoder | None, modules) -> DataFrame:
    rows = graph.match(query, p=namespace).filter("o_kind = 'uri'").select(F.col("s").alias("subject"), "o")
    return rows.select("subject", encoded(F.col("o"), encoder).alias("embedding"))


def centroids(clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    """clusters (cluster_id, subject), vectors (subject, embedding) -> (cluster_id, centroid); every vector of a member counts."""
    return mean_by(clusters.join(vectors, "subject"), ["cluster_id"], "embedding", "centroid")


def checked_centroids(clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    """centroids(); a declared cluster without any vector is an error."""
    out = centroids(clusters, vectors)
    lost = clusters.select("cluster_id").distinct().join(out, "cluster_id", "left_anti").first()
    if lost is not None:
        raise ArithmeticError(f"cluster {lost[0]} has no embeddings")
    return out


def coarse(queries: DataFrame, centers: DataFrame, most: int = MOST_CENTROIDS) -> DataFrame:
    """queries (subject, embedding) with cluster_id, the centroid of the largest cosine (at twelve digits ties to the smallest id); norms are taken once per vector.

    Every query meets every centroid by definition.  Up to `most` centroids are sent to all tasks; more are dealt into blocks of about
    that many, which meet the queries by an equi-join on (block, share), the queries being dealt into as many shares as there are partitions.
    """
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    asked = queries.select("subject", "embedding").distinct().withColumn("long", norm("embedding"))
    centers = centers.select("cluster_id", "centroid", norm("centroid").alias("far"))
    if centers.limit(most + 1).count() <= most:
        met = asked.crossJoin(F.broadcast(centers))
    else:
        blocks, shares = -(-centers.count() // most), int(centers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        dealt = centers.select("*", own("cluster_id", blocks).alias("block"), every(shares).alias("share"))
        met = asked.select("*", own("subject", shares).alias("share"), every(blocks).alias("block")).join(dealt, ["block", "share"])
    both = F.col("long") * F.col("far")
    met = met.withColumn("c", F.when(both > 0, dot(F.col("embedding"), F.col("centroid")) / both)).filter("c is not null")
    best = met.groupBy("subject", "embedding").agg(F.min(F.struct((-F.round("c", pairs.DIGITS)).alias("less"), "cluster_id")).alias("b"))
    return best.select("subject", "embedding", F.col("b.cluster_id").alias("cluster_id"))


def fine(placed: DataFrame, clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    """placed (subject, embedding, cluster_id) -> (subject, candidate, similarity), the best positive one inside the cluster (at twelve digits ties to the smallest candidate)."""
    return _fine(placed, clusters.join(vectors, "subject"))


def _fine(placed: DataFrame, members: DataFrame) -> DataFrame:
    """fine() from the members' vectors (cluster_id, subject, embedding)."""
    placed = cut(placed.select("subject", "embedding", "cluster_id"))
    members = members.select("cluster_id", F.col("subject").alias("candidate"), F.col("embedding").alias("other"))
    many = lambda df, name: df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias(name))
    sizes = cut(many(placed, "asked").join(many(members, "held"), "cluster_id"))
    best = pairs.nearest(placed, members, sizes).groupBy("subject").agg(F.min(F.struct((-F.round("c", pairs.DIGITS)).alias("less"), "candidate", "c")).alias("b"))
    return best.select("subject", F.col("b.candidate").alias("candidate"), F.col("b.c").alias("similarity"))


def aligned(queries: DataFrame, clusters: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD, namespace: str = iri.ALIGN_NAMESPACE) -> DataFrame:
    """Triples (s, p, o) from each query subject to its candidate, where the similarity reaches the threshold."""
    first = queries.groupBy("subject").agg(F.min("embedding").alias("embedding"))
    members = kept(clusters.join(vectors, "subject"), "align-members")  # read for centroids, sizes and the search
    found = _fine(coarse(first, mean_by(members, ["cluster_id"], "embedding", "centroid")), members).filter(F.col("similarity") >= threshold)
    return found.select(F.col("subject").alias("s"), F.lit(namespace).alias("p"), F.col("candidate").alias("o"))


class Aligner:
    """Holds the target vectors, their clusters, the encoder and the modules; transcribe() and merge() a query graph."""

    def __init__(self, vectors: DataFrame, clusters: DataFrame, encoder: Encoder | None = None, modules=None):
        self.vectors, self.clusters, self.encoder, self.modules = vectors, clusters, encoder, modules

    def align(self, query: DataFrame, invoker: str, threshold: float = THRESHOLD, namespace: str = iri.ALIGN_NAMESPACE) -> DataFrame:
        found = invokers.invoke(invoker, query, namespace, self.encoder, self.modules)
        out = aligned(found, self.clusters, self.vectors, threshold, namespace)
        if out.isEmpty():
            raise EmptyAlignmentError("no subject of the query graph is aligned")
        return out

    def transcribe(self, query: DataFrame, invoker: str, threshold: float = THRESHOLD, namespace: str = iri.ALIGN_NAMESPACE) -> DataFrame:
        return graph.transcribe(query, self.align(query, invoker, threshold, namespace))

    def merge(self, query: DataFrame, invoker: str, threshold: float = THRESHOLD, namespace: str = iri.ALIGN_NAMESPACE) -> DataFrame:
        return graph.merge(query, self.align(query, invoker, threshold, namespace))


def translation_scores(facts: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """facts (s, p, o) with `score` -||h + r - t|| from given embeddings (id, embedding): link prediction over supplied vectors."""
    h, t = (entities.select(F.col("id").alias(c), F.col("embedding").alias(f"{c}_v")) for c in ("s", "o"))
    rows = facts.join(h, "s").join(t, "o").join(relations.select(F.col("id").alias("p"), F.col("embedding").alias("p_v")), "p")
    gap = F.zip_with(F.zip_with("s_v", "p_v", lambda a, b: a.cast("double") + b), "o_v", lambda a, b: a - b)
    return rows.select("s", "p", "o", (-F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))).alias("score"))
