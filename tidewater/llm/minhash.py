"""MinHash near-duplicate detection by a signature-coordinate inverted join.

Each distinct shingle set (a class of documents) gets K minimum-hash
coordinates and is posted under every (coordinate, value) pair. Two sets with
``THRESHOLD`` or more equal coordinates share a posting among the
``K - THRESHOLD + 1`` rarest postings of each of them (all sets order
postings by the same key, so the rarest ones form a prefix filter, and the
long posting lists of frequent passages are skipped). Within a posting list
the members meet in stars: all lists with the same pivot merge into one
neighbourhood, which is dealt out in bounded blocks. A block counts
coordinate collisions of its members, keeps the pairs at or above the
threshold, confirms these on the full sets and returns a spanning forest of
the confirmed links, never the pairs themselves. Neighbourhoods of more than
one block get a second round, in which the members that did not join the
neighbourhood's largest component meet every block.

With K = 48 and THRESHOLD = 22 a pair of similarity 0.75 is missed with a
probability of about 2e-6, and less above; links are exact otherwise.

Defined results: null or word-free texts have an empty set, link with nothing
and are kept; a null doc_id links with nothing and is kept; repeated rows and
equal texts form one class and share its component; extra columns of the
input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import components, cut, id_text, whole_row
from ._text import shingle_sets, slices, tidy

K = 48
THRESHOLD = 22
BLOCK = 256
LINK_NUM, LINK_DEN = 75, 100

_rng = np.random.default_rng(20251)
_MUL = _rng.integers(0, 2**31, K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, K, dtype=np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """K minima of multiply-add permutations of the hashes' upper halves."""
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(hashes), 8192):
        part = (hashes[lo : lo + 8192] >> np.uint64(32)).astype(np.uint32)
        np.minimum(out, (_MUL[:, None] * part[None, :] + _ADD[:, None]).min(axis=1), out=out)
    return out


def _sign(batches):
    where = np.arange(K, dtype=np.int64) << 32
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offsets in slices(batch.column(1)):
            n, key, sig = [], [], []
            for s in shingle_sets(data, offsets):
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(where | signature(s).astype(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "set_key", "sig"]
            )


def signatures(docs: DataFrame) -> DataFrame:
    return id_text(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(tidy(_sign), "doc_id long, text_key long, n_shingles long, set_key binary, sig array<long>")


def _pairs_of(sets: list[np.ndarray], sig: np.ndarray, left: np.ndarray, label: np.ndarray):
    """Confirmed links (i, j) with i in ``left``; members that already share a label are not compared."""
    n = len(sets)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in np.flatnonzero(left).tolist():
        hits = np.count_nonzero(sig == sig[i], axis=1) >= THRESHOLD
        hits &= label != label[i]
        hits[: i + 1] &= ~left[: i + 1]
        hits[i] = False
        for j in np.flatnonzero(hits).tolist():
            a, b = len(sets[i]), len(sets[j])
            if root(i) == root(j) or LINK_DEN * min(a, b) < LINK_NUM * max(a, b):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if LINK_DEN * both >= LINK_NUM * (a + b - both):
                parent[root(i)] = root(j)
                yield i, j


def _block_links(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("node", kind="stable").reset_index(drop=True)
    sets = [s for _, _, data, offsets in slices(pa.array(block["text"], pa.large_string())) for s in shingle_sets(data, offsets)]
    found = list(_pairs_of(sets, np.array(block["sig"].tolist()).reshape(len(block), -1), block["is_left"].to_numpy(bool), block["label"].to_numpy(np.int64)))
    node = block["node"].to_numpy()
    return pd.DataFrame({"a": node[[i for i, _ in found]], "b": node[[j for _, j in found]]}, dtype="int64")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    signed, classes, roots = _linked(docs)
    rep = classes.select("set_key", "node").join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("component"))
    out = signed.drop("sig").join(rep, "set_key", "left")
    component = F.when(F.col("doc_id").isNull() | F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with the keys of their texts and sets, classes of equal sets by their least id, roots of the classes that have another one)."""
    signed = cut(signatures(docs))
    classes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"))
    posts = classes.select("node", F.explode("sig").alias("post"))
    often = posts.groupBy("post").agg(F.count("*").alias("often")).where("often > 1")
    shared = posts.join(often, "post")
    by_node = Window.partitionBy("node")
    prefix = cut(
        shared.withColumns({"rank": F.row_number().over(by_node.orderBy("often", "post")), "alone": F.lit(K) - F.count("*").over(by_node)})
        .where(F.col("rank") + F.col("alone") <= K - THRESHOLD + 1)
        .select("post", "node")
    )
    pivots = prefix.groupBy("post").agg(F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    around = prefix.join(pivots, "post").select("pivot", "node").distinct()
    sizes = around.groupBy("pivot").agg(F.count("*").alias("n")).where("n > 1")
    around = cut(around.join(sizes, "pivot"))
    texts = id_text(docs).withColumnRenamed("doc_id", "node")
    members = around.select("node").distinct().join(classes.select("node", "sig"), "node")
    held = cut(members.join(texts, "node"))  # only the documents that share a posting

    def meet(rows: DataFrame) -> DataFrame:
        """rows: pivot, left block, right block, node, is_left, label."""
        return rows.join(held, "node").groupBy("pivot", "block").applyInPandas(_block_links, "a long, b long")

    blocks = F.ceil(F.col("n") / (BLOCK - 1))
    own = F.pmod(F.xxhash64("node"), blocks)
    first = around.withColumn("block", own.cast("string"))
    pivot_too = around.where(F.col("n") > BLOCK - 1).select("pivot", "n").distinct().select(
        "pivot", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")).cast("array<string>")).alias("block"), F.col("pivot").alias("node")
    )
    first = first.select("pivot", "block", "node").union(pivot_too).distinct()
    links = cut(meet(first.select("*", F.lit(True).alias("is_left"), F.col("node").alias("label"))))
    roots = components(links)

    large = around.where(F.col("n") > BLOCK - 1)
    if not large.isEmpty():
        named = cut(large.join(roots, "node", "left").select("pivot", "node", "n", F.coalesce("root", "node").alias("label")))
        main = named.groupBy("pivot", "label").agg(F.count("*").alias("c")).groupBy("pivot").agg(
            F.max(F.struct("c", "label"))["label"].alias("main"), (F.sum("c") - F.max("c")).alias("n_apart")
        )
        main = main.where("n_apart > 0").select("pivot", "main", "n_apart")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        apart_blocks = F.ceil(F.col("n_apart") / (BLOCK // 2)).cast("int")
        apart = named.join(main, "pivot").withColumns({"i": F.pmod(F.xxhash64("node", F.lit(7)), apart_blocks), "j": own, "na": apart_blocks, "nb": blocks.cast("int")})
        is_apart = F.col("label") != F.col("main")
        left = apart.where(is_apart).select("pivot", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), "node", F.lit(True).alias("is_left"), "label")
        right = apart.select("pivot", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"), "j", "node", F.lit(False).alias("is_left"), "label")
        again = left.union(right).groupBy("pivot", F.concat_ws("-", "i", "j").alias("block"), "node", "label").agg(F.max("is_left").alias("is_left"))
        links = links.union(cut(meet(again)))
        roots = components(links)

    return signed, classes, roots


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that represent their group, whatever their other columns are called.

    Different sets under one doc_id each stay; of rows with equal id and set
    one stays, that of the least text key, then of the least other columns
    (as JSON). Of rows without an id, whose texts link with nothing, all stay.
    """
    signed, classes, roots = _linked(docs)
    keyed = signed.where("doc_id is not null").select("doc_id", "set_key", "text_key")
    reps = classes.join(roots, "node", "left_anti").select(F.col("node").alias("doc_id"), "set_key")  # joined by id, so that no group of copies meets in a task
    own = keyed.join(reps, ["doc_id", "set_key"], "left_semi").union(keyed.where("set_key is null"))
    kept = own.groupBy("doc_id", "set_key").agg(F.min("text_key").alias("mark")).select(F.col("doc_id").alias("id"), "mark").distinct()
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark"), whole_row(docs).alias("row"))
    rest = F.to_json(F.struct(F.col("row.text").isNull(), F.col("row").dropFields("text")))
    one = keyed.where("id is not null").join(kept, ["id", "mark"], "left_semi").groupBy("id", "mark").agg(F.min_by("row", rest).alias("row"))
    return one.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))
