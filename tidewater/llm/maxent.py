"""Language-model scores from a hashed maximum-entropy model.

Words (runs outside ``\\x20\\x09-\\x0D``, ASCII lower-cased) and one end per
document are the tokens. The probability of a token is factored over classes
and their leaves: P(class | history) P(leaf | class, history) P(token | leaf).
The class of a word comes from its last three bytes, hashed to ``SUFFIXES``
buckets; the buckets are clustered by the buckets they follow. A class has
``LEAVES`` leaves, and a word is in that of its hash, so most frequent words
make up nearly all of a leaf. Both of the first factors are softmaxes over
hashed features of the history: the word before and the word before that (a
skip feature), and for classes also the pair of both their classes; those of
the second have weights of their own in every class. P(token | leaf) is the
add-one share of the token in its leaf, with one share for all unknown words of
the leaf, so that the product is a probability over all tokens.

Training covers every training document: one pass counts words, and each of
``UPDATES`` gradient updates sums observed and expected feature counts of all
of them over all tasks, and moves the weights by iterative scaling. What the
driver holds does not grow: weights, bucket counts and the ``HEAD`` most
frequent words, which are looked up in the tasks; all other words are joined
to the full vocabulary by a shuffle.

Defined results: null or empty texts are one end token; a null doc_id counts
as held out of training; without training documents every token is unknown
and N is 0; repeated rows each count and each give a row; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import id_text, written
from ._text import LOWER, SLICE_BYTES, mix, range_hash, row_ranges, slices, word_bounds

SUFFIXES, CLASSES, HASHED, UPDATES, HEAD = 4096, 32, 4096, 3, 1 << 18
CONTEXTS = 256  # buckets of the word before, for clustering
STEPS = (0.7, 0.5, 0.4)
PRIOR, LEAF_PRIOR = 0.5, 10.0  # counts added to observed and expected ones, so that few say little
LEAVES, LEAF_HASHED = 32, 256  # leaves of a class, and buckets of each of their features
CHUNK = 1 << 13
BLOCK = 1 << 15  # tokens whose probabilities are held at once
COUNTED = 1 << 20  # bytes of a slice: each adds whole arrays of counts, and looks its distinct words up once
END_HASH = np.uint64(0x5851F42D4C957F2D)
START_HASH = np.uint64(0x14057B7EF767814F)
END_BUCKET = SUFFIXES  # the end has a class of its own, the last
FEATURES = 2 * HASHED + (CLASSES + 1) ** 2


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(hash, bucket, row) of every token of a slice, an end after each row's words; read in pieces that stay in the processor's cache."""
    parts = [_tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo) for lo, hi in row_ranges(offsets, SLICE_BYTES)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else _tokens(data, offsets, 0)


def _tokens(data: np.ndarray, offsets: np.ndarray, row: int):
    start, end, first = word_bounds(data, offsets)
    n, rows = len(start), len(offsets) - 1
    word_row = np.repeat(np.arange(rows), np.diff(first))
    at, stop = np.arange(n) + word_row, first[1:] + np.arange(rows)
    h, b, r = np.full(n + rows, END_HASH), np.full(n + rows, END_BUCKET, np.int32), np.empty(n + rows, np.int64)
    h[at] = range_hash(data, start, end)
    low, code = LOWER[data], np.zeros(n, np.uint64)
    for k in (1, 2, 3):
        long = end - start >= k
        code[long] = code[long] * np.uint64(256) + low[end[long] - k]
    b[at] = (mix(code) % np.uint64(SUFFIXES)).astype(np.int32)
    r[at], r[stop] = word_row + row, np.arange(rows) + row
    return h, b, r


def _before(x: np.ndarray, row: np.ndarray, by: int, none):
    out = np.full(len(x), none, x.dtype)
    same = row[by:] == row[:-by]
    out[by:][same] = x[:-by][same]
    return out


def feature_ids(h: np.ndarray, b: np.ndarray, row: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """(tokens, 3): the features of each token's history."""
    one, two = _before(h, row, 1, START_HASH), _before(h, row, 2, START_HASH)
    k = class_of[b]
    pair = _before(k, row, 1, CLASSES).astype(np.int64) * (CLASSES + 1) + _before(k, row, 2, CLASSES)
    return np.stack([(one % np.uint64(HASHED)).astype(np.int64), (two % np.uint64(HASHED)).astype(np.int64) + HASHED, pair + 2 * HASHED]).T


def leaves(h: np.ndarray) -> np.ndarray:
    """The leaf of each token in its class."""
    return (mix(h) >> np.uint64(40)).astype(np.int64) % LEAVES


def leaf_rows(h: np.ndarray, row: np.ndarray, k: np.ndarray) -> np.ndarray:
    """(tokens, 2): for each feature of the history, its row in the weights of a token's own class."""
    one, two = (mix(_before(h, row, n, START_HASH)) >> np.uint64(20) for n in (1, 2))
    hashed = np.stack([(one % np.uint64(LEAF_HASHED)).astype(np.int64), (two % np.uint64(LEAF_HASHED)).astype(np.int64) + LEAF_HASHED])
    return (hashed * CLASSES + k).T


def _sums(ids: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = weights.take(ids[:, 0], axis=0)
    for j in range(1, ids.shape[1]):
        z += weights.take(ids[:, j], axis=0)
    z += bias
    return z


def _normalised(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials, their sums); updates are clipped, so that sums of weights stay far from what floats can't hold."""
    e = np.exp(z)
    return e, np.einsum("ij->i", e)


def log_leaves(rows: np.ndarray, k: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(tokens, LEAVES) log-probabilities in the tokens' own classes."""
    z = _sums(rows, weights, bias[k])
    return z - np.log(_normalised(z)[1])[:, None]


def log_classes(ids: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(tokens, CLASSES) log-probabilities."""
    z = _sums(ids, weights, bias)
    return z - np.log(_normalised(z)[1])[:, None]


def in_training():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2, F.lit(False))


def _merge(h, b, c):
    u, first, inv = np.unique(h, return_index=True, return_inverse=True)
    return u, b[first], np.bincount(inv, weights=c).astype(np.int64)


def _count(batches):
    """Counts of words, by task as far as memory is bounded, and of buckets after buckets (word is null)."""
    held, size = [], 0
    pairs = np.zeros((SUFFIXES + 1) * CONTEXTS, np.int64)

    def flush():
        if not held:
            return []
        u, b, c = _merge(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return [pa.RecordBatch.from_arrays([pa.array(u[k : k + 100_000].view(np.int64)), pa.array(b[k : k + 100_000], pa.int32()), pa.array(c[k : k + 100_000])], names=["word", "bucket", "c"]) for k in range(0, len(u), 100_000)]

    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0), COUNTED):
            h, b, row = tokens(data, offsets)
            pairs += np.bincount(b.astype(np.int64) * CONTEXTS + _before(b, row, 1, END_BUCKET) % CONTEXTS, minlength=len(pairs))
            held.append(_merge(h, b, np.ones(len(h))))
            size += len(held[-1][0])
            if size > 1_000_000:
                yield from flush()
                size = 0
    yield from flush()
    at = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(pairs[at])], names=["word", "bucket", "c"])


def cluster(pairs: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Class of each bucket: k-means of the square roots of its context shares, the end apart."""
    n = pairs[:SUFFIXES].sum(axis=1)
    x = np.sqrt(pairs[:SUFFIXES] / np.maximum(n, 1)[:, None])
    k = CLASSES - 1
    by = np.argsort(-n, kind="stable")
    centre = x[by[: 4 * k : 4]].copy() if len(by) >= 4 * k else x[by[:k]].copy()
    for _ in range(rounds):
        near = (x @ centre.T * 2 - (centre**2).sum(axis=1)).argmax(axis=1)
        for j in range(k):
            if (w := n[near == j]).sum() > 0:
                centre[j] = (x[near == j] * w[:, None]).sum(axis=0) / w.sum()
    return np.append(near, CLASSES - 1).astype(np.int32)


def _factors(weights: np.ndarray, bias: np.ndarray, ends: tuple[int, ...]) -> list[np.ndarray]:
    """(outcomes, rows) of each feature: exponentials of its weights, the first times those of the bias; ``ends`` are the features' last rows."""
    parts = np.split(weights.astype(np.float64), ends[:-1])
    parts[0] += np.resize(bias, parts[0].shape)  # the bias of a row's class, or of all rows
    return [np.ascontiguousarray(np.exp(w).T.astype(np.float32)) for w in parts]


def _expect(totals: list[np.ndarray], ids: np.ndarray, factors: list[np.ndarray]) -> None:
    """totals[j][:, f] += the probabilities at all tokens whose feature j is f.

    Goes outcome by outcome: their factors and totals stay in the processor's
    cache, and nothing is sorted.
    """
    first = np.cumsum([0, *(f.shape[1] for f in factors[:-1])])
    for lo in range(0, len(ids), BLOCK):
        part = [ids[lo : lo + BLOCK, j] - at for j, at in enumerate(first)]
        p, one = np.empty((len(factors[0]), len(part[0])), np.float32), np.empty(len(part[0]), np.float32)
        for row, *own in zip(p, *factors, strict=True):
            own[0].take(part[0], out=row, mode="wrap")  # places are in range; this mode needs no buffer
            for f, at in zip(own[1:], part[1:], strict=True):
                row *= f.take(at, out=one, mode="wrap")
        share = 1.0 / p.sum(axis=0)
        for j, row in enumerate(p):
            weight = np.multiply(row, share, dtype=np.float64)
            for total, at in zip(totals, part, strict=True):
                total[j] += np.bincount(at, weights=weight, minlength=total.shape[1])


def _gradient(model):
    """Observed and expected counts of a task's tokens: of classes (part 0) by feature, of leaves (part 1) by feature and class.

    Observed counts are the same whatever the weights are, and are left out for
    a model that has them (``seen``). While all weights are zero, the history
    tells nothing, and what is expected of a feature is its number of tokens
    times the shares of the bias.
    """
    class_of, weights, bias, leaf_weights, leaf_bias = (model[c] for c in ("class_of", "weights", "bias", "leaf_weights", "leaf_bias"))
    count, even = "seen" not in model, not (weights.any() or leaf_weights.any())

    def run(batches):
        tables = ((weights, bias, (HASHED, 2 * HASHED, FEATURES)), (leaf_weights, leaf_bias, (LEAF_HASHED * CLASSES, 2 * LEAF_HASHED * CLASSES)))
        factors = [_factors(*t) for t in tables]
        totals = [[np.zeros(f.shape) for f in own] for own in factors]
        seen = [np.zeros(weights.size, np.int64), np.zeros(leaf_weights.size, np.int64)]
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), COUNTED):
                h, b, row = tokens(data, offsets)
                k = class_of[b].astype(np.int64)
                for part, (ids, outcome, outcomes) in enumerate(((feature_ids(h, b, row, class_of), k, CLASSES), (leaf_rows(h, row, k), leaves(h), LEAVES))):
                    if count or even:
                        for at in ids.T:
                            seen[part] += np.bincount(at * outcomes + outcome, minlength=len(seen[part]))
                    if not even:
                        _expect(totals[part], ids, factors[part])
        for part, (w, own_bias, _) in enumerate(tables):
            observed, expected = seen[part].reshape(w.shape), np.hstack(totals[part]).T
            if even:
                e, total = _normalised(np.atleast_2d(own_bias))
                expected = observed.sum(axis=1)[:, None] * np.resize(e / total[:, None], w.shape)
            both = np.hstack([observed, expected]) if count else expected
            at = np.flatnonzero(both.any(axis=1))
            for lo in range(0, len(at), 2000):
                own = at[lo : lo + 2000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), part, np.int32)), pa.array(own, pa.int32()), *(pa.array(c, pa.float32()) for c in both[own].T)],
                    names=["part", "f", *(f"s{j}" for j in range(both.shape[1]))]
                )

    return run


def train(docs: DataFrame) -> dict:
    """vocabulary (a table: word, bucket, c) and the model's arrays."""
    learn = docs.where(in_training())
    counted = learn.select("text").mapInArrow(_count, "word long, bucket int, c long")
    counted = counted.groupBy("word", F.when(F.col("word").isNull(), F.col("bucket")).alias("at")).agg(F.first("bucket").alias("bucket"), F.sum("c").alias("c"))
    counted = written(counted.select("word", "bucket", "c"))
    pairs = np.zeros((SUFFIXES + 1) * CONTEXTS)
    got = counted.where("word is null").select("bucket", "c").toArrow().to_pandas()  # as many cells at most
    pairs[got["bucket"]] = got["c"]
    class_of = cluster(pairs.reshape(SUFFIXES + 1, CONTEXTS))
    del pairs

    vocabulary = counted.where("word is not null")
    # CLASSES * LEAVES rows at most
    sums = vocabulary.mapInArrow(
        _leaf_sums(class_of), "leaf int, n long, v long"
    ).groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow().to_pandas()
    n, v = (np.bincount(sums["leaf"], weights=sums[c], minlength=CLASSES * LEAVES).reshape(CLASSES, LEAVES) for c in ("n", "v"))
    of_class = n.sum(axis=1)
    model = {
        "class_of": class_of, "n": n, "v": v, "bias": np.log((of_class + 1) / (n.sum() + CLASSES)).astype(np.float32), "weights": np.zeros((FEATURES, CLASSES), np.float32),
        "leaf_bias": np.log((n + 1) / (of_class[:, None] + LEAVES)).astype(np.float32), "leaf_weights": np.zeros((2 * LEAF_HASHED * CLASSES, LEAVES), np.float32),
    }
    width, names = max(CLASSES, LEAVES), ("weights", "leaf_weights")
    for step in STEPS[:UPDATES]:
        columns = [f"s{j}" for j in range(width if "seen" in model else 2 * width)]
        rows = learn.select("text").mapInArrow(_gradient(model), "part int, f int, " + ", ".join(f"{c} float" for c in columns))
        rows = rows.groupBy("part", "f").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()  # a row for each row of the weights at most
        part, f = rows["part"].to_numpy(), rows["f"].to_numpy()
        got = np.stack([rows[c].to_numpy() for c in columns], axis=1)
        if "seen" not in model:
            model["seen"] = [np.zeros(model[name].shape) for name in names]
            for k, seen in enumerate(model["seen"]):
                seen[f[part == k]] = got[part == k, :width]
        for k, (name, prior) in enumerate(zip(names, (PRIOR, LEAF_PRIOR), strict=True)):
            at, expected = f[part == k], got[part == k, -width:]
            model[name] = model[name].copy()
            model[name][at] += (step * np.clip(np.log((model["seen"][k][at] + prior) / (expected + prior)), -3, 3)).astype(np.float32)
    return model | {"vocabulary": vocabulary, "head": _head(vocabulary)}


def _leaf_sums(class_of):
    def run(batches):
        for batch in batches:
            word, bucket, c = (batch.column(k).to_numpy() for k in range(3))
            at = class_of[bucket].astype(np.int64) * LEAVES + leaves(word.view(np.uint64))
            n, v = np.bincount(at, weights=c), np.bincount(at)
            leaf = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(n[leaf].astype(np.int64)), pa.array(v[leaf].astype(np.int64))], names=["leaf", "n", "v"])

    return run


def _head(vocabulary: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, ``most`` at most: a limit on the count that keeps so many."""
    step = F.floor(F.log2("c") * 8)
    counts = sorted(((r[0], r[1]) for r in vocabulary.groupBy(step.alias("k")).count().collect()), reverse=True)
    total, least = 0, None
    for k, c in counts:
        if total + c > most:
            break
        total, least = total + c, k
    head = vocabulary.where(step >= least).select("word", "c").toArrow().to_pandas() if least is not None else pd.DataFrame({"word": [], "c": []}, dtype="int64")
    head = head.sort_values("word")
    return head["word"].to_numpy(np.int64), head["c"].to_numpy(np.int64)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row for each row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    n, v = model["n"], model["v"]
    total = float(n.sum() + v.sum() + 1)
    shared = sc.broadcast((*(model[c] for c in ("class_of", "weights", "bias", "leaf_weights", "leaf_bias")), np.log10(n + v + 1), *model["head"]))  # bounded by HEAD and the parameters

    def run(batches):
        class_of, weights, bias, leaf_weights, leaf_bias, within, head, head_c = shared.value
        logs = np.log10(head_c + 1.0)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2), COUNTED):
                h, b, row = tokens(data, offsets)
                ids, k, rows = feature_ids(h, b, row, class_of), class_of[b], hi - lo
                own, leaf, gained = leaf_rows(h, row, k), leaves(h), np.empty(len(h))
                for at in range(0, len(h), CHUNK):
                    part = slice(at, at + CHUNK)
                    p, q = log_classes(ids[part], weights, bias), log_leaves(own[part], k[part], leaf_weights, leaf_bias)
                    gained[part] = p[np.arange(len(p)), k[part]] + q[np.arange(len(q)), leaf[part]]
                gained = gained / np.log(10) - within[k, leaf]
                words, inverse = np.unique(h.view(np.int64), return_inverse=True)
                place = np.minimum(np.searchsorted(head, words), max(0, len(head) - 1))
                hit = head[place] == words if len(head) else np.zeros(len(words), bool)
                hit_token = hit[inverse]
                count = np.where(hit, logs[place], 0.0)[inverse] if len(head) else np.zeros(len(h))
                by = lambda w, row=row, rows=rows: np.bincount(row, weights=w, minlength=rows)
                number = batch.column(0).slice(lo, rows)
                key = number.to_numpy(zero_copy_only=False)
                tail = np.flatnonzero(~hit_token)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([key, key[row[tail]]])),
                        pa.concat_arrays([batch.column(1).slice(lo, rows), pa.nulls(len(tail), pa.int64())]),
                        pa.array(np.concatenate([mix(key.astype(np.uint64)).view(np.int64), h[tail].view(np.int64)])),
                        pa.array(np.concatenate([np.bincount(row, minlength=rows), np.zeros(len(tail), np.int64)])),
                        pa.array(np.concatenate([by(hit_token).astype(np.int64), np.zeros(len(tail), np.int64)])),
                        pa.array(np.concatenate([by(count), np.zeros(len(tail))])),
                        pa.array(np.concatenate([by(gained), np.zeros(len(tail))])),
                    ],
                    names=["row", "doc_id", "word", "n_tokens", "n_known", "counts", "gained"],
                )

    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    parts = rows.mapInArrow(run, "row long, doc_id long, word long, n_tokens long, n_known long, counts double, gained double")
    found = parts.join(model["vocabulary"].select("word", "c"), "word", "left")
    rare = (F.col("n_tokens") == 0) & F.col("c").isNotNull()
    found = found.select(
        "row", "doc_id", "n_tokens", (F.col("n_known") + rare.cast("long")).alias("n_known"),
        (F.col("counts") + F.when(rare, F.log10(F.col("c") + 1.0)).otherwise(0.0)).alias("counts"), "gained"
    )
    out = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("counts").alias("counts"),
        F.sum("gained").alias("gained")
    )
    return out.select(
        "doc_id", (~in_training()).alias("held_out"), "n_tokens", "n_known", F.lit(int(n.sum())).cast("long").alias("train_tokens"),
        (F.col("counts") - F.col("n_tokens") * float(np.log10(total))).alias("base_score"), (F.col("counts") + F.col("gained")).alias("score"),
    )


def model_scores(docs: DataFrame) -> DataFrame:
    plain = id_text(docs)
    return score(plain, train(plain))
