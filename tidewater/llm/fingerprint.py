"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a weighted set: its words (runs outside ``\\x20\\x09-\\x0D``), in
lower case, weighted by count. For each of ``SAMPLES`` samples a word of weight
w draws r and c from Gamma(2, 1) and b from U(0, 1), all seeded by word and
sample alone, and gets

    t = floor(ln w / r + b),    ln a = ln c - r (t - b) - r;

the word of least a is the sample. The probability that two documents draw
the same (word, t) is their generalised Jaccard similarity, the sum of minima
over the sum of maxima of the weights, so the share of equal samples has a
standard error of at most 0.5 / sqrt(SAMPLES), 0.063. A sample is kept as one
64-bit number: the order of ln a above, a hash of word and t below, so a plain
minimum picks it; the fingerprint holds the low halves in hexadecimal.

A gamma draw is the sum of two exponential ones, and each of these takes its
whole halvings from trailing zeros of a hash and the rest from a polynomial;
ln c comes from its fourth root and a polynomial, as logarithms are by far the
dearest part. Samples are drawn ``AT_ONCE`` at a time: more would make the
generated code too long for the JVM's compiler.

Texts are dealt out by doc_id once; words, weights and minima of a document
then meet in the same task without further shuffles.

Defined results: null or word-free texts have the fingerprint of no words,
equal only to that of other word-free texts; documents are ordered by doc_id,
those of one id by a hash of their texts; repeated rows (equal id and text)
are one document in that order and each give its row; a null doc_id is below
all others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import cut, written

SAMPLES, AT_ONCE = 64, 2
_NULL_ID = -(2**63)
SPACE = "[\\x20\\x09-\\x0D]+"
BITS = 10  # of the halvings and of the rest of an exponential draw each
_REST = np.polyfit(np.linspace(0, 1 << BITS, 4001), -np.log(1 - np.linspace(0, 0.5, 4001)), 5).tolist()  # -ln(1 - x / 2^(BITS + 1)), to about 1e-5


def _exponential(bits: Column, shift: int) -> Column:
    """-ln U from 2 BITS bits, U = 2^-zeros (1 - rest / 2)."""
    low = F.shiftrightunsigned(bits, shift).bitwiseAND((1 << BITS) - 1).bitwiseOR(1 << BITS)
    zeros = F.bit_count((low - 1).bitwiseAND(F.bitwise_not(low)))
    x = F.shiftrightunsigned(bits, shift + BITS).bitwiseAND((1 << BITS) - 1).cast("double") + 0.5
    rest = F.lit(_REST[0])
    for c in _REST[1:]:
        rest = rest * x + F.lit(c)
    return zeros * F.lit(float(np.log(2))) + rest


_MIDDLE = 0.6
_Y = np.cos(np.pi * (np.arange(400) + 0.5) / 400) * 0.62
_ATANH = np.linalg.lstsq(np.stack([_Y ** (2 * k + 1) for k in range(5)], axis=1), 8 * np.arctanh(_Y), rcond=None)[0].tolist()


def _four_logs(y: Column) -> Column:
    """4 ln s from y = (s - _MIDDLE) / (s + _MIDDLE), for s between 0.14 and 2.5 to about 1e-5: the logarithm of a gamma draw from its fourth root."""
    square, out = y * y, F.lit(_ATANH[-1])
    for c in _ATANH[-2::-1]:
        out = out * square + F.lit(c)
    return out * y + float(4 * np.log(_MIDDLE))


def fingerprints(texts: DataFrame, keys: list[str], columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and, under their names, the prints of the texts in ``columns``; rows must be dealt by (a prefix of) ``keys`` already.

    A column without words has a null print; a row without any is left out. A
    word of several columns is hashed and draws once.
    """
    sides, some = range(len(columns)), range(AT_ONCE)
    each = texts.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("t")) for k, c in enumerate(columns)))).alias("x"))
    word = each.select(
        *keys, F.col("x.side").alias("side"), F.explode(F.split(F.lower("x.t"), SPACE)).alias("word")
    ).where("word <> ''").select(*keys, "side", F.xxhash64("word").alias("word"))
    weight = word.groupBy(*keys, "word").agg(*(F.count(F.when(F.col("side") == k, 1)).alias(f"w{k}") for k in sides))
    parts = F.explode(F.sequence(F.lit(0), F.lit(samples // AT_ONCE - 1))).alias("part")
    own = [*keys, "part", "word", *(f"log_w{k}" for k in sides)]
    drawn = weight.select(*keys, "word", *(F.log(F.nullif(F.col(f"w{k}"), F.lit(0))).alias(f"log_w{k}") for k in sides), parts)
    # stepwise, so that nothing is computed twice
    drawn = drawn.select(
        *own, *(F.xxhash64("word", F.col("part") * AT_ONCE + j).alias(f"g{j}") for j in some),
        *(F.xxhash64("word", -1 - F.col("part") * AT_ONCE - j).alias(f"h{j}") for j in some)
    )
    gamma = lambda c: _exponential(F.col(c), 0) + _exponential(F.col(c), 2 * BITS)
    b = lambda c: (F.shiftrightunsigned(c, 4 * BITS).cast("double") + 0.5) * 2.0 ** (4 * BITS - 64)
    drawn = drawn.select(*own, *(x for j in some for x in (gamma(f"g{j}").alias(f"r{j}"), F.sqrt(F.sqrt(gamma(f"h{j}"))).alias(f"c{j}"), b(f"g{j}").alias(f"b{j}"))))
    drawn = drawn.select(*own, *(x for j in some for x in (f"r{j}", f"b{j}", ((F.col(f"c{j}") - _MIDDLE) / (F.col(f"c{j}") + _MIDDLE)).alias(f"y{j}"))))
    drawn = drawn.select(*own, *(x for j in some for x in (f"r{j}", f"b{j}", _four_logs(F.col(f"y{j}")).alias(f"log_c{j}"))))
    drawn = drawn.select("*", *(F.floor(F.col(f"log_w{k}") / F.col(f"r{j}") + F.col(f"b{j}")).alias(f"t{j}_{k}") for j in some for k in sides))
    log_a = lambda j, t: F.col(f"log_c{j}") - F.col(f"r{j}") * (t - F.col(f"b{j}") + 1)
    name = lambda t: F.shiftrightunsigned("word", 32).bitwiseXOR(F.shiftleft(t, 8)).bitwiseAND(0xFFFFFFFF)
    key = lambda j, t: F.shiftleft((log_a(j, t) * 2_000_000).cast("int").cast("long"), 32).bitwiseOR(name(t))
    least = drawn.groupBy(*keys, "part").agg(*(F.min(key(j, F.col(f"t{j}_{k}"))).alias(f"k{j}_{k}") for j in some for k in sides))
    hexed = lambda k: F.concat(*(F.lpad(F.lower(F.hex(F.col(f"k{j}_{k}").bitwiseAND(0xFFFFFFFF))), 8, "0") for j in some))
    # samples / AT_ONCE parts
    one = least.select(
        *keys, F.struct("part", *(hexed(k).alias(f"x{k}") for k in sides)).alias("part")
    ).groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("x"))
    return one.select(*keys, *(F.nullif(F.array_join(F.col("x")[f"x{k}"], ""), F.lit("")).alias(c) for k, c in enumerate(columns)))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    equal = sum((F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int") for k in range(samples))
    return equal / F.lit(float(samples))


def _in_order(keys: DataFrame) -> DataFrame:
    """``keys`` (id, mark) with ``place``: 0, 1, ... by descending id, then mark; dealt over range partitions."""
    dealt = cut(keys.distinct().repartitionByRange(F.desc("id"), F.asc("mark")).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("id"), "mark")) - 1
    return dealt.withColumn("own", own).join(sums.drop("count"), "part").select("id", "mark", (F.col("own") + F.col("before")).alias("place"))


def compare_edited(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; a row for each row of ``docs``.

    The edited text replaces the last floor(n/2) code points by the first as
    many of the next document by descending doc_id; after the last comes the first.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    order = cut(_in_order(plain.select("id", "mark")))
    n = order.count()
    ahead = order.select(F.struct("id", "mark").alias("own"), F.pmod(F.col("place") + 1, F.lit(max(n, 1))).alias("place"))
    links = cut(ahead.join(order, "place").select("own.id", "own.mark", F.struct("id", "mark").alias("next")))
    dealt = plain.join(links, ["id", "mark"])
    half = F.expr("char_length(text) div 2").cast("int")
    need = dealt.select("next.id", "next.mark", F.struct("id", "mark").alias("own"), half.alias("half"))
    head = need.join(plain.select("id", "mark", F.col("text").alias("next_text")), ["id", "mark"]).select("own.id", "own.mark", F.expr("left(next_text, half)").alias("head"))
    repeated = plain.count() > n
    if repeated:
        head = head.dropDuplicates(["id", "mark"])
    pair = dealt.join(head, ["id", "mark"]).withColumn("edited", F.concat(F.expr("left(text, char_length(text) - char_length(text) div 2)"), F.col("head")))
    both = (pair.dropDuplicates(["id", "mark"]) if repeated else pair).select("id", "mark", F.col("text").alias("fingerprint"), F.col("edited").alias("edited_fingerprint"))
    printed = fingerprints(both, ["id", "mark"], ["fingerprint", "edited_fingerprint"], samples)
    facts = pair.select("id", "mark", "next", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    # one job for both, so that the exchange of the texts is written once; prints are kept as bytes, half as long
    prints = ["fingerprint", "edited_fingerprint"]
    out = facts.join(printed, ["id", "mark"], "left").na.fill("0" * 8 * samples, prints)
    out = written(out.withColumns({c: F.unhex(c) for c in prints}))
    following = out.select(F.struct("id", "mark").alias("next"), F.col("fingerprint").alias("_ahead"))
    out = out.join(following.dropDuplicates(["next"]) if repeated else following, "next")
    out = out.withColumns({c: F.lower(F.hex(c)) for c in (*prints, "_ahead")})
    return out.select(
        F.when(F.col("id") != _NULL_ID, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_ahead"), samples).alias("near_next"),
    )
