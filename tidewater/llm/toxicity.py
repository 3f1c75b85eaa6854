"""Toxicity scores: a lexicon trie met by Levenshtein automata, and context windows.

Learning uses a bounded sample (``SAMPLE`` labelled documents, lowest id
hashes first; near copies of one another count once). Words and word stems
that occur in toxic documents far more often than in others (log-likelihood
ratio of ``EVIDENCE`` or more, ``SUPPORT`` documents at least) make the
lexicon, of ``ENTRIES`` entries at most; an entry weighs the logarithm of that
ratio, as a share of the largest. A word that is not in it is matched by
intersecting its Levenshtein automaton with the trie of the strong entries
(``STRONG`` or more): one edit for entries of five letters or more, two for
eight or more. Look-alike characters, separators and letter runs are undone
first. A misspelled word weighs what its entry does, times the trust in such
misspellings: 1 minus twice their share in clean training documents, where few
say little. Forms that clean training documents hold as often are words of
their own.

The window around a hit says whether it quotes: inside quotation marks, or
after a word that announces a mention, a hit keeps ``QUOTED`` of its weight,
or ``ADDRESSED`` where the window addresses someone and reports nothing. Words
around hits also weigh by how often they stand around hits of toxic and of
other documents. A logistic model of the strongest hit, the sums of
squared and plain weights and the surroundings of hits, fitted on the same sample with no weight below 0,
gives the score.

Defined results: null or empty texts score like any text without hits; without
training rows every score is 0; labels with null ids or values are ignored,
of repeated ones the highest counts; repeated rows each give a row, and the
order of rows doesn't matter; other columns pass through ``drop_toxic``
whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._spark import cut, whole_row
from ._text import column_bytes, shingle_sets, slices, tidy
from .minhash import signature

SAMPLE, ENTRIES, EVIDENCE, SUPPORT, NEAR, WIDE, CONTEXT, INNOCENT = 20_000, 512, 20.0, 4, 4, 12, 400, 4096
EXACT, MASKED, ONE, TWO = range(4)
PRIOR, FAITH = (1.0, 0.95, 0.92, 0.9), 4.0
QUOTED, ADDRESSED, STRONG = 0.15, 0.7, 0.8
FEATURES = ("most", "strong", "sum", "near")
STEMS = (4, 5, 6)
LOWEST = ("low1", "low2", "low3", "low4")
_SLICE = 2 << 20
KNOWN = 200_000  # chunks whose hits a task remembers
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…¡¿"
_OUTER_BUT_MASKS = "".join(c for c in _OUTER if c not in "@$")
_QUOTES = "\"'«»“”‘’„"
# Characters that pass for letters, and words that report, mention or address.
_LOOK_ALIKE = str.maketrans("013457@$!|+€", "oieastasiite")
_SEPARATORS = re.compile(r"[.\-_*~'’·]")
_RUN = re.compile(r"(\w)\1{2,}")
MENTIONS = frozenset("word words term insult slur wort begriff schimpfwort mot terme insulte palabra término insulto".split())
REPORTS = frozenset(
    """said says saying wrote writes written called calls quote quoted quotes quoting reported reads word words term insult slur sagte sagt schrieb nannte zitat zitiert wort dit écrit écrivait cite
    citation mot appelé dijo dice escribió cita citó palabra llamó""".split()
)
ADDRESSES = frozenset("you your you're youre yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti usted ustedes eres vos".split())


def edits(entry: str) -> int:
    return 2 if len(entry) >= 8 else 1 if len(entry) >= 5 else 0


class Trie:
    """Nodes are dicts of letters; the key "" holds the entry that ends there.

    An entry with k edits has k + 1 parts, one of which is unchanged in every
    word that it matches, at most k places away; words without such a part, or
    of another length, need no automaton.
    """

    def __init__(self, entries):
        self.top: dict = {}
        self.parts: dict[int, set[tuple[int, str]]] = {}  # by length of the word: (place, part)
        for e in entries:
            node = self.top
            for c in e:
                node = node.setdefault(c, {})
            node[""] = e
            k = edits(e)
            cuts = [len(e) * i // (k + 1) for i in range(k + 2)]
            for size in range(len(e) - k, len(e) + k + 1):
                own = self.parts.setdefault(size, set())
                own.update((lo + d, e[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False) for d in range(-k, k + 1) if 0 <= lo + d <= size - (hi - lo))
        self.tests = {size: sorted({(at, len(part)) for at, part in own}) for size, own in self.parts.items()}

    def near(self, word: str) -> tuple[str, int] | None:
        """The entry within its own edit limit of the word, nearest first."""
        own = self.parts.get(len(word))
        if own is None or not any((at, word[at : at + n]) in own for at, n in self.tests[len(word)]):
            return None
        best: tuple[int, str] | None = None
        stack = [(self.top, list(range(len(word) + 1)))]  # the automaton's state: edits by position in the word
        while stack:
            node, row = stack.pop()
            for c, below in node.items():
                if c == "":
                    if row[-1] <= edits(below) and (best is None or (row[-1], below) < best):
                        best = (row[-1], below)
                    continue
                new = [row[0] + 1]
                for j, w in enumerate(word):
                    new.append(min(row[j] + (w != c), row[j + 1] + 1, new[j] + 1))
                if min(new) <= 2:
                    stack.append((below, new))
        return (best[1], best[0]) if best else None


def unmasked(chunk: str) -> str:
    """The chunk with look-alike characters as letters, separators inside taken out and runs of three letters or more as one."""
    return _RUN.sub(r"\1", _SEPARATORS.sub("", chunk.strip(_OUTER_BUT_MASKS).translate(_LOOK_ALIKE)))


class Matcher:
    """Finds lexicon entries in chunks: (entry, kind), kinds being EXACT, MASKED and the misspellings ONE and TWO edits away."""

    def __init__(self, model: dict):
        self.words, self.stems = model["words"], model["stems"]
        self.trust, self.innocent = model.get("trust", {}), model.get("innocent", frozenset())
        self.lengths = sorted({len(s) for s in self.stems})
        self.known: dict[str, tuple[str, int] | None] = {}
        self.trie = Trie(sorted(w for w, v in self.words.items() if v >= STRONG))  # a misspelled weak sign is no sign

    def look(self, chunk: str) -> tuple[str, int] | None:
        word = chunk.strip(_OUTER)
        if word in self.words:
            return word, EXACT
        for n in self.lengths:
            if len(word) > n and word[:n] in self.stems:
                return word[:n] + "*", EXACT
        if not 3 <= len(word) <= 40 or word in self.innocent:
            return None
        if not (word.isalpha() and len(chunk) - len(word) < 3) or _RUN.search(word):
            plain = unmasked(chunk)
            if plain != word:
                if self.words.get(plain, 0) >= STRONG:
                    return plain, MASKED
                if len(plain) >= 4 and (got := self.trie.near(plain)) and got[1] == 1:
                    return got[0], MASKED
        got = self.trie.near(word) if len(word) >= 4 else None
        return (got[0], got[1] + 1) if got else None

    def weight(self, entry: str, kind: int) -> float:
        """What a hit counts, 0 to 1: the entry's own weight, discounted for masks and edits."""
        own = self.stems[entry[:-1]] if entry.endswith("*") else self.words[entry]
        return own if kind == EXACT else own * self.trust.get((entry, kind), trust(0, 0, kind))

    def hits(self, texts: pa.Array):
        """For each text with hits: (row, [(entry, kind, chunk, chunks before, chunks after)])."""
        for lo, hi, _, _ in slices(texts, _SLICE):
            rows = pc.utf8_split_whitespace(pc.utf8_lower(texts.slice(lo, hi - lo)))
            first = rows.offsets.to_numpy()
            coded = rows.flatten().dictionary_encode()
            chunks, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            known = self.known
            if len(known) > KNOWN:
                known.clear()
            for c in chunks:
                if c not in known:
                    known[c] = self.look(c)
            found = {k: got for k, got in enumerate(map(known.__getitem__, chunks)) if got}
            if not found:
                continue
            is_hit = np.zeros(len(chunks), bool)
            is_hit[list(found)] = True
            places = np.flatnonzero(is_hit[at])
            for row, own in groupby(zip((np.searchsorted(first - first[0], places, "right") - 1).tolist(), places.tolist(), strict=True), key=lambda x: x[0]):
                start, end = int(first[row] - first[0]), int(first[row + 1] - first[0])
                out = []
                for _, k in own:
                    before, after = ([chunks[j] for j in at[max(start, a) : min(end, b)]] for a, b in ((k - WIDE, k), (k + 1, k + 1 + WIDE)))
                    out.append((*found[int(at[k])], chunks[at[k]], before, after))
                yield lo + row, out


def trust(toxic: float, clean: int, kind: int) -> float:
    """How far a mask or misspelling stands for its entry, 0 to 1, from the (class-balanced) numbers of documents that hold one; PRIOR counts as FAITH such documents."""
    share = (toxic + FAITH * PRIOR[kind]) / (toxic + clean + FAITH)
    return max(0.0, 2 * share - 1)


def _closes(chunk: str) -> bool:
    bare = chunk.rstrip(".,;:!?)")
    return bool(bare) and bare[-1] in _QUOTES


def quotation(chunk: str, before: list[str], after: list[str]) -> float:
    """What is left of a hit inside quotation marks, or after a word that announces a mention; a quotation that addresses someone and that nobody reports weighs more."""
    if before and before[-1].strip(_OUTER) in MENTIONS:
        return QUOTED
    opened = chunk[0] in _QUOTES
    for c in reversed([] if opened else before):
        if c[0] in _QUOTES:
            opened = not (len(c) > 1 and _closes(c))
            break
        if _closes(c):
            break
    if not opened or not (_closes(chunk) or any(map(_closes, after))):
        return 1.0
    near = {c.strip(_OUTER) for c in [*before, *after]}
    return QUOTED if near & REPORTS or not near & ADDRESSES else ADDRESSED


def _around(before: list[str], after: list[str]) -> list[str]:
    return [w for c in before[-NEAR:] + after[:NEAR] if (w := c.strip(_OUTER))]


def features(hits, matcher: Matcher, context: dict[str, float]) -> list[float]:
    """The strongest hit, the sums (logs) of strong hits and of all, and what stands around them."""
    weights, strong = [], []
    for entry, kind, chunk, before, after in hits:
        own, left = matcher.weight(entry, kind), quotation(chunk, before, after)
        weights.append(own * left)
        strong.append(own * own * left)
    near = [context.get(w, 0.0) for *_, before, after in hits for w in _around(before, after)]
    most = max(strong)
    return [most, math.log1p(sum(strong)), math.log1p(sum(weights)), most * float(np.clip(sum(near) / len(hits), -3, 3))]


def _measured(texts: pa.Array, matcher: Matcher, context: dict[str, float]) -> np.ndarray:
    out = np.zeros((len(texts), len(FEATURES)))
    for row, hits in matcher.hits(texts):
        out[row] = features(hits, matcher, context)
    return out


def _scores(texts: pa.Array, matcher: Matcher, model: dict) -> np.ndarray:
    w = model["weights"]
    if w is None:
        return np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip(w[0] + _measured(texts, matcher, model["context"]) @ w[1:], -30, 30)))


def in_training():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0


def _terms(batches):
    for batch in batches:
        terms, toxic = [], []
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {w for c in (t or "").lower().split() if (w := c.strip(_OUTER))}
            own = {w for w in words if 3 <= len(w) <= 40} | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
            terms += own
            toxic += [y] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(toxic, pa.int64())], names=["term", "toxic"])


def _lowest(batches):
    for batch in batches:
        flat, offsets = column_bytes(batch.column(0))
        base = int(offsets[0]) if len(offsets) else 0
        keys = np.array([signature(s)[: len(LOWEST)] for s in shingle_sets(flat[base : int(offsets[-1])], offsets - base)], np.int64).reshape(-1, len(LOWEST))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(k, pa.int64()) for k in keys.T)], names=["text", "toxic", "mark", *LOWEST])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression; the intercept first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def lexicon(support: dict[str, int]) -> tuple[list[str], list[str]]:
    """Words and stems ("stem*") that say nothing twice: a stem yields to a word that makes nine tenths of its support, else its words yield to it."""
    stems = sorted((e[:-1] for e in support if e.endswith("*")), key=lambda s: (len(s), s))
    words = sorted(e for e in support if not e.endswith("*"))
    kept: list[str] = []
    for s in stems:
        if not any(s.startswith(k) for k in kept) and not any(w.startswith(s) and support[w] >= 0.9 * support[s + "*"] for w in words):
            kept.append(s)
    return [w for w in words if not any(w.startswith(k) for k in kept)], kept


def _logistic_at_least_0(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """_logistic with no weight below 0: columns that come out so are left out."""
    use = list(range(x.shape[1]))
    while True:
        w = _logistic(x[:, use], y)
        low = [c for c, v in zip(use, w[1:], strict=True) if v < 0]
        if not low:
            out = np.zeros(x.shape[1] + 1)
            out[[0, *(c + 1 for c in use)]] = w
            return out
        use = [c for c in use if c not in low]


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of SAMPLE labelled documents at most, near copies once; which ones depends on ids and texts alone."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic")).where(in_training())
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toDF("_id", "_toxic")
    # SAMPLE rows at most
    picked = docs.select(
        F.col("doc_id").cast("long").alias("_doc"), F.coalesce("text", F.lit("")).alias("text")
    ).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    signed = cut(picked.select("text", F.col("_toxic").alias("toxic"), F.xxhash64("text").alias("mark")).mapInArrow(tidy(_lowest), "text string, toxic long, mark long, " + ", ".join(f"{k} long" for k in LOWEST)))
    left = signed.drop("text").distinct()
    for k in LOWEST:  # of documents that share a minimum-hash coordinate that of the least text hash stays
        left = left.groupBy("toxic", k).agg(F.min(F.struct("mark", *(x for x in LOWEST if x != k))).alias("x")).select("toxic", k, "x.*")
    once = signed.select("text", "toxic", "mark").dropDuplicates(["toxic", "mark"])  # equal texts
    return cut(once.join(left.select("toxic", "mark"), ["toxic", "mark"], "left_semi").select("text", "toxic"))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: weighted lexicon words and stems, trust in their misspellings, innocent look-alikes, context weights, logistic weights.

    Its size is bounded by ENTRIES, INNOCENT and CONTEXT.
    """
    sample = _sample(docs, labels)
    total = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return {"words": {}, "stems": {}, "context": {}, "weights": None}
    a, b = F.col("a"), F.col("b")
    g2 = lambda k, n: F.when(k > 0, k * F.log(k * (bad + good) / ((a + b) * n))).otherwise(F.lit(0.0))
    counted = sample.mapInArrow(tidy(_terms), "term string, toxic long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    strong = counted.where((a >= SUPPORT) & (a * good > 10 * b * bad)).withColumn("g2", 2 * (g2(a, bad) + g2(b, good))).where(F.col("g2") >= EVIDENCE)
    chosen = {r["term"]: r for r in strong.orderBy(F.desc("g2"), "term").limit(ENTRIES).collect()}
    words, stems = lexicon({t: r["a"] for t, r in chosen.items()})
    ratio = {e: math.log((chosen[e]["a"] + 0.5) * good / ((chosen[e]["b"] + 0.5) * bad)) for e in [*words, *(s + "*" for s in stems)]}
    most = max(ratio.values(), default=1.0)
    model = {"words": {w: ratio[w] / most for w in words}, "stems": {s: ratio[s + "*"] / most for s in stems}}

    def sightings(batches):
        """Documents by form that is no entry itself, and by word around hits (entry null)."""
        matcher = Matcher(model)
        for batch in batches:
            seen: Counter = Counter()
            toxic = batch.column(1).to_pylist()
            for row, hits in matcher.hits(batch.column(0)):
                seen.update({(entry, kind, chunk.strip(_OUTER), toxic[row]) for entry, kind, chunk, *_ in hits if kind != EXACT})
                seen.update((None, None, w, toxic[row]) for _, kind, _, before, after in hits if kind == EXACT for w in _around(before, after))
            columns = [*zip(*seen, strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip([*columns, list(seen.values())], [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()], strict=True)],
                names=["entry", "kind", "form", "toxic", "n"]
            )

    forms = cut(sample.mapInArrow(tidy(sightings), "entry string, kind int, form string, toxic long, n long").groupBy("entry", "kind", "form").agg(F.sum(F.col("n") * F.col("toxic")).alias("a"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("b")))
    other = forms.where("entry is not null")
    own_word = (b >= 2) & (b * bad >= a * good)  # it stands in clean documents as often: a word of its own
    model["innocent"] = frozenset(r["form"] for r in other.where(own_word).orderBy(F.desc("b"), "form").limit(INNOCENT).collect())
    rest = other.where(~own_word).groupBy("entry", "kind").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()  # three rows an entry at most
    model["trust"] = {(r["entry"], r["kind"]): trust(r["a"] * good / bad, r["b"], r["kind"]) for r in rest}
    near = forms.where("entry is null")
    sums = near.agg(F.sum("a"), F.sum("b")).first()
    model["context"] = {}
    if sums[0] and sums[1]:
        rate = sums[0] / sums[1]
        model["context"] = {r["form"]: math.log((r["a"] + 0.5) / ((r["b"] + 0.5) * rate)) for r in near.where("a + b >= 5").orderBy(F.desc(F.least("a", F.lit(50)) + 20 * F.least("b", F.lit(50))), "form").limit(CONTEXT).collect()}

    def measured(batches):
        matcher = Matcher(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in _measured(batch.column(0), matcher, model["context"]).T)], names=["toxic", *FEATURES])

    rows = sample.mapInArrow(tidy(measured), "toxic long, " + ", ".join(f"{c} double" for c in FEATURES)).collect()  # SAMPLE rows at most, a few numbers each
    x = np.array(sorted(tuple(r) for r in rows))
    return model | {"weights": _logistic_at_least_0(x[:, 1:], x[:, 0])}


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` columns and score, a row for each row of ``docs``; one pass, no shuffle. The text is the column ``text``, or the field ``text`` of a kept struct ``row``."""
    held = "row" in keep
    rows = docs.select(*keep) if held else docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text_"))
    fields = [f for f in rows.schema.fields if f.name in keep]

    def run(batches):
        matcher = Matcher(model)
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                text = pc.struct_field(part.column(keep.index("row")), "text") if held else part.columns[-1]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(_scores(text, matcher, model), pa.float64())], names=[*keep, "score"])

    return rows.mapInArrow(tidy(run), StructType([*fields, StructField("score", DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, whatever their other columns are called; they travel as one struct."""
    return score(docs.select(whole_row(docs).alias("row")), train(docs, labels), ["row"]).where("score < 0.5").select("row.*")
