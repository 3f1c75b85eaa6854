"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. Each token has a byte span, and each
section (a line with its break, or the lines up to an empty one) a span too;
both are sorted, so the interval join is two searches per token. A token that
crosses a boundary counts for the section that holds most of its bytes, for
the earlier one if they tie: every token counts exactly once.

Defined results: null or empty texts have one section without characters or
tokens; a text that ends with a break has no section after it; a null doc_id
passes through; repeated rows each give their rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import id_text
from .bpe import encoder


def section_starts(raw: bytes, blank: bool = False) -> np.ndarray:
    """Byte offsets at which sections start: after each break, or each empty line (``blank``)."""
    data = np.frombuffer(raw, np.uint8)
    after = np.flatnonzero(data == 10) + 1
    if blank and len(after):
        after = after[1:][np.diff(after) == 1]
    return np.concatenate([[0], after[after < len(data)]]).astype(np.int64)


def attribute(ends: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The section of each token; tokens end at ``ends``, sections start at ``starts``, the text has n bytes."""
    begin = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    limit = np.append(starts, n)
    for t in np.flatnonzero(first != last).tolist():
        held = [min(ends[t], limit[s + 1]) - max(begin[t], limit[s]) for s in range(first[t], last[t] + 1)]
        first[t] += int(np.argmax(held))
    return first


def section_tokens(docs: DataFrame, path: str, pattern: str, blank: bool = False) -> DataFrame:
    """doc_id, section (from 0), start_char, n_chars, n_tokens, doc_tokens: a row for each section."""

    def run(batches):
        own = encoder(path, pattern)
        size = np.zeros(max(own.bytes_of) + 1, np.int64)
        size[list(own.bytes_of)] = [len(t) for t in own.bytes_of.values()]
        names = ["doc_id", "section", "start_char", "n_chars", "n_tokens", "doc_tokens"]
        for batch in batches:
            lo = 0
            while lo < len(batch):
                hi, bulk, texts = lo, 0, []
                while hi < len(batch) and (hi == lo or bulk < 1 << 20):
                    texts.append(batch.column(1)[hi].as_py())
                    bulk += len(texts[-1])
                    hi += 1
                rows: list[list[np.ndarray]] = []
                for k, (text, ids) in enumerate(zip(texts, own.encode(texts), strict=True)):
                    raw = text.encode()
                    starts = section_starts(raw, blank)
                    count = np.bincount(attribute(np.cumsum(size[ids]), starts, len(raw)), minlength=len(starts)) if len(ids) else np.zeros(len(starts), np.int64)
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                    at = chars[np.append(starts, len(raw))]
                    rows.append([np.full(len(starts), lo + k), np.arange(len(starts)), at[:-1], np.diff(at), count, np.full(len(starts), len(ids))])
                columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)
                lo = hi

    return id_text(docs).mapInArrow(run, "doc_id long, section long, start_char long, n_chars long, n_tokens long, doc_tokens long")
