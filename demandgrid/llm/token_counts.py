"""Token counts of sections from one encoding of the whole document (operator 7).

A document is encoded once.  Token lengths give each token's span of bytes and thus of characters; a merge of the two
sorted lists of spans joins tokens to the sections they overlap.  A token that crosses a border goes, whole, to one
section by the rule ``crossing``: ``start`` (where its first character lies), ``end`` (its last) or ``most`` (the
largest overlap, the earlier section among equals).  So the counts of sections that tile a text add up to its tokens.

Defined results: without given sections they are the text's lines, each with its newline; a null text is like an empty
one, a single empty section without tokens; characters outside all given sections lose their tokens only if the token
overlaps no section; given sections are sorted and don't overlap, empty ones count 0, null ones are left out.  Tokens
that begin inside a character (its bytes may be several tokens) span that character."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from demandgrid.llm.bpe import Tokenizer

RULES = ("start", "end", "most")
RESULT = "array<struct<section: int, start: int, stop: int, n_tokens: bigint>>"


def attribute(token_sizes: np.ndarray, raw: bytes, starts: np.ndarray | None, stops: np.ndarray | None,
              crossing: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops (characters) and token counts of the sections of one text."""
    octets = np.frombuffer(raw, np.uint8)
    first = (octets & 0xC0) != 0x80
    character = np.cumsum(first) - 1                    # of each byte
    n = int(first.sum())
    if starts is None:
        ends = np.flatnonzero(octets == 10)
        stops = character[ends] + 1
        starts = np.concatenate(([0], stops))
        stops = np.concatenate((stops, [n]))
    if not len(token_sizes) or not len(starts):
        return starts, stops, np.zeros(len(starts), np.int64)
    last_byte = np.cumsum(token_sizes)
    a, b = character[last_byte - token_sizes], character[last_byte - 1]  # first and last character, both inside
    full = np.flatnonzero(stops > starts)               # an empty section holds no character
    if not len(full):
        return starts, stops, np.zeros(len(starts), np.int64)
    s, e = starts[full], stops[full]
    low = np.searchsorted(e, a, side="right")           # first section that ends behind the token's start
    high = np.searchsorted(s, b, side="right") - 1      # last section that starts before its end
    met = low <= high
    if crossing == "start":
        chosen = low
    elif crossing == "end":
        chosen = high
    else:
        chosen = low.copy()
        for t in np.flatnonzero(met & (low < high)):
            i = np.arange(low[t], high[t] + 1)
            chosen[t] = i[np.argmax(np.minimum(e[i], b[t] + 1) - np.maximum(s[i], a[t]))]
    counts = np.zeros(len(starts), np.int64)
    counts[full] = np.bincount(chosen[met], minlength=len(full))[:len(full)]
    return starts, stops, counts


def count_tokens(tokenizer: Tokenizer, text: Column, sections: Column | None = None, crossing: str = "most") -> Column:
    """Array of (section, start, stop, n_tokens); ``sections`` is an array of (start, stop) in characters."""
    if crossing not in RULES:
        raise ValueError(f"crossing is one of {RULES}")
    of = tokenizer.vocabulary

    def counted(texts: pa.Array, given: pa.Array | None) -> pa.Array:
        v = of()
        texts = [t or "" for t in texts.to_pylist()]
        ids = v.encode(texts)
        results, ends = [], [0]
        for k, t in enumerate(texts):
            starts = stops = None
            if given is not None:
                spans = [x for x in given[k].as_py() or [] if x is not None and None not in x.values()]
                flat = np.array([tuple(x.values()) for x in spans], np.int64).reshape(-1, 2)
                starts, stops = flat[:, 0], flat[:, 1]
            results.append(attribute(v.lengths[np.frombuffer(ids[k], "<u4")], t.encode(), starts, stops, crossing))
            ends.append(ends[-1] + len(results[-1][0]))
        join = lambda i, kind: pa.array(np.concatenate([np.zeros(0, kind), *(r[i].astype(kind) for r in results)]))
        number = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(r[0]), dtype=np.int32) for r in results)])
        rows = pa.StructArray.from_arrays([pa.array(number), join(0, np.int32), join(1, np.int32), join(2, np.int64)],
                                          ["section", "start", "stop", "n_tokens"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    if sections is None:
        return F.arrow_udf(RESULT)(_one(counted))(text)
    return F.arrow_udf(RESULT)(_two(counted))(text, sections)


def _one(counted):
    def lines(texts: pa.Array) -> pa.Array:
        return counted(texts, None)
    return lines


def _two(counted):
    def spans(texts: pa.Array, given: pa.Array) -> pa.Array:
        return counted(texts, given)
    return spans
