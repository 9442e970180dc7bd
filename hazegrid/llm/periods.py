"""Periodic runs of words by string synchronising sets.

A run is a maximal stretch of words with smallest period q and at least four periods. All texts of a slice lie
behind one another with a separator of their own between them, so no stretch crosses a border.

At each dyadic scale t, position k belongs to the synchronising set if the smallest fingerprint of t words among
positions k .. k + t stands at k or at k + t. That depends on the 2t words from k only, so equal contexts are
chosen alike, and every t neighbouring positions hold a member. A run of period t <= q < 2t has a member i in its
first t positions, and i + q has the same context; no nearer position has it, because a shorter distance would
make a shorter period of the run (Fine and Wilf). So neighbouring members of equal context propose every period
of the scale; proposals are extended to both sides and checked word by word.

Inside a highly periodic region (period of at most t / 3, at least 3t - 1 words) nearly all positions would be
members. Those regions are left out of the set: they are runs found at smaller scales, and periods below the
first scale are found by direct comparison.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm import textbytes as tb

LEAST_WORDS, LEAST_PERIODS = 6, 4
FIRST_SCALE = 4  # smaller periods are compared directly


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` values from each position that has so many, by minima of blocks from both ends."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number per word, equal for equal bytes, and the distinct words. Words lie in order and apart."""
    sizes = end - start
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


class Symbols:
    """Symbols of a slice with fingerprints of all stretches of 2^k, for the common length at two places."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.symbols = symbols
        self.prints = [tb.mixed(symbols.astype(np.uint64) * np.uint64(tb.BASES[0]) + np.uint64(1))]
        while 2 << (len(self.prints) - 1) <= longest:
            size, last = 1 << (len(self.prints) - 1), self.prints[-1]
            self.prints.append(tb.mixed(last[:-size] * np.uint64(tb.BASES[1]) + last[size:]))

    def common(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """Number of equal symbols from (or, ``back``, before) positions ``i`` and ``j`` on; j > i."""
        length = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.prints) - 1, -1, -1):
            size, known = 1 << k, self.prints[k]
            x, y = (i - length - size, j - length - size) if back else (i + length, j + length)
            fits = np.flatnonzero((x >= 0) & (y < len(known)))
            equal = fits[known[x[fits]] == known[y[fits]]]
            length[equal] += size
        return length


def _true_stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _primitive(symbols: np.ndarray, start: int, period: int) -> bool:
    """No smaller period divides the first period of a run."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            step = period // prime
            if np.array_equal(symbols[start : start + period - step], symbols[start + step : start + period]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def _checked(symbols: np.ndarray, found: np.ndarray, period: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, int]]:
    """Distinct (start, end, period) that are long enough, of smallest period and periodic word by word."""
    length = stop - found
    long = (length >= LEAST_WORDS) & (length >= LEAST_PERIODS * period)
    runs = []
    for s, e, q in sorted(set(zip(found[long].tolist(), stop[long].tolist(), period[long].tolist(), strict=True))):
        if np.array_equal(symbols[s : e - q], symbols[s + q : e]) and _primitive(symbols, s, q):
            runs.append((s, e, q))
    return runs


def find_runs(symbols: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All runs of a symbol array as (start, end, period). ``longest``: no run is longer than this."""
    runs: list[tuple[int, int, int]] = []
    for q in range(1, FIRST_SCALE):
        if max(LEAST_WORDS, LEAST_PERIODS * q) <= longest:
            low, high = _true_stretches(symbols[:-q] == symbols[q:])
            runs += _checked(symbols, low, np.full(len(low), q), high + q)
    if LEAST_PERIODS * FIRST_SCALE > longest:
        return runs
    known = Symbols(symbols, longest)
    scale, level = FIRST_SCALE, FIRST_SCALE.bit_length() - 1
    while LEAST_PERIODS * scale <= longest:
        prints, contexts = known.prints[level], known.prints[level + 1]
        least = sliding_least(prints, scale + 1)
        member = (least == prints[: len(least)]) | (least == prints[scale:])
        for s, e, q in runs:
            if 3 * q <= scale and e - s >= 3 * scale - 1:
                member[s : e - (3 * scale - 1) + 1] = False
        place = np.flatnonzero(member)
        context = contexts[place]
        order = np.argsort(context, kind="stable")
        place, context = place[order], context[order]
        step = np.diff(place)
        proposed = np.flatnonzero((context[1:] == context[:-1]) & (step >= scale) & (step < 2 * scale))
        i, q = place[proposed], step[proposed]
        runs += _checked(symbols, i - known.common(i, i + q, back=True), q, i + q + known.common(i, i + q))
        scale, level = 2 * scale, level + 1
    return runs


def text_runs(data: np.ndarray, offsets: np.ndarray, sources: Callable | None = None):
    """Per text of a slice: word bounds (behind ``sources``) and its runs as sorted (start, length, period).

    ``sources(row, n)`` may give, for a text of n words, the numbers of the words to read instead, or None.
    """
    start, end, heads = tb.words(data, offsets, tb.byte_classes(tb.SPACES))
    codes, _ = word_codes(data, start, end)
    sizes = np.diff(heads)
    if sources is not None:
        chosen = np.arange(len(start))
        for row in np.flatnonzero(sizes):
            other = sources(int(row), int(sizes[row]))
            if other is not None:
                chosen[heads[row] : heads[row + 1]] = heads[row] + other
        start, end, codes = start[chosen], end[chosen], codes[chosen]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    symbols = np.empty(len(start) + len(sizes), dtype=np.int64)
    symbols[np.arange(len(start)) + rows] = codes
    symbols[heads[1:] + np.arange(len(sizes))] = -1 - np.arange(len(sizes))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    base = heads[:-1] + np.arange(len(sizes))
    for s, e, q in find_runs(symbols, int(sizes.max(initial=0))):
        row = int(np.searchsorted(base, s, side="right")) - 1
        runs[row].append((s - int(base[row]), e - s, q))
    for found in runs:
        found.sort(key=lambda run: (run[0], run[2]))
    return start, end, heads, runs


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    sources: Callable[[object, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """``id, n_words, runs, collapsed`` per row: runs by start and period, and the text without repetitions.

    Words are maximal stretches without ASCII white space; equality is that of their bytes. A run has a smallest
    period q (words q apart are equal), at least six words and four periods, and no neighbouring word extends it.
    ``collapsed`` joins by one space the words that no run holds after its first q words.

    ``sources(id, n)`` may name, per text, the words to read in place of its own.

    A null, empty or blank text has no words and no runs and collapses to an empty text. Rows are independent:
    equal rows and rows of one id give equal rows, null ids pass through, an empty table gives no rows, and
    other columns are not read. A text is worked off as a whole in one task, with memory in proportion to its
    words times the logarithm of their number.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    shape = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def find(batches):
        for batch in batches:
            ids = batch.column(0)
            data, offsets, _ = tb.batch_texts(batch.column(1))
            for first, last in tb.row_slices(offsets):
                part, borders = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                named = sources and (lambda row, n, first=first: sources(ids[first + row].as_py(), n))
                start, end, heads, runs = text_runs(part, borders, named)
                texts = []
                content = part.tobytes()
                for row, found in enumerate(runs):
                    a, b = heads[row], heads[row + 1]
                    keep = np.ones(b - a, dtype=bool)
                    for s, length, q in found:
                        keep[s + q : s + length] = False
                    bounds = zip(start[a:b][keep].tolist(), end[a:b][keep].tolist(), strict=True)
                    texts.append(b" ".join([content[x:y] for x, y in bounds]))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, last - first),
                        pa.array(np.diff(heads)),
                        pa.array([[dict(zip(("start", "length", "period"), run)) for run in found] for found in runs], type=shape),
                        pa.array(texts, type=pa.binary()).cast(pa.string()),
                    ],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    texts = docs.select(F.col(id_column).alias("id"), text_column)
    return texts.mapInArrow(find, f"id {kind}, n_words long, runs {RUNS}, collapsed string")
