"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Blocks have features of their enclosing tags, of words in ``class``, ``id`` and ``role``, and of their text. The
field scores a label (main text or not) per block and per pair of neighbours, is trained on labelled pages by
the gradient of the log likelihood, and decoded by Viterbi.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hazegrid.llm import training_pages
from hazegrid.llm.dom import Block, leaf_blocks

PENALTY, STEPS, RATE = 1e-3, 150, 0.25


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the active features of each block."""
    found, n = [], len(blocks)
    for i, block in enumerate(blocks):
        words = block.text.count(" ") + 1
        size = min(6, int(np.log2(words + 1)))
        own = [
            "bias",
            f"leaf:{block.tags[-1] if block.tags else 'none'}",
            f"words:{size}",
            f"linked:{int(block.linked * 4)}",
            f"bold:{int(block.bold * 2)}",
            f"end:{block.text[-1] if block.text[-1] in '.!?:' else 'other'}",
            f"sentences:{min(4, block.text.count('. ') + block.text.count('.') // 2)}",
        ]
        own += [f"in:{tag}" for tag in set(block.tags)]
        own += [f"name:{name}" for name in block.names]
        if "article" not in block.tags and "main" not in block.tags:
            own.append(f"outside:{size}")
        if any(sign in block.text for sign in ("©", "®", "(c)")):
            own.append("rights")
        if i == 0:
            own.append("first")
        if i == n - 1:
            own.append("last")
        found.append(own)
    return found


@dataclass
class ChainField:
    """Weights per feature and label, and per pair of neighbouring labels; label 1 is main text."""

    weights: dict[str, tuple[float, float]]
    pairs: np.ndarray

    def scores(self, blocks: list[Block]) -> np.ndarray:
        known = self.weights
        out = np.zeros((len(blocks), 2))
        for i, names in enumerate(features(blocks)):
            for name in names:
                pair = known.get(name)
                if pair is not None:
                    out[i, 0] += pair[0]
                    out[i, 1] += pair[1]
        return out

    def labels(self, blocks: list[Block]) -> list[int]:
        """The best labelling of the chain (Viterbi); ties go to label 0."""
        if not blocks:
            return []
        scores = self.scores(blocks).tolist()
        (p00, p01), (p10, p11) = self.pairs.tolist()
        best0, best1 = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            from0, from1 = int(best1 + p10 > best0 + p00), int(best1 + p11 > best0 + p01)
            best0, best1 = (best1 + p10 if from0 else best0 + p00) + s0, (best1 + p11 if from1 else best0 + p01) + s1
            back.append((from0, from1))
        label = int(best1 > best0)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def _expected(scores: np.ndarray, pairs: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of labels and summed chances of label pairs, for padded chains (pages x blocks x labels)."""
    pages, length, _ = scores.shape
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for t in range(1, length):
        step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + pairs, axis=1) + scores[:, t]
        ahead[:, t] = np.where(there[:, t, None], step, ahead[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = np.logaddexp.reduce(pairs + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
        behind[:, t] = np.where(there[:, t + 1, None], step, 0.0)
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)
    single = np.exp(ahead + behind - total[:, None, None]) * there[:, :, None]
    both = ahead[:, :-1, :, None] + pairs + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
    both = np.exp(np.where(there[:, 1:, None, None], both, -np.inf))
    return single, both.sum(axis=(0, 1))


def train(pages: list[tuple[list[Block], list[int]]]) -> ChainField:
    """Maximum likelihood with an L2 penalty; steps adapt to each weight's past gradients."""
    pages = [(blocks, labels) for blocks, labels in pages if blocks]
    named = [features(blocks) for blocks, _ in pages]
    index = {name: i for i, name in enumerate(sorted({n for page in named for names in page for n in names}))}
    length = max(map(len, named))
    there = np.zeros((len(pages), length), dtype=bool)
    truth = np.zeros((len(pages), length, 2))
    flat, column = [], []
    for p, (page, (_, labels)) in enumerate(zip(named, pages, strict=True)):
        there[p, : len(page)] = True
        truth[p, np.arange(len(page)), labels] = 1
        for t, names in enumerate(page):
            flat += [p * length + t] * len(names)
            column += [index[n] for n in names]
    flat, column = np.array(flat), np.array(column)
    seen_pairs = np.einsum("pti,ptj->ij", truth[:, :-1], truth[:, 1:])
    weights, pairs = np.zeros((len(index), 2)), np.zeros((2, 2))
    past_w, past_p = np.full_like(weights, 1e-8), np.full_like(pairs, 1e-8)
    for _ in range(STEPS):
        scores = np.zeros((len(pages) * length, 2))
        np.add.at(scores, flat, weights[column])
        single, both = _expected(scores.reshape(len(pages), length, 2), pairs, there)
        gap = (truth - single).reshape(-1, 2)
        grad = np.zeros_like(weights)
        np.add.at(grad, column, gap[flat])
        grad, grad_p = grad / len(pages) - PENALTY * weights, (seen_pairs - both) / len(pages) - PENALTY * pairs
        past_w += grad**2
        past_p += grad_p**2
        weights += RATE * grad / np.sqrt(past_w)
        pairs += RATE * grad_p / np.sqrt(past_p)
    return ChainField({name: (float(weights[i, 0]), float(weights[i, 1])) for name, i in index.items()}, pairs)


@functools.lru_cache(maxsize=1)
def default_field() -> ChainField:
    """Trained once per process on the labelled pages of ``training_pages``."""
    return train([training_pages.labelled_blocks(i) for i in range(training_pages.PAGES)])


def main_text(field: ChainField, page: str | None) -> str:
    """Main blocks joined by line ends; empty for a null or empty page."""
    if not page:
        return ""
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, label in zip(blocks, field.labels(blocks), strict=True) if label)


def extract_main_text(pages: DataFrame, html_column: str = "html", text_column: str = "text", field: ChainField | None = None) -> DataFrame:
    """Every row without its page source but with the main text, which replaces a column of that name.

    Character references are decoded and white space inside a block is one space. Null, empty and textless
    pages give an empty text; the whole page is read, however long. Rows are worked off one by one, so
    repeated rows, null keys and further columns pass through as they are.
    """
    field = default_field() if field is None else field
    kept = [c for c in pages.columns if c not in (html_column, text_column)]
    place = len(kept)
    source = pages.select(*[f"`{c}`" for c in kept], f"`{html_column}`")
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), f"`{text_column}` string"])

    def extract(batches):
        for batch in batches:
            texts = pa.array([main_text(field, page) for page in batch.column(place).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], texts], names=[*kept, text_column])

    return source.mapInArrow(extract, schema)
