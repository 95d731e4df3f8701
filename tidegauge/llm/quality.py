"""Quality by weak supervision: rules that vote or abstain, combined by their accuracies.

Each rule looks at a document's statistics and votes good (+1), bad (-1) or abstains
(0).  A label model (the prior of good documents and, per rule, how likely each vote is
in good and in bad ones, hence its accuracy) is fitted to the votes alone by
expectation maximisation, and a document is kept if its
posterior probability of being good reaches ``THRESHOLD``.

The fit sees only counts of equal vote patterns, of which there are at most
3^rules, summed by Spark over all documents; the number of rows does not matter.

A null text counts as empty: no words, which fails the base rules.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.batches import annotate, buffer_of, encode, row_sums, word_spans

THRESHOLD = 0.5
#: Weight of the beliefs about a rule against what the votes say.
TRUST = 0.2
FIELDS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "n_lines bigint, n_upper bigint, n_letters bigint, n_ends bigint, max_word bigint, n_unlettered bigint, n_marks bigint")
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 0xC0)
_MARK = np.isin(np.arange(256), [ord(c) for c in "!?"])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def _same_before(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For rows of equal keys: whether an earlier equal row exists, and whether any other does."""
    n = len(keys[0])
    order = np.lexsort(keys[::-1])
    equal = np.ones(max(0, n - 1), bool)
    for k in keys:
        equal &= k[order[1:]] == k[order[:-1]]
    earlier, any_other = np.zeros(n, bool), np.zeros(n, bool)
    earlier[order[1:]] = equal
    any_other[order[1:]] = equal
    any_other[order[:-1]] |= equal
    return earlier, any_other


def _before(marks: np.ndarray) -> np.ndarray:
    """How many marks stand before each place."""
    out = np.zeros(len(marks) + 1, np.int64 if len(marks) >= 2**31 else np.int32)
    np.cumsum(marks, out=out[1:])
    return out


def statistics(texts: pa.Array) -> list[np.ndarray]:
    """The columns of ``FIELDS`` for a batch."""
    raw, offsets = buffer_of(texts)
    n = len(offsets) - 1
    starts, ends, rows = word_spans(raw, offsets)
    codes, _ = encode(raw, starts, ends)
    lead = _before((raw & 0xC0) != 0x80)  # code points before each byte
    word_len = lead[ends] - lead[starts]
    letters = _before(_LETTER[raw])
    by_byte = lambda table: row_sums(table[raw], offsets)

    # Lines: split at \n, so rows begin lines as well.
    inner = offsets[1:-1]
    begins = np.zeros(len(raw) + 1, bool)
    begins[np.flatnonzero(raw == 10) + 1] = True
    begins[inner] = True
    begins[[0, -1]] = [True, False]
    at = np.flatnonzero(begins)
    line_end = np.append(at[1:], len(raw))
    if len(at):
        line_end = line_end - ((line_end > at) & (raw[np.maximum(line_end - 1, 0)] == 10) if len(raw) else 0)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, at)
    at, line_end = at[has_word], line_end[has_word]
    line_row = np.searchsorted(offsets, at, "right") - 1
    line_code, _ = encode(raw, at, line_end)
    dup, _ = _same_before((line_code, line_row))

    # Three-word windows found twice or more in a text.
    word_row = np.repeat(np.arange(n), np.diff(rows))
    repeated = np.zeros(len(codes), bool)
    if len(codes) > 2:
        inside = word_row[2:] == word_row[:-2]
        first = np.flatnonzero(inside)
        c = codes.astype(np.int64)
        top = int(c.max()) + 1
        pair = c[first] * top + c[first + 1]
        key = (pair, c[first + 2]) if top > 2_000_000 else (pair * top + c[first + 2],)
        _, other = _same_before((*key, word_row[first]))
        for k in range(3):
            repeated[first[other] + k] = True
    word_max = np.zeros(n, np.int64)
    filled = np.flatnonzero(np.diff(rows) > 0)
    if len(filled):
        word_max[filled] = np.maximum.reduceat(word_len, rows[filled])
    stop_end = _STOP[raw[line_end - 1]] if len(line_end) else np.zeros(0, bool)
    return [np.diff(rows), row_sums(word_len, rows), by_byte(_SYMBOL), np.bincount(line_row[dup], minlength=n),
            row_sums(repeated.astype(np.int64), rows), np.bincount(line_row, minlength=n), by_byte(_UPPER), by_byte(_LETTER),
            np.bincount(line_row[stop_end], minlength=n), word_max, row_sums((letters[ends] == letters[starts]).astype(np.int64), rows),
            by_byte(_MARK)]


def base_failed(s: Column) -> Column:
    """The rules that no vote can outweigh: too few words, or mostly repeated ones."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def votes(s: Column) -> list[Column]:
    """One vote per rule: bad beyond one bound, good within another, else abstain."""
    n = F.greatest(s["n_words"], F.lit(1))
    lines = F.greatest(s["n_lines"], F.lit(1))
    letters = F.greatest(s["n_letters"], F.lit(1))

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    mean = s["word_chars"] / n
    return [
        rule(s["n_symbols"] > 0.1 * n, s["n_symbols"] <= 0.02 * n),
        rule(s["n_symbols"] > 0.5 * n, s["n_symbols"] <= 0.1 * n),
        rule(s["n_dup_lines"] > 0.3 * lines, s["n_dup_lines"] == 0),
        rule(s["n_repeat_words"] > 0.2 * n, s["n_repeat_words"] <= 0.05 * n),
        rule((mean < 2.5) | (mean > 12), (mean >= 3) & (mean <= 10)),
        rule(s["n_upper"] > 0.4 * letters, s["n_upper"] <= 0.15 * letters),
        rule(s["n_words"] < 50, s["n_words"] >= 80),
        rule(s["n_ends"] < 0.1 * lines, s["n_ends"] >= 0.5 * lines),
        rule(s["max_word"] > 1000, s["max_word"] <= 60),
        rule(s["n_unlettered"] > 0.2 * n, s["n_unlettered"] <= 0.05 * n),
        rule(s["n_marks"] > 0.2 * n, s["n_marks"] <= 0.1 * n),
    ]


RULES = 11


class Model(NamedTuple):
    """Prior of good, and the probability of each rule's votes (-1, 0, +1) in bad and in good documents."""

    prior: float
    votes: np.ndarray  # 2 x rules x 3

    @property
    def accuracy(self) -> np.ndarray:
        """Per rule, how often a vote that is cast is right."""
        share = np.array([1 - self.prior, self.prior])[:, None, None] * self.votes
        return (share[0, :, 0] + share[1, :, 2]) / (share[..., 0] + share[..., 2]).sum(0)


def _posterior(patterns: np.ndarray, model: Model) -> np.ndarray:
    base, weights = _weights(model)
    odds = base + sum(weights[r][patterns[:, r] + 1] for r in range(patterns.shape[1]))
    return 1 / (1 + np.exp(-odds))


def _weights(model: Model) -> tuple[float, np.ndarray]:
    """Log odds of the prior, and of each rule's vote -1, 0 and +1."""
    return math.log(model.prior / (1 - model.prior)), np.log(model.votes[1] / model.votes[0])


def fit(patterns: np.ndarray, counts: np.ndarray, trust: float = TRUST, rounds: int = 500) -> Model:
    """Expectation maximisation over distinct vote patterns and how often each occurs.

    What is believed of a rule beforehand (bad votes are rare among good documents and
    not among bad ones) keeps a weight of ``trust`` throughout, so the classes cannot
    change places and no probability is zero.  A rule that comes out misleading (a bad
    vote likelier among good documents) counts for nothing.
    """
    rules = patterns.shape[1]
    believed = np.stack([np.tile([0.4, 0.2, 0.4], (rules, 1)), np.tile([0.01, 0.19, 0.8], (rules, 1))])
    model = Model(0.8, believed)
    cast = np.stack([patterns == v for v in (-1, 0, 1)], 2)
    total = float(counts.sum())
    for _ in range(rounds):
        p = _posterior(patterns, model)
        tables = []
        for weight, belief in zip((counts * (1 - p), counts * p), believed, strict=True):
            table = (weight[:, None, None] * cast).sum(0) + belief
            tables.append((1 - trust) * table / table.sum(1, keepdims=True) + trust * belief)
        votes_ = np.stack(tables)
        misled = votes_[1, :, 0] > votes_[0, :, 0]
        votes_[:, misled] = votes_[:, misled].mean(0)
        new = Model(float(np.clip((counts * p).sum() / total, 0.05, 0.95)) if total else 0.5, votes_)
        done = abs(new.prior - model.prior) < 1e-9 and np.abs(new.votes - model.votes).max() < 1e-9
        model = new
        if done:
            break
    return model


def posterior(vote_columns: list[Column], model: Model) -> Column:
    """The probability of good as an expression over votes."""
    base, weights = _weights(model)
    odds = reduce(lambda a, b: a + b, [F.when(v == 1, float(w[2])).when(v == -1, float(w[0])).otherwise(float(w[1]))
                                       for v, w in zip(vote_columns, weights, strict=True)], F.lit(base))
    return 1 / (1 + F.exp(-odds))


def fit_votes(measured: DataFrame) -> Model:
    """Fit the label model to a frame with the struct ``out`` of statistics: all rows that pass the base rules."""
    names = [f"v{i}" for i in range(RULES)]
    rows = (measured.where(~base_failed(F.col("out"))).select(*[v.alias(n) for v, n in zip(votes(F.col("out")), names, strict=True)])
            .groupBy(*names).count().collect())  # at most 3^rules rows
    patterns = np.array([[r[n] for n in names] for r in rows], np.int64).reshape(-1, RULES)
    return fit(patterns, np.array([r["count"] for r in rows], float))


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``out``, a struct of the statistics."""
    return annotate(docs, text, lambda: statistics, FIELDS, keep)


def judge(measured: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Adds base_failed, quality (the posterior) and kept."""
    s = F.col("out")
    return (measured.withColumn("base_failed", base_failed(s))
            .withColumn("quality", posterior(votes(s), model))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))
