"""Quality rules as weak supervision: vote or abstain, estimate accuracies, keep by posterior.

Each rule votes good (1), bad (-1) or abstains (0). The counts of vote patterns,
at most 3 ** rules rows whatever the input, are all that expectation-maximisation
needs; it estimates how often each rule votes which way on good and on bad
documents. The posterior probability of "good" replaces the demand that every
rule must pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.storage import stored
from feedloom.llm.text_arrays import blocks, mix, window_hashes

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_letters", "n_upper", "n_alpha_words", "n_shouts", "n_distinct_words", "n_plain_ends", "n_stutters")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
PLAIN_END = np.zeros(256, bool)  # letters, digits, bytes beyond ASCII and usual closing marks
PLAIN_END[list(b".,;:!?)\"'")] = True
PLAIN_END[48:58] = PLAIN_END[65:91] = PLAIN_END[97:123] = PLAIN_END[128:] = True
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30  # per cent of the words


def _distinct(owner: np.ndarray, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per document, and for each value whether it is found again in its document."""
    own = hashes ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own)
    ranked = own[order]
    new = np.ones(len(own), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    again = ~new
    again[:-1] |= ~new[1:]
    flags = np.zeros(len(own), bool)
    flags[order[again]] = True
    return np.bincount(owner[order[new]], minlength=n_docs), flags


def block_stats(block) -> dict[str, np.ndarray]:
    """The counts of every document of a block."""
    data, n = block.data, block.n_docs
    starts, ends, owner = block.words()
    count = lambda flags: np.bincount(owner[flags], minlength=n)
    inside = np.zeros(len(data) + 1, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    np.cumsum(((data & 0xC0) != 0x80) & ~space, out=inside[1:])
    letters = ((data | 32) >= 97) & ((data | 32) <= 122)
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letters | (data >= 0x80), out=upto[1:])
    hashes = block.hasher()(starts, ends)

    first, stop, line_of = block.lines()
    last_word = np.searchsorted(starts, stop)
    filled = last_word > np.searchsorted(starts, first)
    line_hash = block.hasher(None, 1)(first[filled], stop[filled])
    n_filled = np.bincount(line_of[filled], minlength=n)
    different, _ = _distinct(line_of[filled], line_hash, n)

    at, windows = window_hashes(hashes, owner, WINDOW)
    _, again = _distinct(owner[at], windows, n)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + WINDOW, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": inside[block.offsets[1:]] - inside[block.offsets[:-1]],
        "n_symbols": block.per_doc(SYMBOLS[data]),
        "n_dup_lines": n_filled - different,
        "n_repeat_words": count(repeated),
        "n_lines": n_filled,
        "n_letters": block.per_doc(letters),
        "n_upper": block.per_doc(letters & (data < 97)),
        "n_alpha_words": count(upto[ends] > upto[starts]),
        "n_shouts": count(data[ends - 1] == 33),
        "n_distinct_words": _distinct(owner, hashes, n)[0],
        "n_plain_ends": count(PLAIN_END[data[ends - 1]]),
        "n_stutters": np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=n),
    }


def text_stats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of each whole text (a null text has no words)."""
    names = [*STATS, *MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                found = block_stats(block)
                own = batch.column("doc_id").slice(block.first, block.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [own, *(pa.array(found[c].astype(np.int64)) for c in names)], names=["doc_id", *names]
                )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(F.col("n_words") == 0, 0).when(bad, -1).when(good, 1).otherwise(0)


def default_rules() -> dict[str, Column]:
    """Votes of the rules as columns over the counts; between its two limits a rule abstains."""
    length = _share("word_chars", "n_words")
    symbols = _share("n_symbols", "n_words")
    lines = _share("n_dup_lines", "n_lines")
    again = _share("n_repeat_words", "n_words")
    upper = _share("n_upper", "n_letters")
    alpha = _share("n_alpha_words", "n_words")
    shouts = _share("n_shouts", "n_words")
    variety = _share("n_distinct_words", "n_words")
    density = _share("n_symbols", "word_chars")
    ends = _share("n_plain_ends", "n_words")
    stutter = _share("n_stutters", "n_words")
    return {
        "word_length": _vote(length, length.between(3.5, 9), (length < 2.5) | (length > 12)),
        "symbols": _vote(symbols, symbols < 0.02, symbols > 0.1),
        "lines": _vote(lines, (lines == 0) & (F.col("n_lines") >= 3), lines > 0.3),
        "repetition": _vote(again, again < 0.05, again > 0.2),
        "upper_case": _vote(upper, upper < 0.15, upper > 0.4),
        "alphabetic": _vote(alpha, alpha > 0.95, alpha < 0.8),
        "shouting": _vote(shouts, shouts < 0.02, shouts > 0.15),
        "variety": _vote(variety, variety > 0.3, variety < 0.1),
        "symbol_density": _vote(density, density < 0.005, density > 0.05),
        "word_ends": _vote(ends, ends > 0.9, ends < 0.7),
        "stutter": _vote(stutter, stutter < 0.02, stutter > 0.15),
    }


@dataclass
class VoteModel:
    """Class prior and, for each rule, the log-probabilities of (bad, abstain, good) votes by class."""

    prior: float
    good: list[list[float]]
    bad: list[list[float]]

    def posterior(self, votes: list[Column]) -> Column:
        score = F.lit(math.log(self.prior) - math.log(1 - self.prior))
        for vote, g, b in zip(votes, self.good, self.bad):
            lift = [x - y for x, y in zip(g, b)]
            score = score + F.when(vote < 0, lift[0]).when(vote > 0, lift[2]).otherwise(lift[1])
        return F.lit(1.0) / (1 + F.exp(-score))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, smooth: float = 1.0, still: float = 1e-9) -> VoteModel:
    """Expectation-maximisation over vote patterns and their counts.

    It starts from the number of bad votes, which fixes what "good" means (most
    rules have nothing to say on most faults, so one objection weighs more than
    many approvals), and goes on until no posterior moves by ``still``. Rules are taken as
    independent given the class.
    """
    n_rules = patterns.shape[1] if patterns.ndim == 2 else 0
    if not len(patterns) or not counts.sum():
        flat = [[math.log(1 / 3)] * 3] * n_rules
        return VoteModel(0.5, flat, flat)
    good = np.array([0.95, 0.4, 0.1])[np.minimum(2, (patterns < 0).sum(1))]
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    moved = 1.0
    while moved >= still:
        weight = [counts * good, counts * (1 - good)]
        prior = np.clip(weight[0].sum() / counts.sum(), 1e-6, 1 - 1e-6)
        logs = []
        for w in weight:
            found = np.einsum("p,prv->rv", w, onehot) + smooth
            logs.append(np.log(found / found.sum(1, keepdims=True)))
        lift = np.einsum("prv,rv->p", onehot, logs[0] - logs[1]) + math.log(prior / (1 - prior))
        now = 1 / (1 + np.exp(-np.clip(lift, -500, 500)))
        moved = np.abs(now - good).max()
        good = now
    return VoteModel(float(prior), logs[0].tolist(), logs[1].tolist())


def quality_rules(docs: DataFrame, rules: dict[str, Column] | None = None, keep_from: float = 0.5) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept``, ``posterior`` and one vote column for each rule.

    ``base_failed``: under 20 words, or over 30 % of the words in 8-word windows
    that the text repeats. ``kept``: not ``base_failed`` and a posterior of at
    least ``keep_from``. The accuracies are estimated from the votes on all rows
    that the base check lets pass.

    Nulls: a null text has no words and fails the base check; a null doc_id stays
    null. Repeated rows are judged and counted as often as they occur. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    rules = rules or default_rules()
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    votes = [f"vote_{name}" for name in rules]
    judged = stored(
        text_stats(docs)
        .withColumn("base_failed", failed)
        .withColumns({v: rule.cast("int") for v, rule in zip(votes, rules.values())}),
        "votes",
    )
    # At most 3 ** rules rows.
    rows = judged.where(~F.col("base_failed")).groupBy(*votes).count().collect()
    patterns = np.array([[r[v] for v in votes] for r in rows], float).reshape(len(rows), len(votes))
    model = fit_votes(patterns, np.array([r["count"] for r in rows], float))
    posterior = model.posterior([F.col(v) for v in votes])
    return (
        judged.withColumn("posterior", posterior)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))
        .select("doc_id", *STATS, "base_failed", "kept", "posterior", *votes)
    )
