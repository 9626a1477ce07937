"""Weak supervision for quality: rules vote or abstain, EM finds how far each is to be trusted.

A rule's vote is 1 (good), -1 (bad) or 0 (abstains). Votes are independent given the
class; each rule has its own chance to vote well of a good and badly of a bad document.
Expectation-maximisation runs on the counts of vote patterns, of which there are at most
3 to the number of rules whatever the number of documents. A document's posterior
quality replaces the usual all-must-pass filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import covered, fresh, grams, in_arrow, slices, word_hasher

SYMBOLS, SEPARATORS, WINDOW = "#*$%&|<>", " \t\n\x0b\x0c\r", 8
MIN_WORDS = 20
LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower",
         "n_digits", "n_loud", "n_chars", "n_ends")
STATS = T.StructType([T.StructField(c, T.LongType()) for c in LONGS])
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SYMBOLS = SYMBOLS.encode()


def _one(text: str) -> tuple[list[bytes], tuple]:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    less = lambda cut: len(raw) - len(raw.translate(None, cut))
    ends = sum(x.rstrip(SEPARATORS)[-1] in ".!?:;\"'»”…" for x in lines)
    return words, (len(text) - sum(map(text.count, SEPARATORS)), less(_SYMBOLS), len(lines) - len(set(lines)), len(lines),
                   less(_UPPER), less(_LOWER), less(_DIGITS), raw.count(b"!") + raw.count(b"?"), len(text), ends)


def text_stats(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The columns of ``STATS`` for whole texts; a null text has no words."""
    hashes, spans, rest, at = [], [], [], 0
    hasher = word_hasher()
    for text in texts:
        words, row = _one(text or "")
        hashes.append(hasher(words))
        spans.append((at, at := at + len(words)))
        rest.append(row)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), [b - a for a, b in spans])
    salt = doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    n_words = np.array([b - a for a, b in spans], np.int64)
    repeat = np.zeros(len(texts), np.int64)
    if len(h) >= WINDOW:
        g = grams(h, WINDOW)
        whole = np.flatnonzero(doc[:len(g)] == doc[WINDOW - 1:])
        _, where, times = np.unique(g[whole] ^ salt[whole], return_inverse=True, return_counts=True)
        hit = np.zeros(len(h), bool)
        hit[whole[times[where] > 1]] = True
        np.add.at(repeat, doc[covered(hit, WINDOW, len(h))], 1)
    distinct = np.bincount(doc[_firsts(h ^ salt)], minlength=len(texts))
    chars, symbols, dups, lines, upper, lower, digits, loud, n_chars, ends = (np.array(x, np.int64) for x in zip(*rest)) if rest else [np.empty(0, np.int64)] * 10
    return dict(n_words=n_words, word_chars=chars, n_symbols=symbols, n_dup_lines=dups, n_repeat_words=repeat, n_lines=lines,
                n_distinct=distinct, n_upper=upper, n_lower=lower, n_digits=digits, n_loud=loud, n_chars=n_chars, n_ends=ends)


def _firsts(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_index=True)[1]


def with_stats(docs: DataFrame, name: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct of ``STATS`` as ``name``."""
    keep = docs.columns if keep is None else keep
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, STATS)])
    fields = [pa.field(c, pa.int64()) for c in LONGS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            made = text_stats(batch.column(text).to_pylist())
            stats = pa.StructArray.from_arrays([pa.array(made[c].astype(np.int64)) for c in LONGS], fields=fields)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), stats], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).transform(in_arrow, run, schema)


def base_failed(s: Column) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def _rule(value: Column, bad: Column, good: Column | None = None) -> Column:
    vote = F.when(value.isNull(), 0).when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def default_rules(s: Column) -> dict[str, Column]:
    """Votes by rule name. A rule without evidence, such as one on lines for a one-line text, abstains."""
    share = lambda a, b: F.when(b > 0, a / b)
    letters = s["n_upper"] + s["n_lower"]
    length, symbols = share(s["word_chars"], s["n_words"]), share(s["n_symbols"], s["n_words"])
    upper, loud = F.when(letters >= 20, s["n_upper"] / letters), share(s["n_loud"], s["n_words"])
    repeats, digits = share(s["n_repeat_words"], s["n_words"]), share(s["n_digits"], s["word_chars"])
    dups = F.when(s["n_lines"] >= 3, s["n_dup_lines"] / s["n_lines"])
    variety = F.when(s["n_words"] >= 50, s["n_distinct"] / F.sqrt(s["n_words"].cast("double")))
    ends = F.when(s["n_lines"] >= 3, s["n_ends"] / s["n_lines"])
    return {
        "word_length": _rule(length, (length < 2.5) | (length > 14), (length >= 3.5) & (length <= 9)),
        "symbols": _rule(symbols, symbols > 0.1),
        "few_symbols": _rule(symbols, symbols > 0.5, symbols < 0.02),
        "capitals": _rule(upper, upper > 0.5, upper < 0.15),
        "shouting": _rule(loud, loud > 0.3, loud < 0.1),
        "repeats": _rule(repeats, repeats > 0.3, repeats < 0.1),
        "same_lines": _rule(dups, dups > 0.3),
        "digits": _rule(digits, digits > 0.3),
        "variety": _rule(variety, variety < 2.0, variety > 4.0),
        "sentences": _rule(ends, ends < 0.1, ends > 0.6),
        "length": _rule(s["n_words"], s["n_words"] < MIN_WORDS),
    }


@dataclass
class LabelModel:
    """Class balance and, per rule, the chance of each vote (-1, 0, 1) given bad and good."""

    rules: list[str]
    prior: float
    votes: np.ndarray

    def log_odds(self, votes: dict[str, Column]) -> Column:
        """Log posterior odds of good against bad."""
        out = F.lit(math.log(self.prior / (1 - self.prior)))
        for k, name in enumerate(self.rules):
            bad, none, good = (float(x) for x in np.log(self.votes[k, 1] / self.votes[k, 0]))
            out = out + F.when(votes[name] == -1, bad).when(votes[name] == 1, good).otherwise(none)
        return out

    def posterior(self, votes: dict[str, Column]) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(votes)))

    def accuracy(self) -> dict[str, float]:
        """How often a rule that votes is right, by the model."""
        bad, good = (1 - self.prior) * self.votes[:, 0], self.prior * self.votes[:, 1]
        cast = bad[:, [0, 2]].sum(1) + good[:, [0, 2]].sum(1)
        return {r: float(x) for r, x in zip(self.rules, (bad[:, 0] + good[:, 2]) / cast)}


#: Before any document: the share of good ones, and a rule's chances of -1, 0, 1 on a bad and on a good document.
PRIOR, START = 0.85, np.array([[0.30, 0.55, 0.15], [0.01, 0.39, 0.60]])


def fit(patterns: np.ndarray, counts: np.ndarray, rules: list[str], rounds: int = 300, strength: float = 50.0) -> LabelModel:
    """EM over vote patterns (rows of -1, 0, 1) with their counts.

    The starting chances count as ``strength`` documents of each class, so that a rule that
    hardly votes keeps them and the classes can't change places. No documents: the start.
    """
    start = np.repeat(START[None], len(rules), 0)
    model = LabelModel(list(rules), PRIOR, start)
    if not len(counts):
        return model
    n = np.asarray(counts, float)
    cast = np.stack([np.asarray(patterns) == v for v in (-1, 0, 1)], 2).astype(float)  # pattern, rule, vote
    for _ in range(rounds):
        odds = math.log(model.prior / (1 - model.prior)) + np.einsum("prv,rv->p", cast, np.log(model.votes[:, 1] / model.votes[:, 0]))
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        seen = np.stack([np.einsum("p,prv->rv", n * p, cast) for p in (1 - good, good)], 1)  # rule, class, vote
        votes = (seen + strength * start) / (seen.sum(2, keepdims=True) + strength)
        prior = float((n @ good + PRIOR * strength) / (n.sum() + strength))
        done = np.abs(votes - model.votes).max() < 1e-9 and abs(prior - model.prior) < 1e-9
        model = LabelModel(list(rules), prior, votes)
        if done:
            break
    return model


def fit_votes(votes: DataFrame, rules: list[str]) -> LabelModel:
    """Fit on a table with one vote column per rule; only pattern counts reach the driver, at most 3 ** rules rows."""
    rows = votes.groupBy(*rules).count().orderBy(*rules).collect()
    return fit(np.array([r[:-1] for r in rows], np.int64).reshape(-1, len(rules)), np.array([r[-1] for r in rows], float), rules)


def passes(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that quality keeps: no base rule fails and the posterior reaches ``threshold``.

    Null and empty texts have no words and fail. Repeated rows are judged alike; other
    columns pass through; an empty table gives an empty result.
    """
    name = fresh(docs, "_stats")
    narrow = with_stats(docs.select("text"), name, keep=[])
    rules = default_rules(F.col(name))
    model = fit_votes(narrow.select(*(v.alias(k) for k, v in rules.items())), list(rules))
    judged = with_stats(docs, name)
    keep = ~base_failed(F.col(name)) & (model.posterior(default_rules(F.col(name))) >= threshold)
    return judged.where(keep).select(*docs.columns)
