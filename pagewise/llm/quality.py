"""Quality rules as a short-circuit cascade.

Every rule is a predicate on one text that says whether to reject it. On a bounded sample the next
rule is chosen again and again: of the texts that the rules before it leave, and with the features
that these have computed, each rule's cost (seconds a text) and selectivity (part rejected) are
estimated, and the one with the most rejection per cost goes next. A text leaves at the first rule
that rejects it. A text is kept when no rule rejects it, so the verdict doesn't depend on the order,
nor on the sample.

Edge cases: a null or empty text has no words and is rejected by the word count; features of a
text without words or lines are 0; other columns pass through untouched, those named like an added
one with `_given` after their name; an empty table gives an empty result and keeps the declared
order.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, byte_texts, column, gram_hashes, sampled, set_aside

#: Texts at most of which costs and selectivities are estimated, and characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 256, 20_000
SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = re.compile(rb"[#*$%&|<>]")


class Features:
    """What rules ask about one text; each is computed on demand, once."""

    __slots__ = ("_hashes", "_known", "raw")

    def __init__(self, raw: bytes | None, hashes: WordHashes, known: dict | None = None):
        """known: features that have been computed already."""
        self.raw, self._hashes, self._known = raw or b"", hashes, {} if known is None else known

    def __getattr__(self, name: str):
        known = self._known
        if name not in known:
            known[name] = getattr(type(self), f"_{name}")(self)
        return known[name]

    def _words(self):
        return self.raw.split()

    def _lines(self):
        return [x for x in self.raw.split(b"\n") if x.strip(SPACES)]

    def _n_words(self):
        return len(self.words)

    def _word_chars(self):
        return len(b"".join(self.words).decode())

    def _n_symbols(self):
        return len(_SYMBOLS.findall(self.raw))

    def _n_lines(self):
        return len(self.lines)

    def _n_dup_lines(self):
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self):
        if self.n_words < 3:
            return 0
        g = gram_hashes(self._hashes.of(self.words), 3)
        _, which, n = np.unique(g, return_inverse=True, return_counts=True)
        twice = n[which] >= 2
        covered = np.zeros(self.n_words, bool)
        for k in range(3):
            covered[k : k + len(g)] |= twice
        return int(covered.sum())

    def _top_word_share(self):
        return Counter(self.words).most_common(1)[0][1] / self.n_words if self.n_words else 0.0

    def _alpha_words(self):
        return sum(any(c.isalpha() for c in w.decode()) for w in self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


#: Thresholds as widely published for web prose (words, symbols to words, repeated lines and
#: n-grams, word lengths, words with a letter), on the lenient side.
RULES = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("repeated_lines", lambda f: 100 * f.n_dup_lines > 60 * f.n_lines),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 15 * f.n_words),
    Rule("no_letters", lambda f: 10 * f.alpha_words < 7 * f.n_words),
    Rule("one_word", lambda f: f.top_word_share > 0.3),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    cost: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.cost, 1e-9)


def estimate(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[Estimate]:
    """The cascade: cost and selectivity of each rule where it stands, from first to last."""
    hashes, found, open_ = WordHashes(), [], list(rules)
    left = [(t.encode() if t else b"", {}) for t in texts]
    while open_:
        tried = []
        for rule in open_:
            at = [Features(raw, hashes, dict(known)) for raw, known in left]
            began = time.perf_counter()
            verdicts = [bool(rule.rejects(f)) for f in at]
            spent = time.perf_counter() - began
            # one more rejection and text than seen, so that a rule that rejects nothing still ranks by cost
            tried.append((Estimate(rule, spent / max(1, len(left)), (sum(verdicts) + 1) / (len(left) + 2)), verdicts, at))
        best, verdicts, at = max(tried, key=lambda x: x[0].rank)
        found.append(best)
        open_.remove(best.rule)
        left = [(f.raw, f._known) for f, gone in zip(at, verdicts, strict=True) if not gone]
    return found


def plan(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Estimate]:
    """The cascade, from a sample of SAMPLE_ROWS texts at most, SAMPLE_CHARS of each."""
    rows = sampled(docs, SAMPLE_ROWS).select(F.substring("text", 1, SAMPLE_CHARS)).collect()
    return estimate([r[0] for r in rows], rules)


def judge(spark: SparkSession, docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, measures: tuple[str, ...] = ()) -> DataFrame:
    """docs with columns kept boolean, and of `measures` (names of features) as long.

    The cascade stops at the first rejection; measures are computed for every text, as asked for.
    """
    order = [e.rule for e in plan(spark, docs, rules)]
    added = ["kept", *measures]
    docs, _ = set_aside(docs, added)
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["kept boolean", *[f"{m} bigint" for m in measures]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            kept, values = [], [[] for _ in measures]
            for raw in byte_texts(batch.column(batch.schema.get_field_index("text"))):
                f = Features(raw, hashes)
                kept.append(not any(rule.rejects(f) for rule in order))
                for m, out in zip(measures, values, strict=True):
                    out.append(int(getattr(f, m)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.bool_()), *[pa.array(v, pa.int64()) for v in values]], names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, schema)


def filtered(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    _, names = set_aside(docs, ["kept"])
    return judge(spark, docs, rules=rules).filter("kept").select(*[column(names.get(c, c)).alias(c) for c in docs.columns])
