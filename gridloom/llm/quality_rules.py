"""Quality rules as a short-circuit cascade, ordered by rejection per cost as measured on a sample."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and selectivities are estimated; longer texts than SAMPLE_BYTES aren't drawn.
SAMPLE_ROWS, SAMPLE_BYTES = 256, 65_536
_CASED = re.compile(rb"[A-Z]{2}")
_LOWER = re.compile(rb"[a-z]")
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


class Features:
    """Counts of one text; each is computed when a rule first asks for it."""

    __slots__ = ("_upper", "_with_letter", "_dup", "_repeat", "_lines", "_symbols", "text", "words")

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = self.text.encode("utf-8", "surrogatepass").split()
        self._dup = self._repeat = self._lines = self._symbols = self._upper = self._with_letter = None

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_chars(self) -> int:
        t = self.text
        return len(t) - sum(t.count(c) for c in " \t\n\x0b\x0c\r")

    @property
    def n_symbols(self) -> int:
        if self._symbols is None:
            t = self.text
            self._symbols = sum(t.count(c) for c in SYMBOLS)
        return self._symbols

    def _count_lines(self) -> None:
        lines = [x for x in self.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        self._lines, self._dup = len(lines), len(lines) - len(set(lines))

    @property
    def n_lines(self) -> int:
        if self._lines is None:
            self._count_lines()
        return self._lines

    @property
    def n_dup_lines(self) -> int:
        if self._dup is None:
            self._count_lines()
        return self._dup

    @property
    def n_repeat_words(self) -> int:
        """Words that stand in a three-word window which the text has twice or more."""
        if self._repeat is None:
            w = self.words
            grams = list(zip(w, w[1:], w[2:], strict=False))
            self._repeat = 0
            if len(set(grams)) != len(grams):
                many = {g for g, n in Counter(grams).items() if n > 1}
                end = covered = 0
                for i, g in enumerate(grams):
                    if g in many:
                        covered += i + 3 - max(i, end)
                        end = i + 3
                self._repeat = covered
        return self._repeat

    @property
    def n_upper_words(self) -> int:
        if self._upper is None:
            self._upper = sum(1 for w in self.words if _CASED.search(w) and not _LOWER.search(w))
        return self._upper

    @property
    def n_letter_words(self) -> int:
        if self._with_letter is None:
            self._with_letter = sum(1 for w in self.words if _LETTER.search(w))
        return self._with_letter


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


#: The two rules that decide ``base_failed``.
BASE_RULES = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repetition", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)


def base_failed(f: Features) -> bool:
    return any(r.rejects(f) for r in BASE_RULES)


#: All compare whole numbers, so that SQL gives the same verdicts.
RULES = (
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("duplicate_lines", lambda f: 2 * f.n_dup_lines > f.n_lines),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 14 * f.n_words),
    Rule("shouting", lambda f: 10 * f.n_upper_words > 3 * f.n_words),
    Rule("few_letters", lambda f: 10 * f.n_letter_words < 7 * f.n_words),
)


def sample_texts(df: DataFrame, rows: int = SAMPLE_ROWS) -> list[str]:
    """At most ``rows`` whole texts of at most SAMPLE_BYTES bytes: those whose hash is smallest, so any input order gives the same.

    A threshold on the hash leaves about four times as many rows for the final choice, so tasks send next to nothing.
    """
    drawn = df.select("text", F.xxhash64("doc_id", F.lit(1)).alias("at"))
    drawn = drawn.where(F.pmod("at", F.lit(max(1, df.count()))) < 4 * rows).where(F.octet_length("text") <= SAMPLE_BYTES)
    return [r.text for r in drawn.orderBy("at", "text").limit(rows).collect()]


def primed(texts: list[str]) -> list[Features]:
    """Features with what every text pays whatever the order (its words) already there."""
    out = [Features(t) for t in texts]
    for f in out:
        f.n_words  # noqa: B018
    return out


def cost_of(rule: Rule, texts: list[str], passes: int = 3) -> float:
    """Seconds per text of the rule alone: the least of some passes after a warm one, each on features nothing else has computed."""
    best = float("inf")
    for _ in range(passes + 1):
        fresh = primed(texts)
        began = time.perf_counter()
        for f in fresh:
            rule.rejects(f)
        best = min(best, time.perf_counter() - began)
    return best / max(1, len(texts))


def estimate(rules: tuple[Rule, ...], survivors: list[Features], costs: dict[str, float]) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds per text): the share among the texts that no earlier rule rejected."""
    return [(r, sum(map(r.rejects, survivors)) / max(1, len(survivors)), costs[r.name]) for r in rules]


def order_rules(measured: list[tuple[Rule, float, float]]) -> tuple[Rule, ...]:
    """Most rejections per second first: the cheapest expected cascade of independent rules. Ties: by name."""
    return tuple(r for r, _, _ in sorted(measured, key=lambda x: (-x[1] / max(x[2], 1e-9), x[0].name)))


def cascade(f: Features, rules: tuple[Rule, ...]) -> str | None:
    """Name of the first rule that rejects; later rules and the counts only they need aren't computed."""
    return next((r.name for r in rules if r.rejects(f)), None)


def plan_cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, after: tuple[Rule, ...] = BASE_RULES) -> tuple[Rule, ...]:
    """The order of ``rules`` for texts that passed ``after``: the next is always the one with most rejections per second
    among the sampled texts that are still there."""
    texts = sample_texts(df)
    costs = {r.name: cost_of(r, texts) for r in rules}
    survivors = [f for f in primed(texts) if cascade(f, after) is None]
    left, out = tuple(rules), []
    while left:
        first = order_rules(estimate(left, survivors, costs))[0]
        out.append(first)
        left = tuple(r for r in left if r is not first)
        survivors = [f for f in survivors if not first.rejects(f)]
    return tuple(out)


def quality_report(df: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """A row per row of ``df`` (doc_id, text): counts, base_failed, kept.

    Base rules come first (under 50 words, over half of the words in repeated windows); texts that pass them go
    through the ordered cascade. The order changes only the cost, never ``kept``. A null text counts as empty and
    fails; repeated rows are judged alone; extra columns are ignored; an empty table gives no rows.
    """
    order = plan_cascade(df) if rules is None else rules
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    @F.pandas_udf(", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            f = Features(text if isinstance(text, str) else None)
            failed = base_failed(f)
            rows.append((*(getattr(f, c) for c in counts), failed, not failed and cascade(f, order) is None))
        return pd.DataFrame(rows, columns=[*counts, "base_failed", "kept"])

    judged = df.select(F.col("doc_id").cast("long").alias("doc_id"), judge(F.col("text").cast("string")).alias("j"))
    return judged.select("doc_id", "j.*")


def quality_filter(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that the rules keep, with all their columns; counts that no rule asks for aren't computed.

    Here base rules and others form one cascade, ordered together.
    """
    order = plan_cascade(df, BASE_RULES + RULES, ())

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        return pd.Series([cascade(Features(t if isinstance(t, str) else None), order) is None for t in texts], dtype=bool)

    return df.where(keeps(F.col("text").cast("string")))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]{2}') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_letter
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
         OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_upper > 3 * n_words OR 10 * n_letter < 7 * n_words) AS kept
FROM b
"""
