"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source x language x topic). Raking scales the cells' weights to each
target margin in turn until all hold; a weight above 1 counts as 1, for a document is taken once at
most. A document is then kept when a hash of its id, as a number in [0, 1), is below its cell's
weight, so the expected tokens of the kept documents meet every margin.

The total is ``keep`` of all tokens, or less where a named class has too few tokens for its
share. Values that a margin doesn't name (and nulls) are one class, ``OTHER``, whose share is its
target or, if it holds less, its share of all tokens, so it never lowers the total. There are at most
(sources + 1) x (languages + 1) x (topics + 1) cells, whatever the data, and only their sums are
fitted on the driver and broadcast. ``MAX_CELLS`` bounds what a set of targets may ask for.

Defined results
* Tokens are words of ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none and get their cell's weight.
* A class without tokens leaves its share to the others of its margin, in proportion.
* Where margins can't all be met (their cells hold too few tokens), the weights of the last round
  stand and ``margin_error`` tells the largest relative miss.
* Repeated rows get the same decision; null ids are decided by the text. An empty table gives an
  empty result. Result columns replace columns of the same name, other columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

OTHER = "(other)"
MAX_CELLS = 200_000
ROUNDS = 2000
TOLERANCE = 1e-10
KEEP = 0.5
# First rule that matches names the topic; the rest is prose.
TOPICS = (
    ("notice", r"[Ll]icen[sc]ed? under|[Cc]opyright|Licen[sc]e,"),
    ("contact", r"[A-Za-z0-9]@[A-Za-z0-9]"),
    ("table", r"\|[^|\n]*\|"),
    ("symbols", r"[!#$%&*]{2}"),
)
PROSE = "prose"


@dataclass
class Targets:
    """Shares by class for each margin; they need not add up to 1."""

    source: dict[str, float] = field(default_factory=dict)
    lang: dict[str, float] = field(default_factory=dict)
    topic: dict[str, float] = field(default_factory=dict)
    other: float = 0.02

    def margins(self) -> list[dict[str, float]]:
        return [{**m, OTHER: self.other} for m in (self.source, self.lang, self.topic)]


def topic_of(text: Column, rules: tuple = TOPICS) -> Column:
    found = F.lit(PROSE)
    for name, pattern in reversed(rules):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def rake(cells: np.ndarray, tokens: np.ndarray, margins: list[np.ndarray], keep: float = KEEP, other: bool = False) -> tuple[np.ndarray, float]:
    """Weights of cells in [0, 1], and the largest relative miss of a margin.

    ``cells`` has a row per cell with its class number in each margin, ``margins`` the classes' shares;
    with ``other`` the last class of each is ``OTHER``.
    """
    wanted, total = [], tokens.sum()
    if total <= 0:
        return np.full(len(tokens), min(1.0, keep)), 0.0
    held = [np.bincount(cells[:, m], tokens, minlength=len(shares)) for m, shares in enumerate(margins)]
    most = keep * total
    for have, shares in zip(held, margins):
        share = np.where(have > 0, shares, 0.0)
        share = share / share.sum() if share.sum() else have / have.sum()
        if other and share[-1] > have[-1] / total and share[:-1].any():
            share[:-1] *= (1 - have[-1] / total) / share[:-1].sum()
            share[-1] = have[-1] / total
        wanted.append(share)
        most = min(most, (have[share > 0] / share[share > 0]).min())
    weight = np.full(len(tokens), most / total)
    miss = np.inf
    for _ in range(ROUNDS):
        for m, share in enumerate(wanted):
            now = np.bincount(cells[:, m], tokens * np.minimum(weight, 1), minlength=len(share))
            weight = np.minimum(weight, 1e100) * np.divide(share * most, now, out=np.ones_like(now), where=now > 0)[cells[:, m]]
        kept = tokens * np.minimum(weight, 1)
        miss = max(
            np.abs(np.bincount(cells[:, m], kept, minlength=len(s))[s > 0] / (s[s > 0] * most) - 1).max() for m, s in enumerate(wanted))
        if miss < TOLERANCE:
            break
    return np.minimum(weight, 1), float(miss)


def _classes(docs: DataFrame, targets: Targets, source_col: str, lang_col: str, topic: Column) -> list[Column]:
    def named(value: Column, shares: dict[str, float]) -> Column:
        return F.when(value.isin(list(shares)), value).otherwise(OTHER) if shares else F.lit(OTHER)

    return [named(v, s) for v, s in zip((F.col(source_col), F.col(lang_col), topic), (targets.source, targets.lang, targets.topic))]


def mix(docs: DataFrame, targets: Targets, keep: float = KEEP, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", lang_col: str = "lang", topics: tuple = TOPICS) -> DataFrame:
    """``docs`` with topic, n_tokens, probability, margin_error and sampled."""
    spark = docs.sparkSession
    margins = targets.margins()
    if np.prod([len(m) for m in margins]) > MAX_CELLS:
        raise ValueError("the targets name too many classes")
    topic, tokens = topic_of(F.coalesce(F.col(text_col), F.lit("")), topics), token_count(F.col(text_col))
    keys = ["__source", "__lang", "__topic"]
    classes = [c.alias(k) for c, k in zip(_classes(docs, targets, source_col, lang_col, topic), keys)]
    sums = docs.select(*classes, tokens.alias("n")).groupBy(*keys).agg(F.sum("n").alias("n")).orderBy(*keys).collect()
    numbers = [{c: i for i, c in enumerate(m)} for m in margins]
    cells = np.array([[numbers[m][r[m]] for m in range(3)] for r in sums], dtype=np.int64).reshape(len(sums), 3)
    shares = [np.array(list(m.values()), dtype=float) for m in margins]
    weights, miss = rake(cells, np.array([float(r["n"]) for r in sums]), shares, keep, other=True)
    fitted = spark.createDataFrame(
        [(*[r[k] for k in keys], float(w), miss) for r, w in zip(sums, weights)],
        "__source string, __lang string, __topic string, probability double, margin_error double")
    results = ("topic", "n_tokens", "probability", "margin_error", "sampled")
    kept = [c for c in docs.columns if c not in results]
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))), F.lit(1 << 52)) / F.lit(float(1 << 52))
    marked = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *classes, topic.alias("__named"), tokens.alias("__tokens"), drawn.alias("__drawn"))
    return marked.drop("probability", "margin_error").join(F.broadcast(fitted), keys).select(
        *[F.col(f"`{c}`") for c in kept], F.col("__named").alias("topic"), F.col("__tokens").alias("n_tokens"), "probability", "margin_error",
        (F.col("__drawn") < F.col("probability")).alias("sampled"))


def keep_mixed(docs: DataFrame, targets: Targets, **options) -> DataFrame:
    """The sampled rows, with the columns of ``docs``."""
    columns = docs.columns
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    source_col, lang_col = options.pop("source_col", "source"), options.pop("lang_col", "lang")
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), *[
        F.col(c).alias(f"__{n}") for n, c in (("i", id_col), ("t", text_col), ("s", source_col), ("l", lang_col))])
    found = mix(work, targets, id_col="__i", text_col="__t", source_col="__s", lang_col="__l", **options).filter("sampled")
    return found.select(*[F.col("__row").getField(c).alias(c) for c in columns])
