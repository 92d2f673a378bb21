"""URL filters: ordered host and path rules, and gradient-boosted trees on lexical features for the rest.

Features, rules and the trees are DataFrame expressions. The trees are fitted on the driver to a bounded sample of
different labelled URLs (about ``sample_rows``, drawn by URL hash), of which only binned numbers and labels are
collected. Suffix statistics count all different labelled URLs and stay a table.

A suffix's statistic is how far its share of blocked labels, smoothed towards all labels' share by ``PSEUDO`` labels, lies
from that share in log-odds. What has no labels stands at 0 and is marked as unseen; so that the trees know what to do
with it, the fit hides the suffix of one URL in ``HIDDEN``, and so an unseen suffix is judged as URLs at large are.

Defined cases: a null URL, or one without host (``://``), has empty host and path, fits no rule and scores the prior;
very long URLs are measured whole; repeated rows are judged alike, and a URL counts once for the model however often it
is there; an empty table gives no rows; without labelled rows, or with labels of one kind only, the model is that label's
prior and with none at all allows; a suffix without labels is unseen. Columns that the
caller wants along are named in ``keep``, so other columns, whatever their names, do no harm. Of rules that fit, the
longest wins (host and path together), of equally long ones the last; of rules for one host and path the first counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import ascii_lower
from loomline.storage import materialise

#: Up to so many rules become one expression; more are joined as a table, with the same result.
COMPILED_RULES = 500
#: Rows of a table (suffixes) that may be broadcast; beyond, the same join runs by a shuffle.
BROADCAST_ROWS = 500_000


#: Labels at the overall share that a suffix's own are mixed with, and one URL in so many that is fitted as if its suffix had none.
PSEUDO, HIDDEN = 4.0, 5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules in production.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

FEATURES = ("url_length", "host_length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens", "suffix_odds", "suffix_seen")


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _in_order(rules: Sequence[Rule]) -> list[Rule]:
    """One rule for each host and path, the weakest first."""
    first: dict[tuple[str, str], Rule] = {}
    for rule in rules:
        first.setdefault((rule.host, rule.path), rule)
    return sorted(first.values(), key=lambda r: len(r.text))


def best_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (null where none does), as one expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in _in_order(rules):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, F.lit(rule.text)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def with_rule(rows: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rows with ``host`` and ``path``, and ``rule`` and ``said``: text and verdict of the longest rule that fits.

    Many rules are joined: every host's own suffixes (all of them that begin a label) meet the rules for that host.
    """
    if len(rules) <= COMPILED_RULES:
        name, verdict = best_rule(F.col("host"), F.col("path"), rules)
        return rows.withColumn("rule", name).withColumn("said", verdict)
    table = [(r.host, r.path, r.text, r.verdict, k) for k, r in enumerate(_in_order(rules))]
    given = rows.sparkSession.createDataFrame(table, "_host string, _path string, rule string, said string, _k long")
    labels = F.split("host", "\\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    places = rows.select("host", "path").distinct()
    met = places.withColumn("_host", F.explode(ends)).join(given, "_host").filter(F.startswith("path", F.col("_path")))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "said"), "_k").alias("_best"))
    return rows.join(best, ["host", "path"], "left").withColumns({c: F.col("_best")[c] for c in ("rule", "said")}).drop("_best")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def lexical(url: Column, host: Column, path: Column, letters: Column) -> dict[str, Column]:
    """The features but for the suffix's, as doubles; ratios and entropy are whole thousandths.

    ``letters`` is a column with the URL's characters (``letters_of``), so that they are split once a row.
    """
    whole = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(whole), F.lit(1))
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)))
    spread = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * F.log2(c.cast("double")))
    columns = {
        "url_length": F.length(whole),
        "host_length": F.length(host),
        "depth": _count(path, "/"),
        "digit_ratio": F.floor(1000 * _count(whole, "[0-9]") / n),
        "entropy": F.floor(1000 * (F.log2(n.cast("double")) - spread / n)),
        "n_params": F.when(F.instr(whole, "?") > 0, _count(F.regexp_extract(whole, "\\?([^#]*)", 1), "&") + 1).otherwise(0),
        "n_labels": F.when(host == "", 0).otherwise(_count(host, "\\.") + 1),
        "n_hyphens": _count(host, "-"),
    }
    return {name: c.cast("double") for name, c in columns.items()}


def letters_of(url: Column) -> Column:
    return F.split(F.coalesce(url, F.lit("")), "")


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


@dataclass(frozen=True)
class Model:
    """A table (suffix, odds), a prior, and trees as nested tuples: (feature, threshold, low side, high side) or a leaf's value."""

    suffixes: DataFrame | None
    prior: float
    trees: tuple

    def score(self, features: dict[str, Column]) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, cut, low, high = node
            return F.when(features[name] <= cut, walk(low)).otherwise(walk(high))

        total = F.lit(float(self.prior))
        for tree in self.trees:
            total = total + walk(tree)
        return total


def _grow(x: np.ndarray, bins: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, rate: float, out: np.ndarray):
    """One regression tree on binned features: the split of largest gain at each node, from histograms."""
    g, h, penalty = grad[rows].sum(), hess[rows].sum(), 1.0
    best = (1e-6, None, None)
    if depth and len(rows) >= 20:
        for f, cuts in enumerate(bins):
            if len(cuts) == 0:
                continue
            low_g = np.cumsum(np.bincount(x[rows, f], grad[rows], len(cuts) + 1))[:-1]
            low_h = np.cumsum(np.bincount(x[rows, f], hess[rows], len(cuts) + 1))[:-1]
            gain = low_g**2 / (low_h + penalty) + (g - low_g) ** 2 / (h - low_h + penalty) - g**2 / (h + penalty)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
    if best[1] is None:
        value = float(-rate * g / (h + penalty))
        out[rows] += value
        return value
    _, f, k = best
    low = x[rows, f] <= k
    sides = [_grow(x, bins, grad, hess, rows[side], depth - 1, rate, out) for side in (low, ~low)]
    return (FEATURES[f], float(bins[f][k]), *sides)


def boost(values: np.ndarray, blocked: np.ndarray, n_trees: int = 12, depth: int = 3, rate: float = 0.4, n_bins: int = 32) -> tuple[float, tuple]:
    """Prior and trees for the logistic loss."""
    share = (blocked.sum() + 1) / (len(blocked) + 2)
    prior = float(np.log(share / (1 - share)))
    bins = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, n_bins + 1)[:-1], method="lower"))[:-1] if len(np.unique(values[:, f])) > n_bins else np.unique(values[:, f])[:-1] for f in range(values.shape[1])]
    x = np.stack([np.searchsorted(cuts, values[:, f], side="left") for f, cuts in enumerate(bins)], axis=1)
    total, trees = np.full(len(blocked), prior), []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-total))
        trees.append(_grow(x, bins, p - blocked, np.maximum(p * (1 - p), 1e-6), np.arange(len(blocked)), depth, rate, total))
    return prior, tuple(trees)


def _odds(blocked: Column, n: Column, share: float) -> Column:
    """How far a suffix's smoothed log-odds are from those of all labels; null where it has none."""
    odds = F.log((blocked + PSEUDO * share) / (n - blocked + PSEUDO * (1 - share)))
    return F.when(n > 0, F.round(odds - float(np.log(share / (1 - share))), 6))


def train(labelled: DataFrame, sample_rows: int = 20_000, **options) -> Model:
    """A model from ``url`` and boolean ``blocked``, fitted to about ``sample_rows`` different URLs drawn by their hash.

    For the fit, a suffix's odds are those of the half of the URLs (by another hash) that the row isn't in, so that they
    are never read off the row itself; the model's own odds count both halves.
    """
    url = F.col("url")
    urls = labelled.filter("blocked IS NOT NULL").select("url", "blocked").distinct()
    urls = urls.select("url", "blocked", suffix_of(host_of(url)).alias("suffix"), (F.hash("url") % 2 == 0).cast("int").alias("half"), F.pmod(F.xxhash64("url"), F.lit(1 << 20)).alias("draw"))
    sums = [F.count_if((F.col("half") == h) & c).alias(f"{n}{h}") for h in (0, 1) for n, c in (("b", F.col("blocked")), ("n", F.lit(True)))]
    counts = materialise(urls.groupBy("suffix").agg(*sums), "suffixes")
    total = counts.agg(*[F.coalesce(F.sum(F.col(f"{n}0") + F.col(f"{n}1")), F.lit(0)).alias(n) for n in "bn"]).first()
    if total["b"] in (0, total["n"]):
        return Model(None, -1.0 if total["b"] == 0 else 1.0, ())
    share = total["b"] / total["n"]
    suffixes = counts.filter("suffix <> ''").select("suffix", _odds(F.col("b0") + F.col("b1"), F.col("n0") + F.col("n1"), share).alias("odds"))
    apart = counts.select("suffix", *[_odds(F.col(f"b{h}"), F.col(f"n{h}"), share).alias(f"o{h}") for h in (0, 1)])
    drawn = urls.filter((F.col("draw") < sample_rows / total["n"] * (1 << 20)) & (F.col("suffix") != "")).join(apart, "suffix")
    hidden = F.pmod(F.xxhash64("url", F.lit("hidden")), F.lit(HIDDEN)) == 0
    told = F.when(~hidden, F.when(F.col("half") == 0, F.col("o1")).otherwise(F.col("o0")))
    drawn = drawn.select("blocked", told.alias("told"), "url", host_of(url).alias("host"), path_of(url).alias("path"), letters_of(url).alias("letters"))
    features = lexical(url, F.col("host"), F.col("path"), F.col("letters")) | suffix_features(F.col("told"))
    rows = drawn.select("blocked", *[c.alias(k) for k, c in features.items()]).collect()
    labels = np.array([r["blocked"] for r in rows], float)
    if len(set(labels)) < 2:
        return Model(suffixes, float(np.log((total["b"] + 1) / (total["n"] - total["b"] + 1))), ())
    prior, trees = boost(np.array([[r[f] for f in FEATURES] for r in rows]), labels, **options)
    return Model(suffixes, prior, trees)


def suffix_features(odds: Column) -> dict[str, Column]:
    """The two features of a suffix's odds, null where it has no labels."""
    return {"suffix_odds": F.coalesce(odds, F.lit(0.0)), "suffix_seen": odds.isNotNull().cast("double")}


def judge(pages: DataFrame, model: Model, rules: Sequence[Rule] = RULES, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``keep``, then host, path, rule, block_score and verdict of every row: the rule's verdict, else the trees'."""
    url = F.col("url").cast("string")
    parts = pages.select(F.struct(*keep).alias("_keep"), url.alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"), letters_of(url).alias("_letters"))
    features = lexical(F.col("_url"), F.col("host"), F.col("path"), F.col("_letters"))
    used = with_rule(parts.withColumns({f"_{k}": c for k, c in features.items()} | {"suffix": suffix_of(F.col("host"))}).drop("_url", "_letters"), rules)
    if model.suffixes is None:
        used = used.withColumn("odds", F.lit(None).cast("double"))
    else:
        known = materialise(model.suffixes, "odds")
        used = used.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "suffix", "left")
    score = model.score({k: F.col(f"_{k}") for k in features} | suffix_features(F.col("odds")))
    score = F.when(F.col("host") == "", F.lit(float(model.prior))).otherwise(score)
    scored = used.select("_keep.*", "host", "path", "rule", score.alias("block_score"), "said")
    return scored.select(*keep, "host", "path", "rule", "block_score", F.coalesce("said", F.when(F.col("block_score") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def labelled_by_rules(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The URLs that a rule decides, as labels for ``train``."""
    url = F.col("url").cast("string")
    told = with_rule(pages.select(url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")), rules)
    return told.select("url", (F.col("said") == "block").alias("blocked")).filter("blocked IS NOT NULL")
