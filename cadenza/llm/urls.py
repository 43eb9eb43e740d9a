"""Op 6: URL filter by rules, then by gradient-boosted trees on lexical features.

The longest rule that fits decides. URLs that a rule decides are the labelled ones: at most
``sample_rows`` different ones, the first by hash, train the trees, which judge the URLs that no rule
fits. The features are lengths, depth, digit ratio, entropy, parameter counts and two suffix statistics:
the share of blocked ones among the labelled hosts under the host's last label, and among those with the
same first path segment. Shares count hosts, not URLs, are drawn to the overall share, and are taken for
a labelled URL from the other hosts only, so that no URL's own label is among its features. Everything is
one narrow pass; only the sample leaves it.

Null URLs and those without "://" have an empty host and path; no rule fits them and the trees judge
them by their features. Without labelled rows the trees allow. Repeated rows are judged alike and teach
once.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import boosting
from cadenza.llm.common import ascii_lower

def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules (host and path, to allow or block) that fits, or null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out if out is not None else F.lit(None).cast("string")


def lexical(url: str | None, host: str, path: str) -> list[float]:
    u = url or ""
    query = u.partition("?")[2].partition("#")[0]
    n = len(u)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(u).values()) if n else 0.0
    labels = host.split(".") if host else []
    digits = sum(c.isdigit() for c in u)
    features = (n, len(host), len(path), len(labels), path.count("/"), digits / n if n else 0, sum(c.isdigit() for c in host), entropy, u.count("-"), query.count("=") + query.count("&"), len(query), "#" in u, u[:8].lower() == "https://", "." in path.rpartition("/")[2], max(map(len, labels), default=0))
    return [float(x) for x in features]


class Shares:
    """For each token (a host's last label, a path's first segment) the share of blocked among its labelled hosts, drawn to the overall share."""

    def __init__(self, tokens: list[str], hosts: list[str], blocked: np.ndarray, drawn: float = 5.0):
        self.of_host: dict[tuple[str, str], list[float]] = defaultdict(list)
        for t, h, y in zip(tokens, hosts, blocked, strict=True):
            self.of_host[t, h].append(float(y))
        self.sums: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for (t, _), ys in self.of_host.items():
            self.sums[t][0] += sum(ys) / len(ys)
            self.sums[t][1] += 1
        self.prior, self.drawn = (float(np.mean(blocked)) if len(blocked) else 0.0), drawn
        self.share = {t: (b + drawn * self.prior) / (n + drawn) for t, (b, n) in self.sums.items()}

    def without(self, token: str, host: str) -> float:
        """The share but for one host."""
        ys = self.of_host[token, host]
        b, n = self.sums[token]
        return (b - sum(ys) / len(ys) + self.drawn * self.prior) / (n - 1 + self.drawn)


def suffix(host: str) -> str:
    return host.rpartition(".")[2]


def head(path: str) -> str:
    return path.split("/")[1] if "/" in path else ""


class Judge:
    """Trees over lexical features and suffix statistics, learned from labelled URLs: (url, host, path, blocked)."""

    def __init__(self, labelled: list[tuple[str, str, str, int]]):
        y = np.array([r[3] for r in labelled], float)
        hosts = [r[1] for r in labelled]
        self.stats = [(f, i, Shares([f(r[i]) for r in labelled], hosts, y)) for f, i in ((suffix, 1), (head, 2))]
        x = [[*lexical(u, h, p), *(s.without(f((u, h, p)[i]), h) for f, i, s in self.stats)] for u, h, p, _ in labelled]
        self.trees = boosting.fit(np.array(x), y) if len(y) else boosting.Trees(-1.0, 1)
        self.shares = [(f, i, s.share, s.prior) for f, i, s in self.stats]
        del self.stats

    def probability(self, urls: list[tuple[str | None, str, str]]) -> np.ndarray:
        """Of each (url, host, path) to be blocked."""
        x = [[*lexical(*r), *(share.get(f(r[i]), prior) for f, i, share, prior in self.shares)] for r in urls]
        return self.trees.probability(np.array(x)) if x else np.zeros(0)


def judge(pages: DataFrame, rules: dict[str, str], url_col: str = "url", sample_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """pages with __host, __path, __rule and __verdict."""
    host, path = parts(F.col(url_col))
    d = pages.withColumns({"__host": host, "__path": path})
    d = d.withColumn("__rule", rule_for(F.col("__host"), F.col("__path"), rules))
    verdicts = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        verdicts = F.when(F.col("__rule") == rule, verdict).otherwise(verdicts)
    labelled = d.filter("__rule is not null").select(F.col(url_col).alias("u"), "__host", "__path", (verdicts == "block").cast("int").alias("y")).distinct()
    sample = labelled.orderBy(F.xxhash64("u"), "u").limit(sample_rows).collect()
    shared = pages.sparkSession.sparkContext.broadcast(Judge([tuple(r) for r in sample]))

    @F.pandas_udf("double")
    def blocks(url: pd.Series, host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(shared.value.probability(list(zip(url, host, path, strict=True))), dtype=float)

    model_says = F.when(blocks(F.col(url_col), "__host", "__path") >= threshold, "block").otherwise("allow")
    return d.withColumn("__verdict", F.coalesce(verdicts, model_says))
