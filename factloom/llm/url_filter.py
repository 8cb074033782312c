"""URL filter: explicit rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled URL table (LABELLED below, or any other of its shape), by
full-batch gradient descent with L2, always to the same weights. Scoring is one narrow pass.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets the model's verdict on those;
rules fit a host itself and its subdomains; repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ascii_lower

#: (host, path, verdict). The longest one that fits wins.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: A small labelled table, written for this filter: 1 is to be blocked.
LABELLED = (
    ("http://casino-bonus.example.com/win/now", 1), ("http://free-pills.example.net/buy?id=3", 1), ("https://ads.tracker.example.org/click/99", 1),
    ("http://www.xxx-cams.example.com/live", 1), ("http://cheap-loans.example.net/apply/fast", 1), ("https://spam.example.org/offers/1", 1),
    ("http://poker.slots.example.com/play/now", 1), ("http://warez.example.net/crack/keygen.exe", 1), ("https://bet.example.org/odds/today", 1),
    ("http://download-free.example.com/setup.exe", 1), ("http://adserver.example.net/banner/12", 1), ("https://win-prize.example.org/claim", 1),
    ("https://docs.example.com/guide/intro", 0), ("https://www.example.org/about", 0), ("http://news.example.net/2024/05/story", 0),
    ("https://blog.example.com/fr/123", 0), ("https://m.example.net/en/25", 0), ("http://wiki.example.org/en/article", 0),
    ("https://library.example.com/es/410", 0), ("https://university.example.org/de/research", 0), ("http://museum.example.net/fr/18", 0),
    ("https://docs.example.org/fr/reference", 0), ("http://the.example.com/de/52", 0), ("https://recipes.example.net/es/77", 0),
)
BUCKETS = 4096
GRAMS = (3, 4)
THRESHOLD = 0.5


def host(url: Column) -> Column:
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    found = ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0))
    return F.when(F.locate("://", url) > 0, found).otherwise(F.lit(""))


def path(url: Column) -> Column:
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null without one."""
    fits = [(h, p, v, ((host == h) | host.endswith("." + h)) & path.startswith(p)) for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v, ok in reversed(fits):
        rule, verdict = F.when(ok, h + p).otherwise(rule), F.when(ok, v).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str) -> list[int]:
    """Buckets of the n-grams of ^host$ and of ^path$, apart from each other; each once."""
    out = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            out.update(zlib.crc32(f"{kind}{text[k : k + n]}".encode()) % BUCKETS for k in range(max(1, len(text) - n + 1)))
    return sorted(out)


def _split(url: str) -> tuple[str, str]:
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    stop = min((k for c in "?#" if (k := rest.find(c, end)) >= 0), default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:stop]


def train(labelled: tuple = LABELLED, rounds: int = 400, rate: float = 1.0, decay: float = 1e-3) -> np.ndarray:
    """Weights per bucket and, last, the bias."""
    x = np.zeros((len(labelled), BUCKETS + 1))
    y = np.array([label for _, label in labelled], dtype=np.float64)
    for k, (url, _) in enumerate(labelled):
        at = features(*_split(url))
        x[k, at] = 1 / np.sqrt(len(at))
        x[k, -1] = 1
    w = np.zeros(BUCKETS + 1)
    for _ in range(rounds):
        w -= rate * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + decay * w)
    return w


def judged(pages: DataFrame, rules: tuple = RULES, labelled: tuple = LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's probability that the url is to be blocked)."""
    weights = train(labelled)
    url = F.coalesce("url", F.lit(""))
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = []
            for h, p in zip(batch["host"], batch["path"], strict=True):
                at = features(h, p)
                scores.append(1 / (1 + np.exp(-(weights[at].sum() / np.sqrt(len(at)) + weights[-1]))))
            batch["page_id"] = batch["page_id"].astype("Int64")
            yield batch.assign(score=scores)

    scored = cut.mapInPandas(run, "page_id long, host string, path string, score double")
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")).alias("verdict"), "score")
