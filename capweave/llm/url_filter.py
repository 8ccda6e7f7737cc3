"""URL filtering by given rules and, beyond them, by association rules mined from labelled URLs.

Given rules name a host and the begin of a path; the longest that fits decides.  URLs that a given
rule decides are the labelled ones.  From their tokens (host labels with their place from the end, path
segments, path depth, query names, scheme, port) Spark's FP-growth mines combinations that go with a verdict;
rules under ``SUPPORT`` or ``CONFIDENCE``, and rules no better than a shorter one within them, are pruned.  A URL without a
given rule takes the verdict of the best mined rule among its tokens, by confidence, then support,
then number of tokens; without any it is allowed.  Rules are found by an inverted index: each is
listed under its rarest token, so only rules with a token of the URL are looked at.

The number of mined rules is bounded by the support, not by the data: a combination has to hold for
a fixed share of the labelled URLs.  Equal URLs are counted as often as they occur.

Defined cases: a null URL and one without ``://`` have an empty host and path and no token; they fit
no rule and are allowed.  Rows with the same id are judged one by one.  Without labelled URLs all others are allowed.  An empty
table gives an empty result.  Columns made replace those of the same name; all others stay.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from capweave.llm.tables import materialize, ship_package

#: Given rules: host and begin of the path, verdict.
GIVEN = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
SUPPORT = 0.005
CONFIDENCE = 0.9
#: Tokens of a mined combination, the verdict not counted.
LONGEST = 3
_VERDICT = "verdict="

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    """Behind the first ``://`` up to /, ?, # or the end; A to Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(given: tuple[tuple[str, str], ...] = GIVEN) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits ``host`` and ``path``; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(given, key=lambda r: (len(r[0]), r[0])):
        host, _, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(f"/{rest}"))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens(url: str = "url") -> Column:
    """Distinct tokens of a URL; needs ``host`` and ``path``."""
    name = F.regexp_replace("host", ":[0-9]*$", "")
    labels = F.reverse(F.filter(F.split(name, r"\."), lambda x: x != ""))
    numbered = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    steps = F.transform(parts, lambda x: F.concat(F.lit("p="), F.when(F.regexp_like(x, F.lit("^[0-9]+$")), "#").otherwise(x)))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q="), F.split_part(x, F.lit("="), F.lit(1)))
    )
    rest = F.array(
        F.concat(F.lit("s="), F.regexp_extract(url, r"(?s)^(.*?)://", 1)),
        F.concat(F.lit("port="), F.regexp_extract("host", ":([0-9]+)$", 1)),
        F.concat(F.lit("depth="), F.size(parts).cast("string")),
    )
    every = F.array_distinct(F.filter(F.concat(numbered, steps, names, rest), lambda x: ~x.isin("s=", "port=", "depth=0")))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(every)


@dataclass(frozen=True)
class Mined:
    tokens: frozenset[str]
    verdict: str
    confidence: float
    support: float

    @property
    def rank(self) -> tuple:
        return (-self.confidence, -self.support, -len(self.tokens), sorted(self.tokens), self.verdict)


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[list[Mined], dict[str, int]]:
    """(rules, counts of the tokens in them) from a table of ``tokens`` and ``verdict``."""
    if not labelled.limit(1).count():
        return [], {}
    # Tokens that are too rare for any rule are left out before the mining.
    total = labelled.count()
    often = labelled.select(F.explode("tokens").alias("t")).groupBy("t").count().filter(F.col("count") >= support * total)
    counts = {r.t: r["count"] for r in often.collect()}  # tokens per URL over the support, at most
    used = F.array(*[F.lit(t) for t in sorted(counts)]) if counts else F.array().cast("array<string>")
    basket = F.concat(F.array_intersect("tokens", used), F.array(F.concat(F.lit(_VERDICT), F.col("verdict"))))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(labelled.select(basket.alias("items")))
    size = F.size("items")
    named = F.filter("items", lambda x: F.startswith(x, F.lit(_VERDICT)))
    sets = model.freqItemsets.withColumn("v", F.get(named, F.lit(0))).withColumn("x", F.array_sort(F.array_except("items", named)))
    sets = sets.filter(F.size("x").between(0, LONGEST) & (size >= 1))
    whole = sets.filter("v IS NULL").select("x", F.col("freq").alias("n"))
    ruled = sets.filter("v IS NOT NULL AND size(x) > 0").select("x", "v", "freq")
    # One case more for and one against, so that a handful of URLs makes no rule.
    sure = (F.col("freq") + 1) / (F.col("n") + 2)
    found = ruled.join(whole, "x").withColumn("sure", sure).filter(F.col("sure") >= confidence).collect()  # bounded by the support
    rules = [Mined(frozenset(r.x), r.v.removeprefix(_VERDICT), r.sure, r.freq / total) for r in found]
    best: dict[frozenset[str], Mined] = {}
    kept = []
    for rule in sorted(rules, key=lambda r: (len(r.tokens), r.rank)):
        shorter = [best[part] for part in _parts(rule.tokens) if part in best]
        if not any(s.verdict == rule.verdict and s.confidence >= rule.confidence for s in shorter):
            kept.append(rule)
            best[rule.tokens] = rule
    return kept, counts


def _parts(tokens: frozenset[str]) -> list[frozenset[str]]:
    """Proper parts that are not empty; a combination has LONGEST tokens at most."""
    items = sorted(tokens)
    return [frozenset(t for k, t in enumerate(items) if mask >> k & 1) for mask in range(1, (1 << len(items)) - 1)]


class Index:
    """Mined rules under their rarest token."""

    def __init__(self, rules: list[Mined], counts: dict[str, int]):
        self.lists: dict[str, list[Mined]] = defaultdict(list)
        for rule in sorted(rules, key=lambda r: r.rank):
            self.lists[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(rule)

    def verdict(self, tokens: list[str]) -> str | None:
        there = set(tokens)
        fits = (next((r for r in self.lists[t] if r.tokens <= there), None) for t in there if t in self.lists)
        best = min((r for r in fits if r), key=lambda r: r.rank, default=None)
        return best.verdict if best else None


def judge(pages: DataFrame, given: tuple[tuple[str, str], ...] = GIVEN) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    spark = pages.sparkSession
    ship_package(spark)
    rule, verdict = given_rule(given)
    parsed = pages.withColumns({"host": host_of(), "path": path_of()}).withColumns({"rule": rule, "verdict": verdict})
    labelled = materialize(parsed.filter("verdict IS NOT NULL").select(tokens().alias("tokens"), "verdict"), "labelled")
    index = spark.sparkContext.broadcast(Index(*mine(labelled)))

    @F.arrow_udf(StringType())
    def mined(lists: pa.Array) -> pa.Array:
        return pa.array([index.value.verdict(x) if x else None for x in lists.to_pylist()], pa.string())

    free = F.when(F.col("verdict").isNull(), tokens())  # decided URLs send nothing to Python
    return parsed.withColumn("verdict", F.coalesce("verdict", mined(free), F.lit("allow")))
