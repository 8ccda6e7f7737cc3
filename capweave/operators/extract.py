"""Links out of captures: built-in, pattern-based and user-written extractors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capweave.functions.common import text_of
from capweave.functions.http import mime
from capweave.functions.markup import (
    css_url_links,
    find_all,
    html_links,
    links_as,
    unescape_script,
)
from capweave.functions.urls import hop_cost, resolve_url, surt
from capweave.operators.rules import Rule, dispatch, rule_matches
from capweave.operators.scratch import materialize
from capweave.operators.skew import HEAVY_ROWS, skew_join

SOURCE_COLUMNS = ("capture_id", "surt", "url", "hops")

ColumnExtractor = Callable[[Column], Column]  # body text -> array<struct<kind,raw>>
FrameExtractor = Callable[[DataFrame], DataFrame]  # captures -> SOURCE_COLUMNS, kind, pos, raw
PythonExtractor = Callable[[dict, bytes], Iterable[str]]  # header, body -> URLs


@dataclass
class Extractors:
    """Named extractors.  Column extractors share one scan of the captures."""

    columns: dict[str, ColumnExtractor] = field(
        default_factory=lambda: {"html": html_links, "css": css_url_links}
    )
    frames: dict[str, FrameExtractor] = field(default_factory=dict)

    def add(self, name: str, extractor: ColumnExtractor) -> None:
        self.columns[name] = extractor

    def add_frame(self, name: str, extractor: FrameExtractor) -> None:
        self.frames[name] = extractor

    def add_python(self, name: str, extractor: PythonExtractor) -> None:
        self.frames[name] = lambda captures: run_python(captures, extractor, name)


def extract_column(captures: DataFrame, extractor: ColumnExtractor) -> DataFrame:
    """Apply one column extractor to every capture."""
    staged = captures.select(*SOURCE_COLUMNS, text_of(F.col("body")).alias("_text"))
    return _exploded(staged, extractor(F.col("_text")), "kind")


def _exploded(staged: DataFrame, links: Column, *before: str) -> DataFrame:
    """One row per link, with the fields ``before`` of the links before ``pos``.

    The generator takes the expression itself.  From a column that holds the links the planner would infer a
    filter for links that are not empty and push it below the projection, so all links would be found twice.
    """
    return staged.select(*SOURCE_COLUMNS, F.posexplode(links).alias("pos", "_link")).select(
        *SOURCE_COLUMNS, *[f"_link.{name}" for name in before], "pos", "_link.raw"
    )


def extract_links(
    captures: DataFrame, rules: Sequence[Rule], extractors: Extractors | None = None
) -> DataFrame:
    """Send every capture to all matching rules and return the links they find.

    All column extractors run in one pass over the bodies.  Extractors written
    in Python get their captures through a filter that runs before them.
    """
    extractors = extractors or Extractors()
    native = [r for r in rules if r.extractor in extractors.columns]
    other = [r for r in rules if r.extractor in extractors.frames]
    missing = {r.extractor for r in rules} - extractors.columns.keys() - extractors.frames.keys()
    if missing:
        raise KeyError(f"unknown extractors: {sorted(missing)}")
    found = []
    if native:
        staged = captures.select(
            *SOURCE_COLUMNS,
            mime(F.col("headers")).alias("_mime"),
            text_of(F.col("body")).alias("_text"),
        )
        per_rule = [
            F.when(
                rule_matches(r, F.col("url"), F.col("_mime")),
                _labelled(r.name, extractors.columns[r.extractor](F.col("_text"))),
            )
            for r in native
        ]
        found.append(_exploded(staged, F.flatten(F.array_compact(F.array(*per_rule))), "rule", "kind"))
    for rule in other:
        routed = dispatch(captures, [rule]).drop("rule")
        found.append(
            extractors.frames[rule.extractor](routed).select(
                *SOURCE_COLUMNS, F.lit(rule.name).alias("rule"), "kind", "pos", "raw"
            )
        )
    if not found:
        none = captures.select(*SOURCE_COLUMNS).limit(0)
        return none.selectExpr("*", "'' AS rule", "'' AS kind", "0 AS pos", "'' AS raw")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def _labelled(rule: str, links: Column) -> Column:
    return F.transform(
        links,
        lambda link: F.struct(
            F.lit(rule).alias("rule"), link["kind"].alias("kind"), link["raw"].alias("raw")
        ),
    )


def resolve_links(links: DataFrame) -> DataFrame:
    """Canonical target, key and hop count of each link; unresolvable ones go."""
    return (
        links.withColumnsRenamed({"surt": "src_surt", "url": "src_url", "hops": "src_hops"})
        # Through a generator, as a filter on a plain projection would evaluate the whole expression twice.
        .withColumn("url", F.explode_outer(F.array(resolve_url(F.col("src_url"), F.col("raw")))))
        .filter(F.col("url").isNotNull())
        .withColumn("surt", surt(F.col("url")))
        .withColumn("cross_host", hop_cost(F.col("src_url"), F.col("url")) == 1)
        .withColumn("hops", F.col("src_hops") + F.col("cross_host").cast("int"))
        .drop("src_hops")
    )


def within_hops(links: DataFrame, max_hops: int) -> DataFrame:
    return links.filter(F.col("hops") <= max_hops)


def subresources(
    links: DataFrame,
    captures: DataFrame,
    kinds: Sequence[str] = ("script",),
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Resolved links of some kinds with the capture of their target.

    ``captures`` holds one row per key.  Links without a capture stay, with
    nulls: they are what an extractor would see as a failed read.  The hop
    limit plays no part here.
    """
    # Finding hot targets scans the links once more, so the extraction behind
    # them is written down first.
    wanted = materialize(links.filter(F.col("kind").isin(list(kinds))), "subresources")
    targets = captures.select(
        "surt",
        F.col("capture_id").alias("target_id"),
        F.col("status").alias("target_status"),
        F.col("body").alias("target_body"),
    )
    return skew_join(wanted, targets, "surt", "capture_id", "left", heavy_rows)


@dataclass(frozen=True)
class PatternSpec:
    """Links found by pattern in a body and written out through a template.

    ``pattern`` finds blocks.  Without ``item`` its first group is the value;
    with ``item`` the first group of that pattern, searched in the block, is,
    and the block pattern's second group is available as ``{suffix}``.
    """

    name: str
    pattern: str
    template: str
    item: str | None = None


def pattern_extractor(specs: Sequence[PatternSpec]) -> ColumnExtractor:
    """Column extractor for a list of patterns; equal links of a body are merged."""

    def values(text: Column, spec: PatternSpec) -> Column:
        if spec.item is None:
            return F.transform(
                find_all(text, spec.pattern, 1),
                lambda v: _fill(spec.template, {"value": unescape_script(v)}),
            )
        return F.flatten(
            F.transform(
                find_all(text, spec.pattern, 0),
                lambda block: F.transform(
                    find_all(F.regexp_extract(block, spec.pattern, 1), spec.item, 1),
                    lambda v: _fill(
                        spec.template,
                        {
                            "value": unescape_script(v),
                            "suffix": F.regexp_extract(block, spec.pattern, 2),
                        },
                    ),
                ),
            )
        )

    def extractor(text: Column) -> Column:
        return F.array_distinct(F.flatten(F.array(*[links_as(s.name, values(text, s)) for s in specs])))

    return extractor


def _fill(template: str, values: dict[str, Column]) -> Column:
    filled = F.lit(template)
    for name, value in values.items():
        if f"{{{name}}}" in template:
            filled = F.replace(filled, F.lit(f"{{{name}}}"), value)
    return filled


def template_links(
    captures: DataFrame,
    fields: dict[str, tuple[str, str]],
    templates: Sequence[str],
) -> DataFrame:
    """Fixed URLs filled with values found in the capture.

    ``fields`` maps a name to (``"url"`` or ``"text"``, pattern); the value is
    the pattern's first group.  Captures that lack a field give no rows.
    """
    staged = captures.select(*SOURCE_COLUMNS, text_of(F.col("body")).alias("_text"))
    for name, (where, pattern) in fields.items():
        source = F.col("url") if where == "url" else F.col("_text")
        staged = staged.withColumn(f"_f_{name}", F.regexp_extract(source, pattern, 1))
    for name in fields:
        staged = staged.filter(F.col(f"_f_{name}") != "")
    filled = [_fill(t, {n: F.col(f"_f_{n}") for n in fields}) for t in templates]
    return staged.select(
        *SOURCE_COLUMNS, F.lit("template").alias("kind"), F.posexplode(F.array(*filled)).alias("pos", "raw")
    )


_PYTHON_ROWS = 10_000


def run_python(captures: DataFrame, extractor: PythonExtractor, kind: str = "python") -> DataFrame:
    """Run user code over captures, batch by batch, in Python workers.

    The code gets the capture's header as a dict and its body, and returns or
    yields URLs.
    """
    header = F.struct(
        F.struct("url", "discovered_in", "hops").alias("url"),
        F.col("status"),
        F.col("http_version").alias("version"),
        F.col("headers"),
        F.col("remote_addr"),
        F.col("fetched_at"),
        F.col("capture_id").alias("id"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*SOURCE_COLUMNS, "kind", "pos", "raw"]
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                found = extractor(json.loads(row.header), bytes(row.body))
                for pos, raw in enumerate(found):
                    rows.append((row.capture_id, row.surt, row.url, row.hops, kind, pos, raw))
                    if len(rows) == _PYTHON_ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    return captures.select(*SOURCE_COLUMNS, F.to_json(header).alias("header"), "body").mapInPandas(
        run,
        "capture_id string, surt string, url string, hops int, kind string, pos int, raw string",
    )

