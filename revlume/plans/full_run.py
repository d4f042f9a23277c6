"""A full run: landed raw pages in, clean, scored and sorted reviews out."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, functions as F

from revlume.functions import output_name
from revlume.functions.naming import SLUG_OF_KEY
from revlume.operators.aggregates import run_summary, throughput
from revlume.operators.analysis import Scorer, analyze_reviews
from revlume.operators.combine import union_all
from revlume.operators.dedup import country_order, dedup_first_seen
from revlume.operators.filters import in_countries, up_to_page, within_window
from revlume.operators.joins import only, with_attributes
from revlume.operators.projections import (
    extended_columns, standard_columns, with_platform_key,
)
from revlume.operators.walk import batch_stats, keep_reached, mark_reached
from revlume.schema import GOOGLE_PAGE_KEY, GOOGLE_WALK_KEY, PAGE_KEY
from revlume.session import staged
from revlume.sources.app_store import (
    QUALITY, page_quality, page_reviews, page_stats, read_pages, with_page_stats,
)
from revlume.sources.catalog import CONFIG_ERROR_CODE, catalog_errors
from revlume.sources.google_play import parse_google_play
from revlume.sources.sinks import named_outputs, sorted_by_output, write_csv, write_summary

log = logging.getLogger(__name__)

OUTPUT_MODES = ("reviews", "analysis", "both")
OUTPUT_KINDS = ("reviews", "analysis")


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run; ``as_of`` stands for "now".

    Landed pages are all read unless a page cap is given; ``max_pages``
    overrides the caps of both stores.  A platform that fails ends the run,
    unless ``keep_going`` asks to go on without it; the summary then names the
    error.
    """

    as_of: datetime
    platforms: tuple[str, ...] = ("app-store", "google-play")
    countries: tuple[str, ...] = ("us",)
    max_pages_app_store: int | None = None
    max_pages_google_play: int | None = None
    max_pages: int | None = None
    output_mode: str = "analysis"
    single_file: bool = True
    extended_fields: bool = False
    strict_page: bool = False
    interrupted: bool = False
    keep_going: bool = False

    def __post_init__(self):
        if self.output_mode not in OUTPUT_MODES:
            raise ValueError(f"output_mode must be one of {OUTPUT_MODES}")

    @property
    def app_store_cap(self) -> int | None:
        return self.max_pages_app_store if self.max_pages is None else self.max_pages

    @property
    def google_play_cap(self) -> int | None:
        return self.max_pages_google_play if self.max_pages is None else self.max_pages

    @property
    def write_raw(self) -> bool:
        return self.output_mode in ("reviews", "both")

    @property
    def write_analysis(self) -> bool:
        return self.output_mode in ("analysis", "both")


@dataclass(frozen=True)
class RunResult:
    reviews: DataFrame
    summary: DataFrame
    rejected: DataFrame
    paths: tuple[str, ...]


def _clean(
    rows: DataFrame, marked: DataFrame, cap: int | None, config: RunConfig, page_key: list[str]
) -> DataFrame:
    reached = within_window(keep_reached(rows, marked, cap, page_key), config.as_of)
    ordered = reached.withColumn("country_order", country_order(config.countries))
    return with_platform_key(dedup_first_seen(ordered))


def clean_app_store(
    pages: DataFrame, config: RunConfig, quality: list[DataFrame] | None = None
) -> DataFrame:
    """Pages of the selected countries to clean reviews.

    What each app's pages held besides reviews is added to ``quality``.

    Bodies are parsed once, into a staged table; the walk then reads only the
    figures of each page.
    """
    wanted = up_to_page(in_countries(pages, config.countries), config.app_store_cap)
    read = staged(with_page_stats(read_pages(wanted, config.strict_page)), "app-store")
    marked = mark_reached(page_stats(read), config.as_of, config.app_store_cap)
    if quality is not None:
        quality.append(page_quality(page_stats(read), "app_id"))
    return _clean(page_reviews(read), marked, config.app_store_cap, config, PAGE_KEY)


def clean_google_play(batches: DataFrame, config: RunConfig) -> DataFrame:
    """Batches to clean reviews; the walk reads only times and tokens.

    Batches are landed rows of the wanted apps only: read for the walk and again
    for the reviews, so they are worked out once, into a staged table.
    """
    batches = staged(batches, "google-play-batches")
    marked = mark_reached(
        batch_stats(batches), config.as_of, config.google_play_cap,
        is_last=F.col("is_last"), walk_key=GOOGLE_WALK_KEY,
    )
    # Read for the unreached pages and for their number: worked out once.
    marked = staged(marked, "google-play-pages")
    rows = parse_google_play(batches)
    return _clean(rows, marked, config.google_play_cap, config, GOOGLE_PAGE_KEY)


def _collect(
    name: str, clean: Callable[[DataFrame, RunConfig], DataFrame],
    landed: DataFrame, apps: DataFrame, config: RunConfig, errors: dict[str, str],
) -> DataFrame | None:
    """Clean reviews of one platform, staged.

    A failure is raised; only with ``keep_going`` it is put down in ``errors``
    and the run goes on.
    """
    selected = apps.where(F.array_contains("platforms", name))
    try:
        wanted = only(landed, selected, ["app_id"], spread_by=["country", "page"])
        return staged(clean(wanted, config), name)
    except Exception as error:
        if not config.keep_going:
            raise
        log.exception("collecting %s failed; going on without it", name)
        errors[name] = f"{type(error).__name__}: {str(error)[:500]}"
        return None


def _files_written(config: RunConfig) -> Column:
    """Names of the outputs that hold rows of an app."""
    kinds = [k for k, on in ((False, config.write_raw), (True, config.write_analysis)) if on]
    name = F.col("app_name")
    if config.single_file:
        made = [
            F.when(F.col("total_reviews") > 0, output_name(name, None, F.lit(k)))
            for k in kinds
        ]
    else:
        made = [
            F.when(F.col(key) > 0, output_name(name, F.lit(key), F.lit(k)))
            for key in SLUG_OF_KEY
            for k in kinds
        ]
    return F.array_compact(F.array(*made)).alias("files_written")


def _write(
    reviews: DataFrame, path: str, config: RunConfig, scorer: Scorer | None
) -> int:
    """One sorted CSV dataset with a folder per output name; returns its number of rows.

    Rows are scored after the sort: a range sort reads its input twice, and
    scores do not change the order.  They are counted while they are written,
    behind the sort, where each partition counts once.
    """
    named = named_outputs(
        reviews, F.col("app_name"), config.single_file, analysis=scorer is not None
    )
    ordered = sorted_by_output(named)
    pick = extended_columns if config.extended_fields else standard_columns
    keep = ["output_name"]
    if scorer is not None:
        ordered = analyze_reviews(ordered, scorer)
        keep += ["sentiment_score", "sentiment_label"]
    columns = pick(ordered, *keep)
    if scorer is not None:
        scores = ["sentiment_score", "sentiment_label"]
        others = [c for c in columns.columns if c not in scores]
        columns = columns.select(*others, *scores)
    written = Observation()
    counted = columns.observe(written, F.count(F.lit(1)).alias("n_rows"))
    return written.get["n_rows"] if write_csv(counted, path, ["output_name"], same_rows=reviews) else 0


def run(
    catalog: DataFrame,
    app_store_pages: DataFrame,
    google_play_batches: DataFrame,
    out_dir: str,
    config: RunConfig,
    scorer: Scorer | None = None,
    run_id: str = "run",
) -> RunResult:
    """Validate, collect, write and summarise.

    ``scorer`` comes from ``choose_scorer`` and is needed for the analysis
    output.  Outputs go to ``{out_dir}/reviews`` and ``{out_dir}/analysis``.  The
    summary goes last, to the folder of ``run_id`` in ``{out_dir}/run_summary``, and
    takes the place of what a run of that id left there: a run that failed and is
    started again leaves the rows of one.
    """
    if config.write_analysis and scorer is None:
        raise ValueError("the analysis output needs a scorer")
    started = time.monotonic()
    selected = F.array(*[F.lit(p) for p in config.platforms]).cast("array<string>")
    asked = catalog.withColumn(
        "platforms", F.filter("platforms", lambda p: F.array_contains(selected, p))
    )
    checked = catalog_errors(asked)
    rejected = checked.where(F.size("errors") > 0).withColumn(
        "exit_code", F.lit(CONFIG_ERROR_CODE)
    )
    # Read by every join with the apps: checked once.
    apps = staged(checked.where(F.size("errors") == 0).select("app_id", "app_name", "platforms"), "apps")

    quality: list[DataFrame] = []
    sources = {
        "app-store": (partial(clean_app_store, quality=quality), app_store_pages),
        "google-play": (clean_google_play, google_play_batches),
    }
    errors: dict[str, str] = {}
    parts = [
        _collect(name, *sources[name], apps, config, errors)
        for name in sources
        if name in config.platforms
    ]
    found = [p for p in parts if p is not None]
    collected = time.monotonic()
    paths: list[str] = []
    rows_written: dict[str, int] = {}
    writing: dict[str, float] = {}
    if found:
        names = apps.select("app_id", "app_name")
        reviews = with_attributes(union_all(*found), names, ["app_id"], spread_by=["text_hash"])
        for kind, wanted, with_scorer in (
            ("reviews", config.write_raw, None),
            ("analysis", config.write_analysis, scorer),
        ):
            if not wanted:
                continue
            path, begun = f"{out_dir}/{kind}", time.monotonic()
            rows_written[kind] = _write(reviews, path, config, with_scorer)
            writing[kind] = round(time.monotonic() - begun, 2)
            if rows_written[kind]:
                paths.append(path)
        counted = reviews.select("app_id", "platform")
    else:
        reviews = None
        counted = apps.sparkSession.createDataFrame([], "app_id string, platform string")
    finished = time.monotonic()

    summary = with_attributes(
        run_summary(apps, counted, F.lit(config.interrupted), *SLUG_OF_KEY),
        apps.select("app_id", "app_name"), ["app_id"], spread_by=[],
    )
    read = quality[0] if quality else apps.select("app_id", *[F.lit(0).cast("long").alias(c) for c in QUALITY])
    summary = with_attributes(summary, read, ["app_id"], spread_by=[]).select(
        F.lit(run_id).alias("run_id"),
        "app_id", "status", "exit_code", "total_reviews", "by_platform",
        _files_written(config),
        F.lit(round(finished - started, 2)).alias("duration_seconds"),
        F.lit(round(collected - started, 2)).alias("collecting_seconds"),
        throughput(F.col("total_reviews"), F.lit(collected - started)).alias("reviews_per_second"),
        *[F.lit(rows_written.get(k)).cast("long").alias(f"run_{k}_rows") for k in OUTPUT_KINDS],
        *[F.lit(writing.get(k)).cast("double").alias(f"run_{k}_seconds") for k in OUTPUT_KINDS],
        "platforms_failed", "interrupted",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in QUALITY[1:]],
        F.lit(json.dumps(errors, sort_keys=True)).alias("platform_errors"),
    )
    summary = staged(summary, "summary")
    write_summary(summary, f"{out_dir}/run_summary")
    return RunResult(reviews, summary, rejected, tuple(paths))
