"""python -m stagehand: fetch pages, extract rows, build the weekly snapshot, judge, index, search and serve it, tell what changed, probe and patch venues, write the page."""

from __future__ import annotations

import argparse
import datetime
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagehand import service
from stagehand.operators import audits, judgement, numbering, patches, search, snapshots
from stagehand.operators import build as steps
from stagehand.session import build
from stagehand.sources import fetching, listings, probes, sinks, validation


def extract(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Shows of the chosen venues, from their listings and their own pages; unknown ids are an error."""
    venues = listings.registry(spark, a.venues)
    ids = {r["id"] for r in venues.select("id").collect()}  # the registry is a small file of settings
    chosen = venues.filter(F.col("id").isin(*steps.select_ids(ids, a.ids, a.exclude)))
    pages = spark.read.parquet(a.pages)
    return steps.crawl(listings.extract(chosen, pages, F.lit(a.as_of)), chosen, pages, F.lit(a.as_of), a.weeks)


def taste(path: str | None, spark: SparkSession) -> judgement.Taste:
    """What judgements depend on, from a JSON object."""
    return judgement.Taste(**json.loads(whole(path, spark))) if path else judgement.Taste()


def whole(path: str, spark: SparkSession) -> str:
    """One small text, from any store that Spark reads."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def numbered(snapshot: DataFrame) -> DataFrame:
    """Events with ``idx``, their place by date, venue and title."""
    return numbering.numbered(snapshot, "first_date", "venue_id", "title")


def settings(path: str, spark: SparkSession) -> DataFrame:
    """(``id``, ``fields``) of a JSON list of objects, or an object with ``venues``: a registry or patches as maps of JSON texts."""
    rows = json.loads(whole(path, spark))
    rows = rows.get("venues", []) if isinstance(rows, dict) else rows
    return spark.createDataFrame([(r["id"], {k: json.dumps(v) for k, v in r.items() if k != "id"}) for r in rows], "id string, fields map<string,string>")


def probed(venues: DataFrame, pages: DataFrame) -> DataFrame:
    """The signals of each venue by the pages at hand, REST indexes and sitemaps of their sites among them."""
    asked = venues.select(F.col("whats_on_url").alias("url")).distinct()
    listing = pages.join(asked, "url").select("url", F.coalesce("final_url", "url").alias("final_url"), "status", "body")
    sites = listing.select(F.col("final_url").alias("base")).distinct()
    types = sites.withColumn("url", fetching.rest_index(F.col("base"))).join(pages.select("url", "body"), "url").select("base", "body")
    return probes.probe(venues, listing, types, probes.sitemaps(sites, pages))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    day = datetime.date.fromisoformat
    top = argparse.ArgumentParser(prog="stagehand", description=__doc__)
    subs = top.add_subparsers(dest="task", required=True)
    p = subs.add_parser("extract")
    for name in ("--venues", "--pages", "--out"):
        p.add_argument(name, required=True)
    p.add_argument("--as-of", type=day, required=True)
    p.add_argument("--weeks", type=int, default=8)
    p.add_argument("--ids", nargs="*", default=[])
    p.add_argument("--exclude", nargs="*", default=[])
    p = subs.add_parser("build")
    for name in ("--raw", "--venues", "--snapshots"):
        p.add_argument(name, required=True)
    for name in ("--generated", "--start", "--end"):
        p.add_argument(name, type=day, required=True)
    p.add_argument("--force", action="store_true")
    p = subs.add_parser("changed")
    p.add_argument("--snapshots", required=True)
    p.add_argument("--generated", type=day, required=True)
    p = subs.add_parser("audit")
    p.add_argument("--snapshot", required=True)
    p = subs.add_parser("page")
    for name in ("--snapshot", "--venues", "--template", "--out"):
        p.add_argument(name, required=True)
    p = subs.add_parser("fetch")
    p.add_argument("--venues", required=True)
    p.add_argument("--pages", required=True)
    p.add_argument("--now", type=datetime.datetime.fromisoformat, required=True)
    p.add_argument("--rows", help="an extract whose shows' own pages are fetched, in place of listings")
    p.add_argument("--signals", action="store_true", help="fetch what probes look at too")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--tasks", type=int, default=64)
    p = subs.add_parser("refine")
    for name in ("--snapshot", "--cache", "--out"):
        p.add_argument(name, required=True)
    p.add_argument("--as-of", type=day, required=True)
    p.add_argument("--taste")
    p.add_argument("--limit", type=int)
    p.add_argument("--dry-run", action="store_true")
    p = subs.add_parser("embed")
    for name in ("--snapshot", "--venues", "--out"):
        p.add_argument(name, required=True)
    for task in ("search", "serve"):
        p = subs.add_parser(task)
        for name in ("--snapshot", "--venues", "--index"):
            p.add_argument(name, required=True)
        if task == "search":
            p.add_argument("query", nargs="?", default="")
            p.add_argument("--tags")
            p.add_argument("--venue")
            p.add_argument("--limit", type=int)
        else:
            p.add_argument("--page")
            p.add_argument("--host", default="127.0.0.1")
            p.add_argument("--port", type=int, default=8000)
    for task in ("probe", "validate", "urls"):
        p = subs.add_parser(task)
        for name in ("--venues", "--pages", "--out"):
            p.add_argument(name, required=True)
        if task == "validate":
            p.add_argument("--as-of", type=day, required=True)
    p = subs.add_parser("inspect")
    p.add_argument("--pages", required=True)
    p.add_argument("--url", required=True)
    p = subs.add_parser("patch")
    for name in ("--registry", "--patches", "--out"):
        p.add_argument(name, required=True)
    p.add_argument("--as-of", type=day, required=True)
    a = top.parse_args(argv)
    spark = spark or build()
    if a.task == "extract":
        extract(spark, a).write.mode("overwrite").parquet(a.out)
    elif a.task == "build":
        seasonal = listings.registry(spark, a.venues).filter("seasonal").select(F.col("id").alias("venue_id"))
        try:
            built = steps.normalised(spark.read.parquet(a.raw), a.start, a.end)
            sinks.guarded_save(steps.records(built), a.snapshots, a.generated.isoformat(), "venue_id", seasonal, a.force)
        except sinks.Refused as e:
            print(f"refused: {e}", file=sys.stderr)
            return 2
        for name, rows in (("dropped", steps.dropped(built).groupBy("reason").count()), ("no copy", steps.without_copy(built).groupBy("venue_id").count())):
            for r in rows.orderBy(F.desc("count")).collect():  # a row for each reason or venue
                print(f"{name}: {r[0]} {r[1]}")
    elif a.task == "changed":
        new = spark.read.parquet(f"{a.snapshots.rstrip('/')}/generated={a.generated}")
        old = sinks.before(spark, a.snapshots, a.generated.isoformat())
        row = lambda df: df.select(snapshots.fingerprint(*[F.col(c) for c in sorted(new.columns)]).alias("print"))
        same = old is not None and snapshots.difference(row(old), row(new), ["print"]).isEmpty()
        print("same" if same else "changed")
        return 1 if same else 0
    elif a.task == "audit":
        events = spark.read.parquet(a.snapshot)
        found = audits.grade(events, ["venue_id", "title"])
        for r in snapshots.top_groups(found, "rule", "venue_id").orderBy("rule", "place").collect():  # four rows a rule
            print(f"{r['rule']}: {r['venue_id']} {r['n']}")
    elif a.task == "fetch":
        venues = listings.registry(spark, a.venues)
        asked = fetching.of_details(spark.read.parquet(a.rows), venues) if a.rows else fetching.of_probes(venues) if a.signals else fetching.of_listings(venues)
        hours = 0 if a.no_cache else fetching.DETAIL_HOURS if a.rows else fetching.LISTING_HOURS
        fetching.refresh(asked, a.pages, F.lit(a.now), hours, a.tasks)
    elif a.task == "refine":
        events, start = spark.read.parquet(a.snapshot), spark.createDataFrame([], judgement.CACHE)
        cache = sinks.read_or(start, a.cache)
        some = events.orderBy("first_date", "venue_id", "title").limit(a.limit) if a.limit else events
        done = judgement.refine(some, cache, taste(a.taste, spark), F.lit(a.as_of), prune=not a.limit)
        for name, n in done.stats.first().asDict().items():
            print(f"{name}: {n}")
        if not a.dry_run:
            done.kept.write.mode("overwrite").parquet(a.out)
            sinks.swap(done.cache, a.cache)
    elif a.task == "embed":
        events = numbered(spark.read.parquet(a.snapshot))
        search.embedded(search.event_chunks(events, listings.registry(spark, a.venues))).write.mode("overwrite").parquet(a.out)
    elif a.task in ("search", "serve"):
        events, index, venues = numbered(spark.read.parquet(a.snapshot)), spark.read.parquet(a.index), listings.registry(spark, a.venues)
        if a.task == "search":
            for r in search.retrieve(events, index, venues, a.query, tags=search.parse_tags(a.tags), venue=a.venue, limit=a.limit).collect():  # at most 80 rows
                print(f"{r['id']} {r['score']:.4f} {r['venue_id']} {r['title']}")
        else:
            service.server(service.Service(events, index, venues, whole(a.page, spark) if a.page else ""), a.port, a.host).serve_forever()
    elif a.task in ("probe", "validate", "urls"):
        venues, pages = listings.registry(spark, a.venues), fetching.latest(spark.read.parquet(a.pages))
        if a.task == "urls":
            found = probes.resolved(venues.withColumn("url_candidates", F.lit(None).cast("array<string>")), pages)
            sinks.as_json(found, a.out)
        else:
            signals = probed(venues, pages)
            sinks.as_json(signals if a.task == "probe" else validation.validate(venues, signals, pages, F.lit(a.as_of)), a.out)
    elif a.task == "inspect":
        page = fetching.latest(spark.read.parquet(a.pages).filter(F.col("url") == a.url))
        for r in probes.suggested_cards(page, "url", "body").orderBy("place").collect():  # at most 25 rows
            print(f"{r['n']} {r['signature']}")
    elif a.task == "patch":
        registry, named = settings(a.registry, spark), settings(a.patches, spark)
        patches.merge(registry, named, F.lit(a.as_of)).write.mode("overwrite").parquet(a.out)
        for r in patches.missed(registry, named).orderBy("id").collect():  # a row a wrong patch
            print(f"no venue {r['id']}")
    else:
        sinks.artifact(spark.read.parquet(a.snapshot), listings.registry(spark, a.venues), whole(a.template, spark), ["first_date", "venue_id", "title"]).write.mode("overwrite").text(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
