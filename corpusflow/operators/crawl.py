"""The link graph: robots rules, link extraction, breadth-first crawl and discovery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.config import DISCOVERY_SKIP_EXTENSIONS, CrawlConfig
from corpusflow.functions import urls
from corpusflow.functions.text import half_up, trimmed

#: Characters of robots patterns that may be broadcast; more are met by a salted join.
RULES_BROADCAST, SALTS = 16 << 20, 64


def robots_rules(files: DataFrame, user_agent: str) -> DataFrame:
    """(origin, kind, pattern) from files(origin, status, body): rules under `*` or the agent's name.
    A file that wasn't answered with 200 has none."""
    agent = user_agent.split("/")[0].lower()
    lines = files.where("status = 200 AND body IS NOT NULL").select("origin", F.posexplode(F.split("body", "\n")).alias("pos", "raw"))
    line = trimmed(F.regexp_replace("raw", "#.*", ""))
    lines = lines.select("origin", "pos", F.lower(trimmed(F.substring_index(line, ":", 1))).alias("kind"), trimmed(F.when(F.instr(line, ":") > 0, F.substring(line, F.instr(line, ":") + 1, F.length(line))).otherwise("")).alias("pattern"))
    applies = F.when(F.col("kind") == "user-agent", F.lower("pattern").isin("*", agent))
    order = Window.partitionBy("origin").orderBy("pos")
    lines = lines.withColumn("applies", F.last(applies, ignorenulls=True).over(order))
    return lines.where("applies AND kind IN ('allow', 'disallow') AND pattern <> ''").select("origin", "kind", "pattern")


def robots_allowed(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """pages with `allowed`: the longest matching rule decides, ties allow, no rule allows. Rules are
    gathered to one row an origin first, so pages are joined once and never multiplied. They are broadcast
    where all patterns together are short; else origins are salted, as one may hold most of the pages."""
    gathered = rules.groupBy("origin").agg(F.collect_set(F.when(F.col("kind") == "disallow", F.col("pattern"))).alias("__deny"), F.collect_set(F.when(F.col("kind") == "allow", F.col("pattern"))).alias("__allow"))
    longest = lambda c: F.coalesce(F.array_max(F.transform(F.filter(c, lambda p: F.startswith(F.col("__path"), p)), F.length)), F.lit(-1))
    rows = pages.withColumn("__origin", urls.origin(F.col(url))).withColumn("__path", urls.path(F.col(url)))
    gathered = gathered.withColumnRenamed("origin", "__of")
    size = rules.agg(F.sum(F.length("pattern") + F.length("origin"))).first()[0] or 0
    if size <= RULES_BROADCAST:
        rows = rows.join(F.broadcast(gathered), F.col("__origin") == F.col("__of"), "left")
    else:
        gathered = gathered.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64(url), F.lit(SALTS)).cast("int"))
        rows = rows.join(gathered, (F.col("__origin") == F.col("__of")) & (F.col("__salt") == F.col("__s")), "left")
    deny, allow = longest(F.col("__deny")), longest(F.col("__allow"))
    return rows.withColumn("allowed", F.coalesce((deny == -1) | (allow >= deny), F.lit(True))).select(*pages.columns, "allowed")


def links(pages: DataFrame) -> DataFrame:
    """(src, pos, dst) of pages(url, links): links to pages, in normal form, the first of each target."""
    found = pages.select(F.col("url").alias("src"), F.posexplode("links").alias("pos", "href")).where(urls.is_link(F.col("href")))
    found = found.select("src", "pos", urls.normalize(F.col("href"), F.col("src")).alias("dst")).where("dst IS NOT NULL")
    return found.groupBy("src", "dst").agg(F.min("pos").alias("pos")).select("src", "pos", "dst")


def reachable(graph: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth) by breadth-first search over graph(src, dst) from seeds(url): one join a level, each
    level cut from its lineage by a checkpoint in the shared folder."""
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0)).checkpoint()
    front = seen
    for depth in range(1, max_depth + 1):
        reached = front.join(graph, front.url == graph.src).select(F.col("dst").alias("url")).distinct()
        front = reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def is_html(column: str):
    c = F.coalesce(F.col(column), F.lit(""))
    return c.contains("text/html") | c.contains("application/xhtml") | (c == "")


def outcomes(pages: DataFrame, rules: DataFrame, config: CrawlConfig) -> DataFrame:
    """pages(url, statusCode, contentType, ...) with `outcome`, by the first test that fails: domain,
    extension, robots, failed (no 2xx answer), non_html, else fetched."""
    rows = robots_allowed(pages, rules)
    url = F.col("url")
    outcome = (
        F.when(~urls.in_domains(url, config.allowed_domains), "domain")
        .when(urls.has_extension(url, config.skip_extensions), "extension")
        .when(~F.col("allowed"), "robots")
        .when(F.coalesce(~F.col("statusCode").between(200, 299), F.lit(True)), "failed")
        .when(~is_html("contentType"), "non_html")
        .otherwise("fetched")
    )
    return rows.withColumn("outcome", outcome).drop("allowed")


def walk(graph: DataFrame, seeds: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: Callable[[Column], Column], max_depth: int, most: int | None) -> DataFrame:
    """(url, depth, way, ...) of a breadth-first crawl in order of discovery: judge() adds `outcome` (and
    what else it likes) to rows (url, depth, way); only `fetched` ones are expanded, over graph(src, pos,
    dst), to targets that keep() allows. `way` holds the place of the seed and of each link on the first
    way to a url: within a level it orders urls as a queue would. Once `most` are fetched (None: never)
    the crawl ends, and what would come later in the queue is never looked at."""
    way = F.array(F.col("at").cast("long")).alias("way")
    front = seeds.groupBy("url").agg(F.min("at").alias("at")).select("url", F.lit(0).alias("depth"), way)
    seen, left = None, most
    for depth in range(max_depth + 1):
        front = judge(front).checkpoint()
        got = front.where("outcome = 'fetched'")
        if left is not None:
            n = got.count()
            if n >= left:
                last = got.orderBy("way").limit(left).agg(F.max("way").alias("last"))
                front = front.join(F.broadcast(last), F.col("way") <= F.col("last")).drop("last")  # one row
                return front if seen is None else seen.unionByName(front)
            left -= n
        seen = front if seen is None else seen.unionByName(front)
        if depth == max_depth or got.isEmpty():
            break
        reached = got.select("url", "way").join(graph, F.col("url") == F.col("src")).where(keep(F.col("dst")))
        reached = reached.groupBy(F.col("dst").alias("url")).agg(F.min(F.concat("way", F.array(F.col("pos").cast("long")))).alias("way"))
        front = reached.join(seen.select("url"), "url", "left_anti").select("url", F.lit(depth + 1).alias("depth"), "way")
    return seen


def _seeds(spark, config: CrawlConfig, seeds: DataFrame | None) -> DataFrame:
    """(url, at): normal urls of the seeds in their order; of a table of seeds in order of url."""
    if seeds is None:
        rows = spark.createDataFrame(list(enumerate(config.seeds)), "at int, url string")
    else:
        rows = seeds.select("url", F.lit(0).alias("at"))
    rows = rows.select(urls.normalize(F.col("url")).alias("url"), "at").where("url IS NOT NULL")
    if seeds is None:
        return rows
    return rows.select("url", F.conv(F.substring(F.sha2("url", 256), 1, 15), 16, 10).cast("long").alias("at"))


def crawl(web: DataFrame, rules: DataFrame, config: CrawlConfig, seeds: DataFrame | None = None) -> DataFrame:
    """Outcomes of the urls that a breadth-first crawl of web(url, html, statusCode, contentType, links)
    looks at, until max_pages of them are fetched (None: all), in order of discovery. Only fetched pages
    are expanded, up to max_depth. Links are read once, whatever the depth. seeds(url), where given, stand
    for those of config; they are taken in an order of their own, by a hash of the url."""
    answers = web.select("url", "statusCode", "contentType")
    graph = links(web.where(F.col("statusCode").between(200, 299) & is_html("contentType")).select("url", "links")).checkpoint()
    judge = lambda rows: outcomes(rows.join(answers, "url", "left"), rules, config)
    seen = walk(graph, _seeds(web.sparkSession, config, seeds), judge, lambda u: urls.in_domains(u, config.allowed_domains), config.max_depth, config.max_pages)
    rest = [c for c in web.columns if c not in ("links", "statusCode", "contentType")]
    return seen.drop("way").join(web.select(*rest), "url", "left")


def discover(web: DataFrame, config: CrawlConfig, seeds: DataFrame | None = None) -> DataFrame:
    """(url, lastmod) of the pages that the same walk finds to answer 200 with HTML, until there are
    max_pages; robots don't count, there are no retries."""
    answers = web.select("url", "statusCode", "contentType", "lastmod")
    graph = links(web.where((F.col("statusCode") == 200) & is_html("contentType")).select("url", "links")).checkpoint()
    url = F.col("url")
    good = urls.in_domains(url, config.allowed_domains) & ~urls.has_extension(url, DISCOVERY_SKIP_EXTENSIONS) & F.coalesce(F.col("statusCode") == 200, F.lit(False)) & is_html("contentType")
    judge = lambda rows: rows.join(answers, "url", "left").withColumn("outcome", F.when(good, "fetched").otherwise("skipped"))
    seen = walk(graph, _seeds(web.sparkSession, config, seeds), judge, lambda u: urls.in_domains(u, config.allowed_domains), config.max_depth, config.max_pages)
    return seen.where("outcome = 'fetched'").select("url", "lastmod")


def crawl_manifest(rows: DataFrame, seconds: float = 0.0, started_at: str | None = None, finished_at: str | None = None) -> DataFrame:
    """Counts by outcome, failed urls, begin and end, and the rounded duration."""
    n = lambda what: F.count_if(F.col("outcome") == what)
    failed = F.array_sort(F.collect_set(F.when(F.col("outcome") == "failed", F.col("url"))))
    return rows.agg(
        n("fetched").alias("pages_fetched"), n("failed").alias("pages_failed"), n("robots").alias("pages_skipped_robots"), n("domain").alias("pages_skipped_domain"), n("non_html").alias("pages_skipped_non_html"), n("extension").alias("pages_skipped_extension"),
        failed.alias("failed_urls"), half_up(F.lit(seconds)).alias("duration_seconds"), F.lit(started_at).cast("string").alias("started_at"), F.lit(finished_at).cast("string").alias("finished_at"),
    )
