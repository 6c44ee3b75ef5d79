"""Links between stored pages: edges, scope of a site, breadth-first reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules as rl
from lodestone.functions import urls as ux
from lodestone.operators.extract import extract_pages
from lodestone.operators.rank import number_rows
from lodestone.session import cut_lineage, small_batches


def page_links(pages: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Distinct edges (src_url, dst_url) to the same scheme and host.

    ``pages`` holds (url, links). With ``scope`` (url, scope_url) the target's path
    must begin with the scope's path.
    """
    rows = pages.withColumn("src_url", ux.normalize_url(F.col("url")))
    if scope is not None:
        rows = rows.join(scope.select(F.col("url").alias("src_url"), "scope_url"), "src_url")
    else:
        rows = rows.withColumn("scope_url", F.concat(ux.url_site(F.col("src_url")), F.lit("/")))
    edges = rows.select("src_url", "scope_url", F.explode_outer("links").alias("link"))
    edges = edges.where("link is not null")
    target = ux.normalize_url(ux.resolve_link(F.col("src_url"), F.col("link")))
    edges = edges.withColumn("dst_url", target)
    inside = (ux.url_site(F.col("dst_url")) == ux.url_site(F.col("scope_url"))) & F.startswith(
        ux.url_path(F.col("dst_url")), ux.url_path(F.col("scope_url"))
    )
    return edges.where(inside).select("src_url", "dst_url").distinct()


def page_scope(pages: DataFrame) -> DataFrame:
    """(url, scope_url): deepest breadcrumb above the page, else its folder.

    ``pages`` holds (url, breadcrumb_links, json_ld_blocks). JSON-LD breadcrumbs go
    before those of the markup.
    """
    url = ux.normalize_url(F.col("url"))
    small_batches(pages.sparkSession)
    base = pages.select(url.alias("url"), "breadcrumb_links", "json_ld_blocks")
    links = base.mapInArrow(ux.crumb_links, "url string, level int, place int, link string")
    crumbs = links.withColumn("crumb", ux.normalize_url(F.col("link")))
    above = crumbs.where(
        F.col("crumb").isNotNull()
        & (F.col("crumb") != F.col("url"))
        & ux.is_scope_ancestor(F.col("crumb"), F.col("url"))
    )
    depth = F.length(ux.url_path(F.col("crumb")))
    chosen = above.groupBy("url").agg(
        F.max_by("crumb", F.struct("level", depth, -F.col("place"))).alias("crumb")
    )
    return (
        base.select("url")
        .distinct()
        .join(chosen, "url", "left")
        .select("url", F.coalesce("crumb", ux.url_scope(F.col("url"))).alias("scope_url"))
    )


#: Links of a page that one task follows; hub pages are dealt out in so many each.
HUB = 10_000


def dealt_links(links: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """(src_url, part, dst_url) and (src_url, parts) of the hub pages: links of a hub lie in several parts."""
    hubs = cut_lineage(links.groupBy("src_url").agg(F.ceil(F.count("*") / hub).cast("int").alias("parts")).where("parts > 1"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst_url"), F.col("parts"))).cast("int")
    return cut_lineage(links.join(hubs, "src_url", "left").select("src_url", part.alias("part"), "dst_url")), hubs


def _first_of_each(step: DataFrame, left: DataFrame) -> DataFrame:
    """Of each root's pages, in order of URLs, as many as it may still visit.

    A range sort places all pages, so a root with most of them isn't in one task; its pages are numbered from its first one.
    """
    numbered = cut_lineage(number_rows(step, [F.col("root"), F.col("url")], "_n"))
    firsts = numbered.groupBy("root").agg(F.min("_n").alias("_first"), F.count("*").alias("_size"))
    bounds = cut_lineage(firsts.join(left, "root"))
    return numbered.join(bounds, "root").where(F.col("left").isNull() | (F.col("_n") - F.col("_first") < F.col("left"))).select("root", "url")


def crawl_roots(
    links: DataFrame, roots: DataFrame, max_depth: int, rules: list[str] = (), max_pages: int | None = None, hub: int = HUB
) -> DataFrame:
    """(root, url, depth): what each root reaches over (src_url, dst_url) edges, all roots in one loop.

    ``roots`` holds (root, url) and may hold several seeds of a root. One round per level: the frontier of all roots is
    joined with the edges, and what a root has seen is dropped. ``max_pages`` is each root's quota, held
    inside the loop: of a level that would exceed it the first URLs stay, and the root leaves the frontier. The
    loop ends when no root has a frontier. Every round is kept as a table, so the plan does not grow and a lost executor
    costs one round. URLs hit by a rule are not visited and not followed.
    """
    hidden = rl.excluded_url(F.col("url"), rules)
    edges, hubs = dealt_links(links, hub)
    all_roots = cut_lineage(roots.select("root").distinct())
    quota = F.lit(max_pages).cast("bigint")

    def within(step: DataFrame, reached: DataFrame | None) -> DataFrame:
        if max_pages is None:
            return step
        used = all_roots.withColumn("left", quota)
        if reached is not None:
            counts = reached.groupBy("root").agg(F.count("*").alias("seen"))
            used = all_roots.join(counts, "root", "left").select("root", (quota - F.coalesce("seen", F.lit(0))).alias("left"))
        return _first_of_each(step, used.where("left > 0"))

    frontier = cut_lineage(within(roots.select("root", "url").distinct().where(~hidden), None).withColumn("depth", F.lit(0)))
    reached = frontier
    for depth in range(1, max_depth + 1):
        asked = frontier.join(hubs.withColumnRenamed("src_url", "url"), "url", "left")
        parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        asked = asked.select("root", F.col("url").alias("src_url"), F.explode(parts).alias("part"))
        step = (
            asked.join(edges, ["src_url", "part"])
            .select("root", F.col("dst_url").alias("url"))
            .distinct()
            .where(~hidden)
            .join(reached.select("root", "url"), ["root", "url"], "left_anti")
        )
        frontier = cut_lineage(within(step, reached).withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def crawl_frontier(
    links: DataFrame, seeds: DataFrame, max_depth: int, rules: list[str] = (), max_pages: int | None = None
) -> DataFrame:
    """(url, depth) reached from the seeds, as one root; ``max_pages`` counts in breadth-first order, ties by URL."""
    one = seeds.select(F.lit("").alias("root"), "url")
    return crawl_roots(links, one, max_depth, rules, max_pages).drop("root")


def pages_with_links(pages: DataFrame) -> DataFrame:
    """Stored pages (url, html) with what the link operators need."""
    return extract_pages(pages).select("url", "links", "breadcrumb_links", "json_ld_blocks")


def stored_targets(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored pages that some current link points to."""
    keyed = pages.withColumn("dst_url", ux.normalize_url(F.col("url")))
    return keyed.join(links.select("dst_url"), "dst_url", "left_semi").drop("dst_url")
