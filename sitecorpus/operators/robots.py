"""What robots files allow.

A robots file is one input row, so its lines, groups and rules are bounded by
that row.  The rules of the group that counts become one array per site; a URL
then needs one join on the site and no aggregation.  Rules of long files are a table
of their own, keyed by site and path, and a URL meets them by its prefixes of the lengths
that occur there, so that its cost does not grow with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitecorpus.checkpoints import cut
from sitecorpus.functions import urls

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

# Paths that stay open although a rule denies them.
COMMON_SITEMAPS = ["/sitemap.xml", "/wp-sitemap.xml", "/sitemap_index.xml"]
# Paths open on a site that hides its robots file, conservative policy.
OPEN_PATHS = ["", "/", "/index.html", "/index.php", "/sitemap.xml", "/robots.txt"]
# Fixed value: seconds between requests on a site that hides its robots file.
DENIED_DELAY = 10.0
#: Rules of a site that are tried one by one; longer files are met by a join on the prefixes of a URL.
FEW_RULES = 64


def robots_lines(robots_docs: DataFrame) -> DataFrame:
    """``(site, pos, blank, key, value)`` of each line of the files that were read."""
    lines = robots_docs.where("status between 200 and 299").select(
        "site", F.posexplode(F.split("body", LINE_BREAK)).alias("pos", "line")
    )
    text = F.substring_index("line", "#", 1)
    has_value = F.instr(text, ":") > 0
    return lines.select(
        "site",
        "pos",
        (F.col("line") == "").alias("blank"),
        F.when(has_value, F.lower(F.trim(F.substring_index(text, ":", 1)))).alias("key"),
        F.when(has_value, urls.percent_decoded(F.trim(F.regexp_extract(text, r"^[^:]*:([\s\S]*)", 1)))).alias("value"),
    )


def _plain(path: Column) -> Column:
    """A rule or URL without the marks of an empty fragment, query or parameter part."""
    path = F.regexp_replace(path, r"^([^#]*)#\z", "$1")
    path = F.regexp_replace(path, r"^([^#?]*)\?(#|\z)", "$1$2")
    return F.regexp_replace(path, r"^((?:[^#?]*/)?[^#?;/]*);([?#]|\z)", "$1$2")


def robots_groups(robots_docs: DataFrame) -> DataFrame:
    """Lines of valid groups, ``(site, pos, group_id, key, value)``.

    A group opens at an agent line that does not follow another one; a blank
    line closes it; a group without any rule does not count.
    """
    key = F.col("key")
    mark = (
        F.when(F.col("blank"), "blank")
        .when(key == "user-agent", "agent")
        .when(key.isin("allow", "disallow", "crawl-delay", "request-rate"), "rule")
    )
    by_line = Window.partitionBy("site").orderBy("pos")
    lines = (
        robots_lines(robots_docs)
        .withColumn("mark", mark)
        .where("mark is not null")
        .withColumn("previous", F.lag("mark").over(by_line))
    )
    opens = (F.col("mark") == "blank") | (
        (F.col("mark") == "agent") & (F.coalesce("previous", F.lit("")) != "agent")
    )
    segment = Window.partitionBy("site", "group_id")
    return (
        lines.withColumn("group_id", F.sum(opens.cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("has_agent", F.max(F.col("mark") == "agent").over(segment))
        .withColumn("has_rule", F.max(F.col("mark") == "rule").over(segment))
        .where("has_agent and has_rule and mark <> 'blank'")
        .select("site", "pos", "group_id", "key", "value")
    )


def robots_rules(robots_docs: DataFrame) -> DataFrame:
    """``(site, group_id, agents, pos, allow, path)``; an empty ``Disallow`` allows all."""
    groups = robots_groups(robots_docs)
    agents = groups.where("key = 'user-agent'").groupBy("site", "group_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("agents")
    )
    rules = groups.where("key in ('allow', 'disallow')")
    return rules.join(agents, ["site", "group_id"]).select(
        "site",
        "group_id",
        F.col("agents.value").alias("agents"),
        "pos",
        ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"),
        _plain(F.col("value")).alias("path"),
    )


def chosen_groups(robots_docs: DataFrame, agent: str) -> DataFrame:
    """R2: ``(site, group_id)`` that speaks for ``agent``: the first that names it, else the first for ``*``."""
    token = agent.split("/")[0].lower()
    groups = robots_groups(robots_docs).where("key = 'user-agent'")
    per_group = groups.groupBy("site", "group_id").agg(
        F.max(F.col("value") == "*").alias("for_all"),
        F.max(F.contains(F.lit(token), F.lower("value"))).alias("named"),
    )
    return (
        per_group.groupBy("site")
        .agg(
            F.min(F.when(~F.col("for_all") & F.col("named"), F.col("group_id"))).alias("named"),
            F.min(F.when(F.col("for_all"), F.col("group_id"))).alias("default"),
        )
        .select("site", F.coalesce("named", "default").alias("group_id"))
        .where("group_id is not null")
    )


def listed_sitemaps(robots_docs: DataFrame) -> DataFrame:
    """``(site, pos, sitemap)``; sites that hide their robots file get three usual places."""
    named = robots_lines(robots_docs).where("key = 'sitemap'").select("site", "pos", F.col("value").alias("sitemap"))
    usual = robots_docs.where("status = 403").select(
        "site", F.posexplode(F.array(*[F.lit(p) for p in COMMON_SITEMAPS])).alias("pos", "path")
    )
    return named.unionByName(usual.select("site", "pos", F.concat("site", "path").alias("sitemap")))


def site_policies(robots_docs: DataFrame, agent: str) -> DataFrame:
    """One row per site: ``site, denied, rules, crawl_delay, sitemaps``.

    Any failed answer but 403, and no answer, leaves a site without rules: all is allowed.
    """
    groups = robots_groups(robots_docs).join(chosen_groups(robots_docs, agent), ["site", "group_id"])
    rule = F.struct(
        "pos",
        ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"),
        _plain(F.col("value")).alias("path"),
    )
    digits = F.when((F.col("key") == "crawl-delay") & F.col("value").rlike(r"^[0-9]+\z"), F.col("value"))
    chosen = groups.groupBy("site").agg(
        F.array_sort(F.collect_list(F.when(F.col("key").isin("allow", "disallow"), rule))).alias("rules"),
        F.max_by(digits.cast("double"), F.when(digits.isNotNull(), F.col("pos"))).alias("delay"),
    )
    maps = listed_sitemaps(robots_docs).groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("pos", "sitemap"))).alias("maps")
    )
    denied = F.coalesce(F.col("status") == 403, F.lit(False))
    return cut(
        robots_docs.select("site", "status")
        .join(chosen, "site", "left")
        .join(maps, "site", "left")
        .select(
            "site",
            denied.alias("denied"),
            "rules",
            F.when(denied, F.lit(DENIED_DELAY)).when(F.col("delay") > 0, F.col("delay")).alias("crawl_delay"),
            F.coalesce("maps.sitemap", F.array().cast("array<string>")).alias("sitemaps"),
        ),
        "policies",
    )


def first_long_rules(urls_of_sites: DataFrame, long: DataFrame) -> DataFrame:
    """``(site, text, allow)``: of the rules in ``long (site, rules)`` the first in file order that begins each text.

    ``urls_of_sites`` holds ``site, text``.  One equi-join on site and prefix; of rules with one path the first counts.
    """
    rules = long.select("site", F.explode("rules").alias("rule")).groupBy("site", F.col("rule.path").alias("prefix")).agg(
        F.min(F.struct("rule.pos", "rule.allow")).alias("first")
    )
    lengths = rules.groupBy("site").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    reached = F.filter("lengths", lambda n: n <= F.length("text"))
    prefixes = (
        urls_of_sites.join(lengths, "site").select("site", "text").distinct()
        .join(lengths, "site")
        .select("site", "text", F.explode(reached).alias("n"))
        .select("site", "text", F.expr("left(text, n)").alias("prefix"))
    )
    return prefixes.join(rules, ["site", "prefix"]).groupBy("site", "text").agg(F.min("first").alias("first")).select("site", "text", "first.allow")


def with_decision(
    df: DataFrame, policies: DataFrame, url: str = "url", policy_403: str = "allow", respect: bool = True
) -> DataFrame:
    """Add ``site``, ``allowed`` and ``why`` to rows that hold a URL.

    The first matching rule in file order decides, as a plain prefix.  A URL of
    a site without a known policy is allowed.  ``why`` names what decided.
    """
    if policy_403 not in ("allow", "conservative"):
        raise ValueError(f"unknown 403 policy {policy_403!r}")
    df = urls.with_url_parts(df, url, "__u_")
    df = df.withColumn("site", urls.site_key(F.col("__u_scheme"), F.col("__u_netloc")))
    path = F.col("__u_path")
    if not respect:
        df = df.withColumns({"allowed": F.lit(True), "why": F.lit("robots ignored")})
        return urls.drop_parts(df, "__u_")
    # The text a rule is matched with: all after the host, decoded.
    text = F.regexp_replace(urls.percent_decoded(urls.cleaned(F.col(url))), r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    text = _plain(F.regexp_replace(text, "^//[^/?#]*", ""))
    text = F.when(text == "", F.lit("/")).when(text.startswith("//"), F.concat(F.lit("//"), text)).otherwise(text)
    df = df.withColumn("__text", text)
    few = F.coalesce(F.size("rules") <= FEW_RULES, F.lit(True))
    long = policies.where(~few).select("site", "rules")
    by_index = F.lit(None).cast("boolean")
    if not long.isEmpty():
        found = first_long_rules(df.select("site", F.col("__text").alias("text")), long)
        df = df.join(found.select(F.col("site").alias("__s"), F.col("text").alias("__t"), F.col("allow").alias("__allow")), (F.col("site") == F.col("__s")) & (F.col("__text") == F.col("__t")), "left").drop("__s", "__t")
        by_index = F.col("__allow")
    known = policies.withColumn("rules", F.when(few, F.col("rules"))).withColumnRenamed("site", "__site")
    df = df.join(known, F.col("site") == F.col("__site"), "left")
    first = F.try_element_at(F.filter("rules", lambda r: F.startswith(F.col("__text"), r["path"])), F.lit(1))
    df = df.withColumn("__rule", F.coalesce(first["allow"], by_index))
    denied, listed = F.coalesce("denied", F.lit(False)), F.coalesce(F.array_contains("sitemaps", F.col(url)), F.lit(False))
    by_rule = F.coalesce("__rule", F.lit(True))
    common = path.rlike("(?:" + "|".join(p.replace(".", "\\.") for p in COMMON_SITEMAPS) + ")\\z")
    hidden = F.lit(True) if policy_403 == "allow" else path.isin(OPEN_PATHS)
    root = path.isin("", "/")
    why = (
        F.when(denied, F.lit("hidden robots file"))
        .when(listed, F.lit("listed sitemap"))
        .when(by_rule, F.when(F.col("__rule").isNull(), F.lit("no rule")).otherwise(F.lit("rule")))
        .when(common, F.lit("common sitemap"))
        .when(root, F.lit("root"))
        .otherwise(F.lit("rule"))
    )
    df = df.withColumn("allowed", F.when(denied, hidden).otherwise(listed | by_rule | common | root)).withColumn("why", why)
    return urls.drop_parts(df, "__u_").drop("__text", "__rule", "__allow", "__site", "denied", "rules", "crawl_delay", "sitemaps")


def robots_audit(decided: DataFrame) -> DataFrame:
    """Allowed and denied URLs per site and deciding reason."""
    return decided.groupBy("site", "why").agg(
        F.count_if(F.col("allowed")).alias("n_allowed"), F.count_if(~F.col("allowed")).alias("n_denied")
    )
