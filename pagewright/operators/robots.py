"""robots.txt: lines to rules, verdicts for pages, issues of hosts, and issues of whole sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import urls

RULES = ("disallow", "allow", "crawl-delay")
# Agents whose block counts as one of the main search crawler, in order.
MAIN_AGENTS = ("googlebot", "google", "googlebot-image", "googlebot-mobile")


def robots_lines(docs: DataFrame) -> DataFrame:
    """Directives (host, line, block, key, value) of robots.txt bodies (host, body). A block begins at
    a user-agent line behind a rule. The window is one file's lines."""
    lines = docs.select("host", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r\n|\r|\n")).alias("line", "text")).withColumn("text", F.trim("text"))
    pairs = lines.where("text NOT LIKE '#%' AND text LIKE '%:%'").select("host", "line", F.trim(F.lower(F.substring_index("text", ":", 1))).alias("key"), F.trim(F.regexp_replace("text", "^[^:]*:", "")).alias("value"))
    known = pairs.where(F.col("key").isin("user-agent", "sitemap", *RULES))
    w = Window.partitionBy("host").orderBy("line")
    # sitemap lines and an empty delay end no block
    is_rule = F.col("key").isin("disallow", "allow") | ((F.col("key") == "crawl-delay") & (F.col("value") != ""))
    mark = F.when(F.col("key") == "user-agent", "agent").when(is_rule, "rule")
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = (F.col("key") == "user-agent") & (F.coalesce(before, F.lit("rule")) == "rule")
    return known.withColumn("begins", begins.cast("int")).withColumn("block", F.sum("begins").over(w)).select("host", "line", "block", "key", "value")


def robots_agents(lines: DataFrame) -> DataFrame:
    """One row for each agent of each block: rules, and the block's last delay."""
    rules = lines.where("block > 0").groupBy("host", "block").agg(
        F.collect_list(F.when(F.col("key") == "user-agent", F.struct("line", F.col("value").alias("agent")))).alias("agents"),
        F.array_sort(F.collect_list(F.when(F.col("key").isin("allow", "disallow"), F.struct("line", (F.col("key") == "allow").alias("allow"), F.col("value").alias("path"))))).alias("rules"),
        F.max_by("value", F.when((F.col("key") == "crawl-delay"), F.col("line"))).alias("delay"),
    )
    return rules.select("host", "block", F.inline("agents"), "rules", F.nullif("delay", F.lit("")).alias("delay"))


def robots_rules(lines: DataFrame) -> DataFrame:
    """Rules (host, block, user_agent, rule_idx, allow, path) in file order. An empty disallow allows
    everything; an empty allow says nothing."""
    rows = robots_agents(lines).select("host", "block", F.col("agent").alias("user_agent"), F.posexplode("rules").alias("rule_idx", "r"))
    return rows.select("host", "block", "user_agent", "rule_idx", (F.col("r.allow") | (F.col("r.path") == "")).alias("allow"), F.col("r.path").alias("path"))


def robots_allowed(pages: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """Verdict of each page: the agent's own block if its host has one, else that of all agents;
    the first rule in file order whose path begins the page's path decides.

    A page is joined with the rules by its own prefixes, of those lengths that its host's rules have.
    So its cost follows the length of its path, not the number of rules, and no host's rules or pages
    come together in one task.
    """
    own = rules.where(F.lower("user_agent").isin(agent.lower(), "*") & (F.col("path") != "")).withColumn("own", F.lower("user_agent") == agent.lower())
    any_own = rules.where(F.lower("user_agent").isin(agent.lower(), "*")).groupBy("host").agg(F.max(F.lower("user_agent") == agent.lower()).alias("any_own"))
    used = own.join(any_own, "host").where("own = any_own").groupBy("host", "path").agg(F.min(F.struct("block", "rule_idx", "allow")).alias("rule"))
    lengths = used.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    rest = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    path = F.when(rest == "", "/").when(F.startswith(rest, F.lit("?")), F.concat(F.lit("/"), rest)).otherwise(rest)
    seen = pages.select("url").distinct().select("url", urls.netloc(F.col("url")).alias("host"), path.alias("page_path")).join(lengths, "host")
    prefixes = seen.select("url", "host", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("page_path")), lambda n: F.substring(F.col("page_path"), F.lit(1), n))).alias("path"))
    first = prefixes.join(used, ["host", "path"]).groupBy("url").agg(F.min("rule").alias("rule"))
    return pages.select("url").join(first, "url", "left").select("url", F.coalesce("rule.allow", F.lit(True)).alias("allowed"))


def robots_check(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Check of each page against its host's file (host, status, body): verdicts for all agents and
    Googlebot, the delay for all. No file (404) allows all; one that could not be fetched warns."""
    lines = robots_lines(docs.where("status = 200"))
    rules = robots_rules(lines)
    star, bot = robots_allowed(pages, rules), robots_allowed(pages, rules, "Googlebot").withColumnRenamed("allowed", "googlebot")
    delay = robots_agents(lines).where("agent = '*'").groupBy("host").agg(F.max_by("delay", "block").alias("crawl_delay"))
    state = docs.groupBy("host").agg(F.min("status").alias("robots_status"))
    j = star.join(bot, "url").withColumn("host", urls.netloc(F.col("url"))).join(state, "host", "left").join(delay, "host", "left")
    fetched = F.col("robots_status").isin(200, 404)
    status = F.when(~F.coalesce(fetched, F.lit(False)), "warning").when(F.col("allowed") & F.col("googlebot"), "pass").otherwise("fail")
    return j.select("url", "allowed", "googlebot", "crawl_delay", status.alias("status"))


def robots_issues(lines: DataFrame) -> DataFrame:
    """Issues (host, level, issue, detail) of robots.txt files that have any directive."""
    agents = robots_agents(lines).withColumn("name", F.lower("agent"))
    paths = lambda allow: F.transform(F.filter("rules", lambda r: r["allow"] == F.lit(allow)), lambda r: r["path"])
    agents = agents.withColumn("blocked", F.array_contains(paths(False), "/") & (F.size(paths(True)) == 0)).withColumn("open", (F.size(paths(False)) == 1) & (F.get(paths(False), 0) == ""))
    # of an agent's blocks the last one counts
    last = agents.groupBy("host", "name").agg(F.max_by(F.struct("blocked", "delay", "agent"), "block").alias("b"), F.count("*").alias("n")).select("host", "name", "b.*", "n")
    say = lambda df, level, issue, detail: df.select("host", F.lit(level).alias("level"), F.lit(issue).alias("issue"), detail.alias("detail"))
    nothing = F.lit("")
    star = last.where("name = '*'")
    number = F.col("delay").try_cast("double")
    rank = F.array_position(F.array(*map(F.lit, MAIN_AGENTS)), F.col("name"))
    main = last.where(F.col("blocked") & F.col("name").isin(*MAIN_AGENTS)).groupBy("host").agg(F.min_by("agent", rank).alias("agent"))
    maps = lines.where("key = 'sitemap'")
    out = say(star.where("blocked"), "error", "all crawlers blocked", nothing)
    out = out.unionByName(say(main, "error", "main crawler blocked", F.col("agent")))
    out = out.unionByName(say(lines.select("host").distinct().join(maps.select("host").distinct(), "host", "left_anti"), "warning", "no sitemap", nothing))
    out = out.unionByName(say(star.where(number > 10), "warning", "long crawl delay", F.col("delay")))
    out = out.unionByName(say(star.where(F.col("delay").isNotNull() & number.isNull()), "warning", "invalid crawl delay", F.col("delay")))
    out = out.unionByName(say(last.where("n > 1"), "warning", "repeated agent", F.col("name")))
    out = out.unionByName(say(agents.where("open"), "info", "empty disallow", F.col("agent")))
    return out.unionByName(say(maps.where(~F.col("value").rlike("^(?i:https?)://")), "error", "bad sitemap address", F.col("value")))


def issue_verdicts(issues: DataFrame) -> DataFrame:
    """Errors, warnings and verdict of each host."""
    s = issues.groupBy("host").agg(F.count_if(F.col("level") == "error").alias("n_errors"), F.count_if(F.col("level") == "warning").alias("n_warnings"))
    return s.withColumn("verdict", F.when(F.col("n_errors") > 0, "fail").when(F.col("n_warnings") > 0, "warning").otherwise("pass"))


def robots_audit(lines: DataFrame) -> DataFrame:
    """Errors, warnings and verdict of each host with a robots.txt; one without issues passes."""
    hosts = lines.select("host").distinct()
    v = hosts.join(issue_verdicts(robots_issues(lines)), "host", "left")
    return v.select("host", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_errors", "n_warnings")), F.coalesce("verdict", F.lit("pass")).alias("verdict"))


def crawl_issues(robots: DataFrame, sitemaps: DataFrame, failed: DataFrame) -> DataFrame:
    """Issues of whole sites: those of robots.txt and sitemaps, without mere notes, and an error for
    each source (host, source) that could not be read."""
    rows = robots.withColumn("source", F.lit("robots")).unionByName(sitemaps.withColumn("source", F.lit("sitemap"))).where("level <> 'info'")
    return rows.unionByName(failed.select("host", F.lit("error").alias("level"), F.lit("not readable").alias("issue"), F.lit("").alias("detail"), "source"))
