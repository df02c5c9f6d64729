"""Redirect chains by pointer doubling over the crawl log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.sources.durable import durable, union_all


def _last_fetch(fetches: DataFrame) -> DataFrame:
    """One row for each url: its last attempt, if the log counts attempts."""
    if "attempt" in fetches.columns:
        place = F.col("attempt")
    else:
        place = F.struct(F.col("location").isNotNull(), "status", "location")
    return fetches.where("url IS NOT NULL").groupBy("url").agg(F.max_by(F.struct(F.col("status").cast("string").alias("status"), "location"), place).alias("r")).select("url", "r.*")


def _joined(path: Column, codes: Column, final: Column, on: str) -> Column:
    """A chain and the one that begins where it ends, as one. If the second comes to a url of the
    first, the chain is a loop and ends at that url."""
    more, more_codes = F.col(f"{on}.path"), F.col(f"{on}.codes")
    met = F.get(F.filter(more, lambda u: F.array_contains(path, u)), 0)
    at = F.array_position(more, met) - 1
    whole = F.struct(F.concat(path, more).alias("path"), F.concat(codes, more_codes).alias("codes"), F.col(f"{on}.final").alias("final"), F.col(f"{on}.is_loop").alias("is_loop"), F.col(f"{on}.done").alias("done"))
    cut = F.struct(F.concat(path, F.slice(more, F.lit(1), at.cast("int"))).alias("path"), F.concat(codes, F.slice(more_codes, F.lit(1), at.cast("int"))).alias("codes"), met.alias("final"), F.lit(True).alias("is_loop"), F.lit(True).alias("done"))
    own = F.struct(path.alias("path"), codes.alias("codes"), final.alias("final"), F.lit(False).alias("is_loop"), F.lit(True).alias("done"))
    return F.when(F.col(f"{on}.path").isNull(), own).when(F.arrays_overlap(path, more), cut).otherwise(whole)


def follow(fetches: DataFrame) -> DataFrame:
    """url, path (urls of the chain before its end), codes, final_url and is_loop of each url that
    redirects.

    Every chain is joined with the chain of the url where it ends, so its length doubles each round:
    a chain or loop of n hops takes log2(n) + 2 rounds. A round is one equi-join, written out. Rows
    of ended chains are joined no more, and no path is longer than the one reported.
    """
    hops = _last_fetch(fetches).where("location IS NOT NULL")
    own = F.col("url") == F.col("location")
    active = durable(hops.select("url", F.array("url").alias("path"), F.array("status").alias("codes"), F.col("location").alias("final"), own.alias("is_loop"), own.alias("done")))
    done = [active.where("done")]
    active = active.where("NOT done")
    while not active.isEmpty():
        ends = union_all([*done, active]).select(F.col("url").alias("final"), F.struct("path", "codes", F.col("final").alias("final"), "is_loop", "done").alias("next"))
        now = durable(active.join(ends, "final", "left").select("url", _joined(F.col("path"), F.col("codes"), F.col("final"), "next").alias("r")).select("url", "r.*"))
        done.append(now.where("done"))
        active = now.where("NOT done")
    return union_all(done).select("url", "path", "codes", F.col("final").alias("final_url"), "is_loop")


def _to_https(a: Column, b: Column) -> Column:
    return F.startswith(a, F.lit("http://")) & F.startswith(b, F.lit("https://"))


def redirect_chains(fetches: DataFrame) -> DataFrame:
    """Each url that redirects: hops, final url, codes, loop, step to https, issues, verdict."""
    out = follow(fetches).withColumn("hops", F.size("codes"))
    to_https = _to_https(F.col("url"), F.col("final_url"))
    issues = F.concat_ws("; ", F.when(F.col("hops") >= 3, "long chain"), F.when(F.array_contains("codes", "302"), "temporary redirect"), F.when(~to_https & F.array_contains("codes", "301") & (F.col("hops") >= 2), "several permanent redirects"))
    verdict = F.when(F.col("is_loop") | (F.col("hops") >= 2), "fail").otherwise("warning")
    return out.select("url", "final_url", "hops", F.array_join("codes", ">").alias("codes"), "is_loop", to_https.alias("to_https"), issues.alias("issues"), verdict.alias("verdict"))


def redirect_report(fetches: DataFrame) -> DataFrame:
    """The redirect check of every fetched url, those without a redirect too: chain, hops, codes, final
    url, loop, steps from http to https, and pass (no hop), warning (one) or fail. A url whose last
    fetch has no location has no hop; one that was never fetched appears only inside chains."""
    rows = follow(fetches)
    chain = F.array_append("path", F.col("final_url"))
    steps = F.zip_with(F.slice(chain, F.lit(1), F.size("path")), F.slice(chain, F.lit(2), F.size("path")), _to_https)
    moved = rows.select("url", "final_url", F.size("codes").alias("hops"), F.array_join(chain, " > ").alias("chain"), F.array_join("codes", ">").alias("codes"), "is_loop", F.exists(steps, lambda x: x).alias("mixed_scheme"))
    still = fetches.where("url IS NOT NULL").select("url").distinct().join(rows.select("url"), "url", "left_anti")
    still = still.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"), F.col("url").alias("chain"), F.lit("").alias("codes"), F.lit(False).alias("is_loop"), F.lit(False).alias("mixed_scheme"))
    verdict = F.when(F.col("is_loop") | (F.col("hops") >= 2), "fail").when(F.col("hops") == 1, "warning").otherwise("pass")
    return moved.unionByName(still).withColumn("verdict", verdict)
