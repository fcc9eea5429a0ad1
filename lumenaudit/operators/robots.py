"""robots.txt as relations: parsed with windows, evaluated with joins. No rule runs in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The crawlers whose access is reported.
BOTS = ("Googlebot", "OAI-SearchBot", "ChatGPT-User", "GPTBot", "PerplexityBot", "ClaudeBot", "Claude-SearchBot", "Google-Extended")


def lines(files: DataFrame) -> DataFrame:
    """``(site_id, line, key, value)`` of the lines that say something. files: ``site_id, body``."""
    rows = files.select("site_id", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\r?\n")).alias("line", "raw"))
    bare = F.trim(F.regexp_replace("raw", "#.*$", ""))
    at = F.instr(bare, ":")
    return rows.where(at > 0).select("site_id", "line", F.lower(F.trim(F.substring_index(bare, ":", 1))).alias("key"), F.trim(F.substr(bare, at + 1)).alias("value"))


def rules(files: DataFrame) -> DataFrame:
    """``(site_id, grp, agents, line, type, path)``: a row per rule, and one without rule for groups that have none.

    Agents that follow each other share a group; sitemap lines don't part them; rules before any agent make a group for all."""
    found = lines(files).where("key <> 'sitemap'")
    order = Window.partitionBy("site_id").orderBy("line")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    grouped = found.withColumn("grp", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    agents = grouped.groupBy("site_id", "grp").agg(F.array_sort(F.collect_set(F.when(F.col("key") == "user-agent", F.lower("value")))).alias("agents"))
    agents = agents.withColumn("agents", F.when(F.size("agents") == 0, F.array(F.lit("*"))).otherwise(F.col("agents")))
    said = grouped.where(F.col("key").isin("allow", "disallow") & (F.col("value") != "")).select("site_id", "grp", "line", F.col("key").alias("type"), F.col("value").alias("path"))
    # rules ahead of all agents exist only where there are any
    return agents.join(said, ["site_id", "grp"], "left").where("grp > 0 OR path IS NOT NULL")


def sitemaps(files: DataFrame) -> DataFrame:
    return lines(files).where("key = 'sitemap' AND value <> ''").select("site_id", "line", F.col("value").alias("url"))


def normal_pattern(path: Column, origin: Column) -> Column:
    full = path.rlike("(?i)^https?://")
    inner = F.regexp_extract(path, r"^(?i:https?)://[^/?#]*([^?#]*)", 1)
    bare = F.when(full, F.when(inner == "", F.lit("/")).otherwise(inner)).when(path.rlike(r"^[/*]"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(~full & (origin != "") & F.startswith(bare, origin), F.substr(bare, F.length(origin) + 1)).otherwise(bare)


def pattern_regex(pattern: Column) -> Column:
    """An anchored regular expression: ``*`` for anything, ``$`` at the end for the end."""
    body = F.regexp_replace(pattern, r"\$$", "")
    safe = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(safe, r"\*", ".*"), F.when(pattern.endswith("$"), F.lit("$")).otherwise(F.lit("")))


def specificity(pattern: Column) -> Column:
    return F.length(F.regexp_replace(pattern, r"\$$", ""))


def access(files: DataFrame, requests: DataFrame) -> DataFrame:
    """``(site_id, bot, path, allowed)``. requests: ``site_id, bot, path, origin``.

    The longest agent token that a bot's name begins with chooses the groups, else those for all; the longest pattern wins, allowing before not."""
    asked = requests.select("site_id", "bot", "path", "origin").distinct()
    parsed = rules(files)
    tokens = parsed.select("site_id", "grp", F.explode("agents").alias("agent")).distinct()
    named = asked.select("site_id", "bot").distinct().join(tokens, "site_id").where((F.col("agent") == "*") | F.startswith(F.lower("bot"), F.col("agent")))
    length = F.when(F.col("agent") == "*", F.lit(-1)).otherwise(F.length("agent"))
    best = named.withColumn("n", length).withColumn("top", F.max("n").over(Window.partitionBy("site_id", "bot"))).where("n = top").select("site_id", "bot", "grp").distinct()
    # rules by the letters before their first wildcard; a path meets only those that begin as it does
    origins = asked.select("site_id", "origin").distinct()
    index = parsed.where("path IS NOT NULL").select("site_id", "grp", "type", F.col("path").alias("rule")).join(origins, "site_id")
    index = index.withColumn("pattern", normal_pattern(F.col("rule"), F.coalesce("origin", F.lit("")))).where("pattern <> ''").withColumn("prefix", F.regexp_extract("pattern", "^[^*$]*", 0)).drop("rule").distinct()
    by = ["site_id", "grp", "origin"]
    lengths = index.groupBy(*by).agg(F.collect_set(F.length("prefix")).alias("lengths")).alias("l")
    asking = asked.join(best, ["site_id", "bot"]).alias("a")
    same = lambda x, y, names: [F.col(f"{x}.{n}").eqNullSafe(F.col(f"{y}.{n}")) if n == "origin" else F.col(f"{x}.{n}") == F.col(f"{y}.{n}") for n in names]
    begun = asking.join(lengths, same("a", "l", by)).select("a.*", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")).withColumn("prefix", F.substring("path", F.lit(1), F.col("n"))).alias("b")
    applied = begun.join(index.alias("i"), same("b", "i", [*by, "prefix"])).select("b.*", "i.type", "i.pattern")
    plain = ~F.col("pattern").rlike("[*$]")
    hit = applied.where(plain | F.rlike("path", pattern_regex(F.col("pattern"))))
    won = hit.groupBy("site_id", "bot", "path").agg(F.max(F.struct(specificity(F.col("pattern")).alias("s"), (F.col("type") == "allow").alias("allow"))).alias("w"))
    return asked.join(won, ["site_id", "bot", "path"], "left").select("site_id", "bot", "path", F.coalesce("w.allow", F.lit(True)).alias("allowed"))


def bot_access(files: DataFrame) -> DataFrame:
    """``(site_id, bots)``: a map of each reported bot to whether it may read the root, and how that reads."""
    bots = files.sparkSession.createDataFrame([(b,) for b in BOTS], "bot string")
    asked = files.select("site_id", F.coalesce("origin", F.lit("")).alias("origin")).crossJoin(F.broadcast(bots)).withColumn("path", F.lit("/"))  # eight rows a site
    got = access(files, asked)
    said = F.concat("bot", F.lit(": "), F.when(F.col("allowed"), "allowed").otherwise("blocked"), F.lit(" at /"))
    entry = F.struct("bot", F.struct("allowed", said.alias("evidence")))
    return got.groupBy("site_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("bots"))
