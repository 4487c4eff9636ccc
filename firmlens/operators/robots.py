"""robots.txt files as rule tables, and access decisions as a join on the origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions.text import py_strip
from firmlens.functions.urls import fetch_origin, robots_path

# Every line break Python's str.splitlines knows.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"


def robots_groups(files: DataFrame) -> DataFrame:
    """One row per origin and group: agents, rules in order, crawl delay.

    ``files`` has origin and content. The windows run within one robots file, whose size is limited by
    the protocol, and never over the pages of an origin.
    """
    key = "origin"
    lines = files.select(key, F.posexplode(F.split("content", LINE_BREAK)).alias("n", "raw"))
    line = py_strip(F.substring_index("raw", "#", 1))
    split = lines.withColumn("line", line).filter(F.contains("line", F.lit(":")))
    parsed = split.select(
        key, "n",
        F.lower(py_strip(F.substring_index("line", ":", 1))).alias("field"),
        py_strip(F.substring("line", F.instr("line", ":") + 1, F.length("line"))).alias("value"),
    ).filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    in_file = Window.partitionBy(key).orderBy("n")
    is_agent = F.col("field") == "user-agent"
    opens = is_agent & (F.coalesce(F.lag("field").over(in_file), F.lit("none")) != "user-agent")
    grouped = parsed.withColumn("_opens", opens.cast("int")).withColumn(
        "group_no", F.sum("_opens").over(in_file)
    )
    allow_rule = F.col("field").isin("allow", "disallow") & (F.col("value") != "")
    delay = F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("double"))
    rule = F.struct(
        "n", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern")
    )
    return (
        grouped.filter(F.col("group_no") > 0)
        .groupBy(key, "group_no")
        .agg(
            F.collect_list(F.when(F.col("field") == "user-agent", F.lower("value"))).alias("agents"),
            F.array_sort(F.collect_list(F.when(allow_rule, rule))).alias("rules"),
            F.max_by(delay, F.when(delay > 0, F.col("n"))).alias("crawl_delay"),
        )
    )


def rule_regex(pattern: Column) -> Column:
    """Anchored regular expression of a robots path pattern with ``*`` and a final ``$``."""
    escaped = F.regexp_replace(pattern, r"([^A-Za-z0-9_/*\u0080-\uffff])", r"\\$1")
    starred = F.replace(escaped, F.lit("*"), F.lit(".*"))
    ended = F.regexp_replace(starred, r"\\\$$", r"\$")
    return F.concat(F.lit("^"), ended)


def rule_specificity(pattern: Column) -> Column:
    plain = F.replace(pattern, F.lit("*"), F.lit(""))
    return F.length(plain) - F.when(plain.endswith("$"), 1).otherwise(0)


def robots_policies(files: DataFrame, user_agent: str) -> DataFrame:
    """One row per origin: the rules and crawl delay that apply to the agent."""
    product = user_agent.lower().split("/", 1)[0]
    groups = robots_groups(files)
    named = F.filter(
        "agents", lambda agent: (agent != "*") & F.contains(F.lit(product), agent)
    )
    length = F.array_max(F.transform(named, F.length))
    sized = groups.withColumns(
        {"_length": length, "_any": F.array_contains("agents", "*")}
    )
    best = sized.groupBy("origin").agg(F.max("_length").alias("_best"))
    chosen = sized.join(best, "origin").filter(
        F.when(F.col("_best").isNotNull(), F.col("_length") == F.col("_best")).otherwise(
            F.col("_any")
        )
    )
    prepared = F.transform(
        "rules",
        lambda rule: F.struct(
            rule_specificity(rule["pattern"]).alias("specificity"),
            rule["allow"].alias("allow"),
            rule["pattern"].alias("pattern"),
        ),
    )
    per_origin = chosen.groupBy("origin").agg(
        F.flatten(F.collect_list(prepared)).alias("rules"),
        F.min_by("crawl_delay", F.when(F.col("crawl_delay").isNotNull(), F.col("group_no"))).alias(
            "crawl_delay"
        ),
    )
    return files.select("origin").join(per_origin, "origin", "left")


def literal_rules(policies: DataFrame) -> DataFrame:
    """Rules without a wildcard: origin, ``mark`` (what a path must carry), specificity and whether it is allowed.

    A mark is ``^`` and the beginning of a path, or ``=`` and a whole path for a rule that ends in ``$``. Of equal marks Allow wins.
    """
    rule = policies.select("origin", F.explode("rules").alias("rule")).select("origin", "rule.*")
    plain = rule.filter(~F.contains("pattern", F.lit("*")))
    whole = plain["pattern"].endswith("$")
    mark = F.when(whole, F.concat(F.lit("="), F.expr("left(pattern, length(pattern) - 1)"))).otherwise(
        F.concat(F.lit("^"), "pattern")
    )
    return plain.groupBy("origin", mark.alias("mark")).agg(
        F.max("specificity").alias("specificity"), F.max("allow").alias("allow")
    )


def _wild_rules(policies: DataFrame) -> DataFrame:
    """Rules with a wildcard per origin: the literal beginning, the regular expression, specificity, allow."""
    wild = F.filter("rules", lambda rule: F.contains(rule["pattern"], F.lit("*")))
    return policies.select(
        "origin", "crawl_delay",
        F.transform(
            wild,
            lambda rule: F.struct(
                F.substring_index(rule["pattern"], "*", 1).alias("head"),
                rule_regex(rule["pattern"]).alias("regex"),
                rule["specificity"].alias("specificity"),
                rule["allow"].alias("allow"),
            ),
        ).alias("wild"),
    )


def robots_decisions(urls: DataFrame, policies: DataFrame) -> DataFrame:
    """Add robots_allowed and crawl_delay to urls.

    The longest matching pattern decides and Allow wins ties; no match allows; an origin without a
    known policy is denied. Literal rules are an index: each distinct path of an origin carries its beginnings of the lengths
    that the origin's rules have, and these are equi-joined with the rules, so a path costs its length however many rules there are.
    Only rules with a ``*`` are matched as patterns, after their literal beginning.
    """
    keyed = urls.withColumns(
        {"_origin": fetch_origin(F.col("url")), "_path": robots_path(F.col("url"))}
    )
    literal = literal_rules(policies)
    # Lengths are at most as many as the longest path has characters, whatever the number of rules.
    lengths = (
        literal.filter(F.col("mark").startswith("^")).groupBy("origin")
        .agg(F.collect_set(F.length("mark") - 1).alias("lengths"))
    )
    paths = keyed.select("_origin", "_path").distinct()
    reach = F.filter(F.coalesce("lengths", F.array().cast("array<int>")), lambda size: size <= F.length("_path"))
    marks = F.array_append(
        F.transform(reach, lambda size: F.concat(F.lit("^"), F.substring("_path", F.lit(1), size))),
        F.concat(F.lit("="), "_path"),
    )
    carried = paths.join(lengths.withColumnRenamed("origin", "_origin"), "_origin", "left").select(
        "_origin", "_path", F.explode(marks).alias("mark")
    )
    winners = (
        carried.join(literal.withColumnRenamed("origin", "_origin"), ["_origin", "mark"])
        .groupBy("_origin", "_path").agg(F.max(F.struct("specificity", "allow")).alias("_literal"))
    )
    known = _wild_rules(policies).select(
        F.col("origin").alias("_origin"), "wild", "crawl_delay", F.lit(True).alias("_known")
    )
    hits = F.filter(
        "wild", lambda rule: F.col("_path").startswith(rule["head"]) & F.rlike(F.col("_path"), rule["regex"])
    )
    pattern = F.array_max(F.transform(hits, lambda rule: F.struct(rule["specificity"], rule["allow"])))
    joined = (
        keyed.join(known, "_origin", "left").join(winners, ["_origin", "_path"], "left")
        .withColumn("_winner", F.greatest("_literal", pattern))
    )
    allowed = F.col("_known").isNotNull() & F.coalesce(F.col("_winner.allow"), F.lit(True))
    return joined.select(*urls.columns, allowed.alias("robots_allowed"), "crawl_delay")
