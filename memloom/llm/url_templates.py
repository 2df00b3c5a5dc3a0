"""URL filters by path-template trees, in DataFrame operations only.

Each host has a tree over the segments of its paths. Level by level, from the root:

* generalise: a segment that looks like a value (all digits, a long hexadecimal run, a UUID, a
  digit-laden slug, each with its ending) or that holds under MIN_SHARE of its parent's rows
  becomes a wildcard;
* merge: a parent's literal branches, in the order of their labelled rate, are one branch as long
  as each next rate is within Z standard errors of the one before (a two-proportion test), so
  statistically alike branches share one template;
* the levels beyond DEPTH are one wildcard tail, so every path has a template.

A template's purity is (good + PRIOR_N * host prior) / (labelled + PRIOR_N), the host's prior being
smoothed to the whole in the same way. Templates with labelled rows and under the accepted purity
are rejected (block).

Defined cases: null urls, and urls without ://, have an empty host and path and go by the tree of
the empty host; a host without labels goes by the overall rate; repeated urls count each; ties of
rate go by the segment; urls are read whole, however long; further columns are kept, but for those
named as a result; an empty table stays empty; without any label nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import stored

DEPTH, MIN_SHARE, Z, PRIOR_N, ACCEPT = 6, 0.02, 1.96, 8.0, 0.5
VALUE = r"^(\d+|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[^.]*\d[^.]*\d[^.]*\d[^.]*)(\.[A-Za-z0-9]{1,5})?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first :// up to / ? # or the end, A-Z lower-cased, and the path from there up to ? # or the end; both empty without ://."""
    rest = F.coalesce(F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of rules (host/path prefix, verdict) that fits; null if none does. The rules become one
    expression; a long list is better given as a table, to `with_rules`."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def with_rules(rows: DataFrame, rules: DataFrame, host: str, path: str) -> DataFrame:
    """rows with __rule and __ruled, by a table of rules (rule, verdict) of any length: each distinct host and path meets the
    rules of its own domains by an equi-join, and the longest that the path starts with stays (ties by the rule)."""
    known = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("domain"), F.expr("substr(rule, instr(rule, '/'))").alias("prefix"))
    places = rows.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    labels = F.split("h", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = places.select("h", "p", F.explode(domains).alias("domain")).join(known, "domain").where("startswith(p, prefix)")
    best = met.groupBy("h", "p").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("r")).select("h", "p", F.col("r.rule").alias("__rule"), F.col("r.verdict").alias("__ruled"))
    return rows.join(best, (F.col(host) == F.col("h")) & (F.col(path) == F.col("p")), "left").drop("h", "p")


def _split(paths: DataFrame, k: int) -> DataFrame:
    """paths with the segment at level k (from DEPTH on one tail; null beyond the last) and whether it is a value; values
    are their wildcard at once, so a host with countless of them has one row for all."""
    raw = F.get("segments", F.lit(k)) if k < DEPTH else F.when(F.size("segments") > DEPTH, F.lit("**"))
    value = F.coalesce(raw.rlike(VALUE), F.lit(False))
    wildcard = F.concat(F.lit("*"), F.regexp_extract(raw, r"(\.[A-Za-z0-9]{1,5})?$", 0))
    return paths.withColumns({"segment": F.when(value, wildcard).otherwise(raw), "value": value})


def _level(paths: DataFrame) -> DataFrame:
    """(host, node, segment, value, branch): the branch that each segment of a node belongs to.

    paths: (host, node, segment, value, n, good, bad), one row for each distinct path so far.
    """
    here = paths.where("segment is not null")
    counts = here.groupBy("host", "node", "segment", "value").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")))
    parents = counts.groupBy("host", "node").agg(F.sum("n").alias("all_n"))
    counts = counts.join(parents, ["host", "node"])
    rare = (F.col("n") < MIN_SHARE * F.col("all_n")) & (F.col("segment") != "**")
    counts = counts.withColumn("literal", ~F.col("value") & ~rare)
    # at most 1 / MIN_SHARE literal branches for each parent
    literal = counts.where("literal").withColumn("labelled", F.col("good") + F.col("bad"))
    literal = literal.withColumn("rate", F.col("good") / F.when(F.col("labelled") > 0, F.col("labelled")))
    order = Window.partitionBy("host", "node", F.col("rate").isNull()).orderBy("rate", "segment")
    before_n, before_good = F.lag("labelled").over(order), F.lag("good").over(order)
    pooled = (F.col("good") + before_good) / (F.col("labelled") + before_n)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / before_n))
    apart = F.coalesce((F.col("rate") - before_good / before_n) > Z * error, F.lit(False))
    literal = literal.withColumn("group", F.sum(apart.cast("int")).over(order))
    named = F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_set("segment").over(Window.partitionBy("host", "node", F.col("rate").isNull(), "group"))), "|"), F.lit("}"))
    literal = literal.select("host", "node", "segment", "value", F.when(F.contains(named, F.lit("|")), named).otherwise(F.col("segment")).alias("branch"))
    rest = counts.where("not literal").select("host", "node", "segment", "value", F.when(F.col("value"), F.col("segment")).otherwise("*").alias("branch"))
    return literal.union(rest)


def learn_templates(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From urls (host, path, label; label 1 good, 0 bad or null): (host, path, template) for each distinct path, and
    (host, template, n, good, bad, purity) for each template."""
    good, bad = F.sum((F.col("label") == 1).cast("long")), F.sum((F.col("label") == 0).cast("long"))
    paths = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.coalesce(good, F.lit(0)).alias("good"), F.coalesce(bad, F.lit(0)).alias("bad"))
    paths = stored(paths.withColumn("segments", F.expr("filter(split(path, '/'), x -> x <> '')")).withColumn("node", F.lit("/")), "paths")
    deepest = paths.agg(F.max(F.size("segments"))).first()[0] or 0
    for k in range(min(DEPTH + 1, deepest)):
        cut = _split(paths, k)
        joined = cut.withColumnRenamed("node", "up").join(_level(cut).withColumnRenamed("node", "up"), ["host", "up", "segment", "value"], "left")
        paths = joined.withColumn("node", F.when(F.col("branch").isNull(), F.col("up")).otherwise(F.concat("up", F.when(F.col("up") == "/", "").otherwise("/"), "branch"))).drop("up", "segment", "value", "branch")
        paths = stored(paths, "paths") if k % 2 else paths
    paths = stored(paths.withColumnRenamed("node", "template"), "paths")
    sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    templates = paths.groupBy("host", "template").agg(*sums)
    hosts = templates.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("bad").alias("host_bad"))
    whole = hosts.agg(F.sum("host_good").alias("g"), F.sum("host_bad").alias("b")).select((F.coalesce("g", F.lit(0)) + PRIOR_N).alias("g"), (F.coalesce("b", F.lit(0))).alias("b"))
    overall = F.col("g") / (F.col("g") + F.col("b"))
    hosts = hosts.join(F.broadcast(whole)).select("host", ((F.col("host_good") + PRIOR_N * overall) / (F.col("host_good") + F.col("host_bad") + PRIOR_N)).alias("prior"))
    purity = (F.col("good") + PRIOR_N * F.col("prior")) / (F.col("good") + F.col("bad") + PRIOR_N)
    return paths.select("host", "path", "template"), templates.join(hosts, "host").select("host", "template", "n", "good", "bad", purity.alias("purity"))


def judge(urls: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, url_col: str = "url", label_col: str | None = None, accept: float = ACCEPT) -> DataFrame:
    """urls with host, path, rule, template, purity and verdict: the longest rule's, else block for templates under the accepted purity.

    Labels are label_col (1 good, 0 bad), and where there are none the verdicts of the rules, which may be a table (rule, verdict).
    """
    names = urls.columns
    plain = urls.toDF(*(f"u{i}" for i in range(len(names))))  # so that no name of urls meets one of these
    own = {c: F.col(f"u{i}") for i, c in enumerate(names)}
    host, path = host_and_path(own[url_col])
    rows = plain.withColumn("__host", host).withColumn("__path", path)
    if isinstance(rules, DataFrame):
        rows = with_rules(rows, rules, "__host", "__path")
    else:
        rule, ruled = matched_rule(F.col("__host"), F.col("__path"), rules)
        rows = rows.withColumn("__rule", rule).withColumn("__ruled", ruled)
    by_rule = F.when(F.col("__ruled") == "allow", 1).when(F.col("__ruled") == "block", 0)
    label = F.coalesce(own[label_col], by_rule) if label_col else by_rule
    paths, templates = learn_templates(rows.select(F.col("__host").alias("host"), F.col("__path").alias("path"), label.alias("label")))
    known = paths.join(templates, ["host", "template"]).select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("template").alias("__template"), F.when(F.col("good") + F.col("bad") > 0, F.col("purity")).alias("__judged"), F.col("purity").alias("__purity"))
    out = rows.join(known, (F.col("__host") == F.col("__h")) & (F.col("__path") == F.col("__p")), "left")
    verdict = F.coalesce("__ruled", F.when(F.col("__judged") < accept, "block").otherwise("allow"))
    kept = [own[c].alias(c) for c in names if c not in ("host", "path", "rule", "template", "purity", "verdict")]
    return out.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__template").alias("template"), F.col("__purity").alias("purity"), verdict.alias("verdict"))
