"""URL filters: explicit rules, then a path-template tree per host.

The tree generalises variable path segments into wildcards and, at every level,
merges branches that are statistically alike: G-tests find neither their labels
nor what follows them different from the other branches of their parent.  The
purity of a node is smoothed with that of its parent, from the root of the host
down, so a template without labels has the purity of what stands above it; a
template is rejected by its purity.  Labels are whatever the caller gives; the
query takes the verdicts of the rules, the only labels its table has.

Different urls are counted, so repeated rows change nothing.  All steps work on
counts that are summed per (host, shape) before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

#: A node is variable if it has so many different children and so few urls to each.
MANY_CHILDREN = 16
URLS_PER_CHILD = 2
#: Labels differ beyond this G (5 % of chance, one degree of freedom); what follows, beyond df + SPREAD * sqrt(2 * df).
LABELS_DIFFER = 3.841
SPREAD = 2.0
#: What a parent's purity counts in urls, that of a host without labels, and the least purity of a rejected template.
STRENGTH, UNKNOWN, REJECT = 2.0, 0.5, 0.8
#: Steps of templates: any segment, and branches that are alike.
ANY, ALIKE = "*", "+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; '' without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule of (host, path, verdict) as text, and its verdict; null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda r: ((host == r[0]) | F.endswith(host, F.lit("." + r[0]))) & F.startswith(path, F.lit(r[1]))
    pick = lambda value: F.coalesce(*[F.when(fits(r), F.lit(value(r))) for r in ordered], F.lit(None).cast("string"))
    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def shape_of(path: Column) -> Column:
    """The path with long hexadecimal runs and numbers replaced."""
    return F.regexp_replace(F.regexp_replace(path, r"[0-9a-fA-F]{16,}", "{h}"), r"[0-9]+", "{n}")


def _levels(shapes: DataFrame, steps: Column) -> DataFrame:
    """A row for each step of each shape: pos, step, prefix (the steps before it) and what follows it ('/' at the end)."""
    placed = shapes.withColumn("steps", steps).select("*", F.posexplode("steps").alias("pos", "step"))
    follows = F.coalesce(F.get("steps", F.col("pos") + 1), F.lit("/"))
    return placed.withColumn("prefix", F.array_join(F.slice("steps", F.lit(1), F.col("pos")), "/")).withColumn("follows", follows).drop("steps")


def _replaced(levels: DataFrame, marked: DataFrame, on: list[str], mark: str) -> DataFrame:
    """host, shape, n, b, m and steps, with the steps that marked names by `on` replaced by mark."""
    marked = small(cut(marked.select(*[F.col(c).alias(f"m_{c}") for c in on], F.lit(True).alias("marked"))))
    same = [F.col(c) == F.col(f"m_{c}") for c in on]
    step = F.struct("pos", F.when(F.col("marked"), F.lit(mark)).otherwise(F.col("step")).alias("step"))
    rows = levels.join(marked, same, "left").groupBy("host", "shape", "n", "b", "m").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return rows.withColumn("steps", F.transform("steps", lambda x: x["step"]))


def _g(observed: Column, expected: Column) -> Column:
    return F.when(observed > 0, 2 * observed * F.ln(observed / expected)).otherwise(0.0)


def alike_branches(levels: DataFrame) -> DataFrame:
    """host, prefix, pos, step of the branches that neither their labels nor what follows tell from their siblings."""
    at = ["host", "prefix", "pos"]
    cells = levels.groupBy(*at, "step", "follows").agg(F.sum("n").alias("o"), F.sum("b").alias("b"), F.sum("m").alias("m"))
    branches = cells.groupBy(*at, "step").agg(F.sum("o").alias("of_step"), F.sum("b").alias("b1"), F.sum("m").alias("m1"))
    nodes = branches.groupBy(*at).agg(F.sum("of_step").alias("all"), F.sum("b1").alias("b2"), F.sum("m1").alias("m2"), F.count("*").alias("children")).where("children > 1")
    nodes = cut(nodes)
    following = cells.join(small(nodes.select(*at)), at).groupBy(*at, "follows").agg(F.sum("o").alias("of_next"))
    df = following.groupBy(*at).agg((F.count("*") - 1).alias("df"))
    nodes = small(cut(nodes.join(df, at)))
    tested = cells.select(*at, "step", "follows", "o").join(following, [*at, "follows"]).join(nodes.select(*at, "all"), at)
    tested = tested.join(branches.select(*at, "step", "of_step"), [*at, "step"])
    rest = F.col("all") - F.col("of_step")
    g = _g(F.col("o"), F.col("of_step") * F.col("of_next") / F.col("all")) + _g(F.col("of_next") - F.col("o"), rest * F.col("of_next") / F.col("all"))
    found = tested.groupBy(*at, "step").agg(F.sum(g).alias("g"), F.sum("of_next").alias("met")).join(nodes, at).join(branches, [*at, "step"])
    # next steps that this branch lacks
    g_next = F.col("g") + 2 * (F.col("all") - F.col("met")) * F.ln(F.col("all") / rest)
    c = {(x, y): F.col(f"{x}1") if y else F.col(f"{x}2") - F.col(f"{x}1") for x in "bm" for y in (0, 1)}
    g_labels = sum((_g(seen, c["m", y] * share / F.col("m2")) for y in (0, 1) for seen, share in ((c["b", y], F.col("b2")), (c["m", y] - c["b", y], F.col("m2") - F.col("b2")))), F.lit(0.0))
    g_labels = F.when((c["m", 0] > 0) & (c["m", 1] > 0), g_labels).otherwise(0.0)
    return found.where((g_next <= F.col("df") + SPREAD * F.sqrt(2 * F.col("df")) + 1e-9) & (g_labels <= LABELS_DIFFER)).select(*at, "step")


def template_verdicts(urls: DataFrame) -> DataFrame:
    """urls(host, path, label) -> host, shape, template, purity, verdict.

    label is 'block', 'allow' or null; a url with both counts as block.  One
    output row per (host, shape).
    """
    different = urls.groupBy("host", "path").agg(F.max(F.when(F.col("label") == "block", 1).otherwise(0)).alias("b"), F.max(F.when(F.col("label").isNotNull(), 1).otherwise(0)).alias("m"))
    shapes = different.groupBy("host", shape_of(F.col("path")).alias("shape")).agg(F.count("*").alias("n"), F.sum("b").alias("b"), F.sum("m").alias("m"))
    levels = _levels(cut(shapes), F.split("shape", "/"))
    variable = levels.groupBy("host", "prefix", "pos", "step").agg(F.sum("n").alias("n")).groupBy("host", "prefix", "pos").agg(F.count("*").alias("children"), F.sum("n").alias("urls"))
    variable = variable.where((F.col("children") >= MANY_CHILDREN) & (F.col("urls") < URLS_PER_CHILD * F.col("children")))
    levels = _levels(cut(_replaced(levels, variable, ["host", "prefix", "pos"], ANY)), F.col("steps"))
    merged = cut(_replaced(levels, alike_branches(levels), ["host", "prefix", "pos", "step"], ALIKE))
    # every node from the root (no steps) to the template itself
    nodes = merged.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("steps")))).withColumn("node", F.array_join(F.slice("steps", F.lit(1), F.col("depth")), "/"))
    counts = nodes.groupBy("host", "depth", "node").agg(F.sum("b").alias("nb"), F.sum("m").alias("nm"))
    counts = small(cut(counts.select(F.col("host").alias("h"), F.col("depth").alias("d"), F.col("node").alias("at"), "nb", "nm")))
    line = nodes.join(counts, (F.col("host") == F.col("h")) & (F.col("depth") == F.col("d")) & (F.col("node") == F.col("at")))
    line = line.groupBy("host", "shape", "steps").agg(F.sort_array(F.collect_list(F.struct("depth", "nb", "nm"))).alias("line"))
    purity = F.aggregate("line", F.lit(UNKNOWN), lambda above, x: (x["nb"] + STRENGTH * above) / (x["nm"] + STRENGTH))
    judged = line.select("host", "shape", F.array_join("steps", "/").alias("template"), purity.alias("purity"))
    return judged.withColumn("verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", label: Column | None = None) -> DataFrame:
    """id_col, host, path, rule, verdict, template, purity: one row per row of pages.

    rules: (host, path, verdict).  label: 'block', 'allow' or null for each row;
    without one the rules' own verdicts are the labels.  A url that is null or
    has no :// has an empty host and path.  Urls without a rule take the
    verdict of their template; on a host without labels that is allow.  Repeated
    rows are judged alike and count once; ties of rules are decided by their
    order as text; very long urls are taken whole; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"), (F.lit(None).cast("string") if label is None else label).alias("given"))
    rows = rows.select("id", "given", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", ruled).withColumn("shape", shape_of(F.col("path")))
    learnt = template_verdicts(rows.select("host", "path", (F.col("ruled") if label is None else F.col("given")).alias("label")))
    joined = rows.join(learnt, ["host", "shape"], "left")
    return joined.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "verdict").alias("verdict"), "template", "purity")
