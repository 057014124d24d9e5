"""URL filter: fixed rules, and a tree of path templates per host that learns from the urls the rules decide."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.llm.line_dedup import ascii_lower
from prefspark.session import settle

#: (verdict, host and path prefix).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Levels of the tree. What is left of a longer path is one segment of the last level.
LEVELS = 4
#: A segment met less often among its siblings is variable.
SUPPORT = 5
#: Two branches differ when some share differs by more than SPREAD * (1 / sqrt(n) + 1 / sqrt(m)): Hoeffding at 5 %.
SPREAD = math.sqrt(0.5 * math.log(2 / 0.05))
#: A template is judged as if it also held SMOOTHING labelled urls at the overall share of blocked ones, and one more
#: for every ten of its urls that no rule decides.
SMOOTHING = 4.0
UNLABELLED = 0.1
PURITY = 0.8
LONG = 40
#: Leaves with a share of 1 / HEAVY of all urls are at most HEAVY many; these are broadcast.
HEAVY = 10_000
SALTS = 16
#: What may follow a segment: nothing, or a typed segment, by the first hexadecimal digit of its MD5.
CLASSES = ("stop", *(f"next_{digit}" for digit in "0123456789abcdef"))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Longest rule that fits a host, or a domain above it, and the start of the path; and that rule's verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"), r[1])):
        domain, _, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def typed(segment: Column) -> Column:
    """A segment with its variable parts named: numbers ``{n}``, long hexadecimal, much mixed and long ones whole."""
    return (
        F.when(F.char_length(segment) > LONG, F.lit("{long}"))
        .when(segment.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("{hex}"))
        .when(F.regexp_count(segment, F.lit("[0-9]+")) > 2, F.lit("{mixed}"))
        .otherwise(F.regexp_replace(segment, "[0-9]+", "{n}"))
    )


def template_of(path: Column, levels: int = LEVELS) -> Column:
    """Typed segments of a path joined by ``/``; slashes at its start and end do not count."""
    segments = F.split(F.regexp_replace(path, "^/|/$", ""), "/", levels)
    return F.array_join(F.transform(segments, typed), "/")


def _class_of(segment: Column) -> Column:
    digit = F.substring(F.md5(segment.cast("binary")), 1, 1)
    return F.when(segment.isNull(), F.lit("stop")).otherwise(F.concat(F.lit("next_"), digit))


def _salted(rows: DataFrame, few: DataFrame, on: list[str], key: str, how: str) -> DataFrame:
    """Join on ``on`` with rows of one key dealt to SALTS parts by ``key``, and ``few`` repeated for each part."""
    parts = F.explode(F.array(*map(F.lit, range(SALTS))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return dealt.join(few.withColumn("_salt", parts), [*on, "_salt"], how).drop("_salt")


def _differs() -> Column:
    """Whether a branch (``n``, ``block``, ...) differs from the rest of its node (``all_*`` less its own)."""

    def far(own: Column, n: Column, other: Column, m: Column) -> Column:
        return F.abs(own / n - other / m) > F.lit(SPREAD) * (1 / F.sqrt(n) + 1 / F.sqrt(m))

    rest = {name: F.col(f"all_{name}") - F.col(name) for name in ("n", "block", "allow", *CLASSES)}
    labelled, others = F.col("block") + F.col("allow"), rest["block"] + rest["allow"]
    shapes = [far(F.col(c), F.col("n"), rest[c], rest["n"]) for c in CLASSES]
    judged = (labelled > 0) & (others > 0) & far(F.col("block"), labelled, rest["block"], others)
    return F.exists(F.array(*shapes, judged), lambda differs: differs)


def _grown(leaves: DataFrame, level: int, levels: int) -> DataFrame:
    """Leaves with ``made`` one level longer: the segment itself, or ``*`` where it is variable or its branch merges.

    Only branches that keep their segment are joined back, each of at least SUPPORT urls.
    """
    segments = F.split("template", "/", levels)
    here = leaves.withColumn("segment", F.get(segments, F.lit(level)))
    if not level:
        here = here.withColumn("segment", F.when(F.col("template") != "", F.col("segment")))
    following = _class_of(F.get(segments, F.lit(level + 1)))
    sums = ("n", "block", "allow", *CLASSES)
    counted = here.where("segment IS NOT NULL").select(
        "host", "made", "segment", "n", "block", "allow", *[F.when(following == c, F.col("n")).otherwise(0).alias(c) for c in CLASSES]
    )
    branches = counted.groupBy("host", "made", "segment").agg(*[F.sum(name).alias(name) for name in sums])
    branches = settle(branches, "url_branches")
    nodes = branches.groupBy("host", "made").agg(*[F.sum(name).alias(f"all_{name}") for name in sums])
    kept = _salted(branches.where(F.col("n") >= SUPPORT), nodes, ["host", "made"], "segment", "inner").where(
        (F.col("all_n") == F.col("n")) | _differs()
    )
    kept = settle(kept.select("host", "made", "segment", F.lit(True).alias("literal")), "url_literals")
    found = _salted(here, kept, ["host", "made", "segment"], "leaf", "left")
    step = F.when(F.col("literal"), F.col("segment")).otherwise(F.lit("*"))
    made = F.when(F.col("segment").isNull(), F.col("made")).otherwise(F.concat("made", F.lit("/"), step))
    return settle(found.select("leaf", "host", "template", "n", "block", "allow", made.alias("made")), "url_leaves")


def parsed(df: DataFrame, rules=RULES, levels: int = LEVELS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, template, leaf`` of every row; ``leaf`` is a key of host and template."""
    split = df.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    named = split.select("*", rule.alias("rule"), verdict.alias("verdict"), template_of(F.col("path"), levels).alias("template"))
    return named.withColumn("leaf", F.unhex(F.md5(F.concat("host", F.lit("/"), "template").cast("binary"))))


def templates(urls: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Leaves ``leaf, host, template, n, block, allow, made`` and judged templates ``host, made, n, block, allow, purity, verdict``.

    ``urls`` is a table like that of ``parsed``; a verdict in it is a label. Urls with equal host and typed segments are one leaf with counts, combined before
    the shuffle. From the top down, every node compares each branch with the rest of its siblings: a branch met fewer
    than SUPPORT times, or one whose following segments and labels are distributed like those of the rest, becomes part
    of ``*``; the others keep their segment. That is one test a branch, not one a pair.
    A template's purity is the share of blocked urls among its labelled ones, smoothed towards that of all urls.
    """
    leaves = urls.groupBy("leaf", "host", "template").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("verdict") == "block").alias("block"),
        F.count_if(F.col("verdict") == "allow").alias("allow"),
    )
    leaves = settle(leaves.withColumn("made", F.lit("")), "url_leaves")
    for level in range(levels):
        leaves = _grown(leaves, level, levels)
    total = leaves.agg(F.sum("block").alias("block"), F.sum(F.col("block") + F.col("allow")).alias("labelled")).first()
    prior = ((total.block or 0) + 1) / ((total.labelled or 0) + 2)
    sums = leaves.groupBy("host", "made").agg(*[F.sum(name).alias(name) for name in ("n", "block", "allow")])
    labelled = F.col("block") + F.col("allow")
    weight = F.lit(SMOOTHING) + F.lit(UNLABELLED) * (F.col("n") - labelled)
    purity = (F.col("block") + weight * F.lit(prior)) / (labelled + weight)
    judged = sums.withColumn("purity", purity)
    verdict = F.when(F.col("purity") >= PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return leaves, settle(judged.withColumn("verdict", verdict), "url_templates")


def judge(
    df: DataFrame, rules=RULES, levels: int = LEVELS, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template`` of every row: the rule's verdict, else that of its template.

    A url decided by a rule meets no other table. All others look their leaf up among those of rejected templates;
    leaves that hold more than 1 / HEAVY of all urls come by broadcast (at most HEAVY rows), so no key of the shuffled
    join is hot. ``template`` is the url's own, before branches merge.

    A null url, or one without ``://``, has empty host and path and is judged like any other without labels. Repeated
    rows keep a row each. Urls are read whole: of very long segments only the length counts in a template. A segment ``*`` is
    taken for a variable one. No rows in, no rows out. Other columns are ignored.
    """
    urls = parsed(df, rules, levels, id_col, url_col)
    leaves, judged = templates(urls, levels)
    rejected = judged.where("verdict = 'block'").select("host", "made", F.lit("block").alias("says"))
    placed = _salted(leaves, rejected, ["host", "made"], "leaf", "left")
    placed = settle(placed.select("leaf", "n", F.coalesce("says", F.lit("allow")).alias("says")), "url_verdicts")
    total = placed.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HEAVY >= total
    heavy = F.broadcast(placed.where(often).select("leaf", "says"))
    light = placed.where(~often & (F.col("says") == "block")).select("leaf", "says")
    open_urls = urls.where("rule IS NULL")
    shown = ["page_id", "host", "path", "rule", F.coalesce("verdict", "says", F.lit("allow")).alias("verdict"), "template"]
    return (
        urls.where("rule IS NOT NULL")
        .withColumn("says", F.lit(None).cast("string"))
        .select(*shown)
        .unionByName(open_urls.join(heavy, "leaf").select(*shown))
        .unionByName(open_urls.join(heavy, "leaf", "left_anti").join(light, "leaf", "left").select(*shown))
    )
