"""URL filter by path-template trees. DataFrame functions only.

Rules (host, path prefix, verdict) judge the urls they fit: a rule fits its host
and all subdomains where the path starts with the rule's path, and the longest
rule wins. Urls that no rule fits are judged by what the rules teach about the
templates of their host:

* each host has a tree of path segments, as deep as its paths; a segment that varies
  (it holds a digit, or it is one of many rare ones at its place) is generalised to a
  wildcard;
* branches at the same place that are like the others are merged into the wildcard. If
  rules judge enough urls of a branch and of the others, their shares of blocked urls
  are compared (chi-squared); else what all urls show: how many of them end there, go on
  with a variable segment, or go on with another one (chi-squared, 2 degrees of freedom);
* a template is rejected if its share of blocked urls among its labelled ones, smoothed
  towards that of its host, reaches ``PURITY``; its urls without a rule are blocked, all
  others allowed.

All statistics are aggregated with map-side combining over the distinct shapes of
paths, so a host with any number of urls costs its distinct shapes. The tree grows level
by level; a shape leaves it where no other shape shares its branch.

Defined results: a null url and one without ``://`` have an empty host and path, fit
no rule and are allowed; repeated rows are judged alike and count as often as they
occur; whole paths are read; a segment ``*`` is written ``%2A`` in templates; columns of
the input named like those made here are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import release, stage

#: A place with more than MANY branches is variable; its branches with fewer than FEW urls are generalised.
MANY = 20
FEW = 5
#: Chi-squared up to which branches are similar: of labels (1 degree of freedom), and of what urls show (2).
SIMILAR = 3.84
ALIKE = 5.99
#: The least labelled urls of a branch or template that say something.
LEAST = 3
#: Weight of the host's share in a template's purity and of all hosts' in the host's, and the purity to reject.
PRIOR = 2.0
PURITY = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def apply_rules(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


_SUMS = ("n", "l", "b", "e", "v")


def _segments(path: Column) -> Column:
    """The segments of a path, those with a digit as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), "*").when(s == "*", "%2A").otherwise(s))


def judge(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", keep: list[str] | None = None, teaches: Column | None = None) -> DataFrame:
    """``keep`` columns of ``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``learned``.

    ``learned`` is the verdict of the template, also where a rule judges. Rows for which
    ``teaches`` does not hold are judged, but their rules teach nothing.
    """
    made = ["host", "path", "rule", "verdict", "template", "learned"]
    keep = [c for c in (pages.columns if keep is None else keep) if c not in made]
    host, path = split_url(F.col(url_col))
    rows = pages.select(*(F.col(c).alias(f"k_{c}") for c in keep), host.alias("host"), path.alias("path"), (F.lit(True) if teaches is None else teaches).alias("_teaches"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict, "shape": F.array_join(_segments(F.col("path")), "/")})
    learned = _learn(rows.select("host", "shape", F.when(F.col("_teaches"), F.col("verdict")).alias("label")))
    out = rows.join(learned, ["host", "shape"], "left")
    kept = [F.col(f"k_{c}").alias(c) for c in keep]
    return out.select(*kept, "host", "path", "rule", F.coalesce("verdict", "learned").alias("verdict"), "template", "learned")


def _learn(urls: DataFrame) -> DataFrame:
    """(host, shape, template, learned) of all distinct shapes of (host, shape, label)."""
    count = lambda c: F.count(F.when(c, 1))
    shapes = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("l"), count(F.col("label") == "block").alias("b"))
    # ``at``: the template so far; ``left``: the segments below it
    shapes = shapes.withColumns({"at": F.lit(""), "left": F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/"))})
    shapes = stage(shapes, "shapes")
    done = []
    while True:
        ended = shapes.where(F.size("left") == 0)
        done.append(ended.select("host", "shape", "l", "b", F.when(F.col("at") == "", "/").otherwise(F.col("at")).alias("template")))
        shapes = shapes.where(F.size("left") > 0)
        if shapes.isEmpty():
            break
        shapes = stage(_level(shapes), "level")
    templates = done[0]
    for d in done[1:]:
        templates = templates.unionByName(d)
    templates = stage(templates, "templates")
    release(urls.sparkSession, *done)
    totals = templates.groupBy("host", "template").agg(F.sum("l").alias("tl"), F.sum("b").alias("tb"))
    hosts = totals.groupBy("host").agg(F.sum("tl").alias("hl"), F.sum("tb").alias("hb"))
    share = templates.agg(F.coalesce(F.try_divide(F.sum("b"), F.sum("l")), F.lit(0.0)).alias("share")).first().share
    above = (F.col("hb") + PRIOR * share) / (F.col("hl") + PRIOR)
    purity = (F.col("tb") + PRIOR * above) / (F.col("tl") + PRIOR)
    judged = totals.join(hosts, "host").select("host", "template", F.when((F.col("tl") >= LEAST) & (purity >= PURITY), "block").otherwise("allow").alias("learned"))
    return templates.join(judged, ["host", "template"]).select("host", "shape", "template", "learned")


def _level(shapes: DataFrame) -> DataFrame:
    """One segment of every shape goes from ``left`` to ``at``: as it is, or as a wildcard."""
    after = F.when(F.size("left") > 1, F.col("left")[1])
    rows = shapes.withColumns({"seg": F.col("left")[0], "e": F.when(after.isNull(), F.col("n")).otherwise(0), "v": F.when(after == "*", F.col("n")).otherwise(0)})
    branch = rows.groupBy("host", "at", "seg").agg(*(F.sum(c).alias(f"c{c}") for c in _SUMS), F.count("*").alias("shapes"))
    place = branch.groupBy("host", "at").agg(*(F.sum(f"c{c}").alias(f"p{c}") for c in _SUMS), F.count("*").alias("branches"))
    both = branch.join(place, ["host", "at"])
    rare = (F.col("branches") > MANY) & (F.col("cn") < FEW)
    # the branch against the others at its place, by labels or by what urls show
    told = (F.col("cl") >= LEAST) & (F.col("pl") - F.col("cl") >= LEAST)
    both_of = lambda f: (f("c"), f("p"))
    labels = _chi("l", both_of(lambda x: F.col(f"{x}b")), both_of(lambda x: F.col(f"{x}l") - F.col(f"{x}b")))
    shows = _chi("n", both_of(lambda x: F.col(f"{x}e")), both_of(lambda x: F.col(f"{x}v")), both_of(lambda x: F.col(f"{x}n") - F.col(f"{x}e") - F.col(f"{x}v")))
    like = F.when(told, labels <= SIMILAR).otherwise(shows <= ALIKE)
    wild = (F.col("seg") == "*") | rare | ((F.col("branches") > 1) & like)
    step = both.select("host", "at", "seg", F.when(wild, "*").otherwise(F.col("seg")).alias("step"), (F.col("shapes") == 1).alias("alone"))
    out = rows.join(step, ["host", "at", "seg"])
    rest = F.slice("left", 2, F.size("left"))
    # a shape that has its branch for itself keeps the segments below it
    own = F.col("alone") & ~F.col("step").eqNullSafe("*") & (F.size("left") > 1)
    at = F.concat_ws("/", "at", "step", F.when(own, F.array_join(rest, "/")))
    return out.select("host", "shape", "n", "l", "b", at.alias("at"), F.when(own, F.array().cast("array<string>")).otherwise(rest).alias("left"))


def _chi(size: str, *kinds: tuple[Column, Column]) -> Column:
    """Chi-squared of a branch against the others; ``kinds``: how many of the branch, and of all, are of each kind."""
    c, p = F.col(f"c{size}").cast("double"), F.col(f"p{size}").cast("double")
    parts = [F.coalesce(F.try_divide((own * p - all_ * c) * (own * p - all_ * c), c * (p - c) * all_), F.lit(0.0)) for own, all_ in kinds]
    return sum(parts[1:], parts[0])
