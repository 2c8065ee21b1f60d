"""URL filter: host and path rules, and a character language-model ratio for all other URLs.

Rules give accepted and rejected URLs; from these two variable-order Markov models over characters are
counted (Witten-Bell smoothed, contexts of up to three characters, backing off to shorter ones). A URL
without a rule is judged by the difference of its log-likelihoods per character, against a threshold
calibrated on labelled URLs that the models have not seen.

Everything is DataFrame operations. Characters fold to a fixed alphabet, so grams number at most 43**4
whatever the corpus, and far fewer in practice; their table is broadcast below
``broadcast_grams`` rows and joined by shuffle above. URLs that fold alike are scored once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import cut

#: Verdict and host/path of each rule.
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALPHABET = 43


@dataclass(frozen=True)
class UrlModel:
    """Context length, calibration share (of 16), score bins, the row limit of a broadcast and the most URLs sent by one."""

    order: int = 3
    held: tuple[str, ...] = ("0", "4", "8", "c")
    bins: int = 400
    span: float = 4.0
    broadcast_grams: int = 500_000
    heavy: float = 10_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does; ties to the earlier rule."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, start = rule.partition("/")
        inside = (host == own) | host.endswith(f".{own}")
        fits.append(F.when(inside & path.startswith(slash + start), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _folded(host: Column, path: Column, order: int) -> Column:
    """Host and path over the fixed alphabet, with start and end marks."""
    plain = F.translate(F.concat(host, path), _UPPER, _LOWER)
    return F.concat(F.lit("^" * order), F.regexp_replace(plain, "[^a-z0-9/._-]", "*"), F.lit("$"))


def _grams(folded: Column, order: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(folded) - order), lambda i: F.substr(folded, i, F.lit(order + 1)))


def gram_ratios(grams: DataFrame, order: int) -> DataFrame:
    """g, ratio: log of the two models' probabilities of a gram's last character after its first ones.

    ``grams`` has every gram to be scored with its counts among accepted (a) and rejected (r) URLs.
    """
    base = grams
    for k in range(order + 1):
        sums = grams.groupBy(F.right("g", F.lit(k + 1)).alias(f"s{k}")).agg(F.sum("a").alias(f"a{k}"), F.sum("r").alias(f"r{k}"))
        context = sums.groupBy(F.substring(f"s{k}", 1, k).alias(f"c{k}")).agg(
            *[f(x).alias(f"{name}{x}") for x in (f"a{k}", f"r{k}") for name, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))]
        )
        both = sums.join(context, F.substring(f"s{k}", 1, k) == F.col(f"c{k}")).drop(f"c{k}")
        base = base.join(both, F.right("g", F.lit(k + 1)) == F.col(f"s{k}")).drop(f"s{k}")

    def chance(x: str) -> Column:
        p = F.lit(1.0 / _ALPHABET)
        for k in range(order + 1):
            own, n, t = F.col(f"{x}{k}"), F.col(f"n{x}{k}"), F.col(f"t{x}{k}")
            p = F.when(n > 0, (own + t * p) / (n + t)).otherwise(p)
        return p

    return base.select("g", (F.log(chance("a")) - F.log(chance("r"))).alias("ratio"))


def _threshold(scored: DataFrame, options: UrlModel) -> float:
    """Bin edge of the best balanced accuracy over scored calibration URLs; 0 if a class has none."""
    step = 2 * options.span / options.bins
    at = F.floor((F.least(F.greatest("score", F.lit(-options.span)), F.lit(options.span)) + options.span) / step)
    bins = scored.groupBy(at.alias("bin")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    below, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    right = (1 - F.coalesce(F.sum("a").over(below), F.lit(0)) / F.sum("a").over(every)) + F.coalesce(F.sum("r").over(below), F.lit(0)) / F.sum("r").over(every)
    both = bins.agg(F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    if not both.a or not both.r:
        return 0.0
    edge = F.col("bin") * step - options.span
    best = bins.select(edge.alias("edge"), F.round(right, 9).alias("right")).orderBy(F.desc("right"), F.abs("edge"), "edge").first()
    return float(best.edge)


def filter_urls(pages: DataFrame, rules=RULES, options: UrlModel = UrlModel()) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (null where a rule decides).

    Null URLs and URLs without ``://`` have empty parts and are scored as such. Where the rules leave no
    accepted or no rejected URL there is nothing to compare and URLs without a rule are allowed. Repeated
    rows get equal verdicts, null ids too; columns other than page_id and url are not read. URLs are scored whole,
    whatever their length; an empty table gives no rows.
    """
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    parsed = parsed.withColumn("folded", _folded(F.col("host"), F.col("path"), options.order))
    urls = parsed.groupBy("folded").agg(
        F.count_if(F.col("fit.verdict") == "allow").alias("a"), F.count_if(F.col("fit.verdict") == "block").alias("r"), F.count_if(F.col("fit").isNull()).alias("free")
    )
    urls = cut(urls.withColumn("held", F.substring(F.md5("folded"), 1, 1).isin(*options.held)))
    learned = lambda c: F.sum(F.when(F.col("held"), 0).otherwise(F.col(c))).alias(c)
    grams = urls.select(F.explode(_grams(F.col("folded"), options.order)).alias("g"), "a", "r", "held").groupBy("g").agg(learned("a"), learned("r"))
    ratios = cut(gram_ratios(cut(grams), options.order))
    classes = urls.agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.sum("free").alias("free")).first()
    fits_in_memory = ratios.count() <= options.broadcast_grams
    table = F.broadcast(ratios) if fits_in_memory else ratios
    asked = urls.where("free > 0 or held").select("folded", "a", "r", "held", "free", F.explode(_grams(F.col("folded"), options.order)).alias("g"))
    scores = cut(
        asked.join(table, "g").groupBy("folded").agg(F.round(F.avg("ratio"), 9).alias("score"), *[F.first(c).alias(c) for c in ("a", "r", "held", "free")])
    )
    edge = _threshold(scores.where("held and a + r > 0"), options) if classes.a and classes.r else float("-inf")
    # URLs of many rows are at most ``heavy``, as all rows without a rule together are classes.free; they return by a broadcast
    often = F.col("free") > (classes.free or 0) / options.heavy
    wanted = scores.where("free > 0")
    judged = parsed.withColumn("folded", F.when(F.col("fit").isNull(), F.col("folded")))
    judged = judged.join(F.broadcast(wanted.where(often).select("folded", F.col("score").alias("common"))), "folded", "left")
    salt = F.when(F.col("folded").isNotNull() & F.col("common").isNull(), 0).otherwise(F.xxhash64("page_id", "host", "path"))
    judged = judged.withColumn("salt", salt).join(wanted.where(~often).select("folded", "score", F.lit(0).cast("bigint").alias("salt")), ["folded", "salt"], "left")
    judged = judged.withColumn("score", F.coalesce("common", "score"))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= edge, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.round(F.when(F.col("fit").isNull(), F.col("score")), 6).alias("score"))


def oracle(rules=RULES, options: UrlModel = UrlModel()) -> str:
    """The same filter as SQL over ``pages``."""
    low = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    fits = {"rule": "", "verdict": ""}
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, start = rule.partition("/")
        test = f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash}{start}')"
        fits["rule"] += f" WHEN {test} THEN '{rule}'"
        fits["verdict"] += f" WHEN {test} THEN '{verdict}'"
    k = options.order
    levels, joins = "", ""
    for i in range(k + 1):
        levels += f"""
s{i} AS (SELECT right(g, {i + 1}) AS s, left(right(g, {i + 1}), {i}) AS c, sum(a) AS a, sum(r) AS r FROM grams GROUP BY 1, 2),
c{i} AS (SELECT c, sum(a) AS na, count(*) FILTER (WHERE a > 0) AS ta, sum(r) AS nr, count(*) FILTER (WHERE r > 0) AS tr FROM s{i} GROUP BY 1),"""
        joins += f" JOIN s{i} ON s{i}.s = right(g, {i + 1}) JOIN c{i} ON c{i}.c = s{i}.c"
    chance = {}
    for x in "ar":
        p = f"{1.0 / _ALPHABET!r}::DOUBLE"
        for i in range(k + 1):
            p = f"(CASE WHEN c{i}.n{x} > 0 THEN (s{i}.{x}::DOUBLE + c{i}.t{x} * {p}) / (c{i}.n{x} + c{i}.t{x}) ELSE {p} END)"
        chance[x] = p
    step = 2 * options.span / options.bins
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {low("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT *, CASE{fits["rule"]} END AS rule, CASE{fits["verdict"]} END AS verdict,
  '{"^" * k}' || regexp_replace({low("host || path")}, '[^a-z0-9/._-]', '*', 'g') || '$' AS folded FROM h),
urls AS (SELECT folded, count(*) FILTER (WHERE verdict = 'allow') AS a, count(*) FILTER (WHERE verdict = 'block') AS r, count(*) FILTER (WHERE verdict IS NULL) AS free,
  left(md5(folded), 1) IN {options.held} AS held FROM f GROUP BY 1),
cut AS (SELECT *, unnest(list_transform(range(1, len(folded) - {k} + 1), lambda i: substr(folded, i, {k + 1}))) AS g FROM urls),
grams AS (SELECT g, sum(CASE WHEN held THEN 0 ELSE a END) AS a, sum(CASE WHEN held THEN 0 ELSE r END) AS r FROM cut GROUP BY 1),{levels}
ratios AS (SELECT g, ln({chance["a"]}) - ln({chance["r"]}) AS ratio FROM grams{joins}),
scores AS (SELECT folded, round(avg(ratio), 9) AS score, any_value(a) AS a, any_value(r) AS r, any_value(held) AS held FROM cut JOIN ratios USING (g) GROUP BY 1),
bins AS (SELECT floor((least(greatest(score, -{options.span}), {options.span}) + {options.span}) / {step}) AS bin, sum(a) AS a, sum(r) AS r FROM scores WHERE held AND a + r > 0 GROUP BY 1),
sides AS (SELECT bin * {step} - {options.span} AS edge, round((1 - coalesce(sum(a) OVER before, 0) / sum(a) OVER ()) + coalesce(sum(r) OVER before, 0) / sum(r) OVER (), 9) AS correct,
  sum(a) OVER () AS ta, sum(r) OVER () AS tr FROM bins WINDOW before AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
edge AS (SELECT CASE WHEN (SELECT sum(a) FROM urls) > 0 AND (SELECT sum(r) FROM urls) > 0
  THEN coalesce((SELECT edge FROM sides WHERE ta > 0 AND tr > 0 ORDER BY correct DESC, abs(edge), edge LIMIT 1), 0.0) ELSE '-infinity'::DOUBLE END AS edge)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= edge THEN 'allow' ELSE 'block' END) AS verdict,
  round(CASE WHEN verdict IS NULL THEN score END, 6) AS score
FROM f JOIN scores USING (folded), edge"""
