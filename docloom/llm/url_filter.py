"""URL filter: host and path rules first, then a character language-model ratio.

URLs that a rule decides train two models, one of accepted and one of rejected URLs. Each is a variable-order Markov
model over an alphabet of 32 symbols with contexts of up to three symbols, smoothed by Witten-Bell interpolation down to an
add-one unigram. A URL's score is the mean over its symbols of ln P(accepted) - ln P(rejected). A quarter of the
labelled URLs is held out from the counts and calibrates the threshold (largest balanced accuracy). Log ratios are
rounded to millionths, so sums are exact in any order. Everything is DataFrame work; the one broadcast table has
at most 32^4 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import written

#: 26 letters, one digit, separators, '?' for other URL punctuation and '~' for the rest and for the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-?~"
SIZE = len(ALPHABET)
PAD = SIZE - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): the host and its subdomains, paths with that prefix; the longest host + path wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    found = F.regexp_extract(_after(url), r"^([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or no ://."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def ruled(df: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """df with host, path, rule (host + path of the longest rule that fits, else null) and rule_verdict."""
    d = df.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(name)).otherwise(verdict)
    return d.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _folded(url: Column) -> Column:
    low = F.regexp_replace(F.translate(url, UPPER, LOWER), "[0-9]", "0")
    return F.regexp_replace(F.regexp_replace(low, r"[:?#&=%_+]", "?"), r"[^a-z0/.?\-]", "~")


def _grams(urls: DataFrame) -> DataFrame:
    """One row for each symbol of each url, known by its key alone: gram, the symbol's code and those of the three before, in base 32."""
    codes = F.transform(F.regexp_extract_all("folded", F.lit("(?s)."), F.lit(0)), lambda c: (F.instr(F.lit(ALPHABET), c) - 1).cast("long"))
    d = urls.withColumn("folded", _folded(F.col("url"))).filter(F.length("folded") > 0).withColumn("codes", codes)
    at = lambda i: F.coalesce(F.when(i >= 0, F.get("codes", i)), F.lit(PAD).cast("long"))
    gram = F.transform("codes", lambda c, i: ((at(i - 3) * SIZE + at(i - 2)) * SIZE + at(i - 1)) * SIZE + c)
    return d.select("key", "rule_verdict", "use", F.explode(gram).alias("gram"))


def gram_counts(grams: DataFrame) -> DataFrame:
    """(gram, a, r): every gram that occurs, at most SIZE^4, with its count in accepted and in rejected urls that the models learn from."""
    return grams.groupBy("gram").agg(
        F.sum(F.when((F.col("use") == "fit") & (F.col("rule_verdict") == "allow"), 1).otherwise(0)).alias("a"),
        F.sum(F.when((F.col("use") == "fit") & (F.col("rule_verdict") == "block"), 1).otherwise(0)).alias("r"),
    )


def log_ratios(seen: DataFrame) -> DataFrame:
    """(gram, micro): millionths of ln P(accepted) - ln P(rejected) for every gram of gram_counts()."""
    table = seen.select("gram")
    for order in range(4):
        width = SIZE ** (order + 1)
        counts = seen.groupBy((F.col("gram") % width).alias(f"g{order}")).agg(F.sum("a").alias(f"a{order}"), F.sum("r").alias(f"r{order}"))
        context = counts.groupBy(F.floor(F.col(f"g{order}") / SIZE).alias(f"c{order}")).agg(
            F.sum(f"a{order}").alias(f"an{order}"),
            F.sum(f"r{order}").alias(f"rn{order}"),
            F.sum((F.col(f"a{order}") > 0).cast("long")).alias(f"at{order}"),
            F.sum((F.col(f"r{order}") > 0).cast("long")).alias(f"rt{order}"),
        )
        own = F.col("gram") % width
        table = table.withColumn(f"g{order}", own).withColumn(f"c{order}", F.floor(own / SIZE)).join(counts, f"g{order}").join(context, f"c{order}")
    p = {}
    for side in "ar":
        p[side] = (F.col(f"{side}0") + 1.0) / (F.col(f"{side}n0") + float(SIZE))
        for order in range(1, 4):
            n, t = F.col(f"{side}n{order}"), F.col(f"{side}t{order}")
            p[side] = F.when(n > 0, (F.col(f"{side}{order}") + t * p[side]) / (n + t)).otherwise(p[side])
    return table.select("gram", F.round((F.ln(p["a"]) - F.ln(p["r"])) * 1e6).cast("long").alias("micro"))


def url_verdicts(df: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """df with host, path, rule, verdict and micro (the mean log ratio in millionths; null where the url has no symbol).

    Each different url trains and calibrates once, however often it occurs. Without labelled urls on both sides the
    threshold is 0. A null or empty url has no rule and takes the verdict of score 0; urls of any length are read whole. Repeated rows and null ids
    are returned as they are; an empty table gives an empty result; columns of df named like a result, or rule_verdict, are replaced.
    """
    own = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "micro", "rule_verdict")]
    pages = ruled(df.select(*own), rules, url_col)
    key = F.md5(F.col(url_col).cast("binary"))
    use = F.when(F.col("rule_verdict").isNull(), "none").when(F.col("key") < "4", "check").otherwise("fit")
    urls = pages.filter(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), key.alias("key"), "rule_verdict").distinct().withColumn("use", use)
    # Urls are far smaller than their grams, so they are dealt anew before these are made.
    grams = _grams(urls.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key"))
    seen = written(gram_counts(grams), "gram-counts")
    scored = (
        grams.join(F.broadcast(log_ratios(seen)), "gram")
        .groupBy("key", "rule_verdict", "use")
        .agg(F.floor(F.sum("micro") / F.count(F.lit(1))).cast("long").alias("micro"))
    )
    scored = written(scored, "url-scores")
    cut = _threshold(scored).first()["cut"]
    out = pages.join(scored.select(F.col("key").alias("url_key"), "micro"), key == F.col("url_key"), "left")
    method = F.when(F.coalesce("micro", F.lit(0)) >= cut, "allow").otherwise("block")
    return out.select(*own, "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "micro")


def _threshold(scored: DataFrame) -> DataFrame:
    """One row, cut: of the steps of 10,000 millionths within +-10, the one with the largest balanced accuracy on the held-out labelled urls; ties take the smallest size."""
    step = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("micro") / 10000))).cast("long")
    histogram = scored.filter("use = 'check'").groupBy(step.alias("step")).agg(
        F.sum((F.col("rule_verdict") == "allow").cast("long")).alias("a"), F.sum((F.col("rule_verdict") == "block").cast("long")).alias("r")
    )
    # At most 2,001 steps, so one task orders them.
    edges = histogram.sparkSession.range(-1000, 1001).withColumnRenamed("id", "step").join(histogram, "step", "left").na.fill(0)
    up = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gained = edges.select("step", F.sum("a").over(up).alias("a"), F.sum("r").over(up).alias("r"), F.sum("a").over(whole).alias("n_a"), F.sum("r").over(whole).alias("n_r"))
    gain = F.col("a") * F.col("n_r") - F.col("r") * F.col("n_a")
    best = F.max_by(F.col("step") * 10000, F.struct(gain, -F.abs("step"), F.col("step")))
    both = F.max(F.col("n_a") * F.col("n_r")) > 0
    return gained.agg(F.when(both, best).otherwise(F.lit(0)).alias("cut"))


def op2_char_ratio(spark, sf_dir: str) -> DataFrame:
    """Every page's url with its host, path, rule and verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict", "micro")


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_LONGEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_ORDERS = "".join(
    f"""
k{o} AS (SELECT gram % {SIZE ** (o + 1)} AS g, sum(a) AS a, sum(r) AS r FROM seen GROUP BY 1),
c{o} AS (SELECT g // {SIZE} AS c, sum(a) AS an, sum(r) AS rn, sum((a > 0)::INT) AS at, sum((r > 0)::INT) AS rt FROM k{o} GROUP BY 1),"""
    for o in range(4)
)


def _p(side: str) -> str:
    p = f"((k0.{side} + 1.0::DOUBLE) / (c0.{side}n + {SIZE}.0::DOUBLE))"
    for o in range(1, 4):
        p = f"(CASE WHEN c{o}.{side}n > 0 THEN (k{o}.{side}::DOUBLE + c{o}.{side}t::DOUBLE * {p}) / (c{o}.{side}n + c{o}.{side}t)::DOUBLE ELSE {p} END)"
    return p


_JOINS = "\n".join(f"JOIN k{o} ON k{o}.g = seen.gram % {SIZE ** (o + 1)} JOIN c{o} ON c{o}.c = (seen.gram % {SIZE ** (o + 1)}) // {SIZE}" for o in range(4))
#: DuckDB text of op2_char_ratio.
OP2_SQL = f"""
WITH cut_up AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut_up),
judged AS (
  SELECT *, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in _LONGEST)} END AS rule,
         CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in _LONGEST)} END AS rule_verdict FROM parts),
urls AS (
  SELECT DISTINCT url, rule_verdict, CASE WHEN rule_verdict IS NULL THEN 'none' WHEN md5(url) < '4' THEN 'check' ELSE 'fit' END AS use
  FROM judged WHERE url IS NOT NULL),
folded AS (
  SELECT url, rule_verdict, use,
         regexp_replace(regexp_replace(regexp_replace(translate(url, '{UPPER}', '{LOWER}'), '[0-9]', '0', 'g'), '[:?#&=%_+]', '?', 'g'), '[^a-z0/.?\\-]', '~', 'g') AS f
  FROM urls),
codes AS (
  SELECT url, rule_verdict, use, list_transform(generate_series(1, length(f)), lambda i: strpos('{ALPHABET}', f[i]) - 1) AS c FROM folded WHERE length(f) > 0),
grams AS (
  SELECT url, rule_verdict, use, unnest(list_transform(generate_series(1, len(c)), lambda i:
    ((coalesce(CASE WHEN i > 3 THEN c[i - 3] END, {PAD}) * {SIZE} + coalesce(CASE WHEN i > 2 THEN c[i - 2] END, {PAD})) * {SIZE}
      + coalesce(CASE WHEN i > 1 THEN c[i - 1] END, {PAD})) * {SIZE} + c[i])) AS gram FROM codes),
seen AS (
  SELECT gram, sum((use = 'fit' AND rule_verdict = 'allow')::INT) AS a, sum((use = 'fit' AND rule_verdict = 'block')::INT) AS r FROM grams GROUP BY gram),{_ORDERS}
ratios AS (SELECT seen.gram, round((ln({_p("a")}) - ln({_p("r")})) * 1e6)::BIGINT AS micro FROM seen
{_JOINS}),
scored AS (
  SELECT url, rule_verdict, use, floor(sum(micro) / count(*))::BIGINT AS micro FROM grams JOIN ratios USING (gram) GROUP BY ALL),
steps AS (
  SELECT greatest(-1000, least(1000, floor(micro / 10000)))::BIGINT AS step, sum((rule_verdict = 'allow')::INT) AS a, sum((rule_verdict = 'block')::INT) AS r
  FROM scored WHERE use = 'check' GROUP BY 1),
gained AS (
  SELECT e.step, sum(coalesce(a, 0)) OVER (ORDER BY e.step DESC) AS a, sum(coalesce(r, 0)) OVER (ORDER BY e.step DESC) AS r,
         sum(coalesce(a, 0)) OVER () AS n_a, sum(coalesce(r, 0)) OVER () AS n_r
  FROM (SELECT unnest(generate_series(-1000, 1000)) AS step) e LEFT JOIN steps ON steps.step = e.step),
best AS (SELECT step, n_a, n_r FROM gained ORDER BY a * n_r - r * n_a DESC, abs(step), step DESC LIMIT 1),
cut AS (SELECT CASE WHEN n_a * n_r > 0 THEN step * 10000 ELSE 0 END AS cut FROM best)
SELECT page_id, host, path, rule, coalesce(judged.rule_verdict, CASE WHEN coalesce(micro, 0) >= cut THEN 'allow' ELSE 'block' END) AS verdict, micro
FROM judged LEFT JOIN scored ON judged.url = scored.url CROSS JOIN cut
"""
