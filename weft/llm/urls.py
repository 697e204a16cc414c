"""URL filter: allow and block rules, and a character language-model ratio for all other URLs.

Two variable-order Markov models, of accepted and of rejected URLs, are counted from the URLs that a rule decides.
Each order is smoothed towards the next lower one. Every string of a character and its context that stands MIN_COUNT
times or more is kept, so the models grow with the corpus. A URL's score is the mean log ratio of its characters under
both models, each by the longest kept context; the threshold is the one that parts the rules' own URLs best.

Scores are worked out once for each distinct context and joined to the places: those of the few contexts that stand at
more than one in HEAVY of all places (HEAVY at most, so they are broadcast), and by a shuffle those of all others.
All of it is DataFrame expressions.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is blocked; with no
accepted or no rejected URLs to learn from, others are allowed; ties between thresholds go to the one nearest 0;
repeated rows get equal verdicts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import durable, shuffle_partitions, table

#: (rule, verdict); a rule is a host and the beginning of a path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
ORDERS = 5
HEAVY = 1 << 13
MIN_COUNT = 2
#: Weight of the lower order, in characters seen.
SMOOTHING = 4.0
CHARACTERS = 256
#: Scores are calibrated in steps of 1 / STEPS between -LIMIT and LIMIT.
STEPS, LIMIT = 100, 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: len(x[0])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _places(df: DataFrame) -> DataFrame:
    """(s, ...) with ``gram`` for every character but the start mark: it and up to ORDERS - 1 characters before it."""
    places = df.filter(F.length("s") > 2).select("*", F.explode(F.sequence(F.lit(2), F.length("s"))).alias("p"))
    return places.withColumn("gram", F.expr(f"substring(s, greatest(1, p - {ORDERS - 1}), least(p, {ORDERS}))")).drop("p")


def model(labelled: DataFrame) -> DataFrame:
    """(s, n, accepted) to (gram, ratio): the log ratio of the last character's probabilities after the others."""
    whole = _places(labelled).groupBy("gram", "accepted").agg(F.sum("n").alias("n"))
    grams = whole.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("gram")), lambda k: F.right("gram", k))).alias("gram"), "n", "accepted")
    counts = grams.groupBy("gram").agg(F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("no"))
    counts = durable(counts.filter(F.col("yes") + F.col("no") >= MIN_COUNT))
    sums = counts.filter(F.length("gram") == 1).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).first()
    levels = []
    for k in range(ORDERS):
        own = counts.filter(F.length("gram") == k + 1)
        if k == 0:
            own = own.withColumns({"cy": F.lit(sums["yes"] or 0), "cn": F.lit(sums["no"] or 0), "ly": F.lit(1 / CHARACTERS), "ln": F.lit(1 / CHARACTERS)})
        else:
            context = counts.select(F.col("gram").alias("context"), F.col("yes").alias("cy"), F.col("no").alias("cn"))
            lower = levels[-1].select(F.col("gram").alias("lower"), F.col("py").alias("ly"), F.col("pn").alias("ln"))
            # The start mark is a context but no character, so it has no count of its own.
            own = own.withColumns({"context": F.expr(f"left(gram, {k})"), "lower": F.expr(f"right(gram, {k})")})
            own = own.join(context, "context", "left").join(lower, "lower", "left").fillna(0, ["cy", "cn"]).fillna(1 / CHARACTERS, ["ly", "ln"])
            own = own.withColumns({"cy": F.greatest("cy", "yes"), "cn": F.greatest("cn", "no")})
        p = lambda n, c, low: (F.col(n) + SMOOTHING * F.col(low)) / (F.col(c) + SMOOTHING)
        levels.append(own.select("gram", p("yes", "cy", "ly").alias("py"), p("no", "cn", "ln").alias("pn")))
    every = reduce(DataFrame.unionByName, levels)
    return durable(every.select("gram", F.log(F.col("py") / F.col("pn")).alias("ratio")))


def score_urls(urls: DataFrame, ratios: DataFrame, *, heavy: int = HEAVY) -> DataFrame:
    """(s) to (s, score): the mean over all characters of the ratio after the longest context the model has."""
    # Dealt out by number, so that the places, many for each URL, are not made in one task.
    own = urls.select("s").repartition(shuffle_partitions(urls.sparkSession), "s").distinct()
    places = _places(own)
    grams = durable(places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    total = grams.agg(F.sum("n")).first()[0] or 0
    # The ratio of the longest end of each distinct context that the model has.
    ends = grams.select("gram", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("gram")), lambda k: F.right("gram", k))).alias("k", "end"))
    known = ends.join(ratios.withColumnRenamed("gram", "end"), "end").groupBy("gram").agg(F.max_by("ratio", "k").alias("ratio"))
    known = durable(grams.join(known, "gram", "left").select("gram", "n", F.coalesce("ratio", F.lit(0.0)).alias("ratio")))
    often = F.col("n") > total / heavy
    # HEAVY rows at most: each stands at more than one in HEAVY of all places.
    near = F.broadcast(known.filter(often).select("gram", "ratio"))
    by_often = places.join(near, "gram").select("s", "ratio")
    by_rare = places.join(near, "gram", "left_anti").join(known.filter(~often).select("gram", "ratio"), "gram").select("s", "ratio")
    return by_often.unionByName(by_rare).groupBy("s").agg(F.avg("ratio").alias("score"))


def threshold(scores: DataFrame) -> float:
    """(score, n, accepted) to the threshold with the least sum of both classes' error rates."""
    step = F.greatest(F.lit(-LIMIT * STEPS), F.least(F.lit(LIMIT * STEPS), F.floor(F.col("score") * STEPS)))
    bins = scores.filter("score IS NOT NULL").groupBy(step.cast("int").alias("b"), "accepted").agg(F.sum("n").alias("n")).collect()  # a row per step and class
    yes, no = ({r["b"]: r["n"] for r in bins if r["accepted"] is kind} for kind in (True, False))
    if not yes or not no:
        return float("-inf")
    all_yes, all_no, best = sum(yes.values()), sum(no.values()), None
    below_yes = below_no = 0
    for b in range(-LIMIT * STEPS, LIMIT * STEPS + 2):
        wrong = below_yes / all_yes + 1 - below_no / all_no
        best = min(best or (wrong, abs(b), b), (wrong, abs(b), b))
        below_yes, below_no = below_yes + yes.get(b, 0), below_no + no.get(b, 0)
    return best[2] / STEPS


def judge_urls(pages: DataFrame, *, rules=RULES, heavy: int = HEAVY, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    own = own.select("id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "ruled": verdict, "s": F.concat(F.lit("\x02"), "host", "path", F.lit("\x03"))})
    own = own.withColumn("s", F.when((F.col("host") != "") | (F.col("path") != ""), F.col("s")))
    labelled = own.filter("rule IS NOT NULL").groupBy("s", (F.col("ruled") == "allow").alias("accepted")).agg(F.count(F.lit(1)).alias("n"))
    ratios = model(labelled)
    scores = durable(score_urls(own.filter("s IS NOT NULL"), ratios, heavy=heavy))
    least = threshold(labelled.join(scores, "s"))
    passed = F.coalesce(F.col("score") >= least, F.lit(False))
    return own.join(scores, "s", "left").select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(passed, "allow").otherwise("block")).alias("verdict"), F.round("score", 6).alias("score"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _level_sql(k: int) -> str:
    p = lambda own, context, lower: f"(c.{own} + {SMOOTHING} * coalesce(l.{lower}, {1 / CHARACTERS})) / (greatest(coalesce(x.{own}, 0), c.{own}) + {SMOOTHING})"
    return f"""m{k} AS (SELECT c.gram, {p("yes", "cy", "py")} AS py, {p("no", "cn", "pn")} AS pn FROM c
  LEFT JOIN c x ON x.gram = left(c.gram, {k}) LEFT JOIN m{k - 1} l ON l.gram = right(c.gram, {k}) WHERE length(c.gram) = {k + 1})"""


def _rules_sql(out: int) -> str:
    case = ""
    for r in sorted(RULES, key=lambda x: -len(x[0])):
        h, _, path = r[0].partition("/")
        case += f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{path}') THEN '{r[out]}'"
    return f"CASE{case} END"


OP4_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {_rules_sql(0)} AS rule, {_rules_sql(1)} AS ruled,
             CASE WHEN host <> '' OR path <> '' THEN chr(2) || host || path || chr(3) END AS s FROM p),
lab AS (SELECT s, ruled = 'allow' AS acc, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY 1, 2),
pl AS (SELECT s, n, acc, unnest(range(2, length(s) + 1)) AS p FROM lab WHERE length(s) > 2),
g AS (SELECT substr(s, p - k, k + 1) AS gram, n, acc FROM pl, unnest(range(0, {ORDERS})) AS t(k) WHERE p > k),
c0 AS (SELECT gram, CAST(sum(CASE WHEN acc THEN n ELSE 0 END) AS DOUBLE) AS yes, CAST(sum(CASE WHEN acc THEN 0 ELSE n END) AS DOUBLE) AS no FROM g GROUP BY gram),
c AS (SELECT * FROM c0 WHERE yes + no >= {MIN_COUNT}),
z AS (SELECT sum(yes) AS y, sum(no) AS n FROM c WHERE length(gram) = 1),
m0 AS (SELECT gram, (yes + {SMOOTHING / CHARACTERS}) / (y + {SMOOTHING}) AS py, (no + {SMOOTHING / CHARACTERS}) / (n + {SMOOTHING}) AS pn FROM c, z WHERE length(gram) = 1),
{", ".join(_level_sql(k) for k in range(1, ORDERS))},
m AS ({" UNION ALL ".join(f"SELECT gram, ln(py / pn) AS ratio FROM m{k}" for k in range(ORDERS))}),
sp AS (SELECT s, unnest(range(2, length(s) + 1)) AS p FROM (SELECT DISTINCT s FROM r WHERE length(s) > 2)),
sc AS (SELECT s, avg(coalesce({", ".join(f"m{k}.ratio" for k in reversed(range(ORDERS)))}, 0)) AS score
       FROM sp {" ".join(f"LEFT JOIN m m{k} ON m{k}.gram = CASE WHEN p > {k} THEN substr(sp.s, p - {k}, {k + 1}) END" for k in range(ORDERS))} GROUP BY s),
b AS (SELECT greatest({-LIMIT * STEPS}, least({LIMIT * STEPS}, floor(score * {STEPS}))) AS b, sum(CASE WHEN acc THEN n ELSE 0 END) AS yes,
             sum(CASE WHEN acc THEN 0 ELSE n END) AS no FROM lab JOIN sc USING (s) GROUP BY 1),
w AS (SELECT x, coalesce(sum(yes) FILTER (b < x), 0) / (SELECT sum(yes) FROM b) + 1 - coalesce(sum(no) FILTER (b < x), 0) / (SELECT sum(no) FROM b) AS wrong
      FROM range({-LIMIT * STEPS}, {LIMIT * STEPS + 2}) AS t(x), b GROUP BY x),
least_score AS (SELECT x / {STEPS}.0 AS v FROM w WHERE wrong IS NOT NULL ORDER BY wrong, abs(x), x LIMIT 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= coalesce((SELECT v FROM least_score), '-infinity'::DOUBLE) THEN 'allow' ELSE 'block' END) AS verdict,
       round(score, 6) AS score
FROM r LEFT JOIN sc USING (s)
"""

QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES = {"op4_url_filter": OP4_SQL}
