"""URL filter: host and path rules, then the ratio of two character language models.

Built-in functions only.  Urls that an allow rule decides train one Markov model, those that a block
rule decides the other.  Contexts have up to two characters; the model's order varies with what a context
has seen: Witten-Bell smoothing leans on the shorter context by the number of distinct characters the
longer one was followed by.  The alphabet has ``SIZE`` symbols (lower-case letters, digits as one,
punctuation, start, end, any other), so a model is at most ``SIZE**3`` numbers whatever the input; both are
folded into one array of log ratios that every task gets as a constant, and scoring moves no rows.

A url's score is the sum of its characters' log ratios over their number.  The threshold is where normal
curves fitted to the scores of the two training classes have equal error rates.

Defined results: NULL urls, and urls without ``://``, have empty host and path and an empty string as the
model's text.  If one class has no training url, urls without a rule are allowed.  Repeated rows are
judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: Symbols 1 to 37 in this order; 0 is any other character.  Digits are written as 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_?=&#%:"
START, END, SIZE = 38, 39, 40
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def model_text(url: Column) -> Column:
    """What the models read: the url behind ``://``, letters in lower case, digits as 0."""
    rest = F.coalesce(F.regexp_extract(url, "(?s)://(.*)", 1), F.lit(""))
    return F.translate(rest, _UPPER + "123456789", _LOWER + "0" * 9)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, given (the rule's verdict) and text of every row."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                     model_text(F.col("url")).alias("text"))
    rule, given = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The longest rule is asked last, so that it stands outermost.
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        given = F.when(fits, F.lit(verdict)).otherwise(given)
    return p.select("page_id", "host", "path", rule.alias("rule"), given.alias("given"), "text")


def symbols(text: Column) -> Column:
    """Array of symbol numbers with two starts before and one end behind."""
    chars = F.filter(F.split(text, "", -1), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c))
    return F.concat(F.array(F.lit(START), F.lit(START)), codes, F.array(F.lit(END)))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trigrams(text: Column) -> Column:
    """Array of the numbers of a text's three-symbol runs, one for each symbol from the first on."""
    return _let(symbols(text), lambda s: F.transform(
        F.sequence(F.lit(2), F.size(s) - 1),
        lambda i: (F.get(s, i - 2) * SIZE + F.get(s, i - 1)) * SIZE + F.get(s, i),
    ))


def log_ratios(ruled: DataFrame) -> DataFrame:
    """One row: ``d``, the log ratio (allow over block) of each of the ``SIZE**3`` runs, and ``both``,
    whether both classes had training urls."""
    seen = (
        ruled.where("given is not null").select("given", F.explode(trigrams(F.col("text"))).alias("run"))
        .groupBy("run").agg(
            F.sum(F.when(F.col("given") == "allow", 1).otherwise(0)).alias("allow"),
            F.sum(F.when(F.col("given") == "block", 1).otherwise(0)).alias("block"),
        )
    )
    spark = ruled.sparkSession
    grid = spark.range(0, SIZE**3, 1, 1).select(
        F.col("id").alias("run"),
        F.floor(F.col("id") / SIZE**2).alias("a"), (F.floor(F.col("id") / SIZE) % SIZE).alias("b"), (F.col("id") % SIZE).alias("c"),
    )
    n = grid.join(seen, "run", "left").fillna(0, ["allow", "block"])
    two = n.groupBy("b", "c").agg(F.sum("allow").alias("allow2"), F.sum("block").alias("block2"))
    one = two.groupBy("c").agg(F.sum("allow2").alias("allow1"), F.sum("block2").alias("block1"))

    def positive(name: str) -> Column:
        return F.sum(F.when(F.col(name) > 0, 1).otherwise(0))

    # For each context: how often it was seen, and by how many distinct symbols it was followed.
    after_two = n.groupBy("a", "b").agg(
        *[f(k).alias(f"{k}_{v}2") for k in ("allow", "block") for v, f in (("n", F.sum), ("t", positive))])
    after_one = two.groupBy("b").agg(
        *[f(k + "2").alias(f"{k}_{v}1") for k in ("allow", "block") for v, f in (("n", F.sum), ("t", positive))])
    after_none = one.agg(
        *[f(k + "1").alias(f"{k}_{v}0") for k in ("allow", "block") for v, f in (("n", F.sum), ("t", positive))])
    none = after_none.select(F.struct("*").alias("z"))
    rows = n.join(two, ["b", "c"]).join(one, "c").join(after_two, ["a", "b"]).join(after_one, "b").withColumn("z", none.scalar())

    def log_p(k: str) -> Column:
        def mixed(count, seen_, kinds, shorter):
            return F.when(seen_ > 0, (count + kinds * shorter) / (seen_ + kinds)).otherwise(shorter)

        z = F.col("z")
        p = mixed(F.col(k + "1"), z[f"{k}_n0"], z[f"{k}_t0"] + 1, F.lit(1.0 / SIZE))
        for order in ("1", "2"):
            count = F.col(k + "2") if order == "1" else F.col(k)
            p = mixed(count, F.col(f"{k}_n{order}"), F.col(f"{k}_t{order}"), p)
        return F.log(p)

    return rows.select("run", (log_p("allow") - log_p("block")).alias("d"), "z").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("run", "d"))), lambda x: x["d"]).alias("d"),
        (F.coalesce(F.max(F.col("z")["allow_n0"]), F.lit(0)) * F.coalesce(F.max(F.col("z")["block_n0"]), F.lit(0)) > 0).alias("both"),
    )


def with_scores(ruled: DataFrame, ratios: DataFrame) -> DataFrame:
    """``ruled`` with ``score``: the mean log ratio of a url's symbols."""
    runs = ruled.withColumn("_m", ratios.select(F.struct("d", "both")).scalar()).withColumn("_r", trigrams(F.col("text")))
    total = _let(F.col("_m")["d"], lambda d: F.aggregate("_r", F.lit(0.0), lambda a, r: a + F.get(d, r)))
    return runs.withColumn("score", total / F.size("_r")).withColumn("_both", F.col("_m")["both"]).drop("_m", "_r")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold of every row."""
    ruled = with_rules(pages, rules)
    scored = with_scores(ruled, log_ratios(ruled))
    of = lambda f, v: f(F.when(F.col("given") == v, F.col("score")))
    curves = scored.where("given is not null").agg(
        of(F.avg, "allow").alias("ma"), of(F.stddev_pop, "allow").alias("sa"),
        of(F.avg, "block").alias("mb"), of(F.stddev_pop, "block").alias("sb"),
    ).select(
        F.when(F.col("sa") + F.col("sb") > 0, (F.col("ma") * F.col("sb") + F.col("mb") * F.col("sa")) / (F.col("sa") + F.col("sb")))
        .otherwise((F.col("ma") + F.col("mb")) / 2).alias("t")
    )
    likely = F.when(~F.col("_both") | (F.col("score") >= F.col("threshold")), F.lit("allow")).otherwise(F.lit("block"))
    return scored.withColumn("threshold", curves.scalar()).select(
        "page_id", "host", "path", "rule", F.coalesce("given", likely).alias("verdict"),
    )


def _oracle() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for h, p, _ in ordered) + " END"
    given = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered) + " END"
    classes = " UNION ALL ".join(
        f"""SELECT '{k}' AS k, a, b, c,
               ln((n3 + t2 * p2) / (n2 + t2)) AS l3, ln(p2) AS l2, n2
        FROM (SELECT g.a, g.b, g.c, coalesce(x.n, 0) AS n3, coalesce(c2.n, 0) AS n2, coalesce(c2.t, 0) AS t2,
                     CASE WHEN coalesce(c1.n, 0) > 0 THEN (coalesce(y.n, 0) + c1.t * p1) / (c1.n + c1.t) ELSE p1 END AS p2
              FROM grid g
              LEFT JOIN (SELECT a, b, c, count(*) AS n FROM runs WHERE given = '{k}' GROUP BY ALL) x ON (x.a, x.b, x.c) = (g.a, g.b, g.c)
              LEFT JOIN (SELECT a, b, count(*) AS n, count(DISTINCT c) AS t FROM runs WHERE given = '{k}' GROUP BY ALL) c2 ON (c2.a, c2.b) = (g.a, g.b)
              LEFT JOIN (SELECT b, c, count(*) AS n FROM runs WHERE given = '{k}' GROUP BY ALL) y ON (y.b, y.c) = (g.b, g.c)
              LEFT JOIN (SELECT b, count(*) AS n, count(DISTINCT c) AS t FROM runs WHERE given = '{k}' GROUP BY ALL) c1 ON c1.b = g.b
              JOIN (SELECT s.c, CASE WHEN tot.n > 0 THEN (coalesce(o.n, 0) + (tot.t + 1) / {SIZE}.0) / (tot.n + tot.t + 1) ELSE 1 / {SIZE}.0 END AS p1
                    FROM (SELECT unnest(range({SIZE})) AS c) s
                    LEFT JOIN (SELECT c, count(*) AS n FROM runs WHERE given = '{k}' GROUP BY ALL) o ON o.c = s.c,
                    (SELECT count(*) AS n, count(DISTINCT c) AS t FROM runs WHERE given = '{k}') tot) u ON u.c = g.c)"""
        for k in ("allow", "block")
    )
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
             translate(coalesce(regexp_extract(url, '(?s)://(.*)', 1), ''), '{_UPPER}123456789', '{_LOWER}000000000') AS text
           FROM pages),
r AS (SELECT *, {rule} AS rule, {given} AS given FROM p),
s AS (SELECT page_id, given, [{START}, {START}] || list_transform(list_filter(string_split(text, ''), lambda x: x <> ''),
             lambda x: instr('{ALPHABET}', x)) || [{END}] AS s FROM r),
runs AS (SELECT page_id, given, s[i] AS a, s[i + 1] AS b, s[i + 2] AS c
         FROM (SELECT page_id, given, s, unnest(range(1, len(s) - 1)) AS i FROM s)),
grid AS (SELECT DISTINCT a, b, c FROM runs),
logs AS ({classes}),
d AS (SELECT a, b, c, max(l) FILTER (WHERE k = 'allow') - max(l) FILTER (WHERE k = 'block') AS d
      FROM (SELECT k, a, b, c, CASE WHEN n2 > 0 THEN l3 ELSE l2 END AS l FROM logs) GROUP BY ALL),
score AS (SELECT page_id, given, avg(d) AS score FROM runs JOIN d USING (a, b, c) GROUP BY ALL),
curve AS (SELECT avg(score) FILTER (WHERE given = 'allow') AS ma, stddev_pop(score) FILTER (WHERE given = 'allow') AS sa,
                 avg(score) FILTER (WHERE given = 'block') AS mb, stddev_pop(score) FILTER (WHERE given = 'block') AS sb FROM score)
SELECT page_id, host, path, rule,
       coalesce(r.given, CASE WHEN ma IS NULL OR mb IS NULL OR score >= CASE WHEN sa + sb > 0 THEN (ma * sb + mb * sa) / (sa + sb)
                         ELSE (ma + mb) / 2 END THEN 'allow' ELSE 'block' END) AS verdict
FROM r JOIN score USING (page_id), curve
"""


ORACLE = _oracle()
