"""Operator 1, URL filters: rules, then the likelihood ratio of two character language models. DataFrame functions only.

Rules (host, path) decide first; the longest that fits wins. The urls that rules decide are the accepted and
rejected examples (others may be given) of two variable-order Markov models over a folded alphabet of SYMBOLS
signs: contexts of up to ORDER signs, each order smoothed with the next lower one by Witten-Bell interpolation. A
url's score is the sum of log P(accepted) - log P(rejected) over its signs, divided by their number; it is allowed
from the threshold on that lies equally many standard deviations from the mean scores of both kinds of examples.

Counting and scoring work on distinct urls with their multiplicity. What is scored is host and path, as in the rules:
query strings and fragments hold identifiers and tracking codes, about which the examples of one crawl say little of
the next; so urls that differ only there get one verdict. Scores are joined back to rows by the folded url in a plain
shuffled join, so a url of many rows is split by Spark's adaptive skew join. The table of n-grams has SYMBOLS ** (ORDER + 1) rows at most (about 1.3 million, two numbers each), however
large the input: that is the proven bound of the only broadcast.

Results for odd input: null, empty and malformed urls have empty host and path, no rule, and the score of the empty
string; without examples of both kinds all scores are 0 and every url without a rule is allowed; repeated rows and
null ids each give their row; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import scratch, table

#: Fixed rules of the query: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ORDER = 3
#: The folded alphabet: letters, "0" for every digit, "./-_", "~" for anything else, "^" before and "$" after a url.
ALPHABET = string.ascii_lowercase + "0./-_~^$"
SYMBOLS = len(ALPHABET)


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The rule string and verdict of the longest rule that fits; both null if none does."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    chain = lambda value: F.coalesce(*(F.when(fits(h, p), F.lit(value(v, h, p))) for v, h, p in ranked), F.lit(None).cast("string"))
    return chain(lambda v, h, p: h + p), chain(lambda v, h, p: v)


def folded(text: Column) -> Column:
    low = F.translate(text, string.ascii_uppercase + string.digits, string.ascii_lowercase + "0" * 10)
    return F.regexp_replace(low, r"(?s)[^a-z0./_-]", "~")


def ngrams(text: Column) -> Column:
    """All (ORDER + 1)-grams of a folded text with its marks, one for each sign and the end."""
    padded = F.concat(F.lit("^" * ORDER), text, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def log_ratios(grams: DataFrame) -> DataFrame:
    """gram, llr: log P(accepted) - log P(rejected) of each n-gram's last sign after its context. grams: gram, accepted, rejected (counts)."""
    out = grams.select("gram")
    out = out.withColumns({"p_accepted": F.lit(1.0 / SYMBOLS), "p_rejected": F.lit(1.0 / SYMBOLS)})
    for k in range(ORDER + 1):
        tail = F.substring("gram", ORDER + 1 - k, k + 1)
        seen = grams.groupBy(tail.alias("tail")).agg(F.sum("accepted").alias("c_accepted"), F.sum("rejected").alias("c_rejected"))
        sums = [f(kind) for kind in ("accepted", "rejected") for f in (lambda x: F.sum(f"c_{x}").alias(f"n_{x}"), lambda x: F.sum((F.col(f"c_{x}") > 0).cast("long")).alias(f"t_{x}"))]
        contexts = seen.groupBy(F.substring("tail", 1, k).alias("context")).agg(*sums)
        out = out.withColumn("tail", tail).withColumn("context", F.substring("gram", ORDER + 1 - k, k)).join(seen, "tail").join(contexts, "context")
        for kind in ("accepted", "rejected"):
            mixed = (F.col(f"c_{kind}") + F.col(f"t_{kind}") * F.col(f"p_{kind}")) / (F.col(f"n_{kind}") + F.col(f"t_{kind}"))
            out = out.withColumn(f"p_{kind}", F.when(F.col(f"n_{kind}") > 0, mixed).otherwise(F.col(f"p_{kind}")))
        out = out.select("gram", "p_accepted", "p_rejected")
    return out.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("llr"))


def url_filter(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, examples: DataFrame | None = None) -> DataFrame:
    """id, host, path, rule, verdict, score of every row. examples: host, path, accepted (boolean), besides the urls that rules decide."""
    spark = df.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, by_rule = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": by_rule, "text": folded(F.concat("host", "path"))})
    counted = lambda on: F.sum(on.cast("long"))
    texts = rows.groupBy("text").agg(F.coalesce(counted(F.col("by_rule") == "allow"), F.lit(0)).alias("accepted"), F.coalesce(counted(F.col("by_rule") == "block"), F.lit(0)).alias("rejected"))
    if examples is not None:
        more = examples.groupBy(folded(F.concat("host", "path")).alias("text")).agg(counted(F.col("accepted")).alias("accepted"), counted(~F.col("accepted")).alias("rejected"))
        texts = texts.union(more).groupBy("text").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    texts = scratch(spark, texts, "url-texts")
    signs = texts.select("text", "accepted", "rejected", F.explode(ngrams(F.col("text"))).alias("gram"))
    grams = scratch(spark, signs.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "url-grams")
    both = grams.agg(F.sum("accepted"), F.sum("rejected")).first()
    ratios = log_ratios(grams) if both[0] and both[1] else grams.select("gram", F.lit(0.0).alias("llr"))
    scored = signs.join(F.broadcast(ratios), "gram").groupBy("text").agg(F.avg("llr").alias("score"), F.first("accepted").alias("accepted"), F.first("rejected").alias("rejected"))
    scored = scratch(spark, scored, "url-scores")
    threshold = calibrate(scored)
    out = rows.join(scored.select("text", "score"), "text")
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.round("score", 9).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The score that lies equally many standard deviations from both kinds of examples; 0 without both."""
    stats = []
    for kind in ("accepted", "rejected"):
        n, s = F.sum(kind), F.sum(F.col(kind) * F.col("score"))
        mean = F.try_divide(s, n)
        spread = F.try_divide(F.sum(F.col(kind) * F.col("score") ** 2), n) - mean**2
        stats += [n, mean, F.sqrt(F.greatest(spread, F.lit(1e-12)))]
    n_a, mean_a, sd_a, n_r, mean_r, sd_r = scored.agg(*stats).first()
    return (mean_a * sd_r + mean_r * sd_a) / (sd_a + sd_r) if n_a and n_r else 0.0


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def _oracle_sql() -> str:
    """The same query for an engine that runs on one machine: rules, n-gram counts of all orders, smoothing, calibration."""
    up, low = string.ascii_uppercase, string.ascii_lowercase
    parts = lambda k: rf"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {k}), '')"
    fits = lambda h, p: f"((host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}'))"
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    chain = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(v, h, p)}'" for v, h, p in ranked) + " END"
    ctes = [
        f"h AS (SELECT page_id, translate({parts(1)}, '{up}', '{low}') AS host, {parts(2)} AS path FROM pages)",
        f"u AS (SELECT *, {chain(lambda v, h, p: h + p)} AS rule, {chain(lambda v, h, p: v)} AS by_rule, regexp_replace(translate(host || path, '{up}{string.digits}', '{low}{'0' * 10}'), '[^a-z0./_-]', '~', 'g') AS t FROM h)",
        "x AS (SELECT t, count(*) FILTER (WHERE by_rule = 'allow') AS a, count(*) FILTER (WHERE by_rule = 'block') AS r FROM u GROUP BY t)",
        f"s AS (SELECT t, a, r, unnest(list_transform(range(1, len(t) + 2), lambda i: substr('{'^' * ORDER}' || t || '$', i, {ORDER + 1}))) AS g FROM x)",
        "c AS (SELECT g, sum(a) AS a, sum(r) AS r FROM s GROUP BY g)",
        f"p0 AS (SELECT g, 1.0::DOUBLE / {SYMBOLS} AS pa, 1.0::DOUBLE / {SYMBOLS} AS pr FROM c)",
    ]
    for k in range(ORDER + 1):
        tail, context = f"substr(g, {ORDER + 1 - k}, {k + 1})", f"substr(g, {ORDER + 1 - k}, {k})"
        mixed = lambda x: f"CASE WHEN n{x} > 0 THEN (c{x} + t{x} * p{x}) / (n{x} + t{x}) ELSE p{x} END AS p{x}"
        ctes += [
            f"tail{k} AS (SELECT {tail} AS tail, sum(a)::DOUBLE AS ca, sum(r)::DOUBLE AS cr FROM c GROUP BY 1)",
            f"context{k} AS (SELECT substr(tail, 1, {k}) AS context, sum(ca) AS na, sum(cr) AS nr, (count(*) FILTER (WHERE ca > 0))::DOUBLE AS ta, (count(*) FILTER (WHERE cr > 0))::DOUBLE AS tr FROM tail{k} GROUP BY 1)",
            f"p{k + 1} AS (SELECT g, {mixed('a')}, {mixed('r')} FROM p{k} JOIN tail{k} ON tail = {tail} JOIN context{k} ON context = {context})",
        ]
    stats = ", ".join(f"sum({x} * score) / nullif(sum({x}), 0) AS m{x}, sqrt(greatest(sum({x} * score * score) / nullif(sum({x}), 0) - (sum({x} * score) / nullif(sum({x}), 0)) ** 2, 1e-12)) AS d{x}" for x in "ar")
    ctes += [
        "two AS (SELECT sum(a) > 0 AND sum(r) > 0 AS two FROM c)",
        f"z AS (SELECT t, any_value(a) AS a, any_value(r) AS r, avg(CASE WHEN two THEN ln(pa) - ln(pr) ELSE 0 END) AS score FROM s JOIN p{ORDER + 1} USING (g), two GROUP BY t)",
        f"k AS (SELECT coalesce((ma * dr + mr * da) / (da + dr), 0) AS least FROM (SELECT {stats} FROM z))",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN score >= least THEN 'allow' ELSE 'block' END) AS verdict, round(score, 9) AS score FROM u JOIN z USING (t), k"


ORACLE_SQL = _oracle_sql()
