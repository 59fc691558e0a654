"""Column profiling and masking over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions.dates import date_is_odd, date_normalise  # noqa: F401
from quarrylens.operators import masking, profile
from quarrylens.session import table

LETTERS = "'0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ','9999999999aaaaaaaaaaaaaaaaaaaaaaaaaaAAAAAAAAAAAAAAAAAAAAAAAAAA'"


def placeholders(spark, d):
    """props with placeholder values put in by key, so that null-like values exist."""
    k = F.col("event_id") % 7
    value = F.when(k == 0, F.lit(None)).when(k == 1, "N/A").when(k == 2, "-").when(k == 3, "  ").when(k == 4, "없음").otherwise(F.col("props"))
    return table(spark, d, "events").select(value.alias("v"))


PLACEHOLDERS = "SELECT CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN '-' WHEN 3 THEN '  ' WHEN 4 THEN '없음' ELSE props END AS v FROM events"


def mixed_dates(spark, d):
    """Order dates written in six shapes by key, two of them no dates."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy/MM/dd")).when(k == 2, F.date_format(day, "MMM dd yyyy HH:mm"))
        .when(k == 3, F.date_format(day, "yyyyMMddHHmmss")).when(k == 4, F.lit("20191399")).otherwise(F.lit("N/A"))
    )
    return table(spark, d, "orders").select(text.alias("d"))


MIXED = """SELECT CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%b %d %Y %H:%M')
  WHEN 3 THEN strftime(o_orderdate, '%Y%m%d%H%M%S') WHEN 4 THEN '20191399' ELSE 'N/A' END AS d FROM orders"""
NORMAL = f"""SELECT d AS value, CASE WHEN regexp_matches(d, '^[0-9]{{4}}-') THEN left(replace(d, '-', ''), 8) WHEN regexp_matches(d, '^[0-9]{{4}}/') THEN left(replace(d, '/', ''), 8)
  WHEN regexp_matches(d, '^[A-Za-z]') THEN strftime(try_strptime(nullif(regexp_extract(d, '^([A-Za-z]+ +[0-9]+ +[0-9]+)', 1), ''), '%b %d %Y'), '%Y%m%d')
  WHEN regexp_matches(d, '^[0-9]{{8}}') THEN left(d, 8) END AS norm_date FROM ({MIXED})"""


def mask_sql(c, h, t):
    right = f"right({c}, {t})" if t else "''"
    return f"CASE WHEN length({c}) <= {h + t} THEN repeat('*', length({c})) ELSE left({c}, {h}) || repeat('*', length({c}) - {h + t}) || {right} END"


def mask_customers(spark, d):
    return masking.masked(table(spark, d, "customer").select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit("@x.org")).alias("c_mail")), {"c_name": "card", "c_mail": "email"})


def mask_texts(spark, d):
    mail = F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._-]+@[A-Za-z0-9.-]+)"), F.lit(1)))
    return masking.masked(table(spark, d, "documents").select("doc_id", mail.alias("mail")), {"mail": "email"}).distinct()


QUERIES = {
    "format_profile": (
        lambda s, d: profile.format_profile(table(s, d, "customer"), "c_name"),
        f"SELECT translate(c_name, {LETTERS}) AS fmt, count(*) AS cnt, min(c_name) AS sample1, max(c_name) AS sample2 FROM customer GROUP BY 1",
    ),
    "format_profile_dates": (
        lambda s, d: profile.format_profile(mixed_dates(s, d), "d"),
        f"SELECT translate(d, {LETTERS}) AS fmt, count(*) AS cnt, min(d) AS sample1, max(d) AS sample2 FROM ({MIXED}) GROUP BY 1",
    ),
    "nullish_values": (
        lambda s, d: profile.null_like(placeholders(s, d), "v"),
        f"SELECT v AS value, count(*) AS cnt FROM ({PLACEHOLDERS}) WHERE v IS NULL OR trim(v) = '' OR trim(v) IN ('-', '.', '0', 'N/A', 'NA', 'NULL', '없음', '미상', '해당없음', '99999999', '99991231') GROUP BY v",
    ),
    "dirty_chars": (
        lambda s, d: profile.dirty_characters(table(s, d, "documents"), "text"),
        r"""SELECT count(*) FILTER (WHERE text <> trim(text)) AS untrimmed, count(*) FILTER (WHERE contains(text, '　')) AS full_width_space,
          count(*) FILTER (WHERE regexp_matches(text, '[\n\r\t]')) AS line_or_tab, count(*) FILTER (WHERE regexp_matches(text, '[^0-9]')) AS non_digit,
          count(*) FILTER (WHERE strlen(text) <> length(text)) AS multibyte FROM documents""",
    ),
    "code_distribution": (
        lambda s, d: profile.code_distribution(table(s, d, "orders"), "o_orderstatus"),
        "SELECT o_orderstatus AS code, count(*) AS cnt FROM orders GROUP BY 1",
    ),
    "orphan_codes": (
        lambda s, d: profile.orphan_codes(table(s, d, "lineitem"), "l_partkey", table(s, d, "part").where("p_size > 10"), "p_partkey"),
        "SELECT l_partkey AS code, count(*) AS cnt FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_size > 10 AND p.p_partkey = l.l_partkey) GROUP BY 1",
    ),
    "key_duplicates": (
        lambda s, d: profile.key_duplicates(table(s, d, "lineitem"), "l_orderkey", "l_linenumber"),
        "SELECT l_orderkey, l_linenumber, count(*) AS cnt FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    ),
    "null_key_count": (
        lambda s, d: profile.null_keys(table(s, d, "orders").withColumn("k", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey"))), "o_orderkey", "k"),
        "SELECT count(*) AS null_keys FROM orders WHERE o_orderkey % 11 = 0 OR o_custkey IS NULL OR o_orderkey IS NULL",
    ),
    "date_normalize": (lambda s, d: profile.dates(mixed_dates(s, d), "d"), NORMAL),
    "date_check": (
        lambda s, d: profile.odd_dates(mixed_dates(s, d), "d"),
        f"SELECT * FROM ({NORMAL}) WHERE norm_date IS NULL OR substr(norm_date, 5, 2) NOT BETWEEN '01' AND '12' OR substr(norm_date, 7, 2) NOT BETWEEN '01' AND '31'",
    ),
    "mask_customer": (
        mask_customers,
        f"SELECT c_custkey, {mask_sql('c_name', 6, 4)} AS c_name, {mask_sql('c_mktsegment', 2, 0)} || '@x.org' AS c_mail FROM customer",
    ),
    "mask_text": (
        mask_texts,
        f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9._-]+@[A-Za-z0-9.-]+)', 1)) AS mail FROM documents), p AS (SELECT doc_id, mail, split_part(mail, '@', 1) AS l FROM m)
        SELECT DISTINCT doc_id, {mask_sql('l', 2, 0)} || substr(mail, strpos(mail, '@')) AS mail FROM p""",
    ),
}
