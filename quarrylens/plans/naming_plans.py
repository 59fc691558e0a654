"""Names and dictionaries: part names and column names against a small dictionary of this engine's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import generate, masking, metadata, naming
from quarrylens.plans.metadata_plans import values
from quarrylens.session import TABLES, table

#: kind, abbreviation, word: some abbreviations in several dictionaries.
WORDS = [
    ("word", "ORDERKEY", "주문키"), ("word", "CUSTKEY", "고객키"), ("word", "NAME", "명"), ("org", "NAME", "이름"), ("user", "O", "주문"), ("word", "C", "고객"), ("word", "L", "주문상세"),
    ("word", "P", "부품"), ("word", "DATE", "일자"), ("org", "TEXT", "본문"), ("word", "TEXT", "글"), ("word", "ID", "식별자"), ("user", "DOC", "문서"), ("word", "N", "국가"), ("word", "URL", "주소"), ("word", "LABEL", "표지"),
]
TYPES = ["MY", "ONOMY", "GE", "ARGE", "O", "ALL", "ARD", "STEEL"]


def words(s):
    return s.createDataFrame(WORDS, "kind string, abbr string, word_ko string")


def columns(s, d):
    return metadata.columns_of(s, d, TABLES)


def column_values(s=None):
    """The names of all columns as SQL, from DuckDB's own catalog of the registered views."""
    return "SELECT table_name, column_name AS name FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"


W = values(WORDS, "kind, abbr, word_ko")
BEST = f"SELECT abbr AS token, arg_min(word_ko, CASE kind WHEN 'user' THEN 1 WHEN 'org' THEN 2 ELSE 3 END) AS word_ko, arg_min(kind, CASE kind WHEN 'user' THEN 1 WHEN 'org' THEN 2 ELSE 3 END) AS source FROM ({W}) GROUP BY 1"
PARTS = f"""SELECT name, pos, token, word_ko, source, lag(word_ko) OVER w AS before, row_number() OVER w AS k FROM (SELECT name, unnest(string_split(name, '_')) AS token, generate_subscripts(string_split(name, '_'), 1) AS pos
  FROM (SELECT DISTINCT upper(name) AS name FROM ({column_values()}))) LEFT JOIN ({BEST}) USING (token) WHERE token <> '' WINDOW w AS (PARTITION BY name ORDER BY pos)"""
LOGICAL = f"""SELECT name, string_agg(CASE WHEN word_ko IS NOT NULL THEN word_ko WHEN k > 1 AND before IS NULL THEN '_' || token ELSE token END, '' ORDER BY pos) AS logical,
  CASE WHEN count(word_ko) = 0 THEN 'none' WHEN count(word_ko) < count(*) THEN 'mix' WHEN count(DISTINCT source) > 1 THEN 'multi' ELSE min(source) END AS source,
  coalesce(string_agg(CASE WHEN word_ko IS NULL THEN token END, ',' ORDER BY pos), '') AS missing FROM ({PARTS}) GROUP BY 1"""

QUERIES = {
    "logical_names": (lambda s, d: naming.logical_names(columns(s, d), "name", words(s)), LOGICAL),
    "match_statistics": (lambda s, d: naming.match_statistics(naming.logical_names(columns(s, d), "name", words(s))), f"SELECT source, count(*) AS cnt FROM ({LOGICAL}) GROUP BY 1"),
    "token_rank": (
        lambda s, d: naming.missing_rank(columns(s, d), "name", words(s)),
        f"SELECT token, count(*) AS cnt FROM (SELECT unnest(string_split(upper(name), '_')) AS token FROM ({column_values()})) WHERE token <> '' AND token NOT IN (SELECT abbr FROM ({W})) GROUP BY 1",
    ),
    "longest_suffix_domain": (
        lambda s, d: naming.longest_suffix(table(s, d, "part"), "p_type", s.createDataFrame([(x,) for x in TYPES], "concept string")),
        f"SELECT lower(p_type) AS name, arg_max(lower(concept), length(concept)) AS concept FROM (SELECT DISTINCT p_type FROM part) JOIN ({values([(x,) for x in TYPES], 'concept')}) ON suffix(lower(p_type), lower(concept)) GROUP BY 1",
    ),
    "first_occurrence_terms": (
        lambda s, d: naming.standard_terms(table(s, d, "events").withColumn("n", F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.col("user_id") % 10)), "n", "event_id"),
        "WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || (user_id % 10) AS n FROM events) SELECT upper(n) AS term, arg_min(n, event_id) AS name, min(event_id) AS first_at, count(*) AS cnt FROM e GROUP BY 1",
    ),
    "first_rows": (
        lambda s, d: naming.first_by_name(table(s, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id"),
        "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
    ),
    "domain_rules": (
        lambda s, d: s.createDataFrame([("VARCHAR2", 20, 0), ("CHAR", 10, 0), ("NUMBER", 13, 2), ("DECIMAL", 5, 0), ("DATE", None, None)], "t string, n int, k int").select("t", naming.domain_rule(F.col("t"), F.col("n"), F.col("k")).alias("rule")),
        values([("VARCHAR2", "V20"), ("CHAR", "C10"), ("NUMBER", "N13,2"), ("DECIMAL", "N5"), ("DATE", None)], "t, rule"),
    ),
    "word_search": (
        lambda s, d: words(s).where(F.upper("abbr").contains("N") | F.col("word_ko").contains("N")).orderBy("kind", "abbr").limit(200),
        f"SELECT * FROM ({W}) WHERE contains(abbr, 'N') OR contains(word_ko, 'N') ORDER BY kind, abbr LIMIT 200",
    ),
    "relation_candidates": (
        lambda s, d: naming.relation_candidates(
            s.createDataFrame([("A", "A_ID", "INT", None), ("B", "A_ID", "INT", None), ("B", "B_ID", "INT", None), ("C", "A_ID", "TEXT", None), ("C", "B_ID", "INT", None)], "table_name string, name string, native_type string, length long"),
            s.createDataFrame([("A", "A_ID", "INT", None), ("B", "B_ID", "INT", None)], "table_name string, name string, native_type string, length long"),
        ),
        values([("B", "A", "A_ID"), ("C", "B", "B_ID")], 'child, parent, "column"'),
    ),
    "personal_columns": (
        lambda s, d: masking.detect(s.createDataFrame([("T", "USER_NM", None), ("T", "HP_NO", ""), ("T", "X", "고객 이메일"), ("T", "QTY", ""), ("T", "BIRTH_DT", None), ("T", "CARD_NO", "계좌 연결"), ("T", "MENU_NM", "메뉴이름"), ("T", "IP_ADDR", "접속 IP주소"), ("T", "ADBK_ID", "주소록 ID"), ("T", "TELNO_YN", "전화번호 여부"), ("T", "USER_ADDR", None), ("T", "ACNUTNO", None)], "table_name string, name string, comment string")),
        values([("T", "USER_NM", "name"), ("T", "HP_NO", "phone"), ("T", "X", "email"), ("T", "BIRTH_DT", "birth"), ("T", "CARD_NO", "account"), ("T", "USER_ADDR", "address"), ("T", "ACNUTNO", "account")], "table_name, name, kind"),
    ),
    "sample_rows": (
        lambda s, d: generate.sample_rows(s, table(s, d, "supplier").schema, 50),
        "SELECT CAST(i AS BIGINT) AS s_suppkey, 's_name_' || i AS s_name, CAST(i AS INTEGER) AS s_nationkey, i / 2 AS s_acctbal FROM range(1, 51) t(i)",
    ),
}
