"""Rule scans over text corpora: line rules, absent and count rules, card numbers, inline suppression, fingerprints.

A corpus is rows (path, text). Line rules explode a text's lines once and test all rules on each line in one
projection, so there is no join of lines with rules and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import excerpt


@dataclass(frozen=True)
class Rule:
    """A line rule: a finding at each line that the pattern is found in; `when` must be found in the whole text first, a
    match that holds `without` does not count, and only paths that fit one of the globs are scanned."""

    id: str
    pattern: str
    group: str = "common"
    severity: str = "warn"
    when: str = ""
    without: str = ""
    globs: tuple[str, ...] = ("*",)

    def fits(self, path: Column) -> Column:
        parts = [p.replace(".", r"\.").replace("*", ".*") for p in self.globs]
        return F.lit(True) if "*" in self.globs else F.lower(path).rlike(f"^({'|'.join(parts)})$")

    def hits(self, line: Column) -> Column:
        if not self.without:
            return line.rlike(self.pattern)
        return F.exists(F.regexp_extract_all(line, F.lit(self.pattern), F.lit(0)), lambda m: ~m.rlike(self.without))


def needed_words(pattern: str) -> frozenset[str] | None:
    """Texts in lower case of which at least one is in whatever a pattern matches, from its parse tree; None if it says nothing.

    Of a sequence the part with the longest texts counts; alternatives need one each; what may be absent says nothing."""
    try:
        tree = _parser.parse(pattern)
    except Exception:  # noqa: BLE001 a pattern that only Java knows has no words here
        return None

    def of(sequence) -> frozenset[str] | None:
        found, run = [], ""
        for op, value in [*sequence, (None, None)]:
            if op is _parser.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            if run:
                found.append(frozenset([run]))
                run = ""
            inner = None
            if op is _parser.SUBPATTERN:
                inner = of(value[3])
            elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT) and value[0] > 0:
                inner = of(value[2])
            elif op is _parser.BRANCH:
                arms = [of(arm) for arm in value[1]]
                inner = frozenset().union(*arms) if all(arms) else None
            if inner:
                found.append(inner)
        return max(found, key=lambda words: (min(map(len, words)), -len(words)), default=None)

    return of(tree)


#: Example rules that data files can trigger; the rule texts are this engine's own.
RULES = (
    Rule("todo", r"(?i)\b(todo|fixme|xxx)\b"),
    Rule("secret", r"(?i)(api[_-]?key|secret|token|passwd|password)\s*[:=]\s*\S+", "security", "high"),
    Rule("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "security", "warn"),
    Rule("ipAddress", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "security", "info"),
    Rule("tab", r"\t", "file", "info"),
    Rule("trailingSpace", r"[ \t]+$", "file", "info"),
    Rule("longLine", r"^.{900,}", "file", "info"),
    Rule("license", r"(?i)\b(license|copyright)\b", "common", "info"),
)

#: A marker is the first word after a comment sign; its rules are the list after white space, or all rules.
MARK = r"(?://|/\*|\*|#|<!--|<%--|--)[ \t]*tb-ignore(-next)?(?![\w-])(?:[ \t]+([A-Za-z][A-Za-z0-9_.,]*))?"
UNUSED = "common.unusedIgnore"


def lines(corpus: DataFrame) -> DataFrame:
    """path, line (from 1), content."""
    return corpus.select("path", F.posexplode(F.split("text", "\n")).alias("at", "content")).select("path", (F.col("at") + 1).alias("line"), "content")


def line_rules(corpus: DataFrame, rules=RULES) -> DataFrame:
    """path, line, rule, grp, severity, excerpt of every finding.

    A text is only tried for the rules of whose needed words it has one, then as a whole (^ and $ at line ends); only texts
    that are hit are cut into lines, and a line is only tried for the rules that hit its text."""

    def of_text(r: Rule) -> Column:
        words = needed_words(r.pattern)
        has = reduce(lambda a, b: a | b, [F.contains("low", F.lit(w)) for w in sorted(words)]) if words else F.lit(True)
        return r.fits(F.col("path")) & has & F.col("text").rlike(f"(?m){r.pattern}") & (F.col("text").rlike(r.when) if r.when else F.lit(True))

    hit = F.array_compact(F.array(*(F.when(of_text(r), r.id) for r in rules)))
    once = F.explode(F.array(F.struct("text", F.lower("text").alias("low")))).alias("t")  # a generator's output is made once, not for each use
    each = corpus.select("path", once).select("path", "t.text", "t.low").select("path", "text", hit.alias("open")).where(F.size("open") > 0).select("path", "open", F.posexplode(F.split("text", "\n")).alias("at", "content"))
    found = F.array_compact(
        F.array(*(F.when(F.array_contains("open", r.id) & r.hits(F.col("content")), F.struct(F.lit(r.id).alias("rule"), F.lit(r.group).alias("grp"), F.lit(r.severity).alias("severity"))) for r in rules))
    )
    return each.select("path", (F.col("at") + 1).alias("line"), F.explode(found).alias("f"), excerpt(F.col("content")).alias("excerpt")).select("path", "line", "f.rule", "f.grp", "f.severity", "excerpt")


def absent_rule(corpus: DataFrame, rule: str, when: str, required: str) -> DataFrame:
    """path, line, rule: a text where `when` is found and `required` is nowhere; at the first line with `when`. Expressions on the row, no grouping."""
    text = F.split("text", "\n")
    first = F.filter(F.transform(text, lambda x, i: F.when(x.rlike(when), i + 1)), lambda x: x.isNotNull())
    return corpus.where(F.col("text").rlike(when) & ~F.col("text").rlike(required)).select("path", F.get(first, F.lit(0)).alias("line"), F.lit(rule).alias("rule"))


def count_rule(corpus: DataFrame, rule: str, pattern: str, most: int) -> DataFrame:
    """path, line, rule, hits: texts with more than `most` matches, at the line of the first."""
    n = F.regexp_count("text", F.lit(pattern))
    first = F.array_position(F.transform(F.split("text", "\n"), lambda x: x.rlike(pattern)), True)
    return corpus.select("path", first.cast("int").alias("line"), F.lit(rule).alias("rule"), n.cast("long").alias("hits")).where(F.col("hits") > most)


def tag_rule(corpus: DataFrame, rule: str, pattern: str, without: str) -> DataFrame:
    """path, line, rule: matches of the pattern in a whole text, over line ends, that do not hold `without`; at the line where each begins."""
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    total = lambda texts: F.aggregate(texts, F.lit(0), lambda n, x: n + newlines(x))
    found = corpus.where(F.col("text").rlike(pattern)).select("path", F.split("text", pattern, -1).alias("between"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("matches"))
    hits = F.transform("matches", lambda m, i: F.when(~m.rlike(without), 1 + total(F.slice("between", 1, i + 1)) + total(F.slice("matches", 1, i))))
    return found.select("path", F.explode(F.array_compact(hits)).alias("line"), F.lit(rule).alias("rule"))


def unused_imports(corpus: DataFrame, rule: str = "tsx.unusedImport") -> DataFrame:
    """path, line, rule, name: names that a text imports (on one line, by default, in braces or as a whole) and that stand nowhere else in it."""
    line = corpus.select("path", "text", F.posexplode(F.split("text", "\n")).alias("at", "content")).where(F.col("content").rlike(r"^\s*import\b.*\bfrom\b"))
    whole = F.array(*(F.regexp_extract("content", p, 1) for p in (r"^\s*import\s+(?:type\s+)?([A-Za-z_$][\w$]*)\s*(?:,|from)", r"\*\s+as\s+([\w$]+)")))
    braced = F.transform(F.split(F.regexp_extract("content", r"\{([^}]*)\}", 1), ","), lambda x: F.element_at(F.split(F.trim(x), r"\s+"), -1))
    name = line.select("path", "text", (F.col("at") + 1).alias("line"), F.explode(F.filter(F.concat(whole, braced), lambda x: x != "")).alias("name"))
    code = F.regexp_replace("text", r"\bfrom\s*[\"'][^\"']*[\"']", "from")  # a module's own name is no use
    times = F.regexp_count(code, F.concat(F.lit(r"(?<![\w$])"), F.replace("name", F.lit("$"), F.lit(r"\$")), F.lit(r"(?![\w$])")))
    return name.where(times < 2).select("path", "line", F.lit(rule).alias("rule"), "name")


def card_numbers(corpus: DataFrame) -> DataFrame:
    """path, number: runs of sixteen digits from 3 to 6 on that pass the Luhn test."""
    runs = corpus.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\b([3-6][0-9]{15})\b"), F.lit(1))).alias("number"))
    return runs.where(F.expr("luhn_check(number)")).distinct()


def card_findings(corpus: DataFrame) -> DataFrame:
    """path, line, number, excerpt: every place of a card number, with its line of 160 characters at most in which all digits but the last four of the number are stars."""
    lines = corpus.where(F.col("text").rlike("[3-6][0-9]{15}")).select("path", F.posexplode(F.split("text", "\n")).alias("at", "content"))
    each = lines.select("path", (F.col("at") + 1).alias("line"), "content", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([3-6][0-9]{15})\b"), F.lit(1)))).alias("number"))
    hidden = F.replace("content", F.col("number"), F.concat(F.lit("*" * 12), F.right("number", F.lit(4))))
    return each.where(F.expr("luhn_check(number)")).select("path", "line", "number", F.substring(F.trim(hidden), 1, 160).alias("excerpt"))


def markers(corpus: DataFrame) -> DataFrame:
    """path, at, number, line, ids of every marker: where it stands, its number on that line, the line it is for (null after the last line) and its rules (none: all)."""
    text = F.split("text", "\n")
    last = F.size(text) - F.when(F.element_at(text, -1) == "", 1).otherwise(0)
    each = corpus.where(F.contains("text", F.lit("tb-ignore"))).select("path", last.alias("last"), F.posexplode(text).alias("k", "content"))
    found = F.arrays_zip(F.regexp_extract_all("content", F.lit(MARK), F.lit(1)).alias("next"), F.regexp_extract_all("content", F.lit(MARK), F.lit(2)).alias("ids"))
    each = each.select("path", "last", (F.col("k") + 1).alias("at"), F.posexplode(found).alias("number", "m"))
    line = F.when(F.col("m.next") == "", F.col("at")).when(F.col("at") < F.col("last"), F.col("at") + 1)
    return each.select("path", "at", "number", line.alias("line"), F.filter(F.split("m.ids", ","), lambda x: x != "").alias("ids"))


def suppressed(findings: DataFrame, corpus: DataFrame) -> DataFrame:
    """findings with `suppressed`: whether a marker for their line names their rule or none; findings of unused markers never are."""
    marks = markers(corpus).where("line is not null").groupBy("path", "line").agg(F.flatten(F.collect_set("ids")).alias("ids"), F.max(F.size("ids") == 0).alias("every"))
    hit = (F.col("every") | F.array_contains("ids", F.col("rule"))) & (F.col("rule") != UNUSED)
    return findings.join(marks, ["path", "line"], "left").withColumn("suppressed", F.coalesce(hit, F.lit(False))).drop("ids", "every")


def unused_markers(findings: DataFrame, corpus: DataFrame) -> DataFrame:
    """path, line, rule of the markers that suppress no finding, at the line where they stand."""
    marks = markers(corpus)
    rules = findings.where(F.col("rule") != UNUSED).groupBy("path", "line").agg(F.collect_set("rule").alias("rules"))
    used = marks.join(rules, ["path", "line"]).where((F.size("ids") == 0) | F.arrays_overlap("ids", "rules")).select("path", "at", "number")
    return marks.join(used, ["path", "at", "number"], "left_anti").select("path", F.col("at").alias("line"), F.lit(UNUSED).alias("rule"))


def fingerprint(rules=RULES) -> Column:
    """A hash of the rules' definitions."""
    return F.sha2(F.lit("\n".join("|".join((r.id, r.pattern, r.group, r.severity, r.when, r.without, ",".join(r.globs))) for r in sorted(rules, key=lambda r: r.id))), 256)
