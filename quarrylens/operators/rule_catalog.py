"""The catalogue of text rules by group, for the scans of scan.py. Ids and severities are fixed values; the patterns are this engine's own.

A rule with `without` reports a match only if that is not found within it (an <img> without alt). No pattern looks around,
so that the same text runs on Spark and on engines with linear-time expressions. Rules that need a syntax tree (java.*,
metric.* but duplicates, ext.*) are not here; mybatis rules on statements are those of sqltext.lint.
"""

from __future__ import annotations

from quarrylens.operators.scan import Rule

MARKUP, SCRIPT, SOURCE = ("*.jsp", "*.jspf", "*.html", "*.htm"), ("*.js", "*.jsx", "*.ts", "*.tsx"), ("*.java", "*.jsp", "*.jspf")
XML, PROPERTIES = ("*.xml",), ("*.properties", "*.yml", "*.yaml")
INPUT = r"request\s*\.\s*get(Parameter|Header|QueryString|Cookies)"
SECRET_NAME = r"(password|passwd|pwd|secret|api_?key|access_?key|private_?key|token)"
#: Text types of <input> that need a label of their own.
HIDDEN_INPUT = r"(type\s*=\s*[\"']?(hidden|submit|button|image|reset)|title\s*=|aria-label|\bid\s*=)"


def _of(group: str, globs: tuple[str, ...], *rules: tuple) -> tuple[Rule, ...]:
    """(name, severity, pattern[, without[, when]]) of one group."""
    return tuple(Rule(f"{group}.{name}", pattern, group, severity, more[1] if len(more) > 1 else "", more[0] if more else "", globs) for name, severity, pattern, *more in rules)


COMMON = (
    _of("common", MARKUP, ("debugger", "warn", r"\bdebugger\b"), ("consoleLog", "warn", r"\bconsole\.log\s*\("), ("alert", "info", r"(^|[^\w$.])alert\s*\("))
    + _of("common", SOURCE, ("sysout", "warn", r"\bSystem\s*\.\s*(out|err)\s*\.\s*print"), ("printStackTrace", "warn", r"\.\s*printStackTrace\s*\(\s*\)"))
    + _of(
        "common", SOURCE + SCRIPT + XML + PROPERTIES,
        ("todo", "info", r"(//|/\*|\*|#|<!--|<%--|--)\s*(TODO|FIXME|XXX)\b"),
        ("localhost", "warn", r"(https?|jdbc:\w+)://?(localhost|127\.0\.0\.1)\b"),
        ("devIp", "warn", r"\b(10\.[0-9]{1,3}|192\.168|172\.(1[6-9]|2[0-9]|3[01]))\.[0-9]{1,3}\.[0-9]{1,3}\b"),
        ("password", "error", rf"(?i)\b{SECRET_NAME}\s*[:=]\s*[\"']?[^\s\"'<>$#]{{4,}}"),
    )
)
JSP = _of("jsp", ("*.jsp", "*.jspf"), ("expression", "info", r"<%=[^%]*%>"), ("escapeXmlFalse", "warn", r"escapeXml\s*=\s*[\"']false[\"']"))
TSX = _of(
    "tsx", SCRIPT,
    ("debugger", "warn", r"^\s*debugger\s*;?"), ("console", "warn", r"\bconsole\.(log|debug|info|warn|error|trace)\s*\("), ("any", "info", r"[:<,]\s*any\b|\bas\s+any\b"),
    ("eslintDisable", "info", r"eslint-disable"), ("keyIndex", "info", r"\bkey=\{\s*(i|idx|index)\s*\}"), ("blankNoopener", "warn", r"<a\b[^>]*target\s*=\s*[\"'{]+_blank[^>]*>", r"\brel\s*="),
)
SECURITY = (
    _of("security", XML, ("sqlDollar", "error", r"\$\{[^}]*\}", "", r"<(mapper|sqlMap)\b"), ("cfgDebugLog", "info", r"(?i)(level\s*=\s*|<level\s+value\s*=\s*)[\"'](debug|trace)[\"']"))
    + _of("security", PROPERTIES, ("cfgDebugLogProps", "info", r"(?i)^\s*(log4j\.|logging\.)[\w.]*\s*[=:]\s*(debug|trace)\b"), ("cfgStackTrace", "warn", r"(?i)include-?stacktrace\s*[=:]\s*(always|on[-_]trace[-_]param)"))
    + _of(
        "security", SOURCE,
        ("sqlConcat", "error", r"(?i)\"\s*(select|insert|update|delete)\b[^\"]*\"\s*\+"),
        ("xssExpression", "warn", r"<%=\s*[^%]*(request|param)[^%]*%>"),
        ("xssEscapeXml", "warn", r"escapeXml\s*=\s*[\"']false[\"']"),
        ("pathTraversal", "error", rf"new\s+File(Input|Output)?(Stream|Reader|Writer)?\s*\([^;]*{INPUT}"),
        ("hardcodedPassword", "error", r"(?i)\b(password|passwd|pwd)\w*\s*=\s*\"[^\"]+\""),
        ("exceptionMessage", "warn", r"(print|println|write|append)\s*\(\s*\w+\.(getMessage|toString|getLocalizedMessage)\s*\(\s*\)"),
        ("osCommand", "error", r"Runtime\s*\.\s*getRuntime\s*\(\s*\)\s*\.\s*exec\s*\(|new\s+ProcessBuilder\s*\("),
        ("deserialization", "error", r"new\s+ObjectInputStream\s*\(|\bXMLDecoder\s*\("),
        ("codeInjection", "warn", r"\b(getEngineByName|parseExpression|evaluateExpression)\s*\("),
        ("ssrf", "warn", rf"new\s+(URL|URI|HttpGet|HttpPost)\s*\([^;]*{INPUT}"),
        ("openRedirect", "warn", rf"sendRedirect\s*\([^;]*{INPUT}"),
        ("responseSplitting", "warn", rf"(addHeader|setHeader|new\s+Cookie)\s*\([^;]*{INPUT}"),
        ("weakHash", "error", r"getInstance\s*\(\s*\"(MD2|MD4|MD5|SHA-?1)\""),
        ("weakCipher", "error", r"getInstance\s*\(\s*\"(DES|DESede|RC2|RC4|Blowfish|AES/ECB)[\"/]"),
        ("weakRandom", "info", r"\bMath\s*\.\s*random\s*\(|new\s+Random\s*\("),
        ("hardcodedKey", "error", r"new\s+SecretKeySpec\s*\(\s*\"[^\"]+\"|(?i)\b(secret|private|encryption)_?key\s*=\s*\"[^\"]+\""),
        ("fileUpload", "info", r"\bMultipartFile\b|\bgetPart\s*\(|\bFileItem\b"),
        ("piiLog", "warn", r"(?i)\blog(ger)?\.(trace|debug|info|warn|error)\s*\([^;]*(password|passwd|jumin|rrn|cardno|accountno|phone)"),
    )
    + _of(
        "security", MARKUP + SCRIPT,
        ("jsEval", "warn", r"(^|[^\w$.])(eval|Function)\s*\(|set(Timeout|Interval)\s*\(\s*[\"']"), ("domXss", "info", r"\.(innerHTML|outerHTML)\s*\+?=|document\.write(ln)?\s*\(|insertAdjacentHTML\s*\("),
        ("jsxDangerousHtml", "warn", r"dangerouslySetInnerHTML"), ("jsEnvSecret", "error", r"\b(REACT_APP|VITE|NEXT_PUBLIC)_\w*(SECRET|PASSWORD|PRIVATE|TOKEN)\w*"),
        ("jsTokenStorage", "warn", r"(?i)(local|session)Storage\.setItem\s*\([^,)]*(token|jwt|auth)"), ("jsHrefJavascript", "warn", r"(?i)href\s*=\s*[\"'{]*\s*javascript:"),
        ("jspElParam", "warn", r"\$\{\s*param(Values)?\."),
    )
    + _of(
        "security", ("*",),
        ("piiRrn", "error", r"\b[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])-[1-8][0-9]{6}\b"), ("piiCard", "warn", r"\b[3-6][0-9]{3}-[0-9]{4}-[0-9]{4}-[0-9]{4}\b"), ("piiPhone", "info", r"\b01[016789]-?[0-9]{3,4}-?[0-9]{4}\b"),
    )
)
A11Y = _of(
    "a11y", MARKUP,
    ("imgAlt", "warn", r"(?i)<img\b[^>]*>", r"(?i)\balt\s*="), ("inputLabel", "info", r"(?i)<input\b[^>]*>", rf"(?i){HIDDEN_INPUT}"),
    ("selectLabel", "info", r"(?i)<(select|textarea)\b[^>]*>", r"(?i)(title\s*=|aria-label|\bid\s*=)"), ("iframeTitle", "warn", r"(?i)<iframe\b[^>]*>", r"(?i)\btitle\s*="),
    ("htmlLang", "warn", r"(?i)<html\b[^>]*>", r"(?i)\blang\s*="), ("deprecatedTag", "info", r"(?i)<(font|center|marquee|blink|big|strike|tt|frameset)\b"),
    ("mouseOnly", "info", r"(?i)<(div|span|li|td|tr|p|img)\b[^>]*\bonclick\s*=[^>]*>", r"(?i)\bon(key(down|up|press)|focus)\s*="), ("nonStandardDom", "warn", r"document\.(all|layers)\b"),
    ("activeX", "warn", r"ActiveXObject|classid\s*=\s*[\"']clsid:"),
) + _of(
    "a11y", ("*.jsx", "*.tsx"),
    ("jsxImgAlt", "warn", r"<(img|Image)\b[^>]*>", r"\balt\s*="), ("jsxMouseOnly", "info", r"<(div|span|li|td|tr|p)\b[^>]*\bonClick\s*=[^>]*>", r"\b(onKey(Down|Up|Press)|role)\s*="),
    ("jsxAnchorHref", "info", r"<a\b[^>]*>", r"\b(href|to)\s*="), ("jsxIframeTitle", "warn", r"<iframe\b[^>]*>", r"\btitle\s*="),
)
MYBATIS = _of("mybatis", XML, ("dollar", "warn", r"\$\{[^}]*\}", "", r"<(mapper|sqlMap)\b"), ("selectStar", "info", r"(?i)\bselect\s+(\w+\.)?\*", "", r"<(mapper|sqlMap)\b"))

#: Absent rules: id, severity, what must be there first, what is then required somewhere.
ABSENT = (
    ("security.cfgErrorPage", "warn", r"<web-app\b", r"<error-page\b"), ("security.cfgSessionTimeout", "info", r"<web-app\b", r"<session-timeout\b"),
    ("security.cfgCookieHttpOnly", "warn", r"<web-app\b", r"<http-only>\s*true"), ("security.cfgCookieSecure", "info", r"<web-app\b", r"<secure>\s*true"),
    ("a11y.thScope", "info", r"<th([\s/>]|$)", r"\bscope\s*="), ("a11y.tableCaption", "warn", r"<th\b", r"<caption\b"), ("a11y.pageTitle", "warn", r"<html\b", r"<title\b"),
)
#: Tag rules, over line ends: id, severity, pattern, what the match must hold.
TAGS = (
    ("jsp.blankNoopener", "warn", r"(?i)<a\b[^>]*target\s*=\s*[\"']?_blank[^>]*>", r"(?i)\brel\s*="),
    ("a11y.jsxInputLabel", "info", r"<input\b[^>]*>", r"(type\s*=\s*[\"'{]*(hidden|submit|button|image|reset)|title\s*=|aria-label|\bid\s*=|\.\.\.)"),
)
#: Count rules: id, severity, pattern, most.
COUNTS = (("jsp.scriptlets", "info", r"<%[^@=!-]", 0),)

GROUPS = {"common": COMMON, "jsp": JSP, "tsx": TSX, "security": SECURITY, "a11y": A11Y, "mybatis": MYBATIS}
RULES = tuple(r for rules in GROUPS.values() for r in rules)
