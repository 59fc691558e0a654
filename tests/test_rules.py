"""Needed words of patterns: what a pattern matches always holds one of them."""

import re

import pytest

from quarrylens.operators import rule_catalog, scan


@pytest.mark.parametrize("pattern,want", [
    (r"\bdebugger\b", {"debugger"}), (r"(?i)\b(todo|FIXME)\b", {"todo", "fixme"}), (r"a*b?", None), (r"(abc)?x", {"x"}), (r"(?:ab|[0-9])z", {"z"}), (r"(ab|cd*)", {"ab", "c"}), (r"foo(?=bar)", {"foo"}), (r"(?!foo)[a-z]", None),
    (r"x{0,3}y{2}", {"y"}), (r"\p{L}+", None), (r"[a]bc", {"abc"}), (r"é", None), (r"(", None), ("", None),
])
def test_needed_words(pattern, want):
    assert scan.needed_words(pattern) == want


def test_matches_hold_a_needed_word():
    lines = ["// TODO later", "console.log(1)", 'String password = "secret1";', "http://localhost/x 10.1.2.3", "<td onclick=x>", 'getInstance("MD5")', "eval (x)", "900101-1234567", "<IMG src=a>", "log.info(password)", "TOKEN: abc", "a@b.co", "\tx"]
    rules = [*scan.RULES, *(r for group in rule_catalog.GROUPS.values() for r in group)]
    hits = 0
    for r in rules:
        words = scan.needed_words(r.pattern)
        try:
            found = [x for x in lines if re.search(r.pattern, x)]
        except re.error:
            continue
        hits += len(found)
        assert words is None or all(any(w in x.lower() for w in words) for x in found), r.id
    assert hits > 15
