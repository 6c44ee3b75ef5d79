"""Exclusion rules: text lines turned into one boolean column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules in force when none are given.
DEFAULT_RULES = (
    "node_modules", ".git", "old", "旧", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".tox", ".venv", "venv", "env", "dist", "build", "coverage", ".next",
    ".turbo", ".parcel-cache",
)


def rule_path(rule: str) -> str | None:
    """The path a rule names, or None when it is a plain name."""
    text = rule.strip().replace("\\", "/")
    if "/" not in text:
        return None
    return text.rstrip("/") if len(text) > 1 else text


def rule_key(rule: str) -> str:
    """Identity of a rule: paths keep their case, names do not."""
    return rule if rule_path(rule) is not None else rule.lower()


def parse_rules(text: str | None) -> list[str]:
    lines = (line.strip() for line in (text or "").splitlines())
    return merge_rules(line for line in lines if line)


def merge_rules(*groups: Iterable[str]) -> list[str]:
    """Union in order of first appearance, by rule identity."""
    first: dict[str, str] = {}
    for group in groups:
        for rule in group if not isinstance(group, str) else [group]:
            first.setdefault(rule_key(rule), rule)
    return list(first.values())


def _is_rooted(path: str) -> bool:
    return path.startswith("/") or (len(path) >= 3 and path[1:3] == ":/")


def excluded_by_path(path: Column, rules: Iterable[str]) -> Column:
    """True where a path rule names the path or something above it."""
    slashed = F.translate(path, "\\", "/")
    padded = F.concat(F.lit("/"), slashed, F.lit("/"))
    tests = []
    for rule in filter(None, map(rule_path, rules)):
        if rule.endswith("/."):
            tests.append(slashed.startswith(rule))
            if not _is_rooted(rule):
                tests.append(slashed.contains("/" + rule))
        elif _is_rooted(rule):
            tests += [slashed == rule, slashed.startswith(rule + "/")]
        else:
            tests.append(padded.contains("/" + rule + "/"))
    return _any(tests) & slashed.contains("/") if tests else F.lit(False)


def excluded_by_name(path: Column, rules: Iterable[str]) -> Column:
    """True where a name rule equals a path part or a token of it, or (for
    names with non-ASCII letters) is contained in one."""
    names = sorted({r.lower() for r in rules if rule_path(r) is None})
    if not names:
        return F.lit(False)
    lowered = F.lower(F.translate(path, "\\", "/"))
    parts = F.split(lowered, "/")
    bare = F.transform(parts, lambda p: F.ltrim(p, F.lit(".")))
    tokens = F.regexp_extract_all(lowered, F.lit("([a-z0-9]+)"), F.lit(1))
    listed = F.array(*[F.lit(n) for n in names])
    tests = [F.arrays_overlap(F.concat(parts, bare, tokens), listed)]
    tests += [lowered.contains(n) for n in names if not n.isascii()]
    return _any(tests)


def excluded(path: Column, rules: Iterable[str]) -> Column:
    rules = list(rules)
    return excluded_by_path(path, rules) | excluded_by_name(path, rules)


def excluded_url(url: Column, rules: Iterable[str]) -> Column:
    lowered = F.lower(url)
    return _any([lowered.contains(r.lower()) for r in rules])


def excluded_result(path: Column, rules: Iterable[str], root: str = "") -> Column:
    """Rule test of search results: URLs by substring, files relative to the root."""
    rules = list(rules)
    if not rules:
        return F.lit(False)
    prefix = root if root.endswith("/") else root + "/"
    relative = (
        F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
        if root
        else path
    )
    is_url = path.startswith("http://") | path.startswith("https://")
    if root.startswith(("http://", "https://")):
        is_url = F.lit(True)
    return F.when(is_url, excluded_url(path, rules)).otherwise(excluded(relative, rules))


def _any(tests: list[Column]) -> Column:
    result = F.lit(False)
    for test in tests:
        result = result | test
    return result
