"""Text columns: tokens, features, fingerprints, guards, gates (all JVM-side expressions)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import or_
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlens import fixed_values as V

_ASCII_WORD = "[A-Za-z0-9_]"
_BEFORE, _AFTER = f"(?<!{_ASCII_WORD})", f"(?!{_ASCII_WORD})"
_EDGE = f"(?:(?<={_ASCII_WORD})(?!{_ASCII_WORD})|(?<!{_ASCII_WORD})(?={_ASCII_WORD}))"


def jvm(pattern: str) -> str:
    """``\\b`` in Java looks at Unicode letters; the patterns here mean ASCII ones.

    In front of a word (start of a branch) or right behind one, a one-sided
    check says the same and is much cheaper than the general edge.  ``(?i)`` in
    Java folds ASCII only, so patterns with Cyrillic letters get ``(?iu)``.
    """
    pattern = re.sub(r"(^|\|(?=\\b[(A-Za-z])|\)(?=\\b\()|\((?!\?)(?=\\b))\\b(?=[(A-Za-z])", lambda m: m.group(1) + _BEFORE, pattern) \
        if not pattern.startswith("(?") else pattern[:pattern.index(")") + 1] + jvm(pattern[pattern.index(")") + 1:])
    pattern = re.sub(r"(?<=[A-Za-z)])(?<!\\[a-z])\\b(?=$|[|).\[\\])", lambda m: _AFTER, pattern)
    if pattern.startswith("(?i)") and re.search("[а-яё]", pattern):
        pattern = "(?iu)" + pattern[4:]  # case of letters beyond ASCII
    return pattern.replace(r"\b", _EDGE)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def needles(pattern: str, least: int = 3) -> list[str] | None:
    """Pieces of text one of which stands in whatever the pattern matches, lower case for ``(?i)``; none if it asks for nothing so plain.

    A search for bytes is many times cheaper than a pattern, and few texts hold a piece of any.
    """
    def best(items) -> list[str] | None:
        found, run = [], ""
        for op, value in [*items, (None, None)]:
            if op is sre.LITERAL and value < 128:
                run += chr(value)
                continue
            if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):  # take no characters
                continue
            found, run = [*found, [run]], ""
            if op is sre.BRANCH:
                found.append([n for alternative in value[1] for n in best(alternative) or [""]])
            elif op is sre.SUBPATTERN and not value[1] and not value[2]:
                found.append(best(value[3]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
                found.append(best(value[2]))
        found = [f for f in found if f and min(map(len, f)) >= least]
        return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=None)

    try:
        parsed = sre_parser.parse(pattern)
    except re.error:
        return None
    if parsed.state.flags & re.VERBOSE or jvm(pattern).startswith("(?iu)"):  # there "k" and "s" have mates beyond ASCII
        return None
    found = best(parsed)
    return [n.lower() for n in found] if found and folds_case(pattern) else found


def folds_case(pattern: str) -> bool:
    return bool(re.match(r"\(\?[a-z]*i", pattern))


def matches(text: Column, pattern: str) -> Column:
    hit, plain = text.rlike(jvm(pattern)), needles(pattern)
    if plain is None:
        return hit
    within = F.lower(text) if folds_case(pattern) else text
    return reduce(or_, [F.contains(within, F.lit(n)) for n in plain]) & hit


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    out = None
    for p in patterns:
        hit = matches(text, p)
        out = hit if out is None else out | hit
    return out


def first_match(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Name of the first rule that matches, else null; later rules are not tried."""
    out = None
    for name, pattern in rules:
        hit = matches(text, pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def literal_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def norm_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# --- tokens ------------------------------------------------------------------

def words(text: Column) -> Column:
    """Every lower-case word of the text, repeats kept; camelCase, snake_case, paths split."""
    spaced = F.regexp_replace(text, r"(\p{Lower})(\p{Upper})", "$1 $2")
    spaced = F.regexp_replace(spaced, r"\P{Alnum}+", " ")  # ASCII, as [^a-zA-Z0-9]+, which Java walks eight times slower
    return F.split(F.lower(F.trim(spaced)), " ")


def tokenize(text: Column, extra_stop: Sequence[str] = ()) -> Column:
    """Distinct words in first-seen order without stop words."""
    return F.array_except(words(text), literal_array([*V.STOP_WORDS, *[w.lower() for w in extra_stop], ""]))


def index_terms(text: Column) -> Column:
    """Terms of the full-text index: runs of letters and digits, lower case, repeats kept."""
    return F.array_remove(F.split(index_text(text), " "), "")


def index_text(text: Column) -> Column:
    """Terms of the full-text index with spaces between them."""
    return F.lower(F.regexp_replace(text, r"[\P{L}&&\P{N}]+", " "))  # as [^\p{L}\p{N}]+, which Java walks slower


def split_terms(text: Column, pattern: str, min_len: int, stop: Sequence[str] = ()) -> Column:
    """Distinct lower-case pieces between ``pattern`` of at least ``min_len`` characters."""
    pieces = F.filter(F.split(F.lower(text), pattern), lambda t: F.length(t) >= min_len)
    return F.array_except(pieces, literal_array([*stop, ""]))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Of two distinct-token arrays."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(both_empty)).otherwise(both / union)


# --- features and fingerprints --------------------------------------------------

def labelled_match(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Lower-case label of the first matching rule; ``$1`` stands for the captured word."""
    out = None
    for pattern, label in rules:
        hit = matches(text, pattern)
        if "$1" in label:
            value = F.concat(F.lit(label.replace("$1", "")), F.regexp_extract(text, jvm(pattern), 1))
        else:
            value = F.lit(label)
        out = F.when(hit, F.lower(value)) if out is None else out.when(hit, F.lower(value))
    return out


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def features(text: Column, path: Column, language: Column, framework: Column, error_type: Column,
             error_rules: Sequence[tuple[str, str]] = (), framework_rules: Sequence[tuple[str, str]] = (),
             extra_stop: Sequence[str] = ()) -> Column:
    """Struct of error type, code, language, framework, file extension and keywords."""
    code = F.regexp_extract(text, jvm(V.ERROR_CODE_PATTERN), 1)
    ext = extension(path)
    return F.struct(
        F.coalesce(F.lower(error_type), labelled_match(text, [*V.ERROR_TYPE_PATTERNS, *error_rules])).alias("error_type"),
        F.when(code != "", code).alias("error_code"),
        F.coalesce(F.lower(language), lookup(ext, V.LANGUAGE_BY_EXTENSION)).alias("language"),
        F.coalesce(F.lower(framework), labelled_match(text, [*V.FRAMEWORK_PATTERNS, *framework_rules])).alias("framework"),
        ext.alias("file_extension"),
        F.filter(tokenize(text, extra_stop), lambda t: F.length(t) > 2).alias("keywords"),
    )


def canonical(feat: Column, custom: Column | None = None) -> Column:
    """Features, then custom ``name:value`` parts, then sorted keywords, joined by a bar."""
    tag = lambda name, field: F.concat(F.lit(name), feat[field])
    # concat_ws leaves out nulls; no function of a lambda goes around the patterns, for Spark compiles nothing inside of it
    parts = [tag("err:", "error_type"), tag("code:", "error_code"), tag("lang:", "language"), tag("fw:", "framework")]
    if custom is not None:
        parts.append(F.transform(F.array_sort(F.map_entries(custom)), lambda e: F.concat_ws(":", e["key"], e["value"])))
    return F.concat_ws("|", *parts, F.sort_array(feat["keywords"]))


def fingerprint(feat: Column, custom: Column | None = None) -> Column:
    return F.sha2(canonical(feat, custom), 256)


def custom_features(text: Column, patterns: dict[str, str]) -> Column:
    """Map of named features; value = first capture group, or the whole match, lower case."""
    pairs: list[Column] = []
    for name, pattern in sorted(patterns.items()):
        p = jvm(pattern)
        value = F.when(text.rlike(p), F.lower(F.coalesce(
            F.nullif(F.regexp_extract(text, p, 1), F.lit("")) if "(" in pattern.replace("(?", "") else F.lit(None),
            F.nullif(F.regexp_extract(text, p, 0), F.lit("")))))
        pairs += [F.lit(name), value]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def block_keywords(situation: Column, language: Column, framework: Column, error_type: Column, apis: Column) -> Column:
    """Sorted distinct keywords of a block with its ``lang:/fw:/err:/api:`` tags."""
    free = split_terms(situation, r"[\W&&[^.]]+", 2, V.BLOCK_STOP_WORDS)
    tags = F.array(*[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(t), F.lower(c)))
                     for t, c in (("lang:", language), ("fw:", framework), ("err:", error_type))])
    api_tags = F.transform(F.coalesce(apis, F.array().cast("array<string>")), lambda a: F.concat(F.lit("api:"), F.lower(a)))
    return F.sort_array(F.array_distinct(F.concat(free, F.filter(tags, lambda t: t.isNotNull()), api_tags)))


def block_fingerprint(language: Column, framework: Column, error_type: Column, apis: Column, keywords: Column) -> Column:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    sorted_low = lambda a: F.array_join(F.array_sort(F.transform(a, lambda x: F.lower(x))), ",")
    text = F.concat_ws(
        "|", F.concat(F.lit("lang="), low(language)), F.concat(F.lit("fw="), low(framework)),
        F.concat(F.lit("err="), low(error_type)),
        F.concat(F.lit("api="), sorted_low(F.coalesce(apis, F.array().cast("array<string>")))),
        F.concat(F.lit("kw="), sorted_low(keywords)))
    return F.sha2(text, 256)


# --- guards and gates ------------------------------------------------------------

def leakage(text: Column, core: bool = True) -> Column:
    """Name of the first leakage rule, or null.  ``core=False`` leaves out the four block rules."""
    return first_match(text, [*V.LEAKAGE_CORE, *V.LEAKAGE_EXTENDED] if core else V.LEAKAGE_EXTENDED)


def prompt_injection(text: Column) -> Column:
    return first_match(text, V.PROMPT_INJECTION)


def package_rule(package: str | None) -> list[str]:
    """The rule for one package name followed by a version; none without a name."""
    return [] if package is None else [rf"(?i){re.escape(package)}@\d"]


def release_noise_rules(package: str | None = None) -> list[str]:
    return [*package_rule(package), *V.RELEASE_NOISE]


def capture_gate(situation: Column, mechanism: Column, unlock: Column, verification: Column,
                 package: str | None = None) -> Column:
    body = F.concat_ws("\n", situation, mechanism, unlock)
    return (F.when(matches_any(body, release_noise_rules(package)), F.lit("release-noise"))
            .when(matches(trim_ws(verification), V.TEMPLATE_VERIFY), F.lit("template-verify"))
            .otherwise(F.lit("accept")))


def prune_reason(situation: Column) -> Column:
    """Why a stored situation would be rejected today; null when it would be kept."""
    return (F.when(matches_any(situation, V.META_WRAP_LEADS), F.lit("meta-wrap-lead"))
            .when(matches_any(situation, V.PROJECT_MANAGEMENT_LEADS), F.lit("project-management-lead"))
            .when(~matches(situation, V.PROBLEM_SIGNAL), F.lit("no-problem-signal")))


def is_problem_shaped(text: Column) -> Column:
    return prune_reason(text).isNull()


def resolved_signal(text: Column) -> Column:
    flat = norm_space(text)
    return (F.length(flat) >= 40) & ~matches(flat, V.RESOLVED_NEGATIVE) & matches(flat, V.RESOLVED_POSITIVE)


def failure_class(text: Column, kind: Column) -> Column:
    return F.coalesce(first_match(text, V.FAILURE_CLASSES),
                      F.when(kind == "check_run", F.lit("ci-failure"))
                      .when(kind == "pull_request", F.lit("code-change")).otherwise(F.lit("general")))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)


def clamp_text(text: Column, limit: int) -> Column:
    """Cut at the last space inside the final 80 characters of the limit, else at the limit."""
    head = F.substring(text, 1, limit)
    back = F.locate(" ", F.reverse(head))
    space_at = F.length(head) - back
    return (F.when(F.length(text) <= limit, text)
            .when((back > 0) & (space_at > limit - 80), F.concat(F.substring(head, F.lit(1), space_at), F.lit("…")))
            .otherwise(F.concat(head, F.lit("…"))))


def strip_code(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)```.*?```", "")


# --- paths and scopes ----------------------------------------------------------------

def is_repo_relative(path: Column) -> Column:
    """Non-empty, at most 256 characters, not absolute, no drive or home prefix, no escape upward."""
    p = trim_ws(path)
    parts = F.split(p, "/")
    depth = F.aggregate(
        parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda acc, s: F.struct(
            (acc["d"] + F.when((s == "") | (s == "."), 0).when(s == "..", -1).otherwise(1)).alias("d"),
            F.least(acc["low"], acc["d"] + F.when(s == "..", -1).otherwise(0)).alias("low")))
    return ((F.length(p) > 0) & (F.length(p) <= 256) & ~p.rlike("^/|^~|^[A-Za-z]:[\\\\/]") & (depth["low"] >= 0))


def repo_relative(path: Column, base: str) -> Column:
    """Path relative to ``base`` or null when it cannot be proven to stay inside it."""
    p = trim_ws(path)
    root = base.rstrip("/") + "/"
    inside = F.expr("null").cast("string") if not base else F.when(p.startswith(root), F.substring(p, len(root) + 1, 1 << 20))
    rel = F.when(p.startswith("/"), inside).otherwise(p)
    tidy = F.regexp_replace(F.regexp_replace(rel, r"(^|/)(\./)+", "$1"), "/+", "/")
    return F.when(is_repo_relative(rel), tidy)


def expand_scope(scope: Column) -> Column:
    """``a.b/c`` -> [global, a.b/c, a, a.b]; only ``global`` for an empty or global scope."""
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(scope), F.lit(1))),
                    lambda i: F.substring(scope, i, F.lit(1)).isin(".", "/") & (i > 1))
    prefixes = F.transform(cuts, lambda i: F.substring(scope, F.lit(1), i - 1))
    own = F.array_distinct(F.concat(F.array(F.lit("global"), scope), prefixes))
    return F.when((F.coalesce(scope, F.lit("")) == "") | (scope == "global"), F.array(F.lit("global"))).otherwise(own)


def scope_specificity(scope: Column) -> Column:
    return F.when((F.coalesce(scope, F.lit("")) == "") | (scope == "global"), F.lit(0)).otherwise(
        1 + F.length(F.regexp_replace(scope, "[^./]", "")))
