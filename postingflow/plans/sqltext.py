"""SQL text for the twins of rule, keyword and salary queries."""

from __future__ import annotations

from postingflow import config
from postingflow.functions import regex

EDGE_LEFT = r"(^|[^\p{L}\p{N}_])"
EDGE_RIGHT = r"([^\p{L}\p{N}_]|$)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(words) -> str:
    return "[" + ", ".join(quote(w) for w in words) + "]"


def edges(pattern: str) -> str:
    """Unicode word edges for an engine whose ``\\b`` only knows ASCII."""
    if pattern.startswith(r"\b"):
        pattern = EDGE_LEFT + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + EDGE_RIGHT
    return pattern


def rule_test(column: str, ignore_case: bool, pattern: str) -> str:
    if regex.is_literal(pattern):
        if ignore_case:
            return f"contains(lower({column}), {quote(pattern.lower())})"
        return f"contains({column}, {quote(pattern)})"
    flags = ", 'i'" if ignore_case else ""
    return f"regexp_matches({column}, {quote(edges(pattern))}{flags})"


def rule_sum(column: str, rules) -> str:
    return "(" + " + ".join(
        f"CASE WHEN {rule_test(column, ic, p)} THEN {pts} ELSE 0 END" for _, ic, p, pts in rules
    ) + ")"


def contains_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(w)})" for w in words) + ")"


def location_match(column: str, terms) -> str:
    tests = " OR ".join(f"contains(lower(x), {quote(t.lower())})" for t in terms)
    return f"(len(list_filter({column}, lambda x: {tests})) > 0)"


def penalty(column: str, desired, secondary) -> str:
    return (
        f"CASE WHEN len({column}) = 0 OR {location_match(column, desired)} THEN 0 "
        f"WHEN {location_match(column, secondary)} THEN -1 ELSE -2 END"
    )


def salary_ctes(source: str, pay: str, out: str, factor: str = "12", thousands: str = ".", decimal: str = ",") -> str:
    """CTEs that read ``annual`` and ``monthly`` from the text expression ``pay``."""
    cents = ("\\." if decimal == "." else decimal) + "[0-9]{2}"

    def num(pattern):
        return f"TRY_CAST(regexp_extract(pl, '{pattern}', 1) AS BIGINT)"

    annual = contains_any("lo", config.ANNUAL_KEYWORDS)
    monthly = contains_any("lo", config.MONTHLY_KEYWORDS)
    return f"""{out}_low AS (SELECT *, lower({pay}) AS lo, replace(lower({pay}), '{thousands}', '') AS pl FROM {source}),
{out}_rung AS (SELECT *,
  CASE WHEN {annual} THEN nullif(coalesce({num('([0-9]{6})')}, {num('([0-9]{5})')}), 0) END AS y1,
  coalesce(nullif({num(f'([0-9]{{4}}){cents}')}, 0), CASE WHEN {monthly} THEN nullif({num('([0-9]{4})')}, 0) END) AS m1,
  nullif(coalesce({num(f'([0-9]{{6}}){cents}')}, {num(f'([0-9]{{5}}){cents}')}, {num('([0-9]{6})')}, {num('([0-9]{5})')}), 0) AS y2,
  nullif(coalesce({num(f'([0-9]{{4}}){cents}')}, {num('([0-9]{4})')}), 0) AS m2 FROM {out}_low),
{out}_pick AS (SELECT *,
  CASE WHEN y1 IS NOT NULL THEN y1 WHEN m1 IS NULL THEN y2 END AS yr,
  CASE WHEN y1 IS NOT NULL THEN NULL WHEN m1 IS NOT NULL THEN m1 WHEN y2 IS NULL THEN m2 END AS mo FROM {out}_rung),
{out} AS (SELECT *, coalesce(yr, mo * {factor}) AS annual, coalesce(mo, yr // {factor}) AS monthly FROM {out}_pick)"""


def section(column: str, patterns) -> str:
    """First pattern that matches, in order (patterns without lookahead only)."""
    options = [f"nullif(regexp_extract({column}, {quote(edges(p))}, 0, 'i'), '')" for p in patterns]
    return "coalesce(" + ", ".join(options) + ")"


def token_list(column: str) -> str:
    return rf"regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}_]+')"


def language(column: str) -> str:
    """``en``, ``de`` or NULL as an expression over a text column."""
    tokens = f"list_distinct({token_list(column)})"

    def side(words, hints):
        parts = [f"len(list_filter({tokens}, lambda w: list_contains({array(words)}, w)))"]
        for h in hints:
            if regex.is_literal(h):
                parts.append(f"CAST(contains(lower({column}), {quote(h)}) AS INT)")
            else:
                pattern = edges(h).replace(r"grade:" + EDGE_RIGHT, r"grade:[\p{L}\p{N}_]")
                parts.append(f"CAST(regexp_matches(lower({column}), {quote(pattern)}) AS INT)")
        return "(" + " + ".join(parts) + ")"

    en, de = side(config.ENGLISH_WORDS, config.ENGLISH_HINTS), side(config.GERMAN_WORDS, config.GERMAN_HINTS)
    return f"CASE WHEN {en} > {de} THEN 'en' WHEN {de} > {en} THEN 'de' END"


def keywords(column: str, ordered) -> str:
    """Tagged keywords as a list: exact ones first, then the rest, each once."""
    exact = [k for k in ordered if any(c.isupper() for c in k)]
    loose = list(dict.fromkeys(k for k in ordered if not any(c.isupper() for c in k)))
    loose = [k for k in loose if k not in exact]
    return (
        f"list_concat(list_filter({array(exact)}, lambda k: contains({column}, k)), "
        f"list_filter({array(loose)}, lambda k: contains(lower({column}), k)))"
    )


# Section patterns with a tempered gap, for an engine without lookahead:
# (number, what may not start between the number and the word, words).
TEMPERED = {
    2: (r"[0-9]{5}[.,][0-9]+", r"[0-9]{5}", "netto|brutto|gross"),
    3: (r"[0-9]{2}[.,][0-9]{3}[.,][0-9]+", r"[0-9]{2}[.,][0-9]{3}[.,]", "netto|brutto|gross"),
    4: (r"[0-9]{4}[.,][0-9]+", r"[0-9]{4}", "netto|brutto|gross"),
    5: (r"[0-9][.,][0-9]{3}[.,][0-9]+", r"[0-9][.,][0-9]{3}[.,]", "netto|brutto|gross"),
    6: (r"[0-9]{5}", r"[0-9]{5}", "netto|brutto|gross"),
    7: (r"[0-9]{2}[.,][0-9]{3}", r"[0-9]{2}[.,][0-9]{3}", "netto|brutto|gross"),
    8: (r"[0-9]{5}[.,][0-9]+", r"[0-9]{5}", "net|taxes|tax"),
    9: (r"[0-9]{4}[.,][0-9]+", r"[0-9]{4}", "net|taxes|tax"),
    10: (r"[0-9][.,][0-9]{3}", r"[0-9][.,][0-9]{3}", "netto|brutto|gross"),
    12: (r"[0-9]{5}", r"[0-9]{5}", "net|taxes|tax"),
}


def tempered_section(column: str, number: str, barred: str, words: str) -> str:
    """The section of one tempered pattern, found by trying every digit position.

    Lines are cut after each closing word; in the first piece with a valid start, the
    section runs from the leftmost number that no barred number follows to the piece's end.
    """
    mark = rf"'(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])', '\1\2' || chr(1) || '\3', 'g'"
    marked = f"regexp_replace(regexp_replace(line, {mark}), {mark})"
    starts = "list_filter(range(1, length(seg) + 1), lambda i: substr(seg, i, 1) BETWEEN '0' AND '9')"
    found = f"regexp_extract(substr(seg, i), '^{number}', 0)"
    valid = f"{found} <> '' AND NOT regexp_matches(substr(seg, i + length({found})), '{barred}')"
    best = f"(list_filter({starts}, lambda i: {valid}))[1]"
    pieces = (
        "flatten(list_transform(string_split(lower(" + column + "), chr(10)), "
        f"lambda line: string_split({marked}, chr(1))[:-2]))"
    )
    sections = f"list_transform({pieces}, lambda seg: substr(seg, {best}))"
    return f"(list_filter({sections}, lambda x: x IS NOT NULL))[1]"


def full_section(column: str) -> str:
    """The salary section over all patterns, lower-cased."""
    options = []
    for i, pattern in enumerate(config.SALARY_SECTION_PATTERNS):
        if i in TEMPERED:
            words = TEMPERED[i][2]
            section_ = tempered_section(column, *TEMPERED[i])
            options.append(f"CASE WHEN regexp_matches(lower({column}), '{words}') THEN {section_} END")
        else:
            body = pattern.lower()
            if body.startswith(r"\b("):
                body = EDGE_LEFT + "(" + body[2:].replace(r"\b", "", 1) + ")"
                options.append(f"nullif(regexp_extract(lower({column}), {quote(body)}, 2), '')")
            else:
                options.append(f"nullif(regexp_extract(lower({column}), {quote(body)}, 0), '')")
    return "coalesce(" + ", ".join(options) + ")"
