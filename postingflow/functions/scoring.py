"""Weighted pattern rules compiled to columns.

A rule set is plan-time data. In a large set, all literals and the words that regex rules
need are found in one pass over the text (``literals``), and a regex rule is tried where its
word was found. In a small one, literal rules are grouped so that a rule is only tested when
a shorter rule contained in it has already matched ("graph theory" needs "graph"), and the
groups are walked by one higher-order expression over an array literal. Regex rules stay
literal ``rlike`` tests, so each pattern is compiled once, behind a cheap ``contains`` gate
where the pattern has a plain core.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postingflow.functions import literals, regex
from postingflow.functions.once import let
from postingflow.functions.regex import matches

SCALE = Decimal("0.001")


@dataclass(frozen=True)
class Rule:
    category: str
    ignore_case: bool
    pattern: str
    points: Decimal = Decimal(0)


@dataclass(frozen=True)
class RuleSet:
    """An immutable list of rules. Points are exact decimals with three places."""

    rules: tuple[Rule, ...]

    @staticmethod
    def of(rows) -> "RuleSet":
        """From (category, ignore_case, pattern[, points]) rows."""
        if isinstance(rows, RuleSet):
            return rows
        rules = tuple(
            Rule(r[0], bool(r[1]), r[2], Decimal(str(r[3])) if len(r) > 3 else Decimal(0))
            for r in rows
        )
        return RuleSet(rules)

    @staticmethod
    def from_nested(rules: dict, category: str = "") -> "RuleSet":
        """From nested ``{name: {..., "flags": n, "patterns": {pattern: points}}}`` dicts.

        ``patterns`` may also be a plain list (a taxonomy without points); ``flags`` is 0
        or ``re.IGNORECASE``, and lists below ``ignore_case``/``case_sensitive`` need none.
        """
        found = []
        for name, value in rules.items():
            label = category if name in ("ignore_case", "case_sensitive") else name
            if isinstance(value, (list, tuple)):
                found += [Rule(label, name == "ignore_case", p) for p in value]
            elif isinstance(value, dict) and "patterns" in value:
                ignore = bool(int(value.get("flags", 0)) & 2)
                found += [Rule(label, ignore, p, Decimal(str(v))) for p, v in value["patterns"].items()]
            elif isinstance(value, dict):
                found += RuleSet.from_nested(value, label).rules
        return RuleSet(tuple(found))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "RuleSet":
        """From a nested JSON file, or a parquet/JSON-lines table with the rule columns.

        A rule table is configuration, part of every plan: all of it is read to the driver.
        """
        if path.endswith(".json"):
            text = spark.read.text(path, wholetext=True).first()[0]
            return RuleSet.from_nested(json.loads(text))
        reader = spark.read.parquet if path.endswith(".parquet") else spark.read.json
        table = reader(path).select("category", "ignore_case", "pattern", "points")
        return RuleSet.of([tuple(r) for r in table.collect()])

    def where(self, category: str) -> "RuleSet":
        return RuleSet(tuple(r for r in self.rules if r.category == category))

    def categories(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(r.category for r in self.rules))


def _mills(points: Decimal) -> int:
    scaled = points / SCALE
    if scaled != scaled.to_integral_value():
        raise ValueError(f"points {points} have more than three decimal places")
    return int(scaled)


def _grouped(literals: dict[str, int]) -> list[tuple[str, int, list[tuple[str, int]]]]:
    """(gate, points, members containing the gate), every literal in exactly one place."""
    roots: list[tuple[str, int, list]] = []
    for text in sorted(literals, key=len):
        home = next((g for g in roots if g[0] in text), None)
        if home is None:
            roots.append((text, literals[text], []))
        else:
            home[2].append((text, literals[text]))
    return roots


def _pair(text: str, points: int) -> Column:
    return F.struct(F.lit(text).alias("text"), F.lit(points).cast("bigint").alias("points"))


def _literal_score(text: Column, literals: dict[str, int]) -> Column:
    zero = F.lit(0).cast("bigint")
    groups = F.array(
        *[
            F.struct(
                F.lit(gate).alias("text"),
                F.lit(points).cast("bigint").alias("points"),
                (
                    F.array(*[_pair(*m) for m in members])
                    if members
                    else F.array().cast("array<struct<text:string,points:bigint>>")
                ).alias("members"),
            )
            for gate, points, members in _grouped(literals)
        ]
    )

    def member(total, m):
        return total + F.when(F.contains(text, m["text"]), m["points"]).otherwise(zero)

    def group(total, g):
        hit = g["points"] + F.aggregate(g["members"], zero, member)
        return total + F.when(F.contains(text, g["text"]), hit).otherwise(zero)

    return F.aggregate(groups, zero, group)


def _points_of(word: Column, points: dict[str, int]) -> Column:
    """A word's points, 0 if it has none; by its first character, then by the word."""
    groups: dict[str, dict[str, int]] = {}
    for text, value in sorted(points.items()):
        groups.setdefault(text[0], {})[text] = value
    table = F.create_map(*[
        c for first, group in groups.items()
        for c in (F.lit(first), F.create_map(*[x for t, v in group.items() for x in (F.lit(t), F.lit(v).cast("bigint"))]))
    ])
    found = F.try_element_at(F.try_element_at(table, F.substring(word, 1, 1)), word)
    return F.coalesce(found, F.lit(0).cast("bigint"))


def _needed(rule: Rule) -> tuple[str, ...]:
    """Words of which one occurs wherever the rule does, in the case that it is looked up in."""
    words = (rule.pattern,) if regex.is_literal(rule.pattern) else regex.required_words(rule.pattern)
    return tuple(w.lower() if rule.ignore_case else w for w in words)


def found_words(haystack: Column, rules, body) -> Column:
    """``body`` with a test ``found(words)``: whether one of the words that the rules need occurs.

    One pass finds them all where there are many; few are tested one by one.
    """
    words = {w for r in rules for w in _needed(r) if w}
    if len(words) < literals.MANY:
        def tested(some):
            hit = F.contains(haystack, F.lit(some[0]))
            for w in some[1:]:
                hit = hit | F.contains(haystack, F.lit(w))
            return hit

        return body(tested, None)

    def looked_up(hits):
        def tested(some):
            if "" in some:
                return F.lit(True)
            if len(some) == 1:
                return F.array_contains(hits, F.lit(some[0]))
            return F.arrays_overlap(hits, F.array(*map(F.lit, some)))

        return body(tested, hits)

    return let(literals.literals_in(haystack, words), looked_up)


def _rule_hit(text: Column, lowered: Column, rule: Rule, found) -> Column:
    """Whether one rule's pattern occurs, with the words that it needs looked up."""
    words = _needed(rule)
    if regex.is_literal(rule.pattern):
        return found(words)
    test = regex.matches_lowered(text, lowered, rule.pattern) if rule.ignore_case else matches(text, rule.pattern)
    return found(words) & test if words else test


def balanced_sum(terms: list[Column]) -> Column:
    """Sum as a balanced tree: a left-deep chain of hundreds of terms overflows the planner."""
    while len(terms) > 1:
        terms = [
            terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i]
            for i in range(0, len(terms), 2)
        ]
    return terms[0]


def _case_mills(text: Column, lowered: Column, rules: list[Rule], ignore_case: bool) -> Column:
    """Points of the rules of one case."""
    zero = F.lit(0).cast("bigint")
    haystack = lowered if ignore_case else text
    words: dict[str, int] = {}
    patterns = []
    for rule in rules:
        if regex.is_literal(rule.pattern):
            word = _needed(rule)[0]
            words[word] = words.get(word, 0) + _mills(rule.points)
        else:
            patterns.append(rule)

    def body(found, hits):
        if hits is None:
            terms = [_literal_score(haystack, words)] if words else []
        else:
            # The empty literal is in every text.
            looked = {w: p for w, p in words.items() if w}
            terms = [F.lit(words[""]).cast("bigint")] if "" in words else []
            if looked:
                terms.append(F.aggregate(hits, zero, lambda total, w: total + _points_of(w, looked)))
        terms += [
            F.when(_rule_hit(text, lowered, r, found), F.lit(_mills(r.points)).cast("bigint")).otherwise(zero) for r in patterns
        ]
        return balanced_sum(terms)

    return found_words(haystack, rules, body)


def score_mills(text: Column, rules) -> Column:
    """Sum of points (in thousandths) of every pattern that occurs at least once."""
    ruleset = RuleSet.of(rules)
    by_case = {case: [r for r in ruleset.rules if r.ignore_case is case] for case in (True, False)}
    text = F.coalesce(text, F.lit(""))

    def body(lowered):
        terms = [_case_mills(text, lowered, some, case) for case, some in by_case.items() if some]
        return balanced_sum(terms) if terms else F.lit(0).cast("bigint")

    return let(F.lower(text), body)


def score(text: Column, rules) -> Column:
    """Points of a text as an exact decimal."""
    return (score_mills(text, rules) * F.lit(SCALE)).cast("decimal(15,3)")


def deduction(text: Column, patterns, points: Decimal) -> Column:
    """``points`` once if any pattern occurs (say, a list of unwanted companies)."""
    text = F.coalesce(text, F.lit(""))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | matches(text, p, ignore_case=True)
    return F.when(hit, F.lit(points)).otherwise(F.lit(Decimal(0)))


def tag_categories(text: Column, taxonomy) -> Column:
    """The categories with at least one matching pattern, in taxonomy order."""
    ruleset = RuleSet.of(taxonomy)
    text = F.coalesce(text, F.lit(""))

    def body(lowered):
        def tagged(loose, exact):
            tags = []
            for category in ruleset.categories():
                own = ruleset.where(category).rules
                hit = None
                for case, found in ((True, loose), (False, exact)):
                    # All literals of a category are one look-up.
                    plain = tuple(_needed(r)[0] for r in own if r.ignore_case is case and regex.is_literal(r.pattern))
                    tests = [found(plain)] if plain else []
                    tests += [
                        _rule_hit(text, lowered, r, found)
                        for r in own if r.ignore_case is case and not regex.is_literal(r.pattern)
                    ]
                    for t in tests:
                        hit = t if hit is None else hit | t
                tags.append(F.when(hit, F.lit(category)))
            return F.array_compact(F.array(*tags))

        loose = [r for r in ruleset.rules if r.ignore_case]
        exact = [r for r in ruleset.rules if not r.ignore_case]
        return found_words(lowered, loose, lambda a, _: found_words(text, exact, lambda b, _: tagged(a, b)))

    return let(F.lower(text), body)


def rules_frame(spark: SparkSession, rules) -> DataFrame:
    """The rule set as a table."""
    return spark.createDataFrame(
        [(r.category, r.ignore_case, r.pattern, r.points) for r in RuleSet.of(rules).rules],
        "category string, ignore_case boolean, pattern string, points decimal(6,3)",
    )
