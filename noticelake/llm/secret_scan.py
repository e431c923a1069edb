"""Secret scans with DataFrame functions alone: a trigram index narrows the documents that each pattern is run on."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions.arrays import bound, running_sums
from noticelake.llm.common import cut, small_side

MOST_STRINGS = 128  # different strings that a part of a pattern is followed into; beyond it the part says nothing


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match of ``pattern`` counts if its group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# Fixed patterns: the first three give the base columns, the others add spans.
RULES = (
    Rule("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


# ---- from a pattern to trigrams -------------------------------------------------------------------

Either = frozenset[frozenset[str]]  # one of the sets must have all its trigrams in a text; ANYTHING: nothing is known
ANYTHING: Either = frozenset([frozenset()])


def _least(options) -> Either:
    """Without sets that hold another one: a text that has theirs has the other one's as well."""
    options = set(options)
    return frozenset(x for x in options if not any(y < x for y in options))


def _both(a: Either, b: Either) -> Either:
    if len(a) * len(b) > MOST_STRINGS:  # either one alone is still implied
        return min(a, b, key=len) if ANYTHING not in (a, b) else (b if a == ANYTHING else a)
    return _least(x | y for x in a for y in b)


def _trigrams(strings: frozenset[str]) -> Either:
    return _least(frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in strings)


def _chars(members) -> frozenset[str] | None:
    """The characters of a class, if they are few."""
    out: set[str] = set()
    for op, value in members:
        if op is kinds.LITERAL:
            out.add(chr(value))
        elif op is kinds.RANGE and value[1] - value[0] < MOST_STRINGS:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= MOST_STRINGS else None


def _part(op, value) -> tuple[frozenset[str] | None, Either]:
    """All strings that an element of a pattern can match, or None if they are many; and what a match of it must hold."""
    if op is kinds.LITERAL:
        return frozenset([chr(value)]), ANYTHING
    if op is kinds.IN:
        return _chars(value), ANYTHING
    if op in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
        return frozenset([""]), ANYTHING
    if op is kinds.SUBPATTERN:
        return _sequence(value[3])
    if op is kinds.ATOMIC_GROUP:
        return _sequence(value)
    if op is kinds.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        whole = [x for x, _ in parts]
        if None not in whole and len(frozenset().union(*whole)) <= MOST_STRINGS:
            return frozenset().union(*whole), ANYTHING
        return None, _least(o for x, q in parts for o in (_both(_trigrams(x), q) if x is not None else q))
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, holds = _sequence(inner)
        if strings is not None and most is not kinds.MAXREPEAT and most <= 4 and len(strings) ** int(most) <= MOST_STRINGS:
            times = [frozenset([""])]
            for _ in range(int(most)):
                times.append(frozenset(x + y for x in times[-1] for y in strings))
            return frozenset().union(*times[least:]), ANYTHING
        if least == 0:
            return None, ANYTHING
        return None, _both(_trigrams(strings), holds) if strings is not None else holds
    return None, ANYTHING


def _sequence(parts) -> tuple[frozenset[str] | None, Either]:
    run, holds, whole = frozenset([""]), ANYTHING, True
    for op, value in parts:
        strings, inner = _part(op, value)
        holds = _both(holds, inner)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = frozenset(x + y for x in run for y in strings)
            continue
        # neighbours are followed no further: what was gathered must be there, and a new run begins
        whole = False
        holds = _both(holds, _trigrams(run))
        run = strings if strings is not None else frozenset([""])
    return (run, holds) if whole else (None, _both(holds, _trigrams(run)))


def any_case(rule: Rule) -> bool:
    """Whether trigrams of the rule are looked for in lower-case text: some part of its pattern ignores case."""

    def folds(parts) -> bool:
        for op, value in parts:
            if op is kinds.SUBPATTERN and value[1] & re.IGNORECASE:
                return True
            inner = [value[3]] if op is kinds.SUBPATTERN else value[1] if op is kinds.BRANCH else [value[2]] if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) else []
            if any(folds(x) for x in inner):
                return True
        return False

    parsed = parser.parse(rule.pattern)
    return bool(parsed.state.flags & re.IGNORECASE) or folds(parsed)


def trigram_query(rule: Rule) -> list[list[str]] | None:
    """The rule's Boolean query, derived from its pattern: one of the lists must have all its trigrams in a text.
    None: the pattern has no mandatory trigram, every text must be read.

    Literals, small classes, alternatives, optional parts and short repetitions are followed as sets of strings; where
    these grow too many, the strings so far give their trigrams and a new run of characters begins."""
    strings, holds = _sequence(parser.parse(rule.pattern))
    if strings is not None:
        holds = _both(_trigrams(strings), holds)
    if any_case(rule):
        holds = _least(frozenset(t.lower() for t in x) for x in holds)
    return None if frozenset() in holds else sorted(sorted(x) for x in holds)


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, folded, doc_id, h): the texts that hold each trigram of the rules' queries, in any case if ``folded``."""
    asked = sorted({(t, any_case(r)) for r in rules for group in trigram_query(r) or [] for t in group})
    if not asked:
        return docs.select(F.lit("").alias("trigram"), F.lit(False).alias("folded"), "doc_id", F.xxhash64("text").alias("h")).limit(0)
    own = docs.select("doc_id", F.xxhash64("text").alias("h"), "text", F.lower("text").alias("low"))
    held = [F.when(F.contains("low" if folded else "text", F.lit(t)), F.struct(F.lit(t).alias("trigram"), F.lit(folded).alias("folded"))) for t, folded in asked]
    own = own.select("doc_id", "h", F.explode(F.filter(F.array(*held), lambda x: x.isNotNull())).alias("x"))
    return own.select("x.trigram", "x.folded", "doc_id", "h")


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, h, kinds): rules with a query whose trigrams a text holds, from intersections of postings."""
    index = postings(docs, rules).groupBy("doc_id", "h").agg(F.collect_set(F.concat(F.when(F.col("folded"), "i").otherwise("c"), F.col("trigram"))).alias("t"))

    def fits(rule: Rule) -> Column:
        key = "i" if any_case(rule) else "c"
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.array_contains("t", key + t) for t in group]) for group in trigram_query(rule)])

    fitting = [F.when(fits(r), F.lit(r.kind)) for r in rules if trigram_query(r) is not None]
    if not fitting:
        return index.select("doc_id", "h", F.array().cast("array<string>").alias("kinds")).limit(0)
    return index.select("doc_id", "h", F.filter(F.array(*fitting), lambda x: x.isNotNull()).alias("kinds")).filter(F.size("kinds") > 0)


def _spans(rule: Rule, place: int, text: Column) -> Column:
    """Spans of the rule, leftmost and not overlapping: structs (start, rank, end, kind, ok) in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    matches = F.zip_with(found, value, lambda f, v: F.struct(F.length(f).alias("n"), F.length(v).alias("v")))
    # text before each match; what follows the last one has no match beside it
    steps = F.zip_with(matches, F.split(text, rule.pattern, -1), lambda m, g: F.struct(F.length(g).alias("gap"), m["n"].alias("n"), m["v"].alias("v")))

    def placed(x: Column) -> Column:
        ends = running_sums(F.transform(x, lambda y: y["gap"] + y["n"]))
        return F.zip_with(x, ends, lambda y, end: F.struct((end - y["n"]).alias("start"), F.lit(place).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), (y["v"] >= rule.least).alias("ok")))

    return F.filter(bound(steps, placed), lambda x: x["ok"])


def _text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_<kind> of the first ``base`` rules, base_sha256, spans.

    Each rule's matches are leftmost and do not overlap within the rule. A span is kind:start:end in code points, end
    exclusive, ordered by start, then by the order of the rules. The trigrams of all queries are looked for in each
    text once, which gives postings; their intersections per text give the rules to run there. Rules without mandatory
    trigrams run on every text. Null and empty texts have no spans. Repeated rows and rows that share a doc_id are
    judged each by its own text. Other columns are ignored.
    """
    own = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = small_side(cut(candidates(own.filter("text is not null"), rules).select(F.struct("doc_id", "h").alias("key"), "kinds")), 100_000)
    rows = own.join(asked, F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("h")).eqNullSafe(F.col("key")), "left")
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,ok:boolean>>")
    cols = []
    for place, rule in enumerate(rules):
        wanted = F.col("text").rlike(rule.pattern)
        if trigram_query(rule) is not None:
            wanted = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) & wanted
        cols.append(F.when(wanted, _spans(rule, place, F.col("text"))).otherwise(empty).alias(f"_{place}"))
    rows = rows.select("doc_id", *cols)
    first = F.array_sort(F.concat(*[F.col(f"_{i}") for i in range(base)]))
    every = F.array_sort(F.concat(*[F.col(f"_{i}") for i in range(len(rules))]))
    counts = [F.size(f"_{i}").cast("long").alias(f"n_{rules[i].kind}") for i in range(base)]
    return rows.select("doc_id", *counts, F.sha2(_text(first), 256).alias("base_sha256"), _text(every).alias("spans"))
