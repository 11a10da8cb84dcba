"""Secret scan through a trigram inverted index, in Spark expressions only.

From each rule's pattern a Boolean query over trigrams is derived: every match
must hold one of some literal strings, hence all trigrams of one of them.  The
index lists, for each trigram the rules ask for, the documents whose lower-case
text holds it; postings are intersected by document and rules are verified only
on the documents their query leaves.  A pattern without a mandatory trigram has
no query and is scanned over all texts.

Defined results: a null text counts as empty and has no spans; rows that repeat
each get their spans; other columns are not read.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

_EITHER = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)


@dataclass(frozen=True)
class Rule:
    """``least`` is the number of characters that ``group`` needs."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules, then well-known public credential formats.
_NAMES = "|".join([*map(_EITHER, ("password", "passwd", "secret", "token")), _EITHER("api") + "_?" + _EITHER("key")])
BASE = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE
WIDEST = 256

Query = list[set[frozenset[str]]]


def _exact(items) -> set[str] | None:
    """All lower-case strings that the items match, if they are few."""
    out = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            step = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            step = {chr(c).lower() for _, c in arg}
        elif op is sre.SUBPATTERN:
            step = _exact(arg[3])
        elif op is sre.BRANCH:
            parts = [_exact(b) for b in arg[1]]
            step = None if None in parts else set().union(*parts)
        elif op is sre.MAX_REPEAT and arg[1] == 1:
            step = _exact(arg[2])
            step = step if step is None or arg[0] else step | {""}
        else:
            return None
        if step is None or len(out) * len(step) > WIDEST:
            return None
        out = {a + b for a in out for b in step}
    return out


def trigram_query(pattern: str) -> Query:
    """All clauses hold for a text with a match; a clause is a choice of sets
    of trigrams, one of which the text holds in full."""
    clauses: Query = []
    run = {""}

    def close():
        nonlocal run
        if min(map(len, run)) >= 3:
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append({s for s in sets if not any(t < s for t in sets)})
        run = {""}

    def walk(items):
        nonlocal run
        for item in items:
            step = _exact([item])
            if step is not None and len(run) * len(step) <= WIDEST:
                run = {a + b for a in run for b in step}
                continue
            close()
            op, arg = item
            if op is sre.SUBPATTERN:
                walk(arg[3])
                close()
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
                close()

    walk(sre_parse.parse(pattern))
    close()
    return clauses


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: ``trigram, doc_id, text_key``."""
    lower = F.lower("text")
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("_lower"), t))
    rows = docs.select("doc_id", "text_key", lower.alias("_lower"))
    return rows.select("doc_id", "text_key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Documents with the rules whose queries their postings satisfy."""
    held = F.col("held")
    all_of = lambda s: F.size(F.array_intersect(held, F.array(*map(F.lit, sorted(s))))) == len(s)

    def passes(query: Query) -> Column:
        out = F.lit(True)
        for clause in query:
            one = F.lit(False)
            for s in sorted(clause, key=sorted):
                one = one | all_of(s)
            out = out & one
        return out

    kinds = F.array_compact(F.array(*(F.when(passes(q), F.lit(k)) for k, q in queries.items())))
    return index.groupBy("doc_id", "text_key").agg(F.collect_set("trigram").alias("held")).select("doc_id", "text_key", kinds.alias("kinds")).where(F.size("kinds") > 0)


_SPANS = "array<struct<start:int,kind:int,end:int>>"


#: Matches whose spans are gathered in one array before those are joined.
RUN = 128


def _spans(rule: Rule, number: int) -> Column:
    """Spans of the leftmost matches that are long enough, in code points.

    Pieces between matches and the matches alternate, so running lengths are
    the places.  An array that grows is copied at each step; so spans grow in
    runs of ``RUN`` matches, and the array of runs is flattened at the end.
    """
    pattern, text = F.lit(rule.pattern), F.col("text")
    part = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("before"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
    )

    def step(acc, x):
        a = acc["at"] + F.length(x["before"])
        b = a + F.length(x["match"])
        found = F.array(F.struct(a.alias("start"), F.lit(number).alias("kind"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    def of_run(acc, run):
        one = F.aggregate(run, F.struct(acc["at"].alias("at"), F.array().cast(_SPANS).alias("out")), step)
        return let(one, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["runs"], F.array(r["out"])).alias("runs")))

    def of_text(matches):
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / RUN).cast("int")), lambda k: F.slice(matches, k * RUN + 1, RUN))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("runs"))
        return F.aggregate(runs, start, of_run, lambda acc: F.flatten(acc["runs"]))

    matches = F.filter(part, lambda x: x["match"].isNotNull())
    return F.when(text.rlike(rule.pattern), let(matches, of_text)).otherwise(F.array().cast(_SPANS))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans`` for every row; kinds number the rules."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    full = [(n, r) for n, r in enumerate(rules) if not queries[r.kind]]
    scanned = rows.select("doc_id", "text_key", F.concat(F.array().cast(_SPANS), *(_spans(r, n) for n, r in full)).alias("scanned"))
    if not indexed:
        return scanned.select("doc_id", F.array_sort("scanned").alias("spans"))
    trigrams = sorted({t for q in indexed.values() for clause in q for s in clause for t in s})
    found = cut(candidates(postings(rows, trigrams), indexed)).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "kinds")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
    held = rows.join(found, same).select("_doc", "_key", "text", "kinds")
    spans = [F.when(F.array_contains("kinds", r.kind), _spans(r, n)).otherwise(F.array().cast(_SPANS)) for n, r in enumerate(rules) if r.kind in indexed]
    verified = held.select("_doc", "_key", F.concat(*spans).alias("more")).where(F.size("more") > 0).dropDuplicates(["_doc", "_key"])
    out = scanned.join(verified, same, "left")
    return out.select("doc_id", F.array_sort(F.concat("scanned", F.coalesce("more", F.array().cast(_SPANS)))).alias("spans"))


def digests(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{rules[k].kind}")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *(count(k) for k in range(len(BASE))), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
