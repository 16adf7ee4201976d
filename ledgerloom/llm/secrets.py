"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is parsed on the driver into a Boolean query over the
trigrams that any match must hold (of the text in lower case). The index has a posting
for each document and each trigram that some query asks for. Postings are intersected by
document, which gives candidates for each rule, and only those are verified with the
expression. A rule without mandatory trigrams is verified on every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` of which `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = f"""({_any_case("password|passwd|secret|token|api_?key")})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: A maximal run is shorter than the limit or is the match, so the limits of access and hex stand in their
#: expressions. A short match of assign is dropped only after it has taken its characters.
BASE_RULES = (Rule("assign", ASSIGN, 2, 6), Rule("access", "AKIA[A-Z0-9]{16,}"), Rule("hex", "[0-9a-f]{24,}"))
MORE_RULES = (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{16,}"),
)

#: Strings that are followed exactly through an expression.
EXACT = 64

ALL = True  # the query that every text answers


def _and(*queries):
    parts = {q for q in queries if q is not ALL}
    flat = frozenset(x for q in parts for x in (q[1] if isinstance(q, tuple) and q[0] == "and" else [q]))
    return ALL if not flat else next(iter(flat)) if len(flat) == 1 else ("and", flat)


def _or(*queries):
    if any(q is ALL for q in queries):
        return ALL
    flat = {x for q in queries for x in (q[1] if isinstance(q, tuple) and q[0] == "or" else [q])}
    terms = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in flat}
    flat = frozenset(q for q in flat if not any(terms[o] < terms[q] for o in flat))  # what another implies goes
    return next(iter(flat)) if len(flat) == 1 else ("or", flat)


def _holds(strings) -> object:
    """That a text holds one of the strings, said in trigrams that follow on each other: all
    of a short string, and as many of a longer one as cover it."""
    return _or(*(_and(*(s[i : i + 3] for i in ([*range(0, len(s) - 3, 3), len(s) - 3] if len(s) > 9 else range(len(s) - 2)))) for s in strings)) if strings else ALL


@dataclass
class _Part:
    """What is known of the matches of a part: all of them, or how they begin and end, and a query."""

    exact: frozenset | None
    heads: frozenset
    tails: frozenset
    query: object = ALL


_ANY = _Part(None, frozenset([""]), frozenset([""]))


def _exactly(strings) -> _Part:
    s = frozenset(strings)
    return _Part(s, s, s) if len(s) <= EXACT else _Part(None, frozenset([""]), frozenset([""]), _holds(s))


def _loose(p: _Part) -> _Part:
    """The same part, its exact strings given up for a query."""
    return p if p.exact is None else _Part(None, p.exact, p.exact, _and(p.query, _holds(p.exact)))


def _join(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= EXACT:
        return _exactly(x + y for x in a.exact for y in b.exact)
    x, y = _loose(a), _loose(b)
    over = frozenset(s + t for s in x.tails for t in y.heads) if len(x.tails) * len(y.heads) <= EXACT else frozenset()
    heads = frozenset(s + t for s in a.exact for t in b.heads) if a.exact is not None and len(a.exact) * len(b.heads) <= EXACT else x.heads
    tails = frozenset(s + t for s in a.tails for t in b.exact) if b.exact is not None and len(a.tails) * len(b.exact) <= EXACT else y.tails
    return _Part(None, heads, tails, _and(x.query, y.query, _holds(over)))


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts):
        return _exactly(s for p in parts for s in p.exact)
    loose = [_loose(p) for p in parts]
    heads, tails = (frozenset().union(*(getattr(p, k) for p in loose)) for k in ("heads", "tails"))
    bare = frozenset([""])
    return _Part(None, heads if len(heads) <= EXACT else bare, tails if len(tails) <= EXACT else bare, _or(*(p.query for p in loose)))


def _parts(tree) -> _Part:
    out = _exactly([""])
    for op, arg in tree:
        if op is sre.LITERAL:
            p = _exactly([chr(arg).lower()])
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < 8:
                    chars.update(chr(c).lower() for c in range(x[0], x[1] + 1))
                else:
                    chars = None
                    break
            p = _exactly(chars) if chars else _ANY
        elif op is sre.SUBPATTERN:
            p = _parts(arg[-1])
        elif op is sre.BRANCH:
            p = _either([_parts(x) for x in arg[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg[0], arg[1], _parts(arg[2])
            if least == 0:
                p = _exactly([*inner.exact, ""]) if most == 1 and inner.exact is not None else _ANY
            elif least == most == 1:
                p = inner
            else:
                p = _loose(inner)
        elif op is sre.AT:
            p = _exactly([""])
        else:
            p = _ANY
        out = _join(out, p)
    return out


def trigram_query(pattern: str):
    """ALL, a trigram, ("and", queries) or ("or", queries): what each match of pattern must hold."""
    return _loose(_parts(parser.parse(pattern))).query


def trigrams_of(query) -> set[str]:
    return set() if query is ALL else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def _answers(query, has) -> Column:
    if isinstance(query, str):
        return has(query)
    parts = [_answers(q, has) for q in sorted(query[1], key=str)]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def postings(docs: DataFrame, rules: tuple[Rule, ...], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: trigram, doc_id. It has the trigrams that the rules' queries ask for."""
    grams = sorted(set().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams))) if grams else F.array().cast("array<string>")
    return rows.select(F.explode(held).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, and the numbers of the rules whose queries its postings answer.

    Each posting becomes one bit, so that a document's postings are intersected by an
    aggregate that sums up each task's rows before the shuffle.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(trigrams_of, queries)))
    bits = [F.bit_or(F.when(F.col("trigram").isin(grams[at : at + 60]), F.call_function("shiftleft", F.lit(1).cast("long"), F.array_position(F.array(*map(F.lit, grams[at : at + 60])), F.col("trigram")).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"bits{at // 60}") for at in range(0, len(grams), 60)]
    has = lambda g: F.col(f"bits{grams.index(g) // 60}").bitwiseAND(F.lit(1 << (grams.index(g) % 60 + 1)).cast("long")) != 0
    found = F.array_compact(F.array(*(F.when(_answers(q, has), F.lit(i)) for i, q in enumerate(queries) if q is not ALL)))
    return index.groupBy("doc_id").agg(*bits).select("doc_id", found.alias("rules")).where(F.size("rules") > 0)


def _verified(text: Column, rule: Rule) -> Column:
    """Spans (start, end; code points) of the rule's matches in a text."""
    whole, bits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    rows = F.arrays_zip(bits.alias("gap"), whole.alias("whole"), kept.alias("kept"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + F.length(row["gap"])
        end = begin + F.coalesce(F.length(row["whole"]), F.lit(0))
        own = F.when(F.coalesce(F.length(row["kept"]), F.lit(0)) >= rule.least, F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], own).alias("spans"))

    return F.aggregate(rows, start, step, lambda acc: acc["spans"])


def _named(spans: Column, number: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _count(number: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind_no"] == number)).cast("long")


def mark_secrets(docs: DataFrame, into: str, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, whatever their names, and `into`: spans, an array of (start, kind_no,
    end, kind), sorted.

    Matches are leftmost and do not overlap within a kind; places are code points, the end
    exclusive; spans that begin at one place go in the order of the rules. Null and empty
    texts have no spans; very long ones are scanned whole. Ids of any type only find a row's
    candidate rules: rows of one id share them, which verifying makes right, and every rule is
    verified on rows with a null id. An empty table gives no rows. The candidates are written first, so
    that Spark knows their size: few are broadcast, more are joined by a shuffle on the id.
    """
    scratch = C.Scratch(docs.sparkSession, "secrets")
    found = candidates(postings(docs.where(F.col(id_col).isNotNull()), rules, id_col=id_col, text_col=text_col), rules)
    found = scratch.save(found.select(F.col("doc_id").alias("_found_id"), F.col("rules").alias("_rules")), "candidates")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names)), docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    joined = C.left_join(rows, found, "_id", "_found_id", "_text")
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = []
    for i, rule in enumerate(rules):
        ask = F.col("_text").rlike(rule.pattern)
        if trigram_query(rule.pattern) is not ALL:
            ask = (F.col("_id").isNull() | F.coalesce(F.array_contains("_rules", i), F.lit(False))) & ask
        own = F.when(ask, _verified(F.col("_text"), rule)).otherwise(none)
        spans.append(_named(own, i, rule.kind))
    return joined.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)), F.array_sort(F.concat(*spans)).alias(into))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id (as it is), text (null: empty) and spans; see mark_secrets. Extra
    columns are not read."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return mark_secrets(own, "spans", rules)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span replaced by mark; of spans that overlap, the part that is left."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(span["start"] - acc["at"], F.lit(0)))
        new = F.when(span["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), new.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op5_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(C.table(spark, sf_dir, "documents"))
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_RULES))
    counts = [_count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(F.encode(said(base), "utf-8"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def _sql_rule(i: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {i} AS k, '{rule.kind}' AS kind, CAST(coalesce(list_sum([length(x) for x in gaps[1:i]]), 0) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) AS BIGINT) AS s, length(ms[i]) AS n, length(ks[i]) AS g
FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, ms, regexp_extract_all(text, '{pattern}', {rule.group}) AS ks, unnest(range(1, len(ms) + 1)) AS i
      FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS ms FROM documents WHERE text IS NOT NULL)) WHERE length(ks[i]) >= {rule.least}"""


OP5_SQL = f"""
WITH m AS ({" UNION ALL ".join(_sql_rule(i, r) for i, r in enumerate(BASE_RULES + MORE_RULES))}),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))},
             string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (k < {len(BASE_RULES)}) AS base,
             string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans FROM m GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a USING (doc_id)
"""
