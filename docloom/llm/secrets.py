"""Secret scans over a trigram inverted index, in DataFrame operations alone.

Each rule's regular expression yields a Boolean trigram query: a disjunction of conjunctions of trigrams that every
match must hold. One pass over the texts posts the hash of a text under each trigram of the queries that it has; the
postings are gathered into lists by trigram and block of hashes, and the lists of a conjunction are intersected, the
shortest first. What comes out, a mask of rules by hash, is joined to the rows in a second pass, and only the rules of
the mask are searched with their expressions. A rule without mandatory trigrams searches every text. A hash that two
texts share gives them each other's rules to search and changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .shared import free_name, saved


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` count if `group` has `least` characters or more.

    `sought`, if given, is an expression that has just the matches that count, so that others aren't listed first.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    sought: str = ""


# The base rules and further well-known key formats.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("hub_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES
LONGEST_ALTERNATIVES = 24


def _strings(parsed) -> list[set[str] | None]:
    """The pieces of a parsed expression in order: all strings a piece can be, or None if too many."""
    out: list[set[str] | None] = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append({chr(arg).lower()})
        elif name == "IN" and len(arg) <= 8 and all(str(x[0]) == "LITERAL" for x in arg):
            out.append({chr(x[1]).lower() for x in arg})
        elif name == "SUBPATTERN":
            out += _strings(arg[3])
        elif name == "BRANCH":
            whole = [_joined(_strings(x)) for x in arg[1]]
            out.append(None if None in whole else set().union(*whole))
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            inner = _joined(_strings(arg[2]))
            out.append(None if inner is None else inner | {""})
        else:
            out.append(None)
    return out


def _joined(pieces: list[set[str] | None]) -> set[str] | None:
    if None in pieces:
        return None
    out = reduce(lambda a, b: {x + y for x in a for y in b}, pieces, {""})
    return out if len(out) <= LONGEST_ALTERNATIVES else None


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams that must all be there; empty: no mandatory trigram.

    Every match holds one of the strings of each run of finite pieces. Of the runs whose every string
    has a trigram, the one with the most trigrams in its poorest alternative is taken.
    """
    runs: list[set[str]] = [{""}]
    for piece in _strings(re._parser.parse(pattern)):
        if not piece or "" in piece:
            runs.append({""})
        elif len(grown := {x + y for x in runs[-1] for y in piece}) <= LONGEST_ALTERNATIVES:
            runs[-1] = grown
        else:
            runs.append(piece)
    queries = [[frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(run)] for run in runs]
    usable = [q for q in queries if all(q)]
    return max(usable, key=lambda q: (min(map(len, q)), -len(q)), default=[])


#: A block of the index holds about so many postings; there are as many blocks as that needs.
POSTINGS_A_BLOCK = 200_000
#: Masks too many to broadcast are joined under so many numbers, so that copies of one text meet in as many tasks.
SALTS = 16


def _hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def index(df: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """(block, lists): for each block of text hashes the sorted hashes under each trigram's place in `trigrams`.

    Trigrams are looked for in lower-case texts. Hashes are posted once a task and trigram, so that copies of a text
    are one posting; a block holds about `POSTINGS_A_BLOCK` of them, however often a trigram occurs.
    """
    seen = df.select(_hash(text).alias("key"), F.lower(text).alias("folded"))
    here = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)]))
    postings = saved(seen.select("key", F.explode(here).alias("trigram")))
    blocks = 1 + postings.count() // POSTINGS_A_BLOCK
    lists = postings.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "trigram").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))


def _matching(query: list[list[int]]) -> Column:
    """The hashes of a block that a query admits: those in all lists of one of its conjunctions."""

    def every(conjunction: list[int]) -> Column:
        some = F.array(*[F.coalesce(F.try_element_at("lists", F.lit(k)), F.array().cast("array<bigint>")) for k in conjunction])
        by_length = F.array_sort(some, lambda a, b: F.size(a) - F.size(b))
        return F.aggregate(F.slice(by_length, 2, len(conjunction)), F.element_at(by_length, 1), lambda a, b: F.array_intersect(a, b))

    return F.array_distinct(F.flatten(F.array(*map(every, query))))


def candidates(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(key, mask), a written table: for hashes of texts a bit for each rule with a query that the texts may match."""
    queries = {r: q for r, rule in enumerate(rules) if (q := trigram_query(rule.pattern))}
    trigrams = sorted({t for q in queries.values() for some in q for t in some})
    if not trigrams:
        return df.sparkSession.createDataFrame([], "key bigint, mask bigint")
    place = {t: k for k, t in enumerate(trigrams)}
    under = lambda r: lambda key: F.struct(key.alias("key"), F.lit(1 << r).cast("long").alias("mask"))
    found = [F.transform(_matching([sorted(place[t] for t in some) for some in q]), under(r)) for r, q in queries.items()]
    hits = index(df, trigrams, text).select(F.inline(F.flatten(F.array(*found))))
    return saved(hits.groupBy("key").agg(F.bit_or("mask").alias("mask")))


def with_mask(df: DataFrame, rules: tuple[Rule, ...], text: str, mask: str) -> DataFrame:
    """`df` with `mask`: a bit for each rule that the row's text may match.

    A table of masks that is small, which is counted, is broadcast and the rows stay where they are; a larger one is
    joined by hash and by the number of the row's task, so that copies of one text don't meet in one task.
    """
    found = candidates(df, rules, text)
    key, salt = free_name(df, "text_hash"), free_name(df, "text_salt")
    named = found.select(F.col("key").alias(key), F.col("mask").alias(mask))
    always = sum(1 << r for r, rule in enumerate(rules) if not trigram_query(rule.pattern))
    keyed = df.withColumn(key, _hash(text))
    if found.count() * len(found.columns) <= shared.BROADCAST_CELLS:
        joined = keyed.join(F.broadcast(named), key, "left")
    else:
        salted = named.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn(salt, F.spark_partition_id() % SALTS).join(salted, [key, salt], "left").drop(salt)
    return joined.withColumn(mask, F.coalesce(mask, F.lit(0).cast("long")).bitwiseOR(F.lit(always).cast("long"))).drop(key)


SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _groups(values: Column) -> Column:
    """An array in groups of about the root of its length, so that folds with growing results stay short."""
    size = F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int")
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.size(values) - 1, size), lambda i: F.slice(values, i + 1, size)))


def _before(groups: Column, of_group: Callable[[Column], Column], joined: Callable[[Column, Column], Column]) -> Column:
    """For each group what `joined` makes, from 0 on, of the values `of_group` of those before it, and of all at the end."""
    first = F.array(F.lit(0))
    return F.aggregate(F.transform(groups, of_group), first, lambda acc, x: F.concat(acc, F.array(joined(F.element_at(acc, -1), x))))


def _steps(text: Column, rule: Rule) -> Column:
    """The lengths of the gaps between the rule's matches and of the matches, in turn: array<struct<g, h, k>>.

    Splitting at the expression gives the gaps; `k` is the length of what is sought in a match.
    """
    pattern = rule.sought or rule.pattern
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else hits
    return F.zip_with(F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h"))), F.transform(kept, F.length), lambda s, k: F.struct(s["g"].alias("g"), s["h"].alias("h"), k.alias("k")))


def _spans(steps: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in order, from a column of `_steps`: struct<start, rank, kind, end> in code points, end exclusive."""
    groups = _groups(steps)
    of_step = lambda s: s["g"] + F.coalesce(s["h"], F.lit(0))
    starts = _before(groups, lambda g: F.aggregate(g, F.lit(0), lambda acc, s: acc + of_step(s)), lambda a, b: a + b)

    def step(acc: Column, s: Column) -> Column:
        start, end = acc["at"] + s["g"], acc["at"] + of_step(s)
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["k"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    fold = lambda g, at: F.aggregate(g, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), step, lambda acc: acc["out"])
    return F.coalesce(F.flatten(F.zip_with(groups, F.slice(starts, 1, F.size(groups)), fold)), F.array().cast(SPANS))


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "secrets") -> DataFrame:
    """`df` with `out`: all spans of all rules, array<struct<start, rank, kind, end>> by start, then rule.

    A null text counts as empty and has none. Rows stay where they are, repeated ones each with their spans; ids are
    not looked at. A column called `out` is replaced. The texts are read twice, the first time when this is called, to
    build the index; they must be the same both times.
    """
    names = [c for c in df.columns if c.lower() != out.lower()]
    mask = free_name(df, "rule_mask")
    steps = [free_name(df, f"rule_steps_{r}") for r in range(len(rules))]
    body = F.coalesce(F.col(text), F.lit(""))
    marked = with_mask(df, rules, text, mask)
    may = lambda r, rule: (F.col(mask).bitwiseAND(1 << r) != 0) & (body.rlike(rule.sought) if rule.sought else F.lit(True))
    marked = marked.withColumns({steps[r]: F.when(may(r, rule), _steps(body, rule)) for r, rule in enumerate(rules)})
    each = [F.when(F.col(steps[r]).isNotNull(), _spans(F.col(steps[r]), rule, r)).otherwise(F.array().cast(SPANS)) for r, rule in enumerate(rules)]
    return marked.select(*names, F.array_sort(F.concat(*each)).alias(out))


def redact(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """`df` with every secret of `scan` in its text replaced by `mark`; overlapping spans become one mark.

    A null text stays null; rows and other columns stay as they are.
    """
    own = free_name(df, "redact_spans")
    groups, body = _groups(F.col(own)), F.col(text)
    ends = _before(groups, lambda g: F.array_max(F.transform(g, lambda s: s["end"])), lambda a, b: F.greatest(a, b))

    def step(part: Column) -> Callable[[Column, Column], Column]:
        def run(acc: Column, s: Column) -> Column:
            between = F.substring(part["body"], acc["at"] - part["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            piece = F.when(s["start"] >= acc["at"], F.array(between, F.lit(mark))).otherwise(F.array().cast("array<string>"))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

        return run

    # each group with its own part of the text, from where the groups before it end
    bounds = F.zip_with(groups, F.zip_with(F.slice(ends, 1, F.size(groups)), F.slice(ends, 2, F.size(groups)), lambda a, b: F.struct(a.alias("at"), b.alias("to"))), lambda g, x: F.struct(g.alias("spans"), x["at"].alias("at"), x["to"].alias("to")))
    parts = F.transform(bounds, lambda x: F.struct(x["spans"].alias("spans"), x["at"].alias("at"), F.substring(body, x["at"] + 1, x["to"] - x["at"]).alias("body")))
    start = lambda x: F.struct(x["at"].alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.transform(parts, lambda x: F.array_join(F.aggregate(x["spans"], start(x), step(x), lambda acc: acc["out"]), ""))
    rest = F.substring(body, F.element_at(ends, -1) + 1, F.length(body))
    clean = F.when(F.size(own) > 0, F.concat(F.array_join(done, ""), rest)).otherwise(body)
    return scan(df, rules, text, own).withColumn(text, clean).drop(own)


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("secrets")
    count = lambda r: F.size(F.filter(spans, lambda s: s["rank"] == r)).cast("long")
    return scan(docs).select(
        "doc_id",
        *[count(r).alias(f"n_{rule.kind}") for r, rule in enumerate(BASE_RULES)],
        F.sha2(_digest(F.filter(spans, lambda s: s["rank"] < len(BASE_RULES))), 256).alias("base_sha256"),
        _digest(spans).alias("spans"),
    )


def _sql_spans(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
    select doc_id, {rank} as rank, '{rule.kind}' as kind, k,
      (sum(length(g) + coalesce(length(h), 0)) over (partition by doc_id order by k) - coalesce(length(h), 0))::bigint as s,
      (sum(length(g) + coalesce(length(h), 0)) over (partition by doc_id order by k))::bigint as e, v
    from (select doc_id, unnest(range(1, len(gs) + 1)) as k, unnest(gs) as g, unnest(list_resize(hs, len(gs))) as h, unnest(list_resize(vs, len(gs))) as v
      from (select doc_id, string_split_regex(text, '{pattern}') as gs, regexp_extract_all(text, '{pattern}') as hs, regexp_extract_all(text, '{pattern}', {rule.group}) as vs
        from (select doc_id, coalesce(text, '') as text from documents)))"""


ORACLE = "with " + ", ".join(f"r{r} as ({_sql_spans(rule, r)})" for r, rule in enumerate(RULES)) + ", found as (" + " union all ".join(
    f"select doc_id, rank, kind, s, e from r{r} where length(v) >= {rule.least}" for r, rule in enumerate(RULES)) + f"""),
spans as (select doc_id, {", ".join(f"count(*) filter (rank = {r}) as n_{rule.kind}" for r, rule in enumerate(BASE_RULES))},
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < {len(BASE_RULES)}), '') as base,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank), '') as spans from found group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0) as n_{rule.kind}" for rule in BASE_RULES)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join spans s on d.doc_id = s.doc_id"""  # fmt: skip
