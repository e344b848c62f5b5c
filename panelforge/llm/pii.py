"""Personal data: patterns of known kinds, and identifiers found by bootstrapped contexts.

Everything here is DataFrame and SQL functions. Known kinds (e-mail, IP, card and phone numbers)
are seeds. Seeds and identifier-like tokens (with a run of four digits) are instances; the word before one, or the kind
of the match before it, is its lexical pattern. Over the graph of patterns and instances, a pattern's confidence is the smoothed mean of its
instances' scores and an instance's score the noisy-or of its patterns; seeds stay at 1. After
some rounds, unseen instances at patterns of high confidence and enough different instances are spans of the kind ``context``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.common import join_one, written

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the known kinds, written so that matching takes time in proportion to the text: repeats are possessive where what follows
#: can't be part of them, and a run that failed from its start isn't tried again from its middle (but for what a match left of it, \G).
#: Runs that are too short for a card can't match, which changes no other match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPACE = r"\x20\x09-\x0D"
IDENTIFIER = rf"(?<![^{SPACE}])[^{SPACE}]*[0-9]{{4}}[^{SPACE}]*"
LAST_WORD = rf"(?<![^{SPACE}])([^{SPACE}]++)[{SPACE}]*+$"
SPAN = "array<struct<s:int,k:int,kind:string,e:int,m:string,before:string>>"
#: Matches of a text whose places are added up at once; longer lists are added up list by list.
RUN = 256


@dataclass(frozen=True)
class BootstrapSpec:
    rounds: int = 3
    confidence: float = 0.6
    instances: int = 3
    damping: float = 0.9


def located(text: str, kind: str, pattern: str, order: int = 0) -> Column:
    """All leftmost non-overlapping matches in column ``text`` with their places in code points: matches and the pieces between them have known lengths.

    ``before`` is the word before a match, or <kind> if only white space stands between it and the match before.
    Places are carried on over runs of matches, so that no list grows match by match.
    """
    quoted, word = (p.replace("\\", "\\\\").replace("'", "\\'") for p in (pattern, LAST_WORD))
    return F.expr(f"""
        transform(array(zip_with(regexp_extract_all({text}, '{quoted}', 0), split({text}, '{quoted}', -1), (m, p) -> named_struct('m', m, 'p', p))), z ->
            aggregate(
                sequence(0, (size(z) - 1) div {RUN}),
                named_struct('at', 0, 'runs', cast(array() as array<{SPAN}>)),
                (done, i) -> transform(array(aggregate(
                    slice(z, cast(i as int) * {RUN} + 1, {RUN}),
                    named_struct('at', done.at, 'a', cast(array() as {SPAN})),
                    (acc, x) -> if(x.m is null, acc, named_struct(
                        'at', acc.at + length(x.p) + length(x.m),
                        'a', concat(acc.a, array(named_struct('s', acc.at + length(x.p), 'k', {order}, 'kind', '{kind}', 'e', acc.at + length(x.p) + length(x.m), 'm', x.m,
                            'before', coalesce(nullif(lower(regexp_extract(x.p, '{word}', 1)), ''), if(acc.at > 0, '<{kind}>', ''))))))))),
                    r -> named_struct('at', r.at, 'runs', concat(done.runs, array(r.a))))[0],
                done -> flatten(done.runs)))[0]""")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    digits = _digits(x)
    if kind == "ip":
        return F.forall(F.split(x, "\\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(256)) <= 255)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _maybe(kind: str) -> Column:
    """A cheap test that every text with such a match passes."""
    text = F.col("text")
    return {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][0-9 -]{10}")}[kind]


def _known(kind: str, order: int) -> Column:
    spans = F.filter(located("text", kind, PATTERNS[kind], order), lambda x: _valid(kind, x["m"]))
    return F.when(_maybe(kind), spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base`` (spans of the known kinds by start, then kind) to rows with ``text``."""
    return docs.withColumn("base", F.array_sort(F.concat(*(_known(k, i) for i, k in enumerate(KINDS)))))


def occurrences(docs: DataFrame) -> DataFrame:
    """Adds ``seen``: the seeds (spans of the known kinds) and identifier-like tokens, each with the word before it."""
    found = F.when(F.col("text").rlike("[0-9]{4}"), located("text", "context", IDENTIFIER, len(KINDS))).otherwise(F.expr(f"cast(array() as {SPAN})"))
    shown = lambda spans, seed: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("instance"), x["before"].alias("pattern"), F.lit(seed).alias("seed")))
    return docs.withColumn("seen", F.concat(shown(F.col("base"), True), shown(found, False)))


def apart_from_seeds(every: DataFrame) -> DataFrame:
    """Occurrences (row, s, e, seed) without those that touch a seed but aren't one, by running ends and starts within a row (one text's occurrences)."""
    by = W.partitionBy("row").orderBy("s")
    ended, next_ = F.max(F.when(F.col("seed"), F.col("e"))).over(by), F.min(F.when(F.col("seed"), F.col("s"))).over(by.rangeBetween(W.currentRow, W.unboundedFollowing))
    marked = every.withColumn("_ended", ended).withColumn("_next", next_)
    return marked.where("seed or not (coalesce(_ended > s, false) or coalesce(_next < e, false))").drop("_ended", "_next")


def confident_patterns(seen: DataFrame, spec: BootstrapSpec) -> DataFrame:
    """(pattern, confidence, instances) accepted after the rounds; ``seen`` has a row for each occurrence (pattern, instance, seed), both known by hashes of any length of text."""
    edges = written(seen.where("pattern is not null").groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pattern-graph")
    scores = written(edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score")), "instances")
    for k in range(spec.rounds):
        last = k == spec.rounds - 1
        held = join_one(edges, scores, "instance")
        patterns = held.groupBy("pattern").agg(F.sum("score").alias("mass"), F.count("*").alias("instances"))
        patterns = written(patterns.withColumn("confidence", F.col("mass") / (F.col("instances") + 1)), "patterns")
        if not last:
            odds = F.sum(F.log(1 - spec.damping * F.col("confidence")))
            linked = join_one(edges, patterns.select("pattern", "confidence"), "pattern").groupBy("instance").agg(odds.alias("miss"), F.max("seed").alias("known"))
            scores = written(linked.select("instance", F.when(F.col("known"), 1.0).otherwise(1 - F.exp("miss")).alias("score")), "instances")
    return patterns.where((F.col("confidence") >= spec.confidence) & (F.col("instances") >= spec.instances)).select("pattern", "confidence", "instances")


def find(docs: DataFrame, spec: BootstrapSpec = BootstrapSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, extra) for every row: spans of the known kinds and those found by context (start s, kind, end e, text m).

    A null text has no spans; a text of any length is read whole, in time proportional to it; equal rows get equal spans; an empty table gives none. Only the id and the
    text are looked at. Spans by context never touch one of a known kind. Spans of two kinds at one start stand in the order of the kinds.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    read = occurrences(base_spans(rows)).select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", "seen")
    read = written(read, "spans")
    every = read.where(F.size("seen") > 0).select("row", F.explode("seen").alias("o"))
    every = every.select("row", "o.s", "o.e", "o.seed", F.col("o.instance").alias("m"), F.xxhash64("o.instance").alias("instance"), F.when(F.col("o.pattern") != "", F.xxhash64("o.pattern")).alias("pattern"))
    every = written(apart_from_seeds(every), "occurrences")
    good = written(confident_patterns(every, spec).select("pattern"), "confident")
    fresh = join_one(every.where("not seed"), good, "pattern")
    by_row = fresh.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("s"), F.lit(len(KINDS)).alias("k"), F.lit("context").alias("kind"), F.col("e"), F.col("m")))).alias("extra"))
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["kind"].alias("kind"), x["e"].alias("e"), x["m"].alias("m")))
    out = read.join(by_row, "row", "left")
    return out.select("doc_id", base.alias("base"), F.coalesce("extra", F.expr("cast(array() as array<struct<s:int,k:int,kind:string,e:int,m:string>>)")).alias("extra"))


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
