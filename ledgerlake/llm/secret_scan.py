"""Operator 2: secrets by corpus-wide ownership frequency, in DataFrame functions alone.

Patterns find candidates with their places. A hash of each candidate's value is counted over the corpus by distinct
repositories and distinct owners: a value that several owners hold is a copied example; one that stays with an owner but lies in many of its
repositories is shared (a fixture, a template); one that is in few repositories of few owners and looks random is taken to be live. The base
kinds are always reported; opaque tokens (long runs that mix cases and digits and overlap nothing of the base) are added only where
they are live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import joined_with_hot, written

#: Fixed patterns. For access and hex the least length stands in the pattern, which finds the same spans as dropping
#: shorter matches: their runs end where the match ends. A failing assignment uses up its text, so it is dropped later.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("opaque", OPAQUE))
BASE = 3
ASSIGN_LEAST = 8
#: A value with this many owners is a copied example, and one of fewer owners with this many repositories is shared.
EXAMPLE_OWNERS, SHARED_REPOSITORIES = 3, 10
#: Spans of one value from which its verdict is sent to every task instead of its spans to one, and such values that are sent at most
#: (about 60 bytes each); beyond them all go through the shuffle.
HOT_SPANS, MOST_HOT = 10_000, 200_000
#: Matches whose places are summed up in a row; the sums of such runs are summed up again.
RUN = 256
#: Values of live credentials have at least so many different characters, and none of these words.
LEAST_CHARACTERS = 8
PLACEHOLDERS = "example|sample|changeme|dummy|placeholder|xxxx|test|your"

EMPTY = "cast(array() as array<struct<start:bigint,k:int,end:bigint,value:string>>)"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(k: int, pattern: str) -> Column:
    """Places and values of the matches of a pattern in column text: what lies between them gives where they start.

    Where a match ends is a running sum over lengths. An array can't grow in place, so the sum is built in runs of RUN matches, and the runs' sums
    in a row of their own: work grows with the matches and not with their square.
    """
    p = _literal(pattern)
    value = f"regexp_extract(s.m, {p}, 2)" if k == 0 else "s.m"
    ends = f"""transform(sequence(0, cast((size(z) - 1) div {RUN} as int)), r -> aggregate(slice(z, r * {RUN} + 1, {RUN}), array(0L),
      (a, x) -> concat(a, array(element_at(a, -1) + length(x.g) + length(x.m)))))"""
    starts = "aggregate(runs, array(0L), (a, r) -> concat(a, array(element_at(a, -1) + element_at(r, -1))))"
    whole = "flatten(zip_with(runs, slice(starts, 1, size(runs)), (r, s) -> transform(slice(r, 2, size(r) - 1), e -> s + e)))"
    matched = f"regexp_extract_all(text, {p}, 0)"
    z = f"zip_with(slice(split(text, {p}, -1), 1, size({matched})), {matched}, (g, m) -> named_struct('g', g, 'm', m))"
    # let-bindings, as SQL has none in an expression: a one-element array is transformed
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    spans = f"transform(zip_with(z, {whole}, (x, e) -> named_struct('m', x.m, 'end', e)), s -> named_struct('start', s.end - length(s.m), 'k', {k}, 'end', s.end, 'value', {value}))"
    spans = let("z", z, let("runs", ends, let("starts", starts, spans)))
    return F.expr(f"if(text rlike {p}, filter({spans}, s -> length(s.value) >= {ASSIGN_LEAST if k == 0 else 1}), {EMPTY})")


def _joined(spans: str) -> str:
    names = ", ".join(f"'{n}'" for n, _ in KINDS)
    return f"concat_ws(',', transform({spans}, s -> concat(array({names})[s.k], ':', s.start, ':', s.end)))"


def _live(value: str) -> str:
    """A value that looks random: enough different characters, and no word of a placeholder."""
    return f"size(array_distinct(split({value}, ''))) >= {LEAST_CHARACTERS} and not lower({value}) rlike '{PLACEHOLDERS}'"


def _apart_from_base(each: DataFrame) -> DataFrame:
    """Spans without the opaque ones that overlap one of the base in their row: of the base spans those that begin at or before a span reach
    past its start, or the next one begins before its end. Base spans of a kind don't overlap, but kinds may, so the furthest end counts."""
    base = F.col("k") < BASE
    before = W.partitionBy("row").orderBy("start").rangeBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy("row").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, W.currentRow)
    reach, following = F.max(F.when(base, F.col("end"))).over(before), F.min(F.when(base, F.col("start"))).over(after)
    apart = F.coalesce(reach <= F.col("start"), F.lit(True)) & F.coalesce(following >= F.col("end"), F.lit(True))
    return each.withColumn("apart", base | apart).filter("apart").drop("apart")


def _judged(each: DataFrame, example_owners: int, shared_repositories: int) -> DataFrame:
    """Spans with owners and repositories of their value. Values of very many spans are few, and their verdicts are broadcast."""
    holders = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("spans")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("spans").alias("spans"))
    holders = holders.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("spans").alias("spans"))
    known = joined_with_hot(each, written(holders, "holders"), ["hash"], "spans", HOT_SPANS, MOST_HOT)
    few = (F.col("owners") < example_owners) & (F.col("repositories") < shared_repositories)
    return known.withColumn("live", few & F.col("random")).withColumn("example", F.col("owners") >= example_owners).withColumn("shared", ~F.col("example") & ~few)


def secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", example_owners: int = EXAMPLE_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, n_example and most_repositories.

    Spans are kind:start:end in code points, by start, then kind. Null texts count as empty; a null owner or repository is one
    of its own; rows are never merged, whatever their ids, and repeated ones each get their spans. n_live counts spans whose value lies with
    fewer than example_owners owners in fewer than shared_repositories repositories and looks random, n_example those with as many owners, n_shared
    those with fewer owners and as many repositories; most_repositories is the largest number of repositories of a value in the row.
    Work grows with the number of matches of a text, however many. Other columns are ignored; an empty table gives none.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"))
    rows = rows.select("doc_id", "repository", "owner", *(_found(k, p).alias(n) for k, (n, p) in enumerate(KINDS)))
    rows = rows.withColumn("base", F.array_sort(F.concat(*(n for n, _ in KINDS[:BASE]))))
    mixed = "s.value rlike '[a-z]' and s.value rlike '[A-Z]' and s.value rlike '[0-9]'"
    rows = rows.withColumn("all", F.concat("base", F.expr(f"filter(opaque, s -> {mixed})")))
    hashed = F.expr(f"transform(all, s -> named_struct('start', s.start, 'k', s.k, 'end', s.end, 'hash', md5(s.value), 'random', {_live('s.value')}))")
    counts = [F.size(n).cast("long").alias(f"n_{n}") for n, _ in KINDS[:BASE]]
    digest = F.sha2(F.expr(_joined("base")), 256).alias("base_sha256")
    # values are gone from here on; the written rows have numbers that stay
    scanned = written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repository", "owner", *counts, digest, hashed.alias("found")), "candidates")

    each = scanned.filter(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("s")).select("row", "owner", "repository", "s.*")
    each = written(_apart_from_base(each), "spans")
    shown = _judged(each, example_owners, shared_repositories).filter((F.col("k") < BASE) | F.col("live"))
    per_row = shown.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "k", "end"))).alias("s"), F.max("repositories").alias("most"), *(F.count_if(x).alias(f"n_{x}") for x in ("live", "shared", "example"))
    )
    out = scanned.drop("found", "owner", "repository").join(per_row, "row", "left")
    number = lambda c, n: F.coalesce(c, F.lit(0)).cast("long").alias(n)
    spans = F.coalesce(F.expr(_joined("s")), F.lit("")).alias("spans")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans, *(number(n, n) for n in ("n_live", "n_shared", "n_example")), number("most", "most_repositories"))


def _oracle() -> str:
    def found(k: int, pattern: str) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        value = f"regexp_extract(m, {p}, 2)" if k == 0 else "m"
        return f"""select r, {k} as k, s, e, {value} as v from (
          select r, m, sum(length(g) + length(m)) over (partition by r order by i) as e, e - length(m) as s from (
            select r, unnest(regexp_extract_all(text, {p})) as m, unnest(list_slice(regexp_split_to_array(text, {p}), 1, len(regexp_extract_all(text, {p})))) as g,
              unnest(range(len(regexp_extract_all(text, {p})))) as i from d)) where length({value}) >= {ASSIGN_LEAST if k == 0 else 1}"""

    names = "['" + "', '".join(n for n, _ in KINDS) + "'][k + 1] || ':' || s || ':' || e"
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as source, coalesce(text, '') as text from documents),
f as ({" union all ".join(found(k, p) for k, (_, p) in enumerate(KINDS))}),
base as (select * from f where k < {BASE}),
opaque as (select * from f where k >= {BASE} and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[0-9]')
           and not exists (select 1 from base where base.r = f.r and base.s < f.e and f.s < base.e)),
every as (select * from base union all select * from opaque),
own as (select v, count(distinct source) as owners, count(distinct (source, coalesce(doc_id::varchar, ''))) as repositories from every join d using (r) group by v),
j as (select every.*, owners, repositories, owners < {EXAMPLE_OWNERS} and repositories < {SHARED_REPOSITORIES} and len(list_distinct(string_split(v, ''))) >= {LEAST_CHARACTERS} and not regexp_matches(lower(v), '{PLACEHOLDERS}') as live
      from every join own using (v)),
b as (select r, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
        string_agg({names}, ',' order by s, k) as base from base group by r),
a as (select r, string_agg({names}, ',' order by s, k) as spans, count(*) filter (live) as n_live, count(*) filter (owners >= {EXAMPLE_OWNERS}) as n_example,
        count(*) filter (owners < {EXAMPLE_OWNERS} and repositories >= {SHARED_REPOSITORIES}) as n_shared, max(repositories) as most from j where k < {BASE} or live group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example,
  coalesce(n_shared, 0) as n_shared, coalesce(most, 0) as most_repositories
from d left join b using (r) left join a using (r)
"""


#: DuckDB: the same spans and owners over documents.
ORACLE = _oracle()
