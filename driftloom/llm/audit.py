"""Filter interaction audit: what every order of a set of filters removes, step by step.

A document counts by the set of filters that it fails, as a mask of bits. Masks are counted first,
by part and label; each cell then contributes to the edges of the lattice of subsets, (filters
already applied, next filter): 16 subsets for each of five filters, 80 edges. The documents that an
order has left before a step depend only on which filters came before, so an order of filters is a
path of edges, and the 600 steps of the 120 orders are a join with the edges; no order is run.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.llm.common import checkpoint, looked_up, table, text_or_empty

LEAST_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
SYMBOLS = "[#$%&*|]"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters() -> dict[str, Column]:
    """Failure conditions of a row's own text: ``_text`` (never null) and ``_words`` (its words)."""
    words, chars = F.size("_words"), F.char_length("_text")
    upper = chars - F.char_length(F.regexp_replace("_text", "[A-Z]+", ""))
    return {
        "A": words < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct("_words")) < DISTINCT_PERCENT * words,
        "C": 100 * upper.cast("long") > UPPER_PERCENT * chars.cast("long"),
        "D": F.rlike("_text", F.lit(SYMBOLS)),
    }


def failures(docs: DataFrame, filters: dict[str, Column], part: str = "lang") -> DataFrame:
    """doc_id, part and fails of every row: bit i of fails for the ith filter, the last bit for a repeated text.

    A text is repeated if a row of a smaller doc_id has the same one, whatever the filters do to that row.
    """
    words = F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty().alias("_text"))
    rows = rows.withColumn("_words", words)
    mask = sum((fails.cast("int") * 2**i for i, fails in enumerate(filters.values())), F.lit(0))
    rows = checkpoint(rows.select("doc_id", "part", mask.alias("fails"), F.unhex(F.sha2("_text", 256)).alias("_key")))
    several = rows.groupBy("_key").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    found = looked_up(rows, several.drop("_n"), ["_key"])
    repeated = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)).cast("int") * 2 ** len(filters)
    return found.select("doc_id", "part", (F.col("fails") + repeated).alias("fails"))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts ``n`` of documents by part, fails, good and toxic; a document is either if any row of its labels says so."""
    said = labels.where("doc_id is not null").groupBy("doc_id")
    said = said.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = looked_up(failed, said, ["doc_id"])
    marked = marked.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return marked.groupBy("part", "fails", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def edges(counted: DataFrame, n_filters: int) -> DataFrame:
    """One row per part and edge of the lattice: ``applied`` (a mask), ``bit`` (the next filter's), the counts and shapley."""
    pairs = [(s, 2**i) for i in range(n_filters) for s in range(2**n_filters) if not s >> i & 1]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(b).alias("bit")) for s, b in pairs])).alias("_e")
    rows = counted.select("part", "fails", "good", "toxic", "n", each).select("*", "_e.*").drop("_e")
    here, before = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("fails").bitwiseAND(F.col("applied")) != 0
    lost = here & ~before
    conditions = (~here & ~before, lost, here & before, F.col("fails") == F.col("bit"), lost & F.col("good"), lost & F.col("toxic"))
    sums = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in zip(_COUNTS, conditions)]
    size = F.bit_count("applied")
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n_filters - 1 - k)) for k in range(n_filters)]), size + 1)
    shapley = F.sum(F.col("removed") * orders.cast("long")).over(W.partitionBy("part", "bit"))
    return rows.groupBy("part", "applied", "bit").agg(*sums).withColumn("shapley", shapley)


def steps(spark: SparkSession, names: str) -> DataFrame:
    """Every step of every order of ``names``: filter_order, step (from 1) and its edge."""
    bit = {name: 2**i for i, name in enumerate(names)}
    rows = [
        ("".join(order), k + 1, sum(bit[x] for x in order[:k]), bit[order[k]])
        for order in permutations(names)
        for k in range(len(names))
    ]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, bit int")


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, repeated: str = "E", part: str = "lang") -> DataFrame:
    """part, filter_order, step and the counts of every step of every order of ``filters`` and ``repeated``.

    ``filters`` maps names of one letter to failure conditions on ``_text`` and ``_words``; nulls in
    them are not looked for. kept: left after the step; removed: failing its filter and left before
    it; redundant: failing it and removed earlier; unique_fails: failing its filter only; good_lost
    and toxic_lost: removed with such a label; shapley: the filter's removed over all orders.

    A null text is empty (and equal to empty ones); texts of any length are taken whole; a null part
    is the empty string; a row without doc_id has no smaller doc_id and no label, so it is never
    repeated, nor are rows of the first doc_id of a text, however often that row repeats; labels
    other than 1 and of unknown ids count for nothing; an empty table gives an empty result; only
    doc_id, text, ``part`` and the labels' doc_id, quality and toxic are read.
    """
    filters = filters or text_filters()
    counted = cells(failures(docs, filters, part), labels)
    names = "".join(filters) + repeated
    orders = F.broadcast(steps(docs.sparkSession, names))  # a few hundred rows, whatever the table
    found = edges(counted, len(names)).join(orders, ["applied", "bit"])
    return found.select("part", "filter_order", "step", *_COUNTS, "shapley")


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters in all 120 orders over the whole ``documents`` table, by lang."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every order is run over the documents' masks, without a lattice.
ORACLE = f"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
    coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as words from documents),
f as (select doc_id, part, (len(words) < {LEAST_WORDS})::int as a,
    (100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words))::int as b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(t))::int as c,
    regexp_matches(t, '{SYMBOLS}')::int as d,
    coalesce(doc_id > min(doc_id) over (partition by t), false)::int as e from d),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
m as (select part, a + 2 * b + 4 * c + 8 * d + 16 * e as fails, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic,
    count(*) as n from f left join l on f.doc_id = l.doc_id group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as letter, unnest([1, 2, 4, 8, 16]) as bit),
o as (select concat(p.letter, q.letter, r.letter, s.letter, t.letter) as filter_order from x p, x q, x r, x s, x t
    where p.bit | q.bit | r.bit | s.bit | t.bit = 31),
k as (select filter_order, unnest([1, 2, 3, 4, 5]) as step from o),
w as (select filter_order, step, bit, coalesce(sum(bit) over (partition by filter_order order by step
    rows between unbounded preceding and 1 preceding), 0)::int as applied
    from k join x on letter = substr(filter_order, step, 1)),
g as (select part, filter_order, step, bit,
    sum(case when fails & (applied | bit) = 0 then n else 0 end)::bigint as kept,
    sum(case when fails & applied = 0 and fails & bit > 0 then n else 0 end)::bigint as removed,
    sum(case when fails & applied > 0 and fails & bit > 0 then n else 0 end)::bigint as redundant,
    sum(case when fails = bit then n else 0 end)::bigint as unique_fails,
    sum(case when fails & applied = 0 and fails & bit > 0 and good then n else 0 end)::bigint as good_lost,
    sum(case when fails & applied = 0 and fails & bit > 0 and toxic then n else 0 end)::bigint as toxic_lost
    from m cross join w group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, bit))::bigint as shapley from g
"""
