"""Merkle manifest of a dataset: a tree of digests per source, one above the sources, and each row's proof.

Rows are numbered in the order of their source and id by a range partition and its counts, so that a
source of any size is spread over all tasks. Levels are DataFrames: a node's index, divided by the
fanout, is its parent's; children are gathered as sorted arrays of ``FANOUT`` at most and hashed.
Proofs go down the same levels: the siblings of the root's children are known first, each level's
join hands a node the path of its parent, and the node puts its own siblings before it. So a level
costs as many rows as it has nodes, all levels together half as many as the leaves, where a join of
every leaf with every level would cost leaves times levels.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import checkpoint, looked_up, partitions, table

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def encoded(value: Column) -> Column:
    """``-`` if null, else its length in bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row: of the encoded fields in order."""
    return F.sha2(F.concat(*[encoded(c) for c in columns.values()]), 256)


def without_line_feeds() -> tuple[Column, Column]:
    """Which rows are tampered with (the id's crc32 is even), and the text that they then have."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows``, which must not be computed twice, with ``_at``: 0, 1, ... in the order of the columns; equal rows in any order.

    Rows that are equal in all columns are told apart by where they are held, so none are too many for a task.
    """
    keys = [*order, "_held"]
    held = rows.withColumn("_held", F.monotonically_increasing_id())
    dealt = held.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = checkpoint(dealt.withColumn("_own", F.monotonically_increasing_id()).drop("_held"))
    # a row's number within its partition is in the lower 33 bits of its id, its partition's above them
    part = F.shiftright("_own", 33).alias("_part")
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # a row per partition
    before = accumulate([0, *[r["n"] for r in counts]])
    starts = [(r["_part"], b) for r, b in zip(counts, before)]
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    found = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return found.withColumn("_at", F.col("_before") + F.col("_own").bitwiseAND(F.lit(2**33 - 1))).drop("_part", "_before", "_own")


def levels(nodes: DataFrame, most: int, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels above ``nodes`` (_g, _i, _h, _n, _row): _g, _i, _kids (sorted structs of _i, _h, _row), _h, _n (nodes of its group).

    ``_g`` names a tree, ``_i`` counts its nodes from 0; ``most`` is the largest ``_n``. A tree ends where it has one node.
    """
    found = []
    while most > 1:
        kids = F.array_sort(F.collect_list(F.struct("_i", "_h", "_row"))).alias("_kids")
        above = nodes.where("_n > 1").groupBy("_g", F.expr(f"_i div {fanout}").alias("_i")).agg(kids, F.max("_n").alias("_n"))
        count = F.expr(f"(_n + {fanout - 1}) div {fanout}").alias("_n")
        found.append(checkpoint(above.select("_g", "_i", "_kids", F.sha2(F.concat_ws("", "_kids._h"), 256).alias("_h"), count)))
        nodes = found[-1].select("_g", "_i", "_h", "_n", F.lit(0).alias("_row"))
        most = -(-most // fanout)
    return found


def roots(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """The root of every tree: _g, _h and _height (0: a lone node)."""
    found = nodes.where("_n = 1").select("_g", "_h", F.lit(0).alias("_height"))
    for height, level in enumerate(above, 1):
        found = found.unionByName(level.where("_n = 1").select("_g", "_h", F.lit(height).alias("_height")))
    return found


def proofs(nodes: DataFrame, above: list[DataFrame], tops: DataFrame) -> DataFrame:
    """_row, _h and _path (siblings from the node up, before and after it) of ``nodes``, and the columns of ``tops`` but _height.

    ``tops`` has, for every tree, _g, _height, _path (what lies above its root) and what else its nodes are to have.
    """
    more = [c for c in tops.columns if c not in ("_g", "_height", "_path")]
    known = None
    for height in range(len(above), 0, -1):
        own = tops.where(F.col("_height") == height).select("_g", F.lit(0).cast("long").alias("_i"), "_path", *more)
        known = own if known is None else own.unionByName(known)
        kid = above[height - 1].select("_g", "_i", "_kids").join(known, ["_g", "_i"])
        kid = kid.select("_g", "_path", *more, F.col("_kids._h").alias("_all"), F.posexplode("_kids").alias("_p", "_kid"))
        before = F.concat_ws("", F.slice("_all", F.lit(1), F.col("_p")))
        after = F.concat_ws("", F.slice("_all", F.col("_p") + 2, F.size("_all")))
        own = F.array(F.struct(before.alias("before"), after.alias("after")))
        known = kid.select("_g", "_kid.*", F.concat(own, "_path").alias("_path"), *more)
        if height > 1:
            known = known.drop("_h", "_row")
    lone = nodes.where("_n = 1").join(tops.where("_height = 0"), "_g").select("_g", "_i", "_h", "_row", "_path", *more)
    return lone if known is None else lone.unionByName(known)


def folded(start: Column, path: str = "_path") -> Column:
    """The root that a digest and its siblings give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def manifest(docs: DataFrame, tampered: tuple[Column, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    ``tampered`` says which rows are tampered with and what text they have then; their folded_root is
    made from that text and the siblings as they were. Nulls have a digest of their own (``-``), so a
    null text is no empty one; texts of any length are hashed whole; a null source is one source, the
    first; rows without doc_id come first in their source and are never tampered with by the default.
    Rows that repeat, or share an id, are leaves of their own, in the order of their digests; of equal
    rows it is undefined which has which place, and the result is the same. An empty table gives an
    empty result; only doc_id, source, lang, n_chars and text are read.
    """
    which, text = tampered or without_line_feeds()
    fields = {c: F.col(c) for c in FIELDS}
    other = F.when(which & (text != F.col("text")), leaf({**fields, "text": text}))
    rows = checkpoint(docs.select("doc_id", "source", leaf(fields).alias("leaf"), other.alias("other")))
    rows = ranked(rows, "source", "doc_id", "leaf").withColumn("_k", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    sources = checkpoint(rows.groupBy("_k").agg(F.min("_at").alias("_g"), F.count(F.lit(1)).alias("_n")))
    own = F.struct("doc_id", "other").alias("_row")
    nodes = looked_up(rows, sources, ["_k"]).select("_g", (F.col("_at") - F.col("_g")).alias("_i"), F.col("leaf").alias("_h"), "_n", own)
    most, n_sources = sources.agg(F.max("_n"), F.count(F.lit(1))).first()
    above = levels(nodes, most or 0, fanout)

    tops = ranked(checkpoint(roots(nodes, above)), "_g")  # _g rises with the source
    tops = tops.select(F.lit(0).cast("long").alias("_g"), F.col("_at").alias("_i"), "_h", F.lit(n_sources).alias("_n"), F.struct("_g", "_height").alias("_row"))
    highest = levels(tops, n_sources, fanout)
    top = roots(tops, highest).first()  # one row
    start = F.array().cast(_PATH)
    seed = roots(tops, highest).select("_g", "_height", start.alias("_path"))
    subroots = proofs(tops, highest, seed).select("_row.*", F.col("_h").alias("subroot"), "_path")
    found = proofs(nodes, above, checkpoint(subroots))

    root = F.lit(top["_h"] if top else None).cast("string")
    siblings = F.concat_ws("", F.transform("_path", lambda s: F.concat(s["before"], s["after"])))
    found = found.select(
        "_row.doc_id", F.col("_h").alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.coalesce("_row.other", "_h")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the whole ``documents`` table, line feeds deleted where the id's crc32 is even."""
    return manifest(table(spark, sf_dir, "documents"))


def _sql_leaf(text: str) -> str:
    values = [*[f"{c}::varchar" for c in FIELDS[:-1]], text]
    return f"sha256({' || '.join(f"coalesce(strlen({v})::varchar || ':' || {v}, '-')" for v in values)})"


#: Levels by recursion; each row folds its own way up, level by level. DuckDB has no crc32, so a macro computes it by bits.
ORACLE = f"""
with recursive digits as (select doc_id, doc_id::varchar as s from documents),
crc as (select distinct doc_id, s, 1 as p, 4294967295::bigint as c from digits where s is not null
    union all select doc_id, s, p + 1, list_reduce(list_prepend(xor(c, ascii(s[p])::bigint), range(8)::bigint[]),
        lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end) from crc where p <= length(s)),
odd as (select doc_id as odd_id from crc where p = length(s) + 1 and xor(c, 4294967295::bigint) % 2 = 0),
l as (select row_number() over () as rid, d.doc_id, source, {_sql_leaf("text")} as leaf,
    case when odd_id is not null then {_sql_leaf("replace(text, chr(10), '')")} else {_sql_leaf("text")} end as other
    from documents d left join odd on d.doc_id = odd_id),
n as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i,
    coalesce('=' || source, '') as g, count(*) over (partition by source) as m from l),
up as (select 0 as lvl, g, i, leaf as h, m from n
    union all select lvl + 1, g, i // {FANOUT}, sha256(string_agg(h, '' order by i)), (max(m) + {FANOUT - 1}) // {FANOUT}
    from up where m > 1 group by lvl, g, i // {FANOUT}),
sub as (select g, h, lvl as height, row_number() over (order by encode(g)) - 1 as i, count(*) over () as m from up where m = 1),
top as (select 0 as lvl, i, h, m from sub
    union all select lvl + 1, i // {FANOUT}, sha256(string_agg(h, '' order by i)), (max(m) + {FANOUT - 1}) // {FANOUT}
    from top where m > 1 group by lvl, i // {FANOUT}),
kin as (select g, lvl, i, h, m from up where m > 1),
tkin as (select lvl, i, h, m from top where m > 1),
around as (select a.g, a.lvl, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as before,
    coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as after
    from kin a join kin b on a.g = b.g and a.lvl = b.lvl and a.i // {FANOUT} = b.i // {FANOUT} group by all),
taround as (select a.lvl, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as before,
    coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as after
    from tkin a join tkin b on a.lvl = b.lvl and a.i // {FANOUT} = b.i // {FANOUT} group by all),
fold as (select rid, g, 0 as lvl, i, other as h, '' as proof from n
    union all select f.rid, f.g, f.lvl + 1, f.i // {FANOUT}, sha256(a.before || f.h || a.after), f.proof || a.before || a.after
    from fold f join around a on f.g = a.g and f.lvl = a.lvl and f.i = a.i),
done as (select f.rid, s.i, f.h, f.proof, s.h as subroot from fold f join sub s on f.g = s.g and f.lvl = s.height),
tfold as (select rid, 0 as lvl, i, h, proof, subroot from done
    union all select f.rid, f.lvl + 1, f.i // {FANOUT}, sha256(a.before || f.h || a.after), f.proof || a.before || a.after, f.subroot
    from tfold f join taround a on f.lvl = a.lvl and f.i = a.i)
select n.doc_id, n.leaf, t.subroot, r.h as root, sha256(t.proof) as proof_sha256, t.h as folded_root, t.h = r.h as verified
from tfold t join (select h, lvl from top where m = 1) r on t.lvl = r.lvl join n on n.rid = t.rid
"""
