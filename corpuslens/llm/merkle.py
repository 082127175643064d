"""Merkle manifest of a table: a hash tree of each source's documents, a tree of the sources, a proof for each document.

H is the lowercase hex SHA-256 of its inputs' concatenation; digests are joined as hex text. A tree is reduced in runs
of ARITY neighbours, the last one of fewer; a single node is its own root.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import scan, stored

ARITY = 3
#: Levels that one superblock reduces: it takes ARITY ** LEVELS nodes.
LEVELS = 6
NODES = "tree string, place long, n long, node string"
OUTER = "tree string, place long, outer string, subroot string, root string"
PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


# --- leaves


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """H of the values: `-` for a null, else the UTF-8 byte count, a colon and the value."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, given: tree orders sources bytewise with null first; given is the leaf of the tampered row.

    Tampering deletes the line feeds of the text where 2 divides the CRC-32 of the decimal doc_id. A null doc_id or
    text is not tampered with.
    """
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    values = [F.col(c) for c in names]
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    text = F.col("text").cast("string")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    hashed = docs.select(*names, tree.alias("tree"), leaf_hash(*values).alias("leaf"))
    given = F.when(tampered, leaf_hash(*values[:-1], F.replace(text, F.lit("\n"), F.lit("")))).otherwise(F.col("leaf"))
    return hashed.select("tree", F.col("doc_id").cast("long").alias("doc_id"), "leaf", given.alias("given"))


# --- order


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with place, their number from 0 in their tree by `order`, and n, the rows of the tree.

    Rows are range-partitioned by tree and order, so a large tree lies in many tasks. What each task holds of a tree is
    counted, and the counts before it give its first number; no tree is sorted or counted in one task.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = rows.repartitionByRange(tasks, "tree", *order).sortWithinPartitions("tree", *order)
    numbered = stored(inside.withColumn("at", F.monotonically_increasing_id()), "merkle-order").withColumn("task", F.shiftright("at", 33))
    held = numbered.groupBy("tree", "task").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    by_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("held").over(by_tree.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select("tree", "task", (before - F.col("first")).alias("shift"), F.sum("held").over(by_tree).alias("n"))
    joined = numbered.join(starts, ["tree", "task"])
    return joined.select(*rows.columns, (F.col("at") + F.col("shift")).alias("place"), "n")


# --- inside a superblock


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes: list[str], n: int, most: int) -> list[list[str]]:
    """The nodes of a superblock level by level: `most` up, or to the root of a tree of n nodes that fits one."""
    found = [nodes]
    while len(found) <= most and (n > ARITY**most or len(found[-1]) > 1):
        below = found[-1]
        found.append([sha("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return found


def runs_of(levels: list[list[str]], place: int) -> list[str]:
    """On each level the run of the node over `place`, its members joined by commas, itself as `-`."""
    runs = []
    for nodes in levels[:-1]:
        first = place - place % ARITY
        runs.append(",".join("-" if i == place else nodes[i] for i in range(first, min(first + ARITY, len(nodes)))))
        place //= ARITY
    return runs


def fold(leaf: str, runs: list[str]) -> str:
    for run in runs:
        leaf = sha(run.replace("-", leaf).replace(",", ""))
    return leaf


def proof(runs: list[str]) -> str:
    """H of the siblings from left to right, level by level."""
    return sha("".join(runs).replace("-", "").replace(",", ""))


def _reduced(key: tuple, block: pd.DataFrame, most: int) -> pd.DataFrame:
    block = block.sort_values("place")
    n = int(block["n"].iloc[0])
    node = levels_of(block["node"].tolist(), n, most)[-1][0]
    return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "n": [-(-n // ARITY**most)], "node": [node]})


def _opened(inner: pd.DataFrame, outer: pd.DataFrame, most: int) -> tuple[pd.DataFrame, list[list[str]], list[str], pd.Series]:
    """The superblock in order, its levels, the runs above it, and what it was handed."""
    inner = inner.sort_values("place")
    above = outer.iloc[0]
    levels = levels_of(inner["node"].tolist(), int(inner["n"].iloc[0]), most)
    return inner, levels, [run for run in above["outer"].split(";") if run], above


def _handed_down(key: tuple, inner: pd.DataFrame, outer: pd.DataFrame, most: int) -> pd.DataFrame:
    """The outer nodes of each superblock below."""
    inner, levels, beyond, above = _opened(inner, outer, most)
    paths = [";".join(runs_of(levels, i) + beyond) for i in range(len(inner))]
    subroot = inner["subroot"].where(inner["subroot"].notna(), above["subroot"])
    return pd.DataFrame({"tree": inner["below"], "place": inner["below_place"], "outer": paths, "subroot": subroot, "root": above["root"]})


def _proven(key: tuple, inner: pd.DataFrame, outer: pd.DataFrame, most: int) -> pd.DataFrame:
    """Proof and folded root of each document."""
    inner, levels, beyond, above = _opened(inner, outer, most)
    paths = [runs_of(levels, i) + beyond for i in range(len(inner))]
    folded = [fold(leaf, path) for leaf, path in zip(inner["given"], paths, strict=True)]
    return pd.DataFrame(
        {
            "doc_id": inner["doc_id"], "leaf": inner["node"], "subroot": above["subroot"], "root": above["root"], "proof_sha256": [proof(path) for path in paths],
            "folded_root": folded, "verified": [root == above["root"] for root in folded],
        }
    )


# --- the exchange


def _blocked(rows: DataFrame, most: int) -> DataFrame:
    return rows.withColumn("block", F.expr(f"place div {ARITY**most}"))


def _met(nodes: DataFrame, outer: DataFrame, most: int):
    """Nodes and the outer nodes of their superblock, cogrouped."""
    return _blocked(nodes, most).groupBy("tree", "block").cogroup(outer.withColumnRenamed("place", "block").groupBy("tree", "block"))


def _grown(nodes: DataFrame, n: int, most: int) -> list[DataFrame]:
    """Tables of nodes, each of the roots of the superblocks of the one before; the last has one node a tree."""
    tables = [nodes]
    while True:
        blocks = _blocked(tables[-1].select("tree", "place", "n", "node"), most).groupBy("tree", "block")
        tables.append(stored(blocks.applyInPandas(partial(_reduced, most=most), NODES), "merkle-nodes"))
        if n <= ARITY**most:
            return tables
        n = -(-n // ARITY**most)


def _descended(tables: list[DataFrame], outer: DataFrame, most: int) -> DataFrame:
    """Outer nodes of what the first of the tables stands for, from those of the last one's nodes."""
    for nodes in tables[-2::-1]:
        named = nodes if "below" in nodes.columns else nodes.withColumns({"below": F.col("tree"), "below_place": F.col("place"), "subroot": F.lit(None).cast("string")})
        outer = stored(_met(named, outer, most).applyInPandas(partial(_handed_down, most=most), OUTER), "merkle-outer")
    return outer


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of doc_id, source, lang, n_chars, text.

    The trees are reduced in superblocks of ARITY ** levels neighbours: a first exchange gives the root of each, and of the
    superblocks over them, up to the root of all sources. On the way back superblocks and the nodes they need from
    outside are cogrouped; each is reduced again, its proofs are completed from the outer nodes, and the leaf that a
    reader holds (tampered or not) is folded up to the root. A task holds one superblock, however large a source is.

    Rows of one doc_id are ordered by their leaves; equal rows are leaves of their own. Nulls are values of their own:
    a null source is a tree before all others, a null doc_id comes first. An empty table gives no rows; further
    columns are not read.
    """
    ordered = placed(leaves(docs), "doc_id", "leaf").withColumnRenamed("leaf", "node")
    ordered = stored(ordered, "merkle-leaves")
    largest = ordered.agg(F.max("n")).first()[0]
    if largest is None:
        return docs.sparkSession.createDataFrame([], PROVEN)
    low = _grown(ordered, largest, levels)
    sources = low[-1].select(F.lit("").alias("tree"), F.col("tree").alias("below"), "node")
    tops = placed(sources, "below").select("*", F.lit(0).cast("long").alias("below_place"), F.col("node").alias("subroot"))
    tops = stored(tops, "merkle-sources")
    high = _grown(tops, tops.first()["n"], levels)
    root = high[-1].select("tree", "place", F.lit("").alias("outer"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    outer = _descended(low[1:], _descended(high, root, levels), levels)
    return _met(ordered, outer, levels).applyInPandas(partial(_proven, most=levels), PROVEN)


def op12_merkle(spark, sf_dir):
    return manifest(scan(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))


def _sql_leaf(*values: str) -> str:
    return f"sha256({' || '.join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)})"


_SQL_VALUES = ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)")
#: The same in SQL. CRC-32 bit by bit: eight steps a byte of the decimal doc_id.
OP12_SQL = f"""
with recursive hashed as (
  select row_number() over () as r, doc_id, case when source is null then '' else 's' || source end as tree, text,
    {_sql_leaf(*_SQL_VALUES, "text")} as leaf, {_sql_leaf(*_SQL_VALUES, "replace(text, chr(10), '')")} as cut
  from documents
), bits as (
  select d, cast(4294967295 as bigint) as c, 0 as i, 0 as b from (select distinct cast(doc_id as varchar) as d from documents where doc_id is not null)
  union all
  select d, case when b = 0 then xor(c, ascii(substring(d, i + 1, 1)))
      when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, case when b = 8 then i + 1 else i end, (b + 1) % 9
  from bits where i < length(d)
), even as (
  select d, xor(c, 4294967295) % 2 = 0 as tampered from bits where i = length(d)
), placed as (
  select h.*, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by tree) as n,
    case when coalesce(tampered, false) and text is not null then cut else leaf end as given
  from hashed h left join even on cast(doc_id as varchar) = d
), up as (
  select tree, 0 as level, place, n, leaf as node from placed
  union all
  select tree, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(node, '' order by place)) from up where n > 1 group by tree, level, place // 3, n
), sources as (
  select tree, node as subroot, row_number() over (order by tree) - 1 as place, count(*) over () as n from up where n = 1
), top as (
  select 0 as level, place, n, subroot as node from sources
  union all
  select level + 1, place // 3, (n + 2) // 3, sha256(string_agg(node, '' order by place)) from top where n > 1 group by level, place // 3, n
), sides as (
  select a.tree, a.level, a.place, coalesce(string_agg(b.node, '' order by b.place) filter (where b.place < a.place), '') as l,
    coalesce(string_agg(b.node, '' order by b.place) filter (where b.place > a.place), '') as r
  from up a join up b on a.tree = b.tree and a.level = b.level and a.place // 3 = b.place // 3 where a.n > 1 group by all
), top_sides as (
  select a.level, a.place, coalesce(string_agg(b.node, '' order by b.place) filter (where b.place < a.place), '') as l,
    coalesce(string_agg(b.node, '' order by b.place) filter (where b.place > a.place), '') as r
  from top a join top b on a.level = b.level and a.place // 3 = b.place // 3 where a.n > 1 group by all
), low as (
  select r as id, tree, 0 as level, place, given as h, '' as proof from placed
  union all
  select id, low.tree, low.level + 1, low.place // 3, sha256(l || h || r), proof || l || r
  from low join sides on low.tree = sides.tree and low.level = sides.level and low.place = sides.place
), met as (
  select id, tree, h, proof from low qualify row_number() over (partition by id order by level desc) = 1
), high as (
  select id, 0 as level, place, h, proof from met join sources using (tree)
  union all
  select id, high.level + 1, high.place // 3, sha256(l || h || r), proof || l || r
  from high join top_sides on high.level = top_sides.level and high.place = top_sides.place
), proven as (
  select id, h, proof from high qualify row_number() over (partition by id order by level desc) = 1
)
select doc_id, leaf, subroot, (select node from top where n = 1) as root, sha256(proof) as proof_sha256, h as folded_root,
  h = (select node from top where n = 1) as verified
from placed join sources using (tree) join proven on id = r
"""
