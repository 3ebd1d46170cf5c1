"""A Merkle manifest of a table: one root for all rows, and for each row the siblings that lead to it.

Leaves are digests of rows. Where a leaf stands in its group is a rank, and ranks come from bitmaps, not from sorting:
each group's ids are set in words of 64 bits (only words with a bit exist, so sparse ids cost no room), and a directory
of popcounts on top of them, 32,768 children a node, says how many ids stand before a word. A row's place is that number plus
the bits below its own. Rows that share an id are counted in their word and placed by the first digits of their digest.

Levels are reduced in keyed slot arrays: nodes of one group whose index agrees but for its last six base-3 digits
meet in one array by slot, at most 729, and six levels are hashed there; what is left goes on as a node of the next array.
So no task ever holds more than 729 nodes of a group, whatever the group's size, and a pass shrinks the nodes 729 times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, durable, read
from .sql import crc32

FAN = 3
#: Levels hashed in one slot array, and the nodes it holds.
DEPTH = 6
SLOTS = FAN**DEPTH
#: The word of rows without an id: below those of all longs.
_NO_ID = -(1 << 57) - 1


def H(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs, concatenated; digests go in as hex text."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(df: DataFrame, columns: list[str], **other: Column) -> Column:
    """The digest of a row: each column as its number of UTF-8 bytes, a colon and its value, or `-` for null.
    `other` stands in for a column's value."""
    shown = [other.get(c, F.col(c)).cast("string") for c in columns]
    return H(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in shown))


def _before(by: list[str], order: str, value: str = "rows") -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _same(*pairs: tuple[str, str]) -> Column:
    out = F.lit(True)
    for x, y in pairs:
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def places(leaves: DataFrame) -> DataFrame:
    """(grp, id, leaf, n, ...) distinct rows with their number -> the same with `place`, the number of rows before
    them in their group, and `size`, the group's number of rows.

    Rows go by id (null first), then leaf. `n` equal rows take the places from `place` on."""
    rows = leaves.withColumn("w", F.coalesce(F.shiftright("id", 6), F.lit(_NO_ID))).withColumn("bit", F.coalesce(F.col("id").bitwiseAND(63), F.lit(0)).cast("int"))
    words = durable(rows.groupBy("grp", "w").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("n").alias("rows")), "merkle-words")
    levels = [words]
    for _ in range(3):
        levels.append(levels[-1].groupBy("grp", F.shiftright("w", 15).alias("w")).agg(F.sum("rows").alias("rows")))
    # downwards: what stands before a node is what stands before its parent and its elder siblings, 32,767 at most
    top = levels[3].withColumn("before", _before(["grp"], "w")).withColumn("size", F.sum("rows").over(Window.partitionBy("grp")))
    for level in (levels[2], levels[1], levels[0]):
        up = top.select(F.col("grp").alias("ug"), F.col("w").alias("up"), F.col("before").alias("over"), "size")
        own = level.withColumn("parent", F.shiftright("w", 15))
        own = own.withColumn("own", _before(["grp", "parent"], "w"))
        top = own.join(up, _same(("grp", "ug"), ("parent", "up"))).withColumn("before", F.col("own") + F.col("over")).drop("ug", "up", "parent", "own", "over")
    on = top.select(F.col("grp").alias("ug"), F.col("w").alias("up"), "bits", "rows", "before", "size")
    rows = rows.join(on, _same(("grp", "ug"), ("w", "up"))).drop("ug", "up")
    crowded = F.col("rows") > F.bit_count("bits")
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    own = [*leaves.columns, "place", "size"]
    plain = rows.where(~crowded).withColumn("place", F.col("before") + below)
    return plain.select(own).unionByName(_crowded(rows.where(crowded)).select(own))


def _crowded(rows: DataFrame) -> DataFrame:
    """Words in which an id has several rows: places by counts of ids, then of the digests' first three digits, then in one such bin."""
    keys = ["grp", "w", "bit"]
    rows = rows.withColumn("bin", F.substring("leaf", 1, 3))
    bins = rows.groupBy(*keys, "bin").agg(F.sum("n").alias("here"))
    ids = bins.groupBy(*keys).agg(F.sum("here").alias("here"))
    ids = ids.select(F.col("grp").alias("g1"), F.col("w").alias("v1"), F.col("bit").alias("b1"), _before(["grp", "w"], "bit", "here").alias("by_id"))
    bins = bins.select(F.col("grp").alias("g2"), F.col("w").alias("v2"), F.col("bit").alias("b2"), F.col("bin").alias("bin2"), _before(keys, "bin", "here").alias("by_bin"))
    bins = bins.join(ids, _same(("g1", "g2"), ("v1", "v2"), ("b1", "b2")))
    rows = rows.withColumn("by_leaf", _before([*keys, "bin"], "leaf", "n"))
    rows = rows.join(bins, _same(("grp", "g2"), ("w", "v2"), ("bit", "b2"), ("bin", "bin2")))
    return rows.withColumn("place", F.col("before") + F.col("by_id") + F.col("by_bin") + F.col("by_leaf"))


_PAIR = "struct<l:string,r:string>"


def _levels(nodes: Column, depth: Column) -> Column:
    """All levels of a slot array, the nodes first: runs of three become their digest, `depth` times."""

    def up(done, _):
        last = F.element_at(done, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / FAN).cast("int"))
        return F.concat(done, F.array(F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(last, i * FAN + 1, FAN), ""), 256))))

    return F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(1), depth), F.array(nodes), up)


def _path(levels: Column, slot: Column, depth: Column) -> Column:
    """What stands left and right of a node's ancestors in their runs, from the node upwards, inside one slot array."""

    def pair(k):
        row, at = F.element_at(levels, k + 1), F.floor(slot / F.pow(F.lit(FAN), k)).cast("int")
        own = at % FAN
        left = F.array_join(F.slice(row, at - own + 1, own), "")
        right = F.array_join(F.slice(row, at + 2, FAN - 1 - own), "")
        return F.struct(left.alias("l"), right.alias("r"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(DEPTH - 1)), F.lit(1), depth), pair)


def ascend(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """Slot arrays, bottom up, of (grp, place, n, hash, size, *carried): `n` equal nodes from `place` on, `size` of the group's nodes.

    Each is (grp, block, slots, depth, levels, top), written; the last has one block a group, whose top is the group's root."""
    passes, now = [], nodes
    last = F.col("place") + F.col("n") - 1
    while True:
        # copies are dealt to their blocks first, and only there become single nodes
        block = now.withColumn("block", F.explode(F.sequence(F.floor(F.col("place") / SLOTS), F.floor(last / SLOTS))))
        own = F.sequence(F.greatest("place", F.col("block") * SLOTS), F.least(last, (F.col("block") + 1) * SLOTS - 1))
        block = block.repartition("grp", "block").withColumn("at", F.explode(own)).withColumn("slot", (F.col("at") % SLOTS).cast("int"))
        item = F.struct("slot", "hash", *(carried if not passes else []))
        block = block.groupBy("grp", "block").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(item)).alias("slots"))
        depth = sum((F.when(F.col("size") > FAN**k, 1).otherwise(0) for k in range(DEPTH)), F.lit(0))
        block = block.withColumn("depth", depth.cast("int")).withColumn("levels", _levels(F.col("slots.hash"), F.col("depth")))
        block = durable(block.withColumn("top", F.element_at(F.element_at("levels", -1), 1)), "merkle-slots")
        passes.append(block)
        if not block.agg(F.max("block")).first()[0]:
            return passes
        # a group that is done has one node left and goes through unchanged
        now = block.select("grp", F.col("block").alias("place"), F.lit(1).alias("n"), F.col("top").alias("hash"), F.ceil(F.col("size") / SLOTS).alias("size"))


def descend(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """(grp, place, item, subroot, root, path) of the lowest nodes; above: (grp, place 0, subroot, root, path), a row a group."""
    for block in reversed(passes):
        up = above.select(F.col("grp").alias("ug"), F.col("place").alias("up"), "subroot", "root", F.col("path").alias("rest"))
        block = block.join(up, _same(("grp", "ug"), ("block", "up")))
        paths = F.transform("slots", lambda s: F.struct(s.alias("s"), _path(F.col("levels"), s["slot"], F.col("depth")).alias("own")))
        block = block.select("grp", "block", "subroot", "root", "rest", F.explode(paths).alias("e"))
        above = block.select("grp", (F.col("block") * SLOTS + F.col("e.s.slot")).alias("place"), F.col("e.s").alias("item"), "subroot", "root", F.concat("e.own", "rest").alias("path"))
    return above


def _in_order(groups: DataFrame) -> DataFrame:
    """(grp, top) with `place`, the number of groups before it, null first and by UTF-8 bytes: sorted in ranges, which are then offset."""
    ranged = groups.repartitionByRange("grp").sortWithinPartitions("grp").withColumn("at", F.monotonically_increasing_id())
    ranged = durable(ranged.withColumn("range", F.shiftright("at", 33)), "merkle-groups")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("rows")).withColumn("_", F.lit(0))
    sizes = sizes.select(F.col("range").alias("r"), _before(["_"], "range").alias("before"), F.sum("rows").over(Window.partitionBy("_")).alias("size"))
    # a row a range
    return ranged.join(F.broadcast(sizes), F.col("range") == F.col("r")).select("grp", "top", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place"), "size")


def manifest(df: DataFrame, id: str, group: str, columns: list[str], altered: dict[str, Column] | None = None) -> DataFrame:
    """(grp, id, place, leaf, other, subroot, root, path), one row per row of df.

    Leaves are digests of `columns`. Within a group they go by id (long, null first), equal ids by leaf; a null group is a group and
    comes first. path: for each level from the leaf to the root what stands left and right in the node's run of three, groups' levels last.
    `altered` gives columns other values; `other` is the leaf that results, null where it is the same. Equal rows
    are counted, not repeated, until they are dealt to their slot arrays. Other columns are not read; an empty table gives no rows."""
    leaf, other = leaf_of(df, columns), F.lit(None).cast("string")
    if altered:
        changed = F.lit(False)
        for c, v in altered.items():
            changed = changed | ~v.eqNullSafe(F.col(c))
        other = F.when(changed, leaf_of(df, columns, **altered))
    leaves = df.select(F.col(group).alias("grp"), F.col(id).cast("long").alias("id"), leaf.alias("leaf"), other.alias("other"))
    leaves = durable(leaves.groupBy("grp", "id", "leaf").agg(F.max("other").alias("other"), F.count("*").alias("n")), "merkle-leaves")
    passes = ascend(places(leaves).select("grp", "place", "n", F.col("leaf").alias("hash"), "size", "id", "other"), ["id", "other"])
    discard(leaves)
    groups = _in_order(passes[-1].select("grp", "top"))
    nodes = groups.select(F.lit("").alias("grp"), "place", F.lit(1).alias("n"), F.col("top").alias("hash"), "size", F.col("grp").alias("of"))
    over = ascend(nodes, ["of"])
    roots = over[-1].select("grp", F.lit(0).alias("place"), F.lit("").alias("subroot"), F.col("top").alias("root"), F.expr(f"cast(array() as array<{_PAIR}>)").alias("path"))
    above = descend(over, roots).select(F.col("item.of").alias("grp"), F.lit(0).alias("place"), F.col("item.hash").alias("subroot"), "root", "path")
    rows = descend(passes, above)
    return rows.select("grp", F.col("item.id").alias("id"), "place", F.col("item.hash").alias("leaf"), F.col("item.other").alias("other"), "subroot", "root", "path")


def proof(path: Column) -> Column:
    """The siblings, level by level, left to right, as one string."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["l"], p["r"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["l"], h, p["r"]), 256))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns: the manifest of documents, and each proof folded from its tampered leaf."""
    docs = read(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], {"text": tampered})
    rows = rows.withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("path")))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _part(x: str) -> str:
    return f"case when {x} is null then '-' else octet_length(encode({x}::varchar))::varchar || ':' || {x}::varchar end"


def _siblings(of: str, by: str) -> str:
    """Per node of a tree that is not its root, what stands left and right of it in its run."""
    own, same = (f"a.{by}, ", f"a.{by} is not distinct from b.{by} and ") if by else ("", "")
    return f"""select {own}a.lvl, a.idx, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx < a.idx), '') as l, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx > a.idx), '') as r
 from {of} a join {of} b on {same}a.lvl = b.lvl and a.idx // 3 = b.idx // 3 where a.n > 1 group by {own}a.lvl, a.idx"""


#: Levels by recursion, leaves placed by sorting: another way to the same manifest.
OP13_SQL = f"""
WITH RECURSIVE d as (select doc_id, {" || ".join(map(_part, ("doc_id", "source", "lang", "n_chars")))} as p, source, text, case when {crc32("coalesce(doc_id, 0)::varchar")} % 2 = 0 and doc_id is not null then replace(text, chr(10), '') else text end as t2 from documents),
 lv as (select doc_id, source, sha256(p || {_part("text")}) as leaf, sha256(p || {_part("t2")}) as other from d),
 pl as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place, row_number() over () as rid from lv),
 up as (select source, 0 as lvl, place as idx, leaf as h, count(*) over (partition by source) as n from pl
  union all select source, lvl + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (any_value(n) + 2) // 3 from up where n > 1 group by source, lvl, idx // 3),
 sub as (select source, h as subroot, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n from up where n = 1),
 tp as (select 0 as lvl, place as idx, subroot as h, n from sub union all select lvl + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (any_value(n) + 2) // 3 from tp where n > 1 group by lvl, idx // 3),
 sb as ({_siblings("up", "source")}), st as ({_siblings("tp", "")}),
 f1 as (select rid, source, place as idx, 0 as lvl, other as h, '' as proof from pl
  union all select rid, f1.source, f1.idx // 3, f1.lvl + 1, sha256(l || h || r), proof || l || r from f1 join sb on sb.source is not distinct from f1.source and sb.lvl = f1.lvl and sb.idx = f1.idx),
 e1 as (select rid, arg_max(h, lvl) as h, arg_max(proof, lvl) as proof from f1 group by rid),
 f2 as (select e1.rid, sub.place as idx, 0 as lvl, h, proof from e1 join pl using (rid) join sub on sub.source is not distinct from pl.source
  union all select rid, f2.idx // 3, f2.lvl + 1, sha256(l || h || r), proof || l || r from f2 join st on st.lvl = f2.lvl and st.idx = f2.idx),
 e2 as (select rid, arg_max(h, lvl) as folded_root, arg_max(proof, lvl) as proof from f2 group by rid)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded_root, folded_root = root as verified
from pl join e2 using (rid) join sub on sub.source is not distinct from pl.source, (select h as root from tp where n = 1)
"""
