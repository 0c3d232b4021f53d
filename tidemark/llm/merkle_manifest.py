"""Merkle manifest of a dataset: nodes labelled by the interval of leaf ranks that they cover.

Every row is a leaf of the tree of its language; the roots of those trees are the leaves of
one more tree. A node is a row (tree, level, lo, hi, digest): it covers the leaves of ranks
lo to hi, end exclusive. All that a proof needs follows from these labels:

* a node's parent is the node one level up whose interval contains its own, found by a join
  on the bucket ``lo >> level`` of that level;
* its sibling covers what is left of the parent's interval without its own;
* a leaf's ancestors are attached by the same containment join, in bands of ``BAND`` levels:
  a leaf meets those of its lowest band only, and takes the rest from the node on top of that.

Ranks come from range partitions whose counts are added up, and digests of ``BLOCK`` levels are
made from blocks of 2^BLOCK neighbours, so no task holds a tree. Stored and shuffled digests
are bytes; they are hashed and told as hex text.

Defined results. Null columns are written ``-``; a null text and an empty one differ. A null
language is a tree of its own, the first. Null ids come first; rows with equal ids stand by
their digests, and wholly equal rows beside each other. An empty table has no rows and an empty
manifest. Columns that are not hashed are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_join, small, written

#: Columns of a document that its leaf is made of, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Levels that are hashed together, from 2^BLOCK nodes.
BLOCK = 8

#: Levels of a band: so many rows a node are joined with ancestors.
BAND = 4

#: Trees up to which their roots' paths are broadcast (about 70 bytes a level, so 10 MB).
MOST_TREES = 10_000

_PATH = "array<struct<left:boolean,sibling:binary>>"


def field(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, altered): the digest of each row and, where 7 divides the checksum of the id, that of a row with one more character counted."""
    cols = {c: F.col(c) for c in FIELDS}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("tree"),
        "doc_id",
        digest(*cols.values()).alias("leaf"),
        F.when(hit & F.col("n_chars").isNotNull(), digest(*(cols | {"n_chars": F.col("n_chars") + 1}).values())).alias("altered"),
    )


def height(size: Column) -> Column:
    """Levels above the leaves of a tree of so many leaves."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def numbered(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """df with ``rank``, from 0 without gaps in each tree, and ``size``, the tree's number of leaves.

    Rows are dealt into ranges of (tree, order) and written; the counts of ranges are added up.
    """
    at = written(df.repartitionByRange(tree, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = at.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(tree)
    counts = written(counts.select(tree, "_part", (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_offset"), F.sum("_n").over(w).alias("size")), "counts")
    row = F.row_number().over(Window.partitionBy(tree, "_part").orderBy(*order)) - 1
    out = at.join(small(counts, counts.count()), [tree, "_part"]).withColumn("rank", F.col("_offset") + row)
    return out.drop("_part", "_offset")


def _raised(nodes: Column) -> Column:
    """The nodes one level above a list of neighbours: each of two, the last of fewer."""

    def parent(i: Column) -> Column:
        a, b = F.get(nodes, i * 2), F.get(nodes, i * 2 + 1)
        both = F.concat(text(a["digest"]), F.coalesce(text(b["digest"]), F.lit("")))
        return F.struct(a["lo"].alias("lo"), F.coalesce(b["hi"], a["hi"]).alias("hi"), F.unhex(F.sha2(both, 256)).alias("digest"))

    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1), parent)


def manifest(ranked: DataFrame) -> DataFrame:
    """All nodes (tree, size, level, lo, hi, digest) over leaves (tree, size, rank, leaf)."""
    base = ranked.select("tree", "size", F.lit(0).alias("level"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("digest"))
    tallest = ranked.agg(F.max(height(F.col("size")))).first()[0] or 0
    made = [base]
    for low in range(0, tallest, BLOCK):
        block = base.where(height(F.col("size")) > low).groupBy("tree", "size", F.shiftright("lo", low + BLOCK).alias("_block"))
        row = block.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("_0"))
        for k in range(1, BLOCK + 1):
            row = row.withColumn(f"_{k}", F.when(height(F.col("size")) >= low + k, _raised(F.col(f"_{k - 1}"))))
        levels = F.array(*[F.struct(F.lit(low + k).alias("level"), F.col(f"_{k}").alias("nodes")) for k in range(1, BLOCK + 1)])
        rows = row.select("tree", "size", F.explode(levels).alias("_l")).select("tree", "size", "_l.level", F.explode("_l.nodes").alias("_n"))
        rows = written(rows.select("tree", "size", "level", "_n.lo", "_n.hi", "_n.digest"), "nodes")
        made.append(rows)
        base = rows.where(F.col("level") == low + BLOCK)
    return reduce(DataFrame.unionByName, made)


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("level") == height(F.col("size"))).select("tree", F.col("digest").alias("root"))


def siblings(nodes: DataFrame) -> DataFrame:
    """(tree, level, lo, hi, left, sibling) of every node below a root: the rest of its parent's interval; sibling is null where nothing is left."""
    below = nodes.where(F.col("level") < height(F.col("size"))).select("tree", "level", "lo", "hi", (F.col("level") + 1).alias("_up"), F.expr("shiftright(lo, level + 1)").alias("_bucket"))
    over = nodes.where("level > 0").select("tree", F.col("level").alias("_up"), F.expr("shiftright(lo, level)").alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    inside = below.join(over, ["tree", "_up", "_bucket"]).where("_lo <= lo and hi <= _hi")
    left = F.col("_lo") < F.col("lo")
    rest = inside.select("tree", "level", "lo", "hi", left.alias("left"), F.when(left, F.col("_lo")).otherwise(F.col("hi")).alias("_from"), F.when(left, F.col("lo")).otherwise(F.col("_hi")).alias("_to"))
    other = nodes.select("tree", "level", F.col("lo").alias("_from"), F.col("hi").alias("_to"), F.col("digest").alias("sibling"))
    return rest.join(other, ["tree", "level", "_from", "_to"], "left").drop("_from", "_to")


def paths(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """ranked with ``path``: the siblings of each leaf and of its ancestors, from the leaf up; empty for a lone leaf."""
    tallest = max(1, ranked.agg(F.max(height(F.col("size")))).first()[0] or 0)
    steps = written(siblings(nodes), "siblings")
    above = None
    for low in reversed(range(0, tallest, BAND)):
        top = F.least(F.lit(low + BAND), height(F.col("size"))) - 1
        at = nodes.where((F.col("level") == low) & (height(F.col("size")) > low)).select("tree", F.col("lo").alias("rank"), F.col("hi").alias("_hi"), F.explode(F.sequence(F.lit(low), top)).alias("level"))
        at = at.withColumn("_bucket", F.expr("shiftright(rank, level)"))
        over = steps.where((F.col("level") >= low) & (F.col("level") < low + BAND)).withColumn("_bucket", F.expr("shiftright(lo, level)"))
        near = at.join(over, ["tree", "level", "_bucket"]).where("lo <= rank and _hi <= hi")
        band = near.groupBy("tree", "rank").agg(F.sort_array(F.collect_list(F.struct("level", "left", "sibling"))).alias("_near"))
        band = band.select("tree", "rank", F.transform("_near", lambda s: F.struct(s["left"].alias("left"), s["sibling"].alias("sibling"))).cast(_PATH).alias("path"))
        if not low:
            band = ranked.join(band, ["tree", "rank"], "left").withColumn("path", F.coalesce("path", F.array().cast(_PATH)))
        if above is not None:
            band = band.withColumn("_top", F.shiftright("rank", low + BAND)).join(above, ["tree", "_top"], "left").drop("_top")
            band = band.withColumn("path", F.concat("path", F.coalesce("_more", F.array().cast(_PATH)))).drop("_more")
        if low:
            above = band.select("tree", F.shiftright("rank", low).alias("_top"), F.col("path").alias("_more"))
    return band


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def up(acc: Column, s: Column) -> Column:
        own, other = text(acc), F.coalesce(text(s["sibling"]), F.lit(""))
        return F.unhex(F.sha2(F.when(s["left"], F.concat(other, own)).otherwise(F.concat(own, other)), 256))

    return F.aggregate(path, leaf, up)


def proven(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, path, altered of every row, and ``folded_root`` of the altered leaf where there is one, else of the leaf; digests as bytes."""
    ranked = written(numbered(leaves(docs), "tree", ["doc_id", "leaf"]), "leaves")
    nodes = manifest(ranked)
    trees = numbered(roots(nodes).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf")), "tree", ["name"])
    trees = written(trees, "trees")
    top = manifest(trees)
    root = roots(top).first()
    upper = written(paths(trees, top).select(F.col("name").alias("tree"), F.col("leaf").alias("subroot"), F.col("path").alias("_more")), "trees")
    out = paths(ranked, nodes)
    out = out.join(F.broadcast(upper), "tree") if upper.count() <= MOST_TREES else dealt_join(out, upper, "tree", "rank")
    out = out.withColumn("path", F.concat("path", "_more"))
    return out.select("doc_id", "leaf", "subroot", F.lit(bytes(root["root"]) if root else None).cast("binary").alias("root"), "path", "altered", folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"))


def proofs(docs: DataFrame) -> DataFrame:
    """The digest of every row's proof, and whether the row, altered or not, still leads to the root."""
    others = F.array_join(F.transform("path", lambda s: F.coalesce(text(s["sibling"]), F.lit(""))), "")
    told = {c: text(F.col(c)) for c in ("leaf", "subroot", "root")}
    return proven(docs).select("doc_id", *[c.alias(n) for n, c in told.items()], F.sha2(others, 256).alias("proof_sha256"), text(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(tree, lo, hi) of the leaves in manifest ``new`` whose interval has another digest in manifest ``old``, or none.

    From the top band down, what lies below an equal node is left out before the next comparison.
    """
    tallest = new.agg(F.max("level")).first()[0] or 0
    known = old.select("tree", "level", "lo", "hi", "digest")
    same = None
    for low in reversed(range(0, max(tallest, 1), BAND)):
        here = new.where(F.col("level") == low).withColumn("_top", F.shiftright("lo", low + BAND))
        if same is not None:
            here = here.join(same, ["tree", "_top"], "left_anti")
        same = here.join(known, ["tree", "level", "lo", "hi", "digest"], "left_semi").select("tree", F.shiftright("lo", low).alias("_top"))
    return here.join(known, ["tree", "level", "lo", "hi", "digest"], "left_anti").select("tree", "lo", "hi")


_FIELD = "case when {0} is null then '-' else strlen(({0})::varchar) || ':' || ({0})::varchar end"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"

_RAISED = """{name}(tree, level, idx, digest, many) as (
    select tree, 0, idx, digest, many from {leaves}
    union all
    select tree, level + 1, idx // 2, sha256(string_agg(digest, '' order by idx)), (any_value(many) + 1) // 2
    from {name} where many > 1 group by tree, level, idx // 2)"""

_STEPS = """select a.tree, a.idx, list(case when a.idx >> n.level & 1 = 1 then 'L' else 'R' end || coalesce(s.digest, '') order by n.level) as steps
    from {leaves} a join (select distinct tree, level from {nodes} where many > 1) n on n.tree = a.tree
    left join {nodes} s on s.tree = a.tree and s.level = n.level and s.idx = xor(a.idx >> n.level, 1)
    group by a.tree, a.idx"""

#: The manifest built level by level, siblings by index, the checksum of an id bit by bit.
SQL = f"""
with recursive hashed as (
    select doc_id, coalesce('+' || lang, '') as tree, {_LEAF} as leaf,
        {_LEAF.replace("n_chars", "n_chars + 1")} as altered,
        list_reduce(list_concat([4294967295], flatten(list_transform(range(1, 1 + length(doc_id::varchar)), lambda i: [ascii((doc_id::varchar)[i]), -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda c, v: case when v >= 0 then xor(c, v) else xor(c >> 1, 3988292384 * (c & 1)) end) as sum
    from documents),
leaves as (
    select *, leaf as digest, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as many,
        case when xor(sum, 4294967295) % 7 = 0 then altered else leaf end as told
    from hashed),
{_RAISED.format(name="nodes", leaves="leaves")},
trees as (
    select '' as tree, tree as name, digest, row_number() over (order by tree) - 1 as idx, count(*) over () as many
    from nodes where many = 1),
{_RAISED.format(name="top", leaves="trees")},
low as ({_STEPS.format(leaves="leaves", nodes="nodes")}),
high as ({_STEPS.format(leaves="trees", nodes="top")}),
proof as (
    select l.doc_id, l.leaf, l.told, t.digest as subroot, (select digest from top where many = 1) as root,
        list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) as steps
    from leaves l join trees t on t.name = l.tree
    left join low on low.tree = l.tree and low.idx = l.idx
    left join high on high.tree = t.tree and high.idx = t.idx),
folded as (
    select *, list_reduce(list_prepend(told, steps), lambda a, s: sha256(case when s[1] = 'L' then s[2:] || a else a || s[2:] end)) as folded_root
    from proof)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified
from folded
"""
