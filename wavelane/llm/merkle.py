"""Merkle manifest of a dataset, built and proved by time-forward processing.

Rows are leaves. Each tree takes its leaves in the wanted order; while it has more than one node,
every two consecutive ones (a last one alone, too) become the hash of their digests. The roots of
all trees, in the order of the trees' names, are the leaves of one more tree.

Nodes carry labels, (level, place), and are processed in label order: each sends its digest to its
parent through a priority queue, which hands the messages to the parent when its label comes up.
The queue is external: between bands of ``BAND`` levels the messages are rows that Spark shuffles
to the parent's band and sorts by label; inside a band a heap of at most ``2**BAND`` messages does.
The reversed sweep runs from the top label down: a parent sends each child the proof suffix that
it got, with the child's sibling in front, until the suffixes reach the leaves. A band of leaves is
one group of at most ``2**BAND`` rows whatever the size of its tree, and the number of bands is
logarithmic; the driver sees only the size of the largest tree.

A proof is a text of steps from the leaf to the root, parted by spaces: ``L`` or ``R`` and the
digest of the sibling on that side, or ``-`` where a node has none. ``fold`` recomputes a root.

Defined cases: null fields count as ``-``; a null tree name is a tree of its own and comes first;
null ids come first in their tree; rows that repeat an id stay and are ordered by their digests;
equal rows are interchangeable; an empty table gives no rows; columns that aren't named are left
to the caller, who passes those that should come back.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelane.llm.common import cut

#: Levels that one task climbs: a band holds up to ``2**BAND`` nodes of its lowest level.
BAND = 10
_TREE, _AT, _SIZE, _CHUNK = "_tree", "_at", "_size", "_chunk"


def hashed(*columns: str | Column) -> Column:
    """Digest of fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    parts = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def steps(path: str | Column) -> Column:
    """The steps of a proof as an array."""
    return F.filter(F.split(path, " "), lambda s: s != "")


def siblings(path: str | Column) -> Column:
    """The digests of a proof's siblings, leaf to root, as one text."""
    return F.concat_ws("", F.transform(F.filter(steps(path), lambda s: s != "-"), lambda s: F.substring(s, 2, 64)))


def fold(path: str | Column, digest: str | Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    start = F.col(digest) if isinstance(digest, str) else digest

    def up(h: Column, s: Column) -> Column:
        beside = F.substring(s, 2, 64)
        both = F.when(s == "-", h).when(F.startswith(s, F.lit("L")), F.concat(beside, h)).otherwise(F.concat(h, beside))
        return F.sha2(both, 256)

    return F.aggregate(steps(path), start, up)


def levels_of(size: int, band: int = BAND) -> int:
    """Levels to climb from ``size`` nodes of a tree inside one band."""
    return band if size > 1 << band else (size - 1).bit_length()


def climb(digests: Sequence[str], levels: int) -> dict[tuple[int, int], str]:
    """Digest of every node of a band by its label, from those of its lowest level."""
    queue: list[tuple[tuple[int, int], int, str]] = [((0, i), i, d) for i, d in enumerate(digests)]
    made: dict[tuple[int, int], str] = {}
    while queue:
        label, _, message = heapq.heappop(queue)
        if label[0]:  # leaves arrive as digests, other nodes as their children's messages
            parts = [message]
            while queue and queue[0][0] == label:
                parts.append(heapq.heappop(queue)[2])
            message = hashlib.sha256("".join(parts).encode()).hexdigest()
        made[label] = message
        if label[0] < levels:
            heapq.heappush(queue, ((label[0] + 1, label[1] >> 1), label[1], message))
    return made


def descend(made: dict[tuple[int, int], str], levels: int, suffix: str) -> dict[int, str]:
    """Proof of every node of the lowest level, from the suffix of the band's root."""
    queue = [((-levels, 0), suffix)]
    proofs: dict[int, str] = {}
    while queue:
        (level, place), held = heapq.heappop(queue)
        if not level:
            proofs[-place] = held
            continue
        for child in (-2 * place, -2 * place + 1):
            if (-level - 1, child) not in made:
                continue
            beside = made.get((-level - 1, child ^ 1))
            step = "-" if beside is None else ("L" if child & 1 else "R") + beside
            heapq.heappush(queue, ((level + 1, -child), f"{step} {held}" if held else step))
    return proofs


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds the place of each row in its tree and the tree's size; rows are dealt to tasks by range."""
    keys = [_TREE, *order, "_digest", "_salt"]
    placed = rows.withColumn("_salt", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_id", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_shard", F.shiftright("_id", 33)))
    shards = placed.groupBy(_TREE, "_shard").agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy(_TREE)
    shards = shards.select(_TREE, "_shard", (F.sum("_n").over(tree.orderBy("_shard")) - F.col("_n") - F.col("_low")).alias("_shift"), F.sum("_n").over(tree).alias(_SIZE))
    return placed.join(shards, [_TREE, "_shard"]).withColumn(_AT, F.col("_id") + F.col("_shift")).drop("_id", "_shard", "_shift")


def _up(key: tuple, nodes: pa.Table, band: int) -> pa.Table:
    nodes = nodes.sort_by(_AT)
    size = nodes[_SIZE][0].as_py()
    levels = levels_of(size, band)
    top = climb(nodes["_digest"].to_pylist(), levels)[(levels, 0)]
    return pa.table({_TREE: [key[0].as_py()], _AT: pa.array([key[1].as_py()], pa.int64()), _SIZE: pa.array([-(-size >> band)], pa.int64()), "_digest": [top]})


def _down(nodes: pa.Table, tops: pa.Table, band: int) -> pa.Table:
    nodes = nodes.sort_by(_AT)
    levels = levels_of(nodes[_SIZE][0].as_py(), band)
    made = climb(nodes["_digest"].to_pylist(), levels)
    proofs = descend(made, levels, tops["path"][0].as_py())
    n = nodes.num_rows
    out = nodes.drop_columns([_SIZE, _CHUNK])
    for name in ("subroot", "root"):
        out = out.append_column(name, pa.array([tops[name][0].as_py()] * n, pa.string()))
    return out.append_column("path", pa.array([proofs[i] for i in range(n)], pa.string()))


def _chunked(nodes: DataFrame, band: int) -> DataFrame:
    return nodes.withColumn(_CHUNK, F.shiftright(_AT, band))


def _bands(nodes: DataFrame, band: int) -> list[DataFrame]:
    """The nodes at the foot of every band, the given ones first and the roots of all trees last."""
    out = [nodes]
    largest = nodes.agg(F.max(_SIZE)).first()[0] or 0
    while largest > 1:
        schema = f"{_TREE} string, {_AT} bigint, {_SIZE} bigint, _digest string"
        foot = _chunked(out[-1].select(_TREE, _AT, _SIZE, "_digest"), band)
        out.append(cut(foot.groupBy(_TREE, _CHUNK).applyInArrow(lambda key, t: _up(key, t, band), schema)))
        largest = -(-largest >> band)
    return out


def _proved(bands: list[DataFrame], tops: DataFrame, band: int) -> DataFrame:
    """The lowest nodes with ``subroot, root, path``, from those of the trees' roots (``_tree, _at, subroot, root, path``)."""
    for nodes in reversed(bands[:-1]):
        foot = _chunked(nodes, band)
        schema = T.StructType([f for f in foot.schema.fields if f.name not in (_SIZE, _CHUNK)] + [T.StructField(n, T.StringType()) for n in ("subroot", "root", "path")])
        above = tops.select(_TREE, F.col(_AT).alias(_CHUNK), "subroot", "root", "path")
        tops = foot.groupBy(_TREE, _CHUNK).cogroup(above.groupBy(_TREE, _CHUNK)).applyInArrow(lambda a, b: _down(a, b, band), schema)
    if len(bands) == 1:
        tops = bands[0].join(tops.drop(_AT), _TREE)
    return tops


def manifest(rows: DataFrame, tree: str, order: Sequence[str], digest: str = "leaf", band: int = BAND) -> DataFrame:
    """``rows`` with ``subroot, root, path``: the root of the row's tree, the root of all, and its proof."""
    names = rows.columns
    # Tree names as never-null texts in the same order, null first.
    named = rows.withColumn(_TREE, F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))).withColumn("_digest", F.col(digest))
    bands = _bands(_numbered(named, order), band)
    subroots = bands[-1].select(F.col(_TREE).alias("name"), "_digest")
    if len(bands) == 1:
        subroots = cut(subroots)
    upper = _bands(_numbered(subroots.withColumn(_TREE, F.lit("")), ["name"]), band)
    crown = upper[-1].select(_TREE, _AT, F.lit("").alias("subroot"), F.col("_digest").alias("root"), F.lit("").alias("path"))
    roots = _proved(upper, crown, band).select(F.col("name").alias(_TREE), F.lit(0).cast("bigint").alias(_AT), F.col("_digest").alias("subroot"), "root", "path")
    return _proved(bands, cut(roots), band).select(*names, "subroot", "root", "path")


#: Fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def audit(docs: DataFrame, tampered: Column, band: int = BAND) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of ``documents``.

    Rows where ``tampered`` holds get one more in ``n_chars`` before their proof is folded again.
    """
    changed = F.when(tampered & F.col("n_chars").isNotNull(), hashed(*[F.col("n_chars") + 1 if c == "n_chars" else c for c in FIELDS]))
    leaves = docs.select(*FIELDS).select("doc_id", "lang", hashed(*FIELDS).alias("leaf"), changed.alias("changed"))
    proved = manifest(leaves, "lang", ["doc_id"], band=band)
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings("path"), 256).alias("proof_sha256"), fold("path", F.coalesce("changed", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def sql() -> str:
    """DuckDB twin of ``audit`` over ``documents``, tampered where the id's crc32 divides by seven."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
    leaf = " || ".join(field(c) for c in FIELDS)
    crc = _crc_sql("CAST(doc_id AS VARCHAR)")
    changed = " || ".join(field("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS)
    return f"""WITH RECURSIVE bits AS (SELECT b, list_reduce([b, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))),
crctable AS (SELECT list(c ORDER BY b) AS t FROM bits),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({leaf}) AS leaf, CASE WHEN {crc} % 7 = 0 AND n_chars IS NOT NULL THEN sha256({changed}) END AS changed FROM documents, crctable),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM d),
nodes(tree, lvl, pos, size, h) AS (SELECT tree, 0, pos, size, leaf FROM leaves UNION ALL
 SELECT tree, lvl + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE size > 1 GROUP BY tree, lvl, pos // 2, size),
subroots AS (SELECT tree, lvl AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1),
crown(lvl, pos, size, h) AS (SELECT 0, pos, size, subroot FROM subroots UNION ALL
 SELECT lvl + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE size > 1 GROUP BY lvl, pos // 2, size),
everywhere AS (SELECT tree, lvl, pos, h FROM nodes UNION ALL SELECT '~', lvl, pos, h FROM crown),
top AS (SELECT lvl AS height, h AS root FROM crown WHERE size = 1),
walk AS (SELECT l.tree, l.pos, unnest(range(s.height + t.height)) AS step, s.height, s.pos AS crown_at FROM leaves l JOIN subroots s USING (tree), top t),
side AS (SELECT w.tree, w.pos, w.step, CASE WHEN step < height THEN (w.pos >> step) & 1 ELSE (crown_at >> (step - height)) & 1 END AS odd, e.h
 FROM walk w LEFT JOIN everywhere e ON e.tree = CASE WHEN step < height THEN w.tree ELSE '~' END AND e.lvl = CASE WHEN step < height THEN step ELSE step - height END
 AND e.pos = xor(CASE WHEN step < height THEN w.pos >> step ELSE crown_at >> (step - height) END, 1)),
proofs AS (SELECT tree, pos, list({{'odd': odd, 'h': h}} ORDER BY step) AS steps, coalesce(string_agg(h, '' ORDER BY step), '') AS beside FROM side GROUP BY tree, pos),
all_leaves AS (SELECT l.*, coalesce(p.steps, []) AS steps, coalesce(p.beside, '') AS beside FROM leaves l LEFT JOIN proofs p USING (tree, pos)),
folds(tree, pos, k, h) AS (SELECT tree, pos, 0, coalesce(changed, leaf) FROM all_leaves UNION ALL
 SELECT f.tree, f.pos, k + 1, sha256(CASE WHEN a.steps[k + 1].h IS NULL THEN f.h WHEN a.steps[k + 1].odd = 1 THEN a.steps[k + 1].h || f.h ELSE f.h || a.steps[k + 1].h END)
 FROM folds f JOIN all_leaves a USING (tree, pos) WHERE k < len(a.steps))
SELECT a.doc_id, a.leaf, s.subroot, t.root, sha256(a.beside) AS proof_sha256, f.h AS folded_root, f.h = t.root AS verified
FROM all_leaves a JOIN subroots s USING (tree) JOIN folds f ON f.tree = a.tree AND f.pos = a.pos AND f.k = len(a.steps), top t"""


def _crc_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text in DuckDB, by ``crctable.t``."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295)"
