"""Alias closure and order-dependent greedy selection as fixpoints of joins.

Each round is a few shuffles; lineage is cut with reliable checkpoints. Minima combine
map-side, so an alias shared by a third of all rows costs one small row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.functions.hashing import hash_integer, set_hash, text_hash
from wavelane.session import cut_lineage


def alias_edges(df: DataFrame, row: str, keys: Sequence[str]) -> DataFrame:
    """``row, alias`` edges; equal values of different columns are different aliases."""
    tagged = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in keys]))
    return df.select(row, F.explode(tagged).alias("alias"))


def alias_components(edges: DataFrame, row: str = "id", alias: str = "alias") -> DataFrame:
    """``row, component``: the smallest row id reachable through shared aliases.

    Every row links to the smallest row of each of its aliases; ``pair_components`` closes the links.
    """
    known = edges.select(F.col(row).alias("a"), F.col(alias).alias("alias")).filter("a is not null and alias is not null")
    hubs = known.groupBy("alias").agg(F.min("a").alias("b"))
    return pair_components(known.join(hubs, "alias"), "a", "b", row)


def pair_components(pairs: DataFrame, a: str, b: str, row: str = "id") -> DataFrame:
    """``row, component``: the smallest id reachable from each id of ``a`` or ``b`` over the pairs.

    An id beside NULL is there without a link. Ids become hashed numbers; in a round every number
    goes over into the smallest number of itself and its neighbours, and links between the numbers
    left make the next round's graph. The order is kept while it lets the smallest number swallow
    stars, and drawn anew by a bijective hash every third round, so chains in any order shrink too:
    the graph gets smaller by a factor, and all rounds together cost a few times the first. What
    the rounds did is then followed from the last one back.
    """
    ids = pairs.select(F.explode(F.array(a, b)).alias("id")).filter("id is not null").distinct()
    seed = 0
    while True:  # another seed in the rare case that two ids share a number
        names = cut_lineage(ids.withColumn("v", F.xxhash64(F.lit(seed), "id")))
        if names.groupBy("v").count().filter("count > 1").isEmpty():
            break
        seed += 1
    links = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = cut_lineage(links.select(F.xxhash64(F.lit(seed), a).alias("a"), F.xxhash64(F.lit(seed), b).alias("b")))
    rounds = []
    while not links.isEmpty():
        fresh = lambda c, r=len(rounds): F.xxhash64(F.lit(r), c) if r % 3 == 2 else F.col(c)  # noqa: E731  (one number with a fixed seed: no two meet)
        near = links.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("l"))
        near = near.select(F.col("l.v").alias("v"), fresh("l.w").alias("w")).groupBy("v").agg(F.min("w").alias("w"))
        step = cut_lineage(near.select("v", F.least(fresh("v"), "w").alias("to")))
        left = links.join(step.select(F.col("v").alias("a"), F.col("to").alias("_a")), "a").join(step.select(F.col("v").alias("b"), F.col("to").alias("_b")), "b")
        links = cut_lineage(left.filter("_a != _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        rounds.append(step)
    # A number is unique within its round: a component is the round and the number in which it ended.
    ends = None
    for r in range(len(rounds) - 1, -1, -1):
        here = rounds[r].select("v", "to")
        if ends is None:
            ends = here.select("v", F.lit(r).alias("round"), F.col("to").alias("end"))
        else:
            later = ends.select(F.col("v").alias("to"), "round", "end")
            ends = cut_lineage(here.join(later, "to", "left").select("v", F.coalesce("round", F.lit(r)).alias("round"), F.coalesce("end", "to").alias("end")))
    if ends is None:
        return names.select(F.col("id").alias(row), F.col("id").alias("component"))
    found = cut_lineage(names.join(ends, "v", "left").select("id", "round", "end"))
    least = found.filter("end is not null").groupBy("round", "end").agg(F.min("id").alias("least"))
    return found.join(least, ["round", "end"], "left").select(F.col("id").alias(row), F.coalesce("least", "id").alias("component"))


def component_roles(df: DataFrame, keys: Sequence[str], modulus: int = 5) -> DataFrame:
    """Members with component and role: ``review`` when the member-set hash is 0 mod ``modulus``.

    Members are tagged alias values; two members are connected when a row holds both.
    """
    tagged = df.select(*[F.concat(F.lit(f"{k}:"), F.col(k).cast("string")).alias(k) for k in keys]).distinct()
    members = F.array_compact(F.array(*keys))
    pairs = tagged.select(F.get(members, F.lit(0)).alias("first"), F.explode(members).alias("other"))
    comp = pair_components(pairs, "first", "other", "member")
    hashes = set_hash(comp, ["component"], F.col("member"))
    role = F.when(hash_integer(F.col("set_hash"), 13) % modulus == 0, "review").otherwise("fit")
    return comp.join(hashes, "component").select("member", "component", F.col("members").alias("size"), role.alias("role"))


def exclude_exposed(catalog: DataFrame, history: DataFrame, row: str, keys: Sequence[str]) -> DataFrame:
    """Catalog rows whose alias component never touches a historical alias."""
    edges = alias_edges(catalog, row, keys)
    comp = alias_components(edges, row)
    used = alias_edges(history.withColumn(row, F.lit(None).cast(catalog.schema[row].dataType)), row, keys).select("alias").distinct()
    exposed_rows = edges.join(used, "alias", "left_semi").select(row).distinct()
    tainted = comp.join(exposed_rows, row, "left_semi").select("component").distinct()
    exposed = comp.join(tainted, "component", "left_semi").select(row)
    return catalog.join(exposed, row, "left_anti")


def greedy_distinct(df: DataFrame, row: str, order: str, keys: Sequence[str]) -> DataFrame:
    """``row, selected``: in ``order``, a row is held if any key is used by a *selected* row.

    Held rows do not claim keys. A round selects every undecided row that comes first in all its
    key groups, and holds the rows sharing a key with it. The result equals the sequential scan
    for unique ``order`` values; NULL keys conflict with nothing.
    """
    undecided = cut_lineage(df.select(row, order, *keys))
    decided = None
    while True:
        state = undecided
        for k in keys:
            first = undecided.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_f_{k}"))
            state = state.join(first, k, "left")
        wins = F.lit(True)
        for k in keys:
            wins = wins & (F.col(k).isNull() | (F.col(order) == F.col(f"_f_{k}")))
        state = state.withColumn("_win", wins)
        winners = state.filter("_win").select(row, *keys)
        out = state.select(row, order, *keys, "_win")
        for k in keys:
            taken = winners.select(k).filter(F.col(k).isNotNull()).distinct().withColumn(f"_t_{k}", F.lit(True))
            out = out.join(taken, k, "left")
        lost = F.lit(False)
        for k in keys:
            lost = lost | F.coalesce(f"_t_{k}", F.lit(False))
        step = cut_lineage(
            out.select(row, order, *keys, F.when(F.col("_win"), 1).when(lost, 0).alias("_state"))
        )
        done = step.filter("_state is not null").select(row, (F.col("_state") == 1).alias("selected"))
        decided = done if decided is None else decided.unionByName(done)
        undecided = step.filter("_state is null").select(row, order, *keys)
        if undecided.isEmpty():
            return decided


def select_balanced(df: DataFrame, row: str, genre: str, author: str, keys: Sequence[str], seed: int, per_genre: int = 4, per_author: int = 3, page: int = 256) -> DataFrame:
    """Rows chosen rare-genre-first, in hash order, with author cap and disjoint aliases.

    The choice holds at most genres x per_genre rows. Each genre is read in pages of its hash
    order until filled or exhausted; a page leaves out rows the choices made so far rule out, so its
    length changes nothing. Rows without a genre are one genre (``unlabeled``), rows without an
    author one author (``unknown``); empty aliases clash with nothing.
    """
    df = df.withColumn(genre, F.coalesce(genre, F.lit("unlabeled"))).withColumn(author, F.coalesce(author, F.lit("unknown")))
    counts = df.groupBy(genre).agg(F.count(F.lit(1)).alias("n")).orderBy("n", genre)
    hashed = df.select(row, genre, author, *keys, text_hash(seed, F.col(row).cast("string")).alias("_h"))
    chosen: list = []
    authors: dict = {}
    seen = {k: set() for k in keys}
    for item in counts.toLocalIterator():
        taken, last = 0, ""
        while taken < per_genre:
            pool = hashed.filter((F.col(genre) == item[genre]) & (F.col("_h") > last))
            full = [a for a, n in authors.items() if n >= per_author]
            if full:
                pool = pool.filter(~F.col(author).isin(full))
            for k in keys:
                if seen[k]:
                    pool = pool.filter(F.col(k).isNull() | ~F.col(k).isin(list(seen[k])))
            rows = pool.orderBy("_h").limit(page).collect()
            for r in rows:
                last = r["_h"]
                clash = any(r[k] is not None and r[k] in seen[k] for k in keys)
                if clash or authors.get(r[author], 0) >= per_author:
                    continue
                chosen.append((r[row], len(chosen) + 1))
                authors[r[author]] = authors.get(r[author], 0) + 1
                for k in keys:
                    seen[k].add(r[k])
                taken += 1
                if taken == per_genre:
                    break
            if len(rows) < page:
                break
    kind = df.schema[row].dataType.simpleString()
    picks = df.sparkSession.createDataFrame(chosen, f"{row} {kind}, pick int")
    return df.join(F.broadcast(picks), row)


def disjoint_roles(draws: DataFrame, roles: int, anchor: int, keys: Sequence[str]) -> DataFrame:
    """``role, draw_id``: one draw per role, all chosen draws sharing no key value.

    ``draws`` holds one row per (draw_id, member) with dense draw ids. Role r starts looking at
    ``anchor + r * n / roles`` and takes the first draw disjoint from the earlier choices.
    """
    total = draws.agg(F.max("draw_id")).first()[0] + 1
    ids = draws.select("draw_id").distinct()
    chosen: list[tuple[int, int]] = []
    for r in range(roles):
        free = ids
        picked = [d for _, d in chosen]
        if picked:
            members = draws.filter(F.col("draw_id").isin(picked))
            for k in keys:
                clash = draws.join(members.select(k), k, "left_semi").select("draw_id").distinct()
                free = free.join(clash, "draw_id", "left_anti")
            free = free.filter(~F.col("draw_id").isin(picked))
        start = anchor + r * total // roles
        best = free.agg(F.min_by("draw_id", F.pmod(F.col("draw_id") - start, F.lit(total))).alias("d")).first()["d"]
        if best is None:
            raise ValueError("insufficient disjoint draws")
        chosen.append((r, best))
    return draws.sparkSession.createDataFrame(chosen, "role int, draw_id bigint")
