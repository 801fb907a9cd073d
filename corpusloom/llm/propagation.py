"""Sharding by balanced label propagation: linked documents gather in one shard, sizes stay even.

Documents with equal texts are linked. Linked documents start in shards drawn by hash; each round, the
members of a group move towards the shard that holds most of it, as far as quotas allow. Documents without links
are indifferent, so they take the room that is left. Groups are handled as counts per shard, at most one
row for each shard, so a group of any size costs no more than that; its members get their shards from
their rank in the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.splits import exact_rank
from ..session import stage

SHARDS = 8
ROUNDS = 12
HOT_ROWS = 100_000   # members from which a group's rows are salted in joins
SALTS = 32
_BUCKETS = 4096


def quotas(n: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [n // shards + (k < n % shards) for k in range(shards)]


def _pick(values: list[int], index: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)).cast("bigint") for v in values]), index)


def move_quotas(wishes: dict[tuple[int, int], int], free: list[int]) -> list[list[int]]:
    """How many may move from each shard to each other: wishes against each other change places, the
    rest share the room that is free, the largest wishes first."""
    shards = len(free)
    quota = [[min(wishes.get((i, j), 0), wishes.get((j, i), 0)) for j in range(shards)] for i in range(shards)]
    left = list(free)
    for (i, j), n in sorted(wishes.items(), key=lambda w: (-w[1], w[0])):
        more = min(n - quota[i][j], left[j])
        quota[i][j] += more
        left[j] -= more
    return quota


def propagate(counts: DataFrame, room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Move ``n`` members of each ``grp`` between shards, never beyond ``room`` rows in a shard.

    ``counts`` has ``grp``, ``shard``, ``n``. A group's members move to the shard that holds most of the
    group, ties by hash; every other round to the one of those with room, so that what a full shard cannot
    take gathers elsewhere. Where more want to move than quotas allow, hash order decides, and the last
    group moves in part. Only totals per shard or pair of shards come to the driver. Ends after two
    rounds without a move.
    """
    shards, still = len(room), 0
    for turn in range(rounds):
        used = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        free = [room[k] - used.get(k, 0) for k in range(shards)]
        goals = counts.filter(F.col("shard").isin([k for k in range(shards) if free[k] > 0])) if turn % 2 else counts
        order = F.struct("n", F.xxhash64("grp", "shard").alias("tie"), "shard")
        best = goals.groupBy("grp").agg(F.max(order).alias("best"))
        placed = counts.withColumn("own", order).join(best, "grp", "left")
        moves = F.coalesce(F.col("best") > F.col("own"), F.lit(False))
        placed = stage(placed.select(
            "grp", "shard", "n", F.when(moves, F.col("best.shard")).alias("target"),
            F.pmod(F.xxhash64("grp"), F.lit(_BUCKETS)).alias("bucket")), "propagation-wishes")
        wishes = placed.filter("target IS NOT NULL")
        wanted = {(r["shard"], r["target"]): r["n"]
                  for r in wishes.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}
        quota = move_quotas(wanted, free)
        if not any(map(any, quota)):
            still += 1
            if still == 2:
                break
            continue
        still = 0
        way = ["shard", "target"]
        by_bucket = Window.partitionBy(*way).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        earlier = wishes.groupBy(*way, "bucket").agg(F.sum("n").alias("wanted")) \
            .select(*way, "bucket", F.coalesce(F.sum("wanted").over(by_bucket), F.lit(0)).alias("before"))
        inside = Window.partitionBy(*way, "bucket").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
        queued = wishes.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))) \
            .join(earlier, [*way, "bucket"])
        limit = _pick([n for row in quota for n in row], (F.col("shard") * shards + F.col("target")).cast("int"))
        moved = F.least(F.col("n"), F.greatest(F.lit(0), limit - F.col("before") - F.col("within")))
        settled = queued.withColumn("moved", moved).select("grp", F.explode(F.array(
            F.struct(F.col("target").alias("shard"), F.col("moved").alias("n")),
            F.struct(F.col("shard"), (F.col("n") - F.col("moved")).alias("n")))).alias("part")) \
            .select("grp", "part.shard", "part.n")
        after = placed.filter("target IS NULL").select("grp", "shard", "n").unionAll(settled) \
            .groupBy("grp", "shard").agg(F.sum("n").alias("n")).filter("n > 0")
        counts = stage(after, "propagation")
    return counts


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                  rounds: int = ROUNDS, seed: str = "shards") -> DataFrame:
    """A shard and a slot for every document, under the law ``rows``: counts at most one apart.

    Columns: the id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``grp`` (md5 of the text), ``shard``,
    ``slot`` (gapless from 0 in each shard). One row per input row. A null text has size 1 and the
    checksum of empty text; null texts are a group of their own. Rows that repeat are linked like other
    equal texts. An empty table gives an empty one. Texts are read once and not shuffled.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    nodes = stage(docs.select(
        docs[id_col].alias("doc"), F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("tag"),
        (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("null")).alias("grp")), "shard-nodes")
    sizes = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
    linked_groups = stage(sizes.filter("members > 1"), "shard-groups")
    n = nodes.count()
    n_linked = linked_groups.agg(F.sum("members")).first()[0] or 0
    room = quotas(n, shards)

    # Start: each shard gets an equal part of every group, the rest of a group by its hash.
    start = linked_groups.select("grp", "members", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    share = F.floor(F.col("members") / shards) + F.when(
        F.pmod(F.col("shard") - F.xxhash64("grp"), F.lit(shards)) < F.col("members") % shards, 1).otherwise(0)
    counts = stage(start.select("grp", F.col("shard").cast("int").alias("shard"), share.cast("bigint").alias("n"))
                   .filter("n > 0"), "propagation-start")
    counts = _within(counts, room)
    counts = stage(propagate(counts, room, rounds), "propagation-end")

    used = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    assert sum(used.values()) == n_linked and all(used.get(k, 0) <= room[k] for k in range(shards))
    by_shard = Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.withColumn("from", F.coalesce(F.sum("n").over(by_shard), F.lit(0))) \
        .groupBy("grp").agg(F.sum("n").alias("total"), F.collect_list(F.struct("shard", "from", "n")).alias("parts"))
    salted = places.withColumn("salt", F.explode(F.sequence(
        F.lit(0), F.when(F.col("total") > HOT_ROWS, SALTS - 1).otherwise(0)))).drop("total")
    ranked = exact_rank(nodes.join(linked_groups.select("grp"), "grp", "left_semi"), ["grp"], "tag", seed) \
        .withColumn("salt", F.when(F.col("group_rows") > HOT_ROWS, F.pmod(F.xxhash64("tag", "rank"), F.lit(SALTS)))
                    .otherwise(0).cast("int"))
    own = F.filter("parts", lambda p: (F.col("rank") > p["from"]) & (F.col("rank") <= p["from"] + p["n"]))
    linked = ranked.join(salted, ["grp", "salt"]).select(*nodes.columns, F.get(own, F.lit(0))["shard"].alias("shard"))

    ends, total = [], 0
    for k in range(shards):
        total += room[k] - used.get(k, 0)
        ends.append(total)
    alone = exact_rank(nodes.join(linked_groups.select("grp"), "grp", "left_anti"), [], "tag", seed)
    shard = F.lit(shards - 1)
    for k in reversed(range(shards - 1)):
        shard = F.when(F.col("rank") <= ends[k], k).otherwise(shard)
    single = alone.select(*nodes.columns, shard.cast("int").alias("shard"))
    placed = stage(linked.unionAll(single), "shard-placed")
    slotted = exact_rank(placed, ["shard"], "tag", seed)
    return slotted.select(F.col("doc").alias(id_col), "size", "text_crc32", "grp", "shard",
                          (F.col("rank") - 1).alias("slot"))


def _within(counts: DataFrame, room: list[int]) -> DataFrame:
    """Even starts exceed a quota by few rows at most; hand those over to the emptiest shards.

    Taken from the groups of the overfull shard in hash order; a handful of rows in all.
    """
    used = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    for k, limit in enumerate(room):
        over = used.get(k, 0) - limit
        while over > 0:
            rows = counts.filter(F.col("shard") == k).orderBy(F.xxhash64("grp"), "grp").limit(min(over, 1000)).collect()
            moved = []
            for r in rows:
                to = max(range(len(room)), key=lambda j: room[j] - used.get(j, 0))
                take = min(over, r["n"], room[to] - used.get(to, 0))
                if take <= 0:
                    continue
                over, used[k], used[to] = over - take, used[k] - take, used.get(to, 0) + take
                moved += [(r["grp"], k, -take), (r["grp"], to, take)]
            delta = counts.sparkSession.createDataFrame(moved, counts.schema)
            counts = stage(counts.unionAll(delta).groupBy("grp", "shard").agg(F.sum("n").alias("n"))
                           .filter("n > 0"), "propagation-start")
    return counts
