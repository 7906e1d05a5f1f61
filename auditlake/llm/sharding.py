"""Balanced label propagation: linked documents move towards the shards of their neighbours.

Vertices have a weight, links join them. Every linked vertex starts in a shard its hash names, in
proportion to the room of the shards. In each round half of the vertices look at their neighbours: a vertex wishes for the shard most of its
link weight leads to, if that is more than leads to its own. Wishes between two shards are granted up
to a quota, the room left in the wished shard and what moves the other way, in the order of a running
sum. Vertices without weight are hubs; they move freely and only pass labels on. Shards stay within
their capacity, an equal share of all weight. In the end the vertices without links, in classes from
heavy to light, fill what room is left, so that the shards come out even.

Up to ``HUB`` equal documents are linked through a hub. A larger group is one vertex, settled before the
links are looked at: from heavy to light, each goes as a whole to the shard with the most room. A group
that no shard has room for is cut, so that it fills as few shards as can be. Groups lighter than a
``HEAVY``-th of a shard are laid one behind the other into the room the heavy ones left.

Nulls: a null text has weight 1 and is linked to other null texts; a null id is kept. Ties between
shards go to the lower number. Repeated rows are documents of their own. Empty tables give no rows.
Only DataFrame operations run on the executors; the driver holds the loads and wishes of pairs of
shards, and the heavy groups, at most ``HEAVY`` times the number of shards. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.shared import stored

# Documents linked to one hub, rounds at most, rows of a bucket of a running sum.
HUB, ROUNDS, BUCKET_ROWS = 256, 8, 4000
# Large groups of more than this part of a shard's room are settled one by one.
HEAVY = 1000


def _running(rows: DataFrame, group: list[str], weight: str, near: str, count: int) -> DataFrame:
    """Add ``before``: the weight that comes before a row in its group, in an order of buckets.

    Rows that share ``near`` follow each other. Buckets are numbered by hash; their sums, one row per
    group and bucket, are added up apart, and rows only within their bucket.
    """
    buckets = max(1, count // BUCKET_ROWS)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(near), F.lit(buckets)))
    sums = dealt.groupBy(*group, "_bucket").agg(F.sum(weight).alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(near, "v").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return summed.join(bases, [*group, "_bucket"]).withColumn("before", F.col("_base") + F.col("_inside")).drop("_bucket", "_base", "_inside")


def _quotas(wishes: dict[tuple[int, int], int], loads: list[int], room: list[int]) -> dict[tuple[int, int], int]:
    """How much weight may move between each two shards: what moves back, and a share of the free room."""
    quotas = {(f, t): min(w, wishes.get((t, f), 0)) for (f, t), w in wishes.items()}
    for t in range(len(loads)):
        free = max(0, room[t] - loads[t])
        more = {f: w - quotas[f, s] for (f, s), w in wishes.items() if s == t}
        total = sum(more.values())
        for f, w in more.items():
            quotas[f, t] += min(w, free * w // total) if total else 0
    return quotas


def _case(values: dict[tuple[int, int], int]) -> Column:
    """The value of the pair of shards in ``label`` and ``wish``, 0 for others."""
    if not values:
        return F.lit(0)
    table = F.create_map(*(F.lit(x) for (f, t), v in sorted(values.items()) for x in (f"{f}>{t}", v)))
    return F.coalesce(table[F.concat_ws(">", "label", "wish")], F.lit(0))


def _wishes(state: DataFrame, links: DataFrame, phase: int) -> DataFrame:
    """Vertices of a phase that wish for another shard, with ``wish``."""
    labels = state.select(F.col("v").alias("b"), F.col("label").alias("near_label"))
    votes = links.join(labels, "b").groupBy("a", "near_label").agg(F.sum("w").alias("votes"))
    asked = state.filter(F.col("phase") == phase)
    seen = votes.join(asked, votes["a"] == asked["v"])
    best = seen.groupBy("v", "size", "near", "phase", "label").agg(
        F.max(F.struct("votes", (-F.col("near_label")).alias("other"))).alias("best"),
        F.coalesce(F.max(F.when(F.col("near_label") == F.col("label"), F.col("votes"))), F.lit(0)).alias("own"),
    )
    moved = best.filter((F.col("best.votes") > F.col("own")) & (-F.col("best.other") != F.col("label")))
    return moved.select("v", "size", "near", "phase", "label", (-F.col("best.other")).alias("wish"))


def _start(room: list[int]) -> Column:
    """A shard for each vertex by its hash, in proportion to the room."""
    whole, end, ends = sum(room) or 1, 0, []
    for r in room[:-1]:
        end += r
        ends.append((end << 20) // whole)
    at = F.pmod(F.xxhash64("v"), F.lit(1 << 20))
    return sum(((at >= e).cast("int") for e in ends), F.lit(0))


def _fitting(placed: DataFrame, room: list[int]) -> DataFrame:
    """``(v, size, label)`` of placed vertices; ``label`` is null where the shard has no room."""
    loads = {r["label"]: r for r in placed.groupBy("label").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    if all(r["size"] <= room[s] for s, r in loads.items()):
        return placed.select("v", "size", "label")
    summed = _running(placed, ["label"], "size", "near", sum(r["n"] for r in loads.values()))
    limit = F.array(*(F.lit(x) for x in room))[F.col("label")]
    fits = F.col("before") + F.col("size") <= limit
    return stored(summed.select("v", "size", F.when(fits, F.col("label")).alias("label")), "placed")


def propagate(vertices: DataFrame, links: DataFrame, shards: int, room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``(v, size, label)`` of every linked vertex with weight; ``label`` is null where a shard had no room.

    ``vertices`` has ``v``, ``size``, ``near`` (vertices that share it move together) and ``phase``
    (0 or 1: the half it moves with); ``links`` has ``a``, ``b`` and weight ``w`` in both directions.
    """
    state = stored(vertices.withColumn("label", _start(room)), "labels")
    moved_before = True
    for turn in range(2 * rounds):
        wishes = stored(_wishes(state, links, turn % 2), "wishes")
        asked = wishes.groupBy("label", "wish").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        if not asked:
            # Neither half wishes anything when the other one has not moved since.
            if not moved_before:
                break
            moved_before = False
            continue
        moved_before = True
        by_label = state.groupBy("label").agg(F.sum("size").alias("size")).collect()
        loads = [next((r["size"] for r in by_label if r["label"] == s), 0) for s in range(shards)]
        wanted = {(r["label"], r["wish"]): r["size"] for r in asked}
        quotas = _quotas(wanted, loads, room)
        granted = wishes
        if any(quotas[pair] < size for pair, size in wanted.items()):
            summed = _running(wishes, ["label", "wish"], "size", "near", sum(r["n"] for r in asked))
            granted = summed.filter(F.col("before") + F.col("size") <= _case(quotas))
        changes = granted.select("v", "wish")
        state = stored(state.join(changes, "v", "left").withColumn("label", F.coalesce("wish", "label")).drop("wish"), "labels")
    return _fitting(state.filter("size > 0"), room)


def _fill(loose: DataFrame, shards: int, loads: list[int], room: list[int], count: int) -> DataFrame:
    """``(v, size, label)`` of vertices without a shard, laid one behind the other into the free room."""
    order = F.floor(F.log2(F.col("size").cast("double")) / 2).cast("int")
    rows = stored(_running(loose.withColumn("class", order), ["class"], "size", "v", count), "loose")
    totals = {r["class"]: r["size"] for r in rows.groupBy("class").agg(F.sum("size").alias("size")).collect()}
    labels: Column | None = None
    middle = F.col("before") * 2 + F.col("size")
    for kind in sorted(totals, reverse=True):
        free = [max(0, r - x) for r, x in zip(room, loads, strict=True)]
        whole = sum(free) or 1
        # The line of this class is cut in proportion to the free room.
        ends, end = [], 0
        for s in range(shards - 1):
            end += free[s]
            ends.append(totals[kind] * end // whole)
        shard = sum(((middle > 2 * e).cast("int") for e in ends), F.lit(0))
        labels = F.when(F.col("class") == kind, shard) if labels is None else labels.when(F.col("class") == kind, shard)
        added = rows.filter(F.col("class") == kind).groupBy(shard.alias("label")).agg(F.sum("size").alias("size")).collect()
        for r in added:
            loads[r["label"]] += r["size"]
    return rows.select("v", "size", (labels if labels is not None else F.lit(0)).cast("int").alias("label"))


def _plan(groups: list[tuple[int, int, int]], loads: list[int], room: list[int]) -> list[tuple[int, bool, list[tuple[int, int]]]]:
    """For groups ``(g, weight, copies)``: whether one shard takes all, and up to which weight each shard takes copies.

    ``loads`` are raised. What no shard has room for lies above all cuts.
    """
    made = []
    for g, weight, copies in sorted(groups, key=lambda x: (-x[1], x[0])):
        cuts, done, size = [], 0, weight // copies
        while done < weight:
            s = max(range(len(room)), key=lambda i: (room[i] - loads[i], -i))
            part = min(weight - done, (room[s] - loads[s]) // size * size)
            if part <= 0:
                break
            loads[s] += part
            done += part
            cuts.append((done, s))
        made.append((g, done == weight and len(cuts) == 1, cuts))
    return made


def settle(members: DataFrame, shards: int, room: list[int]) -> DataFrame:
    """``(v, size, label)`` of the copies ``(v, size, g)`` in large groups ``g``; ``label`` is null where no shard had room."""
    groups = stored(members.groupBy("g").agg(F.sum("size").alias("weight"), F.count("*").alias("n")), "large-groups")
    heavy = F.col("weight") * HEAVY > min(room)
    loads = [0] * shards
    planned = _plan([tuple(r) for r in groups.filter(heavy).collect()], loads, room)
    cuts = groups.sparkSession.createDataFrame(planned, "g bigint, whole boolean, cuts array<struct<upto: bigint, shard: int>>")
    light = groups.filter(~heavy).select(F.col("g").alias("v"), F.col("weight").alias("size"))
    if count := light.count():
        laid = _fill(light, shards, loads, room, count)
        end = F.struct(F.col("size").alias("upto"), F.col("label").alias("shard"))
        cuts = cuts.unionByName(laid.select(F.col("v").alias("g"), F.lit(True).alias("whole"), F.array(end).alias("cuts")))
    dealt = stored(members.join(cuts, "g").withColumn("near", F.col("g")), "settled")
    placed = dealt.filter("whole").select("v", "size", "near", F.col("cuts")[0]["shard"].alias("label"))
    split = dealt.filter("NOT whole")
    if count := split.count():
        # Copies are of one size, so that cuts fall between them.
        summed = _running(split, ["g"], "size", "v", count)
        inside = F.filter("cuts", lambda x: F.col("before") + F.col("size") <= x["upto"])
        placed = placed.unionByName(summed.select("v", "size", "near", F.get(inside, F.lit(0))["shard"].alias("label")))
    return _fitting(stored(placed.filter("label IS NOT NULL"), "settled"), room)


def balance(vertices: DataFrame, large: DataFrame, linked: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """``(v, size, label)`` for all ``vertices`` (``v``, ``size``).

    ``large`` are copies in large groups, with ``g``; ``linked`` are vertices with links, and hubs.
    """
    total, count = vertices.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    room = [total // shards + (s < total % shards) for s in range(shards)]

    def loads(rows: DataFrame) -> list[int]:
        sums = {r["label"]: r["size"] for r in rows.groupBy("label").agg(F.sum("size").alias("size")).collect()}
        return [sums.get(s, 0) for s in range(shards)]

    kept = None
    if large.limit(1).count():
        kept = settle(large, shards, room).filter("label IS NOT NULL")
    free = [r - x for r, x in zip(room, loads(kept), strict=True)] if kept is not None else room
    placed = propagate(linked, links, shards, free).filter("label IS NOT NULL")
    kept = placed if kept is None else kept.unionByName(placed)
    loose = vertices.join(kept.select("v"), "v", "left_anti").select("v", "size")
    return kept.unionByName(_fill(loose, shards, loads(kept), room, count))


def slots(rows: DataFrame, count: int, shard: str = "shard") -> DataFrame:
    """Add ``slot``: rows of a shard numbered from 0 without gaps."""
    one = rows.withColumn("_one", F.lit(1).cast("bigint"))
    return _running(one, [shard], "_one", "v", count).withColumnRenamed("before", "slot").drop("_one")


def shard_documents(documents: DataFrame, shards: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: id, ``size``, ``text_crc32``, ``shard`` and ``slot``; equal texts are linked."""
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = documents.select(
        F.col(id).alias("id"),
        (F.octet_length(data) + 1).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.when(F.col(text).isNotNull(), F.hash(text)).alias("k2"),
    ).withColumn("v", F.monotonically_increasing_id())
    rows = stored(rows, "documents")
    groups = rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1")
    groups = stored(groups, "groups")
    same = (rows["k1"] == groups["k1"]) & rows["k2"].eqNullSafe(groups["k2"])
    # Hubs have negative numbers, documents have none.
    hub = -F.shiftrightunsigned(F.xxhash64(groups["k1"], groups["k2"], F.lit(0)), 1) - 1
    copies = stored(rows.join(groups, same).select("v", "size", "n", hub.alias("hub")), "members")
    large = copies.filter(F.col("n") > HUB).select("v", "size", F.col("hub").alias("g"))
    members = copies.filter(F.col("n") <= HUB)
    single = members.select(F.col("v").alias("a"), F.col("hub").alias("b"), F.lit(1).cast("bigint").alias("w"))
    links = stored(single.unionByName(single.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "links")
    hubs = members.select(F.col("hub").alias("v")).distinct().select(
        "v", F.lit(0).cast("bigint").alias("size"), F.col("v").alias("near"), F.lit(0).alias("phase")
    )
    linked = members.select("v", "size", F.col("hub").alias("near"), F.lit(1).alias("phase")).unionByName(hubs)
    labels = balance(rows.select("v", "size"), large, linked, links, shards)
    sharded = rows.select("v", "id", "size", "text_crc32").join(labels.select("v", F.col("label").alias("shard")), "v")
    return slots(stored(sharded, "sharded"), rows.count()).select(F.col("id").alias(id), "size", "text_crc32", "shard", "slot")
