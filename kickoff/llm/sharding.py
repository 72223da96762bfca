"""Sharding by balanced label propagation, with DataFrame operations only.

Linked documents (equal texts) should share a shard, while the shards' document counts
stay at most one apart (law ``rows``). Documents of one group are interchangeable, so
the state is a table of cells (group, shard, n), never a list of links.

* Start: documents take shards by the hash of their id, in proportion to the shards' room;
  only groups that no shard holds fill whole shards at once, one after the other.
* Round: a split group's documents vote (a join with the group's fullest shard that has room); cells elsewhere want to move there. Between two
  shards as many documents may move one way as the other way, and into a shard as many more
  as it has room. Moves are admitted up to these 40 x 40 quotas by running sums, a cell at
  the border in part.
* Where no vote can be followed, whole groups change places with as many voters.
* Rounds end when no vote is left, or ``PATIENCE`` of them in turn leave no fewer cells; the
  cells of the best round count. Documents without links have no vote; they fill the shards
  up to their quotas.
* Repair, only where rounds leave a group split that its size doesn't force (tables of hardly
  anything but copies, whose shards have no room): the driver packs the group sizes (a number
  per distinct size, at most the root of twice the documents) whole into the quotas, largest
  first into the emptiest shard; groups that don't fit get room by exchanges between two
  shards. What still doesn't fit is split, and each cut fills a shard, so there are fewer
  needless cuts than shards; rounds go on from there. The cells count if they are fewer.

Numbers over many rows (a group, a shard, the whole table) are given in two levels,
totals per hash bucket and then places within a bucket, so no window holds a hot group.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, text_key

#: Hash buckets in which rows are numbered.
BUCKETS = 1024
#: Rounds without fewer cells after which rounds end: ties fall anew in each.
PATIENCE = 3
#: Sizes of a shard, smallest first, whose sums by two are tried in exchanges.
PAIRED = 64


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, weight: Column | None = None) -> DataFrame:
    """Add ``out``: rows (or weight) before this row among those with equal ``keys``."""
    weight = F.lit(1) if weight is None else weight
    dealt = df.withColumn("_w", weight.cast("bigint")).withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int"))
    totals = dealt.groupBy(*keys, "_b").agg(F.sum("_w").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_bb"),
                           F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_b") == F.col("_bb")]
    return (dealt.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0))).join(starts, on)
                 .withColumn(out, (F.col("_s") + F.col("_in")).cast("bigint")).select(*df.columns, out))


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def by_bounds(rank: Column, sizes: list[int]) -> Column:
    """The index of the range of consecutive ``sizes`` that holds ``rank``."""
    bounds, at = [], 0
    for s in sizes[:-1]:
        at += s
        bounds.append(at)
    return F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in bounds]), lambda b: b <= rank))


def admitted(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many documents may move between shards so that none exceeds its quota: rings of
    two and three shards that exchange, then moves into room, which make room themselves."""
    left, allowed = dict(wanted), dict.fromkeys(wanted, 0)

    def move(edges: list[tuple[int, int]], n: int) -> None:
        for e in edges:
            left[e] -= n
            allowed[e] += n

    rings = [[(i, j), (j, i)] for i, j in wanted if i < j]
    rings += [[(i, j), (j, k), (k, i)] for i, j in wanted for k in range(len(room)) if i < min(j, k) and j != k]
    for ring in rings:
        if n := min(left.get(e, 0) for e in ring):
            move(ring, n)
    moved = True
    while moved:
        moved = False
        for i, j in sorted(left, key=lambda e: (-left[e], e)):
            if n := min(left[i, j], room[j]):
                move([(i, j)], n)
                room[j] -= n
                room[i] += n
                moved = True
    return allowed


def _give_way(moves: DataFrame, wanted: dict[tuple[int, int], int]) -> tuple[dict[tuple[int, int], int], DataFrame]:
    """When no vote can be followed: whole groups in a wanted shard change places with as many voters.

    For each wanted shard, the shard with most voters for it takes whole groups of at most
    that many documents in all. Returns the voters that may move and (_key, shard, _new).
    """
    asker: dict[int, int] = {}
    for (i, j), n in sorted(wanted.items(), key=lambda x: (x[1], x[0])):
        asker[j] = i
    pick = lambda values: F.create_map(*[x for j, i in asker.items() for x in (F.lit(j), F.lit(values(i, j)))])[F.col("shard")]
    groups = moves.groupBy("_key").agg(F.count(F.lit(1)).alias("_parts")).where("_parts = 1").select("_key")
    whole = moves.join(groups, "_key", "left_semi").where(F.col("shard").isin(list(asker))).select("_key", "shard", "n")
    fit = numbered(whole, ["shard"], ["_key"], "_before", F.col("n")).where(F.col("_before") + F.col("n") <= pick(lambda i, j: wanted[i, j]))
    fit = fit.withColumn("_new", pick(lambda i, j: i).cast("int")).checkpoint()
    given = {r["shard"]: r["n"] for r in fit.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    return {(asker[j], j): n for j, n in given.items()}, fit.select("_key", "shard", "_new")


def _sums(held: Counter) -> dict[int, tuple[int, ...]]:
    """What up to two groups of a shard hold together, and their sizes."""
    sizes = sorted(s for s, c in held.items() if c)
    few = sizes[:PAIRED]
    out = {a + b: (a, b) for i, a in enumerate(few) for b in few[i:] if a != b or held[a] > 1}
    return out | {a: (a,) for a in sizes} | {0: ()}


def _exchange(size: int, room: list[int], held: list[Counter]) -> int | None:
    """Exchange groups between two shards so that one of them has room for ``size``; that shard."""
    sums = [_sums(h) for h in held]
    order = [sorted(s) for s in sums]
    for x in sorted(range(len(room)), key=lambda j: -room[j]):
        need = size - room[x]
        for y in range(len(room)):
            if y == x or room[y] < need:
                continue
            for a in order[x]:  # x gives a, y gives b, and need <= a - b <= room[y]
                at = bisect_left(order[y], a - room[y])
                if at < len(order[y]) and order[y][at] <= a - need:
                    b = order[y][at]
                    for s in sums[x][a]:
                        held[x][s] -= 1
                        held[y][s] += 1
                    for s in sums[y][b]:
                        held[y][s] -= 1
                        held[x][s] += 1
                    room[x] += a - b
                    room[y] -= a - b
                    return x
    return None


def packed(sizes: dict[int, int], quota: list[int]) -> dict[int, list[tuple[int, list[tuple[int, int]]]]]:
    """For each group size the places of its groups: (groups, [(shard, documents)]); ``sizes`` has groups by size.

    A piece of a group larger than a quota fills a shard, its rest is placed like a group.
    """
    room, shards = list(quota), len(quota)
    held: list[Counter] = [Counter() for _ in quota]  # whole groups (and rests) by size
    rests: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # by the rest's size: the group's size and parts so far
    count = Counter(sizes)
    heap = [-s for s in sizes]
    heapq.heapify(heap)
    late: list[int] = []
    while heap:
        s = -heapq.heappop(heap)
        if s > max(quota):  # no shard holds it: whole shards first
            for _ in range(sizes[s]):
                rest, parts = s, []
                while rest > max(quota) and max(room):
                    j = max(range(shards), key=lambda i: room[i])
                    n = min(rest, room[j])
                    parts.append((j, n))
                    room[j] -= n
                    rest -= n
                if rest and rest not in count:
                    heapq.heappush(heap, -rest)
                if rest:
                    count[rest] += 1
                rests.setdefault(rest, []).append((s, parts))
            continue
        c = count[s]
        fits = lambda level: [max(0, (r - level) // s) for r in room]  # noqa: E731  groups by shard that leave ``level`` of room
        lo, hi = 0, max(room) + 1  # the least level to which no more than c groups fit
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if sum(fits(mid)) <= c else (mid + 1, hi)
        for j, n in enumerate(fits(lo)):
            room[j] -= n * s
            held[j][s] += n
            c -= n
        while c and max(room) >= s:
            j = max(range(shards), key=lambda i: room[i])
            room[j] -= s
            held[j][s] += 1
            c -= 1
        late += [s] * c
    split: dict[int, list[list[tuple[int, int]]]] = {}
    for s in late:
        if max(room) >= s:
            j = max(range(shards), key=lambda i: room[i])
        else:
            j = _exchange(s, room, held)
        if j is not None:
            room[j] -= s
            held[j][s] += 1
            continue
        rest, parts = s, []
        while rest:
            j = max(range(shards), key=lambda i: room[i])
            n = min(rest, room[j])
            parts.append((j, n))
            room[j] -= n
            rest -= n
        split.setdefault(s, []).append(parts)
    out: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for s in {s for h in held for s in h} | set(split) | set(rests):
        for size, parts in rests.get(s, []):  # a rest takes a place of its size
            if not s:
                more = []
            elif split.get(s):
                more = split[s].pop()
            else:
                j = next(j for j in range(shards) if held[j][s])
                held[j][s] -= 1
                more = [(j, s)]
            at: Counter = Counter()
            for j, n in parts + more:
                at[j] += n
            out.setdefault(size, []).append((1, sorted(at.items())))
        places = [(n, [(j, s)]) for j in range(shards) if (n := held[j][s])] + [(1, parts) for parts in split.get(s, [])]
        if places:
            out.setdefault(s, []).extend(places)
    return out


def propagate(cells: DataFrame, quota: list[int]) -> DataFrame:
    """Cells (_key, shard, n) after balanced label propagation; no shard exceeds its quota."""
    shards, idle, turn = len(quota), 0, -1
    kept, least = cells, cells.count()
    while idle < PATIENCE:
        turn += 1
        used = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
        room = [quota[s] - used.get(s, 0) for s in range(shards)]
        vote = cells
        if any(room):  # groups whose fullest shard is full vote for the fullest with room
            full = F.element_at(F.array(*[F.lit(r <= 0) for r in room]), F.col("shard") + 1)
            vote = cells.withColumn("_full", full)
        else:
            vote = cells.withColumn("_full", F.lit(False))
        # a shard that one group fills stays its own; what is left of the group votes on
        vote = vote.where(F.col("n") < F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard") + 1))
        # a group is whole already, or votes for the shard with most of it; ties fall anew in each round, both ways alike
        lot = F.xxhash64("_key", "shard", F.lit(turn))
        targets = vote.groupBy("_key").agg(F.max_by("shard", F.struct(~F.col("_full"), "n", lot)).alias("_open"),
                                           F.max_by("shard", F.struct("n", lot)).alias("_most"), F.count(F.lit(1)).alias("_parts"))
        targets = targets.where("_parts > 1").select(F.col("_key").alias("_tkey"), "_open", "_most")
        filled = F.col("n") >= F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard") + 1)
        joined = cells.join(targets, (F.col("_key") == F.col("_tkey")) & ~filled, "left")
        best = None
        for target in ("_most", "_open") if any(room) else ("_most",):
            moves = joined.withColumn("_to", F.coalesce(F.col(target), F.col("shard"))).drop("_tkey", "_open", "_most").checkpoint()
            wanted = {(r["shard"], r["_to"]): r["n"] for r in moves.where("shard <> _to").groupBy("shard", "_to").agg(F.sum("n").alias("n")).collect()}  # shards x shards
            allowed = admitted(wanted, list(room))
            if any(allowed.values()):
                best = moves
                break
        volunteers = None
        if best is None:
            if not wanted:
                return kept
            best = moves
            allowed, volunteers = _give_way(moves, wanted)
            if not any(allowed.values()):
                idle += 1
                continue
        moves = best
        names = [k for k, v in allowed.items() if v]
        limit = F.create_map(*[x for i, j in names for x in (F.lit(i * shards + j), F.lit(allowed[i, j]).cast("bigint"))])
        pair = F.col("shard") * shards + F.col("_to")
        staying = moves.where("shard = _to").select("_key", "shard", "n")
        if volunteers is not None:
            staying = staying.join(volunteers, ["_key", "shard"], "left").select("_key", F.coalesce("_new", "shard").alias("shard"), "n")
        moving = numbered(moves.where("shard <> _to"), ["shard", "_to"], ["_key"], "_before", F.col("n"))
        moving = moving.withColumn("_go", F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce(limit[pair], F.lit(0)) - F.col("_before"))))
        parts = moving.select("_key", F.explode(F.array(
            F.struct(F.col("_to").alias("shard"), F.col("_go").alias("n")),
            F.struct(F.col("shard"), (F.col("n") - F.col("_go")).alias("n")))).alias("p")).select("_key", "p.*")
        cells = (parts.unionByName(staying).where("n > 0")
                      .groupBy("_key", "shard").agg(F.sum("n").cast("bigint").alias("n")).checkpoint())
        now = cells.count()
        idle = 0 if now < least else idle + 1
        if now < least:
            kept, least = cells, now
    return kept


def started(members: DataFrame, sizes: dict[int, int], quota: list[int]) -> DataFrame:
    """Cells (_key, shard, n) to start from, of the linked documents (doc_id, _key, and _g, the size of their group)."""
    large = max(quota, default=0)
    over = sum(s * n for s, n in sizes.items() if s > large)
    room, left = [], over
    for q in quota:  # groups that no shard holds lie one after the other
        room.append(q - min(q, left))
        left -= min(q, left)
    rest, total, upto = sum(s * n for s, n in sizes.items()) - over, sum(room), 0
    dealt = []
    for r in room:
        dealt.append((upto + r) * rest // max(total, 1) - upto * rest // max(total, 1))
        upto += r
    docs = members.withColumn("_large", F.col("_g") > large)
    whole = numbered(docs.where("_large"), ["_large"], ["_key"], "_i").withColumn("shard", by_bounds(F.col("_i"), quota).cast("int"))
    others = numbered(docs.where("NOT _large"), ["_large"], ["doc_id"], "_i").withColumn("shard", by_bounds(F.col("_i"), dealt).cast("int"))
    both = whole.select("_key", "shard").unionByName(others.select("_key", "shard"))
    return both.groupBy("_key", "shard").agg(F.count(F.lit(1)).alias("n")).checkpoint()


def repaired(cells: DataFrame, left: int, linked_keys: DataFrame, sizes: dict[int, int], quota: list[int], needed: int) -> DataFrame:
    """The cells of a packing of all groups, propagated on, if they are fewer than the ``left`` of ``cells``."""
    plan = packed(sizes, quota)
    count = sum(n * len(parts) for ps in plan.values() for n, parts in ps)
    if count >= left:
        return cells
    upto = []  # group number i of its size takes the first place whose bound is above i
    for size, places in plan.items():
        bound, ends = 0, []
        for n, parts in places:
            bound += n
            ends.append((bound, parts))
        upto.append((size, ends))
    places = cells.sparkSession.createDataFrame(upto, "_size bigint, _ends array<struct<upto:bigint,parts:array<struct<shard:int,n:bigint>>>>")
    place = F.filter("_ends", lambda e: e.upto > F.col("_at"))[0].parts
    cells = (numbered(linked_keys, ["_g"], ["_key"], "_at").join(F.broadcast(places), F.col("_g") == F.col("_size"))
             .select("_key", F.explode(place).alias("c")).select("_key", "c.*").checkpoint())
    return propagate(cells, quota) if count > needed else cells


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, one row per input row.

    Law ``rows``: the shards' counts are at most one apart; slots count a shard's rows
    from 0. A group of equal texts (a null text counts as empty; its size is 16) is split
    where quotas force it; beyond that there are fewer cuts than shards, and none while
    the exchanges find room. Null ids are kept, repeated rows are rows of their own;
    an empty table gives no rows, other columns are ignored.
    """
    shared_folder(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("size"),
                       F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), text_key(text).alias("_key")).checkpoint()
    groups = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_g"))
    linked_keys = groups.where("_g > 1")
    total = rows.count()
    quota = quotas(total, shards)
    sizes = {r["_g"]: r["n"] for r in linked_keys.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a distinct size
    members = rows.join(groups.where("_g > 1"), "_key")
    cells = propagate(started(members, sizes, quota), quota)
    needed = sum(n * -(-size // max(quota)) for size, n in sizes.items())
    if (left := cells.count()) > needed:
        cells = repaired(cells, left, linked_keys, sizes, quota, needed)
    # a group's documents take its cells by their number in the group
    ranges = cells.withColumn("_from", F.coalesce(F.sum("n").over(Window.partitionBy("_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranges = ranges.select(F.col("_key").alias("_ckey"), "shard", "_from", (F.col("_from") + F.col("n")).alias("_to"))
    linked = (numbered(members.drop("_g"), ["_key"], ["doc_id"], "_i").join(
        ranges, (F.col("_key") == F.col("_ckey")) & (F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_to"))).select(*rows.columns, "shard"))
    used = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    free = [q - used.get(s, 0) for s, q in enumerate(quota)]
    single = numbered(rows.join(linked_keys.select("_key"), "_key", "left_anti").withColumn("_one", F.lit(1)), ["_one"], ["_key"], "_i")
    placed = linked.unionByName(single.withColumn("shard", by_bounds(F.col("_i"), free).cast("int")).select(*rows.columns, "shard"))
    # the numbering reads the placed rows twice: both reads must meet the same places
    final = numbered(placed.checkpoint(), ["shard"], ["doc_id", "_key"], "slot")
    return final.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
