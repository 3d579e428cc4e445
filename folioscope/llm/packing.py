"""Filling containers of fixed capacity with whole documents.

How many items there are of each size is all that a packing depends on, and there are at most as many
sizes as the capacity, however many documents. So the sizes are counted on the cluster and packed on the
driver, as patterns: this many containers with these sizes in each. First the dominance reduction of
Martello and Toth fixes containers that some best packing has: for the largest size left, the fullest
pair or triple that no other set of items can beat. The rest is packed best-fit, largest first. Then
every item finds its container by its number among the items of its size, in blocks of numbers, so no
size that a third of all items share lands in one task.

A text beyond the capacity is cut into full containers and one rest; no other is split. Texts without
tokens, null ids and null, zero or negative capacities take no place. Equal sizes are placed in order of
a hash of doc_id, so the result doesn't depend on the order of rows. Extra columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.tokens import TOKENIZER, token_sizes
from folioscope.sources.staging import stage

Pattern = tuple[tuple[int, int], ...]

#: Numbers of one size that meet the patterns together, and items of one size that are numbered in one task.
BLOCK, NUMBERED = 256, 200_000
#: Kinds of containers that one packing may ask for.
MOST_KINDS = 10_000


class _Stock:
    """The sizes that items are left of, sorted, and as bits of a number and of its mirror image."""

    def __init__(self, counts: dict[int, int]):
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)
        self.top = self.sizes[-1] if self.sizes else 0
        self.bits = sum(1 << s for s in self.sizes)
        self.mirror = sum(1 << self.top - s for s in self.sizes)

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.sizes[bisect_left(self.sizes, size)]
            self.bits ^= 1 << size
            self.mirror ^= 1 << self.top - size

    def largest(self, most: int, used: Counter) -> int | None:
        """The largest size up to most of which an item is left beyond those used."""
        at = bisect_left(self.sizes, most + 1) - 1
        while at >= 0 and self.left[self.sizes[at]] <= used[self.sizes[at]]:
            at -= 1
        return self.sizes[at] if at >= 0 else None

    def smallest(self, n: int, used: Counter, above: int = 0) -> list[int]:
        found: list[int] = []
        at = bisect_left(self.sizes, above + 1)
        while len(found) < n and at < len(self.sizes):
            s = self.sizes[at]
            found += [s] * min(n - len(found), max(0, self.left[s] - used[s]))
            at += 1
        return found

    def has_pair(self, more_than: int, most: int, used: Counter) -> bool:
        """Whether two items left beyond those used sum to more than the one and at most the other.

        For each sum, one comparison of the bits with the mirror image; for many sums and few sizes, two pointers.
        """
        if most - more_than <= len(self.sizes):
            gone = [s for s, n in used.items() if s in self.left and 0 < self.left[s] <= n]
            bits, mirror = self.bits, self.mirror
            for s in gone:
                bits ^= 1 << s
                mirror ^= 1 << self.top - s
            for total in range(more_than + 1, most + 1):
                met = bits & (mirror >> self.top - total if total <= self.top else mirror << total - self.top)
                half = total // 2
                if met and total % 2 == 0 and self.left.get(half, 0) - used[half] < 2:
                    met &= ~(1 << half)
                if met:
                    return True
            return False
        lo, hi = 0, bisect_left(self.sizes, most) - 1
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            if self.left[a] <= used[a]:
                lo += 1
            elif self.left[b] <= used[b] or a + b > most:
                hi -= 1
            elif a + b > more_than and (lo < hi or self.left[a] - used[a] >= 2):
                return True
            else:
                lo += 1
        return False


def _dominating(size: int, stock: _Stock, capacity: int) -> list[int] | None:
    """Items to join one of this size so that no other set with it can be better; None if unknown."""
    used, room = Counter([size]), capacity - size
    first = stock.largest(room, used)
    if first is None:
        return []
    if first == room:
        return [first]
    three = stock.smallest(3, used)
    if len(three) == 3 and sum(three) <= room:
        return None
    if not stock.has_pair(first, room, used):
        return [first]
    used[first] += 1
    second = stock.largest(room - first, used)
    if second is None:
        return None
    above = stock.smallest(2, Counter([size]), above=second)
    return [first, second] if len(above) < 2 or sum(above) > room else None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixed (pattern, how many containers), and the counts that are left."""
    stock = _Stock(counts)
    fixed: list[tuple[Pattern, int]] = []
    for size in sorted(stock.left, reverse=True):
        while stock.left[size] > 0 and (others := _dominating(size, stock, capacity)) is not None:
            need = Counter([size, *others])
            times = min(stock.left[s] // k for s, k in need.items())
            # What is left afterwards fits no better, so the set stays the best one until its items run out.
            for s, k in need.items():
                stock.take(s, k * times)
            fixed.append((tuple(sorted(need.items())), times))
    return fixed, {s: n for s, n in stock.left.items() if n > 0}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over whole groups of equal containers."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[Pattern, int]]] = {}

    def add(room: int, pattern: Pattern, n: int) -> None:
        if n <= 0:
            return
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append((pattern, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n > 0:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                add(capacity - per * size, ((size, per),), n // per)
                add(capacity - (n % per) * size, ((size, n % per),), 1 if n % per else 0)
                break
            room = rooms[at]
            pattern, held = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            per = min(room // size, n)
            times = min(held, n // per)
            add(room, pattern, held - times)
            add(room - per * size, (*pattern, (size, per)), times)
            n -= per * times
    return [g for room in rooms for g in groups[room]]


def packed_patterns(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _slots(container_id: int, patterns: list[tuple[Pattern, int]]) -> list[tuple]:
    """Which numbers of each size go where: container_id, size, lo, hi, per, first bin."""
    rows, start, taken = [], 0, Counter()
    for pattern, times in patterns:
        for size, per in pattern:
            rows.append((container_id, size, taken[size], taken[size] + per * times, per, start))
            taken[size] += per * times
        start += times
    return rows


def capacities(containers: DataFrame) -> dict[int, int]:
    """The containers' capacities: a short list that the user wrote."""
    fit = containers.where("container_id is not null and capacity_tokens > 0").select("container_id", "capacity_tokens").limit(MOST_KINDS + 1).collect()
    if len(fit) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    return {r[0]: r[1] for r in fit}


def pieces(sizes: DataFrame, capacity: dict[int, int]) -> DataFrame:
    """container_id, doc_id, piece_no, token_start, n_tokens of every item to be packed."""
    kinds = F.array(*[F.struct(F.lit(c).cast("int").alias("id"), F.lit(n).cast("long").alias("most")) for c, n in sorted(capacity.items())])
    every = sizes.where("n_tokens > 0").withColumn("c", F.explode(kinds if capacity else F.array().cast("array<struct<id:int,most:bigint>>")))
    n = F.ceil(F.col("n_tokens") / F.col("c.most")).cast("int")
    cut = every.withColumn("piece_no", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("piece_no") * F.col("c.most")
    return cut.select(
        F.col("c.id").alias("container_id"), "doc_id", "piece_no", start.alias("token_start"), F.least("c.most", F.col("n_tokens") - start).alias("n_tokens")
    )


def packed(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """container_id, bin_no, doc_id, piece_no, token_start, n_tokens."""
    spark = documents.sparkSession
    sizes = token_sizes(documents, tokenizer=tokenizer)
    capacity = capacities(containers)
    items = pieces(sizes, capacity)
    # At most as many rows as the capacities sum to.
    histogram = items.groupBy("container_id", "n_tokens").agg(F.count("*").alias("n")).collect()
    # A size is numbered in so many parts that none is too long for a task.
    salts = max(1, -(-max((r["n"] for r in histogram), default=0) // NUMBERED))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    counted = stage(salted.groupBy("container_id", "n_tokens", "salt").agg(F.count("*").alias("n")), "counted")
    slots = []
    for cid, most in sorted(capacity.items()):
        slots += _slots(cid, packed_patterns({r["n_tokens"]: r["n"] for r in histogram if r["container_id"] == cid}, most))
    schema = "container_id int, size long, lo long, hi long, per long, first long"
    table = spark.createDataFrame(slots, schema).withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor((F.col("hi") - 1) / BLOCK)))
    )
    before = counted.withColumn(
        "ahead", F.sum("n").over(Window.partitionBy("container_id", "n_tokens").orderBy("salt")) - F.col("n")
    ).drop("n")
    local = Window.partitionBy("container_id", "n_tokens", "salt").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "piece_no")
    numbered = salted.withColumn("local", F.row_number().over(local) - 1).join(before, ["container_id", "n_tokens", "salt"])
    numbered = numbered.withColumn("number", F.col("ahead") + F.col("local")).withColumn("block", F.floor(F.col("number") / BLOCK))
    t = table.withColumnRenamed("container_id", "cid").withColumnRenamed("block", "in_block")
    placed = numbered.join(
        t,
        (F.col("container_id") == F.col("cid")) & (F.col("n_tokens") == F.col("size")) & (F.col("block") == F.col("in_block"))
        & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi")),
    )
    bin_no = F.col("first") + F.floor((F.col("number") - F.col("lo")) / F.col("per"))
    return placed.select("container_id", bin_no.cast("long").alias("bin_no"), "doc_id", "piece_no", "token_start", "n_tokens")


def packing_report(packing: DataFrame, containers: DataFrame) -> DataFrame:
    """container_id, capacity_tokens, bins, items, tokens, least_bins (no packing has fewer), fill, overfull_bins."""
    by_bin = packing.groupBy("container_id", "bin_no").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("items"))
    fit = containers.select("container_id", "capacity_tokens").where("capacity_tokens > 0")
    return (
        by_bin.join(F.broadcast(fit), "container_id")
        .groupBy("container_id", "capacity_tokens")
        .agg(
            F.count("*").alias("bins"), F.sum("items").alias("items"), F.sum("held").alias("tokens"),
            F.count_if(F.col("held") > F.col("capacity_tokens")).alias("overfull_bins"),
        )
        .withColumn("least_bins", F.ceil(F.col("tokens") / F.col("capacity_tokens")))
        .withColumn("fill", F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")))
    )
