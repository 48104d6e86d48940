"""Filling fixed-capacity containers with texts, by a grouping genetic algorithm.

Texts are measured in tokens of a public tokenizer. A text above the capacity
is cut into full containers and a rest; every other text stays whole. Rests
and whole texts are dealt into blocks by a hash of their id and number of tokens, so the same texts
give the same packing however they are stored. A block has so many items that one unfilled container
is little, but on average no more than a stated number; the blocks are packed side by side, each by several
islands with seeds of their own. An individual is a set of bins. The first ones are made in different ways:
best fit in falling and in disturbed order, and bin after bin filled as exactly as one or two items can. Crossover
injects a parent's well-filled bins whole into the other's and drops the bins
that then hold an item twice; mutation dissolves the emptiest bins and some
others. Displaced items first take the place of smaller ones where that fills a bin better, and what is
displaced then goes where it fits best. Between epochs the islands of a block pass
their elite on to the next island. A block is done when its bins are as few as a lower bound says they must be, or
after some generations without gain. The individual with the fewest bins wins,
then the one with its space most unevenly left.

Defined results: null and empty texts have 0 tokens and take a place without
room; a text of exactly the capacity fills a container; equal texts and
repeated rows are packed each; no texts or no containers of a capacity above 0 give no rows; every token of
every text has exactly one place. Other columns are ignored.
"""

from __future__ import annotations

import base64
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.storage import settle, shuffle_partitions

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Kinds of containers are a stated list, held by the driver.
MOST_KINDS = 1000
#: Fixed value: splits a text before the merges of the vocabulary are applied.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def count_tokens(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) under a byte-level vocabulary of ranks, whose file at the path ``tokenizer`` the driver reads.

    A vocabulary is about a megabyte; more than 64 MB raise an error.
    """
    with open(tokenizer, "rb") as f:
        content = f.read((64 << 20) + 1)
    if len(content) > 64 << 20:
        raise ValueError(f"{tokenizer} is larger than a vocabulary may be")
    vocabulary = docs.sparkSession.sparkContext.broadcast(content)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], ["d", "tokens"])

    return docs.select(doc_id, text).mapInArrow(count, f"`{doc_id}` {dict(docs.dtypes)[doc_id]}, tokens long")


class Bins:
    """One individual: items of ``sizes`` in bins of ``capacity``."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit r: some bin has room r

    def add(self, items: list[int], room: int) -> None:
        self.items.append(items)
        self.room.append(room)
        self.with_room[room].append(len(self.items) - 1)
        self.mask |= 1 << room

    def best_fit(self, displaced: list[int]) -> None:
        """Put items, largest first as given, where the least room is left over."""
        for i in displaced:
            size = self.sizes[i]
            fitting = self.mask >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                b = self.with_room[room].pop()
                if not self.with_room[room]:
                    self.mask &= ~(1 << room)
                left = room - size
                self.items[b].append(i)
                self.room[b] = left
                self.with_room[left].append(b)
                self.mask |= 1 << left
            else:
                self.add([i], self.capacity - size)

    def score(self) -> tuple[int, int]:
        """Less is better: bins, then minus the unevenness of their room."""
        return len(self.items), -sum(r * r for r in self.room)


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs: for each threshold the large items, and what the small ones need beside the room these leave."""
    count = [0] * (capacity + 1)
    for x in sizes:
        count[x] += 1
    half = capacity // 2
    large = sum(count[half + 1 :])
    best = -(-sum(sizes) // capacity)
    # from threshold t on: items above capacity - t stand alone, those from half up to that leave room for items of t and more
    room = sum((capacity - x) * count[x] for x in range(half + 1, capacity + 1))
    small = sum(x * count[x] for x in range(1, half + 1))
    for t in range(1, half + 1):
        room -= (t - 1) * count[capacity - t + 1]
        small -= (t - 1) * count[t - 1]
        best = max(best, large + max(0, -(-(small - room) // capacity)))
    return best


def _exchange(kept: list[list[int]], room: list[int], displaced: list[int], sizes: list[int]) -> list[int]:
    """Let displaced items take the place of one or two smaller ones where a bin gets fuller by it; what is displaced then."""
    by: dict[int, list[int]] = {}
    mask = 0  # bit s: an item of size s is displaced
    for i in displaced:
        by.setdefault(sizes[i], []).append(i)
        mask |= 1 << sizes[i]
    for b, items in enumerate(kept):
        free = room[b]
        if not free or len(items) > 32:
            continue
        best: tuple[int, int, tuple[int, ...]] = (0, 0, ())
        for x in range(len(items)):
            sx = sizes[items[x]]
            for gone, out in ((sx, (x,)), *((sx + sizes[items[y]], (x, y)) for y in range(x))):
                gain = ((mask >> (gone + 1)) & ((1 << free) - 1)).bit_length()
                if gain > best[0]:
                    best = (gain, gone + gain, out)
            if best[0] == free:
                break
        gain, size, out = best
        if gain:
            new = by[size].pop()
            if not by[size]:
                mask &= ~(1 << size)
            for x in sorted(out, reverse=True):
                i = items.pop(x)
                by.setdefault(sizes[i], []).append(i)
                mask |= 1 << sizes[i]
            items.append(new)
            room[b] = free - gain
    return [i for same in by.values() for i in same]


def _rebuilt(sizes: list[int], capacity: int, kept: list[list[int]], room: list[int], displaced: list[int]) -> Bins:
    kept, room = [list(items) for items in kept], list(room)
    displaced = _exchange(kept, room, displaced, sizes)
    out = Bins(sizes, capacity)
    for items, free in zip(kept, room, strict=True):
        out.add(items, free)
    displaced.sort(key=sizes.__getitem__, reverse=True)
    out.best_fit(displaced)
    return out


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Inject well-filled bins of ``a`` whole into ``b``."""
    tight = a.capacity // 100
    good = [k for k in range(len(a.items)) if a.room[k] <= tight and rng.random() < 0.5]
    injected = bytearray(len(a.sizes))
    for k in good:
        for i in a.items[k]:
            injected[i] = 1
    kept, room = [a.items[k] for k in good], [a.room[k] for k in good]
    displaced: list[int] = []
    for k, items in enumerate(b.items):
        if any(injected[i] for i in items):
            displaced += [i for i in items if not injected[i]]
        else:
            kept.append(items)
            room.append(b.room[k])
    return mutate(_rebuilt(a.sizes, a.capacity, kept, room, displaced), rng)


def mutate(a: Bins, rng: random.Random) -> Bins:
    """Dissolve the emptiest bins and a few others, and fit their items again."""
    order = sorted(range(len(a.items)), key=a.room.__getitem__)
    gone = set(order[-max(1, len(order) // 50) :]) | {k for k in order if rng.random() < 0.05}
    keep = [k for k in order if k not in gone]
    rng.shuffle(keep)
    return _rebuilt(a.sizes, a.capacity, [a.items[k] for k in keep], [a.room[k] for k in keep], [i for k in order if k in gone for i in a.items[k]])


def individual(sizes: list[int], capacity: int, rng: random.Random | None) -> Bins:
    """Best fit, largest first; with ``rng`` in an order slightly disturbed."""
    order = sorted(range(len(sizes)), key=(lambda i: -sizes[i]) if rng is None else (lambda i: -sizes[i] * (1 + 0.3 * rng.random())))
    out = Bins(sizes, capacity)
    out.best_fit(order)
    return out


def exact(sizes: list[int], capacity: int, pairs: int = 40) -> Bins:
    """Bin after bin: the largest item left, then the one or two that leave least room, of the ``pairs`` largest first ones."""
    by: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, x in enumerate(sizes):
        by[x].append(i)
        mask |= 1 << x
    out = Bins(sizes, capacity)

    def take(size: int) -> int:
        nonlocal mask
        i = by[size].pop()
        if not by[size]:
            mask &= ~(1 << size)
        return i

    empty = [take(0) for _ in range(len(by[0]))]
    while mask:
        size = mask.bit_length() - 1
        items, room = [take(size)], capacity - size
        while room and (low := mask & ((2 << room) - 1)):
            one = low.bit_length() - 1
            best, firsts = (one, (one,)), low
            for _ in range(pairs if one < room else 0):
                if not firsts or best[0] == room:
                    break
                x = firsts.bit_length() - 1
                firsts &= ~(1 << x)
                seconds = low & ((2 << min(room - x, x)) - 1)
                if seconds >> x and len(by[x]) < 2:
                    seconds &= ~(1 << x)
                if seconds and x + seconds.bit_length() - 1 > best[0]:
                    best = (x + seconds.bit_length() - 1, (x, seconds.bit_length() - 1))
            for x in best[1]:
                items.append(take(x))
                room -= x
        out.add(items, room)
    out.best_fit(empty)
    return out


def _from_assignment(sizes: list[int], capacity: int, assignment: list[int]) -> Bins:
    groups: list[list[int]] = [[] for _ in range(max(assignment, default=-1) + 1)]
    for i, b in enumerate(assignment):
        groups[b].append(i)
    out = Bins(sizes, capacity)
    for g in groups:
        out.add(g, capacity - sum(sizes[i] for i in g))
    return out


def evolve(sizes: list[int], capacity: int, elites: list[list[int]], seed: str, population: int, generations: int, stall: int = 3) -> tuple[list[int], tuple[int, int]]:
    """Best bin of each item, and its score, from the elites given and a fresh rest.

    Ends at the lower bound, or after ``stall`` generations without gain.
    """
    rng = random.Random(seed)
    least = lower_bound(sizes, capacity)
    rank = lambda people: sorted(((p.score(), n, p) for n, p in enumerate(people)), key=lambda x: x[:2])
    people = [_from_assignment(sizes, capacity, e) for e in elites] or [individual(sizes, capacity, None)]
    scored = rank(people)
    if scored[0][0][0] > least:
        if len(people) < population:
            people.append(exact(sizes, capacity))
        while len(people) < population:
            people.append(individual(sizes, capacity, rng))
        scored, idle = rank(people), 0
        for _ in range(generations):
            if scored[0][0][0] == least or idle == stall:
                break
            children = [crossover(*(min(rng.sample(scored, min(2, len(scored))))[2] for _ in range(2)), rng) for _ in range(max(1, population // 2))]
            before = scored[0][0]
            scored = rank([p for _, _, p in scored] + children)[:population]
            idle = 0 if scored[0][0] < before else idle + 1
    score, _, best = scored[0]
    out = [0] * len(sizes)
    for b, items in enumerate(best.items):
        for i in items:
            out[i] = b
    return out, score


def _epoch(blocks: DataFrame, population: int, generations: int, epoch: int) -> DataFrame:
    """Evolve each (container_id, block, island); elites are the best of this island and of the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for container, capacity, block, island, sizes, elites in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = [elites[island], elites[island - 1]] if elites else []
                best, (bins, room) = evolve(sizes, capacity, own, f"{container} {block} {island} {epoch}", population, generations)
                rows.append((container, block, island, best, bins, room))
            c, k, i, a, n, r = zip(*rows, strict=True) if rows else [()] * 6
            arrays = [pa.array(c, b.column(0).type), pa.array(k, pa.int64()), pa.array(i, pa.int32()), pa.array(a, pa.list_(pa.int32())), pa.array(n, pa.int32()), pa.array(r, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["container_id", "block", "island", "best", "bins", "room"])

    kind = dict(blocks.dtypes)["container_id"]
    return blocks.select("container_id", "capacity", "block", "island", "sizes", "elites").mapInArrow(run, f"container_id {kind}, block long, island int, best array<int>, bins int, room long")


def _copies(measured: DataFrame, at_once: int = 1000) -> DataFrame:
    """(doc, tokens, copy): equal rows numbered from 0, of (doc, tokens) in any order."""
    counted = measured.groupBy("doc", "tokens").agg(F.count(F.lit(1)).alias("n"))
    steps = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(at_once).cast("long"))))
    return steps.select("doc", "tokens", F.explode(F.sequence("first", F.least(F.col("n"), F.col("first") + at_once) - 1)).alias("copy"))


def pack(
    docs: DataFrame,
    containers: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    block_items: int = 5000,
    block_bins: int = 500,
    most_items: int = 20_000,
    islands: int = 2,
    epochs: int = 2,
    population: int = 6,
    generations: int = 6,
) -> DataFrame:
    """(container_id, capacity_tokens, doc_id, piece, token_start, tokens, bin, place, bin_start).

    Each piece of each text stands in the container ``bin`` of each kind
    (container_id, capacity_tokens), as number ``place`` from token ``bin_start`` on.
    A block has ``block_items`` items on average, or more where these fill fewer than ``block_bins`` containers, but
    never more than ``most_items`` on average.
    """
    partitions = 3 * shuffle_partitions(docs.sparkSession)
    measured = settle(_copies(count_tokens(docs, doc_id, text, tokenizer).withColumnRenamed(doc_id, "doc")), "tokens")
    kinds = [tuple(r) for r in containers.select("container_id", "capacity_tokens").where("capacity_tokens > 0").distinct().limit(MOST_KINDS + 1).collect()]
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    if not kinds:
        schema = f"container_id {dict(containers.dtypes)['container_id']}, capacity_tokens int, `{doc_id}` {dict(docs.dtypes)[doc_id]}, piece int, token_start long, tokens int, bin string, place int, bin_start int"
        return docs.sparkSession.createDataFrame([], schema)
    n, total = measured.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()

    def blocks_of(capacity: int) -> int:
        return max(1, -(-n // most_items), min(-(-n // block_items), total // (block_bins * capacity)))

    kind_rows = F.array(*(F.struct(F.lit(c).alias("container_id"), F.lit(int(k)).cast("int").alias("capacity"), F.lit(blocks_of(k)).alias("blocks")) for c, k in kinds))
    offered = measured.select("doc", "tokens", "copy", F.inline(kind_rows)).withColumn("block", F.pmod(F.xxhash64("doc", "tokens", "copy"), "blocks"))
    full = F.expr("tokens div capacity")
    rest = F.col("tokens") % F.col("capacity")
    item = F.struct("doc", "tokens", "copy", full.alias("piece"), rest.cast("int").alias("size"))
    items = offered.where((rest > 0) | (F.col("tokens") == 0)).select("container_id", "capacity", "block", item.alias("item"))
    blocks = settle(items.groupBy("container_id", "capacity", "block").agg(F.array_sort(F.collect_list("item")).alias("items")), "blocks")
    sized = blocks.withColumn("sizes", F.col("items.size"))
    best = None
    for epoch in range(epochs):
        start = sized.select("container_id", "capacity", "block", "sizes")
        if best is None:
            start = start.withColumn("elites", F.expr("cast(null as array<array<int>>)"))
        else:
            elites = best.groupBy("container_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("island", "best"))), lambda x: x["best"]).alias("elites"))
            start = start.join(elites, ["container_id", "block"])
        # a stated number of partitions isn't coalesced: the work is in the evolution, not in the bytes
        spread = start.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).repartition(partitions, "container_id", "block", "island")
        best = settle(_epoch(spread, population, generations, epoch), "elites")
    winner = best.groupBy("container_id", "block").agg(F.min_by("best", F.struct("bins", "room", "island")).alias("best"))
    placed = (
        blocks.join(winner, ["container_id", "block"])
        .select("container_id", "capacity", "block", F.inline(F.arrays_zip("items", "best")))
        .select("container_id", "capacity", "block", "best", "items.*")
    )
    # the places of a bin lie within one block; the window's groups are bins, of bounded size
    w = Window.partitionBy("container_id", "block", "best").orderBy(F.desc("size"), "doc", "tokens", "copy", "piece")
    in_bins = placed.select(
        "container_id",
        F.col("capacity").alias("capacity_tokens"),
        F.col("doc").alias(doc_id),
        F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * F.col("capacity")).cast("long").alias("token_start"),
        F.col("size").cast("int").alias("tokens"),
        F.concat_ws("-", F.lit("b"), "block", "best").alias("bin"),
        F.row_number().over(w).alias("place"),
        (F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).cast("int").alias("bin_start"),
    )
    whole = offered.where(full > 0).select("container_id", "capacity", "doc", "tokens", "copy", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"))
    owner = F.when(F.col("doc").isNull(), "n").otherwise(F.concat(F.lit("f-"), F.col("doc").cast("string")))
    own_bins = whole.select(
        "container_id",
        F.col("capacity").alias("capacity_tokens"),
        F.col("doc").alias(doc_id),
        F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * F.col("capacity")).cast("long").alias("token_start"),
        F.col("capacity").alias("tokens"),
        F.concat_ws("-", owner, "tokens", "copy", "piece").alias("bin"),
        F.lit(1).alias("place"),
        F.lit(0).alias("bin_start"),
    )
    return own_bins.union(in_bins)


def check(packed: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(container_id, capacity_tokens, texts, tokens_astray, overfull, cut_for_nothing, places_astray) of a packing.

    Texts placed, tokens of these without a place of their own or beyond their text's, containers above their
    capacity, texts cut although they fit, and pieces that don't begin where the one before them in the container ends.
    """
    kind = ["container_id", "capacity_tokens"]
    true = count_tokens(docs, doc_id, text, tokenizer).groupBy(F.col(doc_id).alias("true_id")).agg(F.sum("tokens").alias("true_tokens"), F.count(F.lit(1)).alias("rows"), F.max("tokens").alias("largest"))
    own = packed.groupBy(*kind, doc_id).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("token_start") == 0).alias("begun"), F.sum("token_start").alias("starts"))
    both = own.join(true, F.col(doc_id).eqNullSafe(F.col("true_id")), "full_outer")  # a text without any place gives a row of null kind
    # the pieces of a text begin at 0, capacity, 2 x capacity, ...: their sum tells a wrong or missing one
    k = F.expr("(true_tokens + capacity_tokens - 1) div capacity_tokens")
    astray = F.coalesce(F.abs(F.col("tokens") - F.col("true_tokens")), F.col("true_tokens"), F.col("tokens")) + F.when((F.col("rows") == 1) & (F.col("starts") != F.col("capacity_tokens") * (F.expr("true_tokens > 0").cast("int") * k * (k - 1) / 2)), 1).otherwise(0)
    texts = both.groupBy(*kind).agg(F.sum("begun").alias("texts"), F.sum(astray).cast("long").alias("tokens_astray"), F.count_if((F.col("largest") <= F.col("capacity_tokens")) & (F.col("pieces") > F.col("rows"))).alias("cut_for_nothing"))
    w = Window.partitionBy(*kind, "bin").orderBy("place")
    follows = packed.withColumn("expected", F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("number", F.row_number().over(w))
    bins = follows.groupBy(*kind, "bin").agg(F.sum("tokens").alias("tokens"), F.count_if((F.col("expected") != F.col("bin_start")) | (F.col("number") != F.col("place"))).alias("astray"))
    filled = bins.groupBy(*kind).agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("overfull"), F.sum("astray").alias("places_astray"))
    return texts.join(filled, kind, "full_outer").select(*kind, "texts", "tokens_astray", "overfull", "cut_for_nothing", "places_astray")


def fill(packed: DataFrame) -> DataFrame:
    """(container_id, capacity_tokens, bins, tokens, least_bins, fill_share) of a packing."""
    sums = packed.groupBy("container_id", "capacity_tokens").agg(F.countDistinct("bin").alias("bins"), F.sum("tokens").cast("long").alias("tokens"))
    return sums.withColumns({"least_bins": F.ceil(F.col("tokens") / F.col("capacity_tokens")), "fill_share": F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6)})
