"""Filling containers of fixed capacity with documents, measured in tokens.

Method: a grouping genetic algorithm on islands. Its genes are whole containers: a crossover injects well-filled
containers of one parent into the other, drops the containers that hold a document twice and puts the documents
displaced by that back by best fit. The documents of a capacity are spread over cells of bounded size by a hash;
each cell is evolved by several islands in tasks of their own, whose elites migrate around a ring between epochs.

A container that is full to the last token is as good as can be. It is injected into every individual once and for all,
so that evolution spends itself on the others and on a few full ones thawed for their documents. Containers that are
not full at the end of a round are opened, and their documents meet those of other cells in the next round, whose cells
are as many fewer as there are fewer documents left, until one cell holds them all.

A document is only split if it exceeds the capacity: into pieces of exactly the capacity and a last piece, which
is packed like a document. Pieces of the capacity fill a container each.

Defined results: null texts have no tokens; documents without tokens lie in a container with others or with
their like. Of repeated deliveries of a ``doc_id`` the latest ``updated_at`` counts (null first, then the larger
count). Rows with null ``doc_id`` are ignored, as are capacities that are null or below one. Extra columns are
ignored; without documents or capacities there are no rows.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import random
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.session import written

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Documents a cell has on average; its spread is that of a hash.
CELL = 2000
ISLANDS, EPOCHS = 2, 2
#: Generations of an epoch; a round of a single cell has no next one to mend what it leaves.
POPULATION, GENERATIONS, LAST_GENERATIONS = 10, 30, 300
#: Share of a cell's containers that stay open though they are full: those of the most documents, small ones that
#: fill the gaps of the next round.
OPEN_SHARE = 0.1
#: Containers filled to this share are final in every round; those of the last round are whatever they hold.
WELL_FILLED = 0.9995
#: A round that leaves more than this share of its documents open is the last: more rounds would not end.
SHRINK = 0.7


@functools.lru_cache(maxsize=2)
def encoding(path: str, vocabulary: str):
    """The public tokenizer, read from its folder."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("tokenizer_files", f"{path}/__init__.py")
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(f"{path}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens): one row a document."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path, vocabulary)
        for f in frames:
            yield pd.DataFrame(
                {
                    "doc_id": f["doc_id"], "at": f["at"],
                    "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in f["text"]],
                }
            )

    counted = (
        documents.filter(F.col("doc_id").isNotNull())
        .select(
            F.col("doc_id").cast("long").alias("doc_id"), "text",
            F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**62))).alias("at"),
        )
        .mapInPandas(count, "doc_id long, at long, tokens int")
    )
    return counted.groupBy("doc_id").agg(F.max(F.struct("at", "tokens")).alias("m")).select("doc_id", "m.tokens")


class Packing:
    """A solution: documents by container, and the tokens in each."""

    __slots__ = ("bins", "loads")

    def __init__(self, bins: list[list[int]], loads: list[int]):
        self.bins, self.loads = bins, loads

    def fitness(self, capacity: int) -> float:
        """Mean square of the fill: rewards full containers beside empty ones over evenly filled ones."""
        return sum((x / capacity) ** 2 for x in self.loads) / max(1, len(self.loads))


def best_fit(items: Sequence[int], sizes: Sequence[int], capacity: int, into: Packing) -> Packing:
    """Puts items, in this order, each into the fullest container that still takes it."""
    free = sorted((capacity - load, k) for k, load in enumerate(into.loads))
    for i in items:
        size = sizes[i]
        at = bisect_left(free, (size, -1))
        if at == len(free):
            into.bins.append([i])
            into.loads.append(size)
            insort(free, (capacity - size, len(into.bins) - 1))
        else:
            space, k = free.pop(at)
            into.bins[k].append(i)
            into.loads[k] += size
            insort(free, (space - size, k))
    return into


def crossover(a: Packing, b: Packing, sizes: Sequence[int], capacity: int, rng: random.Random) -> Packing:
    """Well-filled containers of ``b`` injected into ``a``."""
    order = sorted(range(len(b.bins)), key=lambda k: -b.loads[k])
    inject = [k for k in order[: max(1, len(order) // 2)] if rng.random() < 0.6] or order[:1]
    taken = {i for k in inject for i in b.bins[k]}
    child = Packing([list(b.bins[k]) for k in inject], [b.loads[k] for k in inject])
    displaced: list[int] = []
    for items, load in zip(a.bins, a.loads):
        if taken.isdisjoint(items):
            child.bins.append(items[:])
            child.loads.append(load)
        else:
            displaced += [i for i in items if i not in taken]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(displaced, sizes, capacity, child)


def mutate(p: Packing, sizes: Sequence[int], capacity: int, rng: random.Random) -> Packing:
    """Opens the emptiest containers and a few others and fits their documents again."""
    n = len(p.bins)
    order = sorted(range(n), key=lambda k: p.loads[k])
    opened = set(order[: max(1, n // 12)]) | {rng.randrange(n) for _ in range(max(1, n // 20))}
    loose = [i for k in opened for i in p.bins[k]]
    rest = [k for k in range(n) if k not in opened]
    child = Packing([p.bins[k][:] for k in rest], [p.loads[k] for k in rest])
    loose.sort(key=lambda i: -sizes[i] * (1 + 0.2 * rng.random()))
    return best_fit(loose, sizes, capacity, child)


def evolve(sizes: Sequence[int], capacity: int, seed: int, elites: list[list[int]], generations: int = GENERATIONS) -> Packing:
    """One island's epoch. ``elites``: solutions that migrated in, as the container of each document."""
    n = len(sizes)
    rng = random.Random(seed)
    population = []
    for e in elites:
        p = Packing([], [])
        place: dict[int, int] = {}
        for i, k in enumerate(e):
            at = place.setdefault(k, len(p.bins))
            if at == len(p.bins):
                p.bins.append([])
                p.loads.append(0)
            p.bins[at].append(i)
            p.loads[at] += sizes[i]
        population.append(p)
    if not population:
        population.append(best_fit(sorted(range(n), key=lambda i: -sizes[i]), sizes, capacity, Packing([], [])))
    bound = -(-sum(sizes) // capacity)
    best = min(population, key=lambda p: (len(p.bins), -p.fitness(capacity)))
    if len(best.bins) <= bound:
        return best  # no packing needs fewer containers
    # full containers of the best: most are kept for good, some are thawed beside those that are not full
    full = [k for k, load in enumerate(best.loads) if load == capacity]
    rng.shuffle(full)
    kept = full[: max(0, len(full) - max(8, len(best.bins) - len(full)))]
    frozen = Packing([best.bins[k] for k in kept], [best.loads[k] for k in kept])
    fixed = {i for b in frozen.bins for i in b}
    loose = [i for i in range(n) if i not in fixed]
    least = bound - len(kept)
    part = []
    for p in population:
        mine = [k for k, b in enumerate(p.bins) if fixed.isdisjoint(b)]
        own = Packing([p.bins[k] for k in mine], [p.loads[k] for k in mine])
        there = {i for b in own.bins for i in b}
        part.append(best_fit(sorted((i for i in loose if i not in there), key=lambda i: -sizes[i]), sizes, capacity, own))
    while len(part) < POPULATION:
        wild = rng.choice((0.05, 0.15, 0.35))
        keys = {i: -sizes[i] * (1 + wild * rng.random()) for i in loose}
        part.append(best_fit(sorted(loose, key=keys.__getitem__), sizes, capacity, Packing([], [])))
    scored = sorted(((-len(p.bins), p.fitness(capacity), -k, p) for k, p in enumerate(part)), reverse=True)
    for g in range(generations):
        if -scored[0][0] <= least:
            break
        a, b = scored[0][3], scored[1 + rng.randrange(len(scored) - 1)][3]
        if rng.random() < 0.5:
            a, b = b, a
        child = mutate(crossover(a, b, sizes, capacity, rng), sizes, capacity, rng)
        scored[-1] = (-len(child.bins), child.fitness(capacity), -POPULATION - g, child)
        scored.sort(reverse=True)
    won = scored[0][3]
    return Packing(frozen.bins + won.bins, frozen.loads + won.loads)


_ISLAND = "size_id int, capacity int, cell int, island int, docs array<struct<doc_id:long,piece:int,tokens:int>>, elites array<array<int>>"
_EVOLVED = (
    "size_id int, capacity int, cell int, island int, docs array<struct<doc_id:long,piece:int,tokens:int>>, "
    "bins array<int>, final array<boolean>, fitness double"
)


def finished(p: Packing, capacity: int) -> list[bool]:
    """For each container, whether a round leaves it as it is."""
    most = sorted(range(len(p.bins)), key=lambda k: (-len(p.bins[k]), k))[: int(OPEN_SHARE * len(p.bins))]
    stays = set(most)
    return [load >= WELL_FILLED * capacity and k not in stays for k, load in enumerate(p.loads)]


def _evolver(round_no: int, epoch: int, cells: dict[int, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bins, final, fit = [], [], []
            for size_id, capacity, cell, island, docs, elites in zip(
                f["size_id"], f["capacity"], f["cell"], f["island"], f["docs"], f["elites"]
            ):
                sizes = [d["tokens"] for d in docs]
                seed = hash((int(size_id), int(cell), int(island), round_no, epoch))
                last = cells[int(size_id)] == 1
                p = evolve(
                    sizes, int(capacity), seed, [list(map(int, e)) for e in elites] if elites is not None else [],
                    LAST_GENERATIONS if last else GENERATIONS,
                )
                where = np.zeros(len(sizes), np.int32)
                for k, items in enumerate(p.bins):
                    where[items] = k
                done = np.ones(len(p.bins), bool) if last else np.array(finished(p, int(capacity)), bool)
                bins.append(where)
                final.append(done[where])
                fit.append(p.fitness(int(capacity)) - len(p.bins))
            yield f[["size_id", "capacity", "cell", "island", "docs"]].assign(bins=bins, final=final, fitness=fit)

    return run


def _round(items: DataFrame, round_no: int, cells: dict[int, int]) -> DataFrame:
    """(size_id, capacity, cell, bin, final, doc_id, piece, tokens): one round over all cells, whose number is given by capacity."""
    count = F.create_map(*[F.lit(x) for kv in sorted(cells.items()) for x in kv])[F.col("size_id")]
    spread = items.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_no)), count).cast("int"))
    islands = (
        spread.groupBy("size_id", "capacity", "cell")
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", "piece", "tokens"))).alias("docs"))
        .withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])))
        .withColumn("elites", F.lit(None).cast("array<array<int>>"))
        .repartition("size_id", "cell", "island")
    )
    for epoch in range(EPOCHS):
        done = islands.select("size_id", "capacity", "cell", "island", "docs", "elites").mapInPandas(
            _evolver(round_no, epoch, cells), _EVOLVED
        )
        cell = done.groupBy("size_id", "capacity", "cell").agg(
            F.first("docs").alias("docs"),
            F.array_sort(F.collect_list(F.struct("island", "bins", "final", "fitness"))).alias("solved"),
        )
        if epoch + 1 == EPOCHS:
            break
        # each island goes on with its own elite and the one of its neighbour in the ring
        islands = cell.select(
            "size_id", "capacity", "cell", "docs", F.posexplode("solved").alias("at", "own"), "solved"
        ).select(
            "size_id", "capacity", "cell", F.col("own.island").alias("island"), "docs",
            F.array(
                F.col("own.bins"), F.element_at("solved", (F.pmod(F.col("at") + 1, F.size("solved")) + 1).cast("int"))["bins"]
            ).alias("elites"),
        ).repartition("size_id", "cell", "island")
    best = F.array_max(F.transform("solved", lambda s: F.struct(s["fitness"].alias("fitness"), s["island"].alias("island"), s["bins"].alias("bins"), s["final"].alias("final"))))
    return (
        cell.select("size_id", "capacity", "cell", "docs", best.alias("best"))
        .select("size_id", "capacity", "cell", F.explode(F.arrays_zip("docs", F.col("best.bins").alias("bin"), F.col("best.final").alias("final"))).alias("z"))
        .select(
            "size_id", "capacity", "cell", F.col("z.bin").alias("bin"), F.col("z.final").alias("final"), F.col("z.docs.doc_id").alias("doc_id"),
            F.col("z.docs.piece").alias("piece"), F.col("z.docs.tokens").alias("tokens"),
        )
    )


def _name(*parts: Column | str) -> Column:
    return F.concat_ws("-", *parts)


def containers(
    documents: DataFrame, sizes: DataFrame, path: str = TOKENIZERS, vocabulary: str = VOCABULARY
) -> DataFrame:
    """(size_id, doc_id, piece, first_token, tokens, container): where every document or piece lies."""
    caps = (
        sizes.filter((F.col("capacity_tokens") >= 1) & F.col("size_id").isNotNull())
        .groupBy(F.col("size_id").cast("int").alias("size_id"))
        .agg(F.max("capacity_tokens").cast("int").alias("capacity"))
    )
    counted = written(token_counts(documents, path, vocabulary))
    each = _with_capacities(counted, caps)
    pieces = each.select(
        "size_id", "capacity", "doc_id",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int"))),
                lambda k: F.least(F.col("tokens") - k * F.col("capacity"), F.col("capacity")),
            )
        ).alias("piece", "tokens"),
    )
    full = pieces.filter(F.col("tokens") == F.col("capacity")).withColumn("container", _name(F.lit("f"), "doc_id", "piece"))
    items = pieces.filter(F.col("tokens") < F.col("capacity"))
    out, r = full, 0
    left = {x["size_id"]: x["n"] for x in items.groupBy("size_id").agg(F.count("*").alias("n")).collect()}  # one row a capacity
    while left:
        cells = {s: max(1, -(-n // CELL)) for s, n in left.items()}
        well = written(_round(items, r, cells))
        rest = {x["size_id"]: x["n"] for x in well.filter("not final").groupBy("size_id").agg(F.count("*").alias("n")).collect()}
        stuck = [s for s, n in rest.items() if n > SHRINK * left[s] and n > CELL]
        done = F.col("final") | F.col("size_id").isin(stuck)
        out = out.unionByName(well.filter(done).withColumn("container", _name(F.lit(f"r{r}"), "cell", "bin")).select(out.columns))
        items = well.filter(~done).select("size_id", "capacity", "doc_id", "piece", "tokens")
        left, r = {s: n for s, n in rest.items() if s not in stuck}, r + 1
    return out.select(
        "size_id", "doc_id", "piece", (F.col("piece").cast("long") * F.col("capacity")).alias("first_token"), "tokens", "container"
    )


def _with_capacities(counted: DataFrame, caps: DataFrame) -> DataFrame:
    """Each document with each capacity: the capacities are a stated short list, carried along as literals."""
    rows = caps.orderBy("size_id").collect()
    listed = F.array(*[F.struct(F.lit(r["size_id"]).alias("size_id"), F.lit(r["capacity"]).alias("capacity")) for r in rows])
    if not rows:
        return counted.select(F.lit(0).alias("size_id"), F.lit(1).alias("capacity"), "doc_id", "tokens").limit(0)
    return counted.select(F.explode(listed).alias("c"), "doc_id", "tokens").select(
        "c.size_id", "c.capacity", "doc_id", "tokens"
    )


def fill(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Containers, tokens and used share per capacity, beside the least number that could do."""
    caps = sizes.select("size_id", F.col("capacity_tokens").alias("capacity"))
    return (
        packed.groupBy("size_id")
        .agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
        .join(caps, "size_id")
        .withColumn("used_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
        .withColumn("least", F.ceil(F.col("tokens") / F.col("capacity")))
    )


__all__ = ["containers", "crossover", "evolve", "fill", "token_counts"]
