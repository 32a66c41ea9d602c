"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become token pieces of at most ``capacity``; pieces are spread evenly over blocks of bounded size. Each
block is packed by several islands: populations of packings that start from best-fit with different orders and
evolve by group crossover (whole well-filled bins of one parent are injected into the other, bins that hold
duplicates are dissolved, the displaced pieces go back in by best-fit). Between rounds each island's elite moves to
the next island. An island rests once it reaches a lower bound that can't be beaten. Bins that stay under-filled are opened again and their pieces packed in new blocks from all over the
corpus, so that leftovers of many blocks meet.

Defined results: a NULL text is empty and has one piece (the end id alone); repeated rows are packed one by one;
NULL ids and extra columns don't matter; ties go to the earlier piece. An empty table gives no rows.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.memory import claim
from ledgerline.llm.tokens import groups_by_size, word_tokenizer
from ledgerline.session import cut_lineage

PIECE = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    stop = np.array([end_id], dtype="<u4").tobytes()

    def cut(ids: bytes) -> list[dict]:
        ids += stop
        return [{"piece": k, "start": k * capacity, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                for k, part in enumerate(ids[a:a + 4 * capacity] for a in range(0, len(ids), 4 * capacity))]

    @F.pandas_udf(PIECE)
    def pieces(texts: pd.Series) -> pd.Series:
        claim("tokens", word_tokenizer.cache_clear)
        t = word_tokenizer(tokenizer_path)
        whole = (x if isinstance(x, str) else "" for x in texts)
        return pd.Series([cut(ids) for some in groups_by_size(whole) for ids in t.ids(some)], dtype=object)

    return (df.select(F.col(id_col).alias("doc_id"), F.explode(pieces(text_col)).alias("p"))
            .select("doc_id", "p.*"))


# -- one island -----------------------------------------------------------------------------------

def best_fit(lengths, items, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Puts items, in the given order, where the least room is left; opens a bin when none has room. ``rooms`` is a
    bit set of the sizes of room that some bin has."""
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for k, b in enumerate(bins):
        r = capacity - sum(lengths[i] for i in b)
        by_room.setdefault(r, []).append(k)
        rooms |= 1 << r
    for i in items:
        size = lengths[i]
        wide = rooms >> size
        if wide:
            r = size + (wide & -wide).bit_length() - 1
            k = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
            bins[k].append(i)
        else:
            r, k = capacity, len(bins)
            bins.append([i])
        r -= size
        by_room.setdefault(r, []).append(k)
        rooms |= 1 << r
    return bins


def fitness(lengths, bins, capacity: int) -> float:
    """Mean of squared fills less the number of bins: fewer bins first, then fuller ones."""
    fill = [sum(lengths[i] for i in b) / capacity for b in bins]
    return sum(f * f for f in fill) / max(1, len(fill)) - len(bins)


def _descending(lengths, items):
    return sorted(items, key=lambda i: (-lengths[i], i))


def crossover(lengths, one, two, capacity: int, rng: random.Random, well_filled: float = 0.999):
    """Injects well-filled bins of ``two`` into ``one``."""
    good = [b for b in two if sum(lengths[i] for i in b) >= well_filled * capacity]
    inject = [list(b) for b in good if rng.random() < 0.5]
    taken = {i for b in inject for i in b}
    whole, displaced = [], []
    for b in one:
        if taken.isdisjoint(b):
            whole.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    return inject + best_fit(lengths, _descending(lengths, displaced), whole, capacity)


def mutate(lengths, bins, capacity: int, rng: random.Random, share: float = 0.1):
    """Dissolves the emptiest bins and a few others."""
    order = sorted(range(len(bins)), key=lambda k: sum(lengths[i] for i in bins[k]))
    gone = set(order[:max(1, int(share * len(bins) / 2))]) | {k for k in order if rng.random() < share / 2}
    items = [i for k in gone for i in bins[k]]
    rng.shuffle(items)
    items.sort(key=lambda i: -lengths[i] * rng.uniform(0.8, 1.0))
    return best_fit(lengths, items, [list(b) for k, b in enumerate(bins) if k not in gone], capacity)


def least_bins(lengths, capacity: int) -> int:
    """A number of bins that no packing can beat. For each size a: pieces over capacity - a share a bin with nothing of
    size a or more; pieces over half need a bin each; of the pieces from a to half, what doesn't fit beside them needs
    further room. The largest of these counts, and of total length over capacity."""
    n = np.bincount(np.asarray(lengths, dtype=np.int64), minlength=capacity + 1)[:capacity + 1]
    count, total = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    a = np.arange(0, half + 1)
    alone = count[capacity] - count[capacity - a]
    large = count[capacity - a] - count[half]
    room = large * capacity - (total[capacity - a] - total[half])
    small = total[half] - np.where(a > 0, total[a - 1], 0)
    return int((alone + large + np.maximum(0, -(-(small - room) // capacity))).max(initial=-(-total[capacity] // capacity)))


def evolve(lengths, immigrants, capacity: int, seed: int, population: int = 6, generations: int = 8):
    """The best packing that one island finds: a list of bins (lists of item numbers)."""
    rng = random.Random(seed)
    least = least_bins(lengths, capacity)
    everyone = [[list(b) for b in p] for p in immigrants]
    order = _descending(lengths, range(len(lengths)))
    while len(everyone) < population and min((len(p) for p in everyone), default=least + 1) > least:
        some = order if not everyone else sorted(order, key=lambda i: -lengths[i] * rng.uniform(0.9, 1.0))
        everyone.append(best_fit(lengths, some, [], capacity))
    rank = lambda p: -fitness(lengths, p, capacity)
    everyone.sort(key=rank)
    for _ in range(generations):
        if len(everyone[0]) <= least or len(everyone) < 2:
            break
        parents = [min(rng.sample(range(len(everyone)), 2)) for _ in range(population)]
        young = [crossover(lengths, everyone[a], everyone[b], capacity, rng)
                 for a, b in zip(parents, rng.sample(parents, population))]
        young.append(mutate(lengths, everyone[0], capacity, rng))
        everyone = sorted(everyone + young, key=rank)[:population]
    return everyone[0]


def _numbers(bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(numbers) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(numbers):
        bins.setdefault(int(k), []).append(i)
    return list(bins.values())


# -- islands on Spark -----------------------------------------------------------------------------

def _pack_blocks(items: DataFrame, n_blocks: int, capacity: int, islands: int, rounds: int, salt: int) -> DataFrame:
    """Packs (row, length, ...) in blocks: adds block, bin, offset, fill."""
    cols = items.columns
    block = F.pmod(F.xxhash64(F.lit(salt), F.col("row")), F.lit(n_blocks))
    blocks = cut_lineage(
        items.groupBy(block.alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col("row"), *[c for c in cols if c != "row"]))).alias("items")))

    @F.pandas_udf("bins array<int>, score double")
    def island_round(block: pd.Series, island: pd.Series, lengths: pd.Series, elites: pd.Series) -> pd.DataFrame:
        out = []
        for b, k, ls, es in zip(block, island, lengths, elites):
            ls = [int(x) for x in ls]
            best = evolve(ls, [_bins(e) for e in es], capacity, seed=hash((salt, int(b), int(k), len(es))))
            out.append((_numbers(best, len(ls)), fitness(ls, best, capacity)))
        return pd.DataFrame(out, columns=["bins", "score"])

    lengths = F.transform("items", lambda x: x["length"])
    state = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                          lengths.alias("lengths"), F.array().cast("array<array<int>>").alias("elites"))
    for r in range(rounds):
        found = state.withColumn("found", island_round("block", "island", "lengths", "elites"))
        one = F.struct(F.col("found.score").alias("score"), (-F.col("island")).alias("neg_island"),
                       F.col("found.bins").alias("bins"))
        meet = found.groupBy("block").agg(F.sort_array(F.collect_list(one), asc=False).alias("all"))
        if r < rounds - 1:
            # migration: island k gets its own best and the best of island k - 1
            by_island = F.transform(F.sequence(F.lit(0), F.lit(islands - 1)), lambda k: F.struct(
                k.alias("island"),
                F.transform(F.filter("all", lambda a: (a["neg_island"] == -k)
                                     | (a["neg_island"] == -F.pmod(k + islands - 1, F.lit(islands)))),
                            lambda a: a["bins"]).alias("elites")))
            state = (meet.select("block", F.explode(by_island).alias("i")).join(blocks, "block")
                     .select("block", "i.island", lengths.alias("lengths"), "i.elites"))
        else:
            best = meet.select("block", F.col("all")[0]["bins"].alias("bins"))

    @F.pandas_udf("array<struct<bin:int,offset:long,fill:long>>")
    def places(lengths: pd.Series, bins: pd.Series) -> pd.Series:
        out = []
        for ls, numbers in zip(lengths, bins):
            used: dict[int, int] = {}
            rows = []
            for size, k in zip(ls, numbers):
                rows.append([int(k), used.get(int(k), 0)])
                used[int(k)] = rows[-1][1] + int(size)
            out.append([{"bin": k, "offset": o, "fill": used[k]} for k, o in rows])
        return pd.Series(out, dtype=object)

    joined = best.join(blocks, "block").withColumn("at", places(lengths, "bins"))
    pairs = F.zip_with("items", "at", lambda a, b: F.struct(a.alias("item"), b.alias("at")))
    return (joined.select("block", F.explode(pairs).alias("x"))
            .select("x.item.*", "block", "x.at.bin", "x.at.offset", "x.at.fill"))


def pack(pieces: DataFrame, capacity: int = 4096, block_size: int = 4096, islands: int = 4, rounds: int = 2,
         full_enough: float = 0.99) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to capacity. ``pieces`` should be a written
    or checkpointed table (it is read twice, and its rows are numbered by place)."""
    cols = pieces.columns
    items = pieces.withColumn("row", F.monotonically_increasing_id())
    alone = items.where(F.col("length") >= capacity)
    rest = items.where(F.col("length") < capacity)
    n = rest.count()
    first = cut_lineage(_pack_blocks(rest, max(1, round(n / block_size)), capacity, islands, rounds, salt=1))
    done = F.col("fill") >= full_enough * capacity
    left = first.where(~done).select(*rest.columns)
    m = left.count()
    again = _pack_blocks(left, max(1, round(m / block_size)), capacity, islands, rounds, salt=2)

    def place(df, level):
        return df.select(*cols, ((F.col("block") * (1 << 20) + F.col("bin")) * 4 + level).alias("sequence_id"), "offset")

    return (alone.select(*cols, (F.col("row") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
            .unionByName(place(first.where(done), 1)).unionByName(place(again, 2)))


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id",
                   text_col: str = "text", **how) -> DataFrame:
    """Tokenizes, cuts and packs whole documents."""
    pieces = cut_lineage(token_pieces(df, tokenizer_path, capacity, id_col=id_col, text_col=text_col))
    return pack(pieces, capacity, **how)
