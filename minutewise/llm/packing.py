"""Packing token pieces into sequences by bin completion over the histogram of lengths.

A piece has 1 to `capacity` tokens, so all pieces of a corpus are a histogram of at most `capacity` lengths, whatever
its size. The search branches over the fillings of one bin after another. At each node it takes the largest length left
and enumerates the undominated fillings around it, the fullest first and the largest pieces first among equally full
ones; a filling is dominated (Martello and Toth) if some of its pieces can be exchanged for one larger piece that is
still there. A filling is first applied as often as the histogram allows, which uses up at least one length, so that
the first dive takes about as many steps as there are lengths; on the way back it is applied once, so that no packing is
out of reach. A branch is left when its bins and the lower bound of what is left (Martello and Toth's L2) are more than
the incumbent has, or if its waste is more than such a packing can afford. The incumbent is best-fit decreasing at first.

The plan of the search is taken if it has no more bins than best fit. It is proven optimal if it meets the lower bound or
the search ends before `NODES` nodes; else the plan is the best one met, and `plan_gap`, a column of the result, tells how
many sequences it may be from the fewest.

The plan is a list of fillings with multiplicities: a few thousand numbers at most, proven by the number of lengths. A
piece's sequence follows from its rank among the pieces of its length, by arithmetic: ranks come from prefix sums over
the parts in which the pieces were written, so neither a length that a third of all pieces share nor any other group
is gathered in one place.

Defined results: a null or empty text is one piece that holds the end id; a text over `capacity` ids is cut into full
pieces, of which the first takes the remainder; repeated rows, null ids and ties are packed one by one; an empty table
gives no sequences; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutewise.llm.shared import per_worker, staged
from minutewise.llm.token_counts import slices
from minutewise.llm.token_ids import PieceEncoder

CAPACITY = 2048
END = 0
#: Nodes of the search and fillings looked at, together; beyond, the best plan so far is taken.
NODES = 12_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, part (where it was made), nth (of its length there, from 0)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(f"ids {vocabulary}", lambda: PieceEncoder(vocabulary))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        last = np.array([end], "<u4")
        for b in batches:
            for s in slices(b):
                out = []
                for doc_id, ids in zip(s.column("doc_id").to_pylist(), encoder.encode(s.column("text")), strict=True):
                    ids = np.concatenate((ids, last))
                    first = (len(ids) - 1) % capacity + 1
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                        out.append((doc_id, k, a, z - a, zlib.crc32(ids[a:z].tobytes()), part, int(seen[z - a])))
                        seen[z - a] += 1
                columns = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over a histogram: fillings and how often each is used."""
    left, plan = counts.copy(), []
    while left.any():
        rest, filling = capacity, []
        take = left.copy()
        while rest > 0:
            fits = np.flatnonzero(take[: rest + 1])
            if not len(fits):
                break
            filling.append(int(fits[-1]))
            take[fits[-1]] -= 1
            rest -= int(fits[-1])
        plan.append((filling, apply(left, filling)))
    return plan


def apply(left: np.ndarray, filling: list[int]) -> int:
    """Takes a filling from the histogram as often as it is there."""
    sizes, uses = np.unique(filling, return_counts=True)
    times = int((left[sizes] // uses).min())
    left[sizes] -= uses * times
    return times


def lower_bound(left: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2: for each k, pieces over capacity - k stand alone, those over half need a bin each, those from k
    up to half fill up what these leave. Also, of pieces over capacity / (m + 1) no more than m share a bin."""
    n, t = np.r_[0, np.cumsum(left)], np.r_[0, np.cumsum(left * np.arange(capacity + 1))]
    half = capacity // 2
    k = np.arange(half + 1)
    alone, middle = n[-1] - n[capacity - k + 1], n[capacity - k + 1] - n[half + 1]
    room = middle * capacity - (t[capacity - k + 1] - t[half + 1])
    small = t[half + 1] - t[k]
    m = np.arange(1, capacity + 1)
    large = n[-1] - n[capacity // (m + 1) + 1]
    return int(max((alone + middle + np.maximum(0, -(-(small - room) // capacity))).max(), (-(-large // m)).max()))


def copies(reach: int, n: int, stock: int) -> int:
    """The sums (bits) that up to `stock` more pieces of length n make."""
    step = 1
    while stock > 0:
        take = min(step, stock)
        reach |= reach << (n * take)
        stock -= take
        step *= 2
    return reach


def is_dominated(filling: list[int], slack: int, stock: dict[int, int], there: int | None = None) -> bool:
    """Whether one piece that is left over could take the place of several, or of a smaller one. there: the lengths of the stock, as bits."""
    one = several = 0
    if there is None:
        there = sum(1 << n for n in stock if stock[n])
    for n in filling:
        several |= several << n | one << n
        one |= 1 << n
    for n in set(filling):
        if filling.count(n) >= stock.get(n, 0):
            there &= ~(1 << n)
    # Sums, and sums up to `slack` above them; of single pieces only what is above.
    above, width = several, 1
    more, wide = one << 1 if slack else 0, 1
    while width <= slack:
        step = min(width, slack + 1 - width)
        above |= above << step
        width += step
    while wide < slack:
        step = min(wide, slack - wide)
        more |= more << step
        wide += step
    return bool((above | more) & there)


def fillings(left: np.ndarray, capacity: int, most_waste: int, budget: list[int]) -> Iterator[tuple[list[int], int]]:
    """The undominated fillings around the largest length left, with their waste, from full ones on up to `most_waste`.

    Sums within reach of the lengths from each place on (bits of a number) lead the enumeration, so that it has no dead ends.
    Each filling looked at, dominated or not, takes one from the budget; without a budget there are no more.
    """
    largest = int(np.flatnonzero(left)[-1])
    rest = capacity - largest
    stock = {int(n): min(int(left[n]), rest // int(n)) for n in np.flatnonzero(left[: rest + 1])[::-1]}
    if largest in stock:
        stock[largest] = min(int(left[largest]) - 1, rest // largest)
    lengths = [n for n in stock if stock[n]]
    there = sum(1 << n for n in lengths)
    keep = (1 << (rest + 1)) - 1
    reach = [1]
    for n in reversed(lengths):
        reach.append(copies(reach[-1], n, stock[n]) & keep)
    reach.reverse()  # reach[i]: sums of lengths[i:]

    def exact(i: int, total: int) -> Iterator[list[int]]:
        if total == 0:
            yield []
            return
        while i < len(lengths) and lengths[i] > total:
            i += 1
        # The first place from which the total can be made with its length: those before it only pass it on.
        while i < len(lengths) and reach[i] >> total & 1:
            n = lengths[i]
            for c in range(min(stock[n], total // n), 0, -1):
                if reach[i + 1] >> (total - n * c) & 1:
                    for more in exact(i + 1, total - n * c):
                        yield [n] * c + more
            i += 1

    for waste in range(min(rest, most_waste) + 1):
        if reach[0] >> (rest - waste) & 1:
            for f in exact(0, rest - waste):
                budget[0] -= 1
                if budget[0] < 0:
                    return
                if not is_dominated(f, waste, stock, there):
                    yield [largest, *f], waste


def search(counts: np.ndarray, capacity: int, most: int, bound: int, nodes: int) -> tuple[list[tuple[list[int], int]] | None, bool]:
    """A packing of at most `most` bins, as few as the search finds, and whether it is proven that there are no fewer."""
    size = np.arange(capacity + 1)
    tokens = int((counts * size).sum())
    best, plan = None, []
    left, used, wasted = counts.copy(), 0, 0
    budget = [nodes]
    # A node: its fillings still to come, the one to apply once on the way back, what it has applied.
    stack: list[list] = []
    down = True
    while True:
        if down:
            if not left.any():
                best, most = list(plan), used - 1
                if used == bound:
                    return best, True
            elif used + lower_bound(left, capacity) <= most:
                stack.append([fillings(left, capacity, most * capacity - tokens - wasted, budget), None, None])
        if budget[0] < 0:
            return best, False
        if not stack:
            return best, True
        node = stack[-1]
        if node[2] is not None:  # takes back what the node applied
            filling, times, waste = node[2]
            plan.pop()
            np.add.at(left, filling, times)
            used, wasted, node[2] = used - times, wasted - times * waste, None
        if node[1] is not None:
            (filling, waste), node[1] = node[1], None
            times = 1
        else:
            found = next(node[0], None)
            if found is None:
                stack.pop()
                down = False
                continue
            filling, waste = found
            sizes, uses = np.unique(filling, return_counts=True)
            times = int((left[sizes] // uses).min())
            if waste:
                times = max(1, min(times, (most * capacity - tokens - wasted) // waste))
            node[1] = found if times > 1 else None
        if wasted + times * waste > most * capacity - tokens:
            down = False
            continue
        budget[0] -= 1
        np.subtract.at(left, filling, times)
        plan.append((filling, times))
        used, wasted, node[2] = used + times, wasted + times * waste, (filling, times, waste)
        down = True


def bins(plan: list[tuple[list[int], int]]) -> int:
    return sum(times for _, times in plan)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int | None = None) -> list[tuple[list[int], int]]:
    """Fillings and how often each is used, for a histogram of lengths."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    incumbent = best_fit(counts, capacity)
    found, _ = search(counts, capacity, bins(incumbent), lower_bound(counts, capacity), NODES if nodes is None else nodes)
    return incumbent if found is None else found


def plan_gap(histogram: dict[int, int], plan: list[tuple[list[int], int]], capacity: int = CAPACITY) -> int:
    """Bins of the plan over the lower bound: 0 is proven optimal."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    return bins(plan) - lower_bound(counts, capacity)


def laid_out(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """The plan as runs of ranks of one length that are laid out alike: from the rank `low` to `high`, `uses` of them in each
    of the sequences from `first_sequence` on, from `first_offset` on; and the plan's gap."""
    taken: dict[int, int] = dict.fromkeys(histogram, 0)
    runs, sequence = [], 0
    plan = plan_bins(histogram, capacity)
    for filling, times in plan:
        sizes, uses = np.unique(filling, return_counts=True)
        offset = 0
        for n, u in zip(sizes.tolist()[::-1], uses.tolist()[::-1], strict=True):
            runs.append((n, taken[n], taken[n] + u * times, u, sequence, offset))
            taken[n] += u * times
            offset += n * u
        sequence += times
    return pd.DataFrame(runs, columns=["length", "low", "high", "uses", "first_sequence", "first_offset"]).assign(plan_gap=plan_gap(histogram, plan, capacity))


LAYOUT = "length long, low long, high long, uses long, first_sequence long, first_offset long, plan_gap long"


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id, offset, and plan_gap (sequences over the lower bound, 0: proven fewest) to the rows of token_pieces()."""
    rows = staged(pieces, "pieces")
    counts = staged(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")

    def planned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        histogram = {n: k for pdf in frames for n, k in zip(pdf.length.tolist(), pdf.n.tolist(), strict=True)}
        if histogram:
            yield laid_out(histogram, capacity)

    # One task plans, from `capacity` rows at most.
    layout = staged(counts.groupBy("length").agg(F.sum("n").alias("n")).repartition(1).mapInPandas(planned, LAYOUT), "layout")
    # Which ranks each part's pieces of a length have: parts x lengths small rows, added up length by length.
    before = F.expr("coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0)")
    ranks = counts.select("part", "length", before.alias("before"))
    ranked = rows.join(ranks, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    # A few thousand rows, by the number of lengths and of fillings.
    laid = ranked.join(F.broadcast(layout), (ranked["length"] == layout["length"]) & (ranked["rank"] >= layout["low"]) & (ranked["rank"] < layout["high"])).drop(layout["length"])
    return laid.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("first_sequence + (rank - low) div uses").alias("sequence_id"),
        F.expr("first_offset + (rank - low) % uses * length").alias("offset"),
        "plan_gap",
    )


def packing_query(docs: DataFrame, vocabulary: str) -> DataFrame:
    return pack(token_pieces(docs, vocabulary))
