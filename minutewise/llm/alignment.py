"""Cross-tokenizer alignment: which tokens of a byte-level BPE and of a sentencepiece model cover the same bytes.

Both libraries' tokens of a text are ranges of the same bytes. Tokens that overlap are joined in a bipartite graph with
one edge a stretch between two neighbouring ends, so with no more edges than tokens, and a union-find over arrays
(hooking roots, halving paths, for all texts of a batch at once) finds its components. Tokens are ranges in a row, so
the components are exactly the smallest groups that no token crosses: a group ends where both sides end. Members of a
component expand to its links, the pairs that end together (and, as `n_overlaps`, all pairs that overlap).

Neither side has a token that runs from a visible character into a blank or a line feed (the byte-level pre-tokenizer
never crosses it; that the other model has no such piece is tested when it is loaded). So a text falls into pieces, each
a blank or line feed with what follows, that are aligned on their own, and a worker keeps what it has met. Texts are
encoded once. Each document's distinct pairs, with their numbers, are written; pairs are counted in partial sums over
all documents; counts and each B id's highest come back by a join on the pair. The table of pairs is no larger than the
two vocabularies allow; it is broadcast only if it was counted to have no more than `BROADCAST_PAIRS` rows, else
Spark shuffles the join.

Defined results: a null or empty text, and a text whose bytes a side doesn't give back (as one with U+2581), has no tokens:
zeros and an empty digest. Rows that repeat a doc_id, or have none, are counted one by one; ties for a B id's highest
count are all best; texts of any length are aligned whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minutewise.llm.shared import per_worker, staged
from minutewise.llm.token_counts import SPACE, byte_symbols, slices
from minutewise.llm.token_ids import PATTERN

#: Bytes of a worker's kept pieces, about; pieces of more than KEPT_PIECE characters are aligned but not kept.
KEPT, KEPT_PIECE = 120_000_000, 64
CHUNK = 4096
BROADCAST_PAIRS = 2_000_000
SHIFT = 32
MARK = "▁"
#: A blank or line feed after a visible character starts a piece.
PIECES = re.compile(rf"[ \n]+[^ \n]*(?:(?<=[{SPACE}])[ \n]+[^ \n]*)*")


def components(edges_a: np.ndarray, edges_b: np.ndarray, n: int) -> np.ndarray:
    """Union-find over arrays: each of n nodes' smallest node of its component."""
    parent = np.arange(n)
    while True:
        a, b = parent[edges_a], parent[edges_b]
        apart = a != b
        if not apart.any():
            return parent
        edges_a, edges_b = edges_a[apart], edges_b[apart]
        low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(parent, high, low)  # roots hang below the smallest root that they meet
        while True:
            grand = parent[parent]
            if np.array_equal(grand, parent):
                break
            parent = grand


class Grown:
    """A flat array that rows of any length are appended to."""

    def __init__(self):
        self.flat, self.ends, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 12, np.int64), 0

    @staticmethod
    def put(to: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
        need = at + len(values)
        if need > len(to):
            to = np.r_[to[:at], np.zeros(max(need, 2 * len(to)) - at, to.dtype)]
        to[at:need] = values
        return to

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        at = int(self.ends[self.n])
        self.flat = self.put(self.flat, at, values)
        self.ends = self.put(self.ends, self.n + 1, at + np.cumsum(sizes))
        self.n += len(sizes)

    def rows(self, which: np.ndarray) -> np.ndarray:
        """The rows' values one after another."""
        first, sizes = self.ends[which], self.ends[which + 1] - self.ends[which]
        upto = np.r_[0, np.cumsum(sizes)]
        return self.flat[np.arange(upto[-1]) + np.repeat(first - upto[:-1], sizes)]


class Aligner:
    """Both vocabularies, and what is known of pieces: tokens, groups, links, overlaps, digest, link codes."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece
        import tiktoken

        with open(bytes_path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = {c: b for b, c in enumerate(byte_symbols())}
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(shown.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in added}
        made = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("the vocabulary's ids don't follow its merges")
        self.a = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.a_bytes[i] = len(token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        n = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(n)]
        if any("\n" in t or re.search(f"[^{MARK}]{MARK}", t) for t in names):
            raise ValueError("the model has pieces that run into a blank or hold a line feed")
        self.b_text = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(names)]
        self.b_bytes = np.array(list(map(len, self.b_text)), np.int64)
        self.blank = self.b.piece_to_id(MARK)
        #: An id and the sign after it: inside a side, after the first side, after a group, after a piece.
        numbers = range(max(len(self.a_bytes), n))
        self.said = np.array([[f"{i}{sign}" for sign in ",|;\n"] for i in numbers], object)
        self.known: dict[str, int] = {}
        self.room = KEPT
        self.digest: list[str | None] = []
        self.sizes, self.links = np.zeros((0, 5), np.int64), Grown()

    def one_by_one(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both sides, and whether the second gives the bytes back. Pieces start with a blank, which that model adds
        itself, or a line feed, before which its own blank is left out."""
        a = list(map(self.a.encode_ordinary, pieces))
        b = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        b = [[self.blank] if p == " " else ids if p[0] == " " else ids[1:] for p, ids in zip(pieces, b, strict=True)]
        return a, b, [b"".join(map(self.b_text.__getitem__, ids)) == p.encode() for p, ids in zip(pieces, b, strict=True)]

    def tokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of both sides, and which pieces they are of. Pieces that end visibly are encoded as one text, as
        both sides' tokens end with them; if that doesn't give the bytes back, one by one."""
        if all(p[-1] not in SPACE for p in pieces):
            text = "".join(pieces)
            b = self.b.encode(text[1:] if text[0] == " " else text, num_threads=1)
            b = b if text[0] == " " else b[1:]
            if b"".join(map(self.b_text.__getitem__, b)) == text.encode():
                return np.array(self.a.encode_ordinary(text), np.int64), np.array(b, np.int64), np.arange(len(pieces))
        a, b, good = self.one_by_one(pieces)
        flat = lambda x: np.array([t for ids, g in zip(x, good, strict=True) if g for t in ids], np.int64)
        return flat(a), flat(b), np.flatnonzero(good)

    def learn(self, pieces: list[str]) -> None:
        """Appends what is known of new pieces."""
        flat_a, flat_b, use = self.tokens(pieces)
        end_a, end_b = np.cumsum(self.a_bytes[flat_a]), np.cumsum(self.b_bytes[flat_b])
        # Members that end together.
        at = np.searchsorted(end_b, end_a)
        in_a = np.flatnonzero(end_b[at] == end_a)
        in_b = at[in_a]
        # Between two neighbouring ends one token of each side lies: an edge.
        stretch = np.sort(np.r_[end_a, np.delete(end_b, in_b)], kind="stable")
        of_a, of_b = np.searchsorted(end_a, stretch), np.searchsorted(end_b, stretch)
        root = components(of_a, of_b + len(flat_a), len(flat_a) + len(flat_b))
        # Components lie in a row on both sides: a token is its group's last where the next one's root differs.
        root_a, root_b = root[: len(flat_a)], root[len(flat_a) :]
        last_a, last_b = (np.r_[r[1:] != r[:-1], True][: len(r)] for r in (root_a, root_b))
        group_a, group_b = (np.cumsum(last) - last for last in (last_a, last_b))
        size = np.fromiter((len(pieces[i].encode()) for i in use.tolist()), np.int64, len(use))
        piece_end = np.cumsum(size)
        piece_a, piece_b = np.searchsorted(piece_end, end_a), np.searchsorted(piece_end, end_b)
        count = lambda of: np.bincount(of, minlength=len(use))
        n_links = count(piece_a[in_a])
        sizes, n_of = np.zeros((len(pieces), 5), np.int64), np.zeros(len(pieces), np.int64)
        sizes[use] = np.stack([count(piece_a), count(piece_b), count(piece_a[last_a]), n_links, count(piece_a[of_a])], 1)
        n_of[use] = n_links
        # The digest's parts: each group's A tokens, then its B tokens, each id with the sign that follows it.
        upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=1)), np.r_[0, np.cumsum(np.bincount(group_b, minlength=1))]
        said = np.empty(len(flat_a) + len(flat_b), object)
        said[np.arange(len(flat_a)) + upto_b[group_a]] = self.said[flat_a, np.where(last_a, 1, 0)]
        said[np.arange(len(flat_b)) + upto_a[group_b]] = self.said[flat_b, np.where(last_b, np.where(np.isin(end_b, piece_end), 3, 2), 0)]
        spoken: list[str | None] = [None] * len(pieces)
        for i, t in zip(use.tolist(), "".join(said).split("\n"), strict=False):
            spoken[i] = t
        self.digest += spoken
        self.sizes = np.r_[self.sizes, sizes]
        self.links.add((flat_a[in_a] << SHIFT) | flat_b[in_b], n_of)

    def align(self, texts: list[str | None]) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
        """For each text: tokens of A, of B, groups, links, overlaps; digest; distinct link codes and their numbers."""
        cut = [PIECES.findall(f" {t}") if t else [] for t in texts]
        known, rows = self.known, len(self.digest)
        new = {p for pieces in cut for p in pieces}.difference(known)
        # Those that are encoded together and kept come first.
        new = sorted(new, key=lambda p: (len(p) > KEPT_PIECE or p[-1] in SPACE or MARK in p))
        for at in range(0, len(new), CHUNK):
            self.learn(new[at : at + CHUNK])
        known.update(zip(new, range(rows, rows + len(new)), strict=True))
        for pieces in cut:
            at = list(map(known.__getitem__, pieces))
            said = list(map(self.digest.__getitem__, at))
            if not said or None in said:
                yield [0] * 5, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            at = np.array(at)
            yield self.sizes[at].sum(0).tolist(), hashlib.sha256(";".join(said).encode()).hexdigest(), *np.unique(self.links.rows(at), return_counts=True)
        # The worker keeps new pieces while there is room; the others go.
        stay = 0
        while stay < len(new) and len(new[stay]) <= KEPT_PIECE and self.room > 0:
            self.room -= 4 * len(new[stay]) + 400
            stay += 1
        for p in new[stay:]:
            del known[p]
        del self.digest[rows + stay :]
        self.sizes, self.links.n = self.sizes[: rows + stay], rows + stay


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]
ALIGNED = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, _row long, codes array<long>, times array<long>"


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """Each document's numbers, digest and distinct link pairs (A id << 32 | B id) with how often each occurs in it."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = per_worker(f"aligner {bytes_path} {pieces_path}", lambda: Aligner(bytes_path, pieces_path))
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for b in slices(whole):
                rows = list(aligner.align(b.column("text").to_pylist()))
                lists = [pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(r[i]) for r in rows])].astype(np.int32), np.concatenate([r[i] for r in rows])) for i in (2, 3)]
                numbers = np.array([r[0] for r in rows], np.int64)
                made = [b.column("doc_id"), *map(pa.array, numbers.T.copy()), pa.array([r[1] for r in rows]), pa.array(np.arange(row, row + len(rows))), *lists]
                row += len(rows)
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", *COUNTS, "groups_sha256", "_row", "codes", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(part, ALIGNED)


def exploded(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.inline(F.arrays_zip(F.col("codes").alias("code"), F.col("times").alias("times"))))


def pair_counts(docs: DataFrame) -> DataFrame:
    """code, n (links corpus-wide), best (n is its B id's highest)."""
    n = exploded(docs).toDF("code", "times").groupBy("code").agg(F.sum("times").alias("n"))
    of_b = Window.partitionBy(F.col("code").bitwiseAND(F.lit((1 << SHIFT) - 1)))  # no more rows than A has ids
    return n.withColumn("best", F.col("n") == F.max("n").over(of_b))


def align_tokens(docs: DataFrame, bytes_path: str, pieces_path: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their numbers, digest, n_best and count_sum; and the corpus's pairs: code, n, best."""
    done = staged(aligned(docs, bytes_path, pieces_path), "aligned")
    pairs = staged(pair_counts(done), "pairs")
    small = pairs.count() <= BROADCAST_PAIRS
    met = exploded(done, "_row").toDF("_row", "code", "times").join(F.broadcast(pairs) if small else pairs, "code")
    sums = met.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = done.select("doc_id", *COUNTS, "groups_sha256", "_row").join(sums, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", *COUNTS, zero("n_best"), zero("count_sum"), "groups_sha256"), pairs


def alignment_query(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    return align_tokens(docs, bytes_path, pieces_path)[0]
