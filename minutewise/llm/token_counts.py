"""Token counts by rank-synchronous merging of ragged symbol arrays.

A byte-level BPE vocabulary with word ends is read as arrays: symbols are numbers, merges a sorted array of pair keys
with their ranks. The pre-tokens of a batch lie in one flat array of symbols; in each round every pre-token applies its
pair of lowest rank at all its places at once, and a pre-token without a mergeable pair is done: the symbols that
survive are its tokens. Pre-tokens never cross white space, so a text's count is the sum over its blank-separated
pieces, and a piece is counted once for each worker while its cache lasts.

Very long pre-tokens (over `LONG` symbols) use a heap of pairs by rank instead of rounds over the whole array, which
gives the same merges in n log n.

Defined results: null and empty texts have 0 tokens and 0 bytes; repeated rows are counted one by one; the strings of
special tokens inside a text count as that one token, as the library does by default; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutewise.llm.shared import per_worker

LONG = 512
#: Entries of a worker's cache. Frequent pieces come early and stay; once it is full, others are done batch by batch.
CACHE = 600_000
#: White space as the tokenizers library sees it (Unicode White_Space). Fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` bytes of text: memory doesn't follow the number of rows that Spark hands over."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size)))
        yield batch.slice(at, end - at)
        at = end


def piece_codes(texts: pa.Array, line_feed: str = " ") -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut at blanks (line feeds replaced before): each piece's number, where each text's pieces end, the pieces by number."""
    cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", line_feed), " ")
    coded = cut.flatten().dictionary_encode()
    return coded.indices.to_numpy(), cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py(), coded.dictionary.to_pylist()


class MergeRanks:
    """A vocabulary file's merges as arrays, and the counting of pre-tokens with them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"] or ""
        self.specials = [t["content"] for t in spec["added_tokens"]]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern).findall
        shown = byte_symbols()
        self.path, self.library, self.byte_of = path, None, {c: b for b, c in enumerate(shown)}
        self.inner = np.array([vocab[c] for c in shown], np.int64)
        self.last = np.array([vocab[c + end] for c in shown], np.int64)
        self.size = 1 << (len(vocab) + 1).bit_length()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.none = len(pairs)
        self.by_pair = None
        self.split = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.counts: dict[str, int] = {}

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], self.none), at

    def surviving(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token (none of them empty)."""
        sizes = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        out = np.zeros(len(pre_tokens), np.int64)
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self.by_heap(pre_tokens[i])
        ids = np.flatnonzero(sizes <= LONG)
        if not len(ids):
            return out
        flat = np.frombuffer(b"".join(pre_tokens[i] for i in ids), np.uint8)
        ends = np.cumsum(sizes[ids])
        sym = self.inner[flat]
        sym[ends - 1] = self.last[flat[ends - 1]]
        own = np.repeat(ids, sizes[ids])
        while len(sym):
            # Pairs inside one pre-token; the pair at a pre-token's last symbol is none.
            same = np.empty(len(sym), bool)
            same[-1] = False
            np.equal(own[1:], own[:-1], out=same[:-1])
            rank = np.full(len(sym), self.none, np.int64)
            at = np.zeros(len(sym), np.int64)
            inside = np.flatnonzero(same)
            rank[inside], at[inside] = self.look_up(sym[inside] * self.size + sym[inside + 1])
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            least = np.minimum.reduceat(rank, starts)
            lens = np.diff(np.r_[starts, len(sym)])
            out[own[starts[least == self.none]]] = lens[least == self.none]
            chosen = (rank == np.repeat(least, lens)) & (rank < self.none)
            places = np.flatnonzero(chosen)
            if not len(places):
                break
            # Equal pairs that overlap ("aaa") merge from the left: of a run of neighbours, every second one.
            run = np.r_[True, (np.diff(places) != 1) | (own[places[1:]] != own[places[:-1]])]
            begin = places[np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))]
            places = places[(places - begin) % 2 == 0]
            sym[places] = self.made[at[places]]
            keep = np.repeat(least < self.none, lens)
            keep[places + 1] = False
            sym, own = sym[keep], own[keep]
        return out

    def by_heap(self, pre_token: bytes) -> int:
        if self.by_pair is None:
            self.by_pair = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.rank.tolist(), self.made.tolist(), strict=True)}
        raw = np.frombuffer(pre_token, np.uint8)
        sym = [*self.inner[raw[:-1]].tolist(), int(self.last[raw[-1]])]
        n, size, pairs = len(sym), self.size, self.by_pair
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(pairs[k][0], i, k) for i in range(n - 1) if (k := sym[i] * size + sym[i + 1]) in pairs]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, k = heapq.heappop(heap)
            j = after[i] if sym[i] >= 0 else -1
            if j < 0 or sym[i] * size + sym[j] != k:
                continue
            sym[i], sym[j] = pairs[k][1], -1
            left -= 1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (q := sym[a] * size + sym[after[a]]) in pairs:
                    heapq.heappush(heap, (pairs[q][0], a, q))
        return left

    def pre_tokens(self, part: str) -> list[bytes]:
        """ASCII by the file's pattern; else the library's own normalizer and pre-tokenizer, which know its version of Unicode."""
        if part.isascii():
            return [t.encode() for t in self.find(part.lower())]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        normal = self.library.normalizer
        cut = self.library.pre_tokenizer.pre_tokenize_str(normal.normalize_str(part) if normal else part)
        return [bytes(map(self.byte_of.__getitem__, t)) for t, _ in cut if t]

    def count_pieces(self, pieces: list[str]) -> list[int]:
        """Tokens of pieces of texts, cut at white space."""
        fixed, owner, found = [0] * len(pieces), [], []
        for i, piece in enumerate(pieces):
            parts = [piece]
            if self.split and "<|" in piece:
                fixed[i] = len(self.split.findall(piece))
                parts = self.split.split(piece)
            for part in parts:
                for token in self.pre_tokens(part):
                    owner.append(i)
                    found.append(token)
        if found:
            for i, n in zip(owner, self.surviving(found).tolist(), strict=True):
                fixed[i] += n
        return fixed

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text (null: none)."""
        codes, ends, pieces = piece_codes(texts)
        seen = self.counts
        known = list(map(seen.get, pieces))
        if None in known:
            at = [i for i, n in enumerate(known) if n is None]
            new = [pieces[i] for i in at]
            for i, piece, n in zip(at, new, self.count_pieces(new), strict=True):
                known[i] = n
                if len(seen) < CACHE:
                    seen[piece] = n
        upto = np.r_[0, np.cumsum(np.array(known, np.int64)[codes])]
        return np.diff(upto[np.r_[0, ends]])


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each document's whole text, by the vocabulary file at the path `vocabulary`."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = per_worker(f"merges {vocabulary}", lambda: MergeRanks(vocabulary))
        for b in batches:
            for part in slices(b):
                counts = pa.array(ranks.count(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), counts], names=["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_bytes, "text").mapInArrow(counted, SCHEMA)


def token_counts_query(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    return count_tokens(docs, vocabulary).withColumn("over_limit", F.col("n_tokens") > limit)
