"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

1. Words are hashed in the JVM; in Arrow batches each document gets its set of word shingles (64-bit hashes), a digest of
   the set, and a sketch of `COORDINATES` numbers by hashed bin placement: in round i every shingle throws its value
   into one bin drawn by that round's hash; a bin keeps its least (round, value); from round `COORDINATES` on, round i
   throws into bin i - COORDINATES only, so that after twice as many rounds every bin is filled whatever the set's
   size. Two sets agree in a coordinate with the probability of their similarity, with concentration as for as many
   independent coordinates.
2. Equal sets are one class, by digest (partial aggregation first); only one document of each goes on.
3. `COORDINATES / ROWS` bands of `ROWS` coordinates are hashed; documents that share a band are candidates. At similarity
   0.8 a pair shares none of the 32 bands with probability 5e-8.
4. In each band group every document is held against the group's smallest: as many pairs as documents. Pairs are
   verified on the full sets; the links' components are found by alternating large-star and small-star steps.
5. Band groups that still hold several components are searched in full, pairs of different components only: groups
   that share documents are searched as one, in cells of about `BLOCK` documents or, if that is larger, band by band,
   a pair in the first band it shares, band groups over `BLOCK` in pairs of blocks. Within a cell the sketches tell which pairs are worth verifying (an estimate `SLACK` below the threshold has
   a chance of 1e-7 at the threshold, by Chernoff's bound), and those are verified on their full sets at once; only the
   links that join components leave the cell. No group is gathered in one task, no group's pairs are written out.

Sets of copies never meet as pairs: they are one class from step 2 on. Sets are compared by 64-bit hashes of word
pairs; within one document of 100,000 shingles a collision has a chance under 1e-9.

Defined results: null and empty texts and texts without words have an empty set and stand alone; a text with fewer
words than a shingle is one shingle; repeated rows get the same verdict each; rows that share a doc_id but not their sets
are documents of their own, which their id doesn't link (if there are such, rows are numbered first, and the numbers go
through the steps above in the ids' place); extra columns are ignored (and kept by drop_near_duplicates(), which keeps one
row of a doc_id and component, and one of a doc_id's rows without words); documents with a null id stand alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutewise.llm.shared import BLANKS, ascii_lower, staged, words

COORDINATES, ROWS = 128, 4
BLOCK = 1_024
#: No more bands than this are joined by a broadcast.
HOT = 1_000
SLACK = 0.22
SEED = 0x9E3779B97F4A7C15
SKETCHED = "id long, n_shingles long, d1 long, d2 long, sketch binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingles of a text, by the hashes of its words."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(SEED) + hashes[k : k + n])
    return np.unique(out)


def shingle_sets(column: pa.ListArray, size: int) -> list[np.ndarray]:
    flat = column.flatten().to_numpy().view(np.uint64)
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    return [shingle_set(flat[a:z], size) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """A row of t unsigned 32-bit numbers for each set: round in the upper 8 bits, value in the lower 24. Empty sets: all ones."""
    n = len(sets)
    out = np.full((n, t), 0xFFFFFFFF, np.uint32)
    open_ = np.array([i for i in range(n) if len(sets[i])], np.int64)
    flat = np.concatenate([sets[i] for i in open_]) if len(open_) else np.zeros(0, np.uint64)
    sizes = np.array([len(sets[i]) for i in open_], np.int64)
    for i in range(2 * t):
        if not len(open_):
            break
        h = mix(flat + np.uint64((SEED * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        value = ((h & np.uint64(0xFFFFFF)) | np.uint64(i << 24)).astype(np.uint32)
        if i < t:
            bins = ((h >> np.uint64(32)) % np.uint64(t)).astype(np.int64)
            np.minimum.at(out.reshape(-1), np.repeat(open_, sizes) * t + bins, value)
        else:
            starts = np.cumsum(sizes) - sizes
            out[open_, i - t] = np.minimum(out[open_, i - t], np.minimum.reduceat(value, starts))
        full = (out[open_] != 0xFFFFFFFF).all(axis=1)
        if full.any():
            keep = np.repeat(~full, sizes)
            flat, sizes, open_ = flat[keep], sizes[~full], open_[~full]
    return out


def hashed_words(text: Column, separators: str = BLANKS) -> Column:
    return F.transform(words(ascii_lower(text), separators), lambda w: F.xxhash64(w))


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """id, n_shingles, d1 and d2 (digest of the set), sketch."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                sets = shingle_sets(part.column("hashes"), size)
                d = [(np.bitwise_xor.reduce(mix(s)), np.add.reduce(mix(s + np.uint64(1)))) if len(s) else (0, 0) for s in sets]
                digests = np.array(d, np.uint64).reshape(-1, 2).view(np.int64)
                rows = [r.tobytes() for r in sketches(sets)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(rows, pa.binary())],
                    names=["id", "n_shingles", "d1", "d2", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("id"), hashed_words(F.col("text")).alias("hashes")).mapInArrow(made, SKETCHED)


def band_hashes(grid: np.ndarray) -> np.ndarray:
    """A column a band: the hash of the band's number and coordinates."""
    bands = grid.reshape(len(grid), COORDINATES // ROWS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(COORDINATES // ROWS, dtype=np.uint64), bands.shape[:2])
    for k in range(ROWS):
        h = mix(h * np.uint64(SEED) + bands[:, :, k])
    return h.view(np.int64)


def band_rows(reps: DataFrame) -> DataFrame:
    """id, band (a hash of the band's number and coordinates): a row a band."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h = band_hashes(np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint32).reshape(b.num_rows, COORDINATES))
            ids = np.repeat(b.column("id").to_numpy(), COORDINATES // ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h.reshape(-1))], names=["id", "band"])

    return reps.select("id", "sketch").mapInArrow(cut, "id long, band long")


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    both = (
        pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
        .join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
        .select("a", "b", hashed_words(F.col("text_a")).alias("ha"), hashed_words(F.col("text_b")).alias("hb"))
    )

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                ok = []
                for x, y in zip(shingle_sets(part.column("ha"), size), shingle_sets(part.column("hb"), size), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(len(x) > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                kept = part.filter(pa.array(ok, pa.bool_()))
                yield kept.select(["a", "b"])

    # A repeated doc_id gives a pair more than once.
    return both.mapInArrow(held, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in the links (a, b), by large-star and small-star steps."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")

    def star(pairs: DataFrame, large: bool, rows: int) -> DataFrame:
        around = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
        # Ids with more than one of HOT equal shares of the links: 2 * HOT at most, as a link has two ends. These by a broadcast.
        many = F.col("n") * HOT > rows
        told = around.join(F.broadcast(least.where(many).select("u", "m")), "u", "left")
        joined = told.where("m is not null").unionByName(told.where("m is null").select("u", "v").join(least.where(~many).select("u", "m"), "u"))
        # Large: larger neighbours go to the smallest around; small: smaller neighbours and the id itself do.
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    # Done when only stars are left: each u has one v, and no v is a u. The steps keep what is connected together.
    while True:
        rows = edges.count()
        edges = staged(star(star(edges, True, rows), False, rows), "links")
        several = edges.groupBy("u").count().where("count > 1").select("u")
        inner = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        if several.union(inner).isEmpty():
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def search(ids: np.ndarray, comps: np.ndarray, grid: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, main: int, percent: int, own: int = -1) -> list[tuple[int, int]]:
    """Links between different components, of the rows `left` (none of component `main`) with the rows `right`.

    own: the number of the band that the rows share, if they do; a pair is looked at in the first band it shares only.
    Pairs whose sketches reach the threshold less SLACK are verified on their sets, the most alike first; a pair whose
    components have met by then is left out, so that at most as many links as components come back.
    """
    least = (percent / 100 - SLACK) * COORDINATES
    met: dict[int, int] = {}

    def root(c: int) -> int:
        while met.get(c, c) != c:
            c = met[c]
        return c

    links = []
    for x in left.tolist():
        alike = (grid[right] == grid[x]).sum(axis=1)
        ok = (alike >= least) & (comps[right] != comps[x]) & ((comps[right] == main) | (ids[right] > ids[x]))
        if own >= 0:
            ok[ok] = (grid[right[ok]] == grid[x]).reshape(-1, COORDINATES // ROWS, ROWS).all(axis=2).argmax(axis=1) == own
        near = right[ok]
        for y in near[np.argsort(-alike[ok], kind="stable")].tolist():
            a, b = root(int(comps[x])), root(int(comps[y]))
            if a == b:
                continue
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                met[max(a, b)] = min(a, b)
                links.append((min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))))
    return links


def crossing_links(rest: DataFrame, hot: DataFrame, sketches_of: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between the components left in band groups (rows: band, id, component).

    Band groups that share documents form one candidate group, so that a pair is looked at once, not once a band, if it
    has up to BLOCK documents. In larger ones each band group stays a group of its own, as most of their pairs may share
    no band; a pair is looked at in its first band. In a group only documents outside its most frequent component are
    held against all others. Groups of up to BLOCK documents are dealt to cells of about BLOCK rows; band groups that
    are larger are cut into blocks, each pair of blocks in a place of its own.
    """
    first = rest.groupBy("band").agg(F.min("id").alias("a"))
    grouped = components(joined_on_band(rest, staged(first, "first"), hot).select("a", F.col("id").alias("b"))).withColumnRenamed("component", "g")
    grouped = staged(grouped.distinct(), "grouped")
    large = grouped.groupBy("g").count().where(F.col("count") > BLOCK).select("g")  # fewer than a BLOCK-th of the documents
    split = staged(grouped.join(large, "g", "left_semi").select("id"), "large")
    whole = rest.select("id", "component").distinct().join(grouped.join(large, "g", "left_anti"), "id").select("id", "component", "g", F.lit(None).cast("long").alias("band"))
    by_band = rest.join(split, "id", "left_semi").select("id", "component", F.col("band").alias("g"), "band").distinct()
    members = staged(whole.unionByName(by_band), "candidates")
    parts = members.groupBy("g", "band", "component").agg(F.count("*").alias("n"))
    about = staged(parts.groupBy("g", "band").agg(F.sum("n").alias("n"), F.max("n").alias("n_main"), F.max_by("component", F.struct("n", "component")).alias("main")), "groups")
    cells = max(1, -(-members.count() // BLOCK))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    told = members.join(about.withColumnsRenamed({"g": "about_g", "band": "about_band"}), F.expr("g = about_g and band <=> about_band")).withColumns({"big": F.col("n") > BLOCK, "n_left": F.col("n") - F.col("n_main"), "other": F.col("component") != F.col("main")})
    told = told.withColumns({"nl": F.greatest(F.lit(1), blocks("n_left")), "nr": blocks("n")})
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # A candidate group and a band may have the same number: cells are told apart by both.
    place = lambda cell, i, j, side: F.struct(F.xxhash64(cell, F.col("band").isNull()).alias("cell"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    as_right = F.transform(upto("nl"), lambda i: place(F.col("g"), i, block("nr", 1), "r"))
    as_left = F.when(F.col("other"), F.transform(upto("nr"), lambda j: place(F.col("g"), block("nl", 2), j, "l"))).otherwise(F.slice(as_right, 1, 0))
    alone = F.array(place(F.pmod(F.xxhash64("g"), F.lit(cells)), F.lit(-1), F.lit(-1), "b"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    whole = told.join(sketches_of.select("id", "sketch").dropDuplicates(["id"]), "id").join(texts, "id").dropDuplicates(["id", "g", "band"])
    whole = whole.select("id", "g", "band", "component", "main", "sketch", hashed_words(F.col("text")).alias("hashes"), F.when(F.col("big"), F.concat(as_right, as_left)).otherwise(alone).alias("places"))
    dealt = whole.withColumn("p", F.explode("places")).select("p.*", "id", "g", "band", "component", "main", "sketch", "hashes")

    def searched(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comps, g, main = (table.column(c).to_numpy() for c in ("id", "component", "g", "main"))
        side = np.array(table.column("side").to_pylist())
        grid = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(len(ids), COORDINATES)
        sets = shingle_sets(table.column("hashes").chunk(0), size)
        links = []
        band, banded = table.column("band").fill_null(0).to_numpy(), table.column("band").is_valid().to_numpy(zero_copy_only=False)
        order = np.lexsort((banded, g))
        for rows in np.split(order, np.flatnonzero(np.diff(g[order]) | np.diff(banded[order].astype(np.int8))) + 1):
            first = rows[0]
            own = int(np.flatnonzero(band_hashes(grid[first : first + 1])[0] == band[first])[0]) if banded[first] else -1
            left = rows[(comps[rows] != main[first]) & (side[rows] != "r")]
            links += search(ids, comps, grid, sets, left, rows[side[rows] != "l"], int(main[first]), percent, own)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return dealt.groupBy("cell", "i", "j").applyInArrow(searched, "a long, b long").distinct()


def joined_on_band(rows: DataFrame, table: DataFrame, hot: DataFrame) -> DataFrame:
    """rows join table on band; the bands in `hot` (`HOT` at most) by a broadcast, so that no task gets all rows of one."""
    known = table.join(F.broadcast(hot), "band", "left_semi")
    rest = table.join(F.broadcast(hot), "band", "left_anti")
    return rows.join(F.broadcast(known), "band").unionByName(rows.join(F.broadcast(hot), "band", "left_anti").join(rest, "band"))


def classes_of(every: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """near_duplicate_classes() of documents whose ids have one set each; every: their sketches."""
    full = every.where("n_shingles > 0 and id is not null")
    classes = staged(full.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    # One document of each set: its smallest id (a repeated id is there once).
    bands = staged(band_rows(full.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])), "bands")
    groups = staged(bands.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1"), "groups")
    # Bands that hold more than one of HOT equal shares of all rows: fewer than HOT, whatever the data.
    hot = staged(groups.where(F.col("n") * HOT > bands.count()).select("band"), "hot")
    members = staged(joined_on_band(bands, groups.select("band", "a"), hot), "members")
    stars = staged(members.where("id <> a").select("a", F.col("id").alias("b")).distinct(), "stars")
    links = staged(verified(stars, docs, size, percent), "verified")
    found = components(links)
    # Band groups in which several components are left.
    named = members.select("band", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    rest = staged(joined_on_band(named, staged(several, "several"), hot), "rest")
    if not rest.isEmpty():
        crossing = staged(crossing_links(rest, hot, full, docs, size, percent), "crossing")
        if not crossing.isEmpty():
            found = components(links.union(crossing))
    found = staged(found, "components")
    # Back to all documents: by set, then by component. Classes of one document need no table.
    with_rep = every.join(classes.where("n > 1").select("d1", "d2", "n_shingles", "rep"), ["d1", "d2", "n_shingles"], "left").select("id", "n_shingles", F.coalesce("rep", "id").alias("rep"))
    out = with_rep.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def ids_of_several_sets(every: DataFrame) -> bool:
    """Whether rows with different sets share an id."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("d1", "d2", "n_shingles") for n, f in (("low", F.min), ("high", F.max))]
    spread = every.where("id is not null").groupBy("id").agg(*ends)
    return not spread.where("low_d1 <> high_d1 or low_d2 <> high_d2 or low_n_shingles <> high_n_shingles").isEmpty()


def row_classes(numbered: DataFrame, row: str, size: int, percent: int) -> DataFrame:
    """row, doc_id, n_shingles, component (its smallest row), component_id (its smallest doc_id); numbered: written, with a number a row."""
    rows = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text")
    found = staged(near_duplicate_classes(known, size, percent).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "row_components")
    told = rows.select("row", "doc_id").join(found, "row", "left")
    least = told.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    sizes = sketched(rows.select(F.col("row").alias("doc_id"), "text"), size).select(F.col("id").alias("row"), "n_shingles")
    return told.join(least, "component", "left").join(sizes, "row").select("row", "doc_id", "n_shingles", "component", "component_id")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number a row, written, and the column's name, which none of theirs has."""
    row = "_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def near_duplicate_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept."""
    every = staged(sketched(docs, size), "sketches")
    if not ids_of_several_sets(every):
        return classes_of(every, docs, size, percent)
    out = row_classes(*numbered(docs.select("doc_id", "text")), size, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that link to a smaller doc_id, with their own columns; of a doc_id and component one row stays."""
    every = staged(sketched(docs, size), "sketches")
    nameless = docs.where("doc_id is null")
    if not ids_of_several_sets(every):
        gone = classes_of(every, docs, size, percent).where("not kept").select("doc_id").distinct()
        named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*docs.columns).dropDuplicates(["doc_id"])
        return named.unionByName(nameless)
    rows, row = numbered(docs)
    stay = row_classes(rows, row, size, percent).where("component_id = doc_id").groupBy("doc_id", F.when(F.col("n_shingles") > 0, F.col("component"))).agg(F.min("row").alias(row))
    return rows.join(stay.select(row), row, "left_semi").select(*docs.columns).unionByName(nameless)


def near_duplicates_query(docs: DataFrame) -> DataFrame:
    return near_duplicate_classes(docs, size=2)


#: The same result by counting the shingles that any two documents share, and a walk along the links.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, u.b FROM r JOIN u ON r.reach = u.a),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
