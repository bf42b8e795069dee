"""Benchmark passages in training documents, by a distributed positional inverted index. DataFrame operations only.

1. Index: a row a posting (document row, term, position), written once, for the terms that the benchmark holds; each
   document adds one posting of the end mark, whose position is its number of words. Documents stay where they are read:
   the index is partitioned by document and costs no shuffle.
2. Windows of `WINDOW` consecutive item words are classes: equal ones, of one item or of many, are looked up once. The
   postings' counts tell how rare each term is in the corpus; windows with a term that no document holds are out.
3. The rarest terms come first: of each window its two rarest terms and the distance between them; windows that share
   these share the look-up. The second term's list, shifted by the distance, is intersected with the first's.
4. Where the two stand in place, each of the windows' words is looked up there: all of them, and the window occurs. Words
   under any window are hit, each counted once. A posting of a rarest term meets a window's words once, however often
   the words repeat in the document or in the item.

near_matches() stops after step 3 with a slack: windows whose two rarest terms stand near their distance.

The benchmark's tables (terms, windows, pairs) are written before they are joined, so that Spark knows their size
and broadcasts them only if it allows; beyond, the same joins shuffle. A term that a third of all postings hold is then
a skewed join key, which adaptive execution splits.

Defined results: null texts and texts without words have 0 words and no hits; an item without words is no item; items
that share an item_id count once, those with a null id not by name; repeated rows are judged one by one; ties in rarity
go by place; extra columns, also of the benchmark, are ignored, or kept by drop_contaminated(), which judges rows
without an id, and rows that share one, each by its own text; an empty benchmark or document table gives no hits or no rows. Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutewise.llm.shared import NON_WORDS, ascii_lower, staged, words

WINDOW = 10
#: Stands for the end of a document; no word, as words hold no control character.
END_MARK = "\x00"


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, start (the window's first word in its item), window (a number for its words), w (its term ids)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.transform(words(ascii_lower(F.col("text")), NON_WORDS), lambda x: F.xxhash64(x)).alias("_w")).where(F.size("_w") > 0)
    size = F.least(F.size("_w"), F.lit(window))
    placed = items.select("item_id", F.explode(F.sequence(F.lit(0), F.size("_w") - size)).alias("start"), size.alias("_n"), "_w")
    cut = F.expr("slice(_w, start + 1, _n)")
    return placed.select("item_id", "start", cut.alias("w")).select("item_id", "start", F.xxhash64("w").alias("window"), "w")


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """row (a number of the document's row), doc_id, term_id, pos: a row a posting of the terms (term, term_id)."""
    held = F.concat(words(ascii_lower(F.col("text")), NON_WORDS), F.array(F.lit(END_MARK)))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"))
    placed = numbered.select("row", "doc_id", F.posexplode("held").alias("pos", "term"))
    return placed.join(terms, "term").select("row", "doc_id", "term_id", "pos")


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """window, off1, term1, term2, gap: each window's rarest word, its second rarest (null in windows of one word) and how far that is off."""
    known = windows.select("window", F.posexplode("w").alias("off", "term_id")).join(counts, "term_id", "left")
    ranked = known.groupBy("window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("f"), "off", "term_id"))).alias("r"))  # `WINDOW` words
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    found = ranked.where(first["f"] > 0)
    return found.select("window", first["off"].alias("off1"), first["term_id"].alias("term1"), second["term_id"].alias("term2"), (second["off"] - first["off"]).alias("gap"))


class Index:
    """The staged tables of one benchmark over one corpus."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW):
        spelled = benchmark.select(F.explode(words(ascii_lower(F.col("text")), NON_WORDS)).alias("term")).distinct().withColumn("term_id", F.xxhash64("term"))
        mark = docs.sparkSession.range(1).select(F.lit(END_MARK).alias("term"), F.lit(-1).cast("long").alias("term_id"))
        self.placed = staged(item_windows(benchmark, window), "item_windows")
        self.windows = staged(self.placed.groupBy("window").agg(F.first("w").alias("w")), "windows")
        self.postings = staged(positional_index(docs, staged(spelled.union(mark), "terms")), "postings")
        self.documents = self.postings.where("term_id = -1").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
        counts = staged(self.postings.groupBy("term_id").count(), "counts")
        self.rarest = staged(rarest_terms(self.windows, counts), "rarest")

    def candidates(self, slack: int = 0) -> DataFrame:
        """row, window, start of the windows whose two rarest words stand in place (or `slack` words from it)."""
        pairs = self.rarest.select("term1", "term2", "gap").distinct()
        first = self.postings.select("row", F.col("term_id").alias("term1"), "pos").join(pairs, "term1")
        other = self.postings.join(self.rarest.select(F.col("term2").alias("term_id")).distinct(), "term_id", "left_semi").select("row", F.col("term_id").alias("term2"), F.col("pos").alias("pos2"))
        if slack:
            both = first.join(other, ["row", "term2"]).where(F.abs(F.col("pos2") - F.col("pos") - F.col("gap")) <= slack).select(*first.columns).distinct()
        else:
            both = first.withColumn("pos2", F.col("pos") + F.col("gap")).join(other, ["row", "term2", "pos2"], "left_semi").select(*first.columns)
        met = both.join(self.rarest, ["term1", "term2", "gap"]).unionByName(first.where("term2 is null").join(self.rarest.where("term2 is null").drop("term2", "gap"), "term1"))
        return met.select("row", "window", (F.col("pos") - F.col("off1")).alias("start"))

    def occurrences(self) -> DataFrame:
        """row, window, start, size: where windows occur, all their words in place."""
        candidates = staged(self.candidates(), "candidates")
        # A number a document with candidates: written, so that Spark knows how few they are.
        rows = staged(candidates.select("row").distinct(), "rows")
        there = self.postings.join(rows, "row", "left_semi").select("row", "term_id", "pos")
        asked = candidates.join(self.windows, "window").select("row", "window", "start", F.size("w").alias("size"), F.posexplode("w").alias("off", "term_id"))
        met = asked.withColumn("pos", F.col("start") + F.col("off")).join(there, ["row", "term_id", "pos"])
        return met.groupBy("row", "window", "start", "size").agg(F.count("*").alias("n")).where("n = size").drop("n")


def covered(spans: Column) -> Column:
    """Places under the spans (from, to), each counted once."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    more = lambda acc, s: F.struct(F.greatest(acc["upto"], s["to"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(acc["upto"], s["from"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), start, more)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row a document: doc_id, n_words, n_hit, items (ids of the items with occurring windows, sorted as strings)."""
    index = Index(docs, benchmark, window)
    found = staged(index.occurrences(), "occurrences")
    # One document's spans: no more than its words times the sizes of windows (one, but for short items).
    span = F.struct(F.col("start").alias("from"), (F.col("start") + F.col("size")).alias("to"))
    hits = found.groupBy("row").agg(covered(F.collect_set(span)).alias("n_hit"))
    named = found.select("row", "window").distinct().join(index.placed.select("window", "item_id").distinct(), "window")
    items = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = index.documents.join(hits.join(items, "row"), "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def near_matches(docs: DataFrame, benchmark: DataFrame, slack: int = 3, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, place: proximity matches, two rarest words of a window at most `slack` words from their distance."""
    index = Index(docs, benchmark, window)
    of = index.placed.select("item_id", "window", F.col("start").alias("_in_item"))
    met = index.candidates(slack).join(of, "window").withColumn("place", F.col("start") - F.col("_in_item"))
    return met.join(index.documents, "row").select("doc_id", "item_id", "place").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    hit = staged(contamination(docs, benchmark, window).where("n_hit > 0").select("doc_id").distinct(), "hit")
    clean = docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
    # Which row an id stands for isn't told by ids that are null or stand for several: these rows are numbered and judged once more.
    several = docs.join(hit, "doc_id", "left_semi").groupBy("doc_id").count().where("count > 1").select("doc_id")
    unclear = docs.join(several, "doc_id", "left_semi").select(*docs.columns)
    if not hit.where("doc_id is null").isEmpty():
        clean = clean.where("doc_id is not null")
        unclear = unclear.unionByName(docs.where("doc_id is null"))
    row = "_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    unclear = staged(unclear.withColumn(row, F.monotonically_increasing_id()), "unclear")
    if unclear.isEmpty():
        return clean
    found = contamination(unclear.select(F.col(row).alias("doc_id"), "text"), benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias(row))
    return clean.unionByName(unclear.join(found, row, "left_anti").select(*docs.columns))


def decontamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same result by comparing all windows as lists.
DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
k AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, w[s : s + least(len(w), 10) - 1] AS win
  FROM b, LATERAL (SELECT unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM k),
placed AS (
  SELECT doc_id, n, s, w[s : s + n - 1] AS win
  FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS s) WHERE len(w) >= n),
m AS (SELECT doc_id, item_id, s, k.n FROM placed JOIN k ON placed.n = k.n AND placed.win = k.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
