"""Quality rules whose cutoffs are certified on labelled documents, in DataFrame operations only.

A document fails the base rules if it has under 20 words, or if over 30 % of its words lie in 8-word windows that the
text holds twice. Beyond these, one joint rule rejects a document if any of the signals of `SIGNALS` lies above its
cutoff. `STEPS` tightens the rule step by step, signal after signal, each from lenient to strict, and the step up to
which a stratum (language) goes is what its labelled holdouts certify:

* holdout: labelled good documents, each distinct text of a stratum once. Exact copies are no independent draws; copies
  edited in a few words do count as draws of their own, so the bound holds as far as they behave like such;
* a step passes if the chance of so few false rejections or fewer, were the true rate of the whole joint rule `alpha`,
  is at most the family's level: the exact binomial upper bound (Clopper-Pearson) then lies under `alpha`;
* steps are tried in order and the first that fails ends the search (fixed-sequence testing: the level needs no
  correction along the sequence); the level is `delta` over the number of families (Bonferroni);
* of the steps that pass, the rule goes no further than labelled bad documents tell: the last one at which one more of
  the family's bad documents is rejected. A milder rule loses no more good documents, so the bound stays.

Families: a stratum with so many holdouts that it could pass without a false rejection is a family of its own. All
others share one: of their pooled holdouts, or, if these are too few as well, of all holdouts. Which strata are pooled
depends on the numbers of holdouts alone, not on what they show. So with probability 1 - delta no family loses more than
a share `alpha` of its good documents to the signals; within the shared family that holds for the strata together, not
for each of them. So every document is judged by a family's rule, whatever its stratum's labels; the bound of a stratum
of few labels, or none, is the shared family's, as far as the labels are drawn at random from the strata that share it.

The query measures all documents in one pass, in which only numbers are written, and judges from these. keep_good() needs
the texts again: it measures the labelled documents first, then judges all. The cutoffs are a table with a row a family.

Defined results: a null or empty text has no words and fails; a null stratum is one of its own; several labels of one
document count as its worst; null labels, labels without a document and documents without a label are no holdouts; no
labels, or an empty table, certify nothing; repeated rows are judged one by one; other columns, also of the labels, pass
through unread.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutewise.llm.shared import BLANKS, UPPER, staged

ALPHA, DELTA = 0.01, 0.05
WINDOW = 8
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Cutoffs from lenient to strict; the strictest are those of published rule sets, or near them. The signals stand in the
#: order in which the joint rule is tightened.
SIGNALS: dict[str, list[float]] = {
    "symbols_per_word": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "same_next_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "word_length": [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 14.0],
    "upper_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
}
#: The joint rule of step i rejects what a cutoff of the steps 0 to i rejects.
STEPS = [(name, cut) for name, cuts in SIGNALS.items() for cut in cuts]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Labelled ids that are broadcast, so that only their documents are measured first (8 MB); more are joined by numbers.
BROADCAST_IDS = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once: a lambda variable isn't computed anew where it is used."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows of so many words found twice or more (windows by a 64-bit hash of their words' hashes)."""
    windows = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hashes: F.when(F.size(hashes) >= window, F.transform(F.sequence(F.lit(1), F.size(hashes) - window + 1), lambda i: F.xxhash64(F.slice(hashes, i, window)))).otherwise(F.array().cast("array<bigint>")),
    )

    def covered(at: Column) -> Column:
        """Words under windows that start at the ascending places `at`."""
        steps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, s: n + s)

    def counted(sorted_windows: Column) -> Column:
        return let(
            F.transform(sorted_windows, lambda s: s["h"]),
            lambda hs: let(
                F.array_sort(F.transform(F.filter(sorted_windows, lambda s, k: F.coalesce(F.get(hs, k - 1) == s["h"], F.lit(False)) | F.coalesce(F.get(hs, k + 1) == s["h"], F.lit(False))), lambda s: s["i"])), covered
            ),
        )

    return let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), counted)),
    )


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def length_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, "")).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and rejected_at, the first of `STEPS` whose joint rule rejects
    the document (null: none), each with a leading underscore. What isn't selected isn't computed."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANK_CHARS))
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != ""), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))
    )
    w = F.col("_w")
    counted = docs.withColumns({"_w": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS)), "_lines": lines}).withColumns(
        {
            "_n_words": F.size(w).cast("long"),
            "_word_chars": length_without(text, BLANK_CHARS),
            "_n_symbols": F.length(text) - length_without(text, SYMBOLS),
            "_n_dup_lines": F.col("_lines.dup"),
            "_n_repeat_words": F.when(F.size(w) < WINDOW + 1, F.lit(0).cast("long")).otherwise(repeated_words(w)),
            "_n_lines": F.col("_lines.n"),
            "_n_upper": F.length(text) - length_without(text, UPPER),
            "_n_same": F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))),
        }
    )
    c = {k: F.col(f"_{k}") for k in (*COUNTS, "n_lines", "n_upper", "n_same")}
    signals = {
        "symbols_per_word": share(c["n_symbols"], c["n_words"]),
        "same_next_share": share(c["n_same"], c["n_words"]),
        "word_length": share(c["word_chars"], c["n_words"]),
        "upper_share": share(c["n_upper"], c["word_chars"]),
        "dup_line_share": share(c["n_dup_lines"], c["n_lines"]),
    }
    steps = [F.when(signals[name] > cut, F.lit(i)) for i, (name, cut) in enumerate(STEPS)]
    return counted.withColumn("_rejected_at", F.least(*steps)).drop("_w", "_lines", "_n_lines", "_n_upper", "_n_same")


def log_factorial(n: Column) -> Column:
    """By Stirling's series, whose error is under 1e-12 from 20 on."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def log_tail(n: Column, k: Column, p: Column) -> Column:
    """log P(X <= k) for X binomial(n, p), exact up to rounding; 0 if k reaches the mean, where no test passes.

    Terms are added from k downwards, relative to the term of k; below 10 standard deviations under k they vanish.
    """
    odds = (1 - p) / p

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1) / (n - k + i) * odds
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(p) + (n - k) * F.log1p(-p)
    further = F.least(k, (10 * F.sqrt(n * p) + 50).cast("long"))
    terms = F.when(further >= 1, F.sequence(F.lit(1).cast("long"), further)).otherwise(F.array().cast("array<bigint>"))
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    return F.when(k >= n * p, F.lit(0.0)).otherwise(top + F.log(F.aggregate(terms, one, step)["sum"]))


def labelled_ids(labels: DataFrame) -> DataFrame:
    """_id and _good of the labelled documents, by their worst label."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"))
    return staged(told.select(F.col("doc_id").alias("_id"), (F.col("q") == 1).alias("_good")), "labelled")


def holdout_numbers(docs: DataFrame, labelled: DataFrame, stratum: str) -> DataFrame:
    """doc_id, _stratum, _text (a hash), _rejected_at of the labelled documents, measured alone if a broadcast can tell them."""
    text = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")
    small = docs.select("doc_id", "text", F.col(stratum).cast("string").alias("_stratum"))
    if labelled.count() <= BROADCAST_IDS:
        small = small.join(F.broadcast(labelled), small["doc_id"] == labelled["_id"], "left_semi")
    return measured(small).select("doc_id", "_stratum", text, "_rejected_at")


def certified_steps(numbers: DataFrame, labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> tuple[DataFrame, int]:
    """A table _stratum, last_step of the strata that are families of their own, and the last step of the shared family.

    numbers: doc_id, _stratum, _text, _rejected_at. A last step of -1 rejects nothing.
    """
    distinct = numbers.join(labelled, F.col("doc_id") == F.col("_id")).groupBy("_stratum", "_text", "_good").agg(F.min("_rejected_at").alias("_at"))
    over = [F.count_if(F.col("_good") & (F.col("_at") <= i)).alias(f"k{i}") for i in range(len(STEPS))]
    bad = [F.count_if(~F.col("_good") & (F.col("_at") == i)).alias(f"b{i}") for i in range(len(STEPS))]
    tried = staged(distinct.groupBy("_stratum").agg(F.count_if("_good").alias("n"), *over, *bad), "holdouts")  # a row a stratum
    n_strata = tried.where("n > 0").count()
    need = math.log(delta / (n_strata + 1)) / math.log1p(-alpha)
    own = F.col("n") >= need
    told = tried.agg(F.count_if(own).alias("own"), F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)).alias("n")).first()
    sums = [F.sum(c).alias(c) for c in tried.columns[1:]]
    shared = (tried.where(~own) if told["n"] >= need else tried).agg(*sums).where("n > 0")
    families = tried.where(own).withColumn("own", F.lit(True)).unionByName(shared.withColumns({"own": F.lit(False), "_stratum": F.lit(None).cast("string")}))
    level = math.log(delta / (told["own"] + 1))
    counts = F.array(*(F.struct(F.col(f"k{i}").alias("k"), F.col(f"b{i}").alias("b")) for i in range(len(STEPS))))
    tests = families.select("own", "_stratum", "n", F.posexplode(counts).alias("step", "c"))
    fails = F.min(F.when(log_tail(F.col("n"), F.col("c.k"), F.lit(alpha)) > level, F.col("step"))).over(Window.partitionBy("own", "_stratum"))
    # Of the steps before the first that fails, the last that rejects another bad document.
    useful = F.max(F.when((F.col("c.b") > 0) & (F.col("step") < F.coalesce("fails", F.lit(len(STEPS)))), F.col("step")))
    judged = staged(tests.withColumn("fails", fails).groupBy("own", "_stratum").agg(F.coalesce(useful, F.lit(-1)).alias("last_step")), "cutoffs")
    rest = judged.where("not own").first()
    return judged.where("own").select("_stratum", "last_step"), rest["last_step"] if rest else -1


def verdicts(rows: DataFrame, steps: DataFrame, shared: int, stratum: str) -> DataFrame:
    """Adds _base_failed and _kept to measured rows. steps, a written table of a row a stratum, is broadcast if it is small."""
    told = rows.withColumn("_s", F.col(stratum).cast("string")).join(steps, F.col("_s").eqNullSafe(F.col("_stratum")), "left")
    failed = (F.col("_n_words") < 20) | (100 * F.col("_n_repeat_words") > 30 * F.col("_n_words"))
    rejected = F.coalesce(F.col("_rejected_at") <= F.coalesce("last_step", F.lit(shared)), F.lit(False))
    return told.withColumn("_base_failed", failed).withColumn("_kept", ~F.col("_base_failed") & ~rejected).drop("_s", "_stratum", "last_step")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    labelled = labelled_ids(labels)
    steps, shared = certified_steps(staged(holdout_numbers(docs, labelled, stratum), "numbers"), labelled, alpha, delta)
    rows = measured(docs.select(F.struct("*").alias("_row"), "text", F.col(stratum).alias("_lang")))
    return verdicts(rows, steps, shared, "_lang").where("_kept").select("_row.*")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document, measured in one pass."""
    text = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")
    rows = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(stratum).cast("string").alias("_stratum")))
    numbers = staged(rows.select("doc_id", "_stratum", text, *(f"_{c}" for c in COUNTS), "_rejected_at"), "numbers")
    steps, shared = certified_steps(numbers, labelled_ids(labels), alpha, delta)
    out = verdicts(numbers.withColumnRenamed("_stratum", "_lang"), steps, shared, "_lang")
    return out.select("doc_id", *(F.col(f"_{c}").alias(c) for c in COUNTS), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels)


#: The same result; the binomial tail by the logarithms of its terms.
QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (
  SELECT doc_id, array_to_string(w[i : i + 7], ' ') AS win, list(i) AS places
  FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 7)) AS i) WHERE len(w) >= 9 GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM (SELECT doc_id, unnest(places) AS i FROM g)) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, lang, text, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::BIGINT AS n_symbols,
         len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         length(coalesce(text, '')) - length(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
         len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) AS n_same, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
v AS (
  SELECT *, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
         CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_share, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length,
         CASE WHEN n_words > 0 THEN n_same / n_words ELSE 0 END AS same_next_share FROM c),
cuts AS (CUTS),
x AS (UNPIVOT (SELECT doc_id, symbols_per_word, same_next_share, word_length, upper_share, dup_line_share FROM v) ON symbols_per_word, same_next_share, word_length, upper_share, dup_line_share INTO NAME signal VALUE value),
r AS (SELECT doc_id, min(step) AS step FROM x JOIN cuts USING (signal) WHERE value > cutoff GROUP BY doc_id),
told AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
hold AS (SELECT DISTINCT lang, text, step FROM v JOIN told USING (doc_id) LEFT JOIN r USING (doc_id) WHERE good),
bad AS (SELECT DISTINCT lang, step FROM v JOIN told USING (doc_id) JOIN r USING (doc_id) WHERE NOT good),
z AS (SELECT lang, count(*) AS n, count(*) >= ln(DELTA / ((SELECT count(DISTINCT coalesce(lang, chr(0))) FROM hold) + 1)) / ln(1 - RATE) AS own,
        ln(DELTA / ((SELECT count(DISTINCT coalesce(lang, chr(0))) FROM hold) + 1)) / ln(1 - RATE) AS need FROM hold GROUP BY lang),
fam AS (
  SELECT true AS own, hold.lang, step FROM hold JOIN z ON z.lang IS NOT DISTINCT FROM hold.lang WHERE z.own
  UNION ALL
  SELECT false, NULL, step FROM hold JOIN z ON z.lang IS NOT DISTINCT FROM hold.lang
  WHERE NOT z.own OR (SELECT coalesce(sum(n) FILTER (NOT own), 0) < any_value(need) FROM z)),
t AS (SELECT own, lang, cuts.step, count(*) AS n, count(*) FILTER (fam.step <= cuts.step) AS k FROM fam, cuts GROUP BY ALL),
tail AS (
  SELECT own, lang, step, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(RATE) + (n - i) * ln(1 - RATE))) AS p
  FROM t, LATERAL (SELECT unnest(generate_series(0, k)) AS i) WHERE k < n * RATE GROUP BY ALL),
failed AS (
  SELECT t.own, t.lang, min(t.step) AS fail FROM t LEFT JOIN tail ON tail.own = t.own AND tail.lang IS NOT DISTINCT FROM t.lang AND tail.step = t.step
  WHERE coalesce(p, 1) > DELTA / ((SELECT count(*) FILTER (own) FROM z) + 1) GROUP BY ALL),
last AS (
  SELECT f.own, f.lang, coalesce(fail, 1000000) AS upto FROM (SELECT DISTINCT own, lang FROM fam) f LEFT JOIN failed ON failed.own = f.own AND failed.lang IS NOT DISTINCT FROM f.lang),
useful AS (
  SELECT last.own, last.lang, max(bad.step) AS step FROM last JOIN bad ON bad.step < upto
    AND CASE WHEN last.own THEN bad.lang IS NOT DISTINCT FROM last.lang ELSE (SELECT coalesce(sum(n) FILTER (NOT own), 0) < any_value(need) FROM z) OR NOT EXISTS (SELECT 1 FROM z WHERE z.own AND z.lang IS NOT DISTINCT FROM bad.lang) END
  GROUP BY ALL),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM v)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(r.step <= CASE WHEN EXISTS (SELECT 1 FROM z WHERE z.own AND z.lang IS NOT DISTINCT FROM b.lang) THEN u.step ELSE (SELECT step FROM useful WHERE NOT own) END, false) AS kept
FROM b LEFT JOIN r USING (doc_id) LEFT JOIN useful u ON u.own AND u.lang IS NOT DISTINCT FROM b.lang
"""
for _name, _value in {
    "CUTS": " UNION ALL ".join(f"SELECT '{s}' AS signal, {i} AS step, {c}::DOUBLE AS cutoff" for i, (s, c) in enumerate(STEPS)),
    "RATE": f"{ALPHA}::DOUBLE", "DELTA": f"{DELTA}::DOUBLE",
}.items():
    QUALITY_SQL = QUALITY_SQL.replace(_name, _value)
