"""Quality rules by cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import carry, join_small, materialize, with_key

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 5
MIN_DOCS = 20
MAX_SHARE = 0.05
MIN_KEPT_SHARE = 0.3
MIN_WORDS = 10


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _with_repeats(df: DataFrame, window: int) -> DataFrame:
    """Adds n_repeat_words. Windows are compared by hash; only texts with an equal pair are sorted to find the covered words."""
    n = F.size("_words")
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_w", F.transform(starts, lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(window)])))
    df = df.withColumn("_w", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.col("_w")).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_s", F.array_sort(F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    same = lambda s, k, j: F.coalesce(F.get("_s", j)["x"] == s["x"], F.lit(False))
    hit = F.array_sort(F.transform(F.filter("_s", lambda s, k: same(s, k, k + 1) | ((k > 0) & same(s, k, F.greatest(k - 1, F.lit(0))))), lambda s: s["i"]))
    df = df.withColumn("_hit", hit)
    gaps = F.transform("_hit", lambda p, k: F.least(F.lit(window), F.coalesce(F.get("_hit", k + 1) - p, F.lit(window))))
    return df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_h", "_w", "_s", "_hit")


def boilerplate(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(_host, _line): hashes of the normalised lines that more than max(min_docs, max_share of the host's documents) documents of the host hold.

    Documents are distinct rows of id and text. A line also has to stand in more than min_docs different texts: copies of one text are
    for deduplication, and do not make boilerplate of its lines.
    """
    seen = with_key(docs).select(F.coalesce(F.col(host), F.lit("")).alias("_host"), F.xxhash64("text").alias("_t"), "_k_id", "_k_rid", line_hashes(F.col("text")).alias("_l"))
    # One row for each text with the number of its documents, so that copies are counted before their lines are told apart.
    texts = seen.dropDuplicates(["_host", "_t", "_k_id", "_k_rid"]).groupBy("_host", "_t").agg(F.count("*").alias("_c"), F.first("_l").alias("_l"))
    texts = materialize(texts)
    per_host = texts.groupBy("_host").agg(F.sum("_c").alias("_docs"))
    counts = texts.select("_host", "_c", F.explode("_l").alias("_line")).groupBy("_host", "_line").agg(F.sum("_c").alias("_n"), F.count("*").alias("_texts"))
    over = counts.where((F.col("_n") > min_docs) & (F.col("_texts") > min_docs)).join(per_host, "_host").where(F.col("_n") > F.col("_docs") * max_share)
    return over.select("_host", "_line")


def line_hashes(text: Column) -> Column:
    """Distinct hashes of the normalised lines of a text that hold a word: lower case, digits as 0, one space for white space."""
    return F.array_distinct(F.transform(F.filter(F.transform(F.split(normal(text), "\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x)))


def normal(text: Column) -> Column:
    """A whole text with its lines normalised, but for a blank at their ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " "))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose normal form has a hash in `gone`."""
    pairs = F.arrays_zip(F.split(F.coalesce(text, F.lit("")), "\n").alias("x"), F.split(normal(text), "\n").alias("y"))
    left = F.filter(pairs, lambda p: (F.trim(p["y"]) == "") | ~F.array_contains(gone, F.xxhash64(F.trim(p["y"]))))
    return F.array_join(F.transform(left, lambda p: p["x"]), "\n")


@carry("doc_id", "text", "source", "n_chars")
def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_kept_share: float = MIN_KEPT_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with clean_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words_left, base_failed and kept.

    A document is kept if the base rules pass and, without its host's boilerplate lines, at least min_words words and min_kept_share
    of its words are left. Every verdict depends on one row and the boilerplate table alone, so repeated rows and repeated ids get
    equal verdicts. A null text has no words and fails; a null host is a host of its own; other columns are carried, a host other than
    source must be renamed to it; an empty table gives no rows.
    """
    over = materialize(boilerplate(docs, "source", min_docs, max_share))
    keyed = with_key(docs)
    lines = keyed.select("_k_id", "_k_rid", F.coalesce(F.col("source"), F.lit("")).alias("_host"), F.explode(line_hashes(F.col("text"))).alias("_line"))
    found = join_small(lines, over, ["_host", "_line"]).groupBy("_k_id", "_k_rid", "_host").agg(F.collect_set("_line").alias("_found"))
    keyed = keyed.withColumn("_host", F.coalesce(F.col("source"), F.lit("")))
    docs = join_small(keyed, materialize(found), ["_k_id", "_k_rid", "_host"], "left").drop("_k_id", "_k_rid", "_host")
    text = F.coalesce(F.col("text"), F.lit(""))
    some = F.col("_found").isNotNull()
    df = docs.withColumns({
        "_words": words_of(F.col("text")),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "clean_text": F.when(some, without_lines(F.col("text"), F.col("_found"))).otherwise(F.col("text")),
    }).withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    df = _with_repeats(df, WINDOW)
    df = df.withColumn("n_words_left", F.when(some, F.size(words_of(F.col("clean_text"))).cast("long")).otherwise(F.col("n_words")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = some & ((F.col("n_words_left") < min_words) | (F.col("n_words_left") < min_kept_share * F.col("n_words")))
    # A filter on the verdict must stop here: pushed further down, it would repeat the nested expressions below over and over.
    df = df.withColumns({"base_failed": failed, "_stop": F.monotonically_increasing_id()})
    df = df.withColumn("kept", (F.col("_stop") >= 0) & ~F.col("base_failed") & ~depleted)
    return df.drop("_words", "_lines", "_found", "_stop")


DIGEST = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


@carry("doc_id", "text", "source", "n_chars", exact=True)
def stage(docs: DataFrame) -> DataFrame:
    """The kept documents with their boilerplate lines removed, in the columns of docs."""
    out = quality_rules(docs).where("kept")
    return out.select(*[F.col("clean_text").alias("text") if c == "text" else F.length("clean_text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
n AS (SELECT *, list_distinct(list_transform(l, lambda x: trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')))) AS nl FROM f),
u AS (SELECT DISTINCT host, doc_id, t, nl FROM n),
hosts AS (SELECT host, count(*) AS docs FROM u GROUP BY host),
over_ AS (SELECT host, line FROM (SELECT host, t, unnest(nl) AS line FROM u) JOIN hosts USING (host) GROUP BY host, line
          HAVING count(*) > {MIN_DOCS} AND count(DISTINCT t) > {MIN_DOCS} AND count(*) > max(docs) * {MAX_SHARE}),
lists AS (SELECT host, list(line) AS over_lines FROM over_ GROUP BY host),
win AS (SELECT doc_id, t, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS g FROM (SELECT DISTINCT doc_id, t, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM n)),
rep AS (SELECT doc_id, t, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, t, g) > 1),
cov AS (SELECT doc_id, t, count(DISTINCT i + k) AS c FROM rep, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY doc_id, t),
r AS (
  SELECT n.*, coalesce(c, 0) AS n_repeat_words, len(w) AS n_words,
    list_filter(string_split(n.t, chr(10)), lambda x: NOT (regexp_matches(x, '[^\x20\x09-\x0D]') AND
      list_contains(coalesce(over_lines, []), trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))))) AS kl
  FROM n LEFT JOIN cov ON cov.doc_id IS NOT DISTINCT FROM n.doc_id AND cov.t = n.t LEFT JOIN lists USING (host)),
s AS (SELECT *, len(regexp_extract_all(array_to_string(kl, chr(10)), '[^\x20\x09-\x0D]+')) AS words_left FROM r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
  AND NOT (words_left < n_words AND (words_left < {MIN_WORDS} OR words_left < {MIN_KEPT_SHARE} * n_words)) AS kept
FROM s
"""
