"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Built-in expressions only. The n-grams are the words of a text and its pairs of
neighbouring words, hashed (xxhash64 of the word, or of the one and then the other)
into BUCKETS. The raw multinomial counts them over every document; the target
multinomial over every trusted document, found by a join with all labelled ids. A
bitmap of hashed ids, of 4 MB at most, keeps most other texts from being shuffled to
that join. The target is smoothed towards the raw distribution with PRIOR pseudo
counts a bucket, so a bucket without evidence counts nothing. A document's score is
its mean log ratio over its n-grams; it is kept if that reaches THRESHOLD whatever
the other documents are: no sampling, no ranking.
Weights are whole millionths, so sums don't depend on their order.

A null or empty text has no words: all counts are 0 and it fails the base rule.
Without trusted documents every ratio is 0. Repeated rows are rows of their own;
a null doc_id is never trusted. Further columns are kept or ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words

BUCKETS = 16381
PRIOR = 5
THRESHOLD = -0.1
UNIT = 1_000_000
#: Slices of the bitmap of trusted ids, and the bits of one (those of bitmap_construct_agg).
SLICES, SLICE_BITS = 1024, 32768


def neighbours(ws: Column) -> Column:
    """Each word with the one after it (null: none)."""
    return F.arrays_zip(ws.alias("w"), F.slice(ws, F.lit(2), F.greatest(F.size(ws), F.lit(1))).alias("next"))


def single(w: Column) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")


def pair(w: Column, after: Column) -> Column:
    return F.pmod(F.xxhash64(w, after), F.lit(BUCKETS)).cast("int")


def _slice(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLICES)).cast("int")


def _bit(key: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 32), F.lit(SLICE_BITS))


def _told(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """_bt_text of each row of docs, and good: 1 if its doc_id is trusted, else 0."""
    key = F.col("doc_id").try_cast(docs.schema["doc_id"].dataType)  # equal ids must have equal hashes
    ids = trusted_ids.select(key.alias("_bt_id")).where("_bt_id IS NOT NULL")
    marks = ids.select(_slice(F.col("_bt_id")).alias("_bt_slice"), _bit(F.col("_bt_id")).alias("bit")).repartition("_bt_slice").groupBy("_bt_slice").agg(F.bitmap_construct_agg("bit").alias("_bt_bits"))
    texts = docs.select(F.col("doc_id").alias("_bt_doc"), F.col("text").alias("_bt_text"))
    marked = texts.withColumn("_bt_slice", F.when(F.col("_bt_doc").isNotNull(), _slice(F.col("_bt_doc")))).join(F.broadcast(marks), "_bt_slice", "left")
    bit = _bit(F.col("_bt_doc"))
    byte = F.conv(F.hex(F.substring("_bt_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    # a bit that is not set tells surely; the rest meet the ids, always by a shuffle, so that its cost grows in proportion
    near = marked.where(may).join(ids.distinct().hint("merge"), F.col("_bt_doc") == F.col("_bt_id"), "left")
    apart = marked.where(~may).select("_bt_text", F.lit(0).alias("good"))
    return near.select("_bt_text", F.col("_bt_id").isNotNull().cast("int").alias("good")).unionByName(apart)


def weights(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """One row with an array: by bucket, the log ratio in millionths. Its size is fixed."""
    split = _told(docs, trusted_ids).select("good", words(F.col("_bt_text")).alias("ws"))  # once a text, before what reads it twice
    both = split.select("good", F.explode(neighbours(F.col("ws"))).alias("g"))
    found = both.select("good", single(F.col("g.w")).alias("one"), F.when(F.col("g.next").isNotNull(), pair(F.col("g.w"), F.col("g.next"))).alias("two"))
    seen = found.select("good", F.expr("stack(2, one, two)").alias("bucket")).where("bucket IS NOT NULL")
    counted = seen.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    totals = counted.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    prior = PRIOR * BUCKETS
    share = F.col("raw") / F.col("all_raw")
    ratio = F.log((F.col("target") + prior * share) / (F.col("all_target") + prior) / share)
    rated = counted.crossJoin(F.broadcast(totals)).select("bucket", F.round(ratio * UNIT).cast("long").alias("w"))  # totals: one row
    unseen = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("w"))
    whole = unseen.unionByName(rated).groupBy("bucket").agg(F.sum("w").alias("w"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "w"))), lambda x: x["w"]).alias("w"))


def repeated(hashes: Column) -> Column:
    """Words in 3-word windows whose hash stands twice or more."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_spread(placed))


def _spread(placed: Column) -> Column:
    # bound once through a one-element array, else each use would sort again
    def found(s: Column) -> Column:
        at = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
        starts = F.filter(at, lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    return F.get(F.transform(F.array(placed), found), F.lit(0))


#: Names of the columns that quality_scores adds.
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def quality_scores(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs as the struct ``_bt_row``, with ADDED."""
    w = weights(docs, trusted_ids)
    ws = F.col("_bt_words")
    a = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_bt_row"), words(F.col("text")).alias("_bt_words"))
    text = F.coalesce(F.col("_bt_row.text"), F.lit(""))
    hashes = F.transform(ws, lambda x: F.xxhash64(x))
    b = a.withColumn("_bt_hashes", hashes).withColumn("n_words", F.size(ws).cast("long"))
    windows = F.when(F.col("n_words") >= 3, F.transform(F.slice("_bt_hashes", F.lit(1), F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")), lambda h, i: F.xxhash64(h, F.get(F.col("_bt_hashes"), i + 1), F.get(F.col("_bt_hashes"), i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    c = b.withColumn("_bt_windows", windows).withColumn("_bt_lines", lines)
    c = c.withColumn("word_chars", F.aggregate(ws, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)))
    c = c.withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
    c = c.withColumn("n_dup_lines", (F.size("_bt_lines") - F.size(F.array_distinct("_bt_lines"))).cast("long"))
    c = c.withColumn("n_repeat_words", repeated(F.col("_bt_windows")).cast("long"))
    c = c.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    # the weights are one row of fixed size, joined to each row of docs
    d = c.crossJoin(F.broadcast(w.select(F.col("w").alias("_bt_w"))))
    weight = F.col("_bt_w")
    total = F.aggregate(neighbours(ws), F.lit(0).cast("long"), lambda acc, g: acc + F.get(weight, single(g["w"])) + F.when(g["next"].isNull(), 0).otherwise(F.get(weight, pair(g["w"], g["next"]))))
    d = d.withColumn("score", F.when(F.col("n_words") > 0, total / (UNIT * (2 * F.col("n_words") - 1))).otherwise(F.lit(0.0)))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    # made rows by a generator, below which no later filter is pushed: it would repeat every expression above
    return d.select("_bt_row", F.explode(F.array(F.struct(*ADDED))).alias("_bt_added")).select("_bt_row", "_bt_added.*")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, trusted(spark, sf_dir)).select("_bt_row.doc_id", *[c for c in ADDED if c != "score"])
