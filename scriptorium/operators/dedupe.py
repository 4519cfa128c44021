"""Duplicate documents: exact, by key precedence, by title trigrams, and greedy acceptance in order of arrival."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.similar import best_in_blocks, similar_ids, similar_pairs
from scriptorium.storage import stage

THRESHOLD = 0.6


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given total order; rows with a null key all stay.

    Firsts are found by an aggregate with map-side partial minima, so a key that a third of all rows carry never gathers in
    one task.
    """
    firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    marked = df.join(firsts, key, "left")
    return marked.where(F.col(key).isNull() | (F.struct(*order) == F.col("_first"))).drop("_first")


def trigrams(c: Column) -> Column:
    """Distinct three-letter pieces of the lower-case words, each word padded with two blanks before and one behind."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def _titles(docs: DataFrame) -> DataFrame:
    """id, document_type, title, known, t: the different titles of each type with their trigrams, staged, so that ids stay."""
    given = docs.where("title is not null and document_type is not null")
    known = F.min("known") if "known" in docs.columns else F.min(F.lit(False))
    titles = given.groupBy("document_type", "title").agg(known.alias("known"))
    return stage(titles.select(F.monotonically_increasing_id().alias("id"), "document_type", "title", "known", trigrams(F.col("title")).alias("t")), "trigrams")


def similar_titles(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """document_type, title_a, title_b, similarity: different titles of a type with a trigram Jaccard similarity over the threshold.

    Equal titles collapse first. The sets are packed into blocks, and every two blocks with a type in common meet in one task: two sets that similar
    must share a trigram among their rarest few, only those meet there, and each candidate is verified on the whole sets where it is found
    (`similar`). No pair is lost, and no candidate is shuffled. Null titles, and null types, match nothing. With a boolean column `known` only
    pairs with a title that has a row where it is false are sought: what is new against all.
    """
    return similar_pairs(_titles(docs), threshold)


def best_matches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """document_type, title, best, similarity: of each title the most similar other one of its type over the threshold, of equals the least.

    Pairs are never listed: each task gives the best of a title in a block, and the least of them is taken.
    """
    titles = _titles(docs)
    best = best_in_blocks(titles, threshold).groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "best")).alias("m"))
    return titles.select("id", "document_type", "title").join(best, "id").select("document_type", "title", F.col("m.best").alias("best"), (-F.col("m.s")).alias("similarity"))


def acceptance(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, status - what a sequential intake would report: inserted, duplicate, near_duplicate or irrelevant.

    docs: doc_id, created_at, content_hash, document_type, title, relevant. A document is compared only with documents
    accepted before it: an equal hash makes it a duplicate, a similar or equal title of its type a near duplicate; else its flag
    decides. Order of arrival is (created_at, doc_id). All rows decide at once in rounds: a row is settled when the least
    accepted or least open arrival among its neighbours tells; settled rows leave the loop. Neighbours are summed up per hash and per title, never
    paired row by row; titles and arrivals are numbers there. known: documents accepted in earlier runs, of the same columns; they come first and are not reported.
    """
    docs = docs.select("doc_id", "created_at", "content_hash", "document_type", "title", "relevant").withColumn("known", F.lit(False))
    if known is not None:
        docs = docs.unionByName(known.select("doc_id", "created_at", "content_hash", "document_type", "title", "relevant").withColumn("known", F.lit(True)))
    order = (~F.col("known"), F.coalesce("created_at", F.lit(0).cast("timestamp")), F.col("doc_id"))
    rows = stage(docs.withColumn("relevant", F.coalesce("relevant", F.lit(False))).orderBy(*order).withColumn("o", F.monotonically_increasing_id()), "arrivals")
    # a title's id is its first arrival, so a link leads from the later title to the earlier one; back only where the earlier one comes again later
    titles = rows.where("title is not null and document_type is not null").groupBy("document_type", "title").agg(F.min("o").alias("id"), F.max("o").alias("last"), F.min("known").alias("known"))
    titles = stage(titles.select("*", trigrams(F.col("title")).alias("t")), "trigrams")
    links = stage(similar_ids(titles, THRESHOLD).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "title-links")
    again = links.join(titles.where("last > id").select(F.col("id").alias("b"), "last"), "b").where("last > a").select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = links.unionByName(again)
    rows = rows.join(titles.select("document_type", "title", F.col("id").alias("k")), ["document_type", "title"], "left")
    state = stage(rows.select("doc_id", "o", "content_hash", "k", "relevant", F.lit(False).alias("touched"), F.when(F.col("known"), "inserted").alias("status")), "acceptance")
    settled = []
    while True:
        accepted, still = F.col("status") == "inserted", F.col("status").isNull()
        # a row that is not relevant is never accepted, so none waits for it
        least = (F.min(F.when(accepted, F.col("o"))).alias("acc"), F.min(F.when(still & F.col("relevant"), F.col("o"))).alias("open"))
        by_hash = state.where("content_hash is not null").groupBy("content_hash").agg(*least).select("content_hash", F.col("acc").alias("h_acc"), F.col("open").alias("h_open"))
        by_title = state.where("k is not null").groupBy(F.col("k").alias("b")).agg(*least)
        beside = near.join(by_title, "b").select("a", "acc", "open").unionByName(by_title.select(F.col("b").alias("a"), "acc", "open"))
        around = beside.groupBy(F.col("a").alias("k")).agg(F.min("acc").alias("t_acc"), F.min("open").alias("t_open"))
        seen = state.where(still).join(by_hash, "content_hash", "left").join(around, "k", "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("o"), F.lit(False))
        touched = F.col("touched") | before("t_acc")
        decided = (
            F.when(before("h_acc"), "duplicate")
            .when(before("h_open"), None)  # a hash match may still be accepted and goes first
            .when(touched, "near_duplicate")
            .when(before("t_open"), None)
            .when(F.col("relevant"), "inserted")
            .otherwise("irrelevant")
        )
        # the next round needs the open rows, with what they know of earlier rounds, and what this round has accepted
        done = stage(seen.select("doc_id", "o", "content_hash", "k", "relevant", touched.alias("touched"), decided.alias("status")), "acceptance")
        settled.append(done.where("status is not null").select("doc_id", "status"))
        if not done.where(still).limit(1).count():
            return reduce(DataFrame.unionByName, settled)
        state = done.where(still | accepted)
        open_keys = done.where(still & F.col("k").isNotNull()).select(F.col("k").alias("a")).distinct()
        near = stage(near.join(open_keys, "a", "left_semi"), "title-links")


def by_precedence(df: DataFrame, key: str, rank: Column, order: str) -> DataFrame:
    """One row per key: that of the best rank, then least order; rows with a null key all stay."""
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(rank.alias("r"), F.col(order).alias("o"))).alias("_best"))
    marked = df.join(best, key, "left")
    return marked.where(F.col(key).isNull() | ((rank == F.col("_best.r")) & (F.col(order) == F.col("_best.o")))).drop("_best")


def rewrite_conflicts(df: DataFrame, old: str, new: str, key: str) -> DataFrame:
    """Rows whose new value another row already has or also gets; those rows keep the old one."""
    taken = df.select(F.col(new).alias("v"), F.col(key).alias("k")).union(df.select(F.col(old), F.col(key))).where("v is not null").groupBy("v").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi")
    return df.where(f"not ({new} <=> {old})").join(taken.select(F.col("v").alias(new)), new, "left_semi")


