"""Training samples from papers: sections to rows, splits by group, balance, label masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.storage import per_value

# The least number of characters of a section that makes a sample.
LEAST = {"abstract": 80, "introduction": 250, "body": 800, "conclusion": 180}
IGNORED = -100


def paper_samples(papers: DataFrame, least: dict[str, int] = LEAST) -> DataFrame:
    """paper_id, section, input, output: the title and every section of enough characters, one row each."""
    parts = [F.struct(F.lit("title").alias("section"), F.col("title").alias("output"), F.lit(1).alias("least"))]
    parts += [F.struct(F.lit(n).alias("section"), F.trim(n).alias("output"), F.lit(k).alias("least")) for n, k in least.items()]
    rows = papers.select(F.col("id").alias("paper_id"), F.col("title").alias("input"), F.explode(F.array(*parts)).alias("s"))
    return rows.where(F.length("s.output") >= F.col("s.least")).select("paper_id", "s.section", "input", "s.output")


def paper_key(paper_id: Column, source: Column, sample_id: Column) -> Column:
    """The paper's id, else the source's name, else the sample's own id."""
    return F.coalesce(F.nullif(F.trim(paper_id), F.lit("")), F.nullif(F.trim(source), F.lit("")), sample_id.cast("string"))


def split_groups(samples: DataFrame, key: str, share: float = 0.15, seed: int = 42, small: int = 10_000) -> DataFrame:
    """Adds part: all samples of a group are in train or in validation.

    A share of the groups, rounded half to even and at least one, is taken in the order of a hash of key and seed; with two
    groups or fewer all are train. The greatest hash that is taken is found by counting groups by ever longer beginnings of their hashes
    (at most 4,096 counts at a time) until few are left, so no task sorts the groups and nothing is joined.
    """
    hashed = F.when(F.col(key).isNotNull(), F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")), 256))
    groups = samples.select(hashed.alias("h")).where("h is not null").distinct()
    n = groups.count()
    take = 0 if n <= 2 else max(1, round(n * share))
    if not take:
        return samples.withColumn("part", F.lit("train"))
    begin, left = "", take
    while True:
        within = groups.where(F.col("h").startswith(begin))
        size = len(begin) + 3
        counts = sorted(within.groupBy(F.left("h", F.lit(size)).alias("p")).agg(F.count("*").alias("n")).collect())
        for p, n in counts:
            if left <= n:
                begin = p
                break
            left -= n
        if n <= small:
            bound = sorted(r[0] for r in groups.where(F.col("h").startswith(begin)).collect())[left - 1]
            return samples.withColumn("part", F.when(hashed <= bound, "validation").otherwise("train"))


def even_positions(n: Column, most: int) -> Column:
    """`most` of n positions from 0, evenly spaced, rounded half to even; all if there are no more; the middle one for one."""
    if most == 1:
        return F.array(F.floor((n - 1) / 2).cast("long"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / (most - 1), 0).cast("long"))
    return F.when(n <= most, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).otherwise(F.array_distinct(spread))


def balance(samples: DataFrame, group: str, order: str, most: int = 5, slots: int = 256) -> DataFrame:
    """At most `most` body samples per group (null groups are one), evenly chosen by a numeric order; all other samples stay.

    Positions in a group are numbered in two levels: the order's range is cut into slots by its quantiles, each slot of a group is numbered
    in its own task, and the counts of the slots before it, at most `slots` rows a group, are added. So a group with a
    third of all rows is spread over all slots.
    """
    body = samples.where(F.col("section").startswith("body"))
    bounds = body.agg(F.percentile_approx(order, [i / slots for i in range(1, slots)])).first()[0] or []
    slot = F.size(F.filter(F.lit(sorted(set(bounds))) if bounds else F.array().cast("array<long>"), lambda b: b < F.col(order)))
    numbered = body.withColumn("_s", F.coalesce(slot, F.lit(-1))).withColumn("_r", F.row_number().over(W.partitionBy(group, "_s").orderBy(order)).cast("long") - 1)
    sizes = body.withColumn("_s", F.coalesce(slot, F.lit(-1))).groupBy(group, "_s").agg(F.count("*").alias("_c"))
    w = W.partitionBy(group).orderBy("_s")
    before = sizes.select(F.col(group).alias("_g"), F.col("_s").alias("_t"), (F.sum("_c").over(w) - F.col("_c")).alias("_b"), F.sum("_c").over(W.partitionBy(group)).alias("_n"))
    placed = numbered.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_t")))
    kept = placed.where(F.array_contains(even_positions(F.col("_n"), most), F.col("_b") + F.col("_r"))).select(*samples.columns)
    return kept.unionByName(samples.where(~F.coalesce(F.col("section").startswith("body"), F.lit(False))))


def body_pieces(body: Column, size: int = 3000, overlap: int = 250, least: float = 0.65) -> Column:
    """Pieces of a body of at most `size` characters: cut behind the last pause (paragraph, full stop, Korean sentence end) if it lies beyond `least` of the size.

    Consecutive pieces overlap by `overlap` characters; pieces are trimmed, empty ones left out. A short text is one piece, null stays null.
    """

    def pieces(text: str) -> list[str]:
        if len(text) <= size:
            return [text] if text else []
        out, start = [], 0
        while True:
            end = min(start + size, len(text))
            if end < len(text):
                pause = max(text.rfind(mark, start, end) for mark in ("\n\n", ". ", ".\n", "다. "))
                if pause - start >= int(size * least):
                    end = pause + 1
            out.append(text[start:end].strip())
            if end == len(text):
                return [x for x in out if x]
            start = max(end - overlap, start + 1)

    return per_value(pieces, "array<string>")(body)


def masked_labels(ids: Column, prompt: Column, least: int = 8) -> Column:
    """Labels: ids with the prompt's positions ignored; all are ignored if fewer than `least` remain."""
    few = F.size(ids) - prompt < least
    return F.transform(ids, lambda x, i: F.when(few | (i < prompt), F.lit(IGNORED)).otherwise(x))


def section_rank(section: Column) -> Column:
    """Order of sections: title, abstract, introduction, body by number, unknown ones, conclusion."""
    part = F.regexp_extract(section, "^body_([0-9]+)$", 1)
    return F.when(section == "title", 0).when(section == "abstract", 1).when(section == "introduction", 2).when(part != "", 100 + part.cast("int")).when(section == "conclusion", 9999).otherwise(5000)
