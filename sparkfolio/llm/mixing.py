"""Sources mixed to target shares of the tokens, by systematic sampling.

Every document of a source is expected to be used r times, r being the source's share of the total over
its own tokens.  The expected copies are summed up along the source, one random offset is added, and a
document comes out once for each whole number its step crosses: floor or ceil of r times, so never more than
the cap.  Documents are summed in order of size, so the tokens drawn miss the share by no more than about the
longest document; the report tells the shares reached.  The prefix sum runs over cells (size class and hash, a bounded number per source) and then within each cell, so a
source that holds most rows is never in one task.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_rows
from .packing import TOKENIZER_FILE, _cut, token_counts

CELLS = 256  # hash cells per size class; size classes are eighths of a power of two


def rates(counts: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> dict[str, float]:
    """Expected copies per document of each source that has a target and tokens.

    Without `total_tokens` the total is the largest at which every such source reaches its share within its
    cap; with it, sources whose cap binds give what they can.
    """
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share"), F.max("max_repeats"))
    want = {r[0]: (float(r[1]), int(r[2])) for r in small_rows(wanted, "the table of targets", 1000)}
    have = {r[0]: r[1] for r in counts.where("source is not null and tokens > 0").join(F.broadcast(targets.select("source").distinct()), "source").groupBy("source").agg(F.sum("tokens")).collect()}
    live = {s: (share, cap, have[s]) for s, (share, cap) in want.items() if have.get(s)}
    if not live:
        return {}
    total = total_tokens or min(cap * tokens / share for share, cap, tokens in live.values())
    return {s: min(float(cap), total * share / tokens) for s, (share, cap, tokens) in live.items()}


def mix_sources(documents: DataFrame, targets: DataFrame, seed: int = 42, total_tokens: float | None = None, path: str = TOKENIZER_FILE) -> DataFrame:
    """(doc_id, source, tokens, copy): one row per use of a document.

    Null sources, sources without a target and documents without tokens aren't used; a target without
    documents stays unreached.  `targets` is a small fixed table (8 rows).
    """
    spark = documents.sparkSession
    counts = _cut(token_counts(documents, path, keep=("source",)))
    per = rates(counts, targets, total_tokens)
    if not per:
        return counts.where("false").select("doc_id", "source", "tokens", F.lit(1).alias("copy"))
    rate = F.broadcast(spark.createDataFrame(sorted(per.items()), "source string, rate double"))
    rows = counts.where("tokens > 0").join(rate, "source")
    rows = rows.withColumn("size_class", F.floor(F.log2("tokens") * 8).cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(CELLS)).cast("int"))
    keys = ["source", "size_class", "cell"]
    cells = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    along = Window.partitionBy("source").orderBy("size_class", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n")
    within = Window.partitionBy(*keys).orderBy("tokens", "doc_id")
    rows = rows.withColumn("rn", F.row_number().over(within)).join(cells, keys).select("doc_id", "source", "tokens", "rate", (F.col("before") + F.col("rn")).alias("at"))
    # One random offset a source, the same in every run with the seed.
    rng = random.Random(seed)
    offset = F.create_map(*[x for source in sorted(per) for x in (F.lit(source), F.lit(rng.random()))])[F.col("source")]
    copies = F.floor(F.col("at") * F.col("rate") + offset) - F.floor((F.col("at") - 1) * F.col("rate") + offset)
    rows = rows.withColumn("copies", copies.cast("int")).where("copies > 0")
    return rows.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def mix_report(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: the share aimed at and the share, tokens, documents and most uses of one document reached."""
    got = selection.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("docs"), F.max("copy").alias("most_uses"))
    # A window over the few rows of the report.
    out = targets.join(got, "source", "left").withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    return out.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"))
