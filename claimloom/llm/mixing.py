"""Problem 7: sources combined to target shares of the tokens.

Tokens are summed per source; the shares set how often each source has to be
repeated, no more than its cap allows. A rate is met by giving each document
floor(rate) times, and once more with the probability of the rest, drawn from a
hash of its id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources.tables import small, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's text is cut into words before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
# End of the fixed values.


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of each document with an id; null texts have no tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _tokenizer(vocabulary).encode_ordinary
        for df in batches:
            df["n_tokens"] = [len(encode(t)) if t else 0 for t in df["text"]]
            yield df[["doc_id", "source", "n_tokens"]]

    return documents.select("doc_id", "source", "text").where("doc_id is not null").mapInPandas(count, "doc_id bigint, source string, n_tokens bigint")


def rates(sizes: DataFrame, targets: DataFrame, wanted: int | None = None) -> DataFrame:
    """Per target source: n_tokens, target_share, max_repeats, rate.

    ``sizes`` has the tokens per source. If the caps allow, the mix has ``wanted``
    tokens, or is as large as the sources without repetition; else the mix shrinks to the largest total
    at which every source that has tokens meets its share under its cap, the
    shares of sources without any tokens being spread over the rest.
    """
    rows = targets.select("source", "target_share", "max_repeats").where("source is not null").join(sizes, "source", "left").fillna(0, ["n_tokens"])
    rows = rows.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("n_tokens").alias("n_tokens"))
    able = (F.col("n_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    least = F.min(F.when(able, F.col("n_tokens") * F.col("max_repeats") / F.col("target_share")))
    rows = written(rows, "mix-sources")
    tokens, shares, least = rows.agg(F.sum(F.when(able, F.col("n_tokens"))), F.sum(F.when(able, F.col("target_share"))), least).first()
    size = min(wanted if wanted is not None else tokens or 0, (least or 0) * (shares or 0))
    rate = F.when(able, F.least(F.col("max_repeats").cast("double"), F.lit(size / (shares or 1)) * F.col("target_share") / F.col("n_tokens"))).otherwise(0.0)
    return rows.select("source", "n_tokens", "target_share", "max_repeats", rate.alias("rate"))


def mix(counts: DataFrame, targets: DataFrame, seed: int = 1, wanted: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix and what it reached: (doc_id, source, copy_no, n_tokens) and per source the shares.

    counts: doc_id, source, n_tokens, as ``token_counts`` gives. A document of a
    source without a target, or of a null source, is not in the mix; neither is
    one of a source with a share or cap of zero or null. Equal repeated rows are
    repeated documents. The report has a row per target source, with zeros where
    nothing was given: source, target_share, reached_share, spread (the standard
    deviation to expect of the reached share, from the draws of this source),
    max_repeats, rate, n_docs, n_copies, n_tokens. ``wanted`` as in ``rates``.
    """
    sizes = counts.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.pow("n_tokens", F.lit(2.0))).alias("squares"))
    rate = written(rates(sizes.drop("squares"), targets, wanted), "mix-rates")
    rows = counts.join(small(rate.select("source", "rate"), 100_000), "source")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    times = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")
    rows = rows.withColumn("times", times.cast("int")).where("times > 0")
    mixed = rows.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy_no"), "n_tokens")
    given = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("times").alias("n_copies"), F.sum(F.col("times") * F.col("n_tokens")).alias("given"))
    report = rate.join(given, "source", "left").join(sizes.select("source", "squares"), "source", "left").fillna(0, ["n_docs", "n_copies", "given", "squares"])
    whole = F.sum("given").over(Window.partitionBy())  # one row per target source
    reached = F.when(whole > 0, F.col("given") / whole).otherwise(0.0)
    drawn = F.col("rate") - F.floor("rate")
    spread = F.when(whole > 0, F.sqrt(drawn * (1 - drawn) * F.col("squares")) / whole).otherwise(0.0)
    return mixed, report.select("source", "target_share", reached.alias("reached_share"), spread.alias("spread"), "max_repeats", "rate", "n_docs", "n_copies", F.col("given").alias("n_tokens"))
