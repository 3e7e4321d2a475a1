"""References to parent records that don't exist at the time of the reference.

Method: a Bloom filter of the parent keys, broadcast, proves definite orphans;
only references that pass it are verified by an exact join; then both kinds are
aggregated per table and period.

The filter is a small table of blocks of 64 words of 64 bits: a key's hash names
its block, its word and four bits in it. It has at most 2^24 words, so that its
broadcast, about 150 MB, is bounded whatever the number of parents: 16 bits a
parent up to 67 million of them, 4 bits at 270 million. Beyond that it proves
less and leaves more to the exact join, but the result is the same;
``proved_shares`` tells how much.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.text import stripped
from strandlake.session import materialize

#: Fixed value: stands for "not removed".
FOREVER = "9999-12-31 00:00:00"
BITS_PER_KEY, BITS_SET = 16, 4
MIN_WORDS, MAX_WORDS, BLOCK_WORDS = 64, 1 << 24, 64
#: Exact join: parents are broadcast up to this many bytes, else both sides are shuffled with hot keys salted.
BROADCAST_BYTES = 32 << 20
SALTS = 32


@dataclass(frozen=True)
class References:
    """A table that refers to parents. ``key``, ``parent`` and ``at`` are expressions over ``rows``."""

    name: str
    rows: DataFrame
    key: Column
    parent: Column
    at: Column


@dataclass(frozen=True)
class Parents:
    """Per id its span, and the closed lifetimes of ids whose span has holes. ``size``: rows, bytes."""

    spans: DataFrame
    holes: DataFrame
    size: tuple[int, int]
    holes_bytes: int


def parent_lifetimes(parents: list[DataFrame], id_col: str = "id", from_col: str = "loaded_at", to_col: str = "removed_at") -> Parents:
    """Reduce parent rows to lifetimes per id, without gathering an id's rows in one place.

    A row is live from ``from_col`` (inclusive) to ``to_col`` (exclusive, null =
    not removed). Rows with a null or empty id, without a start or with an end
    not after it are never live; their ids still count as known.
    """
    rows = reduce(DataFrame.unionByName, (
        p.select(stripped(F.col(f"`{id_col}`")).alias("id"), F.col(f"`{from_col}`").cast("timestamp").alias("a"), F.coalesce(F.col(f"`{to_col}`").cast("timestamp"), F.lit(FOREVER).cast("timestamp")).alias("b"))
        for p in parents
    )).where(F.col("id").isNotNull() & (F.col("id") != ""))
    live = F.coalesce(F.col("a") < F.col("b"), F.lit(False))
    # a repeated row is one lifetime; of one start only the latest end matters
    lives = rows.groupBy("id", F.when(live, F.col("a")).alias("a")).agg(F.max(F.when(live, F.col("b"))).alias("b"))
    forever = F.lit(FOREVER).cast("timestamp")
    spans = lives.groupBy("id").agg(
        F.min("a").alias("first_at"),
        F.min(F.when(F.col("b") >= forever, F.col("a"))).alias("open_from"),
        F.max(F.when(F.col("b") < forever, F.col("b"))).alias("last_end"),
        F.count_if(F.col("b") < forever).alias("n_closed"),
    )
    spans = materialize(spans, "parent-spans")
    n, size = spans.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("id") + 64), F.lit(0))).first()
    several = spans.where("n_closed + cast(open_from is not null as int) > 1").select("id", "open_from")
    holes = lives.where(F.col("b") < forever).join(several, "id").where("open_from is null or a < open_from").select("id", "a", "b")
    holes = materialize(holes, "parent-lifetimes")
    return Parents(spans, holes, (n, size), holes.agg(F.coalesce(F.sum(F.octet_length("id") + 64), F.lit(0))).first()[0])


def _word_and_mask(key: Column, n_words: int) -> tuple[Column, Column]:
    word = F.pmod(F.xxhash64(key), F.lit(n_words)).cast("long")
    second = F.xxhash64(key, F.lit(1))
    bits = (F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int") for i in range(BITS_SET))
    return word, reduce(lambda a, b: a.bitwiseOR(b), (F.call_function("shiftleft", F.lit(1).cast("long"), at) for at in bits))


def bloom_filter(keys: DataFrame, n: int, bits_per_key: int = BITS_PER_KEY, max_words: int = MAX_WORDS) -> tuple[DataFrame, int]:
    """Filter of the column ``id``, as rows (word, bits), and its number of words, at most ``max_words``."""
    n_words = MIN_WORDS
    while n_words * 64 < n * bits_per_key and n_words < max_words:
        n_words *= 2
    word, mask = _word_and_mask(F.col("id"), n_words)
    return keys.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits")), n_words


def _blocks(bloom: DataFrame) -> DataFrame:
    """The filter with BLOCK_WORDS words to a row, which takes little more memory than the words themselves."""
    at = F.pmod("_word", F.lit(BLOCK_WORDS))
    words = F.array(*(F.coalesce(F.bit_or(F.when(at == i, F.col("_bits"))), F.lit(0).cast("long")) for i in range(BLOCK_WORDS)))
    return bloom.groupBy(F.shiftright("_word", BLOCK_WORDS.bit_length() - 1).alias("_block")).agg(words.alias("_words"))


def _probed(refs: DataFrame, parents: Parents, bits_per_key: int, max_words: int) -> DataFrame:
    """``refs`` with ``_maybe``: false where the filter proves that there is no such parent."""
    bloom, n_words = bloom_filter(parents.spans.select("id"), parents.size[0], bits_per_key, max_words)
    word, mask = _word_and_mask(F.col("parent_key"), n_words)
    keyed = refs.withColumn("_word", word).withColumn("_mask", mask).withColumn("_block", F.shiftright("_word", BLOCK_WORDS.bit_length() - 1))
    probed = keyed.join(F.broadcast(_blocks(bloom)), "_block", "left")
    bits = F.get("_words", F.pmod("_word", F.lit(BLOCK_WORDS)).cast("int"))
    return probed.withColumn("_maybe", F.coalesce(bits.bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))).drop("_word", "_mask", "_block", "_words")


def _references(tables: list[References]) -> DataFrame:
    refs = reduce(DataFrame.unionByName, (t.rows.select(F.lit(t.name).alias("src_table"), t.key.alias("row_key"), stripped(t.parent).alias("parent_key"), t.at.cast("timestamp").alias("at")) for t in tables))
    return refs.where(F.col("parent_key").isNotNull() & (F.col("parent_key") != ""))


def proved_shares(tables: list[References], parents: Parents, bits_per_key: int = BITS_PER_KEY, max_words: int = MAX_WORDS) -> DataFrame:
    """Per table: ``n_references``, ``n_proved`` (orphans by the filter alone) and ``n_verified`` (left to the exact join)."""
    probed = _probed(_references(tables), parents, bits_per_key, max_words)
    return probed.groupBy("src_table").agg(F.count("*").alias("n_references"), F.count_if(~F.col("_maybe")).alias("n_proved"), F.count_if("_maybe").alias("n_verified"))


def _verdict(known: Column) -> Column:
    """Null if live by the span alone; 'gap' if only the lifetimes can tell; else the reason."""
    at = F.col("at")
    return (
        F.when(~known, "missing")
        .when(at.isNull(), "undated")
        .when(F.col("first_at").isNull(), "never_live")
        .when(at < F.col("first_at"), "loaded_later")
        .when(at >= F.col("open_from"), None)
        .when(F.col("last_end").isNull() | (at >= F.col("last_end")), "removed")
        .when((F.col("n_closed") == 1), None)
        .otherwise("gap")
    )


def orphan_references(tables: list[References], parents: Parents, broadcast_bytes: int = BROADCAST_BYTES, bits_per_key: int = BITS_PER_KEY, max_words: int = MAX_WORDS, salts: int = SALTS) -> DataFrame:
    """Rows whose reference isn't live at their own time.

    Columns ``src_table, row_key, parent_key, at, reason``. The reference is
    stripped of white space and compared exactly; null and empty references are
    none and never orphans. ``reason``: ``missing`` (no such id), ``undated``
    (the row has no time), ``never_live`` (no valid lifetime), ``loaded_later``
    or ``removed`` (between or after lifetimes). Repeated rows are reported each
    time. Without parents every reference is missing; without rows the result
    is empty.
    """
    size = parents.size[1]
    probed = _probed(_references(tables), parents, bits_per_key, max_words)

    if size <= broadcast_bytes:  # the references aren't moved at all
        spans = parents.spans.withColumnRenamed("id", "_id")
        judged = probed.join(F.broadcast(spans), F.when(F.col("_maybe"), F.col("parent_key")) == F.col("_id"), "left")
        judged = judged.withColumn("reason", _verdict(F.col("_id").isNotNull()))
    else:
        judged = _salted_join(probed.where("_maybe"), parents.spans, salts).withColumn("reason", _verdict(F.col("_id").isNotNull()))
        judged = judged.select("src_table", "row_key", "parent_key", "at", "reason").unionByName(
            probed.where("not _maybe").select("src_table", "row_key", "parent_key", "at", F.lit("missing").alias("reason"))
        )
    open_ = judged.where("reason is not null").select("src_table", "row_key", "parent_key", "at", "reason")
    h = parents.holes.select(F.col("id").alias("_hid"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    inside = (F.col("reason") == "gap") & (F.col("parent_key") == F.col("_hid")) & (F.col("_a") <= F.col("at")) & (F.col("at") < F.col("_b"))
    if parents.holes_bytes <= broadcast_bytes:
        found = open_.join(F.broadcast(h), inside, "left_anti")
    else:
        open_ = materialize(open_, "open-references")  # read several times: the orphans, and those that a gap may explain
        left, right = _salted(open_.where("reason = 'gap'"), h, "_hid", salts)
        found = open_.where("reason <> 'gap'").unionByName(left.join(right, inside & (F.col("_salt") == F.col("_s")), "left_anti").drop("_salt"))
    return found.withColumn("reason", F.when(F.col("reason") == "gap", "removed").otherwise(F.col("reason")))


def _salted(refs: DataFrame, parents: DataFrame, id_col: str, salts: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a shuffled join on ``parent_key`` and ``id_col``, with ``_salt`` and ``_s`` to join on too, so that hot ids are spread over ``salts`` partitions.

    Hot are ids with over one in ``8 * salts`` of the references, so there are
    fewer than ``8 * salts`` of them and their list may be broadcast.
    """
    counts = refs.groupBy("parent_key").agg(F.count("*").alias("_n"))
    total = refs.count()
    hot = counts.where(F.col("_n") * F.lit(8 * salts) > F.lit(total)).select(F.col("parent_key").alias("_hot"))
    left = refs.join(F.broadcast(hot), F.col("parent_key") == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("src_table", "row_key"), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    right = parents.join(F.broadcast(hot), F.col(id_col) == F.col("_hot"), "left").withColumn("_s", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left, right


def _salted_join(refs: DataFrame, spans: DataFrame, salts: int) -> DataFrame:
    """Left join of references to the spans of their ids, both shuffled."""
    left, right = _salted(refs, spans.withColumnRenamed("id", "_id"), "_id", salts)
    return left.join(right.hint("shuffle_hash"), (F.col("parent_key") == F.col("_id")) & (F.col("_salt") == F.col("_s")), "left")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month of ``at`` ('unknown' without a time) and reason."""
    month = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown"))
    return orphans.groupBy("src_table", month.alias("month"), "reason").agg(F.count("*").alias("n_orphans"), F.count_distinct("parent_key").alias("n_keys"))
