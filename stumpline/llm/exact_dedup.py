"""Exact duplicates against immutable snapshots, screened by static binary-fuse filters.

Digests of a snapshot never change, so each bucket of them gets a static filter of about nine bits a digest, built
once. Digests of a new batch meet the filter of their bucket: most are new and stop there. Those that the filter lets
through join the snapshot's exact table, and the texts behind equal digests are compared byte by byte. Copies within the
new batch are grouped among themselves, before the screening, so a text with millions of copies is screened once.

Memory of a task: one filter bucket, ``BUCKET`` digests on average, whatever the table's size. Groups are aggregated
before they are shuffled, so a hot group is a few rows.

Defined results: a null text is empty; all empty texts are equal; null ids lose ties; of rows that are equal in id and
text too, exactly one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stumpline.llm.arrays import mixed
from stumpline.llm.cluster import ship, staged, without_rows

BUCKET = 1 << 16
SENT = 200_000
WHITE_SPACE = r"[\x20\x09-\x0D]"


# The filter: three slots for each key, one in each of three neighbouring segments; the xor of the slots is the key's
# fingerprint. Slots are filled in the reverse of the order in which keys that own a slot alone are peeled off.


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> np.ndarray:
    h = mixed(keys + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    base = first * np.uint64(segment)
    step = np.uint64(segment)
    return np.stack([base + (h & mask), base + step + ((h >> np.uint64(18)) & mask), base + step + step + (mixed(h) & mask)]).astype(np.int64)


def _fingerprints(keys: np.ndarray, seed: int) -> np.ndarray:
    return (mixed(keys ^ np.uint64(seed + 0x5851F42D)) >> np.uint64(40)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, slots) of the static filter of distinct 64-bit keys."""
    keys = np.unique(keys)
    n = len(keys)
    segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / segment) - 2)
    for seed in range(1, 200):
        slots = _slots(keys, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.bincount(slots.ravel(), weights=np.tile(np.arange(n), 3), minlength=size).astype(np.int64)
        rounds, peeled = [], 0
        single = np.flatnonzero(count == 1)
        while len(single):
            key, at = np.unique(owner[single], return_index=True)
            rounds.append((key, single[at]))
            peeled += len(key)
            gone = slots[:, key].ravel()
            np.subtract.at(count, gone, 1)
            np.subtract.at(owner, gone, np.tile(key, 3))
            touched = np.unique(gone)
            single = touched[count[touched] == 1]
        if peeled == n:
            table, prints = np.zeros(size, np.uint8), _fingerprints(keys, seed)
            for key, own in reversed(rounds):
                others = table[slots[0, key]] ^ table[slots[1, key]] ^ table[slots[2, key]] ^ table[own]
                table[own] = prints[key] ^ others
            return seed, segment, segments, table.tobytes()
        segments += 1 + segments // 50
    raise ValueError("no seed peels these keys")


def may_contain(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    """False only for keys that aren't in the filter."""
    slots, held = _slots(keys, seed, segment, segments), np.frombuffer(table, np.uint8)
    return (held[slots[0]] ^ held[slots[1]] ^ held[slots[2]]) == _fingerprints(keys, seed)


# The operator.


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def digests(docs: DataFrame, arrived: Column) -> DataFrame:
    """(row, doc_id, arrived, n_chars, digest), written once: the texts are read, their digests kept."""
    return staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            arrived.alias("arrived"),
            F.length(F.coalesce(F.col("text"), F.lit(""))).alias("n_chars"),
            F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
        )
    )


def groups(rows: DataFrame) -> DataFrame:
    """One row for each digest and side: its rows' number and the row that stays."""
    return rows.groupBy("digest", "arrived").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg_id"), (-F.col("row")).alias("neg_row"))).alias("best")
    )


def _addressed(groups_of: DataFrame, buckets: int) -> DataFrame:
    return groups_of.select(
        "digest", F.col("best.neg_id").alias("neg_id"), F.xxhash64("digest").alias("key"), F.pmod(F.hash("digest"), F.lit(buckets)).alias("bucket")
    )


def snapshot_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One static filter for each bucket of a snapshot's digests."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, table = build_filter(rows["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "seed": [seed], "segment": [segment], "segments": [segments], "slots": [table]})

    return _addressed(snapshot, buckets).groupBy("bucket").applyInPandas(build, "bucket int, seed int, segment int, segments int, slots binary")


def screened(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Digests of the batch that the filters let through: all that the snapshot has and a few more."""

    def screen(rows: pd.DataFrame, filter_of: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or filter_of.empty:
            return pd.DataFrame({"digest": [], "new": []})
        f = filter_of.iloc[0]
        through = may_contain(rows["key"].to_numpy(np.int64).view(np.uint64), int(f["seed"]), int(f["segment"]), int(f["segments"]), f["slots"])
        return rows.loc[through, ["digest", "neg_id"]].rename(columns={"neg_id": "new"})

    return _addressed(batch, buckets).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(screen, "digest binary, new long")


def unequal_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Digests of (digest, old, new) whose two texts aren't the same bytes.

    Only the row that stays of either side is compared, as rows of one digest and side are one group already. Up to
    ``SENT`` wanted rows are sent to the scan, so that only their texts are shuffled; beyond it, all texts are.
    """
    wanted = pairs.select(F.explode(F.array("old", "new")).alias("neg_id"))
    wanted = F.broadcast(wanted) if pairs.count() <= SENT // 2 else wanted
    texts = docs.select((-F.col("doc_id").cast("long")).alias("neg_id"), normalised(F.col("text")).alias("norm"))
    texts = texts.join(wanted, "neg_id", "left_semi").select(F.unhex(F.sha2("norm", 256)).alias("digest"), "norm")
    return texts.groupBy("digest").agg((F.min("norm") != F.max("norm")).alias("unequal")).where("unequal").select("digest")


def exact_duplicates(docs: DataFrame, incoming: Column | None = None) -> DataFrame:
    """Every row with the row that stays of its group: doc_id, keep_id, group_size, kept, text_sha256, origin.

    ``incoming`` marks the rows of the new batch by their id; the others are the snapshot. The result is the same for
    any such division, only the way to it differs. origin: snapshot, new or copy (of a text of the snapshot).
    """
    ship(docs.sparkSession)
    incoming = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1 if incoming is None else incoming
    rows = digests(docs, F.coalesce(incoming, F.lit(False)))
    grouped = staged(groups(rows))
    snapshot, batch = grouped.where("not arrived"), grouped.where("arrived")
    buckets = max(1, math.ceil(snapshot.count() / BUCKET))
    positives = screened(batch, snapshot_filters(snapshot, buckets), buckets)
    pairs = staged(positives.join(snapshot, "digest").select("digest", F.col("best.neg_id").alias("old"), "new"))

    facts = (
        grouped.unionByName(pairs.select("digest", F.lit(True).alias("met")), allowMissingColumns=True)
        .unionByName(unequal_texts(pairs, docs).withColumn("unequal", F.lit(True)), allowMissingColumns=True)
        .groupBy("digest")
    )
    old, new = ~F.col("arrived"), F.col("arrived")
    sides = facts.agg(
        F.sum(F.when(old, F.col("n")).otherwise(0)).alias("n_old"),
        F.sum(F.when(new, F.col("n")).otherwise(0)).alias("n_new"),
        F.max(F.when(old, F.col("best"))).alias("old"),
        F.max(F.when(new, F.col("best"))).alias("new"),
        F.max("met").alias("met"),
        F.max("unequal").alias("unequal"),
    )
    own = F.col("unequal").isNotNull()
    best = F.when(own, F.when(new, F.col("new")).otherwise(F.col("old"))).otherwise(F.greatest("old", "new"))
    size = F.when(own, F.when(new, F.col("n_new")).otherwise(F.col("n_old"))).otherwise(F.col("n_old") + F.col("n_new"))
    return rows.join(sides, "digest").select(
        "doc_id",
        (-best["neg_id"]).alias("keep_id"),
        size.alias("group_size"),
        (F.col("row") == -best["neg_row"]).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.when(old, "snapshot").when(F.col("met") & ~own, "copy").otherwise("new").alias("origin"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    found = staged(exact_duplicates(docs).select(F.xxhash64("doc_id").alias("id"), F.unhex("text_sha256").alias("digest"), "kept"))
    dropped, kept = found.where("not kept").select("id", "digest"), found.where("kept").select("id", "digest")
    keys = {"id": F.xxhash64(F.col("doc_id").cast("long")), "digest": F.unhex(F.sha2(normalised(F.col("text")), 256))}
    return without_rows(docs, keys, dropped.join(kept, ["id", "digest"], "left_anti"), dropped.join(kept, ["id", "digest"], "left_semi"))
