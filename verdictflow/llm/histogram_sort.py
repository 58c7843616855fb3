"""Sharding by histogram sort: splitters are refined from exact byte counts, then rows are exchanged once.

Rows are ordered by a 128-bit key: the hash of the key columns, then the hash of what tells equal keys apart. A round counts the exact bytes of all rows
between candidate boundaries (4096 to a bracket, combined in every partition before they are exchanged) and narrows the bracket of each
splitter that isn't within tolerance of its target yet. Rows of equal key columns stay in one shard unless they alone exceed the
tolerance; then the second half of the key cuts through them. DataFrame functions only.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS = 12  # of the key that a round looks at
ROUNDS = -(-128 // BITS)


def _digit(round_: int) -> Column:
    """The key's bits from 12 * round_ on; the halves are unsigned 64-bit numbers held in longs."""
    at = BITS * round_
    if at + BITS <= 64:
        return F.shiftrightunsigned("key_hi", 64 - at - BITS).bitwiseAND(2**BITS - 1)
    if at >= 64:
        left = 128 - at - BITS
        return (F.shiftrightunsigned("key_lo", left) if left >= 0 else F.shiftleft("key_lo", -left)).bitwiseAND(2**BITS - 1)
    low = at + BITS - 64
    return F.shiftleft(F.col("key_hi").bitwiseAND(2 ** (BITS - low) - 1), low).bitwiseOR(F.shiftrightunsigned("key_lo", 64 - low))


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[int]:
    """The shards - 1 boundaries as 128-bit numbers: rows whose key is below boundary k belong to shards 0 to k.

    `keys` holds key_hi, key_lo and size. Each boundary is exact to `tolerance` of a shard's mean size, or is
    an edge of the one row, or of the rows of one key, that its target falls into.
    The driver gets at most shards * 4096 sums a round, whatever the input.
    """
    prefix, total, found = {0: 0}, None, {}
    bracket = dict.fromkeys(range(1, shards), 0)  # splitter -> the bits that its key is known to begin with
    for round_ in range(ROUNDS):
        rows = keys
        above = F.lit(0).cast("long")
        if round_:
            wanted = F.lit(False)
            for n, p in enumerate(sorted(set(bracket.values()))):
                inside = _begins(p, BITS * round_)
                above, wanted = F.when(inside, F.lit(n).cast("long")).otherwise(above), wanted | inside
            rows = keys.where(wanted)
        sums = rows.groupBy(above.alias("bracket"), _digit(round_).alias("digit")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
        own: dict[int, list[tuple[int, int, int]]] = {}
        starts = sorted(set(bracket.values())) if round_ else [0]
        for r in sums:
            own.setdefault(starts[r["bracket"]], []).append((r["digit"], int(r["bytes"] or 0), int(r["rows"])))
        if total is None:
            total = sum(b for v in own.values() for _, b, _ in v)
            near = tolerance * total / shards
        nearer: dict[int, int] = {}
        below_of: dict[int, int] = {}
        for k, p in bracket.items():
            target, below, best = total * k / shards, prefix[p], None
            for digit, n, many in sorted(own.get(p, [])):
                edge = (p << BITS | digit) << 128 - BITS * (round_ + 1) if BITS * (round_ + 1) <= 128 else (p << BITS | digit) >> BITS * (round_ + 1) - 128
                for boundary, under in ((edge, below), (edge + (1 << max(0, 128 - BITS * (round_ + 1))), below + n)):
                    if best is None or abs(under - target) < abs(best[1] - target):
                        best = (boundary, under)
                if below <= target < below + n and many > 1:  # one row can't be cut
                    nearer[k], below_of[p << BITS | digit] = p << BITS | digit, below
                below += n
            if best is None or abs(best[1] - target) <= near or k not in nearer or round_ == ROUNDS - 1:
                found[k] = best[0] if best else 0
                nearer.pop(k, None)
        bracket, prefix = nearer, below_of
        if not bracket:
            break
    return [found[k] for k in range(1, shards)]


def _begins(prefix: int, bits: int) -> Column:
    """Whether a key begins with the `bits` bits of `prefix`."""
    if bits <= 64:
        return F.shiftrightunsigned("key_hi", 64 - bits) == F.lit(_signed(prefix, bits)).cast("long")
    low = bits - 64
    return (F.col("key_hi") == F.lit(_signed(prefix >> low, 64)).cast("long")) & (F.shiftrightunsigned("key_lo", 64 - low) == F.lit(_signed(prefix & (1 << low) - 1, low)).cast("long"))


def _signed(n: int, bits: int) -> int:
    return n - (1 << 64) if bits == 64 and n >= 1 << 63 else n


def _at_least(boundary: int) -> Column:
    """Whether a key is at or above a boundary; the top bit is flipped, so that signed comparison orders unsigned numbers."""
    if boundary >= 1 << 128:
        return F.lit(False)
    flip = 1 << 63
    hi, lo = (boundary >> 64) - flip, (boundary & (1 << 64) - 1) - flip
    own_hi, own_lo = F.col("key_hi").bitwiseXOR(F.lit(-flip).cast("long")), F.col("key_lo").bitwiseXOR(F.lit(-flip).cast("long"))
    return (own_hi > F.lit(hi).cast("long")) | ((own_hi == F.lit(hi).cast("long")) & (own_lo >= F.lit(lo).cast("long")))


def histogram_shards(df: DataFrame, key_cols: list[str], tie_cols: list[str], size_col: str, shards: int = 16, tolerance: float = 0.01, rows_a_slice: int = 200_000) -> DataFrame:
    """`df` with `shard` (0 to shards - 1, sizes near equal) and `slot` (gapless from 0 in each shard).

    Rows of equal `key_cols` (nulls are equal to each other) stay together unless they exceed the tolerance, a part of a shard's mean size. Rows that
    also agree in `tie_cols` are told apart by their place in the input. Null sizes count as none. An empty table stays empty. Columns of `df` named shard
    or slot give way to the results; all others stay, but for one named _place. Slots are numbered in slices of about `rows_a_slice` rows, so no shard passes through one task.
    """
    keyed = cut(
        df.withColumn("_place", F.monotonically_increasing_id()).select(
            F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),  # so that no column of `df` can meet one of these
            F.xxhash64(*key_cols).alias("key_hi"),
            F.xxhash64(*tie_cols, "_place").alias("key_lo"),
        )
    )
    edges = splitters(keyed.select("key_hi", "key_lo", F.coalesce(F.col(f"row.`{size_col}`"), F.lit(0)).cast("long").alias("size")), shards, tolerance)
    shard = sum((_at_least(e).cast("int") for e in edges), F.lit(0))
    slices = max(1, min(4096, -(-keyed.count() // (rows_a_slice * shards))) * 8)
    dealt = keyed.select("*", shard.alias("shard"), F.pmod(F.col("key_lo"), F.lit(slices)).cast("int").alias("part"))
    # offsets of the slices: shards * slices sums, at most 524,288 rows whatever the input
    sums = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("shard", "part").orderBy(F.col("key_hi"), F.col("key_lo"))
    numbered = dealt.withColumn("_n", F.row_number().over(inner) - 1)
    placed = numbered.join(F.broadcast(offsets) if shards * slices <= 10_000 else offsets, ["shard", "part"])
    return placed.select(*[F.col(f"row.`{c}`") for c in df.columns if c not in ("shard", "slot")], "shard", (F.col("_n") + F.col("offset")).cast("long").alias("slot"))
