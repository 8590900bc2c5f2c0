"""A Merkle manifest of a table: one leaf for each row, one subtree for each group, one root.

Where a leaf stands follows from rank queries on bitmaps, not from sorting. The ids of a group are
filed in containers of 65,536 numbers: every task compresses what it holds, a sorted list of 16-bit
numbers or the bits themselves, and the containers of all tasks are merged with a directory of
popcounts in front. The rank of an id is the number of rows in the containers before its own, from
sums over three levels of its leading bits, and the set bits before it inside. Ids that several rows
share carry their number of rows; different rows of one id are ranked by their leaves in the same way,
60 bits at a time, and equal rows stand side by side.

The tree is reduced in blocks: a task gets the nodes of one block under (group, block), puts each
into its slot of an array, and hashes some levels at once. The tops of the blocks are the nodes of
the next round. The way down again gives every block the path above it, and every leaf its proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywise.llm.common import stored

LOW = 16  # bits of a number inside its container
FEW = 4096  # numbers from which on a container holds bits
WORD = 64
BLOCK = 4096  # slots of a block at most
DIGITS = 15  # of a leaf, that make up a whole number


# ---------------------------------------------------------------------------
# Leaves
# ---------------------------------------------------------------------------


def field(c: Column) -> Column:
    """A value as part of a leaf: `-` for null, else its length in bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields one after the other."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def leaves(
    documents: DataFrame,
    fields: tuple[str, ...],
    id_col: str,
    group_col: str,
    changed: dict[str, Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """(g, doc_id, leaf, tampered, m): every distinct row and how often it comes.

    g sorts like the group by UTF-8 bytes, null first. `tampered` is the leaf of a row in which the
    `changed` values stand for the real ones, null where `where` does not hold.
    """
    own = [F.col(f"`{f}`") for f in fields]
    new = [(changed or {}).get(f, F.col(f"`{f}`")) for f in fields]
    group = F.col(f"`{group_col}`").cast("string")
    rows = documents.select(
        F.coalesce(F.concat(F.lit("+"), group), F.lit("")).alias("g"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.unhex(leaf(*own)).alias("leaf"),
        (F.when(where, F.unhex(leaf(*new))) if where is not None else F.lit(None).cast("binary")).alias("tampered"),
    )
    return rows.groupBy("g", "doc_id", "leaf", "tampered").agg(F.count(F.lit(1)).alias("m"))


# ---------------------------------------------------------------------------
# Bitmap ranks
# ---------------------------------------------------------------------------

CONTAINER = "part string, hi long, dense boolean, bits binary, many binary, extra binary"


def packed(low: np.ndarray, n: np.ndarray) -> tuple[bool, bytes, bytes, bytes]:
    """A container of distinct 16-bit numbers: (is dense, numbers, numbers of several rows, rows beyond the first)."""
    order = np.argsort(low, kind="stable")
    low, n = low[order], n[order]
    dense = len(low) >= FEW
    if dense:
        bits = np.zeros(1 << LOW, np.uint8)
        bits[low] = 1
        shown = np.packbits(bits, bitorder="little").tobytes()
    else:
        shown = low.astype("<u2").tobytes()
    several = n > 1
    return dense, shown, low[several].astype("<u2").tobytes(), (n[several] - 1).astype("<i8").tobytes()


def opened(dense: bool, bits: bytes, many: bytes, extra: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a container and how many rows each has."""
    if dense:
        low = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    else:
        low = np.frombuffer(bits, "<u2").astype(np.int64)
    n = np.ones(len(low), np.int64)
    n[np.searchsorted(low, np.frombuffer(many, "<u2"))] += np.frombuffer(extra, "<i8")
    return low, n


class Directory:
    """Rank queries on one container: bits, popcounts of the words before each word, and rows beyond the first."""

    def __init__(self, dense: bool, bits: bytes, many: bytes, extra: bytes):
        octets = np.frombuffer(bits, np.uint8)
        if not dense:
            flags = np.zeros(1 << LOW, np.uint8)
            flags[np.frombuffer(bits, "<u2")] = 1
            octets = np.packbits(flags, bitorder="little")
        self.words = octets.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.many = np.frombuffer(many, "<u2")
        self.extra = np.concatenate(([0], np.cumsum(np.frombuffer(extra, "<i8"))))

    def rank(self, low: np.ndarray) -> np.ndarray:
        """Rows of smaller numbers."""
        word, bit = low // WORD, (low % WORD).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below) + self.extra[np.searchsorted(self.many, low)]


def _compressed(keys: DataFrame) -> DataFrame:
    """Containers of the (part, key, n) that each task holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names, which = np.unique(np.array(batch.column("part").to_pylist(), object), return_inverse=True)
            key, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n"))
            hi, low = key >> LOW, key & ((1 << LOW) - 1)
            order = np.lexsort((low, hi, which))
            which, hi, low, n = which[order], hi[order], low[order], n[order]
            cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(hi) != 0)) + 1
            bounds = [0, *cuts.tolist(), len(hi)]
            rows = [(names[which[a]], int(hi[a]), *packed(low[a:b], n[a:b])) for a, b in zip(bounds, bounds[1:])]
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
            arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "hi", "dense", "bits", "many", "extra"])

    return keys.select("part", "key", "n").mapInArrow(run, CONTAINER)


def _merged(containers: DataFrame) -> DataFrame:
    """One container for each (part, hi); the tasks' containers have no number in common."""

    def run(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        rows = [opened(*r) for r in zip(*[held.column(c).to_pylist() for c in ("dense", "bits", "many", "extra")])]
        low, n = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        values = [key[0].as_py(), key[1].as_py(), *packed(low, n), int(n.sum())]
        kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.binary()] * 3, pa.int64()]
        names = ["part", "hi", "dense", "bits", "many", "extra", "rows"]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names)

    return containers.groupBy("part", "hi").applyInArrow(run, f"{CONTAINER}, rows long")


def bitmap_index(keys: DataFrame) -> DataFrame:
    """The containers of distinct (part, key) with n rows each, and the rows before each container.

    The rows before are added up over the leading bits: within the 2^32 numbers around a container,
    around those within 2^48, and around those within all. No window holds more than 65,536 rows.
    """
    merged = stored(_merged(_compressed(keys)))
    sums = merged.select("part", F.col("hi").alias("at"), "rows")
    before = merged.select(F.col("part").alias("of"), F.col("hi").alias("to"), F.lit(0).cast("long").alias("before"))
    for level in range(3):
        around = ["part"] if level == 2 else ["part", F.shiftright("at", LOW)]
        smaller = Window.partitionBy(*around).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        prefix = sums.select("part", "at", F.coalesce(F.sum("rows").over(smaller), F.lit(0)).alias("x"))
        inside = (F.col("of") == F.col("part")) & (F.shiftright("to", level * LOW) == F.col("at"))
        before = before.join(prefix, inside).select("of", "to", (F.col("before") + F.col("x")).alias("before"))
        sums = sums.groupBy("part", F.shiftright("at", LOW).alias("at")).agg(F.sum("rows").alias("rows"))
    same = (F.col("part") == F.col("of")) & (F.col("hi") == F.col("to"))
    return merged.join(before, same).drop("of", "to")


def ranks(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(part, key, before): the rows of smaller keys of the same part, for distinct (part, key)."""

    def run(held: pa.Table, container: pa.Table) -> pa.Table:
        key = held.column("key").to_numpy()
        (row,) = container.select(["dense", "bits", "many", "extra", "before"]).to_pylist()
        before = row.pop("before") + Directory(**row).rank(key & ((1 << LOW) - 1))
        return pa.table([held.column("part"), held.column("key"), pa.array(before)], ["part", "key", "before"])

    dealt = keys.select("part", "key", F.shiftright("key", LOW).alias("hi")).groupBy("part", "hi")
    return dealt.cogroup(index.groupBy("part", "hi")).applyInArrow(run, "part string, key long, before long")


def placed(rows: DataFrame) -> DataFrame:
    """The rows of `leaves` with their first position in the group: ids ascending, null first, then by leaf."""
    rows = rows.withColumns({"part": F.col("g"), "key": F.col("doc_id"), "pos": F.lit(0).cast("long")})
    done, chunk = None, 0
    while True:
        keys = stored(rows.groupBy("part", "key").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("d")))
        known = keys.where("key is not null")
        unknown = keys.where("key is null").select(F.col("part").alias("of"), F.col("n").alias("first"))
        found = ranks(known, bitmap_index(known)).join(unknown, F.col("part") == F.col("of"), "left")
        found = found.select("part", "key", (F.col("before") + F.coalesce("first", F.lit(0))).alias("x"))
        found = known.select("part", "key", "d").join(found, ["part", "key"]).select("part", "key", "d", "x")
        found = found.union(keys.where("key is null").select("part", "key", "d", F.lit(0).cast("long").alias("x")))
        found = found.withColumnsRenamed({"part": "of", "key": "to"})
        same = (F.col("part") == F.col("of")) & F.col("key").eqNullSafe(F.col("to"))
        rows = rows.join(found, same).withColumn("pos", F.col("pos") + F.col("x")).drop("of", "to", "x")
        rows = stored(rows)
        alone = rows.where("d = 1").select("g", "doc_id", "leaf", "tampered", "m", "pos")
        done = alone if done is None else done.union(alone)
        rest = rows.where("d > 1").drop("d")
        if rest.isEmpty():
            return done
        # rows of one id: a part of their own, ranked by the next digits of their leaves
        digits = F.substring(F.hex("leaf"), 1 + DIGITS * chunk, DIGITS)
        rest = rest.withColumn("part", F.concat_ws("/", "part", F.coalesce(F.col("key").cast("string"), F.lit("-"))))
        rows = rest.withColumn("key", F.conv(digits, 16, 10).cast("long"))
        chunk += 1


# ---------------------------------------------------------------------------
# Levels
# ---------------------------------------------------------------------------


def parent(run: list[bytes]) -> bytes:
    """Digest of the digests of a run, taken as hex text."""
    return hashlib.sha256("".join([d.hex() for d in run]).encode()).digest()


def levels_of(n: int, fan_out: int) -> int:
    """Levels above n nodes, until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan_out), levels + 1
    return levels


def levels_at_once(fan_out: int) -> int:
    """Levels that a block takes in one round."""
    levels, size = 1, fan_out
    while size * fan_out <= BLOCK:
        levels, size = levels + 1, size * fan_out
    return levels


def block_levels(slots: list[bytes], levels: int, fan_out: int) -> list[list[bytes]]:
    """The slot arrays of a block, level by level; the last holds its top."""
    found = [slots]
    for _ in range(levels):
        below = found[-1]
        found.append([parent(below[i : i + fan_out]) for i in range(0, len(below), fan_out)])
    return found


def path_inside(levels: list[list[bytes]], slot: int, fan_out: int) -> list[tuple[int, list[bytes]]]:
    """(place in its run, siblings of the run) at every level of a block."""
    path = []
    for below in levels[:-1]:
        first = slot // fan_out * fan_out
        run = below[first : first + fan_out]
        path.append((slot - first, run[: slot - first] + run[slot - first + 1 :]))
        slot //= fan_out
    return path


def shown_path(path: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(bytes([place, len(others)]) + b"".join(others) for place, others in path)


def read_path(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        at += 2
        yield place, [path[at + 32 * i : at + 32 * i + 32] for i in range(n)]
        at += 32 * n


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings on its way give."""
    for place, others in read_path(path):
        digest = parent([*others[:place], digest, *others[place:]])
    return digest


def proof(path: bytes) -> str:
    """Digest of all siblings on the way up."""
    return hashlib.sha256("".join([o.hex() for _, others in read_path(path) for o in others]).encode()).hexdigest()


def _slots(held: pa.Table, per_block: int) -> list[bytes]:
    """The digests of a block, each in its slot; a row of m equal leaves fills those of its positions in the block."""
    slots: dict[int, bytes] = dict(zip((held.column("pos").to_numpy() % per_block).tolist(), held.column("digest").to_pylist()))
    if len(slots) != held.num_rows or max(slots) != held.num_rows - 1:
        raise ValueError("a position without a node, or with two")
    return [slots[i] for i in range(len(slots))]


def _dealt(nodes: DataFrame, per_block: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(per_block)).cast("long"))


def _tops(nodes: DataFrame, fan_out: int) -> DataFrame:
    """The nodes of the next round."""
    at_once = levels_at_once(fan_out)
    per_block = fan_out**at_once

    def run(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        n = held.column("n")[0].as_py()
        slots = _slots(held, per_block)
        top = block_levels(slots, min(at_once, levels_of(n, fan_out)), fan_out)[-1]
        values = [key[0].as_py(), key[1].as_py(), top[0], -(-n // per_block)]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64()]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], ["g", "pos", "digest", "n"])

    schema = "g string, pos long, digest binary, n long"
    return _dealt(nodes, per_block).groupBy("g", "block").applyInArrow(run, schema)


def rounds(nodes: DataFrame, fan_out: int) -> list[DataFrame]:
    """The nodes (g, pos, digest, n) of each round, two rounds at least; the last has one for each group."""
    found = [nodes, stored(_tops(nodes, fan_out))]
    while (found[-1].agg(F.max("n")).first()[0] or 1) > 1:
        found.append(stored(_tops(found[-1], fan_out)))
    return found


def with_paths(nodes: DataFrame, above: DataFrame, fan_out: int, outcome: str = "path") -> DataFrame:
    """The nodes of a round with the paths that lead from them to the top.

    `above` has (g, pos, path) of the next round's nodes. With outcome `path` come (g, pos, path),
    with `checked` (g, doc_id, leaf, proof_sha256, folded_root): the root that `tampered`, else the leaf gives.
    """
    at_once = levels_at_once(fan_out)
    per_block = fan_out**at_once
    check = outcome == "checked"

    def run(held: pa.Table, top: pa.Table) -> pa.Table:
        n = held.column("n")[0].as_py()
        levels = block_levels(_slots(held, per_block), min(at_once, levels_of(n, fan_out)), fan_out)
        rest = top.column("path")[0].as_py()
        positions = held.column("pos").to_pylist()
        paths = [shown_path(path_inside(levels, p % per_block, fan_out)) + rest for p in positions]
        if not check:
            return pa.table([held.column("g"), held.column("pos"), pa.array(paths, pa.binary())], ["g", "pos", "path"])
        digests, tampered = held.column("digest").to_pylist(), held.column("tampered").to_pylist()
        roots = [folded(d if t is None else t, p).hex() for d, t, p in zip(digests, tampered, paths)]
        shown = [pa.array(x, pa.string()) for x in ([d.hex() for d in digests], list(map(proof, paths)), roots)]
        names = ["g", "doc_id", "leaf", "proof_sha256", "folded_root"]
        return pa.table([held.column("g"), held.column("doc_id"), *shown], names)

    checked = "doc_id long, leaf string, proof_sha256 string, folded_root string"
    schema = f"g string, {checked}" if check else "g string, pos long, path binary"
    below = _dealt(nodes, per_block).groupBy("g", "block")
    return below.cogroup(above.select("g", F.col("pos").alias("block"), "path").groupBy("g", "block")).applyInArrow(run, schema)


# ---------------------------------------------------------------------------
# The manifest
# ---------------------------------------------------------------------------


def _in_order(groups: DataFrame) -> DataFrame:
    """(g, digest) with pos, their place by g. Range partitions; one row for each partition is added up."""
    dealt = groups.repartitionByRange("g").sortWithinPartitions("g").withColumn("at", F.monotonically_increasing_id())
    dealt = stored(dealt)
    part = F.shiftright("at", 33)
    sizes = dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("p", F.coalesce(before, F.lit(0)).alias("first"))
    placed_at = dealt.join(sizes, part == F.col("p"))
    return placed_at.withColumn("pos", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).select("g", "digest", "pos")


@dataclass
class Manifest:
    """leaves: (g, doc_id, pos, digest, tampered, n); subroots: (g, digest, pos); root: (root), one row or none."""

    leaves: DataFrame
    subroots: DataFrame
    root: DataFrame
    rounds: list[DataFrame]
    upper: list[DataFrame]
    fan_out: int

    def checked(self) -> DataFrame:
        """(g, doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each leaf."""
        path = self.upper[-1].select("g", "pos", F.lit(b"").alias("path"))
        for nodes in reversed(self.upper[:-1]):
            path = stored(with_paths(nodes, path, self.fan_out))
        path = path.select(F.col("pos").alias("to"), "path")
        above = self.subroots.join(path, F.col("pos") == F.col("to")).select("g", F.lit(0).cast("long").alias("pos"), "path")
        for nodes in reversed(self.rounds[1:-1]):
            above = stored(with_paths(nodes, above, self.fan_out))
        found = with_paths(self.rounds[0], above, self.fan_out, "checked")
        subroots = self.subroots.select("g", F.lower(F.hex("digest")).alias("subroot"))
        rows = found.join(subroots, "g").withColumn("root", self.root.scalar())
        return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(rows: DataFrame, fan_out: int = 2) -> Manifest:
    """The tree over the rows of `leaves`: ids ascending in each group, groups by their bytes, null first."""
    if fan_out < 2 or fan_out > 255:
        raise ValueError("a run has 2 to 255 nodes")
    own = placed(stored(rows))
    sizes = own.groupBy("g").agg(F.sum("m").alias("n"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("copy")
    nodes = own.select("g", "doc_id", "leaf", "tampered", "pos", copies).join(sizes, "g")
    nodes = stored(
        nodes.select("g", "doc_id", (F.col("pos") + F.col("copy")).alias("pos"), F.col("leaf").alias("digest"), "tampered", "n")
    )
    lower = rounds(nodes, fan_out)
    subroots = stored(_in_order(lower[-1].select("g", "digest")))
    n = subroots.count()
    top = subroots.select(F.lit("").alias("g"), "pos", "digest", F.lit(n).cast("long").alias("n"))
    upper = rounds(top, fan_out)
    root = upper[-1].select(F.lower(F.hex("digest")).alias("root"))
    return Manifest(nodes, subroots, root, lower, upper, fan_out)
