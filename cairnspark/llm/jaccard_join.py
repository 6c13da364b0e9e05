"""N-gram Jaccard join: exact links of word-shingle sets, found by signature trees."""

from __future__ import annotations

import hashlib
import heapq
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, map_arrow, slices, spread_by_class
from .components import connected_components, hot_keys, starred

SHINGLE = 3
PERCENT = 90  # two sets link when 100 * intersection >= PERCENT * union
SPARE = 3
#: For sets that differ in so many shingles at the most: how many of all parts (and those that many more) are signed together.
TOGETHER = {2: 3, 3: 3, 4: 2, 5: 2, 6: 2}
SLICE_BYTES = 4_000_000
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixing generator, value by value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hashes of words, kept for those met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, known: WordHash) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; a shorter text is one shingle, a wordless one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return mixed(np.array([(h * np.array([A, B][: len(h)])).sum() + np.uint64(len(h))]))
    return np.unique(mixed(h[:-2] * A + mixed(h[1:-1] * B + mixed(h[2:] * C))))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def bands(most: int) -> np.ndarray:
    """Least sizes of size bands: sets that link are in one band or in neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // PERCENT + 1)
    return np.array([*out, out[-1] * 100 // PERCENT + 1, out[-1] * 2], np.int64)


def differ_most(n: int, m: int) -> int:
    """How many shingles at most are in one of two sets of these sizes that link, and not in the other."""
    return n + m - 2 * -(-PERCENT * (n + m) // (100 + PERCENT))


def part_signatures(sets: list[np.ndarray], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of different sets such that sets that link share one: (set number, signature).

    What of a set is signed should be so much that unrelated sets hardly share it.  D is the most that sets of two
    neighbouring size bands that link can differ in.

    * D = 1: one set is the other without one shingle, so the smaller one signs itself and the larger one itself
      without each of its shingles in turn.  Sets of two sizes that can differ in nothing are one class anyway.
    * D from 2 to 6: shingles are dealt by hash into D + k parts (k from TOGETHER), of which k at least are the same
      in both; every k parts are signed together.
    * Larger D: shingles are dealt into D + 1 + spare parts, each signed alone; spare + 1 at least are the same.  A
      part of at most two shingles is light; a set leaves its light parts out if there are no more than spare of
      them, since then a part that is not light remains.
    """
    size = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    least = bands(int(size.max(initial=1)))
    band = np.searchsorted(least, size, "right") - 1
    owner = np.repeat(np.arange(len(sets)), size)
    start = np.cumsum(size) - size
    salt = mixed(np.array([seed], np.uint64) * B + C)[0]
    spread, added = mixed(tokens ^ A ^ salt), mixed(tokens + B)
    owners, found = [], []

    def put(of: np.ndarray, total: np.ndarray, low: np.ndarray, number: np.ndarray) -> None:
        owners.append(of)
        found.append(mixed(total + mixed(low.astype(np.uint64) * C + number.astype(np.uint64) + salt)))

    whole = np.zeros(len(sets), np.uint64)
    np.add.at(whole, owner, added)
    differs = (least[1:-1] + least[2:] - 2) * (100 - PERCENT) // (100 + PERCENT)  # D by the lower band
    alone = [n for n in range(1, int(least[np.searchsorted(differs, 2)])) if 100 * n >= PERCENT * (n + 1) and differ_most(n, n + 1) == 1]
    of = np.flatnonzero(np.isin(size, alone))
    put(of, whole[of], -size[of], np.zeros(len(of)))
    on = np.flatnonzero(np.isin(size, np.array(alone, np.int64) + 1)[owner])
    put(owner[on], whole[owner[on]] - added[on], 1 - size[owner[on]], np.zeros(len(on)))

    for group in (band, band - 1):
        used = (group >= 0) & (size > 0)
        low = np.where(used, group, 0)
        differ = differs[low]
        for most, together in TOGETHER.items():
            of = np.flatnonzero(used & (differ == most))
            if not len(of):
                continue
            parts, row = most + together, np.full(len(sets), -1, np.int64)
            row[of] = np.arange(len(of))
            on = row[owner] >= 0
            total = np.zeros(len(of) * parts, np.uint64)
            np.add.at(total, row[owner[on]] * parts + (spread[on] % np.uint64(parts)).astype(np.int64), added[on])
            choice = np.array(list(itertools.combinations(range(parts), together)))
            total = total.reshape(-1, parts)[:, choice].sum(2, dtype=np.uint64)
            put(np.repeat(of, len(choice)), total.ravel(), np.repeat(low[of], len(choice)), np.tile(np.arange(len(choice)), len(of)))
        used &= differ > max(TOGETHER)
        spare = SPARE + differ // 50
        parts = np.where(used, differ + 1 + spare, 0)
        base = np.cumsum(parts) - parts
        on = used[owner]
        which = base[owner[on]] + (spread[on] % np.maximum(parts, 1).astype(np.uint64)[owner[on]]).astype(np.int64)
        total = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(total, which, added[on])
        light = np.bincount(which, minlength=len(total)) <= 2
        of = np.repeat(np.arange(len(sets)), parts)
        few = np.bincount(of, weights=light, minlength=len(sets)) <= spare
        keep = ~(light & few[of])
        put(of[keep], total[keep], low[of[keep]], (np.arange(len(total)) - base[of])[keep])
    return np.concatenate(owners), np.concatenate(found)


@dataclass
class Forest:
    """Union-find over the sets of a tree."""

    parent: np.ndarray

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = int(self.parent[k])
        return k

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
            self.parent = up
        return self.parent


def enough(n: np.ndarray, m: np.ndarray, common: np.ndarray) -> np.ndarray:
    return 100 * common >= PERCENT * (n + m - common)


class SignatureTree:
    """Sets under nodes of FANOUT children.  A node holds the OR of its bitmaps and the range of its set sizes.

    A shingle sets one bit.  ``extra`` is how many more shingles than bits a set has at most under a node; sets
    under nodes X and Y share at most popcount(X AND Y) + min(extra) shingles, and no more than the smaller has.
    """

    FANOUT = 8

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets], np.int64)
        width = 1 << max(6, int(4 * size.max(initial=1) - 1).bit_length())
        words = width // 64
        least = np.array([int(mixed(s ^ C).min()) if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((size, least))  # sets that link mostly have one least hash, so they stand together
        bits = np.zeros((len(sets), words), np.uint64)
        for row, k in enumerate(self.order):
            bit = sets[k] % np.uint64(width)
            np.bitwise_or.at(bits[row], (bit // np.uint64(64)).astype(np.int64), np.uint64(1) << (bit % np.uint64(64)))
        size = size[self.order]
        extra = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, extra)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, extra = self.levels[-1]
            at = np.arange(0, len(bits), self.FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the largest possible overlap of two nodes can reach a link between sets below them."""
        bits, low, high, extra = self.levels[level]
        out = (100 * high[a] >= PERCENT * low[b]) & (100 * high[b] >= PERCENT * low[a])
        near = np.flatnonzero(out)
        step = max(1, 4_000_000 // bits.shape[1])
        for k in range(0, len(near), step):
            at = near[k : k + step]
            x, y = a[at], b[at]
            most = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64) + np.minimum(extra[x], extra[y])
            most = np.minimum(most, np.minimum(high[x], high[y]))
            out[at] = enough(low[x], low[y], most)
        return out

    def same_component(self, level: int, roots: np.ndarray) -> np.ndarray:
        """For each node the root that all sets below it have, or -1."""
        low = high = roots[self.order]
        for _ in range(level):
            at = np.arange(0, len(low), self.FANOUT)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
        return np.where(low == high, low, -1)


def link_sets(sets: list[np.ndarray], label: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Components by dual traversal of one tree: (root, member) for every set but the roots, which are the first of theirs.

    Sets with one ``label`` are joined already.  With ``side`` given, only pairs of different sides are looked at.
    """
    if len(sets) < 2:
        return []
    forest = Forest(np.arange(len(sets)))
    if label is not None:
        _, first, number = np.unique(label, return_index=True, return_inverse=True)
        forest.parent = first[number]
    tree = SignatureTree(sets)
    order, size = tree.order, np.array([len(s) for s in sets])

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(order[a].tolist(), order[b].tolist(), strict=True):
            if forest.root(x) != forest.root(y) and (side is None or side[x] != side[y]):
                if enough(size[x], size[y], len(np.intersect1d(sets[x], sets[y], assume_unique=True))):
                    forest.join(x, y)

    near = np.arange(len(sets) - 1)
    good = tree.may_link(0, near, near + 1)
    settle(near[good], near[good] + 1)  # neighbours first: most of a family of near copies is one component then
    top = len(tree.levels) - 1
    work = [(top, 0, np.zeros(1, np.int64), np.zeros(1, np.int64))]  # lowest level first, which keeps the list short
    count = 1
    while work:
        level, _, a, b = heapq.heappop(work)
        if level == 0:
            a, b = a[a != b], b[a != b]
        at = tree.same_component(level, forest.roots())
        open_ = (at[a] < 0) | (at[a] != at[b])
        a, b = a[open_], b[open_]
        good = tree.may_link(level, a, b)
        a, b = a[good], b[good]
        if level == 0:
            settle(a, b)
            continue
        n = len(tree.levels[level - 1][0])
        x = np.repeat(a * tree.FANOUT, tree.FANOUT**2) + np.tile(np.repeat(np.arange(tree.FANOUT), tree.FANOUT), len(a))
        y = np.repeat(b * tree.FANOUT, tree.FANOUT**2) + np.tile(np.tile(np.arange(tree.FANOUT), tree.FANOUT), len(b))
        keep = (x < n) & (y < n) & (x <= y)
        x, y = x[keep], y[keep]
        for k in range(0, len(x), 4096):
            heapq.heappush(work, (level - 1, count, x[k : k + 4096], y[k : k + 4096]))
            count += 1
    return [(int(r), k) for k, r in enumerate(forest.roots()) if r != k]


# Distributed part.

BLOCK_SETS, BLOCK_SHINGLES = 256, 1_000_000
PAIR_SETS, PAIR_SHINGLES = 1000, 2_000_000  # of blocks that are compared with each other
MANY_BLOCKS = 16  # a group of more such blocks is signed again first


def set_table(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, n, class (the set's digest), node (its first 64 bits) and signatures of docs(doc_id, text); its other columns follow.

    Signatures stand at the first row of each set in a slice of rows; other rows of it have none.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches):
        known = WordHash()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sets = [shingle_set(t.as_py(), known) for t in part.column("text")]
                marks = [digest(s) for s in sets]
                first = {m: k for k, m in reversed(list(enumerate(marks)))}
                chosen = [k for k, m in enumerate(marks) if len(sets[k]) and first[m] == k]
                owner, found = part_signatures([sets[k] for k in chosen], seed)
                order = np.argsort(owner, kind="stable")
                count = np.zeros(len(sets) + 1, np.int64)
                count[np.array(chosen, np.int64) + 1] = np.bincount(owner, minlength=len(chosen))
                signatures = pa.ListArray.from_arrays(pa.array(np.cumsum(count), pa.int32()), pa.array(found[order].view(np.int64)))
                nodes = pa.array([int.from_bytes(m[:8], "big", signed=True) for m in marks], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), nodes, signatures, *(part.column(c) for c in others)], ["doc_id", "n", "class", "node", "signatures", *others])

    kinds = dict(docs.dtypes)
    return map_arrow(docs, run, ", ".join([f"doc_id {kinds['doc_id']}, n long, class binary, node long, signatures array<long>", *(f"`{c}` {kinds[c]}" for c in others)]))


def candidate_groups(sets: DataFrame) -> DataFrame:
    """node, root for the nodes of a set_table that share signatures, directly or by others; a root is its own."""
    rows = sets.select(F.explode("signatures").alias("u"), F.col("node").alias("v"))
    groups = connected_components(durable(starred(rows, "siblings", [u for u, _ in hot_keys(rows)])))
    return groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())


def grouped_components(rows: DataFrame) -> DataFrame:
    """Components within each group of rows(group, class, label, side, text): class and root of all but the roots.

    A group fits in memory; rows of its task stream by.
    """

    def run(batches):
        known = WordHash()
        group, held = None, []

        def settle():
            if len(held) < 2:
                return None
            built = [(h, shingle_set(h[3], known)) for h in held]
            unique = {h[0]: (h, s) for h, s in built if digest(s) == h[0]}  # an id may stand for other texts too
            sets = [s for _, s in unique.values()]
            unique = {m: h for m, (h, _) in unique.items()}
            marks = list(unique)
            if len(marks) < 2:
                return None
            label, side = (None if unique[marks[0]][k] is None else np.array([unique[m][k] for m in marks]) for k in (1, 2))
            links = link_sets(sets, label, side)
            return pa.RecordBatch.from_arrays([pa.array([marks[k] for _, k in links], pa.binary()), pa.array([marks[r] for r, _ in links], pa.binary())], ["class", "root"]) if links else None

        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group:
                    if (out := settle()) is not None:
                        yield out
                    group, held = row["group"], []
                held.append((row["class"], row["label"], row["side"], row["text"]))
        if (out := settle()) is not None:
            yield out

    return map_arrow(rows.repartition("group").sortWithinPartitions("group"), run, "class binary, root binary")


def with_group_values(rows: DataFrame, hot_share: float, **values) -> DataFrame:
    """``rows`` with aggregates over their ``group``; groups of at least ``hot_share`` of all rows aren't shuffled.

    Those are at most 1 / hot_share, so their values are broadcast and their rows stay where they are.
    """
    of_group = durable(rows.groupBy("group").agg(F.count("*").alias("_rows"), *(v.alias(k) for k, v in values.items())))
    total = of_group.agg(F.sum("_rows")).first()[0] or 0
    hot = of_group.where(F.col("_rows") >= max(2.0, total * hot_share)).select("group")
    return spread_by_class(rows, of_group.drop("_rows"), "group", hot)


def set_components(docs: DataFrame, wide: DataFrame, hot_share: float) -> DataFrame:
    """class, root for the classes of docs(doc_id, text) that may link with another; ``wide`` is its set_table.

    1. Signatures bring sets that may link together; their stars give candidate groups.
    2. One text of each class goes to its group.  A group is cut into blocks of bounded size, each a signature tree
       that is traversed against itself.  A group of one block is done.
    3. Groups of several blocks: the roots of all blocks meet; groups that are whole then are done.  Sets of the
       others are signed again with parts dealt by another hash: groups that chance had joined fall apart, and each
       group that both signings agree on is traversed, all pairs of its blocks if it has several, passing over node
       pairs of one component.  (Groups of MANY_BLOCKS blocks or fewer are traversed without that second signing.)
    """
    groups = candidate_groups(wide)
    classes = wide.where("n > 0").groupBy("class", "node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    chosen = durable(classes.join(groups, "node").select("class", "doc_id", "n", F.col("root").alias("group")))

    def blocked(rows: DataFrame, sets: int, shingles: int) -> DataFrame:
        blocks = F.greatest(F.ceil(F.count("*") / sets), F.ceil(F.sum("n") / shingles))
        return with_group_values(rows, hot_share, blocks=blocks).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))

    def place(block: str, other) -> list:
        return ["doc_id", "class", F.struct("group", F.col(block).alias("block"), other.cast("long").alias("other")).alias("group")]

    alone = [F.lit(None).cast("binary").alias("label"), F.lit(None).cast("long").alias("side")]

    def relabelled(rows: DataFrame, found: DataFrame) -> DataFrame:
        """``rows`` with the root of their label, where it has one, as label."""
        roots = found.select(F.col("class").alias("label"), F.col("root").alias("_root"))
        return rows.join(roots, "label", "left").withColumn("label", F.coalesce("_root", "label")).drop("_root")

    chosen = blocked(chosen, BLOCK_SETS, BLOCK_SHINGLES)
    texts = durable(chosen.select("doc_id").distinct().join(docs, "doc_id"))
    found = grouped_components(chosen.select(*place("block", F.lit(-1)), *alone).join(texts, "doc_id"))
    now = durable(relabelled(chosen.withColumn("label", F.col("class")), found))
    out = now.where("blocks = 1").select("class", F.col("label").alias("root"))
    large = now.where("blocks > 1")
    if large.isEmpty():
        return out

    heads = large.where(F.col("class") == F.col("label"))
    meets = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES))
    heads = with_group_values(heads, hot_share, meets=meets).withColumn("meet", F.pmod(F.xxhash64("class", F.lit(1)), F.col("meets")))
    large = durable(relabelled(large, grouped_components(heads.select(*place("meet", F.lit(-2)), *alone).join(texts, "doc_id"))))
    left = with_group_values(large, hot_share, split=F.min("label") != F.max("label")).where("split").select("class", "doc_id", "n", "label", "group")
    if left.isEmpty():
        return out.unionByName(large.select("class", F.col("label").alias("root")))
    left = durable(blocked(left, PAIR_SETS, PAIR_SHINGLES))
    columns = ["class", "doc_id", "n", "label", "blocks", "block"]
    far = left.where(F.col("blocks") > MANY_BLOCKS).select("class", "doc_id", "n", "label", "group")
    left = left.where(F.col("blocks") <= MANY_BLOCKS).select(*columns, F.struct("group", F.lit(None).cast("long").alias("root")).alias("group"))
    if not far.isEmpty():
        again = candidate_groups(durable(set_table(far.select("doc_id").distinct().join(texts, "doc_id"), seed=1)))
        far = far.withColumn("node", F.conv(F.hex(F.substring("class", 1, 8)), 16, -10).cast("long")).join(again, "node")
        far = blocked(far.select("class", "doc_id", "n", "label", F.struct("group", "root").alias("group")), PAIR_SETS, PAIR_SHINGLES)
        left = left.unionByName(durable(far.select(*columns, "group")))
    pairs = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "side": F.when(F.col("block") != F.col("other"), F.col("block"))})
    joined = grouped_components(pairs.select(*place("low", F.col("high")), "label", "side").join(texts, "doc_id"))
    edges = joined.select(F.col("root").alias("a"), F.col("class").alias("b")).unionByName(large.select(F.col("label").alias("a"), F.col("class").alias("b")))
    roots = connected_components(durable(edges)).withColumnRenamed("node", "class")
    return out.unionByName(large.select("class").join(roots, "class", "left").select("class", F.coalesce("root", "class").alias("root")))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = 0.001) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Words are what white space parts, after lower-casing A-Z; a set is the distinct shingles of SHINGLE words, taken
    as 64-bit hashes.  Rows with one set are one class (by 128-bit digest); links are found between classes and are
    exact on the sets.  component_id is the least doc_id that links reach.

    A text without words, or null, has no shingles, links with nothing, and is its own component.  Null ids never
    name a component; a class that has no other ids links with nothing and has a null component_id.  Repeated rows
    give a row each; an empty table gives none.  Other
    columns are ignored.
    """
    return joined(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), hot_share)


def joined(rows: DataFrame, hot_share: float = 0.001) -> DataFrame:
    """The Jaccard join of rows(doc_id, text), whose other columns are carried along."""
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    wide = durable(set_table(rows))
    sets = durable(wide.drop("signatures"))
    roots = set_components(rows.select("doc_id", "text"), wide, hot_share)
    members = sets.where("n > 0")
    total = members.count()
    hot = lambda frame, key: frame.groupBy(key).count().where(F.col("count") >= max(2.0, total * hot_share)).select(key)
    least = members.groupBy("class").agg(F.min("doc_id").alias("least"))
    linked = durable(roots.join(least, "class"))
    by_root = durable(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    by_class = spread_by_class(linked, by_root, "root", durable(hot(linked, "root"))).select("class", "component_id")
    alone = least.join(by_class, "class", "left_anti").select("class", F.col("least").alias("component_id"))
    by_class = durable(by_class.unionByName(alone))
    out = spread_by_class(members, by_class, "class", durable(hot(members, "class"))).select("doc_id", F.col("n").alias("n_shingles"), "component_id", *others)
    return out.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *others))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of its component_id, with all its own columns, whatever their names.

    A row goes by its id and text, so an id that stands on several texts can lose one and keep another.  Rows with a
    null id all stay, as do repeated rows of an id that stays.
    """
    mark = F.unhex(F.sha2(F.col(text_col).cast("string"), 256))
    drop_id, drop_mark = fresh(docs.columns, "cairn_drop_id", "cairn_drop_mark")
    found = joined(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), mark.alias("mark")))
    dropped = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(drop_id), F.col("mark").alias(drop_mark))
    return docs.join(dropped, (F.col(id_col) == F.col(drop_id)) & (mark == F.col(drop_mark)), "left_anti")


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda k: array_to_string(list_slice(w, k, k + {SHINGLE - 1}), ' ')))) END AS sh FROM d),
c AS (SELECT row_number() OVER () AS c, sh, len(sh) AS n, min(doc_id) AS least FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT c, n, unnest(sh) AS x FROM c),
l AS (SELECT a.c AS a, b.c AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.c <> b.c AND 100 * a.n >= {PERCENT} * b.n AND 100 * b.n >= {PERCENT} * a.n
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
k AS (SELECT reach.a AS c, min(c.least) AS component_id FROM reach JOIN c ON reach.b = c.c GROUP BY reach.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE k.component_id END AS component_id
FROM s LEFT JOIN c ON s.sh = c.sh LEFT JOIN k ON c.c = k.c
"""
