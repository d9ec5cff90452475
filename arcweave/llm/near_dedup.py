"""MinHash near-dedup with an LSH forest.

1. A text's words give its set of five-word shingles (64-bit hashes). Equal sets
   are one node, named by a digest; a node's label is its smallest doc_id.
2. Each node has a MinHash signature. Every tree of the forest is one sorted
   order of the nodes, by its own run of the signature's values: the orders are
   range-partitioned as one table, so a prefix that very many texts share is
   spread over tasks instead of filling one. Rows at a partition's ends also meet
   those of the next partition.
3. In such an order the longest common prefix with a row falls with the distance
   from it. Each node looks at the next NEIGHBOURS ones that share DEPTH values, at
   twice as many that share one more, and so on up to whole keys: in sparse regions
   that is everything at the smallest depth, in dense ones the depth rises with the
   region. A neighbour counts if the sketches agree well enough for the similarity
   to be in reach.
4. Nodes of regions that are denser at DEPTH than NEIGHBOURS are sorted again, by
   CROWDED further orders made of other values of their signatures.
5. Candidate links make families (connected components). A chain of candidates
   is enough to bring two texts into one family, so no list of partners is cut.
6. Families of one block are compared in full. In larger ones the candidate links
   are confirmed first; then each node outside the largest confirmed part is
   compared with all others, in blocks, each pair of blocks a group of its own.
   A group returns a spanning forest of its links, never all pairs.
7. Connected components of the confirmed links are the result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.common import SPACED_WORD, ascii_lower, broadcast_if_small, joined_by_key, small_batches, stored, table, whole_rows
from arcweave.operators.components import stars

SHINGLE, PERCENT = 5, 75
#: Trees, signature values of each, and values that neighbours must share at least. At similarity s and depth 2 a pair shares no tree with probability (1 - s*s)**TREES: 5e-5 at 0.75.
TREES, VALUES, DEPTH = 12, 8, 2
NEIGHBOURS = 24
#: Further orders for nodes of crowded regions, and rows of an order that are looked at together.
CROWDED, TOGETHER = 24, 8192
#: Bytes of a sketch, and how many must agree: 0.75 agree on the mean, with a standard deviation of 0.054.
SKETCH, AGREE = 64, 35
#: Sets compared at once, and their shingles (8 bytes each) on the mean.
BLOCK, BLOCK_SHINGLES = 256, 4_000_000
#: Words that a worker remembers.
MEMO = 100_000

_word = re.compile(SPACED_WORD)
_powers = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(16)], dtype=np.uint64)
_random = np.random.default_rng(20_240_601)
_mul = (_random.integers(0, 1 << 32, TREES * VALUES, dtype=np.uint32) | np.uint32(1))[:, None]
_add = _random.integers(0, 1 << 32, TREES * VALUES, dtype=np.uint32)[:, None]


class Shingler:
    def __init__(self, memo: int = MEMO) -> None:
        self.memo, self.known = memo, {}

    def of(self, text: str | None, width: int = SHINGLE) -> np.ndarray:
        """The sorted distinct shingle hashes of a text; the whole sequence as one for fewer words than ``width``; none without words."""
        words = _word.findall(ascii_lower(text))
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        new = {w for w in words if w not in known}
        if len(known) + len(new) > self.memo:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(width, len(h))
        out = np.full(len(h) - n + 1, n * 0xD6E8FEB86659FD93 % (1 << 64), dtype=np.uint64)
        for k in range(n):
            part = (h[k : len(h) - n + 1 + k] ^ (h[k : len(h) - n + 1 + k] >> np.uint64(32))) * _powers[2 * k]
            out += part ^ (part >> np.uint64(29))
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> np.uint64(27)))


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(shingles: np.ndarray, block: int = 4096) -> np.ndarray:
    """MinHash values (unsigned 32-bit), least over blocks, so that memory doesn't grow with a text."""
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    out = None
    for k in range(0, len(low), block):
        part = low[None, k : k + block] * _mul + _add
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x85EBCA6B)
        part ^= part >> np.uint32(13)
        least = part.min(axis=1)
        out = least if out is None else np.minimum(out, least)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, tk (hash of its text), n_shingles, node, sig; node and sig are null for texts without words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            sets = [shingler.of(t) for t in b.column("text").to_pylist()]
            nodes = [node_of(s) if len(s) else None for s in sets]
            sigs = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tk"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "tk", "n_shingles", "node", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tk long, n_shingles long, node long, sig binary")


def find(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def shared_values(keys: np.ndarray) -> np.ndarray:
    """Of each row and the next one: how many of the tree's leading values are equal (-1: another tree). A key is the tree's number and VALUES values of 4 bytes."""
    same = keys[1:] == keys[:-1]
    values = same[:, 1:].reshape(len(same), (keys.shape[1] - 1) // 4, 4).all(axis=2)
    return np.where(same[:, 0], np.logical_and.accumulate(values, axis=1).sum(axis=1), -1)


def reach(depth: int) -> int:
    """How many places apart rows that share so many values are still neighbours."""
    return NEIGHBOURS << depth - DEPTH


def neighbour_links(keys: np.ndarray, nodes: np.ndarray, sketches: np.ndarray, seen: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b) between sorted rows and the crowded rows' nodes; of the first ``seen`` rows, pairs among themselves are left out.

    A row is linked with those of the next ones that share enough values for their distance and agree in AGREE sketch bytes. Of each set of linked rows only a spanning forest is returned: first of the best agreeing pairs up to NEIGHBOURS places apart, then of pairs that it leaves apart. A row is crowded if it is in a region of DEPTH that goes beyond NEIGHBOURS rows."""
    n = len(nodes)
    crowded, found, label = np.zeros(n, dtype=bool), [], np.arange(n)
    first = shared_values(keys)
    rows, shared, edges = np.arange(max(0, n - 1)), first, []
    depth, step = DEPTH, 0

    def agreeing(at: np.ndarray) -> Iterator[np.ndarray]:
        """(row, later row, agreement) of rows whose sketch is near enough to that ``step`` places later."""
        at = at[at + step >= seen]
        for k in range(0, len(at), 8192):
            part = at[k : k + 8192]
            agree = (sketches[part] == sketches[part + step]).sum(axis=1)
            good = agree >= AGREE
            yield np.stack([part[good], part[good] + step, agree[good]])

    def linked(pairs: np.ndarray) -> None:
        for x, y, _ in pairs.T.tolist():
            low, high = sorted((label[x], label[y]))
            if low != high:
                label[label == high] = low
                found.append((x, y))

    while len(rows):
        step += 1
        if step > reach(depth):
            depth += 1
            if depth > VALUES:
                break
        inside = rows + step < n
        rows, shared = rows[inside], shared[inside]
        shared = np.minimum(shared, first[rows + step - 1])
        deep = shared >= depth
        rows, shared = rows[deep], shared[deep]
        if step <= NEIGHBOURS:
            edges += agreeing(rows)
        if step == NEIGHBOURS:
            for k in range(NEIGHBOURS + 1):
                crowded[rows + k] = True
        if edges and (step == NEIGHBOURS or not len(rows)):
            best = np.concatenate(edges, axis=1)
            parent = list(range(n))
            order = np.argsort(-best[2], kind="stable")
            for k in range(0, len(order), 8192):
                for x, y in best[:2, order[k : k + 8192]].T.tolist():
                    rx, ry = find(parent, x), find(parent, y)
                    if rx != ry:
                        parent[max(rx, ry)] = min(rx, ry)
                        found.append((x, y))
            label, edges = np.array([find(parent, k) for k in range(n)]), []
        if step > NEIGHBOURS:
            for pairs in agreeing(rows[label[rows] != label[rows + step]]):
                linked(pairs)
    a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
    return nodes[a], nodes[b], nodes[crowded]


def tree_values(trees: int, offset: int) -> list[list[int]]:
    """Which values of the signature each tree sorts by: runs of them, then (offset > 0) others picked by steps, so that no two trees begin alike."""
    total = TREES * VALUES
    if not offset:
        return [list(range(t * VALUES, (t + 1) * VALUES)) for t in range(trees)]
    return [[(t * 5 + k * (7 + 2 * (t % 9)) + offset) % total for k in range(VALUES)] for t in range(trees)]


LINK, NODE, BORDER = 0, 1, 2


def sorted_links(nodes: DataFrame, values: list[list[int]], what: str) -> DataFrame:
    """Stored (kind, a, b) from nodes (node, sig): candidate links, and crowded nodes (a), over one sorted order a tree."""
    pick = lambda t: F.concat(F.lit(bytes([t])), *(F.substring("sig", 4 * k + 1, 4) for k in values[t]))
    if values == tree_values(len(values), 0):
        pick = lambda t: F.concat(F.lit(bytes([t])), F.substring("sig", t * 4 * VALUES + 1, 4 * VALUES))
    keys = F.when(F.col("tree") == 0, pick(0))
    for t in range(1, len(values)):
        keys = keys.when(F.col("tree") == t, pick(t))
    small = F.concat(*(F.substring("sig", 4 * k + 1, 1) for k in range(SKETCH)))
    orders = nodes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(len(values) - 1))).alias("tree"))
    ordered = orders.select(keys.alias("key"), "node", small.alias("sketch")).repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.binary()), ("sketch", pa.binary())])

    def rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none], schema=schema)

    def ends(part: int, held: tuple) -> pa.RecordBatch:
        """Rows that also meet the neighbouring partition's: ``b`` is the border's number."""
        keys, ids, sketches = held
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), BORDER, np.int32)), pa.array(ids, pa.int64()), pa.array(np.full(len(ids), part, np.int64)), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([x.tobytes() for x in sketches], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, head, seen = TaskContext.get().partitionId(), None, 0, 0

        def blocks() -> Iterator[tuple]:
            """Rows as (keys, nodes, sketches), TOGETHER or more at once."""
            group, n = [], 0
            for batch in batches:
                if batch.num_rows:
                    group.append(batch)
                    n += batch.num_rows
                if n >= TOGETHER:
                    yield arrays(group, n)
                    group, n = [], 0
            if n:
                yield arrays(group, n)

        def arrays(group: list[pa.RecordBatch], n: int) -> tuple:
            key, sketch = (np.frombuffer(b"".join(x for g in group for x in g.column(c).to_pylist()), dtype=np.uint8).reshape(n, -1) for c in ("key", "sketch"))
            return key, np.concatenate([g.column("node").to_numpy(zero_copy_only=False) for g in group]), sketch

        for now in blocks():
            if head < NEIGHBOURS and part:  # the first rows of a partition stand at the border before it
                yield ends(part - 1, tuple(x[: NEIGHBOURS - head] for x in now))
                head += min(len(now[1]), NEIGHBOURS - head)
            if held is not None:  # the last rows of the block before meet those of this one
                seen = len(held[1])
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            a, b, crowded = neighbour_links(*now, seen)
            yield rows(LINK, a, b)
            yield rows(NODE, crowded, crowded)
            held = tuple(x[-reach(VALUES) :] for x in now)
        if held is not None:
            yield ends(part, tuple(x[-NEIGHBOURS:] for x in held))

    found = stored(ordered.mapInArrow(run, "kind int, a long, b long, key binary, sketch binary"), what)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "a"])
        keys, sketches = (np.frombuffer(b"".join(frame[c]), dtype=np.uint8).reshape(len(frame), -1) for c in ("key", "sketch"))
        a, b, _ = neighbour_links(keys, frame["a"].to_numpy(), sketches)
        return pd.DataFrame({"kind": np.zeros(len(a), np.int32), "a": a, "b": b})

    # A border has 2 * NEIGHBOURS rows at most.
    borders = found.where(F.col("kind") == BORDER).groupBy("b").applyInPandas(meet, "kind int, a long, b long")
    return found.where(F.col("kind") != BORDER).select("kind", "a", "b").unionByName(borders)


def forest_links(nodes: DataFrame) -> DataFrame:
    """Stored candidate links (a, b) between nodes (node, sig): neighbours in each tree's order, and in further orders those of crowded regions."""
    found = sorted_links(nodes, tree_values(TREES, 0), "forest")
    links = found.where(F.col("kind") == LINK).select("a", "b")
    crowded = stored(found.where(F.col("kind") == NODE).select(F.col("a").alias("node")).distinct(), "crowded")
    if not crowded.isEmpty():
        again = sorted_links(nodes.join(crowded, "node"), tree_values(CROWDED, 1), "crowded-forest")
        links = links.unionByName(again.where(F.col("kind") == LINK).select("a", "b"))
    return stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")


def set_links(sets: list[np.ndarray], left: int | None = None) -> list[tuple[int, int]]:
    """Pairs of sets with 100 * intersection >= PERCENT * union, as a spanning forest; with ``left``, only pairs of one of the first ``left`` sets and one of the others.

    Intersections come from postings: for each set, the sets that hold each of its elements are counted."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if len(sets) < 2:
        return []
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(at, kind="stable")
    holders, ends = owner[order], np.cumsum(np.bincount(at))
    starts = ends - np.bincount(at)
    parent, out, begins = list(range(len(sets))), [], np.cumsum(sizes) - sizes
    for k in range(len(sets) if left is None else left):
        mine = at[begins[k] : begins[k] + sizes[k]]
        lengths = ends[mine] - starts[mine]
        total = int(lengths.sum())
        index = np.repeat(starts[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        both = np.bincount(holders[index], minlength=len(sets))
        linked = np.flatnonzero(100 * both >= PERCENT * (sizes + sizes[k] - both))
        for j in linked[linked >= left] if left is not None else linked[linked > k]:
            a, b = find(parent, k), find(parent, int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((k, int(j)))
    return out


def family_sets(members: DataFrame, docs: DataFrame, n_members: int) -> DataFrame:
    """Stored (node, root, blocks, shingles) of members (node, root, doc_id, tk, n_shingles): a node stands for the text of its first document, read again from docs. Blocks: into how many its family is dealt."""
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("n"))
    key = lambda df: df.withColumns({"none": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}).drop("doc_id")
    wanted = key(joined_by_key(members, sizes, ["root"], "n", n_members).select("node", "root", "blocks", "doc_id", "tk"))
    texts = key(docs.select("doc_id", F.xxhash64("text").alias("tk"), F.col("text").cast("string").alias("text")))
    small_batches(docs.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            found = [shingler.of(t) for t in b.column("text").to_pylist()]
            keep = [k for k, (s, n) in enumerate(zip(found, b.column("node").to_pylist(), strict=True)) if node_of(s) == n]
            part = b.take(pa.array(keep, pa.int64())).drop_columns(["text"])
            yield part.append_column("shingles", pa.array([found[k].tobytes() for k in keep], pa.binary()))

    joined = broadcast_if_small(texts, wanted, ["none", "id", "tk"], n_members)
    return stored(joined.select("node", "root", "blocks", "text").mapInArrow(sets, "node long, root long, blocks int, shingles binary"), "family-sets")


def small_family_links(held: DataFrame) -> DataFrame:
    """Confirmed links (a, b) of families of one block; many share a task, so that there are not as many Python calls as families."""

    def compare_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, nodes, own = None, [], []

        def linked() -> pa.RecordBatch:
            links = set_links(own)
            return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in links], pa.int64()), pa.array([nodes[y] for _, y in links], pa.int64())], names=["a", "b"])

        for b in batches:
            for r, n, s in zip(b.column("root").to_pylist(), b.column("node").to_pylist(), b.column("shingles").to_pylist(), strict=True):
                if r != root:
                    if len(own) > 1:
                        yield linked()
                    root, nodes, own = r, [], []
                if not nodes or nodes[-1] != n:
                    nodes.append(n)
                    own.append(np.frombuffer(s, dtype=np.uint64))
        if len(own) > 1:
            yield linked()

    return held.select("root", "node", "shingles").repartition("root").sortWithinPartitions("root", "node").mapInArrow(compare_sorted, "a long, b long")


def confirmed_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) are linked; each pair's two sets meet by joins, so a node of many pairs is no group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def large_family_links(held: DataFrame, candidates: DataFrame) -> DataFrame:
    """Confirmed links (a, b) of families of several blocks: candidate links first; then nodes outside a family's largest confirmed part (its core) meet all others of the family."""
    sets = held.dropDuplicates(["node"])
    names = sets.select("node", "root")
    pairs = candidates.join(names.select(F.col("node").alias("a")), "a", "left_semi")
    first = stored(confirmed_pairs(pairs, sets.select("node", "shingles")), "confirmed-candidates")
    part = names.join(stars(first, "parts").withColumnsRenamed({"u": "node", "root": "part"}), "node", "left").withColumn("part", F.coalesce("part", "node"))
    part = stored(part, "family-parts")
    core = part.groupBy("root", "part").agg(F.count("*").alias("n")).groupBy("root").agg(F.max(F.struct("n", "part")).alias("c"), F.sum("n").alias("total"))
    core = core.select("root", F.col("c.part").alias("core"), F.col("c.n").alias("n_core"), (F.col("total") - F.col("c.n")).alias("n_loose"), "total")
    placed = joined_by_key(part.select("node", "root", "part"), core, ["root"], "total", part.count())
    labelled = sets.drop("root").join(placed, "node").withColumn("loose", F.col("part") != F.col("core"))
    # Blocks of loose nodes come first; those of the core are numbered after them.
    share = F.col("blocks") / (F.col("n_core") + F.col("n_loose"))
    of = {n: F.greatest(F.ceil(F.col(f"n_{n}") * share), F.lit(1)).cast("int") for n in ("core", "loose")}
    hashed = F.xxhash64("node")
    block = F.when(F.col("loose"), F.pmod(hashed, of["loose"].cast("long"))).otherwise(of["loose"] + F.pmod(hashed, of["core"].cast("long"))).cast("int")
    dealt = labelled.where("n_loose > 0").select("root", "node", "shingles", "loose", of["loose"].alias("n_loose_blocks"), (of["loose"] + of["core"]).alias("n_blocks"), block.alias("block"))
    # A loose block meets every block, a core block the loose ones only.
    others = F.when(F.col("loose"), F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("n_loose_blocks") - 1))
    groups = dealt.select("root", "node", "shingles", "block", F.explode(others).alias("o")).select("root", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "shingles")

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node").sort_values(["block", "node"])
        nodes = frame["node"].to_numpy()
        own = [np.frombuffer(x, dtype=np.uint64) for x in frame["shingles"]]
        left = int((frame["block"] == key[1]).sum()) if key[1] != key[2] else None
        links = set_links(own, left)
        return pd.DataFrame({"a": [nodes[x] for x, _ in links], "b": [nodes[y] for _, y in links]}, dtype="int64")

    return first.unionByName(groups.groupBy("root", "i", "j").applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, tk (hash of its text), n_shingles (long), node, component_id (long), kept (boolean).

    Null, empty and blank texts have no shingles and are linked with nothing (component_id is their own doc_id). A null doc_id never names a component; such a row gets its component's id, or null if all its rows lack one, and is not kept. Repeated rows are each kept if their id is the component's. A text is held as a whole, with its set, one at a time; sets of a family are bounded by blocks. Other columns of ``docs`` are ignored."""
    rows = stored(signed(docs), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk"))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(first.alias("f"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("copies"))
    nodes = stored(nodes.select("node", "f.doc_id", "f.tk", "sig", "n_shingles", "copies"), "nodes")
    candidates = forest_links(nodes.select("node", "sig"))
    families = stars(candidates, "families")
    in_family = families.select(F.col("u").alias("node"), "root").union(families.select("root", "root")).distinct()
    members = stored(in_family.join(nodes.select("node", "doc_id", "tk", "n_shingles"), "node"), "members")
    held = family_sets(members, docs, members.count())
    links = small_family_links(held.where("blocks = 1"))
    large = held.where("blocks > 1")
    if not large.isEmpty():
        links = links.unionByName(large_family_links(large, candidates))
    confirmed = stars(links, "links")
    linked = confirmed.select(F.col("u").alias("node"), "root").union(confirmed.select("root", "root")).distinct()
    named = stored(linked.join(nodes.select("node", "doc_id"), "node"), "linked")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    label = joined_by_key(named.select("node", "root"), least, ["root"], "n", named.count()).select("node", "component_id")
    label = stored(nodes.select("node", "copies", F.col("doc_id").alias("own")).join(label, "node", "left").select("node", "copies", F.coalesce("component_id", "own").alias("component_id")), "labels")
    rows = rows.drop("sig")
    out = joined_by_key(rows.where("node IS NOT NULL"), label, ["node"], "copies", rows.count())
    out = out.unionByName(rows.where("node IS NULL").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "tk", "n_shingles", "node", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, with its own columns: the row of the smallest doc_id. Documents without words, and groups without any id, stay as they are. Of repeated rows (equal id and text) one stays, too. No rows give none."""
    key = ["none", "id", "tk"]
    named = lambda df: df.withColumns({"none": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    stays = F.col("kept") | F.col("node").isNull() | F.col("component_id").isNull()
    decided = named(near_duplicates(docs)).withColumn("stays", stays).groupBy(*key).agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    # Few documents go or are repeated: only their keys are joined, and without them no text is shuffled.
    odd = stored(decided.where("NOT stays OR n > 1").select(*key, "stays"), "duplicates")
    n = odd.count()
    rows = whole_rows(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("tk"))
    rows = named(rows).drop("doc_id")
    once = broadcast_if_small(rows, odd.select(*key), key, n, "left_anti").select("row.*")
    again = odd.where("stays").select(*key)
    return once if again.isEmpty() else once.unionByName(broadcast_if_small(rows, again, key, n).dropDuplicates(key).select("row.*"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, generate_subscripts(ws, 1) AS k, unnest(ws) AS x FROM d WHERE len(ws) >= 5),
five AS (SELECT r, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY k)),
sh AS (SELECT DISTINCT r, g FROM five WHERE g IS NOT NULL UNION ALL SELECT r, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
both_sets AS (SELECT a.r AS r1, b.r AS r2, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT r1, r2 FROM both_sets JOIN n a ON a.r = r1 JOIN n b ON b.r = r2 WHERE 100 * i >= 75 * (a.n + b.n - i)),
e AS (SELECT r1 AS a, r2 AS b FROM links UNION SELECT r2, r1 FROM links),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT reach.a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""
QUERIES = {"op6_near_duplicates": op6_near_duplicates}
ORACLE_SQL = {"op6_near_duplicates": OP6_SQL}
