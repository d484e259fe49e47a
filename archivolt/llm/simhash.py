"""SimHash near-duplicates by a grid over segment popcounts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.common import scratch, unused
from archivolt.llm.components import components, root

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 for no words."""
    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, len(shingles), 1 << 16):
        h = np.array([digest(s, SEED) for s in shingles[start : start + (1 << 16)]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], dtype=np.uint64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("th"), pa.array(prints.view(np.int64))], names=["doc_id", "th", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, th, fp) of every document: a hash of its text, and the fingerprint as a signed long."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_fingerprints(words), "doc_id long, th long, fp long")


FIVES = np.uint64(0x5555555555555555)
ONE = np.uint64(1)


def embed(fp: np.ndarray) -> np.ndarray:
    """Popcounts of the 32 segments of two bits, each written in unary in its segment.

    0, 1 and 2 become 00, 01 and 11. The Manhattan distance of two count
    vectors is then the number of differing bits of their codes, and never
    more than the number of differing bits of the fingerprints.
    """
    pair = fp >> ONE
    return ((fp | pair) & FIVES) | ((fp & pair & FIVES) << ONE)


def axes(distance: int) -> list[tuple[int, ...]]:
    """Segments dealt to the three groups that span the grids."""
    groups = max(1, min(32, distance // 2 + 1))
    return [tuple(range(g, 32, groups)) for g in range(groups)]


def _grid(distance: int):
    """Rows of the grids: each fingerprint in its own cell and, as a visitor, in the cells next to it.

    Segments fall into distance // 2 + 1 groups, so fingerprints within the
    distance are at Manhattan distance 1 or less in one group at least. In that
    group they share a cell or are in neighbouring cells of one axis; the one
    with the smaller count there visits the other's cell.
    """
    groups = axes(distance)
    masks = [np.uint64(sum(3 << (2 * s) for s in g)) for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = np.asarray(batch.column("fp")), np.asarray(batch.column("node"))
            code = embed(fp.view(np.uint64))
            out: list[tuple] = []
            for g, (segments, mask) in enumerate(zip(groups, masks, strict=True)):
                cell = code & mask
                out.append((np.full(len(fp), g), cell, np.zeros(len(fp), bool), fp, rep))
                for s in segments:
                    low = (cell >> np.uint64(2 * s)) & np.uint64(3)
                    up = low < 3
                    bit = np.where(low == 0, np.uint64(1 << (2 * s)), np.uint64(2 << (2 * s)))
                    out.append((np.full(int(up.sum()), g), (cell | bit)[up], np.ones(int(up.sum()), bool), fp[up], rep[up]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.record_batch(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1].view(np.int64)), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4])],
                names=["grid", "cell", "visitor", "fp", "node"],
            )

    return run


PAIRS = 1 << 17  # held at a time; in a tight group all of them are within the distance


def links(home: np.ndarray, home_node: np.ndarray, other: np.ndarray, other_node: np.ndarray, within: bool, possible, distance: int) -> list[tuple[int, int]]:
    """Edges between a cell's own fingerprints and others, thinned to a forest.

    Fingerprints are rows of 64-bit words. `possible` is a lower bound on their
    distances and excludes most pairs; those it leaves are verified. Edges that
    join what is joined already are left out, so a cell sends fewer edges than
    it has rows.
    """
    every = np.concatenate([home_node, other_node])
    parent = list(range(len(every)))
    base, edges = len(home), []
    if within:
        other, base = np.concatenate([home, other]), 0
    step = max(1, PAIRS // max(1, len(home)))
    for start in range(0, len(other), step):
        part = other[start : start + step]
        at, to = np.nonzero(possible(part, home))
        sure = np.bitwise_count(part[at] ^ home[to]).sum(axis=1, dtype=np.int64) <= distance
        at, to = at[sure] + start + base, to[sure]
        keep = at != to
        for a, b in zip(at[keep].tolist(), to[keep].tolist(), strict=True):
            x, y = root(parent, a), root(parent, b)
            if x != y:
                parent[x] = y
                edges.append((int(every[a]), int(every[b])))
    return edges


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays without repeats; two empty ones are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 1.0


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start up to its end."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def similar_edges(sets: list[np.ndarray], first: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Edges (i, j) that connect all sets of a Jaccard similarity, thinned to a forest.

    Sets that similar share an element among the rarest n - ceil(s n) + 1 of
    each, in one order of all elements, so only sets that meet there are
    compared, and of these only pairs that nothing joins yet. With `first`, a
    set of one side is compared with those of the other side alone. Empty sets
    are alike.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, element, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    order = np.lexsort((element, count[element], owner))
    begin = np.cumsum(sizes) - sizes
    prefix = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-6).astype(np.int64) + 1, 0)
    taken = order[ranges(begin, begin + prefix)]
    shared = taken[count[element[taken]] > 1]
    posting = shared[np.lexsort((owner[shared], element[shared]))]
    keys, members = element[posting], owner[posting]
    mine = np.searchsorted(owner[shared], np.arange(len(sets) + 1))  # shared is in order of owners
    low, high = np.searchsorted(keys, element[shared]), np.searchsorted(keys, element[shared], "right")
    label, edges = np.arange(len(sets)), []
    none = np.flatnonzero(sizes == 0)
    for i in range(len(sets)):
        of = slice(mine[i], mine[i + 1])
        met = np.unique(members[ranges(low[of], high[of])]) if sizes[i] else none
        met = met[met < i]
        ok = (label[met] != label[i]) & (np.minimum(sizes[met], sizes[i]) >= similarity * np.maximum(sizes[met], sizes[i]) - 1e-6)
        if first is not None:
            ok &= first[met] != first[i]
        for j in met[ok].tolist():
            if label[j] != label[i] and jaccard(sets[j], sets[i]) >= similarity:
                label[label == label[j]] = label[i]
                edges.append((j, i))
    return edges


def _verified(similarity: float):
    """Edges of similar texts of a pair of blocks; rows (node, shingle_set) come sorted by pair."""

    def flush(rows: list[tuple]) -> list[tuple[int, int]]:
        own, node = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        sets = [np.frombuffer(x, dtype="<u8") for r in rows for x in r[2]]
        return [(int(node[i]), int(node[j])) for i, j in similar_edges(sets, None if rows[0][3] else own, similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("cell", "home_block", "other_block")])
            own, node, sets = batch.column("own").to_numpy(zero_copy_only=False), np.asarray(batch.column("node")), batch.column("shingle_set").to_pylist()
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            edges: list[tuple[int, int]] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)], strict=True):
                key = tuple(keys[:, a].tolist())
                if key != last and held:
                    edges += flush(held)
                    held = []
                last = key
                held.append((own[a:b], node[a:b], sets[a:b], key[1] == key[2]))
            if edges:
                yield _edges(edges)
        if held and (edges := flush(held)):
            yield _edges(edges)

    return run


def _cells(words: tuple[str, ...], possible, distance: int):
    """Stream over rows sorted by block; hold one pair of blocks at a time."""

    def flush(rows: list[tuple]) -> list[tuple[int, int]]:
        own, visitor, fp, node = (np.concatenate([r[i] for r in rows]) for i in range(4))
        home, other = own & ~visitor, ~own | visitor
        if len(fp) < 2 or not home.any():
            return []
        return links(fp[home], node[home], fp[other], node[other], rows[0][4], possible, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("grid", "cell", "home_block", "other_block")])
            own = batch.column("own").to_numpy(zero_copy_only=False)
            visitor = batch.column("visitor").to_numpy(zero_copy_only=False)
            fp = np.stack([np.asarray(batch.column(c)) for c in words], axis=1).view(np.uint64)
            node = np.asarray(batch.column("node"))
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            edges: list[tuple[int, int]] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                key = tuple(keys[:, a].tolist())
                if key != last and held:
                    edges += flush(held)
                    held = []
                last = key
                held.append((own[a:b], visitor[a:b], fp[a:b], node[a:b], key[2] == key[3]))
            if edges:
                yield _edges(edges)
        if held and (edges := flush(held)):
            yield _edges(edges)

    return run


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True)
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])


def in_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows of cells (grid, cell, visitor, node ...) dealt so that no cell has to fit into one task.

    A cell of more than block_rows rows is dealt by a hash into blocks, and
    each pair of its blocks is a group of its own: homes of the first block
    meet all rows of the second. Cells in which nothing can link are left out.
    """
    columns = rows.columns
    size = rows.groupBy("grid", "cell").agg(F.count("*").alias("size"), F.bool_or(~F.col("visitor")).alias("homes"))
    useful = scratch(size.where("homes and size > 1").select("grid", "cell", F.ceil(F.col("size") / block_rows).cast("int").alias("parts")), "cells")
    joined = rows.join(useful, ["grid", "cell"])
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    as_home = F.when(~F.col("visitor"), F.transform(each, lambda j: F.struct(own.alias("home_block"), j.alias("other_block"), F.lit(True).alias("own"))))
    as_other = F.transform(F.filter(each, lambda i: i != own), lambda i: F.struct(i.alias("home_block"), own.alias("other_block"), F.lit(False).alias("own")))
    as_visitor = F.when(F.col("visitor"), F.array(F.struct(own.alias("home_block"), own.alias("other_block"), F.lit(True).alias("own"))))
    none = F.array().cast("array<struct<home_block:int,other_block:int,own:boolean>>")
    places = F.concat(F.coalesce(as_home, none), as_other, F.coalesce(as_visitor, none))
    dealt = joined.select("*", F.explode(places).alias("p")).select(*columns, "p.home_block", "p.other_block", "p.own")
    keys = ["grid", "cell", "home_block", "other_block"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys)


def near_links(nodes: DataFrame, distance: int = 4, block_rows: int = 16384) -> DataFrame:
    """Edges (u, v) that connect all fingerprints within the distance; nodes has fp and node (long), each fp once.

    No nodes, or none within the distance of another, give no edges.
    """
    rows = scratch(nodes.select("fp", "node").mapInArrow(_grid(distance), "grid int, cell long, visitor boolean, fp long, node long"), "grid")
    exclude = lambda a, b: np.bitwise_count(embed(a[:, 0])[:, None] ^ embed(b[:, 0])[None, :]) <= distance
    return in_blocks(rows, block_rows).mapInArrow(_cells(("fp",), exclude, distance), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, th, fp, component_id, label) for every document, component_id the smallest doc_id reachable.

    label is the component's smallest fingerprint, th a hash of the text.

    Documents of one fingerprint are one node, so copies make no pairs. Texts
    that are null or have no words have fingerprint 0 and link like any other.
    Repeated doc_ids are kept as separate rows of one node each; rows without a
    doc_id keep a null doc_id and count for links, not for component_id. Other
    columns of docs are not read. An empty table gives an empty result.
    """
    prints = scratch(fingerprints(docs, words), "fingerprints")
    nodes = scratch(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest")).withColumn("node", F.col("fp")), "nodes")
    found = components(near_links(nodes, distance))
    labelled = nodes.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.groupBy("label").agg(F.min("smallest").alias("component_id"))
    member = scratch(labelled.join(smallest, "label").select("fp", "component_id", "label"), "members")
    return prints.join(member, "fp").select("doc_id", "th", "fp", "component_id", "label")


LANES = ("f0", "f1", "f2", "f3")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Hashes of a text's different word shingles in ascending order; none for no words."""
    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    count = max(1, len(parts) - words + 1)
    return np.unique(np.fromiter((digest(b" ".join(parts[i : i + words]), SEED) for i in range(count)), np.uint64, count))


def wide_fingerprint(text: str | None, words: int = 5) -> tuple[np.ndarray, int]:
    """256-bit SimHash of a text's different shingles, and their number; zeros and 0 for no words."""
    shingles = shingle_set(text, words)
    ones = np.zeros((len(LANES), 64), dtype=np.int64)
    for start in range(0, len(shingles), 1 << 15):
        h = shingles[start : start + (1 << 15)]
        for k, odd in enumerate(_ODD):
            x = (h ^ (h >> np.uint64(29))) * odd
            x ^= x >> np.uint64(32)
            ones[k] += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(shingles), axis=1, bitorder="little").view("<u8")[:, 0], len(shingles)


def _wide(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(t.as_py(), words) for t in batch.column("text")]
            lanes = np.array([f for f, _ in found], dtype=np.uint64).reshape(-1, len(LANES)).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("th"), *[pa.array(lanes[:, k]) for k in range(len(LANES))], pa.array([n for _, n in found], pa.int32())], names=["doc_id", "th", *LANES, "shingles"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words).astype("<u8").tobytes() for t in batch.column("text")]
            yield pa.record_batch([batch.column("node"), batch.column("cell"), pa.array(sets, pa.binary())], names=["node", "cell", "shingle_set"])

    return run


SMALL = 1.25
SET_ROWS = 1024  # of a block that holds shingles
GRIDS = 72
AXES = 11  # segments whose bit counts make a cell
SPAN = 3.0  # of a cell on the axis of shingle counts, in factors of the similarity
FEW = 64  # rows of a cell that are compared shift by shift


def grid_axes() -> tuple[np.ndarray, np.ndarray]:
    """Masks of the segments that span each grid, one word a lane, and where its axis of counts starts.

    Segments are single bits here: counts of wider ones agree too rarely
    between texts of a similarity of 0.8 (README.md has the figures).
    """
    random = np.random.default_rng(23)
    masks = np.zeros((GRIDS, len(LANES)), np.uint64)
    for g in range(len(masks)):
        for s in random.choice(64 * len(LANES), AXES, replace=False).tolist():
            masks[g, s // 64] |= np.uint64(1 << (s % 64))
    return masks, random.uniform(0, SPAN, len(masks))


def _cells_of_texts(similarity: float, with_prints: bool):
    """A row for each text and grid: the cell of its segments' bit counts and of its number of shingles."""
    masks, offsets = grid_axes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in range(len(masks)):
                fp = np.stack([np.asarray(batch.column(c)) for c in LANES], axis=1).view(np.uint64)
                n = np.asarray(batch.column("shingles"))
                span = np.where(n > 0, np.floor((np.log(np.maximum(n, 1)) / -np.log(similarity) + offsets[g]) / SPAN), -1)
                key = span.astype(np.int64).view(np.uint64) * _ODD[1] + np.array([g], np.uint64) * _ODD[2]
                for lane in range(len(LANES)):
                    key = (key ^ (key >> np.uint64(31)) ^ (fp[:, lane] & masks[g, lane])) * _ODD[lane]
                cells = [pa.array((key ^ (key >> np.uint64(32))).view(np.int64))]
                yield pa.record_batch(cells + batch.columns if with_prints else cells, names=["cell", *(batch.schema.names if with_prints else ())])

    return run


WITHIN, FIRST, SECOND = 0, 1, 2


def in_pairs_of_blocks(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Rows of cells (cell, node, shingles ...) sorted by cell, those of a large cell dealt to pairs of blocks.

    large has the cells that are dealt and their number of blocks (parts). A
    row of block i goes to the pair {i, j} for each block j, so every two rows
    of a cell meet and no cell has to fit into one task. info holds the number
    of shingles and the side that the row takes in its pair.
    """
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    side = lambda j: F.when(own == j, WITHIN).when(own < j, FIRST).otherwise(SECOND)
    pair = lambda j: F.struct(F.xxhash64("cell", F.least(own, j), F.greatest(own, j)).alias("cell"), side(j).alias("side"))
    alone = F.array(F.struct("cell", F.lit(WITHIN).alias("side")))
    places = F.when(F.col("parts").isNull(), alone).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pair))
    dealt = rows.join(large, "cell", "left").select("node", *LANES, "shingles", F.explode(places).alias("p"))
    packed = dealt.select("p.cell", "node", *LANES, (F.col("shingles").cast("long") * 4 + F.col("p.side")).alias("info"))
    return packed.repartition("cell").sortWithinPartitions("cell")


def _link_cells(distance: int, similarity: float):
    """Edges from the smallest node of each component of a cell to the others.

    Of two texts first the numbers of shingles, then the Manhattan distance of
    the counts of two-bit segments, a lower bound, and last the bits decide.
    """

    def near(x: np.ndarray, y: np.ndarray, rows: dict) -> np.ndarray:
        n, side = rows["shingles"], rows["side"]
        ok = np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-6
        ok &= (side[x] == WITHIN) | (side[x] != side[y])
        x, y = (np.broadcast_to(v, ok.shape)[ok] for v in (x, y))
        close = np.bitwise_count(rows["code"][x] ^ rows["code"][y]).sum(axis=1, dtype=np.int64) <= distance
        close[close] = np.bitwise_count(rows["fp"][x[close]] ^ rows["fp"][y[close]]).sum(axis=1, dtype=np.int64) <= distance
        ok[ok] = close
        return ok

    def flush(cell: np.ndarray, rows: dict) -> list[tuple[int, int]]:
        starts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(cell)]]))
        rows["code"], rows["side"], rows["shingles"] = embed(rows["fp"]), rows["info"] & 3, rows["info"] >> 2
        node, edges = rows["node"], []
        last = np.repeat(starts + sizes, sizes)  # the end of each row's cell
        at = np.flatnonzero(np.repeat(sizes, sizes) <= FEW)
        parent: dict[int, int] = {}

        def star(rows: list[int]) -> None:
            """Edges from the smallest node, so that grids in which the same texts meet send the same edges."""
            least = int(node[rows].min())
            edges.extend((least, v) for v in node[rows].tolist() if v != least)

        for shift in range(1, FEW):
            at = at[at + shift < last[at]]
            if not len(at):
                break
            met = at[near(at, at + shift, rows)]
            for a in met.tolist():
                x, y = root(parent, parent.setdefault(a, a)), root(parent, parent.setdefault(a + shift, a + shift))
                parent[x] = y
        groups: dict[int, list[int]] = {}
        for a in parent:
            groups.setdefault(root(parent, a), []).append(a)
        for rows_ in groups.values():
            star(rows_)
        for start, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            left = np.arange(start, start + size)
            while len(left):  # rows reached leave, so a tight group costs one pass
                reached, left = [int(left[0])], left[1:]
                for a in reached:
                    met = near(np.array([a]), left, rows)
                    reached += left[met].tolist()
                    left = left[~met]
                star(reached)
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def joined() -> dict:
            return {c: np.concatenate([r[c] for r in held]) for c in held[0]}

        def found(rows: dict) -> Iterator[pa.RecordBatch]:
            if edges := flush(rows.pop("cell"), rows):
                yield _edges(edges)

        for batch in batches:
            if not len(batch):
                continue
            rows = {c: np.asarray(batch.column(c)) for c in ("cell", "node", "info")}
            rows["fp"] = np.stack([np.asarray(batch.column(c)) for c in LANES], axis=1).view(np.uint64)
            held.append(rows)
            if rows["cell"][-1] == held[0]["cell"][0]:
                continue  # still one cell
            rows = joined()
            cut = int(np.searchsorted(rows["cell"], rows["cell"][-1]))
            held = [{c: v[cut:] for c, v in rows.items()}]
            yield from found({c: v[:cut] for c, v in rows.items()})
        if held:
            yield from found(joined())

    return run


def possible_links(nodes: DataFrame, similarity: float, block_rows: int) -> DataFrame:
    """Edges (u, v) that connect what may be similar; nodes has node, the lanes and the number of shingles.

    Each grid takes the bit counts of AXES segments and the logarithm of the
    number of shingles as axes; texts that meet in a cell of any grid and whose
    bit counts, and then bits, lie within the bound are joined. At a similarity
    of 0.8 two texts share a cell of one grid with a probability of about 0.13,
    and so of one of 72 with 0.9999. README.md has
    the measured shares. Cells of more than block_rows rows are dealt to pairs
    of blocks.
    """
    angle = min(0.5, SMALL * np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = 64 * len(LANES)
    distance = int(bits * angle + 4 * np.sqrt(bits * angle * (1 - angle)))
    nodes = nodes.select("node", *LANES, "shingles")
    counted = nodes.mapInArrow(_cells_of_texts(similarity, False), "cell long").groupBy("cell").count().where(F.col("count") > block_rows)
    large = scratch(counted.select("cell", F.ceil(F.col("count") / block_rows).cast("int").alias("parts")), "cells")
    rows = nodes.mapInArrow(_cells_of_texts(similarity, True), "cell long, node long, " + ", ".join(f"{c} long" for c in LANES) + ", shingles int")
    return in_pairs_of_blocks(rows, large).mapInArrow(_link_cells(distance, similarity), "u long, v long")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, block_rows: int = 8192) -> DataFrame:
    """(doc_id, th, label) of every document; label is the same throughout a group of near-duplicates.

    Two texts link if the Jaccard similarity of their different shingles is
    `similarity` or more. Pairs to verify come from 256-bit fingerprints of the
    shingles, by grids over their segment popcounts (`possible_links`): the
    angle between texts that similar is arccos(2s / (1 + s)) at most, those of
    few shingles differ in up to a quarter more bits (SMALL), and the bound on
    bits lies four standard deviations above that. What these pairs connect is
    one cell of a second step, which holds the shingles themselves and
    compares the texts that share one of their rarest. Equal texts are one node. Texts without words, null ones too, are
    alike. A null doc_id stays null, repeated rows stay separate rows, other
    columns of docs are not read, an empty table gives an empty result.
    """
    source = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), "text")
    prints = scratch(source.mapInArrow(_wide(words), "doc_id long, th long, " + ", ".join(f"{c} long" for c in LANES) + ", shingles int"), "fingerprints")
    nodes = scratch(prints.groupBy(F.col("th").alias("node")).agg(*[F.min(c).alias(c) for c in LANES], F.min("shingles").alias("shingles")), "nodes")
    maybe = components(possible_links(nodes, similarity, block_rows))
    texts = source.join(maybe.withColumnRenamed("node", "th"), "th").select(F.col("th").alias("node"), F.col("label").alias("cell"), "text")
    sets = texts.mapInArrow(_sets(words), "node long, cell long, shingle_set binary").dropDuplicates(["node"])
    held = scratch(sets.select(F.lit(0).alias("grid"), F.lit(False).alias("visitor"), "node", "cell", "shingle_set"), "sets")
    pairs = in_blocks(held, min(block_rows, SET_ROWS))
    found = components(pairs.mapInArrow(_verified(similarity), "u long, v long"))
    labels = scratch(found.withColumnRenamed("node", "th"), "labels")
    return prints.select("doc_id", "th").join(labels, "th", "left").withColumn("label", F.coalesce("label", "th"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of docs, one of each group of near-duplicates: that of the smallest doc_id.

    Of rows that share that doc_id the one whose text has the smallest hash
    stays, and of rows repeated with their text, one. A group without any
    doc_id keeps one row. All columns stay, whatever they are called. An empty
    table gives an empty result.
    """
    found = scratch(similar_groups(docs, words, similarity), "found")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("m"))
    names = unused(docs.columns, "__kept_id", "__kept_null", "__kept_text")
    key = [F.coalesce("doc_id", F.lit(0)).alias(names[0]), F.col("doc_id").isNull().alias(names[1])]
    chosen = scratch(first.select("m.doc_id", "m.th").select(*key, F.col("th").alias(names[2])).distinct(), "chosen")
    kept = docs.select("*", *key, F.coalesce(F.xxhash64("text"), F.lit(0)).alias(names[2])).join(chosen, names, "left_semi")
    if found.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(names)
    return kept.select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text of `documents`; odd rows as in near_duplicates."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
