"""Near-duplicates by SuperMinHash (operator 13).

A document is the set of its distinct 4-word shingles (64-bit hashes). Its
signature has ``SLOTS`` places: every element draws its own random permutation
of the places by swaps, and at step ``j`` offers ``j`` plus a random fraction
to the place drawn; a place keeps the least offer. An element's offers to the
places are thus correlated ranks, which lowers the estimate's variance. Steps
run for all elements of a batch at once, and a document stops early, at the
step that no place of its can still be improved by.

Equal sets are one node, so exact copies never multiply. ``BANDS`` bands of
``ROWS`` places give bucket keys; a pair at similarity 0.8 shares no bucket
with probability 3e-6. In a bucket of several nodes, pairs are compared by
sketch, one bit a place: at 0.8 the bits that differ exceed ``SKETCH_BITS``
with probability 1e-7. Nodes joined by such pairs are a group; the full sets of
their members alone are made again from the texts. Within a group every pair
near by sketch, and not linked already, is verified on the full sets. Buckets and groups of any size are dealt over grids of cells bounded by
rows and set sizes; a cell returns only a spanning forest, found by union-find.
Components over the links come from ``graph.components``.

Defined cases: a null or empty text has the empty set and is linked with
nothing, its component is its own id; fewer than four words are one shingle;
long texts are taken whole (their elements in chunks); repeated rows are equal
sets; a null ``doc_id`` gets the smallest id of its group, or null, and is
kept only in the latter case; rows with equal ids are documents of their own;
an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtally.llm.common import Work, bit_table, in_bit_table, map_rows, slices
from wordtally.llm.graph import components, spanning_forest

SHINGLE = 4
SEED = 42
BANDS, ROWS = 42, 6
SLOTS = BANDS * ROWS
#: Sketch bits of SLOTS in which a pair worth verifying may differ.
SKETCH_BITS = 52
SKETCH = ["s0", "s1", "s2", "s3"]
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Elements whose permutations are held at once.
BATCH = 32_768
#: Nodes and set elements of one side of a cell.
CELL_ROWS, CELL_ELEMENTS = 2048, 1 << 19
STEP, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
ALL_ONES = np.iinfo(np.uint64).max


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of a whole text, sorted."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, dtype=np.uint64)
    grams = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=np.uint64))


def _random(x: np.ndarray) -> np.ndarray:
    """64 random bits from each seed."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _offer(best: np.ndarray, elements: np.ndarray, owner: np.ndarray) -> None:
    """Lower the places ``best`` (documents x SLOTS) by the offers of the elements of each document."""
    flat = best.reshape(-1)
    perm = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(elements), 1))
    for j in range(SLOTS):
        # step of the highest place: later offers of these documents are larger than all they have
        alive = ((best >> np.uint64(32)).max(axis=1) >= j)[owner]
        if not alive.all():
            elements, owner, perm = elements[alive], owner[alive], perm[alive]
        if not len(elements):
            return
        with np.errstate(over="ignore"):
            x = _random(elements + STEP * np.uint64(j + 1))
        k = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(SLOTS - j)) >> np.uint64(32)).astype(np.int64)
        row = np.arange(len(elements))
        slot = perm[row, k]
        perm[row, k] = perm[:, j]
        perm[:, j] = slot
        np.minimum.at(flat, owner * SLOTS + slot, (np.uint64(j) << np.uint64(32)) | (x >> np.uint64(32)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures: a row of SLOTS offers (step in the high half, fraction in the low) a set."""
    best = np.full((len(sets), SLOTS), ALL_ONES, dtype=np.uint64)
    first = 0
    while first < len(sets):
        last, held = first + 1, len(sets[first])
        while last < len(sets) and held + len(sets[last]) <= BATCH:
            held += len(sets[last])
            last += 1
        owner = np.repeat(np.arange(last - first), [len(s) for s in sets[first:last]])
        elements = np.concatenate(sets[first:last])
        for at in range(0, held, BATCH):
            _offer(best[first:last], elements[at : at + BATCH], owner[at : at + BATCH])
        first = last
    return best


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Bucket keys (documents x BANDS)."""
    cells = signature.reshape(len(signature), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * STEP, cells.shape[:2])
        for r in range(ROWS):
            key = _random(key * MIX_A + cells[:, :, r])
    return key.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """The lowest bit of each place, packed into four integers."""
    bits = np.zeros((len(signature), 256), dtype=np.uint8)
    bits[:, :SLOTS] = signature & np.uint64(1)
    return np.packbits(bits, axis=1).view(np.int64)


def _node(elements: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    return xxhash.xxh64_intdigest(elements.tobytes(), SEED) - (1 << 63)


def printed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text), node (hash of the set), n, bucket keys and sketch."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        sets = [shingles(t) for t in cols["text"]]
        signature = signatures(sets)
        return {
            "doc_id": cols["doc_id"],
            "text_key": cols["text_key"],
            "node": [_node(s) for s in sets],
            "n": [len(s) for s in sets],
            "bands": list(band_keys(signature)),
            **dict(zip(SKETCH, sketches(signature).T)),
        }

    ddl = "doc_id long, text_key long, node long, n long, bands array<long>, s0 long, s1 long, s2 long, s3 long"
    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), run, ddl)


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and elements of the documents whose text may be among ``wanted`` (text_key); other texts are not shingled again."""
    keys = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, "text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at = part["text_key"].to_numpy()
            _, first = np.unique(at, return_index=True)
            first = first[in_bit_table(keys.value, at[first])]
            sets = [shingles(t) for t in part["text"].take(pa.array(first)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "elements"])

    return docs.select(F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "node long, elements binary")


def in_cells(rows: DataFrame, key: str, side: Column) -> DataFrame:
    """Deal the rows of each ``key`` over a triangular grid: (key, i, j, upper, ...), every two rows of a key in one cell.

    ``side`` is the number of parts the key is cut into; a row of part p goes
    to the cells (p, q) and (q, p), i <= j; ``upper`` marks the rows of part i.
    """
    part = F.pmod(F.xxhash64("node", F.lit(1)), side)
    one = F.lit(1).cast("long")
    dealt = rows.withColumn("_p", part).withColumn("_q", F.explode(F.sequence(one - 1, side - one)))
    dealt = dealt.withColumns({"i": F.least("_p", "_q"), "j": F.greatest("_p", "_q"), "upper": F.col("_p") <= F.col("_q")}).drop("_p", "_q")
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def cells(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, bool]]:
    """The rows of each cell of a sorted stream, and whether the cell lies on the diagonal; a cell may span batches."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        at = np.column_stack([batch[c].to_numpy() for c in (key, "i", "j")])
        if not len(at):
            continue
        cuts = (np.nonzero((at[1:] != at[:-1]).any(axis=1))[0] + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(at)]):
            if rest and (at[a] != last).any():
                yield pa.Table.from_batches(rest), last[1] == last[2]
                rest = []
            rest.append(batch.slice(a, b - a))
            last = at[a]
    if rest:
        yield pa.Table.from_batches(rest), last[1] == last[2]


def _sides(table: pa.Table, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two parts that a cell compares."""
    everything = np.arange(table.num_rows)
    if diagonal:
        return everything, everything
    upper = table["upper"].to_numpy()
    return everything[upper], everything[~upper]


def _near(sketch: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Matrix of the pairs x, y that differ in SKETCH_BITS at most and whose sizes allow a link."""
    differ = np.zeros((len(x), len(y)), dtype=np.int16)
    for word in range(4):
        differ += np.bitwise_count(sketch[x, word][:, None] ^ sketch[y, word][None, :])
    small, large = np.minimum(n[x][:, None], n[y][None, :]), np.maximum(n[x][:, None], n[y][None, :])
    return (differ <= SKETCH_BITS) & (100 * small >= PERCENT * large)


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sketch = np.column_stack([table[c].to_numpy() for c in SKETCH]).view(np.uint64)
    return table["node"].to_numpy(), table["n"].to_numpy(), sketch


def _links_out(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _compare_bucket(table: pa.Table, diagonal: bool) -> tuple[list[int], list[int]]:
    """Spanning forest of the near pairs of a cell of a bucket."""
    node, n, sketch = _columns(table)
    x, y = _sides(table, diagonal)
    a: list[int] = []
    b: list[int] = []
    for at in range(0, len(x), 256):
        i, j = np.nonzero(_near(sketch, n, x[at : at + 256], y))
        p, q = x[at + i], y[j]
        other = p != q
        a += node[p[other]].tolist()
        b += node[q[other]].tolist()
        keep = spanning_forest(a, b)
        a, b = [a[k] for k in keep], [b[k] for k in keep]
    return a, b


def _compare_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, diagonal in cells(batches, "bucket"):
        if table.num_rows > 1:
            yield _links_out(*_compare_bucket(table, diagonal))


def _verify_group(table: pa.Table, diagonal: bool) -> tuple[list[int], list[int]]:
    """Spanning forest of the links of a cell of a group: near pairs not yet connected are held against each other in full."""
    node, n, sketch = _columns(table)
    x, y = _sides(table, diagonal)
    sets = [np.frombuffer(s, dtype=np.uint64) for s in table["elements"].to_pylist()]
    label = np.arange(table.num_rows)
    near = np.concatenate([_near(sketch, n, x[at : at + 256], y) for at in range(0, len(x), 256)])
    a: list[int] = []
    b: list[int] = []
    for i in np.argsort(-near.sum(axis=1), kind="stable").tolist():  # the best connected rows first
        p = x[i]
        open_ = y[near[i] & (label[y] != label[p])]
        if not len(open_):
            continue
        theirs = np.concatenate([sets[q] for q in open_])
        mine = sets[p]
        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        common = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.concatenate(([0], np.cumsum(n[open_])[:-1])))
        linked = open_[100 * common >= PERCENT * (n[p] + n[open_] - common)]
        for q in linked.tolist():
            if label[q] != label[p]:
                a.append(int(node[p]))
                b.append(int(node[q]))
                label[label == label[q]] = label[p]
    return a, b


def _verify_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, diagonal in cells(batches, "grp"):
        if table.num_rows > 1:
            yield _links_out(*_verify_group(table, diagonal))


def links(docs: DataFrame, nodes: DataFrame, work: Work) -> DataFrame:
    """Verified links (a, b) that connect all nodes at or above the threshold."""
    placed = nodes.where("n > 0").select("node", F.explode("bands").alias("bucket"))
    size = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = work.store(placed.join(size, "bucket"), "shared")
    shape = nodes.select("node", "n", *SKETCH)
    bucket = shared.join(shape, "node")
    side = F.ceil(F.col("rows") / CELL_ROWS)
    near = in_cells(bucket, "bucket", side).mapInArrow(_compare_buckets, "a long, b long")
    group = components(near, work, "near").select("node", F.col("root").alias("grp"))
    member = work.store(group.unionByName(group.select(F.col("grp").alias("node"), "grp")).distinct().join(nodes.drop("bands"), "node"), "members")
    size = member.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"))
    side = F.greatest(F.ceil(F.col("rows") / CELL_ROWS), F.ceil(F.col("total") / CELL_ELEMENTS))
    held = member.drop("text_key").join(size.select("grp", side.alias("side")), "grp")
    whole = full_sets(docs, member.select("text_key")).groupBy("node").agg(F.first("elements").alias("elements"))
    return in_cells(held.join(whole, "node"), "grp", F.col("side")).drop("side").mapInArrow(_verify_groups, "a long, b long")


def near_duplicates(docs: DataFrame, work: Work) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    prints = work.store(printed(docs), "prints")
    nodes = work.store(prints.drop("doc_id").dropDuplicates(["node"]), "sets")
    comp = components(links(docs, nodes, work), work, "links")
    first = prints.groupBy("node").agg(F.min("doc_id").alias("first"))
    node = first.join(comp, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    node = work.store(node, "roots")
    best = node.groupBy("root").agg(F.min("first").alias("least"))
    label = node.join(best, "root").select("node", "least")
    out = prints.select("doc_id", "node", "n").join(label, "node")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
