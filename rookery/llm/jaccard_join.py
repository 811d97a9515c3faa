"""Similarity self-join on word n-grams: MinHash LSH forest, then exact Jaccard.

Words are maximal runs of letters, digits and underscores, lower-cased; a
document's set holds its n-grams of ``width`` words (one shorter n-gram if it
has fewer words).  Two documents are linked if the Jaccard similarity of
their sets is ``threshold`` or more; classes are the connected components of
links.

1. One pass hashes each whole text to its set's fingerprint and a MinHash
   signature.  Documents of equal sets become one node with a copy count.
2. LSH forest: a tree's label of a node is ``DEPTH`` hash values, and the
   labels of each tree, sorted, are its prefix trie: a node of the trie at
   depth k is a run of equal prefixes of length k.  All tries are one range
   partitioned table (tree, label, node), so that runs of any length are
   spread evenly.  The walk starts from whole labels; members of a run that
   come from different children are compared on sketches of the signature,
   with a margin of five standard errors, and give a spanning forest of likely
   pairs.  Then the matched prefixes are shortened by one value, until the
   estimated recall reaches ``target_recall``: of the distinct likely pairs
   at the threshold or more, found at length k, each stands for
   1 / (1 - (1 - s^k)^trees) true ones; besides, the modelled recall of a pair
   just at the threshold must reach ``least_recall``.  A run too large for
   one comparison, or cut by the border of two partitions, is joined to one of
   its members as a star instead, which only adds work for the next step.
3. Components of likely pairs are checked exactly.  Those of up to ``block``
   nodes are one cell.  For a larger one a pivot set is made, the n-grams of
   most of some thirty members; Jaccard distance is a metric, so two members
   whose distances to the pivot are half of the allowed one or less are linked
   without being compared.  The others are dealt out as blocks of a grid; each
   cell counts the exact intersections of two blocks and returns, for each
   node, the number of linked documents and a spanning forest of links: never
   the pairs themselves.

Result: ``doc_id, class_id, n_links, n_shingles, n_copies`` for each row.
``class_id`` is the least doc_id of the class, ``n_links`` the number of other
rows linked to the row, copies included.

Joins on a set, a class or a node of the component search deal frequent keys
over several tasks (``join_groups``).

Edge cases: null, empty and wordless texts have no set: they are their own
class with no links.  A null id keeps a null class only if all its class has
null ids.  Repeated rows count as copies.  An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import Memo, join_groups, map_rows, mix64, on_disk, small_batches, stored, tidy
from rookery.llm.components import connected_components

WIDTH, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET_RECALL, LEAST_RECALL = 24, 6, 0.9999, 0.999
HASHES = TREES * DEPTH
_WORD = re.compile(r"\w+")
_word_hash = Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "replace")))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted unique 64-bit hashes of the text's word n-grams."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mix64(out))


def fingerprint(grams: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


_FACTORS = (np.random.default_rng(20240229).integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[None, :]


def signature(grams: np.ndarray) -> np.ndarray:
    """``HASHES`` minima of multiplicative hashes, as uint32."""
    x = (grams >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (x[at : at + 1024] * _FACTORS).min(axis=0), out=out)
    return out


def labels(minima: np.ndarray) -> np.ndarray:
    """For each tree two signed longs: the tree's number (8 bits), then ``DEPTH`` values of 16 bits each, then blanks."""
    out = np.zeros((TREES, 16), np.uint8)
    out[:, 0] = np.arange(TREES)
    out[:, 1 : 1 + 2 * DEPTH] = (minima & np.uint32(0xFFFF)).astype(">u2").reshape(TREES, DEPTH).view(np.uint8)
    return out.reshape(-1).view(">i8").astype(np.int64)


def sketch(keys: np.ndarray) -> np.ndarray:
    """One byte of each of the signature's values, from rows of ``labels``."""
    return keys.astype(">i8").view(np.uint8).reshape(-1, TREES, 16)[:, :, 2 : 2 + 2 * DEPTH : 2].reshape(len(keys), HASHES)


def prefix(hi: np.ndarray, lo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels cut to the tree and ``k`` values."""
    bits = 8 + 16 * k
    cut = [np.int64(-1) << np.int64(64 - b) if b else np.int64(0) for b in (min(64, bits), max(0, bits - 64))]
    return hi & cut[0], lo & cut[1]


def modelled_recall(s: float | np.ndarray, k: int, trees: int = TREES):
    """The probability that a pair of similarity ``s`` shares a prefix of ``k`` values in one tree or more."""
    return 1 - (1 - np.asarray(s, float) ** k) ** trees


def _fingerprints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    def rows(batch):
        sets = [shingles(t.as_py(), width) for t in batch.column(1)]
        return [batch.column(0), batch.column(2), [fingerprint(s) if len(s) else None for s in sets], [len(s) for s in sets], [labels(signature(s)) if len(s) else None for s in sets]]

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col))), "doc_id long, text_hash long, node long, n_shingles int, labels array<long>", rows, size=256)


def _forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``pairs`` that join two trees, in order."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal key columns, from sorted batches; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        differs = held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(n_keys))
        if differs:
            yield pa.Table.from_batches(held)
            held = []
        if len(changes):
            last = int(changes[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, n_keys: int) -> np.ndarray:
    keys = [table.column(k).to_numpy() for k in range(n_keys)]
    changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return np.concatenate(([0], changes, [table.num_rows]))


# -- the forest
def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition of the sorted tries that has rows: its number, first and last label, first node."""
    from pyspark import TaskContext

    first = last = None
    for batch in batches:
        if batch.num_rows:
            ends = [[c[k].as_py() for c in batch.columns] for k in (0, -1)]
            first, last = first or ends[0], ends[1]
    if first and last:
        yield pa.RecordBatch.from_pydict({"p": pa.array([TaskContext.get().partitionId()], pa.int32()), "hi": [first[0]], "lo": [first[1]], "node": [first[2]], "last_hi": [last[0]], "last_lo": [last[1]]})


def cut_runs(borders: list[tuple], k: int) -> dict[int, tuple[int | None, int | None]]:
    """For each partition the node that stands for its first and its last run, if that run goes on in another partition.

    ``borders``: ``(p, hi, lo, node, last_hi, last_lo)`` of the partitions with rows, in their order.
    """
    out: dict[int, list[int | None]] = {b[0]: [None, None] for b in borders}

    def cut(hi: int, lo: int) -> tuple[int, int]:
        a, b = prefix(np.array([hi], np.int64), np.array([lo], np.int64), k)
        return int(a[0]), int(b[0])

    for before, now in zip(borders, borders[1:]):
        if cut(before[4], before[5]) == cut(now[1], now[2]):
            # a run that fills a partition and came from the one before keeps its node
            through = out[before[0]][0] if cut(before[1], before[2]) == cut(before[4], before[5]) else None
            out[before[0]][1] = out[now[0]][0] = now[3] if through is None else through
    return {p: (a, b) for p, (a, b) in out.items() if a is not None or b is not None}


def _walk(k: int, deepest: bool, leaders: dict[int, tuple[int | None, int | None]], group_most: int):
    """Runs of prefix length ``k`` that hold more than one child, from sorted tries.

    Rows ``run, child, node`` for a run to be compared; ``run`` is null where ``node`` is joined to ``child`` as a star.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first_leader, last_leader = leaders.get(TaskContext.get().partitionId(), (None, None))
        none = [np.zeros(0, np.int64)] * 3
        held = none
        star: int | None = None  # the leader of a run that is being given out as a star
        opening = True

        def give(part: list[np.ndarray], leader: int | None = None) -> Iterator[pa.RecordBatch]:
            """Whole runs, or with a leader a piece of one run."""
            hi, lo, node = part
            if leader is not None:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(node), pa.int64()), pa.array(np.full(len(node), leader)), pa.array(node)], names=["run", "child", "node"])
                return
            ph, pl = prefix(hi, lo, k)
            starts = np.concatenate(([0], np.flatnonzero((ph[1:] != ph[:-1]) | (pl[1:] != pl[:-1])) + 1))
            sizes = np.diff(np.append(starts, len(node)))
            ch, cl = prefix(hi, lo, k + 1) if not deepest else (node, node)
            fresh = np.concatenate(([False], (ch[1:] != ch[:-1]) | (cl[1:] != cl[:-1])))
            fresh[starts] = False
            children = np.add.reduceat(fresh.astype(np.int64), starts) if len(node) else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(starts)), sizes)
            name = (mix64(ph.view(np.uint64) ^ np.uint64(k)) + mix64(mix64(pl.view(np.uint64)))).view(np.int64)
            kept = (children > 0)[of]
            big = kept & (sizes > group_most)[of]
            child = np.where(big, node[starts][of], np.cumsum(fresh))
            kept &= ~(big & (node == child))
            yield pa.RecordBatch.from_arrays([pa.array(name[kept], mask=big[kept]), pa.array(child[kept]), pa.array(node[kept])], names=["run", "child", "node"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            part = [np.concatenate([a, b]) for a, b in zip(held, new)]
            ph, pl = prefix(part[0], part[1], k)
            changes = np.flatnonzero((ph[1:] != ph[:-1]) | (pl[1:] != pl[:-1])) + 1
            if not len(changes):
                if star is None:
                    star = first_leader if opening and first_leader is not None else int(part[2][0]) if len(part[2]) > group_most else None
                if star is not None:  # memory stays bounded in a run of any length; one row keeps its label
                    yield from give(part, star)
                held = part if star is None else [a[-1:] for a in part]
                continue
            at = int(changes[0])
            lead = star if star is not None else (first_leader if opening else None)
            if lead is not None:
                yield from give([a[:at] for a in part], lead)
                part = [a[at:] for a in part]
                changes = changes[1:] - at
            star, opening = None, False
            if len(changes):
                last = int(changes[-1])
                yield from give([a[:last] for a in part])
                part = [a[last:] for a in part]
            held = part
        if len(held[2]):
            lead = star if star is not None else (first_leader if opening and first_leader is not None else last_leader)
            yield from give(held, lead)
            if lead is not None and last_leader is not None and last_leader != lead:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([lead], pa.int64()), pa.array([last_leader], pa.int64())], names=["run", "child", "node"])

    return run


def _likely_pairs(threshold: float):
    """``a, b, agree`` of the pairs of different children that join two trees of a run's forest."""
    least = max(0.0, threshold - 5 * math.sqrt(threshold * (1 - threshold) / HASHES)) * HASHES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 1):
            bounds, child, nodes = _bounds(table, 1), table.column(1).to_numpy(), table.column(2).to_numpy()
            bits = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(-1, HASHES)
            a, b, agree = [], [], []
            sizes = np.diff(bounds)
            for lag in range(1, 4):  # runs of two to four, at once
                first = np.concatenate([bounds[:-1][(sizes > lag) & (sizes <= 4)] + k for k in range(4 - lag)])
                run_end = np.concatenate([bounds[1:][(sizes > lag) & (sizes <= 4)]] * (4 - lag))
                first = first[(first + lag < run_end)]
                first = first[child[first] != child[first + lag]]
                same = (bits[first] == bits[first + lag]).sum(axis=1)
                a.append(nodes[first[same >= least]])
                b.append(nodes[first[same >= least] + lag])
                agree.append(same[same >= least])
            for k in np.flatnonzero(sizes > 4):
                s, c, found = bits[bounds[k] : bounds[k + 1]], child[bounds[k] : bounds[k + 1]], {}

                def linked(s=s, c=c, found=found):
                    for i in range(len(s) - 1):
                        same = (s[i + 1 :] == s[i]).sum(axis=1)
                        for j in np.flatnonzero((same >= least) & (c[i + 1 :] != c[i])):
                            found[i, i + 1 + int(j)] = int(same[j])
                            yield i, i + 1 + int(j)

                pairs = _forest(len(s), linked())
                a.append(nodes[bounds[k] + np.array([i for i, _ in pairs], np.int64)])
                b.append(nodes[bounds[k] + np.array([j for _, j in pairs], np.int64)])
                agree.append(np.array([found[p] for p in pairs], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in ((a, pa.int64()), (b, pa.int64()), (agree, pa.int32()))], names=["a", "b", "agree"])

    return run


def estimated_recall(agree: np.ndarray, pairs: np.ndarray, k: int, threshold: float) -> float:
    """Of ``pairs[i]`` links found with ``agree[i]`` equal values: found over expected, at prefix length ``k``."""
    s, at = agree / HASHES, agree / HASHES >= threshold
    expected = float((pairs[at] / modelled_recall(s[at], k)).sum())
    return float(pairs[at].sum()) / expected if expected else 1.0


def likely_links(spark: SparkSession, nodes: DataFrame, n_nodes: int, *, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, least_recall: float = LEAST_RECALL, group_most: int = 512, rows_a_file: int = 50_000) -> tuple[DataFrame, list[tuple[int, float]]]:
    """``a, b`` of likely pairs from ``nodes`` (``node, labels``), and the prefix lengths walked with their estimated recall."""
    small_batches(spark, 20_000)
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(F.get("labels", 2 * t).alias("hi"), F.get("labels", 2 * t + 1).alias("lo"))))
    tries = on_disk(nodes.select("node", each.alias("l")).select("l.hi", "l.lo", "node").repartitionByRange("hi", "lo", "node").sortWithinPartitions("hi", "lo", "node"))
    borders = sorted(tuple(r) for r in tries.mapInArrow(_borders, "p int, hi long, lo long, node long, last_hi long, last_lo long").collect())  # a row a partition
    sketches = map_rows(nodes.select("node", "labels"), "node long, sketch binary", lambda b: [b.column(0), [x.tobytes() for x in sketch(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))]])
    small_batches(spark, 20_000)
    links, walked, files = None, [], max(1, -(-n_nodes // rows_a_file))
    for k in range(DEPTH, 0, -1):
        tidy(spark)
        found = on_disk(tries.mapInArrow(_walk(k, k == DEPTH, cut_runs(borders, k), group_most), "run long, child long, node long"))
        pairs = found.filter("run is not null").join(sketches, "node").select("run", "child", "node", "sketch")
        pairs = pairs.repartition("run").sortWithinPartitions("run", "child", "node").mapInArrow(_likely_pairs(threshold), "a long, b long, agree int")
        stars = found.filter("run is null and node != child").select(F.col("child").alias("a"), F.col("node").alias("b"), F.lit(None).cast("int").alias("agree"))
        new = stored(spark, pairs.unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "agree").groupBy("a", "b").agg(F.max("agree").alias("agree")), "likely", files)
        found.unpersist()
        links = new if links is None else links.unionByName(new)
        # at most HASHES rows; a pair is met at one length only, but for stars
        counts = links.filter("agree is not null").groupBy("agree").count().collect()
        recall = estimated_recall(np.array([r[0] for r in counts], float), np.array([r[1] for r in counts], float), k, threshold)
        walked.append((k, recall))
        if recall >= target_recall and modelled_recall(threshold, k) >= least_recall:
            break
    tries.unpersist()
    return links.select("a", "b"), walked


# -- exact counts
def _counts(left: list[np.ndarray], right: list[np.ndarray], most: int = 1_500_000) -> np.ndarray:
    """Sizes of the intersections of every left with every right set; sides of more than ``most`` elements are halved."""
    if sum(map(len, left)) + sum(map(len, right)) > most and len(left) * len(right) > 16:
        if len(left) >= len(right):
            half = len(left) // 2
            return np.concatenate([_counts(left[:half], right, most), _counts(left[half:], right, most)], axis=0)
        half = len(right) // 2
        return np.concatenate([_counts(left, right[:half], most), _counts(left, right[half:], most)], axis=1)
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.float64)
    values, place = np.unique(np.concatenate(left + right), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, len(values), 4096):
        lo, hi = np.searchsorted(place, (at, at + 4096))
        m = np.zeros((len(left) + len(right), 4096), np.float32)
        m[row[lo:hi], place[lo:hi] - at] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _verify(threshold: float):
    """``node, links, other`` from cells ``root, ci, cj, block, node, copies, grams``: links of a node, or a forest edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 3):
            bounds = _bounds(table, 3)
            ci, cj, block, node, copies = (table.column(k).to_numpy() for k in range(1, 6))
            grams = table.column(6)
            out_node, out_links, out_other = [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                rows, sets = range(lo, hi), {r: np.frombuffer(grams[r].as_py(), np.uint64) for r in range(lo, hi)}
                inside = ci[lo] == cj[lo]
                left = [r for r in rows if block[r] == ci[lo]]
                right = left if inside else [r for r in rows if block[r] == cj[lo]]
                if not left or not right or (inside and len(left) < 2):
                    continue
                ls, rs = [sets[r] for r in left], [sets[r] for r in right]
                common = _counts(ls, rs)
                union = np.array([len(s) for s in ls])[:, None] + np.array([len(s) for s in rs])[None, :] - common
                hit = common / union >= threshold
                if inside:
                    np.fill_diagonal(hit, False)
                out_node.append(node[left])
                out_links.append(hit @ copies[right])
                out_other.append(np.full(len(left), -1))
                if not inside:
                    out_node.append(node[right])
                    out_links.append(hit.T @ copies[left])
                    out_other.append(np.full(len(right), -1))
                i, j = np.nonzero(np.triu(hit) if inside else hit)
                shift = 0 if inside else len(left)
                both = left if inside else left + right
                pairs = _forest(len(both), zip(i.tolist(), (j + shift).tolist()))
                out_node.append(node[[both[i] for i, _ in pairs]] if pairs else np.zeros(0, np.int64))
                out_other.append(node[[both[j] for _, j in pairs]] if pairs else np.zeros(0, np.int64))
                out_links.append(np.full(len(pairs), -1))
            if out_node:
                links, other = np.concatenate(out_links).astype(np.int64), np.concatenate(out_other).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_node).astype(np.int64)), pa.array(links, pa.int64(), mask=links < 0), pa.array(other, pa.int64(), mask=links >= 0)], names=["node", "links", "other"])

    return run


def majority(sets: list[np.ndarray]) -> np.ndarray:
    """The elements that half of the sets or more have."""
    values, n = np.unique(np.concatenate(sets), return_counts=True)
    return values[2 * n >= len(sets)]


def _pivot(table: pa.Table) -> pa.Table:
    return pa.table({"root": table.column("root")[:1], "pivot": pa.array([majority([np.frombuffer(x.as_py(), np.uint64) for x in table.column("grams")]).tobytes()])})


def _beside_pivot(threshold: float):
    """Whether each member's distance to the pivot is at most half of the allowed one."""
    least = (1 + threshold) / 2 + 1e-9

    def rows(batch):
        near = []
        for grams, pivot in zip(batch.column(5), batch.column(6)):
            a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (grams, pivot))
            common = len(np.intersect1d(a, b, assume_unique=True))
            near.append(common >= least * (len(a) + len(b) - common))
        return [*batch.columns[:6], near]

    return rows


def _cells(sets: DataFrame, threshold: float, block: int, weight: int, sample: int, n_nodes: int, files: int) -> tuple[DataFrame, DataFrame | None]:
    """Cells to compare, and the members of large components that are linked by their pivot: ``node, root, copies, leader, all_copies``."""
    of = ["root", "ci", "cj", "block", "node", "copies", "grams"]
    one = F.lit(0).alias
    small = sets.filter("blocks = 1").select("root", one("ci"), one("cj"), one("block"), "node", "copies", "grams")
    big = sets.filter("blocks > 1")
    if big.isEmpty():
        return small.select(*of), None
    # about ``sample`` members, and always one; the pivot only decides how much is compared
    chosen = big.filter((F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")) < sample) | (F.col("node") == F.col("root")))
    pivots = chosen.select("root", "grams").groupBy("root").applyInArrow(_pivot, "root long, pivot binary").join(big.select("root", "n").distinct(), "root")
    beside = join_groups(big.drop("n", "blocks"), pivots, "root", "n", ["node"], n_nodes).select("root", "n", "node", "copies", "n_shingles", "grams", "pivot")
    beside = stored(sets.sparkSession, map_rows(beside, "root long, n long, node long, copies long, n_shingles int, grams binary, near boolean", _beside_pivot(threshold), size=64), "beside", files)

    def parts(far: bool):
        kept = F.when(~F.col("near") if far else F.col("near"), 1)
        return F.ceil(F.greatest(F.count(kept) / block, F.coalesce(F.sum(F.when(kept.isNotNull(), F.col("n_shingles"))), F.lit(0)) / weight)).cast("int")

    about = beside.groupBy("root").agg(F.count("*").alias("n"), parts(True).alias("far"), parts(False).alias("close"), F.min(F.when(F.col("near"), F.col("node"))).alias("leader"), F.sum(F.when(F.col("near"), F.col("copies"))).alias("all_copies"))
    placed = join_groups(beside.drop("n"), about, "root", "n", ["node"], n_nodes)
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.greatest(F.lit(1), F.when(F.col("near"), F.col("close")).otherwise(F.col("far")))).cast("int") + F.when(F.col("near"), F.col("far")).otherwise(0)
    others = F.when(F.col("near"), F.col("far")).otherwise(F.col("far") + F.col("close"))
    large = placed.filter("far > 0").withColumn("block", own).withColumn("o", F.explode(F.sequence(F.lit(0), others - 1)))
    large = large.select("root", F.least("o", "block").alias("ci"), F.greatest("o", "block").alias("cj"), "block", "node", "copies", "grams")
    return small.select(*of).unionByName(large.select(*of)), placed.filter("near").select("node", "copies", "leader", "all_copies")


def _classified(spark: SparkSession, docs: DataFrame, *, width: int = WIDTH, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, least_recall: float = LEAST_RECALL, group_most: int = 512, block: int = 192, weight: int = 2_000_000, sample: int = 33, rows_a_file: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, row, root, class_id, n_links, n_shingles, n_copies`` for each row; ``root`` is null without words.

    A component of more than ``block`` nodes or ``weight`` n-grams is compared in blocks of that size.
    """
    prints = stored(spark, _fingerprints(docs, width, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    n_rows = prints.count()
    tidy(spark)
    files = max(1, -(-n_rows // rows_a_file))
    light = prints.select("doc_id", "text_hash", "row", "node", "n_shingles")
    # all rows of a node have the same labels
    nodes = prints.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("rep"), F.count("*").alias("copies"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("labels").alias("labels"))
    nodes = stored(spark, nodes.select("node", "rep.doc_id", "rep.text_hash", "copies", "n_shingles", "labels"), "nodes", files)
    likely, _ = likely_links(spark, nodes, n_rows, threshold=threshold, target_recall=target_recall, least_recall=least_recall, group_most=group_most, rows_a_file=rows_a_file)
    comps = connected_components(spark, likely, files).join(nodes.select("node", "doc_id", "text_hash", "copies", "n_shingles"), "node")

    tidy(spark)
    sizes = comps.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / block, F.sum("n_shingles") / weight)).cast("int").alias("blocks"))
    placed = join_groups(comps, sizes, "root", "n", ["node"], n_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    with_text = texts.join(placed, placed["doc_id"].eqNullSafe(texts["id"]) & (F.col("hash") == F.col("text_hash")))
    carried = ["node", "root", "n", "blocks", "copies", "n_shingles"]

    def grams(batch):
        made = [shingles(t.as_py(), width) for t in batch.column(6)]
        # another row may have the same id and hash
        return [*batch.columns[:6], [s.tobytes() if fingerprint(s) == n else None for s, n in zip(made, batch.column(0).to_pylist())]]

    sets = map_rows(with_text.select(*carried, "text"), "node long, root long, n long, blocks int, copies long, n_shingles int, grams binary", grams, size=256).filter("grams is not null")
    # repeated rows once
    sets = stored(spark, sets.groupBy(*carried).agg(F.any_value("grams").alias("grams")), "sets", 8 * files)
    tidy(spark)
    cells, near = _cells(sets, threshold, block, weight, sample, n_rows, 8 * files)
    checked = stored(spark, cells.repartition("root", "ci", "cj").sortWithinPartitions("root", "ci", "cj", "node").mapInArrow(_verify(threshold), "node long, links long, other long"), "checked", files)

    tidy(spark)
    links = checked.filter("links is not null").select("node", "links")
    edges = checked.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    if near is not None:
        links = links.unionByName(near.select("node", (F.col("all_copies") - F.col("copies")).alias("links")))
        edges = edges.unionByName(near.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    classes = connected_components(spark, edges, files)
    about = nodes.select("node", "doc_id", "copies").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = about.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    about = join_groups(about.drop("doc_id"), firsts, "root", "n", ["node"], n_rows).select("node", "root", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    about = stored(spark, about, "classes", files)
    tidy(spark)
    found = join_groups(light.filter("node is not null"), about, "node", "copies", ["row"], n_rows)
    found = found.select("doc_id", "text_hash", "row", "root", "class_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), "n_shingles", F.col("copies").cast("long").alias("n_copies"))
    none = lambda kind: F.lit(None).cast(kind)
    wordless = light.filter("node is null").select("doc_id", "text_hash", "row", none("long").alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_shingles", F.lit(1).cast("long").alias("n_copies"))
    return found.unionByName(wordless)


def near_duplicates(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``doc_id, class_id, n_links, n_shingles, n_copies`` for each row; options as in ``_classified``."""
    return _classified(spark, docs, **options).drop("text_hash", "row", "root")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all columns: one row of the least id of each class.

    Rows without words all stay.
    """
    rows = _classified(spark, docs, id_col=id_col, text_col=text_col, **options).filter("root is not null").select("doc_id", "text_hash", "root")
    tidy(spark)
    # rows of one id and text are alike for this purpose
    each = on_disk(rows.groupBy("doc_id", "text_hash", "root").agg(F.count("*").alias("rows")))
    n_rows = each.count()
    files = max(1, -(-n_rows // 50_000))
    first = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("f"), F.count("*").alias("n"))
    judged = join_groups(each, first, "root", "n", ["doc_id", "text_hash"], n_rows).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("text_hash") == F.col("f.text_hash")))
    tidy(spark)
    judged = stored(spark, judged.filter("rows > 1 or not stays").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "stays"), "judged", files)
    each.unpersist()
    names = docs.columns
    key = next(n for n in (f"_{k}_hash" for k in range(len(names) + 1)) if n not in names)
    keyed = docs.select("*", F.xxhash64(F.col(text_col)).alias(key))
    same = lambda right: keyed[id_col].cast("long").eqNullSafe(right["_id"]) & (keyed[key] == right["_hash"])
    single = keyed.join(judged, same(judged), "left_anti").select(*names)
    repeated = judged.filter("stays").select("_id", "_hash")
    if repeated.isEmpty():
        return single
    one = keyed.join(repeated, same(repeated), "left_semi").groupBy(F.col(id_col), key).agg(F.any_value(F.struct(*names)).alias("row"))
    return single.unionByName(one.select("row.*"))
