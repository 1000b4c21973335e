"""N-gram Jaccard join: pairs of documents whose sets of five-word shingles are at least 0.8 similar.

Chosen path: in each of several independent runs a set picks each of its tokens with probability 1 / (LAMBDA n)
by a hash that all sets share, and goes into the bucket of each picked token; similar sets share a bucket with
constant probability. Buckets of at most SMALL sets are searched by brute force. Larger ones are split again by
tokens picked with a hash of the path, down to DEPTH, where whatever is left is searched whole. The number of runs
follows from the worst case for a pair at the threshold and the target recall.

What moves: equal sets are one node, told by a digest, from the first map on, so copies cost nothing however many
there are. A first pass counts the nodes of each bucket; bit maps of fixed size say which buckets have company and
which are large; a second pass ships (bucket, node, size, sketch) for those only. Within buckets, two sketches (128
minima of two bits) rule pairs out that are far from the threshold, and what is left becomes stars of candidates,
never all pairs. Each connected group of candidates is then gathered once with its sets, and every pair in it is decided
by exact set sizes; a large group is dealt to blocks by classes of set size, of which only the same and neighbouring
ones can hold similar sets, and blocks meet in pairs. Of these pairs only sums leave a task: links a node, and a spanning
star.

Defined results: a null text and one without words has no set, no link, and a class of its own; one of one to four
words has itself as its only shingle; repeated rows are copies of each other; null ids come last among the members of
a class, and the class of null ids only is null; ties don't arise; very long texts are sets of all their shingles; an empty table
gives no rows. Extra columns pass through `keep_one` only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import components, map_groups, mix, ship, tidy, written

SHINGLE = 5
LAMBDA, DEPTH, SMALL = 0.7, 3, 64
TARGET_RECALL = 0.9999
BINS = 128  # of a sketch, two bits each
TOKEN_BITS = np.uint64(52)  # a shingle's hash; the document within a piece fills the rest
BLOCK = 256  # sets that are compared in one matrix product, with as many others
NODES = {"key": "u8", "node": "u8"}
#: Documents with their nodes pass through the first shuffle, by document.
DOCUMENTS = {"id": "i8", "tie": "i8", "second": "i8", "own": "u8", "n": "i8"}
FIRST = "key long, id long, tie long, second long, node long, n long"
MEMBERS = {"key": "u8", "node": "u8", "n": "u4", "s0": "u8", "s1": "u8", "s2": "u8", "s3": "u8"}


def runs_needed(threshold: float, target: float = TARGET_RECALL) -> int:
    """Runs until a pair at the threshold is missed with probability 1 - target at most, if all buckets split DEPTH times.

    Two sets of Jaccard similarity s share s of the larger one's tokens or more, so a bucket that has both has at
    least a Poisson number, with mean s / LAMBDA, of children that have both."""
    found = 1.0
    for _ in range(DEPTH):
        found = 1.0 - math.exp(-threshold / LAMBDA * found)
    return math.ceil(math.log(1.0 - target) / math.log(1.0 - found))


def most_mismatches(threshold: float) -> int:
    """Differing bins of two sketches that a pair at the threshold exceeds with five standard deviations."""
    p = (1.0 - threshold) * 0.75
    return math.ceil(BINS * p + 5.0 * math.sqrt(BINS * p * (1.0 - p)))


class Sets:
    """The distinct shingles of a piece's documents, sorted by document, and what is derived from them."""

    def __init__(self, p: spans.Piece):
        n = p.ends - p.starts
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(p.codes))
        length = np.minimum(SHINGLE, n)[doc]  # short documents are their own only shingle
        inside = at + length <= p.ends[doc]
        inside &= (length == SHINGLE) | (at == p.starts[doc])
        at, doc = at[inside], doc[inside]
        h = p.hashes(at, at + length[inside])
        keys = np.sort((doc.astype(np.uint64) << TOKEN_BITS) | (h >> (np.uint64(64) - TOKEN_BITS)))
        keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
        self.doc = (keys >> TOKEN_BITS).astype(np.int64)
        self.token = mix(keys & ((np.uint64(1) << TOKEN_BITS) - np.uint64(1)))
        self.size = np.bincount(self.doc, minlength=len(n))
        self.edge = np.concatenate(([0], np.cumsum(self.size)))
        with np.errstate(divide="ignore"):
            share = np.minimum(1.0, 1.0 / (LAMBDA * np.maximum(self.size, 1)))
        self.limit = np.minimum(share * 2.0**64, 2.0**64 - 2048).astype(np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.token + np.uint64(11)), dtype=np.uint64)))
        self.node = mix((total[self.edge[1:]] - total[self.edge[:-1]]) ^ self.size.astype(np.uint64))

    def sketches(self) -> np.ndarray:
        """The sets' sketches as four numbers each."""
        u = mix(self.token ^ np.uint64(0xA24BAED4963EE407))
        order = np.argsort((self.doc.astype(np.uint64) << TOKEN_BITS) | (u >> (np.uint64(64) - TOKEN_BITS)))
        doc, u = self.doc[order], u[order]
        cell = doc * BINS + (u >> np.uint64(57)).astype(np.int64)
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        bits = np.zeros(len(self.size) * BINS, np.uint64)
        bits[cell[first]] = (mix(u[first]) & np.uint64(3))
        out = np.zeros((len(self.size), 4), np.uint64)
        for j, column in enumerate(bits.reshape(-1, 4, BINS // 4).transpose(1, 0, 2)):
            for k in range(BINS // 4):
                out[:, j] |= column[:, k] << np.uint64(2 * k)
        return out

    def picked(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, bucket keys) of the first level of a run."""
        odd = mix(np.array([(2 * run + 1) * 0x9E3779B97F4A7C15 % (1 << 64)], np.uint64)) | np.uint64(1)
        at = np.flatnonzero(self.token * odd < self.limit[self.doc])
        return self.doc[at], mix(self.token[at] + np.uint64(run * 0xD1342543DE82EF95 % (1 << 64)))

    def paths(self, doc: np.ndarray, key: np.ndarray, at_once: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
        """(documents, bucket keys) of the deepest level below buckets of the first."""
        for _ in range(DEPTH - 1):
            total, below, done = np.cumsum(self.size[doc]), [], 0
            while done < len(doc):
                upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + at_once, side="right")))
                d, k = doc[done:upto], key[done:upto]
                n = self.size[d]
                token = self.token[np.arange(int(n.sum())) + np.repeat(self.edge[d] - (np.cumsum(n) - n), n)]
                hit = token * np.repeat(mix(k) | np.uint64(1), n) < np.repeat(self.limit[d], n)
                below.append((np.repeat(d, n)[hit], mix(token[hit] ^ np.repeat(k, n)[hit])))
                done = upto
            doc, key = (np.concatenate(c) for c in zip(*below)) if below else (doc, key)
        return doc, key


def _arrays(batch: pa.RecordBatch) -> Iterator[Sets]:
    texts = batch.column(1).to_pylist()
    for p in spans.word_pieces(texts):
        s = Sets(p)
        s.first = p.first
        yield s


def _pairs_within(sizes: np.ndarray, starts: np.ndarray, at_once: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within groups (few members each), a bounded number at once."""
    done = 0
    total = np.cumsum(sizes * (sizes - 1) // 2)
    while done < len(sizes):
        before = total[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(total, before + at_once, side="right")))
        for m in np.unique(sizes[done:upto]):
            i, j = np.triu_indices(int(m), 1)
            base = starts[done:upto][sizes[done:upto] == m]
            yield (base[:, None] + i).ravel(), (base[:, None] + j).ravel()
        done = upto


def _near(x: dict, a: np.ndarray, b: np.ndarray, threshold: float, most: int) -> np.ndarray:
    """Whether sizes and sketches of pairs allow similarity at the threshold."""
    small, large = np.minimum(x["n"][a], x["n"][b]), np.maximum(x["n"][a], x["n"][b])
    differ = np.zeros(len(a), np.int64)
    for c in ("s0", "s1", "s2", "s3"):
        y = x[c][a] ^ x[c][b]
        differ += np.bitwise_count((y | (y >> np.uint64(1))) & np.uint64(0x5555555555555555))
    return (small >= threshold * large - 1e-9) & (differ <= most)


def merge_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n is connected to by the pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _large_group(x: dict, members: np.ndarray, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what is near in a large bucket. A set is compared with all others, until one component is
    left or each set outside the largest component has been."""
    m = len(members)
    label, compared = np.arange(m), np.zeros(m, bool)
    out = []
    pivot = 0
    while True:
        compared[pivot] = True
        others = np.flatnonzero(np.arange(m) != pivot)
        hit = others[_near(x, np.full(len(others), members[pivot]), members[others], threshold, most)]
        if len(hit):
            out.append((np.full(len(hit), members[pivot]), members[hit]))
            joined = np.unique(np.append(label[hit], label[pivot]))
            label[np.isin(label, joined)] = joined[0]
        counts = np.bincount(label, minlength=m)
        left = np.flatnonzero((label != counts.argmax()) & ~compared)
        if not len(left):
            break
        pivot = int(left[0])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _candidates(x: dict, threshold: float, most: int, small: int) -> Iterator[pa.RecordBatch]:
    """Stars of near sets in a shuffle bucket's path buckets."""
    if not len(x["key"]):
        return
    order = np.lexsort((x["node"], x["key"]))
    new = np.ones(len(order), bool)
    new[1:] = (x["key"][order[1:]] != x["key"][order[:-1]]) | (x["node"][order[1:]] != x["node"][order[:-1]])
    order = order[new]  # a set comes once from each task that has it
    x = {c: v[order] for c, v in x.items()}
    starts = np.flatnonzero(np.append(True, x["key"][1:] != x["key"][:-1]))
    sizes = np.diff(np.append(starts, len(order)))
    found = []
    few = (sizes > 1) & (sizes <= small)
    for a, b in _pairs_within(sizes[few], starts[few]):
        hit = _near(x, a, b, threshold, most)
        found.append((a[hit], b[hit]))
    for k in np.flatnonzero(sizes > small):
        found.append(_large_group(x, np.arange(starts[k], starts[k] + sizes[k]), threshold, most))
    nodes, at = np.unique(x["node"], return_inverse=True)
    a, b = (at[np.concatenate([f[j] for f in found])] if found else np.zeros(0, np.int64) for j in (0, 1))
    label = merge_labels(len(nodes), a, b)
    star = np.flatnonzero(label != np.arange(len(nodes)))
    if len(star):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[star].view(np.int64)), pa.array(nodes[label[star]].view(np.int64))], names=["a", "b"])


def _compare(sets: list[np.ndarray], n_left: int) -> np.ndarray:
    """Intersection sizes of sets: all with all, or the first n_left (if below all) with the rest."""
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count[column] > 1  # a token of one set is in no intersection
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left = slice(0, n_left)
    right = slice(n_left, None) if n_left < len(sets) else slice(None)
    width = 4_096
    total = None
    for c in range(0, int(column[-1]) + 1 if len(column) else 1, width):
        a, b = np.searchsorted(column, (c, c + width))
        x = np.zeros((len(sets), width if b - a > width else max(1, int(column[b - 1]) - c + 1 if b > a else 1)), np.float32)
        x[owner[a:b], column[a:b] - c] = 1.0
        part = x[left] @ x[right].T
        total = part if total is None else total + part
    return total.astype(np.int64)


def _verified(ratio: tuple[int, int]):
    """For groups of gathered sets (cluster, left, right blocks): each node's links there, and its component's smallest node."""
    up, down = ratio

    def run(table: pa.Table, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        node_all, weight_all = table.column("node").to_numpy(), table.column("weight").to_numpy()
        block_all, left_all, right_all = (table.column(c).to_numpy() for c in ("block", "left", "right"))
        data = table.column("tokens").to_pylist()
        out = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            rows = a + np.argsort(node_all[a:b])
            across = left_all[a] != right_all[a]
            if across:
                rows = rows[np.argsort(block_all[rows] != left_all[a], kind="stable")]
            n_left = int((block_all[rows] == left_all[a]).sum()) if across else len(rows)
            if len(rows) < 2 or across and n_left in (0, len(rows)):
                continue
            sets = [np.frombuffer(data[i], np.uint64) for i in rows]
            size, weight = np.array([len(s) for s in sets]), weight_all[rows]
            both = _compare(sets, n_left if across else len(rows))
            one, other = (np.arange(n_left), np.arange(n_left, len(rows))) if across else (np.arange(len(rows)),) * 2
            # s >= up / down  <=>  (down + up) * both >= up * (sum of sizes)
            hit = (down + up) * both >= up * (size[one][:, None] + size[other][None, :])
            if not across:
                np.fill_diagonal(hit, False)
            links = np.zeros(len(rows), np.int64)
            links[one] += hit @ weight[other]
            if across:
                links[other] += hit.T @ weight[one]
            i, j = np.nonzero(hit)
            label = merge_labels(len(rows), one[i], other[j])
            linked = np.flatnonzero(links > 0)
            out.append((node_all[rows[linked]], links[linked], node_all[rows[label[linked]]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], names=["node", "links", "label"])

    return run


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: tuple[int, int] = (4, 5), target: float = TARGET_RECALL, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(id, tie, doc_id, class_id, n_links, n_copies): for each row of `docs` the smallest id of its connected group, and
    with how many rows it is similar, copies included."""
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    threshold = ratio[0] / ratio[1]
    runs, most = runs_needed(threshold, target), most_mismatches(threshold)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    n_buckets = spans.bucket_count(docs)

    # first pass: each document's node, and how many nodes each bucket of the first level has
    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slices(batches, 1):
            ids, ties = spans.document_keys(b.column(0), b.column(1).to_pylist())
            keys, owners, node, size, second = [], [], [], [], [b.column(2).to_numpy(zero_copy_only=False)]
            for s in _arrays(b):
                node.append(s.node)
                size.append(s.size)
                once = np.zeros(len(s.size), bool)
                once[np.unique(s.node, return_index=True)[1]] = True
                for r in range(runs):
                    doc, key = s.picked(r)
                    keys.append(key[once[doc]])
                    owners.append(s.node[doc[once[doc]]])
            if keys:
                key, owner = np.concatenate(keys), np.concatenate(owners)
                parts = [spans.pack((key % np.uint64(n_buckets)).astype(np.int64), n_buckets, {"key": key, "node": owner}), spans.pack((mix(ids.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64), n_buckets, {"id": ids, "tie": ties, "second": np.concatenate(second), "own": np.concatenate(node), "n": np.concatenate(size)})]
                for part in parts:
                    blank = pa.array([b""] * part.num_rows, pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("bucket"), *(part.column(c) if c in part.schema.names else blank for c in (*NODES, *DOCUMENTS))], names=["bucket", *NODES, *DOCUMENTS])

    def count(x: dict) -> Iterator[pa.RecordBatch]:
        if len(x["own"]):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(x["own"]), pa.int64()), pa.array(x["id"]), pa.array(x["tie"]), pa.array(x["second"]), pa.array(x["own"].view(np.int64)), pa.array(x["n"])], names=["key", "id", "tie", "second", "node", "n"])
        order = np.lexsort((x["node"], x["key"]))
        key, node = x["key"][order], x["node"][order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        keys, n = np.unique(key[new], return_counts=True)
        if (n > 1).any():
            none = pa.nulls(int((n > 1).sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), none, none, none, none, pa.array(n[n > 1].astype(np.int64))], names=["key", "id", "tie", "second", "node", "n"])

    kinds = NODES | DOCUMENTS
    first = written(spans.by_bucket(texts.withColumn("second", F.xxhash64("text")).mapInArrow(tidy(buckets), spans.shipped(kinds)), kinds, count, FIRST), "first")
    members = first.where("key IS NULL").select(F.nullif(F.col("id"), F.lit(spans.LAST_ID)).alias("doc_id"), "id", "tie", "second", "node", "n")
    counted = first.where("key IS NOT NULL").select("key", "n")
    company, large = (context.broadcast(spans.bit_map(counted.where(c), "key")) for c in ("n > 1", f"n > {small}"))

    # second pass: members of buckets with company, those of large ones at the deepest level
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slices(batches, 1):
            parts = []
            for s in _arrays(b):
                once = np.zeros(len(s.size), bool)
                once[np.unique(s.node, return_index=True)[1]] = True
                sketch = s.sketches()
                for r in range(runs):
                    doc, key = s.picked(r)
                    some = once[doc] & spans.in_map(company.value, key)
                    doc, key = doc[some], key[some]
                    split = spans.in_map(large.value, key)
                    below = s.paths(doc[split], key[split])
                    doc, key = np.concatenate((doc[~split], below[0])), np.concatenate((key[~split], below[1]))
                    parts.append({"key": key, "node": s.node[doc], "n": s.size[doc].astype("u4"), **{f"s{j}": sketch[doc, j] for j in range(4)}})
            if parts:
                x = {c: np.concatenate([p[c] for p in parts]).astype(k) for c, k in MEMBERS.items()}
                if len(x["key"]):
                    yield spans.pack((x["key"] % np.uint64(n_buckets)).astype(np.int64), n_buckets, x)

    edges = spans.by_bucket(texts.mapInArrow(tidy(paths), spans.shipped(MEMBERS)), MEMBERS, lambda x: _candidates(x, threshold, most, small), "a long, b long")
    clusters = components(edges)

    # third pass: the sets of all nodes that have a candidate, each group of candidates together
    weights = members.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("weight"), F.min("n").alias("n"))
    clusters = written(clusters.join(weights, "node"), "clusters", narrow=True)
    # sets at the threshold differ in size by 1 / threshold at most: one class of sizes, or the next (a little wider, for rounding)
    width = -math.log(threshold) * (1 + 1e-6)
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("whole"))
    clusters = written(clusters.join(sizes, "component").withColumn("class", F.when(F.col("whole") > block, F.floor(F.log("n") / width)).otherwise(0).cast("int")), "classes", narrow=True)
    classes = clusters.groupBy("component", "class").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    code = F.col("class").cast("long") * (1 << 40)
    placed = written(clusters.join(classes, ["component", "class"]).select("component", "class", "node", "weight", (code + F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")), "placed", narrow=True)
    beside = classes.withColumn("others", F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: code + i))
    beside = beside.withColumn("near", F.array(*[F.col("class") + d for d in (-1, 0, 1)])).select("component", "others", F.explode("near").alias("class"))
    beside = written(beside.groupBy("component", "class").agg(F.flatten(F.collect_list("others")).alias("others")), "beside", narrow=True)
    wanted = context.broadcast(spans.bit_map(placed, "node"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slices(batches, 1):
            for s in _arrays(b):
                hit = np.zeros(len(s.size), bool)
                hit[np.unique(s.node, return_index=True)[1]] = True
                at = np.flatnonzero(hit & (s.size > 0) & spans.in_map(wanted.value, s.node))
                if len(at):
                    raw = [s.token[s.edge[d] : s.edge[d + 1]].tobytes() for d in at]
                    yield pa.RecordBatch.from_arrays([pa.array(s.node[at].view(np.int64)), pa.array(raw, pa.binary())], names=["node", "tokens"])

    # a set meets every block of the classes beside its own: groups of up to BLOCK sets have one block
    meeting = placed.join(beside, ["component", "class"]).select("component", "block", "node", "weight", F.explode("others").alias("other"))
    # each slice that has a set sends it: one row is left before it is dealt to groups, in the shuffle that the join needs
    sets = texts.mapInArrow(tidy(gather), "node long, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens"))
    rows = sets.join(meeting, "node").withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    rows = rows.select("component", "left", "right", "block", "node", "weight", "tokens")
    decided = written(map_groups(rows, ["component", "left", "right"], [], _verified(ratio), "node long, links long, label long", min_rows=1_000), "links")
    linked = decided.groupBy("node").agg(F.sum("links").alias("links"), F.min("label").alias("label"))
    if clusters.where(F.col("whole") > block).isEmpty():
        groups = linked.select("node", "links", F.col("label").alias("component"))
    else:
        whole = components(decided.select(F.col("node").alias("a"), F.col("label").alias("b")))
        groups = linked.join(whole, "node").select("node", "links", "component")
    results = members.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"), F.min(F.struct("id", "tie", "second")).alias("head")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    results = written(results, "results", narrow=True)
    classes = results.groupBy("component").agg(F.min("first").alias("class_id"), F.min("head").alias("kept")).withColumnRenamed("component", "class_key")
    results = written(results.join(classes, F.col("component") == F.col("class_key")).select("node", "copies", F.coalesce("links", F.lit(0)).alias("links"), "class_id", "class_key", "kept"), "classes", narrow=True)
    alone = members.where("n = 0").select("id", "tie", "second", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(None).cast("long").alias("class_key"), F.lit(True).alias("stays"))
    return members.where("n > 0").join(results, "node").select("id", "tie", "second", "doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), "class_key", (F.struct("id", "tie", "second") == F.col("kept")).alias("stays")).union(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each class of similar documents: that of the smallest id, and of equal ids by hashes of the text."""
    found = join(docs, id_col, text_col).where("stays")
    stays = written(found.groupBy("id", "tie", "second").agg(F.count(F.lit(1)).alias("same")), "stays", narrow=True)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.col(f"`{text_col}`")
    keyed = docs.select(row.alias("_row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(spans.LAST_ID)).alias("id"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("tie"), F.xxhash64(text).alias("second")).join(stays, ["id", "tie", "second"])
    # rows that repeat in full, of which one stays, are few
    return keyed.where("same = 1").select("_row.*").union(keyed.where("same > 1").dropDuplicates(["id", "tie", "second"]).select("_row.*"))
