"""N-gram Jaccard join with Bayesian candidate pruning.

Shingles are K consecutive words (a shorter text is one shingle). Documents with equal shingle sets are one node. Nodes that
share a band of MinHash values are candidates; pairs compare their values STEP at a time and are dropped when the posterior
probability of a similarity of THRESHOLD or more (uniform prior, so a beta distribution) falls below TOLERANCE. Components of
the surviving pairs bring the shingle sets together once, and what is still not dropped there is verified exactly.

No pair becomes a row: tasks see blocks of at most BLOCK nodes against each other, and give link counts and a spanning forest.
A true pair is missed with probability (1 - THRESHOLD ** ROWS) ** BANDS < 1e-7 at the threshold, far less above it. 64-bit
hashes stand for shingles.

Null and wordless texts have no shingles: a class of their own, no links. A null id has a hash of its text as class id where the
class has no other. Repeated rows are copies of each other and count as links. Extra columns do not matter.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import durable, group_bounds, join_facts, pairs_within, row_keys, whole_groups
from wakeline.llm.graph import components
from wakeline.llm.repeats import Hashes, mixed
from wakeline.llm.suffix_trees import _words

K = 5
THRESHOLD = (4, 5)       # similarity, as a fraction
BANDS, ROWS, STEP = 32, 4, 16
HASHES = BANDS * ROWS
TOLERANCE = 1e-9
BLOCK = 512              # nodes of a block where all pairs are verified; four times as many while pruning
SMALL = 64               # units whose pairs are all compared while pruning
_MUL = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mixed(np.arange(HASHES + 1, 2 * HASHES + 1, dtype=np.uint64))


def least_matches(threshold: float, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> list[int]:
    """Matches that a pair needs after step, 2 * step, ... compared values to stay: the posterior tail of Beta(m + 1, n - m + 1)
    above the threshold is a binomial sum."""
    out = []
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def shingle_sets(column, k: int = K) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    codes, off = _words(column)
    out = []
    if not len(codes):
        return [np.zeros(0, np.uint64)] * len(column)
    h = Hashes(codes)
    gram = h.grams(k) if len(codes) >= k else np.zeros(0, np.uint64)
    for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if z - a >= k:
            out.append(np.unique(gram[a:z - k + 1]))
        elif z > a:
            out.append(mixed(h.spans(np.array([a]), np.array([z])) + np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES values of 16 bits (equal low bits by chance only ever keep a pair)."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        low = np.minimum(low, (shingles[None, at:at + 1024] * _MUL[:, None] + _ADD[:, None]).min(axis=1))
    return (low >> np.uint64(40)).astype(np.uint16)


def _sign(batches):
    for b in batches:
        keys, sizes, signs = [], [], []
        for s in shingle_sets(b.column(3)):
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sizes.append(len(s))
            signs.append(minhash(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary())],
                                         ["doc_id", "k1", "k2", "node", "n", "sig"])


def _unpack_sig(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _survivors(sig: np.ndarray, left: np.ndarray, right: np.ndarray, need: list[int], rows: int = 1 << 17):
    """Pairs that no step drops."""
    keep_l, keep_r = [], []
    for at in range(0, len(left), rows):
        a, b = left[at:at + rows], right[at:at + rows]
        got = np.zeros(len(a), np.int32)
        for k, least in enumerate(need):
            s = slice(k * STEP, (k + 1) * STEP)
            got += (sig[a, s] == sig[b, s]).sum(axis=1, dtype=np.int32)
            ok = got >= least
            if not ok.all():
                a, b, got = a[ok], b[ok], got[ok]
            if not len(a):
                break
        keep_l.append(a)
        keep_r.append(b)
    return (np.concatenate(keep_l), np.concatenate(keep_r)) if keep_l else (left[:0], right[:0])


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row of each row's component."""
    lab = np.arange(n)
    while True:
        m = np.minimum(lab[a], lab[b])
        before = lab.copy()
        np.minimum.at(lab, a, m)
        np.minimum.at(lab, b, m)
        lab = lab[lab]
        if (lab == before).all():
            return lab


def _unit_pairs(t: pa.Table):
    """Pairs of a table of whole units: all rows of a block, or rows of its two blocks."""
    unit = [t.column(c).combine_chunks().to_numpy() for c in ("unit", "i", "j")]
    block = t.column("block").combine_chunks().to_numpy()
    start = group_bounds(*unit)
    left, right = pairs_within(start[:-1], np.diff(start))
    across = (unit[1] == unit[2])[left] | (block[left] != block[right])
    return left[across], right[across]


def _units(members: DataFrame, unit: str, size: str, block: int) -> DataFrame:
    """Deal the members of each unit into blocks; every two blocks meet in one (unit, i, j)."""
    nb = F.ceil(F.col(size) / block).cast("int")
    m = members.withColumn("_nb", nb).withColumn("block", F.pmod(F.xxhash64("node", F.col(unit)), F.col("_nb")).cast("int"))
    m = m.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return m.withColumn("unit", F.xxhash64(unit)).withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o")).drop("_nb", "_o")


def _star(sig: np.ndarray, first: int, end: int, need: list[int]):
    """Surviving pairs that connect a large unit as all of them would: the first row against all, then only the rows that it
    did not reach against all (near copies need about one comparison each)."""
    rows = np.arange(first, end)
    a, b = _survivors(sig, np.full(len(rows) - 1, first), rows[1:], need)
    left, right = [a], [b]
    rest = np.setdiff1d(rows[1:], b, assume_unique=True)
    for at in range(0, len(rest), 64):
        some = rest[at:at + 64]
        x, y = np.repeat(some, len(rows)), np.tile(rows, len(some))
        other = x != y
        a, b = _survivors(sig, x[other], y[other], need)
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _prune(need: list[int]):
    """Candidate pairs of each unit compared step by step; a spanning forest of the survivors comes out."""
    def run(batches):
        for t in whole_groups(batches, ["unit", "i", "j"], 2048):
            start = group_bounds(*(t.column(c).combine_chunks().to_numpy() for c in ("unit", "i", "j")))
            sig, size = _unpack_sig(t.column("sig")), np.diff(start)
            few = size <= SMALL
            found = [_survivors(sig, *pairs_within(start[:-1][few], size[few]), need)]
            found += [_star(sig, int(s), int(s + n), need) for s, n in zip(start[:-1][~few], size[~few], strict=True)]
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            lab = _labels(t.num_rows, a, b)
            rows = np.flatnonzero(lab != np.arange(len(lab)))
            if len(rows):
                node = t.column("node").combine_chunks()
                yield pa.RecordBatch.from_arrays([node.take(pa.array(rows)), node.take(pa.array(lab[rows]))], ["a", "b"])
    return run


def _sets(k: int):
    """Shingle sets of the fetched texts; a text whose set is not its node's (another row of the same id) is left out."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = shingle_sets(part.column(0), k)
                ok = [i for i, (s, key) in enumerate(zip(sets, part.column(1).to_pylist(), strict=True)) if xxhash.xxh3_128_digest(s.tobytes()) == key]
                take = pa.array(ok, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in range(1, 5)), pa.array([sets[i].tobytes() for i in ok], pa.binary()),
                                                  pa.array([minhash(sets[i]).tobytes() for i in ok], pa.binary())], ["node", "docs", "comp", "size", "shingles", "sig"])
    return run


def _verify(need: list[int], threshold: tuple[int, int]):
    """Exact similarity of the pairs that survive: link counts of each node, and a spanning forest of the links."""
    p, q = threshold

    def run(batches):
        for t in whole_groups(batches, ["unit", "i", "j"], 512):
            left, right = _unit_pairs(t)
            left, right = _survivors(_unpack_sig(t.column("sig")), left, right, need)
            raw = t.column("shingles").to_pylist()
            n = np.array([len(x) // 8 for x in raw])
            if not len(left):
                continue
            off = np.concatenate([[0], np.cumsum(n)])
            term = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)[1]
            marked = np.zeros(int(term.max()) + 1, bool)
            order = np.argsort(left, kind="stable")
            left, right = left[order], right[order]
            hit = np.zeros(len(left), bool)
            start = group_bounds(left)
            for a, z in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                own = term[off[left[a]]:off[left[a] + 1]]
                marked[own] = True
                for s in range(a, z, 64):
                    r = right[s:min(z, s + 64)]
                    both = np.concatenate([term[off[x]:off[x + 1]] for x in r.tolist()])
                    common = np.add.reduceat(marked[both].astype(np.int64), np.concatenate([[0], np.cumsum(n[r])[:-1]]))
                    hit[s:s + len(r)] = common * q >= p * (len(own) + n[r] - common)
                marked[own] = False
            left, right = left[hit], right[hit]
            docs = t.column("docs").combine_chunks().to_numpy()
            links = np.bincount(left, docs[right], len(n)) + np.bincount(right, docs[left], len(n))
            lab = _labels(len(n), left, right)
            rows = np.flatnonzero(links)
            if len(rows):
                node = t.column("node").combine_chunks()
                yield pa.RecordBatch.from_arrays([node.take(pa.array(rows)), node.take(pa.array(lab[rows])), pa.array(links[rows].astype(np.int64))], ["a", "b", "links"])
    return run


def similarity_classes(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, k: int = K, block: int = BLOCK) -> DataFrame:
    """One row per document: k1, k2, doc_id, n_shingles, class_id (smallest id of the documents it is linked to, directly or
    over others), n_links (other documents of at least that similarity, copies included), keep (its class's smallest id)."""
    need = least_matches(threshold[0] / threshold[1])
    keyed = row_keys(docs.select("doc_id", "text"))
    signed = durable(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "k1", "k2", "text").mapInArrow(
        _sign, "doc_id long, k1 long, k2 long, node binary, n int, sig binary"))
    nodes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("least_id"), F.min("k1").alias("k1"), F.first("sig").alias("sig"))
    nodes = durable(nodes)
    # bands: buckets of one node end here, and so do buckets with the same members as another
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * (2 * ROWS) + 1, F.lit(2 * ROWS)))))
    banded = nodes.select("node", band.alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("x")).filter("size > 1")
    buckets = durable(buckets.groupBy("size", "x").agg(F.min("bucket").alias("bucket")))
    members = banded.join(buckets.select("bucket", "size"), "bucket").join(nodes.select("node", "sig"), "node")
    units = _units(members, "bucket", "size", 4 * block).select("unit", "i", "j", "block", "node", "sig")
    near = units.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j").mapInArrow(_prune(need), "a binary, b binary")
    comp = durable(components(near).withColumnRenamed("root", "comp"))
    # one fetch of the texts whose nodes have a candidate, then exact similarity inside the components
    sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    wanted = comp.join(sizes, "comp").join(nodes.select("node", "docs", "k1"), "node")
    sets = keyed.select("k1", "text").join(wanted, "k1").select("text", "node", "docs", "comp", "size").mapInArrow(
        _sets(k), "node binary, docs long, comp binary, size long, shingles binary, sig binary")
    unrepeated = signed.filter(F.col("node").isNotNull()).groupBy("k1", "node").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()
    sets = sets if unrepeated else sets.dropDuplicates(["node"])
    units = _units(sets, "comp", "size", block).select("unit", "i", "j", "block", "node", "docs", "shingles", "sig")
    links = durable(units.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j").mapInArrow(_verify(need, threshold), "a binary, b binary, links long"))
    root = components(links)
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    facts = nodes.select("node", "docs", "least_id", "k1").join(root, "node", "left").join(counts, "node", "left")
    facts = facts.withColumn("root", F.coalesce("root", "node"))
    least = facts.groupBy("root").agg(F.coalesce(F.min("least_id"), F.min("k1")).alias("class_id"))
    facts = durable(facts.join(least, "root").select("node", "docs", "class_id", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links")))
    out = join_facts(signed.select("doc_id", "k1", "k2", "node", F.col("n").alias("n_shingles")), facts, "node", "docs", ["k1", "k2"])
    out = out.withColumn("class_id", F.coalesce("class_id", "k1")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return out.select("k1", "k2", "doc_id", "n_shingles", "class_id", "n_links", (F.col("k1") == F.col("class_id")).alias("keep"))


def keep_one_of_each_class(docs: DataFrame, **how) -> DataFrame:
    """The documents, one of each class of near duplicates (the smallest id), with their own columns."""
    stay = durable(similarity_classes(docs, **how).filter("keep").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_rows")))
    whole = row_keys(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")))
    out = whole.join(stay, ["k1", "k2"])
    if not stay.filter("_rows > 1").isEmpty():      # repeated rows are copies: one of them stays, the same at every run
        out = out.groupBy("k1", "k2").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return out.select("_row.*")
