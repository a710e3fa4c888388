"""Operator 7, near-duplicates by MinHash bands with sequential Bayesian verification.

1. A pass over the texts makes each document's set of five-word shingles (64-bit hashes), a digest of the set, 200
   MinHash values and the keys of 40 bands of 5. Documents with equal sets form a class, a node from here on.
2. In every bucket (nodes that share a band) each member is paired with the bucket's leader, the member that meets
   most others over all its buckets: a star, so a bucket of n members makes n pairs, not n * n. The buckets of a group of
   copies tend to have one leader, the text that the others are copies of. Each member is first verified with the best of
   its leaders alone; the others are met only in buckets that are open then, by members of other components.
3. Pairs are verified in batches of signature values: after each batch a pair is dropped if the posterior probability
   that its similarity reaches the threshold (uniform prior) is below `MISS`. Survivors are compared on their full sets.
4. Verified links give components. Buckets whose members now lie in one component are finished. In the others the
   pairs across components remain: of up to `SMALL_BUCKET` members all of them. Larger buckets are merged by their
   leader's component. What most members of a group share, which is what makes it large, joins nothing: each member
   is the list of shingles in which it differs from that, and these lists tell which members are similar. A star is led by
   the one that differs least. Groups of at most BLOCKS blocks are compared block by block, in cells of two blocks each
   that give only links, so that their pairs are no rows. In larger ones members who differ in so few that they must be similar
   are so with the leader; all others meet under the first of their lists, rarest first (`_split`), and keys that
   many share are groups again, of at most half the members. No pair above the threshold is in none of them. This ends when
   all pairs of the groups left are no more than the table has texts (they are compared as pairs), or after `DEPTH` times,
   the last of which compares all groups by blocks.

A pair at similarity 0.75 shares no band with probability 2e-5, at 0.8 with 1e-7.

Distribution: keys with many rows (a text that a third of the table repeats, a band of a large group) are joined by
broadcast of that key (`join_counted`), counts are added up before they are shuffled.

Defined results: null, empty and blank texts have no shingles, are linked with nothing and kept; every row has the
component of its own text, so rows that share an id may differ; a null id counts as larger than any other and is
returned as null; ties go to the smallest id; an empty table gives no rows; other columns are ignored, whatever their
names. The pipeline stage keeps one row of each component, the one with the smallest id (of equal ids the one with the
smallest text hash; of rows that repeat both, one).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrium.llm.common import bounded_batches, cut_lineage, join_counted, leaves_nothing, let_go, read, release
from calibrium.llm.graph import components

WIDTH, PERCENT = 5, 75
BANDS, ROWS = 40, 5
MISS, BATCH = 1e-6, 40
SMALL_BUCKET, DEPTH, SHARE, LEADERS, TIERS = 32, 6, 64, 4, 4
#: Members of a block and of what is listed for them; blocks of a group up to which all are compared.
BLOCK, BLOCK_LIST, BLOCKS = 128, 1 << 17, 64
#: Ids (8 bytes each) up to which a set of documents to be read again is broadcast; beyond, it is joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Documents to a file of the held tables: of a document come up to BANDS rows, or its set.
DOCS_A_FILE = 2_500
#: Words whose hashes a worker keeps: some ten MB, as idle workers keep theirs too.
WORDS_HELD = 1 << 16
NO_ID = (1 << 63) - 1

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """Memo of words' hashes, emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, memo: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    k = min(width, n)
    total = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        total = _mix(total * _MULTIPLIERS[j % 5] + w[j : n - k + 1 + j])
    return np.unique(total)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.uint64)
    step = max(1, 200_000 // max(1, len(found)))
    for i in range(0, len(a), step):
        out[i : i + step] = (found[None, :] * a[i : i + step, None] + b[i : i + step, None]).min(axis=1)
    return out


def _sign(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        memo, (a, b) = WordHashes(), _permutations(bands * rows)
        salt = _mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = shingles(text, memo)
                out[0].append(len(found))
                if not len(found):
                    for x in out[1:]:
                        x.append(None)
                    continue
                out[1].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                full = signature(found, a, b)
                key = salt.copy()
                for column in full.reshape(bands, rows).T:
                    key = _mix(key * _MULTIPLIERS[0] + column)
                out[2].append(key.view(np.int64))
                out[3].append((full >> np.uint64(40)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())], names=["doc_id", "th", "n_shingles", "digest", "bands", "sig"])

    return docs.mapInArrow(leaves_nothing(sign), "doc_id long, th long, n_shingles long, digest binary, bands array<long>, sig binary")


def least_matches(size: int, percent: int = PERCENT, miss: float = MISS, batch: int = BATCH) -> list[tuple[int, int]]:
    """After n values compared: the fewest equal ones with which P(similarity >= threshold) is at least `miss`.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1), and P(s >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(batch, size + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _bayes(pairs: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) that the signature doesn't rule out."""
    tests = least_matches(size)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, size) for i in (2, 3))
            alive, matches, at = np.arange(len(left)), np.zeros(len(left), np.int64), 0
            for n, least in tests:
                matches = matches + (left[alive, at:n] == right[alive, at:n]).sum(axis=1)
                keep = matches >= least
                alive, matches, at = alive[keep], matches[keep], n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], names=["a", "b"])

    return pairs.mapInArrow(prune, "a long, b long")


def _few(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """df, for broadcast if it has at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _sets(texts: DataFrame, nodes: DataFrame, ids: DataFrame, files: int) -> DataFrame:
    """(node, shingles as bytes) of the given nodes (held), each from its first text."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            found = [shingles(x, memo).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "hashes"])

    wanted = cut_lineage(nodes.select("node", "low.doc_id", "low.th").join(_few(ids), "node", "left_semi"), files)
    found = texts.join(_few(wanted), ["doc_id", "th"]).select("node", "text").mapInArrow(leaves_nothing(gather), "node long, hashes binary")
    held = cut_lineage(found.groupBy("node").agg(F.first("hashes").alias("hashes")), files)  # a row and its repeats give one
    release(wanted)
    return held


def _exact(pairs: DataFrame, percent: int) -> DataFrame:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.mapInArrow(leaves_nothing(compare), "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int, files: int) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets; held."""
    sig = nodes.select("node", "sig")
    signed = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    alive = cut_lineage(_bayes(signed, size), files)
    ids = cut_lineage(alive.select(F.col("a").alias("node")).union(alive.select("b")).distinct(), files)
    sets = _sets(texts, nodes, ids, files)
    full = alive.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    out = cut_lineage(_exact(full, percent), files)
    release(alive, ids, sets)
    return out


def _across(members: DataFrame, key: str, percent: int) -> DataFrame:
    """Pairs under one key, of different components and of sizes that allow the similarity."""
    x, y = (members.select(key, *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "component")]) for s in "ab")
    fits = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return x.join(y, key).where(fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _placed(members: DataFrame, component: DataFrame) -> DataFrame:
    """members with their components; a node without links is its own."""
    return members.drop("component").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _merged(component: DataFrame, links: DataFrame, files: int) -> DataFrame:
    """Components (node, component) after further links (a, b); held."""
    if links.isEmpty():
        return component
    named = links.join(component.toDF("a", "ca"), "a", "left").join(component.toDF("b", "cb"), "b", "left")
    second = components(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), files)
    known = component.join(second.toDF("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return cut_lineage(known.union(second.join(component, "node", "left_anti")), files)


def _open(groups: DataFrame, key: str) -> DataFrame:
    """The rows of groups whose members lie in several components."""
    keys = groups.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("of")).where("lo < hi").select(key, "of")
    return join_counted(groups, keys, [key], "of").drop("of")


def _cored(groups: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, files: int) -> DataFrame:
    """groups (g, node, n, component) with own, in which shingles a member differs from what most members of its group have;
    d, how many these are; and f, (100 + percent) * d - (100 - percent) * n; held. The rarest of own come first: the
    shingles of no more than SMALL_BUCKET or 1/SHARE of the members by their hash, the others by how many differ in them.
    So the shingles that are counted for a group, its core, are as many as SHARE times a text's at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(0).to_numpy()
            for x in np.unique(g):
                held = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(1).filter(pa.array(g == x))]
                h, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), x)), pa.array(h), pa.array(n)], names=["g", "h", "n"])

    def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores: dict = {}
            d, own = [], []
            for g, size, x, core in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), batch.column(5), batch.column(6)):
                if g not in cores:
                    h, n = (c.to_numpy() for c in core.values.flatten())
                    most = 2 * n > size
                    order = np.lexsort((h, np.where(most, size - n, n)))
                    cores[g] = h[order], most[order]
                x, (h, most) = np.frombuffer(x.as_buffer(), np.int64), cores[g]
                own.append(np.concatenate((x[~np.isin(x, h, assume_unique=True)], h[np.isin(h, x, assume_unique=True) ^ most])))
                d.append(len(own[-1]))
            d = np.array(d, np.int64)
            f = (100 + percent) * d - (100 - percent) * batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(d), pa.array(f), pa.array(own, pa.list_(pa.int64()))], names=["g", "node", "n", "component", "d", "f", "own"])

    sets = _sets(texts, nodes, groups.select("node").distinct(), files)
    sizes = cut_lineage(groups.groupBy("g").agg(F.count("*").alias("size")), files)
    held = cut_lineage(join_counted(groups, sizes, ["g"], "size").join(sets, "node"), files)
    common = held.select("g", "hashes").mapInArrow(count, "g long, h long, n long").groupBy("g", "h").agg(F.sum("n").alias("n"))
    common = common.join(_few(sizes, 100_000), "g").where((F.col("n") > SMALL_BUCKET) & (F.col("n") * SHARE >= F.col("size")))
    cores = cut_lineage(common.groupBy("g").agg(F.collect_list(F.struct("h", "n")).alias("core")), files)
    none = F.coalesce("core", F.array().cast("array<struct<h:long,n:long>>")).alias("core")
    out = held.join(_few(cores, 2_000), "g", "left").select("g", "node", "n", "component", "size", "hashes", none)
    out = cut_lineage(out.mapInArrow(leaves_nothing(differing), "g long, node long, n long, component long, d long, f long, own array<long>"), files)
    release(sets, sizes, held, cores)
    return out


def _fit(x: str, y: str, percent: int) -> Column:
    """Whether sizes and differences from the group allow the similarity of two members (columns n_ and d_)."""
    sizes = F.least(f"n_{x}", f"n_{y}") * 100 >= F.greatest(f"n_{x}", f"n_{y}") * percent
    return sizes & (F.abs(F.col(f"d_{x}") - F.col(f"d_{y}")) * (100 + percent) <= (F.col(f"n_{x}") + F.col(f"n_{y}")) * (100 - percent))


def _stars(held: DataFrame, percent: int) -> DataFrame:
    """Pairs of LEADERS members of a group, the one with the smallest f among them, with all members of other components."""
    leaders = held.groupBy("g", (F.col("node") % LEADERS).alias("k")).agg(F.min(F.struct("f", "node", "component", "n", "d")).alias("x"))
    leaders = leaders.select("g", *[F.col(f"x.{c}").alias(f"{c}_a") for c in ("node", "component", "n", "d")])
    pairs = held.withColumnsRenamed({"n": "n_b", "d": "d_b"}).join(_few(leaders, 100_000), "g").where((F.col("component") != F.col("component_a")) & _fit("a", "b", percent))
    return pairs.select(F.least("node_a", "node").alias("a"), F.greatest("node_a", "node").alias("b")).distinct()


def _split(held: DataFrame, percent: int, files: int) -> tuple[DataFrame, DataFrame]:
    """Groups of `_cored` as smaller ones (g, node, n, component), and pairs (a, b); both held.

    u and x are similar if they differ in at most (100 - p) / (100 + p) * (|u| + |x|) shingles, and they differ in what only
    one of own(u) and own(x) has. So they need o >= (f(u) + f(x)) / (2 * (100 + p)) of own in common. If that is not
    above 0 they are similar whatever they share, and so are both with the member of the smallest f: `_stars` has them. Other
    pairs meet under one of the rarest d - o + 1 of own. Of a pair the one with the smaller f is looked up by the other; f
    falls into TIERS ranges, so a few members near to what most have don't make the others' lists longer than for themselves.
    Keys under which many members of several components meet are groups of their own, of at most half the members.
    """
    ends = held.groupBy("g").agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    tier = F.floor((F.col("f") - F.col("lo")) * TIERS / (F.col("hi") - F.col("lo") + 1)).alias("tier")
    tiered = cut_lineage(held.join(_few(ends, 100_000), "g").select("g", "node", "n", "component", "d", "f", "own", tier), files)
    tiers = tiered.groupBy("g", "tier").agg(F.min("f").alias("low")).groupBy("g").agg(F.collect_list(F.struct("tier", "low")).alias("tiers"))
    up_to = lambda twice_o: (F.col("d") - F.greatest(F.lit(1), F.ceil(twice_o / (2 * (100 + percent)))) + 1).cast("int")
    lists = tiered.join(_few(tiers, 100_000), "g").withColumn("at", F.explode(F.filter("tiers", lambda t: t["tier"] <= F.col("tier"))))
    lists = lists.withColumn("own", F.slice("own", F.lit(1), up_to(F.col("f") + F.col("at.low"))))
    sought = (F.col("at.tier") == F.col("tier")) & (F.col("pos") < up_to(2 * F.col("f")))
    met = lists.select("g", "node", "n", "component", "d", "f", "tier", "at", F.posexplode("own").alias("pos", "h"))
    met = cut_lineage(met.select(F.xxhash64("g", "at.tier", "h").alias("g"), "node", "n", "component", "d", "f", sought.alias("sought")), files)

    h = F.xxhash64("node")
    each = met.groupBy("g", "component").agg(F.count("*").alias("of"), F.count_if("sought").alias("sought"), F.bit_xor(h).alias("x"), F.sum(h % 1_000_003).alias("y"))
    keys = each.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("of").alias("of"), F.max("of").alias("main"), F.sum("sought").alias("sought"), F.bit_xor("x").alias("x"), F.sum("y").alias("y"))
    keys = keys.where("lo < hi AND sought > 0").withColumn("heavy", F.least("sought", F.col("of") - F.col("main")) > SMALL_BUCKET)
    keys = cut_lineage(keys.groupBy("heavy", "of", "x", "y", F.when(~F.col("heavy"), F.col("g")).alias("light")).agg(F.min("g").alias("g")).select("g", "of", "heavy"), files)  # groups of the same members count once
    open_ = cut_lineage(join_counted(met, keys, ["g"], "of").drop("of"), files)
    light = open_.where("NOT heavy")
    x, y = (light.where(w).select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "component", "d", "f")]) for s, w in (("a", "sought"), ("b", "true")))
    ordered = (F.col("component_a") != F.col("component_b")) & (F.struct("f_a", "node_a") < F.struct("f_b", "node_b"))
    pairs = x.join(y, "g").where(ordered & _fit("a", "b", percent)).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    out = cut_lineage(open_.where("heavy").select("g", "node", "n", "component"), files), cut_lineage(pairs, files)
    release(tiered, met, keys, open_)
    return out


def _blocked(held: DataFrame, percent: int, blocks: int | None) -> tuple[DataFrame, DataFrame]:
    """Groups of `_cored` of at most `blocks` blocks, or all: their members (g, node, component, f, own) by cells, each
    two blocks that are compared; and the other groups, as they are. Members are dealt by sizes first, so that only those of
    a range or of two that follow one another can be similar; a block has about BLOCK members, fewer if their lists are long."""
    width = max(0.01, 1.001 * math.log(100 / percent))
    ranged = held.withColumn("range", F.floor(F.log("n") / width))
    counted = ranged.groupBy("g", "range").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("d") / BLOCK_LIST)).alias("of"))
    ranges = counted.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("range", "of"))).alias("ofs"), F.sum("of").alias("blocks"))
    ranged = ranged.join(_few(ranges, 100_000), "g")
    few = ranged.where(F.col("blocks") <= blocks) if blocks is not None else ranged
    few = few.withColumn("block", F.pmod(F.xxhash64("node"), F.element_at("ofs", F.col("range"))))
    places = lambda at: F.transform(F.sequence(F.lit(1), F.coalesce(F.try_element_at("ofs", at), F.lit(0)).cast("long")), lambda i: i - 1)
    # (range, block) of the left and of the right side of a cell, and whether the member stands on either
    other = lambda at: F.when(F.coalesce(F.try_element_at("ofs", at), F.lit(0)) > 0, places(at)).otherwise(F.array().cast("array<long>"))
    cell = lambda right, i, j, l, r: F.struct((F.col("range") - (0 if right != -1 else 1)).alias("range"), F.lit(right != 0).alias("next"), i.alias("i"), j.alias("j"), l.alias("left"), r.alias("right"))
    own = F.transform(other(F.col("range")), lambda k: cell(0, F.least(k, F.col("block")), F.greatest(k, F.col("block")), F.col("block") <= k, F.col("block") >= k))
    above = F.transform(other(F.col("range") + 1), lambda k: cell(1, F.col("block"), k, F.lit(True), F.lit(False)))
    below = F.transform(other(F.col("range") - 1), lambda k: cell(-1, k, F.col("block"), F.lit(False), F.lit(True)))
    cells = few.withColumn("cell", F.explode(F.concat(own, above, below)))
    cells = cells.select("g", "cell.range", "cell.next", "cell.i", "cell.j", "cell.left", "cell.right", "node", "component", "f", "own")
    return cells, ranged.where(F.col("blocks") > blocks).select(*held.columns) if blocks is not None else ranged.limit(0).select(*held.columns)


def _compared(cells: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components within each cell; similar pairs beyond these link nothing more. What two members
    have of own in common tells exactly whether they are similar (see `_split`)."""

    def compare(table: pa.Table) -> pa.Table:
        left, right, node, component, f = (table.column(c).to_numpy() for c in ("left", "right", "node", "component", "f"))
        own = table.column("own").combine_chunks()
        lengths, values = np.diff(own.offsets.to_numpy()), own.flatten().to_numpy()
        row = np.repeat(np.arange(len(node)), lengths)
        at = [np.flatnonzero(s) for s in (left, right)]
        common = np.intersect1d(values[left[row]], values[right[row]])
        column = np.searchsorted(common, values)
        known = column < len(common)
        known[known] = common[column[known]] == values[known]
        row, column, shared = row[known], column[known], np.zeros((len(at[0]), len(at[1])), np.float32)
        for k in range(0, len(common), 2_048):
            here = (column >= k) & (column < k + 2_048)
            has = np.zeros((len(node), min(2_048, len(common) - k)), np.float32)
            has[row[here], column[here] - k] = 1
            shared += has[at[0]] @ has[at[1]].T
        fits = (2 * (100 + percent) * shared.astype(np.int64) >= f[at[0]][:, None] + f[at[1]][None, :]) & (component[at[0]][:, None] != component[at[1]][None, :])
        top: dict = {}

        def of(c: int) -> int:
            while (up := top.get(c, c)) != c:
                top[c] = c = top.get(up, up)
            return c

        out: tuple[list, list] = ([], [])
        for i, j in zip(*(x.tolist() for x in np.nonzero(fits))):
            i, j = at[0][i], at[1][j]
            x, y = of(component[i]), of(component[j])
            if x != y:
                top[x] = y
                out[0].append(min(node[i], node[j]))
                out[1].append(max(node[i], node[j]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return cells.groupBy("g", "range", "next", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, pair_rows: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row, and th and first: the text's hash, and whether the row is the
    one of its component that stays. pair_rows: pairs up to which groups are compared member by member, the number of texts by default."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    signed = cut_lineage(_sign(texts, bands, rows))
    files = signed.count() // DOCS_A_FILE + 1
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("low"), F.count("*").alias("rows"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()), files)
    size = bands * rows

    exploded = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = cut_lineage(exploded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), files)
    members = cut_lineage(join_counted(exploded, shared, ["key"]), files)
    met = cut_lineage(members.groupBy("node").agg(F.sum("members").alias("met")), files)
    leaders = cut_lineage(members.join(met, "node").groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("minus"))).alias("x"), F.count("*").alias("of")).select("key", (-F.col("x.minus")).alias("leader"), F.col("x.met").alias("led_met"), "of"), files)
    release(shared)
    led = cut_lineage(join_counted(members, leaders, ["key"], "of").drop("of"), files)
    release(members, leaders)
    pair = [F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")]
    best = led.where("node <> leader").groupBy("node").agg(F.max(F.struct("led_met", (-F.col("leader")).alias("minus"))).alias("x"))
    first = cut_lineage(best.select("node", (-F.col("x.minus")).alias("leader")).select(*pair).distinct(), files)
    component = cut_lineage(components(_verified(first, nodes, texts, size, percent, files), files), files)

    at = component.toDF("leader", "led_component")
    still = _open(cut_lineage(_placed(led, component), files), "key").where("node <> leader").join(at, "leader", "left")
    star = still.where("component <> coalesce(led_component, leader)").select(*pair).distinct().join(first, ["a", "b"], "left_anti")
    component = _merged(component, _verified(star, nodes, texts, size, percent, files), files)
    release(first)

    rest = cut_lineage(_open(cut_lineage(_placed(led, component), files), "key"), files)
    tested = rest.where("node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    large = rest.where(F.col("members") > SMALL_BUCKET)
    home = component.select(F.col("node").alias("leader"), F.col("component").alias("g"))
    named = cut_lineage(large.join(home, "leader", "left").withColumn("g", F.coalesce("g", "leader")).select("g", "node", "n", "component").distinct(), files)
    pairs = _across(rest.where(F.col("members") <= SMALL_BUCKET), "key", percent).join(tested, ["a", "b"], "left_anti")
    component = _merged(component, _verified(pairs, nodes, texts, size, percent, files), files)
    release(led, rest)

    groups, total = cut_lineage(_open(cut_lineage(_placed(named, component), files), "g"), files), pair_rows if pair_rows is not None else nodes.count()
    for k in range(DEPTH):
        left = groups.groupBy("g").count().agg(F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0))).first()[0]
        if left <= total:
            break
        held = _cored(groups, nodes, texts, percent, files)
        component = _merged(component, _verified(_stars(held, percent), nodes, texts, size, percent, files), files)
        still = cut_lineage(_open(cut_lineage(_placed(held, component), files), "g"), files)
        release(held)
        cells, wide = _blocked(still, percent, BLOCKS if k < DEPTH - 1 else None)
        links, wide = cut_lineage(_compared(cells, percent), files), cut_lineage(wide, files)
        component = _merged(component, links, files)
        groups = wide.select("g", "node", "n", "component")
        if not wide.isEmpty():
            smaller, pairs = _split(wide, percent, files)
            component = _merged(component, _verified(pairs, nodes, texts, size, percent, files), files)
            groups = cut_lineage(_open(cut_lineage(_placed(smaller, component), files), "g"), files)
            release(smaller, pairs, wide)
        release(still, links)
    if not groups.isEmpty():
        component = _merged(component, _verified(_across(groups, "g", percent), nodes, texts, size, percent, files), files)

    known = nodes.select("digest", "node", "low", "rows").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tops = known.groupBy("component").agg(F.min("low").alias("top"), F.count("*").alias("of"))
    named = cut_lineage(join_counted(cut_lineage(known, files), cut_lineage(tops, files), ["component"], "of").select("digest", "rows", "top"), files)
    release(nodes, met)
    some = join_counted(signed.where("n_shingles > 0").select("doc_id", "th", "n_shingles", "digest"), named, ["digest"], "rows").select("doc_id", "th", "n_shingles", "top")
    none = signed.where("n_shingles = 0").select("doc_id", "th", "n_shingles", F.struct("doc_id", "th").alias("top"))
    out = some.union(none)
    shown = lambda c: F.when(c != NO_ID, c)
    first = (F.col("n_shingles") == 0) | ((F.col("doc_id") == F.col("top.doc_id")) & (F.col("th") == F.col("top.th")))
    return out.select(shown(F.col("doc_id")).alias("doc_id"), "n_shingles", shown(F.col("top.doc_id")).alias("component_id"), (F.col("doc_id") == F.col("top.doc_id")).alias("kept"), "th", first.alias("first"))


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("th", "first")


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of near-duplicates, that with the smallest id. Rows without words all stay."""
    judged = cut_lineage(near_duplicates(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("th").alias("__th"), "first", F.col("n_shingles") > 0))
    judged = judged.toDF("__id", "__th", "first", "some")
    gone = judged.where("NOT first").select("__id", "__th").distinct()
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__th": F.xxhash64("text")})
    left = keyed.join(_few(cut_lineage(gone)), ["__id", "__th"], "left_anti")
    again = cut_lineage(judged.where("first AND some").groupBy("__id", "__th").count().where("count > 1").select("__id", "__th"))
    if not again.isEmpty():
        repeated = left.join(_few(again), ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"])
        left = left.join(_few(again), ["__id", "__th"], "left_anti").unionByName(repeated)
    return left.select(*docs.columns)
