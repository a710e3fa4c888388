"""Operator 13, a trie of conversations by shared first turns.

Every conversation is rebuilt from the first turns of its base conversation and its own later ones; a node of the trie is
a distinct sequence of first turns. A node tells its smallest member, its members, children, leaves below it, the tokens
that sharing prefixes saves in its subtree, and a digest of the members that end there.

Distribution. Turns become digests of 128 bits and word counts before anything moves, so no text is shuffled. A
conversation is one row, its path the digests in order (32 characters a turn): the longest conversation is the unit that
a task must hold. Equal paths become one row with a count; their ids are sorted by range partitions, joined to pieces of
text there, and only the pieces of a path meet in one task, which hashes them as a stream: a digest of ids in order can't
be put together from parts. Paths are dealt by the digest of the first turn to tasks that build tries of dictionaries and
sum them up from the last node to the first, children before parents. A first turn whose paths hold more than a task's
share of turns (`limit`) is not built whole: its longest common prefix becomes a chain of nodes, the paths are dealt
anew by the turn after it, again and again while subtries are too large, and the sums of the subtries' tops add up to
those of the chain. So no group grows with a hot first turn, and a single path that is too long is only such a chain.

Defined results: rows with a null conversation id belong to none and are left out; a null role or text is empty; a null
turn comes first, equal turns go by their digest, repeated rows are turns each; a conversation whose base is absent or
shorter takes what there is; a conversation rebuilt without turns ends at the root; an empty table gives no
nodes; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrium.llm.common import cut_lineage, join_counted, read, release
from calibrium.llm.resample import CRC, CRC_TABLE

BASE_STEP, HEADS, WIDTH = 20, 4, 32
#: Turns of a task's share of the tries, at least and at most; ids that a piece of text joins.
LEAST_TURNS, MOST_TURNS, PIECE_IDS = 1_000, 50_000, 65_536
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODES = "parent string, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, WIDTH)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, words of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = _key(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))


def heads_of(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path, words (an array) of every conversation, rebuilt."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    placed = cut_lineage(turn_rows(conversations).withColumn("pos", F.row_number().over(order)).drop("turn"))
    each = placed.where("pos = 1").select("conv_id", heads_of(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % BASE_STEP).alias("base"))
    heads = placed.where((F.col("pos") < HEADS) & (F.col("conv_id") % BASE_STEP == 0)).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    taken = each.join(heads, "base").where("pos <= h").select("conv_id", F.lit(0).alias("part"), "pos", "digest", "words")
    own = placed.where(F.col("pos") > heads_of(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "pos", "digest", "words")
    there = each.select("conv_id", F.lit(2).alias("part"), F.lit(0).alias("pos"), F.lit("").alias("digest"), F.lit(0).alias("words"))
    steps = taken.union(own).union(there).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "pos", "digest", "words"))).alias("s"))
    steps = steps.select("conv_id", F.slice("s", F.lit(1), F.size("s") - 1).alias("s"))  # `there` is the last
    return steps.select("conv_id", F.array_join("s.digest", "").alias("path"), F.col("s.words").alias("words"))


def ends(members: DataFrame) -> DataFrame:
    """pid, conv_id (the smallest), n and sha256 of the ids in order, of each path. members: pid, conv_id."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        pid, ids = None, []

        def close() -> None:
            if ids:
                out.append((pid, ids[0], len(ids), ",".join(map(str, ids))))
                ids.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["pid", "first", "n", "ids"])

        for batch in batches:
            for p, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != pid or len(ids) >= PIECE_IDS:
                    close()
                    pid = p
                ids.append(conv)
            yield batch_of(out)
            out.clear()
        close()
        yield batch_of(out)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []

        def done(rows: list) -> pa.RecordBatch:
            columns = list(zip(*[(p, first, n, h.hexdigest()) for p, first, n, h in rows])) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["pid", "conv_id", "n", "sha"])

        for batch in batches:
            out = []
            for p, first, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                if state and state[0] == p:
                    state[2] += n
                    state[3].update(b"," + text.encode())
                else:
                    if state:
                        out.append(tuple(state))
                    state = [p, first, n, hashlib.sha256(text.encode())]
            yield done(out)
        yield done([tuple(state)] if state else [])

    parts = members.select("pid", "conv_id").repartitionByRange("pid", "conv_id").sortWithinPartitions("pid", "conv_id").mapInArrow(pieces, "pid string, first long, n long, ids string")
    return parts.repartition("pid").sortWithinPartitions("pid", "first").mapInArrow(hashed, "pid string, conv_id long, n long, sha string")


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the subtries of one bucket. rows: g, d, parent, path, words, n, conv_id, sha; g and d are the top of a path's subtrie."""
    down: dict[tuple, int] = {}
    above, depth, words, convs, least, sha, group = [], [], [], [], [], [], []
    for g, d, parent, path, path_words, n, conv, end in zip(*(rows[c] for c in ("g", "d", "parent", "path", "words", "n", "conv_id", "sha"))):
        node = -1
        for at in range(d, len(path) // WIDTH + 1):
            step = (node, g if at == d else path[WIDTH * (at - 1) : WIDTH * at])
            here = down.get(step)
            if here is None:
                here = down[step] = len(above)
                above.append(node)
                depth.append(at)
                words.append(int(path_words[at - 1]))
                convs.append(0)
                least.append(conv)
                sha.append(EMPTY_SHA)
                group.append(parent if at == d else None)
            convs[here] += n
            least[here] = min(least[here], conv)
            node = here
        sha[node] = end
    children, leaves, saved = [0] * len(above), [0] * len(above), [0] * len(above)
    for node in range(len(above) - 1, -1, -1):  # parents were numbered before their children
        leaves[node] = leaves[node] or 1
        saved[node] += (convs[node] - 1) * words[node]
        if above[node] >= 0:
            children[above[node]] += 1
            leaves[above[node]] += leaves[node]
            saved[above[node]] += saved[node]
    parents = pd.array([least[a] if a >= 0 else None for a in above], dtype="Int64")
    return pd.DataFrame({"parent": group, "top": [a < 0 for a in above], "conv_id": least, "depth": depth, "parent_conv_id": parents, "n_convs": convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": sha})


def _chains(rows: DataFrame) -> DataFrame:
    """A row for each subtrie of rows: its top, longest common prefix l, the words of its chain, and the path that ends at l."""
    same = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.length("lo"), F.length("hi")) / WIDTH).cast("int")),
        F.lit(0),
        lambda a, i: F.when((a == i - 1) & (F.substring("lo", 1 + (i - 1) * WIDTH, WIDTH) == F.substring("hi", 1 + (i - 1) * WIDTH, WIDTH)), i).otherwise(a),
    )
    found = rows.groupBy("g", "d", "parent").agg(F.min("path").alias("lo"), F.max("path").alias("hi"), F.min_by("words", "path").alias("words"))
    return found.withColumn("l", same).select("g", "d", "parent", "l", F.slice("words", F.col("d"), F.col("l") - F.col("d") + 1).alias("chain"))


def trie(conversations: DataFrame, least_turns: int = LEAST_TURNS, most_turns: int = MOST_TURNS) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    all_paths = cut_lineage(rebuilt_paths(conversations).withColumn("pid", _key(F.col("path"))))
    paths = cut_lineage(all_paths.join(ends(all_paths), ["pid", "conv_id"]).select("path", "words", "n", "conv_id", "sha", (F.length("path") / WIDTH).cast("int").alias("turns")))
    release(all_paths)
    total = paths.agg(F.coalesce(F.sum("turns"), F.lit(0))).first()[0]
    share = max(1, min(most_turns, max(least_turns, total // int(spark.conf.get("spark.sql.shuffle.partitions")))))

    rows = paths.withColumns({"g": F.lit(""), "d": F.lit(0), "parent": F.lit(None).cast("string")})
    root = spark.range(1).select(F.lit("").alias("g"), F.lit(0).alias("d"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("l"), F.array(F.lit(0)).alias("chain"))
    levels, small = [], None
    while True:
        if not levels:
            large, left, chains = rows, None, root
        else:
            sizes = rows.groupBy("g").agg(F.sum(F.col("turns") - F.col("d") + 1).alias("members"))
            big = cut_lineage(sizes.where(F.col("members") > share), 1)
            left = rows.join(F.broadcast(big.select("g")), "g", "left_anti") if big.limit(200_001).count() <= 200_000 else rows.join(big.select("g"), "g", "left_anti")
            if big.isEmpty():
                small = rows if small is None else small.unionByName(rows)
                break
            large = join_counted(rows, big, ["g"], hot=1).drop("members")
            chains = cut_lineage(_chains(large), 8)
        known = chains.select("g", "l")
        at = large.join(F.broadcast(known), "g") if known.limit(200_001).count() <= 200_000 else large.join(known, "g")
        stops = at.where(F.col("turns") == F.col("l")).select("g", F.col("n").alias("end_n"), F.col("conv_id").alias("end_conv"), "sha")
        levels.append(cut_lineage(chains.join(stops, "g", "left"), 8))
        on = at.where(F.col("turns") > F.col("l"))
        deeper = on.select("path", "words", "n", "conv_id", "sha", "turns", _key(F.substring(F.col("path"), F.lit(1), (F.col("l") + 1) * WIDTH)).alias("g"), (F.col("l") + 1).alias("d"), F.col("g").alias("parent"))
        if left is not None:
            small = left if small is None else small.unionByName(left)
        rows = cut_lineage(deeper) if levels[1:] else deeper

    buckets = max(1, -(-int(total) // share))
    dealt = small.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))
    built = cut_lineage(dealt.groupBy("bucket").applyInPandas(build, NODES))

    sums = ["parent", "conv_id", "n_convs", "n_leaves", "saved_tokens"]
    tops, nodes = built.where("top").select(*sums), [built]
    uppers = None
    for level in reversed(levels):
        kids = tops.groupBy("parent").agg(F.min("conv_id").alias("k_conv"), F.sum("n_convs").alias("k_n"), F.count("*").alias("kids"), F.sum("n_leaves").alias("k_leaves"), F.sum("saved_tokens").alias("k_saved"))
        joined = level.join(kids.withColumnRenamed("parent", "g"), "g", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        one = joined.select("g", "parent", "d", "l", F.explode(F.sequence("d", "l")).alias("depth"), "chain", F.least("k_conv", "end_conv").alias("conv_id"), (zero("k_n") + zero("end_n")).alias("n_convs"), zero("kids").alias("kids"), F.greatest(zero("k_leaves"), F.lit(1)).alias("n_leaves"), zero("k_saved").alias("k_saved"), "sha")
        below = Window.partitionBy("g").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        saves = F.when(F.col("n_convs") > 0, (F.col("n_convs") - 1) * F.get("chain", F.col("depth") - F.col("d"))).otherwise(0)
        last = F.col("depth") == F.col("l")
        held = cut_lineage(
            one.select(
                "g", F.when(F.col("depth") == F.col("d"), F.col("parent")).alias("parent"), (F.col("depth") == F.col("d")).alias("top"), "conv_id", F.col("depth").cast("long").alias("depth"),
                F.when(F.col("depth") > F.col("d"), F.col("conv_id")).alias("parent_conv_id"), F.col("n_convs").cast("long").alias("n_convs"), F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
                (F.col("k_saved") + F.sum(saves).over(below)).cast("long").alias("saved_tokens"), F.when(last, F.coalesce("sha", F.lit(EMPTY_SHA))).otherwise(EMPTY_SHA).alias("ends_sha256"), last.alias("last"),
            )
        )
        tops = tops.unionByName(held.where("top AND n_convs > 0").select(*sums))
        nodes.append(held.drop("g", "last"))
        named = held.where("last").select(F.col("g").alias("parent"), F.col("conv_id").alias("above"), F.col("n_children").alias("members"))
        uppers = named if uppers is None else uppers.unionByName(named)
    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    inner = every.where("n_convs > 0 AND (NOT top OR parent IS NULL)").select(*NODE)
    hung = join_counted(every.where("top AND parent IS NOT NULL").drop("parent_conv_id"), uppers, ["parent"])
    return inner.unionByName(hung.withColumn("parent_conv_id", F.col("above")).select(*NODE))


def op13_conversation_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(read(spark, sf_dir, "conversations"))


ORACLE_SQL = f"""
WITH {CRC_TABLE},
turns AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS digest,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM turns),
ids AS (SELECT DISTINCT conv_id, hex(encode(conv_id::VARCHAR)) AS f_hex FROM placed),
each AS (SELECT conv_id, conv_id - conv_id % {BASE_STEP} AS base, {CRC} % {HEADS} AS h FROM ids, crc_table),
steps AS (SELECT each.conv_id, 0 AS part, pos, digest, words FROM each JOIN placed ON placed.conv_id = base AND pos <= h
  UNION ALL SELECT each.conv_id, 1, pos, digest, words FROM each JOIN placed ON placed.conv_id = each.conv_id AND pos > h),
paths AS (SELECT each.conv_id, coalesce(list(digest ORDER BY part, pos) FILTER (digest IS NOT NULL), []) AS p,
  coalesce(list(words ORDER BY part, pos) FILTER (digest IS NOT NULL), []) AS w FROM each LEFT JOIN steps USING (conv_id) GROUP BY 1),
prefixes AS (SELECT conv_id, d, p[1:d] AS p, len(p) = d AS stops, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM paths)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stops), '')) AS ends_sha256 FROM prefixes GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p, d)),
spread AS (SELECT p[1:k] AS p, k AS d, sum(saved) AS saved_tokens, sum((n_children = 0)::INT) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM known) GROUP BY ALL)
SELECT known.conv_id, known.d AS depth, above.conv_id AS parent_conv_id, known.n_convs, known.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, known.ends_sha256
FROM known JOIN spread USING (p, d) LEFT JOIN known AS above ON above.d = known.d - 1 AND above.p = known.p[1:known.d - 1]
"""
