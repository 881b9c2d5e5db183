"""Prefix trie of conversations, built as a burst trie in shards.

Every conversation becomes a sequence of turns (a digest of role and text, and its
number of words). Sequences lie in containers under trie heads: a container holds the
suffixes of all conversations that share a prefix. A container with more than
``CONTAINER`` suffixes bursts: the turns that all its suffixes share become a chain of
trie nodes in one step, and the rest goes to child containers by the next turn. What
remains is sorted by container and suffix, and each container is swept into its nodes
within one task. Sums over subtrees then rise from container to container, deepest
bursts first.

No row or group is unbounded. A row holds at most ``SEGMENT`` turns: a longer
conversation goes on in a container that is keyed by all its turns so far, and a
container with one conversation only is a plain chain that needs no sums. A container
in a task has at most ``CONTAINER`` suffixes; copies in any number share one chain. The
ids that end at one node of a chain are joined to text in range-sorted blocks, and the
blocks are hashed in order.

Defined cases: rows without a conv_id belong to no conversation; turns are ordered by
``turn`` (null first), then role, then text, so equal rows count as turns of their own; a null
role or text is empty; a conversation without a turn left is a member of the root; an
empty table has no node at all; only the four named columns are read, others may have
any name; texts are reduced to digests and word counts in their row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm import crc_sql, store
from tollgate.operators.ordered import numbered
from tollgate.session import small_side

SEGMENT = 256
CONTAINER = 256
BLOCK_IDS = 1 << 14
GROUP = 20
MOST_SHARED = 4

NO_IDS = hashlib.sha256(b"").hexdigest()
SEQUENCE = "array<struct<tid:binary,words:bigint>>"
NODE = (
    "key string, root boolean, owned boolean, up string, via string, next_key string, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest and words of every turn."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    ranked = numbered(rows, ["conv_id"], ["turn", "role", "text"], "pos")
    name = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return ranked.select("conv_id", "pos", F.unhex(F.sha2(name, 256)).alias("tid"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth, tid and words of every rebuilt conversation; one row without depth for each."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).alias("h"))
    convs = store.written(convs, "conversations")
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("shared"))
    first = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    taken = convs.join(first, "base").where("pos <= shared").select("conv_id", F.col("pos").alias("depth"), "tid", "words")
    own = turns.join(convs.select("conv_id", "h", "shared"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("depth"), "tid", "words")
    nothing = convs.select("conv_id", F.lit(None).cast("long").alias("depth"), F.lit(None).cast("binary").alias("tid"), F.lit(None).cast("long").alias("words"))
    return taken.unionByName(own).unionByName(nothing)


def segments(rows: DataFrame) -> DataFrame:
    """Sequences of at most ``SEGMENT`` turns, with the key of the container each starts in."""
    seg = F.coalesce(F.floor((F.col("depth") - 1) / SEGMENT), F.lit(0))
    turn = F.when(F.col("depth").isNotNull(), F.struct("depth", "tid", "words"))
    cut = rows.groupBy("conv_id", seg.cast("long").alias("seg")).agg(F.array_sort(F.collect_list(turn)).alias("found"))
    cut = cut.select("conv_id", "seg", F.transform("found", lambda t: F.struct(t.tid.alias("tid"), t.words.alias("words"))).cast(SEQUENCE).alias("seq"))
    cut = store.written(cut, "segments")
    begin = F.when(F.col("seg") == 0, F.lit(""))
    whole = (F.col("seg") > 0) | (F.size("seq") == SEGMENT)
    short = cut.where(~whole).select("conv_id", "seg", "seq", F.lit("").alias("key"), F.lit(None).cast("string").alias("next_key"))
    digest = F.sha2(F.concat_ws("", F.col("seg").cast("string"), F.transform("seq", lambda t: F.hex(t.tid))), 256)
    part = [F.conv(F.substring("digest", at, 15), 16, 10).cast("long") for at in (1, 16)]
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.concat_ws("/", F.col("seg").cast("string"), *[F.hex(F.bit_xor(p).over(before)) for p in part])
    long = cut.where(whole).withColumn("digest", digest).withColumn("key", F.coalesce(begin, so_far))
    long = long.withColumn("next_key", F.lead("key").over(Window.partitionBy("conv_id").orderBy("seg")))
    return short.unionByName(long.select(*short.columns))


def shared_turns(low: Column, high: Column) -> Column:
    """How many first turns two sequences share."""
    shorter = F.least(F.size(low), F.size(high))
    unlike = F.transform(F.sequence(F.lit(0), shorter - 1), lambda i: F.get(low, i).tid != F.get(high, i).tid)
    at = F.array_position(unlike, True)
    return F.when(shorter == 0, 0).when(at == 0, shorter).otherwise(at - 1).cast("int")


class Below:
    """What the containers of the next segment add to the nodes in which this one's conversations go on."""

    def __init__(self, table: DataFrame | None):
        self.table = table

    def added(self, rows: DataFrame) -> DataFrame:
        """``rows`` with below_children, below_leaves and below_saved of their next container."""
        names = ["below_children", "below_leaves", "below_saved"]
        if self.table is None:
            return rows.withColumns({n: F.lit(0).cast("long") for n in names})
        # a container that is in no table holds one conversation: one child, one leaf, nothing saved
        alone = F.col("next_key").isNotNull().cast("long")
        joined = rows.join(self.table, "next_key", "left")
        return joined.withColumns({"below_children": F.coalesce("below_children", alone), "below_leaves": F.coalesce("below_leaves", alone), "below_saved": F.coalesce("below_saved", F.lit(0).cast("long"))})


def sweep(rows: list[tuple], owned: bool, top: int) -> list[list]:
    """The nodes of one container whose suffixes come in sorted order.

    A row is (conv_id, digests, words, next key, children, leaves and saved tokens below its end).
    A node is [depth below the root, parent's place, conv_id, members, children, leaves,
    saved tokens, ids that end here, next key]; the root is first, children follow parents.
    """
    nodes = [[0, -1, None, 0, 0, 0, 0, [], None]]
    weight = [top]
    path, before = [0], []
    for conv, tids, words, next_key, children, leaves, saved in rows:
        same = 0
        stop = min(len(before), len(tids))
        while same < stop and before[same] == tids[same]:
            same += 1
        del path[same + 1 :]
        for i in range(same, len(tids)):
            nodes.append([i + 1, path[-1], conv, 0, 0, 0, 0, [], None])
            weight.append(words[i])
            path.append(len(nodes) - 1)
        for at in path:
            node = nodes[at]
            node[3] += 1
            if node[2] is None or conv < node[2]:
                node[2] = conv
        end = nodes[path[-1]]
        if next_key is None:
            end[7].append(conv)
        elif end[8] is None:
            end[8] = next_key
            end[4], end[5], end[6] = end[4] + children, end[5] + leaves, end[6] + saved
        before = tids
    for at in range(len(nodes) - 1, -1, -1):
        node = nodes[at]
        if not node[4]:
            node[5] = 1
        node[6] += (node[3] - 1) * weight[at]
        if at:
            above = nodes[node[1]]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    return nodes


def sha_of_ids(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest() if ids else NO_IDS


def swept(rows: DataFrame) -> DataFrame:
    """Nodes of all containers of ``rows``; each container lies within one task, in sorted order."""

    def nodes_of(key: str, head: tuple, held: list[tuple]) -> Iterator[tuple]:
        depth, owned, parent, up, top = head
        nodes = sweep(held, owned, top)
        for at, (below, parent_at, conv, n, children, leaves, saved, ends, next_key) in enumerate(nodes):
            via = key if at and parent_at == 0 and not owned else None
            above = parent if at == 0 else nodes[parent_at][2]
            yield key, at == 0, owned, up, via, next_key, conv, depth + below, above, n, children, leaves, saved, sha_of_ids(ends)

    def as_batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), TYPES, strict=True)], names=NAMES)

    def task(batches):
        key, head, held, found = None, None, [], []
        for batch in batches:
            columns = {n: batch.column(n) for n in ("key", "conv_id", "depth", "owned", "parent", "up", "top", "next_key", "below_children", "below_leaves", "below_saved")}
            values = {n: c.to_pylist() for n, c in columns.items()}
            seq = batch.column("seq")
            tids, words = seq.flatten().field("tid").to_pylist(), seq.flatten().field("words").to_pylist()
            at = 0
            for i, size in enumerate(seq.value_lengths().to_pylist()):
                if values["key"][i] != key:
                    if held:
                        found.extend(nodes_of(key, head, held))
                        if len(found) >= 20_000:
                            yield as_batch(found)
                            found = []
                    key, held = values["key"][i], []
                    head = tuple(values[n][i] for n in ("depth", "owned", "parent", "up", "top"))
                held.append((values["conv_id"][i], tids[at : at + size], words[at : at + size], *(values[n][i] for n in ("next_key", "below_children", "below_leaves", "below_saved"))))
                at += size
        if held:
            found.extend(nodes_of(key, head, held))
        if found:
            yield as_batch(found)

    ready = rows.select("key", "conv_id", "depth", "owned", "parent", "up", "top", "seq", "next_key", "below_children", "below_leaves", "below_saved")
    return ready.repartition("key").sortWithinPartitions("key", "seq", "conv_id").mapInArrow(task, NODE)


_KINDS = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}
NAMES = [c.split()[0] for c in NODE.split(", ")]
TYPES = [_KINDS[c.split()[1]] for c in NODE.split(", ")]


def digests_of_ends(stops: DataFrame) -> DataFrame:
    """key and the digest of the ascending ids of ``stops(key, conv_id)``, of any number per key."""

    def pack(batches):
        """Consecutive ids of a key as one text; a block starts anew at each batch and key."""
        for batch in batches:
            rows: dict[str, list[int]] = {}
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                rows.setdefault(key, []).append(conv)
            blocks = [(k, ids[i], ",".join(map(str, ids[i : i + BLOCK_IDS]))) for k, ids in rows.items() for i in range(0, len(ids), BLOCK_IDS)]
            if blocks:
                keys, first, text = zip(*blocks, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(first, pa.int64()), pa.array(text, pa.string())], names=["key", "first", "text"])

    def hashed(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if k != key:
                    if digest is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["key", "ends"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "ends"])

    pieces = int(stops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = stops.repartitionByRange(pieces, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pack, "key string, first long, text string")
    return blocks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key string, ends string")


def burst(level: DataFrame, below: Below, container: int) -> DataFrame:
    """All nodes of the containers of ``level``: oversized ones burst until none is left, the rest is swept."""
    settled, heads, stopped = [], [], []
    while True:
        big = store.written(level.groupBy("key").count().where(F.col("count") > container).select("key"), "big")
        if not big.limit(1).count():
            settled.append(level)
            break
        few = small_side(big)
        settled.append(level.join(few, "key", "left_anti"))
        rows = level.join(few, "key", "left_semi")
        same = [F.first(c).alias(c) for c in ("depth", "owned", "parent", "up", "top")]
        chain = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.min("seq").alias("low"), F.max("seq").alias("high"), *same)
        chain = chain.withColumn("shared", shared_turns(F.col("low"), F.col("high")))
        chain = store.written(chain.withColumn("words", F.transform(F.slice("low", F.lit(1), F.col("shared")), lambda t: t.words)).drop("low", "high"), "heads")
        heads.append(chain)
        moved = rows.select("key", "conv_id", "seq", "next_key").join(small_side(chain.select("key", "shared", "conv", F.col("depth").alias("at"))), "key")
        moved = moved.withColumn("next", F.get("seq", F.col("shared")))
        stopped.append(moved.where("next IS NULL").select("key", "conv_id", "next_key"))
        child = F.sha2(F.concat("key", F.lit("/"), F.hex("next.tid")), 256)
        rest = F.slice("seq", F.col("shared") + 2, F.greatest(F.size("seq"), F.lit(1)))
        level = moved.where("next IS NOT NULL").select(
            child.alias("key"), "conv_id", rest.alias("seq"), "next_key", (F.col("at") + F.col("shared") + 1).alias("depth"),
            F.lit(True).alias("owned"), F.col("conv").alias("parent"), F.col("key").alias("up"), F.col("next.words").alias("top"),
        )
        level = store.written(level, "burst")
    kept = [store.written(swept(below.added(reduce(DataFrame.unionByName, settled))), "swept")]
    for chain, stops in zip(reversed(heads), reversed(stopped), strict=True):
        kept.append(store.written(chain_nodes(chain, stops, reduce(DataFrame.unionByName, kept), below), "chain"))
    return reduce(DataFrame.unionByName, kept)


def chain_nodes(chain: DataFrame, stops: DataFrame, found: DataFrame, below: Below) -> DataFrame:
    """The nodes of burst containers, with the sums of the containers under them."""
    under = found.where("root AND up IS NOT NULL").groupBy(F.col("up").alias("key"))
    under = under.agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    on = below.added(stops.where("next_key IS NOT NULL").select("key", "next_key").distinct())
    ends = digests_of_ends(stops.where("next_key IS NULL").select("key", "conv_id"))
    rows = chain.join(under, "key", "left").join(on, "key", "left").join(ends, "key", "left")
    nothing = F.lit(0).cast("long")
    rows = rows.withColumns({
        "kids": F.coalesce("kids", nothing) + F.coalesce("below_children", nothing),
        "leaves": F.coalesce("leaves", nothing) + F.coalesce("below_leaves", nothing),
        "saved": F.coalesce("saved", nothing) + F.coalesce("below_saved", nothing),
        "words": F.concat(F.array("top"), "words"),
    })
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), "shared")))
    last, root = F.col("j") == F.col("shared"), F.col("j") == 0
    left = F.aggregate(F.slice("words", F.col("j") + 1, F.size("words")), nothing, lambda a, x: a + x)
    return rows.select(
        "key", root.alias("root"), "owned", "up",
        F.when((F.col("j") == 1) & ~F.col("owned"), F.col("key")).alias("via"),
        F.when(last, F.col("next_key")).alias("next_key"),
        F.col("conv").alias("conv_id"), (F.col("depth") + F.col("j")).alias("depth"),
        F.when(root, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.greatest("leaves", F.lit(1).cast("long")).alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * left).alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("ends")), F.lit(NO_IDS)).alias("ends_sha256"),
    )


def alone(rows: DataFrame) -> DataFrame:
    """The nodes of later segments that one conversation has to itself: a chain with nothing to sum."""
    each = rows.select("*", F.posexplode("seq").alias("i", "turn"))
    end = (F.col("i") + 1 == F.size("seq")) & F.col("next_key").isNull()
    one, nothing = F.lit(1).cast("long"), F.lit(0).cast("long")
    first = F.col("i") == 0
    return each.select(
        "key", F.lit(False).alias("root"), F.lit(True).alias("owned"), F.lit(None).cast("string").alias("up"), F.when(first, F.col("key")).alias("via"),
        F.when(F.col("i") + 1 == F.size("seq"), F.col("next_key")).alias("next_key"),
        "conv_id", (F.col("seg") * SEGMENT + F.col("i") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"),
        one.alias("n_convs"), F.when(end, nothing).otherwise(one).alias("n_children"), one.alias("n_leaves"), nothing.alias("saved_tokens"),
        F.when(end, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NO_IDS)).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    spark = conversations.sparkSession
    turns = store.written(turns_of(conversations), "turns")
    cut = store.written(segments(rebuilt(turns)), "sequences")
    rows = cut.withColumns({
        "depth": F.col("seg") * SEGMENT, "owned": F.col("seg") == 0, "parent": F.lit(None).cast("long"),
        "up": F.lit(None).cast("string"), "top": F.lit(0).cast("long"),
    })
    later = rows.where("seg > 0")
    sizes = store.written(later.groupBy("seg", "key").count(), "containers")
    crowded = sizes.where("count > 1")
    deepest = crowded.agg(F.max("seg")).first()[0] or 0
    any_later = bool(sizes.limit(1).count())
    found = []
    if any_later:
        found.append(alone(later.join(sizes.where("count = 1").select("key"), "key", "left_semi")))
    # Only segments in which several conversations still go together are summed one after the other.
    below = Below(spark.createDataFrame([], "next_key string, below_children long, below_leaves long, below_saved long") if any_later else None)
    for seg in range(deepest, -1, -1):
        part = rows.where(F.col("seg") == seg).drop("seg")
        if seg:
            part = part.join(crowded.where(F.col("seg") == seg).select("key"), "key", "left_semi")
        nodes = burst(part, below, container)
        found.append(nodes)
        tops = nodes.where("root AND NOT owned")
        below = Below(tops.select(F.col("key").alias("next_key"), F.col("n_children").alias("below_children"), F.col("n_leaves").alias("below_leaves"), F.col("saved_tokens").alias("below_saved")))
    nodes = reduce(DataFrame.unionByName, found).where("owned OR NOT root")
    if any_later:
        above = nodes.where("next_key IS NOT NULL").select(F.col("next_key").alias("via"), F.col("conv_id").alias("above"))
        nodes = nodes.join(above, "via", "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    return nodes.select(*COLUMNS)


SQL = f"""
WITH {crc_sql.TABLE},
ranked AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {crc_sql.of_text("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM ranked), crc),
taken AS (
  SELECT c.conv_id, 0 AS part, r.pos, r.role, r.text FROM convs c JOIN ranked r ON r.conv_id = c.base AND r.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, r.pos, r.role, r.text FROM convs c JOIN ranked r ON r.conv_id = c.conv_id AND r.pos > c.h),
path AS (
  SELECT conv_id, row_number() OVER w AS depth,
         md5(string_agg(md5(len(role) || ':' || role || text), '' ) OVER (w ROWS UNBOUNDED PRECEDING)) AS node,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM taken WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
placed AS (
  SELECT *, lag(node) OVER w AS above, lead(node) OVER w IS NULL AS final FROM path WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (
  SELECT node, any_value(depth) AS depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE final), '')) AS ends_sha256
  FROM placed GROUP BY node),
children AS (SELECT above AS node, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
sums AS (
  SELECT p.node, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM nodes n JOIN path p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children c ON c.node = n.node GROUP BY p.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN nodes a ON a.node = n.above LEFT JOIN children c ON c.node = n.node
"""
