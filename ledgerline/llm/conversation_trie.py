"""A prefix trie of conversations, whose subtree totals leaf-peeling messages carry to the root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, keep, materialize, scanned, scratch, table

#: A conversation's first turns that another may take over, at most; families of conversations are so many ids.
HEAD, FAMILY = 8, 5
#: Ids of a chunk of the list of a node's members.
CHUNK = 4096


def turns_of(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, bytes): the turns of each conversation, numbered from 1 in order of turn (null first), then role, then text.

    A null role or text is empty. Rows without a key belong to no conversation. digest stands for role and text, and the texts stay where they are: they
    are only moved, to be put in order, where several turns of a conversation have one number and role.
    """
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256))
    full = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv"), F.col(turn).alias("t"), who.alias("role"), digest.alias("digest"), F.octet_length(said).cast("long").alias("bytes"), said.alias("said"))
    rows = materialize(full.drop("said"), "turns")
    place = F.sha2(F.concat_ws("|", F.col("conv").cast("string"), F.coalesce(F.col("t").cast("string"), F.lit("-")), F.col("role")), 256)
    ties = materialize(rows.groupBy("conv", "t", "role").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).where("a != z").select(place.alias("g")), "ties")
    ranked = rows.withColumn("rank", F.lit(0).cast("long"))
    if not ties.isEmpty():
        several = full.withColumn("g", place).join(ties, "g", "left_semi").groupBy("g", "digest").agg(F.first("said").alias("said"))
        ranks = materialize(scanned(several, ["g"], [F.col("said")], {"rank": ("sum", F.lit(1).cast("long"))}).select("g", "digest", F.coalesce("rank", F.lit(0).cast("long")).alias("rank")), "ranks")
        ranked = rows.withColumn("g", place).join(ranks, ["g", "digest"], "left").withColumn("rank", F.coalesce("rank", F.lit(0).cast("long")))
    order = [F.col("t").asc_nulls_first(), F.col("role"), F.col("rank"), F.col("digest")]
    placed = scanned(ranked.select("conv", "t", "role", "rank", "digest", "bytes"), ["conv"], order, {"pos": ("sum", F.lit(1).cast("long"))})
    return materialize(placed.select("conv", (F.coalesce("pos", F.lit(0)) + 1).alias("pos"), "digest", "bytes"), "placed")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, digest, bytes, last) and (conv, length): conversation c is the first h turns of c - c % 5, or all if there are fewer, and its own beyond its first h; h is the CRC-32 of c in decimal, modulo 9."""
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    sizes = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = own.withColumns({"base": F.col("conv") - F.col("conv") % FAMILY, "h": F.crc32(F.col("conv").cast("string")) % (HEAD + 1)}).join(sizes, "base", "left")
    take = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = materialize(convs.select("conv", "base", "h", take.alias("take"), (take + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "convs")
    head = turns.where(F.col("pos") <= HEAD).withColumnRenamed("conv", "base").join(convs, "base").where("pos <= take").select("conv", F.col("pos").alias("depth"), "digest", "bytes", "length")
    tail = turns.join(convs, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("take")).alias("depth"), "digest", "bytes", "length")
    return head.unionByName(tail).select("conv", "depth", "digest", "bytes", (F.col("depth") == F.col("length")).alias("last")), convs.select("conv", "length")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of conversations as they are."""
    convs = materialize(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("length")), "convs")
    return turns.join(convs, "conv").select("conv", F.col("pos").alias("depth"), "digest", "bytes", (F.col("pos") == F.col("length")).alias("last")), convs


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, depth, conv) in order to chunks (owner, depth, first, ids), the ids comma-joined."""
    node, ids, chunks, held = None, [], [], 0

    def close() -> None:
        if ids:
            chunks.append((*node, ids[0], ",".join(map(str, ids))))

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunks, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["owner", "depth", "first", "ids"])

    for batch in batches:
        for owner, depth, conv in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if node != (owner, depth) or len(ids) >= CHUNK:
                close()
                if held >= 8 * CHUNK:
                    yield told()
                    chunks, held = [], 0
                node, ids = (owner, depth), []
            ids.append(conv)
            held += 1
    close()
    if chunks:
        yield told()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to (owner, depth, ends_sha256): a node's chunks pass one by one, and are not held."""
    node, sha = None, None
    for batch in batches:
        out = []
        for owner, depth, ids in zip(*[batch.column(c).to_pylist() for c in ("owner", "depth", "ids")], strict=True):
            if node != (owner, depth):
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (owner, depth), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["owner", "depth", "ends_sha256"])
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([sha.hexdigest()])], names=["owner", "depth", "ends_sha256"])


def ends_of(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of (owner, depth, conv): the SHA-256 of a node's conversations in order, comma-joined.

    Ids are sorted by ranges, so the members of one node may be many tasks; these pack them in chunks, and a hash runs over the chunks of a node in order.
    """
    shape = ["owner", "depth", "conv"]
    chunks = ends.select(*shape).repartitionByRange(*shape).sortWithinPartitions(*shape).mapInArrow(_packed, "owner long, depth long, first long, ids string")
    return chunks.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(_hashed, "owner long, depth long, ends_sha256 string")


def peeled(paths: DataFrame) -> DataFrame:
    """paths (pc, pd, uc, ud, ac, ad, leaves, saved, remaining) with the totals of their subtrees in leaves and saved.

    remaining counts the paths that hang on a path, uc and ud. In each round those without any are done: they are written, and
    their totals go to the paths above as messages, summed for each; until only the root's path finishes.
    """
    state, done = materialize(paths, "paths"), []
    while not state.isEmpty():
        finished = materialize(state.where("remaining = 0"), "peeled")
        said = finished.where("uc is not null").groupBy(F.col("uc").alias("pc"), F.col("ud").alias("pd")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"), F.count(F.lit(1)).alias("_k"))
        left = state.where("remaining > 0").join(said, ["pc", "pd"], "left")
        more = lambda name, by: F.col(name) + F.coalesce(by, F.lit(0).cast("long"))
        left = left.select("pc", "pd", "uc", "ud", "ac", "ad", more("leaves", "_l").alias("leaves"), more("saved", "_s").alias("saved"), (F.col("remaining") - F.coalesce("_k", F.lit(0).cast("long"))).alias("remaining"))
        left = materialize(left, "paths")
        discard(state)
        done.append(finished)
        state = left
    return reduce(DataFrame.unionByName, done or [state])


def _prefixes(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, x, y, px, py, bytes, last): 128 bits for the first turns of each conversation up to each depth, and for those before the last one; the root is 0."""
    hx, hy = F.xxhash64("depth", "digest"), F.xxhash64(F.lit("and"), F.col("digest"), F.col("depth"))
    so_far = scanned(steps.withColumns({"hx": hx, "hy": hy}).drop("digest"), ["conv"], [F.col("depth")], {"px": ("xor", F.col("hx")), "py": ("xor", F.col("hy"))})
    px, py = (F.coalesce(c, F.lit(0).cast("long")) for c in ("px", "py"))
    inner = so_far.select("conv", F.col("depth").cast("long").alias("depth"), px.bitwiseXOR(F.col("hx")).alias("x"), py.bitwiseXOR(F.col("hy")).alias("y"), px.alias("px"), py.alias("py"), "bytes", "last")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("x"), zero.alias("y"), none.alias("px"), none.alias("py"), zero.alias("bytes"), (F.col("length") == 0).alias("last"))
    return materialize(inner.unionByName(root), "prefixes")


def trie(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv, depth, digest, bytes, last) and (conv, length): see prefix_trie().

    1. A prefix is 128 bits: the xor of its turns' hashes, each with its depth. Equal prefixes are one node, named by its smallest member and its depth.
    2. Each node has one heavy child, of the most members; chains of heavy children are paths. A step to any other child at least halves the members, so
       above a leaf there are at most log2(conversations) paths, however long the conversations are. A node's path, and its parent, are the greatest
       depths before it in the rows of its smallest member.
    3. Paths hold counters of the paths that hang on them. Leaves first, those that are complete send their totals up: see peeled().
    4. Inside a path, the totals of a node are the sums from its end up to it.
    """
    prefixes = _prefixes(steps, convs)
    nodes = materialize(prefixes.groupBy("x", "y").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"), F.min("px").alias("px"), F.min("py").alias("py"), F.min("bytes").alias("bytes")), "nodes")
    heavy = F.max(F.struct("n_convs", (-F.col("owner")).alias("o"), F.struct("x", "y").alias("of")))["of"]
    kids = materialize(nodes.where("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"), heavy.alias("heavy")), "kids")
    flags = nodes.join(kids.drop("heavy"), ["x", "y"], "left").join(kids.select("heavy.*", F.lit(False).alias("light")), ["x", "y"], "left")
    flags = materialize(flags.select("x", "y", "owner", "n_convs", "bytes", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("light", F.lit(True)).alias("light")), "flags")

    own = prefixes.select("conv", "depth", "x", "y").join(flags.select(F.col("owner").alias("conv")).distinct(), "conv", "left_semi").join(flags, ["x", "y"]).drop("x", "y")
    here = F.struct("depth", "owner")
    seen = scanned(own, ["conv"], [F.col("depth")], {"parent": ("max", here), "up": ("max", F.when(F.col("light"), here))}).where("conv = owner")
    path = F.when(F.col("light"), here).otherwise(F.col("up"))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    nodes_of = materialize(seen.select("conv", "depth", F.col("parent.owner").alias("parent"), path["owner"].alias("pc"), path["depth"].alias("pd"), "light", "up", "n_convs", "n_children", leaf.alias("leaf"), saved.alias("saved")), "tree")

    top = lambda c: F.max(F.when(F.col("light"), c))
    paths = nodes_of.groupBy("pc", "pd").agg(top(F.col("up.owner")).alias("uc"), top(F.col("up.depth")).alias("ud"), top(F.col("parent")).alias("ac"), (top(F.col("depth")) - 1).alias("ad"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    paths = materialize(paths, "paths")
    hung = paths.where("uc is not null").groupBy(F.col("uc").alias("pc"), F.col("ud").alias("pd")).agg(F.count(F.lit(1)).alias("remaining"))
    totals = peeled(paths.join(hung, ["pc", "pd"], "left").withColumn("remaining", F.coalesce("remaining", F.lit(0).cast("long"))))

    sent = totals.where("ac is not null").groupBy(F.col("ac").alias("conv"), F.col("ad").alias("depth")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
    with_sent = nodes_of.drop("light", "up").join(sent, ["conv", "depth"], "left")
    for name, by in (("leaf", "_l"), ("saved", "_s")):
        with_sent = with_sent.withColumn(name, F.col(name) + F.coalesce(by, F.lit(0).cast("long")))
    summed = scanned(with_sent.drop("_l", "_s"), ["pc", "pd"], [F.col("depth").desc()], {"below_l": ("sum", F.col("leaf")), "below_s": ("sum", F.col("saved"))})

    ends = ends_of(prefixes.where("last").select("conv", "depth", "x", "y").join(flags.select("x", "y", "owner"), ["x", "y"]))
    out = summed.join(ends.withColumnRenamed("owner", "conv"), ["conv", "depth"], "left")
    with_below = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0).cast("long"))
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        with_below("leaf", "below_l").alias("n_leaves"), with_below("saved", "below_s").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", of=whole) -> DataFrame:
    """A row for each node of the trie of conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node of depth d is a distinct sequence of first d turns (role, text); its members are the conversations that start with it, and conv_id is the smallest.
    n_leaves counts childless nodes of its subtree, itself included, and saved_tokens the bytes of text that its members share: for each node
    of the subtree its members less one, times the UTF-8 bytes of its last text. ends_sha256 stands for the members that end there.

    Turns are in order of turn, null first; turns of one number by role and then text, so repeated rows are turns of their own. A null role or text is empty.
    Rows without a key are in no conversation. Texts may be of any length, and only their digests are shuffled. Without a conversation there is no node,
    not even the root. of tells which turns a conversation has: whole() or rebuilt().

    A conversation of any length, or a node of any number of members, is dealt to many tasks; every step that is read again is a table in the shared folder.
    """
    with scratch() as tables:
        out = materialize(trie(*of(turns_of(df, key, turn, role, text))), "trie")
        keep(tables, out)
    return out


def op11(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"), of=rebuilt)


SQL = r"""
WITH bits AS (SELECT b, list_reduce(list_prepend(b::ubigint, [k::ubigint for k in range(8)]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::ubigint) ELSE c >> 1 END) AS v FROM range(256) t(b)),
tab AS (SELECT list(v ORDER BY b) AS t FROM bits),
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, [coalesce(role, ''), coalesce(text, '')] AS turn FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM o GROUP BY 1),
k AS (SELECT c, c - c % 5 AS b,
  xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::ubigint)), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255::ubigint)::bigint + 1])), 4294967295::ubigint) % 9 AS h FROM n, tab),
f AS (SELECT k.c, h, least(h, coalesce(n, 0)) AS take FROM k LEFT JOIN n ON k.b = n.c),
r AS (SELECT f.c, i AS d, turn FROM o JOIN k ON o.c = k.b JOIN f ON f.c = k.c WHERE i <= take UNION ALL SELECT c, i - h + take, turn FROM o JOIN f USING (c) WHERE i > h),
p AS (SELECT c, d, turn, list(turn) OVER (PARTITION BY c ORDER BY d) AS seq FROM r UNION ALL SELECT c, 0, NULL, [] FROM n),
v AS (SELECT seq, d, min(c) AS conv, count(*) AS members, coalesce(octet_length(encode(any_value(turn[2]))), 0) AS bytes FROM p GROUP BY 1, 2),
placed AS (SELECT p.c, p.d, v.conv FROM p JOIN v USING (seq, d)),
e AS (SELECT conv, d, string_agg(c::varchar, ',' ORDER BY c) AS ids FROM placed JOIN (SELECT c, max(d) AS d FROM p GROUP BY 1) USING (c, d) GROUP BY 1, 2),
w AS (SELECT v.conv, v.d, members, bytes, a.conv AS parent FROM v LEFT JOIN placed a ON a.c = v.conv AND a.d = v.d - 1),
kids AS (SELECT parent AS conv, d - 1 AS d, count(*) AS n FROM w WHERE d > 0 GROUP BY 1, 2),
own AS (SELECT w.*, coalesce(kids.n, 0) AS n FROM w LEFT JOIN kids USING (conv, d)),
total AS (SELECT a.conv, a.d, sum((own.n = 0)::int) AS leaves, sum((members - 1) * bytes) AS saved FROM own JOIN placed a ON a.c = own.conv AND a.d <= own.d GROUP BY 1, 2)
SELECT conv::bigint AS conv_id, d::bigint AS depth, parent::bigint AS parent_conv_id, members::bigint AS n_convs, n::bigint AS n_children, leaves::bigint AS n_leaves, saved::bigint AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN total USING (conv, d) LEFT JOIN e USING (conv, d)
"""
