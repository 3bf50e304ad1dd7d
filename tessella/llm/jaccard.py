"""N-gram Jaccard self-join by a MinHash LSH forest, with exact verification.

A text is the set of its five-word shingles. Texts of equal sets are one node, so copies cost nothing further. Each of
the forest's trees labels a node with a run of DEPTH minimum hashes. The labels of a tree, sorted, are its prefix trie:
neighbours in that order share the longest prefixes, and a subtree is a run of it. Subtrees at the shortest prefix that
may be needed are dealt to tasks (large ones in pairs of blocks); a task walks the sorted labels and links nodes at the
longest prefix that they share, if all their minimum hashes together estimate a similarity near the threshold, so that
unlike texts that meet by chance connect nothing. The matched prefix starts at the whole label and is shortened, a hash
at a time, until the recall that the links of all trees let expect reaches the target; links at shorter prefixes are
not used. At the shortest prefix a pair at the threshold itself meets with the target's probability.

Nodes that these links connect are verified exactly, in blocks of bounded size, a task for each pair of blocks of a
component: shingles that most nodes have are counted by their absence, so a large group of near copies costs little
more than its differences. Tasks return counts and classes, never pairs.

Defined cases: a text of one to four words has one shingle, all its words; a null or empty text has no shingle, no link
and a class of its own; repeated rows, even of one doc_id, are copies of each other and link; a null doc_id is an id
like any other and a class may carry it; an empty table gives an empty result. Only doc_id and text are read. Shingles
and rows are told apart by hashes of 64 bits, sets by 128 bits and their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.textbits import K1, K4, Rolling, mix, modest_batches, slices, tidy, word_hashes
from tessella.session import materialize

NO_ID = -(2**63)
CHUNK = 3_000_000
#: Trees of the forest and minimum hashes of a label.
TREES, DEPTH = 24, 8
#: Nodes of a block of a subtree, and shingles of a block of a component.
SUBTREE, BLOCK = 8_000, 400_000
#: Standard errors of the estimated similarity that a link may lie below the threshold.
SLACK = 4.9


def recall(similarity: float, prefix: int) -> float:
    """The chance that a pair of that similarity shares a prefix of that length in some tree."""
    return 1 - (1 - similarity**prefix) ** TREES


def prefix_length(threshold: float, target: float) -> int:
    """The longest prefix at which a pair of that similarity meets in some tree with the target's probability."""
    for k in range(DEPTH, 0, -1):
        if recall(threshold, k) >= target:
            return k
    raise ValueError("no prefix reaches the target: more trees are needed")


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and how many each has."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    buf = b" ".join([b" ".join(w) for w in words if w])
    cut = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
    starts = np.concatenate([[0], cut + 1])
    rolling = Rolling(word_hashes(buf, starts, np.append(cut, len(buf)) - starts, 3))
    heads = np.cumsum(counts) - counts
    have = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), have)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(have) - have, have) + heads[doc]
    hashes = rolling.ranges(first, np.minimum(first + n, (heads + counts)[doc]))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])
    return hashes[new], np.bincount(doc[new], minlength=len(texts))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**63, TREES * DEPTH).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, TREES * DEPTH).astype(np.uint64)


def forest_labels(hashes: np.ndarray, counts: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text with shingles: 64-bit keys [text, tree] of its labels' shortest prefixes, and all labels, a byte a minimum."""
    heads = (np.cumsum(counts) - counts)[counts > 0]
    keys, labels = np.zeros((len(heads), TREES), np.uint64), np.zeros((len(heads), TREES * DEPTH), np.uint8)
    a, b = _coefficients()
    for tree in range(TREES):
        key = np.full(len(heads), tree, np.uint64)
        for d in range(DEPTH):
            i = tree * DEPTH + d
            least = mix(np.minimum.reduceat(hashes * a[i] + b[i] >> np.uint64(20), heads) + np.uint64(i))
            labels[:, i] = least.astype(np.uint8)
            if d < shortest:
                key = mix(key * K1 + least)
        keys[:, tree] = key
    return keys, labels


def signatures(docs: DataFrame, n: int, shortest: int) -> DataFrame:
    """id, tag, n_shingles, one, two (a 128-bit hash of the set), keys and labels of every row, stored."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), CHUNK):
                hashes, counts = shingles([t or b"" for t in batch.column(2).slice(a, b - a).cast(pa.binary()).to_pylist()], n)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ k), dtype=np.uint64)]) for k in (K1, K4)]
                ends = np.cumsum(counts)
                one, two = (s[ends] - s[ends - counts] for s in sums)
                keys, labels = forest_labels(hashes, counts, shortest)
                offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, TREES, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).reshape(-1)))
                places = iter(labels)
                packed = [next(places).tobytes() if c else b"" for c in counts.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists, pa.array(packed, pa.binary())], ["id", "tag", "n_shingles", "one", "two", "keys", "labels"])

    return materialize(docs.select("id", "tag", "text").mapInArrow(run, "id bigint, tag bigint, n_shingles bigint, one bigint, two bigint, keys array<bigint>, labels binary"), "signatures")


def block_pairs(block: Column, blocks: Column) -> Column:
    """The pairs (i, j) of blocks, i <= j, that a row of this block belongs to: one for each block."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, block).alias("i"), F.greatest(o, block).alias("j")))


def _bridges(labels: np.ndarray, minima: np.ndarray, shared: np.ndarray, cluster: np.ndarray, shortest: int, least: float) -> list[tuple[int, int, int, float]]:
    """Links (row, row, prefix, similarity) that connect the clusters of one subtree further, the longest prefixes first.

    shared[i] is the prefix that rows i - 1 and i share; rows of one cluster are connected already.
    """
    n, root, out = len(labels), cluster.copy(), []
    inner = np.arange(n)
    for prefix in range(DEPTH, shortest - 1, -1):
        run = np.cumsum(np.concatenate([[0], shared[1:] < prefix]))
        edges = np.searchsorted(run, np.arange(int(run[-1]) + 2)).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            for i in range(a, b - 1) if b - a > 1 and len(np.unique(root[a:b])) > 1 else ():
                others = i + 1 + np.flatnonzero((root[i + 1 : b] != root[i]) & (inner[i + 1 : b] != inner[i]))
                alike = (minima[others] == minima[i]).mean(axis=1)
                for j, s in zip(others[alike >= least].tolist(), alike[alike >= least].tolist(), strict=True):
                    if root[j] != root[i]:
                        out.append((i, j, prefix, s))
                        root[root == root[j]] = root[i]
        inner = run
    return out


def subtree_links(task: np.ndarray, labels: np.ndarray, minima: np.ndarray, shortest: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (row, row, shared prefix, similarity of the neighbours behind it) between rows sorted by task and label.

    Links of a prefix or a longer one connect exactly the rows that pairs of similar rows of such prefixes connect.
    """
    n = len(task)
    same = task[1:] == task[:-1]
    shared = np.concatenate([[0], np.where(same, np.maximum(np.cumprod(labels[1:] == labels[:-1], axis=1, dtype=np.int8).sum(axis=1), shortest), 0)])
    alike = np.zeros(n)
    at = np.flatnonzero(same) + 1
    for a in range(0, len(at), 20_000):
        now = at[a : a + 20_000]
        alike[now] = (minima[now] == minima[now - 1]).mean(axis=1)
    linked = (shared > 0) & (alike >= least)
    # A chain of neighbours becomes a star: each row is linked to the first that its prefix reaches without a gap.
    first = np.zeros(n, np.int64)
    for prefix in range(shortest, DEPTH + 1):
        gap = ~linked | (shared < prefix)
        reached = np.maximum.accumulate(np.where(gap, np.arange(n), 0))
        first = np.where(shared == prefix, reached, first)
    rows = np.flatnonzero(linked)
    found = [(first[rows], rows, shared[rows], alike[rows])]
    heads = np.flatnonzero(np.concatenate([[True], ~same])) if n else np.zeros(0, np.int64)
    ends = np.append(heads[1:], n)
    broken = np.add.reduceat((shared > 0) & ~linked, heads) if n else heads
    cluster = np.cumsum(~linked)
    for a, b in zip(heads[(broken > 0) & (ends - heads > 2)].tolist(), ends[(broken > 0) & (ends - heads > 2)].tolist(), strict=True):
        more = _bridges(labels[a:b], minima[a:b], shared[a:b], cluster[a:b], shortest, least)
        if more:
            i, j, prefix, s = (np.array(x) for x in zip(*more, strict=True))
            found.append((i + a, j + a, prefix, s))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def forest_links(nodes: DataFrame, shortest: int, threshold: float) -> DataFrame:
    """a, b, prefix, alike (in hundredths) of links between nodes in the forest, stored. nodes: node, keys, labels."""
    each = nodes.select("node", F.posexplode("keys").alias("tree", "subtree"))
    sizes = each.groupBy("subtree").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / SUBTREE).cast("int")
    members = each.join(sizes.hint("merge"), "subtree").select("node", "tree", "subtree", blocks.alias("blocks"))
    labelled = members.join(nodes.select("node", "labels").hint("merge"), "node")
    pairs = block_pairs(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.col("blocks"))
    dealt = labelled.select("subtree", F.explode(pairs).alias("pair"), "node", F.expr(f"substring(labels, tree * {DEPTH} + 1, {DEPTH})").alias("label"), "labels")
    least = threshold - SLACK * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5

    @tidy
    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> pa.RecordBatch:
            bytes_of = lambda name, width: np.frombuffer(b"".join(rows.column(name).to_pylist()), np.uint8).reshape(-1, width)
            a, b, prefix, alike = subtree_links(rows.column("task").to_numpy(), bytes_of("label", DEPTH), bytes_of("labels", TREES * DEPTH), shortest, least)
            node = rows.column("node").combine_chunks()
            return pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b)), pa.array(prefix, pa.int32()), pa.array((100 * alike).astype(np.int32))], ["a", "b", "prefix", "alike"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            task = held.column("task").to_numpy()
            ended = np.flatnonzero(task != task[-1])
            if len(ended):
                yield done(held.slice(0, int(ended[-1]) + 1))
                held = held.slice(int(ended[-1]) + 1)
        if held is not None and held.num_rows:
            yield done(held)

    met = dealt.select(F.xxhash64("subtree", "pair").alias("task"), "node", "label", "labels").repartition("task").sortWithinPartitions("task", "label", "node")
    node = nodes.schema["node"].dataType.simpleString()
    return materialize(met.mapInArrow(climb, f"a {node}, b {node}, prefix int, alike int"), "forest-links")


def needed_prefix(links: DataFrame, shortest: int, threshold: float, target: float) -> int:
    """The matched prefix, shortened from the whole label until the recall that the links let expect reaches the target.

    A pair of similarity s makes TREES * s ** shortest links on average, so links tell how many pairs there are of each
    similarity; one row a prefix and hundredth is collected. Without links it is the shortest.
    """
    rows = links.where(F.col("alike") >= int(100 * threshold)).groupBy("alike").agg(F.count("*").alias("n")).collect()
    pairs = [(max(r["alike"] / 100, threshold), r["n"]) for r in rows]
    pairs = [(s, n / s**shortest) for s, n in pairs]
    for prefix in range(DEPTH, shortest, -1):
        if pairs and sum(n * recall(s, prefix) for s, n in pairs) >= target * sum(n for _, n in pairs):
            return prefix
    return shortest


def components(members: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component. members: node and the groups that connect nodes."""
    members = materialize(members.select("node", "group"), "members")
    labels = materialize(members.groupBy("node").agg(F.min("node").alias("label")), "labels")
    while True:
        groups = members.join(labels, "node").groupBy("group").agg(F.min("label").alias("least"))
        nearer = members.join(groups, "group").groupBy("node").agg(F.min("least").alias("label"))
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = nearer.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"))
        after = materialize(after, "labels")
        if after.join(labels.withColumnRenamed("label", "old"), "node").where(F.col("label") != F.col("old")).limit(1).count() == 0:
            return after
        labels = after


def links_of(sets: list[np.ndarray], weights: np.ndarray, sides: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per set the summed weights of the sets it is similar to, and its class (a number) by these links.

    With sides only links between different sides count. Shingles in more than half of the sets count by absence.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    spread = np.bincount(code)
    common = spread > n / 2
    own_common = np.bincount(owner, weights=common[code], minlength=n).astype(np.int64)
    rare = ~common[code] & (spread[code] > 1)
    has = np.zeros((n, int(common.sum())), bool)
    number = np.cumsum(common) - 1
    at = common[code]
    has[owner[at], number[code[at]]] = True
    missing_owner, missing = np.nonzero(~has)
    # One list of what tells sets apart: rare shingles they have, then common ones they lack.
    who = np.concatenate([owner[rare], missing_owner])
    what = np.concatenate([code[rare], missing + len(spread)])
    order = np.argsort(what, kind="stable")
    by_what, lists = who[order], what[order]
    begin, end = np.searchsorted(lists, what, side="left"), np.searchsorted(lists, what, side="right")
    mine = np.argsort(who, kind="stable")
    edges = np.searchsorted(who[mine], np.arange(n + 1))
    lacks = int(common.sum()) - own_common
    total, label, found = np.zeros(n, np.int64), np.full(n, -1, np.int64), 0

    def row(i: int) -> np.ndarray:
        own = mine[edges[i] : edges[i + 1]]
        parts = [by_what[a:b] for a, b in zip(begin[own].tolist(), end[own].tolist(), strict=True)]
        both = np.bincount(np.concatenate(parts), minlength=n) if parts else np.zeros(n, np.int64)
        shared = both + (int(common.sum()) - lacks[i]) - lacks
        near = shared >= threshold * (sizes[i] + sizes - shared) - 1e-9
        near[i] = False
        if sides is not None:
            near &= sides != sides[i]
        return np.flatnonzero(near)

    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed], queue = found, [seed]
        while queue:
            i = queue.pop()
            near = row(i)
            total[i] = weights[near].sum()
            new = near[label[near] < 0]
            label[new] = found
            queue += new.tolist()
        found += 1
    return total, label


def verified(docs: DataFrame, placed: DataFrame, n: int, threshold: float) -> DataFrame:
    """node, group, links: per task and node its class there and its links there. placed: node, component, weight, size."""
    sums = placed.groupBy("component").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    small = placed.join(sums, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Always by a shuffle: this side grows with the documents, and a plan that changes with its size cannot be foreseen.
    rows = docs.join(small.hint("merge"), (F.col("id") == F.col("node.id")) & (F.col("tag") == F.col("node.tag"))).select("node", "component", "weight", "block", "blocks", "text")

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), CHUNK):
                hashes, counts = shingles([t or b"" for t in batch.column(1).slice(a, b - a).cast(pa.binary()).to_pylist()], n)
                edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
                packed = [hashes[x:y].tobytes() for x, y in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(packed, pa.binary())], ["row", "shingles"])

    info = rows.select(F.struct("node", "component", "weight", "block", "blocks").alias("row"), "text")
    sets = info.mapInArrow(cut, f"row {info.schema['row'].dataType.simpleString()}, shingles binary").select("row.*", "shingles")
    dealt = sets.withColumn("pair", F.explode(block_pairs(F.col("block"), F.col("blocks")))).select(F.xxhash64("component", "pair").alias("task"), F.struct("component", "pair").alias("key"), "node", "weight", "block", (F.col("pair.i") != F.col("pair.j")).alias("crossed"), "shingles")

    @tidy
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: dict) -> pa.RecordBatch:
            nodes = list(rows)
            weights = np.array([rows[x][0] for x in nodes], np.int64)
            sides = np.array([rows[x][1] for x in nodes]) if rows[nodes[0]][2] else None
            total, label = links_of([np.frombuffer(rows[x][3], np.uint64) for x in nodes], weights, sides, threshold)
            groups = [now * 1_000_003 + 1 + int(x) for x in label]
            groups = [(g + 2**63) % 2**64 - 2**63 for g in groups]
            node = pa.StructArray.from_arrays([pa.array([x[0] for x in nodes], pa.int64()), pa.array([x[1] for x in nodes], pa.int64())], ["id", "tag"])
            return pa.RecordBatch.from_arrays([node, pa.array(groups, pa.int64()), pa.array(total, pa.int64())], ["node", "group", "links"])

        now, rows = None, {}
        for batch in batches:
            ids, tags = batch.column(1).field(0).to_pylist(), batch.column(1).field(1).to_pylist()
            for task, i, t, weight, block, crossed, packed in zip(batch.column(0).to_pylist(), ids, tags, *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                if task != now and rows:
                    yield done(rows)
                    rows = {}
                now = task
                rows[i, t] = (weight, block, crossed, packed)
        if rows:
            yield done(rows)

    met = dealt.repartition("task").sortWithinPartitions("task").select("task", "node", "weight", "block", "crossed", "shingles")
    return met.mapInArrow(check, "node struct<id:bigint,tag:bigint>, group bigint, links bigint")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), "tag": F.xxhash64("text")})


def similar_documents(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, target: float = 0.9999) -> DataFrame:
    """Rows id, tag, node, label, n_links, one a row of docs: id and tag as in keyed(), node the first copy's.

    label is the least node of the class that links connect; n_links counts all other rows that are similar.
    """
    modest_batches(docs.sparkSession)
    own = keyed(docs.select("doc_id", "text")).select("id", "tag", "text")
    shortest = prefix_length(threshold, target)
    marks = signatures(own, n, shortest)
    node = F.struct("id", "tag")
    full = marks.where(F.col("n_shingles") > 0)
    least = F.min(F.struct(node.alias("node"), F.col("keys"), F.col("labels"))).alias("least")
    nodes = materialize(full.groupBy("one", "two", "n_shingles").agg(least, F.count("*").alias("weight")).select("one", "two", F.col("n_shingles").alias("size"), "least.node", "least.keys", "least.labels", "weight"), "nodes")
    links = forest_links(nodes, shortest, threshold)
    links = links.where(F.col("prefix") >= needed_prefix(links, shortest, threshold, target)).select("a", "b").distinct()
    labels = components(links.select(F.col("b").alias("node"), F.col("a").alias("group")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("group")).distinct()))
    placed = materialize(labels.join(nodes.select("node", "weight", "size"), "node").select("node", F.col("label").alias("component"), "weight", "size"), "placed")
    checked = materialize(verified(own, placed, n, threshold), "verified")
    classes = components(checked)
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    by_node = nodes.join(links, "node", "left").join(classes, "node", "left").select("one", "two", "node", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = full.select("id", "tag", "one", "two").join(by_node, ["one", "two"]).select("id", "tag", "node", "label", "n_links")
    bare = marks.where(F.col("n_shingles") == 0).select("id", "tag", node.alias("node"), node.alias("label"), F.lit(0).cast("bigint").alias("n_links"))
    return linked.unionByName(bare)


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs without all but one document of each class; rows of empty texts stay.

    The document of least id stays, null before all, then the one of least text hash; of rows equal in id and text the
    one of the least hash of all its columns, so that the choice does not depend on the order of tasks.
    """
    found = similar_documents(docs, **how)
    stay = found.where(F.struct("id", "tag") == F.col("label")).select(F.col("id").alias("keep_id"), F.col("tag").alias("keep_tag")).distinct()
    row = F.struct(*[F.col(c) for c in docs.columns])
    own = docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("tag"))
    kept = own.join(stay, (F.col("id") == F.col("keep_id")) & (F.col("tag") == F.col("keep_tag")), "left_semi")
    blank = F.coalesce(F.col("row.text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*\z")
    one = kept.where(~blank).groupBy("id", "tag").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*").unionByName(own.where(blank).select("row.*"))
