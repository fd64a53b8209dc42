"""Exact n-gram Jaccard join: which documents share at least 0.8 of their distinct 5-word shingles, and their groups.

1. Documents with equal sets become one node.  2. Nodes that can be similar share a shingle among the first few of
each (in one order for all, with very frequent shingles last): only such nodes meet, in groups.  3. In each group a
signature tree over the nodes' bitmaps is traversed against itself; what its bounds can't rule out joins nodes to
candidate components.  4. In each component a signature tree with an exact test at its leaves finds the links; nodes
already linked need no test.  Components over MAX_BLOCK nodes are cut into blocks, and blocks are joined in pairs.
No bound or limit here loses a link: whatever is too large for one way takes the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import cut, mix64, slices, table, tidy, tidy_table, word_hashes, words
from factloom.llm.components import connected_components
from factloom.llm.sigtree import OVER, UNDER, Forest, bitmap, link


#: Bytes of text that are hashed at once.
SLICE = 4 << 20


@dataclass(frozen=True)
class Params:
    width: int = 5
    #: Nodes of one group, beyond which all of it is joined untested; nodes of one block.
    max_group: int = 4096
    max_block: int = 2048
    #: A shingle is very frequent from so many nodes on; so many of them are known to all tasks at most.
    hot: int = 1000
    max_hot: int = 100_000
    #: Bits of a set's first digest; fewer only serve to test what happens when digests of different sets meet.
    digest_bits: int = 64
    #: Bytes of one unit of work, about.
    unit_bytes: int = 24 << 20


def shingle_sets(col: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their bounds."""
    flat, bounds = words(col)
    own = word_hashes(flat)[0]
    n = np.diff(bounds)
    docs = len(n)
    count = np.maximum(n - width + 1, 0)
    doc = np.repeat(np.arange(docs), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][doc]
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for k in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + own[at + k]
        short = np.flatnonzero((n > 0) & (n < width))
        more = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            live = n[short] > k
            more[live] = more[live] * np.uint64(0x9E3779B97F4A7C15) + own[bounds[:-1][short][live] + k]
        more += n[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = mix64(np.concatenate([h, more]))
    ends = np.concatenate([[0], np.cumsum(count)])
    for i in np.flatnonzero(count > 1).tolist():  # each text by itself: short sorts are the quickest
        h[ends[i] : ends[i + 1]].sort()
    if len(short):  # sets of one go where their texts are
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))]).astype(np.int64)


#: Salts of a set's first and second digest.
DIGEST, SECOND = 0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3
NONE = np.zeros(0, np.int64)


def _digest(h: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(salt)), dtype=np.uint64)])
        n = np.diff(bounds).astype(np.uint64)
        return mix64(total[bounds[1:]] - total[bounds[:-1]] + n * np.uint64(0xE7037ED1A0B428DB)).view(np.int64)


def digests(h: np.ndarray, bounds: np.ndarray, twins: np.ndarray = NONE, bits: int = 64) -> np.ndarray:
    """What names each set: its first digest, or its second where the first is one of `twins`, which different sets share."""
    dig = _digest(h, bounds, DIGEST) & np.int64(-1 if bits == 64 else (1 << bits) - 1)
    shared = np.isin(dig, twins) if len(twins) else NONE
    return np.where(shared, _digest(h, bounds, SECOND), dig) if shared.any() else dig


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values[bounds[i]:bounds[i + 1]] as bytes, for each i."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])


def _joined(col, kind) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind)


class _Fresh:
    """Which nodes a task sees for the first time (it may forget, if they are very many)."""

    def __init__(self, limit: int = 500_000):
        self.seen: set[int] = set()
        self.limit = limit

    def __call__(self, digs: np.ndarray, ok: np.ndarray) -> np.ndarray:
        out = np.zeros(len(digs), bool)
        for i in np.flatnonzero(ok).tolist():
            d = int(digs[i])
            if d not in self.seen:
                self.seen.add(d)
                out[i] = True
        if len(self.seen) > self.limit:
            self.seen.clear()
        return out


def _take(h: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets that keep marks."""
    n = np.diff(bounds)
    return h[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[keep])])


def measured(df: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """id, n, both digests of each row (kind 0; null for empty sets), and shingles frequent in a slice (kind 1: dig, n)."""

    names = ["kind", "id", "n", "dig", "second"]

    def run(batches):
        fresh = _Fresh()
        for b, col in slices(batches, text_col, SLICE):
            ids = b.column(b.schema.get_field_index(id_col))
            h, bounds = shingle_sets(col, p.width)
            n, dig = np.diff(bounds), digests(h, bounds, bits=p.digest_bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n)), pa.int32()), ids, pa.array(n), pa.array(dig, mask=n == 0), pa.array(_digest(h, bounds, SECOND), mask=n == 0)], names)
            own, count = np.unique(_take(h, bounds, fresh(dig, n > 0))[0], return_counts=True)
            often = count >= 4
            if often.any():
                k = int(often.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k), pa.int32()), pa.nulls(k, ids.type), pa.array(count[often]), pa.array(own[often].view(np.int64)), pa.nulls(k, pa.int64())], names)

    rows = df.select(id_col, text_col)
    return rows.mapInArrow(tidy(run), f"kind int, id {dict(rows.dtypes)[id_col]}, n long, dig long, second long")


def _range(n: np.ndarray) -> np.ndarray:
    """The range of each size.  Sizes of one range differ by a factor under 1.2, so they are in one run of groups()."""
    return np.floor(np.log(n) / np.log(1.2 - 1e-9)).astype(np.int64)


def prefixes(df: DataFrame, p: Params, text_col: str, hot: np.ndarray, buckets: int, twins: np.ndarray) -> DataFrame:
    """The first shingles of each node, packed by bucket of the shingle: (h, dig, n, sure) side by side.

    A very frequent shingle would bring very many nodes together.  Its nodes meet slice by slice (sure is 1), and one
    node of each slice and range of sizes meets those of other slices (sure is 2); they are joined without a test.
    """

    def run(batches):
        fresh, part, count = _Fresh(), TaskContext.get().partitionId(), 0
        for _, col in slices(batches, text_col, SLICE):
            h, bounds = shingle_sets(col, p.width)
            dig = digests(h, bounds, twins, p.digest_bits)
            keep = fresh(dig, np.diff(bounds) > 0)
            h, bounds = _take(h, bounds, keep)
            dig, n = dig[keep], np.diff(bounds)
            node = np.repeat(np.arange(len(n)), n)
            sure = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
            if sure.any():
                order = np.lexsort((h, sure, node))
                h, sure = h[order], sure[order]
            size = n - (OVER * n + UNDER - 1) // UNDER + 1
            first = (np.arange(len(h)) - bounds[:-1][node]) < size[node]
            h, sure, node = h[first], sure[first], node[first]
            if sure.any():
                at = np.flatnonzero(sure)
                order = np.lexsort((_range(n[node[at]]), h[at]))
                own, range_ = h[at][order], _range(n[node[at]])[order]
                lead = at[order[np.append(True, (own[1:] != own[:-1]) | (range_[1:] != range_[:-1]))]]
                count += 1
                keys, leads = h.copy(), h[lead]
                with np.errstate(over="ignore"):
                    keys[at] = mix64(h[at] + np.uint64((part << 24) + count) * np.uint64(0x9E3779B97F4A7C15))
                h, sure, node = np.concatenate([keys, leads]), np.concatenate([sure.astype(np.uint8), np.full(len(lead), 2, np.uint8)]), np.concatenate([node, node[lead]])
            bucket = (mix64(h) >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))])
            some = np.flatnonzero(np.diff(ends))
            cut_ = np.append(ends[some], ends[-1])
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), part, np.int32)), _binary(h[order], cut_), _binary(dig[node][order], cut_), _binary(n[node][order].astype(np.int32), cut_), _binary(sure[order].astype(np.uint8), cut_)], ["bucket", "part", "h", "dig", "n", "sure"])

    return df.select(text_col).mapInArrow(tidy(run), PACKED)


PACKED = "bucket int, part int, h binary, dig binary, n binary, sure binary"


def _entries(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries (h, dig, n, sure) of packed rows by h and size; where each h begins, and each run of sizes in it."""
    h, dig, n, sure = _joined(t.column("h"), np.uint64), _joined(t.column("dig"), np.int64), _joined(t.column("n"), np.int32), _joined(t.column("sure"), np.uint8)
    order = np.lexsort((255 - sure, dig, n, h))
    h, dig, n, sure = h[order], dig[order], n[order].astype(np.int64), sure[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (dig[1:] != dig[:-1])
    h, dig, n, sure = h[new], dig[new], n[new], sure[new]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    # leads stand for nodes of up to 1.2 times their size or less: of similar nodes they differ by under 1.8
    start = np.flatnonzero(first)
    led = np.repeat(np.maximum.reduceat(sure, start) == 2, np.diff(np.append(start, len(h)))) if len(h) else first
    begin = first.copy()
    begin[1:] |= np.where(led[1:], n[1:] > 2 * n[:-1], OVER * n[1:] > UNDER * n[:-1])
    return h, dig, n, sure, start, np.flatnonzero(begin)


def thinned(packed: DataFrame, p: Params) -> tuple[DataFrame, DataFrame | None]:
    """The packed rows without those nodes of a shingle that one task couldn't hold, and the edges (a, b) that join these.

    A bucket outgrows a task only if a shingle of it has very many nodes: one that isn't frequent in any slice but occurs
    in very many, or the leads of a very frequent one.  Such a bucket is dealt in parts; a shingle with `hot` nodes in a part
    is treated there as a very frequent one in a slice.  This goes on until no bucket is too large or nothing gives way.
    """

    def run(t: pa.Table) -> pa.Table:
        h, dig, n, sure, start, runs = _entries(t)
        count = np.diff(np.append(start, len(h)))
        heavy = np.repeat((count >= p.hot) & (sure[start] != 1), count)
        size = np.diff(np.append(runs, len(h)))
        lead = np.repeat(dig[runs], size)
        edge = heavy & (lead != dig)
        range_ = _range(n)
        last = np.append((h[1:] != h[:-1]) | (range_[1:] != range_[:-1]), True)
        keep = ~heavy | last
        left = [x[keep].tobytes() for x in (h, dig, n.astype(np.int32), np.where(heavy, 2, sure).astype(np.uint8))]
        edges = int(edge.sum())
        one = [t.column("bucket").slice(0, 1).combine_chunks(), t.column("chunk").slice(0, 1).combine_chunks(), *(pa.array([x]) for x in left), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())]
        two = [*(pa.nulls(edges, x.type) for x in one[:6]), pa.array(lead[edge]), pa.array(dig[edge])]
        return pa.table([pa.concat_arrays([x, y]) for x, y in zip(one, two, strict=True)], ["bucket", "part", "h", "dig", "n", "sure", "a", "b"])

    columns, edges, before = ["bucket", "part", "h", "dig", "n", "sure"], None, None
    packed = cut(packed)
    while True:
        bytes_ = (F.sum(F.length("h")) * 21 / 8).alias("bytes")
        large = packed.groupBy("bucket").agg(bytes_).filter(F.col("bytes") > 3 * p.unit_bytes)
        total = large.agg(F.sum("bytes")).first()[0]
        if not total or (before is not None and total > 0.9 * before):
            return packed, edges
        before = total
        tagged = packed.join(large.select("bucket", F.ceil(F.col("bytes") / p.unit_bytes).cast("int").alias("chunks")), "bucket", "left")
        dealt = tagged.filter("chunks IS NOT NULL").withColumn("chunk", F.pmod(F.xxhash64("part", "h"), F.col("chunks")).cast("int"))
        out = cut(dealt.drop("chunks", "part").groupBy("bucket", "chunk").applyInArrow(tidy_table(run), f"{PACKED}, a long, b long"))
        more = out.filter("bucket IS NULL").select("a", "b")
        edges = more if edges is None else edges.union(more)
        packed = cut(tagged.filter("chunks IS NULL").select(*columns).union(out.filter("bucket IS NOT NULL").select(*columns)))


def groups(packed: DataFrame, p: Params) -> DataFrame:
    """Nodes that share one of their first shingles and may be similar by size: (gid, dig), or sure edges (a, b)."""

    def run(t: pa.Table) -> pa.Table:
        h, dig, n, sure, _, start = _entries(t)
        size = np.diff(np.append(start, len(h)))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(dig.view(np.uint64)), dtype=np.uint64)])
            gid = mix64(total[start + size] - total[start] + size.astype(np.uint64)).view(np.int64)
        some = size > 1
        any_sure = np.maximum.reduceat(sure, start) > 0 if len(start) else some
        # of groups of the same nodes one is kept: one that is joined untested, if there is any, for its nodes stand for others
        order = np.lexsort((~any_sure, gid))
        once = np.zeros(len(gid), bool)
        once[order[np.append(True, gid[order][1:] != gid[order][:-1])[: len(gid)]]] = True
        test = some & once & ~any_sure & (size <= p.max_group)
        star = some & once & ~test
        row_test, row_star = np.repeat(test, size), np.repeat(star & some, size)
        lead = np.repeat(dig[start], size)
        row_star &= lead != dig
        gids, none = np.repeat(gid, size)[row_test], int(row_star.sum())
        return pa.table({"gid": pa.concat_arrays([pa.array(gids), pa.nulls(none, pa.int64())]), "a": pa.array(np.concatenate([dig[row_test], lead[row_star]])), "b": pa.concat_arrays([pa.nulls(len(gids), pa.int64()), pa.array(dig[row_star])])})

    return packed.groupBy("bucket").applyInArrow(tidy_table(run), "gid long, a long, b long")


def bloom(keys: DataFrame) -> np.ndarray:
    """A filter of at most 2^25 bits over the column `key`; a full one lets all pass."""
    keys = cut(keys)
    n = keys.count()
    bits = 1 << min(25, max(10, int(8 * n).bit_length()))
    at = keys.select(F.pmod("key", F.lit(bits)).cast("int").alias("at")).union(keys.select(F.pmod(F.shiftright("key", 30), F.lit(bits)).cast("int")))
    got = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)))).alias("w")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("w").to_numpy().view(np.uint64)
    return out


def _passes(filter_: np.ndarray, key: np.ndarray) -> np.ndarray:
    bits = np.int64(len(filter_) * 64)
    ok = np.ones(len(key), bool)
    for at in (key % bits, (key >> np.int64(30)) % bits):
        ok &= (filter_[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)) > 0
    return ok


def _key(dig: np.ndarray, id_hash: np.ndarray) -> np.ndarray:
    return dig ^ id_hash


def sets_of(df: DataFrame, p: Params, id_col: str, text_col: str, filter_: np.ndarray, full: bool, twins: np.ndarray) -> DataFrame:
    """dig, n, map (bitmap) and, if full, members of the nodes whose first document passes the filter."""
    names = ["dig", "n", "map", *["members"] * full]

    def run(batches):
        fresh = _Fresh()
        for b, col in slices(batches, text_col, SLICE):
            h, bounds = shingle_sets(col, p.width)
            dig = digests(h, bounds, twins, p.digest_bits)
            ok = _passes(filter_, _key(dig, b.column("id_hash").to_numpy())) & (np.diff(bounds) > 0)
            keep = fresh(dig, ok)
            h, bounds = _take(h, bounds, keep)
            maps = [bitmap(h[a:z]).tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(dig[keep]), pa.array(np.diff(bounds)), pa.array(maps, pa.binary()), *([_binary(h, bounds)] if full else [])], names)

    return df.select(F.xxhash64(id_col).alias("id_hash"), text_col).mapInArrow(tidy(run), "dig long, n long, map binary" + ", members binary" * full)


def candidate_links(members: DataFrame, sets: DataFrame, units: int) -> DataFrame:
    """Edges (a, b) that join the nodes of each group (gid, dig) which bitmaps and sizes can't keep apart."""

    def run(t: pa.Table) -> pa.Table:
        gid, dig = t.column("gid").to_numpy(), t.column("dig").to_numpy()
        nodes, first, at = np.unique(dig, return_index=True, return_inverse=True)
        sizes = t.column("n").to_numpy()[first]
        raw = t.column("map").combine_chunks() if t.num_rows else t.column("map")
        maps = [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in first]
        forest, links = Forest(len(nodes)), []
        order = np.argsort(gid, kind="stable")
        start = np.flatnonzero(np.append(True, gid[order][1:] != gid[order][:-1]))
        size = np.diff(np.append(start, len(gid)))
        for k in np.argsort(-size, kind="stable"):
            links += link(forest, sizes, maps, None, np.unique(at[order[start[k] : start[k] + size[k]]]))
        pairs = nodes[np.array(links, np.int64).reshape(-1, 2)]
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    rows = members.join(sets.select("dig", "n", "map").hint("merge"), "dig").select(F.pmod(F.xxhash64("gid"), F.lit(units)).alias("unit"), "gid", "dig", "n", "map")
    return rows.groupBy("unit").applyInArrow(tidy_table(run), "a long, b long")


def exact_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of each (unit, root); nodes that share a label need none.

    rows: unit, root, dig, label, n, map, members.  A node may occur more than once in a unit.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        root, dig, label, n = (t.column(c).to_numpy() for c in ("root", "dig", "label", "n"))
        raw_map, raw_set = (t.column(c).chunk(0) if t.num_rows else None for c in ("map", "members"))
        order, out = np.argsort(root, kind="stable"), []
        start = np.flatnonzero(np.append(True, root[order][1:] != root[order][:-1]))
        for a, z in zip(start, np.append(start[1:], len(root)), strict=True):
            nodes, first = np.unique(dig[order[a:z]], return_index=True)
            at = order[a:z][first]
            maps = [np.frombuffer(raw_map[int(i)].as_buffer(), np.uint64) for i in at]
            sets = [np.frombuffer(raw_set[int(i)].as_buffer(), np.uint64) for i in at]
            forest = Forest(len(nodes))
            _, one, of = np.unique(label[at], return_index=True, return_inverse=True)
            forest.up = np.minimum.reduceat(np.arange(len(nodes))[np.argsort(of, kind="stable")], np.searchsorted(np.sort(of), np.arange(len(one))))[of]

            def similar(i: int, j: int, sets=sets) -> bool:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                return UNDER * both >= OVER * (len(sets[i]) + len(sets[j]) - both)

            out += [(nodes[i], nodes[j]) for i, j in link(forest, n[at], maps, similar)]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("unit").applyInArrow(tidy_table(run), "a long, b long")


def link_components(components: DataFrame, sets: DataFrame, p: Params, units: int) -> DataFrame:
    """node and root of the components that exact links make within candidate components (node, root)."""
    n_of = components.groupBy("root").agg(F.count("*").alias("nodes"))
    blocks = F.ceil(F.col("nodes") / p.max_block).cast("int")
    placed = cut(components.join(n_of.hint("merge"), "root").select(F.col("node").alias("dig"), "root", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block")))
    one = F.col("blocks") == 1
    unit = F.when(one, F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(units)).cast("string")))
    to = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = placed.withColumn("to", F.explode(to)).select(F.coalesce(unit, F.concat_ws(":", F.col("root").cast("string"), F.col("to").cast("string"))).alias("unit"), "root", "dig", F.col("dig").alias("label"))
    links = cut(exact_links(first.join(sets.hint("merge"), "dig").select("unit", "root", "dig", "label", "n", "map", "members")))
    labels = connected_components(links)
    large = placed.filter(~one)
    if large.isEmpty():
        return labels
    # in a component of several blocks, nodes outside its largest group still have to meet all others
    labelled = cut(large.join(labels.toDF("dig", "label"), "dig", "left").withColumn("label", F.coalesce("label", "dig")))
    most = labelled.groupBy("root", "label").count().groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.sum("count").alias("all"), F.max("count").alias("top"))
    rest = labelled.join(most.withColumn("chunks", F.ceil((F.col("all") - F.col("top")) / p.max_block).cast("int")), "root").filter("chunks > 0")
    apart = F.col("label") != F.col("most")
    chunk = F.pmod(F.xxhash64("dig", F.lit(1)), F.col("chunks")).cast("int")
    name = F.concat_ws(":", F.col("root").cast("string"), F.col("i").cast("string"), F.col("c").cast("string")).alias("unit")
    left = rest.withColumn("i", F.col("block")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(name, "root", "dig", "label")
    right = rest.filter(apart).withColumn("c", chunk).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(name, "root", "dig", "label")
    more = cut(exact_links(left.union(right).join(sets, "dig").select("unit", "root", "dig", "label", "n", "map", "members")))
    return connected_components(links.union(more))


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:  # noqa: B008
    """n_shingles and component_id of every row of df.

    Two rows link if 100 * intersection >= 80 * union of their sets of distinct shingles (of lower-cased words; fewer
    than `width` words are one shingle).  component_id is the smallest id that links lead to, its own included.  Null
    and empty texts, and those without words, have no shingle and no link: their component is their own id.  Rows that
    share an id count each by itself.  A null id counts as larger than any other.  Whole texts count, of any length.
    Sets are compared by 64-bit hashes of their shingles; two digests of 64 bits tell different sets apart.
    """
    spark = df.sparkSession
    rows = cut(measured(df, p, id_col, text_col))
    docs = rows.filter("kind = 0").select("id", "n", "dig", "second")
    nodes = cut(docs.filter("n > 0").groupBy("dig").agg(F.min("id").alias("first"), F.min("second").alias("low"), F.max("second").alias("high")))
    twins = nodes.filter("low <> high").select("dig").toArrow().column("dig").to_numpy()  # n documents have about n * n / 2^65
    if len(twins):
        shared = F.broadcast(spark.createDataFrame([(int(x),) for x in twins], "dig long")).withColumn("shared", F.lit(True))
        docs = docs.join(shared, "dig", "left").withColumn("dig", F.when(F.col("shared"), F.col("second")).otherwise(F.col("dig")))
        nodes = docs.filter("n > 0").groupBy("dig").agg(F.min("id").alias("first"))
    # the sum of all sizes comes first, then what is frequent
    counts = rows.groupBy("kind", F.when(F.col("kind") == 1, F.col("dig")).alias("h")).agg(F.sum("n").alias("n")).filter((F.col("kind") == 0) | (F.col("n") >= p.hot))
    counts = counts.orderBy("kind", F.desc("n"), "h").limit(p.max_hot + 1).toArrow()
    kind = counts.column("kind").to_numpy()
    hot = np.sort(counts.column("h").drop_null().to_numpy().view(np.uint64)[: p.max_hot])
    total = int(counts.column("n").to_numpy()[kind == 0].sum())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, int(total * 0.21 * 21 / p.unit_bytes))

    def keys(found: DataFrame) -> DataFrame:
        return found.select(F.col("dig").bitwiseXOR(F.xxhash64("first")).alias("key"))

    packed, more = thinned(prefixes(df, p, text_col, hot, buckets, twins), p)
    met = cut(groups(packed, p))
    members = cut(met.filter("gid IS NOT NULL").select("gid", F.col("a").alias("dig")).distinct())
    edges = met.filter("gid IS NULL").select("a", "b")
    edges = edges if more is None else edges.union(more)
    survivors = cut(members.select("dig").union(edges.select("a")).union(edges.select("b")).distinct().join(nodes.select("dig", "first").hint("merge"), "dig"))
    filter_ = bloom(keys(survivors))
    maps = cut(sets_of(df, p, id_col, text_col, filter_, False, twins))
    size = members.join(maps.hint("merge"), "dig").agg(F.sum(F.length("map") + 32)).first()[0] or 0
    candidates = connected_components(edges.union(candidate_links(members, maps, max(parts, int(size / p.unit_bytes) + 1))))
    filter_ = bloom(keys(survivors.join(candidates.select(F.col("node").alias("dig")).hint("merge"), "dig")))
    sets = cut(sets_of(df, p, id_col, text_col, filter_, True, twins))
    size = sets.agg(F.sum(F.length("members") + F.length("map"))).first()[0] or 0
    labels = link_components(candidates, sets, p, max(parts, int(size / p.unit_bytes) + 1)).toDF("dig", "root")
    linked = labels.join(survivors.hint("merge"), "dig")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component"))
    component = linked.join(smallest.hint("merge"), "root").select("dig", "component")
    known = nodes.join(component.hint("merge"), "dig", "left").select("dig", F.coalesce("component", "first").alias("component"))
    out = docs.join(known.hint("merge"), "dig", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(df: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """The rows of df (doc_id, text and others) without near duplicates: of each group the row with the smallest id.

    Null ids come last; rows that share an id go by a hash of all columns; of wholly equal rows one stays.  Rows without
    words link with nothing, so all of them stay.
    """
    columns = df.columns
    # two hashes of 64 bits: one alone would take some different rows for equal among 10^10
    key = F.struct(F.xxhash64(*(F.col(c) for c in columns)).alias("a"), F.xxhash64(F.lit(1), *(F.col(c) for c in columns)).alias("b"))
    ids = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), key.alias("key"))
    found = cut(jaccard_groups(df.select(ids.alias("row"), "text"), "row", "text", p).filter("n_shingles > 0"))
    goes = found.filter("row <> component_id").select(F.col("row.key").alias("__key")).distinct()
    again = cut(found.filter("row = component_id").groupBy("row.key").count().filter("count > 1").select(F.col("key").alias("__key")))
    keyed = df.withColumn("__key", key)
    out = keyed.join(goes.union(again), "__key", "left_anti")
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    return out.select(*columns)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; nulls, texts without words, ties and repeats as in `jaccard_groups`."""
    return jaccard_groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh
  FROM d),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS h FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 80 * (p.n + q.n - o)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS r FROM n UNION SELECT reach.a, sides.b FROM reach JOIN sides ON sides.a = reach.r)
SELECT n.doc_id, n.n AS n_shingles, (SELECT min(r) FROM reach WHERE reach.a = n.doc_id) AS component_id FROM n
"""
