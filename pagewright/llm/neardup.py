"""Near duplicates by SetSketch registers.

A document is the set of its distinct word shingles. Its sketch has `REGISTERS` registers; each is the minimum of an
exponential hash over the set, truncated on a logarithmic scale of base `BASE`: registers of a union are the maxima of
the registers. `ROWS` neighbouring registers form a band; documents that share a band meet in a bucket. For documents
that meet, the similarity is estimated jointly from which registers are larger, equal or smaller and from both set
sizes, by likelihood; those that could be similar enough are verified on their full sets.

Equal sets are one node, so that copies never meet each other. In a bucket no pairs are made: first every node is held
against the bucket's smallest node only, and plausible pairs are joined to clusters. What is left are buckets with
members of several clusters; there, and only there, members that aren't of the bucket's largest cluster are compared with
all others by their registers, in blocks, and give pairs that span what is plausible. Then each cluster gets the full sets
of its members, and links are verified inside it: a set is held against those that nothing has reached yet. A cluster of
several blocks is first held against its hub, the member that most others met first, block by block; what the hub doesn't
reach then meets all blocks of members of a possible size. So a large group of copies of one text costs as much as it has
members, and only members that the hub doesn't reach cost more.

Similar pairs of at least `SIMILAR` percent miss every band with a probability of (1 - 0.8**4)**32 < 5e-8, and fall below
the estimate's cut at `ESTIMATE` with one below 1e-8.

Defined results: null, empty and wordless texts have an empty set, link with nothing and stay; a text of fewer words than
a shingle is one shingle; repeated rows have one component; a component's id is its smallest non-null id, null if all
are; other columns are ignored by `components` and kept by `deduplicate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

REGISTERS, ROWS = 128, 4
BASE, RATE = 1.005, 20.0
SIMILAR, ESTIMATE = 80, 0.58
#: Members of a block, and bytes of their sets, when a bucket or a cluster is compared within.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Bits of the filter of wanted ids for each id, and at most (32 MB are sent to the executors). A full filter lets all pass.
FILTER_BITS, FILTER_MOST = 16, 1 << 28
_R = np.random.default_rng(20240229)
_A = (_R.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = (_R.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) & ~np.uint64(1)).astype(np.uint32)
_C = _R.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles: A-Z lower-cased, words parted by ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ w[i : len(w) - size + 1 + i]) * _MIX
        h ^= h >> np.uint64(32)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def registers(h: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes, as 16-bit registers."""
    lo, hi = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 1024):
        v = np.multiply.outer(_A, lo[a : a + 1024])
        v += np.multiply.outer(_B, hi[a : a + 1024])
        v += _C[:, None]
        np.minimum(least, v.min(axis=1), out=least)
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def at_least(na: np.ndarray, nb: np.ndarray, larger: np.ndarray, smaller: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the likeliest similarity of two sketched sets is at least the given one.

    na, nb: set sizes; larger, smaller: how many registers of the first are larger and smaller. The likelihood is
    concave, so that its slope at the given similarity tells on which side the maximum lies."""
    equal = REGISTERS - larger - smaller
    u, v = na / (na + nb), nb / (na + nb)
    c = (BASE - 1) / BASE
    x, y = u - v * similarity, v - u * similarity
    ok = (x > 0) & (y > 0)
    x, y = np.where(ok, x, 0.5), np.where(ok, y, 0.5)
    p, q = -np.log(1 - x * c) / np.log(BASE), -np.log(1 - y * c) / np.log(BASE)
    dp, dq = -v * c / (np.log(BASE) * (1 - x * c)), -u * c / (np.log(BASE) * (1 - y * c))
    slope = larger * dp / p + smaller * dq / q - equal * (dp + dq) / np.maximum(1 - p - q, 1e-9)
    return ok & (slope >= 0)


def sketch(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, node (digest of the set; null if empty), n (set size), sketch (registers as bytes). One pass."""
    common.ship(docs.sparkSession)

    def run(batches):
        common.only("neardup")
        for b in batches:
            nodes, sizes, kept = [], [], []
            for t in b.column(1).to_pylist():
                h = shingles(t, k)
                nodes.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sizes.append(len(h))
                kept.append(registers(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary())], [key, "node", "n", "sketch"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, node binary, n long, sketch binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def buckets(nodes: DataFrame) -> DataFrame:
    """band, value (its registers as one number), node: a row for every band of a node."""

    def run(batches):
        common.only("neardup")
        bands = REGISTERS // ROWS
        for b in batches:
            if b.num_rows:
                values = _matrix(b.column(1)).reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, len(values) + 1, bands, dtype=np.int32), pa.array(values))], ["node", "v"])

    return nodes.select("node", "sketch").mapInArrow(run, "node binary, v array<long>").select(F.posexplode("v").alias("band", "value"), "node")


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (x, y) those whose sketches let them be similar enough."""
    a = nodes.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
    b = nodes.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
    both = pairs.join(a, "x").join(b, "y").filter(f"100 * least(nx, ny) >= {SIMILAR} * greatest(nx, ny)").select("x", "y", "nx", "ny", "sx", "sy")

    def run(batches):
        common.only("neardup")
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b.column(4)), _matrix(b.column(5))
                larger, smaller = (x > y).sum(axis=1), (x < y).sum(axis=1)
                ok = np.flatnonzero(at_least(b.column(2).to_numpy(), b.column(3).to_numpy(), larger, smaller, ESTIMATE))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok))], ["x", "y"])

    return both.mapInArrow(run, "x binary, y binary")


def _filter_of(ids: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the ids (column h: 64-bit hashes), as 64-bit words. It is made by the executors; the driver gets
    its words, 32 MB at most."""
    bits = min(FILTER_MOST, max(64, 1 << (FILTER_BITS * count).bit_length()))
    place = F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1)))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint64)


def _passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    bits = np.uint64(64 * len(words) - 1)
    ok = np.ones(len(h), bool)
    for p in (h & bits, (h >> np.uint64(32)) & bits):
        ok &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    return ok


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """node, set (sorted hashes as bytes) of at least the wanted nodes (node, id): documents with their ids are read again.

    A Bloom filter of the ids goes to the documents, so that no text is shuffled; some others pass it too."""
    ids = wanted.select(F.xxhash64("id").alias("h"))
    words = common.ship(docs.sparkSession).sparkContext.broadcast(_filter_of(ids, wanted.count()))

    def run(batches):
        common.only("neardup")
        for b in batches:
            some = np.flatnonzero(_passes(words.value, b.column(0).to_numpy().view(np.uint64)))
            nodes, sets = [], []
            for t in b.column(1).take(pa.array(some)).to_pylist():
                h = shingles(t, k).tobytes()
                if h:
                    nodes.append(xxhash.xxh3_128_digest(h))
                    sets.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "set"])

    # an id may stand for several texts, and a text that passes be a copy of a wanted one
    found = docs.select(F.xxhash64(key).alias("h"), text).mapInArrow(run, "node binary, set binary")
    return found.groupBy("node").agg(F.first("set").alias("set"))


def linked(sizes: np.ndarray, flat: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """Links that hold together what is linked among some sets, given as numbers of their elements one after another; the
    second of a link is what the first reached. Also how many of the links hang on the first set.

    A set is held against those that no set has reached yet: copies of one text are reached from the first of them, and
    are not held against each other. The result spans the components of all links."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    out: list[tuple[int, int]] = []
    elements, begins, counts = flat, first[:-1], sizes  # of the open sets; rebuilt when half of them are gone
    held = np.arange(len(sizes))
    alive = np.ones(len(sizes), bool)
    queue: list[int] = []
    hanging = None
    for seed in range(len(sizes)):
        if not alive[seed]:
            continue
        if seed and hanging is None:
            hanging = len(out)
        alive[seed] = False
        queue.append(seed)
        while queue:
            i = queue.pop()
            if not alive.any():
                return out, len(out) if hanging is None else hanging
            if 2 * np.count_nonzero(alive[held]) < len(held):
                held = held[alive[held]]
                counts = sizes[held]
                begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
                elements = np.concatenate([flat[first[j] : first[j + 1]] for j in held])
            mine = flat[first[i] : first[i + 1]]
            mark[mine] = True
            shared = np.add.reduceat(mark[elements], begins, dtype=np.int64)
            mark[mine] = False
            new = held[alive[held] & (100 * shared >= SIMILAR * (counts + sizes[i] - shared))]
            alive[new] = False
            out += [(i, j) for j in new.tolist()]
            queue += new.tolist()
    return out, len(out) if hanging is None else hanging


def _near_sizes(n) -> F.Column:
    """Classes of set sizes: similar sets are in the same one or in neighbouring ones."""
    return F.floor(F.log(F.col(n)) / np.log(100 / SIMILAR) + 1e-9).cast("int")


def _blocks(count: str, size: str | None = None) -> F.Column:
    by_count = F.ceil(F.col(count) / BLOCK)
    return (F.greatest(by_count, F.ceil(F.col(size) / BLOCK_BYTES)) if size else by_count).cast("int")


def facing(rows: DataFrame, keys: list[str], size: str | None = None) -> DataFrame:
    """Groups (keys, near, s, q) in which every row that seeks (column seek) meets every row with the same keys and a
    possible set size (column n), once each; of the columns of rows, and side (0: seeks, 1: is met).

    Both sides are dealt into blocks; a group has one block of each, so that none is larger than two blocks, and rows are
    copied as often as the other side has blocks."""
    by = [*keys, "near"]
    near = _near_sizes("n")
    met = rows.withColumn("near", near)
    seeks = rows.filter("seek").withColumn("near", F.explode(F.array(near - 1, near, near + 1)))
    weigh = lambda df, c, b: df.groupBy(*by).agg(F.count(F.lit(1)).alias(c), (F.sum(size) if size else F.lit(0)).alias(b))
    counts = weigh(met, "cq", "bq").join(weigh(seeks, "cs", "bs"), by)
    counts = counts.select(*by, _blocks("cq", "bq" if size else None).alias("nq"), _blocks("cs", "bs" if size else None).alias("ns"))
    own = F.xxhash64("node")
    seeks = seeks.join(counts, by).withColumn("s", F.pmod(own, "ns").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).withColumn("side", F.lit(0))
    met = met.join(counts, by).withColumn("q", F.pmod(own, "nq").cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("ns") - 1))).withColumn("side", F.lit(1))
    return seeks.unionByName(met).drop("ns", "nq")


_LINKS = pa.schema([("x", pa.binary()), ("y", pa.binary()), ("first", pa.bool_())])


def _spanning(table: pa.Table) -> pa.Table:
    """Links that span what is linked among a group's sets, those of side 0 first, and whether they hang on the first."""
    side = table.column("side").to_numpy()
    order = np.argsort(side, kind="stable").tolist()
    names, all_ = table.column("node").to_pylist(), table.column("set").to_pylist()
    by_node = {names[i]: all_[i] for i in reversed(order)}  # a set may be on both sides
    node = list(dict.fromkeys(names[i] for i in order))
    sets = [np.frombuffer(by_node[x], np.uint64) for x in node]
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    got, hanging = linked(np.array([len(x) for x in sets]), flat)
    if side.min():
        hanging = 0
    return pa.Table.from_arrays([pa.array([node[i] for i, _ in got], pa.binary()), pa.array([node[j] for _, j in got], pa.binary()), pa.array(np.arange(len(got)) < hanging)], schema=_LINKS)


def verified(sets: DataFrame, clusters: DataFrame, likely: DataFrame, store: common.Store) -> DataFrame:
    """Links (x, y) that span what is linked on full sets within each cluster (node, root). likely: pairs (x, y) of a
    member and the one it met first."""
    kind = "x binary, y binary, first boolean"
    whole = store(sets.join(clusters, "node").select("root", "node", "set", F.octet_length("set").alias("bytes"), (F.octet_length("set") / 8).cast("long").alias("n")), "sets")
    total = whole.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("b")).filter("c > 1")
    total = store(total.select("root", ((F.col("c") <= BLOCK) & (F.col("b") <= BLOCK_BYTES)).alias("small")), "totals")
    # A cluster of one block, as nearly all are, is one group.
    small = whole.join(total.filter("small").select("root"), "root").select("root", F.lit(1).alias("side"), "node", "set")
    links = store(small.groupBy("root").applyInArrow(_spanning, kind), "links")
    if total.filter("not small").isEmpty():
        return links.select("x", "y")

    large = whole.join(total.filter("not small").select("root"), "root")
    met = likely.groupBy(F.col("y").alias("node")).agg(F.count(F.lit(1)).alias("c")).join(clusters, "node")
    hubs = met.groupBy("root").agg(F.max_by("node", F.struct("c", "node")).alias("hub"))
    hub = large.join(hubs, (large.root == hubs.root) & (F.col("node") == F.col("hub"))).select(large.root, "node", "set", "bytes", "n", F.lit(True).alias("seek"))
    rest = large.select("root", "node", "set", "bytes", "n", F.lit(False).alias("seek"))
    first = store(facing(rest.unionByName(hub), ["root"], "bytes").groupBy("root", "near", "s", "q").applyInArrow(_spanning, kind), "hub_links")
    reached = first.filter("first").select(F.explode(F.array("x", "y")).alias("node")).distinct()
    lone = large.select("root", "node", "set", "bytes", "n").join(reached.withColumn("reached", F.lit(True)), "node", "left").withColumn("seek", F.col("reached").isNull()).drop("reached")
    second = facing(lone, ["root"], "bytes").groupBy("root", "near", "s", "q").applyInArrow(_spanning, kind)
    return links.select("x", "y").unionByName(first.select("x", "y")).unionByName(second.select("x", "y"))


def connected(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (x, y): the smallest node that it reaches.

    Large-star and small-star steps take turns until the stars don't change: a number of rounds that grows with the
    logarithm of the longest chain. Every round is checkpointed in the shared folder."""
    edges = common.keep(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        # large star: the neighbours above a node go to the smallest of its neighbourhood
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and those below it go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        both = large.join(low, "u")
        small = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = common.keep(small.filter("u != v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        common.tidy(links.sparkSession)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _crossing(members: DataFrame, nodes: DataFrame, clusters: DataFrame, store: common.Store) -> DataFrame:
    """Pairs (x, y) that span the plausible pairs between members of a bucket that are in different clusters.

    Only buckets with several clusters are looked at. There, members that aren't of the cluster with most members seek
    all members, in blocks; a group gives fewer pairs than it has members."""
    c = members.join(clusters, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mine = c.groupBy("band", "value", "root").agg(F.count(F.lit(1)).alias("size"))
    mixed = mine.groupBy("band", "value").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").drop("roots")
    left = c.join(mixed, ["band", "value"]).join(nodes.select("node", "n", "sketch"), "node")
    left = store(left.select("band", "value", "node", "root", "n", "sketch", (F.col("root") != F.col("largest")).alias("seek")), "mixed")
    schema = pa.schema([("x", pa.binary()), ("y", pa.binary())])

    def run(table):
        s, n, node = _matrix(table.column("sketch")), table.column("n").to_numpy(), table.column("node").to_pylist()
        number: dict[bytes, int] = {}
        root = np.array([number.setdefault(x, len(number)) for x in table.column("root").to_pylist()])
        side = table.column("side").to_numpy()
        out: list[tuple[bytes, bytes]] = []
        theirs = np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0):
            j = theirs[(root[theirs] != root[i]) & (100 * np.minimum(n[theirs], n[i]) >= SIMILAR * np.maximum(n[theirs], n[i]))]
            if len(j):
                larger, smaller = (s[i] > s[j]).sum(axis=1), (s[i] < s[j]).sum(axis=1)
                for x in j[at_least(np.full(len(j), n[i]), n[j], larger, smaller, ESTIMATE)]:
                    if root[x] != root[i]:
                        out.append((node[i], node[x]))
                        root[root == root[x]] = root[i]
        return pa.Table.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], schema=schema)

    return facing(left, ["band", "value"]).groupBy("band", "value", "near", "s", "q").applyInArrow(run, "x binary, y binary")


def components(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept for every row."""
    spark = common.ship(docs.sparkSession)
    store = common.Store(spark, "neardup")
    rows = store(sketch(docs, k, key, text), "rows")
    nodes = store(rows.filter("node is not null").groupBy("node").agg(F.min(key).alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    met = buckets(nodes)
    hubs = met.groupBy("band", "value").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("band", "value", "hub")
    members = store(met.join(hubs, ["band", "value"]), "members")

    # Clusters of nodes that may be linked, by their sketches: first each node with the smallest members of its buckets,
    # then what else could join two clusters. Their full sets are read once.
    stars = members.filter("node != hub").select(F.col("node").alias("x"), F.col("hub").alias("y")).distinct()
    likely = store(plausible(stars, nodes), "likely")
    clusters = store(connected(likely), "stars")
    clusters = store(connected(clusters.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(_crossing(members, nodes, clusters, store))), "clusters")
    store.drop("members", "mixed", "stars")
    wanted = store(clusters.join(nodes.select("node", "id"), "node"), "wanted")
    component = store(connected(verified(full_sets(docs, wanted, k, key, text), clusters, likely, store)), "components")
    store.drop("likely", "clusters", "wanted", "sets", "totals", "links", "hub_links")
    named = component.join(nodes.select("node", "id"), "node")
    smallest = named.groupBy("root").agg(F.min("id").alias("smallest"))
    by_node = nodes.select("node", "id").join(component, "node", "left").join(smallest, "root", "left").select("node", F.coalesce("smallest", "id").alias("component_id"))
    out = rows.select(key, "n", "node").join(by_node, "node", "left")
    own = F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col(key) == own, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id. Documents without words stay.

    Rows are dropped by id: where an id stands for several rows, all stay if one does."""
    stays = F.col("kept") | (F.col("n_shingles") == 0) | F.col("component_id").isNull()
    drop = components(docs, k, key, text).groupBy(F.col(key).alias("drop_key")).agg(F.max(stays).alias("stays")).filter("not stays")
    return docs.join(drop.select("drop_key").hint("merge"), F.col(key).eqNullSafe(F.col("drop_key")), "left_anti")
