"""N-gram Jaccard join by a token-group matrix.

Sets with equal content are one node. Nodes that may be similar share one of their rarest tokens (a prefix that no qualifying
pair can miss). Of the nodes that share a rare token the one that shares most leads; the groups of similar sets behind one
leader are the matrix' columns: each group keeps the union of its tokens, a query's overlap with the union bounds its similarity
to every member, and only groups whose bound qualifies are opened and compared set by set. Queries meet groups, not sets, so that
many copies of one text cost blocks of rows and not pairs of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import CHUNK_BYTES, Words, chunks, few_tasks, mix, no_text, texts_of, whole, windows, words_of, written

#: Places of the table that counts the tokens of all rows, and how many of them travel together; rows per block of a group's members and queries.
PLACES, TOGETHER = 1 << 21, 1 << 16
MEMBERS, QUERIES = 512, 1_000
FILTER_BITS = 26
BLOCK = ["grp", "mb", "qb"]


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its runs of `width` words; a shorter text is one run, a text without words none."""
    hashes = windows(words.hash, width, 0x8CB92BA72F3D8DD7)
    fits = whole(words.first, width, len(hashes)) if len(hashes) else np.zeros(0, bool)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(hashes[a:b][fits[a:b]]))
        elif b > a:
            key = np.uint64(b - a)
            for h in words.hash[a:b]:
                key = mix(np.array([key ^ h]))[0]
            out.append(np.array([key], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(size: int, percent: int) -> int:
    """Least overlap with any set of similarity `percent` or more."""
    return -(-size * percent // 100)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def token_loads(docs: DataFrame, width: int) -> np.ndarray:
    """How often the tokens of all rows fall on each place of a table of fixed size, in sixths of a power of two.

    A token's place is its lowest bits, so a place's count bounds its tokens' counts from above. Every row is counted; a task
    sends one table and the driver gets one byte per place.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(PLACES, np.uint32)
        for batch in batches:
            for piece in chunks(batch, "text"):
                sets = shingle_sets(words_of(texts_of(piece.column("text")), lower=True), width)
                for tokens in sets:
                    np.add.at(loads, (tokens & np.uint64(PLACES - 1)).astype(np.int64), np.uint32(1))
        if loads.any():
            compressor = zstandard.ZstdCompressor()
            packed = [compressor.compress(part.tobytes()) for part in loads.reshape(-1, TOGETHER)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(packed)), pa.int32()), pa.array(packed, pa.binary())], ["part", "loads"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("loads").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(opener.decompress(packed), np.uint32).astype(np.int64)
        levels = [np.floor(6 * np.log2(1 + loads)).astype(np.uint8).tobytes() for loads in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["part", "loads"])

    tables = docs.select("text").mapInArrow(count, "part int, loads binary").repartition("part")
    out = np.zeros((PLACES // TOGETHER, TOGETHER), np.uint8)
    for row in tables.mapInArrow(add, "part int, loads binary").collect():
        out[row["part"]] = np.frombuffer(row["loads"], np.uint8)
    return out.ravel()


def sketches(docs: DataFrame, width: int, percent: int, loads: np.ndarray) -> DataFrame:
    """Per row: id, digest of the text, set size, node (digest of the set), the prefix (its rarest tokens) and the tokens' bitmap."""
    listed = docs.sparkSession.sparkContext.broadcast(loads)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = listed.value
        for batch in batches:
            for piece in chunks(batch, "text"):
                sizes, nodes, prefixes, bits = [], [], [], []
                for tokens in shingle_sets(words_of(texts_of(piece.column("text")), lower=True), width):
                    n = len(tokens)
                    sizes.append(n)
                    nodes.append(np.int64(mix(np.array([mix(tokens ^ np.uint64(n)).sum(dtype=np.uint64)])).view(np.int64)[0]) if n else None)
                    bits.append(token_bits(tokens) if n else None)
                    # Tokens are sorted and the sort is stable: by load, then by token.
                    rare = np.argsort(load[(tokens & np.uint64(PLACES - 1)).astype(np.int64)], kind="stable")
                    prefixes.append(tokens[rare[: n - needed(n, percent) + 1 if n else 0]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("said"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    ["id", "said", "n_shingles", "node", "prefix", "bits"],
                )

    return docs.mapInArrow(sketch, f"id {docs.schema['id'].dataType.simpleString()}, said long, n_shingles long, node long, prefix array<long>, bits binary")


def _packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, said, packed) of the rows of `docs` that can be among those of `wanted` (id, said): a filter of fixed size (8 MB) spares
    the others the shuffle. Texts go through it as zstandard frames, less than half of what the shuffle's own packing leaves."""
    slot = F.shiftrightunsigned(F.xxhash64("id", "said"), 64 - FILTER_BITS)
    bits = wanted.groupBy(F.shiftright(slot, 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int"))).alias("bits"))
    found = bits.toPandas()
    table = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    table[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, table = zstandard.ZstdCompressor(level=3), shared.value
        for batch in batches:
            s = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((table[s >> 5] >> (s & 31).astype(np.uint32) & np.uint32(1)).astype(bool)))
            packed = [compressor.compress(text.encode()) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("said"), pa.array(packed, pa.binary())], ["id", "said", "packed"])

    return docs.select("id", "said", "text", slot.alias("slot")).mapInArrow(pack, f"id {docs.schema['id'].dataType.simpleString()}, said long, packed binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch with texts again, a few rows at a time."""
    opener, at = zstandard.ZstdDecompressor(), 0
    while at < batch.num_rows:
        texts, size, upto = [], 0, at
        while upto < batch.num_rows and size < CHUNK_BYTES:
            texts.append(opener.decompress(batch.column("packed")[upto].as_py()).decode())
            size += len(texts[-1])
            upto += 1
        part = batch.slice(at, upto - at)
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*part.schema.names[:-1], "text"])
        at = upto


def token_bits(tokens: np.ndarray) -> bytes:
    """Bitmap of a set: one bit per token, with about twice as many bits as tokens (a power of two)."""
    size = min(max(256, 1 << (2 * len(tokens)).bit_length()), 1 << 17)
    bits = np.zeros(size, dtype=bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap in `size` bytes: the upper halves laid over the lower ones."""
    out = np.frombuffer(bits, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return out


def _unions(bits: Sequence[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of a block's members in `size` bytes, one per row, and their union."""
    matrix = np.stack([folded(b, size) for b in bits])
    return matrix, np.bitwise_or.reduce(matrix)


def blocks(members: DataFrame, queries: DataFrame) -> DataFrame:
    """Members (kind 0) and queries (kind 1, or 2 in their own group) of each group, cut into blocks that all meet.

    No task needs more than a block of members at once, and a crowded group is dealt to many tasks.
    """
    kind = F.when(F.col("own"), 2).otherwise(1).alias("kind")
    rows = members.select("grp", F.lit(0).alias("kind"), "node").unionByName(queries.select("grp", kind, "node"))
    blocks_of = lambda those, size: F.ceil(F.count_if(those) / size).cast("int")
    sizes = rows.groupBy("grp").agg(blocks_of(F.col("kind") > 0, QUERIES).alias("qs"), blocks_of(F.col("kind") == 0, MEMBERS).alias("ms")).where("qs > 0 and ms > 0")
    part = F.xxhash64("node", F.lit(13))
    one, every = lambda n: F.array(F.pmod(part, n).cast("int")), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = rows.join(sizes, "grp").withColumn("mb", F.explode(F.when(F.col("kind") == 0, one("ms")).otherwise(every("ms"))))
    return placed.withColumn("qb", F.explode(F.when(F.col("kind") > 0, one("qs")).otherwise(every("qs")))).select(*BLOCK, "kind", "node")


def qualifying(nodes: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Queries (rows of `placed`) that a block of their group may hold a similar set for, and those sets' rows.

    The matrix keeps token unions as bitmaps. Bits of the query that the union lacks are tokens that no member has, which
    bounds the overlap. Where the union's bound is met, the bitmaps of members of a fitting size bound each similarity from
    both sides. Members are kept by the length of their bitmaps: folded to that of a much smaller set, a bitmap would be full
    and rule nothing out.
    """
    rows = placed.join(nodes.select("node", "n", "component", "bits"), "node").repartition(*BLOCK).sortWithinPartitions(*BLOCK, "kind")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        members: list[tuple] = []
        asked: set[int] = set()
        lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None
        columns: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            out: list[tuple] = []
            for *key, kind, node, n, component, bits in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                if tuple(key) != group:
                    group, members, asked, lengths, columns = tuple(key), [], set(), None, {}
                if kind == 0:
                    members.append((len(bits), n, node, component, bits))
                    continue
                if lengths is None:
                    members.sort(key=lambda m: m[:2])
                    cut = {length: [m for m in members if m[0] == length] for length in {m[0] for m in members}}
                    lengths = {length: tuple(np.array([m[i] for m in those], np.int64) for i in (1, 2, 3)) for length, those in cut.items()}
                    columns = {(length, length): _unions([m[4] for m in those], length) for length, those in cut.items()}
                found = False
                for length, (sizes, names, theirs) in lengths.items():
                    a, b = np.searchsorted(sizes, needed(n, percent)), np.searchsorted(sizes, n * 100 // percent, side="right")
                    if a == b:
                        continue
                    size = min(length, len(bits))
                    if (length, size) not in columns:
                        columns[length, size] = _unions(columns[length, length][0], size)
                    matrix, union = columns[length, size]
                    mine = folded(bits, size)
                    if n - int(np.bitwise_count(mine & ~union).sum()) < needed(n, percent):
                        continue
                    matrix, sizes, names, theirs = matrix[a:b], sizes[a:b], names[a:b], theirs[a:b]
                    shared = np.minimum(n - np.bitwise_count(mine & ~matrix).sum(axis=1, dtype=np.int64), sizes - np.bitwise_count(matrix & ~mine).sum(axis=1, dtype=np.int64))
                    near = (100 * shared >= percent * (n + sizes - shared)) & (theirs != component)
                    near = np.flatnonzero(near & ((kind == 1) | (names < node)))
                    found |= len(near) > 0
                    out += [(*key, 0, int(name)) for name in names[near] if name not in asked]
                    asked.update(names[near])
                if found:
                    out.append((*key, kind, node))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            made = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], [*BLOCK, "kind", "node"])

    return rows.select(*BLOCK, "kind", "node", "n", "component", "bits").mapInArrow(bound, "grp long, mb int, qb int, kind int, node long")


def open_groups(docs: DataFrame, nodes: DataFrame, members: DataFrame, queries: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of queries (node, grp, own) to members (node, grp) of their group.

    Only qualifying queries open their block; then texts are fetched and sets compared. A query takes one link to each
    component of `nodes` and none to its own, as more would say nothing new; in its own group it looks at smaller nodes only.
    """
    asking = written(qualifying(nodes, blocks(members, queries), percent), "qualifying")
    rows = written(asking.join(nodes.select("node", "id", "said", "component"), "node"), "probes")
    texts = _packed(docs, rows.select("id", "said")).withColumnsRenamed({"id": "__id", "said": "__said"})
    placed = rows.join(texts, F.col("id").eqNullSafe(F.col("__id")) & (F.col("said") == F.col("__said"))).select(*BLOCK, "kind", "node", "component", "packed").repartition(*BLOCK).sortWithinPartitions(*BLOCK, "kind", "node")

    def open_them(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        held: list[tuple[int, int, np.ndarray]] = []
        for batch in batches:
            for piece in _unpacked(batch):
                sets = shingle_sets(words_of(texts_of(piece.column("text")), lower=True), width)
                out: list[tuple[int, int]] = []
                for *key, kind, node, mine, tokens in zip(*[piece.column(i).to_pylist() for i in range(6)], sets, strict=True):
                    if tuple(key) != group:
                        group, held = tuple(key), []
                    if kind == 0:
                        held.append((node, mine, tokens))
                        continue
                    known = {mine}
                    for other, theirs, those in held:
                        if theirs not in known and (kind == 1 or other < node) and similar(tokens, those, percent):
                            out.append((node, other))
                            known.add(theirs)
                a, b = zip(*out, strict=True) if out else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return placed.mapInArrow(open_them, "a long, b long")


def ask(docs: DataFrame, reps: DataFrame, shared: DataFrame, homes: DataFrame, links: DataFrame, listings: int, width: int, percent: int) -> DataFrame:
    """The links so far and those that nodes find in their own group and in the other groups of their lists.

    Lists whose nodes are all linked are done with. A node asks groups that hold nodes of its size in a list of its own, and is
    compared with nodes of other components only. `listings` is the number of rows of `shared`.
    """
    linked = components(links)
    component = F.coalesce("component", "node").alias("component")
    nodes = written(reps.join(linked, "node", "left").select(*reps.columns, component), "components")
    placed = shared.select("token", "node", "n").join(homes.join(linked, "node", "left").select("node", "grp", component), "node")
    placed = written(few_tasks(placed, listings), "placed")
    open_lists = placed.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token")
    placed = written(few_tasks(placed.drop("component").join(open_lists, "token"), listings), "open-lists")
    listed = placed.select("node", "grp").distinct()
    columns = placed.groupBy("token", F.col("grp").alias("other")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    near = (F.col("least") * percent <= F.col("n") * 100) & (F.col("n") * percent <= F.col("most") * 100)
    others = placed.join(columns, "token").where("grp < other").where(near).select("node", F.col("other").alias("grp")).distinct()
    asks = listed.withColumn("own", F.lit(True)).unionByName(others.withColumn("own", F.lit(False)))
    asks = written(few_tasks(asks, listings), "asks")
    return written(links.unionByName(open_groups(docs, nodes, listed, asks, width, percent)), "links-found")


def together(nodes: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, rows) of prefix tokens that several nodes list; rows are the nodes that list the token.

    Sets that fit in size lie in one or two neighbouring bands of sizes, each wider than the ratio that fits. A list whose nodes
    all lie in bands of their own is left by those without a neighbouring band: they are similar to no other node of the list.
    """
    wide = max(math.log(100 / percent), 0.01) * 1.0001
    bit = lambda step: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.floor(F.log("n") / wide) + step, F.lit(64)).cast("int"))
    prefixes = nodes.select("node", "n", F.explode("prefix").alias("token")).repartition("token")
    # The ends of a list read all columns, so that Spark deals the rows out once for the lists and for the join with them.
    ends = [F.min("node").alias("least"), F.max("node").alias("most")]
    lists = prefixes.groupBy("token").agg(F.count("*").alias("rows"), F.bit_or(bit(0)).alias("bands"), *ends).where("least <> most").drop("least", "most")
    fits = (F.col("rows") > F.bit_count("bands")) | (F.col("bands").bitwiseAND(bit(1).bitwiseOR(bit(-1))) != 0)
    return prefixes.join(lists, "token").where(fits).select("token", "node", "n", "rows")


def _resolved(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per input row: id, digest of its text, set size, and a name of its component (null without words)."""
    picked = docs.select(docs[id_col].alias("id"), no_text(text_col).alias("text")).withColumn("said", F.xxhash64("text"))
    rows = written(sketches(picked, width, percent, token_loads(picked, width)), "sketches")
    # A set's text is fetched by the id and text of one of its rows; copies without an id are one row there.
    picked = picked.where("id is not null").unionByName(picked.where("id is null").dropDuplicates(["said"]))
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "said")).alias("one")
    firsts = [F.first(c).alias(name) for c, name in (("n_shingles", "n"), ("bits", "bits"), ("prefix", "prefix"))]
    nodes = written(rows.where("node is not null").groupBy("node").agg(one, *firsts).select("node", "one.id", "one.said", "n", "bits", "prefix"), "nodes")
    reps = nodes.drop("prefix")
    # Only a count and a maximum per token meet, never a token's list. A list is led by the node that shares most: among copies
    # of one text with edits of their own, that is the text itself or the one nearest to it.
    several = written(together(nodes, percent), "several")
    weight = several.groupBy("node").agg(F.sum("rows").alias("weight"))
    leads = several.select("token", "node", "n").join(weight, "node").groupBy("token").agg(F.max(F.struct("weight", "node", "n")).alias("lead"))
    shared = written(several.select("token", "node", "n").join(leads, "token"), "shared")
    fits = (F.least("n", "lead.n") * 100) >= (F.greatest("n", "lead.n") * percent)
    stars = shared.where("node <> lead.node").where(fits).select("node", F.col("lead.node").alias("grp"), F.lit(False).alias("own")).distinct()
    listings = shared.count()
    stars = written(few_tasks(stars, listings), "stars")
    leaders = stars.select(F.col("grp").alias("node"), "grp").distinct()
    first = written(open_groups(picked, reps.withColumn("component", F.col("node")), leaders, stars, width, percent), "round-one")
    # From here on a group is what one node leads: its copies, linked or not.
    homes = shared.groupBy("node").agg(F.max(F.struct("lead.weight", F.col("lead.node").alias("grp"))).alias("home"))
    homes = written(few_tasks(homes.select("node", "home.grp"), listings), "homes")
    links = ask(picked, reps, shared, homes, first, listings, width, percent)
    named = written(few_tasks(rows.where("node is not null").select("id", "node").distinct(), rows.count()), "named")
    # The sets of one id are linked through the least of them.
    least = named.where("id is not null").groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most")
    final = components(links.unionByName(named.join(least, "id").where("node <> b").select(F.col("node").alias("a"), "b")))
    return rows.join(final, "node", "left").select("id", "said", "n_shingles", F.coalesce("component", "node").alias("component"))


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size of its shingle set, smallest id reachable by links.

    Two rows link when their sets' similarity is at least `percent` / 100; A-Z is lowered. Rows without words have no set and
    stand alone. Equal sets are linked without being compared. Rows that share an id count as one document, so their sets are
    linked. Rows without an id are compared like any others and lead on from one id to another; a component without any id has a
    null one. Extra columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    rows = written(_resolved(docs, width, percent, id_col, text_col), "resolved")
    least = rows.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    own = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.join(least, "component", "left").select(F.col("id").cast(kind).alias(id_col), "n_shingles", own.cast(kind).alias("component_id"))


def _unused(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores as no column of the table has."""
    taken = {column.lower() for column in docs.columns}
    while name in taken:
        name += "_"
    return name


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, with all columns: that with the smallest id, of rows without an id one that is left
    only if no row of the component has an id.

    Rows that share an id are one document, of which one row stays. Rows without words all stay.
    """
    rows = written(_resolved(docs, width, percent, id_col, text_col), "resolved").where("component is not null")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "said")
    kept = rows.groupBy("component").agg(F.min(place).alias("kept"), F.count("*").alias("rows"))
    kept = written(kept.where("rows > 1").select("component", "kept.id", "kept.said"), "kept")
    others = kept.withColumnsRenamed({"id": "kept_id", "said": "kept_said"})
    is_kept = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("said") == F.col("kept_said"))
    gone = rows.join(others, "component").where(~is_kept).select("id", "said").distinct()
    often = rows.join(others, "component").where(is_kept).groupBy("id", "said").count().where("count > 1").select("id", "said")
    said, a, b = (_unused(docs, name) for name in ("__said", "__a", "__b"))
    told = docs.withColumn(said, F.xxhash64(no_text(text_col)))
    listed = gone.unionByName(often).select(F.col("id").alias(a), F.col("said").alias(b))
    same = F.col(id_col).eqNullSafe(F.col(a)) & (F.col(said) == F.col(b))
    again = told.join(often.select(F.col("id").alias(a), F.col("said").alias(b)), same, "left_semi").dropDuplicates([id_col, said])
    return told.join(listed, same, "left_anti").unionByName(again).drop(said)
