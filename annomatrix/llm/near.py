"""Near-duplicate documents by MinHash, with links confirmed on whole shingle sets.

1. A document's set: hashes of its distinct 5-word shingles (all words as one if there are fewer). Documents of equal
   sets are one class, known by its smallest doc_id.
2. Minima of many universal hash functions per class. Rows per band and bands are chosen so that a pair at the
   threshold shares no band with a chance of MISS at most. One bit of each minimum makes a signature, and a pair at the
   threshold differs in more than apart() bits with the same chance at most: such pairs are ruled out unseen.
3. First links: each class meets the smallest class with which it shares a band and a near enough signature. Pairs that
   pass are compared on their whole sets, in tasks of bounded documents and bytes around that smallest class.
4. What is left: bands whose classes are not all linked by then. There, the classes outside the band's largest
   component are compared with all of the band's, by signatures alone and in blocks; a pair counts at the first band
   that it shares. Only classes that have such a partner go on, with their texts, to be compared on their whole sets.
5. Components of all links by large-star and small-star.

Inside a task, pairs are compared by products of shingle incidence matrices, and a spanning forest of the links leaves
it; pairs are never listed. Sets are compared by both lanes of their shingles' 128-bit hashes (see words.py).

Null texts and texts without words have an empty set and are linked with nothing. Rows of a null doc_id stand alone:
component_id is null and kept is true. Rows that share a doc_id are in one component, with all that any of their texts is
linked to; kept is then true for each of them if the component's smallest id is theirs. keep() goes by text instead, as
a shared id makes no copy: of each component of links one row stays, of its smallest doc_id, so that no text goes
without a near copy that stays, and an empty text stays once for its doc_id. A text of any length is compared whole. An
empty table gives none. Extra columns, whatever their names, are not read by near_classes() and kept by keep().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import groups, materialize, quoted, scratch
from .words import Runs, chunks, mix, signed

SHINGLE = 5
MISS = 1e-6
BLOCK_DOCS = 256
BLOCK_BYTES = 1 << 21
SEED = 5


def plan(percent: int, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands): seven rows per band from 85 % on, fewer below, and as many bands as the chance asks for."""
    t = percent / 100
    rows = 7 if t >= 0.85 else 6 if t >= 0.8 else 4
    return rows, 1 if t >= 1 else math.ceil(math.log(miss) / math.log1p(-(t**rows)))


def apart(percent: int, functions: int, miss: float = MISS) -> int:
    """Bits of a signature in which a pair at the threshold differs at most, but for a chance of miss. Where minima
    differ, with a chance of 1 - t, their bits do in half of the cases."""
    p, at_most, least = (1 - percent / 100) / 2, 0.0, 0
    for bits in range(functions + 1):
        at_most += math.comb(functions, bits) * p**bits * (1 - p) ** (functions - bits)
        if 1 - at_most <= miss:
            return bits
        least = bits
    return least


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position of a text, its set in either lane as sorted 64-bit hashes)."""
    for lo, hashes, bounds in chunks(column, lower=True):
        lanes = [Runs(hashes, 0), Runs(hashes, 1)]
        at = np.arange(max(0, len(hashes) - shingle + 1))
        grams = [runs.of(at, at + shingle) for runs in lanes]
        for i in range(len(bounds) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= shingle:
                yield lo + i, *(np.unique(g[a : b - shingle + 1]) for g in grams)
            elif b > a:
                yield lo + i, *(runs.of(np.array([a]), np.array([b])) for runs in lanes)
            else:
                yield lo + i, *[np.zeros(0, dtype=np.uint64)] * 2


def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    return rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 2**64, n, dtype=np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, at_once: int = 256) -> np.ndarray:
    """Smallest upper half of a x + b modulo 2**64 over the set, for every function; x has 32 bits, so that the family
    is universal."""
    x = shingles >> np.uint64(32)
    out = np.full(len(a), 2**64 - 1, dtype=np.uint64)
    for lo in range(0, len(x), at_once):
        h = np.multiply.outer(a, x[lo : lo + at_once])
        h += b[:, None]
        np.minimum(out, h.min(1), out=out)
    return out >> np.uint64(32)


def digest(one: np.ndarray, two: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that identify a set, 64 from each lane; zero for the empty one."""
    return mix(one ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(two + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)


def digests(text: Column, shingle: int) -> Column:
    """d1 and d2 of each text."""

    @F.pandas_udf("d1 long, d2 long")
    def run(texts: pd.Series) -> pd.DataFrame:
        both = [digest(one, two) for _, one, two in shingle_sets(pa.array(texts, pa.string()), shingle)]
        return pd.DataFrame(signed(np.array(both, dtype=np.uint64).reshape(-1, 2)), columns=["d1", "d2"])

    return run(text.cast("string"))


def signatures(docs: DataFrame, percent: int, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, bytes, d1, d2, bands, sig): d1 and d2 identify the set, bands holds one hash per band, and
    sig the signature's bits."""
    rows, bands = plan(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = hash_functions(rows * bands)
        rng = np.random.Generator(np.random.PCG64(SEED + 1))
        weight = rng.integers(0, 2**64, rows, dtype=np.uint64) | np.uint64(1)
        salt = rng.integers(0, 2**64, rows * bands, dtype=np.uint64)
        number = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        def batch_of(ids: pa.Array, size: pa.Array, found: list[tuple], least: np.ndarray) -> pa.RecordBatch:
            keys = mix(mix(((least.reshape(-1, bands, rows) + np.uint64(1)) * weight).sum(2, dtype=np.uint64)) + number)
            bits = np.packbits((mix(least + salt) & np.uint64(1)).astype(bool), axis=1)
            words = -(-bits.shape[1] // 8)
            bits = np.pad(bits, ((0, 0), (0, 8 * words - bits.shape[1]))).view("<i8").astype(np.int64)
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(m).ravel()))
            n, d1, d2 = zip(*found, strict=True)
            columns = [ids, pa.array(n, pa.int64()), size, *(pa.array(signed(np.array(d, dtype=np.uint64))) for d in (d1, d2)), lists(signed(keys)), lists(bits)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "bytes", "d1", "d2", "bands", "sig"])

        for whole in batches:
            for lo in range(0, len(whole), 500):
                batch = whole.slice(lo, 500)
                found, least = [], np.zeros((len(batch), len(a)), dtype=np.uint64)
                for i, one, two in shingle_sets(batch.column("text"), shingle):
                    found.append((len(one), *digest(one, two)))
                    if len(one):
                        least[i] = minima(one, a, b)
                yield batch_of(batch.column("doc_id"), batch.column("bytes"), found, least)

    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, bytes long, d1 long, d2 long, bands array<long>, sig array<long>")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of the pairs with 100 * intersection >= percent * union."""
    n, size = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    whole = np.float32 if size.max(initial=0) < 2**24 else np.float64  # counts are exact
    shared = np.zeros((n, n), dtype=whole)
    everything = np.concatenate(sets) if n else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(n), size)
    _, word, times = np.unique(everything, return_inverse=True, return_counts=True)
    more = times[word] > 1
    word, owner = word[more], owner[more]
    _, word = np.unique(word, return_inverse=True)
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    step = 4096
    for lo in range(0, int(word[-1]) + 1 if len(word) else 0, step):
        a, b = np.searchsorted(word, [lo, lo + step])
        x = np.zeros((n, step), dtype=np.float32)
        x[owner[a:b], word[a:b] - lo] = 1
        shared += x @ x.T
    both = shared.astype(np.int64)
    out = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    out[size == 0] = out[:, size == 0] = False
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a boolean matrix of links, as (node, root)."""
    left, out = np.ones(len(links), dtype=bool), []
    for root in range(len(links)):
        if not left[root]:
            continue
        reached = np.zeros(len(links), dtype=bool)
        reached[root], front = True, np.array([root])
        while len(front):
            front = np.flatnonzero(links[front].any(0) & ~reached)
            reached[front] = True
        left &= ~reached
        out += [(int(i), root) for i in np.flatnonzero(reached) if i != root]
    return out


def _confirm(rows: DataFrame, texts: DataFrame, tasks: list[str], percent: int, shingle: int) -> DataFrame:
    """rows (tasks..., node, asks): confirmed links (u, v), a forest per task, among the nodes of each task of which one
    asks. texts (node, text) has one row per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, tasks):
            if len(group) < 2:
                continue
            found = list(shingle_sets(group.column("text"), shingle))
            asks = group.column("asks").to_numpy()
            links = linked([one for _, one, _ in found], percent)
            links &= asks[:, None] | asks[None, :]
            if links.any():
                links &= linked([two for _, _, two in found], percent)
            nodes, pairs = group.column("node").to_numpy(), np.array(forest(links), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], names=["u", "v"])

    with_text = rows.join(texts, "node").select(*tasks, "node", "asks", "text")
    return with_text.repartition(*tasks).sortWithinPartitions(*tasks, "node").mapInArrow(run, "u long, v long")


def _parts(block_docs: int, block_bytes: int) -> Column:
    """Blocks for a group of classes, by number and bytes."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("bytes") / block_bytes), F.lit(1)).cast("int")


def first_tasks(members: DataFrame, sigs: DataFrame, most: int, block_docs: int, block_bytes: int) -> DataFrame:
    """(v, chunk, node, asks): every class with the smallest one of a shared band that its signature is near to."""
    pairs = members.where("node <> v").select("node", "v").distinct()
    centre = sigs.select(F.col("node").alias("v"), F.col("sig").alias("centre"))
    differ = F.aggregate(F.zip_with("sig", "centre", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    near = pairs.join(sigs.select("node", "sig", "bytes"), "node").join(centre, "v").where(differ <= most)
    near = materialize(near.groupBy("node").agg(F.min("v").alias("v"), F.first("bytes").alias("bytes")), "near-centres")
    sized = near.groupBy("v").agg(_parts(block_docs, block_bytes).alias("parts"))
    around = near.join(sized, "v").select("v", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("chunk"), "node")
    centres = sized.select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), F.col("v").alias("node"))
    return around.unionByName(centres).withColumn("asks", F.lit(True))


def left_tasks(members: DataFrame, sigs: DataFrame, found: DataFrame, most: int, block_docs: int, block_bytes: int) -> DataFrame:
    """(key, team, task, node, asks): the classes that share a band and a near enough signature with one of another
    component of found, in the blocks in which they meet."""
    labelled = members.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    labelled = materialize(labelled.join(mixed, "key").join(sigs.select("node", "bytes"), "node"), "mixed-bands")
    most_of = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("main"))
    blocks = labelled.groupBy("key").agg(_parts(block_docs, block_bytes).alias("blocks"))
    sides = labelled.join(most_of, "key").withColumn("outside", F.col("label") != F.col("main")).drop("main")
    teams = sides.where("outside").groupBy("key").agg(_parts(block_docs, block_bytes).alias("teams"))
    own = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n)).cast("int")
    sides = sides.join(blocks, "key").join(teams, "key").withColumn("team", own(1, "teams")).withColumn("task", own(0, "blocks"))
    sides = materialize(sides, "mixed-sides")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = sides.where("outside").select("key", "node", "label", "team", each("blocks").alias("task"), F.lit(True).alias("asks"))
    asked = sides.withColumn("own", F.col("team")).drop("team").select("key", "node", "label", each("teams").alias("team"), "task", "own", "outside")
    asked = asked.where("not (outside and team = own)").select("key", "node", "label", "team", "task", F.lit(False).alias("asks"))
    tasks = ["key", "team", "task"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, tasks):
            n = len(group)
            matrix = lambda c: group.column(c).combine_chunks().flatten().to_numpy().reshape(n, -1)  # noqa: B023, E731
            sig, bands = matrix("sig"), matrix("bands")
            label, node, asks = (group.column(c).to_numpy() for c in ("label", "node", "asks"))
            key, team, task = (group.column(c)[0].as_py() for c in tasks)
            flag, mine = np.zeros(n, dtype=bool), np.flatnonzero(asks)
            for lo in range(0, len(mine), 128):
                rows = mine[lo : lo + 128]
                bits = sum(np.bitwise_count(sig[rows, None, w] ^ sig[None, :, w]).astype(np.int16) for w in range(sig.shape[1]))
                i, j = np.nonzero((bits <= most) & (label[rows][:, None] != label[None, :]))
                i = rows[i]
                for at in range(0, len(i), 1 << 16):
                    a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    here = bands[a, (bands[a] == bands[b]).argmax(1)] == key
                    flag[a[here]] = flag[b[here]] = True
            some = np.flatnonzero(flag)
            same = lambda v, t: pa.array(np.full(len(some), v), t)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([same(key, pa.int64()), same(team, pa.int32()), same(task, pa.int32()), pa.array(node[some]), pa.array(asks[some])], names=[*tasks, "node", "asks"])

    meet = asking.unionByName(asked).join(sigs.select("node", "sig", "bands"), "node")
    return meet.repartition(*tasks).sortWithinPartitions(*tasks, "node").mapInArrow(run, "key long, team int, task int, node long, asks boolean")


def _links(docs: DataFrame, percent: int, shingle: int, block_docs: int, block_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """The signatures of all rows; classes (d1, d2, id, node), id being the smallest doc_id and node a number of the
    class, its id unless another class has that; confirmed links (u, v) of nodes; and the doc_ids of several rows
    (doc_id, several), several telling whether their sets differ, None without any."""
    if not 0 < percent <= 100:
        raise ValueError("a similarity lies in (0, 100] %")
    spark = docs.sparkSession
    with scratch(spark) as kept:
        most = apart(percent, math.prod(plan(percent)))
        rows = materialize(signatures(docs, percent, shingle), "signatures")
        one_set = F.struct("d1", "d2")
        shared = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(one_set).alias("least"), F.max(one_set).alias("most"))
        shared = materialize(shared.where("n > 1").select("doc_id", (F.col("least") != F.col("most")).alias("several")), "repeated-ids")
        of_class = [F.min("doc_id").alias("id"), F.max("bytes").alias("bytes"), F.first("bands").alias("bands"), F.first("sig").alias("sig")]
        classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(*of_class)
        classes = materialize(classes.withColumn("node", F.col("id")), "classes")
        own = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
        several = shared.where("several").select(F.col("doc_id").alias("node"))
        if not several.isEmpty():
            first = classes.groupBy("id").agg(F.min(one_set).alias("first"))
            node = F.when(F.col("first") == one_set, F.col("id")).otherwise(F.xxhash64("id", "d1", "d2"))
            classes = materialize(classes.join(first, "id").withColumn("node", node).drop("first"), "classes-by-set")
            mixed = own.join(several, "node", "left_semi").withColumnRenamed("node", "id").withColumn("set", digests(F.col("text"), shingle))
            mixed = mixed.select("id", "text", "set.d1", "set.d2").join(classes.select("id", "d1", "d2", "node"), ["id", "d1", "d2"])
            own = materialize(own.join(several, "node", "left_anti").unionByName(mixed.select("node", "text")), "texts-by-set")

        keys = classes.select("node", F.explode("bands").alias("key"))
        centre = keys.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v < w").select("key", "v")
        members = materialize(keys.join(centre, "key").select("key", "node", "v"), "shared-bands")
        sigs = classes.select("node", "sig", "bands", "bytes")
        # All texts are shuffled once; what shares a band is a part of them. Rows of a node are of one set.
        met = own.hint("merge").join(members.select("node").distinct(), "node")
        texts = materialize(met.groupBy("node").agg(F.min("text").alias("text")), "texts")

        def confirm(tasks: DataFrame, name: str) -> DataFrame:
            by = [c for c in tasks.columns if c not in ("node", "asks")]
            return materialize(_confirm(tasks, texts, by, percent, shingle), name)

        tasks = materialize(first_tasks(members, sigs, most, block_docs, block_bytes), "first-tasks")
        links = confirm(tasks, "links")
        tasks = materialize(left_tasks(members, sigs, components(links), most, block_docs, block_bytes), "left-tasks")
        more = confirm(tasks, "more-links")
        kept += [rows, shared, classes, links, more]
    return rows, classes.select("d1", "d2", "id", "node"), links.unionByName(more), None if shared.isEmpty() else shared


def near_classes(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    rows, classes, links, shared = _links(docs, percent, shingle, block_docs, block_bytes)
    full = rows.where("n_shingles > 0 and doc_id is not null").select("doc_id", "d1", "d2")
    if shared is not None:
        held = full.join(shared.where("several"), "doc_id", "left_semi").join(classes, ["d1", "d2"]).select("doc_id", "node")
        least = held.groupBy("doc_id").agg(F.min("node").alias("v"))
        links = links.unionByName(held.join(least, "doc_id").select(F.col("node").alias("u"), "v"))
    by_class = classes.join(components(links), "node", "left").select("d1", "d2", "id", F.coalesce("component", "node").alias("component"))
    if shared is not None:  # a node may then be other than an id
        by_class = by_class.join(by_class.groupBy("component").agg(F.min("id").alias("least")), "component").select("d1", "d2", F.col("least").alias("component"))
    by_id = full.join(by_class, ["d1", "d2"]).select("doc_id", "component")
    by_id = by_id if shared is None else by_id.distinct()
    out = rows.select("doc_id", "n_shingles").join(by_id, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row of each component of links, that of its smallest doc_id; of such rows of one set, that of the smallest
    text by hash. Rows of a null doc_id stay, and one row without words of each doc_id. Rows that agree in doc_id and
    text are told apart by a hash of all columns."""
    spark = docs.sparkSession
    with scratch(spark) as kept:
        rows, classes, links, shared = _links(docs.select("doc_id", "text"), percent, shingle, block_docs, block_bytes)
        by_class = classes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        stay = by_class.groupBy("component").agg(F.min(F.struct("id", "d1", "d2")).alias("least")).select("least.*")
        empty = rows.where("n_shingles = 0 and doc_id is not null").select(F.col("doc_id").alias("id"), "d1", "d2")
        stay = materialize(stay.unionByName(empty.distinct()), "stay")
        # Ids of one row: all but those of the classes that go.
        gone = rows.where("n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("id"))
        gone = materialize(gone.join(stay.select("id"), "id", "left_anti").distinct(), "gone")
        kept += [stay, gone] if shared is None else [stay, gone, shared]
    whole = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    own = whole.where("id is not null").join(gone, "id", "left_anti")
    null = whole.where("id is null").select("row.*")
    if shared is None:
        return own.select("row.*").unionByName(null)
    repeated = shared.select(F.col("doc_id").alias("id"))
    several = own.join(repeated, "id", "left_semi").withColumn("set", digests(F.col("text"), shingle)).select("row", "id", "text", "set.d1", "set.d2")
    order = F.struct(F.xxhash64("text"), F.col("text"), F.xxhash64(*[F.col("row")[c] for c in docs.columns]))
    once = several.join(stay, ["id", "d1", "d2"]).groupBy("id", "d1", "d2").agg(F.min_by("row", order).alias("row"))
    return own.join(repeated, "id", "left_anti").select("row.*").unionByName(once.select("row.*")).unionByName(null)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the whole documents table at 85 %."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same by all pairs that share a shingle, for documents of distinct doc_ids.
ORACLE = r"""with recursive d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct r, doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) as g from (select r, doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select r, count(*) as n from s group by r),
c as (select a.r as r, b.r as q, any_value(a.doc_id) as u, any_value(b.doc_id) as v, count(*) as both_have from s a join s b on a.g = b.g and a.r < b.r group by 1, 2),
e as (select distinct u, v from c join n x on x.r = c.r join n y on y.r = c.q where 100 * both_have >= 85 * (x.n + y.n - both_have) and u is not null and v is not null),
b as (select u, v from e union select v, u from e),
t as (select u as a, v from b union select t.a, b.v from t join b on t.v = b.u),
m as (select a, least(a, min(v)) as least_id from t group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(least_id, d.doc_id) as component_id, coalesce(d.doc_id = coalesce(least_id, d.doc_id), true) as kept
from d left join n using (r) left join m on m.a = d.doc_id"""
