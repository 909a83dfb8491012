"""Exact Jaccard self-join of documents on word shingles, and the groups that its links form.

Universe partition: the shingles that could be are dealt by hash over the ``m`` segments of a size
band. Two sets of n and s shingles that reach the threshold of 0.8 differ in at most (n + s) / 9
<= n / 4 of them, so at least ``m - n / 4`` of their segments are equal. A set therefore needs to
index only ``n // 4 + 1`` segments, if both sides choose by the same rule.

Cost-based allocation: segments are ranked by their content alone - many shingles that are rare
in the corpus first, so that index lists stay short - and the cheapest are indexed. (The cheapest
of the equal segments is then kept by both sides: if one side dropped it, it would have dropped
all equal ones, more than it may drop.) A set in which fewer segments than needed hold a rare
shingle keeps those, and adds the one-deletion neighbourhoods of the segments with two or more:
each counts double, as it also finds a segment that differs by one shingle. Only where that is
not enough, segments of common shingles are indexed too.

Verification: sets that share a key form a group, groups of the same smallest id one. First that
id meets the others, which links most copies. Groups that then still hold several linked parts are met in blocks: whoever is
outside a group's largest part meets all others of it as bit maps of the sets, an eighth of their
size, inside a task; bits that only one side has prove a difference, and only pairs which the maps
leave open come out of it. While many of these link, each row gives its likeliest few, as parts
that have grown together need not meet again; the last round gives all that are left. Open pairs
are compared shingle by shingle. No pairs of a group are ever rows before a map left them open.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.components import components
from statloom.llm.cuts import runs
from statloom.llm.hashing import WordHasher, mix, shingles
from statloom.llm.rows import giving_back
from statloom.operators.stage import Stage

SHINGLE = 5
#: Segments per size of the largest set of a band; more make them smaller, fewer make them rarer to skip.
SEGMENTS = 0.35
#: A shingle is common from this count or this share of documents on; it steers costs, never results.
COMMON_COUNT, COMMON_SHARE = 32, 1 / 4096
BATCH_BYTES = 1 << 20
#: Rows and shingles of a block of a group; larger groups meet block by block.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 4 << 20
#: Pairs whose maps a task compares in one step, and shingles of the rows that it receives at once.
PAIRS_AT_ONCE, TASK_SHINGLES = 1 << 18, 16 << 20
#: Partners that a row gives in a round before the last; such rounds go on while one pair of so many links.
PARTNERS, JOINING = 8, 8
#: Keys that a task holds before it hands them on, and keys in a bucket of the index.
KEYS_AT_ONCE, BUCKET_KEYS = 1_000_000, 500_000
_U = np.uint64


def _sets(texts: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of the distinct shingles of each text, sorted."""
    text, value = shingles(hasher(texts), len(texts), SHINGLE)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of values whose groups are sorted."""
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values, out=total[1:])
    edges = np.searchsorted(group, np.arange(n + 1))
    return total[edges[1:]] - total[edges[:-1]]


def _digests(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Two sums per text that do not depend on the order: equal sets, equal digests."""
    return np.stack([_sums(mix(value + _U(k)), text, n) for k in (1, 2)])


@giving_back
def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document - id, set size, digests - and rows of shingles seen in two texts of a task."""
    hasher, held, seen = WordHasher(), [], set()

    def repeated():
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        values, counts = values[counts > 1], counts[counts > 1]
        held.clear()
        none = pa.nulls(len(values), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts), none, none, pa.array(np.ones(len(values), bool))], ["id", "n", "d1", "d2", "shingle"])

    for batch in batches:
        at = 0
        for run in runs(pc.fill_null(batch.column("text"), ""), BATCH_BYTES):
            text, value = _sets(run, hasher)
            digest = _digests(text, value, len(run))
            size = np.bincount(text, minlength=len(run))
            ids = batch.column("id").slice(at, len(run))
            at += len(run)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size), *(pa.array(d.view(np.int64)) for d in digest), pa.array(np.zeros(len(run), bool))], ["id", "n", "d1", "d2", "shingle"])
            held.append(value[_first_seen(digest, seen)[text]])
            if sum(map(len, held)) >= KEYS_AT_ONCE:
                yield repeated()
    if held:
        yield repeated()


def _first_seen(digest: np.ndarray, seen: set) -> np.ndarray:
    """Which texts hold a set that this task has not met yet."""
    out = np.zeros(digest.shape[1], bool)
    for i, pair in enumerate(zip(*digest.tolist())):
        out[i] = pair not in seen
        seen.add(pair)
    return out


def keys_of_sets(doc: np.ndarray, value: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, key) of the index entries of sets given as sorted (doc, shingle) rows."""
    count = np.bincount(doc) if len(doc) else np.zeros(0, np.int64)
    band = np.zeros(len(count), np.int64)
    np.log2(count, out=(wide := np.zeros(len(count))), where=count > 0)
    band = np.floor(wide + 1e-12).astype(np.int64)
    rare = ~np.isin(value, common)
    out = []
    for up in (0, 1):  # the band of the set, and the next one where a partner may lie there
        here = count > 0 if not up else (count * 5) // 4 >= 1 << (band + 1)
        rows = here[doc]
        out.append(_band_keys(doc[rows], value[rows], rare[rows], count, band + up))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _band_keys(doc, value, rare, count, band):
    if not len(doc):
        return doc, value
    m = np.ceil(SEGMENTS * ((2 << band) - 1)).astype(np.int64) + 2
    own = mix(value + band[doc].astype(_U) * _U(0x632BE59BD9B4E019))
    segment = (((own >> _U(32)) * m[doc].astype(_U)) >> _U(32)).astype(np.int64)
    order = np.lexsort((segment, doc))
    doc, segment, own, rare = doc[order], segment[order], own[order], rare[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (segment[1:] != segment[:-1])
    first = np.flatnonzero(new)
    part = np.cumsum(new) - 1
    content = np.add.reduceat(mix(own), first)
    n_rare, n_all = np.add.reduceat(rare.astype(np.int64), first), np.diff(np.append(first, len(doc)))
    s_doc, s_segment = doc[first], segment[first]
    place = mix(s_segment.astype(_U) + (band[s_doc].astype(_U) << _U(40)))
    key = mix(content + place)
    # The cheapest segments of each set: most rare shingles, then most shingles, then by content.
    order = np.lexsort((key, -n_all, -n_rare, s_doc))
    start = np.searchsorted(s_doc, np.arange(len(count)))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - start[s_doc[order]]
    need = count // 4 + 1
    cold = np.bincount(s_doc, n_rare > 0, minlength=len(count)).astype(np.int64)
    double = np.bincount(s_doc, n_rare > 1, minlength=len(count)).astype(np.int64)
    full = cold < need  # too few rare segments
    enough = full & (cold + double >= need)
    keep = (rank < need[s_doc]) & ~(enough[s_doc] & (n_rare == 0))
    docs, keys = [s_doc[keep]], [key[keep]]
    deep = full[s_doc] & (n_rare > 1)
    rows = deep[part]
    if rows.any():
        docs.append(doc[rows])
        keys.append(mix(content[part[rows]] - mix(own[rows]) + place[part[rows]]))
    found = np.bincount(s_doc, minlength=len(count))
    for d in np.flatnonzero((found > 0) & (found < need) & ~enough):  # empty segments as well, in an order of their own
        empty = np.setdiff1d(np.arange(m[d]), s_segment[s_doc == d])
        marks = np.sort(mix(mix(empty.astype(_U) + (_U(band[d]) << _U(40)))))[: need[d] - found[d]]
        docs.append(np.full(len(marks), d))
        keys.append(marks)
    return np.concatenate(docs), np.concatenate(keys)


def _index(common: np.ndarray, buckets: int):
    @giving_back
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, ids_held, keys_held = WordHasher(), set(), [], []

        def blocks():
            ids, keys = np.concatenate(ids_held), np.concatenate(keys_held)
            ids_held.clear()
            keys_held.clear()
            bucket = (keys % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            ids, keys, bucket = ids[order], keys[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket)) + 1
            for i in range(0, len(edges) + 1, 256):
                a = [0, *edges.tolist()][i : i + 256]
                b = [*edges.tolist(), len(ids)][i : i + 256]
                # The upper half of a key tells enough within its bucket: a false match is only compared in vain.
                rows = [(int(bucket[x]), (keys[x:y] >> _U(32)).astype(np.uint32).tobytes(), ids[x:y].tobytes()) for x, y in zip(a, b) if y > x]
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["bucket", "keys", "ids"])

        for batch in batches:
            at = 0
            for run in runs(pc.fill_null(batch.column("text"), ""), BATCH_BYTES):
                ids = batch.column("id").slice(at, len(run)).to_numpy(zero_copy_only=False)
                at += len(run)
                text, value = _sets(run, hasher)
                new = _first_seen(_digests(text, value, len(run)), seen)[text]
                doc, keys = keys_of_sets(text[new], value[new], common)
                ids_held.append(ids[doc].astype(np.int64))
                keys_held.append(keys)
                if sum(map(len, keys_held)) >= KEYS_AT_ONCE:
                    yield from blocks()
        if keys_held and sum(map(len, keys_held)):
            yield from blocks()

    return entries


def _groups(table: pa.Table) -> pa.Table:
    """(group, id) of the ids that share a key of this bucket; equal groups once."""
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32)
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[new], ids[new]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(start, len(keys)))
    group = np.add.reduceat(mix(ids.view(_U) + _U(3)), start) if len(start) else np.zeros(0, _U)
    chosen = np.zeros(len(start), bool)
    chosen[np.unique(group, return_index=True)[1]] = True
    chosen &= size > 1
    rows = np.repeat(chosen, size)
    return pa.table({"gid": pa.array(np.repeat(group, size)[rows].view(np.int64)), "id": pa.array(ids[rows])})


@giving_back
def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        at = 0
        for run in runs(pc.fill_null(batch.column("text"), ""), BATCH_BYTES):
            text, value = _sets(run, hasher)
            ends = np.searchsorted(text, np.arange(len(run) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value.view(np.int64)))
            maps = [bit_maps(text, value, np.diff(ends), size) for size in (8, 4)]
            kept = [batch.column(c).slice(at, len(run)) for c in ("id", "again")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(ends)), lists, *maps], ["id", "again", "n", "shingles", "fine", "coarse"])
            at += len(run)


def bit_maps(text: np.ndarray, value: np.ndarray, count: np.ndarray, bits: int) -> pa.ListArray:
    """Which parts of the hash range each set has a shingle in: ``bits`` parts per size of its band.

    A map of the next larger band with half as many bits has the same parts.
    """
    band = np.floor(np.log2(np.maximum(count, 1)) + 1e-12).astype(np.int64)
    power = np.maximum(band + bits.bit_length() - 1, 6)
    words = np.where(count > 0, (1 << power) // 64, 0)
    first = np.concatenate([[0], np.cumsum(words)])
    at = value >> (64 - power[text]).astype(_U)
    out = np.zeros(first[-1], _U)
    np.bitwise_or.at(out, first[text] + (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(out.view(np.int64)))


def _only_in(a: Column, b: Column) -> Column:
    """How many bits of map ``a`` are not in ``b``."""
    apart = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.aggregate(apart, F.lit(0), lambda t, x: t + x)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = pa.concat_arrays(column.chunks)
    return lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(_U)


def _meeting(partners: int):
    """Pairs of a group's blocks that their maps leave open, the ``partners`` likeliest of a row, or all (0).

    A row of nulls says that some were left for a later round.
    """

    def meet(table: pa.Table) -> pa.Table:
        gid, unit, ids, part, n, asked, partner, outer = (
            table.column(c).to_numpy() for c in ("gid", "unit", "id", "part", "n", "asked", "partner", "outer")
        )
        maps = [_lists(table.column(c)) for c in ("fine", "coarse")]
        band = np.floor(np.log2(n) + 1e-12).astype(np.int64)
        order = np.lexsort((unit, gid))
        cuts = np.flatnonzero((np.diff(gid[order]) != 0) | (np.diff(unit[order]) != 0)) + 1
        left, right, more = [], [], False

        def matrix(rows: np.ndarray, coarse: bool) -> np.ndarray:
            offsets, values = maps[int(coarse)]
            return values[offsets[rows][:, None] + np.arange(offsets[rows[0] + 1] - offsets[rows[0]])]

        def compare(x: np.ndarray, y: np.ndarray) -> None:
            """Rows of one band against rows of the same or a neighbouring one."""
            nonlocal more
            a, b = matrix(x, band[x[0]] > band[y[0]]), matrix(y, band[y[0]] > band[x[0]])
            spare_a, spare_b = n[x] - np.bitwise_count(a).sum(1, dtype=np.int64), n[y] - np.bitwise_count(b).sum(1, dtype=np.int64)
            b = np.ascontiguousarray(b.T)
            step = max(1, PAIRS_AT_ONCE // len(y))
            for i in range(0, len(x), step):
                rows, one = x[i : i + step], a[i : i + step]
                most = np.minimum(spare_a[i : i + step, None], spare_b)
                for w in range(b.shape[0]):
                    most += np.bitwise_count(one[:, w, None] & b[w])
                may = (9 * most >= 4 * (n[rows][:, None] + n[y])) & (part[rows][:, None] != part[y]) & (ids[rows][:, None] != ids[y])
                if partners and len(y) > partners:
                    more |= bool((may.sum(1) > partners).any())
                    likely = np.where(may, most / (n[rows][:, None] + n[y]), -1.0)
                    best = np.argpartition(-likely, partners, axis=1)[:, :partners]
                    r, c = np.nonzero(np.take_along_axis(may, best, 1))
                    c = best[r, c]
                else:  # two outer rows meet twice, each in a block of the other
                    r, c = np.nonzero(may & ~(outer[y] & (ids[y] < ids[rows][:, None])))
                left.append(ids[rows][r])
                right.append(ids[y][c])

        for rows in np.split(order, cuts):
            x, y = rows[asked[rows]], rows[partner[rows]]
            for b in np.unique(band[x]):
                for c in (b - 1, b, b + 1):
                    if (there := y[band[y] == c]).size:
                        compare(x[band[x] == b], there)
        one, two = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
        nothing = pa.nulls(int(more), pa.int64())
        low, high = (pa.concat_arrays([pa.array(f(one, two), pa.int64()), nothing]) for f in (np.minimum, np.maximum))
        return pa.table({"lead": low, "id": high})

    return meet


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: ``key``, ``n_shingles`` and ``component_id``, the smallest linked key.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a set is the
    distinct runs of five words, or the whole run of fewer. Two documents link if 100 times the
    intersection is 80 times the union or more. Null or wordless texts have no shingles and link
    with nothing. Rows of one key are one document, linked if any of their texts is. A null key
    has a null component. Keys are whole numbers; other columns are not read.
    """
    spark = df.sparkSession
    stage = Stage(spark, "ngram-join")
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    profile = stage.put(docs.mapInArrow(_profile, "id long, n long, d1 long, d2 long, shingle boolean"), "profile")
    sets = profile.filter("not shingle").drop("shingle")
    n_docs, n_shingles = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(COMMON_COUNT, n_docs * COMMON_SHARE)
    # At most 1 / COMMON_SHARE times the mean set size: a bound that does not grow with the corpus.
    common = profile.filter("shingle").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    common = np.sort(common.select("id").toArrow().column("id").to_numpy().view(_U))

    # Equal sets count once, under their smallest id.
    named = sets.filter("n > 0 and id is not null")
    first = named.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"))
    member = stage.put(named.join(first, ["n", "d1", "d2"]).select("id", "n", "rep"), "member")
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parallel, int(n_shingles * 0.4 / BUCKET_KEYS) + 1)
    entries = docs.filter("id is not null").mapInArrow(_index(common, buckets), "bucket int, keys binary, ids binary")
    shared = stage.put(entries.groupBy("bucket").applyInArrow(_groups, "gid long, id long"), "shared")
    postings = shared.distinct().join(member.select("id", "rep", "n").distinct(), "id")
    postings = stage.put(postings.groupBy("gid", F.col("rep").alias("id")).agg(F.max("n").alias("n")), "postings-0")
    # Groups of one smallest id are met as one: their rows are mostly the same.
    lead = postings.groupBy("gid").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("gid", "lead")
    postings = stage.put(postings.join(lead, "gid").groupBy("lead", "id").agg(F.max("n").alias("n")), "postings")

    # Sets and maps of the candidates only; a repeated key with several texts brings several sets.
    repeated = member.groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("again"))
    wanted = postings.select("id").distinct().join(repeated, "id", "left").select("id", F.coalesce("again", F.lit(False)).alias("again"))
    wanted = stage.put(wanted, "wanted")
    sketch = "id long, again boolean, n long, shingles array<long>, fine array<long>, coarse array<long>"
    found = stage.put(docs.join(wanted, "id").mapInArrow(_shingle_sets, sketch).filter("n > 0"), "sets")
    once = stage.put(found.filter("again").dropDuplicates(["id", "shingles"]), "sets-repeated")
    found = found.filter("not again").unionByName(once).drop("again")
    maps = found.select("id", "n", "fine", "coarse")
    links = []

    def verified(pairs: DataFrame, step: str) -> DataFrame:
        """The distinct pairs ``(lead, id)`` that do link, added to the links."""
        leads = stage.put(pairs.select(F.col("lead").alias("id")).distinct(), f"{step}-leads")
        one = pairs.join(found.select("id", "n", "shingles"), "id")
        two = found.join(leads, "id", "left_semi").select(F.col("id").alias("lead"), F.col("n").alias("m"), F.col("shingles").alias("others"))
        both = F.size(F.array_intersect("shingles", "others"))
        linked = stage.put(one.join(two, "lead").filter(9 * both >= 4 * (F.col("n") + F.col("m"))).select("lead", "id").distinct(), step)
        links.append(linked)
        return linked

    # First every group against its smallest id.
    sides = postings.filter("id <> lead").select("lead", "id").join(maps, "id").join(maps.toDF("lead", "m", "lead_fine", "lead_coarse"), "lead")
    n, m = F.col("n"), F.col("m")
    sides = sides.filter(9 * F.least(n, m) >= 4 * (n + m))
    band, lead_band = F.floor(F.log2(n) + 1e-12), F.floor(F.log2(m) + 1e-12)
    one = F.when(band > lead_band, F.col("coarse")).otherwise(F.col("fine"))
    two = F.when(lead_band > band, F.col("lead_coarse")).otherwise(F.col("lead_fine"))
    sides = sides.select("lead", "id", n, m, F.least(n - _only_in(one, two), m - _only_in(two, one)).alias("most"))
    verified(stage.put(sides.filter(9 * F.col("most") >= 4 * (n + m)).select("lead", "id").distinct(), "open-0"), "linked-0")

    turn, partners, left = 0, PARTNERS, True
    while left:
        # What already hangs together need not be compared.
        turn += 1
        known = components(reduce(DataFrame.unionByName, links), "lead", "id", stage, f"round-{turn}")
        links[:] = [known.select(F.col("component").alias("lead"), F.col("node").alias("id")).filter("lead <> id")]
        here = postings.join(known.withColumnRenamed("node", "id"), "id", "left")
        here = stage.put(here.select(F.col("lead").alias("gid"), "id", "n", F.coalesce("component", "id").alias("part")), f"here-{turn}")
        parts = here.groupBy("gid", "part").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size"))
        largest = F.struct("k", "part")
        parts = parts.groupBy("gid").agg(
            F.max_by("part", largest).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("k"), F.max("k").alias("k_main"),
            F.sum("size").alias("size"), F.max_by("size", largest).alias("size_main"),
        )
        # A group of two has met in the first comparison.
        blocks = lambda k, size: F.ceil(F.greatest(k / BLOCK_ROWS, size / BLOCK_SHINGLES))
        parts = parts.filter("parts > 1 and k > 2").select(
            "gid", "main", blocks(F.col("k") - F.col("k_main"), F.col("size") - F.col("size_main")).alias("blocks"), blocks(F.col("k"), F.col("size")).alias("pieces")
        )
        rows = stage.put(here.join(parts, "gid"), f"rows-{turn}")
        size = rows.agg(F.sum(F.col("n") * (F.col("blocks") + F.col("pieces")))).first()[0]
        if size is None:
            break
        outer, block, piece = F.col("part") != F.col("main"), F.expr("pmod(xxhash64(id, 1), blocks)"), F.expr("pmod(xxhash64(id, 2), pieces)")
        as_partner = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: b * F.col("pieces") + piece)
        as_asked = F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), lambda p: block * F.col("pieces") + p)
        units = rows.drop("n").join(maps, "id").withColumn("unit", F.explode(F.when(outer, F.array_union(as_asked, as_partner)).otherwise(as_partner)))
        units = units.select(
            F.pmod(F.xxhash64("gid", "unit"), F.lit(max(parallel, int(size // TASK_SHINGLES) + 1))).alias("cell"), "gid", "unit", "id", "part", "n", "fine", "coarse",
            (outer & (F.expr("unit div pieces") == block)).alias("asked"), (F.expr("unit % pieces") == piece).alias("partner"), outer.alias("outer"),
        )
        met = stage.put(units.groupBy("cell").applyInArrow(_meeting(partners), "lead long, id long").distinct(), f"open-{turn}")
        left = partners > 0 and not met.filter("id is null").isEmpty()
        met = met.filter("id is not null")
        linked = verified(met, f"linked-{turn}")
        if left and linked.count() * JOINING < met.count():
            partners = 0
        stage.drop(f"here-{turn}", f"rows-{turn}")
    # All texts of one key stand in one class.
    several = member.groupBy("id").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).filter("lead <> last").drop("last")
    links.append(member.join(several, "id").filter("rep <> lead").select("lead", F.col("rep").alias("id")))
    edges = reduce(DataFrame.unionByName, links)
    labels = components(edges, "lead", "id", stage)
    labels = stage.put(labels.withColumnRenamed("node", "rep"), "labels")
    joined = member.join(labels, "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = sets.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    out = joined.unionByName(alone)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
