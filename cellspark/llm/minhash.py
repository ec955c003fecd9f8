"""Near-duplicate documents with b-bit MinHash, confirmed on whole shingle sets.

1. Each text gives its shingle set, 192 minima, 32 band keys of six minima and a packed
   signature of four bits a minimum.  Texts of equal sets form one class from here on.
2. Classes that share a band key are candidates.  Each band key names a leader, the
   class whose keys are the most shared; bit counts of the signatures give the
   collision-corrected similarity of the others to it.  Those that are too far from the leader
   are compared so with all of their band key, in blocks of bounded size.  What is near enough joins
   classes into families; pairs are never listed.
3. Each family's hub is compared with every member.  What the hub doesn't link is
   compared with the whole family, in blocks of bounded size: bit counts of the
   signatures give the collision-corrected similarity, and where that leaves a pair
   possible, the sets decide.
4. Confirmed links give connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import components, stash
from .words import BY_SPACE, blocks, hash_spans, lower, mix, table, windows, words

SHINGLE = 5
#: Linked from this share of common shingles on, unless the caller says otherwise: numerator and denominator.
LINK = (85, 100)
BANDS, ROWS, BITS = 32, 6, 4
HASHES = BANDS * ROWS
#: Estimates so many standard deviations under the threshold are no candidates.
DEVIATIONS = 6.3
#: Bytes of shingle sets in a block of a family.
BLOCK_BYTES = 1 << 20
_U = np.uint64
_MUL, _ADD = table(21, HASHES) | _U(1), table(22, HASHES)


def shingles(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a block."""
    raw = lower(raw)
    starts, ends, rows = words(raw, off, BY_SPACE)
    hashes = hash_spans(raw, starts, ends)
    five = windows(hashes, SHINGLE)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(five[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(windows(hashes[a:b], b - a, seed=5 + b - a))
        else:
            out.append(np.zeros(0, _U))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each non-empty set."""
    x = np.concatenate(sets)
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), HASHES), _U)
    for i in range(HASHES):
        y = x * _MUL[i] + _ADD[i]
        out[:, i] = np.minimum.reduceat(y ^ (y >> _U(32)), first)
    return out


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit hashes of each set: sums of independent hashes of its members."""
    out = np.zeros((len(sets), 2), _U)
    for i, s in enumerate(sets):
        out[i] = np.add.reduce(s), np.add.reduce(mix(s + _U(len(s))))
    return mix(out + np.array([len(s) for s in sets], _U)[:, None])


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, two to a byte."""
    low = (mix(least) & _U(2**BITS - 1)).astype(np.uint8)
    return low[:, ::2] << 4 | low[:, 1::2]


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of all pairs of two blocks of packed signatures.

    Of unrelated sets a minimum's bits agree by chance in 1 of 2**BITS cases.
    """
    same = np.zeros((len(a), len(b)), np.int16)
    for i in range(a.shape[1]):
        x = a[:, i, None] ^ b[None, :, i]
        same += (x < 16).astype(np.int16) + ((x & 15) == 0)
    chance = 0.5**BITS
    return (same / HASHES - chance) / (1 - chance)


#: Stands for a null id.
NULL_ID = -(2**63) + 1
SIGNATURE = "key long, mark long, n long, set_a long, set_b long, bands array<long>, bits binary"


def signatures(rows: DataFrame) -> DataFrame:
    """(key, mark, n, set hashes, band keys, packed bits) of each (key, mark, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, raw, off in blocks(batch.column(2)):
                sets = shingles(raw, off)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                both = set_hashes(sets).view(np.int64)
                bands, bits = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), HASHES * BITS // 8), np.uint8)
                if len(full):
                    least = minima([sets[i] for i in full])
                    key = np.repeat((np.arange(BANDS, dtype=_U) + _U(1))[None, :], len(full), 0)
                    for j in range(ROWS):
                        key = mix(key * _U(0xD6E8FEB86659FD93) + least[:, j::ROWS])
                    bands[full], bits[full] = key.view(np.int64), packed(least)
                at = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(top, len(sets)) for i in (0, 1)), pa.array(n), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.ListArray.from_arrays(at, pa.array(bands.ravel())), pa.array([b.tobytes() for b in bits], pa.binary())],
                    ["key", "mark", "n", "set_a", "set_b", "bands", "bits"],
                )

    return rows.mapInArrow(task, SIGNATURE)


def enough(common, na, nb, link: tuple[int, int] = LINK):
    return link[1] * common >= link[0] * (na + nb - common)


def least_estimate(link: tuple[int, int]) -> float:
    """The smallest estimate that leaves a pair at the threshold possible."""
    chance = 0.5**BITS
    equal = chance + (1 - chance) * link[0] / link[1]
    return link[0] / link[1] - DEVIATIONS * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - chance)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all sets of b."""
    out = np.zeros(len(a) * len(b), np.int64)
    if not len(out):
        return out.reshape(len(a), len(b))

    def index(sets):
        value = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(value, kind="stable")
        u, first, n = np.unique(value[order], return_index=True, return_counts=True)
        return row[order], u, first, n

    row_a, ua, first_a, n_a = index(a)
    row_b, ub, first_b, n_b = index(b)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    pairs = n_a[ia] * n_b[ib]
    i = 0
    total = np.concatenate(([0], np.cumsum(pairs)))
    while i < len(pairs):
        j = max(i + 1, int(np.searchsorted(total, total[i] + 2_000_000, "right")) - 1)
        n = pairs[i:j]
        k = np.arange(int(n.sum())) - np.repeat(total[i:j] - total[i], n)
        wide = np.repeat(n_b[ib[i:j]], n)
        x = row_a[np.repeat(first_a[ia[i:j]], n) + k // wide]
        y = row_b[np.repeat(first_b[ib[i:j]], n) + k % wide]
        out += np.bincount(x * len(b) + y, minlength=len(out))
        i = j
    return out.reshape(len(a), len(b))


def block_links(a: dict, b: dict, link: tuple[int, int] = LINK) -> list[tuple[int, int]]:
    """Links between two blocks of a family that join parts not joined yet.

    A block has key, open (not linked by the hub), bits and set of its members.
    """
    wide = np.frombuffer(b"".join(a["bits"]), np.uint8).reshape(len(a["key"]), -1), np.frombuffer(b"".join(b["bits"]), np.uint8).reshape(len(b["key"]), -1)
    open_a, open_b = np.array(a["open"]), np.array(b["open"])
    maybe = (similarity(*wide) >= least_estimate(link)) & (open_a[:, None] | open_b[None, :])
    if a["key"] == b["key"]:
        maybe &= np.tri(len(open_a), k=-1, dtype=bool)
    use_a, use_b = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
    if not len(use_a):
        return []
    sets_a, sets_b = ([np.frombuffer(x["set"][i], _U) for i in use] for x, use in ((a, use_a), (b, use_b)))
    common = overlaps(sets_a, sets_b)
    sure = enough(common, np.array([len(s) for s in sets_a])[:, None], np.array([len(s) for s in sets_b]), link) & maybe[np.ix_(use_a, use_b)]
    found = [(a["key"][use_a[i]], b["key"][use_b[j]]) for i, j in zip(*np.nonzero(sure), strict=True)]
    return forest(found)


def forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that connect what all links connect."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x, y in links:
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def sets_of(texts: DataFrame) -> DataFrame:
    """The shingle set of each (key, set_a, text), where it is that of set_a."""
    columns = [c for c in texts.columns if c != "text"]
    place = texts.columns.index("text"), columns.index("set_a")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, raw, off in blocks(batch.column(place[0])):
                sets = shingles(raw, off)
                rest = batch.drop_columns(["text"]).slice(top, len(sets))
                mine = pa.array(set_hashes(sets).view(np.int64)[:, 0] == rest.column(place[1]).to_numpy(zero_copy_only=False))
                arrays = [*rest.columns, pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, "set"]).filter(mine)

    schema = texts.select(*columns).schema.add("set", "binary")
    return texts.mapInArrow(task, schema)


def hub_links(members: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """(a, b) of the members (key, set, hub, hub_set) that their hub is linked to."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, mine, hub, its in zip(*batch.columns, strict=True):
                x, y = np.frombuffer(mine.as_buffer(), _U), np.frombuffer(its.as_buffer(), _U)
                if enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), link):
                    out.append((hub.as_py(), key.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return members.select("key", "set", "hub", "hub_set").mapInArrow(task, "a long, b long")


def family_links(blocks_: DataFrame, link: tuple[int, int] = LINK, between=block_links) -> DataFrame:
    """What ``between`` finds among the blocks of families (family, block, members), where a member is open: not linked by the hub."""
    light = blocks_.select("family", "block", F.exists("members", lambda m: m["open"]).alias("open"))
    pair = light.alias("x").join(light.alias("y"), (F.col("x.family") == F.col("y.family")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.open") | F.col("y.open")))
    pair = pair.select(F.col("x.family").alias("family"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    left = blocks_.select("family", F.col("block").alias("i"), F.col("members").alias("left"))
    right = blocks_.select("family", F.col("block").alias("j"), F.col("members").alias("right"))
    both = pair.join(left, ["family", "i"]).join(right, ["family", "j"]).select("left", "right")
    names = blocks_.schema["members"].dataType.elementType.names

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for left, right in zip(*batch.columns, strict=True):
                a, b = ({n: [m[n].as_buffer() if n in ("bits", "set") else m[n].as_py() for m in side.values] for n in names} for side in (left, right))
                out += between(a, b, link)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return both.mapInArrow(task, "a long, b long")


def likely_links(a: dict, b: dict, link: tuple[int, int] = LINK) -> list[tuple[int, int]]:
    """Pairs of two blocks of a band key whose estimate leaves a link possible, enough to connect them all.

    Of pairs that are both near the leader nothing is said.
    """
    bits = [np.frombuffer(b"".join(x["bits"]), np.uint8).reshape(len(x["key"]), -1) for x in (a, b)]
    open_ = [np.array(x["open"], bool) for x in (a, b)]
    found = []
    for use_a, use_b in ((np.flatnonzero(open_[0]), np.arange(len(open_[1]))), (np.flatnonzero(~open_[0]), np.flatnonzero(open_[1]))):
        if len(use_a) and len(use_b):
            maybe = similarity(bits[0][use_a], bits[1][use_b]) >= least_estimate(link)
            found += [(a["key"][use_a[i]], b["key"][use_b[j]]) for i, j in zip(*np.nonzero(maybe), strict=True)]
    return forest([(x, y) for x, y in found if x != y])


def near_leader(pairs: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """(band, key, leader, near) of (band, key, leader, bits, leader_bits): whether the estimate leaves a link possible."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = 0.5**BITS
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (3, 4))
            x = a ^ b
            same = ((x < 16).astype(np.int16) + ((x & 15) == 0)).sum(1)
            near = (same / HASHES - chance) / (1 - chance) >= least_estimate(link)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near)], ["band", "key", "leader", "near"])

    return pairs.select("band", "key", "leader", "bits", "leader_bits").mapInArrow(task, "band long, key long, leader long, near boolean")


def candidates(classes: DataFrame, link: tuple[int, int] = LINK) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) between classes that may be near copies, enough to connect all of them; (key, weight) of classes that share band keys)."""
    keys = classes.select("key", "bits", F.explode("bands").alias("band"))
    size = keys.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = stash(keys.join(size.hint("shuffle_hash"), "band"))
    weight = stash(shared.groupBy("key").agg(F.sum("size").alias("weight")))
    best = F.max(F.struct("weight", (-F.col("key")).alias("low"), "bits"))
    leader = stash(shared.join(weight, "key").groupBy("band").agg(best.alias("best")).select("band", (-F.col("best.low")).alias("leader"), F.col("best.bits").alias("leader_bits")))
    tested = stash(near_leader(shared.join(leader, "band").where("leader <> key"), link))
    stars = tested.where("near").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    wide = BLOCK_BYTES // (HASHES * BITS // 8) // 4  # the estimates of two blocks are a matrix
    busy = stash(tested.where("not near").groupBy("band").agg(F.count("*").alias("far")).join(size, "band").select(F.col("band").alias("family"), F.ceil(F.col("size") / wide).cast("int").alias("n_blocks")))
    far = tested.where("not near").select(F.col("band").alias("family"), "key", F.lit(True).alias("open"))
    held = shared.select(F.col("band").alias("family"), "key", "bits").join(busy, "family").join(far, ["family", "key"], "left")
    held = held.withColumns({"open": F.coalesce("open", F.lit(False)), "block": F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int")})
    grouped = stash(held.groupBy("family", "block").agg(F.collect_list(F.struct("key", "open", "bits")).alias("members")))
    return stash(stars.union(family_links(grouped, link, likely_links)).distinct()), weight


def links(rows: DataFrame, classes: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """Links (a, b) between classes, enough to connect all that are linked.

    ``classes`` (key, first, mark, n, set_a, bands, bits) name the row (first, mark) of
    ``rows`` (key, mark, text) that stands for them.
    """
    likely, weight = candidates(classes, link)
    family = components(likely).toDF("key", "family").join(weight, "key").join(classes.drop("bands"), "key")
    family = stash(family)
    best = F.max(F.struct("weight", (-F.col("key")).alias("low")))
    about = family.groupBy("family").agg(F.sum("n").alias("total"), best.alias("best")).select("family", F.ceil(F.col("total") * 8 / BLOCK_BYTES).cast("int").alias("n_blocks"), (-F.col("best.low")).alias("hub"))
    placed = family.join(stash(about), "family").withColumn("block", F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int"))
    placed = placed.select(F.col("key").alias("node"), F.col("first").alias("key"), "mark", "set_a", "bits", "family", "block", "n_blocks", "hub")
    texts = rows.join(placed.hint("shuffle_hash"), ["key", "mark"]).dropDuplicates(["key", "mark"])  # rows that repeat as a whole count once
    members = stash(sets_of(texts.drop("key", "mark").withColumnRenamed("node", "key")))
    hubs = stash(members.where("key = hub").select("hub", F.col("set").alias("hub_set")))
    first = stash(hub_links(members.where("key <> hub").join(hubs, "hub"), link).distinct())
    linked = first.select(F.col("b").alias("key"), F.lit(False).alias("open"))
    state = stash(members.select("key", "family", "n_blocks", "hub").join(linked, "key", "left").withColumn("open", F.coalesce("open", F.col("key") != F.col("hub"))))
    # families with open members, a row for each block: dealt by blocks from here on, so that a large family is spread
    busy = state.where("open").select("family", "n_blocks").distinct().select("family", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    fields = F.struct("key", "open", "bits", "set")
    held = members.select("key", "family", "block", "bits", "set").join(state.select("key", "open"), "key").join(busy.hint("shuffle_hash"), ["family", "block"], "left_semi")
    grouped = stash(held.groupBy("family", "block").agg(F.collect_list(fields).alias("members")))
    return first.union(family_links(grouped, link))


def classed(signed: DataFrame) -> DataFrame:
    """(node, first, first_mark, set hashes, n): the classes of rows of equal sets, each with its first row.

    ``node`` is that row's id, but where ids repeat it may be the smallest of several classes:
    all but one of these get a number of their own, so that classes never merge by an id.
    """
    same = ["set_a", "set_b", "n"]
    # tables of their own: joined to an aggregate in the same stage, a large group of copies could not be split
    least = signed.where("n > 0").groupBy(*same).agg(F.min(F.struct("key", "mark")).alias("r"))
    least = stash(least.select(*same, F.col("r.key").alias("first"), F.col("r.mark").alias("first_mark")))
    several = stash(least.groupBy("first").agg(F.min(F.struct(*same)).alias("own"), F.count("*").alias("k")).where("k > 1").select("first", "own"))
    other = F.lit(-(2**62)) - F.shiftrightunsigned(F.xxhash64(*same), 2)
    node = F.when(F.col("own").isNull() | (F.col("own") == F.struct(*same)), F.col("first")).otherwise(other)
    return stash(least.join(several, "first", "left").select(node.alias("node"), "first", "first_mark", *same))


def near_duplicates(docs: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id, kept, mark, stays.

    ``link`` is the share of common shingles, as numerator and denominator, from which
    on two texts are near copies.

    Null, empty and blank texts have no shingles and are linked with nothing; a text of
    fewer words than a shingle is one shingle.  Rows of equal sets are linked; repeated
    rows of one id and text share everything.  A null id counts as the smallest.  Links
    are between texts, not ids: rows of one id with different texts have each their own
    component.  ``kept`` tells whether the id is the component's.  ``stays``
    is the verdict on the row for removal: true for one text of each component and for
    every text without shingles; ``mark`` is xxhash64 of the text and, with the id, names
    the row.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("key", F.xxhash64("text").alias("mark"), "text")
    signed = stash(signatures(rows))
    same = ["set_a", "set_b", "n"]
    nodes = classed(signed)
    classes = signed.join(nodes, same).where("key = first and mark = first_mark").select(F.col("node").alias("key"), "first", "mark", "n", "set_a", "bands", "bits").dropDuplicates(["key"])
    joined = stash(components(links(rows, stash(classes), link)).toDF("node", "component"))
    label = stash(joined.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min(F.struct("first", "node")).alias("label")))
    verdict = stash(nodes.join(joined, "node", "left").join(label, "component", "left").select(*same, "first", "first_mark", "node", "label"))
    out = signed.select("key", "mark", *same).join(verdict, same, "left")
    c = F.coalesce("label.first", "first", "key")
    stays = F.col("first").isNull() | (F.col("key") == c) & (F.col("mark") == F.col("first_mark")) & (F.coalesce("label.node", "node") == F.col("node"))
    known = lambda x: F.when(x != NULL_ID, x)
    return out.select(known(F.col("key")).alias("doc_id"), F.col("n").alias("n_shingles"), known(c).alias("component_id"), (F.col("key") == c).alias("kept"), "mark", stays.alias("stays"))


def drop_near_duplicates(docs: DataFrame, link: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with one document of each group of near copies.

    The verdict belongs to the row, by id and text, so ids that repeat lose no text that is
    no copy.  Of rows that repeat id and text one stays, unless the text has no shingles: those all stay.
    """
    found = stash(near_duplicates(docs, link).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__key"), F.col("mark").alias("__mark"), "stays", "n_shingles"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.withColumns({"__key": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "__mark": F.xxhash64(text)})
    held = named.join(found.where("not stays").select("__key", "__mark"), ["__key", "__mark"], "left_anti")
    twice = stash(found.where("stays and n_shingles > 0").groupBy("__key", "__mark").count().where("count > 1").select("__key", "__mark"))
    one = held.join(twice, ["__key", "__mark"], "left_semi").dropDuplicates(["__key", "__mark"])
    return held.join(twice, ["__key", "__mark"], "left_anti").unionByName(one).select(*docs.columns)
