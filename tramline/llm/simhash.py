"""SimHash near-dedup with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, sliced, table

#: Production parameters of op3: words a shingle, and the most differing bits of a link.
WORDS, MOST_BITS = 3, 2
#: Larger candidate groups are linked through shared neighbours instead of by pairs.
_MOST_PAIRED = 8
_BLOCKS = 4
_SLICE = 1 << 16

#: Parameters of similar_dedup: words a shingle, the least Jaccard similarity of a link, bits beyond which a pair is discarded.
#: Pairs with a document of fewer than FAR_SHINGLES shingles are not discarded: so few hashes make fingerprints that say little.
SIMILAR_WORDS, LEAST_SIMILARITY, FAR_BITS, FAR_SHINGLES = 5, 0.8, 28, 32
#: Keys of a document and minima a key, for all documents and for those in crowds. A pair of similarity 0.8 shares no
#: key once in 300,000 times, in crowds once in 9,000 times; one of 0.85 never to speak of. Sharing a key is enough.
_KEYS = [(24, 4), (128, 12)]
#: Members of a group that its picked member meets in one task.
_MEET = 64
#: Members of a crowd, and of its leads, that meet in one task; shingles counted at a time there.
_CELL_ROWS, _CELL_SHINGLES = 256, 4096


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: The pivots: a base, the base with one bit turned for each bit, and spread ones; all by rule, none from the data.
BASE = xxhash.xxh64_intdigest(b"pivot", 0)
TURNED = [BASE ^ (1 << i) for i in range(64)]
SPREAD = [xxhash.xxh64_intdigest(b"pivot", i) for i in range(1, 17)]


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The XXH64 of a text's shingles in order, repeats included, in slices of bounded size."""
    tokens = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not tokens:
        return
    n = max(1, len(tokens) - words + 1)
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) >= words else iter([b" ".join(tokens)])
    hashes = map(partial(xxhash.xxh64_intdigest, seed=seed), shingles)
    for start in range(0, n, _SLICE):
        yield np.fromiter(hashes, np.uint64, min(_SLICE, n - start))


def majority(slices: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes: a bit is set if over half of them have it."""
    ones, n = np.zeros(64, np.int64), 0
    for h in slices:
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(text: str | None, words: int = WORDS, seed: int = 42) -> int:
    """The unsigned fingerprint of one text; see near_dedup."""
    return majority(shingle_hashes(text, words, seed))


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((simhash(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64), pa.int64())], ["_id", "_fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """-> (_id, _fp): the 64-bit fingerprint as a signed long."""
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return base.mapInArrow(lambda it: _fingerprints(it, words), "_id long, _fp long")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(nodes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """nodes(node, fp), fp distinct -> edges (u, v) that connect exactly what links of most_bits bits connect.

    The pivot table holds each fingerprint's distances to 81 pivots. Within a block of 16 bits, the 16 turned
    pivots' distances less the base's tell fingerprints apart, and a differing bit changes just one of them; so of
    four blocks, two fingerprints within two bits agree in all table coordinates of at least two. Candidates are
    therefore the fingerprints that agree in the coordinates of a pair of blocks: six keys each, by equi-grouping.
    Pairs whose coordinates for the spread pivots differ by more than most_bits anywhere are discarded (triangle
    inequality), survivors are verified by their true distance.

    A crowd of near copies may put thousands of fingerprints under one key. Members of groups over 8 are linked
    exactly without pairs: two fingerprints are within two bits if and only if some word is within one bit of
    both, so each emits its 65 words within one bit, and those who share a word are linked to its smallest node.
    At most 65 fingerprints share a word. Both ways together lose no link and make none.
    """
    if most_bits != 2:
        raise ValueError("the blocks and the shared words are laid out for two bits")
    # d(x, turned) - d(x, base) is -1 or 1; packed to a bit each, the coordinates of a block make its key.
    toward = [(_distance(F.col("fp"), F.lit(_signed(p))) - F.col("_base") + 1) / 2 for p in TURNED]
    size = 64 // _BLOCKS
    keyed = nodes.withColumn("_base", _distance(F.col("fp"), F.lit(_signed(BASE))))
    coordinates = [reduce(lambda a, b: a + b, [toward[k * size + i].cast("long") * (1 << i) for i in range(size)]) for k in range(_BLOCKS)]
    keyed = keyed.select("node", "fp", F.array(*[_distance(F.col("fp"), F.lit(_signed(p))).cast("byte") for p in SPREAD]).alias("_far"), *[c.alias(f"_c{k}") for k, c in enumerate(coordinates)])
    pairs = list(combinations(range(_BLOCKS), 2))
    keys = [F.lit(n).cast("long") * (1 << 32) + F.col(f"_c{a}") * (1 << 16) + F.col(f"_c{b}") for n, (a, b) in enumerate(pairs)]
    members = keyed.select("node", "fp", "_far", F.explode(F.array(*keys)).alias("_key"))
    light = keyed.select("node", "fp", F.explode(F.array(*keys)).alias("_key"))
    sizes = light.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    small = members.join(sizes.filter(F.col("_n") <= _MOST_PAIRED), "_key").groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("node", "fp", "_far"))).alias("_all"))
    first = small.select("_all", F.posexplode("_all").alias("_i", "_x")).select("_x", F.explode(F.slice("_all", 1, F.col("_i"))).alias("_y"))
    apart = F.array_max(F.zip_with("_x._far", "_y._far", lambda a, b: F.abs(a - b)))
    near = first.filter(apart <= most_bits).filter(_distance(F.col("_x.fp"), F.col("_y.fp")) <= most_bits)
    paired = near.select(F.col("_x.node").alias("u"), F.col("_y.node").alias("v"))
    crowd = light.join(sizes.filter(F.col("_n") > _MOST_PAIRED).select("_key"), "_key", "left_semi").select("node", "fp").distinct()
    turned = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    words = crowd.select("node", F.explode(F.concat(F.array("fp"), turned)).alias("_word"))
    shared = words.groupBy("_word").agg(F.collect_list("node").alias("_all")).filter(F.size("_all") > 1)
    starred = shared.select(F.array_min("_all").alias("v"), F.explode("_all").alias("u")).filter("u <> v").select("u", "v")
    return paired.union(starred).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """-> (id_col, fingerprint string, component_id long), one row per input row.

    Texts are lower-cased (A-Z) and split at ASCII white space; a shingle is `words` words joined by a space, repeats
    count, fewer words are one shingle. A bit is set if over half of the shingles' XXH64 (seed 42) have it. Null and
    empty texts have fingerprint zero and are linked like any other. Fingerprints link at two or fewer differing bits;
    component_id is the smallest id reachable. Equal fingerprints are one node, so copies are never paired. Rows
    without an id have their fingerprint's component, or null if nothing with an id is linked to it. Other columns are
    ignored. An empty table gives an empty result.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, words))
    groups = prints.groupBy("_fp").agg(F.min("_id").alias("node"), F.count(F.lit(1)).alias("_n"))
    nodes = checkpointed(groups.filter("node is not null").select(F.col("_fp").alias("fp"), "node", "_n"))
    found = connected_components(links(nodes.select("node", "fp")))
    named = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.filter("_n > 1 or component <> node").select(F.col("fp").alias("_fp"), "component")
    return prints.join(named, "_fp", "left").select(
        F.col("_id").alias(id_col),
        F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        F.coalesce("component", "_id").alias("component_id"),
    )


#: Odd multipliers, one a minimum; the order of the products is the order of a shuffle of the shingles.
_SHUFFLES = np.array([xxhash.xxh64_intdigest(b"minimum", i) | 1 for i in range(max(k * m for k, m in _KEYS))], np.uint64)


def _set_of(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def _sketches(batches: Iterator[pa.RecordBatch], words: int, keys: int, minima: int) -> Iterator[pa.RecordBatch]:
    """(id, text or shingle set) -> (id, fingerprint of the distinct shingles, their number, keys)."""
    shuffles = _SHUFFLES[: keys * minima]
    rows_at_once = max(1, _SLICE * 4 // len(shuffles))
    for batch in sliced(batches):
        prints, sizes, found = [], [], []
        for given in batch.column(1).to_pylist():
            h = np.frombuffer(given, "<u8") if isinstance(given, bytes) else _set_of(given, words)
            prints.append(_signed(majority([h])))
            sizes.append(len(h))
            if not len(h):
                found.append([])
                continue
            least = np.full(len(shuffles), np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(h), rows_at_once):
                np.minimum(least, (h[at : at + rows_at_once, None] * shuffles).min(axis=0), out=least)
            rows = least.astype("<u8").reshape(keys, minima)
            found.append([_signed(xxhash.xxh64_intdigest(row.tobytes(), n)) for n, row in enumerate(rows)])
        columns = [batch.column(0), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["_id", "_fp", "_n", "_keys"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = [_set_of(t, words).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["_id", "_set"])


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        similar = []
        for a, b in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            similar.append(both >= least * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(similar, pa.bool_()))


def _candidates(docs: DataFrame, words: int, keys: int, minima: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs(_id, text or shingle set) -> sketches (_id, _fp, _n), who shares a key (_key, _id, _size, _picked), their pairs (u, v, s), and the crowds (_key, _id, _picked).

    In a crowd v is the picked member, and s deals the many pairs that it has.
    """
    sketched = checkpointed(docs.mapInArrow(lambda it: _sketches(it, words, keys, minima), "_id long, _fp long, _n long, _keys array<long>"))
    members = sketched.select(F.explode("_keys").alias("_key"), "_id")
    pick = F.min_by("_id", F.xxhash64("_id"))  # mostly the same member in all keys that a crowd shares
    # written out, so that both sides of the join are dealt for it and a hot key's partition can be split
    groups = checkpointed(members.groupBy("_key").agg(F.count(F.lit(1)).alias("_size"), pick.alias("_picked")).filter("_size > 1"))
    met = checkpointed(members.join(groups, "_key"))
    small = met.filter(F.col("_size") <= _MOST_PAIRED).groupBy("_key").agg(F.sort_array(F.collect_set("_id")).alias("_all"))
    paired = small.select("_all", F.posexplode("_all").alias("_i", "u")).select("u", F.explode(F.slice("_all", 1, F.col("_i"))).alias("v"), F.lit(0).alias("s"))
    crowded = met.filter(F.col("_size") > _MOST_PAIRED)
    dealt = F.pmod(F.xxhash64("_id", F.lit(1)), F.ceil(F.col("_size") / _MEET)).cast("int")
    pairs = paired.union(crowded.select(F.col("_id").alias("u"), F.col("_picked").alias("v"), dealt.alias("s")))
    return sketched.select("_id", "_fp", "_n"), met, pairs.filter("u <> v").groupBy("u", "v").agg(F.min("s").alias("s")), crowded.select("_key", "_id", "_picked")


def _both(pairs: DataFrame, known: DataFrame, what: str) -> DataFrame:
    """pairs(u, v, s) with what is known of u as _x and of v as _y. A row of known goes to as many places as v's pairs are dealt to."""
    places = pairs.groupBy("v").agg(F.max("s").alias("_most"))
    second = known.select(F.col("_id").alias("v"), F.col(what).alias("_y")).join(places, "v").select("v", F.explode(F.sequence(F.lit(0), F.col("_most"))).alias("s"), "_y")
    return pairs.join(known.select(F.col("_id").alias("u"), F.col(what).alias("_x")), "u").join(second, ["v", "s"])


def _survivors(pairs: DataFrame, sketched: DataFrame, least: float, far_bits: int) -> DataFrame:
    """The pairs that neither sizes nor pivot distances nor fingerprints discard."""
    far = F.array(*[_distance(F.col("_fp"), F.lit(_signed(p))).cast("byte") for p in SPREAD])
    table = sketched.dropDuplicates(["_id"]).select("_id", F.struct(F.col("_fp").alias("fp"), F.col("_n").alias("n"), far.alias("far")).alias("_sketch"))
    near = _both(pairs, table, "_sketch").filter(F.least("_x.n", "_y.n") >= F.lit(least) * F.greatest("_x.n", "_y.n"))
    most = F.when(F.least("_x.n", "_y.n") < FAR_SHINGLES, 64).otherwise(far_bits)
    near = near.filter(F.array_max(F.zip_with("_x.far", "_y.far", lambda a, b: F.abs(a - b))) <= most)
    return near.filter(_distance(F.col("_x.fp"), F.col("_y.fp")) <= most).select("u", "v", "s")


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    sets = docs.select("_id", "_text").mapInArrow(lambda it: _sets(it, words), "_id long, _set binary")
    return sets.groupBy("_id").agg(F.max("_set").alias("_set"))  # rows that repeat an id


def _verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v, s) whose whole shingle sets have a similarity of `least` or more, as (u, v)."""
    pairs = checkpointed(pairs.select("u", "v", "s"))
    return checkpointed(_both(pairs, sets, "_set").select("u", "v", "_x", "_y").mapInArrow(lambda it: _verified(it, least), "u long, v long"))


def _named(df: DataFrame, parts: DataFrame, node: str, out: str) -> DataFrame:
    """With the component of each node, or itself where it has none."""
    return df.join(parts.select(F.col("node").alias(node), F.col("component").alias(out)), node, "left").withColumn(out, F.coalesce(out, node))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for crowd, key, own in zip(*(c.to_pylist() for c in batch.columns)):
            shingles = np.frombuffer(own, "<i8")
            for at in range(0, len(shingles), _SLICE):
                part = shingles[at : at + _SLICE]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), crowd)), pa.array(np.full(len(part), key)), pa.array(part)], ["_crowd", "_id", "_shingle"])


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each set of x shares with each of y."""
    flat = [np.concatenate(s) for s in (x, y)]
    both = np.intersect1d(*flat)
    rows, columns = [], []
    for sets, f in zip((x, y), flat):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, f)
        met = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == f) if len(both) else np.zeros(len(f), bool)
        order = np.argsort(at[met], kind="stable")
        rows.append(row[met][order])
        columns.append(at[met][order])
    out = np.zeros((len(x), len(y)), np.int64)
    for start in range(0, len(both), _CELL_SHINGLES):
        held = []
        for sets, row, column in zip((x, y), rows, columns):
            a, b = np.searchsorted(column, [start, start + _CELL_SHINGLES])
            m = np.zeros((len(sets), _CELL_SHINGLES), np.float32)
            m[row[a:b], column[a:b] - start] = 1
            held.append(m)
        out += (held[0] @ held[1].T).astype(np.int64)
    return out


def _met(least: float):
    def run(members: pd.DataFrame, leads: pd.DataFrame) -> pd.DataFrame:
        """The links between a block of members and one of leads, one for each two components."""
        if not len(members) or not len(leads):
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        x, y = ([np.frombuffer(s, "<u8") for s in d["_set"]] for d in (members, leads))
        both = _shared(x, y)
        sizes = [np.array([len(s) for s in z]) for z in (x, y)]
        similar = both >= least * (sizes[0][:, None] + sizes[1][None, :] - both)
        i, j = np.nonzero(similar & (members["_part"].to_numpy()[:, None] != leads["_part"].to_numpy()[None, :]))
        found = pd.DataFrame({"u": members["_id"].to_numpy()[i], "v": leads["_id"].to_numpy()[j], "p": members["_part"].to_numpy()[i], "q": leads["_part"].to_numpy()[j]})
        return found.drop_duplicates(["p", "q"])[["u", "v"]]

    return run


def _dealt(df: DataFrame, block: str, owner: str) -> DataFrame:
    """With the name of a row's block in its crowd; a component over a block's size has blocks of its own, and its name as owner."""
    sizes = df.groupBy("_crowd", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_large", F.col("_n") > _CELL_ROWS)
    sizes = sizes.withColumn("_owner", F.when(F.col("_large"), F.col("_part")).otherwise(F.lit(0)))
    blocks = sizes.groupBy("_crowd", "_large", "_owner").agg(F.ceil(F.sum("_n") / _CELL_ROWS).alias("_blocks"))
    known = sizes.join(blocks, ["_crowd", "_large", "_owner"]).select("_crowd", "_part", "_large", "_owner", "_blocks")
    named = F.concat_ws(":", F.col("_large").cast("string"), "_owner", F.pmod(F.xxhash64("_id"), "_blocks"))
    return df.join(known, ["_crowd", "_part"]).select(*df.columns, named.alias(block), F.when(F.col("_large"), F.col("_owner")).alias(owner))


def _crowd_links(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """rest(_id, _picked, _part), the members of groups that no key parts -> edges that connect all that links among them connect.

    Exact, within each crowd (groups with common members). A shingle is rare if up to eight members hold it, else
    common. Two linked members share a rare shingle, then they are paired and verified; or all they share is common.
    Of members with the same common shingles, the one with the fewest shingles in all leads. If x and y share no rare
    shingle, x is at least as similar to the lead of y's as to y, y to the lead of x's, and the leads to each other, so
    members have to meet the leads alone. Only those of whose shingles a part of `least` is common need to. A passage that
    all share makes one lead; where most members differ in common shingles, all blocks of them meet.
    """
    crowds = connected_components(rest.select(F.col("_id").alias("u"), F.col("_picked").alias("v")), written=True)
    members = rest.select("_id", "_part").distinct().join(crowds.select(F.col("node").alias("_id"), F.col("component").alias("_crowd")), "_id")
    members = checkpointed(members.join(sets, "_id").select("_crowd", "_id", "_part", "_set"))
    shingles = members.select("_crowd", "_id", "_set").mapInArrow(_exploded, "_crowd long, _id long, _shingle long")
    counts = shingles.groupBy("_crowd", "_shingle").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    rare = shingles.join(counts.filter(F.col("_n") <= _MOST_PAIRED), ["_crowd", "_shingle"]).groupBy("_crowd", "_shingle").agg(F.sort_array(F.collect_set("_id")).alias("_all"))
    rare = rare.select("_all", F.posexplode("_all").alias("_i", "u")).select("u", F.explode(F.slice("_all", 1, F.col("_i"))).alias("v"), F.lit(0).alias("s")).distinct()
    parts = members.select(F.col("_id").alias("node"), F.col("_part").alias("component"))
    paired = _verify(_named(_named(rare, parts, "u", "_p"), parts, "v", "_q").filter("_p <> _q"), sets, least)
    common = shingles.join(counts.filter(F.col("_n") > _MOST_PAIRED).select("_crowd", "_shingle"), ["_crowd", "_shingle"], "left_semi")
    common = common.groupBy("_id").agg(F.sort_array(F.collect_list("_shingle")).alias("_common"))
    common = common.select("_id", F.size("_common").alias("_n_common"), F.sha2(F.array_join(F.col("_common").cast("array<string>"), ","), 256).alias("_like"))
    n = F.octet_length("_set") / 8
    rich = checkpointed(members.join(common, "_id").filter(F.col("_n_common") >= F.lit(least) * n))
    first = rich.groupBy("_crowd", "_like").agg(F.min(F.struct(n.alias("n"), "_id"))["_id"].alias("_id")).select("_id")
    columns = ["_crowd", "_id", "_part", "_set"]
    x, y = _dealt(rich.select(*columns), "_a", "_a_owner"), _dealt(rich.join(first, "_id", "left_semi").select(*columns), "_b", "_b_owner")
    cells = x.select("_crowd", "_a", "_a_owner").distinct().join(y.select("_crowd", "_b", "_b_owner").distinct(), "_crowd")
    cells = checkpointed(cells.filter(F.coalesce(F.col("_a_owner") != F.col("_b_owner"), F.lit(True))).select("_crowd", "_a", "_b"))
    keys = ["_crowd", "_a", "_b"]
    # named anew on both sides, as they come of one table
    sides = [df.join(cells, ["_crowd", own]).select(*[F.col(c).alias(c) for c in (*keys, "_id", "_part", "_set")]).groupBy(*keys) for df, own in ((x, "_a"), (y, "_b"))]
    return paired.union(checkpointed(sides[0].cogroup(sides[1]).applyInPandas(_met(least), "u long, v long")))


def similar_links(docs: DataFrame, words: int = SIMILAR_WORDS, least: float = LEAST_SIMILARITY, far_bits: int = FAR_BITS) -> DataFrame:
    """docs(_id, _text) -> edges (u, v) that connect what pairs of a Jaccard similarity of `least` or more connect.

    At 0.8 fingerprints differ by some ten bits, too many for keys made of their bits. So candidates share a key of
    four minima of the shingles' hashes; sizes too different and pairs whose distances to a pivot differ by more than
    far_bits anywhere are discarded, then those whose fingerprints do; survivors are verified by their whole shingle sets.

    Groups of up to eight are paired. In a larger group (a crowd of near copies, a passage that many short texts share)
    every member meets the one member that a hash picks. Members of crowds have further keys, more and finer ones, which
    part the crowd into small groups; their pairs are verified unless links found before connect them already. Groups
    over eight that even these keys leave, and that links have not made one component, get their links from
    _crowd_links. Work grows with the members, but for crowds without an order of their own there.
    """
    docs = docs.filter("_id is not null")
    sketched, met, coarse, crowd = _candidates(docs, words, *_KEYS[0])
    sets = checkpointed(_shingle_sets(docs.join(met.select("_id").distinct(), "_id", "left_semi"), words))
    found = _verify(_survivors(coarse, sketched, least, far_bits), sets, least)
    if not crowd.head(1):
        return found
    crowded = crowd.select("_id").distinct()
    _, _, fine, crowd = _candidates(sets.join(crowded, "_id", "left_semi").select("_id", "_set"), words, *_KEYS[1])
    part = connected_components(found, written=True)
    apart = _both(fine, _named(crowded, part, "_id", "_part"), "_part").filter("_x <> _y").select("u", "v", "s")
    found = found.union(_verify(apart, sets, least))
    held = _named(crowd, connected_components(found, written=True), "_id", "_part")
    unsettled = held.groupBy("_key").agg(F.min("_part").alias("_p"), F.max("_part").alias("_q")).filter("_p <> _q").select("_key")
    rest = checkpointed(held.join(unsettled, "_key", "left_semi").select("_id", "_picked", "_part").distinct())
    return found.union(_crowd_links(rest, sets, least)) if rest.head(1) else found


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, least: float = LEAST_SIMILARITY) -> DataFrame:
    """-> (id_col, component_id) of the documents linked to another: component_id is the smallest id reachable.

    Texts are lower-cased and split as in near_dedup; links are those of similar_links. Fewer words than a shingle has
    are one shingle. Null and empty texts and those without words have no shingles and no links, nor have rows without
    an id. Of rows that repeat an id, each is looked up by its own keys and verified by one of the texts. Other columns
    are ignored. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = connected_components(similar_links(base, words, least), written=True)
    return found.select(F.col("node").alias(id_col), F.col("component").alias("component_id"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
