"""Groups of near copies: texts whose sets of five-word shingles have Jaccard 0.8 at least, or whose SimHashes differ in at most two bits.

The Jaccard join is exact, by prefix filtering with positions.  All shingles have one order, the rare
ones first.  Two sets of m and n that reach 0.8 share 4 (m + n) / 9 at least, so the first that they
share stands no later in either than that many from its end, and among the first fifth and one of
both.  Those are posted with their places, and only pairs that meet at such places are looked at: by
the posted shingles that both have, which bounds what they can share, then by their whole sets (of
64-bit hashes).

Only what connects is needed.  First each posting's members are compared with the member that has the
posting's shingle nearest to its start, one with few rare shingles of its own, which large groups
of copies have in their middle.  Then only pairs that are not connected yet are compared: members
outside a posting's largest component with all others of it.

The order begins as that of a sample's counts, then of the hashes; any order gives the same groups.  The sample is a share
of the table, so that what becomes frequent with more rows stands late from the start.  What it does not show is counted over the whole table: a posting with over ``CROWD`` members outside its largest
component holds a common passage rather than copies, and its shingle moves to the end of the order.  With it go the other
shingles of the passage: of those that stand within ``REACH`` places of it in a text of each component that posts it, those
that texts of over ``CROWD`` components have there.  So what is looked at grows with the places of crowded shingles, not with
the lengths and copies of the texts around them; a passage that reaches further is found by the others of its shingles that
are crowded, in the same round or the next.  The
texts post their next shingles instead, and what these bring together is compared in a further round; texts that do
not post a moved shingle would not either way.  So each shingle brings a member together with a bounded number of others,
unless a text has too few others to post.

Texts are named by 128 bits of a hash, sets of shingles are told apart by as many and numbered.

Defined cases: letters A-Z are lower-cased and words end at ASCII white space; a text of fewer than
five words is one shingle; a null text is like an empty one; texts of any length are taken whole; ties
of the order go by hash; an empty table gives no rows; columns of any name are carried along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import simhash
from docloom.llm.graph import components
from docloom.llm.shared import scratch, small_batches, written

SEED = 42
WORDS_EACH = 5
#: So many of each so many documents have their shingles counted for the order, whose counts are used for so many shingles at most.
SAMPLE, OUT_OF, MOST_COUNTED = 4_000, 24_000, 100_000
#: Texts that are Python bytes at a time.
ROWS = 250
#: Rows of a number and a hash that are sent to every task at most: 24 megabytes.
BROADCAST_ROWS = 1_000_000
#: Members outside a posting's largest component with which all are compared, and rounds in which shingles of larger ones are moved to the end.
CROWD, ROUNDS = 32, 6
#: Places to either side of a crowded shingle that are looked at for others of its passage.
REACH = 64


def _sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``ROWS`` at most, so that few texts are Python objects at a time."""
    return (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS))


def _in_place(text: bytes, words_each: int = WORDS_EACH) -> np.ndarray:
    """The hashes of a text's shingles as they stand in it."""
    words = text.lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - words_each + 1)
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist()) if words else [(0, 0)]
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def shingles(text: bytes, words_each: int = WORDS_EACH) -> np.ndarray:
    """The hashes of a text's different shingles, in order."""
    return np.unique(_in_place(text, words_each))


def _around(text: bytes, own: np.ndarray) -> np.ndarray:
    """The hashes of the different shingles that stand within ``REACH`` places of one of a text's ``own``, in order."""
    hashes = _in_place(text)
    at, change = np.flatnonzero(np.isin(hashes, own)), np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, np.maximum(at - REACH, 0), 1)
    np.add.at(change, np.minimum(at + REACH + 1, len(hashes)), -1)
    return np.unique(hashes[np.cumsum(change[:-1]) > 0])


def _among(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the hashes stand among the ``known`` ones, which are in order, and which of them do."""
    if not len(known):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return at, known[at] == hashes


def prefix(hashes: np.ndarray, counted: np.ndarray, counts: np.ndarray, moved: np.ndarray = np.zeros(0, np.uint64)) -> np.ndarray:
    """The shingles to post: enough of the first ones that no set of Jaccard 0.8 has none of them.  Those that are ``moved`` are the last."""
    at, found = _among(hashes, counted)
    weight = np.where(found, counts[at], 0) if len(counted) else np.zeros(len(hashes), np.int64)
    weight[_among(hashes, moved)[1]] = np.iinfo(np.int64).max
    return hashes[np.lexsort((hashes, weight))][: len(hashes) // 5 + 1]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def text_hash(text_col: str) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _counted(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of the texts, in order, and their counts."""

    def run(batches):
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()).view(np.int64))], ["key"])

    n = texts.count()
    every = max(1, n // (SAMPLE * max(1, -(-n // OUT_OF))))  # a share of the table: else what a larger one repeats often is unknown to the order
    some = texts.where(F.pmod(F.xxhash64("t", F.lit(SEED)), F.lit(every)) == 0).dropDuplicates(["t"]).select("text").mapInArrow(run, "key bigint")
    found = some.groupBy("key").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(MOST_COUNTED).toPandas()
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["n"].to_numpy(np.int64)[order]


def _compared(texts: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of sets that reach the similarity."""

    def whole(batches):
        for batch in _sliced(batches):
            found = [shingles(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in found], pa.binary())], ["node", "hashes"])

    def compare(batches):
        for batch in _sliced(batches):
            kept = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    with scratch(pairs.sparkSession) as result:
        return result(_compared_with(texts, sets, pairs, whole, compare), "similar")


def _of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, and the columns of ``wanted``) of each text that is wanted by its name ``t``, once."""
    few = wanted.count() <= BROADCAST_ROWS  # else texts and names meet by shuffles
    names = wanted.select("t")
    return texts.join(F.broadcast(names) if few else names, "t", "left_semi").dropDuplicates(["t"]).join(wanted, "t")


def _compared_with(texts: DataFrame, sets: DataFrame, pairs: DataFrame, whole, compare) -> DataFrame:
    wanted = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(sets.select("node", "t"), "node"), "wanted")
    bodies = written(_of(texts, wanted).select("node", "text").mapInArrow(whole, "node bigint, hashes binary"), "bodies")
    a, b = (bodies.select(F.col("node").alias(x), F.col("hashes").alias(f"of_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b").mapInArrow(compare, "a bigint, b bigint")


def _fit(a: str, b: str) -> Column:
    """Two postings of one shingle are where the first shared one of two similar sets can be."""
    need = 4 * (F.col(f"{a}.n") + F.col(f"{b}.n"))
    return (9 * (F.col(f"{a}.n") - F.col(f"{a}.place")) >= need) & (9 * (F.col(f"{b}.n") - F.col(f"{b}.place")) >= need)


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, that postings (key, p: node, place, n, root) of two kinds bring together across components."""
    pairs = left.select("key", F.col("p").alias("x")).join(right.select("key", F.col("p").alias("y")), "key").where(F.col("x.root") != F.col("y.root")).where(_fit("x", "y"))
    return pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def _within_reach(met: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of those ``met`` that can reach the similarity by the shingles that both post: all else they share lies beyond what one of them posts."""
    for x in "ab":
        met = met.join(sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("keys").alias(f"keys_{x}")), x)
    beyond = F.greatest(*[F.col(f"n_{x}") - F.expr(f"n_{x} div 5") - 1 for x in "ab"])
    return met.where(9 * (F.size(F.array_intersect("keys_a", "keys_b")) + beyond) >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _postings(sets: DataFrame) -> DataFrame:
    return sets.select("node", "n", F.posexplode("keys").alias("place", "key")).select("key", F.struct("node", "place", "n", F.col("node").alias("root")).alias("p"))


def _met_in(texts: DataFrame, sets: DataFrame, post: DataFrame, known: DataFrame | None, moved: DataFrame | None, last: bool) -> tuple[DataFrame, DataFrame]:
    """(links, crowded): the ``known`` links and those of what ``post`` brings together beyond what they connect.

    Postings that are ``crowded`` (key) are left for the next round, unless this is the last or their shingle is ``moved`` already.
    """
    with scratch(texts.sparkSession) as result:
        links, crowded = _met_and_compared(texts, sets, post, known, moved, last)
        return result(links, "links"), result(crowded, "crowded")


def _met_and_compared(texts: DataFrame, sets: DataFrame, post: DataFrame, known: DataFrame | None, moved: DataFrame | None, last: bool) -> tuple[DataFrame, DataFrame]:
    middle = post.groupBy("key").agg(F.min_by("p", F.struct("p.place", F.xxhash64("p.node", "key"))).alias("p"))
    stars = written(_within_reach(_met(post, middle), sets), "stars")
    first = _compared(texts, sets, stars)
    linked = first if known is None else known.union(first)

    roots = components(linked).select(F.col("node").alias("of"), F.col("root").alias("to"))
    own = F.struct("p.node", "p.place", "p.n", F.coalesce("to", "p.root").alias("root"))
    rooted = written(post.join(roots, post["p.node"] == roots["of"], "left").select("key", own.alias("p")), "rooted")
    sizes = rooted.groupBy("key", F.col("p.root").alias("root")).agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"))
    apart = sizes.where("parts > 1").select("key", F.col("main.root").alias("main"), (F.col("n") - F.col("main.n") > (2**62 if last else CROWD)).alias("crowd"))
    apart = written(apart if moved is None else apart.join(moved.withColumn("_moved", F.lit(True)), "key", "left").select("key", "main", (F.col("crowd") & F.col("_moved").isNull()).alias("crowd")), "apart")
    rest = rooted.join(apart.where("NOT crowd").drop("crowd"), "key")
    pairs = written(_within_reach(_met(rest.where("p.root <> main"), rest).join(stars, ["a", "b"], "left_anti"), sets), "pairs")
    return linked.union(_compared(texts, sets, pairs)).distinct(), apart.where("crowd").select("key")


def _crowding(texts: DataFrame, sets: DataFrame, links: DataFrame, crowded: DataFrame) -> DataFrame:
    """(key): the ``crowded`` shingles, and those near one of them in texts of over ``CROWD`` components, of which each shows one text for each crowded shingle."""

    def run(batches):
        for batch in _sliced(batches):
            found = [_around(t.as_py(), np.array(own.as_py(), np.int64).view(np.uint64)).view(np.int64) for own, t in zip(batch.column(1), batch.column(2).cast(pa.binary()))]
            size = [len(h) for h in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["root", "key"])

    hit = sets.select("node", "t", F.explode("keys").alias("key")).join(crowded, "key")
    rooted = hit.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    shown = rooted.groupBy("key", "root").agg(F.min(F.struct("node", "t")).alias("shown"))
    wanted = shown.groupBy("root", "shown.t").agg(F.collect_list("key").alias("own"))
    every = _of(texts, written(wanted, "crowds")).select("root", "own", "text").mapInArrow(run, "root bigint, key bigint")
    common = every.groupBy("key", "root").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    return crowded.union(common.select("key")).distinct()


def _reposted(texts: DataFrame, sets: DataFrame, moved: DataFrame, counted: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Those of the ``sets`` that post shingles ``moved`` to the end since, with the next ones instead.

    Tasks get all moved shingles where these are few.  Else a set learns by its postings which of its own are
    moved, gathers them in ``common``, and may learn of more by what it posts instead.
    """
    few = moved.count() <= BROADCAST_ROWS
    known = np.sort(moved.toPandas()["key"].to_numpy(np.int64).view(np.uint64)) if few else np.zeros(0, np.uint64)
    shared = sets.sparkSession.sparkContext.broadcast((known, counted, counts))

    def run(batches):
        known, counted, counts = shared.value
        for batch in _sliced(batches):
            posted, common = [], []
            for text, own in zip(batch.column("text").cast(pa.binary()), batch.column("common")):
                all_moved = known if few else np.sort(np.array(own.as_py(), np.int64).view(np.uint64))
                keys = prefix(shingles(text.as_py()), counted, counts, all_moved)
                posted.append(keys.view(np.int64))
                common.append(keys[_among(keys, all_moved)[1]].view(np.int64) if few else own.as_py())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "t", "n")], pa.array(posted, kind), pa.array(common, kind)], ["node", "t", "n", "keys", "common"])

    changed, now = None, sets
    while True:
        ahead = now.select("node", F.explode(F.array_except("keys", "common")).alias("key")).join(moved, "key")
        hit = written(ahead.groupBy("node").agg(F.collect_list("key").alias("more")), "moved_in")
        if changed is not None and hit.isEmpty():
            return changed
        wanted = written(now.join(hit, "node").select("node", "t", "n", F.array_union("common", "more").alias("common")), "wanted")
        new = _of(texts, wanted).select("node", "t", "n", "common", "text").mapInArrow(run, "node bigint, t binary, n int, keys array<bigint>, common array<bigint>")
        new = written(new, "reposted")
        changed = now = new if changed is None else written(changed.join(new.select("node"), "node", "left_anti").unionByName(new), "changed")
        if few:
            return changed


def jaccard_links(texts: DataFrame, sets: DataFrame, counted: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Links (a, b) that connect the ``sets`` (node, t, n, keys) just as all pairs of Jaccard 0.8 do.

    A pair that a round has left first meets at a crowded posting, which both its sets post, so both post
    others in the next round: there sets that have not changed take no part.
    """
    sets, links, moved = sets.withColumn("common", F.array().cast("array<bigint>")), None, None
    for turn in range(ROUNDS):
        with scratch(texts.sparkSession) as result:
            post = _postings(sets).repartition("key")  # once for the counts and the join
            met = post.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
            post = written(post.join(met.select("key"), "key"), "postings")
            links, crowded = (result(x, "met") for x in _met_in(texts, sets, post, links, moved, turn == ROUNDS - 1))
        if crowded.isEmpty():
            break
        with scratch(texts.sparkSession) as result:
            crowded = _crowding(texts, sets, links, crowded)
            moved = result(crowded if moved is None else moved.union(crowded).distinct(), "moved")
            sets = result(_reposted(texts, sets, moved, counted, counts), "sets")
    return links


def groups(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(t, root): the group of each text that has near copies, texts by their names."""
    with small_batches(docs.sparkSession):
        return _groups(docs.select(text_hash(text_col).alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))


def _groups(texts: DataFrame) -> DataFrame:
    counted, counts = _counted(texts)

    def run(batches):
        for batch in _sliced(batches):
            bodies = [t.as_py() for t in batch.column(1).cast(pa.binary())]
            prints, found = [simhash.simhash(t) for t in bodies], [shingles(t) for t in bodies]
            own = [xxhash.xxh3_128_digest(h.tobytes(), SEED) for h in found]
            keys = [prefix(h, counted, counts).view(np.int64) for h in found]
            columns = [batch.column(0), pa.array(prints, pa.int64()), pa.array(own, pa.binary()), pa.array([len(h) for h in found], pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["t", "fp", "own", "n", "keys"])

    with scratch(texts.sparkSession) as result:
        with scratch(texts.sparkSession) as lasting:
            sketches = written(texts.mapInArrow(run, "t binary, fp bigint, own binary, n int, keys array<bigint>"), "sketches")
            sets = sketches.groupBy("own").agg(F.min(F.struct("t", "n", "keys")).alias("s")).select(F.monotonically_increasing_id().alias("node"), "own", "s.*")
            sets = lasting(sets, "sets")  # the numbers hold from here on
            rows = lasting(sketches.select("t", "own", "fp"), "names")
        prints = written(rows.groupBy("fp").agg(F.min("t").alias("t")), "prints")

        same_set = rows.select("own", F.col("t").alias("a")).join(sets.select("own", F.col("t").alias("b")), "own").select("a", "b")
        same_print = rows.select("fp", F.col("t").alias("a")).join(prints.withColumnRenamed("t", "b"), "fp").select("a", "b")
        links = same_set.union(same_print).where("a <> b").distinct()
        for found, known, key in ((jaccard_links(texts, sets.drop("own"), counted, counts), sets, "node"), (simhash.links(prints.select("fp")), prints, "fp")):
            a, b = (known.select(F.col(key).alias(x), F.col("t").alias(f"t_{x}")) for x in "ab")
            links = links.union(found.join(a, "a").join(b, "b").select("t_a", "t_b"))
        return result(components(links.toDF("a", "b")).withColumnRenamed("node", "t"), "groups")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: that of the least id, then of the least text hash.  Rows that repeat it are one row; a null id comes after all others."""
    own = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), text_hash(text_col).alias("t"))
    found = own.select("id", "t").join(groups(docs, text_col), "t", "left").select("id", "t", F.coalesce("root", "t").alias("root"))
    least = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("first"), F.count("*").alias("size"))
    kept = written(least.select(F.col("first.id").alias("kept_id"), F.col("first.t").alias("kept_t"), "size"), "kept")
    first = own.join(kept, (own["t"] == kept["kept_t"]) & own["id"].eqNullSafe(kept["kept_id"]))
    once, several = first.where("size = 1"), first.where("size > 1")
    return once.union(several.dropDuplicates(["id", "t"])).select("doc.*")
