"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes at eight positions.  Two fingerprints that differ in at most
two bits share at least six positional bytes.  A posting is named by the positions that it keeps
and by the bytes there.  The index begins with the fourteen four-position blocks of the Steiner
system S(3, 4, 8) (four positions whose numbers XOR to zero): fingerprints that share six positions
meet in three of its blocks at least, and these have all six, while chance meetings need 32 equal
bits, so that postings stay short as the table grows.

Pairs that meet are tallied: the positions kept by all postings of a pair, gathered by an
aggregation, are the positional bytes that it shares.  Pairs with the guaranteed minimum are
retained, and their bits are compared.

A posting longer than ``posting_cap`` is split by one more position, each of the others in turn, and
so on up to six positions; pairs that share six still meet, with the same tally.  Six positions that
are still crowded are split by two of the remaining four half bytes (two differing bits leave two of
them alone), and then hold 256 fingerprints at most.  So the index is one at every size, no posting
is unbounded, and no link is lost.

Defined cases: a null or wordless text has fingerprint zero and links like any other; repeated
rows and ids give a row each; a null id is kept and never names a component unless all are null;
texts of any length are hashed whole, a piece at a time; an empty table gives no rows; columns other
than the two named are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.graph import components
from docloom.llm.shared import scratch, written

#: The four-position blocks of S(3, 4, 8).
BLOCKS = [s for s in combinations(range(8), 4) if not s[0] ^ s[1] ^ s[2] ^ s[3]]
SEED = 42
#: Hashes whose bits are counted at a time.
PIECE = 1 << 18


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(positions) -> int:
    return _signed(sum(255 << 8 * p for p in positions))


#: What splits the postings of a crowded set of positions: one more position, or, from six on, two of the half bytes left.
FINER: dict[int, list[int]] = {}
for _size in (4, 5, 6):
    for _own in combinations(range(8), _size):
        _rest = [p for p in range(8) if p not in _own]
        if _size < 6:
            FINER[_mask(_own)] = [_mask((*_own, p)) for p in _rest]
        else:
            _halves = [15 << 8 * p + 4 * h for p in _rest for h in (0, 1)]
            FINER[_mask(_own)] = [_signed(_mask(_own) % (1 << 64) | x | y) for x, y in combinations(_halves, 2)]


def simhash(text: bytes, words_each: int = 3) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    n = max(1, len(words) - words_each + 1)
    starts, ends = (ends - size)[:n].tolist(), ends[len(words) - n :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, PIECE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + PIECE], ends[i : i + PIECE])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """(id, fp): the SimHash of every whole text, one row for each row of ``docs``."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint"

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([simhash(t.as_py() or b"", words_each) for t in texts], pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _posted(rows: DataFrame, masks: Column) -> DataFrame:
    """(kept, bytes, fp): each fingerprint under each of its masks, once."""
    kept = rows.select("fp", F.explode(masks).alias("kept"))
    return kept.select("kept", F.col("fp").bitwiseAND(F.col("kept")).alias("bytes"), "fp")


def meetings(nodes: DataFrame, posting_cap: int = 32) -> DataFrame:
    """(a, b, kept): pairs a > b of the distinct fingerprints ``nodes`` (fp) in each posting that both are in."""
    finer = F.create_map(*[x for k, v in FINER.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    post, met = _posted(nodes, F.array(*[F.lit(_mask(b)) for b in BLOCKS])), None
    for level in range(4):
        sizes = written(post.groupBy("kept", "bytes").agg(F.count("*").alias("n")).where("n > 1"), f"posting_sizes{level}")
        shared = written(post.join(sizes, ["kept", "bytes"]), f"postings{level}")
        short = shared if level == 3 else shared.where(F.col("n") <= posting_cap)
        a, b = (short.select("kept", "bytes", F.col("fp").alias(x)) for x in "ab")
        pairs = a.join(b, ["kept", "bytes"]).where("a > b").select("a", "b", "kept")
        met = pairs if met is None else met.union(pairs)
        crowded = shared.where(F.col("n") > posting_cap)
        if level == 3 or crowded.isEmpty():
            return met
        masks = crowded.select("fp", F.explode(F.element_at(finer, F.col("kept"))).alias("kept")).distinct()
        post = masks.select("kept", F.col("fp").bitwiseAND(F.col("kept")).alias("bytes"), "fp")


def links(nodes: DataFrame, bits: int = 2, posting_cap: int = 32) -> DataFrame:
    """Links (a, b), a > b: all pairs of the distinct fingerprints ``nodes`` (fp) within ``bits`` (at most 2) of each other."""
    if not 0 <= bits <= 2:
        raise ValueError("the index guarantees matches for at most 2 differing bits")
    tallied = meetings(nodes, posting_cap).groupBy("a", "b").agg(F.bit_or("kept").alias("shared"))
    n_shared = sum((F.shiftrightunsigned("shared", 8 * p).bitwiseAND(F.lit(255)) == 255).cast("int") for p in range(8))
    return tallied.where(n_shared >= 8 - bits).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, bits: int = 2, posting_cap: int = 32) -> DataFrame:
    """(id, fp, component): component is the least id that links reach from a row, its own included."""
    rows = written(fingerprints(docs, id_col, text_col, words_each), "fingerprints")
    with scratch(docs.sparkSession) as result:
        nodes = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
        roots = components(links(nodes.select("fp"), bits, posting_cap))
        rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = rooted.groupBy("root").agg(F.min("first").alias("component"))
        component = result(rooted.join(least, "root").select("fp", "component"), "components")
    return rows.join(component, "fp").select("id", "fp", "component")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group: that with the group's least id.  Rows that repeat it are one row; rows without an id all stay."""
    found = written(near_duplicates(docs, id_col, text_col, **options), "near_duplicates")
    kept = found.where("id = component").select("id").distinct()
    own = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    first = own.where("id is not null").join(kept, "id", "left_semi")
    if not found.where("id = component").groupBy("id", "fp").count().where("count > 1").isEmpty():
        first = first.dropDuplicates(["id", "hash"])
    return first.select("doc").union(own.where("id is null").select("doc")).select("doc.*")
