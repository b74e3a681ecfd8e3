"""Batches of questions against a vector table: filtered, tiered top-k, de-duplication and ranking.

A chunk table has (id, vector, authority_level, doc_family, instrument, jurisdiction,
effective_date); a question table has (query_id, vector) and, for tiers, the query profile.  Each
question's filter is worked out once for each two kinds of profiles and chunks, tiles of vectors are
multiplied in each task, and only the best rows of a question leave it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import rules
from docloom.operators.crawl import saved
from docloom.operators.scans import stretches

#: Bytes and rows of a block of questions at most.
BLOCK_BYTES, BLOCK_ROWS = 64 << 20, 4096
#: Chunks that meet a block in one task, about, and the parts that chunks are dealt to at least.
CELL_ROWS, LEAST_CELLS = 32_768, 32
#: Chunks that are scored at a time, pairs whose scores are computed anew at a time, and rows that leave a task at a time.
TILE, PAIRS, ROWS_OUT = 1024, 16_384, 10_000


def compiled(filter: Mapping | None, schema_arrays: Sequence[str] = ()) -> Column:
    """A metadata filter of $eq, $in and $and as a condition; no filter holds for every row."""
    if not filter:
        return F.lit(True)
    tests = []
    for name, spec in filter.items():
        if name == "$and":
            tests += [compiled(f, schema_arrays) for f in spec]
            continue
        values = spec["$in"] if "$in" in spec else [spec["$eq"]]
        test = F.arrays_overlap(F.col(name), F.array(*map(F.lit, values))) if name in schema_arrays else F.col(name).isin(*values)
        tests.append(F.coalesce(test, F.lit(False)))
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if the lengths differ or one is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def with_norms(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """Adds ``norm``, so that pairs need one product each."""
    return rows.withColumn("norm", F.sqrt(dot(F.col(vector), F.col(vector))))


def question_blocks(queries: DataFrame, vector: str = "vector") -> int:
    """How many blocks of ``BLOCK_BYTES`` and ``BLOCK_ROWS`` at most the questions make; their number and largest vector are looked up once."""
    n, dims = queries.agg(F.count("*"), F.max(F.size(vector))).first()
    return max(1, -(-n // BLOCK_ROWS), -(-n * (8 * (dims or 0) + 1024) // BLOCK_BYTES))


def _vectors(column: pa.Array) -> np.ndarray:
    """The rows of an array of equally long lists."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _cosines(a: np.ndarray, b: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The cosines of the rows of two arrays, added up from the first component on, so that they do not depend on what else is in the arrays."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        total += x * y
    return total / norms


class _Asked:
    """The questions of a block that have vectors of one length, and the best chunks of each and its tiers so far.

    Scores of whole tiles come from products of matrices, whose last bits depend on the tile; they only tell which
    pairs can be among the best, and these are computed anew.
    """

    def __init__(self, rows: np.ndarray, asks: list[str], vectors: np.ndarray, norms: np.ndarray):
        self.rows, self.vectors, self.norms = rows, vectors, norms
        #: What the last bits of a cosine and of its two norms can amount to.
        self.slack = 8 * (vectors.shape[1] + 8) * np.finfo(float).eps
        self.members = {ask: np.flatnonzero(np.array(asks) == ask) for ask in dict.fromkeys(asks)}
        self.best: dict[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _plain(norms: np.ndarray) -> np.ndarray:
        """Norms whose products neither overflow nor lose digits; pairs of others are computed one by one."""
        return (norms > 1e-100) & (norms < 1e100)

    def meet(self, at: np.ndarray, has: list[str], vectors: np.ndarray, norms: np.ndarray, admitted: dict[str, dict[str, set[str]]], sizes: Mapping[str, int], rest: int) -> None:
        """Takes in the chunks ``at``, in order of their ids; ``admitted`` has the kinds of chunks that each tier of each question takes."""
        kinds, kind = np.unique(has, return_inverse=True)
        for ask, members in self.members.items():
            takes = {tier: np.array([x in of for x in kinds.tolist()])[kind] for tier, of in admitted.get(ask, {}).items()}
            some = np.flatnonzero(np.any(list(takes.values()), axis=0)) if takes else np.zeros(0, int)
            if not len(some):
                continue
            with np.errstate(all="ignore"):
                rough = (self.vectors[members] @ vectors[some].T) / (self.norms[members, None] * norms[some])
            rough[~self._plain(self.norms[members])] = np.nan
            rough[:, ~self._plain(norms[some])] = np.nan
            for tier, fit in takes.items():
                among = np.flatnonzero(fit[some])
                if len(among):
                    self._keep(ask, tier, sizes.get(tier, rest), members, rough if len(among) == len(some) else rough[:, among], at, some[among], vectors, norms)

    def _keep(self, ask: str, tier: str, k: int, members: np.ndarray, rough: np.ndarray, at: np.ndarray, some: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        """Merges the chunks ``some``, whose rough scores are given, into the best ``k`` of the questions ``members``."""
        held = self.best.get((ask, tier), (np.zeros(0, int), np.zeros(0, int), np.zeros(0)))
        least = np.full(len(members), -np.inf)
        last = np.flatnonzero(np.bincount(held[0], minlength=len(members)) == k)
        if len(last):
            # What is held is in order of question and place.
            ends = np.searchsorted(held[0], last, side="right") - 1
            least[last] = np.where(np.isnan(held[2][ends]), np.inf, held[2][ends])
        unsure = np.isnan(rough)
        if len(last) < len(members) and rough.shape[1] > k:
            least = np.maximum(least, np.partition(np.where(unsure, -np.inf, rough), -k, axis=1)[:, -k] - self.slack)
        r, c = np.nonzero(unsure | (rough >= least[:, None] - self.slack))
        if not len(r):
            return
        exact = np.empty(len(r))
        with np.errstate(all="ignore"):
            for i in range(0, len(r), PAIRS):
                q, x = members[r[i : i + PAIRS]], some[c[i : i + PAIRS]]
                exact[i : i + PAIRS] = _cosines(self.vectors[q], vectors[x], self.norms[q] * norms[x])
        r, c, score = np.concatenate([held[0], r]), np.concatenate([held[1], at[some[c]]]), np.concatenate([held[2], exact])
        order = np.lexsort((c, np.where(np.isnan(score), -np.inf, -score), r))  # not-a-number is the largest
        r, c, score = r[order], c[order], score[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        self.best[ask, tier] = r[first], c[first], score[first]

    def found(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """(tier, places of questions, places of chunks, scores)."""
        for (ask, tier), (r, c, score) in self.best.items():
            yield tier, self.rows[self.members[ask][r]], c, score


def _answers(batches: Iterable[pa.RecordBatch], sizes: Mapping[str, int], rest: int) -> Iterator[pa.RecordBatch]:
    """The best rows of each cell, whose rows come by kind: what fits what, the questions, then the chunks in order of ids."""
    cell: int | None = None
    admitted: dict[str, dict[str, set[str]]] = {}
    asked: list[pa.RecordBatch] = []
    groups: dict[int, _Asked] | None = None
    held: list[pa.Array] = []
    n = 0

    def by_length(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch | pa.Table]]:
        lengths = np.asarray(pc.list_value_length(rows.column("vector")))
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            yield length, at, rows.take(pa.array(at))

    def closed() -> Iterator[pa.RecordBatch]:
        if not groups or not n:
            return
        questions, chunks = pa.concat_arrays([x.column("q") for x in asked]), pa.concat_arrays(held)
        for tier, q, c, score in (found for group in groups.values() for found in group.found()):
            for i in range(0, len(q), ROWS_OUT):
                s = slice(i, i + ROWS_OUT)
                yield pa.RecordBatch.from_arrays([questions.take(pa.array(q[s])), chunks.take(pa.array(c[s])), pa.array([tier] * len(q[s]), pa.string()), pa.array(score[s])], ["q", "c", "tier", "score"])

    for batch in batches:
        for a, b in stretches(batch.column("key")):
            part = batch.slice(a, b - a)
            to, kind = divmod(part.column("key")[0].as_py(), 3)
            if to != cell:
                yield from closed()
                cell, admitted, asked, groups, held, n = to, {}, [], None, [], 0
            if kind == 0:
                for ask, has, tiers in zip(*(part.column(c).to_pylist() for c in ("ask", "has", "tiers"))):
                    for tier in tiers:
                        admitted.setdefault(ask, {}).setdefault(tier, set()).add(has)
            elif kind == 1:
                asked.append(part)
            else:
                if groups is None:
                    rows = pa.Table.from_batches(asked).combine_chunks() if asked else None
                    groups = {d: _Asked(at, own.column("ask").to_pylist(), _vectors(own.column("vector").combine_chunks()), own.column("norm").to_numpy()) for d, at, own in by_length(rows)} if rows else {}
                for i in range(0, len(part), TILE):
                    tile = part.slice(i, TILE)
                    for length, at, own in by_length(tile):
                        if length in groups:
                            groups[length].meet(n + at, own.column("has").to_pylist(), _vectors(own.column("vector")), own.column("norm").to_numpy(), admitted, sizes, rest)
                    held.append(tile.column("c"))
                    n += len(tile)
    yield from closed()


def _nearest(queries: DataFrame, chunks: DataFrame, tiers: Column, sizes: Mapping[str, int], rest: int, asks: Sequence[str], has: Sequence[str], blocks: int | None = None) -> DataFrame:
    """(question and chunk columns, tier, score, position): the most similar chunks of each question in each of its tiers, ties by id.

    ``tiers`` is an array of names, of which those without a size have ``rest``, told by the columns ``asks`` of questions and ``has`` of chunks alone, so that it is
    worked out once for each two kinds of them.  Blocks of questions meet parts of the chunks in cells, whose tasks hold one block, one
    tile of chunks and the best rows so far; neither side is sent whole to any task.
    """
    blocks = question_blocks(queries) if blocks is None else blocks
    cells = max(LEAST_CELLS, -(-chunks.count() // CELL_ROWS))
    kind = lambda names: F.to_json(F.struct(*names)) if names else F.lit("")
    own = lambda df: F.struct(*[c for c in df.columns if c != "vector"])
    each = lambda n, key: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: key(x).cast("bigint"))).alias("key")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    q = with_norms(queries).select(own(queries).alias("q"), kind(asks).alias("ask"), F.col("vector").cast("array<double>").alias("vector"), "norm", part("query_id", blocks).alias("block")).where("norm > 0")
    c = with_norms(chunks).select(own(chunks).alias("c"), kind(has).alias("has"), "id", F.col("vector").cast("array<double>").alias("vector"), "norm", part("id", cells).alias("cell")).where("norm > 0")
    a, b = queries.select(kind(asks).alias("ask"), *asks).dropDuplicates(["ask"]), chunks.select(kind(has).alias("has"), *has).dropDuplicates(["has"])
    fits = a.crossJoin(b).select("ask", "has", tiers.alias("tiers")).where(F.size("tiers") > 0)

    fits = fits.select("*", each(blocks * cells, lambda x: x * 3))
    q = q.select("q", "ask", "vector", "norm", each(cells, lambda x: (F.col("block") * cells + x) * 3 + 1))
    c = c.select("c", "has", "id", "vector", "norm", each(blocks, lambda x: (x * cells + F.col("cell")) * 3 + 2))
    rows = c.unionByName(q, allowMissingColumns=True).unionByName(fits, allowMissingColumns=True)
    dealt = rows.repartition(blocks * cells, F.expr("key div 3")).sortWithinPartitions("key", "id")
    schema = T.StructType([dealt.schema["q"], dealt.schema["c"], T.StructField("tier", T.StringType()), T.StructField("score", T.DoubleType())])
    sizes = dict(sizes)
    found = dealt.mapInArrow(lambda batches: _answers(batches, sizes, rest), schema).select("q.*", "c.*", "tier", "score")
    order = Window.partitionBy("query_id", "tier").orderBy(F.desc("score"), "id")
    size = F.lit(rest)
    for t, k in sizes.items():
        size = F.when(F.col("tier") == t, k).otherwise(size)
    # The cut by a constant is what Spark makes in each task.
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= max(rest, *sizes.values(), 0)).where(F.col("position") <= size)


def top_k(queries: DataFrame, chunks: DataFrame, k: int, minimum: float | None = None, blocks: int | None = None) -> DataFrame:
    """(query columns, chunk columns, score, position): the ``k`` most similar chunks of each question, ties by id."""
    best = _nearest(queries, chunks, F.array(F.lit("")), {}, k, [], [], blocks).drop("tier")
    return best if minimum is None else best.where(F.col("score") >= minimum)


def tier_sizes(k: int) -> tuple[int, int]:
    """How many binding and guidance sources a question gets."""
    k = max(1, min(16, k))
    binding = -(-k // 2)
    return max(1, min(12, binding)), max(1, min(12, max(1, k - binding)))


def shared_fit() -> Column:
    """A chunk fits a question's family, instruments and, beyond federal matters, jurisdiction."""
    family = (F.col("profile.doc_family") == "") | (F.col("doc_family") == F.col("profile.doc_family"))
    instrument = (F.size("profile.instruments") == 0) | F.array_contains("profile.instruments", F.col("instrument"))
    place = (F.col("profile.jurisdiction") == "federal") | (F.col("jurisdiction") == F.col("profile.jurisdiction"))
    return family & instrument & place


def tier_levels(tier: str) -> Column:
    """The authority levels that a tier admits for a question's mode."""
    lits = lambda levels: F.array(*map(F.lit, levels))
    mode = F.col("profile.mode")
    if tier == "binding":
        return F.when(mode == "reference", lits(rules.REFERENCE)).when(mode == "provincial", lits(rules.PROVINCIAL)).when(mode == "case_law", lits(rules.CASE_LAW)).otherwise(lits(rules.BINDING))
    guidance = F.when(mode == "provincial", lits(rules.PROVINCIAL + rules.GUIDANCE)).when(mode == "case_law", lits(rules.CASE_LAW)).when(mode == "reference", lits(rules.GUIDANCE))
    return guidance.when(F.col("profile.case_law_requested"), lits(rules.GUIDANCE + rules.CASE_LAW)).otherwise(lits(rules.GUIDANCE))


def tiered(queries: DataFrame, chunks: DataFrame, k: int = 8, fallback: bool = False, blocks: int | None = None) -> DataFrame:
    """(query_id, id, ..., score, tier, position): binding sources, then guidance, then two families to compare.

    A pair is scored once and ranked in each tier it fits, all in one pass.  With ``fallback``,
    questions whose filter finds nothing in a tier are asked again without it, for that tier.
    """
    sizes = dict(zip(("binding", "guidance"), tier_sizes(k)))
    blocks = question_blocks(queries) if blocks is None else blocks
    in_tier = {tier: shared_fit() & F.array_contains(tier_levels(tier), F.col("authority_level")) for tier in sizes}
    families = F.col("profile.compare_families")
    in_tier["guidance"] = in_tier["guidance"] & ((F.size(families) < 2) | F.array_contains(families, F.col("doc_family")))
    fits = [F.when(F.coalesce(test, F.lit(False)), tier) for tier, test in in_tier.items()]
    compares = (F.size(families) > 1) & F.col("profile.compare_requested")
    for place in (0, 1):
        family = F.get(families, F.lit(place))
        fits.append(F.when(F.coalesce(compares & (F.col("doc_family") == family), F.lit(False)), F.concat(F.lit("compare_"), family)))
    tiers = F.array_compact(F.array(*fits))
    found = _nearest(queries, chunks, tiers, sizes, sizes["guidance"], ["profile"], ["doc_family", "authority_level", "instrument", "jurisdiction"], blocks)
    if not fallback:
        return found
    found = saved(found)
    asked = queries.withColumn("tier", F.explode(F.array(*map(F.lit, sizes))))
    unanswered = asked.join(found.select("query_id", "tier").distinct(), ["query_id", "tier"], "left_anti")
    again = unanswered.groupBy("query_id").agg(F.sort_array(F.collect_set("tier")).alias("tiers"))
    again = _nearest(saved(queries.join(again, "query_id")), chunks, F.col("tiers"), sizes, 0, ["tiers"], [], blocks).drop("tiers")
    return found.unionByName(again.select(*found.columns))


def tier_order() -> Column:
    return F.when(F.col("tier") == "binding", 0).when(F.col("tier") == "guidance", 1).otherwise(2)


def source_key(id: Column, title: Column, url: Column) -> Column:
    """What sources are told apart by: the id, else title and address together."""
    text = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit(""))
    return F.coalesce(F.nullif(text(id), F.lit("")), F.concat(text(title), F.lit("|"), text(url)))


def deduplicated(sources: DataFrame, key: Column | None = None) -> DataFrame:
    """The first of each question's sources by id, or by another key, in tier order."""
    own = sources.select(F.struct("*").alias("own"), "query_id", (F.col("id") if key is None else key).alias("key"), tier_order().alias("place"), "tier", "position")
    first = Window.partitionBy("query_id", "key").orderBy("place", "tier", "position")
    return own.withColumn("n", F.row_number().over(first)).where("n = 1").select("own.*")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``: by score, authority, date (newest first, undated last) and id."""
    authority = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, a in enumerate(rules.AUTHORITY_RANK, 1) for x in (a, i)]), F.col("authority_level")), F.lit(99))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("score", F.lit(-1.0))), authority, F.desc(F.coalesce("effective_date", F.lit(""))), "id", tier_order(), "position")
    return sources.withColumn("rank", F.row_number().over(order))


def counts_by(sources: DataFrame, column: str) -> DataFrame:
    """(query_id, key, n) of the values that are not empty."""
    return sources.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy("query_id", F.col(column).alias("key")).agg(F.count("*").alias("n"))


def summary(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """Per question: its ten best ids, the number of binding sources, and whether binding law is missing."""
    binding = F.count_if((F.col("tier") == "binding") & F.col("authority_level").isin(*rules.BINDING))
    best = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "id"))), 1, 10), lambda x: x["id"])
    got = ranked(sources).groupBy("query_id").agg(F.count("*").alias("n_sources"), binding.alias("n_binding"), best.alias("top_ids"))
    out = queries.select("query_id", "profile").join(got, "query_id", "left").fillna(0, ["n_sources", "n_binding"])
    return out.select("query_id", "n_sources", "n_binding", F.coalesce("top_ids", F.array().cast("array<bigint>")).alias("top_ids"), (F.col("profile.requires_binding") & (F.col("n_binding") == 0)).alias("no_binding_found"))


#: A number for each letter or digit that words have, and one for all other bytes.
LETTERS = np.full(256, 36, np.int32)
LETTERS[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = np.arange(36)


def grams(text: bytes) -> np.ndarray:
    """The different runs of three letters or digits of a text in lower case, as numbers."""
    x = LETTERS[np.frombuffer(text, np.uint8)]
    a, b, c = x[:-2], x[1:-1], x[2:]
    has = np.zeros(36**3, bool)
    has[(a * 1296 + b * 36 + c)[np.maximum(np.maximum(a, b), c) < 36]] = True
    return np.flatnonzero(has).astype(np.int32)


def _grams_of(low: Column) -> Column:
    @F.arrow_udf("array<int>")
    def each(texts: pa.Array) -> pa.Array:
        found = [grams(t.as_py() or b"") for t in texts.cast(pa.binary())]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))

    return each(low)


def lexical_rank(queries: DataFrame, chunks: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, owner, chunk_index, score, position): chunks by the share of a question's words they contain.

    Words of three letters or digits at least count as often as they occur, substrings are hits,
    the whole phrase adds a quarter, and chunks without a hit stay.  Questions meet the chunks of
    their own ``owner`` only, in which ``chunk_index`` tells chunks apart.

    Words are found by an index of three-character strings: a word is listed under the one of its own that the
    fewest of its owner's chunks contain, a chunk is looked up by its strings and the words met are verified in its
    text, so a pair that shares no such string is never made.  What has no hit has score 0, whatever it says: it fills up in
    order of ``chunk_index``, and the first 2 k chunks of an owner are enough for that.
    """
    k = max(1, min(12, k))
    words = F.filter(F.split(F.lower("query"), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    asked = queries.select("query_id", "owner", F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    texts = chunks.where(F.trim("text") != "").select("owner", "chunk_index", F.lower("text").alias("low"))
    terms = asked.select("owner", F.explode("words").alias("word")).distinct()
    of_terms = saved(terms.select("owner", "word", F.explode(_grams_of(F.col("word"))).alias("gram")))
    # Cheaper to make again than to keep: it is many times the texts.
    posted = texts.select("owner", "chunk_index", _grams_of(F.col("low")).alias("grams")).select("owner", "chunk_index", F.explode_outer("grams").alias("gram")).where("gram IS NOT NULL")
    sizes = posted.groupBy("owner", "gram").agg(F.count("*").alias("n"))
    listed = of_terms.join(sizes, ["owner", "gram"], "left").groupBy("owner", "word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("by"))
    listed = saved(listed.where("by.n > 0").select("owner", "word", "by.gram"))  # a word with a string that no chunk has is in none

    met = posted.join(listed, ["owner", "gram"]).groupBy("owner", "chunk_index").agg(F.collect_list("word").alias("met"))
    found = texts.join(met, ["owner", "chunk_index"]).withColumn("met", F.filter("met", lambda w: F.contains("low", w))).where("size(met) > 0")
    found = saved(found)
    counts = asked.select("query_id", "owner", F.explode("words").alias("word")).groupBy("query_id", "owner", "word").agg(F.count("*").alias("times"))
    hits = found.select("owner", "chunk_index", F.explode("met").alias("word")).join(counts, ["owner", "word"])
    hits = hits.groupBy("query_id", "owner", "chunk_index").agg(F.sum("times").alias("hits"))
    whole = asked.select("query_id", "owner", F.size("words").alias("n"), F.array_join("words", " ").alias("phrase"))
    hits = hits.join(whole, ["query_id", "owner"])

    # Only a chunk with all words can have the phrase, so few texts are looked at again.
    full = hits.where("hits = n").join(found.select("owner", "chunk_index", "low"), ["owner", "chunk_index"]).where(F.contains("low", F.col("phrase"))).select("query_id", "owner", "chunk_index", F.lit(0.25).alias("bonus"))
    scored = hits.join(full, ["query_id", "owner", "chunk_index"], "left").select("query_id", "owner", "chunk_index", F.least(F.lit(1.0), F.col("hits") / F.col("n") + F.coalesce("bonus", F.lit(0.0))).alias("score"))
    scored = saved(scored)

    place = Window.partitionBy("owner").orderBy("chunk_index")
    first = texts.select("owner", "chunk_index").withColumn("place", F.row_number().over(place)).where(F.col("place") <= 2 * k).select("owner", "chunk_index")
    rest = asked.select("query_id", "owner").join(first, "owner").join(scored, ["query_id", "owner", "chunk_index"], "left_anti").withColumn("score", F.lit(0.0))
    order = Window.partitionBy("query_id", "owner").orderBy(F.desc("score"), "chunk_index")
    return scored.unionByName(rest).withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A stand-in for an embedding service: signed counts of hashed words, of unit length."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    spots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dims)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: (F.size(F.filter(spots, lambda s: s == d)) - F.size(F.filter(spots, lambda s: s == d + dims))).cast("double"))
    size = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(size > 0, x / size).otherwise(0.0))


def prompts(sources: DataFrame, titles: str = "title", texts: str = "text") -> DataFrame:
    """(query_id, prompt, prompt_hash): numbered sources, P first, then C for cases and D for documents."""
    letter = F.when(F.col("source_type") == "a2aj_case", "C").when(F.col("source_type") == "user_document", "D").otherwise("P")
    w = Window.partitionBy("query_id", "letter").orderBy("rank")
    numbered = sources.withColumn("letter", letter).withColumn("n", F.row_number().over(w))
    line = F.concat(F.lit("["), F.col("letter"), F.col("n").cast("string"), F.lit("] "), F.col(titles), F.lit("\n"), F.col(texts))
    order = F.when(F.col("letter") == "P", 0).when(F.col("letter") == "C", 1).otherwise(2)
    got = numbered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "n", line.alias("line")))).alias("lines"))
    prompt = F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")
    return got.select("query_id", prompt.alias("prompt"), F.sha2(prompt, 256).alias("prompt_hash"))
