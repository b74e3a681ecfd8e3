"""Benchmark decontamination by a set of normalised test n-grams, in DataFrame functions alone.

The windows of the benchmark (``width`` consecutive words, or a shorter item's whole) are hashed
into buckets of a constant array that every task gets; its size is checked first.  A document's
word hashes are combined by doubling (2, 4, 8 and so on) to hash the window at every position, each
hash is looked up in its bucket, and the words of a hit are compared with the window itself.
No row is joined, exploded or shuffled.  A benchmark with over ``most_windows`` windows has no
constant set of them all: a bit set of their hashes thins out the documents' windows, and what is
left is joined by hash, compared word by word and gathered by text.

Defined cases: a null text has no words and no hits; null or wordless benchmark items are no
windows, an empty benchmark hits nothing; items with equal windows all count; null item ids take
no part in the list of items; repeated rows are judged alike; every window of a text counts,
whatever its length; hits and items have no order in which ties could fall; an empty table gives no
rows; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import WORD_BREAK, ascii_lower, let

#: Word characters before A-Z are lower-cased, and the other characters.
RAW, BREAK = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: The bit set of a large benchmark has 2 to this power bits at most, eight megabytes.
MOST_BITS = 26


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), WORD_BREAK), ""), F.array().cast("array<string>"))


def _powers(width: int) -> list[int]:
    """The powers of two that add up to ``width``, largest first."""
    return [1 << b for b in range(width.bit_length() - 1, -1, -1) if width >> b & 1]


def _after(size: int):
    return lambda x, i: F.xxhash64(x, F.get(F.col(f"h{size}"), i + size))


def _doubled(rows: DataFrame, most: int) -> DataFrame:
    """Adds h1, h2, h4 ... up to ``most``: the hash of the words at and after each position."""
    rows = rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    size = 1
    while size * 2 <= most:
        rows = rows.withColumn(f"h{2 * size}", F.transform(f"h{size}", _after(size)))
        size *= 2
    return rows


def _window_hash(first: Column, at: Column, width: int) -> Column:
    """The hash of the ``width`` words from position ``at``, whose largest part is ``first``."""
    parts, past = [first], _powers(width)[0]
    for p in _powers(width)[1:]:
        parts.append(F.get(F.col(f"h{p}"), at + past))
        past += p
    return F.xxhash64(*parts) if len(parts) > 1 else first


def windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(words, width, items): each different window with the sorted ids, as strings, of its items."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    rows = rows.withColumn("width", F.least(F.size("words"), F.lit(width)))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1)))
    return rows.groupBy(F.slice("words", F.col("at"), F.col("width")).alias("words"), "width").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _constant(buckets: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), kind)


def _looked_up(rows: DataFrame, known: list[tuple[list[str], list[str], int]]) -> DataFrame:
    """Adds hits: (at, width, items) of every window of ``known`` (words, items, hash) in the documents' words."""
    size = 1 << max(4, (2 * len(known)).bit_length())
    widths = sorted({len(w) for w, _, _ in known})
    by_hash: list[list[int]] = [[] for _ in range(size)]
    by_text: list[dict[str, list[str]]] = [{} for _ in range(size)]
    for words, items, code in known:
        by_hash[code & size - 1].append(code)
        by_text[code & size - 1][" ".join(words)] = items
    hashes, texts = _constant(by_hash, "array<array<bigint>>"), _constant(by_text, "array<map<string,array<string>>>")

    def slot(code: Column) -> Column:
        return code.bitwiseAND(F.lit(size - 1)).cast("int")

    def met(n: int):
        """Of the window hash that begins at a position: the position, if its bucket has the hash."""
        return lambda x, i: let(_window_hash(x, i, n), lambda code: F.when(F.array_contains(F.get(hashes, slot(code)), code), i))

    def compared(n: int):
        first = F.col(f"h{_powers(n)[0]}")

        def one(i: Column) -> Column:
            bucket = F.get(texts, slot(_window_hash(F.get(first, i), i, n)))
            items = F.try_element_at(bucket, F.array_join(F.slice("words", i + 1, n), " "))
            return F.struct(i.alias("at"), F.lit(n).alias("width"), items.alias("items"))

        return one

    rows = _doubled(rows, max(widths))
    for n in widths:
        rows = rows.withColumn(f"met{n}", F.array_compact(F.transform(f"h{_powers(n)[0]}", met(n))))
    for n in widths:
        rows = rows.withColumn(f"met{n}", F.filter(F.transform(f"met{n}", compared(n)), lambda m: m["items"].isNotNull()))
    return rows.withColumn("hits", F.concat(*[F.col(f"met{n}") for n in widths]))


def _filter_of(coded: DataFrame, n: int) -> tuple[Column, int]:
    """(words, mask): a bit set that has the hashes of ``coded``, sixteen bits for each of ``n`` but MOST_BITS at most, as a constant."""
    size = 1 << min(MOST_BITS, max(10, (16 * n).bit_length()))
    bit = F.col("hash").bitwiseAND(F.lit(size - 1))
    word = coded.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    words = [0] * (size >> 6)
    for r in word.collect():
        words[r["at"]] = r["bits"]
    return _constant(words, "array<bigint>"), size - 1


def _joined(rows: DataFrame, known: DataFrame, n: int, widths: list[int]) -> DataFrame:
    """The same by a join on the hash of every window that a bit set lets through.

    A text is named by its SHA-256, which no shuffle changes; equal texts share their hits.
    """
    kind = "array<struct<at:int,width:int,items:array<string>>>"
    rows = _doubled(rows.withColumn("named", F.sha2("text", 256)), max(widths))
    bits, mask = _filter_of(known, n)

    def window(n: int):
        return lambda x, i: F.struct(i.alias("at"), F.lit(n).alias("width"), _window_hash(x, i, n).alias("hash"))

    def may_hit(w: Column) -> Column:
        bit = w["hash"].bitwiseAND(F.lit(mask))
        word = F.get(bits, F.shiftright(bit, 6).cast("int"))
        return (w["at"] + w["width"] <= F.size("words")) & (F.getbit(word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1)

    every = [F.transform(f"h{_powers(n)[0]}", window(n)) for n in widths]
    spots = rows.select("named", "words", F.explode(F.filter(F.concat(*every), may_hit)).alias("w"))
    spots = spots.select("named", "w.at", "w.width", "w.hash", F.slice("words", F.col("w.at") + 1, F.col("w.width")).alias("words"))
    found = spots.join(known, ["hash", "width", "words"]).groupBy("named").agg(F.collect_set(F.struct("at", "width", "items")).alias("hits"))
    return rows.join(found, "named", "left").withColumn("hits", F.coalesce("hits", F.array().cast(kind)))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", benchmark_text: str = "text", width: int = 10, most_windows: int = 50_000) -> DataFrame:
    """(doc, words, hit_words, items) for each row: doc holds the row's own columns, hit_words the positions of words in hits."""
    known = windows(benchmark, item_col, benchmark_text, width)
    rows = docs.select(F.struct("*").alias("doc"), words_of(F.col(text_col)).alias("words"))
    n, widths = known.agg(F.count("*"), F.collect_set("width")).first()
    if not n:
        return rows.select("doc", "words", F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<string>").alias("items"))
    coded = _doubled(known, max(widths))
    whole = F.coalesce(*[F.when(F.col("width") == m, _window_hash(F.get(F.col(f"h{_powers(m)[0]}"), F.lit(0)), F.lit(0), m)) for m in widths])
    coded = coded.withColumn("hash", whole).select("hash", "width", "words", "items")
    if n <= most_windows:
        rows = _looked_up(rows, [(r.words, r["items"], r.hash) for r in coded.collect()])
    else:
        rows = _joined(rows.withColumn("text", F.col("doc")[text_col]), coded, n, sorted(widths))
    any_hit = F.size("hits") > 0
    spots = F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["width"] - 1)))
    return rows.select(
        "doc",
        "words",
        F.when(any_hit, F.array_distinct(spots)).otherwise(F.array().cast("array<int>")).alias("hit_words"),
        F.when(any_hit, F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))).otherwise(F.array().cast("array<string>")).alias("items"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", remove: str = "documents", **options) -> DataFrame:
    """``docs`` without the documents that have hits, or (``remove="spans"``) without the words hit and what follows each up to the next word."""
    found = contamination(docs, benchmark, text_col, **options)
    if remove == "documents":
        clean = F.when(F.size("hit_words") == 0, F.array("doc"))  # a filter would be moved below the windows and compute them anew
        return found.select(F.explode(clean).alias("doc")).select("doc.*")
    if remove != "spans":
        raise ValueError('remove is "documents" or "spans"')
    text = F.col("doc")[text_col]
    pieces = F.regexp_extract_all(text, F.lit(f"{RAW}+{BREAK}*"), 0)
    lead = F.regexp_extract(text, f"^{BREAK}*", 0)
    rest = F.concat(lead, F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains("hit_words", i)), ""))
    clean = F.when(F.size("hit_words") > 0, rest).otherwise(text)
    return found.select(*[clean.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
