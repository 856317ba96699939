"""Which texts hold which passages, by a join on hashes of windows.

Wherever a text holds a passage, it holds the words inside the passage, those with white space
on both sides, as words in a row. A passage with such words is known by one or two of them; a
shorter one by a window of 1 to 32 characters. Passages are thus in a few length classes. For
each class that occurs, the texts are cut into all their windows of that length, text and passage
meet where the hashes of their windows agree, and ``contains`` decides. Two words are plain rows
of the scan, which cost far less than hashes of longer windows; ``contains`` drops the few texts
more that they let through. For characters, long texts are cut into pieces that overlap by a window.

A passage takes the window that the fewest passages share and of these the longest, so passages
with a common beginning do not meet the texts that have only that, and few texts have it by chance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.scale import broadcast_if_small
from ledgerlight.session import durable

WORDS = 2  # most words in a window
CHARS = 32  # most characters in a window
PIECE = 65_536  # characters of a piece


def _windows(rows: DataFrame, text: str, by_words: bool, width: int, piece: int) -> DataFrame:
    """``rows`` without ``text``, with hash and length of each of its windows; one that occurs again may come again."""
    kept = [name for name in rows.columns if name != text]
    if by_words:
        words = rows.select(*kept, F.split(text, r"\s+").alias("a"))
        if width == 1:
            each = words.select(*kept, F.explode(F.array_distinct("a")).alias("a"))
            return each.select(*kept, F.xxhash64("a").alias("mark"), F.length("a").alias("size"))
        pairs = words.select(*kept, F.inline(F.arrays_zip("a", F.slice("a", F.lit(2), F.size("a")).alias("b"))).alias("a", "b")).where("b IS NOT NULL")
        return pairs.select(*kept, F.xxhash64("a", "b").alias("mark"), (F.length("a") + F.length("b")).alias("size"))
    cut = rows.select(*kept, F.explode(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{piece + width - 1}}})).{{1,{piece}}}"), F.lit(1))).alias("unit"))
    each = F.array_distinct(F.regexp_extract_all("unit", F.lit(rf"(?s)(?=(.{{{width}}}))"), F.lit(1)))
    return cut.select(*kept, F.explode(each).alias("a")).select(*kept, F.xxhash64("a").alias("mark"), F.lit(width).alias("size"))


def _classed(passages: DataFrame) -> DataFrame:
    """Passages with the kind and width of their windows and the part that windows are taken from."""
    inner = F.regexp_extract("passage", r"(?s)\s(\S.*\S|\S)\s", 1)
    words = F.size(F.filter(F.split(inner, r"\s+"), lambda w: w != ""))
    by_words = words > 0

    def power(n: Column, most: int) -> Column:
        return F.least(F.lit(most), F.pow(F.lit(2), F.floor(F.log2(n))).cast("int"))

    return passages.select(
        "passage", by_words.alias("by_words"), F.when(by_words, power(words, WORDS)).otherwise(power(F.length("passage"), CHARS)).alias("width"),
        F.when(by_words, inner).otherwise(F.col("passage")).alias("part"),
    )


def _anchors(wanted: DataFrame, by_words: bool, width: int) -> DataFrame:
    """One window hash for each distinct passage of a class: the one that fewest share, then the longest."""
    hashes = _windows(wanted.select("passage", "part"), "part", by_words, width, PIECE).distinct()
    shared = hashes.groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    rarest = hashes.join(shared, "mark").groupBy("passage").agg(F.min(F.struct("n", (-F.col("size")).alias("short"), "mark")).alias("least"))
    return rarest.select("passage", F.col("least.mark").alias("mark"))


def passages_in(docs: DataFrame, passages: DataFrame, piece: int = PIECE) -> DataFrame:
    """``(question_id, entry)`` for every entry whose text holds the passage verbatim.

    docs: entry, text. passages: question_id, passage. A missing passage or text meets nothing.
    An empty passage is in every text, which ``everywhere`` tells as a number instead of rows.
    Repeated rows of either side give repeated pairs.
    """
    given = passages.where(F.length("passage") > 0).select("question_id", "passage")
    wanted = durable(_classed(given.select("passage").distinct()))
    classes = sorted(map(tuple, wanted.select("by_words", "width").distinct().collect()))  # ten at most
    texts = docs.where(F.length("text") > 0).select("entry", "text").withColumn("row", F.xxhash64("text"))
    found = []
    for by_words, width in classes:
        anchors = _anchors(wanted.where((F.col("by_words") == by_words) & (F.col("width") == width)), by_words, width)
        marks = _windows(texts.select("row", "text"), "text", by_words, width, piece)
        found.append(marks.join(broadcast_if_small(anchors), "mark").select("row", "passage").distinct())
    if not found:
        return given.select("question_id", F.lit(None).cast(dict(docs.dtypes)["entry"]).alias("entry")).limit(0)
    near = broadcast_if_small(reduce(DataFrame.unionByName, found))
    holds = texts.join(near, "row").where(F.contains("text", "passage")).select("entry", "passage")
    return given.join(holds, "passage").select("question_id", "entry")


def everywhere(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``(question_id, n_entries)`` of the empty passages: the number of entries that have a text."""
    n = docs.agg(F.count("text")).scalar()
    return passages.where(F.length("passage") == 0).select("question_id", n.alias("n_entries"))
