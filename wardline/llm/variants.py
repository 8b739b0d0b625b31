"""Spelling variants: words of a corpus that differ by one code point, and the common form each goes back to.

Words are runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case.  Where 31 divides the crc32 of
``<doc_id>:<run>`` one code point of the run is deleted (this plants misspellings in a clean corpus).  Of
these the vocabulary keeps what has at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences.

* Both tries of the vocabulary are numbered with integers: prefixes in code-point order, suffixes by the
  reversed words.  The words are sorted by range; each partition walks its own in order and gives new nodes
  new numbers.  Nodes that reach over the bounds of partitions take the numbers of the partition before,
  from one small row per partition.  A walk costs as much as its words are long, however long they are.
* A word stands under the pairs (prefix node, suffix node) that skip one of its positions, and under the pairs
  that meet between two positions and skip nothing.  Words under one pair are exactly: the string that prefix
  and suffix join to, and strings with one more code point there.  So equal pairs are near words, no others
  are, and a pair holds at most one word per letter of the alphabet (90) and one more.  In a run of equal letters
  only skipping the last one counts as a deletion, so two words meet under one pair only.
* Every word keeps, per pair, the number of near words and the best of them; both are added up by word.
* Forms are at least ten times as frequent as what they stand for, so chains of forms are short; they
  are followed by joins until none moves.

Defined results: NULL texts have no words; a NULL id is written as nothing before the colon.  Repeated rows
count as often as they stand there; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import landed

DELETES = 31
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is this many times as frequent.
RATIO = 10
#: Words, and characters of them, that a task adds up before it hands them on.
HELD_WORDS, HELD_CHARS = 200_000, 8_000_000
#: Characters whose rows are made at a time; characters of one partition of the sorted words.
STEP, PART = 100_000, 4_000_000

_RUN = re.compile("[a-zÀ-ÿ]+")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n: occurrences in this task, handed on whenever many are held."""

    def rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    found, chars = Counter(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            if not text.is_valid:
                continue
            start = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
            runs = Counter(_RUN.findall(text.as_buffer().to_pybytes().lower().decode()))
            for run, n in runs.items():
                size = len(run)
                if size >= LEAST_LENGTH:
                    h = zlib.crc32(run.encode(), start)
                    if h % DELETES == 0:
                        at = h % size
                        run = run[:at] + run[at + 1 :]
                        if size == LEAST_LENGTH:
                            continue
                    if run not in found:
                        chars += size
                    found[run] += n
            if len(found) >= HELD_WORDS or chars >= HELD_CHARS:
                yield rows(found)
                found, chars = Counter(), 0
    if found:
        yield rows(found)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b[: len(a)]:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:  # bisection compares slices, so long words cost no Python step per character
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the nodes of the sorted strings in the first column: of each prefix, empty one included, the number it
    got when the walk first met it.  Numbers start at 0 in each partition."""
    before, nodes, offset = "", np.zeros(0, dtype=np.int64), 0
    for batch in batches:
        strings = batch.column(0).to_pylist()
        sizes = np.cumsum([len(s) for s in strings])
        start = 0
        while start < len(strings):
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + STEP, "right")))
            found = []
            for s in strings[start:end]:
                known = min(len(nodes), _common(before, s) + 1)
                nodes = np.concatenate((nodes[:known], np.arange(offset + known, offset + len(s) + 1)))
                found.append(nodes)
                offset, before = offset + len(s) + 1, s
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))).cast(pa.list_(pa.int64()))
            part = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "_nodes"])
            start = end


def _bounds(summary: list) -> list[tuple]:
    """part, base, carry of each partition, from (part, first, last, nodes of the last, size) in order.  ``carry``
    numbers the nodes on the first string's path that the partition before has too."""
    out, base, last, nodes = [], 0, None, []
    for part, first, its_last, its_nodes, size in sorted(summary):
        carry = nodes[: _common(last, first) + 1] if last is not None else []
        out.append((part, base, carry))
        nodes = [carry[v] if v < len(carry) else v + base for v in its_nodes]
        last, base = its_last, base + size
    return out


def numbered(words: DataFrame, key: Column, name: str) -> DataFrame:
    """``words`` with the trie nodes of the prefixes of ``key`` as array ``name``: equal prefixes have equal
    numbers, different ones different numbers, and those of whole keys follow code-point order."""
    spark = words.sparkSession
    chars = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    parts = max(chars // PART + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = (
        words.select(key.alias("_key"), "*").repartitionByRange(parts, "_key").sortWithinPartitions("_key")
        .withColumn("_part", F.spark_partition_id())
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", _nodes array<bigint>"
    walked = landed(rows.mapInArrow(_walk, kinds), f"{name}-walked")
    # One row per partition: its number of nodes and the words at its ends.
    summary = walked.groupBy("_part").agg(
        F.min("_key"), F.max("_key"), F.max_by("_nodes", "_key"), F.sum(F.char_length("_key") + 1)
    ).collect()
    bounds = spark.createDataFrame(_bounds([tuple(r) for r in summary]), "_part int, _base bigint, _carry array<bigint>")
    number = F.transform("_nodes", lambda v: F.when(v < F.size("_carry"), F.get("_carry", v.cast("int"))).otherwise(v + F.col("_base")))
    return walked.join(bounds, "_part").withColumn(name, number).drop("_key", "_part", "_nodes", "_base", "_carry")


_PLACED = "prefix bigint, suffix bigint, id bigint, n bigint, whole boolean, last boolean"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node pairs of each word: ``whole`` pairs skip nothing; of the others ``last`` marks those that skip the
    last of a run of equal letters."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(words):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP, "right")))
            part = batch.slice(start, end - start)
            size, n = sizes[start:end], part.column(1).to_numpy()
            forward, backward = (part.column(i).flatten().to_numpy() for i in (2, 3))
            first = np.cumsum(size + 1) - size - 1  # of a word's nodes
            ids = forward[first + size]
            letters = np.frombuffer("".join(words[start:end]).encode("utf-32-le"), "<u4")
            word = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
            final = place == size[word] - 1
            final[:-1] |= letters[:-1] != letters[1:]
            between = np.repeat(np.arange(len(size)), size + 1)
            gap = np.arange(len(between)) - first[between]
            both = np.concatenate((word, between))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((forward[first[word] + place], forward[first[between] + gap]))),
                    pa.array(np.concatenate((backward[first[word] + size[word] - place - 1], backward[first[between] + size[between] - gap]))),
                    pa.array(ids[both]), pa.array(n[both]),
                    pa.array(np.arange(len(both)) >= len(word)), pa.array(np.concatenate((final, np.zeros(len(between), dtype=bool)))),
                ],
                [f.split()[0] for f in _PLACED.split(", ")],
            )
            start = end


def _near(placed: DataFrame) -> DataFrame:
    """id, n_near, best (n, order): of words that have near words."""
    met = placed.groupBy("prefix", "suffix").agg(F.collect_list(F.struct("id", "n", "whole", "last")).alias("met")).where(F.size("met") > 1)

    def near(x: Column) -> Column:
        others = F.filter("met", lambda y: (y["id"] != x["id"]) & F.when(x["whole"], y["last"]).when(y["whole"], x["last"]).otherwise(True))
        return F.struct(x["id"].alias("id"), F.transform(others, lambda y: F.struct(y["n"].alias("n"), (-y["id"]).alias("order"))).alias("near"))

    return (
        met.select(F.inline(F.transform("met", near))).where(F.size("near") > 0)
        .select("id", F.size("near").alias("n_near"), F.array_max("near").alias("best"))
        .groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))
    )


def _roots(moves: DataFrame) -> DataFrame:
    """id, root: where following ``moves`` (id, form) from each id ends."""
    found = landed(moves.select("id", F.col("form").alias("root")), "roots")
    onward = moves.select(F.col("id").alias("root"), F.col("form").alias("_next"))
    while True:
        step = landed(found.join(onward, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        found = step.select("id", "root")
        if step.where("_moved").isEmpty():
            return found


def grouped(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = landed(vocabulary(docs), "vocabulary")
    both = numbered(numbered(words, F.col("word"), "forward"), F.reverse("word"), "backward")
    both = landed(both.withColumn("id", F.element_at("forward", -1)), "tries")
    placed = both.select("word", "n", "forward", "backward").mapInArrow(_pairs, _PLACED)
    near = landed(_near(placed), "near-words")
    names = both.select("id", "word", "n")
    joined = landed(
        names.join(near, "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(F.col("best.n") >= RATIO * F.col("n"), -F.col("best.order")).alias("form_id"),
        ),
        "words",
    )
    moves = joined.where("form_id is not null").select("id", F.col("form_id").alias("form"))
    roots = _roots(moves)
    forms = names.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    ends = roots.join(names.select(F.col("id").alias("root"), F.col("word").alias("_root")), "root").select("id", "_root")
    return joined.join(forms, "form_id", "left").join(ends, "id", "left").select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n"
    )
