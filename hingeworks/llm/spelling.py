"""Grouping of spelling variants: each word's most frequent neighbour at one inserted, deleted or replaced code point.

A word that is one error from another agrees with it exactly in its first half, or in its second half. So the words are
kept twice, as they are and reversed, each time as shards of a sorted order; a word asks the shards in which its first
half (reversed: its second half) may begin a word. A shard is a minimal acyclic automaton whose states count the words
below them, so that a path spells a word and its number in the shard; the rest of the word is completed with one error.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hingeworks.llm.common import cut, cuts_so_far, drop_cut, drop_cuts_since, shuffle_width

#: Latin letters; runs of at least five, since shorter words take no part.
LETTERS, LEAST_CHARS, LEAST_COUNT = r"[A-Za-zÀ-ÿ]", 5, 3
#: An occurrence loses a code point if this divides its digest.
TYPO_EVERY = 97
#: Code points of a shard's words, about; code points of a shard's first word that its bound keeps.
SHARD_CHARS, BOUND_CHARS = 200_000, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; a word's number is its place among them.

    arcs[state][c] is (target, words of this state that come before those through c); final[state] tells whether a word
    ends there. Equal states are one, so shared beginnings and endings are kept once.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._count: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[list] = [[False, {}]]  # open states along the last word
        last = ""
        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            while len(path) > same + 1:
                self._close(path, last)
            path.extend([False, {}] for _ in word[same:])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            self._close(path, last)
        self.start = self._state(*path[0])
        self._known.clear()

    def _close(self, path: list[list], last: str) -> None:
        final, targets = path.pop()
        path[-1][1][last[len(path) - 1]] = self._state(final, targets)

    def _state(self, final: bool, targets: dict[str, int]) -> int:
        key = (final, *targets.items())
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.arcs)
            arcs, before = {}, int(final)
            for c, t in targets.items():
                arcs[c] = (t, before)
                before += self._count[t]
            self.arcs.append(arcs)
            self.final.append(final)
            self._count.append(before)
        return found

    def _rest(self, state: int, number: int, word: str, i: int) -> int:
        """The number of the word that ends when word[i:] is read from a state, or -1."""
        arcs = self.arcs
        for c in word[i:]:
            step = arcs[state].get(c)
            if step is None:
                return -1
            state, number = step[0], number + step[1]
        return number if self.final[state] else -1

    def near(self, word: str, half: int) -> list[int]:
        """Numbers of the words that begin with word[:half] and then differ from word by exactly one error; each once.

        Of errors that give the same word, such as the loss of either of two equal neighbours, one is tried.
        """
        state, number = self.start, 0
        for c in word[:half]:
            step = self.arcs[state].get(c)
            if step is None:
                return []
            state, number = step[0], number + step[1]
        out, n = [], len(word)
        for i in range(half, n + 1):
            arcs, c = self.arcs[state], word[i] if i < n else None
            after = word[i + 1] if i + 1 < n else None
            for d, (target, skipped) in arcs.items():
                if d == c:
                    continue  # the same word as with d behind the run of it
                beyond = self.arcs[target]
                if c is None or c in beyond:
                    out.append(self._rest(target, number + skipped, word, i))
                if c is not None and (after is None or after in beyond):
                    out.append(self._rest(target, number + skipped, word, i + 1))
            if c is None:
                break
            if i == half or c != word[i - 1]:
                out.append(self._rest(state, number, word, i + 1))
            step = arcs.get(c)
            if step is None:
                break
            state, number = step[0], number + step[1]
        return [x for x in out if x >= 0]


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least five code points that occur three times or more.

    Words are maximal runs of Latin letters, A-Z lower-cased. An occurrence whose digest of document id and word is
    divisible by 97 loses a code point, as a typing error would. A null text has no words; a null id counts as empty.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(key.alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS + f"{{{LEAST_CHARS},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % TYPO_EVERY == 0, shorter).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def _sharded(words: DataFrame, backward: bool, shards: int) -> tuple[DataFrame, list[str]]:
    """(pid, key, n), the words or the reversed words in shards of one sorted order, and the shards' first keys, cut short."""
    key = F.reverse("word") if backward else F.col("word")
    dealt = words.select(key.alias("key"), "n").repartitionByRange(shards, "key")
    dealt = cut(dealt.select(F.spark_partition_id().alias("part"), "key", "n"), "spelling-shards", narrow=True)
    rows = dealt.groupBy("part").agg(F.min("key").alias("first")).select("part", F.substring("first", 1, BOUND_CHARS).alias("first")).collect()  # a row a shard
    order = sorted(rows, key=lambda r: r.part)
    number = {r.part: i for i, r in enumerate(order)}
    pid = F.element_at(F.create_map(*[F.lit(x) for kv in number.items() for x in kv]), F.col("part")) if number else F.lit(0)
    return dealt.select(pid.alias("pid"), "key", "n"), [r.first for r in order]


def half_near(words: DataFrame, backward: bool, shards: int) -> DataFrame:
    """(word, near, near_n): near words that agree with a word in its first half, or backward in its second half."""
    dealt, firsts = _sharded(words, backward, shards)
    bounds = dealt.sparkSession.sparkContext.broadcast(firsts)  # a short string a shard

    def half(key: str) -> int:
        return len(key) - len(key) // 2 if backward else len(key) // 2

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            pids, asked = [], []
            for k in keys:
                begin = k[: half(k)][:BOUND_CHARS]
                low = max(0, bisect_left(bounds.value, begin) - 1)
                high = bisect_right(bounds.value, begin + "\U0010ffff")
                pids.extend(range(low, high))
                asked.extend([k] * (high - low))
            own = pa.array([False] * len(keys) + [True] * len(asked), pa.bool_())
            pid = pa.concat_arrays([batch.column("pid").cast(pa.int32()), pa.array(pids, pa.int32())])
            n = pa.concat_arrays([batch.column("n"), pa.nulls(len(asked), pa.int64())])
            yield pa.RecordBatch.from_arrays([pid, own, pa.array([*keys, *asked], pa.string()), n], ["pid", "query", "key", "n"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, words, counts, found = None, [], [], None
        for batch in batches:
            left, right, size = [], [], []
            for p, query, key, n in zip(*(batch.column(c).to_pylist() for c in ("pid", "query", "key", "n"))):
                if p != pid:
                    pid, words, counts, found = p, [], [], None
                if not query:
                    words.append(key)
                    counts.append(n)
                    continue
                if found is None:
                    found = Automaton(words)
                for at in found.near(key, half(key)):
                    left.append(key)
                    right.append(words[at])
                    size.append(counts[at])
            if backward:
                left, right = ([w[::-1] for w in side] for side in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(size, pa.int64())], ["word", "near", "near_n"])

    both = dealt.mapInArrow(ask, "pid int, query boolean, key string, n long")
    met = both.repartitionById(max(1, len(firsts)), F.col("pid")).sortWithinPartitions("pid", "query", "key")
    return met.mapInArrow(answer, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): the last word that forms lead to, by doubling the way at each round.

    A form is at least twice as frequent as its word, so ways have no cycles and rounds grow with the log of their length.
    """
    now = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots", narrow=True)
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = cut(now.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots", narrow=True)
        drop_cut(now)
        now = after
        if after.where("moved").isEmpty():
            return now


def grouped(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct words and their counts (word, n).

    A word's near words differ from it by exactly one inserted, deleted or replaced code point; its form is the one of
    largest n (ties: the least in code-point order) if that is at least twice the word's n, else null; its root is where
    forms lead from it, itself without one. An empty table gives an empty one. A word's near words are one row at a time
    in the alphabet's size times its length at most.
    """
    spark, before = words.sparkSession, cuts_so_far()
    words = cut(words, "spelling-words", narrow=True)
    chars = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    shards = max(1, min(shuffle_width(spark), chars // 5_000), math.ceil(chars / SHARD_CHARS))
    pairs = half_near(words, False, shards).unionByName(half_near(words, True, shards))
    each = pairs.groupBy("word").agg(F.collect_set(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("near"))
    each = each.select("word", F.size("near").cast("long").alias("n_near"), F.array_min("near").alias("top"))
    joined = words.join(each, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    enough = -F.col("top.m") >= 2 * F.col("n")
    joined = joined.select("word", "n", "n_near", F.when(enough, F.col("top.w")).alias("form"), F.when(enough, -F.col("top.m")).alias("form_n"))
    found = cut(joined, "spelling-forms", narrow=True)
    ends = roots(found.where("form IS NOT NULL"))
    drop_cuts_since(before, found, ends)
    return found.join(ends.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of `documents`: word, form, root, n, n_near, form_n."""
    return grouped(counted_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: The query in SQL: CRC-32 by its table, near words by joins of what remains when a code point is left out.
ORACLE = r"""WITH RECURSIVE table_of AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{5,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
bytes AS (SELECT id, run, count(*) AS times, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b FROM runs GROUP BY id, run),
digests AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1]))) AS h FROM bytes, table_of),
words AS (SELECT word, sum(times)::BIGINT AS n FROM (SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM digests)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
left_out AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n FROM left_out a JOIN left_out b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM left_out a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM left_out a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top, arg_min(near, (-n, near)) AS form FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN form END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n FROM words w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at FROM forms UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON way.at = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT way.word, way.at AS root FROM way JOIN forms ON way.at = forms.word WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
