"""Language identification of mixed-language text.

Script ranges narrow each word's candidate languages to those that use its script; each word gets a score per
candidate from character-gram frequencies; a Viterbi pass over the words, with a penalty for each switch of language,
labels spans. The text's language is the one that labels most of its letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hingeworks.llm.common import STEP_CHARS, steps, text_batches

#: Labelled texts a language that teach at most, in expectation; beyond that an even sample by hash of the id is taken.
MAX_TRAIN = 4_000
#: Grams have 1 to ORDERS characters; each order has BUCKETS counters, so a language's model has a fixed size.
ORDERS, BUCKETS = 4, 1 << 16
#: Cost of a switch between languages, in nats; weight of the smoothing count; cost of a script that a language doesn't use.
SWITCH, SMOOTH, FOREIGN = 10.0, 0.5, 40.0
#: A language uses a script if so much of its letters are in it.
SCRIPT_SHARE = 0.002
#: First code points of script ranges, ascending, and the script from there on (0: other).
SCRIPT_STARTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "other"), (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"),
    (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han"), (0x30000, "other"),
)
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
_SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])
SLOTS = ORDERS * BUCKETS + len(SCRIPTS)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter, and its lower-case form where that is one code point."""
    chars = [chr(i) for i in range(0x110000)]
    letter = np.array([c.isalpha() for c in chars])
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(letter):
        low = chars[i].lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return letter, lower


@dataclass
class Words:
    """The words (runs of letters) of several texts laid end to end, and the grams within them."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    script: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]  # per order: slot, word


def words_of(texts: list[str]) -> Words:
    letter, lower = _tables()
    joined = " " + " ".join(texts) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    mark = letter[code]
    edge = np.flatnonzero(mark[1:] != mark[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1] if texts else np.empty(0, np.int64)
    text = np.searchsorted(begin, start, side="right") - 1
    script = _SCRIPT_OF[np.searchsorted(_STARTS, code[start], side="right") - 1]
    low = np.where(mark, lower[code], 0).astype(np.uint64)
    # words with one mark on either side: positions start - 1 to end, end included
    size = end - start + 2
    word = np.repeat(np.arange(len(start)), size)
    first = np.repeat(np.cumsum(size) - size, size)
    place = np.arange(len(word)) - first
    at = np.repeat(start - 1, size) + place
    here = low[at]
    grams, hashed = [], np.zeros(len(at), dtype=np.uint64)
    for order in range(1, ORDERS + 1):
        hashed = np.concatenate([np.zeros(1, np.uint64), hashed[:-1]]) if order > 1 else hashed
        hashed = (hashed + here + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
        keep = place >= order - 1
        if order == 1:
            keep &= here > 0
        slot = (hashed[keep] >> np.uint64(40)).astype(np.int64) % BUCKETS + (order - 1) * BUCKETS
        grams.append((slot, word[keep]))
    return Words(start - begin[text] if len(start) else start, end - begin[text] if len(end) else end, text, script, grams)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # slots x languages, log probability within an order
    uses: np.ndarray  # scripts x languages

    def word_scores(self, w: Words) -> np.ndarray:
        """Words x languages: summed log probabilities of a word's grams, averaged over orders; foreign scripts cost."""
        total = np.zeros((len(w.start), len(self.langs)))
        for slot, word in w.grams:
            run = np.zeros((len(slot) + 1, len(self.langs)))
            np.cumsum(self.table[slot], axis=0, out=run[1:])
            ends = np.searchsorted(word, np.arange(len(w.start) + 1))
            total += run[ends[1:]] - run[ends[:-1]]
        total /= ORDERS
        uses = self.uses[w.script]
        uses[~uses.any(axis=1)] = True
        return np.where(uses, total, total - FOREIGN)

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """For each text (language or und, share of letters, spans (start, end, language) in code points)."""
        out: list[tuple[str, float, list[tuple[int, int, str]]]] = []
        for a, b in steps((len(t or "") for t in texts), max(1, 4 * STEP_CHARS // max(4, len(self.langs)))):
            w = words_of([t or "" for t in texts[a:b]])
            scores = self.word_scores(w) if self.langs else np.zeros((len(w.start), 0))
            cuts = np.searchsorted(w.text, np.arange(b - a + 1))
            for i, j in zip(cuts, cuts[1:]):
                out.append(self._one(scores[i:j], w.start[i:j], w.end[i:j]))
        return out

    def _one(self, s: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[str, float, list[tuple[int, int, str]]]:
        if not len(s) or not self.langs:
            return "und", 0.0, []
        path = viterbi(s, SWITCH)
        size = end - start
        weight = np.bincount(path, weights=size, minlength=len(self.langs))
        best = int(weight.argmax())
        edges = np.flatnonzero(np.diff(path, prepend=-1))
        spans = [(int(start[i]), int(end[j - 1]), self.langs[path[i]]) for i, j in zip(edges, [*edges[1:], len(path)])]
        return self.langs[best], float(weight[best] / size.sum()), spans


def viterbi(s: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each row of scores s where each change of label costs `switch`; ties go to the earlier label.

    Shortcut: let A have the best total. If no stretch of rows gains more than half the cost by another label, no
    path with a switch can beat A throughout.
    """
    best = int(s.sum(axis=0).argmax())
    gain = np.zeros((len(s) + 1, s.shape[1]))
    np.cumsum(s - s[:, best : best + 1], axis=0, out=gain[1:])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= switch / 2:
        return np.full(len(s), best)
    labels = range(s.shape[1])
    now, back = s[0].tolist(), []
    for row in s[1:].tolist():
        top = max(labels, key=now.__getitem__)
        jump = now[top] - switch
        step = [k if now[k] >= jump else top for k in labels]
        now = [row[k] + (now[k] if step[k] == k else jump) for k in labels]
        back.append(step)
    k = max(labels, key=now.__getitem__)
    path = [k]
    for step in reversed(back):
        k = step[k]
        path.append(k)
    return np.array(path[::-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Learn from (doc_id, text, lang), held-out documents and null languages left aside; whole texts of a bounded sample.

    Counts reach the driver: at most SLOTS numbers a language.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text", "lang").where("text is not null and lang is not null").where(~held_out(F.col("id")))
    sizes = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, most / sizes[k]) * (1 << 30)))]) if langs else None
    if not langs:
        return Model([], np.zeros((SLOTS, 0)), np.zeros((len(SCRIPTS), 0), bool))
    text_batches(docs.sparkSession)
    taught = own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang"))).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()))
            for lang in {x for x, _ in rows}:
                texts = [t for x, t in rows if x == lang]
                counts = np.zeros(SLOTS, dtype=np.int64)
                for a, b in steps(map(len, texts), STEP_CHARS):
                    w = words_of(texts[a:b])
                    for slot, _ in w.grams:
                        counts += np.bincount(slot, minlength=SLOTS)
                    counts[ORDERS * BUCKETS :] += np.bincount(w.script, weights=w.end - w.start, minlength=len(SCRIPTS)).astype(np.int64)
                slots = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(counts[slots])], ["lang", "slot", "n"])

    found = taught.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((SLOTS, len(langs)))
    place = {k: i for i, k in enumerate(langs)}
    counts[found["slot"].to_numpy(), [place[k] for k in found["lang"].to_pylist()]] = found["n"].to_numpy()
    letters = counts[ORDERS * BUCKETS :]
    uses = letters > SCRIPT_SHARE * letters.sum(axis=0)
    table = np.zeros((ORDERS * BUCKETS, len(langs)), dtype=np.float32)
    for o in range(ORDERS):
        part = counts[o * BUCKETS : (o + 1) * BUCKETS]
        table[o * BUCKETS : (o + 1) * BUCKETS] = np.log((part + SMOOTH) / (part.sum(axis=0) + SMOOTH * BUCKETS))
    return Model(langs, table, uses)


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score, spans): score is the share of the text's letters that the language labels.

    A null text, or one without letters, is und with score 0 and no spans; so is every text if nothing was learned.
    Repeated rows stay, other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed size a language
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = m.label(batch.column("text").to_pylist())
            spans = [[{"start": a, "end": b, "lang": k} for a, b, k in s] for _, _, s in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, span)], ["id", "lang_pred", "score", "spans"])

    text_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every text of `documents`; n_spans counts the labelled spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identified(docs, fit(docs))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
