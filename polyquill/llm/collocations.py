"""Collocations from word-id suffix arrays.

Texts fall into pieces at punctuation, pieces into words.  A shard is some megabytes of text: its words get numbers by Arrow's dictionary, and its
suffixes are ordered by prefix doubling in numpy (one word, two, four; longer phrases aren't asked for).  Neighbours in that
order have a longest common prefix, and an interval of suffixes that have n words in common is one phrase of n words with its count.  Counts of
shards are summed by language and phrase.

Phrases of three and four words are counted in a second pass, only where each two consecutive words are frequent.  Which pairs are is told by a bit
filter of ``FILTER_BITS`` bits: a pair that isn't in it is not frequent, a pair that is may not be, and is then counted in vain.  So nothing is lost, and what
is sent has one size for any corpus.  Parts of phrases are looked up by joins; the few parts that very many phrases share are sent by broadcast.  Ranks come from
range partitions, so no language is one task's work.

Defined results: a null text is empty; a null lang is ``und`` (and counts with such rows); a text of any length is one text; repeated rows count as often as they are there; words
are compared byte by byte, upper-case letters other than A-Z stay; ties of cuts go to the shorter first part, ties of rank to the greater count, then the lesser bytes; an
empty table, or one without frequent phrases, gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import attached, placed
from .shared import cut, shipped
from .textkit import Hasher, lower_ascii, mix, odd_constants, slices, trim, utf8, word_spans

LEAST, SHARE, TOP, LONGEST = 30, 80, 2000, 4
#: Text of a shard; bits of the filter of frequent pairs.
SHARD_BYTES, FILTER_BITS = 1_500_000, 27
_BLOCK = 17  # the filter is gathered in blocks of so many bits
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORDS = ~_ENDS
_WORDS[[0x20, 0x09]] = False
COUNTS = "lang string, phrase string, f long"


def _pair_hash(first: np.ndarray, second: np.ndarray, lang: np.ndarray) -> np.ndarray:
    k = odd_constants(3, 41)
    return mix(first * k[0] + mix(second * k[1] + lang * k[2]))


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(FILTER_BITS)) & mask).astype(np.int64)


class Shard:
    """The words of some texts: numbers within a language, lengths of what is left of each piece, and ranks of suffixes by their first words."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        raw, at = utf8(texts)
        raw = lower_ascii(raw)
        begin, end, first = word_spans(raw, at, _WORDS)
        langs = langs.fill_null("und").dictionary_encode()
        self.langs = langs.dictionary
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[of]
        n = self.n = len(begin)
        size = end - begin
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        inside = np.zeros(len(raw) + 1, np.int8)
        np.add.at(inside, begin, 1)
        np.add.at(inside, end, -1)
        packed = raw[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        words = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        self.words, self.word = words.dictionary, words.indices.to_numpy().astype(np.int64)
        ends = np.cumsum(_ENDS[raw], dtype=np.int32)[begin] if n else np.zeros(0, np.int64)
        new = np.ones(n, bool)
        new[1:] = (ends[1:] != ends[:-1]) | (of[1:] != of[:-1])
        starts = np.flatnonzero(new)
        last = np.append(starts[1:], n)[np.cumsum(new) - 1] if n else starts
        self.left = last - np.arange(n)  # words to the end of the piece
        self.rank1 = self.lang * len(self.words) + self.word

    def hashes(self) -> np.ndarray:
        """Of each word and the one after it (of whatever piece)."""
        word, lang = (Hasher().spans(raw, at[:-1], at[1:]) for raw, at in (utf8(self.words), utf8(self.langs)))
        h, tongue = word[self.word], lang[self.lang]
        return _pair_hash(h[:-1], h[1:], tongue[:-1])

    def likely(self, bits: np.ndarray) -> None:
        """Cuts what is left of each piece where two words that follow each other are not in the filter."""
        if self.n < 2:
            return
        good = self.left[:-1] > 1
        for b in _bits(self.hashes()):
            good &= (bits[b >> 3] >> (b & 7) & 1).astype(bool)
        run = np.zeros(self.n + LONGEST, np.int64)
        good = np.append(good, np.zeros(LONGEST, bool))
        for j in range(LONGEST - 1):  # pairs in a row from each word on
            run[: self.n] += np.logical_and.reduce([good[i : i + self.n] for i in range(j + 1)])
        self.left = 1 + run[: self.n]

    @staticmethod
    def _dense(key: np.ndarray) -> np.ndarray:
        return np.unique(key, return_inverse=True)[1].astype(np.int64)

    def counts(self, lengths: tuple[int, ...]) -> pa.RecordBatch:
        """lang, phrase, f of all phrases of these lengths, from the intervals of common prefixes."""
        longest = max(lengths)
        left = np.minimum(self.left, longest)
        rank1 = np.append(self.rank1 + 1, np.zeros(LONGEST, np.int64))
        at = np.flatnonzero(left >= min(lengths))
        wide = int(rank1.max()) + 1

        def pair(i: np.ndarray, two: np.ndarray) -> np.ndarray:
            return rank1[i] * wide + np.where(two, rank1[i + 1], 0)

        first2 = pair(at, left[at] > 1)
        key = first2
        if longest > 2:
            rest = np.where(left[at] > 2, pair(at + 2, left[at] > 3), 0)
            both = self._dense(np.concatenate([first2, rest]))
            key = both[: len(at)] * (len(both) + 1) + both[len(at) :] + 1
        order = np.argsort(key, kind="stable")
        sa = at[order]
        # words that each suffix has in common with the one before it
        common = np.zeros(len(sa), np.int64)
        same = np.ones(max(len(sa) - 1, 0), bool)
        for j in range(longest):
            here = left[sa] > j
            same = same & here[1:] & here[:-1] & (rank1[sa[1:] + j] == rank1[sa[:-1] + j])
            common[1:] += same
        langs, phrases, found = [], [], []
        for n in lengths:
            valid = left[sa] >= n
            begins = np.flatnonzero(valid & (common < n))
            total = np.append(np.cumsum(valid), 0)  # the last place stays free for an empty shard
            upto = total[np.append(begins[1:], len(sa)) - 1] if len(begins) else total[:0]
            found.append(np.diff(np.concatenate([[0], upto])))
            where = sa[begins]
            langs.append(self.langs.take(pa.array(self.lang[where])))
            parts = [self.words.take(pa.array(self.word[where + j])) for j in range(n)]
            phrases.append(pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(langs).cast(pa.string()), pa.concat_arrays(phrases).cast(pa.string()), pa.array(np.concatenate(found), pa.int64())], ["lang", "phrase", "f"])


def _counter(lengths: tuple[int, ...], bits: Callable[[], np.ndarray] | None, totals: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits() if bits else None
        for whole in batches:
            for batch in slices(whole, most=SHARD_BYTES):
                shard = Shard(batch.column("text"), batch.column("lang"))
                if not shard.n:
                    continue
                if totals:  # all words of each language, as the count of the empty phrase
                    n = np.bincount(shard.lang, minlength=len(shard.langs))
                    yield pa.RecordBatch.from_arrays([shard.langs.cast(pa.string()), pa.array([""] * len(n)), pa.array(n, pa.int64())], ["lang", "phrase", "f"])
                if known is not None:
                    shard.likely(known)
                found = shard.counts(lengths)
                del shard
                for i in range(0, found.num_rows, 50_000):
                    yield found.slice(i, 50_000)
                del found
                trim()

    return run


def frequent(docs: DataFrame, lengths: tuple[int, ...], least: int = LEAST, bits: Callable | None = None, totals: bool = False) -> DataFrame:
    """lang, phrase, f of the phrases of these lengths with at least so many occurrences, stored; with ``totals`` the empty phrase counts all words."""
    each = docs.select("lang", "text").mapInArrow(_counter(lengths, bits, totals), COUNTS)
    return cut(each.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == "")))


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """A bit filter of the pairs (lang, phrase of two words); what reaches the driver are its bytes, however many pairs there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = np.ones(256, bool)
        blank[0x20] = False
        for b in batches:
            raw, at = utf8(b.column("phrase"))
            begin, end, first = word_spans(raw, at, blank)
            h = Hasher().spans(raw, begin, end)
            lang_raw, lang_at = utf8(b.column("lang"))
            h = _pair_hash(h[first[:-1]], h[first[:-1] + 1], Hasher().spans(lang_raw, lang_at[:-1], lang_at[1:]))
            places = np.unique(np.concatenate(_bits(h)))
            yield pa.RecordBatch.from_arrays([pa.array(places >> _BLOCK, pa.int64()), pa.array(places & ((1 << _BLOCK) - 1), pa.int32())], ["block", "bit"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for places in b.column("bits"):
                own = np.zeros(1 << _BLOCK, bool)
                own[places.values.to_numpy(zero_copy_only=False)] = True
                out.append(np.packbits(own, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(out, pa.binary())], ["block", "bits"])

    places = pairs.select("lang", "phrase").mapInArrow(run, "block long, bit int")
    blocks = places.groupBy("block").agg(F.collect_set("bit").alias("bits"))  # at most 2**17 bits a block
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = 1 << (_BLOCK - 3)
    for block, own in blocks.mapInArrow(pack, "block long, bits binary").collect():
        bits[block * size : (block + 1) * size] = np.frombuffer(own, np.uint8)
    return bits


def mined(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """Per language the phrases with the highest scores: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    short = frequent(docs, (1, 2), least, totals=True)
    words = F.size(F.split("phrase", " "))
    totals, pairs = short.where("phrase = ''").select("lang", F.col("f").alias("n")), short.where((F.col("phrase") != "") & (words == 2))
    long = frequent(docs, (3, 4), least, shipped(spark, pair_filter(pairs)))
    known = short.where("phrase <> ''").unionByName(long).withColumn("words", F.split("phrase", " "))
    total = totals.agg(F.sum("n")).first()[0] or 0
    # phrases inside a longer one that has nearly all their occurrences
    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    longer = known.where(size > 2).select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("_g")).groupBy("lang", "phrase").agg(F.max("_g").alias("_g"))
    candidates = known.where(size > 1).join(longer, ["lang", "phrase"], "left").where(F.col("_g").isNull() | (F.col("_g").cast("decimal(38,0)") * 100 < F.col("f").cast("decimal(38,0)") * share)).drop("_g")
    candidates = cut(candidates)
    # every cut of a phrase asks for two counts
    parts = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit("l").alias("side"), F.array_join(F.slice("words", 1, k), " ").alias("part")), F.struct(k.alias("k"), F.lit("r").alias("side"), F.array_join(F.slice("words", k + 1, size - k), " ").alias("part")),
    )))
    asked = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(parts).alias("_p")).select("lang", "phrase", "a", "_p.*")
    counts = known.where(size < LONGEST).select("lang", F.col("phrase").alias("part"), "f", F.col("f").alias("_rows"))
    answered = attached(asked, counts, ["lang", "part"], "_rows", total)
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")
    wide = answered.groupBy("lang", "phrase", "a").agg(*(of(k, side) for k in range(1, LONGEST) for side in "lr"))
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"cast(a as decimal(31,0)) * 2000000BD div (cast(l{k} as decimal(20,0)) + r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)]
    scored = wide.withColumn("_c", F.array_min(F.filter(F.array(*cuts), lambda c: c.isNotNull()))).select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score")
    ranked = placed(scored, "lang", F.desc("score"), F.desc("a"), "phrase", place="_place", part="_part")
    begins = ranked.groupBy("lang").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    begins = begins.join(totals, "lang")
    out = attached(ranked, begins, ["lang"], "_rows", ranked.count()).withColumn("rank", F.col("_place") - F.col("_first") + 1).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))


def report(docs: DataFrame) -> DataFrame:
    return mined(docs)


#: The same by SQL (DuckDB): all phrases are counted, then cut, thinned and ranked.
SQL = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0B\x0C\r]')) AS p FROM docs)),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM spots, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
known AS (SELECT *, string_split(phrase, ' ') AS w FROM counts),
longer AS (SELECT lang, phrase, max(f) AS g FROM (SELECT k.lang, k.f, array_to_string(k.w[i : i + s - 1], ' ') AS phrase FROM known k, (SELECT unnest([2, 3]) AS s), (SELECT unnest([1, 2, 3]) AS i) WHERE s < k.m AND i + s - 1 <= k.m) GROUP BY ALL),
kept AS (SELECT k.* FROM known k LEFT JOIN longer USING (lang, phrase) WHERE k.m > 1 AND (g IS NULL OR 100 * g < 80 * k.f)),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, (2000000 * c.f::HUGEINT // (x.f + y.f))::BIGINT AS score
  FROM kept c, (SELECT unnest([1, 2, 3]) AS k), counts x, counts y
  WHERE k < c.m AND x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') AND y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best JOIN totals USING (lang)) WHERE rank <= 2000
"""
