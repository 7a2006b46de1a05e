"""Benchmark decontamination by pigeonhole edit matching.

An item of n normalised characters may be met with up to k = n // piece - 1 edits (at least 0). It is split into k + 1
pieces; a passage within k edits holds at least one of them unchanged, so an Aho-Corasick automaton over all pieces
finds every candidate place, and Myers' bit-parallel recurrence over a window around it decides and gives the distance.
Normalising lower-cases and turns each run of characters other than letters and digits into one space.

The benchmark is measured before it is broadcast; beyond `block_chars` it is met in blocks: one is collected and broadcast at
a time, a pass of its automaton runs over the documents without a shuffle, and what it found is stored before the next.

Edge cases: null and empty texts match nothing; null items match nothing; items shorter than `least` characters are met
without edits at word edges, if they have at least `least_words` words, for one or two words stand in clean texts by chance;
texts of any length are searched whole; of an item's places that with the least distance, then the first, is reported; items of equal text are all reported; repeated rows are judged alike; with an empty
benchmark no row is contaminated; extra columns are kept by `decontaminate` and ignored by `matches`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflux.llm.common import only, stored, table, with_computed

FOUND = "array<struct<item_id:bigint,distance:int,start:bigint,end:bigint>>"
_GAP = re.compile(r"[\W_]+")


#: Bytes of Latin-1 with a space for what `_GAP` matches.
_LATIN = bytes(32 if _GAP.match(chr(c)) else c for c in range(256))


def plain(text: str | None) -> str:
    low = (text or "").lower()
    try:
        return b" ".join(low.encode("latin-1").translate(_LATIN).split()).decode("latin-1")
    except UnicodeEncodeError:
        return _GAP.sub(" ", low).strip()


def pieces(item: str, piece: int) -> tuple[int, list[tuple[int, str]]]:
    """The error budget k and the k + 1 pieces (offset, text) of an item."""
    k = max(0, len(item) // piece - 1)
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(masks: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the first best place in text where a pattern of m characters stands within the budget."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a match may begin anywhere
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= budget and (best is None or score < best[0]):
            best = (score, at + 1)
            if not score:
                break
    return best


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int, str]], piece: int, least: int = 0):
        import ahocorasick

        self.by_text: dict[str, list[int]] = {}
        for item_id, text in items:
            self.by_text.setdefault(text, []).append(item_id)
        self.items, words = [], {}
        for text, ids in self.by_text.items():
            k, parts = pieces(text, piece) if len(text) >= least else (None, [(0, text)])
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            n = len(self.items)
            self.items.append((ids, text, k, masks))
            for offset, part in parts:
                words.setdefault(part, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for part, places in words.items():
            self.automaton.add_word(part, (len(part), places))
        if words:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item that the text holds, at its best place."""
        x, found, tried = plain(text), {}, set()
        if not self.items or not x:
            return []
        for end, (size, places) in self.automaton.iter(x):
            for n, offset in places:
                if n in found and not found[n][0]:
                    continue
                _, item, k, masks = self.items[n]
                begin = end + 1 - size - offset  # where the item would start without insertions
                if k is None:
                    if (begin == 0 or x[begin - 1] == " ") and (end + 1 == len(x) or x[end + 1] == " "):
                        found[n] = (0, begin, end + 1)
                    continue
                if (n, begin) in tried:
                    continue
                tried.add((n, begin))
                lo = max(0, begin - k)
                window = x[lo : begin + len(item) + k]
                if (hit := myers(masks, len(item), window, k)) is not None:
                    stop = lo + hit[1]
                    place = (hit[0], max(0, stop - len(item)), stop)
                    found[n] = min(found.get(n, place), place)
        return sorted((i, *hit) for n, hit in found.items() for i in self.items[n][0])


def blocks(benchmark: DataFrame, least: int, least_words: int, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The normalised items, in blocks of about block_chars, one at a time; how many there are follows from a measured size."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["item_id"], x) for r in part.collect() if (x := plain(r["text"])) and (len(x) >= least or x.count(" ") + 1 >= least_words)]


def with_matches(docs: DataFrame, benchmark: DataFrame, piece: int = 16, least: int = 32, least_words: int = 3, block_chars: int = 16_000_000) -> DataFrame:
    """docs plus `__found`: which items each row's text holds, with distance and place (in normalised characters)."""
    out, sent = docs.withColumn("__found", F.array().cast(FOUND)), None
    for block in blocks(benchmark, least, least_words, block_chars):
        if sent is not None:  # a further block: what the last one found is written, and its memory given back
            out = stored(out, "matched")
            sent.unpersist()
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def compute(sent=sent):
            import pyarrow as pa

            matcher = Matcher(sent.value, piece, least)
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
            return lambda texts: [pa.array([[dict(zip(("item_id", "distance", "start", "end"), h)) for h in matcher.find(t.as_py())] for t in texts], kind)]

        out = with_computed(out, "text", compute, f"__more {FOUND}").withColumn("__found", F.concat("__found", "__more")).drop("__more")
    return out


def matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row per document and item found in it."""
    found = with_matches(only(docs, "doc_id", "text"), benchmark, **options)
    return found.select("doc_id", F.explode("__found").alias("m")).select("doc_id", "m.item_id", "m.distance", "m.start", "m.end")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item."""
    return with_matches(docs, benchmark, **options).where(F.size("__found") == 0).drop("__found")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
