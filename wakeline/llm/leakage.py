"""Evaluation texts leaking into training text (problem 9): Wu-Manber multi-pattern search over words.

Patterns are all runs of five words of the test items. A stretch of n >= 14 item words with at most one edit in
eight has n - e matching words in at most e + 1 runs, e = n // 8, so one of them has five words or more: no stretch
that counts is without a pattern. A table over blocks of two words tells how far the search may jump ahead; blocks
that end a pattern select candidate patterns by hash, and direct comparison confirms them. Confirmed runs are
extended both ways by furthest-reaching alignments of the words in order, by the number of changed, missing or added
words; a stretch counts if it spans ``min_words`` words of the item and at most one word in eight of the whole is so
edited, wherever in it.

Common language starts no search: a run of words that stands in more than two different surroundings within the items
is none of an item's own, and a stretch needs six words in runs of three that are. Wording that several items share
in the same surroundings (an answer, a passage) is searched for and reported with each of them.

Instructions don't count: of a prompt's first three sentences those of at most ``INSTRUCTION_WORDS`` words that other
items have among theirs too, as long as they lead and something follows them.

Case, punctuation, white space, quoting and markup don't matter. Defined results: null and empty texts hold
nothing; null prompts or answers are no patterns; a document is searched whole whatever its length; repeated
documents are searched row by row and give distinct (doc_id, item_id) rows. Beyond ``block_items`` test items the
corpus is searched once for each block of them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.session import spread_scan, write_table

M, B = 5, 2
INSTRUCTION_WORDS = 24


def words_of(text: str | None) -> list[str]:
    t = html.unescape(text or "")
    t = re.sub(r"</?[A-Za-z][^<>]{0,200}>", " ", t)
    t = unicodedata.normalize("NFKC", t).casefold()
    t = re.sub("[­​-‏⁠﻿'’‘`´*_~]", "", t)
    return re.findall(r"[^\W_]+", t)


def item_passages(items: list[tuple[int, str | None, str | None, Sequence[str] | None]]) -> list[tuple[int, list[str]]]:
    """(item_id, words) of prompts and answers; items are (item_id, prompt, answer, its shared instructions)."""
    out = []
    for i, p, a, shared in items:
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", p or "") if s]
        while len(sentences) > 1 and sentences[0] in (shared or ()):
            sentences.pop(0)
        for passage in (" ".join(sentences), a):
            if w := words_of(passage):
                out.append((i, w))
    return out


def _common_runs(passages: list[tuple[int, list[str]]], n: int, wordings: int) -> set[tuple[str, ...]]:
    around: dict[tuple[str, ...], set[tuple[str, ...]]] = defaultdict(set)
    for _, w in passages:
        for p in range(len(w) - n + 1):
            around[tuple(w[p : p + n])].add((*w[max(0, p - 4) : p], "", *w[p + n : p + n + 4]))
    return {r for r, seen in around.items() if len(seen) > wordings}


class WuManber:
    """Shift table over blocks of B words and suffix buckets of patterns of M words."""

    def __init__(self, passages: list[tuple[int, list[str]]], wordings: int = 2):
        """A run that stands in more than wordings different surroundings of 4 words each way is common language, no pattern."""
        self.passages = passages
        common = {n: _common_runs(passages, n, wordings) for n in (M, 3)}
        self.rare: list[dict[tuple[str, ...], list[int]]] = []
        for _, w in passages:
            runs: dict[tuple[str, ...], list[int]] = {}
            for p in range(len(w) - 2):
                if (r := tuple(w[p : p + 3])) not in common[3]:
                    runs.setdefault(r, []).append(p)
            self.rare.append(runs)
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        for k, (_, w) in enumerate(passages):
            for p in range(len(w) - M + 1):
                if tuple(w[p : p + M]) in common[M]:
                    continue
                for q in range(B, M + 1):
                    block = (w[p + q - 2], w[p + q - 1])
                    self.shift[block] = min(self.shift.get(block, M - B + 1), M - q)
                self.bucket[(w[p + M - 2], w[p + M - 1])].append((k, p))

    @classmethod
    def of_tables(cls, tables: tuple) -> WuManber:
        index = cls.__new__(cls)
        index.passages, index.rare, index.shift, index.bucket = tables
        return index

    def tables(self) -> tuple:
        """The index as plain lists and dicts, which workers can read without this package."""
        return self.passages, self.rare, self.shift, dict(self.bucket)

    def hits(self, doc: list[str]) -> dict[int, list[tuple[int, int]]]:
        """passage -> (position in doc, position in passage) of every pattern found."""
        found: dict[int, list[tuple[int, int]]] = {}
        i, n, default = M - 1, len(doc), M - B + 1
        shift, bucket, passages = self.shift, self.bucket, self.passages
        while i < n:
            block = (doc[i - 1], doc[i])
            s = shift.get(block, default)
            if s:
                i += s
                continue
            at = i - M + 1
            front = doc[at : i - 1]
            for k, p in bucket[block]:
                if passages[k][1][p : p + M - B] == front:
                    found.setdefault(k, []).append((at, p))
            i += 1
        return found


def _ends(doc: list[str], item: list[str], d: int, p: int, way: int, won: int = 0, per_edit: int = 8) -> list[int]:
    """Item words passed from (d, p) on in direction way up to the last matching one, by the number of edits spent.

    Edits are spent while twice the words passed, with those won on the other side, can pay for them.
    """
    n, m = (len(doc) - d, len(item) - p) if way > 0 else (d + 1, p + 1)
    far, ends, e = {0: 0}, [], 0  # furthest item word by diagonal
    while True:
        best = ends[-1] if ends else 0
        reached: dict[int, int] = {}
        for g, j in far.items():
            # no edit yet, or a word changed, missing in doc, added in doc
            for h, k in ((g, j + 1), (g - 1, j + 1), (g + 1, j)) if e else ((g, j),):
                i = k + h
                if k > m or not 0 <= i <= n:
                    continue
                begun = k
                while k < m and i < n and doc[d + way * i] == item[p + way * k]:
                    i, k = i + 1, k + 1
                if k > begun and k > best:
                    best = k
                if k > reached.get(h, -1):
                    reached[h] = k
        far = reached
        ends.append(best)
        e += 1
        if best == m or 2 * (best + won) + per_edit < (per_edit - 1) * e:
            return ends


def aligned_span(doc: list[str], item: list[str], seeds: list[tuple[int, int]] | None = None, per_edit: int = 8) -> int:
    """Most words of item in order in doc around one of the seeds, matching runs (position in doc, in item), of which
    at most one in per_edit is edited, wherever in the stretch; it begins and ends with a matching word.

    Take a stretch that counts apart into parts that no search from within leaves: then every gap between two parts
    costs more than twice what either part won, so all gaps together cost more than all parts won, and the stretch
    doesn't count. So the search from one of its seeds, to the right, the left and the right again, passes it all.
    """
    if seeds is None:
        seeds = [(i, j) for i, w in enumerate(doc) for j, v in enumerate(item) if w == v]
    known, span = set(seeds), 0
    for d, p in seeds:
        if (d - 1, p - 1) in known:  # the same run
            continue
        won = lambda ends: max(y - (per_edit - 1) * e for e, y in enumerate(ends))
        right = _ends(doc, item, d, p, 1, 0, per_edit)
        left = _ends(doc, item, d - 1, p - 1, -1, won(right), per_edit)
        if won(left) > 0:
            right = _ends(doc, item, d, p, 1, won(left), per_edit)
        for a, x in enumerate(left):
            for b, y in enumerate(right):
                if x + y > span and per_edit * (a + b) <= x + y:
                    span = x + y
    return span


def search(text: str | None, index: WuManber, min_cover: int = 6, drift: int = 12) -> dict[int, int]:
    """item_id -> longest stretch of its words in text, of which min_cover words or more stand in uncommon runs of three."""
    doc = words_of(text)
    out: dict[int, int] = {}
    for k, hits in index.hits(doc).items():
        item_id, words = index.passages[k]
        while hits:  # hits on about the same diagonal belong together
            lead = hits[0][0] - hits[0][1]
            near = [(d, p) for d, p in hits if abs(d - p - lead) <= drift]
            hits = [(d, p) for d, p in hits if abs(d - p - lead) > drift]
            first, last = max(0, near[0][0] - len(words)), near[-1][0] + len(words)
            cover = set()
            for d in range(first, min(len(doc) - 2, last)):
                for p in index.rare[k].get((doc[d], doc[d + 1], doc[d + 2]), ()):
                    if abs(d - p - lead) <= 2 * drift:
                        cover.update((p, p + 1, p + 2))
            if len(cover) >= min_cover:
                out[item_id] = max(out.get(item_id, 0), aligned_span(doc, words, near))
    return out


def with_instructions(items: DataFrame) -> DataFrame:
    """item_id, prompt, answer and the instructions that lead the prompt and those of other items; counted over all items."""
    base = items.select("item_id", "prompt", "answer")
    lead = base.select("item_id", F.explode(F.slice(F.split("prompt", r"(?<=[.!?])\s+"), 1, 3)).alias("sentence")).distinct()
    lead = lead.filter(F.size(F.split("sentence", r"\s+")) <= INSTRUCTION_WORDS)
    shared = lead.groupBy("sentence").agg(F.count("*").alias("n")).filter("n > 1").select("sentence")
    per_item = lead.join(shared, "sentence").groupBy(F.col("item_id").alias("__i")).agg(F.collect_set("sentence").alias("shared"))
    return base.join(per_item, F.col("item_id") == F.col("__i"), "left").drop("__i")


def leaked_spans(docs: DataFrame, items: DataFrame, *, block_items: int = 20_000, min_words: int = 14) -> DataFrame:
    """(doc_id, item_id, words) of every stretch of at least min_words words.

    The driver holds one block of test items and its index at a time; the index goes to each worker once.
    """
    spark = docs.sparkSession
    known = with_instructions(items.filter(F.col("item_id").isNotNull()))
    blocks = max(1, -(-items.count() // block_items))
    if blocks > 1:
        known = write_table(known.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "items")
    found = []
    for k in range(blocks):
        rows = (known.filter(F.col("block") == k) if blocks > 1 else known).select("item_id", "prompt", "answer", "shared").collect()
        index = spark.sparkContext.broadcast(WuManber(item_passages([tuple(r) for r in rows])).tables())

        def run(batches: Iterator[pd.DataFrame], shared=index) -> Iterator[pd.DataFrame]:
            index = WuManber.of_tables(shared.value)
            for pdf in batches:
                got = [(d, i, n) for d, t in zip(pdf["doc_id"], pdf["text"]) for i, n in search(t, index).items() if n >= min_words]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "words"])

        found.append(spread_scan(docs.select("doc_id", "text")).mapInPandas(run, "doc_id bigint, item_id bigint, words int"))
    return reduce(DataFrame.unionByName, found)


def found_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaked_spans(docs, items).select("doc_id", "item_id").distinct()
