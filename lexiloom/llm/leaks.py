"""Evaluation texts leaking into training text.

The test items are indexed once: shingles of three tokens with their BM25 weights, in
blocks of items with the greatest weight of each term in each block. Every passage of
every document is a query. As in block-max WAND, a passage is skipped if its terms' greatest
weights together stay below the threshold, then a block if the block maxima do; in opened
blocks the exact scores decide, and all items above the threshold are retrieved, however
many. Queries run set at a time over arrays. Retrieved pairs are then verified token by
token: how much of the question the document holds, and whether it has the answer too.

The corpus is read and tokenised once, whatever the number of items: what may be a term of
some item goes on as positions and hashes, to one part of the index after the other.
"""

from __future__ import annotations

import functools
import pickle
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.skeleton import skeletons
from lexiloom.llm.spans import _mixed, _power
from lexiloom.session import materialise

SHINGLE = 3
#: Items of an index block, and characters of items in an index (larger test sets are indexed in parts).
BLOCK_ITEMS = 32
INDEX_CHARS = 1 << 22
#: Cells of the filter of terms: FILTER_CELLS at most, a byte each.
FILTER_CELLS = 1 << 27
#: Tokens of a passage; half of it is shared with the next.
PASSAGE = 512
#: Cells of pieces by item places that are compared at a time.
COVER_CELLS = 4_000_000
#: Characters handled at a time.
BATCH_CHARS = 400_000
#: Least BM25 score, as a share of the score against itself of the item, or of its part of at most PASSAGE tokens.
RETRIEVE = 0.14
#: Least share of an item's tokens that a document holds in at most two pieces, but for the two
#: whole tokens that shingles cannot see beside an altered one at the end of a piece.
HELD = 0.6
K1, B = 1.2, 0.75


@functools.lru_cache(1)
def _folding() -> np.ndarray:
    """By code point: 0 for what parts words, 1 for what is dropped, 2 + n for an ideograph or syllable, else the lower-case letter."""
    fold = np.zeros(0x110000, np.uint32)
    for cp in range(0x20, 0x3400):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind[0] == "M":
            fold[cp] = 1
        elif kind[0] in "LN":
            low = ch.lower()
            fold[cp] = ord(low[0])
    fold[ord("'")] = fold[ord("’")] = 1
    for a, b in ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x323AF), (0x0F40, 0x0FBC)):
        fold[a:b + 1] = np.arange(a, b + 1)
    return fold


def _alone(code: np.ndarray) -> np.ndarray:
    """Characters that are a token each."""
    return ((code >= 0x3040) & (code <= 0x9FFF)) | (code >= 0x20000)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of many texts, and the number of the text of each: words in one case without accents, ideographs one by one."""
    plain = skeletons(texts)
    cp = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(plain), dtype=np.int64), [len(t) for t in plain])
    code = _folding()[cp]
    keep = code != 1
    code, owner = code[keep], owner[keep]
    n = len(code)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    alone, word = _alone(code), code > 1
    begins = word & (alone | np.concatenate([[True], (~word | alone)[:-1] | (owner[1:] != owner[:-1])]))
    start = np.nonzero(begins)[0]
    edge = np.nonzero(begins | ~word)[0]
    end = np.append(edge, n)[np.searchsorted(edge, start, "right")]
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(code.astype(np.uint64) + np.uint64(0x51_7C_C1_B7_27_22_0A_95)) * up[:n], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * down[start]), owner[start]


def shingles(tok: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of SHINGLE consecutive tokens of one text, and where each begins."""
    n = len(tok) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = (h ^ tok[i: i + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
        h ^= h >> np.uint64(29)
    at = np.nonzero(owner[:n] == owner[SHINGLE - 1:])[0]
    return h[at], at


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [begin, begin + count): the row of each entry, and the entries."""
    row = np.repeat(np.arange(len(begin)), count)
    first = np.cumsum(count) - count
    return row, np.arange(len(row)) - first[row] + begin[row]


def grams(tok: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive tokens of one text, told apart by size, and where each begins."""
    n = len(tok) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = tok[:n] ^ np.uint64(size)
    for i in range(1, size):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ tok[i: i + n]
    at = np.nonzero(owner[:n] == owner[size - 1:])[0]
    return _mixed(h[at] * np.uint64(0xD6E8FEB86659FD93)), at


def terms_of(tok: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of texts of ``sizes`` tokens: shingles, or the whole of a text of fewer tokens than those have."""
    h, at = shingles(tok, owner)
    for size in range(1, SHINGLE):
        g, p = grams(tok, owner, size)
        own = sizes[owner[p]] == size
        h, at = np.concatenate([h, g[own]]), np.concatenate([at, p[own]])
    order = np.argsort(at, kind="stable")
    return h[order], at[order]


@dataclass
class Hits:
    """What texts have of terms that may be items': text, place (its token) and hash, in order of text and place; and the texts' tokens."""

    doc: np.ndarray
    place: np.ndarray
    h: np.ndarray
    n_tokens: np.ndarray

    @staticmethod
    def of(texts: list[str], cells: np.ndarray) -> Hits:
        tok, owner = tokens(texts)
        n = np.bincount(owner, minlength=len(texts))
        first = np.cumsum(n) - n
        found = []
        for h, at in [shingles(tok, owner), *(grams(tok, owner, size) for size in range(1, SHINGLE))]:
            keep = np.nonzero(cells[_cell(h, len(cells))])[0]
            found.append((at[keep], h[keep]))
        at, h = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at, kind="stable")
        at, h = at[order], h[order]
        return Hits(owner[at], at - first[owner[at]], h, n)


def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(cells - 1)).astype(np.int64)


@dataclass
class Index:
    """Inverted index of the items, as arrays that travel as one broadcast.

    Items longer than a passage are indexed in equal parts of at most PASSAGE tokens, the
    others as one part; ``item`` is the number of the part, places are those in the whole item.
    Answers are kept as the hashes of their terms, one after the other.
    """

    ids: np.ndarray
    n_tokens: np.ndarray
    part_off: np.ndarray  # by item, into the parts
    terms: np.ndarray
    term_max: np.ndarray
    block_off: np.ndarray  # by term, into the block postings
    block: np.ndarray
    block_max: np.ndarray
    post_off: np.ndarray  # by block posting, into the postings
    item: np.ndarray
    weight: np.ndarray
    seen_off: np.ndarray  # by posting, into the places
    place: np.ndarray
    answer_off: np.ndarray  # by item, into the answers
    answer: np.ndarray

    @staticmethod
    def of(ids: list[int], texts: list[str], answers: list[str | None] | None = None) -> Index:
        tok, owner = tokens(texts)
        n_tokens = np.bincount(owner, minlength=len(ids))
        h, at = terms_of(tok, owner, n_tokens)
        first = np.cumsum(n_tokens) - n_tokens
        terms, term = np.unique(h, return_inverse=True)
        place = at - first[owner[at]]
        n_parts = np.maximum(1, -(-n_tokens // PASSAGE))
        part_off = np.append(0, np.cumsum(n_parts))
        n_all = int(part_off[-1])
        item = part_off[owner[at]] + place * n_parts[owner[at]] // n_tokens[owner[at]]
        order = np.lexsort((place, item, term))
        term, item, place = term[order], item[order], place[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (item[1:] != item[:-1])
        p = np.nonzero(new)[0]
        tf = np.diff(np.append(p, len(term)))
        p_term, p_item = term[p], item[p]
        df = np.bincount(p_term, minlength=len(terms))
        length = np.bincount(item, minlength=n_all).astype(float)
        idf = np.log1p((n_all - df + 0.5) / (df + 0.5))
        w = idf[p_term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[p_item] / max(1.0, length.mean() if len(length) else 1.0)))
        own = np.bincount(p_item, weights=w, minlength=n_all)
        w = w / own[p_item]
        blk = p_item // BLOCK_ITEMS
        newb = np.ones(len(p), bool)
        newb[1:] = (p_term[1:] != p_term[:-1]) | (blk[1:] != blk[:-1])
        bp = np.nonzero(newb)[0]
        bmax = np.maximum.reduceat(w, bp) if len(bp) else np.zeros(0)
        tmax = np.zeros(len(terms))
        np.maximum.at(tmax, p_term, w)
        a_tok, a_owner = tokens([a or "" for a in answers or [""] * len(ids)])
        answer, at = terms_of(a_tok, a_owner, np.bincount(a_owner, minlength=len(ids)))
        answer_off = np.searchsorted(a_owner[at], np.arange(len(ids) + 1))
        return Index(np.array(ids, np.int64), n_tokens, part_off, terms, tmax.astype(np.float32), np.searchsorted(p_term[bp], np.arange(len(terms) + 1)), blk[bp].astype(np.int32), bmax.astype(np.float32),
                     np.append(bp, len(p)), p_item.astype(np.int32), w.astype(np.float32), np.append(p, len(term)), place.astype(np.int32), answer_off, answer)

    def cells(self, size: int) -> np.ndarray:
        """The filter: which cells hold a term of an item or of an answer."""
        out = np.zeros(size, bool)
        out[_cell(self.terms, size)] = True
        out[_cell(self.answer, size)] = True
        return out

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms, and which terms."""
        t = np.searchsorted(self.terms, h)
        t[t == len(self.terms)] = 0
        hit = np.nonzero(self.terms[t] == h)[0]
        return hit, t[hit]

    def search(self, query: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, part, score of all pairs that reach RETRIEVE, from (query, term) pairs."""
        n_parts = int(self.part_off[-1])
        key = np.unique(query * len(self.terms) + term)
        query, term = key // len(self.terms), key % len(self.terms)
        asked, inverse = np.unique(query, return_inverse=True)
        bound = np.bincount(inverse, weights=self.term_max[term], minlength=len(asked))
        able = bound[inverse] >= RETRIEVE
        query, term = query[able], term[able]
        row, bp = _spread(self.block_off[term], self.block_off[term + 1] - self.block_off[term])
        n_blocks = n_parts // BLOCK_ITEMS + 1
        where, inverse = np.unique(query[row] * n_blocks + self.block[bp], return_inverse=True)
        bound = np.bincount(inverse, weights=self.block_max[bp], minlength=len(where))
        opened = bound[inverse] >= RETRIEVE
        row, bp = row[opened], bp[opened]
        again, p = _spread(self.post_off[bp], self.post_off[bp + 1] - self.post_off[bp])
        pair, inverse = np.unique(query[row[again]] * n_parts + self.item[p], return_inverse=True)
        score = np.bincount(inverse, weights=self.weight[p], minlength=len(pair))
        good = score >= RETRIEVE
        return pair[good] // n_parts, pair[good] % n_parts, score[good]

    def places(self, term: np.ndarray, item: int) -> tuple[np.ndarray, np.ndarray]:
        """Row of ``term`` and place in the item of every occurrence of the terms in it."""
        row, bp = _spread(self.block_off[term], self.block_off[term + 1] - self.block_off[term])
        low, high = self.part_off[item], self.part_off[item + 1]
        own = (self.block[bp] >= low // BLOCK_ITEMS) & (self.block[bp] <= (high - 1) // BLOCK_ITEMS)
        row, bp = row[own], bp[own]
        again, p = _spread(self.post_off[bp], self.post_off[bp + 1] - self.post_off[bp])
        own = (self.item[p] >= low) & (self.item[p] < high)
        row, p = row[again[own]], p[own]
        again, s = _spread(self.seen_off[p], self.seen_off[p + 1] - self.seen_off[p])
        return row[again], self.place[s]


def held_share(i: np.ndarray, j: np.ndarray, n: int) -> float:
    """Share of an item's n tokens that lie in the two best pieces of matches (item place i, document place j).

    A piece runs along one diagonal, give or take a few words put in or left out; up to
    four altered tokens between matches count as held.
    """
    if n <= 0 or not len(i):
        return 0.0
    order = np.lexsort((j, j - i))
    i, j = i[order], j[order]
    d = j - i
    group = np.cumsum(np.concatenate([[0], np.diff(d) > 4]))
    order = np.lexsort((j, group))
    i, j, group = i[order], j[order], group[order]
    piece = np.cumsum(np.concatenate([[0], (np.diff(group) != 0) | (np.diff(j) > 24)]))
    # By piece and item place, and how far each match reaches until the next of its piece.
    key = np.unique(piece * (n + 1) + i)
    piece, i = key // (n + 1), key % (n + 1)
    last = np.append(piece[1:] != piece[:-1], True)
    gap = np.append(i[1:] - i[:-1], 0)
    reach = np.where(last | (gap > 4 + SHINGLE), SHINGLE, gap)
    begin = np.nonzero(np.append(True, last[:-1]))[0]
    size = np.add.reduceat(reach, begin)
    # Copies of one piece count once.
    mark = np.add.reduceat(_mixed(i.astype(np.uint64)), begin)
    once = np.unique(np.stack([mark, size.astype(np.uint64)]), axis=1, return_index=True)[1]
    once = once[np.argsort(-size[once], kind="stable")]
    size, begin, count = size[once], begin[once], np.diff(np.append(begin, len(i)))[once]

    def covers(a: int, b: int) -> np.ndarray:
        row, at = _spread(begin[a:b], count[a:b])
        edge = np.zeros((b - a, n + 1), np.int8)
        np.add.at(edge, (row, i[at]), 1)
        np.add.at(edge, (row, np.minimum(i[at] + reach[at], n)), -1)
        return np.cumsum(edge, axis=1, dtype=np.int8)[:, :n] > 0

    # Best pair: a partner counts only if the two sizes together exceed the best so far.
    best = int(size[0])
    some = max(1, COVER_CELLS // (n + 1))
    for a in range(len(size)):
        if best >= n or a + 1 == len(size) or size[a] + size[a + 1] <= best:
            break
        first, b = covers(a, a + 1)[0], a + 1
        while b < len(size) and size[a] + size[b] > best:
            to = min(b + some, int(np.searchsorted(-size, size[a] - best, "left")))
            best = max(best, int(size[a] + (covers(b, to) & ~first).sum(axis=1).max()))
            b = to
    return best / n


def has_answer(answer: np.ndarray, place: np.ndarray, h: np.ndarray) -> bool:
    """Whether a text with terms ``h`` at ``place`` has the answer's terms one after the other."""
    if not len(answer):
        return False
    begins = place[h == answer[0]]
    for k in range(1, len(answer)):
        if not len(begins):
            return False
        begins = begins[np.isin(begins + k, place[h == answer[k]])]
    return len(begins) > 0


def _pairs(index: Index, ids: list[int], hits: Hits) -> list[tuple[int, int, float, float, bool]]:
    """doc_id, item_id, score, held, answer_found of all pairs."""
    if not len(index.terms):
        return []
    hit, term = index.lookup(hits.h)
    if not len(hit):
        return []
    doc, place = hits.doc[hit], hits.place[hit]
    # Every place lies in two passages that overlap by half.
    half = PASSAGE // 2
    halves = hits.n_tokens // half + 2
    base = np.cumsum(halves) - halves
    q = base[doc] + place // half
    query = np.concatenate([q, q + 1])
    found, part, score = index.search(query, np.concatenate([term, term]))
    item = np.searchsorted(index.part_off, part, "right") - 1
    of = np.searchsorted(base, found, "right") - 1
    pair, inverse = np.unique(of * len(index.ids) + item, return_inverse=True)
    top = np.zeros(len(pair))
    np.maximum.at(top, inverse, score)
    lo, all_lo = np.searchsorted(doc, np.arange(len(ids) + 1)), np.searchsorted(hits.doc, np.arange(len(ids) + 1))
    out = []
    for key, s in zip(pair.tolist(), top.tolist()):
        d, it = divmod(key, len(index.ids))
        a, b = lo[d], lo[d + 1]
        row, i = index.places(term[a:b], it)
        n = int(index.n_tokens[it])
        share = 1.0 if n < SHINGLE else held_share(i.astype(np.int64), place[a:b][row], n)
        if share >= HELD - (SHINGLE - 1) / n:
            own = slice(all_lo[d], all_lo[d + 1])
            answer = has_answer(index.answer[index.answer_off[it]: index.answer_off[it + 1]], hits.place[own], hits.h[own])
            out.append((ids[d], int(index.ids[it]), s, share, answer))
    return out


_FOUND = "doc_id long, item_id long, score double, held double, answer_found boolean"


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, score, held, answer_found: the documents that contain test items, with all items they contain.

    docs: ids and texts; items: item_id, text, and answer if there is one. An item counts as
    contained if a document holds at least HELD of its tokens in one or two pieces, whatever
    its case, accents, line breaks, punctuation or look-alike characters; one of fewer tokens
    than a shingle if the document has it whole. ``score`` is the best of a passage
    against the item, or against one part of an item longer than a passage; ``answer_found``
    tells whether the document has the answer's tokens too, one after the other. Rows
    without id or text, texts without letters and items without any give no row; rows repeated
    under their own id count once; an empty table on either side gives none. The corpus is
    read and tokenised once and is not shuffled. Of items of more than INDEX_CHARS characters
    together, indexes are built in parts, in parallel, and sent one at a time.
    """
    spark = docs.sparkSession
    answer = F.col("answer") if "answer" in items.columns else F.lit(None).cast("string")
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer")).filter("item_id is not null and text is not null")
    tests = tests.groupBy("item_id").agg(F.max(F.struct("text", "answer")).alias("t")).select("item_id", "t.*")
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // INDEX_CHARS))
    size = 1 << min(FILTER_CELLS.bit_length() - 1, max(16, (16 * chars).bit_length()))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id")
        index = Index.of(pdf["item_id"].tolist(), pdf["text"].tolist(), pdf["answer"].tolist())
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "index": [pickle.dumps(index)], "cells": [zlib.compress(np.packbits(index.cells(size)).tobytes(), 1)]})

    built = tests.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int")).groupBy("part").applyInPandas(build, "part int, index binary, cells binary")
    built = materialise(built, "index")
    cells = np.zeros(size // 8, np.uint8)
    for row in built.select("cells").toLocalIterator():  # one part at a time
        cells |= np.frombuffer(zlib.decompress(row[0]), np.uint8)
    cells_of = spark.sparkContext.broadcast(cells)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], Hits]]:
        filter_ = np.unpackbits(cells_of.value).view(bool)
        ids, texts, chars = [], [], 0
        for pdf in batches:
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                ids.append(i)
                texts.append(t)
                chars += len(t)
                if chars >= BATCH_CHARS:
                    yield ids, Hits.of(texts, filter_)
                    ids, texts, chars = [], [], 0
        if ids:
            yield ids, Hits.of(texts, filter_)

    def of_part(part: int):
        row = built.filter(F.col("part") == part).select("index").first()
        return spark.sparkContext.broadcast(row[0]) if row else None

    def told(index, held: Iterator[tuple[list[int], Hits]]) -> Iterator[pd.DataFrame]:
        for ids, hits in held:
            yield pd.DataFrame(_pairs(index, ids, hits), columns=["doc_id", "item_id", "score", "held", "answer_found"])

    if parts == 1:
        whole = of_part(0)
        if whole is None:
            return spark.createDataFrame([], _FOUND)
        found = rows.mapInPandas(lambda batches: told(pickle.loads(whole.value), read(batches)), _FOUND)
    else:
        def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for ids, hits in read(batches):
                at = np.searchsorted(hits.doc, np.arange(len(ids) + 1))
                some = np.nonzero(np.diff(at))[0]
                yield pd.DataFrame({"doc_id": [ids[d] for d in some], "n": hits.n_tokens[some], "place": [hits.place[at[d]: at[d + 1]] for d in some], "h": [hits.h[at[d]: at[d + 1]].view(np.int64) for d in some]})

        hits_of = materialise(rows.mapInPandas(kept, "doc_id long, n long, place array<long>, h array<long>"), "hits")

        def again(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], Hits]]:
            for pdf in batches:
                if len(pdf):
                    sizes = pdf["place"].str.len().to_numpy()
                    yield pdf["doc_id"].tolist(), Hits(np.repeat(np.arange(len(pdf)), sizes), np.concatenate(pdf["place"].tolist()), np.concatenate(pdf["h"].tolist()).view(np.uint64), pdf["n"].to_numpy())

        each = []
        for part in range(parts):
            own = of_part(part)
            if own is not None:
                each.append(materialise(hits_of.mapInPandas(lambda batches, own=own: told(pickle.loads(own.value), again(batches)), _FOUND), f"found{part}"))
                own.unpersist()
        found = reduce(DataFrame.unionByName, each)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("held").alias("held"), F.max("answer_found").alias("answer_found"))
