"""Keyword-stuffed and link-list pages.

Texts are read as sequences of word classes: function words as themselves, other words by
form (and by whether the same content words came before on the page), links, tags, numbers,
runs of ideographs by length, punctuation. An interpolated trigram model over these classes
is trained on the prose lines of the whole corpus. A line is abnormal if its perplexity
lies outside what prose lines of its length have, and a page is flagged if abnormal
lines make up more than half of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.skeleton import skeletons
from lexiloom.session import materialise

#: Share of the page, in characters, that abnormal lines must exceed.
SHARE = 0.5
#: Share of prose lines that may lie above, and below, what counts as normal. Litanies are
#: the most predictable prose, so that abnormally low is below half of their perplexity's logarithm.
ABOVE, BELOW = 0.002, 0.0005
#: A word that is more than one in so many words of the page so far is common on it.
COMMON = 10
#: Longest stretch scored at once; longer lines are scored piece by piece.
STRETCH = 64

# English function words.
FUNCTION_WORDS = (
    "the a an this that these those some every another one no any each all both and or but nor yet so for because although while whereas until unless if "
    "of in on at by to from with without inside beside behind before after above under among against across beyond near into over between about through as than "
    "is was are were be been has had have do did does will would shall should can could may might must not "
    "who whom whose which what when where why how it its he his him she her they their them we our us you your i my me there here said asked replied says").split()

# Function words of romanised Sanskrit, and Tibetan particles of a syllable.
FUNCTION_WORDS += "ca na iti eva tu hi api vā atha tatra yathā tathā sa tad yad".split()
TIBETAN_PARTICLES = frozenset("གི ཀྱི གྱི ཡི གིས ཀྱིས གྱིས ཡིས ལ ན དུ ཏུ རུ སུ ནས ལས དང ཅིང ཞིང ཤིང ཏེ དེ སྟེ ནི ཡང".split())

CLASSES = (
    ["\n", "word", "word+", "word=", "num", "url", "tag", "tag+", "markup", "han1", "han2", "han4", "han8", "han16", "han+", "kana", "hangul", "hangul+", "hangul.", "tibetan", "tibetanf", "letters"]
    + list(".,;:!?…|/*#()[]<>{}\"'-–=&+_%$@~") + ["“", "”", "‘", "’", "«", "»", "。", "，", "、", "；", "：", "！", "？", "「", "」", "『", "』", "（", "）", "།", "༎", "॥", "other"]
)
_AT = {c: i for i, c in enumerate(CLASSES)}
_WORDS_AT = {w: len(CLASSES) + i for i, w in enumerate(FUNCTION_WORDS)}
V = len(CLASSES) + len(_WORDS_AT)

_TOKEN = re.compile(
    r"(?P<markup></?[A-Za-z][^<>\n]{0,300}>|\]\([^()\s]{1,300}\))|(?P<url>\w+://\S+|[\w-]+(?:\.[\w-]+)*\.[a-z]{2,12}(?![\w.])(?:/\S*)?)|(?P<tag>#\w+)"
    "|(?P<han>[一-鿿㐀-䶿]+)|(?P<kana>[぀-ヿ]+)|(?P<hangul>[가-힣]+)|(?P<tibetan>[ཀ-ྼ་]+)|(?P<num>[0-9]+(?:[.,][0-9]+)*)|(?P<word>[^\\W\\d_]+)|(?P<sign>[^\\w\\s])|(?P<line>\n)")
_ENDING = frozenset("다요까은는이가을를에의")


def classes(text: str) -> tuple[list[int], list[int], list[int]]:
    """Class of every token, and for every line its number of tokens and of characters (without white space)."""
    seq: list[int] = []
    tokens_in, chars_in = [], []
    seen: set[str] = set()
    met: set = set()
    times: dict[str, int] = {}
    words = 0
    before = ""
    count = size = 0
    add = seq.append

    def known(t: str | list[str]) -> bool:
        """Whether at least a third of a run's stretches of three came before on the page; the run's are added."""
        own = {t[i: i + 3] if isinstance(t, str) else tuple(t[i: i + 3]) for i in range(len(t) - 2)}
        new = own - met
        met.update(new)
        return len(new) * 3 <= (len(t) - 2) * 2

    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        t = m.group()
        if kind == "line":
            if count:
                tokens_in.append(count)
                chars_in.append(size)
            count = size = 0
            before = ""
            continue
        size += len(t)
        count += 1
        if kind == "word":
            low = t.lower()
            k = _WORDS_AT.get(low)
            words += 1
            if k is not None:
                add(k)
                before = ""
                continue
            again = False
            if before:
                pair = before + " " + low
                again = pair in seen
                seen.add(pair)
            before = low
            n = times[low] = times.get(low, 0) + 1
            add(_AT["word+" if again else "word=" if n > 2 and n * COMMON > words else "word"])
            continue
        if kind == "hangul":
            pair = before + " " + t
            add(_AT["hangul+" if before and pair in seen else "hangul." if t[-1] in _ENDING else "hangul"])
            seen.add(pair)
            before = t
            continue
        before = "" if kind != "num" else before
        if kind == "han":
            n = len(t)
            if n <= 6 and t in seen:
                add(_AT["han+"])
            elif n > 6 and known(t):  # words without anything between them
                seq += [_AT["han+"]] * (n // 3)
                count += n // 3 - 1
            else:
                if n <= 6:
                    seen.add(t)
                add(_AT["han1" if n == 1 else "han2" if n < 4 else "han4" if n < 8 else "han8" if n < 16 else "han16"])
        elif kind == "kana" and len(t) > 2:
            again = t in seen if len(t) < 7 else known(t)
            seen.add(t)
            add(_AT["han+" if again else "kana"])
        elif kind == "tibetan":
            parts = t.strip("་").split("་")
            if len(parts) > 4 and known(parts):
                seq += [_AT["han+"]] * (len(parts) // 2)
                count += len(parts) // 2 - 1
            else:
                add(_AT["tibetan" if TIBETAN_PARTICLES.isdisjoint(parts) else "tibetanf"])
        elif kind == "tag":
            bare = t.rstrip("0123456789")
            add(_AT["tag+" if bare in seen else "tag"])
            seen.add(bare)
        elif kind == "sign":
            add(_AT.get(t, _AT["other"]))
        else:
            add(_AT[kind])
    if count:
        tokens_in.append(count)
        chars_in.append(size)
    return seq, tokens_in, chars_in


_F0 = len(CLASSES)
_AGAIN = np.array([_AT[c] for c in ("word+", "tag+", "han+", "hangul+")])
_LINKS = np.array([_AT[c] for c in ("url", "tag", "tag+", "markup")])
_LATIN = np.array([_AT[c] for c in ("word", "word+", "word=")])


def _pieces(tokens_in: np.ndarray, chars_in: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines cut into stretches of at most STRETCH tokens: tokens and characters of each."""
    parts = -(-tokens_in // STRETCH)
    row = np.repeat(np.arange(len(tokens_in)), parts)
    k = np.arange(len(row)) - (np.cumsum(parts) - parts)[row]
    lo, hi = k * tokens_in[row] // parts[row], (k + 1) * tokens_in[row] // parts[row]
    return hi - lo, (hi - lo) * chars_in[row] / tokens_in[row]


def _spans(seq: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.cumsum(sizes) - sizes
    return start, np.repeat(np.arange(len(sizes)), sizes)


def _is_prose(seq: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches to train on: few repeated words and links, and function words among Latin ones."""
    sums = lambda mask: np.add.reduceat(mask.astype(np.int64), start)
    again, links = sums(np.isin(seq, _AGAIN)), sums(np.isin(seq, _LINKS))
    latin, function = sums(np.isin(seq, _LATIN)), sums(seq >= _F0)
    return (again * 12 <= sizes) & (links * 10 <= sizes) & (function * 6 >= latin)


def _codes(seq: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Trigram code of every token; a stretch begins after two line breaks."""
    a, b = np.zeros_like(seq), np.zeros_like(seq)
    b[1:] = seq[:-1]
    a[2:] = seq[:-2]
    first = np.zeros(len(seq), bool)
    first[start] = True
    b[first] = 0
    second = np.zeros(len(seq), bool)
    second[1:] = first[:-1]
    a[first | second] = 0
    return (a * V + b) * V + seq


def _bucket(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(sizes).astype(np.int64), 5)


BUCKETS, BINS, WIDTH = 6, 400, 0.05


#: Tokens that are scored at a time.
BLOCK = 1 << 21


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of batches in blocks of at most BLOCK tokens, or one row."""
    for pdf in batches:
        group = (pdf["seq"].str.len().cumsum() // BLOCK).to_numpy()
        for k in np.unique(group):
            yield pdf[group == k].reset_index(drop=True)


def _gathered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """seq, stretch sizes, stretch characters, and the row of each stretch."""
    seq = np.frombuffer(b"".join(pdf["seq"]), np.uint8).astype(np.int64)
    sizes, chars, rows = [], [], []
    for i, (n, c) in enumerate(zip(pdf["tokens_in"], pdf["chars_in"])):
        if len(n):
            s, w = _pieces(np.asarray(n, np.int64), np.asarray(c, np.float64))
            sizes.append(s)
            chars.append(w)
            rows.append(np.full(len(s), i))
    if not sizes:
        return seq, *(np.zeros(0, np.int64),) * 3
    return seq, np.concatenate(sizes), np.concatenate(chars), np.concatenate(rows)


def trained(code: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Negative log probabilities of all trigrams, by Witten-Bell interpolation; half of what an unseen context gives is uniform."""
    tri = np.zeros(V * V * V, np.float32)
    tri[code] = count
    tri = tri.reshape(V, V, V)
    bi = tri.sum(0)
    uni = bi.sum(0)
    kinds = np.count_nonzero(uni)
    p1 = (uni + kinds / V) / max(uni.sum() + kinds, 1.0) if kinds else np.full(V, 1.0 / V)
    t2 = np.count_nonzero(bi, axis=1)[:, None]
    p2 = (bi + (t2 + 1) * p1[None, :] + 1 / V) / (bi.sum(1, keepdims=True) + t2 + 2)
    t3 = np.count_nonzero(tri, axis=2)[:, :, None]
    p3 = (tri + (t3 + 1) * p2[None, :, :] + 1 / V) / (tri.sum(2, keepdims=True) + t3 + 2)
    return -np.log(np.maximum(p3, 1e-9)).astype(np.float32).reshape(-1)


def class_sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, seq (a byte a token), tokens_in and chars_in (by line)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [classes(t) for t in skeletons(pdf["text"].tolist())]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "seq": [bytes(s) for s, _, _ in got], "tokens_in": [n for _, n, _ in got], "chars_in": [c for _, _, c in got]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    return rows.mapInPandas(run, "doc_id long, seq binary, tokens_in array<int>, chars_in array<int>")


def _train(sequences: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            seq, sizes, _, _ = _gathered(pdf)
            if len(sizes):
                start, own = _spans(seq, sizes)
                code, n = np.unique(_codes(seq, start)[_is_prose(seq, start, sizes)[own]], return_counts=True)
                yield pd.DataFrame({"code": code, "n": n})

    # At most V ** 3 rows of 12 bytes, whatever the corpus.
    counts = sequences.mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).select(F.col("code").cast("int"), "n").toArrow()
    return trained(counts["code"].to_numpy(), counts["n"].to_numpy())


def _score(pdf: pd.DataFrame, model: np.ndarray):
    seq, sizes, chars, rows = _gathered(pdf)
    if not len(sizes):
        return None
    start, _ = _spans(seq, sizes)
    mean = np.add.reduceat(model[_codes(seq, start)], start) / sizes
    return seq, start, sizes, chars, rows, mean


def _normal(sequences: DataFrame, model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By length bucket the lowest and highest mean score of prose, and how far its tail goes on, from a histogram of all prose lines.

    The tail is the way to what is rare from what is ten times as frequent.
    """

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            got = _score(pdf, model.value)
            if got:
                seq, start, sizes, _, _, mean = got
                ok = _is_prose(seq, start, sizes)
                at = _bucket(sizes[ok]) * BINS + np.minimum((mean[ok] / WIDTH).astype(np.int64), BINS - 1)
                k, n = np.unique(at, return_counts=True)
                yield pd.DataFrame({"k": k, "n": n})

    rows = sequences.mapInPandas(binned, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    hist = np.zeros(BUCKETS * BINS)
    for k, n in rows:
        hist[k] = n
    hist = hist.reshape(BUCKETS, BINS)
    total = hist.sum(1, keepdims=True)
    share = np.cumsum(hist, 1) / np.maximum(total, 1)
    low = np.where(total[:, 0] > 0, (share <= BELOW).sum(1) * WIDTH / 2, 0.0)
    high, usual = (np.where(total[:, 0] > 0, ((share < 1 - x).sum(1) + 1) * WIDTH, np.inf) for x in (ABOVE, 10 * ABOVE))
    with np.errstate(invalid="ignore"):
        tail = np.where(np.isfinite(high), high - usual, 0.0)
    for k in range(BUCKETS - 2, -1, -1):  # without prose of a length, that of the next length counts
        if not total[k, 0]:
            low[k], high[k], tail[k] = low[k + 1], high[k + 1], tail[k + 1]
    return low, high, tail


def page_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, perplexity, abnormal_share of every page.

    The share is that of the characters (white space aside) that stand in lines of
    abnormal perplexity. Rows without id or text give no row; a text without any sign has
    perplexity null and share 0; rows repeated under an id give a row each. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    sequences = materialise(class_sequences(docs, doc_id, text), "classes")
    model = spark.sparkContext.broadcast(_train(sequences))
    low, high, tail = _normal(sequences, model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            n = len(pdf)
            sums, tokens, odd, every = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
            got = _score(pdf, model.value)
            if got:
                _, _, sizes, chars, rows, mean = got
                k = _bucket(sizes)
                # A page of few stretches is judged by few, and so must lie further out.
                off = (mean > high[k] + tail[k] / np.bincount(rows)[rows]) | (mean < low[k])
                np.add.at(sums, rows, mean * sizes)
                np.add.at(tokens, rows, sizes)
                np.add.at(every, rows, chars)
                np.add.at(odd, rows, chars * off)
            with np.errstate(invalid="ignore", divide="ignore"):
                ppl = pd.Series(np.exp(sums / tokens)).where(tokens > 0, None)
                share = np.where(every > 0, odd / np.maximum(every, 1e-9), 0.0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "perplexity": ppl, "abnormal_share": share})

    return sequences.mapInPandas(scored, "doc_id long, perplexity double, abnormal_share double")


def stuffed_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """page_scores of the pages of which more than SHARE is abnormal."""
    return page_scores(docs, doc_id, text).filter(F.col("abnormal_share") > SHARE)
