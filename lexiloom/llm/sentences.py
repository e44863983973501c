"""Sentence boundaries across languages and scripts.

The boundary rules are compiled into a finite transducer. A lexer, which looks at most
CONTEXT characters to either side of a run of marks, turns a text into symbols (ends,
openings, closings, paragraph breaks, wide spaces); the transducer's state is the stack of
open quotes and brackets; its output are boundaries, marked with whether a quotation was
open. At the end of a paragraph its boundaries are settled: those outside quotations, or
all of them if a quotation was left open; wide spaces in a paragraph without sentence marks.

Every document is cut into chunks, between two letters, where no run of marks and no white
space can lie. Each chunk is a function from the state before it to the state after it; the
functions are composed by a parallel prefix scan (doubling), which gives each chunk its
first state, and then all chunks run at once. Paragraphs within a chunk are settled there,
those that go over chunks from what their chunks have of them: marks, not text.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.skeleton import skeletons
from lexiloom.session import materialise

#: Characters of a chunk, up to the next place for a cut, and those the lexer may look at before and after it.
CHUNK = 1 << 12
CONTEXT = 96
AHEAD = 64

# Quotes and brackets that pair, by type.
PAIRS = ("“”", "‘’", "«»", "「」", "『』", "()", '""', "<>")
BRACKET, STRAIGHT, ASIDE = 5, 6, 7  # ASIDE: a bracket opened where a sentence begins
#: Open ones that are told apart by kind, and further ones that are counted.
DEPTH, OVER = 3, 4

# Words before a full stop that does not end a sentence.
ALWAYS = frozenset("st mr mrs ms mss dr rev ven prof vs cf i.e e.g viz ed eds tr trans fol fols hon gen".split())
BEFORE_NUMBER = frozenset("vol vols no nos p pp fig figs ca c b d r fl ch chap sec art l ll f ff n nn t x j o s ibid bk".split())
# Shortened words that may also close a sentence.
MAYBE = frozenset("jr sr etc al c.e b.c.e a.d b.c a.m p.m inc ltd co ibid fols".split())
# Words that begin a sentence rather than go on with one.
STARTERS = frozenset(
    "a an the this that these those some every no one another in on at see it he she they we who why where when how what which according section there here if as".split())
# Those that begin one even in lower case, after a word that may be shortened.
DETERMINERS = frozenset("a an the this that some every no another one see".split())

_EVENT = re.compile('[\n  .．…!?。！？｡།-༒༔|॥/　“”‘’«»「」『』()（）［］\\[\\]"＂]')
_WORD = re.compile(r"([A-Za-zÀ-ɏḀ-ỿ]+(?:\.[A-Za-zÀ-ɏḀ-ỿ]+)*)\n?$")
_NUMBERING = r"\s*(?:(?:chapter|part|book|section|vol|no)\.?\s+)?(?:\d+(?:\.\d+)*|[ivxlcdm]+|[a-h])$"
_ENUM = (re.compile(r"(?:^|\n)" + _NUMBERING, re.I), re.compile(r"(?:^|\n[^\S\n]*\n)" + _NUMBERING, re.I))  # by layout
_DOTS = tuple(re.compile(rf"(?:\.(?:{b}\.){{2,}}|[.．…!?。！？｡]+(?:{b}?[.!?。！？])*)") for b in (r"[^\S\n]", r"\s"))  # by layout
_SHADS = re.compile(r"[།-༒༔]+(?:[  ]*[།-༒༔]+)*")
_STROKES = re.compile(r"(?:\|\||॥|//)(?:\s{0,3}[0-9०-९]{1,6}\s{0,3}(?:\|\||॥|//))?")
_CLOSERS = re.compile("[”’»」』)）\\]］\"＂]+")
_BLANKLINE = re.compile(r"\n[^\S\n]*\n\s*")
_NEXTWORD = re.compile(r"[^\W\d_]{1,24}")
_CJK = re.compile("[⺀-⿟぀-㆏㐀-䶿一-鿿豈-﫿\U00020000-\U000323af]")
_WIDE_FORMS = re.compile("[\uff10-\uff5a]")
_MARKS = re.compile("[。！？｡!?]")
_UNSEEN = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufe00\ufe01\ufeff\U000e0100\U000e0101"
OUTER = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + _UNSEEN
_OUTER_SET = frozenset(OUTER)
_HARD = frozenset("!?。！？｡")
_ENDS = frozenset(".．…!?。！？｡")

PARA, END, WIDE = 0, 1, 2


def _past(text: str, i: int) -> int:
    """The next place whose character is seen."""
    while i < len(text) and text[i] in _UNSEEN:
        i += 1
    return i


def _symbol(kind: int, what: int) -> int:
    """what: 0 opening, 1 closing, 2 closing right after an end, with a sentence beginning after it."""
    return 3 + 3 * kind + what


@functools.lru_cache(1)
def transducer() -> tuple[list[list[int]], list[list[str]]]:
    """NEXT[state][symbol] and OUT[state][symbol]; state 0 is the empty stack.

    Outputs: '' nothing, 'o' boundary outside quotations, 'i' inside, 'w' wide space,
    'p' paragraph closed in order, 'u' closed with a quotation open.
    """
    stacks = [s for n in range(DEPTH + 1) for s in itertools.product(range(len(PAIRS)), repeat=n)]
    states = [(s, 0) for s in stacks] + [(s, more) for s in stacks if len(s) == DEPTH for more in range(1, OVER + 1)]
    number = {s: i for i, s in enumerate(states)}
    nexts, outs = [], []
    for i, (s, more) in enumerate(states):
        to, out = [0, i, i], ["u" if s else "p", "i" if s else "o", "w"]
        for kind in range(len(PAIRS)):
            to.append(number[(s + (kind,), 0) if len(s) < DEPTH else (s, min(more + 1, OVER))])
            out.append("")
            if more:  # the innermost one, of whatever kind
                to += [number[s, more - 1]] * 2
                out += ["", "i"]
                continue
            # A closing pops down to its opening; one that was never opened changes nothing.
            match = [k for k, x in enumerate(s) if x == kind or kind == BRACKET and x == ASIDE]
            rest = s[: match[-1]] if match else s
            aside = bool(match) and s[match[-1]] == BRACKET
            to += [number[rest, 0]] * 2
            out += ["", "" if aside else ("i" if rest else "o")]
        nexts.append(to)
        outs.append(out)
    return nexts, outs


_KIND = {c: (k, j) for k, pair in enumerate(PAIRS[:6]) for j, c in enumerate(pair)}
_KIND |= {"（": (BRACKET, 0), "）": (BRACKET, 1), "[": (BRACKET, 0), "]": (BRACKET, 1), "［": (BRACKET, 0), "］": (BRACKET, 1)}


def _ideographic(ch: str) -> bool:
    return "⺀" <= ch <= "鿿" or "豈" <= ch <= "﫿" or "\U00020000" <= ch <= "\U000323af"


def _begins(text: str, at: int, wrapped: bool) -> bool:
    """Whether a sentence may begin after a closing quote that ends at ``at``."""
    n, i = len(text), at
    while i < n and (text[i].isspace() or text[i] in _UNSEEN):
        if text[i] == "\n" and not wrapped:
            return True
        i += 1
    if i == n:
        return True
    ch = text[i]
    if ch in "，、；：,;:…-–—.・" or ch in "と라고":
        return False
    if ch in ")）」』”’»":
        return False
    if _ideographic(ch) or ch in "“‘«「『(（":
        return True
    if "가" <= ch <= "힣":
        return i > at
    if ch.islower():
        return False
    return i > at or not ch.isalpha()


def _stop(text: str, i: int, end: int, wrapped: bool) -> bool:
    """Whether the full stop text[i:end] can end a sentence."""
    n = len(text)
    end = _past(text, end)
    after = text[end] if end < n else "\n"
    before = text[i - 1] if i else "\n"
    if not after.isspace() and not _CLOSERS.match(after):
        return _ideographic(after) and (_ideographic(before) or "가" <= before <= "힣") and end - i >= 1
    j = end
    while j < n and (text[j].isspace() or text[j] in _UNSEEN) and j - end < CONTEXT:
        j += 1
    following = text[j] if j < n else ""
    left = text[max(0, i - CONTEXT): i]
    if wrapped and text[end: end + 1] == "\n" and following.isdigit() and j == end + 1 and re.search(r"[^\x00-ɏ]\s?\d{1,4}$", left):
        return False  # a decimal cut by the line
    if i > CONTEXT:
        left = "\0" + left  # not the beginning
    if _WIDE_FORMS.search(left):
        left = unicodedata.normalize("NFC", skeletons([left])[0])
    if _ENUM[wrapped].search(left):
        return False
    m = _WORD.search(left)
    k = m.start(1) - 1 if m else len(left) - 1
    if k >= 0 and (left[k] in _UNSEEN or left[k].isalpha() and not _ideographic(left[k]) and not "가" <= left[k] <= "힣"):
        left = unicodedata.normalize("NFC", skeletons([left])[0])  # letters of another shape or hidden signs within the word
        m = _WORD.search(left)
    if not m:
        return not (before.isspace() and following.isdigit())
    word = m.group(1).lower()
    upper = m.group(1)
    if following.isdigit() and (word in BEFORE_NUMBER or len(word) == 1):
        return False
    if word in ALWAYS and word not in MAYBE:
        return False
    nxt = _NEXTWORD.match(text, j)
    starter = nxt is not None and nxt.group().lower() in STARTERS
    if word in MAYBE:
        return not following or not following.islower() or nxt is not None and nxt.group() in DETERMINERS
    if len(upper) == 1 and upper not in "ai" and upper.isascii() and (m.start(1) == 0 or not left[m.start(1) - 1].isalnum() or _ideographic(left[m.start(1) - 1])):
        return not following or starter or not following.isalpha()
    return True


def symbols(text: str, wrapped: bool, begin: int = 0, stop: int | None = None) -> list[tuple[int, int, int]]:
    """(symbol, end of the unit before, first place after) in text[begin:stop]; what lies outside is context."""
    out: list[tuple[int, int, int]] = []
    n, skip = len(text), begin
    stop = n if stop is None else stop
    for m in _EVENT.finditer(text, begin, stop):
        i = m.start()
        if i < skip:
            continue
        ch = text[i]
        if ch in "\n  ":
            if wrapped and ch == "\n":
                blank = _BLANKLINE.match(text, i)
                if not blank:
                    continue
                skip = blank.end()
            out.append((PARA, i, max(skip, i + 1)))
        elif ch in _ENDS:
            run = _DOTS[wrapped].match(text, i)
            end = skip = run.end()
            cluster = run.group()
            if not _HARD.isdisjoint(cluster):
                seen = _past(text, end)
                after = text[seen] if seen < n else "\n"
                wide = not cluster.isascii()
                ok = wide or after.isspace() or _ideographic(after) or after in "“‘«「『（" or bool(_CLOSERS.match(after))
            elif cluster in (".", "．"):
                ok = _stop(text, i, end, wrapped)
            else:  # an ellipsis ends a sentence only if another begins
                j = end
                while j < n and text[j].isspace():
                    j += 1
                ok = "……" not in cluster and j > end and j < n and (text[j].isupper() or text[j] in "“‘«\"")
                if ok and len(cluster) > 3 and cluster[-2].isspace():
                    ok = text[j].isupper()
            if ok:
                closers = _CLOSERS.match(text, end)
                out.append((END, end, closers.end() if closers else end))
        elif "།" <= ch <= "༔":
            run = _SHADS.match(text, i)
            skip = run.end()
            out.append((END, skip, skip))
        elif ch in "|॥/":
            run = _STROKES.match(text, i)
            if run and (ch != "/" or i == 0 or text[i - 1].isspace()):
                skip = run.end()
                out.append((END, skip, skip))
        elif ch == "　":
            out.append((WIDE, i, i + 1))
        else:
            j = i
            while j and text[j - 1] in _UNSEEN:
                j -= 1
            before = text[j - 1] if j else "\n"
            if ch in '"＂':
                kind, closing = STRAIGHT, int(not (before.isspace() or before in "([（［“‘«「『"))
            else:
                kind, closing = _KIND[ch]
            if ch == "’" and before.isalpha() and i + 1 < n and text[i + 1].isalpha():
                continue
            if not closing:
                if kind == BRACKET:
                    j = i
                    while j and (text[j - 1].isspace() or text[j - 1] in _UNSEEN):
                        j -= 1
                    if j == 0 or text[j - 1] in "!?。！？.":
                        kind = ASIDE
                out.append((_symbol(kind, 0), i, i))
            else:
                j = i
                while j and (text[j - 1] == "\n" and wrapped or text[j - 1] in "”’»」』" or text[j - 1] in _UNSEEN):
                    j -= 1
                ended = j > 0 and text[j - 1] in _ENDS
                out.append((_symbol(kind, 2 if ended and _begins(text, i + 1, wrapped) else 1), i + 1, i + 1))
    return out


def cuts(text: str, chunk: int) -> list[int]:
    """Where the chunks of a text begin, and its end. A cut lies between two letters."""
    out, n, at = [0], len(text), chunk
    while at < n:
        while at < n and not (text[at - 1].isalpha() and text[at].isalpha()):
            at += 1
        if at < n:
            out.append(at)
        at += chunk
    return [*out, n]


def run(symbols_: list[int], state: int = 0) -> tuple[str, int]:
    """Output of each symbol, ``-`` for none, and the last state."""
    nexts, outs = transducer()
    result = []
    for symbol in symbols_:
        result.append(outs[state][symbol] or "-")
        state = nexts[state][symbol]
    return "".join(result), state


@functools.lru_cache(1)
def _next_array() -> np.ndarray:
    return np.array(transducer()[0], np.int16)


def chunk_function(symbols_: list[int]) -> list[int]:
    """State after the symbols by state before them."""
    nexts = _next_array()
    f = np.arange(len(nexts))
    for symbol in symbols_:
        f = nexts[f, symbol]
    return f.tolist()


def _left(text: str, at: int, floor: int) -> int:
    """The end of what is seen before ``at``."""
    while at > floor and text[at - 1].isspace():
        at -= 1
    return at


def _right(text: str, at: int) -> int:
    """The begin of what is seen from ``at``."""
    n = len(text)
    while at < n and text[at] in _OUTER_SET:
        at += 1
    return at


@dataclass
class Lexed:
    """A chunk without its text: symbols, where the unit before each ends and the next begins, and of each stretch between paragraph breaks whether it has marks (1) and ideographs (2)."""

    first: int
    symbols: list[int]
    ends: list[int]
    begins: list[int]
    has: list[int]


def lexed(text: str, wrapped: bool, begin: int, stop: int, off: int, last: bool) -> Lexed:
    """text[begin:stop] as a chunk; places count from ``off`` before the text. The end of a text closes its paragraph."""
    out = Lexed(_right(text, begin) + off, [], [], [], [])
    events = symbols(text, wrapped, begin, stop)
    if last:
        events.append((PARA, stop, stop))
    since, wide = begin, False
    for symbol, e, b in events:
        cut = e if symbol in (PARA, WIDE) else max(e, b)
        out.symbols.append(symbol)
        out.ends.append(_left(text, cut, begin) + off)
        out.begins.append(_right(text, b if symbol in (PARA, WIDE) else cut) + off)
        wide = wide or symbol == WIDE
        if symbol == PARA:
            out.has.append(_has(text, since, e) if wide or not out.has else 0)
            since, wide = b, False
    out.has.append(_has(text, since, stop))
    return out


def _has(text: str, a: int, b: int) -> int:
    return (_MARKS.search(text, a, b) is not None) + 2 * (_CJK.search(text, a, b) is not None)


def settled(first: int, outputs: str, ends: list[int], begins: list[int], has: int) -> list[tuple[int, int]]:
    """Units of a paragraph that begins at ``first``; its last output, ``p`` or ``u``, is its end."""
    units: list[tuple[int, int]] = []
    at, whole = first, outputs[-1] == "p"
    by_space = "w" in outputs and has == 2
    for k, e, b in zip(outputs, ends, begins):
        if k == "-" or (k not in "wpu" if by_space else k == "w" or k == "i" and whole):
            continue
        if e > at:
            units.append((at, e))
        at = max(at, b)
    return units


def _parted(chunk: Lexed, outputs: str) -> tuple[list[tuple[int, int]], list[tuple[int, str, list[int], list[int], int]]]:
    """Units of the paragraphs that lie within the chunk, or end its document's first; and what it has of others: (first, outputs, ends, begins, has), the head before the tail."""
    units, pieces, since, first = [], [], 0, chunk.first
    breaks = [i for i, k in enumerate(outputs) if k in "pu"]
    for n, i in enumerate([*breaks, len(outputs) - 1]):
        closed = n < len(breaks)
        piece = (first, outputs[since: i + 1], chunk.ends[since: i + 1], chunk.begins[since: i + 1], chunk.has[n])
        if closed and n:
            units += settled(*piece)
        else:
            pieces.append(piece)
        if closed:
            since, first = i + 1, chunk.begins[i]
    return units, pieces


def units(text: str, wrapped: bool) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit of a text, as one chunk."""
    chunk = lexed(text, wrapped, 0, len(text), 0, True)
    outputs, _ = run(chunk.symbols)
    within, (head, *_) = _parted(chunk, outputs)
    return settled(*head) + within


_UNITS = "doc_id long, starts array<int>, ends array<int>"


def _short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, starts, ends = [], [], []
        for i, t, w in zip(pdf["doc_id"], pdf["text"], pdf["wrapped"]):
            u = units(t, w)
            ids.append(i)
            starts.append([a for a, _ in u])
            ends.append([b for _, b in u])
        yield pd.DataFrame({"doc_id": ids, "starts": starts, "ends": ends})


def _long(rows: DataFrame, chunk: int) -> DataFrame:
    """row, doc_id, sent_start, sent_end of texts of several chunks: chunks as functions, a prefix scan of them, and the chunks' outputs from their first states."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r, i, t, w in zip(pdf["row"], pdf["doc_id"], pdf["text"], pdf["wrapped"]):
                at = cuts(t, chunk)
                off = [max(0, a - CONTEXT - 1) for a in at[:-1]]
                n = len(off)
                yield pd.DataFrame({"row": [r] * n, "doc_id": [i] * n, "wrapped": [w] * n, "k": range(n), "off": off, "begin": at[:-1], "stop": at[1:], "last": [k == n - 1 for k in range(n)],
                                    "text": [t[o: b + AHEAD] for o, b in zip(off, at[1:])]})

    pieces = rows.withColumn("row", F.monotonically_increasing_id()).mapInPandas(cut, "row long, doc_id long, wrapped boolean, k int, off int, begin int, stop int, last boolean, text string")
    pieces = materialise(pieces, "chunks")
    read = "row long, doc_id long, k int, first int, symbols array<int>, ends array<int>, begins array<int>, has array<int>, breaks boolean, f array<short>"

    def lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [lexed(t, w, a - o, b - o, o, z) for t, w, a, b, o, z in zip(pdf["text"], pdf["wrapped"], pdf["begin"], pdf["stop"], pdf["off"], pdf["last"])]
            yield pdf[["row", "doc_id", "k"]].assign(
                first=[x.first for x in got], symbols=[x.symbols for x in got], ends=[x.ends for x in got], begins=[x.begins for x in got], has=[x.has for x in got],
                breaks=[PARA in x.symbols for x in got], f=[chunk_function(x.symbols) for x in got])

    chunks = materialise(pieces.repartition("row", "k").mapInPandas(lex, read), "lexed")
    scan = chunks.select("row", "k", "f")
    most = scan.agg(F.max("k")).first()[0] or 0
    step = 1
    while step <= most:
        prior = scan.select("row", (F.col("k") + step).alias("k"), F.col("f").alias("g"))
        scan = materialise(
            scan.join(prior, ["row", "k"], "left").select("row", "k", F.when(F.col("g").isNull(), F.col("f")).otherwise(F.expr("transform(g, s -> f[s])")).alias("f")), f"scan{step}")
        step *= 2
    first = scan.select("row", (F.col("k") + 1).alias("k"), F.col("f")[0].alias("state"))
    # The paragraph that is open where a chunk begins, by number.
    before = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    opened = chunks.select("row", "k", F.coalesce(F.sum(F.col("breaks").cast("int")).over(before), F.lit(0)).alias("paragraph"))
    told = chunks.drop("f", "breaks").join(first, ["row", "k"], "left").fillna(0, ["state"]).join(opened, ["row", "k"])
    told_as = "row long, doc_id long, k int, paragraph long, first int, outputs string, ends array<int>, begins array<int>, has int"

    def outputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                c = Lexed(r.first, list(r.symbols), list(map(int, r.ends)), list(map(int, r.begins)), list(map(int, r.has)))
                within, parts = _parted(c, run(c.symbols, r.state)[0])
                if within:  # settled already: the starts and ends of units
                    out.append((r.row, r.doc_id, r.k, -1, 0, None, [b for _, b in within], [a for a, _ in within], 0))
                out += [(r.row, r.doc_id, r.k, r.paragraph + n, *piece) for n, piece in enumerate(parts)]
            yield pd.DataFrame(out, columns=["row", "doc_id", "k", "paragraph", "first", "outputs", "ends", "begins", "has"])

    told = materialise(told.mapInPandas(outputs, told_as), "told")
    done = told.filter("paragraph < 0").select("row", "doc_id", F.explode(F.arrays_zip("begins", "ends")).alias("u")).select("row", "doc_id", F.col("u.begins").alias("sent_start"), F.col("u.ends").alias("sent_end"))
    whole = told.filter("paragraph >= 0").groupBy("row", "doc_id", "paragraph").agg(F.sort_array(F.collect_list(F.struct("k", "first", "outputs", "ends", "begins", "has"))).alias("pieces"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r, i, parts in zip(pdf["row"], pdf["doc_id"], pdf["pieces"]):
                kinds = "".join(p["outputs"] for p in parts)
                if kinds and kinds[-1] in "pu":
                    has = functools.reduce(lambda a, p: a | p["has"], parts, 0)
                    got = settled(int(parts[0]["first"]), kinds, [int(x) for p in parts for x in p["ends"]], [int(x) for p in parts for x in p["begins"]], has)
                    out += [(r, i, a, b) for a, b in got]
            yield pd.DataFrame(out, columns=["row", "doc_id", "sent_start", "sent_end"])

    return done.unionByName(whole.mapInPandas(joined, "row long, doc_id long, sent_start int, sent_end int"))


def sentence_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", layout: str = "layout", chunk: int = CHUNK) -> DataFrame:
    """doc_id, sent_no, sent_start, sent_end: every document's sentence units in order.

    Offsets count code points from 0, end exclusive, without outer white space. In layout
    ``wrapped`` only a blank line parts paragraphs, in any other every line break does.
    Rows without id or text and texts of white space have no unit; rows that come twice are
    segmented twice, with texts of their own or the same. An empty table gives no rows. A text
    of up to ``chunk`` characters is one chunk; where a text is cut does not change its units.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.coalesce(F.col(layout), F.lit("")) == "wrapped").alias("wrapped"))
    rows = rows.filter("doc_id is not null and text is not null")
    every = rows.filter(F.length("text") <= chunk).mapInPandas(_short, _UNITS)
    every = every.select("doc_id", F.posexplode(F.arrays_zip("starts", "ends")).alias("sent_no", "u")).select(
        "doc_id", "sent_no", F.col("u.starts").alias("sent_start"), F.col("u.ends").alias("sent_end"))
    above = rows.filter(F.length("text") > chunk)
    if not above.isEmpty():
        number = F.row_number().over(Window.partitionBy("row").orderBy("sent_start")) - 1
        every = every.unionByName(_long(above, chunk).withColumn("sent_no", number).select("doc_id", "sent_no", "sent_start", "sent_end"))
    return every
