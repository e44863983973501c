"""One stored form for text that looks the same.

The skeleton of a text: decompose, replace every character by the prototype of its
shape, decompose again. What stays visible stays apart: letter case, accents, simplified
forms, raised and circled signs. The built-in table of shapes is short; ``public_table``
is the whole public one.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import materialise

# Pairs of a character and the prototype of its shape, after the public
# table of confusable characters, for the scripts that stand beside each other here.
LOOK_ALIKE = {
    # Cyrillic capitals and small letters shaped as Latin ones
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S",
    "Т": "T", "Х": "X", "Ү": "Y", "У": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "ү": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "γ": "y", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Տ": "S", "Օ": "O",
    # Latin letters of the same shape
    "ɑ": "a", "ɡ": "g", "ı": "i", "ſ": "f",
    # kana shaped as ideographs, and as each other
    "エ": "工", "カ": "力", "タ": "夕", "ト": "卜", "ニ": "二", "ハ": "八", "ロ": "口", "ー": "一", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ", "リ": "り", "〇": "○", "⼝": "口",
    # dashes, dots and strokes
    "‐": "-", "‑": "-", "‒": "–", "−": "–", "·": "・", "‧": "・", "•": "・", "∙": "・", "⋅": "・", "।": "|", "∣": "|", "ǀ": "|", "｜": "|", "॥": "||", "‖": "||", "༎": "།།",
    "․": ".", "‚": ",", "⁄": "/", "∕": "/", "∶": ":", "։": ":", "׃": ":", "˸": ":", "꞉": ":", "ǃ": "!", "∗": "*", "˂": "<", "˃": ">",
}

# Compatibility forms that are seen as such and so stay apart.
VISIBLE = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")

_KEPT_BLANKS = "\n\r\x0b\x0c\x85  "


def _decompose(ch: str) -> str:
    """Full decomposition of a character, but of forms that are seen as such."""
    rule = unicodedata.decomposition(ch)
    if not rule:
        return unicodedata.normalize("NFD", ch) if "가" <= ch <= "힣" else ch
    if rule.startswith(VISIBLE):
        return ch
    parts = rule.split(">")[-1].split()
    if rule.startswith("<compat>") and len(parts) > 1 and "0028" in (parts[0], parts[-1].lstrip()):
        return ch  # bracketed signs
    return "".join(_decompose(chr(int(x, 16))) for x in parts)


def _blank_or_unseen(ch: str) -> str | None:
    """' ' for a blank, '' for what is not seen, None for all else."""
    kind = unicodedata.category(ch)
    if ch not in _KEPT_BLANKS and (kind == "Zs" or ch == "\t"):
        return " "
    if kind == "Cf" or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef" or ch in "͏ᅟᅠㅤﾠ឴឵᠋᠌᠍":
        return ""
    return None


def public_table(spark: SparkSession) -> dict[str, str]:
    """The public table of confusable characters, as the Unicode library that comes with Spark holds it: character, prototype.

    Characters that decompose are left out, their parts are listed. About 5,000 entries.
    """
    listed = [c for c in map(chr, range(0x21, 0x32000)) if unicodedata.category(c) not in ("Cs", "Co", "Cn") and unicodedata.normalize("NFD", c) == c]
    found = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(listed)).split("\n")
    return {c: to for c, to in zip(listed, found) if to and to != c}


def prototypes(table: dict[str, str] | None = None) -> dict[str, str]:
    """What each character becomes, where it is not itself: decomposed, by prototype, decomposed again.

    table: character and prototype, beside LOOK_ALIKE, which goes first. Characters that any entry or
    decomposition makes equal are one class and become the same.
    """
    listed = [*range(0x80, 0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x32000)]
    pairs: list[tuple[str, str]] = []
    direct: dict[str, str] = {"\t": " "}
    for ch in map(chr, [*listed, *range(0xE0000, 0xE01F0)]):
        blank = _blank_or_unseen(ch)  # blanks and invisible signs first: some decompose into a blank and a mark
        to = _decompose(ch) if blank is None else blank
        if to == ch:
            continue
        if blank is not None or "가" <= ch <= "힣" or not unicodedata.decomposition(ch).startswith("<") and len(to) > 1:
            direct[ch] = to  # and pieces that nothing else is equal to
        else:
            pairs.append((ch, to))
    parted = {a for a, _ in pairs}  # decomposition goes before shape
    pairs += [x for x in ((table or {}) | LOOK_ALIKE).items() if x[0] not in parted]
    up: dict[str, str] = {}
    known = set(LOOK_ALIKE.values())

    def head(c: str) -> str:
        while c in up:
            c = up[c]
        return c

    for a, b in pairs:
        b = direct.get(b, b)
        if len(b) == 1 and a not in direct and b not in direct and head(a) != head(b):
            # Of a class a small ASCII letter stands for all, then another ASCII character, a prototype, the least.
            x, y = sorted((head(a), head(b)), key=lambda c: (not c.isascii(), not c.islower(), c not in known, c))
            up[y] = x
    several: dict[str, str] = {}
    for a, b in pairs:
        if len(b) > 1 and a not in direct and head(a) not in map(head, b):  # a mark beside its spacing form stays itself
            several.setdefault(head(a), b)

    def becomes(text: str, within: tuple[str, ...]) -> str:
        out = []
        for c in text:
            h = head(c)
            if c in direct:
                out.append(becomes(direct[c], within) if len(direct[c]) > 1 else direct[c])
            elif h in several and h not in within:
                out.append(becomes(several[h], (*within, h)))
            else:
                out.append(_decompose(h))
        return "".join(out)

    own = {*direct, *(a for a, _ in pairs), *up.values(), *several, *up}
    return {c: to for c in own if unicodedata.category(c) != "Cs" and (to := becomes(c, ())) != c}


def _arrays(table: dict[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: number of characters it becomes, where they begin in a flat list, that list, and whether it is a mark."""
    top = 0x110000
    size, start, mark = np.ones(top, np.int8), np.arange(top, dtype=np.int32), np.zeros(top, bool)
    more: list[int] = []
    for cp in range(0x300, 0x20000):
        mark[cp] = unicodedata.combining(chr(cp)) > 0
    for c, to in table.items():
        size[ord(c)], start[ord(c)] = len(to), top + len(more)
        more += map(ord, to)
    return size, start, np.concatenate([np.arange(top, dtype=np.uint32), np.array(more, np.uint32)]), mark


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _arrays(prototypes())


_made: dict[int, tuple] = {}


def _tables_of(table: dict[str, str] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arrays of a table of prototypes, made once in a Python worker."""
    if table is None:
        return _tables()
    name = zlib.crc32(repr(sorted(table.items())).encode())
    if name not in _made:
        _made.clear()
        _made[name] = _arrays(table)
    return _made[name]


#: Characters that go through the table at a time.
BLOCK = 1 << 21


def skeletons(texts: list[str], tables: tuple | None = None) -> list[str]:
    """Skeletons of many texts at once, by table over their code points."""
    tables = tables or _tables()
    out: list[str] = []
    block, total = [], 0
    for t in texts:
        block.append(t)
        total += len(t)
        if total >= BLOCK:
            out += _skeletons(block, tables)
            block, total = [], 0
    return out + _skeletons(block, tables) if block else out


def _skeletons(texts: list[str], tables: tuple) -> list[str]:
    size, start, flat, mark = tables
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    n = size[cp]
    begin = start[cp]
    if (n == 1).all():
        out, at = flat[begin], ends
    else:
        total = np.cumsum(n, dtype=np.int64)
        first = np.repeat(begin - np.concatenate([[0], total[:-1]]), n)
        out = flat[first + np.arange(len(first))]
        at = np.concatenate([[0], total])[ends]
    whole = out.tobytes().decode("utf-32-le", "surrogatepass")
    m = mark[out]
    stacked = np.concatenate([[0], np.cumsum(m[1:] & m[:-1]), [0]])[: len(out) + 1] if len(out) else np.zeros(1, int)
    result, a = [], 0
    for b in at.tolist():
        t = whole[a:b]
        if b > a and stacked[b - 1] > stacked[a]:  # several marks in a row: put them in canonical order
            t = unicodedata.normalize("NFD", t)
        result.append(t)
        a = b
    return result


def _udf(kind: T.DataType, of: Callable[[str], object], table: dict[str, str] | None) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = _tables_of(table)
        for s in texts:
            has = s.notna()
            out = pd.Series([None] * len(s), dtype=object)
            out[has.to_numpy()] = [of(t) for t in skeletons(s[has].tolist(), tables)]
            yield out

    return run


def skeleton(text: Column | str, table: dict[str, str] | None = None) -> Column:
    """The skeleton as a column; null for null, '' for ''. table: as of ``prototypes``, the built-in one by default."""
    return _udf(T.StringType(), str, table)(text)


def _key(text: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def skeleton_key(text: Column | str, table: dict[str, str] | None = None) -> Column:
    """128-bit key of the skeleton, so that texts need not travel."""
    return _udf(T.BinaryType(), _key, table)(text)


def looks(rows: DataFrame, key: Column, text: str, table: dict[str, str] | None = None) -> DataFrame:
    """key, look (skeleton's key), stored (key of the text as stored). Rows without key or text are left out; rows equal in all count once."""
    return rows.filter(F.col(text).isNotNull()).select(key.alias("key"), skeleton_key(text, table).alias("look"), F.unhex(F.md5(text)).alias("stored")).filter("key is not null")


def look_classes(rows: DataFrame, key: Column, text: str, table: dict[str, str] | None = None) -> DataFrame:
    """key, class, forms, members: a row per key and stored text of which another form exists.

    ``class`` is the least key of all that look the same, ``forms`` the number of its stored
    forms, ``members`` that of its rows. Whatever the size of a class its rows stay as many:
    the way to use for texts that stand in very many places.
    """
    each = materialise(looks(rows, key, text, table), "looks").distinct()
    forms = each.groupBy("look").agg(F.min("key").alias("class"), F.min("stored").alias("a"), F.max("stored").alias("b"), F.count(F.lit(1)).alias("members")).filter("a <> b").drop("a", "b")
    some = each.join(forms, "look")
    n = some.select("look", "stored").distinct().groupBy("look").agg(F.count(F.lit(1)).alias("forms"))
    return some.join(n, "look").select("key", "class", "forms", "members")


def look_alike_pairs(rows: DataFrame, key: Column, text: str, table: dict[str, str] | None = None) -> DataFrame:
    """key_a < key_b of rows whose texts look the same but differ as stored.

    Texts travel as 128-bit keys only. Looks of a single stored form, whatever their
    number of rows, leave before anything is paired.
    """
    each = materialise(looks(rows, key, text, table), "looks")
    several = each.groupBy("look").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).filter("a <> b").select("look")
    kept = each.join(several, "look", "left_semi").distinct()
    other = kept.select("look", F.col("key").alias("key_b"), F.col("stored").alias("stored_b"))
    return kept.join(other, "look").filter("stored <> stored_b AND key < key_b").select(F.col("key").alias("key_a"), "key_b").distinct()


def look_alike_readings(apparatus: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """key_a (``file_id#seq``), key_b (wit): readings that look like their lemma but differ as stored."""
    one = apparatus.filter("lem is not null").select("file_id", "seq", "lem", F.explode("readings").alias("r")).filter("r.text is not null and r.text <> lem")
    near = one.select(F.concat_ws("#", "file_id", "seq").alias("key_a"), F.col("r.wit").alias("key_b"), skeleton("lem", table).alias("a"), skeleton(F.col("r.text"), table).alias("b"))
    return near.filter("a = b AND key_b is not null").select("key_a", "key_b").distinct()
