"""Encoded texts (TEI XML) to ordered tables.

A document is one row; its events are read once by a streaming XML parser inside
``mapInPandas``, so that comments, entities and attributes are those of XML, and all tables
come from that one pass. What is markup is decided by local name, whatever the namespace.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "file_id string, error string, title_zh string, title_en string,"
    " lines array<struct<line_id:string,text:string,is_synthetic:boolean>>,"
    " headings array<struct<line_id:string,text:string,juan:string>>,"
    " apparatus array<struct<line_id:string,pos:int,lem:string,readings:array<struct<wit:string,text:string>>>>,"
    " witnesses array<struct<wit_id:string,label:string>>"
)

_BLANKS = " \t\n\r\x0b\x0c\xa0　﻿"


def normal(text: str) -> str:
    """As ``functions.text.normalize_text``."""
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", text.replace("\r", ""))
    return re.sub(r"[ \t]{2,}", " ", text).strip(_BLANKS + "            　")


@dataclass
class _Reading:
    wit: str
    text: list[str] = field(default_factory=list)


@dataclass
class _Entry:
    line: str
    pos: int
    lem: str = ""
    readings: list[_Reading] = field(default_factory=list)


class _Reader:
    """State of one document while its events go by."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.lines: dict[str, list[str]] = {}
        self.sizes: dict[str, int] = {}
        self.line = ""
        self.edition = ""
        self.breaks = 0
        self.juan: str | None = None
        self.in_body = self.seen_body = False
        self.mute = 0  # depth inside notes, tables of contents and readings
        self.entries: list[_Entry] = []
        self.open: list[_Entry] = []
        self.lemma: list[tuple[_Entry, str, int]] = []
        self.reading: _Reading | None = None
        self.reading_mute = 0
        self.heads: list[tuple[list[str], str, str | None]] = []
        self.headings: list[tuple[str, str, str | None]] = []
        self.anchors: dict[str, tuple[str, int]] = {}
        self.titles: list[tuple[str, str]] = []
        self.collect: list[str] | None = None
        self.lang = ""
        self.wits: list[tuple[str, str]] = []
        self.wit = ""
        self.lists = 0
        self.back: list[_Entry] = []
        self.back_at: tuple[str, int] | None = None
        self.back_lem: list[str] | None = None

    def bucket(self, key: str) -> None:
        if key and key not in self.lines:
            self.lines[key] = []
            self.sizes[key] = 0

    def add(self, text: str) -> None:
        if self.line and text:
            self.bucket(self.line)
            self.lines[self.line].append(text)
            self.sizes[self.line] += len(text)

    def mark(self, what: str) -> None:
        self.bucket(f"__{what}_break_{self.breaks}")
        self.breaks += 1

    def at(self) -> int:
        return self.sizes.get(self.line, 0)

    def start(self, name: str, attrs: dict[str, str]) -> None:
        name = name.rpartition(":")[2]
        self.stack.append(name)
        attr = lambda k: attrs.get(k, "")
        if not self.in_body:
            self.outside(name, attr)
            return
        if self.reading is not None:
            if self.reading_mute or name in ("lb", "pb", "note"):
                self.reading_mute += 1
            self.mute += 1
            return
        if self.mute or name in ("note", "mulu"):
            self.mute += 1
            return
        if name == "lb" and attr("n"):
            ed = attr("ed")
            if ed and not self.edition:
                self.edition = ed
            if not ed or ed == self.edition:
                self.line = attr("n")
                self.bucket(self.line)
        elif name in ("pb", "lg"):
            self.mark(name)
        elif name == "juan" or name == "milestone" and attr("unit") == "juan":
            if attr("n"):
                number = re.match(r"\s*([+-]?\d+)", attr("n"))
                self.juan = str(int(number.group(1))) if number else attr("n")
        elif name == "head":
            self.heads.append(([], self.line, self.juan))
        elif name == "caesura":
            self.add("　")
        elif name == "anchor":
            key = attr("xml:id")
            if key.startswith("beg"):
                self.bucket(self.line)
                self.anchors[key] = (self.line, self.at())
        elif name == "app":
            self.bucket(self.line)
            self.open.append(_Entry(self.line, self.at()))
        elif name == "lem" and self.open:
            self.bucket(self.line)
            self.lemma.append((self.open[-1], self.line, self.at()))
        elif name == "rdg" and self.open:
            self.reading = _Reading(attr("wit"))
            self.open[-1].readings.append(self.reading)
            self.mute = 1

    def outside(self, name: str, attr) -> None:
        if name == "body" and not self.seen_body:
            self.in_body = self.seen_body = True
        elif name == "title" and "titleStmt" in self.stack:
            self.collect, self.lang = [], (attr("xml:lang") or attr("lang")).lower()
        elif name == "listWit":
            self.lists += 1
        elif name == "witness" and self.lists == 1 and "listWit" in self.stack:
            self.collect, self.wit = [], attr("xml:id")
        elif "back" in self.stack:
            if name == "app":
                self.back_at = self.anchors.get(re.sub("^#", "", attr("from")))
                self.back.append(_Entry(*(self.back_at or ("", -1))))
            elif name in ("lem", "rdg") and self.back and self.stack[-2] == "app":
                self.back_lem = []
                self.lang = attr("wit")
            elif self.back_lem is not None and (self.reading_mute or name in ("lb", "pb", "note")):
                self.reading_mute += 1

    def text(self, data: str) -> None:
        if self.in_body:
            if self.reading is not None:
                if not self.reading_mute:
                    self.reading.text.append(data)
            elif not self.mute:
                self.add(data)
            if self.heads and not any(x in ("note", "lb", "pb") for x in self.stack[self.head_depth():]):
                self.heads[-1][0].append(data)
        elif self.back_lem is not None:
            if not self.reading_mute:
                self.back_lem.append(data)
        elif self.collect is not None:
            self.collect.append(data)

    def head_depth(self) -> int:
        return len(self.stack) - 1 - self.stack[::-1].index("head")

    def end(self, name: str) -> None:
        name = name.rpartition(":")[2]
        self.stack.pop()
        if self.in_body and name == "body" and "body" not in self.stack:
            self.in_body = False
            return
        if not self.in_body:
            self.outside_end(name)
            return
        if self.reading is not None:
            self.mute -= 1
            self.reading_mute = max(0, self.reading_mute - 1)
            if not self.mute:
                self.reading = None
            return
        if self.mute:
            self.mute -= 1
            return
        if name == "lg":
            self.mark("lg")
        elif name == "head" and self.heads:
            parts, line, juan = self.heads.pop()
            text = normal("".join(parts))
            if text:
                self.headings.append((line, text, juan))
        elif name == "lem" and self.lemma and self.open:
            entry, line, before = self.lemma.pop()
            entry.lem = "".join(self.lines[line])[before:] if line else ""
        elif name == "app" and self.open:
            entry = self.open.pop()
            if entry.lem or entry.readings:
                self.entries.append(entry)

    def outside_end(self, name: str) -> None:
        if self.back_lem is not None:
            if self.reading_mute:
                self.reading_mute -= 1
            elif name in ("lem", "rdg"):
                text = "".join(self.back_lem)
                if name == "lem":
                    self.back[-1].lem = text
                else:
                    self.back[-1].readings.append(_Reading(self.lang, [text]))
                self.back_lem = None
        elif self.collect is not None and name == "title":
            self.titles.append((self.lang, normal("".join(self.collect))))
            self.collect = None
        elif self.collect is not None and name == "witness":
            if self.wit:
                self.wits.append((self.wit, "".join(self.collect).strip()))
            self.collect = None

    def row(self) -> dict:
        entries = self.entries + [e for e in self.back if e.pos >= 0 and (e.lem or e.readings)]
        named = [(lang, t) for lang, t in self.titles if t]
        of = lambda *codes: next((t for lang, t in named if lang in codes or lang.split("-")[0] == codes[0]), "")
        return {
            "error": None,
            "title_zh": of("zh", "chi") or (named[0][1] if named else ""),
            "title_en": of("en", "eng"),
            "lines": [{"line_id": k, "text": normal("".join(v)), "is_synthetic": k.startswith("__")} for k, v in self.lines.items()],
            "headings": [{"line_id": a, "text": b, "juan": c} for a, b, c in self.headings],
            "apparatus": [{"line_id": e.line, "pos": e.pos, "lem": e.lem, "readings": [{"wit": r.wit, "text": "".join(r.text)} for r in e.readings]} for e in entries],
            "witnesses": [{"wit_id": a, "label": b} for a, b in self.wits],
        }


def read_document(xml: str) -> dict:
    """All tables of one document; ``error`` instead where it is no XML or has no body."""
    empty = dict.fromkeys(("title_zh", "title_en")) | {k: [] for k in ("lines", "headings", "apparatus", "witnesses")}
    reader = _Reader()
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.text
    try:
        parser.Parse(xml, True)
    except expat.ExpatError as e:
        return empty | {"error": f"not well-formed: {e}"}
    return reader.row() if reader.seen_body else empty | {"error": "no body"}


def parsed(documents: DataFrame, file_id: str = "file_id", xml: str = "xml") -> DataFrame:
    """One row a document with all its tables as arrays (see SCHEMA).

    A document that is not well-formed, is null or has no body has its reason in ``error`` and
    empty arrays. Line ids that come twice continue the first; text before the first line
    break has no line and is left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"file_id": i} | read_document(x or "") for i, x in zip(pdf["file_id"], pdf["xml"])]
            yield pd.DataFrame(rows, columns=["file_id", "error", "title_zh", "title_en", "lines", "headings", "apparatus", "witnesses"])

    return documents.select(F.col(file_id).cast("string").alias("file_id"), F.col(xml).alias("xml")).mapInPandas(run, SCHEMA)


def lines(documents: DataFrame) -> DataFrame:
    """file_id, line_no, line_id, text, is_synthetic."""
    return documents.select("file_id", F.posexplode("lines").alias("line_no", "l")).select("file_id", "line_no", "l.*")


def headings(documents: DataFrame) -> DataFrame:
    """file_id, seq, line_id, text, level (always 1), juan."""
    return documents.select("file_id", F.posexplode("headings").alias("seq", "h")).select("file_id", "seq", "h.line_id", "h.text", F.lit(1).alias("level"), "h.juan")


def apparatus(documents: DataFrame) -> DataFrame:
    """file_id, seq, line_id, pos, lem, readings: entries of the body in order, then those of the back that are anchored."""
    return documents.select("file_id", F.posexplode("apparatus").alias("seq", "a")).select("file_id", "seq", "a.*")


def witnesses(documents: DataFrame) -> DataFrame:
    return documents.select("file_id", F.explode("witnesses").alias("w")).select("file_id", "w.*")


def index_text(xml: Column) -> Column:
    """Body text for an index, by expressions only: each tag one blank, white space joined, variant readings left out.

    An empty-element reading hides the rest of the text, as its end never comes. Notes stay,
    entities are not resolved; without body the text is empty.
    """
    body = F.regexp_extract(xml, r"(?is)<body[^>]*>(.*?)</body>", 1)
    body = F.regexp_replace(body, r"(?is)<rdg(?=[\s>/])[^>]*/>.*$", " ")
    # Cut before each begin and end of a reading; what follows is kept where no reading is open.
    parts = F.split(F.regexp_replace(body, r"(?i)<rdg(?=[\s>/])|</rdg(?=[\s>])", "\x01$0"), "\x01")
    opens = lambda p: F.when(F.startswith(F.lower(p), F.lit("<rdg")), 1).when(F.startswith(F.lower(p), F.lit("</rdg")), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("open"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, p: Column) -> Column:
        now = F.greatest(state["open"] + opens(p), F.lit(0))
        return F.struct(now.alias("open"), F.when(now == 0, F.concat(state["kept"], F.array(p))).otherwise(state["kept"]).alias("kept"))

    body = F.aggregate(parts, start, step, lambda state: F.array_join(state["kept"], " "))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), "(?s)<[^>]*>", " "), "\r", ""), "[\n\t \f\x0b]+", " "))
