"""Rows, cards and links as markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import encoded, escape_html


def _tag(name: str, css: str, inner: Column, more: Column | None = None) -> Column:
    head = F.concat(F.lit(f'<{name} class="{css}"'), more if more is not None else F.lit(""), F.lit(">"))
    return F.concat(head, inner, F.lit(f"</{name}>"))


def line_row(line_id: Column, text: Column) -> Column:
    """A line of the reader: its id and text, or a spacer for a break of verse or page. Null for no id."""
    spacer = F.startswith(line_id, F.lit("__lg_break_")) | F.startswith(line_id, F.lit("__pb_break_"))
    shown = escape_html(line_id)
    row = _tag("div", "line-row", F.concat(_tag("span", "line-id", shown), _tag("span", "line-text", escape_html(text))), F.concat(F.lit(' data-line-id="'), shown, F.lit('"')))
    return F.when(spacer, F.lit('<div class="line-row spacer-row"></div>')).when(line_id.isNotNull(), row)


def kwic_row(file_id: Column, start: Column, end: Column, line_id: Column, left: Column, match: Column, right: Column, q: Column) -> Column:
    """A hit in its context, with the link to the lines around it."""
    span = F.concat(start, F.when((end != "") & (end != start), F.concat(F.lit("-"), end)).otherwise(F.lit("")))
    href = F.concat(F.lit("#/"), file_id, F.lit("/"), span, F.lit("?q="), encoded(q))
    parts = [_tag("span", f"kwic-{k}", escape_html(v)) for k, v in (("left", left), ("match", match), ("right", right), ("lb", line_id))]
    return _tag("a", "kwic-row", F.concat(*parts), F.concat(F.lit(' href="'), escape_html(href), F.lit('"')))


def card_list(items: Column) -> Column:
    """A section's content from an array: a list, or a dash for none."""
    rows = F.array_join(F.transform(items, lambda x: F.concat(F.lit("<li>"), escape_html(x.cast("string")), F.lit("</li>"))), "")
    return F.when(F.size(items) == 0, F.lit('<p class="lookup-empty-line">—</p>')).when(items.isNotNull(), _tag("ul", "lookup-list", rows))


def card_paragraph(text: Column) -> Column:
    """A section's content from a text; null for null."""
    return F.when(text.isNotNull(), _tag("p", "lookup-paragraph", escape_html(text)))


def lookup_card(title: Column, sections: list[tuple[str, Column]], subtitle: Column | None = None, footer: Column | None = None, banner: Column | None = None) -> Column:
    """A card: banner, title and subtitle, sections of a heading and markup, footer; what is null or empty is left out."""
    def given(name: str, css: str, c: Column | None) -> Column:
        return F.lit("") if c is None else F.when(F.coalesce(c, F.lit("")) != "", _tag(name, css, escape_html(c))).otherwise(F.lit(""))

    each = [F.when(body.isNotNull(), _tag("div", "lookup-section", F.concat(_tag("p", "lookup-section-heading", escape_html(F.lit(head))), _tag("div", "lookup-section-body", body)))).otherwise(F.lit("")) for head, body in sections if head]
    head = _tag("header", "lookup-head", F.concat(_tag("h2", "lookup-title", escape_html(title)), given("p", "lookup-subtitle", subtitle)))
    return _tag("article", "panel lookup-card", F.concat(given("div", "lookup-banner", banner), head, _tag("div", "lookup-sections", F.concat(F.lit(""), *each)), given("p", "lookup-footer", footer)))


def empty_card(title: Column, detail: Column, hint: Column | None = None) -> Column:
    """The card of what was not found."""
    tail = F.lit("") if hint is None else F.when(F.coalesce(hint, F.lit("")) != "", _tag("p", "lookup-empty-hint", escape_html(hint))).otherwise(F.lit(""))
    head = _tag("header", "lookup-head", _tag("h2", "lookup-title", escape_html(F.coalesce(F.nullif(title, F.lit("")), F.lit("Not found")))))
    return _tag("article", "panel lookup-card lookup-card--empty", F.concat(head, _tag("p", "lookup-empty-detail", escape_html(detail)), tail))
