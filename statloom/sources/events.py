"""Everything a page is asked for, in one pass over its parser events.

A pushdown automaton: a stack holds the open elements, and the text read so far lies in one list.
When an element closes it becomes a *piece* of its parent - its tag and the range of its text - and
the work it was opened for is finished: a table cell, a row, a labelled paragraph, a block of
figures. No tree is built, nothing recurses, and nothing that has closed is kept but the pieces of
elements that are still open.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Classes of repeated header rows inside a table body, and the bullet between labels.
_HEADER_CLASSES = {"thead", "over_header"}
_BULLET = "▪"


def snake(label: str) -> str:
    """A label as a name: what is no letter or digit becomes one underscore, none at the ends."""
    return "_".join(re.findall(r"[^\W_]+", label)).lower()


class _Open:
    """An open element: where its text starts, the pieces closed inside it, and what it was opened for."""

    __slots__ = ("tag", "attrs", "start", "pieces", "roles", "waiting")

    def __init__(self, tag: str, attrs: dict, start: int):
        self.tag, self.attrs, self.start = tag, attrs, start
        self.pieces: list[tuple[str | None, int, int]] = []
        self.roles: list = []  # called with the element when it closes
        self.waiting: list[tuple[dict, int]] = []  # paragraphs whose first label is among the pieces


class PageScan(HTMLParser):
    """Reads one page; the results are attributes."""

    def __init__(self, tables: set[str], labels: dict[str, str] | None = None):
        super().__init__(convert_charrefs=True)
        self.wanted, self.figures = set(tables), labels or {}
        self.texts: list[str] = []
        self.stack = [_Open("", {}, 0)]
        self.count: dict[str, int] = {}
        self.tables: dict[str, list[dict]] = {}
        self.open_tables: list[str] = []
        self.open_rows: list[dict] = []
        self.open_cells: list[dict] = []
        self.open_paragraphs: list[dict] = []
        self.open_blocks: list[dict] = []
        self.has_box = False
        self.in_info = self.in_box = self.in_heading = self.in_figures = 0
        self.seen_figures = False
        self.first_label: dict[str, str] = {}
        self.every_label: dict[str, str] = {}
        self.paragraphs: list[dict] = []
        self.headings: list[str] = []
        self.linked: list[tuple[str, str]] = []
        self.blocks: list[tuple[str, list[str]]] = []

    @classmethod
    def of(cls, html: str | None, tables: set[str] = frozenset(), labels: dict[str, str] | None = None) -> PageScan:
        scan = cls(set(tables), labels)
        scan.feed(html or "")
        scan.close()
        while len(scan.stack) > 1:
            scan._close()
        return scan

    # ------------------------------------------------------------ events

    def handle_data(self, data: str) -> None:
        self.stack[-1].pieces.append((None, len(self.texts), len(self.texts) + 1))
        self.texts.append(data)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._open(tag, dict(attrs))
        self._close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._open(tag, dict(attrs))
        if tag in _VOID:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        if self.count.get(tag):
            while self.stack[-1].tag != tag:
                self._close()
            self._close()

    def _open(self, tag: str, attrs: dict) -> None:
        here, parent = _Open(tag, attrs, len(self.texts)), self.stack[-1]
        self.stack.append(here)
        self.count[tag] = self.count.get(tag, 0) + 1
        name = attrs.get("id")
        if name in self.wanted and name not in self.tables:
            self._table(here, name)
        if tag == "tr" and self.open_tables:
            self._row(here)
        elif tag in ("td", "th") and self.open_rows and "data-stat" in attrs:
            self._cell(here)
        if name == "info" and not self.in_info:
            self._inside(here, "in_info")
        elif name == "meta" and self.in_info and not self.has_box:
            self.has_box = True
            self._inside(here, "in_box")
        if self.in_box:
            self._box_element(here, parent)
        if not self.seen_figures and "stats_pullout" in (attrs.get("class") or "").split():
            self.seen_figures = True
            self._inside(here, "in_figures")
        elif self.in_figures:
            self._figure_element(here)
        if tag == "a" and self.open_cells:
            for cell in self.open_cells:
                if "link" not in cell:
                    cell["link"] = None  # known when it closes
                    here.roles.append(lambda e, cell=cell: cell.update(link=self._text(e, " "), href=e.attrs.get("href")))

    def _close(self) -> None:
        here = self.stack.pop()
        self.count[here.tag] -= 1
        self.stack[-1].pieces.append((here.tag, here.start, len(self.texts)))
        for paragraph, at in here.waiting:
            paragraph["after"] = here.pieces[at + 1 :]
        for role in here.roles:
            role(here)

    def _inside(self, here: _Open, state: str) -> None:
        setattr(self, state, getattr(self, state) + 1)
        here.roles.append(lambda e: setattr(self, state, getattr(self, state) - 1))

    def _text(self, part: _Open | tuple, sep: str = "") -> str:
        start, end = (part.start, len(self.texts)) if isinstance(part, _Open) else part[1:]
        return sep.join(x for x in (t.strip() for t in self.texts[start:end]) if x)

    # ------------------------------------------------------------ tables

    def _table(self, here: _Open, name: str) -> None:
        self.tables[name] = []
        self.open_tables.append(name)
        here.roles.append(lambda e: self.open_tables.remove(name))

    def _row(self, here: _Open) -> None:
        header = bool(set((here.attrs.get("class") or "").split()) & _HEADER_CLASSES)
        row = {"header": header, "cells": {}, "any": False}
        for name in self.open_tables:
            self.tables[name].append(row)
        self.open_rows.append(row)
        here.roles.append(lambda e: self.open_rows.remove(row))

    def _cell(self, here: _Open) -> None:
        cell = {"name": here.attrs["data-stat"]}
        rows = list(self.open_rows)
        for row in rows:
            row["any"], row["header"] = True, row["header"] or here.attrs.get("scope") == "col"
            row["cells"].setdefault(cell["name"], None)
        self.open_cells.append(cell)

        def done(element: _Open) -> None:
            self.open_cells.remove(cell)
            value = cell["link"] if "link" in cell else self._text(element, " ")
            for row in rows:
                row["cells"][cell["name"]] = value or None
                if cell.get("href"):
                    row["cells"][cell["name"] + "_href"] = cell["href"]

        here.roles.append(done)

    def rows(self, name: str) -> list[dict[str, str | None]]:
        """The data rows of a table, by the names of their cells."""
        return [r["cells"] for r in self.tables.get(name, ()) if r["any"] and not r["header"]]

    # ------------------------------------------------------------ the box of labels

    def _box_element(self, here: _Open, parent: _Open) -> None:
        tag = here.tag
        if tag == "p":
            paragraph = {"spans": [], "links": [], "first": None}
            self.open_paragraphs.append(paragraph)
            self.paragraphs.append(paragraph)
            here.roles.append(lambda e: self._paragraph(e, paragraph))
        elif tag == "h1":
            self._inside(here, "in_heading")
        elif tag == "strong":
            for paragraph in self.open_paragraphs:
                if paragraph["first"] is None:
                    paragraph["first"] = ""
                    parent.waiting.append((paragraph, len(parent.pieces)))
                    here.roles.append(lambda e, p=paragraph: p.update(first=self._text(e)))
        elif tag == "span":
            for paragraph in self.open_paragraphs:
                self._text_into(here, paragraph["spans"])
            if self.in_heading:
                self._text_into(here, self.headings)
        elif tag == "a":
            for paragraph in self.open_paragraphs:
                self._text_into(here, paragraph["links"])
            at = len(self.linked)
            self.linked.append((here.attrs.get("href") or "", ""))
            here.roles.append(lambda e: self.linked.__setitem__(at, (self.linked[at][0], self._text(e))))

    def _text_into(self, here: _Open, texts: list[str]) -> None:
        at = len(texts)
        texts.append("")
        here.roles.append(lambda e: texts.__setitem__(at, self._text(e)))

    def _value(self, pieces: list[tuple], bullets: bool) -> str:
        """The text of pieces in a row; with ``bullets`` these separate and do not count."""
        found = []
        for piece in pieces:
            text = self.texts[piece[1]] if piece[0] is None else self._text(piece, " ")
            text = text.strip() if bullets else text
            if text and text != (_BULLET if bullets else "\n"):
                found.append(text)
        return " ".join(" ".join(found).split()).strip(" ;:\n\t," + (_BULLET if bullets else ""))

    def _paragraph(self, here: _Open, paragraph: dict) -> None:
        self.open_paragraphs.remove(paragraph)
        if paragraph["first"] is not None and (key := snake(paragraph["first"])):
            self.first_label[key] = self._value(paragraph.pop("after", []), False)
        labels, run = [], None
        for piece in [*here.pieces, ("strong", 0, 0)]:  # one more label ends the last run
            if piece[0] == "strong":
                if run is not None and (key := snake(self._text(run[0]))):
                    labels.append(key)
                    if value := self._value(run[1], True):
                        self.every_label[key] = value
                run = (piece, [])
            elif run is not None:
                run[1].append(piece)
        loose = " ".join(self.texts[p[1]] for p in here.pieces if p[0] is None)
        paragraph.update(labels=labels, loose=" ".join(loose.split()))

    def labelled(self, label: str) -> dict | None:
        """The first paragraph with that label."""
        return next((p for p in self.paragraphs if label in p.get("labels", ())), None)

    def link_text(self, part: str) -> str | None:
        """The text of the box's first link whose address has ``part``."""
        return next((text for href, text in self.linked if part in href), None)

    def bio(self) -> dict | None:
        """The fields of a person's box; None without a box."""
        if not self.has_box:
            return None
        label = self.every_label.get
        sized = next((p["spans"] for p in self.paragraphs if len(p["spans"]) > 1 and re.fullmatch(r"\d-\d{1,2}", p["spans"][0])), None)
        born = (self.link_text("birthdays") or "").split()
        draft, debut = self.labelled("draft"), self.labelled("nba_debut")
        links = draft["links"] if draft else []
        years = label("experience")
        lead = re.match(r"\d+", years or "")
        positions = [x.strip() for x in re.split(r",|\band\b", label("position", "")) if x.strip()]
        return {
            "player_name": self.headings[0] if self.headings else None, "position": ", ".join(positions) or None, "shoots": label("shoots"),
            "height": sized and sized[0], "weight": sized and sized[1].replace("lb", ""),
            "birthday": born[1] if len(born) == 2 else None, "birthmonth": born[0] if len(born) == 2 else None,
            "birthyear": self.link_text("birthyears"), "college": self.link_text("colleges"),
            "draft": links[-1] if links else None, "draft_team": links[0] if links else None,
            "draft_pick": (draft["loose"].strip(" ,:") or None) if draft else None,
            "experience": lead.group() if lead else years, "nba_debut": debut["links"][0] if debut and debut["links"] else None,
        }

    # ------------------------------------------------------------ blocks of figures

    def _figure_element(self, here: _Open) -> None:
        if here.tag == "div":
            block = {"inner": False, "spans": [], "values": []}
            for outer in self.open_blocks:
                outer["inner"] = True
            self.open_blocks.append(block)

            def done(element: _Open) -> None:
                self.open_blocks.remove(block)
                if block["spans"] and not block["inner"]:
                    self.blocks.append((block["spans"][0], block["values"]))

            here.roles.append(done)
        elif here.tag in ("span", "p"):
            for block in self.open_blocks:
                self._text_into(here, block["spans" if here.tag == "span" else "values"])

    def career(self) -> dict[str, str]:
        """The career figure of every known block, named by ``labels``.

        The summary block's heads say where the career column is; a block with fewer columns has
        its career figure last.
        """
        at = -1
        for label, values in self.blocks:
            heads = [v.lower() for v in values]
            if label.lower() == "summary" and "career" in heads:
                at = heads.index("career")
                break
        found = {}
        for label, values in self.blocks:
            if label in self.figures and values:
                value = values[at if 0 <= at < len(values) else -1]
                if value not in ("", "-"):
                    found[self.figures[label]] = value
        return found
