"""Official update notes: their listing and their body."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions import text
from loomspark.sources.pages import VOID, _captured

#: The path of a note, marks of its dates and containers, the label of an image, tags that begin a line, tags without text.
NOTE_PATH = re.compile(r"^/news/update/(\d+)/?$", re.IGNORECASE)
MODIFIED, OUTER, INNER, IMAGE = "modify_common", "qs_text", "new_board_con", "이미지"
LINES = frozenset("br p div li tr td th h1 h2 h3 h4 ul ol".split())
SILENT = frozenset("script style noscript".split())
LISTING = "status string, notes array<struct<id:long,title:string,url:string,published_at:timestamp,modified_at:timestamp>>"


def _when(value: str | None, *forms: str) -> pd.Timestamp | None:
    """A local time of Seoul in UTC, null where it has none of the forms."""
    for form in forms if value else ():
        try:
            return pd.Timestamp(pd.to_datetime(value.strip(), format=form)).tz_localize("Asia/Seoul").tz_convert("UTC").tz_localize(None)
        except ValueError:
            continue
    return None


def notes(html: Column | str, base_url: str) -> Column:
    """Notes of listing pages: each outermost list item with a link to a note, a title and a day. Of repeated ids the last wins. status: ok or drift (no note, or a time that can't be read)."""
    rules = {
        "item": lambda tag, a: tag == "li",
        "link": lambda tag, a: tag == "a" and bool(NOTE_PATH.match(urlparse(urljoin(base_url, a.get("href", ""))).path)),
        "modified": lambda tag, a: tag == "em" and MODIFIED in a.get("class", "").split() and bool(a.get("data-modifytime")),
        "day": lambda tag, a: tag == "dd",
    }

    def read(page: str | None) -> tuple[str, list]:
        items: dict[int, dict] = {}
        bad = False
        for name, a, said, around in _captured(page, rules):
            outer = next((e for e in around if e[0] == "item"), None)
            own = items.setdefault(id(outer), {}) if outer else {}
            if name == "link":
                url = urljoin(base_url, a["href"]).split("?", 1)[0]
                own |= {"id": int(NOTE_PATH.match(urlparse(url).path)[1]), "url": url, "title": said}
            elif name == "modified":
                own["modified_at"] = _when(a["data-modifytime"], "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S")
                bad = bad or own["modified_at"] is None
            elif name == "day" and re.fullmatch(r"\d{4}\.\d{2}\.\d{2}", said):
                own["published_at"] = _when(said, "%Y.%m.%d")
                bad = bad or own["published_at"] is None
        found = {i["id"]: {"modified_at": None, **i} for i in items.values() if {"id", "title", "published_at"} <= i.keys()}
        return ("drift", []) if bad or not found else ("ok", list(found.values()))

    @F.pandas_udf(LISTING)
    def parse(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(p) for p in pages], columns=["status", "notes"])

    return parse(html)


class _Body(HTMLParser):
    """Text of the inner containers inside an outer one; the stack holds the open elements with their classes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, frozenset]] = []
        self.seen, self.parts = False, []

    def _inside(self) -> bool:
        marks = [i for i, (tag, classes) in enumerate(self.stack) if tag == "div" and OUTER in classes]
        return bool(marks) and any(tag == "div" and INNER in classes for tag, classes in self.stack[marks[0] :])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag not in VOID:
            self.stack.append((tag, frozenset(a.get("class", "").split())))
        if self._inside() and not any(t in SILENT for t, _ in self.stack):
            self.seen = True
            if tag in LINES:
                self.parts.append("\n")
            if tag == "img" and a.get("alt"):
                self.parts.append(f" [{IMAGE}: {a['alt']}] ")

    def handle_endtag(self, tag: str) -> None:
        at = max((i for i, (t, _) in enumerate(self.stack) if t == tag), default=None)
        if at is not None:
            inside = self._inside()
            del self.stack[at:]
            if inside and tag in LINES:
                self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self._inside() and not any(t in SILENT for t, _ in self.stack):
            self.parts.append(data)


def body(html: Column | str) -> Column:
    """struct(status, body) of note pages: the masked text with image labels; drift where the container is missing, empty or never closed."""

    @F.pandas_udf("status string, body string")
    def parse(pages: pd.Series) -> pd.DataFrame:
        out = []
        for page in pages:
            parser = _Body()
            parser.feed(page or "")
            parser.close()
            ended = parser.seen and not any(tag == "div" for tag, _ in parser.stack)
            out.append(("ok" if ended else "drift", "".join(parser.parts) if ended else None))
        return pd.DataFrame(out, columns=["status", "body"])

    raw = parse(html)
    said = text.masked(raw["body"])
    fine = (raw["status"] == "ok") & (said != "")
    return F.struct(F.when(fine, "ok").otherwise("drift").alias("status"), F.when(fine, said).alias("body"))
