"""A stream of listing pages, board by board: a cursor per board is the offset, and a page that is fully known ends a crawl.

The pages lie in a folder that driver and executors reach, as <board>/<page>.html. The driver reads a listing for the ids
on it, some pages of each board in a batch, and hands out places only; tasks read the pages themselves.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: How a listing names its articles, in either of its two forms.
_ARTICLE = re.compile(r"""data-article-id\s*=\s*["']?(\d+)|/(\d+)(?:[?#][^"']*)?["'][^>]*\bsubject-link\b|\bsubject-link\b[^>]*?/(\d+)["'?#]""")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:/", uri) else f"file://{uri}")


def page_of(folder: str, board: int, page: int) -> str | None:
    """The text of a page, null where there is none."""
    where, path = _open(folder)
    try:
        with where.open_input_file(f"{path}/{board}/{page}.html") as file:
            return file.read().decode("utf-8", "replace")
    except FileNotFoundError:
        return None


def ids_of(listing: str) -> list[int]:
    return [int(next(g for g in m.groups() if g)) for m in _ARTICLE.finditer(listing)]


class BoardReader(SimpleDataSourceStreamReader):
    """Offsets: for each board {page: the next one, known: the greatest id of crawls before, top: of this one, crawl: its number, done}."""

    def __init__(self, options: dict) -> None:
        self.folder, self.batch, self.crawl = options["path"], int(options.get("pagesPerBatch", 10)), int(options.get("crawl", 1))
        self.boards = [int(b) for b in options["boards"].split(",")]

    def initialOffset(self) -> dict:
        return {str(b): json.dumps({"page": 1, "known": 0, "top": 0, "crawl": 1, "done": False}) for b in self.boards}

    def _board(self, board: int, state: dict) -> tuple[list[tuple], dict]:
        if state["crawl"] < self.crawl:
            state = {"page": 1, "known": max(state["known"], state["top"]), "top": state["top"], "crawl": self.crawl, "done": False}
        rows, end = [], state["page"] + self.batch
        while not state["done"] and state["page"] < end:
            listing = page_of(self.folder, board, state["page"])
            ids = ids_of(listing) if listing else []
            if not ids or max(ids) <= state["known"]:
                state = {**state, "done": True}
                break
            rows.append((board, state["page"], state["crawl"]))
            state = {**state, "page": state["page"] + 1, "top": max([state["top"], *ids])}
        return rows, state

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, after = [], {}
        for board in sorted({*map(int, start), *self.boards}):
            state = json.loads(start.get(str(board)) or self.initialOffset()[str(board)])
            found, state = self._board(board, state) if board in self.boards else ([], state)
            rows += found
            after[str(board)] = json.dumps(state)
        return iter(rows), after

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The pages that were handed out between two offsets, as their numbers say, whatever the listings are now."""
        for board, text in sorted(end.items(), key=lambda x: int(x[0])):
            after, before = json.loads(text), json.loads(start.get(board) or '{"page": 1, "crawl": 0}')
            first = before["page"] if before["crawl"] == after["crawl"] else 1
            yield from ((int(board), page, after["crawl"]) for page in range(first, after["page"]))

    def commit(self, end: dict) -> None:
        pass


class BoardPages(DataSource):
    """Options: path, boards (numbers with commas), pagesPerBatch, crawl (a greater number starts anew at the first page)."""

    @classmethod
    def name(cls) -> str:
        return "board_pages"

    def schema(self) -> str:
        return "board_id long, page int, crawl int"

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
        return BoardReader(dict(self.options))


def stream(spark: SparkSession, folder: str, boards: list[int], pages_per_batch: int = 10, crawl: int = 1) -> DataFrame:
    """(board_id, page, crawl) of listing pages to be taken: from the first page of each board to its end, or to a page without a new article."""
    spark.dataSource.register(BoardPages)
    return spark.readStream.format("board_pages").options(path=folder, boards=",".join(map(str, boards)), pagesPerBatch=str(pages_per_batch), crawl=str(crawl)).load()


def with_text(places: DataFrame, folder: str) -> DataFrame:
    """places with the column html, read by the tasks."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(html=[page_of(folder, b, p) for b, p in zip(batch["board_id"], batch["page"], strict=True)])

    return places.mapInPandas(fetch, "board_id long, page int, crawl int, html string")


def stored(folder: str):
    """For mapInPandas over (board_id, page, html): writes each page into the folder and gives its place."""

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, path = _open(folder)
        for batch in batches:
            files = []
            for board, page, html in batch[["board_id", "page", "html"]].itertuples(index=False):
                where.create_dir(f"{path}/{board}", recursive=True)
                with where.open_output_stream(f"{path}/{board}/{page}.html") as file:
                    file.write((html or "").encode())
                files.append(f"{board}/{page}.html")
            yield pd.DataFrame({"file": files})

    return store
