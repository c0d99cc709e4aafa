"""Crawled pages: listings, articles, comments, character sets.

HTML has no built-in parser in Spark, so pages pass through pandas UDFs that return structs; a page that can't be
read gives a status, never an exception. Comments are JSON and need no Python.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import text

#: The container of an article's body, blocks that end a line, counters of views and recommendations.
BODY_ID = "powerbbsContent"
BLOCKS = frozenset("p div li tr h1 h2 h3 blockquote br".split())
VIEWS, LIKES = re.compile(r"조회\s*:\s*([\d,]+)"), re.compile(r"추천\s*:\s*([\d,]+)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Captured(HTMLParser):
    """The elements that rules name, in the order in which they begin: (rule, attributes, text, enclosing elements found before).

    rules: name and a test of tag and attributes. An element ends with its own end tag, or with that of one around it.
    """

    def __init__(self, rules: dict) -> None:
        super().__init__(convert_charrefs=True)
        self.rules, self.found, self.path, self.open = rules, [], [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        for name, wanted in self.rules.items():
            if wanted(tag, a):
                entry = (name, a, [], [e for _, e in self.open])
                self.found.append(entry)
                if tag not in VOID:
                    self.open.append((len(self.path), entry))
        if tag not in VOID:
            self.path.append(tag)

    def handle_data(self, data: str) -> None:
        for _, entry in self.open:
            entry[2].append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.path:
            at = len(self.path) - 1 - self.path[::-1].index(tag)
            del self.path[at:]
            self.open = [(depth, entry) for depth, entry in self.open if depth < at]


def _captured(page: str | None, rules: dict) -> list[tuple[str, dict, str, list]]:
    parser = _Captured(rules)
    parser.feed(page or "")
    parser.close()
    return [(name, a, " ".join("".join(parts).split()), around) for name, a, parts, around in parser.found]


#: The path of an article of a board.
ARTICLE_PATH = re.compile(r"/board/maple/(\d+)/(\d+)(?:[/?#]|$)")
_classes = lambda a: a.get("class", "").split()
LISTING_RULES = {
    "category": lambda tag, a: tag in ("a", "option") and ("data-category" in a or "category=" in a.get("href", "") and not ARTICLE_PATH.search(a["href"])) and "subject-link" not in _classes(a),
    "row": lambda tag, a: tag == "article" and "data-article-id" in a,
    "title": lambda tag, a: tag == "a" and "title" in _classes(a),
    "subject": lambda tag, a: tag == "a" and "subject-link" in _classes(a) and bool(ARTICLE_PATH.search(a.get("href", ""))),
}
ARTICLE_RULES = {
    "heading": lambda tag, a: tag == "h1" and (a.get("data-title") == "article" or "article-title" in _classes(a)),
    "og": lambda tag, a: tag == "meta" and a.get("property") == "og:title",
    "author": lambda tag, a: tag in ("span", "div") and (a.get("data-author") == "nickname" or bool({"user-name", "nickname", "article-author"} & set(_classes(a)))),
    "hits": lambda tag, a: tag == "div" and "articleHit" in _classes(a),
}


class _Article(HTMLParser):
    """The body of an article: its lines and media."""

    def __init__(self, body_id: str) -> None:
        super().__init__(convert_charrefs=True)
        self.body_id, self.depth, self.seen, self.parts, self.media, self.skip = body_id, 0, False, [], [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        if self.depth:
            if tag in BLOCKS:
                self.parts.append("\n")
            if tag == "img" and a.get("src"):
                self.media.append(("image", a["src"], a.get("alt") or None))
            if tag == "a" and a.get("href") and (a.get("data-media") or a["href"].startswith("http")):
                self.media.append((a.get("data-media") or "link", a["href"], None))
            self.depth += tag not in VOID
        elif a.get("id") == self.body_id:
            self.depth, self.seen = 1, True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        if self.depth and tag not in VOID:
            self.depth -= 1
            if tag in BLOCKS:
                self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.depth and not self.skip:
            self.parts.append(data)


LISTING = "status string, categories array<string>, articles array<struct<id:long,title:string,url:string,category:string,published_at:string,pinned:boolean>>"
ARTICLE = "status string, title string, author string, body string, views long, likes long, media array<struct<kind:string,url:string,alt:string>>"


def listings(html: Column | str, base_url: str, board_id: int | None = None) -> Column:
    """Categories and articles of listing pages; of repeated ids the last wins in the place of the first. status: ok or drift.

    Categories are texts of links and options that lead to one. Articles are marked elements with a titled link, and
    subject links to an article's path, with board_id only those of the board.
    """

    def read(page: str | None) -> dict:
        found = _captured(page, LISTING_RULES)
        categories = list(dict.fromkeys(text for name, _, text, _ in found if name == "category" and text))
        rows: dict[int, dict] = {}
        links = [(around[-1][1], a.get("href", ""), text) for name, a, text, around in found if name == "title" and around and around[-1][0] == "row"]
        bad = len({id(row) for row, _, _ in links}) < sum(name == "row" for name, *_ in found)
        for row, href, title in links:
            if row["data-article-id"].isdigit() and title and href:
                rows[int(row["data-article-id"])] = {"title": title, "url": href, "category": row.get("data-category") or None, "published_at": row.get("data-published-at") or None, "pinned": row.get("data-pinned", "").lower() == "true"}
            else:
                bad = True
        for name, a, title, _ in found:
            path = ARTICLE_PATH.search(a.get("href", "")) if name == "subject" else None
            if path and (board_id is None or int(path[1]) == board_id):
                bad = bad or not title
                rows[int(path[2])] = {"title": title, "url": a["href"], "category": a.get("data-category") or None, "published_at": None, "pinned": False}
        status = "drift" if bad or not categories else "ok"
        return {"status": status, "categories": categories, "articles": [{"id": i, **r, "url": urljoin(base_url, r["url"])} for i, r in rows.items()] if status == "ok" else []}

    @F.pandas_udf(LISTING)
    def parse(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(p) for p in pages], columns=["status", "categories", "articles"])

    return parse(html)


def articles(html: Column | str, base_url: str, body_id: str = BODY_ID) -> Column:
    """Title, author, body, counters and media of article pages; the page's own heading counts before og:title. status: ok, drift (the body never ends or is missing), unavailable (empty)."""

    def count(pattern: re.Pattern, whole: str) -> int:
        found = pattern.search(whole)
        return int(found[1].replace(",", "")) if found else 0

    def read(page: str | None) -> tuple:
        parser = _Article(body_id)
        parser.feed(page or "")
        parser.close()
        lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
        body = "\n".join(line for line in lines if line)
        status = "drift" if not parser.seen or parser.depth else "ok" if body else "unavailable"
        media = [{"kind": k, "url": urljoin(base_url, u), "alt": a} for k, u, a in parser.media]
        facts: dict[str, str] = {}
        for name, a, said, _ in _captured(page, ARTICLE_RULES):
            facts.setdefault(name, a.get("content", "") if name == "og" else said)
        hits = facts.get("hits", "")
        return status, facts.get("heading") or facts.get("og", ""), facts.get("author", ""), body, count(VIEWS, hits), count(LIKES, hits), media

    @F.pandas_udf(ARTICLE)
    def parse(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(p) for p in pages], columns=["status", "title", "author", "body", "views", "likes", "media"])

    return parse(html)


def decoded(raw: Column | str, declared: Column | str) -> Column:
    """Text of bytes in the declared character set, UTF-8 or CP949: whichever leaves the fewest unreadable characters, in this order."""

    def decode(data: bytes | None, name: str | None) -> str | None:
        if data is None:
            return None
        tries = []
        for place, codec in enumerate((name, "utf-8", "cp949")):
            try:
                value = bytes(data).decode(codec or "utf-8", "replace")
            except LookupError:
                continue
            tries.append((value.count("�"), place, value))
        return min(tries)[2]

    @F.pandas_udf("string")
    def best(data: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([decode(d, n) for d, n in zip(data, names, strict=True)], dtype=object)

    return best(raw, declared)


#: A comment row in either of the two schemas of responses; numbers come as text or number.
_FIELDS = ("id", "cmtidx", "parent_id", "parentcmtidx", "cmtpidx", "body", "o_comment", "comment", "contents", "author", "o_name", "published_at", "o_datetime", "o_date", "score", "o_recommend", "o_good", "deleted", "del_state", "state")
_ROW = f"struct<{','.join(f'{f}:string' for f in _FIELDS)},__attr__:struct<cmtidx:string,parentcmtidx:string,cmtpidx:string,state:string>>"


def comments(responses: DataFrame, key: str = "article_id", body: str = "response", salt: str | None = None) -> DataFrame:
    """Comments of JSON responses: (key, comment_id, parent_id, author_hash, text, published_at, score, deleted, content_hash, status).

    A flat list (`comments`) gives parents; grouped lists (`commentlist`) give a parent, or a root whose own, unknown or
    zero parent is none, or else the first comment of the group. Deleted comments lose their text. status is ok, or
    orphan where the parent isn't in the response; check cycles with threads.on_cycle. A response that is neither
    schema gives one row with status drift.
    """
    schema = f"comments array<{_ROW}>, commentlist array<struct<list:array<{_ROW}>>>"
    parsed = responses.select(F.col(key), F.from_json(body, schema).alias("j"))
    bad = parsed.filter("j.comments is null and j.commentlist is null").select(key)
    flat = F.when(F.col("j.comments").isNotNull(), F.array(F.struct(F.lit(True).alias("flat"), F.col("j.comments").alias("list")))).otherwise(F.transform("j.commentlist", lambda g: F.struct(F.lit(False).alias("flat"), g["list"].alias("list"))))
    rows = parsed.select(key, F.posexplode(flat).alias("g", "group")).select(key, "g", "group.flat", F.posexplode("group.list").alias("pos", "r"))
    number = lambda *names: F.coalesce(*[F.expr(f"try_cast({n} as bigint)") for n in names])
    cid = F.when(F.col("flat"), number("r.id")).otherwise(F.coalesce(F.nullif(number("r.id"), F.lit(0)), number("r.cmtidx", "r.__attr__.cmtidx")))
    rows = rows.withColumn("comment_id", cid).filter("comment_id <> 0")
    group = Window.partitionBy(key, "g")
    first = F.first("comment_id").over(group.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ids = F.collect_set("comment_id").over(group)
    own = F.nullif(number("r.parent_id"), F.lit(0))
    generic, native = F.coalesce(own, number("r.parentcmtidx", "r.__attr__.parentcmtidx")), number("r.cmtpidx", "r.__attr__.cmtpidx")
    inferred = F.when(native.isNotNull(), F.when((native != 0) & (native != F.col("comment_id")) & F.array_contains(ids, native), native)).otherwise(F.nullif(first, F.col("comment_id")))
    rows = rows.withColumn("parent_id", F.when(F.col("flat"), number("r.parent_id")).otherwise(F.coalesce(generic, inferred)))
    state = F.coalesce("r.state", "r.__attr__.state")
    gone = (F.coalesce(F.lower("r.deleted"), F.lit("false")) == "true") | ~F.coalesce("r.del_state", F.lit("0")).isin("", "0", "false", "False") | F.coalesce(F.upper(state) != "Y", F.lit(False)) & ~F.col("flat")
    said = F.coalesce("r.body", "r.o_comment", "r.comment", "r.contents", F.lit(""))
    rows = rows.withColumn("deleted", gone).withColumn("text", F.when(gone, F.lit("")).otherwise(text.masked(said)))
    author = F.trim(F.coalesce("r.author", "r.o_name", F.lit("")))
    last = F.row_number().over(Window.partitionBy(key, "comment_id").orderBy(F.desc("g"), F.desc("pos")))
    rows = rows.withColumn("n", last).filter("n = 1")
    known = F.collect_set("comment_id").over(Window.partitionBy(key))
    out = rows.select(
        key, "comment_id", "parent_id", (F.when(author != "", text.keyed_hash(author, salt)) if salt else F.lit(None).cast("string")).alias("author_hash"), "text",
        F.coalesce("r.published_at", "r.o_datetime", "r.o_date", F.lit("1970-01-01T00:00:00+00:00")).alias("published_at"), F.coalesce(number("r.score", "r.o_recommend", "r.o_good"), F.lit(0)).alias("score"), "deleted",
        text.content_hash("text", F.coalesce(F.col("parent_id").cast("string"), F.lit(""))).alias("content_hash"),
        F.when(F.col("parent_id").isNotNull() & ((F.col("parent_id") == F.col("comment_id")) | ~F.array_contains(known, F.col("parent_id"))), "orphan").otherwise("ok").alias("status"),
    )
    return out.unionByName(bad.withColumn("status", F.lit("drift")), allowMissingColumns=True)
