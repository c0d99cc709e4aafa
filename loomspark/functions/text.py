"""Text expressions. All are built-in column functions but for those that say they are pandas UDFs."""

from __future__ import annotations

import difflib
import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is masked, in this order, and the label written in its place. Java reads what stands before a place by
#: code points only where the look-behind has a sign beyond 16 bits; 𝐀 is a letter and 𝟘 a digit anyway.
MASKS = (
    ("email", r"(?U)(?<![\w.𝐀-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w.-])", "[이메일 삭제]"),
    ("phone", r"(?U)(?<![\d𝟘])(?:\+?82[- .]?)?0?1[016789][- .]?\d{3,4}[- .]?\d{4}(?!\d)", "[전화번호 삭제]"),
    ("discord_id", r"(?U)<@!?(?:\d{15,22})>|<@&(?:\d{15,22})>", "[Discord 식별자 삭제]"),
    ("discord_tag", r"(?U)(?<![\w𝐀])[\w가-힣.]{2,32}#\d{4}(?!\d)", "[Discord 식별자 삭제]"),
)
#: Keys whose values are never logged.
SENSITIVE_KEYS = ("authorization", "content", "database_url", "discord_token", "message", "nickname", "ocr_text", "password", "pii_hash_salt", "query", "raw_body", "token")
#: Addresses with credentials, and what counts as a token.
_CREDENTIAL_URL = r"(?i)\b(?:postgres(?:ql)?|https?)://[^\s/@:]+:[^\s/@]+@"
_TOKEN = r"(?U)[\w가-힣]+|[^\s\w]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized(text: Column | str) -> Column:
    """Lower case, trimmed, white space collapsed. For text that NFKC leaves as it is; see normalized_nfkc."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), r"(?U)\s+", " "))


def nfkc_casefold(text: str | None) -> str | None:
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def normalized_nfkc(text: Column | str) -> Column:
    """NFKC, case folding, trimming and collapsing; a pandas UDF, as Spark has no NFKC."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(nfkc_casefold, na_action="ignore")

    return fold(_c(text))


def masked(text: Column | str, masks: tuple = MASKS) -> Column:
    """Sensitive identifiers masked one kind after the other, blanks collapsed by line, at most one empty line in a row."""
    out = F.replace(_c(text), F.char(F.lit(0)), F.lit(""))
    for _, pattern, label in masks:
        out = F.regexp_replace(out, pattern, label)
    out = F.regexp_replace(F.regexp_replace(out, r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", "\n"), r"[ \t\f\x0B]+", " ")
    out = F.regexp_replace(out, r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def masked_fields(text: Column | str, masks: tuple = MASKS) -> Column:
    """Sorted names of the kinds that masked() found; each kind sees the text that the earlier ones left."""
    left, found = F.replace(_c(text), F.char(F.lit(0)), F.lit("")), []
    for name, pattern, label in masks:
        found.append(F.when(F.regexp_like(left, F.lit(pattern)), F.lit(name)))
        left = F.regexp_replace(left, pattern, label)
    return F.array_sort(F.array_compact(F.array(*found)))


def content_hash(*values: Column | str) -> Column:
    """SHA-256 over the parts, each preceded by its length in bytes as eight bytes, big-endian."""
    pieces = []
    for v in values:
        raw = F.encode(_c(v), "UTF-8")
        pieces += [F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw]
    return F.sha2(F.concat(*pieces), 256)


def relation_id(subject: Column | str, predicate: Column | str, obj: Column | str) -> Column:
    return F.sha2(F.concat_ws("\0", _c(subject), _c(predicate), _c(obj)), 256)


def keyed_hash(text: Column | str, salt: str, domain: str = "loomspark:nickname:v1") -> Column:
    """HMAC-SHA-256 of the trimmed, lower-cased text under a salt of at least 16 characters, for one domain of use."""
    if len(salt) < 16:
        raise ValueError("the salt must have at least 16 characters")
    key = salt.encode().ljust(64, b"\0") if len(salt.encode()) <= 64 else None
    if key is None:
        raise ValueError("the salt must have at most 64 bytes")
    inner, outer = (bytes(b ^ pad for b in key) for pad in (0x36, 0x5C))
    message = F.concat(F.lit(inner + domain.encode() + b"\0"), F.encode(F.lower(F.trim(_c(text))), "UTF-8"))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(message, 256))), 256)


def token_count(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(_TOKEN))


def keywords(text: Column | str, most: int = 10) -> Column:
    """The first ASCII or Hangul words of up to 100 characters."""
    found = F.regexp_extract_all(_c(text), F.lit(r"[a-zA-Z0-9가-힣]+"), F.lit(0))
    return F.slice(F.filter(found, lambda w: F.length(w) <= 100), 1, most)


def trigrams(text: Column | str) -> Column:
    """Distinct trigrams of the lower-cased words of letters and digits, two blanks before each and one after; as 64-bit hashes.

    Sets of numbers intersect several times faster than sets of strings.
    """
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.xxhash64(F.substring(w, i, F.lit(3)))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(one: Column | str, other: Column | str) -> Column:
    """Jaccard similarity of two arrays of distinct values, 0 if both are empty."""
    both = F.size(F.array_intersect(_c(other), _c(one)))  # the second is hashed: give the shorter one first
    either = F.size(_c(one)) + F.size(_c(other)) - both
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def bigrams(text: Column | str) -> Column:
    """Distinct character bigrams of the normalised text, blanks included."""
    signs = F.regexp_extract_all(normalized(text), F.lit("(?s)."), F.lit(0))
    pairs = lambda c: F.when(F.size(c) < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 2, F.lit(0))), lambda i: F.concat(F.get(c, i), F.get(c, i + 1))))
    )
    return F.element_at(F.transform(F.array(signs), pairs), 1)  # the array makes Spark take the signs apart once, not for each pair


def coverage(query: Column | str, title: Column | str) -> Column:
    """Share of the query's character bigrams that the title has; 0 without bigrams."""
    share = lambda both: F.when(F.size(both["q"]) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(both["q"], both["t"])) / F.size(both["q"]))
    sides = F.struct(bigrams(query).alias("q"), bigrams(F.coalesce(_c(title), F.lit(""))).alias("t"))
    return F.element_at(F.transform(F.array(sides), share), 1)


def truncated(text: Column | str, limit: int) -> Column:
    """White space collapsed; if longer than limit, cut by one more and closed with an ellipsis."""
    flat = F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def like_escaped(term: Column | str) -> Column:
    """A term with the wild cards of LIKE escaped by a backslash."""
    return F.regexp_replace(_c(term), r"([\\%_])", r"\\$1")


def sections(text: Column | str) -> Column:
    """Non-empty sections, split at empty lines and before headings and list items."""
    parts = F.split(_c(text), r"(?m)\n\s*\n|(?=^#{1,4}\s)|(?=^[-*]\s)")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def expansions(text: Column | str, term: Column | str) -> Column:
    """Distinct explicit expansions of a term: term(...), term[...], then term=..., 2 to 60 characters."""
    quoted = F.concat(F.lit(r"\Q"), _c(term), F.lit(r"\E"))
    brackets = F.regexp_extract_all(_c(text), F.concat(quoted, F.lit(r"\s*[\(\[]\s*([^\)\]\n]{2,60})\s*[\)\]]")), F.lit(1))
    equals = F.regexp_extract_all(_c(text), F.concat(quoted, F.lit(r"\s*=\s*([^,.;\n]{2,60})")), F.lit(1))
    return F.array_distinct(F.transform(F.concat(brackets, equals), lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " "))))


def compounds(text: Column | str, term: Column | str, letters: str = "가-힣") -> Column:
    """Runs of 2 to 20 of the given letters that contain the term and are longer than it; repeats stay."""
    runs = F.regexp_extract_all(_c(text), F.lit(f"(?<![{letters}])([{letters}]{{2,20}})(?![{letters}])"), F.lit(1))
    return F.filter(runs, lambda r: F.contains(r, _c(term)) & (r != _c(term)))


def unescaped(text: Column | str, depth: int = 2) -> Column:
    """Character references decoded up to `depth` times; a pandas UDF, as Spark has none of the names."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for _ in range(depth):
                texts = texts.map(html.unescape, na_action="ignore")
            yield texts

    return decode(_c(text))


def matching_ratio(left: Column | str, right: Column | str) -> Column:
    """Ratcliff-Obershelp ratio of two strings; a pandas UDF, as no built-in distance equals it."""

    @F.pandas_udf("double")
    def ratio(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(one, other, strict=True)], dtype="float64")

    return ratio(_c(left), _c(right))


#: Fixed value: a word that makes any expansion a name.
SCROLL = "주문서"


def resembles(candidate: Column | str, abbreviation: Column | str, official: Column | str, least: float = 0.55) -> Column:
    """Whether an expansion looks like a name of the term: it holds the official name or speaks of a scroll, or is about as long as the abbreviation (at most 12 or six more letters) and like it by Ratcliff-Obershelp ratio. Blanks and case don't count."""
    flat = lambda c: F.replace(normalized(c), F.lit(" "), F.lit(""))
    said, short, long = flat(candidate), flat(abbreviation), flat(official)
    near = (F.length(said) <= F.greatest(F.lit(12), F.length(short) + 6)) & (matching_ratio(said, short) >= least)
    return F.contains(said, F.lit(SCROLL)) | F.contains(said, long) | near


def comparable(text: Column | str) -> Column:
    """Text for comparison of answers: tags gone, lower case, only letters and digits. Decode references first."""
    return F.regexp_replace(F.lower(F.regexp_replace(_c(text), r"<[^>]+>", " ")), r"(?U)[\W_]+", "")


def neutral_mentions(text: Column | str) -> Column:
    """Mentions broken by a zero-width space."""
    out = F.replace(_c(text), F.lit("@everyone"), F.lit("@\u200beveryone"))
    return F.replace(F.replace(out, F.lit("@here"), F.lit("@\u200bhere")), F.lit("<@"), F.lit("<@\u200b"))


def message_parts(text: Column | str, limit: int = 1900) -> Column:
    """Array of parts of at most limit characters, mentions broken, white space around each part gone; empty for a blank text.

    A part is all that is left if it fits, else it ends before the last line end or blank that leaves it at least half
    full, else after limit characters. One expression says so, and its matches in order are the parts.
    """
    if not 100 <= limit <= 2000:
        raise ValueError("limit must lie between 100 and 2000")
    part = rf"(?Us)\s*+(.{{1,{limit}}}\z|.{{{limit // 2},{limit}}}(?=[\n ])|.{{{limit}}})"
    edges = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.transform(F.regexp_extract_all(edges(neutral_mentions(F.coalesce(_c(text), F.lit("")))), F.lit(part), F.lit(1)), edges)


def redacted(values: Column | str, keys: tuple = SENSITIVE_KEYS) -> Column:
    """A map of log fields with sensitive values replaced, credentials in addresses hidden and the rest masked."""
    return F.transform_values(_c(values), lambda k, v: F.when(F.lower(k).isin(*keys), F.lit("<redacted>")).otherwise(masked(F.regexp_replace(v, _CREDENTIAL_URL, "<redacted-url>"))))


def allowed_url(url: Column | str, hosts: tuple[str, ...], path: str = "^/", schemes: tuple[str, ...] = ("https",), ports: tuple[int, ...] = (80, 443)) -> Column:
    """Whether an address has an allowed scheme, host, port and path, and no user part; false for null and malformed ones."""
    part = lambda p: F.try_parse_url(_c(url), F.lit(p))
    port = F.regexp_extract(F.coalesce(part("AUTHORITY"), F.lit("")), r":(\d+)$", 1)
    ok = F.lower(part("PROTOCOL")).isin(*schemes) & F.lower(part("HOST")).isin(*hosts) & F.coalesce(part("PATH"), F.lit("/")).rlike(path)
    ok = ok & part("USERINFO").isNull() & ((port == "") | port.isin(*map(str, ports)))
    return F.coalesce(ok, F.lit(False))


def fingerprint(values: Column | str) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_c(values)))))


def role(qa_branch: Column | str, board: Column | str, question_board: str = "질문과 답변") -> Column:
    """What a passage may claim: an answer with its question's context, only a question, or a post."""
    return F.when(F.coalesce(_c(qa_branch), F.lit(False)), "answer_with_question_context").when(_c(board) == question_board, "question_only").otherwise("community_post")


#: Fixed value: how a comment begins inside a passage.
_COMMENT = r"(?:^|\n)(댓글 \d+:)"


def claim_text(text: Column | str, kind: Column | str) -> Column:
    """The part of a passage that may make claims: of a comment branch what follows the question's context."""
    at = F.regexp_instr(_c(text), F.lit(_COMMENT))
    start = at + F.when(F.substring(_c(text), at, F.lit(1)) == "\n", 1).otherwise(0)
    return F.when((_c(kind) == "answer_with_question_context") & (at > 0), F.substring(_c(text), start, F.length(_c(text)))).otherwise(_c(text))


def group_key(source_key: Column | str, kind: Column | str, article_key: Column | str) -> Column:
    """Comment branches of one article share a group; any other source is its own."""
    key = _c(source_key)
    parsed = F.when(F.startswith(key, F.lit("comment:")) & F.contains(F.substring(key, 9, 10_000), F.lit(":")), F.regexp_extract(key, r"^comment:(.*):[^:]*$", 1))
    parent = F.when(_c(kind) == "answer_with_question_context", F.coalesce(F.nullif(_c(article_key), F.lit("")), parsed))
    return F.when(parent.isNotNull(), F.concat(F.lit("comment-thread:"), parent)).otherwise(F.concat(F.lit("source:"), key))
