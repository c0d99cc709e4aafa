"""Expressions over passages and answers: rerank documents, named terms, disclosures, JSON fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions import text

#: How the lines of a header begin, what stands for a missing title or board, and the marks of a comment branch.
HEADER = ("제목:", "게시판:", "분류:", "작성일:", "댓글 답변:")
NO_TITLE, NO_BOARD, CONTEXT = "제목 없음", "게시판 미상", "질문 문맥:"
BRANCH = "answer_with_question_context"
#: A term with an expansion in brackets, prefixes of skill headings, and the request code of comments.
_TERM = r"(?<![가-힣A-Za-z0-9])([가-힣A-Za-z][가-힣A-Za-z0-9]{0,5})\s*[\(\[]\s*([가-힣A-Za-z][가-힣A-Za-z\s·/+\-]{1,39})\s*[\)\]]"
_SKILL = r"^(오리진|마스터리 코어|스킬 코어|시퀀스 버프|하이퍼|5차|6차)[\s:]*"
_CHECK_CODE = r"(?i)(?:chkcode|cmtChkCode|commentChkCode)[\"']?\s*[:=]\s*[\"']([a-zA-Z0-9_-]{8,128})"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def header_of(passage: Column | str) -> Column:
    """The header of a passage: up to its first empty line, else its first header lines where a line follows them; '' without one."""
    p, line = _c(passage), "(?:" + "|".join(HEADER) + ")"
    upto = F.instr(p, F.lit("\n\n"))
    lines = F.regexp_extract(p, rf"(?s)\A((?:{line}[^\n]*\n)++)(?!{line})(?=.)", 1)
    return F.when(~F.startswith(p, F.lit(HEADER[0])), "").when(upto > 0, F.substring(p, F.lit(1), upto + 1)).otherwise(lines)


def rerank_document(passage: Column | str, kind: Column | str, title: Column | str, board: Column | str, most: int = 1500) -> Column:
    """What a reranker reads of a passage: at most `most` characters, the header kept, the body cut.

    A comment branch shows its answers only, below a short header of its own.
    """
    p, branch = _c(passage), _c(kind) == BRANCH
    given = lambda c, none: F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(none))
    own = F.concat(F.lit(f"{HEADER[0]} "), given(title, NO_TITLE), F.lit(f"\n{HEADER[1]} "), given(board, NO_BOARD), F.lit(f"\n{HEADER[4]}\n"))
    head = F.when(branch, own).otherwise(header_of(p))
    body = F.when(branch, text.claim_text(p, kind)).otherwise(F.substring(p, F.length(head) + 1, F.length(p)))
    cut = F.substring(F.concat(head, F.substring(body, F.lit(1), F.greatest(F.lit(0), most - F.length(head)))), 1, most)
    return F.when(~branch & (F.length(p) <= most), p).otherwise(cut)


def question_context(passage: Column | str, kind: Column | str) -> Column:
    """The question's context of a comment branch, null for other passages."""
    p = _c(passage)
    start, answers = F.instr(p, F.lit(CONTEXT)), F.regexp_instr(p, F.lit(text._COMMENT))
    answers = answers + F.when(F.substring(p, answers, F.lit(1)) == "\n", 1).otherwise(0)
    inside = F.substring(p, start + len(CONTEXT), answers - start - len(CONTEXT))
    return F.when((_c(kind) == BRANCH) & (start > 0) & (start < answers), F.regexp_replace(inside, r"(?U)^\s+|\s+$", ""))


def terms(answer: Column | str) -> Column:
    """(term, expansion) of each term that an answer explains in brackets, blanks collapsed."""
    a = _c(answer)
    both = F.arrays_zip(F.regexp_extract_all(a, F.lit(_TERM), F.lit(1)).alias("term"), F.regexp_extract_all(a, F.lit(_TERM), F.lit(2)).alias("expansion"))
    return F.transform(both, lambda t: F.struct(t["term"].alias("term"), F.trim(F.regexp_replace(t["expansion"], r"(?U)\s+", " ")).alias("expansion")))


def without_expansions(answer: Column | str, guesses: Column | str) -> Column:
    """An answer with the given guesses (term, expansion) taken out; the terms stay."""
    found = lambda g: F.concat(F.lit(r"\Q"), g["term"], F.lit(r"\E\s*[\(\[]\s*\Q"), g["expansion"], F.lit(r"\E\s*[\)\]]"))
    return F.aggregate(_c(guesses), _c(answer), lambda left, g: F.regexp_replace(left, found(g), g["term"]))


def disclosed(answer: Column | str, tools: Column | str, lines: dict[str, str], generic: str, none: str) -> Column:
    """An answer without disclosure lines of its own, and below it those of the tools that were used, in the order of lines."""
    known = [*lines.values(), generic, none]
    kept = F.filter(F.split(_c(answer), "\n"), lambda line: ~F.trim(line).isin(*known))
    said = F.array_distinct(F.array_compact(F.array(*[F.when(F.array_contains(_c(tools), t), F.lit(line)) for t, line in lines.items()])))
    said = F.when(F.size(said) > 0, said).when(F.size(_c(tools)) > 0, F.array(F.lit(generic))).otherwise(F.array(F.lit(none)))
    return F.concat(F.regexp_replace(F.array_join(kept, "\n"), r"(?U)^\s+|\s+$", ""), F.lit("\n\n"), F.array_join(said, "\n"))


def skill_name(heading: Column | str) -> Column:
    """A skill's name: numbers, section words and remarks in brackets gone."""
    out = F.regexp_replace(F.regexp_replace(_c(heading), r"^[0-9]+\.\s*", ""), _SKILL, "")
    return F.regexp_replace(F.regexp_replace(out, r"\([^)]*\)|\[[^\]]*\]", ""), r"(?U)^\s+|\s+$", "")


def check_code(page: Column | str) -> Column:
    """The request code of a page's comments, null without one."""
    return F.nullif(F.regexp_extract(_c(page), _CHECK_CODE, 1), F.lit(""))


def json_value(document: Column | str, field: str, default: str) -> Column:
    """A field of a JSON object as text, default where it is missing or null."""
    return F.coalesce(F.get_json_object(_c(document), f"$.{field}"), F.lit(default))


def merged(one: Column | str, other: Column | str) -> Column:
    """Two maps in one; the second wins, with its nulls too. A null map counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(_c(one), empty), F.coalesce(_c(other), empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def projected(document: Column | str, fields: tuple[str, ...], lists: dict[str, tuple[int, tuple[str, ...]]]) -> Column:
    """Named fields of a JSON object as text, and of its lists of objects the first so many with some of their fields."""
    kind = ", ".join([*[f"`{f}` string" for f in fields], *[f"`{n}` array<struct<{', '.join(f'`{k}`: string' for k in keys)}>>" for n, (_, keys) in lists.items()]])
    read = F.from_json(_c(document), kind)
    return F.struct(*[read[f].alias(f) for f in fields], *[F.slice(F.coalesce(read[n], F.array().cast(f"array<struct<{', '.join(f'`{k}`: string' for k in keys)}>>")), 1, most).alias(n) for n, (most, keys) in lists.items()])
