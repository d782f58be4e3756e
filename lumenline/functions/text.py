"""Scalar text functions as column expressions: fuzzy scores, edit similarity, time stamps, cleaning.

Lengths and positions count code points.  Nulls give null unless a function says otherwise.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a bit vector that are in one number: two more keep its sums below the sign.  Longer texts take several.
BITS = 62
#: Marks claimed characters; it can't stand in a query word.
CLAIMED = "\0"


def query_words(query: str) -> list[str] | None:
    """The words of a multi-word query in lower case, or None for a single one.

    Only a space or ``%20`` makes it multi-word; it is then cut at all white space.
    """
    low = query.lower()
    if " " not in low and "%20" not in low:
        return None
    return re.sub("%20", " ", low).split()


def _masks(query: str, begin: int = 0) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(query[begin : begin + BITS]):
        out[c] = out.get(c, 0) | 1 << i
    return out


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it stands in the expression."""
    return F.get(F.transform(F.array(value), use), 0)


def _long(x: int | Column) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def _lcs_step(v: Column, m: Column, full: Column) -> Column:
    both = v.bitwiseAND(m)
    return (v + both).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full)


def _lcs_words(vector: Column, masks: Column) -> Column:
    """One step of a bit vector in several numbers, lowest first; each hands its carry to the next."""
    none = F.struct(_long(0).alias("carry"), F.array().cast("array<bigint>").alias("v"))
    full = _long((1 << BITS) - 1)

    def word(s: Column, x: Column) -> Column:
        total = x["v"] + x["v"].bitwiseAND(x["m"]) + s["carry"]
        left = total.bitwiseOR(x["v"].bitwiseAND(F.bitwise_not(x["m"]))).bitwiseAND(full)
        return F.struct(F.shiftright(total, BITS).alias("carry"), F.array_append(s["v"], left).alias("v"))

    return F.aggregate(F.zip_with(vector, masks, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), none, word, lambda s: s["v"])


def _cleared(vector: Column) -> Column:
    """Bits that are no more set.  Bits beyond a text's end stay set, as no mask has them."""
    return F.aggregate(vector, F.lit(0), lambda n, v: n + BITS - F.bit_count(v))


def lcs_length(query: str, text: Column) -> Column:
    """Length of the longest common subsequence with a literal, by a bit vector over the literal's characters."""
    if not query:
        return F.lit(0)
    # characters that the query lacks change nothing, so all that are left have a mask
    own = F.regexp_replace(text, f"[^{_class(query)}]+", "")
    chars = F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, ""))
    if len(query) <= BITS:
        full = _long((1 << len(query)) - 1)
        table = F.create_map(*(F.lit(x) for c, m in _masks(query).items() for x in (c, m)))
        left = F.aggregate(F.transform(chars, lambda c: F.element_at(table, c).cast("long")), full, lambda v, m: _lcs_step(v, m, full))
        return F.lit(len(query)) - F.bit_count(left)
    words = [_masks(query, i) for i in range(0, len(query), BITS)]
    table = F.create_map(*(x for c in dict.fromkeys(query) for x in (F.lit(c), F.array(*(_long(w.get(c, 0)) for w in words)))))
    start = F.array(*(_long((1 << BITS) - 1) for _ in words))
    return _cleared(F.aggregate(chars, start, lambda v, c: _lcs_words(v, F.element_at(table, c))))


def _class(chars: str) -> str:
    """The characters as code points, for use between brackets of a pattern."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in dict.fromkeys(chars))


def lcs_ratio(query: str, text: Column) -> Column:
    """Percent of the query that is a subsequence of the text, both in lower case; 0 where either is empty."""
    q = query.lower()
    if not q:
        return F.lit(0.0)
    low = F.lower(text)
    score = F.when(F.length(text) == 0, F.lit(0.0))
    if len(q) <= BITS:  # whole query in order: one pass without backtracking, and no fold
        score = score.when(low.rlike("^" + "".join(f"[^{_class(c)}]*+[{_class(c)}]" for c in q)), F.lit(100.0))
    return score.otherwise(lcs_length(q, low) * 100.0 / len(q))


def _lcs_of_columns(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts that are not empty.

    The masks of ``a``'s distinct characters are worked out once a row; each character of ``b`` that is one of them is a step.
    """

    def masks(chars: Column, c: Column) -> Column:
        word = lambda i: F.aggregate(
            F.transform(F.slice(chars, i * BITS + 1, F.lit(BITS)), lambda x, k: F.when(x == c, F.call_function("shiftleft", _long(1), k)).otherwise(_long(0))),
            _long(0), lambda s, x: s + x,
        )
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(chars) - 1) / BITS).cast("int")), word)

    table = lambda chars: F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c.alias("c"), masks(chars, c).alias("m"))))
    steps = lambda t: F.filter(F.transform(F.split(b, ""), lambda c: F.element_at(t, c)), lambda m: m.isNotNull())
    start = F.array_repeat(_long((1 << BITS) - 1), F.ceil(F.length(a) / BITS).cast("int"))
    one = lambda m: F.aggregate(m, _long((1 << BITS) - 1), lambda v, x: _lcs_step(v, F.get(x, 0), _long((1 << BITS) - 1)))
    short = lambda t: BITS - F.bit_count(one(steps(t)))
    many = lambda t: _cleared(F.aggregate(steps(t), start, _lcs_words))
    return let(table(F.split(a, "")), lambda t: F.when(F.length(a) <= BITS, short(t)).otherwise(many(t)))


def lcs_columns(a: Column, b: Column) -> Column:
    """Share of ``a`` (case kept) that is a subsequence of ``b``; 0 where either is empty."""
    n = F.length(a)
    return F.when((n == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(_lcs_of_columns(a, b) / n)


def multiword_ratio(words: list[str], text: Column) -> Column:
    """Percent of the words' characters that stand in the text: each word in turn claims its first free occurrence.

    Null without words.
    """
    total = sum(map(len, words))
    if not total:
        return F.lit(None).cast("double")
    zero = F.struct(F.lower(text).alias("t"), F.lit(0).alias("n"))

    def claim(state: Column, word: Column) -> Column:
        at, n = F.locate(word, state["t"]) if isinstance(word, str) else F.instr(state["t"], word), F.length(word)
        free = F.overlay(state["t"], F.repeat(F.lit(CLAIMED), n), at, n)
        return F.struct(F.when(at > 0, free).otherwise(state["t"]).alias("t"), (state["n"] + F.when(at > 0, n).otherwise(0)).alias("n"))

    return F.aggregate(F.array(*map(F.lit, words)), zero, claim, lambda s: s["n"] * 100.0 / total)


def contains_all(words: list[str], text: Column) -> Column:
    """Whether each word is a substring of the text in lower case."""
    out = F.lit(True)
    for w in words:
        out = out & F.lower(text).contains(w)
    return out


def norm_text(text: Column) -> Column:
    """Chinese characters, digits and A-Z, a-z only; case is kept."""
    return F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}0-9A-Za-z]", "")


def edit_similarity(a: Column, b: Column, least: float | None = None) -> Column:
    """1 - edit distance / shorter length of the normed texts: 0 where either is empty, negative for very unlike ones.

    With ``least``, similarities under it are null: lengths that differ by too much already rule a pair out, and of the others
    only a band of the distances is worked out.
    """
    return normed_similarity(norm_text(a), norm_text(b), least)


def normed_similarity(x: Column, y: Column, least: float | None = None) -> Column:
    """:func:`edit_similarity` of texts that are normed already."""
    n = F.least(F.length(x), F.length(y))
    if least is None:
        return F.when(n == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / n)
    most = F.floor((1 - least) * n + 1e-9).cast("int")
    # one edit over the bound is -1, which is above 1 here and so out of range
    near = 1 - F.call_function("levenshtein", x, y, most) / n
    empty = F.lit(0.0 if least <= 0 else None).cast("double")
    return F.when(n == 0, empty).when(F.abs(F.length(x) - F.length(y)) <= most, F.when(near.between(least, 1.0), near))


def kana_ratio(text: Column) -> Column:
    """Share of characters from U+3041 to U+30FF; 0 for the empty text."""
    other = F.length(F.regexp_replace(text, r"[\x{3041}-\x{30ff}]", ""))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise((F.length(text) - other) / F.length(text))


def is_subsequence(a: Column, b: Column) -> Column:
    """Whether ``a``'s characters stand in ``b`` in order."""
    step = lambda at, c: F.when(at < 0, at).otherwise(
        F.when(F.instr(F.substring(b, at + 1, F.length(b)), c) > 0, at + F.instr(F.substring(b, at + 1, F.length(b)), c)).otherwise(-1)
    )
    chars = F.when(F.length(a) == 0, F.array().cast("array<string>")).otherwise(F.split(a, ""))
    return F.aggregate(chars, F.lit(0), step) >= 0


def diff_relation(old: Column, new: Column) -> Column:
    """'' if either normed text is empty, same from 0.95, add or del for a subsequence, else diff."""
    x, y = norm_text(old), norm_text(new)
    return (
        F.when((x == "") | (y == ""), "")
        .when(edit_similarity(old, new) >= 0.95, "same")
        .when(is_subsequence(x, y), "add")
        .when(is_subsequence(y, x), "del")
        .otherwise("diff")
    )


def containment_match(readings: Column, expected: Column, least: float = 0.5) -> Column:
    """Whether a reading contains the expected text, is contained in it (two characters at least), or shares half of it."""
    bare = lambda c: F.regexp_replace(c, r"[\s·]", "")
    e = bare(expected)
    one = lambda r: bare(r).contains(e) | ((F.length(bare(r)) >= 2) & e.contains(bare(r))) | (lcs_columns(e, bare(r)) >= least)
    return F.exists(readings, one)


def clean_trailing(text: Column) -> Column:
    """Trimmed, without trailing CJK, full-width, general and ASCII punctuation."""
    return F.regexp_replace(F.trim(text), r"[\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\x{2000}-\x{206F}.,!?;:\s]+$", "")


def parse_ts(ts: Column, whole: bool = False) -> Column:
    """Seconds of ``XmYYs``; what follows is ignored unless ``whole``; null where it doesn't fit."""
    pattern = r"^(\d+)m(\d+)s" + ("$" if whole else "")
    part = lambda k: F.regexp_extract(ts, pattern, k).try_cast("int")
    return part(1) * 60 + part(2)


def format_ts(seconds: Column) -> Column:
    """``XmYYs``, by floor division for negative seconds."""
    minutes = F.floor(seconds / 60).cast("int")
    return F.format_string("%dm%02ds", minutes, F.pmod(seconds, F.lit(60)).cast("int"))


def display_title(title: Column) -> Column:
    """``[P07] rest name.json`` as ``P07 name``: brackets and what follows up to white space go, and the suffix."""
    return F.trim(F.replace(F.regexp_replace(title, r"^\[P(\d+)\].*?\s+", "P$1 "), F.lit(".json"), F.lit("")))


def strip_comments(html: Column) -> Column:
    """Without HTML comments, but for conditional ones."""
    return F.regexp_replace(html, r"(?s)<!--(?!\[if).*?-->", "")


def _longest_first(phrases: Iterable[str]) -> str:
    """A pattern that matches, of the phrases that begin at a place, the longest: a trie, each branch of it optional."""
    trie: dict = {}
    for phrase in phrases:
        node = trie
        for c in phrase:
            node = node.setdefault(c, {})
        node[""] = {}

    def said(node: dict) -> str:
        branches = [re.escape(c) + said(below) for c, below in node.items() if c]
        return f"(?:{'|'.join(branches)}){'?' if '' in node else ''}" if branches else ""

    return said(trie)


def to_simplified(text: Column, pairs: dict[str, str] | None = None) -> Column:
    """The text with what ``pairs`` has replaced, the longest phrase that begins at a place first; itself without a table.

    What was replaced is not looked at again.  A table of single characters is worked out without Python.
    """
    pairs = {k: v for k, v in (pairs or {}).items() if k}
    if all(len(k) == 1 and len(v) == 1 for k, v in pairs.items()):
        return F.translate(text, "".join(pairs), "".join(pairs.values())) if pairs else text
    pattern = re.compile(_longest_first(pairs))

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pattern.sub(lambda m: pairs[m[0]], t))

    return replaced(text)


def edit_kind_of(old: str, new: str) -> tuple[str, str, int, int, int]:
    """(kind, description, inserted, deleted, replaced characters) of the normed texts, by matching blocks.

    The kind is same, add, del, replace or mixed.  The description has each change as ``operation:old->new``, joined by
    semicolons, after a sign and the sum where there is one kind of change only.
    """
    keep = lambda s: re.sub(r"[^一-鿿0-9A-Za-z]", "", s or "")
    a, b = keep(old), keep(new)
    sums, said = {"insert": 0, "delete": 0, "replace": 0}, []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op != "equal":
            sums[op] += max(j - i, m - k)
            said.append(f"{op}:{a[i:j]}->{b[k:m]}")
    used = [op for op, n in sums.items() if n]
    if len(used) != 1:
        return ("mixed" if used else "same"), ";".join(said), *sums.values()
    name, sign = {"insert": ("add", "+"), "delete": ("del", "-"), "replace": ("replace", "~")}[used[0]]
    return name, f"{sign}{sums[used[0]]} {';'.join(said)}", *sums.values()


def _edit_kinds(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edit_kind_of(a, b) for a, b in zip(old, new, strict=True)], columns=["kind", "description", "inserted", "deleted", "replaced"])


def edit_kind(old: Column | str, new: Column | str) -> Column:
    """Struct (kind, description, inserted, deleted, replaced) of an edit; no built-in function aligns texts that way."""
    return F.pandas_udf(_edit_kinds, "kind string, description string, inserted int, deleted int, replaced int")(old, new)


def fixed(value: Column, digits: int = 1) -> Column:
    """A number with so many digits after the point, as text."""
    return F.format_string(f"%.{digits}f", value.cast("double"))
