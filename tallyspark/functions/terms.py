"""Many terms found in a text by one pass of one pattern.

Terms become a prefix tree, written as a pattern that matches, without consuming anything, wherever a term begins, and yields the longest one there; every other
term that begins at the same place is a beginning of that one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import let

_BLANK = "[\\s\\u00A0\\u2007\\u202F]+"
_END = ""


def prefix_pattern(terms: Iterable[str]) -> str:
    """A pattern of all terms, each letter branching once; a blank in a term stands for any white space."""
    tree: dict = {}
    for term in terms:
        node = tree
        for ch in " ".join(term.split()).lower():
            node = node.setdefault(_BLANK if ch == " " else ch if ch.isalnum() else "\\" + ch, {})
        node[_END] = {}

    def written(node: dict) -> str:
        branches = [letter + written(below) for letter, below in sorted(node.items()) if letter != _END]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and _END not in node else "(?:" + "|".join(branches) + ")"
        return body + "?" if _END in node else body

    return written({k: v for k, v in tree.items() if k != _END})


def term_hits(low: Column, terms: Iterable[str]) -> Column:
    """Array of (at, term) in order: each place, from 1, of a lower-cased text where a term begins, and the text of the longest one there.

    Each place costs what the array holds before it, so a text should not have more than some thousands of hits.
    """
    pattern = prefix_pattern(terms)
    if not pattern:
        return F.array().cast("array<struct<at:int,term:string>>")
    text = F.coalesce(low, F.lit(""))
    terms_there = F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), 1)
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda state, piece: F.struct((state.at + F.length(piece)).alias("at"), F.concat(state.starts, F.array(state.at)).alias("starts"))
    starts = F.aggregate(F.split(text, f"(?={pattern})"), begin, step, lambda state: state.starts)
    # The text is split where terms begin; what stands before the first term is a piece more.
    both = F.struct(starts.alias("starts"), terms_there.alias("terms"))
    return let(both, lambda x: F.zip_with(F.slice(x.starts, F.size(x.starts) - F.size(x.terms) + 1, F.size(x.terms)), x.terms, lambda at, term: F.struct(at.alias("at"), term.alias("term"))))
