"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import params

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that str.strip() removes.
WHITE = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
TERM = "[a-zA-Z0-9_-]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WHITE}+", " "))


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z only, as SQLite has it."""
    return F.translate(text, _UPPER, _LOWER)


def density(text: Column) -> Column:
    """Share of letters (L, Nl and No) among the characters; 0 if there are none."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{Nl}\p{No}]", ""))
    return F.when(F.length(text) > 0, letters / F.length(text)).otherwise(F.lit(0.0))


def index_like(text: Column) -> Column:
    """Whether a chunk looks like a table of contents or an index page."""
    named = F.contains(F.lower(F.substring(text, 1, params.TOC_CHARS)), F.lit("table of contents"))
    return named | (density(F.substring(text, 1, params.DENSITY_CHARS)) < params.DENSITY_THRESHOLD)


def terms(query: Column) -> Column:
    """Search terms of a query, in order, repeats included."""
    return F.filter(F.regexp_extract_all(query, F.lit(TERM), F.lit(0)), lambda x: F.length(x) >= 2)


def exact_bonus(text: Column, query: Column, phrase: float = params.PHRASE_BONUS, term: float = params.TERM_BONUS) -> Column:
    """Bonus for the query as it stands and for the share of its terms that the text holds; 0 for a query without terms. The
    text is folded once, for all terms."""
    words = F.transform(terms(query), ascii_lower)
    seen = F.transform(F.array(ascii_lower(text)), lambda low: F.struct(F.contains(low, F.lower(strip(query))).alias("whole"), F.size(F.filter(words, lambda x: F.contains(low, x))).alias("hits")))[0]
    bonus = F.when(seen["whole"], phrase).otherwise(0.0) + F.lit(term) * (seen["hits"] / F.size(words))
    return F.when(F.size(words) > 0, bonus).otherwise(F.lit(0.0))


def candidates(total: Column, limit: int) -> Column:
    """Number of vector candidates for a corpus of a size."""
    base = max(limit * 4, 50)
    adaptive = F.least(total, F.greatest(F.lit(150), F.floor(total * 0.05), F.lit(base)))
    return F.least(F.greatest(F.lit(base), adaptive), F.lit(1500)).cast("long")


def preview(text: Column, chars: int = 100) -> Column:
    return F.translate(F.substring(text, 1, chars), "\n", " ")


def short_parts(budget: int) -> tuple[int, int]:
    """Characters of a text that is over a budget that are kept of its head and of its tail; no tail where the head and the
    mark between them leave no room."""
    head = max(params.SHORT_HEAD_MIN, int(budget * params.SHORT_HEAD))
    tail = budget - head - len(params.SHORT_MARK)
    return (head, tail) if tail > 0 else (max(0, budget), 0)


def short_text(text: str, budget: int) -> str:
    """compact_doc() of one string."""
    head, tail = short_parts(budget)
    return text if len(text) <= budget else text[:head] + (params.SHORT_MARK + text[-tail:] if tail else "")


def compact_doc(text: Column, budget: int) -> Column:
    """Head and tail of a text that is over a budget of characters, as a reranker gets it."""
    head, tail = short_parts(budget)
    cut = F.substring(text, 1, head)
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(cut, F.lit(params.SHORT_MARK), F.right(text, F.lit(tail))) if tail else cut)


def head_of(text: Column) -> Column:
    """What stands before the first empty line."""
    return strip(F.substring_index(text, "\n\n", 1))


def body_of(text: Column) -> Column:
    """What stands after the first empty line, without line feeds before it; empty if there is no such line."""
    gap = F.instr(text, "\n\n")
    return F.when(gap > 0, F.regexp_replace(F.substring(text, gap + 2, F.length(text)), "^\n+", "")).otherwise(F.lit(""))


def compact_header(header: Column, parts: int) -> Column:
    """[doc | a | b | c] with the document and its last parts only; anything else as it is."""
    line = strip(header)
    names = F.filter(F.transform(F.split(F.substring(line, F.lit(2), F.length(line) - 2), r"\|"), strip), lambda x: x != "")
    ends = F.slice(names, F.greatest(F.lit(1), F.size(names) - parts + 1), parts)
    shown = F.concat(F.slice(names, 1, 1), F.filter(ends, lambda x: x != names[0]))
    framed = F.startswith(line, F.lit("[")) & F.endswith(line, F.lit("]")) & (F.length(line) >= 2)
    return F.when(framed & (F.size(names) >= 2), F.concat(F.lit("["), F.array_join(shown, " | "), F.lit("]"))).otherwise(line)


def embedding_input(doc: Column, title: Column, context: Column, text: Column) -> Column:
    """What is embedded for a chunk: its document and section, its context if there is one, its text."""
    head = F.concat(F.lit("["), doc, F.when(F.coalesce(F.length(title), F.lit(0)) > 0, F.concat(F.lit(" | "), title)).otherwise(""), F.lit("]\n\n"))
    own = strip(F.coalesce(context, F.lit("")))
    return F.concat(head, F.when(F.length(own) > 0, F.concat(own, F.lit("\n\n"))).otherwise(""), text)


def progress(done: Column, total: Column) -> Column:
    return F.when(total <= 0, 0).when(done >= total, 100).otherwise(F.least(F.lit(99), F.bround(done / total * 100, 0).cast("int")))


def size_label(size: Column) -> Column:
    of = lambda unit: F.format_string("%.1f", F.bround(size / unit, 1))
    return F.when(size == 0, "-").when(size >= 1 << 20, F.concat(of(1 << 20), F.lit(" MB"))).when(size >= 1 << 10, F.concat(of(1 << 10), F.lit(" KB"))).otherwise(F.concat(size.cast("string"), F.lit(" B")))
