"""Expressions over the text of one bibliography entry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import pmid_from_url


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a costly value once where an expression needs it repeatedly."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _depths(changes: Column) -> Column:
    """How many braces are open behind each piece, counted anew from where none is.

    ``changes`` tells how many more a piece opens than it closes. A fold that
    appends copies its array at each step, so pieces are folded in blocks of about
    the root of their number, and the blocks then put together.
    """
    none = F.array().cast("array<int>")

    def folded(known: Column) -> Column:
        given, step = known["changes"], known["step"]

        def block(done: Column, begin: Column) -> Column:
            start = F.struct(done["depth"].alias("depth"), none.alias("all"))
            inner = F.aggregate(F.slice(given, begin, step), start, _next)
            return _let(inner, lambda x: F.struct(x["depth"], F.concat(done["all"], x["all"]).alias("all")))

        begins = F.when(F.size(given) > 0, F.sequence(F.lit(1), F.size(given), step)).otherwise(none)
        start = F.struct(F.lit(0).alias("depth"), none.alias("all"))
        return F.aggregate(begins, start, block, lambda done: done["all"])

    def sized(given: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(given))).cast("int"), F.lit(1))
        return _let(F.struct(given.alias("changes"), step.alias("step")), folded)

    return _let(changes, sized)


def _next(done: Column, change: Column) -> Column:
    depth = F.greatest(done["depth"], F.lit(0)) + change
    return F.struct(depth.alias("depth"), F.array_append(done["all"], depth).alias("all"))


def _depth(piece: Column) -> Column:
    """Braces that a text opens, less those it closes."""
    opened = F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
    closed = F.length(piece) - F.length(F.replace(piece, F.lit("}"), F.lit("")))
    return opened - closed


def _own_fields(entry: Column) -> Column:
    """The entry without commas inside its values, so that only its own fields follow one."""

    def flat(tokens: Column) -> Column:
        def marked(depths: Column) -> Column:
            # A brace token changes the depth behind it, so it has the depth of what it ends or begins.
            return F.array_join(
                F.transform(
                    tokens,
                    lambda x, i: F.when(F.get(depths, i) > 1, F.replace(x, F.lit(","), F.lit(" "))).otherwise(x),
                ),
                "",
            )

        return _let(_depths(F.transform(tokens, _depth)), marked)

    return _let(F.split(entry, r"(?<=[{}])|(?=[{}])"), flat)


def bib_field(entry: Column, name: str) -> Column:
    """Value of a field in braces, quotes or as a bare number; else null."""
    field = rf"""(?i),\s*{name}\s*=\s*([{{"][^}}"]*[}}"]|\d+)"""
    top = F.when(F.regexp_like(entry, F.lit(field)), _own_fields(entry))
    found = F.try_element_at(F.regexp_extract_all(top, F.lit(field), F.lit(1)), F.lit(1))
    return F.nullif(F.regexp_replace(found, r"""\A[{"\s]+|[}"\s]+\z""", ""), F.lit(""))


# An entry starts at a line that begins with @type{; these types hold no work.
_ENTRY_START = r"(?m)^[ \t]*@(?=\w+\s*[{(])"
_NO_WORK = r"(?i)\A(comment|string|preamble)\b"


def bib_entries(text: Column) -> Column:
    """Entries of a bibliography in order, without their ``@``.

    A line that looks like a start inside the braces of an entry belongs to that
    entry. If a file's braces do not match, every such line starts an entry.
    """

    def entries(pieces: Column) -> Column:
        def merged(depths: Column) -> Column:
            last = F.size(pieces)
            # Where no brace is open before a piece, an entry starts.
            starts = F.filter(F.sequence(F.lit(1), last), lambda i: (i == 1) | (F.get(depths, i - 2) <= 0))

            def cut(begins: Column) -> Column:
                def entry(begin: Column, k: Column) -> Column:
                    end = F.coalesce(F.get(begins, k + 1), last + 1)
                    return F.array_join(F.slice(pieces, begin, end - begin), "@")

                return F.transform(begins, entry)

            return F.when(F.get(depths, last - 1) == 0, _let(starts, cut)).otherwise(pieces)

        changes = F.transform(pieces, _depth)
        # Where each piece closes what it opens, there is nothing to put together.
        plain = _let(changes, lambda c: F.when(F.exists(c, lambda d: d != 0), _let(_depths(c), merged)))
        return F.filter(F.coalesce(plain, pieces), lambda e: ~e.rlike(_NO_WORK))

    return _let(F.slice(F.split(text, _ENTRY_START), 2, 1 << 30), entries)


def bib_ids(pmid: Column, url: Column, strict: bool = False) -> Column:
    """Article ids of an entry: its own, then the one in its address.

    An address with a trailing slash gives an empty id, kept unless ``strict``.
    """
    own = F.nullif(pmid, F.lit(""))
    linked = pmid_from_url(url)
    if strict:
        linked = F.nullif(linked, F.lit(""))
    return F.array_compact(F.array(own, linked))
