"""Page-view path columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine import fixed_values as V


def _bare(path: Column) -> Column:
    cut = F.substring_index(F.coalesce(path, F.lit("")), "?", 1)
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def path_key(path: Column) -> Column:
    bare = _bare(path)
    return F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def path_type(path: Column) -> Column:
    """Page type by the path as sent; a path without its leading slash is ``other``."""
    bare = _bare(path)
    chain = F
    for exact, name in V.PAGE_EXACT.items():
        chain = chain.when(bare == exact, F.lit(name))
    for prefix, name in V.PAGE_PREFIXES.items():
        chain = chain.when(bare.startswith(prefix), F.lit(name))
    return chain.otherwise(F.lit("other"))


def path_tracked(path: Column) -> Column:
    """Blocked prefixes are plain text prefixes, so ``/adminx`` is blocked too.

    One pattern over the path as sent (with or without its leading slash), so that a filter on it
    evaluates the path once.
    """
    prefixes = "|".join(re.escape(p[1:]) for p in V.BLOCKED_PREFIXES)
    exact = "|".join(re.escape(p[1:]) for p in V.BLOCKED_PATHS)
    return ~F.coalesce(path, F.lit("")).rlike(rf"^/?(?:(?:{prefixes})|(?:{exact})(?:\?|\z))")


def normalize_lang(lang: Column) -> Column:
    return F.when(lang.isin(*V.TRACKED_LANGS), lang).otherwise(F.lit("en"))
