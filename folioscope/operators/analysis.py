"""What kind of question a query is, and which folder or date it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that tell the kind of a query. Fixed values.
BROAD = ("overview", "summary", "summarize", "general", "explain", "describe", "introduction")
NAVIGATIONAL = ("where", "find", "locate", "location", "path")
ASKING = ("what", "how", "why", "when", "which")
#: Identifiers, versions, paths, folder and date hints. Fixed values.
IDENTIFIER = "[a-z]+_[a-z]|[a-z][A-Z]|[a-zA-Z]+\\.[a-zA-Z]+"
VERSION = "\\d+\\.\\d+"
PATH = "[/\\\\][\\w.-]+"
FOLDER = "(?i)(?:in\\s+folder|from\\s+folder|folder)\\s+[\"']?([/\\w.-]+)[\"']?"
IN_PATH = "(?i)(?:in|from)\\s+[\"']?([/\\w.-]*[/][/\\w.-]*)[\"']?"
DATE = "(?:since|after|before|from)\\s+(\\d{4}[-/]\\d{2}(?:[-/]\\d{2})?)"


def _hits(c: Column, rx: str) -> Column:
    return F.regexp_count(c, F.lit(rx))


def analyzed(queries: DataFrame, text: str) -> DataFrame:
    """``queries`` with ``classification`` (specific, navigational or broad, in this order on ties), ``folder_hint``, ``date_hint``.

    A null query is classified as an empty one.
    """
    q = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(q, "\\s+"), lambda w: w != "")
    low, n = F.transform(words, F.lower), F.size(words)
    among = lambda these: F.size(F.filter(low, lambda w: w.isin(*these)))
    broad_words = among(BROAD)
    broad = broad_words * 2.0 + F.when(F.startswith(F.lower(q), F.lit("what is")) & (n <= 5), 2.0).otherwise(0.0) + F.when(n <= 3, 1.0).otherwise(0.0)
    specific = _hits(q, IDENTIFIER) * 2.0 + _hits(q, VERSION) * 1.5 + F.when((n >= 6) & (broad_words == 0), 1.5).otherwise(0.0)
    named = n.between(2, 4) & (among(ASKING) == 0) & (broad_words == 0)
    navigational = among(NAVIGATIONAL) * 2.0 + _hits(q, PATH) * 2.0 + F.when(named, 1.0).otherwise(0.0)
    kind = F.when((specific >= navigational) & (specific >= broad), "specific").when(navigational >= broad, "navigational").otherwise("broad")
    hint = lambda rx: F.nullif(F.regexp_extract(q, rx, 1), F.lit(""))
    return queries.withColumns({"classification": kind, "folder_hint": F.coalesce(hint(FOLDER), hint(IN_PATH)), "date_hint": hint(DATE)})
