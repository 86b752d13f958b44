"""Text functions of tags."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..model import BRAND_KEYS, ROLES


def trim_all(c: Column) -> Column:
    """Strips Unicode white space at both ends; ``trim`` strips plain spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def full_match(c: Column, pattern: str) -> Column:
    """``\\z`` because ``$`` would also match before a final newline."""
    return c.rlike(rf"^(?:{pattern})\z")


#: Classes of tag values, by name.
VALUE_CLASSES = {
    "numeric_like": r"^[-+]?[0-9]+([.,][0-9]+)?\z",
    "url_like": r"^https?://",
    "phone_like": r"^\+?[0-9][0-9 ()\-./]{5,}\z",
    "wikidata_qid": r"^Q[0-9]+\z",
    "lang_prefixed": r"^[a-z]{2,3}:",
    "non_ascii": r"[^\x00-\x7F]",
    "token_like": r"^[a-z0-9_]+(;[a-z0-9_]+)*\z",
}


def tag_ids(tags: Column, roles: dict[str, str] = ROLES) -> Column:
    """The ``key=value`` ids of a tag map, duplicates kept.

    Keys without a role fall away before any value is touched. Brands are trimmed only; other
    values are split at ``;``, trimmed and lower-cased. Blank parts are dropped. Null map: null.
    """
    brands = [k for k, r in roles.items() if r == "brand"] or BRAND_KEYS
    kept = F.map_filter(tags, lambda k, v: k.isin(*roles) & v.isNotNull())

    def ids(e: Column) -> Column:
        k, v = e["key"], e["value"]
        parts = F.when(k.isin(*brands), F.array(v)).otherwise(F.split(F.lower(v), ";", -1))
        return F.transform(F.filter(F.transform(parts, trim_all), lambda p: p != ""), lambda p: F.concat(k, F.lit("="), p))

    return F.flatten(F.transform(F.map_entries(kept), ids))


def key_group(key: Column) -> Column:
    """``addr:city`` to ``addr:*``."""
    return F.when(key.contains(":"), F.concat(F.split_part(key, F.lit(":"), F.lit(1)), F.lit(":*"))).otherwise(key)


def json_safe_id(i: Column) -> Column:
    """Ids beyond 2**53 - 1 don't survive JSON readers as numbers; all come as text."""
    return i.cast("string")


def normalise_lens(text: str) -> str:
    """NFKC, trimmed, white space collapsed, and then final full stops stripped."""
    return re.sub(r"[。.]+$", "", re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).strip()))


@F.pandas_udf(StringType())
def normalised_lens(texts: pd.Series) -> pd.Series:
    """``normalise_lens`` of a column, in Arrow batches, as Spark has no NFKC; null stays null."""
    return texts.map(normalise_lens, na_action="ignore")


def utf16_units(text: str) -> int:
    """Length as JavaScript counts it, which is the unit of request budgets."""
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def summary(c: Column, most: int = 300) -> Column:
    """The first ``most`` characters of a body, with an ellipsis if there are more."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def parse_tags(c: Column) -> Column:
    """A tag map back from its JSON text; text that isn't an object of strings gives an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def answer_value(answer: Column, primitive: Column) -> tuple[Column, Column]:
    """``(number, choice)`` of an answer in JSON: a noul's ``probability`` (or ``noul``), a score's ``score``, a choice's ``choice``."""
    a = F.from_json(answer, "probability double, noul double, score double, choice string")
    number = F.when(primitive == "noul", F.coalesce(a["probability"], a["noul"])).when(primitive == "score", a["score"])
    return F.when(~F.isnan(number), number), F.when(primitive == "choice", a["choice"])


def variant_label(primitive: Column, variant: Column) -> Column:
    """``choice-v3`` for a named variant, else the primitive alone."""
    return F.when(F.coalesce(variant, F.lit("")) != "", F.concat(primitive, F.lit("-"), variant)).otherwise(primitive)
