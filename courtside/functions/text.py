"""Text, link and URL column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: team codes that belong to one franchise
TEAM_ALIASES = {"NOK": "NOH", "NOP": "NOH", "NJN": "BRK", "WSB": "WAS"}


def initials(name: Column) -> Column:
    """First letter and the letter after the first space; without a space the
    first letter twice."""
    return F.concat(
        F.substring(name, 1, 1), F.substr(name, F.instr(name, " ") + 1, F.lit(1))
    )


def canonical_team(code: Column) -> Column:
    mapped = F.create_map(*[F.lit(x) for kv in TEAM_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(mapped, code), code)


def extract(text: Column, pattern: str) -> Column:
    """First match or NULL."""
    return F.regexp_substr(text, F.lit(pattern))


def remove_first(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, f"^(.*?){pattern}", "$1")


def url_params(url: Column) -> Column:
    """Query string as a map; NULL when there is none."""
    return F.str_to_map(F.try_parse_url(url, F.lit("QUERY")), F.lit("&"), F.lit("="))


def override_param(params: Column, name: str, value: Column) -> Column:
    """Map with one parameter set, whether or not it was there."""
    rest = F.map_filter(params, lambda k, _: k != name)
    return F.map_concat(rest, F.create_map(F.lit(name), value))


def dedupe_param(url: Column, name: str) -> Column:
    """Drop the earlier ``?name=...`` of a doubled one."""
    doubled = F.regexp_count(url, F.lit(name)) > 1
    return F.when(
        doubled, F.regexp_replace(url, rf"^(.*?)\?{name}.*?(?=\?{name})", "$1")
    ).otherwise(url)


def link_slug(link: Column, folder: str) -> Column:
    """``/teams/ABC/1999.html`` to ``ABC``; NULL when the link is of another kind."""
    return F.nullif(F.regexp_extract(link, rf"/{folder}/([^/]+)", 1), F.lit(""))


def whole_word(text: Column, word: Column) -> Column:
    """Text holds the word, case-insensitive, between non-word characters.

    The borders are spelled out over all letters, so accented neighbours count
    as part of a word.
    """
    edge = r"[\p{L}\p{N}_]"
    return F.regexp_like(
        F.lower(text), F.concat(F.lit(f"(?<!{edge})"), F.lower(word), F.lit(f"(?!{edge})"))
    )
