"""URL filter: host rules first, then a weighted vocabulary searched with an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from granary.llm.common import modest_batches

#: The vocabulary that is taken where none is given.
TERMS = Path(__file__).with_name("url_terms.tsv")
#: Rules of host and path with their verdicts.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: A term of this weight rejects a URL alone; weaker ones do so together, each counting once.
STRICT = 1000
#: Terms that travel with the plan at most.
MOST_TERMS = 200_000


def terms_of(rows: Iterable) -> tuple[tuple[str, int], ...]:
    """A vocabulary from rows (term, weight): lower-cased, sorted, the greatest weight of a term that comes twice."""
    found: dict[str, int] = {}
    for term, weight in rows:
        if term and weight and weight > 0:
            found[lower(term)] = max(found.get(lower(term), 0), int(weight))
    if len(found) > MOST_TERMS:
        raise ValueError(f"{len(found)} terms; a vocabulary has {MOST_TERMS} at most")
    return tuple(sorted(found.items()))


def read_terms(path: str | Path) -> tuple[tuple[str, int], ...]:
    """A vocabulary from a file of lines: term, tab, weight, below a line of names."""
    with open(path, encoding="utf-8") as file:
        return terms_of((t, int(w)) for t, w in (line.rstrip("\n").split("\t") for line in list(file)[1:] if line.strip()))


def table_terms(table: DataFrame, term_col: str = "term", weight_col: str = "weight") -> tuple[tuple[str, int], ...]:
    """A vocabulary from a table, which is refused beyond ``MOST_TERMS`` rows."""
    return terms_of((r[0], r[1]) for r in table.select(term_col, weight_col).limit(MOST_TERMS + 1).collect())


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = [i for i in map(rest.find, "?#") if i >= 0]
    rest = rest[: min(cut)] if cut else rest
    host, slash, path = rest.partition("/")
    return lower(host), slash + path


def lower(text: str) -> str:
    """A-Z lower-cased, all else as it was."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


@lru_cache(8)
def by_host(rules: tuple) -> tuple[dict[str, list[tuple[str, str, str]]], int]:
    """Rules by host, the longest first, and the most labels that a host among them has."""
    found: dict[str, list] = {}
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        host, slash, path = rule.partition("/")
        found.setdefault(host, []).append((slash + path, rule, verdict))
    return found, max((h.count(".") + 1 for h in found), default=0)


def ruled(host: str, path: str, rules: tuple) -> tuple[str, str] | None:
    """The longest rule that fits the host or a domain above it and begins the path."""
    table, labels = by_host(rules)
    # No more labels than a rule has are looked at, however many the host has.
    parts, best = host.rsplit(".", labels), None
    for i in range(len(parts) > labels, len(parts)):
        for start, rule, verdict in table.get(".".join(parts[i:]), ()):
            if path.startswith(start):
                if best is None or len(rule) > len(best[0]):
                    best = rule, verdict
                break
    return best


@lru_cache(8)
def automaton(terms: tuple) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in terms:
        found.add_word(term, (term, weight))
    if len(found):
        found.make_automaton()
    return found


def hits(url: str | None, terms: tuple) -> tuple[int, int, int]:
    """Numbers of distinct strict and other terms that stand between other than a-z, 0-9, and the weight of all."""
    search = automaton(terms)
    if not url or not len(search):
        return 0, 0, 0
    text = lower(url)
    inner = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()
    found = {hit for end, hit in search.iter(text) if not inner(end - len(hit[0])) and not inner(end + 1)}
    n = sum(weight >= STRICT for _, weight in found)
    return n, len(found) - n, sum(weight for _, weight in found)


def judge_urls(pages: DataFrame, rules: tuple = RULES, terms: tuple | None = None, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict and n_soft (distinct terms in the whole URL) and weight per row.

    A rule decides where one fits; elsewhere terms whose weights come to ``STRICT`` block: one strict one or several
    different weaker ones.  ``terms`` is a vocabulary of :func:`read_terms` or :func:`table_terms`; without it the file
    beside this module is taken.
    Null and empty URLs, and those without ``://``, have empty host and path, fit no rule and are still
    searched, whatever their length; repeated rows each get their row; an empty table gives no rows; other columns
    are ignored.  Rules and terms are parameters that travel with the tasks; nothing is shuffled.
    """
    modest_batches(pages.sparkSession)
    terms = read_terms(TERMS) if terms is None else terms
    kind = pages.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("page_id", kind)]
        + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
        + [T.StructField(c, T.LongType()) for c in ("n_strict", "n_soft", "weight")]
    )

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url in frame["url"]:
                host, path = parts(url)
                rule = ruled(host, path, rules)
                n_strict, n_soft, weight = hits(url, terms)
                verdict = rule[1] if rule else "block" if weight >= STRICT else "allow"
                rows.append((host, path, rule and rule[0], verdict, n_strict, n_soft, weight))
            out = pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "n_strict", "n_soft", "weight"])
            out.insert(0, "page_id", frame["page_id"].to_numpy())
            yield out

    return pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url")).mapInPandas(judged, schema)


def sql(rules: tuple = RULES, terms: tuple | None = None) -> str:
    """The report in DuckDB's SQL."""
    terms = read_terms(TERMS) if terms is None else terms
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        host, slash, path = rule.partition("/")
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')", rule, verdict))
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    listed = ", ".join(f"('{t}', {w})" for t, w in terms)
    return f"""
WITH terms(term, weight) AS (VALUES {listed}),
u AS (SELECT row_number() OVER () AS r, page_id, translate(coalesce(url, ''), {az}) AS low,
   CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT r, page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), {az}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT r, count(*) FILTER (WHERE weight >= {STRICT}) AS n_strict, count(*) FILTER (WHERE weight < {STRICT}) AS n_soft, sum(weight)::BIGINT AS weight
   FROM u JOIN terms ON strpos(low, term) > 0 AND regexp_matches(low, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY r),
n AS (SELECT *, {case(1)} AS rule, {case(2)} AS ruled FROM p)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(weight, 0) >= {STRICT} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, coalesce(weight, 0) AS weight
FROM n LEFT JOIN h USING (r)
"""
