"""URL filters: host and path rules, and a weighted vocabulary for the URLs that no rule fits.

The host of a URL is what follows its first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path goes on from there
to ``?``, ``#`` or the end.  A rule has a host and a path.  It fits its host and all subdomains of it, if the URL's path starts
with the rule's; of several that fit, the one with the longest host wins, then the one with the longest path.

Where no rule fits, an Aho-Corasick automaton finds every term of the vocabulary in the whole lower-cased URL in one pass.
An occurrence counts if no word character (a-z, 0-9, or any beyond ASCII) stands beside it.  A strict term weighs as much as the
limit, a soft term its own weight, each term once: the URL is blocked if the weights reach the limit, that is by
one strict term or by several distinct soft ones.

Rules and vocabulary are parameters of a user's size (lists of terms, not data): they travel with the task.

Defined cases: a NULL URL or one without ``://`` has an empty host and path, so no rule fits it, and is judged by the vocabulary
(a NULL is allowed); a repeated row gets a row each; an empty table gives no rows; an empty vocabulary blocks nothing; of
rules with equal host and path the first counts; ``judge`` reads id and URL only, ``keep_allowed`` keeps all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, arrow_schema, batches_of, worker_state

#: The rules of the contract, as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Terms that block by themselves.
STRICT = ("bestiality", "camgirl", "camgirls", "casino", "casinos", "escort", "escorts", "hentai", "jackpot", "onlyfans", "porn",
          "porno", "pornhub", "sexcam", "torrent", "torrents", "viagra", "warez", "webcam-sex", "xnxx", "xvideos", "xxx")
#: Terms that block in company, with their weights.
SOFT = {"18plus": 1, "adult": 1, "bet": 1, "betting": 1, "bonus": 1, "cheap": 1, "coupon": 1, "crack": 1, "dating": 1, "deal": 1,
        "deals": 1, "download": 1, "farm": 1, "free": 1, "gambling": 1, "girls": 1, "hack": 1, "hot": 1, "keygen": 1, "loan": 1,
        "loans": 1, "lottery": 1, "nude": 1, "payday": 1, "pharmacy": 1, "pills": 1, "poker": 1, "promo": 1, "replica": 1, "sex": 1,
        "sexy": 1, "slots": 1, "spam": 1, "win": 1, "winner": 1}
LIMIT = 2

ASCII_LOWER = str.maketrans(UPPER, LOWER)
VERDICTS = "host string, path string, rule string, verdict string, weight long, n_strict long, n_soft long, hits string"


@dataclass(frozen=True)
class UrlPolicy:
    """Rules, and a vocabulary of terms with their weights."""

    rules: tuple = RULES
    strict: tuple = STRICT
    soft: tuple = tuple(SOFT.items())
    limit: int = LIMIT


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path)."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(ASCII_LOWER), slash + path


def rule_table(rules: Iterable[tuple]) -> dict[str, list[tuple[str, str]]]:
    """host -> [(path, verdict)], the longest path first."""
    found: dict[str, dict[str, str]] = {}
    for verdict, host, path in rules:
        found.setdefault(host, {}).setdefault(path, verdict)
    return {host: sorted(paths.items(), key=lambda p: (-len(p[0]), p[0])) for host, paths in found.items()}


def fitting_rule(host: str, path: str, table: dict) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits: the host, then each of its parents."""
    while host:
        for start, verdict in table.get(host, ()):
            if path.startswith(start):
                return host + start, verdict
        host = host.partition(".")[2]
    return None


def automaton(policy: UrlPolicy):
    """The worker's automaton of the policy's terms, built once."""
    import ahocorasick

    kept = worker_state("url_filter")
    key = policy.strict, policy.soft, policy.limit
    if key not in kept:
        built = ahocorasick.Automaton()
        for term, weight in policy.soft:
            built.add_word(term, (term, weight, False))
        for term in policy.strict:
            built.add_word(term, (term, policy.limit, True))
        if len(built):
            built.make_automaton()
        kept[key] = built
    return kept[key]


def word_character(c: str) -> bool:
    return c > "\x7f" or c.isalnum()


def term_hits(url: str | None, found) -> dict[str, tuple[int, bool]]:
    """term -> (weight, strict) of the terms that stand in the URL as words of their own."""
    text = (url or "").translate(ASCII_LOWER)
    hits = {}
    if text and len(found):
        for end, (term, weight, strict) in found.iter(text):
            start = end - len(term) + 1
            if not (start and word_character(text[start - 1])) and not (end + 1 < len(text) and word_character(text[end + 1])):
                hits[term] = weight, strict
    return hits


def verdict_of(url: str | None, table: dict, found, limit: int) -> tuple:
    """VERDICTS of a URL."""
    host, path = split_url(url)
    hits = term_hits(url, found)
    weight, n_strict = sum(w for w, _ in hits.values()), sum(s for _, s in hits.values())
    rule = fitting_rule(host, path, table)
    verdict = rule[1] if rule else "block" if weight >= limit else "allow"
    return host, path, rule[0] if rule else None, verdict, weight, n_strict, len(hits) - n_strict, ",".join(sorted(hits))


def judge(pages: DataFrame, policy: UrlPolicy = UrlPolicy(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col`` as page_id, and VERDICTS: weight, strict and distinct soft terms and the terms themselves too."""
    ddl = "page_id long, " + VERDICTS

    def run(batches):
        table, found = rule_table(policy.rules), automaton(policy)
        yield from batches_of(((i, *verdict_of(u, table, found, policy.limit)) for b in batches
                               for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), arrow_schema(ddl))

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).mapInArrow(run, ddl)


def keep_allowed(pages: DataFrame, policy: UrlPolicy = UrlPolicy(), url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, with all their columns."""
    at = pages.columns.index(url_col)

    def run(batches):
        import pyarrow as pa

        table, found = rule_table(policy.rules), automaton(policy)
        for b in batches:
            kept = np.array([verdict_of(u, table, found, policy.limit)[3] == "allow" for u in b.column(at).to_pylist()], bool)
            yield b.filter(pa.array(kept))

    return pages.mapInArrow(run, pages.schema)
