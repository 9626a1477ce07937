"""URL filter: host rules first, then a weighted vocabulary.

An Aho-Corasick automaton counts the strict and soft terms that stand between
boundaries (no letter or digit on either side). One strict term blocks; so do several
distinct soft terms whose weights add up to the limit. A rule for the host decides alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pageloom.llm.common import in_arrow

#: The contract's rules: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
STRICT = ("casino", "cheap-pills", "escort", "jackpot", "porn", "spam-farm", "viagra", "xxx")
SOFT = {"adult": 1.0, "bet": 0.5, "bonus": 0.5, "cheap": 1.0, "crack": 0.5, "deal": 0.5, "farm": 0.5, "free": 0.5,
        "loan": 1.0, "lottery": 1.0, "pills": 1.0, "poker": 1.0, "sex": 1.0, "spam": 1.0, "win": 0.5}
SOFT_LIMIT, SOFT_DISTINCT = 2.0, 2
RESULT = T.StructType([T.StructField(*f) for f in (
    ("host", T.StringType()), ("path", T.StringType()), ("rule", T.StringType()), ("verdict", T.StringType()),
    ("strict_hits", T.LongType()), ("soft_hits", T.LongType()), ("soft_weight", T.DoubleType()))])
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def host_and_path(url: str | None) -> tuple[str, str]:
    found = _PARTS.search(url or "")
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


def matching_rule(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """The longest fitting rule and its verdict; ``rules`` by host, looked up for the host and its parents."""
    best, at = None, 0
    while at >= 0:
        for name, start, verdict in rules.get(host[at:], ()):
            if path.startswith(start) and (best is None or len(name) > len(best[0])):
                best = (name, verdict)
        at = host.find(".", at) + 1 or -1
    return best


def automaton(strict: Iterable[str], soft: dict[str, float]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for term in sorted({*strict, *soft}):
        built.add_word(term, (term, term in set(strict), soft.get(term, 0.0)))
    built.make_automaton()
    return built


def term_hits(url: str, terms: ahocorasick.Automaton) -> tuple[int, int, float]:
    """Strict hits, distinct soft terms, and the weight of these."""
    low, strict, soft = url.translate(_UPPER), 0, {}
    word = lambda i: 0 <= i < len(low) and low[i].isalnum()
    for end, (term, is_strict, weight) in terms.iter(low):
        if not word(end + 1) and not word(end - len(term)):
            if is_strict:
                strict += 1
            else:
                soft[term] = weight
    return strict, len(soft), sum(soft.values())


def judge_urls(pages: DataFrame, url: str = "url", rules: Iterable[tuple[str, str, str]] = RULES,
               strict: Iterable[str] = STRICT, soft: dict[str, float] | None = None,
               soft_limit: float = SOFT_LIMIT, soft_distinct: int = SOFT_DISTINCT) -> DataFrame:
    """``pages`` with the columns of ``RESULT``; columns of ``pages`` with these names are replaced.

    A null url has an empty host and path, fits no rule, has no terms and is allowed. Rows
    are judged one by one, so ties and repeated rows need no care; an empty table gives an
    empty result.
    """
    soft, strict = dict(SOFT if soft is None else soft), tuple(strict)
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((host + path, path, verdict))
    kept = [c for c in pages.columns if c.lower() not in {f.name for f in RESULT} or c == url]
    pages = pages.select(*kept)
    schema = T.StructType([f for f in pages.schema if f.name.lower() not in {f.name for f in RESULT}] + list(RESULT))
    out = [f.name for f in schema[: len(schema) - len(RESULT)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        terms = automaton(strict, soft)
        for batch in batches:
            rows = []
            for value in batch.column(url).to_pylist():
                host, path = host_and_path(value)
                found = matching_rule(host, path, by_host)
                n_strict, n_soft, weight = term_hits(value or "", terms)
                bad = n_strict > 0 or (n_soft >= soft_distinct and weight >= soft_limit)
                name, verdict = found or (None, "block" if bad else "allow")
                rows.append((host, path, name, verdict, n_strict, n_soft, weight))
            made = list(zip(*rows)) or [()] * len(RESULT)
            kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), *map(pa.array, made, kinds)], names=schema.names)

    return pages.transform(in_arrow, run, schema)
