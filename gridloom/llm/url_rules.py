"""URL verdicts by pattern rules that are indexed by their rarest literal token.

A rule is a host suffix with a path prefix, or a pattern in the public syntax of
filter lists (``parse``), compiled to a regular expression over host and path
with the literal tokens that any match holds whole. The tokens of all URLs are
counted by group, those that some rule has are kept (a few numbers), and each
rule is filed under its token that is rarest among the URLs. A URL fetches the
rules filed under its own tokens, and only those run their regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import record
from gridloom.session import let_workers_import

_OUT = "page_id long, host string, path string, rule string, verdict string, pattern string"
_OUT_ARROW = pa.schema([("page_id", pa.int64()), *((x, pa.string()) for x in ("host", "path", "rule", "verdict", "pattern"))])
_TOKEN = re.compile("[0-9a-z]+")
_LOW = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Rules at most: their index goes to every task.
MOST_RULES = 1 << 20


@dataclass(frozen=True)
class Rule:
    """name: as returned; regex: searched in host + path; tokens: alphanumeric runs that any match holds whole.

    A listed rule is searched as it is, a pattern with A-Z lower-cased.
    """

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    listed: bool = False


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits host and its subdomains where the path starts with path."""
    tokens = tuple(_TOKEN.findall(host.lower()))
    return Rule(host + path, verdict, rf"\A(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}", tokens, True)


#: What the signs of a pattern stand for, and whether a token may end beside them.
_SIGNS = {"*": ("(?s:.*)", False), "^": (r"(?:[^0-9a-z_.%-]|\Z)", True)}


def parse(line: str) -> Rule | None:
    """A pattern of a filter list; None for comments (!) and empty lines.

    ``||`` begins at a label of the host, ``|`` at either end is the beginning
    or the end of host and path, ``*`` is anything, ``^`` a separator or the end,
    ``@@`` before a pattern makes an exception, which allows. Options ($) and
    element rules (##) concern pages, not URLs, and are an error.
    """
    name = line.strip()
    if not name or name.startswith("!"):
        return None
    if "$" in name or "##" in name:
        raise ValueError(f"options and element rules are not read: {name}")
    verdict, body = ("allow", name[2:]) if name.startswith("@@") else ("block", name)
    body = body.translate(_LOW)
    start, bounded = (r"\A(?:[^/]*\.)?", True) if body.startswith("||") else (r"\A", True) if body.startswith("|") else ("", False)
    body = body.lstrip("|") if start else body
    end = r"\Z" if body.endswith("|") else ""
    body = body.removesuffix("|")
    out, tokens, at = [start], [], 0
    for part in re.findall(r"[0-9a-z]+|[*^]|[^0-9a-z*^]", body):
        at += len(part)
        if part in _SIGNS:
            text, bounded = _SIGNS[part]
        else:
            text, whole = re.escape(part), bool(_TOKEN.fullmatch(part))
            after = body[at : at + 1]
            if whole and bounded and (after not in ("", "*") or (after == "" and end)):
                tokens.append(part)
            bounded = not whole
        out.append(text)
    return Rule(name, verdict, "".join(out) + end, tuple(dict.fromkeys(tokens)))


def parse_all(lines: Iterable[str]) -> tuple[Rule, ...]:
    found = tuple(r for r in map(parse, lines) if r)
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return found


def read_rules(rules: DataFrame, line: str) -> tuple[Rule, ...]:
    """The patterns in a column of a table, of MOST_RULES rows at most."""
    return parse_all(r[0] or "" for r in rules.select(line).limit(MOST_RULES + 1).collect())


#: The listed rules of the query; fixed values of its contract.
LISTED = (host_rule("block", "net", "/"), host_rule("allow", "example.net", "/en/"), host_rule("block", "example.com", "/de/"), host_rule("allow", "org", "/fr/"))

#: Patterns for URLs that no listed rule fits: trackers, advertisements and what training data does without.
PATTERNS = parse_all(
    """
! advertisements and trackers
||ads-track.*^
||ads.*^
||adserver.*^
||tracker.*^
||click.*.com^*/redirect/
^banner^*.gif|
/pixel.gif|
! adult, gambling, pills, counterfeits
||adult-*.
||porn.*^
||xxx.*^
||casino.*^
-casino.
||casino-
||poker-*.
||jackpot.*^
||lottery.*^
||viagra.*^
||cheap-pills.*^
||replica-*.
! logins and copies of pages
/wp-login.php|
^calendar^*^day^
! exceptions
@@||lottery.*.org^history^
@@||casino.*^museum/
""".splitlines()
)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host after the first ``://``, A-Z lower-cased, and the path up to ? or #."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = re.search("[/?#]", rest)
    at = end.start() if end else len(rest)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at]) if not rest[:at].islower() else rest[:at]
    stop = re.search("[?#]", rest[at:])
    return host, rest[at : at + stop.start()] if stop else rest[at:]


def url_tokens(text: str) -> set[str]:
    """The alphanumeric runs of host and path with A-Z lower-cased."""
    return set(_TOKEN.findall(text))


def token_counts(urls: DataFrame, url: Column, wanted: list[str]) -> dict[str, int]:
    """For each wanted token the number of URLs that hold it whole.

    URLs are split into their tokens once, whatever the number of rules; only
    wanted tokens, a broadcast of their number, are counted and reach the driver.
    """
    if not wanted:
        return {}
    words = F.regexp_extract_all(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^?#]*)", 1)), F.lit("[0-9a-z]+"), 0)
    asked = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    met = urls.select(F.explode(F.array_distinct(words)).alias("token")).join(F.broadcast(asked), "token", "left_semi")
    return {r["token"]: r["n"] for r in met.groupBy("token").agg(F.count("*").alias("n")).collect()}


def index_rules(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules by their rarest token (ties: the longer, then the smaller token), and those without a token."""
    index: dict[str, list[Rule]] = {}
    rest = []
    for rule in rules:
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(rule)
        else:
            rest.append(rule)
    return index, rest


def judge(host: str, path: str, index: dict[str, list[Rule]], rest: list[Rule], compiled: dict[str, re.Pattern]) -> tuple[str | None, str, str | None]:
    """Rule, verdict and pattern of one URL: the longest listed rule that fits, else an exception, else a blocking pattern, else allow."""
    text = host + path
    low = text.translate(_LOW)
    run = lambda r: compiled[r.regex].search(text if r.listed else low)
    fitting = [r for t in url_tokens(low) & index.keys() for r in index[t] if run(r)]
    fitting += [r for r in rest if run(r)]
    if listed := [r for r in fitting if r.listed]:
        best = max(listed, key=lambda r: (len(r.name), r.name))
        return best.name, best.verdict, None
    if fitting:
        first = min(fitting, key=lambda r: (r.verdict != "allow", r.name))
        return None, first.verdict, first.name
    return None, "allow", None


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict for each row of pages: page_id, host, path, rule, verdict, pattern.

    rule names the listed rule that decided (the longest that fits), else it is
    null and the verdict comes from the patterns: allow where an exception fits,
    block where another does (in pattern the first of them by name), else allow.
    Null urls and urls without ``://`` have empty
    host and path, and are allowed. Null ids pass through; repeated rows are
    judged alike; other columns are not read; no rows give no rows.
    """
    spark = pages.sparkSession
    let_workers_import(spark)
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    wanted = sorted({t for r in rules for t in r.tokens})
    index, rest = index_rules(list(rules), token_counts(urls, F.col("url"), wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.regex: re.compile(r.regex) for r in rules}
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column(1).to_pylist()]
            said = [judge(h, p, index, rest, compiled) for h, p in parts]
            yield record(_OUT_ARROW, batch.column(0), [h for h, _ in parts], [p for _, p in parts], [x[0] for x in said], [x[1] for x in said], [x[2] for x in said])

    return urls.mapInArrow(run, _OUT)


def _sql_pattern(rules: tuple[Rule, ...]) -> str:
    """The first rule that fits the column low, exceptions first, then by name."""
    ordered = sorted(rules, key=lambda r: (r.verdict != "allow", r.name))
    return "case " + " ".join(f"when regexp_matches(low, '{r.regex.replace('\\Z', '\\z')}') then '{r.name}'" for r in ordered) + " end"


ORACLE = rf"""
with a as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
b as (select page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host from a),
c as (select page_id, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') path from b),
d as (select page_id, host, path, translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low, case
  when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
  when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end rule from c),
e as (select page_id, host, path, rule, case when rule is null then {_sql_pattern(PATTERNS)} end pattern from d)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null or pattern is null or starts_with(pattern, '@@') then 'allow' else 'block' end verdict, pattern
from e
"""
