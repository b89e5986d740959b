"""URL filters: pattern rules found by their rarest literal token.

Host rules come first: a rule fits its host and all subdomains if the URL's path
starts with the rule's path; the longest rule wins. They are looked up by host
suffix. Every other URL is judged by pattern rules:

``||`` begin of the host or of one of its labels, ``^`` a separator (any
character but letters, digits and ``%``, or the end), ``*`` anything, ``|`` the
URL's begin or end, ``@@`` before the rule: allow although another rule blocks.

A token of a rule is a run of letters and digits that must stand alone in any
URL that the rule matches. Each rule is indexed under the one of its tokens that
is rarest in the corpus (counted over all URLs); a rule without a token is always
a candidate. A URL's tokens fetch the candidates, and only their regular
expressions are run.

Edge cases: null URLs and those without ``://`` have an empty host and path and
are judged by the pattern rules on the text that there is (null: allowed); equal
lengths of fitting host rules go to the first listed; repeated rows are judged
one by one; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, query, table

HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

PATTERNS = (
    "||*^casino^", "||casino-", "||*-casino^", "||*^pills^", "||*^viagra^", "||*^spam^", "||*^bets^", "||*^betting^", "||*^poker^",
    "||*^porn^", "||*^xxx^", "||*^adult^", "||*^escort^", "||*^warez^", "||*^torrent^", "||*^malware^", "||*^phishing^",
    "||ads.", "||ad.", "||*^ads^track*^", "||*^adserver^", "||*^doubleclick^", "||*^tracker^", "||*^popunder^",
    "/porn/", "/xxx/", "/casino/", "/viagra^", "^cheap^viagra^", "^free^download^crack^", "/ads/banner^",
    "@@||*^spam^filter^", "@@||*^responsible^betting^", "@@||*^adult^education^",
)

TOKEN = re.compile(r"[a-z0-9]+")
URL = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)
UPPER = {c: c + 32 for c in range(65, 91)}


def expression(pattern: str) -> str:
    """The regular expression of a pattern (without ``@@``), for lower-cased URLs."""
    out, at = "", 0
    if pattern.startswith("||"):
        out, at = r"^[^:/?#]*://(?:[^/?#]*\.)?", 2
        if pattern.startswith("||*"):  # anything within the host
            out, at = r"^[^:/?#]*://[^/?#]*?", 3
    elif pattern.startswith("|"):
        out, at = "^", 1
    while at < len(pattern):
        c = pattern[at]
        if c == "^":
            out += r"(?:[^a-z0-9%]|$)" if at + 1 == len(pattern) else r"[^a-z0-9%]"
        elif c == "*":
            out += ".*"
        elif c == "|" and at + 1 == len(pattern):
            out += "$"
        else:
            out += re.escape(c)
        at += 1
    # The separator right after the host's anchor may be the anchor itself.
    return out.replace(r"://[^/?#]*?[^a-z0-9%]", r"://(?:[^/?#]*?[^a-z0-9%/?#])?")


def tokens_of(pattern: str) -> list[str]:
    """Tokens that stand alone in every URL that the pattern matches."""
    body = pattern.removeprefix("@@")
    start = 2 if body.startswith("||") else 1 if body.startswith("|") else 0
    out = []
    for m in TOKEN.finditer(body, start):
        before = m.start() == start and start > 0 or m.start() > start and body[m.start() - 1] != "*"
        after = m.end() < len(body) and body[m.end()] != "*"
        if before and after:
            out.append(m.group())
    return out


@dataclass
class Rules:
    """Pattern rules under their rarest tokens, and host rules under their hosts."""

    by_token: dict[str, list[int]]
    always: list[int]
    compiled: list[tuple[bool, re.Pattern]]
    by_host: dict[str, list[tuple[str, str, str]]]

    def host_rule(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        while host:
            for verdict, name, begin in self.by_host.get(host, ()):
                if path.startswith(begin) and (best is None or len(name) > len(best[1])):
                    best = (verdict, name)
            host = host.partition(".")[2]
        return best

    def pattern_verdict(self, url: str) -> str:
        url = url.translate(UPPER)
        candidates = set(self.always)
        for token in set(TOKEN.findall(url)):
            candidates.update(self.by_token.get(token, ()))
        blocked = False
        for number in sorted(candidates):
            allows, pattern = self.compiled[number]
            if (allows or not blocked) and pattern.search(url):
                if allows:
                    return "allow"
                blocked = True
        return "block" if blocked else "allow"


def build(urls: DataFrame, url_column: str, patterns=PATTERNS, host_rules=HOST_RULES) -> Rules:
    """The rules, indexed by the counts of their tokens over all URLs."""
    wanted = {t for p in patterns for t in tokens_of(p)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(wanted, 0)
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for token in set(TOKEN.findall(url.translate(UPPER) if url else "")):
                    if token in counts:
                        counts[token] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    rows = arrow_map(urls.select(url_column), count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    seen = {r[0]: r[1] for r in rows}
    by_token: dict[str, list[int]] = {}
    always, compiled = [], []
    for number, pattern in enumerate(patterns):
        tokens = tokens_of(pattern)
        if tokens:
            by_token.setdefault(min(tokens, key=lambda t: (seen.get(t, 0), t)), []).append(number)
        else:
            always.append(number)
        compiled.append((pattern.startswith("@@"), re.compile(expression(pattern.removeprefix("@@")))))
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in host_rules:
        by_host.setdefault(host, []).append((verdict, host + path, path))
    return Rules(by_token, always, compiled, by_host)


def url_verdicts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", patterns=PATTERNS, host_rules=HOST_RULES) -> DataFrame:
    """One row per page: host, path, the host rule that decides (or null) and the verdict."""
    rules = pages.sparkSession.sparkContext.broadcast(build(pages, url_column, patterns, host_rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                found = URL.match(url) if url else None
                host, path = (found.group(1).translate(UPPER), found.group(2)) if found else ("", "")
                rule = rules.value.host_rule(host, path)
                out.append((host, path, rule[1] if rule else None, rule[0] if rule else rules.value.pattern_verdict(url or "")))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict"]
            )

    return arrow_map(pages.select(id_column, url_column), judge, "page_id long, host string, path string, rule string, verdict string")


def _sql() -> str:
    fits = [
        (len(host + path), -k, f"(h = '{host}' OR suffix(h, '.{host}')) AND starts_with(p, '{path}')", host + path, verdict)
        for k, (verdict, host, path) in enumerate(HOST_RULES)
    ]
    order = sorted(fits, reverse=True)
    case = lambda field: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[field]}'" for f in order) + " END"
    any_of = lambda allows: " OR ".join(
        f"regexp_matches(u, '{expression(p.removeprefix('@@'))}', 's')" for p in PATTERNS if p.startswith("@@") == allows
    )
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS i FROM pages),
b AS (SELECT page_id, url, CASE WHEN i > 0 THEN substr(url, i + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, {lower.format("url")} AS u, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS p FROM b)
SELECT page_id, h AS host, p AS path, {case(3)} AS rule,
  coalesce({case(4)}, CASE WHEN {any_of(True)} THEN 'allow' WHEN {any_of(False)} THEN 'block' ELSE 'allow' END) AS verdict
FROM c
"""


ORACLE = _sql()


@query("op9_url_filters", ORACLE)
def op9_url_filters(spark, sf_dir):
    return url_verdicts(table(spark, sf_dir, "pages"))
