"""Allow and block rules for URLs, by longest match in a broadcast trie.

The trie's edges are host labels from the right, then whole path segments; a node may also hold path ends that
stop within a segment. A rule (host, path) fits its host and all subdomains if the URL's path starts with the
rule's. Of the rules that fit, the longest wins (host and path together; at a tie the longer host, then allow).
URLs that no rule fits get the default verdict, which is to allow.

Rules are broadcast in blocks of a fixed size, one pass of the pages for each, so the broadcast has a bound
whatever the number of rules. Null URLs and those without `://` have an empty host and path and no rule. Repeated
rows are judged alike; an empty table gives no rows; page_id may be null or repeat; very long URLs are judged whole; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fairlead.functions.tables import load

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BLOCK = 200_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HOST, PATH, ENDS = 0, 1, 2


def parts(url: str | None) -> tuple[str, str]:
    """Host and path: up to the first `/`, `?` or `#` after `://`, and from there up to `?` or `#`."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def build(rules: Iterable[tuple[str, str, str]]) -> list:
    """A node is [children by host label, children by path segment, [(rest of path, rank, rule, verdict)]]."""
    root: list = [{}, {}, []]
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.translate(LOWER).split(".")):
            node = node[HOST].setdefault(label, [{}, {}, []])
        *segments, rest = path.split("/")
        for segment in segments:
            node = node[PATH].setdefault(segment, [{}, {}, []])
        name = host.translate(LOWER) + path
        node[ENDS].append((rest, (len(name), len(host), verdict == "allow"), name, verdict))
    return root


def longest(root: list, host: str, path: str) -> tuple | None:
    """The winning (rank, rule, verdict)."""
    best, node, segments = None, root, path.split("/")
    for label in reversed(host.split(".")):
        node = node[HOST].get(label)
        if node is None:
            break
        at, inner = node, 0
        while at is not None:
            for rest, *end in at[ENDS]:
                if segments[inner].startswith(rest) or not rest:
                    best = max(best, end) if best else end
            at = at[PATH].get(segments[inner]) if inner < len(segments) - 1 else None
            inner += 1
    return best


def judge(spark: SparkSession, pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow", block: int = BLOCK) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages(page_id, url)."""
    rules = list(rules)
    out = pages.selectExpr("page_id", "url", "cast(null as string) as rule", "cast(null as string) as verdict", "array(0L, 0L, 0L) as rank")
    for lo in range(0, max(1, len(rules)), block):
        trie = spark.sparkContext.broadcast(build(rules[lo : lo + block]))

        def fold(batches: Iterator[pa.RecordBatch], trie=trie) -> Iterator[pa.RecordBatch]:
            root = trie.value
            for batch in batches:
                rows = list(zip(*(batch[c].to_pylist() for c in ("rule", "verdict", "rank")), strict=True))
                for i, url in enumerate(batch["url"].to_pylist()):
                    found = longest(root, *parts(url))
                    if found and list(map(int, found[0])) > rows[i][2]:
                        rows[i] = (found[1], found[2], list(map(int, found[0])))
                rule, verdict, rank = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(rank, pa.list_(pa.int64()))], names=["page_id", "url", "rule", "verdict", "rank"])

        out = out.mapInArrow(fold, out.schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [parts(url) for url in batch["url"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array([x[0] for x in both], pa.string()), pa.array([x[1] for x in both], pa.string()), batch["rule"], batch["verdict"].fill_null(default)], names=["page_id", "host", "path", "rule", "verdict"])

    kind = out.schema["page_id"].dataType.simpleString()
    return out.mapInArrow(finish, f"page_id {kind}, host string, path string, rule string, verdict string")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, load(spark, sf_dir, "pages"), RULES)


SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(rule_host, rule_path, verdict)),
f AS (SELECT DISTINCT host, path, rule_host, rule_path, verdict FROM (SELECT DISTINCT host, path FROM q) JOIN r
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
b AS (SELECT host, path, max_by(rule_host || rule_path, length(rule_host) + length(rule_path)) AS rule, max_by(verdict, length(rule_host) + length(rule_path)) AS verdict FROM f GROUP BY 1, 2)
SELECT page_id, q.host, q.path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN b ON q.host = b.host AND q.path = b.path
"""
